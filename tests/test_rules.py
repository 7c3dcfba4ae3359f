import pytest
from pyspark.sql import functions as F

from provender.errors import RuleError
from provender.operators import decode
from provender.operators.normalize import normalize
from provender.rules import conditional
from provender.rules import fixed_values as V
from provender.rules.conditional import Rule, When
from provender.rules.fixed_values import HIERARCHY
from provender.rules.ruleset import RuleSet, category_groups, close_corrections, tag_gates

# Gate sizes per category, cumulative and isolated. Meat and Meals are without "whipped".
GATE_SIZES = {
    "Fruit": (53, 53),
    "Vegetables": (53, 49),
    "Roots & Tubers": (54, 50),
    "Produce": (54, 49),
    "Legumes": (54, 49),
    "Butter": (60, 54),
    "Cheese": (61, 55),
    "Milk": (62, 55),
    "Yogurt": (62, 55),
    "Milk & Dairy": (62, 54),
    "Beef": (127, 114),
    "Eggs": (128, 115),
    "Seafood": (128, 53),
    "Grain Products": (128, 48),
    "Beverages": (133, 54),
    "Meals": (132, 47),
    "Condiments & Snacks": (133, 53),
    "Non-Food": (133, 48),
}


@pytest.mark.parametrize("category", GATE_SIZES)
def test_gate_sizes(category):
    cumulative, isolated = GATE_SIZES[category]
    assert len(tag_gates()[category]) == cumulative
    assert len(tag_gates(scoping="isolated")[category]) == isolated


def test_category_in_two_groups_keeps_the_last():
    groups = category_groups(HIERARCHY)
    assert groups["Legumes"] == "Bread, Grains & Legumes"
    assert list(groups).index("Legumes") == 4 and len(groups) == 27


def test_corrections_are_followed_to_their_end():
    closed = close_corrections({"a": "b", "b": "c", "d": "e"})
    assert closed == {"a": "c", "b": "c", "d": "e"}


def test_correction_cycles_are_refused():
    with pytest.raises(RuleError):
        close_corrections({"a": "b", "b": "a"})


def test_rules_without_tokens_are_refused():
    with pytest.raises(RuleError):
        RuleSet.build(token_rules=[Rule("no token", When(type="snack"), drop=True)])


def test_unknown_lists_and_columns_are_refused():
    with pytest.raises(RuleError):
        RuleSet.build(token_rules=[Rule("list", When(lists="nowhere"), drop=True)])
    with pytest.raises(RuleError):
        RuleSet.build(type_map={"x": {"Colour": "red"}})


def test_pack_from_directory(spark, tmp_path, make_rows):
    (tmp_path / "corrections.csv").write_text('raw,clean\naple,apple\n"x, y",z\n')
    (tmp_path / "skipped.csv").write_text("token\nshiny\n")
    (tmp_path / "types.csv").write_text(
        "type,column,value\ncider,Basic Type,juice\ncider,Sub-Types,apple\n"
        "cider,Sub-Types,cider\ncider,Shape,cut\n"
    )
    (tmp_path / "overrides.csv").write_text(
        "product_type,column,value\nPT ONE,Basic Type,thing\nPT ONE,Food Product Group,Meat\n"
    )
    (tmp_path / "vocabularies.csv").write_text("list,token\nflavors,moss\n")
    (tmp_path / "tag_scopes.csv").write_text("scope,column,tag\nAll,Shape,cut\nFruit,Skin,peeled\n")
    pack = RuleSet.from_directory(spark, str(tmp_path))
    assert pack.corrections == {"aple": "apple", "x, y": "z"}
    assert pack.type_map["cider"]["Sub-Types"] == ["apple", "cider"]
    assert pack.vocabularies["flavors"] == ("moss",)
    assert pack.gates["Fruit"] == {"cut": "Shape", "peeled": "Skin"}
    rows = make_rows(
        [
            ("Beverages", "Beverages", None, "x", "cider, shiny, moss"),
            ("Produce", "Fruit", None, "x", "aple, cut, frozen"),
            ("Produce", "Fruit", None, "PT ONE", "aple"),
        ]
    )
    out = {r["row_id"]: r for r in normalize(rows, pack).collect()}
    assert out[0]["Normalized Name"] == "juice, apple, cider, flavored, cut"
    assert out[1]["Normalized Name"] == "apple, frozen, cut"
    assert (out[2]["Basic Type"], out[2]["Food Product Group"]) == ("thing", "Meat")


def test_own_rules(make_rows):
    pack = RuleSet.build(
        token_rules=[
            Rule("a", When("glow", group="Meat", not_type="beef"), assign={"Skin": "lit"}, drop=True),
            Rule("b", When("glow"), rename="dim"),
            Rule("c", When("first"), add=("front", "row"), front=True, drop=True),
        ]
    )
    rows = make_rows(
        [
            ("Meat", "Pork", None, "x", "pork, glow, z, first"),
            ("Meat", "Beef", None, "x", "beef, glow"),
        ]
    )
    out = {r["row_id"]: r for r in normalize(rows, pack).collect()}
    assert out[0]["Sub-Types"] == ["front", "row", "z"] and out[0]["Skin"] == "lit"
    assert out[1]["Sub-Types"] == ["dim"]


def test_a_pack_survives_being_written_and_read(spark, make_rows, rules, tmp_path):
    """All tables: the pack read back is equal and gives equal results."""
    rules.to_directory(spark, str(tmp_path / "pack"))
    pack = RuleSet.from_directory(spark, str(tmp_path / "pack"))
    for name in RuleSet.__dataclass_fields__:
        if name != "compiled":
            assert getattr(pack, name) == getattr(rules, name), name
    rows = make_rows(
        [
            ("Meat", "Beef", "Beef", "x", "beef, taco meat, popper"),
            ("Bread, Grains & Legumes", "Grain Products", None, "x", "cereal, apple jacks"),
            ("Meat", "Pork", "Pork", "BOLOGNA ALL MEAT", "bologna, sliced"),
        ]
    )
    assert normalize(rows, pack).collect() == normalize(rows, rules).collect()


def test_odd_rules_are_refused():
    with pytest.raises(RuleError, match="odd"):
        conditional.rule_from_dict({"name": "odd", "when": [{"tokens": ["a"]}], "unheard_of": 1})
    with pytest.raises(RuleError):
        conditional.rule_from_dict({"name": "no condition"})


def test_own_hierarchy(spark):
    pack = RuleSet.build(hierarchy={"Toys": ["Balls"], **V.HIERARCHY})
    assert pack.category_groups["Balls"] == "Toys" and "Balls" in pack.gates
    row = spark.range(1).select(
        decode.inconsistent(F.lit("Toys"), F.lit("Balls"), F.lit("Balls"), pack.hierarchy)
    )
    assert row.first()[0] is False
