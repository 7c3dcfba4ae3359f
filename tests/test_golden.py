"""One case per kind of rule and per quirk of the normalization."""

import pytest

from provender import schema as S
from provender.operators.normalize import normalize
from provender.rules.ruleset import RuleSet

CONDIMENTS = ("Condiments & Snacks", "Condiments & Snacks")
GRAIN = ("Bread, Grains & Legumes", "Grain Products")

# group, category, primary, product type, product name -> normalized name
CASES = [
    (("Produce", "Fruit", None, "x", "Cranberries, dried, ss"), "cranberry, dried, ss"),
    (
        ("Milk & Dairy", "Yogurt", None, "x", "yogurt, greek, variety, ss"),
        "yogurt, greek, flavored, ss",
    ),
    (("Meat", "Eggs", None, "x", "Egg, hard-boiled"), "eggs, hard boiled"),
    (("Produce", "Fruit", None, "x", "apple, gala, "), "apple, gala, "),
    ((*CONDIMENTS, None, "x", "condiment, gherkin"), "condiment"),
    ((*GRAIN, None, "x", "cereal, apple jacks"), "cereal, corn, wheat, oat"),
    (("Meat", "Chicken", None, "x", "chicken, popcorn"), "chicken, cut, breaded"),
    (("Milk & Dairy", "Cheese", None, "x", "cheese, blue, cheddar"), "cheese, blue, flavored"),
    (("Milk & Dairy", "Cheese", None, "x", "cheese, mozzarella, provolone"), "cheese, blend"),
    (("Beverages", "Beverages", None, "x", "juice, apple, orange"), "juice, flavored"),
    (("Produce", "Fruit", None, "x", "fruit, apple, pear"), "fruit, blend"),
    (("Meals", "Meals", "Meals", "x", "entree, apple, pear"), "entrée, fruit"),
    ((*CONDIMENTS, None, "x", "spice"), "seasoned"),
    ((*CONDIMENTS, None, "x", "snack, bar, oat"), "bar, oat"),
    (("Meat", "Pork", None, "BOLOGNA ALL MEAT", "bologna, sliced"), "beef, pork, bologna, cut"),
    (("Produce", "Vegetables", None, "x", "chickpea, roasted"), "snack, chickpea, cooked"),
    (("Produce", "Vegetables", None, "x", "chili"), "pepper, chili"),
    ((*CONDIMENTS, None, "x", "chili"), "spice, chili"),
    (("Produce", "Vegetables", "Vegetables", "x", "paprika"), "spice, paprika"),
    (("Non-Food", "Non-Food", "Non-Food", "x", None), ""),
    (("Produce", "Roots & Tubers", None, "ROOT TARO MALANGA COCA", "anything, x, y"), "taro"),
    (("Meat", "Beef", None, "x", "gyro meat, cut"), "beef, lamb, gyro, cut"),
    ((*GRAIN, None, "x", "bread, ham"), "bread, ham"),
    (("Produce", "Vegetables", None, "x", "salad, ham"), "salad, ham"),
    (("Meat", "Beef", None, "x", "beef, taco meat"), "beef, crumble, seasoned"),
    (("Produce", "Fruit", None, "x", "peach, sugar free, cut"), "peach, cut"),
    ((None, None, None, "x", "apple, frozen"), "apple, frozen"),
    # more rule kinds
    (("Meals", "Meals", "Beef", "x", "pizza, pepperoni"), "pizza, pepperoni"),
    (("Meat", "Pork", None, "x", "pork, pepperoni"), "pork, pepperoni"),
    (("Meat", "Beef", None, "x", "beef, pulled"), "beef, cut, cooked"),
    (("Produce", "Fruit", None, "x", "apple, pulled"), "apple"),
    (("Produce", "Vegetables", None, "x", "herb, watercress, cut"), "watercress, cut"),
    ((*CONDIMENTS, None, "x", "snack, walnut, swiss"), "snack, nut, cheese"),
    ((*CONDIMENTS, None, "x", "condiment, pickle, chip"), "condiment, pickle, cut"),
    # powder is a concentrate (Shape) and base a mix (Flavor/Cut) in beverages
    (("Beverages", "Beverages", None, "x", "juice, powder, base"), "juice, mix, concentrate"),
    ((*GRAIN, None, "x", "appetizer, popper"), "appetizer, cheese, breaded"),
    (("Produce", "Vegetables", None, "x", "salad, fried onion"), "salad, onion, fried"),
    ((*CONDIMENTS, None, "x", "honeydew, gusher"), "fruit snack, honeydew"),
    (("Produce", "Fruit", None, "x", "melon, cantaloupe, honeydew"), "melon, variety"),
    (("Produce", "Vegetables", None, "x", "soup, carrot, celery"), "soup, carrot, celery"),
    (("Meat", "Beef", None, "x", "beef, steak, brisket"), "beef, brisket, steak"),
    (("Produce", "Fruit", None, "x", "\xa0Apple\t,  CUT\xa0"), "apple, cut"),
]


@pytest.fixture(scope="module")
def results(make_rows):
    rows = normalize(make_rows([row for row, _ in CASES])).collect()
    return {row["row_id"]: row for row in rows}


@pytest.mark.parametrize("number", range(len(CASES)), ids=[c[0][4] or "none" for c in CASES])
def test_normalized_name(results, number):
    assert results[number][S.NORMALIZED_NAME] == CASES[number][1]


def _row(results, name):
    return next(r for r in results.values() if r[S.PRODUCT_NAME] == name)


def test_empty_token_is_a_subtype(results):
    assert _row(results, "apple, gala, ")[S.SUB_TYPES] == ["gala", ""]


def test_subtype_equal_to_type_is_removed_from_its_column_only(results):
    row = _row(results, "condiment, gherkin")
    assert row[S.SUB_TYPES] == ["condiment"] and row["Sub-Type 1"] is None


def test_brand_token_overflows(results):
    row = _row(results, "cereal, apple jacks")
    assert row[S.SUB_TYPES] == ["corn", "wheat", "oat", "apple jacks"]
    assert row[S.MISC] == ["apple jacks"]


def test_bologna_moves_to_beef(results):
    row = _row(results, "bologna, sliced")
    assert (row[S.FPC], row[S.PFPC]) == ("Beef", "Beef")


def test_spice_moves_group_but_not_primary(results):
    row = _row(results, "paprika")
    assert [row[c] for c in S.CATEGORY_LABELS] == [*CONDIMENTS, "Vegetables"]


def test_non_food_is_empty_with_null_misc(results):
    row = next(r for r in results.values() if r[S.FPC] == "Non-Food")
    assert all(row[c] is None for c in S.NORMALIZED_COLUMNS) and row[S.MISC] is None


def test_scope_decides_column_or_subtype(make_rows, results):
    assert _row(results, "bread, ham")["Flavor/Cut"] == "ham"
    assert _row(results, "salad, ham")["Sub-Type 1"] == "ham"
    isolated = normalize(
        make_rows([(*GRAIN, None, "x", "bread, ham")]), RuleSet.starter("isolated")
    ).first()
    assert isolated["Sub-Type 1"] == "ham" and isolated["Flavor/Cut"] is None


def test_no_category_no_columns(results):
    assert _row(results, "apple, frozen")["Sub-Type 1"] == "frozen"
