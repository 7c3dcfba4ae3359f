from provender import schema as S
from provender.operators.clean import (
    add_group_and_commodity,
    build_name,
    clean_rows,
    fill_group,
)
from provender.sources.readers import missing_to_null, prefer_normalized_product_type


def _names(df):
    return {r["row_id"]: r for r in df.collect()}


def test_filters_and_repairs(make_rows):
    rows = make_rows(
        [
            ("Produce", "Fruit", "Fruit", None, "apple, cut"),  # no product type
            ("Produce", "Fruit", "Fruit", "ab", "apple, cut"),  # short product type
            ("Non-Food", "Non-Food", "Supplies", None, "napkin"),  # kept all the same
            ("Produce", "Fruit", "Fruit", "\t\xa0PEAR\xa0 ", "PREQUALIFIED: pear"),
            ("Produce", "Roots & Tubers", "Roots & Tuber", "YAM", "yam"),
            ("Produce", "Fruit", "Whole/Minimally Processed", "FIG", "fig"),
            ("Produce", "Fruit", "Fruit", "Other Products + Fees ($4,640.56)", "fees"),
            ("Non-Food", "Non-Food", None, "Other Products + Fees ($4,640.56)", "fees"),
            ("Produce", "Fruit", None, "KIWI", None),
            ("Produce", None, "Fruit", "PLUM", "plum"),
        ]
    )
    out = _names(clean_rows(rows))
    assert sorted(out) == [2, 3, 4, 5, 9]
    assert out[2][S.PRODUCT_NAME] is None and out[2][S.PFPC] == "Non-Food"
    assert out[2][S.PRODUCT_TYPE] is None
    assert (out[3][S.PRODUCT_TYPE], out[3][S.PRODUCT_NAME]) == ("PEAR", "pear")
    assert out[4][S.PFPC] == "Roots & Tubers"
    assert out[5][S.PFPC] == "Fruit"


def test_schema_is_fixed(spark):
    rows = spark.createDataFrame(
        [("TYPE", "name", "Fruit", "x")], "`Product Type` string, `Product Name` string, "
        "`Food Product Category` string, Other string"
    )
    out = clean_rows(rows)
    assert out.columns == [*S.ID_COLUMNS, *S.GROUP_COLUMNS]
    row = out.first()
    assert row[S.FPG] == "Produce" and row["Unique Id"] is None


def test_group_fill(spark):
    rows = spark.createDataFrame(
        [("Legumes", "old"), ("Nowhere", "old"), (None, "old")],
        "`Food Product Category` string, `Food Product Group` string",
    )
    assert {r[1] for r in fill_group(rows).collect()} == {"old"}
    filled = {r[S.FPC]: r for r in add_group_and_commodity(rows).collect()}
    assert filled["Legumes"][S.FPG] == "Bread, Grains & Legumes"
    assert filled["Nowhere"][S.FPG] is None and filled[None][S.FPG] is None
    assert filled["Legumes"]["Commodity"] is None


def test_name_is_built_from_columns(spark):
    rows = spark.createDataFrame(
        [("apple", None, "cut")], "`Basic Type` string, `Sub-Type 1` string, Shape string"
    )
    assert build_name(rows).first()[S.PRODUCT_NAME] == "apple, cut"


def test_missing_text(spark):
    rows = spark.createDataFrame([("NA", "x"), ("", "None"), ("nan", "n.a.")], "a string, b string")
    assert [tuple(r) for r in missing_to_null(rows).collect()] == [
        (None, "x"),
        (None, None),
        (None, "n.a."),
    ]


def test_normalized_product_type_wins(spark):
    rows = spark.createDataFrame(
        [("a", "b"), ("a", None)], "`Product Type` string, `Normalized Product Type` string"
    )
    out = prefer_normalized_product_type(rows)
    assert [r[S.PRODUCT_TYPE] for r in out.collect()] == ["b", "a"]
