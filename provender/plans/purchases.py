"""Purchase rows derived from the order tables, for queries and benchmarks.

The test tables hold no food names. Each line item becomes one purchase: its keys pick a base
product and up to four modifiers from fixed word lists with integer arithmetic only, so Spark and
SQL build the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provender import schema as S
from provender.functions.expressions import constant
from provender.functions.partitions import dealt, spread
from provender.sources.readers import (
    NORMALIZED_PRODUCT_TYPE,
    missing_to_null,
    prefer_normalized_product_type,
)

# Fixed values: (group, category, primary category, first token).
CASES = [
    ("Produce", "Fruit", "Fruit", "Cranberries"),
    ("Produce", "Fruit", "Fruit", "apple"),
    ("Produce", "Fruit", "Whole/Minimally Processed", "fruit"),
    ("Produce", "Fruit", "Fruit", "fruit basket"),
    ("Produce", "Fruit", "Fruit", "honeydew"),
    ("Produce", "Vegetables", "Vegetables", "salad"),
    ("Produce", "Vegetables", "Vegetables", "chickpea"),
    ("Produce", "Vegetables", "Vegetables", "chili"),
    ("Produce", "Vegetables", "Vegetables", "paprika"),
    ("Produce", "Vegetables", "Vegetables", "vegetable"),
    ("Produce", "Vegetables", "Vegetables", "herb"),
    ("Produce", "Roots & Tubers", "Roots & Tuber", "Sweet Potato"),
    ("Produce", "Produce", "Produce", "bell pepper"),
    ("Bread, Grains & Legumes", "Legumes", "Legumes", "bean"),
    ("Milk & Dairy", "Butter", "Butter", "butter"),
    ("Milk & Dairy", "Cheese", "Cheese", "cheese"),
    ("Milk & Dairy", "Cheese", "Cheese", " Mozzerella"),
    ("Milk & Dairy", "Milk", "Milk", "milk"),
    ("Milk & Dairy", "Yogurt", "Yogurt", "yogurt"),
    ("Milk & Dairy", "Yogurt", "Yogurt", "yogurt alternative"),
    ("Milk & Dairy", "Milk & Dairy", "Milk & Dairy", "ice cream"),
    ("Milk & Dairy", "Milk & Dairy", "Milk & Dairy", "plant milk"),
    ("Meat", "Beef", "Beef", "beef"),
    ("Meat", "Beef", "Beef", "gyro meat"),
    ("Meat", "Chicken", "Chicken", "chicken"),
    ("Meat", "Chicken", "Chicken", "chicken nugget"),
    ("Meat", "Eggs", "Eggs", "Egg"),
    ("Meat", "Pork", "Pork", "bologna"),
    ("Meat", "Pork", "Pork", "chorizo"),
    ("Meat", "Turkey, Other Poultry", "Turkey, Other Poultry", "turkey"),
    ("Meat", "Meat", "Meat", "bison"),
    ("Seafood", "Fish (Farm-Raised)", "Fish (Farm-Raised)", "Talapia"),
    ("Seafood", "Fish (Wild)", "Fish (Wild)", "tuna"),
    ("Seafood", "Seafood", "Seafood", "shrimp"),
    ("Bread, Grains & Legumes", "Grain Products", "Grain Products", "cereal"),
    ("Bread, Grains & Legumes", "Grain Products", "Grain Products", "bread"),
    ("Bread, Grains & Legumes", "Grain Products", "Grain Products", "rotini"),
    ("Bread, Grains & Legumes", "Rice", "Rice", "rice"),
    ("Bread, Grains & Legumes", "Tree Nuts & Seeds", "Tree Nuts & Seeds", "almond"),
    ("Bread, Grains & Legumes", "Bread, Grains & Legumes", "Legumes", "oat"),
    ("Beverages", "Beverages", "Beverages", "juice"),
    ("Beverages", "Beverages", "Beverages", "beverage"),
    ("Beverages", "Beverages", "Beverages", "tea"),
    ("Meals", "Meals", "Meals", "Entree"),
    ("Meals", "Meals", "Beef", "pizza"),
    ("Meals", "Meals", "Vegetables", "meal kit"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "condiment"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "snack"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "snack, bar"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "chip"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "salsa"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "chili"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "spice"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "cookie"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "dessert"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "pickle, pickle"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "supplement"),
    ("Condiments & Snacks", "Condiments & Snacks", "Condiments & Snacks", "mix"),
    ("Non-Food", "Non-Food", "Supplies", "napkin"),
    ("Produce", "Unlisted", None, "apple"),
    (None, None, None, "bread"),
]

# Further tokens, raw, with spelling variants and stray white space.
MODIFIERS = [
    "dried", "ss", "Sliced", " frozen", "cut", "canned", "greek", "variety", "vanilla",
    "chocolate", "cheddar", "mozzarella", "provolone", "blue", "apple", "pear", "Orange",
    "cantaloupe", "watermelon", "honeydew", "gherkin", "apple jacks", "cap'n crunch",
    "life", "special k", "popcorn", "popper", "pulled", "shredded", "stick", "taco meat",
    "grated", "powder", "base", "mix", "chip", "string", "bar", "watercress", "ham",
    "pepperoni", "bacon", "breast", "bone in", "skin-on", "smoked", "ROASTED", "baked",
    "instant", "black", "red", "organic", "fresh ", "reduced fat", "sugar-free",
    "Gluten-Free", "whole wheat", "non dairy", "decaf", "diet", "iced", "in brine",
    "in olive oil", "in heavy syrup", "almond", "walnut", "peanut butter and jelly",
    "fajita", "applesauce", "fruit medley", "fruit and vegetable", "funnel cake",
    "vanilla chocolate almond", "fried onion", "vegetarian chili", "pea and carrot",
    "cheetos", "ham and cheese", "gusher", "dark chocolate", "cocoa chip", "raisin bran",
    "corn pops", "cheerios", "2% lactose free", "hanger", "low-fat", "nonfat", "honey",
    "ketchup", "whole", "peeled", "seasoned", "lime", "in water", "turtle", "liquid", "seed",
    "cookie", "thick", "wheat", "sugar", "crumb", "custard", "tortilla", "triangle", "parfait",
    "carrots", "onion", "broccoli", "\tcorn", "\xa0gala\xa0", "pickle", "commodity", "halal",
    "whipped", "stuffed", "1%", "evaporated", "hard-boiled", "steak", "sweet", "spicy", "",
    "crispix", "Crumbled", "feta cheese", "swiss", "gravy master", "mocha", "sauce",
    "Persian", "Cuban",
]

# Product types that have an override, and the row that is never kept.
OVERRIDE_KEYS = [
    "ROOT TARO MALANGA COCA",
    "EDAMAME SUCCOTASH BLEND",
    "SANDWICH CHILI CHS DOG IW",
    "DRINK TEA CHAI CASHEWMILK",
    "GRAIN, BLEND COUSCOUS TRI-COLOR QUINOA RESEALABLE BAG",
]
EXCLUDED_ROW = "Other Products + Fees ($4,640.56)"

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase per line item, as it would stand in a raw file.

    Two joins on dimension keys; Spark broadcasts part and supplier while their files are small
    and shuffles (with skew handling) beyond that. The joined keys are dealt to tasks by number of rows.
    """
    lineitem = read(spark, sf_dir, "lineitem").select(*LINE_KEYS)
    lines = spread(lineitem)
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    df = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    df = dealt(df.select(*LINE_KEYS, "p_brand", "s_name"), LINE_KEYS, lineitem.count())
    order, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")

    def pick(values: list, index, ddl: str = "string"):
        return F.get(constant(values, f"array<{ddl}>"), (index % len(values)).cast("int"))

    case = pick(
        [dict(zip(("g", "c", "p", "b"), c)) for c in CASES],
        F.col("l_partkey") + line,
        "struct<g:string,c:string,p:string,b:string>",
    )
    df = df.withColumn("case", case).withColumn("count", (order + line) % 5)
    modifiers = [
        F.when(F.col("count") > j, pick(MODIFIERS, supplier * (3 + j) + order + 17 * j))
        for j in range(4)
    ]
    name = F.concat(
        F.when(order % 31 == 0, "PREQUALIFIED: ").otherwise(""),
        F.concat_ws(", ", F.col("case.b"), *modifiers),
        F.when(order % 53 == 0, ", ").otherwise(""),
    )
    df = df.withColumn("name", F.when(order % 83 == 0, "NULL").otherwise(name))
    product_type = (
        F.when(order % 97 == 0, F.lit(None))
        .when(order % 89 == 0, "ab")
        .when(order % 101 == 0, EXCLUDED_ROW)
        .when(order % 61 == 0, pick(OVERRIDE_KEYS, supplier))
        .otherwise(
            F.concat(
                F.when(order % 7 == 0, "\t\xa0 ").otherwise(""),
                F.upper("name"),
                F.when(supplier % 3 == 0, " ALL MEAT ").otherwise(" "),
                F.col("p_brand"),
                F.when(order % 11 == 0, " \xa0").otherwise(""),
            )
        )
    )
    row = F.struct(
        F.concat_ws("-", *[F.lpad(F.col(k).cast("string"), 12, "0") for k in LINE_KEYS]).alias(
            S.ROW_ID
        ),
        F.concat_ws("-", *LINE_KEYS).alias("Unique Id"),
        F.col("s_name").alias("Origin Detail"),
        product_type.alias(S.PRODUCT_TYPE),
        F.when(order % 43 == 0, F.concat(F.lit("REVISED "), F.upper("name"))).alias(
            NORMALIZED_PRODUCT_TYPE
        ),
        F.col("name").alias(S.PRODUCT_NAME),
        F.col("case.g").alias(S.FPG),
        F.col("case.c").alias(S.FPC),
        F.col("case.p").alias(S.PFPC),
    )
    # Built once per row: filters further up must not be pushed below and build it again.
    return df.select(F.inline(F.array(row)))


def loaded_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw purchases after the loading step: missing text as null, product type override."""
    raw = raw_purchases(spark, sf_dir)
    return prefer_normalized_product_type(
        missing_to_null(raw, [c for c in raw.columns if c != S.ROW_ID])
    )
