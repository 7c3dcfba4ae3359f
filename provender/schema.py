"""Column names of the purchase tables.

Fixed values: these names and orders are the file formats users exchange.
"""

from __future__ import annotations

PRODUCT_TYPE = "Product Type"
PRODUCT_NAME = "Product Name"
FPG = "Food Product Group"
FPC = "Food Product Category"
PFPC = "Primary Food Product Category"
BASIC_TYPE = "Basic Type"
SUB_TYPES = "Sub-Types"
MISC = "Misc"
NORMALIZED_NAME = "Normalized Name"
ROW_ID = "row_id"

ID_COLUMNS = ["Unique Id", "Origin Detail"]
GROUP_COLUMNS = [PRODUCT_TYPE, PRODUCT_NAME, FPG, FPC, PFPC]

SUB_TYPE_COLUMNS = ["Sub-Type 1", "Sub-Type 2", "Sub-Type 3"]
TAG_COLUMNS = [
    "Flavor/Cut",
    "Shape",
    "Skin",
    "Seed/Bone",
    "Processing",
    "Cooked/Cleaned",
    "WG/WGR",
    "Dietary Concern",
    "Additives",
    "Dietary Accommodation",
    "Frozen",
    "Packaging",
    "Commodity",
]
NORMALIZED_COLUMNS = [BASIC_TYPE, *SUB_TYPE_COLUMNS, *TAG_COLUMNS]
EXPORT_COLUMNS = [PRODUCT_TYPE, FPG, FPC, PFPC, PRODUCT_NAME, *NORMALIZED_COLUMNS]

MISC_EXPORT_COLUMNS = [
    PRODUCT_TYPE,
    PRODUCT_NAME,
    FPG,
    FPC,
    BASIC_TYPE,
    "Sub-Type 1",
    "Sub-Type 2",
    MISC,
]

# Classifier heads. The sub-type columns share one head, "Sub-Types", which comes last.
CATEGORY_LABELS = [FPG, FPC, PFPC]
LABELS = [*CATEGORY_LABELS, BASIC_TYPE, *TAG_COLUMNS, *SUB_TYPE_COLUMNS]
HEADS = [*CATEGORY_LABELS, BASIC_TYPE, *TAG_COLUMNS, SUB_TYPES]
PREDICTION_KEYS = ["Product Identifier", PRODUCT_TYPE]
PREDICTION_COLUMNS = [
    *PREDICTION_KEYS,
    *CATEGORY_LABELS,
    BASIC_TYPE,
    *SUB_TYPE_COLUMNS,
    *TAG_COLUMNS,
]

# Text that pandas' CSV reader treats as a missing value, plus the empty field.
MISSING_TEXT = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]
# The training label that stands for "no value".
NO_LABEL = "None"


def quoted(name: str) -> str:
    """The name as a column reference that is safe for names such as ``Sub-Type 1``."""
    return "`" + name.replace("`", "``") + "`"
