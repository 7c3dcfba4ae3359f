"""Provender: normalization and classification of food purchase records on Spark."""

from provender.errors import DataError, ProvenderError, RuleError
from provender.operators.clean import add_group_and_commodity, clean_rows, fill_group
from provender.operators.normalize import normalize
from provender.rules.ruleset import RuleSet

__all__ = [
    "DataError",
    "ProvenderError",
    "RuleError",
    "RuleSet",
    "add_group_and_commodity",
    "clean_rows",
    "fill_group",
    "normalize",
]
