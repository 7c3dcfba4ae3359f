"""Errors raised by the package."""

from __future__ import annotations


class ProvenderError(RuntimeError):
    """Base of all errors raised on purpose."""


class DataError(ProvenderError):
    """A file is missing, or a table lacks what the job needs."""


class RuleError(ProvenderError):
    """A rule pack is inconsistent."""
