"""Typed failures raised by gates, scans and sinks, and what may be shown of them."""

from __future__ import annotations

from typing import Any

from quayside.contracts import ERROR_CATEGORIES

# What is shown where a failure has no known category, and in place of a code that is no plain name.
UNKNOWN = {"category": "INFRASTRUCTURE", "code": "UNEXPECTED_ERROR", "retryable": False}
UNNAMED_CODE = "APPLICATION_ERROR"
# The text of a shown failure names its class only; row content can't get into it.
MESSAGE = "{code} ({category})"


class DataFailure(Exception):
    """A classified failure: stable code, category and whether trying again can help."""

    def __init__(self, code: str, message: str, category: str = "DATA_QUALITY", retryable: bool = False):
        super().__init__(message)
        self.code, self.category, self.retryable = code, category, retryable


def source_unavailable(message: str = "The landed input set is unavailable.") -> DataFailure:
    return DataFailure("SOURCE_UNAVAILABLE", message, "INFRASTRUCTURE", retryable=True)


def public_error(error: BaseException) -> dict[str, Any]:
    """The shown form of one failure; ``failures.redact_errors`` gives the same for a column of them."""
    shown = dict(UNKNOWN)
    if getattr(error, "category", None) in ERROR_CATEGORIES:
        code = str(error.code)
        shown = {
            "category": error.category,
            "code": code if code.isidentifier() else UNNAMED_CODE,
            "retryable": bool(error.retryable),
        }
    return {**shown, "message": MESSAGE.format(**shown)}
