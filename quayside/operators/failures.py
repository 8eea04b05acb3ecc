"""Classification and redaction of recorded failures, and what may be tried again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contracts import ERROR_CATEGORIES, SAFE_STRATEGIES
from quayside.errors import UNKNOWN, UNNAMED_CODE
from quayside.functions.text import IDENTIFIER, full_match


def redact_errors(errors: DataFrame) -> DataFrame:
    """Replace ``category, code, message, retryable`` by what may be shown. A failure of a known category
    keeps its code; anything else becomes one fixed code. The raw message never passes through."""
    known = F.coalesce(F.col("category").isin(*ERROR_CATEGORIES), F.lit(False))
    named = F.when(full_match(F.col("code"), IDENTIFIER), F.col("code")).otherwise(UNNAMED_CODE)
    category = F.when(known, F.col("category")).otherwise(UNKNOWN["category"])
    code = F.when(known, named).otherwise(UNKNOWN["code"])
    return errors.withColumns(
        {
            "category": category,
            "code": code,
            "message": F.concat(code, F.lit(" ("), category, F.lit(")")),
            "retryable": known & F.coalesce(F.col("retryable"), F.lit(False)),
        }
    )


def retry_eligible() -> Column:
    """May this failed attempt run again on its own? Every condition has to hold; NULL counts as no."""
    conditions = [
        F.col("status").isin("FAILED", "TIMED_OUT"),
        ~F.col("execution_uncertain"),
        F.col("retryable"),
        F.array_contains(F.col("retry_categories"), F.col("error_category")),
        F.col("attempt") <= F.col("max_retries"),
        F.col("strategy").isin(*SAFE_STRATEGIES),
        F.col("eligible"),
    ]
    verdict = F.lit(True)
    for condition in conditions:
        verdict = verdict & F.coalesce(condition, F.lit(False))
    return verdict
