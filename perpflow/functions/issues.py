"""Findings as data: every check is a Column that yields NULL or an issue struct."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

ISSUE_TYPE = "struct<severity:string,category:string,message:string,subject:string>"
ISSUES_TYPE = f"array<{ISSUE_TYPE}>"


def issue(when: Column, severity: str | Column, category: str, message: str | Column,
          subject: str | None = None) -> Column:
    """An issue where ``when`` holds, NULL elsewhere (also where ``when`` is NULL)."""
    if isinstance(severity, str) and isinstance(message, str):
        # All literals: one parsed expression instead of a tree built call by call.
        name = "CAST(NULL AS STRING)" if subject is None else _text(subject)
        body = F.expr(f"named_struct('severity', {_text(severity)}, 'category', {_text(category)}, "
                      f"'message', {_text(message)}, 'subject', {name})")
        return F.when(when, body)
    level = F.lit(severity) if isinstance(severity, str) else severity
    text = F.lit(message) if isinstance(message, str) else message
    body = F.struct(
        level.alias("severity"), F.lit(category).alias("category"),
        text.alias("message"), F.lit(subject).cast("string").alias("subject"),
    )
    return F.when(when, body)


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def gather(checks: Sequence[Column]) -> Column:
    """All raised issues of a row, in check order."""
    if not checks:
        return F.array().cast(ISSUES_TYPE)
    return F.array_compact(F.array(*checks)).cast(ISSUES_TYPE)


def of_severity(issues: Column, severity: str) -> Column:
    return F.filter(issues, lambda i: i["severity"] == severity)


def has_error(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "ERROR")


def status(issues: Column) -> Column:
    """INVALID with any error, WARNING with any issue, else VALID."""
    return (
        F.when(has_error(issues), "INVALID")
        .when(F.size(issues) > 0, "WARNING")
        .otherwise("VALID")
    )
