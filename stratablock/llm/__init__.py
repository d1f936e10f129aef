"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
list its registered queries; ``__spark_entry__.py`` adds them when the
subpackage is present.
"""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "unigram",
    "line_dedup",
    "decontaminate",
    "quality",
    "html_extract",
    "simhash",
    "token_frames",
    "token_counts",
    "url_filter",
    "exact_dedup",
)


def queries() -> dict:
    """Registered queries of the ten operators: name -> f(spark, sf_dir)."""
    found: dict = {}
    for name in _MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those queries that SQL can express."""
    found: dict[str, str] = {}
    for name in _MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {})
    return found
