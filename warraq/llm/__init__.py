"""Training-data operators: one module for each, and the queries that apply them to whole tables.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` are what
``__spark_entry__`` adds to its own when the subpackage is present.
"""

from __future__ import annotations

from importlib import import_module

#: Module of each operator, by its number.
MODULES = {
    1: "mixture",
    2: "shingle_join",
    3: "phrase_print",
    4: "secret_scan",
    5: "packing",
    6: "ppm",
    7: "quality",
    8: "token_count",
    9: "exact_dedup",
    10: "shards",
    11: "ball_hash",
    12: "hard_negatives",
    13: "prefix_trie",
}


def queries():
    """Name to callable (spark, sf_dir) for every operator of the subpackage."""
    found = {}
    for name in MODULES.values():
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql():
    """Name to DuckDB SQL for the operators that SQL can express."""
    found = {}
    for name in MODULES.values():
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLES", {})
    return found
