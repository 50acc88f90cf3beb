"""All registered queries and their oracle SQL (imported for their side effect of registering)."""

from __future__ import annotations

import importlib

from vecspark.catalog.registry import ORACLE, QUERIES

_MODULES = ("q_knn", "q_predicates", "q_sparse", "q_cells", "q_workload", "q_subsets", "q_ranges", "q_quality",
            "q_stream", "q_reports", "q_io", "q_files", "q_gen")

for _m in _MODULES:
    try:
        importlib.import_module(f"vecspark.catalog.{_m}")
    except ModuleNotFoundError as e:  # module not written yet
        if e.name != f"vecspark.catalog.{_m}":
            raise


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
