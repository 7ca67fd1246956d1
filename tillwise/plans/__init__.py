"""Input views and registered queries."""

from __future__ import annotations

import importlib

MODULES = ["sales_reports", "profile_reports", "catalog_reports", "cleaning_checks",
           "text_reports", "erp_reports", "governance_reports",
           "model_reports"]


def load_all():
    from tillwise.plans.registry import ORACLE, QUERIES

    for m in MODULES:
        importlib.import_module(f"tillwise.plans.{m}")
    return QUERIES, ORACLE
