"""Registered queries of the detection and extraction engine, and their SQL."""

from __future__ import annotations

from . import detection_queries, format_queries, legacy_queries, ocr_queries

MODULES = (detection_queries, format_queries, legacy_queries, ocr_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
