"""Named queries over the given tables, each with the SQL it is compared to."""

from __future__ import annotations


def load():
    """(queries, sql) with every module of the catalog imported."""
    from bandsift.catalog import disk, evidence, lists, spectrum, streams, tables  # noqa: F401
    from bandsift.catalog.registry import QUERIES, SQL

    return QUERIES, SQL
