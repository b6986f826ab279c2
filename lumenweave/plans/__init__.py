"""Registered queries over the driver's tables, and their SQL."""

from lumenweave.plans import blocks, containers, frames, halo, images, records, scalars, tables, tokens

_MODULES = (blocks, containers, frames, halo, images, records, scalars, tables, tokens)


def queries():
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
