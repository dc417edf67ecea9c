"""Queries over the given tables, one or more per operator, and their SQL equivalents."""

from catalog import files, flows, streams

QUERIES = {**flows.QUERIES, **files.QUERIES, **streams.QUERIES}
ORACLE = {**flows.ORACLE, **files.ORACLE, **streams.ORACLE}
