"""Registered queries of the rhythm operators and their SQL."""

from . import context, cycles, nights, oracle, queries
from .queries import FLAGSHIP  # noqa: F401

ORACLE_BPM = {"prj18_bpm_ranges": oracle.sql(f"SELECT person, window_end, cluster, {context._BPM_SQL} FROM pt2", *oracle.upto("published"), nights._ROWS)}
QUERIES = {**queries.QUERIES, **context.QUERIES, **nights.QUERIES, **cycles.QUERIES}
ORACLES = {**queries.ORACLES, **context.ORACLES, **nights.ORACLES, **cycles.ORACLES, **ORACLE_BPM}
