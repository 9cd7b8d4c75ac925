"""Registered queries over the ledger, each with the SQL that checks it."""

from tidemark.plans import accounting, behaviour, candidates, evaluation, fitting, history, ingest, lifecycle, live, matching, sets, simulate, strategies, summaries, timing
from tidemark.streaming import flows

_MODULES = (ingest, accounting, matching, behaviour, lifecycle, sets, strategies, simulate, flows, live, timing, candidates, evaluation, history, fitting, summaries)
QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
