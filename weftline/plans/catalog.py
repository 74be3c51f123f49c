"""Imports every module that registers queries."""

from __future__ import annotations

from weftline.operators import articles, bootstrap, collation, containment, corrections, generators, groupstats, metrics, multihop, negatives, packing, quantiles, relational, retrieval, sampling, scans, scoring, streams, tablefunctions, tasks, textqueries, tokens, vectorindex  # noqa: F401
from weftline.plans.oracles import INDEPENDENT
from weftline.plans.registry import ORACLES, QUERIES, Query

if unknown := set(INDEPENDENT) - set(QUERIES):
    raise ValueError(f"oracles without queries: {sorted(unknown)}")
ORACLES.update(INDEPENDENT)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
