"""All registered queries of the engine."""

from __future__ import annotations

from lodestar.plans import curation, entities, inputs, links, ranking, relational, reports, structure, synthesis, texts, verify, winners
from lodestar.plans.registry import ORACLES, QUERIES, Query

MODULES = [relational, texts, ranking, synthesis, verify, entities, curation, reports, inputs, winners, links, structure]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
