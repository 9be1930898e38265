"""All registered queries of the engine's own operators."""

from __future__ import annotations

from weftline.plans import queries_core, queries_more, queries_report, queries_sampling, queries_selection, queries_steps, queries_study, registry  # noqa: F401


def queries():
    return registry.QUERIES


def oracles():
    return registry.ORACLES
