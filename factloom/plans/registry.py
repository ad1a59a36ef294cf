"""All queries of the fact engine, gathered from the modules that define them."""

from __future__ import annotations

from factloom.plans import coherence, core, domains, history, logs, relational, resources, rules, traces

FLAGSHIP = "slice_findings"
MODULES = (core, relational, rules, coherence, history, logs, traces, resources, domains)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.plan.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.plan.oracle.items()}
