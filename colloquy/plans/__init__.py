"""Queries over the tables, grouped by subject."""

from __future__ import annotations

from .registry import Registry


def all_plans() -> Registry:
    """Every registered query of the core."""
    from . import carry_plans, data_quality, interval_plans, match_plans, report_plans, sample_plans, score_plans, text_plans

    whole = Registry()
    for module in (data_quality, carry_plans, text_plans, interval_plans, score_plans, sample_plans, match_plans, report_plans):
        for name, f in module.registry.queries.items():
            whole.query(name, module.registry.sql.get(name))(f)
    return whole
