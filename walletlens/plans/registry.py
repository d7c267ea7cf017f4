"""All registered queries with their oracle SQL."""

from __future__ import annotations

from walletlens.plans import ingest, profiles, reporting

ALL = {**ingest.QUERIES, **profiles.QUERIES, **reporting.QUERIES}
FLAGSHIP = "monthly_profile_text"


def queries():
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql is not None}
