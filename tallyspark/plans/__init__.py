"""Registered queries over the fixture tables and their SQL."""

from . import boxscore, domain, incremental, matchup, more, relational, windowed  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "feature_pipeline"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
