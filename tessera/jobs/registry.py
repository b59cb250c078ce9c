"""Every query of the library outside the llm subpackage, with its oracle SQL."""

from __future__ import annotations

from . import bayes, groups, models, online, plans, ratings, readers, search, text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (ratings, text, bayes, models, search, groups, plans, online, readers):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
