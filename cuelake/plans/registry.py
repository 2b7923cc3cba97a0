"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_more, queries_runs, queries_scale, queries_text, queries_upkeep

FLAGSHIP = "match_word_counts"
QUERIES: dict = queries_text.Q | queries_runs.Q | queries_more.Q | queries_upkeep.Q | queries_scale.Q
ORACLE_SQL: dict = queries_text.SQL | queries_runs.SQL | queries_more.SQL | queries_upkeep.SQL | queries_scale.SQL
