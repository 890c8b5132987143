"""The query registry and the SQL text of the derived inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register `fn(spark, folder) -> DataFrame` under `name`."""
    def keep(fn):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, fn, tuple(covers.split()), sql)
        return fn
    return keep


LABELLED = """
SELECT r_name AS industry, s_name AS org, concat('G', CAST(bn % 5 AS STRING)) AS parent_aspect,
       p_brand AS aspect,
       CASE WHEN l_quantity <= 5 + 3*(bn % 10) THEN 'negative'
            WHEN l_quantity <= 8 + 3*(bn % 10) THEN 'neutral' ELSE 'positive' END AS sentiment,
       l_linestatus AS source, l_shipdate AS ts, l_orderkey, l_linenumber, l_suppkey
FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS bn
      FROM lineitem JOIN part ON l_partkey = p_partkey
      JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t
"""

CELLS = """
SELECT industry, org, parent_aspect, aspect, count(*) AS total_count,
       count(*) FILTER (sentiment = 'negative') AS neg_count,
       count(*) FILTER (sentiment = 'neutral') AS neu_count,
       count(*) FILTER (sentiment = 'positive') AS pos_count
FROM feedback GROUP BY ALL
"""

STEPS = """
SELECT concat(CAST(user_id AS STRING), '-', CAST(CAST(date_trunc('week', ts) AS DATE) AS STRING)) AS run_id,
       concat('T', CAST(user_id % 10 + 1 AS STRING), '-E', CAST(user_id % 5 + 1 AS STRING)) AS task_id,
       concat('agent', CAST(user_id % 4 AS STRING)) AS agent, user_id % 5 AS seed,
       row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) - 1 AS idx,
       event_type AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       event_id, ts, value AS latency_s, props,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS tokens
FROM events
"""

RATINGS = """
SELECT doc_id AS unit, 'r' || r AS rater, CAST((doc_id * 7 + r * (doc_id % 3)) % 6 AS INT) AS score
FROM documents, (VALUES (1), (2), (3)) v(r) WHERE (doc_id + r) % 11 <> 0
"""

REFERENCES = """
SELECT doc_id AS unit, CAST(n_chars % 6 AS INT) AS judge_score,
       CAST(doc_id * 7 % 6 AS INT) AS intended_score, CAST(doc_id % 10 + 1 AS INT) AS template
FROM documents
"""


def _with(views: dict[str, str], body: str) -> str:
    """`body` under the named views; a body starting with a comma adds views of its own."""
    head = ", ".join(f"{name} AS ({text})" for name, text in views.items())
    return f"WITH {head}{body}" if body.lstrip().startswith(",") else f"WITH {head} {body}"


def on_feedback(body: str) -> str:
    return _with({"feedback": LABELLED}, body)


def on_cells(body: str) -> str:
    return _with({"feedback": LABELLED, "cells": CELLS}, body)


def on_steps(body: str) -> str:
    return _with({"steps": STEPS}, body)


def on_ratings(body: str) -> str:
    return _with({"ratings": RATINGS, "refs": REFERENCES}, body)
