"""The catalog's logical tables, derived from the synthetic star schema by SQL that Spark and DuckDB both run.

Each entry of TABLES is a SELECT with {names} of raw tables or of other entries. `logical()` resolves them to DataFrames
(lazily, nothing is materialised), `with_clause()` to a chain of common table expressions for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The instant at which time windows over event-based tables and over score-based tables end.
AS_OF = "2024-01-31 00:00:00"
SCORES_AS_OF = "2001-11-05 00:00:00"
RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

_DAY = "TIMESTAMP '2024-01-01 00:00:00'"

TABLES: dict[str, str] = {
    "papers": f"""
        SELECT CAST(doc_id AS STRING) AS id, doc_id AS seq, substr(text, 1, 80) AS title, text AS abstract,
               CASE doc_id % 4 WHEN 0 THEN 'narrated' WHEN 1 THEN 'narrating' WHEN 2 THEN 'unnarrated' ELSE 'failed' END AS status,
               CASE WHEN doc_id % 4 = 3 THEN concat('error ', CAST(doc_id % 5 AS STRING)) END AS error_message,
               doc_id % 5 AS retry_count,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('tok', CAST(doc_id % 17 AS STRING)) END AS submitted_by_token,
               concat('ip', CAST(doc_id % 23 AS STRING)) AS submitted_by_ip,
               CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS submitted_by_country, source AS submitted_by_city,
               n_chars AS script_char_count, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars * 3 END AS tar_bytes,
               CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars * 2 END AS latex_char_count, doc_id % 9 AS figure_count,
               {_DAY} + doc_id * INTERVAL '1' HOUR AS created_at,
               CASE WHEN doc_id % 4 = 0 THEN {_DAY} + doc_id * INTERVAL '1' HOUR + INTERVAL '30' MINUTE END AS completed_at,
               {_DAY} + doc_id * INTERVAL '1' HOUR + (doc_id % 50) * INTERVAL '1' MINUTE AS updated_at
        FROM {{documents}}""",
    "page_visits": """
        SELECT event_id AS id, CAST(event_id % 1300 AS STRING) AS paper_id, concat('ip', CAST(user_id % 97 AS STRING)) AS visitor_ip,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS visitor_token, ts AS visited_at
        FROM {events} WHERE event_type = 'view'""",
    "rating_events": """
        SELECT event_id AS id, CAST(user_id % 211 AS STRING) AS paper_id, concat('u', CAST(user_id AS STRING)) AS rater_token,
               concat('ip', CAST(user_id % 97 AS STRING)) AS rater_ip, 1 + CAST(floor(value) AS BIGINT) % 5 AS stars, ts AS created_at
        FROM {events} WHERE event_type IN ('purchase', 'signup') AND value IS NOT NULL""",
    "ratings": """
        SELECT id, paper_id, rater_token, rater_ip, stars, created_at FROM (
            SELECT *, row_number() OVER (PARTITION BY paper_id, rater_token ORDER BY created_at DESC, id DESC) AS newest FROM {rating_events}
        ) r WHERE newest = 1""",
    "submissions": """
        SELECT event_id AS id, concat('ip', CAST(user_id % 20 AS STRING)) AS ip_address, ts AS submitted_at FROM {events} WHERE event_type = 'signup'""",
    "listens": """
        SELECT user_token, paper_id, position, updated_at FROM (
            SELECT concat('u', CAST(user_id % 40 AS STRING)) AS user_token, CAST(event_id % 60 AS STRING) AS paper_id, value AS position, ts AS updated_at,
                   row_number() OVER (PARTITION BY user_id % 40, event_id % 60 ORDER BY ts DESC, event_id DESC) AS newest
            FROM {events} WHERE event_type = 'click'
        ) l WHERE newest = 1""",
    "lists": """
        SELECT c_custkey AS id, concat('owner', CAST(c_custkey % 37 AS STRING)) AS owner_token,
               CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'Untitled Collection' WHEN c_custkey % 2 = 0 THEN lower(c_name) ELSE c_name END AS name,
               c_custkey % 3 AS publicly_listed, TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' MINUTE AS created_at
        FROM {customer}""",
    "list_items": """
        SELECT o_orderkey AS id, o_custkey AS list_id, CAST(o_orderkey % 1200 AS STRING) AS paper_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderdate AS added_at
        FROM {orders}""",
    "narration_versions": """
        SELECT o_orderkey AS id, CAST(o_custkey % 900 AS STRING) AS paper_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'plus3' WHEN '2' THEN 'plus2' WHEN '3' THEN 'plus1' ELSE 'base' END AS narration_tier,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 40 WHEN '2' THEN 30 WHEN '3' THEN 20 WHEN '4' THEN 10 ELSE 5 END AS quality_rank,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('audio/', CAST(o_orderkey AS STRING), '.mp3') END AS audio_key,
               CASE o_orderkey % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'regex' END AS scripter_mode,
               o_totalprice / 1000000 AS llm_cost, o_orderkey % 4000 AS script_latency_ms, o_orderdate AS created_at
        FROM {orders}""",
    "narration_scores": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id,
               l_orderkey AS version_id, 1 - l_discount AS score_fidelity, 1 - l_tax AS score_citations,
               CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity / 50 END AS score_header,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1 - l_tax / 2 END AS score_figures, 1 - l_discount / 2 AS score_tts,
               CASE WHEN l_linestatus = 'O' THEN concat('c', CAST(year(l_shipdate) AS STRING)) END AS parser_commit, l_shipdate AS scored_at
        FROM {lineitem}""",
    "parser_versions": """
        SELECT commit_hash, tier, TIMESTAMP '2001-10-01 00:00:00' + (min(p_partkey) % 40) * INTERVAL '1' DAY AS registered_at
        FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN concat('c', CAST(1992 + p_size % 11 AS STRING)) ELSE p_brand END AS commit_hash,
                     CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'plus1' END AS tier FROM {part}) p
        GROUP BY commit_hash, tier""",
    "job_events": """
        SELECT user_id AS paper, ts, event_id,
               CASE event_type WHEN 'signup' THEN 'narrating' WHEN 'error' THEN 'failed' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'narrated' ELSE 'narrating' END END AS status,
               CASE WHEN event_type = 'click' THEN value END AS eta,
               CASE WHEN event_type = 'error' THEN concat('error ', CAST(event_id % 5 AS STRING)) END AS error,
               event_type = 'purchase' AS side,
               CASE WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN concat('transcripts/', CAST(event_id AS STRING)) END AS transcript_key
        FROM {events}""",
    "training_rows": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id, p_brand AS provider_model,
               l_extendedprice AS latex_char_count, l_linenumber AS figure_count, p_retailprice AS tar_bytes, l_quantity * 100 AS script_char_count,
               0.3 * l_extendedprice + 85 * l_linenumber + 0.1 * p_retailprice + 500 AS actual_input_tokens,
               CASE WHEN l_tax > 0.07 THEN NULL ELSE 25 * l_quantity + 40 END AS actual_output_tokens
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def logical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The logical or raw table `name`."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    return spark.sql(sql, **{n: logical(spark, sf_dir, n) for n in _names(sql)})


def with_clause(*names: str) -> str:
    """WITH ... of the logical tables that `names` need, in order of dependence."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES and name not in order:
            for n in _names(TABLES[name]):
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n].format(**{x: x for x in _names(TABLES[n])})})" for n in order)


def oracle(select: str, *names: str) -> str:
    """DuckDB SQL: `select` over the logical tables `names`."""
    return f"{with_clause(*names)}\n{select}"
