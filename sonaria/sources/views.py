"""The catalog's tables as views over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (tables it reads, SQL that Spark and DuckDB both run)
VIEWS: dict[str, str] = {
    "roots": "SELECT r_regionkey AS id, r_name AS path, concat('Root ', r_name) AS label, r_regionkey <> 4 AS enabled FROM region",
    "libraries": """SELECT s_suppkey AS id, n_regionkey AS root_id, s_name AS name, concat(n_name, '/', s_name) AS path, n_name AS category,
        CAST(round(abs(s_acctbal) * 100) AS BIGINT) * 10000 AS size_bytes, s_suppkey % 50 AS file_count, s_suppkey % 7 AS nki_count,
        s_suppkey % 3 AS junk_count, (s_suppkey % 3) * 30000000 AS junk_bytes, s_suppkey % 4 <> 0 AS has_nicnt,
        CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat(CAST(s_suppkey % 9 AS STRING), '.', CAST(s_suppkey % 11 AS STRING), '.', CAST(s_suppkey % 3 AS STRING)) END AS required_version,
        CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'cover.png' END AS cover_file FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "instruments": """SELECT p_partkey AS id, p_partkey % 90 AS library_id, p_name AS name, concat(p_brand, '/', p_type, '/', p_name) AS rel_path,
        CASE WHEN p_size % 5 = 0 THEN 'nkm' ELSE 'nki' END AS kind, p_size * 1024 AS size_bytes, CASE WHEN p_size % 2 = 0 THEN 'header' ELSE 'file' END AS name_source FROM part""",
    "category_rules": """SELECT DISTINCT ascii(substring(word, 1, 1)) AS rank, upper(substring(word, 1, 1)) AS class, word
        FROM (SELECT split_part(p_name, ' ', 1) AS word FROM part UNION ALL SELECT split_part(p_name, ' ', 2) AS word FROM part) WHERE substring(word, 1, 1) BETWEEN 'c' AND 'p'""",
    "clips": """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS library_id, concat('clip ', CAST(l_partkey AS STRING), CASE WHEN l_linenumber = 1 THEN ' close' WHEN l_linenumber = 2 THEN ' hall' ELSE '' END) AS name,
        concat(l_linestatus, '/', CAST(l_partkey % 40 AS STRING), '/clip.wav') AS rel_path, CASE WHEN l_linenumber = 7 THEN 'nkx' ELSE 'wav' END AS ext,
        CASE l_returnflag WHEN 'A' THEN 'demo' WHEN 'R' THEN 'ncw' ELSE 'sample' END AS kind, CAST(l_quantity AS BIGINT) * 1024 AS size_bytes FROM lineitem""",
    "manuals": """SELECT doc_id AS id, doc_id % 90 AS library_id, concat(source, CASE doc_id % 3 WHEN 0 THEN ' Manual' WHEN 1 THEN ' readme' ELSE ' notes' END, '_', lang) AS name,
        CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'rtf' ELSE 'chm' END AS ext, n_chars * 40 AS size_bytes, doc_id % 10 = 0 AS is_primary FROM documents""",
    "trace": """SELECT event_id AS id, user_id AS session_id, event_type AS tool_name, event_id % 7 <> 0 AS ok, CAST(round(value * 10) AS BIGINT) AS elapsed_ms,
        event_id % 5000 AS result_chars, event_id % 900 AS prompt_tokens, event_id % 70 AS completion_tokens, props AS args, ts AS created_at FROM events""",
    "messages": "SELECT conv_id AS session_id, turn AS id, role, text AS content, conv_id % 5 AS category_id FROM conversations",
    "tags": "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 12",
    "tag_map": "SELECT 'library' AS entity_type, s_suppkey AS entity_id, s_nationkey AS tag_id FROM supplier WHERE s_nationkey < 10",
    "favorites": "SELECT p_partkey AS instrument_id FROM part WHERE p_size = 7",
    "junk": "SELECT o_orderkey AS id, o_custkey % 90 AS library_id, CASE o_orderstatus WHEN 'F' THEN 'zip' WHEN 'O' THEN 'url' ELSE 'nfo' END AS kind, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey % 11 = 0 AS suggested_keep FROM orders",
    "points": "SELECT vec_id AS clip_id, vec_id % 7 AS library_id, CAST({e}[{0}] AS DOUBLE) AS x, CAST({e}[{1}] AS DOUBLE) AS y, label AS cluster FROM embeddings",
    "names": "SELECT c_nationkey AS library_id, concat(c_mktsegment, CAST(CAST(floor(c_acctbal / 500) AS BIGINT) AS STRING)) AS name FROM customer",
    "registered": "SELECT concat('K', CAST(s_suppkey AS STRING)) AS reg_key, concat(n_name, '/', s_name, CASE WHEN s_suppkey % 3 = 0 THEN '/content' ELSE '' END) AS content_dir, s_suppkey % 2 = 0 AS in64, s_suppkey % 3 = 0 AS in32, s_suppkey % 5 = 0 AS in_user FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 3",
    "branches": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 <> 1 THEN o_orderkey - 1 END AS parent_id, o_custkey % 200 AS session_id FROM orders",
    "memory": "SELECT l.doc_id AS id, CASE WHEN l.doc_id % 2 = 0 THEN 'library' ELSE 'user' END AS scope, l.doc_id % 5 AS library_id, concat('k', CAST(l.doc_id % 50 AS STRING)) AS key, d.text AS content, 1 + l.quality * 2 + l.toxic AS importance, l.doc_id AS updated_at FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A catalog table as a DataFrame, without registering anything in the session."""
    sql = VIEWS[name].replace("{e}", "embedding").replace("{0}", "0").replace("{1}", "1")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in sql}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    sql = sql.replace("AS labels l", "AS l").replace("AS documents d", "AS d")
    return spark.sql(sql, **frames)


def oracle(names: str, sql: str) -> str:
    """``sql`` with the named views as common tables, for DuckDB."""
    views = ", ".join(f"{n} AS ({VIEWS[n].replace('{e}', 'embedding').replace('{0}', '1').replace('{1}', '2')})" for n in names.split())
    joiner = "WITH RECURSIVE " if sql.lstrip().startswith("RECURSIVE") else "WITH "
    sql = sql.lstrip().removeprefix("RECURSIVE").lstrip()
    if sql.startswith("WITH "):
        return f"{joiner}{views}, {sql[5:]}" if views else joiner + sql[5:]
    return f"{joiner}{views} {sql}" if views else sql
