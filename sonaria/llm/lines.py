"""Line dedup by the spread of a line over distinct sites.

Every line's hashes, two of 64 bits, get a HyperLogLog sketch of the sites it stands on, merged by aggregation.
Lines whose estimate lies near the threshold get exact distinct counts; the others are decided
by the estimate. A line on ``min_sites`` sites or more is cross-site boilerplate: its first place
(smallest id, then smallest position) stays and all others are removed.

Rows: a null text stays null and has no lines; lines are compared by their hashes, without outer spaces and blank
lines are never removed; a null site counts for no site; each row has a key of its own, written
before the stage, so rows with null or repeated ids are decided one by one; an empty table gives an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import small, spread_join, table, written

MIN_SITES = 5
MARGIN = 0.4
_KEY, _LOST, _ROW = "__line_key", "__line_lost", "__line_row"


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """key, row, site, pos, h, h2: one row per line that is not blank, with two hashes of 64 bits."""
    row = F.col(_ROW) if _ROW in docs.columns else F.lit(0).cast("long")
    rows = docs.select(_key(id_col).alias("key"), row.alias("row"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line <> ''").select("key", "row", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _key(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))


def _met(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``lines`` with the row of ``found`` of the same hashes: few rows are broadcast, and with more of them
    a line that stands on very many places is dealt out over tasks."""
    few = small(found)
    return lines.join(few, ["h", "h2"]) if few is not found else spread_join(lines, found, ["h", "h2"], F.xxhash64("row", "pos"))


def wide_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, log_k: int = 11) -> DataFrame:
    """h, h2, first: the hashes of lines on ``min_sites`` distinct sites or more, and their first place."""
    spread = lines.groupBy("h", "h2").agg(F.hll_sketch_agg("site", log_k).alias("sketch"), F.min(F.struct("key", "row", "pos")).alias("first"))
    spread = spread.select("h", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin))
    spread = written(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("h", "h2", "first")
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("h", "h2", "first")
    pairs = _met(lines, near.select("h", "h2")).where("site is not null").groupBy("h", "h2", "site").count()
    exact = pairs.groupBy("h", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return sure.union(near.join(exact, ["h", "h2"], "left_semi"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text; with ``counts`` also n_lines, n_removed."""
    keyed = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "keyed")
    lines = written(lines_of(keyed, id_col, text_col, site_col), "lines")
    wide = written(wide_lines(lines, min_sites), "wide")
    lost = _met(lines, wide).where((F.col("first.row") != F.col("row")) | (F.col("first.pos") != F.col("pos")))
    lost = lost.groupBy(F.col("row").alias(_KEY)).agg(F.collect_set("pos").alias(_LOST))
    joined = keyed.join(lost, F.col(_ROW) == F.col(_KEY), "left")
    parts = F.split(text_col, "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(_LOST))
    kept = F.get(F.transform(F.array(parts), lambda ls: F.array_join(F.transform(places, lambda i: F.get(ls, i)), "\n")), F.lit(0))
    text = F.when(F.col(_LOST).isNull(), F.col(text_col)).otherwise(kept)
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        size = F.coalesce(F.size(parts), F.lit(0)).cast("long")
        columns += [F.when(F.col(text_col).isNull(), 0).otherwise(size).cast("long").alias("n_lines"), F.coalesce(F.size(F.col(_LOST)), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*columns)


def op7_query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True).drop("source")


ORACLE_SQL = """
WITH parts AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, source, unnest(range(len(ls))) AS pos, trim(unnest(ls)) AS line FROM parts
), wide AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= 5
), lost AS (
  SELECT l.doc_id, list(l.pos) AS gone FROM lines l JOIN wide w ON l.line = w.line
  WHERE w.first.d <> l.doc_id OR w.first.p <> l.pos GROUP BY l.doc_id
)
SELECT p.doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM parts p LEFT JOIN lost USING (doc_id)
"""
