"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are put in a seeded random order and laid end to end on a line of words,
which goes round: after its last word comes its first. A source takes its target, to the word, in
blocks of ``block`` words, the last one shorter. The slots of all blocks come from the van der
Corput sequence: each point falls in the interval of one source under the cumulative numbers of
blocks, so that every source, however small, has exactly its own number of slots and these lie
evenly over the whole mix. Slots are ranked within their source, and the slot of rank k takes block
k of the source's line: what a document gives is the sum over the slots that its words meet.

Places on a line, ranks of slots and cumulative numbers come from sums by (source, bucket), so a
source that holds a third of all rows is spread over all tasks, and sources may be many.

Rows: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order; each row has a key of its own, so repeated rows and null ids are separate documents; rows
of equal id and text are in any order among themselves, and give the same rows whatever it is; an
empty table gives an empty result; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import table, written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1024
SEED = 17
#: Numbers of one source that a row of the schedule is made of before it is exploded.
_CHUNK = 1 << 16
_ROW = "__mix_row"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def van_der_corput(k: Column, bits: int) -> Column:
    """The base-2 radical inverse of k < 2**bits as an integer numerator over 2**bits."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("long")


def sums_before(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over the rows of the group that come before in the order of
    ``bucket`` and then ``order``: within a bucket by a window, and before it from one sum a bucket."""
    rows_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
    start = F.coalesce(F.sum("__sum").over(rows_before(Window.partitionBy(*group).orderBy(bucket))), F.lit(0))
    starts = sums.select(*[F.col(c).alias(f"__b_{c}") for c in [*group, bucket]], start.alias("__start"))
    inner = F.coalesce(F.sum(value).over(rows_before(Window.partitionBy(*group, bucket).orderBy(*order))), F.lit(0))
    same = F.lit(True)
    for c in [*group, bucket]:
        same = same & (F.col(c) == F.col(f"__b_{c}"))
    return rows.withColumn("__inner", inner).join(starts, same).withColumn(name, F.col("__start") + F.col("__inner")).select(*rows.columns, name)


def in_order(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` written in a sorted table, with ``part`` (the sort's own partitions, in order) and ``at``."""
    placed = written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), label)
    return placed.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("all", F.lit(0))


def capped_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """number, source, source_size, target. Targets share ``share`` of all sizes by weight and stop at
    ``cap`` times the source's size; what lies above is shared by weight among the others.

    The level at which the open sources stop rises from step to step: each closes the sources that
    it fills and shares what they leave, until none is filled any more.
    """
    placed = in_order(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").isNull(), F.col("source")], "sources")
    rows = sums_before(placed, ["all"], "part", ["at"], "one", "number")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = rows.select("number", "source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("top"))
    rows = written(rows, "weights")
    filled = lambda level: F.col("top") <= F.lit(level) * F.col("weight")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, closed = 0.0, -1
    while True:
        now = rows.agg(F.count_if(filled(level)), F.sum(F.when(filled(level), F.col("top"))), F.sum(F.when(~filled(level), F.col("weight")))).first()
        if now[0] == closed or now[2] is None:
            break
        closed, level = now[0], max(level, (total - float(now[1] or 0)) / now[2])
    return rows.select("number", "source", "source_size", F.round(F.least(F.col("top"), F.lit(level) * F.col("weight")), 6).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """number (of the source), rank, slot, first, last: the slots of the mix, in the order of ``slot``,
    and the words ``first`` up to ``last`` of its source's round line that each takes."""
    goal = F.round("target").cast("long")
    rows = targets.select("number", goal.alias("goal"), F.ceil(goal / F.lit(block)).cast("long").alias("slots")).where("slots > 0")
    placed = in_order(rows, [F.col("number")], "blocks")
    rows = written(sums_before(placed, ["all"], "part", ["at"], "slots", "low").select("number", "goal", "low", "slots"), "intervals")
    total = int(rows.agg(F.sum("slots")).first()[0] or 0)
    bits = max(1, (total - 1).bit_length())
    # the points of a source's interval are numbers in a row; the slot of each is its bits reversed
    begins = F.explode(F.sequence(F.col("low"), F.col("low") + F.col("slots") - 1, F.lit(_CHUNK).cast("long"))).alias("begin")
    chunks = rows.select("number", "goal", (F.col("low") + F.col("slots") - 1).alias("end"), begins)
    points = chunks.select("number", "goal", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + (_CHUNK - 1), F.col("end")))).alias("x"))
    shift = max(0, bits - max(3, (total // 2000).bit_length()))
    slots = points.select("number", "goal", van_der_corput(F.col("x"), bits).alias("slot"), F.lit(1).cast("long").alias("one"))
    slots = slots.withColumn("bucket", F.shiftrightunsigned("slot", shift))
    ranked = sums_before(slots, ["number"], "bucket", ["slot"], "one", "rank")
    first = F.col("rank") * F.lit(block)
    return ranked.select("number", "rank", "slot", first.alias("first"), F.least(first + block, F.col("goal")).alias("last"))


def mixed_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken, first_slot from (row, doc_id, source, size, key)."""
    targets = written(capped_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    named = targets.select("number", F.col("source").alias("t_source"), "source_size", "target")
    few = targets.limit(10_001).count() <= 10_000
    met = rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    buckets = max(8, min(1 << 30, rows.count() // 2000))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("decimal(20,0)")
    bucket = F.floor(lead * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    line = sums_before(met.withColumn("bucket", bucket), ["number"], "bucket", ["key", "row"], "size", "at")
    # where a document stands on the round line up to its target, and the blocks that it meets there
    goal = F.round("target").cast("long")
    times = F.when((F.col("size") > 0) & (F.col("at") < goal), F.sequence(F.lit(0).cast("long"), F.floor((goal - F.col("at") - 1) / F.col("source_size"))))
    stands = line.select("*", F.explode_outer(times).alias("round")).withColumn("a", F.col("at") + F.col("round") * F.col("source_size"))
    blocks = F.when(F.col("round").isNotNull(), F.sequence(F.floor(F.col("a") / block), F.floor((F.least(F.col("a") + F.col("size"), goal) - 1) / block)))
    parts = stands.select("row", "doc_id", "source", "size", "source_size", "target", "number", "a", F.explode_outer(blocks).alias("rank"))
    taking = parts.join(schedule(targets, block), ["number", "rank"], "left")
    words = F.least(F.col("a") + F.col("size"), F.col("last")) - F.greatest("a", "first")
    kept = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return taking.groupBy("row").agg(*kept, F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken"), F.coalesce(F.min("slot"), F.lit(-1)).alias("first_slot"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """row, doc_id, source, size, key: what the mix needs of the documents, in a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{SEED}|"), text))
    return written(docs.select(row.alias("row"), doc_id.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), key.alias("key")), "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot for every row: the first of the
    slots that take it, -1 if none does."""
    return mixed_rows(measured(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), block).drop("row")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row appears as often as its words are taken, to the nearest whole.

    Rows without words carry none of the weight and stay out.
    """
    keyed = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "keyed")
    plan = mixed_rows(measured(keyed, "doc_id", "text", "source", F.col(_ROW))).where("size > 0")
    times = plan.select(F.col("row").alias(_ROW), F.round(F.col("taken") / F.col("size")).cast("int").alias("__mix_times")).where("__mix_times > 0")
    kept = keyed.join(times, _ROW)
    return kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


#: The line's whole rounds and its beginning once more give ``taken`` in closed form; slots by reversed bits.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}|' || coalesce(text, '')) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source
), w AS (
  SELECT *, 2.0::DOUBLE * source_size AS top, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(number % 3)::INT + 1] AS weight FROM s
), f AS (
  SELECT *, top / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
         coalesce(sum(top) OVER (ORDER BY top / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY top / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight FROM w
), level AS (
  SELECT min_by((total - filled) / open_weight, (ratio, number)) AS level FROM f WHERE (total - filled) / open_weight < ratio
), t AS (
  SELECT number, source, source_size, round(least(top, coalesce(level, 0) * weight), 6) AS target FROM f, level
), g AS (
  SELECT *, round(target)::BIGINT AS goal, ceil(round(target) / {BLOCK})::BIGINT AS slots FROM t
), i AS (
  SELECT *, sum(slots) OVER (ORDER BY number) - slots AS low, greatest(1, length(ltrim((sum(slots) OVER () - 1)::BIGINT::BIT::VARCHAR, '0'))) AS bits FROM g
), x AS (
  SELECT number, goal, bits, unnest(range(low::BIGINT, (low + slots)::BIGINT)) AS x FROM i WHERE slots > 0
), j AS (
  SELECT number, goal, list_sum(list_transform(range(bits), lambda b: ((x >> b) & 1) << (bits - 1 - b)))::BIGINT AS slot FROM x
), k AS (
  SELECT number, goal, slot, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM j
), p AS (
  SELECT d.row, doc_id, size, g.number, g.source_size, g.target, g.goal, sum(size) OVER (PARTITION BY g.number ORDER BY key, d.row) - size AS place
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), r AS (
  SELECT p.*, unnest(range(3)) AS round FROM p WHERE size > 0
), h AS (
  SELECT r.row, min(slot) AS first_slot FROM r JOIN k ON r.number = k.number AND r.place + r.round * r.source_size < least((k.rank + 1) * {BLOCK}, k.goal)
   AND r.place + r.round * r.source_size + r.size > k.rank * {BLOCK} GROUP BY r.row
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(place + size, goal % source_size) - place) END::BIGINT AS taken, coalesce(first_slot, -1) AS first_slot
FROM p LEFT JOIN h USING (row)
"""
