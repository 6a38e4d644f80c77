"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints are computed in the scan's own tasks, so texts are never shuffled. Each distinct
fingerprint is cut into segments, and a table of each segment holds it under that segment's value.
By the pigeonhole principle two fingerprints at two or fewer differing bits differ in at most one
bit of the first half or in none of the second: so each one enumerates the ball of radius one
within its first segment and of radius zero within its second, 34 values in all, fetches what the
tables hold there, and verifies the complete distance of each pair.

A value that more than ``crowd`` fingerprints share (near copies by the thousand have one half in
common) is not compared pair by pair. Whatever probes such a value goes another exact way: its
balls go on through the other segment too, so that the key is a whole fingerprint with one bit
flipped. Two fingerprints at two or fewer bits share such a key, a key has at most 65 members, all
within two bits of one another, and each is linked to the smallest of them.

Rows: a null text counts as empty; texts without words have fingerprint zero and link like any
other; repeated ids keep one row each; columns besides id and text are ignored; an empty table
gives an empty result. A null id gives a row whose id is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import Written, small, spread_join, unfolded, written

BITS = 64
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
SEGMENTS = 2
CROWD = 64
SEED = 42
ROW = "__row"
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    cut = size - 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:-cut or None].tolist(), ends[cut:].tolist())], np.uint64)


def fingerprint(text: str | None, size: int) -> int:
    """Unsigned 64-bit fingerprint: a bit is set where over half of the shingles have it."""
    return majority(shingle_hashes(text, size))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def segment_bits(segments: int = SEGMENTS) -> list[range]:
    """The bits of each segment of a fingerprint."""
    cuts = [BITS * s // segments for s in range(segments + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:])]


def radii(segments: int = SEGMENTS, distance: int = DISTANCE) -> list[int]:
    """Radii that sum up to distance - segments + 1: whatever lies within the distance lies within the
    radius in one segment or more, or else its distance would be above. Below zero: no look-up."""
    total = distance - segments + 1
    return [total // segments + (s < total % segments) if total >= 0 else 0 if s < distance + 1 else -1 for s in range(segments)]


def ball(bits: range, radius: int) -> list[int]:
    """The flips of the Hamming ball within a segment."""
    return [_signed(sum(1 << b for b in flips)) for r in range(radius + 1) for flips in combinations(bits, r)]


def _looked_up(fps: DataFrame, flips: list[list[int]], segments: int) -> DataFrame:
    """fp, segment, value: one row for each flip of each segment."""
    masks = [_signed(sum(1 << b for b in bits)) for bits in segment_bits(segments)]
    where = F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(masks[s]).alias("mask"), F.lit(x).alias("flip")) for s in range(segments) for x in flips[s]])
    value = F.col("fp").bitwiseXOR(F.col("at.flip")).bitwiseAND(F.col("at.mask"))
    return unfolded(fps.select("fp", F.explode(where).alias("at")).select("fp", "at.segment", value.alias("value")))


def links(fps: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v), u > v, that connect all distinct fingerprints at two or fewer differing bits."""
    reach = [r if r >= 0 else None for r in radii(segments)]
    entries = _looked_up(fps, [[0] if r is not None else [] for r in reach], segments)
    probes = _looked_up(fps, [ball(bits, r) if r is not None else [] for bits, r in zip(segment_bits(segments), reach)], segments)
    place = ["segment", "value"]
    crowded = written(entries.groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*place), "crowded")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
    if crowded.isEmpty():
        found = probes.join(entries.withColumnRenamed("fp", "v"), place)
        return found.where(F.col("fp") > F.col("v")).where(far <= DISTANCE).select(F.col("fp").alias("u"), "v").distinct()
    few = small(crowded)
    found = probes.join(entries.join(few, place, "left_anti").withColumnRenamed("fp", "v"), place).where(F.col("fp") > F.col("v")).where(far <= DISTANCE)
    # what meets a crowd: keys of whole fingerprints with a bit flipped, linked to the smallest of each key
    crowd_fps = probes.join(few, place, "left_semi").select("fp").distinct()
    keys = crowd_fps.select("fp", F.explode(F.array(*[F.lit(m) for m in ball(range(BITS), 1)])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    met = keys.select("fp", F.min("fp").over(Window.partitionBy("key")).alias("v")).where(F.col("fp") > F.col("v"))
    return found.select(F.col("fp").alias("u"), "v").union(met.select(F.col("fp").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v): root is the smallest node reachable.

    Alternates large-star and small-star steps; each round is written to the shared folder. Minima
    are merged before they are shuffled, and the links of a node of very many are dealt over tasks
    where they meet its minimum, so a star of any size is no task's own.
    """
    now = Written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    mark = _digest(now.df)
    while mark[0]:
        both = now.df.union(now.df.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = spread_join(both.where("v > u"), least, ["u"], F.xxhash64("v"), n=mark[0])
        large = Written(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label)
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        hooked = spread_join(large.df, low, ["u"], F.xxhash64("v"), n=mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = Written(hooked.union(low).distinct(), label)
        new = _digest(step.df)
        now.drop()
        large.drop()
        now = step
        if new == mark:
            break
        mark = new
    roots = now.df.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return int(row[0]), int(row[1] or 0), int(row[2] or 0)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id of the near-duplicate group)."""
    marked = written(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(links(classes.select("fp"), segments))
    rooted = written(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    leaders = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = spread_join(rooted, leaders, ["root"], F.xxhash64("fp")).select("fp", "component_id")
    return spread_join(marked, groups, ["fp"], F.xxhash64("doc_id")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` in a written table with a key for each row, whatever its id."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def first_rows(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """``keyed`` without all but the first of each group (row, root): smallest id, then hash of the text; null ids last."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"), F.col(ROW).alias("row"))
    ranked = keyed.select(F.col(ROW), order.alias("order")).join(groups.withColumnRenamed("row", ROW), ROW)
    first = ranked.groupBy("root").agg(F.min("order").alias("first")).select("root", F.col("first.row").alias("first"))
    others = spread_join(groups, written(first, "firsts"), ["root"], F.xxhash64("row")).where("row <> first")
    dropped = written(others.select(F.col("row").alias(ROW)), "dropped")
    return keyed.join(small(dropped), ROW, "left_anti").drop(ROW)  # where few rows go, no text is shuffled


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents without all but the first of each near-duplicate group, each row on its own,
    also where ids are null or repeat."""
    keyed = keyed_rows(docs)
    groups = near_duplicates(keyed, id_col=ROW, shingle=shingle)
    return first_rows(keyed, written(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root")), "groups"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    from sonaria.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))
