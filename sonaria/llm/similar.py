"""Near copies by the likeness of their word shingles, one document kept of each group.

Two documents are near copies when the sets of their five-word shingles have a Jaccard similarity
of ``similarity`` or more. Candidates come from the sets' fingerprints by multi-index hashing
(``simhash.links``): sets of one fingerprint meet its first, and firsts meet at two or fewer differing
bits. Pairs at 0.8 differ in about ten bits, which no index of 64 finds, so an exact check of what
fingerprints leave apart follows: candidates that share one of ``BANDS`` hashes of ``WIDTH`` minima each; a pair
at 0.8 shares none with a probability of 0.0002, one at 0.9 with less than 1e-7. Each set
also has an odd sketch, the parity of its shingles in each of ``PARITIES`` cells: the cells in which
two sketches differ are never more than the shingles that only one of the sets has, so a pair whose
sketches differ in more cells than the threshold allows is no near copy, without any error. Every
other candidate is verified on the whole sets.

In each bucket all members are first compared with one leader, which differs from bucket to bucket;
what that leaves apart is then compared with all that is not in its group yet. So no candidate pair
goes unseen, a group of thousands of near copies costs a comparison for each member and bucket, and
members that stay alone emit only what their sketches leave within reach of the threshold.

Rows: each row is decided on its own, by a key written before the stage, whatever its id. The first
of a group is that with the smallest (id, hash of the text), null ids last. Texts with equal sets
are one class; texts without words are one class too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.llm import simhash
from sonaria.llm.common import Written, spread_join, unfolded, written
from sonaria.llm.simhash import ROW, connected_components, first_rows, keyed_rows, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, WIDTH = 16, 4
PARITIES = 1024
#: Segments of the fingerprints' index: with two bits at most, one of three is equal, so a look-up is three rows.
SEGMENTS = 3
#: Members of a bucket for which one more part of it is compared by another task.
PART = 2000
_CHUNK = 4096
_FACTORS = np.random.default_rng(29).integers(0, 1 << 63, BANDS * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + _CHUNK]).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, WIDTH))]


def odd_sketch(hashes: np.ndarray) -> list[int]:
    """Parities of the numbers of hashes in each cell, as signed longs."""
    cells = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=PARITIES)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _marked(keyed: DataFrame, shingle: int) -> DataFrame:
    """row, digest of the set, fp (its fingerprint), n (its size), bands, odd (its sketch)."""
    schema = "row long, digest binary, fp long, n long, bands array<long>, odd array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array(np.array(list(map(simhash.majority, sets)), np.uint64).view(np.int64))
            longs = [pa.array(list(map(f, sets)), pa.list_(pa.int64())) for f in (band_keys, odd_sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, fps, pa.array(list(map(len, sets)), pa.int64()), *longs], ["row", "digest", "fp", "n", "bands", "odd"])

    return keyed.select(F.col(ROW).alias("row"), F.col("text")).mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes array<long>")


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of classes (node, fp) that connect all at two or fewer differing bits: the smallest node
    of a fingerprint with its others, and with those of the fingerprints that the index links."""
    firsts = classes.groupBy("fp").agg(F.min("node").alias("first"))
    same = spread_join(classes.select("node", "fp"), firsts, ["fp"], F.xxhash64("node")).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    met = written(simhash.links(firsts.select("fp"), SEGMENTS), "fingerprint-links")
    near = _with_both(met, firsts.select(F.col("fp").alias("node"), "first"))
    return same.union(near.select(F.greatest("u_first", "v_first"), F.least("u_first", "v_first")))


def _apart(similarity: float) -> Column:
    """The most shingles that only one of two sets has, for sets u and v that are alike."""
    return F.floor((F.col("u_n") + F.col("v_n")) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def _within(similarity: float) -> Column:
    """Whether sizes and sketches of u and v leave them within reach of the threshold."""
    sizes = F.least("u_n", "v_n") >= similarity * F.greatest("u_n", "v_n") - 1e-9
    cells = [F.bit_count(F.get("u_odd", F.lit(i)).bitwiseXOR(F.get("v_odd", F.lit(i)))) for i in range(PARITIES // 64)]
    return sizes & (reduce(add, cells) <= _apart(similarity))


def _with_both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) with the columns of ``nodes`` of both, named u_... and v_..."""
    made, n = pairs, pairs.count()
    for x, other in (("u", "v"), ("v", "u")):
        own = nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in nodes.columns if c != "node"])
        made = spread_join(made, own, [x], F.xxhash64(other), pairs, n)
    return made


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike, by the whole sets."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = written(_sets(texts.join(nodes, "node", "left_semi").select("node", "text"), shingle), "sets")
    both = F.size(F.array_intersect("u_hashes", "v_hashes"))
    alike = both >= similarity * (F.size("u_hashes") + F.size("v_hashes") - both) - 1e-9
    return written(_with_both(pairs, sets).where(alike).select("u", "v"), "links")


def near_copies(keyed: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """row, root: the rows of ``keyed`` (row key, text) that have a near copy, and their group, in a
    written table; those that led to it are deleted."""
    held: list[Written] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        held.append(Written(df, label))
        return held[-1].df

    marked = written(_marked(keyed, shingle), "marked")
    named = marked.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("fp", "n", "bands", "odd")])
    classes = written(named, "classes")
    texts = keyed.select(F.col(ROW).alias("node"), "text")
    pair = lambda u, v: [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]
    buckets = unfolded(classes.select("node", F.explode("bands").alias("key")))
    order = F.struct(F.xxhash64("node", "key").alias("at"), "node")
    leaders = buckets.groupBy("key").agg(F.min(order)["node"].alias("leader"), F.count("*").alias("members")).where("members > 1")
    met = written(buckets.join(leaders, "key"), "buckets")
    stars = met.where("node <> leader").select(*pair("node", "leader"))
    stars = written(fingerprint_pairs(classes.select("node", "fp")).union(stars).distinct(), "stars")
    near = written(_with_both(stars, classes.select("node", "n", "odd")).where(_within(similarity)).select("u", "v"), "pairs")
    links = _verified(near, texts, shingle, similarity)
    roots = written(connected_components(links), "roots")
    # what the leaders left apart: members outside the largest group of a bucket meet all others
    placed = written(met.join(roots, "node", "left").select("key", "node", "leader", "members", F.coalesce("root", "node").alias("root")), "placed")
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("rows"))
    largest = groups.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("top"), F.count("*").alias("groups")).where("groups > 1").select("key", F.col("top.root").alias("top"))
    open_ = placed.join(largest, "key").where("members > 2")  # two have met already
    apart = written(open_.join(classes.select("node", "n", "odd"), "node"), "apart")
    side = lambda x: ["key", "part", "leader", *[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in ("node", "n", "odd", "root")]]
    parts = F.ceil(F.col("members") / PART).cast("int")
    left = apart.where("root <> top").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).select(*side("u"))
    right = apart.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("top").select(*side("v")).drop("leader")
    new = left.join(unfolded(right), ["key", "part"]).where("u_root <> v_root and u <> leader and v <> leader").where(_within(similarity))
    more = _verified(written(new.select(*pair("u", "v")).distinct(), "pairs"), texts, shingle, similarity)
    roots = written(connected_components(links.union(more)), "roots")
    grouped = classes.join(roots, "node", "left").where("copies > 1 or root is not null").select("digest", F.coalesce("root", "node").alias("root"))
    made = Written(spread_join(marked.select("row", "digest"), grouped, ["digest"], F.xxhash64("row")).select("row", "root"), "groups").df
    for table in held:
        table.drop()
    return made


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (doc_id, text, ...) without all but the first row of each group of near copies."""
    keyed = keyed_rows(docs)
    return first_rows(keyed, near_copies(keyed, shingle, similarity))
