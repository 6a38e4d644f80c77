"""Document fingerprints by a homomorphic multiset hash.

A document's fingerprint is the sum, lane by lane and modulo a power of two, of wide vectors
hashed from its paragraphs (lines that are not blank). Addition makes it independent of their
order and lets paragraphs be inserted (add) or deleted (subtract) without the rest of the text.
A paragraph's vector has eight lanes modulo 2**32, hashed from the whole paragraph, for equality;
and 190 lanes modulo 2**20 that count its sentences: all of them, and those whose hash has each of
189 bits set, three lanes to a long. Twice a bit's count less the number of sentences is a random
projection of the sentence multiset, so the cosine of two such vectors estimates how much two
documents share, with a deviation of 0.07 or less.

Everything is DataFrame expressions. The next document, for the edited text, comes from a window
over ranges of (id, hash of the text); the heads of the ranges, two longs each, come from a sorted
table of ids and hashes alone: at most ``RANGES``, and one for each partition of the sort. The first document of
a range is also handed to the range before it, so that no row has to look beyond its own range.

Rows: a null text counts as empty and has the zero fingerprint; a null id comes before all others;
rows of one id, or of none, follow one another in the order of a hash of their texts and are split
over ranges like any others; of many rows with equal id and text one goes through the window and
the others, each followed by its like, are counted and added; a table of one row has itself as
next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import small, table, written

EQUAL_LANES = 8
MASK32 = (1 << 32) - 1
#: Counts are modulo 2**20, three to a long, each with a bit to spare above it.
LANE = (1 << 20) - 1
SPACES = (0, 21, 42)
ONES3 = sum(1 << s for s in SPACES)
LANES3 = sum(LANE << s for s in SPACES)
#: Hashes of a sentence; 63 bits of each are counted.
WORDS = 3
PACKED = 21 * WORDS
FIRST = -(1 << 63)
RANGES = 200_000
#: Rows of equal id and text from which on they are counted instead of sent.
MANY = 1000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column, mask: int, lane: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: (acc + lane(x)).bitwiseAND(F.lit(mask)))


def vector(text: Column) -> Column:
    """array<bigint>: 8 equality lanes, the number of sentences, and the packed counts."""
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: F.trim(p) != "")
    sentences = F.transform(F.filter(F.split(text, r"\n+|(?<=[.!?])\s+", -1), lambda s: F.trim(s) != ""), lambda s: F.xxhash64(s))

    def equality(hashes: Column) -> list[Column]:
        return [_sum(hashes, MASK32, lambda h, j=j: F.xxhash64(h, F.lit(j)).bitwiseAND(F.lit(MASK32))) for j in range(EQUAL_LANES)]

    def rehashed(hashes: Column, word: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(word)))

    def counts(hashes: Column) -> Column:
        return F.array(*[_sum(hashes, LANES3, lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(ONES3))) for i in range(21)])

    whole = let(F.transform(paragraphs, lambda p: F.xxhash64(p)), lambda hs: F.array(*equality(hs)))
    parts = let(sentences, lambda hs: F.concat(F.array(F.size(hs).cast("long").bitwiseAND(F.lit(LANE))), *[let(rehashed(hs, w), counts) for w in range(WORDS)]))
    return F.concat(whole, parts)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of two documents' paragraphs together; ``subtract`` undoes it."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: _lane(x["a"] + x["b"], i))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``, which it holds."""
    # packed counts never fall below those of a part, so no lane borrows from its neighbour
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: _lane(x["a"] - x["b"], i))


def _lane(x: Column, i: Column) -> Column:
    return F.when(i < EQUAL_LANES, x.bitwiseAND(F.lit(MASK32))).when(i == EQUAL_LANES, x.bitwiseAND(F.lit(LANE))).otherwise(x.bitwiseAND(F.lit(LANES3)))


def digits(v: Column) -> Column:
    """The fingerprint as a string: lanes in hexadecimal, 8 digits each for equality, 16 for counts."""
    return F.lower(F.array_join(F.transform(v, lambda x, i: F.lpad(F.hex(x), F.when(i <= EQUAL_LANES, 8).otherwise(16), F.lit("0"))), ""))


def _projections(x: Column, n: Column) -> list[Column]:
    return [(F.shiftrightunsigned(x, s).bitwiseAND(F.lit(LANE)) * 2 - n).cast("double") for s in SPACES]


def dot(a: Column, b: Column) -> Column:
    """Estimate of the number of sentence pairs that two fingerprints share, times the number of bits."""

    def all_three(x: Column, y: Column) -> Column:
        own, other = _projections(x, F.get(a, F.lit(EQUAL_LANES))), _projections(y, F.get(b, F.lit(EQUAL_LANES)))
        return own[0] * other[0] + own[1] * other[1] + own[2] * other[2]

    cut = EQUAL_LANES + 2
    return F.aggregate(F.zip_with(F.slice(a, cut, PACKED), F.slice(b, cut, PACKED), all_three), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column, aa: Column, bb: Column) -> Column:
    """1 for equal fingerprints, else the cosine of their projections, within 0 and just below 1."""
    cosine = F.when((aa > 0) & (bb > 0), dot(a, b) / F.sqrt(aa * bb)).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), cosine)))


def range_heads(keys: DataFrame, range_rows: int = 2000) -> list[tuple[int, int]]:
    """The ascending first (key, h) of each range of the rows: two longs each, about ``RANGES`` at most."""
    step = max(range_rows, keys.count() // RANGES)
    placed = written(keys.select("key", "h").orderBy("key", "h").withColumn("at", F.monotonically_increasing_id()), "order")
    # the place within a partition of the sort is in the lower bits
    heads = placed.where(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) % step == 0).select("key", "h").distinct()
    return sorted((r.key, r.h) for r in heads.toLocalIterator())


def _range_of(heads: Column, place: Column, most: int) -> Column:
    """Number of ``heads`` not above ``place``, less one, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(heads).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        open_ = acc["lo"] < acc["hi"]
        below = F.get(heads, F.least(middle, F.size(heads) - 1)) <= place
        return F.struct(F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), start, halve)["lo"] - 1


def with_next(rows: DataFrame, value: list[str], range_rows: int = 2000) -> DataFrame:
    """Adds ``next``, the struct of ``value`` of the row after in the order of ``key`` (a long) and
    ``h``; the last row is followed by the first."""
    found = range_heads(rows.select("key", "h"), range_rows)
    n = len(found)
    # one literal of all heads, once the optimizer has read it
    heads = F.from_json(F.lit(json.dumps([{"key": k, "h": h} for k, h in found])), "array<struct<key:bigint,h:bigint>>")
    place = F.struct("key", "h")
    number = _range_of(heads, place, n)
    seat = lambda part, guest: F.struct(part.alias("part"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("__range") - 1, F.lit(n or 1))
    first = F.get(heads, F.col("__range")) == place
    seats = F.when(first, F.array(seat(F.col("__range"), 0), seat(before, 1))).otherwise(F.array(seat(F.col("__range"), 0)))
    seated = rows.withColumn("__range", number).withColumn("__seat", F.explode(seats)).select("*", "__seat.part", "__seat.guest").drop("__range", "__seat")
    window = Window.partitionBy("part").orderBy("guest", "key", "h")
    return seated.withColumn("next", F.lead(F.struct(*value)).over(window)).where("guest = 0").drop("part", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_chars, v, vv: the fingerprint and its squared length for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return _measured(rows, "text", "v", "vv").withColumn("n_chars", F.char_length("text").cast("long"))


def _measured(rows: DataFrame, text: str, v: str, vv: str) -> DataFrame:
    both = let(vector(F.col(text)), lambda x: F.struct(x.alias("v"), dot(x, x).alias("vv")))
    return rows.withColumn("__m", both).select("*", F.col("__m.v").alias(v), F.col("__m.vv").alias(vv)).drop("__m")


def _compared(rows: DataFrame) -> DataFrame:
    """The query's columns, and ``times``, from rows with their ``next``."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).select("doc_id", "n_chars", "v", "vv", F.col("next.v").alias("nv"), F.col("next.vv").alias("nvv"), "edited", "times")
    rows = _measured(rows, "edited", "ev", "evv")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("v")).alias("fingerprint"),
        digits(F.col("ev")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("ev"), F.col("vv"), F.col("evv")).alias("near_edited"),
        likeness(F.col("v"), F.col("nv"), F.col("vv"), F.col("nvv")).alias("near_next"),
        "times",
    )


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """Fingerprints of the texts and of their edited texts, and how like they and the next ones are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(FIRST)).alias("key"), F.xxhash64(text).alias("h"), F.lit(1).cast("long").alias("times"))
    counts = texts.groupBy("key", "h").agg(F.count("*").alias("n"))
    repeated = written(counts.where(F.col("n") > many), "repeated")
    alike = None
    if not repeated.isEmpty():
        few = small(repeated)
        crowd = texts.join(few.select("key", "h"), ["key", "h"], "left_semi").groupBy("key", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
        alike = written(crowd.select(*texts.columns), "alike")
        texts = texts.join(few.select("key", "h"), ["key", "h"], "left_anti").unionByName(alike.withColumn("times", F.lit(1).cast("long")))
    rows = _measured(texts, "text", "v", "vv").withColumn("n_chars", F.char_length("text").cast("long"))
    made = _compared(with_next(rows, ["text", "v", "vv"])).drop("times")
    if alike is None:
        return made
    own = _measured(alike, "text", "v", "vv").withColumn("n_chars", F.char_length("text").cast("long")).withColumn("next", F.struct("text", "v", "vv")).withColumn("times", F.col("times") - 1)
    parts = _compared(own).withColumn("left", F.explode(F.sequence(F.col("times"), F.lit(1).cast("long"), F.lit(-many).cast("long")))).repartition("doc_id", "left")
    return made.union(parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("left", F.lit(many))))).drop("times", "left", "copy"))


def op4_query(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
