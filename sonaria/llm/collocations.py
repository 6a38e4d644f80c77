"""Phrases whose words stand together more often than alone, from vertical positional lists.

Texts are cut into blocks of bounded size. In a block every word has the ascending list of its
positions (words are numbered through the block, with a gap after each piece), so a list's length
is the word's exact frequency there and the sum over blocks its frequency. A level extends the
lists of a block's phrases: their positions, moved by one, are merge-joined with those of the
phrases that start next, and two phrases of k words that overlap in k - 1 make one of k + 1. All
lists of a block are joined at once, over its positions in order.

Only phrases of frequent parts can be frequent, so the lists of longer phrases come from those of
frequent ones. Before the lists of a new level are spelled out, blocks exchange hashes of their
phrases with counts, five bytes each, dealt out by hash; the sums tell each block which of its
phrases may be frequent. Hashes that collide only let a rare phrase through, and exact counts follow.
No word, phrase or language gathers in one task: blocks hold whole documents or cuts of very long
ones, and counts are summed before they are shuffled.

A table of lists has a few thousand lists in a row: phrases joined by line feeds, which no phrase
has, list lengths, and the positions' steps, byte by byte and compressed.

Rows: a null text counts as empty and gives nothing; a null language is ``und``; every row counts,
repeated or with a null id; very long texts are cut between pieces into several blocks; ties of
score go by frequency, then by the phrase in UTF-8 byte order, and ties of cuts to the fewest first
words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import Written, small, spread_join, table

#: Characters of a block: about a million words.
BLOCK_CHARS = 6_000_000
#: Lists of a row.
PACK = 5_000
#: Hashes that one group of the exchange sums, about.
GROUP_HASHES = 1_000_000
MARKS = ".,;:!?\n\x0b\x0c\r"
_MARK = re.compile(f"[{re.escape(MARKS)}]")
#: Bytes: A-Z in lower case, tabulators as spaces, marks as line feeds; other bytes, UTF-8's above all, stay.
_BYTES = bytes.maketrans(bytes(range(65, 91)) + b"\t" + MARKS.encode(), bytes(range(97, 123)) + b" " + b"\n" * len(MARKS))
LISTS = "block long, lang string, phrases string, n array<int>, at binary"
_NAMES = ["block", "lang", "phrases", "n", "at"]


def cuts(text: str, most: int) -> Iterator[str]:
    """``text`` in parts that end at a piece's end, of ``most`` characters or as few more as possible."""
    at = 0
    while len(text) - at > most:
        mark = _MARK.search(text, at + most)
        if mark is None:
            break
        yield text[at : mark.end()]
        at = mark.end()
    yield text[at:]


def _steps(positions: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending lists of ``n`` positions each as steps from one to the next, low bytes first, compressed."""
    steps = np.diff(positions, prepend=0)
    starts = np.cumsum(n) - n
    steps[starts] = positions[starts]
    return pa.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _positions(steps: bytes, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    planes = np.frombuffer(pa.decompress(steps, 4 * total, "zstd", asbytes=True), np.uint8).reshape(4, total)
    sums = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)
    ends = np.cumsum(n)
    return sums - np.repeat(np.concatenate([[0], sums[ends[:-1] - 1]]), n)


def _packed(block: int, lang: np.ndarray, names: list[str], phrases: pa.Array, n: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """Rows of up to ``PACK`` lists of one language; ``lang`` numbers the ``names``, ascending."""
    turns = np.flatnonzero(np.diff(lang)) + 1
    bounds = [0, *turns.tolist(), len(n)]
    spans = [(at, min(at + PACK, b)) for a, b in zip(bounds, bounds[1:]) for at in range(a, b, PACK)]
    ends = np.concatenate([[0], np.cumsum(n)])
    columns = [
        pa.array([block] * len(spans), pa.int64()), pa.array([names[lang[a]] for a, _ in spans], pa.string()),
        pa.array(["\n".join(phrases.slice(a, b - a).to_pylist()) for a, b in spans], pa.string()), pa.array([n[a:b] for a, b in spans], pa.list_(pa.int32())),
        pa.array([_steps(positions[ends[a] : ends[b]], n[a:b]) for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def word_lists(block: int, texts: dict[str, list[str]]) -> pa.RecordBatch:
    """The lists of a block's words; positions run on through its languages."""
    start, langs, phrases, counts, places = 0, [], [], [], []
    for number, parts in enumerate(texts.values()):
        data = ("\n".join(parts) + "\n").encode("utf-8").translate(_BYTES).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([data], pa.large_binary()).cast(pa.large_string()), " ").flatten()
        coded = words.dictionary_encode()
        words, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        blank, gap = (pc.index(words, w).as_py() for w in ("", "\n"))  # -1 is no word's code
        codes = codes[codes != blank]
        n = np.bincount(codes, minlength=len(words))
        n[gap] = 0
        order = np.argsort(codes, kind="stable")
        places.append(order[codes[order] != gap] + start)
        start += len(codes)
        held = np.flatnonzero(n)
        langs.append(np.full(len(held), number))
        phrases.append(words.take(pa.array(held)))
        counts.append(n[held])
    lang, n, positions = (np.concatenate(x) for x in (langs, counts, places))
    return _packed(block, lang, list(texts), pa.concat_arrays(phrases), n, positions)


def blocks(docs: DataFrame, text_col: str, lang_col: str, block_chars: int) -> DataFrame:
    """block, lang, phrases, n, at: the lists of the words of each block."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        held: dict[str, list[str]] = {}
        chars = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part in cuts(text.as_py(), block_chars):
                    held.setdefault(lang.as_py(), []).append(part)
                    chars += len(part)
                    if chars >= block_chars:
                        yield word_lists(block, held)
                        block, held, chars = block + 1, {}, 0
        if held:
            yield word_lists(block, held)

    return rows.mapInArrow(run, LISTS)


def _hashes(values: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


class Joined:
    """The phrases one word longer that a block's lists make, by a merge join of their positions."""

    def __init__(self, rows: pa.Table, groups: int):
        self.block, langs = rows["block"][0].as_py(), rows["lang"].to_pylist()
        self.names = sorted(set(langs))
        lists = [x.values.to_numpy() for x in rows["n"]]
        spelled = [x.split("\n") for x in rows["phrases"].to_pylist()]
        order = sorted(range(len(langs)), key=lambda i: langs[i])
        self.lang = np.repeat([self.names.index(langs[i]) for i in order], [len(lists[i]) for i in order])
        phrases = [p for i in order for p in spelled[i]]
        last = [p.rsplit(" ", 1)[-1] for p in phrases]
        positions = np.concatenate([_positions(rows["at"][i].as_py(), lists[i]) for i in order])
        n = np.concatenate([lists[i] for i in order])
        # the phrase that starts at each place; no two phrases of a level do
        owner = np.full(int(positions.max()) + 2, -1, np.int64)
        owner[positions] = np.repeat(np.arange(len(n)), n)
        starts = np.flatnonzero((owner[:-1] >= 0) & (owner[1:] >= 0))
        pair = owner[starts] * len(n) + owner[starts + 1]
        order = np.argsort(pair, kind="stable")
        pair, self.starts = pair[order], starts[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        self.n = np.diff(first, append=len(pair))
        self.left, self.right = pair[first] // len(n), pair[first] % len(n)
        self.phrases, self.last = pa.array(phrases, pa.string()), pa.array(last, pa.string())
        seeds = _hashes(self.names)[self.lang] * np.uint64(0x9E3779B97F4A7C15)
        hashes = (_hashes(phrases) + seeds)[self.left] * np.uint64(0xBF58476D1CE4E5B9) + _hashes(last)[self.right]
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.group = ((hashes >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
        self.key = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def spelled(self, kept: np.ndarray) -> pa.RecordBatch:
        """The lists of the phrases marked in ``kept``."""
        left, right = self.left[kept], self.right[kept]
        phrase = pc.binary_join_element_wise(self.phrases.take(pa.array(left)), self.last.take(pa.array(right)), " ")
        return _packed(self.block, self.lang[left], self.names, phrase, self.n[kept], self.starts[np.repeat(kept, self.n)])


def longer(lists: DataFrame, groups: int, least: int) -> DataFrame:
    """The lists of phrases one word longer, without those that cannot reach ``least`` in all blocks."""

    def told(rows: pa.Table) -> pa.Table:
        """block, grp, keys, counts: the hashes of a block's phrases, by group; counts stop at ``least``."""
        made = Joined(rows, groups)
        order = np.argsort(made.group, kind="stable")
        group, key, n = made.group[order], made.key[order], np.minimum(made.n[order], min(least, 255)).astype(np.uint8)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        spans = list(zip(starts, [*starts[1:], len(group)]))
        return pa.table({
            "block": pa.array([made.block] * len(spans), pa.int64()), "grp": pa.array(group[starts]),
            "keys": pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
        })

    def summed(rows: pa.Table) -> pa.Table:
        """block, grp, keys: of each row, the hashes that reach the least in all rows of the group."""
        keys = [np.frombuffer(k.as_py(), np.uint32) for k in rows["keys"]]
        counts = np.concatenate([np.frombuffer(n.as_py(), np.uint8) for n in rows["counts"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        enough = (np.bincount(place, counts) >= min(least, 255))[place]
        ends = np.cumsum([len(k) for k in keys])
        kept = [k[enough[e - len(k) : e]].tobytes() for k, e in zip(keys, ends)]
        made = pa.table({"block": rows["block"], "grp": rows["grp"], "keys": pa.array(kept, pa.binary())})
        return made.filter(pc.greater(pc.binary_length(made["keys"]), 0))

    def spelled(rows: pa.Table, kept: pa.Table) -> pa.Table:
        if not len(rows) or not len(kept):
            return pa.table({c: pa.array([], t) for c, t in zip(_NAMES, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()))})
        made = Joined(rows, groups)
        wanted = np.concatenate([np.frombuffer(k.as_py(), np.uint32).astype(np.uint64) | np.uint64(g.as_py() << 32) for g, k in zip(kept["grp"], kept["keys"])])
        return pa.Table.from_batches([made.spelled(np.isin(made.key.astype(np.uint64) | made.group.astype(np.uint64) << np.uint64(32), wanted))])

    hashes = lists.groupBy("block").applyInArrow(told, "block long, grp long, keys binary, counts binary")
    kept = hashes.groupBy("grp").applyInArrow(summed, "block long, grp long, keys binary")
    return lists.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(spelled, LISTS)


def _frequent(lists: DataFrame, least: int) -> DataFrame:
    each = F.explode(F.arrays_zip(F.split("phrases", "\n", -1).alias("phrase"), F.col("n").alias("n"))).alias("x")
    return lists.select("lang", each).groupBy("lang", F.col("x.phrase").alias("phrase")).agg(F.sum("x.n").cast("long").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, f of all phrases of 1 to ``longest`` words and ``least`` places or more;
    and lang, n, the number of words of each language."""
    lists = Written(blocks(docs, text_col, lang_col, block_chars), "word-lists")
    total = F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")
    sizes = Written(lists.df.groupBy("lang").agg(total), "languages").df
    groups = max(64, (sizes.agg(F.sum("n")).first()[0] or 0) // GROUP_HASHES)
    found = []
    for words in range(1, longest + 1):
        frequent = Written(_frequent(lists.df, least), "phrases").df
        found.append(frequent.select("lang", "phrase", F.lit(words).alias("words"), "f"))
        if words < longest:
            made = Written(longer(lists.df, groups, least), "phrase-lists")
            lists.drop()
            lists = made
    lists.drop()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every, sizes


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` phrases of each language by score.

    A phrase of 2 to ``longest`` words that stands at ``a`` places, ``least`` or more, is cut after
    each word; the lowest of floor(1000000 a a / (l r)) counts. One that lies in a longer phrase with
    ``inside`` percent of its places or more is left out.
    """
    every, sizes = frequent_phrases(docs, longest, least, text_col, lang_col, block_chars)
    parts = F.split("phrase", " ")
    phrases = every.where("words > 1")
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), parts.alias("parts"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), " ").alias("right"))
    salt = F.xxhash64("phrase", "k")
    cut = spread_join(cut, every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"], salt)
    cut = Written(cut, "cuts").df
    cut = spread_join(cut, every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"], salt)
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    held = phrases.where("words > 2").select("lang", "f", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    held = held.select("lang", "f", "parts", "size", F.explode(F.sequence(F.lit(1), F.size("parts") - F.col("size") + 1)).alias("at"))
    held = held.groupBy("lang", F.array_join(F.slice("parts", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("f").alias("longer"))
    alone = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    return _first(alone.select("lang", "phrase", "a", "best.l", "best.r", "best.score"), most).join(small(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, most: int, shards: int = 16) -> DataFrame:
    """The first ``most`` rows of each language with their rank: of each shard first, so that no task holds a language."""
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    few = rows.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards))).withColumn("rank", place("lang", "shard")).where(F.col("rank") <= most)
    return few.withColumn("rank", place("lang")).where(F.col("rank") <= most).drop("shard")


def op11_query(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^ \t]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)
), words AS (
  SELECT piece, lang, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM pieces
), near AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)
), totals AS (
  SELECT lang, count(*) AS n FROM near GROUP BY lang
), f AS (
  SELECT lang, w1 AS phrase, count(*) AS f FROM near GROUP BY 1, 2
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM near WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM near WHERE w3 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE contains(phrase, ' ') AND f >= 10
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c)
), scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE len(ws) = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE len(ws) = 3) GROUP BY 1, 2
), alone AS (
  SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone) JOIN totals USING (lang) WHERE rank <= 2000
"""
