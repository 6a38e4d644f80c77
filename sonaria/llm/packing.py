"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most ``capacity`` bins, whatever the input. The
driver solves the fractional configuration program over it by multiplicative weights: each round
prices the lengths, a knapsack dynamic program finds the most valuable configuration of a
sequence, that configuration is used for an amount, and the weights of the lengths it holds fall.
Prices give a lower bound on any packing. The amounts are rounded down and the program is solved again
for what is left, until too little is left for a whole sequence; that goes by best fit. The
plan is a table of ranges (length, first rank, count, first sequence, offset); pieces get their
rank within their length from counts by (length, shard), so no length, however common, meets in
one task, and look up their range in the plan, which is bounded by the capacity and broadcast.

Rows: a null text counts as empty and packs its separator alone; repeated ids are separate
documents; an empty table gives an empty result; other columns are ignored. A text is read in one
piece by one task, so the longest one bounds a task's memory; pieces of equal length are told apart by
their number, so ties do not matter to the number of sequences.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import table, written

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR = 0
_WORKERS: dict[str, "WordIds"] = {}


#: Words of these characters alone have one reading under any Unicode version, in composed form.
_PLAIN = re.compile("[!-~\u00a1-\u012f]+")
END = b"\xff"  # no byte of UTF-8; stands for the end-of-word mark of the vocabulary


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) of words between white space, encoded when first met.

    The tokenizer drops white space and its pre-tokens never span it, so a text's ids are its
    words' ids one after the other. Words of plain Latin characters are merged by a byte-pair
    encoder over the same vocabulary, in which a byte that UTF-8 lacks ends a word; all others,
    those that may hold a special token, and all words of a vocabulary that the encoder does not
    read as the library does (checked on loading), go to the library. ``limit`` bounds the cache.
    """

    def __init__(self, model_file: str, limit: int = 600_000):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.library = Tokenizer.from_file(model_file)
        spec = json.loads(self.library.to_str())
        alphabet, suffix = byte_alphabet(), spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            stem, end = (token[: -len(suffix)], END) if token.endswith(suffix) else (token, b"")
            ranks[bytes(alphabet[c] for c in stem) + end] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.parts = regex.compile(split).findall
        # the short way holds only if it reads the vocabulary's own words, alone and joined, as the library does
        words = [t.removesuffix(suffix) for t in spec["model"]["vocab"] if t.endswith(suffix) and _PLAIN.fullmatch(t.removesuffix(suffix)) and "<|" not in t][:: max(1, len(ranks) // 400)]
        probes = words + [a.upper() + b for a, b in zip(words, words[7:])] + [f"{a}{b}.{a}" for a, b in zip(words, words[3:])]
        self.short = all(self._merged(w) == self.library.encode(w, add_special_tokens=False).ids for w in probes)

    def _merged(self, word: str) -> list[int]:
        return [i for part in self.parts(word.lower()) for i in self.merge(part.encode() + END)]

    def __missing__(self, word: str) -> bytes:
        if self.short and _PLAIN.fullmatch(word) and "<|" not in word:
            found = self._merged(word)
        else:
            found = self.library.encode(word, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, split_words(text or "")))


def split_words(text: str) -> list[str]:
    """Cut at spaces and line feeds; other white space stays inside and is the tokenizer's matter."""
    return text.replace("\n", " ").split(" ")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, each at most ``capacity`` tokens; the ids end with the separator."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _WORKERS:
            _WORKERS[model_file] = WordIds(model_file)
        words = _WORKERS[model_file]
        end = np.array([SEPARATOR], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                out = []
                for doc_id, text in zip(ids, texts):
                    data = words.ids(text) + end
                    out += [(doc_id, i // step, i // 4, len(cut := data[i : i + step]) // 4, zlib.crc32(cut)) for i in range(0, len(data), step)]
                columns = list(zip(*out))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(run, PIECE)


def best_configuration(value: np.ndarray, most: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Indices of the most valuable multiset of lengths that fits, each at most ``most`` times.

    A knapsack by dynamic programming over capacities; multiplicities enter as powers of two.
    """
    parts = []
    for k, (size, n) in enumerate(zip(lengths.tolist(), np.minimum(most, capacity // lengths).tolist())):
        power = 1
        while n > 0:
            parts.append((k, min(power, n), size * min(power, n)))
            n -= power
            power *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(parts), capacity + 1), bool)
    for i, (k, times, size) in enumerate(parts):
        new = best[:-size] + times * value[k]
        taken[i, size:] = better = new > best[size:]
        best[size:] = np.where(better, new, best[size:])
    chosen, c = [], int(best.argmax())
    for i in range(len(parts) - 1, -1, -1):
        if taken[i, c]:
            chosen += [parts[i][0]] * parts[i][1]
            c -= parts[i][2]
    return chosen


def best_fit(groups: list[list], lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[list]:
    """Best-fit decreasing of ``rest`` into ``groups`` of equal sequences [[length indices], room, count]."""
    by_room: dict[int, list[tuple[list[int], int]]] = {}
    for items, room, count in groups:
        by_room.setdefault(room, []).append((items, count))
    for k in range(len(lengths) - 1, -1, -1):
        left, size = int(rest[k]), int(lengths[k])
        while left:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                count = left // each
                by_room.setdefault(capacity - each * size, []).append(([k] * each, count))
                left -= each * count
                continue
            items, count = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = min(room // size, left)
            used = min(count, left // each)
            by_room.setdefault(room - each * size, []).append((items + [k] * each, used))
            left -= each * used
            if count > used:
                by_room.setdefault(room, []).append((items, count - used))
    return [[items, room, count] for room, found in by_room.items() for items, count in found]


def most_valuable(value: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """The greatest value of any configuration, however often a length occurs in it."""
    price = np.full(capacity + 1, -np.inf)
    price[lengths] = value
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], float((best[c - 1 :: -1] + price[1 : c + 1]).max()))
    return float(best[capacity])


def fractional_cover(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, least: float = 0.95, rounds: int = 400, eta: float = 2.0, priced: int = 12, spread: int = CAPACITY, seeded: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """A fractional solution of the covering program, [(kinds, each, amount)], and a lower bound on any.

    The program takes amounts x of configurations, multisets of lengths that fit a sequence, so that
    every length is covered to the share ``least`` of its number, no length beyond its number, and the
    sum of x is least. Weights begin high for long pieces, the hard ones. A round prices the ``priced``
    heaviest lengths that are not covered yet and ``spread`` others, all of them or new ones each time, finds the most
    valuable configuration by knapsack, uses it as often as one of its lengths still needs, and the
    weight of each length it holds falls by exp(-eta * covered share). Prices are sizes, the dual of the
    volume bound, plus a gain by weight, so weights decide among full sequences; the gain only grows
    where no full one holds a length in need. With ``seeded`` the heaviest length is priced at a sequence
    of its own instead, as pieces over half a sequence are worth, and the knapsack fills up beside it.
    What ``rounds`` leave open is left to the rounding. Any prices give a bound by duality: the value
    of all pieces over that of the most valuable configuration.
    """
    lengths, demand = np.asarray(lengths, np.int64), np.asarray(counts, float)
    free = demand.copy()
    weight = 4 * np.log(lengths / capacity)
    found: dict[tuple, float] = {}
    gain = start = 1 / (2 * capacity)
    for turn in range(rounds):
        needy = free > (1 - least) * demand + 1e-9
        if not needy.any():
            break
        left, wanted = np.flatnonzero(free > 0), np.flatnonzero(needy)
        heavy = wanted[np.argsort(-weight[wanted], kind="stable")[:priced]]
        hop = max(1, len(left) // spread)
        some = np.union1d(heavy, left[7 * turn % hop :: hop])
        first = heavy[:1] if seeded else heavy[:0]
        beside = capacity - int(lengths[first].sum())
        value = lengths[some] * (1 + gain * needy[some] * np.exp(weight[some] - weight[wanted].max()))
        most = np.ceil(free[some]).astype(np.int64) - np.isin(some, first)
        if len(some) > FEW:  # so many lengths fill a sequence without many pieces of one
            most = np.minimum(most, 3)
        fits = lengths[some] <= beside
        more = some[fits][best_configuration(value[fits], most[fits], lengths[some][fits], beside)] if fits.any() else some[:0]
        kinds, each = np.unique(np.append(more, first).astype(np.int64), return_counts=True)
        if not needy[kinds].any():
            gain *= 1.3
            continue
        gain = max(start, gain / 2)
        # as much as a length needs, or a quarter of what is left of one that only fills up; a sequence at least
        room = np.where(needy[kinds], free[kinds] - (1 - least) * demand[kinds], free[kinds] / 4) / each
        amount = float(min(max(1.0, room.min()), (free[kinds] / each).min()))
        free[kinds] = np.maximum(0.0, free[kinds] - amount * each)
        free[free < 1e-9] = 0.0
        weight[kinds] -= eta * amount * each / demand[kinds]
        key = (tuple(kinds.tolist()), tuple(each.tolist()))
        found[key] = found.get(key, 0.0) + amount
    volume = float((demand * lengths).sum()) / capacity
    if not len(lengths):
        return [], 0.0
    prices = lengths * np.exp(np.maximum(weight - weight.max(), -50))
    bound = max(volume, float((demand * prices).sum()) / most_valuable(prices, lengths, capacity))
    return [(np.array(k), np.array(e), x) for (k, e), x in found.items()], bound


#: Lengths that a round prices (2048 are all), rounds, and whether the heaviest length is worth a sequence.
TRIES = ((2048, 400, True), (200, 1000, True), (2048, 400, False))
#: Lengths up to which a configuration holds any number of pieces of one; beyond that three.
FEW = 256
#: Times that the program is solved again for what rounding left.
SOLVES = 6


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, spread: int, rounds: int, seeded: bool) -> tuple[list[list], np.ndarray, float]:
    """Whole sequences [[indices into lengths], room, count] of the program, what is left of each length, the bound.

    The amounts are rounded down, and the program is solved for what that leaves, until a solution has
    no whole sequence any more.
    """
    rest, groups, bound = counts.copy(), [], 0.0
    for turn in range(SOLVES):
        on = np.flatnonzero(rest)
        cover, below = fractional_cover(lengths[on], rest[on], capacity, spread=spread, rounds=rounds, seeded=seeded)
        bound, before = bound if turn else below, len(groups)
        for kinds, each, amount in cover:
            at = on[kinds]
            whole = min(int(amount + 1e-9), int((rest[at] // each).min()))
            if whole > 0:
                rest[at] -= whole * each
                groups.append([[int(k) for k, n in zip(at, each) for _ in range(n)], capacity - int((lengths[at] * each).sum()), whole])
        if len(groups) == before:
            break
    return groups, rest, bound


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, tries: tuple[tuple[int, int, bool], ...] = TRIES) -> list[list]:
    """[[indices into lengths], room, count] of sequences that hold every piece once.

    What no whole sequence of the program holds goes by best fit, largest
    pieces first. Where the sequences are more than 0.02 % above the bound the next way of ``tries`` is
    taken too; the fewest win, and never are they more than best fit of all pieces makes.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    number = lambda made: sum(g[2] for g in made)
    best = None
    for spread, rounds, seeded in tries:
        groups, rest, bound = rounded(lengths, counts, capacity, spread, rounds, seeded)
        made = best_fit(groups, lengths, rest, capacity)
        if best is None or number(made) < number(best):
            best = made
        if number(best) <= 1 + 1.0002 * max(bound, float((counts * lengths).sum()) / capacity):
            return best
    alone = best_fit([], lengths, counts, capacity)
    return alone if best is None or number(alone) < number(best) else best


def plan_ranges(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """length, rank (first), sequence (of the first), offset: ranks from one range to the next lie
    in successive sequences at the same offset. Ordered by length and rank."""
    lengths = np.asarray(lengths, np.int64)
    used = np.zeros(len(lengths), np.int64)
    rows, sequence = [], 0
    for items, _, count in configurations(lengths, counts, capacity):
        at = 0
        for k in sorted(items, key=lambda k: -lengths[k]):
            rows.append((int(lengths[k]), int(used[k]), sequence, at))
            used[k] += count
            at += int(lengths[k])
        sequence += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def ranked(cut: DataFrame, shards: int) -> DataFrame:
    """Adds ``rank``, a number from 0 within the length, from counts by (length, shard)."""
    rows = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "shard").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = rows.withColumn("inner", F.row_number().over(inside) - 1)
    return local.join(starts, ["length", "shard"]).withColumn("rank", F.col("first") + F.col("inner")).drop("shard", "inner", "first")


def pack(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all pieces."""
    spark = docs.sparkSession
    cut = written(pieces(docs, model_file, id_col, text_col, capacity), "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()  # at most ``capacity`` rows
    plan = plan_ranges(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity)
    span = int(histogram["n"].max()) + 1 if len(histogram) else 1
    keys = (plan["length"] * span + plan["rank"]).to_numpy(np.int64)
    ranges = spark.sparkContext.broadcast((keys, plan["rank"].to_numpy(np.int64), plan["sequence"].to_numpy(np.int64), plan["offset"].to_numpy(np.int64)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = ranges.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            found = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + found, names + ["sequence_id", "offset"])

    names = [c.split()[0] for c in PIECE.split(", ")]
    shards = max(4, int(histogram["n"].sum()) // 20_000 + 1) if len(histogram) else 1
    rows = ranked(cut, shards).select(*names, F.col("rank").cast("long").alias("rank"))
    return rows.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def op5_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
