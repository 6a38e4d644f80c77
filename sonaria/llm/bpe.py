"""Byte-level BPE encoding and decoding by a two-tier lookup.

A text is cut by the vocabulary's pattern. The first tier is a minimal perfect hash over the
vocabulary: a hash picks a bucket, the bucket's seed picks a slot, each slot belongs to one token, and
comparing its bytes tells whether a pre-token is that token. The pre-tokens of a batch are looked up
together, each distinct one once. The second tier encodes the misses: their bytes are a doubly linked
list, and a heap of (rank, place) gives the pair of lowest rank, the leftmost of equal ones, to be
merged next, so a pre-token of n bytes takes n log n steps. Misses are kept in a cache of bounded
size in each worker. Decoding takes ids back to the bytes of their tokens. Texts stay in their
partitions: only the hash's tables, a few hundred kilobytes and the tokens, go to the tasks.

Rows: a null text counts as empty and has no ids; every row, repeated or with a null id, gives one
row, and equal texts equal ids, so no ties arise between rows; equal ranks of one text's pairs merge
from the left; very long texts, and very long pre-tokens, take memory in proportion; an empty table
gives an empty result; other columns are ignored; special strings in texts are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from sonaria.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct pre-tokens of a batch are looked up in parts of this size.
PART = 100_000
_WORD = (1 << 64) - 1


def read_ranks(file: str) -> dict[bytes, int]:
    """Token and rank of each line of a rank file."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Another hash for each seed."""
    h = (h ^ (seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash: n keys, n slots. Buckets are placed from the largest; each takes the first
    seed that sends its keys to free slots, and a bucket of one key is given a free slot outright."""

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        h = self.hashes(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("two keys are equal or have one hash of 64 bits")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        free = np.ones(self.n, bool)
        self.seeds = np.zeros(self.buckets, np.int64)
        tries = np.arange(1, 257, dtype=np.int64)
        self.slot_of_key = np.zeros(self.n, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            held = order[starts[b] : starts[b] + sizes[b]]
            if len(held) <= 1:
                break
            first = 0
            while True:
                slots = (_mixed(h[held][None, :], (tries + first)[:, None]) % np.uint64(self.n)).astype(np.int64)
                fit = free[slots].all(axis=1)
                for row in np.flatnonzero(fit):
                    if len(set(slots[row].tolist())) == len(held):
                        self.seeds[b] = tries[row] + first
                        free[slots[row]] = False
                        self.slot_of_key[held] = slots[row]
                        break
                else:
                    first += len(tries)
                    continue
                break
        single = [b for b in np.flatnonzero(sizes == 1)]
        for b, slot in zip(single, np.flatnonzero(free)):
            self.seeds[b] = -slot - 1
            self.slot_of_key[order[starts[b]]] = slot
        self.few_seeds = self.seeds.tolist()

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; that of a key which is not among the n may be any."""
        h = self.hashes(keys)
        seeds = self.seeds[self._bucket(h)]
        moved = (_mixed(h, np.maximum(seeds, 0)) % np.uint64(max(1, self.n))).astype(np.int64)
        return np.where(seeds < 0, -seeds - 1, moved)

    def slot(self, key: bytes) -> int:
        """The same of one key."""
        h = xxh3_64_intdigest(key)
        seed = self.few_seeds[(h >> 32) % self.buckets]
        if seed < 0:
            return -seed - 1
        h = (h ^ (seed * 0x9E3779B97F4A7C15 & _WORD)) * 0xBF58476D1CE4E5B9 & _WORD
        h = (h ^ h >> 29) * 0x94D049BB133111EB & _WORD
        return (h ^ h >> 32) % self.n


class _Met(dict):
    """Ranks of byte strings met in merging, -1 for those that are no tokens; others are looked up."""

    def __init__(self, rank: Callable[[bytes], int], limit: int):
        super().__init__()
        self.rank, self.limit = rank, limit

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[key] = rank = self.rank(key)
        return rank


class BytePairs:
    """The vocabulary of a rank file: ``encode`` and ``decode``, as ids of four bytes, lowest first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 600_000):
        self.pattern, self.limit = pattern, limit
        self.hash = PerfectHash(ranks)
        self.tokens: list[bytes] = [b""] * len(ranks)
        self.ids: list[int] = [0] * len(ranks)
        for slot, (token, rank) in zip(self.hash.slot_of_key.tolist(), ranks.items()):
            self.tokens[slot], self.ids[slot] = token, rank
        self._prepare()

    def _prepare(self) -> None:
        import regex

        self.find = regex.compile(self.pattern).findall
        self.bytes_of = dict(zip(self.ids, self.tokens))
        self.known: dict[str, bytes] = {}
        self.met = _Met(self.rank, self.limit)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pattern", "limit", "hash", "tokens", "ids")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def ranks(self, keys: list[bytes]) -> list[int]:
        """The rank of each byte string, -1 where it is no token."""
        tokens, ids = self.tokens, self.ids
        return [ids[s] if tokens[s] == key else -1 for s, key in zip(self.hash.slots(keys).tolist(), keys)] if tokens else [-1] * len(keys)

    def rank(self, key: bytes) -> int:
        slot = self.hash.slot(key) if self.tokens else 0
        return self.ids[slot] if self.tokens and self.tokens[slot] == key else -1

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no token itself: merges by a heap over its linked bytes."""
        n, met = len(piece), self.met
        wide = n.bit_length() + 1
        low = (1 << wide) - 1
        # an entry is (rank, start of the left part, end of the right part) in one number
        heap = [(rank << wide | i) << wide | i + 2 for i in range(n - 1) if (rank := met[piece[i : i + 2]]) >= 0]
        heapify(heap)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a byte; the end is where the next starts
        while heap:
            entry = heappop(heap)
            end, i = entry & low, entry >> wide & low
            j = ends[i]
            if not j or j >= n or ends[j] != end:
                continue  # one of the two has been merged since
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
                if (rank := met[piece[i : ends[end]]]) >= 0:
                    heappush(heap, (rank << wide | i) << wide | ends[end])
            left = before[i]
            if left >= 0 and (rank := met[piece[left:end]]) >= 0:
                heappush(heap, (rank << wide | left) << wide | end)
        out, i = [], 0
        while i < n:
            if (rank := met[piece[i : ends[i]]]) < 0:
                raise KeyError(piece[i : ends[i]])
            out.append(rank)
            i = ends[i]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each. What is met for the first time is looked up, all at
        once; misses are merged. Both are kept up to ``limit`` pre-tokens."""
        found = [self.find(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = list(set().union(*found).difference(known))
        for at in range(0, len(new), PART):
            part = new[at : at + PART]
            keys = [p.encode("utf-8") for p in part]
            ids = self.ranks(keys)
            known.update((piece, rank.to_bytes(4, "little") if rank >= 0 else np.array(self.merged(key), "<u4").tobytes()) for piece, key, rank in zip(part, keys, ids))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in found]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text or ""])[0], "<u4").tolist()

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        """The bytes of the tokens of ``ids``; an id that is none is an error."""
        ids = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        return b"".join(map(self.bytes_of.__getitem__, ids))


def shared(spark, ranks_file: str, pattern: str):
    """The vocabulary for the tasks, read once by the driver."""
    return spark.sparkContext.broadcast(BytePairs(read_ranks(ranks_file), pattern))


def parts_of(values: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about ``most`` characters, with the place of the first."""
    held, chars, start = [], 0, 0
    for i, value in enumerate(values):
        held.append(value.as_py() or "")
        chars += len(held[-1])
        if chars >= most:
            yield start, held
            held, chars, start = [], 0, i + 1
    if held:
        yield start, held


def encode(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (four bytes each, lowest first), and with ``decoded`` the bytes that they
    decode to; ``vocabulary`` is what ``shared`` gives."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_tokens", "ids"] + (["decoded"] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary.value
        for batch in batches:
            for start, texts in parts_of(batch.column(1)):
                ids = pairs.encode_all(texts)
                columns = [batch.column(0).slice(start, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([pairs.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(rows: DataFrame, vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the bytes of each row's ids; null ids decode to nothing."""
    held = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pairs.decode(x.as_py()) for x in batch.column(1)], pa.binary())], ["doc_id", "decoded"])

    return held.mapInArrow(run, "doc_id long, decoded binary")


def op13_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = shared(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    made = encode(table(spark, sf_dir, "documents"), vocabulary, decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
