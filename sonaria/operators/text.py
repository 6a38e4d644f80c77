"""Text retrieval: tokens, pages and chunks, an inverted index, BM25, hashed vectors, fusion, diversity."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.sources.shared import written

# Ranking and cutting depend on them.
K1, B = 1.2, 0.75
CHUNK, OVERLAP, PAGE = 900, 120, 3000
RRF_K, RECALL, MMR_LAMBDA, COSINE_FLOOR = 60, 50, 0.7, 0.05
DIM = 512
#: Candidates that meet in one task to be diversified.
MMR_MOST = 2000


LATIN = "[a-z0-9]{2,}"


def latin_tokens(text: Column) -> Column:
    """Words of two or more letters or digits in lower case (JVM-side variant)."""
    return F.regexp_extract_all(F.lower(text), F.lit(LATIN), F.lit(0))


def latin_words(text: str | None) -> list[str]:
    """The same in Python."""
    return re.findall(LATIN, (text or "").lower())


_CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"
_RUN = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+(?:[-_/.][^\W_{_CJK}]+)*")
_IDEOGRAPH, _MARK, _MARKS = re.compile(f"[{_CJK}]"), re.compile("[-_/.]"), re.compile("[-_/.]+")


def _forms(word: str) -> list[str]:
    """A word of two characters or more and what it may be a plural of; none for a shorter one."""
    out = [word] if len(word) >= 2 else []
    if not word.endswith("s"):
        return out
    if len(word) > 4 and word.endswith("es"):
        out.append(word[:-2])
    if len(word) > 3 and not word.endswith("ss"):
        out.append(word[:-1])
    return out


def _pairs(run: str) -> list[str]:
    """The pairs of neighbours in a run of CJK characters; a lone one as it is."""
    return [run[i : i + 2] for i in range(len(run) - 1)] or [run]


def tokens_of(text: str | None) -> list[str]:
    """Words, compounds whole and in parts, plural variants, and pairs of CJK characters."""
    out: list[str] = []
    for run in _RUN.findall((text or "").lower()):
        if _IDEOGRAPH.match(run):
            out += _pairs(run)
        elif run.isalnum():
            out += _forms(run)
        else:
            for word in [run, *_MARK.split(run)]:
                out += _forms(word)
    return out


_LINKED = re.compile(rf"[{_CJK}]+|[^\W_{_CJK}]+(?:[-_/.]+[^\W_{_CJK}]+)*")


def embed_runs(text: str | None) -> list[str]:
    """What a text's vector is made of: words and compounds as they stand, and pairs of CJK characters.

    Case is lowered by character, so that no letter depends on its place (Σ) or comes apart (İ).
    """
    low = "İ".join(p.replace("Σ", "σ").lower() for p in (text or "").split("İ"))
    runs = _LINKED.findall(low)
    if _IDEOGRAPH.search(low):
        runs = [x for run in runs for x in (_pairs(run) if _IDEOGRAPH.match(run) else [run])]
    return runs


def embed_tokens(run: str) -> list[str]:
    """The tokens of one of these: a compound counts in one word and in its parts, each with plural variants."""
    if _IDEOGRAPH.match(run):
        return [run]
    if run.isalnum():
        return _forms(run)
    parts = _MARKS.split(run)
    return [form for word in ["".join(parts), *parts] for form in _forms(word)]


def _mapped(function: Callable, kind: str, column: Column | str) -> Column:
    """A vectorised function of one column; made on use, for it needs a session."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(function)

    return F.pandas_udf(run, kind)(column)


def tokenize(text: Column | str) -> Column:
    return _mapped(tokens_of, "array<string>", text)


def pages_of(text: str | None, size: int = PAGE) -> list[str]:
    """Lines gathered until a page has about ``size`` characters."""
    pages, held, n = [], [], 0
    for line in (text or "").split("\n"):
        held.append(line)
        n += len(line) + 1
        if n >= size:
            pages.append("\n".join(held))
            held, n = [], 0
    return pages + (["\n".join(held)] if any(h.strip() for h in held) else [])


def chunks_of(text: str | None, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``size`` that end at a paragraph, line or sentence where one is near."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            for mark in ("\n\n", "\n", ". "):
                cut = text.rfind(mark, at, end)
                if cut > at + size // 3:
                    end = cut + len(mark)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def paginate(text: Column | str) -> Column:
    return _mapped(pages_of, "array<string>", text)


def chunk(text: Column | str) -> Column:
    return _mapped(chunks_of, "array<string>", text)


def chunk_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, part, text: one row per chunk."""
    return docs.select(key, F.posexplode(chunk(F.col(text))).alias("part", "text"))


def bm25(docs: DataFrame, key: str, tokens: str, query: list[str], k: int) -> DataFrame:
    """The ``k`` documents of highest BM25 score for the distinct query tokens, from arrays of tokens."""
    counts = {t: F.size(tokens) - F.size(F.array_remove(tokens, t)) for t in sorted(set(query))}
    return _bm25(docs.select(key, F.size(tokens).alias("__len"), *[c.alias(f"__tf{i}") for i, c in enumerate(counts.values())]), key, len(counts), k)


def bm25_text(docs: DataFrame, key: str, text: str, query: list[str], k: int) -> DataFrame:
    """The same over Latin tokens, counted in the text itself: no array of tokens is made."""
    low = F.lower(text)
    counts = [F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])")) for t in sorted(set(query))]
    return _bm25(docs.select(key, F.regexp_count(low, F.lit(LATIN)).alias("__len"), *[c.alias(f"__tf{i}") for i, c in enumerate(counts)]), key, len(counts), k)


def _bm25(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """Texts are read once: lengths and term frequencies are written, a few numbers a row, and both the
    statistics and the scores come from these."""
    if not n:
        return rows.select(key, F.lit(0.0).alias("score")).orderBy(key).limit(k)
    return _scored(written(rows, "term-counts"), key, n, k)


def _scored(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """The best ``k`` of rows with a length and ``n`` term frequencies."""
    stats = rows.agg(F.count("*").alias("n"), F.avg("__len").alias("avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"d{i}") for i in range(n)]).first()
    score = F.lit(0.0)
    for i in range(n):
        idf = float(np.log(1 + (stats["n"] - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)))
        f = F.col(f"__tf{i}").cast("double")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.lit(float(stats["avg"] or 1.0))))
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def token_runs(tokens: Column) -> Column:
    """array<struct<token, tf>>: each distinct token of a row with its number, from the sorted tokens."""
    held = F.transform(F.array(F.sort_array(tokens)), lambda s: F.struct(s.alias("s"), F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull()).alias("at")))
    runs = F.transform(held, lambda h: F.transform(h["at"], lambda i, j: F.struct(F.get(h["s"], i).alias("token"), (F.coalesce(F.get(h["at"], j + 1), F.size(h["s"])) - i).cast("long").alias("tf"))))
    return F.get(runs, F.lit(0))


def postings(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, token, tf: the inverted index, to be written once and read by later queries. Tokens are
    counted within their row, so nothing is shuffled."""
    return docs.select(key, F.explode(token_runs(F.col(tokens))).alias("p")).select(key, "p.token", "p.tf")


def document_frequencies(docs: DataFrame, tokens: str) -> DataFrame:
    """token, df, cf: documents that hold a token, and how often it occurs; only partial sums by token
    are shuffled."""
    found = docs.select(F.explode(token_runs(F.col(tokens))).alias("p"))
    return found.groupBy(F.col("p.token").alias("token")).agg(F.count("*").alias("df"), F.sum("p.tf").alias("cf"))


# Vectors depend on them.
FNV_START, FNV_PRIME, GOLDEN, MASK = 1469598103934665603, 1099511628211, 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF
#: What a token and each of its triples of characters add, 1 to 0.35: whole numbers, whose sums are exact in any order.
TOKEN, TRIPLE = 20.0, 7.0


def _fnv(units: Iterable[int], h: int = FNV_START) -> int:
    for u in units:
        h = ((h ^ u) * FNV_PRIME) & MASK
    return h


def _fnv_all(units: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes of many runs of ``units``, each from its value in ``h``, a step of all runs at a time, until a few
    long ones are left."""
    live, i = np.flatnonzero(sizes > 0), 0
    while len(live) > 50:
        h[live] = (h[live] ^ units[starts[live] + i]) * np.uint64(FNV_PRIME)
        i += 1
        live = live[sizes[live] > i]
    for j in live:
        h[j] = _fnv(units[starts[j] + i : starts[j] + sizes[j]].tolist(), int(h[j]))
    return h


def _cells(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token number, cell and what it adds there, for each token and its triples of characters (UTF-16 units).

    Each has three cells, with a sign of its own in each; triples are marked, so that no word is taken for one.
    """
    units = np.frombuffer("".join(tokens).encode("utf-16-le", "surrogatepass"), np.uint16)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    if sizes.sum() < len(units):  # characters of two units
        sizes = np.fromiter((len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in tokens), np.int64, len(tokens))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(units)) - np.repeat(starts, sizes)
    triple = np.flatnonzero(place < np.repeat(sizes, sizes) - 2)
    owner = np.concatenate([np.arange(len(tokens)), np.repeat(np.arange(len(tokens)), sizes)[triple]])
    starts, sizes = np.concatenate([starts, triple]), np.concatenate([sizes, np.full(len(triple), 3)])
    first = np.repeat(np.array([FNV_START, _fnv(b"3:")], np.uint64), [len(tokens), len(triple)])
    h = _fnv_all(units.astype(np.uint64), starts, sizes, first)
    h = np.concatenate([h + np.uint64(j * GOLDEN & MASK) for j in range(3)])
    weight = np.tile(np.repeat([TOKEN, TRIPLE], [len(tokens), len(triple)]), 3)
    return np.tile(owner, 3), (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63) == 0, weight, -weight)


def hashed_vectors(lists: list[list[str]], split: Callable[[str], list[str]] | None = None) -> np.ndarray:
    """Signed hashes of tokens (weight 1) and of their character triples (0.35) in 512 dimensions, of unit
    length, for each list of tokens, or of what ``split`` takes into tokens; zeros for none. What is distinct
    is hashed once, all at a time."""
    codes: dict[str, int] = {}
    flat = np.fromiter((codes.setdefault(t, len(codes)) for tokens in lists for t in tokens), np.int64)
    v = np.zeros((len(lists), DIM))
    if len(flat):
        if split:
            tokens = [split(t) for t in codes]
            owner, cells, add = _cells([t for some in tokens for t in some])
            owner = np.repeat(np.arange(len(codes)), [len(t) for t in tokens])[owner]
        else:
            owner, cells, add = _cells(list(codes))
        order = np.argsort(owner, kind="stable")
        cells, add = cells[order], add[order]
        n = np.bincount(owner, minlength=len(codes))
        first = np.cumsum(n) - n
        rows = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        for at in range(0, len(flat), 200_000):  # bounds what is spread out at once
            part, own = flat[at : at + 200_000], rows[at : at + 200_000]
            size = n[part]
            spread = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            low = own[0]
            sums = np.bincount((np.repeat(own, size) - low) * DIM + cells[spread], add[spread], (own[-1] - low + 1) * DIM)
            v[low : own[-1] + 1] += sums.reshape(-1, DIM)
    norms = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norms > 0, norms, 1.0)


def hashed_vector(tokens: list[str]) -> np.ndarray:
    return hashed_vectors([list(tokens)])[0]


#: Tokens, rows and characters of tokens that are turned to vectors at a time, about.
HELD_TOKENS, HELD_ROWS, HELD_CHARS = 100_000, 2048, 1_000_000


def vector_parts(lists: Iterator[list[str]], split: Callable[[str], list[str]] | None = None) -> Iterator[np.ndarray]:
    """``hashed_vectors`` of many lists of tokens, a bounded part at a time."""
    held: list[list[str]] = []
    n = chars = 0
    for tokens in lists:
        held.append(tokens)
        n += len(tokens)
        chars += sum(map(len, tokens))
        if n >= HELD_TOKENS or len(held) >= HELD_ROWS or chars >= HELD_CHARS:
            yield hashed_vectors(held, split)
            held, n, chars = [], 0, 0
    if held:
        yield hashed_vectors(held, split)


def embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, embedding: the hashed vector of each whole text, in any script; zeros for a text without tokens or a null
    one. Tokens stay in the task, which passes vectors on a bounded part at a time."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for v in vector_parts((embed_runs(t.as_py()) for t in batch.column(1)), embed_tokens):
                ends = pa.array(np.arange(0, v.size + 1, DIM, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(v.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(v)), vectors], [key, "embedding"])
                at += len(v)

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def hash_embed(tokens: Column | str) -> Column:
    def run(values: pa.Array) -> pa.Array:
        parts = [v.astype(np.float32).ravel() for v in vector_parts(t.as_py() or [] for t in values)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, DIM, dtype=np.int32)), pa.array(flat))

    return F.arrow_udf(run, "array<float>")(tokens)


def likeness(rows: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, similarity: the cosine of each text's hashed vector to the question's; texts without tokens, and all for a
    question without any, are left out. Vectors stay in the task that makes them."""
    question = hashed_vector(tokens_of(query))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for v in vector_parts(tokens_of(t.as_py()) for t in batch.column(1)):
                fit = np.flatnonzero(v.any(axis=1) & question.any())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + fit)), pa.array(v[fit] @ question)], [key, "similarity"])
                at += len(v)

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, similarity double")


def fuse(sides: list[DataFrame], key: str, score: str = "score", k: int = RRF_K) -> DataFrame:
    """key, fused: reciprocal ranks summed over retrieval sides of bounded length."""
    ranks = []
    for side in sides:
        w = Window.orderBy(F.desc(score), key)  # a side has at most its recall limit of rows
        ranks.append(side.withColumn("__r", F.row_number().over(w) - 1).select(key, (1.0 / (k + F.col("__r") + 1)).alias("__s")))
    merged = ranks[0]
    for r in ranks[1:]:
        merged = merged.union(r)
    return merged.groupBy(key).agg(F.sum("__s").alias("fused"))


def diversify(rows: DataFrame, key: str, relevance: str, vec: str, k: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance over candidates, as one group: twice the recall of a retrieval
    side at most, which is checked."""
    if rows.limit(MMR_MOST + 1).count() > MMR_MOST:
        raise ValueError(f"more than {MMR_MOST} candidates")
    kind = dict(rows.dtypes)[key]

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([relevance, key], ascending=[False, True], ignore_index=True)
        rel = frame[relevance].to_numpy() / max(float(frame[relevance].max()), 1e-12)
        m = np.stack(frame[vec].to_list()) if len(frame) else np.zeros((0, 1))
        sim = np.maximum(m @ m.T, 0)
        chosen: list[int] = []
        while len(chosen) < min(k, len(frame)):
            near = sim[:, chosen].max(axis=1) if chosen else np.zeros(len(frame))
            gain = weight * rel - (1 - weight) * near
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        out = frame.loc[sorted(chosen), [key, relevance]]
        return out.rename(columns={relevance: "relevance"})

    return rows.withColumn("__group", F.lit(0)).groupBy("__group").applyInPandas(pick, f"{key} {kind}, relevance double")


def hybrid(chunks: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """BM25 and hashed-vector recall, fused by rank and diversified.

    One pass over the chunks leaves a few numbers of each: its length, how often it has each word of the
    question, and its likeness to the question. Vectors are made again for the fused candidates only.
    """
    words = tokens_of(query)
    asked = sorted(set(words))
    question = hashed_vector(words)
    kind = dict(chunks.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [tokens_of(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(hashed_vectors(lists) @ question)]
            columns += [pa.array([x.count(w) for x in lists], pa.int64()) for w in asked]
            yield pa.RecordBatch.from_arrays(columns, [key, "__len", "similarity", *[f"__tf{i}" for i in range(len(asked))]])

    counts = "".join(f", __tf{i} long" for i in range(len(asked)))
    made = written(chunks.select(key, text).mapInArrow(run, f"{key} {kind}, __len long, similarity double{counts}"), "chunk-counts")
    lexical = _scored(made, key, len(asked), RECALL) if asked else made.select(key, F.lit(0.0).alias("score")).orderBy(key).limit(RECALL)
    dense = made.where(F.col("similarity") > COSINE_FLOOR).orderBy(F.desc("similarity"), key).limit(RECALL).select(key, F.col("similarity").alias("score"))
    fused = written(fuse([lexical, dense], key), "fused")  # at most twice the recall
    candidates = chunks.select(key, text).join(F.broadcast(fused), key)
    return diversify(candidates.select(key, hash_embed(tokenize(F.col(text))).alias("vec"), "fused"), key, "fused", "vec", k)


#: The share of a context from which a history is compressed, what is kept of its end, and the
#: characters from which a tool's result counts as long.
TRIGGER, KEPT, LONG_RESULT = 0.7, 6, 200
#: What stands for a result that is left out.
BLANK = "(left out)"


def compress_history(messages: DataFrame, trigger: int, long: Column | None = None, kept: int = KEPT) -> DataFrame:
    """session_id, id, state, tokens of messages (session_id, id, role, content): what becomes of each.

    A session of at most ``trigger`` tokens stays ``whole``. Of another the oldest long tool results (``long``)
    are ``blanked`` until it fits, or all; if it does not fit then, and has more than ``kept`` + 1 messages, all
    but the last ``kept`` are ``summarised``, left to the summary. Tokens are those of the state. Ids are unique in
    a session and without nulls; no content counts as an empty one. Running sums go over ranges, so a session may
    be of any length.
    """
    from sonaria.functions.scalars import estimate_tokens
    from sonaria.operators.relational import spread_sums

    long = F.coalesce(long if long is not None else (F.col("role") == "tool") & (F.char_length("content") > LONG_RESULT), F.lit(False))
    content = F.coalesce(F.col("content"), F.lit(""))
    size = F.when(content == "", 8).otherwise(estimate_tokens(content) + 8).cast("long")
    blank = (estimate_tokens(F.lit(BLANK)) + 8).cast("long")
    rows = messages.select("session_id", "id", long.alias("__long"), size.alias("__size"), blank.alias("__blank"))
    placed = spread_sums(rows.withColumn("__own", F.when(F.col("__long"), F.col("__size") - F.col("__blank")).otherwise(0)), "session_id", "id", "__own")
    totals = rows.groupBy("session_id").agg(F.sum("__size").alias("__used"), F.sum(F.when(F.col("__long"), F.col("__size") - F.col("__blank")).otherwise(0)).alias("__most"), F.count("*").alias("__n"))
    over = F.col("__used") > trigger
    gone = over & (F.col("__used") - F.col("__most") > trigger) & (F.col("__n") > kept + 1) & (F.col("__place") <= F.col("__n") - kept)
    blanked = over & F.col("__long") & (F.col("__used") - F.col("__before") > trigger)
    joined = placed.join(totals, "session_id")
    return joined.select("session_id", "id", F.when(gone, "summarised").when(blanked, "blanked").otherwise("whole").alias("state"), F.when(gone, 0).when(blanked, F.col("__blank")).otherwise(F.col("__size")).cast("long").alias("tokens"))


WORD = "[A-Za-z][A-Za-z0-9-]+"
#: Words of a line of keywords, least and most; the characters before which a colon ends a heading;
#: and the words of the frequent ones.
LINE_WORDS, HEADING, FREQUENT = (3, 16), 40, 12


def sanitize_keywords(docs: DataFrame, key: str, text: str, noise: list[str], stop: list[str]) -> DataFrame:
    """key, value: the words of the first line that looks like keywords, else the text's most frequent words.

    Such a line holds none of ``noise`` (in any case) and no full stop, question or exclamation mark of CJK, and three
    words or more after a colon near its beginning; its first sixteen count. Without one it is the twelve most
    frequent words of three letters or more but ``stop``, in lower case, of equal ones the first to occur. A text
    without words, an empty or a null one gives an empty value. ``key`` tells rows apart.
    """
    clean = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = F.coalesce(F.col(text), F.lit(""))
    quiet = lambda x: ~F.array_contains(F.transform(F.array(*[F.lit(n.lower()) for n in [*noise, "。", "？", "！"]]), lambda n: F.contains(F.lower(x), n)), True)
    lines = F.filter(F.transform(F.split(body, "\n"), clean), quiet)
    words = F.transform(lines, lambda x: F.regexp_extract_all(F.regexp_replace(x, f"^[^:：]{{0,{HEADING - 1}}}[:：]", ""), F.lit(WORD), F.lit(0)))
    first = F.get(F.filter(words, lambda w: F.size(w) >= LINE_WORDS[0]), F.lit(0))
    rows = docs.select(F.col(key), body.alias("__text"), F.array_join(F.slice(first, 1, LINE_WORDS[1]), " ").alias("value"))
    rest = rows.where("value is null").select(key, F.posexplode(F.regexp_extract_all("__text", F.lit(WORD), F.lit(0))).alias("__at", "__w")).withColumn("__w", F.lower("__w"))
    kept = rest.where((F.char_length("__w") >= 3) & ~F.col("__w").isin(*stop))
    counts = kept.groupBy(key, "__w").agg((-F.count("*")).alias("n"), F.min("__at").alias("at"))
    named = counts.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "at", "__w"))), 1, FREQUENT).alias("s"))  # the words of one text
    top = named.select(key, F.array_join(F.transform("s", lambda x: x["__w"]), " ").alias("__top"))
    return rows.select(key, "value").join(top, key, "left").select(key, F.coalesce("value", "__top", F.lit("")).alias("value"))
