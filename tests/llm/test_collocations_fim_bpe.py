import functools
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonaria.llm import bpe, collocations, fim
from tests.llm.conftest import TEXTS

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))


# phrases


def brute_collocations(rows, longest=3, least=10, inside=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", tuple(ws[i : i + k])] += 1
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = defaultdict(list)
    for (lang, ws), a in found.items():
        inner = any(100 * c >= inside * a and any(o[i : i + len(ws)] == ws for i in range(len(o) - len(ws) + 1)) for (m, o), c in found.items() if m == lang and len(o) > len(ws))
        if not inner:
            score, _, l, r = min((1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most]))


def words(seed, n, kinds=9):
    r = random.Random(seed)
    return " ".join(r.choice(["Of", "the", "a", "new", "York", "é", "漢", "x.", "y,"][:kinds]) for _ in range(n))


@pytest.mark.parametrize("longest,least,block", [(3, 10, 300), (3, 10, 6_000_000), (4, 5, 150), (2, 3, 1000)])
def test_phrases_are_those_of_brute_force(spark, longest, least, block):
    rows = [(["en", "de", None, "und"][i % 4], words(i, 60)) for i in range(60)] + [("en", "one hot passage of words that repeats. " * 40)] * 5 + [("fr", None), ("fr", ""), (None, " \t\n")]
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int").repartition(5)
    got = sorted(map(tuple, collocations.collocations(docs, longest, least, block_chars=block, most=25).collect()))
    assert got == brute_collocations(rows, longest, least, most=25)


def test_phrases_of_awkward_rows(spark, awkward, nothing, rows_of):
    rows = [(s, t) for _, t, s in rows_of]
    got = sorted(map(tuple, collocations.collocations(awkward, least=2, lang_col="source", block_chars=5000).collect()))
    assert got == brute_collocations(rows, least=2)
    assert collocations.collocations(nothing, lang_col="source").count() == 0


def test_repeated_words_overlap(spark):
    docs = spark.createDataFrame([(0, "a a a a a a a a a a a a", "x")], "doc_id long, text string, lang string")
    assert {r.phrase: (r.a, r.l, r.r) for r in collocations.collocations(docs).collect()} == {"a a a": (10, 12, 11)}


def test_products_beyond_64_bits(spark):
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    rows = [(10**15 - 1, 10**15, 10**15 + 7), (3 * 10**12, 4 * 10**12, 5 * 10**13)]
    got = [r.s for r in spark.createDataFrame(rows, "a long, l long, r long").select(score.alias("s")).collect()]
    assert got == [1000000 * a * a // (l * r) for a, l, r in rows]


def test_very_long_texts_are_cut_between_pieces():
    text = "word one, two. " * 1000 + "y" * 500
    parts = list(collocations.cuts(text, 333))
    assert "".join(parts) == text and len(parts) > 30 and all(p[-1] in collocations.MARKS for p in parts[:-1])
    assert list(collocations.cuts("x" * 1000, 10)) == ["x" * 1000]


# fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


FIM = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "a\r\nb\x0b\x85c d\n\n🎉e", "<P>", "x <S> y\nz", "<\nS>\n<P\n>", "<P<P\n<S\n<", "line\n" * 30000, "🎉\n" * 99]


def test_fill_in_middle_is_brute_force(spark):
    rows = [(i * 7 + j, t) for i in range(12) for j, t in enumerate(FIM)] + [(None, "a\nb\nc"), (-3, "a\nb\nc"), (-3, "a\nb\nc")]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), r.output) for r in made)
    assert got == Counter((i, *brute_fim(i, t)) for i, t in rows)
    assert all(r.back == (r.text or "") for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(
    "unit,pattern",
    [
        ("lines", r"[^\n]*\n|[^\n]+"), ("words", r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+"), ("runs", r"[^\W]+|[ \t-\r]+|[^\w \t-\r]+"),
        (fim.begun_by("#"), r"#[^#]*|[^#]+"), (fim.ended_by("[.;]"), r"[^.;]*[.;]|[^.;]+"), (fim.runs_of("[0-9]", "[^0-9]"), r"[0-9]+|[^0-9]+"), (fim.led_by("[A-Z]", "[^A-Z]"), r"[A-Z]+[^A-Z]*|[^A-Z]+"),
    ],
)
def test_units_are_those_of_the_grammar(spark, unit, pattern):
    r = random.Random(4)
    texts = ["".join(r.choice(["a", "B", " ", "\n", "\t", "#", ".", ";", "7", "é", "🎉", "_", "漢"]) for _ in range(r.randrange(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fim.units_of(F.col("text"), unit).alias("u")).collect()
    assert all(r.u == re.findall(pattern, r.text) for r in rows)


def test_sentences_keep_every_character(spark):
    rows = spark.createDataFrame([("One. Two!  Three?\nFour",), ("",), (" . a. ",)], "text string").select("text", fim.units_of(F.col("text"), "sentences").alias("u")).collect()
    assert all("".join(r.u) == r.text for r in rows) and rows[0].u[0] == "One. " and rows[1].u == []


def test_rates_and_marks(spark):
    docs = spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(400)], "doc_id long, text string")
    forms = Counter(r.form for r in fim.transform(docs, rate=50, spm_rate=0).collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260
    assert {r.form for r in fim.transform(docs, rate=0).collect()} == {"plain"}
    own = fim.Marks("<a>", "<b>", "<c>")
    made = fim.transform(docs, "words", marks=own).withColumn("back", fim.restored(F.col("output"), F.col("form"), own)).collect()
    assert all(r.back == r.text and "<a>" in r.output for r in made)


def test_fill_in_middle_of_awkward_rows(awkward, nothing, rows_of):
    made = fim.transform(awkward)
    got = Counter((r.doc_id, r.n, r.form, r.output) for r in made.collect())
    assert got == Counter((i, *(b := brute_fim(i, t))[:2], b[4]) for i, t, _ in rows_of)
    assert fim.transform(nothing).count() == 0


# byte pairs


@functools.cache
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(RANKS, public_tokenizers.PATTERN, limit=500)


def test_every_token_has_a_slot_of_its_own(pairs):
    keys = list(RANKS)
    assert sorted(pairs.hash.slots(keys).tolist()) == list(range(len(keys)))
    assert pairs.ranks(keys) == list(RANKS.values())
    other = [k + b"\xff\xfe" for k in keys[:2000]] + [b"", b"no such token"]
    assert pairs.ranks(other) == [RANKS.get(k, -1) for k in other]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000])
def test_perfect_hash_of_any_size(n):
    keys = [f"key {i}".encode() for i in range(n)]
    made = bpe.PerfectHash(keys)
    assert sorted(made.slots(keys).tolist() if n else []) == list(range(n))


def test_ids_are_the_librarys(pairs):
    r = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\r\n", "\t", "aaaa", "the", "ing", ".", "Σ", "é", "é", "<|endoftext|>", "'s", "don't", "漢字", "\x1c", "\xa0", " ", "10", "ÀÉ", "\x01", "🎉", "한", "xyz", "\U0010ffff"]
    texts = [t or "" for t in TEXTS] + ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(4000)] + ["ab" * 50_000, "a" * 100_001, " " * 5000 + "x"]
    want = library()
    for text, ids in zip(texts, pairs.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text), repr(text[:60])
        assert pairs.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_any_text_comes_back(text):
    made = test_any_text_comes_back.pairs = getattr(test_any_text_comes_back, "pairs", None) or bpe.BytePairs(RANKS, public_tokenizers.PATTERN)
    ids = made.encode(text)
    assert ids == library().encode_ordinary(text) and made.decode(ids) == text.encode()


def test_small_vocabulary_without_some_bytes_merges_from_the_left():
    made = bpe.BytePairs({b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aaa": 4}, r"[ab]+")
    own = tiktoken.Encoding("small", pat_str=r"[ab]+", mergeable_ranks={b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aaa": 4}, special_tokens={})
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice("aab") for _ in range(r.randrange(1, 14)))
        assert made.encode(text) == own.encode_ordinary(text), text


def test_encode_and_decode_tables(spark, awkward, nothing, rows_of):
    vocabulary = bpe.shared(spark, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    want = library()
    made = bpe.encode(awkward, vocabulary, decoded=True)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in made.collect())
    assert got == Counter((i, len(ids := want.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows_of)
    back = bpe.decode(made.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("ids")).alias("ids")), vocabulary)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, _ in rows_of)
    assert bpe.encode(nothing, vocabulary).count() == 0


def test_ids_that_are_none_are_an_error(pairs):
    with pytest.raises(KeyError):
        pairs.decode([60_000])
