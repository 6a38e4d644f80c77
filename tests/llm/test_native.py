import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from sonaria.llm import licenses, lines, multiset
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_licence_base_against_brute_force(awkward, rows_of):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(awkward).collect()), key=str)
    want = []
    for i, t, _ in rows_of:
        words = WORD.findall(ascii_lower(t or ""))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want.append((i, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("released under the MIT License", "mit"),
        ("komm mit mir", ""),
        ("SPDX-License-Identifier: MIT", "mit"),
        ("the GNU Lesser General Public License version 2.1 or later", "gpl,lgpl-2.1"),
        ("All\nrights   reserved", "reserved"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Creative Commons Attribution-ShareAlike", "cc-attribution-sharealike"),
        ("dedicated to the public domain; Boost Software License", "boost,public-domain"),
        ("KKSD licensİ", ""),
    ],
)
def test_licence_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_rules_are_hundreds_and_longer_ones_suppress_those_inside(spark):
    assert len(licenses.rules()) >= 200
    row = licenses.scan(spark.createDataFrame([(1, "licensed under the terms of the Mozilla Public License, v. 2.0")], "doc_id long, text string")).first()
    assert row.labels == "mpl-2.0" and row.score == 0.95
    assert licenses.scan(spark.createDataFrame([(1, "gpl " * 3000)], "doc_id long, text string")).first().labels == "gpl"


def brute_lines(rows, least):
    sites, first = {}, {}
    for key, text, site in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" ")
            if line:
                first.setdefault(line, (key, pos))
                sites.setdefault(line, set()).update([site] if site is not None else [])
    out = []
    for key, text, site in rows:
        if text is None:
            out.append((key, None))
            continue
        kept = [ln for pos, ln in enumerate(text.split("\n")) if not ln.strip(" ") or len(sites[ln.strip(" ")]) < least or first[ln.strip(" ")] == (key, pos)]
        out.append((key, "\n".join(kept)))
    return out


def test_lines_against_brute_force(awkward, spark):
    extra = [(100 + i, f"Common banner\nown {i}\n Common banner \n\nrare{i % 3}", f"s{i}") for i in range(12)]
    df = awkward.select("doc_id", "text", "source").union(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    rows = [tuple(r) for r in df.collect()]
    got = sorted(((r.doc_id, r.text) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == sorted(brute_lines(rows, lines.MIN_SITES), key=str)
    made = lines.dedup_lines(awkward)
    assert made.columns == awkward.columns and made.count() == awkward.count()


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(n * 100 + i, f"line {n}", f"s{i}") for n in range(1, 12) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = lines.wide_lines(lines.lines_of(docs, "doc_id", "text", "source"), 5, margin=0.9)
    assert wide.count() == 7


def test_line_oracle(awkward, spark):
    docs = awkward.where("doc_id is not null and text is not null").dropDuplicates(["doc_id"]).select("doc_id", "source", "text")
    documents = docs.toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql(lines.ORACLE_SQL).df().sort_values("doc_id", ignore_index=True)
    got = lines.dedup_lines(docs, counts=True).drop("source").toPandas().sort_values("doc_id", ignore_index=True)
    assert got[want.columns].equals(want.astype(got[want.columns].dtypes.to_dict()))


def text_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_edits(rows):
    """(doc_id, n_chars, digest of the edited text) in ascending order of id, then hash of the text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1])))
    texts = [r[1] or "" for r in rows]
    out = []
    for k, r in enumerate(rows):
        text, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(text) // 2
        out.append((r[0], len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts(awkward, rows_of, monkeypatch):
    for size in (3, 1000):
        monkeypatch.setattr(multiset.with_next, "__defaults__", (size,))
        made = multiset.edited_neighbours(awkward).select("doc_id", "n_chars", "edited_sha256")
        assert sorted(map(tuple, made.collect()), key=str) == brute_edits(rows_of)


def test_edited_texts_of_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None, f"null id {i}. and more {i % 5}") for i in range(60)] + [(7, f"one id {i}. {i}") for i in range(40)] + [(9, "equal row. again")] * 25 + [(None, "also equal")] * 11 + [(3, "x"), (20, "last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(multiset.with_next, "__defaults__", (4,))
    for many in (1000, 10, 2):
        made = multiset.edited_neighbours(docs, many=many).select("doc_id", "n_chars", "edited_sha256")
        assert sorted(map(tuple, made.collect()), key=str) == brute_edits(rows)


def sentences(text):
    return Counter(x for x in re.split(r"\n+|(?<=[.!?])\s+", text) if x.strip(" "))


def test_likeness_against_true_shares(spark):
    """The cosine of the sentence counts, within five deviations for each pair and close on average."""
    r = random.Random(5)
    made = [" ".join(f"Sentence {r.randrange(60)} of {k}." if r.random() < 0.5 else f"Shared {r.randrange(40)}." for _ in range(r.randrange(1, 60))) for k in range(60)]
    rows = [(i, a, made[(i * 7 + j) % 60]) for i, a in enumerate(made) for j in range(3)]
    df = spark.createDataFrame([(a, b) for _, a, b in rows], "a string, b string").select("a", "b", multiset.vector(F.col("a")).alias("va"), multiset.vector(F.col("b")).alias("vb"))
    dots = [multiset.dot(F.col(x), F.col(y)).alias(n) for x, y, n in (("va", "va", "aa"), ("vb", "vb", "bb"))]
    got = df.select("*", *dots).select("a", "b", multiset.likeness(F.col("va"), F.col("vb"), F.col("aa"), F.col("bb")).alias("near")).collect()
    errors = []
    for row in got:
        x, y = sentences(row.a), sentences(row.b)
        true = sum(n * y[k] for k, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
        errors.append(row.near - true)
    assert max(map(abs, errors)) < 0.36 and sum(e * e for e in errors) / len(errors) < 0.08**2


def test_fingerprints_are_homomorphic(spark):
    rows = [("a. b\nc", "c\na. b"), ("x\ny\nx", "x\nx\ny"), ("p", "q"), ("", " "), ("x", "x\nx")]
    df = spark.createDataFrame(rows, "a string, b string").select(multiset.vector(F.col("a")).alias("va"), multiset.vector(F.col("b")).alias("vb"), multiset.vector(F.concat_ws("\n", "a", "b")).alias("both"))
    made = df.select("*", multiset.digits(F.col("va")).alias("da"), multiset.digits(F.col("vb")).alias("db"), (multiset.add(F.col("va"), F.col("vb")) == F.col("both")).alias("added"), (multiset.subtract(F.col("both"), F.col("vb")) == F.col("va")).alias("taken")).collect()
    assert [r.da == r.db for r in made] == [True, True, False, True, False]
    assert all(r.added and r.taken for r in made)
    assert len({len(r.da) for r in made}) == 1


def test_likeness(spark, awkward, tmp_path):
    awkward.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    rows = multiset.op4_query(spark, str(tmp_path)).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    texts = {}
    for r, t in ((r, dict(enumerate(TEXTS)).get(r.doc_id)) for r in rows):
        texts.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for k, v in texts.items() if k)
    one = spark.createDataFrame([(1, "only. one")], "doc_id long, text string")
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    assert multiset.op4_query(spark, f"{tmp_path}/one").first().near_next == 1.0


def test_empty_tables(nothing, spark, tmp_path):
    assert licenses.scan(nothing).count() == 0 and lines.dedup_lines(nothing).count() == 0
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert multiset.op4_query(spark, str(tmp_path)).count() == 0
