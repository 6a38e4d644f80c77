"""The block index against full scans."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sonaria.operators import blocks as K
from sonaria.operators import text as T


def brute(texts, query, k):
    docs = {i: Counter(T.tokens_of(t)) for i, t in texts.items()}
    size = {i: sum(c.values()) for i, c in docs.items()}
    mean = sum(size.values()) / len(size)
    out = []
    for i, c in docs.items():
        s = 0.0
        for w in set(query):
            df = sum(w in d for d in docs.values())
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) if c[w] else 0
        if s > 0:
            out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(3000):
        low = 10 if 1000 <= i < 1100 else 30  # a stretch of keys is richer in the first words
        texts[i * 3 - 50] = " ".join(rng.choice(vocabulary[: low if rng.random() < 0.5 else 60]) for _ in range(rng.randint(0, 40)))
    texts[7001 * 3] = None
    texts[7002 * 3] = "rare " + "common " * 200
    texts |= {9000 * 3 + i: "common tie" for i in range(40)}
    return texts, spark.createDataFrame(list(texts.items()), "id long, text string")


def test_equal_to_the_full_scan(spark, made, monkeypatch):
    monkeypatch.setattr(K, "SEGMENT_DOCS", 50)
    texts, docs = made
    built = K.build(docs.withColumn("key", F.lit("clash")), "id", "text")
    assert built.segments > 40 and built.documents == len(texts)
    index = K.load(spark, built.path)
    assert index == built
    for query, k in ((["w1"], 5), (["w1", "w2", "w3"], 10), (["rare", "common"], 7), (["tie"], 5), (["w59", "w0", "none"], 3), (["common"], 500), (["none"], 5), ([], 5)):
        got = K.search(spark, index, query, k)
        assert [(r["key"], round(r["score"], 9)) for r in got.rows.orderBy(F.desc(F.round("score", 9)), "key").collect()] == brute(texts, query, k), query
        assert got.read <= got.blocks


def test_blocks_below_the_floor_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(K, "SEGMENT_DOCS", 50)
    texts = {i: "hot " * 8 + "x" if 500 <= i < 520 else ("hot " if i % 3 == 0 else "") + ("cold " if i % 2 == 0 else "") + "pad " * 30 for i in range(3000)}
    index = K.build(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    got = K.search(spark, index, ["hot", "cold"], 10)
    assert got.blocks > 60 and got.read < got.blocks / 10
    assert [r["key"] for r in got.rows.collect()] == [i for i, _ in brute(texts, ["hot", "cold"], 10)]


def test_no_documents(spark):
    index = K.build(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert K.search(spark, index, ["a"], 3).rows.count() == 0


def test_a_hot_token_lies_in_several_blocks(spark):
    docs = spark.range(1000).select(F.col("id"), F.lit("every word").alias("text"))
    index = K.build(docs, "id", "text")
    rows = spark.read.parquet(index.path + "/blocks")
    assert rows.agg(F.max("n")).first()[0] <= K.BLOCK and rows.where("token = 'every'").agg(F.sum("n")).first()[0] == 1000


def test_postings_are_passed_on_in_bounded_parts():
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(120)] + [None]
    batch = pa.RecordBatch.from_pydict({"key": list(range(121)), "text": texts})
    made = list(K.counted(iter([batch]), T.latin_words))
    assert max(b.num_rows for b in made) <= K.HELD + 1000 and sum(b.num_rows for b in made) == 120_001
    assert made[-1].to_pylist()[-1] == {"key": 120, "token": None, "tf": 0, "len": 0}
