"""License scans of very long texts, and runs of hits against a single fold."""

import time

from pyspark.sql import functions as F

from sonaria.llm import licenses as L

NOTICE = "Licensed under the Apache License, Version 2.0. Some words, all rights reserved by the MIT License. GNU General Public License version 2 or later.\n"


def test_runs_give_what_one_fold_gives(spark, monkeypatch):
    texts = [NOTICE * n + "tail words" for n in (0, 1, 2, 3, 7, 8, 9, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for size in (1, 4, 1_000_000):
        monkeypatch.setattr(L, "RUN", size)
        line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(L.WORD), F.lit(0)), " "), F.lit(" "))
        rule = F.struct(F.lit(r"(?<= )(?:apache|mit|gnu) (?:licen[sc]e|general)(?= )").alias("pattern"), F.lit(1).alias("priority"), F.lit("x").alias("label"), F.lit(0.5).alias("score"))
        spans = docs.select("doc_id", L._detections(line, rule).alias("d")).orderBy("doc_id").collect()
        found.append(([[tuple(x) for x in r["d"]] for r in spans], [tuple(r) for r in L.scan(docs).orderBy("doc_id").collect()]))
    assert found[0] == found[1] == found[2]
    for text, spans in zip(texts, found[0][0]):
        words = [w.lower() for w in text.replace(".", " ").replace(",", " ").split()]
        assert [s[0] for s in spans] == [i for i in range(len(words) - 1) if words[i] in ("apache", "mit", "gnu") and words[i + 1] in ("license", "general")]


def test_ten_megabytes_of_notices(spark):
    docs = spark.createDataFrame([(1, NOTICE), (2, NOTICE * (10_000_000 // len(NOTICE)))], "doc_id long, text string")
    began = time.perf_counter()
    short, long = L.scan(docs).orderBy("doc_id").collect()
    assert time.perf_counter() - began < 150
    assert short["labels"] == long["labels"] and long["n_base"] == short["n_base"] * (10_000_000 // len(NOTICE))
