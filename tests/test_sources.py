import io
import math
import random
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sonaria.sources import files, tables
from sonaria.streaming import incremental


def build(root):
    r = random.Random(1)
    for lib in ("Alpha", "Beta"):
        for i in range(50):
            p = root / lib / "Docs" / f"notes{i:02}.pdf"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x" * (50 * 1024 if i else 50 * 1024 - 1))
        for i in range(200):
            p = root / lib / "Samples" / f"s{i:03}.wav"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x" * (8 * 1024 + (1 if i % 10 else 0)))
        for name in ("a.nki", "b.nki", "c.nkm", "x.nicnt", "Logic_Icons.zip", "old.rar", "Manual.txt", "license.rtf"):
            (root / lib / name).write_bytes(bytes(r.randrange(256) for _ in range(40)))


def test_scan_of_a_tree(spark, tmp_path):
    build(tmp_path)
    listing = files.listing(spark, f"file://{tmp_path}").cache()
    sums = {r.library: r for r in files.library_sums(listing).collect()}
    assert sums["Alpha"].file_count == 258 and sums["Alpha"].nki_count == 2 and sums["Beta"].nkm_count == 1 and sums["Beta"].has_nicnt
    assert {(r.name, r.suggested_keep) for r in files.junk(listing).collect()} == {("Logic_Icons.zip", True), ("old.rar", False)}
    manuals = files.manuals(listing).groupBy("library").count().collect()
    assert {r["count"] for r in manuals} == {40}
    names = {r.name for r in files.manuals(listing, 1000).collect()}
    assert "Manual.txt" in names and "license.rtf" not in names and "notes00.pdf" not in names
    clips = files.clips(listing)
    assert {r["count"] for r in clips.groupBy("library").count().collect()} == {160}
    assert clips.where("size_bytes <= 8192").count() == 0


def tone(seconds, make, rate=22050):
    x = np.array([make(i / rate) for i in range(int(seconds * rate))])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_features(spark):
    r = random.Random(5)
    sounds = [
        ("sine", tone(1, lambda t: 0.5 * math.sin(2 * math.pi * 440 * t))),
        ("noise", tone(1, lambda t: r.uniform(-0.5, 0.5))),
        ("click", tone(1, lambda t: math.exp(-40 * t) * math.sin(2000 * t))),
        ("pad", tone(1, lambda t: t * 0.9 * math.sin(1000 * t))),
        ("broken", b"RIFFnothing"),
        ("short", tone(0.01, lambda t: 0.5)),
    ]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in sounds], "path string, content binary")
    got = {x.path: x for x in files.audio_features(df).collect()}
    assert len(got["sine"].features) == 32 and all(-1 <= v <= 1 for v in got["sine"].features)
    assert got["noise"].features[28] > got["sine"].features[28] and got["click"].features[31] < got["pad"].features[31]
    assert got["broken"].error and got["short"].error == "too short"


def test_headers_and_markup(spark):
    head = b"\0" * 12 + b"hsin" + b"\0" * 20 + "Grand Piano".encode("utf-16-le") + b"\0\0\1" + "7.5.2".encode("utf-16-le")
    df = spark.createDataFrame([(bytearray(head),), (bytearray(b""),), (None,)], "content binary")
    got = [tuple(r.h) for r in df.select(files.read_header("content").alias("h")).collect()]
    assert got == [("container", "Grand Piano", "7.5.2"), ("legacy", "", ""), ("legacy", "", "")]
    df = spark.createDataFrame([("<p>a &amp; b</p><script>x</script> c",), ("{\\rtf1\\b hello\\b0 world}",), (None,)], "t string")
    assert [r.t for r in df.select(files.plain_text("t").alias("t")).collect()] == ["a & b c", "hello world", ""]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'c"d'), ("x", "y|z")], "p string, q string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, df.collect()))
    assert tables.to_markdown(df.where("p = 'x'")) == "| p | q |\n| - | - |\n| x | y\\|z |"
    assert all(tables.schema(n).fields for n in tables.SCHEMAS)


def test_vectors_and_upserts(spark):
    blob = np.array([1.5, -2.0], "<f4").tobytes()
    df = spark.createDataFrame([(1, bytearray(blob)), (2, None)], "id long, b binary")
    assert [r.vec for r in tables.unpack_vectors(df, "b").orderBy("id").collect()] == [[1.5, -2.0], None]
    old = spark.createDataFrame([(1, "a"), (2, "a")], "clip_id long, created_at string")
    new = spark.createDataFrame([(2, "b"), (3, "b")], "clip_id long, created_at string")
    assert sorted(map(tuple, tables.upsert_features(old, new).collect())) == [(1, "a"), (2, "b"), (3, "b")]


def test_knowledge_documents(spark, tmp_path):
    (tmp_path / "kb.json").write_text('{"library_id": 4,\n "manual_name": "m", "page_count": 1, "pages": [{"n": 1, "text": "t", "source": "text"}], "chunks": [{"id": 0, "page": 1, "text": "t"}]}')
    row = tables.read_kb(spark, str(tmp_path), whole_files=True).select("library_id", F.size("chunks").alias("n")).first()
    assert tuple(row) == (4, 1)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02}:00", i % 3, "click" if i % 2 else "view", float(i)) for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = incremental.trace_windows(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(calls) AS n, count(*) AS k FROM w").first() == (60, 24)
    q = incremental.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", ["user_id"], "event_id")
    q.awaitTermination()
    newest = lambda: {(r.user_id, r.event_id) for r in incremental.newest_snapshot(spark, f"{tmp_path}/out").collect()}
    assert newest() == {(0, 57), (1, 58), (2, 59)}
    # a new checkpoint goes on from the table that is there, and adds each of its batches once
    spark.createDataFrame([(90, 1), (50, 2), (91, 7)], "event_id long, user_id long").selectExpr("event_id", "current_timestamp() ts", "user_id", "'click' event_type", "1.0D value").write.parquet(f"{tmp_path}/in2")
    for _ in range(2):
        more = spark.readStream.schema(schema).parquet(f"{tmp_path}/in2")
        incremental.upsert_stream(more, f"{tmp_path}/out", f"{tmp_path}/cp2", ["user_id"], "event_id").awaitTermination()
        assert newest() == {(0, 57), (1, 90), (2, 59), (7, 91)}
        assert len(incremental.snapshots(spark, f"{tmp_path}/out")) == 2
    batch = spark.read.parquet(f"{tmp_path}/in")
    assert incremental.session_windows(batch, "2 minutes").count() == 60


def test_audio_results_go_on_in_small_batches():
    clip = tone(1, lambda t: 0.5, 8000)
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(600)], "content": [clip if i % 3 else None for i in range(600)]})
    made = list(files.clip_batches(iter([batch]), 12.0, "path string, rate int, samples array<double>, error string", lambda rate, x: (rate, files.resample(x, rate, 16000))))
    assert max(len(b.column("samples").flatten()) for b in made) <= files.HELD_SAMPLES + 16000
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [str(i) for i in range(600)]
    assert all(len(r["samples"]) == 16000 and r["error"] is None if int(r["path"]) % 3 else r["samples"] is None and r["error"] is not None for r in rows)
