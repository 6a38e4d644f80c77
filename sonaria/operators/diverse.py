"""Diverse picks: farthest points over all vectors by core-sets, and over the candidates of a question
with guarantees and library quotas.

``core_set`` needs one pass: each task keeps, batch by batch, the greedy farthest points of what it kept
and the batch, and these meet by tasks of a bounded number each until one group is left. The kept points of
all parts hold a set about as diverse as the best one (composable core-sets), so the last greedy choice
need not see the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.functions.scalars import contains_all, mic_rank, primary_pick, term_and_match
from sonaria.operators.relational import first_rows
from sonaria.sources.shared import written

# What a question gathers, and how many picks and companions it may ask for.
CANDIDATES, MOST_PICKS, MOST_BATCH = 200, 12, 6
#: Parts whose core-sets meet in one group.
FAN = 64


def _units(vectors: list) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def greedy(keys: np.ndarray, units: np.ndarray, k: int, first: int | None = None) -> tuple[list[int], list[float]]:
    """Places of the picks and how far each was from those before (1 - cosine, the first 1): ties go to
    the smallest key; the first pick is ``first``, or the smallest key."""
    order = np.argsort(keys, kind="stable")
    start = order[0] if first is None or first not in keys else int(np.flatnonzero(keys == first)[0])
    picked, told = [int(start)], [1.0]
    far = np.round(1 - units @ units[start], 9)
    while len(picked) < min(k, len(keys)):
        far[picked] = -np.inf
        best = order[int(np.argmax(far[order]))]
        picked.append(int(best))
        told.append(float(far[best]))
        far = np.minimum(far, np.round(1 - units @ units[best], 9))
    return picked, told


def core_set(rows: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding", first: int | None = None) -> DataFrame:
    """pick, key, distance: ``k`` rows (1 to ``MOST_PICKS``), each the farthest by cosine from all before.

    Rows without a vector, or of another dimension than the first row by key, are left out.
    """
    k = max(1, min(MOST_PICKS, k))
    out = f"{key} long, {vec} array<double>"
    data = rows.where(F.size(vec) > 0).select(F.col(key).cast("long").alias(key), F.col(vec).cast("array<double>").alias(vec))
    head = data.where(F.col(key) == first).first() if first is not None else data.agg(F.min_by(F.struct(key, vec), key).alias("r")).first()["r"]
    if head is None:
        return rows.sparkSession.createDataFrame([], f"pick int, {key} long, distance double")
    data = data.where(F.size(vec) == len(head[vec]))

    def few(frame: pd.DataFrame) -> pd.DataFrame:
        """The picks of a frame, starting from the head, which every core-set holds."""
        start = pd.DataFrame({key: [head[key]], vec: [list(head[vec])]})
        frame = pd.concat([start, frame[frame[key] != head[key]]], ignore_index=True)
        return frame.iloc[greedy(frame[key].to_numpy(), _units(frame[vec].to_list()), k, head[key])[0]]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for frame in frames:
            if not len(frame):
                continue
            kept = few(frame if kept is None else pd.concat([kept, frame], ignore_index=True))
        if kept is not None:
            yield kept

    held = written(data.mapInPandas(parts, out), "core-sets")
    while (groups := -(-held.count() // (FAN * MOST_PICKS))) > 1:
        held = written(held.groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("g")).applyInPandas(lambda frame: few(frame[[key, vec]]), out), "core-sets")

    def last(frame: pd.DataFrame) -> pd.DataFrame:
        frame = few(frame[[key, vec]]).reset_index(drop=True)
        _, told = greedy(frame[key].to_numpy(), _units(frame[vec].to_list()), k, head[key])
        return pd.DataFrame({"pick": np.arange(len(frame), dtype=np.int32), key: frame[key], "distance": told})

    return held.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(last, f"pick int, {key} long, distance double")


def _order(seed: int) -> Column:
    """Demos first, then a random order that a seed fixes."""
    return F.struct((F.col("kind") != "demo").cast("int").alias("rest"), F.xxhash64("id", F.lit(seed)).alias("turn"), F.col("id").alias("id"))


def _candidates(clips: DataFrame, question: str, seed: int) -> DataFrame:
    """The first ``CANDIDATES`` clips with all words in name or path, then those worth hearing."""
    found = clips.where(term_and_match(F.col("name"), F.col("rel_path"), question)).withColumn("turn", _order(seed)).orderBy("turn").limit(CANDIDATES)
    found = written(found, "candidates")  # at most CANDIDATES rows
    return found.where(primary_pick(F.col("name"), F.col("rel_path"), F.col("ext"), F.col("kind")))


def choose(frame: pd.DataFrame, count: int, guarantee: int) -> pd.DataFrame:
    """The picks of candidates (id, library_id, strong, vec or None) in their order, and how far each is
    from the nearest other pick that has a vector: 1 for a lone one, 0 without a vector."""
    rows = frame.to_dict("records")
    vec = {r["id"]: _units([r["vec"]])[0] for r in rows if r["vec"] is not None and len(r["vec"])}
    far = lambda a, b: 1.0 - float(vec[a] @ vec[b])
    strong = [r for r in rows if r["strong"]]
    picked: list[dict] = []
    used: set[int] = set()
    for r in strong:
        if len(picked) >= guarantee:
            break
        if r["library_id"] in used and len(used) < guarantee:
            continue
        picked.append(r)
        used.add(r["library_id"])
    taken = {r["id"] for r in picked}
    pool = [r for r in strong + [r for r in rows if not r["strong"]] if r["id"] not in taken and r["id"] in vec]
    while len(picked) < count and pool:
        spread = lambda r: min((far(p["id"], r["id"]) if p["id"] in vec else 0.0 for p in picked), default=1.0)  # noqa: E731, B023
        best = max(pool, key=spread)
        if best["library_id"] in used:
            best = max((r for r in pool if r["library_id"] not in used), key=spread, default=best)
        pool.remove(best)
        picked.append(best)
        used.add(best["library_id"])
    out = []
    for i, r in enumerate(picked):
        others = [far(r["id"], p["id"]) for p in picked if p is not r and p["id"] in vec] if r["id"] in vec else []
        diversity = 1.0 if len(picked) <= 1 else (min(others, default=1.0) if r["id"] in vec else 0.0)
        out.append((i, r["id"], r["library_id"], "name" if r["strong"] else "path", diversity))
    return pd.DataFrame(out, columns=["pick", "id", "library_id", "matched", "diversity"])


_PICKS = "pick int, id long, library_id long, matched string, diversity double"


def diverse_candidates(clips: DataFrame, vectors: DataFrame, question: str, count: int, guarantee: int, batch: int, related: list[str] | None = None, seed: int = 1) -> DataFrame:
    """pick, id, library_id, matched, diversity, companions: clips (id, library_id, name, rel_path, ext,
    kind) for a question, as unlike one another as can be.

    Clips with all words in name or path are retrieved and left to those worth hearing; of those with
    all words in the name ``guarantee`` come first, from different libraries as far as there are any; then
    the farthest by the vectors (id, vec), from libraries not yet used before others. Each gets up to
    ``batch`` clips of its library that match. While there are fewer libraries than ``count``, the
    ``related`` words bring further libraries, in place of a second pick of theirs or added.
    """
    count, batch = max(1, min(MOST_PICKS, count)), max(1, min(MOST_BATCH, batch))
    guarantee = max(0, min(count, guarantee))
    terms = question.lower().split()
    strong = contains_all(F.lower("name"), terms) if terms else F.lit(False)
    found = _candidates(clips, question, seed).join(vectors.select("id", "vec"), "id", "left")
    group = found.select(F.lit(0).alias("g"), "turn", "id", "library_id", strong.alias("strong"), "vec")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(key=frame["turn"].map(lambda t: (t["rest"], t["turn"], t["id"]))).sort_values("key", kind="stable")
        return choose(frame, count, guarantee)

    picks = written(group.groupBy("g").applyInPandas(run, _PICKS), "picks")
    rows = [r.asDict() | {"words": question} for r in picks.orderBy("pick").collect()]  # MOST_PICKS at most
    libraries = {r["library_id"] for r in rows}
    if rows:
        for word in related or []:
            if len(libraries) >= count:
                break
            more = _candidates(clips, word, seed).where(~F.col("library_id").isin(*libraries)) if libraries else _candidates(clips, word, seed)
            firsts = more.groupBy("library_id").agg(F.min_by("id", "turn").alias("id"), F.min("turn").alias("turn")).orderBy("turn").limit(count).collect()
            for r in firsts:
                if len(libraries) >= count:
                    break
                rows.append({"pick": len(rows), "id": r["id"], "library_id": r["library_id"], "matched": f"name:{word}", "diversity": 0.0, "words": word})
                libraries.add(r["library_id"])
    schema = _PICKS + ", words string"
    spark = clips.sparkSession
    chosen = spark.createDataFrame([tuple(r[c] for c in ("pick", "id", "library_id", "matched", "diversity", "words")) for r in rows], schema)
    parts = []
    for words in sorted({r["words"] for r in rows}):
        own = clips.where(term_and_match(F.col("name"), F.col("rel_path"), words)).where(F.col("library_id").isin(*{r["library_id"] for r in rows if r["words"] == words}))
        own = own.where(primary_pick(F.col("name"), F.col("rel_path"), F.col("ext"), F.col("kind"))).select("library_id", _order(seed).alias("turn"))
        near = first_rows(own, ["library_id"], "turn", batch).groupBy("library_id").agg(F.transform(F.sort_array(F.collect_list("turn")), lambda t: t["id"]).alias("near"))
        parts.append(chosen.where(F.col("words") == words).join(near, "library_id", "left"))
    if not parts:
        return chosen.select("pick", "id", "library_id", "matched", "diversity", F.array().cast("array<long>").alias("companions"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    own = F.array("id")
    near = F.when(F.col("near").isNull(), own).when(F.array_contains("near", F.col("id")), F.col("near")).otherwise(F.concat(own, "near"))
    return every.select("pick", "id", "library_id", "matched", "diversity", F.slice(near, 1, batch).alias("companions"))


def far_libraries(clips: DataFrame) -> DataFrame:
    """Libraries of which every clip is from a distant microphone."""
    return clips.groupBy("library_id").agg(F.min(mic_rank(F.col("name"), F.col("rel_path"))).alias("best")).where("best >= 2").select("library_id")
