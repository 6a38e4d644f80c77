"""Commits over several tables: readers see all of a commit or none of it.

A collection is a folder. Each commit writes the tables that change to folders of its own, and then one
small file, its manifest, which names the folder of every table; the manifest with the highest number is
the collection. A manifest is written under another name and renamed, which either happens or does
not, and a number is taken once: of two writers the second is told so. What a stopped commit has written
is named by no manifest and is deleted by ``clean``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.sources.shared import delete_path, file_system, written


class Conflict(RuntimeError):
    """Another commit was made since the collection was read."""


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        store, target = file_system(self.spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in store.listStatus(target)) if store.exists(target) else []

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self._names("commits") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, version: int | None = None) -> dict:
        """version, tables and notes of a commit, the newest if none is named."""
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "notes": {}}
        version = found[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/commits/{version:012}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """A table as a commit left it; None where it has none."""
        names = self.manifest(version)["tables"].get(table)
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names]) if names else None

    def commit(self, tables: dict[str, DataFrame], notes: dict | None = None, since: int | None = None, add: bool = False) -> int:
        """Write ``tables`` in place of those of the same name, or with ``add`` to their rows, and keep the
        others; the number of the commit. ``since`` is the version the tables were made from: a ``Conflict``
        if there is a later one."""
        old = self.manifest()
        if since is not None and old["version"] != since:
            raise Conflict(f"version {old['version']} was made since {since}")
        turn = old["version"] + 1
        names = dict(old["tables"])
        for table, rows in tables.items():
            name = f"{table}-{turn:012}-{uuid.uuid4().hex[:12]}"
            rows.write.parquet(f"{self.path}/data/{name}")
            names[table] = [*(names.get(table, []) if add else []), name]
        self._publish(turn, {"version": turn, "tables": names, "notes": notes or {}})
        return turn

    def _publish(self, turn: int, manifest: dict) -> None:
        store, target = file_system(self.spark, f"{self.path}/commits/{turn:012}.json")
        _, draft = file_system(self.spark, f"{self.path}/commits/.draft-{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if store.exists(target) or not store.rename(draft, target):
            store.delete(draft, False)
            raise Conflict(f"version {turn} was made meanwhile")

    def clean(self, kept: int = 2) -> list[str]:
        """Delete all but the last ``kept`` commits and the folders that no commit left names; their names."""
        found = self.versions()
        for version in found[: max(0, len(found) - kept)]:
            delete_path(self.spark, f"{self.path}/commits/{version:012}.json")
        named = {n for v in found[-kept:] for names in self.manifest(v)["tables"].values() for n in names}
        gone = [n for n in self._names("data") if n not in named]
        for name in gone:
            delete_path(self.spark, f"{self.path}/data/{name}")
        return gone


#: Tables of a scan that belong to a library and are replaced with it.
CHILDREN = ("instruments", "clips", "junk", "manuals")


def save_scan(collection: Collection, roots: DataFrame, libraries: DataFrame, children: dict[str, DataFrame], run: dict) -> int:
    """One scan's result as one commit: the number of it.

    Roots (path, ...) are added or renewed by path and keep their ids; the libraries of the scanned
    roots and all their rows in ``CHILDREN`` are deleted and those of the scan put in; the run is
    added to ``runs``. ``libraries`` name their root by ``root_path``, and children their library by
    ``library_path``; new libraries get ids above all others, in the order of their paths.
    """
    before = collection.manifest()["version"]
    spark = collection.spark
    old_roots, old_libraries = collection.read("roots"), collection.read("libraries")
    made: dict[str, DataFrame] = {}
    scanned = roots.dropDuplicates(["path"])
    if old_roots is None:
        made["roots"] = _numbered(scanned, "path", 0)
    else:
        known = old_roots.select("path", "id")
        fresh = _numbered(scanned.join(known, "path", "left_anti"), "path", old_roots.agg(F.max("id")).first()[0] or 0)
        same = scanned.join(known, "path")
        made["roots"] = old_roots.join(scanned.select("path"), "path", "left_anti").unionByName(same).unionByName(fresh)
    ids = made["roots"].join(scanned.select("path"), "path", "left_semi").select(F.col("path").alias("root_path"), F.col("id").alias("root_id"))
    named = libraries.join(ids, "root_path").drop("root_path")
    top = 0 if old_libraries is None else old_libraries.agg(F.max("id")).first()[0] or 0
    numbered = written(_numbered(named, "path", top), "libraries")
    gone = None
    if old_libraries is None:
        made["libraries"] = numbered
    else:
        gone = old_libraries.join(ids.select("root_id"), "root_id", "left_semi").select(F.col("id").alias("library_id"))
        made["libraries"] = old_libraries.join(ids.select("root_id"), "root_id", "left_anti").unionByName(numbered)
    owners = numbered.select(F.col("path").alias("library_path"), F.col("id").alias("library_id"))
    for name in CHILDREN:
        old = collection.read(name)
        new = children[name].join(owners, "library_path").drop("library_path") if name in children else None
        stays = old if old is None or gone is None else old.join(gone, "library_id", "left_anti")
        both = [x for x in (stays, new) if x is not None]
        if both:
            made[name] = both[0].unionByName(both[1]) if len(both) > 1 else both[0]
    log = spark.createDataFrame([(before + 1, json.dumps(run, sort_keys=True))], "version long, run string")
    runs = collection.read("runs")
    made["runs"] = log if runs is None else runs.unionByName(log)
    return collection.commit(made, run, since=before)


def _numbered(rows: DataFrame, order: str, above: int) -> DataFrame:
    """``rows`` with ids above ``above``, ascending with ``order``: ranges of a sort, and places in them."""
    from sonaria.operators.relational import numbered

    return numbered(rows, order, "id", above)


def extract(collection: Collection, jobs: DataFrame, work, table: str = "features", key: str = "clip_id", batch: int = 10_000, most_batches: int | None = None) -> int:
    """Do the jobs that are not done yet, in commits of ``batch`` jobs each; how many were done.

    ``work`` takes a DataFrame of jobs and gives rows with ``key``. A job whose key is in ``table`` is done,
    so a run that was stopped goes on after its last commit, and a job is done once however often it is
    listed. ``most_batches`` ends a run early.
    """
    done, turn = 0, 0
    while most_batches is None or turn < most_batches:
        held = collection.read(table)
        left = jobs.dropDuplicates([key]) if held is None else jobs.dropDuplicates([key]).join(held.select(key), key, "left_anti")
        part = written(left.orderBy(key).limit(batch), "jobs")  # in the order of keys, so that runs agree
        n = part.count()
        if not n:
            break
        collection.commit({table: work(part)}, {"jobs": n}, add=True)
        done, turn = done + n, turn + 1
    return done
