"""Media columns: payloads stored losslessly as 8-bit images in archives, and read back by range.

``media_archive`` is a custom Spark data source. Its writer packs each row's payload as an 8-bit
greyscale PNG of 192 samples a line into archives of ``ARCHIVE_BYTES`` or little more and commits a
manifest, so that files of failed attempts, which an attempt deletes if it still can, are never
read. Its reader plans byte ranges over the archives of a directory from their sizes alone; a task
takes the members whose headers begin in its range, reads each on its own by offset, tries a member
again after a pause without touching the others, and hands out Arrow batches of bounded size. A
range reads the directory of its own archive, whose size is bounded as the archive's is. Archives
go to the shared folder through Arrow's file systems.

Rows: a null text counts as empty and gives a payload of 192 spaces; equal texts give equal
stored bytes; repeated rows and null ids give one row each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sonaria.llm.common import new_path, table

LINE = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
BATCH_BYTES = 4 << 20
ARCHIVE_BYTES = 64 << 20
#: Seconds before a member is tried again; they double from try to try.
PAUSE = 0.2


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its length before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (-len(data) % LINE or (LINE if not data else 0)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(data: bytes) -> bytes:
    """A greyscale PNG whose samples are the bytes of ``data``, a multiple of a line."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, LINE)
    lines = np.zeros((len(rows), LINE + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", LINE, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> bytes:
    """The samples of an image of ``encode_image``; raises on damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, size = 8, b"", (0, 0)
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            packed += data
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:].tobytes()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class ArchiveWritten(WriterCommitMessage):
    archives: list[tuple[str, int]]


@dataclass
class ArchiveRange(InputPartition):
    name: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _file_system(self.path)
        store.create_dir(path, recursive=True)
        made: list[tuple[str, int]] = []
        rows = ((doc_id.as_py(), text.as_py()) for batch in iterator for doc_id, text in zip(batch.column("doc_id"), batch.column("text")))
        name = ""
        try:
            row = next(rows, None)
            while row is not None:  # a task without rows leaves no archive
                name = f"part-{uuid.uuid4().hex}.zip"
                with store.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    held = 0
                    while row is not None and held < self.archive_bytes:
                        data, size = payload(row[1])
                        media = encode_image(data)
                        archive.writestr(zipfile.ZipInfo(f"{row[0]}_{size}.png"), media)
                        held += len(media)
                        row = next(rows, None)
                made.append((name, store.get_file_info(f"{path}/{name}").size))
        except BaseException:
            _delete(store, path, [*(n for n, _ in made), name])
            raise
        return ArchiveWritten(made)

    def commit(self, messages) -> None:
        store, path = _file_system(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages) -> None:
        store, path = _file_system(self.path)
        _delete(store, path, [name for m in messages if m for name, _ in m.archives])


def _delete(store, path: str, names: list[str]) -> None:
    """Delete archives that no manifest will name; one that is not there is no matter."""
    for name in filter(None, names):
        try:
            store.delete_file(f"{path}/{name}")
        except OSError:
            continue


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, attempts: int):
        self.path, self.range_bytes, self.attempts = path, range_bytes, attempts

    def partitions(self) -> list[InputPartition]:
        store, path = _file_system(self.path)
        with store.open_input_stream(f"{path}/{MANIFEST}") as src:
            archives = json.loads(src.read())
        return [ArchiveRange(name, at, at + self.range_bytes) for name, size in archives for at in range(0, size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, path = _file_system(self.path)
        source = f"{path}/{partition.name}"
        with store.open_input_file(source) as src:
            members = [m for m in zipfile.ZipFile(src).infolist() if partition.start <= m.header_offset < partition.end]
        rows, held = [], 0
        src = None
        try:
            for member in members:
                for attempt in range(self.attempts):
                    try:
                        if src is None:
                            src = store.open_input_file(source)
                            archive = zipfile.ZipFile(src)
                        media = archive.read(member)  # checks the member's own checksum
                        break
                    except (OSError, zipfile.BadZipFile):
                        if src is not None:
                            src.close()
                        src = None
                        if attempt + 1 == self.attempts:
                            raise
                        time.sleep(PAUSE * 2**attempt)
                rows.append((member.filename, member.header_offset, media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)
        finally:
            if src is not None:
                src.close()

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names, offsets, media = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(media, pa.binary())], ["member", "offset", "media"])


class MediaArchive(DataSource):
    """format("media_archive"): option ``path``; ``archive_bytes`` when writing, ``range_bytes`` and ``attempts`` when reading."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, offset long, media binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", 16 << 20)), int(self.options.get("attempts", 3)))


def store_payloads(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the payloads of all rows to archives under ``path``."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows.write.format("media_archive").option("archive_bytes", archive_bytes).mode("append").save(path)


def media_rows(spark, path: str, range_bytes: int = 16 << 20) -> DataFrame:
    """member, offset and stored bytes of every member of the archives under ``path``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: bytes) -> str:
    """Level statistics of the samples: mean, deviation, smoothness, entropy, and eight level shares."""
    levels = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = levels / levels.sum()
    seen = share[share > 0]
    mean = float((share * np.arange(256)).sum())
    deviation = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    change = float(np.abs(np.diff(np.frombuffer(samples, np.uint8).astype(np.int16))).mean())
    entropy = float(-(seen * np.log2(seen)).sum())
    return ",".join(f"{x:.4f}" for x in [mean, deviation, change, entropy, *share.reshape(8, 32).sum(axis=1)])


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in FEATURES.split(", ")]
        for batch in batches:
            out = []
            for member, stored in zip(batch.column("member"), batch.column("media")):
                key, n = member.as_py().removesuffix(".png").rsplit("_", 1)
                stored = stored.as_py()
                data = decode_image(stored)
                out.append((None if key == "None" else int(key), int(n), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return media.mapInArrow(run, FEATURES)


def op3_query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    store_payloads(table(spark, sf_dir, "documents"), path)
    return describe(media_rows(spark, path))
