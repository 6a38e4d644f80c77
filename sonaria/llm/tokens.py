"""Exact token counts of a SentencePiece BPE model by a two-tier lookup on the map side.

A text is cut before every run of spaces and at every line feed. No piece of the vocabulary spans
such a cut (checked on loading; a vocabulary that fails the check is encoded whole), so a text's
count is the sum of its pre-tokens' counts. The first tier is a broadcast table of the lengths of
frequent pre-tokens, from a sample of bounded size; it only saves time. The second tier is a
cache in each Python worker, of bounded size, that encodes what it meets for the first time.
No pre-token is shuffled.

Rows: a null text counts as empty and has no tokens; every row, repeated or with a null id, gives
one row; other columns are ignored; special strings in texts are ordinary text, as the library
has it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_PRE = re.compile("\n[^ \n]*| +[^ \n]*")
_WORKERS: dict[str, "PreTokenCounts"] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text; those of words begin with their run of spaces."""
    text = " " + text.replace(SPACE, " ")
    return _PRE.findall(text)


class PreTokenCounts(dict):
    """Lengths of pre-tokens in tokens; a missing one is encoded and, within the limit, kept."""

    def __init__(self, model_file: str, frequent: dict[str, int] | None = None, limit: int = 600_000):
        import sentencepiece

        super().__init__(frequent or {})
        self.frequent = frequent or {}
        self.limit = limit
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.separable = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)

    def __missing__(self, token: str) -> int:
        if token[0] == " ":
            n = 1 if token == " " else len(self.library.encode(token[1:]))
        else:
            n = len(self.library.encode(token)) - 1  # the model's own leading space
        if len(self) >= self.limit:
            self.clear()
            self.update(self.frequent)
        self[token] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.library.encode(text))
        return sum(map(self.__getitem__, pre_tokens(text)))


def frequent_pre_tokens(docs: DataFrame, text_col: str, sample_chars: int, keep: int) -> list[str]:
    """The most frequent pre-tokens of a few sampled documents of ``sample_chars`` in total at most."""
    rows = docs.where(F.length(text_col) > 0).select(F.substring(text_col, 1, sample_chars // 100).alias("text")).limit(400)
    counts: Counter[str] = Counter()
    left = sample_chars
    for row in rows.toLocalIterator():
        counts.update(pre_tokens(row.text))
        left -= len(row.text)
        if left <= 0:
            break
    return [t for t, _ in counts.most_common(keep)]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, sample_chars: int = 2_000_000, keep: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    lengths = PreTokenCounts(model_file)
    frequent = spark.sparkContext.broadcast({t: lengths[t] for t in frequent_pre_tokens(docs, text_col, sample_chars, keep)})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{model_file} {frequent.id if hasattr(frequent, 'id') else 0}"
        if key not in _WORKERS:
            _WORKERS.clear()
            _WORKERS[key] = PreTokenCounts(model_file, frequent.value)
        counts = _WORKERS[key]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                text = value.as_py()
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(counts.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sonaria.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
