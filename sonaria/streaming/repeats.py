"""Repeated tool calls of a session, as a batch and as a stream with state.

A call repeats if its tool and its arguments, but for white space, are those of an earlier one among the
session's last calls. The stream keeps a ring of fingerprints per session; it needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sonaria.functions.scalars import args_fingerprint

# A notice is given exactly at these counts among so many calls.
LAST, NOTICES = 24, (3, 5, 8)
OUT = "session_id long, id long, repeats int"


def fingerprint(tool: Column, args: Column) -> Column:
    return F.concat_ws("|", tool, F.coalesce(args_fingerprint(args), F.lit("")))


def calls(trace: DataFrame, without: list[str]) -> DataFrame:
    """session_id, id, fp of the calls that count: those of the tools in ``without`` neither count nor
    push others out of the ring."""
    return trace.where(~F.col("tool_name").isin(*without)).select("session_id", "id", fingerprint(F.col("tool_name"), F.col("args")).alias("fp"))


def repeat_notices(trace: DataFrame, without: list[str], last: int = LAST, block: int = 4096) -> DataFrame:
    """session_id, id, repeats: calls that are the third, fifth or eighth of their fingerprint among the
    session's last ``last``, of a table; a repeated id counts once.

    Places are counted in blocks of a session and blocks are summed, and the calls of a block are seen
    together with the last calls before it, so a session of any length is spread over tasks.
    """
    from sonaria.operators.relational import spread_places

    rows = spread_places(calls(trace, without).dropDuplicates(["session_id", "id"]), "session_id", "id")
    part = F.floor((F.col("place") - 1) / block)
    early = (F.col("place") - 1) % block >= block - last + 1  # also seen by the block after
    seats = F.when(early, F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct((part + 1).alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("guest"))))
    seated = rows.withColumn("s", F.explode(seats)).select("session_id", "id", "fp", "place", "s.part", "s.guest")
    near = Window.partitionBy("session_id", "part", "fp").orderBy("place").rangeBetween(1 - last, 0)
    counted = seated.withColumn("repeats", F.count("*").over(near).cast("int")).where(~F.col("guest"))
    return counted.where(F.col("repeats").isin(*NOTICES)).select("session_id", "id", "repeats")


class _Ring(StatefulProcessor):
    """The last fingerprints of a session and the largest id seen, which repeated batches do not pass."""

    def __init__(self, last: int, forget_ms: int | None):
        self.last, self.forget_ms = last, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "fps array<string>, seen long", self.forget_ms)  # None: kept for good

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.ring.get() if self.ring.exists() else ([], None)
        ring, seen = list(held[0]), held[1]
        out = []
        frame = pd.concat(list(rows)).sort_values("id", kind="stable")
        for id_, fp in zip(frame["id"].tolist(), frame["fp"].tolist()):
            if seen is not None and id_ <= seen:
                continue  # told before, or too late to have a place
            seen = id_
            ring = [*ring, fp][-self.last :]
            if (n := ring.count(fp)) in NOTICES:
                out.append((key[0], id_, n))
        self.ring.update((ring, seen))
        yield pd.DataFrame(out, columns=["session_id", "id", "repeats"]).astype({"repeats": "int32"})

    def close(self) -> None:
        pass


def repeat_stream(trace: DataFrame, without: list[str], last: int = LAST, forget_ms: int | None = None) -> DataFrame:
    """The same notices of a stream whose calls come in the order of their ids within a session; a call that
    comes again, or after a later one, gives no notice and changes nothing. With ``forget_ms`` a session is
    forgotten so long after its last call, by the clock: for streams that run on, since Spark then never
    ends a run over what is available now."""
    rows = calls(trace, without)
    return rows.groupBy("session_id").transformWithStateInPandas(_Ring(last, forget_ms), OUT, "Append", "None" if forget_ms is None else "ProcessingTime")
