"""Named streams and continuous queries on Structured Streaming.

A stream is a folder of files of one schema: defining it fixes the schema, inserting appends a file. A query reads streams, applies a plan
and writes to another stream, a memory table or a function; it can be added and removed while others run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The interval of micro-batches, and how long a synchronous operation waits.
INTERVAL, ACK_MS = "2 seconds", 500


@dataclass
class Engine:
    spark: SparkSession
    root: str
    streams: dict[str, T.StructType] = field(default_factory=dict)
    queries: dict[str, StreamingQuery] = field(default_factory=dict)

    def create(self, name: str, schema: str | T.StructType) -> None:
        if name in self.streams:
            raise ValueError(f"there is a stream {name}")
        self.streams[name] = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.spark.createDataFrame([], self.streams[name]).write.mode("overwrite").parquet(self.path(name))

    def alter(self, name: str, more: str) -> None:
        """Add columns; rows from before have nulls in them."""
        self.streams[name] = T.StructType([*self.streams[name].fields, *T._parse_datatype_string(more).fields])

    def drop(self, name: str) -> None:
        for q in [q for q in self.queries if q.startswith(f"{name}/")]:
            self.remove(q)
        del self.streams[name]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def insert(self, name: str, rows: list[dict] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([tuple(r.get(f.name) for f in self.streams[name].fields) for r in rows], self.streams[name])
        df.coalesce(1).write.mode("append").parquet(self.path(name))

    def columns(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.streams[name].fields]

    def read(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        r = self.spark.readStream.schema(self.streams[name])
        if files_per_trigger:
            r = r.option("maxFilesPerTrigger", files_per_trigger)
        return r.parquet(self.path(name))

    def add(self, name: str, source: str, plan: Callable[[DataFrame], DataFrame], into: str | Callable, mode: str = "append", once: bool = True) -> StreamingQuery:
        """A continuous query over a stream: into a stream by name, a memory table (memory:name), or a foreachBatch function."""
        out = plan(self.read(source)).writeStream.outputMode(mode).option("checkpointLocation", f"{self.root}/_checkpoints/{name}-{uuid.uuid4().hex}")
        out = out.trigger(availableNow=True) if once else out.trigger(processingTime=INTERVAL)
        if callable(into):
            out = out.foreachBatch(into)
        elif into.startswith("memory:"):
            out = out.format("memory").queryName(into.removeprefix("memory:"))
        else:
            out = out.format("parquet").option("path", self.path(into))
        self.queries[f"{source}/{name}"] = q = out.start()
        return q

    def remove(self, key: str) -> None:
        self.queries.pop(key).stop()

    def settle(self) -> None:
        """Wait until the queries have seen all that was inserted: a synchronous operation's end."""
        for q in list(self.queries.values()):
            q.awaitTermination() if q.lastProgress is None and not q.isActive else q.processAllAvailable() if q.isActive else None

    def stats(self) -> list[tuple[str, int]]:
        return [(k, sum(p["numInputRows"] for p in q.recentProgress)) for k, q in self.queries.items()]


class LengthWindow(StatefulProcessor):
    """For each row, how many and what sum the last `length` rows of its key make; the ring lives in list state."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "value double")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        held = [float(r[0]) for r in self.ring.get()] if self.ring.exists() else []
        # a batch's rows of a key come in pieces of any order
        pdf = pd.concat(list(rows)).sort_values("seq")
        out = []
        for at, v in pdf[["seq", "value"]].itertuples(index=False):
            held = [*held, float(v)][-self.length :]
            out.append((key[0], int(at), len(held), sum(held)))
        self.ring.put([(v,) for v in held])
        yield pd.DataFrame(out, columns=["key", "seq", "n", "total"])

    def close(self) -> None:
        pass


def length_windows(stream: DataFrame, length: int) -> DataFrame:
    """(key, seq, n, total) for each row of a stream (key long, seq long, value double)."""
    return stream.groupBy("key").transformWithStateInPandas(LengthWindow(length), outputStructType="key long, seq long, n int, total double", outputMode="Append", timeMode="None")


class CountedRules(StatefulProcessor):
    """Rules of a session for each key: an action fires once, when the rows of its type that the session has seen reach its count."""

    def __init__(self, rules: list[tuple[str, int, str]]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event_type string", "n long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        new: dict[str, int] = {}
        for pdf in rows:
            for name, n in pdf["event_type"].value_counts().items():
                new[name] = new.get(name, 0) + int(n)
        out = []
        for name, n in new.items():
            before = int(self.seen.getValue((name,))[0]) if self.seen.containsKey((name,)) else 0
            out += [(key[0], action) for kind, least, action in self.rules if kind == name and before < least <= before + n]
            self.seen.updateValue((name,), (before + n,))
        yield pd.DataFrame(out, columns=["key", "action"])

    def close(self) -> None:
        pass


def session_rules(stream: DataFrame, rules: list[tuple[str, int, str]]) -> DataFrame:
    """(key, action) of stateful rules (event type, count, action) over a stream (key long, event_type string)."""
    return stream.groupBy("key").transformWithStateInPandas(CountedRules(rules), outputStructType="key long, action string", outputMode="Append", timeMode="None")


def distinct_within(stream: DataFrame, time: str, columns: list[str], lateness: str) -> DataFrame:
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(columns)


def tumbling(stream: DataFrame, time: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, n): rows in tumbling or sliding windows of event time."""
    df = stream.withWatermark(time, late) if late else stream
    return df.groupBy(F.window(time, width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def session_counts(stream: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    df = stream.withWatermark(time, late) if late else stream
    return df.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def fired_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Stateless rules (field value, limit, action) as a join: each row with the actions of the rules that it meets."""
    return rows.join(F.broadcast(rules), "event_type").where(F.col("value") > F.col("limit"))


def parsed(stream: DataFrame, schema: str, payload: str = "value") -> DataFrame:
    """JSON messages by a schema; what can't be parsed is null."""
    return stream.select(F.from_json(F.col(payload).cast("string"), schema).alias("m")).select("m.*")
