"""Windows over events, batch and streaming: the streaming queries replay the table as files and must equal their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.operators import windows
from stratalake.operators.graph import cut
from stratalake.registry import query
from stratalake.streaming import engine

HOUR = "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, count(*) AS n FROM events GROUP BY 1"
SESSIONS = "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, no"


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("tumbling_hour", ops="R3", sql=HOUR)
def tumbling_hour(spark, t):
    return engine.tumbling(t("events"), "ts", "1 hour").select(_stamp("start").alias("start"), "n")


@query("sliding_two_hours", ops="R3", sql="SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def sliding_two_hours(spark, t):
    return engine.tumbling(t("events"), "ts", "2 hours", slide="1 hour").select(_stamp("start").alias("start"), "n")


@query("session_6h", ops="R3", sql=SESSIONS)
def session_6h(spark, t):
    return engine.session_counts(t("events"), "ts", "user_id", "6 hours").select("user_id", _stamp("start").alias("start"), "n")


@query("session_islands", ops="R3 A7", sql=SESSIONS)
def session_islands(spark, t):
    return windows.sessions(t("events"), "user_id", "ts", 6 * 3600).select("user_id", _stamp("start").alias("start"), "n")


@query("rule_actions", ops="R11", sql="SELECT event_id, action FROM events JOIN (VALUES ('error', 20.0, 'alert'), ('purchase', 50.0, 'thank'), ('purchase', 10.0, 'note')) r(event_type, lim, action) USING (event_type) WHERE value > lim")
def rule_actions(spark, t):
    rules = spark.createDataFrame([("error", 20.0, "alert"), ("purchase", 50.0, "thank"), ("purchase", 10.0, "note")], "event_type string, limit double, action string")
    return engine.fired_rules(t("events"), rules).select("event_id", "action")


@query("session_rules", ops="R11", sql="SELECT user_id AS key, action FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) JOIN (VALUES ('error', 2, 'alert'), ('purchase', 1, 'greet'), ('purchase', 4, 'thank')) r(event_type, least, action) USING (event_type) WHERE n >= least")
def session_rules(spark, t):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rules = [("error", 2, "alert"), ("purchase", 1, "greet"), ("purchase", 4, "thank")]
    return _replayed(spark, t, lambda s: engine.session_rules(s.select(F.col("user_id").alias("key"), "event_type"), rules), "append")


@query("json_messages", ops="R13 S22", sql="SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_messages(spark, t):
    return engine.parsed(t("events"), "k long", "props").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def _replayed(spark: SparkSession, t, plan, mode: str) -> DataFrame:
    """The rows that a streaming query over the events gives in the end: each batch is written to the shared folder, and the
    last batch of a complete query, or all batches of an appending one, are read."""
    cut(spark.range(1))  # sets the shared folder where it is unset
    root = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{uuid.uuid4().hex}"
    source, sink = f"{root}/in", f"{root}/out"
    t("events").repartition(3, "event_id").write.parquet(source)
    stream = spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", 2).parquet(source)
    out = plan(stream)
    schema = out.schema

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={n:06d}")

    q = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(schema.add("batch", T.IntegerType())).parquet(sink)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


@query("stream_tumbling", ops="R3", sql=HOUR)
def stream_tumbling(spark, t):
    return _replayed(spark, t, lambda s: engine.tumbling(s, "ts", "1 hour"), "complete").select(_stamp("start").alias("start"), "n")


@query("stream_filter", ops="R3", sql="SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND value > 10")
def stream_filter(spark, t):
    return _replayed(spark, t, lambda s: s.where("event_type = 'purchase' AND value > 10").select("event_id", "event_type"), "append")


@query("stream_distinct", ops="R6 W10 R8", sql="SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, t):
    return _replayed(spark, t, lambda s: s.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@query("stream_counts", ops="R9 A2", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(spark, t):
    return _replayed(spark, t, lambda s: s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "complete")
