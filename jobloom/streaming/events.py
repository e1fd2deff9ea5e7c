"""Streams: windows with watermarks, duplicates inside a watermark, and state that outlives a batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.session import stage_root


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files; ts as a UTC timestamp."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    x = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path + "*")
    return x.withColumn("ts", F.col("ts").cast("timestamp"))


def replay(events: DataFrame, part: Column, parts: int) -> DataFrame:
    """Rows as a stream of one micro-batch a part (0, 1, ..), in that order: each part is one file, written after the
    one before it. For tests and backfills of bounded size; a live stream reads the files as they come."""
    spark = events.sparkSession
    path = f"{stage_root(spark)}/replay-{uuid.uuid4().hex}"
    for i in range(parts):
        events.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    x = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return x.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return x.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Events whose keys were not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def claims(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, ts, granted): a claim is granted if `seconds` have passed since the key's last granted one. The state of a
    key is one time; its events come sorted within a batch; events without a time are left out."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=["ts"]).sort_values("ts")
        out = []
        for ts in rows["ts"]:
            t = int(pd.Timestamp(ts).timestamp() * 1000)
            ok = last is None or t - last >= seconds * 1000
            last = t if ok else last
            out.append(ok)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: k[0], "ts": rows["ts"], "granted": out})

    kind = dict(events.dtypes)[key]
    return events.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, ts timestamp, granted boolean", "last long", "append", "NoTimeout")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, from the shared folder."""
    spark = stream.sparkSession
    root = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(df: DataFrame, _: int) -> None:
            df.write.mode("overwrite").parquet(f"{root}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
