"""Streams: windows over event time, stateful filters, limits and de-duplication.

Every flow takes a streaming DataFrame; those that a batch can express take a static one too.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame) -> DataFrame:
    """Streams need an instant as event time; tables may have it without a time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def tumbling(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """Counts and sums of each type and window; what is later than `late` is left out of a stream."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """A user's events that follow each other within `gap`."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first of the events with equal keys."""
    if events.isStreaming:
        return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def visible_text(chunks: DataFrame, opening: str = "<think>", closing: str = "</think>") -> DataFrame:
    """(message, seq, shown) of the chunks (message, seq, text) of a stream: what lies between the tags is dropped.

    A tag may be cut anywhere; the state of a message is what could still become a tag, and whether
    it is inside. Chunks of one message in one trigger are taken in order of seq.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside = state.get if state.exists else ("", False)
        rows = []
        for seq, text in sorted((s, t) for f in frames for s, t in zip(f.seq, f.text)):
            held += text or ""
            shown = ""
            while held:
                tag = closing if inside else opening
                at = held.find(tag)
                if at >= 0:
                    shown += "" if inside else held[:at]
                    held, inside = held[at + len(tag) :], not inside
                    continue
                keep = next((n for n in range(min(len(tag) - 1, len(held)), 0, -1) if held.endswith(tag[:n])), 0)
                shown += "" if inside else held[: len(held) - keep]
                held = held[len(held) - keep :]
                break
            rows.append((key[0], seq, shown))
        state.update((held, inside))
        yield pd.DataFrame(rows, columns=["message", "seq", "shown"])

    kind = dict(chunks.dtypes)["message"]
    return chunks.groupBy("message").applyInPandasWithState(run, f"message {kind}, seq long, shown string", "held string, inside boolean", "append", GroupStateTimeout.NoTimeout)


def limited(attempts: DataFrame, most: int, seconds: int) -> DataFrame:
    """(user_id, event_id, allowed) of attempts (user_id, event_id, at: seconds): at most `most` in a window that the first attempt opens."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (-1, 0)
        rows = []
        for at, event in sorted((a, e) for f in frames for a, e in zip(f["at"], f.event_id)):
            if start < 0 or at >= start + seconds:
                start, n = at, 0
            n += 1
            rows.append((key[0], event, n <= most))
        state.update((int(start), int(n)))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed"])

    return attempts.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, and returns its output as a table in the shared folder."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = f"{named or tempfile.mkdtemp(prefix='clausewise-')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out"))
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files; the table is a file or a folder of part files, in any store that Spark reads."""
    path = f"{folder}/{name}.parquet"
    there = spark.read.parquet(path)
    schema = there.schema
    if any(f.rsplit("/", 1)[-1] != f"{name}.parquet" for f in there.inputFiles()):  # part files of a folder
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
