"""Structured Streaming: score files as they come, keep a bank or leaf counts up to date, windowed statistics of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlens.operators.base import Detector, label
from oddlens.sources.scratch import batch_limits, settle


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Count, mean and deviation of ``value`` in tumbling or sliding windows of ``ts``; rows later than ``late`` are dropped by the watermark."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).select(F.col("w.start").alias("start"), *by, "n", "mean", "sd")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n", "total")


class TooManyErrors(RuntimeError):
    """Raised in a batch, after its results are written, when more items have failed than are allowed."""


def guarded(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` of ``rows`` (with a column ``id``), which gives a row for each of its rows, with a column ``error``.

    A chunk that fails is worked on row by row; a row that fails alone has its id and error, the rest null.
    """
    kind = f"id {rows.schema['id'].dataType.simpleString()}, {schema}, error string"
    names = [c.split()[0] for c in f"id long, {schema}".split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            try:
                yield work(pdf).assign(error=None)[[*names, "error"]]
            except Exception:  # which row it was is found out below
                for k in range(len(pdf)):
                    one = pdf.iloc[k : k + 1].reset_index(drop=True)
                    try:
                        yield work(one).assign(error=None)[[*names, "error"]]
                    except Exception as wrong:
                        yield pd.DataFrame({"id": one["id"], "error": [f"{type(wrong).__name__}: {wrong}"]}).reindex(columns=[*names, "error"])

    return rows.mapInPandas(each, kind)


def score_stream(rows: DataFrame, model: Detector, target: str, checkpoint: str, learn: Callable[[DataFrame], None] | None = None, once: bool = True):
    """Scores each micro-batch (id, features) with a fitted model and appends (id, score, label) to ``target``.

    ``learn`` sees a batch after it is scored, for models that grow (``partial_fit``, ``merge``). A batch that is
    repeated after a failure overwrites its own folder, so each row is written once.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            label(model.decision_function(df), model.threshold).write.mode("overwrite").parquet(f"{target}/batch={number}")
            if learn:
                learn(df)
        finally:
            df.unpersist()

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def work_stream(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, target: str, checkpoint: str, max_errors: int | None = None, once: bool = True):
    """``guarded`` work of each micro-batch, appended to ``target``; stops with TooManyErrors once all batches hold over ``max_errors`` errors.

    The batch that goes over is written first, and Spark doesn't mark it done: on a restart it is worked on again and
    overwrites its folder, so nothing is lost and the stream goes on if its errors are gone.
    """

    def batch(df: DataFrame, number: int) -> None:
        guarded(df, work, schema).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if max_errors is not None:
            held = df.sparkSession.read.parquet(target).where("error IS NOT NULL").count()
            if held > max_errors:
                raise TooManyErrors(f"{held} errors")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


STATE = "path string, fingerprint string, status string, delivery_attempts int, error string"


class WatchState:
    """What became of each file: a table in numbered versions under ``path``, swapped whole.

    A version counts once Spark has committed it (``_SUCCESS``), so a reader sees the one before or the one after and
    a writer that dies leaves the one before. One writer at a time. The last ``keep`` versions stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Committed ones, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        there = self.versions()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v={there[-1]}") if there else self.spark.createDataFrame([], STATE)

    def swap(self, changed: DataFrame) -> None:
        """The next version: ``changed`` rows in place of those of the same path, the others as they were."""
        there = self.versions()
        rest = self.read().join(changed.select("path"), "path", "left_anti")
        rest.select("path", "fingerprint", "status", "delivery_attempts", "error").unionByName(changed).write.mode("overwrite").parquet(f"{self.path}/v={(there or [0])[-1] + 1}")
        fs, path = self._fs()
        for old in self.versions()[: -self.keep]:
            fs.delete(path(f"{self.path}/v={old}"), True)


def watch_once(files: DataFrame, state: WatchState, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, target: str, attempts: int = 3, max_errors: int | None = None) -> DataFrame:
    """One round over a folder: ``work`` of the files (``settled_files``) that are due, results to ``target``, then the state.

    ``work`` gets ``id`` (the path) and ``content`` and gives ``id`` and the columns of ``schema``. A file is due if it is new or changed, or
    has failed fewer than ``attempts`` times. Results of a round are written before the state is swapped, so a round
    that dies is done again; they lie in a folder named by the state's version, so it overwrites its own. Returns the
    round's rows of the state. With over ``max_errors`` errors in this round, TooManyErrors is raised after the swap.
    """
    spark, known = files.sparkSession, state.read()
    due = settle(pending(files, known, attempts))
    if due.isEmpty():
        return known.limit(0)
    with batch_limits(spark, 16):
        content = spark.read.format("binaryFile").load([r.path for r in due.select("path").toLocalIterator()]).select(F.col("path").alias("id"), "content")
        folder = f"{target}/round={(state.versions() or [0])[-1] + 1}"
        guarded(content, work, schema).write.mode("overwrite").parquet(folder)
    done = spark.read.parquet(folder).groupBy(F.col("id").alias("path")).agg(F.first("error", ignorenulls=True).alias("error"))
    before = known.select("path", F.col("fingerprint").alias("seen"), F.col("delivery_attempts").alias("tried"))
    tries = F.when(F.col("seen") == F.col("fingerprint"), F.col("tried")).otherwise(0) + 1  # a changed file starts anew
    failed = F.col("error").isNotNull()
    rows = due.select("path", "fingerprint").join(done, "path").join(before, "path", "left")
    rows = settle(rows.select("path", "fingerprint", F.when(failed, "failed").otherwise("done").alias("status"), tries.cast("int").alias("delivery_attempts"), "error"))
    state.swap(rows)
    if max_errors is not None and (n := rows.where("status = 'failed'").count()) > max_errors:
        raise TooManyErrors(f"{n} errors")
    return rows


def settled_files(spark: SparkSession, path: str, settle_seconds: int, suffix: str = "") -> DataFrame:
    """Files under ``path`` that haven't changed for a while: path, length, modificationTime, fingerprint. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    old = F.col("modificationTime") <= F.current_timestamp() - F.make_interval(secs=F.lit(settle_seconds))
    return files.where(old & F.endswith("path", F.lit(suffix))).withColumn("fingerprint", F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256))


def pending(files: DataFrame, state: DataFrame, attempts: int = 3) -> DataFrame:
    """Files that are new, changed, or failed fewer than ``attempts`` times. ``state``: path, fingerprint, status, delivery_attempts."""
    known = state.select("path", F.col("fingerprint").alias("seen"), "status", "delivery_attempts")
    due = F.col("seen").isNull() | (F.col("seen") != F.col("fingerprint")) | ((F.col("status") == "failed") & (F.col("delivery_attempts") < attempts))
    return files.join(known, "path", "left").where(due).drop("seen", "status", "delivery_attempts")
