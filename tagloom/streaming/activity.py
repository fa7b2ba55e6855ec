"""Activity events as streams. Each function takes and returns a (streaming or
batch) DataFrame; `run_once` drives a stream over what its source holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.plans.staging import shared_folder

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_activity(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).format(fmt).load(path)


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): an event needs an id, a time and a type that is not blank."""
    ok = F.col("event_id").isNotNull() & F.col("ts").isNotNull() & (F.trim(F.coalesce("event_type", F.lit(""))) != "")
    return events.where(ok), events.where(~ok)


def events_by_type(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def daily_activity(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "n")


def sliding_items(events: DataFrame, key: str = "user_id", width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row per session: events, clicks, purchases, and whether a purchase was made."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key)
    count = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    out = s.agg(F.count(F.lit(1)).alias("events"), count("click").alias("clicks"), count("purchase").alias("purchases"))
    return out.select(key, F.col("w.start").alias("start"), "events", "clicks", "purchases", (F.col("purchases") > 0).alias("converted"))


def dedupe(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def click_join(shown: DataFrame, clicks: DataFrame, key: str = "user_id", within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Each click with what was shown to the same key up to `within` before it."""
    a = shown.select(F.col(key), F.col("event_id").alias("shown_id"), F.col("ts").alias("shown_ts")).withWatermark("shown_ts", late)
    b = clicks.select(F.col(key).alias("_k"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")).withWatermark("click_ts", late)
    near = (F.col(key) == F.col("_k")) & (F.col("click_ts") >= F.col("shown_ts")) & (F.col("click_ts") <= F.col("shown_ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select(key, "shown_id", "click_id")


def running_profile(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Running totals of a key; for update mode."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))


class UpsertTable:
    """A keyed table in folders bucket=<b>/batch=<k>: the last row of each key by
    `order`, whatever the order in which batches come. A batch reads and writes only the
    buckets that its keys fall into; a bucket's newest folder is its content. Of older ones the
    last is kept, so that a batch that is run again finds what it found at first and
    writes the same folders again."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64, schema: str | None = None) -> None:
        """`buckets` bounds the tasks of a batch, and stays what it was at first; `schema` is that of a table nothing was written to."""
        self.spark, self.path, self.keys, self.order, self.buckets, self.schema = spark, path, keys, order, buckets, schema

    def _folders(self) -> dict[int, list[int]]:
        """The batches of each bucket, in order."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        found: dict[int, list[int]] = {}
        for f in root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*/batch=*")) or []:
            bucket, batch = (int(x.partition("=")[2]) for x in f.getPath().toString().rstrip("/").split("/")[-2:])
            found.setdefault(bucket, []).append(batch)
        return {b: sorted(k) for b, k in found.items()}

    def _read(self, parts: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/bucket={b}/batch={k}" for b, k in parts)).drop("bucket", "batch")

    def read(self) -> DataFrame:
        if self.schema and not self._folders():
            return self.spark.createDataFrame([], self.schema)
        return self._read([(b, k[-1]) for b, k in self._folders().items()])

    def write(self, batch: DataFrame, batch_id: int) -> None:
        from tagloom.operators.tables import upsert

        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r.b for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` rows
        before = {b: [k for k in ks if k < batch_id] for b, ks in self._folders().items() if b in touched}
        old = [(b, ks[-1]) for b, ks in before.items() if ks]
        rows = self._read(old).unionByName(batch) if old else batch
        merged = upsert(rows.limit(0), rows, self.keys, order=self.order).withColumns({"bucket": bucket, "batch": F.lit(batch_id)})
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)
        jvm = self.spark.sparkContext._jvm
        for b, ks in before.items():
            for k in ks[:-1]:
                gone = jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}/batch={k}")
                gone.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tagloom-{name}-{uuid.uuid4().hex}"


class Fed(NamedTuple):
    """A folder of batches to be streamed: `files` of them a trigger make one batch."""

    path: str
    files: int

    def stream(self, spark: SparkSession, batches: int = 1) -> DataFrame:
        return read_activity(spark, self.path, files_per_trigger=self.files * batches)


def as_files(events: DataFrame, batches: int = 4, rows_per_file: int = 500_000) -> Fed:
    """Writes a bounded table as several batches, one after the other and in order of time, to be streamed."""
    seconds = F.coalesce(F.col("ts").cast("timestamp").cast("double"), F.lit(float("inf")))  # rows without a time come last
    cuts = events.select(seconds.alias("s")).approxQuantile("s", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *cuts, None]
    inside = [(F.lit(True) if a is None else seconds > a) & (F.lit(True) if b is None else seconds <= b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return as_batches([events.where(c) for c in inside], rows_per_file)


def as_batches(parts: list[DataFrame], rows_per_file: int = 500_000) -> Fed:
    """Writes each table as a batch of one folder, in the order given. A file source knows files only, by their
    time, so that every batch is as many files: what the largest needs at `rows_per_file`, each written by a task of its
    own, or as many as the smallest has rows. Empty tables are no batch."""
    path = _fresh(parts[0].sparkSession, "stream")
    counted = [(p, n) for p in parts if (n := p.count())]
    if not counted:
        parts[0].limit(0).write.parquet(path)
        return Fed(path, 1)
    files = min(-(-max(n for _, n in counted) // rows_per_file), min(n for _, n in counted))
    for k, (p, n) in enumerate(counted):
        if files == 1:
            p.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{path}/b{k:06d}")
            continue
        # Ids are dense in one partition, so that few rows fill all files too.
        slot = (p.coalesce(1) if n < 100 * files else p).withColumn("_slot", F.pmod(F.monotonically_increasing_id(), F.lit(files)))
        slot.repartition(files, "_slot").sortWithinPartitions("_slot", "ts").write.partitionBy("_slot").parquet(f"{path}/b{k:06d}")
    return Fed(path, files)


def run_once(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, counts: list[str] | None = None):
    """Runs a stream over all that is there and gives the folder of its Parquet
    output; with `counts`, also the sums of those figures of its stateful
    operators over all batches, such as numRowsDroppedByWatermark."""
    spark = stream.sparkSession
    out, mark = _fresh(spark, "out"), _fresh(spark, "mark")
    writer = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True)
    if each is not None:
        writer = writer.foreachBatch(each)
    elif mode == "append":
        writer = writer.format("parquet").option("path", out).outputMode("append")
    else:
        writer = writer.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    query = writer.start()
    seen: dict[int, list] = {}  # by batch: a query itself keeps its last hundred only
    while True:
        ended = query.awaitTermination(0.5)
        for p in query.recentProgress if counts is not None else []:
            if p["batchId"] not in seen or p["stateOperators"]:
                seen[p["batchId"]] = p["stateOperators"]
        if ended:
            break
    if query.exception() is not None:
        raise query.exception()
    return out if counts is None else (out, *(sum(int(op.get(c, 0)) for ops in seen.values() for op in ops) for c in counts))


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the batches that update mode wrote."""
    rows = spark.read.option("basePath", out).parquet(out)
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("_r", newest).where("_r = 1").drop("_r", "batch")
