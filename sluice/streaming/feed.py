"""The activity rollup kept up to date from a stream of events.

A run can grow or merge when an event comes late, and events of other kinds
bridge gaps, so session windows with a watermark would give other runs. Each
micro-batch therefore joins what is stored for the users that it touches, and
their runs are computed anew by the batch operator; other users' rows stay.

The store has a folder for each micro-batch and bucket of users:
``batch=N/bucket=K``. Reading for some users prunes to their buckets and keeps
their rows only, before anything is shuffled. compact() writes all batches up to
one as ``base=N``, each event once; readers take the newest whole base and the
batches after it, and what it replaces is deleted last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import activity_rollup

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BUCKETS = 64
#: Batches after which follow() compacts.
EVERY = 64


def _bucket(user: str = "user_id") -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int")


def apply_batch(spark: SparkSession, store: str, batch: DataFrame, batch_id: int) -> None:
    """Appends a micro-batch to the event store, once: a batch that is tried again replaces its own files."""
    batch.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")


def _folders(spark: SparkSession, store: str) -> tuple[list[str], list[str]]:
    """Folders to read (the newest whole base and the batches after it), and those that it replaces."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return [], []
    names = [f.getPath().getName() for f in files.listStatus(root)]
    whole = lambda n: files.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))
    number = lambda n: int(n.split("=")[1])
    bases = [n for n in names if n.startswith("base=") and whole(n)]
    newest = max(bases, key=number, default=None)
    after = number(newest) if newest else -1
    batches = [n for n in names if n.startswith("batch=") and whole(n)]
    live = ([newest] if newest else []) + [n for n in batches if number(n) > after]
    old = [n for n in bases if n != newest] + [n for n in batches if number(n) <= after]
    return [f"{store}/{n}" for n in sorted(live)], [f"{store}/{n}" for n in old]


def stored_events(spark: SparkSession, store: str, users: DataFrame | None = None) -> DataFrame:
    """All stored events, or those of the given users; events that came twice count once."""
    out = spark.createDataFrame([], EVENTS)
    wanted = None
    if users is not None:
        wanted = users.select("user_id").distinct()
        buckets = [r.bucket for r in wanted.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
    for folder in _folders(spark, store)[0]:
        events = spark.read.schema(f"{EVENTS}, bucket int").parquet(folder)
        if wanted is not None:
            events = events.filter(F.col("bucket").isin(buckets))
        out = out.unionByName(events.drop("bucket"))
    if wanted is not None:
        named = wanted.withColumnRenamed("user_id", "_user")
        out = out.join(named, out["user_id"].eqNullSafe(named["_user"]), "left_semi")
    return out.dropDuplicates(["event_id"])


def current_feed(spark: SparkSession, store: str, users: DataFrame | None = None) -> DataFrame:
    """The rollup of all stored events, or of the given users' only."""
    return activity_rollup(stored_events(spark, store, users))


def compact(spark: SparkSession, store: str, batch_id: int) -> None:
    """Writes the batches up to batch_id, all that are there, as one base; deletes what it replaces. A try that failed half way is written again."""
    if f"{store}/base={batch_id}" not in _folders(spark, store)[0]:  # else an earlier try got as far as deleting
        events = stored_events(spark, store).withColumn("bucket", _bucket())
        events.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/base={batch_id}")
    jvm = spark.sparkContext._jvm
    for folder in _folders(spark, store)[1]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def follow(spark: SparkSession, source: DataFrame, store: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None, once: bool = False, every: int = EVERY) -> StreamingQuery:
    """Starts the query; publish gets the new rollup of the users that a batch touches. Every so many batches the store is compacted."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            apply_batch(spark, store, batch, batch_id)
            if publish:
                publish(current_feed(spark, store, batch), batch_id)
            if batch_id % every == every - 1:
                compact(spark, store, batch_id)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
