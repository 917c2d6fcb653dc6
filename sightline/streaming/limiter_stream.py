"""Request limiters over live logs.

Every micro-batch is worked on by the batch functions, which cut each host's requests into chunks, fold the chunks apart and combine
them; a host with a third of a backlog is many tasks. Between micro-batches only one small row per host is carried: when its last
request went out, or its rate and counts. That state is a table written anew by every micro-batch beside the one before it, so a
micro-batch that is repeated after a failure starts from the same state and replaces what it wrote.

A log has to arrive in order of time from one micro-batch to the next; within one, order does not matter. The results then are
those of the batch functions, however the log was split. A folder belongs to one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sightline import vocab
from sightline.operators import limiter

Step = Callable[[DataFrame, int], None]


def _state(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """What the micro-batch before ``number`` left."""
    return spark.read.parquet(f"{path}/state/slot={(number - 1) % 2}") if number else None


def _keep(fresh: DataFrame, state: DataFrame | None, path: str, number: int) -> None:
    """The state behind micro-batch ``number``: rows of its hosts replace older ones."""
    rows = fresh if state is None else state.drop("batch").join(fresh.select("host"), "host", "left_anti").unionByName(fresh)
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/state/slot={number % 2}")


def grant_step(rate: float, path: str, bits: int = limiter.CHUNK_BITS) -> Step:
    """What to do with a micro-batch of requests (``host, id, t``): store its grants and what they leave per host."""

    def step(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, _state(batch.sparkSession, path, number)
        granted = limiter.rate_grants(batch, rate, bits, last=state, work=f"{path}/work")
        granted.write.mode("overwrite").parquet(f"{path}/grants/batch={number}")
        stored = spark.read.schema(granted.schema).parquet(f"{path}/grants/batch={number}")
        _keep(stored.groupBy("host").agg(F.max("granted").alias("last")), state, path, number)

    return step


def rate_step(initial: float, lowest: float, highest: float, path: str, bits: int = limiter.CHUNK_BITS) -> Step:
    """What to do with a micro-batch of a request log: store the rates and counts of its hosts."""

    def step(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, _state(batch.sparkSession, path, number)
        rates = limiter.adaptive_rates(batch, initial, lowest, highest, bits, state=state, work=f"{path}/work")
        rates.write.mode("overwrite").parquet(f"{path}/updates/batch={number}")
        _keep(spark.read.schema(rates.schema).parquet(f"{path}/updates/batch={number}"), state, path, number)

    return step


def _started(log: DataFrame, step: Step, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_rate_grants(
    log: DataFrame, rate: float, path: str, checkpoint: str, bits: int = limiter.CHUNK_BITS, **trigger
) -> StreamingQuery:
    """Store when each request of the stream may go out, a folder per micro-batch."""
    return _started(log, grant_step(rate, path, bits), checkpoint, trigger)


def read_grants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/grants").drop("batch")


def write_adaptive_rates(
    log: DataFrame, path: str, checkpoint: str, initial: float = vocab.INITIAL_RATE, lowest: float = vocab.MIN_RATE,
    highest: float = vocab.MAX_RATE, bits: int = limiter.CHUNK_BITS, **trigger,
) -> StreamingQuery:
    """Store the rates and counts of the hosts of every micro-batch, a folder each."""
    return _started(log, rate_step(initial, lowest, highest, path, bits), checkpoint, trigger)


def current_rates(spark: SparkSession, path: str) -> DataFrame:
    """The rate and counts of every host seen so far."""
    states = spark.read.parquet(f"{path}/state").drop("slot")
    last = states.agg(F.max("batch").alias("batch"))
    return states.join(F.broadcast(last), "batch", "left_semi").drop("batch")


def write_updates(updates: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store each micro-batch of an updating result in a folder of its own (``batch=n``), so a retry replaces it."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_updates(spark, path: str, key: str) -> DataFrame:
    """The last stored row of every key."""
    rows = spark.read.parquet(path)
    names = [name for name in rows.columns if name not in (key, "batch")]
    return rows.groupBy(key).agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch").join(
        rows, [key, "batch"]
    ).select(key, *names)
