"""Request rates per host, computed from a request log.

Both limiters are sequential by nature, yet each step is a function that can be combined with the
next, so a host's log is cut into chunks of consecutive requests, the chunks are worked on apart, and
their results are combined. A host with a large share of all requests is just more chunks.

The log has ``host``, a time ``t`` in seconds, and an ``id`` that settles ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sightline import vocab
from sightline.session import materialize

CHUNK_BITS = 16


def chunked(log: DataFrame, bits: int = CHUNK_BITS, work: str | None = None) -> DataFrame:
    """The log in order of host and time with a ``chunk`` of at most ``2**bits`` neighbouring requests.

    Written out once, since the numbering depends on how the rows were laid out: to a new scratch folder, or to ``work``, in
    place of what is there.
    """
    order = ["host", "t", "id"]
    laid_out = log.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = laid_out.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), bits))
    if work is None:
        return materialize(rows, "log")
    rows.write.mode("overwrite").parquet(work)
    return log.sparkSession.read.schema(rows.schema).parquet(work)


def rate_grants(
    log: DataFrame, rate: float, bits: int = CHUNK_BITS, last: DataFrame | None = None, work: str | None = None
) -> DataFrame:
    """When each request may go out at ``rate`` requests per second: ``granted`` and ``waited``.

    A request goes out at its own time or one interval after the one before, whichever is later. With
    n requests so far that is the running maximum of ``t - n * interval``, plus ``n * interval``. ``last`` says when a host's last
    request before this log went out (``host, last``).
    """
    if rate <= 0:
        return log.withColumns({"granted": F.col("t"), "waited": F.lit(0.0)})
    step = 1.0 / rate
    rows = chunked(log, bits, work)
    within = Window.partitionBy("host", "chunk").orderBy("t", "id")
    local = rows.withColumn("n", F.row_number().over(within))
    local = local.withColumn("peak", F.max(F.col("t") - F.col("n") * step).over(within))
    per_chunk = local.groupBy("host", "chunk").agg(F.count("*").alias("size"), F.max("peak").alias("peak"))
    before = Window.partitionBy("host").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    offsets = offsets.withColumn("carried", F.max(F.col("peak") - F.col("base") * step).over(before))
    if last is not None:
        # As if the request before this log were one of no number.
        offsets = offsets.join(last.select("host", "last"), "host", "left").withColumn("carried", F.greatest("carried", "last"))
    joined = local.join(offsets.select("host", "chunk", "base", "carried"), ["host", "chunk"])
    granted = F.greatest("carried", F.col("peak") - F.col("base") * step) + (F.col("base") + F.col("n")) * step
    return joined.select(*log.columns, granted.alias("granted")).withColumn("waited", F.col("granted") - F.col("t"))


def request_stats(log: DataFrame) -> DataFrame:
    """Successes, errors and slow successes per host."""
    return log.groupBy("host").agg(
        F.expr("count_if(NOT is_error) AS success_count"),
        F.expr("count_if(is_error) AS error_count"),
        F.expr(f"count_if(NOT is_error AND response_time > {vocab.SLOW_SECONDS}) AS slow_response_count"),
    )


def _combined(steps: DataFrame, keys: list[str], order: str, lowest: float, highest: float) -> DataFrame:
    """Combine consecutive steps ``x -> min(max(factor * x, low), high)`` into one per key.

    Rates stay between ``lowest`` and ``highest``, so a combined step has finite bounds: what it makes of those two. Where
    they meet, the step is a constant and its factor, which may no longer be a number that can be held, is set to 1.
    """
    ordered = f"array_sort(collect_list(struct({order} AS at, factor, low, high)))"
    # The bounds of the next step apply to the bounds so far as they do to the rate itself.
    def bound(b: str) -> str:
        return f"least(greatest(s.factor * {b}, s.low), s.high)"

    start = f"struct(1D AS factor, {lowest}D AS low, {highest}D AS high)"
    factor = f"CASE WHEN {bound('a.low')} >= {bound('a.high')} THEN 1D ELSE a.factor * s.factor END"
    fold = f"aggregate({ordered}, {start}, (a, s) -> struct({factor} AS factor, {bound('a.low')} AS low, {bound('a.high')} AS high))"
    return steps.groupBy(*keys).agg(F.expr(f"{fold} AS step")).select(*keys, "step.*")


def adaptive_rates(
    log: DataFrame,
    initial: float = vocab.INITIAL_RATE,
    lowest: float = vocab.MIN_RATE,
    highest: float = vocab.MAX_RATE,
    bits: int = CHUNK_BITS,
    state: DataFrame | None = None,
    work: str | None = None,
) -> DataFrame:
    """The rate each host of the log ends up with, and its request counts.

    Errors and slow successes slow a host down; every tenth success that is not slow speeds it up. The
    log also has ``response_time`` and ``is_error``. ``state`` is a result for what came before this log.
    """
    rows = chunked(log, bits, work)
    within = Window.partitionBy("host", "chunk").orderBy("t", "id")
    good = F.expr("int(NOT is_error)")
    local = rows.withColumn("successes", F.sum(good).over(within))
    before = Window.partitionBy("host").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = rows.groupBy("host", "chunk").agg(F.sum(good).alias("successes"))
    offsets = per_chunk.select("host", "chunk", F.coalesce(F.sum("successes").over(before), F.lit(0)).alias("base"))
    counts = ("success_count", "error_count", "slow_response_count")
    if state is None:
        known = rows.select("host").where("false").selectExpr("host", "0D AS known_rate", *(f"0L AS known_{name}" for name in counts))
    else:
        known = state.selectExpr("host", "current_rate AS known_rate", *(f"{name} AS known_{name}" for name in counts))
        offsets = offsets.join(known, "host", "left").selectExpr("host", "chunk", "base + coalesce(known_success_count, 0) AS base")
    joined = local.join(offsets, ["host", "chunk"]).withColumn("count", F.expr("base + successes"))
    slower = f"is_error OR response_time > {vocab.SLOW_SECONDS}"
    faster = f"NOT is_error AND count % {vocab.SUCCESSES_PER_SPEEDUP} = 0"
    steps = joined.selectExpr(
        "host", "chunk", "t", "id",
        f"CASE WHEN {slower} THEN {vocab.SLOWDOWN}D WHEN {faster} THEN {vocab.SPEEDUP}D ELSE 1D END AS factor",
        f"CASE WHEN {slower} THEN {lowest}D ELSE double('-Infinity') END AS low",
        f"CASE WHEN NOT ({slower}) AND {faster} THEN {highest}D ELSE double('Infinity') END AS high",
    )
    reach = min(lowest, initial), max(highest, initial)
    by_chunk = _combined(steps.where("factor <> 1"), ["host", "chunk"], "struct(t, id)", *reach)
    # Chunks of chunks, so that no list grows with a host's log.
    place = F.row_number().over(Window.partitionBy("host").orderBy("chunk"))
    grouped = by_chunk.withColumn("part", F.shiftright(place, bits)).withColumn("t", F.col("chunk"))
    by_part = _combined(grouped, ["host", "part"], "t", *reach)
    by_host = _combined(by_part, ["host"], "part", *reach)
    started = f"coalesce(known_rate, {initial}D)"
    rate = f"least(greatest(coalesce(factor, 1D) * {started}, coalesce(low, {reach[0]}D)), coalesce(high, {reach[1]}D))"
    return request_stats(rows).join(by_host, "host", "left").join(known, "host", "left").selectExpr(
        "host", f"{rate} AS current_rate", *(f"{name} + coalesce(known_{name}, 0) AS {name}" for name in counts)
    )


def request_log(events: DataFrame, tick_micros: int) -> DataFrame:
    """An event table as a request log: users as hosts, values as response times.

    Time runs faster: ``tick_micros`` of it make one tick of 1/1024 second, so that sums of times and
    of intervals like half a second are exact.
    """
    micros = "unix_micros(cast(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')"
    return events.selectExpr(
        "user_id AS host", "event_id AS id", f"(({micros}) div {tick_micros}) / 1024D AS t",
        "value / 20 AS response_time", "event_type = 'error' AS is_error",
    )
