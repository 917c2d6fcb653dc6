"""History, runs, request rates, and the streaming jobs."""

import random
from datetime import datetime, timedelta

import pytest

from sightline.operators import limiter as L
from sightline.plans.scan import scan_pages
from sightline.session import scratch_root
from sightline.sources import history as H, pages as S, runs as U
from sightline.streaming import limiter_stream as LS, scan_stream as SS

PAGE = "<html lang=en><title>t</title><main><h1>h</h1>{}</main>"


def test_history(spark, pages_of, tmp_path):
    path = str(tmp_path / "scans")
    H.init_scan_store(spark, path)
    H.init_scan_store(spark, path)
    assert H.read_scan_history(spark, path).count() == 0
    for ts, site in ((10, "http://a.test"), (20, "http://b.test"), (30, "http://a.test")):
        scanned = scan_pages(pages_of(PAGE.format("<img>"), PAGE.format("é"), site=site))
        H.append_scan_results(H.scan_results(scanned, ts), path)
    H.init_scan_store(spark, path)
    rows = H.read_scan_history(spark, path).collect()
    assert [r.ts for r in rows] == [30, 30, 20, 20, 10, 10]
    own = H.read_scan_history(spark, path, "a.test")
    assert [(r.url, r.ts, [i.code for i in r.issues]) for r in own.collect()][0] == ("http://a.test/0", 30, ["IMG_MISSING_ALT"])
    assert own.where("url = 'http://a.test/1'").first().issues == []
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan  # a site is read from its bucket alone


def test_runs(spark, tmp_path):
    base = datetime(2024, 1, 1)

    def event(run, minute, status, **fields):
        names = ("url", "pages_scanned", "total_issues", "started_at", "completed_at", "error")
        return (run, base + timedelta(minutes=minute), status, *[fields.get(n) for n in names])

    log = [
        event("r1", 0, "pending", url="http://a"), event("r1", 1, "running", started_at=base + timedelta(minutes=1)),
        event("r1", 2, "running", pages_scanned=3), event("r1", 9, "completed", pages_scanned=5, total_issues=7),
        event("r2", 3, "pending", url="http://b"), event("r2", 4, "running", started_at=base + timedelta(minutes=4)),
        event("r2", 5, "failed", error="boom"), event("r3", 6, "pending", url="http://c"),
    ]
    path = str(tmp_path / "runs")
    U.append_events(spark.createDataFrame(log, U.EVENTS), path)
    events = spark.read.parquet(path)
    runs = {r.scan_id: r for r in U.current_runs(events).collect()}
    assert (runs["r1"].status, runs["r1"].pages_scanned, runs["r1"].total_issues, runs["r1"].url) == ("completed", 5, 7, "http://a")
    assert (runs["r2"].status, runs["r2"].error, runs["r2"].pages_scanned) == ("failed", "boom", 0)
    assert [r.scan_id for r in U.recent_runs(events).collect()] == ["r2", "r1", "r3"]
    assert [r.scan_id for r in U.recent_runs(events, 1).collect()] == ["r2"]
    U.append_events(U.deletion(events, "r2"), path)
    events = spark.read.parquet(path)
    assert {r.scan_id for r in U.current_runs(events).collect()} == {"r1", "r3"}
    with pytest.raises(KeyError):
        U.get_run(events, "r2")
    with pytest.raises(KeyError):
        U.deletion(events, "nope")
    assert U.get_run(events, "r1").first().status == "completed"


def test_fetch_outcomes(spark):
    log = [(200, None, 1), (404, None, 1), (429, None, 1), (500, None, 3), (None, "timeout", 2), (None, "timeout", 3),
           (None, "tls", 1), (301, None, 1)]
    frame = spark.createDataFrame(log, "status int, error string, attempt int")
    got = [r.outcome for r in S.fetch_outcomes(frame, 3).collect()]
    assert got == ["ok", "empty", "failed", "failed", "retry", "failed", "failed", "failed"]


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é\r\nx</p>", encoding="utf-8")
    (tmp_path / "b.html").write_text("", encoding="utf-8")
    rows = {r.url.rsplit("/", 1)[1]: r.html for r in S.read_html_files(spark, str(tmp_path / "*.html")).collect()}
    assert rows["a.html"] == "<p>é\r\nx</p>"


# -- request rates -----------------------------------------------------------------------------------


def make_log(spark, seed, hosts=4, size=300):
    random.seed(seed)
    # One host has most requests, some at the same time.
    rows = [
        (0 if random.random() < 0.6 else random.randrange(hosts), i, round(random.random() * 60, 1), random.random() * 10,
         random.random() < 0.1)
        for i in range(size)
    ]
    return rows, spark.createDataFrame(rows, "host long, id long, t double, response_time double, is_error boolean")


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_rate_grants_agree_with_one_request_at_a_time(spark, bits):
    rows, log = make_log(spark, bits)
    last, want = {}, {}
    for host, i, t, *_ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[host] = t if host not in last else max(t, last[host] + 0.25)
        want[i] = last[host]
    got = {r.id: r.granted for r in L.rate_grants(log, 4.0, bits).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_no_limit(spark):
    rows, log = make_log(spark, 5, size=20)
    assert all(r.waited == 0 and r.granted == r.t for r in L.rate_grants(log, 0).collect())


def adaptive(rows):
    state = {}
    for host, i, t, seconds, is_error in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        rate, good, bad, slow = state.get(host, (2.0, 0, 0, 0))
        if is_error:
            bad, rate = bad + 1, max(rate * 0.8, 0.1)
        else:
            good += 1
            if seconds > 5:
                slow, rate = slow + 1, max(rate * 0.8, 0.1)
            elif good % 10 == 0:
                rate = min(rate * 1.1, 10.0)
        state[host] = (rate, good, bad, slow)
    return state


@pytest.mark.parametrize("bits,scale", [(1, 1.0), (2, 0.51), (16, 1.0), (3, 0.3)])
def test_adaptive_rates_agree_with_one_request_at_a_time(spark, bits, scale):
    rows, log = make_log(spark, 10 + bits)
    rows = [(h, i, t, s * scale, e and scale > 0.4) for h, i, t, s, e in rows]
    log = spark.createDataFrame(rows, log.schema)
    want = adaptive(rows)
    got = {r.host: tuple(r)[1:] for r in L.adaptive_rates(log, bits=bits).collect()}
    assert got.keys() == want.keys()
    for host, (rate, *counts) in want.items():
        assert abs(got[host][0] - rate) < 1e-9 and list(got[host][1:]) == counts


@pytest.mark.parametrize("bits", [1, 10, 16])
def test_rates_hold_their_bounds_over_many_chunks(spark, bits):
    from pyspark.sql import functions as F

    size = 150_000 if bits > 1 else 3_000
    schema = "host long, id long, t double, response_time double, is_error boolean"
    errors = spark.range(size).select(
        F.lit(1).cast("long").alias("host"), "id", F.col("id").cast("double").alias("t"), F.lit(0.1).alias("response_time"),
        F.lit(True).alias("is_error"),
    )
    good = [(1, size + k, float(size + k), 0.1, False) for k in range(10)]
    steady = [(2, k, float(k), 0.1, False) for k in range(4000)] + [(2, 4000 + k, 4000.0 + k, 0.1, True) for k in range(3)]
    last = L.adaptive_rates(errors, bits=bits).first().current_rate
    assert abs(last - 0.1) < 1e-12
    log = errors.unionByName(spark.createDataFrame(good + steady, schema))
    got = {r.host: r.current_rate for r in L.adaptive_rates(log, bits=bits).collect()}
    assert abs(got[1] - 0.11) < 1e-12 and abs(got[2] - 10 * 0.8**3) < 1e-9
    outside = {r.host: r.current_rate for r in L.adaptive_rates(log, initial=20.0, bits=bits).where("host = 2").collect()}
    assert abs(outside[2] - 10 * 0.8**3) < 1e-9


def test_stats_of_a_short_log(spark):
    rows = [(1, 0, 0.0, 0.1, False), (1, 1, 1.0, 6.0, False), (1, 2, 2.0, 0.0, True)]
    log = spark.createDataFrame(rows, "host long, id long, t double, response_time double, is_error boolean")
    row = L.adaptive_rates(log).first()
    assert tuple(row)[2:] == (2, 1, 1) and abs(row.current_rate - 2 * 0.64) < 1e-12


# -- streams -------------------------------------------------------------------------------------------


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_scan_stream_takes_each_page_once_over_restarts(spark, pages_of, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for n in range(3):
        pages_of(PAGE.format("<img>" * n), site=f"http://s{n}.test").write.mode("append").parquet(source)
        run(SS.stream_history(SS.stream_pages(spark, source), out, state, ts=n))
    rows = H.read_scan_history(spark, out).collect()
    assert [(r.site, r.ts, len(r.issues)) for r in rows] == [("s2.test", 2, 2), ("s1.test", 1, 1), ("s0.test", 0, 0)]


def test_batches_and_streams_share_a_store(spark, pages_of, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    rows = lambda ts, site: H.scan_results(scan_pages(pages_of(PAGE.format("<img>"), site=site)), ts)
    H.append_scan_results(rows(1, "http://a.test"), out, "first")
    H.append_scan_results(rows(1, "http://a.test"), out, "first")
    pages_of(PAGE.format("<img>"), PAGE.format(""), site="http://b.test").write.parquet(source)
    run(SS.stream_history(SS.stream_pages(spark, source), out, state, ts=2))
    H.append_scan_results(rows(3, "http://a.test"), out)
    assert [(r.site, r.ts) for r in H.read_scan_history(spark, out).collect()] == [
        ("a.test", 3), ("b.test", 2), ("b.test", 2), ("a.test", 1),
    ]
    assert H.read_scan_history(spark, out, "b.test").count() == 2


def test_deleted_runs_stay_deleted(spark):
    from datetime import datetime

    from sightline.sources import runs

    def event(at, status, url=None):
        return ("x", datetime(2024, 1, 1, 0, 0, at), status, url, None, None, None, None, None)

    made = spark.createDataFrame([event(1, "pending", "u"), event(1, "running"), event(2, "completed")], runs.EVENTS)
    assert runs.get_run(made, "x").first().status == "completed"
    assert runs.current_runs(made.where("status <> 'completed'")).first().status == "running"
    gone = made.unionByName(runs.deletion(made, "x")).unionByName(spark.createDataFrame([event(50, "completed", "v")], runs.EVENTS))
    assert runs.current_runs(gone).collect() == [] and runs.recent_runs(gone).collect() == []


def test_counts_stream_accumulates(spark, pages_of, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for n in (1, 2):
        pages_of(PAGE.format("<img>" * n), PAGE.format("")).write.mode("append").parquet(source)
        run(LS.write_updates(SS.running_severity_counts(SS.stream_pages(spark, source)), f"{out}/run={n}", state))
    row = LS.latest_updates(spark, f"{out}/run=2", "site").first()
    assert (row.pages, row.issues, row.critical) == (4, 3, 3)


def test_first_sightings_within_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("u1", datetime(2024, 1, 1, 0, m)) for m in (0, 5)] + [("u2", datetime(2024, 1, 1, 0, 1))]
    spark.createDataFrame(rows, "url string, seen timestamp").write.parquet(source)
    stream = spark.readStream.schema("url string, seen timestamp").parquet(source)
    query = SS.first_sightings(stream, "seen").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run(query)
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


def test_limiter_streams_remember_hosts_between_batches(spark, tmp_path):
    rows, log = make_log(spark, 21, size=300)
    # One host has more than a third of all requests and spans many chunks of every micro-batch.
    rows = sorted(((1 if r[1] % 2 else r[0], *r[1:]) for r in rows), key=lambda r: r[2])
    log = spark.createDataFrame(rows, log.schema)
    source, grants, rates = (str(tmp_path / name) for name in ("in", "grants", "rates"))
    for part in (rows[:10], rows[10:150], rows[150:151], rows[151:]):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(source)
    for again in range(2):
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
        run(LS.write_rate_grants(stream.select("host", "id", "t"), 4.0, grants, str(tmp_path / "g"), bits=3))
        run(LS.write_adaptive_rates(stream, rates, str(tmp_path / "r"), bits=3))
    batch = {r.id: r.granted for r in L.rate_grants(log, 4.0).collect()}
    live = {r.id: r.granted for r in LS.read_grants(spark, grants).collect()}
    assert live.keys() == batch.keys() and all(abs(live[i] - batch[i]) < 1e-9 for i in batch)
    want = adaptive(rows)
    got = {r.host: r for r in LS.current_rates(spark, rates).collect()}
    assert got.keys() == want.keys() and spark.read.parquet(f"{rates}/state").select("batch").distinct().count() == 2
    for host, (rate, *counts) in want.items():
        row = got[host]
        assert abs(row.current_rate - rate) < 1e-9
        assert [row.success_count, row.error_count, row.slow_response_count] == list(counts)


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    rows, log = make_log(spark, 22, size=90)
    rows.sort(key=lambda r: r[2])
    parts = [spark.createDataFrame(p, log.schema) for p in (rows[:40], rows[40:41], rows[41:])]
    grant, rate = LS.grant_step(4.0, str(tmp_path / "g"), bits=2), LS.rate_step(2.0, 0.1, 10.0, str(tmp_path / "r"), bits=2)
    for number, part in enumerate(parts):
        for _ in range(2):
            grant(part.select("host", "id", "t"), number)
            rate(part, number)
    empty = parts[0].where("false")
    grant(empty.select("host", "id", "t"), 3)
    rate(empty, 3)
    batch = {r.id: r.granted for r in L.rate_grants(log, 4.0).collect()}
    assert all(abs(r.granted - batch[r.id]) < 1e-9 for r in LS.read_grants(spark, str(tmp_path / "g")).collect())
    want = adaptive(rows)
    for row in LS.current_rates(spark, str(tmp_path / "r")).collect():
        assert abs(row.current_rate - want[row.host][0]) < 1e-9 and row.error_count == want[row.host][2]


def test_scratch_folder_is_the_session_setting(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_root(spark) == (before or spark.conf.get("spark.checkpoint.dir"))

