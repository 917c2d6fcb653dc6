"""Requests served into a store: log, results, repeats, failures, streams; and sightings whose state ends."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sightline.operators import fixes
from sightline.plans import run_store
from sightline.sources import runs
from sightline.streaming.scan_stream import first_sightings

IMG = '<html lang="en"><head><title>t</title></head><body><main><h1>h</h1><img src="a.png"></main></body></html>'
FINE = '<html lang="en"><head><title>t</title></head><body><main><h1>h</h1></main></body></html>'
BARE = "<p>bare</p>"
REQUEST = "url string, requested_at timestamp, scan_site boolean, max_pages int, exclude_analyzers array<string>"
AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def snapshot(spark):
    linked = FINE.replace("</main>", '<a href="/1">one</a><a href="/2">two</a></main>')
    rows = [(0, "http://a.test/", linked), (1, "http://a.test/1", IMG), (2, "http://a.test/2", BARE), (3, "http://b.test/", ""),
            (4, "http://a.test/1", FINE), (5, "http://b.test/x", IMG)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def state(spark, path):
    return {r.url: r for r in runs.current_runs(run_store.read_events(spark, path)).collect()}


def test_pages_are_served_and_repeats_replace_themselves(spark, snapshot, tmp_path):
    path = str(tmp_path)
    asked = spark.createDataFrame([
        ("http://a.test/1#top", AT, None, None, None), ("http://b.test/x", AT, False, 7, ["alt_text"]), ("http://b.test/", AT, False, None, None),
        ("ftp://a.test/1", AT, False, None, None), ("http://a.test/1#top", AT, False, None, None), ("http://a.test/2", AT, False, None, None),
    ], REQUEST)
    for _ in range(2):
        run_store.serve_requests(snapshot, asked, path, "first")
    found = state(spark, path)
    assert run_store.read_events(spark, path).count() == 12
    assert {u: (r.status, r.pages_scanned, r.error) for u, r in found.items()} == {
        "http://a.test/1#top": ("completed", 1, None), "http://b.test/x": ("completed", 1, None),
        "http://b.test/": ("failed", 0, "page not found"), "http://a.test/2": ("completed", 1, None),
    }
    assert all(AT < r.started_at < r.completed_at for r in found.values())
    assert found["http://b.test/x"].total_issues == sum(
        r.total for r in run_store.read_results(spark, path, found["http://b.test/x"].scan_id).collect())
    bare = run_store.read_results(spark, path, found["http://a.test/2"].scan_id).first()
    assert {i.code for i in bare.issues} >= {"MISSING_LANG", "MISSING_TITLE"} and bare.total == len(bare.issues)
    latest = run_store.read_results(spark, path, found["http://a.test/1#top"].scan_id).first()
    assert "IMG_MISSING_ALT" not in [i.code for i in latest.issues]
    kept = run_store.read_results(spark, path, found["http://b.test/x"].scan_id).first()
    assert "alt_text" not in [i.analyzer for i in kept.issues]
    with pytest.raises(KeyError):
        run_store.read_results(spark, path, "unknown")
    total = {r.scan_id: r for r in run_store.run_summaries(run_store.read_results(spark, path)).collect()}
    assert total[bare.scan_id].total_issues == bare.total == bare.critical + bare.major + bare.minor


def test_many_addresses_need_no_broadcast(spark, snapshot, tmp_path, monkeypatch):
    monkeypatch.setattr(run_store, "broadcastable", lambda df: False)
    asked = spark.createDataFrame([("http://a.test/2", AT)], "url string, requested_at timestamp")
    run_store.serve_requests(snapshot, asked, str(tmp_path))
    assert [(u, r.status) for u, r in state(spark, str(tmp_path)).items()] == [("http://a.test/2", "completed")]


def test_a_failing_job_is_logged_and_its_repeat_forgets_it(spark, snapshot, tmp_path):
    path, asked = str(tmp_path), spark.createDataFrame([("http://a.test/2", AT)], "url string, requested_at timestamp")
    broken = snapshot.withColumn("html", F.expr("raise_error('no disk')").cast("string"))
    with pytest.raises(Exception, match="no disk"):
        run_store.serve_requests(broken, asked, path, "x")
    failed = state(spark, path)["http://a.test/2"]
    assert failed.status == "failed" and "no disk" in failed.error and failed.completed_at > failed.started_at
    run_store.serve_requests(snapshot, asked, path, "x")
    done = state(spark, path)["http://a.test/2"]
    assert (done.status, done.error, done.pages_scanned) == ("completed", None, 1)


def test_no_requests_leave_an_empty_store(spark, snapshot, tmp_path):
    run_store.serve_requests(snapshot, spark.createDataFrame([], REQUEST), str(tmp_path))
    assert run_store.read_events(spark, str(tmp_path)).count() == 0
    assert run_store.read_results(spark, str(tmp_path)).count() == 0


def test_a_stream_of_site_requests(spark, snapshot, tmp_path):
    path, schema = str(tmp_path), "url string, requested_at timestamp, scan_site boolean, max_pages int"
    for k, row in enumerate([("http://a.test/", AT, True, 2), ("http://a.test/", AT.replace(year=2025), True, None)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    served = run_store.serve_stream(snapshot, stream, f"{path}/store", f"{path}/state")
    served.awaitTermination()
    assert served.exception() is None
    found = runs.current_runs(run_store.read_events(spark, f"{path}/store")).collect()
    assert sorted((r.status, r.pages_scanned) for r in found) == [("completed", 2), ("completed", 3)]
    pages = {r.scan_id: [x.url for x in run_store.read_results(spark, f"{path}/store", r.scan_id).orderBy("rank").collect()] for r in found}
    assert sorted(pages.values(), key=len)[1] == ["http://a.test/", "http://a.test/1", "http://a.test/2"]


def test_sightings_forget_and_their_state_stays_small(spark, tmp_path):
    path, schema = str(tmp_path), "url string, ts timestamp"
    for day in range(1, 21):
        rows = [(f"u{day}", datetime(2024, 1, day)), ("daily", datetime(2024, 1, day, 1))]
        if day == 12:
            rows.append(("late", datetime(2024, 1, 2)))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    running = (
        first_sightings(stream, "ts", "2 days").writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    seen = [r.url for r in spark.read.parquet(f"{path}/out").collect()]
    assert all(seen.count(f"u{day}") == 1 for day in range(1, 21))
    assert 2 <= seen.count("daily") < 20 and "late" not in seen
    states = [p.stateOperators[0] for p in running.recentProgress if p.stateOperators]
    assert max(s.numRowsTotal for s in states) <= 8 and sum(s.numRowsDroppedByWatermark for s in states) == 1


def test_a_prompt_has_room_for_the_first_pages_of_a_site(spark):
    rows = [(k, "s" if k % 2 else "t", f"http://s.test/{k}") for k in range(6000)] + [(None, "t", None), (6000, None, "http://x/"), (7, "u", "")]
    made = {r.site: r.prompt for r in fixes.site_prompts(spark.createDataFrame(rows, "page_id long, site string, url string")).collect()}
    assert set(made) == {"s", "t", None}
    listed = "\n".join(f"http://s.test/{k}" for k in range(1, 6000, 2))[:4000]
    assert made["s"].endswith("Found issues: []\n\nHTML snippet (truncated):\n" + listed)


def test_pages_that_no_request_names_are_not_parsed(spark, pages_of, monkeypatch):
    parsed, scan = [], run_store.scan_pages
    monkeypatch.setattr(run_store, "broadcastable", lambda *_: False)
    monkeypatch.setattr(run_store, "scan_pages", lambda pages, **options: parsed.append(pages.count()) or scan(pages, **options))
    wanted = spark.createDataFrame([("r", "http://a.test/1", [])], "scan_id string, url string, exclude_analyzers array<string>")
    rows = run_store._page_results(pages_of("<p>a", "<p>b", "<p>c"), wanted, None).collect()
    assert parsed == [1] and [r.url for r in rows] == ["http://a.test/1"]
