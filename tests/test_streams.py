"""Streams with state: order, repeats, restarts, expiry."""

import datetime as dt
import os

from pyspark.sql import functions as F

from leafmark.streaming import jobs, state

T0 = dt.datetime(2024, 1, 1)
EVENTS = "job_id bigint, seq bigint, at timestamp, type string, status string"


def _events(*rows):
    return [(j, s, T0 + dt.timedelta(minutes=m), t, x) for j, s, m, t, x in rows]


def _run(spark, tmp_path, name, schema, batches, stream):
    """Each batch is a file and a run of its own: the stream is started again for each."""
    folder, out, point = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "point"))
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        with state.stores(spark):
            got = jobs.run_available(stream(spark.readStream.schema(schema).parquet(folder)), out, point)
        seen.append(got.collect())
    return seen


def test_job_states(spark, tmp_path):
    batches = [
        _events((1, 3, 3, "log", None), (1, 1, 1, "status", "running"), (1, 2, 2, "status", "running"), (2, 4, 4, "artifact", None)),
        _events((1, 2, 2, "status", "error"), (1, 6, 6, "done", None), (1, 5, 5, "status", "done"), (2, 7, 7, "error", None), (2, 8, 8, "error", None)),  # 2 is late
        _events((1, 6, 6, "done", None), (1, 9, 9, "status", "running"), (2, 10, 10, "done", None), (2, 10, 10, "done", None)),
    ]
    seen = _run(spark, tmp_path, "jobs", EVENTS, batches, state.job_states)
    told = [sorted((r.job_id, r.seq, r.type, r.status) for r in s) for s in seen]
    first = [(1, 1, "status", "running")]
    second = [*first, (1, 5, "status", "done"), (1, 6, "done", "done"), (2, 7, "error", "error")]
    assert told == [first, second, [*second, (2, 10, "done", "error")]]


def test_finished_jobs_are_forgotten(spark, tmp_path):
    day = 24 * 60
    batches = [
        _events((1, 1, 0, "status", "running"), (1, 2, 1, "done", None)),
        _events((1, 3, 60, "status", "running")),  # not yet forgotten
        _events((2, 4, 3 * day, "log", None)),
        _events((1, 5, 3 * day, "status", "running")),  # a new job of that number
    ]
    seen = _run(spark, tmp_path, "old", EVENTS, batches, state.job_states)
    assert [len(s) for s in seen] == [2, 2, 2, 3]


def test_page_counters(spark, tmp_path):
    import random

    rnd = random.Random(1)
    rows = [(rnd.randint(1, 3), i, T0 + dt.timedelta(seconds=i), f"p{rnd.randint(1, 6)}", rnd.random() < 0.5) for i in range(120)]
    batches = [rnd.sample(rows[a : a + 40], 40) + rows[max(0, a - 5) : a] for a in (0, 40, 80)]  # out of order within a batch, some repeated
    seen = _run(spark, tmp_path, "pages", "job_id bigint, seq bigint, at timestamp, page string, valid boolean", batches, state.page_counters)
    want, pages = [], {}
    for job, seq, _, page, valid in rows:
        if pages.get((job, page)) != valid:
            pages[job, page] = valid
            mine = [v for (j, _), v in pages.items() if j == job]
            want.append((job, seq, page, sum(mine), len(mine) - sum(mine)))
    assert sorted(tuple(r) for r in seen[-1]) == sorted(want)


def test_watcher(spark, tmp_path):
    root = tmp_path / "job"
    for name in ("a.png", "sub/b.JPG", "input/c.png", "sub/input/d.tif", "e.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"1")
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    scans, out, point = (str(tmp_path / x) for x in ("scans", "out", "point"))

    def changes(number):
        state.watch(spark, str(root), scans, out, point, number)
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out).where(f"scan = {number}").collect())

    assert changes(1) == ["a.png", "b.JPG"]
    assert changes(2) == []
    (root / "a.png").write_bytes(b"12")  # rewritten, other size and time
    os.utime(root / "sub/b.JPG", (1_700_000_100, 1_700_000_100))  # touched
    (root / "new.tiff").write_bytes(b"x")
    assert changes(3) == ["a.png", "b.JPG", "new.tiff"]
    (root / "new.tiff").unlink()
    assert changes(4) == []
    os.utime(root / "a.png", (1_700_000_000, 1_700_000_000))  # back to an older time is a change too
    assert changes(5) == ["a.png"]
    assert spark.read.parquet(out).count() == 6


def test_reported_sums(spark, tmp_path):
    folder = str(tmp_path / "in")
    for k in range(5):
        spark.createDataFrame([(i, i % 3 == 0) for i in range(10 * k, 10 * k + 10)], "n int, bad boolean").coalesce(1).write.mode("append").parquet(folder)
    seen = []
    sums = {"pages": F.count(F.lit(1)), "errors": F.count_if("bad"), "total": F.sum("n")}
    jobs.reported_sums(jobs.event_stream(spark, folder, 1), sums, str(tmp_path / "sums"), lambda t: seen.append(t.first().asDict()), str(tmp_path / "point"), every=2)
    assert [s["pages"] for s in seen] == [20, 40, 50] and seen[-1] == {"pages": 50, "errors": 17, "total": 1225}


def test_page_counters_ask_the_stores_once_for_a_batch():
    """Each call of a store is a message to the JVM: a batch of events costs as many as its pages, not as its events."""
    import datetime
    from types import SimpleNamespace

    from leafmark.streaming import state as streaming

    calls, held = [], {}
    of = streaming._Pages(1000)
    of.pages = SimpleNamespace(iterator=lambda: (calls.append("all"), iter([((k,), v) for k, v in held.items()]))[1], updateValue=lambda k, v: (calls.append("one"), held.update({k[0]: v})))
    of.counts = SimpleNamespace(exists=lambda: False, update=lambda v: held.setdefault("counts", v))
    of.seen = lambda at: None
    at = datetime.datetime(2024, 1, 1)
    out = list(of.handleInputRows((7,), iter([SimpleNamespace(seq=i, at=at, page="a", valid=i % 2 == 0) for i in range(100)]), None))
    assert len(out) == 100 and (out[-1].valid, out[-1].not_valid) == (0, 1)
    assert calls == ["one"] and held == {"a": (99, False), "counts": (0, 1)}
