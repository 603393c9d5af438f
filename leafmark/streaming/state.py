"""Streams with keyed state of their own: the states of jobs, running counters of pages, and changes of files.

Processors of `transformWithState`: state lives in RocksDB stores (`stores` sets the provider while a stream starts) and comes back
from the checkpoint after a restart. A key's rows of one micro-batch are put in order of their number before they are applied; a row
whose number is not higher than the last one applied is late or repeated and changes nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leafmark.streaming import jobs

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HOUR = 3_600_000


@contextlib.contextmanager
def stores(spark: SparkSession):
    """State stores with timers and maps, for streams that start inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Expiring(StatefulProcessor):
    """Drops all state of a key when the watermark is keep_ms beyond the key's last row."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def expect(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.timer = handle, handle.getValueState("timer", "at bigint")

    def seen(self, at) -> None:
        if self.timer.exists():
            (old,) = self.timer.get()
            if old >= int(at.timestamp() * 1000) + self.keep_ms:
                return
            self.handle.deleteTimer(old)
        self.timer.update((int(at.timestamp() * 1000) + self.keep_ms,))
        self.handle.registerTimer(int(at.timestamp() * 1000) + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.timer.clear()
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Jobs(_Expiring):
    """queued, running, done or error. Rows: job_id, seq, at, type, status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expect(handle)
        self.state = handle.getValueState("job", "seq bigint, status string, ended boolean")
        self.states = (self.state,)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seq, status, ended = tuple(self.state.get()) if self.state.exists() else (None, "queued", False)
        last = None
        for r in sorted(rows, key=lambda r: r.seq):
            if ended or (seq is not None and r.seq <= seq):
                continue
            seq, last = r.seq, r.at if last is None else max(last, r.at)
            if r.type == "status" and r.status != status:
                status = r.status
                yield Row(job_id=key[0], seq=seq, type="status", status=status)
            elif r.type == "error" and status != "error":
                status = "error"
                yield Row(job_id=key[0], seq=seq, type="error", status=status)
            elif r.type == "done":
                ended = True
                yield Row(job_id=key[0], seq=seq, type="done", status=status if status == "error" else "done")
        if last is not None:
            self.seen(last)
        self.state.update((seq, status, ended))


def job_states(events: DataFrame, late: str = "1 hour", keep_ms: int = 24 * HOUR) -> DataFrame:
    """The changes of each job (job_id, seq, type, status) out of its events (job_id, seq, at, type, status): each new status once, the
    error that turns it, and done once and last; the job's events after that are dropped. State is dropped when the watermark is keep_ms
    beyond the job's last event, so a finished or silent job costs nothing for ever."""
    keyed = events.select("job_id", "seq", "at", "type", "status").withWatermark("at", late).groupBy("job_id")
    return keyed.transformWithState(_Jobs(keep_ms), "job_id bigint, seq bigint, type string, status string", "append", "EventTime")


class _Pages(_Expiring):
    """The last state of each page of a job, and how many are valid and not. Rows: job_id, seq, at, page, valid."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expect(handle)
        self.pages = handle.getMapState("pages", "page string", "seq bigint, valid boolean")
        self.counts = handle.getValueState("counts", "valid bigint, not_valid bigint")
        self.states = (self.pages, self.counts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts = list(self.counts.get()) if self.counts.exists() else [0, 0]
        # a job's pages are few beside its events: the stores are asked once for all of them, and told once what has changed
        held = {page: tuple(state) for (page,), state in self.pages.iterator()} if self.counts.exists() else {}
        changed, last = set(), None
        for r in sorted(rows, key=lambda r: r.seq):
            old = held.get(r.page)
            if old is not None and r.seq <= old[0]:
                continue
            last = r.at if last is None else max(last, r.at)
            held[r.page] = (r.seq, r.valid)
            changed.add(r.page)
            if old is not None and old[1] == r.valid:
                continue
            counts[0 if r.valid else 1] += 1
            if old is not None:
                counts[0 if old[1] else 1] -= 1
            yield Row(job_id=key[0], seq=r.seq, page=r.page, valid=counts[0], not_valid=counts[1])
        for page in sorted(changed):
            self.pages.updateValue((page,), held[page])
        if last is not None:
            self.seen(last)
            self.counts.update(tuple(counts))


def page_counters(events: DataFrame, late: str = "1 hour", keep_ms: int = 24 * HOUR) -> DataFrame:
    """The counters of each job at every event (job_id, seq, at, page, valid) that changes a page's state: job_id, seq, page, and valid and
    not_valid after it. A job's pages are forgotten when the watermark is keep_ms beyond its last event."""
    out = "job_id bigint, seq bigint, page string, valid bigint, not_valid bigint"
    keyed = events.select("job_id", "seq", "at", "page", "valid").withWatermark("at", late).groupBy("job_id")
    return keyed.transformWithState(_Pages(keep_ms), out, "append", "EventTime")


class _Files(_Expiring):
    """Size and time of each path at its last scan. Rows: path, scan, at, size, modified."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expect(handle)
        self.last = handle.getValueState("file", "scan bigint, size bigint, modified_ms bigint")
        self.states = (self.last,)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.last.get()) if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r.scan):
            if held is not None and r.scan <= held[0]:
                continue
            marks = (r.size, round(r.modified.timestamp() * 1000))
            if held is None or held[1:] != marks:
                yield Row(path=key[0], scan=r.scan, size=r.size, modified=r.modified)
            held = (r.scan, *marks)
            self.seen(r.at)
        if held is not None:
            self.last.update(held)


#: Files that are artifacts, and folders whose files are not (fixed values).
SUFFIXES, EXCLUDED = (".png", ".jpg", ".jpeg", ".tif", ".tiff"), ("input",)


SCAN = "path string, scan bigint, at timestamp, size bigint, modified timestamp"


def scan(spark: SparkSession, root: str, scans: str, number: int) -> None:
    """Adds the present files below root to the table of scans: one more part, written whole or not at all."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.split(F.substring_index("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1), "/")
    folders = F.slice(below, 1, F.size(below) - 1)
    image = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0)).isin(*SUFFIXES)
    kept = files.where(image & ~F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED))))
    at = {"scan": F.lit(number).cast("bigint"), "at": F.current_timestamp(), "size": F.col("length"), "modified": F.col("modificationTime")}
    kept.select("path", *(v.alias(k) for k, v in at.items())).write.mode("append").parquet(scans)


def file_changes(scans: DataFrame, late: str = "1 minute", keep_ms: int = 24 * HOUR) -> DataFrame:
    """The files (path, scan, size, modified) whose size or time differs from the scan before, and new ones; a path that no scan has shown for
    keep_ms is forgotten, and new when it comes back."""
    return scans.withWatermark("at", late).groupBy("path").transformWithState(_Files(keep_ms), "path string, scan bigint, size bigint, modified timestamp", "append", "EventTime")


def watch(spark: SparkSession, root: str, scans: str, out: str, checkpoint: str, number: int) -> None:
    """One round of the watcher: scans the files below root and appends their changes to the table out. Call it again as often as wanted,
    with rising numbers, and once more after the job's end."""
    scan(spark, root, scans, number)
    with stores(spark):
        jobs.run_available(file_changes(spark.readStream.schema(SCAN).parquet(scans)), out, checkpoint)
