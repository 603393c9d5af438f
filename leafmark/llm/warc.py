"""WARC archives and an external merge of their indexes.

`write_archives` stores one gzip member per page in .warc.gz files of the shared folder (real WARC 1.1 records:
response with an HTTP block, or revisit by identical payload digest). `read_archives` streams the files back,
checks the payload digests and emits for each archive a run of captures sorted locally by URL key,
timestamp and page id. `merge_runs` deals the runs' rows into key ranges; in each range Spark sorts by run and place (spilling
to disk), so that the pieces of the runs arrive whole and in their own order, and a k-way loser tree
merges them. The merged index is written with range and rank; the sums of the ranges before turn these into the place of each
capture in the globally ordered capture histories. A hot URL is cut by timestamp and page id like any other range.

Records are written once: the manifest of archives is a table that Spark commits, files of failed attempts
are not in it. Tasks hold one record and the index rows of one archive (`archive_bytes` at most) at a time.

Of pages with equal payloads of at least `least_bytes` bytes, the one with the largest page id is the response and
the others revisit it. Edge cases: null html is the empty payload; a null url gives no target URI and the empty URL
key; rows that repeat a page id are records of their own, and if it is the largest of its payload all
of them are responses; a null page id is a response; an empty table gives an empty index; extra columns are ignored, whatever
their names. Captures with equal URL key, time and page id keep the order of their archives. Times are `EPOCH` plus the page id,
unless a column of seconds is named (`captured`): the pages table has none. A payload is held as a whole, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import column, scratch_path, table, written

LEAST_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
#: Index rows that a merging task holds, on average.
RANGE_ROWS = 200_000
EPOCH = 1_700_000_000
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The URL's sort-friendly key: host labels reversed, then the path and query; no scheme, user, fragment."""
    if not url:
        return ""
    try:
        at = urlsplit(url.strip())
        host, port = (at.hostname or "").rstrip("."), at.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + (at.path or "/").lower() + (f"?{at.query.lower()}" if at.query else "")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page/{page_id}')}>"


def _date(seconds: int) -> str:
    return str(np.datetime64(seconds, "s")) + "Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, seconds: int) -> bytes:
    """One WARC record; refers_to makes it a revisit, without the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_date(seconds)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the payload of a record; raises if a response's payload does not fit its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record is cut")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"][5:]:
        raise ValueError("payload does not fit its digest")
    return fields, payload


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member."""
    at, held, chunk = 0, b"", b""
    while True:
        chunk = held or stream.read(1 << 20)
        if not chunk:
            return
        unzip, parts, size, held = zlib.decompressobj(31), [], 0, b""
        while True:
            parts.append(unzip.decompress(chunk))
            size += len(chunk) - len(unzip.unused_data)
            if unzip.eof:
                held = unzip.unused_data
                break
            chunk = stream.read(1 << 20)
            if not chunk:
                raise ValueError("archive is cut")
        yield at, size, b"".join(parts)
        at += size


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.head = [(False, r[0]) if r else (True,) for r in runs] or [(True,)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _play(self, winner: int) -> None:
        """Sends a leaf up; where no opponent has come yet, it waits."""
        node, head = (winner + self.k) // 2, self.head
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if (head[other], other) < (head[winner], winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while len(self.head[self.tree[0]]) == 2:
            i = self.tree[0]
            yield self.head[i][1]
            self.at[i] += 1
            self.head[i] = (False, self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else (True,)
            self._play(i)


def with_record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES, captured: str | None = None) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) and seconds."""
    seconds = F.col(captured).cast("bigint") if captured else F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)) + EPOCH
    raw = pages.select(seconds.alias("seconds"), F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # digests are taken below the joins, once for each side; the grouped side reads the html column alone
    keyed = raw.withColumn("digest", F.sha1("payload"))
    heads = (
        keyed.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.col("digest").alias("head_digest"))
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("head_digest", "head")
    )
    joined = keyed.join(heads, F.col("digest") == F.col("head_digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to"), "seconds")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Writes the records; returns the manifest (archive, n_records, n_bytes), committed as a table."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        done, stream, name, size, n = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to, seconds in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "seconds"))):
                zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = zipped.compress(record(page_id, url, payload, digest, refers_to, seconds or 0)) + zipped.flush()
                if stream is None or size + len(member) > archive_bytes:
                    if stream is not None:
                        stream.close()
                        done.append((name, n, size))
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    stream, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                stream.write(member)
                size += len(member)
                n += 1
        if stream is not None:
            stream.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return written(records.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"), "warc-manifest")


_RUN = "run string, pos bigint, url_key string, seconds bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, offset bigint, length bigint"


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures of the archives, one locally sorted run for each."""
    n = manifest.count()

    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for name in column(batch, "archive").to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, raw in members(stream):
                        f, _ = parse(raw)
                        page, refers = f.get("X-Page-Id"), f.get("X-Refers-To-Page")
                        seconds = int(np.datetime64(f["WARC-Date"][:-1], "s").astype(np.int64))
                        rows.append((url_key(f.get("WARC-Target-URI")), seconds, int(page) if page else None, int(f["X-Payload-Length"]), base64.b32decode(f["WARC-Payload-Digest"][5:]).hex(), f["WARC-Type"], int(refers) if refers else None, offset, length))
                rows.sort(key=_order)
                cols = [[name] * len(rows), list(range(len(rows))), *([r[i] for r in rows] for i in range(9))]
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _RUN.split(", ")])

    return written(manifest.select("archive").repartition(max(1, min(n, 10_000))).mapInArrow(run, _RUN), "warc-runs")


def _order(row) -> tuple:
    """URL key (as Spark orders strings, by its UTF-8 bytes), timestamp, page id; nulls first."""
    return row[0].encode(), row[1], -1 if row[2] is None else row[2], row[7]


def merge_runs(runs: DataFrame) -> DataFrame:
    """The written rows of the runs in global order: range, rank in it as the loser tree yields them, and capture_order, the
    place among all captures, from 1."""

    def run(batches):
        from pyspark import TaskContext

        pieces: list[pa.RecordBatch] = []
        cuts, keys, name = [0], [], None
        for batch in batches:  # in order of run and place
            if not batch.num_rows:
                continue
            pieces.append(batch)
            for own, *key in zip(*(column(batch, c).to_pylist() for c in ("run", "url_key", "seconds", "page_id"))):
                if own != name and keys:
                    cuts.append(len(keys))
                name = own
                keys.append((key[0].encode(), key[1], -1 if key[2] is None else key[2], len(keys)))
        if not keys:
            return
        cuts.append(len(keys))
        order = [x[-1] for x in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:])])]
        out = pa.Table.from_batches(pieces).take(pa.array(order, pa.int64()))
        out = out.append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32())).append_column("rank", pa.array(range(len(order)), pa.int64()))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    ranges = max(8, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, "url_key", "seconds", "page_id", "run", "pos").sortWithinPartitions("run", "pos")
    merged = written(dealt.mapInArrow(run, _RUN + ", range int, rank bigint"), "warc-index")
    sizes = merged.groupBy("range").count()  # a row for RANGE_ROWS captures
    before = F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return merged.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").withColumn("capture_order", F.col("before") + F.col("rank") + 1).drop("before")


def capture_histories(pages: DataFrame, folder: str | None = None, captured: str | None = None, **options) -> DataFrame:
    """Writes the pages' archives, reads them back and merges their indexes."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return merge_runs(read_archives(write_archives(with_record_types(pages, captured=captured), folder, **options), folder))


def op1_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_order")


SQL = """
WITH p AS (SELECT page_id, CASE WHEN html IS NULL THEN '' ELSE html END AS html, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS host FROM pages),
k AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS digest, CASE WHEN url IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' ||
    coalesce(nullif(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), ''), '/') || lower(regexp_extract(url, '^[^?#]*([?][^#]+)', 1)) END AS key FROM p
),
h AS (SELECT digest, max(page_id) AS head FROM k WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.digest AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN CAST(head AS BIGINT) END AS refers_to,
  row_number() OVER (ORDER BY key, coalesce(page_id, 0), coalesce(page_id, -1)) AS capture_order
FROM k LEFT JOIN h ON k.digest = h.digest
"""

QUERIES = {"op1_warc_merge": op1_warc_merge}
ORACLES = {"op1_warc_merge": SQL}
