import gzip
import hashlib
import random

import duckdb
import pytest

from leafmark.llm import warc

PAGES = "page_id bigint, url string, html string, extra string"


def _expected(rows):
    heads = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            key = hashlib.sha1(raw).hexdigest()
            heads[key] = max(heads.get(key, -1), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        key = hashlib.sha1(raw).hexdigest()
        head = heads.get(key, i)
        out.append((i, len(raw), key, "revisit" if head > i else "response", head if head > i else None))
    return sorted(out)


def test_round_trip_and_order(spark, tmp_path):
    rnd = random.Random(3)
    long = "<p>" + "é" * 900
    rows = [(1, "http://b.example.com/x", long), (2, "https://www.b.example.com/x#f", long), (3, None, None), (4, "http://a.example.org:80/", ""), (5, "http://a.example.org/", "short"), (6, "bad url\n here", "short"), (9, "http://b.example.com/x", long)]
    rows += [(100 + i, f"http://h{i % 5}.example.net/{i % 3}", "z" * rnd.randint(0, 3000)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], PAGES).repartition(3)
    found = warc.capture_histories(pages, folder=str(tmp_path / "w"), archive_bytes=2000)
    got = found.collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == _expected(rows)
    got.sort(key=lambda r: r.capture_order)
    assert [r.capture_order for r in got] == list(range(1, len(rows) + 1))
    order = [(r.url_key.encode(), r.seconds, r.page_id) for r in got]
    assert order == sorted(order) and [(r.range, r.rank) for r in got] == sorted((r.range, r.rank) for r in got)
    for r in got:  # an entry of the index leads to its record
        raw = (tmp_path / "w" / r.run).read_bytes()[r.offset : r.offset + r.length]
        fields, payload = warc.parse(gzip.decompress(raw))
        assert fields.get("X-Page-Id") == str(r.page_id)
        assert r.record_type == "revisit" or hashlib.sha1(payload).hexdigest() == r.payload_digest


def test_empty_and_repeated_rows(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert warc.capture_histories(none, folder=str(tmp_path / "e")).count() == 0
    twice = spark.createDataFrame([(7, "http://a.b/", "y" * 2000, "")] * 2 + [(None, None, None, None)], PAGES)
    got = warc.capture_histories(twice, folder=str(tmp_path / "t")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (7, "response"), (7, "response")]


@pytest.mark.parametrize("sizes", [[], [0], [3], [0, 4, 1], [5, 5, 5, 5, 5], [1] * 9])
def test_loser_tree(sizes):
    rnd = random.Random(sum(sizes))
    runs = [sorted((rnd.randint(0, 9), k) for _ in range(n)) for k, n in enumerate(sizes)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTPS://www.Example.com:443/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("http://x.y:8080") == "y,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_cut_archive_is_found(tmp_path):
    raw = gzip.compress(warc.record(1, "http://a/", b"x" * 100, hashlib.sha1(b"x" * 100).hexdigest(), None, 0))
    (tmp_path / "a").write_bytes(raw[:-5])
    with (tmp_path / "a").open("rb") as f, pytest.raises(ValueError):
        list(warc.members(f))


def test_query_equals_its_sql(spark, tmp_path):
    rnd = random.Random(5)
    long = "y" * 1500
    hosts = ["www.b.example.com", "B.example.com", "a.example.org", "example.net"]
    ends = ["", "/", "/X/1", "/x/1?q=A&b", "/x/1#top", "?q=1"]
    rows = [(i, f"http{'s' * rnd.randint(0, 1)}://{rnd.choice(hosts)}{rnd.choice(ends)}", rnd.choice([long, long + "é", "z" * rnd.randint(0, 40), None]), "e") for i in range(120)]
    rows += [(500, None, long, "e"), (501, "http://a.example.org", "", "e")]
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in warc.op1_warc_merge(spark, str(tmp_path)).collect()) == sorted(db.sql(warc.SQL).fetchall())


def test_named_times_and_columns_of_the_same_names(spark, tmp_path):
    rows = [(i, "http://a/", "x", 100 - i) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, at int").selectExpr("*", "1 AS digest", "2 AS rank", "3 AS run", "4 AS refers_to", "5 AS seconds", "6 AS payload")
    got = sorted(warc.capture_histories(pages, folder=str(tmp_path / "n"), captured="at").collect(), key=lambda r: r.capture_order)
    assert [r.page_id for r in got] == list(range(8, -1, -1)) and got[0].seconds == 92
