"""Readers, writers, kernels and streams that no query runs."""

import json
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import export, incremental, kernels as K, report, validate
from leafmark.operators import rows as W
from leafmark.sources import files, sinks
from leafmark.streaming import jobs


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"2")
    (tmp_path / "b.tif").write_bytes(b"1")
    found = files.image_files(spark, str(tmp_path))
    decode = lambda raw: [np.full((4, 5, 3), i, np.uint8) for i in range(int(raw))]
    rows = files.pages_of(found, decode).collect()
    assert sorted((r.path[-5:], r.page, r.image.data[0], r.image.mode) for r in rows) == [("a.tif", 1, 0, 16), ("a.tif", 2, 1, 16), ("b.tif", 1, 0, 16)]
    with pytest.raises(Exception, match="no pages"):
        files.pages_of(found, lambda raw: []).collect()
    assert files.page_scale(595, 842, 300, 2000) == pytest.approx(2000 / 842) and files.page_scale(100, 100, 144) == 2


def test_images_that_cannot_be_decoded(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(K.png(np.arange(60, dtype=np.uint8).reshape(4, 5, 3)))
    assert files.images(spark, str(tmp_path)).select("image.width").first().width == 5
    (tmp_path / "bad.png").write_bytes(b"no image")
    assert files.images(spark, str(tmp_path), drop_invalid=True).count() == 1
    with pytest.raises(Exception, match="not an image"):
        files.images(spark, str(tmp_path)).collect()


def test_png_round_trip(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(K.png(image, 9))
    row = files.images(spark, str(tmp_path)).first().image
    assert (K.pixels(row.asDict()) == image).all()
    with pytest.raises(ValueError):
        K.png(image, 10)


def test_png_files_are_written_and_read(spark, tmp_path):
    rnd = np.random.default_rng(3)
    drawn = {f"p {k}": rnd.integers(0, 256, (k + 1, 4, 3) if k % 2 else (k + 1, 4)).astype(np.uint8) for k in range(6)}
    rows = [(n, ("", p.shape[0], p.shape[1], p.ndim if p.ndim == 3 else 1, 16 if p.ndim == 3 else 0, p.tobytes())) for n, p in drawn.items()]
    images = spark.createDataFrame(rows, "name string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>").repartition(3)
    for _ in range(2):  # a second run replaces the files
        made = sinks.write_png(images, str(tmp_path / "out"))
    assert {r.file: r.size for r in made.collect()} == {p.name: p.stat().st_size for p in (tmp_path / "out").glob("[!_.]*.png")}
    back = files.images(spark, str(tmp_path / "out")).collect()
    assert len(back) == 6
    for r in back:
        page = K.pixels(r.image.asDict())
        want = drawn[next(n for n in drawn if r.image.origin.replace("%20", " ").endswith(f"{n}.png"))]
        assert (page == want).all()
    with pytest.raises(Exception, match="no file name"):
        sinks.write_png(images.withColumn("name", F.lit("../x")), str(tmp_path / "bad"))


def test_config_is_laid_over_defaults():
    pytest.importorskip("yaml")
    base = {"a": {"x": 1, "y": 2}, "b": 3}
    assert files.merged_config(base, "a: {y: 5}") == {"a": {"x": 1, "y": 5}, "b": 3} and files.merged_config(base, "") == base
    with pytest.raises(ValueError, match=r"a\.z"):
        files.merged_config(base, "a: {z: 1}")


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Ä & <b>", 44000), (2, None, None)], "seq int, name string, day int").orderBy("seq")
    path = str(tmp_path / "crew.xlsx")
    assert sinks.write_xlsx(rows, path, ["No", "Name", "Born"], {1: 20.0}, dates=(2,)) == 2
    with zipfile.ZipFile(path) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        for part in z.namelist():
            ElementTree.fromstring(z.read(part))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    cells = {c.get("r"): "".join(c.itertext()) for c in sheet.findall(".//m:c", ns)}
    assert cells == {"A1": "No", "B1": "Name", "C1": "Born", "A2": "1", "B2": "Ä & <b>", "C2": "44000", "A3": "2"}
    assert sheet.find(".//m:pane", ns).get("state") == "frozen" and sheet.find(".//m:c[@r='C2']", ns).get("s") == "1"


def test_run_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "page int, name string, n int")
    report.write_run(pages.agg(F.count(F.lit(1)).alias("pages")), pages, str(tmp_path / "r"), {"dpi": 300})
    head = json.loads(spark.read.text(str(tmp_path / "r" / "run")).first()[0])
    assert head["summary"] == {"pages": 2} and head["run"]["config"] == {"dpi": 300} and set(head["run"]["runtime"]) == {"python", "pyspark", "pyarrow", "numpy"}
    assert report.version("no-such-package") is None
    assert sorted(r.page for r in spark.read.json(str(tmp_path / "r" / "pages")).collect()) == [1, 2]
    assert report.page_of("T", ["<tr></tr>"]).count("<tr>") == 1


def test_reviews(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, "correct", None)], "k string, seq int, review string, failure_reason string")
    new = lambda *rows: spark.createDataFrame(rows, "k string, review string, failure_reason string")
    got = incremental.append_reviews(events, new(("a", "incorrect", "crop"), ("b", "correct", "crop")), ["k"]).collect()
    assert sorted((r.k, r.seq, r.failure_reason, r.latest) for r in got) == [("a", 1, None, False), ("a", 2, "crop", True), ("b", 1, None, True)]
    with pytest.raises(Exception, match="unsupported review outcome"):
        incremental.append_reviews(events, new(("a", "maybe", None)), ["k"]).collect()
    incremental.write_reviews(events, str(tmp_path / "v"), ["k"])
    assert spark.read.json(str(tmp_path / "v")).first().latest.review == "correct"


def test_row_choice(spark):
    schema = "doc_id bigint, row_index int, raw_text string, normalized_text string, fragment_count bigint, confidence double"
    full, short = "A" * 44, "A" * 40
    first = spark.createDataFrame([(1, 1, "", short, 1, 0.9), (2, 1, "", full, 1, 0.9), (3, 1, "", full, 1, 0.5), (4, 2, "", short, 1, None)], schema)
    second = spark.createDataFrame([(1, 1, "", full, 1, 0.1), (2, 1, "", full, 1, 1.0), (3, 1, "", full, 1, 0.5), (4, 2, "", short, 1, 0.2)], schema)
    assert {r.doc_id: r.variant for r in W.chosen_rows(first, second).collect()} == {1: 1, 2: 0, 3: 0, 4: 1}
    one = spark.createDataFrame([(["x", "mrz_parse_partial"], None)], "w array<string>, s string").select(*(W.parse_warnings(F.col("w"), F.col("s"), k).alias(k) for k in ("second", "fast", "again"))).first()
    assert one.second == ["x", "mrz_parse_partial"] and one.fast[-1] == "mrz_parse_invalid" and one.again == ["x"]


def test_enlargement():
    small = np.random.default_rng(2).integers(0, 256, (6, 7, 3)).astype(np.uint8)
    big = K.enlarged(small, 3)
    assert big.shape == (18, 21, 3) and (K.enlarged(small, 1) == small).all()
    assert (big[1::3, 1::3] == small).all()  # the middle of each pixel keeps its value


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, f"t{i % 2}") for i in range(30)]
    folder = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "seq int, k int, v string").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: jobs.event_stream(spark, folder, 1)
    assert jobs.follow(stream(), str(tmp_path / "out"), str(tmp_path / "c1")) == 30
    spark.createDataFrame([(30, 0, "x")], "seq int, k int, v string").coalesce(1).write.mode("append").parquet(folder)
    assert jobs.follow(stream(), str(tmp_path / "out"), str(tmp_path / "c1")) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 31
    seen = []
    jobs.reported(stream(), str(tmp_path / "rep"), lambda df: seen.append(df.count()), str(tmp_path / "c2"), every=2)
    assert len(seen) == 3 and seen[-1] == 31 and seen == sorted(seen)
    state = jobs.run_available(jobs.page_states(stream(), ["k"], "seq", "v"), str(tmp_path / "s"), str(tmp_path / "c3"), "complete")
    assert sorted((r.k, r.seq, r.v, r.events) for r in state.collect()) == [(0, 30, "x", 11), (1, 28, "t0", 10), (2, 29, "t1", 10)]


def test_numbers_of_documents(spark, monkeypatch):
    names = [f"crew {i % 40}" for i in range(300)] + ["艾", "张", "Ä", "b", "A"]
    pages = spark.createDataFrame([(n,) for n in names], "document string")
    whole = {r.document: r.before for r in export.numbered_documents(pages).collect()}
    monkeypatch.setattr(export, "RANGES", 3)
    assert {r.document: r.before for r in export.numbered_documents(pages).collect()} == whole
    order, at = sorted(whole, key=whole.get), 0
    for n in order:
        assert whole[n] == at
        at += names.count(n)
    assert order.index("艾") < order.index("张") and order.index("A") < order.index("b")


def test_seeds_and_first_labels(spark):
    spec = spark.createDataFrame([("d", 3), ("e", 0)], "dataset string, pages int")
    of = lambda *rows, schema="dataset string, page int": spark.createDataFrame(rows, schema)
    got = validate.seeded_labels(spec, of(("d", 2)), of(("d", 1, 450), schema="dataset string, page int, value int"), None, of(("d", 3))).collect()
    assert sorted((r.page, r.contains_data_page, r.expected_pages, r.rotation, r.remarks) for r in got) == [(1, True, 1, 90, ""), (2, False, 0, 0, "")]
    inside = spark.createDataFrame([(p,) for p in ("a", "a/..", "..//a", "a/../../a", "a\\b", "")], "p string").select(T.stays_inside(F.col("p")).alias("i"))
    assert [r.i for r in inside.collect()] == [True, False, False, False, False, False]


def test_large_reports_fail(spark, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_PAGES", 2)
    with pytest.raises(ValueError):
        sinks.summary_json(spark.range(1), spark.range(3), "id")



def test_unknown_jobs_fail(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "job_id string")
    running = spark.createDataFrame([("a", "running", 2)], "job_id string, status string, workers int")
    assert [(r.status, r.workers) for r in incremental.found_jobs(asked, running, asked).orderBy("job_id").collect()] == [("running", 2), ("done", 1)]
    with pytest.raises(Exception, match="unknown job: b"):
        incremental.found_jobs(asked, running, running).collect()


def test_command_line(tmp_path, capsys):
    from leafmark.__main__ import main

    main(["list"])
    assert "mrz_parse_status" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "in", "out"])


def test_decimals_round_the_exact_value(spark):
    values = [56.65, 70.35, 71.25, 71.35, 0.05, 99.95, 12.5, 0.0, -0.25, -0.04, 1e9 + 0.05, 123456.789, *(k / 20 for k in range(500))]
    for places in (1, 2):
        got = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", T.fixed(F.col("v"), places).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.v:.{places}f}" for r in got]
    got = spark.sql("SELECT 0.5665D AS rate, 50.0D AS ms UNION ALL SELECT NULL, NULL").select(T.format_rate(F.col("rate")).alias("rate"), report.seconds(F.col("ms")).alias("s"), T.fixed(F.col("ms"), 1).alias("t"))
    assert [tuple(r) for r in got.collect()] == [(f"{0.5665 * 100:.1f}%", f"{50.0 / 1000:.1f}s", "50.0"), ("N/A", "N/A", None)]
