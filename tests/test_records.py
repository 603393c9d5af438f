"""The registered queries against their SQL, and the units below them."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.functions import mrz as M
from leafmark.functions import text as T
from leafmark.operators import kernels as K
from leafmark.operators import mrz as P
from leafmark.operators import ocr as O
from leafmark.operators import profiles as PR
from leafmark.plans import registry
from leafmark.sources import files, sinks

SF = "/root/testdata/sf0.001"
#: The specimen of the public standard.
FIRST = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
SECOND = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


def _rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(map(_norm, r)) for r in zip(*(table[c].to_pylist() for c in names))), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toArrow()
    want = duck.sql(registry.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert _rows(got) == _rows(want)


def _parse(spark, *pages):
    rows = [(d, i, t, None) for d, texts in enumerate(pages) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id int, row_index int, raw_text string, normalized_text string")
    return {r.doc_id: r for r in P.parse(P.page_rows(frame)).collect()}


def test_parse_statuses(spark):
    bad = SECOND[:43] + "7"
    pm = "PM" + FIRST[2:]
    got = _parse(
        spark, [FIRST, SECOND], [FIRST + SECOND], [SECOND + FIRST], [FIRST, bad], [FIRST[:40], SECOND], ["PC" + FIRST[2:], SECOND], [pm, SECOND], [pm, bad], [pm[:30], bad], [FIRST[:36], SECOND[:36]], ["nothing"], ["!!"], [None],
        [FIRST, "A" + SECOND[1:]], [FIRST[:42] + SECOND],
    )
    want = ["valid", "valid", "valid", "invalid", "valid", "valid", "valid", "partial", "partial", "unsupported_format", "incomplete", "incomplete", "incomplete", "invalid", "valid"]
    assert [got[i].status for i in range(len(want))] == want
    assert [got[i].recovery for i in (0, 4, 5, 8, 14)] == [None, "validated_filler_padding", "validated_structural_marker", "pm_filler_padding", "validated_concatenated_split"]
    assert got[1].method == "split_concatenated_row" and got[2].row_order == "swapped" and got[11].reasons == ["no_mrz_rows"]
    fields = got[0].fields.asDict()
    assert (fields["surname"], fields["given_names"], fields["passport_number"], fields["sex"], fields["optional_data"]) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "female", "ZE184226B")
    assert [c.value for c in got[0].checks] == ["6", "2", "9", "1", "0"]


def test_no_silent_acceptance(spark):
    """One changed character of the data row is never valid without a recovery, where a check digit covers it."""
    rnd = random.Random(1)
    pages = []
    for _ in range(60):
        k = rnd.choice([*range(10), *range(13, 20), *range(21, 44)])
        other = rnd.choice([c for c in "0123456789ABCDEFGHIJ" if M._VALUES[M._CHARACTERS.index(c)] != M._VALUES[M._CHARACTERS.index(SECOND[k])]])
        pages.append([FIRST, SECOND[:k] + other + SECOND[k + 1 :]])
    got = _parse(spark, *pages)
    assert not [p for i, p in enumerate(pages) if got[i].status == "valid" and not got[i].recovery]


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_check_digits(spark):
    for text, want in (("520727", "3"), ("AB2134<<<", "5"), ("", "0"), ("<", "0"), ("A!", None), ("L898902C3", "6"), ("Z" * 40, str(sum((7, 3, 1)[i % 3] * 35 for i in range(40)) % 10))):
        assert _value(spark, M.check_digit(F.lit(text))) == want


def test_text_functions(spark):
    assert _value(spark, T.compact(F.lit("a b c\x1cd\n"))) == "ABCD"
    assert _value(spark, T.allowed_ratio(F.lit("A1<é"))) == 0.75 and _value(spark, T.allowed_ratio(F.lit(""))) == 0
    assert _value(spark, T.last_number(F.lit("a12b003"))) == 3 and _value(spark, T.last_number(F.lit("x"))) == 0
    assert _value(spark, T.tagged_number(F.lit("DATAPAGE_7 page12"))) == 12 and _value(spark, T.tagged_number(F.lit("9"))) is None
    assert _value(spark, T.safe_name(F.lit("3.Seaman Books"))) == "3_Seaman_Books"
    assert _value(spark, T.html_escape(F.lit("<a href='x'>&\"</a>"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;&lt;/a&gt;"
    assert _value(spark, T.url_quote(F.lit("a b/ü~*"))) == "a%20b/%C3%BC~%2A"
    assert _value(spark, T.stem(F.lit("/a/b.c/x.tar.gz"))) == "x.tar" and _value(spark, T.suffix(F.lit("/a/X.PNG"))) == ".png"


def test_ties_take_the_first(spark):
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 3.0, 1.0, 3.0])], "key int, i int, x double")
    assert PR.peak(frame).first().i == 1
    assert PR.peak(frame.where("false")).count() == 0


def test_kernels():
    page = np.full((100, 80), 255, np.uint8)
    page[20:30, 10:50] = 0
    assert K.content_box(page) == (10, 20, 40, 10) and K.content_box(page, margin=15) == (0, 5, 65, 40) and K.content_box(np.full((5, 6), 255, np.uint8)) == (0, 0, 6, 5)
    assert (K.turned(K.turned(page, 90), 270) == page).all() and K.turned(page, 90)[10, 100 - 1 - 20] == 0
    assert K.white_padded(page).shape == (148, 128) and K.lower_band(page).shape == (48, 80)
    at, two = K.otsu(np.where(page == 0, 30, 220).astype(np.uint8))
    assert 30 <= at < 220 and ((two == 0) == (page == 0)).all()
    small, scale = K.shrunk(page, 50)
    assert small.shape == (50, 40) and scale == 0.5 and K.gray(K.three_channels(page)).tolist() == page.tolist()


def test_images_and_recognition(spark, tmp_path):
    import struct
    import zlib

    def png(pixels):
        h, w = pixels.shape
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + r.tobytes() for r in pixels)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    page = np.full((40, 30), 255, np.uint8)
    page[5:9, 3:20] = 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.PNG").write_bytes(png(page))
    (tmp_path / "b.txt").write_text("x")
    found = files.image_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["p.PNG"]
    boxes = K.apply(files.images(spark, str(tmp_path / "a")), K.content_box, "box").collect()
    assert [b.box for b in boxes] == [[3, 5, 17, 4]]

    class Fake:
        def recognize(self, image):
            if image == b"bad":
                raise ValueError("no image")
            return [{"polygon": [[1, 2], [5, 2], [5, 6], [1, 6]], "text": "AB", "confidence": 0.5}, {"polygon": [], "text": "C", "confidence": 0.1}]

    pages = spark.createDataFrame([(1, b"ok"), (2, b"bad")], "page int, content binary")
    out = O.recognized(pages, Fake)
    assert {r.page: r.error for r in out.collect()} == {1: None, 2: "ValueError: no image"}
    lines = O.extents(out, "page").orderBy("idx").collect()
    assert [(r.text, r.x, r.y, r.x2, r.y2) for r in lines] == [("AB", 1, 2, 5, 6), ("C", None, None, None, None)]
    with pytest.raises(RuntimeError):
        O.not_configured()
    payload = '{"res": {"rec_texts": ["A", "B"], "rec_scores": [0.5], "dt_polys": [[[0.5, 1.5], [2.5, 3.4]]]}}'
    decoded = _value(spark, O.payload_lines(F.lit(payload)))
    assert [(x.text, x.confidence, x.polygon) for x in decoded] == [("A", 0.5, [[0, 2], [2, 3]]), ("B", 0.0, [])]


def test_run_folders(spark, tmp_path):
    import json

    page = tmp_path / "labels" / "Set" / "page003"
    page.mkdir(parents=True)
    label = {"schema_version": 1, "source_file": "a.pdf", "source_page": 3, "contains_data_page": True, "expected_pages": 1, "rotation": 450, "remarks": ""}
    (page / "expected.json").write_text(json.dumps(label, indent=2))
    event = {"reviewed_at": "2020-01-01T00:00:00", "review": "correct", "failure_reason": None, "quality": {"page_complete": True, "portrait_complete": True, "mrz_complete": True, "ocr_ready": False}}
    (page / "review.json").write_text(json.dumps({"schema_version": 2, "latest": event, "history": [event, event]}))
    (row,) = files.labels(spark, str(tmp_path / "labels")).collect()
    assert (row.dataset_name, row.rotation, row.source_page) == ("Set", 90, 3)
    (review,) = files.reviews(spark, str(tmp_path / "labels")).collect()
    assert (review.dataset_name, review.page_folder, review.review, review.quality.ocr_ready, review.events) == ("Set", "page003", "correct", False, 2)
    (page / "expected.json").write_text(json.dumps({"source_file": "a.pdf"}))
    with pytest.raises(Exception, match="missing fields"):
        files.labels(spark, str(tmp_path / "labels")).collect()
    run = tmp_path / "debug" / "a" / "page007"
    run.mkdir(parents=True)
    stage = lambda n, s: {"name": n, "file": "x", "elapsed_ms": 2.5, "metadata": {"scores": {"final": s}}}
    (run / "log.json").write_text(json.dumps({"status": "selected", "message": "", "metrics": {"orientation": {"angle": 90}}, "stages": [stage("scored_1", 50.0), stage("scored_2", 70.0), stage("other", 99.0)]}))
    (log,) = files.page_logs(spark, str(tmp_path / "debug")).collect()
    assert (log.document, log.page, log.selected, log.rotation, log.score_1, log.score_2, log.ocr_safe, log.elapsed_ms) == ("a", 7, True, 90, 70.0, 50.0, True, 7.5)
    assert [r.reader for r in files.routed(spark.createDataFrame([("a.PDF",), ("b.tif",), ("c.jpg",)], "path string")).collect()] == ["pdf", "tiff", "image"]
    with pytest.raises(Exception, match="unsupported"):
        files.routed(spark.createDataFrame([("a.doc",)], "path string")).collect()
    pages = spark.createDataFrame([("d", 2, "x"), ("d", 1, "y")], "document string, page int, status string")
    report = json.loads(sinks.summary_json(pages.agg(F.count("page").alias("pages")), pages, "page").first().report)
    assert report["summary"] == {"pages": 2} and [p["page"] for p in report["pages"]] == [1, 2]
    sinks.write_pages(pages, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_configuration_is_strict():
    from leafmark.operators.scores import merged_config

    known = {"a": 1, "b": {"c": 2, "d": 3}}
    assert merged_config(known, {"b": {"d": 9}}) == {"a": 1, "b": {"c": 2, "d": 9}}
    with pytest.raises(ValueError, match="b.x"):
        merged_config(known, {"b": {"x": 1}})


def test_acceptance_cases(spark):
    """Scores of known cases: (portrait, mrz, layout, final, eye, lines) and the path taken."""
    from leafmark.operators import decide

    cases = [
        (100.0, 0.0, 67.0, 57.5, None, None, "strong_portrait_layout_fallback"), (55.0, 0.0, 60.0, 57.5, None, None, "low_confidence"), (90.0, 0.0, 68.0, 54.0, 0.9, None, "verified_face_layout_fallback"),
        (90.0, 0.0, 68.0, 54.0, 0.0, None, "low_confidence"), (97.0, 0.0, 78.0, 66.0, 0.0, 84.0, "narrative_page_rejection"), (0.0, 0.0, 0.0, 58.0, None, None, "standard_threshold"),
    ]
    frame = spark.createDataFrame(cases, "portrait double, mrz_texture double, layout double, final double, eye_quality double, line_count double, want string")
    rows = decide.acceptance(frame).collect()
    assert len(rows) == len(cases) and all(r.path == r.want for r in rows)


def test_streams(spark, tmp_path):
    from leafmark.streaming import jobs

    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "a"), (1, 5, "a")]
    for k, part in enumerate((rows[:2], rows[2:])):  # a change back counts, across batches too
        spark.createDataFrame(part, "key int, seq int, mark string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    out = jobs.run_available(jobs.changed(stream, "key", "seq", "mark"), str(tmp_path / "changes"), str(tmp_path / "c"))
    assert sorted(r.seq for r in out.collect()) == [1, 3, 4, 5]
    timed = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 05:00:00", "y")], "at string, kind string").selectExpr("cast(at as timestamp) at", "kind")
    timed.write.parquet(str(tmp_path / "t"))
    counts = jobs.counts_by_type(jobs.event_stream(spark, str(tmp_path / "t")), "at", "kind")
    got = jobs.run_available(counts, str(tmp_path / "counts"), str(tmp_path / "d"), "complete").collect()
    assert sorted((r.kind, r.n) for r in got) == [("x", 2), ("y", 1)]


def test_crew_list(spark):
    from leafmark.operators.export import birth_serial, crew_list

    fields = "struct<surname:string,given_names:string,sex_code:string,nationality:string,date_of_birth:string,document_code:string,passport_number:string>"
    rows = [("b", 1, "valid", ("A", "", "M", "1ND", "000229", "P<", "X1")), ("a", 2, "partial", ("B", "C", "<", "ZMB", "490230", "PM", "")), ("a", 1, "invalid", ("D", "E", "F", "FRA", "500101", "P<", "Z"))]
    got = crew_list(spark.createDataFrame(rows, f"document string, page_number int, status string, fields {fields}")).orderBy("seq").collect()
    assert [(r.seq, r.name, r.sex, r.nationality, r.document_kind, r.document_number, r.remark) for r in got] == [
        (1, "", None, None, None, None, None), (2, "B C", None, "ZM", "17-海员证", None, "MRZ校验需复核"), (3, "A", "1-男", "IN-印度", "14-普通护照", "X1", None),
    ]
    assert [r.birth_serial for r in got] == [None, None, 36585]
    assert _value(spark, birth_serial(F.lit("500101"))) == 18264 and _value(spark, birth_serial(F.lit("5001"))) is None
