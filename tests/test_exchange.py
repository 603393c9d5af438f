"""Payloads, stage logs, progress and quantiles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from leafmark.operators import ocr
from leafmark.operators import profiles as P
from leafmark.plans.images import _cut
from leafmark.sources import files, stagelog
from leafmark.streaming import jobs, progress


def _plain(payload):
    value = json.loads(payload)
    value = json.loads(value) if isinstance(value, str) else value
    out = []
    for one in value if isinstance(value, list) else [value]:
        data = one.get("res", one)
        polygons, scores = data.get("rec_polys") or data.get("dt_polys") or [], data.get("rec_scores", [])
        for i, t in enumerate(data.get("rec_texts", [])):
            out.append(([[round(v) for v in p] for p in polygons[i]] if i < len(polygons) else [], str(t), float(scores[i]) if i < len(scores) else 0.0))
    return out


def test_payloads_of_all_kinds(spark):
    box = [[0.5, 1.5], [2, 3.49]]
    one = {"rec_texts": ["A<1", "b", 7, None], "rec_scores": [0.5, 1], "rec_polys": [box, [[1, 2]]], "dt_polys": [[[9, 9]]]}
    detected = {"res": {"rec_texts": ["x", "y"], "rec_scores": [0.25], "rec_polys": [], "dt_polys": [box]}}
    said = [json.dumps(x) for x in (one, {"res": one}, detected, json.dumps(detected), [one, detected], [], {}, {"res": {"rec_texts": []}}, {"rec_texts": ["ä\n\"q\""], "other": [1, {"a": 2}]})]
    rows = spark.createDataFrame(list(enumerate([*said, None])), "k int, payload string")
    got = {r.k: [(x.polygon, x.text, x.confidence) for x in r.lines] for r in rows.select("k", ocr.payload_lines(F.col("payload")).alias("lines")).collect()}
    assert got == {**{k: _plain(p) for k, p in enumerate(said)}, len(said): []}
    for bad in ("7", "true", "[", '"7"'):
        with pytest.raises(Exception, match="unsupported payload|MALFORMED"):
            spark.createDataFrame([(bad,)], "payload string").select(ocr.payload_lines(F.col("payload"))).collect()


def _logs(spark, n, first=0):
    log = lambda i: json.dumps({"status": "selected" if i % 2 else "rejected", "source_page": i, "stages": [{"name": "scored_1", "elapsed_ms": 1.5, "metadata": {"scores": {"final": float(i)}}}]})
    return spark.createDataFrame([(f"crew {i % 3}", i, log(i)) for i in range(first, first + n)], "document string, page int, log string").repartition(3)


def test_stage_logs_round_trip(spark, tmp_path):
    spark.dataSource.register(stagelog.StageLogs)
    root = str(tmp_path / "run")
    write = lambda rows, mode="append": rows.write.format("stage_logs").option("path", root).mode(mode).save()
    write(_logs(spark, 20))
    write(_logs(spark, 5, 20))
    got = sorted((r.document, r.page, r.selected, r.score_1, r.elapsed_ms) for r in files.page_logs(spark, root).collect())
    assert got == sorted((f"crew {i % 3}", i, i % 2 == 1, float(i), 1.5) for i in range(25))
    bad = _logs(spark, 10, 30).withColumn("document", F.when(F.col("page") == 35, "../x").otherwise(F.col("document")))
    with pytest.raises(Exception, match="no name"):
        write(bad)
    assert files.page_logs(spark, root).count() == 25 and not list((tmp_path / "run").glob("_*"))
    with pytest.raises(Exception, match="append"):
        write(_logs(spark, 1), "overwrite")
    write(_logs(spark, 0))
    assert files.page_logs(spark, root).count() == 25


def test_progress_of_batches_and_streams(spark, tmp_path):
    rows = [(i, "bad" if i % 5 == 0 else None, i % 3 == 0) for i in range(90)]
    spec = "page int, error string, reused boolean"
    counted, seen = progress.watched(spark.createDataFrame(rows, spec))
    counted.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"pages": 90, "errors": 18, "reused": 30}
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], spec).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = progress.Progress(lambda number, counts: told.append((number, counts["pages"])))
    spark.streams.addListener(listener)
    try:
        stream = progress.watched_stream(jobs.event_stream(spark, str(tmp_path / "in"), 1))
        jobs.run_available(stream, str(tmp_path / "table"), str(tmp_path / "point"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert told == [(0, 30), (1, 30), (2, 30)] and list(listener.sums.values()) == [{"pages": 90, "errors": 18, "reused": 30}]


def test_weighted_quantiles_by_refinement(spark):
    rnd = random.Random(2)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e9), 7.0, -0.0]), rnd.randint(0, 9)) for _ in range(3000)]
    rows += [("one", 3.5, 2), ("same", 1.0, 1), ("same", 1.0, 5), ("wide", -1.7e308, 1), ("wide", 1.7e308, 1), ("wide", 0.0, 3), ("none", None, 1), ("tiny", 5e-324, 1), ("tiny", 0.0, 1), ("tiny", 1e-323, 1)]
    frame = spark.createDataFrame(rows, "key string, value double, weight int").repartition(4)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        want = {}
        for key in {r[0] for r in rows} - {"none"}:
            mine, total = sorted((v, w) for k, v, w in rows if k == key), 0
            for v, w in mine:
                total += w
                if total >= share * sum(w for _, w in mine):
                    want[key] = v
                    break
        got = {r.key: r.value for r in P.weighted_quantile(frame, _cut(spark), share, buckets=8).collect()}
        assert got == want
    same = P.weighted_median(frame.where("key = 'hot'").withColumn("i", F.monotonically_increasing_id())).first().median
    assert same == P.weighted_quantile(frame.where("key = 'hot'"), _cut(spark)).first().value
    assert P.weighted_quantile(frame.where("false"), _cut(spark)).count() == 0


def test_row_cascade_equals_the_chain(spark):
    from leafmark.operators import cascade as C
    from leafmark.operators import rows as W

    rnd = random.Random(7)
    rows = []
    for doc in range(12):
        for row in (1, 2):
            for idx in range(rnd.randint(0, 4)):
                text = rnd.choice(["P<UTO", "AB <12", "x", "  ", "ab\tc", "---", "M" * 22, "<" * 30, "É9"])
                rows.append((doc, row, idx, text, rnd.choice([None, 0.5, 0.9, 1.0]), rnd.choice([None, 1, 5, 9]), 50.0 + rnd.choice([0, 10, 60]), 100))
    rows.append((99, 1, 0, "Q" * 44, 1.0, 1, 50.0, 100))
    pieces = spark.createDataFrame(rows, "doc_id bigint, row_index int, idx bigint, text string, confidence double, left int, centre double, height int")
    first = W.row_texts(pieces)
    read = lambda d, r, t: (t.ljust(44, "<")[:44], (d * 7 + r) % 10 / 10)
    second = first.withColumns({"normalized_text": F.rpad("normalized_text", 44, "<"), "confidence": ((F.col("doc_id") * 7 + F.col("row_index")) % 10) / 10})
    want = sorted((r.doc_id, r.row_index, r.normalized_text, r.confidence, r.variant) for r in W.chosen_rows(first, second).collect())
    assert sorted(tuple(r) for r in C.cascade(pieces, read).collect()) == want and {r[-1] for r in want} == {0, 1}
    with pytest.raises(Exception, match="misses the columns"):
        spark.sql("SELECT * FROM merged_rows(TABLE(SELECT 1 AS doc_id))")


def test_saved_buckets_are_not_dealt_again(spark, tmp_path):
    from leafmark.operators import incremental as I

    inputs = spark.createDataFrame([(i, float(i % 7), i % 3 or None) for i in range(200)], "k bigint, size double, stamp int")
    saved = spark.createDataFrame([(i, float(i % 7 + (i % 10 == 0)), i % 3 or None, "error" if i % 11 == 0 else "ok") for i in range(0, 250, 2)] + [(4, 9.0, 9, "ok")], "k bigint, size double, stamp int, status string")
    want = sorted(r.k for r in I.reusable(inputs, saved, "k", ["size", "stamp"])[0].collect())
    kept = I.saved_in_buckets(saved, "saved_results", "k", str(tmp_path), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        todo = I.todo_of_buckets(inputs, kept, "k", ["size", "stamp"], 8)
        plan = todo._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.k for r in todo.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE saved_results")
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan, plan


def test_a_payload_is_parsed_once(spark):
    """Twice at most in the plan (an object, and a text that holds one); each line took the arrays out of the payload anew before."""
    rows = spark.createDataFrame([(1, '{"rec_texts": ["a", "b"], "rec_scores": [0.5], "dt_polys": [[[1, 2], [3, 4]]]}')], "doc_id bigint, payload string")
    lines = rows.select("doc_id", ocr.payload_lines(F.col("payload")).alias("lines"))
    assert lines._jdf.queryExecution().analyzed().toString().count("parse_json(") <= 2
    assert [(r.idx, r.text, r.confidence, r.x, r.y2) for r in ocr.extents(lines, "doc_id").collect()] == [(0, "a", 0.5, 1, 4), (1, "b", 0.0, None, None)]


def _row_plan(spark, name):
    from leafmark.plans import rows as plans

    return plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_row_crops_measure_pages_once(spark):
    assert _row_plan(spark, "mrz_row_crops").count("posexplode(parts") == 1


def test_row_texts_judge_only_lines_in_crops(spark):
    """The lines are made twice, for rows and for pieces, and no text is judged below the join with the crops."""
    plan = _row_plan(spark, "mrz_row_texts")
    assert plan.count("posexplode(parts") == 2
    below = plan[plan.index("Join") :].split("\n")
    judged = [x for x in below[1:] if "btrim" in x or "trim(BOTH" in x]
    assert not judged


def test_second_readings_as_columns_equal_the_chain(spark):
    from leafmark.operators import rows as W

    rows = [(d, r, t, t, 1, c) for d, (t, c) in enumerate([("P<UTO", 0.5), ("A" * 44, None), ("A" * 44, 0.9), ("", 0.1), ("B" * 50, 0.99), ("P<" + "Q" * 42, 0.74), ("é" * 44, 0.2)]) for r in (1, 2)]
    first = spark.createDataFrame(rows, "doc_id bigint, row_index int, raw_text string, normalized_text string, fragment_count bigint, confidence double")
    for sure in (F.lit(0.5), F.lit(None).cast("double"), F.col("confidence"), (F.col("doc_id") * 7 + F.col("row_index")) % 10 / 10):
        text = F.rpad("normalized_text", 44, "<")
        want = W.chosen_rows(first, first.withColumns({"normalized_text": text, "confidence": sure})).collect()
        assert sorted(map(str, W.chosen_readings(first, text, sure).collect())) == sorted(map(str, want))
    assert _row_plan(spark, "row_variants").count("posexplode(parts") == 2


def test_row_cascade_makes_its_lines_twice(spark):
    assert _row_plan(spark, "row_cascade").count("posexplode(parts") == 2


def test_row_cascade_deals_crops_only(spark):
    """The functions get a row for each crop, of the pieces that count; every line in a crop was dealt and ordered for them before."""
    from leafmark.plans import rows as plans

    plan = plans.QUERIES["row_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan[: plan.index("REPARTITION_BY_COL")], plan[plan.index("REPARTITION_BY_COL") :]
    assert "Sort [" not in above
    assert "collect_list(struct(left" in below and "trim(" in below
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def test_merged_rows_takes_pieces_in_order_of_place(spark):
    from leafmark.operators import cascade as C

    rows = [(1, 1, i, t, c, x, 50.0, 100) for i, t, c, x in ((0, "CD", 0.5, 9), (1, " A\tB", None, 2), (2, "EF", 0.7, 9), (3, "G", 0.9, 1), (4, "HI", 0.9, None), (5, "----", 0.9, 0))]
    rows += [(1, 2, 0, "FAR", 0.9, 1, 95.0, 100), (2, 1, 0, "P<X", None, 1, 50.0, 100)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, row_index int, idx bigint, text string, confidence double, left int, centre double, height int")
    assert sorted(map(tuple, C.cascade(pieces, lambda d, r, t: ("", None)).collect())) == [(1, 1, "ABCDEF", 0.6, 0), (2, 1, "P<X", None, 0)]


def test_fragments_make_the_compact_text_once(spark):
    from leafmark.operators import lines as L

    rows = [(1, i, t, c, 10, 40 * i, 300, 40 * i + 24, 800) for i, (t, c) in enumerate([("top", 0.9)] + [("plain", 0.9)] * 11 + [("a<b", 0.9), ("a<", 0.9), ("a 1", 0.9), ("x" * 19 + "1", 0.9), ("ä" * 9 + "<", 0.9), ("<<<", 0.3), (None, 0.9), ("< < <", 0.9)])]
    found = L.fragments(spark.createDataFrame(rows, "doc_id bigint, idx bigint, text string, confidence double, x int, y int, x2 int, y2 int, page_height int"))
    assert sorted((r.idx, r.compact) for r in found.collect()) == [(12, "A<B"), (15, "X" * 19 + "1"), (19, "<<<")]
    plan = found.select("idx")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(translate(") == 1 and plan.count("Window [") == 1
