import random
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from leafmark.llm import langid, packing, secrets
from leafmark.llm.common import crc_mod
from tests.llm.helpers import prose
from tests.llm.test_decontaminate import _plain as _hits
from tests.llm.test_neardup import _brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _tables(spark, folder, texts, items):
    rows = [(i, t, None if t and "\u4e00" <= t[0] else "en" if i % 2 else "fr", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]  # no label for foreign scripts
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_equal_plain_versions(spark, tmp_path):
    rnd = random.Random(1)
    item = prose(rnd, 30)
    texts = [prose(rnd, rnd.randint(10, 80)) for _ in range(40)]
    texts += [texts[3], texts[3] + " end", None, "", "12 34", item + " " + prose(rnd, 20), prose(rnd, 30) + " token=abcdefghijklmnop " + prose(rnd, 9)]
    foreign = {47: "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(200)), 48: "½ ¾ 12 ²"}  # of no learned language; no letter
    texts += [foreign[k] for k in sorted(foreign)] + ["字"]  # too short to tell
    _tables(spark, tmp_path, texts, [(1, item)])
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == cp.COLUMNS
            docs = spark.createDataFrame(docs.collect(), DOCS)
        seen.append({r.doc_id: r for r in docs.collect()})

    left = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t) and i not in foreign}
    assert set(seen[0]) == set(left)
    ids = sorted(left)
    root = _brute([left[i] for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if root[k] == k}
    assert set(seen[1]) == set(left)
    for i in list(left):
        n, hit, _ = _hits(left[i], [(1, item)])
        if hit and 20 * len(hit) >= n:
            del left[i]
    assert set(seen[2]) == set(left) and 45 not in left
    for i, t in left.items():
        (found,) = secrets.Scanner().spans([t])
        assert (seen[3][i].text == t) == (not found) and seen[3][i].n_chars == len(seen[3][i].text)
    assert "[SECRET]" in seen[3][46].text
    total = sum(len(packing.encoder(packing.tokenizer_path(), 1).encode(r.text)) // 2 for r in seen[3].values())
    assert sum(r.length for r in docs.collect()) == total


def test_edge_rows_of_all_stages(spark, tmp_path):
    """Null and repeated ids and texts, a long text, columns with the names that stages use, null benchmark rows; then empty tables."""
    rnd = random.Random(4)
    same, long = prose(rnd, 40), " ".join(f"{w}{i}" for i, w in enumerate(prose(rnd, 30_000).split()))
    rows = [(1, same), (1, same), (2, same), (None, prose(rnd, 30)), (None, None), (3, None), (4, ""), (5, long), (6, prose(rnd, 20)), (6, prose(rnd, 20))]
    extra = {c: i for i, c in enumerate(("lang_pred", "score", "bits_per_byte", "class_id", "n_words", "hit_items", "spans", "piece_ids", "sequence_id"))}
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for c, k in extra.items():
        frame = frame.withColumn(c, F.lit(k))
    bench = "item_id bigint, text string"
    for folder, docs, items in (("some", frame, [(1, None), (None, None)]), ("none", frame.where("false"), [])):
        docs.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame(items, bench).write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    got = cp.run(spark, f"{tmp_path}/some").collect()
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(per) == {1, None, 5, 6}
    for doc, pieces in per.items():
        tokens = sum({t for _, _, t in pieces}) if doc != 6 else sum(n for _, n, _ in pieces)
        assert sum(n for _, n, _ in pieces) == tokens
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_run_and_registry(spark, tmp_path):
    import __spark_entry__ as entry

    _tables(spark, tmp_path, [prose(random.Random(i), 30) for i in range(12)] + [None], [(1, "nothing here")])
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() >= 1
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_language_stage_learns_only_from_training_rows(spark, tmp_path):
    _tables(spark, tmp_path, ["ka to mi"] * 10, [(1, "x")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    trees = langid.fit(docs, crc_mod("doc_id", 5) != 0)
    assert trees.languages == ["en", "fr"]
