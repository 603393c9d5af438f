import hashlib
import random
import re

import duckdb
import pytest

from leafmark.llm import decontaminate as dc
from tests.llm.helpers import awkward, frame, prose

ITEMS = "item_id bigint, text string"


def _words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def _plain(text, items):
    w, hit, names = _words(text), set(), set()
    for item, t in items:
        b = _words(t)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if b else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(item))
    return len(w), sorted(hit), sorted(names)


def _case():
    rnd = random.Random(1)
    items = [(i, prose(rnd, n)) for i, n in enumerate((40, 13, 12, 5, 1, 60, 20))] + [(50, None), (51, ""), (52, "..."), (10, prose(rnd, 30))]
    words = [t.split() for _, t in items if t]
    texts = awkward(rnd)
    for _ in range(40):
        b = rnd.choice(words)
        a = rnd.randrange(len(b))
        texts.append(prose(rnd, rnd.randint(0, 60)) + " " + ", ".join(b[a : a + rnd.randint(1, 30)]).upper() + "! " + prose(rnd, rnd.randint(0, 60)))
    return texts, items


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 300])
def test_hits_equal_brute_force(spark, block_bytes):
    texts, items = _case()
    found = dc.hits(frame(spark, texts), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes).collect()
    got = {r.doc_id: (r.n_words, list(r.hit_words), list(r.hit_items)) for r in found}
    assert got == {i: _plain(t, items) for i, t in enumerate(texts)}


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 100])
def test_items_without_an_id_equal_the_sql(spark, tmp_path, monkeypatch, block_bytes):
    texts, items = _case()
    texts, items = [*texts, "ka1 ka2 ka3"], [(None if i % 2 else i, t) for i, t in items] + [(None, "Ka1 ka2, ka3"), (None, None)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = dc.hits
    monkeypatch.setattr(dc, "hits", lambda *a: hits(*a, block_bytes=block_bytes))
    got = sorted(tuple(r) for r in dc.op9_decontamination(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(db.sql(dc.SQL).fetchall())
    none = hashlib.sha256(b"").hexdigest()
    assert (len(texts) - 1, 3, 3, 1, none, True) in got  # only an item without an id hits it


def test_removal(spark):
    texts, items = _case()
    docs, bench = frame(spark, texts), spark.createDataFrame(items, ITEMS)
    kept = {r.doc_id for r in dc.remove_documents(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = _plain(t, items)
        assert (i in kept) == (not hit or 20 * len(hit) < n)
    cut = {r.doc_id: r.text for r in dc.remove_spans(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = _plain(t, items)
        assert _words(cut[i]) == [w for k, w in enumerate(_words(t)) if k not in set(hit)] and (hit or cut[i] == t)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert dc.hits(frame(spark, ["a b"]), none).first().hit_words == []
    assert dc.hits(frame(spark, []), none).count() == 0


@pytest.mark.parametrize("block_bytes", [dc.BLOCK_BYTES, 100])
def test_columns_of_the_same_names(spark, block_bytes):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = frame(spark, [item, "quite clean", None]).selectExpr("*", "doc_id + 70 AS n_words", "'x' AS hit_words", "'y' AS hit_items", "1 AS row", "2 AS n")
    bench = spark.createDataFrame([(1, item), (2, "other " + item)], ITEMS)
    kept = dc.remove_documents(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted(r.n_words for r in kept.collect()) == [71, 72]
    cut = dc.remove_spans(docs, bench, block_bytes=block_bytes)
    assert cut.columns == docs.columns and sorted((r.n_words, r.text) for r in cut.collect()) == [(70, ""), (71, "quite clean"), (72, None)]
    assert {r.doc_id: (r.n_words, list(r.hit_items)) for r in dc.hits(docs, bench, block_bytes=block_bytes).collect()} == {0: (13, ["1", "2"]), 1: (2, []), 2: (0, [])}


def test_a_long_text_and_a_window_of_many_items(spark):
    rnd = random.Random(3)
    item = prose(rnd, 20)
    text = prose(rnd, 400_000) + " " + item + " " + prose(rnd, 1000)
    found = dc.WindowSet([(str(i), item) for i in range(500)] + [("own", "zz " + item)]).scan(text)
    assert found[0] == 401_020 and found[1].tolist() == list(range(400_000, 400_020)) and len(found[2]) == 501


def test_blocks_are_bounded_for_any_item_ids(spark):
    """One item id on every row, and one text longer than a block."""
    rnd = random.Random(8)
    items = [("task", prose(rnd, rnd.randint(1, 30))) for _ in range(200)] + [("task", prose(rnd, 900)), (None, prose(rnd, 400))]
    frame_ = spark.createDataFrame(items, "item_id string, text string")
    blocks = dc._blocks(frame_, "item_id", "text", 1000, 13)
    held = [[(r.item, r.text) for r in b.collect()] for b in blocks]
    sizes = [sum(len(t.encode()) for _, t in b) for b in held]
    assert len(blocks) > 10 and max(sizes) <= 1000 and min(map(len, held)) > 0
    windows = lambda texts: {(i, tuple(w[k : k + 13])) for i, t in texts for w in [_words(t)] for k in range(max(1, len(w) - 12))}
    assert windows(x for b in held for x in b) == windows(items)
    texts = [prose(rnd, 20) + " " + " ".join(t.split()[a : a + 25]) for _, t in items[190:] for a in (0, 5, 300)]
    found = dc.hits(frame(spark, texts), frame_, block_bytes=1000).collect()
    for r in found:
        n, hit, _ = _plain(texts[r.doc_id], items)
        assert (r.n_words, list(r.hit_words)) == (n, hit)
    assert {tuple(r.hit_items) for r in found} <= {("task",), (None,), ("task", None), ()}


def test_pieces_of_a_text_keep_its_windows():
    rnd = random.Random(9)
    for n, width, size in ((5, 13, 10), (27, 13, 10), (28, 13, 10), (200, 13, 100), (1000, 4, 300), (60, 1, 7)):
        text = prose(rnd, n)
        whole = _words(text)
        cut = [_words(p) for p in dc.pieces(text, width, size)]
        assert {tuple(w[k : k + width]) for w in cut for k in range(max(1, len(w) - width + 1))} == {tuple(whole[k : k + width]) for k in range(max(1, n - width + 1))}
        assert all(len(w) >= min(width, n) for w in cut)
