import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmark.llm import packing
from tests.llm.helpers import DOCS, awkward, frame, prose

TEXTS = ["", "a  b", "a \n\n b  ", "  x", "it's I'll we've'''s", "<|endoftext|> hi", "12ab½ é—– x\t\ty \r\n", "\xa0 x", "\x85", "$$$ !!! a%%%", "don't 'S", "字 mixed text", "ÀÉ¼ªº", "x" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(packing.tokenizer_path(), 1)
    assert np.frombuffer(e.encode(text), e.dtype).tolist() == _ids(e.tokenizer, text)


def test_encoder_on_set_texts(tokenizer):
    e = packing.encoder(packing.tokenizer_path(), 1)
    for t in [*TEXTS, *awkward(random.Random(1)), prose(random.Random(2), 500)]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == _ids(tokenizer, t)


def _check(rows, texts, tokenizer, length):
    by_doc, taken = defaultdict(list), Counter()
    for r in rows:
        by_doc[r.doc_id].append(r)
        for k in range(r.length):
            taken[r.sequence_id, r.offset + k] += 1
    for i, t in enumerate(texts):
        ids, at = _ids(tokenizer, t), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own.tobytes())) and list(r.piece_ids) == own.tolist()
            at += r.length
        assert at == len(ids)
    total = sum(len(_ids(tokenizer, t)) for t in texts)
    assert set(taken.values()) <= {1} and set(taken) == {(i // length, i % length) for i in range(total)}


@pytest.mark.parametrize("weights", [None, {"s0": 3, "s1": 1}, {"s2": 1, "nothing": 5}])
def test_pieces_fill_sequences(spark, tokenizer, weights):
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randint(0, 60)) for _ in range(80)] + awkward(rnd) + TEXTS
    rows = packing.pack(frame(spark, texts), length=64, weights=weights).collect()
    _check(rows, texts, tokenizer, 64)


def test_windows_hold_the_targets(spark, tokenizer):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(5, 200)) for _ in range(150)]
    source = {i: f"s{i % 3}" if i % 7 else "" for i in range(150)}
    size = Counter()
    for i, t in enumerate(texts):
        size[source[i]] += len(_ids(tokenizer, t))
    rows = packing.pack(frame(spark, texts), length=256).collect()
    window = defaultdict(Counter)
    for r in rows:
        window[r.sequence_id][source[r.doc_id]] += r.length
    last = max(window)
    for w, own in window.items():
        if w < last:
            assert all(abs(own[s] - 256 * size[s] / sum(size.values())) < 2 for s in size)
    # with weights, as long as no queue is dry
    rows = packing.pack(frame(spark, texts), length=256, weights={"s0": 2, "s1": 1, "s2": 1}).collect()
    first = Counter()
    for r in rows:
        if r.sequence_id < 5:
            first[source[r.doc_id]] += r.length
    assert abs(first["s0"] - 640) < 10 and abs(first["s1"] - 320) < 10 and not first[""]


def test_small_sources_keep_their_targets(spark, tokenizer):
    # 1500 sources of one size, none of which gets two tokens a window, and some of a tenth of it
    texts = ["a b c d e f g h i j k l m n o p q r s"] * 1500 + ["a b"] * 30
    docs = spark.createDataFrame([(i, t, "en", f"w{i}", len(t)) for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(docs, length=2048).collect()
    _check(rows, texts, tokenizer, 2048)
    size = [len(_ids(tokenizer, t)) for t in texts]
    every, had, done = sum(size), Counter(), defaultdict(list)
    for r in rows:
        done[r.sequence_id].append(r)
    for w in range(max(done)):
        for r in done[w]:
            had[r.doc_id] += r.length
        assert all(abs(had[i] - (w + 1) * 2048 * n / every) < 5 for i, n in enumerate(size))


def test_one_small_source_is_not_put_last(spark, tokenizer):
    texts = ["a b c d e f g h"] * 1000 + ["x y"]
    docs = spark.createDataFrame([(i, t, "en", "small" if t == "x y" else "large", len(t)) for i, t in enumerate(texts)], DOCS)
    rows = packing.pack(docs, length=64).collect()
    _check(rows, texts, tokenizer, 64)
    own = sorted(r.sequence_id for r in rows if r.doc_id == 1000)
    last = max(r.sequence_id for r in rows)
    assert own[0] < last / 2 and len(own) == len(_ids(tokenizer, "x y"))


def test_weighted_small_source_keeps_its_target():
    # with weights 1 to 400 and windows of 64, the small one has its share at the end of every window
    plan, had = packing.phases([("a", 40000), ("b", 100)], {"a": 400, "b": 1}, 64), Counter()
    for _, size, w, _ in packing.cut(0, 100, plan["b"], 64):
        had[w] += size
    assert all(abs(sum(n for k, n in had.items() if k <= w) - (w + 1) * 64 / 401) < 2 for w in range(40100 // 64))


def test_gaps_are_not_walked():
    plan = packing.phases([("a", 10**15), ("b", 3), ("c", 2)], {}, 2048)
    for q, n in (("b", 3), ("c", 2)):
        assert [p[:2] for p in packing.cut(0, n, plan[q], 2048)] == [(k, 1) for k in range(n)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(0, 14), min_size=1), st.sampled_from([4, 7, 16]))
def test_tiers_tile_all_windows(sizes, length):
    totals = {f"q{k}": 1 + (k * 7919) % (1 << e) for k, e in sizes.items()}
    plan, taken = packing.phases(list(totals.items()), {}, length), Counter()
    every, points = sum(totals.values()), []
    for q, n in totals.items():
        pieces = packing.cut(0, n, plan[q], length)
        assert [p[0] for p in pieces] == [sum(x[1] for x in pieces[:k]) for k in range(len(pieces))] and sum(p[1] for p in pieces) == n
        for start, size, w, offset in pieces:
            taken.update(range(w * length + offset, w * length + offset + size))
            points.append((start + size - 1, w, n))
    assert taken == Counter(range(every))
    # a piece's window is about where its source's share is reached
    assert all(abs(own - (w + 0.5) * length * n / every) <= length * n / every / 2 + 10 for own, w, n in points)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 300), min_size=1), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 4)), st.sampled_from([4, 7, 16]), st.randoms(use_true_random=False))
def test_cuts_tile_all_windows(totals, weights, length, rnd):
    plan, taken = packing.phases(list(totals.items()), weights, length), set()
    for q, n in totals.items():
        at = 0
        while at < n:
            m = min(n - at, rnd.randint(1, 40))
            begun = 0
            for start, size, w, offset in packing.cut(at, m, plan[q], length):
                assert start == begun and size > 0
                begun += size
                for k in range(size):
                    assert (w, offset + k) not in taken
                    taken.add((w, offset + k))
            assert begun == m
            at += m
    assert taken == {(i // length, i % length) for i in range(sum(totals.values()))}


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_only_ranked_merges_use_the_faster_engine():
    import json

    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        said = json.load(f)
    assert packing.plain_ranks(said) and packing.encoder(packing.tokenizer_path(), 1).fast is not None
    merges = said["model"]["merges"]
    for change in (
        {"merges": [merges[1], merges[0], *merges[2:]]},
        {"merges": merges[:-1]},
        {"type": "Unigram"},
        {"dropout": 0.1},
        {"ignore_merges": True},
    ):
        assert not packing.plain_ranks(said | {"model": said["model"] | change})
    assert not packing.plain_ranks(said | {"pre_tokenizer": said["pre_tokenizer"] | {"use_regex": False}})
    assert not packing.plain_ranks(said | {"normalizer": {"type": "NFC"}})


def test_columns_of_the_same_names(spark):
    docs = frame(spark, ["one two", None]).selectExpr("*", "1 AS queue", "2 AS ids", "3 AS start", "4 AS part", "5 AS tier")
    assert sorted(r.doc_tokens for r in packing.pack(docs).collect())[0] == 1
