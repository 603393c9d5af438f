import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmark.llm import secrets
from tests.llm.helpers import awkward, frame, prose


def _plain(text, rules=secrets.RULES):
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if m.end(r.group) - m.start(r.group) >= r.least)


CASES = [
    'password = "hunter2hunter2"', "PASSWD:abcdefghijkl", "api_key=abc", "ApiKey: 0123456789abcdef01", "secret=token:abcdefghijklmnop", "token='x' secret=abcdefghijklm=", "AKIA" + "A" * 14, "AKIA" + "A" * 13,
    "deadbeef" * 2, "deadbee " * 3, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "xoxb-1234567890-x", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "https://me:secretpw@host/", "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", "é字 token=abcdefghijklmnop",
]


def test_spans_equal_a_full_scan():
    rnd = random.Random(1)
    texts = CASES + [t or "" for t in awkward(rnd)]
    texts += [" ".join(rnd.sample(CASES, 3)) + prose(rnd, 50) for _ in range(50)]
    assert secrets.Scanner().spans(texts) == [_plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="paswordtokenAKI=:\"' _key0af9ſK", max_size=60), min_size=1, max_size=5))
def test_index_loses_nothing(texts):
    assert secrets.Scanner().spans(texts) == [_plain(t) for t in texts]


def test_queries():
    assert secrets.trigram_query("abcd") == ("and", [b"abc", b"bcd"])
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("ab|cdef") is True
    assert secrets.trigram_query("(abc|xyz)q?") == ("or", [b"abc", ("and", [b"abc", b"bcq"]), b"xyz", ("and", [b"xyz", b"yzq"])])
    assert secrets.trigram_query("a{3}") == b"aaa" and secrets.trigram_query("(abc)*") is True and secrets.trigram_query("(abc)+") == b"abc"


def test_contract_columns(spark):
    import hashlib

    texts = [*CASES, None, ""]
    got = {r.doc_id: r for r in secrets.digest(secrets.scan(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = _plain(t or "", secrets.BASE)
        names = [r.kind for r in secrets.RULES]
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert got[i].spans == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in _plain(t or ""))


def test_redaction(spark):
    docs = frame(spark, ["a token=abcdefghijklmnop b", "clean", None])
    got = {r.doc_id: r for r in secrets.redact(docs, length="n_chars").collect()}
    assert got[0].text == "a [SECRET] b" and got[0].n_chars == 12 and got[1].text == "clean" and got[2].text is None
    assert secrets.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_rules_without_trigrams_scan_fully(rule):
    assert (secrets.trigram_query(rule.pattern) is True) == (rule.kind == "hex")


def test_rules_that_fold_other_letters_scan_fully():
    for pattern in ("(?i)secret[a-z]+", "(?i:secret)[a-z]+", "x(?i:k)ey"):
        assert secrets.trigram_query(pattern) is True
    rules = (secrets.Rule("own", "(?i)secret[a-z]+"),)
    texts = ["ſecretabc", "ſEcretabc x", "SECRETx", "sécretab"]
    assert secrets.Scanner(rules).spans(texts) == [_plain(t, rules) for t in texts] and secrets.Scanner(rules).spans(texts)[0]


def test_columns_of_the_same_names_and_a_long_text(spark):
    docs = frame(spark, ["a token=abcdefghijklmnop b"]).selectExpr("*", "1 AS found", "2 AS kind", "3 AS spans")
    assert secrets.redact(docs, length="n_chars").first().found == 1 and len(secrets.scan(docs).first().found) == 1
    text = "x y " * 1_000_000 + "token=abcdefghijklmnop"
    assert secrets.Scanner().spans([text]) == [[(4_000_000, 0, 4_000_022)]]
