"""Secret scans over a trigram inverted index.

For each rule a Boolean trigram query is derived from the parsed regular expression: literals, small
character classes, alternatives and optional parts give sets of strings, whatever else gives no demand.
Each task builds the postings of a block of documents (trigram -> documents, as bit rows over the block),
for the trigrams that the queries name, over the block's UTF-8 bytes with A-Z lower-cased; the queries are
evaluated by and/or of postings, and only the candidates are verified by the expression itself, on the
whole text. A rule without mandatory trigrams (the plain hex run) scans every document, and so does one that ignores
case beyond ASCII, as other letters fold to i, k and s there. The index is a superset filter, so the spans are those of a full scan.

Spans count code points, end exclusive. Within a kind they are leftmost and do not overlap; a rule's
`least` is applied to the matches afterwards. Kinds may overlap each other.

Edge cases: null counts as the empty text and has no spans; repeated rows give repeated results; an empty
table gives an empty one; extra columns are ignored by `scan` and carried by `redact`, whatever their names. A very long text is
held as a whole, with 5 bytes a byte of it for the postings.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import column, slices, table

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python 3.10 and before
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds of the contract, in its order. The scoped flags keep to ASCII: (?a) stops other letters from folding to s or k.
BASE = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"(?a)gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("login", r"[a-z]{3,10}://[^/\s:@]{1,64}:[^/\s:@]{3,64}@"),
)
RULES = BASE + MORE

_MOST = 64  # strings that a set may hold before it is turned into a query
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# A query is True (no demand), False (never), a trigram (bytes), or ("and"|"or", [queries]).
def _join(kind: str, parts: list):
    neutral, final = (True, False) if kind == "and" else (False, True)
    out: list = []
    for p in parts:
        if p is final:
            return final
        if p is not neutral and p not in out:
            out.append(p)
    return neutral if not out else out[0] if len(out) == 1 else (kind, out)


def _demand(strings: set[bytes]):
    """What a text must hold that has one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(tree) -> tuple[set[bytes] | None, object]:
    """(the strings that the tree matches, or None if too many; the query that any match satisfies)."""
    strings: set[bytes] | None = {b""}
    whole, queries = True, []
    for op, arg in tree:
        own, query = _node(op, arg)
        if own is not None and len(strings) * len(own) <= _MOST:
            strings = {a + b for a in strings for b in own}
            continue
        queries += [_demand(strings), _demand(own) if own is not None else query]
        strings, whole = {b""}, False
    queries.append(_demand(strings))
    return (strings if whole else None), _join("and", queries)


def _node(op, arg) -> tuple[set[bytes] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).encode().translate(_LOWER)}, True
    if op is sre.IN:
        chars: set[int] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(x)
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars.update(range(x[0], x[1] + 1))
            else:
                return None, True
        return ({chr(c).encode().translate(_LOWER) for c in chars}, True) if len(chars) <= 8 else (None, True)
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and len(union := set().union(*(s for s, _ in parts))) <= _MOST:
            return union, True
        return None, _join("or", [q for _, q in parts])
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, True
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, tree = arg
        own, query = _walk(tree)
        if own is not None and most == 1:
            return (own | {b""} if least == 0 else own), True
        if own is not None and least == most and least and len(own) ** least <= _MOST:
            out = {b""}
            for _ in range(least):
                out = {a + b for a in out for b in own}
            return out, True
        return None, (query if least else True)
    return None, True


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of the pattern satisfies."""
    flags = re.compile(pattern).flags
    if not flags & re.ASCII and (flags & re.IGNORECASE or re.search(r"\(\?[a-zA-Z]*i", pattern)):
        return True  # other letters fold to ASCII ones
    return _walk(sre_parse.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1])) if isinstance(query, tuple) else set()


class Index:
    """The postings of one block of texts for the trigrams named: a bit row over the texts for each trigram."""

    def __init__(self, wanted: list[bytes]):
        self.row = {t: i for i, t in enumerate(wanted)}
        self.of = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for t, i in self.row.items():
            self.of[int.from_bytes(t, "big")] = i + 1

    def build(self, texts: list[bytes]) -> np.ndarray:
        joined = np.frombuffer(b"\xff".join(texts).translate(_LOWER), np.uint8)  # 0xff is in no UTF-8 text
        bits = np.zeros((len(self.row), len(texts)), bool)
        if len(joined) < 3 or not self.row:
            return bits
        code = joined[:-2].astype(np.int32)
        for shift in (1, 2):
            code <<= 8
            code |= joined[shift : len(joined) - 2 + shift]
        found = self.of[code]
        at = np.flatnonzero(found)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        bits[found[at].astype(np.int64) - 1, np.searchsorted(starts, at, "right") - 1] = True
        return bits

    def candidates(self, query, bits: np.ndarray) -> np.ndarray:
        if query is True or query is False:
            return np.full(bits.shape[1], query)
        if isinstance(query, bytes):
            return bits[self.row[query]]
        kind, parts = query
        out = self.candidates(parts[0], bits).copy()
        for p in parts[1:]:
            (np.logical_and if kind == "and" else np.logical_or)(out, self.candidates(p, bits), out=out)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = Index(sorted(set().union(*map(trigrams, self.queries))))
        # [class]+ alone, kept from `least` on, is the same as [class]{least,}: both take the maximal runs
        self.compiled = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^]]*\]\+", r.pattern) and r.least else r.pattern) for r in rules]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end) in order of start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        bits = self.index.build([t.encode() for t in texts])
        for k, (rule, query, expression) in enumerate(zip(self.rules, self.queries, self.compiled)):
            for i in np.flatnonzero(self.index.candidates(query, bits)).tolist():
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for found in out:
            found.sort()
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and found array<struct<kind, start, end>> for every row."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scanner = Scanner(rules)
        for batch in slices(batches, "text", 2 << 20):
            found = scanner.spans([t or "" for t in column(batch, "text").to_pylist()])
            rows = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in own] for own in found]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "found"])

    return out.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns; each stretch of the text that spans cover is replaced by the mark, and the length column follows."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in slices(batches, text, 2 << 20):
            old = column(batch, text).to_pylist()
            new, sizes = list(old), column(batch, length).to_pylist() if length else []
            for i, found in enumerate(scanner.spans([t or "" for t in old])):
                if found:
                    parts, end = [], 0
                    for a, _, b in found:
                        if a >= end:
                            parts += [old[i][end:a], mark]
                        end = max(end, b)
                    new[i] = "".join([*parts, old[i][end:]])
                    if length:
                        sizes[i] = len(new[i])
            changed = {text: pa.array(new, pa.string())} | ({length: pa.array(sizes, column(batch, length).type)} if length else {})
            yield pa.RecordBatch.from_arrays([changed.get(c, column(batch, c)) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE) -> DataFrame:
    """The digest columns of the contract from scan()'s rows."""
    base = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            counts, shas, joined = {k: [] for k in base}, [], []
            for own in column(batch, "found").to_pylist():
                said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in own]
                for k in base:
                    counts[k].append(sum(kind == k for kind, _ in said))
                shas.append(hashlib.sha256(",".join(x for kind, x in said if kind in base).encode()).hexdigest())
                joined.append(",".join(x for _, x in said))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(counts[k], pa.int64()) for k in base), pa.array(shas, pa.string()), pa.array(joined, pa.string())], names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in base) + ", base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES: dict[str, str] = {}
