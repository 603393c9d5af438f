"""Record-shaped inputs derived from the driver's tables.

Each view is one SELECT that Spark and DuckDB both read, with {table} where a table stands, so that the queries and the SQL that
checks them start from the same rows. Only inputs are shared; the operators are written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(text: str, n: int) -> str:
    """The check digit of the first n characters, written out."""
    terms = (f"{(7, 3, 1)[i % 3]} * greatest(instr('{_ALPHABET}', substr({text}, {i + 1}, 1)) - 1, 0)" for i in range(n))
    return f"CAST(({' + '.join(terms)}) % 10 AS STRING)"


_PEOPLE = f"""
SELECT k, state, name_row, number, number || {_digit("number", 9)} AS number_part, birth || {_digit("birth", 6)} AS birth_part, sex,
  expiry || {_digit("expiry", 6)} AS expiry_part, optional || {_digit("optional", 14)} AS optional_part, optional
FROM (
  SELECT c_custkey AS k, state, rpad('P<' || state || translate(lpad(CAST(c_custkey AS STRING), 6, '0'), '0123456789', 'ABCDEFGHIJ') || '<<' || c_mktsegment, 44, '<') AS name_row,
    'W' || lpad(CAST(c_custkey AS STRING), 8, '0') AS number,
    lpad(CAST(c_custkey * 7 % 100 AS STRING), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || lpad(CAST(c_custkey % 31 + 1 AS STRING), 2, '0') AS birth,
    CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '<' END AS sex,
    lpad(CAST(c_custkey % 15 + 20 AS STRING), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS STRING), 2, '0') || lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0') AS expiry,
    CASE WHEN c_custkey % 4 = 0 OR c_custkey % 10 = 5 THEN '<<<<<<<<<<<<<<' ELSE 'A' || lpad(CAST(c_custkey AS STRING), 7, '0') || '<<<<<<' END AS optional
  FROM (SELECT c_custkey, c_mktsegment, CASE c_nationkey % 5 WHEN 0 THEN 'UTO' WHEN 1 THEN 'D<<' WHEN 2 THEN 'FRA' WHEN 3 THEN 'ESP' ELSE 'G8R' END AS state FROM {{customer}}) AS c
) AS p
"""

_FULL = f"""
SELECT k, name_row, number_part || state || birth_part || sex || expiry_part || optional_part AS body,
  {_digit("(number_part || birth_part || expiry_part || optional_part)", 39)} AS composite
FROM ({_PEOPLE}) AS q
"""

#: By the last digit of the key: 0 intact, 1 both rows in one, 2 the same turned round, 3 a short name row, 4 a wrong marker, 5 a blank
#: optional check digit, 6 a confused letter, 7 a wrong composite digit, 8 a PM document with a wrong optional digit, 9 short rows.
_ROWS = f"""
SELECT k, CASE k % 10
    WHEN 1 THEN name_row || body || composite WHEN 2 THEN body || composite || name_row WHEN 3 THEN substr(name_row, 1, 40)
    WHEN 4 THEN 'PC' || substr(name_row, 3, 42) WHEN 8 THEN 'PM' || substr(name_row, 3, 42) WHEN 9 THEN substr(name_row, 1, 36) ELSE name_row END AS first_row,
  CASE k % 10
    WHEN 1 THEN '' WHEN 2 THEN '' WHEN 5 THEN substr(body, 1, 42) || '<' || composite WHEN 6 THEN 'H' || substr(body, 2, 42) || composite
    WHEN 7 THEN body || CAST((CAST(composite AS INT) + 1) % 10 AS STRING)
    WHEN 8 THEN substr(body, 1, 42) || CAST((instr('0123456789', substr(body, 43, 1)) + 2) % 10 AS STRING) || composite
    WHEN 9 THEN substr(body, 1, 36) ELSE body || composite END AS second_row
FROM ({_FULL}) AS f
"""

MRZ_INPUT = f"""
SELECT k AS doc_id, n AS row_index, CASE WHEN n = 1 THEN lower(first_row) ELSE second_row END AS raw_text, CAST(NULL AS STRING) AS normalized_text
FROM ({_ROWS}) AS r CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n) AS two
"""

#: The page of every document is 1000 wide; a line is 40 high. Corners are given as extents.
PAGE_WIDTH = 1000
OCR_LINE = """
SELECT doc_id, idx, text, confidence, x, y, x + w AS x2, y + h AS y2, CAST(greatest(n, 1) * 40 AS INT) AS page_height FROM (
  SELECT doc_id, idx, CASE WHEN coded THEN upper(replace(replace(text, ' ', '<'), '.', '<')) || CAST(doc_id % 10 AS STRING) ELSE text END AS text,
    (30 + ((doc_id * 31 + idx * 17) % 70)) / 100e0 AS confidence,
    CAST(20 + doc_id % 7 + (idx % 3) * 5 AS INT) AS x, CAST(40 * idx - CASE WHEN idx % 4 = 3 THEN 30 ELSE 0 END AS INT) AS y,
    CAST(least(8 * length(text), 900) AS INT) AS w, 24 AS h, n
  FROM ({lines}) AS l
) AS m
"""
#: Every fifth line of a text is cut into pieces of this length, which are coded lines.
PIECE = 40


def _once(expression: str, name: str, rows: str) -> str:
    """doc_id and the expression of rows, made once whatever it is used for: as a plain column it is put in the place of each use, and into a
    condition that an inner explode takes to the reading of the table."""
    return f"SELECT doc_id, col AS {name} FROM (SELECT doc_id, array({expression}) AS held FROM {rows}) AS h LATERAL VIEW OUTER explode(held) AS col"


def lines(dialect: str) -> str:
    """doc_id, idx (from 0), text, whether it is a piece of a coded line, and the number of lines n of the documents."""
    if dialect == "spark":
        pieces = f"transform(sequence(0, greatest(CAST(ceil(length(t) / {PIECE}) AS INT) - 1, 0)), k -> named_struct('text', substr(t, k * {PIECE} + 1, {PIECE}), 'coded', true))"
        parts = f"flatten(transform(split(replace(text, 'ß', 'ss'), '\\n'), (t, i) -> CASE WHEN i % 5 = 3 THEN {pieces} ELSE array(named_struct('text', t, 'coded', false)) END))"
        return f"SELECT doc_id, CAST(pos AS BIGINT) AS idx, col.text AS text, col.coded AS coded, n FROM (SELECT doc_id, parts, size(parts) AS n FROM ({_once(parts, 'parts', '{documents}')}) AS d) AS c LATERAL VIEW OUTER posexplode(parts) AS pos, col WHERE pos IS NOT NULL"
    pieces = f"list_transform(range(0, greatest(CAST(ceil(length(t) / {PIECE}) AS BIGINT), 1)), lambda k: {{'text': substr(t, k * {PIECE} + 1, {PIECE}), 'coded': true}})"
    parts = f"flatten(list_transform(string_split(replace(text, 'ß', 'ss'), chr(10)), lambda t, i: CASE WHEN i % 5 = 4 THEN {pieces} ELSE [{{'text': t, 'coded': false}}] END))"
    return f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS idx, parts[i].text AS text, parts[i].coded AS coded, len(parts) AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {parts} AS parts FROM {{documents}}) AS d) AS e"


#: A page of pixels is 48 words wide and 64 high; a word is a pixel, the darker the longer it is, and a page's last row ends in white ones.
RASTER_WIDTH, RASTER_PAGE = 48, 48 * 64


def word_pages(dialect: str) -> str:
    """key (doc_id and number of the page), pw and px, the gray values row by row, of the pages of all texts."""
    if dialect == "spark":
        words = "transform(filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> ''), w -> 255 - 20 * least(length(w), 12))"
        filled = f"concat(gray, array_repeat(255, CAST(pmod(-size(gray), {RASTER_WIDTH}) AS INT)))"
        cut = f"transform(sequence(0, CAST((size(gray) - 1) DIV {RASTER_PAGE} AS INT)), p -> slice(gray, p * {RASTER_PAGE} + 1, {RASTER_PAGE}))"
        gray = _once(words, "gray", "{documents}")
        whole = _once(filled, "gray", f"({gray}) AS w")
        return f"SELECT doc_id * 1000000 + pos AS key, {RASTER_WIDTH} AS pw, col AS px FROM (SELECT doc_id, {cut} AS pages FROM ({whole}) AS f) AS c LATERAL VIEW OUTER posexplode(pages) AS pos, col WHERE size(col) > 0"
    words = "list_transform(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+'), lambda w: CAST(255 - 20 * least(length(w), 12) AS INT))"
    filled = f"list_concat(gray, list_transform(range(0, (({RASTER_WIDTH} - len(gray) % {RASTER_WIDTH}) % {RASTER_WIDTH})), lambda z: 255::INT))"
    return f"SELECT doc_id * 1000000 + p AS key, {RASTER_WIDTH} AS pw, gray[p * {RASTER_PAGE} + 1:(p + 1) * {RASTER_PAGE}] AS px FROM (SELECT doc_id, gray, unnest(range(0, (len(gray) - 1) // {RASTER_PAGE} + 1)) AS p FROM (SELECT doc_id, {filled} AS gray FROM (SELECT doc_id, {words} AS gray FROM {{documents}}) AS w) AS f WHERE len(gray) > 0) AS c"


GROUND_TRUTH = """
SELECT 'set' || CAST(doc_id % 4 AS STRING) || '/Crew book ' || CAST(doc_id % 23 AS STRING) || '.pdf' AS source_file, CAST(doc_id AS INT) AS source_page, quality = 1 AS contains_data_page,
  CAST(CASE WHEN doc_id % 13 = 0 THEN 90 ELSE 0 END AS INT) AS rotation
FROM {labels}
"""
PREDICTION = """
SELECT CASE WHEN doc_id % 11 = 0 THEN 'Unsorted' ELSE 'Crew_book_' || CAST(doc_id % 23 AS STRING) END AS document, CAST(doc_id AS INT) AS page, n_chars % 7 > 1 AS selected,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 90 WHEN doc_id % 13 = 0 THEN 90 ELSE 0 END AS INT) AS rotation,
  CAST(n_chars % 100 AS DOUBLE) AS score_1, CAST((n_chars + doc_id % 9) % 100 AS DOUBLE) AS score_2, n_chars % 5 > 0 AS ocr_safe, CAST(n_chars % 1000 AS DOUBLE) AS elapsed_ms
FROM {documents}
"""
REVIEW_EVENT = """
SELECT 'set' || CAST(doc_id % 4 AS STRING) || '/Crew book ' || CAST(doc_id % 23 AS STRING) || '.pdf' AS source_file, CAST(doc_id AS INT) AS source_page, n AS seq,
  CASE WHEN (doc_id + n) % 4 = 0 THEN 'incorrect' ELSE 'correct' END AS review,
  CASE WHEN (doc_id + n) % 4 = 0 AND doc_id % 8 <> 0 THEN CASE doc_id % 3 WHEN 0 THEN 'crop' WHEN 1 THEN 'rotation' ELSE 'ocr' END END AS failure_reason,
  doc_id % 5 > 0 AS has_quality, doc_id % 2 = 0 OR n = 1 AS page_complete, doc_id % 7 > 0 AS portrait_complete, doc_id % 9 > 0 AS mrz_complete, n <> 2 AS ocr_ready
FROM (SELECT doc_id FROM {labels}) AS d CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 AS n UNION ALL SELECT 3 AS n) AS three WHERE n <= doc_id % 4
"""
JOB_EVENT = """
SELECT user_id % 50 AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'status' WHEN 'click' THEN 'artifact' WHEN 'purchase' THEN 'mrz_page' ELSE 'log' END AS type,
  'page' || CAST(event_id % 40 AS STRING) AS item, CAST(floor(value) AS BIGINT) % 3 AS size, CAST(event_id % 4 AS BIGINT) AS stamp
FROM {events}
"""

#: What the rows of the views' tables are dealt by, and what they weigh. A file may be one row group, which one task reads: what costs time or
#: memory comes after rows are dealt, to as many tasks as their weight asks for.
_DEALT = {"documents": ("doc_id", "coalesce(octet_length(text), 0) + 200"), "customer": ("c_custkey", "200")}
#: Weight for a task, that for a task of few (SPREAD at most), and the views whose tables are dealt.
TASK, LEAST_TASK, SPREAD = 4 << 20, 1 << 20, 32
_DEALT_VIEWS = ("word_page", "ocr_line", "mrz_input")


def tasks(weight: int, task: int = TASK, least: int = LEAST_TASK) -> int:
    """How many tasks a weight is dealt to: what a task gets stays the same however much there is."""
    return max(1, -(-weight // task), min(SPREAD, -(-weight // least)))


def dealt_to(spark: SparkSession, sf_dir: str, table: str, task: int = TASK) -> int:
    """The tasks that the table's weight asks for."""
    return tasks(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"sum({_DEALT[table][1]})").first()[0] or 0, task)


VIEWS = {"word_page": "{word_pages}", "mrz_input": MRZ_INPUT, "ocr_line": OCR_LINE, "ground_truth": GROUND_TRUTH, "prediction": PREDICTION, "review_event": REVIEW_EVENT, "job_event": JOB_EVENT}


def oracle(name: str) -> str:
    """The view as a DuckDB subquery."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name].replace("{lines}", lines("duckdb")).replace("{word_pages}", word_pages("duckdb")))


def view(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """The view over the tables in sf_dir; those of _DEALT_VIEWS are dealt by their key to so many tasks, or what their weight asks for."""
    text = VIEWS[name].replace("{lines}", lines("spark")).replace("{word_pages}", word_pages("spark"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    if name in _DEALT_VIEWS:
        tables = {t: rows.repartition(parts or dealt_to(spark, sf_dir, t), _DEALT[t][0]) for t, rows in tables.items()}
    return spark.sql(text, **tables)
