"""Queries of the MRZ operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import mrz as M
from leafmark.functions.text import sanitize
from leafmark.operators import mrz as P
from leafmark.operators.export import crew_list
from leafmark.sources import derived


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse(P.page_rows(derived.view(spark, sf_dir, "mrz_input")))


def mrz_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.view(spark, sf_dir, "mrz_input").where("row_index = 2").select("doc_id", sanitize(F.col("raw_text")).alias("row")).where("length(row) = 44")
    return rows.select("doc_id", F.explode(M.td3_checks("row")).alias("c")).select("doc_id", "c.field", "c.value", "c.expected", "c.valid")


def mrz_parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", "status", "format", F.concat_ws(",", "reasons").alias("reasons"), F.size("rows").cast("bigint").alias("n_rows"))


def mrz_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("doc_id", "method", "row_order", "recovery", F.concat_ws("|", "rows").alias("rows"))


def mrz_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).where(F.col("status").isin("valid", "partial")).select("doc_id", *(F.col(f"fields.{c}").alias(c) for c in M.FIELDS))


def mrz_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(parsed(spark, sf_dir))


def mrz_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = {"document": F.concat(F.lit("crew "), (F.col("doc_id") % 97).cast("string")), "page_number": F.col("doc_id")}
    pages = derived.view(spark, sf_dir, "mrz_input").select("doc_id").distinct().withColumns(placed)
    return crew_list(parsed(spark, sf_dir).withColumns(placed), pages)


# The same in DuckDB, written as candidate rows instead of arrays.
def _clean(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9<]', '', 'g')"


def _cd(v: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN ({v})[i] = '<' THEN 0 ELSE instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', ({v})[i]) - 1 END * (CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END))) % 10 AS VARCHAR)"


_PARTS = {
    "passport_number": ("{s}[1:9]", 10),
    "date_of_birth": ("{s}[14:19]", 20),
    "date_of_expiry": ("{s}[22:27]", 28),
    "optional_data": ("{s}[29:42]", 43),
    "composite": ("({s}[1:10] || {s}[14:20] || {s}[22:43])", 44),
}


def _check(field: str, s: str) -> str:
    part, at = _PARTS[field]
    return f"({s}[{at}] = {_cd(part.format(s=s))})"


def _all(s: str, fields=tuple(_PARTS)) -> str:
    return "(" + " AND ".join(_check(f, s) for f in fields) + ")"


_TEXTS = f"""
mrz_in AS ({derived.oracle("mrz_input")}),
texts AS (SELECT doc_id, list(t ORDER BY row_index) FILTER (t <> '') AS t FROM (SELECT doc_id, row_index, {_clean("raw_text")} AS t FROM mrz_in) GROUP BY doc_id),
split AS (
  SELECT doc_id, CASE WHEN len(t) = 1 AND length(t[1]) = 88 THEN [t[1][1:44], t[1][45:88]] WHEN len(t) = 1 AND length(t[1]) = 72 THEN [t[1][1:36], t[1][37:72]]
      WHEN len(t) = 1 AND length(t[1]) = 90 THEN [t[1][1:30], t[1][31:60], t[1][61:90]] ELSE t END AS r,
    CASE WHEN len(t) = 1 AND length(t[1]) IN (88, 72, 90) THEN 'split_concatenated_row' ELSE 'row_results' END AS method
  FROM texts
),
page AS (
  SELECT doc_id, method, CASE WHEN turned THEN [r[2], r[1]] ELSE r END AS r, CASE WHEN turned THEN 'swapped' END AS row_order
  FROM (SELECT *, len(r) = 2 AND length(r[1]) = 44 AND length(r[2]) = 44 AND r[2][1:2] = 'P<' AND r[1][1:2] <> 'P<' AS turned FROM split)
),
pair AS (
  SELECT doc_id, CASE WHEN r[2][1] = 'P' AND r[1][1] <> 'P' THEN r[2] ELSE r[1] END AS a, CASE WHEN r[2][1] = 'P' AND r[1][1] <> 'P' THEN r[1] ELSE r[2] END AS b
  FROM page WHERE len(r) = 2
),
a0 AS (
  SELECT doc_id, 1 AS o, a AS x, [] AS m FROM pair
  UNION ALL SELECT doc_id, 2, rpad(a, 44, '<'), ['validated_filler_padding'] FROM pair WHERE length(a) BETWEEN 15 AND 43 AND a[1] = 'P'
),
firsts AS (
  SELECT * FROM a0 UNION ALL
  SELECT doc_id, o + 2, 'P<' || x[3:44], list_append(m, 'validated_structural_marker') FROM a0 WHERE x[1] = 'P' AND length(x) = 44 AND x[2] NOT IN ('<', 'M')
),
doubt AS (
  SELECT doc_id, b FROM pair WHERE length(b) = 44 AND NOT {_check("passport_number", "b")} AND NOT {_check("composite", "b")} AND {_all("b", ("date_of_birth", "date_of_expiry", "optional_data"))}
),
seconds AS (
  SELECT doc_id, 0 AS o, b AS y, [] AS m FROM pair
  UNION ALL SELECT doc_id, 1, b[1:42] || '0' || b[44], ['validated_optional_data_check'] FROM pair WHERE length(b) = 44 AND b[29:43] = '<<<<<<<<<<<<<<<' AND regexp_matches(b[44], '[0-9]')
  UNION ALL SELECT doc_id, 1 + i, b[1:i-1] || translate(b[i], 'HWO0I1B8Z2', 'WH0O1I8B2Z') || b[i+1:44], ['validated_passport_character_correction'] FROM doubt, range(1, 10) AS n(i) WHERE instr('HWO0I1B8Z2', b[i]) > 0
),
tried AS (
  SELECT doc_id, f.o * 100 + s.o AS o, [x, y] AS r, array_to_string(list_concat(f.m, s.m), '+') AS m FROM firsts AS f JOIN seconds AS s USING (doc_id) WHERE len(f.m) + len(s.m) > 0
  UNION ALL
  SELECT doc_id, i, [rpad(r[1][1:i], 44, '<'), rpad(r[1][i+1:], 44, '<')], 'validated_concatenated_split' FROM page, range(40, 45) AS n(i)
  WHERE len(r) = 1 AND length(r[1]) BETWEEN 80 AND 88 AND r[1][1] = 'P' AND length(r[1]) - i <= 44
),
proven AS (
  SELECT doc_id, arg_min(r, o) AS r, arg_min(m, o) AS m FROM tried WHERE length(r[1]) = 44 AND length(r[2]) = 44 AND r[1][1] = 'P' AND r[1][2] IN ('<', 'M') AND {_all("r[2]")} GROUP BY doc_id
),
routed AS (
  SELECT page.doc_id, method, row_order, proven.m AS m, page.r AS r0, proven.r AS r1,
    CASE WHEN len(page.r) = 2 AND page.r[1][1:2] = 'PM' AND length(page.r[1]) BETWEEN 15 AND 43 AND length(page.r[2]) = 44 THEN [rpad(page.r[1], 44, '<'), page.r[2]] END AS r2
  FROM page LEFT JOIN proven USING (doc_id)
),
route AS (
  SELECT *, CASE WHEN len(r0) = 0 OR r0 IS NULL THEN 'none' WHEN r1 IS NOT NULL THEN 'repair' WHEN r2 IS NOT NULL AND {_all("r2[2]", M.ESSENTIAL)} THEN 'padded'
    WHEN len(r0) = 2 AND length(r0[1]) = 44 AND length(r0[2]) = 44 THEN 'plain'
    WHEN len(r0) = 2 AND length(r0[1]) = 36 AND length(r0[2]) = 36 THEN 'TD2' WHEN len(r0) = 3 AND length(r0[1]) = 30 AND length(r0[2]) = 30 AND length(r0[3]) = 30 THEN 'TD1' ELSE 'shape' END AS way
  FROM routed
),
final AS (SELECT *, CASE way WHEN 'repair' THEN r1 WHEN 'padded' THEN r2 ELSE r0 END AS r FROM route),
judged AS (
  SELECT *, CASE WHEN way = 'none' THEN 'incomplete' WHEN way = 'shape' THEN CASE WHEN len(r0) IN (2, 3) THEN 'unsupported_format' ELSE 'incomplete' END WHEN way IN ('TD1', 'TD2') THEN 'unsupported_format'
    WHEN {_all("r[2]")} THEN 'valid' WHEN way = 'padded' OR (r0[1][1:2] = 'PM' AND {_all("r[2]", M.ESSENTIAL)}) THEN 'partial' ELSE 'invalid' END AS status
  FROM final
)
"""

_FIELDS_SQL = """
fields AS (
  SELECT *, r[1][1:2] AS document_code, r[1][3:5] AS issuing_state, trim(replace(CASE WHEN instr(nf, '<<') > 0 THEN nf[1:instr(nf, '<<')-1] ELSE nf END, '<', ' ')) AS surname,
    CASE WHEN instr(nf, '<<') > 0 THEN trim(replace(nf[instr(nf, '<<')+2:], '<', ' ')) ELSE '' END AS given_names,
    rtrim(r[2][1:9], '<') AS passport_number, r[2][11:13] AS nationality, r[2][14:19] AS date_of_birth,
    CASE r[2][21] WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' WHEN '<' THEN 'unspecified' ELSE 'unknown' END AS sex, r[2][21] AS sex_code, r[2][22:27] AS date_of_expiry, rtrim(r[2][29:42], '<') AS optional_data
  FROM (SELECT *, rtrim(regexp_replace(r[1][6:44], '<{3}[A-Z0-9].*$', ''), '<') AS nf FROM judged)
)
"""

_EXPORT_SQL = f"""
WITH {_TEXTS}, {_FIELDS_SQL}, code AS (
  SELECT *, status IN ('valid', 'partial') AS good, translate(upper(nationality), '01', 'OI') AS c3,
    try_strptime(CASE WHEN CAST(date_of_birth[1:2] AS INT) >= 50 THEN '19' ELSE '20' END || date_of_birth, '%Y%m%d') AS born
  FROM fields
), named AS (SELECT *, CASE c3 WHEN 'FRA' THEN 'FR' WHEN 'ESP' THEN 'ES' WHEN 'GBR' THEN 'GB' ELSE c3 END AS c2 FROM code)
SELECT row_number() OVER (ORDER BY 'crew ' || CAST(doc_id % 97 AS VARCHAR), doc_id) AS seq,
  CASE WHEN good THEN array_to_string(list_filter([surname, given_names], lambda x: x <> ''), ' ') ELSE '' END AS name,
  CASE WHEN good THEN CASE sex_code WHEN 'M' THEN '1-男' WHEN 'F' THEN '0-女' END END AS sex,
  CASE WHEN good THEN CASE c2 WHEN 'FR' THEN 'FR-法国' WHEN 'ES' THEN 'ES-西班牙' WHEN 'GB' THEN 'GB-英国' ELSE nullif(c2, '') END END AS nationality,
  CAST(NULL AS VARCHAR) AS duty,
  CASE WHEN good THEN CAST(date_diff('day', DATE '1899-12-30', CAST(born AS DATE)) AS INT) END AS birth_serial, CAST(NULL AS VARCHAR) AS birth_place,
  CASE WHEN good THEN CASE document_code WHEN 'P<' THEN '14-普通护照' WHEN 'PM' THEN '17-海员证' END END AS document_kind,
  CASE WHEN good THEN nullif(passport_number, '') END AS document_number, CASE WHEN status = 'partial' THEN 'MRZ校验需复核' END AS remark,
  CAST(NULL AS VARCHAR) AS landing, CAST(NULL AS VARCHAR) AS boarding_date, CAST(NULL AS VARCHAR) AS boarding_port
FROM named
"""

_CHECK_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, s[{at}] AS value, {_cd(part.format(s='s'))} AS expected, {_check(f, 's')} AS valid FROM s" for f, (part, at) in _PARTS.items())

QUERIES = {f.__name__: f for f in (mrz_check_digits, mrz_parse_status, mrz_recovery, mrz_fields, mrz_summary, mrz_export)}
ORACLES = {
    "mrz_check_digits": f"WITH s AS (SELECT doc_id, {_clean('raw_text')} AS s FROM ({derived.oracle('mrz_input')}) WHERE row_index = 2 AND length({_clean('raw_text')}) = 44) {_CHECK_ROWS}",
    "mrz_parse_status": f"""WITH {_TEXTS} SELECT doc_id, status, CASE WHEN way IN ('repair', 'padded', 'plain') THEN 'TD3' WHEN way IN ('TD1', 'TD2') THEN way END AS format,
        CASE WHEN way = 'none' THEN 'no_mrz_rows' WHEN way = 'shape' THEN 'unsupported_or_incomplete_row_lengths' WHEN way IN ('TD1', 'TD2') THEN 'td3_parser_only'
          WHEN status = 'partial' THEN 'check_digit_failed,optional_or_composite_check_failed' WHEN status = 'invalid' THEN 'check_digit_failed' ELSE '' END AS reasons,
        CAST(len(r) AS BIGINT) AS n_rows FROM judged""",
    "mrz_recovery": f"WITH {_TEXTS} SELECT doc_id, method, row_order, CASE way WHEN 'repair' THEN m WHEN 'padded' THEN 'pm_filler_padding' END AS recovery, array_to_string(r, '|') AS rows FROM judged",
    "mrz_fields": f"WITH {_TEXTS}, {_FIELDS_SQL} SELECT doc_id, {', '.join(M.FIELDS)} FROM fields WHERE status IN ('valid', 'partial')",
    "mrz_summary": f"WITH {_TEXTS} SELECT status, count(*) AS pages FROM judged GROUP BY status",
    "mrz_export": _EXPORT_SQL,
}
