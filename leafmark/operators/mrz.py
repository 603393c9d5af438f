"""MRZ parsing of pages: rows in, a parse result per document out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import mrz as M


def page_rows(lines: DataFrame) -> DataFrame:
    """doc_id and texts: the rows of each document in order of row_index (lines: doc_id, row_index, normalized_text, raw_text)."""
    text = F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text", F.lit(""))
    held = F.array_sort(F.collect_list(F.struct(F.coalesce("row_index", F.lit(0)).alias("row_index"), text.alias("text"))))
    # by number, so that the few bytes of a page do not merge the partitions: a page's parse is the cost
    dealt = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return dealt.groupBy("doc_id").agg(held.alias("held")).select("doc_id", F.transform("held", lambda x: x["text"]).alias("texts"))


#: Weight of each of a data row's 44 characters in the five checked sums, 12 bits for each sum (44 x 9 x 7 < 4096).
_WEIGHTS = [0] * 44
for _f, (_, _slices, _) in enumerate(M.CHECKED):
    for _n, _i in enumerate(i for start, end in _slices for i in range(start, end)):
        _WEIGHTS[_i] += (7, 3, 1)[_n % 3] << 12 * _f
_SUMS = "aggregate(zip_with(split(translate({y}, '" + M._CHARACTERS + "', '" + M._VALUES + "'), ''), array(" + ", ".join(f"{w}L" for w in _WEIGHTS) + "), (c, w) -> coalesce(try_cast(c AS BIGINT) * w, 0L)), 0L, (s, t) -> s + t)"


def _digits(y: str) -> str:
    """The five check digits that a data row of 44 characters should have, as one text, by a single walk over it; '' for other rows."""
    five = " || ".join(f"CAST((shiftright(z, {12 * f}) & 4095) % 10 AS STRING)" for f in range(len(M.CHECKED)))
    return f"CASE WHEN length({y}) = 44 THEN transform(array({_SUMS.format(y=y)}), z -> {five})[0] ELSE '' END"


def _present(y: str) -> str:
    """The check digits that a data row has, in the same order."""
    return " || ".join(f"substr({y}, {at + 1}, 1)" for _, _, at in M.CHECKED)


_FIRST_OK = "length({x}) = 44 AND startswith({x}, 'P') AND substr({x}, 2, 1) IN ('<', 'M')"
_OTHER = "".join(a + b for a, b in M.CONFUSED) + "".join(b + a for a, b in M.CONFUSED)
_FROM, _TO = _OTHER[0::2], _OTHER[1::2]

#: Rows sanitised, empty ones dropped, one long row parted, a name row first.
_ROWS = """
SELECT *, CASE WHEN swapped THEN array(get(parted, 1), get(parted, 0)) ELSE parted END AS rows, CASE WHEN swapped THEN 'swapped' END AS row_order FROM (
  SELECT *, size(parted) AS n, coalesce(size(parted) = 2 AND length(get(parted, 0)) = 44 AND length(get(parted, 1)) = 44 AND startswith(get(parted, 1), 'P<') AND NOT startswith(get(parted, 0), 'P<'), false) AS swapped FROM (
    SELECT *, CASE {parts} ELSE held END AS parted, CASE WHEN size(held) = 1 AND length(get(held, 0)) IN ({lengths}) THEN 'split_concatenated_row' ELSE 'row_results' END AS method FROM (
      SELECT *, filter(transform({texts}, t -> regexp_replace(upper(t), '[^A-Z0-9<]', '')), x -> x <> '') AS held FROM {pages}
    )
  )
)""".replace("{parts}", " ".join(f"WHEN size(held) = 1 AND length(get(held, 0)) = {n * k} THEN array({', '.join(f'substr(get(held, 0), {i * k + 1}, {k})' for i in range(n))})" for _, n, k in M.FORMATS)).replace("{lengths}", ", ".join(str(n * k) for _, n, k in M.FORMATS))

#: What a page's rows may have been: name rows and data rows with the repair that makes them, the data rows with their check digits.
_OPTIONS = f"""
SELECT *, filter(array(named_struct('text', first, 'how', ''), named_struct('text', padded, 'how', 'validated_filler_padding'),
    named_struct('text', CASE WHEN length(first) = 44 AND startswith(first, 'P') AND substr(first, 2, 1) NOT IN ('<', 'M') THEN 'P<' || substr(first, 3) END, 'how', 'validated_structural_marker'),
    named_struct('text', CASE WHEN substr(padded, 2, 1) NOT IN ('<', 'M') THEN 'P<' || substr(padded, 3) END, 'how', 'validated_filler_padding+validated_structural_marker')), x -> coalesce({_FIRST_OK.format(x="x.text")}, false)) AS firsts,
  transform(array_compact(concat(array(CASE WHEN second IS NOT NULL THEN named_struct('text', second, 'how', '') END,
      CASE WHEN length(second) = 44 AND substr(second, 29, 15) = '<<<<<<<<<<<<<<<' AND substr(second, 44, 1) RLIKE '[0-9]' THEN named_struct('text', substr(second, 1, 42) || '0' || substr(second, 44), 'how', 'validated_optional_data_check') END),
    CASE WHEN length(second) = 44 THEN transform(filter(sequence(1, 9), i -> instr('{_FROM}', substr(second, i, 1)) > 0),
      i -> named_struct('text', substr(second, 1, i - 1) || translate(substr(second, i, 1), '{_FROM}', '{_TO}') || substr(second, i + 1), 'how', 'validated_passport_character_correction')) ELSE array() END,
    transform(splits, x -> named_struct('text', x[1], 'how', x[0])))), y -> named_struct('text', y.text, 'how', y.how, 'digits', {_digits("y.text")}, 'present', {_present("y.text")})) AS seconds
FROM (
  SELECT *, CASE WHEN length(first) BETWEEN 15 AND 43 AND startswith(first, 'P') THEN rpad(first, 44, '<') END AS padded,
    CASE WHEN n = 1 AND length(get(rows, 0)) BETWEEN 80 AND 88 AND startswith(get(rows, 0), 'P') THEN transform(filter(sequence(40, 44), k -> length(get(rows, 0)) - k <= 44), k -> array(rpad(substr(get(rows, 0), 1, k), 44, '<'), rpad(substr(get(rows, 0), k + 1), 44, '<'))) ELSE array() END AS splits
  FROM (SELECT *, CASE WHEN n = 2 THEN CASE WHEN turned THEN get(rows, 1) ELSE get(rows, 0) END END AS first, CASE WHEN n = 2 THEN CASE WHEN turned THEN get(rows, 0) ELSE get(rows, 1) END END AS second
    FROM (SELECT *, coalesce(n = 2 AND startswith(get(rows, 1), 'P') AND NOT startswith(get(rows, 0), 'P'), false) AS turned FROM ({{rows}})))
)"""

#: The first pair that a repair makes and all check digits prove, in the order of the repairs.
_REPAIRED = f"""
SELECT *, get(filter(CASE WHEN n = 2 THEN flatten(transform(firsts, x -> transform(good, y -> named_struct('rows', array(x.text, y.text), 'method', concat_ws('+', nullif(x.how, ''), nullif(y.how, ''))))))
    WHEN n = 1 THEN transform(filter(good, y -> {_FIRST_OK.format(x="y.how")}), y -> named_struct('rows', array(y.how, y.text), 'method', 'validated_concatenated_split')) ELSE array() END, p -> p.method <> ''), 0) AS repair,
  CASE WHEN n = 2 AND startswith(get(rows, 0), 'PM') AND length(get(rows, 0)) BETWEEN 15 AND 43 AND length(get(rows, 1)) = 44 THEN array(rpad(get(rows, 0), 44, '<'), get(rows, 1)) END AS padded_rows,
  substr(get(seconds, 0).digits, 1, {len(M.ESSENTIAL)}) = substr(get(seconds, 0).present, 1, {len(M.ESSENTIAL)}) AS second_essential
FROM (
  SELECT *, filter(seconds, y -> y.digits <> '' AND y.digits = y.present AND (y.how <> 'validated_passport_character_correction' OR doubtful)) AS good FROM (
    SELECT *, coalesce(substr(get(seconds, 0).digits, 1, 1) <> substr(get(seconds, 0).present, 1, 1) AND substr(get(seconds, 0).digits, 5, 1) <> substr(get(seconds, 0).present, 5, 1)
      AND substr(get(seconds, 0).digits, 2, 3) = substr(get(seconds, 0).present, 2, 3), false) AS doubtful FROM ({{options}})
  )
)"""

#: Which way a page goes, and its rows by that way.
_ROUTED = f"""
SELECT *, CASE WHEN route IN ('repair', 'padded', 'plain') THEN get(final, 0) END AS name_row, CASE WHEN route IN ('repair', 'padded', 'plain') THEN get(final, 1) END AS data_row FROM (
  SELECT *, CASE route WHEN 'repair' THEN repair.rows WHEN 'padded' THEN padded_rows ELSE rows END AS final FROM (
    SELECT *, CASE WHEN n = 0 THEN 'none' WHEN repair IS NOT NULL THEN 'repair' WHEN padded_rows IS NOT NULL AND second_essential THEN 'padded' WHEN plain_format IS NULL THEN 'shape' WHEN plain_format <> 'TD3' THEN 'other' ELSE 'plain' END AS route FROM (
      SELECT *, CASE {" ".join(f"WHEN n = {n} AND forall(rows, r -> length(r) = {k}) THEN '{name}'" for name, n, k in M.FORMATS)} END AS plain_format FROM (SELECT inline(array(struct(*))) FROM ({{repaired}}))
    )
  )
)"""

#: Check digits, status and reasons.
_JUDGED = f"""
SELECT {{keep}}, status, CASE WHEN taken THEN 'TD3' WHEN n > 0 THEN plain_format END AS format, final AS rows, method, row_order,
  CASE route WHEN 'repair' THEN repair.method WHEN 'padded' THEN 'pm_filler_padding' END AS recovery, checks, name_row, data_row,
  array_compact(array(CASE WHEN route = 'none' THEN 'no_mrz_rows' END, CASE WHEN route = 'shape' THEN 'unsupported_or_incomplete_row_lengths' END, CASE WHEN route = 'other' THEN 'td3_parser_only' END,
    CASE WHEN taken AND status <> 'valid' THEN 'check_digit_failed' END, CASE WHEN status = 'partial' THEN 'optional_or_composite_check_failed' END)) AS reasons
FROM (
  SELECT *, CASE WHEN route = 'none' THEN 'incomplete' WHEN route = 'shape' THEN CASE WHEN n IN (2, 3) THEN 'unsupported_format' ELSE 'incomplete' END WHEN route = 'other' THEN 'unsupported_format'
    WHEN digits = present THEN 'valid' WHEN route = 'padded' OR (startswith(get(rows, 0), 'PM') AND substr(digits, 1, {len(M.ESSENTIAL)}) = substr(present, 1, {len(M.ESSENTIAL)})) THEN 'partial' ELSE 'invalid' END AS status,
    CASE WHEN taken THEN array({", ".join(f"named_struct('field', '{name}', 'value', substr(present, {i + 1}, 1), 'expected', substr(digits, {i + 1}, 1), 'valid', substr(digits, {i + 1}, 1) = substr(present, {i + 1}, 1))" for i, (name, _, _) in enumerate(M.CHECKED))}) END AS checks
  FROM (SELECT *, data_row IS NOT NULL AS taken, {_digits("data_row")} AS digits, {_present("data_row")} AS present FROM ({{routed}}))
)"""


def parse(pages: DataFrame, texts: str = "texts") -> DataFrame:
    """The pages with status, format, rows, method, row_order, recovery, checks, fields and reasons.

    One statement in layers, so that the plan is analysed once. Rows are reconstructed, then every name row and data row that a
    repair makes is an option; each data row is walked once for its five check digits. The order of the tests is fixed: no rows, a
    proven repair, a padded PM pair, the format, the check digits.
    """
    spark, keep = pages.sparkSession, ", ".join(f"`{c}`" for c in pages.columns)
    text = _ROWS.replace("{texts}", f"`{texts}`")
    for name, outer in (("rows", _OPTIONS), ("options", _REPAIRED), ("repaired", _ROUTED), ("routed", _JUDGED)):
        text = outer.replace("{" + name + "}", text)
    text = text.replace("{keep}", keep)
    found = spark.sql(text, pages=pages)
    fields = F.when(F.col("data_row").isNotNull(), M.td3_fields(F.col("name_row"), F.col("data_row")))
    out = found.withColumn("fields", fields).drop("name_row", "data_row")
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def summary(parsed: DataFrame) -> DataFrame:
    """Pages of each status."""
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("pages"))
