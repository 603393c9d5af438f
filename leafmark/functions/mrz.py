"""Machine-readable zone grammar as column expressions.

Check digits, fields, formats and the repairs of single rows. operators/mrz.py puts them together for whole pages: repairs are enumerated as
small arrays in a fixed order and the first one that all check digits prove is taken, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and row length of each format (fixed values).
FORMATS = (("TD1", 3, 30), ("TD2", 2, 36), ("TD3", 2, 44))
#: Characters that recognition confuses in document numbers, both ways (fixed values).
CONFUSED = (("H", "W"), ("O", "0"), ("I", "1"), ("B", "8"), ("Z", "2"))
#: The checked fields of a TD3 data row: its slices (from, to) and the place of its digit (fixed values).
CHECKED = (
    ("passport_number", ((0, 9),), 9),
    ("date_of_birth", ((13, 19),), 19),
    ("date_of_expiry", ((21, 27),), 27),
    ("optional_data", ((28, 42),), 42),
    ("composite", ((0, 10), (13, 20), (21, 43)), 43),
)
ESSENTIAL = ("passport_number", "date_of_birth", "date_of_expiry")
FIELDS = ("document_code", "issuing_state", "surname", "given_names", "passport_number", "nationality", "date_of_birth", "sex", "sex_code", "date_of_expiry", "optional_data")


def cut(text: Column, start: int, end: int) -> Column:
    return F.substring(text, start + 1, end - start)


#: Values of the characters, modulo 10 (0-9, then A as 10 to Z as 35; a filler is 0).
_CHARACTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
_VALUES = "0123456789" + "0123456789" * 2 + "012345" + "0"


def check_digit(text: Column) -> Column:
    """The digit for weights 7, 3, 1 in turn, null if a character has no value.

    Only the last digit of the sum counts, so characters become digits, every third digit is multiplied by its weight as
    a character map, and the digits are summed by counting each: a few string operations for any length.
    """
    digits = F.translate(text, _CHARACTERS, _VALUES)
    padded = F.concat(digits, F.lit("00"))  # two zeros at most stay over
    third = lambda n: F.regexp_replace(padded, "(.)(.)(.)", f"${n}")
    weighted = F.concat(F.translate(third(1), "123456789", "741852963"), F.translate(third(2), "123456789", "369258147"), third(3))

    def total(s: Column) -> Column:
        out = F.lit(0)
        for k in range(1, 10):
            out = out + k * (F.length(s) - F.length(F.translate(s, str(k), "")))
        return (out % 10).cast("string")

    return F.when(digits.rlike(r"\A[0-9]*\z"), F.transform(F.array(weighted), total)[0])


def digit_sql(text: str) -> str:
    """The same as SQL text, for use inside lambdas: one walk over the characters, whose weight follows from the place."""
    value = f"greatest(instr('{_CHARACTERS[:36]}', substr({text}, i, 1)) - 1, 0)"
    total = f"aggregate(sequence(1, length({text})), 0, (s, i) -> s + element_at(array(7, 3, 1), (i - 1) % 3 + 1) * {value})"
    return f"CASE WHEN {text} RLIKE '[^A-Z0-9<]' THEN NULL WHEN length({text}) = 0 THEN '0' ELSE CAST({total} % 10 AS STRING) END"


def _part_sql(text: str, slices: tuple[tuple[int, int], ...]) -> str:
    return " || ".join(f"substr({text}, {a + 1}, {b - a})" for a, b in slices)


def td3_checks(second: str) -> Column:
    """array<struct<field, value, expected, valid>> of a row, given as SQL text: value is the digit that the row has."""
    parts = ", ".join(f"named_struct('field', '{f}', 'value', substr({second}, {at + 1}, 1), 'part', {_part_sql(second, slices)})" for f, slices, at in CHECKED)
    found = f"transform(array({parts}), p -> named_struct('field', p.field, 'value', p.value, 'expected', {digit_sql('p.part')}))"
    return F.expr(f"transform({found}, c -> named_struct('field', c.field, 'value', c.value, 'expected', c.expected, 'valid', coalesce(c.value = c.expected, false)))")


def name_field(first: Column) -> Column:
    """What stands before noise that follows a run of fillers, without trailing fillers."""
    return F.rtrim(F.regexp_replace(cut(first, 5, 44), "<{3}[A-Z0-9].*$", ""), F.lit("<"))


def td3_fields(first: Column, second: Column) -> Column:
    parts = F.split(name_field(first), "<<", 2)
    plain = lambda x: F.trim(F.replace(x, F.lit("<"), F.lit(" ")))
    code = cut(second, 20, 21)
    sex = F.when(code == "F", "female").when(code == "M", "male").when(code == "<", "unspecified").otherwise("unknown")
    columns = (
        cut(first, 0, 2), cut(first, 2, 5), plain(parts[0]), F.coalesce(plain(F.get(parts, F.lit(1))), F.lit("")),
        F.rtrim(cut(second, 0, 9), F.lit("<")), cut(second, 10, 13), cut(second, 13, 19), sex, code, cut(second, 21, 27), F.rtrim(cut(second, 28, 42), F.lit("<")),
    )
    return F.struct(*(c.alias(n) for n, c in zip(FIELDS, columns)))
