"""String expressions: compaction, names and numbers in paths, escaping, formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every code point that counts as white space when words are parted (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ALLOWED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"


def compact(text: Column) -> Column:
    """Upper case, without any white space."""
    return F.upper(F.translate(text, SPACES, ""))


def sanitize(text: Column) -> Column:
    """Upper case, of MRZ characters only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9<]", "")


def allowed_ratio(text: Column) -> Column:
    """Share of MRZ characters; 0 for the empty text."""
    return (F.length(text) - F.length(F.translate(text, ALLOWED, ""))) / F.greatest(F.lit(1), F.length(text))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def safe_name(name: Column) -> Column:
    """Runs of other characters than word characters become one underscore."""
    return F.regexp_replace(name, r"(?U)[^\w]+", "_")


def last_number(text: Column) -> Column:
    """The last run of digits, 0 without one."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(text, F.lit(r"[0-9]+"), F.lit(0)), F.lit(-1)).cast("int"), F.lit(0))


def tagged_number(text: Column) -> Column:
    """The last number after page or DataPage_, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(?i)(?:page|DataPage_)([0-9]+)"), F.lit(1)), F.lit(-1)).cast("int")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def url_quote(path: Column) -> Column:
    """Percent-encoding that leaves slashes and ~ and writes a blank as %20."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fixed(value: Column, places: int) -> Column:
    """The double with so many decimals, as C and Python print it: its exact binary value is rounded, exact halves to even.

    (format_string and bround round the shortest decimal text of a double instead.) From 1e13 on, and for what is not a number, as format_string does.
    """
    scale = float(10**places)

    def printed(v: Column) -> Column:
        size = F.abs(v)
        high = size * 134217729.0 - (size * 134217729.0 - size)  # its upper 26 bits, so that both partial products are exact
        scaled, low = size * scale, size - high
        error = (high * scale - scaled) + low * scale  # of the product; it decides what only looks like a half
        whole = F.floor(scaled)
        tie = scaled - whole == 0.5
        n = F.when(tie & (error > 0), whole + 1).when(tie & (error < 0), whole).otherwise(F.rint(scaled).cast("bigint")).cast("string")
        digits = F.lpad(n, F.greatest(F.lit(places + 1), F.length(n)), F.lit("0"))
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), "-").otherwise("")
        point = F.concat(sign, F.left(digits, F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places)))
        return F.when(size < 1e13, point).when(v.isNotNull(), F.format_string(f"%.{places}f", v))

    return F.transform(F.array(value.cast("double")), printed)[0]  # so that the value is computed once


def format_rate(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.concat(fixed(rate * 100, 1), F.lit("%"))).otherwise("N/A")


def format_elapsed(ms: Column) -> Column:
    return F.when(ms.isNotNull(), F.concat(fixed(ms / 1000, 2), F.lit(" s"))).otherwise("N/A")


def relocated(path: Column, root: str) -> Column:
    """The path from its first output or dataset folder on, under the root; other paths as they are."""
    return F.regexp_replace(path, r"^.*?/(output|dataset)/", f"{root}/$1/")


def stays_inside(path: Column) -> Column:
    """Whether a relative path leads to something below the folder it starts in: no absolute path, drive or backslash, and no
    step out of it on the way."""
    steps = F.split(path, "/")
    depth = lambda s: F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("least"))
    step = lambda a, s: F.struct((a["now"] + depth(s)).alias("now"), F.least(a["least"], a["now"] + depth(s)).alias("least"))
    end = F.aggregate(steps, start, step)
    return ~path.startswith("/") & ~path.rlike(r"[\\:]") & (end["least"] >= 0) & (end["now"] > 0)


def jobs(uploads: DataFrame, name: str, workers: str, identity: Column, least: int = 1, most: int = 3) -> DataFrame:
    """Uploads as jobs: the file's name without folders, whether its kind is accepted, workers in their range, and a job id
    of 12 hex digits of the identity's hash."""
    file = basename(F.translate(F.col(name), "\\", "/"))
    accepted = suffix(file).isin(".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff")
    return uploads.withColumns({"file": file, "accepted": accepted, workers: F.greatest(F.lit(least), F.least(F.lit(most), F.col(workers))), "job_id": F.substring(F.sha2(identity.cast("binary"), 256), 1, 12)})


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000.0


def epoch_seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1000000.0


def now_text() -> Column:
    """The time now, to the second."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
