"""Queries of the raster operators, over pages whose pixels are the words of the documents and over boxes of the vectors table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.operators import profiles, scores
from leafmark.operators import raster as R
from leafmark.sources import derived

HEIGHT, WIDTH = 300, 400
GUARD = 12
#: Gray below which a pixel is ink: words of seven characters and more.
INK = 121
#: Adaptive threshold: pixels around, and how much darker than their mean; gaps below CLOSE are filled.
RADIUS, BELOW, CLOSE = 5, 40, 3
#: Directions of level and upright lines in degrees, step of an edge, votes of a line, gap and length of a segment.
LEVEL, UPRIGHT, EDGE = R.directions(-6, 6, 2), R.directions(86, 94, 2), 100
VOTES, GAP, LENGTH = 14, 3, 9


def _cut(spark: SparkSession):
    """Writes a table into the shared folder and reads it back."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: the executors share no folder")
        root = tempfile.mkdtemp(prefix="leafmark-")

    def cut(rows: DataFrame) -> DataFrame:
        path = f"{root.rstrip('/')}/raster-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    return cut


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The pages, and to how many tasks their pixels are dealt."""
    parts = derived.dealt_to(spark, sf_dir, "documents")
    return derived.view(spark, sf_dir, "word_page", parts), parts


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pixels(*_pages(spark, sf_dir))


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs(_pixels(spark, sf_dir), F.col("g") < INK)


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.adaptive(_pixels(spark, sf_dir), RADIUS, BELOW)


def raster_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the black-and-white pages."""
    return _binary(spark, sf_dir).select("key", "y", "x1", "x2")


def raster_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each page and its dark pixels."""
    px = _pixels(spark, sf_dir)
    return px.join(R.otsu(px), "key").groupBy("key", "at").agg(F.count_if(F.col("g") <= F.col("at")).alias("dark"))


def raster_edge_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of long words in the two rows and columns along the edges of each page."""
    pages, parts = _pages(spark, sf_dir)
    sizes = pages.select("key", "pw", F.expr("CAST(size(px) DIV pw AS INT)").alias("ph"))
    found = R.edge_ink(R.runs(R.pixels(pages, parts), F.col("g") < INK), sizes, 2)
    return found.select("key", *(F.round(c, 6).alias(f"at_{c}") for c in ("top", "bottom", "left", "right")))


def raster_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.components(_ink(spark, sf_dir), _cut(spark)).select("key", "component", "area", "x", "y", "w", "h")


def raster_text_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the closed black-and-white pages as text lines: their number, and the shares of long and of field-like ones."""
    parts = R.components(R.closed(_binary(spark, sf_dir), CLOSE), _cut(spark))
    return scores.text_bands(parts, derived.RASTER_WIDTH, derived.RASTER_PAGE // derived.RASTER_WIDTH)


def raster_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the pages whose size and place a face can have."""
    parts = R.components(_ink(spark, sf_dir), _cut(spark))
    return scores.faces(parts, derived.RASTER_WIDTH, derived.RASTER_PAGE // derived.RASTER_WIDTH, lowest=0.5).select("key", "component", "x", "y", "w", "h")


def _segments(spark: SparkSession, sf_dir: str, level: bool) -> DataFrame:
    pages, parts = _pages(spark, sf_dir)
    return R.segments(R.page_edges(pages, EDGE, level, parts), LEVEL if level else UPRIGHT, VOTES, GAP, LENGTH)


def raster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of nearly level lines."""
    return _segments(spark, sf_dir, True).select("key", "i", "a", "rho", "x1", "y1", "x2", "y2", "points")


def raster_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.skew(R.line_angles(_segments(spark, sf_dir, True)), 6.0)


def raster_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upright segment that best parts each page that has one in its middle."""
    return scores.line_seam(_segments(spark, sf_dir, False), derived.RASTER_WIDTH, derived.RASTER_PAGE // derived.RASTER_WIDTH)


def raster_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = _cut(spark)(_binary(spark, sf_dir))
    parts = R.components(R.closed(ink, CLOSE), _cut(spark))
    found = R.layout(ink, parts, R.text_rows(ink, dense=0.2, tallest=0.2))
    return found.select("key", *(F.round(c, 6).alias(c) for c in ("horizontal", "lower", "compact", "readable")))


def raster_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border trimming of the pages' longest words, with margins that fit their size."""
    pages, parts = _pages(spark, sf_dir)
    sizes = pages.select("key", "pw", F.expr("CAST(size(px) DIV pw AS INT)").alias("ph"))
    found = R.trimmed(R.runs(R.pixels(pages, parts), F.col("g") < 56), sizes, R.Trim(least_margin=1, ink=0.05, smooth=0.08, least_gain=0.05))
    return found.select("key", *"xywh", F.round("cut", 6).alias("cut"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each vector on a page of its own, by its id."""
    k = F.col("vec_id")
    of = {c: (k * m % n + a).cast("int") for c, m, n, a in (("x", 17, 340, 0), ("y", 31, 260, 0), ("w", 13, 150, 1), ("h", 7, 120, 1))}
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(k.alias("key"), F.lit(WIDTH).alias("pw"), F.lit(HEIGHT).alias("ph"), *(v.alias(c) for c, v in of.items()))


def _box_ink(boxes: DataFrame) -> DataFrame:
    """The runs of black boxes on white pages."""
    rows = F.sequence("y", F.least(F.col("y") + F.col("h"), F.col("ph")) - 1)
    return boxes.select(*R.PAGE, F.col("x").alias("x1"), F.least(F.col("x") + F.col("w"), F.col("pw")).alias("x2"), F.explode(rows).alias("y"))


def image_border_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return R.trimmed(_box_ink(boxes), boxes.select(*R.PAGE)).select(F.col("key").alias("vec_id"), *"xywh", F.round("cut", 6).alias("cut"))


def image_edge_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of ink in the strips along the edges, and whether all are clean."""
    boxes, strips = _boxes(spark, sf_dir), ("top", "bottom", "left", "right")
    found = R.edge_ink(_box_ink(boxes), boxes.select(*R.PAGE), GUARD).select(F.col("key").alias("vec_id"), *(F.round(c, 6).alias(c) for c in strips))
    return found.withColumn("safe", F.greatest(*strips) < 0.012)


_BOX = f"""b AS (SELECT vec_id, x, y, least({WIDTH}, x + w) AS x2, least({HEIGHT}, y + h) AS y2 FROM (
  SELECT vec_id, vec_id * 17 % 340 AS x, vec_id * 31 % 260 AS y, vec_id * 13 % 150 + 1 AS w, vec_id * 7 % 120 + 1 AS h FROM embeddings))"""
_LAP = "greatest(0, least({hi}, {b}) - greatest({lo}, {a}))"


def _strip(x1: int, y1: int, x2: int, y2: int) -> str:
    across, down = _LAP.format(lo=x1, hi=x2, a="x", b="x2"), _LAP.format(lo=y1, hi=y2, a="y", b="y2")
    return f"round({across} * {down} / {(x2 - x1) * (y2 - y1)}.0::DOUBLE, 6)"


_STRIPS = {"top": _strip(0, 0, WIDTH, GUARD), "bottom": _strip(0, HEIGHT - GUARD, WIDTH, HEIGHT), "left": _strip(0, 0, GUARD, HEIGHT), "right": _strip(WIDTH - GUARD, 0, WIDTH, HEIGHT)}

# The raster queries in DuckDB: means by summing the box of each pixel, components by spreading the least pixel from row to row, votes by joins.
_PX = f"""pg AS MATERIALIZED ({derived.oracle("word_page")}),
px AS MATERIALIZED (SELECT key, CAST((i - 1) // pw AS INT) AS y, CAST((i - 1) % pw AS INT) AS x, CAST(px[i] AS BIGINT) AS g, pw, CAST(len(px) // pw AS INT) AS ph FROM (SELECT key, pw, px, unnest(range(1, len(px) + 1)) AS i FROM pg))"""
_RUNS = "{name} AS MATERIALIZED (SELECT key, pw, ph, y, CAST(min(x) AS INT) AS x1, CAST(max(x) + 1 AS INT) AS x2 FROM (SELECT *, x - row_number() OVER (PARTITION BY key, y ORDER BY x) AS k FROM {of}) GROUP BY key, pw, ph, y, k)"
_NEAR = f"bw AS (SELECT a.key, a.pw, a.ph, a.y, a.x FROM px AS a JOIN px AS b ON a.key = b.key AND b.y BETWEEN a.y - {RADIUS} AND a.y + {RADIUS} AND b.x BETWEEN a.x - {RADIUS} AND a.x + {RADIUS} GROUP BY a.key, a.pw, a.ph, a.y, a.x, a.g HAVING a.g + {BELOW} < avg(b.g))"
_PARTS = """own AS MATERIALIZED (SELECT *, y * pw + x1 AS a FROM {runs}),
link AS MATERIALIZED (SELECT s.key, s.a, t.a AS b FROM own AS s JOIN own AS t ON s.key = t.key AND abs(s.y - t.y) = 1 AND s.x1 < t.x2 AND t.x1 < s.x2),
flow(key, a, root) USING KEY (key, a) AS (
  SELECT key, a, a FROM own
  UNION
  SELECT f.key, l.b, min(f.root) FROM flow AS f JOIN link AS l ON f.key = l.key AND f.a = l.a JOIN recurring.flow AS r ON r.key = l.key AND r.a = l.b WHERE f.root < r.root GROUP BY f.key, l.b
),
part AS (SELECT o.key, f.root AS component, sum(x2 - x1) AS area, min(x1) AS x, min(y) AS y, max(x2) - min(x1) AS w, max(y) - min(y) + 1 AS h, any_value(pw) AS pw, any_value(ph) AS ph FROM own AS o JOIN flow AS f ON o.key = f.key AND o.a = f.a GROUP BY o.key, f.root)"""


def _lines(table: list[tuple[int, int, int]], level: bool) -> str:
    """The segments, as the operator defines them."""
    on = "key, x ORDER BY y" if level else "key, y ORDER BY x"
    return f"""ang(a, c, s) AS (VALUES {", ".join(f"({a}, {c}, {s})" for a, c, s in table)}),
pt AS MATERIALIZED (SELECT key, pw, ph, y, x FROM (SELECT *, lag(g) OVER (PARTITION BY {on}) AS before FROM px) WHERE abs(g - before) >= {EDGE}),
hit AS MATERIALIZED (SELECT key, pw, ph, y, x, a, CAST(floor((y * c - x * s + 512) / 1024) AS INT) AS rho, CAST(floor((x * c + y * s + 512) / 1024) AS INT) AS t FROM pt, ang),
v AS MATERIALIZED (SELECT key, a, rho, count(*) AS n FROM hit GROUP BY key, a, rho),
top AS (SELECT * FROM v WHERE n >= {VOTES} AND NOT EXISTS (SELECT 1 FROM v AS o WHERE o.key = v.key AND ((o.a = v.a AND o.rho <> v.rho AND abs(o.rho - v.rho) <= 2) OR (o.rho = v.rho AND abs(o.a - v.a) = 1))
  AND (o.n > v.n OR (o.n = v.n AND (o.a < v.a OR (o.a = v.a AND o.rho < v.rho)))))),
gap AS (SELECT *, t - lag(t) OVER (PARTITION BY key, a, rho ORDER BY t, y, x) > {GAP} AS new FROM hit SEMI JOIN top USING (key, a, rho)),
pc AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY key, a, rho ORDER BY t, y, x) AS piece FROM gap),
seg AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY a, rho, piece) - 1 AS INT) AS i FROM (
    SELECT key, a, rho, piece, arg_min(x, (t, y, x)) AS x1, arg_min(y, (t, y, x)) AS y1, arg_max(x, (t, y, x)) AS x2, arg_max(y, (t, y, x)) AS y2, count(*) AS points FROM pc GROUP BY key, a, rho, piece HAVING max(t) - min(t) + 1 >= {LENGTH}
  ))"""


_SKEW = """l AS (SELECT key, i, ((degrees(atan2(y2 - y1, x2 - x1)) + 90) % 180 + 180) % 180 - 90 AS v, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS weight FROM seg),
near AS (SELECT key, i, round(v, 9) AS value, weight FROM l WHERE abs(round(v, 9)) <= 6),
m AS (SELECT key, min(value) AS estimate FROM (SELECT *, sum(weight) OVER (PARTITION BY key ORDER BY value, i ROWS UNBOUNDED PRECEDING) AS up, sum(weight) OVER (PARTITION BY key) AS whole FROM near) WHERE up >= whole / 2 GROUP BY key),
o AS (SELECT near.key, i, abs(value - estimate) AS off, weight, estimate FROM near JOIN m ON near.key = m.key),
d AS (SELECT key, min(off) AS dispersion FROM (SELECT *, sum(weight) OVER (PARTITION BY key ORDER BY off, i ROWS UNBOUNDED PRECEDING) AS up, sum(weight) OVER (PARTITION BY key) AS whole FROM o) WHERE up >= whole / 2 GROUP BY key)
SELECT o.key, round(CASE WHEN count(*) < 3 THEN 0 ELSE any_value(estimate) END, 6) AS estimate,
  round(CASE WHEN count(*) < 3 THEN 0 ELSE least(1, count(*) FILTER (off <= greatest(0.6::DOUBLE, dispersion * 2.5::DOUBLE)) / 8) * greatest(0, 1 - any_value(dispersion) / 1.5::DOUBLE) END, 6) AS confidence
FROM o JOIN d ON o.key = d.key GROUP BY o.key"""
_SEAM = f"""m AS (SELECT key, i, CAST(round_even((x1 + x2) / 2.0::DOUBLE, 0) AS INT) AS seam, abs(y2 - y1) / {derived.RASTER_PAGE // derived.RASTER_WIDTH} AS covered FROM seg WHERE NOT abs(x2 - x1) > abs(y2 - y1) * tan(radians(5))),
s AS (SELECT *, covered - abs(seam - {derived.RASTER_WIDTH / 2}::DOUBLE) / {derived.RASTER_WIDTH / 2}::DOUBLE * 0.08::DOUBLE AS score FROM m WHERE seam >= {int(derived.RASTER_WIDTH * 0.28)} AND seam < {int(derived.RASTER_WIDTH * 0.72)})
SELECT key, seam, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, i) AS k FROM s WHERE score > 0) WHERE k = 1"""
_SHUT = f"""gapped AS (SELECT *, coalesce(x1 - lag(x2) OVER (PARTITION BY key, y ORDER BY x1) >= {CLOSE}, false) AS new FROM bin),
shut AS MATERIALIZED (SELECT key, pw, ph, y, min(x1) AS x1, max(x2) AS x2 FROM (SELECT *, count(*) FILTER (new) OVER (PARTITION BY key, y ORDER BY x1) AS k FROM gapped) GROUP BY key, pw, ph, y, k),
{_PARTS.format(runs="shut")}"""
_W, _H = derived.RASTER_WIDTH, derived.RASTER_PAGE // derived.RASTER_WIDTH
_LAYOUT = f"""{_SHUT},
hor AS (SELECT key, coalesce(sum(area) FILTER (w >= h * 1.6::DOUBLE AND w >= pw * 0.025::DOUBLE), 0) / sum(area) AS horizontal FROM part GROUP BY key),
whole AS (SELECT key, pw, ph, (max(x2) - min(x1)) * (max(y) - min(y) + 1) / (pw * ph) AS compact, greatest(1, floor(ph * 0.35::DOUBLE)) AS t, floor(ph * 0.65::DOUBLE) AS b FROM bin GROUP BY key, pw, ph),
dens AS (SELECT w.key, any_value(compact) AS compact, 0.5 + 5 * (sum(CASE WHEN y >= b THEN x2 - x1 ELSE 0 END) / any_value(bin.pw * (bin.ph - b)) - sum(CASE WHEN y < t THEN x2 - x1 ELSE 0 END) / any_value(bin.pw * t)) AS lower FROM bin JOIN whole AS w ON bin.key = w.key GROUP BY w.key),
busy AS (SELECT key, pw, ph, y, min(x1) AS x1, max(x2) AS x2 FROM bin WHERE y >= round_even(ph * 0.55::DOUBLE, 0) GROUP BY key, pw, ph, y HAVING sum(x2 - x1) / pw > 0.2::DOUBLE),
band AS (SELECT key, ph, min(y) AS y, max(y) + 1 AS y2, (max(x2) - min(x1)) / pw AS cover FROM (SELECT *, y - row_number() OVER (PARTITION BY key ORDER BY y) AS k FROM busy) GROUP BY key, pw, ph, k
  HAVING max(y) - min(y) + 1 BETWEEN 2 AND greatest(3, round_even(ph * 0.2::DOUBLE, 0)) AND (max(x2) - min(x1)) / pw >= 0.35::DOUBLE),
two AS (SELECT *, lead(y) OVER (PARTITION BY key ORDER BY y) - y2 AS apart, lead(cover) OVER (PARTITION BY key ORDER BY y) AS next FROM band),
rd AS (SELECT key, coalesce(arg_min(least(1, (cover + next) / 1.4::DOUBLE), y) FILTER (apart <= ph * 0.11::DOUBLE), least(0.55::DOUBLE, max(cover) * 0.55::DOUBLE)) AS readable FROM two GROUP BY key)
SELECT d.key, round(horizontal, 6) AS horizontal, round(greatest(0, least(1, lower)), 6) AS lower, round(compact, 6) AS compact, round(coalesce(readable, 0), 6) AS readable FROM dens AS d JOIN hor ON d.key = hor.key LEFT JOIN rd ON d.key = rd.key"""

def _axis(name: str, at: str, size: str, inside: str, across: str) -> str:
    """First and behind-last place of an axis whose moving mean of ink is enough."""
    return f"""{name}n AS (SELECT key, {at} AS i, any_value({size}) AS size, greatest(3, round_even(any_value({size}) * 0.08::DOUBLE, 0)) AS k, count(*) / any_value({across}) AS v FROM dk WHERE {inside} GROUP BY key, {at}),
{name}s AS (SELECT key, i + d AS i, any_value(k) AS k, any_value(size) AS size, sum(v) AS v FROM {name}n, (SELECT unnest(range(-40, 41)) AS d) WHERE d BETWEEN -((k - 1) // 2) AND k // 2 GROUP BY key, i + d),
{name} AS (SELECT key, min(i) AS lo, max(i) + 1 AS hi FROM {name}s WHERE i >= 0 AND i < size AND v / k >= 0.05::DOUBLE GROUP BY key)"""


_TRIM = f"""sz AS MATERIALIZED (SELECT key, pw, CAST(len(px) // pw AS INT) AS ph FROM pg),
dk AS MATERIALIZED (SELECT *, greatest(1, round_even(pw * 0.02::DOUBLE, 0)) AS ex, greatest(1, round_even(ph * 0.02::DOUBLE, 0)) AS ey FROM px WHERE g < 56),
ct AS (SELECT key, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM dk GROUP BY key, pw, ph HAVING (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) / (pw * ph) >= 0.006::DOUBLE),
{_axis("dn", "y", "ph", "pw > 2 * ex AND ph > 2 * ey AND x >= ex AND x < pw - ex", "pw - 2 * ex")},
{_axis("ac", "x", "pw", "pw > 2 * ex AND ph > 2 * ey AND y >= ey AND y < ph - ey", "ph - 2 * ey")},
mg AS (SELECT *, greatest(1, round_even(least(pw, ph) * 0.015::DOUBLE, 0)) AS m FROM sz),
pj AS (SELECT mg.key, greatest(0, ac.lo - m) AS x1, greatest(0, dn.lo - m) AS y1, least(pw, ac.hi + m) AS x2, least(ph, dn.hi + m) AS y2, pw, ph FROM mg JOIN dn ON mg.key = dn.key JOIN ac ON mg.key = ac.key),
kp AS (SELECT pj.key, any_value(x1) AS x1, any_value(y1) AS y1, any_value(x2) AS x2, any_value(y2) AS y2, count(*) FILTER (dk.x >= x1 AND dk.x < x2 AND dk.y >= y1 AND dk.y < y2) AS kept, count(dk.x) AS n
  FROM pj LEFT JOIN dk ON pj.key = dk.key AND dk.x >= ex AND dk.x < dk.pw - ex AND dk.y >= ey AND dk.y < dk.ph - ey WHERE 1 - (x2 - x1) * (y2 - y1) / (pj.pw * pj.ph) >= 0.05::DOUBLE GROUP BY pj.key),
ok AS (SELECT * FROM kp WHERE n = 0 OR kept / n >= 0.995::DOUBLE),
bx AS (SELECT mg.key, pw, ph, greatest(0, x1 - m) AS x1, greatest(0, y1 - m) AS y1, least(pw, x2 + m) AS x2, least(ph, y2 + m) AS y2 FROM mg JOIN ct ON mg.key = ct.key),
ch AS (SELECT bx.key, {", ".join(f"CASE WHEN greatest((bx.x2 - bx.x1) / pw, (bx.y2 - bx.y1) / ph) >= 0.98::DOUBLE THEN coalesce(ok.{c}, bx.{c}) ELSE bx.{c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))} FROM bx LEFT JOIN ok ON bx.key = ok.key),
ct2 AS (SELECT sz.key, pw, ph, x1, y1, x2, y2, coalesce((x2 - x1) * (y2 - y1) / (pw * ph) >= 1 - 0.96::DOUBLE, false) AS cuts FROM sz LEFT JOIN ch ON sz.key = ch.key)
SELECT key, CAST(CASE WHEN cuts THEN x1 ELSE 0 END AS INT) AS x, CAST(CASE WHEN cuts THEN y1 ELSE 0 END AS INT) AS y, CAST(CASE WHEN cuts THEN x2 - x1 ELSE pw END AS INT) AS w, CAST(CASE WHEN cuts THEN y2 - y1 ELSE ph END AS INT) AS h,
  CASE WHEN cuts THEN round(1 - (x2 - x1) * (y2 - y1) / (pw * ph), 6) ELSE 0::DOUBLE END AS cut FROM ct2"""

QUERIES = {f.__name__: f for f in (raster_adaptive, raster_otsu, raster_edge_ink, raster_components, raster_lines, raster_skew, raster_seams, raster_text_bands, raster_faces, raster_layout, raster_trim, image_border_trim, image_edge_safety)}
ORACLES = {
    "raster_adaptive": f"WITH {_PX}, {_NEAR}, {_RUNS.format(name='bin', of='bw')} SELECT key, y, x1, x2 FROM bin",
    "raster_otsu": f"""WITH {_PX}, h AS (SELECT key, g, count(*) AS n FROM px GROUP BY key, g),
        c AS (SELECT *, sum(n) OVER w AS below, sum(n) OVER k AS whole, sum(n * g) OVER w AS part, sum(n * g) OVER k AS total FROM h WINDOW w AS (PARTITION BY key ORDER BY g), k AS (PARTITION BY key)),
        t AS (SELECT key, arg_max(g, (v, -g)) AS best, max(v) AS v FROM (SELECT *, CASE WHEN below < whole THEN CAST(part * whole - below * total AS DOUBLE) * CAST(part * whole - below * total AS DOUBLE) / CAST(below * (whole - below) AS DOUBLE) ELSE 0 END AS v FROM c) GROUP BY key)
        SELECT px.key, CAST(CASE WHEN v > 0 THEN best ELSE 0 END AS INT) AS at, count(*) FILTER (g <= CASE WHEN v > 0 THEN best ELSE 0 END) AS dark FROM px JOIN t ON px.key = t.key GROUP BY px.key, v, best""",
    "raster_edge_ink": f"""WITH {_PX} SELECT key, {", ".join(f"round(coalesce(avg(CAST(g < {INK} AS INT)) FILTER ({at}), 0), 6) AS at_{k}" for k, at in (("top", "y < 2"), ("bottom", "y >= ph - 2"), ("left", "x < 2"), ("right", "x >= pw - 2")))} FROM px GROUP BY key""",
    "raster_components": f"WITH RECURSIVE {_PX}, {_RUNS.format(name='ink', of=f'(SELECT * FROM px WHERE g < {INK})')}, {_PARTS.format(runs='ink')} SELECT key, CAST(component AS INT) AS component, CAST(area AS BIGINT) AS area, x, y, w, h FROM part",
    "raster_lines": f"WITH {_PX}, {_lines(LEVEL, True)} SELECT key, i, a, rho, x1, y1, x2, y2, points FROM seg",
    "raster_skew": f"WITH {_PX}, {_lines(LEVEL, True)}, {_SKEW}",
    "raster_seams": f"WITH {_PX}, {_lines(UPRIGHT, False)}, {_SEAM}",
    "raster_layout": f"WITH RECURSIVE {_PX}, {_NEAR}, {_RUNS.format(name='bin', of='bw')}, {_LAYOUT}",
    "raster_text_bands": f"""WITH RECURSIVE {_PX}, {_NEAR}, {_RUNS.format(name='bin', of='bw')}, {_SHUT} SELECT key, count(*) AS line_count, round(avg(CASE WHEN w / {_W} >= 0.58::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS long_line_ratio,
        round(avg(CASE WHEN w / {_W} >= 0.06::DOUBLE AND w / {_W} < 0.58::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6) AS field_line_ratio FROM part WHERE h >= greatest(2, {_H} * 0.003::DOUBLE) AND w >= {_W} * 0.025::DOUBLE GROUP BY key""",
    "raster_faces": f"""WITH RECURSIVE {_PX}, {_RUNS.format(name='ink', of=f'(SELECT * FROM px WHERE g < {INK})')}, {_PARTS.format(runs='ink')} SELECT key, CAST(component AS INT) AS component, x, y, w, h FROM part
        WHERE w * h / {_W * _H} BETWEEN 0.001::DOUBLE AND 0.12::DOUBLE AND y <= {_H} * 0.5::DOUBLE""",
    "raster_trim": f"WITH {_PX}, {_TRIM}",
    "image_border_trim": f"""WITH {_BOX}, m AS (SELECT vec_id, (x2 - x) * (y2 - y) / {HEIGHT * WIDTH} >= 0.006::DOUBLE AS filled, greatest(0, x - 12) AS a, greatest(0, y - 12) AS b, least({WIDTH}, x2 + 12) AS c, least({HEIGHT}, y2 + 12) AS d FROM b),
        t AS (SELECT *, filled AND (c - a) * (d - b) / {HEIGHT * WIDTH} >= 1 - 0.96::DOUBLE AS cuts FROM m)
        SELECT vec_id, CAST(CASE WHEN cuts THEN a ELSE 0 END AS INT) AS x, CAST(CASE WHEN cuts THEN b ELSE 0 END AS INT) AS y, CAST(CASE WHEN cuts THEN c - a ELSE {WIDTH} END AS INT) AS w, CAST(CASE WHEN cuts THEN d - b ELSE {HEIGHT} END AS INT) AS h,
          CASE WHEN cuts THEN round(1 - (c - a) * (d - b) / {HEIGHT * WIDTH}.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS cut FROM t""",
    "image_edge_safety": f"WITH {_BOX}, s AS (SELECT vec_id, {', '.join(f'{q} AS {k}' for k, q in _STRIPS.items()).replace(' AS left', ' AS \"left\"').replace(' AS right', ' AS \"right\"')} FROM b) SELECT *, greatest(top, bottom, \"left\", \"right\") < 0.012::DOUBLE AS safe FROM s",
}
