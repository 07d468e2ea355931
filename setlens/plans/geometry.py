"""Box geometry, suppression and head-person matching over head_boxes and persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setlens.functions import geometry as g
from setlens.plans import catalog as c
from setlens.plans.catalog import with_cte
from setlens.shared import table

SIDE, THRESHOLD, GRID = 384, 0.3, 4
WIDTH = HEIGHT = 1000  # pixels of every image


def persons(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, person_id, slot, x1, y1, x2, y2), each person once."""
    p = table(spark, d, "persons").select(
        c.plain_image(F.col("image_id")).alias("image_id"), "person_id", "slot", *[F.col(x).cast("double").alias(x) for x in ("x1", "y1", "x2", "y2")]
    )
    return p.where("image_id IS NOT NULL").distinct()


def _box(*prefix: str):
    return [F.struct(*[F.col(f"{p}{x}").alias(x) for x in ("x1", "y1", "x2", "y2")]) for p in prefix]


def letterbox_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = c.boxes(spark, d)
    s = g.letterbox(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(WIDTH) + F.col("x") % 7 * 100, F.lit(HEIGHT), SIDE)
    return b.withColumn("s", s).select("box_id", *[F.round(F.col(f"s.{x}"), 9).alias(x) for x in ("x1", "y1", "x2", "y2")])


def box_centres(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return persons(spark, d).select("person_id", *[F.round(v, 6).alias(n) for v, n in ((cx, "cx"), (cy, "cy"), (F.col("x2") - F.col("x1"), "w"), (F.col("y2") - F.col("y1"), "h"))])


def person_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs a < b by slot of persons in one image."""
    p = persons(spark, d)
    a, b = (p.select("image_id", *[F.col(x).alias(f"{n}{x}") for x in p.columns if x != "image_id"]) for n in "ab")
    return a.join(b, "image_id").where("aperson_id < bperson_id")


def pairwise_iou(spark: SparkSession, d: str) -> DataFrame:
    a, b = _box("a", "b")
    pairs = person_pairs(spark, d).withColumn("a", a).withColumn("b", b)
    return pairs.select(F.col("aperson_id").alias("person_a"), F.col("bperson_id").alias("person_b"), F.round(g.iou(F.col("a"), F.col("b")), 6).alias("iou"))


def pair_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Directed offsets of centres, and log ratios of sizes, each size 1e-6 at least."""
    q = person_pairs(spark, d)
    size = lambda n, k: F.greatest(F.col(f"{n}{k}2") - F.col(f"{n}{k}1"), F.lit(1e-6))
    mid = lambda n, k: (F.col(f"{n}{k}1") + F.col(f"{n}{k}2")) / 2
    return q.select(
        F.col("aperson_id").alias("person_a"), F.col("bperson_id").alias("person_b"),
        F.round(mid("b", "x") - mid("a", "x"), 6).alias("dx"), F.round(mid("b", "y") - mid("a", "y"), 6).alias("dy"),
        F.round(F.log(size("b", "x") / size("a", "x")), 6).alias("log_w"), F.round(F.log(size("b", "y") / size("a", "y")), 6).alias("log_h"),
    )


def patch_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Centres of a GRID x GRID patch grid relative to each person's box; a box without extent counts as the whole image."""
    p = persons(spark, d)
    flat = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    p = p.select("person_id", *[F.when(flat, F.lit(v)).otherwise(F.col(k)).alias(k) for k, v in (("x1", 0.0), ("y1", 0.0), ("x2", 1.0), ("y2", 1.0))])
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID * GRID - 1))))
    px, py = (F.col("i") % GRID + 0.5) / GRID, (F.floor(F.col("i") / GRID) + 0.5) / GRID
    return p.select("person_id", F.col("i").alias("patch"), F.round((px - F.col("x1")) / (F.col("x2") - F.col("x1")), 6).alias("u"), F.round((py - F.col("y1")) / (F.col("y2") - F.col("y1")), 6).alias("v"))


def greedy_nms(spark: SparkSession, d: str) -> DataFrame:
    """Persons that stay after suppression by area; the fold runs over one image's boxes."""
    p = persons(spark, d)
    entry = F.struct(F.round((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), 6).alias("priority"), F.col("person_id").alias("slot"), "x1", "y1", "x2", "y2")
    per = p.groupBy("image_id").agg(F.collect_list(entry).alias("boxes"))
    return per.select("image_id", F.explode(g.keep_boxes(F.col("boxes"), THRESHOLD)).alias("person_id"))


def head_points(spark: SparkSession, d: str) -> DataFrame:
    b = c.boxes(spark, d).where("identity_id IS NOT NULL")
    return b.select("image_id", "box_id", "identity_id", ((F.col("x") + F.col("width") / 2) / WIDTH).alias("hx"), ((F.col("y") + F.col("height") / 2) / HEIGHT).alias("hy"))


def head_person_costs(spark: SparkSession, d: str) -> DataFrame:
    (p,) = _box("")
    both = head_points(spark, d).join(persons(spark, d).withColumn("p", p), "image_id")
    both = both.where(F.col("hx").between(F.col("x1"), F.col("x2")) & F.col("hy").between(F.col("y1"), F.col("y2")))
    return both.select("image_id", "box_id", "identity_id", "person_id", F.round(g.head_cost(F.col("hx"), F.col("hy"), F.col("p")), 9).alias("cost"))


def head_person_match(spark: SparkSession, d: str) -> DataFrame:
    costs = head_person_costs(spark, d)
    pair = F.struct("cost", F.col("box_id").alias("head"), F.col("person_id").alias("person"))
    per = costs.groupBy("image_id").agg(F.collect_list(pair).alias("pairs"))
    return per.select("image_id", F.explode(g.greedy_pairs(F.col("pairs"))).alias("m")).select("image_id", F.col("m.head").alias("box_id"), F.col("m.person").alias("person_id"))


def person_identity(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, identity_id): the identity of the head that a person is matched with."""
    heads = c.boxes(spark, d).select("image_id", "box_id", "identity_id")
    return head_person_match(spark, d).join(heads, ["image_id", "box_id"]).groupBy("person_id").agg(F.min("identity_id").alias("identity_id"))


def supplemental_identity(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose box holds exactly one head centre take its identity."""
    per = head_person_costs(spark, d).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.min("identity_id").alias("identity_id"))
    return per.where("n = 1").select("person_id", "identity_id")


QUERIES = {
    f.__name__: f
    for f in (letterbox_boxes, box_centres, pairwise_iou, pair_geometry, patch_offsets, greedy_nms, head_person_costs, head_person_match, supplemental_identity)
}

_PER = f"""per AS (SELECT DISTINCT {c.sql_image('image_id')} AS image_id, person_id, slot, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2
    FROM persons WHERE {c.sql_image('image_id')} IS NOT NULL)"""
_PAIRS = _PER + """, pairs AS (SELECT a.image_id, a.person_id AS a, b.person_id AS b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
    FROM per a JOIN per b ON a.image_id = b.image_id AND a.person_id < b.person_id)"""
_IOU = """greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)"""
_AREA = "greatest({p}x2 - {p}x1, 0) * greatest({p}y2 - {p}y1, 0)"
_COSTS = _PER + f""", heads AS (SELECT image_id, box_id, identity_id, (x + width / 2) / {WIDTH} AS hx, (y + height / 2) / {HEIGHT} AS hy FROM box WHERE identity_id IS NOT NULL),
    costs AS (SELECT image_id, box_id, identity_id, person_id, round(((hx - (x1 + x2) / 2) / greatest(x2 - x1, 1e-6)) ** 2 + ((hy - y1) / greatest(y2 - y1, 1e-6)) ** 2, 9) AS cost
    FROM heads JOIN per USING (image_id) WHERE hx BETWEEN x1 AND x2 AND hy BETWEEN y1 AND y2)"""
_MATCHED = _COSTS + """, cheap AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cost, box_id, person_id) AS r FROM costs),
    pick AS (SELECT image_id, 1 AS r, [{'h': box_id, 'p': person_id}] AS taken FROM cheap WHERE r = 1
      UNION ALL SELECT o.image_id, w.r + 1, CASE WHEN len(list_filter(w.taken, lambda k: k.h = o.box_id OR k.p = o.person_id)) > 0 THEN w.taken
      ELSE list_append(w.taken, {'h': o.box_id, 'p': o.person_id}) END FROM pick w JOIN cheap o ON o.image_id = w.image_id AND o.r = w.r + 1),
    matched AS MATERIALIZED (SELECT image_id, unnest(arg_max(taken, r)) AS m FROM pick GROUP BY image_id)"""
_PERSON_IDENTITY = _MATCHED + """, pid AS MATERIALIZED (SELECT m.p AS person_id, min(identity_id) AS identity_id FROM matched JOIN box ON box.image_id = matched.image_id AND box.box_id = m.h GROUP BY 1)"""
_EVEN = "round_even({}, 0)"
ORACLE = {
    "letterbox_boxes": with_cte("box", more=f"""w AS (SELECT *, {WIDTH} + x % 7 * 100 AS iw, {HEIGHT} AS ih FROM box), s AS (SELECT *, least({SIDE} / iw, {SIDE} / ih) AS k FROM w),
        r AS (SELECT *, least({SIDE}, {_EVEN.format('iw * k')}) AS rw, least({SIDE}, {_EVEN.format('ih * k')}) AS rh FROM s),
        o AS (SELECT *, {_EVEN.format(f'({SIDE} - rw) / 2')} AS l, {_EVEN.format(f'({SIDE} - rh) / 2')} AS t FROM r)""")
    + f"""SELECT box_id, round(greatest(0, least(1, (x * rw / iw + l) / {SIDE})), 9) AS x1, round(greatest(0, least(1, (y * rh / ih + t) / {SIDE})), 9) AS y1,
        round(greatest(0, least(1, ((x + width) * rw / iw + l) / {SIDE})), 9) AS x2, round(greatest(0, least(1, ((y + height) * rh / ih + t) / {SIDE})), 9) AS y2 FROM o""",
    "box_centres": f"WITH {_PER} SELECT person_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM per",
    "pairwise_iou": f"WITH {_PAIRS} SELECT a AS person_a, b AS person_b, round({_IOU} / greatest({_AREA.format(p='a')} + {_AREA.format(p='b')} - {_IOU}, 1e-12), 6) AS iou FROM pairs",
    "pair_geometry": f"""WITH {_PAIRS} SELECT a AS person_a, b AS person_b, round((bx1 + bx2) / 2 - (ax1 + ax2) / 2, 6) AS dx, round((by1 + by2) / 2 - (ay1 + ay2) / 2, 6) AS dy,
        round(ln(greatest(bx2 - bx1, 1e-6) / greatest(ax2 - ax1, 1e-6)), 6) AS log_w, round(ln(greatest(by2 - by1, 1e-6) / greatest(ay2 - ay1, 1e-6)), 6) AS log_h FROM pairs""",
    "patch_offsets": f"""WITH {_PER}, b AS (SELECT person_id, x2 <= x1 OR y2 <= y1 AS flat, x1, y1, x2, y2 FROM per),
        f AS (SELECT person_id, CASE WHEN flat THEN 0 ELSE x1 END AS x1, CASE WHEN flat THEN 0 ELSE y1 END AS y1, CASE WHEN flat THEN 1 ELSE x2 END AS x2, CASE WHEN flat THEN 1 ELSE y2 END AS y2 FROM b)
        SELECT person_id, i::INTEGER AS patch, round(((i % {GRID} + 0.5::DOUBLE) / {GRID} - x1) / (x2 - x1), 6) AS u, round(((i // {GRID} + 0.5::DOUBLE) / {GRID} - y1) / (y2 - y1), 6) AS v
        FROM f, range({GRID * GRID}) t(i)""",
    "greedy_nms": f"""WITH RECURSIVE {_PER}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round((x2 - x1) * (y2 - y1), 6) DESC, person_id) AS r FROM per WHERE x2 > x1 AND y2 > y1),
        walk AS (SELECT image_id, 1 AS r, [{{'p': person_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM o WHERE r = 1
          UNION ALL SELECT o.image_id, w.r + 1, CASE WHEN len(list_filter(w.kept, lambda k:
            greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0)
            / greatest((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(least(k.x2, o.x2) - greatest(k.x1, o.x1), 0) * greatest(least(k.y2, o.y2) - greatest(k.y1, o.y1), 0), 1e-12) > {THRESHOLD})) > 0
          THEN w.kept ELSE list_append(w.kept, {{'p': o.person_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END FROM walk w JOIN o ON o.image_id = w.image_id AND o.r = w.r + 1)
        SELECT image_id, unnest(arg_max(kept, r)).p AS person_id FROM walk GROUP BY image_id""",
    "head_person_costs": with_cte("box", more=_COSTS) + "SELECT * FROM costs",
    "head_person_match": "WITH RECURSIVE " + with_cte("box", more=_MATCHED).removeprefix("WITH ") + "SELECT image_id, m.h AS box_id, m.p AS person_id FROM matched",
    "supplemental_identity": with_cte("box", more=_COSTS) + "SELECT person_id, min(identity_id) AS identity_id FROM costs GROUP BY person_id HAVING count(*) = 1",
}
