"""Detection and segmentation. An order is an image, its lines are boxes."""

from pyspark.sql import functions as F

from datasheaf.functions import arrays as A
from datasheaf.functions import boxes as B
from datasheaf.operators import detection as D
from datasheaf.operators import filters as W
from datasheaf.operators import joins as J
from datasheaf.operators import segmentation as S
from datasheaf.operators.positions import group_index
from datasheaf.plans.registry import query

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]



def lines(t):
    """Lines numbered within their order, with box and category columns; sizes of a few to 500.

    Written once for a query: predictions and ground truth read the same table.
    """
    if "_lines" not in vars(t):
        t._lines = D.materialize(_lines(t))
    return t._lines


def _lines(t):
    numbered = group_index(
        t.lineitem.select("l_orderkey", "l_returnflag", *LINE_ORDER), "l_orderkey", LINE_ORDER, "id"
    )
    size = F.col("l_extendedprice")
    return numbered.select(
        F.col("l_orderkey").alias("image_id"), "id", F.ascii("l_returnflag").cast("long").alias("category_id"), "l_discount", "l_tax",
        (F.col("l_quantity") * 4).alias("x0"), (F.col("l_linenumber") * 20).cast("double").alias("y0"),
        (F.col("l_quantity") * 4 + size / 500).alias("x1"), (F.col("l_linenumber") * 20 + size / 1000).alias("y1"),
    )


def targets(t):
    g = lines(t)
    return g.withColumn("area", B.area(*[F.col(c) for c in D.BOX])).withColumn(
        "iscrowd", (F.col("l_tax") >= 0.08).cast("int")
    ).drop("l_discount", "l_tax")


def detections(t):
    """The boxes moved by the discount, scored by the tax."""
    p = lines(t)
    d = F.col("l_discount") * 200
    return p.select(
        "image_id", "id", "category_id", (F.col("x0") + d).alias("x0"), (F.col("y0") + d / 4).alias("y0"),
        (F.col("x1") + d).alias("x1"), (F.col("y1") + d / 4).alias("y1"), (1 - F.col("l_tax")).alias("score"),
    )


LINES = f"""l AS (SELECT l_orderkey AS image_id, ascii(l_returnflag)::BIGINT AS category_id, l_discount, l_tax,
    l_quantity * 4 AS x0, l_linenumber * 20.0::DOUBLE AS y0, l_quantity * 4 + l_extendedprice / 500 AS x1, l_linenumber * 20 + l_extendedprice / 1000 AS y1,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS id FROM lineitem),
  g AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, (l_tax >= 0.08)::INTEGER AS iscrowd FROM l),
  p AS (SELECT image_id, id, category_id, x0 + l_discount * 200 AS x0, y0 + l_discount * 200 / 4 AS y0, x1 + l_discount * 200 AS x1,
    y1 + l_discount * 200 / 4 AS y1, 1 - l_tax AS score FROM l),
  o AS (SELECT p.image_id, p.id AS pred, g.id AS gt, greatest(least(p.x1, g.x1) - greatest(p.x0, g.x0), 0) * greatest(least(p.y1, g.y1) - greatest(p.y0, g.y0), 0) AS inter,
    (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, g.area AS ga FROM p JOIN g ON g.image_id = p.image_id),
  iou AS (SELECT image_id, pred, gt, inter / (pa + ga - inter) AS iou FROM o WHERE inter > 0)"""


def plain(t):
    return targets(t).drop("iscrowd")


def pairs(t):
    return D.overlapping_pairs(detections(t), plain(t))


@query("pairwise_iou", f"WITH {LINES} SELECT image_id, pred, gt, round(iou, 6) AS iou FROM iou")
def _(t):
    return pairs(t).select(
        "image_id", F.col("a.id").alias("pred"), F.col("b.id").alias("gt"), F.round("iou", 6).alias("iou")
    )


@query("mean_best_iou", f"""WITH {LINES}, b AS (SELECT image_id, gt AS id, max(iou) AS best FROM iou GROUP BY ALL)
  SELECT round(avg(coalesce(best, 0)), 6) AS mean_best_iou FROM g LEFT JOIN b USING (image_id, id)""")
def _(t):
    return D.mean_best_iou(pairs(t), targets(t)).select(F.round("mean_best_iou", 6).alias("mean_best_iou"))


# Greedy procedures in SQL: a recursion takes the boxes or pairs of every image in order. Images have few boxes here.

def _greedy_sql(scope: list[str], pairs: str, name: str) -> str:
    """Recursive CTEs: the pairs of each scope in order of overlap, each chosen when both ends are free."""
    on = ", ".join(scope)
    return f"""{name}q AS (SELECT {on}, gt, pred, iou, row_number() OVER (PARTITION BY {on} ORDER BY iou DESC, gt, pred) AS k FROM {pairs}),
  {name}r AS (SELECT DISTINCT {on}, 0::BIGINT AS k, []::BIGINT[] AS gts, []::BIGINT[] AS preds FROM {name}q
    UNION ALL
    SELECT {on}, q.k, CASE WHEN list_contains(gts, gt) OR list_contains(preds, pred) THEN gts ELSE list_append(gts, gt) END,
      CASE WHEN list_contains(gts, gt) OR list_contains(preds, pred) THEN preds ELSE list_append(preds, pred) END
    FROM {name}r r JOIN {name}q q USING ({on}) WHERE q.k = r.k + 1),
  {name}l AS (SELECT {on}, arg_max(gts, k) AS gts, arg_max(preds, k) AS preds FROM {name}r GROUP BY ALL),
  {name} AS (SELECT {on}, unnest(gts) AS gt, unnest(preds) AS pred FROM {name}l)"""


def _matched_sql(top: str, slots: str) -> str:
    """Recursive CTEs: detections in order of score take the best free ground truth in each slot (area, t)."""
    return f"""e AS (SELECT image_id, category_id, area, t, det, score, gt, iscrowd = 1 AS crowd, iscrowd = 1 OR gt_area NOT BETWEEN lo AND hi AS ignored,
      row_number() OVER (PARTITION BY image_id, category_id, area, t
        ORDER BY score DESC, det, iscrowd = 1 OR gt_area NOT BETWEEN lo AND hi, iou DESC, gt DESC) AS k
    FROM d JOIN {top} k USING (image_id, category_id, det), {slots} WHERE gt_cat = category_id AND iou >= least(t, 1 - 1e-10)),
  er AS (SELECT DISTINCT image_id, category_id, area, t, 0::BIGINT AS k, []::BIGINT[] AS dets, []::BIGINT[] AS gts, []::BIGINT[] AS hits, []::BIGINT[] AS idle FROM e
    UNION ALL
    SELECT image_id, category_id, area, t, ek, CASE WHEN free THEN list_append(dets, det) ELSE dets END,
      CASE WHEN free AND NOT crowd THEN list_append(gts, gt) ELSE gts END,
      CASE WHEN free AND NOT ignored THEN list_append(hits, det) ELSE hits END, CASE WHEN free AND ignored THEN list_append(idle, det) ELSE idle END
    FROM (SELECT r.*, e.k AS ek, det, gt, crowd, ignored, NOT list_contains(dets, det) AND (crowd OR NOT list_contains(gts, gt)) AS free
          FROM er r JOIN e USING (image_id, category_id, area, t) WHERE e.k = r.k + 1) e),
  el AS (SELECT image_id, category_id, area, t, arg_max(hits, k) AS hits, arg_max(idle, k) AS idle FROM er GROUP BY ALL)"""


OVERLAPS = f"""{LINES},
  d AS (SELECT image_id, g.id AS gt, g.category_id AS gt_cat, p.category_id AS category_id, g.iscrowd, g.area AS gt_area, p.id AS det, p.score,
      CASE WHEN g.iscrowd = 1 THEN inter / pa ELSE inter / (pa + ga - inter) END AS iou
    FROM o JOIN g USING (image_id) JOIN p USING (image_id) WHERE g.id = o.gt AND p.id = o.pred AND inter > 0)"""
AREAS = """ar(area, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10))"""
THRESHOLDS = "th AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS t FROM range(0, 10) r(i))"
AP_CURVE = """f AS (SELECT category_id, area, t, score, image_id, id, coalesce(list_contains(hits, id), false) AS hit
    FROM (SELECT k.image_id, k.category_id, k.det AS id, k.score, k.area AS own, ar.area, lo, hi, t FROM k, ar, th)
    LEFT JOIN el USING (image_id, category_id, area, t)
    WHERE coalesce(list_contains(hits, id), false) OR (NOT coalesce(list_contains(idle, id), false) AND own BETWEEN lo AND hi)),
  n AS (SELECT category_id, area, count(*) AS npos FROM (SELECT category_id, ar.area FROM g, ar WHERE iscrowd = 0 AND g.area BETWEEN lo AND hi) GROUP BY ALL),
  c AS (SELECT category_id, area, t, hit, score, image_id, id, sum(hit::INT) OVER w AS tps, sum(hit::INT) OVER w / (count(*) OVER w)::DOUBLE AS prec FROM f
    WINDOW w AS (PARTITION BY category_id, area, t ORDER BY score DESC, image_id, id ROWS UNBOUNDED PRECEDING)),
  pr AS (SELECT *, tps / npos::DOUBLE AS rec, max(prec) OVER (PARTITION BY category_id, area, t ORDER BY score, image_id DESC, id DESC ROWS UNBOUNDED PRECEDING) AS env
    FROM c JOIN n USING (category_id, area) WHERE hit)"""


@query("nms", f"""WITH RECURSIVE {LINES},
  s AS (SELECT a.image_id, b.id, a.id AS better FROM p a JOIN p b ON a.image_id = b.image_id AND (a.score > b.score OR (a.score = b.score AND a.id < b.id))
    WHERE greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)
      / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)
         - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) > 0.1),
  q AS (SELECT image_id, id, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS k,
      coalesce((SELECT list(better) FROM s WHERE s.image_id = p.image_id AND s.id = p.id), []) AS beaten_by FROM p),
  r AS (SELECT image_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM (SELECT DISTINCT image_id FROM p)
    UNION ALL
    SELECT image_id, q.k, CASE WHEN list_has_any(kept, beaten_by) THEN kept ELSE list_append(kept, id) END
    FROM r JOIN q USING (image_id) WHERE q.k = r.k + 1),
  last AS (SELECT image_id, unnest(arg_max(kept, k)) AS id FROM r GROUP BY image_id)
  SELECT image_id, id, score FROM last JOIN p USING (image_id, id)""")
def _(t):
    return D.nms(detections(t), 0.1).select("image_id", "id", "score")


def named_pairs(t):
    return pairs(t).select("image_id", F.col("a.id").alias("pred"), F.col("b.id").alias("gt"), "iou")


@query("greedy_match", f"""WITH RECURSIVE {LINES}, {_greedy_sql(['image_id'], 'iou', 'm')}
  SELECT image_id, gt, pred, round(iou, 6) AS iou FROM m JOIN iou USING (image_id, gt, pred)""")
def _(t):
    return D.greedy_match(named_pairs(t)).withColumn("iou", F.round("iou", 6))


@query("proposal_recall", f"""WITH RECURSIVE {LINES}, {AREAS}, {THRESHOLDS}, lims(lim) AS (VALUES (100), (1000)),
  top AS (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) AS rank FROM p),
  pos AS (SELECT ar.area, image_id, id FROM g, ar WHERE iscrowd = 0 AND g.area BETWEEN lo AND hi),
  pairs AS (SELECT area, lim, image_id, gt, pred, iou FROM iou JOIN pos USING (image_id) JOIN top USING (image_id), lims
    WHERE pos.id = gt AND top.id = pred AND rank <= lim),
  {_greedy_sql(['area', 'lim', 'image_id'], 'pairs', 'm')},
  h AS (SELECT area, lim, t, count(*) AS hits FROM m JOIN iou USING (image_id, gt, pred), th WHERE iou >= t GROUP BY ALL),
  n AS (SELECT area, count(*) AS num_pos FROM pos GROUP BY ALL)
  SELECT area, lim, round(avg(coalesce(hits, 0) / num_pos), 6) AS ar, max(num_pos) AS num_pos
  FROM n CROSS JOIN lims CROSS JOIN th LEFT JOIN h USING (area, lim, t) GROUP BY area, lim""")
def _(t):
    r = D.proposal_recall(detections(t), targets(t))
    return r.groupBy("area", "lim").agg(F.round(F.avg("recall"), 6).alias("ar"), F.max("num_pos").alias("num_pos"))


@query("recall_from_overlaps", f"""WITH {LINES}, n AS (SELECT count(*) AS n FROM g),
  m AS (SELECT max(iou) AS iou FROM iou GROUP BY image_id, gt), t AS (SELECT unnest(range(0, 10)) AS i),
  h AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS threshold FROM t)
  SELECT threshold, (SELECT count(*) FROM m WHERE iou >= threshold) AS hits, round((SELECT count(*) FROM m WHERE iou >= threshold) / n, 6) AS recall FROM h, n""")
def _(t):
    best = named_pairs(t).groupBy("image_id", "gt").agg(F.max("iou").alias("iou"))
    matched = best.select(F.lit("all").alias("area"), F.lit(100).alias("lim"), "iou")
    totals = targets(t).agg(F.count(F.lit(1)).alias("num_pos")).withColumn("area", F.lit("all"))
    r = D.recall_from_overlaps(matched, totals, [100], D.IOU_THRESHOLDS)
    return r.select("threshold", "hits", F.round("recall", 6).alias("recall"))


@query("coco_ap", f"""WITH RECURSIVE {OVERLAPS}, {AREAS}, {THRESHOLDS},
  k AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, id AS det FROM p QUALIFY row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, id) <= 100),
  kk AS (SELECT image_id, category_id, det FROM k), {_matched_sql('kk', 'ar, th')}, {AP_CURVE},
  best AS (SELECT category_id, area, t, p, coalesce((SELECT max(prec) FROM pr WHERE pr.category_id = n.category_id AND pr.area = n.area AND pr.t = th.t AND rec >= p * 0.01), 0) AS prec
    FROM n, th, range(0, 101) pts(p)),
  ap AS (SELECT category_id, area, t, avg(prec) AS ap FROM best GROUP BY ALL)
  SELECT round(100 * avg(ap) FILTER (area = 'all'), 4) AS ap, round(100 * avg(ap) FILTER (area = 'all' AND t = 0.5), 4) AS ap50,
    round(100 * avg(ap) FILTER (area = 'all' AND t = 0.75), 4) AS ap75, round(100 * avg(ap) FILTER (area = 'small'), 4) AS aps,
    round(100 * avg(ap) FILTER (area = 'medium'), 4) AS apm, round(100 * avg(ap) FILTER (area = 'large'), 4) AS apl FROM ap""")
def _(t):
    return D.coco_summary(D.coco_ap(detections(t), targets(t))).select(
        *[F.round(c, 4).alias(c) for c in ("ap", "ap50", "ap75", "aps", "apm", "apl")]
    )


@query("pascal_map", f"""WITH RECURSIVE {OVERLAPS}, ar(area, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE)), th(t) AS (VALUES (0.5::DOUBLE)),
  k AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, id AS det FROM p),
  kk AS (SELECT image_id, category_id, det FROM k), {_matched_sql('kk', 'ar, th')}, {AP_CURVE}
  SELECT n.category_id, round(coalesce(sum(env) / max(n.npos), 0), 6) AS ap FROM n LEFT JOIN pr USING (category_id, area) GROUP BY n.category_id""")
def _(t):
    return D.pascal_map(detections(t), targets(t)).withColumn("ap", F.round("ap", 6))


# Curves from a matching that SQL can say: a line is a hit when its flag is not R.

CURVE = """m AS (SELECT l_suppkey AS category_id, 1 - l_tax AS score, l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS id,
    (l_returnflag <> 'R')::BIGINT AS tp FROM lineitem),
  c AS (SELECT *, sum(tp) OVER w AS tps, row_number() OVER w AS n, sum(tp) OVER (PARTITION BY category_id) + 10 AS npos FROM m
    WINDOW w AS (PARTITION BY category_id ORDER BY score DESC, image_id, id)),
  pr AS (SELECT *, tps / n::DOUBLE AS prec, tps / npos::DOUBLE AS rec FROM c)"""


def _curve(t, keep=()):
    """Matches, positives and curve over all lines with the supplier as category."""
    n = group_index(t.lineitem.select("l_orderkey", "l_returnflag", *LINE_ORDER), "l_orderkey", LINE_ORDER, "id")
    hit = (F.col("l_returnflag") != "R").cast("long")
    m = n.select(
        F.col("l_suppkey").alias("category_id"), (1 - F.col("l_tax")).alias("score"),
        F.col("l_orderkey").alias("image_id"), "id", hit.alias("hits"),
        F.lit(1).cast("long").alias("counted"),
    )
    m = D.materialize(m)  # read several times
    npos = m.groupBy("category_id").agg((F.sum("hits") + 10).alias("npos")).withColumn("area", F.lit("all"))
    return D.precision_recall(m, npos, [0.5], keep=keep), npos


@query("precision_recall", f"WITH {CURVE} SELECT category_id, image_id, id, round(prec, 6) AS prec, round(rec, 6) AS rec FROM pr WHERE tp = 1")
def _(t):
    c, _ = _curve(t, ["score", "image_id", "id"])
    return D.curve_rows(c, [0.5]).select("category_id", "image_id", "id", F.round("precision", 6).alias("prec"), F.round("recall", 6).alias("rec"))


@query("interpolated_ap", f"""WITH {CURVE}, k AS (SELECT unnest(range(0, 101)) * 0.01::DOUBLE AS r),
  x AS (SELECT category_id, r, max(CASE WHEN rec >= r THEN prec END) AS p FROM pr, k GROUP BY ALL)
  SELECT category_id, round(sum(coalesce(p, 0)) / 101, 6) AS ap FROM x GROUP BY category_id""")
def _(t):
    c, npos = _curve(t)
    return D.interpolated_ap(c, npos, [0.5]).select("category_id", F.round("ap", 6).alias("ap"))


@query("all_point_ap", f"""WITH {CURVE}, e AS (SELECT *, max(prec) OVER (PARTITION BY category_id ORDER BY n DESC) AS env FROM pr)
  SELECT category_id, round(sum(tp * env) / max(npos), 6) AS ap FROM e GROUP BY category_id""")
def _(t):
    c, npos = _curve(t)
    return D.all_point_ap(c, npos, [0.5]).select("category_id", F.round("ap", 6).alias("ap"))


# Classes of boxes by flag and quantity under their flags, and those under two roots.
PARENTS = "hp(category_id, parent_id) AS (SELECT c * 10 + i, c FROM (VALUES (65), (78), (82)) t(c), range(0, 3) r(i) UNION ALL VALUES (65, 1), (78, 1), (82, 2))"
UP = """hc AS (SELECT category_id, category_id AS ancestor FROM hp UNION SELECT parent_id, parent_id FROM hp UNION SELECT category_id, parent_id FROM hp
    UNION SELECT a.category_id, b.parent_id FROM hp a JOIN hp b ON a.parent_id = b.category_id)"""
GROUP_HITS = """gi AS (SELECT image_id, category_id, unnest(idle) AS det FROM el),
  gb AS (SELECT image_id, category_id, det, score, arg_min(gt, (-iou, gt)) AS gt FROM gi JOIN d USING (image_id, category_id, det)
    WHERE gt_cat = category_id AND iscrowd = 1 AND iou >= 0.5 GROUP BY ALL),
  gf AS (SELECT image_id, category_id, arg_min(det, (-score, det)) AS det FROM gb GROUP BY image_id, category_id, gt),
  el2 AS (SELECT image_id, category_id, area, t, list_concat(hits, coalesce(more, [])) AS hits, list_filter(idle, lambda x: NOT list_contains(coalesce(more, []), x)) AS idle
    FROM el LEFT JOIN (SELECT image_id, category_id, list(det) AS more FROM gf GROUP BY ALL) USING (image_id, category_id))"""


@query("open_images_ap", f"""WITH RECURSIVE {LINES.replace('  g AS (', '  g0 AS (').replace('  p AS (', '  p0 AS (').replace('FROM p JOIN g ON', 'FROM p JOIN g ON p.category_id = g.category_id AND')
    .replace('  o AS (', f"""  {PARENTS}, {UP},
  g1 AS (SELECT * REPLACE (category_id * 10 + id % 3 AS category_id) FROM g0), p1 AS (SELECT * REPLACE (category_id * 10 + id % 3 AS category_id) FROM p0),
  g AS (SELECT g1.* REPLACE (ancestor AS category_id) FROM g1 JOIN hc USING (category_id)), p AS (SELECT p1.* REPLACE (ancestor AS category_id) FROM p1 JOIN hc USING (category_id)),
  o AS (""").replace('SELECT p.image_id, p.id AS pred', 'SELECT p.image_id, p.category_id, p.score, g.iscrowd, p.id AS pred')},
  d AS (SELECT image_id, gt, category_id AS gt_cat, category_id, iscrowd, ga AS gt_area, pred AS det, score,
      CASE WHEN iscrowd = 1 THEN inter / pa ELSE inter / (pa + ga - inter) END AS iou FROM o WHERE inter > 0),
  ar(area, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE)), th(t) AS (VALUES (0.5::DOUBLE)),
  k AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, id AS det FROM p), kk AS (SELECT image_id, category_id, det FROM k),
  {_matched_sql('kk', 'ar, th')}, {GROUP_HITS}, {AP_CURVE.replace('LEFT JOIN el USING', 'LEFT JOIN el2 USING').replace('WHERE iscrowd = 0 AND g.area', 'WHERE g.area')}
  SELECT n.category_id, round(coalesce(sum(env) / max(n.npos), 0), 6) AS ap FROM n LEFT JOIN pr USING (category_id, area) GROUP BY n.category_id""")
def _(t):
    """Classes of two levels below two roots; crowds are groups."""
    fine = (F.col("category_id") * 10 + F.col("id") % 3).alias("category_id")
    rows = [(c * 10 + i, c) for c in (65, 78, 82) for i in range(3)] + [(65, 1), (78, 1), (82, 2)]
    parents = t.spark.createDataFrame(rows, "category_id long, parent_id long")
    gt = targets(t).withColumn("category_id", fine).withColumn("is_group", F.col("iscrowd") == 1).drop("iscrowd")
    return D.open_images_ap(detections(t).withColumn("category_id", fine), gt, parents).withColumn("ap", F.round("ap", 6))


def poses(t):
    """Four people an image: 17 keypoints from the vectors, seen where the third number is positive, none for label 0; two detections each."""
    e, scale = A.as_double("embedding"), 100.0
    area = (500.0 + F.col("label") * 1500.0).alias("area")
    base = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 4).alias("image_id"), F.lit(1).cast("long").alias("category_id"), "label",
                               area, F.slice(F.transform(e, lambda v: v * scale), 1, 51).alias("v"))
    seen = F.transform("v", lambda v, i: F.when(i % 3 == 2, F.when((v > 0) & (F.col("label") > 0), 2.0).otherwise(0.0)).otherwise(v))
    x0, y0, side = F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.sqrt("area")
    gt = base.select("image_id", "category_id", F.col("vec_id").alias("id"), seen.alias("keypoints"), "area", (F.col("label") == 9).cast("int").alias("iscrowd"),
                     x0.alias("x0"), y0.alias("y0"), (x0 + side).alias("x1"), (y0 + side).alias("y1"))
    two = base.withColumn("j", F.explode(F.lit([0, 1])))
    move = F.sqrt("area") * 0.02 * (F.col("vec_id") % 7 + 4 * F.col("j")) + 0.5
    moved = F.transform("v", lambda v, i: F.when(i % 3 == 2, 1.0).otherwise(v + move))
    dets = two.select("image_id", "category_id", (F.col("vec_id") * 2 + F.col("j")).alias("id"), D.pixel_keypoints(moved).alias("keypoints"),
                      ((F.col("vec_id") % 10 - F.col("j") * 0.5) / 10).alias("score"))
    return dets, gt


POSES = """em AS (SELECT vec_id, vec_id // 4 AS image_id, label, 500.0::DOUBLE + label * 1500 AS area, list_transform(embedding, lambda x: x::DOUBLE * 100) AS v FROM embeddings),
  g AS (SELECT image_id, 1::BIGINT AS category_id, vec_id AS id, (label = 9)::INTEGER AS iscrowd, area AS real_area, v, v[1] AS x0, v[2] AS y0, sqrt(area) AS side,
      label = 0 OR len(list_filter(v[1:51], lambda x, i: i % 3 = 0 AND x > 0)) = 0 AS free,
      CASE WHEN label = 0 OR len(list_filter(v[1:51], lambda x, i: i % 3 = 0 AND x > 0)) = 0 THEN -1.0 ELSE area END AS area FROM em),
  p AS (SELECT image_id, 1::BIGINT AS category_id, vec_id * 2 + j AS id, (vec_id % 10 - j * 0.5::DOUBLE) / 10 AS score, v, sqrt(area) * 0.02::DOUBLE * (vec_id % 7 + 4 * j) AS move
    FROM em, (VALUES (0), (1)) t(j)),
  s(i, sigma) AS (SELECT i, [SIGMAS][i + 1]::DOUBLE FROM range(0, 17) r(i)),
  o AS (SELECT p.image_id, p.id AS det, g.id AS gt, g.category_id AS gt_cat, p.category_id, p.score, g.iscrowd, g.area AS gt_area,
      CASE WHEN free THEN avg(exp(0 - (greatest(0, x0 - side - p.v[3 * i + 1] - move) + greatest(0, p.v[3 * i + 1] + move - x0 - 2 * side)) ** 2 / (8 * sigma ** 2 * real_area)
          - (greatest(0, y0 - side - p.v[3 * i + 2] - move) + greatest(0, p.v[3 * i + 2] + move - y0 - 2 * side)) ** 2 / (8 * sigma ** 2 * real_area)))
        ELSE avg(exp(-((p.v[3 * i + 1] + move - g.v[3 * i + 1]) ** 2 + (p.v[3 * i + 2] + move - g.v[3 * i + 2]) ** 2) / (8 * sigma ** 2 * real_area))) FILTER (g.v[3 * i + 3] > 0) END AS iou
    FROM p JOIN g USING (image_id), s GROUP BY p.image_id, p.id, g.id, g.category_id, p.category_id, p.score, g.iscrowd, g.area, free),
  d AS (SELECT * FROM o)""".replace("SIGMAS", ", ".join(map(str, D.OKS_SIGMAS)))


@query("keypoint_ap", f"""WITH RECURSIVE {POSES}, ar(area, lo, hi) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)), {THRESHOLDS},
  k AS (SELECT *, id AS det, (list_max(list_filter(v[1:51], lambda x, i: i % 3 = 1)) - list_min(list_filter(v[1:51], lambda x, i: i % 3 = 1)))
      * (list_max(list_filter(v[1:51], lambda x, i: i % 3 = 2)) - list_min(list_filter(v[1:51], lambda x, i: i % 3 = 2))) AS area
    FROM p QUALIFY row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, id) <= 20),
  kk AS (SELECT image_id, category_id, det FROM k), {_matched_sql('kk', 'ar, th')}, {AP_CURVE},
  best AS (SELECT category_id, area, t, p, coalesce((SELECT max(prec) FROM pr WHERE pr.category_id = n.category_id AND pr.area = n.area AND pr.t = th.t AND rec >= p * 0.01), 0) AS prec
    FROM n, th, range(0, 101) pts(p)),
  ap AS (SELECT category_id, area, t, avg(prec) AS ap FROM best GROUP BY ALL)
  SELECT round(100 * avg(ap) FILTER (area = 'all'), 4) AS ap, round(100 * avg(ap) FILTER (area = 'all' AND t = 0.5), 4) AS ap50,
    round(100 * avg(ap) FILTER (area = 'all' AND t = 0.75), 4) AS ap75, round(100 * avg(ap) FILTER (area = 'medium'), 4) AS apm, round(100 * avg(ap) FILTER (area = 'large'), 4) AS apl FROM ap""")
def _(t):
    ap = D.keypoint_ap(*poses(t))
    return ap.select(*[F.round(c, 4).alias(c) for c in ap.columns])


@query("keypoint_oks", """WITH k AS (SELECT vec_id, embedding::DOUBLE[] AS p, list_reverse(embedding::DOUBLE[]) AS q FROM embeddings),
  x AS (SELECT vec_id, p, q, unnest(range(0, 17)) AS i FROM k)
  SELECT vec_id, round(sum(CASE WHEN q[3 * i + 3] > 0 THEN exp(-((p[3 * i + 1] - q[3 * i + 1]) ** 2 + (p[3 * i + 2] - q[3 * i + 2]) ** 2) / (2 * 0.5 * (2 * (0.025 + 0.005 * i)) ** 2)) ELSE 0 END)
    / nullif(count(*) FILTER (q[3 * i + 3] > 0), 0), 6) AS oks FROM x GROUP BY vec_id""")
def _(t):
    sigmas = [0.025 + 0.005 * i for i in range(17)]
    e = A.as_double("embedding")
    k = t.embeddings.select("vec_id", e.alias("p"), F.reverse(e).alias("q"))
    return k.select("vec_id", F.round(B.oks(F.col("p"), F.col("q"), sigmas, F.lit(0.5)), 6).alias("oks"))


@query("box_convert", f"""WITH {LINES} SELECT image_id, id, x0 AS x, y0 AS y, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, round(area, 4) AS area, y0 AS flip_x0, x0 AS flip_y0 FROM g""")
def _(t):
    x, y, w, h = B.xyxy_to_xywh(*[F.col(c) for c in D.BOX])
    fx, fy, _, _ = B.yxyx_to_xyxy(*[F.col(c) for c in D.BOX])
    return targets(t).select(
        "image_id", "id", x.alias("x"), y.alias("y"), F.round(w, 6).alias("w"), F.round(h, 6).alias("h"),
        F.round("area", 4).alias("area"), fx.alias("flip_x0"), fy.alias("flip_y0"),
    )


@query("coco_result_rows", f"""WITH {LINES} SELECT image_id, category_id, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, round(score, 4) AS score FROM p""")
def _(t):
    r = D.coco_result_rows(detections(t))
    return r.select(
        "image_id", "category_id", *[F.round(F.get("bbox", F.lit(i)), 6).alias(c) for i, c in enumerate("xywh")],
        F.round("score", 4).alias("score"),
    )


@query("score_floor", f"WITH {LINES} SELECT image_id, id FROM p WHERE score >= 0.95")
def _(t):
    return W.score_floor(detections(t), "score", 0.95).select("image_id", "id")


@query("area_ranges", f"""WITH {LINES}, r AS (SELECT * FROM (VALUES ('all', 0, 1e10), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10),
    ('96-128', 9216, 16384), ('128-256', 16384, 65536), ('256-512', 65536, 262144), ('512-inf', 262144, 1e10)) v(name, lo, hi))
  SELECT name, count(*) AS n FROM g JOIN r ON area BETWEEN lo AND hi GROUP BY name""")
def _(t):
    names = F.explode(J.matched_in_bands(F.col("area"), D.AREA_RANGES))
    return targets(t).select(names.alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("filter_crowd_only", """SELECT DISTINCT l_orderkey AS image_id FROM lineitem WHERE coalesce(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END, 0) = 0""")
def _(t):
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
    return W.images_with_usable_annotations(t.lineitem.select(F.col("l_orderkey").alias("image_id"), flag.alias("iscrowd")))


@query("filter_few_keypoints", """WITH k AS (SELECT label AS image_id, vec_id, len(list_filter(embedding, lambda x, i: (i - 1) % 3 = 2 AND x > 0)) AS n FROM embeddings)
  SELECT image_id, sum(n)::BIGINT AS n FROM k GROUP BY 1 HAVING sum(n) >= 480""")
def _(t):
    ann = t.embeddings.select(F.col("label").alias("image_id"), F.col("embedding").alias("keypoints"))
    return W.drop_images_with_few_keypoints(ann, 480)


@query("images_with_all_categories", """SELECT l_orderkey AS image_id, l_linenumber AS category_id, l_linenumber - 1 AS label FROM lineitem WHERE l_linenumber IN (1, 2, 3)
  AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3)""")
def _(t):
    ann = t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("category_id"))
    return W.images_with_categories(ann, [1, 2, 3])


@query("attach_proposals", """WITH x AS (SELECT vec_id, unnest(range(0, 8)) AS i, embedding FROM embeddings),
  r AS (SELECT vec_id, embedding[i + 1]::DOUBLE AS score, embedding[8 + i * 4 + 1]::DOUBLE AS x0, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) - 1 AS rank FROM x)
  SELECT vec_id AS image_id, rank::INTEGER AS rank, round(score, 6) AS score, round(x0, 6) AS x0 FROM r""")
def _(t):
    e = A.as_double("embedding")
    boxes = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(
        *[F.get(e, 8 + i * 4 + k).alias(c) for k, c in enumerate(D.BOX)]
    ))
    props = t.embeddings.select(
        F.col("vec_id").cast("string").alias("id"), F.slice(e, 1, 8).alias("objectness_logits"), boxes.alias("boxes")
    )
    images = t.embeddings.select(F.col("vec_id").alias("image_id"))
    out = J.attach_proposals(images, props)
    z = out.select("image_id", F.posexplode(F.arrays_zip("objectness_logits", "boxes")).alias("rank", "z"))
    return z.select(
        "image_id", "rank", F.round("z.objectness_logits", 6).alias("score"), F.round("z.boxes.x0", 6).alias("x0")
    )


# Segments: pixels are lines, an image an order; predicted segments by flag, true ones by status.

def pixels(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.ascii("l_returnflag").alias("pred_id"),
        F.when(F.col("l_tax") > 0.01, F.ascii("l_linestatus")).alias("gt_id"),
    )


@query("panoptic_quality", """WITH px AS (SELECT l_orderkey AS image_id, ascii(l_returnflag) AS pred_id, CASE WHEN l_tax > 0.01 THEN ascii(l_linestatus) END AS gt_id, o_orderstatus AS cat
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  ov AS (SELECT image_id, pred_id, gt_id, cat, count(*) AS n FROM px GROUP BY ALL),
  p AS (SELECT image_id, pred_id, any_value(cat) AS cat, sum(n) AS pa, coalesce(sum(n) FILTER (gt_id IS NULL), 0) AS void FROM ov GROUP BY ALL),
  g AS (SELECT image_id, gt_id, any_value(cat) AS cat, sum(n) AS ga FROM ov WHERE gt_id IS NOT NULL GROUP BY ALL),
  h AS (SELECT ov.image_id, ov.pred_id, ov.gt_id, p.cat, n / (pa + ga - n - void)::DOUBLE AS iou FROM ov JOIN p ON p.image_id = ov.image_id AND p.pred_id = ov.pred_id
    JOIN g ON g.image_id = ov.image_id AND g.gt_id = ov.gt_id WHERE n / (pa + ga - n - void)::DOUBLE > 0.5),
  k AS (SELECT cat, 'tp' AS k, iou FROM h UNION ALL SELECT cat, 'fp', 0 FROM p WHERE void / pa <= 0.5 AND (image_id, pred_id) NOT IN (SELECT image_id, pred_id FROM h)
    UNION ALL SELECT cat, 'fn', 0 FROM g WHERE (image_id, gt_id) NOT IN (SELECT image_id, gt_id FROM h)),
  c AS (SELECT cat, count(*) FILTER (k = 'tp') AS tp, count(*) FILTER (k = 'fp') AS fp, count(*) FILTER (k = 'fn') AS fn, sum(iou) AS iou FROM k GROUP BY cat),
  q AS (SELECT cat <> 'P' AS thing, iou / (tp + 0.5 * fp + 0.5 * fn) AS pq, CASE WHEN tp > 0 THEN iou / tp ELSE 0 END AS sq, tp / (tp + 0.5 * fp + 0.5 * fn) AS rq FROM c),
  z AS (SELECT 'all' AS kind, * FROM q UNION ALL SELECT CASE WHEN thing THEN 'things' ELSE 'stuff' END, * FROM q)
  SELECT kind, count(*) AS n, round(avg(pq) * 100, 6) AS pq, round(avg(sq) * 100, 6) AS sq, round(avg(rq) * 100, 6) AS rq FROM z GROUP BY kind""")
def _(t):
    px = pixels(t)
    overlaps = px.groupBy("image_id", "pred_id", "gt_id").agg(F.count(F.lit(1)).alias("n"))
    cats = t.orders.select(F.col("o_orderkey").alias("image_id"), F.col("o_orderstatus").alias("category_id"))
    pred = px.select("image_id", F.col("pred_id").alias("segment_id")).distinct().join(cats, "image_id")
    gt = px.filter("gt_id IS NOT NULL").select("image_id", F.col("gt_id").alias("segment_id")).distinct().join(cats, "image_id")
    things = t.orders.select(F.col("o_orderstatus").alias("category_id")).distinct().withColumn("isthing", F.col("category_id") != "P")
    q = S.panoptic_quality(S.panoptic_counts(overlaps, pred, gt), things)
    return q.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])


@query("box_from_mask", """WITH b AS (SELECT l_orderkey AS image_id, l_linenumber AS obj, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey) AS x1, max(l_suppkey) AS y1 FROM lineitem GROUP BY ALL)
  SELECT * FROM b QUALIFY obj > min(obj) OVER (PARTITION BY image_id)""")
def _(t):
    return S.box_from_mask(t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("obj"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")
    ))
