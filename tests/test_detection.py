"""Greedy detection procedures against the sequential algorithms, written from their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from datasheaf.operators import detection as D
from datasheaf.session import written

BOX = "x0 double, y0 double, x1 double, y1 double"


def box(rnd, size=60):
    x, y = rnd.randint(0, 60), rnd.randint(0, 60)
    return (float(x), float(y), float(x + rnd.randint(4, size)), float(y + rnd.randint(4, size)))


def iou(a, b, crowd=False):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) if crowd else area(a) + area(b) - w * h)


def fixture(seed, images=4, per=14, size=60):
    rnd = random.Random(seed)
    gt, dets = [], []
    for im in range(images):
        n = per * 4 if im == 0 else rnd.randint(0, per)
        for i in range(n):
            b = box(rnd, size)
            a = (b[2] - b[0]) * (b[3] - b[1])
            gt.append((im, rnd.randint(1, 2), i, *b, a, int(rnd.random() < 0.15)))
            for k in range(rnd.randint(0, 2)):
                d = tuple(v + rnd.randint(-3, 3) for v in b)
                if d[2] > d[0] and d[3] > d[1]:
                    cat = gt[-1][1] if rnd.random() < 0.9 else 3 - gt[-1][1]
                    dets.append((im, cat, 2 * i + k, *d, rnd.randint(1, 9) / 10))
    return gt, dets


def frames(spark, gt, dets):
    g = spark.createDataFrame(gt, f"image_id long, category_id long, id long, {BOX}, area double, iscrowd int")
    d = spark.createDataFrame(dets, f"image_id long, category_id long, id long, {BOX}, score double")
    return g, d


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs(spark, seed):
    gt, dets = fixture(seed)
    g, d = frames(spark, gt, dets)
    got = {(r["image_id"], r["a"]["id"], r["b"]["id"]): r["iou"] for r in D.overlapping_pairs(d, g.drop("iscrowd")).collect()}
    want = {(p[0], p[2], q[2]): iou(p[3:7], q[3:7]) for p in dets for q in gt if p[0] == q[0] and iou(p[3:7], q[3:7]) > 0}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("seed,limit,tier", [(1, 0.1, 256), (2, 0.5, 256), (1, 0.3, 3), (2, 0.05, 1)])
def test_nms(spark, seed, limit, tier):
    gt, dets = fixture(seed)
    _, d = frames(spark, gt, dets)
    got = {(r["image_id"], r["id"]) for r in D.nms(d, limit, first_tier=tier).collect()}
    want = set()
    for im in {p[0] for p in dets}:
        kept = []
        for p in sorted((p for p in dets if p[0] == im), key=lambda p: (-p[7], p[2])):
            if all(iou(p[3:7], q[3:7]) <= limit for q in kept):
                kept.append(p)
        want |= {(im, p[2]) for p in kept}
    assert got == want


def greedy(pairs):
    """pairs: (iou, gt, pred) of one image."""
    out, g, p = [], set(), set()
    for v, a, b in sorted(pairs, key=lambda t: (-t[0], t[1], t[2])):
        if a not in g and b not in p:
            out.append((a, b, v))
            g.add(a)
            p.add(b)
    return out


def test_greedy_match(spark):
    gt, dets = fixture(3)
    g, d = frames(spark, gt, dets)
    from pyspark.sql import functions as F

    pairs = D.overlapping_pairs(d, g.drop("iscrowd")).select(
        "image_id", F.col("a.id").alias("pred"), F.col("b.id").alias("gt"), "iou"
    )
    got = {(r["image_id"], r["gt"], r["pred"]) for r in D.greedy_match(pairs).collect()}
    want = set()
    for im in range(4):
        ps = [(iou(p[3:7], q[3:7]), q[2], p[2]) for p in dets for q in gt if p[0] == q[0] == im]
        want |= {(im, a, b) for a, b, v in greedy([t for t in ps if t[0] > 0])}
    assert got == want


def test_proposal_recall(spark):
    gt, dets = fixture(4)
    g, d = frames(spark, gt, dets)
    rows = D.proposal_recall(d, g, limits=(3, 1000)).collect()
    got = {(r["area"], r["lim"], r["threshold"]): (r["hits"], r["num_pos"]) for r in rows}
    for name, lo, hi in D.AREA_RANGES[:4]:
        for lim in (3, 1000):
            best, pos = [], 0
            for im in range(4):
                ps = sorted((p for p in dets if p[0] == im), key=lambda p: (-p[7], p[2]))
                gs = [q for q in gt if q[0] == im and not q[8]]
                if not ps or not gs:
                    continue
                gs = [q for q in gs if lo <= q[7] <= hi]
                pos += len(gs)
                best += [v for _, _, v in greedy([(iou(p[3:7], q[3:7]), q[2], p[2]) for p in ps[:lim] for q in gs])]
            if pos:
                for t in D.IOU_THRESHOLDS:
                    assert got[name, lim, t] == (sum(v >= t for v in best), pos)


def coco_reference(gt, dets, thresholds, bands, max_dets=100):
    """Category, area, threshold -> AP by the sequential evaluation."""
    out = {}
    cats = sorted({q[1] for q in gt})
    for cat in cats:
        for name, lo, hi in bands:
            npos = sum(1 for q in gt if q[1] == cat and not q[8] and lo <= q[7] <= hi)
            if not npos:
                continue
            for t in thresholds:
                flags = []
                for im in sorted({p[0] for p in dets}):
                    ds = sorted((p for p in dets if p[:2] == (im, cat)), key=lambda p: (-p[7], p[2]))[:max_dets]
                    gs = [(q, bool(q[8]) or not lo <= q[7] <= hi) for q in gt if q[:2] == (im, cat)]
                    gs.sort(key=lambda x: x[1])
                    used = set()
                    for p in ds:
                        best, m = min(t, 1 - 1e-10), None
                        for q, ig in gs:
                            if q[2] in used and not q[8]:
                                continue
                            if m is not None and not m[1] and ig:
                                break
                            v = iou(p[3:7], q[3:7], bool(q[8]))
                            if v < best:
                                continue
                            best, m = v, (q, ig)
                        area = (p[5] - p[3]) * (p[6] - p[4])
                        if m is not None:
                            used.add(m[0][2])
                            flags.append((-p[7], im, p[2], None if m[1] else True))
                        else:
                            flags.append((-p[7], im, p[2], False if lo <= area <= hi else None))
                tp = fp = 0
                curve = []
                for _, _, _, ok in sorted(flags, key=lambda f: f[:3]):
                    if ok is None:
                        continue
                    tp, fp = tp + bool(ok), fp + (not ok)
                    curve.append((tp / npos, tp / (tp + fp)))
                ps = [max((p for r, p in curve if r >= i * 0.01), default=0.0) for i in range(101)]
                env, area, last = 0.0, 0.0, None
                for r, p in reversed(curve):
                    env = max(env, p)
                hits = [j for j in range(len(curve)) if curve[j][0] > (curve[j - 1][0] if j else 0)]
                area = sum(max(p for _, p in curve[j:]) for j in hits) / npos
                out[cat, name, t] = (sum(ps) / 101, area)
    return out


@pytest.mark.parametrize("seed,slots", [(5, 62), (6, 62), (6, 10)])
def test_coco_and_pascal(spark, seed, slots, monkeypatch):
    from datasheaf.operators import positions

    monkeypatch.setattr(positions, "ROWS_PER_RANGE", 7)
    monkeypatch.setattr(D, "MAX_SLOTS", slots)
    gt, dets = fixture(seed)
    g, d = frames(spark, gt, dets)
    bands = [b for b in D.AREA_RANGES if b[0] in ("all", "small", "medium")]
    want = coco_reference(gt, dets, D.IOU_THRESHOLDS, bands)
    got = {
        (r["category_id"], r["area"], r["threshold"]): r["ap"]
        for r in D.coco_ap(d, g, [b[0] for b in bands]).collect()
    }
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v[0], abs=1e-9), k
    one = coco_reference(gt, dets, [0.5], D.AREA_RANGES[:1], max_dets=10**9)
    pas = {r["category_id"]: r["ap"] for r in D.pascal_map(d, g).collect()}
    assert pas == {k[0]: pytest.approx(v[1], abs=1e-9) for k, v in one.items()}


def test_missing_area_is_null(spark):
    g, d = frames(spark, [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 100.0, 0)], [(1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.9)])
    s = D.coco_summary(D.coco_ap(d, g)).first()
    assert s["ap"] == pytest.approx(100.0) and s["aps"] == pytest.approx(100.0) and s["apl"] is None


def test_mean_best_iou_counts_lonely_targets(spark):
    gt, dets = fixture(7)
    g, d = frames(spark, gt, dets)
    got = D.mean_best_iou(D.overlapping_pairs(d, g.drop("iscrowd")), g).first()[0]
    best = [max((iou(p[3:7], q[3:7]) for p in dets if p[0] == q[0]), default=0.0) for q in gt]
    assert got == pytest.approx(sum(best) / len(best))


def expected_nms(dets, limit):
    kept = []
    for im in {p[0] for p in dets}:
        here = []
        for p in sorted((p for p in dets if p[0] == im), key=lambda p: (-p[7], p[2])):
            if all(iou(p[3:7], q[3:7]) <= limit for q in here):
                here.append(p)
        kept += here
    return {(p[0], p[2]) for p in kept}


@pytest.mark.parametrize("most", [1, 7, 60])
def test_large_scopes_are_settled_in_stretches(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MAX_EDGES", most)
    gt, dets = fixture(5, images=3, per=6)
    g, d = frames(spark, gt, dets)
    assert {(r.image_id, r.id) for r in D.nms(d, 0.3).collect()} == expected_nms(dets, 0.3)
    from pyspark.sql import functions as F

    pairs = D.overlapping_pairs(d, g.drop("iscrowd")).select("image_id", F.col("a.id").alias("pred"), F.col("b.id").alias("gt"), "iou")
    got = {(r.image_id, r.gt, r.pred) for r in D.greedy_match(pairs).collect()}
    want = set()
    for im in range(3):
        ps = [(iou(p[3:7], q[3:7]), q[2], p[2]) for p in dets for q in gt if p[0] == q[0] == im]
        want |= {(im, a, b) for a, b, v in greedy([t for t in ps if t[0] > 0])}
    assert got == want


def test_matches_in_stretches(spark, monkeypatch):
    gt, dets = fixture(6, images=3, per=6)
    g, d = frames(spark, gt, dets)
    whole = sorted(D.coco_matches(d, g, [0.3, 0.5], ["all", "small"]).collect())
    monkeypatch.setattr(D, "MAX_EDGES", 4)
    assert sorted(D.coco_matches(d, g, [0.3, 0.5], ["all", "small"]).collect()) == whole


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    """Each of 10,000 boxes overlaps the next, slightly worse one: plain rounds would take 5,000."""
    n = 10_000
    dets = [(0, 1, i, float(i * 10), 0.0, float(i * 10 + 14), 10.0, 1 - i / n) for i in range(n)]
    _, d = frames(spark, [(0, 1, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0)], dets)
    rounds = []
    read = D._read_in_order
    monkeypatch.setattr(D, "_read_in_order", lambda *a: rounds.append(1) or read(*a))
    assert {r.id for r in D.nms(d, 0.1, first_tier=n).select("id").collect()} == set(range(0, n, 2))
    assert len(rounds) == 1


def test_boxes_of_very_different_sizes(spark):
    """One box a million times the others, which lie side by side: no cell holds more than a few small ones."""
    side = 200
    small = [(0, 1, i, float(i % side), float(i // side), i % side + 0.9, i // side + 0.9, 0.5) for i in range(side * side)]
    huge = (0, 1, side * side, -5e5, -5e5, 5e5, 5e5, 0.9)
    flat = (0, 1, side * side + 1, 3.0, 3.0, 3.0, 9.0, 0.9)
    _, d = frames(spark, [(0, 1, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 0)], [*small, huge, flat])
    pairs = D.overlapping_pairs(d, d).selectExpr("a.id AS a", "b.id AS b")
    # Every box with itself, and the huge one with each small one both ways.
    assert pairs.count() == side * side + 1 + 2 * side * side
    assert pairs.filter("a = b").count() == side * side + 1
    assert D._listed(D._sized(d).withColumn("__own", D.F.lit(0)), "a", ["image_id"], D.F.lit(0)).filter("a.id < 40000").groupBy(
        "__cx", "__cy").count().agg({"count": "max"}).first()[0] <= 4


def test_keypoints_must_fit_the_sigmas(spark):
    from pyspark.sql import functions as F

    dets = spark.createDataFrame([(0, 1, 0, [1.0] * 6, 0.5)], "image_id long, category_id long, id long, keypoints array<double>, score double")
    gt = spark.createDataFrame([(0, 1, 0, [1.0] * 6, 10.0, 0, 0.0, 0.0, 3.0, 3.0)],
                               f"image_id long, category_id long, id long, keypoints array<double>, area double, iscrowd int, {BOX}")
    with pytest.raises(ValueError, match="17 sigmas, but a detection has 2 keypoints"):
        D.keypoint_ap(dets, gt)
    whole = D.keypoint_ap(dets, gt.withColumn("area", F.lit(2000.0)), [0.05, 0.05]).first()
    assert (whole.ap, whole.apm, whole.apl) == (pytest.approx(100.0), pytest.approx(100.0), None)
    assert D.keypoint_ap(dets.limit(0), gt.limit(0)).first().ap is None
    assert dets.select(D.pixel_keypoints(F.col("keypoints")).alias("k")).first().k == [0.5, 0.5, 1.0, 0.5, 0.5, 1.0]


@pytest.mark.parametrize("few", [0, 3, 64])
def test_pairs_of_crowded_and_other_images(spark, monkeypatch, few):
    """One image above the bound and others below it: the same pairs as from comparing all boxes, each once."""
    monkeypatch.setattr(D, "FEW_BOXES", few)
    gt, dets = fixture(4)
    gt = gt + [(10**6, 1, 1, 0.0, 0.0, 5.0, 5.0, 25.0, 0)]
    dets = dets + [(10**6, 1, 1, 1.0, 1.0, 4.0, 6.0, 0.5), (10**6, 1, 2, 1.0, 1.0, 1.0, 6.0, 0.5)]
    g, d = frames(spark, gt, dets)
    got = [(r["image_id"], r["a"]["id"], r["b"]["id"]) for r in D.overlapping_pairs(d, g.drop("iscrowd")).collect()]
    want = [(p[0], p[2], q[2]) for p in dets for q in gt if p[0] == q[0] and p[5] > p[3] and iou(p[3:7], q[3:7]) > 0]
    assert sorted(got) == sorted(want)


def test_limits_that_hold_all_proposals_are_matched_once(spark, monkeypatch):
    """Before, every overlap was written and matched for each limit."""
    gt, dets = fixture(2)
    g, d = frames(spark, gt, dets)
    seen, match = [], D.greedy_match

    def counted(pairs, scope):
        seen.append(pairs.count())
        return match(pairs, scope)

    monkeypatch.setattr(D, "greedy_match", counted)
    key = lambda r: (r["area"], r["lim"], r["threshold"])
    of = lambda limits: {key(r): (r["hits"], r["num_pos"]) for r in D.proposal_recall(d, g, limits).collect()}
    both = of((100, 1000))
    assert both == of((100,)) | of((1000,))
    assert seen[0] == seen[1] == seen[2]
    low = of((2, 5))
    assert low == of((2,)) | of((5,))
    assert low != {(a, 2 if m == 100 else 5, t): v for (a, m, t), v in both.items()}


def test_tangled_overlaps_are_matched_in_all_slots_at_once(spark, monkeypatch):
    seen, match = [], D.ordered_matching
    monkeypatch.setattr(D, "ordered_matching", lambda edges, *a: seen.append(edges.count()) or match(edges, *a))
    g, d = frames(spark, *fixture(4))
    D.coco_matches(d, g, D.IOU_THRESHOLDS, ["all", "small", "medium", "large"]).count()
    by = ["image_id", "category_id"]
    overlaps = D.overlapping_pairs(d, g.drop("iscrowd"), by).count()
    assert 0 < seen[0] <= 2 * overlaps  # a row for each kind of slot, none for a slot


def test_curves_in_many_ranges(spark, monkeypatch):
    g, d = frames(spark, *fixture(7))
    whole = [sorted(f(d, g).collect()) for f in (D.coco_ap, D.pascal_map)]
    monkeypatch.setattr(D, "ROWS_IN_ORDER", 9)
    cut = [sorted(f(d, g).collect()) for f in (D.coco_ap, D.pascal_map)]
    for x, y in zip(whole, cut, strict=True):
        assert [r[:-1] for r in x] == [r[:-1] for r in y]
        assert [r.ap for r in x] == pytest.approx([r.ap for r in y], abs=1e-12)


def test_lines_are_numbered_once(spark):
    from datasheaf.plans import vision
    from datasheaf.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert vision.lines(t) is vision.lines(t)


def _boxes_with_groups(spark, seed, images=40, most=9):
    """Detections, ground truth and a hierarchy: equal scores and boxes, nulls, NaN, ids that come twice, images of one side only."""
    rng = random.Random(seed)

    def box():
        x, y = rng.randrange(6) * 3.0, rng.randrange(6) * 3.0
        return [x, y, x + rng.choice([0.0, 6.0, 9.0, 12.0, 2e5]), y + rng.choice([6.0, 9.0, 12.0])]

    def some(v, others=(None,), share=0.03):
        return rng.choice(others) if rng.random() < share else v

    kinds = ["a", "b", "c", "d", "r", "s", "z"]
    dets, gt = [], []
    for image in [*range(images), None]:
        ids = rng.random() < 0.8
        for side in (dets, gt):
            for i in range(rng.randrange(most)):
                row = [image, some(rng.choice(kinds)), i if ids else some(i, (None, 0, 1), 0.2)]
                b = box()
                if side is gt and (here := [d for d in dets if d[0] == image]) and rng.random() < 0.6:
                    row[1], *b = (lambda d: (d[1], *d[3:7]))(rng.choice(here))
                b[rng.randrange(4)] = some(b[0], (None, float("nan")), 0.02)
                area = (b[2] - b[0]) * (b[3] - b[1]) if None not in b else None
                side.append((*row, *b, *((some(rng.randrange(4) / 4, (None, float("nan"))),) if side is dets else (some(area), some(rng.random() < 0.3)))))
    names = "image_id long, category_id string, id long, x0 double, y0 double, x1 double, y1 double"
    parents = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", "s"), ("c", "s"), ("r", "root"), ("s", "root")], "category_id string, parent_id string")
    return spark.createDataFrame(dets, names + ", score double"), spark.createDataFrame(gt, names + ", area double, is_group boolean"), parents


@pytest.mark.parametrize(("seed", "hierarchy", "groups"), [(1, True, True), (2, False, True), (3, True, False)])
def test_images_in_one_pass_as_by_joins(spark, monkeypatch, seed, hierarchy, groups):
    dets, gt, parents = _boxes_with_groups(spark, seed)
    parents = parents if hierarchy else None
    rows = lambda: {r.category_id: round(r.ap, 9) for r in D.open_images_ap(dets, gt, parents, 0.5, groups).collect()}
    one_pass = rows()
    if seed == 1:
        monkeypatch.setattr(D, "PART_ROWS", 100)
        monkeypatch.setattr(D, "IMAGE_BOXES", 5)  # larger images by joins, the others in parts
        assert rows() == one_pass
    monkeypatch.setattr(D, "_plain_boxes", lambda *_: False)  # all by joins
    assert rows() == one_pass and sum(v > 0 for v in one_pass.values()) > 3


def test_boxes_are_not_written_for_ancestors(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(D, "written", lambda df, name: rows.append((lambda t: (name, t.count(), t)[:2])(written(df, name))) or written(df, name))
    boxes = [(i // 4, "leaf", i % 4, 9.0 * (i % 4), 0.0, 9.0 * (i % 4) + 8.0, 8.0) for i in range(400)]
    dets = spark.createDataFrame([(*b, 0.5) for b in boxes], "image_id long, category_id string, id long, x0 double, y0 double, x1 double, y1 double, score double")
    gt = dets.drop("score").withColumn("area", F.lit(64.0)).withColumn("is_group", F.lit(False))
    parents = spark.createDataFrame([("leaf", "branch"), ("branch", "trunk"), ("trunk", "root")], "category_id string, parent_id string")
    assert {r.category_id: r.ap for r in D.open_images_ap(dets, gt, parents).collect()} == dict.fromkeys(["leaf", "branch", "trunk", "root"], 1.0)
    assert max(n for _, n in rows) <= 400  # it was four times as many
