"""Classifier outputs, prototypes, retrieval and graphs."""

from pyspark.sql import functions as F

from datasheaf.functions import arrays as A
from datasheaf.functions.hashing import draw
from datasheaf.operators import classification as M
from datasheaf.operators import embeddings as E
from datasheaf.operators import graph as G
from datasheaf.operators.positions import group_index, running
from datasheaf.plans.registry import query
from datasheaf.plans.sqltext import draw as sql_draw

DIM = 64


def logits(t):
    """The first ten dimensions read as class scores."""
    return t.embeddings.select(
        "vec_id", "label", A.as_double(F.slice("embedding", 1, 10)).alias("logits")
    ).withColumn("pred", A.argmax("logits").cast("int"))


LOGITS = """(SELECT vec_id, label, lg AS logits, (list_position(lg, list_max(lg)) - 1)::INTEGER AS pred
  FROM (SELECT vec_id, label, embedding[1:10]::DOUBLE[] AS lg FROM embeddings))"""
CLASSES = "(SELECT DISTINCT label FROM embeddings)"


def classes(t):
    return t.embeddings.select("label").distinct()


@query("argmax_label", f"SELECT vec_id, pred FROM {LOGITS}")
def _(t):
    return logits(t).select("vec_id", "pred")


@query("accuracy", f"""SELECT round(avg((pred = label)::INTEGER), 6) AS accuracy,
  round(1 - avg((pred = label)::INTEGER), 6) AS error FROM {LOGITS}""")
def _(t):
    a = M.accuracy("pred", "label")
    return logits(t).agg(F.round(a, 6).alias("accuracy"), F.round(1 - a, 6).alias("error"))


@query("topk_accuracy", f"""WITH r AS (SELECT 1 + len(list_filter(logits, lambda v, i: v > logits[label + 1]
    OR (v = logits[label + 1] AND i - 1 < label))) AS r FROM {LOGITS})
  SELECT round(avg((r <= 1)::INTEGER) * 100, 6) AS top1, round(avg((r <= 5)::INTEGER) * 100, 6) AS top5 FROM r""")
def _(t):
    return logits(t).agg(
        F.round(M.topk_accuracy("logits", "label", 1), 6).alias("top1"),
        F.round(M.topk_accuracy("logits", "label", 5), 6).alias("top5"),
    )


@query("confusion_matrix", f"""SELECT pred, CASE WHEN label = 9 THEN 10 ELSE label END AS gt, count(*) AS n
  FROM {LOGITS} GROUP BY ALL""")
def _(t):
    return M.confusion_matrix(logits(t), "pred", "label", ignore=9, classes=10)


COUNTS = f"""(SELECT c.label, count(*) FILTER (pred = c.label AND l.label = c.label) AS tp,
    count(*) FILTER (pred = c.label AND l.label <> c.label) AS fp,
    count(*) FILTER (pred <> c.label AND l.label = c.label) AS fn
  FROM {CLASSES} c CROSS JOIN {LOGITS} l GROUP BY c.label)"""


@query("per_class_f1", f"""SELECT label, tp, fp, fn, round(tp / nullif(tp + 0.5 * (fp + fn), 0), 6) AS f1 FROM {COUNTS}""")
def _(t):
    f1 = M.per_class_f1(M.confusion_matrix(logits(t), "pred", "label"), classes(t))
    return f1.withColumn("f1", F.round("f1", 6))


SEG = f"""(SELECT c.label, count(*) FILTER (pred = c.label AND l.label = c.label) AS tp,
    count(*) FILTER (l.label = c.label) AS g, count(*) FILTER (pred = c.label) AS p
  FROM {CLASSES} c CROSS JOIN (SELECT * FROM {LOGITS} WHERE label <> 9 AND pred <> 9) l
  WHERE c.label <> 9 GROUP BY c.label)"""


@query("sem_seg_metrics", f"""WITH c AS (SELECT *, CASE WHEN g > 0 THEN 100.0 * tp / (g + p - tp) END AS iou,
    CASE WHEN g > 0 THEN 100.0 * tp / g END AS acc FROM {SEG})
  SELECT round(sum(iou) / count(*) FILTER (g + p > 0), 6) AS miou,
    round(sum(iou * g) / sum(g), 6) AS fwiou, round(avg(acc), 6) AS macc,
    round(100.0 * sum(tp) / sum(g), 6) AS pacc FROM c""")
def _(t):
    matrix = M.confusion_matrix(logits(t), "pred", "label", ignore=9, classes=9)
    _, s = M.sem_seg_metrics(matrix, classes(t), 9)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("mse", "SELECT round(avg((l_quantity - l_extendedprice / 2000) ** 2), 6) AS mse FROM lineitem")
def _(t):
    d = F.col("l_quantity") - F.col("l_extendedprice") / 2000
    return t.lineitem.agg(F.round(F.avg(F.pow(d, F.lit(2))), 6).alias("mse"))


def judged(t):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("pred")
    )


JUDGED = """(SELECT quality AS label, (n_chars > 1000)::INTEGER AS pred FROM labels JOIN documents USING (doc_id))"""
CELLS = f"""(SELECT count(*) FILTER (pred=1 AND label=1)::DOUBLE AS tp, count(*) FILTER (pred=1 AND label=0)::DOUBLE AS fp,
  count(*) FILTER (pred=0 AND label=1)::DOUBLE AS fn, count(*) FILTER (pred=0 AND label=0)::DOUBLE AS tn FROM {JUDGED})"""


@query("matthews", f"""SELECT round((tp*tn - fp*fn) / sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)), 6) AS matthews FROM {CELLS}""")
def _(t):
    return judged(t).agg(F.round(M.matthews("pred", "label"), 6).alias("matthews"))


@query("f1_binary", f"SELECT round(2*tp / (2*tp + fp + fn), 6) AS f1 FROM {CELLS}")
def _(t):
    return judged(t).agg(F.round(M.f1_binary("pred", "label"), 6).alias("f1"))


@query("combined_score", f"""SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2*tp / (2*tp + fp + fn), 6) AS f1,
  round(((tp + tn) / (tp + tn + fp + fn) + 2*tp / (2*tp + fp + fn)) / 2, 6) AS combined_score FROM {CELLS}""")
def _(t):
    s = M.task_metrics(judged(t), "mrpc", "pred", "label")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def _(t):
    return t.lineitem.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("spearman", """WITH r AS (SELECT
    rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b
    FROM lineitem)
  SELECT round(corr(a::DOUBLE, b::DOUBLE), 6) AS spearman FROM r""")
def _(t):
    return M.spearman(t.lineitem, "l_quantity", "l_extendedprice").select(
        F.round("spearman", 6).alias("spearman")
    )


def lr_counts(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("param"), (F.col("l_returnflag") == "R").cast("long").alias("val_correct"),
        (F.col("l_linestatus") == "F").cast("long").alias("test_correct"),
        F.lit(1).cast("long").alias("test_count"),
    )


@query("validated_accuracy", """WITH s AS (SELECT l_suppkey AS param, count(*) FILTER (l_returnflag = 'R') AS v,
    count(*) FILTER (l_linestatus = 'F') AS c, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT param, v AS val_correct, round(c / n, 6) AS test_accuracy FROM s ORDER BY v DESC, param LIMIT 1""")
def _(t):
    return M.validated_selection(lr_counts(t), "param").withColumn(
        "test_accuracy", F.round("test_accuracy", 6)
    )


@query("merge_counts", """SELECT k AS key, sum(n)::BIGINT AS n FROM (
    SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1
    UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1""")
def _(t):
    from datasheaf.operators.joins import merge_counts

    a = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return merge_counts(a, b, "key", "n")


@query("class_histogram", """WITH p AS (SELECT p_brand || ' ' || p_type AS name, p_partkey, p_size FROM part),
  c AS (SELECT name, count(l_partkey) FILTER (l_returnflag <> 'R') AS n
    FROM p LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY name)
  SELECT CASE WHEN length(name) > 13 THEN substr(name, 1, 11) || '..' ELSE name END AS name, n FROM c
  UNION ALL SELECT 'total', sum(n)::BIGINT FROM c""")
def _(t):
    parts = t.part.select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), "p_partkey", "p_size")
    # Count per part before the join, so a popular part is one row there.
    per_part = t.lineitem.filter("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("k"))
    counts = (
        parts.join(per_part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy("name").agg(F.sum("k").alias("n"))
    )
    return M.class_histogram(counts, parts.select("name").distinct())


@query("histogram", """WITH v AS (SELECT n_chars AS v, (SELECT min(n_chars) FROM documents) AS lo,
    (SELECT max(n_chars) FROM documents) AS hi FROM documents),
  b AS (SELECT least(floor((v - lo) / ((hi - lo) / 100.0::DOUBLE)), 99)::BIGINT AS bin, lo, hi FROM v)
  SELECT bin, count(*) AS n, round(lo + bin * ((hi - lo) / 100.0::DOUBLE), 6) AS lo FROM b GROUP BY bin, lo, hi""")
def _(t):
    return M.histogram(t.documents, "n_chars", 100).withColumn("lo", F.round("lo", 6))


@query("quantize", """SELECT b AS bucket, count(*) AS n FROM (SELECT (l_quantity >= 1)::BIGINT + (l_quantity >= 10)::BIGINT
  + (l_quantity >= 25)::BIGINT + (l_quantity >= 50)::BIGINT AS b FROM lineitem) GROUP BY b""")
def _(t):
    b = A.quantize("l_quantity", [1.0, 10.0, 25.0, 50.0])
    return t.lineitem.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("count_class", """SELECT l_linenumber AS shard, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1
  UNION ALL SELECT -1, count(*) FILTER (l_returnflag = 'R') FROM lineitem""")
def _(t):
    n = F.count_if(F.col("l_returnflag") == "R").alias("n")
    r = t.lineitem.rollup("l_linenumber").agg(n)
    return r.select(F.coalesce("l_linenumber", F.lit(-1)).alias("shard"), "n")


@query("label_stats", """SELECT count(DISTINCT label) AS num_labels, min(label) AS first, max(label) AS last FROM embeddings""")
def _(t):
    return M.label_stats(t.embeddings, "label")


@query("min_class_size", "SELECT min(n) AS n FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))


@query("label_range_check", """SELECT max(label) AS max_label, CASE WHEN max(label) > 10 THEN 'error'
  WHEN max(label) < 10 THEN 'warning' ELSE 'ok' END AS status FROM embeddings""")
def _(t):
    return M.range_check(t.embeddings, "label", 10)


@query("timing_summary", """WITH w AS (SELECT l_returnflag AS grp, l_partkey, max(l_quantity) AS s FROM lineitem GROUP BY ALL)
  SELECT grp, round(avg(s), 6) AS mean_s, round(stddev_samp(s), 6) AS std_s,
    round(avg(2.0::DOUBLE * 8192 ** 3 / s / 1e12), 6) AS mean_tflops,
    round(stddev_samp(2.0::DOUBLE * 8192 ** 3 / s / 1e12), 6) AS std_tflops FROM w GROUP BY grp""")
def _(t):
    s = M.timing_summary(
        t.lineitem.withColumnRenamed("l_returnflag", "grp"), ["grp"], "l_partkey", "l_quantity",
        F.lit(2.0 * 8192**3),
    )
    return s.select("grp", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query("throughput_summary", """WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type AS worker, count(*) AS items, round(sum(value), 4) AS seconds, round(avg(value), 6) AS seconds_per_item
  FROM p WHERE pos >= least(5, n - 1) GROUP BY 1""")
def _(t):
    timed = group_index(t.events.select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"])
    sizes = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return (
        timed.join(sizes, "event_type").filter(F.col("pos") >= F.least(F.lit(5), F.col("n") - 1))
        .groupBy(F.col("event_type").alias("worker"))
        .agg(
            F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 4).alias("seconds"),
            F.round(F.avg("value"), 6).alias("seconds_per_item"),
        )
    )


# Embeddings

SPLIT = f"(SELECT *, {sql_draw('1', 'vec_id')} < 0.2 AS support FROM embeddings)"
PROTO_SQL = f"""proto AS (SELECT label, i, avg(x) AS x FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
    FROM {SPLIT} WHERE support) GROUP BY label, i),
  q AS (SELECT vec_id, label AS own, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
    FROM {SPLIT} WHERE NOT support),
  dist AS (SELECT vec_id, own, proto.label, sum((q.x - proto.x) * (q.x - proto.x)) AS d
    FROM q JOIN proto USING (i) GROUP BY ALL),
  lse AS (SELECT vec_id, own, min(d) AS dmin, ln(sum(exp(-d))) AS lse, arg_min(label, (d, label)) AS pred
    FROM dist GROUP BY ALL)"""


def classified(t):
    marked = t.embeddings.withColumn("__u", draw(1, "vec_id"))
    support, queries = marked.filter("__u < 0.2").drop("__u"), marked.filter("__u >= 0.2").drop("__u")
    protos = E.class_centroids(support, "label", "embedding", DIM)
    return E.prototype_classify(queries, "vec_id", "embedding", protos, "label")


@query("prototype_classify", f"""WITH {PROTO_SQL}
  SELECT vec_id, own AS label, pred, round(dmin, 6) AS distance, round(-dmin - lse, 6) AS log_prob FROM lse""")
def _(t):
    return classified(t).select(
        "vec_id", "label", "pred", F.round("distance", 6).alias("distance"),
        F.round("log_prob", 6).alias("log_prob"),
    )


@query("prototype_loss", f"""WITH {PROTO_SQL}
  SELECT round(avg((pred = l.own)::INTEGER), 6) AS accuracy, round(avg(d + lse), 6) AS loss
  FROM lse l JOIN dist USING (vec_id) WHERE dist.label = l.own""")
def _(t):
    return classified(t).agg(
        F.round(M.accuracy("pred", "label"), 6).alias("accuracy"), F.round(F.avg("loss"), 6).alias("loss")
    )


CENTROIDS = """(SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)"""


@query("class_centroids", f"SELECT label, (i - 1)::INTEGER AS dim, round(x, 6) AS x FROM {CENTROIDS}")
def _(t):
    c = E.class_centroids(t.embeddings, "label", "embedding", DIM)
    return c.select("label", F.posexplode("proto").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("mean_pool", """SELECT vec_id, (d - 1)::INTEGER AS dim, round(sum(embedding[t * 8 + d]::DOUBLE) / 8, 6) AS x
  FROM embeddings, range(0, 8) a(t), range(1, 9) b(d) GROUP BY vec_id, d""")
def _(t):
    pooled = t.embeddings.select("vec_id", E.mean_pool("embedding", 8, 8).alias("v"))
    return pooled.select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("knn_topk", f"""WITH d AS (SELECT c.label AS query, vec_id, sum((v.x - c.x) * (v.x - c.x)) AS distance
    FROM {CENTROIDS} c JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
      FROM embeddings) v USING (i) GROUP BY ALL)
  SELECT query, vec_id, round(distance, 6) AS distance,
    row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)::INTEGER AS rank FROM d QUALIFY rank <= 10""")
def _(t):
    queries = E.class_centroids(t.embeddings, "label", "embedding", DIM)
    return E.knn_topk(queries, t.embeddings, 10, "label", "vec_id", "proto", "embedding").withColumn(
        "distance", F.round("distance", 6)
    )


@query("batch_score", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x / i)), 5) AS score
  FROM embeddings""")
def _(t):
    import numpy as np

    def process(w, batch):
        x = np.stack(batch["embedding"].to_numpy()).astype("float64")
        return batch[["vec_id"]].assign(score=(x @ w).round(5))

    return E.batch_score(
        t.embeddings.select("vec_id", "embedding"), lambda: 1.0 / np.arange(1, DIM + 1), process,
        "vec_id long, score double",
    )


@query("squared_distance", """SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS dot,
  round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda z: (z[1] - z[2]) ** 2)), 6) AS d
  FROM embeddings""")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select(
        "vec_id", F.round(A.dot(e, e), 6).alias("dot"), F.round(A.squared_distance(e, F.reverse(e)), 6).alias("d")
    )


@query("log_softmax", f"""WITH l AS (SELECT vec_id, logits, list_max(logits) AS m FROM {LOGITS}),
  n AS (SELECT vec_id, logits, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) AS lse FROM l)
  SELECT vec_id, i::INTEGER AS i, round(logits[i + 1] - lse, 6) AS logp, round(exp(logits[i + 1] - lse), 6) AS p
  FROM n, range(0, 10) g(i)""")
def _(t):
    lp = logits(t).select("vec_id", F.posexplode(A.log_softmax("logits")).alias("i", "logp"))
    return lp.select("vec_id", "i", F.round("logp", 6).alias("logp"), F.round(F.exp("logp"), 6).alias("p"))


LOGP = f"""(SELECT vec_id, label, list_transform(logits, lambda x: x - lse) AS lp FROM (
  SELECT *, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) AS lse FROM {LOGITS}))"""


@query("nll_loss", f"SELECT round(avg(-lp[label + 1]), 6) AS loss FROM {LOGP}")
def _(t):
    lp = A.log_softmax("logits")
    return logits(t).agg(F.round(F.avg(-F.element_at(lp, F.col("label") + 1)), 6).alias("loss"))


@query("smoothed_ce", f"SELECT round(avg(-(lp[label + 1] * 0.9 + list_sum(lp) * 0.1 / 10)), 6) AS loss FROM {LOGP}")
def _(t):
    lp = logits(t).withColumn("lp", A.log_softmax("logits"))
    return lp.agg(F.round(F.avg(A.cross_entropy_smoothed("lp", "label", 0.1)), 6).alias("loss"))


@query("one_hot", """SELECT vec_id, array_to_string(list_transform(range(0, 10), lambda i: (i = label)::INTEGER), ',') AS one_hot
  FROM embeddings""")
def _(t):
    return t.embeddings.select(
        "vec_id", F.array_join(A.one_hot("label", 10).cast("array<string>"), ",").alias("one_hot")
    )


@query("scale_features", """SELECT vec_id, (i - 1)::INTEGER AS i, round(x / 255, 8) AS unit, round((x - 127.5) / 127.5, 8) AS signed,
    round((x - 0.5) / 0.25, 8) AS standard, round(x - 1, 8) AS minus_one
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def _(t):
    kinds = {"unit": {}, "signed": {}, "standard": {"mean": 0.5, "std": 0.25}, "minus_one": {}}
    cols = [A.scale("embedding", k, **kw).alias(k) for k, kw in kinds.items()]
    z = t.embeddings.select("vec_id", F.posexplode(F.arrays_zip(*cols)).alias("i", "z"))
    return z.select("vec_id", "i", *[F.round(F.col(f"z.{k}"), 8).alias(k) for k in kinds])


# Graphs: one per order, a node per line, edges between neighbouring lines in both directions.

NODE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]


def nodes(t):
    lines = t.lineitem.select("l_orderkey", *NODE_ORDER)
    return group_index(lines, "l_orderkey", NODE_ORDER, "node_id").select(
        F.col("l_orderkey").alias("graph_id"), "node_id", F.col("l_quantity").alias("x"),
        F.col("l_extendedprice").alias("y"),
    )


def edges(n):
    """Node i with node i-1, both ways."""
    both = F.array(
        F.struct((F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst")),
        F.struct(F.col("node_id").alias("src"), (F.col("node_id") - 1).alias("dst")),
    )
    return n.filter("node_id > 0").select("graph_id", F.explode(both).alias("e")).select("graph_id", "e.*")


NODES = f"""nodes AS (SELECT l_orderkey AS graph_id, l_quantity AS x, l_extendedprice AS y,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(NODE_ORDER)}) - 1 AS node_id FROM lineitem),
  edges AS (SELECT graph_id, node_id - 1 AS src, node_id AS dst FROM nodes WHERE node_id > 0
    UNION ALL SELECT graph_id, node_id, node_id - 1 FROM nodes WHERE node_id > 0)"""


@query("neighbor_sum", f"""WITH {NODES} SELECT graph_id, dst AS node_id, round(sum(x), 4) AS x, round(sum(y), 4) AS y
  FROM edges JOIN nodes ON nodes.graph_id = edges.graph_id AND nodes.node_id = src GROUP BY edges.graph_id, dst""".replace("SELECT graph_id, dst", "SELECT edges.graph_id, dst"))
def _(t):
    n = nodes(t)
    s = G.neighbor_sum(n, edges(n), ["x", "y"])
    return s.select("graph_id", "node_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("topk_pool", f"""WITH {NODES}, kept AS (SELECT graph_id, node_id FROM (SELECT *,
      row_number() OVER (PARTITION BY graph_id ORDER BY y DESC, node_id) AS r,
      ceil(count(*) OVER (PARTITION BY graph_id) * 0.8::DOUBLE) AS k FROM nodes) WHERE r <= k)
  SELECT 'node' AS kind, graph_id, node_id AS src, node_id AS dst FROM kept
  UNION ALL SELECT 'edge', e.graph_id, src, dst FROM edges e
    JOIN kept a ON a.graph_id = e.graph_id AND a.node_id = src JOIN kept b ON b.graph_id = e.graph_id AND b.node_id = dst""")
def _(t):
    n = nodes(t)
    kept, inner = G.topk_pool(n, edges(n), "y", 0.8)
    a = kept.select(F.lit("node").alias("kind"), "graph_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return a.unionByName(inner.select(F.lit("edge").alias("kind"), "graph_id", "src", "dst"))


@query("graph_readout", """SELECT l_orderkey AS graph_id, max(l_quantity) AS max_x, max(l_extendedprice) AS max_y,
  round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 6) AS mean_y FROM lineitem GROUP BY 1""")
def _(t):
    n = t.lineitem.select(F.col("l_orderkey").alias("graph_id"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    r = G.readout(n, ["x", "y"])
    return r.select("graph_id", "max_x", "max_y", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"))


# Losses of evaluation batches: an order is a batch, its total the loss, its customer the worker.

LOSSES = "(SELECT o_orderkey AS batch, o_custkey AS worker, o_totalprice / 100000 AS loss, (o_orderkey % 7 + 1)::BIGINT AS n FROM orders)"


def losses(t):
    return t.orders.select(
        F.col("o_orderkey").alias("batch"), F.col("o_custkey").alias("worker"),
        (F.col("o_totalprice") / 100000).alias("loss"), (F.col("o_orderkey") % 7 + 1).alias("n"),
    )


@query("perplexity", f"SELECT round(exp(avg(loss)), 6) AS perplexity FROM {LOSSES}")
def _(t):
    from datasheaf.operators.language import perplexity

    return losses(t).agg(F.round(perplexity("loss"), 6).alias("perplexity"))


@query("perplexity_weighted", f"""SELECT worker, round(CASE WHEN s > 709.78 OR s IS NULL THEN 100000 ELSE exp(s) END, 4) AS perplexity
  FROM (SELECT worker, sum(loss * 100 * n) / sum(n) AS s FROM {LOSSES} GROUP BY worker)""")
def _(t):
    from datasheaf.operators.language import perplexity_weighted

    scaled = losses(t).withColumn("loss", F.col("loss") * 100)
    return scaled.groupBy("worker").agg(F.round(perplexity_weighted("loss", "n"), 4).alias("perplexity"))


@query("weighted_loss", f"SELECT round(sum(n * loss) / (count(*) - 1), 6) AS loss FROM {LOSSES}")
def _(t):
    from datasheaf.operators.language import length_weighted_loss

    return losses(t).agg(F.round(length_weighted_loss("loss", "n"), 6).alias("loss"))


@query("mean_of_batch_means", f"SELECT round(avg(m), 6) AS mean FROM (SELECT avg(loss) AS m FROM {LOSSES} GROUP BY worker)")
def _(t):
    from datasheaf.operators.language import mean_of_batch_means

    return mean_of_batch_means(losses(t), "worker", "loss").select(F.round("mean", 6).alias("mean"))


@query("running_weighted_mean", f"""SELECT worker, batch, round(sum(loss * n) OVER w / sum(n) OVER w, 6) AS avg FROM {LOSSES}
  WINDOW w AS (PARTITION BY worker ORDER BY batch)""")
def _(t):
    s = running(losses(t), F.col("loss") * F.col("n"), "batch", "worker", out="s")
    c = running(s, F.col("n"), "batch", "worker", out="c")
    return c.select("worker", "batch", F.round(F.col("s") / F.col("c"), 6).alias("avg"))
