"""Trials, metric series and successive halving. A trial is a user, a step an event."""

from pyspark.sql import functions as F

from datasheaf.functions.hashing import draw
from datasheaf.operators import trials as V
from datasheaf.operators.joins import lookup
from datasheaf.plans.registry import query
from datasheaf.plans.sqltext import draw as sdraw


def series(t):
    return t.events.select("user_id", "event_id", "event_type", "value")


@query("best_so_far", """WITH b AS (SELECT user_id, event_id, value, min(value) OVER w AS best FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT user_id, event_id, best, max(CASE WHEN first THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS best_step
  FROM (SELECT *, best < coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id), 1e300) AS first FROM b)""")
def _(t):
    return V.best_so_far(series(t), ["user_id"], "event_id", "value").select("user_id", "event_id", "best", "best_step")


@query("plateau_trigger", """SELECT user_id, event_id, coalesce(value > min(value) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING), false) AS triggered FROM events""")
def _(t):
    return V.plateau_trigger(series(t), ["user_id"], "event_id", "value", 5).select("user_id", "event_id", "triggered")


@query("ema", """WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS e FROM events GROUP BY user_id),
  x AS (SELECT user_id, e, v, unnest(range(1, len(v) + 1)) AS i FROM l)
  SELECT user_id, e[i] AS event_id, round(list_reduce(v[1:i], lambda a, b: 0.9 * a + 0.1 * b), 6) AS ema FROM x""")
def _(t):
    s = V.ema(series(t), ["user_id"], "event_id", "value", 0.9)
    return s.select("user_id", "event_id", F.round("ema", 6).alias("ema"))


@query("top_checkpoint", """SELECT user_id, arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best_metric, max(event_id) AS latest_step
  FROM events GROUP BY user_id""")
def _(t):
    return V.top_checkpoint(series(t), "user_id", "value", "event_id")


@query("rung_units", """WITH r AS (SELECT p_partkey AS search, unnest([0, 1, 2, 3]) AS rung, p_size AS m FROM part),
  u AS (SELECT *, greatest(floor(m / 3.0::DOUBLE ** (3 - rung))::BIGINT, 1) AS u FROM r)
  SELECT search, rung, (sum(u) OVER (PARTITION BY search ORDER BY rung))::BIGINT AS units FROM u""")
def _(t):
    searches = t.part.select(F.col("p_partkey").alias("search"), "p_size")
    return V.rung_units(searches, "search", F.col("p_size"), 4, 3)


def rung_results(t):
    """Each order is a trial of the search named by its priority, with a drawn metric per rung."""
    base = t.orders.select(
        F.col("o_orderpriority").alias("search"), F.col("o_orderkey").alias("trial"),
        F.col("o_orderkey").alias("arrival"), (F.col("o_orderstatus") == "P").alias("exited_early"),
        F.explode(F.lit([0, 1, 2])).alias("rung"),
    )
    return base.withColumn("metric", F.round(draw("rung", "trial", "rung"), 3))


RUNGS = f"""res AS (SELECT o_orderpriority AS search, o_orderkey AS trial, o_orderstatus = 'P' AS early, r AS rung,
    round({sdraw('rung', 'o_orderkey', 'r')}, 3) AS metric FROM orders, (SELECT unnest([0, 1, 2]) AS r))"""


def _rung(r, source):
    return f"""r{r} AS (SELECT search, rung, trial, row_number() OVER (PARTITION BY search ORDER BY CASE WHEN early THEN 'infinity'::DOUBLE ELSE metric END, trial) - 1 AS rank,
    count(*) OVER (PARTITION BY search) // 4 AS q FROM res {source} WHERE rung = {r})"""


@query("rung_promotions", f"""WITH {RUNGS}, {_rung(0, '')},
  {_rung(1, 'SEMI JOIN (SELECT trial FROM r0 WHERE rank < q) p USING (trial)')},
  {_rung(2, 'SEMI JOIN (SELECT trial FROM r1 WHERE rank < q) p USING (trial)')}
  , o AS (SELECT search, rung, trial, rank, rank < q AS promoted FROM r0 UNION ALL SELECT search, rung, trial, rank, rank < q FROM r1
    UNION ALL SELECT search, rung, trial, rank, false FROM r2),
  u AS (SELECT search, rung, sum(greatest(floor(100 / 4.0::DOUBLE ** (2 - rung))::BIGINT, 1)) OVER (PARTITION BY search ORDER BY rung) AS units
    FROM (SELECT DISTINCT search FROM res), range(0, 3) r(rung))
  SELECT o.*, CASE WHEN promoted THEN greatest(b.units - a.units, 1)::BIGINT END AS add FROM o
  LEFT JOIN u a ON a.search = o.search AND a.rung = o.rung LEFT JOIN u b ON b.search = o.search AND b.rung = o.rung + 1""")
def _(t):
    results = rung_results(t)
    units = V.rung_units(results.select("search").distinct(), "search", F.lit(100), 3, 4)
    return V.rung_promotions(results, "search", "trial", 3, 4, units=units)


@query("rung_async")
def _(t):
    """Replay of all orders as results of the search of their priority and status."""
    r = t.orders.select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("search"), F.lit(0).alias("rung"),
        F.col("o_orderkey").alias("trial"), F.col("o_orderkey").alias("arrival"), F.col("o_totalprice").alias("metric"),
    )
    return V.rung_async(r, "search", 4)


@query("search_progress", """WITH s AS (SELECT o_custkey AS search, count(*) FILTER (o_orderstatus <> 'P') AS n,
    count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 50000) AS v, max(10) AS m FROM orders GROUP BY 1)
  SELECT search, round(CASE WHEN n = m THEN greatest(v / m, n / (1.2 * m)) ELSE n / (1.2 * m) END, 6) AS progress FROM s""")
def _(t):
    r = t.orders.select(
        F.col("o_custkey").alias("search"), F.lit(10).alias("max_trials"), (F.col("o_orderstatus") != "P").alias("done"),
        (F.col("o_totalprice") < 50000).alias("invalid"), (F.col("o_orderstatus") == "P").alias("pending"),
    )
    return V.search_progress(r, "search", "max_trials", 100000).withColumn("progress", F.round("progress", 6))


@query("leaderboard", """SELECT l_suppkey AS experiment, l_orderkey AS trial, l_quantity AS metric,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS rank FROM lineitem""")
def _(t):
    r = t.lineitem.select(
        F.col("l_suppkey").alias("experiment"), F.col("l_orderkey").alias("trial"), F.col("l_quantity").alias("metric")
    )
    return V.leaderboard(r, "experiment", "trial", "metric", smaller=False).select("experiment", "trial", "metric", "rank")


@query("metric_curve", """SELECT event_type, date_part('hour', ts)::INTEGER AS x, round(avg(value), 6) AS y, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    return V.metric_curve(t.events, F.hour("ts"), "event_type", "value").withColumn("y", F.round("y", 6))


@query("step_interval_rollup", """SELECT event_type, event_id // 100 AS "interval", count(*) AS n, round(avg(value), 6) AS mean, max(event_id) AS last_step
  FROM events GROUP BY ALL""")
def _(t):
    r = V.step_rollup(t.events, "event_type", F.col("event_id"), 100, "value")
    return r.withColumn("mean", F.round("mean", 6))


@query("category_remap", """SELECT p_partkey, p_size AS dataset_id, CASE WHEN p_type = 'PROMO' THEN NULL
    WHEN p_type = 'SMALL' THEN p_size ELSE dense_rank() OVER (ORDER BY p_size) - 1 END AS contiguous_id FROM part""")
def _(t):
    """Sizes as category ids: things use the contiguous map, stuff keeps its id, a NULL flag gives NULL."""
    from datasheaf.operators.columns import label_names

    mapping = label_names(t.part, "p_size").withColumnRenamed("id", "contiguous_id")
    out = lookup(t.part.select("p_partkey", "p_size", "p_type"), mapping, "p_size")
    kind = F.when(F.col("p_type") == "SMALL", F.col("p_size").cast("long")).when(F.col("p_type") != "PROMO", F.col("contiguous_id"))
    return out.select("p_partkey", F.col("p_size").alias("dataset_id"), kind.alias("contiguous_id"))
