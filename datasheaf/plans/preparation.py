"""Text datasets: columns, labels, filters, chat, splits, sampling and set operations."""

from pyspark.sql import functions as F

from datasheaf.functions import chat as H
from datasheaf.functions import text as T
from datasheaf.functions.hashing import draw
from datasheaf.operators import chatdata as CD
from datasheaf.operators import columns as C
from datasheaf.operators import corpus as K
from datasheaf.operators import filters as W
from datasheaf.operators import joins as J
from datasheaf.operators import splits as X
from datasheaf.plans.registry import query
from datasheaf.session import spread
from datasheaf.plans.sqltext import LINES, PUNCT_SQL, WORD_SQL, digest, draw as sdraw, draw_int, strip, words

N_WORDS = f"len({words('text')})"


@query("select_keep", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    return C.keep_only(t.documents, ["doc_id", "lang", "n_chars"])


@query("path_class_index", """WITH p AS (SELECT page_id, string_split(url, '/') AS s FROM pages),
  c AS (SELECT page_id, CASE WHEN len(s) >= 2 THEN s[-2] END AS class FROM p),
  f AS (SELECT class, min(page_id) AS m FROM c GROUP BY class),
  i AS (SELECT class, row_number() OVER (ORDER BY m) - 1 AS id FROM f)
  SELECT page_id, class, id FROM c JOIN i USING (class)""")
def _(t):
    listed = t.pages.select("page_id", T.parent_name("url").alias("class"))
    return listed.join(K.first_seen_index(listed, "class", "page_id"), "class").select("page_id", "class", "id")


@query("label_index", """SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents""")
def _(t):
    return C.label_index(t.documents.select("doc_id", "source"), "source")


@query("first_seen_index", """SELECT source, row_number() OVER (ORDER BY m) - 1 AS id
  FROM (SELECT source, min(doc_id) AS m FROM documents GROUP BY source)""")
def _(t):
    return K.first_seen_index(t.documents, "source", "doc_id")


@query("label_remap", """WITH a AS (SELECT lang AS name, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents)),
  b AS (SELECT name, row_number() OVER (ORDER BY name DESC) - 1 AS id FROM (SELECT DISTINCT upper(lang) AS name FROM documents)),
  d AS (SELECT count(*) AS n FROM a FULL JOIN b ON lower(a.name) = lower(b.name) WHERE a.id IS NULL OR b.id IS NULL)
  SELECT a.name, CASE WHEN n = 0 THEN b.id ELSE a.id END AS id FROM d, a LEFT JOIN b ON lower(a.name) = lower(b.name)""")
def _(t):
    from datasheaf.operators.positions import global_index

    names = C.label_names(t.documents, "lang").withColumnRenamed("lang", "name")
    model = global_index(t.documents.select(F.upper("lang").alias("name")).distinct(), "-name", "id")
    return C.remap_labels(names, model)


@query("joint_dataset", """SELECT c_custkey AS key, c_name AS name, 0 AS dataset_index FROM customer
  UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part""")
def _(t):
    frames = [
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
        t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name")),
    ]
    return C.add_dataset_index(frames)


@query("union_all", """SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier""")
def _(t):
    return C.concatenate([
        t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
    ])


@query("flatten_metrics", """WITH m AS (SELECT event_type AS g, avg(value) AS mean, max(value) AS best, count(*)::DOUBLE AS n FROM events GROUP BY 1)
  SELECT g || '/mean' AS metric, round(mean, 6) AS value FROM m UNION ALL SELECT g || '/best', best FROM m UNION ALL SELECT g || '/n', n FROM m""")
def _(t):
    m = t.events.groupBy("event_type").agg(
        F.avg("value").alias("mean"), F.max("value").alias("best"), F.count(F.lit(1)).alias("n")
    )
    return C.flatten_metrics(m, "event_type", ["mean", "best", "n"]).withColumn("value", F.round("value", 6))


@query("metric_rows", """SELECT user_id AS trial, event_type AS grp, event_id AS step, 'value' AS metric, value FROM events
  UNION ALL SELECT user_id, event_type, event_id, 'k', json_extract_string(props, '$.k')::DOUBLE FROM events""")
def _(t):
    from datasheaf.sources.readers import explode_metrics

    rows = t.events.select(
        F.col("user_id").alias("trial"), F.col("event_type").alias("grp"), F.col("event_id").alias("step"),
        F.map_concat(
            F.create_map(F.lit("value"), "value"), F.from_json("props", "map<string,double>")
        ).alias("metrics"),
    )
    return explode_metrics(rows)


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


# Filters

@query("word_count", f"SELECT doc_id, {N_WORDS} AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", T.word_count("text").alias("words"))


@query("length_band", f"""WITH w AS (SELECT doc_id, {N_WORDS} + len({words('lang')}) AS total_length FROM documents)
  SELECT 'easy' AS level, * FROM (SELECT * FROM w WHERE total_length BETWEEN 10 AND 100 ORDER BY doc_id LIMIT 10000)
  UNION ALL SELECT 'medium', * FROM (SELECT * FROM w WHERE total_length BETWEEN 101 AND 200 ORDER BY doc_id LIMIT 10000)
  UNION ALL SELECT 'hard', * FROM (SELECT * FROM w WHERE total_length BETWEEN 201 AND 800 ORDER BY doc_id LIMIT 10000)""")
def _(t):
    docs = spread(t.documents.select("doc_id", "text", "lang"))
    return W.length_bands(docs, ["text", "lang"], 10000, ["doc_id"]).select("level", "doc_id", "total_length")


@query("nonblank_lines", f"SELECT doc_id, count(*) AS n FROM {LINES} WHERE regexp_matches(value, '{WORD_SQL}') GROUP BY doc_id")
def _(t):
    kept = K.nonblank_lines(K.text_lines(t.documents, "text", "doc_id"))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("failed_rows", """WITH p AS (SELECT page_id, try_cast(string_split(string_split(url, '/')[5], '?')[1] AS BIGINT) AS number FROM pages)
  SELECT number IS NULL AS failed, count(*) AS n, coalesce(sum(number), 0)::BIGINT AS total FROM p GROUP BY 1""")
def _(t):
    raw = F.split(F.get(F.split("url", "/"), F.lit(4)), r"\?")[0]
    good, bad = W.split_failed(t.pages.select("page_id", "url"), raw.try_cast("long"), "number")
    both = good.withColumn("failed", F.lit(False)).unionByName(bad.withColumn("failed", F.lit(True)))
    return both.groupBy("failed").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("number"), F.lit(0).cast("long")).alias("total")
    )


@query("archivable", """SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 400000) AND
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ACTIVE' ELSE 'CANCELED' END IN ('COMPLETED','CANCELED','DELETED','ERROR')""")
def _(t):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("CANCELED")
    return t.orders.filter(W.archivable(F.col("o_totalprice") > 400000, state)).select("o_orderkey")


# Scalars

@query("path_parts", r"""WITH s AS (SELECT page_id, string_split(url, '/') AS p FROM pages)
  SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] END AS parent,
    array_to_string(p[greatest(len(p) - 1, 1):], '/') AS last_two, regexp_replace(p[-1], '\.[^.]*$', '') || '.png' AS renamed FROM s""")
def _(t):
    return t.pages.select(
        "page_id", T.parent_name("url").alias("parent"), T.last_two("url").alias("last_two"),
        T.base_name("url", ".png").alias("renamed"),
    )


@query("before_marker", "SELECT doc_id, md5(string_split(text, '. ')[1]) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(T.before_marker("text", ". ")).alias("digest"))


@query("squad_normalize", rf"""SELECT doc_id, md5(array_to_string(list_filter({words(r"regexp_replace(lower(text), '" + PUNCT_SQL + r"', '', 'g')")},
  lambda w: w NOT IN ('a', 'an', 'the')), ' ')) AS digest FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5(T.squad_normalize("text")).alias("digest"))


@query("contains_ids", f"""SELECT doc_id, contains(',' || array_to_string(list_transform({words('text')}, lambda w: length(w)), ',') || ',', ',3,2,5,') AS hit
  FROM documents""")
def _(t):
    ids = F.transform(T.words("text"), lambda w: F.length(w))
    return t.documents.select("doc_id", T.contains_ids(ids, F.lit([3, 2, 5])).alias("hit"))


# Chat

PAIRS = """(SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def question_answer(t):
    """User turns with the assistant turn that follows."""
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@query("prompt_format", f"""SELECT conv_id, turn, 'Task: ' || question || chr(10) || 'SQL table: ' || answer || chr(10) || 'SQL query: ' AS prompt
  FROM {PAIRS}""")
def _(t):
    return question_answer(t).select(
        "conv_id", "turn", H.sql_task_prompt(F.col("question"), F.col("answer")).alias("prompt")
    )


RENDERED = f"""(SELECT conv_id, turn, '<|im_start|>' || role || chr(10) ||
    CASE WHEN role = 'assistant' THEN text ELSE {strip('text')} END || '<|im_end|>' || chr(10) AS line FROM conversations
  WHERE role IN ('user','system','assistant'))"""


@query("chatml_render", f"""SELECT conv_id, 0::BIGINT AS part, chr(10) || string_agg(line, '' ORDER BY turn) AS text FROM {RENDERED} GROUP BY conv_id""")
def _(t):
    return CD.render_conversations(t.conversations, "conv_id", "turn", "role", "text", part_chars=16_000_000)


@query("generation_prompt", f"""SELECT conv_id, turn, chr(10) || '<|im_start|>user' || chr(10) || {strip('question')} || '<|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10) AS prompt FROM {PAIRS}""")
def _(t):
    msg = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    return question_answer(t).select(
        "conv_id", "turn", H.with_generation_prompt(H.render_messages(msg)).alias("prompt")
    )


def preferences(t):
    """Chat preferences: a user turn with the answer that follows (chosen) and the next one (rejected)."""
    later = t.conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("other")
    )
    pairs = question_answer(t).join(later, ["conv_id", "turn"])

    def chat(answer):
        return F.array(
            F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col(answer).alias("content")),
        )

    return pairs.select("conv_id", "turn", chat("answer").alias("chosen"), chat("other").alias("rejected"))


PREFS = f"""(SELECT p.*, o.text AS other FROM {PAIRS} p JOIN conversations o
  ON o.conv_id = p.conv_id AND o.turn = p.turn + 3 AND o.role = 'assistant')"""


def _turn(role, col):
    return f"chr(10) || '<|im_start|>{role}' || chr(10) || {col} || '<|im_end|>' || chr(10)"


@query("preference_triplets", f"""SELECT conv_id, turn, {_turn('user', strip('question'))} AS prompt,
  {_turn('assistant', 'answer')} AS chosen, {_turn('assistant', 'other')} AS rejected FROM {PREFS}""")
def _(t):
    p, c, r = CD.preference_from_chat(F.col("chosen"), F.col("rejected"))
    return preferences(t).select("conv_id", "turn", p.alias("prompt"), c.alias("chosen"), r.alias("rejected"))


@query("preference_violations", """WITH p AS (SELECT a.conv_id, a.turn, a.role AS r1, b.role AS r2 FROM conversations a
    JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, CASE WHEN r1 = 'system' THEN 'system role' END AS violation FROM p""")
def _(t):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("r2"), F.col("text").alias("t2"))

    def chat():
        return F.array(
            F.struct("role", F.col("text").alias("content")),
            F.struct(F.col("r2").alias("role"), F.col("t2").alias("content")),
        )

    pairs = c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", chat().alias("chosen"), chat().alias("rejected"))
    return W.preference_violations(pairs).select("conv_id", "turn", "violation")


@query("response_audit", f"""WITH a AS (SELECT role, text, {N_WORDS} AS n, strpos(text, '. ') AS p FROM conversations)
  SELECT role, count(*) AS n, sum(n)::BIGINT AS tokens,
    sum(len({words("CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE text END")}))::BIGINT AS before_tokens,
    count(*) FILTER (NOT contains(array_to_string({words('text')}[1:64], ' '), '. ')) AS without_marker, count(*) FILTER (n > 64) AS cut FROM a GROUP BY role""")
def _(t):
    from datasheaf.operators.audit import token_audit

    return token_audit(t.conversations, ["role"], "text", ". ", 64)


# Splits

@query("split_three_way", f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {digest('123', 'doc_id')}, doc_id) - 1 AS pos FROM documents),
  n AS (SELECT count(*) AS n, floor(count(*) * 0.8)::BIGINT AS tr FROM documents)
  SELECT doc_id, CASE WHEN pos < tr THEN 'train' WHEN pos < n - ceil((n - tr) * 0.5) THEN 'valid' ELSE 'test' END AS split FROM p, n""")
def _(t):
    return X.split_three_way(t.documents.select("doc_id"), "doc_id")


@query("split_tail", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN pos < n - ceil(n * 0.2) THEN 'train' ELSE 'test' END AS split FROM p""")
def _(t):
    return X.split_tail(t.documents.select("doc_id"), ["doc_id"])


@query("split_exact", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {digest('0', 'doc_id')}, doc_id) <= 300 THEN 'train' ELSE 'test' END AS split FROM documents""")
def _(t):
    return X.split_exact(t.documents.select("doc_id"), "doc_id", 300, ("train", "test"))


@query("split_holdout", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {digest('9', 'doc_id')}, doc_id) <= 128 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def _(t):
    return X.split_exact(t.documents.select("doc_id"), "doc_id", 128, ("validation", "train"), seed=9)


@query("split_classes", f"""WITH c AS (SELECT source, row_number() OVER (ORDER BY {digest('0', 'source')}, source) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT source FROM documents))
  SELECT doc_id, source, CASE WHEN r <= floor(n * 0.25) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN c USING (source)""")
def _(t):
    return X.split_classes(t.documents.select("doc_id", "source"), "source", 0.25)


@query("semi_anti_split", """SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 'train' ELSE 'dev' END AS split FROM documents d
  LEFT JOIN (SELECT DISTINCT doc_id, source FROM labels JOIN documents USING (doc_id)) l ON l.doc_id = d.doc_id AND l.source = d.source""")
def _(t):
    listed = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return J.split_by_id_list(t.documents.select("doc_id", "source"), listed, ["doc_id", "source"])


@query("dataset_mixture", """WITH p AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
  q AS (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier)
  SELECT key, 'customer' AS subset FROM p WHERE pos < floor(n * 0.25) UNION ALL SELECT key, 'supplier' FROM q WHERE pos < 40""")
def _(t):
    return X.dataset_mixture([
        (t.customer.select(F.col("c_custkey").alias("key")), "customer", 0.25),
        (t.supplier.select(F.col("s_suppkey").alias("key")), "supplier", 40),
    ], "key")


@query("set_compare", """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
  SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n
  FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def _(t):
    from datasheaf.operators.sets import compare_keys

    return compare_keys(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), "k").groupBy(
        "side"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("set_except", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("top_n_per_group", """SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 20""")
def _(t):
    from datasheaf.operators.sets import top_n_per_group

    top = top_n_per_group(t.lineitem, ["l_suppkey"], ["-l_extendedprice", "l_orderkey", "l_linenumber"], 20)
    return top.select("l_suppkey", "l_orderkey", "l_extendedprice")


@query("upsert_by_key", """WITH u AS (SELECT o_custkey AS k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1)
  SELECT c_custkey AS key, coalesce(v, c_acctbal) AS value FROM customer LEFT JOIN u ON k = c_custkey
  UNION ALL SELECT k, v FROM u WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    updates = t.orders.select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"),
        F.struct("o_orderdate", "o_orderkey").alias("arrival"),
    )
    target = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return J.upsert(target, updates, "key", "arrival")


@query("hierarchy_join", """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def _(t):
    # Orders are summed per customer first: a busy customer is one row in the joins.
    per_customer = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("s"))
    return (
        t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_name", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("s"), 2).alias("total"))
    )


# Sampling

@query("episodes", f"""WITH m AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {digest('0:member', 'vec_id')}, vec_id) - 1 AS pos FROM embeddings),
  s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 6),
  d AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {digest('0:class', 'task', 'label')}, label) - 1 AS way FROM s, range(0, 50) g(task)),
  k AS (SELECT task, way, label, {draw_int('0:rotation', 'task', 'label')} % 4 * 90 AS rotation, slot,
    ({draw_int('0:start', 'task', 'label')} % n + slot) % n AS pos FROM d, range(0, 6) h(slot) WHERE way < 5)
  SELECT task::INTEGER AS task, way::INTEGER AS way, k.label, rotation, slot::INTEGER AS slot, CASE WHEN slot < 1 THEN 'support' ELSE 'query' END AS role, vec_id
  FROM k JOIN m ON m.label = k.label AND m.pos = k.pos""")
def _(t):
    return X.sample_episodes(t.embeddings.select("vec_id", "label"), "vec_id", "label", 5, 1, 5, 50)


IDS = f"(SELECT doc_id, list_transform({words('text')}, lambda w: length(w)::BIGINT) AS ids FROM documents)"


def ids(t):
    docs = spread(t.documents.select("doc_id", "text"))
    return docs.select("doc_id", F.transform(T.words("text"), lambda w: F.length(w).cast("long")).alias("ids"))


def _csv(c):
    return F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


@query("mlm_mask", f"""WITH l AS (SELECT doc_id, unnest(ids) AS x, generate_subscripts(ids, 1) - 1 AS i FROM {IDS}),
  u AS (SELECT *, {sdraw('0:pick', 'doc_id', 'i')} < 0.15 AND x <> 1 AS hit, {sdraw('0:how', 'doc_id', 'i')} AS how, {draw_int('0:token', 'doc_id', 'i')} % 1000 AS rnd FROM l)
  SELECT doc_id, md5(string_agg((CASE WHEN NOT hit OR how >= 0.9 THEN x WHEN how < 0.8 THEN -1 ELSE rnd END)::VARCHAR, ',' ORDER BY i)) AS masked,
    md5(string_agg((CASE WHEN hit THEN x ELSE -100 END)::VARCHAR, ',' ORDER BY i)) AS labels FROM u GROUP BY doc_id""")
def _(t):
    m = X.mlm_mask(ids(t).filter(F.size("ids") > 0), "doc_id", "ids", -1, 1000, special=[1])
    return m.select("doc_id", _csv("masked").alias("masked"), _csv("labels").alias("labels"))


@query("plm_spans", f"""WITH c AS (SELECT doc_id, len(ids) AS n, unnest(range(0, greatest(len(ids) - 1, 0) // 30 + 1)) AS context FROM {IDS}),
  s AS (SELECT *, {draw_int('0:span', 'doc_id', 'context')} % 5 + 1 AS span FROM c),
  w AS (SELECT *, context * 30 + {draw_int('0:start', 'doc_id', 'context')} % (floor(span / (1.0::DOUBLE / 6))::BIGINT - span + 1) AS start FROM s)
  SELECT doc_id, context, start, least(span, n - start) AS span FROM w WHERE n - start > 0""")
def _(t):
    lens = ids(t).select("doc_id", F.size("ids").alias("n"))
    return X.plm_spans(lens, "doc_id", "n", 1 / 6, 5).withColumn("context", F.col("context").cast("long"))


ANN = "(SELECT l_orderkey AS image_id, l_suppkey AS category_id FROM lineitem)"


@query("repeat_factor", f"""WITH p AS (SELECT DISTINCT * FROM {ANN}), n AS (SELECT count(DISTINCT image_id) AS n FROM p),
  f AS (SELECT category_id, greatest(1.0::DOUBLE, sqrt(0.08 / (count(*) / any_value(n)))) AS f FROM p, n GROUP BY category_id),
  r AS (SELECT image_id, max(f) AS factor FROM p JOIN f USING (category_id) GROUP BY image_id)
  SELECT image_id, round(factor, 6) AS factor, (floor(factor) + ({sdraw('0', 'image_id')} < factor - floor(factor))::INTEGER)::BIGINT AS copies FROM r""")
def _(t):
    ann = t.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("category_id"))
    rep = X.repeat_images(X.repeat_factors(ann, 0.08))
    return rep.groupBy("image_id").agg(F.round(F.first("factor"), 6).alias("factor"), F.count(F.lit(1)).alias("copies"))


@query("completion_labels", f"""WITH d AS (SELECT doc_id, ids, list_filter(range(1, len(ids)), lambda i: ids[i] = 3 AND ids[i + 1] = 2)[1] + 1 AS cut FROM {IDS})
  SELECT doc_id, md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= coalesce(cut, len(ids)) THEN -100 ELSE x END), ',')) AS labels FROM d WHERE len(ids) > 0""")
def _(t):
    lab = ids(t).filter(F.size("ids") > 0).withColumn("labels", X.completion_labels(F.col("ids"), [3, 2]))
    return lab.select("doc_id", _csv("labels").alias("labels"))


@query("hparam_random", f"""WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS a, max(p_retailprice) AS z FROM part)
  SELECT p_partkey AS trial, (lo + floor({sdraw('3:filters', 'p_partkey')} * (hi - lo + 1)))::BIGINT AS filters,
    round(a + {sdraw('3:dropout', 'p_partkey')} * (z - a), 6) AS dropout, round(10.0::DOUBLE ** (-5 + {sdraw('3:lr', 'p_partkey')} * 4), 9) AS lr FROM part, b""")
def _(t):
    bounds = t.part.agg(
        F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("z")
    )
    lo, hi, a, z = (bounds.select(c).scalar() for c in ("lo", "hi", "a", "z"))
    h = X.sample_hparams(
        t.part.select(F.col("p_partkey").alias("trial")), "trial",
        {"filters": ("int", lo, hi), "dropout": ("double", a, z), "lr": ("log", -5.0, -1.0)}, seed=3,
    )
    return h.select("trial", "filters", F.round("dropout", 6).alias("dropout"), F.round("lr", 9).alias("lr"))


@query("hparam_grid", """SELECT search, kind, size FROM (SELECT DISTINCT p_brand AS search, p_type AS kind FROM part)
  JOIN (SELECT DISTINCT p_brand AS search, p_size AS size FROM part) USING (search)""")
def _(t):
    lists = t.part.groupBy(F.col("p_brand").alias("search")).agg(
        F.collect_set("p_type").alias("kind"), F.collect_set("p_size").alias("size")
    )
    return X.grid_hparams(lists, "search", ["kind", "size"])


@query("hp_constraint", f"""SELECT p_partkey AS trial FROM part WHERE abs((floor({sdraw('3:f2', 'p_partkey')} * 64) - p_size)) >= 10""")
def _(t):
    f2 = F.floor(draw("3:f2", "p_partkey") * 64)
    return t.part.filter(W.hp_constraint(F.col("p_size"), f2)).select(F.col("p_partkey").alias("trial"))


_OPS = "['skip_connect','sep_conv_3x3','max_pool','none'][{} % 4 + 1]"


@query("arch_constraints", f"""WITH c AS (SELECT p_partkey AS trial, {", ".join(f"{_OPS.format(draw_int(f'8:normal{i}', 'p_partkey'))} AS n{i}" for i in range(8))},
    {", ".join(f"{_OPS.format(draw_int(f'8:reduce{i}', 'p_partkey'))} AS r{i}" for i in range(4))}, p_retailprice * 3000 AS params FROM part),
  k AS (SELECT trial, params, {"+".join(f"(n{i}='skip_connect')::INTEGER" for i in range(8))} AS ns, {"+".join(f"(r{i}='skip_connect')::INTEGER" for i in range(4))} AS rs,
    {"+".join(f"(n{i}='sep_conv_3x3')::INTEGER" for i in range(8))} AS nc FROM c)
  SELECT trial, CASE WHEN ns >= 3 OR rs >= 3 THEN 'too many skip' WHEN ns = 0 OR rs = 0 THEN 'too few skip' WHEN nc < 3 THEN 'too few conv'
    WHEN params < 2.5e6 OR params > 4.5e6 THEN 'parameters out of range' END AS reason FROM k""")
def _(t):
    from datasheaf.functions.hashing import draw_int as di

    ops = F.lit(["skip_connect", "sep_conv_3x3", "max_pool", "none"])
    names = [f"normal{i}" for i in range(8)] + [f"reduce{i}" for i in range(4)]
    trials = t.part.select(
        F.col("p_partkey").alias("trial"), (F.col("p_retailprice") * 3000).alias("params"),
        *[F.get(ops, (di(f"8:{n}", "p_partkey") % 4).cast("int")).alias(n) for n in names],
    )
    return W.arch_constraints(trials, "trial", names, "params")


# Columns found by name, by place or by shape

@query("resolve_columns", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def _(t):
    """`content` is not there, so the column in its place is taken; `lang` is."""
    df = t.documents.select("text", "lang")
    text, lang = C.resolve_column(df, "content", 0), C.resolve_column(df, "lang", 0)
    return df.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"))


@query("rename_legacy_keys", "SELECT vec_id AS ids, round(embedding[1]::DOUBLE, 6) AS objectness_logits, label AS kept FROM embeddings")
def _(t):
    old = t.embeddings.select(
        F.col("vec_id").alias("indexes"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("scores"), F.col("label").alias("kept")
    )
    return C.rename_legacy_keys(old)


@query("preference_format", """SELECT 'prompt,chosen,rejected' AS format, count(*) AS n FROM conversations
  UNION ALL SELECT 'chosen,rejected', count(*) FROM conversations""")
def _(t):
    message = F.array(F.struct("role", F.col("text").alias("content")))
    chat = t.conversations.select(message.alias("chosen"), message.alias("rejected"))
    triplet = t.conversations.select(F.col("role").alias("prompt"), F.col("text").alias("chosen"), F.col("text").alias("rejected"))
    count = lambda df: df.agg(F.lit(C.preference_format(df)).alias("format"), F.count(F.lit(1)).alias("n"))
    return count(triplet).unionByName(count(chat))


@query("expect_count", "SELECT count(*) AS rows, count(*) AS expected FROM documents")
def _(t):
    expected = t.documents.agg(F.count(F.lit(1)).alias("expected"))
    return expected.select(F.lit(C.expect_count(t.documents, expected.first()[0])).cast("long").alias("rows"), "expected")
