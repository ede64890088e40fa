"""Span question answering, entity tagging, BLEU and token accuracy."""

from pyspark.sql import functions as F

from datasheaf.functions import text as T
from datasheaf.functions.hashing import draw, draw_int, draw_ints, draws
from datasheaf.operators import entities as N
from datasheaf.operators import joins as J
from datasheaf.operators import language as L
from datasheaf.operators import packing as P
from datasheaf.operators import qa as Q
from datasheaf.plans.preparation import PAIRS, question_answer
from datasheaf.plans.registry import query
from datasheaf.session import spread
from datasheaf.plans.sqltext import LINES, PUNCT_SQL, draw as sdraw, draw_int as sdraw_int, words

# A feature is a window of at most 128 words of a document: token 0 is CLS, then the words.
MAX_WORDS, STRIDE = 128, 32


def windows(t):
    docs = spread(t.documents.select("doc_id", "text")).select("doc_id", T.words("text").alias("ws"))
    w = P.sliding_windows(docs, "ws", F.lit(0), MAX_WORDS, STRIDE, specials=0)
    return w.select("doc_id", "window", F.col("window_tokens").alias("ws"))


WINDOWS = f"""(SELECT doc_id, "window", list_slice(ws, "window" * 96 + 1, "window" * 96 + 128) AS ws FROM (
    SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= 128 THEN 1 ELSE ceil((len(ws) - 128) / 96.0::DOUBLE)::BIGINT + 1 END)) AS "window"
    FROM (SELECT doc_id, {words('text')} AS ws FROM documents)))"""


def features(t):
    """Windows with context, offsets (NULL at CLS) and drawn logits for every token."""
    def logits(name):
        return draws(name, F.size("ws") + 1, "doc_id", "window", low=-5.0, width=10.0)

    return windows(t).select(
        "doc_id", "window", F.array_join("ws", " ").alias("context"),
        F.concat(
            F.array(F.lit(None).cast("struct<s:int,e:int>")), Q.word_offsets(F.col("ws"))
        ).alias("offsets"),
        logits("s").alias("start_logits"), logits("e").alias("end_logits"),
    )


FEATURES = f"""w AS (SELECT * FROM {WINDOWS}),
  tok AS (SELECT doc_id, "window", unnest(range(0, len(ws) + 1)) AS i FROM w),
  lg AS (SELECT *, {sdraw('s', 'doc_id', '"window"', 'i')} * 10 - 5 AS s, {sdraw('e', 'doc_id', '"window"', 'i')} * 10 - 5 AS e FROM tok)"""
CANDIDATES = FEATURES + """,
  st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "window" ORDER BY s DESC, i) AS r FROM lg) WHERE r <= 20 AND i > 0),
  en AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "window" ORDER BY e DESC, i) AS r FROM lg) WHERE r <= 20 AND i > 0),
  cand AS (SELECT st.doc_id, st."window", st.i AS start, en.i AS "end", st.s + en.e AS score, st.s AS start_logit, en.e AS end_logit
    FROM st JOIN en ON st.doc_id = en.doc_id AND st."window" = en."window" AND en.i BETWEEN st.i AND st.i + 29)"""
NBEST = CANDIDATES + """,
  nb AS (SELECT cand.*, array_to_string(list_slice(ws, start, "end"), ' ') AS text,
      row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "window", start, "end") AS rank
    FROM cand JOIN w USING (doc_id, "window") QUALIFY rank <= 20),
  nul AS (SELECT doc_id, min(s + e) AS null_score FROM lg WHERE i = 0 GROUP BY doc_id)"""


def candidates(t):
    return Q.span_candidates(features(t))


def n_best(t):
    return Q.n_best(Q.span_candidates(features(t), best=20), "doc_id")


@query("example_windows", f"""SELECT d.doc_id, n_chars, "window", len(ws)::INTEGER AS n_words FROM documents d JOIN {WINDOWS} w ON w.doc_id = d.doc_id""")
def _(t):
    f = windows(t).select("doc_id", "window", F.size("ws").alias("n_words"))
    return J.attach_features(t.documents.select("doc_id", "n_chars"), f, "doc_id")


@query("span_candidates", f"""WITH {CANDIDATES} SELECT doc_id, "window", start, "end", round(score, 6) AS score FROM cand""")
def _(t):
    return candidates(t).select(
        "doc_id", "window", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.round("score", 6).alias("score"),
    )


@query("nbest_spans", f"""WITH {NBEST} SELECT doc_id, rank::INTEGER AS rank, "window", text, round(score, 6) AS score FROM nb""")
def _(t):
    return n_best(t).select("doc_id", "rank", "window", "text", F.round("score", 6).alias("score"))


@query("null_answer", f"""WITH {NBEST}, b AS (SELECT doc_id, text, start_logit, end_logit FROM nb WHERE rank = 1)
  SELECT doc_id, round(null_score - coalesce(start_logit, 0) - coalesce(end_logit, 0), 6) AS score_diff,
    CASE WHEN null_score - coalesce(start_logit, 0) - coalesce(end_logit, 0) > -9 THEN '' ELSE coalesce(text, 'empty') END AS answer
  FROM nul LEFT JOIN b USING (doc_id)""")
def _(t):
    a = Q.null_answer(n_best(t), Q.null_scores(features(t), "doc_id"), "doc_id", threshold=-9.0)
    return a.withColumn("score_diff", F.round("score_diff", 6))


@query("nbest_fallback", f"""WITH {NBEST} SELECT doc_id, rank::INTEGER AS rank, text, round(score, 6) AS score FROM nb
  UNION ALL SELECT doc_id, 0, 'empty', 0.0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM nb)
  UNION ALL SELECT doc_id, 0, 'empty', 0.0 FROM nb GROUP BY doc_id HAVING count(*) = 1 AND max(text) = ''""")
def _(t):
    return Q.with_fallback(n_best(t), t.documents, "doc_id").select(
        "doc_id", "rank", "text", F.round("score", 6).alias("score")
    )


@query("group_softmax", f"""WITH {NBEST}, m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS x FROM nb)
  SELECT doc_id, rank::INTEGER AS rank, round(x / sum(x) OVER (PARTITION BY doc_id), 6) AS probability FROM m""")
def _(t):
    p = Q.group_softmax(n_best(t).select("doc_id", "rank", "score"), "doc_id", "score")
    return p.select("doc_id", "rank", F.round("probability", 6).alias("probability"))


def beam_features(t):
    """Beam outputs: 5 starts, 5 ends for each, drawn."""
    n = F.col("n") + 1

    def top(name, k, what):
        if what == "index":
            return F.transform(draw_ints(name, F.lit(k), "doc_id", "window"), lambda x: (x % n).cast("int"))
        return draws(name, F.lit(k), "doc_id", "window", low=0.0, width=-5.0)

    w = windows(t).withColumn("n", F.size("ws"))
    return w.select(
        "doc_id", "window", F.array_join("ws", " ").alias("context"),
        F.concat(F.array(F.lit(None).cast("struct<s:int,e:int>")), Q.word_offsets(F.col("ws"))).alias("offsets"),
        top("bsi", 5, "index").alias("start_top_index"), top("bsl", 5, "p").alias("start_top_log_probs"),
        top("bei", 25, "index").alias("end_top_index"), top("bel", 25, "p").alias("end_top_log_probs"),
        (draw("cls", "doc_id", "window") * 4 - 2).alias("cls_logit"),
    )


BEAM = f"""w AS (SELECT *, len(ws) + 1 AS n, {sdraw('cls', 'doc_id', '"window"')} * 4 - 2 AS cls FROM {WINDOWS}),
  k AS (SELECT *, unnest(range(0, 25)) AS k FROM w), ki AS (SELECT *, k // 5 AS i FROM k),
  c AS (SELECT doc_id, "window", ws, {sdraw_int('bsi', 'doc_id', '"window"', 'i')} % n AS start, {sdraw_int('bei', 'doc_id', '"window"', 'k')} % n AS "end",
    -{sdraw('bsl', 'doc_id', '"window"', 'i')} * 5 - {sdraw('bel', 'doc_id', '"window"', 'k')} * 5 AS score FROM ki),
  v AS (SELECT * FROM c WHERE start > 0 AND "end" BETWEEN start AND start + 29)"""


@query("beam_candidates", f"""WITH {BEAM} SELECT doc_id, "window", start::INTEGER AS start, "end"::INTEGER AS "end", round(score, 6) AS score FROM v""")
def _(t):
    c = Q.beam_candidates(beam_features(t), 5, 5)
    return c.select("doc_id", "window", "start", "end", F.round("score", 6).alias("score"))


@query("beam_answer", f"""WITH {BEAM}, b AS (SELECT doc_id, array_to_string(list_slice(ws, start, "end"), ' ') AS text,
    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "window", start, "end") AS r FROM v)
  SELECT w.doc_id, coalesce(any_value(b.text), '') AS answer, round(min(cls), 6) AS no_answer FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND r = 1 GROUP BY w.doc_id""")
def _(t):
    f = beam_features(t)
    a = Q.beam_answer(Q.n_best(Q.beam_candidates(f, 5, 5), "doc_id"), f, "doc_id")
    return a.withColumn("no_answer", F.round("no_answer", 6))


@query("answer_token_span", f"""WITH w AS (SELECT doc_id, "window", ws, len(ws) AS n, 5 + doc_id % 40 AS a, 30 + doc_id % 40 AS b FROM {WINDOWS}),
  o AS (SELECT doc_id, "window", a, b, unnest(range(1, n + 1)) AS i, ws FROM w),
  x AS (SELECT doc_id, "window", a, b, i, coalesce(list_sum(list_transform(ws[1:i - 1], lambda q: length(q) + 1)), 0) AS s, length(ws[i]) AS l FROM o),
  g AS (SELECT doc_id, "window", min(s) <= any_value(a) AND max(s + l) >= any_value(b) AS ok, max(i) FILTER (s <= a) AS st, min(i) FILTER (s + l >= b) AS en FROM x GROUP BY ALL)
  SELECT w.doc_id, w."window", CASE WHEN ok THEN st ELSE 0 END::INTEGER AS start, CASE WHEN ok THEN en ELSE 0 END::INTEGER AS "end"
  FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g."window" = w."window" """)
def _(t):
    f = windows(t).withColumn(
        "offsets", F.concat(F.array(F.lit(None).cast("struct<s:int,e:int>")), Q.word_offsets(F.col("ws")))
    )
    lo = F.col("doc_id") % 40
    span = Q.answer_token_span(F.col("offsets"), lo + 5, lo + 30, F.lit(0))
    return f.select("doc_id", "window", span.alias("x")).select("doc_id", "window", "x.start", "x.end")


@query("window_masks", f"""WITH w AS (SELECT doc_id, "window", len(ws) AS n FROM {WINDOWS})
  SELECT doc_id, "window", 0 AS cls_index, 1::BIGINT AS masked, n AS in_context,
    (n < 10 + doc_id % 40) AS is_impossible FROM w""")
def _(t):
    # Layout: CLS, context words, one separator.
    f = windows(t).withColumn("n", F.size("ws")).withColumn(
        "ctx", F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), F.col("n")), F.array(F.lit(False)))
    )
    offs = F.transform(F.sequence(F.lit(0), F.col("n") + 1), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
    m = f.select(
        "doc_id", "window", F.lit(0).alias("cls_index"), Q.p_mask(F.col("ctx"), F.lit(0)).alias("mask"),
        Q.context_offsets(offs, F.col("ctx")).alias("offsets"),
    )
    a = (10 + F.col("doc_id") % 40).cast("int")
    span = Q.answer_token_span(F.col("offsets"), a, a + 1, F.lit(0))
    return m.select(
        "doc_id", "window", "cls_index", F.size(F.filter("mask", lambda x: x == 1)).cast("long").alias("masked"),
        F.size(F.filter("offsets", lambda o: o.isNotNull())).cast("long").alias("in_context"),
        (span["start"] == 0).alias("is_impossible"),
    )


@query("align_predictions", """SELECT o_orderkey, o_totalprice, l_extendedprice AS best FROM orders JOIN
  (SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def _(t):
    preds = t.lineitem.groupBy(F.col("l_orderkey").alias("ind")).agg(F.max("l_extendedprice").alias("best"))
    feats = t.orders.select(F.col("o_orderkey").alias("ind"), "o_totalprice")
    return J.align_predictions(preds, feats).select(F.col("ind").alias("o_orderkey"), "o_totalprice", "best")


@query("pred_vs_ref", """SELECT CASE WHEN d.doc_id IS NULL THEN 'reference' WHEN l.doc_id IS NULL THEN 'prediction' ELSE 'both' END AS side,
  count(*) AS n, count(*) FILTER ((n_chars > 1000)::INTEGER = quality) AS hits FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def _(t):
    j = J.predictions_vs_references(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), "doc_id")
    hit = (F.col("n_chars") > 1000).cast("int") == F.col("quality")
    return j.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))


def _norm(col):
    stripped = f"regexp_replace(lower({col}), '{PUNCT_SQL}', '', 'g')"
    return f"list_filter({words(stripped)}, lambda w: w NOT IN ('a', 'an', 'the'))"


@query("squad_em_f1", f"""WITH g AS (SELECT * FROM (SELECT conv_id, turn, {_norm('question')} AS p, unnest([{_norm('answer')}, {_norm('other')}]) AS g, unnest([0, 1]) AS k
    FROM (SELECT p.*, o.text AS other FROM {PAIRS} p LEFT JOIN conversations o ON o.conv_id = p.conv_id AND o.turn = p.turn + 2)) WHERE g IS NOT NULL),
  l AS (SELECT conv_id, turn, k, w, sum(c) AS cp, sum(1 - c) AS cg FROM (SELECT conv_id, turn, k, unnest(p) AS w, 1 AS c FROM g
    UNION ALL SELECT conv_id, turn, k, unnest(g), 0 FROM g) GROUP BY ALL),
  s AS (SELECT conv_id, turn, k, sum(least(cp, cg)) AS same FROM l GROUP BY ALL),
  f AS (SELECT g.conv_id, g.turn, max((p = g)::INTEGER) AS em, max(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INTEGER
      ELSE 2.0 * coalesce(same, 0) / (len(p) + len(g)) END) AS f1
    FROM g LEFT JOIN s ON s.conv_id = g.conv_id AND s.turn = g.turn AND s.k = g.k GROUP BY g.conv_id, g.turn)
  SELECT round(avg(em) * 100, 6) AS exact_match, round(avg(f1) * 100, 6) AS f1, count(*) AS total FROM f""")
def _(t):
    later = t.conversations.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    df = question_answer(t).join(later, ["conv_id", "turn"], "left").select(
        F.struct("conv_id", "turn").alias("id"), "question", F.array_compact(F.array("answer", "other")).alias("golds")
    )
    s = Q.squad_em_f1(df, "id", "question", "golds")
    return s.select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "total")


@query("squad_thresholds", f"""WITH b AS (SELECT p.*, o.text AS other, length(question) % 3 <> 0 AS has, length(answer) % 17 / 16.0::DOUBLE AS odds
    FROM {PAIRS} p LEFT JOIN conversations o ON o.conv_id = p.conv_id AND o.turn = p.turn + 2),
  g AS (SELECT * FROM (SELECT conv_id, turn, has, odds, question <> '' AS said, {_norm('question')} AS p, unnest(CASE WHEN has THEN [{_norm('answer')}, {_norm('other')}]
      ELSE [[]::VARCHAR[], NULL] END) AS g, unnest([0, 1]) AS k FROM b) WHERE g IS NOT NULL),
  l AS (SELECT conv_id, turn, k, w, sum(c) AS cp, sum(1 - c) AS cg FROM (SELECT conv_id, turn, k, unnest(p) AS w, 1 AS c FROM g
    UNION ALL SELECT conv_id, turn, k, unnest(g), 0 FROM g) GROUP BY ALL),
  s AS (SELECT conv_id, turn, k, sum(least(cp, cg)) AS same FROM l GROUP BY ALL),
  f AS (SELECT g.conv_id, g.turn, has, odds, said, max((p = g)::INTEGER) AS em, max(CASE WHEN len(p) = 0 OR len(g) = 0 THEN (len(p) = len(g))::INTEGER
      ELSE 2.0 * coalesce(same, 0) / (len(p) + len(g)) END) AS f1
    FROM g LEFT JOIN s ON s.conv_id = g.conv_id AND s.turn = g.turn AND s.k = g.k GROUP BY ALL),
  r AS (SELECT odds, sum(sum(CASE WHEN has THEN em ELSE -said::INT END)) OVER w AS em, sum(sum(CASE WHEN has THEN f1 ELSE -said::INT END)) OVER w AS f1
    FROM f GROUP BY odds WINDOW w AS (ORDER BY odds)),
  n AS (SELECT count(*) AS total, avg(em) * 100 AS exact, avg(f1) * 100 AS f1, count(*) FILTER (has) AS ht, avg(em) FILTER (has) * 100 AS he,
    avg(f1) FILTER (has) * 100 AS hf, count(*) FILTER (NOT has) AS nt, avg(em) FILTER (NOT has) * 100 AS ne, avg(f1) FILTER (NOT has) * 100 AS nf FROM f)
  SELECT total, round(exact, 4) AS exact, round(f1, 4) AS f1, ht AS "HasAns_total", round(he, 4) AS "HasAns_exact", round(hf, 4) AS "HasAns_f1",
    nt AS "NoAns_total", round(ne, 4) AS "NoAns_exact", round(nf, 4) AS "NoAns_f1",
    round((nt + greatest((SELECT max(em) FROM r), 0)) * 100.0 / total, 4) AS best_exact,
    CASE WHEN (SELECT max(em) FROM r) > 0 THEN (SELECT min(odds) FROM r WHERE em = (SELECT max(em) FROM r)) ELSE 0 END AS best_exact_thresh,
    round((nt + greatest((SELECT max(f1) FROM r), 0)) * 100.0 / total, 4) AS best_f1,
    CASE WHEN (SELECT max(f1) FROM r) > 0 THEN (SELECT min(odds) FROM r WHERE f1 = (SELECT max(f1) FROM r)) ELSE 0 END AS best_f1_thresh FROM n""")
def _(t):
    later = t.conversations.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("other"))
    golds = F.when(F.length("question") % 3 != 0, F.array_compact(F.array("answer", "other"))).otherwise(F.array().cast("array<string>"))
    df = question_answer(t).join(later, ["conv_id", "turn"], "left").select(
        F.struct("conv_id", "turn").alias("id"), "question", golds.alias("golds"), (F.length("answer") % 17 / F.lit(16.0)).alias("odds"))
    s = Q.squad_thresholds(df, "id", "question", "golds", "odds")
    return s.select(*[F.round(c, 4).alias(c) if s.schema[c].dataType.typeName() == "double" and "thresh" not in c else F.col(c) for c in s.columns])


def _gram_sql(col):
    """(id, n, gram) rows of a word list column."""
    return " UNION ALL ".join(
        f"SELECT id, {n} AS n, unnest(list_transform(range(1, len({col}) - {n} + 2), lambda i: array_to_string({col}[i:i + {n - 1}], ' '))) AS g FROM d"
        for n in range(1, 5)
    )


@query("corpus_bleu", f"""WITH d AS (SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS id, {words('question')} AS h, {words('answer')} AS r FROM {PAIRS}),
  gh AS (SELECT id, n, g, count(*) AS c FROM ({_gram_sql('h')}) GROUP BY ALL), gr AS (SELECT id, n, g, count(*) AS c FROM ({_gram_sql('r')}) GROUP BY ALL),
  m AS (SELECT gh.n, sum(least(gh.c, coalesce(gr.c, 0)))::DOUBLE / sum(gh.c) AS p FROM gh LEFT JOIN gr ON gr.id = gh.id AND gr.n = gh.n AND gr.g = gh.g GROUP BY gh.n),
  l AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM d), b AS (SELECT CASE WHEN hl > rl THEN 1.0::DOUBLE ELSE exp(1 - rl / hl) END AS bp FROM l)
  SELECT round(max(p) FILTER (n = 1), 6) AS p1, round(max(p) FILTER (n = 2), 6) AS p2, round(any_value(bp), 6) AS bp,
    round(CASE WHEN min(p) <= 0 THEN 0 ELSE any_value(bp) * exp(sum(CASE WHEN p > 0 THEN ln(p) END) / 4) END, 6) AS bleu FROM m, b""")
def _(t):
    df = question_answer(t).withColumn("id", F.struct("conv_id", "turn"))
    b = L.corpus_bleu(df, "id", "question", "answer")
    return b.select(*[F.round(c, 6).alias(c) for c in ("p1", "p2", "bp", "bleu")])


@query("shifted_token_accuracy", f"""WITH i AS (SELECT doc_id, {words('text')} AS ws FROM documents),
  l AS (SELECT doc_id, length(unnest(ws)) AS x, generate_subscripts(ws, 1) AS i FROM i),
  p AS (SELECT x, i, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM l)
  SELECT count(*) FILTER (x = y) AS hits, count(*) AS used, round(avg((x = y)::INTEGER), 6) AS accuracy FROM p WHERE y IS NOT NULL AND i >= 4""")
def _(t):
    ids = F.transform(T.words("text"), lambda w: F.length(w))
    labels = F.transform("ids", lambda x, i: F.when(i < 4, -100).otherwise(x))
    rows = t.documents.select(ids.alias("ids")).select("ids", labels.alias("labels"))
    hits, used = L.shifted_hits(F.col("ids"), F.col("labels"))
    return rows.agg(F.sum(hits).alias("hits"), F.sum(used).alias("used")).withColumn(
        "accuracy", F.round(F.col("hits") / F.col("used"), 6)
    )


TAGS = ["O", "O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def tagged(t):
    """Sentences (document lines) with drawn gold tags and predictions that differ now and then."""
    tags = F.lit(TAGS)

    def tag_of(x):
        return F.get(tags, (x % len(TAGS)).cast("int"))

    docs = spread(t.documents.select("doc_id", "text"))
    lines = docs.select("doc_id", F.posexplode(T.lines("text")).alias("line", "value"))
    sent = lines.select("doc_id", "line", T.words("value").alias("ws")).filter(F.size("ws") > 0)
    drawn = sent.select("doc_id", "line", *[draw_ints(x, F.size("ws"), "doc_id", "line").alias(x) for x in ("gold", "flip", "other")])
    gold = drawn.select("doc_id", "line", F.transform("gold", tag_of).alias("gold"), "flip", "other")

    def guess(tag, i):
        return F.when(F.get("flip", i) % 4 == 0, tag_of(F.get("other", i))).otherwise(tag)

    return gold.withColumn("pred", F.transform("gold", guess)).drop("flip", "other")


def _spans(col):
    return f"""{col}_a AS (SELECT doc_id, line, i, {col} AS t, lag({col}) OVER (PARTITION BY doc_id, line ORDER BY i) AS q FROM tok),
  {col}_b AS (SELECT *, t LIKE 'I-%' AND coalesce(q <> 'O' AND substr(q, 3) = substr(t, 3), false) AS cont FROM {col}_a),
  {col}_c AS (SELECT *, sum((NOT cont)::INTEGER) OVER (PARTITION BY doc_id, line ORDER BY i) AS grp FROM {col}_b),
  {col}_s AS (SELECT doc_id, line, min(i) AS s, max(i) AS e, substr(any_value(t), 3) AS k FROM {col}_c WHERE t <> 'O' GROUP BY doc_id, line, grp)"""


_TAG = "(['O','O','B-PER','I-PER','B-LOC','I-LOC'])[{} % 6 + 1]"


@query("entity_f1", f"""WITH tok AS (SELECT *, CASE WHEN {sdraw_int('flip', 'doc_id', 'line', 'i')} % 4 = 0 THEN {_TAG.format(sdraw_int('other', 'doc_id', 'line', 'i'))} ELSE gold END AS pred
    FROM (SELECT doc_id, line, i, {_TAG.format(sdraw_int('gold', 'doc_id', 'line', 'i'))} AS gold
      FROM (SELECT doc_id, line, unnest(range(0, len({words('value')}))) AS i FROM {LINES}))),
  {_spans('gold')}, {_spans('pred')},
  c AS (SELECT (SELECT count(*) FROM gold_s) AS ng, (SELECT count(*) FROM pred_s) AS np, (SELECT count(*) FROM gold_s NATURAL JOIN pred_s) AS tp,
    (SELECT avg((gold = pred)::INTEGER) FROM tok) AS acc)
  SELECT round(tp / np, 6) AS precision, round(tp / ng, 6) AS recall, round(2 * tp / (np + ng), 6) AS f1, round(acc, 6) AS accuracy FROM c""")
def _(t):
    s = N.entity_scores(tagged(t), "pred", "gold")
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query("subtoken_labels", f"""WITH w AS (SELECT doc_id, line, ws FROM (SELECT doc_id, line, {words('value')} AS ws FROM {LINES}) WHERE len(ws) > 0),
  p AS (SELECT doc_id, line, j, ws[j + 1] AS x, unnest(range(0, (length(ws[j + 1]) + 3) // 4)) AS k FROM (SELECT *, unnest(range(0, len(ws))) AS j FROM w))
  SELECT doc_id, line::INTEGER AS line, count(*) + 2 AS pieces, sum(CASE WHEN k = 0 THEN length(x) ELSE -100 END)::BIGINT - 200 AS total,
    sum(length(x))::BIGINT - 200 AS total_all FROM p GROUP BY doc_id, line""")
def _(t):
    # Pieces of four characters; a special token in front and at the end.
    lines = t.documents.select("doc_id", F.posexplode(T.lines("text")).alias("line", "value"))
    sent = lines.select("doc_id", "line", T.words("value").alias("ws")).filter(F.size("ws") > 0)
    none = F.array(F.lit(None).cast("int"))
    ids = F.concat(
        none, F.flatten(F.transform("ws", lambda w, j: F.array_repeat(j, F.ceil(F.length(w) / 4).cast("int")))), none
    )
    rows = sent.select("doc_id", "line", ids.alias("word_ids"), F.transform("ws", lambda w: F.length(w)).alias("labels"))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)

    first = N.subtoken_labels(F.col("word_ids"), F.col("labels"))
    every = N.subtoken_labels(F.col("word_ids"), F.col("labels"), label_all=True)
    return rows.select(
        "doc_id", "line", F.size("word_ids").cast("long").alias("pieces"), total(first).alias("total"), total(every).alias("total_all")
    )
