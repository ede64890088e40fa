"""Positions, shards, batches, corpora, packing and windows."""

from pyspark.sql import functions as F

from datasheaf.functions import text as T
from datasheaf.functions.hashing import digest
from datasheaf.operators import corpus as C
from datasheaf.operators import packing as P
from datasheaf.operators import positions as O
from datasheaf.plans.registry import query
from datasheaf.session import spread
from datasheaf.plans.sqltext import CORPUS, LINES, draw, draw_int, words

LINE_KEYS = ["doc_id", "line"]


def lines(t):
    return C.text_lines(spread(t.documents.select("doc_id", "text")), "text", "doc_id")


def texts(t):
    return C.corpus_texts(t.documents.select("doc_id", "text"), "text", ["doc_id"])


def corpus(t):
    return C.text_positions(texts(t), ["doc_id"])


def orders_pos(t):
    return O.global_index(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


ORDERS_POS = """(SELECT o_orderkey, o_totalprice,
  row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders)"""


@query("text_lines", f"SELECT doc_id, line::INTEGER AS line, value FROM {LINES}")
def _(t):
    return lines(t)


@query("global_index", f"SELECT * FROM {ORDERS_POS}")
def _(t):
    return orders_pos(t)


@query("corpus_positions", f"SELECT doc_id, line::INTEGER AS line, pos, token FROM {CORPUS}")
def _(t):
    return corpus(t)


VOCAB = f"""(SELECT token, n, row_number() OVER (ORDER BY first_pos) - 1 AS id FROM (
  SELECT token, min(pos) AS first_pos, count(*) AS n FROM {CORPUS} GROUP BY token))"""


@query("vocab", f"SELECT token, id, n FROM {VOCAB}")
def _(t):
    return C.build_vocab(corpus(t))


@query("encode_corpus", f"""SELECT id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos,
  sum(pos)::BIGINT AS pos_sum FROM {CORPUS} JOIN {VOCAB} USING (token) GROUP BY id""")
def _(t):
    tokens = corpus(t)
    ids = C.encode(tokens, C.build_vocab(tokens))
    return ids.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"), F.sum("pos").alias("pos_sum"),
    )


@query("encode_sentences", f"""SELECT doc_id, line::INTEGER AS line, count(*) AS n,
  string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
  FROM {CORPUS} c JOIN {VOCAB} USING (token) GROUP BY doc_id, line HAVING count(*) > 1""")
def _(t):
    tokens = corpus(t)
    rows = C.encode_sentences(tokens, C.build_vocab(tokens), LINE_KEYS)
    return rows.select(
        *LINE_KEYS, F.size("ids").cast("long").alias("n"),
        F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
    )


def corpus_size(t):
    return t.documents.select(F.sum(T.word_count("text") + F.size(T.lines("text")))).first()[0]


TOTAL = f"(SELECT count(*) FROM {CORPUS})"
CELLS = f"""(SELECT pos % (n // 16) AS row, pos // (n // 16) AS col, token FROM {CORPUS}, (SELECT {TOTAL} AS n)
  WHERE pos < (n // 16) * 16)"""


@query("batchify", f"SELECT row, string_agg(token, ' ' ORDER BY col) AS tokens FROM {CELLS} GROUP BY row")
def _(t):
    return C.batch_rows(texts(t), 16).select("row", F.array_join("tokens", " ").alias("tokens"))


@query("bptt_windows", f"""WITH c AS (SELECT * FROM {CELLS}), r AS (SELECT max(row) + 1 AS n FROM c),
  w AS (SELECT i AS "window", i * 35 AS start, least(35, n - 1 - i * 35) AS len
        FROM r, range(0, (n + 34) // 35) g(i) WHERE n - 1 - i * 35 > 0)
  SELECT "window", col, len, string_agg(token, ' ' ORDER BY row) FILTER (row < start + len) AS inputs,
    string_agg(token, ' ' ORDER BY row) FILTER (row > start) AS targets
  FROM w JOIN c ON row BETWEEN start AND start + len GROUP BY "window", col, len, start""")
def _(t):
    return C.text_windows(texts(t), 16, 35).select(
        "window", "col", "len", F.array_join("inputs", " ").alias("inputs"),
        F.array_join("targets", " ").alias("targets"),
    )


@query("random_windows", f"""WITH n AS (SELECT {TOTAL} // 16 - 2 AS last),
  d AS (SELECT i AS "window", last, least(75, greatest(5, trunc(
      CASE WHEN {draw('7:base', 'i')} < 0.95 THEN 70.0 ELSE 35.0 END
      + 5.0 * sqrt(-2.0 * ln(({draw_int('7:u1', 'i')} + 1) / 4294967296.0::DOUBLE))
            * cos(2.0 * pi() * {draw('7:u2', 'i')}))::BIGINT)) AS drawn
    FROM n, range(0, (last + 4) // 5) g(i)),
  s AS (SELECT "window", last, drawn, coalesce(sum(drawn) OVER (ORDER BY "window"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
  SELECT "window", start, least(drawn, last - 1 - start)::BIGINT AS len FROM s WHERE last - 1 - start > 0""")
def _(t):
    rows = corpus_size(t) // 16
    return C.random_windows(t.spark, rows, 70, 5, seed=7)


DOC_WORDS = f"(SELECT doc_id, {words('text')} AS ws FROM documents)"


def doc_words(t):
    return t.documents.select("doc_id", T.words("text").alias("ws"))


@query("pack_fixed", f"""WITH tok AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS block,
    doc_id, ws FROM {DOC_WORDS}),
  long AS (SELECT block, doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) AS i FROM tok),
  posd AS (SELECT block, tok, row_number() OVER (PARTITION BY block ORDER BY doc_id, i) - 1 AS p FROM long)
  SELECT block, p // 128 AS piece, string_agg(tok, ' ' ORDER BY p) AS tokens
  FROM posd GROUP BY block, piece HAVING count(*) = 128""")
def _(t):
    return P.pack_fixed(doc_words(t), "ws", "doc_id", 128).select(
        "block", "piece", F.array_join("tokens", " ").alias("tokens")
    )


@query("sliding_windows", f"""WITH d AS (SELECT doc_id, ws, len(ws) AS n, 384 - 3 - (3 + doc_id % 5) AS room
    FROM {DOC_WORDS}),
  w AS (SELECT *, unnest(range(0, CASE WHEN n <= room THEN 1
      ELSE ceil((n - room) / (room - 128)::DOUBLE)::BIGINT + 1 END)) AS "window" FROM d)
  SELECT doc_id, "window", "window" * (room - 128) AS start,
    len(list_slice(ws, "window" * (room - 128) + 1, "window" * (room - 128) + room)) AS n_tokens,
    md5(array_to_string(list_slice(ws, "window" * (room - 128) + 1, "window" * (room - 128) + room), ' ')) AS digest
  FROM w""")
def _(t):
    w = P.sliding_windows(doc_words(t), "ws", F.lit(3) + F.col("doc_id") % 5, 384, 128)
    return w.select(
        "doc_id", "window", "start", F.size("window_tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("window_tokens", " ")).alias("digest"),
    )


WORD_LENS = f"(SELECT doc_id, list_transform(ws, lambda w: length(w)::BIGINT) AS ids FROM {DOC_WORDS})"


def word_lens(t):
    return doc_words(t).select(
        "doc_id", F.transform("ws", lambda w: F.length(w).cast("long")).alias("ids")
    )


def _ids(c):
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query("pad_truncate", f"""SELECT doc_id,
    array_to_string(list_concat(list_resize([]::BIGINT[], greatest(64 - len(ids), 0), 0), ids[:64]), ',') AS input_ids,
    least(len(ids), 64) AS mask_sum FROM {WORD_LENS}""")
def _(t):
    rows = P.padded(word_lens(t), "ids", 64, F.lit(0).cast("long"), side="left")
    return rows.select(
        "doc_id", _ids("input_ids").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"),
    )


@query("dynamic_pad", f"""WITH b AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch
    FROM {WORD_LENS}),
  w AS (SELECT *, ((max(len(ids)) OVER (PARTITION BY batch) + 7) // 8) * 8 AS width FROM b)
  SELECT doc_id, batch, width, md5(array_to_string(list_resize(ids, width, 0), ',')) AS digest FROM w""")
def _(t):
    rows = O.global_index(word_lens(t), "doc_id").withColumn("batch", O.batch_id(F.col("pos"), 16))
    wide = P.padded(P.batch_width(rows, "ids", "batch", 8), "ids", F.col("width"), F.lit(0).cast("long"))
    return wide.select("doc_id", "batch", "width", F.md5(_ids("input_ids")).alias("digest"))


@query("length_batches", f"""WITH b AS (SELECT doc_id, len(ids) AS n,
    (row_number() OVER (ORDER BY len(ids), doc_id) - 1) // 32 AS batch FROM {WORD_LENS})
  SELECT doc_id, batch, n, max(n) OVER (PARTITION BY batch) AS width FROM b""")
def _(t):
    return P.length_batches(word_lens(t), "ids", ["doc_id"], 32).select(
        "doc_id", "batch", F.size("ids").cast("long").alias("n"), "width"
    )


@query("aspect_batches", """WITH b AS (SELECT p_partkey, CASE WHEN p_size * 30 > p_retailprice THEN 0 ELSE 1 END AS bucket
    FROM part),
  p AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) - 1) // 16 AS batch FROM b)
  SELECT p_partkey, bucket, batch FROM p QUALIFY count(*) OVER (PARTITION BY bucket, batch) = 16""")
def _(t):
    return P.aspect_batches(
        t.part.select("p_partkey", "p_size", "p_retailprice"),
        F.col("p_size") * 30, F.col("p_retailprice"), ["p_partkey"], 16,
    ).select("p_partkey", "bucket", "batch")


@query("shard_interleaved", f"SELECT o_orderkey, pos % 8 AS shard, (pos // 32) % 8 AS batch_shard FROM {ORDERS_POS}")
def _(t):
    return orders_pos(t).select(
        "o_orderkey", O.interleaved_shard(F.col("pos"), 8).alias("shard"),
        O.interleaved_batch_shard(F.col("pos"), 32, 8).alias("batch_shard"),
    )


@query("shard_contiguous", f"""SELECT o_orderkey, pos // ((n + 6) // 7) AS shard
  FROM {ORDERS_POS}, (SELECT count(*) AS n FROM orders)""")
def _(t):
    n = t.orders.count()
    return orders_pos(t).select("o_orderkey", O.contiguous_shard(F.col("pos"), n, 7).alias("shard"))


@query("fixed_batches", f"""SELECT batch, count(*) AS n, min(o_orderkey) AS first_key, round(sum(o_totalprice), 2) AS total
  FROM (SELECT *, pos // 128 AS batch FROM {ORDERS_POS}) GROUP BY batch HAVING count(*) = 128""")
def _(t):
    n = t.orders.count()
    full = O.full_batches_only(orders_pos(t), "pos", 128, n)
    return full.groupBy(O.batch_id(F.col("pos"), 128).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("resume_after", f"SELECT o_orderkey, pos FROM {ORDERS_POS} WHERE pos >= 20 * 64")
def _(t):
    return O.resume_after(orders_pos(t), "pos", 20, 64).select("o_orderkey", "pos")


@query("round_to_batch", f"""SELECT o_orderkey, pos FROM {ORDERS_POS}, (SELECT count(*) AS n FROM orders)
  WHERE pos < (n // 512) * 512""")
def _(t):
    return O.full_batches_only(orders_pos(t), "pos", 512, t.orders.count()).select("o_orderkey", "pos")


@query("every_kth", f"SELECT o_orderkey, pos FROM {ORDERS_POS} WHERE pos % 10 = 0")
def _(t):
    return O.every_kth(orders_pos(t), "pos", 10).select("o_orderkey", "pos")


@query("positional_slice", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
  n AS (SELECT count(*) AS n FROM documents)
  SELECT '[:100]' AS spec, doc_id FROM p WHERE pos < 100
  UNION ALL SELECT '[50:120]', doc_id FROM p WHERE pos >= 50 AND pos < 120
  UNION ALL SELECT '[:25%]', doc_id FROM p, n WHERE pos < round(n * 0.25)
  UNION ALL SELECT '[75%:]', doc_id FROM p, n WHERE pos >= round(n * 0.75)""")
def _(t):
    ids = t.documents.select("doc_id")
    parts = [
        O.positional_slice(ids, s, "doc_id").select(F.lit(s).alias("spec"), "doc_id")
        for s in ("[:100]", "[50:120]", "[:25%]", "[75%:]")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("epoch_order", """SELECT s_suppkey, epoch,
    row_number() OVER (PARTITION BY epoch ORDER BY md5('5:'||epoch||':'||s_suppkey), s_suppkey) - 1 AS pos
  FROM supplier, (SELECT unnest([0, 1, 2]) AS epoch)""")
def _(t):
    return P.epoch_order(t.supplier.select("s_suppkey"), "s_suppkey", 3, 5)


CHOICES = """(SELECT p_partkey, p_brand AS first, i AS choice, p_name || ' ' || e AS second
  FROM part, (SELECT unnest(['a','b','c','d']) AS e, unnest([0,1,2,3]) AS i))"""


def _choices(t):
    endings = [F.lit(e) for e in "abcd"]
    return P.explode_choices(t.part, "p_partkey", F.col("p_brand"), F.col("p_name"), endings)


@query("choices_flatten", f"SELECT p_partkey, first, choice, second FROM {CHOICES}")
def _(t):
    return _choices(t)


@query("choices_regroup", f"""SELECT p_partkey, string_agg(second, '|' ORDER BY choice) AS seconds
  FROM {CHOICES} GROUP BY p_partkey""")
def _(t):
    return P.regroup_choices(_choices(t), "p_partkey", "second").select(
        "p_partkey", F.array_join("seconds", "|").alias("seconds")
    )


@query("bilevel_pairs", """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:'||doc_id), doc_id) - 1 AS pos
    FROM documents), h AS (SELECT count(*) // 2 AS h FROM documents)
  SELECT a.doc_id AS train_id, b.doc_id AS val_id, a.pos FROM p a, h, p b WHERE a.pos < h AND b.pos = a.pos + h""")
def _(t):
    from datasheaf.operators.joins import bilevel_pairs

    shuffled = t.documents.select("doc_id", digest(3, "doc_id").alias("h"))
    return bilevel_pairs(shuffled, ["h", "doc_id"], t.documents.count()).select(
        F.col("a.doc_id").alias("train_id"), F.col("b.doc_id").alias("val_id"), "pos"
    )


NUMBERED = """a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pa FROM supplier),
  b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pb FROM customer),
  n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb),
  s AS (SELECT unnest(range(0, greatest(na, nb))) AS pos, na, nb FROM n)"""


@query("paired_modulo", f"""WITH {NUMBERED}
  SELECT pos, s_suppkey, c_custkey FROM s JOIN a ON pa = pos % na JOIN b ON pb = pos % nb""")
def _(t):
    from datasheaf.operators.joins import paired_domains

    return paired_domains(t.supplier.select("s_suppkey"), "s_suppkey", t.customer.select("c_custkey"), "c_custkey")


@query("paired_unaligned", f"""WITH {NUMBERED}
  SELECT pos, s_suppkey, c_custkey FROM s JOIN a ON pa = pos % na JOIN b ON pb = {draw_int('11', 'pos')} % nb""")
def _(t):
    from datasheaf.operators.joins import paired_domains

    return paired_domains(
        t.supplier.select("s_suppkey"), "s_suppkey", t.customer.select("c_custkey"), "c_custkey", seed=11
    )
