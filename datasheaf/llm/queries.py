"""One registered query for each operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from datasheaf.llm import ann, bpe, fingerprint, jaccard, merkle, mixing, prefixtrie, quality, rules, tokencount, toxicity, urlfilter, warc
from datasheaf.llm.common import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register `fn(spark, table, root)` under `name`."""
    def register(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(spark, spark.read.parquet(f"{root}/{table}.parquet"), root)

        run.__doc__, run.module = fn.__doc__, fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS src
  FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][((src - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS ceiling,
         (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s
), rounds AS (
  SELECT 0 AS round, src, weight, ceiling, total, false AS stopped FROM w
  UNION ALL
  SELECT round + 1, src, weight, ceiling, total, stopped OR weight * (total - gone) / nullif(open_weight, 0) >= ceiling
  FROM (SELECT *, sum(CASE WHEN stopped THEN ceiling ELSE 0 END) OVER () AS gone,
               sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open_weight FROM rounds)
  WHERE round < 60
), t AS (
  SELECT src, CASE WHEN stopped THEN ceiling ELSE weight * (total - gone) / open_weight END AS target
  FROM (SELECT *, sum(CASE WHEN stopped THEN ceiling ELSE 0 END) OVER () AS gone,
               sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () AS open_weight FROM rounds WHERE round = 60)
), placed AS (
  SELECT d.doc_id, d.size, w.source_size, t.target, floor(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY w.src ORDER BY
            md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.size::VARCHAR), d.doc_id
            ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN t ON t.src = w.src
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, words) - start)
        + greatest(0, least(start + source_size + size, words) - start - source_size))::BIGINT AS taken
FROM placed
"""


@query("op3_mixing", "documents", MIX_SQL)
def op3(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Words that the mix takes of every document: weights 3, 1, 2 in turn, 150% of all words, at most twice a source."""
    return mixing.words_taken(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


@query("op7_url_filters", "pages")
def op7(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Verdict on every page's url: the longest rule, else boosted trees fitted on the URLs that a rule decides."""
    return urlfilter.judge(pages, urlfilter.fit(pages))


@query("op5_fingerprints", "documents")
def op5(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Multiset hashes of every text and of its edit with the next text, and how like they are."""
    return fingerprint.with_next(docs)


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p
), bits AS (
  SELECT *, sha1(body) AS hex FROM f
), digits AS (
  SELECT *, list_transform(range(0, 32), lambda i:
    (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS five FROM bits
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(five, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digits
"""


@query("op10_warc", "pages", WARC_SQL)
def op10(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """Every page archived as WARC, indexed, looked up by its url and read back."""
    found = warc.archive_and_read(spark, pages, work_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_quality", "documents")
def op4(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Quality score of every text by positive-unlabelled learning."""
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{root}/labels.parquet")))


@query("op9_toxicity", "documents")
def op9(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Toxicity score of every text by weak supervision."""
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{root}/labels.parquet")))


@query("op1_bpe", "documents")
def op1(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Every text encoded by the token automaton and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_token_counts", "documents")
def op6(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Tokens of every text, counted by the transducer."""
    return tokencount.counted(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op8_jaccard_join", "documents")
def op8(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Components of documents whose five-word shingles are similar by 0.8 or more."""
    return jaccard.joined(docs)


@query("op2_nearest", "embeddings")
def op2(spark: SparkSession, vectors: DataFrame, root: str) -> DataFrame:
    """Ten nearest vectors found for every vector whose id is divisible by 100."""
    return ann.nearest(vectors, k=10)


# CRC-32 of an id's decimal digits before the last complement, bit by bit.
CRC_SQL = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({v}::VARCHAR) + 1),
    lambda i: ord(substr({v}::VARCHAR, i::INT, 1))::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]),
                             lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"""

MERKLE_SQL = """
WITH RECURSIVE ids AS (
  SELECT doc_id, xor({crc}, 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
), framed AS (
  SELECT d.doc_id, d.source,
         concat(coalesce(length(d.doc_id::VARCHAR) || ':' || d.doc_id, '-'),
                coalesce(octet_length(encode(source)) || ':' || source, '-'), coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
                coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front,
         text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad
  FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id
), hashed AS (
  SELECT doc_id, source, sha256(front || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(octet_length(encode(bad)) || ':' || bad, '-')) AS start
  FROM framed
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed
), inner_nodes AS (
  SELECT tree, 0 AS lvl, i, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3
  FROM inner_nodes WHERE n > 1 GROUP BY tree, lvl, i // 3, n
), outer_nodes AS (
  SELECT 0::BIGINT AS tree, 0 AS lvl, tree - 1 AS i, digest, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3
  FROM outer_nodes WHERE n > 1 GROUP BY tree, lvl, i // 3, n
), nodes AS (
  SELECT * FROM inner_nodes UNION ALL SELECT * FROM outer_nodes
), steps AS (
  SELECT a.tree, a.lvl, a.i, a.n, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.i // 3 = b.i // 3
  GROUP BY a.tree, a.lvl, a.i, a.n
), folds AS (
  SELECT tree AS leaf_tree, i AS leaf_i, tree, 0 AS lvl, i, start AS node, '' AS proof, false AS done FROM leaves
  UNION ALL
  SELECT leaf_tree, leaf_i, CASE WHEN n > 1 THEN s.tree ELSE 0 END, CASE WHEN n > 1 THEN s.lvl + 1 ELSE 0 END,
         CASE WHEN n > 1 THEN s.i // 3 ELSE s.tree - 1 END, CASE WHEN n > 1 THEN sha256(lft || node || rgt) ELSE node END,
         proof || CASE WHEN n > 1 THEN lft || rgt ELSE '' END, n = 1 AND s.tree = 0
  FROM folds JOIN steps s ON folds.tree = s.tree AND folds.lvl = s.lvl AND folds.i = s.i WHERE NOT done
)
SELECT doc_id, leaf, subroot.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256,
       node AS folded_root, node = root.digest AS verified
FROM leaves JOIN folds ON leaves.tree = leaf_tree AND leaves.i = leaf_i AND done
JOIN inner_nodes subroot ON subroot.n = 1 AND subroot.tree = leaves.tree
JOIN outer_nodes root ON root.n = 1
""".replace("{crc}", CRC_SQL.replace("{v}", "doc_id"))


@query("op12_merkle_manifest", "documents", MERKLE_SQL)
def op12(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Every document's leaf and proof in the manifest, and the root that its text with line ends deleted leads to."""
    return merkle.verified(docs, merkle.without_line_ends())


@query("op13_quality_rules", "documents")
def op13(spark: SparkSession, docs: DataFrame, root: str) -> DataFrame:
    """Counts of every text, the base rules, and the verdict by distance from the languages' histograms."""
    return rules.judge(docs, rules.fit(docs))


TRIE_SQL = """
WITH ids AS (
  SELECT conv_id, xor({crc}, 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, hash) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, sha256(concat(length(coalesce(role, '')), ':', role, text)) AS hash,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words
        FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT ids.conv_id, 0 AS own, pos, hash, words FROM ids JOIN turns b ON b.conv_id = ids.conv_id - ids.conv_id % 20 AND pos < h
  UNION ALL
  SELECT conv_id, 1, pos, hash, words FROM ids JOIN turns USING (conv_id) WHERE pos >= h
), lists AS (
  SELECT ids.conv_id, coalesce(list(hash ORDER BY own, pos) FILTER (hash IS NOT NULL), []) AS hashes,
         coalesce(list(words ORDER BY own, pos) FILTER (hash IS NOT NULL), []) AS words
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id
), members AS (
  SELECT conv_id, d, array_to_string(hashes[:d], '') AS key, array_to_string(hashes[:d - 1], '') AS above,
         coalesce(words[d], 0) AS words, len(hashes) = d AS ended
  FROM (SELECT *, unnest(range(0, len(hashes) + 1)) AS d FROM lists)
), nodes AS (
  SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM members GROUP BY d, key
), counted AS (
  SELECT a.*, b.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = a.d + 1 AND c.above = a.key) AS n_children
  FROM nodes a LEFT JOIN nodes b ON b.d = a.d - 1 AND b.key = a.above
)
SELECT a.conv_id, a.d::BIGINT AS depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256,
       count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
FROM counted a JOIN counted b ON starts_with(b.key, a.key)
GROUP BY a.conv_id, a.d, a.key, a.parent_conv_id, a.n_convs, a.n_children, a.ends_sha256
""".replace("{crc}", CRC_SQL.replace("{v}", "conv_id"))


@query("op11_prefix_trie", "conversations", TRIE_SQL)
def op11(spark: SparkSession, conversations: DataFrame, root: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: members, children, leaves, words that shared prefixes save."""
    return prefixtrie.prefix_nodes(conversations)
