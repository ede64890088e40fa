"""The prefix trie, the Merkle manifest and the quality rules against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from datasheaf.llm import merkle, prefixtrie, rules
from datasheaf.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Prefix trie.

def rebuild(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}", text), text))
    by = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in by.items()}
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = by.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute_trie(rows):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in rebuild(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    sha(",".join(map(str, sorted(ends.get(p, [])))))))
    return Counter(out)


def odd_turns(seed):
    r, rows = random.Random(seed), []
    for c in range(100):
        for t in range(r.choice([0, 1, 2, 3, 5, 9, 14, 30])):
            turn = r.choice([t, t, t, None]) if seed else t
            rows.append((c, turn, None if r.random() < 0.05 else "user", r.choice(["a b", "c", None]) if r.random() < 0.25 else "x y z"))
    return rows + [(None, 1, "user", "q"), (5000, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x")]


@pytest.mark.parametrize("seed,chunk,fan_in,rows_at_once", [(0, 4, 3, 7), (1, 256, 64, 4096), (2, 2, 2, 3)])
def test_trie(spark, monkeypatch, seed, chunk, fan_in, rows_at_once):
    monkeypatch.setattr(prefixtrie, "FAN_IN", fan_in)
    monkeypatch.setattr(prefixtrie, "ROWS", rows_at_once)
    rows = odd_turns(seed)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("node", "parent", "pos", "words", "a.b")})
    got = Counter(map(tuple, prefixtrie.prefix_nodes(df, chunk=chunk).collect()))
    assert got == brute_trie(rows)


def contracted(depths, lengths, cut, rng):
    """Nodes of rows with given lengths and shared depths, by way of forests of `cut` rows."""
    def forest(i):
        p = prefixtrie.Part(lengths[i], f"end {i}", lengths[i], 1, i, i, lengths[i], 0, 0, "", 0)
        return prefixtrie.Forest([p], [], None, None)

    def put_together(forests, joints, final, out):
        parts, edges = [], []
        for k, f in enumerate(forests):
            if k:
                edges.append(prefixtrie.Edge(joints[k - 1], f"at {joints[k - 1]}", joints[k - 1]))
            parts += f.parts
            edges += f.edges
        parts, edges = prefixtrie.contract(parts, edges, 0, out, final)
        return prefixtrie.Forest(parts, edges, None, None)

    out, blocks, joints = [], [], []
    for at in range(0, len(lengths), cut):
        end = min(at + cut, len(lengths))
        blocks.append(put_together([forest(i) for i in range(at, end)], depths[at:end - 1], False, out))
        assert len(blocks[-1].parts) <= 2 * (max(lengths) + 1)
        joints.append(depths[end - 1] if end < len(lengths) else None)
    put_together(blocks, joints, True, out)
    return Counter((n["depth"], n["parent_depth"], n["least"], n["count"], n["leaves"], n["saved"]) for n in out)


@pytest.mark.parametrize("seed", range(20))
def test_forests_do_not_depend_on_the_cut(seed):
    r = random.Random(seed)
    words = sorted("".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(60))
    shared = [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
              for a, b in zip(words, words[1:], strict=False)]
    lengths = [len(w) for w in words]
    whole = contracted(shared, lengths, len(words), r)
    assert all(contracted(shared, lengths, cut, r) == whole for cut in (1, 2, 7, 30))
    nodes = Counter(w[:d] for w in words for d in range(len(w) + 1))
    assert sum(d - p for d, p, *_ in whole.elements()) == len(nodes)


def test_trie_without_turns(spark):
    assert prefixtrie.prefix_nodes(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixtrie.prefix_nodes(spark.createDataFrame([(None, 0, "user", "a")], TURNS)).count() == 0
    lone = prefixtrie.prefix_nodes(spark.createDataFrame([(40, None, None, None)], TURNS)).collect()
    assert Counter(map(tuple, lone)) == brute_trie([(40, None, None, None)])


# Merkle manifest.

def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, fanout=3):
    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            first = i // fanout * fanout
            yield level[first:i], level[i + 1:first + fanout]
            i //= fanout

    by = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        front = "".join(map(field, (doc_id, source, lang, n)))
        bad = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            bad = text.replace("\n", "")
        by[source].append((doc_id is not None, doc_id or 0, sha(front + field(text)), sha(front + field(bad)), doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([t[2] for t in sorted(by[s])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, node, doc_id) in enumerate(sorted(by[s])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            for left, right in path:
                node = sha(*left, node, *right)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha(*[d for a, b in path for d in a + b]), node, node == top[-1][0]))
    return Counter(out)


def odd_documents(seed, n):
    r = random.Random(seed)
    rows = [(i, f"line {i}\nline {r.random()}" if r.random() < 0.8 else r.choice([None, "", "\n"]), r.choice(["en", None]),
             "hot" if r.random() < 0.4 else r.choice(["a", "é", "", "Z", None]), r.choice([3, None])) for i in range(n)]
    return rows + rows[:3] + [(None, "t\n", "en", "a", 1), (None, None, None, None, None), (7, "other", None, "alone", 1)]


@pytest.mark.parametrize("n,fanout", [(0, 3), (40, 3), (150, 2), (150, 5)])
def test_manifest(spark, n, fanout):
    rows = odd_documents(n, n)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("tree", "lo", "kids", "path", "digest", "a.b")})
    got = merkle.verified(df, merkle.without_line_ends(), fanout).collect()
    assert Counter(map(tuple, got)) == brute_manifest(rows, fanout)


def test_manifest_of_few(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.verified(none).count() == 0 and merkle.Manifest(none).root is None
    one = merkle.verified(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha()


def test_intervals_nest(spark):
    nodes = merkle.Manifest(spark.createDataFrame(odd_documents(1, 100), DOCS)).labelled().collect()
    by = {(n.tree, n.level, n.lo): n for n in nodes}
    for n in nodes:
        inside = [m for m in nodes if m.tree == n.tree and m.level == n.level - 1 and n.lo <= m.lo and m.hi <= n.hi]
        if n.level:
            assert n.digest == sha(*[m.digest for m in sorted(inside, key=lambda m: m.lo)]) and 1 <= len(inside) <= 3
    assert len(by) == len(nodes)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(50)], DOCS)
    changed = F.when(F.col("doc_id") == 17, F.lit("text 18")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.verified(docs, changed).filter("NOT verified").collect()] == [17]


# Quality rules.

def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside), failed


def js(p, q):
    """Jensen-Shannon distance of two dicts of counts."""
    a, b = ({k: v / sum(x.values()) for k, v in x.items()} for x in (p, q))
    m = {k: (a.get(k, 0) + b.get(k, 0)) / 2 for k in {*a, *b}}
    kl = lambda x: sum(v * np.log2(v / m[k]) for k, v in x.items() if v)
    return max(0.0, (kl(a) + kl(b)) / 2) ** 0.5


def brute_kept(docs):
    def classes(text):
        return Counter(rules.CLASSES[rules.class_table()[ord(c)]] for c in text if c not in " \t\n\x0b\x0c\r")

    def plain(text):
        return Counter(w.strip(rules.PUNCTUATION.decode()) for w in WORD.findall(text.lower()))

    by = defaultdict(lambda: (Counter(), Counter()))
    for d in docs:
        if d.lang is not None:
            by[d.lang][0].update(classes(d.text or ""))
            by[d.lang][1].update(plain(d.text or ""))
    kept = {}
    for d in docs:
        text, near = d.text or "", not by
        for chars, words in by.values():
            common = sorted(words, key=lambda w: (-words[w], w.encode()))[:rules.COMMON_WORDS]
            fold = lambda c: Counter({w: c[w] for w in common}) + Counter({None: sum(v for w, v in c.items() if w not in common)})  # noqa: E731, B023
            own, here = classes(text), plain(text)
            by_class = js(own, chars) if own else 0
            by_word = js(fold(here), fold(words)) if here else 0
            near |= ((by_class <= rules.CLASS_LIMIT or sum(own.values()) < rules.CLASS_LEAST)
                     and (by_word <= rules.WORD_LIMIT or sum(here.values()) < rules.WORD_LEAST))
        kept[d.doc_id] = near and not brute_base(text)[-1]
    return kept


def test_rules_on_a_table(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op13_quality_rules"](spark, ROOT).collect()}
    kept = brute_kept(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(d.text)
        assert r.kept == kept[d.doc_id]
    assert len(got) == len(docs) and 0 < sum(kept.values()) < len(docs)


def test_rules_keep_good_documents_and_find_junk(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    rows = QUERIES["op13_quality_rules"](spark, root).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(junk) < 0.1


def test_rules_edges(spark):
    texts = [None, "", " \n\t", "a b c a b c", "one\ntwo\none\n\n\none", "日本 " * 60, "a\x1cb\xa0c d", "x#*|<> &% $", "w " * 200_000,
             " ".join(f"w{i}" for i in range(300)), "a b", "a b"]
    rows = [(i if i else None, t, None if i % 2 else "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n_words", "kind", "item", "n", "rank", "a.b")})
    got = Counter(tuple(r)[:-1] for r in rules.judge(df, rules.fit(df)).collect())
    assert got == Counter((i, *brute_base(t)) for i, t, *_ in rows)
    none = spark.createDataFrame([], DOCS)
    assert rules.fit(none).languages == [] and rules.judge(none, rules.fit(none)).count() == 0
    unnamed = df.withColumn("lang", F.lit(None).cast("string"))
    assert all(r.kept != r.base_failed for r in rules.judge(unnamed, rules.fit(unnamed)).collect())


def test_distance_is_a_distance():
    p, q = np.array([1.0, 0, 0]), np.array([0, 0.5, 0.5])
    assert rules.distance(p, q) == 1 and rules.distance(p, p) == 0
    a, b = np.array([3.0, 1, 4]) / 8, np.array([2.0, 2, 1]) / 5
    assert rules.distance(a, b) == pytest.approx(js(dict(enumerate(a)), dict(enumerate(b))))


@pytest.mark.parametrize("name,table", [("op11_prefix_trie", "conversations"), ("op12_merkle_manifest", "documents")])
def test_sql_of_new_queries(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    assert compare(QUERIES[name](spark, ROOT), con, ORACLES[name])[0] is None
