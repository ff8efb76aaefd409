"""Line dedup, manifest and ranked search against brute force: nulls, empty and long texts, ties, repeats, empty and wide tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.llm import lexical, lines, merkle, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- line dedup ---


def random_keys(n, seed=0):
    return np.frombuffer(np.random.default_rng(seed).bytes(16 * n), "V16")


@pytest.mark.parametrize("room", [20_000, 9_000])
def test_cuckoo_filter_loses_nothing_and_forgets_all(room):
    keys = random_keys(20_000)
    cuckoo = lines.Cuckoo.sized(room)
    cuckoo.put(keys)
    asked = lambda k: lines.Filters([cuckoo.row(0)], 1).may_hold(k)
    assert asked(keys).all() and asked(random_keys(100_000, 1)).mean() < 1e-3
    cuckoo.take(keys[:15_000])
    assert asked(keys[15_000:]).all() and asked(keys[:15_000]).mean() < 1e-3
    cuckoo.take(keys[15_000:])
    assert not cuckoo.slots.any() and not len(cuckoo.stash) and cuckoo.held == 0


def test_overfull_cuckoo_filter_uses_its_stash():
    keys = random_keys(100)
    cuckoo = lines.Cuckoo(np.zeros((4, 4), np.uint16), np.zeros(0, np.int64), 0)
    cuckoo.put(keys)
    assert len(cuckoo.stash) >= 84 and lines.Filters([cuckoo.row(0)], 1).may_hold(keys).all()
    cuckoo.take(keys)
    assert not cuckoo.slots.any() and not len(cuckoo.stash)


def line_brute(index, docs, min_docs, min_chars=1):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    held = Counter(k for _, t in index for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = "\n".join(x for x in own if held[key(x)] < min_docs)
        out.append((i, len(own), sum(held[key(x)] >= min_docs for x in own), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def line_docs(rng, start, n):
    known = [f"Line {i} É" for i in range(60)] + ["", "  ", "\t\x0b", "a" * 100_000]
    line = lambda: rng.choice(["", " "]) + rng.choice([str.upper, str.lower, str])(rng.choice(known)) + rng.choice(["", " \r"])
    return [(start + i, None if i % 37 == 0 else "\n".join(line() for _ in range(rng.randrange(9)))) for i in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_index_is_reversible(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_FILTERS", 0)
        monkeypatch.setattr(lines, "GROUP_ROWS", 20)
    rng = random.Random(2)
    one = line_docs(rng, 0, 120) + [(5, "x")] * 3 + [(None, "line 1 é")] * 12
    two = line_docs(rng, 200, 100)
    df = lambda rows: spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, shard int, key string")
    index = lines.create(spark, keys=3 * lines.SHARD_KEYS).insert(df(one))
    assert got(index.apply(df(one), indexed=True)) == line_brute(one, one, 10)
    before, index = index, index.insert(df(two))
    both = one + two
    assert got(index.apply(df(both))) == line_brute(both, both, 10)
    gone = [i for i, _ in one if i is None or i > 20] + [99_999]
    index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [x for x in one if x[0] not in gone] + two
    assert got(index.apply(df(both))) == line_brute(left, both, 10)
    assert got(before.apply(df(one))) == line_brute(one, one, 10)  # earlier versions stay readable
    index = index.compact().insert(df(one[30:40]))
    assert got(index.apply(df(both))) == line_brute(left + one[30:40], both, 10)
    index = index.delete(df(both))
    assert index.counts().isEmpty() and index.documents().isEmpty() and {r.held for r in index.filters().collect()} == {0}
    assert got(index.apply(df(one))) == line_brute([], one, 10)


def test_filters_grow_with_their_shard(spark):
    index = lines.create(spark, min_docs=1)
    rows = [(i, f"line {i}") for i in range(400)]
    for a, b in ((0, 3), (3, 400)):
        index = index.insert(spark.createDataFrame(rows[a:b], "doc_id long, text string"))
    assert {r.held for r in index.filters().collect()} == {400}
    assert all(r.n_dropped == 1 for r in index.apply(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_line_limits_and_empty_table(spark):
    rows = [(i, "é\nab\n\nlong line") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(lines.drop_common_lines(docs, min_docs=3, min_chars=2)) == line_brute(rows, rows, 3, 2)
    assert got(lines.drop_common_lines(docs, min_docs=4)) == line_brute(rows, rows, 4)
    assert lines.drop_common_lines(docs.limit(0)).isEmpty()


# --- manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root and each leaf's siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            b = p // 3 * 3
            paths[i] += [x for j, x in enumerate(nodes[b : b + 3]) if j != p - b]
            at[i] = p // 3
        nodes = [sha(*nodes[b : b + 3]) for b in range(0, len(nodes), 3)]
    return nodes[0], paths


def merkle_brute(rows):
    encoded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha(*map(encoded, r[:5]))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s])]) for s in order]
    root, tops = tree([t[0] for t in trees])
    out = [(i if has else None, leaf, sub, root, sha(*p, *top)) for s, (sub, paths), top in zip(order, trees, tops) for (has, i, leaf), p in zip(sorted(groups[s]), paths)]
    return root, sorted(out, key=repr)


@pytest.mark.parametrize("n, per_task, step", [(1, 10, 2), (7, 3, 1), (400, 20, 2), (300, 1000, 9)])
def test_merkle_manifest(spark, monkeypatch, n, per_task, step):
    monkeypatch.setattr(merkle, "LEAVES_PER_TASK", per_task)
    monkeypatch.setattr(merkle, "STEP", step)
    rng = random.Random(n)
    sources = [None, "a", "b", "é", "z", ""] + [f"s{k}" for k in range(15)] + ["a"] * 15
    rows = [(rng.choice([None, i, i, i, i]), rng.choice(sources), rng.choice([None, "en"]), i, rng.choice([None, "", f"t é {i}\n", "x" * 100_000]), 1, "l") for i in range(n)]
    rows += rows[:1] * 9 if n > 10 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, part int, leaf string")
    manifest = merkle.build(docs)
    found = merkle.proofs(manifest, chains=True).collect()
    root, expected = merkle_brute(rows)
    assert manifest.root == root and sorted((tuple(r)[:5] for r in found), key=repr) == expected
    assert all(r.verified and r.folded_root == root and merkle.fold(bytes.fromhex(r.leaf), bytes(r.chain)).hex() == root for r in found)
    assert (len(manifest.frontiers) > 1) == (n > per_task)


def test_merkle_finds_what_was_changed(spark):
    rows = [(i, "ab"[i % 2], "en", 3, f"t\n{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    claimed = merkle.leaf_digest([F.when((F.col("doc_id") % 3 == 0) & (F.lit(f) == "text"), F.lit("t0")).otherwise(F.col(f).cast("string")) for f in merkle.FIELDS])
    assert {r.doc_id for r in merkle.proofs(merkle.build(docs, claimed=claimed)).collect() if not r.verified} == set(range(0, 50, 3))
    empty = merkle.build(docs.limit(0))
    assert empty.root is None and merkle.proofs(empty).isEmpty()


# --- ranked search ---


def search_brute(docs, items, k):
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    total = sum(bool(c) for _, c in counted)
    terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c in counted:
            if c:
                m = 10 + 90 * sum(c.values()) * total // terms
                score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in asked if c[x])
                scored += [(-score, i is None, i)] if score > 0 else []
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    known = [f"w{i}" for i in range(300)] + ["É", "ß日本"]
    odds = [1 / (i + 1) for i in range(len(known))]
    docs = [(i, rng.choice([None, "", " ;"]) if i % 50 == 0 else " ".join(rng.choices(known, odds, k=rng.randrange(1, 150)))) for i in range(500)]
    docs += [docs[1]] * 5 + [(None, docs[2][1]), (900, "w1 W2-" * 40_000)] + [(10**6 + i, docs[3][1]) for i in range(30)]
    items = [(i, " ".join(rng.choices(known, k=rng.randrange(1, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, docs[7][1]), (93, "w0")]
    return docs, items


@pytest.mark.parametrize("sizes, block, first, broadcast", [({}, 1 << 16, 1 << 12, 1 << 18), ({"shard_docs": 17}, 64, 16, 0), ({"shard_terms": 900}, 1 << 16, 64, 1 << 18)])
def test_ranked_search(spark, monkeypatch, corpus, sizes, block, first, broadcast):
    for name, value in (("BLOCK_TERMS", block), ("FIRST_POSTINGS", first), ("BROADCAST_TERMS", broadcast)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, shard int, term string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items + items[:2]], "item_id long, text string, rank int")
    index = lexical.build_index(table, **sizes)
    assert got(lexical.search(index, asked)) == search_brute(docs, items, 10)
    if not sizes:
        assert got(lexical.search(index, asked, k=3)) == search_brute(docs, items, 3)
        assert lexical.search(index, asked.limit(0)).isEmpty() and lexical.ranked(table.limit(0), asked).isEmpty()


def test_lists_are_left_when_bounds_prove_the_best():
    """A shard whose best documents are clear: the frequent term's low impacts are read for few documents only."""
    rng = np.random.default_rng(1)
    frequent = np.arange(20_000, dtype=np.uint16)
    lists = [(5000, np.array([900_000], np.int32), np.array([12], np.uint16), frequent[:12]), (10, np.sort(rng.choice(10_000, 20, False))[::-1].astype(np.int32), np.full(20, 1000, np.uint16), rng.permutation(frequent))]
    score = np.zeros(20_000, np.int64)
    for w, impacts, sizes, docs in lists:
        score[docs] += np.repeat(w * impacts.astype(np.int64), sizes)
    order = np.lexsort((np.arange(20_000), -score))[:10]
    assert lexical.best(lists, np.arange(20_000), 10) == [(int(d), int(score[d])) for d in order]


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_merkle_manifest", "op13_ranked_search"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = queries.queries()[name](spark, folder)
    columns = sorted(found.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert got(found.select(*columns)) == sorted(expected, key=repr)
