"""The pipeline's stages against brute force, each on what the one before kept."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from geoweft.llm import packing, queries
from tests.llm.test_text_operators import brute_components, brute_sets, words


def corpus(rng, passages):
    """Texts of one kind of words; copies, near copies, a contaminated one, texts without letters."""
    texts = [words(rng, rng.randrange(20, 90)) for _ in range(30)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " more", " ".join(texts[2].split()[:-1])]
    texts += [f"{texts[3]} {passages[0]}", passages[1], "12345 67", "", None, "!!", texts[0]]
    return texts


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    passages = [words(rng, 30, 5000) for _ in range(3)]
    texts = corpus(rng, passages)
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    wanted = [set(left)]
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", left[i]), i)
    wanted.append(set(first.values()))
    ids = sorted(wanted[-1])
    sets = brute_sets([left[i] for i in ids])
    links = [(i, j) for i in range(len(ids)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    component = brute_components(len(ids), links)
    wanted.append({ids[c] for c in component})
    item_windows = {tuple(p.split()[k : k + 13]) for p in passages for k in range(18)}

    def hit(t):
        w = t.split()
        marked = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in item_windows for j in range(13)}
        return marked and 20 * len(marked) >= len(w)

    wanted.append({i for i in wanted[-1] if not hit(left[i])})
    assert all(a > b for a, b in zip(wanted[:-1], wanted[1:], strict=True))  # every stage has something to drop

    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        assert sorted(r.doc_id for r in got) == sorted(want), name
        assert all(r.text == texts[r.doc_id] for r in got)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokens = {r.doc_id: r.doc_tokens for r in pieces}
    assert tokens == {i: len(packing.encode(left[i], queries.tokenizer_path())) + 1 for i in wanted[-1]}
    assert sum(r.length for r in pieces) == sum(tokens.values())


def test_repeated_rows(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(2, "a b", "en", "s", 3), (3, "c", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect()) == [1, 3]


def test_rows_of_one_id_with_unlike_texts(spark, tmp_path):
    """Each row is judged for itself."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    a, b, c, passage = say(60), say(60), say(60), say(30)
    near = a.split()
    near[-1] = "edit"
    texts = [(1, a), (2, a), (2, b), (0, " ".join(near)), (3, passage), (3, c), (3, c), (4, None), (4, "12"), (None, say(50)), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = list(texts[:-1])
    for (name, stage), gone in zip(corpus_pipeline.STAGES, [[(4, None), (4, "12")], [(2, a), (3, c)], [(1, a)], [(3, passage)]], strict=False):
        docs = stage(spark, docs, str(tmp_path))
        for row in gone:
            left.remove(row)
        assert sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(repr, left)), name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_rows_without_labels_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12", None, "s", 1), (3, None, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()] == [1]


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    """Labels say the language; documents with text stay, whatever they hold."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    kept = corpus_pipeline.identify_language(spark, docs, "/root/testdata/sf0.01")
    assert kept.count() >= 0.999 * docs.count()


def test_language_stage_fills_in_labels(spark, monkeypatch):
    """Rows without a label get the language that the model finds in their text; another model gives other labels."""
    rng = random.Random(9)
    say = lambda lang: " ".join(rng.choice({"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "dos", "tres"]}[lang]) for _ in range(40))
    rows = [(i, say("xy"[i % 2] * 2), None if i % 5 == 0 else "xy"[i % 2] * 2, "s", 1) for i in range(120)]
    docs = spark.createDataFrame([*rows, (200, "12", None, "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert out == {i: "xy"[i % 2] * 2 for i in range(120)}
    real = corpus_pipeline.language_id.train
    monkeypatch.setattr(corpus_pipeline.language_id, "train", lambda rows, where: real(rows.withColumn("lang", F.translate("lang", "xy", "yx")), where=where))
    swapped = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {i for i in out if swapped[i] != out[i]} == set(range(0, 120, 5))
