"""Ranked lexical search against a plain walk over all documents and items."""

import math
from collections import Counter

import numpy as np
import pytest
import regex
from tidebook.llm import lexical, queries
from tidebook.llm.tables import read

TERM = regex.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, take=10):
    counted = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, total = len(counted), sum(length for _, _, length in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item_id, text in items:
        asked = Counter(plain_terms(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in asked if df[t]}
        scores = []
        for doc_id, c, length in counted:
            m = 25 + (75 * length * n) // total
            score = sum(k * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scores)[:take], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_terms_and_their_hashes_of_any_text():
    text = "It's ÀB-ç９ 漢字 a_b x\x00y Z" + "long" * 20 + " " + "long" * 21
    found = lexical.Terms(text.encode())
    assert [found.word(i).decode() for i in range(len(found.starts))] == plain_terms(text)
    words = sorted({t.encode() for t in plain_terms(text)})
    place, number = lexical.Lexicon(words).occurrences(found)
    assert [words[n].decode() for n in number] == plain_terms(text) and len(place) == len(found.starts)


def test_equal_hashes_are_told_apart():
    """A term whose hash is a lexicon term's counts only if its letters are the same."""
    lexicon = lexical.Lexicon([b"abc", b"twelveletters"])
    found = lexical.Terms(b"abc xyz twelveletterz twelveletters")
    found.hashes[1], found.hashes[2] = found.hashes[0], found.hashes[3]
    place, number = lexicon.occurrences(found)
    assert place.tolist() == [0, 3] and number.tolist() == [0, 1]


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(11)
    words = [f"t{i}" for i in range(300)]
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=chance / chance.sum())) for _ in range(700)]
    texts += [texts[3]] * 30 + ["T5, t5. T6!", None, "", "!!"]
    docs = list(enumerate(texts)) + [(None, texts[3]), (3, texts[3])]
    items = [(i, " ".join(rng.choice(words, 25))) for i in range(12)] + [(20, texts[3]), (21, None), (22, "nowhere"), (20, texts[3]), (None, "t1 t1 t250")]
    return (
        docs, items, spark.createDataFrame([(i, t, 9, "x") for i, t in docs], "doc_id bigint, text string, score int, terms string").repartition(5),
        spark.createDataFrame(items, "item_id bigint, text string"),
    )


def test_ranks_equal_brute_force(many, monkeypatch):
    docs, items, documents, benchmark = many
    expected = brute(docs, items)
    assert rows_of(lexical.ranked(documents, benchmark)) == expected
    # Items in several blocks, with small trees.
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "TREE_DOCUMENTS", 48)
    assert rows_of(lexical.ranked(documents, benchmark)) == expected


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    items = lexical.Items([(0, " ".join(f"r{i}" for i in range(20))), (1, " ".join(f"s{i}" for i in range(20)))])
    holding = rng.integers(1, 9, len(items.words))
    items.weigh(1000, holding)
    values = np.zeros((400, len(items.words)), np.int64)
    values[:200, :20] = rng.integers(0, 900_000, (200, 20))
    values[200:, 20:] = rng.integers(0, 900_000, (200, 20))
    tree = lexical.BallTree(values, items)
    for q in range(2):
        scores = values[:, items.terms[q]] @ items.factors[q]
        for node, rows in enumerate(tree.rows):
            assert tree.bound(node, q) >= scores[rows].max()
        best = lexical.Best()
        best.doc_ids = list(range(400))
        tree.search(q, best)
        assert [(-s, i) for s, _, i in best.kept] == sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:10]
        assert best.scored < 300


def test_long_texts_are_read_whole():
    lexicon = lexical.Lexicon([b"end", b"w"])
    text = b"w " * 3000 + b"x" * 500 + b" end"
    length, found = lexical.term_counts([b"", text, b"End"], lexicon, limit=100)
    assert length.tolist() == [0, 3002, 1]
    assert [(t.tolist(), n.tolist()) for t, n in found] == [([], []), ([0, 1], [1, 3000]), ([0], [1])]


def test_odd_documents(documents, nothing, spark):
    items = [(1, "one two x1"), (2, "漢字漢字"), (3, "")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert rows_of(lexical.ranked(documents, benchmark)) == brute(docs, items)
    assert lexical.ranked(nothing, benchmark).count() == 0
    assert lexical.ranked(documents, benchmark.filter("false")).count() == 0


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in read(spark, small, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()]
    assert rows_of(queries.op12_ball_tree(spark, small)) == brute(docs, items)


def test_query_equals_its_sql(spark, small):
    from compare import connect, duck_table, spark_table

    assert spark_table(queries.op12_ball_tree(spark, small)) == duck_table(connect(small), queries.ORACLES["op12_ball_tree"])
