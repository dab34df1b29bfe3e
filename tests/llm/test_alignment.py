"""Token alignment against a plain walk over the byte offsets of whole texts."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from tidebook.llm import alignment, queries
from tidebook.llm.tables import read

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def pair():
    return alignment.vocabularies(*alignment.default_paths())


def plain_groups(pair, text):
    """Groups ([A ids], [B ids]) of a whole text, None where the bytes are not given back."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return None
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        end_a, end_b = end_a + len(pair.bytes_a[a[i]]), end_b + len(pair.bytes_b[b[j]])
        i, j = i + 1, j + 1
        while end_a != end_b:
            if end_a < end_b:
                left.append(a[i])
                end_a += len(pair.bytes_a[a[i]])
                i += 1
            else:
                right.append(b[j])
                end_b += len(pair.bytes_b[b[j]])
                j += 1
        out.append((left, right))
    return out


def brute(pair, texts):
    found, holds = [], Counter()
    for text in texts:
        groups = plain_groups(pair, text) or []
        linked = Counter((x, y) for left, right in groups for x in left for y in right)
        holds.update(linked.keys())
        found.append((groups, linked))
    most = Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    rows = []
    for groups, linked in found:
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if holds[p] == most[p[0]]), sum(n * holds[p] for p, n in linked.items()),
            hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return rows


ODD = [
    None, "", " ", "  a  b", "a b ", "\n\nx y\n z", "one two three　four  five", "▁ under a", "<|endoftext|> <s> x<unk> </s>",
    "漢字 と かな é́ ñandú ¿qué? á", "\x00 nul \x7f", "\x1c a \x1f b", "tab\t a", "it's we'll I'D 12 345,67", "\u0085 a \u0085b", "🙂🙃 x 🙂",
    "long" * 3000, "a " * 2000, " " * 500 + "x", "x" + "\n" * 300 + "y", "word  two   three    four",
]


def test_pieces_of_odd_texts(spark, pair):
    rng = np.random.default_rng(7)
    letters = list("aB '\n\t漢é▁ s.,<|>1  ") + [" "] * 8
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(400)] + ODD
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    rows = {r.doc_id: r for r in alignment.aligned(docs, keep_groups=True).collect()}
    assert len(rows) == len(texts)
    for i, expected in enumerate(brute(pair, texts)):
        assert (*(rows[i][c] for c in COLUMNS), rows[i].groups_sha256) == expected, texts[i]
        assert rows[i].groups_sha256 == (hashlib.sha256(rows[i].groups.encode()).hexdigest() if rows[i].groups else "")


def test_texts_longer_than_a_block(pair, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50)
    texts = ["some words of a text, twice. " * 40, "ab" * 200, " x", "a  b\n" * 100, None, "漢字 x" * 60]
    block = alignment.Block(pair, [(t or "").encode() for t in texts], True)
    for i, row in enumerate(brute(pair, texts)):
        assert tuple(block.sizes[i]) == row[:4] and block.digests[i] == row[6]


def test_wide_groups_count_by_distinct_ids(monkeypatch):
    a, b = np.array([5, 6, 5, 7]), np.array([1, 1, 2])
    groups = np.array([0, 0, 0, 1]), np.array([0, 0, 1])
    plain = alignment.links(a, groups[0], b, groups[1])
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    wide = alignment.links(a, groups[0], b, groups[1])

    def table(rows):
        out = Counter()
        for g, x, y, n in zip(*map(np.ndarray.tolist, rows), strict=True):
            out[g, x, y] += n
        return out

    assert table(plain) == table(wide) == {(0, 5, 1): 4, (0, 6, 1): 2, (1, 7, 2): 1}


def test_odd_documents(documents, nothing, pair):
    rows = alignment.aligned(documents).collect()
    texts = documents.select("doc_id", "text").collect()
    expected = [(t.doc_id, *row) for t, row in zip(texts, brute(pair, [t.text for t in texts]), strict=True)]
    assert sorted(((r.doc_id, *(r[c] for c in COLUMNS), r.groups_sha256) for r in rows), key=str) == sorted(expected, key=str)
    assert alignment.aligned(nothing).count() == 0


def test_query_equals_brute_force(spark, small, pair):
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in queries.op13_token_alignment(spark, small).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, expected in zip(texts, brute(pair, texts.values()), strict=True):
        assert (*(rows[doc_id][c] for c in COLUMNS), rows[doc_id].groups_sha256) == expected
