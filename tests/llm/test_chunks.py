"""Chunk reuse against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidebook.llm import chunks, queries, vocabulary
from tidebook.llm.tables import read


@pytest.fixture(scope="module")
def known():
    return vocabulary.vocabulary(vocabulary.default_path())


def expected(known, text):
    ids = known.library.encode(text, add_special_tokens=False).ids
    return ids, known.library.decode(ids, skip_special_tokens=False)


def check(known, coder, texts):
    found = coder.encode([t.encode() for t in texts])
    for text, (ids, _) in zip(texts, found, strict=True):
        numbers, decoded = expected(known, text)
        assert np.frombuffer(ids, "<u4").tolist() == numbers
        assert coder.decode(ids) == decoded


@given(st.lists(st.text(alphabet="aB 'sé́ \n漢 <|endoftext|>9.", max_size=200), max_size=6))
@settings(max_examples=60, deadline=None)
def test_any_text_cut_often(texts):
    known = vocabulary.vocabulary(vocabulary.default_path())
    check(known, chunks.ChunkCoder(known, bits=2), texts)


def test_long_texts_without_white_space(known):
    check(known, chunks.ChunkCoder(known, bits=4), ["long" * 30_000, "漢字" * 5_000, "x " * 40_000, "", "\n" * 9000])


def test_stretches_of_long_texts(known):
    coder = chunks.ChunkCoder(known, bits=3)
    texts = ["one two  three it's <|endoftext|>x " * 60, "", "no" * 300, "short text", "\n\n" + "a b " * 90]
    found = coder.encode_all([t.encode() for t in texts], limit=100)
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in found] == [expected(known, t)[0] for t in texts]
    assert b"".join(chunks.stretches(texts[0].encode(), 64)).decode() == texts[0]


def test_passages_are_cut_alike_and_encoded_once(known):
    rng = np.random.default_rng(2)
    passage = " ".join(f"w{i}" for i in rng.integers(0, 5000, 2000))
    texts = [(f"lead {i} " * (i + 5) + passage).encode() for i in range(20)]
    coder = chunks.ChunkCoder(known)
    sizes = [n for _, n in coder.encode(texts)]
    assert sum(sizes) > 20 * 30 and len(coder.chunks) < 2 * max(sizes)


def test_windows_widen_until_they_agree(known):
    """An inside whose kept ids are wrong never agrees with a window, so the whole text is encoded."""
    text = " ".join(f"word{i % 50} and" for i in range(400))
    coder = chunks.ChunkCoder(known, bits=6)
    windows = []
    fresh = coder._fresh
    coder._fresh = lambda pieces: windows.extend(pieces) or fresh(pieces)
    ids = known.ids

    class Other(type(known)):
        pass

    other = object.__new__(Other)
    other.__dict__ = dict(known.__dict__)
    other.ids = lambda text: b"" if not text.strip() else b"\1\0\0\0" + ids(text)
    coder.known = other
    found = coder.encode([text.encode()])[0][0]
    assert np.frombuffer(found, "<u4").tolist() == expected(known, text)[0]
    assert text.encode() in windows and len({len(w) for w in windows}) > 3


def test_odd_documents(documents, nothing, known):
    rows = chunks.coded(documents).collect()
    texts = documents.select("doc_id", "text").collect()
    assert sorted(((r.doc_id is None, r.doc_id, bytes(r.ids), r.decoded) for r in rows), key=str) == sorted(
        ((i is None, i, np.array(expected(known, t or "")[0], "<u4").tobytes(), expected(known, t or "")[1]) for i, t in texts), key=str
    )
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert chunks.coded(nothing).count() == 0


def test_query_equals_the_library(spark, small, known):
    texts = {r.doc_id: r.text for r in read(spark, small, "documents").select("doc_id", "text").collect()}
    rows = queries.op11_chunk_reuse(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, decoded = expected(known, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
