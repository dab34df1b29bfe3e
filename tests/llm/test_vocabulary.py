"""Ids on demand: as the library gives them, each piece encoded once while it is kept."""

from array import array

import numpy as np

from tidebook.llm import vocabulary


def test_new_pieces_are_encoded_once_on_the_way(monkeypatch):
    known = vocabulary.Vocabulary(vocabulary.default_path())
    asked = []
    known.ids_of.made = lambda piece: asked.append(piece) or known.encode(piece)
    text = "École, école l'été ×÷ ß! Ÿ ÿ. a.. 漢字 <|endoftext|> École,\tx�".encode() + b" \xc3 a\xc3\xa9\xc3"
    pieces = text.split()
    whole = [i for p in pieces for i in known.library.encode(p.decode("utf-8", "replace"), add_special_tokens=False).ids]
    for _ in range(2):
        assert np.frombuffer(known.ids(text), "<u4").tolist() == whole
    assert sorted(asked) == sorted(set(pieces))
    assert known.encode(b"Chat!") == array("I", known.library.encode("Chat!", add_special_tokens=False).ids).tobytes()
    monkeypatch.setattr(vocabulary, "MEMO_ENTRIES", 100)
    for i in range(40):
        known.ids(" ".join(f"w{i}x{k}" for k in range(20)).encode() + b" often")
    assert len(known.ids_of) + len(known.ids_of.older) < 160
    assert asked.count(b"often") == 1
