"""Exact token ids and prefix counts of a public vocabulary, looked up piece by piece.

A text is cut at ASCII white space. The vocabularies used here never join text across white
space, so a text's ids are its pieces' ids in a row, and each distinct piece is encoded once per
worker. Ids always come from the tokenizers library.
"""

from __future__ import annotations

import re
import sys
from array import array
from codecs import charmap_decode
from functools import lru_cache
from operator import sub

import numpy as np

# Entries a worker keeps between batches; beyond it only the newest batch's pieces stay.
MEMO_ENTRIES = 500_000
FRAGMENT_ENTRIES = 500_000
# Longer pieces are not kept, and their prefix counts come from the table over last tokens.
LONG_PIECE = 48
_ASCII_SPACE = re.compile(rb"[ \t-\r]")
# Letters whose normal form and lower case are one letter each, then at most one mark.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> dict[int, str]:
    """The printable symbol that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Pieces(dict):
    """Ids of pieces, made when a piece is first asked for. trim() holds it to MEMO_ENTRIES; pieces not asked for since the trim before go."""

    def __init__(self, made):
        super().__init__()
        self.made, self.older = made, {}

    def __missing__(self, piece: bytes) -> bytes:
        found = self.older.get(piece)
        found = self[piece] = self.made(piece) if found is None else found
        return found

    def trim(self) -> None:
        if len(self) > MEMO_ENTRIES // 2:
            self.older = {k: v for k, v in self.items() if len(k) <= LONG_PIECE}
            self.clear()


class Vocabulary:
    """One loaded tokenizer file with its memos."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.symbols = _byte_symbols()
        self._to_symbols = str.maketrans({chr(b): s for b, s in self.symbols.items()})
        self.ids_of = Pieces(self.encode)
        self._marks = {"": b""}
        self._byte_symbols = "".join(self.symbols[b] for b in range(256))
        self._lower = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
        self._id_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size() + 1)]
        self.steps_of: dict[bytes, bytes] = {}
        self._fragments: dict[str, int] = {}
        self._check_shape()

    def _check_shape(self) -> None:
        # The piece-wise route needs: pieces independent of white space, and word ends marked.
        probe = "Le cœur, it's 12 öde\tWORDS.\n\nx"
        whole = self.library.encode(probe, add_special_tokens=False).ids
        parts = [i for p in probe.split() for i in self.library.encode(p, add_special_tokens=False).ids]
        if whole != parts or self.model.end_of_word_suffix != "</w>":
            raise ValueError(f"{self.path}: not a vocabulary that drops white space and marks word ends")

    # ---- ids -----------------------------------------------------------------------------

    def _letters(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._to_symbols)

    def encode(self, piece: bytes) -> bytes:
        """Little-endian 32-bit ids of a piece."""
        text = piece.decode("utf-8", "replace")
        plain = _PLAIN.fullmatch(text)
        if plain is None:
            ids = array("I", self.library.encode(text, add_special_tokens=False).ids)
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()
        mark = plain[2]
        # In UTF-8 each byte of these letters has one lower case.
        word = (piece[:-1] if mark else piece).translate(self._lower)
        found = self._marks.get(mark)
        if found is None:
            found = self._marks[mark] = b"".join(self._id_bytes[t.id] for t in self.model.tokenize(mark))
        if word != piece and (kept := self.ids_of.get(word) or self.ids_of.older.get(word)):
            return kept + found
        known = self._id_bytes
        return b"".join([known[t.id] for t in self.model.tokenize(charmap_decode(word, "strict", self._byte_symbols)[0])]) + found

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a text; it is split once, and its new pieces are encoded on the way."""
        self.ids_of.trim()
        return b"".join(map(self.ids_of.__getitem__, text.split()))

    # ---- prefix counts -------------------------------------------------------------------

    def learn_steps(self, texts: list[bytes]) -> None:
        """Have steps_of hold every piece's change of the token count, one signed byte a character."""
        need: set[bytes] = set()
        for text in texts:
            for line in _ASCII_SPACE.sub(b" ", text).split(b" "):
                need.add(line)
        missing = need.difference(self.steps_of)
        if len(self.steps_of) + len(missing) > MEMO_ENTRIES:
            self.steps_of = {k: v for k, v in self.steps_of.items() if k in need and len(k) <= LONG_PIECE}
        if len(self._fragments) > FRAGMENT_ENTRIES:
            self._fragments = {}
        for piece in missing:
            counts = self._prefix_counts(piece.decode("utf-8", "replace"))
            self.steps_of[piece] = array("b", map(sub, counts, [0, *counts])).tobytes()

    def steps(self, text: bytes) -> bytes:
        return b"\0".join(map(self.steps_of.__getitem__, _ASCII_SPACE.sub(b" ", text).split(b" ")))

    def _word_counts(self, word: str) -> list[int]:
        """Counts of a word's prefixes, each as if the text ended there; words share most of them."""
        known, counts = self._fragments, []
        for k in range(1, len(word) + 1):
            fragment = word[:k]
            found = known.get(fragment)
            if found is None:
                found = known[fragment] = len(self.model.tokenize(self._letters(fragment)))
            counts.append(found)
        return counts

    def _prefix_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ...: the count at the last word start, plus the open word's."""
        plain = _PLAIN.fullmatch(piece)
        if plain and len(piece) <= LONG_PIECE:
            counts = self._word_counts(plain[1].lower())
            return [*counts, counts[-1] + 1] if plain[2] else counts
        if len(piece) <= LONG_PIECE:
            return [len(self.library.encode(piece[:k], add_special_tokens=False).ids) for k in range(1, len(piece) + 1)]
        return self._long_counts(piece)

    def _long_counts(self, piece: str) -> list[int]:
        found = self.library.encode(piece, add_special_tokens=False)
        starts, before = [], []
        for i, (word, (start, _)) in enumerate(zip(found.word_ids, found.offsets, strict=True)):
            # An added token has no word; it stands for itself.
            if word is None or i == 0 or word != found.word_ids[i - 1]:
                if not starts or start > starts[-1]:
                    starts.append(start)
                    before.append(i)
        if not starts or starts[0] > 0:
            starts, before = [0, *starts], [0, *before]
        counts: list[int] = []
        for start, end, base in zip(starts, [*starts[1:], len(piece)], before, strict=True):
            word = piece[start:end]
            if len(word) <= LONG_PIECE:
                inner = [len(self.library.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]
            else:
                inner = self._table_counts(word)
            counts += [base + c for c in inner]
        return counts

    def _table_counts(self, word: str) -> list[int]:
        """Counts of a long word's prefixes by dynamic programming over last tokens.

        The encoding of a prefix is the encoding of a shorter prefix and one last token, and a
        row of tokens is an encoding exactly if each neighbouring pair encodes as itself. So
        each prefix looks for the one last token that agrees with the prefix before it.
        """
        marks = [self.library.normalizer.normalize_str(c) for c in word]
        if "".join(marks) != self.library.normalizer.normalize_str(word):
            return [len(self.library.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]
        text = [self._letters(m) for m in marks]
        ends = np.cumsum([len(t) for t in text]).tolist()
        row, size = "".join(text), self.longest_token
        last: list[str] = [""]
        count = [0]
        for end in range(1, len(row) + 1):
            for start in range(max(0, end - size), end):
                token = row[start:end]
                if self._joins(last[start], token):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        counts = []
        for end in ends:
            if end == 0:
                counts.append(0)
                continue
            for start in range(max(0, end - size), end):
                if self._closes(last[start], row[start:end]):
                    counts.append(count[start] + 1)
                    break
        return counts

    @property
    def longest_token(self) -> int:
        return _longest(self.path)

    def _joins(self, before: str, token: str) -> bool:
        return _open_pair(self.path, before, token)

    def _closes(self, before: str, token: str) -> bool:
        return _closed_pair(self.path, before, token)


@lru_cache(maxsize=4)
def _longest(path: str) -> int:
    return max(len(t.removesuffix("</w>")) for t in vocabulary(path).library.get_vocab())


@lru_cache(maxsize=4)
def _open_model(path: str):
    """The same merges without a mark at the end, for words that go on."""
    import json

    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return BPE(vocab=model["vocab"], merges=merges)


@lru_cache(maxsize=200_000)
def _open_pair(path: str, before: str, token: str) -> bool:
    found = [t.value for t in _open_model(path).tokenize(before + token)]
    return found == ([before, token] if before else [token])


@lru_cache(maxsize=200_000)
def _closed_pair(path: str, before: str, token: str) -> bool:
    found = [t.value for t in vocabulary(path).model.tokenize(before + token)]
    return found == ([before, token + "</w>"] if before else [token + "</w>"])
