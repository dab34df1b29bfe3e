"""BPE encoding and decoding that reuses content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes has its leading bits zero, so a passage that
stands in many texts is cut alike in all of them. The inside of a chunk, from its first white space to
its last, is encoded once and kept under its own bytes, with its ids and nothing else. The words that
a cut goes through are left to the join: a window of the text around the cut, with a whole word of the
inside at either end, is encoded afresh, and it must begin with the ids of the one word and end with
those of the other. Where it does not, the window takes twice as many words, at last the whole text.

Decoding joins the token texts of the ids, as the library does for vocabularies without a decoder; with
a decoder the library decodes the whole row of ids.

Every task reuses the chunks its worker has met: nothing is shuffled, and a lost task is done again alike.

Nulls count as empty texts, which have no ids and an empty decoding. Texts of any length are encoded
whole. Repeated rows give repeated rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.token_counts import groups
from tidebook.llm.vocabulary import Vocabulary, default_path, vocabulary

# A cut about every 256 bytes.
CUT_BITS = 8
WINDOW = 32
# Text handled at once; a longer text is cut at white space, which no token crosses.
GROUP_BYTES = 2_000_000
# Chunks and joins that a worker keeps; beyond it the older half goes.
KEPT_CHUNKS = 300_000
KEPT_JOINS = 100_000
_SPACE = re.compile(rb"[ \t-\r]")


def _gears() -> np.ndarray:
    """One fixed pseudo-random number for each byte."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (state >> np.uint64(32)).astype(np.uint32)


with np.errstate(over="ignore"):
    _GEARS = _gears()


def cuts(raw: np.ndarray, begins: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places where texts that lie one after the other are cut; `begins` has each text's begin and the end.

    The hash at a byte is the sum of its last 32 bytes' numbers, each shifted by its distance. Cuts lie
    before characters, and none in a text's first 32 bytes, whose hash would reach into the text before.
    """
    hashes = _GEARS[raw]
    for step in (1, 2, 4, 8, 16):
        wider = hashes.copy()
        wider[step:] += hashes[:-step] << np.uint32(step)
        hashes = wider
    found = np.flatnonzero((hashes >> np.uint32(32 - bits)) == 0) + 1
    found = found[found < len(raw)]
    found = found[(raw[found] & 0xC0) != 0x80]
    begin = begins[np.searchsorted(begins, found, side="right") - 1]
    return found[found - begin >= WINDOW]


def stretches(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in stretches of about `limit` bytes that begin with white space."""
    begin = 0
    while len(text) - begin > limit:
        found = _SPACE.search(text, begin + limit)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


class Kept(dict):
    """A memo that forgets its older half when it is full."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def __missing__(self, key: bytes) -> bytes | None:
        found = self.older.get(key)
        if found is not None:
            self[key] = found
        return found

    def keep(self, key: bytes, value: bytes) -> None:
        if 2 * len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


class ChunkCoder:
    """Encoder and decoder of one vocabulary with its memos."""

    def __init__(self, known: Vocabulary, bits: int = CUT_BITS):
        self.known, self.bits = known, bits
        self.chunks, self.joins = Kept(KEPT_CHUNKS), Kept(KEPT_JOINS)
        names = known.library.get_vocab(with_added_tokens=True)
        self.names: list[str] = [""] * (max(names.values()) + 1)
        for name, number in names.items():
            self.names[number] = name
        probe = known.library.encode("An it's <|endoftext|> 12 öde", add_special_tokens=False).ids
        self.joins_names = known.library.decode(probe, skip_special_tokens=False) == " ".join(self.names[i] for i in probe)

    # ---- encoding ------------------------------------------------------------------------

    def _fresh(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of texts, each encoded by the library as it stands."""
        found = self.known.library.encode_batch([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, int]]:
        """Ids (little-endian, 32 bits) and number of chunks of each text."""
        whole = b"".join(texts)
        begins = np.cumsum([0, *map(len, texts)])
        raw = np.frombuffer(whole, np.uint8)
        if not len(raw):
            return [(b"", 0)] * len(texts)
        places = cuts(raw, begins, self.bits)
        space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
        # Chunks are the stretches between cuts and ends of texts.
        edges = np.unique(np.concatenate([places, begins]))
        low, high = edges[:-1], edges[1:]
        first, last = np.searchsorted(space, low), np.searchsorted(space, high) - 1
        spaced = first <= last
        owner = np.searchsorted(begins, low, side="right") - 1
        # Of each chunk with white space: its text, and the inside from its first to its last white space.
        first, last, owner_of = first[spaced], last[spaced], owner[spaced]
        insides = [whole[a:b] for a, b in zip(space[first].tolist(), space[last].tolist(), strict=True)]
        inside_ids = self._inside_ids(insides)
        counts = np.bincount(owner, minlength=len(texts)).tolist()
        at = np.searchsorted(owner_of, np.arange(len(texts) + 1)).tolist()
        joined = self._joins(whole, begins, space, first, last, at)
        out, join = [], 0
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if begins[i] == begins[i + 1]:
                out.append((b"", 0))
                continue
            parts, ends = inside_ids[a:b], joined[join : join + b - a + 1]
            join += b - a + 1
            if None in ends:  # no window agreed, so the whole text is encoded as it stands
                out.append((self._fresh([texts[i]])[0], counts[i]))
                continue
            row = [ends[0]]
            for inside, after in zip(parts, ends[1:], strict=True):
                row += (inside, after)
            out.append((b"".join(row), counts[i]))
        return out

    def encode_all(self, texts: list[bytes], limit: int = 4 * GROUP_BYTES) -> list[tuple[bytes, int]]:
        """encode(), with texts of more than `limit` bytes a stretch at a time."""
        if len(texts) == 1 and len(texts[0]) > limit:
            found = [self.encode([part])[0] for part in stretches(texts[0], limit)]
            return [(b"".join(ids for ids, _ in found), sum(n for _, n in found))]
        if any(len(t) > limit for t in texts):
            return [row for text in texts for row in self.encode_all([text], limit)]
        return self.encode(texts)

    def _inside_ids(self, insides: list[bytes]) -> list[bytes]:
        kept = self.chunks
        found = [kept[x] for x in insides]
        new = list({x for x, ids in zip(insides, found, strict=True) if ids is None})
        if new:
            made = dict(zip(new, map(self.known.ids, new), strict=True))
            for x, ids in made.items():
                kept.keep(x, ids)
            found = [made[x] if ids is None else ids for x, ids in zip(insides, found, strict=True)]
        return found

    def _joins(
        self, whole: bytes, begins: np.ndarray, space: np.ndarray, first: np.ndarray, last: np.ndarray, at: list[int]
    ) -> list[bytes | None]:
        """Ids between the insides, text by text: before the first, between neighbours, after the last."""
        spans = []  # number of the white space before and after each join (None: the text's end), and its text
        for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            if begins[i] < begins[i + 1]:
                lefts, rights = [None, *last[a:b].tolist()], [*first[a:b].tolist(), None]
                spans += [(i, k - 1 + a, left, right, k + a) for k, (left, right) in enumerate(zip(lefts, rights, strict=True))]
        out: list[bytes | None] = [None] * len(spans)
        places, starts, firsts, lasts = space.tolist(), begins.tolist(), first.tolist(), last.tolist()
        open_spans, words = list(range(len(spans))), 1
        while open_spans:
            windows, still = {}, []
            for n in open_spans:
                i, before, left, right, after = spans[n]
                # The window reaches `words` words into the insides, no farther than they go.
                from_space = None if left is None else max(left - words, firsts[before])
                to_space = None if right is None else min(right + words, lasts[after])
                a = starts[i] if from_space is None else places[from_space]
                b = starts[i + 1] if to_space is None else places[to_space]
                lead = b"" if left is None else whole[a : places[left]]
                trail = b"" if right is None else whole[places[right] : b]
                ends = (left is None or from_space == firsts[before]) and (right is None or to_space == lasts[after])
                windows[n] = (whole[a:b], lead, trail, ends)
            missing = list({w for w, *_ in windows.values() if self.joins[w] is None})
            made = dict(zip(missing, self._fresh(missing), strict=True))
            for n, (window, lead, trail, ends) in windows.items():
                ids = made.get(window) or self.joins[window] or b""
                before, after = self.known.ids(lead), self.known.ids(trail)
                if len(ids) >= len(before) + len(after) and ids.startswith(before) and ids.endswith(after):
                    out[n] = ids[len(before) : len(ids) - len(after)]
                elif not ends:
                    still.append(n)
            for window, ids in made.items():
                if len(window) < 256:
                    self.joins.keep(window, ids)
            open_spans, words = still, 2 * words
        return out

    # ---- decoding ------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.joins_names:
            return " ".join(map(self.names.__getitem__, numbers))
        return self.known.library.decode(numbers, skip_special_tokens=False)


@lru_cache(maxsize=2)
def _coder(path: str, bits: int) -> ChunkCoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ChunkCoder(vocabulary(path), bits)


def coded(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, bits: int = CUT_BITS,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian, 32 bits each), decoded and n_chunks."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, bits)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts, GROUP_BYTES):
                found = coder.encode_all(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                        pa.array([ids for ids, _ in found], pa.binary()),
                        pa.array([coder.decode(ids) for ids, _ in found], pa.string()),
                        pa.array([n for _, n in found], pa.int64()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded", "n_chunks"],
                )

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, decoded string, n_chunks bigint"
    )
