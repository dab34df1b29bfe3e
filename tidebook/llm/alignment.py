"""Tokens of two vocabularies aligned over the same bytes, with corpus-wide counts of linked ids.

Tokens of both vocabularies are intervals of a text's bytes (a space and the text). All of them are sorted
by start, the running maximum of their ends is taken, and a group breaks where a start reaches it: there
both vocabularies end a token. Inside a group every token of one is linked with every token of the other.

Neither vocabulary joins bytes across a single space between two characters that are no white space (this
is checked when they are loaded), so both always break there. A text is cut at those spaces, each distinct
piece is encoded and coalesced once per worker, and a text's groups are its pieces' groups in a row.

Documents are handled in blocks of a few MB. A block tells which id pairs it links and in how many of its
documents; the sums over all blocks are the corpus-wide counts, which join back to the blocks' pairs, never
to occurrences. A frequent pair has one row a block, on the side of the join that can be split.

Texts that are null, empty, or whose bytes either vocabulary does not give back have zeros and no groups,
and count nowhere. A text of any length is aligned whole. Repeated rows are documents of their own, in the
counts as well. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.tables import narrow, wide
from tidebook.llm.token_counts import groups
from tidebook.llm.vocabulary import _byte_symbols
from tidebook.session import cut

# Text of a block; pieces a worker keeps, and the longest that is kept.
BLOCK_BYTES = 4_000_000
KEPT_PIECES = 400_000
KEPT_LENGTH = 64
# Groups with more links than this are counted by distinct ids.
WIDE_GROUP = 4096


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of A's and of B's intervals, each given in order of start."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    kind = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(a_start)], group[len(a_start) :]


def links(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked ids (group, a, b, times): one row a link, or a distinct pair of ids in wide groups."""
    n = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE_GROUP
    plain = ~wide[a_group]
    left = np.flatnonzero(plain)
    partners = n_b[a_group[left]]
    owner = np.repeat(left, partners)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(partners) - partners, partners)
    rows = [(a_group[owner], a[owner], b[first_b[a_group[owner]] + place], np.ones(len(owner), np.int64))]
    for g in np.flatnonzero(wide).tolist():
        of_a, times_a = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        of_b, times_b = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        size = len(of_a) * len(of_b)
        rows.append((np.full(size, g), np.repeat(of_a, len(of_b)), np.tile(of_b, len(of_a)), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(c) for c in zip(*rows, strict=True))


def piece_starts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie one after the other: at a text's begin and at single spaces
    between characters that are no white space. Characters that may be white space beyond ASCII count as it."""
    padded = np.concatenate([np.full(3, 32, np.uint8), raw, np.full(1, 32, np.uint8)])
    blank = (padded == 32) | ((padded >= 9) & (padded <= 13)) | ((padded >= 28) & (padded <= 31))
    at = np.flatnonzero(raw == 32)
    before, after = at + 2, at + 4
    clear = ~blank[before] & ~blank[after]
    at, before, after = at[clear], before[clear], after[clear]
    far = np.isin(padded, np.array([0xE1, 0xE2, 0xE3], np.uint8))
    near = far | (padded == 0xC2)
    odd = near[after] | (padded[before - 1] == 0xC2) | far[before - 2]
    return np.union1d(at[~odd], begins)


class Pair:
    """The two loaded vocabularies, with the aligned pieces a worker keeps."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self._check_shape(path_a)
        letters = {s: b for b, s in _byte_symbols().items()}
        names = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(letters[c] for c in name)
        self.bytes_b = [self._bytes_of_b(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.size_b = len(self.bytes_b)
        self._text_a = [[f"{i}{end}" for i in range(len(self.bytes_a))] for end in ",|"]
        self._text_b = [[f"{i}{end}" for i in range(self.size_b)] for end in ",;"]
        self._forget()

    def _check_shape(self, path_a: str) -> None:
        # The piece-wise route needs: no token of B with a space after another character, and a byte-level A.
        with open(path_a, encoding="utf-8") as file:
            shape = json.load(file)
        split = shape["pre_tokenizer"] or {}
        if shape["normalizer"] is not None or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError(f"{path_a}: not a byte-level vocabulary that splits words before single spaces")
        if any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())):
            raise ValueError("the second vocabulary has a piece that goes on across a space")

    def _bytes_of_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; -1 for bytes not given back
        self.pair_ends = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Have the tables hold every one of the pieces."""
        need = set(pieces)
        new = [p for p in need if p not in self.index]
        if len(self.index) + len(new) > KEPT_PIECES and self.index:
            self._forget()
            new = list(need)
        if not new:
            return
        ids_a = [x.ids for x in self.a.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]
        ids_b = self.b.encode([p[1:].decode() for p in new], num_threads=1)
        good = np.array([
            b"".join([self.bytes_a[i] for i in x]) == p == b"".join([self.bytes_b[i] for i in y])
            for p, x, y in zip(new, ids_a, ids_b, strict=True)
        ])
        kept = np.flatnonzero(good).tolist()
        a = np.array([i for k in kept for i in ids_a[k]], np.int64)
        b = np.array([i for k in kept for i in ids_b[k]], np.int64)
        # Pieces lie one after the other, so their tokens' ends are running sums.
        a_end, b_end = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        a_group, b_group = coalesce(a_end - self.length_a[a], a_end, b_end - self.length_b[b], b_end)
        n_groups = int(a_group[-1]) + 1 if len(a) else 0
        a_piece = np.repeat(kept, [len(ids_a[k]) for k in kept]).astype(np.int64)
        b_piece = np.repeat(kept, [len(ids_b[k]) for k in kept]).astype(np.int64)
        group_piece = np.empty(n_groups, np.int64)
        group_piece[a_group] = a_piece
        of_group, left, right, times = links(a, a_group, b, b_group)
        counts = [
            np.bincount(x, w, minlength=len(new)).astype(np.int64)
            for x, w in ((a_piece, None), (b_piece, None), (group_piece, None), (group_piece[of_group], times))
        ]
        sizes = np.stack(counts, axis=1)
        sizes[~good] = -1
        # One row for each distinct pair of a piece.
        code, owner = left * self.size_b + right, group_piece[of_group]
        order = np.lexsort((code, owner))
        code, owner, times = code[order], owner[order], times[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        times = np.add.reduceat(times, first) if len(first) else times
        ends = np.cumsum(np.bincount(owner[first], minlength=len(new)))
        # The groups as text: ids of A, a bar, ids of B, a semicolon.
        a_last, b_last = np.ones(len(a), int), np.ones(len(b), int)
        a_last[:-1], b_last[:-1] = a_group[1:] != a_group[:-1], b_group[1:] != b_group[:-1]
        shown = [self._text_a[e][i] for i, e in zip(a.tolist(), a_last.tolist(), strict=True)]
        shown += [self._text_b[e][i] for i, e in zip(b.tolist(), b_last.tolist(), strict=True)]
        kind, group = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a_group, b_group])
        order = np.lexsort((kind, group))
        piece = np.concatenate([a_piece, b_piece])[order]
        shown = [shown[i] for i in order.tolist()]
        bounds = np.searchsorted(piece, np.arange(len(new) + 1)).tolist()
        base = len(self.texts)
        self.texts += ["".join(shown[x:y])[:-1] for x, y in zip(bounds, bounds[1:], strict=False)]
        self.index.update(zip(new, range(base, base + len(new)), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pair_ends = np.concatenate([self.pair_ends, ends + self.pair_ends[-1]])
        self.pairs = np.concatenate([self.pairs, code[first]])
        self.times = np.concatenate([self.times, times])

    def forget_long(self) -> None:
        """Drop everything once long pieces have piled up."""
        if len(self.pairs) > 32 * KEPT_PIECES:
            self._forget()


def _segments(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text's stretches of about `limit` bytes, cut where pieces begin."""
    begin = 0
    while begin < len(text):
        stop = min(begin + limit, len(text))
        if stop < len(text):
            reach = limit
            while True:
                raw = np.frombuffer(text[begin : stop + reach], np.uint8)
                starts = piece_starts(raw, np.zeros(1, np.int64))
                starts = starts[(starts >= stop - begin) & (starts < len(raw) - 1)]
                if len(starts) or stop + reach >= len(text):
                    stop = begin + int(starts[0]) if len(starts) else len(text)
                    break
                reach *= 2
        yield text[begin:stop]
        begin = stop


class Block:
    """The aligned documents of one block: pieces and their pairs once, documents by their pieces."""

    def __init__(self, pair: Pair, texts: list[bytes], keep_groups: bool):
        self.pair, n = pair, len(texts)
        self.sizes = np.zeros((n, 4), np.int64)
        self.digests: list[str] = [""] * n
        self.groups: list[str | None] = ["" if keep_groups else None] * n
        owners, codes, times = [], [], []
        whole = [b" " + t if t else b"" for t in texts]
        long = [i for i, t in enumerate(whole) if len(t) > 2 * BLOCK_BYTES]
        for rows in ([i for i in range(n) if len(whole[i]) <= 2 * BLOCK_BYTES], *([i] for i in long)):
            found = self._align(rows, whole)
            if found is not None:
                for column, part in zip((owners, codes, times), found, strict=True):
                    column.append(part)
        owner, code, time = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (owners, codes, times))
        # Pairs of the block, and in how many documents each is linked.
        self.pairs, number = np.unique(code, return_inverse=True)
        self.documents = np.bincount(number, minlength=len(self.pairs))
        self.number, self.times = number, time
        self.ends = np.searchsorted(owner, np.arange(n + 1))

    def _align(self, rows: list[int], whole: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Sizes, digest and groups of some texts, and their distinct pairs as (text, pair, times)."""
        sums, hashes, shown, parts = {}, {}, {}, []
        long = len(rows) == 1 and len(whole[rows[0]]) > 2 * BLOCK_BYTES
        steps = ([(rows[0], s)] for s in _segments(whole[rows[0]], BLOCK_BYTES)) if long else [[(i, whole[i]) for i in rows]]
        for step in steps:
            text = b"".join(t for _, t in step)
            begins = np.cumsum([0, *(len(t) for _, t in step)])
            if not text:
                continue
            starts = piece_starts(np.frombuffer(text, np.uint8), begins[:-1])
            starts = starts[starts < len(text)]
            ends = [*starts[1:].tolist(), len(text)]
            pieces = [text[x:y] for x, y in zip(starts.tolist(), ends, strict=True)]
            pair = self.pair
            pair.learn(pieces)
            at = np.fromiter(map(pair.index.__getitem__, pieces), np.int64, len(pieces))
            bounds = np.searchsorted(starts, begins)
            total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(pair.sizes[at], axis=0)])
            bad = np.concatenate([[0], np.cumsum(pair.sizes[at, 0] < 0)])
            shown_at = at.tolist()
            for (i, _), x, y in zip(step, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if x == y or sums.get(i, 0) is None or bad[y] > bad[x]:
                    sums[i] = None if x < y else sums.get(i)
                    continue
                groups = ";".join(map(pair.texts.__getitem__, shown_at[x:y]))
                if i in hashes:
                    hashes[i].update(b";")
                    hashes[i].update(groups.encode())
                    sums[i] = sums[i] + total[y] - total[x]
                else:
                    hashes[i] = hashlib.sha256(groups.encode())
                    sums[i] = total[y] - total[x]
                if self.groups[i] is not None:
                    shown.setdefault(i, []).append(groups)
            # Distinct pieces of each text, then their pairs.
            owner = np.repeat(np.array([i for i, _ in step]), np.diff(bounds))
            key, n = np.unique(owner * len(pair.sizes) + at, return_counts=True)
            owner, piece = np.divmod(key, len(pair.sizes))
            low, high = pair.pair_ends[piece], pair.pair_ends[piece + 1]
            each = high - low
            place = np.arange(each.sum()) + np.repeat(low - (np.cumsum(each) - each), each)
            parts.append((np.repeat(owner, each), pair.pairs[place], pair.times[place] * np.repeat(n, each)))
            pair.forget_long()
        good = [i for i in rows if sums.get(i) is not None]
        for i in good:
            self.sizes[i] = sums[i]
            self.digests[i] = hashes[i].hexdigest()
            if self.groups[i] is not None:
                self.groups[i] = ";".join(shown[i])
        if not good or not parts:
            return None
        owner, code, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = np.isin(owner, good)
        owner, code, times = owner[keep], code[keep], times[keep]
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        return owner[first], code[first], np.add.reduceat(times, first)


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("n_pairs", pa.int64()), ("pairs", pa.binary()), ("times", pa.binary()),
    ("is_block", pa.bool_()),
])
_BLOCK_COLUMNS = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, n_pairs bigint, pairs binary, times binary, is_block boolean"


def blocks(docs: DataFrame, id_column: str, text_column: str, paths: tuple[str, str], keep_groups: bool) -> DataFrame:
    """A row for each document, with its pairs as steps between their numbers in the block and how often it
    links each, and after a block's documents a row for the block: its pairs and their document counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            doc_ids = batch.column(0).to_pylist()
            for x, y in groups(texts, BLOCK_BYTES):
                found = Block(vocabularies(*paths), texts[x:y], keep_groups)
                rows = []
                for i, doc_id in enumerate(doc_ids[x:y]):
                    low, high = found.ends[i], found.ends[i + 1]
                    steps = np.diff(found.number[low:high], prepend=0)
                    rows.append((
                        number, doc_id, *found.sizes[i].tolist(), found.digests[i], found.groups[i], int(high - low),
                        narrow(steps), narrow(found.times[low:high]), False,
                    ))
                rows.append((
                    number, None, 0, 0, 0, 0, None, None, len(found.pairs), narrow(np.diff(found.pairs, prepend=0)), narrow(found.documents), True,
                ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)
                number += 1

    columns = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    return columns.mapInArrow(run, _BLOCK_COLUMNS)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, n, pairs, documents in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block)), pa.array(np.cumsum(wide(pairs, n))), pa.array(wide(documents, n))], names=["block", "pair", "documents"]
            )


def aligned(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", paths: tuple[str, str] | None = None, keep_groups: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    n_best counts the links whose pair is, of all pairs with its A id, in the most documents; count_sum adds
    up, over the links, in how many documents their pairs are linked. `groups` is null unless kept.
    """
    spark, paths = docs.sparkSession, paths or default_paths()
    size_b = vocabularies(*paths).size_b
    found = cut(blocks(docs, id_column, text_column, paths, keep_groups), spark)
    of_block = found.filter("is_block").select("block", "n_pairs", "pairs", "times")
    in_blocks = of_block.mapInArrow(_pair_rows, "block bigint, pair bigint, documents bigint")
    totals = in_blocks.groupBy("pair").agg(F.sum("documents").alias("total"))
    # At most one row for each id of the first vocabulary.
    highest = totals.groupBy(F.floor(F.col("pair") / size_b).alias("a")).agg(F.max("total").alias("most"))
    judged = totals.withColumn("a", F.floor(F.col("pair") / size_b)).join(highest, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    known = in_blocks.select("block", "pair").join(judged, "pair")

    def sums(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.filter(pc.invert(rows["is_block"]))
        order = np.argsort(known["pair"].to_numpy())
        total = known["total"].to_numpy()[order]
        best = known["best"].to_numpy().astype(np.int64)[order]
        n_best, count_sum = [], []
        for n, steps, times in zip(rows["n_pairs"].to_pylist(), rows["pairs"].to_pylist(), rows["times"].to_pylist(), strict=True):
            at, often = np.cumsum(wide(steps, n)), wide(times, n)
            n_best.append(int(best[at] @ often))
            count_sum.append(int(total[at] @ often))
        columns = [rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table(
            [*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), rows["groups_sha256"], rows["groups"]],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"],
        )

    return found.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        sums,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string",
    )
