"""Vector bin packing of tokenised documents into training sequences.

Each sequence has three limits at once: tokens, segments and loss-bearing tokens. Every task packs
the documents of its own partition, so nothing is shuffled and a lost task is packed again alike.

Nulls count as empty texts; an empty document is its end token alone. Texts of any length are cut.
Repeated rows are packed each. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.token_counts import groups
from tidebook.llm.vocabulary import default_path, vocabulary

END_TOKEN = 1


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


@dataclass
class Item:
    """A stretch of one document: which, from where, its ids, and how many lead tokens bear no loss."""

    doc_id: int | None
    start: int
    ids: bytes
    quiet: int
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return self.length - self.quiet

    def head_within(self, tokens: int, loss: int) -> int:
        """Most leading tokens that stay within both limits."""
        return min(self.length, tokens, self.quiet + loss)

    def cut(self, tokens: int) -> tuple[Item, Item]:
        quiet = min(self.quiet, tokens)
        return (
            Item(self.doc_id, self.start, self.ids[: 4 * tokens], quiet, self.doc_tokens),
            Item(self.doc_id, self.start + tokens, self.ids[4 * tokens :], self.quiet - quiet, self.doc_tokens),
        )


class Packer:
    """Fills one sequence after the other from a bounded pool of open items.

    The next item is the one that fits and whose demand has the largest dot product with what the
    sequence has left, each limit counted in shares. When none fits, the longest item is cut.
    """

    def __init__(self, limits: Limits, pool: int = 1024):
        self.limits, self.pool = limits, pool
        self._caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self._demand = np.zeros((2 * pool, 3))
        self._items: list[Item] = []

    def add(self, item: Item) -> Iterator[list[Item]]:
        while item.length:
            size = item.head_within(self.limits.tokens, self.limits.loss_tokens)
            if size == self.limits.tokens:
                full, item = item.cut(size)
                yield [full]
                continue
            part, item = item.cut(size)
            self._put(part)
        while len(self._items) > self.pool:
            yield self._fill()

    def finish(self) -> Iterator[list[Item]]:
        while self._items:
            yield self._fill()

    def _put(self, item: Item) -> None:
        if len(self._items) == len(self._demand):
            self._demand = np.concatenate([self._demand, np.zeros_like(self._demand)])
        self._demand[len(self._items)] = item.length, 1, item.loss
        self._items.append(item)

    def _take(self, i: int) -> Item:
        item, last = self._items[i], self._items.pop()
        if i < len(self._items):
            self._items[i] = last
            self._demand[i] = self._demand[len(self._items)]
        return item

    def _fill(self) -> list[Item]:
        left, placed = self._caps.copy(), []
        while self._items and left[0] > 0 and left[1] > 0:
            demand = self._demand[: len(self._items)]
            worth = demand @ (left / self._caps**2)
            # Column by column: a reduction over rows of three costs several times the comparisons.
            over = demand > left
            worth[over[:, 0] | over[:, 1] | over[:, 2]] = -1
            best = int(worth.argmax())
            if worth[best] < 0:
                best = int(demand[:, 0].argmax())
                size = self._items[best].head_within(int(left[0]), int(left[2]))
                if size == 0:
                    break
                item, rest = self._take(best).cut(size)
                self._put(rest)
            else:
                item = self._take(best)
            placed.append(item)
            left -= (item.length, 1, item.loss)
        return placed


def powers_of_two(placed: list[Item], capacity: int) -> Iterator[list[Item]]:
    """A short sequence, cut into ones of power-of-two lengths, which need no padding."""
    total = sum(i.length for i in placed)
    if total == capacity:
        yield placed
        return
    rest = list(placed)
    for bit in reversed(range(total.bit_length())):
        need, out = total & 1 << bit, []
        while need:
            item = rest.pop(0)
            if item.length > need:
                item, after = item.cut(need)
                rest.insert(0, after)
            out.append(item)
            need -= item.length
        if out:
            yield out


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prompt_column: str | None = None,
    limits: Limits = Limits(), end_token: int = END_TOKEN, path: str | None = None,
) -> DataFrame:
    """Pieces of documents in sequences.

    A document's tokens are those of its prompt (if a column is named; they bear no loss), of its
    text, and the end token. A task's last sequence, which its documents do not fill, is cut into
    power-of-two lengths. Columns: doc_id, start, length, ids (little-endian 32-bit), ids_crc32,
    loss_tokens, doc_tokens, sequence_id, offset. Sequence ids are unique, not gapless.
    """
    path = path or default_path()
    end = np.array([end_token], "<u4").tobytes()
    prompt = F.col(prompt_column) if prompt_column else F.lit(None).cast("string")

    def rows(first_id: int, sequences: Iterator[list[Item]]) -> tuple[list[tuple], int]:
        out = []
        for items in sequences:
            offset = 0
            for i in items:
                out.append((i.doc_id, i.start, i.length, i.ids, zlib.crc32(i.ids), i.loss, i.doc_tokens, first_id, offset))
                offset += i.length
            first_id += 1
        return out, first_id

    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
        ("loss_tokens", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = vocabulary(path), Packer(limits)
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids, texts, prompts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in groups([t or b"" for t in texts]):
                done: list[list[Item]] = []
                for doc_id, text, lead in zip(doc_ids[a:b], texts[a:b], prompts[a:b], strict=True):
                    quiet = known.ids(lead) if lead else b""
                    ids = quiet + (known.ids(text) if text else b"") + end
                    done.extend(packer.add(Item(doc_id, 0, ids, len(quiet) // 4, len(ids) // 4)))
                found, next_id = rows(next_id, iter(done))
                yield batch_of(found)
        tails = (short for placed in packer.finish() for short in powers_of_two(placed, limits.tokens))
        yield batch_of(rows(next_id, tails)[0])

    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text"), prompt.cast("binary").alias("prompt")
    ).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, loss_tokens bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
