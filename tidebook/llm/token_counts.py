"""Token counts at every prefix, and what follows from them without encoding again.

Nulls count as empty texts. Empty texts have no tokens and an empty table. Repeated rows give
repeated rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.vocabulary import default_path, vocabulary

TOKEN_LIMIT = 2048  # the query's limit
# Texts are handled in groups of about so many bytes, whatever the batch size.
GROUP_BYTES = 8_000_000


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def prefix_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and prefix_steps.

    prefix_steps holds, for each character of the text, by how much it changes the exact token
    count of the text so far, as one signed byte. Its running sum is the count at every prefix;
    a new character changes it by less than the longest token's length, so a byte is enough.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in groups(texts):
                known.learn_steps(texts[a:b])
                steps = [known.steps(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                        pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64()),
                        pa.array(steps, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
                )

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, prefix_steps binary"
    )


def tokens_at(steps: bytes, characters: int) -> int:
    """Exact token count of the text's first characters."""
    return int(np.frombuffer(steps, np.int8)[: max(characters, 0)].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Most leading characters whose own token count is within the budget."""
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return 0 if budget < 0 or not len(fits) else int(fits[-1]) + 1


def truncate(docs: DataFrame, counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, text cut to the longest prefix of at most `budget` tokens, its token count.

    `counted` is prefix_counts of the same documents with distinct ids; nothing is encoded again.
    """
    rows = docs.select("doc_id", F.col("text")).join(counted.select("doc_id", "prefix_steps"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, steps in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keep = longest_prefix(steps, budget)
                out.append((doc_id, (text or "")[:keep], tokens_at(steps, keep)))
            ids, texts, counts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                names=["doc_id", "text", "n_tokens"],
            )

    return rows.mapInArrow(run, "doc_id bigint, text string, n_tokens bigint")
