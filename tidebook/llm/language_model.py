"""A log-bilinear language model over word classes, trained with noise-contrastive estimation in numpy.

The most frequent words are classes of their own; all others share classes by their endings. A context
vector, the sum of the last classes' vectors weighted by position, scores every class by a dot product, and
a soft maximum over all classes, made for whole batches as matrix products, normalises it. Inside a class a
word has its discounted relative frequency; what the discounts free is the share of unseen words, which
together are one type, as in the base model.

Counts cover all training texts. Every task trains on all of its texts with shared noise samples, starting
alike, and the tasks' parameters are averaged by tokens. Frequent words travel to the tasks in a table of
bounded size; the others meet their counts in a join.

Nulls count as empty texts, whose only token is the end. Rows with null ids are learned from. Repeated rows
count each. Without training texts all classes are alike. Extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.session import cut

END = b"\n"  # no word holds white space
OWN, ENDINGS = 192, 64  # classes of one word, classes by ending
CLASSES = OWN + ENDINGS
FREQUENT = 150_000  # words whose counts tasks hold in memory, at most
WIDTH, CONTEXT = 16, 3
BATCH, NOISE, RATE = 2048, 64, 0.1
FLUSH = 400_000  # words a task counts before it hands them on
SLICE = 512  # tokens scored at once: their scores of all classes stay in a core's cache


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def ending_class(word: bytes) -> int:
    """Class of a word by its last bytes, and whether a mark follows them."""
    bare = word.rstrip(b".,;:!?")
    return OWN + 2 * (zlib.crc32(bare[-3:]) % (ENDINGS // 2)) + (len(bare) < len(word))


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n, ending: how often each token occurs, pre-counted by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([counts[w] for w in words], pa.int64()), pa.array([ending_class(w) for w in words], pa.int32())],
                names=["token", "n", "ending"],
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or b"").lower().split())
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield told()
                    counts.clear()
        yield told()

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "token binary, n bigint, ending int")
    return rows.groupBy("token").agg(F.sum("n").alias("n"), F.first("ending").alias("ending"))


def looked_up(table: dict[bytes, int], held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' values, -1 for those outside the table, and where these stand."""
    ids = np.fromiter(map(table.get, held, repeat(-1)), np.int64, len(held))
    return ids, np.flatnonzero(ids < 0)


class Words:
    """Counts of the frequent words and statistics of the classes; of bounded size."""

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.total, self.types = totals["n"] or 0, totals["v"] or 0
        # The lowest frequency class from which on the words fit; a top-k sort would send k words per task.
        level = F.floor(16 * F.log2(F.col("n"))).cast("int")
        held, least = 0, None
        for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
            held += r["count"]
            if held > FREQUENT:
                break
            least = r["level"]
        frequent = counts.filter(level >= least).select("token", "n").collect() if least is not None else []
        self.count = {bytes(r["token"]): r["n"] for r in sorted(frequent, key=lambda r: (-r["n"], r["token"]))}
        own = list(self.count)[:OWN]
        self.own = {w: i for i, w in enumerate(own)}
        rest = counts.join(counts.sparkSession.createDataFrame([(w,) for w in own], "token binary"), "token", "left_anti") if own else counts
        self.mass, self.kinds, once, twice = (np.zeros(CLASSES, np.int64) for _ in range(4))
        stats = rest.groupBy("ending").agg(
            F.sum("n").alias("mass"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
        )
        for r in stats.collect():
            k = r["ending"]
            self.mass[k], self.kinds[k], once[k], twice[k] = r["mass"], r["kinds"], r["once"], r["twice"]
        for w, i in self.own.items():
            self.mass[i] = self.count[w]
        self.discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)

    def class_of(self, word: bytes) -> int:
        found = self.own.get(word)
        return ending_class(word) if found is None else found

    def within(self, count: int, k: int) -> float:
        """log10 of a word's probability inside its class; a count of 0 stands for all unseen words of the class."""
        if k < OWN or self.mass[k] == 0:
            return 0.0
        share = count - self.discount[k] if count else self.discount[k] * self.kinds[k]
        return float(np.log10(share / self.mass[k]))

    def base(self, count: int) -> float:
        return float(np.log10((count + 1) / (self.total + self.types + 1)))

    def noise(self) -> np.ndarray:
        p = (self.mass + 1.0) / (self.mass.sum() + CLASSES)
        return p / p.sum()


class Model:
    """Context vectors, position weights, class vectors and biases."""

    SHAPES = ((CLASSES + 1, WIDTH), (CONTEXT, WIDTH), (CLASSES, WIDTH), (CLASSES,))

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(29)
        # One more context class stands before the first token.
        self.context = rng.normal(0, 0.3, self.SHAPES[0]).astype(np.float32)
        self.position = np.ones(self.SHAPES[1], np.float32)
        self.target = rng.normal(0, 0.05, self.SHAPES[2]).astype(np.float32)
        self.bias = np.log(noise).astype(np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.position, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for part in self.parts():
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        return self

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Context vectors (batch x width) from the classes before each token (batch x CONTEXT)."""
        weighted = self.context * self.position[:, None]
        out = weighted[0].take(before[:, 0], axis=0)
        for c in range(1, CONTEXT):
            out += weighted[c].take(before[:, c], axis=0)
        return out

    def log_probabilities(self, before: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Natural log of the normalised probability of each class."""
        context, bias = self.predicted(before), self.bias[:, None]
        out = np.empty(len(classes))
        for at in range(0, len(classes), SLICE):
            some = classes[at : at + SLICE]
            scores = self.target @ context[at : at + SLICE].T  # classes x tokens, so that maxima and sums run along whole rows
            scores += bias
            value = scores[some, np.arange(len(some))].astype(np.float64)
            top = scores.max(axis=0)
            scores -= top
            np.exp(scores, out=scores)
            out[at : at + SLICE] = value - top - np.log(scores.sum(axis=0, dtype=np.float64))
        return out


class Trainer:
    """Noise-contrastive estimation with noise samples shared in a batch, steps scaled by past gradients."""

    def __init__(self, model: Model, noise: np.ndarray):
        self.model, self.noise = model, noise
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.rng = np.random.default_rng(31)
        self.past = [np.full(p.shape, 1e-6, np.float32) for p in model.parts()]

    def step(self, before: np.ndarray, classes: np.ndarray) -> None:
        m, size = self.model, len(classes)
        sampled = self.rng.choice(CLASSES, NOISE, p=self.noise)
        vectors, own = m.context[before], m.target[classes]
        q = np.einsum("bcw,cw->bw", vectors, m.position)
        real = (q * own).sum(axis=1) + m.bias[classes] - self.log_noise[classes]
        false = q @ m.target[sampled].T
        false += m.bias[sampled]
        false -= self.log_noise[sampled]
        up = 1 - 1 / (1 + np.exp(-np.clip(real, -30, 30)))
        np.negative(np.clip(false, -30, 30, out=false), out=false)
        np.exp(false, out=false)
        false += 1
        down = np.divide(-1, false, out=false)
        dq = up[:, None] * own + down @ m.target[sampled]
        target = _summed(classes, up[:, None] * q, CLASSES)
        np.add.at(target, sampled, down.T @ q)
        bias = np.bincount(classes, up, CLASSES) + np.bincount(sampled, down.sum(axis=0), CLASSES)
        position = np.einsum("bw,bcw->cw", dq, vectors)
        context = _summed(before.ravel(), (dq[:, None, :] * m.position[None]).reshape(-1, WIDTH), CLASSES + 1)
        for part, past, gradient in zip(m.parts(), self.past, (context, position, target, bias), strict=True):
            gradient = (gradient / size).astype(np.float32)
            past += gradient**2
            part += RATE * gradient / np.sqrt(past)


_PLACES = np.arange((CLASSES + 1) * WIDTH).reshape(-1, WIDTH)


def _summed(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    at = _PLACES.take(rows, axis=0).ravel()
    return np.bincount(at, values.ravel(), size * WIDTH).reshape(size, WIDTH)


def contexts(classes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token, newest first; CLASSES before a text's first."""
    place = np.arange(len(classes)) - np.repeat(begins[:-1], np.diff(begins))
    out = np.full((len(classes), CONTEXT), CLASSES, np.int64)
    for c in range(CONTEXT):
        has = np.flatnonzero(place > c)
        out[has, c] = classes[has - c - 1]
    return out


def _batches(texts: Iterator[list[bytes]]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Token lists put together to about 16 batches of tokens, with where each text begins."""
    held: list[bytes] = []
    begins = [0]
    for words in texts:
        held += words
        begins.append(len(held))
        if len(held) > 16 * BATCH:
            yield held, np.array(begins)
            held, begins = [], [0]
    if held:
        yield held, np.array(begins)


def train(docs: DataFrame, words: Words) -> Model:
    noise = words.noise()
    table = {w: words.class_of(w) for w in words.count}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(noise)
        trainer, seen = Trainer(model, noise), 0
        texts = (tokens(t or b"") for batch in batches for t in batch.column(0).to_pylist())
        order = np.random.default_rng(37)
        for held, begins in _batches(texts):
            classes, rare = looked_up(table, held)
            classes[rare] = [ending_class(held[i]) for i in rare.tolist()]
            before = contexts(classes, begins)
            mixed = order.permutation(len(classes))
            for at in range(0, len(mixed), BATCH):
                pick = mixed[at : at + BATCH]
                trainer.step(before[pick], classes[pick])
            seen += len(classes)
        sums = np.append(model.flat() * seen, seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["part", "sums"]
        )

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "sums": [sum(np.frombuffer(s) for s in group["sums"]).tobytes()]})

    made = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, sums binary")
    rows = made.groupBy("part").applyInPandas(add, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect()
    model = Model(noise)
    total = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(len(model.flat()) + 1))
    return model.load(total[:-1] / total[-1]) if total[-1] else model


def training(doc_id: Column) -> Column:
    """Rows that are learned from: crc32 of the id as text does not leave 2 modulo 7."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the texts' probabilities)."""
    spark = docs.sparkSession
    learned = docs.filter(training(F.col("doc_id").cast("bigint")))
    counts = cut(token_counts(learned), spark)
    words = Words(counts)
    model = train(learned, words)
    known = {w: (words.class_of(w), words.base(n), words.within(n, words.class_of(w))) for w, n in words.count.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: i for i, w in enumerate(known)}
        klass = np.array([v[0] for v in known.values()] + [0], np.int64)
        base = np.array([v[1] for v in known.values()] + [0.0])
        inner = np.array([v[2] for v in known.values()] + [0.0])
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            at = 0
            for held, begins in _batches(tokens(t or b"") for t in batch.column(1).to_pylist()):
                ids, rare = looked_up(table, held)
                classes = klass[ids]
                rare_words = [held[i] for i in rare.tolist()]
                classes[rare] = [ending_class(w) for w in rare_words]
                before = contexts(classes, begins)
                value = inner[ids]
                for i in range(0, len(ids), BATCH):
                    value[i : i + BATCH] += model.log_probabilities(before[i : i + BATCH], classes[i : i + BATCH]) / np.log(10)
                count = len(begins) - 1
                # A text's words outside the table, each once with how often it occurs.
                lone: list[tuple[bytes, int, int]] = []
                offsets = [0]
                for i, j in pairwise(np.searchsorted(rare, begins).tolist()):
                    lone += ((w, ending_class(w), times) for w, times in Counter(rare_words[i:j]).items())
                    offsets.append(len(lone))
                lone_words, endings, times = zip(*lone, strict=True) if lone else ((), (), ())
                offsets = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(uid, uid + count), pa.int64()), pa.array(doc_ids[at : at + count], pa.int64()), pa.array(np.diff(begins)),
                        pa.array(np.add.reduceat((ids >= 0).astype(np.int64), begins[:-1])), pa.array(np.add.reduceat(base[ids], begins[:-1])),
                        pa.array(np.add.reduceat(value, begins[:-1])), *(pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((lone_words, pa.binary()), (endings, pa.int32()), (times, pa.int64()))),
                    ],
                    names=["uid", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "endings", "times"],
                )
                uid += count
                at += count

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = cut(rows.mapInArrow(run, "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<binary>, endings array<int>, times array<bigint>"), spark)
    # Words outside the table are rare, so none of them is a hot key.
    lone = parts.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("endings").alias("ending"), "times")))
    stat = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("ending") + 1)
    n = F.coalesce("n", F.lit(0))
    met = lone.join(counts.select("token", "n"), "token", "left").withColumns({"mass": stat(words.mass), "kinds": stat(words.kinds), "discount": stat(words.discount)})
    share = F.when(n > 0, n - F.col("discount")).otherwise(F.col("discount") * F.col("kinds"))
    summed = met.groupBy("uid").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(words.total + words.types + 1)))).alias("more_base"),
        F.sum(F.when(F.col("mass") > 0, F.col("times") * F.log10(share / F.col("mass"))).otherwise(0.0)).alias("more_score"),
    )
    return parts.drop("rare", "endings", "times").join(summed, "uid", "left").select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
