"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts, full-width forms and digits or
signs used as letters become plain letters, invisible characters go, punctuation becomes blanks. Marks that
are letters as often as punctuation are letters inside a word, blanks at its end; if a word so read has no
hit, it is read as words apart. An
Aho-Corasick automaton then finds every lexicon entry (a word beginning) and every exception phrase in
one pass. Hits inside an exception phrase do not count. The weights found are normalised by length.

Nulls and empty texts have no hits. Ties between labels of one document go to 0. Repeated rows are
scored each. Without toxic training rows the lexicon is empty and every score is 0. Only the named
columns are read, so extra ones, whatever their names, change nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.tables import values

# Labelled rows that a lexicon is fitted on, at most; which ones depends on the ids' hashes.
TRAINING_ROWS = 20_000
CANDIDATES = 50_000  # word beginnings weighed at most, the most frequent in toxic texts
LEXICON = 5_000
PURITY = 0.8  # least share of toxic texts among the training texts that have an entry
EXCEPTIONS = 1_000
STEM_LETTERS = range(3, 13)
FLUSH = 1 << 16  # entries a task counts before it hands them on

# Letters of other scripts and signs that look like Latin letters, in the order of the letters.
_LOOKALIKES = {
    "a": "аα@4", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еεє3", "g": "ɡ", "h": "һ", "i": "іιı1|!¡", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "п", "o": "оο0", "p": "рρ", "s": "ѕ5$", "t": "тτ7+", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ",
}
_INVISIBLE = "­​‌‍⁠﻿"
# Signs at the end of a word are punctuation more often than letters; before a letter or digit they are letters.
_MARKS = "!|+"
_LETTERS = str.maketrans({x: letter for letter, alike in _LOOKALIKES.items() for x in alike if x in _MARKS})
_MARK = re.compile(r"[!|+]")
_ENDS = re.compile(r"[!|+]+(?!\S)")
_MASKED = re.compile(r"\S*[!|+]\S*")


class _Folding(dict):
    """Translation table, filled as characters appear."""

    def __init__(self):
        super().__init__({ord(x): letter for letter, alike in _LOOKALIKES.items() for x in alike})
        self.update({ord(x): None for x in _INVISIBLE})
        self.update({ord(x): x for x in _MARKS})  # read by their place in the word later

    def __missing__(self, code: int) -> str:
        char = unicodedata.normalize("NFKC", chr(code)).lower()
        folded = "".join(super(_Folding, self).get(ord(c), c) or "" for c in char)
        self[code] = folded if all(c.isalnum() or c in _MARKS or unicodedata.combining(c) for c in folded) else " "
        return self[code]


_FOLDING = _Folding()


def fold(text: str | None, automaton=None, longest: int = 0) -> str:
    """The folded text between blanks, as one line of words; with an automaton, masked words without a hit fall apart."""
    plain = (text or "").lower().translate(_FOLDING)
    if any(x in plain for x in _MARKS):
        plain = _ENDS.sub(" ", plain)
        plain = plain.translate(_LETTERS) if automaton is None else _MASKED.sub(lambda word: _read(word[0], automaton, longest), plain)
    return f" {' '.join(plain.split())} "


def _read(word: str, automaton, longest: int) -> str:
    """A word with marks inside: they are letters where that makes a hit, and blanks elsewhere."""
    out, at = [], 0
    while at < len(word):
        # Entries are word beginnings, so nothing beyond the longest one matters.
        found = hits(f" {word[at : at + longest].translate(_LETTERS)} ", automaton)
        if not found and word[at] in _MARKS:
            at += 1
            continue
        mark = _MARK.search(word, at + found[0][1] - 1 if found else at)
        end = mark.start() if mark else len(word)
        out.append(word[at:end].translate(_LETTERS))
        at = end
    return f" {' '.join(out)} "


@dataclass
class Lexicon:
    """Weights of word beginnings, exception phrases (whole folded words), and the length-normalised scale."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    # log-odds = bias + by_weight * log1p(weight) + by_share * log1p(weight per 100 words)
    bias: float = -4.0
    by_weight: float = 1.0
    by_share: float = 1.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(f" {stem}", (len(stem), weight))
        for phrase in self.exceptions:
            found.add_word(f" {' '.join(phrase.split())} ", (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, weight: float, words: int) -> float:
        if not self.weights:
            return 0.0
        odds = self.bias + self.by_weight * math.log1p(weight) + self.by_share * math.log1p(100 * weight / max(words, 1))
        return 1 / (1 + math.exp(-max(min(odds, 700.0), -700.0)))


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """Hits (start, end, weight) outside exception phrases; of one word's hits only the longest."""
    if not len(automaton):
        return []
    found: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        if weight is None:
            free.append((end - size, end))
        else:
            start = end - size + 1
            if start not in found or found[start][0] < end + 1:
                found[start] = (end + 1, weight)
    return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in free)]


def stems(folded: str) -> set[str]:
    return {word[:k] for word in set(folded.split()) for k in STEM_LETTERS if k <= len(word)}


def _counted(rows: DataFrame, make) -> DataFrame:
    """Sums of (entry, toxic, clean) that `make(folded text)` yields for each training row, pre-summed by about FLUSH entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            entries = list(sums[0].keys() | sums[1].keys())
            columns = [pa.array(entries, pa.string()), *(pa.array([sums[k][e] for e in entries], pa.int64()) for k in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, names=["entry", "in_toxic", "in_clean"])

        for batch in batches:
            for text, toxic in zip(values(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                sums[toxic].update(make(fold(text)))
                if len(sums[0]) + len(sums[1]) > FLUSH:
                    yield told()
                    for counts in sums:
                        counts.clear()
        yield told()

    return (
        rows.mapInArrow(run, "entry string, in_toxic bigint, in_clean bigint")
        .groupBy("entry").agg(F.sum("in_toxic").alias("in_toxic"), F.sum("in_clean").alias("in_clean"))
    )


def training_rows(docs: DataFrame, labels: DataFrame, keep, max_rows: int = TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most about `max_rows` labelled documents for which `keep(doc_id)` holds."""
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("toxic") > 0.5).cast("int").alias("toxic"))
    )
    total = known.count()
    if total > max_rows:
        share = max_rows / total
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    # At most about max_rows narrow rows, hence the broadcast.
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def learn(rows: DataFrame) -> Lexicon:
    """Fit a lexicon on labelled (text, toxic) rows; what reaches the driver is bounded by the parameters above."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon({})
    frequent = (
        _counted(rows.filter("toxic = 1"), stems).filter("in_toxic > 1")
        .orderBy(F.desc("in_toxic"), "entry").limit(CANDIDATES).collect()
    )
    candidates = {r["entry"]: r["in_toxic"] for r in frequent}
    wanted = frozenset(candidates)
    in_clean = {r["entry"]: r["in_clean"] for r in _counted(rows.filter("toxic = 0"), lambda text: stems(text) & wanted).collect()}
    weights = _weights(candidates, in_clean, toxic, clean)
    return _calibrated(rows, Lexicon(weights))


def _weights(in_toxic: dict[str, int], in_clean: dict[str, int], toxic: int, clean: int) -> dict[str, float]:
    """Smoothed log-odds of the beginnings that mark toxic texts beyond chance, each as long as it can be."""
    share = toxic / (toxic + clean)
    # So large that among all candidates hardly one passes by chance.
    bar = 2 * math.log(10 * max(len(in_toxic), 1))
    kept: dict[str, float] = {}
    for stem, hit in in_toxic.items():
        miss = in_clean.get(stem, 0)
        both = hit + miss
        if hit / both < max(share, PURITY):
            continue
        surprise = 2 * (hit * math.log(hit / (both * share)) + (miss * math.log(miss / (both * (1 - share))) if miss else 0.0))
        if surprise >= bar or share == 1:
            kept[stem] = math.log((hit + 0.5) / (toxic + 1)) - math.log((miss + 0.5) / (clean + 1))
    longer: dict[str, int] = {}
    for stem in kept:
        longer[stem[:-1]] = max(longer.get(stem[:-1], 0), in_toxic[stem])
    closed = {s: w for s, w in kept.items() if w > 0 and longer.get(s, 0) < 0.9 * in_toxic[s]}
    best = sorted(closed, key=lambda s: (-in_toxic[s] * closed[s], s))[:LEXICON]
    return {s: closed[s] for s in best}


def _phrases(folded: str, automaton) -> Iterable[str]:
    """Each hit's word with the word before it, and with the one after it."""
    for start, end, _ in hits(folded, automaton):
        right = folded.index(" ", end)
        before, after = folded[:start].split()[-1:], folded[right:].split(maxsplit=1)[:1]
        word = folded[start:right]
        yield from ([f"{before[0]} {word}"] if before else []) + ([f"{word} {after[0]}"] if after else [])


def _calibrated(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Exceptions (phrases with hits that only clean texts have, twice or more) and the scale."""
    def phrases(text, cache=[]):  # noqa: B006  one automaton per worker
        if not cache:
            cache.append(lexicon.automaton())
        return _phrases(text, cache[0])

    common = _counted(rows, phrases).filter("in_toxic = 0 and in_clean > 1").orderBy(F.desc("in_clean"), "entry").limit(EXCEPTIONS)
    lexicon.exceptions = [r["entry"] for r in common.collect()]
    # Two numbers of each of at most TRAINING_ROWS rows, already counted into cells.
    cells = measured(rows, lexicon, ["toxic"]).groupBy("toxic", F.round("weight", 1).alias("weight"), "words").count().collect()
    y = np.array([c["toxic"] for c in cells], float)
    n = np.array([c["count"] for c in cells], float)
    weight = np.array([c["weight"] for c in cells])
    words = np.array([max(c["words"], 1) for c in cells], float)
    x = np.column_stack([np.ones(len(y)), np.log1p(weight), np.log1p(100 * weight / words)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - 0.1 * beta * [0, 1, 1]
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1, 0.1])
        step = np.linalg.solve(hessian, gradient)
        beta = np.clip(beta + step, [-30, 0, 0], [30, 30, 30])
        if np.abs(step).max() < 1e-6:
            break
    lexicon.bias, lexicon.by_weight, lexicon.by_share = map(float, beta)
    return lexicon


def measured(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_column: str = "text") -> DataFrame:
    """The kept columns with weight (of the hits), words and score (0 to 1)."""
    rows = docs.select(*keep, F.col(text_column).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        longest = max(map(len, lexicon.weights), default=0)
        for batch in batches:
            weights, words = [], []
            for text in values(batch.column(len(fields))):
                folded = fold(text, automaton, longest)
                weights.append(sum(w for _, _, w in hits(folded, automaton)))
                words.append(folded.count(" ") - 1 if len(folded) > 2 else 0)
            scores = [lexicon.score(w, n) for w, n in zip(weights, words, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(fields)], pa.array(weights, pa.float64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())],
                names=[*(f.name for f in fields), "weight", "words", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{kinds}, weight double, words bigint, score double")


def held_out(doc_id):
    """Rows no label of which is learned from: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5), weight and words of each document."""
    lexicon = learn(training_rows(docs, labels, lambda doc_id: ~held_out(doc_id)))
    scored = measured(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), lexicon, ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weight", "words"
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, columns as they came.

    Only the text goes to Python and only the score comes back; the rows themselves stay where they are.
    """
    lexicon = learn(training_rows(docs, labels, lambda doc_id: ~held_out(doc_id)))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        longest = max(map(len, lexicon.weights), default=0)
        for texts in batches:
            scores = []
            for text in values(texts):
                folded = fold(text, automaton, longest)
                weight = sum(w for _, _, w in hits(folded, automaton))
                scores.append(lexicon.score(weight, folded.count(" ") - 1 if len(folded) > 2 else 0))
            yield pa.array(scores, pa.float64())

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of the input may clash with the score's
    kept = plain.withColumn("score", score(F.col(f"c{names.index('text')}").cast("string"))).filter("score < 0.5")
    return kept.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])
