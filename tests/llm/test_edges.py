"""Every operator on odd input: results as the docstrings define them."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.llm import fingerprint, language_model, lines, minhash, mixing, neighbours, packing, token_counts, toxicity, vocabulary, warc


def key(row):
    return tuple((v is None, str(v)) for v in row)


def test_minhash(documents, nothing):
    rows = {(r.doc_id, r.n_shingles): r for r in minhash.near_copies(documents).collect()}
    assert len(minhash.near_copies(documents).collect()) == documents.count()
    assert rows[0, 0].component_id == 0 and rows[2, 0].kept
    assert rows[4, 1].component_id == 3 and not rows[4, 1].kept
    near = {r.component_id for (i, _), r in rows.items() if i in (5, 6, 7)}
    assert near == {5}
    assert all(r.component_id is None and r.kept for (i, _), r in rows.items() if i is None)
    assert minhash.near_copies(nothing).count() == 0
    kept = minhash.deduplicated(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 5, None, 8, 9, 10, 12}


def test_estimate_matches_similarity():
    rng = np.random.default_rng(3)
    for shared in (1000, 700, 200):
        pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        values, begins = np.concatenate([a, b]), np.array([0, 1000, 2000])
        packed = minhash._packed(minhash._minima(values, begins))
        assert abs(minhash.estimate(packed[0], packed[1]) - shared / (2000 - shared)) < 0.2


def test_lines(documents, nothing):
    report = {r.doc_id: r for r in lines.line_report(documents).collect()}
    assert report[9].n_removed == 1 and report[9].removed_lines == "1"
    assert report[4].n_removed == 1 and report[3].n_removed == 0
    assert report[0].n_lines == 0 and report[2].n_lines == 0
    assert report[None].n_removed == 1  # null ids come last
    cleaned = lines.deduplicated(documents)
    assert cleaned.columns == documents.columns and cleaned.count() == documents.count()
    assert all(r.n_chars == len(r.text or "") for r in cleaned.collect())
    assert lines.line_report(nothing).count() == 0


def test_many_similar_lines_need_all_rows(spark):
    """More rows under a word than the window holds: the matches still equal brute force."""
    words = [f"q{i}" for i in range(24)]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.permutation(words)[: rng.integers(14, 24)]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [frozenset(t.split()) for t in texts]
    expected = {j for j in range(150) if any(4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) for i in range(j))}
    assert {r.doc_id for r in lines.line_report(docs).collect() if r.n_removed} == expected


def test_fingerprints(documents, nothing):
    rows = fingerprint.fingerprints(documents, chunk_rows=3).collect()
    assert len(rows) == documents.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, r)
    assert by[3].fingerprint == by[4].fingerprint and by[0].fingerprint == ""
    assert fingerprint.fingerprints(nothing).count() == 0


def test_edited_texts_equal_brute_force(spark, small):
    import hashlib

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    order = sorted(texts, reverse=True)
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs, chunk_rows=20).collect()}
    for i, doc_id in enumerate(order):
        text, after = texts[doc_id], texts[order[(i + 1) % len(order)]]
        k = len(text) // 3
        assert found[doc_id].edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()


def test_toxicity(documents, labels, nothing):
    rows = toxicity.toxicity(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.toxicity(nothing, labels.filter("false")).count() == 0
    assert toxicity.without_toxic(documents, labels).columns == documents.columns


def test_lexicon_folds_and_excepts():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, ["idiot proof"])
    automaton = lexicon.automaton()
    for text in ("You 1D10T!", "an іdіоt", "ＩＤＩＯＴ", "idi​ots."):
        assert len(toxicity.hits(toxicity.fold(text), automaton)) == 1
    for text in ("idiot proof", "videos", "", None, "anidiot"):
        assert not toxicity.hits(toxicity.fold(text), automaton)


def test_marks_inside_words_are_letters(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0, "bastard": 3.0}, ["idiot proof"], by_weight=9.0)
    automaton = lexicon.automaton()
    for text in ("you id!ot", "id|ot", "!diot", "|d!0+s", "bas+ard!", "ｉｄ！ｏｔ", "(id!ot)", "idi0t!!"):
        assert len(toxicity.hits(toxicity.fold(text), automaton)) == 1
    assert toxicity.fold("Stop! a | b ++ c+") == " stop a b c "
    texts = ["an id!ot", "an id|ot", "a bas+ard", "wow!idiot", "no!id!ot|x", "id|ot proof", "this|or+that", "fine!", "id!ot|bas+ard"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.weight, r.words) for r in toxicity.measured(docs, lexicon, ["doc_id"]).collect()}
    assert found == {0: (5.0, 2), 1: (5.0, 2), 2: (3.0, 2), 3: (5.0, 2), 4: (5.0, 3), 5: (0.0, 2), 6: (0.0, 3), 7: (0.0, 1), 8: (8.0, 2)}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97


def test_counted_entries_are_handed_on(spark, monkeypatch):
    """A task holds a bounded number of entries, however many a batch of texts has, and loses none."""
    monkeypatch.setattr(toxicity, "FLUSH", 50, raising=False)
    tasks = []

    class Rows:
        def mapInArrow(self, run, _):  # noqa: N802
            tasks.append(run)
            return self

        def groupBy(self, *_):  # noqa: N802
            return self

        agg = groupBy

    toxicity._counted(Rows(), toxicity.stems)
    texts = [f"stem{i:04} other{i % 9}" for i in range(300)] + [None, ""]
    flags = [i % 2 for i in range(302)]
    whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(flags, pa.int32())], names=["text", "toxic"])
    told = list(tasks[0](iter([whole.slice(0, 200), whole.slice(200)])))
    assert max(b.num_rows for b in told) <= 50 + 20
    expected = [collections.Counter(), collections.Counter()]
    for text, toxic in zip(texts, flags, strict=True):
        expected[toxic].update(toxicity.stems(toxicity.fold(text)))
    found = [collections.Counter(), collections.Counter()]
    for b in told:
        for entry, in_toxic, in_clean in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[1][entry] += in_toxic
            found[0][entry] += in_clean
    assert [+f for f in found] == expected


def test_mixture(documents, nothing):
    rows = mixing.mixture(documents).collect()
    assert len(rows) == documents.count()
    assert all(r.taken <= 3 * r.size and r.copies >= 0 for r in rows)
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixture(nothing).count() == 0
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mixture(documents).collect()))


def test_mixture_meets_targets(spark, small):
    rows = mixing.mixture(spark.read.parquet(f"{small}/documents.parquet")).collect()
    taken, target, size = {}, {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    expected, free, rest = {}, dict(weights), sum(size.values())
    while True:  # cap, share the rest again
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            expected[s] = 3 * size[s]
            rest -= expected[s]
            del free[s]
    expected |= share
    assert all(abs(target[s] - expected[s]) < 1e-6 * expected[s] for s in size)
    # Ten documents a source: whole copies come within a few hundredths.
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in size)


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    values = [(i, [float(x) for x in rng.normal(size=8)], 1, 0.5) for i in range(400)]
    values += [(400 + i, values[0][1], 1, 0.5) for i in range(30)]
    values += [(1000, None, 1, 0.5), (1100, [0.0] * 8, 1, 0.5), (1200, [None] + [1.0] * 7, 1, 0.5), (1300, [float("nan")] + [1.0] * 7, 1, 0.5), (1400, [1.0], 1, 0.5)]
    table = spark.createDataFrame(values, "vec_id bigint, embedding array<float>, rank int, score double")
    found = {}
    for r in neighbours.search(table, lambda i: i % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in values[:430]]
    ids, held = np.array([i for i, _ in good]), np.array([v for _, v in good])
    assert set(found) == {0, 100, 200, 300, 400}
    hit = 0
    for q, rows in found.items():
        gaps = np.sqrt(((held - held[q]) ** 2).sum(axis=1))
        gaps[q] = np.inf
        best = ids[np.lexsort((ids, gaps))[:10]]
        hit += len({v for _, v, _ in rows} & set(best))
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 11))
        assert all(abs(s - gaps[v]) < 1e-12 for _, v, s in rows)
    assert hit >= 45 and [v for _, v, _ in sorted(found[0])] == list(range(400, 410))
    assert neighbours.search(table.filter("false"), lambda i: i % 100 == 0).count() == 0


def test_neighbours_of_small_groups(spark, monkeypatch):
    """Hundreds of lists, most of them one small group of near copies, on whose centroid its queries almost lie."""
    monkeypatch.setattr(neighbours, "LIST_SIZE", 6)
    rng = np.random.default_rng(23)
    held = (np.repeat(rng.normal(size=(200, 8)), 6, axis=0) + 1e-4 * rng.normal(size=(1200, 8))).astype(np.float32).astype(float)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "vec_id bigint, embedding array<float>")
    for k in (10, 400):  # more than the first lists hold, as well
        found = {}
        for r in neighbours.search(table, lambda i: i % 25 == 0, k).collect():
            found.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert len(found) == 48 and all(sorted(rows) == list(range(1, k + 1)) for rows in found.values())
        hit = 0
        for q, rows in found.items():
            gaps = np.sqrt(((held - held[q]) ** 2).sum(axis=1))
            gaps[q] = np.inf
            hit += len(set(rows.values()) & set(np.argsort(gaps, kind="stable")[:k].tolist()))
        assert hit >= (0.97 if k == 10 else 0.8) * 48 * k


def test_language_model(documents, nothing):
    rows = language_model.scored(documents).collect()
    assert len(rows) == documents.count()
    empty = [r for r in rows if r.doc_id in (0, 1, 2)]
    assert all(r.n_tokens == 1 and r.score < 0 for r in empty)
    assert language_model.scored(nothing).count() == 0


def test_language_model_is_normalised():
    noise = np.full(language_model.CLASSES, 1 / language_model.CLASSES)
    model = language_model.Model(noise)
    before = np.tile(np.array([[1, 2, 3]]), (language_model.CLASSES, 1))
    assert abs(np.exp(model.log_probabilities(before, np.arange(language_model.CLASSES))).sum() - 1) < 1e-5


@pytest.mark.parametrize("scale", [1, 300])
def test_language_model_scores_in_slices(scale):
    model = language_model.Model(np.full(language_model.CLASSES, 1 / language_model.CLASSES))
    rng = np.random.default_rng(3)
    model.target *= scale
    model.bias[:] = rng.normal(0, scale, language_model.CLASSES)
    size = language_model.SLICE + 7
    before, classes = rng.integers(0, language_model.CLASSES + 1, (size, language_model.CONTEXT)), rng.integers(0, language_model.CLASSES, size)
    context = (model.context[before].astype(float) * model.position).sum(axis=1)
    scores = context @ model.target.T.astype(float) + model.bias
    top = scores.max(axis=1)
    expected = scores[np.arange(size), classes] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))
    assert model.log_probabilities(before, classes) == pytest.approx(expected, rel=1e-5, abs=1e-4)


def test_language_model_lone_words_meet_counts_once_a_text(spark, monkeypatch):
    """Words outside the table are counted by text where they are found, not by a shuffle of their occurrences."""
    monkeypatch.setattr(language_model, "FREQUENT", 3)
    docs = spark.createDataFrame([(i, "the of and " * 9 + f"lone{i} Lone{i}. lone{i} " * 3) for i in range(20)], "doc_id bigint, text string")
    found = language_model.scored(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    rows = found.collect()
    learned = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2]
    total, types = len(learned) * 37, 4 + 2 * len(learned)
    for r in rows:
        lone = [6, 3] if r.doc_id in learned else [0, 0]
        counts = {9 * len(learned): 27, len(learned): 1}
        base = sum(k * math.log10((n + 1) / (total + types + 1)) for n, k in counts.items())
        base += sum(k * math.log10((n + 1) / (total + types + 1)) for n, k in zip(lone, (6, 3), strict=True))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (37, 37 if r.doc_id in learned else 28, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_language_model_beats_base_on_held_out(spark):
    rows = language_model.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packing_round_trip(documents, nothing):
    known = vocabulary.vocabulary(vocabulary.default_path())
    pieces = packing.pack(documents.dropDuplicates(["doc_id"]).filter("doc_id is not null"), limits=packing.Limits(64, 4, 64)).collect()
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.ids_crc32 == zlib.crc32(bytes(p.ids)) and len(p.ids) == 4 * p.length
    for doc_id, parts in docs.items():
        ids = list(np.frombuffer(b"".join(b for _, b in sorted(parts)), "<u4"))
        assert ids == [*known.library.encode(texts[doc_id], add_special_tokens=False).ids, 1]
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= 64 and len(parts) <= 4
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("text", ["It's <|endoftext|>x", "aé b", "漢字" * 40, "a" * 150, "x" * 60 + "'s don'tgo", "\x85\xa0 \x1cabc", "Öß.", ""])
def test_prefix_counts_equal_the_library(text):
    known = vocabulary.vocabulary(vocabulary.default_path())
    data = text.encode()
    known.learn_steps([data])
    steps = known.steps(data)
    for k in range(len(text) + 1):
        assert token_counts.tokens_at(steps, k) == len(known.library.encode(text[:k], add_special_tokens=False).ids)


def test_token_counts(documents, nothing):
    rows = token_counts.prefix_counts(documents)
    assert rows.count() == documents.count() and token_counts.prefix_counts(nothing).count() == 0
    alone = documents.filter("doc_id in (9, 12)")
    cut = {r.doc_id: r for r in token_counts.truncate(alone, token_counts.prefix_counts(alone), 20).collect()}
    assert all(r.n_tokens <= 20 for r in cut.values())


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5), 1, "z") for i in range(300)] + [(None, None, None, 1, "z"), (7, "u", "", 1, "z"), (7, "u", "", 1, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, volume int, digest string")
    same = warc.audit(warc.records(pages), warc.records(pages))
    assert same.count() == 0
    found = warc.audit(warc.records(pages), warc.records(warc.fading_replica(pages))).collect()
    broken = {i for i in range(300) if zlib.crc32(str(i).encode()) % 97 == 0}
    assert {r.record_id for r in found if r.state == "altered"} >= broken - {7}
    fewer = warc.audit(warc.records(pages), warc.records(pages.filter("page_id < 299"))).collect()
    assert any(r.state == "missing" for r in fewer)
    none = pages.filter("false")
    assert warc.audit(warc.records(none), warc.records(none)).count() == 0


def test_warc_names_the_very_records(spark, monkeypatch):
    """Losses, additions and damage amid full volumes, repeated ids and null ids; the rest stays equal."""
    def told(archive, replica):
        rows = warc.audit(*(warc.records(spark.createDataFrame(x, "page_id bigint, url string, html string")) for x in (archive, replica))).collect()
        return sorted((r.state, r.record_id if r.state != "extra" else r.replica_id, r.offset, r.position) for r in rows), rows

    pages = [(i, "u", f"{i:04}") for i in range(5000)]
    size = len("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: u\r\nContent-Length: 4\r\n\r\n4444\r\n\r\n")
    offset = lambda i: size * i + sum(len(str(j)) for j in range(i))
    less = [p for p in pages if p[0] != 1000]
    found, rows = told(pages, less)
    assert found == [("missing", 1000, offset(1000), 1000)] and rows[0].volume == 0 and rows[0].replica_id is None
    assert told(less, pages)[0] == [("extra", 1000, None, 1000)]
    mixed = [(i, u, t[:-1] if i == 7 else t) for i, u, t in less] + [(20, "v", "x"), (9000, "u", "")]
    assert [f[:2] for f in told(pages, mixed)[0]] == [("altered", 7), ("extra", 20), ("extra", 9000), ("missing", 1000)]
    odd = [(None, "u", str(i)) for i in range(30)] + [(3, "u", str(i)) for i in range(90)] + [(5, "u", "same")] * 40
    for rows_of_a_volume in (warc.VOLUME_ROWS, 25):  # the second divides the hot id
        monkeypatch.setattr(warc, "VOLUME_ROWS", rows_of_a_volume)
        assert told(odd, odd[::-1])[0] == []
        other = odd[1:40] + [(3, "u", "other")] + odd[41:-2]
        assert sorted(f[:2] for f in told([x for x in odd if x[0]], [x for x in other if x[0]])[0]) == [("altered", 3), ("missing", 5), ("missing", 5)]
        assert [r.state for r in told(odd[:30], odd[1:30])[1]] == ["missing"]


def test_warc_fading_replica_exactly(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "abc" * (i % 3)) for i in range(3000)], "page_id bigint, url string, html string")
    rows = warc.audit(warc.records(pages), warc.records(warc.fading_replica(pages))).collect()
    left = {i: zlib.crc32(str(i).encode()) % 97 for i in range(3000)}
    states = {0: "altered", 1: "missing", 2: "extra"}
    expected = [(states[x], i) for i, x in left.items() if x in states]
    assert sorted((r.state, r.replica_id if r.record_id is None else r.record_id) for r in rows) == sorted(expected)


def test_minhash_components_that_meet_in_buckets_equal_brute_force(spark):
    """Texts around the threshold: buckets hold several components, and no link between them is lost."""
    rng = np.random.default_rng(11)
    texts = []
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(30):
            begin = rng.integers(0, 30)
            texts.append(" ".join(words[begin : begin + rng.integers(70, 90)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    component = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and component[i] != component[j]:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    assert {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()} == dict(enumerate(component))


def test_minhash_family_below_the_threshold_tells_each_class_once(spark):
    """Texts just too far apart to be linked: rows told grow with the texts, not with their pairs, and there is no link."""
    told = {}
    for size in (60, 120):
        rng = np.random.default_rng(5)
        texts = []
        for i in range(size):
            words = [f"w{j}" for j in range(300)]
            for place in rng.choice(300, 8, replace=False):
                words[place] = f"own{i}x{place}"
            texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        if size == 60:
            assert all(r.component_id == r.doc_id for r in minhash.near_copies(docs).collect())
        classes = minhash.signatures(docs).withColumnRenamed("doc_id", "rep")
        banded = classes.select("key", F.explode("bands").alias("band"))
        members = banded.join(banded.groupBy("band").agg(F.min("key").alias("leader"), F.count("key").alias("n")).filter("n > 1").drop("n"), "band")
        rows = minhash._across(members, classes, classes.select("key", "n_shingles", F.col("rep").alias("component")))
        told[size] = rows.count()
        assert rows.groupBy("band", "block", "asks", "key").count().filter("count > 1").isEmpty()
    assert 0 < told[60] <= 60 * 2 * minhash.PERMUTATIONS // minhash.ROWS
    assert told[120] <= 120 * 2 * minhash.PERMUTATIONS // minhash.ROWS


def test_minhash_blocks_join_components_once(spark, monkeypatch):
    """With blocks of a few sets, components equal those of whole buckets."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(130)]
    texts = [" ".join(words[b : b + 90]) for b in rng.integers(0, 40, 80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()}
    monkeypatch.setattr(minhash, "BLOCK_SETS", 4)
    assert {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()} == whole


def test_language_model_base_equals_brute_force(spark, small):
    """Counts and base of every document, from plain Python over whole texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()

    def tokens(text):
        lower = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        return [*re.findall(rb"[^\x20\x09-\x0D]+", lower), None]

    counts = collections.Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(tokens(r.text))
    total, distinct = counts.total(), len(counts)
    made = {r.doc_id: r for r in language_model.scored(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert len(made) == len(docs)
    for r in docs:
        own, row = tokens(r.text), made[r.doc_id]
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(own), sum(counts[t] > 0 for t in own), total
        )
        assert row.base_score == pytest.approx(base, rel=1e-9)


def test_packing_under_a_loss_limit(spark):
    """Prompts bear no loss; the loss limit binds below the token limit, and every id of repeated rows lies in one piece."""
    known = vocabulary.vocabulary(vocabulary.default_path())
    rows = [(i // 2, "tell me more about it " * (i % 5), "an answer of some words " * (1 + i % 9)) for i in range(60)]
    rows += [(100, None, "only text " * 40), (101, "only prompt " * 30, None), (102, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, prompt string, text string")
    pieces = packing.pack(docs, prompt_column="prompt", limits=packing.Limits(64, 8, 24)).collect()

    def ids(text):
        return known.library.encode(text or "", add_special_tokens=False).ids

    assert sum(p.length for p in pieces) == sum(len(ids(prompt)) + len(ids(text)) + 1 for _, prompt, text in rows)
    assert sum(p.loss_tokens for p in pieces) == sum(len(ids(text)) + 1 for _, _, text in rows)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        assert sum(p.length for p in parts) <= 64 and sum(p.loss_tokens for p in parts) <= 24 and len(parts) <= 8
    assert any(sum(p.loss_tokens for p in parts) == 24 and sum(p.length for p in parts) < 64 for parts in sequences.values())
