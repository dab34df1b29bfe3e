"""Line similarity: one number to sort by, batches bounded by rows, and only the wanted texts and lines made again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import hashing, lines, minhash, tables
from tidebook.session import cut


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, "\n".join(f"a{i} b{k} the of and {'w ' * k}x{i % 3} y{k % 4}" for k in range(6))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ranks = lines.rarity(docs)
    return docs, ranks, cut(lines.line_table(docs, ranks), spark)


def test_words_lie_together_by_length_under_one_sort_column(spark, made):
    rows = lines._by_word(made[2].withColumn("uid", F.monotonically_increasing_id()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [word#" in plan and plan.split("Sort [")[1].split("]")[0].count(" ASC") == 1
    for part in rows.rdd.glom().collect():
        seen = [(r.word >> 32, r.word & 0xFFFFFFFF) for r in part]
        assert seen == sorted(seen)
    tokens = made[2].select("n", F.explode("prefix").alias("token"))
    assert sorted((r.word >> 32, r.word & 0xFFFFFFFF) for r in rows.collect()) == sorted((r.token, r.n) for r in tokens.collect())


def test_batch_limit_comes_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), tables.batches_by_rows(spark):
        assert spark.conf.get(key).startswith(str((1 << 31) - 1))
        raise ValueError
    assert spark.conf.get(key) == before


def test_only_wanted_lines_are_made_again(spark, made):
    docs, ranks, table = made
    wanted = table.filter("doc_id in (3, 17) and line_no = 2").select("key", "doc_id")
    found = lines._chosen_lines(docs, ranks, wanted)
    assert {bytes(r.key) for r in found.collect()} == {bytes(r.key) for r in wanted.collect()}
    keys = [bytes(r.key) for r in table.select("key").collect()]
    bits = [r.b for r in table.select(lines._key_bit(F.col("key")).alias("b")).collect()]
    assert lines._key_bits(keys).tolist() == bits
    every = spark.range(200).select(minhash.bit_of(F.col("id")).alias("bit"), "id")
    near = minhash.marked(every, minhash.bitmap_slots(spark.range(0, 200, 7)))
    assert {r.id for r in near.collect()} >= set(range(0, 200, 7)) and near.count() < 60


def test_order_of_words_by_line():
    rng = np.random.default_rng(3)
    for lines_ in (5, 1 << 17):
        line, member = np.sort(rng.integers(0, lines_, 4000)), rng.integers(0, 50, 4000).astype(np.uint64)
        order, plain = lines._by_line(member, line), np.lexsort((member, line))
        assert (member[order] == member[plain]).all() and (line[order] == line[plain]).all()


@pytest.mark.parametrize("text", [b"", b" ", b"a", b" A b\n", b"\x08x\t\r\x0e", "École éa z".encode()])
def test_words_and_their_begins(text):
    hashes, starts = hashing.words(text)
    plain = text.lower().split()
    assert [text[s : s + len(w)].lower() for s, w in zip(starts.tolist(), plain, strict=True)] == plain
    assert [hashing.words(w)[0][0] for w in plain] == hashes.tolist()
