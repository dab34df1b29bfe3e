"""Registered queries of the operators, each over its whole table, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import alignment, chunks, fingerprint, language_model, lexical, lines, minhash, mixing, neighbours, packing, token_counts, toxicity, warc
from tidebook.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_warc_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a replica of all pages' records in which of about a hundred records one lost a character, one is lost and one is added."""
    pages = read(spark, folder, "pages")
    return warc.audit(warc.records(pages), warc.records(warc.fading_replica(pages))).select(
        "volume", "position", "record_id", "offset", "n_bytes", "digest", "replica_digest", "state"
    )


@query
def op2_b_bit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_copies(read(spark, folder, "documents"))


@query
def op4_line_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(read(spark, folder, "documents"))


@query
def op3_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, folder, "documents"))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op6_entropy_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(read(spark, folder, "documents"))


@query
def op9_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


@query
def op10_prefix_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.prefix_counts(read(spark, folder, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (counted["n_tokens"] > token_counts.TOKEN_LIMIT).alias("over_limit"))


@query
def op7_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(read(spark, folder, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(100)) == 0)


@query
def op8_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scored(read(spark, folder, "documents"))


@query
def op11_chunk_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.coded(read(spark, folder, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "n_chunks",
    )


@query
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(read(spark, folder, "documents")).drop("groups")


@query
def op12_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


# Terms are counted over all documents, weights and components follow the same integer arithmetic.
ORACLES["op12_ball_tree"] = """
with words as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents
), tf as (select doc_id, term, count(*) as tf from words group by 1, 2),
lengths as (select doc_id, cast(sum(tf) as bigint) as n from tf group by 1),
totals as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from lengths),
damped as (select doc_id, 25 + (75 * n * big_n) // big_l as m from lengths cross join totals),
asked as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark
), item_terms as (select item_id, term, count(*) as times from asked group by 1, 2),
held as (select term, count(*) as df from tf group by 1),
weights as (
    select term, cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w from held cross join totals
), scores as (
    select item_id, tf.doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
    from item_terms join weights using (term) join tf using (term) join damped on damped.doc_id = tf.doc_id
    group by 1, 2
), ranked as (
    select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
    from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
