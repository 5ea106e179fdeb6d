"""Corpus pipeline: documents in, token ids out.

Each stage takes what the one before kept, written as Parquet and read again, and
works on its whole texts. All but the last return the columns of ``documents``.

Defined results, beside those of the operators: the Jaccard join judges rows, by
id and text, so rows of one id with unlike texts are documents of their own, and
of each component, null ids included, and of equal rows with an id one row stays;
documents without words are no one's copy; texts that are null or
hold no letter go at language identification; empty tables give empty results;
columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import decontaminate, jaccard_join, language_id, mixing, token_ids
from tabloom.llm.common import Store, drop_ids, read
from tabloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those rejected go."""
    model = language_id.fit(docs, F.lit(True))
    return language_id.identify(docs, model).where("not rejected").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked rows one of the smallest doc_id stays; one of a null id only where all of them are null."""
    store = Store(spark, "near-copies")
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = jaccard_join.join(docs.select(F.col("row").alias("doc_id"), "text")).where("n_shingles > 0")
    members = store.keep(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct(), "members")
    ids = docs.select("row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")
    stays = members.join(ids, "row").groupBy("component").agg(first).select("row")
    gone = store.keep(members.join(stays, "row", "left_anti").select("row"), "gone")
    kept = drop_ids(docs, gone, "row")
    twice = docs.groupBy("row").agg(F.count("*").alias("n"), F.first("doc_id").alias("id")).where("n > 1")
    twice = twice.join(members, "row", "left").where("id is not null or component is not null").select("row")
    if twice.limit(1).count():  # equal rows are merged, the others need no exchange
        kept = kept.join(twice, "row", "left_anti").unionByName(kept.join(twice, "row", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that op10 finds is cut out, windows and whole shorter items of any length; documents that are mostly such passages go."""
    cut = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), max_span=0, unnamed=True)
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs), COLUMNS)


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the token files."""
    return token_ids.round_trip(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", ids),
]

#: Trained weights, automata and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = store.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            store.drop(f"stage{i - 1}")
    return docs
