"""The corpus pipeline: five stages from raw documents to packed sequences, each one operator of geoweft.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents. Rows that a stage drops are gone for all later ones.

Defined results: a stage judges rows, not ids. Where no id is repeated, rows are told apart by their id; where one is,
by a 64-bit hash of id and text, so that rows of one id with unlike texts are kept or dropped each for itself, and rows
of one id and text alike (the second stage leaves one of them). Null and empty texts have no language and go in the first
stage, which also fills in `lang` where it is null; where no row has a label, rows with a letter stay. Empty tables give no rows; further columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.llm import decontaminate, exact_dedup, language_id, packing, set_join
from geoweft.llm._common import BROADCAST_IDS, cut, ensure_checkpoint_dir, remove, without
from geoweft.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The columns of documents and `row`, which tells rows apart; whether it is the id."""
    docs = docs.select(*COLUMNS)
    by_id = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    return docs.withColumn("row", F.col("doc_id").cast("long") if by_id else F.xxhash64("doc_id", "text")), by_id


def _less(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows less those whose `row` is the doc_id of one in gone."""
    return without(rows, gone.select(F.col("doc_id").alias("row")), "row").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and gives those without a label the language that was found."""
    rows, _ = _rows(docs)
    model = language_id.train(rows, where=~language_id.held_out())
    rejected = language_id.identify(rows, model, id_col="row").filter("lang_pred = 'und'").select("doc_id")
    unlabelled = rows.filter("lang IS NULL")
    if model.languages and not unlabelled.isEmpty():
        found = cut(language_id.identify(unlabelled, model, id_col="row").groupBy(F.col("doc_id").alias("row")).agg(F.first("lang_pred").alias("found")))  # equal rows have equal texts
        found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
        rows = rows.join(found, "row", "left").withColumn("lang", F.coalesce("lang", "found")).drop("found")
    if not model.languages:
        rejected = rejected.join(rows.filter(F.col("text").rlike("\\p{L}")).select(F.col("row").alias("doc_id")), "doc_id", "left_anti")
    return _less(rows, rejected)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    rows, by_id = _rows(docs)
    found = exact_dedup.exact_dedup(rows)
    if by_id:
        return _less(rows, found.filter(~F.col("kept")))
    kept = cut(found.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")))
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    rows = rows.withColumn("own_sha", F.sha2(norm, 256))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left_semi")
    least = F.min(F.struct("text", "lang", "source", "n_chars"))  # of texts that differ in white space, or rows in labels, always the same one
    return rows.groupBy("doc_id", "own_sha").agg(least.alias("row")).select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    rows, by_id = _rows(docs)
    found = set_join.jaccard_components(rows, id_col="row").select("doc_id", "component_id")
    if not by_id:  # the smallest row isn't that of the smallest doc_id
        found = cut(found)
        ids = rows.select(F.col("row"), F.col("doc_id").alias("id"))
        first = found.join(ids, F.col("doc_id") == F.col("row")).groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("first"))
        found = found.join(first, "component_id").select("doc_id", F.col("first.doc_id").alias("component_id"))
    return _less(rows, found.filter("component_id <> doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are benchmark windows."""
    rows, _ = _rows(docs)
    return _less(rows, decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="row").filter("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences over all that is left."""
    return packing.piece_digests(packing.pack(docs.select(*COLUMNS), tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again. Only the
    rows that the last stage reads stay there, for as long as its result may be computed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


#: Mixture inference and tokenisation aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None
