"""The training-data pipeline over ``documents``: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmeter.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from leafmeter.llm.common import documents_of, same_document, small_batches, stored, without


#: Strings that the suffix stage looks for, in bytes, and the words that a passage must have to go.
PASSAGE_BYTES = 144
PASSAGE_WORDS = 50


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier, fitted on the labelled ones, finds toxic.

    NULL and empty texts have no toxic passage and stay; repeated rows stand or fall together; without labels of both
    kinds, or without rows, nothing is dropped.
    """
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those that are equal without white space; half of them is the indexed history.

    NULL texts count as empty, so one of all empty ones stays.  Of repeated rows (equal doc_id and text) one stays, with
    any one's other columns.  An empty table stays empty.
    """
    small_batches(spark)
    old = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    judged = stored(exact_dedup.deduplicate(docs, old).select("doc_id", "text_key", "kept"), "judged")
    several = judged.filter("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    several = stored(several, "several")
    once = without(docs, judged.filter("NOT kept").select("doc_id", "text_key").unionByName(several))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"))
    one = rows.join(several, same_document(rows, several), "left_semi").dropDuplicates(["doc_id", "text_key"]).select("row.*")
    return once.unionByName(one)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group.

    Texts without words have one fingerprint and count as near; a NULL doc_id comes last in its group; an empty table
    stays empty.
    """
    small_batches(spark)
    groups = simhash.near_duplicates(docs)
    return without(docs, groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of ``PASSAGE_WORDS`` words or more that an earlier place has too; the earliest one stays.

    Strings of ``PASSAGE_BYTES`` bytes are searched, and united ranges go that have enough words or 400 bytes.  A
    character that a cut splits goes whole.  NULL texts become empty; every row stays, so an empty table stays empty;
    repeated rows, of which the exact stage leaves one, count as one document.
    """
    small_batches(spark)
    cut = suffix_dedup.remove_strings(docs, PASSAGE_BYTES, carry=True, keep_first=True, least_words=PASSAGE_WORDS)
    # Bytes of a split character are the only ones that are not UTF-8; they stand next to a cut.
    whole = F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode(errors="ignore")), "string")
    text = F.when(F.size("removed") > 0, whole("kept")).otherwise(F.decode("kept", "UTF-8"))
    columns = {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType),
        "text": F.col("_text"),
        "n_chars": F.length("_text").cast("long"),
    }
    rows = cut.withColumn("_text", text)
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(f"row.{c}").alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts with their places in sequences of at most 2048 tokens.

    NULL and empty texts are one piece of the end id; repeated rows are packed each; an empty table gives no rows.
    """
    small_batches(spark)
    cut = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    digests = cut.select("doc_id", "text_key", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests).drop("text_key")


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("packing", packing_stage),
]

#: No SQL: the first stage trains a model, and others search texts in ways that SQL cannot on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
