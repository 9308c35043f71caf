"""The operators as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from leafmeter.llm import (
    conversation_trie,
    exact_dedup,
    hmm,
    license_scan,
    packing,
    pieces,
    quality_mil,
    quality_rules,
    simhash,
    spelling_variants,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from leafmeter.llm.common import documents_of, small_batches, stored


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents_of(spark, folder))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["begin"]))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.token_pieces(documents_of(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    digests = cut.select("doc_id", "text_key", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests).drop("text_key")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    # One half of the documents is the history, the other half arrives and is looked up.
    old = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return exact_dedup.deduplicate(documents_of(spark, folder), old).drop("text_key")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents_of(spark, folder)
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out())
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(documents_of(spark, folder))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents_of(spark, folder)).drop("text_key")


def op8_hidden_markov_model(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.score_texts(documents_of(spark, folder), hmm.held_out()).drop("text_key")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality_rules.judged(documents_of(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))
    return out.drop("lang")


def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_strings(documents_of(spark, folder))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["begin"]))
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(documents_of(spark, folder), model), model)
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_pieces"),
        "n_byte_pieces",
        "score",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: the first h turns of conversation c - c % 5, then c's own after its
    first h, with h from 0 to 8 by c's checksum."""
    placed = stored(conversation_trie.turns(rows), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    known = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = known.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("source"))
    lengths = known.select(F.col("conv_id").alias("source"), "n")
    head = F.least("h", F.coalesce("n", F.lit(0)))
    convs = stored(convs.join(lengths, "source", "left").withColumn("head", head).drop("n"), "conversations")
    first = placed.filter("pos <= 8").withColumnRenamed("conv_id", "source")
    lent = convs.filter("head > 0").join(first, "source").filter("pos <= head")
    own = placed.join(convs, "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    columns = ["conv_id", "pos", "digest", "size"]
    return convs.select("conv_id"), lent.select(columns).unionByName(own.select(columns))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    convs, placed = _rebuilt(spark.read.parquet(f"{folder}/conversations.parquet"))
    return conversation_trie.conversation_trie(convs, stored(placed, "rebuilt")).withColumnRenamed("saved", "saved_tokens")


def op12_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents_of(spark, folder)
    model = quality_mil.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~quality_mil.held_out())
    return quality_mil.score(docs, model).select(
        "doc_id", quality_mil.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "passages", "top_passage",
    )


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = spelling_variants.count_words(documents_of(spark, folder), least_length=6, every=199)
    return spelling_variants.variants(words.filter("n >= 5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_packing,
        op3_exact_dedup,
        op4_toxicity,
        op5_simhash,
        op6_suffix_array_dedup,
        op7_license_scan,
        op8_hidden_markov_model,
        op9_quality_rules,
        op10_sentencepiece,
        op11_conversation_trie,
        op12_quality_classifier,
        op13_spelling_variants,
    )
}
ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), n AS (
            SELECT doc_id, length(text) AS size,
                sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM t
        ), r AS (
            SELECT *,
                first_value(doc_id) OVER (PARTITION BY h ORDER BY size DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY h) AS group_size
            FROM n
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
    """,
    # The 32-bit checksum of c's digits by shift and exclusive or, then prefixes as lists of turns.
    "op11_conversation_trie": r"""
        WITH RECURSIVE original AS (
            SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), step AS (
            SELECT list(list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i)
                ORDER BY i) AS s
            FROM range(256) t(i)
        ), c AS (
            SELECT conv_id, conv_id - conv_id % 5 AS source,
                xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
                    lambda x, b: xor(x >> 8, s[xor(x & 255, b) + 1]), 4294967295), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM original), step
        ), lists AS (
            SELECT conv_id, list(said ORDER BY pos) AS l FROM original GROUP BY 1
        ), rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(p.l, [])[:h], o.l[h + 1:]) AS l
            FROM c JOIN lists o USING (conv_id) LEFT JOIN lists p ON p.conv_id = c.source
        ), member AS (
            SELECT conv_id, d, len(l) = d AS ended, md5(l[:d]::VARCHAR) AS k, CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].t) END AS size
            FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)
        ), node AS (
            SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
            FROM member GROUP BY d, k
        ), above AS (
            SELECT n.d, n.k, p.k AS pk FROM node n JOIN member p ON p.conv_id = n.conv_id AND p.d = n.d - 1
        ), kids AS (
            SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM above GROUP BY ALL
        ), subtree AS (
            SELECT m.d, m.k, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved
            FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
            GROUP BY ALL
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
            n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM node n JOIN subtree s USING (d, k) LEFT JOIN kids USING (d, k)
            LEFT JOIN above a USING (d, k) LEFT JOIN node p ON p.d = n.d - 1 AND p.k = a.pk
    """,
}
