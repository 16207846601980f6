"""Registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import (
    decontaminate,
    exact_dedup,
    fill_middle,
    hilbert,
    packing,
    piece_bpe,
    quality,
    ranked_search,
    simhash,
    token_counts,
    token_store,
    toxicity,
    warc,
)
from tablewright.llm.common import documents, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def model_path(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine."""
    return public_tokenizers.path(name)


@query
def op1_token_files(spark, folder) -> DataFrame:
    manifest = token_store.write_token_files(documents(spark, folder), model_path("word_bpe_49k.json"))
    return token_store.read_token_files(manifest).withColumnRenamed("id", "doc_id")


@query
def op2_exact_dedup(spark, folder) -> DataFrame:
    found = exact_dedup.exact_duplicates(documents(spark, folder), digests=True)
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


SQL["op2_exact_dedup"] = r"""
WITH rows AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM rows"""


@query
def op3_decontamination(spark, folder) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, folder), benchmark).withColumnRenamed("id", "doc_id")


@query
def op4_hilbert_shards(spark, folder) -> DataFrame:
    placed = hilbert.hilbert_shards(documents(spark, folder), shards=40)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def id_remainder(divisor: int):
    """CRC-32 of the id as text, modulo a number: decides which labels may be learnt from."""
    return F.crc32(F.col("id").cast("string").cast("binary")) % divisor


def with_verdict(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op5_toxicity(spark, folder) -> DataFrame:
    docs = documents(spark, folder)
    marks = quality.one_label_each(spark.read.parquet(f"{folder}/labels.parquet"), "toxic")
    held_out = id_remainder(5) == 0
    texts, labels = toxicity.training_sample(docs, marks.where(~held_out))
    return with_verdict(toxicity.score(docs, toxicity.fit(texts, labels)), held_out)


@query
def op6_warc(spark, folder) -> DataFrame:
    manifest = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"))
    return warc.read_archives(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op7_simhash(spark, folder) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op8_piece_encoding(spark, folder) -> DataFrame:
    path = model_path("piece_bpe_32k.model")
    both = piece_bpe.encode_texts(documents(spark, folder), path, decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op9_token_counts(spark, folder) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, folder), model_path("piece_bpe_32k.model"))
    return counted.withColumnRenamed("id", "doc_id")


@query
def op10_quality(spark, folder) -> DataFrame:
    marks = quality.one_label_each(spark.read.parquet(f"{folder}/labels.parquet"), "quality")
    held_out = id_remainder(3) == 1
    statistics = stored(quality.document_statistics(documents(spark, folder)), "quality-statistics")
    model = quality.train(statistics, marks.where(~held_out))
    return with_verdict(quality.score(statistics, model), held_out)


@query
def op11_packing(spark, folder) -> DataFrame:
    pieces = packing.write_pieces(documents(spark, folder), model_path("word_bpe_49k.json"))
    return packing.place(pieces).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op12_fill_middle(spark, folder) -> DataFrame:
    turned = fill_middle.fill_in_middle(documents(spark, folder))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return turned.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


SQL["op12_fill_middle"] = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS hash
  FROM documents),
draws AS (
  SELECT doc_id, body, u, len(u) AS n,
         CAST('0x' || substr(hash, 1, 8) AS BIGINT) % (len(u) + 1) AS one,
         CAST('0x' || substr(hash, 9, 8) AS BIGINT) % (len(u) + 1) AS two,
         CAST('0x' || substr(hash, 17, 8) AS BIGINT) % 100 AS three,
         CAST('0x' || substr(hash, 25, 8) AS BIGINT) % 100 AS four
  FROM units),
parts AS (
  SELECT doc_id, body, n,
         coalesce(array_to_string(u[1:least(one, two)], ''), '') AS prefix,
         coalesce(array_to_string(u[least(one, two) + 1:greatest(one, two)], ''), '') AS middle,
         coalesce(array_to_string(u[greatest(one, two) + 1:], ''), '') AS suffix,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts"""


@query
def op13_ranked_search(spark, folder) -> DataFrame:
    found = ranked_search.ranked_search(
        documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
    )
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


SQL["op13_ranked_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
         doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""
