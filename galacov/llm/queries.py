"""The queries that apply each operator, with production parameters, to its whole table; SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import exact_dedup, jpeg, licenses, line_dedup, mixing, near_dedup, sentencepiece_codec, token_codec, toxicity, warc
from .common import staged, table

SQL: dict[str, str] = {}


def op1_token_binary(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_codec.round_trip(table(spark, sf_dir, "documents"), path)


def op2_sentencepiece(spark, sf_dir):
    """Digests of the ids and of the text decoded from them; n_ids, ids_crc32, round_trip, parity."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), path)


def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


SQL["op3_line_dedup"] = line_dedup.SQL


def op4_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


SQL["op5_mixing"] = mixing.SQL


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


SQL["op6_license_scan"] = licenses.sql()


def op7_exact_dedup(spark, sf_dir):
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op7_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = toxicity.train(docs, labels.where(fold != 2))
    scored = toxicity.score(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))), model, carry=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_jpeg_media(spark, sf_dir):
    """The streams are written to the shared folder, and everything is recovered from what was written."""
    found = jpeg.columns_of(staged(jpeg.stored(table(spark, sf_dir, "documents")), "media"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_token_binary, op2_sentencepiece, op3_line_dedup, op4_minhash_near_dedup, op5_mixing, op6_license_scan, op7_exact_dedup, op8_toxicity, op9_jpeg_media, op10_warc)}
