"""Query of the byte-pair encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.llm.byte_pairs import decode_ids, encode_texts, read_ranks
from dyadic.llm.registry import query
from dyadic.plans.inputs import table
from dyadic.session import spread_scan

RANKS = "byte_bpe_50k.tiktoken"


@query("op13_byte_pairs")
def op13_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANKS))
    docs = spread_scan(table(spark, folder, "documents").select("doc_id", "text"))
    encoded = encode_texts(docs, ["doc_id"], ranks, public_tokenizers.PATTERN).select("row.doc_id", "found.ids")
    decoded = decode_ids(encoded, ["doc_id", "ids"], ranks)
    return decoded.select(
        "row.doc_id", F.size("row.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("row.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("found.data", 256).alias("decoded_sha256"))
