"""Byte-level BPE encoding and decoding of whole texts.

One Arrow pass: each match of the pattern is encoded on its own by longest
matches with backtracking (see bpe_core), the ids are decoded again, and the
query returns digests of both. No shuffle. Texts are cut at white space, where
the pattern cuts anyway, and a bounded memo keeps the pieces' ids.

Null texts count as empty (no ids). Special strings are ordinary text. Repeated
rows each have their row. Other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_core import sha256, text_encoder
from .common import read_table, text_groups


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for a, b, texts in text_groups(batch.column(1)):
                ids = [memoryview(x).cast("i").tolist() for x in encoder.encode(texts)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of (doc_id, ids) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_encoder(path, pattern).bpe
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            sizes, ids_sha, text_sha = [], [], []
            for _, _, texts in text_groups(batch.column(1)):
                for packed in encoder.encode(texts):
                    sizes.append(len(packed) // 4)
                    ids_sha.append(sha256(packed))
                    text_sha.append(sha256(encoder.decode(packed)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def production() -> tuple[str, str]:
    """The rank file and the pattern that the query and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe_digests(read_table(spark, sf_dir, "documents"), *production())
