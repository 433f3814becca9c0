"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A document's key is the hash of its text, so equal texts stand together on the
ring and share a shard unless its bound cuts them. Each shard takes at most its
share of the rows (law ``rows``: counts differ by one at most); keys that come
to a full shard go on clockwise. Which runs of keys go where follows from the
number of keys at each of the ring's virtual nodes, so the driver sees only
counts for each node and task, and shard and slot follow from a row's rank on
the ring.

assign() deals narrow rows (no texts), write_shards() whole ones, by ranges of
(ring position, doc_id), sorted, so a text that a third of the rows share is
split over many tasks.

Null texts have size 1, the checksum of no bytes and the key of the empty text.
Rows are in ring order by (key, doc_id, checksum), null doc_ids first; which of
several equal rows gets which slot is open, and their rows are equal but for
this. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import discard, materialise, n_parts, read_table, unused
from .ring_core import VIRTUAL, Assignment, arcs_of, virtual_nodes

SHARDS = 8
#: Bytes of a narrow row in the shuffle, about.
_ROW_BYTES = 40


def assign(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    return _assigned(spark, docs, shards, virtual, id_col, text_col, []).select("doc_id", "size", "text_crc32", "shard", "slot")


def _assigned(spark: SparkSession, docs: DataFrame, shards: int, virtual: int, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, and what is carried along) of every row."""
    nodes, owners = virtual_nodes(shards, virtual)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("ring"), *carried)
    keyed, keyed_at = materialise(spark, keyed, "sharding-keys")
    width = F.lit(_ROW_BYTES) + (F.col("size") if carried else F.lit(0))
    width = keyed.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("arc", pa.array(arcs_of(batch.column(3).to_numpy(), nodes).astype(np.int32)))

    order = [F.asc("ring"), F.asc_nulls_first("doc_id"), F.asc("text_crc32")]
    sorted_ = keyed.repartitionByRange(n_parts(spark, width), *order).sortWithinPartitions(*order).mapInArrow(place, StructType([*keyed.schema.fields, StructField("arc", IntegerType())]))
    # monotonically_increasing_id counts a partition's rows in their order and has its number in the high bits
    ranked, _ = materialise(spark, sorted_.withColumn("at", F.monotonically_increasing_id()), "sharding-ranked")
    discard(spark, keyed_at)
    part, local = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each task and each node within its range
    sums = ranked.groupBy(part.alias("part"), (F.col("ring") > F.lit(int(nodes[-1]))).alias("past"), "arc").agg(F.count("*").alias("n")).collect()
    starts, total = {}, 0
    per_part: dict[int, int] = {}
    for r in sums:
        per_part[r.part] = per_part.get(r.part, 0) + r.n
    for p in sorted(per_part):
        starts[p] = total
        total += per_part[p]
    # ranks run from the lowest ring position; keys past the last node belong to node 0, as an arc of its own here
    n = len(nodes)
    counts, first_rank = [0] * (n + 1), [0] * (n + 1)
    for r in sums:
        counts[n if r.past else r.arc] += r.n
    for k in range(1, n + 1):
        first_rank[k] = first_rank[k - 1] + counts[k - 1]
    assignment = Assignment(counts, first_rank, [*owners.tolist(), int(owners[0])], shards)
    kept = [f for f in ranked.schema.fields if f.name not in ("ring", "arc", "at")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            base = np.array([starts[p] for p in (at >> 33).tolist()], np.int64)
            shard, slot = assignment.of(base + (at & ((1 << 33) - 1)))
            yield pa.record_batch([*batch.columns[1:], pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*(f.name for f in kept), "shard", "slot"])

    out = StructType([*kept, StructField("shard", IntegerType()), StructField("slot", LongType())])
    return ranked.select("at", *[f.name for f in kept]).mapInArrow(finish, out)


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = SHARDS, virtual: int = VIRTUAL, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the rows of docs in a folder shard=N for each shard.

    The rows go round the ring whole, so each keeps all its columns and no join
    brings them together with their shards. The files have the columns of docs
    and slot; a column of docs with that name, or named shard, is written as
    slot_ or shard_ (with one more _ where that is taken, too).
    """
    names = unused(["shard", "slot"], *docs.columns)
    row = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row")
    got = _assigned(spark, docs, shards, virtual, id_col, text_col, [row])
    got.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)


def op9_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is ``rows``."""
    out = assign(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
