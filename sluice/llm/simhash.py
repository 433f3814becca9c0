"""SimHash near-duplicates by the generalised pigeonhole principle.

1. One Python pass turns each text into a 64-bit fingerprint; the narrow
   (doc_id, fingerprint) table goes to the shared folder.
2. Equal fingerprints collapse to one row each, so a group of exact copies,
   however large, costs one row from here on.
3. A bounded sample of fingerprints (``SAMPLE``) groups correlated bits into
   parts; dynamic programming gives the parts unequal thresholds at least
   estimated cost (signatures written plus candidates compared).
4. Each fingerprint is indexed under its own bits of a part and probes the
   variants within that part's threshold. Rows that meet under a key are
   verified on all 64 bits; a key gives its links, or a spanning forest where
   these are many. A key with over ``HOT`` rows is dealt in pairs of blocks to
   many tasks, so no group is too large for one task and no link is lost; the
   rows written for such a key grow with the square of its distinct
   fingerprints over ``HOT``.
5. Components of the links; a document's component_id is the smallest doc_id.
   Texts that over a ``COMMON``-th of the rows share, at most so many, meet
   their component by a broadcast, all others by a shuffle.

keep_first() does the same with other fingerprints: near is what the share of
equal bits of 256-bit SimHashes of the distinct five-word shingles says is a
Jaccard similarity of 0.8 or more (simhash_core.wide_distance: with a standard
deviation's leave), and what the plan is made for are SimHashes of the distinct
words, within 4 of 64 bits, since few edits change few words but many shingles.
A pair whose words differ more is not found: see the README for how many.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows keep their rows. A null doc_id is never a component's smallest id
unless the component has no other (component_id is null then). Other columns of
the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash_core as core
from .common import discard, materialise, n_parts, read_table, text_bytes, unused
from .components import connected_components

#: Fingerprints that the plan is estimated from.
SAMPLE = 4096
#: Rows under one key beyond which it is dealt to several tasks.
HOT = 16_384
#: Longs of the bitmap that tells keep_first() which rows surely stay; four rows that go for each, until there are this many.
SLOTS = 1 << 20
#: Keys that may be frequent: such as over this part of all rows share.
COMMON = 50_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([core.fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signatures(nodes: DataFrame, parts: list[tuple[int, int, list[int]]]) -> DataFrame:
    """key, own and the columns of nodes: the index row (own) and the probe rows of each fingerprint (fp) in each part."""
    entries = [
        F.struct(F.lit(k).alias("part"), F.lit(_signed(flip)).alias("flip"), F.lit(_signed(mask)).alias("mask"))
        for k, (mask, _, flipped) in enumerate(parts)
        for flip in flipped
    ]
    each = nodes.select(*nodes.columns, F.explode(F.array(*entries)).alias("e"))
    bits = F.col("fp").bitwiseXOR(F.col("e.flip")).bitwiseAND(F.col("e.mask"))
    return each.select(F.xxhash64("e.part", bits).alias("key"), (F.col("e.flip") == 0).alias("own"), *nodes.columns)


def _deal_hot(spark: SparkSession, rows: DataFrame, hot_rows: int) -> tuple[DataFrame, str]:
    """Gives rows under keys with over hot_rows rows keys of pairs of blocks; any two rows of a key still meet. Also the path of a table that the result reads."""
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows)
    hot, at = materialise(spark, hot, "simhash-hot")
    if hot.isEmpty():
        return rows, at
    carried = [c for c in rows.columns if c != "key"]
    blocks = F.ceil(F.col("n") / F.lit(hot_rows)).cast("long")
    dealt = rows.join(hot, "key", "left")
    block = F.pmod(F.xxhash64("node", F.lit(7)), blocks)
    others = F.when(F.col("n").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = dealt.select("key", *carried, "n", block.alias("block"), F.explode(others).alias("other"))
    key = F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(key.alias("key"), *carried), at


def near_links(spark: SparkSession, nodes: DataFrame, tau: int = core.MAX_DISTANCE, wide_tau: int | None = None, sample_size: int = SAMPLE, hot_rows: int = HOT) -> DataFrame:
    """(a, b): links between near nodes that keep every component of the full link graph whole.

    nodes is a table (node, fp), or (node, fp, wide) with wide_tau: near are
    fingerprints within tau whose wide ones are within wide_tau.
    """
    n = nodes.count()
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()], np.int64).view(np.uint64)
    parts = core.plan(sample, n, tau)
    carried = ["node", "fp"] + (["wide"] if wide_tau is not None else [])
    row_bytes = 25 + (8 * core.WIDE if wide_tau is not None else 0)
    rows, hot_at = _deal_hot(spark, signatures(nodes.select(carried), parts), hot_rows)
    size = n * row_bytes * sum(len(flips) for *_, flips in parts)
    rows = rows.repartition(n_parts(spark, size), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            got[3] = got[3].view(np.uint64)
            if wide_tau is not None:
                got.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, core.WIDE))
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
            yield found([x[:cut] for x in held])
            held = [x[cut:] for x in held]
        if held is not None:
            yield found(held)

    def found(rows: list[np.ndarray]) -> pa.RecordBatch:
        verify = core.Verifier(rows[3], tau, rows[4] if wide_tau is not None else None, wide_tau or 0)
        a, b = core.links(*rows[:3], verify)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    edges, _ = materialise(spark, rows.mapInArrow(run, "a long, b long"), "simhash-edges")
    discard(spark, hot_at)
    return edges


def _with_class(spark: SparkSession, rows: DataFrame, classes: DataFrame, key: str, common: int = COMMON) -> DataFrame:
    """rows joined with classes (key, n: rows with this key, more) on key.

    At most common keys have over a common-th of the rows each; these go by a
    broadcast, so no key is more than such a share of the shuffle.
    """
    most = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // common
    frequent = classes.filter(F.col("n") > most).drop("n") if most else None
    if frequent is None or frequent.isEmpty():
        return rows.join(classes.drop("n"), key)
    rest = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(classes.filter(F.col("n") <= most).drop("n"), key)
    return rows.join(F.broadcast(frequent), key).unionByName(rest)


def _classes(spark: SparkSession, reps: DataFrame, edges: DataFrame) -> DataFrame:
    """reps (node, first_id, n, more) with root: a node of the component."""
    roots = connected_components(spark, edges)
    return reps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = core.MAX_DISTANCE, hot_rows: int = HOT, common: int = COMMON) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    fps, _ = materialise(spark, fingerprints(docs, id_col, text_col), "simhash-fp")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select(F.col("fp").alias("node"), "fp", "first_id", "n")
    reps, reps_at = materialise(spark, reps, "simhash-reps")
    edges = near_links(spark, reps.select("node", "fp"), tau, hot_rows=hot_rows)
    linked = _classes(spark, reps, edges)
    firsts = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes, _ = materialise(spark, linked.join(firsts, "root").select("fp", "n", "component_id"), "simhash-classes")
    discard(spark, reps_at)
    return _with_class(spark, fps, classes, "fp", common).select("doc_id", "fp", "component_id")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    out = simhash_components(spark, read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, fp, wide) of every row; text_key is the text's MD5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [core.sketch(x) for x in text_bytes(batch.column(2))]
            fp = np.array([x for x, _ in got], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp), pa.array([x for _, x in got], pa.binary())], names=["doc_id", "text_key", "fp", "wide"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key string, fp long, wide binary")


def _text_key(text_col: str) -> Column:
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = core.SIMILARITY, tau: int = core.WORD_DISTANCE, hot_rows: int = HOT, common: int = COMMON) -> DataFrame:
    """(doc_id, text_key, component_id, kept) of every row; kept is the text_key whose row with doc_id component_id stays for its group."""
    rows, _ = materialise(spark, _sketches(docs, id_col, text_col), "simhash-sketches")
    reps = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("wide").alias("wide"))
    reps, reps_at = materialise(spark, reps.withColumn("node", F.monotonically_increasing_id()), "simhash-reps")
    edges = near_links(spark, reps.select("node", "fp", "wide"), tau, core.wide_distance(similarity), hot_rows=hot_rows)
    linked = _classes(spark, reps.select("node", "text_key", "first_id", "n"), edges)
    first = F.min_by(F.struct("first_id", "text_key"), F.struct(F.col("first_id").isNull(), "first_id", "text_key")).alias("f")
    firsts = linked.groupBy("root").agg(first).select("root", F.col("f.first_id").alias("component_id"), F.col("f.text_key").alias("kept"))
    classes, _ = materialise(spark, linked.join(firsts, "root").select("text_key", "n", "component_id", "kept"), "simhash-classes")
    discard(spark, reps_at)
    return _with_class(spark, rows.select("doc_id", "text_key"), classes, "text_key", common)


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each group of copies and near copies: one with its smallest doc_id (null ids come last).

    Rows that go are looked up by doc_id and text in a narrow table of what goes.
    A bitmap of hashes of that table, of bounded size, goes to all tasks first;
    only rows that it doesn't clear meet the table, so few texts are shuffled
    whatever the sizes. Of the texts with the smallest
    doc_id the one with the smallest MD5 stays, and of rows with the same doc_id
    and text one, by the hash of all columns.
    """
    id_name, key, n, row, place, slot, bits = unused(docs.columns, "kept_id", "text_key", "rows", "row", "place", "slot", "bits")
    groups = near_groups(spark, docs, id_col, text_col)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("kept"))
    pairs = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.bool_or(stays).alias("stays"))
    pairs = pairs.filter("NOT stays OR n > 1").select(F.col("doc_id").alias(id_name), F.col("text_key").alias(key), F.when(F.col("stays"), F.col("n")).alias(n))
    pairs, _ = materialise(spark, pairs, "simhash-gone")

    slots = min(SLOTS, pairs.count() // 4 + 1)
    hashed = lambda x: F.pmod(F.xxhash64(x, F.col(key)), F.lit(64 * slots))
    marked = pairs.select(hashed(F.col(id_name)).alias(place)).select(F.shiftrightunsigned(place, 6).alias(slot), F.expr(f"shiftleft(1L, CAST(`{place}` % 64 AS INT))").alias(bits))
    bitmap = F.broadcast(marked.groupBy(slot).agg(F.bit_or(bits).alias(bits)))

    def tested(how: str) -> DataFrame:
        """docs with key that the bitmap doesn't clear (left_semi), or that it does (left_anti)."""
        keyed = docs.withColumn(key, _text_key(text_col)).withColumn(place, hashed(F.col(f"`{id_col}`").cast("long")))
        on = (F.shiftrightunsigned(keyed[place], 6) == bitmap[slot]) & (F.getbit(bitmap[bits], (keyed[place] % 64).cast("int")) == 1)
        return keyed.join(bitmap, on, how).drop(place)

    def matching(some: DataFrame, how: str) -> DataFrame:
        keyed = tested("left_semi")
        on = keyed[id_col].cast("long").eqNullSafe(some[id_name]) & (keyed[key] == some[key])
        return keyed.join(some.select(id_name, key), on, how).select(*[keyed[f"`{c}`"] for c in docs.columns], keyed[key])

    once = tested("left_anti").select(docs.columns).unionByName(matching(pairs, "left_anti").select(docs.columns))
    again = pairs.filter(F.col(n).isNotNull())
    if again.isEmpty():
        return once
    held = matching(again, "left_semi")
    comparable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = held.groupBy(F.col(id_col).alias(id_name), key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*comparable)).alias(row))
    return once.unionByName(first.select(f"{row}.*"))
