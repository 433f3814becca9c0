"""Document quality from line labels of a linear-chain conditional random field.

Each line's features (length, shares of character classes, word length, how it
begins and ends, whether it stands twice, words that repeat the one before) go
in beside those of the lines before and after it. Forward-backward marginals of
the state good, weighted by line length, give the document's quality, calibrated
to a probability on the training documents. All messages are products of 2x2
matrices computed by doubling over all lines of a batch, so a document of a
million lines takes no more steps than its logarithm.

The field is fitted on a bounded sample of labelled documents: in the order of
the hash of doc_id, at most ``PER_CLASS`` of each class and as many of these as
have ``LINES`` lines together (a document with more lines than that is scored
but not learnt from); every line has its document's label. Executors turn the
sample's texts into line features and one task fits the field, so the driver
gets ids and the field's numbers, and no text.

Null texts count as empty; an empty text has one empty line and gets a score
like any other. Without labels of both classes every score is 0.5. A doc_id
that labels.quality marks more than once counts with its smallest mark, null
marks and marks but 0 and 1 don't count; of the rows that share a labelled
doc_id the one with the smallest text is learnt from. Repeated documents each
have their row. Other columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import crf_core
from .common import discard, id_crc, materialise, read_table, text_groups

#: Labelled documents of each class, and lines of them, that the field is fitted on at most.
PER_CLASS, LINES = 1500, 100_000
#: Bytes of text whose lines are handled at once.
_GROUP = 1 << 20


def _line_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(quality, lines, own, length) of each (quality, text) row: features as float64 bytes, lengths as int64 bytes."""
    for batch in batches:
        for a, b, texts in text_groups(batch.column(1), _GROUP):
            own, length, n_lines = crf_core.line_features(texts)
            cuts = np.cumsum(n_lines)[:-1]
            parts = [pa.array([x.tobytes() for x in np.split(y, cuts)], pa.binary()) for y in (own, length.astype(np.int64))]
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n_lines), *parts], names=["quality", "lines", "own", "length"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the field's numbers, from _line_table() rows; none without both classes."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    good = np.array([r["quality"] for r in rows], np.int64)
    if len(set(good.tolist())) == 2:
        own = np.frombuffer(b"".join(r["own"] for r in rows), np.float64).reshape(-1, len(crf_core.NAMES))
        length = np.frombuffer(b"".join(r["length"] for r in rows), np.int64)
        field = crf_core.fit(own, length, np.array([r["lines"] for r in rows]), good)
        yield pa.record_batch([pa.array([field.pack().tolist()], pa.list_(pa.float64()))], names=["numbers"])


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lines: int = LINES) -> crf_core.Crf | None:
    """The field, from labels (doc_id, quality) and docs (doc_id, text); None without both classes."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    drawn = [marks.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # at most 2 * per_class ids, so the broadcast is bounded
    known = docs.select("doc_id", text.alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    known, at = materialise(spark, known.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "quality-sample")
    table = known.select("doc_id", "quality", "text", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    # ids and line counts decide who is in; texts are looked at after that
    within = table.filter(F.col("n") <= lines).select("doc_id", "quality", F.sum("n").over(order).alias("so_far")).filter(F.col("so_far") <= lines)
    chosen = known.join(F.broadcast(within.select("doc_id")), "doc_id").select("quality", "text")
    made = chosen.mapInArrow(_line_table, "quality int, lines long, own binary, length binary")
    one = made.repartition(1).sortWithinPartitions("quality", "lines", "length", "own")  # at most 2 * lines lines
    found = one.mapInArrow(_fit, "numbers array<double>").collect()
    discard(spark, at)
    return crf_core.Crf.unpack(np.array(found[0].numbers)) if found else None


def score(spark: SparkSession, docs: DataFrame, crf: crf_core.Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = spark.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if shared.value is not None:
                for a, b, texts in text_groups(batch.column(1), _GROUP):
                    out[a:b] = shared.value.score(texts)
            yield pa.record_batch([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def score_lines(spark: SparkSession, docs: DataFrame, crf: crf_core.Crf) -> DataFrame:
    """(doc_id, good array<double>): the marginal of each line of every row; a null or empty text has one line."""
    shared = spark.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_groups(batch.column(1), _GROUP):
                own, _, n_lines = crf_core.line_features(texts)
                good = shared.value.lines(own, n_lines)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_lines)].astype(np.int32)), pa.array(good))
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists], names=["doc_id", "good"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, good array<double>")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from labels that aren't held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    crf = fit_quality(spark, docs, labels.filter(id_crc("doc_id") % 3 != 1))
    out = score(spark, docs, crf)
    return out.select("doc_id", F.coalesce(id_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
