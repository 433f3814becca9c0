"""Language identification with rank-order n-gram profiles.

A profile is a language's ``TOP`` most frequent n-grams (1 to ``MAX_N`` letters,
word ends as blanks) in order. A text is compared by the out-of-place distance
of its own most frequent n-grams. Every label that occurs is a language; each
profile comes from at most ``PER_LANGUAGE`` of its labelled documents, drawn by
the hash of doc_id (rows that repeat an id are drawn in the order of their
texts). A language's n-grams are ranked in ``BUCKETS`` parts on the executors,
and the driver gets at most ``TOP`` of each part. Every document is predicted
from its whole text.

Null texts and texts without a letter give ``und`` and score 0. Null labels
teach nothing. Without any labelled text all is ``und``. Ties between languages
go to the first by name. Repeated rows each have their row. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_crc, n_shuffle, read_table, text_groups
from .language_core import TOP, Profiles, gram_counts

PER_LANGUAGE, BUCKETS = 1000, 8
#: Labels that n-gram counts can number.
_MOST_LABELS = 1 << 20
#: Characters handled at once: a group's n-grams are sorted together.
_GROUP = 1 << 19
#: What the pipeline's stage takes for no known language.
MIN_SCORE = 0.05


def fit_profiles(spark: SparkSession, labelled: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> Profiles:
    """Profiles from labelled (doc_id, text, lang) rows: a bounded sample of each language, drawn evenly by the hash of doc_id."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return Profiles([], [], [])
    if len(sizes) > _MOST_LABELS:
        raise ValueError(f"lang has {len(sizes)} values, more than {_MOST_LABELS}")
    sizes.sort(key=lambda r: r.lang)
    # enough of each language's hash range that the sample is in it, all but surely
    wanted = [(k, r.lang, min(1 << 31, int((1 << 31) * (1.2 * per_language + 50) / r.n))) for k, r in enumerate(sizes)]
    share = spark.createDataFrame(wanted, "k int, lang string, share long")
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1))
    drawn = labelled.withColumn("draw", draw).join(F.broadcast(share), "lang").filter("draw < share").select("doc_id", "text", "k", "draw")
    first = Window.partitionBy("k").orderBy("draw", "doc_id", "text")
    sample = drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_language).select("k", "text").repartition(n_shuffle(spark))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy()
            for a, b, texts in text_groups(batch.column(1), _GROUP):
                k, gram, n = gram_counts(texts, ks[a:b])
                yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(gram), pa.array(n)], names=["k", "gram", "n"])

    counts = sample.mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    part = F.pmod(F.xxhash64("gram"), F.lit(buckets))
    best = Window.partitionBy("k", "part").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("part", part).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= TOP).select("k", "gram", "n").toArrow()
    k, gram, n = (rows[c].to_numpy() for c in ("k", "gram", "n"))
    order = np.lexsort((gram, -n, k))
    k, gram = k[order], gram[order]
    grams, ranks, kept = [], [], []
    cuts = np.searchsorted(k, np.arange(len(sizes) + 1))
    for r, a, b in zip(sizes, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = gram[a : min(b, a + TOP)]
        if len(own):
            by_gram = np.argsort(own)
            kept.append(r.lang)
            grams.append(own[by_gram])
            ranks.append(by_gram)
    return Profiles(kept, grams, ranks)


def identify(spark: SparkSession, docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = spark.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, texts in text_groups(batch.column(1), _GROUP):
                name, score = shared.value.predict(texts)
                names += name
                scores += score
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_crc(doc_id) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt from those that aren't held out."""
    docs = read_table(spark, sf_dir, "documents")
    profiles = fit_profiles(spark, docs.filter(id_crc("doc_id") % 5 != 0).select("doc_id", "text", "lang"))
    return identify(spark, docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs without those whose language can't be told: no letter in the text, or a score below min_score.

    Works within one pass: the prediction is made beside the row, so no text is
    shuffled. Null and empty texts go; a row that repeats another goes or stays
    with it.
    """
    profiles = fit_profiles(spark, docs.filter(id_crc("doc_id") % 5 != 0).select("doc_id", "text", "lang"))
    shared = spark.sparkContext.broadcast(profiles)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for _, _, texts in text_groups(batch.column(at), _GROUP):
                name, score = shared.value.predict(texts)
                keep += [n != "und" and s >= min_score for n, s in zip(name, score, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
