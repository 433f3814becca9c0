"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are values beside a key (password, token ...), private key blocks,
and runs of 16 or more key characters with a digit. The forest sees length and
character make-up, the likelihood of the character transitions under ordinary
words, how much a dictionary covers, the path (the source column) and the
neighbouring words. Dictionary and transitions come from all documents, counted
on the executors: the dictionary has the words of two documents or more, the
transitions come from every word, as often as documents have it. The driver and
each worker hold at most ``MOST`` words and ``MOST`` transitions; beyond that
the threshold rises to the lowest count that this many reach. Words longer than
a feature can look up (``secret_core.AROUND`` characters) are left out of the
dictionary. The forest learns from labelled findings: rows (value, before,
after, path, label) that the caller gives, or else two kinds together: those of
secret_core.labelled_findings(), and the corpus's own, drawn from at most
``DOCS`` documents with a candidate (by the hash of doc_id, those whose crc32
modulo 5 is 0 held out) and labelled where the surroundings leave no doubt
(secret_core.sure_label), at most ``FINDINGS`` of them.

Null and empty texts have no candidates; null paths, and all where there is no
path column, count as empty. Positions count characters. Repeated rows each
have their findings, and equal ones equal findings; candidates never overlap,
so there are no ties between them. A document's other columns are not read by
scan() and stay as they are in redact(). Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from . import secret_core as core
from .common import discard, id_crc, materialise, read_table, text_groups

#: Words and transitions that a model holds at most, words that a task holds while it counts.
MOST, _HELD = 150_000, 100_000
THRESHOLD = 0.5
#: Documents and findings of the corpus that a forest learns from at most; longer values are left to the patterns.
DOCS, FINDINGS, _LONGEST = 1000, 2000, 4096
#: The commonest dictionary words, which stand around the findings written by pattern.
AROUND_WORDS = 2000
MASK = "[SECRET]"
_WORDS = re.compile(r"[^\W\d_]{4,}")


class Model:
    """Dictionary, transitions and forest."""

    def __init__(self, language: core.Language, trees: forest.Forest) -> None:
        self.language, self.trees = language, trees

    def judge(self, texts: list[str | None], paths: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(begin, end, score) of each candidate of each text."""
        spans = [core.candidates(x) if x else [] for x in texts]
        held = [core.rows(x, s, p or "", self.language) for x, s, p in zip(texts, spans, paths, strict=True) if s]
        scores = iter(self.trees.predict(np.concatenate(held)).tolist() if held else [])
        return [[(a, b, next(scores)) for a, b in s] for s in spans]


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): the documents with each word; counted in bounded tables before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for batch in batches:
            for _, _, held in text_groups(batch.column(0)):
                for x in held:
                    got.update({w.lower() for w in _WORDS.findall(x)})
                if len(got) > _HELD:
                    yield _counted(got)
                    got = Counter()
        yield _counted(got)

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _transitions(words: DataFrame) -> DataFrame:
    """(word, n): the character pairs of the words, ends marked, each word as often as documents have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in zip("^" + w, w + "$", strict=True):
                    got[a + b] += n
            yield _counted(got)

    return words.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(got: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["word", "n"])


def _frequent(counts: DataFrame, least: int, most: int) -> dict[str, int]:
    """The rows (word, n) with n of at least least, or of the lowest threshold above it that most rows reach at the most."""
    sizes = counts.filter(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).collect()
    total, threshold = 0, least
    for k, r in enumerate(sizes):
        total += r.rows
        if total > most:
            threshold = sizes[k - 1].n if k else r.n + 1
            break
    return {r.word: r.n for r in counts.filter(F.col("n") >= threshold).collect()}


def fit(spark: SparkSession, docs: DataFrame, findings: list[tuple[str, str, str, str, int]] | None = None, sample: int | None = None, most: int = MOST) -> Model:
    """A model from the words of all docs (or of a sample, where one is asked for) and labelled findings."""
    drawn = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    if sample is not None:
        ids = drawn.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = drawn.join(F.broadcast(ids.distinct()), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(sample)  # at most sample ids
    words, words_at = materialise(spark, _word_counts(drawn.select("text")), "secrets-words")
    pairs, pairs_at = materialise(spark, _transitions(words), "secrets-transitions")
    counts = _frequent(words.filter(F.length("word") <= core.AROUND), 2, most)
    firsts = {r.a: r.n for r in pairs.groupBy(F.substring("word", 1, 1).alias("a")).agg(F.sum("n").alias("n")).collect()}
    language = core.Language(frozenset(counts), {p: math.log(n / firsts[p[0]]) for p, n in _frequent(pairs, 1, most).items()})
    discard(spark, words_at)
    discard(spark, pairs_at)
    given = findings
    if given is None:
        given = core.labelled_findings(sorted(counts, key=lambda w: (-counts[w], w))[:AROUND_WORDS]) + corpus_findings(docs)
    x = np.array([core.features(v, b, a, p, language) for v, b, a, p, _ in given], np.float64)
    return Model(language, forest.fit(x, np.array([label for *_, label in given])))


def _judged(docs: DataFrame, text_col: str, path_col: str) -> list:
    """The text and path columns; a frame without a path column has empty paths."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    return [F.col(text_col).cast("string").alias("text"), path.alias("path")]


def corpus_findings(docs: DataFrame, held_out: bool = False, most_docs: int = DOCS, most: int = FINDINGS) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, before, after, path, label) of the documents that aren't held out, or of those that are.

    The driver sees most_docs ids and most findings; texts stay on the executors.
    """
    part = F.coalesce((id_crc("doc_id") % 5 == 0) == F.lit(held_out), F.lit(False))
    some = docs.filter(part & F.col("text").rlike("[0-9A-Za-z_+/=-]{16}"))
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, rows = batch.column(1).to_pylist(), []
            for begin, _, texts in text_groups(batch.column(0)):
                for k, x in enumerate(texts):
                    for a, b in core.candidates(x):
                        found = (x[a:b], x[max(0, a - core.AROUND) : a], x[b : b + core.AROUND])
                        known = core.sure_label(*found) if b - a <= _LONGEST else None
                        if known is not None:
                            rows.append((*found, paths[begin + k] or "", known))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    names = ["value", "before", "after", "path", "label"]
    schema = pa.schema([*((n, pa.string()) for n in names[:4]), ("label", pa.int32())])
    rows = some.join(F.broadcast(ids), "doc_id", "left_semi").select(*_judged(some, "text", "source"))
    found = rows.mapInArrow(label, "value string, before string, after string, path string, label int")
    return [tuple(r) for r in found.orderBy(F.xxhash64(*names), *names).limit(most).collect()]


def scan(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, begin, end, value_sha256, score, secret) of every candidate."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(2).to_pylist()
            for first, end, texts in text_groups(batch.column(1)):
                got = [(k, a, b, s) for k, found in enumerate(shared.value.judge(texts, paths[first:end])) for a, b, s in found]
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array([first + k for k, *_ in got], pa.int64())),
                        pa.array([a for _, a, _, _ in got], pa.int64()),
                        pa.array([b for _, _, b, _ in got], pa.int64()),
                        pa.array([hashlib.sha256(texts[k][a:b].encode("utf-8", "surrogatepass")).hexdigest() for k, a, b, _ in got], pa.string()),
                        pa.array([s for *_, s in got], pa.float64()),
                        pa.array([s >= threshold for *_, s in got], pa.bool_()),
                    ],
                    names=["doc_id", "begin", "end", "value_sha256", "score", "secret"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_judged(docs, text_col, path_col))
    return rows.mapInArrow(run, "doc_id long, begin long, end long, value_sha256 string, score double, secret boolean")


def redact(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = THRESHOLD, path_col: str = "source") -> DataFrame:
    """docs with every secret in text replaced by MASK, and n_chars (where there is one) counted anew for changed texts."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    path_at, chars_at = (docs.columns.index(c) if c in docs.columns else None for c in (path_col, "n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(path_at).cast(pa.string()).to_pylist() if path_at is not None else [None] * batch.num_rows
            changed = {}
            for first, end, texts in text_groups(batch.column(at)):
                for k, found in enumerate(shared.value.judge(texts, paths[first:end])):
                    cuts = [(a, b) for a, b, s in found if s >= threshold]
                    if cuts:
                        edges = [0, *(x for cut in cuts for x in cut), len(texts[k])]
                        changed[first + k] = MASK.join(texts[k][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            if changed:
                batch = _replaced(batch, at, changed)
                if chars_at is not None:
                    batch = _replaced(batch, chars_at, {k: len(x) for k, x in changed.items()})
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _replaced(batch: pa.RecordBatch, at: int, values: dict) -> pa.RecordBatch:
    """The batch with the values at these rows of a column."""
    mask = np.zeros(batch.num_rows, np.bool_)
    mask[list(values)] = True
    field = batch.schema.field(at)
    column = pc.replace_with_mask(batch.column(at), pa.array(mask), pa.array([values[k] for k in sorted(values)], field.type))
    return batch.set_column(at, field, column)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, begin, end, value_sha256, score, secret of every candidate in every document."""
    docs = read_table(spark, sf_dir, "documents")
    return scan(spark, docs, fit(spark, docs))
