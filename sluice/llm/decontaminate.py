"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text (an item
longer than that is a block of its own); only one block at a time is sent to the
executors. For each block

1. one scan of the documents counts the block's runs of ``SHORT`` words in the
   whole corpus. An item's seeds are all its runs of ``LONG`` words, and those of
   its short runs that are rare for it: that the corpus has at most ``SLACK``
   times as often as the median one of the item's runs that it has at all. So
   neither runs that stand nowhere nor intact copies elsewhere push a run out;
2. a second scan finds the seeds. A hit reaches as far to both sides as the
   longest item that has this seed; hits whose reaches meet make one passage.
   The passage is aligned, in the same task, with every item that has one of its
   seeds (local alignment of words: match 2, mismatch and gap -1). The score is
   the share of what the whole item would score against itself, and an
   alignment counts if it is worth a run of ``LONG`` words or the whole item.

No shuffle moves a text and no hot passage meets in one task. Nothing is capped:
a seed that a third of the documents share still makes its candidates. A copy
without a seed, so without ``LONG`` intact words and without a rare run of
``SHORT``, is not found.

Words are runs of letters and digits, lower-cased. Null and empty texts and
items without a word match nothing. Items of fewer than ``SHORT`` words are
sought whole. contaminated() gives one row for each doc_id and item: rows that
share a doc_id (null is one too) share it, with their best alignment, and so do
items that share an id; among equal scores the earlier span counts.
drop_contaminated() judges each row by its own text, whatever its doc_id. Other
columns are not read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table, text_groups
from .words import grams, words_of

#: Words of the seeds that always count and of those that count where they are rare.
LONG, SHORT = 5, 3
#: How much commoner than the item's median run a short run may be.
SLACK = 8
#: UTF-8 bytes of items in one block.
BLOCK_BYTES = 8 << 20
#: Score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Bytes of text whose words are found at once; words of passages that are aligned together; cells of an alignment table.
_GROUP, _HELD, _CELLS = 1 << 20, 1 << 21, 1 << 17
_ONE = 1 << 24  # alignment cells hold score * 2^24 + (2^24 - 1 - first word)
FOUND = "doc_id long, item_id long, score double, begin_word long, end_word long"


class Sieve:
    """A sorted set of hashes that tells quickly where others are members of it."""

    def __init__(self, members: np.ndarray) -> None:
        self.members = members
        self.shift = np.uint64(64 - max(20, int(8 * len(members) + 1).bit_length()))
        self.marks = np.zeros(1 << (64 - int(self.shift)), np.bool_)
        self.marks[members >> self.shift] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the hashes, place among the members) of each hash that is a member."""
        at = np.flatnonzero(self.marks[hashes >> self.shift])
        found = hashes[at]
        k = np.minimum(np.searchsorted(self.members, found), max(0, len(self.members) - 1))
        same = self.members[k] == found if len(self.members) else np.zeros(0, np.bool_)
        return at[same], k[same]


class Items:
    """The items of one block: their words and short runs; choose() picks the seeds."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        which, _, _, hashes = words_of(texts)
        cuts = np.searchsorted(which, np.arange(len(texts) + 1))
        self.ids, self.words = [], []
        for item, a, b in zip(ids, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                self.ids.append(item)
                self.words.append(hashes[a:b])
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.sizes = sorted({min(SHORT, n) for n in self.lengths.tolist()} | ({LONG} if (self.lengths >= LONG).any() else set()))
        short, self.owners = self._runs(lambda n: min(SHORT, n))
        self.short = Sieve(np.unique(short))
        self.runs = np.searchsorted(self.short.members, short)  # each item's short runs, by place

    def _runs(self, size: Callable[[int], int]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of all items and the items (by place) that they are of."""
        found = [grams(w, size(len(w))) for w in self.words]
        return np.concatenate(found) if found else np.empty(0, np.uint64), np.repeat(np.arange(len(found)), [len(g) for g in found])

    def choose(self, counts: np.ndarray) -> Seeds:
        """The seeds, by how often the corpus has each short run."""
        seen = counts[self.runs]
        owners, seen, runs = self.owners[seen > 0], seen[seen > 0], self.runs[seen > 0]
        order = np.lexsort((seen, owners))
        owners, seen, runs = owners[order], seen[order], runs[order]
        begins = np.searchsorted(owners, np.arange(len(self.words)))
        sizes = np.diff(np.r_[begins, len(owners)])
        middle = seen[np.minimum(begins + (sizes - 1) // 2, max(0, len(seen) - 1))] if len(seen) else np.zeros(len(self.words), np.int64)
        rare = seen <= SLACK * middle[owners]
        long, long_owners = self._runs(lambda n: LONG if n >= LONG else n)
        return Seeds(self, np.r_[self.short.members[runs[rare]], long], np.r_[owners[rare], long_owners])


class Seeds:
    """Seeds with the items that have them and how far a hit reaches."""

    def __init__(self, items: Items, seeds: np.ndarray, owners: np.ndarray) -> None:
        order = np.argsort(seeds, kind="stable")
        members, begins = np.unique(seeds[order], return_index=True)
        self.sieve, self.owners = Sieve(members), owners[order].astype(np.int32)
        self.begins = np.r_[begins, len(seeds)]
        lengths = items.lengths[self.owners]
        self.reach = np.maximum.reduceat(lengths, begins) if len(begins) else np.empty(0, np.int64)
        self.ids, self.words, self.sizes = items.ids, items.words, sorted({*items.sizes, *(n for n in items.lengths.tolist() if n < LONG)})

    def of(self, hits: np.ndarray) -> list[int]:
        """Items (by place) that have any of these seeds."""
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(self.begins[hits].tolist(), self.begins[hits + 1].tolist(), strict=True)])).tolist()


def occurrences(texts: list[str], sieve: Sieve, sizes: list[int]) -> np.ndarray:
    """Places of the members in the texts, each as often as it occurs."""
    which, _, _, hashes = words_of(texts)
    found = []
    for size in sizes:
        at, k = sieve.places(grams(hashes, size))
        found.append(k[which[at] == which[at + size - 1]])
    return np.concatenate(found) if found else np.empty(0, np.int64)


@dataclass
class Passage:
    """A stretch of a text around hits: its text, place, words, and the items to align."""

    text: int
    first: int
    words: np.ndarray
    items: list[int]


def passages_of(texts: list[str], seeds: Seeds) -> Iterator[Passage]:
    """The passages of the texts, in order."""
    which, _, _, hashes = words_of(texts)
    parts = []
    for size in seeds.sizes:
        at, k = seeds.sieve.places(grams(hashes, size))
        inside = which[at] == which[at + size - 1]
        parts.append((at[inside], k[inside], np.full(int(inside.sum()), size)))
    at, hit, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.empty(0, np.int64)] * 3
    if not len(at):
        return
    begins = np.searchsorted(which, np.arange(len(texts) + 1))
    text_of, reach = which[at], seeds.reach[hit]
    low = np.maximum(begins[text_of], at - reach)
    high = np.minimum(begins[text_of + 1], at + size + reach)
    order = np.argsort(low, kind="stable")
    low, high, hit, text_of = low[order], high[order], hit[order], text_of[order]
    far = np.maximum.accumulate(high)
    cuts = np.r_[0, np.flatnonzero(low[1:] >= far[:-1]) + 1, len(low)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        t, first = int(text_of[a]), int(low[a])
        yield Passage(t, first - int(begins[t]), hashes[first : int(far[b - 1])].copy(), seeds.of(np.unique(hit[a:b])))


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each passage with its item: score, first word, word after the last. All pairs go together, item word by item word."""
    width, length = max(map(len, passages)), max(map(len, items))
    table, words = np.zeros((len(passages), width), np.uint64), np.zeros((len(items), length), np.uint64)
    for k, (p, q) in enumerate(zip(passages, items, strict=True)):
        table[k, : len(p)] = p
        words[k, : len(q)] = q
    words[words == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)  # what fills up an item equals nothing that fills up a passage
    place = np.arange(width + 1, dtype=np.int64)
    fresh = (_ONE - 1) - place  # score 0, beginning here
    slope = place[1:] * _ONE
    cells = np.broadcast_to(fresh, (len(passages), width + 1)).copy()
    best, best_end = np.zeros(len(passages), np.int64), np.zeros(len(passages), np.int64)
    rows = np.arange(len(passages))
    for word in words.T:
        now = cells[:, :-1] + np.where(table == word[:, None], 2 * _ONE, -_ONE)
        np.maximum(now, cells[:, 1:] - _ONE, out=now)
        np.copyto(now, np.broadcast_to(fresh[1:], now.shape), where=now < _ONE)
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        cells[:, 1:] = now
        end = now.argmax(axis=1)
        top = now[rows, end]
        better = top > best
        best = np.where(better, top, best)
        best_end = np.where(better, end + 1, best_end)
    return best >> 24, (_ONE - 1) - (best & (_ONE - 1)), best_end


def scored(passages: list[Passage], seeds: Seeds, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, begin, end) of each pair of a passage and an item that counts."""
    pairs = [(k, i) for k, p in enumerate(passages) for i in p.items]
    # pairs of like sizes go together, so that little of an alignment table is fill
    pairs.sort(key=lambda x: (len(seeds.words[x[1]]).bit_length(), len(passages[x[0]].words), x))
    begin = 0
    while begin < len(pairs):
        end = begin + 1
        least = len(passages[pairs[begin][0]].words)
        bits = len(seeds.words[pairs[begin][1]]).bit_length()
        while end < len(pairs) and len(seeds.words[pairs[end][1]]).bit_length() == bits:
            width = len(passages[pairs[end][0]].words)
            if width > 1.5 * least + 16 or width * (end - begin + 1) > _CELLS:
                break
            end += 1
        part = pairs[begin:end]
        found = align([passages[k].words for k, _ in part], [seeds.words[i] for _, i in part])
        for (k, i), points, a, b in zip(part, *(x.tolist() for x in found), strict=True):
            n = len(seeds.words[i])
            if points >= 2 * threshold * n and points >= 2 * min(n, LONG):
                yield passages[k].text, seeds.ids[i], points / (2 * n), passages[k].first + a, passages[k].first + b
        begin = end


def matches(column: pa.Array, seeds: Seeds, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """scored() of all texts of a column; passages are held until they have a few million words."""
    out: list[tuple[int, int, float, int, int]] = []
    held: list[Passage] = []
    size = 0
    for a, _, texts in text_groups(column, _GROUP):
        for p in passages_of(texts, seeds):
            p.text += a
            held.append(p)
            size += len(p.words)
        if size > _HELD:
            out += scored(held, seeds, threshold)
            held, size = [], 0
    return [*out, *scored(held, seeds, threshold)]


def _blocks(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Items]:
    """The items, in blocks of about limit bytes."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // limit)
    rows = rows.distinct()
    if n > 1:
        rows, _ = materialise(spark, rows, "decontaminate-items")
    for k in range(n):
        block = sorted((rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows).collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        items = Items([r.item_id for r in block], [r.text for r in block])
        if items.words:
            yield items


def _seeds(spark: SparkSession, texts: DataFrame, items: Items) -> Seeds:
    """The seeds of a block, by its runs' counts in all texts. The driver gets a number for each run of the block."""
    shared = spark.sparkContext.broadcast((items.short, [n for n in items.sizes if n <= SHORT]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, sizes = shared.value
        total = np.zeros(len(sieve.members), np.int64)
        for batch in batches:
            for _, _, held in text_groups(batch.column(0), _GROUP):
                total += np.bincount(occurrences(held, sieve, sizes), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["run", "n"])

    got = texts.select("text").mapInArrow(count, "run int, n long").groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    counts = np.zeros(len(items.short.members), np.int64)
    counts[got["run"].to_numpy()] = got["n"].to_numpy()
    return items.choose(counts)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, begin_word, end_word): documents with a passage that aligns with an item at threshold or more; the best passage of each pair."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], FOUND)
    for items in _blocks(spark, benchmark, item_col, item_text_col, block_bytes):
        out = out.union(_found(spark, texts, _seeds(spark, texts, items), threshold))
    best = F.max_by(F.struct("begin_word", "end_word"), F.struct("score", -F.col("begin_word"), -F.col("end_word")))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("at")).select("doc_id", "item_id", "score", "at.begin_word", "at.end_word")


def _found(spark: SparkSession, texts: DataFrame, seeds: Seeds, threshold: float) -> DataFrame:
    """FOUND rows of every alignment that counts."""
    shared = spark.sparkContext.broadcast(seeds)
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = matches(batch.column(1), shared.value, threshold)
            rest = [pa.array([x[k] for x in got], kind) for k, kind in enumerate(kinds, 1)]
            yield pa.record_batch([batch.column(0).take(pa.array([x[0] for x in got], pa.int64())), *rest], names=["doc_id", "item_id", "score", "begin_word", "end_word"])

    return texts.mapInArrow(scan, FOUND)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, begin_word, end_word of every contaminated document and the items in it."""
    return contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text isn't contaminated, judged beside the row: no text is shuffled and no id is looked up."""
    at = docs.columns.index(text_col)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def without(seeds: Seeds, rows: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(seeds)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, np.bool_)
                keep[[t for t, *_ in matches(batch.column(at), shared.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(clean, docs.schema)

    out = docs
    for items in _blocks(spark, benchmark, "item_id", "text", block_bytes):
        out = without(_seeds(spark, texts, items), out)
    return out
