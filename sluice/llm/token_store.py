"""A token store: the ids of all documents in doc_id order, randomly addressable.

write_store() deals the texts by ranges of doc_id, sorts and encodes them, and
writes two Parquet tables below a folder:

segments/  one row for each segment of directly addressable codes (see dac) of
           about ``SEGMENT`` ids, a document never across two: (part, segment,
           first: ids of the same task before it, n_tokens, doc_ids, sizes:
           int64 and uint32 arrays as bytes, payload), in small row groups
index/     (begin, end, part, segment) of each, in order of begin: the ids of
           the whole store that it holds

So ids at any place are found by two look-ups that Parquet's statistics prune,
and no more of a payload is decoded than was asked for. Only one total for each
task goes to the driver.

Null texts count as empty and have the end id only. Null doc_ids come first;
rows with equal doc_ids follow each other in the order of their texts' xxhash64,
and the ranges are dealt by both, so an id that a third of the rows share is
split over many tasks. Other columns are not read. An empty
table gives an empty store. A document's ids are one value, for which Spark's
limit of 2 GB holds as it does for its text.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac
from .common import about_bytes, groups_of, n_parts, new_path, read_table, text_groups
from .pieces import Memo, words

#: Ids in a segment, more or less; the id that ends each document.
SEGMENT, END_ID = 1 << 18, 1
FORMAT = "part int, segment int, first long, n_tokens long, doc_ids binary, sizes binary, payload binary"
INDEX = "begin long, end long, part int, segment int"
_ROW_GROUP = 4 << 20
_NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id


#: A word of Latin letters (as Latin-1 has them) and ASCII marks after it: two matches of the pattern, each encoded on its own.
_PLAIN = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")
#: Characters that one call of the library gets; bytes of text whose words are looked up together; words that the memo of whole parts holds.
_CALL, _GROUP, _PARTS = 1 << 16, 4 << 20, 500_000


def _joined(library, parts: list[str]) -> list[bytes]:
    """Ids of each part, encoded together as one text with blanks between; offsets tell whose a token is."""
    out: list[bytes] = []
    for a, b in groups_of(parts, _CALL):
        group = parts[a:b]
        found = library.encode(" ".join(group), add_special_tokens=False)
        sizes = np.fromiter(map(len, group), np.int64, len(group)) + 1
        starts = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
        packed = np.array(found.ids, np.uint32).tobytes()
        cuts = (4 * np.searchsorted(starts, np.cumsum(sizes))).tolist()
        out += [packed[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]
    return out


# What a vocabulary file must say of white space and matches for the memo of words to be right.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_MATCHES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def works_by_words(spec: dict) -> bool:
    """Whether a tokenizer file drops white space, lower-cases, and works between white space as encoder() takes for granted."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split, rest = pre[0], pre[1:]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZER
        and split.get("type") == "Split" and split.get("pattern") == {"Regex": _MATCHES} and split.get("behavior") == "Removed" and split.get("invert") is True
        and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in rest] == [("ByteLevel", False, False)]
        and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """From texts to ids (uint32, as bytes), as the tokenizers library gives them without special tokens added.

    For a vocabulary that drops white space and works between it, what stands
    between white space is looked up in a memo. A plain word with marks after it
    that is new there is put together from the word in lower case and the marks,
    which have a memo of their own; what is new in that goes to the library.
    With any other vocabulary the library gets whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        by_words = works_by_words(json.load(f))
    if not by_words:
        return lambda texts: [np.array(x.ids, np.uint32).tobytes() for a, b in groups_of(texts, _CALL) for x in library.encode_batch_fast(texts[a:b], add_special_tokens=False)]
    matches = Memo(lambda parts: _joined(library, parts))

    def encode(parts: list[str]) -> list[bytes]:
        found = list(map(_PLAIN.fullmatch, parts))
        heads = [m[1].lower() if m else x for m, x in zip(found, parts, strict=True)]
        marks = [m[2] if m else "" for m in found]
        known = matches.learn((heads, marks))
        return [known[h] + known[m] if m else known[h] for h, m in zip(heads, marks, strict=True)]

    memo = Memo(encode, _PARTS)

    def whole(texts: list[str]) -> list[bytes]:
        lists = [words(t) for t in texts]
        known = memo.learn(lists)
        return [b"".join(map(known.__getitem__, x)) for x in lists]

    return whole


def _segments(vocabulary: str, end_id: int, segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a task's (doc_id, text) in order to rows of FORMAT."""
    names = ["part", "segment", "first", "n_tokens", "doc_ids", "sizes", "payload"]
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)))
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, first, size = TaskContext.get().partitionId(), 0, 0, 0
        make = encoder(vocabulary)
        held: list[bytes] = []
        ids: list[int] = []

        def close() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(held), np.uint32)
            sizes = np.array([len(x) // 4 for x in held], np.uint32)
            row = (part, k, first, len(tokens), np.array(ids, np.int64).tobytes(), sizes.tobytes(), dac.encode(tokens))
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in text_groups(batch.column(1), _GROUP):
                for doc_id, packed in zip(doc_ids[a:b], make(texts), strict=True):
                    ids.append(_NO_ID if doc_id is None else doc_id)
                    held.append(packed + end)
                    size += len(packed) // 4 + 1
                    if size >= segment:
                        yield close()
                        k, first, size = k + 1, first + size, 0
                        held.clear()
                        ids.clear()
        if held:
            yield close()

    return run


def write_store(spark: SparkSession, docs: DataFrame, vocabulary: str, where: str, end_id: int = END_ID, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the store of docs below the folder where."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    # texts, not ids, are dealt: of short invented words the ids take more bytes
    dealt = rows.repartitionByRange(n_parts(spark, about_bytes(docs, text_col)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(_segments(vocabulary, end_id, segment), FORMAT)
    made.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP).parquet(f"{where}/segments")
    segments = spark.read.schema(FORMAT).parquet(f"{where}/segments")
    starts, total = [], 0
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each task that wrote
        starts.append((r.part, total))
        total += r.n
    begin = F.col("start") + F.col("first")
    index = segments.select("part", "segment", "first", "n_tokens").join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    index.select(begin.alias("begin"), (begin + F.col("n_tokens")).alias("end"), "part", "segment").orderBy("begin").write.parquet(f"{where}/index")


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a written store."""
    segments = spark.read.schema(FORMAT).parquet(f"{where}/segments")
    index = spark.read.schema(INDEX).parquet(f"{where}/index")
    starts = {r.part: r.start for r in index.groupBy("part").agg(F.min("begin").alias("start")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
                ends = np.cumsum(sizes)
                begins = ends - sizes
                codes = dac.Segment(row["payload"])
                crcs = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(ids, mask=ids == _NO_ID), pa.array(begins + (starts[row["part"]] + row["first"])), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def segments_with(spark: SparkSession, where: str, begin: int, end: int) -> DataFrame:
    """(at, payload) of the segments that hold any of the ids begin to end - 1 of the whole store."""
    index = spark.read.schema(INDEX).parquet(f"{where}/index").filter((F.col("begin") < end) & (F.col("end") > begin))
    wanted = index.collect()  # a row for each 262,144 ids that were asked for
    segments = spark.read.schema(FORMAT).parquet(f"{where}/segments")
    near = F.col("part").isin(sorted({r.part for r in wanted})) & F.col("segment").isin(sorted({r.segment for r in wanted}))
    places = spark.createDataFrame([(r.part, r.segment, r.begin) for r in wanted], "part int, segment int, at long")
    return segments.filter(near).join(F.broadcast(places), ["part", "segment"]).select("at", "payload")


def tokens_at(spark: SparkSession, where: str, begin: int, end: int) -> list[int]:
    """Ids begin to end - 1 of the whole store: the segments that hold them are found by the index, and cut on the executors."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = dac.Segment(payload.as_py())
                ids = codes.slice(max(0, begin - at), max(0, min(len(codes), end - at)))
                yield pa.record_batch([pa.array([at]), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["at", "ids"])

    if begin >= end:
        return []
    rows = segments_with(spark, where, begin, end).mapInArrow(cut, "at long, ids array<long>").collect()
    return [x for r in sorted(rows) for x in r.ids]


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written store, by word_bpe_49k.json."""
    import public_tokenizers

    where = new_path(spark, "token-store")
    write_store(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), where)
    return read_documents(spark, where)
