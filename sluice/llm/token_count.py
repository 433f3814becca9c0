"""Token counts of whole texts, as the tokenizers or sentencepiece library gives them.

Arrow functions send (doc_id, text) batches to Python and return lengths only.
For the byte-level vocabularies every text is cut at safe boundaries (before
white space that follows something else); a group of texts of about 2 MB gives
one set of distinct pieces, which go to the library in batches of about equal
bytes, and a bounded memo keeps the counts of pieces seen before. So memory
doesn't follow the length of a text or the number of documents. Other
vocabularies get whole texts in batches balanced by bytes.

Null texts count as empty: 0 bytes, 0 tokens. Special strings inside a text are
what the library makes of them by default. Repeated rows each have their row.
Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups_of, read_table, text_groups
from .pieces import Memo, safe_pieces

#: Bytes that one call of the library gets at most, unless one piece alone has more.
CALL_BYTES = 1 << 18
LIMIT = 512


def _balanced(items: list[str], limit: int = CALL_BYTES) -> Iterator[list[str]]:
    for a, b in groups_of(items, limit):
        yield items[a:b]


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their token counts, kept for the worker's life."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for part in _balanced(texts) for x in model.encode(part, num_threads=1)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    def encode(items: list[str]) -> list[int]:
        return [len(x) for part in _balanced(items) for x in library.encode_batch_fast(part, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut = spec["pre_tokenizer"] or {}
    specials = spec["added_tokens"]
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if not plain or any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in specials):
        return encode
    memo = Memo(encode)

    def pieced(texts: list[str]) -> list[int]:
        lists = [safe_pieces(t) for t in texts]
        known = memo.learn(lists)
        return [sum(map(known.__getitem__, x)) for x in lists]

    return pieced


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens: list[int] = []
            for _, _, texts in text_groups(batch.column(1)):
                tokens += count(texts)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document by byte_bpe_50k.json."""
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
