"""What the operators of this subpackage share: tables in the shared folder and batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a batch are handled in groups of about this many bytes.
GROUP_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset in local mode (tests) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is shared."""
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, tag: str) -> str:
    """A place in the shared folder, below the application's id, that nothing has been written to."""
    return f"{shared_root(spark)}/sluice/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, tag: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Writes df below the shared folder; returns the table read from there, and its path.

    This cuts the lineage: a lost executor costs no more than the tasks that
    read the table, and what was costly to make is made once.
    """
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that materialise() has written and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without a detour over str."""
    return column.cast(pa.binary()).to_pylist()


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, texts) of a string column in groups of about limit bytes; null is empty. Only one group's texts are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = size = 0
    for k, n in enumerate(sizes):
        if size and size + n > limit:
            yield begin, k, [x or "" for x in column.slice(begin, k - begin).to_pylist()]
            begin, size = k, 0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes), [x or "" for x in column.slice(begin).to_pylist()]


def utf8_size(text: str | bytes | None) -> int:
    """Bytes of a text in UTF-8."""
    if not text:
        return 0
    return len(text) if isinstance(text, bytes) or text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def groups_of(texts: list, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges that hold about limit bytes each; a longer text is a group of its own."""
    begin = size = 0
    for k, text in enumerate(texts):
        n = utf8_size(text)
        if size and size + n > limit:
            yield begin, k
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def id_crc(doc_id: str | Column) -> Column:
    """crc32 of the id written as text; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary"))


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_parts(spark: SparkSession, size: int, per_part: int = 64 << 20) -> int:
    """Partitions for a shuffle of size bytes: the session's number, more where these would hold over per_part bytes each."""
    return max(n_shuffle(spark), -(-int(size) // per_part))


#: Bytes of text for a byte of a compressed table, about; a size from which a plan's statistics only say that they don't know.
_EXPANDED, _UNKNOWN = 3, 1 << 56


def about_bytes(df: DataFrame, text_col: str) -> int:
    """About how many bytes the texts have: by the plan's statistics (for a Parquet table, its files' sizes), or counted where these know nothing."""
    planned = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if planned < _UNKNOWN:
        return _EXPANDED * planned
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened where a caller's column has one of them (in any case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
