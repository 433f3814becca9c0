"""The id export (gzipped JSON lines): decode, gate, and what remains to fetch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fewest entries of a plausible feed, the share of what is mirrored, and the size once exported.
FLOOR, SHARE, KNOWN = 150_000, 0.95, 228_611


class EmptyExport(ValueError):
    """An export without a single id: nothing downstream tells it from a complete mirror."""


def decode_export(lines: DataFrame) -> DataFrame:
    """(position, id, name, popularity, fault) from rows (position, value).

    Blank lines drop out. fault is null for an entry, else unparseable or no_id.
    An id is what stands for a whole number: a number (its whole part), a text
    of digits, true (1) or false (0). popularity counts only if it is a number.
    """
    raw = lines.filter(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    text = lambda path: F.get_json_object("value", path)
    numeric = "BIGINT|INT|DOUBLE|DECIMAL"
    digits = F.regexp_replace(text("$.id"), r"^\s+|\s+$", "")
    found = (
        F.when(kind("$.id") == "BOOLEAN", (text("$.id") == "true").cast("long"))
        .when(kind("$.id").rlike(numeric), F.coalesce(text("$.id").try_cast("long"), text("$.id").try_cast("double").cast("long")))
        .when((kind("$.id") == "STRING") & digits.rlike(r"^[+-]?\d+$"), digits.try_cast("long"))
    )
    fault = F.when(parsed.isNull(), "unparseable").when(found.isNull(), "no_id")
    popularity = F.when(kind("$.popularity").rlike(numeric), text("$.popularity").try_cast("double"))
    return raw.select("position", found.alias("id"), text("$.original_name").alias("name"), popularity.alias("popularity"), fault.alias("fault"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """decode_export() of a (gzipped) file; a line's position is its place in the file.

    A truncated gzip file fails the read. A file without an id raises EmptyExport.
    """
    out = decode_export(spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), "value"))
    if out.filter("fault IS NULL").isEmpty():
        raise EmptyExport(f"{path} has no id")
    return out


def implausible(feed_size: int, mirrored: int) -> str | None:
    """Why a feed of this size must not be applied, or None."""
    if feed_size < FLOOR:
        return f"the feed has {feed_size} entries, fewer than {FLOOR}"
    least = int(SHARE * max(mirrored, KNOWN))
    return f"the feed has {feed_size} entries, fewer than {least}" if feed_size < least else None


def export_path(base: str, day: dt.date) -> str:
    return f"{base.rstrip('/')}/series_ids_{day:%m_%d_%Y}.json.gz"


def newest_export(spark: SparkSession, base: str, today: dt.date, look_back: int = 3, declared: dict[str, int] | None = None) -> str | None:
    """The newest of the exports of today and the days before that is there.

    declared has the byte lengths that a source states for its files; one whose
    length differs raises, since a short file would read as a short feed.
    """
    jvm = spark.sparkContext._jvm
    for k in range(look_back):
        path = jvm.org.apache.hadoop.fs.Path(where := export_path(base, today - dt.timedelta(days=k)))
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(path):
            size = files.getFileStatus(path).getLen()
            if declared and declared.get(where, size) != size:
                raise ValueError(f"{where} has {size} bytes of {declared[where]}")
            return where
    return None


def to_fetch(export: DataFrame, mirrored: DataFrame) -> DataFrame:
    """Entries whose id isn't mirrored yet."""
    return export.filter("fault IS NULL").join(mirrored.select("id").distinct(), "id", "left_anti")


def windows(gaps: DataFrame, start: str, end: str, max_days: int = 14) -> DataFrame:
    """(…, window_start, window_end): date gaps cut into windows of at most max_days; none where start isn't before end."""
    starts = F.explode(F.when(F.col(start) < F.col(end), F.sequence(F.col(start), F.date_sub(F.col(end), 1), F.expr(f"INTERVAL {max_days} DAYS"))))
    return gaps.withColumn("window_start", starts).withColumn("window_end", F.least(F.date_add("window_start", max_days), F.col(end)))


def changed_ids(pages: DataFrame) -> DataFrame:
    """Ids of a paged changes feed (window, page, body) in the order in which they come first; ids that aren't whole numbers drop out."""
    entries = F.try_variant_get(F.try_parse_json("body"), "$.results", "array<variant>")
    each = pages.select("window", "page", F.posexplode(entries).alias("pos", "r"))
    whole = F.schema_of_variant(F.try_variant_get("r", "$.id", "variant")).isin("BIGINT", "INT")
    each = each.filter(whole).withColumn("id", F.try_variant_get("r", "$.id", "long"))
    return each.groupBy("id").agg(F.min(F.struct("window", "page", "pos")).alias("seen")).orderBy("seen").select("id")


#: Pages that the feed serves of one window at most.
MAX_PAGES = 500


def halves(windows: DataFrame, start: str, end: str, pages: str, most: int = MAX_PAGES) -> DataFrame:
    """Windows to ask for again: those that report over most pages, in two halves that share a day; too_long marks a single day, which has none."""
    days = F.datediff(end, start)
    middle = F.date_add(F.col(start), F.floor(days / 2).cast("int"))
    parts = F.when(days > 1, F.array(F.struct(F.col(start).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col(end).alias("b"))))
    own = F.array(F.struct(F.col(start).alias("a"), F.col(end).alias("b")))
    over = windows.filter(F.col(pages) > most).withColumn("_parts", F.coalesce(parts, own)).withColumn("too_long", days <= 1)
    return over.select(*[c for c in windows.columns if c not in (start, end, pages)], "too_long", F.explode("_parts").alias("_p")).select("*", F.col("_p.a").alias(start), F.col("_p.b").alias(end)).drop("_p")
