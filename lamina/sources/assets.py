"""Files at the edge: scanning, sniffing, identity, bundle members and archive layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.scans import running_sums

C = F.col

# First four bytes of the kinds that are told apart.
MAGIC = {"archive": "504B0304", "image": "38425053", "rejected": "377ABCAF"}


def scan_assets(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of every file; content is read only if selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def asset_kind(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(head == magic, name).otherwise(kind)
    return F.coalesce(kind, F.lit("unsupported"))


def classify_assets(assets: DataFrame) -> DataFrame:
    """Adds ``kind`` and, for files that cannot be opened, ``reason``."""
    reason = (
        F.when(C("kind") == "rejected", "archive format without a reader")
        .when(C("kind") == "unsupported", "unknown first bytes")
    )
    return assets.withColumn("kind", asset_kind(C("content"))).withColumn("reason", reason)


def asset_digest(assets: DataFrame) -> DataFrame:
    """Adds ``hash``, the md5 of all content."""
    return assets.withColumn("hash", F.md5("content"))


def dedupe_assets(assets: DataFrame) -> DataFrame:
    """(hash, path, copies): one file per content, the first by path."""
    return asset_digest(assets).groupBy("hash").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def _extension(name: Column) -> Column:
    return F.lower(F.right(name, F.lit(4)))


def bundle_members(entries: DataFrame) -> DataFrame:
    """(bundle_id, image, favorites, readme, error): first member of each role.

    Both image extensions share one slot; names of four bytes or fewer are skipped.
    """
    ext = _extension(C("name"))
    long = F.octet_length("name") > 4

    def first(*extensions: str) -> Column:
        return F.min_by("name", F.when(long & ext.isin(*extensions), C("idx")))

    rows = entries.groupBy("bundle_id").agg(
        first(".psd", ".psb").alias("image"), first(".pfv").alias("favorites"), first(".txt").alias("readme")
    )
    return rows.withColumn("error", F.when(C("image").isNull(), "no image in bundle"))


def dropped_files(files: DataFrame) -> DataFrame:
    """(bundle_id, favorites, document): of a loose set, the first favorites file and first other file."""
    is_fav = _extension(C("name")) == ".pfv"
    pick = lambda cond: F.min_by("name", F.when(cond, C("idx")))
    return files.groupBy("bundle_id").agg(pick(is_fav).alias("favorites"), pick(~is_fav).alias("document"))


# Fixed values of the archive format: header and record sizes without the name, which is
# written twice, and trailer sizes; the 64-bit layout adds 32 bytes to each header and record.
LOCAL, RECORD, WIDE = 39, 55, 32
TRAILER, WIDE_TRAILER = 22, 98
MAX_SIZE, MAX_ENTRIES = (1 << 32) - 1, 65535


def plan_bundles(entries: DataFrame) -> DataFrame:
    """Archive layout: per entry its header, data and record offsets; per bundle the totals.

    ``entries``: bundle_id, idx (unique in the bundle), name, csize.
    """
    n = F.octet_length("name").cast("bigint") * 2
    rows = entries.select("bundle_id", "idx", "name", "csize", (n + LOCAL).alias("local"), (n + RECORD).alias("record"))
    totals = rows.groupBy("bundle_id").agg(
        F.count("*").alias("entries"),
        F.sum(C("local") + C("csize")).alias("body"),
        F.sum("record").alias("directory"),
    )
    wide = (C("body") + C("directory") + TRAILER > MAX_SIZE) | (C("entries") > MAX_ENTRIES)
    extra = F.when(C("wide"), WIDE).otherwise(0)
    plan = totals.withColumn("wide", wide).select(
        "bundle_id",
        "entries",
        "wide",
        (C("body") + extra * C("entries")).alias("directory_offset"),
        (C("directory") + extra * C("entries")).alias("directory_size"),
    )
    plan = plan.withColumn(
        "total_size",
        C("directory_offset") + C("directory_size") + F.when(C("wide"), WIDE_TRAILER).otherwise(TRAILER),
    )
    sized = rows.join(plan, "bundle_id").withColumns({"local": C("local") + extra, "record": C("record") + extra})
    listed = running_sums(
        sized, ["bundle_id"], "idx", {"__end": C("local") + C("csize"), "__listed": C("record")}
    )
    return listed.select(
        "bundle_id",
        "idx",
        "name",
        (C("__end") - C("csize") - C("local")).alias("header_offset"),
        (C("__end") - C("csize")).alias("data_offset"),
        (C("directory_offset") + C("__listed") - C("record")).alias("record_offset"),
        "entries",
        "wide",
        "directory_offset",
        "directory_size",
        "total_size",
    )
