"""Reader and writer of the sectioned favorites text.

A file is ``[<tag>Favorites-v1]``, then ``key/value`` lines, then sections that start with
``//path`` or ``//path~type``. Everything up to the node table happens inside the row of one
file, so scanning needs no shuffle; only implied folders and repeats are resolved by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.names import decode_name, encode_name
from lamina.operators.tree import joined, tree_fold

# Fixed values of the format. The tag in front of "Favorites" names the program that wrote
# the file; readers accept any, writers take the whole line as a parameter.
HEADER_PATTERN = r"\A\[\w*Favorites-v1\]\z"
DEFAULT_HEADER = "[Favorites-v1]"
DEFAULT_ROOT_NAME = "My Favorites"
DEFAULT_VIEW_MODE = 2
NODE_TYPES = ["item", "folder", "filter"]

FAV_TOP = "#"
C = F.col


def read_favorites_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of favorites files; a file is one row because sections span lines."""
    return spark.read.text(path, wholetext=True).select(
        C("_metadata.file_path").alias("file"), C("value").alias("text")
    )


def _plain(text: Column) -> Column:
    """Drop a byte-order mark and carriage returns."""
    return F.replace(F.regexp_replace(text, r"\A\x{FEFF}", ""), F.lit("\r"), F.lit(""))


def _first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def _rest(text: Column) -> Column:
    return F.when(text.contains("\n"), F.regexp_replace(text, r"\A[^\n]*\n", "")).otherwise("")


def split_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) files by their header line."""
    rows = files.withColumn("text", _plain(C("text")))
    ok = F.coalesce(_first_line(C("text")).rlike(HEADER_PATTERN), F.lit(False))
    return rows.filter(ok), rows.filter(~ok).withColumn("reason", F.lit("invalid header"))


def _sections(files: DataFrame) -> DataFrame:
    chunks = F.split(C("text"), r"\n(?=//[^\n])")
    return files.select("doc_id", F.posexplode(chunks).alias("section", "chunk"))


def _read_sections(files: DataFrame) -> DataFrame:
    """Sections of accepted files with decoded ``parts`` of the name and a ``reason`` where one can't be used."""
    accepted, _ = split_files(files)
    head = F.substring(_first_line(C("chunk")), 3, 1 << 30)
    body = F.array_join(F.filter(F.split(_rest(C("chunk")), "\n"), lambda v: v != ""), "\n")
    rows = _sections(accepted).filter("section > 0").select(
        "doc_id",
        "section",
        F.split_part(head, F.lit("~"), F.lit(1)).alias("name"),
        F.when(head.contains("~"), F.split_part(head, F.lit("~"), F.lit(2))).otherwise("item").alias("type"),
        body.alias("value"),
    )
    parts = F.transform(F.split("name", "/"), decode_name)
    reason = (
        F.when(F.exists("parts", lambda v: v.isNull()), "malformed name")
        .when(~C("type").isin(*NODE_TYPES), "unknown type")
    )
    return rows.withColumn("parts", parts).withColumn("reason", reason)


def rejected_sections(files: DataFrame) -> DataFrame:
    """(doc_id, section, name, type, reason) of sections that ``scan_favorites`` leaves out."""
    return _read_sections(files).filter("reason is not null").select("doc_id", "section", "name", "type", "reason")


def scan_favorites(files: DataFrame) -> DataFrame:
    """Nodes (doc_id, path, parent_path, text, type, value, ordinal) of (doc_id, text) files.

    Missing ancestors become folders; a path that exists already is ignored, so the first
    section to mention it decides. ``ordinal`` grows in order of first mention. Sections with a
    malformed name or an unknown type are left to ``rejected_sections``.
    """
    rows = _read_sections(files).filter("reason is null")
    steps = rows.select(
        "doc_id",
        "section",
        "type",
        "value",
        "parts",
        F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"),
    )
    whole = lambda n: F.array_join(F.transform(F.slice("parts", F.lit(1), n), lambda v: encode_name(v)), "/")
    last = C("level") == F.size("parts")
    mention = F.struct(
        F.when(last, C("type")).otherwise("folder").alias("type"),
        F.when(last & C("type").isin("item", "filter"), C("value")).alias("value"),
        F.element_at("parts", C("level")).alias("text"),
        F.when(C("level") > 1, whole(C("level") - 1)).alias("parent_path"),
    )
    mentions = steps.select("doc_id", "section", whole(C("level")).alias("path"), mention.alias("m"))
    first = mentions.groupBy("doc_id", "path").agg(
        F.min_by("m", "section").alias("m"), F.min("section").cast("bigint").alias("ordinal")
    )
    return first.select("doc_id", "path", "m.parent_path", "m.text", "m.type", "m.value", "ordinal")


def favorites_settings(files: DataFrame) -> DataFrame:
    """(doc_id, root_name, view_mode) from the lines before the first section."""
    accepted, _ = split_files(files)
    top = F.split(C("text"), r"\n(?=//[^\n])", 2)[0]
    lines = F.filter(F.split(_rest(top), "\n"), lambda v: v.contains("/"))

    def last_value(key: str) -> Column:
        prefix = key + "/"
        values = F.transform(
            F.filter(lines, lambda v: v.startswith(prefix)),
            lambda v: decode_name(F.substring(v, len(prefix) + 1, 1 << 30)),
        )
        return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(-1))

    number = F.try_to_number(
        F.nullif(F.regexp_extract(last_value("faview-mode"), r"\A\s*([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")
    ).cast("int")
    mode = F.when(number.isin(0, 1, 2), number).otherwise(DEFAULT_VIEW_MODE)
    return accepted.select(
        "doc_id",
        F.coalesce(last_value("root-name"), F.lit(DEFAULT_ROOT_NAME)).alias("root_name"),
        mode.alias("view_mode"),
    )


def count_entries(text: Column) -> Column:
    """Section lines after the first line."""
    lines = F.split(_rest(_plain(text)), "\n")
    return F.size(F.filter(lines, lambda v: v.startswith("//") & (F.length(v) > 2)))


def favorites_chunks(nodes: DataFrame, view_mode: Column | int = 1, header: str = DEFAULT_HEADER) -> DataFrame:
    """(doc_id, sort_path, chunk): the file's pieces in depth-first order.

    Joining a document's chunks with newlines gives its file. ``nodes`` has node_id,
    parent_id ("#" above the root), ordinal, text, type and value.
    """
    mode = F.lit(view_mode) if isinstance(view_mode, int) else view_mode
    key = F.lpad(C("ordinal").cast("string"), 19, "0")
    name = encode_name("text")
    walked = tree_fold(
        nodes,
        {"sort_path": (key, joined("/")), "path": (name, joined("/"))},
        inner=C("type") != "item",
        node_id="node_id",
        parent_id="parent_id",
        top=FAV_TOP,
        label="favtext",
    )
    # paths begin below the root
    walked = walked.withColumn("path", F.when(C("depth") > 1, F.regexp_replace("path", r"\A[^/]*/", "")).otherwise(""))
    parents = nodes.select("doc_id", C("parent_id").alias("node_id")).distinct().withColumn("__kids", F.lit(True))
    rows = walked.join(parents, ["doc_id", "node_id"], "left")
    value = F.when(F.coalesce("value", F.lit("")) != "", F.concat(F.lit("\n"), "value")).otherwise("")
    chunk = (
        F.when(
            C("type") == "root",
            F.concat(F.lit(header + "\nroot-name/"), name, F.lit("\nfaview-mode/"), mode.cast("string"), F.lit("\n")),
        )
        .when((C("type") == "folder") & C("__kids").isNull(), F.concat(F.lit("//"), "path", F.lit("~folder\n")))
        .when(C("type") == "filter", F.concat(F.lit("//"), "path", F.lit("~filter"), value, F.lit("\n")))
        .when(C("type") == "item", F.concat(F.lit("//"), "path", value, F.lit("\n")))
    )
    return rows.select("doc_id", "sort_path", chunk.alias("chunk")).filter(C("chunk").isNotNull())


def favorites_text(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) for files that fit in a cell, as a saved favorites file does."""
    pieces = F.sort_array(F.collect_list(F.struct("sort_path", "chunk")))
    return chunks.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda p: p["chunk"]), "\n").alias("text"))


def write_favorites(chunks: DataFrame, path: str) -> None:
    """Write each document as text under ``doc_id=``; file order is line order."""
    write_ordered(chunks, "chunk", path)


def write_outline(lines: DataFrame, path: str) -> None:
    """Write layer outlines (doc_id, sort_path, line) the same way."""
    write_ordered(lines, "line", path)


def write_ordered(rows: DataFrame, column: str, path: str) -> None:
    """Text per document in ``sort_path`` order; a large document spans several ordered files."""
    (
        rows.repartitionByRange("doc_id", "sort_path")
        .sortWithinPartitions("doc_id", "sort_path")
        .select("doc_id", C(column).alias("value"))
        .write.partitionBy("doc_id")
        .text(path)
    )
