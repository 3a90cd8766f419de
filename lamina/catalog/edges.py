"""Queries for files, charsets, archives and the batch twins of the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.catalog.tiling import DICT_SQL, raster_columns
from lamina.fixtures import order_lines
from lamina.operators.scans import running_sum
from lamina.session import staging_dir
from lamina.sources import assets as A
from lamina.sources import charset as CS
from lamina.streaming import changes, rings

C = F.col


@register("scan_assets")
def _scan(spark, sf):
    files = A.scan_assets(spark, sf, "*.parquet")
    return files.select(F.regexp_extract("path", r"[^/]+\z", 0).alias("name"), "length")


def _files(spark, sf):
    """Documents as files whose first bytes depend on their language."""
    head = (
        F.when(C("lang") == "en", F.unhex(F.lit("38425053")))
        .when(C("lang") == "fr", F.unhex(F.lit("504B0304")))
        .when(C("lang") == "de", F.unhex(F.lit("377ABCAF")))
        .otherwise(F.unhex(F.lit("0001")))
    )
    return table(spark, sf, "documents").select("doc_id", F.concat(head, C("text").cast("binary")).alias("content"))


@register(
    "classify_assets",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'image' WHEN 'fr' THEN 'archive' WHEN 'de' THEN 'rejected' ELSE 'unsupported' END AS kind,
      CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN NULL WHEN 'de' THEN 'archive format without a reader' ELSE 'unknown first bytes' END AS reason
      FROM documents""",
)
def _classify(spark, sf):
    return A.classify_assets(_files(spark, sf)).select("doc_id", "kind", "reason")


def _texts(spark, sf):
    return table(spark, sf, "documents").select(
        F.lpad(C("doc_id").cast("string"), 12, "0").alias("path"), C("text").cast("binary").alias("content")
    )


@register("asset_digest", "SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, md5(text) AS hash FROM documents")
def _digest(spark, sf):
    return A.asset_digest(_texts(spark, sf)).select("path", "hash")


@register(
    "dedupe_assets",
    "SELECT md5(text) AS hash, min(lpad(doc_id::VARCHAR, 12, '0')) AS path, count(*) AS copies FROM documents GROUP BY 1",
)
def _dedupe(spark, sf):
    return A.dedupe_assets(_texts(spark, sf))


def _entry_name():
    stem = C("doc_id").cast("string")
    return (
        F.when(C("n_chars") % 11 == 0, ".txt")
        .when(C("lang") == "en", F.concat(F.lit("D"), stem, F.lit(".PSD")))
        .when(C("lang") == "de", F.concat(F.lit("d"), stem, F.lit(".psb")))
        .when(C("lang") == "fr", F.concat(F.lit("f"), stem, F.lit(".Pfv")))
        .otherwise(F.concat(F.lit("é"), stem, F.lit(".txt")))
    )


_ENTRY_NAME = """CASE WHEN n_chars % 11 = 0 THEN '.txt' WHEN lang = 'en' THEN 'D' || doc_id || '.PSD' WHEN lang = 'de' THEN 'd' || doc_id || '.psb'
    WHEN lang = 'fr' THEN 'f' || doc_id || '.Pfv' ELSE 'é' || doc_id || '.txt' END"""


def entries(spark, sf):
    return table(spark, sf, "documents").select(
        C("source").alias("bundle_id"), C("doc_id").alias("idx"), _entry_name().alias("name"),
        (C("n_chars") * 1000).alias("csize"), "lang",
    )


_SQL_ENTRIES = f"entries AS (SELECT source AS bundle_id, doc_id AS idx, {_ENTRY_NAME} AS name, n_chars * 1000 AS csize, lang FROM documents)"


@register(
    "bundle_members",
    "WITH "
    + _SQL_ENTRIES
    + """, kinds AS (SELECT *, lower(right(name, 4)) AS ext FROM entries WHERE strlen(name) > 4), picked AS (
      SELECT bundle_id, arg_min(name, idx) FILTER (WHERE ext IN ('.psd', '.psb')) AS image, arg_min(name, idx) FILTER (WHERE ext = '.pfv') AS favorites,
        arg_min(name, idx) FILTER (WHERE ext = '.txt') AS readme FROM kinds GROUP BY bundle_id)
    SELECT bundle_id, image, favorites, readme, CASE WHEN image IS NULL THEN 'no image in bundle' END AS error
    FROM (SELECT DISTINCT bundle_id FROM entries) LEFT JOIN picked USING (bundle_id)""",
)
def _members(spark, sf):
    return A.bundle_members(entries(spark, sf))


@register(
    "dropped_files",
    "WITH "
    + _SQL_ENTRIES
    + """SELECT bundle_id, arg_min(name, idx) FILTER (WHERE lower(right(name, 4)) = '.pfv') AS favorites,
      arg_min(name, idx) FILTER (WHERE lower(right(name, 4)) <> '.pfv') AS document FROM entries GROUP BY bundle_id""",
)
def _dropped(spark, sf):
    return A.dropped_files(entries(spark, sf))


@register(
    "plan_bundles",
    "WITH "
    + _SQL_ENTRIES
    + """, bytes AS (SELECT *, 39 + 2 * strlen(name) AS local0, 55 + 2 * strlen(name) AS record0 FROM entries
    ), totals AS (SELECT bundle_id, count(*) AS entries, sum(local0 + csize)::BIGINT AS body, sum(record0)::BIGINT AS directory FROM bytes GROUP BY bundle_id),
    plan AS (SELECT *, body + directory + 22 > 4294967295 OR entries > 65535 AS wide FROM totals),
    sized AS (SELECT b.bundle_id, b.idx, b.name, b.csize, p.entries, p.wide, local0 + CASE WHEN wide THEN 32 ELSE 0 END AS local,
        record0 + CASE WHEN wide THEN 32 ELSE 0 END AS record, body + CASE WHEN wide THEN 32 * entries ELSE 0 END AS directory_offset,
        directory + CASE WHEN wide THEN 32 * entries ELSE 0 END AS directory_size FROM bytes b JOIN plan p USING (bundle_id))
    SELECT bundle_id, idx, name,
      (coalesce(sum(local + csize) OVER w, 0))::BIGINT AS header_offset, (coalesce(sum(local + csize) OVER w, 0) + local)::BIGINT AS data_offset,
      (directory_offset + coalesce(sum(record) OVER w, 0))::BIGINT AS record_offset, entries, wide, directory_offset, directory_size,
      directory_offset + directory_size + CASE WHEN wide THEN 98 ELSE 22 END AS total_size
    FROM sized WINDOW w AS (PARTITION BY bundle_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _plan(spark, sf):
    return A.plan_bundles(entries(spark, sf))


def _coded(spark, sf):
    """Documents in several encodings by language, with and without marks."""
    text = C("text")
    content = (
        F.when(C("lang") == "en", F.encode(text, "UTF-16"))
        .when(C("lang") == "fr", F.concat(F.unhex(F.lit("EFBBBF")), text.cast("binary")))
        .when(C("lang") == "de", F.concat(F.unhex(F.lit("93FA967B8CEA")), F.encode(F.regexp_replace(text, r"[^\x00-\x7F]", ""), "US-ASCII")))
        .otherwise(text.cast("binary"))
    )
    return table(spark, sf, "documents").select("doc_id", content.alias("content"))


_SQL_CODED = r"""CASE lang WHEN 'en' THEN 'UTF-16' WHEN 'de' THEN 'Shift_JIS' WHEN 'fr' THEN 'UTF-8'
    ELSE CASE WHEN regexp_full_match(text, '[\x00-\x7F]*') THEN 'ASCII' ELSE 'UTF-8' END END AS charset,
    md5(CASE lang WHEN 'de' THEN '日本語' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') ELSE text END) AS text_md5 FROM documents"""


@register("decode_texts", "SELECT doc_id, " + _SQL_CODED)
def _decode(spark, sf):
    return CS.decode_texts(_coded(spark, sf)).select("doc_id", "charset", F.md5("text").alias("text_md5"))


@register("charset_census", f"SELECT charset, count(*) AS files FROM (SELECT {_SQL_CODED}) GROUP BY charset")
def _census(spark, sf):
    return CS.charset_census(_coded(spark, sf))


@register("doc_charset")
def _doc_charset(spark, sf):
    """Order documents whose layers carry legacy names; some also have a Unicode one."""
    layers = order_lines(spark, sf).select(
        "doc_id",
        C("ln").alias("seq_id"),
        F.concat("flag", C("ln").cast("string")).alias("sort_path"),
        F.when(C("flag") == "R", F.concat(F.lit("u"), C("ln").cast("string"))).otherwise("").alias("unicode_name"),
        F.concat(
            F.when(C("doc_id") % 2 == 0, F.unhex(F.lit("93FA967B"))).otherwise(F.unhex(F.lit("C6FCCBDC"))),
            C("flag").cast("binary"),
        ).alias("legacy_name"),
    )
    return CS.doc_charset(layers).select("doc_id", "seq_id", "sort_path", "charset", "name")


# -- streams, batch twins -----------------------------------------------------------------------


def _edits(spark, sf):
    return table(spark, sf, "events").select(
        C("user_id").alias("key"), C("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )


def _sql_bursts(gap_us: int) -> str:
    return f"""WITH edits AS (SELECT user_id AS key, epoch_us(ts) AS us, event_id, value FROM events),
    marked AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) <= {gap_us} THEN 0 ELSE 1 END AS fresh FROM edits),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY us, event_id) AS burst FROM marked)
    SELECT key, min(us) AS first_us, max(us) AS last_us, count(*) AS changes, arg_max(value, (us, event_id)) AS value FROM numbered GROUP BY key, burst"""


@register("debounce_changes", _sql_bursts(3600 * 1000 * 1000))
def _debounce(spark, sf):
    return changes.bursts(_edits(spark, sf), 3600 * 1000)


@register(
    "expire_idle",
    f"SELECT key, first_us, last_us + 60000000 AS expires_us, changes AS writes FROM ({_sql_bursts(60 * 1000 * 1000)})",
)
def _expire(spark, sf):
    return changes.expired(_edits(spark, sf), 60_000)


@register(
    "progress_buckets",
    """WITH reads AS (SELECT source AS file, doc_id AS read_no, n_chars * 64 AS length FROM documents),
    rows AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY read_no))::BIGINT AS pos, (sum(length) OVER (PARTITION BY file))::BIGINT AS size FROM reads)
    SELECT file, read_no, pos, pos >> 18 AS step, pos::DOUBLE / size::DOUBLE AS progress FROM rows WHERE (pos >> 18) <> ((pos - length) >> 18)""",
)
def _progress(spark, sf):
    reads = table(spark, sf, "documents").select(
        C("source").alias("file"), C("doc_id").alias("read_no"), (C("n_chars") * 64).alias("length")
    )
    return changes.progress_buckets(reads)


#: Nothing is late in a finished table, whatever batch it comes in.
_LATE = "36500 days"


def _drained(spark, run, rows, order, name):
    """The stream's rows over a table, closed by a marker without a key far in the future."""
    marker = rows.limit(0).unionByName(
        spark.range(1).select(*[
            F.to_timestamp(F.lit("2200-01-01 00:00:00")).alias(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in rows.schema
        ])
    )
    return changes.drained(rows, run, order, f"{staging_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}", marker=marker)


def _timed_edits(spark, sf):
    return _edits(spark, sf).withColumn("ts", C("ts").cast("timestamp"))


@register("debounce_stream", _sql_bursts(3600 * 1000 * 1000))
def _debounce_stream(spark, sf):
    """Bursts of changes from the stream itself, over a table cut into batches."""
    saved = _drained(spark, lambda s: changes.debounce_changes(s, 3600 * 1000, _LATE), _timed_edits(spark, sf), "ts", "debounce")
    return saved.filter("key is not null").select(
        "key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("saved_from").alias("last_us"), "changes", "value"
    )


@register(
    "expire_stream",
    f"SELECT key, first_us, last_us + 60000000 AS expires_us, changes AS writes FROM ({_sql_bursts(60 * 1000 * 1000)})",
)
def _expire_stream(spark, sf):
    """Lives of bundles from the stream itself."""
    gone = _drained(spark, lambda s: changes.expire_idle(s, 60_000, _LATE), _timed_edits(spark, sf), "ts", "expire")
    return gone.filter("key is not null").select(
        "key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("expires_at").alias("expires_us"), "writes"
    )


@register(
    "progress_stream",
    """WITH rows AS (SELECT source AS file, (sum(n_chars * 64) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS pos FROM documents)
    SELECT DISTINCT file, pos >> 18 AS step FROM rows WHERE pos >> 18 > 0""",
)
def _progress_stream(spark, sf):
    """Steps of every file, each told once by the stream of its reads."""
    reads = table(spark, sf, "documents").select(
        C("source").alias("file"), C("doc_id").alias("read_no"), (C("n_chars") * 64).alias("length")
    )
    placed = running_sum(reads, ["file"], "read_no", C("length"), "pos").select("file", "pos", F.timestamp_seconds("read_no").alias("ts"))
    target = f"{staging_dir(spark)}/lamina/progress-{uuid.uuid4().hex}"
    return changes.drained(placed, lambda s: changes.progress_stream(s, _LATE), "ts", target).select("file", "step")


def _file_stream(spark, sf, name):
    """One driver table as a file stream."""
    batch = table(spark, sf, name)
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@register("stream_tiles", "WITH " + DICT_SQL + "SELECT hash, p, uses FROM dict")
def _stream_tiles(spark, sf):
    """The dictionary of a stream of pictures, read back after the input ran out."""
    suppliers = _file_stream(spark, sf, "supplier")
    target = f"{staging_dir(spark)}/lamina/tilestream-{uuid.uuid4().hex}"
    rings.stream_tiles(suppliers.select(*raster_columns()), target).awaitTermination()
    return rings.read_dictionary(spark, target).select("hash", "p", "uses")


@register("stream_recent_versions")
def _stream_ring(spark, sf):
    events = _file_stream(spark, sf, "events").select(
        C("user_id").alias("user"),
        (C("event_id") % 3).alias("session"),
        F.unix_micros(C("ts").cast("timestamp")).alias("ts_us"),
        F.md5("event_type").alias("doc_hash"),
        F.md5("props").alias("id"),
        F.when(C("value") < 20, 0).otherwise(1).alias("entries"),
    )
    target = f"{staging_dir(spark)}/lamina/rings-{uuid.uuid4().hex}"

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    query = (
        rings.stream_recent_versions(events)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(target)
    latest = rows.groupBy("user").agg(F.max("epoch").alias("epoch"))
    return rows.join(latest, ["user", "epoch"]).drop("epoch")
