"""Session defaults and the staging area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING_CONF = "spark.checkpoint.dir"
#: Off while tables lie in buckets by doc_id: joins on doc_id and more columns then keep to the buckets.
CO_PARTITION_CONF = "spark.sql.requireAllClusterKeysForCoPartition"
#: On for the same time: a task's rows are of one bucket or a few, so they need not be sorted by bucket to be written.
WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"

#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}

#: Number of buckets within ``in_buckets``, else 0.
_buckets: ContextVar[int] = ContextVar("buckets", default=0)


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lamina")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def staging_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only for local masters without the setting."""
    configured = spark.conf.get(STAGING_CONF, None) or _own.get(spark.sparkContext.applicationId)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"set {STAGING_CONF} to a shared folder before staging on a cluster")
    made = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="lamina-stage-")
    return made


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back.

    The result has no lineage beyond the files, so iterative operators neither
    re-run earlier rounds nor lose work with an executor, and both readers of a
    sampled range partitioning see the same partitions.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    path = f"{staging_dir(spark)}/lamina/{label}-{name}"
    buckets = bucketed()
    if buckets and "doc_id" in df.columns:
        return _stage_buckets(df, path, f"lamina_{name}", buckets)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stage_buckets(df: DataFrame, path: str, name: str, buckets: int) -> DataFrame:
    """``df`` in buckets by doc_id; rows that lie so already are not shuffled. The table's name is given up, its files stay."""
    spark = df.sparkSession
    df.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").option("path", path).saveAsTable(name, format="parquet")
    # a mark of its own keeps doc_id apart from the table's name, else unions of such tables lose their buckets
    key = F.col("doc_id").alias("doc_id", metadata={"staged": name})
    out = spark.table(name).select(*[key if c == "doc_id" else F.col(c) for c in df.columns])
    spark.sql(f"DROP TABLE {name}")
    return out


def bucketed() -> int:
    """Number of buckets within ``in_buckets``, else 0."""
    return _buckets.get()


@contextmanager
def in_buckets(spark: SparkSession, buckets: int) -> Iterator[None]:
    """Within, tables with a doc_id are staged in buckets by it, so that joins and groups by doc_id and more need no shuffle.

    A document lies in one bucket whole: for tables of small documents only. What is made within must be staged within.
    """
    confs = {CO_PARTITION_CONF: "false", WRITERS_CONF: "4"}
    strict = {name: spark.conf.get(name) for name in confs}
    before = _buckets.set(buckets)
    for name, value in confs.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        _buckets.reset(before)
        for name, value in strict.items():
            spark.conf.set(name, value)


#: Rows of the largest document that is kept in one place, and the least and most rows of a bucket.
SMALL_DOCUMENT, SLIM_BUCKET, FULL_BUCKET = 1 << 16, 1 << 14, 1 << 17


def by_document(rows: DataFrame, run: Callable[[DataFrame], DataFrame], most: int = SMALL_DOCUMENT) -> DataFrame:
    """``run(rows)`` for work that never looks across documents (doc_id).

    Documents of up to ``most`` rows go through it in buckets, shuffled once. Larger ones, fewer than one for ``most`` rows of
    the table, so that their ids may be broadcast, go through it on their own, spread over tasks as any other table.
    """
    return tables_by_document([rows], lambda part: [run(part)], most)[0]


def tables_by_document(
    tables: Sequence[DataFrame], run: Callable[..., Sequence[DataFrame]], most: int = SMALL_DOCUMENT
) -> list[DataFrame]:
    """``by_document`` for several tables, whose rows count together, and several results."""
    spark = tables[0].sparkSession
    tables = [stage(t, "rows") for t in tables]
    ids = reduce(DataFrame.unionAll, [t.select("doc_id") for t in tables])
    total = ids.count()
    crowded = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select("doc_id")
    crowded = stage(crowded, "crowded")
    alone = not crowded.isEmpty()
    few = [t.join(F.broadcast(crowded), "doc_id", "left_anti") for t in tables] if alone else tables
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with in_buckets(spark, max(min(partitions, total // SLIM_BUCKET), total // FULL_BUCKET, 1)):
        out = [stage(made, "results") for made in run(*[stage_large(t, "rows") for t in few])]
    if not alone:
        return out
    spread = run(*[large(t.join(F.broadcast(crowded), "doc_id", "left_semi")) for t in tables])
    return [small.unionByName(big) for small, big in zip(out, spread, strict=True)]


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that Spark must not broadcast by its estimate.

    Estimates start from compressed files, take a narrow choice of columns for a small part of them and see no
    growth in an explode, so tables of millions of rows pass for small ones and would be collected on the driver. The hint
    holds for what is derived from ``df`` up to the next join or union. In buckets, which are bounded, one side is
    hashed instead of sorting both.
    """
    return df.hint("shuffle_hash" if bucketed() else "merge")


def stage_large(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for tables whose rows follow the input."""
    return large(stage(df, label))
