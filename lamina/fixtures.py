"""Layer trees, favorites and pixels read off the driver tables, in Spark and in SQL.

Both sides of every query start from these derivations, so they share input rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import stage, stage_large


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- deep tree: region > nation > customer > order ---------------------------------------------

DEEP_SQL = """deep AS (
  SELECT *, CASE WHEN seq_id % 5 = 0 THEN '*' WHEN seq_id % 7 = 0 THEN '!' ELSE '' END || raw_name
           || CASE WHEN seq_id % 11 = 0 THEN ':flipx' ELSE '' END AS name,
         (255 - seq_id % 128)::INTEGER AS opacity, (seq_id % 97)::INTEGER AS x, (seq_id % 89)::INTEGER AS y,
         (1 + seq_id % 31)::INTEGER AS width, (1 + seq_id % 17)::INTEGER AS height
  FROM (
    SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT + 1 AS seq_id, -1::BIGINT AS parent_seq_id,
           n_nationkey::BIGINT AS ordinal, n_name AS raw_name, true AS folder, true AS visible, false AS clipping,
           true AS pick, n_nationkey <> 3 AS allow, 1 AS lvl FROM nation
    UNION ALL
    SELECT n_regionkey, 1000 + c_custkey, n_nationkey + 1, c_custkey, c_mktsegment, true, c_acctbal > 0, false,
           c_acctbal > 2000, c_mktsegment <> 'BUILDING', 2
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT n_regionkey, 10000000000 + o_orderkey, 1000 + c_custkey, o_orderkey, o_orderpriority, false,
           o_orderstatus <> 'P', o_orderkey % 3 = 1, o_totalprice > 200000, o_orderpriority NOT LIKE '1%', 3
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""

ORDER_BASE = 10_000_000_000


def _dressed(seq: Column, raw: Column) -> Column:
    return F.concat(
        F.when(seq % 5 == 0, "*").when(seq % 7 == 0, "!").otherwise(""),
        raw,
        F.when(seq % 11 == 0, ":flipx").otherwise(""),
    )


def deep_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-level tree with repeated sibling names; documents are regions."""
    c = F.col
    nation = table(spark, sf_dir, "nation")
    # region and nation have fixed row counts, so the lookups may be broadcast by size
    customer = table(spark, sf_dir, "customer").join(nation, c("c_nationkey") == c("n_nationkey"))
    top = nation.select(
        c("n_regionkey").cast("bigint").alias("doc_id"),
        (c("n_nationkey").cast("bigint") + 1).alias("seq_id"),
        F.lit(-1).cast("bigint").alias("parent_seq_id"),
        c("n_nationkey").cast("bigint").alias("ordinal"),
        c("n_name").alias("raw_name"),
        F.lit(True).alias("folder"),
        F.lit(True).alias("visible"),
        F.lit(False).alias("clipping"),
        F.lit(True).alias("pick"),
        (c("n_nationkey") != 3).alias("allow"),
    )
    middle = customer.select(
        c("n_regionkey").cast("bigint"),
        c("c_custkey") + 1000,
        c("n_nationkey").cast("bigint") + 1,
        c("c_custkey"),
        c("c_mktsegment"),
        F.lit(True),
        c("c_acctbal") > 0,
        F.lit(False),
        c("c_acctbal") > 2000,
        c("c_mktsegment") != "BUILDING",
    )
    leaf = (
        table(spark, sf_dir, "orders")
        .join(customer.select("c_custkey", "n_regionkey"), c("o_custkey") == c("c_custkey"))
        .select(
            c("n_regionkey").cast("bigint"),
            c("o_orderkey") + ORDER_BASE,
            c("c_custkey") + 1000,
            c("o_orderkey"),
            c("o_orderpriority"),
            F.lit(False),
            c("o_orderstatus") != "P",
            c("o_orderkey") % 3 == 1,
            c("o_totalprice") > 200000,
            ~c("o_orderpriority").startswith("1"),
        )
    )
    seq = c("seq_id")
    rows = top.union(middle).union(leaf).select(
        "*",
        _dressed(seq, c("raw_name")).alias("name"),
        (255 - seq % 128).cast("int").alias("opacity"),
        (seq % 97).cast("int").alias("x"),
        (seq % 89).cast("int").alias("y"),
        (1 + seq % 31).cast("int").alias("width"),
        (1 + seq % 17).cast("int").alias("height"),
    )
    # operators read their layer table several times; as in production it is a Parquet table
    return stage(rows.drop("raw_name"), "deep")


# Sibling index, internal name and full path for the deep tree; every level is one join.
DEEP_PATHS_SQL = (
    "WITH "
    + DEEP_SQL
    + """, named AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, parent_seq_id, name ORDER BY ordinal) - 1 AS dup FROM deep),
inner_named AS (
  SELECT *, name || CASE WHEN dup > 0 THEN '\\' || dup::VARCHAR ELSE '' END AS internal_name FROM named),
paths AS (
  SELECT *, internal_name AS path, NULL::VARCHAR AS parent_path, NULL::BIGINT AS grand FROM inner_named WHERE lvl = 1
  UNION ALL
  SELECT b.*, a.internal_name || '/' || b.internal_name, a.internal_name, NULL
  FROM inner_named b JOIN inner_named a ON b.lvl = 2 AND a.doc_id = b.doc_id AND a.seq_id = b.parent_seq_id
  UNION ALL
  SELECT c.*, a.internal_name || '/' || b.internal_name || '/' || c.internal_name,
         a.internal_name || '/' || b.internal_name, a.seq_id
  FROM inner_named c JOIN inner_named b ON c.lvl = 3 AND b.doc_id = c.doc_id AND b.seq_id = c.parent_seq_id
  JOIN inner_named a ON a.doc_id = b.doc_id AND a.seq_id = b.parent_seq_id),
closure AS (
  SELECT doc_id, seq_id, seq_id AS ancestor_seq_id, 0 AS distance FROM deep
  UNION ALL SELECT doc_id, seq_id, parent_seq_id, 1 FROM deep WHERE parent_seq_id <> -1
  UNION ALL SELECT doc_id, seq_id, grand, 2 FROM paths WHERE lvl = 3)
"""
)


# -- shallow trees: one document per order, folders by return flag, layers by line number ---------

# distinct (order, flag, line) triples; documents grow with the data and stay small
LINES_SQL = """lines AS (
  SELECT l_orderkey AS doc_id, l_returnflag AS flag, l_linenumber::BIGINT AS ln,
         bool_or(l_linestatus = 'F') AS on_flag, max(l_quantity)::BIGINT AS qty, max(l_discount) AS disc
  FROM lineitem GROUP BY ALL)"""

_FLAG_NO_SQL = "CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"

SHALLOW_SQL = (
    LINES_SQL
    + f""", shallow AS (
  SELECT DISTINCT doc_id, ({_FLAG_NO_SQL})::BIGINT AS seq_id, -1::BIGINT AS parent_seq_id, ({_FLAG_NO_SQL})::BIGINT AS ordinal,
         flag AS name, true AS folder, flag <> 'R' AS visible, 1 AS lvl, 'plain' AS kind, flag AS path,
         NULL::VARCHAR AS parent_path, flag, NULL::BIGINT AS ln, NULL::BIGINT AS qty, NULL::DOUBLE AS disc FROM lines
  UNION ALL
  SELECT doc_id, ({_FLAG_NO_SQL}) * 10 + ln, {_FLAG_NO_SQL}, ln,
         CASE WHEN flag = 'A' THEN '*' WHEN ln = 7 THEN '!' ELSE '' END || 'l' || ln, false, on_flag, 2,
         CASE WHEN flag = 'A' THEN 'radio' WHEN ln = 7 THEN 'force' ELSE 'plain' END,
         flag || '/' || CASE WHEN flag = 'A' THEN '*' WHEN ln = 7 THEN '!' ELSE '' END || 'l' || ln, flag,
         flag, ln, qty, disc FROM lines)"""
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(order_rows(spark, sf_dir))


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem, the order's key as doc_id."""
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")


def lines_of(rows: DataFrame) -> DataFrame:
    """Distinct (order, flag, line) of ``order_rows``."""
    return (
        rows.groupBy(
            "doc_id",
            F.col("l_returnflag").alias("flag"),
            F.col("l_linenumber").cast("bigint").alias("ln"),
        )
        .agg(
            F.bool_or(F.col("l_linestatus") == "F").alias("on_flag"),
            F.max("l_quantity").cast("bigint").alias("qty"),
            F.max("l_discount").alias("disc"),
        )
    )


def flag_no() -> Column:
    return F.when(F.col("flag") == "A", 1).when(F.col("flag") == "N", 2).otherwise(3).cast("bigint")


def line_name() -> Column:
    return F.concat(
        F.when(F.col("flag") == "A", "*").when(F.col("ln") == 7, "!").otherwise(""),
        F.lit("l"),
        F.col("ln").cast("string"),
    )


def shallow_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many two-level documents: radio, forced and plain leaves under flag folders."""
    lines = order_lines(spark, sf_dir)
    c = F.col
    folders = lines.select(
        "doc_id",
        flag_no().alias("seq_id"),
        F.lit(-1).cast("bigint").alias("parent_seq_id"),
        flag_no().alias("ordinal"),
        c("flag").alias("name"),
        F.lit(True).alias("folder"),
        (c("flag") != "R").alias("visible"),
    ).distinct()
    leaves = lines.select(
        "doc_id", flag_no() * 10 + c("ln"), flag_no(), "ln", line_name(), F.lit(False), "on_flag"
    )
    return stage_large(folders.union(leaves), "shallow")


def shallow_paths(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The shallow trees with paths, kinds and flags spelled out, one row per layer; ``lines`` may be passed where they are known."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    c = F.col
    folders = lines.select(
        "doc_id",
        flag_no().alias("seq_id"),
        F.lit(-1).cast("bigint").alias("parent_seq_id"),
        flag_no().alias("ordinal"),
        c("flag").alias("name"),
        F.lit(True).alias("folder"),
        (c("flag") != "R").alias("checked"),
        F.lit("plain").alias("kind"),
        c("flag").alias("path"),
        F.lit(None).cast("string").alias("parent_path"),
        "flag",
        F.lit(None).cast("bigint").alias("ln"),
        F.lit(None).cast("bigint").alias("qty"),
        F.lit(None).cast("double").alias("disc"),
    ).distinct()
    kind = F.when(c("flag") == "A", "radio").when(c("ln") == 7, "force").otherwise("plain")
    leaves = lines.select(
        "doc_id",
        flag_no() * 10 + c("ln"),
        flag_no(),
        "ln",
        line_name(),
        F.lit(False),
        "on_flag",
        kind,
        F.concat("flag", F.lit("/"), line_name()),
        "flag",
        "flag",
        "ln",
        "qty",
        "disc",
    )
    return stage_large(folders.union(leaves), "shallow")
