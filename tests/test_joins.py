"""Joins of tables that follow the input: none is collected on the driver because its files look small."""

from pyspark.sql import functions as F

from lamina.catalog import tiling
from lamina.operators import bitsets, states
from lamina.operators import tiles as T
from lamina.session import stage_large

LAYERS = "doc_id long, seq_id long, parent_seq_id long, ordinal long, folder boolean, checked boolean, kind string, path string, parent_path string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_layers(spark):
    rows = [(d, 1, -1, 1, True, True, "plain", "a", None) for d in range(3)]
    rows += [(d, 10 + k, 1, k, False, k % 2 == 0, "radio" if k < 3 else "plain", f"a/{k}", "a") for d in range(3) for k in range(5)]
    return spark.createDataFrame(rows, LAYERS)


def test_staged_tables_are_not_broadcast_by_estimate(spark):
    layers = stage_large(some_layers(spark), "layers")
    listed = layers.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert "BroadcastExchange" not in plan(layers.join(listed, "doc_id"))


def test_many_states_are_not_broadcast_by_estimate(spark):
    numbered = bitsets.number_layers(some_layers(spark))
    sets = numbered.filter("seq_id > 10").select("doc_id", F.lit(1).alias("state_id"), "path")
    parsed = sets.withColumns({"all_layers": F.lit(False), "checked": F.lit(True)})
    for bits in (
        bitsets.apply_states(numbered, parsed), bitsets.apply_overlays(numbered, sets, sets), bitsets.hidden(bitsets.to_bits(bitsets.find_layers(sets, numbered), bitsets.STATE), numbered),
        bitsets.filters_effective(numbered, sets, sets.withColumn("level", F.lit(1)), sets),
    ):
        assert "BroadcastExchange" not in plan(bitsets.flags(numbered, bits, bitsets.STATE, on=bits.columns[-1]))


def test_clicks_are_not_broadcast_by_estimate(spark):
    layers = stage_large(some_layers(spark).withColumn("clipping", F.lit(False)), "layers")
    clicks = layers.select("doc_id", "seq_id", F.col("seq_id").alias("click_seq"), F.lit(True).alias("on"))
    toggled = states.apply_toggles(layers, clicks)
    assert "BroadcastExchange" not in plan(toggled)


def test_tiles_are_not_broadcast_by_estimate(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(30)], "image_id long").write.parquet(str(tmp_path / "at"))
    at = spark.read.parquet(str(tmp_path / "at"))
    px = at.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("x"), F.lit(0).alias("y"), *[F.lit(9).alias(c) for c in "rgba"])
    cells = T.chop(px, at.select("image_id", F.lit(40).alias("width"), F.lit(20).alias("height")))
    assert "BroadcastExchange" not in plan(cells)
    assert cells.count() == 30 * 3 * 2


def test_pictures_of_a_small_table_are_made_by_several_tasks(spark, tmp_path):
    suppliers = spark.range(2500).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey"))
    suppliers.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    assert tiling.images(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_names_and_sizes_of_pictures_are_not_broadcast_by_estimate(spark, tmp_path):
    from lamina.catalog import tiling

    spark.createDataFrame([(k, f"s{k}", 1) for k in range(9)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    cells = spark.createDataFrame([(k, 0) for k in range(9)], "image_id long, tx long")
    named = tiling._named(spark, str(tmp_path))
    assert "BroadcastExchange" not in plan(named) and "BroadcastExchange" not in plan(cells.join(named, "image_id"))
    assert "BroadcastExchange" not in plan(cells.join(tiling.sizes(spark, str(tmp_path)), "image_id"))


def test_filter_clicks_stage_only_what_they_read(spark, monkeypatch):
    staged, plain = {}, states.stage
    monkeypatch.setattr(states, "stage", lambda df, label: staged.setdefault(label, df) and plain(df, label))
    layers = some_layers(spark)
    clicks = layers.select("doc_id", "seq_id", F.col("seq_id").alias("click_seq"), F.lit(True).alias("on"), F.lit(True).alias("solo"))
    states.apply_filter_toggles(layers, clicks)
    assert set(staged["clicked"].columns) == {"doc_id", "pos", "last", "last_at", "last_on", "on_at"}


def test_sets_of_a_filter_meet_the_layers_in_two_joins(spark):
    layers = stage_large(some_layers(spark), "layers")
    outer = layers.filter("seq_id > 10").select("doc_id", F.explode(F.array("path", "parent_path")).alias("path")).withColumn("level", F.lit(1))
    own = layers.filter("seq_id = 12").select("doc_id", F.explode(F.array("path", "path", "parent_path")).alias("path"))
    found = states.filter_effective(layers, outer, own)
    assert plan(found).count("SortMergeJoin") == 2
    rows = {(r.doc_id, r.seq_id): (r.enabled, r.selected) for r in found.collect()}
    assert len(rows) == 18
    assert rows[0, 10] == (False, False) and rows[0, 12] == (True, True) and rows[0, 13] == (True, False) and rows[0, 1] == (True, True)


def test_sets_of_many_filters_find_their_layers_once(spark, monkeypatch):
    numbered = bitsets.number_layers(some_layers(spark))
    sets = numbered.filter("seq_id > 10").select("doc_id", F.lit(1).alias("state_id"), "path")
    calls, plain = [], bitsets.find_layers
    monkeypatch.setattr(bitsets, "find_layers", lambda *a: calls.append(1) or plain(*a))
    bitsets.filters_effective(numbered, sets, sets.withColumn("level", F.lit(1)), sets)
    assert len(calls) == 1


def test_owners_of_overlays_are_worked_out_once(spark, monkeypatch):
    staged, plain = [], bitsets.stage
    numbered = bitsets.number_layers(some_layers(spark))
    sets = numbered.filter("seq_id > 10").select("doc_id", F.lit(1).alias("state_id"), "path")
    monkeypatch.setattr(bitsets, "stage", lambda df, label: staged.append(label) or plain(df, label))
    bitsets.apply_overlays(numbered, sets, sets)
    assert "owners" in staged
