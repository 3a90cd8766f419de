"""Documents in buckets: one shuffle, then joins, groups and unions by doc_id stay in place; large documents are spread as before."""

import random

from pyspark.sql import functions as F

from lamina.operators import views as V
from lamina.session import CO_PARTITION_CONF, bucketed, by_document, in_buckets, stage, stage_large


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, docs=40):
    rng = random.Random(4)
    rows = [(doc, k, rng.randint(0, 9)) for doc in [*range(docs), None] for k in range(rng.randint(1, 6))]
    return spark.createDataFrame([*rows, *[(-1, k, k % 7) for k in range(60)]], "doc_id long, k long, v long")


def work(rows):
    """A group, a union, joins and a window's worth of work by document."""
    sums = stage_large(rows.groupBy("doc_id", "v").agg(F.count("*").alias("n")), "sums")
    both = rows.select("doc_id", "v").unionByName(sums.filter("n > 1").select("doc_id", "v"))
    met = both.join(sums, ["doc_id", "v"], "left")
    return met.groupBy("doc_id", "n").agg(F.sum("v").alias("v"), F.count("*").alias("rows"))


def test_work_by_document_needs_no_shuffle(spark):
    rows = table(spark)
    assert "Exchange" in plan(work(stage_large(rows, "rows")))
    with in_buckets(spark, 3):
        assert bucketed() == 3
        out = work(stage_large(rows, "rows"))
        assert "Exchange" not in plan(out)
        out = stage(out, "out")
    assert bucketed() == 0 and spark.conf.get(CO_PARTITION_CONF) == "true"
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, work(rows).collect()), key=str)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lamina_")]


def test_large_documents_go_on_their_own(spark):
    rows, seen = table(spark), []

    def run(part):
        seen.append((bucketed() > 0, {r.doc_id for r in part.select("doc_id").distinct().collect()}))
        return work(part)

    out = by_document(rows, run, most=20)
    assert [b for b, _ in seen] == [True, False]
    assert seen[1][1] == {-1} and seen[0][1] == {*range(40), None}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, work(rows).collect()), key=str)


def test_views_of_documents_in_buckets_stay_in_place(spark, monkeypatch):
    data = [(doc, "r", o, i, 3, f"{o}-{i}") for doc in range(9) for o in range(2) for i in range(3)]
    selects = spark.createDataFrame(data, "doc_id long, root_id string, select_ord long, item_ord long, size long, item_id string")
    deltas = spark.createDataFrame(
        [(doc, f"{o}-{i}", k, (o + i + k) % 2 == 0) for doc in range(9) for o in range(2) for i in range(3) for k in (1, 2 + o)],
        "doc_id long, item_id string, seq_id long, checked boolean",
    )

    def resolved(stage_all):
        chosen, touched = stage_all(selects, "selects"), stage_all(deltas, "deltas")
        return V.resolve_views(None, chosen, V.enumerate_views(chosen), touched)

    want = {tuple(r) for r in resolved(stage_large).collect()}
    assert len(want) == 9 * 9 * 3
    for block, stays in ((1 << 16, True), (4, False)):
        monkeypatch.setattr(V, "VIEW_BLOCK", block)
        with in_buckets(spark, 3):
            out = resolved(stage_large)
            assert ("Exchange" not in plan(out)) == stays
            out = stage(out, "out")
        assert {tuple(r) for r in out.collect()} == want
