"""What the driver keeps of small plans: threads and plan histories grow with exchanges and queries."""

from pyspark.sql import functions as F

from textveil.llm.common import cut, row_count, sized
from textveil.llm.components import connected_components


def _plans(spark, run):
    """What ``run`` returns, and the plans of the queries that it ran."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = {e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    out = run()
    bus.waitUntilEmpty(30_000)
    now = store.executionsList()
    return out, [e.physicalPlanDescription() for e in map(now.apply, range(now.size())) if e.executionId() not in before]


def test_slim_tables_are_counted_without_an_exchange(spark):
    table = cut(spark.range(70).where("id % 7 = 0"))
    (n, _), plans = _plans(spark, lambda: (row_count(table), sized(table)))
    assert n == 10 and not any("Exchange" in p or "AdaptiveSparkPlan" in p for p in plans)
    assert row_count(spark.range(0)) == 0


def test_rounds_of_components_join_by_broadcast(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 150")
    labels, plans = _plans(spark, lambda: connected_components(chain))
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    found = {r.node: r.component for r in labels.collect()}
    assert len(found) == 301 and len({found[i] for i in range(151)}) == len({found[i] for i in range(151, 301)}) == 1 and len(set(found.values())) == 2
