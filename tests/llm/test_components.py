"""Connected components: results against brute force, and what a call costs the driver."""

import random

import pytest

from tapewire.llm import tables


def chain(n):
    return [(k, k + 1) for k in range(1, n)]


def odd_edges(seed=5):
    rng = random.Random(seed)
    hub = [(1_000_000 + k, 3_000_000) for k in range(300)] + [(2_000_000, 1_000_000 + k) for k in range(0, 300, 7)]
    loose = [(rng.randrange(-400, 400) * 7, rng.randrange(-400, 400) * 7) for _ in range(250)]
    mixed = chain(200) + [(10_000 - k, 10_000 - k - 1) for k in range(150)]
    edges = hub + loose + mixed + loose[:20] + [(9, 9), (-(2**62), 2**62)]
    rng.shuffle(edges)
    return edges


def smallest(edges):
    at = {}
    for x, y in edges:
        at.setdefault(x, x), at.setdefault(y, y)
    while True:
        before = dict(at)
        for x, y in edges:
            at[x] = at[y] = min(at[x], at[y])
        if at == before:
            return at


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tables, "BLOCK_EDGES", block)
    edges = odd_edges()
    got = tables.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    want = smallest([(x, y) for x, y in edges if x != y])
    assert len(got) == len(want) and {r["vertex"]: r["component"] for r in got} == want


def test_components_of_no_edges(spark):
    assert tables.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []


def test_components_task_count(spark):
    """The driver keeps each task's and plan's record: a call's tasks stay few where partitions are many."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        spark.sparkContext.setJobGroup("components", "components")
        edges = [(k - k % 50, k) for k in range(2000)]
        tables.components(spark.createDataFrame(edges, "a long, b long").repartition(8))
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
        ran = [i for s in stages if (i := tracker.getStageInfo(s)) is not None and i.numCompletedTasks]
        n = sum(i.numCompletedTasks for i in ran)
        print("tasks", n)
        assert n < 300
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for key, value in was.items():
            spark.conf.set(key, value)
