"""Closures over rules with AND premises: against rounds over everything, and what they leave on disk."""

import os
import random
from pathlib import Path

import pytest

from tidegraph.operators import derivations, fixpoint
from tidegraph.operators.shared import PIECES
from tidegraph.plans import catalog

TABLES = "/root/testdata/sf0.01"


def written(spark) -> int:
    """Bytes of all checkpoints of the session, and of the shuffles that are still there."""
    spark.range(1).checkpoint()
    folders = [spark.sparkContext.getCheckpointDir().removeprefix("file:"), *spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    return sum(os.path.getsize(f) for x in folders for f in Path(x).rglob("*") if f.is_file())


def left_by(spark, name: str) -> int:
    """Bytes that a query over the tables of sf0.01 leaves."""
    before = written(spark)
    df = catalog.queries()[name](spark, TABLES)
    df.write.format("noop").mode("overwrite").save()
    return written(spark) - before


@pytest.mark.parametrize("name", ["and_closure", "assumed_only"])
def test_closures_write_less_than_their_table(spark, name):
    assert left_by(spark, name) < os.path.getsize(f"{TABLES}/lineitem.parquet")


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_and_closure_with_edges_against_rounds_over_everything(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    rules = [(f"r{i % 30}", p, rng.choice(nodes)) for i in range(60) for p in rng.choices([*nodes, None], k=rng.choice([1, 2]))]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25)]
    held = seeds = set(rng.sample(nodes, 5))
    premises: dict = {}
    for r, p, h in rules:
        premises.setdefault((r, h), set()).add(p)
    while True:
        more = {h for (_, h), p in premises.items() if p <= held} | {h for p, h in edges if p in held}
        if more <= held:
            break
        held = held | more
    rules, edges = spark.createDataFrame(rules * 2, "rule string, premise long, head long"), spark.createDataFrame(edges * 2, "premise long, head long")
    got = [x.node for x in fixpoint.and_closure(rules, spark.createDataFrame([(x,) for x in seeds], "node long"), edges).collect()]
    assert sorted(got) == sorted(held)


def test_and_closure_over_more_rounds_than_pieces(spark):
    """A ladder: each step needs the two before it, or an edge; a head without a name ends nothing and repeats nothing."""
    n = PIECES + 4
    rules = spark.createDataFrame([("s", i + j, i + 2) for i in range(0, n, 2) for j in (0, 1)] + [("none", 0, None)], "rule string, premise long, head long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(2, n, 2)] + [(1, None)], "premise long, head long")
    got = [x.node for x in fixpoint.and_closure(rules, spark.createDataFrame([(0,), (1,)], "node long"), edges).collect()]
    assert len(got) == len(set(got)) and set(got) == {*range(n + 1), None}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_derived_nations_writes_less_than_its_tables(spark):
    assert left_by(spark, "derived_nations") < os.path.getsize(f"{TABLES}/lineitem.parquet") + os.path.getsize(f"{TABLES}/orders.parquet")


@pytest.mark.parametrize("n_values", [3, 200])
def test_derived_values_of_several_blocks_and_carriers(spark, monkeypatch, n_values):
    """Rules of one and of several carriers, with and without premises, nulls everywhere; values numbered by several tasks."""
    monkeypatch.setattr(derivations, "NUMBERED", 90)
    rng = random.Random(n_values)
    nodes, vals = [*range(40), None], [*(f"{rng.choice('abc')}{i}" for i in range(n_values)), None]
    tests = [("ANY", ""), ("NOT", vals[0]), ("NOT", vals[1]), ("NOT", "none of them"), ("NOT", None), ("PREFIX", "a"), ("PREFIX", ""), ("PREFIX", "zz"), ("PREFIX", None), (None, None)]
    rules = [(rng.choice([f"r{i}", f"r{i}", None]), h, rng.choice(nodes), *rng.choice(tests)) for i in range(40) for h in [rng.choice(nodes)] for _ in range(rng.choice([1, 1, 2, 3]))]
    premises = [(f"r{i}", rng.choice(nodes)) for i in range(0, 40, 3)]
    seeds = [(n, v) for n in rng.sample(nodes[:-1], 20) for v in rng.sample(vals, 3)] + [(n, None) for n in rng.sample(nodes, 3)] + [(None, vals[0])]
    held = set(seeds)
    lets = lambda kind, arg, v: arg is not None and v is not None and (v != arg if kind == "NOT" else v.startswith(arg)) if kind in ("NOT", "PREFIX") else True
    while True:
        there = {n for n, _ in held if n is not None}
        needs: dict = {}
        for r, h, c, *_ in rules:
            needs.setdefault((r, h), {p for q, p in premises if q == r}).add(c)
        more = {(h, v) for r, h, c, kind, arg in rules if r is None or needs[r, h] <= there for n, v in held if n is not None and n == c and lets(kind, arg, v)}
        if more <= held:
            break
        held |= more
    frames = (spark.createDataFrame(x * 2, t) for x, t in ((rules, "rule string, head long, carrier long, kind string, arg string"), (premises, "rule string, premise long"), (seeds, "node long, val string")))
    got = [tuple(r) for r in derivations.derived_values(*frames).collect()]
    assert len(got) == len(set(got)) and set(got) == held and len(held) > len(set(seeds)) + 20


def test_derived_values_without_rules(spark):
    rules = spark.createDataFrame([], "rule string, head long, carrier long, kind string, arg string")
    for seeds in ([], [(1, "a"), (1, None)]):
        got = derivations.derived_values(rules, None, spark.createDataFrame(seeds, "node long, val string")).collect()
        assert {tuple(r) for r in got} == set(seeds)


def test_keys_without_a_node_stop_the_query(spark):
    keys = spark.createDataFrame([(-5,), (None,), (2**61 - 1,)], "k long")
    got = [[r[0] for r in keys.select(catalog._node(kind, "k").alias("node")).select(catalog._node_name("node")).collect()] for kind in "osp"]
    assert got == [[f"{kind}-5", None, f"{kind}{2**61 - 1}"] for kind in "osp"]
    with pytest.raises(Exception, match="k has no node"):
        spark.createDataFrame([(2**61,)], "k long").select(catalog._node("o", "k")).collect()
