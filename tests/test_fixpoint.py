"""Fixpoints against naive oracles over random programs, in both physical ways, and laws they keep."""

import random

import pytest

from tidegraph.operators import cfg, contexts, dataflow, fixpoint, storage
from tidegraph.operators.dataflow import REACHED

KINDS = ["view", "click", "purchase", "signup", "error"]


def program(spark, seed, units=6, most=12):
    rng = random.Random(seed)
    rows = []
    for unit in range(units):
        for pos in range(rng.randint(1, most)):
            kind, k = rng.choice(KINDS), rng.choice([0, 4, 10, 20, 25, 30, 35, 40, rng.randint(0, 99)])
            rows.append((unit, pos, unit * 1000 + pos, kind, k, k % 4, k % 3, (k + 1) % 4, kind.upper()))
    schema = "unit long, pos long, event_id long, event_type string, k long, cell long, action long, source long, literal string"
    return rows, spark.createDataFrame(rows, schema)


def successors(rows):
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], 0), r[1])
    out = {}
    for u, p, _, kind, k, *_ in rows:
        to = []
        if kind == "click":
            to = [p + 1, p + 2 + k % 3]
        elif kind == "signup" and k % 10 == 0 and p > k % 5:
            to = [p - k % 5]
        elif not (kind == "error" and k % 10 == 0):
            to = [p + 1]
        out[u, p] = [t for t in to if t <= last[u]]
    return out


def naive(rows, start, transfer):
    """Round after round over everything, until nothing changes."""
    after, block = successors(rows), {(r[0], r[1]): r for r in rows}
    facts = {(u, 0, f) for u in {r[0] for r in rows} for f in start}
    while True:
        more = {(u, to, g) for u, p, f in facts for g in transfer(block[u, p], f) for to in after[u, p]}
        if more <= facts:
            return facts
        facts |= more


def values(block, f):
    out = []
    cell, action, source, literal = block[5:]
    if f[0] == -1:
        out.append(f)
        if action != 1:
            out.append((cell, literal if action == 0 else "?"))
    else:
        if f[0] != cell:
            out.append(f)
        if action == 1 and f[0] == source:
            out.append((cell, f[1]))
    return out


def definitions(block, f):
    if f[0] == -1:
        return [f, (block[5], block[1])]
    return [] if f[0] == block[5] else [f]


@pytest.mark.parametrize("seed", [19073, 19074, 27001])
@pytest.mark.parametrize("group", [10_000, 0])
def test_values_and_definitions(spark, seed, group):
    rows, b = program(spark, seed)
    got = {tuple(r) for r in dataflow.possible_values(b, group).collect()}
    want = naive(rows, [(-1, ""), *((c, "?") for c in range(4))], values)
    assert got == {(u, p, *f) for u, p, f in want if f[0] != -1}
    got = {tuple(r) for r in dataflow.reaching_definitions(b, group).collect()}
    want = naive(rows, [(-1, -1), *((c, -1) for c in range(4))], definitions)
    assert got == {(u, p, *f) for u, p, f in want if f[0] != -1}


def test_both_ways_agree_on_stacks_and_reach(spark):
    _, b = program(spark, 5, units=8, most=20)
    for analysis in (dataflow.reach, dataflow.reverse_reach, dataflow.value_support, contexts.stacks):
        assert sorted(analysis(b).collect()) == sorted(analysis(b, 0).collect())


def _stack(block, f):
    """Calls push their place unless it is in the stack, returns pop."""
    if block[3] == "error" and block[4] % 4 == 0 and block[4] % 10:
        return [] if block[1] in f else [(*f, block[1])]
    if block[3] == "view" and block[4] % 2 == 0:
        return [f[:-1]]
    return [f]


def test_stacks_have_no_depth_limit_and_recursion_is_a_repeated_place(spark):
    for seed in (5, 21, 22):
        rows, b = program(spark, seed, units=12, most=40)
        want = naive(rows, [()], _stack)
        written = lambda f: "".join(f"/{x}" for x in f)
        assert {tuple(r) for r in contexts.stacks(b).collect()} == {(u, p, written(f)) for u, p, f in want}
        block = {(r[0], r[1]): r for r in rows}
        recursive = {(u, p, written(f)) for u, p, f in want if not _stack(block[u, p], f)}
        assert {tuple(r) for r in contexts.recursive(b).collect()} == recursive
    # a straight unit of five nested calls
    straight = [(1, p, p, kind, k, 0, 0, 0, kind) for p, (kind, k) in enumerate([("error", 4)] * 5 + [("purchase", 1)])]
    b = spark.createDataFrame(straight, b.schema)
    assert (1, 5, "/0/1/2/3/4") in {tuple(r) for r in contexts.stacks(b).collect()}


def test_overlaps_of_writes_that_are_no_neighbours(spark):
    rows = [(1, 0, p, s, e) for p, (s, e) in enumerate([(0, 8), (20, 22), (4, 6), (0, 8), (6, 9)])]
    got = {tuple(r) for r in storage.overlaps(spark.createDataFrame(rows, "unit long, base long, pos long, start long, end long")).collect()}
    assert got == {(1, 0, 0, 8, 2, 0, 8, 2), (1, 0, 0, 8, 2, 4, 6, 1), (1, 0, 0, 8, 2, 6, 9, 1)}


def test_order_of_rows_does_not_matter(spark):
    rows, b = program(spark, 8)
    random.Random(1).shuffle(rows)
    again = spark.createDataFrame(rows, b.schema)
    assert sorted(dataflow.value_support(b).collect()) == sorted(dataflow.value_support(again).collect())
    assert sorted(cfg.nodes(b).collect()) == sorted(cfg.nodes(again).collect())


def test_another_unit_changes_nothing(spark):
    rows, b = program(spark, 9)
    more, _ = program(spark, 10)
    both = spark.createDataFrame(rows + [(r[0] + 100, *r[1:]) for r in more], b.schema)
    assert sorted(dataflow.possible_values(both).where("unit < 100").collect()) == sorted(dataflow.possible_values(b).collect())


def test_pruning_only_removes(spark):
    _, b = program(spark, 11, units=10, most=20)
    pruned, whole = ({tuple(r) for r in f(b).collect()} for f in (contexts.pruned_values, dataflow.possible_values))
    assert pruned <= whole


def test_and_closure_leaves_ungrounded_cycles_out(spark):
    rules = spark.createDataFrame([("1", "a", "c"), ("1", "b", "c"), ("2", "c", "d"), ("3", "x", "y"), ("4", "y", "x"), ("5", "a", "e"), ("5", "z", "e")], "rule string, premise string, head string")
    seeds = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {r.node for r in fixpoint.and_closure(rules, seeds).collect()} == {"a", "b", "c", "d"}


def test_closure_over_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r.node for r in fixpoint.closure(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {1, 2, 3}


def test_alias_chains_and_cycles(spark):
    a = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 9), (1, 5, 6), (1, 6, 5), (1, 7, 5)], "unit long, id long, of long")
    roots, cycles = storage.resolved(a)
    assert {tuple(r) for r in roots.collect()} == {(1, 1, 9), (1, 2, 9), (1, 3, 9)}
    assert {r.id for r in cycles.collect()} == {5, 6, 7}


def test_empty_program(spark):
    _, b = program(spark, 1)
    none = b.where("unit < 0")
    assert dataflow.possible_values(none).count() == 0 and contexts.stacks(none).count() == 0 and cfg.edges(none).count() == 0
    assert REACHED == -1
