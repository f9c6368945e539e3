"""Graphs of several entries with abnormal outcomes, and qualified occurrences, against plain searches over random programs."""

from collections import defaultdict

import pytest
from test_fixpoint import naive, program, successors
from test_summaries import values

from tidegraph.functions import truth
from tidegraph.operators import outcomes
from tidegraph.operators.dataflow import REACHED, UNKNOWN


def plain_edges(rows):
    last, after = {}, defaultdict(set)
    for r in rows:
        last[r[0]] = max(last.get(r[0], 0), r[1])
    for u, p, _, kind, k, *_ in rows:
        if kind == "error" and k % 10 == 0:
            after[u, p].add((-2, "CONTROL_EXIT"))
        else:
            ways = [(p + 1, "BRANCH_TRUE"), (p + 2 + k % 3, "BRANCH_FALSE")] if kind == "click" else [(p - k % 5, "JUMP")] if kind == "signup" and k % 10 == 0 and p > k % 5 else [(p + 1, "INVOKE_NORMAL" if kind == "error" else "JUMP")]
            after[u, p] |= {(t, w) if t <= last[u] else (-1, "RETURN") for t, w in ways}
        if kind == "error" and k % 2:
            around = [(j // 3 + 2, -q, q) for v, q, _, other, j, *_ in rows if v == u and other == "purchase" and j % 2 == 0 and q - 3 - j // 3 <= p < q]
            after[u, p].add((min(around)[2], "EXCEPTION") if around else (-3, "CONTROL_EXIT"))
    return after


def found(start, after):
    seen, work = set(), list(start)
    while work:
        x = work.pop()
        if x not in seen:
            seen.add(x)
            work += after(x)
    return seen


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 0)])
def test_graphs_of_entries(spark, seed, group):
    rows, b = program(spark, seed, *((20, 14) if group else (5, 8)))
    after = plain_edges(rows)
    name = {-1: "NORMAL", -2: "HALT", -3: "PROPAGATE"}
    want = set()
    for u, e, _, kind, k, *_ in rows:
        if e == 0 or kind == "signup" and k % 5 == 0:
            for _, p in found([(u, e)], lambda x: [(x[0], t) for t, _ in after[x] if t >= 0]):
                want |= {(u, e, p, t if t >= 0 else None, name.get(t), w) for t, w in after[u, p]}
    assert {tuple(r) for r in outcomes.graphs(b, group).collect()} == want
    counts = {(r.unit, r.entry): (r.normal, r.halt, r.propagate) for r in outcomes.exit_counts(b, group).collect()}
    assert counts == {(u, e): tuple(len({p for v, f, p, _, x, _ in want if (v, f) == (u, e) and x == y}) for y in name.values()) for u, e, *_ in want}
    if seed == 1:
        assert {w for *_, w in want} >= {"EXCEPTION", "CONTROL_EXIT", "RETURN"} and {x for *_, x, _ in want} >= {"NORMAL", "HALT", "PROPAGATE"}


def test_the_innermost_scope_handles(spark):
    sites = spark.createDataFrame([(1, 5), (1, 50), (2, 5)], "unit long, pos long")
    scopes = spark.createDataFrame([(1, 10, 0, 9), (1, 8, 4, 7), (1, 9, 5, 8), (1, 20, 6, 19), (3, 1, 0, 9)], "unit long, handler long, first long, last long")
    assert {tuple(r) for r in outcomes.handlers(sites, scopes).collect()} == {(1, 5, 9), (1, 50, None), (2, 5, None)}


def test_qualified_occurrences(spark):
    statuses = set()
    for seed in (4, 5, 6):
        rows, b = program(spark, seed, units=25, most=12)
        rows.append((99, 0, 99, "purchase", 4, 0, 1, 1, "PURCHASE"))
        b = spark.createDataFrame(rows, b.schema)
        after, block = successors(rows), {(r[0], r[1]): r for r in rows}
        step = lambda x: [(x[0], t) for t in after[x]]  # noqa: B023, E731
        known = found({(r[0], 0) for r in rows}, step)
        bounded = lambda x: [(x[0], r[1]) for r in rows if r[0] == x[0] and r[3] == "signup" and r[4] % 10 == 0] if block[x][3] == "purchase" and block[x][4] % 25 == 0 else []  # noqa: B023, E731
        unsure = found({y for x in known for y in bounded(x)}, lambda x: step(x) + bounded(x))  # noqa: B023
        made = defaultdict(set)
        for u, p, f in naive(rows, [(REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(4))], values):
            if f[0] == 0:
                made[u, p].add(f[1:])
        want = set()
        for u, p, _, kind, *_ in rows:
            if kind != "purchase":
                continue
            status = "CONTROL_UNAVAILABLE" if sum(r[0] == u for r in rows) < 2 else "POSSIBLE_UNDER_UNKNOWN_CONTROL" if (u, p) in unsure else "QUALIFIED_POSSIBLE" if (u, p) in known else "NOT_QUALIFIED"
            names = sorted({v for v, _ in made[u, p]} - {UNKNOWN}) if "POSSIBLE" in status else []
            closed = bool(made[u, p]) and all(d >= 0 and block[u, d][6] == 0 and (u, d) not in unsure for _, d in made[u, p])
            want.add((u, p, status, len(names), status != "QUALIFIED_POSSIBLE" or not closed, "|".join(names)))
            statuses.add(status)
        assert {tuple(r) for r in outcomes.qualified(b).collect()} == want
    assert len(statuses) == 4


def test_comparisons_with_what_is_not_known(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(1, 2), (2, 2), (None, 2), (1, None)], "a long, b long").select(*(truth.compare(F.col("a"), op, F.col("b")) for op in ("LT", "EQ", "NE", "GE"))).collect()
    assert [tuple(r) for r in got] == [(2, 1, 2, 1), (1, 2, 1, 2), (3, 3, 3, 3), (3, 3, 3, 3)]


def test_derived_values_need_all_premises(spark):
    """Against rounds over everything, with rules that feed back, cycles without ground and values that predicates stop."""
    import random

    from tidegraph.operators.derivations import derived_values

    for seed in (1, 2, 3):
        rng = random.Random(seed)
        nodes = [f"n{i}" for i in range(25)]
        rules = [(f"r{i}", rng.choice(nodes), rng.choice(nodes), *rng.choice([("ANY", ""), ("NOT", "a"), ("PREFIX", "b")])) for i in range(60)]
        premises = [(r[0], p) for r in rules for p in rng.sample(nodes, rng.choice([0, 0, 1, 2]))]
        seeds = [(n, v) for n in rng.sample(nodes, 5) for v in rng.sample(["a", "ab", "b", "ba", "c"], 2)]
        held = set(seeds)
        while True:
            there = {n for n, _ in held}
            lets = {"ANY": lambda v, x: True, "NOT": lambda v, x: v != x, "PREFIX": str.startswith}
            more = {(h, v) for r, h, c, kind, arg in rules if all(p in there for q, p in premises if q == r) for n, v in held if n == c and lets[kind](v, arg)}
            if more <= held:
                break
            held |= more
        frames = (spark.createDataFrame(x or [("", "")], t) for x, t in ((rules, "rule string, head string, carrier string, kind string, arg string"), (premises, "rule string, premise string"), (seeds, "node string, val string")))
        assert {tuple(r) for r in derived_values(*frames).collect()} == held
