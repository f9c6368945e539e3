"""Exit summaries against explicit stacks, byte definitions against single bytes, expressions against plain evaluation."""

import itertools
import random
import time
from collections import defaultdict

import pytest
from test_fixpoint import naive, program, successors

from tidegraph.operators import cfg, dataflow, expressions, regions, summaries
from tidegraph.operators.dataflow import REACHED, UNKNOWN

BLOCKS = "unit long, pos long, event_id long, event_type string, k long, cell long, action long, source long, literal string"
START = [(REACHED, "", -1), *((c, UNKNOWN, -1) for c in range(4))]


def values(block, f):
    """A block's effect on a value with the block that made it."""
    (_, pos, _, _, _, cell, action, source, literal), out = block, []
    if f[0] == REACHED:
        return [f] if action == 1 else [f, (cell, literal if action == 0 else UNKNOWN, pos)]
    if f[0] != cell:
        out.append(f)
    if action == 1 and f[0] == source:
        out.append((cell, *f[1:]))
    return out


def called(rows):
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], 0), r[1])
    return {(u, p): (p + 2 + k % 7, p + 1 if p < last[u] else None) for u, p, _, kind, k, *_ in rows if kind == "error" and k % 4 == 0 and k % 10 and p + 2 + k % 7 <= last[u]}


def stacked(rows, transfer, start, most):
    """(unit, pos, stack, fact): facts under explicit stacks of (place to come back to, procedure), up to a depth."""
    after, block, calls = successors(rows), {(r[0], r[1]): r for r in rows}, called(rows)
    held = {(u, 0, (), f) for u in {r[0] for r in rows} for f in start}
    work = list(held)
    while work:
        u, p, stack, f = work.pop()
        ends = block[u, p][3] == "view" and block[u, p][4] % 2 == 0
        for g in transfer(block[u, p], f):
            if (u, p) in calls:
                to, back = calls[u, p]
                new = [(u, to, (*stack, (p, back, to)), g)] if len(stack) < most else []
            elif ends and stack:
                new = [(u, stack[-1][1], stack[:-1], g)] if stack[-1][1] is not None else []
            else:
                new = [(u, to, stack, g) for to in after[u, p]]
            work += [x for x in new if x not in held]
            held.update(new)
    return held


def forward(spark, seed, units=8, most=14):
    """A program without back edges, in which no procedure can enter itself."""
    rng = random.Random(seed)
    kinds = ["view", "click", "purchase", "error", "error"]
    rows = [(u, p, u * 100 + p, kind, k, k % 4, k % 3, (k + 1) % 4, kind.upper()) for u in range(units) for p in range(rng.randint(2, most)) for kind, k in [(rng.choice(kinds), rng.choice([4, 8, 12, 16, 24, 28, 3, 6, 7, rng.randint(0, 99)]))]]
    return rows, spark.createDataFrame(rows, BLOCKS)


@pytest.mark.parametrize("group", [20_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_summaries_equal_explicit_stacks(spark, seed, group):
    rows, b = forward(spark, seed, *((8, 14) if group else (4, 9)))
    held = stacked(rows, values, START, 40)
    assert not group or any(len(s) > (seed == 1) for _, _, s, _ in held)
    assert {tuple(r) for r in summaries.values(b, group).collect()} == {(u, p, *f) for u, p, _, f in held if f[0] != REACHED}
    entry = lambda s: s[-1][2] if s else -1
    assert {tuple(r) for r in summaries.reach(b, group).collect()} == {(u, entry(s), p) for u, p, s, f in held if f[0] == REACHED}
    contexts = defaultdict(set)
    for u, p, s, f in held:
        if f[0] == REACHED:
            contexts[u, p].add("".join(f"/{x}" for x, _, _ in s))
    want = {(*at, next(iter(c)) if len(c) == 1 else None) for at, c in contexts.items()}
    assert {tuple(r) for r in summaries.unique_contexts(b, group).collect()} == want


def test_recursion_ends_and_loses_nothing(spark):
    """Of programs that call themselves, stacks of more and more places find what summaries find at once."""
    for seed in (3, 4, 7):
        rows, b = program(spark, seed, units=10, most=9)
        got = {tuple(r) for r in summaries.values(b).collect()}
        deep = [{(u, p, *f) for u, p, _, f in stacked(rows, values, START, most) if f[0] != REACHED} for most in (5, 6, 7)]
        assert deep[1] == deep[2] == got
    rows, b = program(spark, 7, units=5, most=8)
    assert sorted(summaries.values(b).collect()) == sorted(summaries.values(b, 0).collect())


def test_many_optional_calls_take_few_rows(spark):
    """Forty calls, each of which may be left out: 2 ** 40 stacks, and as many summaries as facts."""
    kinds = [("click", 1), ("error", 4)] * 40 + [("view", 2)]  # click: the next block or the one after three
    rows = [(1, p, p, kind, k, k % 4, k % 3, (k + 1) % 4, kind.upper()) for p, (kind, k) in enumerate(kinds)]
    b = spark.createDataFrame(rows, BLOCKS)
    began = time.perf_counter()
    n = summaries.activations(b, b.selectExpr("unit", "pos AS src", "pos + 1 AS dst").where("src < 80"), summaries.calls(b), summaries.exits(b), dataflow._entry(b, *START), dataflow.VALUES).count()
    assert n < 81 * 5 * 81 * 6 and time.perf_counter() - began < 40


def test_exit_summaries_are_what_comes_back(spark):
    rows, b = forward(spark, 5)
    got = {tuple(r) for r in summaries.exit_summaries(b).collect()}
    block, calls = {(r[0], r[1]): r for r in rows}, called(rows)
    want = set()
    for u, to in {(u, to) for (u, _), (to, _) in calls.items()}:
        own = [r for r in rows if r[0] == u]
        entered = {(f[0], f[1]) for w, p, s, f in stacked(own, values, START, 40) if p == to and s and s[-1][2] == to and w == u}
        for cell, val in entered:  # the procedure by itself, from one fact
            held, work = set(), [(u, to, (), (cell, val, -7))]
            after = successors(own)
            while work:
                x = work.pop()
                if x in held:
                    continue
                held.add(x)
                _, p, stack, f = x
                for g in values(block[u, p], f):
                    if (u, p) in calls:
                        work.append((u, calls[u, p][0], (*stack, calls[u, p][1]), g))
                    elif block[u, p][3] == "view" and block[u, p][4] % 2 == 0:
                        if not stack:
                            want.add((u, to, cell, val, g[0], g[1]))
                        elif stack[-1] is not None:
                            work.append((u, stack[-1], stack[:-1], g))
                    else:
                        work += [(u, q, stack, g) for q in after[u, p]]
    assert got == want


# bytes


def by_byte(block, f):
    kind, k, cell, action = block[3], block[4], block[5], block[6]
    own = range(k % 16, k % 16 + len(kind))
    if f[0] == REACHED:
        anywhere = action == 2 and k > 90
        return [f, *((c, at, block[1]) for c in range(4) for at in range(32) if anywhere or c == cell and at in own)]
    return [] if action != 2 and f[0] == cell and f[1] in own else [f]


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 0)])
def test_definitions_by_byte(spark, seed, group):
    rows, b = program(spark, seed, *((6, 16) if group else (3, 8)))
    rows += [(50, p, p, kind, k, k % 4, k % 3, (k + 1) % 4, kind.upper()) for p, (kind, k) in enumerate([("view", 4), ("view", 95), ("purchase", 0), ("view", 8), ("click", 20), ("view", 0), ("view", 1)])]
    b = spark.createDataFrame(rows, b.schema)
    held = naive(rows, [(REACHED, "", -1), *((c, at, -1) for c in range(4) for at in range(32))], by_byte)
    block, spans = {(r[0], r[1]): r for r in rows}, defaultdict(set)
    for u, p, (c, at, d) in held:
        if c != REACHED:
            spans[u, p, c, d].add(at)
    want = set()
    for (u, p, c, d), at in spans.items():
        how = "must" if d < 0 or block[u, d][6] != 2 else "anywhere" if block[u, d][4] > 90 else "may"
        for _, run in itertools.groupby(sorted(at), lambda x, n=itertools.count(): x - next(n)):
            run = list(run)
            want.add((u, p, c, d, run[0], run[-1] + 1, how))
    got = {tuple(r) for r in regions.byte_definitions(b, group).select("unit", "pos", "base", "def_pos", "start", "end", "strength").collect()}
    assert got == want
    reached = {(u, p) for u, p, f in held if f[0] == REACHED}
    sure = {(u, p, c, 32 - len(spans.get((u, p, c, -1), ()))) for u, p in reached for c in range(4)}
    assert {tuple(r) for r in regions.surely_written(b, group).collect()} == {x for x in sure if x[3]}


def test_a_strong_write_leaves_two_pieces_and_a_weak_one_all():
    block = {"pos": 3, "cell": 1, "literal": "4:8:must"}
    assert regions._alone(block, (1, "0:32", -1)) == [(1, "0:4", -1), (1, "8:32", -1)] and regions._alone(block, (1, "5:7", 2)) == []
    assert regions._alone(block, (2, "0:32", -1)) == [(2, "0:32", -1)] == regions._alone(block | {"literal": "4:8:may", "cell": 2}, (2, "0:32", -1))


# expressions


def plain(nodes, at, cells):
    """Alternatives of one expression by recursion; cells: alternatives (None for unknown) of each cell."""
    def value(n, snap):
        x = nodes[n]
        if x["op"] == "LITERAL":
            return x["text"]
        if x["op"] == "READ":
            return snap.get(x["cell"])
        if x["op"] in ("UNKNOWN", "CHOICE"):
            return None
        left = value(x["left"], snap)
        if x["op"] == "CONCAT":
            right = value(x["right"], snap)
            return None if left is None or right is None else left + right
        if x["op"] == "FILL":
            return (left if left is not None and len(left) == 1 else "�") * x["a"]
        if x["op"] == "FIT":
            return "�" * x["a"] if left is None else left[: x["a"]].ljust(x["a"])
        return left[x["a"] : x["a"] + x["b"]] if left is not None and x["a"] + x["b"] <= len(left) else "�" * x["b"]

    tops, work = [], [at]
    while work:
        x = nodes[work.pop()]
        if x["op"] == "CHOICE":
            work += [x["left"], x["right"]]
        else:
            tops.append(x["node"])
    fixed = {c: v[0] for c, v in cells.items() if len(v) == 1}
    snaps = [fixed | {c: v} for c, all_ in cells.items() if len(all_) > 1 for v in all_] or [fixed]
    return {UNKNOWN if (v := value(t, s)) is None else v for s in snaps for t in tops}


def test_expressions_equal_plain_evaluation(spark):
    rng = random.Random(6)
    node = "unit long, pos long, node long, op string, text string, cell long, a long, b long, left long, right long, height long"
    trees, want, held = [], set(), []
    for pos in range(60):
        mine = {}

        def grow(depth, top, pos=pos, mine=mine):
            n = len(mine)
            mine[n] = None
            op = rng.choice(["LITERAL", "READ", "READ", "UNKNOWN"] if depth == 0 else ["FILL", "FIT", "SLICE", "CONCAT", "CONCAT", "READ", *["CHOICE"] * (2 * top or rng.random() < 0.1)])
            x = dict(unit=1, pos=pos, node=n, op=op, text=rng.choice(["*", "ab", "", "x y"]) if op == "LITERAL" else None, cell=rng.randint(0, 3) if op == "READ" else None, a=rng.randint(0, 6) if op in ("FILL", "FIT", "SLICE") else None, b=rng.randint(0, 4) if op == "SLICE" else None, left=None, right=None, height=0)
            sides = ["left", "right"] if op in ("CONCAT", "CHOICE") else ["left"] if op in ("FILL", "FIT", "SLICE") else []
            for side in sides:
                x[side] = grow(depth - 1, top and op == "CHOICE")
            x["height"] = 1 + max(mine[x[s]]["height"] for s in sides) if sides else 0
            mine[n] = x
            return n

        grow(rng.randint(0, 4), True)
        trees += mine.values()
        cells = {c: rng.sample(["a", "bb", "*", "long text", UNKNOWN], rng.randint(0, 3)) for c in range(4)}
        held += [(1, pos, c, v) for c, vs in cells.items() for v in vs]
        known = {c: sorted(v for v in vs if v != UNKNOWN) + [None] * (UNKNOWN in vs or not vs) for c, vs in cells.items()}
        read = {x["cell"] for x in mine.values() if x["op"] == "READ"}
        want |= {(1, pos, v) for v in plain(mine, 0, {c: known[c] for c in read})}
    nodes = spark.createDataFrame([tuple(x[c.split()[0]] for c in node.split(", ")) for x in trees], node)
    got = expressions.evaluate(nodes, spark.createDataFrame(held, "unit long, pos long, cell long, val string"))
    assert {tuple(r) for r in got.collect()} == want
    none = expressions.evaluate(nodes.where("pos < 0"), dataflow.possible_values(spark.createDataFrame([], BLOCKS)))
    assert none.count() == 0 and expressions.assigned(none).count() == 0


def test_no_program(spark):
    none = spark.createDataFrame([], BLOCKS)
    for f in (summaries.values, summaries.reach, summaries.exit_summaries, summaries.unique_contexts, regions.byte_definitions, regions.surely_written):
        assert f(none).count() == 0
    assert cfg.edges(none).count() == 0
