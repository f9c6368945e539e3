"""Ball-tree clusters, WARC transactions and source divergence against brute force, and on defined edge cases."""

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import ball_tree, divergence, warc

VECTORS = "vec_id long, embedding array<float>, cluster int, distance string"


def plain_clusters(rows, k=40, rounds=5, dims=64):
    """vec_id, cluster, distance and the like by Python integers."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            y = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            if max(map(abs, y)) < 1 << 27:
                kept.append((i, y))
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        best = [min((apart(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            own = defaultdict(list)
            for (_, n), (_, v) in zip(best, kept, strict=True):
                own[n].append(v)
            centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    total = Counter()
    for d, n in best:
        total[n] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return Counter((i, n, d, total[n], sum(total.values()), digest(centroids[n])) for (i, _), (d, n) in zip(kept, best, strict=True))


def vectors(n, scale=1.0, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64))
    out = [(i, (scale * (middle[i % 6] + rng.normal(size=64) * (0.01, 0.3)[i % 2])).tolist(), 1, "x") for i in range(n)]
    return out + [(i, out[i % n][1], 1, "x") for i in (3, 3, n + 1, n + 2)]  # repeated rows and equal vectors


@pytest.mark.parametrize(("scale", "block"), [(1.0, 16384), (1.0, 50), (40_000.0, 100)])
def test_clusters_equal_brute_force(spark, scale, block):
    rows = vectors(400, scale)
    odd = [(None, rows[0][1]), (None, rows[5][1]), (901, None), (902, []), (903, [1.0] * 63), (904, [1.0] * 65), (905, [None] + [1.0] * 63), (906, [float("nan")] * 64), (907, [float("inf")] + [0.0] * 63), (908, [1e30] + [0.0] * 63), (909, [0.0] * 64), (910, [-0.0] * 64)]
    rows += [(i, v, 1, "x") for i, v in odd]
    got = ball_tree.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), block=block)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, None, 1, "x")], [(1, [0.5] * 64, 1, "x")], [(i, [float(i % 2)] * 64, 1, "x") for i in range(90)]):
        got = ball_tree.cluster(spark.createDataFrame(rows, VECTORS))
        assert Counter(map(tuple, got.collect())) == plain_clusters(rows)


def test_balls_hold_their_points_and_some_go_whole():
    points = np.array([[int(256 * x) for x in r[1]] for r in vectors(1000)], np.int32)
    order, sums, radii = ball_tree.build(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    for edges, total, radius in zip(ball_tree.cuts(len(points)), sums, radii, strict=True):
        for a, b, s, r in zip(edges, edges[1:], total, radius, strict=False):
            inside = points[order[a:b]].astype(np.int64)
            assert (inside.sum(axis=0) == s).all() and (np.linalg.norm(inside - s / (b - a), axis=1) <= r + 1e-9).all()
    tree = ball_tree.Tree(points[order].tobytes(), np.concatenate(sums).tobytes(), np.concatenate(radii).tobytes(), 64)
    centroids = points[:6].astype(np.int64)
    to, count, total, whole = tree.assign(centroids)
    assert (to == ball_tree.nearest_of(points[order], centroids)).all() and whole > 300
    assert count.sum() == len(points) and (total.sum(axis=0) == points.sum(axis=0)).all()


PAGES = "page_id long, url string, html string, name string, key int"


def rewritten(spark, rows, folder, **settings):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(2)
    got = warc.rewritten(df, str(folder / "warc"), **settings)
    page = lambda c: warc.field(F.col(c), "page-id").cast("long")
    return got.withColumns({"page_id": page("metadata"), "last": page("refers_to.metadata")}).collect()


def test_transactions_round_trip(spark, tmp_path):
    same, long_text = "same words " * 100, "".join(f"<p>é{i}\r\n\r\nWARC/1.1\r\n" for i in range(50_000))
    rows = [(1, "http://a.example/x y?q=é\r\nEvil: 1", same), (2, None, same), (3, "http://[bad", same), (4, "http://b.example/", "short"), (5, "http://b.example/", "short"), (6, "u", None), (7, "u", ""), (None, "u", "no id " * 400), (8, "u", long_text), (9, "u", "twice " * 300), (9, "u", "twice " * 300), (0, "u", "twice " * 300), (10, "u", "\x00\x1f﻿" * 500)]
    got = rewritten(spark, rows, tmp_path, archive_bytes=3000, payloads=True)
    sha1 = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    last = {same: 3, "twice " * 300: 9}
    want = Counter((i, len((t or "").encode()), sha1(t), "revisit" if last.get(t, i) != i else "response", last[t] if last.get(t, i) != i else None) for i, _, t in rows)
    assert Counter((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.type, r["last"]) for r in got) == want
    for r in got:
        assert len(r.requests) == len(r.metadata) == 1 and r.requests[0].concurrent == [r.capture_id] == r.metadata[0].concurrent
        assert (r.response.type == "revisit") == (r.response.payload is None) and r.response.intact in (True, None)
    whole = next(r for r in got if r.page_id == 8).response.payload
    assert bytes(whole).decode() == long_text
    assert len({r.capture_id for r in got}) == len(rows)
    assert next(r for r in got if r.page_id == 1).response.uri == "http://a.example/x%20y?q=%C3%A9%0D%0AEvil:%201"


def test_payloads_that_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, "u", f"payload {i % 5} " * 200) for i in range(40)] + [(100, "u", "alone " * 200)]
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 1)
    got = rewritten(spark, rows, tmp_path)
    assert sorted((r.page_id, r.response.type, r["last"]) for r in got) == [(i, "revisit", 35 + i % 5) if i < 35 else (i, "response", None) for i in [*range(40), 100]]


def test_no_pages(spark, tmp_path):
    assert rewritten(spark, [], tmp_path) == []


def test_archives_of_other_making(spark, tmp_path):
    """Links in either direction and through other records, gzip by record, records without a response, folded headers."""
    make = lambda kind, name, *fields, block=b"x": warc.record(kind, name, block, *fields) + warc.END
    to = lambda x: ("WARC-Concurrent-To", f"<{x}>")
    http = ("Content-Type", "application/http;msgtype=response")
    rows = [
        make("warcinfo", "i"), make("response", "r1", to("q1"), http, block=b"HTTP/1.0 200 OK\r\n\r\nbody"), make("request", "q1"), make("metadata", "m1", to("q1")), make("metadata", "m2", to("m1")),
        make("response", "r2"), make("request", "q2", to("r2"), to("gone")), make("metadata", "lost", to("gone2")), make("revisit", "v", ("WARC-Refers-To", "<r2>")), make("revisit", "w", ("WARC-Refers-To", "<nothing>")), make("revisit", "d", ("WARC-Payload-Digest", warc.digest_field(hashlib.sha1(b"body").digest()))),
        make("metadata", "m3", ("X-Folded", "a\r\n b"), to("r2")),
    ]
    random.Random(3).shuffle(rows)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in rows[:5]))
    (tmp_path / "b.warc").write_bytes(b"".join(rows[5:]))
    got = {r.capture_id: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    shape = {k: (r.response and r.response.record_id, [x.record_id for x in r.requests], [x.record_id for x in r.metadata], r.refers_to and r.refers_to.capture_id) for k, r in got.items()}
    assert shape == {"r1": ("r1", ["q1"], ["m1", "m2"], None), "r2": ("r2", ["q2"], ["m3"], None), "lost": (None, [], ["lost"], None), "v": ("v", [], [], "r2"), "w": ("w", [], [], None), "d": ("d", [], [], "r1")}
    assert bytes(got["r1"].response.payload) == b"body" and got["r1"].response.http == ["HTTP/1.0 200 OK"]


def test_archives_that_are_damaged():
    whole = warc.record("response", "r", b"abc") + warc.END
    assert [b for _, b in warc.records(whole * 2)] == [b"abc"] * 2 and list(warc.records(b"")) == []
    for bad in (whole[:-6], whole[:20], b"GIF89a", gzip.compress(whole)[:-9]):
        with pytest.raises(ValueError, match="WARC"):
            list(warc.records(bad))


def plain_audit(rows, least=30, most=50):
    docs = [(lang or "", source or "", "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" ")) for text, lang, source in rows]
    docs = [(a, b, [t for t in c if t]) for a, b, c in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in within if within[t] >= least]
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if within[t] >= least) for s in {d[1] for d in own}}
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: rate(c) for s, c in counts.items()}, rate(sum(counts.values(), Counter()))
        for s in counts:
            found = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s], "term": [(q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, t, -v, n + 1) for n, (v, t) in enumerate(items[: None if part == "pair" else most])]
    return sorted(out)


DOCS = "text string, lang string, source string, term string, value long"


def audited(spark, rows, **settings):
    got = divergence.audit(spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).repartition(3), **settings)
    return sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("near", [20_000, 0])
def test_audit_equals_brute_force(spark, near, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", near)
    monkeypatch.setattr(divergence, "HELD", 40)
    rng = random.Random(near)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "日本", "x")] + ["Ünï", "İ", "ſ", "a b"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 25))).upper() + "-don't 42", rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "ß", None])) for _ in range(200)]
    rows += [(None, "de", "a"), ("", "de", "b"), ("one word", "xx", "only"), (None, None, "empty"), ("rare words here", "en", "s9")] + [rows[0]] * 5
    assert audited(spark, rows, least_docs=6, most=4) == plain_audit(rows, 6, 4)
    assert audited(spark, rows, least_docs=1, most=50) == plain_audit(rows, 1, 50)
    assert audited(spark, rows) == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []


def test_counts_past_64_bits_of_product(spark):
    got = spark.range(1).select(divergence._rate(F.lit(3 * 10**13), F.lit(7 * 10**14), F.lit(10**6), 10**9, 5).alias("x")).first()[0]
    assert got == 1 + 10**9 * (3 * 10**13 + 5) // (7 * 10**14 + 5 * 10**6)


@pytest.mark.parametrize("digit", [1, 3, 11])
def test_radix_selection_equals_sorting(spark, digit):
    rng = random.Random(digit)
    prefix = "the same long beginning of many items" * 30
    items = [prefix + x for x in ["", "a", "aa", "ab", "é", "日", "\x00", "\x7f"]] + ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(60)] + ["", "z" * 5000]
    items = list(dict.fromkeys(items))
    rows = [("g1", t, rng.choice([0, 5, 5, 5, 7, 1 << 40])) for t in items] + [("g2", t, 3) for t in items] + [("g3", items[0], 0)] + [("g4", f"{i}", rng.randint(0, 4000)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, item string, value long").repartition(3)
    for most in (1, 5, 30, 1000) if digit == 11 else (5,):
        want = []
        for g in ("g1", "g2", "g3", "g4"):
            own = sorted(((-v, t.encode(), t) for h, t, v in rows if h == g))[:most]
            want += [(g, t, -v, n + 1) for n, (v, _, t) in enumerate(own)]
        got = divergence.largest(df, ["g"], most, digit).select("g", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)
