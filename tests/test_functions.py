"""Scalar functions, truths, ranges, documents and reports on small cases."""

import zstandard
from pyspark.sql import functions as F

from tidegraph.functions import text as tx
from tidegraph.functions import truth as tr
from tidegraph.operators import cfg, reports, storage
from tidegraph.sources import documents as src


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_text(spark):
    t = F.lit("a\U0001f600b  ")
    assert one(spark, tx.fit(t, 3), tx.fit(t, 7, "."), tx.piece(t, F.lit(1), F.lit(1)), tx.piece(t, F.lit(3), F.lit(9)), tx.trimmed(t), tx.upper_ascii(F.lit("aé\tz"))) == ["a\U0001f600b", "a\U0001f600b  ..", "\U0001f600", None, "a\U0001f600b", "Aé\tZ"]
    assert one(spark, tx.is_digits(F.lit("012")), tx.is_digits(F.lit("")), tx.padded_equal(F.lit("AB"), F.lit("AB  ")), tx.padded_equal(F.lit("AB"), F.lit("AB x"))) == [True, False, True, False]
    assert one(spark, tx.key_of(F.lit("a"), F.lit("1:b")), tx.key_of(F.lit("a1"), F.lit(":b"))) == ["1:a3:1:b", "2:a12::b"]


def test_names(spark):
    assert one(spark, tx.call_name(F.lit("PROGA   ")), tx.call_name(F.lit("PROGA   "), False), tx.call_name(F.lit("TOOLONGNAME")), tx.call_name(F.lit("1ABC"))) == ["PROGA", None, None, None]
    assert one(spark, tx.fixed_name(F.lit("MENU    "), 8), tx.fixed_name(F.lit("MENU"), 8), tx.fixed_name(F.lit("MENU"), 8, computed=False)) == ["MENU", None, "MENU"]


def test_truth_of_candidate_sets(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    no = F.lit(False)
    assert one(spark, tr.equal(a("A"), a("A"), no), tr.equal(a("A", "B"), a("A", "B"), no), tr.equal(a("A"), a("B"), no), tr.equal(a("A"), a("B"), F.lit(True))) == [tr.TRUE, tr.BOTH, tr.FALSE, tr.BOTH]
    assert one(spark, tr.digits(a("1", "22"), no), tr.digits(a("1", "x"), no), tr.digits(a("x"), no)) == [tr.TRUE, tr.BOTH, tr.FALSE]


def test_ranges(spark):
    r = spark.createDataFrame([(1, 0, 0, 4, 8), (1, 0, 1, 0, 4), (1, 0, 2, 6, 10), (1, 0, 3, 20, 22)], "unit long, base long, pos long, start long, end long")
    assert [tuple(x)[2:] for x in storage.coalesced(r).orderBy("start").collect()] == [(0, 10), (20, 22)]
    assert [tuple(x)[2:] for x in storage.segments(r).orderBy("start").collect()] == [(0, 4), (4, 6), (6, 8), (8, 10), (10, 20), (20, 22)]
    assert {tuple(x)[2:] for x in storage.covered_segments(r).collect()} == {(0, 4, 1), (4, 6, 1), (6, 8, 2), (8, 10, 1), (20, 22, 1)}


def test_json_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "b.json.zst").write_bytes(zstandard.ZstdCompressor().compress(b'{"k": 3}\n'))
    assert sorted(r.k for r in src.read_json(spark, str(tmp_path), "k long").collect()) == [1, 2, 3]
    src.write_json(spark.range(2), str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [0, 1]


def test_evidence_is_strict(spark):
    e = spark.createDataFrame([(1, '{"k": 1}'), (2, '{"k": 1, "x": 2}'), (3, "{}"), (4, None), (5, "no json")], "event_id long, props string")
    assert [r.event_id for r in src.decoded(e).collect()] == [1]
    assert sorted(r.event_id for r in src.rejected(e).collect()) == [2, 3, 4, 5]


def test_manifest(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, content string")
    m = a.select("path", F.sha2("content", 256).alias("sha256")).where("path = 'x'").union(spark.createDataFrame([("y", "bad"), ("z", "gone")], "path string, sha256 string"))
    assert {tuple(r) for r in src.verified(m, a).collect()} == {("x", "VERIFIED"), ("y", "MISMATCH"), ("z", "MISSING")}


def test_difference_keeps_multiplicity(spark):
    a = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2)], "key string, value long")
    b = spark.createDataFrame([("p", 1), ("q", 3)], "key string, value long")
    assert {tuple(r) for r in reports.difference(a, b).collect()} == {("p", 1, 0), ("q", 1, 1)}


def test_mutated_edges_are_found(spark):
    b = spark.createDataFrame([(1, 0, 0, "view", 1, 1, 1, 2, "VIEW"), (1, 1, 1, "error", 10, 2, 1, 3, "ERROR")], "unit long, pos long, event_id long, event_type string, k long, cell long, action long, source long, literal string")
    e = cfg.edges(b)
    assert {tuple(r) for r in e.collect()} == {(1, 0, 1, "JUMP"), (1, 1, -2, "HALT")}
    assert cfg.invalid(e, b).count() == 0
    assert cfg.invalid(e.withColumn("dst", F.col("dst") + 7), b).count() == 2


def test_code_page_1047_round_trip(spark):
    from tidegraph.functions.codecs import decoding_1047, from_1047, to_1047

    assert len(set(decoding_1047())) == 256
    rows = spark.createDataFrame([("HELLO [x]^\n",), ("日",), (None,)], "t string")
    got = [tuple(r) for r in rows.select("t", F.hex(to_1047("t")), from_1047(to_1047("t"))).collect()]
    assert got == [("HELLO [x]^\n", "C8C5D3D3D640ADA7BD5F15", "HELLO [x]^\n"), ("日", None, None), (None, None, None)]


def test_peeling_leaves_cycles_and_what_needs_them(spark):
    from tidegraph.operators.evidence import ungrounded

    p = spark.createDataFrame([(1, 2), (2, None), (3, 4), (4, 3), (5, 4), (6, 1)], "proof long, needs long")
    assert {r.proof for r in ungrounded(p).collect()} == {3, 4, 5}


def test_stream_solves_changed_units_again(spark, tmp_path):
    from tidegraph.operators import dataflow
    from tidegraph.sources.programs import blocks
    from tidegraph.streaming.incremental import current, events_stream, keep_current

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folders = [str(tmp_path / x) for x in ("in", "log", "facts", "checkpoint")]
    for part in (events.where("event_id < 700"), events.where("event_id >= 700 and user_id % 2 = 0")):
        part.write.mode("append").parquet(folders[0])
        keep_current(events_stream(spark, folders[0]), *folders[1:]).awaitTermination()
    want = dataflow.reach(blocks(spark, events.where("event_id < 700 or user_id % 2 = 0")))
    assert sorted(current(spark, folders[2]).select("unit", "pos").collect()) == sorted(want.collect())
