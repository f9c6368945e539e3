"""Reading checked documents and writing results: strict JSON, digests, canonical forms, compressed files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an event's evidence holds: these keys and no others.
EVIDENCE_KEYS = ["k"]
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def receipts(rows: DataFrame, key: str, content: str, limit: int = 1 << 20) -> DataFrame:
    """key, n_bytes, sha256, status of each document: what was delivered, and whether it is within the limit."""
    n = F.octet_length(content).cast("long")
    return rows.select(key, n.alias("n_bytes"), F.sha2(content, 256).alias("sha256"), F.when(n <= limit, "DELIVERED").otherwise("RESOURCE_LIMIT").alias("status"))


def _strict(props):
    keys = F.json_object_keys(props)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, EVIDENCE_KEYS)))) == 0) & (F.size(keys) == len(EVIDENCE_KEYS))


def decoded(events: DataFrame) -> DataFrame:
    """event_id, k of evidence whose keys are exactly the known ones."""
    return events.where(_strict(F.col("props"))).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def rejected(events: DataFrame) -> DataFrame:
    """event_id of evidence with missing, unknown or unreadable keys; null counts as unreadable."""
    return events.where(~F.coalesce(_strict(F.col("props")), F.lit(False))).select("event_id")


def cfg_documents(edges: DataFrame) -> DataFrame:
    """unit, document, version: each unit's graph as canonical JSON (edges in order), its version by the features in it.

    A unit's document is one value by its nature; bytes above the limit are the reader's to refuse (`receipts`).
    """
    row = F.struct("src", "dst", "kind")
    graph = edges.groupBy("unit").agg(F.array_sort(F.collect_list(row)).alias("transitions"), F.max(F.when(F.col("kind") == "HALT", 2).when(F.col("kind") == "INVOKE_NORMAL", 1).otherwise(0)).alias("feature"))
    return graph.select("unit", F.to_json(F.struct("unit", "transitions")).alias("document"), (F.col("feature") + 1).cast("long").alias("version"))


def read_json(spark: SparkSession, path: str, schema: str, limit: int = 64 << 20) -> DataFrame:
    """Rows of JSON lines under path, plain or Zstandard by their first bytes, each file within limit; anything unreadable fails.

    Files are read by Spark's reader and unpacked in tasks, one at a time.
    """
    files = spark.read.format("binaryFile").load(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if raw[:4] == ZSTD_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                if len(raw) > limit:
                    raise ValueError(f"{name}: more than {limit} bytes")
                lines = [x for x in raw.decode("utf-8").split("\n") if x]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])

    lines = files.select("path", "content").mapInArrow(unpack, "line string")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as gzipped JSON lines, keys in the columns' order, by Spark's own commit protocol."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def verified(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """path, status of a manifest (path, sha256) against artifacts (path, content): VERIFIED, MISMATCH or MISSING."""
    held = artifacts.select("path", F.sha2("content", 256).alias("found"))
    met = manifest.join(held, "path", "left")
    return met.select("path", F.when(F.col("found").isNull(), "MISSING").when(F.col("found") == F.col("sha256"), "VERIFIED").otherwise("MISMATCH").alias("status"))
