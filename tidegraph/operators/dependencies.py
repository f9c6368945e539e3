"""What units refer to: call sites with candidates and unknown remainders, files, included sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions.text import FILE_WIDTH, call_name, fit, fixed_name, key_of
from tidegraph.operators.dataflow import UNKNOWN


def call_sites(blocks: DataFrame, reached: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, reached, n, open, status of each purchase block, whose target is the value of cell 0.

    A site that isn't reached has no candidates (null), which differs from having none.
    """
    sites = blocks.where("event_type = 'purchase'").select("unit", "pos")
    met = sites.join(reached.withColumn("reached", F.lit(True)), ["unit", "pos"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    held = values.where("cell = 0").groupBy("unit", "pos").agg(F.count(F.when(F.col("val") != UNKNOWN, 1)).alias("n"), F.bool_or(F.col("val") == UNKNOWN).alias("open"))
    out = met.join(held, ["unit", "pos"], "left")
    status = F.when(~F.col("reached"), "UNREACHABLE").when(F.col("open") & (F.col("n") > 0), "PARTIAL").when(F.col("open"), "OPEN").when(F.col("n") > 0, "CLOSED").otherwise("OTHER")
    return out.select("unit", "pos", "reached", F.when(F.col("reached"), F.col("n")).alias("n"), F.when(F.col("reached"), F.col("open")).alias("open"), status.alias("status"))


def call_candidates(sites: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, name of each known target of a reached site, by the rule for computed names."""
    known = values.where((F.col("cell") == 0) & (F.col("val") != UNKNOWN)).select("unit", "pos", call_name(fit(F.col("val"), 8)).alias("name"))
    return sites.where("reached").select("unit", "pos").join(known, ["unit", "pos"]).where("name is not null")


def call_edges(candidates: DataFrame) -> DataFrame:
    """unit, name, n_sites: which programs a unit may call."""
    return candidates.groupBy("unit", "name").agg(F.count_distinct("pos").alias("n_sites"))


def classification(sites: DataFrame) -> DataFrame:
    counted = sites.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = sites.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counted.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 9).alias("ratio"))


def target_resolution(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """name, key, n_units, n_sites, authority: candidates of all units merged with what literal blocks themselves name."""
    computed = candidates.select("name", "unit", "pos", F.lit("COMPUTED").alias("authority"))
    literal = blocks.where("action = 0 and event_type = 'signup'").select(call_name(F.col("literal"), False).alias("name"), "unit", "pos", F.lit("LITERAL").alias("authority"))
    every = computed.unionByName(literal).where("name is not null")
    grouped = every.groupBy("name").agg(F.count_distinct("unit").alias("n_units"), F.count_distinct("unit", "pos").alias("n_sites"), F.array_join(F.array_sort(F.collect_set("authority")), "+").alias("authority"))
    return grouped.select("name", key_of(F.col("name"), F.col("authority")).alias("key"), "n_units", "n_sites", "authority")


def uncorrelated(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """unit, pos of reached sites for which no program is known (anti-join), to be completed as unknown."""
    return sites.where("reached").select("unit", "pos").join(candidates, ["unit", "pos"], "left_anti")


def conditional_values(sites: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, val: values admitted only because the site's own answer isn't closed."""
    closed = sites.where("status = 'CLOSED'").select("unit", "pos")
    return values.where((F.col("cell") == 1) & (F.col("val") != UNKNOWN)).join(sites.where("reached").select("unit", "pos"), ["unit", "pos"], "left_semi").join(closed, ["unit", "pos"], "left_anti").select("unit", "pos", "val")


def file_sites(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """unit, pos, name, route: view blocks with k under 30 use the file named by cell 2, padded to its field."""
    sites = blocks.where("event_type = 'view' and k < 30").select("unit", "pos", "k")
    named = values.where("cell = 2").select("unit", "pos", F.when(F.col("val") != UNKNOWN, fixed_name(fit(F.col("val"), FILE_WIDTH), FILE_WIDTH)).alias("name"))
    route = F.when(F.col("name").isNull(), "UNKNOWN").when(F.col("k") < 10, "EXPLICIT").otherwise("DEFAULT")
    return sites.join(named, ["unit", "pos"]).select("unit", "pos", "name", route.alias("route"))


def source_dependencies(pages: DataFrame) -> DataFrame:
    """kind, name, n, remainder of what pages' addresses include: the host, by the form of its name."""
    host = F.regexp_extract("url", "//([^/:]+)", 1)
    kind = F.when(host.startswith("www."), "COPYBOOK").when(host.startswith("m."), "DECLARATION").when(host.startswith("blog."), "SQL_INCLUDE").otherwise("TABLE")
    return pages.select(kind.alias("kind"), host.alias("name"), (F.instr("url", "?") > 0).alias("partial")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("partial").alias("remainder"))
