"""Queries on files that have to be found, fetched, merged or reported."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinegrid.plans.prelude import CLASSES, SERIES, sql
from kinegrid.sources.shared import place
from kinegrid.registry import query
from kinegrid.sources import adapters as ad
from kinegrid.sources import files
from kinegrid.sources.adapters import table


@query("S04_clip_arrays", sql(SERIES, select="""
SELECT clip_id, CASE WHEN clip_id % 7 = 0 THEN 'no file' WHEN clip_id % 7 = 1 THEN 'KeyError' END AS problem, CASE WHEN clip_id % 7 > 1 THEN count(*) ELSE 0 END AS n,
  CASE WHEN clip_id % 7 > 1 THEN round(sum(speed), 4) END AS speed FROM series GROUP BY clip_id"""))
def s04(spark, d):
    """Arrays written as NPZ bytes and read again; some files are missing, some lack an array."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bodies = []
            for clip, speed in zip(part["clip_id"], part["speed"], strict=True):
                zero, out = np.zeros(len(speed)), io.BytesIO()
                arrays = {"timestamps": zero, "position": np.zeros((len(speed), 2)), "yaw": zero, "speed": np.array(speed), "accel": zero, "yaw_rate": zero} | ({} if clip % 7 == 1 else {"jerk": zero})
                np.savez(out, **arrays)
                bodies.append(None if clip % 7 == 0 else out.getvalue())
            yield pd.DataFrame({"path": part["clip_id"].astype(str), "content": bodies})

    clips = ad.series(spark, d).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "speed"))), lambda x: x["speed"]).alias("speed"))
    rows = files.unpack_arrays(clips.mapInPandas(pack, "path string, content binary"))
    return rows.groupBy(F.col("path").cast("long").alias("clip_id")).agg(F.max("problem").alias("problem"), F.count("i").alias("n"), F.round(F.sum("speed"), 4).alias("speed"))


_LISTED = "listed AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a/' ELSE 'b/' END || CASE WHEN p_partkey % 2 = 0 THEN 'ref' ELSE '' END || p_partkey || '.npz' AS path FROM part WHERE p_partkey % 5 <> 0)"


@query("S05_trajectory_arrays", f"""
WITH {_LISTED}, clips AS (SELECT c_custkey::VARCHAR AS clip_id, CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'y' END AS source, CASE WHEN c_custkey % 4 < 3 THEN 'ref' || c_custkey || '.npz' END AS array_ref FROM customer)
SELECT clip_id, coalesce(n.path, a.path, b.path) AS path FROM clips LEFT JOIN listed n ON n.path = CASE source WHEN 'x' THEN 'a/' ELSE 'b/' END || array_ref
  LEFT JOIN listed a ON a.path = 'a/' || clip_id || '.npz' LEFT JOIN listed b ON b.path = 'b/' || clip_id || '.npz'""")
def s05(spark, d):
    p = F.col("p_partkey")
    listed = table(spark, d, "part").where(p % 5 != 0).select(F.concat(F.when(p % 3 == 0, "a/").otherwise("b/"), F.when(p % 2 == 0, "ref").otherwise(""), p.cast("string"), F.lit(".npz")).alias("path"))
    k = F.col("c_custkey")
    clips = table(spark, d, "customer").select(k.cast("string").alias("clip_id"), F.when(k % 3 == 0, "x").otherwise("y").alias("source"), F.when(k % 4 < 3, F.concat(F.lit("ref"), k.cast("string"), F.lit(".npz"))).alias("array_ref"))
    return files.located_arrays(clips, listed, {"x": "a"}, "b")


@query("S19_video_lookup", """
WITH listed AS (SELECT 's' || p_size AS scene, CASE WHEN p_partkey % 2 = 0 THEN 's' || p_size || '_' || p_brand || '_FPV.mp4' ELSE p_partkey || p_brand || 'FPV' || CASE WHEN p_partkey % 3 = 0 THEN '.mov' ELSE '.mp4' END END AS name FROM part),
clips AS (SELECT DISTINCT 's' || p_size || '#' || p_brand AS clip_id, 's' || p_size AS scene, p_brand AS behaviour FROM part),
near AS (SELECT clip_id, (name <> c.scene || '_' || behaviour || '_FPV.mp4')::INT AS other, c.scene || '/' || name AS path FROM clips c JOIN listed l ON c.scene = l.scene WHERE contains(name, behaviour) AND contains(name, 'FPV') AND name LIKE '%.mp4'),
best AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY other, path) AS k FROM near)
SELECT c.clip_id, b.path FROM clips c LEFT JOIN best b ON c.clip_id = b.clip_id AND b.k = 1""")
def s19(spark, d):
    scene = F.concat(F.lit("s"), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select(scene.alias("scene"), F.col("p_brand").alias("behaviour"), "p_partkey")
    other = F.concat(F.col("p_partkey").cast("string"), "behaviour", F.lit("FPV"), F.when(F.col("p_partkey") % 3 == 0, ".mov").otherwise(".mp4"))
    listed = rows.select("scene", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("_", "scene", "behaviour", F.lit("FPV.mp4"))).otherwise(other).alias("name"))
    clips = rows.select(F.concat_ws("#", "scene", "behaviour").alias("clip_id"), "scene", "behaviour").distinct()
    return files.located_videos(clips, listed)


@query("K05_metrics_document", sql(CLASSES, select="""
, new AS (SELECT model, 'accuracy' AS entry, round(avg((oracle = pred)::INT), 6) AS value FROM classes GROUP BY model)
SELECT * FROM new UNION ALL SELECT 'm' || l_linenumber, 'seconds', l_linenumber + 0.5::DOUBLE FROM (SELECT DISTINCT l_linenumber FROM lineitem)"""))
def k05(spark, d):
    """Metrics written over an older document: its accuracy is replaced, its timing kept."""
    path = place(spark, "metrics")
    number = table(spark, d, "lineitem").select("l_linenumber").distinct()
    entries = F.inline(F.array(F.struct(F.lit("accuracy").alias("entry"), F.lit(-1.0).alias("value")), F.struct(F.lit("seconds").alias("entry"), (F.col("l_linenumber") + F.lit(0.5)).cast("double").alias("value"))))
    number.select(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), entries).write.json(path)
    new = ad.classes(spark, d).groupBy("model").agg(F.round(F.avg((F.col("oracle") == F.col("pred")).cast("int")), 6).alias("value")).select("model", F.lit("accuracy").alias("entry"), "value")
    return files.keeping_unknown(new, files.read_json_lines(spark, path, "model string, entry string, value double"), ["model", "entry"])


@query("K09_report", "SELECT n_regionkey, '| n_nationkey | n_name |\n|---|---|\n' || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', '\n' ORDER BY n_nationkey) AS report FROM nation GROUP BY n_regionkey")
def k09(spark, d):
    return files.as_markdown(table(spark, d, "nation"), "n_regionkey", ["n_nationkey", "n_name"])


@query("R03_cached_batches", "SELECT o_orderpriority AS batch, count(*) AS n, o_orderpriority IN ('1-URGENT', '2-HIGH') AS cached FROM orders GROUP BY o_orderpriority")
def r03(spark, d):
    """Batches whose result folder is there are not fetched again."""
    path = place(spark, "results")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("batch"), "o_orderkey")
    rows.where("batch IN ('1-URGENT', '2-HIGH')").withColumn("cached", F.lit(True)).write.partitionBy("batch").json(path)
    read = lambda: spark.read.schema("o_orderkey long, cached boolean, batch string").json(path)
    fetched = read().select("batch").distinct()
    rows.join(F.broadcast(fetched), "batch", "left_anti").withColumn("cached", F.lit(False)).write.mode("append").partitionBy("batch").json(path)
    return read().groupBy("batch").agg(F.count("*").alias("n"), F.bool_and("cached").alias("cached"))


@query("X05_batch_collect", """
WITH requests AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 200 AS batch FROM orders),
said AS (SELECT l_orderkey * CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END AS k FROM lineitem WHERE l_linenumber IN (1, 2, 7) AND l_orderkey % 3 = 0),
per AS (SELECT k, count(*) AS n FROM said GROUP BY k)
SELECT coalesce(r.batch, -1) AS batch, count(*) FILTER (WHERE r.o_orderkey IS NOT NULL AND p.k IS NOT NULL) AS answered, count(*) FILTER (WHERE p.k IS NULL) AS missing,
  count(*) FILTER (WHERE r.o_orderkey IS NULL) AS unknown, coalesce(sum(p.n - 1), 0)::BIGINT AS repeated FROM requests r FULL JOIN per p ON r.o_orderkey = p.k GROUP BY coalesce(r.batch, -1)""")
def x05(spark, d):
    """Requests in batches, and what comes back for them: answered, missing, repeated, and (batch -1) unknown ids."""
    requests = files.in_batches(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 200, place(spark, "requests"))
    requests = requests.select(F.concat(F.lit("req-"), F.col("o_orderkey").cast("string")).alias("custom_id"), "batch")
    path = place(spark, "responses")
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    table(spark, d, "lineitem").where("l_linenumber IN (1, 2, 7) AND l_orderkey % 3 = 0").select(F.concat(F.lit("req-"), key.cast("string")).alias("custom_id"), F.lit("yes").alias("answer")).write.json(path)
    per = files.read_json_lines(spark, path, "custom_id string, answer string").groupBy("custom_id").agg(F.count("*").alias("n"))
    both = requests.join(per, "custom_id", "full")
    return both.groupBy(F.coalesce(F.col("batch").cast("long"), F.lit(-1)).alias("batch")).agg(
        F.count_if(F.col("batch").isNotNull() & F.col("n").isNotNull()).alias("answered"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("batch").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
    )
