"""Text parsing queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinegrid.functions import text as tx
from kinegrid.plans.prelude import FEATURES, REPLIES, SERIES, sql
from kinegrid.registry import query
from kinegrid.sources import adapters as ad

CHOICES = ["of", "the", "in_the", "and_the", "que", "der", "maybe"]
_ASCII = "regexp_replace(model_answer, '[^\\x00-\\x7F]', '_', 'g')"


def _ascii(spark, d):
    return ad.replies(spark, d).withColumn("model_answer", F.regexp_replace("model_answer", r"[^\x00-\x7F]", "_"))


_NORM = r"regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[*`]', '', 'g'), '\s+', ' ', 'g')), '[.,;:!?]+$', '')"
_LAST = r"list_extract(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), -1)"


@query("P01_normalise", sql(REPLIES, select=f"SELECT conv_id, turn, {_NORM.format('model_answer')} AS text FROM replies"))
def p01(spark, d):
    return ad.replies(spark, d).select("conv_id", "turn", tx.normalise(F.col("model_answer")).alias("text"))


@query("P03_last_line", sql(REPLIES, select=f"SELECT conv_id, turn, {_LAST.format('model_answer')} AS line FROM replies"))
def p03(spark, d):
    return ad.replies(spark, d).select("conv_id", "turn", tx.last_line(F.col("model_answer")).alias("line"))


def _case(column: str) -> str:
    ordered = sorted(CHOICES, key=lambda c: -len(c))
    tests = [f"WHEN regexp_matches({column}, '\\b{c}\\b')" + (f" OR regexp_matches({column}, '\\b{c.replace('_', ' ')}\\b')" if "_" in c else "") + f" THEN '{c}'" for c in ordered]
    return "CASE " + " ".join(tests) + " END"


@query("P02_parse_answer", sql(REPLIES, select=f"""
, n AS (SELECT conv_id, turn, {_NORM.format(_ASCII)} AS x, {_NORM.format(_LAST.format(_ASCII))} AS l FROM replies)
SELECT conv_id, turn, CASE WHEN x <> '' THEN coalesce(CASE WHEN list_contains({CHOICES!r}, x) THEN x END, CASE WHEN list_contains({CHOICES!r}, l) THEN l END, {_case('l')}, {_case('x')}) END AS label FROM n"""))
def p02(spark, d):
    return _ascii(spark, d).select("conv_id", "turn", tx.parse_choice(F.col("model_answer"), CHOICES).alias("label"))


@query("P04_whole_word", sql(REPLIES, select=f", n AS (SELECT conv_id, turn, {_NORM.format(_ASCII)} AS x FROM replies) SELECT conv_id, turn, {_case('x')} AS label FROM n"))
def p04(spark, d):
    return _ascii(spark, d).select("conv_id", "turn", tx.whole_word_match(tx.normalise(F.col("model_answer")), CHOICES).alias("label"))


@query("P05_short_number", """SELECT event_id, CASE WHEN value % 1 = 0 THEN value::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.2f', value), '0'), '.') END AS short FROM events""")
def p05(spark, d):
    return ad.table(spark, d, "events").select("event_id", tx.short_number(F.col("value").cast("string")).alias("short"))


@query("P06_first_number", r"SELECT event_id, nullif(regexp_extract(props, '(-?\d+(?:\.\d+)?)', 1), '') AS number FROM events")
def p06(spark, d):
    return ad.table(spark, d, "events").select("event_id", tx.first_number(F.col("props")).alias("number"))


@query("P07_grouped_response", """SELECT p_partkey, CASE k WHEN 1 THEN p_brand WHEN 2 THEN p_name ELSE '' END AS answer, k FROM part CROSS JOIN (VALUES (1), (2), (3)) q(k)""")
def p07(spark, d):
    text = F.concat(F.lit("A1: none\nsome words\n a2) "), "p_name", F.lit("\n1. "), "p_brand", F.lit("\n9: x"))
    return ad.table(spark, d, "part").select("p_partkey", F.posexplode(tx.grouped_answers(text, 3)).alias("k", "answer")).select("p_partkey", "answer", (F.col("k") + 1).alias("k"))


@query("P08_without_thoughts", "SELECT p_partkey, p_name AS text FROM part")
def p08(spark, d):
    return ad.table(spark, d, "part").select("p_partkey", tx.without_thoughts(F.concat(F.lit("<think>a\nb</think> \n"), "p_name")).alias("text"))


@query("P09_model_name", "SELECT n_nationkey, n_name AS model FROM nation")
def p09(spark, d):
    return ad.table(spark, d, "nation").select("n_nationkey", tx.model_name(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "_answers").otherwise("_eval"))).alias("model"))


@query("P10_clip_parts", "SELECT p_partkey, p_brand AS scene, p_type AS behaviour, p_size AS \"window\" FROM part")
def p10(spark, d):
    part = tx.clip_parts(F.concat(F.col("p_brand"), F.lit("__"), F.col("p_type"), F.lit("__w"), F.col("p_size").cast("string")))
    return ad.table(spark, d, "part").select("p_partkey", part.alias("c")).select("p_partkey", "c.scene", "c.behaviour", "c.window")


@query("P11_name_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'error' THEN 'fault' ELSE event_type END AS name FROM events")
def p11(spark, d):
    names = F.create_map(*map(F.lit, ("click", "press", "error", "fault")))
    return ad.table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("name"))


@query("P12_source_of_id", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'nuscenes' ELSE 'carla' END AS source FROM customer")
def p12(spark, d):
    clip = F.concat(F.when(F.col("c_custkey") % 3 == 0, "clip_").otherwise("town__"), F.col("c_custkey").cast("string"))
    return ad.table(spark, d, "customer").select("c_custkey", tx.source_of(clip).alias("source"))


@query("P13_summary_text", sql(FEATURES, select="SELECT clip_id, 'Max speed: ' || printf('%.1f', max_speed * 3.6) || ' km/h; peak braking: ' || printf('%.2f', min_accel) || ' m/s2' AS text FROM features"))
def p13(spark, d):
    from kinegrid.plans.q_rules import features

    return features(spark, d).select("clip_id", F.concat(F.lit("Max speed: "), tx.fixed(F.col("max_speed") * 3.6, 1), F.lit(" km/h; peak braking: "), tx.fixed(F.col("min_accel"), 2), F.lit(" m/s2")).alias("text"))


@query("P14_series_text", sql(SERIES, select="SELECT clip_id, 't: ' || string_agg(printf('%.1f', t), ', ' ORDER BY i) AS text FROM series WHERE i IN (0, 9, 18, 27, 36, 45, 54, 63) GROUP BY clip_id"))
def p14(spark, d):
    from kinegrid.functions.series import even_picks

    whole = ad.series(spark, d).groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))
    picked = F.transform(even_picks(F.size("s"), 8), lambda k: tx.fixed(F.element_at(F.col("s.t"), (k + 1).cast("int")), 1))
    return whole.select("clip_id", F.concat(F.lit("t: "), F.array_join(picked, ", ")).alias("text"))


@query("P17_grouped_prompt", "SELECT l_orderkey, string_agg('Q' || l_linenumber || ': ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS prompt FROM lineitem GROUP BY l_orderkey")
def p17(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")))
    line = lambda x: F.concat(F.lit("Q"), x["l_linenumber"].cast("string"), F.lit(": "), x["l_returnflag"])
    return ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, line), "\n").alias("prompt"))


@query("P16_mode_dispatch", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' WHEN p_size % 4 = 1 AND p_size > 25 THEN 'timeseries' ELSE 'summary' END AS mode FROM part")
def p16(spark, d):
    """Time series only where arrays are present; unknown modes fall back to the summary."""
    wanted, has_arrays = F.element_at(F.array(*map(F.lit, ("none", "timeseries", "summary", "odd"))), (F.col("p_size") % 4) + 1), F.col("p_size") > 25
    return ad.table(spark, d, "part").select("p_partkey", F.when(wanted == "none", "none").when(wanted.isin("timeseries", "coordinates", "full") & has_arrays, wanted).otherwise("summary").alias("mode"))


@query("P18_item_numbers", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('qa_%08d', row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS qa_id FROM lineitem WHERE l_quantity > 25")
def p18(spark, d):
    """Numbers run on over the items that are kept. Ranges are numbered apart and joined by their counts, so no task sees all rows."""
    kept = ad.table(spark, d, "lineitem").where("l_quantity > 25").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    block = F.floor(F.col("l_orderkey") / 1024)
    counts = kept.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = counts.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy(*keys))
    return kept.withColumn("block", block).withColumn("k", inside).join(before, "block").select(*keys, F.format_string("qa_%08d", F.col("before") + F.col("k")).alias("qa_id"))


@query("P19_feature_name", sql(FEATURES, select="SELECT clip_id, round(coalesce(CASE WHEN clip_id % 2 = 0 THEN max_speed END, mean_speed), 6) AS value FROM features"))
def p19(spark, d):
    from kinegrid.plans.q_rules import features

    return features(spark, d).select("clip_id", F.round(F.coalesce(F.when(F.col("clip_id") % 2 == 0, F.col("max_speed")), F.col("mean_speed")), 6).alias("value"))


@query("P20_title_label", "SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) || ' Rate' AS label FROM events")
def p20(spark, d):
    raw = F.concat("event_type", F.lit("_rate"))
    return ad.table(spark, d, "events").select("event_id", F.initcap(F.replace(raw, F.lit("_"), F.lit(" "))).alias("label"))


@query("P21_group_in_order", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS items FROM lineitem GROUP BY l_orderkey")
def p21(spark, d):
    return ad.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_linenumber")), ",").alias("items"))
