"""Reading and writing the library's tables as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREDICTION = "qa_id string, clip_id string, question_id string, category string, oracle_label string, answer string, model_answer string"
CLIP = "clip_id string, source string, scene string, behavior string, window_idx int, t_start double, t_end double, array_ref string, split string, video_path string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that read_json_lines leaves out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_p", parsed).where("_p._bad IS NOT NULL").select("value")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the one that comes last."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_planner_logs(spark: SparkSession, path: str) -> DataFrame:
    """Planner logs (`;` between cells, lists in a cell by commas, the first is the current state): log, step, t, x, y, speed, yaw. Logs with under two rows or a bad cell are left out."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    first = lambda c: F.split(F.col(c), ",")[0].try_cast("double")
    rows = raw.select(
        F.col("_metadata.file_name").alias("log"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("x_position_vehicle_m").try_cast("double").alias("x"),
        F.col("y_position_vehicle_m").try_cast("double").alias("y"),
        first("velocities_mps").alias("speed"),
        first("theta_orientations_rad").alias("yaw"),
    )
    w = Window.partitionBy("log")
    whole = F.count("*").over(w) >= 2
    clean = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("speed").isNotNull() & F.col("yaw").isNotNull(), 1)).over(w) == F.count("*").over(w)
    step = F.row_number().over(w.orderBy("_at")) - 1
    return rows.withColumns({"_ok": whole & clean, "step": step}).where("_ok").select("log", "step", (F.col("step") * 0.1).alias("t"), "x", "y", "speed", "yaw")


def log_parts(path: F.Column) -> F.Column:
    """scene and behaviour of a log's path: .../scene/behaviour_logs.csv or .../scene/logs_behaviour.csv."""
    name = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    return F.struct(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("scene"), F.regexp_replace(name, "^logs_|_logs$", "").alias("behaviour"))


SIGNALS = ("yaw", "speed", "accel", "yaw_rate", "jerk")
ARRAYS = "path string, i long, t double, x double, y double, yaw double, speed double, accel double, yaw_rate double, jerk double, problem string"


def unpack_arrays(held: DataFrame) -> DataFrame:
    """Clip arrays of NPZ files (path, content: their bytes, null if there is no file) in long form, a row for each sample. A file that is missing or lacks an array gives one row that names the problem."""
    kinds = {"path": pa.string(), "i": pa.int64(), **dict.fromkeys(("t", "x", "y", *SIGNALS), pa.float64()), "problem": pa.string()}

    def read(name: str, content: bytes | None) -> dict:
        if content is None:
            return {"path": [name], "problem": ["no file"]}
        try:
            with np.load(io.BytesIO(content)) as found:
                position, n = found["position"], len(found["timestamps"])
                return {"path": [name] * n, "i": np.arange(n), "t": found["timestamps"], "x": position[:, 0], "y": position[:, 1], **{k: found[k] for k in SIGNALS}}
        except (KeyError, ValueError, IndexError, EOFError, OSError, zipfile.BadZipFile) as problem:
            return {"path": [name], "problem": [type(problem).__name__]}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                made = read(name.as_py(), content.as_py())
                n = len(made["path"])
                columns = [pa.array(np.asarray(made[c], float), t) if c in made and t == pa.float64() else pa.array(made[c], t) if c in made else pa.nulls(n, t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return held.select("path", "content").mapInArrow(unpack, ARRAYS)


def read_array_files(spark: SparkSession, path: str) -> DataFrame:
    """The arrays of the NPZ files at path. The files are opened in the tasks from the bytes that Spark reads."""
    return unpack_arrays(spark.read.format("binaryFile").load(path))


def located_arrays(clips: DataFrame, listed: DataFrame, folders: dict[str, str], other: str) -> DataFrame:
    """clip_id and path: the file that array_ref names in the source's folder (`other` for an unknown source), else <clip_id>.npz in the first folder that has it, else null. listed: the paths there are."""
    by_source = F.lit(f"{other}/")
    for source, folder in folders.items():
        by_source = F.when(F.col("source") == source, F.lit(f"{folder}/")).otherwise(by_source)
    named = F.when(F.col("array_ref") != "", F.concat(by_source, "array_ref"))
    each = [F.concat(F.lit(f"{folder}/"), "clip_id", F.lit(".npz")) for folder in dict.fromkeys([*folders.values(), other])]
    wanted = clips.select("clip_id", F.posexplode(F.array(named, *each)).alias("place", "path")).where("path IS NOT NULL")
    found = wanted.join(listed.select("path").distinct(), "path").groupBy("clip_id").agg(F.min_by("path", "place").alias("path"))
    return clips.select("clip_id").join(found, "clip_id", "left")


def located_videos(clips: DataFrame, listed: DataFrame) -> DataFrame:
    """clip_id and path: <scene>_<behaviour>_FPV.mp4 in the scene's folder, else the first name there that holds the behaviour and FPV, else null. listed: scene, name."""
    both = clips.select("clip_id", "scene", "behaviour").join(listed.select("scene", "name"), "scene")
    exact = F.col("name") == F.concat_ws("_", "scene", "behaviour", F.lit("FPV.mp4"))
    near = F.col("name").contains(F.col("behaviour")) & F.col("name").contains("FPV") & F.col("name").endswith(".mp4")
    best = both.where(exact | near).groupBy("clip_id").agg(F.min(F.struct((~exact).alias("other"), F.concat_ws("/", "scene", "name").alias("path"))).alias("m"))
    return clips.select("clip_id").join(best.select("clip_id", F.col("m.path").alias("path")), "clip_id", "left")


def keeping_unknown(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The entries of a document that is written again: all new ones, and the existing ones whose keys are not among them."""
    return new.unionByName(existing.join(new.select(*keys).distinct(), keys, "left_anti"))


def as_markdown(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A Markdown table for each group: group, report; rows in the order of their columns."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = F.lit("| " + " | ".join(columns) + " |\n" + "|---" * len(columns) + "|\n")
    lines = F.array_sort(F.collect_list(F.struct(*columns, row.alias("row"))))
    return df.groupBy(group).agg(F.concat(head, F.array_join(F.transform(lines, lambda x: x["row"]), "\n")).alias("report"))


def write_split(df: DataFrame, path: str) -> None:
    """A folder for each split, so that a reader of one split skips the others."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows gathered into a JSON document for each group of keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("document"))


def in_batches(df: DataFrame, order: list[str], rows: int, path: str) -> DataFrame:
    """df with batch: every `rows` rows in order share one. Blocks are numbered apart, kept as files at path (so that a lost executor changes no number) and joined by their counts."""
    from pyspark.sql.functions import spark_partition_id

    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", spark_partition_id())
    placed.write.parquet(path)
    placed = df.sparkSession.read.schema(placed.schema).parquet(path)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    k = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_k", k).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_k")) / rows)).drop("_part", "_k", "_before")
