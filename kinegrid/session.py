"""Session settings used by tests, the bench and scripts; on a cluster the submitter's own settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "kinegrid", **conf: str) -> SparkSession:
    """A session on this machine: adaptive plans, UTC, as many shuffle partitions as cores."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of rows sent to a Python worker at a time: a task holds several batches, in the JVM and in Python.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each application; Spark hands the file to every executor.

    Batches for the workers are bounded by BATCH_BYTES, unless the session sets a bound of its own: with long texts, Spark's 10,000
    rows a batch would be as large as these texts.
    """
    import tempfile
    import zipfile
    from pathlib import Path

    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_kinegrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinegrid-ship-")) / "kinegrid_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    context._kinegrid_shipped = True
