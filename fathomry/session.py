"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "fathomry", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores, any other as it is.

    Spark cuts files no finer than its cost of opening one (4 MB), so an input of
    less than that for each core would leave cores idle in a costly scan. What
    is shuffled here is bounded by that size; tables of unknown size are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Of what is read, not of what is kept of it: sizes of single columns are guesses.
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return df.repartition(cores) if size <= cores * 2_000_000 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder, as driver and
    executors are one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="fathomry-"))
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no earlier work."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
