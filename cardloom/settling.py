"""Frames written where they can be read again: checkpoints, folders of a run, and their removal."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, Spark removes the shuffle files of an execution when that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where the session names none: an own one in local mode, else an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get())
    wanted = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        wanted = tempfile.mkdtemp(prefix="cardloom-")
    context.setCheckpointDir(wanted)
    return str(context._jsc.sc().getCheckpointDir().get())


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of work_path() that nothing will read again."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def _in(session, df: DataFrame, spark: SparkSession) -> DataFrame:
    made = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, df._jdf.logicalPlan())
    return DataFrame(made, spark)


def under(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same rows in a copy of the session with these settings.  The caller's session and its other queries keep theirs."""
    copy = df.sparkSession._jsparkSession.cloneSession()
    for name, value in settings.items():
        copy.conf().set(name, value)
    return _in(copy, df, SparkSession(df.sparkSession.sparkContext, copy))


def lean(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """The same rows in a copy of the session under which shuffle files go when an action or a write has ended.

    settings: more of that copy's settings.
    """
    return under(df, {CLEANUP: "true", **(settings or {})})


def settle(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """Checkpoint: cuts lineage, and a lost executor costs no more than the tasks that ran on it.  Runs a job at once.

    What the checkpoint shuffled is not read again, so those files go at once.
    """
    spark = df.sparkSession
    shared_dir(spark)
    return _in(spark._jsparkSession, lean(df, settings).checkpoint(eager=True), spark)


def discard(*settled: DataFrame) -> None:
    """Remove the files of frames from settle() that nothing will read again."""
    for df in settled:
        held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if held.isDefined():
            remove(df.sparkSession, held.get())
