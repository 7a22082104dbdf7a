"""What the corpus operators share: table access and tables written in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to a Python worker at once, at most: texts are long, and a task holds a batch several times.
BATCH_ROWS = 1024
#: Rows of a few numbers that a task writes at most where a bound of a table's rows is known.
FILE_ROWS = 100_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a folder of our own if all runs on this
    machine (tests); on a cluster that would lose what executors write, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="bitwave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def fewer(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """df, which has no more rows than that, in tasks of about `each` rows and two for each core at least,
    not one for each partition of the exchange before. Each file in a local folder costs its executor two
    processes (Hadoop's chmod of the file and of its checksum), far more than writing a few rows does."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(df: DataFrame, what: str, rows: int | None = None, each: int = FILE_ROWS) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors.
    rows, each: see fewer(), for a table whose rows have a known bound."""
    path, conf = shared_path(df.sparkSession, what), df.sparkSession.conf
    small_batches(df.sparkSession)
    if rows is not None:
        df = fewer(df, rows, each)
    # Nothing reads the exchanges of this job again, so their files go with it.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
