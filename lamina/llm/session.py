"""What the operators of this subpackage take from the Spark session."""

import re
import tempfile
import uuid

from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts of documents may be long, so batches are kept small.
ARROW_ROWS = 400


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark):
    """Batches of ARROW_ROWS rows at most between the JVM and Python; Spark reads this setting from the session when a frame
    is executed, so it stays. A smaller value of the user's own is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark):
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a local
    session (as in tests) gets a new one; on a cluster that is an error, since executors would not see the driver's disk."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
        place = jsc.getCheckpointDir().get()
    return place.rstrip("/")


_made = []


def new_dir(spark, name):
    """A path in the shared folder that no other call gets; clean() removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clean(spark):
    """Removes what this process has written to the shared folder: call it when results are stored elsewhere."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a file of a table whose size is known beforehand.
FILE_ROWS = 20_000


def materialize(spark, df, name, rows=None):
    """df, written to the shared folder and read again: a cut of the lineage that survives lost executors. With rows, a
    bound of its rows, a small table gets few files. Columns without a type, which Parquet can't hold, come back as they were."""
    path, schema = new_dir(spark, name), df.schema
    void = [f.name for f in schema if f.dataType.typeName() == "void"]
    if void:
        df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c in void})
    df = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.withColumns({c: F.lit(None) for c in void}) if void else out


#: Bytes of a table, as Spark estimates them, that are worth a task of their own.
TASK_BYTES = 1 << 19


def spread(df):
    """df in a task for each core if its files make fewer: a file of one row group is one task otherwise, whatever its size. Plans
    with an exchange, and tables of as many parts as there are cores, stay as they are."""
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    size = int(plan.optimizedPlan().stats().sizeInBytes())
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, 1 + size // TASK_BYTES)
    return df.repartition(tasks) if plan.executedPlan().execute().getNumPartitions() * 2 <= tasks else df


def with_text(df, keep, text, made):
    """(frame of the columns `keep` and, last, the text; the names kept). A kept column that the result makes anew is left out."""
    keep = [c for c in keep if c not in made]
    name = "text"
    while name in keep or name in made:
        name = f"_{name}"
    return spread(df.select(*(df[c] for c in keep), df[text].cast("string").alias(name))), name


def schema_of(source, more):
    """The DDL of all columns of source but the last, and more."""
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1]) + more


#: Most bytes of a table, as Spark estimates it from its files, that is sent whole to every executor.
BROADCAST_BYTES = 4 << 20


def small(df):
    """df, marked for a broadcast if its estimated size is within BROADCAST_BYTES; beyond that Spark shuffles it as any other."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
