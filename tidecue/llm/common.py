"""What the operators of this folder share."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL: list[tempfile.TemporaryDirectory] = []
#: Tables written; after so many the driver collects its garbage.
_WRITTEN = itertools.count(1)
TABLES_IN_BETWEEN = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder stands in for it.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="tidecue-"))
        place = "file://" + _LOCAL[0].name
    return place.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as a table in the shared folder and reads it back.

    This cuts the lineage with copies that outlive any executor, and costs one computation of ``df``. Every few tables the driver collects
    its garbage: only then does Spark remove the shuffles and broadcasts of plans that are done, and only then does a heap grown by many plans shrink.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidecue/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if next(_WRITTEN) % TABLES_IN_BETWEEN == 0:
        tidy(spark)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets the driver collect its garbage, so that Spark removes the shuffles of plans that are done, and return freed memory.

    What the JVM frees outside its heap (compilers' arenas, stacks of threads that ended) stays with the C library's allocator, in an arena for
    each thread, until it is told to give it back; over the many plans of a pipeline that comes to hundreds of MB.
    """
    spark._jvm.java.lang.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Whether the driver's JVM knows how to return its freed native memory; if so, it has."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, given = new_array(jvm.Class, len(names)), new_array(jvm.Object, len(names))
    values = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new_array(jvm.Object, 0), new_array(jvm.String, 0))
    for k, (name, value) in enumerate(zip(names, values, strict=True)):
        kinds[k], given[k] = jvm.java.lang.Class.forName(name), value
    try:  # by the interface: the server's own class is not open to callers
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:
        return False
    return True


def discard(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``; nothing that still has to be computed may read it."""
    path = getattr(df, "_written_to", None)
    if path is not None:
        delete(df.sparkSession, [path])


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes files and folders of the shared folder."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")
