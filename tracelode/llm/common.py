"""What the operators of this subpackage share: tables, work folders, hashes and components."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import textnum
from tracelode.sources import work

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The test table ``name``; any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_gives_back(spark: SparkSession) -> str:
    """Returns the driver's free native memory, of Python and of the JVM, to the system; what the JVM says of its own.

    Compiling the many plans of an operator leaves free memory in the C library's arenas, which no garbage collection
    returns. Empty where the JVM has no such command or isn't this process's.
    """
    textnum.give_back()
    try:
        jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
        kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args))
    except (AttributeError, NotImplementedError, Py4JError):
        return ""


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share; an error if it is unset and the master isn't local."""
    driver_gives_back(spark)
    return work.folder(spark)


def written(df: DataFrame, path: str, **options: str) -> DataFrame:
    """``df`` written to Parquet and read again: cuts the lineage, and survives lost executors.

    The shuffle files behind the table are of no use once it is written, so they go, as does the driver's free memory.
    """
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)).cast("int")


def components(edges: DataFrame, work: str) -> DataFrame:
    """(id, root) for every id of the undirected ``edges`` (a, b): root is the least id connected.

    Alternates large-star and small-star steps; every step is a min per node (combined before the
    shuffle) and a join that adaptive execution can split. Ends when the edges no longer change.
    """
    spark = edges.sparkSession

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(turned(edges.where("a <> b")).distinct(), f"{work}/cc0")
    last, step = state(e), 0
    while last[0]:
        step += 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("rebalance"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(turned(large.where("a <> b")).distinct(), f"{work}/cc{step}l")
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least.hint("rebalance"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = written(turned(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b")).distinct(), f"{work}/cc{step}")
        now = state(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
