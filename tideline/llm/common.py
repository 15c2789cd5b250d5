"""Shared helpers: intermediate tables in the cluster's shared folder, folds, word splitting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.shared import delete_on_exit, shared_dir

#: Bytes of texts in one Arrow batch.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when :func:`forget` is told so, or else when the driver ends. The driver gives back memory after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    driver_gives_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def fresh(name: str, df: DataFrame) -> str:
    """``name``, lengthened until it is none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`save` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python in Arrow batches of BATCH_BYTES at most (64 MB by default), as a batch is held
    several times over by each worker. A session that asks for less is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Give memory that the worker holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def driver_gives_back(spark: SparkSession) -> None:
    """Give memory that the driver holds but doesn't use back to the system: its Python's, the JVM's heap beyond what
    lives, and what the JVM's native code (compilers, network buffers) has freed. Many small queries with many tasks
    leave hundreds of MB of these."""
    give_back()
    jvm, java = spark._jvm, spark._jvm.java.lang
    jvm.System.gc()
    # By reflection through the exported interface, as py4j can't call the class of the server.
    names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    types, args = (spark.sparkContext._gateway.new_array(kind, len(names)) for kind in (java.Class, java.Object))
    for i, name in enumerate(names):
        types[i] = java.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = java.management.ManagementFactory.getPlatformMBeanServer()
    try:
        java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(server, args)
    except Py4JJavaError:  # a JVM without this command
        pass


def released(batches: Iterator) -> Iterator:
    """The batches. After each the worker, which may stay idle beside other ones, gives back the memory that it took."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4 (fold 2 is held out). A null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The array of ``[^\\x20\\x09-\\x0D]+`` in the text; null text: no words."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``limit`` labelled documents outside fold 2, by hash order of their ids.

    The limit bounds the label rows, so their broadcast is bounded, and the rows returned: of the texts of a repeated
    id the one of the least hash is taken. Texts are whole, of any length. Null ids, texts and labels are ignored; of
    the labels of a repeated id the largest counts.
    """
    few = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & (fold("_id") != 2))
        .groupBy("_id").agg(F.max("label").alias("label"))
        .orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(limit)
    )
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    rows = rows.join(F.broadcast(few), rows.doc_id == few["_id"])
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "r.text", "r.label")
