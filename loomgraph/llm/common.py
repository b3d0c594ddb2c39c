"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract in this package, as a regex class body.
WHITE = r"\x20\x09-\x0D"

_LOCAL_ROOT: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder
    stands in; on a cluster master an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="loomgraph-"))
    return _LOCAL_ROOT[0]


def trim_driver(spark: SparkSession) -> None:
    """Hand back to the system what the driver's JVM has freed outside its heap.

    malloc keeps it otherwise: 204 MB after two small runs of the pipeline. A JVM that lacks the command (on Linux, one before 17.0.9) keeps it still.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server, kind = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName
    kinds, given = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = kind(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # the server's own class is not open to calls, its interface is
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors lose nothing. The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    trim_driver(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table once nothing will read it again."""
    spark = df.sparkSession
    root = shared_root(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split("://")[-1].split(":", 1)[-1].startswith(root.split("://")[-1].split(":", 1)[-1]):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(df: DataFrame, column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items that sum to about ``limit``, one item at least."""
    begin, size, k = 0, 0, -1
    for k, own in enumerate(sizes):
        size += own
        if size >= limit:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin <= k:
        yield begin, k + 1


def byte_slices(texts: Iterable[str], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` characters each, one text at least."""
    return ranges(map(len, texts), limit)


def fold_column(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``; a null id falls in fold of the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_of(doc_id, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % folds
