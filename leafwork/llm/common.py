"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}

#: Rows that are Python values at a time.
SLICE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session leaves it unset (tests, a laptop) a temporary folder is made and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="leafwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and go on from there: a lost executor costs a re-read only."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``cut``, as a Parquet table that ``release`` can remove: smaller than a checkpoint, and its size is known to later plans."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    read = spark.read.schema(df.schema).parquet(folder)
    read.leafwork_folder = folder
    return read


def release(*stored: DataFrame) -> None:
    """Removes tables made by ``store`` that nothing will read again. Spark removes the shuffles that made them once the driver has
    forgotten them, which collecting its garbage brings about."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.leafwork_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if stored:
        gc.collect()
        stored[0].sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches as dicts from column name to a list of Python values; nulls come as None."""
    fields = [x.strip().split(" ") for x in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(n, ARROW[t]) for n, t in fields])
        slices = (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))
        dicts = ({n: c.to_pylist() for n, c in zip(b.schema.names, b.columns)} for b in slices)
        for out in run(dicts):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(work, schema)
