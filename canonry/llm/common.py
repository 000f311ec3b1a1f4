"""Helpers shared by the corpus operators.

Nothing here keeps state on one machine: tables are read through Spark, and
intermediate tables go to the folder named in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the synthetic tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Where a session of one machine alone names none (tests), a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="canonry-")
    return path.rstrip("/")


class Scratch:
    """Intermediate tables of one operator run, written as Parquet to the shared folder.

    A written table survives the loss of an executor and cuts the lineage, so an
    iterative operator does not recompute what came before.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``keep`` returned and nothing reads any more."""
        jvm = self.spark._jvm  # noqa: SLF001
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # noqa: SLF001
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)  # noqa: SLF001


def map_batches(df: DataFrame, fn: Callable[..., Iterable[list]], schema: str, names: list[str]) -> DataFrame:
    """Apply ``fn(*columns as Python lists) -> columns`` to each Arrow batch of ``df``.

    ``names`` are the output columns in the order ``fn`` returns them; ``schema`` is
    the same as DDL. Memory per task is one batch, which ``small_batches`` keeps small.
    """
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=arrow.field(n).type) for c, n in zip(columns, names, strict=True)], names=names
                )

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, keep: Callable[[object], bool]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose ``column`` passes ``keep``."""
    small_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([keep(x) for x in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets Python workers get whole texts in batches of some 8 MB, unless the session asks for less still."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") or 0) <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def free_name(df: DataFrame, label: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{label}"
    while name in taken:
        name += "_"
    return name


def arrow_schema(ddl: str) -> pa.Schema:
    """A schema written as DDL, as Arrow's. Made on the driver: workers have no session to read DDL with."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def documents_of(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that further columns never clash with an operator's own."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def crc_mod(column: str, n: int) -> Column:
    """``crc32`` of the id written as text, modulo ``n``: the split of training from held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
