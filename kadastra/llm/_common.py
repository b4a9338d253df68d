"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words in the licence and join contracts, as a 256-byte table:
#: A-Z to a-z, every other ASCII byte that is no letter or digit to a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see: the one set, else ``spark.checkpoint.dir``, else, on a local master only,
    a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving unused Arrow memory back when the task ends, as workers live on."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over whole batches: ``make()`` runs once a task and returns a function
    from a dict of Python column lists to a dict of output columns (lists or Arrow arrays)."""
    out = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                cols = f(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := cols[x.name], pa.Array) else pa.array(c, x.type) for x in out], schema=out
                )

    return df.mapInArrow(frugal(run), schema)


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def text_of(df: DataFrame, *keep: str) -> DataFrame:
    """The named columns and ``text`` with null as empty."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
