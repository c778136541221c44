"""Things that several operators of this subpackage share.

* ``WORD`` is the definition of a word: a run of characters other than the six
  ASCII white-space characters.  ``bytes.split()`` uses exactly that set.
* ``table`` reads a table of an input folder with Spark's own readers.
* ``cut`` ends a lineage: it writes a frame as Parquet into the folder that all
  executors share and reads it back, so that lost executors cost no recomputation
  of what came before.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts, as regular expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch that goes to a Python worker.  Texts may be very long, so
#: a batch of Spark's default of 10,000 rows could take gigabytes.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read the table ``name`` of an input folder; any path that Spark can open will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, unless the session asks for fewer already."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a frame that reads it from there.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    made = spark.read.schema(df.schema).parquet(path)
    made.tm_path = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the table of a frame from :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.tm_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def no_collector():
    """Without Python's cyclic garbage collector, for caches of many small objects; workers are used again, so it comes back."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def file_bytes(file: str | bytes) -> bytes:
    """The bytes of a file of the driver, for sending to executors, which may not have it; bytes as they are."""
    return file if isinstance(file, bytes) else Path(file).read_bytes()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others as ``tm_rest``, so that no name of theirs can clash."""
    rest = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns) if c not in own]
    return df.select(*own, F.struct(F.lit(0).alias("none"), *rest).alias("tm_rest"))


def unpacked(columns: list[str], *own: str) -> list[Column]:
    """The columns that :func:`packed` put away, with ``own`` among them, in their order."""
    return [F.col(c) if c in own else F.col(f"tm_rest.c{i}").alias(c) for i, c in enumerate(columns)]


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to be none of ``columns``."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null."""
    return text.encode("utf-8", "replace").split() if text else []


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text column as string, empty for null."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def schema(**kinds: str) -> T.StructType:
    """A schema from names and type names, all nullable."""
    return T.StructType([T.StructField(k, T._parse_datatype_string(v), True) for k, v in kinds.items()])


def map_rows(df: DataFrame, work, ids: list[str], /, **fields: str) -> DataFrame:
    """``df`` through a function on pandas frames, with ``ids`` and ``fields`` as result.

    The ids travel as strings: pandas would turn whole numbers with nulls among them into
    floats, which can't hold all of them.
    """
    kinds = {c: df.schema[c].dataType for c in ids}
    sent = df.withColumns({c: F.col(c).cast("string") for c in ids})
    out = sent.mapInPandas(work, schema(**dict.fromkeys(ids, "string"), **fields))
    return out.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def runs_of(frames: Iterable, key: str) -> Iterator:
    """Frames with all rows of one value of ``key`` each, from batches sorted by ``key``."""
    import pandas as pd

    held: list = []
    at = None
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        edges = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != at:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            at = keys[a]
            held.append(frame.iloc[a:b])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
