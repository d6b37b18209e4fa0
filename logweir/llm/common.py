"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits (as a power of two) of the map that says which rows may have a key.
MAP_BITS = 24
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (as in tests) gets a folder of its own;
    on a cluster it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="logweir-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables in the shared folder, written once and read back.

    A written table cuts the lineage: a lost executor costs its running tasks
    only. Tables that nothing reads any more are removed with :meth:`drop`;
    those behind a returned DataFrame stay until :meth:`close`, the end of a
    block of :func:`temporary`, or until the folder is emptied.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/logweir-llm-{uuid.uuid4().hex}"
        for made in _OPEN_BLOCKS[-1:]:
            made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Remove all tables; nothing may read them any more."""
        self._delete(self.root)

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_OPEN_BLOCKS: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """The tables of every :class:`Scratch` made inside are removed at the end: for a result that is written inside."""
    _OPEN_BLOCKS.append([])
    try:
        yield
    finally:
        for scratch in _OPEN_BLOCKS.pop():
            scratch.close()


def share_package(spark: SparkSession) -> None:
    """Let Python workers on machines that have this package at the same place import it from there.

    Where it is installed otherwise, or shipped with the job, this changes nothing.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, root]))


def release_memory() -> None:
    """Give memory that is free back to the machine; workers wait idle between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with a function of this package, after which a worker keeps no memory."""
    share_package(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(released, schema)


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is; null is empty.

    ``lower`` does this for ASCII text and is much faster than ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text that is not null, as an array."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or the first of ``name_2, name_3, ...`` that is not among ``taken``; case does not tell names apart."""
    used = {other.lower() for other in taken}
    return next(found for k in count(1) if (found := name if k == 1 else f"{name}_{k}").lower() not in used)


def quoted(name: str) -> str:
    """A column name as Spark reads it literally."""
    return f"`{name.replace('`', '``')}`"


def mark_possible(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with the boolean ``name``: false only where ``key`` is surely not in the one column of ``keys``.

    Keys are marked in a map of ``2**MAP_BITS`` bits, so what is broadcast is bounded
    (``2**MAP_BITS / 64`` rows) whatever their number; a full map marks all rows.
    No row moves. Null is a key like others.
    """
    word, bits, place = (free_name(each, [*rows.columns, name]) for each in ("word", "bits", "place"))
    own = F.col(quoted(keys.columns[0]))
    of_key = lambda column: F.pmod(F.xxhash64(column), F.lit(1 << MAP_BITS))
    words = keys.select(of_key(own).alias(place)).groupBy(F.shiftright(place, 6).alias(word))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias(bits))
    marked = rows.withColumn(place, of_key(key)).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word, "left")
    is_set = F.coalesce(F.expr(f"shiftrightunsigned({bits}, cast({place} % 64 as int)) & 1") == 1, F.lit(False))
    return marked.select(*[F.col(quoted(each)) for each in rows.columns], is_set.alias(name))


def hex_bits(text: Column, digits: int = 15) -> Column:
    """The first hex digits of a text's MD5 as a long: a seeded, portable hash."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
