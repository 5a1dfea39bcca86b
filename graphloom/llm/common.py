"""Helpers shared by the operators: Arrow columns, splits, worker caches; written tables come from the library."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.checkpoints import fresh_path as fresh_path
from graphloom.operators.checkpoints import written

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR; bytes.split() without arguments cuts just there.
WORD = r"[^\x20\x09-\x0D]+"

materialize = written

BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows an Arrow batch to BATCH_ROWS: rows here are whole texts, and each batch is held several times."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash_limit(wanted: int, rows: int) -> int:
    """The 64-bit hash up to which about `wanted` of so many rows lie; all of them, if there are no more than that."""
    return 2**63 - 1 if rows <= wanted else -(2**63) + int(2**64 * wanted / rows)


def py_remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: list = [None, None]


def worker_cache(kind: str, key: object, make: Callable[[], object]) -> object:
    """An object that a worker process keeps for the next tasks of its kind; another kind or key drops it first.

    Workers outlive stages. What one operator has cached there would add up with the next one's, so it goes, and its
    memory is given back.
    """
    if _kept[0] != (kind, key):
        _kept[:] = [None, None]
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass
        _kept[:] = [(kind, key), make()]
    return _kept[1]
