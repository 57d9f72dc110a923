"""Shared helpers: reading columns, applying a function to texts in small Arrow slices, word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 256
#: Rows of an Arrow batch at most: ten thousand whole texts are held several times over by the JVM and by Python.
BATCH_ROWS = 4 * SLICE
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


#: What the operators keep in a Python worker from one task to the next, by module: ways to drop it.
DROPS: dict[str, Callable[[], None]] = {}
_HOLDER: list[str] = []


def take_over(module: str) -> None:
    """Drop what operators of other modules keep in this worker and give the memory back, so that a
    chain of jobs holds the caches of one operator at a time. Called where a task begins; what the
    task before took and freed is given back as well."""
    if _HOLDER != [module]:
        for name, drop in DROPS.items():
            if name != module:
                drop()
        _HOLDER[:] = [module]
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and small batches of texts."""
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    if getattr(sc, "_etaforge_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="etaforge-code-")) / "etaforge_code.zip"  # sent by Spark itself
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._etaforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def map_texts(df: DataFrame, fn: Callable[[list], dict], keep: tuple[str, ...], ddl: str, text: str = "text") -> DataFrame:
    """Columns `keep` plus those of `ddl`, which fn makes from a list of texts (None where null).

    fn returns one list or array per new column. A task holds one slice of texts at a time.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(ddl)
    schema = StructType([*(df.schema[k] for k in keep), *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(fn.__module__)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = fn(part.column(len(keep)).to_pylist())
                arrays = [part.column(k).cast(target.field(k).type) for k in range(len(keep))]
                arrays += [pa.array(made[f.name], target.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*keep, text).mapInArrow(run, schema)


class Hashes(dict):
    """Word to 64-bit hash, kept for the life of the worker up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = Hashes()
DROPS[__name__] = HASHES.clear


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    """Hash of each run of `size` words, in order; all words as one run if there are fewer."""
    h = word_hashes(words)
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] + np.uint64(k + 1))
    return out


def id_order(col):
    """Nulls first, then ascending: one order for ids everywhere."""
    return F.col(col).asc_nulls_first()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
