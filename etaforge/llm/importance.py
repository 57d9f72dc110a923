"""Target-distribution importance resampling over hashed word runs, with length-bucketed CRC matrices."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import DROPS, SLICE, map_texts, partitions, ship, take_over

#: A word in the UTF-8 bytes of a text whose A-Z are lower-cased: digits, a-z, and all beyond ASCII.
BYTE_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CACHE_FEATURES = 500_000


def crc_table() -> np.ndarray:
    """Checksums of the 256 single bytes, from the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


TABLE = crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """crc32 of every row of a two-dimensional uint8 array, all rows at once, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc_of(features: list[bytes]) -> np.ndarray:
    """crc32 of each feature: those of one length form a matrix, results are scattered back."""
    out = np.empty(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    for n, at in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True) if len(features) else ():
        flat = b"".join([features[i] for i in at.tolist()])
        out[at] = crc_matrix(np.frombuffer(flat, np.uint8).reshape(len(at), n))
    return out


class Buckets(dict):
    """Feature to bucket, kept for the life of a worker up to a fixed number of features."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def learn(self, features: set[bytes]) -> None:
        if len(self) > CACHE_FEATURES:
            self.clear()
        new = [f for f in features if f not in self]
        self.update(zip(new, (crc_of(new) % np.uint32(self.buckets)).tolist(), strict=True))


_KNOWN: dict[int, Buckets] = {}
DROPS[__name__] = _KNOWN.clear


def features_of(text: str | None, longest: int) -> tuple[list[bytes], int]:
    """All runs of 1 to `longest` consecutive words, joined by one space, repeats kept; number of words."""
    words = BYTE_WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    out = list(words)
    for size in range(2, longest + 1):
        out += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return out, len(words)


def hashed(texts: list, longest: int, buckets: int) -> tuple[list[np.ndarray], list[int]]:
    """Per text the buckets of its features, and its number of words."""
    known = _KNOWN.setdefault(buckets, Buckets(buckets))
    made = [features_of(t, longest) for t in texts]
    known.learn(set().union(*(f for f, _ in made)))
    return [np.fromiter(map(known.__getitem__, f), np.int32, len(f)) for f, _ in made], [n for _, n in made]


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: features of all texts per bucket. A task sends one row per bucket it met at most."""
    ship(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found, _ = hashed(batch.column(0).slice(at, SLICE).to_pylist(), longest, buckets)
                total += np.bincount(np.concatenate(found), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], schema=schema)

    return docs.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def count_vector(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most one row per bucket comes to the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored 1000-fold log ratio of its smoothed shares in target and raw texts."""
    m, all_raw, all_target = len(raw), float(raw.sum()), float(target.sum())
    pairs = zip(raw.tolist(), target.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_raw + m) / ((s + 1.0) * (all_target + m)))) for s, t in pairs],
        np.int64,
    )


def gumbel(key: Column, seed: int) -> Column:
    """Floored 1000-fold Gumbel noise from sha256 of seed and key; a null key counts as empty."""
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(salted, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`.

    Weight is the floored mean of the gains over the row's features, score adds Gumbel noise of the
    key, and of the N rows with `least_words` words the floor(percent * N / 100) highest scores get
    ranks 1, 2, 3...; equal scores go to the smaller key, null keys last, repeated rows in any
    order. Null and empty texts have no features and weight 0. Columns beyond key and text are not
    read; empty `docs` give no rows, an empty `target` is smoothed like any other.

    Texts are read twice, for counts and for weights. What leaves a task is one row per bucket, and
    narrow rows for the ranking, which sorts by ranges of (score, key, row): one group of equal
    scores or ids is cut by row as well. Tasks hold a slice of texts and one count per bucket.
    """
    raw = count_vector(bucket_counts(docs, text, longest, buckets), buckets)
    table = gains(raw, count_vector(bucket_counts(target, target_text, longest, buckets), buckets))

    def weigh(texts: list) -> dict:
        found, words = hashed(texts, longest, buckets)
        weight = [int(table[f].sum()) // len(f) if len(f) else 0 for f in found]
        return {"n_features": [len(f) for f in found], "n_words": words, "weight": weight}

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = map_texts(slim, weigh, ("doc_id",), "n_features bigint, n_words bigint, weight bigint")
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = write_through(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-scores")
    fits = F.col("n_words") >= least_words
    n = scored.where(fits).count()
    return ranked(scored.withColumn("fits", fits), n * percent // 100)


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """Global positions from range partitions and their totals; the first `draw` fitting rows keep theirs."""
    order = [F.col("fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    dealt = scored.repartitionByRange(partitions(scored.sparkSession), *order).sortWithinPartitions(*order)
    # The number holds the partition in its upper bits and the place in the lower 33; range bounds
    # come from a sample, so both are written once and never computed again.
    dealt = write_through(dealt.withColumn("_at", F.monotonically_increasing_id()), "importance-order")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("fits") & (place <= draw)
    return dealt.join(F.broadcast(bases), "_part").select(  # one row per partition
        "doc_id", "n_features", "weight", "score", F.when(drawn, place).alias("rank")
    )
