"""Lempel-Ziv phrase fingerprints: minimum-hash signatures over the set of dictionary phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .common import mix, partitions, ship

SIZE = 64
_SALTS = (np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(1, -1)


def parse(text: str, phrases: set[str] | None = None) -> set[str]:
    """Phrases of the text: each is the longest phrase known so far plus one code point.

    The last one, which may be known already, is added as it is. A given set goes on being filled.
    """
    known = set() if phrases is None else phrases
    phrase = ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    if phrase:
        known.add(phrase)
    return known


def split_parse(text: str, cut: int) -> tuple[set[str], set[str], str]:
    """Phrases of the text; those complete within its first `cut` code points; what is open there."""
    head: set[str] = set()
    phrase = ""
    for c in text[:cut]:
        phrase += c
        if phrase not in head:
            head.add(phrase)
            phrase = ""
    return parse(phrase + text[cut:], set(head)) if phrase or cut < len(text) else set(head), head, phrase


def signature(phrases: set[str]) -> np.ndarray:
    """SIZE least hashes of 32 bits; all ones for no phrases."""
    if not phrases:
        return np.full(SIZE, 0xFFFFFFFF, np.uint32)
    h = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for p in phrases), np.uint64, len(phrases))
    out = np.full(SIZE, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for lo in range(0, len(h), 2048):
        with np.errstate(over="ignore"):
            out = np.minimum(out, mix(h[lo : lo + 2048, None] + _SALTS).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def hexed(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places, which estimates the Jaccard similarity of the phrase sets."""
    return float((a == b).mean())


def opened(text: str) -> dict:
    """What a row keeps until its next document comes: signature and the phrases of the first half."""
    keep = len(text) - len(text) // 2
    whole, head, phrase = split_parse(text, keep)
    return {"text": text, "sig": signature(whole), "head": head, "phrase": phrase}


def described(row: dict, following: dict) -> dict:
    """A document's columns, given its next document; both as `opened` made them."""
    text, n = row["text"], len(row["text"])
    filler = following["text"][: n // 2]
    edited = signature(parse(row["phrase"] + filler, set(row["head"])))
    return {
        "n_chars": n,
        "edited_sha256": hash_text(text[: n - n // 2] + filler),
        "fingerprint": hexed(row["sig"]),
        "edited_fingerprint": hexed(edited),
        "near_edited": likeness(row["sig"], edited),
        "near_next": likeness(row["sig"], following["sig"]),
    }


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of the text whose second half comes from the next document.

    Next means: descending doc_id, after the last the first; null ids come last, repeated ids in
    the order of their texts; of a single document, itself. Null and empty texts have no phrases
    (a fingerprint of ones, alike to each other). An empty table gives no rows.

    Rows are dealt to ranges of the id, each range gets the first row of the next one as well, and
    a task goes through its range from the end, so it holds two texts at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("text")]
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = partitions(spark)
    bounds = slim.where("doc_id is not null").selectExpr(
        f"approx_percentile(doc_id, array({', '.join(str(i / n) for i in range(1, n))}), 10000) as q"
    ).first() if n > 1 else None
    cuts = sorted(set(bounds["q"])) if bounds and bounds["q"] else []
    # Part number falls as ids rise; a literal list of at most as many bounds as partitions.
    array = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(
        F.lit(len(cuts)) - F.size(F.filter(array, lambda c: F.col("doc_id") >= c))
    )
    dealt = slim.withColumn("part", part)
    heads = dealt.groupBy("part").agg(F.max("doc_id").alias("top"))
    chain = Window.orderBy("part")  # one row per part
    before = F.coalesce(F.lag("part").over(chain), F.last("part").over(chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = write_through(heads.withColumn("to", before), "part-heads")
    tops = (
        dealt.join(F.broadcast(heads), "part")
        .where(F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("to")
        .agg(F.min_by(F.struct("doc_id", "text"), F.struct("hash", "text")).alias("t"))
        .select("t.doc_id", "t.text", F.lit(0).cast("long").alias("hash"), F.col("to").alias("part"), F.lit(1).alias("tail"))
    )
    rows = dealt.withColumn("tail", F.lit(0)).unionByName(tops)
    rows = rows.repartition(n, "part").sortWithinPartitions(F.col("part"), F.col("tail"), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = None  # the row that waits for its next one, within one part
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).select(["doc_id", "text", "part", "tail"]).to_pylist():
                    r |= opened(r["text"])
                    if held is not None and held["part"] == r["part"]:
                        out.append({"doc_id": held["doc_id"], **described(held, r)})
                    held = None if r["tail"] else r
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=target)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    target = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [(c, pa.float64()) for c in ("near_edited", "near_next")]
    )
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, ddl)
