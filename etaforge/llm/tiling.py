"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import map_texts, shingle_hashes

TOKEN = re.compile(r"\w+")
#: Shortest tile in words, and the least share of an item's words that tiles must cover.
MIN_MATCH, COVERAGE = 5, 0.5
#: Items are taken in blocks of at most so many bytes of text (or one longer item), one block at a time, each of
#: which is broadcast and passes over the documents once.
BLOCK_BYTES = 64_000_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Seeds:
    """Rolling hashes of all runs of MIN_MATCH words of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        words = [tokens(t) for _, t in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        # An item shorter than a tile is one seed of its own length.
        self.widths = np.minimum(self.sizes, MIN_MATCH)
        self.tables = {}
        for width in sorted({int(x) for x in self.widths if x}):
            own = [k for k, x in enumerate(self.widths) if x == width]
            hashes = [shingle_hashes(words[k], width) for k in own]
            h = np.concatenate(hashes)
            item = np.concatenate([np.full(len(x), k) for k, x in zip(own, hashes, strict=True)])
            place = np.concatenate([np.arange(len(x)) for x in hashes])
            order = np.argsort(h, kind="stable")
            self.tables[width] = (h[order], item[order], place[order])

    def matches(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(item, words covered, words) of every item that shares a seed with the text."""
        out = []
        for width, (h, item, place) in self.tables.items():
            if len(words) < width:
                continue
            doc = shingle_hashes(words, width)
            lo, hi = np.searchsorted(h, doc, "left"), np.searchsorted(h, doc, "right")
            at = np.flatnonzero(hi > lo)
            if not len(at):
                continue
            count = (hi - lo)[at]
            pick = np.repeat(lo[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            docs, items, places = np.repeat(at, count), item[pick], place[pick]
            for k in np.unique(items):
                own = items == k
                out.append((int(k), tile(places[own], docs[own], width), int(self.sizes[k])))
        return out


def tile(p: np.ndarray, t: np.ndarray, width: int) -> int:
    """Words of the item covered by tiles: the longest match of unmarked words is marked, again and again.

    p, t: places in item and text of equal runs of `width` words. Neighbours on a diagonal make one
    maximal match. Of equally long matches the earliest in the item, then in the text, goes first.
    """
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) != 1) | (np.diff(t) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(p))) + width - 1
    heap = [(-int(n), int(p[s]), int(t[s])) for s, n in zip(starts, lengths, strict=True)]
    heapq.heapify(heap)
    used_p: set[int] = set()
    used_t: set[int] = set()
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in used_p and b + k not in used_t for k in range(-n)]
        if all(free):
            used_p.update(range(a, a - n))
            used_t.update(range(b, b - n))
            continue
        run = 0
        for k, ok in enumerate([*free, False]):  # the unmarked rest waits for its turn by length
            if ok:
                run += 1
            else:
                if run >= width:
                    heapq.heappush(heap, (-run, a + k - run, b + k - run))
                run = 0
    return len(used_p)


def _blocks(rows: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """(item_id, text) in blocks of at most `most` bytes of text; an empty block if there are no rows."""
    block, size, first = [], 0, True
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if block and size + n > most:
            yield block
            block, size, first = [], 0, False
        block.append((r["item_id"], r["text"]))
        size += n
    if block or first:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus contaminated, n_items, best_item, best_coverage of every row.

    An item counts if tiles of MIN_MATCH words or more cover at least `coverage` of its words, in
    any order. Words are letters, digits and underscores, lower-cased. Null or wordless texts and items match nothing;
    an item under MIN_MATCH words must occur whole. Repeated items count once by id; of equally covered items
    the smallest id is best. Each distinct text of null id is an item of its own, best (with a null best_item)
    only if it is covered more than all items with an id. An empty benchmark marks nothing.
    """
    spark = docs.sparkSession
    rows = benchmark.where("text is not null").select("item_id", "text").distinct()
    shared = None
    out = docs.select(*keep, "text", F.lit(None).cast("array<struct<c:double,i:bigint>>").alias("hits"))
    for block in _blocks(rows, BLOCK_BYTES):
        if shared is not None:  # the block before is done with and leaves the driver and the executors
            out = write_through(out, "tiling-hits")
            shared.destroy()
        shared = spark.sparkContext.broadcast(Seeds(block) if block else None)

        def run(texts: list, shared=shared) -> dict:
            hits = []
            for t in texts:
                best: dict = {}
                if t and shared.value:
                    for k, covered, n in shared.value.matches(tokens(t)):
                        if covered >= coverage * n:
                            i = shared.value.ids[k]
                            item = (i, k if i is None else -1)
                            best[item] = max(best.get(item, 0.0), covered / n)
                hits.append([{"c": c, "i": i} for (i, _), c in best.items()])
            return {"found": hits}

        made = map_texts(out.withColumn("_text", F.col("text")), run, (*keep, "text", "hits"), "found array<struct<c:double,i:bigint>>", text="_text")
        out = made.select(*keep, "text", F.concat(F.coalesce("hits", F.array().cast("array<struct<c:double,i:bigint>>")), "found").alias("hits"))
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["c"].alias("c"), (-h["i"]).alias("i"))))
    return out.select(
        *keep,
        "text",
        (F.size("hits") > 0).alias("contaminated"),
        (
            F.size(F.array_distinct(F.filter("hits.i", lambda i: i.isNotNull())))
            + F.size(F.filter("hits.i", lambda i: i.isNull()))
        ).alias("n_items"),
        (-best["i"]).alias("best_item"),
        best["c"].alias("best_coverage"),
    )
