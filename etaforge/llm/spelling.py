"""Spelling variants: words one edit apart, found by banded edit rows along sorted word lists."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import SLICE, UPPER, partitions, ship

CACHE_WORDS = 300_000
DROP_EVERY = 31


def runs_of(letters: str, least: int) -> re.Pattern:
    """Maximal runs of the letters that are at least so long."""
    return re.compile(f"[{letters}]{{{least},}}")


def misspelt(words: list[str], key: int | None) -> Iterator[str]:
    """The words; where `DROP_EVERY` divides the crc32 of `<key>:<word>`, less one code point."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())
    for w in words:
        h = zlib.crc32(w.encode("utf-8"), start)
        if h % DROP_EVERY == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        yield w


def word_counts(docs: DataFrame, least_length: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n of all words with at least `least_length` code points. Tasks send partial counts."""
    ship(docs.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    find = runs_of("A-Za-zÀ-ÿ", least_length).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            kept = {w: n for w, n in counts.items() if len(w) >= least_length}
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for w in misspelt(find((t or "").translate(UPPER)), i):
                        counts[w] += 1
                if len(counts) > CACHE_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(key, text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def lcps(words: list[str]) -> list[int]:
    """Length of the prefix that each word shares with the one before it; 0 for the first."""
    out = [0]
    for a, b in zip(words, words[1:], strict=False):
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        out.append(k)
    return out


def hops(lcp: list[int]) -> list[int]:
    """For each place the next one whose shared prefix is shorter; the length of the list if there is none."""
    out, open_ = [len(lcp)] * len(lcp), []
    for j, n in enumerate(lcp):
        while open_ and lcp[open_[-1]] > n:
            out[open_.pop()] = j
        open_.append(j)
    return out


def near_after(words: list[str], i: int, lcp: list[int], hop: list[int], known: int = 0) -> list[int]:
    """Places j > i of the sorted distinct words whose edit distance to words[i] is one.

    rows[k] holds the three cells of the edit matrix around the diagonal after k signs of the word
    at j. The next word keeps the rows of the prefix it shares with this one. If all three exceed
    one edit after `dead` signs, every following word that shares them is passed over. The first
    `known` signs are the same in all words, so their rows are known.
    """
    a = words[i]
    la = len(a)
    padded = a + "\0\0\0"  # columns beyond the word: never matched, never read
    rows = [(2, 0, 1)] if not known else [None] * known + [(1, 0, 1)]
    found = []
    j, total = i + 1, len(words)
    while j < total:
        b = words[j]
        lb = len(b)
        dead = 0
        k = len(rows) - 1
        x, y, z = rows[k]
        while k < lb:
            c = b[k]
            u = x + (k == 0 or c != padded[k - 1])
            if y + 1 < u:
                u = y + 1
            v = y + (c != padded[k])
            if u + 1 < v:
                v = u + 1
            if z + 1 < v:
                v = z + 1
            w = z + (c != padded[k + 1])
            if v + 1 < w:
                w = v + 1
            x, y, z = u, v, w
            k += 1
            if x > 1 and y > 1 and z > 1:
                dead = k
                break
            rows.append((x, y, z))
        if not dead and (lb - la == 1 and x == 1 or lb == la and y == 1 or la - lb == 1 and z == 1):
            found.append(j)
        j += 1
        if dead:
            while j < total and lcp[j] >= dead:
                j = hop[j]
        if j < total:
            # What lies between was passed over because it shares `dead` signs, more than the next one does.
            shared = lcp[j]
            if shared < known:
                break
            del rows[shared + 1 :]
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: every two of the distinct words that are one edit apart, once.

    Let m be the shorter one's length. The edit lies after the first m // 2 signs, which both then
    share, or both share the last m - m // 2. So each word goes, for m its length and one less, to
    the block of its first half and, reversed, to that of its last half; a block is a list sorted
    by word, and a pair is taken where m is the shorter length and, in blocks of last halves, where the
    first halves differ. Blocks hold distinct words with half of their signs in common: copies of texts
    do not make them larger, and passing over whole prefixes keeps large ones from all-pairs work.
    """
    spark = words.sparkSession
    ship(spark)
    n = F.length("word")

    def half(side: int, m: Column) -> Column:
        size = F.floor(m / 2).cast("int")
        w = F.col("word") if side == 0 else F.reverse("word")
        return F.struct(F.lit(side).alias("side"), m.alias("m"), w.alias("w"), (size if side == 0 else m - size).alias("p"))

    sides = F.array(*(half(side, n - d) for side in (0, 1) for d in (0, 1)))
    rows = words.select(F.inline(sides), "n").where("m > 0")
    rows = rows.repartition(partitions(spark), "side", "m", F.substring(F.col("w"), F.lit(1), F.col("p")))
    rows = rows.sortWithinPartitions("side", "m", "w")
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("n_a", pa.int64()), ("n_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("side", "m", "p", "w", "n")), strict=True)

        out: list[tuple] = []
        for (side, m, p, _), block in groupby(flat(), lambda r: (r[0], r[1], r[2], r[3][: r[2]])):
            members = [(r[3], r[4]) for r in block]
            if len(members) < 2:
                continue
            out += block_pairs(side, m, p, members)
            if len(out) >= 10_000:
                yield as_batch(out)
                out = []
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema, strict=True)], schema=schema)

    return rows.select("side", "m", "p", "w", "n").mapInArrow(run, "a string, b string, n_a bigint, n_b bigint")


def block_pairs(side: int, m: int, p: int, members: list[tuple[str, int]]) -> list[tuple]:
    """Pairs of one block; its members come sorted and share their first p signs."""
    words = [w for w, _ in members]
    lcp = lcps(words)
    hop = hops(lcp)
    out = []
    for i, (w, n) in enumerate(members[:-1]):
        for j in near_after(words, i, lcp, hop, p):
            v, n_v = members[j]
            if len(w) > m and len(v) > m:  # a pair of the next block
                continue
            if side == 0:
                out.append((w, v, n, n_v))
            elif w[::-1][: m // 2] != v[::-1][: m // 2]:
                out.append((w[::-1], v[::-1], n, n_v))
    return out


def roots(words: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Each round doubles the steps that are followed."""
    at = write_through(words.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    while True:
        up = at.where("word <> root").select(F.col("word").alias("root"), F.col("root").alias("up"))
        # The roots of frequent words are hot keys of the left side, which AQE may split.
        step = at.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        step = write_through(step, "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(
    docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `least_length` code points that
    occurs `least_n` times in all texts.

    Its form is the word one edit away with the largest n (ties: smallest in code-point order), if
    that n is at least `times` its own; its root the last of the chain of forms, which ends as n
    grows with each step. Null and empty texts have no words; a null key counts as empty in the
    rule that drops a letter; repeated rows count again; an empty table gives no rows. Columns
    beyond key and text are not read.
    """
    counted = word_counts(docs, least_length, key, text).where(F.col("n") >= least_n)
    counted = write_through(counted, "spelling-words")
    pairs = near_pairs(counted)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.select(F.inline(both)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = counted.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n")
    )
    fits = F.col("near_n") >= F.lit(times) * F.col("n")
    found = found.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    found = write_through(found, "spelling-forms")
    return found.join(roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
