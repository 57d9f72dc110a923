"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .common import UPPER, WORD, map_texts, mix, partitions, shingle_hashes

#: Two sets of similarity 0.85 miss all 24 bands of 5 ranks with probability 8e-7.
BANDS, ROWS = 24, 5


def superminhash(elements: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signature of a set of uint64: register p holds the least j + r over elements whose j-th place in
    their own random permutation is p, with r random in [0, 1).

    Round j treats all elements at once; after a round whose j + 1 no register exceeds, no later
    value can change anything and the work stops, as a rule after few rounds for long texts.
    """
    h = np.full(m, np.inf)
    n = len(elements)
    order = None
    with np.errstate(over="ignore"):
        for j in range(m):
            rnd = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + (rnd % np.uint64(m - j)).astype(np.int64)
            if j == 0:
                first, place = k, k
            else:
                if order is None:  # second round: permutations are needed from here on
                    order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (n, 1))
                    order[np.arange(n), first], order[:, 0] = 0, first
                at = np.arange(n)
                place = order[at, k].astype(np.int64)
                order[at, k], order[:, j] = order[:, j].copy(), place
            np.minimum.at(h, place, j + (mix(rnd) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            if h.max() < j + 1:
                break
    return h


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashed 5-word shingles, ascending; of fewer words the whole sequence; of none nothing."""
    return np.unique(shingle_hashes(WORD.findall((text or "").translate(UPPER)), 5))


def _describe(texts: list) -> dict:
    n, key, bands, sketch = [], [], [], []
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64))
    for t in texts:
        s = shingles(t)
        n.append(len(s))
        if not len(s):
            key.append(None), bands.append([]), sketch.append(None)
            continue
        with np.errstate(over="ignore"):
            key.append(f"{int(mix(s).sum()):016x}{int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()):016x}")
            bits = superminhash(s).view(np.uint64)
            bands.append(mix((bits.reshape(BANDS, ROWS) * weights).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist())
            sketch.append((mix(bits) & np.uint64(0xFF)).astype(np.uint8).tobytes())
    return {"n_shingles": n, "key": key, "bands": bands, "sketch": sketch}


def _sets(texts: list) -> dict:
    return {"s": [shingles(t).view(np.int64).tolist() for t in texts]}


def _alike(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum())


def sketch_floor(least: int, m: int = BANDS * ROWS) -> int:
    """Places in which the sketches of two sets of similarity `least` percent agree at the least: six
    deviations below the mean, taken as those of plain MinHash, which are larger."""
    j = least / 100
    return int(m * j - 6 * (m * j * (1 - j)) ** 0.5)


def _sketch_filter(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """Distinct pairs (a, b) less those whose sketches agree in fewer places than `sketch_floor`.

    Sketches are looked up here, once per distinct pair, and carried nowhere else."""
    floor = sketch_floor(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= floor))

    sa, sb = sketches.toDF("a", "sa"), sketches.toDF("b", "sb")
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of ids whose full sets have 100 * intersection >= least * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = map_texts(texts.join(ids, "id"), _sets, ("id",), "s array<bigint>")
    sets = write_through(sets, "shingle-sets")
    a, b = sets.toDF("a", "x"), sets.toDF("b", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = []
                for x, y in zip(part.column("x"), part.column("y"), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= least * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: the same components with an edge per node at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, find(x)) for x in parent]
            rows = [(x, r) for x, r in rows if x != r]
            return pa.RecordBatch.from_pydict(
                {"a": pa.array([r for _, r in rows], pa.int64()), "b": pa.array([x for x, _ in rows], pa.int64())}
            )

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 500_000:
                yield out()
                parent.clear()
        yield out()

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every node of the edges.

    Each round hooks every node to the smallest label around it and then follows the label's own
    label; a table is written per round. Hub nodes are summed map-side, never gathered.
    """
    edges = write_through(forest(edges), "forest")
    both = edges.union(edges.select("b", "a")).toDF("id", "other")
    labels = write_through(both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), "labels")
    while True:
        near = labels.join(both, "id").groupBy(F.col("other").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        # A label's holder may be hot, so its row is looked up with AQE free to split the left side.
        step = step.join(up, "label", "left").select("id", "old", F.coalesce(F.least("label", "up"), "label").alias("label"))
        done = write_through(step, "labels")
        labels = done.select("id", "label")
        if done.where("old <> label").isEmpty():
            return labels


def near_components(docs: DataFrame, least: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Equal sets are linked first, through the smallest id that has the set; the representatives
    are then banded. Every member of a bucket is compared with the bucket's smallest id: a
    comparison per member, whatever the bucket's size. Buckets that then still hold members of
    different components go through `rest_pairs`, which leaves out no pair that can be a link. Null
    and wordless texts have no links, a null id stays null and is linked with nothing. Repeated
    rows of one id share the id's component. An empty table gives no rows.
    """
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    described = map_texts(slim, _describe, ("id",), "n_shingles bigint, key string, bands array<bigint>, sketch binary")
    described = write_through(described, "signatures")
    usable = described.where("key is not null and id is not null")
    reps = write_through(
        usable.groupBy("key").agg(F.min("id").alias("rep"), F.min_by(F.struct("bands", "sketch", "n_shingles"), "id").alias("v"))
        .select("key", F.col("rep").alias("id"), "v.*"),
        "representatives",
    )
    texts, sketches = slim.where("id is not null"), reps.select("id", "sketch")
    # A slot is a band and its value (values of different bands are hashed apart). Slots of one row
    # are gone before anything is joined.
    slots = reps.select("id", "n_shingles", F.explode("bands").alias("slot"))
    heads = slots.groupBy("slot").agg(F.min(F.struct("id", "n_shingles")).alias("head"), F.count("*").alias("n"))
    members = write_through(slots.join(heads.where("n > 1"), "slot"), "members")
    star = members.where("id <> head.id").select(
        F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n_shingles").alias("m"), F.col("n_shingles").alias("n")
    )
    star = write_through(star.where(_fits("m", "n", least)).select("a", "b").distinct(), "star-pairs")
    links = write_through(verify(write_through(_sketch_filter(star, sketches, least), "near-pairs"), texts, least), "links")
    equal = usable.join(reps.select("key", F.col("id").alias("a")), "key").where("id <> a").select("a", F.col("id").alias("b"))
    same = write_through(equal, "equal-links")
    rest = rest_pairs(members, components(links), star, texts, least)
    rest = write_through(_sketch_filter(rest, sketches, least), "rest-pairs")
    labels = components(links.union(verify(rest, texts, least)).union(same))
    return described.join(labels, "id", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("label", "id").alias("component_id"),
        (F.coalesce("label", "id").eqNullSafe(F.col("id"))).alias("kept"),
    )


def _fits(n: str, m: str, least: int):
    """Sets of such sizes can be as similar as `least` percent."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * least


def rest_pairs(members: DataFrame, labels: DataFrame, tested: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """Distinct pairs that may be links, among the sets of buckets which hold several components.

    Two sets of n and more shingles that are `least` percent alike share one of the n -
    ceil(least * n) + 1 shingles that come first in any common order. The order here is rarest
    first, as counted over these sets: an edited copy of a common text begins with shingles of its
    own, which few share, so it meets few others or none, while in a bucket it would meet all. The
    places of the shingle at which a pair meets bound its likeness, and most pairs that meet all the
    same end there. Pairs of one component and pairs already `tested` are left out; of the members
    that share a shingle, those outside its largest component meet all others, so copies of one
    text never meet each other.
    """
    placed = members.where("n > 2").join(labels, "id", "left").select("slot", "id", F.coalesce("label", "id").alias("label"))
    mixed = placed.groupBy("slot").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("slot")
    asked = write_through(placed.join(mixed, "slot", "left_semi").select("id", "label").distinct(), "rest-members")
    sets = map_texts(texts.join(asked.select("id"), "id"), _sets, ("id",), "s array<bigint>")
    # Rows of one id may have different texts, so a set is told by its id and its hash.
    sets = sets.withColumn("v", F.xxhash64("s")).dropDuplicates(["id", "v"])
    every = write_through(sets.select("id", "v", F.size("s").alias("size"), F.explode("s").alias("h")), "rest-shingles")
    often = every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    # Places are counted among all of a set's shingles; those that nobody shares come first.
    shared = every.join(often, "h").groupBy("id", "v", "size").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    alone = F.col("size") - F.size("s")
    prefix = F.col("size") - F.ceil(F.col("size") * least / 100) + 1 - alone
    tokens = shared.where(prefix > 0).select("id", "size", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("at", "t"))
    tokens = tokens.select("id", "size", (F.col("alone") + F.col("at")).alias("at"), F.col("t.h").alias("h")).join(asked, "id")
    tokens = write_through(tokens, "rest-tokens")
    per = tokens.groupBy("h", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels"))
    tokens = tokens.join(main.where("labels > 1").drop("labels"), "h")
    out = tokens.where("label <> main").select(
        "h", F.col("id").alias("o"), F.col("label").alias("lo"), F.col("size").alias("o_size"), F.col("at").alias("o_at")
    )
    # If a pair's first common shingle stands at such places, nothing before them is in the intersection;
    # later common ones may fail this test, as the pair is found at the first.
    most = F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at"))
    fits = most * 100 >= (F.col("size") + F.col("o_size") - most) * least
    met = tokens.join(out, "h").where("label <> lo and (label = main or o < id)").where(fits)
    pairs = met.select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")
