"""Near-duplicate components on planted groups against all pairs."""

import random

import pytest

from etaforge.llm import superminhash


def brute_components(rows, least):
    sets = {i: set(superminhash.shingles(t).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def edited(words, edits, pick, letters):
    out = list(words)
    for at in pick.sample(range(len(out)), edits):
        out[at] = letters()
    return " ".join(out)


@pytest.mark.parametrize(("least", "own_words"), [(85, True), (85, False), (80, False)])
def test_hot_template_with_edits_of_all_degrees(spark, least, own_words):
    """A third of the rows copy one template with many edits, near the threshold and far from it; new
    words are each row's own, or from a small set that many rows share."""
    pick = random.Random(least + own_words)
    template = [f"t{i}" for i in range(120)]
    new = (lambda: f"w{pick.randrange(10**9)}") if own_words else (lambda: f"w{pick.randrange(8)}")
    rows = [(i, edited(template, pick.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8]), pick, new)) for i in range(160)]
    rows += [(1000 + i, " ".join(f"x{pick.randrange(40)}" for _ in range(80))) for i in range(60)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(2000 + i, " ".join(chain[i * 6 : i * 6 + 90])) for i in range(16)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_components(df, least=least).collect()}
    assert got == brute_components(rows, least)


def test_rest_pairs_hold_every_link_of_their_sets(spark):
    """Prefixes of rarest shingles lose no pair, whatever the labels, and repeat no tested one."""
    pick = random.Random(6)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, edited(template, pick.randrange(4), pick, lambda: f"w{pick.randrange(5)}")) for i in range(80)]
    rows = list({t: (i, t) for i, t in rows}.values())
    texts = spark.createDataFrame(rows, "id long, text string")
    members = spark.createDataFrame([(7, i, 3) for i, _ in rows], "slot long, id long, n long")
    labels = spark.createDataFrame([(i, i % 9) for i, _ in rows], "id long, label long")
    tested = spark.createDataFrame([(rows[0][0], rows[1][0])], "a long, b long")
    got = {(r["a"], r["b"]) for r in superminhash.rest_pairs(members, labels, tested, texts, 85).collect()}
    sets = {i: set(superminhash.shingles(t).tolist()) for i, t in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and a % 9 != b % 9 and 100 * len(x & y) >= 85 * len(x | y) and (a, b) != (rows[0][0], rows[1][0]):
                assert (a, b) in got
    assert (rows[0][0], rows[1][0]) not in got and all(a < b for a, b in got)


def test_sketches_of_linked_sets_pass_the_floor():
    """1,000 pairs of sets at the threshold: none agrees in fewer places than the floor."""
    import numpy as np

    rng = np.random.default_rng(1)
    floor, low = superminhash.sketch_floor(85), 120
    for _ in range(1000):
        both, own = rng.integers(0, 2**63, 340, dtype=np.uint64), rng.integers(0, 2**63, 60, dtype=np.uint64)
        x, y = (superminhash.superminhash(np.concatenate([both, part])) for part in (own[:30], own[30:]))
        low = min(low, int((x == y).sum()))
    assert 120 * 0.5 < floor <= low


def test_repeated_ids_and_clashing_names(spark):
    text = " ".join(f"a{i}" for i in range(50))
    rows = [(1, text, 1, "x", 3)] * 3 + [(1, "quite another text of some words here", 1, "x", 3), (2, text + " b", 1, "y", 3), (None, text, 1, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, slot string, n long")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in superminhash.near_components(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True)] * 4 + [(2, 1, False), (None, None, True)], key=str)
