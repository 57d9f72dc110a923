"""Importance resampling, rank-queue BPE and spelling variants against brute force and edge rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import pytest

from etaforge.llm import importance, rankqueue, spelling
from etaforge.llm.queries import tokenizer_file

DDL = "doc_id long, text string, score string, rank string, _row string, n string, word string, _rank_text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu Nu XI omicron Pi2 42 Straße été".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in rows], DDL).repartition(3)


@pytest.fixture(scope="module")
def documents():
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(WORDS, k=pick.randint(0, 60)))) for i in range(120)]
    # null, empty, no word, one very long text, repeated rows of one id, rows without id, equal texts
    long = " ".join(pick.choices(WORDS, k=40_000))
    same = " ".join(WORDS * 2)
    return [*rows, (200, None), (201, ""), (202, " .,-"), (203, long), *[(300, same)] * 9, *[(None, same)] * 3, (301, same)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_importance(docs, target, longest=1, percent=10, least=20):
    def features(text):
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))
        return [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)], len(ws)

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[0]) for texts in ([x for _, x in docs], target))
    all_s, all_t = s.total(), t.total()

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))

    rows = []
    for i, text in docs:
        fs, n = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(fit[: len(fit) * percent // 100])]
    return drawn, collections.Counter(r[:4] for r in rows)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_resampling_is_brute_force(spark, documents, longest, percent):
    target = [" ".join(WORDS[:4] * 5), None, "", "Alpha 42"]
    texts = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = importance.resample(frame(spark, documents), texts, percent=percent, longest=longest).collect()
    drawn, every = brute_importance(documents, target, longest, percent)
    assert collections.Counter(tuple(r)[:4] for r in got) == every
    ranks = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [tuple(r) for r in ranks] == drawn


def test_resampling_of_empty_tables(spark, documents):
    none = frame(spark, [])
    assert importance.resample(none, frame(spark, documents)).collect() == []
    got = importance.resample(frame(spark, documents), none, percent=100).collect()
    drawn, every = brute_importance(documents, [], percent=100)
    assert len(got) == every.total() and sum(r["rank"] is not None for r in got) == len(drawn)
    assert importance.resample(frame(spark, [(1, None)]), none).collect() == [(1, 0, 0, got_score(1), None)]


def got_score(i):
    h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def test_checksums_of_matrices():
    pick = random.Random(1)
    features = [b"", *(pick.randbytes(pick.choice([1, 2, 3, 7, 8, 31, 500])) for _ in range(300))]
    assert importance.crc_of(features).tolist() == [zlib.crc32(f) for f in features]
    assert len(importance.crc_of([])) == 0


@pytest.fixture(scope="module")
def ranks():
    with open(tokenizer_file("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def reference_encoder(ranks):
    import base64

    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def awkward_texts():
    pick = random.Random(3)
    letters = "aabbeent ioürsñдаш 中文ñ0123'.,-\n\t  　é\U0001f600́"
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 80))) for _ in range(1500)]
    long = ["a" * 20_000, "ab" * 9_000, "".join(pick.choices("etaoin", k=30_000)), "\n" * 5_000, " " * 3_000 + "x", "9" * 4_000]
    return [*texts, *long, "I'll we've it's 'sooth", "<|endoftext|> x", "\x00\x01", "Привет, мир! Straße 東京"]


def test_rank_queue_is_the_reference_encoder(ranks):
    import public_tokenizers

    enc, own = reference_encoder(ranks), rankqueue.RankBpe(ranks, public_tokenizers.PATTERN)
    for text in awkward_texts():
        ids = own.encode(text)
        assert list(rankqueue.unpacked(ids)) == enc.encode_ordinary(text)
        assert own.decode(ids).decode() == text


def test_queue_gives_lowest_rank_and_leftmost_place():
    pick = random.Random(2)
    queue, held = rankqueue.RankQueue(50_000), []
    for _ in range(5_000):
        if held and pick.random() < 0.5:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            held.append((pick.choice([0, 1, 1023, 1024, 49_999, pick.randrange(50_000)]), pick.randrange(10**6)))
            queue.push(*held[-1])
    while held:
        assert queue.pop() == min(held)
        held.remove(min(held))
    assert queue.pop() == (-1, -1)


def test_encoded_rows(spark, ranks, documents):
    import public_tokenizers

    enc = reference_encoder(ranks)
    got = rankqueue.encode(frame(spark, documents), ranks, public_tokenizers.PATTERN, ("doc_id", "score")).collect()
    want = collections.Counter()
    for i, t in documents:
        ids = enc.encode_ordinary(t or "")
        want[(i, "x", struct.pack(f"<{len(ids)}I", *ids), (t or "").encode())] += 1
    assert collections.Counter((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in got) == want
    assert rankqueue.encode(frame(spark, []), ranks, public_tokenizers.PATTERN).collect() == []


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def random_words(n, letters, low, high, seed):
    pick = random.Random(seed)
    return sorted({"".join(pick.choices(letters, k=pick.randint(low, high))) for _ in range(n)})


@pytest.mark.parametrize(("letters", "low", "high"), [("ab", 1, 7), ("abc", 3, 6), ("aé", 7, 10), ("abcdefgh", 2, 4)])
def test_sorted_scan_finds_all_near_words(letters, low, high):
    words = random_words(300, letters, low, high, len(letters))
    lcp = spelling.lcps(words)
    hop = spelling.hops(lcp)
    for i, w in enumerate(words):
        want = [j for j in range(i + 1, len(words)) if one_edit(w, words[j])]
        assert spelling.near_after(words, i, lcp, hop) == want


def test_near_pairs_are_each_found_once(spark):
    words = [w for args in (("ab", 5, 9), ("abcé", 1, 6), ("xyz", 7, 8)) for w in random_words(400, *args, 9)]
    df = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(set(words)))], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df).collect()]
    want = [p for p in itertools.combinations(sorted(set(words)), 2) if one_edit(*p)]
    assert sorted(got) == sorted(want)


def brute_variants(docs):
    counts = collections.Counter()
    for i, text in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = lowered(r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            counts[r if h % 31 else r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in kept if one_edit(w, v)] for w in kept}
    best = {w: min(vs, key=lambda v: (-kept[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if kept[v] >= 10 * kept[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), kept.get(form.get(w))) for w, n in kept.items()}


def test_variants_are_brute_force(spark):
    pick = random.Random(8)
    base = random_words(25, "abcdeé", 7, 11, 4) + ["ÀÉÎÕÜßÿ×÷", "SHORTER", "shorter", "Longwörd"]
    rows = [(i, " ".join(pick.choices(base, weights=range(1, len(base) + 1), k=300)) + ".short ab") for i in range(60)]
    # chains: each step ten times as frequent as the one before, ties of equal counts
    rows += [(100, "chainxxx " * 2), *[(101 + k, "chainxxy " * 10) for k in range(2)], *[(110 + k, "chainxyy " * 30) for k in range(8)]]
    rows += [(None, "chainyyy chainyyy"), (130, None), (131, ""), (132, "123 .-"), *[(133, "repeated rowsrow")] * 3]
    got = {tuple(r) for r in spelling.variants(frame(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_variants(rows)
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] > 1 for r in want)


def test_variants_of_empty_and_wordless_tables(spark):
    assert spelling.variants(frame(spark, [])).collect() == []
    assert spelling.variants(frame(spark, [(1, None), (2, ""), (3, "few short words")])).collect() == []
