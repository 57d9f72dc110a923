"""Streaming decoder and trie counts against a search over the whole text, in memory and over tables."""

import random

import pytest

from etaforge.llm import common, viterbi
from etaforge.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
PARTS = ["a", "e", "th", "ing", " ", "  ", "▁", "", "é", "中", "𝄞", "\n", "tion", "the", "0", "x"]


def whole_search(p, text):
    """Ids of the best segmentation, with all places of the text held."""
    if not text:
        return []
    signs = viterbi.to_signs(text)
    best = [(0, 0, ())]
    for end in range(1, len(signs) + 1):
        best.append(max(((best[s][0] + c, s, ids) for s, c, ids in p.edges(signs, end)), key=lambda x: x[0]))
    out, end = [], len(signs)
    while end:
        _, end, ids = best[end]
        out += reversed(ids)
    return out[::-1]


@pytest.fixture(scope="module")
def pieces():
    return viterbi.pieces(MODEL)


def random_text(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_chunks_of_any_size_give_the_ids_of_the_whole(pieces):
    rng = random.Random(5)
    for _ in range(300):
        text = random_text(rng, rng.choice([1, 3, 40, 150]))
        signs, decoder, got, at = viterbi.to_signs(text), viterbi.StreamingViterbi(pieces), [], 0
        while at < len(signs):
            size = rng.choice([1, 2, 7, 50])
            got += decoder.feed(signs[at : at + size])
            at += size
        got += decoder.finish()
        assert got == whole_search(pieces, text) == viterbi.encode_text(pieces, text)
        assert viterbi.decode_ids(pieces, got) == text


def test_window_stays_bounded_without_blanks(pieces):
    text = "".join(random.Random(3).choice("aethionsr") for _ in range(30_000))
    decoder, widest, ids = viterbi.StreamingViterbi(pieces), 0, []
    for at, sign in enumerate(viterbi.to_signs(text)):
        ids += decoder.feed(sign)
        widest = max(widest, len(decoder.back))
        assert all(len(decoder.back) - 1 - place < pieces.longest for place, _, _ in decoder.open), at
    assert widest < 4 * pieces.longest
    assert len(ids) > 10_000  # committed on the way, not at the end
    assert viterbi.decode_ids(pieces, ids + decoder.finish()) == text


def test_pieces_over_blanks_need_no_other_route():
    """With a piece that goes on over a blank no place before a blank is certain, and nothing is remembered."""
    import re

    other = viterbi.Pieces(MODEL)
    other.ids["a▁t"] = (0, 5)
    node = other.trie["a"][0].setdefault("▁", [{}, None, ()])
    node[0]["t"] = [{}, 0, (5,)]
    other.runs, other.memo = re.compile(r"(?s).+"), None
    used = set()
    for text in ("a t a that", "data to a t", "xqa txq", "ba tha t"):
        got = viterbi.encode_text(other, text)
        assert got == whole_search(other, text)
        used.update(got)
    assert 5 in used


def test_memo_is_cleared_and_changes_nothing(pieces, monkeypatch):
    rng = random.Random(9)
    texts = [random_text(rng, 60) for _ in range(40)]
    monkeypatch.setattr(viterbi, "MEMO_SIGNS", 30)
    small = viterbi.Pieces(MODEL)
    assert [viterbi.encode_text(small, t) for t in texts] == [whole_search(pieces, t) for t in texts]
    assert sum(map(len, small.memo)) < 30 + 2 * max(map(len, small.memo))


def rows(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "hello world", "hello world", random_text(rng, 300), "x" * 5000, "ab " * 3000 + "\n", random_text(rng, 20_000)]
    data = [(None if k == 3 else k // 2, t, k, "t", "u") for k, t in enumerate(texts)]
    return texts, spark.createDataFrame(data, "doc_id long, text string, ids int, _text string, decoded string")


def test_encode_table(spark, pieces):
    texts, docs = rows(spark)
    got = viterbi.encode(docs.withColumnRenamed("ids", "row"), MODEL, ("row", "doc_id", "text", "_text")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["text"] == texts[r["row"]] == r["decoded"] and r["_text"] == "t"
        assert r["ids"] == whole_search(pieces, r["text"])
    assert viterbi.encode(docs.limit(0), MODEL).count() == 0


def test_token_counts_table(spark, pieces):
    texts, docs = rows(spark)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_words"], r["n_tokens"]) for r in viterbi.token_counts(docs, MODEL).where("doc_id is not null").collect())
    want = sorted(
        (True, k // 2, len(viterbi.words_of(t)) if t else 0, len(whole_search(pieces, t))) for k, t in enumerate(texts) if k != 3
    )
    assert got == want
    assert viterbi.token_counts(docs, MODEL).where("doc_id is null").count() == 1
    assert viterbi.token_counts(docs.limit(0), MODEL).count() == 0


def test_counts_follow_the_trie_and_look_up_no_slices():
    p = viterbi.pieces(tokenizer_file("piece_bpe_32k.model"))
    words = [w for t in ["counted counting count", "été \U0001f600x naïve▁", "  a", "xq" * 40, "a\ue000b"] for w in viterbi.words_of(t)]
    want = {}
    for w in set(words):
        v = viterbi.StreamingViterbi(p)
        want[w] = len(v.feed(w, end=True))

    def no_slices(*_):
        raise AssertionError("a slice of the word was looked up")

    p.edges = no_slices
    try:
        assert viterbi.counts_by_trie(p, words) == want
    finally:
        del p.edges


def test_another_operator_drops_what_the_decoder_kept(spark, pieces):
    docs = spark.range(64).selectExpr("id as doc_id", "concat('word', id, ' and another') as text").repartition(8)
    viterbi.encode(docs, MODEL).count()
    viterbi.token_counts(docs, MODEL).count()

    def left(texts):
        from etaforge.llm import common, viterbi

        return {"n": [len(viterbi._MODELS) + len(viterbi._COUNTS) + len(common.HASHES)] * len(texts)}

    assert {r["n"] for r in common.map_texts(docs, left, ("doc_id",), "n int").collect()} == {0}
    assert viterbi.encode(docs, MODEL, ("doc_id", "text")).where("decoded = text").count() == 64


def test_texts_come_in_small_batches(spark):
    docs = spark.range(0, 5_000, 1, 1).selectExpr("id as doc_id", "'x' as text")

    def sizes(texts):
        import sys

        return {"n": [sys._getframe(1).f_locals["batch"].num_rows] * len(texts)}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert max(r["n"] for r in common.map_texts(docs, sizes, ("doc_id",), "n int").collect()) <= 1_024
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        assert max(r["n"] for r in common.map_texts(docs, sizes, ("doc_id",), "n int").collect()) == 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
