"""The dealt operators against brute force, round trips and edge rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from etaforge.llm import langid, phrases, pii, records, shards, superminhash, tiling, toxicity, viterbi
from etaforge.llm.queries import tokenizer_file

DDL = "doc_id long, text string, shard string, label string, lang string"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, "one two three four five six seven"),
    (2, "one two three four five six seven"),
    (3, None),
    (4, ""),
    (5, "Mail anna@site.org or +1 (743) 555-3824, card 4785380592391139."),
    (6, "again ANNA@SITE.ORG and anna@site.org; 152.143.123.131"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "  two  blanks ▁ sign \n\n end "),
    (None, "no id"),
    (10, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "l", None) for i, t in ROWS], DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_records_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    files = records.write_records(docs, tokenizer_file("byte_bpe_50k.json"))
    got = sorted(records.read_records(files).collect(), key=lambda r: r["record"])
    start = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, t) in zip(got, order, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), crc)
        start += len(ids)
    picked = records.read_at(files, docs.sparkSession.createDataFrame([(1,), (7,)], "record long"))
    for r in picked.collect():
        assert r["ids"] == tok.encode(order[r["record"]][1] or "", add_special_tokens=False).ids + [2]


def test_added_tokens_as_plain_encode_gives_them(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ["one<|endoftext|> two", "a <|endoftext|>", "x <|endoftext|>  y<|endoftext|>\nz", "after"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = records.write_records(df, tokenizer_file("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in records.read_records(files).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        assert 50256 in ids or "<|" not in t
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc)
        start += len(ids)


def test_broken_record_raises():
    record = bytearray(records.frame(b"\1\0\0\0"))
    assert records.unframe(bytes(record)) == b"\1\0\0\0"
    record[13] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(record))


def test_shards_are_contiguous_and_gapless(docs):
    got = sorted(shards.byte_shards(docs, 3).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in ROWS)
    for s in {r["shard"] for r in got}:
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))


def test_superminhash_estimates_and_orders():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = superminhash.superminhash(base[:600]), superminhash.superminhash(base[300:])
    assert abs((a == b).mean() - 1 / 3) < 0.15
    assert (superminhash.superminhash(base[:600][::-1]) == a).all()


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = {}
    for g in range(8):
        words = [f"w{g}x{k}" for k in range(120)]
        for i in range(30 if g == 0 else 4):
            changed = list(words)
            for k in rng.integers(0, 120, i % 3):
                changed[k] = f"new{rng.integers(1e6)}"
            texts[g * 100 + i] = " ".join(changed)
    df = spark.createDataFrame([*texts.items(), (5000, None), (5001, " \t"), (5002, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in superminhash.near_components(df).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in range(12):
        for a, b in itertools.combinations(texts, 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    assert {i: got[i]["component_id"] for i in texts} == root
    assert [got[i]["n_shingles"] for i in (5000, 5001, 5002)] == [0, 0, 1]
    assert all(got[i]["kept"] for i in (5000, 5001, 5002))


def test_pipeline_drops_near_copies_from_080_on(spark):
    import corpus_pipeline

    # 100 runs of five words; words added at the end make as many runs of their own.
    base = [f"w{k}" for k in range(104)]
    more = {2: 24, 3: 26}  # similarity 100/124 = 0.806 and 100/126 = 0.794
    rows = [(1, " ".join(base))] + [(i, " ".join([*base, *(f"x{i}y{k}" for k in range(n))])) for i, n in more.items()]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 3]


def test_tiling_finds_reordered_passages(spark):
    item = " ".join(f"q{k}" for k in range(40))
    moved = " ".join([f"q{k}" for k in range(20, 40)] + ["between"] + [f"q{k}" for k in range(20)])
    df = spark.createDataFrame([(1, f"a b {moved} c"), (2, "q1 q2 q3 q4 q5 only"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (7, item), (None, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in tiling.contamination(df, items).collect()}
    assert (got[1]["best_item"], got[1]["best_coverage"]) == (7, 1.0)
    assert not any(got[i]["contaminated"] for i in (2, 3, 4))
    assert not tiling.contamination(df, items.limit(0)).where("contaminated").count()


def test_surrogates_keep_type_and_coreference(docs):
    got = {r["doc_id"]: r for r in pii.replace_pii(docs).collect()}
    assert len(got) == len(ROWS) and got[3]["text"] is None and got[4]["text"] == ""
    assert got[5]["n_pii"] == 3 and got[6]["n_pii"] == 3
    assert not any(x in got[5]["text"] for x in ("anna@", "743", "4785380592391139"))
    mail = got[5]["text"].split()[1]
    assert got[6]["text"].split()[1] == mail.upper() and got[6]["text"].split()[3] == mail + ";"
    assert got[7]["text"] == LONG + ""


def test_hex_secrets_of_any_case(spark):
    low = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    mixed = "".join(c.upper() if k % 2 else c for k, c in enumerate(low))
    clear = "ABCDEFABCDEFABCDEFABCDEFABCDEFAB"  # no digit: a word, not a key
    df = spark.createDataFrame([(1, f'TOKEN = "{low.upper()}"'), (2, f"a {low} b {mixed}"), (3, clear)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(df).collect()}
    assert [got[i]["n_pii"] for i in (1, 2, 3)] == [1, 2, 0] and got[3]["text"] == clear
    upper, (_, lower, _, mix) = got[1]["text"].split('"')[1], got[2]["text"].split(" ")
    assert upper == lower.upper() == mix.upper() and lower == lower.lower() != low
    assert len(lower) == len(low) and set(lower) <= set("0123456789abcdef")
    assert all(not c.isupper() for c, v in zip(mix, mixed, strict=True) if not v.isupper())


def test_names_keep_parts_script_and_mentions(spark):
    texts = [
        "Mr John Smith came. Smith agreed; John Smith's car, SMITH. Smithson stayed.",
        "Mr Smith left, and Smith@site.org wrote.",
        "Dr. Anne-Marie Smith and Mr John Paul Smith; Prof. Dr. O'Brien; Herr Jan van der Berg.",
        "Господин Иван Петров пришёл. Петров и г-жа Петрова.",
        "Κύριος Νίκος Παππάς ήρθε. Παππάς, κ. Παππάς.",
        "Smith alone has no title here.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace_pii(df).collect()}
    assert got[5] == texts[5] and "Smithson stayed." in got[0]
    given, last = got[0].split()[1:3]
    last = last if not last.endswith(".") else last[:-1]
    assert got[0] == f"Mr {given} {last} came. {last} agreed; {given} {last}'s car, {last.upper()}. Smithson stayed."
    assert got[1].startswith(f"Mr {last} left, and user") and "Smith" not in got[1]
    assert got[2].count(f" {last}") == 2 and f"Mr {given} " in got[2]
    assert not any(x in got[2] for x in ("Anne", "Marie", "Paul ", "Smith", "Brien", "Jan ", "Berg"))
    assert not any(x in got[3] for x in ("Петров", "Иван ")) and not any("a" <= c <= "z" for c in got[3].lower())
    assert not any(x in got[4] for x in ("Παππάς", "Νίκος")) and not any("a" <= c <= "z" for c in got[4].lower())
    greek = got[4].split()[2]
    assert got[4].count(greek) == 3


def test_many_given_names_differ(spark):
    texts = [f"Mr {a}{b} Smith" for a in ("Ab", "Ec", "Id", "Of", "Ug") for b in ("an", "en", "in", "on", "un", "ar", "er", "ir")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in pii.replace_pii(df).collect()]
    assert len(set(got)) == 40 and len({t.split(" ")[-1] for t in got}) == 1


def full_viterbi(p, signs):
    best = [(0.0, ())]
    for end in range(1, len(signs) + 1):
        best.append(max(((best[s][0] + c, best[s][1] + ids) for s, c, ids in p.edges(signs, end)), key=lambda x: x[0]))
    return list(best[-1][1])


def test_tiling_in_blocks_with_items_of_null_id(spark, monkeypatch):
    item = {c: " ".join(f"{c}{k}é" for k in range(20)) for c in "abcd"}
    docs = [(1, item["a"]), (2, item["b"] + " " + item["c"]), (3, item["d"] + " " + item["a"]), (None, item["c"]), (5, "nothing of these"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, item["a"]), (None, item["b"]), (None, item["c"]), (9, item["d"]), (9, item["d"])], "item_id long, text string")
    size = len(item["a"].encode())
    expected = {1: (True, 1, 7, 1.0), 2: (True, 2, None, 1.0), 3: (True, 2, 7, 1.0), None: (True, 1, None, 1.0), 5: (False, 0, None, None), 6: (False, 0, None, None)}
    assert [len(b) for b in tiling._blocks(items.distinct(), 2 * size - 1)] == [1, 1, 1, 1]  # bytes, not signs
    for most in (1, 2 * size, 64_000_000):
        monkeypatch.setattr(tiling, "BLOCK_BYTES", most)
        got = tiling.contamination(df, items).collect()
        assert {r["doc_id"]: (r["contaminated"], r["n_items"], r["best_item"], r["best_coverage"]) for r in got} == expected


@pytest.mark.parametrize("text", ["hello world", "thantionsh erebleou", "  a ▁ b\n\n", "é中𝄞x", "a" * 200, "▁"])
def test_streaming_viterbi(text):
    p = viterbi.pieces(tokenizer_file("piece_bpe_32k.model"))
    signs = viterbi.to_signs(text)
    v = viterbi.StreamingViterbi(p)
    streamed = [i for c in signs for i in v.feed(c)] + v.finish()
    assert streamed == full_viterbi(p, signs) == viterbi.encode_text(p, text)
    assert viterbi.decode_ids(p, streamed) == text
    counts = viterbi.counts_by_trie(p, viterbi.words_of(text))
    assert sum(counts[w] for w in viterbi.words_of(text)) == len(streamed)


def test_phrases(docs):
    assert phrases.parse("aababc") == {"a", "ab", "abc"}
    got = {r["doc_id"]: r for r in phrases.edited_fingerprints(docs).collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) - len(t) // 2
        edited = t[:cut] + nxt[: len(t) // 2]
        sig = phrases.signature(phrases.parse(t))
        assert got[i]["edited_sha256"] == phrases.hash_text(edited)
        assert got[i]["fingerprint"] == phrases.hexed(sig)
        assert got[i]["edited_fingerprint"] == phrases.hexed(phrases.signature(phrases.parse(edited)))
        assert got[i]["near_next"] == phrases.likeness(sig, phrases.signature(phrases.parse(nxt)))


def test_language_filters(spark):
    rows = [(i, f"the and of thing {i}", "en") for i in range(40)] + [(100 + i, "der und die ungen keit", "de") for i in range(40)]
    df = spark.createDataFrame([*rows, (500, None, "en"), (501, "123", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(df, langid.learn(df)).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und"


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 30)) + (" vilebad" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(1, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels)).collect()
    assert len(got) == 402
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 900]) > 0.9


def test_toxicity_trains_on_every_labelled_row(spark):
    """Several parts are all fitted and counted, not only as many rows as one part holds."""
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, 30)) + (f" vile{i % 16}" if i % 4 == 0 else ""), "en") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, rows=200)
    used = df.where(~toxicity.held_out("doc_id")).count()
    assert used > 600  # at least four parts
    got = toxicity.score(df, model).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"]]) > 0.9
    rare = [(i, "plain words here" + (" hideous" if i % 4 == 0 else "")) for i in range(400)]
    late = spark.createDataFrame(rare, "doc_id long, text string")
    counts = []
    toxicity._start, kept = lambda df, *rest: counts.append(df) or kept(df, *rest), toxicity._start
    try:
        toxicity.fit(late, labels.where("doc_id < 400"), rows=40)
    finally:
        toxicity._start = kept
    fitted = late.where(~toxicity.held_out("doc_id") & (F.col("doc_id") % 4 == 0)).count()
    word = toxicity.word_buckets(["hideous"], 1 << 17)[0, 0]
    assert 0.75 * fitted < counts[0][1, word] <= fitted and counts[0][0, word] == 0


def test_toxicity_parts_are_stored_in_chunks(spark):
    """A part has a partition of its own and is kept in rows of bounded size, so no task holds several whole parts."""
    from glob import glob

    from etaforge.session import shared_root

    rows = [(i, f"plain words number {i % 90} here" + (" vile" if i % 4 == 0 else ""), "en") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    before = set(glob(f"{shared_root(spark)}/parts-*"))
    toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")), rows=2000)
    (folder,) = set(glob(f"{shared_root(spark)}/parts-*")) - before
    stored = spark.read.parquet(folder)
    chunks = [(r["f"], toxicity.pickle.loads(r["packed"])) for r in stored.where("packed is not null").withColumn("f", F.input_file_name()).collect()]
    assert sum(len(c.y) for _, c in chunks) == df.where(~toxicity.held_out("doc_id")).count()
    assert all(len(c.y) <= toxicity.CHUNK_ROWS for _, c in chunks)
    assert len({f for f, _ in chunks}) == len({c.part for _, c in chunks}) == len({(f, c.part) for f, c in chunks}) > 1
    assert {r["lang"] for r in stored.where("gram is not null").collect()} == {"en"}


def test_toxicity_scores_are_those_of_every_window():
    rng = np.random.default_rng(2)
    model = toxicity._start(rng.random((2, 1000)), 5.0, 5.0, 5.0, 5.0, rng, 12, (1, 2, 3), 8)
    texts = ["", None, "one", "one two", "three one two", *(" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (40, 8194, 8195, 30_000))]
    got = model.scores(texts)["score"]
    assert np.array_equal(got, np.concatenate([model.scores([t])["score"] for t in texts]))
    for text, have in zip(texts, got, strict=True):
        words = toxicity.TOKEN.findall(text or "")
        vectors, out = np.zeros((max(len(words), 3), 12), np.float32), []
        if words:
            vectors[: len(words)] = model.word_vectors(words)
        for w, f in model.filters.items():
            places = range(max(1, len(words) - w + 1))
            out.append(np.max([vectors[at : at + w].ravel() @ f for at in places], axis=0) + model.bias[w])
        z = np.maximum(np.concatenate(out), 0) @ model.out + model.out_bias
        assert abs(have - 1 / (1 + np.exp(-z))) < 1e-5


def test_toxicity_without_usable_labels(spark, docs):
    ids = [i for i, _ in ROWS if i is not None]
    held = [r["doc_id"] for r in docs.where(toxicity.held_out("doc_id")).select("doc_id").collect()]
    free = [i for i in ids if i not in held and i != 3]
    for labels in ([], [(i, None) for i in ids], [(i, 1) for i in held], [(i, 1) for i in range(1000, 1040)], [(free[0], 0)]):
        got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
        assert len(got) == len(ROWS) and all(r["predicted"] == 0 and r["score"] < 0.5 for r in got)
    absent = [(i, 1) for i in range(1000, 1400)] + [(i, int(i == free[0])) for i in free]
    few = toxicity.fit(docs, spark.createDataFrame(absent, "doc_id long, toxic int"), rows=len(free))
    assert few.out_bias < 0 and few.out.any()  # trained on both classes of labelled documents, not on none


def test_drop_toxic_goes_by_row(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"plain words number {i} here" + (" vilebad" if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    more = [(None, "plain words vilebad here", None, None, None), (None, "plain words here", None, None, None), (1000, "plain words vilebad here", "en", "s", 1), (1000, "plain words number 2 here", "en", "s", 1)]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    left = got.collect()
    assert not [r for r in left if "vilebad" in r["text"]]
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [*(i for i in range(400) if i % 4), 1000]
    assert [r["text"] for r in left if r["doc_id"] is None] == ["plain words here"]


def test_empty_tables(none):
    assert shards.byte_shards(none).count() == 0
    assert records.read_records(records.write_records(none, tokenizer_file("byte_bpe_50k.json"))).count() == 0
    assert superminhash.near_components(none).count() == 0
    assert pii.replace_pii(none).count() == 0
    assert phrases.edited_fingerprints(none).count() == 0
    assert langid.predict(none, langid.learn(none)).count() == 0
