"""Packing, line dedup, language ID, BPE, sharding, media and the Jaccard join against brute force, and their edge cases."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import bpe, jaccard, langid, line_dedup, media, packing, sharding

WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a\n\nb\r\n", "x" * 5000, "The cat\tsat. " * 900, "日本語 é́ Σας İstanbul ß", "<|endoftext|>a <|startoftext|>", "\x1c\x85\xa0\u3000z", "don't WE'LL 12345 !!! \U0001f600", "a\x00b"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"id": F.lit("clash"), "key": F.lit(1), "c": F.lit(2.5)}) if extra else df


# BPE


def test_bpe_matches_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(docs(spark, ODD), BYTE), BYTE).select("doc_id", "ids", "decoded", bpe.n_ids().alias("n"), "key").collect()
    for r in got:
        want = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["n"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs(spark, ODD).limit(0), BYTE).count() == 0
    clash = bpe.encode(docs(spark, ODD), BYTE, into="key").collect()
    assert {r["_key"] for r in clash} == {1} and {r["doc_id"]: r["key"] for r in clash} == {r["doc_id"]: r["ids"] for r in got}
    with pytest.raises(ValueError):
        bpe.Codec(WORD)


@functools.cache
def encoders():
    return bpe.Codec(BYTE), Tokenizer.from_file(BYTE), packing.WordTokenizer(WORD)


@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=60) | st.text("ab \n't.", max_size=60) | st.text("aAéÉ  \n\t12'", max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoders_match_the_library(s):
    c, byte, words = encoders()
    assert np.frombuffer(c.encode(s), "<u4").tolist() == byte.encode(s, add_special_tokens=False).ids
    assert c.decode(c.encode(s)) == s
    assert words(s) == words.whole(s)


def test_every_token_is_its_own_encoding():
    c = bpe.codec(BYTE)
    assert all(c.encode_bytes(t) == [i] for i, t in list(enumerate(c.tokens))[::17])
    # Without the shortcut for whole tokens, the walk gives the same.
    known, c.by_bytes = c.by_bytes, {}
    try:
        assert all(c.encode_bytes(c.tokens[i]) == [i] for i in range(300, len(c.tokens), 1013))
    finally:
        c.by_bytes = known


def test_decode_of_broken_ids():
    c = bpe.codec(BYTE)
    half = c.encode("日")[:4]
    assert "\ufffd" in c.decode(half) and c.decode(None) == "" and c.decode(np.array([10**6], "<u4").tobytes()) == ""


def test_pieces_stay_remembered_among_rare_ones():
    library, c, asked = Tokenizer.from_file(BYTE), bpe.Codec(BYTE, memo=40), []
    fn = c.encode_bytes
    c.encode_bytes = lambda p: asked.append(p) or fn(p)
    for i in range(400):
        text = f"The rare{chr(97 + i % 26)}{chr(97 + i // 26)} Été of,###  x{i}" + " ’日"[i % 3]
        assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(asked.count(w.encode()) == 1 for w in ("The", " Été", " of", ",###"))
    assert sum(len(m) + len(m.new) + len(m.before) for m in (c.of_piece, c.of_chunk)) <= 80


def test_plain_byte_pieces_of_every_pair_of_characters():
    library, c = Tokenizer.from_file(BYTE), bpe.codec(BYTE)
    plain = list(map(chr, range(0x250)))
    for a in plain:
        text = " ".join(f"{a}{b}{a}" for b in plain)
        assert not bpe.ODD.search(text) and c.plain_pieces.findall(text) == c.pieces.findall(text)
    text = "".join(f"{a} {b}" for a, b in zip(plain, plain[::-1], strict=True))
    assert np.frombuffer(c.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


# Packing


def test_words_stay_remembered_among_rare_ones():
    library, words, asked = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD, memo=64), []
    fn = words.memo.fn
    words.memo.fn = lambda k: asked.append(k) or fn(k)
    marks = [".", ",", "!!", ",###", "'s", "", "'", " 4.0"]
    for i in range(400):
        text = f"The{marks[i % 8]} rare{chr(97 + i % 26)}{chr(97 + i // 26)} Été of{marks[-i % 8]} x{i}"
        assert np.frombuffer(words(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(asked.count(w) == 1 for w in ("the", "été", "of", ",###"))
    assert len(words.memo) + len(words.memo.new) + len(words.memo.before) <= 64


def test_plain_pieces_of_every_pair_of_characters():
    words = packing.WordTokenizer(WORD)
    plain = [c for i in range(0x250) if not packing.ODD.search(c := chr(i))]
    for c in plain:
        text = " ".join(f"{c}{d}{c}" for d in plain)
        assert words.known and words(text) == words.whole(text)
    words.known = False
    assert words("It's 10.5") == words.whole("It's 10.5")


def check_packing(rows, want):
    docs_, seqs = {}, {}
    for r in rows:
        docs_.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(docs_[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == rs[0]["tier"] and at & (at - 1) == 0 and at <= 2048


def test_packing(spark):
    library = Tokenizer.from_file(WORD)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["the", "river", "Einstein,", "zug"]) for _ in range(rng.randint(1, 1500))) for _ in range(150)]
    rows = packing.pack(docs(spark, texts).repartition(3), WORD, buffer_tokens=30_000).collect()
    check_packing(rows, {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)})
    groups = {}
    for r in rows:
        groups.setdefault((r["step_group"], r["tier"]), set()).add(r["sequence_id"])
    assert all(len(s) * tier <= 32_768 for (_, tier), s in groups.items()) and len({g for g, _ in groups}) == len(groups)
    assert packing.pack(docs(spark, texts).limit(0), WORD).count() == 0


@given(st.lists(st.integers(1, 6000), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packer_fills_every_sequence(sizes):
    out = []
    p = packing.Packer((256, 512, 1024, 2048), lambda tier, pieces: out.append((tier, pieces)))
    for k, n in enumerate(sizes):
        p.add(k, n)
    p.finish()
    assert sum(t for t, _ in out) == sum(sizes) and all(sum(x[0] for x in ps) == t and t & (t - 1) == 0 for t, ps in out)
    assert sorted((k, s + i) for _, ps in out for n, k, s in ps for i in range(n)) == [(k, i) for k, n in enumerate(sizes) for i in range(n)]
    assert len(packing.step_groups(out, 4096)) == len(out)


# Line dedup


def brute_lines(texts, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    split = [(t or "").split("\n") for t in texts]
    seen = {}
    for i, ls in enumerate(split):
        for k in {key(x) for x in ls}:
            seen.setdefault(k, set()).add(i)
    out = []
    for ls in split:
        kept = [x for x in ls if not key(x) or len(seen[key(x)]) < min_docs]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = [" Common Line ", "É é", "éÉ", "x", "", "\t", "Rare"] + [f"line {i}" for i in range(40)]
    texts = [*ODD, "x\nx\nx", "x", *["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(60)], *["copy\nof it"] * 15, "\n".join(f"l{i}" for i in range(3000)) + "\nx"]
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df, min_docs=5).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts, 5)
    out = line_dedup.dedup_lines(df.limit(0))
    assert out.count() == 0 and out.columns == [*df.columns, "n_lines", "n_dropped"]
    clash = line_dedup.dedup_lines(df.withColumns({"n_lines": F.lit(-1), "_whole": F.lit("w"), "_drops": F.lit("d")}), min_docs=5)
    assert {(r["_n_lines"], r["_whole"], r["_drops"]) for r in clash.collect()} == {(-1, "w", "d")}
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in clash.collect()} == got
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("wordloom_run_")]


def test_runs_add_up_over_batches(spark, tmp_path):
    runs = line_dedup.Runs(spark, str(tmp_path), 4, 2)
    for b in range(5):
        runs.add(spark.createDataFrame([("a", 1), (f"k{b}", 3), ("b", 2), ("e", 9 if b == 0 else 1)], "key string, n long"))
    assert {r[0] for r in runs.close().collect()} == {"a", "b", "e"}
    assert max(len(x) for x in runs.levels) <= 2


# Language ID


def test_forward_sums_all_segmentations():
    pieces = ("a", "ab", "b", "ba", "▁", "▁a")
    p = np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2], [0.0]])
    alpha = langid.forward(langid.Trie(pieces).spans(["▁aba"]), p)

    def brute(s):
        return 1.0 if not s else sum(p[i, 0] * brute(s[len(x) :]) for i, x in enumerate(pieces) if s.startswith(x))

    assert alpha[-1, 0, 0] == pytest.approx(brute("▁aba"), rel=1e-4)
    counts = langid.expected(langid.Trie(pieces).spans(["▁aba"]), p, np.array([2.0]))
    assert sum(counts[i] * len(x) for i, x in enumerate(pieces)) == pytest.approx(8, rel=1e-3)  # all letters are covered twice


def test_language_id(spark):
    rng = random.Random(5)
    words = {"en": "the and water stone river house light".split(), "de": "der und wasser stein fluss haus licht über".split(), "fr": "le et eau pierre rivière maison lumière".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 3 <> 1 or doc_id % 2 = 0"), PIECE)
    got = {r["doc_id"]: r for r in langid.predict(df.withColumn("key", F.lit(0)), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs(spark, [*ODD, "123 !?", "the river", "the river"], extra=False).drop("lang"), model).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (0, 1, 2, 3, 12)) and odd[13] == odd[14] and odd[13][0] == "en" and odd[5][0] in words
    none = langid.fit(df.limit(0), PIECE)
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(df.withColumns({"score": F.lit("s"), "lang_pred": F.lit(3)}), none).collect()} == {("und", 0.0)}
    clash = langid.predict(df.withColumns({"score": F.lit("s"), "LANG_PRED": F.lit(3)}), model)
    assert clash.columns[-2:] == ["lang_pred", "score"] and {(r["_score"], r["_LANG_PRED"]) for r in clash.collect()} == {("s", 3)}
    assert langid.fit(df.withColumn("lang", F.lit(None).cast("string")), PIECE).languages == []
    assert langid.predict(df.limit(0), model).count() == 0


def test_posteriors_match_brute_force(spark):
    """lang_pred and score of real documents against sums over all segmentations, word by word, in plain Python."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), PIECE, per_language=20)
    at = {x: i for i, x in enumerate(model.pieces)}

    @functools.cache
    def log_word(word, k):
        u, alpha = "▁" + word, [1.0] + [0.0] * (len(word) + 1)
        for end in range(1, len(u) + 1):
            for start in range(end):
                q = model.p[at[u[start:end]], k] if u[start:end] in at else 0.0
                alpha[end] += alpha[start] * (max(q, langid.FLOOR) if end - start == 1 else q)
        return math.log(alpha[-1])

    for r in langid.predict(rows, model).collect():
        ws = langid.words_of(r["text"])[:10**9]
        totals = [sum(log_word(w, k) for w in ws) for k in range(len(model.languages))]
        best = max(range(len(totals)), key=lambda k: totals[k]) if ws else None
        assert r["lang_pred"] == ("und" if best is None else model.languages[best])
        assert r["score"] == pytest.approx(0.0 if best is None else 1 / sum(math.exp(t - totals[best]) for t in totals), abs=1e-6)


def test_long_words_are_not_cut():
    pieces = ("a", "ab", "abab", "b", "ba", "▁", "▁a")
    counts = {"x": {"abab": 5, "ba" * 18: 2}, "y": {"bb": 4, "a": 1}}
    model = langid.fit_counts(counts, pieces)
    words = ["ab" * 15, "ab" * 20, "ba" * 16 + "z", "q" * 34]
    for w, row in zip(words, model.log_words(words), strict=True):
        spans = model.trie.spans(["▁" + w])
        assert row == pytest.approx(np.log(langid.forward(spans, model.p)[-1, 0]), rel=1e-9)
    spans = model.trie.spans(["▁" + "ab" * 18])
    p = model.p[:, :1]
    assert langid.expected_long(spans[0], p, 3.0) == pytest.approx(langid.expected(spans, p, np.array([3.0])), rel=1e-6, abs=1e-12)
    endless = "abba" * 3000
    assert np.isfinite(model.log_words([endless])).all()
    stretch, langid.STRETCH = langid.STRETCH, 7
    try:
        assert model.log_words([words[2]]) == pytest.approx(np.log(langid.forward(model.trie.spans(["▁" + words[2]]), model.p)[-1]), rel=1e-9)
    finally:
        langid.STRETCH = stretch


def test_scorer_forgets_and_stays_the_same():
    model = langid.fit_counts({"a": {"aa": 5, "ab": 2}, "b": {"bb": 4}}, ("a", "ab", "b", "bb", "▁"))
    one, two = langid.Scorer(model), langid.Scorer(model, limit=2)
    texts = ["aa ab", "bb", "ab aa bb", None, "zz " * 50, "a" * 100]
    assert one.predict(texts) == ([*map(lambda t: two.predict([t])[0][0], texts)], [two.predict([t])[1][0] for t in texts])


# Sharding


def test_sharding(spark):
    rng = random.Random(6)
    texts = [*ODD, *["hot text " * 3] * 400, *["w " * rng.randint(0, 200) for _ in range(500)]]
    rows = sharding.shard(docs(spark, texts), shards=8).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size, slots, where = [0] * 8, {}, {}
    for r in rows:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body) and r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        where.setdefault(body, set()).add(r["shard"])
    assert max(size) - min(size) < 0.01 * sum(size) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(w) > 1 for w in where.values()) <= 25  # only groups over the grain are split
    again = sharding.shard(docs(spark, texts).repartition(5), shards=8).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shard(docs(spark, texts).limit(0)).count() == 0
    assert sharding.shard(docs(spark, [None, None]), shards=4).count() == 2
    odd = docs(spark, ["a", "a", None, "b" * 2_000_000, "c"]).withColumns({"doc_id": F.when(F.col("doc_id") > 1, 3).cast("long"), "shard": F.lit("s"), "_atom": F.lit(1), "size": F.lit(2)})
    got = sharding.shard(odd, shards=2).collect()
    assert sorted(r["size"] for r in got) == [16, 17, 17, 17, 2_000_016] and sorted(str(r["doc_id"]) for r in got) == ["3", "3", "3", "None", "None"]
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in (0, 1))


@given(st.lists(st.integers(1, 50), min_size=40, max_size=200), st.integers(2, 6))
@settings(max_examples=40, deadline=None)
def test_placement_is_even(sizes, shards):
    v = np.array([[s, s // 3, 1] for s in sizes], dtype=float)
    at = sharding.place(v, shards)
    load = np.bincount(at, weights=v[:, 0], minlength=shards)
    assert load.max() - load.min() <= 50


# Media


def test_media(spark):
    got = media.load(media.store(docs(spark, [*ODD, "x" * 5000])).select("doc_id", "n_bytes", "media", "key")).collect()
    by = {}
    for r in got:
        body = (([*ODD, "x" * 5000])[r["doc_id"]] or "").encode()
        want = body + b"\xff" * (-len(body) % 576 if body else 576)
        assert r["payload"] == want and r["n_bytes"] == len(body)
        by.setdefault(body, set()).add((r["feature"], bytes(r["media"])))
    assert all(len(v) == 1 for v in by.values())
    assert media.load(media.store(docs(spark, ODD).limit(0))).count() == 0
    clash = media.load(media.store(docs(spark, ODD).withColumns({"media": F.lit(1), "n_bytes": F.lit(2), "payload": F.lit(3), "feature": F.lit(4)})))
    assert {tuple(r[f"_{c}"] for c in ("media", "n_bytes", "payload", "feature")) for r in clash.collect()} == {(1, 2, 3, 4)}
    wide = b"ab" * (576 * 9000)
    assert media.to_payload(media.to_pixels(wide), len(wide)) == wide and media.to_pixels(wide).shape == (9000, 384)


def test_a_long_text_takes_bounded_memory():
    import tracemalloc

    from wordloom.llm import webp

    rng = np.random.default_rng(3)
    text = bytes(rng.choice(np.frombuffer(b"etaoin shrdlu", dtype=np.uint8), 2_000_000))
    tracemalloc.start()
    file = webp.encode_best(media.to_pixels(media.padded(text)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)
    assert media.to_payload(webp.decode_many([file])[0], len(text)) == text


# Jaccard join


def brute_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def edited(rng, words, share):
    return [rng.choice("abcdefghij") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family():
    """Families of near copies around the threshold, templates that share most of their text, copies and odd texts."""
    rng = random.Random(8)
    texts = list(ODD) + ["one", "one", "ONE", "a b c d e f g h i j k", "a b c d e f g h i j", "a b c d e f g h i j k l"]
    for size in (12, 30, 60, 150, 400):
        for _ in range(6):
            base = [f"w{rng.randint(0, 500)}" for _ in range(size)]
            texts += [" ".join(base)] * 2
            texts += [" ".join(edited(rng, base, s)) for s in (0.004, 0.01, 0.015, 0.02, 0.03, 0.05)]
    template = [f"t{i}" for i in range(160)]
    texts += [" ".join(template + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(10, 60))]) for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("n", "percent", "rounds"), [(3, 90, 3), (5, 80, 3), (3, 90, 0), (5, 80, 1)])
def test_jaccard_is_exact(spark, family, n, percent, rounds):
    rows = jaccard.classes(docs(spark, family), n, percent, rounds=rounds, block=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_classes(family, n, percent)


def meet(a, b, percent, frequent=jaccard.NONE):
    """Whether two sets share at least as many regions of a space as each of them has to."""
    mine, theirs = jaccard.region_tokens(a, percent, frequent), jaccard.region_tokens(b, percent, frequent)
    return any(len(set(t.tolist()) & set(u.tolist())) >= max(n, m) for n, t in mine for m, u in theirs)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_region(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(2, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = int(rng.integers(0, max(1, n // 6) + 1)), int(rng.integers(0, max(1, n // 6) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and (len(a) != both or len(b) != both):
            assert meet(a, b, percent)


def test_one_of_each(spark):
    df = docs(spark, ["a b c d e f"] * 3 + ["other words entirely here now ok", None, ""])
    kept = jaccard.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5] and kept.columns == df.columns
    assert jaccard.classes(df.limit(0)).count() == 0
    twice = docs(spark, ["a b c d e f g", "a b c d e f g", "x y z u v w", "x y z u v w"]).withColumns({"doc_id": F.when(F.col("doc_id") < 3, 7).otherwise(8).cast("long"), "root": F.lit(1), "_text": F.lit("t"), "_key": F.lit(2), "kept": F.lit(0)})
    kept = jaccard.one_of_each(twice).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(7, "a b c d e f g"), (7, "x y z u v w")]
    nulls = df.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert jaccard.one_of_each(nulls).count() == 6
    with pytest.raises(ValueError):
        jaccard.classes(df, percent=40)


def test_frequent_pivots_only_steer():
    """Any list of frequent pivots leaves linked sets a common region."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(20, 200)), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 12], rng.integers(0, 2**63, 1, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        tokens = np.unique(np.concatenate([t for t, *_ in jaccard._spaces(a, 80)]))
        some = np.sort(rng.permutation(tokens)[: len(tokens) // 2])
        frequent = some, rng.integers(64, 1000, len(some))
        assert meet(a, b, 80, frequent)


def test_counter_finds_frequent_pivots():
    rng, c = np.random.default_rng(0), jaccard.Counter()
    hot = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for _ in range(300):
        c.add(np.concatenate([rng.integers(0, 2**63, 5000, dtype=np.uint64), hot]))
    known, times = c.most()
    assert set(hot.tolist()) <= set(known.tolist()) and len(known) <= jaccard.FROM_TASK and len(c.known) <= jaccard.COUNTED
    assert all(times[np.searchsorted(known, h)] == 300 for h in []) and times.max() <= 300


def test_hashes_of_words_in_any_window():
    texts = [*ODD, "q" * 100_000 + " z", "a " * 40_000, "w7 " * 20_000 + "y" * 40_000 + " e", *("x" * n for n in (32_765, 32_766, 32_767, 32_768))]
    words = [(t or "").encode().lower().split() for t in texts]
    assert [n for _, counts in jaccard.word_hashes(texts) for n in counts] == list(map(len, words))
    known = {}
    for w, h in zip((w for ws in words for w in ws), (h for hs, _ in jaccard.word_hashes(texts) for h in hs.tolist()), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("values", [1 << 19, 50])
def test_ranges_of_shingles_add_up(values):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: 300 - k], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in range(0, 60, 3)]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    root = list(range(len(sets)))
    for i, j in [*links]:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    found, own = jaccard.linked_pairs(sets, np.arange(len(sets)), 90, values=values), list(range(len(sets)))
    for i, j in found.tolist():
        assert (max(i, j), min(i, j)) in links
        own = [min(own[i], own[j]) if r in (own[i], own[j]) else r for r in own]
    assert own == root


def test_large_sets_that_differ_are_not_sent_to_blocks(spark, monkeypatch):
    """Texts that share nine tenths of 6,000 words, below the threshold: only those with a link may go to the block stage with their shingles."""
    shared = [f"s{i}" for i in range(5400)]
    texts = [" ".join(shared + [f"u{k}x{i}" for i in range(600)]) for k in range(12)]
    texts += [t + " more words" for t in texts[:3]]
    sent = []

    def written(df, path, write=jaccard.written):
        out = write(df, path)
        if "/some-" in path:
            sent.extend(out.collect())
        return out

    monkeypatch.setattr(jaccard, "written", written)
    rows = jaccard.classes(docs(spark, texts), 3, 90).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {k: k % 12 for k in range(15)}
    assert len({r["c"] for r in sent}) <= 6  # the three linked pairs, at most


@pytest.mark.parametrize("percent", [51, 80, 90])
def test_parities_lose_no_link(percent):
    """Of any two sets, also of unlike numbers of classes; sets that share nothing are told apart."""
    rng = np.random.default_rng(percent)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 3000)), dtype=np.uint64))
        drop, add = (int(rng.integers(0, len(a) * (100 - percent) // percent + 1)) for _ in range(2))
        b = np.unique(np.concatenate([rng.permutation(a)[min(drop, len(a) - 1) :], rng.integers(0, 2**64, add, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        x = [jaccard.parity(a, percent), jaccard.parity(b, percent)]
        near = {(i, j) for i, js in jaccard.may_link(x, np.arange(2), percent) for j in js.tolist()}
        if 100 * both >= percent * (len(a) + len(b) - both):
            assert near in ({(0, 1)}, {(1, 0)})
        assert not [js for _, js in jaccard.may_link(x, np.zeros(2), percent) if len(js)]
        if percent > 51 and len(a) > 200:
            other = jaccard.parity(np.unique(rng.integers(0, 2**64, len(a), dtype=np.uint64)), percent)
            assert not [js for _, js in jaccard.may_link([x[0], other], np.arange(2), percent) if len(js)]


def test_components_of_chains(spark, tmp_path):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7)]
    got = {r["c"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_digest_of_kept_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
