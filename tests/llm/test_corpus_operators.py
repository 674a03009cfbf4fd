"""Every corpus operator against brute force, and on odd tables: nulls, empty and very long texts, ties, repeats, no rows, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varve.llm import buckets, capfilter, chat, components, hamming, huffman, langmix, ngramjoin, shards, tempering, toxic

DOCS = "doc_id long, text string, lang string, source string, row int, score double, tokens int, _h string, component_id long, hilbert int"
WORDS = {"en": "the of and thing that with this from water house".split(), "fr": "le la une dans pour avec être même eau maison".split()}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "er"]) for _ in range(n))


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, 1, 0.5, 2, "x", 9, 7)


@pytest.fixture(scope="module")
def odd(spark):
    base = prose("en", 200, 1)
    rows = [doc(i, prose("en" if i % 2 else "fr", 40 + i, i), "en" if i % 2 else "fr", "ab"[i % 2]) for i in range(30)]
    near = " ".join(w if k != 100 else "changed" for k, w in enumerate(base.split()))
    rows += [doc(100, base), doc(101, base), doc(102, near), doc(103, None), doc(104, ""), doc(105, " \n\t"), doc(106, "!!! 123"), doc(107, "two words")]
    rows += [doc(108, prose("en", 60_000, 5), "en", None), doc(None, "a text without a name", None, None), doc(109, "Ünï ñ 😀 </turn> ### x", None, "b")]
    rows += [rows[0]] * 3 + [doc(107, "TWO\twords")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def counted(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# --- chat


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, formatted int")
    return df, chat.format_chats(df)


def test_chat_round_trip_and_odd_rows(spark):
    rows = [(1, 2, "assistant", "fine </turn>\n### user: no"), (1, 1, "user", r"\### \\ <\/turn>"), (1, 1, "user", "tie"), (1, 3, None, None), (2, None, "assistant", ""), (None, 1, "ro:le\\", "x"), (3, 1, "assistant", "word " * 50_000)]
    rows = [(*r, "clash", 1) for r in rows] + [(4, 1, "user", "same", "", 0)] * 2
    _, out = chats(spark, rows)
    back = {r.conv_id: r for r in chat.read_chats(out).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, role or "", text or "") for c, t, role, text, *_ in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        learnt = "".join(x[2] for x in turns if x[1] == "assistant")
        r = back[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for r in out.collect():
        assert all(r.formatted[s.start : s.start + s.chars] in r.formatted for s in r.loss_spans)
    assert {r.conv_id: r.escape_level for r in out.collect()} == {1: 1, 2: 0, None: 0, 3: 0, 4: 0}
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_chat_without_rows(spark):
    assert chat.read_chats(chats(spark, [])[1]).collect() == []


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["</turn>", "\\", "###", "/", "<", "\n", "é", " ", ":", "### user: "]), max_size=8).map("".join), min_size=60, max_size=60))
def test_chat_any_control_strings(spark, texts):
    rows = [(i, t, "assistant" if t % 2 else "user", x, "", 0) for i in range(20) for t, x in enumerate(texts[3 * i : 3 * i + 3])]
    back = {r.conv_id: r for r in chat.read_chats(chats(spark, rows)[1]).collect()}
    for i in range(20):
        said = "".join(f"{'assistant' if t % 2 else 'user'}\n{x}\n" for t, x in enumerate(texts[3 * i : 3 * i + 3]))
        assert back[i].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


# --- shards


def test_hilbert_neighbours_touch(spark):
    for n, bits in ((2, 3), (3, 2)):
        grid = spark.range((1 << bits) ** n).select(*[(F.floor(F.col("id") / (1 << bits) ** i) % (1 << bits)).cast("long").alias(f"a{i}") for i in range(n)])
        walk = grid.withColumn("h", shards.hilbert_index([f"a{i}" for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in walk] == list(range((1 << bits) ** n))
        assert all(sum(abs(p[i] - q[i]) for i in range(n)) == 1 for p, q in zip(walk, walk[1:]))


def test_shards_cut_equal_runs(spark, odd, none):
    placed = shards.hilbert_shards(odd, shards=4)
    rows = placed.collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == odd.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert max(r.hilbert for r in rows if r.shard == 0) <= min(r.hilbert for r in rows if r.shard == 3)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert counted(placed, "doc_id", "size", "text_crc32") == want
    assert shards.hilbert_shards(none).collect() == []


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    shards.write_shards(odd, shards.hilbert_shards(odd, shards=4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("row.*").count() == odd.count()


# --- packing


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_best_bounds_against_all_choices():
    r = random.Random(3)
    for _ in range(40):
        lengths = [r.randint(1, 12) for _ in range(r.randint(1, 20))]
        count, k = Counter(lengths), r.randint(1, 4)
        got = buckets.best_bounds(list(count), list(count.values()), k)
        distinct = sorted(count)
        best = min(padding([*c, distinct[-1]], lengths) for m in range(min(k, len(distinct))) for c in itertools.combinations(distinct[:-1], m))
        assert len(got) <= k and got[-1] == distinct[-1] and padding(got, lengths) == best
    assert buckets.best_bounds([], [], 3) == []


def test_packing_keeps_every_token(spark, odd, none):
    rows = buckets.pack_buckets(odd, max_len=64, buckets=4, batch_tokens=256).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len and r.slot < max(1, 256 // r.bucket_len)
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += len(re.findall(r"\S+", r.text or "")) + 1
    assert got == want
    for b in {r.bucket for r in rows}:
        mine = sorted((r.batch, r.slot) for r in rows if r.bucket == b)
        room = max(1, 256 // next(r.bucket_len for r in rows if r.bucket == b))
        assert mine == [divmod(i, room) for i in range(len(mine))]
    assert buckets.pack_buckets(none).collect() == []


# --- mixing


def test_mixing_meets_the_limit_and_the_budget(spark, odd, none):
    tokens = {}
    for r in odd.collect():
        tokens.setdefault(r.source, []).append(max(1, len(re.findall(r"\S+", r.text or ""))))
    total = {s: sum(t) for s, t in tokens.items()}
    budget = sum(total.values())

    def stats(a):
        z = sum(t**a for t in total.values())
        w = {s: t**a / z for s, t in total.items()}
        return w, max(w[s] * budget / total[s] for s in total), -sum(x * math.log(x) for x in w.values())

    for limit, entropy in ((2.0, None), (None, 0.6)):
        low, high = 0.0, 1.0
        fine = lambda a: (limit is None or stats(a)[1] <= limit) and (entropy is None or stats(a)[2] <= entropy)
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if fine(mid) else (mid, high)
        weights = stats(high)[0]
        rows = tempering.mix_sources(odd, repeat_limit=limit, target_entropy=entropy, block_docs=4).select("row.*", "weight", "epoch", "block", F.col("tokens").alias("n")).drop("tokens").collect()
        for s in total:
            mine = [r for r in rows if r.source == s]
            taken, due = sum(r.n for r in mine), int(weights[s] * budget)
            assert all(abs(r.weight - weights[s]) < 1e-6 for r in mine)
            assert due - 2 <= taken <= due + 4 * max(tokens[s])
            whole = due // total[s]
            assert all(sum(r.n for r in mine if r.epoch == e) == total[s] for e in range(whole))
    assert tempering.mix_sources(none, repeat_limit=2.0).collect() == []
    out = tempering.mix_sources(odd, repeat_limit=2.0)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


# --- ids


TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_survive_the_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    huffman.write_tokens(odd, str(tmp_path / "a"), TOKENIZER, 2)
    got = sorted(huffman.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, zlib.crc32((r.text or "").encode())))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    huffman.write_tokens(none, str(tmp_path / "b"), TOKENIZER, 2)
    assert huffman.read_tokens(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("text", ["a\tb\x1cc ́x é", "<|endoftext|> it's 'S x's<|startoftext|>y", "\n\n", "", "ΟΔΥΣΣΕΥΣ Σ", "a  b\x0bc\x85d", "́ \née", "H̱ İ Σ. ΣΑΣ.", "Wait?. Yes., »No. 3. 4, e.g. a.b, X.", "_. a_, <|START. b", "ß. Ünï, œ. x", "Don'T. 'Ll, 've."])
def test_words_encode_like_whole_texts(text):
    from tokenizers import Tokenizer

    assert huffman.WordIds(TOKENIZER, 2).encode([text])[0].tolist()[:-1] == Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB .,'s?é̀İΣœ3_\n<|»", max_size=30))
def test_any_words_encode_like_whole_texts(text):
    own = test_any_words_encode_like_whole_texts.__dict__
    own.setdefault("words", huffman.WordIds(TOKENIZER, 2))
    assert own["words"].encode([text])[0].tolist()[:-1] == own["words"].tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=3000), st.integers(6, 12))
def test_code_is_optimal_and_decodes(ids, limit):
    ids = np.array(ids, np.uint32)
    counts = np.bincount(ids, minlength=41)
    size = huffman.code_lengths(counts, limit)
    assert size.max() <= limit and sum(2.0 ** -int(s) for s in size if s) <= 1
    bits, offsets = huffman.pack_bits(ids, huffman.canonical_codes(size), size)
    assert (huffman.unpack_bits(bits, offsets, len(ids), huffman.decode_table(size, limit), limit) == ids).all()
    if limit == 12 and np.count_nonzero(counts) > 1:
        heap = sorted(int(c) for c in counts if c)
        cost = 0
        while len(heap) > 1:
            a = heap.pop(0) + heap.pop(0)
            cost += a
            heap = sorted([*heap, a])
        deepest = int(size.max())
        assert (counts * size).sum() >= cost and (deepest == 12 or (counts * size).sum() == cost)


# --- language


def test_language_of_mixtures_and_odd_texts(spark, odd, none):
    many = spark.createDataFrame([doc(1000 + i, prose(x, 80, i), x) for i in range(60) for x in ("en", "fr")], DOCS)
    model = langmix.learn(many)
    assert model["names"] == ["en", "fr"]
    assert langmix.infer(langmix.plain(prose("fr", 100, 3)), model)[0] == "fr"
    main, share, both = langmix.infer(langmix.plain(prose("fr", 300, 3) + " " + prose("en", 150, 4)), model)
    assert main == "fr" and set(both) == {"en", "fr"} and 0.55 < share < 0.8
    rows = langmix.identify(odd, model).select("row.*", F.col("lang").alias("lang_of")).drop("lang")
    assert rows.count() == odd.count()
    und = {r.doc_id for r in rows.filter("lang_of = 'und'").collect()}
    assert und == {103, 104, 105, 106}
    assert langmix.identify(none, model).collect() == []
    empty = langmix.learn(none)
    assert {r.lang for r in langmix.identify(odd, empty).collect()} == {"und"}


# --- toxicity


def test_network_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in toxic.new_network(rng).items()}
    slots, grams = rng.integers(0, 50, (3, 5)), rng.integers(-1, 50, (3, 5, toxic._GRAMS))
    lean, label, weight = rng.standard_normal((3, 5)), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    for k in net:
        net[k] = net[k] + rng.standard_normal(net[k].shape) * 0.3
    _, grad = toxic._gradients(net, slots, grams, lean, label, weight)
    for k, i in [("uhf", (2, 5)), ("uhb", (1, 17)), ("wxf", (0, 3)), ("wxb", (9, 20)), ("attend", (3,)), ("out", (9,)), ("bias", (0,)), ("words", (int(slots[1, 2]), 3)), ("bxb", (4,))]:
        old, step = net[k][i], 1e-3
        net[k][i] = old + step
        up, _ = toxic._gradients(net, slots, grams, lean, label, weight)
        net[k][i] = old - step
        down, _ = toxic._gradients(net, slots, grams, lean, label, weight)
        net[k][i] = old
        assert abs((up - down) / (2 * step) - grad[k][i]) < 2e-3, k


def test_windows_cover_every_word():
    for n in range(1, 200):
        starts = toxic.window_starts(n)
        seen = {i for s in starts for i in range(s, min(n, s + toxic.WINDOW))}
        assert seen == set(range(n)) and (n < toxic.WINDOW or starts[-1] == n - toxic.WINDOW)
        assert all(b - a <= toxic.STRIDE for a, b in zip(starts, starts[1:]))


def test_score_is_that_of_the_worst_of_all_windows():
    """Every run of WINDOW words counts, wherever it begins; short texts between long ones change nothing."""
    rng = np.random.default_rng(11)
    model = {"net": toxic.new_network(rng), "words": {f"{chr(97 + i)}x": (i + 1, float(v)) for i, v in enumerate(rng.uniform(-2, 3, 26))}}
    texts = [" ".join(f"{chr(97 + i)}x" for i in rng.integers(0, 26, n)) for n in (90, 3, 33, 32, 1, 57, 250, 2, 5, 1)]
    net, brute = model["net"], toxic.Scorer(model)
    for text, score in zip(texts, toxic.Scorer(model).scores(texts)):
        words = text.split()
        words = list(np.resize(words, max(toxic.WINDOW, len(words))))
        slots, lean = np.array([[model["words"][w] for w in words[i : i + toxic.WINDOW]] for i in range(len(words) - toxic.WINDOW + 1)]).transpose(2, 0, 1)
        spelt = np.stack([toxic.word_grams(words[i : i + toxic.WINDOW]) for i in range(len(slots))])
        proj = toxic.projected(net, toxic.word_inputs(net, slots.astype(int), spelt, lean.astype(np.float32))).transpose(1, 0, 2)
        h, n = toxic.HIDDEN, toxic.WINDOW
        ahead = toxic._run_gru(lambda t: proj[t, :, : 3 * h], net["uhf"], range(n))
        back = toxic._run_gru(lambda t: proj[t, :, 3 * h :], net["uhb"], range(n - 1, -1, -1))[::-1]
        _, pooled = toxic._pooled(np.concatenate([np.stack(ahead), np.stack(back)], axis=2), net["attend"])
        assert abs(toxic._sigmoid(pooled @ net["out"] + net["bias"]).max() - score) < 1e-5
        alone = [brute.scores([" ".join(words[i : i + toxic.WINDOW])])[0] for i in range(len(slots))]
        assert abs(max(alone) - score) < 1e-5


def test_toxic_words_anywhere_are_caught(spark, odd, none):
    bad = "vile rotten foul".split()

    def text(i, is_bad):
        words = prose("en", 60 + i % 50, i).split()
        if is_bad:
            for k in range(2):
                words[random.Random(i + k).randrange(len(words))] = bad[(i + k) % 3]
        return " ".join(words)

    texts, label = [text(i, i % 4 == 0) for i in range(240)], np.array([i % 4 == 0 for i in range(240)])
    model = toxic.fit(texts, label, rounds=2)
    scorer = toxic.Scorer(model)
    fresh = scorer.scores([text(1000 + i, i % 2 == 0) for i in range(80)])
    assert (fresh[::2] >= 0.7).mean() > 0.9 and (fresh[1::2] < 0.7).mean() > 0.9
    late = prose("en", 3000, 8) + " vile foul rotten " + prose("en", 2000, 9)
    assert scorer.scores([late])[0] >= 0.7 and scorer.scores([prose("en", 500, 11)])[0] < 0.7
    rows = toxic.score_texts(odd, model).select("row.doc_id", F.col("score").alias("s")).collect()
    assert len(rows) == odd.count() and all(0 <= r.s <= 1 for r in rows)
    assert all(r.s == 0 for r in rows if r.doc_id in (103, 104, 105, 106))
    assert toxic.score_texts(none, model).collect() == []
    unlabelled = spark.createDataFrame([(1, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert toxic.training_sample(odd, unlabelled)[0] == []
    assert toxic.Scorer(toxic.fit([], np.zeros(0))).scores(["a b", None]).shape == (2,)


# --- pairs


def closure(ids, edges):
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2), (200, 150)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert {k: want[k] for k in got} == got and set(got) >= {x for x in want if want[x] != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def sets_of(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [(i, sets_of(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return closure({i for i, _ in sets}, links)


def test_ngram_groups_of_odd_rows(spark, odd, none):
    got = ngramjoin.link_documents(odd)
    want = brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert counted(got, "doc_id", "n_shingles", "component_id") == Counter((r.doc_id, len(sets_of(r.text)), want.get(r.doc_id)) for r in odd.collect())
    assert want[102] == 100 and ngramjoin.link_documents(none).collect() == []


def test_ngram_families_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CHUNK", 8)
    r, rows = random.Random(5), []
    shared = [f"s{i}" for i in range(30)]
    for family in range(4):
        base = [f"w{family}x{i}" for i in range(60)] + shared
        for _ in range(25):
            words = list(base)
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = f"r{r.random()}"
            rows.append((len(rows), " ".join(words)))
    got = {x.doc_id: x.component_id for x in ngramjoin.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows) and len(set(got.values())) > 4


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((60, 64))
    x = np.concatenate([base, base[:30] + 0.15 * r.standard_normal((30, 64)), base[:10], 3 * base[10:15]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 64), (902, [None, *[1.0] * 63]), (903, [float("nan")] * 64), (904, [1.0, 2.0]), (905, [])]
    df = spark.createDataFrame([(*t, 1, "c") for t in rows + odd], "vec_id long, embedding array<float>, n_links int, filters string")
    got = {t.vec_id: t for t in capfilter.near_vectors(df).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = closure(range(len(x)), np.argwhere(near).tolist())
    assert sum(got[i].n_links for i in want) >= 0.97 * near.sum() and all(got[i].n_links <= near[i].sum() for i in want)
    assert np.mean([got[i].component_id == want[i] for i in want]) > 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd)
    assert capfilter.near_vectors(df.limit(0)).collect() == []


def test_hot_filter_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "CHUNK", 16)
    r = np.random.default_rng(4)
    x = (np.ones(64) + 0.1 * r.standard_normal((80, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = capfilter.near_vectors(df).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert sum(t.n_links for t in rows) >= 0.97 * (near.sum() - 80) and {t.component_id for t in rows} == {0}


def test_hamming_against_all_codes(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((150, 64)), np.ones((20, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 3) for i, v in enumerate(x)] + [(500, None, 3), (501, [float("nan")] * 64, 3), (None, [1.0] * 64, 3), (0, x[0].tolist(), 3)], "vec_id long, embedding array<float>, code int")
    codes = hamming.sign_codes(df, "vec_id", "embedding")
    rows = hamming.top_k(codes.filter("id % 10 = 0"), codes, 7).collect()
    for q in range(0, 170, 10):
        d = ((x > 0) != (x[q] > 0)).sum(axis=1)
        want = [(int(i), int(d[i])) for i in np.lexsort((np.arange(len(x)), d))[:7]]
        assert [(t.vec_id, t.distance) for t in sorted((t for t in rows if t.query_id == q), key=lambda t: t.rank)] == want
    few = hamming.top_k(codes.filter("id = 1"), codes.filter("id < 3"), 7).collect()
    assert sorted(t.vec_id for t in few) == [0, 1, 2]
    assert hamming.top_k(codes.limit(0), codes, 3).collect() == [] and hamming.top_k(codes, codes.limit(0), 3).collect() == []


# --- the pipeline


def test_pipeline_stages_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}-{docs is odd}"))
    kept = corpus_pipeline.drop_near_copies(spark, odd, str(tmp_path)).collect()
    groups = brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    ids = Counter(r.doc_id for r in kept)
    assert set(ids) - {None} == {i for i in groups if groups[i] == i} and max(ids.values()) == 1
