"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm import bytesx, components, embed_index, grammar, media, mixing, ngram, quality, recompress, shard, substring, suffixes, wordbpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("rank", T.StringType()), T.StructField("bytes", T.StringType()),
])


def _texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["an", "the", "é", "ing", "ou", "ß", "st"]) for _ in range(rng.randint(1, 4)))
    body = lambda n: " ".join(word() for _ in range(n))
    passage, near = body(70), body(160).split()
    out = [None, "", " ", "\n\n", "one", "one two", "One  TWO", "a" * 700, "ab " * 400, "it's    odd   x \x1c y 12 ???!!", "日本語 " * 90, body(3000)]
    out += [f"{body(30)} {passage} {body(20)}" for _ in range(6)]
    for k in range(6):
        w = list(near)
        if k:
            w[10 * k] = word()
        out.append(" ".join(w))
    out += [body(120)] * 4 + [body(rng.randint(5, 200)) for _ in range(15)]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    texts = _texts()
    ids = [7 * k % 101 for k in range(len(texts))]
    rows = [(i, t, None if k % 3 else "en", None, None if k % 4 == 0 else len(t or ""), k, "x", None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[20], rows[20]]  # repeated rows
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def _same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n, k in ((0, 2), (1, 2), (2, 1), (90, 1), (700, 2), (900, 200)):
        t = rng.integers(0, k, n).astype(np.uint16)
        order, raw = suffixes.suffix_array(t), t.astype(">u2").tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: raw[2 * i :])
        shared = suffixes.common_prefixes(t, order, 40) if n > 1 else np.zeros(n, int)
        for p in range(1, n):
            a, b, h = order[p - 1], order[p], 0
            while h < 40 and max(a, b) + h < n and t[a + h] == t[b + h]:
                h += 1
            assert shared[p] == h


def _brute_bytes(pairs, length):
    raws = [(t or "").encode() for _, t in pairs]
    seen = Counter(r[s : s + length] for r in raws for s in range(len(r) - length + 1))
    for (i, _), r in zip(pairs, raws, strict=True):
        gone = np.zeros(len(r) + 1, bool)
        for s in range(len(r) - length + 1):
            if seen[r[s : s + length]] > 1:
                gone[s : s + length] = True
        gone = gone[: len(r)]
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        yield i, len(r), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [2_048, 1])
def test_substring(spark, docs, pairs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "RANGE", 50)
    _same(substring.remove_repeats(spark, docs).collect(), _brute_bytes(pairs, 200))


def test_substring_texts(spark, docs):
    out = substring.without_repeats(spark, docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all((r["text"] is None) or r["text"].encode() for r in out.where("length(text) > 0").collect())


def _brute_words(pairs):
    words = [(t or "").encode().split() for _, t in pairs]
    first = {}
    for (i, _), w in zip(pairs, words, strict=True):
        for s in range(len(w) - 49):
            first[tuple(w[s : s + 50])] = min(i, first.get(tuple(w[s : s + 50]), i))
    want = []
    for (i, _), w in zip(pairs, words, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return want


@pytest.mark.parametrize("hot", [2_048, 1])
def test_recompress(spark, docs, pairs, monkeypatch, hot):
    monkeypatch.setattr(recompress, "HOT", hot)
    _same(recompress.remove_repeats(spark, docs).collect(), _brute_words(pairs))


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80)])
def test_ngram(spark, docs, pairs, words, percent):
    sets = []
    for _, t in pairs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(least[find(k)], i)
    got = ngram.near_duplicates(spark, docs, words, percent).select("doc_id", "n_shingles", "component_id").collect()
    _same(got, [(i, len(s), least[find(k)]) for k, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))])


def test_ngram_hub_missing(spark, tmp_path):
    """Near copies whose original is not there, over several blocks: no link is lost."""
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    texts = []
    for k in range(90):
        w = list(base)
        for p in rng.sample(range(150), rng.choice([1, 2, 2, 3])):
            w[p] = f"v{p}{rng.randint(0, 1)}"
        texts.append((k, " ".join(w)))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    test_ngram(spark, spark.read.parquet(str(tmp_path / "d")), texts, 3, 90)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 16, "STRIPE": 900}, {"BLOCK_GRAMS": 3_000}])
def test_ngram_links(spark, tmp_path, monkeypatch, limits):
    """All links count: those between texts that a third has joined too, and over several blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram, name, value)
    rng = random.Random(9)
    texts = []
    for copies in (3, 2, 60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
        for k in range(copies):
            w = list(base)
            for p in rng.sample(range(160), min(k, rng.choice([1, 2, 3]))):
                w[p] = f"v{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [texts[1], texts[1], "alone", "", texts[0].upper()]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset())
    near = lambda a, b: a != b and 100 * len(a & b) >= 90 * len(a | b)
    want = {s: sum(near(s, o) for o in set(sets)) for s in sets}
    assert [want[s] for s in sets[:5]] == [2, 2, 2, 1, 1]
    got = ngram.near_duplicates(spark, spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "n_links").collect()
    _same(got, [(k, want[s]) for k, s in enumerate(sets)])


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 51), (52, 51), (7, 7), (60, 61), (60, 61)]
    got = dict(components.components(spark, spark.createDataFrame(edges, "a long, b long")).df.collect())
    assert got == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50, 52: 50, 60: 60, 61: 60}


def test_grammar(spark, docs, pairs):
    path = public.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    written = grammar.write_ids(spark, docs, path).df
    got = grammar.read_ids(written).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in pairs)
    start, by_id = 0, defaultdict(Counter)
    for i, text in pairs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        by_id[i][len(ids), zlib.crc32(ids.tobytes())] += 1
    for r in got:
        assert r["start"] == start and by_id[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] > 0
        start += r["n_tokens"]


def test_grammar_random_access():
    rng = np.random.default_rng(2)
    for n, k in ((0, 3), (1, 3), (5_000, 3), (5_000, 40), (3_000, 1)):
        ids = rng.integers(0, k, n).astype(np.uint32)
        s = grammar.Shard(grammar.pack(ids, np.array([n // 2, n - n // 2]), 50))
        assert (s.ids(0, n) == ids).all() and (s.document(1) == ids[n // 2 :]).all()
        for a, b in rng.integers(0, n + 1, (20, 2)):
            assert (s.ids(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_grammar_counts_only_pairs_that_may_be_frequent(monkeypatch):
    """Rounds go on until no pair is frequent, but sort few keys after the first ones."""
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 900, rng.integers(2, 7)) for _ in range(3_000)]
    ids = np.concatenate([words[k] for k in np.minimum(rng.zipf(1.3, 40_000), 3_000) - 1]).astype(np.uint32)
    sort, sizes = np.sort, []
    monkeypatch.setattr(np, "sort", lambda a, *rest, **more: (sizes.append(len(a)), sort(a, *rest, **more))[1])
    for base in (1_000, 65_530, 70_000):  # symbols of two bytes, of two and then more, of more
        sizes.clear()
        seq, rules, lengths = grammar.compress(ids, base)
        assert len(sizes) > 5 and sum(sizes) < 0.5 * len(sizes) * len(ids)
        pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
        assert len(rules) > 100 and max(pairs.values()) < grammar.LEAST_COUNT
        span = np.concatenate((np.ones(base, np.int64), lengths))
        assert span[base:].tolist() == span[rules].sum(1).tolist() and (grammar.expand(seq, rules, span) == ids).all()


def _encoded(enc, texts):
    raw = [x.encode() for x in texts]
    ids, sizes = enc(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_words_go_to_the_model(monkeypatch):
    """Words of Latin letters pass the library's cutting of texts by, and get the ids that it would give them."""
    enc = grammar.WordEncoder(public.path("word_bpe_49k.json"))
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    letters = [chr(c) for c in range(0x370) if chr(c).isalpha()]
    odd = ["\u0130stanbul", "ΟΔΟΣ", "e\u0301te\u0301", "\u212b", "<|endoftext|>", "l'été's", "É!!", "3×é÷2=", "c'é=\u0338", "日本語", "\u200bab", "x\x85y", "é" * 300, "a" * 70_000]
    texts = [" ".join(f"a{c}b {c} {c}'ll,{c}" for c in letters), " ".join(odd), "", "été Été thé, straße STRASSE ſ ŉ ª º"]
    assert _encoded(enc, texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]

    class Spy:
        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return enc_tokenizer.encode_batch_fast(texts, **more)

    seen, enc_tokenizer = [], enc.tokenizer
    monkeypatch.setattr(enc, "tokenizer", Spy())
    text = "Plain words, größere Wörter, déjà vu); señor!"
    assert _encoded(enc, [text]) == [t.encode(text, add_special_tokens=False).ids]
    assert not [x for x in seen if any(c.isalpha() for c in x)]


def test_known_words(monkeypatch):
    """Words that a worker knows already, with digests that meet, a table that grows, and one that starts afresh."""
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 300)} {'q' * rng.randint(1, 40)}é{rng.randint(0, 9)}" for _ in range(150)) for _ in range(8)]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    call = bytesx.Runs.__call__
    for bits, cache in ((64, 500_000), (64, 200), (6, 500_000), (0, 500_000)):
        monkeypatch.setattr(bytesx.Runs, "__call__", lambda self, a, b, keep=np.uint64(2**bits - 1): call(self, a, b) & keep)
        monkeypatch.setattr(grammar, "CACHE", cache)
        enc = grammar.WordEncoder(public.path("word_bpe_49k.json"))
        enc.slots = enc.slots[:4].copy()
        assert [_encoded(enc, [x])[0] for x in texts + texts] == want + want


def test_wordbpe(spark, docs, pairs):
    ranks = wordbpe.Ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    got = wordbpe.encode_texts(spark, docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, bundle=7, words_per_block=50).collect()
    want = []
    for i, t in pairs:
        ids = ranks.encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    _same(got, want)


def test_wordbpe_long_word(spark, tmp_path):
    """Words of more than 65,536 ids, beside others of their bundle."""
    rng = random.Random(12)
    long = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(40_000))
    texts = [(1, "a word before"), (2, long), (3, f"twice {long} and after"), (4, "it's after")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    ranks = wordbpe.Ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    want = [(i, ranks.encoding.encode_ordinary(t)) for i, t in texts]
    assert len(want[1][1]) > 65_536
    got = wordbpe.encode_texts(spark, spark.read.parquet(str(tmp_path / "d")), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    _same([tuple(r)[:3] for r in got], [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in want])


def test_media(spark, docs, pairs):
    got = media.read(media.store(spark, docs).df).collect()
    want = Counter()
    for i, t in pairs:
        p = media.padded((t or "").encode())
        m = media.wav(p)
        want[i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), media.describe(p)] += 1
    assert Counter(tuple(r)[:8] for r in got) == want


def test_cuts_follow_content():
    rng = np.random.default_rng(4)
    tail = rng.bytes(60_000)
    a, b = media.cuts(rng.bytes(3_000) + tail), media.cuts(rng.bytes(9_000) + tail)
    assert len({x - 3_000 for x in a} & {x - 9_000 for x in b}) > 10
    assert media.cuts(b"") == [] and media.cuts(b"x" * 20_000)[-1] == 20_000


def test_shard(spark, docs):
    rows = docs.select("doc_id", F.length("text").alias("size"))
    got = shard.shard_rows(spark, rows, ["doc_id", "size"], 5, rows_per_part=7, cell_rows=2).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())


def test_communication_matrix():
    m = shard.communication_matrix([5, 0, 12, 4], 4)
    assert m.sum(axis=1).tolist() == [5, 0, 12, 4] and sorted(m.sum(axis=0).tolist()) == [5, 5, 5, 6]
    draws = np.mean([shard.communication_matrix([6, 6], 3, seed=s)[0, 0] for s in range(400)])
    assert abs(draws - 2) < 0.2


def test_nearest(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 16))
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(base)] + [(400 + k, [float(x) for x in base[0]], "x") for k in range(30)]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [None] * 16, "x"), (904, [1.0], "x"), (None, [1.0] * 16, "x"), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = embed_index.nearest(spark, df, df.where("vec_id % 20 = 0"), 20).collect()
    ids, points = np.arange(430), np.concatenate((base, np.repeat(base[:1], 30, axis=0)))
    hits = 0
    for q in range(0, 430, 20):
        s = (points[q] * points).sum(axis=1)
        order = [int(k) for k in np.lexsort((ids, -s)) if k != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[v] - x) < 1e-9 for _, v, x in mine)
        hits += len(set(order) & {v for _, v, _ in mine})
    assert hits / 440 >= 0.9
    assert embed_index.nearest(spark, df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize(("reach", "high", "part_rows"), [(9, 0, 10_000), (14, 3, 20), (23, 2, 10_000), (2, 5, 3)])
def test_probes_retrieve_every_code_within_reach(spark, monkeypatch, reach, high, part_rows):
    """Once each, by equal keys only: nothing in the plan multiplies rows with queries."""
    monkeypatch.setattr(embed_index, "PART_ROWS", part_rows)
    rng = np.random.default_rng(14)
    codes = rng.integers(-(2**63), 2**63 - 1, 300)
    for k in range(150):  # near ones
        codes[k] = codes[150 + k] ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 25), replace=False))
    df = spark.createDataFrame([(k, int(c)) for k, c in enumerate(codes)], "id long, c0 long")
    out = embed_index.retrieved(df, df.where("id % 3 = 0"), reach, 64, high)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "CoGroup" not in plan
    away = np.bitwise_count(codes.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None, :])
    want = [(q, v) for q in range(0, 300, 3) for v in range(300) if q != v and away[q, v] <= reach]
    _same(out.collect(), want)


def test_nearest_widens_for_few_and_takes_hot_vectors(spark):
    rng = np.random.default_rng(15)
    base = rng.standard_normal((60, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)] + [(100 + k, [float(x) for x in base[3]]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_index.nearest(spark, df, df.where("vec_id in (3, 7, 110)"), 10, radius=0).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 110] == [3, *range(100, 109)]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 3] == [*range(100, 110)]
    assert sum(r["query_id"] == 7 for r in got) == 10


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    good = [(k, " ".join(rng.choice(["an", "the", "ing", "ou", "st", "of"]) for _ in range(60)), 1, 60) for k in range(120)]
    bad = [(200 + k, " | ".join(rng.choice(["an$$$", "the", "ing###", "ou"]) for _ in range(60)), 0, None) for k in range(60)]
    df = spark.createDataFrame([(i, t, n) for i, t, _, n in good + bad], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in good[:90] + bad[:40]] + [(None, 1), (5, None)], "doc_id long, label int")
    machine = quality.train(spark, df, labels)
    held = {r["doc_id"]: r["score"] for r in quality.score(spark, df, machine).collect()}
    assert np.mean([held[i] > 0.3 for i, *_ in good[90:]] + [held[i] < 0.3 for i, *_ in bad[40:]]) > 0.95
    out = quality.score(spark, docs, machine, "_s")
    assert out.columns == [*docs.columns, "_s"] and all(0 <= r["_s"] <= 1 for r in out.collect())
    assert quality.score(spark, empty, machine).count() == 0
    assert quality.train(spark, df, labels.limit(0)).constant == 0.5


def test_machine_identity():
    m = quality.Machine()
    m.v = np.random.default_rng(0).normal(size=m.v.shape)
    col, val, row = np.array([3, 9, 40, 3]), np.array([0.5, -1.0, 2.0, 1.5]), np.array([0, 0, 0, 1])
    z, _ = m.logits(col, val, row, 2)
    pair = sum(m.v[col[a]] @ m.v[col[b]] * val[a] * val[b] for a in range(3) for b in range(a))
    assert abs(z[0] - pair) < 1e-9 and abs(z[1]) < 1e-9


def test_mixing(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 7 == 0)) for i in range(101)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    goal = {"clean": 0.7, "toxic": 0.1, "low": 0.15, "low_toxic": 0.05}
    out = mixing.mix(spark, docs, labels, weights=goal).collect()
    assert len(out) == docs.count() and all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in out)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in out)
    n, p = np.array([r["n_tokens"] for r in out], float), np.array([r["posterior"] for r in out])
    w, g, share = n / n.sum(), np.array(list(goal.values())), np.maximum((n / n.sum()) @ p, list(goal.values()))
    loss = lambda r: (((w * r) @ p - g) ** 2 / share).sum() / 2
    best = np.ones(len(n))
    for _ in range(mixing.ROUNDS):
        centre = best
        for _ in range(5_000):
            best = np.maximum(0, best - 0.9 * (p @ (((w * best) @ p - g) / share) + mixing.PULL * (best - centre)))
    assert loss(np.array([r["rate"] for r in out])) <= loss(best) + 1e-3 * loss(np.ones(len(n)))
    assert mixing.mix(spark, empty, labels, weights=goal).count() == 0
    assert mixing.mix(spark, empty, labels, factors={"clean": 1.0, "toxic": 0.0}).count() == 0
    assert mixing.mix(spark, docs, labels.limit(0), weights=goal).count() == docs.count()


def test_mixing_reaches_its_targets(spark, tmp_path):
    """Learned posteriors on rows without labels; expected domain tokens within 1 % of attainable targets."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["an", "the", "ing", "ou", "st", "of"]) for _ in range(3))
    rows, labels = [], []
    for k in range(900):
        w = [word() for _ in range(rng.randint(30, 90))]
        bad, toxic = k % 6 == 0, k % 8 == 1
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["scum", "moron"])
            w[rng.randrange(len(w))] = rng.choice(["trash", "clown"])
        rows.append((k, " ".join(x + rng.choice(["$$", "##"]) for x in w) if bad else " ".join(w), "x", 5.0))
        if k % 2:
            labels.append((k, 1, int(toxic)))
        elif k % 3 == 0:
            labels.append((k, int(not bad), int(toxic)))
    spark.createDataFrame(rows, "doc_id long, text string, rid string, rate double").write.parquet(str(tmp_path / "d"))
    df, known = spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    goal = {"clean": 0.93, "toxic": 0.04, "low": 0.03, "low_toxic": 0.0}
    mixed = mixing.mix(spark, df, known, weights=goal)
    assert mixed.columns == ["doc_id", "text", "rid", "n_tokens", "posterior", "rate", "copies"]
    out = mixed.collect()
    names = list(mixing.DOMAINS)
    true = {k: ("low" if k % 6 == 0 else "clean") if k % 8 != 1 else "toxic" for k in range(900)}
    held = [r for r in out if r["doc_id"] % 2 == 0 and r["doc_id"] % 3]
    right = [names[int(np.argmax(r["posterior"]))] == true[r["doc_id"]] for r in out if r not in held] + [names[int(np.argmax(r["posterior"]))] == true[r["doc_id"]] for r in held]
    assert np.mean(right) > 0.95
    n = np.array([r["n_tokens"] for r in out], float)
    got = (n * [r["rate"] for r in out]) @ np.array([r["posterior"] for r in out]) / n.sum()
    assert all(abs(x - goal[k]) <= 0.01 * max(goal[k], 0.01) for k, x in zip(names, got, strict=True))
    plan = mixed.where("copies > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 0 and plan.count("exp(") == 0 and len(plan) < 20_000
    kept = mixing.mix(spark, df, known, factors={"clean": 1.0, "toxic": 0.0, "low": 0.0, "low_toxic": 0.0}, pull=0.1, most=1.0, rounds=1).collect()
    assert max(r["rate"] for r in kept) <= 1
    assert np.mean([r["copies"] == (true[r["doc_id"]] == "clean") for r in kept]) > 0.95


def test_empty(spark, empty):
    assert substring.remove_repeats(spark, empty).count() == 0
    assert recompress.remove_repeats(spark, empty).count() == 0
    assert ngram.near_duplicates(spark, empty).count() == 0
    assert grammar.read_ids(grammar.write_ids(spark, empty, public.path("word_bpe_49k.json")).df).count() == 0
    assert wordbpe.encode_texts(spark, empty, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0
    assert media.read(media.store(spark, empty).df).count() == 0
    assert shard.shard_rows(spark, empty.select("doc_id"), ["doc_id"]).count() == 0


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"abcabcab", np.uint8)
    h = bytesx.Runs(data)(np.array([0, 3, 0]), np.array([3, 6, 4]))
    assert h[0] == h[1] != h[2]


def _twins():
    """A word whose two-letter forms any polynomial digest modulo 2^64 takes for each other."""
    a = "".join("ab"[k.bit_count() & 1] for k in range(1_024))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_twins_are_told_apart(spark, tmp_path):
    x, y = _twins()
    rest = [" ".join(f"{c}{k}" for k in range(60)) for c in "pq"]
    texts = [(1, x), (2, y), (3, f"{rest[0]} {x} {rest[0][::-1]}"), (4, f"{rest[1]} {y} {rest[1][::-1]}"), (5, " ".join([x, y] * 30)), (6, " ".join([y, x] * 30) + " z")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    _same(substring.remove_repeats(spark, df).collect(), _brute_bytes(texts, 200))
    _same(recompress.remove_repeats(spark, df).collect(), _brute_words(texts))
    test_ngram(spark, df, texts, 3, 90)
    test_grammar(spark, df, texts)
    ranks = wordbpe.Ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    ids = [(i, np.array(ranks.encoding.encode_ordinary(t), "<u4")) for i, t in texts]
    got = wordbpe.encode_texts(spark, df, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    _same([tuple(r)[:3] for r in got], [(i, len(v), hashlib.sha256(v.tobytes()).hexdigest()) for i, v in ids])


def test_words_of_one_digest_are_told_apart(spark, tmp_path, monkeypatch):
    """Even where digests meet, here in six bits of them, op2 and op3 give every word its own ids."""
    call = bytesx.Runs.__call__
    rng = random.Random(3)
    texts = [(k, " ".join(f"w{rng.randint(0, 400)}" for _ in range(200))) for k in range(6)]
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    monkeypatch.setattr(bytesx.Runs, "__call__", lambda self, a, b: call(self, a, b) & np.uint64(63))
    enc = grammar.WordEncoder(public.path("word_bpe_49k.json"))
    raw = b"".join(x.encode() for _, x in texts)
    ids, sizes = enc(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(x.encode()) for _, x in texts)]))
    want = [t.encode(x, add_special_tokens=False).ids for _, x in texts]
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_periodic_texts(spark, tmp_path):
    """Runs of one stretch are one occurrence; what is removed stays the same."""
    texts = [(1, "a" * 900), (2, "xy" * 400 + "z"), (3, "tell me " * 90), (4, "b" * 150), (5, "a" * 300 + "c" * 250), (0, "me tell " * 60 + "end")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    _same(substring.remove_repeats(spark, df).collect(), _brute_bytes(texts, 200))
    _same(recompress.remove_repeats(spark, df).collect(), _brute_words(texts))


def test_inputs_that_are_no_files(spark, docs, pairs):
    """Rows of a shuffled input have one place whenever they are read."""
    df = docs.join(docs.select("doc_id").distinct(), "doc_id").select(docs.columns)
    _same(substring.remove_repeats(spark, df).collect(), _brute_bytes(pairs, 200))


def test_without_shared_folder(spark, monkeypatch):
    from tempora.llm import scratch

    class Far:
        sparkContext = type("C", (), {"master": "spark://host:7077"})
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError, match="share"):
        scratch.shared_root(Far)
