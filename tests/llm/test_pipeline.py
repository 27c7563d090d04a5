"""The pipeline's stages one by one against plain Python, and run() against the stages."""

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
cp = pytest.importorskip("corpus_pipeline")
public = pytest.importorskip("public_tokenizers")

from tempora.llm import substring, wordbpe  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "the", "ing", "ou", "st", "of", "é"]) for _ in range(rng.randint(1, 4)))
    body = lambda n: [word() for _ in range(n)]
    shared = " ".join(body(60))
    docs, labels = [], []
    for k in range(160):
        bad, toxic = k % 5 == 0, k % 7 == 0
        w = body(80)
        if bad:
            w = [x + rng.choice(["$$$", "###", "&&&"]) for x in w]
        if toxic:
            for p in rng.sample(range(80), 6):
                w[p] = rng.choice(["scum", "moron", "trash"])
        text = " ".join(w)
        if k % 20 in (1, 2):
            text += " " + shared
        docs.append((k, text, "en", f"s{k % 3}", len(text), "kept"))
        if k % 4:
            labels.append((k, int(not bad), int(toxic)))
    w = body(120)
    for k in range(4):  # near copies
        v = list(w)
        v[30 * k] = word()
        docs.append((500 + k, " ".join(v), "en", "s0", None, "kept"))
    docs += [docs[-1], (None, None, None, None, None, None), (900, "", None, None, 0, "x")]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, tables[-1], corpus).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
        assert k == 4 or tables[-1].columns == columns
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    key = lambda r: (r["doc_id"], r["text"])

    # 1: bad rows go, good ones stay
    left = {r["doc_id"] for r in rows[1]}
    assert np.mean([(k in left) == bool(k % 5) for k in range(160)]) > 0.95 and not Counter(map(key, rows[1])) - Counter(map(key, rows[0]))

    # 2: one of each near-duplicate group, by plain sets
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [grams(r["text"]) for r in rows[1]], list(range(len(rows[1])))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups: dict[int, list[int]] = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(k)
    want = Counter(min((rows[1][k] for k in g), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for g in groups.values())
    assert Counter(r["doc_id"] for r in rows[2]) == want

    # 3: strings that start anywhere else are gone
    seen = Counter(t[s : s + 200] for r in rows[2] for t in [(r["text"] or "").encode()] for s in range(len(t) - 199))
    before = {r["doc_id"]: (r["text"] or "").encode() for r in rows[2]}
    for r in rows[3]:
        raw = before[r["doc_id"]]
        runs = substring._removed(len(raw), [(s, s + 200) for s in range(len(raw) - 199) if seen[raw[s : s + 200]] > 1])
        assert (r["text"] or "").encode() == substring._whole_signs(raw, runs)
    assert any(len(r["text"] or "") < len(before[r["doc_id"]]) for r in rows[3])

    # 4: clean rows stay, toxic ones go, nothing else comes
    assert {key(r) for r in rows[4]} <= {key(r) for r in rows[3]}
    clean = [r["doc_id"] for r in rows[3] if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 7 and r["doc_id"] % 5]
    toxic = [r["doc_id"] for r in rows[3] if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 7 == 0]
    stay = {r["doc_id"] for r in rows[4]}
    assert np.mean([d in stay for d in clean]) > 0.9 and np.mean([d in stay for d in toxic]) < 0.4

    # 5: the library's own ids
    ranks = wordbpe.Ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    want = Counter()
    for r in rows[4]:
        raw = np.array(ranks.encoding.encode_ordinary(r["text"] or ""), "<u4").tobytes()
        want[r["doc_id"], len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows[5]) == want


def test_run(spark, corpus):
    """run() gives what its stages give one after another, whatever its columns are called."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, corpus)
    key = lambda r: (r["doc_id"], r["n_tokens"], r["ids_sha256"])
    assert Counter(map(key, cp.run(spark, corpus).collect())) == Counter(map(key, docs.collect()))


def test_clashing_names_and_no_rows(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    clash = docs.selectExpr("*", *[f"'{k}' as {k}" for k in ("rid", "score", "spans", "copies", "rate", "n_tokens", "posterior", "row", "root", "place", "n")])
    clash.write.parquet(str(tmp_path / "c"))
    clash.limit(0).write.parquet(str(tmp_path / "e"))
    for name, some in (("c", True), ("e", False)):
        for k, (_, stage) in enumerate(cp.STAGES):
            rows = spark.read.parquet(str(tmp_path / name))
            out = stage(spark, rows, corpus)
            got = out.collect()
            assert bool(got) == some
            if k < 4:
                assert out.columns == rows.columns
                assert all(r["rid"] == "rid" and r["rate"] == "rate" and r["row"] == "row" for r in got)
