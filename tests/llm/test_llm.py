"""The corpus operators against brute force, on small rows with every awkward case."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.llm import fingerprints, language_id, mixing, packing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter
from scrivana.llm.components import connected_components
from scrivana.llm.suffix_array import suffix_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string"


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "straße", "größe", "élan", "中文字", "x", "longerword"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(60))
    rows = []
    for k in range(n):
        t = " ".join(rng.choice(words) + rng.choice(["", "a", "bc", "."]) + str(rng.randrange(999)) for _ in range(rng.randrange(3, 90)))
        if k % 4 == 0:
            t += "\n" + passage[: rng.randrange(60, len(passage))]
        rows.append([k, t, ["en", "fr", None][k % 3], ["a", "a", "b", None][k % 4], len(t)])
    rows[7][1], rows[9][1], rows[11][1] = None, "", rows[8][1]
    rows[13][1] = "word " * 3000
    rows[15][1] = "a" * 700
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Repeated rows, repeated ids with other texts, and null ids."""
    r = corpus()
    return spark.createDataFrame([*r[:20], *r[:3], (5, "quite another text " * 9, "en", "a", 9, "", ""), (None, r[4][1], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1: fingerprints


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.against_next(docs).collect()}
    texts = {r[0]: r[1] or "" for r in corpus()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        sketch = lambda x: fingerprints.sketch(*fingerprints.anchors(x), x)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert got[i].fingerprint == fingerprints.to_text(sketch(t)) and got[i].edited_fingerprint == fingerprints.to_text(sketch(edited))
        assert got[i].near_edited == fingerprints.likeness(sketch(t), sketch(edited)) and got[i].near_next == fingerprints.likeness(sketch(t), sketch(nxt))
    assert got[8].fingerprint == got[11].fingerprint


def test_closed_syncmers_by_definition():
    codes = np.array([random.Random(1).randrange(97, 101) for _ in range(500)], np.uint32)
    _, at = fingerprints.closed_syncmers(codes)
    n = len(codes) - fingerprints.S + 1
    c = codes.astype(np.uint64)
    inner = c[:n].copy()
    for j in range(1, fingerprints.S):
        inner = inner * fingerprints._M2 + c[j : n + j]
    inner = fingerprints._mix(inner)
    w = fingerprints.K - fingerprints.S + 1
    assert at.tolist() == [p for p in range(len(codes) - fingerprints.K + 1) if inner[p : p + w].min() in (inner[p], inner[p + w - 1])]


def test_fingerprints_awkward(awkward, empty):
    assert fingerprints.against_next(awkward).count() == awkward.count()
    assert fingerprints.against_next(empty).count() == 0


# 2: suffix-array dedup


def brute(rows):
    seen, out = set(), {}
    for i, b in rows:
        gone = bytearray(len(b))
        for q in range(len(b) - 99):
            w = b[q : q + 100]
            if w in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_ranks(spark):
    rng = random.Random(0)
    strings = [[rng.randrange(1, 3) for _ in range(rng.randrange(1, 12))] for _ in range(20)] + [[1] * 9]
    df = spark.createDataFrame([(k, s, 27) for k, s in enumerate(strings)], "sid long, syms array<long>, need int")
    got = {r.sid: r.ranks for r in suffix_ranks(df).collect()}
    every = sorted(tuple(s[i:]) for s in strings for i in range(len(s)))
    assert all(got[k][i] == every.index(tuple(s[i:])) for k, s in enumerate(strings) for i in range(len(s)))


def test_remove_repeats(docs):
    want = brute((r[0], (r[1] or "").encode()) for r in corpus())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 5000


def test_remove_repeats_awkward(awkward, empty):
    assert suffix_dedup.remove_repeats(awkward).count() == awkward.count()
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_phrases_cover_every_string():
    raw = np.frombuffer(random.Random(2).randbytes(20_000), np.uint8)
    at, _ = suffix_dedup.anchors(raw)
    assert np.diff(at).max() <= suffix_dedup.K - suffix_dedup.S


# 3 and 5: classifiers


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(240):
        w = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(40)]
        bad = k % 3 == 0
        if bad:
            w[5], w[20] = "nastything", "nastythings"
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r.doc_id: r for r in toxicity.classify(d, model).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    out = [k for k in got if got[k].held_out]
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in out]) > 0.9
    assert toxicity.classify(spark.createDataFrame([(1, "a nastythiing here nastythinq")], "doc_id long, text string"), model).first().score > 0.3
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert toxicity.classify(odd, model).count() == 3 and toxicity.drop_toxic(odd, model).columns == ["doc_id", "text"]
    assert toxicity.classify(empty, toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_language(spark, empty):
    rng = random.Random(6)
    parts = {"xx": ["the", "ing", "sh"], "yy": ["eau", "que", "oir"]}
    rows = [(k, " ".join("".join(rng.choice(parts[la]) for _ in range(2)) for _ in range(20)), la) for k in range(120) for la in [("xx", "yy")[k % 2]]]
    d = spark.createDataFrame([*rows, (500, None, "xx"), (501, "123 !", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(d, language_id.train(d)).collect()}
    assert np.mean([got[i].lang_pred == la for i, _, la in rows]) > 0.95
    assert got[500].lang_pred == got[501].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_score_by_definition():
    """The score is the highest of the spans' averages, over slices of a long text too."""
    rng = random.Random(7)
    weight = np.random.default_rng(0).normal(size=1 << toxicity.BITS).astype(np.float32)
    from scrivana.llm import ngrams

    for n in (1, 3, 9, 40):
        words = ["".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 9))) for _ in range(n)]
        spans = [words[k : k + toxicity.SPAN] for k in range(0, n, toxicity.SPAN)]
        bags = [np.concatenate([g for w in s for g in ngrams.hashed(w, toxicity.SIZES, toxicity.BITS)]) for s in spans]
        best = max(weight[b].mean() for b in bags if len(b))
        assert abs(toxicity.score(" ".join(words), weight, 0.5) - 1 / (1 + np.exp(-0.5 - best))) < 1e-5
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200))
    whole = toxicity.score(text, weight, 0.0)
    before, ngrams._SLICE = ngrams._SLICE, 37
    try:
        assert abs(toxicity.score(text, weight, 0.0) - whole) < 1e-6
    finally:
        ngrams._SLICE = before
    assert toxicity.score("", weight, 0.5) == toxicity.score("12 !", weight, 0.5) == pytest.approx(1 / (1 + np.exp(-0.5)))


# 4: packing


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(spans[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
        want[i] = len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    return sum(want.values()) / (len(seqs) * packing.WINDOW)


def test_packing(docs):
    texts = {r[0]: r[1] for r in corpus()}
    assert check_packing(packing.pack(docs).collect(), texts) > 0.8


def test_packing_awkward(awkward, empty):
    assert packing.pack(awkward).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packing.pack(empty).count() == 0


def test_word_ids():
    from tokenizers import Tokenizer

    tk, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for t in ["", " <|endoftext|> a<|startoftext|>b", "don't It's é İ ß İstanbul 's 'll\x85\x1c z　q", "Σίσυφος ΣΑΣ 中文 日本語 é", "\x01 \x01"]:
        assert np.frombuffer(own.encode(t), np.uint32).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(rng.normal(size=12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


# 6: SimHash


@pytest.mark.parametrize("tile", [2048, 4])
def test_simhash(docs, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    texts = {r[0]: r[1] for r in corpus()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, radius=6, blocks=8).collect()}
    fp = {i: simhash.simhash(t)[0] for i, t in texts.items()}
    part = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            part[i] = min(part[j] for j in texts if (fp[i] ^ fp[j]).bit_count() <= 6)
    assert got == {i: (f"{fp[i]:016x}", part[i]) for i in texts}


def test_simhash_by_definition():
    import xxhash

    words = "The quick\tBrown fox jumps ÄÖ".split()
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    h = [xxhash.xxh64_intdigest(" ".join(low[k : k + 3]).encode(), 42) for k in range(len(low) - 2)]
    assert simhash.simhash(" ".join(words))[0] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(None) == (0,)


def test_simhash_awkward(awkward, empty):
    assert simhash.near_duplicates(awkward).count() == awkward.count()
    assert simhash.near_duplicates(empty).count() == 0


def five(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_copies_recall(spark):
    """Pairs of a similarity of 0.6 to 0.95 against brute force: all but a hundredth of those from 0.8 up are linked, and none below."""
    rng = random.Random(8)
    rows, like = [], []
    for k in range(1200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 60, 100, 160, 250]))]
        v = list(w)
        for p in rng.sample(range(len(w)), 1 + k % 5):
            v[p] = f"z{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        a, b = five(rows[-2][1]), five(rows[-1][1])
        like.append(len(a & b) / len(a | b))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(1200))
    gone = [2 * k + 1 not in kept for k in range(1200)]
    assert not any(g for g, j in zip(gone, like, strict=True) if j < 0.8)
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1)):
        found = [g for g, j in zip(gone, like, strict=True) if low <= j < high]
        assert len(found) > 50 and np.mean(found) >= 0.99, (low, len(found), np.mean(found))


@pytest.mark.parametrize("tile", [1024, 3])
def test_confirmed_links(spark, tile, monkeypatch):
    """Links of one part equal those of all its pairs, in one tile or many."""
    monkeypatch.setattr(simhash, "TILE_TEXTS", tile)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(f"v{rng.randrange(99)}" if rng.random() < 0.025 else w for w in base) for _ in range(40)]
    d = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "node long, part long, text string")
    sets, part = [five(t) for t in texts], list(range(40))
    near = [[j for j in range(40) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for a in sets]
    for _ in texts:
        part = [min(part[j] for j in near[i]) for i in range(40)]
    got = {r.node: r.component for r in simhash.confirmed_components(d, 5, 0.8).collect()}
    groups = lambda m: {frozenset(i for i in range(40) if m(i) == g) for g in {m(i) for i in range(40)}}
    assert groups(lambda i: got.get(i, i)) == groups(lambda i: part[i]) and len(set(part)) > 3


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (300, 300), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {300: 300}


# 7: quality


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t, *_ in corpus():
        w = (t or "").encode().split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(again), sum(len(x.decode()) for x in w))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    assert sum(r.kept for r in got.values()) > 40
    assert quality.judge(empty).count() == 0
    assert quality.base_counts("a #b\n\n x \na #b\n")[1:4] == (7, 2, 1)


def test_quality_verdict(spark):
    """kept by definition: quartiles of the language and size averaged with the script's, on texts of two languages."""
    rng = random.Random(10)
    word = {"en": lambda: rng.choice(["the", "of", "and", "house", "water", "people", "light"]) + rng.choice(["", "s", "ing"]), "xx": lambda: "".join(rng.choice("bcdfgxzq") for _ in range(6))}
    rows = [(k, " ".join((word["xx"] if k % 23 == 0 else word["en"])() for _ in range(60)), "en") for k in range(200)] + [(900, " ".join(word["xx"]() for _ in range(60)), "xx"), (901, None, "en"), (902, "", None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    pick = lambda v, q: sorted(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    good = [r for r in got.values() if not r.base_failed]
    size = lambda r: int(np.log2(max(r.n_words, 1)))
    for r in got.values():
        keep = not r.base_failed
        for c, least in zip(quality.MEASURES, quality.LEAST_RANGE, strict=True):
            if keep:
                own = [getattr(x, c) for x in good if x.band == r.band and size(x) == size(r)]
                all_ = [getattr(x, c) for x in good if size(x) == size(r)]
                a, b = ((len(own) * pick(own, q) + quality.SHRINK * pick(all_, q)) / (len(own) + quality.SHRINK) for q in (0.25, 0.75))
                reach = quality.REACH * max(b - a, least)
                keep &= (c == "byte_share" or getattr(r, c) >= a - reach) and (c == "entropy" or getattr(r, c) <= b + reach)
        assert r.kept == keep, r
    assert sum(not got[k].kept for k in range(0, 200, 23)) >= 8 and sum(got[k].kept for k in range(200) if k % 23) > 170


# 8: mixing


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    assert abs(sum(s[0].target for s in by.values()) - total) < 1e-6
    for s in by.values():
        assert abs(sum(r.taken for r in s) - s[0].target) <= 1 and s[0].target <= 3 * s[0].source_size + 1e-6
    assert sorted(map(tuple, ((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()))) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_texts(docs)
    words = mixed.select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).agg(F.sum("n")).first()[0]
    assert words == sum(r.taken for r in rows) and mixed.columns == docs.columns


def test_targets(spark):
    def of(sizes, weights):
        d = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, n long")
        return [r.target for r in mixing.targets(d, weights).orderBy("source").collect()]

    assert of([10, 10, 10], (5, 2, 1)) == [18.75, 7.5, 3.75]
    assert of([1, 100], (5, 1)) == [3.0, 98.0]
    assert of([0, 0], (5, 1)) == [0.0, 0.0]
    assert of([1, 2, 500, 3], (5, 2, 1)) == [3.0, 6.0, 488.0, 9.0]


def test_many_sources(spark, monkeypatch):
    """A source for each row or few: the same mix whether sources are broadcast or joined, and null last."""
    d = spark.createDataFrame([(k, "w " * (k % 7), None if k % 50 == 0 else f"h{k % 60}") for k in range(300)], "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(d).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.taken, r.target) for r in mixing.mix(d).collect()) == want


# 9: sharding


@pytest.mark.parametrize("limit", [500, 5000, 10**9])
def test_sharding(docs, limit):
    rows = sharding.shard(docs, limit).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
        assert r.shard == f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}"[: r.depth]
    alone = Counter(r.shard for r in rows)
    assert len(rows) == 60 and all(size[r.shard] == r.shard_bytes and (size[r.shard] <= limit or alone[r.shard] == 1) for r in rows)
    for s in size:  # only oversized buckets were split
        assert s == "" or sum(n for x, n in size.items() if x.startswith(s[:-1])) > limit


def test_sharding_equal_keys(spark, empty):
    d = spark.createDataFrame([(1, "x" * 100)] * 50 + [(2, "y")], "doc_id long, text string")
    rows = sharding.shard(d, 1000).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
    assert len(rows) == 51 and max(size.values()) <= 1100
    assert sharding.shard(empty).count() == 0


def test_write_shards(spark, tmp_path):
    """Rows stand where the manifest counts them, under the limit (but for less than a row), on any partitions; null ids and repeated rows too."""
    rows = [(1, f"{k % 30:03d}" * 30, "x") for k in range(200)] + [(None, "y" * 50, "x")] * 9 + [(k, "z" * 40, "own") for k in range(2, 90)] + [(7, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    at = str(tmp_path / "shards")
    manifest = Counter((r.doc_id, r.n_bytes, r.shard) for r in sharding.write_shards(d.repartition(3), at, 1000).collect())
    assert manifest == Counter((r.doc_id, r.n_bytes, r.shard) for r in sharding.shard(d.repartition(7), 1000).collect())
    back = spark.read.option("inferSchema", "false").schema("doc_id long, text string, shard string, _shard string").parquet(at).collect()
    assert Counter((r.doc_id, r.text, r.shard) for r in back) == Counter(rows)
    assert Counter((r.doc_id, len(r.text or ""), r._shard or "") for r in back) == manifest
    size = Counter()
    for r in back:
        size[r._shard] += len(r.text or "")
    assert max(size.values()) < 1000 + 90


# 10: urls


def test_urls(spark):
    html = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.com/en/1", ""),  # blocked by rule
        (2, "http://x.edu/p#frag", html.format("http://a.com/en/1")),  # alias of 1
        (3, "http://y.edu/q", '<meta http-equiv="refresh" content="0; url=http://x.edu/p">'),  # alias of an alias
        (4, "http://z.edu/", html.format("http://Www.Example.com/en/77")),  # alias of an allowed url
        (5, "http://w.edu/", html.format("/other")),
        (6, None, None),
        (7, "no scheme", ""),
        (8, "https://EXAMPLE.com/en/71?x#y", ""),
        (9, "http://notexample.com/en/7", ""),
        (10, "http://b.example.net/de/8", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.alias_edges(df)).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert [got[k][3] for k in (2, 3, 4, 5, 6, 7)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert got[6][:3] == ("", "", None) and got[8][2:] == ("example.com/en/7", "allow")
    assert got[9][2] == "com/en/" and got[10][2:] == ("example.net/de/8", "block")


# pipeline


def test_stages_tell_rows_apart(spark):
    """Null and repeated ids: every different text goes through the stages, and the smallest row of near copies stays."""
    rng = random.Random(4)
    t = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(7)]
    rows = [(1, t[0]), (1, t[1]), (1, t[1]), (2, t[0] + " more"), (2, t[2]), (None, t[3]), (None, t[4]), (None, t[2] + " end"), (3, t[5]), (None, None), (4, "")]
    d = spark.createDataFrame([(i, x, "en", "a", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = {(1, t[0]), (1, t[1]), (2, t[2]), (None, t[3]), (None, t[4]), (3, t[5]), (4, "")}
    kept = simhash.keep_one(d)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    twice = spark.createDataFrame([(1, t[0]), (1, t[1]), (None, t[2]), (None, t[3] + " " + t[0]), (None, None), (5, t[0])], "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in suffix_dedup.without_repeats(twice).collect()]
    assert {x for i, x in left if i is None} >= {None, t[2]} and len([x for i, x in left if i == 1]) >= 1
    assert len({x for _, x in left if x and (t[1] in x or t[2] in x or t[3] in x)}) == 3 and sum(t[0] in (x or "") for _, x in left) == 1
    same = spark.createDataFrame([(None, "a b c", "s"), (None, "d e f", "s"), (1, "g h i", "s"), (1, "j k l", "s"), (1, "m n o", "z")], "doc_id long, text string, source string")
    mixed = mixing.mixed_texts(same)
    taken = Counter(w for r in mixed.collect() for w in r.text.split())
    assert sum(taken.values()) == sum(r.taken for r in mixing.mix(same).collect())


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = base
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == base.columns
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.WINDOW
