"""Importance resampling, byte-level BPE and the prefix trie against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.llm import byte_bpe, prefix_trie, resampling

# 11: importance resampling

DOCS = "doc_id long, text string, score string, rank string, before string, n_words string"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "straße", "中文", "x1", "ÀB", "dog's", "e.g.", "naïve"]
    rows = [(k, " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n", "-y"]) for _ in range(rng.randrange(60)))) for k in range(n)]
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (3, "another text under one id " * 9), (None, "no id here " * 30), rows[5], rows[5], (1003, "many Words " * 40_000)]
    return [(*r, "a", "b", "c", "d") for r in rows]


TARGET = [("beta beta ÀB straße",), (None,), ("x1 naïve. dog's",)]


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(w.encode()) % 10000 for w in words] + [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(words, words[1:])]


def resampled(rows, target):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for (x,) in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, text, *_ in rows:
        words, fs = features(text)
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    may = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = may[: 25 * len(may) // 100]
    return out, drawn


def test_resampling(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    target = spark.createDataFrame(TARGET, "text string")
    want, drawn = resampled(rows, TARGET)
    got = [tuple(r) for r in resampling.ranked(docs, target).select("__k0", "n_features", "weight", "score", "n_words", "rank").collect()]
    assert Counter(g[:5] for g in got) == Counter(want)
    mine = sorted((g for g in got if g[5] is not None), key=lambda g: g[5])
    assert [g[:5] for g in mine] == drawn and [g[5] for g in mine] == list(range(1, len(drawn) + 1))
    kept = resampling.resample(docs, target)
    assert kept.columns == docs.columns and sorted(str(r[0]) for r in kept.collect()) == sorted(str(d[0]) for d in drawn)


def test_resampling_empty(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame(TARGET, "text string")
    assert resampling.ranked(none, target).count() == 0 and resampling.resample(none, target).count() == 0
    rows = corpus(30)
    want, _ = resampled(rows, [])
    got = resampling.ranked(spark.createDataFrame(rows, DOCS), target.where("false")).select("__k0", "n_features", "weight", "score", "n_words").collect()
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("grams", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 7, 50, 10**6])
def test_feature_slices(grams, size):
    text = ("The CAT sat on, the mat  straße 中文 x " * 5).encode()
    words = text.translate(resampling.LOWER).split()
    want = Counter(zlib.crc32(b" ".join(words[k : k + g])) for g in range(1, grams + 1) for k in range(len(words) - g + 1))
    got = list(resampling.features(text, grams, size))
    assert sum(n for n, _ in got) == len(words) and Counter(c for _, cs in got for c in cs) == want


# 12: byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    with open(byte_bpe.vocabulary_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(vocab, n=300, seed=2):
    rng = random.Random(seed)
    odd = [b" ", b"  ", b"\n", b"\r\n", b"\x1c", b"!", b"'s", b"'", b".", b"a", " ".encode(), "　".encode(), "🎉".encode(), "é".encode()]
    return [b"".join(rng.choice(vocab) if rng.random() < 0.5 else rng.choice(odd) for _ in range(rng.randrange(60))).decode("utf-8", "ignore") for _ in range(n)]


@pytest.mark.parametrize("size", [30, 1 << 18])
def test_byte_bpe_ids(encoding, size, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", size)
    ranks, enc = encoding
    codec = byte_bpe.ByteBpe(byte_bpe.vocabulary_path(), keep=500)
    all_ = texts(list(ranks)) + ["", " ", "a" * 5000, "ab " * 3000, "\n" * 400, "=" * 700 + "x", "中" * 900]
    got = codec.encode(all_)
    for t, g in zip(all_, got, strict=True):
        want = enc.encode_ordinary(t)
        assert np.frombuffer(g, "<u4").tolist() == want, t
        assert codec.decode(g) == t.encode()
        ids, starts, ends = codec.offsets(t)
        assert ids == want
        raw, at, n = t.encode(), 0, 0  # each id's bytes lie within the characters of its offsets
        before = [len(t[:k].encode()) for k in range(len(t) + 1)]
        for i, a, b in zip(ids, starts, ends, strict=True):
            n = len(codec.bytes[i])
            assert before[a] <= at and at + n <= before[b] and (a == b - 1 or before[a] == at or before[b] == at + n or before[a + 1] > at)
            at += n
        assert at == len(raw)


def test_byte_bpe_tables(spark, encoding):
    ranks, enc = encoding
    rows = [(k, t, "x", "y", "z") for k, t in enumerate(texts(list(ranks), 60))] + [(500, None, "", "", ""), (500, "", "", "", ""), (None, "same", "", "", ""), (7, "same", "", "", ""), (8, "word " * 200_000, "", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string, starts string").repartition(3)
    tokens = byte_bpe.encode(docs)
    back = byte_bpe.decode(tokens).select("*", byte_bpe.as_text().alias("shown")).collect()
    want = Counter((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode(), t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded), r.shown) for r in back) == want
    spans = byte_bpe.encode(docs, offsets=True).where("doc_id = 8").first()
    assert len(spans.starts) == len(spans.ends) == len(spans.ids) // 4 and spans.ends[-1] == 1_000_000
    assert byte_bpe.encode(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(None,), (bytearray(b"\xff\xff\xff\xff"),), (bytearray(),)], "ids binary")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(odd.coalesce(1)).collect()] == [None, None, b""]


def test_split_character(encoding):
    codec = byte_bpe.ByteBpe(byte_bpe.vocabulary_path())
    for c in ("🧿", "𒀀", "ꙮ"):
        ids, starts, ends = codec.offsets(c)
        assert len(ids) > 1 and set(starts) == {0} and set(ends) == {1}
        assert codec.decode(np.array(ids, "<u4").tobytes()).decode() == c


# 13: prefix trie


def trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"")
    end = {p: ",".join(str(c) for c in m if len(full[c]) == len(p)) for p, m in members.items()}
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(end[p].encode()).hexdigest()) for p, m in members.items())


def talks(seed=3, n=160, most=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for k in range(rng.choice([1, 2, 5, 8, most])):
            rows.append((c, k, rng.choice(["user", "assistant"]) if rng.random() < 0.05 else "user", rng.choice(["hi", "hé", "long text " * 3]) if rng.random() < 0.3 else "so"))
    rows += [(3, None, None, None), (3, None, "user", None), (4, 1, "user", "so"), (4, 1, "user", "so"), (None, 0, "user", "so"), (2000, 0, "user", "lone")]
    rng.shuffle(rows)
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("piece", "most"), [(None, 1000), (40, 1000), (40, 0), (7, 1000)])
def test_prefix_trie(spark, piece, most):
    rows = talks()
    t = spark.createDataFrame(rows, TALK).withColumns({c: F.lit("clash") for c in ("depth", "n_convs", "h0", "id", "at", "base")}).repartition(6)
    got = Counter(map(tuple, prefix_trie.prefix_trie(t, piece, most).collect()))
    assert got == trie(rows)


def test_prefix_trie_long(spark):
    """One conversation of most rows, and many copies of another."""
    rows = [(5, k, "user", f"t{k % 7}") for k in range(3000)] + [(c, k, "user", f"u{k}") for c in range(100, 400) for k in range(4)] + [(6, k, "user", f"t{k % 7}") for k in range(2900)]
    t = spark.createDataFrame(rows, TALK).repartition(8)
    assert Counter(map(tuple, prefix_trie.prefix_trie(t, 3000).collect())) == trie(rows)


def test_prefix_trie_empty(spark):
    none = spark.createDataFrame([], TALK)
    assert prefix_trie.prefix_trie(none).count() == 0
    rows = [(1, 0, "user", "a")]
    assert Counter(map(tuple, prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK)).collect())) == trie(rows)


@pytest.mark.parametrize("shape", ["path", "star", "random", "bush"])
def test_centroids(shape):
    rng = random.Random(4)
    n = 700
    parent = [-1] + [{"path": k - 1, "star": 0, "random": rng.randrange(k), "bush": max(0, k - rng.randrange(1, 9))}[shape] for k in range(1, n)]
    parent += [-1, n, n, -1]
    values = [[rng.randrange(100) for _ in parent], [1] * len(parent)]
    want = [list(v) for v in values]
    for v in range(len(parent) - 1, -1, -1):
        if parent[v] >= 0:
            for w in want:
                w[parent[v]] += w[v]
    assert prefix_trie.decompose(parent, values) == want
