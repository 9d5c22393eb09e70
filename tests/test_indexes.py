"""Indexes and radius searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivana.operators import hamming as H
from scrivana.operators import retrieval as R
from scrivana.operators import text_index as X
from scrivana.operators import vector_index as I
from scrivana.store import new_path, placed


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# BM25


def texts(n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    return [(["t1", "t1", "t2"][k % 3], k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for k in range(n)] + [("t1", 900, None), ("t1", 901, ""), (None, 902, "w1 w2"), ("t3", 903, "w5"), ("t1", 904, "w0 " * 500)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(texts(), "user_id string, id long, content string").repartition(5).cache()


@pytest.mark.parametrize("block", [3, 128])
def test_text_index(spark, corpus, block, monkeypatch):
    """The index finds what scoring every text finds, whatever its blocks."""
    monkeypatch.setattr(X, "BLOCK", block)
    rng = random.Random(2)
    asked = [(["t1", "t2", "t3", "t4"][k % 4], 1000 + k, " ".join(rng.choices([f"w{x}" for x in range(310)], k=rng.randrange(0, 9))) + " w0 W1") for k in range(40)] + [("t1", 2000, ""), ("t1", 2001, None), ("t1", 2002, "w0 w0 w0")]
    q = spark.createDataFrame(asked, "user_id string, qid long, query string")
    path = new_path(spark, "test-index")
    built = X.build_text_index(corpus, path)
    want = rows(R.bm25(corpus, q))
    assert rows(X.search_text(built, q)) == want and len(want) > 100
    again = X.open_text_index(spark, path)
    assert rows(X.search_text(again, q, 3)) == rows(R.bm25(corpus, q, 3))


def test_text_index_skips(spark, corpus):
    """A query of a common and a rare word does not open all of the common one's texts."""
    index = X.build_text_index(corpus.where("user_id = 't1'"), new_path(spark, "test-index"))
    q = spark.createDataFrame([("t1", 1, "w0 w150 w151 w152")], "user_id string, qid long, query string")
    terms = X.asked_terms(index, q)
    met = corpus.where("user_id = 't1'").select("id", F.explode(F.array_distinct(F.split("content", " "))).alias("tok")).join(terms.select("tok"), "tok").select("id").distinct().count()
    assert X.candidates(index, terms).count() < met / 4
    assert rows(X.search_text(index, q)) == rows(R.bm25(corpus, q))


def test_text_index_empty(spark, corpus):
    index = X.build_text_index(corpus.where("false"), new_path(spark, "test-index"))
    q = spark.createDataFrame([("t1", 1, "w0")], "user_id string, qid long, query string")
    assert X.search_text(index, q).count() == 0


# vectors


def vectors(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(8, dim))[rng.integers(8, size=n)]
    x[100:160] = x[7]  # one very common vector
    return [(int(i), ["a", "a", "b"][i % 3], [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]


def nearest(data, asked, k):
    out = []
    x = {t: (np.array([r[0] for r in data if r[1] == t]), np.array([r[2] for r in data if r[1] == t])) for t in "ab"}
    for i, t, v in asked:
        ids, m = x[t]
        d = np.round(((m - np.array(v)) ** 2).sum(axis=1), 6)
        out += [(i, int(ids[j]), float(d[j]), n + 1) for n, j in enumerate(np.lexsort((ids, d))[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile", [(4096, 1024), (50, 7)])
def test_tiled_nearest(spark, tile, monkeypatch):
    monkeypatch.setattr(I, "TILE_ROWS", tile[0])
    monkeypatch.setattr(I, "TILE_QUERIES", tile[1])
    data = vectors(600)
    v = spark.createDataFrame([*data, (9000, "a", None)], "id long, user_id string, v array<float>")
    asked = [r for r in data if r[0] % 20 == 0]
    q = spark.createDataFrame([*asked, (9001, "a", None), (9002, "none", data[0][2])], "qid long, user_id string, q array<float>")
    assert rows(I.tiled_nearest(v, q, ["user_id"], 5)) == nearest(data, asked, 5)


def test_vector_index(spark):
    """Every row is indexed, recall at five is 0.9 or more, and only a part of all rows is compared."""
    data = vectors()
    v = spark.createDataFrame(data, "id long, user_id string, v array<float>").repartition(4)
    index = I.fit_index(v, rows=1500)
    assigned = index.assign(v).cache()
    assert assigned.count() == len(data) and index.probe < len(index.centres)
    asked = [r for r in data if r[0] % 20 == 0]
    q = spark.createDataFrame(asked, "qid long, user_id string, q array<float>")
    got = rows(index.search(assigned, q, 5, ["user_id"]))
    want = nearest(data, asked, 5)
    assert len({x[:2] for x in got} & {x[:2] for x in want}) / len(want) >= 0.9
    assert rows(index.search(assigned, q, 5, ["user_id"], probe=len(index.centres))) == want
    share = assigned.groupBy("cell").count().agg(F.max("count")).first()[0] / len(data)
    assert share < 0.5
    none = v.where("false")
    assert I.fit_index(none).search(I.fit_index(none).assign(none), q, by=["user_id"]).count() == 0


def test_index_recall_of_the_query(spark):
    from scrivana.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    exact, found = ({(r.qid, r.id) for r in QUERIES[n](spark, sf).collect()} for n in ("vector_topk", "vector_index_topk"))
    assert len(exact & found) / len(exact) >= 0.9


# hashes


def hashes(n=300, seed=4):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(30)]
    out = []
    for k in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(14)):
            h ^= 1 << rng.randrange(64)
        out.append((k, h - (1 << 64) if h >> 63 else h))
    return out + [(1000, None), (1001, out[3][1]), (1002, out[3][1])]


@pytest.mark.parametrize(("radius", "blocks"), [(10, 4), (3, 4), (10, 6), (0, 2)])
def test_radius_search(spark, radius, blocks, monkeypatch):
    monkeypatch.setattr(H.near_hashes, "__defaults__", ((), blocks))
    data = hashes()
    df = spark.createDataFrame(data, "id long, h long")
    asked = [r for r in data if r[0] % 20 == 0]
    classes = {}
    for i, h in data:
        if h is not None:
            classes.setdefault(h, []).append(i)
    want = sorted((a, min(ids), len(ids), n) for a, g in asked if g is not None for h, ids in classes.items() if (n := ((g ^ h) & (2**64 - 1)).bit_count()) <= radius)
    assert rows(H.radius_search(spark.createDataFrame(asked, "a long, h long"), df, radius)) == want


def pages(n=500, seed=5):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    out = []
    for k in range(n):
        h = rng.choice(base)
        for _ in range(rng.randrange(12)):
            h ^= 1 << rng.randrange(64)
        out.append((k % 3, k // 3, f"{h:016x}" if rng.random() > 0.05 else rng.choice([None, "", "xyz"])))
    out += [(1, 500 + k, out[4][2]) for k in range(40)]
    rng.shuffle(out)
    return out


def clusters(data):
    out = []
    for doc in {d for d, *_ in data}:
        leaders = []
        for _, page, h in sorted((r for r in data if r[0] == doc), key=lambda r: r[1]):
            v = int(h, 16) if h and h != "xyz" else None
            hit = next((k for k, x in enumerate(leaders) if v is not None and x is not None and (v ^ x).bit_count() <= 10), None)
            if hit is None:
                leaders.append(v)
                hit = len(leaders) - 1
            out.append((doc, page, hit))
    return sorted(out)


@pytest.mark.parametrize("fold", [1000, 180, 0])
def test_leader_clusters(spark, fold):
    data = pages()
    df = spark.createDataFrame(data, "doc long, page int, phash string").repartition(4)
    assert rows(H.leader_clusters(df, fold=fold)) == clusters(data)


def test_leader_chain(spark):
    """Each page is near the one before it only, so every second one leads."""
    data = [(1, k, f"{(1 << (6 * k // 2 if k < 20 else 60)) - 1:x}") for k in range(18)]
    df = spark.createDataFrame(data, "doc long, page int, phash string")
    assert rows(H.leader_clusters(df, 3, fold=0)) == rows(H.leader_clusters(df, 3))


def test_placed(spark):
    data = [(k % 3 if k > 50 else 9, k) for k in range(200)]
    random.Random(6).shuffle(data)
    got = rows(placed(spark.createDataFrame(data, "key long, x long"), "key", [F.col("x")], "place"))
    want = sorted((key, x, sum(1 for a, b in data if a == key and b <= x)) for key, x in data)
    assert got == want
