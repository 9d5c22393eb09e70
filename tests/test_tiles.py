"""Searches in tiles: the whole result, and nothing shuffled that grows with the pairs of queries and texts."""

import math
import random
import re
from collections import Counter

import pytest

from scrivana.operators import retrieval as R
from scrivana.operators import text_index as X
from scrivana.operators import text_tiles as S
from scrivana.store import new_path


def shuffled(spark, run):
    """Rows that the jobs of ``run`` write to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(f"count-{random.random()}", "")
    group = sc.getLocalProperty("spark.jobGroup.id")
    out = run()
    sc._jsc.clearJobGroup()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def plain(texts, queries, k=5):
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    out = []
    for user, qid, query in queries:
        mine = [(i, Counter(split(t))) for u, i, t in texts if u == user]
        avgdl = sum(sum(c.values()) for _, c in mine) / len(mine) if mine else 0
        score = Counter()
        for tok in set(split(query)):
            df = sum(tok in c for _, c in mine)
            for i, c in mine:
                if tok in c:
                    score[i] += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * c[tok] * 2.5 / (c[tok] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avgdl))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:k]
        out += [(qid, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("texts", "queries", "share"), [(2048, 2048, 0.005), (13, 7, 2.0), (50, 4, 0.0)])
def test_bm25_of_any_tiles(spark, monkeypatch, texts, queries, share):
    for name, value in (("TILE_TEXTS", texts), ("TILE_QUERIES", queries), ("DENSE_SHARE", share), ("DENSE_TOKENS", 9)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(5)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 90}"
    rows = [(["a", "b"][k % 3 == 0], k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(200)] + [("a", 300 + k, "w1 w2 W3!w3") for k in range(40)] + [("a", 400, None), ("c", 401, "")]
    asked = [(["a", "b", "c", "d"][k % 4], k, " ".join(word() for _ in range(rng.randrange(0, 30)))) for k in range(40)]
    t, q = spark.createDataFrame(rows, "user_id string, id long, content string"), spark.createDataFrame(asked, "user_id string, qid long, query string")
    got = sorted((r.qid, r.id, round(r.score, 6), r["rank"]) for r in R.bm25(t, q).collect())
    assert got == plain(rows, asked) and len(got) > 80
    index = X.build_word_index(t, new_path(spark, "test-words"))
    assert sorted((r.qid, r.id, round(r.score, 6), r["rank"]) for r in X.search_words(index, q).collect()) == got


def test_bm25_shuffles_no_pairs(spark):
    """600 texts and 200 queries of the same 30 words meet in 120,000 pairs."""
    rng = random.Random(6)
    some = lambda: " ".join(rng.choices([f"w{k}" for k in range(30)], k=10))
    t = spark.createDataFrame([("a", k, some()) for k in range(600)], "user_id string, id long, content string")
    q = spark.createDataFrame([("a", k, some()) for k in range(200)], "user_id string, qid long, query string")
    found, rows = shuffled(spark, lambda: R.bm25(t, q).collect())
    assert len(found) == 1000 and 0 < rows < 30_000


def test_tokens_are_hashed_once_a_batch(monkeypatch):
    import pyarrow as pa

    from scrivana.operators import chunks as C

    asked = []
    monkeypatch.setattr(C, "_place", lambda t, n: asked.append(t) or len(t) % n)
    toks = pa.array([["a", "bb", "a"], [], ["bb", "bb"]] * 500, pa.list_(pa.string()))
    assert C.term_vectors(toks, 4).tolist() == [[0, 2, 1, 0], [0, 0, 0, 0], [0, 0, 2, 0]] * 500 and sorted(asked) == ["a", "bb"]
    assert C.term_vectors(toks[:0], 4).shape == (0, 4) and C.term_vectors(toks.slice(1, 2), 4).tolist() == [[0, 0, 0, 0], [0, 0, 2, 0]]


def test_tasks_write_files_in_place(spark, tmp_path):
    """A file a text, equal ones too (a null tenant's is there, but no tenant reads it), named by what it holds; no process, checksum or move for each."""
    from scrivana.sources.uploads import store_texts, uploads

    t = spark.createDataFrame([("u1", "one"), ("u1", "one"), ("u2", "two"), ("u2", None), ("u2", ""), ("a/b", "x"), (None, "y")], "user_id string, content string").repartition(3)
    assert store_texts(t, str(tmp_path / "x")) == 7
    want = [("a%2Fb", "x\n"), ("u1", "one\n"), ("u1", "one\n"), ("u2", "\n"), ("u2", "\n"), ("u2", "two\n")]
    assert sorted(tuple(r) for r in uploads(spark, str(tmp_path / "x")).select("user_id", "content").collect()) == want
    files = sorted(p.name for p in (tmp_path / "x").rglob("*") if p.is_file())
    assert len(files) == 7 and all(re.fullmatch(r"[0-9a-f]{32}-[12]\.txt", f) for f in files)
    assert store_texts(t, str(tmp_path / "x")) == 7 and sorted(p.name for p in (tmp_path / "x").rglob("*") if p.is_file()) == files
    assert store_texts(t.where("false"), str(tmp_path / "y")) == 0
