"""Streams against their batch forms, across restarts and replays."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivana.operators import chunks as C
from scrivana.operators import notes as N
from scrivana.streaming import keyed
from scrivana.streaming.stateful import blacklisted, cache_aside, cache_reads


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def played(spark, tmp_path, make, tables: dict[str, tuple[list, str]], parts: int = 4):
    """Rows of each table dealt in order into ``parts`` files; half of them are streamed, the query ends, and another goes on from its checkpoint."""
    def put(lo, hi):
        for name, (data, kind) in tables.items():
            size = -(-len(data) // parts)
            for k in range(lo, hi):
                spark.createDataFrame(data[size * k : size * (k + 1)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    out = str(tmp_path / "out")
    for lo, hi in ((0, parts // 2), (parts // 2, parts)):
        put(lo, hi)
        streams = {n: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, (_, kind) in tables.items()}
        q = make(**streams).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    return spark.read.parquet(out)


def test_blacklist(spark, tmp_path):
    rng = random.Random(1)
    times = sorted(rng.sample(range(1000, 9000), 200))
    asked = [(rng.choice("abc"), t, n) for n, t in enumerate(times)]
    listed = [(rng.choice("abc"), t, rng.choice([5, 50, 400])) for t in sorted(rng.sample(range(1000, 9000), 24))]
    kinds = "token string, at long, seq long", "token string, at long, ttl_s long"
    want = rows(blacklisted(spark.createDataFrame(asked, kinds[0]), spark.createDataFrame(listed, kinds[1])))
    # both are dealt by time, so no batch holds an entry that a batch before should have known
    cut = [2000 * k + 1000 for k in range(5)]
    even = lambda data, pad: [r for k in range(4) for r in ([x for x in data if cut[k] <= x[1] < cut[k + 1]] + [pad(k)] * 99)[:99]]
    asked_, listed_ = even(asked, lambda k: ("none", cut[k], 10**6)), even(listed, lambda k: ("none", cut[k], 0))
    got = played(spark, tmp_path, lambda asked, listed: keyed.blacklisted_stream(asked, listed, "3000 seconds"), {"asked": (asked_, kinds[0]), "listed": (listed_, kinds[1])})
    assert rows(got.where("token != 'none'")) == want and {r[3] for r in want} == {True, False}


def test_cache(spark, tmp_path):
    rng = random.Random(2)
    data = [(rng.choice("abc"), t, n, rng.choice([None, "x", "y"])) for n, t in enumerate(sorted(rng.choices(range(1000, 9000), k=200)))]
    kind = "key string, at long, seq long, value string"
    batch = cache_aside(spark.createDataFrame(data, kind), 300, 60)
    state = {}
    plain = []
    for key, at, seq, value in data:
        until, held = state.get(key, (0, None))
        hit = at < until
        if not hit:
            held = value
            state[key] = (at + (60 if value is None else 300), value)
        plain.append((key, at, seq, hit, held))
    text = lambda found: sorted(map(str, found))
    assert text(map(tuple, batch.collect())) == text(plain)
    got = played(spark, tmp_path, lambda reads: keyed.cache_aside_stream(reads, 300, 60), {"reads": (data, kind)})
    assert text(map(tuple, got.collect())) == text(plain)
    same = cache_aside(spark.createDataFrame(data, kind).withColumn("value", F.lit("v")), 300).drop("value")
    assert rows(same) == rows(cache_reads(spark.createDataFrame(data, kind), 300))


def test_due_reviews(spark, tmp_path):
    rng = random.Random(3)
    start, day = 1_700_000_000, 86_400
    data = [(rng.choice("ab"), rng.randrange(4), float(start + t * day / 4 + rng.random())) for t in sorted(rng.sample(range(400), 80))]
    kind = "user_id string, note_id long, at double"
    at = lambda df: df.withColumn("at", F.timestamp_seconds("at"))
    want = N.due_history(at(spark.createDataFrame(data, kind))).select("user_id", "note_id", "review_count", F.unix_micros("next_at"))
    late = [("z", 0, float(start + 900 * day))] * 20  # moves the watermark past every date
    got = played(spark, tmp_path, lambda reviews: keyed.due_stream(at(reviews)), {"reviews": ([*data, *late], kind)}, parts=5)
    got = rows(got.where("user_id != 'z'"))
    assert got == rows(want) and len(got) == len(set(got)) > 10


def test_ingest(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.choice(["u", "v"]), n, rng.choice(["one", "two ", "three", "four", "five"]) * rng.choice([1, 90]), float(1000 + n)) for n in range(40)] + [("u", 99, "", 1100.0)]
    kind = "user_id string, id long, content string, at double"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")

    def run(checkpoint):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source).withColumn("at", F.timestamp_seconds("at"))
        keyed.ingest_stream(stream, store).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(300)

    for k in range(4):
        spark.createDataFrame(data[11 * k : 11 * k + 11], kind).coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            run("cp")
    read = lambda name: spark.read.parquet(f"{store}/{name}")
    state = lambda: (rows(read("registry")), rows(read("chunks")))
    before = state()
    registered = [(r.user_id, r.md5) for r in read("registry").collect()]
    assert len(registered) == len(set(registered)) == len({(u, c) for u, _, c, _ in data})
    texts = {i: c for _, i, c, _ in data}
    assert {r.id: r.content for r in C.seamless(read("chunks").withColumnRenamed("id", "doc")).withColumnRenamed("doc", "id").collect()} == {r.id: texts[r.id] for r in read("registry").collect() if texts[r.id]}
    # a replayed batch, and a stream that begins anew, leave the store as it is
    first = spark.createDataFrame(data[:11], kind).withColumn("md5", F.md5("content"))
    number = read("registry").where(F.col("id") == read("registry").agg(F.min("id")).first()[0]).first()["batch"]
    again = first.where(F.col("id").isin([r.id for r in read("registry").where(F.col("batch") == number).collect()]))
    keyed.put_batch(again, number, store)
    assert state() == before


def merged(docs):
    import hashlib
    import re

    out = []
    for d, texts in docs.items():
        parts, vec, n = [], None, 0
        for k, t in enumerate(texts):
            v = np.zeros(C.PLACES)
            for w in re.split(r"[\W_]+", (t or "").lower()):
                if w:
                    v[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % C.PLACES] += 1
            if parts and (s := np.linalg.norm(vec) * np.linalg.norm(v)) > 0 and vec @ v / s > 0.7 + 1e-12:
                parts.append((k, t))
                vec = vec + v
                continue
            if parts:
                out.append((d, n, parts[0][0], len(parts), " ".join(p[1] or "" for p in parts)))
                n += 1
            parts, vec = [(k, t)], v
        if parts:
            out.append((d, n, parts[0][0], len(parts), " ".join(p[1] or "" for p in parts)))
    return sorted(out)


def test_merge_alike(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta epsilon".split()
    docs = {d: [" ".join(rng.choices(words, [5, 3, 1, 1, 1] if rng.random() < 0.7 else [1, 1, 1, 5, 5], k=8)) for _ in range(rng.randrange(1, 15))] for d in range(30)}
    docs[3] = [None, "", "alpha", "alpha alpha", "...", "beta"]
    data = [(d, k, t) for d, ts in docs.items() for k, t in enumerate(ts)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc long, chunk_index int, content string").repartition(5)
    got = rows(C.merge_alike(df))
    assert got == merged(docs) and any(r[3] > 2 for r in got)
    assert C.merge_alike(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a" * 500, "abcab" * 130, "x" * 19, "", "one two " * 100, "é中" * 300])
def test_seams(spark, text):
    from scrivana.functions.text import windows

    chunks = spark.createDataFrame([(1, text)], "doc long, t string").select("doc", F.posexplode(windows(F.col("t"))).alias("chunk_index", "content"))
    got = C.seamless(chunks).collect()
    assert [r.content for r in got] == ([text] if text else [])
