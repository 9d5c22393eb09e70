"""Searches that return every pair or a file's whole lists do so."""

import random

from pyspark.sql import functions as F

import scrivana.plans.views  # noqa: F401
from scrivana.operators import hamming as H
from scrivana.operators import vector_index as I
from scrivana.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(I, "PAIR_ROWS", 40)
    monkeypatch.setattr(I, "PAIR_QUERIES", 3)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    n, asked = e.count(), e.where("vec_id % 20 = 0").count()
    got = QUERIES["cosine_pairs"](spark, SF)
    assert set(got.columns) == {"a", "b", "cosine"} and got.count() == n * asked and got.select("a", "b").distinct().count() == n * asked


def test_all_distances(spark, monkeypatch):
    monkeypatch.setattr(H, "TILE", 30)
    rng = random.Random(1)
    rows = [(k, rng.getrandbits(63) if k % 9 else None) for k in range(200)] + [(200 + k, 5) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, h long")
    got = sorted(((r.a, r.b, r.bits) for r in H.all_distances(df.where("id % 20 = 0").select(F.col("id").alias("a"), "h"), df).collect()), key=str)
    want = sorted(((a, b, None if g is None or h is None else (g ^ h).bit_count()) for a, g in rows if a % 20 == 0 for b, h in rows), key=str)
    assert got == want


def test_image_lists(spark):
    r = QUERIES["image_sets"](spark, SF)
    assert {"images", "n_images", "first_ids", "chunks"} <= set(r.columns)
    assert r.agg(F.sum("chunks")).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_megabytes_of_exact_halves(spark):
    """6.25 MB and 18.75 MB are halves in binary too: printf gives 6.2 and 18.8."""
    import duckdb
    from scrivana.functions.views import megabytes

    sizes = [k * 6553600 for k in range(1, 6)] + [0, 1, 52428, 52429, 157286, 104857600, 999999999999]
    got = [r.m for r in spark.createDataFrame([(n,) for n in sizes], "n long").coalesce(1).select(megabytes(F.col("n")).alias("m")).collect()]
    assert got == [duckdb.execute("select printf('%.1fMB', ? / 1048576.0)", [n]).fetchone()[0] for n in sizes] and got[0] == "6.2MB"


def test_order_of_distances(spark, monkeypatch):
    """A row's pairs with the asked rows of a tile lie together: Parquet then stores ids in runs, and the pairs at half the bytes."""
    monkeypatch.setattr(H, "TILE", 64)
    ids = spark.range(1000).select("id", F.xxhash64("id").alias("h"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for larger tables
    try:
        got = H.all_distances(ids.where("id % 20 = 0").select(F.col("id").alias("a"), "h"), ids).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    tiles = -(-50 // 16)  # of asked rows
    assert len(got) == 50_000 and sum(x.b != y.b for x, y in zip(got, got[1:], strict=False)) < 1000 * tiles


def test_order_of_cosines(spark, monkeypatch):
    """A part's pairs lie in order of their cosine, whole and once, also where a tile is several parts and a part several batches."""
    monkeypatch.setattr(I, "PAIR_ROWS", 60)
    monkeypatch.setattr(I, "PAIR_QUERIES", 20)
    monkeypatch.setattr(I, "PART_PAIRS", 300)
    monkeypatch.setattr(I, "BATCH_PAIRS", 70)
    rng = random.Random(2)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(3)]) for k in range(300)] + [(300, [0.0] * 3), (301, None)]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    got = I.tiled_cosines(v, v.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))).collect()
    size = lambda x: sum(y * y for y in x) ** 0.5 or 1.0
    want = {(a, b): sum(x * y for x, y in zip(p, q, strict=True)) / size(p) / size(q) for a, p in rows if a % 5 == 0 and p for b, q in rows if q}
    assert len(got) == len(want) and all(abs(want[r.qid, r.id] - r.cosine) < 1e-6 for r in got)
    assert sum(x.cosine > y.cosine for x, y in zip(got, got[1:], strict=False)) < len(got) / 50
