"""Results that must not depend on partitions, other columns or repeats."""

import random

import numpy as np
from pyspark.sql import functions as F

from scrivana.llm import mixing, quality, simhash, suffix_dedup, packing, toxicity

MEASURED = "band string, script string, size int, base_failed boolean, chars_per_token double, byte_share double, entropy double"


def measured(n=4000, seed=1):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de"]), "Latn", rng.choice([3, 4]), rng.random() < 0.1, rng.gauss(3, 0.3), abs(rng.gauss(0, 0.05)), rng.gauss(0.8, 0.04)) for _ in range(n)] + [("xx", "Latn", 3, False, None, 0.0, 0.9)]


def test_bands_do_not_depend_on_partitions(spark):
    rows = measured()
    found = [sorted(map(tuple, quality.bands(spark.createDataFrame(rows, MEASURED).repartition(n)).collect())) for n in (1, 3, 29)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5


def test_quartiles(spark):
    rows = [r for r in measured() if not r[3]]
    counts = [("en", r[2], 0, round(r[4] * quality.STEPS), 1) for r in rows if r[0] == "en" and r[4] is not None]
    df = spark.createDataFrame(counts, "script string, size int, m int, step long, k long")
    df = df.unionByName(df.withColumns({"m": F.lit(1)})).unionByName(df.withColumns({"m": F.lit(2)}))
    for r in quality._quartiles(df, ["script", "size"]).collect():
        mine = sorted(c[3] for c in counts if c[1] == r["size"])
        want = [mine[int(np.ceil(p * len(mine))) - 1] / quality.STEPS for p in (0.25, 0.5, 0.75)]
        assert r["chars_per_token"] == want and r["byte_share"] == want


def test_stages_with_clashing_columns(spark):
    rows = [(k, "some words of text " * (1 + k % 7) + str(k), "en", ["a", "b", None][k % 3], 10) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({c: F.lit("x") for c in ("taken", "rows", "key", "node", "size", "tie", "target", "s", "score", "component")})
    for stage in (mixing.mixed_texts, simhash.keep_one, suffix_dedup.without_repeats):
        one, two = (sorted(tuple(r[c] for c in docs.columns) for r in stage(d).collect()) for d in (docs, clash))
        assert [tuple(map(str, r)) for r in one] == [tuple(map(str, r)) for r in two]
    assert packing.pack(clash).count() == packing.pack(docs).count()


def test_a_training_row_repeated(spark, monkeypatch):
    """A chosen id that stands in thousands of rows is collected once."""
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, **_: seen.append((texts, labels)))
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(12)] + [(4, "text 4")] * 3000 + [(4, "text 40"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    texts, marks = seen[0]
    assert len(texts) == len(set(texts)) == len(marks) and "text 40" in texts and "text 4" not in texts
