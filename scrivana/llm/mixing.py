"""Mixing sources to target weights.

Method: hash-random keys, a range sort within each source, distributed prefix sums of sizes, and
a cut at each source's exact budget, after whole epochs where the budget exceeds the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import WORD, join_back, materialise, prefix_sums, table

#: Weights of the sources in code-point order, repeating, and epochs at most.
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3


#: Sources up to this number are broadcast to the documents (some 100 bytes each); more are joined with their hot ones dealt.
BROADCAST_SOURCES = 20_000


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to sources (source, n): shares of the sum of sizes by weight; what exceeds max_epochs times a size is shared anew among the rest.

    Weights go round in the order of sources. Each round of sharing reads the sources once and gathers three numbers.
    """
    ranked = prefix_sums(sources.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "source_ranks")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("before") % len(weights) + 1).cast("int"))
    s = ranked.withColumn("weight", w).drop("one", "before")
    most, share, capped = (max_epochs * F.col("n")).cast("double"), F.lit(None).cast("double"), -1
    over = F.lit(False)
    while True:
        left, free, now = s.agg(F.sum("n").cast("double") - F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if now == capped or not free:
            return s.withColumn("target", F.when(over, most).otherwise(share)).drop("weight")
        capped, share = now, F.lit(left) * F.col("weight") / F.lit(free)
        over = share > most


def mix(docs: DataFrame, *, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row of ``docs``.

    size counts words. Sources are a table, however many they are. Within a source documents are taken whole, in the order of a hash of seed and id, for
    each full epoch; the last epoch stops at the exact budget, the floor of the target, within a
    document if need be. The order rests on the id, then the text's hash, so reruns agree. Null
    text: size 0. Null source: a source of its own, last. Repeated rows count as documents of their own.
    """
    return _mix(docs, seed, weights, max_epochs, id_col, text, source).drop("tie")


def _mix(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix with ``tie``, the hash of the text."""
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).alias("source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    by_source = F.col("source").asc_nulls_last()
    done = prefix_sums(d, [by_source, F.col("key"), F.col("doc_id"), F.col("tie")], "size", "mix")
    sources = done.groupBy("source").agg(F.sum("size").alias("n"), F.min("before").alias("begin"), F.count("*").alias("rows"))
    plan = targets(materialise(sources, "sources"), weights, max_epochs)
    budget = F.floor(F.col("target") + 1e-6).cast("long")
    named = lambda c: F.concat(F.when(c.isNull(), "1").otherwise("0"), F.coalesce(c, F.lit("")))
    plan = plan.select(named(F.col("source")).alias("s"), "rows", F.col("n").alias("source_size"), "target", "begin", *[F.when(F.col("n") > 0, x).otherwise(0).cast("long").alias(c) for c, x in (("epochs", F.floor(budget / F.col("n"))), ("rest", budget % F.col("n")))])
    done = done.withColumn("s", named(F.col("source")))
    out = done.join(F.broadcast(plan), "s") if plan.count() <= BROADCAST_SOURCES else join_back(done, plan, "s", "rows", ["doc_id", "tie"])
    part = F.least(F.greatest(F.col("rest") - (F.col("before") - F.col("begin")), F.lit(0)), F.col("size"))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "tie")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole copy that is taken, then one with the first words where a part is
    (its words joined by single spaces).

    Documents of no word are never taken. Rows that repeat id, text and source share their copies evenly, as they are the same
    document; different texts under one id, or under null ids, are documents of their own.
    """
    cols = docs.columns
    each = _mix(docs, **options).groupBy("doc_id", "tie", "source").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows")).where("taken > 0")
    each = each.select(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), F.col("source").alias("__source"), F.col("taken").alias("__taken"), F.col("rows").alias("__rows"))
    d = docs.withColumn("__n", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    d = d.join(each, d["doc_id"].eqNullSafe(each["__id"]) & (F.xxhash64(d["text"]) == each["__tie"]) & d["source"].eqNullSafe(each["__source"]))
    share = F.floor(F.col("__taken") / F.col("__rows"))
    d = d.withColumn("__whole", F.floor(share / F.col("__n"))).withColumn("__part", share % F.col("__n"))
    copy = F.explode(F.sequence(F.lit(1), F.col("__whole") + F.when(F.col("__part") > 0, 1).otherwise(0)))
    d = d.withColumn("__copy", copy)
    cut = (F.col("__part") > 0) & (F.col("__copy") > F.col("__whole"))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__part").cast("int"))
    d = d.withColumn("text", F.when(cut, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in cols:
        d = d.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.select(*cols)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: The oracle's key is the same MD5; the budget's floor allows for rounding. 3 sources at most are capped within 40 rounds of resharing.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, source, md5('17:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, n, k, CASE k % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
fill(step, source, k, n, weight, capped, target) AS (
  SELECT 0, source, k, n, weight, false, (sum(n) OVER () * weight / sum(weight) OVER ())::DOUBLE FROM w
  UNION ALL
  SELECT step + 1, source, k, n, weight, over, CASE WHEN over THEN 3.0 * n ELSE (total - sum(CASE WHEN over THEN 3.0 * n ELSE 0 END) OVER ()) * weight / sum(CASE WHEN over THEN 0 ELSE weight END) OVER () END::DOUBLE
  FROM (SELECT *, capped OR target > 3 * n AS over, sum(n) OVER () AS total FROM fill WHERE step < 40)),
goal AS (SELECT source, n, target, floor(target + 1e-6)::BIGINT AS budget FROM fill WHERE step = 40),
o AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id) - size AS before FROM d)
SELECT doc_id, size, n AS source_size, target, (CASE WHEN n = 0 THEN 0 ELSE (budget // n) * size + least(greatest(budget % n - before, 0), size) END)::BIGINT AS taken, o.source AS source
FROM o JOIN goal ON o.source IS NOT DISTINCT FROM goal.source
"""
