"""Hashes within a Hamming radius by multi-index hashing, and leader clusters over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.store import new_path, placed, written

#: Bits of a hash, blocks that it is cut into, and pages up to which a document is clustered in one fold.
BITS, BLOCKS, FOLD_PAGES = 64, 4, 1000
#: Root of the pairs of a tile of all pairs; pairs of a task of a radius search, one of about so many pairs of hashes meeting in a block; and partitions at most.
TILE, TASK_PAIRS, MEETING_SHARE, MOST_TASKS = 4096, 4_000_000, 40, 10_000
#: How many times fewer asked rows, and more rows, than TILE a tile of all pairs has: their ids recur soon, which Parquet stores in little.
NARROW = 4


def tasks_of(pairs: int) -> int:
    return max(8, min(-(-pairs // TASK_PAIRS), MOST_TASKS))


def hash_number(h: Column) -> Column:
    """A hexadecimal hash of up to 64 bits as a long; null if it is missing or malformed."""
    return F.when(h.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(h, 16, -10).cast("long"))


def _block(h: Column, k: int, blocks: int) -> Column:
    low, high = k * BITS // blocks, (k + 1) * BITS // blocks
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _near_keys(k: int, blocks: int, masks: list[int]) -> Column:
    own = _block(F.col("g"), k, blocks)
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(m).alias("key")))


def near_hashes(asked: DataFrame, hashes: DataFrame, radius: int, by: list[str] = (), blocks: int = BLOCKS, *, parts: int | None = None) -> DataFrame:
    """``by, g, h, bits``: the hashes h (long, distinct in ``by``) within ``radius`` bits of each asked g (likewise), every pair once.

    Of two hashes so near, one of the blocks differs in at most radius / blocks bits: each hash is found by the values of its blocks, and an asked one looks up
    all values that near its own. A pair that meets in several blocks is taken in the first. Work follows the pairs that share a block
    value, not the product of both sides. ``parts``: partitions of that meeting, which adaptive execution would choose by the few bytes that go in.
    """
    within = radius // blocks
    keys, probes = [], []
    for k in range(blocks):
        width = (k + 1) * BITS // blocks - k * BITS // blocks
        masks = [sum(1 << i for i in c) for n in range(within + 1) for c in combinations(range(width), n)]
        keys.append(F.struct(F.lit(k).alias("k"), _block(F.col("h"), k, blocks).alias("key")))
        probes.append(_near_keys(k, blocks, masks))
    right = hashes.select(*by, "h", F.explode(F.array(*keys)).alias("at")).select(*by, "h", "at.*")
    left = asked.select(*by, "g", F.explode(F.concat(*probes)).alias("at")).select(*by, "g", "at.*")
    if parts:
        left, right = (x.repartition(parts, *by, "k", "key") for x in (left, right))
    diff = F.col("g").bitwiseXOR(F.col("h"))
    earlier = F.lit(False)
    for k in range(blocks):
        earlier = earlier | ((F.lit(k) < F.col("k")) & (F.bit_count(_block(diff, k, blocks)) <= within))
    met = left.join(right, [*by, "k", "key"]).where((F.bit_count(diff) <= radius) & ~earlier)
    return met.select(*by, "g", "h", F.bit_count(diff).alias("bits"))


def radius_search(asked: DataFrame, rows: DataFrame, radius: int) -> DataFrame:
    """``a, b, copies, bits``: for each asked row (a, h) the distinct hashes of ``rows`` (id, h) within the radius, each as its least id and
    number of rows. Rows of one hash are one class, so a hash of a third of all rows makes no pairs of its copies. Null hashes are near nothing."""
    classes = rows.where("h is not null").groupBy("h").agg(F.min("id").alias("b"), F.count("*").alias("copies"))
    want = asked.where("h is not null").select("a", F.col("h").alias("g"))
    asked_hashes = want.select("g").distinct()
    parts = tasks_of(asked_hashes.count() * classes.count() // MEETING_SHARE)
    pairs = near_hashes(asked_hashes, classes.select("h"), radius, parts=parts)
    return want.join(pairs.join(classes, "h"), "g").select("a", "b", "copies", "bits")


def all_distances(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``a, b, bits`` of every asked row (a, h) with every row (id, h): the bits in which their hashes differ, null where one has none.

    The result is the product of both sides. Tiles of about TILE / NARROW by TILE * NARROW meet in tasks of their own; there are as many partitions as tiles, up to MOST_TASKS.
    Each row in turn meets all asked ones of its tile, always in one order: written as Parquet, such ids take next to nothing.
    """
    na, nb = (max(1, -(-x.count() // most)) for x, most in ((asked, max(1, TILE // NARROW)), (rows, TILE * NARROW)))
    parts = min(na * nb, MOST_TASKS)
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(all_(na).alias("ta"), mine("id", nb).alias("tb"), F.col("id").alias("b"), "h").repartition(parts, "ta", "tb")
    right = asked.select(mine("a", na).alias("ta"), all_(nb).alias("tb"), "a", F.col("h").alias("g")).repartition(parts, "ta", "tb")
    # a merge reads the left side in turn and holds a tile's asked rows, whatever their bytes
    return left.join(right.hint("merge"), ["ta", "tb"]).select("a", "b", F.bit_count(F.col("g").bitwiseXOR(F.col("h"))).alias("bits"))


def _fold(pages: DataFrame, threshold: int) -> DataFrame:
    import pandas as pd

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        leaders: list[int | None] = []
        out = []
        pdf = pdf.sort_values("page")
        for text in pdf["h"]:
            v = int(text, 16) if text is not None else None
            hit = next((k for k, x in enumerate(leaders) if v is not None and x is not None and (v ^ x).bit_count() <= threshold), None)
            if hit is None:
                leaders.append(v)
                hit = len(leaders) - 1
            out.append(hit)
        return pdf[["doc", "page"]].assign(cluster=out)

    hexed = F.when(F.col("h").isNotNull(), F.hex("h"))
    return pages.select("doc", "page", hexed.alias("h")).groupBy("doc").applyInPandas(lead, "doc long, page int, cluster int")


def first_leaders(pages: DataFrame, near: DataFrame) -> DataFrame:
    """``doc, page`` of the pages that lead: a page does if no earlier one near it leads (``near``: doc, early, late).

    In rounds: of the pages not yet decided, those with no undecided earlier one near them lead, and those near them follow. Each round is a
    few joins over what is left, and cuts the lineage.
    """
    spark = pages.sparkSession
    left = written(pages.select("doc", "page"), new_path(spark, "undecided"))
    edges = written(near.select("doc", "early", "late"), new_path(spark, "near"))
    found = []
    while not left.isEmpty():
        lead = left.join(edges.select("doc", F.col("late").alias("page")), ["doc", "page"], "left_anti")
        lead = written(lead, new_path(spark, "leaders"))
        found.append(lead)
        follow = edges.join(lead.withColumnRenamed("page", "early"), ["doc", "early"], "left_semi").select("doc", F.col("late").alias("page"))
        left = written(left.join(lead.unionByName(follow).distinct(), ["doc", "page"], "left_anti"), new_path(spark, "undecided"))
        open_ = [left.withColumnRenamed("page", c) for c in ("early", "late")]
        edges = written(edges.join(open_[0], ["doc", "early"], "left_semi").join(open_[1], ["doc", "late"], "left_semi"), new_path(spark, "near"))
    out = pages.select("doc", "page").limit(0)
    for lead in found:
        out = out.unionByName(lead)
    return out


def _rounds(pages: DataFrame, threshold: int) -> DataFrame:
    # pages of one hash go where the first of them goes; a page without a hash leads itself
    first = pages.where("h is not null").groupBy("doc", "h").agg(F.min("page").alias("page"))
    pairs = near_hashes(first.select("doc", F.col("h").alias("g")), first.select("doc", "h"), threshold, ["doc"]).where("g != h")
    one, two = first.select("doc", F.col("h").alias("g"), F.col("page").alias("late")), first.select("doc", "h", F.col("page").alias("early"))
    near = pairs.join(one, ["doc", "g"]).join(two, ["doc", "h"]).where("early < late").select("doc", "early", "late")
    near = written(near, new_path(pages.sparkSession, "near-all"))
    lead = first_leaders(first, near)
    joined = near.join(lead.withColumnRenamed("page", "early"), ["doc", "early"], "left_semi").groupBy("doc", F.col("late").alias("page")).agg(F.min("early").alias("leader"))
    of_first = first.join(joined, ["doc", "page"], "left").select("doc", "h", F.coalesce("leader", "page").alias("leader"))
    alone = pages.where("h is null").select("doc", "page", F.col("page").alias("leader"))
    each = pages.where("h is not null").join(of_first, ["doc", "h"]).select("doc", "page", "leader").unionByName(alone)
    numbers = placed(each.select("doc", "leader").distinct(), "doc", [F.col("leader")], "cluster")
    return each.join(numbers, ["doc", "leader"]).select("doc", "page", (F.col("cluster") - 1).cast("int").alias("cluster"))


def leader_clusters(pages: DataFrame, threshold: int = 10, fold: int = FOLD_PAGES) -> DataFrame:
    """``doc, page, cluster`` for pages (doc, page, phash): in page order each joins the first cluster whose leader's hash is near enough, or leads a new one.

    Near is not transitive, so the order decides. Documents of up to ``fold`` pages are folded, one in a task; larger ones are decided in rounds over
    the pairs of near hashes, spread over all tasks. Both give the serial result. Missing and malformed hashes are near nothing.
    """
    p = pages.select("doc", "page", hash_number(F.col("phash")).alias("h"))
    size = p.groupBy("doc").agg(F.count("*").alias("n"))
    large = size.where(F.col("n") > fold).select("doc")
    if large.isEmpty():
        return _fold(p, threshold)
    large = written(large, new_path(pages.sparkSession, "large"))
    small = _fold(p.join(large, "doc", "left_anti"), threshold)
    return small.unionByName(_rounds(p.join(large, "doc", "left_semi"), threshold))
