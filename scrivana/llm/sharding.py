"""Byte-bounded shards by extendible hashing, in DataFrame operations only.

Method: a directory indexed by hash-prefix bits. Only a bucket over the byte limit is split on
another bit, until every shard fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.llm.common import materialise, table

#: Bytes of text a shard may hold.
SHARD_BYTES = 1 << 20
#: Bits that one sweep over the still oversized buckets resolves, and bits that the key hash has.
SWEEP_BITS, HASH_BITS = 12, 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a non-negative long (null: the key ``''``)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(hash_: Column, depth: Column) -> Column:
    """The leading ``depth`` bits as a string of 0 and 1."""
    return F.substring(F.lpad(F.conv(hash_.cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), depth)


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``prefix, depth, shard_bytes, shard_docs, fits``: the leaves of the directory for rows (h, n_bytes).

    Each sweep first sums the bytes of the finest prefixes it looks at (partial aggregation, so a
    hot key is added up before the shuffle), rolls those sums up to every shorter depth, and keeps
    for each the shallowest depth that fits. Only what still exceeds the limit goes into the next
    sweep. fits is false only where all 60 bits are used up: rows of one and the same key.
    """
    out, base, rest = None, 0, sizes
    while True:
        top = min(base + SWEEP_BITS, HASH_BITS)
        fine = rest.groupBy(F.shiftright("h", HASH_BITS - top).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(top)))
        up = fine.select("p", "b", "n", depths.alias("depth")).withColumn("q", F.expr(f"shiftright(p, {top} - depth)"))
        sums = up.groupBy("depth", "q").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        sums = materialise(sums, "directory")
        # a prefix is a leaf if it fits and its parent does not (or it is where this sweep began)
        parent = sums.where(F.col("b") > limit).select((F.col("depth") + 1).alias("depth"), F.col("q").alias("parent"))
        fit = sums.where((F.col("b") <= limit) | ((F.col("depth") == top) & F.lit(top == HASH_BITS)))
        leaf = fit.withColumn("parent", F.shiftright("q", 1)).join(parent, ["depth", "parent"], "left_semi")
        if base == 0:
            leaf = leaf.unionByName(fit.where("depth = 0").withColumn("parent", F.lit(0).cast("long")))
        leaf = leaf.select("depth", "q", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), (F.col("b") <= limit).alias("fits"))
        leaf = leaf.withColumn("prefix", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("q").cast("string"), 10, 2), F.col("depth"), F.lit("0"))))
        out = leaf if out is None else out.unionByName(leaf)
        over = sums.where((F.col("depth") == top) & (F.col("b") > limit)).select("q")
        if top == HASH_BITS or over.isEmpty():
            return out.drop("q")
        rest = rest.withColumn("q", F.shiftright("h", HASH_BITS - top)).join(over, "q", "left_semi").select("h", "n_bytes")
        base = top


def _sized(docs: DataFrame, id_col: str, text: str, *extra: Column) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64(text).alias("t"), *extra)
    return materialise(d.withColumn("h", key_hash(F.col("doc_id"))), "sizes")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, shard_docs`` for every row of ``docs``.

    shard is the prefix of hash bits that names the bucket; it stays the same on any rerun and
    whatever the partitions. Rows of one key cannot be told apart by hash bits: where they alone
    exceed the limit they are dealt by their text's hash to sub-shards ``prefix/k``, cut
    where their running bytes pass a multiple of the limit, so such a sub-shard, like the shard of
    a single text over the limit, exceeds it by less than one row. Null texts have 0 bytes, null ids
    hash as ``''``; repeated rows are all kept; an empty table gives no row; other columns are ignored.
    """
    return _placed(_sized(docs, id_col, text), limit)


def _placed(d: DataFrame, limit: int, extra: tuple[str, ...] = ()) -> DataFrame:
    tree = materialise(directory(d.select("h", "n_bytes"), limit), "leaves")
    depths = [r[0] for r in tree.select("depth").distinct().collect()]  # at most 61 numbers
    keyed = d.withColumn("prefix", F.explode(F.array(*[_prefix(F.col("h"), F.lit(k)) for k in sorted(depths)]))) if depths else d.withColumn("prefix", F.lit(""))
    out = keyed.join(tree, "prefix")
    whole = out.where("fits or shard_docs = 1").select("doc_id", "n_bytes", F.col("prefix").alias("shard"), "depth", "shard_bytes", "shard_docs", *extra)
    if tree.where("not fits and shard_docs > 1").isEmpty():
        return whole
    return whole.unionByName(_split_equal_keys(out.where("not fits and shard_docs > 1"), limit, extra))


def _split_equal_keys(rows_: DataFrame, limit: int, extra: tuple[str, ...]) -> DataFrame:
    """Deal rows of one key by running bytes, in an order that rests on the rows alone.

    Equal rows are counted first, and their copies told apart only by where they fall. 4096 slices by hash carry the sums, so no task
    holds a key's rows whole.
    """
    own = ["doc_id", "n_bytes", "t", *extra]
    x = rows_.groupBy("prefix", "depth", *own).agg(F.count("*").alias("rows")).withColumn("slice", F.pmod(F.xxhash64("t", "doc_id"), F.lit(4096)))
    x = materialise(x.withColumn("b", F.col("n_bytes") * F.col("rows")), "equal_keys")
    before = Window.unboundedPreceding, -1
    begun = x.groupBy("prefix", "slice").agg(F.sum("b").alias("s"))
    begun = begun.withColumn("begun", F.coalesce(F.sum("s").over(Window.partitionBy("prefix").orderBy("slice").rowsBetween(*before)), F.lit(0))).drop("s")
    at = F.coalesce(F.sum("b").over(Window.partitionBy("prefix", "slice").orderBy(*own).rowsBetween(*before)), F.lit(0))
    x = x.withColumn("at", at).join(begun, ["prefix", "slice"])
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    k = F.floor((F.col("begun") + F.col("at") + F.col("copy") * F.col("n_bytes")) / limit)
    x = materialise(x.select("doc_id", "n_bytes", F.concat("prefix", F.lit("/"), k.cast("string")).alias("shard"), "depth", *extra), "sub_shards")
    sums = x.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return x.join(sums, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", *extra)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as Parquet with a folder for each shard (column ``shard``, or ``_shard`` where that is a column of theirs); returns
    the manifest (see :func:`shard`). Every row goes to the shard that the manifest counts it in, also where one key has many."""
    name = "_shard" if "shard" in docs.columns else "shard"
    placed = materialise(_placed(_sized(docs, id_col, text, F.struct(*docs.columns).alias("row")), limit, ("row",)), "placed")
    placed.select("row.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(path)
    return placed.drop("row")


def op9_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


#: Leaves of the directory: the shallowest of 32 depths that fits (no key of a test table needs more, as ids are unique).
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
up AS (SELECT k AS depth, h >> (60 - k) AS q, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM d, range(0, 33) r(k) GROUP BY ALL),
mine AS (SELECT d.doc_id, d.n_bytes, h, min(depth) AS depth FROM d JOIN up ON (d.h >> (60 - depth)) = q WHERE b <= {SHARD_BYTES} GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN mine.depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, mine.depth::INT) END AS shard,
  mine.depth::INT AS depth, b AS shard_bytes, n AS shard_docs
FROM mine JOIN up ON up.depth = mine.depth AND up.q = (h >> (60 - mine.depth))
"""
