"""BM25 indexes: stored words and token counts for long queries, and postings in blocks ordered by impact, whose maxima let short ones skip what cannot reach the top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivana.functions.text import tokens
from scrivana.operators.retrieval import B, K1, top_k
from scrivana.operators.text_tiles import split_texts, tiled_scores, token_stats
from scrivana.store import written

#: Postings of a block.
BLOCK = 128
#: Scores are rounded to six places, so a bound this far below a threshold may still tie with it.
MARGIN = 2e-6


@dataclass
class TextIndex:
    """Tables of an index in one folder.

    ``tenants``: user_id, n, avgdl. ``forward``: user_id, id and the text's distinct tokens ``toks`` with their impacts ``ws`` (what BM25 multiplies the
    inverse document frequency with). ``blocks``: user_id, tok, block, wmax, ids, ws: up to BLOCK texts of a token, impacts descending. ``terms``: user_id, tok, df,
    wmax and ``top``, its block of the highest impacts.
    """

    tenants: DataFrame
    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens of each text and their counts, a batch of texts at once."""
    for b in batches:
        t = b.column("t")
        lengths = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
        codes = t.flatten().dictionary_encode()
        words = max(1, len(codes.dictionary))
        pairs, n = np.unique(np.repeat(np.arange(b.num_rows), lengths) * words + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
        ends = np.append(0, np.cumsum(np.bincount(pairs // words, minlength=b.num_rows))).astype(np.int32)
        toks = pa.ListArray.from_arrays(pa.array(ends), codes.dictionary.take(pa.array(pairs % words)))
        tfs = pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("id"), pa.array(lengths), toks, tfs], names=["user_id", "id", "dl", "toks", "tfs"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings of a partition, cut into blocks where a token ends or BLOCK postings are full."""
    key, ids, ws, out, no, pid = None, [], [], [], 0, None

    def flush() -> None:
        nonlocal no, ids, ws
        if ids:
            out.append((*key, (pid << 40) + no, ws[0], ids, ws))
            no, ids, ws = no + 1, [], []

    def sent() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["user_id", "tok", "block", "wmax", "ids", "ws"])
        out.clear()
        return b

    for b in batches:
        if b.num_rows:
            pid = b.column("pid")[0].as_py()
        for user, tok, i, w in zip(*(b.column(c).to_pylist() for c in ("user_id", "tok", "id", "w")), strict=True):
            if (user, tok) != key or len(ids) == BLOCK:
                flush()
                key = (user, tok)
            ids.append(i)
            ws.append(w)
        if len(out) > 4096:
            yield sent()
    flush()
    if out:
        yield sent()


def build_text_index(corpus: DataFrame, path: str, k1: float = K1, b: float = B) -> TextIndex:
    """Index texts (user_id, id, content) into the folder ``path``.

    Tokens are counted where the text is read. Postings are sorted over all partitions by token and impact, so a word of a third of all texts spans many
    tasks and its blocks are cut where they lie. A null text has no tokens but counts as a text; a null tenant's are left out.
    """
    words = corpus.where("user_id is not null").select("user_id", "id", F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("t"))
    kind = corpus.schema["user_id"].dataType.simpleString()
    counted = written(words.mapInArrow(_counted, f"user_id {kind}, id long, dl long, toks array<string>, tfs array<int>"), f"{path}/counted")
    tenants = written(counted.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), f"{path}/tenants")
    long = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    impact = F.transform("tfs", lambda tf: tf * (k1 + 1) / (tf + long))
    forward = counted.join(tenants, "user_id").select("user_id", "id", "toks", impact.alias("ws"))
    forward = written(forward, f"{path}/forward")
    flat = forward.select("user_id", "id", F.explode(F.arrays_zip("toks", "ws")).alias("x")).select("user_id", F.col("x.toks").alias("tok"), "id", F.col("x.ws").alias("w"))
    order = [F.col("user_id"), F.col("tok"), F.col("w").desc(), F.col("id")]
    flat = flat.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id().cast("long"))
    blocks = written(flat.mapInArrow(_cut, f"user_id {kind}, tok string, block long, wmax double, ids array<long>, ws array<double>"), f"{path}/blocks")
    terms = blocks.groupBy("user_id", "tok").agg(F.sum(F.size("ids")).alias("df"), F.max("wmax").alias("wmax"), F.max_by("block", F.struct("wmax", -F.col("block"))).alias("top"))
    return TextIndex(tenants, forward, blocks, written(terms, f"{path}/terms"))


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("tenants", "forward", "blocks", "terms")))


def asked_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``user_id, qid, tok, idf, ub, others, upto`` of the distinct tokens of queries (user_id, qid, query) that their tenant has:
    what a token can add at most, what the query's others can, and what it can with all tokens that add less."""
    asked = queries.select("user_id", "qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("tok"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    t = asked.join(index.terms, ["user_id", "tok"]).join(index.tenants, "user_id").withColumn("idf", idf).withColumn("ub", F.col("idf") * F.col("wmax"))
    mine = Window.partitionBy("qid")
    return t.select("user_id", "qid", "tok", "idf", "ub", "top", (F.sum("ub").over(mine) - F.col("ub")).alias("others"), F.sum("ub").over(mine.orderBy("ub", "tok").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


def candidates(index: TextIndex, terms: DataFrame, k: int = 5) -> DataFrame:
    """``qid, id``: texts that may be among a query's k best; all that are, and few others.

    The best blocks of a query's tokens give scores that some k texts reach at least. Against the k-th of these: tokens whose bounds together stay below
    it need not be looked at on their own; of the others, blocks whose maximum with the other tokens' bounds stays below are not opened; and a text goes when
    what is known of it with the bounds of the rest stays below.
    """
    w = F.explode(F.arrays_zip("ids", "ws")).alias("x")
    first = terms.join(index.blocks.select(F.col("block").alias("top"), "ids", "ws"), "top").select("qid", "idf", w)
    seen = first.groupBy("qid", F.col("x.ids").alias("id")).agg(F.sum(F.col("idf") * F.col("x.ws")).alias("least"))
    floor = top_k(seen, k, F.col("least").desc()).where(F.col("rank") == k).select("qid", (F.col("least") - MARGIN).alias("floor"))
    t = terms.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))).where(F.col("upto") >= F.col("floor"))
    heads = index.blocks.select("user_id", "tok", "block", F.col("wmax").alias("most"))
    open_ = t.join(heads, ["user_id", "tok"]).where(F.col("idf") * F.col("most") + F.col("others") >= F.col("floor"))
    hits = open_.select("qid", "idf", "ub", "others", "floor", "block").join(index.blocks.select("block", "ids", "ws"), "block").select("qid", "idf", "ub", (F.col("others") + F.col("ub")).alias("all"), "floor", w)
    one = hits.groupBy("qid", F.col("x.ids").alias("id")).agg((F.sum(F.col("idf") * F.col("x.ws")) + F.first("all") - F.sum("ub")).alias("most"), F.first("floor").alias("floor"))
    return one.where(F.col("most") >= F.col("floor")).select("qid", "id")


def search_text(index: TextIndex, queries: DataFrame, k: int = 5) -> DataFrame:
    """``qid, id, score, rank``: the k best texts of each query's tenant by BM25, as scoring every text would give them."""
    terms = asked_terms(index, queries)
    found = candidates(index, terms, k)
    whole = terms.groupBy("qid").agg(F.collect_list(F.struct("tok", "idf")).alias("asked"))  # a query's own tokens
    w = lambda x: F.coalesce(F.get("ws", F.array_position("toks", x["tok"]).cast("int") - 1), F.lit(0.0))
    pairs = found.join(index.forward.select("id", "toks", "ws"), "id").join(whole, "qid")
    score = F.aggregate("asked", F.lit(0.0), lambda a, x: a + x["idf"] * w(x))
    return top_k(pairs.select("qid", "id", F.round(score, 6).alias("score")).where("score > 0"), k, F.col("score").desc())


@dataclass
class WordIndex:
    """Tables of an index in one folder: ``texts`` and ``stats`` as ``text_tiles`` has them."""

    texts: DataFrame
    stats: DataFrame


def build_word_index(corpus: DataFrame, path: str) -> WordIndex:
    """Index texts (user_id, id, content) into the folder ``path``: each text's words and each tenant's tokens. Its size is about that of the texts."""
    texts = written(split_texts(corpus), f"{path}/texts")
    return WordIndex(texts, written(token_stats(texts), f"{path}/stats"))


def search_words(index: WordIndex, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """As :func:`search_text`, in tiles of texts and queries: what it shuffles does not grow with the texts that a query's tokens meet, which with long queries are all."""
    return top_k(tiled_scores(index.texts, index.stats, queries, k, k1, b), k, F.col("score").desc())
