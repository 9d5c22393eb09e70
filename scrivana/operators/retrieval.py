"""Hybrid retrieval: BM25 and vector branches for many queries at once, rank fusion, look-up, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import dynamic_weights, tokens
from scrivana.operators.text_tiles import split_texts, tiled_scores, token_stats
from scrivana.store import new_path, written

K1, B, FUSION = 1.5, 0.75, 60


def tenant(df: DataFrame, user: str | None) -> DataFrame:
    """A tenant's rows; none, not all, for no tenant."""
    return df.where(F.col("user_id") == user) if user else df.limit(0)


def top_k(scored: DataFrame, k: int, order: Column, by: str = "qid") -> DataFrame:
    """Rank within a query; ties go to the lower id. Spark limits each group before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, "id"))).where(F.col("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """``qid, id, score, rank`` for queries (user_id, qid, query), each over its tenant's texts (user_id, id, content), without an index.

    Two scans of the corpus: one counts a tenant's texts and the texts of each token, the other scores tiles (see :func:`text_tiles.tiled_scores`). What is shuffled
    follows the texts and queries, not their pairs.
    """
    texts = split_texts(corpus)
    stats = written(token_stats(texts), new_path(corpus.sparkSession, "token-stats"))
    return top_k(tiled_scores(texts, stats, queries, k, k1, b), k, F.col("score").desc())


def fuse(branches: dict[str, DataFrame], queries: DataFrame, constant: int = FUSION) -> DataFrame:
    """Weighted rank fusion of the branches ``vector`` and ``bm25``; a query's weights follow from its text."""
    w = queries.select("qid", dynamic_weights(F.col("query")).alias("w")).select("qid", "w.vector", "w.bm25")
    parts = None
    for name, ranked in branches.items():
        part = ranked.join(w, "qid").select("qid", "id", (F.col(name) / (constant + F.col("rank"))).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("qid", "id").agg(F.round(F.sum("part"), 8).alias("score"))


def look_up(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Full rows of the hits, with the hits' rank; ids that no row has are dropped."""
    return hits.join(rows, "id")


def lexical_overlap(query: Column, toks: Column) -> Column:
    """The default scorer: the share of a query's distinct tokens that are among a text's tokens."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, toks)) / F.size(q), 4)).otherwise(0.0)


def rerank(pairs: DataFrame, score: Column | None) -> DataFrame:
    """Pairs (qid, id, ord, what the scorer needs) by score, ties in input order; without a scorer all score 0."""
    s = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
    scored = pairs.withColumn("score", s)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "ord")))


def notes_first(notes: DataFrame, base: DataFrame) -> DataFrame:
    """Hits of both branches (qid, id, rank) with ``ord`` (branch and rank): notes before the knowledge base, each in its order; an id in both stands first."""
    both = notes.select("qid", "id", "rank", F.lit(0).alias("src")).unionByName(base.select("qid", "id", "rank", F.lit(1).alias("src")))
    return both.groupBy("qid", "id").agg(F.min(F.struct("src", "rank")).alias("ord"))


#: The texts of a ranked list.
LIST_HEAD, LIST_SCORE, LIST_TEXT = "重排序后的文档列表：\n", "%d. 相似度: %.4f\n", "   内容: "


def ranked_list(ranked: DataFrame) -> DataFrame:
    """``qid, listed``: the few reranked texts of a query (qid, rank, score, content) as one text, best first."""
    line = F.concat(F.format_string(LIST_SCORE, "rank", "score"), F.lit(LIST_TEXT), F.col("content"), F.lit("\n\n"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("qid").agg(F.concat(F.lit(LIST_HEAD), F.array_join(F.transform(lines, lambda x: x["line"]), "")).alias("listed"))
