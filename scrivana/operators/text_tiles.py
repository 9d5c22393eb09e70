"""BM25 of many queries over many texts in tiles of bounded size: one sparse product a tile, so no pair of a query and a text is ever shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import tokens

#: Texts and queries of a tile: what a task scores at once, whatever the size of a tenant.
TILE_TEXTS, TILE_QUERIES = 2048, 2048
#: Tokens of a dense product, and the share of a tile's pairs from which a token goes there.
DENSE_TOKENS, DENSE_SHARE = 512, 0.005
#: Tenants whose sizes are broadcast; above, they are joined by hash.
BROADCAST_TENANTS = 100_000


def split_texts(corpus: DataFrame) -> DataFrame:
    """``user_id, id, dl, words``: the tokens of each text (user_id, id, content), joined by blanks, and their number. A null text has none; a null tenant's are left out."""
    t = corpus.where("user_id is not null").select("user_id", "id", F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")).alias("t"))
    return t.select("user_id", "id", F.size("t").alias("dl"), F.array_join("t", " ").alias("words"))


def token_stats(texts: DataFrame) -> DataFrame:
    """``user_id, tok, df, length`` of :func:`split_texts`: each tenant's tokens with the number of texts that have them; the empty token stands for all texts, and has the number of their tokens."""
    distinct = F.array_distinct(F.concat(F.array(F.lit("")), F.split("words", " ")))
    each = texts.select("user_id", "dl", F.explode(distinct).alias("tok"))
    return each.groupBy("user_id", "tok").agg(F.count("*").alias("df"), F.sum(F.when(F.col("tok") == "", F.col("dl"))).alias("length"))


def _places(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of joined words, and the row of each."""
    split = pc.split_pattern(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, " ")
    return split.flatten(), np.repeat(np.arange(len(split)), split.value_lengths().to_numpy(zero_copy_only=False))


def _product(q: tuple[np.ndarray, np.ndarray, np.ndarray], t: tuple[np.ndarray, np.ndarray, np.ndarray], words: int, nq: int, nt: int) -> np.ndarray:
    """Scores (queries by texts) of entries (token, row, weight), both sorted by token: tokens of many pairs by dense products, the others one by one."""
    out = np.zeros((nq, nt))
    at_q, at_t = (np.searchsorted(x[0], np.arange(words + 1)) for x in (q, t))
    pairs = np.diff(at_q) * np.diff(at_t)
    common = np.flatnonzero(pairs > DENSE_SHARE * nq * nt)
    place = np.full(words, -1)
    for n in range(0, len(common), DENSE_TOKENS):
        some = common[n : n + DENSE_TOKENS]
        place[some] = np.arange(len(some))
        left, right = np.zeros((nq, len(some))), np.zeros((len(some), nt))
        mine = place[q[0]] >= 0
        left[q[1][mine], place[q[0][mine]]] = q[2][mine]
        mine = place[t[0]] >= 0
        right[place[t[0][mine]], t[1][mine]] = t[2][mine]
        out += left @ right
        place[some] = -1
    pairs[common] = 0
    for w in np.flatnonzero(pairs):
        a, b = slice(at_q[w], at_q[w + 1]), slice(at_t[w], at_t[w + 1])
        out[q[1][a][:, None], t[1][b]] += q[2][a][:, None] * t[2][b]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each query ids and rounded scores of its k best texts among those that share a token, ties to the lower id."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2e-6 if scores.shape[1] > k else np.zeros(len(scores))
    for row, floor in zip(scores, least, strict=True):
        at = np.flatnonzero((row > 0) & (row >= floor))
        rounded = np.round(row[at], 6)
        order = np.lexsort((ids[at], -rounded))[:k]
        yield ids[at][order], rounded[order]


def tiled_scores(texts: DataFrame, stats: DataFrame, queries: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """``qid, id, score``: of each query (user_id, qid, query) the k best texts of every tile of its tenant; the best of all are among them.

    ``texts`` and ``stats`` are those of :func:`split_texts` and :func:`token_stats`. A tenant is cut into tiles of about TILE_TEXTS texts and TILE_QUERIES
    queries by hashes of their ids. A text is sent once for each tile of queries, as its words; a query once for each tile of texts. A tile sends k rows a query.
    """
    tiles = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = stats.where("tok = ''").join(queries.groupBy("user_id").agg(F.count("*").alias("nq")), "user_id")
    sizes = sizes.select("user_id", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"), tiles("df", TILE_TEXTS).alias("__tt"), tiles("nq", TILE_QUERIES).alias("__tq"))
    if sizes.limit(BROADCAST_TENANTS + 1).count() <= BROADCAST_TENANTS:
        sizes = F.broadcast(sizes)
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = queries.select("user_id", "qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("tok"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(stats.select("user_id", "tok", "df"), ["user_id", "tok"]).join(sizes, "user_id").select("user_id", "qid", "__tt", "__tq", F.struct("tok", idf.alias("idf")).alias("x"))
    whole = terms.groupBy("user_id", "qid", "__tt", "__tq").agg(F.collect_list("x").alias("x"))  # a query's own tokens
    q = whole.select(F.col("user_id").alias("__qu"), all_("__tt").alias("__qa"), mine("qid", "__tq").alias("__qb"), "qid", F.array_join("x.tok", " ").alias("words"), F.col("x.idf").alias("idf"))
    t = texts.join(sizes, "user_id").select(F.col("user_id").alias("__tu"), mine("id", "__tt").alias("__ta"), all_("__tq").alias("__tb"), "id", "dl", "avgdl", "words")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, qids, dl = (x.column(c).to_numpy() for x, c in ((left, "id"), (right, "qid"), (left, "dl")))
        words, rows = _places(right.column("words"))
        codes = words.dictionary_encode()
        known, codes = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(codes, kind="stable")
        asked_ = codes[by], rows[by], right.column("idf").combine_chunks().flatten().to_numpy(zero_copy_only=False)[by]
        words, rows = _places(left.column("words"))
        found = pc.index_in(words, value_set=known)
        have = found.is_valid().to_numpy(zero_copy_only=False)
        entries, tf = np.unique(found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + rows[have], return_counts=True)
        row = entries % len(ids)
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / left.column("avgdl")[0].as_py()))
        scores = _product(asked_, (entries // len(ids), row, impact), len(known), len(qids), len(ids)) if len(entries) else np.zeros((len(qids), len(ids)))
        got = list(_best(scores, ids, k))
        return pa.table({"qid": np.repeat(qids, [len(i) for i, _ in got]), "id": np.concatenate([i for i, _ in got]), "score": np.concatenate([s for _, s in got])})

    return t.groupBy("__tu", "__ta", "__tb").cogroup(q.groupBy("__qu", "__qa", "__qb")).applyInArrow(tile, "qid long, id long, score double")
