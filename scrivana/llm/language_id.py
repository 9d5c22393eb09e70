"""Language identification.

Method: sparse multinomial logistic regression on TF-IDF of character n-grams, trained with
follow-the-regularised-leader (proximal) and elastic-net penalties, then temperature calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scrivana.llm.common import batched, held_out, table
from scrivana.llm.ngrams import has_letter, hashed

SIZES, BITS = (1, 2, 3), 16
#: Labelled documents of each language that the fit may take (by least id hash), and of all languages together.
SAMPLE, SAMPLE_ALL = 500, 50_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.001, 4
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # bucket x language, sparse by the L1 penalty
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    if len(text) < 20_000:
        return np.unique(np.concatenate([*hashed(text, SIZES, BITS)]), return_counts=True)
    total = np.zeros(1 << BITS, np.int64)
    for ids in hashed(text, SIZES, BITS):
        total += np.bincount(ids, minlength=len(total))
    u = np.flatnonzero(total)
    return u, total[u]


def _tfidf(u: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = n * idf[u]
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """A fifth of the rows is kept from the descent and sets the temperature."""
    langs = sorted(set(labels))
    y = np.array([langs.index(v) for v in labels], np.int64)
    size, k = 1 << BITS, max(1, len(langs))
    counts = [_counts(t) for t in texts]
    df = np.zeros(size)
    for u, _ in counts:
        df[u] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    rows = [(u, _tfidf(u, n, idf)) for u, n in counts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check, learn = order[: len(rows) // 5], order[len(rows) // 5 :]
    z, n2 = np.zeros((size, k)), np.zeros((size, k))
    bias, g_bias = np.zeros(k), np.full(k, 1e-4)

    def weights(u: np.ndarray) -> np.ndarray:
        zu = z[u]
        return np.where(np.abs(zu) <= L1, 0.0, -(zu - np.sign(zu) * L1) / ((BETA + np.sqrt(n2[u])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            u, v = rows[i]
            w = weights(u)
            p = _softmax(v @ w + bias)
            p[y[i]] -= 1
            g = np.outer(v, p)
            grown = np.sqrt(n2[u] + g * g)
            z[u] += g - (grown - np.sqrt(n2[u])) / ALPHA * w
            n2[u] += g * g
            g_bias += p * p
            bias -= 0.1 * p / np.sqrt(g_bias)
    w = weights(np.arange(size))
    logits = np.array([v @ w[u] + bias for u, v in (rows[i] for i in check)]).reshape(-1, k)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(check)), y[check]] + 1e-12).mean() if len(check) else abs(np.log(t)) for t in grid]
    return Model(langs, w, bias, idf, float(grid[int(np.argmin(loss))]))


def identify_text(text: str | None, model: Model) -> tuple[str, float]:
    if not text or not model.langs or not has_letter(text):
        return UNKNOWN, 0.0
    u, n = _counts(text)
    p = _softmax((_tfidf(u, n, model.idf) @ model.weight[u] + model.bias) / model.temperature)
    return model.langs[int(p.argmax())], float(p.max())


def train(docs: DataFrame, per_lang: int = SAMPLE, most: int = SAMPLE_ALL) -> Model:
    """Fit on about ``per_lang`` documents of each language outside the held-out quarter, fewer of each where all would be over ``most``.

    Languages are counted over all rows, and every one is learned; a document is chosen if the hash of its id falls below its
    language's share, so nothing is shuffled but counts, and rows of least hash stand for the rest where that gives over twice
    ``most``. Null texts and languages are left out; rows repeated are learned as often.
    """
    d = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull())
    counts = d.groupBy("lang").count()
    langs = counts.count()
    if not langs:
        return Model([], np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1 << BITS), 1.0)
    each = max(1, min(per_lang, most // langs))
    share = counts.select("lang", F.least(F.lit(1.0), each / F.col("count")).alias("share"))
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.broadcast(share) if langs <= most else share  # some 20 bytes a language
    got = d.where(F.col("text").isNotNull()).withColumn("luck", luck).join(share, "lang").where(F.col("luck") < F.col("share"))
    got = got.orderBy("luck", "doc_id", F.xxhash64("text"), "lang").limit(2 * most).select("doc_id", "text", "lang").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["lang"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    score is the calibrated probability of the prediction; null and letterless texts are ``und``
    with score 0. Repeated rows are all judged; an empty table gives no row; other columns are
    ignored. Only the non-zero rows of the model, bounded by its buckets, go to the tasks.
    """
    used = np.flatnonzero(np.abs(model.weight).sum(axis=1)).astype(np.int32)
    slim = (model.langs, used, model.weight[used].astype(np.float32), model.bias, model.idf.astype(np.float32), model.temperature)

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        langs, at, w, bias, idf, temperature = slim
        full = np.zeros((len(idf), max(1, len(langs))))
        full[at] = w
        m = Model(langs, full, bias, idf, temperature)
        for i, out, t in rows:
            yield i, out, *identify_text(t, m)

    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = d.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return d.mapInArrow(batched(make, schema, ("doc_id", "held_out", "text")), f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
