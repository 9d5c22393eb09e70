"""Toxicity by subword bags.

Method: character n-grams have embeddings, averaged over a span of words and fed to a linear softmax;
both are trained jointly in numpy, so unseen spellings share the vectors of their n-grams. A text is as
toxic as its most toxic span: an average over a whole long text would drown a few words, and labels
mark texts, not places, so training lets the model choose the span that it learns from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scrivana.llm.common import batched, held_out, table, tidy
from scrivana.llm.ngrams import located

#: N-gram sizes, bits of a bucket's number, embedding width, passes, learning rate, words of a span.
SIZES, BITS, WIDTH, EPOCHS, RATE, SPAN = (3, 4, 5), 18, 8, 8, 0.05, 4
#: Labelled documents of each class that the fit may take.
SAMPLE = {1: 1500, 0: 4000}
#: N-grams in fewer sampled documents than this keep the zero vector.
MIN_DOCS = 3
THRESHOLD = 0.3


@dataclass
class Model:
    """score = softmax(mean embedding of the span . head + bias), the highest of all spans; for scoring, each bucket's vector is projected on the head once."""

    embedding: np.ndarray
    head: np.ndarray
    bias: np.ndarray

    def projected(self) -> tuple[np.ndarray, float]:
        return (self.embedding @ (self.head[:, 1] - self.head[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def _spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams in order of span, and where its spans begin."""
    ids, word = (np.concatenate(x) for x in zip(*located(text, SIZES, BITS), strict=True))
    span = word // SPAN
    order = np.argsort(span, kind="stable")
    span = span[order]
    return ids[order], np.flatnonzero(np.diff(span, prepend=-1))


def fit(texts: list[str], labels: list[int], seed: int = 1, prior: float | None = None) -> Model:
    """Stochastic descent with a step per bucket that adapts to its gradients (AdaGrad by rows).

    The first pass takes a text as one span; after it a text is learnt from the span that scores highest.
    ``prior`` is the share of label 1 where the model will be used; the bias is shifted to it from the sample's.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    # all n-grams in one flat array (4 bytes each), as thousands of small ones would stay with the driver
    most = sum(len(SIZES) * (len(t) + 2) for t in texts)
    buckets, ends, starts = np.empty(most, np.int32), [0], []
    seen = np.zeros(size, np.int32)
    for t in texts:
        ids, begin = _spans(t)
        seen[np.unique(ids)] += 1
        ends.append(ends[-1] + len(ids))
        buckets[ends[-2] : ends[-1]] = ids
        starts.append(begin.astype(np.int32))
    common = seen >= MIN_DOCS
    e = np.zeros((size, WIDTH), np.float32)
    head = rng.normal(0, 1, (WIDTH, 2))
    bias = np.zeros(2)
    g_e, g_head, g_bias = np.full(size, 1e-8), np.full((WIDTH, 2), 1e-4), np.full(2, 1e-4)
    for epoch in range(EPOCHS if texts else 0):
        for k in rng.permutation(len(texts)):
            ids, begin = buckets[ends[k] : ends[k + 1]], starts[k]
            if epoch and len(begin) > 1:
                many = np.diff(np.append(begin, len(ids)))
                s = int((np.add.reduceat(e[ids] @ (head[:, 1] - head[:, 0]).astype(np.float32), begin) / many).argmax())
                ids = ids[begin[s] : begin[s] + many[s]]
            u, n = np.unique(ids, return_counts=True)
            w = n[common[u]] / max(1, len(ids))
            u = u[common[u]]
            x = w @ e[u]
            z = x @ head + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = head @ p
            d_head = np.outer(x, p)
            g_head += d_head**2
            g_bias += p**2
            g_e[u] += w**2 * float(back @ back) / WIDTH
            e[u] -= (RATE * w / np.sqrt(g_e[u]))[:, None] * back
            head -= RATE * d_head / np.sqrt(g_head)
            bias -= RATE * p / np.sqrt(g_bias)
    if prior is not None and 0 < sum(labels) < len(labels):
        share = sum(labels) / len(labels)
        bias[1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(e, head, bias)


def score(text: str, weight: np.ndarray, bias: float) -> float:
    """The highest probability of label 1 of a text's spans (of the bias alone where it has no n-gram)."""
    best, total, n, span = -np.inf, 0.0, 0, 0  # of finished spans, and of the open one
    for ids, word in located(text, SIZES, BITS):  # slices of a long text; a span may go on in the next one
        if not len(ids):
            continue
        number = word // SPAN
        low = int(number.min())
        sums, many = np.bincount(number - low, weight[ids]), np.bincount(number - low)
        if low == span:
            sums[0], many[0] = sums[0] + total, many[0] + n
        elif n:
            best = max(best, total / n)
        done = (sums[:-1] / np.maximum(many[:-1], 1))[many[:-1] > 0]
        best = max(best, float(done.max(initial=-np.inf)))
        total, n, span = float(sums[-1]), int(many[-1]), low + len(sums) - 1
    best = max(best, total / n) if n else 0.0
    return float(1 / (1 + np.exp(-np.clip(bias + best, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: dict[int, int] | None = None) -> Model:
    """Fit on at most ``sample`` documents of each label, the ones of least id hash, outside the held-out quarter.

    Labels are ranked without their texts, so only the chosen ids (a number bounded by ``sample``) are
    broadcast to the documents, whose texts are not shuffled. Null labels and ids are left out; of
    repeated ids one row is taken.
    """
    sample = sample or SAMPLE
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    lab = lab if usable is None else lab.where(usable)
    counts = {r[0]: r[1] for r in lab.groupBy("toxic").count().collect()}
    picked = []
    for k, most in sample.items():
        picked += lab.where(F.col("toxic") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most).collect()
    if not picked:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(picked, lab.schema)
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out()).join(F.broadcast(chosen), "doc_id")
    got = got.groupBy("doc_id").agg(F.max(F.struct("text", "toxic")).alias("r")).select("doc_id", "r.*").collect()  # a row for each chosen id
    got.sort(key=lambda r: r["doc_id"])
    prior = min(0.99, max(0.01, counts.get(1, 0) / max(1, sum(counts.values()))))
    return fit([r["text"] for r in got], [r["toxic"] for r in got], prior=prior)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and letterless texts score the bias alone; repeated rows are all scored; an empty table
    gives no row; other columns are ignored. The model is 4 bytes a bucket (1 MB), whatever the input.
    """
    weight, bias = model.projected()

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, out, t in rows:
            s = score(t or "", weight, bias)
            yield i, out, s, int(s >= threshold)

    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = d.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    return d.mapInArrow(batched(make, schema, ("doc_id", "held_out", "text")), f"doc_id {kind.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject; text is judged where it stands, without a shuffle."""
    weight, bias = model.projected()
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                good = [score(t.as_py() or "", weight, bias) < threshold for t in b.column(at)]
                yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
