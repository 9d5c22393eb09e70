"""Importance resampling of a corpus towards a target distribution.

Method: a 256-byte table lower-cases and blanks separators in the UTF-8 bytes, ``bytes.split`` gives the words, CRC-32s with the
CRC so far as seed extend n-grams word by word, and Counters of buckets, one a task, are summed by Spark. A document's weight
is the mean log ratio of its features' buckets in the target to those in the corpus; the highest sums of weight and Gumbel
noise, drawn from a hash of the id, are a sample without replacement by those weights.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from scrivana.llm.common import materialise, prefix_sums, table, tidy

#: Buckets of features, words of the longest feature, words of the shortest document that may be drawn, the share drawn in percent, and the noise's seed.
BUCKETS, GRAMS, LEAST_WORDS, SHARE, SEED = 10_000, 2, 20, 25, 7
#: Bytes of a text that are split at once.
SLICE = 1 << 20

#: A-Z to a-z; digits, a-z and all bytes of other characters stay; the rest of ASCII becomes a blank.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def features(text: bytes, grams: int = GRAMS, size: int = SLICE) -> Iterator[tuple[int, list[int]]]:
    """Slice by slice of a whole text: its number of words, and the CRC-32s of all features (runs of up to ``grams`` words) that end there."""
    text = text.translate(LOWER)
    at, last = 0, []  # last[k]: the CRC of the k + 1 words before the slice
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        words, at = text[at:end].split(), end
        if not words:
            continue
        spaced = [b" " + w for w in words] if grams > 1 else []
        level = list(map(crc32, words))
        out, ends = level, [level[-1]]
        for k in range(1, grams):
            # the runs of k words that end before each word; the first has one only if the text before the slice has so many words
            before = [*last[k - 1 : k], *level[:-1]]
            level = list(map(crc32, spaced[len(words) - len(before) :], before))
            if not level:
                break
            out = out + level
            ends.append(level[-1])
        last = ends
        yield len(words), out


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """``bucket, n``: how many features of all texts (null: none) fall in each bucket that has any. A task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for b in batches:
            for t in b.column(0):
                for _, crcs in features(t.as_py() or b"", grams):
                    counts.update((np.array(crcs, np.int64) % buckets).tolist())
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    part = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), "bucket int, n long")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A thousand times the log ratio of each bucket's smoothed shares in the target and the source, floored. ``buckets`` numbers, whatever the texts."""
    s, t = [0] * buckets, [0] * buckets
    for counts, into in ((source, s), (target, t)):
        for r in counts.collect():  # a row a bucket
            into[r["bucket"]] = r["n"]
    whole, aim = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((b + 1) * whole / ((a + 1) * aim))) for a, b in zip(s, t, strict=True)]


def noise(seed: int, doc_id: str) -> int:
    """A thousand times Gumbel noise from the first 32 bits of a hash, floored."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], *, id_col: str = "doc_id", text: str = "text", keep: list[str] = (), grams: int = GRAMS, seed: int = SEED) -> DataFrame:
    """``n_words, n_features, weight, score`` of every whole text (null: no words, weight 0) with the columns ``keep``, as ``__k0``, ``__k1`` ..."""
    kept = [F.col(c).alias(f"__k{k}") for k, c in enumerate(keep)]
    d = docs.select(*kept, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id"), F.col(text).cast("binary").alias("__text"))
    names, width = ["n_words", "n_features", "weight", "score"], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.array(gain, np.int64)
        for b in batches:
            found = []
            for i, t in zip(b.column("__id").to_pylist(), b.column("__text"), strict=True):
                words = n = total = 0
                for w, crcs in features(t.as_py() or b"", grams):
                    words, n = words + w, n + len(crcs)
                    total += int(table_[np.array(crcs, np.int64) % len(table_)].sum())
                weight = total // n if n else 0
                found.append((words, n, weight, weight + noise(seed, i)))
            cols = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *cols], names=[*b.schema.names[:width], *names])

    out = StructType(d.schema.fields[: len(kept)])
    for c in names:
        out = out.add(c, LongType())
    return d.mapInArrow(tidy(run), out)


def ranked(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: list[str] = (), buckets: int = BUCKETS, grams: int = GRAMS, least: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED) -> DataFrame:
    """As :func:`scored`, with the id first among ``keep``, and ``rank`` (1, 2, ...) for the documents drawn, null for others.

    Of the N documents with at least ``least`` words the floor(share * N / 100) highest scores are drawn, ties to the smaller id, null ids last; rows alike in both are drawn
    in a fixed order of no meaning. Each row of a repeated id is a document of its own. Ranks come from one range sort with distributed prefix sums.
    """
    gain = gains(bucket_counts(docs, text, buckets, grams), bucket_counts(target, text, buckets, grams), buckets)
    rows_ = scored(docs, gain, id_col=id_col, text=text, keep=[id_col, *keep], grams=grams, seed=seed)
    rows_ = materialise(rows_.withColumn("__tie", F.monotonically_increasing_id()), "scored")
    may = F.col("n_words") >= least
    quota = share * rows_.where(may).count() // 100
    order = [F.when(may, 0).otherwise(1), F.col("score").desc(), F.col("__k0").asc_nulls_last(), F.col("__tie")]
    placed = prefix_sums(rows_.withColumn("__one", F.lit(1).cast("long")), order, "__one", "ranked")
    rank = F.when(may & (F.col("before") < quota), F.col("before") + 1).alias("rank")
    return placed.select(*[f"__k{k}" for k in range(1 + len(keep))], "n_words", "n_features", "weight", "score", rank)


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns and nothing else. An empty corpus gives none; an empty target weighs by rarity alone."""
    options.setdefault("id_col", "doc_id")
    out = ranked(docs, target, keep=docs.columns, **options).where(F.col("rank").isNotNull())
    return out.select(*[F.col(f"__k{k + 1}").alias(c) for k, c in enumerate(docs.columns)])


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of ``documents`` drawn towards the texts of ``benchmark``; all documents are listed, with the rank of those drawn."""
    out = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("__k0").alias("doc_id"), "n_features", "weight", "score", "rank")
