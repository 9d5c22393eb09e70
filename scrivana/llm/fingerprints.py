"""Document fingerprints from closed syncmers.

Method: a k-mer of code points is chosen if its least inner s-mer stands at either edge. The choice
depends on the k-mer alone, so an edit moves no anchor beyond its own k-mer, and anchors of two
texts can be matched by place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import batched, shuffle_partitions, table

#: Code points of a k-mer and of its inner s-mers; anchors that a fingerprint keeps.
K, S, KEEP = 8, 3, 48
#: Code points that are hashed at a time.
_SLICE = 1 << 18
_M1, _M2, _M3 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    return x ^ (x >> np.uint64(31))


def closed_syncmers(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the closed syncmers of a text's code points (ties at an edge count)."""
    if len(codes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    c = codes.astype(np.uint64)
    n = len(c) - s + 1
    inner = c[:n].copy()
    for j in range(1, s):
        inner *= _M2
        inner += c[j : n + j]
    inner = _mix(inner)
    width, least, have = k - s + 1, inner, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - width + have], least[width - have :])
    first, last = inner[: len(least)], inner[width - 1 :]
    at = np.flatnonzero((least == first) | (least == last))
    h = np.zeros(len(at), np.uint64)
    for j in [*range(0, k - s, s), k - s]:
        h = _mix(h ^ inner[at + j])
    return h, at


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Closed syncmers of a whole text, a slice at a time; slices overlap by a k-mer less one."""
    found = []
    for at in range(0, max(1, len(text) - K + 1), _SLICE):
        codes = np.frombuffer(text[at : at + _SLICE + K - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h, p = closed_syncmers(codes)
        found.append((h, p + at))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketch(h: np.ndarray, at: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The KEEP least distinct hashes (40 bits) with the place of their first anchor; a text without anchors is one by itself."""
    if not len(h):
        whole = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "<u8") >> np.uint64(24)
        return (whole, np.zeros(1, np.int64)) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
    h = h >> np.uint64(24)
    if len(h) > 8 * KEEP:  # nothing above the 4 KEEP-th smallest matters unless they are mostly repeats
        few = np.partition(h, 4 * KEEP)[4 * KEEP]
        low = np.flatnonzero(h <= few)
        if len(np.unique(h[low])) >= KEEP:
            h, at = h[low], at[low]
    u, first = np.unique(h, return_index=True)  # places ascend, so the first index is the first place
    return u[:KEEP], at[first[:KEEP]]


def to_text(s: tuple[np.ndarray, np.ndarray]) -> str:
    """18 hex digits an anchor: 10 of the hash, 8 of the place (a string has under 2^32 code points)."""
    h, at = (x.astype(">u8").view(np.uint8).reshape(-1, 8) for x in s)
    return np.concatenate([h[:, 3:], at[:, 4:]], axis=1).tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 9)
    pad = lambda x: np.pad(x, ((0, 0), (8 - x.shape[1], 0))).copy().view(">u8")[:, 0]
    return pad(raw[:, :5]).astype(np.uint64), pad(raw[:, 5:]).astype(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the share of anchors that two fingerprints have in common at matching places.

    The least KEEP hashes of the union estimate the Jaccard index j; common ones count if their
    shift is near the median shift of all common ones. The share is 2j / (1 + j). Empty texts are
    alike (1) among themselves and unlike (0) any other.
    """
    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    union = np.union1d(ha, hb)[:KEEP]
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    inside = ha[i] <= union[-1]
    i, j = i[inside], j[inside]
    if not len(i):
        return 0.0
    shift = pa_[i] - pb[j]
    reach = max(16, int(max(pa_.max(), pb.max())) // 16)
    share = int((np.abs(shift - np.median(shift)) <= reach).sum()) / len(union)
    return 2 * share / (1 + share)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    tail = len(text) // 4
    return text[: len(text) - tail] + following[:tail]


def edited_anchors(h: np.ndarray, at: np.ndarray, edited: str, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the edited text from those of the text: only k-mers past the kept part are hashed anew."""
    cut = int(np.searchsorted(at, kept - K, side="right"))
    begin = max(0, kept - K + 1)
    h2, at2 = anchors(edited[begin:])
    return np.concatenate([h[:cut], h2]), np.concatenate([at[:cut], at2 + begin])


_FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _describe(i, text: str, h, at, mine, following: str | None, theirs) -> tuple:
    edited = edited_text(text, following or "")
    h2, at2 = edited_anchors(h, at, edited, len(text) - len(text) // 4)
    changed = sketch(h2, at2, edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return i, len(text), digest, to_text(mine), to_text(changed), likeness(mine, changed), None if theirs is None else likeness(mine, theirs)


def _stream(rows_: Iterator[tuple]) -> Iterator[tuple]:
    """Rows in order of (block, role, id): each is finished when the next one comes."""
    held, block_open = None, None
    for block, role, i, text in rows_:
        text = text or ""
        if block != block_open:
            held, block_open = None, block
        h, at = anchors(text)
        mine = sketch(h, at, text)
        if role == 2:  # no id, so no place in the order
            yield _describe(i, text, h, at, mine, None, None)
            continue
        if held is not None:
            yield _describe(*held, text, mine)
        held = None if role == 1 else (i, text, h, at, mine)


def fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text (null: empty, whose fingerprint is empty)."""

    def make(rows_: Iterator[tuple]) -> Iterator[tuple]:
        for i, t in rows_:
            t = t or ""
            yield i, to_text(sketch(*anchors(t), t))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(batched(make, pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())]), ("doc_id", "text")), "doc_id long, fingerprint string")


def against_next(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses (see ``_FIELDS``).

    The texts are shuffled once, into ranges of ids whose bounds are approximate quantiles (one
    number per partition reaches the driver). The first document of each range is also sent to the
    range before it (that of all to the last), so each task sees what follows its own rows; a task
    streams its sorted rows and holds two texts at a time. Equal ids stand in order of their text's hash.
    Rows without id have no place in the order: nothing follows them and near_next is null.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bounds = d.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    splits = [-float("inf"), *sorted({float(b) for b in bounds or []}), float("inf")]
    d = d.withColumn("x", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="x", outputCol="b", handleInvalid="keep").transform(d)
    else:
        d = d.withColumn("b", F.lit(0))
    d = d.withColumn("b", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n))).otherwise(F.col("b")).cast("int")).drop("x")
    heads = [tuple(r) for r in d.where("doc_id is not null").groupBy("b").agg(F.min("doc_id")).orderBy("b").collect()]  # a row per partition at most
    halo = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    halo = spark.createDataFrame(halo, "head long, target int")
    d = d.join(F.broadcast(halo), d["doc_id"] == halo["head"], "left")
    role = F.when(F.col("doc_id").isNull(), 2).otherwise(0)
    own, more = F.struct(F.col("b"), role.alias("role")), F.struct(F.col("target").alias("b"), F.lit(1).alias("role"))
    d = d.withColumn("to", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, more)))).select("to.b", "to.role", "doc_id", "text")
    d = d.repartitionById(n, F.col("b")).sortWithinPartitions("b", "role", "doc_id", F.xxhash64("text"), "text")
    out = pa.schema([(c, k) for c, k in zip(_FIELDS, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)])
    return d.mapInArrow(batched(_stream, out, ("b", "role", "doc_id", "text")), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))
