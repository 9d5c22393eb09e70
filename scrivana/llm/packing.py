"""Packing token sequences by non-negative least squares.

Method: enumerate shallow length combinations that fill a window, solve their repeat counts
against the histogram of lengths, round down, and greedily pack what is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scrivana.llm.common import batched, materialise, prefix_sums, table

#: Tokens of a window, and of the unit in which lengths are combined.
WINDOW, UNIT = 2048, 64
#: Pieces that a combination has at most.
DEPTH = 4
#: The id that ends each document, as the query's contract fixes it.
END_ID = 1
#: Words whose ids a worker keeps.
CACHE_WORDS = 300_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Ids of whole texts, word by word.

    The vocabulary drops white space and never merges across it, so a text's ids are those of its
    words (cut at the six ASCII white spaces) in a row. Ids of frequent words are kept. New words of
    Latin letters go to the same merges in tiktoken's faster core (the end of a word is a byte that
    UTF-8 never has, merged first); all others to the tokenizer itself. Tests hold both against
    whole-text encoding.
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, suffix = spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        chars = _byte_chars()
        ranks, ids = {}, []

        def add(raw: bytes, token: str) -> None:
            if raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab.get(token, 0))

        def raw(token: str) -> bytes:
            body = token[: -len(suffix)] if token.endswith(suffix) else token
            return bytes(chars[c] for c in body) + b"\xff" * (body != token)

        for tail in ("", suffix):
            for c, b in sorted(chars.items(), key=lambda x: x[1]):
                if b < 255 or not tail:
                    add(bytes([b]) + b"\xff" * bool(tail), c + tail)
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            add(raw(a) + raw(b), a + b)
        self.ids = np.array(ids, np.uint32)
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.keep:
            self.known = {}
        merge, pieces, ids, flat, ends, fast, slow = self.merge, self.pieces, self.ids, [], [], [], []
        for b in words:
            w = b.decode("utf-8", "surrogatepass")
            if (b.isascii() or max(w) < "\u0250" and "\u0130" not in w) and "<|" not in w:
                for p in pieces(w.lower()):
                    flat += merge(p.encode() + b"\xff")
                ends.append(4 * len(flat))
                fast.append(b)
            else:
                slow.append((b, w))
        raw, start = ids[np.array(flat, np.int64)].tobytes(), 0
        for b, end in zip(fast, ends, strict=True):
            self.known[b] = raw[start:end]
            start = end
        for (b, _), e in zip(slow, self.tokenizer.encode_batch_fast([w for _, w in slow], add_special_tokens=False), strict=True):
            self.known[b] = np.array(e.ids, np.uint32).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        out, words = [], text.encode("utf-8", "surrogatepass").split()
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            ids = list(map(self.known.get, part))
            if None in ids:
                new = list(dict.fromkeys(w for w, i in zip(part, ids, strict=True) if i is None))
                if len(self.known) + len(new) > self.keep:
                    new = list(dict.fromkeys(part))  # learn() starts afresh
                self.learn(new)
                ids = list(map(self.known.__getitem__, part))
            out.append(b"".join(ids))
        return b"".join(out)


@lru_cache(1)
def _encoder(path: str) -> WordIds:
    """One per worker process, so that its words stay known from task to task."""
    return WordIds(path)


def cut_tokens(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its token count with the end id, and the CRC-32s of its canonical parts.

    A document is cut into whole windows, then a body of whole units, then a crumb of under one
    unit. ``full`` has a CRC per window, ``body`` one for each unit that the body may later be cut at
    (of the ids since the body's start is not enough, so one per unit), ``crumb`` that of the crumb.
    """
    path = path or tokenizer_path()

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder = _encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        for i, t in rows:
            ids = encoder.encode(t or "") + end
            n = len(ids) // 4
            whole, unit = n // WINDOW, 4 * UNIT
            full = [zlib.crc32(ids[4 * WINDOW * k : 4 * WINDOW * (k + 1)]) for k in range(whole)]
            body = ids[4 * WINDOW * whole : unit * (n // UNIT)]
            yield i, n, full, [zlib.crc32(body[k : k + unit]) for k in range(0, len(body), unit)], zlib.crc32(body), zlib.crc32(ids[unit * (n // UNIT) :]), len(t or "")

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("doc_tokens", pa.int64()), ("full", longs), ("units", longs), ("body", pa.int64()), ("crumb", pa.int64()), ("tie", pa.int64())])
    return d.mapInArrow(batched(make, schema, ("doc_id", "text")), f"doc_id {kind.simpleString()}, doc_tokens long, full array<long>, units array<long>, body long, crumb long, tie long")


def combinations(units: int = WINDOW // UNIT, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` lengths under ``units`` that add up to it."""

    def fill(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif parts:
            for k in range(min(left, most), 0, -1):
                if k * parts < left:
                    break
                yield from ((k, *rest) for rest in fill(left - k, k, parts - 1))

    return [c for c in fill(units, units - 1, depth)]


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 4000) -> np.ndarray:
    """min |ax - b| over x >= 0 by the active-set method of Lawson and Hanson (1974)."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        w = right - gram @ x
        w[passive] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tol:
            break
        passive[k] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if s[passive].min() > 0:
                x = s
                break
            bad = passive & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], units: int = WINDOW // UNIT, depth: int = DEPTH) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, first rank, ranks, first sequence, repeats per sequence, offset) and the number of sequences.

    Counts are rounded down, then lowered until no length is used more often than it occurs.
    """
    combos = combinations(units, depth)
    h = np.array([histogram.get(k, 0) for k in range(1, units)], float)
    if not h.sum():
        return [], 0
    a = np.zeros((units - 1, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    counts = np.floor(nnls(a, h) + 1e-9).astype(int)
    for k in range(units - 1):  # least squares may overshoot a length
        for j in np.flatnonzero(a[k] * counts)[::-1]:
            over = (a[k] @ counts) - h[k]
            if over <= 0:
                break
            counts[j] -= min(counts[j], math.ceil(over / a[k, j]))
    slots, used, sequences = [], dict.fromkeys(range(1, units), 0), 0
    for j in np.flatnonzero(counts):
        at = 0
        for k in combos[j]:
            slots.append((k, used[k], int(counts[j]), sequences, 1, at))
            used[k] += int(counts[j])
            at += k
        sequences += int(counts[j])
    return slots, sequences


def pack(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of ``docs``.

    Whole windows are sequences of their own. Bodies (1 to 31 units) go to the combinations that
    the least squares chose: the r-th body of a length, in order of id, takes the r-th slot for it.
    Left-over bodies are packed greedily end to end and cut at units where a window ends, so only the
    last one is padded. Crumbs are packed greedily uncut; a window is closed within a unit of its end.
    Only the 31-number histogram and one total per partition reach the driver.

    Null text: the end id alone. Null ids and repeated rows are documents of their own (pieces of
    equal rows are alike but for their places). An empty table gives no row; other columns are ignored.
    """
    units = WINDOW // UNIT
    t = materialise(cut_tokens(docs, path, id_col=id_col, text=text), "tokens")
    n = F.col("doc_tokens")
    whole = F.floor(n / WINDOW).cast("long")
    full = t.select("doc_id", "doc_tokens", "tie", F.posexplode("full").alias("k", "ids_crc32"))
    full = prefix_sums(full.withColumn("one", F.lit(1).cast("long")), [F.col("doc_id"), F.col("k"), F.col("ids_crc32")], "one", "full")
    full = full.select("doc_id", (F.col("k") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), "ids_crc32", "doc_tokens", F.col("before").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_full = t.agg(F.coalesce(F.sum(whole), F.lit(0))).first()[0]

    bodies = t.where(F.size("units") > 0).select("doc_id", "doc_tokens", (whole * WINDOW).alias("start"), F.size("units").alias("u"), "units", "body", F.lit(1).cast("long").alias("one"))
    bodies = prefix_sums(bodies, [F.col("u"), F.col("doc_id"), F.col("body")], "one", "bodies")
    histogram = {r[0]: r[1] for r in bodies.groupBy("u").count().collect()}
    slots, n_combined = plan(histogram)
    begin, total = {}, 0
    for k in range(1, units):
        begin[k], total = total, total + histogram.get(k, 0)
    spark = docs.sparkSession
    first = F.element_at(F.create_map(*[F.lit(x) for k in range(1, units) for x in (k, begin[k])]), F.col("u"))
    ranked = bodies.withColumn("rank", F.col("before") - first)
    taken = {k: max([0, *(s[1] + s[2] for s in slots if s[0] == k)]) for k in range(1, units)}
    limit = F.element_at(F.create_map(*[F.lit(x) for k in range(1, units) for x in (k, taken[k])]), F.col("u"))
    slot = spark.createDataFrame([(s[0], s[1], s[2], s[3], s[5]) for s in slots], "su int, low long, many long, seq long, at int")  # under DEPTH x combinations rows
    placed = ranked.where(F.col("rank") < limit).join(F.broadcast(slot), (F.col("u") == F.col("su")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("many")))
    placed = placed.select("doc_id", "start", (F.col("u") * UNIT).cast("long").alias("length"), F.col("body").alias("ids_crc32"), "doc_tokens", (F.lit(n_full) + F.col("seq") + F.col("rank") - F.col("low")).alias("sequence_id"), (F.col("at") * UNIT).cast("long").alias("offset"))

    rest = ranked.where(F.col("rank") >= limit).drop("before").withColumn("u", F.col("u").cast("long"))
    rest = prefix_sums(rest.select("doc_id", "doc_tokens", "start", "u", "units", "body"), [F.col("u").desc(), F.col("doc_id"), F.col("body")], "u", "rest")
    n_rest = rest.agg(F.coalesce(F.ceil(F.sum("u") / units), F.lit(0))).first()[0]
    base = n_full + n_combined

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, tokens, start, u, crcs, body, before in rows:
            at = 0
            while at < u:
                room = units - (before + at) % units
                take = min(room, u - at)
                crc = body if take == u else _joined(crcs[at : at + take])
                yield i, start + at * UNIT, take * UNIT, crc, tokens, base + (before + at) // units, (before + at) % units * UNIT
                at += take

    kind = t.schema["doc_id"].dataType
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = pa.schema([(c, to_arrow_type(kind) if c == "doc_id" else pa.int64()) for c in names])
    ddl = ", ".join(f"{c} {kind.simpleString() if c == 'doc_id' else 'long'}" for c in names)
    rest = rest.mapInArrow(batched(cut, out, ("doc_id", "doc_tokens", "start", "u", "units", "body", "before")), ddl)

    crumbs = t.where(n % UNIT > 0).select("doc_id", "doc_tokens", (n - n % UNIT).alias("start"), (n % UNIT).alias("length"), F.col("crumb").alias("ids_crc32"))
    crumbs = prefix_sums(crumbs, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "length", "crumbs")
    stride = WINDOW - UNIT + 1  # a crumb that starts before the stride ends within the window
    window = F.floor(F.col("before") / stride)
    crumbs = crumbs.withColumn("w", window)
    heads = crumbs.groupBy("w").agg(F.min("before").alias("head"))
    crumbs = crumbs.join(heads, "w").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(base + n_rest) + F.col("w")).alias("sequence_id"), (F.col("before") - F.col("head")).alias("offset"))
    return full.union(placed).union(rest).union(crumbs).select(*[F.col(c) if c == "doc_id" else F.col(c).cast("long").alias(c) for c in names])


def _joined(parts: list[int]) -> int:
    """The CRC-32 of units in a row from theirs."""
    crc = parts[0]
    for p in parts[1:]:
        crc = _advance(crc) ^ p
    return crc


def _unit_tables() -> list[list[int]]:
    """Per byte of a CRC-32: what it becomes when a unit of zero ids follows (CRC-32 is affine)."""
    zeros = bytes(4 * UNIT)
    blank = zlib.crc32(zeros)
    return [[zlib.crc32(zeros, v << shift) ^ blank for v in range(256)] for shift in (0, 8, 16, 24)]


_TABLES = _unit_tables()


def _advance(crc: int) -> int:
    return _TABLES[0][crc & 255] ^ _TABLES[1][crc >> 8 & 255] ^ _TABLES[2][crc >> 16 & 255] ^ _TABLES[3][crc >> 24]


def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
