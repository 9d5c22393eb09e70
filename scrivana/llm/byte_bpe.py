"""Byte-level BPE of a public vocabulary: texts to ids with offsets, and ids back to bytes and texts.

Method: the tokenizers library over Arrow batches. The vocabulary's byte strings are written in the public byte-to-character
alphabet, its ranks as merges of that library, and offsets of the ids tell which belong to which part of a text. Decoding
reverses the byte table; bytes of a character that are spread over ids come together before they are read as UTF-8.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scrivana.llm.common import table, tidy

#: Segments whose ids a worker keeps. A cache: it changes no result.
CACHE_SEGMENTS = 300_000
#: Code points that are looked at before their ids are joined, and ids that are decoded at once.
SLICE = 1 << 18
#: White space as the pattern's ``\s`` takes it; Python's own takes four control characters more.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The public alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBpe:
    """Ids of whole texts and their bytes, for the ranks in a file.

    A match of the pattern never goes on into white space, nor from letters and digits into punctuation but for an apostrophe. So a
    text is cut where white space begins and between a word and the marks after it; each segment is encoded once as long as it is
    remembered. New segments are put one after another into one string, whose ids are dealt back to them by their offsets.
    """

    def __init__(self, path: str, keep: int = CACHE_SEGMENTS):
        import os

        import public_tokenizers
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_characters()
        name = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        self.names: list[str | None] = [None] * (max(ranks.values()) + 1)
        merges = []
        for t in sorted(ranks, key=ranks.get):
            self.names[ranks[t]] = name[t]
            # each pair that makes the token, those whose second part is shortest first: where two pairs overlap, the left one is such
            merges += [(name[t[:m]], name[t[m:]]) for m in range(len(t) - 1, 0, -1) if t[:m] in ranks and t[m:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated")
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(chars)}
        self.bytes = [None if n is None else bytes(map(byte_of.__getitem__, n)) for n in self.names]
        self.segments = re.compile(f"[{SPACE}]*(?:[^\\W_]+(?=[{SPACE},.;:!?])|[^{SPACE}]+)|[{SPACE}]+").findall
        self.blank = re.compile(f"[{SPACE}]").match
        self.keep, self.known = keep, {}

    def learn(self, new: list[str]) -> None:
        """Encode segments and remember them. Those that do not start with white space, or hold nothing else, stand alone."""
        row, alone = [], []
        for s in new:
            (row if self.blank(s) and not self.blank(s, len(s) - 1) else alone).append(s)
        if row:
            e = self.tokenizer.encode("".join(row), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids))
            ends = np.searchsorted(starts, np.cumsum([len(s) for s in row]), "left").tolist()
            raw, at = np.array(e.ids, "<u4").tobytes(), 0
            for s, end in zip(row, ends, strict=True):
                self.known[s] = raw[4 * at : 4 * end]
                at = end
        for s, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.known[s] = np.array(e.ids, "<u4").tobytes()

    def slices(self, text: str) -> Iterator[list[str]]:
        """A text's segments, those of about SLICE code points at a time; a slice ends before a blank that follows a letter."""
        at = 0
        while len(text) - at > SLICE:
            cut = _LETTER_BLANK(text, at + SLICE)
            if not cut:
                break
            yield self.segments(text[at : cut.start() + 1])
            at = cut.start() + 1
        yield self.segments(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            new = {s: None for _, part in held for s in part if s not in self.known}
            if len(self.known) + len(new) > self.keep:
                self.known, new = {}, {s: None for _, part in held for s in part}
            self.learn(list(new))
            for k, part in held:
                out[k].append(b"".join(map(self.known.__getitem__, part)))
            held.clear()

        for k, t in enumerate(texts):
            for part in self.slices(t):
                held.append((k, part))
                size += len(part)
                if size > SLICE >> 2:
                    flush()
                    size = 0
        flush()
        return [b"".join(x) for x in out]

    def offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the code points ``[start, end)`` that each touches; ids of one split character share it."""
        ids, starts, ends, at = [], [], [], 0
        for part in self.slices(text):
            whole = "".join(part)
            e = self.tokenizer.encode(whole, add_special_tokens=False)
            ids += e.ids
            starts += [a + at for a, _ in e.offsets]
            ends += [b + at for _, b in e.offsets]
            at += len(whole)
        return ids, starts, ends

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes of little-endian ids; None if one is not of the vocabulary."""
        out = []
        for at in range(0, len(ids), 4 * SLICE):
            part = np.frombuffer(ids[at : at + 4 * SLICE], "<u4")
            if part.max(initial=0) >= len(self.bytes):
                return None
            found = list(map(self.bytes.__getitem__, part.tolist()))
            if None in found:
                return None
            out.append(b"".join(found))
        return b"".join(out)


_LETTER_BLANK = re.compile("[A-Za-z](?= )").search


@lru_cache(2)
def _codec(path: str) -> ByteBpe:
    """One per worker process, so that its segments stay known from task to task."""
    return ByteBpe(path)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Some texts at a time (about SLICE code points, one at least), null as empty, with the place of the first."""
    at, size, held = 0, 0, []
    for k, t in enumerate(column):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > SLICE:
            yield at, held
            at, size, held = k + 1, 0, []
    if held:
        yield at, held


def encode(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` (binary: unsigned 32-bit, little-endian) of every whole text; with ``offsets`` also the ``starts`` and ``ends`` (arrays).

    A null text is empty and has no ids. A row of the result belongs to a row of ``docs``, repeated or null ids included; other
    columns are not looked at. The text's special strings, if any, are ordinary text.
    """
    path = path or vocabulary_path()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType
    longs = pa.list_(pa.int64())
    fields = [("doc_id", to_arrow_type(kind)), ("ids", pa.binary()), *((n, longs) for n in ("starts", "ends") if offsets)]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            for at, texts in _texts(b.column("text")):
                ids = b.column("doc_id").slice(at, len(texts)).cast(schema.field("doc_id").type)
                if offsets:
                    found = [codec.offsets(t) for t in texts]
                    cols = [pa.array([np.array(i, "<u4").tobytes() for i, _, _ in found], pa.binary()), *(pa.array([x[k] for x in found], longs) for k in (1, 2))]
                else:
                    cols = [pa.array(codec.encode(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, *cols], schema=schema)

    more = ", starts array<long>, ends array<long>" if offsets else ""
    return d.mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, ids binary{more}")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``tokens`` (``ids`` as :func:`encode` gives them, whatever else) with ``decoded`` (binary).

    Null ids, and ids of which one is not of the vocabulary, have a null ``decoded``; no ids have an empty one.
    ``decoded`` is read as UTF-8 only when it is whole (``F.decode`` or :func:`as_text`), so a character may be spread over ids.
    A column named ``decoded`` is replaced.
    """
    path = path or vocabulary_path()
    t = tokens.drop("decoded")
    names = t.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for b in batches:
            raw = b.column("ids")
            at, size, held = 0, 0, []
            for k, x in enumerate(raw):
                ids = x.as_py()
                held.append(None if ids is None else codec.decode(ids))
                size += len(held[-1] or b"")
                if size > 4 * SLICE or k == len(raw) - 1:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "decoded"])
                    at, size, held = k + 1, 0, []

    from pyspark.sql.types import BinaryType, StructType

    return t.mapInArrow(tidy(run), StructType([*t.schema.fields]).add("decoded", BinaryType()))


def as_text(decoded: str = "decoded"):
    """The text of whole decoded bytes."""
    return F.decode(F.col(decoded), "UTF-8")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests. A null text is empty; repeated rows are each a row."""
    tokens = encode(table(spark, sf_dir, "documents"))
    back = decode(tokens)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return back.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
