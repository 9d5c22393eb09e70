"""Chunks of documents: merged where neighbours are alike, and put together again without their overlaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import preview, tokens

#: Chunks are merged above this cosine, with a blank between them.
ALIKE, BETWEEN = 0.7, " "
#: Places of a hashed term vector.
PLACES = 64


@lru_cache(100_000)
def _place(token: str, places: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % places


def term_vectors(toks: pa.ListArray, places: int) -> np.ndarray:
    """Tokens of each row counted by hashed place; a token of a batch is hashed once, however often it occurs."""
    codes = toks.flatten().dictionary_encode()
    place = np.array([_place(t, places) for t in codes.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(toks)), toks.value_lengths().to_numpy(zero_copy_only=False))
    return np.bincount(row * places + place[codes.indices.to_numpy(zero_copy_only=False)], minlength=len(toks) * places).reshape(len(toks), places)


def merge_alike(chunks: DataFrame, alike: float = ALIKE, places: int = PLACES) -> DataFrame:
    """``doc, chunk_index, first, parts, content`` of chunks (doc, chunk_index, content) merged in order: the next chunk joins the one so far while the
    cosine of their term vectors is above ``alike``, else it begins another. ``first`` is the index of its first part, ``parts`` how many it has.

    A vector counts tokens by hashed place, so that of the text so far is the sum of its parts' and is kept up as chunks stream by: a task holds
    one merged chunk, however long the document (each step needs the one before, so a document is one task's). Chunks without a token are alike to none. A document
    without chunks has none.
    """
    rows = chunks.select("doc", "chunk_index", "content").repartition("doc").sortWithinPartitions("doc", "chunk_index")
    rows = rows.withColumn("toks", F.coalesce(tokens(F.col("content")), F.array().cast("array<string>")))
    kind = chunks.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, number, first, parts, vector, out = None, 0, 0, [], None, []
        for b in batches:
            counted = term_vectors(b.column("toks"), places)
            for d, k, text, v in zip(*(b.column(c).to_pylist() for c in ("doc", "chunk_index", "content")), counted, strict=True):
                if parts and d == doc:
                    size = float(np.sqrt(float(vector @ vector)) * np.sqrt(float(v @ v)))
                    if size > 0 and float(vector @ v) / size > alike:
                        parts.append(text or "")
                        vector = vector + v
                        continue
                if parts:
                    out.append((doc, number, first, len(parts), BETWEEN.join(parts)))
                    number += 1
                if d != doc or not parts:
                    number = 0
                doc, first, parts, vector = d, k, [text or ""], v
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (b.schema.field("doc").type, pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc", "chunk_index", "first", "parts", "content"])
                kinds, out = b.schema.field("doc").type, []
            else:
                kinds = b.schema.field("doc").type
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((doc, number, first, len(parts), BETWEEN.join(parts)), (kinds, pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc", "chunk_index", "first", "parts", "content"])

    return rows.mapInArrow(run, f"doc {kind}, chunk_index int, first int, parts int, content string")


def overlap(before: Column, text: Column, most: int) -> Column:
    """Length of the longest end of ``before``, ``most`` characters at most, with which ``text`` starts; 0 for null."""
    sizes = F.sequence(F.lit(0), F.least(F.lit(most), F.length(before), F.length(text)))
    # the longest comes last; a length of 0 always fits
    return F.coalesce(F.array_max(F.filter(sizes, lambda n: F.right(before, n) == F.substring(text, F.lit(1), n))), F.lit(0))


def seamless(chunks: DataFrame, most: int = 20) -> DataFrame:
    """``doc, content, chunks`` of chunks (doc, chunk_index, content) that overlap the one before by up to ``most`` characters: the text they were cut from.

    Each chunk loses what the end of the one before already has. Where a text repeats itself the longest overlap is taken, so ``most`` must be the splitter's.
    """
    w = Window.partitionBy("doc").orderBy("chunk_index")
    before = F.lag("content").over(w)
    cut = chunks.select("doc", "chunk_index", "content", before.alias("before"))
    rest = F.when(F.col("before").isNull(), F.col("content")).otherwise(F.substr("content", overlap(F.col("before"), F.col("content"), most) + 1))
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", rest.alias("rest"))))
    return cut.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["rest"]), "").alias("content"), F.count("*").alias("chunks"))


def detail(chunks: DataFrame, images: DataFrame, shown: int = 100) -> DataFrame:
    """``doc, total, chunks, images`` of chunks (doc, chunk_index, chunk_id, content): an array of index, id, length and preview in order of index; images
    (doc, path) are a sorted array of distinct paths. Both are one document's, as its page shows them; a document without images has an empty array."""
    one = F.struct("chunk_index", "chunk_id", F.length("content").alias("size"), preview(F.col("content"), shown).alias("preview"))
    listed = chunks.groupBy("doc").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(one)).alias("chunks"))
    seen = images.where("path is not null").groupBy("doc").agg(F.array_sort(F.collect_set("path")).alias("images"))
    return listed.join(seen, "doc", "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))
