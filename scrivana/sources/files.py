"""Files as documents: text, Markdown, and a splitter along separators."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.functions.text import basename, extension
from scrivana.functions.views import MIME_TYPES, OTHER_MIME, labelled

#: Separators in order of preference, chunk size and overlap in characters.
SEPARATORS, SIZE, OVERLAP = ("\n\n", "\n", "。", "！", "？", "!", "?", " ", ""), 200, 20


def list_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """``path, length`` of a folder's files (not below it) with one of these extensions; contents are not read."""
    pattern = "*{" + ",".join(kinds) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path).select("path", "length")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, content`` of the files in a folder whose extension, in either case, has a reader; others give no row."""
    raw = read_texts(spark, path, "*.{txt,md,TXT,MD}")
    return raw.select("path", F.substr(extension(F.col("path")), F.lit(2)).alias("kind"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One row: a map from image name to its data URL, in order of name. For a folder of one document's images."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = basename(F.col("path"))
    url = F.concat(F.lit("data:"), labelled(extension(name), MIME_TYPES, F.lit(OTHER_MIME)), F.lit(";base64,"), F.base64("content"))
    return raw.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("name"), url.alias("url"))))).alias("images"))


def image_rows(spark: SparkSession, path: str) -> DataFrame:
    """``doc, name, url`` of the images in a folder of documents' folders: a row an image, so a document may have any number."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = basename(F.col("path"))
    doc = F.regexp_extract("path", r"([^/\\\\]*)[/\\\\][^/\\\\]*$", 1)
    url = F.concat(F.lit("data:"), labelled(extension(name), MIME_TYPES, F.lit(OTHER_MIME)), F.lit(";base64,"), F.base64("content"))
    return raw.select(doc.alias("doc"), name.alias("name"), url.alias("url"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """``path, content`` of the files in a folder (not below it): UTF-8, else GBK, else empty; files of no bytes have no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(path)

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            for code in ("utf-8", "gbk"):
                try:
                    return bytes(b).decode(code)
                except UnicodeDecodeError:
                    pass
            return ""

        return data.map(one)

    return raw.select("path", decode("content").alias("content"))


def _pieces(text: str, begin: int, end: int, sep: str) -> list[tuple[int, int]]:
    """Places of the parts of text[begin:end], each but the first starting with the separator."""
    if sep == "":
        return [(k, k + 1) for k in range(begin, end)]
    cuts, at = [begin], text.find(sep, begin, end)
    while at >= 0:
        cuts.append(at)
        at = text.find(sep, at + len(sep), end)
    return [(a, b) for a, b in zip(cuts, [*cuts[1:], end], strict=True) if a < b]


def _cut(text: str, begin: int, end: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    sep = next((s for s in separators if s == "" or text.find(s, begin, end) >= 0), "")
    rest = separators[separators.index(sep) + 1 :] or ("",)
    first, last = begin, begin  # the pieces held are text[first:last]
    starts: deque[int] = deque()
    for a, b in _pieces(text, begin, end, sep):
        if b - a > size:
            yield text[first:last]
            yield from _cut(text, a, b, size, overlap, rest)
            starts.clear()
            first = last = b
            continue
        if b - first > size and last > first:
            yield text[first:last]
            while starts and (last - first > overlap or b - first > size):
                starts.popleft()
                first = starts[0] if starts else last
        if not starts:
            first = a
        starts.append(a)
        last = b
    yield text[first:last]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that the text has and merged up to the size.

    A separator stays with what follows it, so every chunk stands in the text as it is, and only blanks at a chunk's ends are lost.
    """
    return [chunk for c in _cut(text, 0, len(text), size, overlap, separators) if (chunk := c.strip())]


def recursive_chunks(docs: DataFrame) -> DataFrame:
    """``id, chunk_index, content`` of documents (id, content); an empty or null text has no chunk."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, c) for i, t in zip(f["id"], f["content"], strict=True) for k, c in enumerate(split_text(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "content"])

    return docs.select("id", "content").mapInPandas(cut, "id long, chunk_index int, content string")
