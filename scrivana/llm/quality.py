"""Quality rules from tokeniser fertility.

Method: a public vocabulary measures characters per token, the share of byte-fallback tokens and
the entropy of a text's tokens; texts outside the bands of their language (or script) are rejected.
Spread and entropy depend on a text's length, so a band holds for texts of one language and about as many words.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scrivana.llm.common import batched, join_back, materialise, table

#: Fixed values of the query's contract.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 5, 10, 20
#: Words whose tokens a worker keeps.
CACHE_WORDS = 300_000
#: A group's bands reach so many interquartile ranges beyond its quartiles, each range taken as this at least (characters
#: per token, byte share, relative entropy). Chosen on labelled documents: see the README.
REACH, LEAST_RANGE = 2.0, (0.01, 0.01, 0.005)
#: Steps of one in which measures are counted.
STEPS = 10_000
#: Texts of its script that a group's quartiles are averaged with, so that a rare language has bands too.
SHRINK = 50
#: Groups up to this number are broadcast to the texts (some 100 bytes each); more are joined with their hot ones dealt.
BROADCAST_GROUPS = 20_000
MEASURES = ("chars_per_token", "byte_share", "entropy")
_RANGES = ((0x0370, "Grek"), (0x0400, "Cyrl"), (0x0530, "Armn"), (0x0590, "Hebr"), (0x0600, "Arab"), (0x0900, "Deva"), (0x0980, "Zyyy"), (0x0E00, "Thai"), (0x0E80, "Zyyy"), (0x3040, "Kana"), (0x3100, "Zyyy"), (0x3400, "Hani"), (0xA000, "Zyyy"), (0xAC00, "Hang"), (0xD7B0, "Zyyy"))
_STARTS = np.array([r[0] for r in _RANGES])


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordPieces:
    """Tokens of words, each on its own (this vocabulary never merges across a space)."""

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        import sentencepiece

        self.model, self.keep, self.known = sentencepiece.SentencePieceProcessor(model_file=path), keep, {}
        self.is_byte = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = list(map(self.known.get, words))
        if None in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i is None))
            if len(self.known) + len(new) > self.keep:
                self.known, new = {}, list(dict.fromkeys(words))
            for w, i in zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True):
                self.known[w] = array("H", i).tobytes()
            ids = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(ids), np.uint16)


@lru_cache(1)
def _pieces(path: str) -> WordPieces:
    """One per worker process, so that its words stay known from task to task."""
    return WordPieces(path)


def script_of(text: str) -> str:
    """The script most of the text's letters beyond ASCII punctuation are in; Latn for texts of Latin letters or none."""
    if text.isascii():
        return "Latn"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes[codes >= 0x0370]
    latin = int(((codes < 0x0370) & (codes > 64)).sum())
    if 2 * len(far) <= latin + len(far):
        return "Latn"
    names, counts = np.unique(np.searchsorted(_STARTS, far, side="right") - 1, return_counts=True)
    return _RANGES[int(names[counts.argmax()])][1]


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blanks = sum(raw.count(bytes([b])) for b in b" \t\n\r\x0b\x0c")
    symbols = sum(raw.count(bytes([b])) for b in SYMBOLS)
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip():
            seen.add(line)
    again = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        m = n - WINDOW + 1
        w = h[:m].copy()
        for k in range(1, WINDOW):
            w *= np.uint64(0x9E3779B97F4A7C15)
            w ^= w >> np.uint64(32)
            w += h[k : m + k]
        s = np.sort(w)
        twice = s[1:][s[1:] == s[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(w, twice))
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            again = int((np.cumsum(edge)[:n] > 0).sum())
    return n, len(text or "") - blanks, symbols, repeated, again, words


def fertility(words: list[bytes], pieces: WordPieces) -> tuple[int, float, float]:
    """Tokens, share of byte-fallback tokens, and entropy as a share of the most that as many tokens can have."""
    counts = np.zeros(len(pieces.is_byte), np.int64)
    for at in range(0, len(words), 1 << 16):
        ids = pieces.encode(words[at : at + (1 << 16)])
        counts += np.bincount(ids, minlength=len(counts))
    total = int(counts.sum())
    if not total:
        return 0, 0.0, 0.0
    p = counts[counts > 0] / total
    entropy = float(-(p * np.log2(p)).sum())
    return total, float(counts[pieces.is_byte].sum() / total), entropy / float(np.log2(max(2, min(total, len(counts)))))


def measure(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The base counts and fertility measures of every whole text, with the group (language, else script) whose bands apply."""
    path = path or tokenizer_path()

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        pieces = _pieces(path)
        for i, t, la in rows:
            n, chars, symbols, dup, again, words = base_counts(t)
            tokens, share, entropy = fertility(words, pieces)
            script = script_of(t or "")
            yield i, script, f"{la}" if la is not None else script, n, chars, symbols, dup, again, tokens, chars / tokens if tokens else None, share, entropy

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    kind = d.schema["doc_id"].dataType
    fields = [("doc_id", to_arrow_type(kind)), ("script", pa.string()), ("band", pa.string())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")] + [(c, pa.float64()) for c in ("chars_per_token", "byte_share", "entropy")]
    ddl = f"doc_id {kind.simpleString()}, script string, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double"
    return d.mapInArrow(batched(make, pa.schema(fields), ("doc_id", "text", "lang")), ddl)


def _quartiles(counts: DataFrame, group: list[str]) -> DataFrame:
    """A row for each group: of each measure an array of its quartiles. ``counts`` has a row for each step of a measure, few of them a group."""
    mine = Window.partitionBy(*group, "m")
    upto = F.sum("k").over(mine.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    c = counts.withColumn("upto", upto).withColumn("all", F.sum("k").over(mine))
    at = lambda k, p: F.min(F.when((F.col("m") == k) & (F.col("upto") >= p * F.col("all")), F.col("step"))) / STEPS
    return c.groupBy(*group).agg(*[F.array(*[at(k, p) for p in (0.25, 0.5, 0.75)]).alias(name) for k, name in enumerate(MEASURES)])


def bands(measured: DataFrame) -> DataFrame:
    """``band, script, size, n`` and for each measure ``low_``, ``high_``: the bands of every language and size (log2 of words).

    Quartiles of all documents that pass the base rules, averaged with those of all texts of the script and size as if SHRINK of
    these were in the group. Measures are counted in steps of 1 / STEPS, so the quartiles are those of the counts, in whatever order rows come.
    """
    good = measured.where("not base_failed")
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), F.round(F.col(c) * STEPS).cast("long").alias("step")) for k, c in enumerate(MEASURES)]))
    counts = good.select("band", "script", "size", step.alias("x")).groupBy("band", "script", "size", "x.m", "x.step").agg(F.count("*").alias("k"))
    counts = materialise(counts.where("step is not null"), "steps")
    n = good.groupBy("band", "script", "size").agg(F.count("*").alias("n"))
    own = n.join(_quartiles(counts, ["band", "script", "size"]), ["band", "script", "size"], "left")
    all_ = _quartiles(counts.groupBy("script", "size", "m", "step").agg(F.sum("k").alias("k")), ["script", "size"])
    all_ = all_.select("script", "size", *[F.col(c).alias(f"{c}_all") for c in MEASURES])
    q = lambda c, k: (F.col("n") * F.col(c)[k] + SHRINK * F.col(f"{c}_all")[k]) / (F.col("n") + SHRINK)
    reach = lambda c, least: REACH * F.greatest(q(c, 2) - q(c, 0), F.lit(least))
    edges = [e for c, least in zip(MEASURES, LEAST_RANGE, strict=True) for e in ((q(c, 0) - reach(c, least)).alias(f"low_{c}"), (q(c, 2) + reach(c, least)).alias(f"high_{c}"))]
    return own.join(all_, ["script", "size"]).select("band", "script", "size", "n", *edges)


def judge(docs: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Measures and verdict for every row of ``docs``.

    A text that passes the base rules is rejected if its characters per token leave its group's band (see :func:`bands`) on either
    side, its byte share exceeds it, or its entropy falls below it. Null texts have no words and fail the base rules; a null
    language uses the script; texts of any length are read whole; repeated rows are all judged; an empty table gives no row;
    other columns are ignored.
    """
    m = measure(docs, path, **columns).withColumn("size", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = materialise(m.withColumn("base_failed", failed), "quality")
    g = materialise(bands(m), "bands")
    group = ["band", "script", "size"]
    if g.count() <= BROADCAST_GROUPS:
        out = m.join(F.broadcast(g), group, "left")
    else:
        key = F.xxhash64(*group).alias("group")
        one = g.groupBy(key).agg(F.max("n").alias("n"), *[F.first(c).alias(c) for c in g.columns if c.startswith(("low_", "high_"))])
        out = join_back(m.withColumn("group", F.xxhash64(*group)), one, "group", "n", ["doc_id", "chars_per_token"], "left")
    c, b, e = MEASURES
    good = F.col(c).between(F.col(f"low_{c}"), F.col(f"high_{c}")) & (F.col(b) <= F.col(f"high_{b}")) & (F.col(e) >= F.col(f"low_{e}"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", "n_tokens", *MEASURES)


def op7_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
