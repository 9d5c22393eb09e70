"""Distributed suffix sorting by the difference cover modulo 3.

Method (Kärkkäinen, Sanders and Burkhardt, "Linear work suffix array construction", 2006): sort the
sampled triples and name them, recurse on the strings of names, merge the remaining suffixes. Strings
have an end smaller than any symbol.

A level is a few shuffles of flat rows, one a suffix: triples are sorted over all partitions and named
by what stands before them, names go back to their strings; then all suffixes, with the ranks of the
sampled ones that follow, are sorted the same way, and the ranks go back. A suffix of a unique
triple is settled by its name, so the recursion keeps only the other names and the unique one that ends each
stretch of them (the discarding of Dementiev, Kärkkäinen, Mehnert and Sanders, "Better external memory suffix
array construction", 2008). The sorts are by all their
keys, the string and the place last, so suffixes that begin alike, however many, are cut anywhere
between two partitions. Rows follow from the symbols alone, never from the number of partitions; only
a sample for the bounds and a row for each partition reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.llm.common import discard, gathered, materialise, numbered, partitions, picked, tidy

_LISTS = "sid long, kind int, need int, vals array<long>"
_LIST_SCHEMA = pa.schema([("sid", pa.int64()), ("kind", pa.int32()), ("need", pa.int32()), ("vals", pa.list_(pa.int64()))])
#: What a row of ``_LISTS`` holds of its string: symbols, names of the sampled places, and the places of remainder 1 and 2 as
#: the recursion ranks them among those of one name. Names are doubled, and 1 higher if surely unique (from 2 on); their
#: ``need`` is over 3 where the string recurses.
_SYMBOLS, _NAMES, _FINE1, _FINE2 = range(4)
_SUFFIX = "x long, y long, z long, sid long, i int, need int"
_MERGED = "side int, x long, y long, z long, sid long, i int, own long"


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, row and index in its row of every value of a list column."""
    many = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(many)), many)
    return lists.flatten().to_numpy(zero_copy_only=False), row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _after(values: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The value k places further on in the row, 0 beyond its end."""
    out = np.zeros(len(values), np.int64)
    ok = np.flatnonzero(row[: len(row) - k] == row[k:]) if k < len(row) else np.empty(0, np.int64)
    out[ok] = values[ok + k]
    return out


def _lists(sid: np.ndarray, kind: int, need: np.ndarray, row_of: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A row of ``_LISTS`` for each string, from values in order of string."""
    ends = np.append(0, np.cumsum(np.bincount(row_of, minlength=len(sid)))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(np.full(len(sid), kind, np.int32)), pa.array(need.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))], schema=_LIST_SCHEMA)


def _grouped(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by string and place, and in that order the first row of each string and each row's number of its string."""
    sid, i = (_column(t, c).to_numpy() for c in ("sid", "i"))
    order = np.lexsort((i, sid))
    sid = sid[order]
    new = np.ones(len(sid), bool)
    new[1:] = sid[1:] != sid[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(at, 1 << 14) for at in range(0, batch.num_rows, 1 << 14))


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            b = whole.slice(at, 4096)
            sym, row, i = _flat(b.column("vals"))
            s = np.flatnonzero(i % 3 != 0)
            cols = [sym[s], *(_after(sym, row, k)[s] for k in (1, 2)), b.column("sid").to_numpy()[row[s]], i[s].astype(np.int32), b.column("need").to_numpy()[row[s]]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["x", "y", "z", "sid", "i", "need"])


def _named(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Names of each string's sampled places in order; three symbols are all that a string of unique triples needs."""
    order, first, row = _grouped(t)
    sid, need, name, alone = (_column(t, c).to_numpy(zero_copy_only=False)[order] for c in ("sid", "need", "before0", "alone"))
    settled = np.logical_and.reduceat(alone, first)
    yield from _parts(_lists(sid[first], _NAMES, np.where(settled, np.minimum(need[first], 3), need[first]), row, 2 * name + 2 + alone))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all that is known of a string the rows by which its suffixes are merged: those of remainder 0 with either kind of the others."""
    if (t := gathered(batches)) is None:
        return
    kind, sids = (_column(t, c).to_numpy() for c in ("kind", "sid"))

    def part(k: int) -> pa.Table:
        at = np.flatnonzero(kind == k)
        return t.take(pa.array(at[np.argsort(sids[at], kind="stable")]))

    s = part(_SYMBOLS)
    sym, row, i = _flat(_column(s, "vals"))
    own = np.zeros(len(sym), np.int64)  # 1 higher than the rank among sampled suffixes, so that 0 is the end
    names = part(_NAMES)
    name, of, j = _flat(_column(names, "vals"))
    own[i % 3 != 0] = name >> 1
    open_ = name % 2 == 0
    kept = np.zeros(len(sym), bool)
    kept[i % 3 != 0] = (_column(names, "need").to_numpy() > 3)[of] & (open_ | ((j >= 2) & np.roll(open_, 2)))  # as in _deeper
    if kept.any():
        # among suffixes of one name the deeper order decides; names have room for as many ranks as they have suffixes
        for k in (1, 2):
            own[kept & (i % 3 == k)] += _flat(_column(part(_FINE1 + k - 1), "vals"))[0]
    r1, r2, s2, sid = _after(own, row, 1), _after(own, row, 2), _after(sym, row, 1), _column(s, "sid").to_numpy()[row]
    for side, at, keys in ((0, np.flatnonzero(i % 3 != 2), (sym, r1, np.zeros_like(r1))), (1, np.flatnonzero(i % 3 != 1), (sym, s2, r2))):
        cols = [np.full(len(at), side, np.int32), *(k[at] for k in keys), sid[at], i[at].astype(np.int32), np.where(i[at] % 3 == 0, 0, own[at] - 1)]
        yield from _parts(pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["side", "x", "y", "z", "sid", "i", "own"]))


def _settled(t: pa.Table, relative: bool) -> Iterator[pa.RecordBatch]:
    """Ranks of each string's suffixes (among those of the same first symbol if ``relative``); one of remainder 0 has a part from either side."""
    order, _, row = _grouped(t)
    side, sid, i, own, *b = (_column(t, c).to_numpy()[order] for c in ("side", "sid", "i", "own", *(f"before{k}" for k in range(4))))
    left, zero = side == 0, i % 3 == 0
    part = np.where(left, np.where(zero, b[0] + b[1], own + b[0]), np.where(zero, b[3], own + b[2]))
    if relative:  # a suffix of remainder 0 has a part from either side
        within = sum(_column(t, f"within{k}").to_numpy()[order] for k in (0, 1, 3))
        part = part - np.where(left | ~zero, within, 0)
    new = np.ones(len(sid), bool)
    new[1:] = (sid[1:] != sid[:-1]) | (i[1:] != i[:-1])
    first = np.flatnonzero(new)
    head = np.flatnonzero(i[first] == 0)
    yield from _parts(_lists(sid[first][head], _SYMBOLS, np.zeros(len(head)), row[first], np.add.reduceat(part, first)))


def _read(make: Callable[..., Iterator[pa.RecordBatch]], read: Callable, *args) -> Callable:
    """A ``mapInArrow`` function that makes rows of all that a partition was sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := read(batches)) is not None:
            yield from make(t, *args)

    return tidy(run)


def _one(t: dict[str, np.ndarray]) -> np.ndarray:
    return np.ones(len(t["i"]), np.int64)


def _weigh_merged(t: dict[str, np.ndarray]) -> np.ndarray:
    side, zero = t["side"], t["i"] % 3 == 0
    return np.stack([(side == s) & (zero == z) for s in (0, 1) for z in (True, False)], axis=1)


def _deeper(halves: DataFrame) -> DataFrame:
    """The strings of the recursion: of each remainder's names those that are not unique, and the unique ones right after one of
    these. No two suffixes agree beyond a unique name, so what is left out between it and the next name changes no order."""

    def open_(name: Column) -> Column:
        return name.bitwiseAND(F.lit(1)) == 0

    def half(k: int) -> Column:
        kept = F.filter("vals", lambda name, at: (at % 2 == k) & (open_(name) | ((at >= 2) & open_(F.get("vals", at - 2)))))
        return F.struct((F.col("sid") * 2 + k).alias("sid"), F.transform(kept, lambda name: F.shiftright(name, 1)).alias("vals"))

    each = halves.where("need > 3").select(F.explode(F.array(half(0), half(1))).alias("h"), F.ceil(F.col("need") / 3).cast("int").alias("need"))
    return each.where(F.size("h.vals") > 0).select("h.sid", F.lit(_SYMBOLS).alias("kind"), "need", "h.vals")


def _ranked(strings: DataFrame, relative: bool) -> DataFrame:
    """Ranks (rows of ``_LISTS``) of the suffixes of strings (rows of ``_LISTS``), among those of the same first symbol if ``relative``."""
    spark, (most, size) = strings.sparkSession, strings.agg(F.coalesce(F.max("need"), F.lit(0)), F.coalesce(F.sum(F.size("vals")), F.lit(0))).first()
    n = partitions(spark, size)
    chosen = picked(spark, 2 * size // 3, "sid")
    names = numbered(strings, strings.where(chosen), _triples, _SUFFIX, 2 * size // 3, ["x", "y", "z", "sid", "i"], [["x", "y", "z"]], _one, 1, "names", ["sid", "i", "need"], alone=True, to=n)
    halves = materialise(names.mapInArrow(_read(_named, names._scrivana_read), _LISTS), "halves")
    discard(names)
    all_, fine = [strings, halves], None
    if most > 3:
        deeper = materialise(_deeper(halves), "deeper")
        fine = _ranked(deeper, True)
        discard(deeper)
        all_.append(fine.select(F.shiftright("sid", 1).alias("sid"), (F.lit(_FINE1) + F.col("sid").bitwiseAND(F.lit(1))).cast("int").alias("kind"), "need", "vals"))
    chosen = picked(spark, 4 * size // 3, "sid")
    both, some = (reduce(DataFrame.unionByName, frames).repartition(n, "sid") for frames in (all_, [f.where(chosen) for f in all_]))
    order = ["x", "side", "y", "z", "sid", "i"]
    runs = [["x", "side", "y", "z"], ["x"]] if relative else [["x", "side", "y", "z"]]
    merged = numbered(both, some, _spread, _MERGED, 4 * size // 3, order, runs, _weigh_merged, 4, "merged", ["side", "sid", "i", "own"], to=n)
    discard(halves, *([] if fine is None else [fine]))
    out = materialise(merged.mapInArrow(_read(_settled, merged._scrivana_read, relative), _LISTS), "ranks")
    discard(merged)
    return out


def suffix_ranks(strings: DataFrame) -> DataFrame:
    """``sid, ranks`` for strings (sid long from 0 on, syms array<long> of positive numbers, need int).

    ranks[i] is the number of suffixes, of all strings, that are smaller than suffix i. A string's
    suffixes are told apart by their first ``need`` symbols at least, so a string leaves the recursion
    at level log3(need); suffixes equal that far may or may not share a rank, but always stand
    together. (Equal prefixes must come with equal needs, as they do where the need follows from the symbols.)
    Empty strings have no row. Only a string's own symbols meet in one task.
    """
    given = materialise(strings.where(F.size("syms") > 0).select("sid", F.lit(_SYMBOLS).alias("kind"), "need", F.col("syms").alias("vals")), "strings")
    ranks = _ranked(given, False)
    discard(given)
    out = ranks.select("sid", F.col("vals").alias("ranks"))
    out._scrivana_path = ranks._scrivana_path
    return out
