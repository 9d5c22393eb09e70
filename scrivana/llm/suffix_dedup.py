"""Removal of repeated 100-byte strings by a distributed suffix array.

Method: the difference-cover algorithm of :mod:`scrivana.llm.suffix_array`, on texts rewritten over
an alphabet of phrases. Byte suffixes of a whole corpus are too many to sort; most start nothing
that occurs twice, and what does occur twice mostly occurs as long passages. So

1. closed syncmers cut each text into phrases (two anchors in a row with what lies between), a
   choice that depends on content alone: any 100-byte string holds a whole phrase, and equal strings
   hold equal phrases. What holds a phrase that occurs once in the corpus occurs once;
2. runs of repeated phrases are cut into strings, again by content alone, each with as many of the
   phrases that follow as its suffixes are compared by; equal strings are kept once, with their
   earliest place and their number;
3. the suffixes of these strings are sorted, and adjacent ones with equal prefixes of 100 bytes and
   more form runs. In a run all but the earliest place are repeats; if in addition every occurrence
   of the run's inner phrase belongs to the run, all is known about the strings around its start;
4. the remaining starts, which lie near the ends of copied passages where a match may go on for part
   of a phrase, are compared as byte strings, by hash (64 bits) against each other. The earliest
   occurrence of any of them is among them, as what step 3 settles as first or repeated is so.

Removal is exact up to hash collisions; tests hold it against brute force.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import _hashed, discard, frequent, gathered, join_back, materialise, partitions, picked, prefix_sums, shuffle_partitions, sorted_parts, table, tidy
from scrivana.llm.packed import Columns, pack, packed_ddl, unpack
from scrivana.llm.suffix_array import suffix_ranks

#: Bytes of a string whose repeats go; bytes of an anchor and of its inner strings: 3 K - 2 S - 2 <= LENGTH
#: makes each string hold two whole anchors, hence a phrase.
LENGTH, K, S = 100, 44, 16
#: More than any two anchors in a row are apart.
GAP = 64
#: A string of phrases is cut before every phrase whose hash is a multiple of PIECE, and after LONGEST phrases
#: (which makes a periodic passage a few strings over and over).
PIECE, LONGEST = 16, 32
_SLICE, _FLUSH = 1 << 20, 1 << 20
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_P = {1: 0xD6E8FEB86659FD93}
for _n in (2, 4, 8):
    _P[_n] = pow(_P[1], _n, 1 << 64)
_P = {n: np.uint64(v) for n, v in _P.items()}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


def _eights(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of every 4 and of every 8 bytes."""
    one = _TABLE.take(raw)
    two = one[:-1] * _P[1] + one[1:]
    four = two[:-2] * _P[2] + two[2:]
    return four, four[:-4] * _P[4] + four[4:]


def _joined(eight: np.ndarray, four: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` bytes (a multiple of 8, plus 4) from each place."""
    h = eight[at]
    for k in range(8, length - 4, 8):
        h = h * _P[8] + eight[at + k]
    return h * _P[4] + four[at + length - 4]


def _anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    four, eight = _eights(raw)
    inner = (_mix(eight[: len(raw) - S + 1] * _P[8] + eight[8:]) >> np.uint64(32)).astype(np.uint32)
    width, least, have = K - S + 1, inner, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - width + have], least[width - have :])
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[width - 1 :]))
    return at, _joined(eight, four, at, K)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text's bytes, slice by slice."""
    if len(raw) <= _SLICE:
        return _anchors(raw)
    found = [(p + at, h) for at in range(0, len(raw) - K + 1, _SLICE) for p, h in [_anchors(raw[at : at + _SLICE + K - 1])]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def phrases(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and hashes of the phrases, one fewer."""
    at, h = anchors(raw)
    if len(at) < 2:
        return at, np.empty(0, np.uint64)
    return at, _mix(h[:-1] * _M1 + h[1:] * _M2 + np.diff(at).astype(np.uint64))


def phrases_of(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of several texts' bytes at once: document number, place in it and hash of every anchor. An anchor depends on its own bytes alone, so it is the
    same in a row of texts; those that lie across two are none."""
    ends = np.cumsum([len(t) for t in texts])
    at, h = anchors(np.concatenate(texts) if texts else np.empty(0, np.uint8))
    doc = np.searchsorted(ends, at, "right")
    ok = at + K <= ends[doc] if len(at) else np.zeros(0, bool)
    doc, at, h = doc[ok], at[ok], h[ok]
    return doc, at - (np.append(0, ends)[doc]), h


def string_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH bytes from each start (ascending)."""
    out, first = [], 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(starts, low + _SLICE))
        q = starts[first:last] - low
        four, eight = _eights(raw[low : int(starts[last - 1]) + LENGTH])
        out.append(_mix(_joined(eight, four, q, LENGTH)))
        first = last
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def _columns(b: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(b.column(n).to_pylist() for n in names), strict=True)


def _small(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from _columns(b.slice(at, 256), names)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


#: Documents (and for each partition), and open starts for each partition, whose frequent phrases and strings stand for those of all.
SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_STARTS = 4000, 16, 640


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _frequent(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which hashes are frequent ones."""
    return hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)


def _met(c: Columns, n: int) -> np.ndarray:
    """The partition where a phrase's occurrences meet; those of frequent ones are dealt evenly."""
    own = _mix(_mix(c["key"].view(np.uint64).copy()) + c["at"].view(np.uint64)).view(np.int64)
    return _hashed(np.where(c["hot"] > 0, own, c["h"]), n)


def _phrase_rows(docs: DataFrame) -> DataFrame:
    """The hash of every phrase occurrence."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in _small(batches, ["key", "text"]):
            h = phrases(_bytes(text))[1].view(np.int64)
            for k in range(0, len(h), _FLUSH):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + _FLUSH])], names=["g"])

    return docs.select("key", "text").mapInArrow(tidy(make), "g long")


#: Phrase occurrences as they are packed: document key, phrase number times GAP plus its anchors' distance, hash, and whether it is a frequent one; and those that occur again.
_OCCURS, _AGAIN = "key long, at long, h long, hot boolean", "key long, at long, h long, n long"


def _grouped_texts(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows (the second column a text, as bytes) in groups of about a slice of text, a row at least."""
    held, size = [], 0
    for key, text, *rest in _small(batches, names):
        held.append((key, _bytes(text), *rest))
        size += len(held[-1][1])
        if size >= _SLICE or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def _occurrences(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[Columns]:
    for group in _grouped_texts(batches, ["key", "text"]):
        doc, at, h = phrases_of([raw for _, raw in group])
        if len(at) < 2:
            continue
        first = np.searchsorted(doc, doc, "left")  # each document's first anchor
        same = np.flatnonzero(doc[1:] == doc[:-1])
        gap = at[same + 1] - at[same]
        part = _mix(h[same] * _M1 + h[same + 1] * _M2 + gap.astype(np.uint64)).view(np.int64)
        keys = np.array([key for key, _ in group], np.int64)
        yield {"key": keys[doc[same]], "at": (same - first[same]) * GAP + gap, "h": part, "hot": _frequent(part, hot)}


def _repeated(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The occurrences of phrases that occur twice or more (``key, at, h, n``), a document's in one partition, and the frequent phrases.

    n is how often the phrase occurs, or 0 (unknown) for the few frequent ones, whose occurrences never meet.
    """
    few, many = max(SAMPLE_DOCS, SAMPLE_EACH * shuffle_partitions(docs.sparkSession)), docs.count()
    sample = docs if many <= few else docs.sample(few / many, seed=7)
    often, seen = frequent(_phrase_rows(sample), "g")
    hot, n = np.array(sorted(often), np.int64), partitions(docs.sparkSession, 2 * seen * many // max(1, min(few, many)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(_occurrences(batches, hot), _OCCURS, lambda c: _met(c, n))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := unpack(batches, _OCCURS)) is None:
            return
        order = np.argsort(t["h"], kind="stable")
        _, many = _runs(t["h"][order])
        num = np.where(t["hot"][order] > 0, 0, np.repeat(many, many))
        order, num = order[num != 1], num[num != 1]
        yield from pack(iter([{"n": num} | {c: t[c][order] for c in ("key", "at", "h")}]), _AGAIN, lambda c: _hashed(c["key"], n))

    found = docs.select("key", "text").mapInArrow(tidy(deal), packed_ddl(_OCCURS)).repartitionById(n, "to").mapInArrow(tidy(find), packed_ddl(_AGAIN))
    return found.repartitionById(n, "to"), hot


_STRING = "sid long, key long, first int, length int, syms binary, nums binary, gaps binary"


def _strings(repeated: DataFrame) -> DataFrame:
    """A row per piece of a maximal run of repeated phrases: its hash, place and length; the first of its kind among some
    documents has the phrases too, and after its own those that its suffixes' prefixes reach into."""
    schema = _schema(_STRING)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := unpack(batches, _AGAIN)) is not None:
            yield from cut_some(*(t[c] for c in ("key", "at", "h", "n")))

    def cut_some(keys: np.ndarray, idx: np.ndarray, val: np.ndarray, num: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((idx, keys))
        keys, gap, idx, val, num = keys[order], (idx[order] % GAP).astype(np.uint8), idx[order] // GAP, val[order].view(np.uint64), np.minimum(num[order], 0xFFFFFFFF).astype("<u4")
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (idx[1:] != idx[:-1] + 1)
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(keys))
        head = new | (val % np.uint64(PIECE) == 0)
        since = np.arange(len(keys)) - np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
        begin = np.flatnonzero(since % LONGEST == 0)
        end = np.append(begin[1:], len(keys))  # of the piece's own phrases
        # places of phrases' first anchors within a corpus-wide order; a run's last anchor stands one step beyond its last phrase
        place = np.cumsum(np.insert(gap.astype(np.int64), starts, 4 * LENGTH))
        mine = np.arange(len(keys)) + run
        stop = np.where(end == ends[run[begin]], mine[end - 1] + 1, mine[np.minimum(end, len(keys) - 1)])
        reach = np.searchsorted(place, place[stop] + LENGTH - K) - run[begin]
        reach = np.maximum(np.minimum(reach, ends[run[begin]]), end)
        # a polynomial in an odd base, by prefix sums that the base's inverse shifts back to each piece's begin
        base, many = _M1 | np.uint64(1), len(keys) + 1
        power, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(many, b, np.uint64)]), dtype=np.uint64) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(val.copy()) * power[: len(keys)], dtype=np.uint64)])
        h = (total[reach] - total[begin]) * back[begin]
        sid = (_mix(h + _mix((reach - begin).astype(np.uint64) * _M2 + (end - begin).astype(np.uint64))) >> np.uint64(8)).astype(np.int64)  # the sorting doubles it once a level
        fresh = np.zeros(len(sid), bool)
        fresh[np.unique(sid, return_index=True)[1]] = True
        raw = val.tobytes(), num.tobytes(), gap.tobytes()
        out = []
        for c, d, e, s, f in zip(begin.tolist(), end.tolist(), reach.tolist(), sid.tolist(), fresh.tolist(), strict=True):
            out.append((s, int(keys[c]), int(idx[c]), d - c, *((raw[0][8 * c : 8 * e], raw[1][4 * c : 4 * e], raw[2][c:e]) if f else (None,) * 3)))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return repeated.mapInArrow(tidy(cut), _STRING)


def _names(strings: DataFrame) -> DataFrame:
    """Phrase hashes as positive longs (any consistent order will do), and the most phrases by which one of its suffixes is compared."""
    ddl = "sid long, syms array<long>, need int"
    schema = _schema(ddl)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for sid, syms, gaps in _columns(b, ["sid", "syms", "gaps"]):
                place = np.concatenate([[0], np.cumsum(np.frombuffer(gaps, np.uint8), dtype=np.int64)])
                last = np.searchsorted(place, place[1:] + LENGTH - K)
                need = int((np.minimum(last, len(place) - 1) - np.arange(len(last))).max())
                out.append((sid, (np.frombuffer(syms, "<u8") >> np.uint64(1)).astype(np.int64) | 1, need))
            yield _batch(out, schema)

    return strings.select("sid", "syms", "gaps").mapInArrow(tidy(make), ddl)


_PREFIX = "rank long, sid long, i long, prefix long, occurs long, key long, first long, inner long"


def _adjacent_runs(strings: DataFrame, ranks: DataFrame) -> DataFrame:
    """``sid, occurs`` and lists of ``k_i, k_key, k_first, k_whole``: of each string the suffixes with a prefix that reaches LENGTH bytes beyond their
    second anchor (what lies between the two can start nothing that reaches further), the earliest place of their run, and whether
    every occurrence of their second phrase belongs to it.

    Suffixes are sorted by rank; adjacent ones with equal prefixes (by hash) are a run. A task adds up its runs; the first and the last, which may go on in
    other partitions, are told to the driver, a row for each partition, and what they come to is put in when rows are read back by string.
    """
    schema = _schema(_PREFIX)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                col = lambda c, b=b: b.column(c).to_numpy(zero_copy_only=False)
                val, num, gap = (np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("syms", "<u8"), ("nums", "<u4"), ("gaps", np.uint8)))
                rank = b.column("ranks").flatten().to_numpy()
                many = col("occurs") * 0 + np.array([len(v) for v in b.column("gaps").to_pylist()])
                end = np.cumsum(many)
                row = np.repeat(np.arange(len(many)), many)
                i = np.arange(len(val)) - (end - many)[row]
                # anchors' places, every string's beyond those of the one before; a string has one anchor more than phrases
                step = np.insert(gap.astype(np.int64), end - many, 4 * LENGTH)
                place = np.cumsum(step)
                mine = np.arange(len(val)) + row  # a phrase's first anchor
                last = np.searchsorted(place, place[mine + 1] + LENGTH - K)
                good = np.flatnonzero((i < np.minimum(col("length"), many - 1)[row]) & (last <= (end + np.arange(len(many)))[row]))
                n, h = (last - mine)[good], np.zeros(len(good), np.uint64)
                for k in range(int(n.max(initial=0))):
                    go = np.flatnonzero(n > k)
                    h[go] = _mix(h[go] * _M2 + val[good[go] + k])
                r = row[good]
                cols = rank[good], col("sid")[r], i[good], h.view(np.int64), col("occurs")[r], col("key")[r], col("first")[r] + i[good], num[good + 1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], schema=schema)

    size = strings.agg(F.coalesce(F.sum(F.length("gaps")), F.lit(0))).first()[0]
    chosen = picked(strings.sparkSession, size, "sid")
    some = strings.where(chosen).join(ranks.where(chosen), "sid")
    dealt, n = sorted_parts(strings.join(ranks, "sid"), some, make, _PREFIX, size, ["rank", "sid", "i"]), partitions(strings.sparkSession, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        pid, t = held[0].column("to")[0].as_py(), unpack(iter(held), _PREFIX)
        del held
        order = np.lexsort((t["i"], t["sid"], t["rank"]))
        t = {c: v[order] for c, v in t.items() if c != "rank"}
        begin, many = _runs(t["prefix"])
        row = np.repeat(np.arange(len(begin)), many)
        all_ = np.add.reduceat(t["occurs"], begin)
        least = np.lexsort((t["first"], t["key"], row))[begin]  # the first of each run by place
        key, first, edge = t["key"][least], t["first"][least], np.zeros(len(begin), np.int32)
        edge[-1], edge[0] = _LAST, _FIRST_RUN
        note = [int(x) for k in (0, -1) for x in (t["prefix"][begin[k]], all_[k], key[k], first[k])] + [int(len(begin) == 1)]
        rows = {"sid": t["sid"], "i": t["i"], "occurs": t["occurs"], "inner": t["inner"], "all": all_[row], "key": key[row], "first": first[row], "edge": edge[row]}
        for b in pack(iter([rows]), _RUNS, lambda c: _hashed(c["sid"], n)):
            rest = [pa.array(np.full(b.num_rows, pid, np.int32)), pa.nulls(b.num_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *rest], names=[*b.schema.names, "pid", "note"])
        blank = [pa.nulls(1, k) for k in (pa.int32(), *[pa.binary()] * len(rows))]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([pid], pa.int32()), pa.array([note], pa.list_(pa.int64()))], names=["to", *rows, "pid", "note"])

    done = materialise(dealt.mapInArrow(tidy(run), f"{packed_ddl(_RUNS)}, pid int, note array<long>"), "sorted")
    edges = _merged_edges((r["pid"], r["note"]) for r in done.where("note is not null").select("pid", "note").orderBy("pid").collect())
    schema = _schema(_KNOWN)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                c, pid = unpack(iter([one]), _RUNS), one.column("pid")[0].as_py()
                for e in (_FIRST_RUN, _LAST):
                    if (pid, e) in edges and len(at := np.flatnonzero(c["edge"] == e)):
                        for name, x in zip(("all", "key", "first"), edges[pid, e], strict=True):
                            c[name] = c[name].copy()
                            c[name][at] = x
                parts.append(c)
        if not parts:
            return
        t = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
        order = np.lexsort((t["i"], t["sid"]))
        t = {c: v[order] for c, v in t.items()}
        begin, many = _runs(t["sid"])
        lists = [t["i"], t["key"], t["first"], (t["all"] == t["inner"]).astype(np.int64)]
        for k in range(0, len(begin), 1 << 14):
            s, m = begin[k : k + (1 << 14)], many[k : k + (1 << 14)]
            lo, hi = int(s[0]), int(s[-1] + m[-1])
            ends = pa.array(np.append(s, hi).astype(np.int32) - np.int32(lo))
            cols = [pa.array(t["sid"][s]), pa.array(t["occurs"][s]), *(pa.ListArray.from_arrays(ends, pa.array(x[lo:hi])) for x in lists)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    out = materialise(done.where("note is null").drop("note").repartitionById(n, "to").mapInArrow(tidy(known), _KNOWN), "known")
    discard(done)
    return out


#: Rows of suffixes as they are packed, which of a partition's runs may go on elsewhere, and what is known of a string.
_RUNS = "sid long, i long, occurs long, inner long, all long, key long, first long, edge int"
_FIRST_RUN, _LAST = 1, 2
_KNOWN = "sid long, occurs long, k_i array<long>, k_key array<long>, k_first array<long>, k_whole array<long>"


def _merged_edges(notes: Iterator[tuple[int, list[int]]]) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Sum and earliest place of the runs that are a partition's first or last, put together where they go on over partitions."""
    out, prefix, all_, least, members = {}, None, 0, None, []

    def close() -> None:
        out.update({m: (all_, *least) for m in members})

    for pid, n in notes:
        for e, (p, a, *place) in ((_FIRST_RUN, n[:4]), (_LAST, n[4:8]))[: 1 if n[8] else 2]:
            if e == _FIRST_RUN and p == prefix:
                all_, least = all_ + a, min(least, tuple(place))
                members.append((pid, e))
                continue
            close()
            prefix, all_, least, members = p, a, tuple(place), [(pid, e)]
    close()
    return out


#: What is known of the strings that start after a suffix's first anchor, up to the second: nothing, repeated, first.
_OPEN, _REPEATED, _FIRST = 0, 1, 2


def _verdicts(strings: DataFrame) -> DataFrame:
    """``key, info``: the pieces of repeated phrases in a document with a verdict byte for each suffix."""
    kinds = strings.groupBy("sid").agg(F.count("*").alias("occurs"), F.min(F.struct("key", "first")).alias("least"), F.max("length").alias("length"), *[F.first(c, ignorenulls=True).alias(c) for c in ("syms", "nums", "gaps")])
    kinds = materialise(kinds.select("sid", "occurs", "least.key", "least.first", "length", "syms", "nums", "gaps"), "kinds")
    names = materialise(_names(kinds), "names")
    ranks = suffix_ranks(names)
    discard(names)
    known = _adjacent_runs(kinds, ranks)
    discard(kinds, ranks)
    ddl = "key long, first int, length int, state binary"
    schema = _schema(ddl)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key, first, length = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "first", "length"))
            many = b.column("k_i").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            i, k, f, whole = (b.column(c).flatten().to_numpy() for c in ("k_i", "k_key", "k_first", "k_whole"))
            row = np.repeat(np.arange(len(key)), many)
            later = (k < key[row]) | ((k == key[row]) & (f < first[row] + i))
            end = np.cumsum(length)
            state = np.zeros(int(end[-1]), np.uint8)
            state[(end - length)[row] + i] = np.where(later, _REPEATED, np.where(whole == 1, _FIRST, _OPEN))
            raw = state.tobytes()
            out = [raw[e - m : e] for e, m in zip(end.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("first"), b.column("length"), pa.array(out, pa.binary())], schema=schema)

    each = join_back(strings.select("sid", "key", "first", "length"), known, "sid", "occurs", ["key", "first"], "left").mapInArrow(tidy(judge), ddl)
    info = materialise(each.groupBy("key").agg(F.collect_list(F.struct("first", "length", "state")).alias("info")), "info")
    discard(known)
    return info


_RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_SPANS = "key long, begins binary, sizes binary"
#: What a row of places is: a run of starts of strings known to be repeats, one of open strings, or one open string of a frequent phrase.
_GONE, _ASKED, _OFTEN = range(3)


def _finish(raw: bytes, begins: np.ndarray, sizes: np.ndarray, keep: bool) -> tuple:
    """n_bytes, n_removed, n_spans, kept_sha256, kept when the strings of these runs of starts (ascending, apart) go."""
    if not len(begins):
        return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw if keep else None
    ends = begins + sizes - 1 + LENGTH
    apart = begins[1:] > ends[:-1]
    begins, ends = begins[np.concatenate([[True], apart])], ends[np.append(apart, True)]
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(raw)], strict=True))
    return len(raw), len(raw) - len(kept), len(begins), hashlib.sha256(kept).hexdigest(), kept if keep else None


def _sift(at: np.ndarray, length: int, info: list[dict]) -> tuple[np.ndarray, ...]:
    """Of a text with these anchors: first places and lengths of the runs of starts known to be repeats, and first phrases, first
    places and lengths of the runs of starts still open.

    A string that starts after anchor p - 1 and not after anchor p begins with phrase p. It can only be a repeat if all the
    phrases it holds are repeated ones, so within a run of these its end must come before the run's next phrase is whole.
    """
    many = len(at) - 1
    rep, state = np.zeros(many + 2, bool), np.zeros(many + 1, np.uint8)
    for r in info:
        a = r["first"]
        rep[a : a + r["length"]] = True
        state[a : a + r["length"]] = np.frombuffer(r["state"], np.uint8)
    p = np.flatnonzero(rep)
    last = np.flatnonzero(~rep)
    last = last[np.searchsorted(last, p)] - 1  # the last phrase of its run
    beyond = np.append(at, [length + K, length + K])[last + 2]  # the anchor that ends the next phrase
    low = np.where(p > 0, at[p - 1] + 1, 0)
    high = np.minimum(np.minimum(at[p], beyond - (LENGTH - K) - 1), length - LENGTH)
    ok = low <= high
    p, low, high = p[ok], low[ok], high[ok]
    before = np.where(p > 0, state[p - 1], _OPEN)
    gone = before == _REPEATED
    at_anchor = (before == _OPEN) & (high == at[p]) & (state[p] != _OPEN)  # the suffix at the anchor itself is known
    single = at_anchor & (state[p] == _REPEATED)
    begins, sizes = np.concatenate([low[gone], at[p[single]]]), np.concatenate([(high - low + 1)[gone], np.ones(single.sum(), np.int64)])
    order = np.argsort(begins, kind="stable")
    left = before == _OPEN
    left &= high - low + 1 > at_anchor
    return begins[order], sizes[order], p[left], low[left], (high - low + 1 - at_anchor)[left]


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of runs with these first ones and lengths."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


_STARTS = "kind int, key long, at long, many long, g long, hashes binary"


def _places(docs: DataFrame, info: DataFrame, hot: np.ndarray) -> DataFrame:
    """Of the documents with repeated phrases the runs of starts known to be repeats, and the runs of open ones with the hashes
    of their strings.

    Equal strings begin with equal phrases at equal distances, so open runs meet by their first phrase (column ``g``); those of
    frequent phrases are rows of one start each, which meet by their string's hash.
    """

    none = np.empty(0, np.int64)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        many = [len(x[2]) for x in held]
        kind = np.repeat(np.array([x[0] for x in held], np.int32), many)
        key = np.repeat(np.array([x[1] for x in held], np.int64), many)
        at, n, g, data = (np.concatenate([x[k] for x in held]).astype(np.int64, copy=False) for k in range(2, 6))
        ends = np.append(0, np.cumsum(np.where(kind == _GONE, 0, n)) * 8).astype(np.int32)
        hashes = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        b = pa.RecordBatch.from_arrays([*map(pa.array, (kind, key, at, n)), pa.array(g, mask=kind == _GONE), hashes], names=["kind", "key", "at", "many", "g", "hashes"])
        yield from (b.slice(k, 1 << 16) for k in range(0, b.num_rows, 1 << 16))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in _grouped_texts(batches, ["key", "text", "info"]):
            doc, places, anchor = phrases_of([raw for _, raw, _ in group])
            cuts = np.searchsorted(doc, np.arange(len(group) + 1))
            for d, (key, raw, found) in enumerate(group):
                at, a_ = places[cuts[d] : cuts[d + 1]], anchor[cuts[d] : cuts[d + 1]]
                h = _mix(a_[:-1] * _M1 + a_[1:] * _M2 + np.diff(at).astype(np.uint64))
                begins, sizes, p, first, n = _sift(at, len(raw), found)
                if len(begins):
                    held.append((_GONE, key, begins, sizes, np.zeros(len(begins), np.int64), none))
                    size += len(begins)
                g = h[p].view(np.int64)
                often = np.isin(g, hot) if len(hot) else np.zeros(len(g), bool)
                for k in range(0, len(g), 1 << 16):  # bounded for a very long text
                    o, m, a = often[k : k + (1 << 16)], n[k : k + (1 << 16)], first[k : k + (1 << 16)]
                    strings = string_hashes(raw, _each(a, m)).view(np.int64)
                    if not o.any():
                        held.append((_ASKED, key, a, m, g[k : k + (1 << 16)], strings))
                        size += len(strings)
                        continue
                    single = np.repeat(o, m)
                    held.append((_ASKED, key, a[~o], m[~o], g[k : k + (1 << 16)][~o], strings[~single]))
                    held.append((_OFTEN, key, _each(a[o], m[o]), np.ones(m[o].sum(), np.int64), strings[single], strings[single]))
                    size += len(strings)
                    if size >= 1 << 18:
                        yield from flush(held)
                        held, size = [], 0
                if size >= 1 << 18:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("key", "text").join(info, "key").mapInArrow(tidy(sift), _STARTS)


def _later(places: DataFrame) -> DataFrame:
    """``key, at, many``: runs of open starts whose strings are not the first of their kind."""
    single, spark = places.where(F.col("kind") == _OFTEN), places.sparkSession
    few, many = SAMPLE_STARTS * shuffle_partitions(spark), single.count()
    hot, _ = frequent(single if many <= few else single.sample(few / many, seed=7), "g")
    is_hot = F.broadcast(spark.createDataFrame([(g,) for g in hot], "g long"))  # 4 a partition at most
    place = F.struct("key", "at")
    often = single.join(is_hot, "g")
    often = often.join(F.broadcast(often.groupBy("g").agg(F.min(place).alias("least"))), "g").where(place != F.col("least")).select("key", "at", "many")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := gathered(batches)) is None:
            return
        many = t.column("many").to_numpy()
        keys, idx = np.repeat(t.column("key").to_numpy(), many), _each(t.column("at").to_numpy(), many)
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.int64)
        order = np.argsort(h, kind="stable")
        _, n = _runs(h[order])
        again = order[np.repeat(n > 1, n)]
        order = again[np.lexsort((idx[again], keys[again], h[again]))]
        later = order[np.flatnonzero(h[order[1:]] == h[order[:-1]]) + 1]
        later = later[np.lexsort((idx[later], keys[later]))]
        keys, idx = keys[later], idx[later]
        s, n = _runs(idx - np.arange(len(idx)))
        new = np.zeros(len(idx), bool)
        new[s] = True
        new[1:] |= keys[1:] != keys[:-1]
        s = np.flatnonzero(new)
        b = pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(idx[s]), pa.array(np.diff(np.append(s, len(idx))))], names=["key", "at", "many"])
        yield from (b.slice(k, 1 << 16) for k in range(0, b.num_rows, 1 << 16))

    open_ = places.where(F.col("kind") != _GONE)
    n = partitions(spark, open_.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0])
    rest = open_.join(is_hot.withColumn("kind", F.lit(_OFTEN)), ["g", "kind"], "left_anti").repartition(n, "g")
    return often.unionByName(rest.select("key", "at", "many", "hashes").mapInArrow(tidy(compare), "key long, at long, many long"))


def _spans(gone: DataFrame) -> DataFrame:
    """A row per document that loses bytes: first places and lengths of the runs of starts of its repeats (``key, at, many``)."""
    schema = _schema(_SPANS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (t := gathered(batches)) is None:
            return
        keys, idx, num = (t.column(c).to_numpy() for c in ("key", "at", "many"))
        order = np.lexsort((idx, keys))
        keys, idx, num = keys[order], idx[order], num[order]
        # runs of one document that touch become one; known and open places never overlap
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (idx[1:] != idx[:-1] + num[:-1])
        first = np.flatnonzero(new)
        keys, idx, num = keys[first], idx[first], np.add.reduceat(num, first)
        s, many = _runs(keys)
        begins, sizes = idx.astype("<u4").tobytes(), num.astype("<u4").tobytes()
        out = [(int(keys[a]), begins[4 * a : 4 * (a + m)], sizes[4 * a : 4 * (a + m)]) for a, m in zip(s.tolist(), many.tolist(), strict=True)]
        for at in range(0, len(out), 4096):
            yield _batch(out[at : at + 4096], schema)

    return gone.repartition("key").mapInArrow(tidy(gather), _SPANS)


def _cut(docs: DataFrame, spans: DataFrame, keep: bool) -> DataFrame:
    """Final rows: the texts without the bytes that the spans' strings cover."""
    schema = _schema(_RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for key, text, begins, sizes in _small(batches, ["key", "text", "begins", "sizes"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            b, m = (np.frombuffer(x or b"", "<u4").astype(np.int64) for x in (begins, sizes))
            out.append((key, *_finish(raw, b, m, keep)))
            held += len(raw) if keep else 0
            if len(out) >= 512 or held >= _FLUSH:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    return docs.select("key", "text").join(spans, "key", "left").mapInArrow(tidy(finish), _RESULT)


def _keyed(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """``key, text`` with a unique key in the order of documents, and a map from keys to ids where they are not the ids."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if d.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return d.select(F.col("doc_id").alias("key"), "text"), None
    d = materialise(d.withColumn("h", F.xxhash64("text")), "texts")
    rows = d.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).withColumn("one", F.lit(1).cast("long"))
    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    keys = materialise(prefix_sums(rows, order, "one", "keys").select("doc_id", "h", "rows", F.col("before").alias("key")), "keys")
    k = keys.select(F.col("doc_id").alias("i"), F.col("h").alias("g"), "key")
    one = d.join(k, d["doc_id"].eqNullSafe(k["i"]) & (d["h"] == k["g"])).groupBy("key").agg(F.first("text").alias("text"))
    return one, keys


def remove_repeats(docs: DataFrame, *, keep_bytes: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``) for every row of ``docs``.

    A byte goes if a LENGTH-byte string that covers it also starts earlier: in a document of smaller
    id, or earlier in the same one. Null texts are empty. Rows that repeat an id stand in the order of
    their texts' hashes (null ids first of all); rows that repeat id and text are one document, with
    the same result for each row. An empty table gives no row; other columns are ignored.

    Nothing but totals per partition reaches the driver. Tasks hold a bounded batch of rows, or
    one document; a phrase or string however frequent is added up before it is sent, and its
    occurrences are dealt over as many tasks as they need.
    """
    out, ids = _removed(docs, keep_bytes, id_col, text)
    if ids is None:
        out = out.withColumnRenamed("key", "doc_id")
    else:
        rows = ids.select(F.col("doc_id").alias("id"), "key", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
        out = rows.join(out, "key").drop("key", "copy").withColumnRenamed("id", "doc_id")
    return out if keep_bytes else out.drop("kept")


def _removed(docs: DataFrame, keep_bytes: bool, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Results by ``key``, and the map from keys to ids and text hashes where keys are not the ids (see :func:`_keyed`)."""
    keyed, ids = _keyed(docs, id_col, text)
    repeated, hot = _repeated(keyed)
    strings = materialise(_strings(repeated), "strings")
    info = _verdicts(strings)
    discard(strings)
    places = materialise(_places(keyed, info, hot), "places")
    discard(info)
    known = places.where(F.col("kind") == _GONE).select("key", "at", "many")
    spans = materialise(_spans(known.unionByName(_later(places))), "spans")
    discard(places)
    return _cut(keyed, spans, keep_bytes), ids


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the kept bytes as text; n_chars follows where it is a column.

    Bytes of a character cut in two are dropped with it; documents of which nothing is left go, texts null or empty before stay.
    Null and repeated ids are as in :func:`remove_repeats`; each row gets the result of its own id and text.
    """
    cols = docs.columns
    out, ids = _removed(docs, True)
    kept = out.where("n_bytes = 0 or n_removed < n_bytes").select(F.col("key").alias("__id"), "kept")
    schema = _schema("__id long, __text string")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(i, k.decode("utf-8", "ignore")) for i, k in _columns(b, ["__id", "kept"])], schema)

    texts = kept.select("__id", "kept").mapInArrow(tidy(decode), "__id long, __text string")
    each = docs.withColumn("__null", F.col("text").isNull()).withColumn("__empty", F.col("text") == "").withColumn("__doc", F.col("doc_id").cast("long"))
    if ids is not None:
        k = ids.select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"), F.col("key").alias("__key"))
        each = each.join(k, F.col("__doc").eqNullSafe(F.col("__i")) & (F.xxhash64("text") == F.col("__h"))).withColumn("__doc", F.col("__key"))
    out = each.drop("text").join(texts, F.col("__doc") == F.col("__id"))
    out = out.withColumn("text", F.when(~F.col("__null"), F.col("__text"))).where("__null or __text != '' or __empty")
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
