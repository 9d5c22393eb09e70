"""SimHash near-duplicates: whole-text fingerprints and exact Hamming components.

Method: tiled exact comparison. Fingerprints are compared tile by tile with numpy exclusive-or
and bit counts; tile pairs whose population counts differ beyond the radius are skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import batched, discard, join_back, materialise, shuffle_partitions, table, tidy
from scrivana.llm.common import rows as in_rows
from scrivana.llm.components import connected_components

#: Words a shingle of the query has, and bits by which linked fingerprints differ at most.
SHINGLE_WORDS, RADIUS = 3, 2
#: Rows of a tile.
TILE = 2048
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _again(h: np.ndarray) -> np.ndarray:
    """Independent hashes from hashes (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE_WORDS, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles (repeats count), a bounded slice of a long text at a time; nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    digest = xxhash.xxh64_intdigest
    for at in range(0, max(1, len(words) - n + 1) if words else 0, 1 << 16):
        part = words[at : at + (1 << 16) + n - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(n)), strict=False)) if len(words) > n else [b" ".join(words)]
        yield np.fromiter((digest(s, seed) for s in joined), np.uint64)


def _simhash(slices: Iterable[np.ndarray], wide: int) -> tuple[int, ...]:
    ones, total = np.zeros((wide, 64), np.int64), 0
    for h in slices:
        total += len(h)
        for k in range(wide):
            ones[k] += _bits(h)
            h = _again(h) if k + 1 < wide else h
    return tuple(np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist())


def simhash(text: str | None, n: int = SHINGLE_WORDS, seed: int = 42, wide: int = 1) -> tuple[int, ...]:
    """``wide`` times 64 bits, each set if it is in over half the hashes of the n-word shingles (repeats count); 0 without words.

    The first 64 are of the shingles' XXH64, each further 64 of hashes of the hashes before.
    """
    return _simhash(shingles(text, n, seed), wide)


def fingerprints(docs: DataFrame, *, n: int = SHINGLE_WORDS, wide: int = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp0, fp1 ...``: the SimHash of every whole text as (signed) longs; null and wordless texts have 0."""

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for i, t in rows:
            yield i, *map(_signed, simhash(t, n, wide=wide))

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((f"fp{k}", pa.int64()) for k in range(wide))])
    return d.mapInArrow(batched(make, schema, ("doc_id", "text")), f"doc_id {kind.simpleString()}, " + ", ".join(f"fp{k} long" for k in range(wide)))


def _segments(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Masks of 64 bits: fingerprints within the radius agree on one of them at least (pigeonhole over the blocks)."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(part[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _root(up: np.ndarray, k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, total: int | None = None) -> list[tuple[int, int]]:
    """Links between the rows of two tiles that keep their connectivity: a spanning forest, as row numbers (those of b after a's).

    Column 0 of a tile is the word that must agree within the radius; ``total`` bounds the bits by
    which all words differ. Rows come sorted by the population count of column 0; runs of 256 whose
    counts cannot come within the radius are skipped.
    """
    if not len(a) or not len(b):
        return []
    shift = 0 if same else len(a)
    up, out = np.arange(shift + len(b)), []
    ones_a, ones_b = (np.bitwise_count(x[:, 0]).astype(np.int16) for x in (a, b))
    for i in range(0, len(a), 256):
        x, px = a[i : i + 256], ones_a[i : i + 256]
        for j in range(i if same else 0, len(b), 256):
            y, py = b[j : j + 256], ones_b[j : j + 256]
            if py[0] > px[-1] + radius or px[0] > py[-1] + radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]) <= radius)
            if total is not None and a.shape[1] > 1:
                near = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64) <= total
                p, q = p[near], q[near]
            for k, m in zip((p + i).tolist(), (q + j + shift).tolist(), strict=True):
                r, t = _root(up, k), _root(up, m)
                if r != t:
                    up[r] = t
                    out.append((k, m))
    return out


def hamming_links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, total: int | None = None, keys: str | None = None) -> DataFrame:
    """``src, dst`` links over distinct fingerprints (columns ``node``, ``fp0``, ``fp1`` ...).

    Two fingerprints are linked if one of their words differs in at most ``radius`` bits and, where
    given, all words together in at most ``total``; the links returned have the same components as
    all of these. Rows meet by the bits of a mask: over ``blocks`` blocks of a word any near pair agrees
    on blocks - radius of them, so buckets hold what agrees there and nothing is missed. A bucket is
    cut into tiles by population count and order; a task gets one tile or one pair of tiles, and pairs
    whose counts lie apart beyond the radius are never formed. Tiles are bounded however large a bucket is.
    With ``keys`` (a column of longs) rows meet where they have a key in common instead, and the first word is compared first.
    """
    blocks = blocks or radius + 2
    words = [c for c in fps.columns if c.startswith("fp")]
    if keys is None:
        heads = [k for k in range(len(words)) for _ in _segments(radius, blocks)]
        meet = F.array(*[F.struct(F.col(w).alias("word"), F.col(w).bitwiseAND(F.lit(_signed(m))).alias("key")) for w in words for m in _segments(radius, blocks)])
    else:
        heads = None
        meet = F.transform(keys, lambda k: F.struct(F.col(words[0]).alias("word"), k.alias("key")))
    at = F.posexplode(meet).alias("mask", "m")
    spread = fps.repartition(shuffle_partitions(fps.sparkSession))  # small rows, each of which becomes one for every mask
    each = spread.select("node", *words, at).select("node", *words, "mask", F.col("m.key").alias("key"), F.bit_count("m.word").alias("ones"))
    # tile numbers: by population count, then by as many hash chunks as keep a chunk near TILE rows
    sizes = each.groupBy("mask", "key", "ones").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    per = sizes.groupBy("mask", "key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("ones", "chunks"))).alias("chunks")).where("all > 1")
    per = materialise(per.select(F.xxhash64("mask", "key").alias("bucket"), "all", "chunks"), "buckets")
    rows = join_back(each.withColumn("bucket", F.xxhash64("mask", "key")), per, "bucket", "all", ["node"])
    small = rows.where(F.col("all") <= TILE).select("mask", "key", F.lit("").alias("tiles"), "node", *words, F.lit(0).alias("side"))
    large = rows.where(F.col("all") > TILE).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")[F.col("ones")]).cast("int"))
    # partners: tiles of counts ones - radius .. ones + radius; a pair is named by its two (count, chunk) numbers in order
    has = F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda o: F.try_element_at("chunks", o).isNotNull())
    other = F.explode(F.flatten(F.transform(has, lambda o: F.transform(F.sequence(F.lit(0), F.col("chunks")[o] - 1), lambda c: F.struct(o.alias("ones"), c.alias("chunk"))))))
    large = large.withColumn("me", F.struct("ones", "chunk")).withColumn("other", other)
    pair = F.concat_ws("|", *[F.concat_ws(".", p["ones"].cast("string"), p["chunk"].cast("string")) for p in (F.least("me", "other"), F.greatest("me", "other"))])
    large = large.select("mask", "key", pair.alias("tiles"), "node", *words, F.when(F.col("me") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("me") == F.col("other")).alias("same"))
    both = small.withColumn("same", F.lit(True)).unionByName(large)
    dealt = both.repartition(shuffle_partitions(fps.sparkSession), "mask", "key", "tiles").sortWithinPartitions("mask", "key", "tiles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches_of(batches), [None]):
            now = held if batch is None else pa.concat_tables([held, batch]) if held is not None else batch
            if now is None or not now.num_rows:
                continue
            mask, key = (now.column(c).to_numpy() for c in ("mask", "key"))
            tiles = np.array(now.column("tiles").to_pylist(), dtype=object)
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (tiles[1:] != tiles[:-1])) + 1
            end = len(key) if batch is None else int(cut[-1]) if len(cut) else 0
            held = now.slice(end)
            fp = np.stack([now.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            node, side, same = (now.column(c).to_numpy() for c in ("node", "side", "same"))
            starts = [0, *(c for c in cut.tolist() if c <= end)] if end else []
            starts = starts if not starts or starts[-1] == end else [*starts, end]
            src, dst = [], []
            for a, b in zip(starts, starts[1:], strict=False):
                first = heads[int(mask[a])] if heads else 0  # the word this mask is of stands first
                view = fp[a:b, [first, *(k for k in range(len(words)) if k != first)]]
                order = np.argsort(np.bitwise_count(view[:, 0]), kind="stable")
                if same[a]:
                    links, ids = tile_links(view[order], view[order], radius, True, total), node[a + order]
                else:
                    x, y = order[side[a + order] == 0], order[side[a + order] == 1]
                    links, ids = tile_links(view[x], view[y], radius, False, total), node[a + np.concatenate([x, y])]
                src += [ids[k] for k, _ in links]
                dst += [ids[k] for _, k in links]
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    out = materialise(dealt.mapInArrow(tidy(compare), "src long, dst long"), "links")
    discard(per)
    return out


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    return (pa.Table.from_batches([b]) for b in batches)


def near_duplicates(docs: DataFrame, *, n: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int | None = None, wide: int = 1, total: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    component_id is the least doc_id that a document reaches over links of :func:`hamming_links`,
    itself included. Documents are collapsed to distinct fingerprints first, so a group of copies
    costs one row. Null and wordless texts have fingerprint zero, linked like any other. Null ids
    keep their rows and never name a component unless all its ids are null; repeated rows are kept;
    an empty table gives no row; other columns are ignored.
    """
    words = [f"fp{k}" for k in range(wide)]
    f = materialise(fingerprints(docs, n=n, wide=wide).withColumn("node", F.col("fp0") if wide == 1 else F.xxhash64(*words)), "fingerprints")
    least = materialise(f.groupBy("node", *words).agg(F.min("doc_id").alias("least")), "distinct_fp")
    links = hamming_links(least.select("node", *words), radius, blocks, total)
    parts = connected_components(links)
    discard(links)
    labelled = least.select("node", "least").join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    # a part has one row per distinct fingerprint; its least id is a partial aggregate
    ids = labelled.groupBy("part").agg(F.min("least").alias("component_id"))
    by_node = labelled.join(ids, "part").select("node", "component_id")
    return f.join(by_node, "node").select("doc_id", F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in words]).alias("fingerprint"), "component_id")


#: Near copies of a pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.
STAGE = {"n": 5, "similarity": 0.8}
#: Their candidates: four words of 64 bits that differ in at most 60 (texts of similarity 0.8 in 39 on average, with
#: a deviation of 6; unrelated ones in 128), at most 26 of them in the first word.
WIDE, NEAR, NEAR_WORD = 4, 60, 26
#: Tiles are made of texts with a key in common: so many keys, each of the shingles of so many least products. A pair of
#: similarity J has any given key in common with probability J ** 4, so one of 0.8 is missed by all with 0.002.
KEYS, KEY_SHINGLES = 12, 4
_ODD = np.random.default_rng(6).integers(1, 1 << 63, KEYS * KEY_SHINGLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts and shingles of a tile in which similarities are taken.
TILE_TEXTS, TILE_SHINGLES = 1024, 1 << 19


def _keys(members: np.ndarray) -> list[int]:
    """The keys by which a set of shingles (hashes) meets others."""
    if not len(members):
        return []
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(members), 4096):
        least = np.minimum(least, (members[at : at + 4096, None] * _ODD).min(axis=0))
    h = np.arange(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, KEY_SHINGLES).T:
        h = _again(h ^ part)
    return h.view(np.int64).tolist()


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (distinct members, none empty) of at least this Jaccard similarity, as their numbers."""
    if len(sets) < 2:
        return []
    size = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark, out = np.zeros(len(values), bool), []
    left, rest = np.arange(1, len(sets)), flat[begin[1] :]  # sets not reached yet and their members
    reached = [0]
    while len(left):
        if not reached:
            reached, left, rest = [int(left[0])], left[1:], rest[size[left[0]] :]
            continue
        k = reached.pop()
        own = flat[begin[k] : begin[k + 1]]
        mark[own] = True
        n = size[left]
        both = np.add.reduceat(mark[rest], np.concatenate([[0], np.cumsum(n)[:-1]]), dtype=np.int64)
        mark[own] = False
        near = both >= similarity * (len(own) + n - both) - 1e-9
        if near.any():
            found = left[near].tolist()
            out += [(k, m) for m in found]
            reached += found
            left, rest = left[~near], rest[np.repeat(~near, n)]
    return out


def _tiles(sets: DataFrame, similarity: float) -> DataFrame:
    """``src, dst``: in each tile (columns ``part``, ``tile``) every text but the first of its component, with that one."""
    dealt = sets.select("part", "tile", "node", "shingles").repartition("part", "tile").sortWithinPartitions("part", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []

        def flush() -> pa.RecordBatch:
            up = np.arange(len(ids))
            for k, m in similar_links(held, similarity):
                up[_root(up, m)] = _root(up, k)
            found = [(ids[k], ids[r]) for k in range(len(ids)) if ids[k] != ids[r := _root(up, k)]]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for part, tile, node, raw in in_rows(batches, "part", "tile", "node", "shingles"):
            if (part, tile) != at:
                if len(ids) > 1:
                    yield flush()
                at, ids, held = (part, tile), [], []
            ids.append(node)
            held.append(np.frombuffer(raw, np.uint64))
        if len(ids) > 1:
            yield flush()

    return dealt.mapInArrow(tidy(compare), "src long, dst long")


def _chunked(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``chunks`` of the part and ``me``, the chunk of the text."""
    out = join_back(sets, sizes, "part", "many", ["node"])
    return out.withColumn("me", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))


def _sizes(sets: DataFrame) -> DataFrame:
    """Texts of each part, and the chunks of bounded texts and shingles that they need."""
    chunks = F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("members") / TILE_SHINGLES)).cast("int")
    return sets.groupBy("part").agg(F.count("*").alias("many"), chunks.alias("chunks"))


def _pairs(chunked: DataFrame) -> DataFrame:
    """A row for each tile of two chunks (or the only one) that a text is in."""
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: (o != F.col("me")) | (F.col("chunks") == 1))
    out = chunked.withColumn("other", F.explode(others))
    return out.withColumn("tile", F.least("me", "other").cast("long") * F.col("chunks") + F.greatest("me", "other"))


def confirmed_components(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``node, component`` over links between texts of one part (columns ``node``, ``part``, ``text``) that are similar enough.

    Nodes without a link may be absent. Every pair of a part counts, in tiles of bounded texts and shingles. A part of many
    chunks is not compared pair by pair of chunks at once: first each chunk by itself, then only the first texts of the
    components found there among each other, then what is still apart from its part's largest component with all of
    the part. So a large group of near copies costs in proportion to its texts.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, node, text in rows:
            h = list(shingles(text, n))
            if h:
                h = np.unique(np.concatenate(h))
                yield part, node, len(h), h.tobytes()

    kind, schema = "part long, node long, members long, shingles binary", pa.schema([("part", pa.int64()), ("node", pa.int64()), ("members", pa.int64()), ("shingles", pa.binary())])
    sets = materialise(texts.select("part", "node", "text").mapInArrow(batched(make, schema, ("part", "node", "text"), 256), kind), "shingle_sets")
    sizes = materialise(_sizes(sets), "part_sizes")
    alone = materialise(_tiles(_chunked(sets, sizes).withColumn("tile", F.col("me").cast("long")), similarity).toDF("node", "component"), "alone")
    wide = sizes.where("chunks > 1")
    if wide.isEmpty():
        discard(sets, sizes)
        return alone
    several = sets.join(wide.select("part"), "part", "left_semi")
    heads = several.join(alone.select("node"), "node", "left_anti")
    few = materialise(_sizes(heads), "head_sizes")
    between = materialise(_tiles(_pairs(_chunked(heads, few)), similarity), "between")
    found = connected_components(alone.toDF("src", "dst").union(between))
    whole = several.select("part", "node", "members").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = whole.groupBy("part", "component").agg(F.count("*").alias("n"), F.sum("members").alias("m"))
    left = each.groupBy("part").agg(F.max_by("component", "n").alias("largest"), F.count("*").alias("components"), F.sum("n").alias("many"), F.sum("m").alias("all"), (F.sum("n") - F.max("n")).alias("apart"), F.max("m").alias("most"))
    chunks = lambda n_, m: F.greatest(F.ceil(F.col(n_) / TILE_TEXTS), F.ceil(F.col(m) / TILE_SHINGLES)).cast("int")
    left = materialise(left.where("components > 1").withColumn("chunks", chunks("many", "all")).withColumn("rows", chunks("apart", "all")), "apart")
    if left.isEmpty():
        discard(sets, sizes, alone, few, between, left)
        return found
    rows = join_back(sets.join(left.select("part"), "part", "left_semi"), left, "part", "many", ["node"]).join(found, "node", "left")
    a, b = (F.pmod(F.xxhash64("node"), F.col(c)) for c in ("rows", "chunks"))
    every = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: k.cast("long") * F.col("chunks") + b)
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: a * F.col("chunks") + k)
    minor = F.coalesce("component", "node") != F.col("largest")
    tiled = rows.withColumn("tile", F.explode(F.when(minor, F.array_union(every, own)).otherwise(every)))
    rest = materialise(_tiles(tiled, similarity), "rest_links")
    out = connected_components(found.toDF("src", "dst").union(rest))
    discard(sets, sizes, alone, few, between, left, rest, found)
    return out


def row_key(docs: DataFrame) -> Column:
    """A number of the whole row: its columns' hash (rows equal in all columns share it)."""
    return F.xxhash64(*[F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("value")) for c in docs.columns])


def near_copies(docs: DataFrame, *, n: int = STAGE["n"], similarity: float = STAGE["similarity"]) -> DataFrame:
    """``row`` (from :func:`row_key`) of every row of ``docs`` that stays, one for each component over links of this similarity.

    It is the row of the least id, null ids last; of rows of that id the one of the least text hash, then of the least key.

    Texts of the same shingles are collapsed first. SimHash proposes: fingerprints of texts with a key in common are compared tile
    by tile, and near ones linked, which gives loose parts. Shingles decide: within a part the
    similarity of every pair counts, so no link is one of fingerprints only. Texts without words (null ones
    too) are one component.
    """
    words = [f"fp{k}" for k in range(WIDE)]

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row, t in rows:
            h = list(shingles(t, n))
            members = np.unique(np.concatenate(h)) if h else np.empty(0, np.uint64)
            yield row, _signed(xxhash.xxh64_intdigest(members.tobytes())), len(members), *map(_signed, _simhash(h, WIDE)), _keys(members)

    names = ["row", "node", "members", *words]
    keyed = docs.select("doc_id", "text", row_key(docs).alias("row"))
    schema = pa.schema([*((c, pa.int64()) for c in names), ("keys", pa.list_(pa.int64()))])
    made = keyed.select("row", "text").mapInArrow(batched(make, schema, ("row", "text")), ", ".join(f"{c} long" for c in names) + ", keys array<long>")
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("hash"), "row").alias("rank")
    f = materialise(made.dropDuplicates(["row"]).join(keyed.select("row", rank).distinct(), "row"), "fingerprints")
    # equal sets may differ in how often they hold a shingle, and so in bits: the least fingerprint stands for all
    nodes = f.groupBy("node").agg(F.min("rank").alias("least"), F.min(F.struct(*words)).alias("fp"), F.max("members").alias("members"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.select("node", "least", "members", "fp.*", "keys"), "nodes")
    loose = hamming_links(nodes.where("members > 0").select("node", "keys", *words), NEAR_WORD, total=NEAR, keys="keys")
    parts = connected_components(loose)
    discard(loose)
    one = nodes.join(parts, "node").select(F.col("least.row").alias("row"), "node", F.col("component").alias("part"))
    texts = keyed.select("row", "text").join(one, "row").dropDuplicates(["row"])
    sure = confirmed_components(texts, n, similarity)
    labelled = nodes.select("node", "least").join(sure, "node", "left").select("least", F.coalesce("component", "node").alias("whole"))
    kept = materialise(labelled.groupBy("whole").agg(F.min("least").alias("least")).select("least.row"), "kept_rows")
    discard(f, nodes, parts, sure)
    return kept


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all its columns) that stay: of each component the one that :func:`near_copies` names.

    Rows are told apart by all their columns, not by id: different texts under one id or under null ids are judged like any others
    and all stay if they are no near copies. Rows equal in all columns are one. Exact up to collisions of 64-bit hashes.
    """
    kept = near_copies(docs, **(STAGE | options)).withColumnRenamed("row", "__row")
    return docs.withColumn("__row", row_key(docs)).join(kept, "__row").dropDuplicates(["__row"]).select(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
