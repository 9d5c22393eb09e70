"""The trie of conversation prefixes, and what its subtrees hold.

Nodes come from hashes of prefixes, made by one scan of all turns in order. Subtree totals come from a centroid decomposition of
the forest of parent edges: components are split recursively at a node whose removal leaves pieces of at most half the size,
the totals of the pieces below it are added to it and along the path from it to its component's top, so a chain of a million turns is
as balanced as a bush. The first levels of the recursion are one Spark step: nodes at which the weight of a subtree passes another multiple of
PIECE are taken out together, which leaves components of less than PIECE nodes for the tasks, and the nodes taken out, with
the totals of the components between them, are a smaller forest that is decomposed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from scrivana.llm.common import discard, join_back, materialise, table, tidy

#: Conversations in a group that shares the first turns of its first, and the modulus of the hash that says how many.
GROUP, TURNS = 5, 9
#: Least weight of a component that a task decomposes. Above, it is the root of the whole weight, and so are the nodes between the components but for a small factor.
PIECE = 1 << 8
#: Nodes whose list is broadcast; above, they are joined by hash with hot nodes split.
BROADCAST_NODES = 200_000
#: Odd multipliers of the two prefix hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bytes of a piece of a list of ids.
CHUNK = 1 << 13


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def scan(df: DataFrame, key: str, order: list[Column], keep: list[str], name: str, chains: list[str] = (), fills: list[str] = ()) -> DataFrame:
    """Sort rows by ``key`` (a long, not null) and ``order``, and give each its place ``at`` (from 1) among its key's rows.

    ``chains`` (two longs) get ``<c>_chain``, the hash of a key's values so far, and ``<c>_before``, that without the row's own; ``fills`` get their last value so far that is
    not null. The rows of a key may span partitions: each is scanned on its own, a row for each partition tells the driver how it ends, and the rows of a
    key that began in an earlier one are mended on reading. Returns the columns ``keep`` with these. Wants a total order.
    """
    dealt = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    dealt = dealt.select(key, *[c for c in dict.fromkeys([*keep, *chains, *fills]) if c != key], F.spark_partition_id().alias("__pid"))
    longs = ["at", *(f"{c}_chain" for c in chains)]
    fields = StructType([f for f in dealt.schema.fields if f.name not in fills])
    for c in (*longs, *fills):
        fields = fields.add(c, LongType())
    plain = [f.name for f in dealt.schema.fields if f.name not in fills]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, hashes, filled = None, 0, [0] * len(chains), [None] * len(fills)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            new = np.append(True, k[1:] != k[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where each row's key begins in the batch
            at = np.arange(n) - first + 1
            goes_on = (first == 0) & (last is not None and k[0] == last)
            out = [pa.array(at + np.where(goes_on, count, 0), pa.int64())]
            for j, c in enumerate(chains):
                base = BASES[j]
                v = b.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
                sums = np.cumsum(v * _powers(pow(base, -1, 1 << 64), n), dtype=np.uint64)
                h = (sums - np.where(first > 0, sums[first - 1], np.uint64(0))) * _powers(base, n)
                more = np.where(goes_on, np.uint64(hashes[j]), np.uint64(0))
                h = h + more * _powers(base, n + 1)[1:]
                out.append(pa.array(h.view(np.int64), pa.int64()))
                hashes[j] = int(h[-1])
            for j, c in enumerate(fills):
                got = b.column(c)
                there = np.asarray(got.is_valid())
                upto = np.maximum.accumulate(np.where(there, np.arange(n), -1))
                found = np.asarray(got.fill_null(0))[np.maximum(upto, 0)]
                inside = upto >= first
                carried = goes_on & ~inside & (filled[j] is not None)
                out.append(pa.array(np.where(carried, filled[j] or 0, found), pa.int64(), mask=~(inside | carried)))
                filled[j] = out[-1][-1].as_py()
            last, count = k[-1], int(out[0][-1].as_py())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), *out], names=fields.names)

    done = materialise(dealt.mapInArrow(tidy(run), fields), name)
    end = F.max_by(F.struct(key, *longs, *fills), F.struct(key, "at")).alias("end")
    state, carries = None, {}
    for r in done.groupBy("__pid").agg(F.min(key).alias("first"), end).orderBy("__pid").collect():  # a row for each partition
        e = r["end"]
        mine = [e["at"], [e[f"{c}_chain"] % (1 << 64) for c in chains], [e[c] for c in fills]]
        if state is not None and r["first"] == state[0]:
            carries[r["__pid"]] = state
            if e[key] == r["first"]:  # the whole partition is of one key
                hashes = [(h + before * pow(BASES[j], e["at"], 1 << 64)) % (1 << 64) for j, (h, before) in enumerate(zip(mine[1], state[2], strict=True))]
                mine = [e["at"] + state[1], hashes, [x if x is not None else y for x, y in zip(mine[2], state[3], strict=True)]]
        state = (e[key], *mine)

    out_fields = StructType([f for f in fields if f.name in keep or f.name in longs or f.name in fills])
    for c in chains:
        out_fields = out_fields.add(f"{c}_before", LongType())

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c) for c in b.schema.names}
            pids, keys = (np.asarray(cols[c]) for c in ("__pid", key))
            local = np.asarray(cols["at"])
            for pid in np.unique(pids).tolist():
                if pid not in carries:
                    continue
                first, count, hashes, filled = carries[pid]
                open_ = (pids == pid) & (keys == first)
                cols["at"] = pa.array(np.asarray(cols["at"]) + np.where(open_, count, 0), pa.int64())
                for j, c in enumerate(chains):
                    more = np.uint64(hashes[j]) * np.power(np.full(len(local), BASES[j], np.uint64), local.astype(np.uint64))
                    h = np.asarray(cols[f"{c}_chain"]).view(np.uint64) + np.where(open_, more, np.uint64(0))
                    cols[f"{c}_chain"] = pa.array(h.view(np.int64), pa.int64())
                for j, c in enumerate(fills):
                    if filled[j] is not None:
                        gap = open_ & ~np.asarray(cols[c].is_valid())
                        x = np.where(gap, filled[j], np.asarray(cols[c].fill_null(0)))
                        cols[c] = pa.array(x, pa.int64(), mask=~(gap | np.asarray(cols[c].is_valid())))
            for j, c in enumerate(chains):
                h, v = (np.asarray(cols[x]).view(np.uint64) for x in (f"{c}_chain", c))
                cols[f"{c}_before"] = pa.array(((h - v) * np.uint64(pow(BASES[j], -1, 1 << 64))).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in out_fields], names=out_fields.names)

    back = done.mapInArrow(mend, out_fields)
    back._scrivana_path = done._scrivana_path
    return back


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (``conv_id``), and their rebuilt turns: ``conv_id, depth, h0, h1, p0, p1, bytes``, with hashes of the prefix and of that before it."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    t = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[c.alias(n) for c, n in zip(text, ("role", "text"), strict=True)])
    t = t.select("*", *[F.xxhash64(F.lit(j), "role", "text").alias(f"t{j}") for j in range(2)], F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    own = scan(t, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")], ["conv_id", "t0", "t1", "bytes"], "turns")
    shared = (F.crc32(F.col("conv_id").cast("string")) % TURNS).cast("int")
    convs = materialise(own.groupBy("conv_id").agg(F.max("at").alias("n")).select("conv_id"), "convs")
    want = convs.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("base"), shared.alias("h"))
    head = own.where((F.col("at") < TURNS) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).withColumnRenamed("conv_id", "base")  # under TURNS rows a base
    head = want.join(head, "base").where(F.col("at") <= F.col("h")).select("conv_id", F.lit(0).alias("part"), "at", "t0", "t1", "bytes")
    rest = own.where(F.col("at") > shared).select("conv_id", F.lit(1).alias("part"), "at", "t0", "t1", "bytes")
    both = head.unionByName(rest).withColumnRenamed("at", "was")
    out = scan(both, "conv_id", [F.col("part"), F.col("was")], ["conv_id", "bytes"], "rebuilt", chains=["t0", "t1"])
    names = {"at": "depth"} | {f"t{j}_{a}": f"{b}{j}" for j in range(2) for a, b in (("chain", "h"), ("before", "p"))}
    out_ = out.withColumnsRenamed(names)
    out_._scrivana_path = out._scrivana_path
    discard(own)
    return convs, out_


def decompose(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Subtree totals of a forest by centroid decomposition. ``parent[k]`` is below k, or -1 for a top; ``values`` are columns, one number a node."""
    out = [list(v) for v in values]
    n = len(parent)
    size, piece = [0] * n, [0] * n
    roots: dict[int, list[int]] = {}
    for v in range(n):
        piece[v] = v if parent[v] < 0 else piece[parent[v]]
        roots.setdefault(piece[v], []).append(v)
    todo = [c for c in roots.values() if len(c) > 1]
    while todo:
        part = todo.pop()  # a connected component, tops first
        top = part[0]
        for v in part:
            size[v] = 1
        for v in reversed(part[1:]):
            size[parent[v]] += size[v]
        z = next(v for v in reversed(part) if 2 * size[v] >= len(part))  # the lowest node with half of the component below it
        below: dict[int, list[int]] = {}
        above, under = [], {z}
        for v in part:
            if v == z:
                continue
            if v != top and parent[v] in under:
                under.add(v)
                piece[v] = v if parent[v] == z else piece[parent[v]]
                below.setdefault(piece[v], []).append(v)
            else:
                above.append(v)
        for col, into in zip(values, out, strict=True):
            total = sum(col[v] for v in under)
            into[z] += total - col[z]
            u = z
            while u != top:
                u = parent[u]
                into[u] += total
        todo += [c for c in (above, *below.values()) if len(c) > 1]
    return out


def _rolled(rows_: DataFrame, values: list[str], piece: list[str]) -> DataFrame:
    """``id`` and subtree totals of ``values`` for rows (``id``, ``parent``, ``depth``, columns ``piece`` that name a component), each component in one task."""
    cols = ["id", "parent", *values]
    d = rows_.select(*cols, "depth", *piece).repartition(*piece).sortWithinPartitions(*piece, "depth", "id").select(*cols, *piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            ids = t.column("id").to_pylist()
            place = {i: k for k, i in enumerate(ids)}
            got = decompose([place.get(p, -1) for p in t.column("parent").to_pylist()], [t.column(c).to_pylist() for c in values])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, *got)], names=["id", *values])

        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 1 << 13:
                continue
            keys = [held.column(c).to_numpy() for c in piece]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(cuts):  # all but the last component are whole
                yield solve(held.slice(0, int(cuts[-1]) + 1).combine_chunks())
                held = held.slice(int(cuts[-1]) + 1)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return d.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("id", *values)))


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], piece: int = PIECE, most: int = BROADCAST_NODES) -> DataFrame:
    """``id`` and the totals of ``values`` over each node's subtree.

    ``nodes``: ``id, parent`` (ids; null for a top), ``conv_id`` (one whose path it is on), ``depth``, ``h0, h1`` (unique), ``p0, p1`` (the parent's), ``q`` and ``below``
    (its subtree's weight over ``piece`` and its children's largest), ``size`` (its rows in ``paths``) and the values. ``paths``: ``conv_id, depth, h0, h1, p0, p1`` of all nodes of each conversation.
    """
    cut = (F.col("q") > F.col("below")) | F.col("parent").isNull()
    taken = materialise(nodes.where(cut).select("id", "parent", "conv_id", "depth", "h0", "h1", "p0", "p1", "size", *values), "taken")
    # where a path leaves a node that is taken out, a component begins: its first node names it on the rest of the path
    up = taken.select(F.struct(F.col("h0"), F.col("h1")).alias("up"), "size", F.col("id").alias("over"))
    steps = paths.select("conv_id", "depth", "h0", "h1", F.struct(F.col("p0"), F.col("p1")).alias("up"))
    if taken.count() <= most:
        begins = steps.join(F.broadcast(up), "up")
    else:
        begins = join_back(steps, up, "up", "size", ["conv_id"])
    begins = begins.select("conv_id", "depth", F.lit(0).alias("kind"), F.col("h0").alias("c0"), F.col("h1").alias("c1"), "over", *[F.lit(None).cast("long").alias(c) for c in ("id", "parent", *values)])
    mine = nodes.where(F.col("parent").isNotNull()).select("conv_id", "depth", F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("c0", "c1", "over")], "id", "parent", *values)
    named = scan(begins.unionByName(mine), "conv_id", [F.col("depth"), F.col("kind")], ["conv_id", "depth", "kind", "id", "parent", *values], "named", fills=["c0", "c1", "over"])
    named = named.where("kind = 1").drop("kind", "at")
    out_of = taken.select("id")
    small = named.join(F.broadcast(out_of) if out_of.count() <= most else out_of, "id", "left_anti")
    # the forest of the nodes taken out: each hangs below the next one above it, and holds its components' own totals
    totals = small.groupBy(F.col("over").alias("id")).agg(*[F.sum(c).alias(f"__{c}") for c in values])
    links = named.join(taken.select("id"), "id", "left_semi").select("id", F.col("over").alias("next"))
    forest = taken.join(totals, "id", "left").join(links, "id", "left")
    forest = forest.select("id", F.col("next").alias("parent"), "depth", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values], F.lit(0).alias("all"))
    big = materialise(_rolled(forest, values, ["all"]), "taken_totals")
    # their totals hang on their parents inside the components
    hung = big.join(taken.select("id", "parent"), "id").where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(*[F.sum(c).alias(f"__{c}") for c in values])
    loaded = small.join(hung, "id", "left").select("id", "parent", "depth", "c0", "c1", *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values])
    out = _rolled(loaded, values, ["c0", "c1"]).unionByName(big)
    return out


def ends(last: DataFrame) -> DataFrame:
    """``h0, h1, ends_sha256``: the digest of the ids that end at a node, ascending and joined by commas.

    Ids are sorted over all partitions and written into pieces of CHUNK bytes where they are; the task that digests a node's list streams over its pieces.
    """
    dealt = last.repartitionByRange("h0", "h1", "conv_id").sortWithinPartitions("h0", "h1", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, first, out = None, [], 0, 0, []

        def flush() -> None:
            if ids:
                out.append((*key, first, ",".join(ids)))

        def sent() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["h0", "h1", "first", "ids"])
            out.clear()
            return b

        for b in batches:
            for h0, h1, c in zip(*(b.column(x).to_pylist() for x in ("h0", "h1", "conv_id")), strict=True):
                if (h0, h1) != key or size > CHUNK:
                    flush()
                    key, ids, size, first = (h0, h1), [], 0, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if len(out) > 1 << 10:
                yield sent()
        flush()
        if out:
            yield sent()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for h0, h1, ids in zip(*(b.column(x).to_pylist() for x in ("h0", "h1", "ids")), strict=True):
                if (h0, h1) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (h0, h1), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["h0", "h1", "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["h0", "h1", "ends_sha256"])

    short = dealt.mapInArrow(pieces, "h0 long, h1 long, first long, ids string")
    return short.repartition("h0", "h1").sortWithinPartitions("h0", "h1", "first").drop("first").mapInArrow(digest, "h0 long, h1 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, piece: int | None = None, most: int = BROADCAST_NODES) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie of rebuilt conversations.

    ``turns``: ``conv_id, turn, role, text``; other columns are not looked at. A conversation is ordered by turn, null first; rows of one turn by role and text,
    and repeated rows are turns of their own. A null role or text is empty. Rows of a null conv_id belong to no conversation. An empty table has no node, not even a root.
    Prefixes are told apart by 128 bits of hash.
    """
    convs, paths = rebuilt(turns)
    lens = paths.groupBy("conv_id").agg(F.max("depth").alias("len"), F.max_by(F.struct("h0", "h1"), "depth").alias("end"))
    lens = materialise(lens, "lens")
    steps = join_back(paths, lens.select("conv_id", "len"), "conv_id", "len", ["depth"])
    nodes = steps.groupBy("h0", "h1").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(F.col("len") - F.col("depth") + 1).alias("weight"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    # a prefix without a turn hashes to zeros; the root weighs as much as all paths, and one more for each conversation
    steps_ = lens.agg(F.sum(F.expr("len * (len + 1) div 2"))).first()[0] or 0
    root = root.select(zero.alias("h0"), zero.alias("h1"), "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("p0"), F.lit(None).cast("long").alias("p1"), "n_convs", zero.alias("bytes"), (F.lit(steps_) + F.col("n_convs")).alias("weight"))
    nodes = materialise(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    whole = nodes.agg(F.max("weight")).first()[0] or 0
    piece = piece or max(PIECE, int(whole**0.5))
    q = F.floor(F.col("weight") / piece).cast("long")
    kids = nodes.where(F.col("p0").isNotNull()).groupBy(F.col("p0").alias("h0"), F.col("p1").alias("h1")).agg(F.count("*").alias("n_children"), F.max(q).alias("below"))
    nodes = materialise(nodes.join(kids, ["h0", "h1"], "left").withColumns({"n_children": F.coalesce("n_children", zero), "below": F.coalesce("below", zero), "q": q}), "nodes_below")
    parents = nodes.where("n_children > 0").select(F.struct("h0", "h1").alias("up"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n"))
    below_root = nodes.where(F.col("p0").isNotNull()).withColumn("up", F.struct(F.col("p0").alias("h0"), F.col("p1").alias("h1")))
    linked = join_back(below_root, parents, "up", "__n", ["id"]).drop("up", "__n")
    top = nodes.where(F.col("p0").isNull()).withColumns({"parent": F.lit(None).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    linked = linked.unionByName(top).withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"), "size": F.col("n_convs")})
    linked = materialise(linked, "linked")
    totals = subtree_totals(linked, paths, ["n_leaves", "saved_tokens"], piece, most)
    last = convs.join(lens, "conv_id", "left").select("conv_id", F.coalesce("end.h0", zero).alias("h0"), F.coalesce("end.h1", zero).alias("h1"))
    out = linked.drop("n_leaves", "saved_tokens").join(totals, "id").join(ends(last), ["h0", "h1"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
