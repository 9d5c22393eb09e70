"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII ones; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. A session on one machine without one gets a folder of its own; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scrivana-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark deletes a query's shuffle files when the query ends.
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    This cuts the lineage: a lost executor costs only a re-read, and what follows sees
    the very rows that were written (sampled range bounds and partition ids are not redrawn).
    The shuffles that made the table go with the end of its query.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/scrivana/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FILE_CLEANUP) if before is None else spark.conf.set(_FILE_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._scrivana_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables from :func:`materialise` that nothing reads any more."""
    for df in frames:
        spark, path = df.sparkSession, df._scrivana_path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as Python tuples, a bounded slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def tidy(make: Callable) -> Callable:
    """The same ``mapInArrow`` function, which at its end gives the memory it has freed back to the system.

    Worker processes outlive their tasks, and the allocator would keep what the largest of them took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        yield from make(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run


def batched(make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, names: tuple[str, ...], size: int = 2048):
    """A ``mapInArrow`` function from a generator of row tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row in make(rows(batches, *names)):
            held.append(row)
            if len(held) >= size:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return tidy(run)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the quarter of documents whose crc32 of the id as text is 2 modulo 4 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Rows that a task sorts in memory.
TASK_ROWS = 1 << 20


def partitions(spark: SparkSession, rows_: int) -> int:
    """How many partitions so many rows are dealt to: the session's shuffle partitions, fewer for few rows, and more where one
    would get over TASK_ROWS, so that what a task holds does not grow with the input."""
    return max(1, min(shuffle_partitions(spark), int(rows_) >> 15), -(-int(rows_) // TASK_ROWS))


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of a partition (see :func:`partitions` for how many), None if there are none."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def join_back(rows_: DataFrame, totals: DataFrame, key: str, size: str, tie: list[str], how: str = "inner") -> DataFrame:
    """``rows_`` with the columns of ``totals`` (one row a key, of ``size`` rows), no key's rows meeting in one task.

    A key of over a quarter of a partition's even share is dealt by a hash of ``tie`` to as many places as it has such
    quarters, and its total is copied there. There are under 4 such keys a partition, so their list is small enough to
    broadcast, and the copies are under 8 a partition.
    """
    most = max(64, (totals.agg(F.sum(size)).first()[0] or 0) // (4 * shuffle_partitions(rows_.sparkSession)))
    places = F.ceil(F.col(size) / most).cast("int")
    heavy = totals.where(F.col(size) > most).select(key, places.alias("__places"))
    r = rows_.join(F.broadcast(heavy), key, "left")
    r = r.withColumn("__place", F.coalesce(F.pmod(F.xxhash64(*tie), F.col("__places")).cast("int"), F.lit(0))).drop("__places")
    t = totals.withColumn("__place", F.explode(F.sequence(F.lit(0), F.greatest(places, F.lit(1)) - 1)))
    return r.join(t, [key, "__place"], how).drop("__place")


def frequent(rows_: DataFrame, key: str) -> tuple[list, int]:
    """Values of ``key`` that a sample of rows holds often enough to fill a quarter of a partition, 4 a partition at most, and the rows.

    Only for balance, as the bounds of range partitions are sampled: what is missed or found too much changes no result.
    """
    least, seen = 4 * shuffle_partitions(rows_.sparkSession), Observation()
    sums = rows_.groupBy(key).agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("all"))
    most = [tuple(r) for r in sums.where("n >= 8").orderBy(F.desc("n")).limit(least).collect()]
    total = seen.get["all"] or 0
    return [k for k, n in most if n * least >= total], total


def picked(spark: SparkSession, rows_: int, key: str) -> Column:
    """Whether a row's key is in the sample by which :func:`numbered` sets the bounds of so many rows: about 64 rows a partition, a million at most."""
    want = max(1 << 12, min(64 * partitions(spark, rows_), 1_000_000))
    return F.pmod(F.xxhash64(key), F.lit(max(1, rows_ // want))) == 0


def _bounds(sample: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """Columns of the rows that cut a sample into so many even parts, ascending."""
    at = np.lexsort(sample[::-1])
    at = at[np.arange(1, parts) * len(at) // parts] if len(at) else at
    return [c[at] for c in sample]


def _places(keys: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """How many bounds are not above each row, by all columns in order (longs from 0 on)."""
    low, high = (np.searchsorted(bounds[0], keys[0], side) for side in ("left", "right"))
    more = np.flatnonzero(low < high)  # rows equal to a bound in the first column: compared as bytes that sort alike
    if len(more):
        one, all_ = (np.ascontiguousarray(np.stack(c, axis=1).astype(">i8")).view(f"S{8 * len(c)}").ravel() for c in ([k[more] for k in keys], bounds))
        low[more] = np.searchsorted(all_, one, "right")
    return low.astype(np.int32)


def sorted_parts(source: DataFrame, sample: DataFrame, make: Callable, ddl: str, rows_: int, order: list[str]) -> DataFrame:
    """The rows (``ddl``, about ``rows_`` of them) that ``make`` (as for ``mapInArrow``) gives for ``source``, packed and dealt to ranges of
    ``order`` (long and int columns, none below 0). What ``make`` gives for ``sample``, some rows of ``source``, sets the bounds."""
    from scrivana.llm.packed import kinds, pack, packed_ddl

    parts, types = partitions(source.sparkSession, rows_), kinds(ddl)
    seen = sample.mapInArrow(tidy(make), ddl).select(*order).toArrow() if parts > 1 else None
    bounds = _bounds([seen.column(c).to_numpy().astype(np.int64) for c in order], parts) if parts > 1 else []

    def place(c: dict[str, np.ndarray]) -> np.ndarray:
        n = len(c[order[0]])
        return _places([c[k].astype(np.int64, copy=False) for k in order], bounds) if bounds and len(bounds[0]) else np.zeros(n, np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(({c: b.column(c).to_numpy() for c in types} for b in make(batches) if b.num_rows), ddl, place)

    return source.mapInArrow(tidy(deal), packed_ddl(ddl)).repartitionById(parts, "to")


def numbered(source: DataFrame, sample: DataFrame, make: Callable, ddl: str, rows_: int, order: list[str], runs: list[list[str]], weigh: Callable[[dict], np.ndarray], weights: int, name: str, keep: list[str], alone: bool = False, to: int | None = None) -> DataFrame:
    """Sort the rows (``ddl``, about ``rows_`` of them) that ``make`` (as for ``mapInArrow``) gives for ``source``, and give each the
    sums ``before0``, ``before1`` ... of the weights of all rows that sort before its run; ``within0`` ... for the next kind of run.

    ``order`` (long and int columns, none below 0) must be total; a run is a maximal stretch of rows equal in some columns
    (longs), whatever partitions it spans, and ``runs`` lists the columns of each kind. ``weigh`` gives the rows' weights. With
    ``alone`` a row also tells whether it surely is a run of the first kind by itself (a partition's first and last rows never do).

    What ``make`` gives for ``sample``, some rows of ``source``, sets the bounds of the partitions; they balance tasks and change no
    result. ``make``'s rows are dealt to them straight away, packed, by all of ``order``, so rows that are alike in its first columns are
    cut anywhere; a task sorts its own and adds up, and only a row for each partition (its totals, first and last runs) reaches
    the driver. Returns the columns ``keep`` with the sums; with ``to`` packed and dealt to so many partitions by ``sid``, to be
    read by the function in ``_scrivana_read``.
    """
    from scrivana.llm.packed import kinds, pack, unpack

    many, types = len(runs), kinds(ddl)
    dealt = sorted_parts(source, sample, make, ddl, rows_, order)
    sums = [f"{'before' if not j else 'within'}{k}" for j in range(many) for k in range(weights)]
    heads = [f"__head{j}" for j in range(many)]
    flat = ", ".join([*(f"{c} {types[c]}" for c in keep), *(f"{c} long" for c in sums), *(f"{c} boolean" for c in (*heads, *(["alone"] * alone)))])
    kind = {c: {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[k] for c, k in kinds(flat).items()}
    # a row holds values (packed, or its own), or is the partition's note
    first = "__to int, " + ", ".join(f"{c} binary" for c in kind) if to else flat
    out = f"{first}, __pid int, __note array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = [b for b in batches if b.num_rows]
        if not head:
            return
        pid = head[0].column("to")[0].as_py()
        t = unpack(iter(head), ddl)
        del head
        at = np.lexsort([t[c] for c in order[::-1]])
        t = {c: v[at] for c, v in t.items()}
        w = weigh(t).astype(np.int64).reshape(-1, weights)
        until, note, mine, begun, single = np.cumsum(w, axis=0) - w, w.sum(axis=0).tolist(), [], [], None
        for same in runs:
            keys = [t[k] for k in same]
            new = np.ones(len(w), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            if alone and single is None:
                single = new & np.append(new[1:], False)
                single[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            before = until[start]
            mine += list(before.T)
            begun.append(start == 0)
            note += [*before[-1].tolist(), *(int(k[0]) for k in keys), *(int(k[-1]) for k in keys)]
        full = dict(zip(kind, [*(t[c] for c in keep), *mine, *begun, *([single] * alone)], strict=True))
        names = ["__to"] * bool(to) + [*kind, "__pid", "__note"]
        if to:
            shown = [pa.int32(), *[pa.binary()] * len(kind)]
            made = pack(iter([full]), flat, lambda c: _hashed(c["sid"], to), "__to")
        else:
            shown = list(kind.values())
            made = (pa.RecordBatch.from_arrays([pa.array(v[k : k + (1 << 16)], kind[c]) for c, v in full.items()], names=list(kind)) for k in range(0, len(w), 1 << 16))
        for b in made:
            rest = [pa.array(np.full(b.num_rows, pid, np.int32)), pa.nulls(b.num_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *rest], names=names)
        note += [int(x[-1]) for x in begun]  # a head is true if all its rows are one run
        blank = [pa.nulls(1, k) for k in shown]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([pid], pa.int32()), pa.array([note], pa.list_(pa.int64()))], names=names)

    done = materialise(dealt.mapInArrow(tidy(run), out), name)
    base, open_at, tail, shift = np.zeros(weights, np.int64), [None] * many, [None] * many, []
    for r in done.where(F.col("__note").isNotNull()).select("__pid", "__note").orderBy("__pid").collect():
        n = r["__note"]
        total, at, row = np.array(n[:weights]), weights, [r["__pid"], *base.tolist()]
        for j, same in enumerate(runs):
            start, at = np.array(n[at : at + weights]), at + weights
            one, last, at = n[at : at + len(same)], n[at + len(same) : at + 2 * len(same)], at + 2 * len(same)
            begun = open_at[j] if one == tail[j] else base  # where the run that its first rows belong to began
            row += begun.tolist()
            open_at[j], tail[j] = begun if n[len(n) - many + j] else base + start, last
        shift.append(tuple(row))
        base = base + total
    back = done.where(F.col("__note").isNull())
    if to:
        shifts = {r[0]: np.array(r[1:], np.int64) for r in shift}  # a few numbers a partition

        def read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
            held = []
            for b in batches:
                for k in range(0, b.num_rows):
                    one = b.slice(k, 1)
                    c, s = unpack(iter([one]), flat), shifts[one.column("__pid")[0].as_py()]
                    cols = {x: c[x] for x in keep}
                    for j in range(many):
                        for i in range(weights):
                            cols[sums[j * weights + i]] = np.where(c[heads[j]] > 0, s[weights * (1 + j) + i], s[i] + c[sums[j * weights + i]])
                    held.append(cols | ({"alone": c["alone"] > 0} if alone else {}))
            return pa.table({x: np.concatenate([h[x] for h in held]) for x in held[0]}) if held else None

        back = back.drop("__note").repartitionById(to, "__to")
        back._scrivana_read = read
    else:
        names = ["base", *(f"begun{j}_" for j in range(many))]
        shifts = source.sparkSession.createDataFrame(shift, "__pid int, " + ", ".join(f"__{s}{k} long" for s in names for k in range(weights)))
        back = back.join(F.broadcast(shifts), "__pid")
        whole = [F.when(F.col(heads[j]), F.col(f"__begun{j}_{k}")).otherwise(F.col(f"__base{k}") + F.col(sums[j * weights + k])).alias(sums[j * weights + k]) for j in range(many) for k in range(weights)]
        back = back.select(*keep, *whole, *(["alone"] * alone))
    back._scrivana_path = done._scrivana_path
    return back


def _hashed(values: np.ndarray, n: int) -> np.ndarray:
    """A partition for each value, the same for equal ones."""
    return ((values.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n


def prefix_sums(df: DataFrame, order: list[Column], size: str, name: str) -> DataFrame:
    """Add ``before``: the sum of ``size`` over all rows that sort before a row (ties in any fixed order).

    One range shuffle sorts the rows; each sorted partition adds up on its own, and only one
    total per partition (never per row or key) is gathered to shift the partial sums.
    """
    keyed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    fields = [f.name for f in keyed.schema]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = np.asarray(b.column(fields.index(size)).to_numpy(zero_copy_only=False), dtype=np.int64)
            c = np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c - v + total)], names=[*fields, "__run"])
            total += int(c[-1]) if len(c) else 0

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*keyed.schema.fields]).add("__run", LongType())
    done = materialise(keyed.mapInArrow(tidy(running), schema), name)
    totals = sorted(tuple(r) for r in done.groupBy("__pid").agg(F.max(F.col("__run") + F.col(size))).collect())
    starts, total = [], 0
    for pid, t in totals:
        starts.append((pid, total))
        total += t
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, "__pid int, __start long")
    out = done.join(F.broadcast(offsets), "__pid").withColumn("before", F.col("__run") + F.col("__start")).drop("__pid", "__run", "__start")
    out._scrivana_path = done._scrivana_path
    return out
