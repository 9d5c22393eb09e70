"""The upload registry and the stores of notes, chunks and vectors: what a write leaves behind, as relational jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivana.functions.text import basename
from scrivana.functions.views import ALLOWED_EXTENSIONS, ALLOWED_MIME_TYPES

MAX_FILE, MAX_BATCH = 20 * 1024 * 1024, 200 * 1024 * 1024
RECORD = "md5 string, filename string, original_filename string, upload_time string"


def registry_records(lines: DataFrame) -> DataFrame:
    """Records of registry lines (column ``line``): JSON objects, or legacy and broken lines, which are a hash alone. Blank lines are none."""
    line = F.trim("line")
    got = F.from_json(line, RECORD)
    parsed = F.when(line.startswith("{") & F.get_json_object(line, "$").isNotNull(), got).otherwise(F.from_json(F.to_json(F.struct(line.alias("md5"))), RECORD))
    return lines.where(line != "").withColumn("r", parsed).select(*[c for c in lines.columns if c != "line"], "r.*")


def append_records(records: DataFrame, path: str) -> None:
    """Records (user_id and those of RECORD) as JSON lines, a folder for each tenant."""
    records.write.mode("append").partitionBy("user_id").json(path)


def rewrite_records(records: DataFrame, path: str, emptied: list[str] = ()) -> None:
    """Replace the folders of the tenants that ``records`` has, leaving all others; those of ``emptied`` tenants go."""
    spark = records.sparkSession
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user_id").json(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for user in emptied:
        gone = hadoop(f"{path}/user_id={user}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks (user_id, md5, original_filename, chunk_index, content, ...) to the tenant's folder of a Parquet store."""
    chunks.write.mode("append").partitionBy("user_id").parquet(path)


def delete_file(registry: DataFrame, vectors: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry (user_id, md5, filename, ord) and vectors (user_id, md5, ...) after deletes by file name (user_id, filename).

    All records of the name go, but only the vectors of the last one of them.
    """
    hit = registry.join(requests.distinct(), ["user_id", "filename"], "left_semi")
    last = hit.groupBy("user_id", "filename").agg(F.max_by("md5", "ord").alias("md5"))
    return registry.join(requests, ["user_id", "filename"], "left_anti"), vectors.join(last, ["user_id", "md5"], "left_anti")


def delete_hashes(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry without the asked hashes (user_id, md5), and for each request how many records went and whether any did."""
    left = registry.join(requests, ["user_id", "md5"], "left_anti")
    counts = registry.join(requests, ["user_id", "md5"], "left_semi").groupBy("user_id", "md5").agg(F.count("*").alias("removed"))
    told = requests.join(counts, ["user_id", "md5"], "left").withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
    return left, told.withColumn("found", F.col("removed") > 0)


def without_tenants(df: DataFrame, tenants: DataFrame) -> DataFrame:
    return df.join(tenants, "user_id", "left_anti")


def uploads(files: DataFrame, registry: DataFrame, dedup: bool = True) -> DataFrame:
    """Files (user_id, id, content) to store: with dedup the first of each content that the tenant's registry does not know, else all."""
    if not dedup:
        return files
    new = files.withColumn("md5", F.md5("content")).join(registry.select("user_id", "md5").distinct(), ["user_id", "md5"], "left_anti")
    first = new.groupBy("user_id", "md5").agg(F.min("id").alias("id"))
    return files.join(first.select("user_id", "id"), ["user_id", "id"], "left_semi")


def store_registry(records: DataFrame, table: str, path: str, buckets: int = 32) -> None:
    """Records (user_id, md5, ...) as a table bucketed and sorted by tenant and hash, so that probes need not shuffle it."""
    records.repartition(buckets, "user_id", "md5").write.mode("overwrite").option("path", path).bucketBy(buckets, "user_id", "md5").sortBy("user_id", "md5").saveAsTable(table)


def probe(files: DataFrame, table: str, known: bool = False) -> DataFrame:
    """Files (user_id, md5, ...) that a bucketed registry does not have, or those that it has. Only the files are shuffled, into the registry's buckets."""
    registry = files.sparkSession.table(table).select("user_id", "md5")
    return files.join(registry.hint("merge"), ["user_id", "md5"], "left_semi" if known else "left_anti")


def by_basename(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (user_id, request_id, path) with the records of the tenant whose file name is the path's last part; without one there is no row."""
    asked = requests.select("user_id", "request_id", basename(F.col("path")).alias("filename"))
    return asked.join(registry, ["user_id", "filename"])


def rejection(size: Column, mime: Column, extension: Column) -> Column:
    """Why a file is refused: ``size``, or ``type`` if neither its type nor its extension is known; null if it is not."""
    unknown = ~F.coalesce(mime.isin(*ALLOWED_MIME_TYPES), F.lit(False)) & ~F.coalesce(extension.isin(*ALLOWED_EXTENSIONS), F.lit(False))
    return F.when(size > MAX_FILE, F.lit("size")).when(unknown, F.lit("type"))


def insert_notes(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Note rows, and the rows for the vector store; a note without content has no vector, but is kept."""
    return new, new.where(F.coalesce(F.col("content"), F.lit("")) != "").select("id", "user_id", "content", F.lit("note").alias("doc_type"))


def write_notes(new: DataFrame, store: str, batch: int) -> None:
    """Both stores of :func:`insert_notes` under one batch number: notes last, since a note without its vector is what a reader must not see. A
    repeat of the batch replaces what it wrote."""
    notes, vectors = insert_notes(new)
    for name, rows in (("vectors", vectors), ("notes", notes)):
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/{name}")


def update_notes(notes: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Notes after partial updates (null: unchanged; unknown ids: none), with ``revector``, true where content was given."""
    c = changes.select("id", *[F.col(x).alias(f"__{x}") for x in columns])
    out = notes.join(c, "id", "left")
    revector = F.col("__content").isNotNull() if "content" in columns else F.lit(False)
    return out.select(*[F.coalesce(f"__{x}", x).alias(x) if x in columns else x for x in notes.columns], revector.alias("revector"))


def delete_notes(notes: DataFrame, reviews: DataFrame, vectors: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, reviews and vectors after deletes (user_id, id): only a tenant's own notes go, and with them what hangs on them."""
    gone = notes.join(requests, ["user_id", "id"], "left_semi").select("id")
    return tuple(df.join(gone, "id", "left_anti") for df in (notes, reviews, vectors))


def first_reviews(tagged: DataFrame, now: Column) -> DataFrame:
    """The review that a note gets when it is tagged: interval 1, count 0, due a day later."""
    return tagged.select("id", "user_id", F.lit(1).alias("interval_days"), F.lit(0).alias("review_count"), F.timestamp_add("DAY", F.lit(1), now).alias("next_at"))


def progress_events(files: DataFrame) -> DataFrame:
    """``user_id, seq, event, id`` of a batch upload in order: start; each file sliced or in error; each sliced one written, then completed; finish.

    files has user_id, id and ok. seq is a sortable text, so no tenant's files meet in one task.
    """
    number = lambda step, last=F.lit(0): F.concat_ws(".", F.lit(step), F.lpad(F.col("id").cast("string"), 20, "0"), last.cast("string"))
    sliced = files.select("user_id", number("1").alias("seq"), F.when(F.col("ok"), "slicing_completed").otherwise("error").alias("event"), "id")
    both = F.explode(F.array(*[F.struct(number("2", F.lit(k)).alias("seq"), F.lit(e).alias("event")) for k, e in enumerate(("writing", "completed"))])).alias("x")
    written = files.where("ok").select("user_id", both, "id").select("user_id", "x.seq", "x.event", "id")
    ends = files.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(e).alias("event")) for s, e in (("0", "start"), ("3", "finish"))])).alias("x"))
    return sliced.unionByName(written).unionByName(ends.select("user_id", "x.seq", "x.event", F.lit(None).cast("long").alias("id")))
