"""Notes, sessions, reviews and the upload registry as relational jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivana.functions.text import preview, review_interval

CATEGORIES = ("work", "study", "life", "project")


def category_stats(notes: DataFrame, domain: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Counts of a fixed domain (zero where empty), of null and of other categories, and of all, in one scan."""
    c = F.col("category")
    one = notes.agg(*[F.count_if(c == d).alias(d) for d in domain], F.count_if(c.isNull()).alias("uncategorized"), F.count_if(~c.isin(*domain)).alias("other"), F.count("*").alias("total"))
    return one.unpivot([], [*domain, "uncategorized", "other", "total"], "category", "n")


def page(notes: DataFrame, order: list[Column], number: int, size: int, *, category: str | None = None, tag: str | None = None, tag_mode: str = "pre") -> DataFrame:
    """A page of notes. tag_mode "pre" filters tags before paging, "post" only within the page."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1, size from 1 to 100")
    out = notes.where(F.col("category") == category) if category else notes
    has = F.coalesce(F.array_contains("tags", tag), F.lit(False)) if tag else None
    out = out.where(has) if tag and tag_mode == "pre" else out
    out = out.orderBy(*order).offset((number - 1) * size).limit(size)
    return out.where(has) if tag and tag_mode == "post" else out


def document_rollup(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, the first one's id and the first non-blank one's preview."""
    shown = F.when(F.trim("content") != "", preview(F.col("content"), 100))
    return chunks.groupBy("user_id", "doc").agg(F.count("*").alias("chunks"), F.min_by("chunk_id", "chunk_index").alias("first_id"), F.min_by(shown, F.when(shown.isNotNull(), F.col("chunk_index"))).alias("preview"))


def document_detail(chunks: DataFrame) -> DataFrame:
    """Per file: its chunks' text in order, joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n").alias("content"), F.count("*").alias("chunks"))


def paired_turns(messages: DataFrame) -> DataFrame:
    """Adjacent user and assistant messages; others are skipped."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return nxt.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def schedule(reviews: DataFrame) -> DataFrame:
    """Replays review events (user_id, note_id, at): growing count, interval and next date of each."""
    w = Window.partitionBy("user_id", "note_id").orderBy("at")
    out = reviews.withColumn("review_count", F.row_number().over(w)).withColumn("interval_days", review_interval(F.col("review_count")))
    return out.withColumn("next_at", F.expr("timestampadd(DAY, interval_days, at)"))


def due_history(reviews: DataFrame) -> DataFrame:
    """Every time a note fell due: reviews replayed as :func:`schedule` does, those after which no other came by the next date."""
    out = schedule(reviews).withColumn("__following", F.lead("at").over(Window.partitionBy("user_id", "note_id").orderBy("at")))
    return out.where(F.col("__following").isNull() | (F.col("__following") > F.col("next_at"))).drop("__following")


def due(records: DataFrame, notes: DataFrame, now: Column) -> DataFrame:
    """Records (note_id, next_at, others) due by now, with ``preview``, the start of their note (id, content)."""
    n = notes.select(F.col("id").alias("__id"), preview(F.col("content"), 200, "never").alias("preview"))
    return records.where(F.col("next_at") <= now).join(n, F.col("note_id") == F.col("__id")).drop("__id")


def first_uploads(files: DataFrame) -> DataFrame:
    """One row per tenant and content hash: the upload of the least id."""
    return files.withColumn("md5", F.md5("content")).groupBy("user_id", "md5").agg(F.min("id").alias("id"), F.count("*").alias("uploads"))


def new_uploads(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose hash the tenant's registry does not have."""
    return files.join(registry.select("user_id", "md5"), ["user_id", "md5"], "left_anti")


def without_file(registry: DataFrame, filename: str) -> DataFrame:
    """The registry after a delete by file name: every record of that name goes."""
    return registry.where(~F.coalesce(F.col("filename") == filename, F.lit(False)))


def merge_update(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A partial update: null means unchanged; rows of unknown keys are added."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in columns])


def copy_leaders(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, cluster, content``: every page with the content of its cluster's first page."""
    first = clusters.groupBy("doc", "cluster").agg(F.min("page").alias("lead"))
    lead = pages.select("doc", F.col("page").alias("lead"), "content")
    return clusters.join(first, ["doc", "cluster"]).join(lead, ["doc", "lead"]).select("doc", "page", "cluster", "content")
