"""Text functions of the note and knowledge views, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is hidden from error messages, in this order.
SENSITIVE = (
    r"sk-[a-zA-Z0-9]{32,}",
    r"api[-_]?key['\"]\s*[:=]\s*['\"][^'\"]{16,}['\"]",
    r"password['\"]\s*[:=]\s*['\"][^'\"]{4,}['\"]",
    r"passwd['\"]\s*[:=]\s*['\"][^'\"]{4,}['\"]",
    r"mysql://[^@]+@",
    r"postgresql://[^@]+@",
)

#: Days until the next review after 0, 1, 2 ... reviews, the last for all beyond.
REVIEW_DAYS = (1, 2, 4, 7, 15, 30)


def preview(text: Column, n: int, dots: str = "longer") -> Column:
    """First n characters; dots "longer" adds ``...`` if some are left out, "always" always, "never" never."""
    head = F.substring(text, 1, n)
    if dots == "never":
        return head
    return F.concat(head, F.lit("...")) if dots == "always" else F.when(F.length(text) > n, F.concat(head, F.lit("..."))).otherwise(text)


def session_title(text: Column, n: int = 30) -> Column:
    """First n characters, trimmed, with dots if the message is longer."""
    return F.when(F.length(text) > n, F.concat(F.trim(F.substring(text, 1, n)), F.lit("..."))).otherwise(F.trim(text))


def markdown_strip(text: Column, n: int = 100) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[#*`~>\[\]()!|-]", ""), r"[ \t\n\r]+", " "))
    return preview(plain, n)


def mask(text: Column) -> Column:
    for pattern in SENSITIVE:
        text = F.regexp_replace(text, pattern, "***")
    return text


def extract_json(text: Column) -> Column:
    """What a fenced block holds (be it empty), else from the first brace to the last, else the text."""
    fence = r"(?s)```(?:json)?\s*\n(.*?)\n\s*```"
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), text.substr(first, last - first + 1))
    inside = F.regexp_replace(F.regexp_extract(text, fence, 1), r"\A\s+|\s+\z", "")
    return F.when(text.rlike(fence), inside).otherwise(F.coalesce(braces, text))


def markdown_export(title: Column, tags: Column, category: Column, created: Column, updated: Column, content: Column) -> Column:
    """A note as Markdown under its front matter; tags and category have a line only where there are any."""
    shown = F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    named = F.when(category != "", F.concat(F.lit("category: "), category))
    dates = [F.concat(F.lit(f"{k}_at: "), F.date_format(v, "yyyy-MM-dd HH:mm:ss")) for k, v in (("created", created), ("updated", updated))]
    lines = [F.lit("---"), F.concat(F.lit("title: "), title), shown, named, *dates, F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), content]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def windows(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Chunks of ``size`` characters, each ``overlap`` into the one before; an empty text has none."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def relative_date(now: Column, then: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(s < 60, F.lit("刚刚")).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" 分钟前"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" 小时前"))).otherwise(F.concat(F.month(then).cast("string"), F.lit("月"), F.day(then).cast("string"), F.lit("日")))


def review_interval(count: Column) -> Column:
    """Days until the next review after ``count`` reviews (fixed steps, the last for all beyond)."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, REVIEW_DAYS)), (count + 1).cast("int")), F.lit(REVIEW_DAYS[-1]))


def dynamic_weights(query: Column) -> Column:
    """A struct (vector, bm25) of retrieval weights from a query's length and word density."""
    q = F.coalesce(query, F.lit(""))
    n = F.length(q)
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    v = F.when(n == 0, 0.5).when(n < 20, 0.3).when(n > 50, 0.7).otherwise(0.5)
    b = F.lit(1.0) - v
    dense = (n > 0) & (words / n > 0.1)
    v2, b2 = F.when(dense, F.greatest(v - 0.1, F.lit(0.3))).otherwise(v), F.when(dense, F.least(b + 0.1, F.lit(0.7))).otherwise(b)
    return F.struct(F.round(v2, 1).alias("vector"), F.round(b2, 1).alias("bm25"))
