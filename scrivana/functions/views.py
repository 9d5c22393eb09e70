"""Texts, labels and messages that the note, knowledge and session views show, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, defaults, messages and names as the views show them.
STATUS_MESSAGES = {
    401: "请先登录或确保您的token有效",
    403: "无权限访问该接口",
    404: "接口不存在，请检查URL",
    405: "请求方法不支持，请检查请求方式",
    429: "请求过于频繁，请稍后再试",
}
FIELD_ERRORS = {"missing": "为必填项", "int_parsing": "应为整数类型", "float_parsing": "应为数字类型"}
NO_FIELD = "请求参数"
MIME_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".webp": "image/webp",
}
OTHER_MIME = "application/octet-stream"
ALLOWED_EXTENSIONS = (".pdf", ".txt", ".md", ".pptx", ".docx")
ALLOWED_MIME_TYPES = (
    "application/pdf",
    "text/plain",
    "text/markdown",
    "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
)
CATEGORY_ICONS = {"work": "💼", "study": "📖", "life": "🏠", "project": "🚀"}
OTHER_ICON = "📄"
USER_STATUS = {0: "未激活", 1: "已激活", 2: "已锁定"}
GENDERS = {1: "男", 2: "女", 3: "其他"}
NO_TITLE, NO_FILE = "无标题", "知识库文档"
DEFAULT_CATEGORY = "life"
QUIZ_FALLBACK = ("请回顾这篇笔记的主要内容", ("不太确定", "需要复习", "基本掌握", "完全理解"), "基本掌握")
VISION_MARK = "\n\n[页面视觉描述]: "


def labelled(value: Column, labels: dict, default: Column) -> Column:
    """The label of a value; the default where there is none or an empty one."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.nullif(F.try_element_at(F.create_map(*pairs), value), F.lit("")), default)


def source_label(kind: Column, name: Column, content: Column) -> Column:
    """A passage under the name of its note or file."""
    note = F.concat(F.lit("[来源：笔记《"), F.coalesce(name, F.lit(NO_TITLE)), F.lit("》]\n"), content)
    return F.when(kind == "note", note).otherwise(F.concat(F.lit("[来源：知识库《"), F.coalesce(name, F.lit(NO_FILE)), F.lit("》]\n"), content))


def echo_trimmed(context: Column, completion: Column) -> Column:
    """A completion without its first 10 characters if the context ends with them."""
    return F.when((completion != "") & F.endswith(context, F.substring(completion, 1, 10)), F.substr(completion, F.lit(11))).otherwise(completion)


def filled(template: str, **values: Column) -> Column:
    """A prompt template with its ``{name}`` parts replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def with_vision(text: Column, vision: Column) -> Column:
    """A page's text with the description of what it shows, or whichever exists."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(text) & has(vision), F.concat(text, F.lit(VISION_MARK), vision)).otherwise(F.when(has(text), text).otherwise(F.coalesce(vision, F.lit(""))))


def image_url(md5: Column, name: Column) -> Column:
    return F.concat(F.lit("/knowledge/image/"), md5, F.lit("/"), name)


def cache_key(prefix: str, positional: list[Column], named: Column) -> Column:
    """Prefix, positional values and sorted ``key:value`` pairs of a map, joined by colons; nulls, and a key ``db``, are left out."""
    pairs = F.array_sort(F.filter(F.map_entries(named), lambda e: e["value"].isNotNull() & (e["key"] != "db")))
    return F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in positional], F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"])))


def megabytes(size: Column) -> Column:
    """One digit after the point; exact halves go to the even one, as C's printf has it (Java's goes up). Null if the size is."""
    return F.when(size.isNotNull(), F.format_string("%.1fMB", F.bround(size / (1024 * 1024), 1)))


def quiz_json(raw: Column) -> Column:
    """What stands in the first fenced block, or all, from the first brace on."""
    fenced = lambda mark: F.trim(F.split_part(F.split_part(raw, F.lit(mark), F.lit(2)), F.lit("```"), F.lit(1)))
    body = F.when(F.contains(raw, F.lit("```json")), fenced("```json")).when(F.contains(raw, F.lit("```")), fenced("```")).otherwise(raw)
    at = F.instr(body, "{")
    return F.when(at > 1, F.substr(body, at)).otherwise(body)


def quiz(raw: Column) -> Column:
    """A struct (question, choices, answer); the fixed fallback where the JSON is broken or lacks a part."""
    question, choices, answer = QUIZ_FALLBACK
    default = F.struct(F.lit(question).alias("question"), F.array(*map(F.lit, choices)).alias("choices"), F.lit(answer).alias("answer"))

    def chosen(got: Column) -> Column:
        whole = got["question"].isNotNull() & got["choices"].isNotNull() & got["answer"].isNotNull()
        return F.when(whole, got).otherwise(default)

    parsed = bound(raw, lambda r: F.from_json(quiz_json(r), "question string, choices array<string>, answer string", {"mode": "PERMISSIVE"}))
    return bound(parsed, chosen)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def tagging(json: Column) -> Column:
    """A struct (tags, category) with defaults for missing parts, null for broken JSON."""
    got = F.from_json(json, "tags array<string>, category string")
    ok = F.get_json_object(json, "$").isNotNull()
    return F.when(ok, F.struct(F.coalesce(got["tags"], F.array().cast("array<string>")).alias("tags"), F.coalesce(got["category"], F.lit(DEFAULT_CATEGORY)).alias("category")))


def page_texts(response: Column, pages: Column) -> Column:
    """A map from page number to text of a batch response.

    Pages are marked ``--- Page N ---``; one that is missing gets the text of the first that is there (none is added where
    all are); without any mark the lines are dealt evenly.
    """
    trimmed = F.regexp_replace(response, r"\A\s+|\s+\z", "")
    mark = r"(?s)--- Page (\d+) ---\s*(.*?)(?=--- Page \d+ ---|\z)"
    numbers = F.transform(F.regexp_extract_all(trimmed, F.lit(mark), F.lit(1)), lambda n: n.cast("int"))
    bodies = F.transform(F.regexp_extract_all(trimmed, F.lit(mark), F.lit(2)), lambda t: F.regexp_replace(t, r"\A\s+|\s+\z", ""))
    last = lambda n: F.try_element_at(bodies, (F.size(numbers) - F.array_position(F.reverse(numbers), n) + 1).cast("int"))
    found = F.map_from_arrays(F.array_distinct(numbers), F.transform(F.array_distinct(numbers), last))
    missing = F.array_except(pages, numbers)
    first = F.element_at(F.map_values(found), 1)
    whole = F.map_concat(found, F.map_from_arrays(missing, F.transform(missing, lambda _: first)))
    lines, n = F.split(trimmed, "\n"), F.size(pages)
    per = F.greatest(F.lit(1), F.floor(F.size(lines) / n).cast("int"))
    deal = F.transform(pages, lambda _, k: F.regexp_replace(F.array_join(F.slice(lines, k * per + 1, F.when(k == n - 1, F.greatest(F.size(lines) - k * per, F.lit(0))).otherwise(per)), "\n"), r"\A\s+|\s+\z", ""))
    return F.when(F.size(numbers) > 0, whole).when(n == 1, F.map_from_arrays(pages, F.array(trimmed))).otherwise(F.map_from_arrays(pages, deal))


def validation_message(errors: Column) -> Column:
    """One text of errors (array of loc array<string>, type, msg): where and what, joined by a full-width semicolon."""

    def one(e: Column) -> Column:
        path = F.filter(e["loc"], lambda x: ~x.isin("body", "query", "path"))
        field = F.when(F.size(path) > 0, F.array_join(path, ".")).otherwise(F.lit(NO_FIELD))
        return F.concat(F.lit("字段「"), field, F.lit("」"), labelled(e["type"], FIELD_ERRORS, e["msg"]))

    return F.array_join(F.transform(errors, one), "；")
