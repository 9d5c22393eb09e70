"""Upload folders as tables: Python data sources whose partitions are planned from the folders' listing.

A folder holds one folder for each tenant (``user_id=<tenant>`` or the plain name), and that the tenant's files. The options ``tenants`` and ``kinds``
(JSON lists) choose among them: no other folder is listed, no other file opened. They are options, not filters that Spark pushes down, because
Spark 4.1 goes on with the filters of one query in later ones on the same DataFrame that have none. Paths are whatever pyarrow's file systems open.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that a task reads, unless the option ``bytes`` says otherwise, and of a batch that it sends.
TASK_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
#: Encodings that are tried in order; a text that fits none is empty.
ENCODINGS = ("utf-8", "gbk")
#: The folder of a null tenant, and characters of a tenant that a folder's name has as hexadecimal numbers: as Spark's partitions have them.
NO_TENANT, UNSAFE = "__HIVE_DEFAULT_PARTITION__", re.compile(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]")


def decoded(raw: bytes) -> str:
    for code in ENCODINGS:
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            pass
    return ""


@dataclass
class Files(InputPartition):
    """Files of one task: tenant, kind and path of each."""

    files: list[tuple[str, str, str]]


class _Reader(DataSourceReader):
    kinds: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.root, self.bytes = options["path"], int(options.get("bytes", TASK_BYTES))
        self.tenants, self.only = (set(json.loads(options[o])) if o in options else None for o in ("tenants", "kinds"))

    def listed(self) -> Iterator[tuple[str, str, str, int]]:
        """Tenant, kind, path and size of the files to read, in order; empty files, hidden ones and other kinds are none."""
        fs, root = FileSystem.from_uri(self.root) if "://" in self.root else (FileSystem.from_uri(f"file://{self.root}"))
        for folder in sorted(fs.get_file_info(FileSelector(root)), key=lambda f: f.path):
            name = folder.base_name.removeprefix("user_id=")
            if folder.type != FileType.Directory or name[:1] in "._" or (self.tenants is not None and name not in self.tenants):
                continue
            for f in sorted(fs.get_file_info(FileSelector(folder.path)), key=lambda f: f.path):
                kind = f.base_name.rpartition(".")[2].lower() if "." in f.base_name else ""
                if f.type == FileType.File and f.size and f.base_name[:1] not in "._" and (not self.kinds or kind in self.kinds) and (self.only is None or kind in self.only):
                    yield name, kind, f.path, f.size

    def partitions(self) -> list[Files]:
        out, held = [], 0
        for name, kind, path, size in self.listed():
            if not out or held + size > self.bytes:
                out.append(Files([]))
                held = 0
            out[-1].files.append((name, kind, path))
            held += size
        return out or [Files([])]

    def opened(self, partition: Files) -> Iterator[tuple[str, str, str, bytes]]:
        fs = FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")[0]
        for name, kind, path in partition.files:
            with fs.open_input_stream(path) as f:
                yield name, kind, path, f.read()


class _Documents(_Reader):
    kinds = ("txt", "md")

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["user_id", "kind", "path", "content"]
        for name, kind, path, raw in self.opened(partition):
            held.append((name, kind, path, decoded(raw)))
            size += len(raw)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)


class DocumentSource(DataSource):
    """``user_id, kind, path, content`` of the text and Markdown files of an upload folder: UTF-8, else GBK, else empty."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return "user_id string, kind string, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Documents(self.options)


class _Records(_Reader):
    def read(self, partition: Files) -> Iterator[tuple]:
        for name, _, path, raw in self.opened(partition):
            for line in decoded(raw).splitlines():
                line = line.strip()
                if not line:
                    continue
                try:
                    r = json.loads(line)
                    r = r if isinstance(r, dict) else {"md5": line}
                except ValueError:
                    r = {"md5": line}
                text = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in r.items()}
                yield name, path, text.get("md5"), text.get("filename"), text.get("original_filename"), text.get("upload_time")


class RegistrySource(DataSource):
    """Records of registry files, a line each: JSON objects, or legacy and broken lines, which are a hash alone."""

    @classmethod
    def name(cls) -> str:
        return "upload_registry"

    def schema(self) -> str:
        return "user_id string, path string, md5 string, filename string, original_filename string, upload_time string"

    def reader(self, schema) -> DataSourceReader:
        return _Records(self.options)


def uploads(spark: SparkSession, path: str, source: str = "uploads", tenants: list[str] | None = None, kinds: list[str] | None = None, **options) -> DataFrame:
    """The rows of an upload folder by one of the sources above (``uploads`` or ``upload_registry``), for some tenants and kinds or all."""
    for s in (DocumentSource, RegistrySource):
        spark.dataSource.register(s)
    chosen = {k: json.dumps(v) for k, v in (("tenants", tenants), ("kinds", kinds)) if v is not None}
    return spark.read.format(source).options(**chosen, **options).load(path)


def store_texts(texts: DataFrame, path: str) -> int:
    """Texts (user_id, content) as an upload folder, a file each that ends in a line break; the number of files.

    Tasks write the files themselves, where they are read: Spark's own writer starts a process for each file of a local folder and lets the driver move
    them. Equal texts are one task's and a file's name is its text's hash and number, so a task that runs again writes the same files.
    """
    root = path if "://" in path else f"file://{path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        folders, seen, n = set(), Counter(), 0
        for b in batches:
            for user, text in zip(*(b.column(c).to_pylist() for c in ("user_id", "content")), strict=True):
                raw = ((text or "") + "\n").encode()
                folder = f"{base}/user_id={NO_TENANT if user is None else UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', user)}"
                if folder not in folders:
                    fs.create_dir(folder)
                    folders.add(folder)
                name = folder, hashlib.md5(raw).hexdigest()
                seen[name] += 1
                with fs.open_output_stream(f"{folder}/{name[1]}-{seen[name]}.txt") as f:
                    f.write(raw)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # one more file for each equal text, so null and empty ones must meet as well
    dealt = texts.select("user_id", F.coalesce("content", F.lit("")).alias("content")).repartition("user_id", "content")
    return dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
