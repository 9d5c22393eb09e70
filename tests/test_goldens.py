"""Fixed rules on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from scrivana.functions import text as T
from scrivana.functions import vector as V
from scrivana.operators import hamming as H
from scrivana.operators import notes as N
from scrivana.operators import retrieval as R
from scrivana.operators import registry as G
from scrivana.sources.files import list_files, read_documents, read_images, read_texts, split_text
from scrivana.streaming.stateful import debounce, debounce_stream, rate_limit, rate_limit_stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("query", "weights"),
    [("", (0.5, 0.5)), (None, (0.5, 0.5)), ("   ", (0.3, 0.7)), ("spark", (0.3, 0.7)), ("what is a hash join", (0.3, 0.7)), ("how do I tune shuffle partitions", (0.4, 0.6)), ("小户型适合什么扫地机器人", (0.3, 0.7)), ("a" * 20, (0.5, 0.5)), ("a" * 50, (0.5, 0.5)), ("a" * 51, (0.7, 0.3)), ("explain the difference between broadcast and sort merge joins", (0.6, 0.4))],
)
def test_weights(spark, query, weights):
    assert tuple(one(spark, query, T.dynamic_weights)) == weights


def test_review_interval(spark):
    got = spark.range(8).orderBy("id").select(T.review_interval(F.col("id")).alias("d")).collect()
    assert [r.d for r in got] == [1, 2, 4, 7, 15, 30, 30, 30]


def test_titles(spark):
    assert one(spark, "hi", T.session_title) == "hi"
    assert one(spark, "a" * 30, T.session_title) == "a" * 30
    assert one(spark, "a" * 31, T.session_title) == "a" * 30 + "..."
    assert one(spark, "x" * 29 + " yyy", T.session_title) == "x" * 29 + "..."


@pytest.mark.parametrize(("text", "want"), [('x {"a":{"b":1}} y', '{"a":{"b":1}}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('```\n{"a":1}\n```\n{"z":2}', '{"a":1}'), ('```json {"a":1}```', '{"a":1}'), ("none", "none"), ("} {", "} {")])
def test_json(spark, text, want):
    assert one(spark, text, T.extract_json) == want


def test_masking(spark):
    assert one(spark, "mysql://u:p@h/db", T.mask) == "***h/db"
    assert one(spark, "sk-" + "a1" * 16, T.mask) == "***"
    assert one(spark, "sk-" + "a" * 31, T.mask) == "sk-" + "a" * 31


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.816497, 0.0, 0.0]


def test_leaders(spark):
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate(("0", "FF", "FFFF", "FFF00", ""))], "doc long, page int, phash string")
    assert [r.cluster for r in H.leader_clusters(df).orderBy("page").collect()] == [0, 0, 1, 2, 3]


def test_limiter(spark):
    at = [50, 55, 58, 70, 109, 110, 111, 112, 113]
    df = spark.createDataFrame([("k", a, n) for n, a in enumerate(at)], "key string, at long, seq long")
    assert [r.allowed for r in rate_limit(df, 3, 60).orderBy("seq").collect()] == [True] * 3 + [False] * 2 + [True] * 3 + [False]


def test_pairing(spark):
    df = spark.createDataFrame([(1, k, {"s": "system", "u": "user", "a": "assistant"}[r], f"{r}{k}") for k, r in enumerate("suauuaa")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in N.paired_turns(df).orderBy("turn").collect()] == [("u1", "a2"), ("u4", "a5")]


def test_stats_and_pages(spark):
    df = spark.createDataFrame([(1, "work"), (2, "work"), (3, "study"), (4, None), (5, "other")], "id long, category string").withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("t"))))
    got = {r.category: r.n for r in N.category_stats(df).collect()}
    assert got == {"work": 2, "study": 1, "life": 0, "project": 0, "uncategorized": 1, "other": 1, "total": 5}
    assert N.page(df, [F.col("id").desc()], 1, 2, tag="t", tag_mode="post").count() == 0
    assert N.page(df, [F.col("id").desc()], 1, 2, tag="t").count() == 1


def test_no_tenant_has_no_rows(spark):
    df = spark.createDataFrame([("a",)], "user_id string")
    assert R.tenant(df, None).count() == 0 and R.tenant(df, "a").count() == 1


def test_splitter():
    rng = random.Random(1)
    texts = ["一二三。" * 90 + "\n\n" + "word " * 120, "x" * 150 + "? " + "y" * 150 + "! " + "z" * 150, "a  b   c " * 60, "q" * 1000]
    word = lambda: str(rng.randrange(10 ** rng.choice([9, 200, 400])))
    texts += ["".join(word() + rng.choice([" ", "  ", "。", "! ", "\n", "\n\n", "?"]) for _ in range(60)) for _ in range(20)]
    for text in texts:
        chunks = split_text(text)
        assert chunks and all(0 < len(c) <= 200 and c in text for c in chunks)
        assert "".join("".join(split_text(text, overlap=0)).split()) == "".join(text.split())  # nothing but blanks is lost
        assert sum(map(len, chunks)) >= len("".join(text.split()))
    assert split_text("") == []


def test_streams(spark, tmp_path):
    """The limiter and debouncing on a stream of files give what they give in batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("ab"[n % 2], a, n) for n, a in enumerate([50, 51, 55, 56, 58, 60, 70, 71, 109, 110, 111, 112, 113, 114, 115])]
    kind = "key string, at long, seq long"
    for k in range(3):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rate_limit_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, rate_limit(spark.createDataFrame(rows, kind), 2, 60).collect()))
    assert sorted(map(tuple, spark.table("limited").collect())) == want and any(not r[3] for r in want)
    bursts = debounce_stream(stream.select("key", F.timestamp_seconds("at").alias("at"), "seq"), "5 seconds", "1 second")
    q = bursts.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.events) for r in spark.table("bursts").collect()} >= {("a", 3), ("a", 1), ("b", 3), ("b", 1)}
    quiet = debounce(spark.createDataFrame(rows, kind).withColumn("at", F.timestamp_seconds("at")), 5000)
    assert {(r.key, r.seq) for r in spark.table("bursts").collect()} <= {(r.key, r.seq) for r in quiet.collect()}


def test_stores(spark, tmp_path):
    r = spark.createDataFrame([("u1", "a", "f"), ("u1", "b", None), ("u2", "c", "g")], "user_id string, md5 string, filename string")
    at = str(tmp_path / "registry")
    read = lambda: sorted((x.user_id, x.md5, x.filename) for x in spark.read.schema("md5 string, filename string, user_id string").json(at).collect())
    G.append_records(r.where("md5 != 'b'"), at)
    G.append_records(r.where("md5 = 'b'"), at)
    assert read() == [("u1", "a", "f"), ("u1", "b", None), ("u2", "c", "g")]
    G.rewrite_records(r.where("md5 = 'a'"), at, ["u2"])
    assert read() == [("u1", "a", "f")] and not (tmp_path / "registry" / "user_id=u2").exists()
    store = str(tmp_path / "chunks")
    G.append_chunks(r, store)
    G.append_chunks(r, store)
    assert spark.read.parquet(store).groupBy("user_id").count().where("count = 4").count() == 1


def test_page_bounds(spark):
    df = spark.createDataFrame([(1, "x")], "id long, category string")
    for number, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="page"):
            N.page(df, [F.col("id")], number, size)


def test_folders(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"x")
    (tmp_path / "b.md").write_bytes(b"# y")
    (tmp_path / "c.exe").write_bytes(b"z")
    assert {r.path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path)).collect()} == {"b.md"}
    assert {(r.kind, r.content) for r in read_documents(spark, str(tmp_path)).collect()} == {("txt", "x"), ("md", "# y")}
    images = tmp_path / "images"
    images.mkdir()
    (images / "2.png").write_bytes(b"two")
    (images / "1.bin").write_bytes(b"one")
    assert list(read_images(spark, str(images)).first().images.items()) == [("1.bin", "data:application/octet-stream;base64,b25l"), ("2.png", "data:image/png;base64,dHdv")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode())
    (tmp_path / "b.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.md").write_bytes(b"")
    assert {r.path.rsplit("/", 1)[1]: r.content for r in read_texts(spark, str(tmp_path)).collect()} == {"a.txt": "héllo", "b.txt": "中文"}
