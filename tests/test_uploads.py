"""Upload folders as data sources, the bucketed registry, and both stores of a note."""

import pytest

from scrivana.operators import notes as N
from scrivana.operators import registry as G
from scrivana.sources import uploads as U
from scrivana.sources.files import image_rows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    for tenant in ("user_id=u1", "u2", "u3", "_hidden"):
        (root / tenant).mkdir()
    (root / "stray.txt").write_bytes(b"no tenant")
    (root / "user_id=u1" / "a.txt").write_bytes("héllo".encode())
    (root / "user_id=u1" / "b.MD").write_bytes("中文".encode("gbk"))
    (root / "user_id=u1" / "c.exe").write_bytes(b"x")
    (root / "user_id=u1" / "empty.txt").write_bytes(b"")
    (root / "user_id=u1" / "_SUCCESS").write_bytes(b"x")
    (root / "u2" / "d.txt").write_bytes(b"\xff\xfe\xff")
    (root / "u2" / "e.txt").write_bytes(b"e" * 3000)
    (root / "u3" / "f.md").write_bytes(b"# f")
    (root / "_hidden" / "g.txt").write_bytes(b"g")
    return str(root)


ALL = [("u1", "md", "中文"), ("u1", "txt", "héllo"), ("u2", "txt", ""), ("u2", "txt", "e" * 3000), ("u3", "md", "# f")]


def test_documents(spark, folder):
    read = lambda **o: rows(U.uploads(spark, folder, bytes="10", **o).select("user_id", "kind", "content"))
    df = U.uploads(spark, folder, bytes="10")
    assert df.rdd.getNumPartitions() > 2 and read() == ALL
    assert read(tenants=["u1"], kinds=["txt"]) == [ALL[1]]
    assert read(tenants=["u2", "u3"]) == ALL[2:]
    assert read(tenants=["none"]) == read(kinds=["exe"]) == []
    assert rows(df.where("user_id = 'u1' and kind = 'txt'").select("content")) == [("héllo",)] and df.count() == 5
    assert rows(df.select("path"))[0][0].endswith("/u2/d.txt")


def test_pruning(folder, monkeypatch):
    """Folders of other tenants are not listed, files of other kinds not planned."""
    listed = []
    real = U.FileSelector
    monkeypatch.setattr(U, "FileSelector", lambda path: listed.append(path.rsplit("/", 1)[1]) or real(path))
    reader = U.DocumentSource({"path": folder, "tenants": '["u2"]', "kinds": '["txt", "pdf"]'}).reader(None)
    assert [f[2].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["d.txt", "e.txt"]
    assert "u2" in listed and not {"u3", "user_id=u1", "_hidden"} & set(listed)


def test_registry_files(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    lines = ['{"md5": "a", "filename": "f.txt", "upload_time": "t"}', "", "  legacy  ", "{broken", "[1]", '{"md5": 5}', '{"filename": null}']
    (tmp_path / "u1" / "registry.jsonl").write_text("\n".join(lines))
    got = U.uploads(spark, str(tmp_path), "upload_registry").select("user_id", "md5", "filename", "upload_time").collect()
    assert [tuple(r) for r in got] == [("u1", "a", "f.txt", "t"), ("u1", "legacy", None, None), ("u1", "{broken", None, None), ("u1", "[1]", None, None), ("u1", "5", None, None), ("u1", None, None, None)]


def test_probe_does_not_shuffle_the_registry(spark, tmp_path):
    known = spark.createDataFrame([(f"u{k % 3}", f"m{k}") for k in range(0, 300, 3)], "user_id string, md5 string")
    G.store_registry(known, "registry_of_test", str(tmp_path / "r"), 4)
    files = spark.createDataFrame([(f"u{k % 3}", f"m{k}", k) for k in range(300)] + [(None, "m3", 900), ("u0", None, 901)], "user_id string, md5 string, id long")
    left, found = G.probe(files, "registry_of_test"), G.probe(files, "registry_of_test", known=True)
    assert rows(found.select("id")) == [(k,) for k in range(0, 300, 3)]
    assert rows(left.select("id")) == [(k,) for k in range(300) if k % 3] + [(900,), (901,)]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
    spark.sql("DROP TABLE registry_of_test")


def test_both_stores(spark, tmp_path):
    new = spark.createDataFrame([(1, "u", "one"), (2, "u", ""), (3, "v", None), (4, "v", "four")], "id long, user_id string, content string")
    store = str(tmp_path)
    read = lambda n: rows(spark.read.parquet(f"{store}/{n}").select("id"))
    G.write_notes(new.where("id < 4"), store, 0)
    G.write_notes(new.where("id = 4"), store, 1)
    assert (read("notes"), read("vectors")) == ([(1,), (2,), (3,), (4,)], [(1,), (4,)])
    G.write_notes(new.where("id < 4"), store, 0)
    assert (read("notes"), read("vectors")) == ([(1,), (2,), (3,), (4,)], [(1,), (4,)])


def test_basenames(spark):
    registry = spark.createDataFrame([("u", "a.txt", 1), ("u", "b.txt", 2), ("v", "a.txt", 3)], "user_id string, filename string, n int")
    asked = spark.createDataFrame([("u", 1, "/x/y/a.txt"), ("u", 2, "C:\\up\\b.txt"), ("v", 3, "a.txt"), ("v", 4, "a.txt/"), ("v", 5, None)], "user_id string, request_id int, path string")
    assert rows(G.by_basename(registry, asked).select("request_id", "n")) == [(1, 1), (2, 2), (3, 3)]


def test_images(spark, tmp_path):
    for doc in ("d1", "d2"):
        (tmp_path / doc).mkdir()
        (tmp_path / doc / "1.png").write_bytes(b"one")
    (tmp_path / "d2" / "2.bin").write_bytes(b"two")
    got = rows(image_rows(spark, str(tmp_path)))
    assert got == [("d1", "1.png", "data:image/png;base64,b25l"), ("d2", "1.png", "data:image/png;base64,b25l"), ("d2", "2.bin", "data:application/octet-stream;base64,dHdv")]


def test_copy_of_leaders(spark):
    pages = spark.createDataFrame([(1, 0, "00", "first"), (1, 1, "01", "second"), (1, 2, "ffff", "third"), (2, 5, "00", "other")], "doc long, page int, phash string, content string")
    from scrivana.operators.hamming import leader_clusters

    got = rows(N.copy_leaders(leader_clusters(pages.select("doc", "page", "phash")), pages))
    assert got == [(1, 0, 0, "first"), (1, 1, 0, "first"), (1, 2, 1, "third"), (2, 5, 0, "other")]
