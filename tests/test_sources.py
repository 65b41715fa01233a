import os

from support import SMALL_APP

from corpuslens.functions import plugins
from corpuslens.operators import inventory as I
from corpuslens.operators import render as R
from corpuslens.sources import tree
from pyspark.sql import functions as F


def plant(root, files):
    for p, c in files.items():
        full = root / p
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(c if isinstance(c, bytes) else c.encode())


def test_scan_tree_and_sinks(spark, tmp_path):
    plant(tmp_path / "in" / "app", {**SMALL_APP, "node_modules/x/i.js": "x", "img.png": b"\x89PNG"})
    files = tree.scan_tree(spark, str(tmp_path / "in"))
    inv = I.inventory(files)
    got = {r.path: r["class"] for r in inv.collect()}
    assert got == {**{p: "source_text" for p in SMALL_APP}, "img.png": "binary"}
    assert {r.repo for r in inv.collect()} == {"app"}
    chosen = inv.where("selectable").withColumn("content", F.col("content").cast("string")).select("repo", "path", "size_bytes", "content")
    tree.write_bundles(R.bundle(chosen), R.bundle_parts(chosen), str(tmp_path / "out"))
    names = sorted((tmp_path / "out" / "text" / "repo=app").glob("part-*"))
    text = "".join(p.read_text() for p in names)
    at = [text.index(f"===== {p} =====") for p in sorted(SMALL_APP)]
    assert at == sorted(at)
    assert spark.read.json(str(tmp_path / "out" / "manifest")).first().file_count == 5
    tree.write_parts(R.bundle_parts(chosen), str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 5


def test_scan_keeps_hidden_names_and_turns_failures_into_issues(spark, tmp_path):
    names = [".env", ".github/workflows/ci.yml", "pkg/__init__.py", "_private/x.py", "with space/a%20b+c.txt", "ünï/cödé😀.md", "a[b]{c}*?.txt", "empty.txt"]
    plant(tmp_path / "in" / "app", {**{n: n if n != "empty.txt" else "" for n in names}, "lost.txt": "x", "node_modules/x/i.js": "x", "deep/node_modules/j.js": "x"})
    plant(tmp_path / "in" / "node_modules", {"kept.js": "a repository may have any name"})
    os.symlink(tmp_path / "in" / "app", tmp_path / "in" / "app" / "loop")
    os.mkfifo(tmp_path / "in" / "app" / "pipe")
    (tmp_path / "in" / "app" / os.fsdecode(b"bad\xff.txt")).write_bytes(b"x")
    scan = tree.scanned(spark, (tmp_path / "in").as_uri())
    (tmp_path / "in" / "app" / "lost.txt").unlink()  # listed, and gone when it is read
    rows = scan.collect()
    assert {r.path: bytes(r.content).decode() for r in rows if r.repo == "app" and r.error is None and not r.is_symlink} == {n: "" if n == "empty.txt" else n for n in names}
    assert [(r.path, bytes(r.content)) for r in rows if r.repo == "node_modules"] == [("kept.js", b"a repository may have any name")]
    issues = {r.path: r.message for r in tree.tree_issues(scan).collect()}
    assert set(issues) == {"lost.txt", "pipe", "bad?.txt"} and str(tmp_path) not in " ".join(issues.values())
    assert issues["lost.txt"].startswith("the file could not be read") and issues["pipe"] == "not a regular file"
    assert [r.path for r in rows if r.is_symlink] == ["loop"]
    assert {r.repo for r in tree.scan_tree(spark, str(tmp_path / "in"), repo="one").collect()} == {"one"}


def test_wide_trees_are_dealt_anew(spark, tmp_path):
    plant(tmp_path, {f"r/d{i}/e{j}/f{k}.txt": "x" for i in range(6) for j in range(5) for k in range(4)})
    whole = sorted(r.rel for r in tree.listing(spark, str(tmp_path)).collect())
    assert whole == sorted(r.rel for r in tree.listing(spark, str(tmp_path), entries=3).collect()) and len(whole) == 120


def test_folder_that_cannot_be_listed():
    class Broken(tree.Place):
        def __init__(self):
            pass

        def entries(self, rel):
            if rel == "shut":
                raise PermissionError(13, "Permission denied", "/secret/place/shut")
            yield from {"": [("shut", "dir", 0, 0.0, False), ("a.txt", "file", 1, 0.0, False)]}[rel]

    got = list(tree.listed(Broken(), "", frozenset(), 0, 100))
    assert [(r[0], r[5]) for r in got] == [("a.txt", None), ("shut", "the folder could not be listed: Permission denied")]


def test_places_on_other_file_systems(tmp_path):
    from pyarrow import fs

    assert [tree.arrow_uri(u) for u in ("s3a://bucket/a%20b", "s3n://b/x", "hdfs://nn:8020/data/in", "gs://b")] == ["s3://bucket/a%20b", "s3://b/x", "hdfs://nn:8020/data/in", "gs://b"]
    for root in (str(tmp_path / "a b"), (tmp_path / "a b").as_uri(), (tmp_path / "a b").as_uri().replace("file:///", "file:/")):
        assert tree.Place(root).base == str(tmp_path / "a b")
    plant(tmp_path / "in", {"x/.hidden": "h", "x/p%41th.txt": "q", "skip/y": "n"})
    place = tree.Place.__new__(tree.Place)  # any file system that pyarrow opens is walked the same way
    place.files, place.base = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "in"
    got = {r[0]: place.read(r[0]) for r in tree.listed(place, "", frozenset({"skip"}), 0, 100)}
    assert got == {"x/.hidden": b"h", "x/p%41th.txt": b"q"}


def test_report(spark, tmp_path):
    res = spark.createDataFrame([("r", "raw_all", 3, 0.5, 1.0, 0), ("r", "deterministic_map", 0, None, None, 0)],
                                "repo string, strategy string, files_included long, precision double, recall double, missed_files long")
    tree.write_report(res, str(tmp_path / "rep"))
    lines = {r.value for r in spark.read.text(str(tmp_path / "rep" / "markdown")).collect()}
    assert lines == {"| r | raw_all | 3 | 50% | 100% |", "| r | deterministic_map | 0 | n/a | n/a |"}
    assert os.path.isdir(tmp_path / "rep" / "json")


def test_plugins(spark):
    plugins.register("vue", lambda p: p.endswith(".vue"))
    f = spark.createDataFrame([("a.vue",), ("tests/b.vue",)], "path string")
    assert [r.path for r in f.where(plugins.matching(all_of=("vue",), none_of=("test",))(F.col("path"))).collect()] == ["a.vue"]


def test_snapshots_are_read_without_the_stored_scan(spark, tmp_path):
    from corpuslens import session
    from corpuslens.sources.overlay import Tables

    d = str(tmp_path)
    spark.createDataFrame([(i, "src1", f"text {i}", "en", 300) for i in range(60)], "doc_id long, source string, text string, lang string, n_chars long").write.parquet(f"{d}/documents.parquet")
    t = Tables(spark, d)
    read = sorted(map(tuple, t.view("snap_base").select("repo", "path", "content").collect()))
    assert not any(k.startswith(f"{d}/") for _, k in session._STORED)
    assert read and read == sorted(map(tuple, t.files.select("repo", "path", "content").collect()))
