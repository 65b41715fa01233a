from support import as_files

from corpuslens.functions import paths, text
from corpuslens.operators import inventory as I
from corpuslens.policy import Policy
from pyspark.sql import functions as F


def classes(df):
    return {r.path: r["class"] for r in df.collect()}


def test_sensitive_paths_and_their_examples(spark):
    yes = [".env", "a/.env.local", "id_rsa", "x/id_ed25519", "k/server.pem", "service-account-prod.json", "a/.ssh/config", ".aws/credentials", "t/.terraform/x/y"]
    no = [".env.example", "a/.env.prod.example", "src/env.ts", "keys.md", "awscredentials", "aws/credentials"]
    df = spark.createDataFrame([(p,) for p in yes + no], "path string").select("path", paths.is_sensitive(F.col("path")).alias("s"))
    got = {r.path: r.s for r in df.collect()}
    assert got == {**{p: True for p in yes}, **{p: False for p in no}}


def test_binary_content_and_limits(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(20)
    rows = [("logo.png", png), ("blob.txt", b"abc\x00def"), ("latin.txt", b"caf\xe9"), ("big.txt", b"x" * (2 << 20)), ("data.json", b"1" * (128 << 10)),
            ("package-lock.json", b"{}"), ("app.min.js", b"x"), ("ok.txt", "naïve\n".encode()), ("bom.txt", b"\xef\xbb\xbfhi"), ("u16.txt", b"\xff\xfeh\x00"),
            ("ctl.txt", b"\x01" * 11 + b"a" * 89), ("ctl10.txt", b"\x01" * 10 + b"a" * 90), ("empty.txt", b""), (".hidden", b"x")]
    df = spark.createDataFrame([("r", p, bytearray(c)) for p, c in rows], "repo string, path string, content binary")
    got = classes(I.inventory(df))
    assert got == {
        "logo.png": "binary", "blob.txt": "binary", "latin.txt": "unsupported_encoding", "big.txt": "source_text", "data.json": "source_text",
        "package-lock.json": "lockfile", "app.min.js": "generated", "ok.txt": "source_text", "bom.txt": "source_text", "u16.txt": "binary",
        "ctl.txt": "binary", "ctl10.txt": "source_text", "empty.txt": "source_text", ".hidden": "hidden_metadata"}
    hashed = {r.path: r.content_hash for r in I.inventory(df).collect()}
    assert all(hashed.values())
    sizes = {r.path: r.size_class for r in I.inventory(df).collect()}
    assert sizes["big.txt"] == "large" and sizes["data.json"] == "large_data" and sizes["ok.txt"] == "normal"
    issues = {r.path for r in I.scan_issues(df).collect()}
    assert {"latin.txt", "logo.png"} <= issues


def test_policy_switches(spark):
    df = as_files(spark, {"yarn.lock": "x", "dist2/app.min.js": "x", ".hidden": "x", "a.ts": "x"})
    on = {r.path for r in I.inventory(df, Policy(exclude_lockfiles=False, exclude_generated=False, include_hidden=True)).where("selectable").collect()}
    off = {r.path for r in I.inventory(df).where("selectable").collect()}
    assert on == {"yarn.lock", "dist2/app.min.js", ".hidden", "a.ts"} and off == {"a.ts"}


def test_skipped_dirs_only_as_directories(spark):
    df = as_files(spark, {"node_modules/x/i.js": "", "src/build/a.ts": "", "build": "", "a/target.ts": ""})
    assert {r.path for r in I.prune_skipped_dirs(df).collect()} == {"build", "a/target.ts"}


def ignored(spark, paths, rules):
    """rules: (base, ordinal, source rank, pattern)."""
    files = as_files(spark, {p: "" for p in paths}).select("repo", "path")
    df = spark.createDataFrame([("r", *r) for r in rules], "repo string, base string, ordinal int, source_rank int, pattern string")
    return {r.path: r.ignored for r in I.apply_ignore_rules(files, df).collect()}, df


def test_nested_ignore_with_negation(spark):
    got, _ = ignored(spark, ["keep.log", "drop.log", "sub/x.log", "docs/a.md", "a/docs/b.md", "top.txt", "sub/top.txt"],
                     [("", 1, 2, "*.log"), ("", 2, 2, "!keep.log"), ("", 3, 2, "docs/"), ("", 4, 3, "/top.txt")])
    assert got == {"keep.log": False, "drop.log": True, "sub/x.log": True, "docs/a.md": True, "a/docs/b.md": True, "top.txt": True, "sub/top.txt": False}


def test_ignore_bases_classes_escapes_and_parents(spark):
    got, rules = ignored(
        spark, ["a.tmp", "sub/a.tmp", "sub/deep/a.tmp", "f1.c", "f9.c", "fx.c", "#x", "q?.c", "qa.c", "out/keep.txt", "out/in/keep.txt", "lib/x/y/z.o", "lib/z.o", "w/lib/z.o"],
        [("", 1, 2, "*.tmp"), ("sub", 1, 2, "!*.tmp"), ("sub/deep", 1, 2, "a.tmp"), ("", 2, 2, "f[0-8].c"), ("", 3, 2, "f[!0-9].c"), ("", 4, 2, r"\#x"), ("", 5, 2, r"q\?.c"),
         ("", 6, 2, "out/"), ("", 7, 3, "!out/keep.txt"), ("", 8, 2, "lib/**/z.o"), ("", 9, 2, "[open"), ("", 10, 2, "end\\")])
    assert got == {"a.tmp": True, "sub/a.tmp": False, "sub/deep/a.tmp": True, "f1.c": True, "f9.c": False, "fx.c": True, "#x": True, "q?.c": True, "qa.c": False,
                   "out/keep.txt": True, "out/in/keep.txt": True, "lib/x/y/z.o": True, "lib/z.o": True, "w/lib/z.o": False}
    assert {r.pattern for r in I.invalid_rules(rules).collect()} == {"[open", "end\\"}


def test_inventory_names_the_source_of_an_exclusion(spark):
    rules = spark.createDataFrame([("r", "", 1, 3, "*.ts"), ("r", "", 2, 3, "*.png")], "repo string, base string, ordinal int, source_rank int, pattern string")
    inv = {r.path: r for r in I.inventory(as_files(spark, {"a.ts": "x", "b.png": "x", "c.md": "x"}), rules=rules).collect()}
    assert (inv["a.ts"].selectable, inv["a.ts"].exclusion.source, inv["a.ts"].exclusion.rule) == (False, "ai_ignore", "*.ts")
    assert inv["b.png"].exclusion.source == "policy" and inv["c.md"].selectable and inv["c.md"].exclusion is None


def test_consequential_kinds(spark):
    want = {"Cargo.lock": "dependency lockfile", "package.json": "build or dependency configuration", "requirements-dev.txt": "build or dependency configuration",
            ".github/workflows/ci.yml": "CI configuration", "infra/main.tf": "deployment configuration", "db/migrations/1.sql": "database migration",
            ".gitignore": "ignore rules or app permissions", "src/app.ts": None}
    df = spark.createDataFrame([(p,) for p in want], "path string").select("path", paths.consequential_kind(F.col("path")).alias("k"))
    assert {r.path: r.k for r in df.collect()} == want


def test_human_bytes_rounds_ties_to_even(spark):
    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1536: "1.5 KB", 2304: "2.2 KB", 2816: "2.8 KB", 1048576: "1.0 MB", 3 << 30: "3.0 GB"}
    df = spark.createDataFrame([(k,) for k in want], "n long").select("n", text.human_bytes(F.col("n")).alias("h"))
    assert {r.n: r.h for r in df.collect()} == want


def test_helpers(spark):
    r = spark.range(1).select(
        text.sanitize_message(F.lit("open /home/u/x failed: C:\\tmp denied")).alias("m"),
        text.revision_label(F.lit("git:0123456789abcdef+dirty")).alias("g"), text.revision_label(F.lit("scan:" + "a" * 40)).alias("s"),
        text.capped_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2).alias("c"), text.slug(F.lit("My Model v2!")).alias("sl"), text.slug(F.lit("!!")).alias("d"),
        text.truncate_utf8(F.lit("aé€"), 2).alias("t2"), text.truncate_utf8(F.lit("aé€"), 5).alias("t5"), text.truncate_utf8(F.lit("aé€"), 6).alias("t6")).first()
    assert r.m == "open <path> failed: <path> denied" and r.g == "`0123456` + uncommitted changes" and r.s == "`scan:" + "a" * 15 + "`"
    assert r.c == "`a`, `b` (+1 more)" and r.sl == "my-model-v2" and r.d == "model"
    assert (r.t2, r.t5, r.t6) == ("a", "aé", "aé€")


def test_lines_follow_the_rules(spark):
    for content, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb\r\n", ["a", "b"]), ("a\n\nb", ["a", "", "b"]), ("x\r\r\n", ["x\r"])):
        df = as_files(spark, {"f": content})
        assert df.select(text.line_array(F.col("content")).alias("l")).first().l == want
        got = [(r.line_no, r.line) for r in text.explode_lines(df).orderBy("line_no").collect()]
        assert got == [(i + 1, l) for i, l in enumerate(want)]
