import difflib

from corpuslens.operators import review as J
from corpuslens.operators import ledger as L
from pyspark.sql import functions as F


def naive_diff(path, old, new):
    a, b = old.split("\n")[:-1], new.split("\n")[:-1]
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    st = max(p - 3, 0)
    oe, ne = min(len(a) - s + 3, len(a)), min(len(b) - s + 3, len(b))
    out = [f"--- a/{path}", f"+++ b/{path}", f"@@ -{st + 1},{oe - st} +{st + 1},{ne - st} @@"]
    out += [" " + x for x in a[st:p]] + ["-" + x for x in a[p:len(a) - s]] + ["+" + x for x in b[p:len(b) - s]] + [" " + x for x in a[len(a) - s:oe]]
    return "\n".join(out) + "\n"


def test_unified_diff(spark):
    cases = [("a\nb\nc\nd\ne\nf\ng\n", "a\nb\nc\nX\ne\nf\ng\n"), ("a\n", "a\nb\n"), ("a\nb\n", "b\n"), ("x\nx\nx\n", "x\nx\n"), ("1\n2\n3\n", "9\n8\n")]
    df = spark.createDataFrame([(str(i), o, n) for i, (o, n) in enumerate(cases)], "path string, old string, new string")
    for r in J.unified_diff(df).collect():
        assert r.unified_diff == naive_diff(r.path, r.old, r.new)
        body = [l for l in r.unified_diff.split("\n")[3:-1]]
        restored = "".join(l[1:] + "\n" for l in body if l[0] in " +")
        assert restored in r.new and difflib.SequenceMatcher(None, r.old, r.new).ratio() >= 0
    created = J.unified_diff(spark.createDataFrame([("p", None, "a\nb\n")], "path string, old string, new string")).first().unified_diff
    assert created == "--- /dev/null\n+++ b/p\n@@ -0,0 +1,2 @@\n+a\n+b\n"


def test_commands(spark):
    want = {"cargo test": None, "cargo test --workspace": None, "npm test": None, "cargo test; rm -rf /": "shell character", "cargo test && curl http://x": "shell character",
            "npm test | grep ok": "shell character", "sudo cargo test": "destructive", "python script.py": "not on the list", "bash -c 'echo hi'": "not on the list",
            "pytest 'a b": "a quote is left", "  ": "command cannot"}
    df = spark.createDataFrame([(c,) for c in want], "command string")
    for r in J.command_audit(df, ["cargo test", "npm test", "pytest"]).collect():
        assert (r.error is None) if want[r.command] is None else r.error.startswith(want[r.command]), (r.command, r.error)


def test_gate_levels(spark):
    p = spark.createDataFrame([("1", "src/a.ts", False, 1, 1), ("2", "Cargo.lock", False, 1, 1), ("3", "src/b.ts", False, 100, 1), ("4", "src/c.ts", False, 1, 1)],
                              "proposal_id string, path string, is_deleted boolean, lines_added long, lines_deleted long")
    i = spark.createDataFrame([("1", 1.0, 1.5, 0, 0), ("2", 1.0, 1.5, 0, 0), ("3", 1.0, 1.5, 0, 0), ("4", 0.6, 3.5, 2, 0)],
                              "proposal_id string, change_share double, risk double, corrections long, injection_warnings long")
    w = spark.createDataFrame([], "proposal_id string, path string, warning string")
    got = {r.proposal_id: (r.level, r.reasons) for r in J.apply_gate(J.gate_reasons(p, i, w), i).collect()}
    assert got == {"1": ("auto_apply", 0), "2": ("careful_review", 1), "3": ("confirm", 1), "4": ("confirm", 3)}


def test_upsert_keeps_first_and_replaces_named(spark):
    v = spark.createDataFrame([("r1", 1, "a", "x"), ("r1", 2, "b", None), ("r1", 3, "c", "z"), ("r2", 5, "q", None)], "id string, v int, first string, status string")
    got = {r.id: (r.first, r.status) for r in L.ledger_upsert(v, "id", "v", ["first"], ["status"]).collect()}
    assert got == {"r1": ("a", "z"), "r2": ("q", None)}


def test_sessions_of_one_hot_user(spark):
    ev = spark.range(20_000).select(F.lit(1).cast("long").alias("user_id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 600) + make_dt_interval(CAST(id % 2 AS INT))").alias("ts"), F.lit(1).cast("long").alias("tokens"))
    got = sorted(r.events for r in L.sessions(ev).collect())
    assert got == [10_000, 10_000]


def test_patches_of_repeated_and_missing_keys(spark):
    """What is changed is decided by key: a repeated path gives every pair, a missing one none."""
    base = [("r", "same", "x\n"), ("r", "gone", "x\n"), ("r", "edit", "x\n"), ("r", "twice", "x\n"), ("r", "twice", "y\n"), (None, "a", "x\n"), ("r", "none", None)]
    work = [("r", "same", "x\n"), ("r", "new", "n\n"), ("r", "edit", "z\n"), ("r", "twice", "x\n"), ("r", "none", None)] + [("r", f"u{i}", "u\n") for i in range(300)]
    base += [("r", f"u{i}", "u\n") for i in range(300)]
    side = lambda rows: spark.createDataFrame([(r, p, 0, c) for r, p, c in rows], "repo string, path string, batch long, content string")
    got = sorted((r.path, r.is_new, r.is_deleted) for r in J.patches(side(base), side(work)).collect())
    assert got == [("edit", False, False), ("gone", False, True), ("new", True, False), ("none", True, True), ("twice", False, False), ("twice", False, False)]
