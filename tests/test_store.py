import os

import pytest

from corpuslens.sources import store


@pytest.fixture()
def root(spark, tmp_path):
    folder = str(tmp_path / "store with space")
    store.write_store(tables(spark), folder, buckets=8, files=2)
    return folder


def tables(spark):
    repos = [f"r{i}" for i in range(20)]
    runs = [(f"run{i}", repos[0] if i % 3 == 0 else repos[i % 20], i) for i in range(300)]
    return {
        "projects": spark.createDataFrame([(r, 1) for r in repos], "repo string, opened int"),
        "files": spark.createDataFrame([(repos[0] if i % 2 else repos[i % 20], f"p{i}", i) for i in range(400)] + [(None, "lost", 0)], "repo string, path string, size int"),
        "runs": spark.createDataFrame(runs, "run_id string, repo string, n int"),
        "events": spark.createDataFrame([(runs[i % 300][0], i) for i in range(2000)] + [("orphan", -1), (None, -2)], "run_id string, sequence int"),
    }


def state(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet") and "/_" not in d}


def contents(spark, folder):
    return {d.name: sorted(map(str, store.read_table(spark, folder, d.name).collect())) for d in store.LEDGER}


def wanted(spark, gone):
    t = {k: v.collect() for k, v in tables(spark).items()}
    doomed = {r.run_id for r in t["runs"] if r.repo in gone}
    return {k: sorted(str(r) for r in rows if (r.run_id not in doomed if k == "events" else r.repo not in gone)) for k, rows in t.items()}


def test_removes_every_dependent_and_nothing_else(spark, root):
    before = state(root)
    gone = {"r0", "r7"}
    asked = spark.createDataFrame([("r0",), ("r7",), ("r7",), ("unknown",), (None,)], "repo string")
    report = {r.table_name: r for r in store.forget(spark, root, asked).collect()}
    want = wanted(spark, gone)
    assert contents(spark, root) == want
    all_rows = {k: v.count() for k, v in tables(spark).items()}
    assert {k: (r.removed, r.kept) for k, r in report.items()} == {k: (all_rows[k] - len(want[k]), len(want[k])) for k in want}
    after = state(root)
    for d in ("files", "projects", "runs"):
        same = [p for p in before if p.startswith(d + "/") and after.get(p) == before[p]]
        folders = {p.split("/")[1] for p in before if p.startswith(d + "/")}
        assert len({p.split("/")[1] for p in same}) == len(folders) - report[d].partitions > 0
    # once more: nothing is found, no file is touched
    assert [r.removed + r.partitions for r in store.forget(spark, root, asked).collect()] == [0] * 4
    assert state(root) == after


def test_emptied_partitions_go(spark, root):
    store.forget(spark, root, spark.createDataFrame([(f"r{i}",) for i in range(20)], "repo string"))
    left = contents(spark, root)
    assert [len(left[k]) for k in ("projects", "files", "runs", "events")] == [0, 1, 0, 2]
    assert store.forget(spark, root, spark.createDataFrame([("r1",)], "repo string")).agg({"removed": "sum"}).first()[0] == 0


@pytest.mark.parametrize("step", ["rows", "journal", "half"])
def test_a_run_that_broke_off_is_finished(spark, root, monkeypatch, step):
    asked = spark.createDataFrame([("r0",)], "repo string")
    real, calls = store._swap, []

    def broken(s, table, staged):
        calls.append(table)
        if len(calls) == 2:  # events are gone, runs are staged
            if step == "rows":
                store._delete(s, f"{staged}/journal")
            if step == "half":  # the old partitions are dropped, the new ones not yet there
                for r in s.read.parquet(f"{staged}/journal").collect():
                    store._delete(s, f"{table}/part={r['part']}")
            raise RuntimeError("lost")
        return real(s, table, staged)

    monkeypatch.setattr(store, "_swap", broken)
    with pytest.raises(RuntimeError, match="lost"):
        store.forget(spark, root, asked)
    monkeypatch.setattr(store, "_swap", real)
    store.forget(spark, root, asked)
    assert contents(spark, root) == wanted(spark, {"r0"})
    assert not os.path.exists(f"{root}/_staged/runs")
