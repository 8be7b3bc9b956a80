"""The jobs on copies of the tables: growing input, reruns, failures between steps, odd rows, command lines."""

from __future__ import annotations

import json
import math
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, label_release, observation_feed
from jobs.queries import PLANTED
from pairwell.config import EngineConfig

SF = "/root/testdata/sf0.001"
TOP = Path(__file__).resolve().parents[2]


@pytest.fixture()
def copies(spark, tmp_path):
    """Documents in three files that can be brought one by one, and labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("part", F.col("doc_id") % 3)
    for k in range(3):
        docs.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(f"{tmp_path}/parts/{k}")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels")
    return tmp_path


def bring(copies, k):
    target = copies / "documents"
    target.mkdir(exist_ok=True)
    for file in (copies / "parts" / str(k)).glob("*.parquet"):
        (target / f"{k}-{file.name}").write_bytes(file.read_bytes())


def calls(spark, out):
    rows = spark.read.parquet(f"{out}/calls").select("allele", "cluster_id", "n_pos", "n_neg", "n_total", F.round("gamma", 9).alias("gamma"), "b_call").collect()
    return sorted(map(tuple, rows))


def once(spark, copies, parts, name):
    """What one run over the given parts alone makes."""
    out, folder = copies / name, copies / f"{name}-documents"
    docs = spark.read.parquet(*[f"{copies}/parts/{k}" for k in parts])
    docs.write.parquet(str(folder))
    observation_feed.run(spark, str(folder), f"{copies}/labels", str(out))
    return calls(spark, out)


def feed(spark, copies, **more):
    return observation_feed.run(spark, f"{copies}/documents", f"{copies}/labels", f"{copies}/out", **more)


def test_feed_takes_only_what_is_new(spark, copies):
    sizes = [spark.read.parquet(f"{copies}/parts/{k}").count() for k in range(3)]
    bring(copies, 0)
    bring(copies, 1)
    first = feed(spark, copies)
    assert first["documents"] == sizes[0] + sizes[1] and calls(spark, f"{copies}/out") == once(spark, copies, [0, 1], "a")
    before = {p: p.stat().st_mtime_ns for p in (copies / "out").rglob("*.parquet")}
    again = feed(spark, copies)
    assert again == {"documents": 0, "batches": 0, "pairs_called": None}
    assert before == {p: p.stat().st_mtime_ns for p in (copies / "out").rglob("*.parquet")}
    bring(copies, 2)
    third = feed(spark, copies)
    assert third["documents"] == sizes[2] and third["batches"] == 1
    assert calls(spark, f"{copies}/out") == once(spark, copies, [0, 1, 2], "b")
    logged = [json.loads(r.value) for r in spark.read.text(f"{copies}/out/log").collect()]
    assert sum(r["documents"] for r in logged) == sum(sizes) and {r["batch"] for r in logged} == set(range(len(logged)))


def test_feed_batch_by_batch_is_the_same(spark, copies, tmp_path):
    for k in range(3):
        bring(copies, k)
    config = tmp_path / "one.json"
    config.write_text('{"files_per_batch": 1}')
    done = feed(spark, copies, config=str(config))
    assert done["batches"] == 3 and calls(spark, f"{copies}/out") == once(spark, copies, [0, 1, 2], "a")


def test_feed_stopped_before_calls(spark, copies, monkeypatch):
    bring(copies, 0)
    with monkeypatch.context() as m:
        m.setattr(observation_feed, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            feed(spark, copies)
    done = feed(spark, copies)
    assert done["documents"] == 0 and done["pairs_called"] and calls(spark, f"{copies}/out") == once(spark, copies, [0], "a")


def test_feed_batch_that_fails_is_repeated(spark, copies, monkeypatch):
    bring(copies, 0)
    bring(copies, 1)
    real = common.record

    def lost(*_):
        raise RuntimeError("lost after the counts were written")

    with monkeypatch.context() as m:
        m.setattr(common, "record", lost)
        with pytest.raises(Exception, match="lost"):
            feed(spark, copies)
    assert common.record is real
    done = feed(spark, copies)
    assert done["batches"] == 1 and calls(spark, f"{copies}/out") == once(spark, copies, [0, 1], "a")


def test_feed_of_odd_rows(spark, tmp_path):
    rows = [(1, "Wonderful wonders", "x"), (1, "Wonderful wonders", "x"), (2, None, "x"), (3, "", "y"), (4, "nothing labelled here", "y"), (5, "without source", None), (None, "without number", "x"), (6, "tiny", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    done = observation_feed.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert done["documents"] == 8
    assert [r[:5] for r in calls(spark, f"{tmp_path}/out")] == [("x", "WLCERS", 2, 0, 2), ("x", "WLCFKL", 2, 0, 2)] or [r[2:5] for r in calls(spark, f"{tmp_path}/out")] == [(2, 0, 2)] * 2
    assert json.loads(spark.read.text(f"{tmp_path}/out/log").first().value)["unlabelled"] == 2


def test_feed_without_observations(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels")
    done = observation_feed.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")
    assert done["documents"] == 0 and not done["pairs_called"]


def test_config_is_checked(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"labell": "toxic"}')
    with pytest.raises(ValueError, match="labell"):
        common.read_config(spark, str(path), observation_feed.DEFAULTS)
    for job in (observation_feed, label_release):
        cfg = common.read_config(spark, str(TOP / "jobs" / f"{job.__name__.split('.')[1]}.json"), job.DEFAULTS)
        EngineConfig(**cfg["engine"])


def release(spark, out, kind):
    return sorted(map(tuple, spark.read.parquet(f"{out}/{kind}").drop("gamma").collect()))


def test_release_reruns_and_replaces_parts(spark, tmp_path):
    settings = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    done = label_release.run(spark, SF, str(tmp_path), {"positive": PLANTED})
    assert done["lines"] == done["left_out"] + sum(r[3] for r in release(spark, tmp_path, "observed")) and done["propagated"] > 0
    whole = release(spark, tmp_path, "observed"), release(spark, tmp_path, "propagated")
    assert label_release.run(spark, SF, str(tmp_path), {"positive": PLANTED}) == done
    assert (release(spark, tmp_path, "observed"), release(spark, tmp_path, "propagated")) == whole
    names = {r[-1] for r in whole[0]}
    first = min(names)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("observed/*/*.parquet")}
    part = label_release.run(spark, SF, str(tmp_path), {"positive": "false", "only": first})
    assert part["observed"] == done["observed"]  # what the release holds
    after = release(spark, tmp_path, "observed")
    only = {n for n in names if n.startswith(first)}
    assert [r for r in after if r[-1] not in only] == [r for r in whole[0] if r[-1] not in only]
    assert all(r[1] == 0 for r in after if r[-1] in only)
    kept = {p: t for p, t in files.items() if p.parent.name.split("=")[1] not in only}
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert settings == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def tables(spark, folder, lines):
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_returnflag string, l_orderkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 99)], "s_suppkey long, s_nationkey long").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(10, "A", 1), (11, "B", 1)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{folder}/nation.parquet")


def test_release_of_odd_rows(spark, tmp_path):
    tables(spark, tmp_path, [(1, 1, "R", 1), (1, 2, "A", 1), (1, 3, None, 1), (None, 1, "R", 1), (2, None, "R", 1), (2, 4, "R", 1), (2, 7, "R", 1), (1, 1, "R", 1)])
    done = label_release.run(spark, str(tmp_path), f"{tmp_path}/out")
    assert (done["lines"], done["left_out"], done["observed"], done["propagated"]) == (8, 4, 2, 0)
    assert [r[:4] + r[-1:] for r in release(spark, f"{tmp_path}/out", "observed")] == [(1, 0, 1, 1, "B"), (1, 2, 1, 3, "A")]


def test_release_groups_the_lines_once(spark, tmp_path, monkeypatch):
    plans, real = [], label_release.saved
    monkeypatch.setattr(label_release, "saved", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    label_release.run(spark, SF, str(tmp_path), {"positive": PLANTED})
    by_part = [p for p in plans if "l_partkey" in p and "md5" in p]
    assert len(by_part) == 1 and by_part[0].count("Aggregate [") == 1  # by part and number of the nation; suppliers only where labels are propagated
    assert "Aggregate [cluster_id" in by_part[0] and "n_name" not in by_part[0].split("Join")[0]


def test_release_counts_a_parts_suppliers_once(spark, tmp_path):
    tables(spark, tmp_path, [(p, s, "R" if p % 2 else "A", p) for p in range(200) for s in ((1, 1, 2, 3) if p < 150 else (1, 1, 2))])
    label_release.run(spark, str(tmp_path), f"{tmp_path}/out", {"positive": "l_returnflag = 'R'"})
    found = spark.read.parquet(f"{tmp_path}/out/propagated").where("allele = 'B'").select("cluster_id", "n_tilde", "lambda_w").collect()
    assert {r.cluster_id for r in found} == set(range(150, 200))
    tested = spark.read.parquet(f"{tmp_path}/out/tests").first()
    want = math.log(tested.OR_conservative) * 3 * math.sqrt(3 / 8)  # three lines of two suppliers, four members each
    assert {round(r.n_tilde, 4) for r in found} == {round(want, 4)}


def test_release_of_nothing(spark, tmp_path):
    tables(spark, tmp_path, [])
    done = label_release.run(spark, str(tmp_path), f"{tmp_path}/out")
    assert (done["lines"], done["observed"]) == (0, 0)


@pytest.mark.parametrize("job", ["observation_feed", "label_release"])
def test_command_line(tmp_path, job):
    given = ["--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet"] if job == "observation_feed" else ["--tables", SF]
    command = [sys.executable, str(TOP / "jobs" / f"{job}.py"), *given, "--out", f"{tmp_path}/out", "--config", str(TOP / "jobs" / f"{job}.json")]
    found = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert found.returncode == 0, found.stderr[-2000:]
    assert list(tmp_path.glob("out/*/allele=*/*.parquet")) and "pairs" in found.stderr
