import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.operators.filters import Col, raw_sql, table_condition
from keyloom.plans.foreach import EachOf, Fixed
from keyloom.plans import lineage, state
from keyloom.plans.run import Variable, for_each, states
from keyloom.sources.store import AmbiguousVersion, NotFound, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), ["subject", "trial"])


def test_values_round_trip(store):
    values = {
        "whole": 3, "real": 2.5, "text": "a", "flag": True, "vector": np.array([1.0, 2.0]), "matrix": np.arange(6.0).reshape(2, 3), "cube": np.zeros((2, 2, 2)),
        "list": [1.0, 2.0], "names": ["a", "b"],
    }
    for name, value in values.items():
        store.save(name, value, subject=1, trial=1.0)
        got = store.load(name, subject=1, trial="1")
        assert np.array_equal(got, value) and type(got) is type(value)
    store.save("nested", {"a": {"b": 1, "c": np.array([1.0, 2.0])}, "d": "x"}, subject=1)
    got = store.load("nested", subject=1)
    assert got["a"]["b"] == 1 and got["a"]["c"].tolist() == [1.0, 2.0] and got["d"] == "x"
    table = pd.DataFrame({"side": ["L", "R"], "speed": [1.0, 2.0]})
    store.save("gait", table, subject=1)
    pd.testing.assert_frame_equal(store.load("gait", subject=1), table)


def test_versions_exclusion_and_errors(store):
    first = store.save("speed", 1.0, subject=1, trial=1)
    second = store.save("speed", 2.0, subject=1, trial=1)
    assert store.load("speed", subject=1, trial=1) == 2.0
    store.exclude(second)
    assert store.load("speed", subject=1, trial=1) == 1.0
    store.include(second)
    assert store.load("speed", subject=1, trial=1) == 2.0
    assert store.load("speed", version=first) == 1.0
    assert store.list_versions("speed").count() == 2
    store.save("speed", 5.0, subject=1, trial=1, low_hz=20)
    with pytest.raises(AmbiguousVersion):
        store.load("speed", subject=1, trial=1)
    assert store.load("speed", subject=1, trial=1, versions={"low_hz": 20}) == 5.0
    with pytest.raises(NotFound):
        store.load("speed", subject=9)


def test_same_value_is_stored_once(store):
    assert store.save("speed", 1.0, subject=1, trial=1) == store.save("speed", 1.0, subject="1", trial=1)
    assert store.data("speed").count() == 1 and store.log().count() == 2
    assert store.records("speed", "all").count() == 1


def test_filters_across_levels(store):
    for s in (1, 2):
        store.save("height", 1.5 + s / 10, subject=s)
        for t in (1, 2):
            store.save("step", s + t / 10, subject=s, trial=t)
            store.save("side", "L" if t == 1 else "R", subject=s, trial=t)
    step, side, height = Variable("step"), Variable("side"), Variable("height")
    values = lambda where: sorted(v for _, _, v in store.load_all("step", where))
    assert values(side == "L") == [1.1, 2.1]
    assert values(height > 1.65) == [2.1, 2.2]
    assert values((side == "L") & (height > 1.65)) == [2.1]
    assert values((side == "L") | (height > 1.65)) == [1.1, 2.1, 2.2]
    assert values(~(side == "L")) == [1.2, 2.2]
    assert values(side.isin(["R"])) == [1.2, 2.2]
    assert values(raw_sql('"value" > 2')) == [2.1, 2.2]
    with pytest.raises(ValueError, match="finer"):
        store.load_all("height", step > 1)
    store.save("step", 9.0, subject=3, trial=1)
    with pytest.raises(ValueError, match="no value"):
        store.load_all("step", side == "L")


def test_null_comparisons_follow_the_table_rule(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None)], "id int, v double")
    ids = lambda tree: sorted(r[0] for r in df.where(table_condition(tree)).collect())
    assert ids(Col("v") == 1.0) == [1]
    assert ids(Col("v") != 1.0) == [2]
    assert ids(~(Col("v") == 1.0)) == [2]
    assert ids(Col("v").isin([])) == []


def test_for_each_saves_skips_and_keeps_lineage(spark, store):
    def double(x, factor):
        return float(x) * factor

    def total(x):
        return float(np.asarray(x["value"] if hasattr(x, "columns") else x).sum())

    df = spark.createDataFrame([(s, t, float(s * 10 + t)) for s in (1, 2) for t in (1, 2)], "subject int, trial int, value double")
    store.save_table("raw", df, ["value"])
    out = for_each(store, double, {"x": Variable("raw"), "factor": 2}, ["scaled"], ["subject", "trial"], "value double")
    assert sorted(r["value"] for r in out.collect()) == [22.0, 24.0, 42.0, 44.0]
    assert store.load("scaled", subject=2, trial=1) == 42.0
    again = for_each(store, double, {"x": Variable("raw"), "factor": 2}, ["scaled"], ["subject", "trial"], "value double", skip_computed=True)
    assert again.count() == 0
    arguments = (double, {"x": Variable("raw"), "factor": 2}, "scaled", ["subject", "trial"])
    assert [r["state"] for r in states(store, *arguments).collect()] == ["up_to_date"] * 4
    store.save_table("raw", spark.createDataFrame([(1, 1, 50.0), (3, 1, 0.0)], "subject int, trial int, value double"), ["value"])
    found = states(store, *arguments)
    assert sorted(r["state"] for r in found.collect()) == ["missing", "stale", "up_to_date", "up_to_date", "up_to_date"]
    assert state.node_states(found, "function_name").first()["state"] == "red"
    changed = for_each(store, double, {"x": Variable("raw"), "factor": 2}, ["scaled"], ["subject", "trial"], "value double", skip_computed=True)
    assert sorted(r["value"] for r in changed.collect()) == [0.0, 100.0]
    other = for_each(store, double, {"x": Variable("raw"), "factor": 3}, ["scaled"], ["subject", "trial"], "value double", skip_computed=True)
    assert other.count() == 5
    assert store.load("scaled", subject=2, trial=1, branch={"factor": 3}) == 63.0
    assert store.edges().count() == 11
    hashed = store.table("lineage").first()["lineage_hash"]
    assert store.find_by_lineage(hashed)
    walk = lineage.ancestors(store.edges())
    assert walk.count() == 11
    by_params = lineage.variant_edges(store.records("scaled").unionByName(store.records("raw")), spark.createDataFrame([("scaled", "raw")], "output string, input string"), ["subject", "trial"])
    assert by_params.count() == store.records("scaled").count()
    assert {r["variable_name"]: r["n_records"] for r in store.list_variants().collect()}["raw"] == 6
    summed = for_each(store, total, {"x": Variable("raw")}, ["sum"], ["subject"], "value double")
    assert {r["subject"]: r["value"] for r in summed.collect()} == {"1": 62.0, "2": 43.0, "3": 0.0}
    both = for_each(store, double, {"x": Fixed(Variable("raw"), trial=2), "factor": EachOf(1, 10)}, ["fixed"], ["subject"], "value double", save=False)
    assert sorted(r["value"] for r in both.collect()) == [12.0, 22.0, 120.0, 220.0]


def test_groups_sql_and_csv(spark, store, tmp_path):
    store.save("a", 1.0, subject=1)
    store.save("b", 2.0, subject=1)
    store.group("first", ["a", "b"])
    store.group("first", ["b"], present=False)
    assert store.group_members("first") == ["a"] and store.groups() == ["first"]
    assert [r["variable_name"] for r in store.list_variables().collect()] == ["a", "b"]
    rows = store.sql("SELECT a.value + b.value AS s FROM a JOIN b USING (subject) WHERE a.value < :most", most=5).collect()
    assert rows[0]["s"] == 3.0
    assert store.columns("a") == {"value": "double"} and store.summary().count() == 2
    store.save("t", pd.DataFrame({"v": [1.0, 2.0, 3.0]}), subject=1)
    assert [r["v"] for r in store.scan("t", rows=[0, 2]).orderBy("row_pos").collect()] == [1.0, 3.0]
    assert store.export_csv("a", str(tmp_path / "out")) == 1
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert {"_record_id", "_meta_subject", "value"} <= set(back.columns)
    with pytest.raises(ValueError):
        Store(spark, store.root, ["trial"])
    with pytest.raises(TypeError):
        Store(spark, store.root, {"subject", "trial"})


def test_version_keys_keep_their_types(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["subject"])
    kinds = [1, "1", 1.0, True, None, {"a": [1, "1"]}, "é\"x\\", "true"]
    for n, k in enumerate(kinds):
        store.save("v", float(n), subject=1, k=k)
    assert [store.load("v", subject=1, versions={"k": k}) for k in kinds] == [float(n) for n in range(len(kinds))]
    assert [store.load("v", subject=1, branch={"k": k}) for k in (1, "1")] == [0.0, 1.0]  # version keys come first
    assert store.records("v").count() == len(kinds)
    table = spark.createDataFrame([(2, 1, 5.0), (2, 2, 6.0)], "subject long, k long, value double")
    store.save_table("v", table, ["value"])
    store.save_table("v", table.withColumn("k", F.col("k").cast("string")).withColumn("value", F.col("value") + 10), ["value"])
    assert store.load("v", subject=2, versions={"k": 1}) == 5.0 and store.load("v", subject=2, versions={"k": "1"}) == 15.0
    assert store.list_variants().where("variable_name = 'v'").count() == len(kinds) + 2  # 2 and '2' more; 1 and '1' are there
    store.save("w", 1.0, {"f.low": 3, "g.high": "3"}, subject=1)
    assert store.load("w", subject=1, branch={"low": 3}) == 1.0 and store.load("w", subject=1, branch={"high": "3"}) == 1.0
    with pytest.raises(NotFound):
        store.load("w", subject=1, branch={"low": "3"})


def test_reads_of_records_are_pruned(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["subject"])
    store.save_table("v", spark.range(3000).select(F.col("id").alias("subject"), F.col("id").cast("double").alias("value")), ["value"])
    files = store.data("v").inputFiles()
    assert len({f.split("/shard=")[1][0] for f in files}) == 16
    rid = store.find_id("v", subject=7)
    plan = store.fetch("v", [rid])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard", plan) and re.search(rf"PushedFilters: \[[^\]]*record_id,\[?{rid}", plan)
    read = store.data("v").where((F.col("shard") == rid[0]) & (F.col("record_id") == rid)).select("_metadata.file_path").distinct().count()
    assert read == 1 < len(files)
    # Spark prunes shards at run time when the records come from the log
    assert "dynamicpruning" in store.scan("v", subject=7)._jdf.queryExecution().executedPlan().toString()
    assert store.load("v", subject=7) == 7.0 and sorted(v for _, v in store.load("v", subject=[7, 9])) == [7.0, 9.0]
    assert store.fetch("v", [rid, "no such"]).count() == 1


def test_saves_read_no_data_and_what_failed_is_never_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["subject"])
    table = spark.range(10).select(F.col("id").alias("subject"), F.col("id").cast("double").alias("value"))
    store.save_table("v", table, ["value"])
    torn = store.data("v").where("value < 5").select("record_id", "row_pos", F.lit("torn").alias("batch"), "value")
    store._add_data("v", torn)  # a writer that ended before its log rows
    assert store.scan("v").count() == 10 and store.data("v").count() == 15
    store.save_table("v", table, ["value"])  # the same content again: a log row, no data
    assert store.data("v").count() == 15 and store.scan("v").count() == 10 and store.log().count() == 20
    assert store.save("v", 3.0, subject=3) and store.save_batch("v", [(4.0, {"subject": 50}), (4.0, {"subject": 50})])
    assert store.scan("v", version="all").where("subject = '50'").count() == 1
