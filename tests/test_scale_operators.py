"""Interval joins, mergeable aggregates, table functions, drawn graphs, sketches and cancelling against plain versions."""

import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.operators import filters, intervals, mergeable
from keyloom.plans import drawn, foreach, lineage
from keyloom.plans.run import Variable, cancel, for_each, tagged
from keyloom.sources import table_functions
from keyloom.sources.paths import PathTemplate
from keyloom.sources.store import Store


def test_points_in_intervals_against_all_pairs(spark):
    random = np.random.default_rng(2)
    values = [*(random.choice([5.0, 7.0], 150).tolist()), *random.uniform(0, 20, 150).tolist(), None, float("nan")]  # two values hold half the rows
    points = [(i, v, int(i % 2)) for i, v in enumerate(values)] + [(0, values[0], 0)]
    spans = [(k, float(a), float(a + b), int(k % 2)) for k, (a, b) in enumerate(zip(random.uniform(-5, 20, 60), random.choice([0.0, 0.5, 3.0, 40.0], 60)))] + [(90, 5.0, 7.0, 0), (91, 7.0, 5.0, 0), (92, None, 5.0, 1), (93, 5.0, 7.0, None)]
    p = spark.createDataFrame(points, "i long, v double, side int").repartition(3)
    s = spark.createDataFrame(spans, "k long, a double, b double, side int")
    for closed in (False, True):
        want = sorted((i, k) for i, v, x in points for k, a, b, y in spans if None not in (v, a) and x == y and a <= v and (v <= b if closed else v < b))
        found = intervals.points_in_intervals(p, s, "v", "a", "b", ["side"], closed, bins=16)
        assert sorted((r["i"], r["k"]) for r in found.collect()) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and set(found.columns) == {"i", "v", "side", "k", "a", "b"}
    assert intervals.points_in_intervals(p.limit(0), s, "v", "a", "b", ["side"]).count() == intervals.points_in_intervals(p, s.limit(0), "v", "a", "b", ["side"]).count() == 0


def test_sums_in_intervals_make_no_pairs(spark):
    random = np.random.default_rng(4)
    values = [*(random.choice([5.0, 7.0, -0.0], 150).tolist()), *random.uniform(0, 20, 150).tolist(), None, float("nan")]
    points = [(v, int(i), i % 2 if i % 9 else None) for i, v in enumerate(values)] + [(5.0, None, 0), (5.0, 2**62, 0), (6.0, 2**62, 0), (6.0, 2**62, 0)]
    odd = [(5.0, 7.0, 0), (5.0, 7.0, 0), (7.0, 5.0, 0), (5.0, 5.0, 0), (None, 5.0, 1), (1.0, float("nan"), 1), (float("nan"), float("nan"), 1), (5.0, 7.0, None), (90.0, 95.0, 1), (0.0, 99.0, 7)]
    spans = [(float(a), float(a + b), int(k % 2)) for k, (a, b) in enumerate(zip(random.uniform(-5, 20, 60), random.choice([0.0, 0.5, 3.0, 40.0], 60)))] + odd
    p = spark.createDataFrame(points, "v double, w long, side int").repartition(3)
    s = spark.createDataFrame([(k, *x) for k, x in enumerate(spans)], "k long, a double, b double, side int")
    for by in (["side"], []):
        for closed in (False, True):
            want = []
            for k, (a, b, y) in enumerate(spans):
                held = [w for v, w, x in points if None not in (v, a) and (not by or None not in (x, y) and x == y) and b == b and a <= v and (v <= b if closed else v < b)]
                want.append((k, len(held), sum(w or 0 for w in held)))
            found = intervals.sums_in_intervals(p if by else p.drop("side"), s, "v", "a", "b", {"total": "w"}, by, closed, bins=16)
            assert sorted((r["k"], r["n"], int(r["total"])) for r in found.collect()) == want and found.columns == [*s.columns, "n", "total"]
    assert intervals.sums_in_intervals(p.limit(0), s, "v", "a", "b").agg(F.sum("n")).first()[0] == 0 and intervals.sums_in_intervals(p, s.limit(0), "v", "a", "b").count() == 0
    with pytest.raises(TypeError):
        intervals.sums_in_intervals(p, s, "v", "a", "b", {"total": "v"})
    # a hundred million pairs
    many, wide = spark.range(20_000).select("id", F.col("id").alias("w")), spark.range(5_000).select("id", (F.col("id") % 7 - 9).alias("a"), (F.col("id") % 7 + 20_000).alias("b"))
    found = intervals.sums_in_intervals(many.withColumnRenamed("id", "v"), wide, "v", "a", "b", {"total": "w"})
    assert found.groupBy("n", "total").count().collect() == [(20_000, sum(range(20_000)), 5_000)]
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_times_without_a_zone_keep_their_order_where_a_zone_skips_an_hour(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = lambda minute: f"2021-03-14 {minute // 60:02}:{minute % 60:02}:00"
        p = spark.createDataFrame([(m, at(m)) for m in range(60, 300, 5)], "m int, t string").select("m", F.col("t").cast("timestamp_ntz").alias("v"))
        s = spark.createDataFrame([(k, at(a), at(b)) for k, (a, b) in enumerate([(100, 170), (125, 181), (130, 250)])], "k int, a string, b string").select("k", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
        want = [(0, 14), (1, 12), (2, 24)]
        assert sorted((r["k"], r["count"]) for r in intervals.points_in_intervals(p, s, "v", "a", "b", bins=16).groupBy("k").count().collect()) == want
        assert sorted((r["k"], r["n"]) for r in intervals.sums_in_intervals(p, s, "v", "a", "b", bins=16).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_overlaps_against_all_pairs(spark):
    random = np.random.default_rng(3)
    make = lambda n: [(i, int(a), int(a + b)) for i, (a, b) in enumerate(zip(random.integers(0, 40, n), random.integers(0, 6, n)))] + [(n, None, 3), (n + 1, 0, 100)]
    left, right = make(60), make(60)
    found = intervals.overlaps(spark.createDataFrame(left, "l long, a long, b long"), spark.createDataFrame(right, "r long, c long, d long"), ("a", "b"), ("c", "d"), bins=8)
    want = sorted((x, y) for x, a, b in left for y, c, d in right if None not in (a, c) and max(a, c) < min(b, d))
    assert sorted((r["l"], r["r"]) for r in found.collect()) == want


def moments():
    class Moments(mergeable.Mergeable):
        def start(self):
            return 0, 0.0

        def update(self, state, rows):
            return state[0] + len(rows), state[1] + float(rows["v"].sum())

        def merge(self, one, other):
            return one[0] + other[0], one[1] + other[1]

        def finish(self, state):
            return state if state[0] else None

    return Moments()  # inside, so that it is shipped by value


def test_mergeable_aggregates_combine_before_the_shuffle(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i % 2, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, b int, v double").repartition(9)
    want = {}
    for a, b, v in rows:
        n, s = want.get((a, b), (0, 0.0))
        want[a, b] = n + 1, s + v
    for settings in ({}, {"fan": 2, "held": 1}):  # four rounds, states handed on after every batch
        got = mergeable.aggregate(df, ["a", "b"], moments(), "n long, s double", **settings)
        assert {(r["a"], r["b"]): (r["n"], r["s"]) for r in got.collect()} == want and got.columns == ["a", "b", "n", "s"]
    assert tuple(mergeable.aggregate(df.select("v"), [], moments(), "n long, s double").first()) == (400, sum(v for _, _, v in rows))
    assert mergeable.aggregate(df.limit(0), ["a", "b"], moments(), "n long, s double").collect() == []
    assert [tuple(r) for r in mergeable.aggregate(df.select("v").limit(0), [], moments(), "n long, s double").collect()] == [(None, None)]
    some = foreach.for_each(moments(), {"x": df.select("a", "v")}, ["a"], combos=spark.createDataFrame([("k1",), ("none",)], "a string"), schema="n long, s double")
    assert [r["a"] for r in some.collect()] == ["k1"]


def test_table_functions_in_sql(spark):
    spark.createDataFrame([("x", 3), ("x", 1), ("y", 2), (None, 5)], "k string, v long").createOrReplaceTempView("Numbers")
    table_functions.register(spark, "gaps", lambda rows, least: pd.DataFrame({"gap": rows["v"].diff().dropna().astype("int64")}).query("gap >= @least"), "gap long", ["k"])
    assert [tuple(r) for r in spark.sql("SELECT k, gap FROM gaps(rows => TABLE(Numbers) PARTITION BY k ORDER BY v, least => 1)").collect()] == [("x", 2)]
    assert spark.sql("SELECT * FROM gaps(rows => TABLE(SELECT * FROM Numbers WHERE false) PARTITION BY k, least => 1)").collect() == []
    table_functions.register(spark, "largest", lambda rows: pd.DataFrame({"v": [rows["v"].max()]}), lambda kind: type(kind)([kind["v"]]), ["k"])
    assert sorted((r["k"] or "", r["v"]) for r in spark.sql("SELECT * FROM largest(TABLE(Numbers) PARTITION BY k)").collect()) == [("", 5), ("x", 3), ("y", 2)]
    with pytest.raises(Exception, match="needs the columns"):
        spark.sql("SELECT * FROM largest(TABLE(SELECT v FROM Numbers) PARTITION BY v)").collect()


def test_raw_sql_keeps_quotes_within_texts(spark):
    df = spark.createDataFrame([('a"b', 1), ("it's", 2), ("c", 3)], "`a col` string, v long")
    found = lambda text: sorted(r["v"] for r in df.where(filters.raw_sql(text).condition()).collect())
    assert found("\"a col\" = 'a\"b'") == [1] and found("\"a col\" = 'it''s' OR v = 3") == [2, 3] and found("\"v\" > 1 AND \"a col\" <> '\"c\"'") == [2, 3]


def test_filters_under_or_and_not_mean_locations(spark):
    from keyloom.schema import DatasetSchema

    target = spark.createDataFrame([("1", "a", 1.0), ("1", "a", 9.0), ("1", "b", 2.0), ("2", "a", 3.0), (None, "a", 9.0)], "s string, t string, value double")
    side = spark.createDataFrame([("1", "L"), ("2", "R")], "s string, value string")
    values = {"Side": (side, ["s"])}.__getitem__
    big, left = filters.Compare(None, "value", ">", 5.0), filters.Compare("Side", "value", "==", "L")
    passed = lambda tree: sorted(str((r["s"], r["t"], r["value"])) for r in filters.resolve(tree, target, DatasetSchema(["s", "t"]), values, validate=False).collect())
    row = lambda *rows: sorted(str(r) for r in rows)
    assert passed(big) == row(("1", "a", 9.0), (None, "a", 9.0))  # rows
    assert passed(big | big) == row(("1", "a", 1.0), ("1", "a", 9.0), (None, "a", 9.0))  # locations that have such a row
    assert passed(~(left & big)) == row(("1", "b", 2.0), ("2", "a", 3.0), (None, "a", 9.0))
    assert passed(left | big) == row(("1", "a", 1.0), ("1", "a", 9.0), ("1", "b", 2.0), (None, "a", 9.0))
    assert passed(~left & ~big) == row(("2", "a", 3.0))


def test_best_parents_are_the_largest_part(spark):
    record = lambda i, p, s="1": (i, "In", p, s)
    records = spark.createDataFrame(
        [record("r0", {}), record("r00", {}), record("r1", {"f.a": "1"}), record("r2", {"f.a": "1", "f.b": '"x"'}), record("r3", {"f.a": "1", "f.b": "2"}), record("r4", {"f.a": "1"}, "2"), record("r5", {"f.a": '"1"'}), record("n", {"f.a": "1"}, None)],
        "record_id string, variable_name string, params map<string,string>, s string",
    )
    child = lambda i, own, s="1": (i, "x", "In", own, s)
    children = spark.createDataFrame(
        [child("a", {"f.a": "1", "f.b": '"x"', "g.c": "3"}), child("b", {"f.a": "1"}), child("c", {}), child("d", {"f.a": "9"}, "2"), child("e", {"f.a": '"1"', "f.b": "2"}), child("f", {"f.a": "1"}, None)],
        "child string, param string, input string, own map<string,string>, s string",
    )
    assert {r["child"]: r["parent"] for r in lineage.best_parents(children, records, ["s"]).collect()} == {"a": "r2", "b": "r1", "c": "r00", "e": "r5", "f": "n"}


def test_outdated_goes_down_any_graph(spark):
    random = np.random.default_rng(5)
    pairs = [(f"n{a}", f"n{b}") for a, b in random.integers(0, 30, (40, 2))]  # cycles too
    stale = ["n3", "n7", "none"]
    want, front = set(), set(stale)
    for _ in range(3):
        front = {c for c, p in pairs if p in front} - want
        want |= front
    found = lineage.outdated(spark.createDataFrame(pairs, "child string, parent string"), spark.createDataFrame([(s,) for s in stale], "record_id string"), hops=3)
    assert {r["node"] for r in found.collect()} == want and found.count() == len(want)


def test_paths_are_read_back_from_their_text():
    for p in (PathTemplate("{s}/{t}.csv", "raw"), PathTemplate("it's {s}")):
        for text in (p.key(), f"PathTemplate({p.template!r}, {p.root!r})"):
            back = PathTemplate.parse(text)
            assert (back.template, back.root, back.fields) == (p.template, p.root, p.fields)
    assert [PathTemplate.parse(t) for t in ("Balance", '{"a": 1}', "{s}", "PathTemplate(open('x'))", "f(")] == [None] * 5


def test_drawn_graph_survives_and_graduates(spark, tmp_path):
    nodes = lambda *rows: spark.createDataFrame(list(rows), "id string, type string, label string")
    graph = drawn.DrawnGraph(Store(spark, str(tmp_path / "s"), ["k"]))
    assert graph.nodes().count() == graph.edges().count() == 0
    graph.add_nodes(nodes(("a", "function", "A"), ("b", "variable", "B"), ("c", "variable", "C")))
    graph.configure(spark.createDataFrame([("a", '{"x": 1}'), ("zz", "{}")], "id string, config string"))
    graph.add_edges(spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "a")], "id string, source string, target string"))
    graph.graduate(spark.createDataFrame([("a", "fn:a")], "old string, new string"))
    graph.delete_nodes(spark.createDataFrame([("c",)], "id string"))
    again = drawn.DrawnGraph(Store(spark, str(tmp_path / "s"), ["k"]))
    assert [tuple(r) for r in again.nodes().collect()] == [("b", "variable", "B", None)]
    assert sorted((r["id"], r["source"], r["target"]) for r in again.edges().collect()) == [("e1", "fn:a", "b"), ("e2", "fn:a", "fn:a")]


def test_sketches_add_up_over_saves(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"])
    table = spark.range(4000).select((F.col("id") % 40).alias("k"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    for part in (table.where("k < 10"), table.where("k >= 10"), table.where("k >= 10")):  # the last adds nothing
        store.save_table("x", part, ["v"], order=["v"], sketched=("v",))
    (r,) = store.sketch_summary("x").collect()
    values = np.sort([x["v"] for x in table.where("v IS NOT NULL").collect()])
    assert (r["n"], r["least"], r["most"]) == (len(values), values[0], values[-1])
    assert abs(r["distinct_values"] / len(set(values)) - 1) < 0.05
    for share, q in zip((0.25, 0.5, 0.75), r["quantiles"]):
        assert abs(np.searchsorted(values, q) / len(values) - share) < 0.04


def test_a_cancelled_run_leaves_no_record(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ["k"])
    store.save_table("raw", spark.range(40).select(F.col("id").alias("k"), F.col("id").cast("double").alias("value")), ["value"])
    done, failed = spark.sparkContext.accumulator(0), []

    def slow(x):
        time.sleep(0.3)
        return float(x)

    def work():
        try:
            with tagged(spark, "slow-run"):
                for_each(store, slow, {"x": Variable("raw")}, ["out"], ["k"], "value double", progress=done)
        except Exception as e:
            failed.append(e)

    thread = threading.Thread(target=work)
    thread.start()
    until = time.time() + 60
    while thread.is_alive() and time.time() < until:
        time.sleep(0.5)
        cancel(spark, "slow-run")
    thread.join(30)
    assert failed and store.log().where("variable_name = 'out'").count() == 0
    counted = spark.sparkContext.accumulator(0)
    for_each(store, lambda x: float(x) + 1, {"x": Variable("raw")}, ["out"], ["k"], "value double", progress=counted)
    assert counted.value == 40 and store.load("out", k=3) == 4.0


def test_streamed_inputs_are_whole_and_in_order(spark):
    """A table in pieces is the table in one, whatever its keys; other inputs come whole; what lacks one is left out."""
    random = np.random.default_rng(8)
    trials = {"a": ["2", "10", "9", "1"], "b": ["2", "10", "x", "1"], "c": ["9007199254740993", "9007199254740992", "-1", "1000"], "d": ["1"], None: ["3", None, "20"]}
    rows = [(s, t, p, float(p), f"{s}-{t}-{p}") for s, ts in trials.items() for t in ts for p in range(int(random.integers(1, 90)))]
    rows = [rows[i] for i in random.permutation(len(rows))]
    x = spark.createDataFrame(rows, "subject string, trial string, row_pos int, v double, w string").repartition(3)
    y = spark.createDataFrame([(s, i, i * 2) for s in ("a", "b", "c", "e") for i in (2, 1, 0)], "subject string, row_pos int, u int")

    def whole(x, y=None):
        return x.to_json(), len(x), None if y is None else str(y.tolist())

    def pieces(x, y=None):
        found = list(x)
        return pd.concat(found, ignore_index=True).to_json(), max(map(len, found)), None if y is None else str(y.tolist())

    options = dict(schema="rows string, most int, y string", output_names=["rows", "most", "y"], dataset=["subject", "trial"], order=["row_pos"], errors="raise")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for inputs in ({"x": x}, {"x": x, "y": y}, {"y": y, "x": x}):
            combos = x.select("subject").distinct()
            want = {r["subject"]: r for r in foreach.for_each(whole, inputs, ["subject"], combos, **options).collect()}
            got = {r["subject"]: r for r in foreach.for_each(pieces, inputs, ["subject"], combos, streamed="x", **options).collect()}
            assert got.keys() == want.keys() and len(want) == (4 if "y" not in inputs else 3) + (None in want)
            assert all((r["rows"], r["y"]) == (want[s]["rows"], want[s]["y"]) and r["most"] <= 16 for s, r in got.items())
            assert max(r["most"] for r in want.values()) > 100
        # a function that stops early, one that fails midway, one column
        first = foreach.for_each(lambda x: next(x)["w"].iloc[0], {"x": x}, ["subject"], schema="value string", streamed="x", dataset=["subject", "trial"], order=["row_pos"])
        assert {r["subject"]: r["value"] for r in first.where("subject IS NOT NULL").collect()} == {"a": "a-1-0", "b": "b-1-0", "c": "c--1-0", "d": "d-1-0"}

        def fails(x):
            for piece in x:
                if piece[0] > 0:
                    raise ValueError("midway")
            return 1

        odd = foreach.for_each(fails, {"x": foreach.ColumnSelection(x, "row_pos", "v")}, ["subject"], schema="value int", streamed="x", errors="column", dataset=["subject", "trial"], order=["row_pos"])
        assert {r["subject"]: r["error"] for r in odd.collect() if r["subject"] in "abc"} == {s: "ValueError: midway" for s in "abc"}
        learnt = foreach.for_each(lambda x: sum(len(p) for p in x), {"x": x.where("subject IS NOT NULL")}, ["subject"], streamed="x", order=["row_pos"])
        assert {r["subject"]: r["value"] for r in learnt.collect()}["a"] == sum(s == "a" for s, *_ in rows)
        with pytest.raises(ValueError):
            foreach.for_each(fails, {"x": x, "k": 1}, ["subject"], schema="value int", streamed="k")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
