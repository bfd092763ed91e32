import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from keyloom.constant import Constant, plain_value
from keyloom.functions import hashing, jsonmaps, keys
from keyloom.operators import combos, latest, tables
from keyloom.operators.filters import Col
from keyloom.plans import graph, lineage, state
from keyloom.plans.foreach import ColName, ColumnSelection, EachOf, Fixed, Merge, for_each
from keyloom.schema import DatasetSchema
from keyloom.sources.paths import PathTemplate


def test_keys_are_texts(spark):
    assert [keys.norm_key_value(v) for v in (1.0, 1, "01", 1.5)] == ["1", "1", "01", "1.5"]
    assert [keys.typed_key_value(v) for v in ("1", "01", "1.5", "a")] == [1, "01", 1.5, "a"]
    df = keys.norm_keys(spark.createDataFrame([(1.0, 2), (1.5, 3)], "a double, b int"), ["a", "b"])
    assert [tuple(r) for r in df.collect()] == [("1", "2"), ("1.5", "3")]
    schema = DatasetSchema(["subject", "session", "trial"])
    assert schema.level(["trial", "subject"]) == "trial" and schema.below(["subject"]) == "session" and schema.below(["trial"]) is None
    with pytest.raises(TypeError):
        DatasetSchema({"a", "b"})


def test_hashes_agree_with_the_jvm(spark):
    assert hashing.canonical_hash(42) == "73475cb40a568e8d"
    row = spark.range(1).select(hashing.content_digest(F.lit(42), "int").alias("i"), hashing.content_digest(F.lit(True), "boolean").alias("b")).first()
    assert row["i"] == hashing.canonical_hash(42) and row["b"] == hashing.canonical_hash(True)
    table = pd.DataFrame({"a": ["x", "y"], "b": [1, None]}, dtype=object)
    assert hashing.canonical_hash(table) == hashing.canonical_hash(table.copy(deep=True)) != hashing.canonical_hash(table.iloc[::-1])


def test_json_maps(spark):
    df = spark.createDataFrame([('{"f.low": "1", "g.low": "2", "h.n": "3"}',)], "p string").select(jsonmaps.as_map(F.col("p")).alias("m"))
    row = df.select(
        jsonmaps.suffix_matches(F.col("m"), "n").alias("n"), F.size(jsonmaps.suffix_matches(F.col("m"), "low")).alias("k"), jsonmaps.canonical_map(jsonmaps.without_keys(F.col("m"), "h.n")).alias("c"),
        jsonmaps.variant_label(F.col("m")).alias("l"),
    ).first()
    assert row["n"] == {"h.n": "3"} and row["k"] == 2 and row["c"] == '{"f.low":"1","g.low":"2"}' and row["l"] == "low=1, low=2, n=3"


def test_paths(spark, tmp_path):
    template = PathTemplate("{subject}/x/{subject}_{session}.csv", str(tmp_path))
    for s, t in ((1, "a"), (2, "b")):
        (tmp_path / f"{s}/x").mkdir(parents=True)
        (tmp_path / f"{s}/x/{s}_{t}.csv").write_text("v")
    (tmp_path / "1/x/9_z.csv").write_text("differs")
    got = [(r["subject"], r["session"]) for r in template.discover(spark).collect()]
    assert got == [("1", "a"), ("2", "b")]
    assert template.path(subject=1, session="a").endswith("/1/x/1_a.csv")
    assert [k for _, k in PathTemplate("{a}{b}").product(a=[1, 2], b=[3])] == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


DATASET = ["subject", "session"]


@pytest.fixture
def gait(spark):
    return spark.createDataFrame([(1, "pre", 1.0), (1, "post", 2.0), (2, "pre", 3.0), (2, "post", 5.0)], "subject int, session string, emg double")


def test_for_each_scalar_fixed_and_filter(gait):
    base = lambda x, b: x - b
    out = for_each(base, {"x": gait, "b": Fixed(gait, session="pre")}, ["subject", "session"], schema="value double")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "post", 1.0), (1, "pre", 0.0), (2, "post", 2.0), (2, "pre", 0.0)]
    out = for_each(lambda x: float(x.sum()), {"x": gait}, ["subject"], where=Col("emg") > 1.0, dataset=DATASET)
    assert {r["subject"]: r["value"] for r in out.collect()} == {1: 2.0, 2: 8.0}
    native = for_each({"m": F.max("emg")}, {"x": gait}, ["subject"])
    assert {r["subject"]: r["m"] for r in native.collect()} == {1: 2.0, 2: 5.0}


def test_for_each_merge_select_and_constants(spark, gait):
    force = spark.createDataFrame([(1, 10.0), (2, 20.0)], "subject int, force double")
    emg = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "subject int, pos int, emg double")
    out = for_each(lambda t: float((t["force"] * t["emg"]).sum()), {"t": Merge(force, emg, order=["pos"])}, ["subject"], schema="value double")
    assert {r["subject"]: r["value"] for r in out.collect()} == {1: 30.0, 2: 60.0}
    out = for_each(lambda x, k, n: float(x.max()) * k if n == "emg" else None, {"x": ColumnSelection(gait, "emg"), "k": EachOf(1, 2), "n": ColName(gait)}, ["subject"], schema="value double", dataset=DATASET)
    assert sorted((r["subject"], r["k"], r["value"]) for r in out.collect()) == [(1, "1", 2.0), (1, "2", 4.0), (2, "1", 5.0), (2, "2", 10.0)]
    with pytest.raises(TypeError):
        Fixed(Merge(force, emg), subject=1)
    with pytest.raises(KeyError):
        for_each(len, {"x": ColumnSelection(gait, "no")}, ["subject"])
    with pytest.raises(KeyError):
        tables.merge_positional([force, force], ["subject"], [["force"], ["force"]])
    three = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "subject int, other double")
    with pytest.raises(Exception, match="differ"):
        tables.merge_positional([emg.drop("pos"), three], ["subject"], [["emg"], ["other"]]).collect()


def test_for_each_errors_outputs_and_distribute(gait):
    def fails(x):
        if float(x.sum()) > 5:
            raise ValueError("too large")
        return float(x.sum()), len(x)

    two = for_each(fails, {"x": gait}, ["subject"], schema="total double, n long", output_names=["total", "n"], dataset=DATASET)
    assert [tuple(r) for r in two.collect()] == [(1, 3.0, 2)]
    told = for_each(fails, {"x": gait}, ["subject"], schema="total double, n long", output_names=["total", "n"], dataset=DATASET, errors="column")
    assert {r["subject"]: r["error"] for r in told.collect()}[2] == "ValueError: too large"
    with pytest.raises(PythonException):
        for_each(fails, {"x": gait}, ["subject"], schema="total double, n long", output_names=["total", "n"], dataset=DATASET, errors="raise").collect()
    split = for_each(lambda x: [float(v) for v in sorted(x.ravel())], {"x": gait}, ["subject"], schema="value double", distribute="trial", dataset=DATASET)
    assert sorted(tuple(r) for r in split.collect()) == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 5.0)]
    table = for_each(lambda x: x.assign(twice=x["emg"] * 2)[["twice"]], {"x": gait}, ["subject"], as_table=True, dataset=DATASET)
    assert sorted(tuple(r) for r in table.collect()) == [(1, 2.0), (1, 4.0), (2, 6.0), (2, 10.0)]


def test_latest_plan_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 2, 3)], "k int, t int, id int")
    got = latest.latest(df, ["k"], "t", "id")
    assert [r["id"] for r in got.collect()] == [3]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_states_go_through_chains_and_cycles_of_any_length(spark):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(60)]
    cycle = [(f"c{i}", f"c{(i + 1) % 55}") for i in range(55)] + [("below", "c0"), ("under", "below"), ("self", "self")]
    edges = spark.createDataFrame(chain + cycle + [("x", "unnamed")], "child string, parent string")
    names = [f"n{i}" for i in range(61)] + [f"c{i}" for i in range(55)] + ["below", "under", "self", "x", "alone"]
    own = spark.createDataFrame([(n, "grey" if n == "n0" else "red" if n == "n3" else "green") for n in names], "node string, state string")
    got = {r["node"]: r["effective"] for r in graph.propagate(own.coalesce(1), edges.coalesce(1)).collect()}
    assert got == {n: "grey" if n in ("n0", "n1", "n2") else "green" if n in ("x", "alone") else "red" for n in names}


def test_states_and_graph(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("y", "x")], "child string, parent string")
    walk = {(r["node"], r["ancestor"]): r["hops"] for r in lineage.ancestors(edges, 10).collect()}
    assert walk[("c", "a")] == 2 and walk[("x", "x")] == 2
    own = spark.createDataFrame([("a", "grey"), ("b", "green"), ("c", "green"), ("d", "green"), ("x", "green")], "node string, state string")
    got = {r["node"]: r["effective"] for r in graph.propagate(own, edges, spark.createDataFrame([("d",)], "node string")).collect()}
    assert got == {"a": "grey", "b": "grey", "c": "grey", "d": "grey", "x": "red", "y": "red"}
    states = spark.createDataFrame([("f", "up_to_date"), ("f", "missing"), ("g", "stale"), ("h", "missing")], "fn string, state string")
    assert {r["node"]: r["state"] for r in state.node_states(states, "fn").collect()} == {"f": "grey", "g": "red", "h": "red"}
    variants = spark.createDataFrame([("f", "Out", {"x": "In"}, {"k": "1"}, 4), ("f", "Out", {"x": "In"}, {"k": "2"}, 2)], "function_name string, output string, inputs map<string,string>, constants map<string,string>, record_count int")
    nodes, links = graph.nodes_and_edges(variants)
    assert {tuple(r) for r in nodes.collect()} == {("f", "function"), ("Out", "variable"), ("In", "variable"), ("k", "constant")}
    assert {tuple(r) for r in links.collect()} == {("In", "f"), ("f", "Out"), ("k", "f")}
    assert graph.filter_variants(variants, {"k": "2"}).count() == 1 and graph.filter_variants(variants, {"k": "7"}).count() == 2
    pending = spark.createDataFrame([("k", "1"), ("k", "9")], "constant string, value string")
    assert [tuple(r) for r in graph.pending_constants(pending, variants).collect()] == [("k", "9")]


def test_combos(spark, gait):
    wanted = combos.product(spark, {"subject": [1, 2.0, 3], "session": ["pre"]})
    present = keys.norm_keys(gait, ["subject"])
    assert combos.existing(wanted, present, ["subject", "session"]).count() == 2
    assert [r["subject"] for r in combos.missing(wanted, present, ["subject", "session"]).collect()] == ["3"]
    with pytest.raises(ValueError):
        combos.distinct_from([gait], "no")


def test_traced_calls_know_their_inputs():
    @lineage.lineage_function
    def add(x, k):
        return x + k

    @lineage.lineage_function(unpack=True)
    def halves(x):
        return x / 2, x / 2

    assert add(1, 2) == 3
    one = add.trace(1, k=Constant(2))
    assert one.data == 3 and one.hash == add.trace(1, 2).hash != add.trace(1, 3).hash
    a, b = halves.trace(one)
    assert a.data == 1.5 and a.hash != b.hash and a.made_by is b.made_by
    assert [i["kind"] for i in a.made_by.classified()] == ["result"] and [i["kind"] for i in one.made_by.classified()] == ["constant", "constant"]
    assert [i["kind"] for i in add.trace(np.ones(2), lineage.Saved(1.0, "r1", "raw")).made_by.classified()] == ["record", "raw"]
    assert [e["function_name"] for e in a.upstream()] == ["halves", "add"]
    edited = lineage.manual(2.0, "clip", "an outlier", a)
    assert [e["function_name"] for e in edited.upstream()] == ["manual:clip", "halves", "add"]
    with pytest.raises(TypeError):
        add.trace(1)
    with pytest.raises(ValueError):
        lineage.manual(1, "clip", "")


def test_constants_compute_like_their_values():
    low = Constant(20, "Hz")
    assert low + 1 == 21 and 2 * low == 40 and low > 10 and low == Constant(20) and f"{low}" == "20" and low.bit_length() == 5
    assert Constant([1, 2])[1] == 2 and len(Constant([1, 2])) == 2 and 1 in Constant([1]) and bool(Constant(0)) is False
    assert plain_value({"a": [low]}) == {"a": [20]} and __file__ in low.line
    with pytest.raises(TypeError):
        Constant(low)


def test_hashing_of_unknown_objects_is_an_error():
    with pytest.raises(TypeError):
        hashing.canonical_hash(object())
    assert hashing.canonical_hash({"a": 1, "b": [2]}) == hashing.canonical_hash({"b": [2], "a": 1}) != hashing.canonical_hash({"a": 1, "b": (2,)})
    assert hashing.canonical_hash(["ab", "c"]) != hashing.canonical_hash(["a", "bc"]) and hashing.canonical_hash(np.float64(1.5)) == hashing.canonical_hash(1.5)


def test_rows_reach_the_function_in_order(spark):
    rows = [(s, str(t), p, float(100 * s + 10 * t + p)) for s in (1, 2) for t in range(1, 12) for p in range(3)]
    df = spark.createDataFrame(rows, "s int, t string, row_pos int, v double").repartition(5)
    other = df.withColumnRenamed("v", "w")
    few = spark.createDataFrame([(7.0,)], "k double")
    got = for_each(lambda x, y, k: (x["v"].tolist() == sorted(x["v"]) and y["w"].tolist() == x["v"].tolist(), float(k)), {"x": df, "y": other, "k": few}, ["s"], schema="same boolean, k double", output_names=["same", "k"], order=["row_pos"], as_table=["x", "y"], dataset=["s", "t"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, True, 7.0), (2, True, 7.0)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()  # which adaptive execution leaves as it is


def test_paths_keys_and_observation_of_calls(spark, gait):
    seen = Observation()
    out = for_each(lambda x, p, subject: f"{p}:{subject}:{len(x)}", {"x": gait, "p": PathTemplate("{subject}.csv", "/raw")}, ["subject"], schema="value string", keys_as_arguments=True, dataset=DATASET, observation=seen)
    assert sorted(r["value"] for r in out.collect()) == ["/raw/1.csv:1:2", "/raw/2.csv:2:2"]
    assert seen.get["rows"] == 2


def test_order_of_combinations(spark):
    df = spark.createDataFrame([("2", "a", 1), ("10", "a", 2), ("1", "b", 3), ("2", "a", 4)], "k string, g string, pos int")
    assert [r["k"] for r in combos.in_schema_order(df.select("k").distinct(), ["k"]).collect()] == ["1", "2", "10"]
    assert [r["pos"] for r in combos.first_seen(df, ["k", "g"], "pos").collect()] == [1, 2, 3]


def test_variant_tools_of_the_graph(spark):
    variants = spark.createDataFrame([(1, "f", "A", {"low": "1"}, 3), (2, "f", "A", {"low": "2"}, 1), (3, "f", "A", {"low": "1"}, 9)], "pos int, function_name string, output string, constants map<string,string>, record_count long")
    assert [r["pos"] for r in graph.dedupe_by_constants(variants, "pos").collect()] == [1, 2]
    assert graph.filter_variants(variants, {"low": "2"}).count() == 1 and graph.filter_variants(variants, {"low": "7"}).count() == 3
    pending = spark.createDataFrame([("low", "2"), ("low", "5"), ("high", "9")], "constant string, value string")
    merged = graph.merge_pending(variants.drop("pos"), pending)
    assert sorted((r["constants"].get("low"), r["constants"].get("high"), r["record_count"]) for r in merged.collect() if r["record_count"] == 0) == [("1", "9", 0), ("2", "9", 0), ("5", None, 0)]
    nodes = spark.createDataFrame([("f", "function"), ("A", "variable"), ("B", "variable"), ("k", "constant")], "id string, kind string")
    edges = spark.createDataFrame([("A", "f", "y"), ("k", "f", None), ("B", "f", None), ("f", "A", None)], "source string, target string, handle string")
    signature = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("f", 2, "z")], "function_name string, position int, param string")
    assert sorted((r["param"], r["source"], r["kind"]) for r in graph.resolve_edges(edges, nodes, signature).collect()) == [("x", "B", "variable"), ("y", "A", "variable"), ("z", "k", "constant")]
    placed = spark.createDataFrame([("A", "variable"), ("New", "variable")], "id string, kind string")
    assert [r["id"] for r in graph.merge_nodes(nodes, placed).where("manual").collect()] == ["New"] and [r["id"] for r in graph.graduated(nodes, placed).collect()] == ["A"]
    log = spark.createDataFrame([("1", "a"), ("2", None)], "subject string, session string")
    values = graph.key_values(log, ["subject", "session"], "session", {"subject": [2]})
    assert [r[0] for r in values["subject"].collect()] == ["2"] and values["session"].count() == 1
    assert graph.where_of([]) is None and graph.where_of([{"variable": "A", "op": ">", "value": 1}]).op == ">"
    assert len(graph.where_of([{"variable": "A", "op": "IN", "value": [1]}, {"variable": "B", "op": "==", "value": 2}]).options) == 2



def test_latest_stream(spark, tmp_path):
    from keyloom.streaming.latest import keep_latest

    log, target, marks = (str(tmp_path / n) for n in ("log", "latest", "marks"))
    schema = "k int, t int, id int"
    for n, rows in enumerate([[(1, 1, 1), (2, 1, 2)], [(1, 2, 3)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(log)
        keep_latest(spark, log, schema, target, ["k"], "t", "id", marks).awaitTermination()
        got = sorted(r["id"] for r in spark.read.parquet(f"{target}/{n}").collect())
    assert got == [2, 3]


def test_published_stream(spark, tmp_path):
    """Late, tied, null and repeated rows, over batches and a restart; a batch writes only what it changes."""
    from keyloom.streaming.latest import publish_latest, published

    log, target, marks = (str(tmp_path / n) for n in ("log", "out", "marks"))
    schema = "k int, t int, id int, m map<string,int>"
    saves = [[(1, 5, 1, {"a": 1}), (2, 1, 2, None), (None, 1, 3, {})], [(1, 4, 4, None), (2, 1, 5, {"b": 2}), (2, None, 6, None)], [(1, 5, 1, {"a": 1}), (3, None, 7, None)]]
    for rows in saves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        publish_latest(spark, log, schema, target, ["k"], "t", "id", marks, 1).awaitTermination()
    got = {r["k"]: (r["t"], r["id"], r["m"]) for r in published(spark, target, ["k"], "t", "id").collect()}
    assert got == {1: (5, 1, {"a": 1}), 2: (1, 5, {"b": 2}), None: (1, 3, {}), 3: (None, 7, None)}
    last = spark.read.parquet(f"{target}/batch=2")
    assert {r["k"] for r in last.collect()} == {1, 3} and last.columns == ["k", "t", "id", "m"]
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")  # the caller's session is left alone
