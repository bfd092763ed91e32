"""What is skipped, stale and kept when inputs, functions, constants, filters and options change."""

import numpy as np
import pandas as pd
import pytest

from keyloom.operators.filters import Compare
from keyloom.plans import lineage
from keyloom.plans.foreach import Fixed, Merge
from keyloom.plans.run import Variable, for_each, states
from keyloom.sources.paths import PathTemplate
from keyloom.sources.store import Store, current_store, open_store

RAW = Variable("raw")


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"), ["subject", "trial"])
    made.save_many("raw", {(s, t): float(10 * s + t) for s in (1, 2) for t in (1, 2)})
    return made


def run(store, fn, inputs, output, keys, **options):
    return for_each(store, fn, inputs, [output], keys, "value double", skip_computed=True, **options).count()


def state_of(store, fn, inputs, output, keys, **options):
    return sorted(r["state"] for r in states(store, fn, inputs, output, keys, **options).collect())


def summed():
    def total(x, base=0.0):  # inside, so that it is shipped by value
        return float(np.sum(np.asarray(x, dtype=float))) - float(np.sum(np.asarray(base, dtype=float)))

    return total


total = summed()


def test_fixed_inputs_are_watched(store):
    inputs, keys = {"x": RAW, "base": Fixed(RAW, trial=1)}, ["subject", "trial"]
    assert [run(store, total, inputs, "out", keys) for _ in range(2)] == [4, 0]
    assert state_of(store, total, inputs, "out", keys) == ["up_to_date"] * 4
    store.save("raw", 99.0, subject=1, trial=1)
    # subject 1's base is the record that changed: both its trials are stale
    assert state_of(store, total, inputs, "out", keys) == ["stale", "stale", "up_to_date", "up_to_date"]
    assert [run(store, total, inputs, "out", keys) for _ in range(2)] == [2, 0]
    assert store.load("out", subject=1, trial=2) == 12.0 - 99.0  # a new version of the variant, not a second variant


def test_lower_rows_filter_and_options_are_watched(store):
    inputs, keys = {"x": RAW}, ["subject"]
    assert [run(store, total, inputs, "sum", keys) for _ in range(2)] == [2, 0]
    store.save("raw", 50.0, subject=2, trial=3)
    assert state_of(store, total, inputs, "sum", keys) == ["stale", "up_to_date"]
    assert [run(store, total, inputs, "sum", keys) for _ in range(2)] == [1, 0]
    assert store.load("sum", subject=2) == 93.0
    edges = store.edges()
    newest = store.find_id("sum", subject=2)
    assert edges.where(edges.child == newest).count() == 3  # every lower record is a parent
    where = Compare("raw", "value", ">", 11.5)
    assert state_of(store, total, inputs, "sum", keys, where=where) == ["stale", "stale"]
    assert [run(store, total, inputs, "sum", keys, where=where) for _ in range(2)] == [2, 0]
    assert run(store, total, inputs, "sum", keys) == 0  # another variant, which stays


def test_merged_inputs_are_watched_and_in_order(store):
    store.save("side", pd.DataFrame({"w": [1.0, 2.0, 3.0]}), subject=1)
    store.save("speed", pd.DataFrame({"v": [3.0, 2.0, 1.0]}), subject=1)
    inputs = {"t": Merge(Variable("side"), Variable("speed"))}

    def first(t):
        return float(t["w"].iloc[0] * 10 + t["v"].iloc[0])

    assert [run(store, first, inputs, "m", ["subject"]) for _ in range(2)] == [1, 0]
    assert store.load("m", subject=1) == 13.0
    store.save("speed", pd.DataFrame({"v": [5.0, 2.0, 1.0]}), subject=1)
    assert [run(store, first, inputs, "m", ["subject"]) for _ in range(2)] == [1, 0]
    assert store.load("m", subject=1) == 15.0


def test_changes_go_down_a_chain_and_functions_count(store):
    keys = ["subject", "trial"]

    def one(x):
        return float(x) + 1

    def two(x):
        return float(x) * 2

    def chain():
        return run(store, one, {"x": RAW}, "a", keys), run(store, two, {"x": Variable("a")}, "b", keys)

    assert chain() == (4, 4) and chain() == (0, 0)
    store.save("raw", 11.0, subject=1, trial=1)  # the same content again
    assert chain() == (0, 0)
    store.save("raw", 70.0, subject=1, trial=1)
    assert state_of(store, two, {"x": Variable("a")}, "b", keys) == ["stale"] + ["up_to_date"] * 3  # an ancestor is superseded
    assert chain() == (1, 1) and store.load("b", subject=1, trial=1) == 142.0

    def two(x):  # noqa: F811
        return float(x) * 3

    assert state_of(store, two, {"x": Variable("a")}, "b", keys) == ["stale"] * 4
    assert chain() == (0, 4) and store.load("b", subject=1, trial=1) == 213.0


def test_states_look_at_all_ancestors_over_chains_and_joins(store):
    keys = ["subject", "trial"]

    def same(x):
        return float(x)

    def both(x, y):
        return float(x) + float(y)

    store.save_many("side", {(s, t): 1.0 for s in (1, 2) for t in (1, 2)})
    steps = [(same, {"x": RAW}, "a"), (same, {"x": Variable("a")}, "b"), (both, {"x": Variable("b"), "y": Variable("side")}, "c"), (same, {"x": Variable("c")}, "d")]
    for fn, inputs, output in steps:
        run(store, fn, inputs, output, keys)
    states_of = lambda *which: [state_of(store, *steps[i], keys) for i in which]
    store.save("side", 5.0, subject=2, trial=2)
    one = ["stale"] + ["up_to_date"] * 3
    assert states_of(1, 3) == [["up_to_date"] * 4, one]
    store.save("raw", 70.0, subject=1, trial=1)
    assert states_of(1, 3) == [one, ["stale"] * 2 + ["up_to_date"] * 2]
    for fn, inputs, output in steps:
        run(store, fn, inputs, output, keys)
    assert states_of(3) == [["up_to_date"] * 4]
    newest = store.find_id("d", subject=1, trial=1)
    walk = store.upstream(newest).orderBy("depth").collect()
    assert [(r["depth"], r["function_name"]) for r in walk if r["depth"] < 2] == [(0, "same"), (1, "both"), (1, "both")]
    assert max(r["depth"] for r in walk) == 4 and {r["record_id"] for r in walk if r["parent"] is None} == {store.find_id("raw", subject=1, trial=1), store.find_id("side", subject=1, trial=1)}


def test_several_outputs_are_fresh_together(store):
    @lineage.lineage_function(unpack=True)
    def both(x):
        return float(x), float(x) * 2

    arguments = (both, {"x": RAW}, ["p", "q"], ["subject", "trial"])
    assert for_each(store, *arguments, "p double, q double", output_names=["p", "q"], skip_computed=True).count() == 4
    assert store.load("q", subject=2, trial=1) == 42.0
    store.exclude(store.find_id("q", subject=2, trial=1))
    assert sorted(r["state"] for r in states(store, *arguments).collect()) == ["missing", "up_to_date", "up_to_date", "up_to_date"]
    assert for_each(store, *arguments, "p double, q double", output_names=["p", "q"], skip_computed=True).count() == 1
    with pytest.raises(ValueError):
        for_each(store, lineage.LineageFunction(total), {"x": RAW}, ["p", "q"], ["subject"])


def test_files_and_paths(store, tmp_path):
    (tmp_path / "raw").mkdir()
    for s in (1, 2):
        (tmp_path / f"raw/{s}.txt").write_text(str(s * 5))

    def read(path):
        with open(path) as f:
            return float(f.read())

    inputs = {"path": PathTemplate("{subject}.txt", str(tmp_path / "raw"))}
    assert [run(store, read, inputs, "from_file", ["subject"]) for _ in range(2)] == [2, 0]
    assert store.load("from_file", subject=2) == 10.0

    def write(x, subject):
        with open(f"{tmp_path}/{subject}.out", "w") as f:
            f.write(str(float(x)))

    writer = lineage.LineageFunction(write, generates_file=True)
    for expected in (2, 0):
        assert for_each(store, writer, {"x": Variable("from_file")}, ["plot"], ["subject"], skip_computed=True).count() == expected
    assert (tmp_path / "2.out").read_text() == "10.0"
    assert store.find_id("plot", subject=2).startswith("generated:") and store.provenance(**{"subject": 2}).where("function_name = 'write'").count() == 1


def test_expected_combinations_are_those_of_the_newest_run(store):
    run(store, total, {"x": RAW}, "sum", {"subject": []})
    run(store, total, {"x": RAW}, "sum", {"subject": [1]})
    assert [r["combo"] for r in store.expected("total").collect()] == ['{"subject":"1"}']


def test_saved_forms(store):
    table = {"force": np.array([1.0, 2.0]), "label": ["a", "b"]}
    store.save("grf", table, subject=1)
    got = store.load("grf", subject=1)
    assert got["force"].tolist() == [1.0, 2.0] and got["label"] == ["a", "b"] and store.data("grf").count() == 2
    store.codec("point", lambda p: {"x": p[0], "y": p[1]}, lambda d: (d["x"], d["y"]))
    store.save("point", (1.0, 2.0), subject=1)
    assert store.load("point", subject=1) == (1.0, 2.0)
    store.describe("raw", "made up")
    assert {r["variable_name"]: (r["schema_level"], r["description"]) for r in store.list_variables().collect()}["raw"] == ("trial", "made up")
    assert store.schema_ids().select("schema_id").distinct().count() == store.schema_ids().count() == 5
    result = lineage.lineage_function(lambda x, k: x * k).trace(lineage.load_saved(store, "raw", subject=1, trial=1), 3)
    rid = lineage.save_result(store, "tripled", result, subject=1, trial=1)
    assert store.load("tripled", version=rid) == 33.0 and store.edges().where(f"child = '{rid}'").count() == 1
    with pytest.raises(LookupError):
        current_store()
    assert open_store(store.spark, store.root, ["subject", "trial"]) is current_store()
