"""Whether outputs are up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combo_states(expected: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """expected with `state`: missing, stale or up_to_date.

    expected: keys and input_time, and, if known, function_hash and inputs_hash; made: keys and
    output_time with the hashes of the run that made it. A differing hash or an input newer
    than the output is stale.
    """
    hashes = [c for c in ("function_hash", "inputs_hash") if c in expected.columns and c in made.columns]
    done = made.select(*keys, "output_time", *[F.col(h).alias(f"__{h}") for h in hashes])
    joined = expected.join(done, keys, "left")
    stale = F.col("output_time") < F.col("input_time")
    for h in hashes:
        stale = stale | ~F.col(h).eqNullSafe(F.col(f"__{h}"))
    state = F.when(F.col("output_time").isNull(), "missing").when(stale, "stale").otherwise("up_to_date")
    return joined.withColumn("state", state).drop(*[f"__{h}" for h in hashes])


def node_states(states: DataFrame, node: str) -> DataFrame:
    """(node, state): red if any is stale or none is fresh, grey if some are missing, else green."""
    any_ = lambda s: F.bool_or(F.col("state") == s)
    verdict = F.when(any_("stale") | ~any_("up_to_date"), "red").when(any_("missing"), "grey").otherwise("green")
    return states.groupBy(F.col(node).alias("node")).agg(verdict.alias("state"))


def fresh(states: DataFrame) -> DataFrame:
    return states.where("state = 'up_to_date'")
