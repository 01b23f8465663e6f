"""Plan shape: no cartesian products, pruned scans, one unpivot."""

import pytest

from canonspark.plans import catalogue as C

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fuzzy_pairs_ratio", "fuzzy_pairs_token_set", "fuzzy_pairs_partial",
                                  "entity_match", "spell_corrections", "apply_category", "profile_columns"])
def test_no_cartesian_product(spark, name):
    plan = _plan(C.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    from canonspark.operators import reshape as R
    long = R.melt(C._part_raw(spark, SF), ["p_name"])
    plan = _plan(R.distinct_values(R.normalise_long(long, "direct")))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("p_retailprice" not in s for s in scans)


def test_melt_is_one_expand(spark):
    from canonspark.operators import reshape as R
    long = R.melt(C.TB.messy_part(spark, SF), C.MESSY_COLS, category="category")
    assert _plan(long).count("Expand") == 1


def test_apply_broadcasts_small_value_map(spark):
    df = C.QUERIES["apply_plain"](spark, SF)
    df.write.format("noop").mode("overwrite").save()          # AQE settles the final plan
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan
    assert plan.count("part.parquet") == 1                     # raw table scanned once
