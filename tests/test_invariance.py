"""Results depend on row ids only, not on input order or partitioning."""

from pyspark.sql import functions as F

from canonspark.plans import cleaning as CL
from canonspark.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _summary(g):
    return sorted((r.group_key, r.cluster_id, r.suggestion, r.suggestion_mode, r.size)
                  for r in g.suggestions.collect())


def test_order_and_partition_invariance(spark):
    raw = TB.messy_part(spark, SF).cache()
    a = CL.group_by_category(raw, ["name_a", "name_b"], "category")
    shuffled = raw.repartition(7, F.rand(11)).orderBy(F.rand(3))
    b = CL.group_by_category(shuffled, ["name_a", "name_b"], "category")
    assert _summary(a) == _summary(b)
    c = CL.group_in_column(raw.coalesce(1), ["name_a", "name_b"])
    d = CL.group_in_column(shuffled, ["name_a", "name_b"])
    assert _summary(c) == _summary(d)
