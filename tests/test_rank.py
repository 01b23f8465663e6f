from pyspark.sql import Window
from pyspark.sql import functions as F

from canonspark.operators.rank import row_number_within


def test_distributed_rank_equals_window(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, id int").dropDuplicates(["g", "o"])
    a = {(r.g, r.o): r.k for r in row_number_within(df, ["g"], ["o"], "k", num_partitions=5).collect()}
    plain = Window.partitionBy("g").orderBy("o")
    assert a == {(r.g, r.o): r.k for r in df.withColumn("k", F.row_number().over(plain)).collect()}
    hot = sorted((o, k) for (g, o), k in a.items() if g == "hot")
    assert [k for _, k in hot] == list(range(1, len(hot) + 1))
