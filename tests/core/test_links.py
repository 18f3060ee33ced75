"""Links found by brand against their SQL."""

from coppice.sources import projection as p

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string"


def test_links_by_brand(spark, tmp_path):
    parts = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "a"), (6, "b"), (7, None)]
    lines = [(o, n, k, f, s) for o, n, k, f, s in [
        (1, 1, 1, "A", "F"), (1, 2, 2, "R", "O"), (1, 2, 5, "N", "O"), (1, 2, 5, "N", "O"), (1, 3, 3, "N", "F"), (1, 3, 1, None, None), (1, 4, 6, "A", "F"), (1, 6, 2, "A", "F"),
        (2, 1, 1, "A", "F"), (2, 2, 1, "A", "F"), (2, 3, 4, "A", "F"), (2, 4, 7, "A", "F"), (3, 1, 1, "A", "F"), (3, 2, 2, "A", "F"), (None, 1, 1, "A", "F"), (None, 2, 2, "A", "F"), (4, None, 1, "A", "F"), (4, 1, 99, "A", "F"), (4, 2, None, "A", "F"),
    ]]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.01"):
        by_sql = spark.sql(p.LINKS, part=spark.read.parquet(f"{folder}/part.parquet"), lineitem=spark.read.parquet(f"{folder}/lineitem.parquet"))
        got = p.brand_links(spark, folder)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, by_sql.collect()), key=key) and got.count() >= 5
    # All successions went through three shuffles before the brands were looked at.
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") >= 2
