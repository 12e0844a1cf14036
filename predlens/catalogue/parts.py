"""The derived frame of the statistics queries.

The columns of the given tables hardly depend on each other. This frame over ``part`` adds
a response and predictors that do, and some NULLs; the text is the same for both engines.
"""

PARTS_SELECT = """
SELECT p_partkey, p_size, p_retailprice, p_brand, p_size % 4 AS q4,
       CASE WHEN p_size > 25 THEN 'hi' ELSE 'lo' END AS hl,
       CASE WHEN p_size > 25 THEN p_size % 8 ELSE 9 END AS g9,
       CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS big,
       CASE WHEN p_retailprice > p_size * 30 THEN 1 ELSE 0 END AS dear,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size * p_size AS DOUBLE) END AS area,
       CASE WHEN (p_partkey * 37) % 100 < p_size * 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y,
       CAST(p_size * 3 + p_partkey % 17 AS DOUBLE) AS z
FROM """

PX_SQL = f"WITH px AS ({PARTS_SELECT} part)\n"


def px(spark, folder):
    """The frame of :data:`PX_SQL` on Spark."""
    return spark.sql(PARTS_SELECT + "{part}", part=spark.read.parquet(f"{folder}/part.parquet"))
