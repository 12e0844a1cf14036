"""Ratio queries: orders are games, customers are batters, lines are at-bats, returns are hits."""

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from predlens.catalogue.registry import fixed, query, sql_fixed, table
from predlens.operators.ratios import RatioColumns, annual_ratio, historic_ratio, rolling_ratio
from predlens.operators.windows import trailing_row_means
from predlens.streaming.buckets import tumbling
from predlens.session import durable, scratch_folder
from predlens.streaming.trailing import trailing_ratio_stream
from predlens.transformers import TrailingRatio

COLUMNS = RatioColumns(key="o_custkey", game="game_id", date="local_date", num="hit", den="at_bat")


def line_facts(spark, folder):
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), hit.alias("hit"), F.lit(1).alias("at_bat")
    )


def order_games(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("game_id"), "o_custkey", F.col("o_orderdate").alias("local_date")
    )


LINES_SQL = """
WITH lines AS (
    SELECT o_custkey, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS local_date,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hit, 1 AS at_bat
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""
RATIO_SQL = sql_fixed("SUM(hit) / NULLIF(SUM(at_bat), 0)", 3)


@query("annual_ratio", f"""{LINES_SQL}
SELECT o_custkey, YEAR(local_date) AS year, {RATIO_SQL} AS annual_ratio
FROM lines GROUP BY ALL""")
def q_annual_ratio(spark, folder):
    return annual_ratio(line_facts(spark, folder), order_games(spark, folder), COLUMNS)


@query("historic_ratio", f"""
SELECT l_suppkey, {sql_fixed("SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / COUNT(*)", 3)}
    AS historic_ratio
FROM lineitem GROUP BY l_suppkey""")
def q_historic_ratio(spark, folder):
    hit = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    facts = table(spark, folder, "lineitem").select("l_suppkey", hit.alias("hit"), F.lit(1).alias("at_bat"))
    return historic_ratio(facts, RatioColumns(key="l_suppkey", num="hit", den="at_bat"))


ROLLING_SQL = f"""{LINES_SQL},
games AS (SELECT o_custkey, game_id, local_date, SUM(hit) AS hit, SUM(at_bat) AS at_bat FROM lines GROUP BY ALL)
SELECT o_custkey, game_id, local_date, local_date - 100 AS days_100_prior,
       (SELECT {RATIO_SQL} FROM games b
        WHERE b.o_custkey = a.o_custkey AND b.local_date BETWEEN a.local_date - 100 AND a.local_date)
           AS rolling_ratio
FROM games a"""


@query("rolling_100d", ROLLING_SQL)
def q_rolling(spark, folder):
    return rolling_ratio(line_facts(spark, folder), order_games(spark, folder), COLUMNS)


@query("rolling_transformer", f"""{LINES_SQL},
games AS (SELECT o_custkey, game_id, local_date, SUM(hit) AS hit, SUM(at_bat) AS at_bat FROM lines GROUP BY ALL)
SELECT o_custkey, game_id, local_date,
       CAST(SUM(hit) AS BIGINT) AS hit, CAST(SUM(at_bat) AS BIGINT) AS at_bat, {sql_fixed(
    "SUM(SUM(hit)) OVER w / NULLIF(SUM(SUM(at_bat)) OVER w, 0)", 3)} AS rolling_100_day_avg
FROM games GROUP BY o_custkey, game_id, local_date
WINDOW w AS (PARTITION BY o_custkey ORDER BY local_date RANGE BETWEEN INTERVAL 100 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_transformer(spark, folder):
    sums = line_facts(spark, folder).groupBy("game_id").agg(
        F.sum("hit").alias("hit"), F.sum("at_bat").alias("at_bat")
    )
    dated = order_games(spark, folder).withColumn("local_date", F.col("local_date").cast("date"))
    rows = sums.join(dated, "game_id").select("o_custkey", "game_id", "local_date", "hit", "at_bat")
    stage = TrailingRatio(
        key="o_custkey", date="local_date", num="hit", den="at_bat", outputCol="rolling_100_day_avg"
    )
    return Pipeline(stages=[stage]).fit(rows).transform(rows)


@query("rolling_stream", f"""{LINES_SQL},
daily AS (SELECT o_custkey, local_date AS day, SUM(hit) AS hit, SUM(at_bat) AS at_bat FROM lines GROUP BY ALL)
SELECT o_custkey, day, CAST(SUM(hit) OVER w AS DOUBLE) AS hit, CAST(SUM(at_bat) OVER w AS DOUBLE) AS at_bat,
       {sql_fixed("SUM(hit) OVER w / NULLIF(SUM(at_bat) OVER w, 0)", 3)} AS ratio
FROM daily WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL 100 DAY PRECEDING AND CURRENT ROW)""")
def q_rolling_stream(spark, folder):
    """The lines come as a stream of three batches in no order of time; the last word on each (key, day) is the batch result."""
    facts = line_facts(spark, folder).join(order_games(spark, folder), "game_id")
    rows = facts.select("o_custkey", F.col("local_date").cast("date").alias("local_date"), "hit", "at_bat")
    rows = durable(rows.withColumn("_part", F.pmod(F.xxhash64("o_custkey", "local_date", "hit"), F.lit(3))), "lines")
    place, told, state = (scratch_folder(spark, name) for name in ("stream", "told", "state"))
    # A batch that is run again after a failure writes the same rows to the same place.
    write = lambda batch, number: batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{told}/batch={number}")
    for part in range(3):
        arrived = rows.filter(F.col("_part") == part).drop("_part")
        arrived.write.mode("append").parquet(place)
        # What has arrived since the last run is one batch, of as many files as tasks wrote it.
        stream = spark.readStream.schema(arrived.schema).parquet(place)
        ratios = trailing_ratio_stream(stream, key="o_custkey", date="local_date", num="hit", den="at_bat", out="ratio")
        ratios.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    last = F.max(F.struct("_batch", "hit", "at_bat", "ratio")).alias("last")
    return spark.read.parquet(told).groupBy("o_custkey", "day").agg(last).select("o_custkey", "day", "last.hit", "last.at_bat", "last.ratio")


@query("tumbling_day", """
SELECT date_trunc('day', ts) AS bucket_start, COUNT(*) AS events, COUNT(DISTINCT user_id) AS users
FROM events GROUP BY ALL""")
def q_tumbling_day(spark, folder):
    counted = tumbling(
        table(spark, folder, "events"), "ts", F.count("*").alias("events"), F.countDistinct("user_id").alias("users")
    )
    return counted.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query("prev5_mean", f"""
SELECT o_custkey, o_orderkey, {sql_fixed('''AVG(o_totalprice) OVER (
    PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)''', 4)} AS o_totalprice
FROM orders""")
def q_prev5_mean(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    means = trailing_row_means(orders, key="o_custkey", order="o_orderkey", measures=["o_totalprice"], rows=5)
    return fixed(means, 4, "o_totalprice")


@query("prev50_mean", f"""
WITH nation_orders AS (
    SELECT c_nationkey, o_orderkey, o_totalprice, o_totalprice / 1000 AS thousands
    FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT c_nationkey, o_orderkey, {sql_fixed('AVG(o_totalprice) OVER w', 4)} AS o_totalprice,
       {sql_fixed('AVG(thousands) OVER w', 4)} AS thousands
FROM nation_orders
WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderkey ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""")
def q_prev50_mean(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", "o_orderkey", "o_totalprice", (F.col("o_totalprice") / 1000).alias("thousands")
    )
    means = trailing_row_means(
        rows, key="c_nationkey", order="o_orderkey", measures=["o_totalprice", "thousands"], rows=50
    )
    return fixed(means, 4, "o_totalprice", "thousands")
