"""Profiles, bins, crosstabs, plot data, text fields, sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from predlens.catalogue.parts import PARTS_SELECT, PX_SQL, px
from predlens.catalogue.registry import fixed, query, sql_fixed, table
from predlens.functions import scalars as S
from predlens.operators import ordering, plotdata, profile
from predlens.plans.measurements import class_profile
from predlens.session import scratch_folder
from predlens.sources import sinks, tables
from predlens.sources.datasets import Dataset, Registry

# --- profiles ---

PROFILED = ["p_size", "p_retailprice"]
_EDGES = [f"edge{i}" for i in range(5)]


def _describe_sql(column, source="part"):
    lo, hi = f"CAST(MIN({column}) AS DOUBLE)", f"CAST(MAX({column}) AS DOUBLE)"
    edges = ", ".join(f"{sql_fixed(f'{lo} + {i} * ({hi} - {lo}) / 4', 6)} AS edge{i}" for i in range(5))
    return f"""SELECT CASE WHEN GROUPING(p_brand) = 0 THEN 'group' ELSE 'overall' END AS scope, p_brand AS "group",
        '{column}' AS "column", {sql_fixed(f'AVG({column})', 6)} AS mean, {lo} AS min, {hi} AS max, {edges}
    FROM {source} GROUP BY GROUPING SETS ((p_brand), ())"""


_DESCRIBE = " UNION ALL ".join(_describe_sql(c) for c in PROFILED)


@query("describe_overall", f"""SELECT scope, "column", mean, min, max, {", ".join(_EDGES)}
FROM ({_DESCRIBE}) WHERE scope = 'overall'""")
def q_describe_overall(spark, folder):
    rows = profile.describe(table(spark, folder, "part"), PROFILED)
    return fixed(rows.drop("group"), 6, "mean", *_EDGES)


@query("describe_by_class", _DESCRIBE)
def q_describe_by_class(spark, folder):
    return fixed(profile.describe(table(spark, folder, "part"), PROFILED, by="p_brand"), 6, "mean", *_EDGES)


@query("drop_last", """
SELECT p_partkey, p_brand, TRUE AS of_class FROM part
WHERE (p_brand, p_partkey) NOT IN (SELECT (p_brand, MAX(p_partkey)) FROM part GROUP BY p_brand)
UNION ALL SELECT p_partkey, p_brand, FALSE FROM part WHERE p_partkey < (SELECT MAX(p_partkey) FROM part)""")
def q_drop_last(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    by_class = ordering.drop_last(parts, "p_partkey", by=["p_brand"]).withColumn("of_class", F.lit(True))
    return by_class.unionByName(ordering.drop_last(parts, "p_partkey").withColumn("of_class", F.lit(False)))


@query("group_stats", f"""
SELECT p_brand, {sql_fixed('AVG(p_retailprice)', 6)} AS mean, COUNT(p_retailprice) AS answers,
       (SELECT {sql_fixed('AVG(p_retailprice)', 6)} FROM part) AS population_mean,
       (SELECT MIN(p_retailprice) FROM part) AS population_min,
       (SELECT MAX(p_retailprice) FROM part) AS population_max, (SELECT COUNT(*) FROM part) AS population_rows
FROM part GROUP BY p_brand""")
def q_group_stats(spark, folder):
    rows = profile.group_statistics(table(spark, folder, "part"), "p_brand", "p_retailprice")
    return fixed(rows, 6, "mean", "population_mean")


# --- missing values and checked types ---

_HOLES = """SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price"""


@query("null_drop", f"""
SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS index FROM ({_HOLES} FROM orders))
WHERE status IS NOT NULL AND price IS NOT NULL""")
def q_null_drop(spark, folder):
    source = table(spark, folder, "orders")
    holes = Dataset(
        load=lambda session: session.sql(_HOLES + " FROM {orders}", orders=source),
        response="price", complete=True, index_by=["o_orderkey"],
    )
    return holes.roles(spark).df


@query("not_null_cast", "SELECT l_orderkey AS game_id, COUNT(*) AS rows FROM lineitem GROUP BY ALL")
def q_not_null_cast(spark, folder):
    checked = table(spark, folder, "lineitem").select(S.unsigned(F.col("l_orderkey"), "game_id").alias("game_id"))
    return checked.groupBy("game_id").agg(F.count("*").alias("rows"))


@query("filled_ratio", f"""
SELECT l_suppkey, COALESCE(l_linenumber / NULLIF(l_linenumber % 3, 0), 0) AS filled,
       CAST(l_linenumber / NULLIF(l_linenumber % 3, 0) AS VARCHAR) IS NULL AS empty,
       {sql_fixed('l_extendedprice / 1000', 3)} AS up, TRY_CAST(substr(l_returnflag || '7', 2) AS DOUBLE) AS seven,
       TRY_CAST(l_returnflag AS DOUBLE) AS none
FROM lineitem""")
def q_filled_ratio(spark, folder):
    lines = table(spark, folder, "lineitem")
    ratio = S.safe_ratio(F.col("l_linenumber"), F.col("l_linenumber") % 3)
    return lines.select(
        "l_suppkey",
        F.coalesce(ratio, F.lit(0.0)).alias("filled"),
        ratio.isNull().alias("empty"),
        S.half_up(F.col("l_extendedprice") / 1000, 3).alias("up"),
        F.substring(F.concat("l_returnflag", F.lit("7")), 2, 1).try_cast("double").alias("seven"),
        F.col("l_returnflag").try_cast("double").alias("none"),
    )


# --- bins ---


def _edge_sql(source, x, bins, alias=""):
    return f"""(SELECT CAST(MIN({x}) AS DOUBLE) AS lo{alias}, CAST(MAX({x}) AS DOUBLE) AS hi{alias},
        (CAST(MAX({x}) AS DOUBLE) - CAST(MIN({x}) AS DOUBLE)) / ({bins}) AS step{alias} FROM {source})"""


def _bin_sql(x, bins, alias=""):
    return "(" + " + ".join(f"CAST({x} >= {i} * step{alias} + lo{alias} AS INT)" for i in range(1, bins)) + ")"


@query("hist_edges", f"""
SELECT CAST(i AS INT) AS position, CASE WHEN i = 10 THEN hi ELSE lo + i * (hi - lo) / 10 END AS edge
FROM RANGE(0, 11) r(i), {_edge_sql('events', 'value', 10)}""")
def q_hist_edges(spark, folder):
    return plotdata.edge_rows(table(spark, folder, "events"), "value")


@query("bin_1d", f"""
SELECT CAST(bin AS INT) AS bin, COUNT(*) AS rows, {sql_fixed('AVG(user_id)', 6)} AS mean,
       {sql_fixed('ANY_VALUE(lo) + (bin + 0.5) * ANY_VALUE(step)', 6)} AS center,
       {sql_fixed('COUNT(*) / (SELECT COUNT(*) FROM events)', 6)} AS proportion
FROM (SELECT *, {_bin_sql('value', 10)} AS bin FROM events, {_edge_sql('events', 'value', 10)}) GROUP BY bin""")
def q_bin_1d(spark, folder):
    bins = plotdata.binned(table(spark, folder, "events"), "value", "user_id")
    return fixed(bins, 6, "mean", "center", "proportion")


@query("bin_2d", f"""
SELECT CAST(bin1 AS INT) AS bin1, CAST(bin2 AS INT) AS bin2, COUNT(*) AS rows, {sql_fixed('AVG(l_tax)', 6)} AS mean
FROM (SELECT *, {_bin_sql('l_quantity', 10, '_q')} AS bin1, {_bin_sql('l_extendedprice', 10, '_p')} AS bin2
      FROM lineitem, {_edge_sql('lineitem', 'l_quantity', 10, '_q')},
           {_edge_sql('lineitem', 'l_extendedprice', 10, '_p')})
GROUP BY bin1, bin2""")
def q_bin_2d(spark, folder):
    return fixed(
        plotdata.binned_2d(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_tax"), 6, "mean"
    )


@query("bin_sturges", f"""
SELECT CAST(bin AS INT) AS bin, COUNT(*) AS rows, {sql_fixed('AVG(user_id)', 6)} AS mean,
       {sql_fixed('ANY_VALUE(lo) + (bin + 0.5) * ANY_VALUE(step)', 6)} AS center,
       {sql_fixed('COUNT(*) / (SELECT COUNT(*) FROM events)', 6)} AS proportion
FROM (SELECT *, LEN(LIST_FILTER(RANGE(1, CAST(CEIL(LOG2(n) + 1) AS INT)), lambda i: value >= i * step + lo)) AS bin
      FROM events, (SELECT COUNT(value) AS n FROM events),
           {_edge_sql('events', 'value', 'CEIL(LOG2(COUNT(value)) + 1)')}
      WHERE value < hi) GROUP BY bin""")
def q_bin_sturges(spark, folder):
    bins = plotdata.binned(table(spark, folder, "events"), "value", "user_id", bins=None)
    return fixed(bins, 6, "mean", "center", "proportion")


# --- crosstabs ---


@query("crosstab_count", """
SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS "F", COUNT(*) FILTER (o_orderstatus = 'O') AS "O",
       COUNT(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY ALL""")
def q_crosstab_count(spark, folder):
    return profile.crosstab_wide(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("crosstab_mean", f"""
SELECT o_orderpriority, o_orderstatus, COUNT(*) AS rows, {sql_fixed('AVG(o_totalprice)', 4)} AS mean
FROM orders GROUP BY ALL""")
def q_crosstab_mean(spark, folder):
    cells = profile.crosstab(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    return fixed(cells, 4, "mean")


@query("heat_cells", """
SELECT CAST(SUM(o) AS BIGINT) AS total, COUNT(DISTINCT o_orderpriority) AS row_labels,
       COUNT(DISTINCT o_orderstatus) AS column_labels, MAX(o) AS largest
FROM (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS o FROM orders GROUP BY ALL)""")
def q_heat_cells(spark, folder):
    return profile.crosstab_shape(table(spark, folder, "orders"), "o_orderpriority", "o_orderstatus")


@query("confusion_flags", f"""{PX_SQL}
SELECT CAST(ABS(p_size - 25) > 12.5 AS INT) AS left_flag, CAST(COALESCE(ABS(area - 600) > 500, FALSE) AS INT)
    AS right_flag, COUNT(*) AS rows FROM px GROUP BY ALL""")
def q_confusion_flags(spark, folder):
    shifted = px(spark, folder).select((F.col("p_size") - 25).alias("a"), (F.col("area") - 600).alias("b"))
    return profile.confusion_flags(shifted, "a", "b", 12.5, 500)


# --- plot data ---


@query("hist_by_class", f"""
SELECT event_type, CAST(bin AS INT) AS bin, COUNT(*) AS rows FROM (
    SELECT event_type, {_bin_sql('value', 10)} AS bin FROM events, {_edge_sql('events', 'value', 10)})
GROUP BY ALL""")
def q_hist_by_class(spark, folder):
    return plotdata.histogram_by(table(spark, folder, "events"), "value", "event_type").select(
        "event_type", "bin", "rows"
    )


@query("density_by_class", f"""
SELECT event_type, {sql_fixed('lo + (bin + 0.5) * step', 6)} AS center,
       {sql_fixed('rows / (SUM(rows) OVER (PARTITION BY event_type) * step)', 8)} AS density
FROM (SELECT event_type, bin, COUNT(*) AS rows, ANY_VALUE(lo) AS lo, ANY_VALUE(step) AS step FROM (
          SELECT event_type, {_bin_sql('value', 10)} AS bin, lo, step
          FROM events, {_edge_sql('events', 'value', 10)})
      GROUP BY ALL)""")
def q_density_by_class(spark, folder):
    cells = plotdata.histogram_by(table(spark, folder, "events"), "value", "event_type")
    return fixed(fixed(cells.select("event_type", "center", "density"), 6, "center"), 8, "density")


_QUARTILES = ", ".join(
    f"{sql_fixed(f'QUANTILE_CONT(value, {share})', 6)} AS {name}"
    for name, share in {"low": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1}.items()
)


@query("box_by_class", f"""
SELECT event_type, {_QUARTILES}, {sql_fixed('AVG(value)', 6)} AS mean, COUNT(value) AS rows
FROM events GROUP BY event_type""")
def q_box_by_class(spark, folder):
    boxes = plotdata.box_by(table(spark, folder, "events"), "value", "event_type")
    return fixed(boxes, 6, "low", "q1", "median", "q3", "high", "mean")


@query("box_exclusive", f"""
SELECT event_type, {sql_fixed('MEDIAN(value) FILTER (i <= n // 2)', 6)} AS q1,
       {sql_fixed('MEDIAN(value)', 6)} AS median, {sql_fixed('MEDIAN(value) FILTER (i > n - n // 2)', 6)} AS q3
FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS i,
             COUNT(*) OVER (PARTITION BY event_type) AS n FROM events)
GROUP BY event_type""")
def q_box_exclusive(spark, folder):
    return fixed(plotdata.box_exclusive(table(spark, folder, "events"), "value", "event_type"), 6, "q1", "median", "q3")


@query("point_sample", """
SELECT event_id, event_type, value FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) <= 50""")
def q_point_sample(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    return plotdata.point_sample(rows, "event_type", "event_id", 50)


def _line_sql(x, y):
    return f"""{sql_fixed(f'REGR_SLOPE({y}, {x})', 6)} AS slope, {sql_fixed(f'REGR_INTERCEPT({y}, {x})', 6)}
        AS intercept, CAST(REGR_COUNT({y}, {x}) AS BIGINT) AS points"""


@query("trend_line", f"{PX_SQL} SELECT {_line_sql('p_size', 'z')} FROM px")
def q_trend_line(spark, folder):
    return fixed(plotdata.trend_line(px(spark, folder), "p_size", "z"), 6, "slope", "intercept")


@query("log_trend_line", f"{PX_SQL} SELECT {_line_sql('LN(p_size)', 'z')} FROM px WHERE p_size > 0")
def q_log_trend_line(spark, folder):
    return fixed(plotdata.trend_line(px(spark, folder), "p_size", "z", log_x=True), 6, "slope", "intercept")


# --- labels, order, text ---


@query("distinct_labels", """
SELECT event_type, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS code, event_type || ' and value' AS pair
FROM events GROUP BY event_type""")
def q_distinct_labels(spark, folder):
    codes = ordering.dense_codes(table(spark, folder, "events"), "event_type")
    return codes.withColumn("pair", S.pair_label(F.col("event_type"), F.lit("value")))


@query("top20", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def q_top20(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ordering.top_rows(orders, 20, F.col("o_totalprice").desc(), "o_orderkey")


@query("text_fields", """
SELECT doc_id, source || '_' || lang AS stem, '_' || source AS suffix, CAST(ABS(5000 - n_chars) AS BIGINT) AS far,
       printf('%.6e', n_chars / 7.0::DOUBLE) AS printed
FROM documents""")
def q_text_fields(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.concat(F.lit("plots/"), "source", F.lit("_"), "lang", F.lit(".html"))
    return docs.select(
        "doc_id",
        S.page_stem(path).alias("stem"),
        S.suffix_after(F.concat(F.lit("diff_"), "source"), "diff").alias("suffix"),
        F.abs(5000 - F.col("n_chars")).alias("far"),
        S.scientific(F.col("n_chars") / 7).alias("printed"),
    )


# --- sources and sinks ---


@query("sql_over_views", """
SELECT r_name, COUNT(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def q_sql_over_views(spark, folder):
    views = {f"given_{name}": table(spark, folder, name) for name in ("region", "nation", "customer")}
    return tables.sql_frame(
        spark,
        """SELECT r_name, COUNT(*) AS customers FROM given_region
           JOIN given_nation ON n_regionkey = r_regionkey
           JOIN given_customer ON c_nationkey = n_nationkey GROUP BY r_name""",
        views,
    )


@query("csv_named", "SELECT p_size AS \"size in cm\", p_retailprice AS \"price in cents\", p_brand AS class FROM part")
def q_csv_named(spark, folder):
    path = scratch_folder(spark, "csv")
    table(spark, folder, "part").select("p_size", "p_retailprice", "p_brand").write.csv(path)
    columns = {"size in cm": T.IntegerType(), "price in cents": T.DoubleType(), "class": T.StringType()}
    return tables.named_csv(spark, path, columns)


@query("ctas_replace", "SELECT n_regionkey, COUNT(*) AS nations FROM nation GROUP BY ALL")
def q_ctas_replace(spark, folder):
    nations, path = table(spark, folder, "nation"), scratch_folder(spark, "replace")
    sinks.create_or_replace(nations.select("n_name"), "predlens_replaced", path)
    counted = nations.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    return sinks.create_or_replace(counted, "predlens_replaced", path)


@query("ctas_if_absent", "SELECT n_regionkey, COUNT(*) AS nations FROM nation GROUP BY ALL")
def q_ctas_if_absent(spark, folder):
    nations, path = table(spark, folder, "nation"), scratch_folder(spark, "absent")
    spark.sql("DROP TABLE IF EXISTS predlens_absent")
    counted = nations.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    sinks.create_if_absent(counted, "predlens_absent", path)
    return sinks.create_if_absent(nations.select("n_name"), "predlens_absent", path)


@query("dataset_roles", f"""
SELECT * REPLACE (CAST(q4 AS VARCHAR) AS q4), CAST(p_partkey AS BIGINT) AS index FROM ({PARTS_SELECT} part) WHERE area IS NOT NULL AND brand IS NOT NULL""")
def q_dataset_roles(spark, folder):
    registry = Registry().add(
        "parts",
        Dataset(
            load=lambda session: sinks.keep_on_disk(px(session, folder)), response="y", predictors=["p_size", "area", "q4"],
            categorical=["q4"], complete=True, index_by=["p_partkey"],
        ),
    )
    return registry.get(spark).df


def _without_last_sql(column):
    lo, hi = f"CAST(MIN({column}) AS DOUBLE)", f"CAST(MAX({column}) AS DOUBLE)"
    edges = ", ".join(f"{sql_fixed(f'{lo} + {i} * ({hi} - {lo}) / 4', 6)} AS edge{i}" for i in range(5))
    values = f"""'{column}' AS "column", {sql_fixed(f'AVG({column})', 6)} AS mean, {lo} AS min, {hi} AS max, {edges}"""
    return f"""SELECT 'overall' AS scope, NULL AS "group", {values} FROM part
        WHERE p_partkey < (SELECT MAX(p_partkey) FROM part)
    UNION ALL SELECT 'group', p_brand, {values} FROM part
        WHERE (p_brand, p_partkey) NOT IN (SELECT (p_brand, MAX(p_partkey)) FROM part GROUP BY p_brand)
        GROUP BY p_brand"""


@query("describe_without_last", " UNION ALL ".join(_without_last_sql(c) for c in PROFILED))
def q_describe_without_last(spark, folder):
    rows = class_profile(table(spark, folder, "part"), PROFILED, "p_brand", without_last="p_partkey")
    return fixed(rows, 6, "mean", *_EDGES)
