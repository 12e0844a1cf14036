"""Split, scaling, classifiers and the whole report."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from predlens.catalogue.parts import PX_SQL, px
from predlens.catalogue.registry import fixed, query, sql_fixed, table
from predlens.models.neighbours import majority, nearest
from predlens.models.quadratic import QuadraticDiscriminant, class_moments
from predlens.models.suite import compare, forest_importance
from predlens.operators.ordering import dense_codes
from predlens.operators.scaling import in_test, split, standardize
from predlens.plans.measurements import training_scores
from predlens.plans.report import predictor_report
from predlens.session import scratch_folder

_TEST = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 2) AS INT) < 84"


@query("split_md5", f"SELECT o_orderkey, {_TEST.format('o_orderkey')} AS test FROM orders")
def q_split(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", in_test(F.col("o_orderkey")).alias("test"))


SCALED = ["l_quantity", "l_extendedprice", "l_tax"]


def _scaled_sql(spread):
    columns = ", ".join(
        sql_fixed(f"({c} - (SELECT AVG({c}) FROM lineitem)) / (SELECT {spread}({c}) FROM lineitem)", 5) + f" AS {c}"
        for c in SCALED
    )
    return f"SELECT l_orderkey, l_linenumber, '{spread}' AS spread, {columns} FROM lineitem"


@query("standardize", f"{_scaled_sql('stddev_pop')} UNION ALL {_scaled_sql('stddev_samp')}")
def q_standardize(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *SCALED)
    parts = [
        standardize(lines, SCALED, population=name == "stddev_pop").withColumn("spread", F.lit(name))
        for name in ("stddev_pop", "stddev_samp")
    ]
    return fixed(parts[0].unionByName(parts[1]), 5, *SCALED)


def _vectors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@query("knn3", f"""
WITH rows AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, {_TEST.format('vec_id')} AS test FROM embeddings),
near AS (
    SELECT q.vec_id, q.label AS truth, t.label, t.vec_id AS neighbour, LIST_DISTANCE(q.e, t.e) AS distance
    FROM rows q, rows t WHERE q.test AND NOT t.test
    QUALIFY ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY LIST_DISTANCE(q.e, t.e), t.vec_id) <= 3),
votes AS (SELECT vec_id, truth, label, COUNT(*) AS votes FROM near GROUP BY ALL),
far AS (SELECT vec_id, MAX(distance) AS farthest FROM near GROUP BY ALL)
SELECT vec_id, truth, label AS prediction, {sql_fixed('farthest', 6)} AS farthest
FROM votes JOIN far USING (vec_id)
QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1""")
def q_knn3(spark, folder):
    train, test = split(_vectors(spark, folder), "vec_id")
    near = nearest(train, test, key="vec_id", features="embedding", label="label", k=3)
    farthest = near.filter(F.col("place") == 3).select("vec_id", F.col("distance").alias("farthest"))
    truth = test.select("vec_id", F.col("label").alias("truth"))
    return fixed(truth.join(majority(near, "vec_id"), "vec_id").join(farthest, "vec_id"), 6, "farthest")


@query("qda_params", f"""
SELECT event_type, COUNT(*) AS rows, {sql_fixed('AVG(value)', 6)} AS mean_0, {sql_fixed('AVG(user_id)', 6)} AS mean_1,
       {sql_fixed('COVAR_SAMP(value, value)', 4)} AS cov_0_0, {sql_fixed('COVAR_SAMP(value, user_id)', 4)} AS cov_0_1,
       {sql_fixed('COVAR_SAMP(user_id, user_id)', 4)} AS cov_1_1
FROM events GROUP BY event_type""")
def q_qda_params(spark, folder):
    moments = class_moments(table(spark, folder, "events"), "event_type", ["value", "user_id"])
    return fixed(fixed(moments, 6, "mean_0", "mean_1"), 4, "cov_0_0", "cov_0_1", "cov_1_1")


_QDA_MEASURES = ["p_size", "z"]


@query("qda_predict", f"""{PX_SQL}, rows AS (
    SELECT p_partkey, y, CAST(p_size AS DOUBLE) AS a, z AS b, {_TEST.format('p_partkey')} AS test FROM px),
classes AS (
    SELECT y AS c, COUNT(*) / SUM(COUNT(*)) OVER () AS share, AVG(a) AS ma, AVG(b) AS mb,
           COVAR_SAMP(a, a) AS aa, COVAR_SAMP(a, b) AS ab, COVAR_SAMP(b, b) AS bb
    FROM rows WHERE NOT test GROUP BY y),
scores AS (
    SELECT p_partkey, y, c, LN(share) - 0.5 * LN(aa * bb - ab * ab) - 0.5 * (
        (a - ma) ** 2 * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) ** 2 * aa) / (aa * bb - ab * ab) AS score
    FROM rows, classes WHERE test)
SELECT p_partkey, y, ARG_MAX(c, score) AS prediction FROM scores GROUP BY ALL""")
def q_qda_predict(spark, folder):
    train, test = split(px(spark, folder), "p_partkey")
    gather = VectorAssembler(inputCols=_QDA_MEASURES, outputCol="features")
    model = Pipeline(stages=[gather, QuadraticDiscriminant(labelCol="y")]).fit(train)
    return model.transform(test).select("p_partkey", "y", "prediction")


FEATURES = {"all": ["p_size", "p_retailprice", "z", "q4", "g9"], "top": ["p_size", "z"]}


@query("model_compare")
def q_model_compare(spark, folder):
    train, test = split(px(spark, folder), "p_partkey")
    return compare(train, test, FEATURES, label="y", key="p_partkey")


@query("label_encoding", """
SELECT event_id, CAST(DENSE_RANK() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS code FROM events""")
def q_label_encoding(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    codes = dense_codes(events, "event_type")
    return events.join(codes, "event_type").select("event_id", F.col("code").cast("double").alias("code"))


@query("forest_importance")
def q_forest_importance(spark, folder):
    names = ["p_size", "p_retailprice", "z"]
    importance = forest_importance(px(spark, folder), names, "y", classify=True)
    return spark.createDataFrame(list(importance.items()), "predictor string, importance double")


REPORTED = ["p_size", "p_retailprice", "z", "hl", "q4", "p_brand"]
_NUMBERS = [name for name in REPORTED if name not in ("hl", "p_brand")]

# Rows of each section, from the numbers of continuous (c) and categorical (d) predictors.
_SECTION_ROWS = {
    "ranking": "c + d", "cont_cont_correlation": "c * (c - 1) / 2", "cont_cont_matrix": "c * c", "cont_cont_slopes": "c * (c - 1) / 2",
    "cont_cont_effects": "c * (c - 1) / 2", "cont_cat_correlation": "c * d", "cont_cat_matrix": "c * d", "cont_cat_effects": "c * d",
    "cat_cat_correlation": "d * (d - 1) / 2", "cat_cat_matrix": "d * d", "cat_cat_effects": "d * (d - 1) / 2",
}
_SECTIONS_SQL = PX_SQL + f""", k AS (SELECT {" + ".join(f"CAST(COUNT(DISTINCT {name}) > 5 AS INT)" for name in _NUMBERS)} AS c FROM px),
n AS (SELECT c, {len(REPORTED)} - c AS d FROM k) """ + " UNION ALL ".join(
    f"SELECT '{name}' AS section, CAST({rows} AS BIGINT) AS rows FROM n" for name, rows in _SECTION_ROWS.items()
)


@query("report_sections", _SECTIONS_SQL)
def q_report_sections(spark, folder):
    report = predictor_report(px(spark, folder), REPORTED, "z")
    written = report.write(scratch_folder(spark, "report"))
    rows = [
        spark.read.parquet(path).agg(F.lit(name).alias("section"), F.count("*").alias("rows"))
        for name, path in zip(report.sections, written)
    ]
    return reduce(DataFrame.unionByName, rows)


_TRAINED = {"value": "a", "user_id": "b"}


def _hits_sql(model, scores):
    return f"""SELECT '{model}' AS model, {sql_fixed("AVG(CAST(hit AS DOUBLE))", 6)} AS accuracy
    FROM (SELECT event_id, ARG_MAX(c, {scores}) = ANY_VALUE(code) AS hit FROM scored GROUP BY event_id)"""


@query("training_scores", f"""
WITH coded AS (SELECT event_id, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS code, value AS a, CAST(user_id AS DOUBLE) AS b
               FROM events),
classes AS (SELECT code AS c, LN(COUNT(*) / SUM(COUNT(*)) OVER ()) AS prior, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS va, VAR_POP(b) AS vb,
                   VAR_SAMP(a) AS aa, COVAR_SAMP(a, b) AS ab, VAR_SAMP(b) AS bb FROM coded GROUP BY code),
scored AS (SELECT event_id, code, c, prior - 0.5 * (LN(va) + LN(vb) + (a - ma) ** 2 / va + (b - mb) ** 2 / vb) AS independent,
                  prior - 0.5 * LN(aa * bb - ab * ab) - 0.5 * ((a - ma) ** 2 * bb - 2 * (a - ma) * (b - mb) * ab + (b - mb) ** 2 * aa)
                  / (aa * bb - ab * ab) AS joint FROM coded, classes)
{_hits_sql("naive_bayes", "independent")} UNION ALL {_hits_sql("quadratic_discriminant", "joint")}""")
def q_training_scores(spark, folder):
    scores = training_scores(table(spark, folder, "events"), list(_TRAINED), "event_type", "event_id", models=["naive_bayes", "quadratic_discriminant"])
    return fixed(scores, 6, "accuracy")
