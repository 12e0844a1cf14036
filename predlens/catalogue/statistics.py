"""Kinds, association, effects and slope tests over the derived part frame."""

from itertools import combinations

from pyspark.sql import functions as F

from predlens.catalogue.parts import PX_SQL, px
from predlens.catalogue.registry import fixed, query, sql_even, sql_fixed, table
from predlens.functions.scalars import pair_label
from predlens.operators import association as A
from predlens.operators.effects import Effects
from predlens.operators.kinds import kinds_frame, predictor_kinds, response_kind
from predlens.operators.ordering import ranked, with_position
from predlens.operators.regression import logistic_tests, ols_slopes, ols_tests
from predlens.plans.report import predictor_report

# --- kinds ---

KIND_COLUMNS = {
    "lineitem": ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate"],
    "events": ["event_type", "value", "user_id", "ts"],
    "embeddings": ["label"],
    "labels": ["quality", "toxic"],
    "nation": ["n_regionkey", "n_nationkey"],
}
_TEXT = {"l_returnflag", "l_shipdate", "event_type", "ts"}


def _kind_sql(source, column):
    few = f"COUNT(*) = COUNT({column}) AND COUNT(DISTINCT {column}) <= 5"
    gaps = f"MAX({column}) - MIN({column}) = COUNT(DISTINCT {column}) - 1"
    kind = "MIN('categorical')" if column in _TEXT else (
        f"CASE WHEN {few} AND {gaps} THEN 'categorical' ELSE 'continuous' END"
    )
    return f"SELECT '{source}' AS source, '{column}' AS \"column\", {kind} AS kind FROM {source}"


@query(
    "predictor_kinds",
    " UNION ALL ".join(_kind_sql(source, c) for source, columns in KIND_COLUMNS.items() for c in columns)
    + """ UNION ALL SELECT 'labels', 'quality as response', CASE WHEN COUNT(*) FILTER (quality NOT IN (0, 1)) = 0
          THEN 'boolean' ELSE 'continuous' END FROM labels
          UNION ALL SELECT 'lineitem', 'l_tax as response', CASE WHEN COUNT(*) FILTER (l_tax NOT IN (0, 1)) = 0
          THEN 'boolean' ELSE 'continuous' END FROM lineitem""",
)
def q_predictor_kinds(spark, folder):
    result = None
    for source, columns in KIND_COLUMNS.items():
        part = kinds_frame(table(spark, folder, source), columns).select(F.lit(source).alias("source"), "*")
        result = part if result is None else result.unionByName(part)
    responses = [
        (source, f"{column} as response", response_kind(table(spark, folder, source), column))
        for source, column in (("labels", "quality"), ("lineitem", "l_tax"))
    ]
    return result.unionByName(spark.createDataFrame(responses, result.schema))


# --- Pearson ---

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_sql(columns, source):
    pairs = combinations(columns, 2)
    return " UNION ALL ".join(
        f"SELECT '{a}' AS p1, '{b}' AS p2, {sql_fixed(f'CORR({b}, {a})', 7)} AS r FROM {source}" for a, b in pairs
    )


@query("pearson_pairs", _corr_sql(LINE_NUMBERS, "lineitem"))
def q_pearson_pairs(spark, folder):
    return fixed(A.pearson_pairs(table(spark, folder, "lineitem"), LINE_NUMBERS), 7, "r")


PX_NUMBERS = ["p_size", "p_retailprice", "z", "area"]


@query(
    "pearson_matrix",
    f"""{PX_SQL}, pairs AS ({_corr_sql(PX_NUMBERS, "px")})
SELECT p1, p2, r FROM pairs UNION ALL SELECT p2, p1, r FROM pairs
UNION ALL SELECT c, c, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in PX_NUMBERS)}) t(c)""",
)
def q_pearson_matrix(spark, folder):
    pairs = fixed(A.pearson_pairs(px(spark, folder), PX_NUMBERS), 7, "r")
    return A.symmetric(pairs, PX_NUMBERS, "r")


# --- correlation ratio ---

ETA_CATEGORIES, ETA_VALUES = ["hl", "q4", "p_brand", "brand"], ["z", "p_size", "area"]


def _eta_sql(category, value):
    return f"""
SELECT '{value}' AS p1, '{category}' AS p2, {sql_fixed('''CASE WHEN SUM(n * (m - grand) ** 2) = 0 THEN 0
       ELSE SQRT(SUM(n * (m - grand) ** 2) / MAX(total)) END''', 7)} AS eta
FROM (SELECT {category}, COUNT({value}) AS n, AVG({value}) AS m FROM px WHERE {category} IS NOT NULL GROUP BY ALL),
     (SELECT AVG({value}) FILTER ({category} IS NOT NULL) AS grand FROM px),
     (SELECT SUM(({value} - g) ** 2) AS total
      FROM px, (SELECT AVG({value}) FILTER ({category} IS NOT NULL) AS g FROM px))"""


@query("corr_ratio", PX_SQL + " UNION ALL ".join(_eta_sql(c, v) for c in ETA_CATEGORIES for v in ETA_VALUES))
def q_corr_ratio(spark, folder):
    return fixed(A.correlation_ratio(px(spark, folder), ETA_CATEGORIES, ETA_VALUES), 7, "eta")


# --- crosstab measures ---

CROSS_PAIRS = [("q4", "g9"), ("hl", "q4"), ("big", "dear"), ("hl", "brand"), ("q4", "brand")]


def _filled(column):
    return f"COALESCE({column}, '0')" if column == "brand" else column


def _cross_sql(a, b, outputs):
    return f"""
SELECT '{a}' AS p1, '{b}' AS p2, {outputs}
FROM (SELECT r, c, n, chi2 / n - (r - 1) * (c - 1) / (n - 1) AS kept, chi2, yates,
             r - 1 - (r - 1) ** 2 / (n - 1) AS rr, c - 1 - (c - 1) ** 2 / (n - 1) AS cc
      FROM (SELECT COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS c, MAX(n) AS n, SUM((o - e) ** 2 / e) AS chi2,
                   SUM((ABS(o - e) - LEAST(0.5, ABS(o - e))) ** 2 / e) AS yates
            FROM (SELECT ra.a, rb.b, n, COALESCE(o, 0) AS o, oa * ob / n AS e
                  FROM (SELECT {_filled(a)} AS a, COUNT(*) AS oa FROM px GROUP BY ALL) ra
                  CROSS JOIN (SELECT {_filled(b)} AS b, COUNT(*) AS ob FROM px GROUP BY ALL) rb
                  CROSS JOIN (SELECT COUNT(*) AS n FROM px)
                  LEFT JOIN (SELECT {_filled(a)} AS a, {_filled(b)} AS b, COUNT(*) AS o FROM px GROUP BY ALL) cell
                    ON cell.a = ra.a AND cell.b = rb.b)))"""


def _cross(outputs):
    return PX_SQL + " UNION ALL ".join(_cross_sql(a, b, outputs) for a, b in CROSS_PAIRS)


_RAW = "CASE WHEN r = 2 AND c = 2 THEN yates ELSE chi2 END"


@query("cramers_v", _cross(f"{sql_fixed('SQRT(GREATEST(0, kept) / LEAST(rr, cc))', 7)} AS cramers_v"))
def q_cramers_v(spark, folder):
    measures = A.categorical_association(px(spark, folder), CROSS_PAIRS)
    return fixed(measures.select("p1", "p2", "cramers_v"), 7, "cramers_v")


@query("cramers_v_raw", _cross(f"{sql_fixed(f'SQRT({_RAW} / n / (LEAST(r, c) - 1))', 7)} AS cramers_v_raw"))
def q_cramers_v_raw(spark, folder):
    measures = A.categorical_association(px(spark, folder), CROSS_PAIRS)
    return fixed(measures.select("p1", "p2", "cramers_v_raw"), 7, "cramers_v_raw")


@query(
    "tschuprow_t",
    _cross(
        f"{sql_fixed('SQRT(GREATEST(0, kept) / SQRT(rr * cc))', 7)} AS tschuprow_t, "
        f"{sql_fixed(f'SQRT({_RAW} / n / SQRT((r - 1) * (c - 1)))', 7)} AS tschuprow_t_raw"
    ),
)
def q_tschuprow_t(spark, folder):
    measures = A.categorical_association(px(spark, folder), CROSS_PAIRS)
    return fixed(measures.select("p1", "p2", "tschuprow_t", "tschuprow_t_raw"), 7, "tschuprow_t", "tschuprow_t_raw")


@query(
    "yates_2x2",
    _cross(
        f"r, c, n, {sql_fixed('chi2', 6)} AS chi2, {sql_fixed(_RAW, 6)} AS chi2_yates"
    ),
)
def q_yates(spark, folder):
    return fixed(A.chi_square(px(spark, folder), CROSS_PAIRS), 6, "chi2", "chi2_yates")


CAT_MATRIX = ["hl", "q4", "big", "dear"]


@query(
    "cramers_matrix",
    PX_SQL + ", pairs AS ("
    + " UNION ALL ".join(
        _cross_sql(a, b, f"{sql_fixed('SQRT(GREATEST(0, kept) / LEAST(rr, cc))', 7)} AS v")
        for a, b in combinations(CAT_MATRIX, 2)
    )
    + f""")
SELECT p1, p2, v FROM pairs UNION ALL SELECT p2, p1, v FROM pairs
UNION ALL SELECT c, c, 1.0 FROM (VALUES {", ".join(f"('{c}')" for c in CAT_MATRIX)}) t(c)""",
)
def q_cramers_matrix(spark, folder):
    measures = A.categorical_association(px(spark, folder), A.column_pairs(CAT_MATRIX))
    pairs = fixed(measures.select("p1", "p2", F.col("cramers_v").alias("v")), 7, "v")
    return A.symmetric(pairs, CAT_MATRIX, "v")


# --- slope tests ---

OLS_PAIRS = [("p_size", "z"), ("p_retailprice", "z"), ("area", "z"), ("p_size", "area")]


def _ols_sql(x, y, source="px"):
    t = f"""REGR_SLOPE({y}, {x}) / SQRT(((REGR_SYY({y}, {x}) - REGR_SXY({y}, {x}) ** 2 / REGR_SXX({y}, {x}))
            / (REGR_COUNT({y}, {x}) - 2)) / REGR_SXX({y}, {x}))"""
    return f"""SELECT '{x}' AS p1, '{y}' AS p2, CAST(REGR_COUNT({y}, {x}) AS BIGINT) AS n,
        {sql_fixed(t, 5)} AS t FROM {source}"""


@query(
    "ols_t",
    PX_SQL + " UNION ALL ".join(
        [_ols_sql(x, y) for x, y in OLS_PAIRS] + [_ols_sql("l_quantity", "l_extendedprice", "lineitem")]
    ),
)
def q_ols_t(spark, folder):
    lines = ols_slopes(table(spark, folder, "lineitem"), [("l_quantity", "l_extendedprice")])
    slopes = ols_slopes(px(spark, folder), OLS_PAIRS).unionByName(lines)
    return fixed(slopes.select("p1", "p2", "n", "t"), 5, "t")


# Simpson's rule over x = t + u / (1 - u), u from 0 to 1.
_NODES = 4000


def _tail_sql(density, t):
    """Twice the integral of a density from ``t`` on; ``density`` makes its SQL from that of a place."""
    u = f"(i / {_NODES}.0)"
    value = density(f"(ABS({t}) + {u} / (1 - {u}))")
    weight = "CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"2 * list_sum(list_transform(range({_NODES}), lambda i: {weight} * {value} / ((1 - {u}) * (1 - {u})))) / (3 * {_NODES})"


def _student_sql(t, freedom):
    front = f"EXP(LGAMMA(({freedom} + 1) / 2.0) - LGAMMA({freedom} / 2.0)) / SQRT({freedom} * PI())"
    return _tail_sql(lambda x: f"{front} * POW(1 + {x} * {x} / {freedom}, -({freedom} + 1) / 2.0)", t)


def _normal_sql(z):
    return _tail_sql(lambda x: f"EXP(-{x} * {x} / 2) / SQRT(2 * PI())", z)


def _ols_p_sql(x, y, source="px"):
    return f"""SELECT '{x}' AS p1, '{y}' AS p2, CORR({y}, {x}) AS r, CAST(REGR_COUNT({y}, {x}) AS BIGINT) - 2 AS v FROM {source}"""


@query(
    "ols_p",
    PX_SQL + ", pairs AS (" + " UNION ALL ".join(
        [_ols_p_sql(x, y) for x, y in OLS_PAIRS] + [_ols_p_sql(x, y, "lineitem") for x, y in A.column_pairs(LINE_NUMBERS)]
    ) + f"""), tested AS (SELECT *, r * SQRT(v / (1 - r * r)) AS t FROM pairs)
    SELECT p1, p2, {sql_even('t', 6)} AS t_value, {sql_fixed(_student_sql('t', 'v'), 6)} AS p_value FROM tested""",
)
def q_ols_p(spark, folder):
    lines = ols_tests(table(spark, folder, "lineitem"), A.column_pairs(LINE_NUMBERS))
    return fixed(ols_tests(px(spark, folder), OLS_PAIRS).unionByName(lines), 6, "p_value")


LOGIT_PREDICTORS = ["p_size", "z", "p_retailprice", "area"]
_STEPS = 12


def _newton_sql(predictor):
    """Newton's method for one predictor as a chain of one-row tables."""
    tables = [
        f"""{predictor}_d AS MATERIALIZED (
    SELECT y, ({predictor} - m) / s AS x FROM px,
           (SELECT AVG({predictor}) AS m, STDDEV_POP({predictor}) AS s FROM px)
    WHERE {predictor} IS NOT NULL)""",
        f"{predictor}_0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS z)",
    ]
    for step in range(1, _STEPS + 1):
        tables.append(f"""{predictor}_{step} AS MATERIALIZED (
    SELECT a + (w * g - v * h) / (u * w - v * v) AS a, b + (u * h - v * g) / (u * w - v * v) AS b,
           b / SQRT(u / (u * w - v * v)) AS z
    FROM (SELECT ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, SUM(y - mu) AS g, SUM((y - mu) * x) AS h,
                 SUM(mu * (1 - mu)) AS u, SUM(mu * (1 - mu) * x) AS v, SUM(mu * (1 - mu) * x * x) AS w
          FROM (SELECT *, 1 / (1 + EXP(-(a + b * x))) AS mu FROM {predictor}_d, {predictor}_{step - 1})))""")
    return ", ".join(tables)


@query(
    "logit_z",
    PX_SQL + "".join(", " + _newton_sql(p) for p in LOGIT_PREDICTORS) + " "
    + " UNION ALL ".join(
        f"SELECT '{p}' AS predictor, {sql_fixed('z', 6)} AS t_value FROM {p}_{_STEPS}" for p in LOGIT_PREDICTORS
    ),
)
def q_logit_z(spark, folder):
    return logistic_tests(px(spark, folder), LOGIT_PREDICTORS, "y").select("predictor", "t_value")


@query(
    "logit_zp",
    PX_SQL + "".join(", " + _newton_sql(p) for p in LOGIT_PREDICTORS) + " UNION ALL ".join(
        f" SELECT '{p}' AS predictor, {sql_fixed('z', 6)} AS t_value, {sql_fixed(_normal_sql('z'), 6)} AS p_value FROM {p}_{_STEPS}"
        for p in LOGIT_PREDICTORS
    ),
)
def q_logit_zp(spark, folder):
    return fixed(logistic_tests(px(spark, folder), LOGIT_PREDICTORS, "y").drop("status"), 6, "p_value")


# --- difference with the mean of the response ---


def _edges_sql(x, bins, alias):
    return f"""(SELECT CAST(MIN({x}) AS DOUBLE) AS lo_{alias},
        (CAST(MAX({x}) AS DOUBLE) - CAST(MIN({x}) AS DOUBLE)) / {bins} AS step_{alias},
        CAST(MAX({x}) AS DOUBLE) AS hi_{alias} FROM px)"""


def _ten_sql(x, alias):
    steps = " + ".join(f"CAST({x} >= {i} * step_{alias} + lo_{alias} AS INT)" for i in range(1, 10))
    return f"CASE WHEN {x} IS NOT NULL THEN {steps} END"


def _cont_sql(x, y="y"):
    return f"""
SELECT '{x}' AS predictor, {sql_fixed('SUM((m - pm) ** 2) / 10', 7)} AS msd,
       {sql_fixed('SUM((m - pm) ** 2 * c / n)', 7)} AS wmsd
FROM (SELECT {_ten_sql(x, 'a')} AS bin, AVG({y}) AS m, COUNT(*) AS c
      FROM px, {_edges_sql(x, 10, 'a')} GROUP BY ALL),
     (SELECT AVG({y}) AS pm, COUNT(*) AS n FROM px)
WHERE bin IS NOT NULL"""


def _cat_sql(c, y="y"):
    return f"""
SELECT '{c}' AS predictor, {sql_fixed(f'SUM((m - pm) ** 2) FILTER ({c} IS NOT NULL) / COUNT(*)', 7)} AS msd,
       {sql_fixed(f'SUM((m - pm) ** 2 * c / n) FILTER ({c} IS NOT NULL)', 7)} AS wmsd
FROM (SELECT {c}, AVG({y}) AS m, COUNT({y}) AS c FROM px GROUP BY ALL),
     (SELECT AVG({y}) AS pm, COUNT(*) AS n FROM px)"""


CONTINUOUS, CATEGORICAL = ["p_size", "p_retailprice", "z", "area"], ["hl", "q4", "brand"]


@query("dmr_cont", PX_SQL + " UNION ALL ".join(_cont_sql(x) for x in CONTINUOUS))
def q_dmr_cont(spark, folder):
    return fixed(Effects.of(px(spark, folder), "y", CONTINUOUS, [], pairs=False).single(), 7, "msd", "wmsd")


@query("dmr_cat", PX_SQL + " UNION ALL ".join(_cat_sql(c) for c in CATEGORICAL))
def q_dmr_cat(spark, folder):
    return fixed(Effects.of(px(spark, folder), "y", [], CATEGORICAL, pairs=False).single(), 7, "msd", "wmsd")


_EFFECT = f"""{sql_even('SUM((m - pm) ** 2) / MAX(size)', 3)} AS msd,
       {sql_even('SUM((m - pm) ** 2 * c / n)', 3)} AS wmsd"""


def _cont_cont_sql(a, b, outputs=_EFFECT, group=True):
    return f"""
SELECT '{a}' AS p1, '{b}' AS p2, {outputs}
FROM (SELECT {_ten_sql(a, 'a')} AS b1, {_ten_sql(b, 'b')} AS b2, AVG(y) AS m, COUNT(*) AS c, 100 AS size
      FROM px, {_edges_sql(a, 10, 'a')}, {_edges_sql(b, 10, 'b')} GROUP BY ALL),
     (SELECT AVG(y) AS pm, COUNT(*) AS n FROM px)
WHERE b1 IS NOT NULL AND b2 IS NOT NULL"""


def _sturges_sql(x):
    """Bin index by comparing with every inner edge; the number of bins depends on the data."""
    return f"""SELECT * FROM px,
    (SELECT lo, hi, k, (hi - lo) / k AS step FROM (
        SELECT CAST(MIN({x}) AS DOUBLE) AS lo, CAST(MAX({x}) AS DOUBLE) AS hi,
               CAST(CEIL(LOG2(COUNT({x})) + 1) AS INT) AS k FROM px))"""


def _cont_cat_sql(a, c, outputs=_EFFECT):
    return f"""
SELECT '{a}' AS p1, '{c}' AS p2, {outputs}
FROM (SELECT bin AS b1, {c} AS b2, AVG(y) AS m, COUNT(*) AS c, MAX(k) * ANY_VALUE(labels) AS size
      FROM (SELECT *, LEN(LIST_FILTER(RANGE(1, k), lambda i: {a} >= i * step + lo)) AS bin FROM ({_sturges_sql(a)})
            WHERE {a} < hi),
           (SELECT COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS labels FROM px)
      WHERE {c} IS NOT NULL GROUP BY ALL),
     (SELECT AVG(y) AS pm, COUNT(*) AS n FROM px)"""


def _cat_cat_sql(a, b, outputs=_EFFECT):
    labels = " * ".join(
        f"(SELECT COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM px)" for c in (a, b)
    )
    return f"""
SELECT '{a}' AS p1, '{b}' AS p2, {outputs}
FROM (SELECT {a} AS b1, {b} AS b2, AVG(y) AS m, COUNT(*) AS c, {labels} AS size FROM px
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}),
     (SELECT AVG(y) AS pm, COUNT(*) AS n FROM px)"""


def _paired(spark, folder, kind):
    effects = Effects.of(px(spark, folder), "y", CONTINUOUS, CATEGORICAL)
    return effects.paired().filter(F.col("kind") == kind).drop("kind")


@query("dmr_cont_cont", PX_SQL + " UNION ALL ".join(_cont_cont_sql(a, b) for a, b in combinations(CONTINUOUS, 2)))
def q_dmr_cont_cont(spark, folder):
    return _paired(spark, folder, "cont_cont")


@query("dmr_cont_cat", PX_SQL + " UNION ALL ".join(_cont_cat_sql(a, c) for a in CONTINUOUS for c in CATEGORICAL))
def q_dmr_cont_cat(spark, folder):
    return _paired(spark, folder, "cont_cat")


@query("dmr_cat_cat", PX_SQL + " UNION ALL ".join(_cat_cat_sql(a, b) for a, b in combinations(CATEGORICAL, 2)))
def q_dmr_cat_cat(spark, folder):
    return _paired(spark, folder, "cat_cat")


_GRID = f"""CAST(b1 AS VARCHAR) AS b1, CAST(b2 AS VARCHAR) AS b2, {sql_fixed('m', 7)} AS mean,
    {sql_fixed('m - pm', 7)} AS residual, c AS rows, {sql_even('c / n', 3)} AS proportion"""


def _center_sql(side, x=None, bins="10"):
    """The center of the bin ``side`` of a column; NULL for a category."""
    if x is None:
        return f"CAST(NULL AS DOUBLE) AS center{side[1]}"
    ends = f"(SELECT CAST(MIN({x}) AS DOUBLE) FROM px)", f"(SELECT CAST(MAX({x}) AS DOUBLE) FROM px)"
    return sql_fixed(f"{ends[0]} + ({side} + 0.5) * ({ends[1]} - {ends[0]}) / {bins}", 7) + f" AS center{side[1]}"


def _grid_sql(a, b, kind):
    sturges = f"(SELECT CEIL(LOG2(COUNT({a})) + 1) FROM px)"
    centers = {
        "cont_cont": (_center_sql("b1", a), _center_sql("b2", b)),
        "cont_cat": (_center_sql("b1", a, sturges), _center_sql("b2")),
        "cat_cat": (_center_sql("b1"), _center_sql("b2")),
    }[kind]
    cells = {"cont_cont": _cont_cont_sql, "cont_cat": _cont_cat_sql, "cat_cat": _cat_cat_sql}[kind]
    return cells(a, b, f"'{kind}' AS kind, {', '.join(centers)}, {_GRID}")


@query(
    "dmr_grid",
    PX_SQL + " UNION ALL ".join(
        [_grid_sql("p_size", "p_retailprice", "cont_cont"), _grid_sql("hl", "q4", "cat_cat")]
        + [_grid_sql(a, c, "cont_cat") for a in ("p_size", "p_retailprice") for c in ("hl", "q4")]
    ),
)
def q_dmr_grid(spark, folder):
    effects = Effects.of(px(spark, folder), "y", ["p_size", "p_retailprice"], ["hl", "q4"])
    return fixed(effects.grid(), 7, "mean", "residual", "center1", "center2")


# --- ordered pair tables ---


@query(
    "pairs_by_strength",
    f"""{PX_SQL}, pairs AS ({_corr_sql(PX_NUMBERS, "px")})
SELECT p1, p2, concat(p1, ' and ', p2) AS predictors, r, ABS(r) AS strength,
       ROW_NUMBER() OVER (ORDER BY ABS(r) DESC NULLS LAST, p1, p2) AS place
FROM pairs""",
)
def q_pairs_by_strength(spark, folder):
    pairs = fixed(A.pearson_pairs(px(spark, folder), PX_NUMBERS), 7, "r")
    strong = pairs.select(
        "p1", "p2", pair_label(F.col("p1"), F.col("p2")).alias("predictors"), "r", F.abs("r").alias("strength")
    )
    placed = with_position(strong.withColumn("_weak", -F.col("strength")), ["_weak", "p1", "p2"], "place")
    return ranked(placed.drop("_weak"), "strength", "p1", "p2")


# --- the ranking table without the forest's part ---

RANKED_CONT, RANKED_CAT = ["p_size", "p_retailprice", "z"], ["hl", "q4", "p_brand"]


def _ranking_sql(continuous, categorical):
    """The ranking table but for the importance."""
    tested = [
        f"""SELECT predictor, 'continuous' AS kind, msd, wmsd, {sql_fixed('z', 6)} AS t_value, {sql_fixed(_normal_sql('z'), 6)} AS p_value
            FROM ({_cont_sql(p)}), {p}_{_STEPS}""" for p in continuous
    ]
    untested = [
        f"SELECT predictor, 'categorical' AS kind, msd, wmsd, NULL AS t_value, NULL AS p_value FROM ({_cat_sql(c)})" for c in categorical
    ]
    return PX_SQL + "".join(", " + _newton_sql(p) for p in continuous) + f" SELECT * FROM ({' UNION ALL '.join(tested + untested)})"


def _ranking(spark, folder, predictors):
    ranking = predictor_report(px(spark, folder), predictors, "y").sections["ranking"]
    return fixed(fixed(ranking.drop("importance"), 7, "msd", "wmsd"), 6, "p_value")


@query("rank_table", _ranking_sql(RANKED_CONT, RANKED_CAT))
def q_rank_table(spark, folder):
    return _ranking(spark, folder, [*RANKED_CONT, *RANKED_CAT])


# The forest's part: shares of the continuous predictors, of which the price alone says nothing on the response.
_IMPORTANCE_SQL = """CASE WHEN kind = 'continuous' THEN CAST(1 AS DOUBLE) END AS shares,
    CASE WHEN kind = 'continuous' THEN predictor <> 'p_retailprice' END AS above_price"""


@query("rank_report", f"SELECT *, {_IMPORTANCE_SQL} FROM ({_ranking_sql(RANKED_CONT, RANKED_CAT)})")
def q_rank_report(spark, folder):
    """The whole ranking: the importances add up to 1, and every other predictor's is above twice the price's."""
    ranking = predictor_report(px(spark, folder), [*RANKED_CONT, *RANKED_CAT], "y").sections["ranking"]
    price = F.max(F.when(F.col("predictor") == "p_retailprice", F.col("importance")))
    totals = ranking.agg(F.sum("importance").alias("_total"), price.alias("_price"))
    both = ranking.crossJoin(F.broadcast(totals))  # one row
    shown = both.withColumns({
        "shares": F.when(F.col("importance").isNotNull(), F.col("_total")),
        "above_price": F.col("importance") > 2 * F.col("_price"),
    })
    return fixed(fixed(shown.drop("importance", "_total", "_price"), 7, "msd", "wmsd"), 6, "p_value", "shares")


@query(
    "eta_matrix",
    PX_SQL + f", eta AS ({' UNION ALL '.join(_eta_sql(c, v) for c in ETA_CATEGORIES for v in ETA_VALUES)}) SELECT p1, "
    + ", ".join(f"MAX(eta) FILTER (p2 = '{c}') AS {c}" for c in ETA_CATEGORIES) + " FROM eta GROUP BY p1",
)
def q_eta_matrix(spark, folder):
    ratios = fixed(A.correlation_ratio(px(spark, folder), ETA_CATEGORIES, ETA_VALUES), 7, "eta")
    return A.matrix(ratios, ETA_CATEGORIES, "eta")
