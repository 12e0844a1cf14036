"""Kinds, association, effects and slope tests against brute force on small frames."""

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from predlens.functions.bins import Edges
from predlens.functions.tails import normal_two_sided, student_two_sided
from predlens.operators import association as A
from predlens.operators.effects import Effects, population
from predlens.operators.kinds import kinds_frame, predictor_kinds, response_kind
from predlens.operators.plotdata import binned
from predlens.operators.regression import logistic_tests, ols_slopes, ols_tests


def by_pair(df, value):
    return {(r["p1"], r["p2"]): r[value] for r in df.collect()}


# --- kinds ---


def test_kinds(spark):
    columns = {
        "flag": [0, 1, 0, 1, 0, 1, 0],
        "one_to_five": [1, 2, 3, 4, 5, 5, 5],
        "gap": [1, 2, 4, 1, 2, 4, 1],
        "six": [1, 2, 3, 4, 5, 6, 6],
        "halves": [0.0, 0.5, 1.0, 0.0, 0.5, 1.0, 1.0],
        "uneven": [0.0, 0.5, 2.0, 0.0, 0.5, 2.0, 2.0],  # gaps add up to distinct - 1
        "holes": [0, 1, None, 1, 0, 1, 0],
        "only_holes": [None] * 7,
        "text": list("aabbccd"),
        "truth": [True, False] * 3 + [True],
        "day": [dt.date(2020, 1, 1)] * 7,
        "near": [0.1 * i for i in range(7)],
    }
    schema = (
        "flag int, one_to_five bigint, gap int, six int, halves double, uneven double, holes int, only_holes int, "
        "text string, truth boolean, day date, near double"
    )
    df = spark.createDataFrame(list(zip(*columns.values())), schema)
    kinds = predictor_kinds(df, df.columns)
    categorical = {name for name, kind in kinds.items() if kind == "categorical"}
    assert categorical == {"flag", "one_to_five", "uneven", "text", "truth", "day"}
    assert [r["column"] for r in kinds_frame(df, ["flag", "six"]).collect()] == ["flag", "six"]
    assert response_kind(df, "flag") == "boolean" and response_kind(df, "truth") == "boolean"
    assert response_kind(df, "six") == "continuous"
    with pytest.raises(ValueError):
        response_kind(df, "text")
    with pytest.raises(ValueError):
        predictor_kinds(df.withColumn("list", F.array("flag")), ["list"])


# --- bins ---


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3)), min_size=1, max_size=40), st.integers(1, 12))
def test_edges_are_numpys(values, bins):
    edges = Edges.spanning(min(values), max(values), bins)
    assert np.allclose(edges.values(), np.histogram_bin_edges(values, bins=bins), rtol=1e-12)


@pytest.mark.parametrize("values", [[0.1 * i for i in range(31)], [1.0, 5.9, 10.8, 50.0], [3.0, 3.0], [0.7, 0.1, 0.3]])
def test_closed_bins_are_numpys(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts, _ = np.histogram(values, bins=10)
    ours = {r["bin"]: r["rows"] for r in binned(df, "x").collect()}
    assert ours == {i: c for i, c in enumerate(counts.tolist()) if c}


def test_open_bins_drop_the_maximum(spark):
    df = spark.createDataFrame([(float(v),) for v in range(16)], "x double")
    cells = binned(df, "x", bins=None).collect()
    assert Edges.sturges(0, 15, 16).count == 5 == len(np.histogram_bin_edges(range(16), bins="sturges")) - 1
    assert sum(r["rows"] for r in cells) == 15
    assert Edges.sturges(2, 2, 9).count == 1
    assert math.isclose(sum(r["proportion"] for r in binned(df, "x").collect()), 1)


# --- Pearson and least squares ---


@pytest.fixture(scope="module")
def numbers(spark):
    chance = np.random.default_rng(4)
    x = chance.normal(size=200)
    rows = zip(
        x.tolist(), (2 * x + chance.normal(size=200)).tolist(), chance.normal(size=200).tolist(), [1.0] * 200,
        (chance.uniform(size=200) < 1 / (1 + np.exp(-x))).astype(int).tolist(),
    )
    return spark.createDataFrame(list(rows), "x double, y double, u double, same double, hit int").cache()


def test_pearson(numbers):
    r = by_pair(A.pearson_pairs(numbers, ["x", "y", "u", "same"]), "r")
    pdf = numbers.toPandas()
    assert math.isclose(r["x", "y"], np.corrcoef(pdf.x, pdf.y)[0, 1], rel_tol=1e-9)
    assert math.isclose(r["y", "u"], np.corrcoef(pdf.y, pdf.u)[0, 1], rel_tol=1e-9)
    assert r["x", "same"] is None and len(r) == 6
    full = by_pair(A.symmetric(A.pearson_pairs(numbers, ["x", "y", "u"]), ["x", "y", "u"], "r"), "r")
    assert len(full) == 9 and full["u", "u"] == 1 and full["x", "y"] == full["y", "x"]
    wide = A.matrix(A.symmetric(A.pearson_pairs(numbers, ["x", "y"]), ["x", "y"], "r"), ["x", "y"], "r")
    assert {row["p1"]: row["x"] for row in wide.collect()}["x"] == 1


def test_slope_tests_are_mllibs(numbers):
    ours = {r["p1"]: r for r in ols_tests(numbers, [("x", "y"), ("u", "y"), ("same", "y")]).collect()}
    for name in ("x", "u"):
        rows = VectorAssembler(inputCols=[name], outputCol="f").transform(numbers)
        summary = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(rows).summary
        assert math.isclose(ours[name]["t_value"], summary.tValues[0], abs_tol=1e-6)
        assert math.isclose(ours[name]["p_value"], summary.pValues[0], rel_tol=1e-6, abs_tol=1e-14)
    assert ours["same"]["t_value"] is None and ours["same"]["p_value"] is None


def test_exact_line_has_no_t(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    assert ols_slopes(df, [("a", "b")]).first()["t"] is None


def test_logistic_tests_are_mllibs(numbers):
    ours = {r["predictor"]: r for r in logistic_tests(numbers, ["x", "u", "same"], "hit").collect()}
    for name in ("x", "u"):
        rows = VectorAssembler(inputCols=[name], outputCol="f").transform(numbers)
        summary = GeneralizedLinearRegression(
            family="binomial", link="logit", featuresCol="f", labelCol="hit", tol=1e-12, maxIter=50
        ).fit(rows).summary
        assert math.isclose(ours[name]["t_value"], summary.tValues[0], abs_tol=2e-6)
        assert math.isclose(ours[name]["p_value"], summary.pValues[0], rel_tol=1e-4, abs_tol=1e-12)
    assert ours["same"]["t_value"] is None


def test_logistic_needs_two_mixed_classes(spark):
    split = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "x double, y int")
    assert logistic_tests(split, ["x"], "y").first()["t_value"] is None
    with pytest.raises(ValueError):
        logistic_tests(split.withColumn("y", F.col("x")), ["x"], "y")


def test_tail_probabilities():
    # Table values of the t and the normal distribution.
    assert math.isclose(student_two_sided(2.228139, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(student_two_sided(12.70620, 1), 0.05, rel_tol=1e-5)
    assert math.isclose(student_two_sided(0.5, 1), 1 - 2 * math.atan(0.5) / math.pi, rel_tol=1e-12)
    assert student_two_sided(0, 5) == 1 and math.isnan(student_two_sided(1, 0))
    assert math.isclose(student_two_sided(1.959964, 2_000_000), 0.05, rel_tol=1e-4)
    assert math.isclose(normal_two_sided(1.959964), 0.05, rel_tol=1e-5)
    near, far = student_two_sided(3.0, 999_999), student_two_sided(3.0, 1_000_001)
    assert math.isclose(near, far, rel_tol=1e-6)


# --- correlation ratio ---


def eta(categories, values):
    groups = defaultdict(list)
    for c, v in zip(categories, values):
        if c is not None:
            groups[c].append(v)
    grand = sum(map(sum, groups.values())) / sum(map(len, groups.values()))
    between = sum(len(g) * (sum(g) / len(g) - grand) ** 2 for g in groups.values())
    return math.sqrt(between / sum((v - grand) ** 2 for v in values)) if between else 0.0


def test_correlation_ratio(spark):
    chance = random.Random(1)
    rows = [(chance.choice(["a", "b", None]), chance.randrange(3), chance.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "c string, k int, v double")
    ours = by_pair(A.correlation_ratio(df, ["c", "k"], ["v"]), "eta")
    for i, name in enumerate(("c", "k")):
        assert math.isclose(ours["v", name], eta([r[i] for r in rows], [r[2] for r in rows]), rel_tol=1e-9)


def test_equal_means_have_no_ratio(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 4.0)], "c string, v double")
    assert A.correlation_ratio(df, ["c"], ["v"]).first()["eta"] == 0


# --- crosstab measures ---


def crosstab_measures(pairs):
    """Dense-table formulas."""
    pairs = [tuple(0 if v is None else v for v in pair) for pair in pairs]
    cells, n = Counter(pairs), len(pairs)
    rows, columns = Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    r, c = len(rows), len(columns)
    offs = [(abs(cells[a, b] - rows[a] * columns[b] / n), rows[a] * columns[b] / n) for a in rows for b in columns]
    chi2 = sum(d * d / e for d, e in offs)
    raw = sum((d - min(0.5, d)) ** 2 / e for d, e in offs) if (r, c) == (2, 2) else chi2
    kept = max(0, chi2 / n - (r - 1) * (c - 1) / (n - 1))
    rr, cc = r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)

    def root(num, den):
        return math.sqrt(num / den) if den > 0 else None

    return {
        "cramers_v": root(kept, min(rr - 1, cc - 1)),
        "cramers_v_raw": root(raw / n, min(r - 1, c - 1)),
        "tschuprow_t": root(kept, math.sqrt(max(0, (rr - 1) * (cc - 1)))),
        "tschuprow_t_raw": root(raw / n, math.sqrt((r - 1) * (c - 1))),
    }


CROSSTABS = {
    "two_by_two": [("a", "x")] * 8 + [("a", "y")] * 3 + [("b", "x")] * 2 + [("b", "y")] * 9,
    "empty_cell_2x2": [("a", "x")] * 8 + [("a", "y")] * 3 + [("b", "y")] * 9,
    "perfect": [("a", "x")] * 5 + [("b", "y")] * 5 + [("c", "z")] * 5,
    "one_row": [("a", "x")] * 5 + [("a", "y")] * 5,
    "null_category": [(None, "x")] * 5 + [("b", "y")] * 5 + [("b", "x")] * 2 + [("c", "z")],
    "wide": [(str(i % 3), str(i % 7)) for i in range(50)] + [("0", "0")] * 9,
    "all_distinct": [(str(i), str(i)) for i in range(6)],
    "single": [("a", "x")],
}


@pytest.mark.parametrize("name", CROSSTABS)
def test_crosstab_measures(spark, name):
    pairs = CROSSTABS[name]
    df = spark.createDataFrame(pairs, "a string, b string")
    if name == "single":
        row = A.categorical_association(df, [("a", "b")]).first()
        assert row["cramers_v"] is None and row["tschuprow_t"] is None
        return
    row = A.categorical_association(df, [("a", "b")]).first()
    for measure, value in crosstab_measures(pairs).items():
        if value is None:
            assert row[measure] is None, measure
        else:
            assert math.isclose(row[measure], value, rel_tol=1e-9, abs_tol=1e-7), measure
            assert 0 <= row[measure] <= 1 + 1e-9


def test_missing_number_joins_category_zero(spark):
    df = spark.createDataFrame([(None, "x"), (0, "x"), (1, "y"), (1, "x")], "a int, b string")
    cells = {(r["b1"], r["b2"]): r["o"] for r in A.contingency(df, [("a", "b")]).collect()}
    assert cells == {("0", "x"): 2, ("1", "x"): 1, ("1", "y"): 1}


# --- response effects ---


@pytest.fixture(scope="module")
def survey(spark):
    chance = random.Random(9)
    rows = [
        (
            chance.choice([chance.gauss(0, 1), None]), float(chance.randrange(30)),
            chance.choice(["a", "b", "c", None]), chance.choice([1, 2]), chance.choice([0.0, 1.0, None]),
        )
        for _ in range(150)
    ]
    return spark.createDataFrame(rows, "x double, w double, c string, k int, y double").cache()


def square_sums(cells, mean, size, weights):
    squares = {key: (sum(ys) / len(ys) - mean) ** 2 for key, ys in cells.items() if ys}
    return sum(squares.values()) / size, sum(weights[key] * s for key, s in squares.items())


def brute_effect(rows, places, size):
    """Effect of a grouping given by a function from row to place (None: no place)."""
    known = [r["y"] for r in rows if r["y"] is not None]
    mean = sum(known) / len(known)
    cells, counts = defaultdict(list), Counter()
    for r in rows:
        place = places(r)
        if place is not None:
            counts[place] += 1
            cells[place] += [] if r["y"] is None else [r["y"]]
    weights = {p: n / len(rows) for p, n in counts.items()}
    return square_sums(cells, mean, size, weights), {p: len(ys) / len(rows) for p, ys in cells.items()}, cells, mean


def ten(values, closed=True, bins=10):
    known = [v for v in values if v is not None]
    edges = np.histogram_bin_edges(known, bins=bins)

    def place(v):
        if v is None or (not closed and v >= edges[-1]):
            return None
        return min(int(np.searchsorted(edges, v, side="right")) - 1, len(edges) - 2)

    return place, len(edges) - 1


def test_single_effects(survey):
    rows = survey.collect()
    effects = Effects.of(survey, "y", ["x", "w"], ["c", "k"])
    ours = {r["predictor"]: (r["msd"], r["wmsd"]) for r in effects.single().collect()}
    for name in ("x", "w"):
        place, _ = ten([r[name] for r in rows])
        assert np.allclose(ours[name], brute_effect(rows, lambda r: place(r[name]), 10)[0])
    for name in ("c", "k"):
        size = len({r[name] for r in rows})
        _, shares, cells, mean = brute_effect(rows, lambda r: r[name], size)
        assert np.allclose(ours[name], square_sums(cells, mean, size, shares))


def test_paired_effects(survey):
    rows = survey.collect()
    effects = Effects.of(survey, "y", ["x", "w"], ["c", "k"])
    ours = {(r["p1"], r["p2"]): (r["msd"], r["wmsd"]) for r in effects.paired(digits=9).collect()}
    assert len(ours) == 6
    labels = {name: len({r[name] for r in rows}) for name in ("c", "k")}

    def both(first, second):
        return lambda r: None if first(r) is None or second(r) is None else (first(r), second(r))

    (tx, _), (tw, _) = ten([r["x"] for r in rows]), ten([r["w"] for r in rows])
    expected = {("x", "w"): brute_effect(rows, both(lambda r: tx(r["x"]), lambda r: tw(r["w"])), 100)[0]}
    for a in ("x", "w"):
        place, bins = ten([r[a] for r in rows], closed=False, bins="sturges")
        for c in ("c", "k"):
            expected[a, c] = brute_effect(
                rows, both(lambda r: place(r[a]), lambda r: r[c]), bins * labels[c]
            )[0]
    expected["c", "k"] = brute_effect(rows, both(lambda r: r["c"], lambda r: r["k"]), labels["c"] * labels["k"])[0]
    for pair, values in expected.items():
        assert np.allclose(ours[pair], values, atol=1e-8), pair


def test_grid(survey):
    effects = Effects.of(survey, "y", ["w"], ["k"])
    seen = population(survey, "y", ["w"])
    cells = effects.grid().collect()
    step = seen.sturges("w").step
    for cell in cells:
        assert math.isclose(cell["center1"], seen.sturges("w").lo + (int(cell["b1"]) + 0.5) * step)
        assert cell["center2"] is None
        if cell["mean"] is not None:
            assert math.isclose(cell["residual"], cell["mean"] - seen.mean, abs_tol=1e-12)
    # All rows but those at the maximum have a cell.
    assert sum(cell["rows"] for cell in cells) == survey.filter("w < 29").count()


def test_constant_predictor_and_many_columns(spark):
    rows = [(1.0, *[float((i * j) % 17) for j in range(1, 13)], i % 2) for i in range(40)]
    names = ["same", *[f"n{j}" for j in range(1, 13)]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", y int")
    effects = Effects.of(df, "y", names, [])  # 78 pairs: several passes
    single = {r["predictor"]: r["wmsd"] for r in effects.single().collect()}
    assert math.isclose(single["same"], 0, abs_tol=1e-12)
    assert effects.paired().count() == 78
    alone = Effects.of(df, "y", ["n3", "n7"], []).paired().first()
    together = effects.paired().filter("p1 = 'n3' AND p2 = 'n7'").first()
    assert (alone["msd"], alone["wmsd"]) == (together["msd"], together["wmsd"])


def test_logistic_status(spark):
    """Predictors without a test have a reason, and do not hinder the others."""
    random = np.random.default_rng(4)
    rows = []
    for i in range(400):
        y = int(random.random() < 0.4)
        x = random.normal() + y
        far = 1e6 if i == 0 else x  # a far value makes the plain step overshoot
        rows.append((float(y), x, 5.0, y * 2.0, y * 1.0 if i else 0.5, far, None if y else 1.0))
    df = spark.createDataFrame(rows, "y double, plain double, same double, apart double, touching double, far double, lone double")
    found = {r["predictor"]: r for r in logistic_tests(df, ["plain", "same", "apart", "touching", "far", "lone"], "y").collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        "plain": "ok", "same": "constant", "apart": "separated", "touching": "separated", "far": "ok", "lone": "one class",
    }
    assert all((r["t_value"] is None) == (r["p_value"] is None) == (r["status"] != "ok") for r in found.values())
    # The damped fit is the maximum: no place nearby is likelier.
    x = np.array([r[5] for r in rows])
    y = np.array([r[0] for r in rows])
    z = (x - x.mean()) / x.std()
    loss = lambda a, b: (np.logaddexp(0, a + b * z) - y * (a + b * z)).sum()
    grid = [(loss(a, b), b) for a in np.linspace(-1, 0.5, 31) for b in np.linspace(-60, 60, 121)]
    assert np.sign(min(grid)[1]) == np.sign(found["far"]["t_value"])
