"""The aggregates behind the plots; drawing them is left to the reader of the frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from predlens.functions.bins import Edges, bin_center, closed_bin, edge_columns, half_open_bin
from predlens.session import durable

BINS = 10


def ranges_of(df: DataFrame, *values: str) -> tuple[int, list[tuple[float | None, float | None, int]]]:
    """The number of rows, and minimum, maximum and number of the known values of each column, in one pass."""
    columns = [F.col(f"`{value}`").cast("double") for value in values]
    found = tuple(df.agg(F.count("*"), *[measure(x) for x in columns for measure in (F.min, F.max, F.count)]).first())
    return found[0], [found[i : i + 3] for i in range(1, len(found), 3)]


def binned(df: DataFrame, value: str, response: str | None = None, bins: int | None = BINS) -> DataFrame:
    """Count (and mean response) per equal-width bin with bin center and share of all rows.

    ``bins=None`` takes Sturges' number of bins, which are open on the right.
    """
    total, [(lo, hi, rows)] = ranges_of(df, value)
    x = F.col(f"`{value}`")
    if bins is None:
        edges = Edges.sturges(lo, hi, rows)
        index = half_open_bin(x, edges)
    else:
        edges = Edges.spanning(lo, hi, bins)
        index = closed_bin(x, edges)
    measures = [F.count("*").alias("rows")]
    if response is not None:
        measures.append(F.avg(response).alias("mean"))
    cells = df.withColumn("bin", index).filter(F.col("bin").isNotNull()).groupBy("bin").agg(*measures)
    return cells.select(
        "*", bin_center(F.col("bin"), edges).alias("center"), (F.col("rows") / total).alias("proportion")
    )


def binned_2d(df: DataFrame, first: str, second: str, response: str, bins: int = BINS) -> DataFrame:
    """Count and mean response per cell of a grid of equal-width bins."""
    one, two = [Edges.spanning(lo, hi, bins) for lo, hi, _ in ranges_of(df, first, second)[1]]
    placed = df.select(
        closed_bin(F.col(f"`{first}`"), one).alias("bin1"),
        closed_bin(F.col(f"`{second}`"), two).alias("bin2"),
        F.col(f"`{response}`").alias("_y"),
    )
    cells = placed.filter(F.col("bin1").isNotNull() & F.col("bin2").isNotNull())
    return cells.groupBy("bin1", "bin2").agg(F.count("*").alias("rows"), F.avg("_y").alias("mean"))


def histogram_by(df: DataFrame, value: str, by: str, bins: int = BINS) -> DataFrame:
    """Count and density per class and bin; the bins span the range over all classes."""
    [(lo, hi, _)] = ranges_of(df, value)[1]
    edges = Edges.spanning(lo, hi, bins)
    placed = df.select(F.col(by), closed_bin(F.col(f"`{value}`"), edges).alias("bin"))
    cells = placed.filter(F.col("bin").isNotNull()).groupBy(by, "bin").agg(F.count("*").alias("rows"))
    # The cells, not the rows, are summed per class: at most one row per class and bin.
    of_class = Window.partitionBy(by)
    density = F.col("rows") / (F.sum("rows").over(of_class) * edges.step)
    return cells.select("*", bin_center(F.col("bin"), edges).alias("center"), density.alias("density"))


PIECES = 500  # shares a class is sketched in: a bracket holds some two or three of them
ERROR = 20  # the sketch's ranks are off by no more than this part of a share
INSIDE = 1_000_000  # rows of a bracket beyond which it is sketched again before its values are counted
ROUNDS = 4  # brackets shrink more than a hundredfold a round


def order_statistics(
    df: DataFrame, by: str, value: str, positions: Mapping[str, Column], *, pieces: int | None = None, measures: Sequence[Column] = ()
) -> DataFrame:
    """Exact values at given positions of each class's sorted values, and ``measures`` of the class.

    ``positions`` are 0-based and may be fractional (the value is then interpolated); they
    are expressions of the class size ``n``. Neither a class nor all rows are sorted or written:
    one pass sketches each class at the ends of ``pieces`` equal shares, which brackets every
    position between two values. A second pass counts the rows below each bracket and those at
    each value inside; rows above it, and the single rows below it, are never shuffled. Should
    the sketch have missed a position, all are bracketed wider.
    """
    known = F.col(value).cast("double")
    rows = df.filter(F.col(by).isNotNull()).withColumn("_v", F.when(~F.isnan(known), known))
    pieces, slack = pieces or PIECES, 1
    values = rows.select(by, "_v").filter("_v IS NOT NULL")
    while True:
        sketch = durable(rows.groupBy(by).agg(*measures, F.count("_v").alias("n"), _shares(pieces, slack)).filter("n > 0"), "sketch")
        entries = F.array(*[F.struct(F.lit(k).alias("_name"), p.cast("double").alias("_p")) for k, p in positions.items()])
        wanted = sketch.select(by, "n", "_shares", F.inline(entries)).filter("_p IS NOT NULL")
        brackets = _closer(values, by, _bracketed(wanted, by, F.col("_p"), pieces, slack), pieces)
        found = durable(_at_positions(values, by, brackets), "positions")
        if brackets.join(found.filter("_weight > 0.999999"), [by, "_name"], "left_anti").isEmpty():
            break
        slack *= 8
    each = found.groupBy(by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_value"))).alias(k) for k in positions])
    return sketch.drop("n", "_shares").join(each, by)


def _shares(pieces: int, slack: int = 1) -> Column:
    ends = ", ".join(f"{i / pieces}D" for i in range(pieces + 1))  # one text, as hundreds of small columns are slow to build
    return F.expr(f"percentile_approx(_v, array({ends}), {ERROR * pieces * slack})").alias("_shares")


def _bracketed(wanted: DataFrame, by: str, place: Column, pieces: int, slack: int = 1) -> DataFrame:
    """(class, name, position, least and greatest value, rows expected): ``place`` is the position among the ``n`` sketched rows."""
    share = lambda rank: rank * pieces / F.greatest(F.col("n") - 1, F.lit(1))
    low = F.greatest(F.floor(share(F.floor(place)) - slack / 5), F.lit(0)).cast("int")
    high = F.least(F.ceil(share(F.ceil(place)) + slack / 5), F.lit(pieces)).cast("int")
    cut = wanted.withColumns({"_low": low, "_high": high})
    ends = cut.withColumns({
        "_lo": F.when(F.col("_low") > 0, F.get("_shares", F.col("_low"))).otherwise(F.lit(float("-inf"))),
        "_hi": F.when(F.col("_high") < pieces, F.get("_shares", F.col("_high"))).otherwise(F.lit(float("inf"))),
    })
    size = F.when(F.col("_lo") < F.col("_hi"), (F.col("_high") - F.col("_low")) * F.col("n") / pieces).otherwise(0.0)
    return ends.select(by, "_name", "_p", "_lo", "_hi", size.alias("_size"))


def _closer(values: DataFrame, by: str, brackets: DataFrame, pieces: int) -> DataFrame:
    """Brackets that are expected to hold few rows; a scan for each round of narrowing, none for most tables."""
    for _ in range(ROUNDS):
        large = brackets.filter(F.col("_size") > INSIDE)
        if large.isEmpty():
            break
        inside = F.when(F.col("_v").between(F.col("_lo"), F.col("_hi")), F.col("_v"))
        placed = values.join(large, by).select(by, "_name", "_p", (F.col("_v") < F.col("_lo")).alias("_under"), inside.alias("_v"))
        again = placed.groupBy(by, "_name", "_p").agg(F.count_if("_under").alias("_below"), F.count("_v").alias("n"), _shares(pieces))
        narrow = _bracketed(again, by, F.col("_p") - F.col("_below"), pieces)
        brackets = durable(brackets.filter(F.col("_size") <= INSIDE).unionByName(narrow), "brackets")
    return brackets


def _at_positions(values: DataFrame, by: str, brackets: DataFrame) -> DataFrame:
    """(class, name, value, weight): the value at the position, and 1 if its neighbours both lie in the bracket."""
    # Rows below a bracket are counted as one, rows inside by value: what is shuffled is what lies inside.
    placed = values.join(brackets, by).filter(F.col("_v") <= F.col("_hi"))
    at = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    counts = placed.groupBy(by, "_name", "_p", at.alias("_v")).agg(F.count("*").alias("_c"))
    running = Window.partitionBy(by, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_to", F.sum("_c").over(running)).filter("_v IS NOT NULL")
    here = lambda rank: (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c"))
    below, above = F.floor("_p"), F.ceil("_p")
    # Neighbours of a fractional position weigh by nearness; a whole one has weight 1.
    weight = F.when(here(below), 1 - (F.col("_p") - below)).otherwise(0.0) + F.when((above > below) & here(above), F.col("_p") - below).otherwise(0.0)
    weighed = ranked.withColumn("_w", weight).filter("_w > 0")
    return weighed.groupBy(by, "_name").agg(F.sum(F.col("_v") * F.col("_w")).alias("_value"), F.sum("_w").alias("_weight"))


def box_by(df: DataFrame, value: str, by: str, *, pieces: int | None = None) -> DataFrame:
    """Five-number summary (linear quartiles), mean and row count per class."""
    last = F.col("n") - 1
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    measures = [F.avg(value).alias("mean"), F.count(value).alias("rows")]
    return order_statistics(df, by, value, {name: last * share for name, share in shares.items()}, pieces=pieces, measures=measures)


def box_exclusive(df: DataFrame, value: str, by: str, *, pieces: int | None = None) -> DataFrame:
    """Quartiles as medians of the two halves, an odd class's median in neither half."""
    half = F.floor(F.col("n") / 2)
    within = F.when(half > 0, (half - 1) / 2)
    positions = {"q1": within, "median": (F.col("n") - 1) / 2, "q3": F.col("n") - half + within}
    return order_statistics(df, by, value, positions, pieces=pieces)


def trend_line(df: DataFrame, x: str, y: str, log_x: bool = False) -> DataFrame:
    """Least-squares line of y over x, or over ln(x)."""
    base = F.col(x).cast("double")
    over = F.ln(F.when(base > 0, base)) if log_x else base
    return df.agg(
        F.regr_slope(F.col(y), over).alias("slope"),
        F.regr_intercept(F.col(y), over).alias("intercept"),
        F.regr_count(F.col(y), over).alias("points"),
    )


def point_sample(df: DataFrame, by: str, key: str, per_class: int) -> DataFrame:
    """The same ``per_class`` rows of each class on every run: those whose key hashes lowest.

    Each task passes on no more rows of a class than are wanted.
    """
    lowest = Window.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= per_class).drop("_n")


def edge_rows(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """The ``bins + 1`` edges of equal-width bins over a column, one row each."""
    x = F.col(f"`{value}`").cast("double")
    edges = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    values = edge_columns(F.col("lo"), F.col("hi"), bins)
    return edges.select(F.posexplode(F.array(*values.values())).alias("position", "edge"))
