"""Nearest-neighbour graphs and spatial autocorrelation of genes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsail.frame import ExpressionFrame
from cellsail.tables import written

#: A square is split into so many by so many.
SPLIT = 4
#: Rows of a table of squares that is broadcast; larger ones are joined by their key.
SMALL = 50_000
#: Levels after which places are written with their squares, so that no plan grows with the depth.
WRITE_EVERY = 4


@dataclass(frozen=True)
class _Level:
    """Squares of one level: rows (parent, node, n, x0, x1, y0, y1, leaf), how many there are and how many are split further."""

    squares: DataFrame
    count: int
    split: int

    @property
    def joined(self) -> DataFrame:
        return F.broadcast(self.squares) if self.count <= SMALL else self.squares


def _level(active: DataFrame, most: int) -> _Level:
    box = active.groupBy("parent", "node").agg(F.sum("n").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = written(box.withColumn("leaf", (F.col("n") <= most) | ((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")))), "knn-squares")
    r = box.agg(F.count("*").alias("n"), F.count_if(~F.col("leaf")).alias("split")).first()
    return _Level(box, r["n"], r["split"])


def _tree(places: DataFrame, most: int) -> tuple[DataFrame, list[_Level]]:
    """Places with the leaf that they lie in, and the levels from the root on.

    A square of more than most cells at different places is split by the box of
    what it holds, so far outliers or dense spots only cost the levels that they need.
    """

    def part(c: str) -> Column:
        # halves first: the width of a box may be beyond a double
        share = F.try_divide(F.col(c) / 2 - F.col(f"{c}0") / 2, F.col(f"{c}1") / 2 - F.col(f"{c}0") / 2)
        return F.least(F.coalesce(F.floor(share * SPLIT), F.lit(0)), F.lit(SPLIT - 1)).cast("int")

    active, leaves, levels = places.withColumn("node", F.lit("")).withColumn("parent", F.lit("none")), [], []
    while True:
        level = _level(active, most)
        levels.append(level)
        inside = active.drop("parent").join(level.joined.drop("parent", "n"), "node")
        leaves.append(inside.filter("leaf").select("x", "y", "n", "ids", F.col("node").alias("at")))
        if not level.split:
            return reduce(DataFrame.unionByName, leaves), levels
        active = inside.filter("NOT leaf").select("x", "y", "n", "ids", F.col("node").alias("parent"), F.concat("node", F.char(F.lit(97) + part("x") * SPLIT + part("y"))).alias("node"))
        if len(levels) % WRITE_EVERY == 0:
            active = written(active, "knn-places")


def _near_leaves(levels: list[_Level], k: int) -> DataFrame:
    """(at, node): for each leaf the leaves that may hold one of the k + 1 nearest cells of a place in it.

    From the root on, each leaf keeps a list of squares. The squares that lie wholly
    within some distance of it hold k + 1 cells; what lies wholly beyond the least such distance goes, the
    rest is opened.
    """
    box = ["n", "x0", "x1", "y0", "y1"]
    leaf = reduce(DataFrame.unionByName, [v.squares for v in levels]).filter("leaf").select(F.col("node").alias("at"), *[F.col(c).alias(f"q{c}") for c in box[1:]])
    listed = leaf.crossJoin(F.broadcast(levels[0].squares.select("node", "leaf", *box)))  # the root: one row

    def gap(c: str) -> Column:
        return F.greatest(F.col(f"{c}0") - F.col(f"q{c}1"), F.col(f"q{c}0") - F.col(f"{c}1"), F.lit(0.0))

    def span(c: str) -> Column:
        return F.greatest(F.abs(F.col(f"{c}1") - F.col(f"q{c}0")), F.abs(F.col(f"q{c}1") - F.col(f"{c}0")))

    for level in levels[1:]:
        children = level.joined.select("parent", F.col("node").alias("child"), F.col("leaf").alias("child_leaf"), *[F.col(c).alias(f"child_{c}") for c in box])
        opened = listed.filter("NOT leaf").join(children, F.col("node") == F.col("parent"))
        opened = opened.select("at", *[f"q{c}" for c in box[1:]], F.col("child").alias("node"), F.col("child_leaf").alias("leaf"), *[F.col(f"child_{c}").alias(c) for c in box])
        both = listed.filter("leaf").unionByName(opened).withColumn("low", gap("x") ** 2 + gap("y") ** 2).withColumn("high", span("x") ** 2 + span("y") ** 2)
        held = F.sum("n").over(Window.partitionBy("at").orderBy("high"))
        # a little more than the sum of squares, whose rounding must not lose a tie
        reach = F.min(F.when(F.col("held") > k, F.col("high") * (1 + 1e-12))).over(Window.partitionBy("at"))
        kept = both.withColumn("held", held).withColumn("reach", reach).filter("reach IS NULL OR low <= reach")
        listed = written(kept.drop("low", "high", "held", "reach"), "knn-lists")
    return listed.select("at", "node")


def knn_edges(cells: DataFrame, x: str, y: str, k: int = 30) -> DataFrame:
    """(src, dst, w): each cell's k nearest others in the plane, weight 1; ties by id.

    Coordinates that are missing or not finite are 0. Exact. Of the cells at one
    place only the k + 1 least ids can be neighbours, so others are not compared. A
    tree of squares, each of some k cells, tells which squares a square's cells must be
    compared with: those that can hold a cell nearer than the k that are surely
    near. A fully empty list of cells gives no edges; fewer than k others give them all.
    """
    if not 1 <= k <= 100:
        raise ValueError("k must be from 1 to 100")

    def known(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v + 0.0).otherwise(F.lit(0.0))  # -0.0 is 0

    p = written(cells.select("cell", known(x).alias("x"), known(y).alias("y")), "knn-cells")
    if p.isEmpty():
        return p.select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(1.0).alias("w"))
    first = p.withColumn("i", F.row_number().over(Window.partitionBy("x", "y").orderBy("cell"))).filter(F.col("i") <= k + 1)
    places, levels = _tree(written(first.groupBy("x", "y").agg(F.count("*").alias("n"), F.collect_list("cell").alias("ids")), "knn-places"), 2 * k + 2)
    places = written(places, "knn-leaves")
    other = places.select(F.col("at").alias("node"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("ids").alias("ids2"))
    pairs = places.select("at", "x", "y").join(_near_leaves(levels, k), "at").join(other, "node")
    pairs = pairs.withColumn("d", (F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2).select("x", "y", "d", F.explode("ids2").alias("dst"))
    near = pairs.withColumn("i", F.row_number().over(Window.partitionBy("x", "y").orderBy("d", "dst"))).filter(F.col("i") <= k + 1)
    near = near.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("d", "dst"))).alias("near"))  # k + 1 at most
    own = p.join(near, ["x", "y"]).select(F.col("cell").alias("src"), F.explode(F.slice(F.filter("near", lambda e: e["dst"] != F.col("cell")), 1, k)).alias("e"))
    return own.select("src", F.col("e.dst").alias("dst"), F.lit(1.0).alias("w"))


def autocorrelation(frame: ExpressionFrame, edges: DataFrame, method: str = "moran") -> DataFrame:
    """(gene, score): Moran's I or Geary's C over the edges, whose ends are cells of the frame; missing values are 0.

    Only stored values meet. With z a value less its gene's mean, a pair without a
    stored end has z = -mean there, so sums over all edges are those over pairs stored
    at both ends, plus what weights of edges out of and into stored ends make up.
    """
    if method not in ("moran", "geary"):
        raise ValueError(f"unknown method {method!r}")
    cells = frame.n_cells()
    x = frame.fill_missing().expr.filter("value <> 0")
    mean = frame.genes.select("gene").join(x.groupBy("gene").agg(F.sum("value").alias("s")), "gene", "left").crossJoin(F.broadcast(cells)).select("gene", F.col("n_cells").alias("n"), (F.coalesce("s", F.lit(0.0)) / F.col("n_cells")).alias("mean"))
    z = x.join(mean.select("gene", "mean"), "gene").select("cell", "gene", "value", (F.col("value") - F.col("mean")).alias("z"))
    out = edges.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("out"))
    into = edges.groupBy(F.col("dst").alias("cell")).agg(F.sum("w").alias("into"))
    w_out, w_in = F.coalesce("out", F.lit(0.0)), F.coalesce("into", F.lit(0.0))
    ends = z.join(out, "cell", "left").join(into, "cell", "left").groupBy("gene").agg(
        F.count("*").alias("stored"),
        (F.min("value") == F.max("value")).alias("alike"),
        F.sum(F.col("z") ** 2).alias("own"),
        F.sum(w_out).alias("out"),
        F.sum(w_in).alias("into"),
        F.sum((w_out + w_in) * F.col("z")).alias("ends"),
        F.sum((w_out + w_in) * F.col("value") ** 2).alias("squares"),
    )
    a = z.select("gene", F.col("cell").alias("src"), F.col("value").alias("vi"), F.col("z").alias("zi"))
    b = z.select("gene", F.col("cell").alias("dst"), F.col("value").alias("vj"), F.col("z").alias("zj"))
    w = F.col("w")
    both = edges.join(a, "src").join(b, ["gene", "dst"]).groupBy("gene").agg(
        F.sum(w).alias("both"),
        F.sum(w * F.col("zi") * F.col("zj")).alias("products"),
        F.sum(w * (F.col("zi") + F.col("zj"))).alias("both_ends"),
        F.sum(w * (F.col("zi") - F.col("zj")) ** 2).alias("differences"),
        F.sum(w * (F.col("vi") ** 2 + F.col("vj") ** 2)).alias("both_squares"),
    )
    total = edges.agg(F.sum("w").alias("sw")).crossJoin(cells.select("n_cells")).select("sw")
    rows = mean.join(ends, "gene", "left").join(both, "gene", "left").fillna(0.0).fillna(0).crossJoin(F.broadcast(total))
    m = F.col("mean")
    squares = F.col("own") + (F.col("n") - F.col("stored")) * m**2 + 1e-16
    if method == "moran":
        cross = F.col("products") - m * (F.col("ends") - F.col("both_ends")) + m**2 * (F.col("sw") - F.col("out") - F.col("into") + F.col("both"))
        score = F.col("n") / F.col("sw") * cross / squares
    else:
        differences = F.col("differences") + F.col("squares") - F.col("both_squares")
        score = (F.col("n") - 1) / (2 * F.col("sw")) * differences / squares
    # of a gene that is the same in all cells only rounding would be left
    constant = (F.col("stored") == 0) | (F.col("alike") & (F.col("stored") == F.col("n")))
    return rows.select("gene", F.when(constant, 0.0).otherwise(score).alias("score"))
