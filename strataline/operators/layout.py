"""Layouts of tiles as tables: best forests with places along them, islands joined by votes, slivers, nearest places in the plane.

Ids are longs. Every round is written to the shared folder; no group is as large as a mosaic and nothing but counts is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions import components as stars
from strataline.functions.core import unsent
from strataline.functions.scratch import saved

_SHIFT = ["sx", "sy"]


def _oriented(joins: DataFrame) -> DataFrame:
    """u < v, q, sx, sy of joins (i, j, quality, dx, dy); of repeated ones the best, by dx and dy where equal."""
    turn = F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0)
    made = joins.where("i is not null and j is not null and i != j and quality is not null and dx is not null and dy is not null")
    made = made.select(F.least("i", "j").cast("long").alias("u"), F.greatest("i", "j").cast("long").alias("v"), F.col("quality").alias("q"), (F.col("dx") * turn).alias("sx"), (F.col("dy") * turn).alias("sy"))
    best = made.groupBy("u", "v").agg(F.max(F.struct("q", "sx", "sy")).alias("m"))
    return best.select("u", "v", "m.q", "m.sx", "m.sy")


def _chased(hooks: DataFrame) -> DataFrame:
    """c, p, hx, hy with p the root behind each pointer and the shifts along the way added, by doubling."""
    while True:
        g = hooks.select(F.col("c").alias("p"), F.col("p").alias("p2"), F.col("hx").alias("gx"), F.col("hy").alias("gy"))
        hooks = saved(hooks.join(unsent(g), "p", "left").select("c", F.coalesce("p2", "p").alias("p"), (F.col("hx") + F.coalesce("gx", F.lit(0.0))).alias("hx"), (F.col("hy") + F.coalesce("gy", F.lit(0.0))).alias("hy"), (F.col("p2") != F.col("p")).alias("moved")), "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.drop("moved")
        hooks = hooks.drop("moved")


def _moved(at: DataFrame, hooks: DataFrame) -> DataFrame:
    """Tiles (tile, island, x, y) in the frames of the islands that theirs hang on."""
    h = hooks.withColumnRenamed("c", "island")
    return at.join(unsent(h), "island", "left").select("tile", F.coalesce("p", "island").alias("island"), (F.col("x") + F.coalesce("hx", F.lit(0.0))).alias("x"), (F.col("y") + F.coalesce("hy", F.lit(0.0))).alias("y"))


def _anchored(at: DataFrame) -> DataFrame:
    """The same islands, named by their least tile, which lies at 0, 0."""
    first = at.groupBy("island").agg(F.min(F.struct("tile", "x", "y")).alias("m"))
    return at.join(unsent(first), "island").select("tile", F.col("m.tile").alias("island"), (F.col("x") - F.col("m.x")).alias("x"), (F.col("y") - F.col("m.y")).alias("y"))


def best_forest(joins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The maximum spanning forest (i, j, quality) of joins (i, j, quality, dx, dy), and places (tile, island, x, y) along it.

    In each round every island takes its best join to another one (ties: least i, then j), hangs on that island with the shift it
    gives, and pointers are doubled until all hang on one; then of all joins between two islands the best is kept. So the number of
    rounds is logarithmic, also for chains. dx and dy are the place of j less that of i; a join may stand either way round and
    repeat; loops and joins with a null are ignored. An island is named by its least tile, which lies at 0, 0. No joins: no rows.
    """
    open_ = saved(_oriented(joins).withColumns({"i": F.col("u"), "j": F.col("v")}), "joins")
    at = open_.select(F.col("u").alias("tile")).union(open_.select("v")).distinct().select("tile", F.col("tile").alias("island"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    forest = open_.limit(0).select("i", "j", F.col("q").alias("quality"))
    while not open_.isEmpty():
        ends = open_.select(F.col("u").alias("c"), F.col("v").alias("p"), "q", "i", "j", *[(-F.col(s)).alias(s) for s in _SHIFT])
        ends = ends.union(open_.select("v", "u", "q", "i", "j", *_SHIFT))  # sx, sy: the place of c's origin in p's frame
        order = F.struct("q", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
        best = saved(ends.groupBy("c").agg(F.max_by(F.struct("p", "q", "i", "j", *_SHIFT), order).alias("m")).select("c", "m.*"), "best")
        forest = forest.union(best.select("i", "j", F.col("q").alias("quality")).distinct())
        # two islands that take each other take the same join: the smaller one stays where it is
        back = best.select(F.col("p").alias("c"), F.col("c").alias("p"))
        held = best.join(unsent(back), ["c", "p"], "left_semi").where("c < p").select("c", F.col("c").alias("p"), F.lit(0.0).alias("hx"), F.lit(0.0).alias("hy"))
        hooks = best.join(unsent(held.select("c")), "c", "left_anti").select("c", "p", F.col("sx").alias("hx"), F.col("sy").alias("hy")).union(held)
        hooks = _chased(hooks)
        at = saved(_moved(at, hooks), "places")
        a, b = (hooks.select(F.col("c").alias(k), F.col("p").alias(f"p_{k}"), F.col("hx").alias(f"x_{k}"), F.col("hy").alias(f"y_{k}")) for k in "uv")
        now = open_.join(unsent(a), "u").join(unsent(b), "v").where("p_u != p_v")
        now = now.select(F.col("p_u").alias("u"), F.col("p_v").alias("v"), "q", "i", "j", *[(F.col(f"{k}_u") + F.col(f"s{k}") - F.col(f"{k}_v")).alias(f"s{k}") for k in "xy"])
        turn = F.when(F.col("u") < F.col("v"), 1.0).otherwise(-1.0)
        now = now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "q", "i", "j", *[(F.col(s) * turn).alias(s) for s in _SHIFT])
        open_ = saved(now.groupBy("u", "v").agg(F.max_by(F.struct("q", *_SHIFT, "i", "j"), order).alias("m")).select("u", "v", "m.*"), "joins")
    return forest, _anchored(at)


def disagreements(joins: DataFrame, places: DataFrame, within: float) -> DataFrame:
    """i, j, quality, off of the joins inside an island that lie further than `within` from where its places put them."""
    a, b = (places.select(F.col("tile").alias(k), F.col("island").alias(f"island_{k}"), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}")) for k in "ij")
    off = F.hypot(F.col("x_j") - F.col("x_i") - F.col("dx"), F.col("y_j") - F.col("y_i") - F.col("dy"))
    return joins.join(unsent(a), "i").join(unsent(b), "j").where("island_i = island_j").withColumn("off", off).where(F.col("off") > within).select("i", "j", "quality", "off")


def shift_votes(places: DataFrame, joins: DataFrame, within: float) -> DataFrame:
    """u < v (islands), support, conflicts, quality, sx, sy: for each pair of islands the shift that most joins between them vote for.

    A vote is the place of v's origin in u's frame that a join gives; votes are counted in cells of `within` and support a cell from it
    and the eight around it. The shift is the mean of the cell's own votes. Ties: the larger sum of qualities, then the lesser cell.
    """
    a, b = (places.select(F.col("tile").alias(k), F.col("island").alias(f"c_{k}"), F.col("x").alias(f"x_{k}"), F.col("y").alias(f"y_{k}")) for k in "ij")
    both = joins.where("quality is not null and dx is not null and dy is not null").join(unsent(a), "i").join(unsent(b), "j").where("c_i != c_j")
    turn = F.when(F.col("c_i") < F.col("c_j"), 1.0).otherwise(-1.0)
    shift = {f"s{k}": (F.col(f"{k}_i") + F.col(f"d{k}") - F.col(f"{k}_j")) * turn for k in "xy"}
    votes = both.select(F.least("c_i", "c_j").alias("u"), F.greatest("c_i", "c_j").alias("v"), "quality", *[c.alias(k) for k, c in shift.items()])
    cells = votes.groupBy("u", "v", *[F.round(F.col(s) / within).cast("long").alias(f"c{s}") for s in _SHIFT]).agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), *[F.avg(s).alias(s) for s in _SHIFT])
    # each cell tells the nine around it; a row a cell, however many votes
    near = cells.withColumn("a", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    own = (F.col("a") == 0) & (F.col("b") == 0)
    told = near.groupBy("u", "v", (F.col("csx") + F.col("a")).alias("csx"), (F.col("csy") + F.col("b")).alias("csy")).agg(F.sum("n").alias("support"), F.sum("quality").alias("quality"), *[F.max(F.when(own, F.col(s))).alias(s) for s in _SHIFT])
    total = cells.groupBy("u", "v").agg(F.sum("n").alias("total"))
    best = told.where("sx is not null").groupBy("u", "v").agg(F.max(F.struct("support", F.round("quality", 9).alias("quality"), (-F.col("csx")).alias("a"), (-F.col("csy")).alias("b"), *_SHIFT)).alias("m"))
    return best.join(unsent(total), ["u", "v"]).select("u", "v", "m.support", (F.col("total") - F.col("m.support")).alias("conflicts"), "m.quality", "m.sx", "m.sy")


def merge_islands(places: DataFrame, joins: DataFrame, within: float, least: int = 2, conflicts: float = 0.0) -> DataFrame:
    """places with those islands put together between which joins (i, j, quality, dx, dy) agree.

    A pair may merge if at least `least` votes support one shift and the others are at most a share `conflicts` of all its votes. In each
    round two islands merge if each is the other's best partner (support, then quality, then least ids), and all votes are counted anew
    in the merged frames, so what contradicts a merge keeps its islands apart afterwards. Rounds end when no pair may merge;
    there is at least one merge a round. Islands are named and anchored as in best_forest.
    """
    at = saved(places.select("tile", "island", "x", "y"), "places")
    while True:
        may = shift_votes(at, joins, within).where((F.col("support") >= least) & (F.col("conflicts") <= conflicts * (F.col("support") + F.col("conflicts"))))
        may = saved(may, "votes")
        ends = may.select(F.col("u").alias("c"), "*").union(may.select(F.col("v").alias("c"), "*"))
        order = F.struct("support", "quality", (-F.col("u")).alias("u"), (-F.col("v")).alias("v"))
        best = ends.groupBy("c").agg(F.max_by(F.struct("u", "v", *_SHIFT), order).alias("m")).groupBy("m").agg(F.count("*").alias("n")).where("n = 2")
        hooks = saved(best.select(F.col("m.v").alias("c"), F.col("m.u").alias("p"), F.col("m.sx").alias("hx"), F.col("m.sy").alias("hy")), "hooks")
        if hooks.isEmpty():
            return _anchored(at)
        at = saved(_moved(at, hooks), "places")


def sliver_groups(places: DataFrame, shared: DataFrame, least: int = 6, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Groups (tile, island, part, size, main) that hang on slivers, and the joins (i, j, shared, part_i, part_j, ratio) that hold them.

    shared: i, j, shared (what two tiles have in common). A join is solid if it has at least `share` of the median of all joins;
    parts are the components under solid joins within an island, named by their least tile, and main is the largest (ties: the least).
    Only islands of at least `least` tiles that fall into several parts are given.
    """
    a, b = (places.select(F.col("tile").alias(k), F.col("island").alias(f"island_{k}")) for k in "ij")
    typical = shared.agg(F.median("shared").alias("typical"))  # one row
    inside = shared.join(unsent(a), "i").join(unsent(b), "j").where("island_i = island_j").join(F.broadcast(typical)).where("typical > 0")
    inside = saved(inside.select("i", "j", "shared", (F.col("shared") / F.col("typical")).alias("ratio")), "inside")
    roots = stars.components(inside.where(F.col("ratio") >= share).select(F.col("i").alias("u"), F.col("j").alias("v"))).withColumnRenamed("id", "tile")
    parts = saved(places.join(unsent(roots), "tile", "left").select("tile", "island", F.coalesce("root", "tile").alias("part")), "parts")
    sizes = parts.groupBy("island", "part").agg(F.count("*").alias("size"))
    islands = sizes.groupBy("island").agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.max(F.struct("size", (-F.col("part")).alias("p"))).alias("m")).where((F.col("n") >= least) & (F.col("k") > 1))
    groups = parts.join(unsent(sizes), ["island", "part"]).join(unsent(islands.select("island", (-F.col("m.p")).alias("top"))), "island").select("tile", "island", "part", "size", (F.col("part") == F.col("top")).alias("main"))
    own = lambda k: groups.select(F.col("tile").alias(k), F.col("part").alias(f"part_{k}"))
    return groups, inside.join(unsent(own("i")), "i").join(unsent(own("j")), "j").where("part_i != part_j").select("i", "j", "shared", "part_i", "part_j", "ratio")


FEW = 4  # places of a curve for each square of a search's size, on average over squares with any
SLICE_ROWS = 16_000_000  # rows that one step shuffles, about
WIDE = 128  # coarse cells across the points that are left


def _slices(rows: int) -> int:
    return max(1, -(-rows // SLICE_ROWS))


def _sliced(n: int, made, name: str) -> DataFrame:
    """made(k) for k of n slices, written one after another: the shuffle of one is gone before the next is made."""
    return reduce(DataFrame.union, [saved(made(k), name) for k in range(n)])


def _rim(c: DataFrame, f: float) -> DataFrame:
    """c without places that no point farther than 10 f from all of them can have for its nearest.

    Those lie in a cell of size f around which the eight cells two steps off hold places: one is nearer whatever the direction. (In the
    worst one it is 0.541 f nearer along that, at most sqrt(10) f away, so nearer from anywhere beyond 10 f / (2 * 0.541) = 9.3 f.)
    """
    cell = [F.floor(F.col(v) / f).alias(f"f{v}") for v in "xy"]
    held = c.where((F.abs("x") < f * 2.0**40) & (F.abs("y") < f * 2.0**40)).select(*cell).distinct()
    ring = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-2, 0, 2) for j in (-2, 0, 2) if i or j]))
    inner = held.withColumn("o", ring).groupBy((F.col("fx") + F.col("o.i")).alias("fx"), (F.col("fy") + F.col("o.j")).alias("fy")).agg(F.count("*").alias("n")).where("n = 8")
    return c.select("*", *cell).join(unsent(inner), ["fx", "fy"], "left_anti").select("arc", "x", "y")


def nearest_in_plane(points: DataFrame, curve: DataFrame, most: float, halvings: int = 6) -> DataFrame:
    """point, arc, distance: for each of points (point, x, y) the nearest of curve (arc, x, y) within `most`, ties to the lesser arc.

    The size of the search doubles round by round, from most / 2^halvings, or from a smaller one where its squares would still hold more
    than FEW places of the curve on average, so that pairs go with the points and not with how close the places lie. Of equal places the
    least arc stands for all. Cells are twice that size, so a point looks into two by two of them, and only points that have
    nothing within the size go on to the next round. So crowded places are searched in small cells, and a point that looks at them
    from afar sees their rim only. A round takes those places that lie near points left, by a coarse grid of about WIDE by WIDE cells.
    Least distances first, then the arcs that have them: sums of fixed size, so pairs are neither sorted nor kept. What would be more than
    about SLICE_ROWS rows to shuffle goes in slices of the cells, one after another. Points with nothing within `most`, or a coordinate
    that is null, NaN or infinite, are left out.
    """
    real = " and ".join(f"{v} is not null and not isnan({v}) and abs({v}) < double('infinity')" for v in "xy")
    good = lambda df: df.withColumns({k: F.col(k).cast("double") for k in "xy"}).where(real)
    left, places, found = saved(good(points.select("point", "x", "y")), "points"), good(curve.select("arc", "x", "y")), None
    many = _slices(curve.count())
    part = F.pmod(F.xxhash64(*[F.col(v) + 0.0 for v in "xy"]), F.lit(many))
    c = _sliced(many, lambda s: (places if many == 1 else places.where(part == s)).groupBy("x", "y").agg(F.min("arc").alias("arc")), "curve")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, finest = c.count(), halvings + 15
    for k in range(halvings, halvings + 16, 4):
        cells = c.agg(*[F.approx_count_distinct(F.struct(*[F.floor(F.col(v) / (most / 2**i)) for v in "xy"])) for i in range(k, k + 4)]).first()
        if total <= FEW * max(cells):
            finest = next(i for i, m in enumerate(cells, k) if total <= FEW * m)
            break
    for k in range(finest, -1, -1):
        found, left = _round(found, left, c, most / 2**k, most / 2 ** min(finest - 1, k + 5) if finest - k >= 5 else None, n, total, k == 0)
    return found


def _round(found, left: DataFrame, c: DataFrame, size: float, rim: float | None, n: int, total: int, last: bool):
    """found and those of `left` that have a place within size, and the points that have none; rim: None, or the size of cells for it."""

    def around(v, reach, width):  # rounding moves no place out of reach
        far = reach * (1 + 1e-9) + F.abs(v) * 1e-15
        return F.explode(F.sequence(F.floor((F.col(v) - far) / width), F.floor((F.col(v) + far) / width)))

    rows, wide = left.agg(F.count("*"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()
    coarse = max(2 * size, (wide or 0.0) / WIDE)
    near = left.withColumn("cx", around("x", F.lit(size), coarse)).select("cx", around("y", F.lit(size), coarse).alias("cy")).distinct()
    q = c.join(F.broadcast(near), (F.floor(F.col("x") / coarse) == F.col("cx")) & (F.floor(F.col("y") / coarse) == F.col("cy")), "left_semi")
    if rim and rows:
        q = saved(_rim(q, rim), "rim")
    q = q.select("arc", F.col("x").alias("qx"), F.col("y").alias("qy"))
    parts = _slices(4 * rows + (q.count() if total > SLICE_ROWS else total))
    cell = [F.floor(F.col(v) / (2 * size)) for v in ("qx", "qy")]
    d = F.sqrt((F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")))

    def pairs(s, p, reach):
        """Pairs of the cells of slice s. Few rows become many pairs: what is small before is dealt out by number; a place goes without its cell."""
        p, held = p.withColumn("gx", around("x", reach, 2 * size)).withColumn("gy", around("y", reach, 2 * size)), q
        if parts > 1:
            own = lambda x, y: F.pmod(F.xxhash64(x, F.floor(y / 16)), F.lit(parts)) == s
            p, held = p.where(own(F.col("gx"), F.col("gy"))), held.where(own(*cell))
        return p.repartition(n, "gx", "gy").join(unsent(held.repartition(n, *cell)), (F.col("gx") == cell[0]) & (F.col("gy") == cell[1]))

    least = _sliced(parts, lambda s: pairs(s, left, F.lit(size)).where(d <= size).groupBy("point").agg(F.min(d).alias("distance")), "near")
    if parts > 1:
        least = saved(least.groupBy("point").agg(F.min("distance").alias("distance")), "near")
    if not rows and found is not None:
        return found, left
    known = left.join(unsent(least), "point")
    made = _sliced(parts, lambda s: pairs(s, known, F.col("distance")).where(d == F.col("distance")).groupBy("point", "distance").agg(F.min("arc").alias("arc")), "near")
    if parts > 1:
        made = made.groupBy("point", "distance").agg(F.min("arc").alias("arc"))
    made = made.select("point", "arc", "distance")
    rest = left.join(unsent(least.select("point")), "point", "left_anti")
    return made if found is None else found.union(made), rest if last else saved(rest, "points")
