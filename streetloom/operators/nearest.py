"""Nearest neighbour joins in the plane, over a quadtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import line_wkb
from ..storage import dropped, written

#: Right points in a leaf and left points in a block, at most; levels of the tree, each of which halves both axes twice.
LEAF, BLOCK, LEVELS = 32, 16, 15

#: Copies of a leaf's points, dealt among the blocks that need them; slack of bounds against rounding.
PIECES, SLACK = 8, 1e-9


def _spread(c: Column) -> Column:
    """The low 32 bits of a number, each followed by a zero."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, west: float, south: float, side: float) -> Column:
    """Place on the Z-curve of a square, 2 * LEVELS bits an axis; points outside are moved to its edge."""
    top = (1 << 2 * LEVELS) - 1
    grid = lambda c, low: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), (c - low) / side * (top + 1)))).cast("bigint")
    return _spread(grid(x, west)).bitwiseOR(F.shiftleft(_spread(grid(y, south)), 1))


def quadtree(points: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """(cells of each level from 1 on: (cell, over, leaf, x0, x1, y0, y1); points (level, cell, ..)) of points (code, rx, ry, ..).

    A cell with more than leaf points is cut into sixteen, so a leaf holds no more wherever points are dense; boxes are those of the points.
    """
    cells, placed, live = [], [], points
    for level in range(1, LEVELS + 1):
        shift = 4 * (LEVELS - level)
        here = live.withColumn("cell", F.shiftrightunsigned("code", shift))
        found = here.groupBy("cell").agg(F.count("*").alias("n"), F.min("rx").alias("x0"), F.max("rx").alias("x1"), F.min("ry").alias("y0"), F.max("ry").alias("y1"))
        is_leaf = F.lit(level == LEVELS) | (F.col("n") <= leaf)
        found = written(found.select("cell", F.shiftrightunsigned("cell", 4).alias("over"), is_leaf.alias("leaf"), "x0", "x1", "y0", "y1"), "cells")
        cells.append(found)
        split = written(here.join(found.select("cell", "leaf"), "cell").withColumn("level", F.lit(level)), "points")
        placed.append(split.filter("leaf").drop("leaf"))
        live = split.filter("NOT leaf").drop("leaf", "level", "cell")
        if found.filter("NOT leaf").isEmpty():
            break
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return cells, out


#: Squares of the least and the greatest distance between two boxes, a (left) and b (right).
NEAR = "pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0D), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0D), 2)"
FAR = "pow(greatest(b.x1 - a.x0, a.x1 - b.x0), 2) + pow(greatest(b.y1 - a.y0, a.y1 - b.y0), 2)"


def nearest_join(left: DataFrame, right: DataFrame, leaf: int = LEAF) -> DataFrame:
    """left (id, x, y) with its nearest right (id, x, y): connector_id and distance_m; ties go to the smaller id.

    Left points go in blocks along the Z-curve. Blocks descend the quadtree of right points level by level: a block keeps the cells that may hold
    a neighbour of one of its points, which are those no farther than the farthest corner of the box that is surely nearest. So a block
    meets a few leaves however dense or far away points are, a leaf is bounded, and a task never holds more than a block's points against them.
    A left row without coordinates (null, NaN or infinite), and any if there are no right points, has nulls.
    """
    kind = dict(right.dtypes)["id"]
    whole = lambda c: (F.abs(c) < float("inf")) & ~F.isnan(c)
    right = right.select(F.col("id").alias("connector_id"), F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry")).filter(whole(F.col("rx")) & whole(F.col("ry")))
    right = right.groupBy("rx", "ry").agg(F.min("connector_id").alias("connector_id"))
    left = left.select(F.col("id").alias("building_id"), F.col("x").cast("double").alias("lx"), F.col("y").cast("double").alias("ly"))
    west, east, south, north = right.agg(F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    null = [F.lit(None).cast(t).alias(c) for c, t in (("connector_id", kind), ("distance_m", "double"))]
    nowhere = [F.lit(None).cast("double").alias(c) for c in ("rx", "ry")]
    if west is None:
        return left.select("building_id", *null, "lx", "ly", *nowhere)
    placed = F.coalesce(whole(F.col("lx")) & whole(F.col("ly")), F.lit(False))
    lost = left.filter(~placed).select("building_id", *null, "lx", "ly", *nowhere)
    side = max(east - west, north - south) or 1.0
    cells, points = quadtree(right.withColumn("code", morton(F.col("rx"), F.col("ry"), west, south, side)), leaf)

    curve = left.filter(placed).withColumn("code", morton(F.col("lx"), F.col("ly"), west, south, side))
    # in each range of the curve, BLOCK rows in its order are a block
    rows = written(curve.repartitionByRange("code").sortWithinPartitions("code").withColumn("row", F.monotonically_increasing_id()).select("building_id", "lx", "ly", "row", F.expr(f"row div {BLOCK}").alias("block")), "rows")
    boxes = rows.groupBy("block").agg(F.min("lx").alias("x0"), F.max("lx").alias("x1"), F.min("ly").alias("y0"), F.max("ly").alias("y1"))
    front = written(boxes.select("block", *(F.col(c).alias(f"a{c}") for c in ("x0", "x1", "y0", "y1")), F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell"), F.lit(False).alias("leaf"), *(F.lit(0.0).alias(c) for c in ("x0", "x1", "y0", "y1"))), "front")
    own = "f.block, f.ax0, f.ax1, f.ay0, f.ay1"
    terms = {k: v.replace("a.x", "ax").replace("a.y", "ay").replace("b.", "") for k, v in (("near", NEAR), ("far", FAR))}
    for level, found in enumerate(cells, 1):
        if level > 1 and front.filter("NOT leaf").isEmpty():
            break
        after = written(
            left.sparkSession.sql(
                f"""WITH met AS (
                    SELECT {own}, {level} AS level, c.cell, c.leaf, c.x0, c.x1, c.y0, c.y1 FROM {{front}} f JOIN {{cells}} c ON f.cell = c.over WHERE NOT f.leaf
                    UNION ALL SELECT {own}, f.level, f.cell, f.leaf, f.x0, f.x1, f.y0, f.y1 FROM {{front}} f WHERE f.leaf
                ), bounded AS (SELECT *, {terms["near"]} AS near, min({terms["far"]}) OVER (PARTITION BY block) AS most FROM met)
                SELECT block, ax0, ax1, ay0, ay1, level, cell, leaf, x0, x1, y0, y1 FROM bounded WHERE near <= most * {1 + SLACK}""",
                front=front,
                cells=found,
            ),
            "front",
        )
        dropped(front)
        front = after
    at = {k: v.replace("a.x0", "a.lx").replace("a.x1", "a.lx").replace("a.y0", "a.ly").replace("a.y1", "a.ly") for k, v in (("near", NEAR), ("far", FAR))}
    # the points of a block that still need a leaf meet it together: at most BLOCK points against leaf points
    needed = left.sparkSession.sql(
        f"""WITH met AS (
            SELECT a.block, a.row, a.building_id, a.lx, a.ly, b.level, b.cell, {at["near"]} AS near, min({at["far"]}) OVER (PARTITION BY a.block, a.row) AS most FROM {{rows}} a JOIN {{front}} b ON a.block = b.block
        ) SELECT block, level, cell, collect_list(struct(row, building_id, lx, ly)) AS own FROM met WHERE near <= most * {1 + SLACK} GROUP BY block, level, cell""",
        rows=rows,
        front=front,
    )
    pairs = written(needed.withColumn("piece", F.pmod(F.xxhash64("block"), F.lit(PIECES)).cast("int")), "pairs")
    held = points.groupBy("level", "cell").agg(F.collect_list(F.struct("connector_id", "rx", "ry")).alias("held"))
    dealt = held.withColumn("piece", F.explode(F.array(*map(F.lit, range(PIECES)))))
    best = left.sparkSession.sql(
        """WITH met AS (SELECT inline(own), held FROM {pairs} JOIN {dealt} USING (level, cell, piece)),
        each AS (SELECT row, building_id, lx, ly, array_min(transform(held, p -> named_struct('distance_m', sqrt((lx - p.rx) * (lx - p.rx) + (ly - p.ry) * (ly - p.ry)), 'connector_id', p.connector_id, 'rx', p.rx, 'ry', p.ry))) AS b FROM met)
        SELECT building_id, b.connector_id, b.distance_m, lx, ly, b.rx, b.ry FROM (SELECT row, any_value(building_id) AS building_id, any_value(lx) AS lx, any_value(ly) AS ly, min(b) AS b FROM each GROUP BY row)""",
        pairs=pairs,
        dealt=dealt,
    )
    return best.unionByName(lost)


def first_link(links: DataFrame) -> DataFrame:
    """One link a building: the nearest connector, of equals the smallest id."""
    order = Window.partitionBy("building_id").orderBy("distance_m", "connector_id")
    return links.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def link_lines(links: DataFrame) -> DataFrame:
    """(building_id, connector_id, distance_m, geometry): the line from building to connector."""
    return links.select("building_id", "connector_id", "distance_m", line_wkb(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")).alias("geometry"))
