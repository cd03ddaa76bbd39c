"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from fleetlens.operators.routes import project_on_segment
from fleetlens.session import stage
from fleetlens.settings import HOT_KEYS, HOT_ROWS, LOOKUP_BYTES, LOOKUP_ROWS, SALTS


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: the length of what varies in length, 8 for anything else."""
    def one(field: StructField) -> Column:
        if isinstance(field.dataType, (StringType, BinaryType)):
            return F.octet_length(F.col(f"`{field.name}`"))
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            return F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`"))))
        return F.lit(8)

    return sum((F.coalesce(one(f), F.lit(0)).cast("long") for f in df.schema.fields), F.lit(0))


def is_small(df: DataFrame, rows: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``most_bytes``; stops reading beyond the rows."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_width(df)).alias("bytes")).first()
    return found["n"] <= rows and (found["bytes"] or 0) <= most_bytes


def hot_keys(facts: DataFrame, on: Sequence[str], rows: int = HOT_ROWS, most: int = HOT_KEYS) -> DataFrame:
    """Keys with more than ``rows`` rows, the ``most`` most frequent of them at most: a table that may be broadcast."""
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).dropna(subset=list(on))
    return stage(counts.orderBy(F.desc("_n"), *on).limit(most).select(*on), "hot-keys")


def _salted(facts: DataFrame, table: DataFrame, on: Sequence[str], how: str, salts: int, hot_rows: int) -> DataFrame:
    """A shuffled join; only rows of hot keys are spread over ``salts`` copies of their rows in ``table``.

    Null keys meet nothing, so their rows are spread as well. Hot keys beyond the most frequent are joined plainly.
    """
    hot = hot_keys(facts, on, hot_rows).withColumn("_hot", F.lit(True))
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    nowhere = reduce(or_, [F.col(c).isNull() for c in on])
    facts = facts.join(F.broadcast(hot), on, "left")
    facts = facts.withColumn("_salt", F.when(F.col("_hot") | nowhere, spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    table = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return facts.join(table, [*on, "_salt"], how).drop("_salt")


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    rows: int = LOOKUP_ROWS,
    salts: int = SALTS,
    computed: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``facts`` to ``table`` (left, inner or left_semi): broadcast if the table is small, else shuffled with hot keys salted.

    A computed table is staged, so that counting it and joining it do not run its plan twice. The keys of ``facts``
    are counted before a shuffled join (counts combine before their shuffle, and a scan reads the keys alone).
    """
    on = [on] if isinstance(on, str) else list(on)
    if computed:
        table = stage(table, "lookup")
    if is_small(table, rows):
        return facts.join(F.broadcast(table), on, how)
    return _salted(facts, table, on, how, salts, hot_rows)


def lookup_with_default(
    facts: DataFrame, table: DataFrame, on: str, value: str, default: object, rows: int = LOOKUP_ROWS,
    computed: bool = True,
) -> DataFrame:
    """Dictionary lookup: ``value`` of the matching row, or ``default``."""
    joined = lookup(facts, table.select(on, value), on, "left", rows, computed=computed)
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def keep_known(facts: DataFrame, table: DataFrame, on: Sequence[str] | str, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Rows of ``facts`` whose key occurs in ``table``."""
    on = [on] if isinstance(on, str) else list(on)
    return lookup(facts, table.select(*on).distinct(), on, "left_semi", rows)


def full_outer_fold(tables: dict[str, DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n-way full outer join on ``keys`` in one shuffle: tables are stacked and pivoted by an aggregate.

    Each table holds a key at most once; the columns come out as ``<value>_<table>``.
    """
    stacked = None
    for name, table in tables.items():
        part = table.select(*keys, *values, F.lit(name).alias("_table"))
        stacked = part if stacked is None else stacked.unionByName(part)
    picks: list[Column] = [
        F.max(F.when(F.col("_table") == name, F.col(v))).alias(f"{v}_{name}") for name in tables for v in values
    ]
    return stacked.groupBy(*keys).agg(*picks)


def _cells(spots: DataFrame, size: float) -> DataFrame:
    """Occupied cells of a grid with the tight box around what lies in them and the number of positions."""
    at = [F.floor(F.col(c) / size).alias(n) for c, n in (("_tx", "_cx"), ("_ty", "_cy"))]
    return spots.groupBy(*at).agg(
        F.min("_x0").alias("_x0"), F.max("_x1").alias("_x1"), F.min("_y0").alias("_y0"), F.max("_y1").alias("_y1"),
        F.count(F.lit(1)).alias("_n"),
    )


def _of_point() -> WindowSpec:
    """Rows of one point. Its hash is the key, its position the order: doubles as keys would be sorted anew in each step."""
    return Window.partitionBy("_k").orderBy("_px", "_py")


def _first_of_point(rows: DataFrame) -> DataFrame:
    """One row of each point; whatever else, it leaves the points in order within their partitions."""
    before = F.lag(F.struct("_px", "_py")).over(_of_point())
    firsts = rows.withColumn("_before", before)
    return firsts.where(F.col("_before").isNull() | (F.col("_before") != F.struct("_px", "_py"))).drop("_before")


def _nearer_cells(pairs: DataFrame, radius: float) -> DataFrame:
    """Of the (point, cell) pairs those that can hold the nearest target: no farther than some other cell surely is."""
    zero = F.lit(0.0)
    low = F.hypot(
        F.greatest(zero, F.col("_x0") - F.col("_px"), F.col("_px") - F.col("_x1")),
        F.greatest(zero, F.col("_y0") - F.col("_py"), F.col("_py") - F.col("_y1")),
    )
    high = F.hypot(
        F.greatest(F.abs(F.col("_px") - F.col("_x0")), F.abs(F.col("_px") - F.col("_x1"))),
        F.greatest(F.abs(F.col("_py") - F.col("_y0")), F.abs(F.col("_py") - F.col("_y1"))),
    )
    sure = F.min(high).over(_of_point().rangeBetween(Window.currentRow, Window.currentRow))
    near = pairs.withColumns({"_low": low, "_sure": F.least(sure, F.lit(float(radius))) * (1 + 1e-12) + radius * 1e-9})
    return near.where(F.col("_low") <= F.col("_sure")).select("_k", "_px", "_py", "_cx", "_cy", "_sure")


def _met_cells(near: DataFrame, cells: DataFrame) -> DataFrame:
    """(point, cell) pairs beside what ``cells`` knows of the cell.

    A small table is broadcast: the pairs of a point then stay in the task that holds the point, on all levels and in
    its order, and are neither shuffled, sorted nor written. Else the pairs are staged, since they are counted and joined.
    """
    if is_small(cells):
        return near.join(F.broadcast(cells), ["_cx", "_cy"], "inner")
    return _salted(stage(near, "near"), cells, ["_cx", "_cy"], "inner", SALTS, HOT_ROWS)


def nearest_within(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    point_xy: tuple[str, str] = ("x", "y"),
    target_xy: tuple[str, str] = ("x", "y"),
    target_id: str = "target_id",
    per_cell: int = 64,
    deepest: int = 40,
) -> DataFrame:
    """The nearest target of every point within ``radius``; NULL where there is none, the smaller id on ties.

    Equal positions collapse first. A point starts with the occupied cells around it on a grid of ``radius`` and
    descends with those that can still hold its nearest target, four children at a time, until cells have at most
    ``per_cell`` positions. Only then is it compared with single targets: a crowded cell never meets all its points.
    """
    tx, ty = target_xy
    spots = targets.groupBy(F.col(tx).alias("_tx"), F.col(ty).alias("_ty")).agg(F.min(target_id).alias("_id"))
    spots = spots.withColumns({n: F.col(c) for n, c in (("_x0", "_tx"), ("_x1", "_tx"), ("_y0", "_ty"), ("_y1", "_ty"))})
    gap = F.hypot(F.col("_tx") - F.col("_px"), F.col("_ty") - F.col("_py"))
    return _nearest_spot(points, spots, gap, radius, 1, point_xy, target_id, per_cell, deepest)


def nearest_edge(
    points: DataFrame,
    edges: DataFrame,
    radius: float,
    point_xy: tuple[str, str] = ("x", "y"),
    shape: str = "shape",
    edge_id: str = "edge_id",
    per_cell: int = 64,
    deepest: int = 40,
) -> DataFrame:
    """The edge of every point whose polyline comes nearest, within ``radius``; NULL where there is none, the smaller id on ties.

    ``shape`` is an array of (x, y) structs; a shape of one vertex is that point, an empty or null one is nowhere.
    Equal segments collapse first. A segment is cut into pieces no longer than ``radius``, each placed by its middle;
    a cell's box holds its pieces whole, so the same descent as for single targets applies, and the distance is that
    to the whole segment. Pieces grow with the length of all edges in units of ``radius``.
    """
    shapes = edges.select(F.col(edge_id).alias("_id"), F.col(shape).alias("_shape")).where(F.size("_shape") > 0)
    corner = F.posexplode("_shape").alias("_i", "_a")
    vertices = shapes.select("_id", "_shape", F.size("_shape").alias("_k"), corner).where((F.col("_i") < F.col("_k") - 1) | (F.col("_k") == 1))
    b = F.get("_shape", F.least(F.col("_i") + 1, F.col("_k") - 1))
    ends = {"_ax": F.col("_a")["x"], "_ay": F.col("_a")["y"], "_bx": b["x"], "_by": b["y"]}
    segments = vertices.select("_id", *[c.cast("double").alias(n) for n, c in ends.items()]).where(
        " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in ends)
    )
    segments = segments.groupBy(*ends).agg(F.min("_id").alias("_id"))
    length = F.hypot(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay"))
    pieces = segments.withColumn("_parts", F.greatest(F.ceil(length / radius), F.lit(1)))
    pieces = pieces.withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))))
    on_way = lambda a, b, at: F.col(a) + (F.col(b) - F.col(a)) * (at / F.col("_parts"))
    spots = pieces
    for axis in "xy":
        start, end = (on_way(f"_a{axis}", f"_b{axis}", F.col("_part") - d) for d in (1, 0))
        middle = on_way(f"_a{axis}", f"_b{axis}", F.col("_part") - 0.5)
        spots = spots.withColumns({f"_{axis}0": F.least(start, end), f"_{axis}1": F.greatest(start, end), f"_t{axis}": middle})
    end = lambda c: F.struct(F.col(f"_{c}x").alias("x"), F.col(f"_{c}y").alias("y"))
    foot = project_on_segment(F.col("_px"), F.col("_py"), end("a"), end("b"))
    gap = F.hypot(foot["x"] - F.col("_px"), foot["y"] - F.col("_py"))
    # a piece within the radius has its middle within one and a half: two cells away at most
    return _nearest_spot(points, spots.drop("_parts", "_part"), gap, radius, 2, point_xy, edge_id, per_cell, deepest)


def _nearest_spot(
    points: DataFrame, spots: DataFrame, gap: Column, radius: float, reach: int, point_xy: tuple[str, str],
    target_id: str, per_cell: int, deepest: int,
) -> DataFrame:
    """The descent: ``spots`` have a place (_tx, _ty), a box around it and an id; ``gap`` is the distance from (_px, _py)."""
    px, py = point_xy
    spots = stage(spots, "spots")
    levels = [stage(_cells(spots, radius), "cells")]
    while (levels[-1].agg(F.max("_n")).first()[0] or 0) > per_cell and len(levels) <= deepest:
        levels.append(stage(_cells(spots, radius / 2 ** len(levels)), "cells"))
    near = points.select(F.col(px).alias("_px"), F.col(py).alias("_py")).dropna().distinct().withColumn("_k", F.xxhash64("_px", "_py"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _first_of_point(near.repartition(parts, "_k")).withColumns(
        {"_cx": F.floor(F.col("_px") / radius), "_cy": F.floor(F.col("_py") / radius)}
    )
    step = F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1)]))
    box = ["_x0", "_x1", "_y0", "_y1"]
    for depth, cells in enumerate(levels):
        # cells under the name of what leads to them: on the first level each cell around, then the parent
        if depth:
            led = cells.withColumns({"_fx": F.floor(F.col("_cx") / 2), "_fy": F.floor(F.col("_cy") / 2)})
        else:
            led = cells.withColumn("_dx", step).withColumn("_dy", step).withColumns(
                {"_fx": F.col("_cx") + F.col("_dx"), "_fy": F.col("_cy") + F.col("_dy")}
            )
        near = near.drop("_sure")
        led = led.select(F.col("_fx").alias("_cx"), F.col("_fy").alias("_cy"), F.struct("_cx", "_cy").alias("_to"), *box)
        if depth or is_small(led):
            met = _met_cells(near, led).drop("_cx", "_cy").select("*", "_to._cx", "_to._cy").drop("_to")
        else:
            around = near.withColumn("_dx", step).withColumn("_dy", step).withColumns(
                {"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")}
            )
            met = _met_cells(around.drop("_dx", "_dy"), cells.drop("_n"))
        near = _nearer_cells(met, radius)
        if depth % 6 == 5:
            near = stage(near, "near")  # keeps the plan of a deep descent short
    size = radius / 2 ** (len(levels) - 1)
    placed = spots.withColumn("_cx", F.floor(F.col("_tx") / size)).withColumn("_cy", F.floor(F.col("_ty") / size))
    best = _met_cells(near, placed).withColumn("_gap", gap).where((F.col("_gap") <= radius) & (F.col("_gap") <= F.col("_sure")))
    least = F.min(F.struct("_gap", "_id")).over(_of_point().rangeBetween(Window.currentRow, Window.currentRow))
    best = _first_of_point(best.select("_k", "_px", "_py", least.alias("_best")))
    settled = best.select(
        F.col("_px").alias(px), F.col("_py").alias(py),
        F.col("_best._id").alias(target_id), F.col("_best._gap").alias("gap"),
    )
    return lookup(points, settled, [px, py], "left")
