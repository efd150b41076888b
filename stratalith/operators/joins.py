"""Joins by distance, nearest value and lattice translation.

Distance joins deal points to grid cells of the cutoff's size, so a pair is met in neighbouring cells
only; they are equi-joins on the cell and never pair all points of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .lineage import cut


def distance2(a: str, b: str, axes) -> F.Column:
    return sum(((F.col(f"{a}{x}") - F.col(f"{b}{x}")) * (F.col(f"{a}{x}") - F.col(f"{b}{x}")) for x in axes), F.lit(0.0))


def radius_join(left: DataFrame, right: DataFrame, cutoff: float, *, group: str | None, axes: tuple[str, ...] = ("x", "y", "z"), point: str = "point", strict: bool = False) -> DataFrame:
    """(group, i, j, dist) with dist <= cutoff (or <), also of a point with itself if it is on both sides.

    The grid spans at most the first three axes; further axes only enter the distance.
    """
    cell_axes = axes[:3]
    keys = [group] if group else []

    def dealt(df, side, near):
        cells = [F.floor(F.col(a) / cutoff).cast("long") for a in cell_axes]
        out = df.select(*keys, F.col(point).alias(side), *(F.col(a).cast("double").alias(f"{side}_{a}") for a in axes), *(c.alias(f"c{k}") for k, c in enumerate(cells)))
        if near:
            moves = F.array(*(F.struct(*(F.lit(m).alias(f"m{k}") for k, m in enumerate(step))) for step in product((-1, 0, 1), repeat=len(cell_axes))))
            out = out.withColumn("m", F.explode(moves)).withColumns({f"c{k}": F.col(f"c{k}") + F.col(f"m.m{k}") for k in range(len(cell_axes))}).drop("m")
        return out

    met = dealt(left, "i", False).join(dealt(right, "j", True), [*keys, *(f"c{k}" for k in range(len(cell_axes)))])
    d2 = distance2("i_", "j_", axes)
    near = d2 < cutoff * cutoff if strict else d2 <= cutoff * cutoff
    return met.filter(near).select(*keys, "i", "j", F.sqrt(d2).alias("dist"))


def near_blocks(points: DataFrame, cutoff: float, solve: Callable[[pa.Table, pa.Table], pa.Table], schema: str, *, group: str | None, keep: tuple[str, ...], axes: tuple[str, ...] = ("x", "y", "z"), share: int = 2048, shares: int = 32) -> DataFrame:
    """``solve`` of the points of each grid cell and all points of the cells around it, where pairs are too many to be rows.

    Only points are shuffled. The first table has each point once, in its own cell; a cell of more than ``share`` points goes to
    several tasks, each with all points around. Both tables have the group, ``keep`` and the axes; null ones meet nothing.
    """
    keys, cells = [group] if group else [], [f"_c{k}" for k in range(len(axes[:3]))]
    home = points.select(*keys, *keep, *(F.col(a).cast("double").alias(a) for a in axes)).withColumns({c: F.floor(F.col(a) / cutoff).cast("long") for c, a in zip(cells, axes, strict=False)})
    full = home.groupBy(*keys, *cells).agg(F.least(F.ceil(F.count(F.lit(1)) / share), F.lit(shares)).cast("int").alias("_s"))
    left = home.join(full, [*keys, *cells]).withColumn("_t", F.pmod(F.xxhash64(*keep), "_s").cast("int")).drop("_s")
    moves = F.array(*(F.struct(*(F.lit(m).alias(f"m{k}") for k, m in enumerate(step))) for step in product((-1, 0, 1), repeat=len(cells))))
    right = home.withColumn("_m", F.explode(moves)).withColumns({c: F.col(c) + F.col(f"_m.m{k}") for k, c in enumerate(cells)}).drop("_m")
    right = right.join(full, [*keys, *cells]).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    right = right.toDF(*right.columns)  # columns of its own
    at = [*keys, *cells, "_t"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(solve, schema)


def coordinates(table: pa.Table, axes: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(table[a].to_numpy(), float) for a in axes]


def block_distance2(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Of each of ``a`` to each of ``b``, added up as distance2 does."""
    out = np.square(np.subtract.outer(a[0], b[0]))
    for x, y in zip(a[1:], b[1:], strict=True):
        d = np.subtract.outer(x, y)
        out += np.square(d, out=d)
    return out


def blocks(n: int, m: int, most: int = 1 << 20):
    """Slices of n rows, of about ``most`` cells with m columns."""
    step = max(1, most // max(m, 1))
    return (slice(k, k + step) for k in range(0, n, step))


def radial_graph(atoms: DataFrame, cutoff: float, *, group: str = "graph", point: str = "point", molecule: str | None = None, inside: F.Column | None = None, axes=("x", "y", "z")) -> DataFrame:
    """Edges (group, i, j, dist, kind): from inside atoms to all others; ``intra`` if both are of one molecule and inside, else ``inter``."""
    inside = F.lit(True) if inside is None else inside
    edges = radius_join(atoms.filter(inside), atoms, cutoff, group=group, point=point, axes=axes).filter("i <> j")
    side = atoms.select(group, F.col(point), inside.alias("_in"), (F.col(molecule) if molecule else F.lit(0)).alias("_mol"))
    for s in "ij":
        edges = edges.join(side.withColumnsRenamed({point: s, "_in": f"in_{s}", "_mol": f"mol_{s}"}), [group, s])
    kind = F.when(F.col("in_j") & F.col("mol_i").eqNullSafe(F.col("mol_j")), "intra").otherwise("inter")
    return edges.select(group, "i", "j", "dist", kind.alias("kind"))


def k_nearest(edges: DataFrame, k: int, source: str = "i", tie: str = "j") -> DataFrame:
    """The k shortest edges of each source."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy("dist", tie))).filter(F.col("rank") <= k)


def nearest_value_join(rows: DataFrame, table: DataFrame, value: str, table_value: str, table_key: str, row_key: str) -> DataFrame:
    """The table row nearest in value to each row; the least key among equals.

    Both sides are dealt to ranges of the value; each row needs only the last table value at or below it
    and the first above, carried along in order within a range and over empty ranges by a scan of range ends.
    """
    t = table.groupBy(F.col(table_value).cast("double").alias("v")).agg(F.min(table_key).alias("k"))
    both = t.select("v", "k", F.lit(None).cast(dict(rows.dtypes)[row_key]).alias("r"), F.lit(0).alias("side")).unionByName(rows.select(F.col(value).cast("double").alias("v"), F.lit(None).cast(dict(t.dtypes)["k"]).alias("k"), F.col(row_key).alias("r"), F.lit(1).alias("side")))
    dealt = cut(both.filter("v IS NOT NULL").repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    hit = F.when(F.col("side") == 0, F.struct("v", "k"))
    ends = dealt.groupBy("p").agg(F.min(hit).alias("lo"), F.max(hit).alias("hi"))
    w = Window.orderBy("p")
    ends = ends.select("p", F.last("hi", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("lo", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    own = Window.partitionBy("p").orderBy("v", "side")
    back = Window.partitionBy("p").orderBy(F.desc("v"), F.desc("side"))
    near = dealt.withColumn("_lo", F.last(hit, True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last(hit, True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.filter("side = 1").join(F.broadcast(ends), "p").withColumn("_lo", F.coalesce("_lo", "before")).withColumn("_hi", F.coalesce("_hi", "after"))
    gap = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("v")).alias("gap"), F.col(f"{c}.k").alias("k"))) for c in ("_lo", "_hi")]
    return near.select(F.col("r").alias(row_key), F.least(*gap).alias("best")).select(row_key, F.col("best.k").alias(table_key), F.col("best.gap").alias("gap"))


def shift_grid(spark, n: int, most: float | None = None) -> DataFrame:
    """Integer translations (x, y, z) within +-n, of a norm up to ``most``, in order of (L1 norm, x, y, z)."""
    axis = F.explode(F.sequence(F.lit(-n), F.lit(n)))
    grid = spark.range(1).select(axis.alias("x")).select("x", axis.alias("y")).select("x", "y", axis.alias("z"))
    if most is not None:
        grid = grid.filter(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z") <= most * most)
    return grid.withColumn("l1", F.abs("x") + F.abs("y") + F.abs("z")).orderBy("l1", "x", "y", "z")


def periodic_neighbours(atoms: DataFrame, cells: DataFrame, cutoff: float, *, group: str = "graph", point: str = "point", most: int = 8) -> DataFrame:
    """(group, i, j, sx, sy, sz, dist): |r_j + S.cell - r_i| < cutoff, i = j only with S <> 0. Exact for unwrapped positions.

    cells: group and rows ax..cz. Atoms are wrapped into their cell, images within the cutoff of it are made by
    the number of shifts each axis needs (``most`` is checked, never cut off), and pairs are met by a radius join.
    """
    v = [g.vec(f"{r}x", f"{r}y", f"{r}z") for r in "abc"]
    vol = g.determinant(v)
    normals = [g.scale(g.cross(v[(k + 1) % 3], v[(k + 2) % 3]), 1 / vol) for k in range(3)]
    c = cells.select(group, *(f"{r}{x}" for r in "abc" for x in "xyz"), *(n.alias(f"n{k}{x}") for k, row in enumerate(normals) for x, n in zip("xyz", row, strict=True)))
    need = [F.ceil(cutoff * g.norm(normals[k])).cast("int").alias(f"s{k}") for k in range(3)]
    c = c.join(cells.select(group, *need), group)
    ok = F.assert_true(F.greatest("s0", "s1", "s2") <= most, F.lit(f"a cell needs more than {most} shifts along an axis"))
    c = c.withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_ok")
    p = atoms.select(group, point, *(F.col(a).cast("double").alias(a) for a in "xyz")).join(c, group)
    frac = [F.col("x") * F.col(f"n{k}x") + F.col("y") * F.col(f"n{k}y") + F.col("z") * F.col(f"n{k}z") for k in range(3)]
    p = p.withColumns({f"w{k}": F.floor(frac[k]).cast("int") for k in range(3)})

    def at(shift):
        return {x: F.col(x) + sum((shift[k] * F.col(f"{r}{x}") for k, r in enumerate("abc")), F.lit(0.0)) for x in "xyz"}

    home = p.withColumns(at([-F.col(f"w{k}") for k in range(3)]))
    image = home
    for k in range(3):
        image = image.withColumn(f"t{k}", F.explode(F.sequence(-F.col(f"s{k}") - 1, F.col(f"s{k}") + 1)))
    image = image.withColumns(at([F.col(f"t{k}") for k in range(3)]))
    image = image.withColumn("_id", F.struct(F.col(point).alias("p"), *(F.col(f"{a}{k}") for a in "tw" for k in range(3))))
    base = home.withColumn("_id", F.struct(F.col(point).alias("p"), *(F.lit(0).alias(f"t{k}") for k in range(3)), *(F.col(f"w{k}") for k in range(3))))
    e = radius_join(base, image, cutoff, group=group, point="_id", strict=True)
    shift = [(F.col(f"j.t{k}") + F.col(f"i.w{k}") - F.col(f"j.w{k}")).cast("int").alias(f"s{x}") for k, x in enumerate("xyz")]
    out = e.select(group, F.col("i.p").alias("i"), F.col("j.p").alias("j"), *shift, "dist")
    return out.filter((F.col("i") != F.col("j")) | (F.col("sx") != 0) | (F.col("sy") != 0) | (F.col("sz") != 0))


def angle_paths(bonds: DataFrame, group: str | None = None, centres=None) -> DataFrame:
    """(i, centre, k) with i < k for bonds (src, dst) listed both ways. centres: a condition on ``centre``."""
    keys = [group] if group else []
    a = bonds.select(*keys, F.col("src").alias("i"), F.col("dst").alias("centre"))
    b = bonds.select(*keys, F.col("src").alias("centre"), F.col("dst").alias("k"))
    if centres is not None:
        a, b = a.filter(centres), b.filter(centres)
    return a.join(b, [*keys, "centre"]).filter("i < k").select(*keys, "i", "centre", "k")


def torsion_paths(bonds: DataFrame, group: str | None = None, *, share: int = 256, wide: int = 65536, tile: tuple[int, int] = (64, 128), tasks: int | None = None) -> DataFrame:
    """(i, j, k, l) once each (j < k) for bonds listed both ways.

    Paths of two bonds are no rows: a middle bond gets the neighbours of both its ends as lists, if each end has another neighbour, in pieces of
    ``share`` neighbours of j and ``wide`` of k, and these are dealt to ``tasks`` (the session's shuffle partitions) before their paths are made. The
    lists are no longer than the paths and bonds are many; sizes of what is dealt say little of the paths, so partitions aren't merged by size.
    Spark's generated code holds all rows that it makes of one before it hands them on, so pieces are cut up to ``tile`` first, in a step of its own.
    """
    keys = [group] if group else []
    tasks = tasks or int(bonds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = bonds.groupBy(*keys, "src").agg(F.collect_list("dst").alias("near")).filter(F.array_min("near") < F.array_max("near"))

    def cut_up(rows: DataFrame, side: str, most: int, part: str) -> DataFrame:
        parts = F.explode(F.sequence(F.lit(0), F.floor((F.size(side) - 1) / most).cast("int")))
        return rows.withColumn(part, parts).withColumn(side, F.slice(side, F.col(part) * most + 1, most))

    def end(node: str, others: str, most: int) -> DataFrame:
        return cut_up(near.select(*keys, F.col("src").alias(node), F.col("near").alias(others)), others, most, f"_p{node}")

    middle = near.select(*keys, F.col("src").alias("k"), F.explode("near").alias("j")).filter("j < k")
    both = middle.join(end("j", "_i", share), [*keys, "j"]).join(end("k", "_l", wide), [*keys, "k"])
    both = both.select(*keys, "j", "k", F.array_remove("_i", F.col("k")).alias("_i"), F.array_remove("_l", F.col("j")).alias("_l"), "_pj", "_pk").filter("size(_i) > 0 AND size(_l) > 0")
    dealt = both.repartition(tasks, *keys, "j", "k", "_pj", "_pk").drop("_pj", "_pk")
    tiles = cut_up(cut_up(dealt, "_l", tile[1], "_t"), "_i", tile[0], "_t").drop("_t").coalesce(tasks)  # merges nothing, but ends the generated code
    return tiles.select(*keys, F.explode("_i").alias("i"), "j", "k", "_l").select(*keys, "i", "j", "k", F.explode("_l").alias("l")).filter("l <> i")


def checked_lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their parameters; an unknown key raises when the row is read."""
    met = rows.join(table.withColumn("_known", F.lit(True)), keys, "left")
    ok = F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("no parameters for "), F.to_json(F.struct(*keys))))
    return met.withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_ok", "_known")


def infer_bonds(atoms: DataFrame, *, group: str = "graph", point: str = "point", tolerance: float = 1.2) -> DataFrame:
    """Pairs i < j nearer than tolerance * (ri + rj); atoms: (group, point, x, y, z, r). Atoms are met within the reach of the two largest radii."""
    largest = 2 * (atoms.agg(F.max("r")).first()[0] or 0.0) + 1e-9
    e = radius_join(atoms, atoms, tolerance * largest, group=group, point=point).filter("i < j")
    for s in "ij":
        e = e.join(atoms.select(group, F.col(point).alias(s), F.col("r").alias(f"r{s}")), [group, s])
    return e.filter(F.col("dist") < tolerance * (F.col("ri") + F.col("rj"))).select(group, "i", "j", "dist")


def symmetry_images(structures: DataFrame, ops: DataFrame, key: str = "sg_ind") -> DataFrame:
    """Fractional centroids (fx, fy, fz) under each operator of the space group, wrapped; exactly 1 stays 1."""
    met = structures.join(F.broadcast(ops), key)
    new = {f"f{x}": g.wrap_unit(F.col(f"r{i}1") * F.col("fx") + F.col(f"r{i}2") * F.col("fy") + F.col(f"r{i}3") * F.col("fz") + F.col(f"t{i}")) for i, x in ((1, "x"), (2, "y"), (3, "z"))}
    return met.withColumns(new)


def nonbonded_pairs(pairs: DataFrame, bonds: DataFrame, least: int, group: str = "graph") -> DataFrame:
    """Pairs (i < j) that are ``least`` or more bonds apart, or not connected. bonds: (src, dst) listed both ways."""
    reach = bonds.select(group, F.col("src").alias("i"), F.col("dst").alias("j")).distinct()
    near, step = reach, reach
    for _ in range(least - 2):
        step = step.join(bonds.select(group, F.col("src").alias("j"), F.col("dst").alias("_n")), [group, "j"]).select(group, "i", F.col("_n").alias("j")).distinct()
        near = near.unionByName(step)
    return pairs.filter("i < j").join(near.distinct(), [group, "i", "j"], "left_anti")


def nonbonded_points(points: DataFrame, cutoff: float, bond: float, *, group: str = "graph", point: str = "point", axes: tuple[str, ...] = ("x", "y", "z"), width: int = 8192) -> DataFrame:
    """(group, i, j): pairs i < j within ``cutoff`` that are three or more bonds apart, or not connected, where points within ``bond`` are bonded.

    The result of nonbonded_pairs for bonds by distance (``bond`` <= ``cutoff``). Paths of two bonds are no rows: a point's bonded neighbours are sets of
    bits, united a few at a time until no pair of it is open.
    """
    if bond > cutoff:
        raise ValueError("bonds are longer than the cutoff")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        n, at, to = left.num_rows, coordinates(left, axes), coordinates(right, axes)
        ids, order = right[point].to_numpy(), np.unique(np.concatenate([left[point].to_numpy(), right[point].to_numpy()]), return_inverse=True)[1]
        near = [np.zeros(0, np.int64)] * n
        for s in blocks(n, right.num_rows):
            rows = np.sqrt(block_distance2([x[s] for x in at], to)) <= bond
            near[s] = [np.nonzero(r)[0] for r in rows]
        used = np.unique(np.concatenate(near)) if n else np.zeros(0, np.int64)
        near = [np.searchsorted(used, k) for k in near]
        mid, found = [x[used] for x in to], ([], [])
        for w in range(0, right.num_rows, width):  # points j, some at a time
            part = [x[w : w + width] for x in to]
            bits = np.concatenate([np.packbits(np.sqrt(block_distance2([x[s] for x in mid], part)) <= bond, axis=1) for s in blocks(len(used), len(part[0]))] or [np.zeros((0, (len(part[0]) + 7) // 8), np.uint8)])
            for s in blocks(n, len(part[0])):
                d = np.sqrt(block_distance2([x[s] for x in at], part))
                asked = np.packbits((d <= cutoff) & (d > bond) & (order[:n][s, None] < order[n:][w : w + width]), axis=1)
                for i, left_open in enumerate(asked, s.start):
                    k, many = 0, 32
                    while k < len(near[i]) and left_open.any():
                        left_open &= ~np.bitwise_or.reduce(bits[near[i][k : k + many]], axis=0)
                        k, many = k + many, many * 2
                    if left_open.any():
                        j = np.nonzero(np.unpackbits(left_open, count=len(part[0])))[0] + w
                        found[0].append(np.full(len(j), i))
                        found[1].append(j)
        i, j = (np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64) for f in found)
        return pa.table({group: left[group].take(pa.array(i)), "i": left[point].take(pa.array(i)), "j": pa.array(ids[j], left.schema.field(point).type)})

    t = dict(points.dtypes)
    return near_blocks(points, cutoff, solve, f"{group} {t[group]}, i {t[point]}, j {t[point]}", group=group, keep=(point,), axes=axes)


def typed_pair_counts(atoms: DataFrame, cutoff: float, *, group: str = "graph", point: str = "point", kind: str = "z", axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(group, a, b, d, n): how many near pairs have the lesser type a, the greater b and the distance d in hundredths. Pairs are counted where they meet, none is a row."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        n, names = left.num_rows, left.column_names
        order = np.unique(np.concatenate([left[point].to_numpy(), right[point].to_numpy()]), return_inverse=True)[1]
        kinds, code = np.unique(np.concatenate([left[kind].to_numpy(), right[kind].to_numpy()]), return_inverse=True)
        at, to = coordinates(left, axes), coordinates(right, axes)
        bins = int(np.floor(cutoff * 100)) + 2
        total = np.zeros(len(kinds) ** 2 * bins, np.int64)
        for s in blocks(n, right.num_rows):
            d2 = block_distance2([x[s] for x in at], to)
            i, j = np.nonzero((d2 <= cutoff * cutoff) & (order[:n][s, None] < order[n:]))
            ki, kj = code[:n][s][i], code[n:][j]
            d = np.floor(np.sqrt(d2[i, j]) * 100).astype(np.int64)
            total += np.bincount((np.minimum(ki, kj) * len(kinds) + np.maximum(ki, kj)) * bins + d, minlength=len(total))
        k = np.nonzero(total)[0]
        types = pa.array(kinds, left.schema.field(kind).type)
        g = pa.chunked_array([left[names[0]].combine_chunks().take(pa.array(np.zeros(len(k), np.int64)))])
        return pa.table({group: g, "a": types.take(pa.array(k // bins // len(kinds))), "b": types.take(pa.array(k // bins % len(kinds))), "d": pa.array((k % bins).astype(np.int32)), "n": pa.array(total[k])})

    t = dict(atoms.dtypes)
    rows = atoms.filter(F.col(kind).isNotNull() & F.col(point).isNotNull())
    met = near_blocks(rows, cutoff, count, f"{group} {t[group]}, a {t[kind]}, b {t[kind]}, d int, n long", group=group, keep=(point, kind), axes=axes)
    return met.groupBy(group, "a", "b", "d").agg(F.sum("n").alias("n"))


def typed_pairs(atoms: DataFrame, cutoff: float, *, group: str = "graph", point: str = "point", kind: str = "z") -> DataFrame:
    """(group, fingerprint): sorted array of (lesser type, greater type, distance in hundredths) of near pairs."""
    items = typed_pair_counts(atoms, cutoff, group=group, point=point, kind=kind).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("a", "b", "d", "n"))).alias("_i"))
    return items.select(group, F.flatten(F.transform("_i", lambda x: F.array_repeat(F.struct(x["a"].alias("a"), x["b"].alias("b"), x["d"].alias("d")), x["n"].cast("int")))).alias("fingerprint"))


def typed_pair_text(atoms: DataFrame, cutoff: float, *, group: str = "graph", point: str = "point", kind: str = "z") -> DataFrame:
    """(group, fingerprint): the items of typed_pairs as a-b-d, comma-joined. Equal items are repeated as text only."""
    items = typed_pair_counts(atoms, cutoff, group=group, point=point, kind=kind).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("a", "b", "d", "n"))).alias("_i"))

    def times(x):
        one = F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"), x["d"].cast("string"))
        return F.concat(one, F.repeat(F.concat(F.lit(","), one), (x["n"] - 1).cast("int")))

    return items.select(group, F.array_join(F.transform("_i", times), ",").alias("fingerprint"))


def exact_matches(rows: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key equals a target's; the target listed last (greatest ``value``) counts."""
    last = targets.groupBy(key).agg(F.max(value).alias(value))
    return rows.join(last, key)


def lattice_translations(structures: DataFrame, cutoff: float, key: str, most: int = 1_000_000) -> DataFrame:
    """(key, n0, n1, n2): translations whose cell centres lie within 2 radius + cutoff + 0.1 + half the diagonal; always the zero one. Rows have box vectors ax..cz and ``radius``.

    Each axis gets the shifts that the reach and the spacing of its planes need; a cell that needs more than ``most`` raises.
    """
    v = [g.vec(f"{r}x", f"{r}y", f"{r}z") for r in "abc"]
    reach = 2 * F.col("radius") + cutoff + 0.1 + g.norm(g.add(g.add(v[0], v[1]), v[2])) / 2
    volume = F.abs(g.dot(v[0], g.cross(v[1], v[2])))
    need = [F.floor(reach * g.norm(g.cross(v[(k + 1) % 3], v[(k + 2) % 3])) / volume + 1e-9) for k in range(3)]
    grid = structures.withColumns({f"_s{k}": need[k].cast("int") for k in range(3)})
    ok = F.assert_true((2 * F.col("_s0") + 1.0) * (2 * F.col("_s1") + 1.0) * (2 * F.col("_s2") + 1.0) <= most, F.lit(f"a cell needs more than {most} translations"))
    grid = grid.withColumn("_ok", ok).filter(F.col("_ok").isNull())
    for k in range(3):
        grid = grid.withColumn(f"n{k}", F.explode(F.sequence(-F.col(f"_s{k}"), F.col(f"_s{k}"))))
    at = g.add(g.add(g.scale(v[0], F.col("n0")), g.scale(v[1], F.col("n1"))), g.scale(v[2], F.col("n2")))
    zero = (F.col("n0") == 0) & (F.col("n1") == 0) & (F.col("n2") == 0)
    return grid.filter(zero | (g.norm(at) < reach)).select(key, "n0", "n1", "n2")
