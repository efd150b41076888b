"""Ragged layout: explode, regroup, gather, repeat, chunk, offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lineage import cut


def to_lists(rows: DataFrame, key: str, order: list[str], values: list[str], name: str = "items") -> DataFrame:
    """One row per key with its ordered members as an array of structs."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias(name))


def to_rows(lists: DataFrame, name: str = "items", index: str = "index") -> DataFrame:
    keep = [c for c in lists.columns if c != name]
    return lists.select(*keep, F.posexplode(name).alias(index, "_item")).select(*keep, index, "_item.*")


def gather(rows: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """Rows by a pick list (position, key): duplicates multiply rows and the position keeps the order."""
    return picks.join(rows, key)


def append(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both tables, ids of the second moved past the first's greatest. Columns must be the same."""
    if set(first.columns) != set(second.columns):
        raise ValueError("tables differ in their columns")
    top = first.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).alias("_o"))
    moved = second.crossJoin(F.broadcast(top)).withColumn(key, F.col(key) + F.col("_o")).drop("_o")
    return first.unionByName(moved)


def repeat_rows(rows: DataFrame, count: str, index: str = "copy") -> DataFrame:
    """Each row ``count`` times; none for 0 or null."""
    return rows.filter(F.col(count) > 0).withColumn(index, F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))


def strided_chunk(order: Column, n: int) -> Column:
    """Chunk of an item by its rank in ``order``: item i goes to i mod n."""
    return F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(n))


def offsets(counts: DataFrame, key: str, count: str) -> DataFrame:
    """Exclusive running sum of counts in key order, in two levels: ranges of keys, then within."""
    spread = cut(counts.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))
    sums = spread.groupBy("_p").agg(F.sum(count).alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    own = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(F.broadcast(before), "_p")
    return out.withColumn("offset", F.col("_b") + F.coalesce(F.sum(count).over(own), F.lit(0))).drop("_p", "_b")


def flatten_struct(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as flat columns, until none is left."""
    while any(isinstance(f.dataType, StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}{sep}{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def pad(array, size: int, fill) -> Column:
    """An array filled up on the right."""
    return F.concat(array, F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(array), F.lit(0))))


def split_units(crystals: DataFrame, units: str = "aunits", index: str = "unit") -> DataFrame:
    """A row for each molecule of the asymmetric unit."""
    keep = [c for c in crystals.columns if c != units]
    return crystals.select(*keep, F.posexplode(units).alias(index, "_u")).select(*keep, index, "_u.*")


def join_units(rows: DataFrame, key: str, unit_columns: list[str], units: str = "aunits", index: str = "unit") -> DataFrame:
    """Inverse of split_units: units in order of their index."""
    other = [c for c in rows.columns if c not in (key, index, *unit_columns)]
    g = rows.groupBy(key).agg(*(F.first(c).alias(c) for c in other), F.array_sort(F.collect_list(F.struct(index, *unit_columns))).alias("_u"))
    return g.withColumn(units, F.transform("_u", lambda u: F.struct(*(u[c].alias(c) for c in unit_columns)))).drop("_u")


def canonical_units(units, x: str = "cx", y: str = "cy", z: str = "cz") -> Column:
    """An array of units sorted by distance from the origin."""
    keyed = F.transform(units, lambda u: F.struct((u[x] * u[x] + u[y] * u[y] + u[z] * u[z]).alias("d"), u.alias("u")))
    return F.transform(F.array_sort(keyed), lambda k: k["u"])


def allowed_index(value, allowed: list) -> Column:
    """Position of a type among the allowed ones, else -1."""
    return F.coalesce(F.array_position(F.array(*(F.lit(a) for a in allowed)), value) - 1, F.lit(-1)).cast("int")
