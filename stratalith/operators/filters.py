"""Filters: condition lists, subset tests, ordered reasons, quantile slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import quantiles


def condition(key: str, kind: str, arg, keep_nan: bool = False) -> Column:
    """One condition. ``range`` is inclusive and needs lo < hi; ``in`` and ``not_in`` take lists. A null value fails."""
    c = F.col(key)
    if kind == "range":
        lo, hi = arg
        if not lo < hi:
            raise ValueError(f"range of {key} needs lo < hi")
        ok = c.between(lo, hi)
        return ok | F.isnan(c) if keep_nan else ok
    if kind == "in":
        return c.isin(*arg)
    if kind == "not_in":
        return ~c.isin(*arg)
    raise ValueError(f"unknown condition {kind}")


def filter_conditions(df: DataFrame, conditions: list[tuple], keep_nan: bool = False) -> DataFrame:
    """Rows that meet all conditions, in one predicate that the scan can take."""
    unknown = [k for k, *_ in conditions if k not in df.columns]
    if unknown:
        raise ValueError(f"no column {unknown}")
    return df.filter(reduce(lambda a, b: a & b, (condition(*c, keep_nan) for c in conditions), F.lit(True)))


def groups_within(groups: DataFrame, members: DataFrame, key: str, member_key: str, value: str, allowed: list) -> DataFrame:
    """Groups none of whose members has a value outside ``allowed``; groups without members stay."""
    other = members.filter(~F.coalesce(F.col(value).isin(*allowed), F.lit(False))).select(F.col(member_key).alias(key))
    return groups.join(other, key, "left_anti")


def first_reason(rules: list[tuple[str, Column]], passed: str = "ok") -> Column:
    """Name of the first rule that holds; ``passed`` if none."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, rule in rules:
        out = out.when(rule, F.lit(name))
    return out.otherwise(F.lit(passed))


def reason_counts(df: DataFrame, rules: list[tuple[str, Column]], passed: str = "ok") -> DataFrame:
    return df.select(first_reason(rules, passed).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def below_quantile(df: DataFrame, value: str, q: float, factor: float = 1.0) -> DataFrame:
    """Rows under ``factor`` times the exact quantile."""
    cut = quantiles(df, value, {"_q": q}).select((F.col("_q") * factor).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).filter(F.col(value) < F.col("_cut")).drop("_cut")


def drop_element(atoms: DataFrame, key: str, z: str, element: int) -> DataFrame:
    """Atoms without an element, unless that would leave a structure empty."""
    left = atoms.filter(F.col(z) != element).select(key).distinct().withColumn("_some", F.lit(True))
    return atoms.join(left, key, "left").filter((F.col(z) != element) | F.col("_some").isNull()).drop("_some")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Kept nodes, and the edges with both ends kept. edges: (src, dst, ...)."""
    kept = nodes.filter(keep)
    ids = kept.select(F.col(node).alias("_n"))
    out = edges.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")
    return kept, out


def physical_filter(df: DataFrame, energy: str, packing: str, most: float, low: float, high: float) -> DataFrame:
    """Non-zero energies under ``most`` with low < packing < high, all strict."""
    return df.filter((F.col(energy) != 0) & (F.col(energy) < most) & (F.col(packing) > low) & (F.col(packing) < high))


def copies_of(df: DataFrame, where: Column, n: int) -> DataFrame:
    """n copies of each selected row."""
    return df.filter(where).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
