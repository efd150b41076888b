"""Dimension tables: elements and space groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Van der Waals radii (Angstrom) of elements 0 to 99.
VDW_RADII = [
    0.0, 1.2, 1.4, 2.2, 1.9, 1.8, 1.7, 1.6, 1.55, 1.5, 1.54, 2.4, 2.2, 2.1, 2.1, 1.95, 1.8, 1.8, 1.88, 2.8,
    2.4, 2.3, 2.15, 2.05, 2.05, 2.05, 2.05, 2.0, 2.0, 2.0, 2.1, 2.1, 2.1, 2.05, 1.9, 1.9, 2.02, 2.9, 2.55, 2.4,
    2.3, 2.15, 2.1, 2.05, 2.05, 2.0, 2.05, 2.1, 2.2, 2.2, 2.25, 2.2, 2.1, 2.1, 2.16, 3.0, 2.7, 2.5, 2.48, 2.47,
    2.45, 2.43, 2.42, 2.4, 2.38, 2.37, 2.35, 2.33, 2.32, 2.3, 2.28, 2.27, 2.25, 2.2, 2.1, 2.05, 2.0, 2.0, 2.05, 2.1,
    2.05, 2.2, 2.3, 2.3, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.4, 2.0, 2.3, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0,
]

# Atomic weights of elements 0 to 54 (u).
ATOM_WEIGHTS = [
    1.0, 1.008, 4.002602, 6.94, 9.0121831, 10.81, 12.011, 14.007, 15.999, 18.998403163, 20.1797, 22.98976928, 24.305, 26.9815385,
    28.085, 30.973761998, 32.06, 35.45, 39.948, 39.0983, 40.078, 44.955908, 47.867, 50.9415, 51.9961, 54.938044, 55.845, 58.933194,
    58.6934, 63.546, 65.38, 69.723, 72.63, 74.921595, 78.971, 79.904, 83.798, 85.4678, 87.62, 88.90584, 91.224, 92.90637, 95.95,
    97.90721, 101.07, 102.9055, 106.42, 107.8682, 112.414, 114.818, 118.71, 121.76, 127.6, 126.90447, 131.293,
]

# Symbols of elements 0 (none) to 54.
SYMBOLS = "X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe".split()

# Electronegativities (Pauling) of elements 0 to 54; -1 is unknown.
ELECTRONEGATIVITY = [
    -1, 2.2, -1, 0.98, 1.57, 2.04, 2.55, 3.04, 3.44, 3.98, -1, 0.93, 1.31, 1.61, 1.9, 2.19, 2.58, 3.16, -1, 0.82, 1.0, 1.36, 1.54, 1.63,
    1.66, 1.55, 1.83, 1.88, 1.91, 1.9, 1.65, 1.81, 2.01, 2.18, 2.55, 2.96, -1, 0.82, 0.95, 1.22, 1.33, 1.6, 2.16, 2.1, 2.2, 2.28,
    2.2, 1.93, 1.69, 1.78, 1.96, 2.05, 2.1, 2.66, 2.6,
]

# Last space group of each crystal system.
SYSTEMS = [(2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"), (194, "hexagonal"), (230, "cubic")]

# Asymmetric unit box (fractions of the cell) by space group. Groups without a stated box count as the whole cell.
ASYM_UNITS = {
    1: (1, 1, 1), 2: (0.5, 1, 1), 3: (1, 1, 0.5), 4: (1, 1, 0.5), 5: (0.5, 0.5, 1), 6: (1, 0.5, 1), 7: (1, 0.5, 1), 8: (1, 0.25, 1),
    9: (1, 0.25, 1), 10: (0.5, 0.5, 1), 11: (1, 0.25, 1), 12: (0.5, 0.25, 1), 13: (0.5, 1, 0.5), 14: (1, 0.25, 1), 15: (0.5, 0.5, 0.5),
    16: (0.5, 0.5, 1), 17: (0.5, 0.5, 1), 18: (0.5, 0.5, 1), 19: (0.5, 0.5, 1), 20: (0.5, 0.5, 0.5), 21: (0.25, 0.5, 1), 22: (0.25, 0.25, 1),
    23: (0.5, 0.5, 0.5), 24: (0.5, 0.5, 0.5), 25: (0.5, 0.5, 1), 26: (0.5, 0.5, 1), 27: (0.5, 0.5, 1), 28: (0.25, 1, 1), 29: (0.25, 1, 1),
    30: (0.5, 1, 0.5), 31: (0.5, 0.5, 1), 32: (0.5, 0.5, 1), 33: (0.5, 0.5, 1), 34: (0.5, 0.5, 1), 35: (0.25, 0.5, 1), 36: (0.5, 0.5, 0.5),
    37: (0.25, 0.5, 1), 38: (0.5, 0.5, 0.5), 39: (0.5, 0.25, 1), 40: (0.25, 0.5, 1), 41: (0.5, 0.5, 0.5), 42: (0.25, 0.25, 1), 43: (0.25, 0.25, 1),
    44: (0.5, 0.5, 0.5), 45: (0.5, 0.5, 0.5), 46: (0.25, 1, 0.5), 47: (0.5, 0.5, 0.5), 48: (0.25, 0.5, 1), 49: (0.5, 0.5, 0.5), 50: (0.5, 0.5, 0.5),
    51: (0.25, 0.5, 1), 52: (1, 0.25, 0.5), 53: (0.5, 1, 0.25), 54: (0.5, 0.5, 0.5), 55: (0.5, 0.5, 0.5), 56: (0.25, 1, 0.5), 57: (0.5, 1, 0.25),
    58: (0.5, 0.5, 0.5), 59: (0.5, 0.5, 0.5), 60: (0.5, 0.5, 0.5), 61: (0.5, 0.5, 0.5), 62: (0.5, 0.25, 1), 63: (0.5, 0.5, 0.25), 64: (0.25, 0.5, 0.5),
    65: (0.25, 0.5, 0.5), 66: (0.25, 0.5, 0.5), 67: (0.5, 0.25, 0.5), 68: (0.25, 0.5, 0.5), 69: (0.25, 0.25, 0.5), 70: (0.125, 0.25, 1),
    71: (0.25, 0.5, 0.5), 72: (0.25, 0.5, 0.5), 73: (0.25, 0.5, 0.5), 74: (0.25, 0.25, 1), 75: (0.5, 0.5, 1), 76: (0.5, 0.5, 1), 77: (0.5, 0.5, 1),
    78: (0.5, 0.5, 1), 79: (0.5, 0.5, 0.5), 80: (0.5, 1, 0.25), 81: (0.5, 0.5, 1), 82: (0.5, 0.5, 0.5), 83: (0.5, 0.5, 0.5), 84: (0.5, 0.5, 0.5),
    85: (0.5, 0.5, 0.5), 86: (0.5, 1, 0.25), 87: (0.5, 0.5, 0.25), 88: (0.25, 0.25, 1), 89: (0.5, 0.5, 0.5), 90: (0.5, 0.5, 0.5), 91: (1, 1, 0.125),
    92: (1, 1, 0.125), 93: (0.5, 1, 0.25), 94: (0.5, 0.5, 0.5), 95: (1, 1, 0.125), 96: (1, 1, 0.125), 97: (0.5, 0.5, 0.25), 98: (0.5, 1, 0.125),
    103: (0.5, 0.5, 0.5), 104: (0.5, 0.5, 0.5), 105: (0.5, 0.5, 0.5), 106: (0.5, 0.5, 0.5), 109: (0.5, 0.5, 0.25), 110: (0.5, 0.5, 0.25),
    112: (0.5, 0.5, 0.5), 114: (0.5, 0.5, 0.5), 115: (0.5, 0.5, 0.5), 116: (0.5, 1, 0.25), 117: (0.5, 0.5, 0.5), 118: (0.5, 1, 0.25),
    119: (0.5, 0.5, 0.25), 120: (0.5, 0.5, 0.25), 122: (0.5, 1, 0.125), 124: (0.5, 0.5, 0.25), 126: (0.5, 0.5, 0.25), 128: (0.5, 0.5, 0.25),
    130: (0.5, 0.5, 0.25), 131: (0.5, 0.5, 0.25), 133: (0.5, 0.5, 0.25), 135: (0.5, 0.5, 0.25), 137: (0.5, 0.5, 0.25), 141: (0.5, 0.5, 0.125),
    142: (0.5, 0.5, 0.125),
}


def elements(spark: SparkSession) -> DataFrame:
    """(z, symbol, vdw_radius, weight, electronegativity); columns beyond a list's end are null. At most 100 rows."""

    def at(xs, z):
        return xs[z] if z < len(xs) else None

    rows = [(z, at(SYMBOLS, z), float(r), at(ATOM_WEIGHTS, z), None if at(ELECTRONEGATIVITY, z) is None else float(ELECTRONEGATIVITY[z])) for z, r in enumerate(VDW_RADII)]
    return spark.createDataFrame(rows, "z int, symbol string, vdw_radius double, weight double, electronegativity double")


def crystal_system(sg):
    """System of a space group number; null outside 1 to 230."""
    c = F.col(sg) if isinstance(sg, str) else sg
    out = F.when(c < 1, F.lit(None).cast("string"))
    for last, name in SYSTEMS:
        out = out.when(c <= last, F.lit(name))
    return out


def space_groups(spark: SparkSession, asym_units: dict[int, tuple] | None = None) -> DataFrame:
    """(sg_ind, system, ax, ay, az). asym_units: boxes by group; those missing are the whole cell."""
    boxes = ASYM_UNITS if asym_units is None else asym_units
    rows = [(g, *(float(v) for v in boxes.get(g, (1, 1, 1)))) for g in range(1, 231)]
    return spark.createDataFrame(rows, "sg_ind int, ax double, ay double, az double").withColumn("system", crystal_system("sg_ind"))


def parse_symmetry(op) -> dict[str, object]:
    """Nine rotation and three translation columns of an operator string like ``-x,y+1/2,1/2-z``."""
    parts = F.split(F.regexp_replace(F.lower(op), r"\s", ""), ",")
    out = {}
    for i in range(3):
        p = parts[i]
        for j, axis in enumerate("xyz"):
            out[f"r{i + 1}{j + 1}"] = F.when(p.contains(f"-{axis}"), -1.0).when(p.contains(axis), 1.0).otherwise(0.0)
        num = F.regexp_extract(p, r"([+-]?\d+(?:\.\d+)?)(?:/(\d+))?", 1)
        den = F.regexp_extract(p, r"([+-]?\d+(?:\.\d+)?)(?:/(\d+))?", 2)
        value = F.when(num == "", 0.0).otherwise(F.try_to_number(num, F.lit("S999.999")).cast("double"))
        out[f"t{i + 1}"] = value / F.when(den == "", 1.0).otherwise(F.nullif(den, F.lit("")).cast("double"))
    return out
