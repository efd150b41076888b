"""Readers and writers of structure files and logs, by built-in text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hashed_order, hashed_uniform
from ..functions.tables import SYMBOLS


def element_number(symbol):
    """Atomic number of a symbol; null for an unknown one."""
    table = F.create_map(*(F.lit(v) for z, s in enumerate(SYMBOLS) for v in (s, z)))
    return F.try_element_at(table, symbol)


def read_xyz(texts: DataFrame, key: str = "name", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(molecules, atoms) of whole XYZ texts: line 0 the number, line 1 tab-separated properties, then ``symbol x y z q``. Texts whose number can't be read are left out."""
    lines = F.split(F.col(text), "\r?\n")
    n = F.trim(lines[0]).try_cast("int")
    rows = texts.select(key, lines.alias("lines"), n.alias("n_atoms")).filter(F.col("n_atoms").isNotNull())
    props = F.transform(F.slice(F.split(F.element_at("lines", 2), "\t"), F.lit(2), F.greatest(F.size(F.split(F.element_at("lines", 2), "\t")) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    last = F.filter("lines", lambda x: F.trim(x) != "")
    molecules = rows.select(key, "n_atoms", props.alias("properties"), F.split(F.element_at(last, F.greatest(F.size(last) - 1, F.lit(1))), "\t")[0].alias("smiles"))
    at = rows.select(key, F.posexplode(F.slice("lines", 3, F.col("n_atoms"))).alias("atom", "line"))
    f = F.split(F.regexp_replace(F.trim("line"), r"\*\^", "e"), r"\s+")
    atoms = at.select(key, "atom", f[0].alias("symbol"), element_number(f[0]).alias("z"), *(F.try_element_at(f, F.lit(i)).try_cast("double").alias(c) for i, c in ((2, "x"), (3, "y"), (4, "zc"), (5, "q"))))
    return molecules, atoms


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))


def read_dump(texts: DataFrame, key: str = "name", text: str = "value") -> DataFrame:
    """Atoms of a trajectory dump: (key, timestep, row, id, mol, element, x, y, z), by sections carried forward over lines."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text)
    head = F.col("line").startswith("ITEM:")
    rows = rows.withColumn("section", F.last(F.when(head, F.col("line")), True).over(w)).withColumn("at", F.last(F.when(head, F.col("line_no")), True).over(w))
    rows = rows.withColumn("timestep", F.last(F.when(F.col("section").startswith("ITEM: TIMESTEP") & ~head, F.trim("line").try_cast("long")), True).over(w))
    f = F.split(F.trim("line"), r"\s+")
    atoms = rows.filter(F.col("section").startswith("ITEM: ATOMS") & ~head & (F.trim("line") != ""))
    return atoms.select(key, "timestep", (F.col("line_no") - F.col("at") - 1).alias("row"), f[0].try_cast("long").alias("id"), f[1].try_cast("long").alias("mol"), f[2].alias("element"), *(F.try_element_at(f, F.lit(i)).try_cast("double").alias(c) for i, c in ((4, "x"), (5, "y"), (6, "z"))))


def dump_boxes(texts: DataFrame, key: str = "name", text: str = "value") -> DataFrame:
    """(key, timestep, bounds): the numbers of each BOX BOUNDS section, row by row."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text)
    head = F.col("line").startswith("ITEM:")
    rows = rows.withColumn("section", F.last(F.when(head, F.col("line")), True).over(w))
    rows = rows.withColumn("timestep", F.last(F.when(F.col("section").startswith("ITEM: TIMESTEP") & ~head, F.trim("line").try_cast("long")), True).over(w))
    box = rows.filter(F.col("section").startswith("ITEM: BOX BOUNDS") & ~head)
    row = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    return box.groupBy(key, "timestep").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", row.alias("v")))), lambda s: s["v"]).alias("bounds"))


def read_thermo(texts: DataFrame, key: str = "name", text: str = "value") -> DataFrame:
    """Rows between ``Step`` and ``Loop`` lines: (key, block, step, values); a step that is given again replaces the former row."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text)
    begin, end = F.trim("line").startswith("Step"), F.trim("line").startswith("Loop")
    rows = rows.withColumn("inside", F.last(F.when(begin, True).when(end, False), True).over(w)).withColumn("block", F.count(F.when(begin, 1)).over(w))
    v = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))
    data = rows.filter(F.col("inside") & ~begin & ~end).select(key, "block", "line_no", v.alias("values")).filter(F.col("values")[0].isNotNull())
    data = data.withColumn("step", F.col("values")[0].cast("long"))
    nxt = F.lead("step").over(Window.partitionBy(key).orderBy("line_no"))
    return data.withColumn("_n", nxt).filter(F.col("_n").isNull() | (F.col("_n") != F.col("step"))).drop("_n", "line_no")


def read_frames(texts: DataFrame, key: str = "name", text: str = "value") -> DataFrame:
    """Frames of ``frame n`` headers and rows of values: the mean of each value over the rows of a frame."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = numbered_lines(texts, key, text).withColumn("f", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double"))).filter(F.col("f")[0].isNotNull())
    head = F.size("f") == 2
    rows = rows.withColumn("frame", F.last(F.when(head, F.col("f")[0].cast("long")), True).over(w)).filter(~head)
    return rows.groupBy(key, "frame").agg(*(F.avg(F.try_element_at("f", F.lit(i + 2))).alias(c) for i, c in enumerate(("temp", "kinetic", "internal"))))


def sample_lines(files: DataFrame, lines: int, seed: int, weight: str = "size", key: str = "path") -> DataFrame:
    """Files in a seeded order with chance in proportion to size (exponential keys); empty ones are left out."""
    u = hashed_uniform(F.lit(seed), F.col(key))
    return files.filter(F.col(weight) > 0).orderBy(-F.log(F.greatest(u, F.lit(1e-300))) / F.col(weight), key).limit(lines)


def seeded_files(files: DataFrame, most: int, seed: int = 1, key: str = "path") -> DataFrame:
    """The first files of a seeded order."""
    return files.orderBy(hashed_order(F.lit(seed), F.col(key)), key).limit(most)


def load_chunks(spark: SparkSession, pattern: str, rows_per_file: int | None = None, order: str | None = None, seed: int = 1) -> DataFrame:
    """All Parquet files of a pattern; unreadable ones are skipped. rows_per_file: so many of each, by a seeded hash of ``order``."""
    df = spark.read.option("ignoreCorruptFiles", "true").parquet(pattern)
    if rows_per_file is None:
        return df
    w = Window.partitionBy("_file").orderBy(hashed_order(F.lit(seed), F.col(order)), order)
    return df.withColumn("_file", F.input_file_name()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= rows_per_file).drop("_file", "_r")


def cif_text(crystals: DataFrame, key: str) -> DataFrame:
    """(key, value): a minimal CIF text of each crystal (lengths in Angstrom, angles from radians)."""
    deg = {a: F.degrees(F.col(a)) for a in ("alpha", "beta", "gamma")}
    text = F.format_string(
        "data_%s\n_cell_length_a %.6f\n_cell_length_b %.6f\n_cell_length_c %.6f\n_cell_angle_alpha %.6f\n_cell_angle_beta %.6f\n_cell_angle_gamma %.6f\n_space_group_IT_number %d\n",
        F.col(key).cast("string"), F.col("a"), F.col("b"), F.col("c"), deg["alpha"], deg["beta"], deg["gamma"], F.col("sg_ind"),
    )
    return crystals.select(key, text.alias("value"))


def read_cif(texts: DataFrame, key: str = "name", text: str = "value") -> DataFrame:
    """Cell lengths, angles (radians), group number and operator strings of CIF texts; what is missing is null."""
    def number(tag):
        return F.regexp_extract(F.col(text), rf"{tag}\s+'?([-+0-9.]+)", 1).try_cast("double")

    ops = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:\d+\s+)?'?([-+xyzXYZ0-9/. ]+,[-+xyzXYZ0-9/. ]+,[-+xyzXYZ0-9/. ]+)'?\s*$", 1)), lambda x: x.rlike("[xyzXYZ]"))
    return texts.select(
        key, *(number(f"_cell_length_{a}").alias(a) for a in "abc"), *(F.radians(number(f"_cell_angle_{a}")).alias(a) for a in ("alpha", "beta", "gamma")),
        number("(?:_space_group_IT_number|_symmetry_Int_Tables_number)").cast("int").alias("sg_ind"), ops.alias("operators"),
    )


def xyz_text(atoms: DataFrame, key: str, comment=None) -> DataFrame:
    """(key, value): XYZ text of each structure; atoms: (key, atom, symbol, x, y, z)."""
    line = F.format_string("%s %.6f %.6f %.6f", "symbol", "x", "y", "z")
    g = atoms.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("line")))).alias("rows"))
    return g.select(key, F.concat(F.size("rows").cast("string"), F.lit("\n"), comment if comment is not None else F.col(key).cast("string"), F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("value"))


def unseen(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet: where a job resumes."""
    return new.join(done.select(key).distinct(), key, "left_anti")
