"""Distances and contacts of residues from atoms (chain, serial, name, resname, resseq, x, y, z)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names of the 20 standard residues.
RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")


def representatives(atoms: DataFrame, chain: str | None = "A", keys=()) -> DataFrame:
    """(*keys, residue, x, y, z): of each standard residue the beta carbon, the alpha carbon where there is none."""
    atoms = atoms.where(F.col("resname").isin(*RESIDUES) & F.col("name").isin("CA", "CB"))
    if chain is not None:
        atoms = atoms.where(F.col("chain") == chain)
    best = F.max_by(F.struct("x", "y", "z"), F.struct((F.col("name") == "CB") & (F.col("resname") != "GLY"), -F.col("serial")))
    return atoms.groupBy(*keys, "resseq").agg(best.alias("at")).select(*keys, F.col("resseq").alias("residue"), "at.x", "at.y", "at.z")


def distances(points: DataFrame, keys=()) -> DataFrame:
    """(*keys, i, j, d) for i < j, from (*keys, residue, x, y, z): the residues of each structure, some hundreds."""
    b = points.select(*keys, F.col("residue").alias("j"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))
    a = points.withColumnRenamed("residue", "i")
    both = (a.join(b, list(keys)) if keys else a.crossJoin(b)).where(F.col("i") < F.col("j"))
    d = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2 + (F.col("z") - F.col("w")) ** 2)
    return both.select(*keys, "i", "j", d.alias("d"))


def distances_of_chains(atoms: DataFrame, offset: int, chains=("A", "B"), keys=()) -> DataFrame:
    """Both chains as one, the second one's numbers raised by ``offset``."""
    a, b = representatives(atoms, chains[0], keys), representatives(atoms, chains[1], keys)
    return distances(a.union(b.withColumn("residue", F.col("residue") + offset)), keys)


def contacts(dist: DataFrame, cutoff: float = 8.0, apart: int = 0) -> DataFrame:
    """Pairs nearer than ``cutoff`` and more than ``apart`` residues apart, both strictly, nearest first."""
    return dist.where((F.col("d") < cutoff) & (F.col("j") - F.col("i") > apart)).orderBy("d", "i", "j")
