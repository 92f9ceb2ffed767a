"""Properties of amino acid sequences as expressions on residue counts (P1-P13), and k-mers (Q11)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Average residue masses, and that of water.
MASS = {
    "A": 71.03711, "R": 156.10111, "N": 114.04293, "D": 115.02694, "C": 103.00919, "E": 129.04259, "Q": 128.05858,
    "G": 57.02146, "H": 137.05891, "I": 113.08406, "L": 113.08406, "K": 128.09496, "M": 131.04049, "F": 147.06841,
    "P": 97.05276, "S": 87.03203, "T": 101.04768, "W": 186.07931, "Y": 163.06333, "V": 99.06841,
}
WATER = 18.01056
# The Kyte-Doolittle scale of hydropathy.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "E": -3.5, "Q": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
# pKa of the ends and of side chains that take or give a proton.
N_TERMINUS, C_TERMINUS = 9.69, 2.34
ACIDIC = {"D": 3.65, "E": 4.25, "C": 8.18, "Y": 10.07}
BASIC = {"H": 6.00, "K": 10.54, "R": 12.48}
# Groups of residues.
GROUPS = {"aromaticity": "FWY", "frac_charged": "DEKR", "frac_hydrophobic": "AVILMFW", "frac_polar": "STNQYC", "frac_acidic": "DE", "frac_basic": "KRH"}
PROPERTIES = ("length", "molecular_weight", "isoelectric_point", "gravy", "charge_at_ph7", "aromaticity", "aliphatic_index", "frac_charged", "frac_hydrophobic", "frac_polar", "frac_acidic", "frac_basic", "n_cysteines")


def is_valid(seq: Column) -> Column:
    return seq.rlike(f"^[{''.join(sorted(MASS))}]+$")


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def sequence_properties(df: DataFrame, seq_col: str = "seq", properties: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with a double for each property, null for sequences that are empty or have other letters than the 20 residues'.

    The isoelectric point halves [0, 14] a hundred times on the net charge.
    """
    names = PROPERTIES if properties is None else properties
    if unknown := set(names) - set(PROPERTIES):
        raise ValueError(f"unknown properties: {sorted(unknown)}")
    df_columns = df.columns
    df = df.withColumn("_u", F.upper(F.col(seq_col)))
    seq = F.col("_u")
    n = F.length(seq).cast("double")
    counts = F.struct(*[(F.length(seq) - F.length(F.replace(seq, F.lit(r), F.lit("")))).cast("double").alias(r) for r in MASS])
    out = df.withColumn("_n", F.when(is_valid(seq), counts))
    c = {r: F.col(f"_n.{r}") for r in MASS}

    def charge(ph: Column) -> Column:
        positive = [1 / (1 + F.pow(F.lit(10.0), ph - N_TERMINUS)), *[c[r] / (1 + F.pow(F.lit(10.0), ph - k)) for r, k in BASIC.items()]]
        negative = [1 / (1 + F.pow(F.lit(10.0), C_TERMINUS - ph)), *[c[r] / (1 + F.pow(F.lit(10.0), k - ph)) for r, k in ACIDIC.items()]]
        return _total(positive) - _total(negative)

    def halve(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) / 2
        up = charge(mid) > 0
        return F.struct(F.when(up, mid).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid).alias("hi"))

    made = {
        "length": n,
        "molecular_weight": _total([c[r] * m for r, m in MASS.items()]) + WATER,
        "isoelectric_point": F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi")), halve, lambda a: (a["lo"] + a["hi"]) / 2),
        "gravy": _total([c[r] * h for r, h in HYDROPATHY.items()]) / n,
        "charge_at_ph7": charge(F.lit(7.0)),
        "aliphatic_index": 100 * (c["A"] + 2.9 * c["V"] + 3.9 * (c["I"] + c["L"])) / n,
        "n_cysteines": c["C"],
        **{g: _total([c[r] for r in letters]) / n for g, letters in GROUPS.items()},
    }
    return out.select(*df_columns, *[F.when(F.col("_n").isNotNull(), made[p]).alias(p) for p in names])


def kmers(df: DataFrame, id_col: str = "id", seq_col: str = "seq", k: int = 3) -> DataFrame:
    """Q11: ``(id, kmer, n, frequency)`` of overlapping k-mers, sparse."""
    starts = F.sequence(F.lit(1), F.length(seq_col) - k + 1)
    each = df.where(F.length(seq_col) >= k).select(F.col(id_col).alias("id"), F.explode(F.transform(starts, lambda i: F.substring(F.col(seq_col), i, F.lit(k)))).alias("kmer"), (F.length(seq_col) - k + 1).alias("total"))
    return each.groupBy("id", "kmer").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("t")).select("id", "kmer", "n", (F.col("n") / F.col("t")).alias("frequency"))
