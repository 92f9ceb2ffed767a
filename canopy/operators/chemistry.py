"""Optional: fingerprints and properties of molecules and reactions. Needs a chemistry toolkit on the executors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of properties, and widths of fingerprints.
MOLECULE = ("mw", "logp", "n_rings", "hba", "hbd", "tpsa", "n_rotatable_bonds", "n_heavy_atoms", "fraction_csp3", "n_aromatic_rings", "n_heteroatoms", "formal_charge", "qed")
REACTION = ("delta_mw", "delta_heavy_atoms", "delta_rings", "delta_aromatic_rings", "atom_economy", "delta_logp")
WIDTHS = {"morgan": 2048, "mqn": 42, "mxfp": 217, "drfp": 2048, "map4": 1024, "mhfp": 2048}


def toolkit():
    try:
        from rdkit import Chem
        from rdkit.Chem import AllChem, Crippen, Descriptors, Lipinski, rdMolDescriptors
        from rdkit.Chem.QED import qed
        from rdkit.Chem.Scaffolds import MurckoScaffold
    except ImportError as e:
        raise ImportError("chemistry functions need rdkit, which isn't installed") from e
    return Chem, AllChem, Crippen, Descriptors, Lipinski, rdMolDescriptors, qed, MurckoScaffold


def _on_bits(smiles: str, kind: str, radius: int, n_bits: int) -> list[int] | None:
    chem, all_chem, _, _, _, rd, _, _ = toolkit()
    if kind == "drfp":
        from drfp import DrfpEncoder

        return np.flatnonzero(DrfpEncoder.encode([smiles], n_folded_length=n_bits)[0]).tolist()
    if kind == "mhfp":
        from mhfp.encoder import MHFPEncoder

        mol = chem.MolFromSmiles(smiles)
        return None if mol is None else np.flatnonzero(MHFPEncoder.secfp_from_mol(mol, length=n_bits)).tolist()
    mol = chem.MolFromSmiles(smiles)
    if mol is None:
        return None
    if kind == "morgan":
        return list(all_chem.GetMorganFingerprintAsBitVect(mol, radius, nBits=n_bits).GetOnBits())
    if kind == "mqn":
        return list(rd.MQNs_(mol))
    if kind == "map4":
        from map4 import MAP4Calculator

        return np.flatnonzero(MAP4Calculator(dimensions=n_bits, is_folded=True).calculate(mol)).tolist()
    from mxfp import mxfp

    return [int(x) for x in mxfp.MXFPCalculator().mxfp_from_mol(mol)]


def fingerprints(df: DataFrame, id_col: str, smiles_col: str, kind: str = "morgan", radius: int = 2, n_bits: int | None = None) -> DataFrame:
    """``(id, on)``, set bits of binary kinds, the values themselves of mqn and mxfp. Invalid molecules are left out."""
    if kind not in WIDTHS:
        raise ValueError(f"kind is one of {sorted(WIDTHS)}")
    width = n_bits or WIDTHS[kind]

    def run(batches):
        for batch in batches:
            made = [(i, _on_bits(s, kind, radius, width) if isinstance(s, str) else None) for i, s in zip(batch["id"], batch["s"], strict=True)]
            yield pd.DataFrame([m for m in made if m[1] is not None], columns=["id", "on"])

    kind_of_id = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(smiles_col).alias("s")).mapInPandas(run, f"id {kind_of_id}, on array<long>")


def _molecule(smiles: str) -> dict[str, float] | None:
    chem, _, crippen, desc, lip, rd, qed, _ = toolkit()
    mol = chem.MolFromSmiles(smiles) if isinstance(smiles, str) else None
    if mol is None:
        return None
    rings = mol.GetNumBonds() - mol.GetNumAtoms() + len(chem.GetMolFrags(mol))
    values = (
        desc.MolWt(mol), crippen.MolLogP(mol), rings, lip.NumHAcceptors(mol), lip.NumHDonors(mol), rd.CalcTPSA(mol), lip.NumRotatableBonds(mol), mol.GetNumHeavyAtoms(),
        rd.CalcFractionCSP3(mol), rd.CalcNumAromaticRings(mol), rd.CalcNumHeteroatoms(mol), chem.GetFormalCharge(mol), qed(mol),
    )
    return dict(zip(MOLECULE, map(float, values), strict=True))


def molecular_properties(df: DataFrame, smiles_col: str, properties: tuple[str, ...] = MOLECULE) -> DataFrame:
    """``df`` with a struct ``properties``; null for invalid molecules, whose rows stay."""
    if unknown := set(properties) - set(MOLECULE):
        raise ValueError(f"unknown properties: {sorted(unknown)}")

    @F.pandas_udf(", ".join(f"{p} double" for p in properties))
    def made(s: pd.Series) -> pd.DataFrame:
        rows = [_molecule(x) or {} for x in s]
        return pd.DataFrame([[r.get(p) for p in properties] for r in rows], columns=list(properties))

    return df.withColumn("properties", made(F.col(smiles_col)))


def reaction_properties(df: DataFrame, reaction_col: str, properties: tuple[str, ...] = REACTION) -> DataFrame:
    """C4: differences between products and reactants, the last and the first part between ``>``."""

    def of(reaction: str) -> dict[str, float]:
        parts = reaction.split(">") if isinstance(reaction, str) else []
        sides = [[_molecule(m) for m in p.split(".") if m] for p in (parts[0], parts[-1])] if len(parts) > 1 else []
        if not sides or not all(sides) or any(m is None for s in sides for m in s):
            return {}
        total = [{k: sum(m[k] for m in s) for k in ("mw", "n_heavy_atoms", "n_rings", "n_aromatic_rings", "logp")} for s in sides]
        a, b = total
        return {
            "delta_mw": b["mw"] - a["mw"], "delta_heavy_atoms": b["n_heavy_atoms"] - a["n_heavy_atoms"], "delta_rings": b["n_rings"] - a["n_rings"],
            "delta_aromatic_rings": b["n_aromatic_rings"] - a["n_aromatic_rings"], "atom_economy": b["mw"] / a["mw"] if a["mw"] else np.nan, "delta_logp": b["logp"] - a["logp"],
        }

    @F.pandas_udf(", ".join(f"{p} double" for p in properties))
    def made(s: pd.Series) -> pd.DataFrame:
        rows = [of(x) for x in s]
        return pd.DataFrame([[r.get(p) for p in properties] for r in rows], columns=list(properties))

    return df.withColumn("properties", made(F.col(reaction_col)))


def murcko_scaffolds(df: DataFrame, smiles_col: str) -> DataFrame:
    """``df`` with ``scaffold``, empty for invalid molecules."""

    @F.pandas_udf("string")
    def made(s: pd.Series) -> pd.Series:
        chem, *_, murcko = toolkit()
        out = []
        for x in s:
            mol = chem.MolFromSmiles(x) if isinstance(x, str) else None
            out.append("" if mol is None else chem.MolToSmiles(murcko.GetScaffoldForMol(mol)))
        return pd.Series(out)

    return df.withColumn("scaffold", made(F.col(smiles_col)))
