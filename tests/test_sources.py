import math

import numpy as np
import pytest

from canopy.functions import proteins
from canopy.operators import cells, chemistry, facets
from canopy.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fasta", ">sp|P12345|PROT1 Some protein\nACDE\nfghi\n\n>P99999\nKLMN\n")
    assert sorted(map(tuple, readers.read_fasta(spark, p).collect())) == [("P99999", "KLMN"), ("sp|P12345|PROT1", "ACDEFGHI")]
    assert readers.read_fasta(spark, p, 1).count() == 1


def test_csv(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "id\tsequence\tother\nP12345\tacde\tx\n")
    assert [tuple(r) for r in readers.read_protein_csv(spark, p).collect()] == [("P12345", "ACDE")]
    with pytest.raises(ValueError):
        readers.read_protein_csv(spark, p, seq_col="nothing")


def test_ids(spark, tmp_path):
    p = put(tmp_path / "ids.txt", "# head\n\nP12345 a note\nnot_an_id\n")
    assert [tuple(r) for r in readers.read_id_list(spark, p).collect()] == [("P12345", True), ("not_an_id", False)]


def atom(n, name, res, chain, b):
    return f"ATOM  {n:5d}  {name:<3s} {res} {chain}{n:4d}    {0:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:6.2f}"


def test_pdb(spark, tmp_path):
    head = "HEADER    PROTEIN".ljust(62) + "1TST"
    put(tmp_path / "x.pdb", "\n".join([head, atom(1, "N", "ALA", "A", 10), atom(2, "CA", "ALA", "A", 85), atom(3, "CA", "GLY", "A", 92), atom(4, "CA", "VAL", "B", 40)]))
    put(tmp_path / "y.pdb", "REMARK nothing")
    a, b = readers.read_pdb(spark, str(tmp_path)).collect()
    assert (a["id"], a["sequence"], a["length"]) == ("1TST", "AGV", 3)
    assert a["mean_bfactor"] == pytest.approx(72.33, abs=0.01) and a["frac_high"] == a["frac_low"] == pytest.approx(1 / 3)
    assert (b["id"], b["sequence"], b["mean_bfactor"]) == ("y", "", None)
    assert readers.read_pdb(spark, str(tmp_path), "B").first()["sequence"] == "V"


def test_alignment(spark, tmp_path):
    line = lambda q, s, bits: "\t".join([q, s, "90", *["1"] * 7, "1e-5", str(bits)])
    p = put(tmp_path / "a.m8", "\n".join(["# c", line("A", "A", 999), line("A", "B", 100), line("A", "B", 200), line("A", "C", 50), line("B", "A", 200), line("B", "C", "bad"), "short\tline"]))
    graph, ids = readers.parse_alignment(spark, p, 5)
    names = {r["id"]: r["name"] for r in ids.collect()}
    got = sorted((names[r["i"]], r["rank"], names[r["j"]], r["d"]) for r in graph.collect())
    assert got == [("A", 1, "B", 1 / 201), ("A", 2, "C", 1 / 51), ("B", 1, "A", 1 / 201)]
    d = readers.parse_alignment(spark, p, 5, "evalue")[0].first()["d"]
    assert d == pytest.approx(5)
    assert readers.parse_alignment(spark, p, 5, "evalue", monotone=True)[0].first()["d"] == pytest.approx(1 / 6)


def test_fetch(spark):
    def transport(uids):
        if "BAD" in uids:
            raise OSError
        return {u: {"length": 413.0} for u in uids if u == "P12345"}

    ids = spark.createDataFrame([("P12345",), ("Q00000",), ("BAD",)], "uid string")
    assert dict(map(tuple, readers.fetch(ids, transport, "length double", 1).collect())) == {"P12345": 413.0, "Q00000": None, "BAD": None}


def charge(seq, ph):
    out = 1 / (1 + 10 ** (ph - proteins.N_TERMINUS)) - 1 / (1 + 10 ** (proteins.C_TERMINUS - ph))
    out += sum(seq.count(r) / (1 + 10 ** (ph - k)) for r, k in proteins.BASIC.items())
    return out - sum(seq.count(r) / (1 + 10 ** (k - ph)) for r, k in proteins.ACIDIC.items())


def test_sequence_properties(spark):
    seqs = ["FVNQHLCGSHLVEALYLVCGERGFFYTPKT", "", "ACX", "kkkk"]
    rows = proteins.sequence_properties(spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, seq string")).orderBy("id").collect()
    s, r = seqs[0], rows[0]
    lo, hi = 0.0, 14.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if charge(s, mid) > 0 else (lo, mid)
    assert r["isoelectric_point"] == pytest.approx((lo + hi) / 2)
    assert r["molecular_weight"] == pytest.approx(sum(proteins.MASS[c] for c in s) + proteins.WATER)
    assert r["charge_at_ph7"] == pytest.approx(charge(s, 7.0))
    assert rows[1]["length"] is None and rows[2]["gravy"] is None and rows[3]["gravy"] == -3.9
    with pytest.raises(ValueError):
        proteins.sequence_properties(spark.createDataFrame([("A",)], "seq string"), properties=("shape",))


def test_cells(spark):
    genes = spark.createDataFrame([("GeneA", True), ("GeneB", False), ("GeneC", True)], "gene string, highly_variable boolean")
    x = spark.createDataFrame([("c0", "GeneA", "X", 1.0), ("c0", "GeneC", "X", 3.0), ("c2", "GeneA", "X", 4.0), ("c2", "GeneC", "X", 7.0), ("c1", "GeneB", "X", 2.0)], "cell string, gene string, layer string, value double")
    who = spark.createDataFrame([("c0",), ("c1",), ("c2",)], "cell string")
    with pytest.warns(UserWarning):
        got = cells.marker_scores(x, who, genes, ["GeneA", "GeneC", "GeneX"])
    assert dict(map(tuple, got.collect())) == {"c0": 2.0, "c1": 0.0, "c2": 5.5}
    with pytest.raises(ValueError):
        cells.marker_scores(x, who, genes, ["GeneX"])
    v = {r["id"]: r["v"] for r in cells.features(x, genes, n_top_genes=2).collect()}
    assert v == {"c0": [1.0, 3.0], "c1": [0.0, 0.0], "c2": [4.0, 7.0]}


def test_filters(spark):
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate([("a", 1.0), ("a", 2.0), ("b", math.nan), ("c", math.inf), (None, 0.5)])], "id long, c string, v double")
    assert {r["id"] for r in facets.in_categories(df, "c", ["b", facets.OTHER], top=1).collect()} == {2, 3, 4}
    assert {r["id"] for r in facets.in_range(df, "v", 0.5, 2).collect()} == {0, 1, 4}
    assert sum(r["n"] for r in facets.histogram(df, "v").collect()) == 3
    assert facets.search(df, "c", " A ").count() == 2


def test_sample_has_its_quotas(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(100)], "id long, g string")
    one = sorted(map(tuple, facets.stratified_sample(df, "id", "g", 20).collect()))
    two = sorted(map(tuple, facets.stratified_sample(df.repartition(3), "id", "g", 20).collect()))
    assert one == two and len(one) == 20


def test_chemistry_is_optional():
    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="rdkit"):
            chemistry.toolkit()
    assert np.isfinite(len(chemistry.MOLECULE))
