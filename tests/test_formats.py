"""Formats against plain readings of the same files, for every cut of them."""

import gzip

import numpy as np
import pytest
from pyspark.sql import types as T

from canopy.sources import formats, readers


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    rng = np.random.default_rng(5)
    rows, text = [], "stray line\n"
    for n in range(60):
        seq = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), int(rng.integers(0, 200))))
        rows.append((f"s{n}", seq))
        text += f">s{n} made {n}\r\n" + "".join(seq[i : i + 30].lower() + "\n" for i in range(0, len(seq), 30)) + ("\n" if n % 7 == 0 else "")
    text = text.rstrip("\n")
    folder = tmp_path_factory.mktemp("fasta")
    (folder / "a.fasta").write_bytes(text.encode())
    (folder / "_skipped").write_text(">no\nAAA\n")
    return folder, rows, text


@pytest.mark.parametrize("cut", [1, 7, 64, 1000, 1 << 20])
def test_every_record_once_whatever_the_cut(fasta, cut):
    folder, rows, text = fasta
    reader = formats._Fasta({"path": str(folder), "splitBytes": str(cut)}, T.StructType([T.StructField(n, T.StringType()) for n in ("id", "sequence", "at")]))
    parts = reader.partitions()
    got = [r for p in parts for r in reader.read(p)]
    assert [(i, s) for i, s, _ in got] == rows
    assert all(text.encode()[at:].startswith(f">{i} ".encode()) for i, _, at in got)
    assert len(parts) == max(1, -(-len(text.encode()) // cut))


def test_fasta_through_spark(spark, fasta):
    folder, rows, text = fasta
    formats.register(spark)

    def read():
        return spark.read.format("fasta").option("splitBytes", 500)

    df = read().load(str(folder))
    assert df.rdd.getNumPartitions() == -(-len(text.encode()) // 500)
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    some = read().schema("id string, length long").load(str(folder)).where("id LIKE 's1%' AND length > 90 AND length % 2 = 0")
    assert sorted(map(tuple, some.collect())) == sorted((i, len(s)) for i, s in rows if i.startswith("s1") and len(s) > 90 and len(s) % 2 == 0)
    plan = some._jdf.queryExecution().executedPlan().toString()
    above = plan.split("BatchScan")[0]
    assert " % 2" in above and "StartsWith" not in above and " > 90" not in above
    either = read().load(str(folder)).where("id = 's3' OR sequence = ''")
    assert {r[0] for r in either.collect()} == {i for i, s in rows if i == "s3" or s == ""}
    with pytest.raises(Exception, match="no column"):
        read().schema("id string, weight double").load(str(folder)).collect()
    with pytest.raises(Exception, match="no files"):
        read().option("pathGlobFilter", "*.none").load(str(folder)).collect()


def test_gzip_and_empty_files(spark, fasta, tmp_path):
    _, rows, text = fasta
    (tmp_path / "b.fasta.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.fasta").write_text("")
    formats.register(spark)
    df = spark.read.format("fasta").option("splitBytes", 100).load(f"{tmp_path}/*.fasta*")
    assert sorted(map(tuple, df.collect())) == sorted(rows)


def test_alignments_in_the_order_of_lines(spark, tmp_path):
    rng = np.random.default_rng(6)
    lines = ["# a comment", "short\tline"]
    for _ in range(300):
        a, b = rng.integers(0, 25, 2)
        lines.append("\t".join([f"p{a}", f"p{b}", "99.5", *["0"] * 7, f"1e-{rng.integers(1, 90)}", "bad" if rng.random() < 0.05 else str(rng.integers(20, 300))]))
    path = tmp_path / "hits.tsv"
    path.write_text("\n".join(lines) + "\n")
    formats.register(spark)
    hits = spark.read.format("blast").option("splitBytes", 700).load(str(path))
    numbers = hits.select("query", "bitscore").where("bitscore >= 100 AND query IN ('p1', 'p2', 'p3')")
    fields = [x.split("\t") for x in lines[2:]]
    assert sorted(map(tuple, numbers.collect())) == sorted((f[0], float(f[11])) for f in fields if f[0] in ("p1", "p2", "p3") and f[11] != "bad" and float(f[11]) >= 100)
    assert hits.where("bitscore IS NULL").count() == sum(f[11] == "bad" for f in fields)
    for score in ("bitscore", "evalue"):
        made = readers.graph_of_hits(hits.selectExpr("file", "at", "query q", "subject s", f"{score} x"), ["file", "at"], 4, score)
        plain = readers.parse_alignment(spark, str(path), 4, score)
        assert [sorted(map(tuple, d.collect())) for d in made] == [sorted(map(tuple, d.collect())) for d in plain]
    order = list(dict.fromkeys(n for f in fields if f[11] != "bad" and f[0] != f[1] for n in f[:2]))
    got = readers.graph_of_hits(hits.selectExpr("file", "at", "query q", "subject s", "bitscore x"), ["file", "at"])[1].orderBy("id").collect()
    assert [r["name"] for r in got] == order


def test_structures(spark, tmp_path):
    def atom(n, residue, chain, b, name="CA"):
        return f"ATOM  {n:5d}  {name:<3} {residue} {chain}{n:4d}    {0:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{b:>6}"

    (tmp_path / "x.pdb").write_text("\n".join([f"HEADER{'':56}1ABC", atom(1, "ALA", "A", "95.00"), atom(1, "ALA", "A", "10.00", "CB"), atom(2, "XYZ", "A", "95.00"), atom(3, "TRP", "B", "30.00"), atom(4, "GLY", "A", "none")]))
    (tmp_path / "y.v1.pdb").write_text("REMARK nothing\n")
    formats.register(spark)
    for chain in (None, "A"):
        read = spark.read.format("pdb").option("pathGlobFilter", "*.pdb")
        got = (read if chain is None else read.option("chain", chain)).load(str(tmp_path)).drop("file")
        plain = readers.read_pdb(spark, str(tmp_path), chain).drop("file")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    ids = spark.read.format("pdb").schema("id string, file string").load(str(tmp_path))
    assert ids.where("id = '1ABC'").count() == 1 and ids.where(f"file = '{tmp_path}/y.v1.pdb'").collect()[0]["id"] == "y.v1"
