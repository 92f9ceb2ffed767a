"""Files of sequences, ids, structures and alignments, read with Spark's own readers."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions.scalars import in_order

# Three-letter codes of the standard residues.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLU": "E", "GLN": "Q", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
# Fixed value: the pattern of accessions that UniProt publishes, anchored on both sides.
ACCESSION = "^(?:[OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def read_fasta(spark: SparkSession, path: str, max_seqs: int | None = None) -> DataFrame:
    """``(id, sequence)``. ``>`` at the start of a line begins a record; its first word is the id; letters are upper-cased."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    lines = F.split(F.regexp_replace(body, "\r", ""), "\n")
    seq = F.upper(F.array_join(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x)), ""))
    out = records.select(F.element_at(F.split(F.trim(F.element_at(lines, 1)), r"\s+"), 1).alias("id"), seq.alias("sequence"))
    return out if max_seqs is None else out.limit(max_seqs)


def read_protein_csv(spark: SparkSession, path: str, id_col: str = "id", seq_col: str = "sequence") -> DataFrame:
    """S3: ``(id, sequence)``; comma or tab, told from the file's beginning."""
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())[:4096]
    try:
        sep = csv.Sniffer().sniff(head, ",\t").delimiter
    except csv.Error:
        sep = "\t" if head.count("\t") > head.count(",") else ","
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    for c in (id_col, seq_col):
        if c not in df.columns:
            raise ValueError(f"no column {c}; there are {', '.join(df.columns)}")
    return df.select(F.col(id_col).alias("id"), F.upper(F.trim(seq_col)).alias("sequence"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``(uid, looks_valid)``: the first word of each line that is no comment."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    uid = F.element_at(F.split(line, r"\s+"), 1)
    return rows.select(uid.alias("uid"), uid.rlike(ACCESSION).alias("looks_valid"))


def read_pdb(spark: SparkSession, path: str, chain: str | None = None, pattern: str = "*.pdb") -> DataFrame:
    """A row for each file: id, sequence of alpha carbons, mean B-factor, fractions above 90 and below 50 (null without atoms)."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(F.input_file_name().alias("file"), F.col("value"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    code = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    atom = F.substring("value", 1, 4) == "ATOM"
    b = F.trim(F.substring("value", 61, 6)).try_cast("double")
    is_ca = atom & (F.trim(F.substring("value", 13, 4)) == "CA") & F.col("residue").isNotNull()
    if chain is not None:
        is_ca = is_ca & (F.substring("value", 22, 1) == chain)
    marked = lines.withColumn("residue", F.try_element_at(code, F.trim(F.substring("value", 18, 3))))
    head = F.when(F.col("value").startswith("HEADER"), F.nullif(F.trim(F.substring("value", 63, 4)), F.lit("")))
    g = marked.groupBy("file").agg(
        F.first(head, ignorenulls=True).alias("head"),
        F.array_sort(F.collect_list(F.when(is_ca, F.struct("at", "residue")))).alias("r"),
        F.avg(F.when(is_ca, b)).alias("mean_bfactor"), F.avg(F.when(is_ca, (b > 90).cast("double"))).alias("frac_high"), F.avg(F.when(is_ca, (b < 50).cast("double"))).alias("frac_low"),
    )
    seq = F.array_join(F.transform("r", lambda x: x["residue"]), "")
    return g.select("file", F.coalesce("head", stem).alias("id"), seq.alias("sequence"), F.size("r").alias("length"), "mean_bfactor", "frac_high", "frac_low").orderBy("file")


def parse_alignment(spark: SparkSession, path: str, k: int = 20, score: str = "bitscore", as_distance: bool = True, monotone: bool = False) -> tuple[DataFrame, DataFrame]:
    """A kNN graph ``(i, rank, j, d)`` and ids ``(id, name)`` from BLAST tabular output.

    Ids are numbered in order of first appearance in the file, the query's before the subject's. Distances are 1 / (1 + score), or -log10(e-value + 1e-300), in which better hits are farther; ``monotone`` turns the latter round as 1 / (1 + that).
    """
    place = {"pident": 2, "evalue": 10, "bitscore": 11}
    if score not in place:
        raise ValueError(f"score is one of {sorted(place)}")
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 12))
    hits = rows.select("file", "block", "row", F.trim(f[0]).alias("q"), F.trim(f[1]).alias("s"), F.trim(f[place[score]]).try_cast("double").alias("x"))
    return graph_of_hits(hits, ["file", "block", "row"], k, score, as_distance, monotone)


def graph_of_hits(hits: DataFrame, order: list[str], k: int = 20, score: str = "bitscore", as_distance: bool = True, monotone: bool = False) -> tuple[DataFrame, DataFrame]:
    """S7 of hits ``(q, s, x)`` with a score, whose lines come in the order of the columns ``order``. Hits of a sequence on itself, and without a score, are left out."""
    hits = hits.where("x IS NOT NULL AND q <> s").select(F.struct(*order).alias("at"), "q", "s", "x")
    best = hits.groupBy("q", "s").agg((F.min if score == "evalue" else F.max)("x").alias("x"))
    ends = hits.select("at", F.posexplode(F.array("q", "s")).alias("side", "name"))
    names = ends.groupBy("name").agg(F.min(F.struct("at", "side")).alias("first"))
    ids = in_order(names.select("name", "first.at.*", "first.side"), [*order, "side"], "id").select("id", "name")
    if not as_distance:
        d = F.col("x")
    elif score == "evalue":
        d = -F.log10(F.col("x") + 1e-300)
        d = 1 / (1 + F.greatest(d, F.lit(0.0))) if monotone else d
    else:
        d = 1 / (1 + F.col("x"))
    better = F.asc("x") if score == "evalue" else F.desc("x")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(better, "s"))).where(F.col("rank") <= k)
    a, b = (ids.select(F.col("id").alias(i), F.col("name").alias(n)) for i, n in (("i", "q"), ("j", "s")))
    return ranked.join(a, "q").join(b, "s").select("i", "rank", "j", d.alias("d")), ids


def fetch(ids: DataFrame, transport, schema: str, chunk: int = 50) -> DataFrame:
    """Annotations of ids from a service; ids of which it has none, or whose chunk failed, get nulls.

    transport: called with a list of ids, returns a dict by id of dicts by column; it runs on executors, a chunk at a time, and may raise.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            asked = batch["uid"].drop_duplicates().tolist()
            rows = []
            for at in range(0, len(asked), chunk):
                part = asked[at : at + chunk]
                try:
                    found = transport(part)
                except Exception:  # noqa: BLE001  a failed chunk leaves nulls
                    found = {}
                rows += [[u, *[found.get(u, {}).get(n) for n in names]] for u in part]
            yield pd.DataFrame(rows, columns=["uid", *names])

    unique = ids.select(F.col(ids.columns[0]).alias("uid")).where("uid IS NOT NULL").distinct()
    got = unique.mapInPandas(run, f"uid string, {schema}")
    return ids.select(F.col(ids.columns[0]).alias("uid")).join(got, "uid", "left")


def uniprot_transport(fields: list[str], url: str = "https://rest.uniprot.org/uniprotkb/accessions", timeout: float = 30.0):
    """A transport for ``fetch`` that asks UniProt for tab-separated fields."""

    def ask(uids: list[str]) -> dict[str, dict[str, str]]:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        query = urlencode({"accessions": ",".join(uids), "fields": ",".join(["accession", *fields]), "format": "tsv"})
        with urlopen(f"{url}?{query}", timeout=timeout) as reply:  # noqa: S310
            lines = reply.read().decode().splitlines()
        return {row[0]: dict(zip(fields, row[1:], strict=False)) for row in (line.split("\t") for line in lines[1:])}

    return ask


def alphafold_transport(url: str = "https://alphafold.ebi.ac.uk/api/prediction", timeout: float = 30.0):
    """A transport for ``fetch`` that asks AlphaFold DB for one accession after another."""

    def ask(uids: list[str]) -> dict[str, dict[str, float]]:
        import json
        from urllib.request import urlopen

        out = {}
        for uid in uids:
            try:
                with urlopen(f"{url}/{uid}", timeout=timeout) as reply:  # noqa: S310
                    entry = json.load(reply)[0]
            except (OSError, ValueError, IndexError):
                continue
            low, high = entry.get("fractionPlddtVeryLow"), entry.get("fractionPlddtVeryHigh")
            out[uid] = {"length": float(len(entry.get("uniprotSequence", ""))), "plddt": entry.get("globalMetricValue"), "frac_disordered": low, "frac_confident": high}
        return out

    return ask
