"""Operators as stages over a table of documents: each returns the table's columns, less or with other texts.

All of them take any columns beside the text, whatever their names, and return an empty table for an empty one. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import decontam, pii, resemblance, toxicity
from canopy.llm.durable import durable


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, at: str) -> DataFrame:
    """``docs`` with a number ``at`` for each row, written down so that it stays."""
    return durable(docs.withColumn(at, F.monotonically_increasing_id()))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier, fitted on these and their labels, doesn't predict to be toxic.

    Null, empty and wordless texts are scored as no words. A score of just ``toxicity.AT`` is toxic. Repeated rows get one score and stay or go together. Without labels nothing goes.
    """
    model = toxicity.fit(docs, labels)
    score = unused(docs, "score")
    return toxicity.score(docs, model, keep=score).where(F.col(score) < toxicity.AT).drop(score)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One document of each component of texts whose SimHash fingerprints (three-word shingles, 64 bits) differ in two bits at most or whose five-word shingles are alike by 0.8 or more: the one of least id; of rows with that id, the one stored first.

    Null, empty and wordless texts are alike, so one of them stays. Null ids count as smallest. Of repeated rows one stays.
    """
    at = unused(docs, "row")
    rows = numbered(docs, at)
    gone = resemblance.copies(rows.select(F.col(at).alias("at"), F.col(id_col).alias("id"), "text")).withColumnRenamed("at", at)
    return rows.join(gone, at, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: training data must hold no passage of a test, of one item or more.

    Null, empty and wordless texts stay. Repeated rows stay or go together. An empty benchmark leaves all.
    """
    at = unused(docs, "row")
    rows = numbered(docs, at)
    found = decontam.decontaminate(rows, benchmark, min_items=min_items, id_col=at)
    return rows.join(found.where("contaminated").select(at), at, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by their kinds; ``n_chars`` follows.

    Null and empty texts stay as they are. Spans that overlap are replaced as one, under the kind of the first; of those that begin together, in order of kinds. Repeated rows are changed alike.
    """
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out
