"""How filters of a corpus act on each other in every order, from the lattice of filter sets.

What a filter meets depends on the set of filters applied before it and not on their order. So documents count towards the 80 edges (set already applied, next filter) of the lattice of five filters; an order of filters is a path of five edges from the empty set to the full one, and the 600 steps of all 120 orders take their figures from the aggregated edges by a join. Documents that fail the same filters count alike, so they are added up before edges are made of them: a part of the corpus sends 128 rows at most from each task, whatever its size.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable

#: Filters in order of their bits; E needs the whole table.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def bits(w: Column) -> Column:
        n = F.size(w)
        failed = [n < 50, 100 * F.size(F.array_distinct(w)) < 65 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))

    # An array of one, so that the words are split once
    return F.transform(F.array(words), bits)[0]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(id, part, fails)``: bits of the filters that each document fails, whatever else was applied.

    E: a document of smaller id has the same text. Texts are told apart by SHA-256; null texts are empty ones. Rows of the least id of a text pass, all of them; rows without an id are neither copies nor originals.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = durable(docs.select(F.col(f"`{id_col}`").alias("id"), part.alias("part"), own_failures(text).alias("own"), F.unhex(F.sha2(text, 256)).alias("digest")))
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"))
    # Joined by text and id, which no two originals share: a text of many copies is no hot key
    originals = first.withColumn("original", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("original").isNull(), 1 << 4).otherwise(0)
    return rows.join(originals, ["digest", "id"], "left").select("id", "part", (F.col("own") + copy).alias("fails"))


def edges(profiles: DataFrame) -> DataFrame:
    """``(part, applied, next, kept, ...)`` for all 80 edges of each part, from ``(part, fails, good, toxic, n)``."""
    full = (1 << len(FILTERS)) - 1
    edge = [F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s in range(full + 1) for f in range(len(FILTERS)) if not s >> f & 1]
    each = profiles.select("*", F.explode(F.array(*edge)).alias("e")).select("part", "fails", "good", "toxic", "n", "e.*")
    failing = F.expr("fails & shiftleft(1, next)") != 0
    here = F.expr("fails & applied") == 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    removed = here & failing
    return each.groupBy("part", "applied", "next").agg(
        total(here & ~failing).alias("kept"), total(removed).alias("removed"), total(~here & failing).alias("redundant"), total(F.expr("fails = shiftleft(1, next)")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )


def paths() -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, applied, next)`` of every step of every order."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, applied = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            out.append((name, step, applied, f))
            applied |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``: every step of every order in each part of the corpus.

    Null parts are the part ''. A document is good or toxic if any of its labels (``doc_id``, ``quality``, ``toxic``) says 1; documents without labels are neither. Repeated rows count each; long texts are read whole; ties don't arise, since steps are numbered; an empty table has no parts and gives no rows; other columns don't matter. shapley: what the step's filter removes, added up over all orders.
    """
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    marked = failures(docs, id_col, text_col, part_col).join(told, "id", "left")
    no = F.lit(False)
    profiles = marked.groupBy("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    found = durable(edges(profiles))
    # Orders in which a set comes before a filter and the rest after it
    before = F.bit_count("applied")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), before + 1)
    value = found.groupBy("part", "next").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    steps = found.sparkSession.createDataFrame(paths(), "filter_order string, step int, applied int, next int")
    return found.join(F.broadcast(steps), ["applied", "next"]).join(value, ["part", "next"]).select("part", "filter_order", "step", *MEASURES, "shapley")
