"""Spans of regular expressions in texts, by DataFrame functions only. Places are in code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,value:string>"


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after the matches."""
    return F.split(text, pattern, -1)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is referred to."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], neutral: Column) -> Column:
    """``op`` over all elements up to each, by doubling: n log n steps, where appending to an array takes n for each element."""

    def prefixes(v: Column) -> Column:
        n = F.size(v)
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int") - 1)

        def further(acc: Column, k: Column) -> Column:
            step = F.call_function("shiftleft", F.lit(1), k)
            return F.zip_with(acc, F.concat(F.array_repeat(neutral, F.least(step, n)), F.slice(acc, F.lit(1), F.greatest(n - step, F.lit(0)))), op)

        return F.aggregate(rounds, v, further)

    return let(values, prefixes)


def placed(between: Column, matches: Column) -> Column:
    """``array<struct<start,end,value>>`` from the results of ``gaps`` and ``found``, which must be columns already."""
    size = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = running(size, lambda a, b: a + b, F.lit(0).cast("long"))
    return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))).cast(f"array<{SPAN}>")


#: Code points of a part of a text, of which a cut reads no more than it needs and one part.
PART = 512


def parts(text: Column) -> Column:
    """A text in parts of ``PART`` code points, from which ``cut`` takes slices in time that doesn't grow with the text."""
    return F.when(F.length(text) <= PART, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))


def cut(of: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` (from 0) to before ``end`` of a text in ``parts``; what lies beyond it is left out."""
    first = F.floor(start / PART).cast("int")
    n = F.greatest(F.floor((F.greatest(end, start + 1) - 1) / PART).cast("int") - first + 1, F.lit(1))
    return F.substring(F.array_join(F.slice(of, first + 1, n), ""), (start % PART).cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def coded(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place among kinds, ready for sorting."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


CODED = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then order of kinds, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(df, text: str, kinds: dict[str, tuple[str, Column]], keep):
    """Add a column of spans for each kind: name -> (pattern, condition under which a text can have matches).

    keep: name -> predicate on a match's text, where there is one. Three projections, so that no pattern is run twice.
    """
    names = list(kinds)
    df = df.withColumns({f"_m_{k}": F.when(can, found(F.col(text), p)) for k, (p, can) in kinds.items()})
    df = df.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, gaps(F.col(text), kinds[k][0])) for k in names})
    empty = F.array().cast(f"array<{SPAN}>")
    df = df.withColumns({f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, placed(F.col(f"_g_{k}"), F.col(f"_m_{k}"))).otherwise(empty) for k in names})

    def kept(k: str) -> Column:
        return F.filter(f"_s_{k}", lambda s: keep[k](s["value"])) if k in keep else F.col(f"_s_{k}")

    df = df.withColumns({k: kept(k) for k in names})
    return df.drop(*[f"_{x}_{k}" for x in "mgs" for k in names])
