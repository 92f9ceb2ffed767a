"""Quality rules as a short-circuit cascade, by DataFrame functions only.

Each rule's cost and share of rejections are estimated on a sample; rules are then asked in the order of rejections per cost, and a document that one rejects is asked no further: what the later rules measure isn't measured of it. The order changes the time taken and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows on which costs and rejections are estimated, about as many as this, and bytes of their texts at most.
SAMPLE, SAMPLE_BYTES = 400, 4 << 20
#: Times that each of them is measured in a job, and jobs of which the fastest counts.
COPIES, REPEATS = 4, 3


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " " + BLANKS, "")).cast("long")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    lines = worded_lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeats(df: DataFrame, text: Column, name: str = "n_repeat_words") -> DataFrame:
    """Add the number of words in ``WINDOW``-word windows that occur twice or more in the text.

    Windows are told apart by XXH64 of their words' XXH64. Texts with a repeated window are sorted by window; all others stop after a set test.
    """
    df = df.withColumn("_h", F.transform(words(text), lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(1), F.size("_h") - WINDOW + 1)
    df = df.withColumn("_w", F.when(F.size("_h") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_o", F.when(some, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.transform("_o", lambda s, k: F.when(s["h"].eqNullSafe(F.get("_o", k - 1)["h"]) | s["h"].eqNullSafe(F.get("_o", k + 1)["h"]), s["i"])), lambda i: i.isNotNull()
    )
    df = df.withColumn("_t", F.sort_array(twice))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    count = F.aggregate("_t", zero, lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n")), lambda a: a["n"])
    return df.withColumn(name, F.coalesce(count, F.lit(0)).cast("long")).drop("_o", "_w", "_t", "_h")


def n_lines(text: Column) -> Column:
    return F.size(worded_lines(text)).cast("long")


def n_lettered(text: Column) -> Column:
    """Words with a letter."""
    return F.size(F.filter(words(text), lambda w: w.rlike(r"\p{L}"))).cast("long")


def n_bulleted(text: Column) -> Column:
    """Lines that begin like an item of a list."""
    return F.size(F.filter(worded_lines(text), lambda line: line.rlike(r"^[\x20\t]*[*•‣-]\x20"))).cast("long")


def n_cut_off(text: Column) -> Column:
    """Lines that end in an ellipsis."""
    return F.size(F.filter(worded_lines(text), lambda line: line.rlike(r"(?:\.\.\.|…)[\x20\t\r]*$"))).cast("long")


def top_word(text: Column) -> Column:
    """Times that the commonest word stands in the text."""
    zero = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def add(acc: Column, w: Column) -> Column:
        n = F.when(acc["w"] == w, acc["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    return F.aggregate(F.array_sort(words(text)), zero, add, lambda acc: acc["most"]).cast("long")


MEASURES: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": n_lines, "n_lettered": n_lettered, "n_bulleted": n_bulleted,
    "n_cut_off": n_cut_off, "top_word": top_word,
}
#: Measures that the query returns; they are taken of every document.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule:
    """A name, the measures that it needs, and whether a document with these measures is rejected."""

    def __init__(self, name: str, rejects: Callable[[dict[str, Column]], Column], *needs: str) -> None:
        self.name, self.rejects, self.needs = name, rejects, needs


RULES: dict[str, Rule] = {
    r.name: r
    for r in (
        Rule("short", lambda m: m["n_words"] < 20, "n_words"),
        Rule("repeats", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"], "n_words", "n_repeat_words"),
        Rule("symbols", lambda m: 4 * m["n_symbols"] > m["n_words"], "n_words", "n_symbols"),
        Rule("word_length", lambda m: ~m["word_chars"].between(2 * m["n_words"], 25 * m["n_words"]), "n_words", "word_chars"),
        Rule("same_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"], "n_dup_lines", "n_lines"),
        Rule("no_letters", lambda m: 2 * m["n_lettered"] < m["n_words"], "n_words", "n_lettered"),
        Rule("bullets", lambda m: 10 * m["n_bulleted"] > 9 * m["n_lines"], "n_bulleted", "n_lines"),
        Rule("cut_off", lambda m: 10 * m["n_cut_off"] > 3 * m["n_lines"], "n_cut_off", "n_lines"),
        Rule("one_word", lambda m: (m["n_words"] >= 20) & (10 * m["top_word"] > 3 * m["n_words"]), "n_words", "top_word"),
    )
}
#: These decide ``base_failed``.
BASE_RULES = ("short", "repeats")


def asked(rule: Rule, text: Column, have: dict[str, Column]) -> Column:
    """Whether ``rule`` rejects, with measures that aren't there yet taken in its own expression, so that they are taken only where it is asked."""
    return rule.rejects({n: have[n] if n in have else MEASURES[n](text) for n in rule.needs})


def sampled(docs: DataFrame, text_col: str, sample: int) -> DataFrame:
    """Texts of about ``sample`` rows of ``docs``, taken by a hash of their place in all of it, each ``COPIES`` times; the driver holds ``SAMPLE_BYTES`` at most."""
    every = max(1, docs.count() // sample)
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"), F.xxhash64(F.monotonically_increasing_id()).alias("_h"))
    taken, size = [], 0
    for (text, _) in rows.where(F.pmod("_h", F.lit(every)) == 0).limit(2 * sample).collect() if sample else []:
        size += len(text)
        if size > SAMPLE_BYTES:
            break
        taken.append((text,))
    return docs.sparkSession.createDataFrame(taken, "_text string").select("_text", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))


def order_of_rules(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, rules: Iterable[str] = RULES) -> list[str]:
    """Rules by rejections per second on a sample of bounded size, the highest first, ties by name.

    A rule's cost is the fastest of ``REPEATS`` jobs that ask it of every row of the sample, less that of a job that asks nothing.
    """
    rows = sampled(docs, text_col, sample)

    def timed(rejects: Column, df: DataFrame) -> tuple[float, float]:
        job, best, found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(rejects.cast("int")).alias("out")), float("inf"), None
        for _ in range(REPEATS):
            began = time.perf_counter()
            found = job.first()
            best = min(best, time.perf_counter() - began)
        return best, ((found["out"] or 0) + 0.5) / (found["n"] + 1)

    nothing, _ = timed(F.length("_text") < 0, rows)
    gain = {}
    for name in rules:
        df = with_repeats(rows, F.col("_text")) if "n_repeat_words" in RULES[name].needs else rows
        cost, share = timed(asked(RULES[name], F.col("_text"), {"n_repeat_words": F.col("n_repeat_words")} if df is not rows else {}), df)
        gain[name] = share / max(cost - nothing, 1e-4)
    return sorted(gain, key=lambda n: (-gain[n], n))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)`` of each document.

    base_failed: too few words, or too many of them in repeated windows; ``kept`` is the verdict of all rules. The measures returned are taken of every document, those of the other rules only of documents that neither the base nor a rule before rejects. Null, empty and blank texts have no words and fail; long texts are measured whole. Repeated rows are judged each, and no measure depends on another row; an empty table gives no rows; other columns don't matter. No shuffle.
    """
    order = order_of_rules(docs, text_col, rules=[n for n in RULES if n not in BASE_RULES])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    text = F.col("_text")
    rows = with_repeats(rows.withColumns({n: MEASURES[n](text) for n in BASE if n in MEASURES}), text)
    have = {n: F.col(n) for n in BASE}
    failed = F.lit(False)
    for name in BASE_RULES:
        failed = failed | asked(RULES[name], text, have)
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False))
    for name in order:
        kept = kept.when(asked(RULES[name], text, have), F.lit(False))
    return rows.select(F.col("_id").alias(id_col), *BASE, "base_failed", kept.otherwise(F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, filtered rule by rule in the cascade's order, so that later measures are taken of survivors only.

    Null, empty and blank texts go; long texts are measured whole; repeated rows stay or go together; an empty table stays empty; columns keep their names, whatever they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    text = F.col("_text")
    for name in order_of_rules(docs, text_col):
        if "n_repeat_words" in RULES[name].needs:
            rows = with_repeats(rows, text).where(~asked(RULES[name], text, {"n_repeat_words": F.col("n_repeat_words")})).select("_row", "_text")
        else:
            rows = rows.where(~asked(RULES[name], text, {}))
    return rows.select("_row.*")
