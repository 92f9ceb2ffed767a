"""Personal data: patterns for known kinds, and bootstrapped contextual extraction, by DataFrame functions only.

The known kinds are seeds. Lexical patterns are the labels that stand before values (``label:``, ``label =``, ``label #``), and the one to three words before or after seeds and other identifiers. A table of (pattern, value) pairs with counts over all documents is a bipartite graph; in each round a pattern's score is the share of its occurrences whose values are trusted, its support the number of different trusted values, and values behind patterns of enough of both are trusted in the next round, so that they lend support to patterns of their own. Values that look like identifiers and stand behind patterns of high score are reported as kind ``context``, though they are of no known kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.spans import CODED, coded, cut, let, listed, parts, running, with_spans

# Each pattern matches what the plain one beside it matches, without backtracking over long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"[0-9](?:[\x20-]?[0-9])++"  # [0-9]([\x20-]?[0-9])+
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: ``label`` and ``:``, ``=`` or ``#``, then a value.
CONTEXT = r"(?<![A-Za-z])[A-Za-z][A-Za-z_.-]++\x20?[:=#]\x20?[\"'(]?[A-Za-z0-9+@][^\s\"'<>,;]*+"
LABEL = r"^([A-Za-z][A-Za-z_.-]*\x20?[:=#])"
#: Punctuation that isn't part of a value.
ENDING = r"[.)!?:]+$"
VALUE_AT = r"^[A-Za-z][A-Za-z_.-]*\x20?[:=#]\x20?[\"'(]?"
#: What looks like an identifier: a run with four digits or more, or a handle, ``@`` and three characters or more.
IDENTIFIER = r"(?<![^\s\"'(<>,;:=#])(?:@[A-Za-z0-9_.]{3,}+|[A-Za-z0-9+](?=(?:[^\s\"'<>,;0-9]*+[0-9]){3})[^\s\"'<>,;]*+)"
#: A word of prose beside a value, and how many code points are looked at on either side.
WORD, BESIDE = r"\p{L}[\p{L}'-]*+[:,.]?", 120
#: Code points of a bucket in which values meet seeds.
BUCKET = 256
#: Different trusted values that a pattern needs, its least score, and rounds.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.8, 3
#: Bytes of patterns that go to every executor.
SENT_BYTES = 32 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def identifying(value: Column) -> Column:
    """Whether a value can be one that contexts find: four digits or more, or a handle."""
    return (F.length(_digits(value)) >= 4) | value.rlike(r"^@[A-Za-z0-9_.]{3}")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def is_ip(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Columns ``email``, ``ip``, ``card`` and ``phone`` of spans, ``context`` of labelled values and ``other`` of what looks like an identifier."""
    t = F.col(text)
    kinds = {
        "email": (EMAIL, t.contains("@")),
        "ip": (IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        "card": (CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
        "phone": (PHONE, t.contains("+")),
        "context": (CONTEXT, t.rlike("[:=#]")),
        "other": (IDENTIFIER, t.rlike("[0-9@]")),
    }
    keep = {"ip": is_ip, "card": is_card, "phone": lambda v: F.length(_digits(v)).between(10, 15), "other": identifying}
    return with_spans(df, text, kinds, keep)


def in_prose(spans: Column, text: Column) -> Column:
    """Spans with ``patterns``: the last one to three words before each and the first after it, lower-cased. text: in ``parts``, a column already or bound by ``let``."""

    def patterns(s: Column) -> Column:
        before = F.regexp_replace(F.lower(cut(text, F.greatest(s["start"] - BESIDE, F.lit(0)), s["start"])), r"\s+", " ")
        after = F.regexp_replace(F.lower(cut(text, s["end"], s["end"] + BESIDE)), r"\s+", " ")

        def of(t: Column) -> Column:
            out = []
            for n in (1, 2, 3):
                words = rf"{WORD}(?:\x20{WORD}){{{n - 1}}}"
                out.append(F.concat(F.lit("< "), F.regexp_extract(t["before"], rf"(?<!\S)({words})\x20[\"'(]?$", 1)))
                out.append(F.concat(F.lit("> "), F.regexp_extract(t["after"], rf"^[\"').,;:!?]*\x20({words})(?!\S)", 1)))
            return F.filter(F.array(*out), lambda p: F.length(p) > 2)

        return let(F.struct(before.alias("before"), after.alias("after")), of)

    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), patterns(s).alias("patterns")))


def occurrences(spans: DataFrame) -> DataFrame:
    """``(_uid, label, value, start, end, seed)``: values by the patterns beside them.

    A labelled value that overlaps a seed stands for the first one of the first kind; other identifiers that do are left out, since the seed has its own words. Values meet seeds by document and bucket of ``BUCKET`` code points.
    """
    seeds = spans.select("_uid", F.posexplode("seeds").alias("at", "c")).select("_uid", "at", "c.*")

    def buckets(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(F.floor(start / BUCKET), F.floor((F.greatest(end, start + 1) - 1) / BUCKET))).alias("bucket")

    def overlapping(values: DataFrame) -> DataFrame:
        """``(_uid, start, end, _seed)`` of values ``(_uid, start, end)`` that overlap seeds."""
        left = values.select("_uid", "start", "end").distinct().select("*", buckets(F.col("start"), F.col("end")))
        right = seeds.select("_uid", buckets(F.col("start"), F.col("end")), "at", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("value").alias("seed"))
        met = left.join(right, ["_uid", "bucket"]).where("s_start < end AND s_end > start")
        return met.groupBy("_uid", "start", "end").agg(F.min(F.struct("at", "seed"))["seed"].alias("_seed"))

    each = spans.select("_uid", F.explode("context").alias("c"))
    lead = F.length(F.regexp_extract("c.value", VALUE_AT, 0))
    value = F.regexp_replace(F.regexp_replace("c.value", VALUE_AT, ""), ENDING, "")
    each = each.select("_uid", F.lower(F.regexp_replace(F.regexp_extract("c.value", LABEL, 1), r"\x20", "")).alias("label"), value.alias("value"), (F.col("c.start") + lead).alias("start"))
    each = durable(each.withColumn("end", F.col("start") + F.length("value")).where("end > start"))
    labelled = each.join(overlapping(each), ["_uid", "start", "end"], "left").select("_uid", "label", F.coalesce("_seed", "value").alias("value"), "start", "end", F.col("_seed").isNotNull().alias("seed"))
    known = seeds.select("_uid", F.explode("patterns").alias("label"), "value", "start", "end", F.lit(True).alias("seed"))
    other = spans.select("_uid", F.explode("other").alias("c"))
    other = other.select("_uid", F.col("c.patterns").alias("patterns"), F.regexp_replace("c.value", ENDING, "").alias("value"), F.col("c.start").alias("start"))
    other = durable(other.withColumn("end", F.col("start") + F.length("value")))
    free = other.join(overlapping(other), ["_uid", "start", "end"], "left_anti")
    return labelled.unionByName(known).unionByName(free.select("_uid", F.explode("patterns").alias("label"), "value", "start", "end", F.lit(False).alias("seed")))


def standing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(label, total)``: how often the words of ``patterns (label)`` stand in ``texts (text)``, beside whatever."""
    words = texts.select(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))

    def joined(n: int) -> Column:
        out = F.col("w")
        for k in range(1, n):
            out = F.zip_with(out, F.slice("w", F.lit(k + 1), F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(out, lambda g: g.isNotNull())

    sought = patterns.select("label", F.substring("label", 3, 1 << 20).alias("words"))
    asked = durable(sought.select("words").distinct())
    grams = words.select(F.explode(F.concat(*[joined(n) for n in (1, 2, 3)])).alias("words"))
    size = asked.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    # Few enough go to all executors, so that only what is sought is moved; else all words are counted first
    met = grams.join(F.broadcast(asked), "words") if size <= SENT_BYTES else grams
    return sought.join(met.groupBy("words").agg(F.count(F.lit(1)).alias("total")), "words").select("label", "total")


def discovered(spans: DataFrame, texts: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``(_uid, added)``: spans of identifiers found by context in each document that has some.

    spans: ``_uid``, ``seeds`` (spans of known kinds) and ``other`` (identifiers), both with ``patterns``, and ``context`` (labelled values). Counts are over all documents; pairs are aggregated before they are moved, so that a pattern that stands everywhere is no hot key. texts: ``text`` of all documents.
    """
    each = durable(occurrences(spans))
    edges = each.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("seed").cast("int")).alias("seed")).withColumn("like", identifying(F.col("value")))
    # Patterns beside fewer values than they need, were all trusted, can't count in any round; the others keep all their pairs.
    able = edges.groupBy("label").agg(F.sum((F.col("like") | (F.col("seed") == 1)).cast("int")).alias("most")).where(F.col("most") >= support).select("label")
    # Words of prose stand before other words too, as labels do before words: their score is a share of all places
    prose = durable(able.where(F.col("label").rlike("^[<>] ")))
    edges = durable(edges.join(able, "label").join(standing(texts, prose), "label", "left"))
    most = edges.groupBy("label").agg((F.sum("n") >= confidence * F.coalesce(F.max("total"), F.lit(0))).alias("may")).where("may").select("label")
    edges = durable(edges.join(most, "label"))
    scored = edges.withColumn("s", F.col("seed").cast("double"))

    def patterns(scored: DataFrame) -> DataFrame:
        sure = F.sum((F.col("s") >= confidence).cast("int"))
        of = scored.groupBy("label").agg((F.sum(F.col("n") * F.col("s")) / F.greatest(F.sum("n"), F.max("total"))).alias("p"), sure.alias("support"))
        return of.where((F.col("p") >= confidence) & (F.col("support") >= support)).select("label", "p")

    for _ in range(rounds):
        trusted = edges.join(patterns(scored), "label").where("like").groupBy("value").agg(F.max("p").alias("p"))
        scored = durable(edges.join(trusted, "value", "left").withColumn("s", F.when(F.col("seed") == 1, 1.0).when(F.col("like") & F.col("p").isNotNull(), F.col("p")).otherwise(0.0)).drop("p"))
    sure = scored.where((F.col("s") >= confidence) & F.col("like")).join(patterns(scored), "label").select("label", "value")
    new = each.where(~F.col("seed")).join(sure, ["label", "value"]).select("_uid", "start", "end").distinct()
    span = F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("context").alias("kind"))
    return new.groupBy("_uid").agg(F.array_sort(F.collect_list(span)).alias("added"))


def personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all, if None) and ``_found``: ``struct<base, spans, n_email, n_ip, n_card, n_phone>``.

    base, spans: coded spans of the known kinds, and of these and those found by context. Null and empty texts have none. Repeated rows stay and are searched each; an empty table gives no rows; columns keep their names, whatever they are.
    """
    columns = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    found = base_spans(rows, "_text")
    base = F.concat(*[coded(F.col(k), k, i) for i, k in enumerate(KINDS)])
    found = found.select("_row", F.array_sort(base).alias("base"), let(F.when(F.size("other") + sum(F.size(k) for k in KINDS) > 0, parts(F.col("_text"))), lambda t: F.struct(in_prose(F.concat(*KINDS), t).alias("seeds"), in_prose(F.col("other"), t).alias("other"))).alias("_prose"), "context", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]).select("*", "_prose.*").drop("_prose")
    found = durable(found.withColumn("_uid", F.monotonically_increasing_id()))
    extra = discovered(found.select("_uid", "seeds", "context", "other"), rows.select(F.col("_text").alias("text")))
    out = found.join(extra, "_uid", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(CODED)))))
    return out.select("_row.*", F.struct("base", "spans", *[f"n_{k}" for k in KINDS]).alias("_found"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of each document.

    Null and empty texts have no spans; long texts and long values are searched whole. Spans that begin together go by kind; of a kind none overlap. Repeated rows are searched each; an empty table gives no rows; other columns don't matter.
    """
    found = personal_data(docs, text_col, [id_col])
    return found.select(id_col, *[f"_found.n_{k}" for k in KINDS], F.sha2(listed(F.col("_found.base")), 256).alias("base_sha256"), listed(F.col("_found.spans")).alias("spans"))


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined; the first one names the kind."""

    def joined(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))  # the furthest end so far
        reach = F.concat(F.array(F.lit(0).cast("long")), far)
        # A span that begins where all before it have ended opens a stretch, which goes as far as they do before the next one opens
        opened = F.filter(F.zip_with(s, F.slice(reach, F.lit(1), F.size(s)), lambda x, before: F.struct(x.alias("s"), before.alias("before"))), lambda z: z["s"]["start"] >= z["before"])
        closed = F.concat(F.transform(F.slice(opened, F.lit(2), F.size(opened)), lambda z: z["before"]), F.array(F.element_at(far, -1)))
        return F.zip_with(opened, closed, lambda z, end: F.struct(z["s"]["start"].alias("start"), z["s"]["order"].alias("order"), end.alias("end"), z["s"]["kind"].alias("kind")))

    return F.when(F.size(spans) > 0, let(F.array_sort(spans), joined)).otherwise(F.array()).cast(CODED)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``[EMAIL]`` and the like; null texts stay null. Rows without personal data are unchanged."""
    found = personal_data(docs, text_col).withColumn("_cut", merged(F.col("_found.spans")))
    text, spans = F.col(f"`{text_col}`"), F.col("_cut")
    zero = F.lit(0).cast("long")

    def replaced(t: Column) -> Column:
        before = F.concat(F.array(zero), F.transform(spans, lambda s: s["end"]))
        head = F.zip_with(spans, F.slice(before, F.lit(1), F.size(spans)), lambda s, b: F.concat(cut(t, b, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(head, ""), cut(t, F.element_at(before, -1), F.length(text).cast("long")))

    out = F.when(F.size(spans) > 0, let(parts(text), replaced)).otherwise(text)
    return found.select(*[(out.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
