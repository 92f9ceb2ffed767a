"""Secrets, and multipart credentials linked by interval joins, by DataFrame functions only.

Strong findings (assigned secrets, access keys, long hex runs) are reported as they are. Weak parts — user names or key ids, short or unlabelled secrets, endpoints — are reported only where complementary parts stand in one scope: a weak identifier with a secret, a weak secret with an identifier or endpoint, an endpoint with a secret. The scope of a part is the interval from ``REACH`` code points before it to ``REACH`` after it, so two parts are in one scope if at most that many code points lie between them, however long they are. The interval join goes by document and bucket of ``REACH`` code points: a weak part stands in all buckets of its scope, the other in all buckets of its own interval, and a bucket holds parts of a few hundred code points only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.spans import CODED, coded, listed, with_spans

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex")
USER = r"(?i)(?<![a-z])(?<!secret_)(?:user(?:_?name)?|login|account(?:_?name)?|client_?id|access_?key(?:_?id)?)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9._@-]{3,}+"
# '=' may stand before a blob, but not as the padding of another. Each class is looked for in the whole run, from its start only.
BLOB = r"(?<![A-Za-z0-9+/])(?<![A-Za-z0-9+/]{20}==)(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{20,}+={0,2}"
ENDPOINT = r"(?i)(?<![a-z])(?:https?|s3|jdbc:[a-z]{2,}+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftps?|ssh)://[^\s\"'<>]{4,}+"
#: Roles of parts: 0 identifier, 1 secret, 2 endpoint. (kind, role, strong)
PARTS = {"access": (0, True), "user": (0, False), "assign": (1, True), "short": (1, False), "blob": (1, False), "endpoint": (2, False)}
WEAK = ("user", "short", "blob", "endpoint")
REACH, NO_ROLE = 300, 9


def base_spans(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    kinds = {
        "matched": (ASSIGN, t.rlike("[:=]")),
        "access": (ACCESS, t.contains("AKIA")),
        "hex": (HEX, t.rlike("[0-9a-f]{16}")),
        "user": (USER, t.rlike("[:=]")),
        "blob": (BLOB, t.rlike("[A-Za-z0-9+/]{20}")),
        "endpoint": (ENDPOINT, t.contains("://")),
    }
    df = with_spans(df, text, kinds, {"access": lambda v: F.length(v) >= 18})

    def value(s):
        return F.length(F.regexp_extract(s["value"], ASSIGN, 2))

    return df.withColumns({"assign": F.filter("matched", lambda s: value(s) >= 12), "short": F.filter("matched", lambda s: value(s).between(4, 11))}).drop("matched")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """``(_uid, added)``: weak parts that have complementary parts near, outside strong spans."""

    def part(kind: str):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(PARTS[kind][0]).alias("role")))

    roles = F.concat(*[part(k) for k in PARTS])
    # Hex runs are nobody's complement, but no weak part may stand in one
    hexes = F.transform("hex", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("hex").alias("kind"), F.lit(NO_ROLE).alias("role")))
    parts = durable(found.where(F.size(roles) > 1).select("_uid", F.explode(F.concat(roles, hexes)).alias("p")).select("_uid", "p.*"))
    weak = parts.where(F.col("kind").isin(*WEAK)).select("_uid", "kind", "role", "start", "end", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))).alias("bucket"))
    other = parts.select("_uid", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("bucket"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), F.col("kind").isin(*KINDS).alias("strong"))
    near = weak.join(other, ["_uid", "bucket"]).where((F.col("o_start") <= F.col("end") + reach) & (F.col("o_end") >= F.col("start") - reach))
    complementary = F.when(F.col("role") == 1, F.col("o_role").isin(0, 2)).otherwise(F.col("o_role") == 1)
    inside = F.col("strong") & (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))
    kept = near.groupBy("_uid", "kind", "start", "end").agg(F.max(complementary).alias("linked"), F.max(inside).alias("inside")).where("linked AND NOT inside")
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(WEAK) for x in (k, len(KINDS) + i)]), F.col("kind"))
    return kept.groupBy("_uid").agg(F.collect_list(F.struct("start", order.alias("order"), "end", "kind")).cast(CODED).alias("added"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans)`` of each document.

    Base kinds are found leftmost and without overlap, each by itself; assigned values of under 12 characters, access keys of under 18 and hex runs of under 16 are no findings. Null and empty texts have none; long texts and long values are searched whole. Spans that begin together go by kind; repeated rows are searched each, since a number of its own tells each row apart; an empty table gives no rows; other columns don't matter.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = base_spans(rows, "_text").drop("_text")
    base = F.concat(*[coded(F.col(k), k, i) for i, k in enumerate(KINDS)])
    found = durable(found.withColumn("base", F.array_sort(base)).withColumn("_uid", F.monotonically_increasing_id()))
    out = found.join(linked(found), "_uid", "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast(CODED)))
    return out.select(
        F.col("_id").alias(id_col), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(spans).alias("spans"),
    )
