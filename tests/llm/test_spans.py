"""Spans in long texts: against Python's own, in time that follows the number of matches."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from canopy.llm import pii, secrets, spans


def test_running_parts_and_cuts_against_slices(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab é😀\n") for _ in range(3 * spans.PART + 7))
    places = [(0, 0), (0, 5), (spans.PART - 3, spans.PART + 3), (spans.PART, 2 * spans.PART), (10, len(text)), (len(text) - 2, len(text) + 9), (5, 3 * spans.PART + 1)]
    places += [tuple(sorted((rng.randrange(len(text)), rng.randrange(len(text))))) for _ in range(30)]
    for t in (text, "short é text", ""):
        df = spark.createDataFrame([(t, places)], "t string, p array<struct<a:long,b:long>>")
        got = df.select(spans.let(spans.parts(F.col("t")), lambda of: F.transform("p", lambda p: spans.cut(of, p["a"], p["b"])))).first()[0]
        assert got == [t[a:b] for a, b in places]
    for n in (1, 2, 3, 8, 9, 100):
        values = [rng.randrange(-5, 50) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<long>")
        total, most = df.select(spans.running(F.col("v"), lambda a, b: a + b, F.lit(0).cast("long")), spans.running(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(-9).cast("long"))).first()
        assert total == [sum(values[: i + 1]) for i in range(n)] and most == [max(values[: i + 1]) for i in range(n)]


def test_merged_spans_against_a_loop(spark):
    rng = random.Random(6)
    for n in (0, 1, 2, 40):
        own = [(a, rng.randrange(3), a + rng.randrange(1, 9), rng.choice("xyz")) for a in (rng.randrange(80) for _ in range(n))]
        want = []
        for a, o, b, k in sorted(own):
            if want and want[-1][2] > a:
                want[-1][2] = max(want[-1][2], b)
            else:
                want.append([a, o, b, k])
        got = spark.createDataFrame([(own,)], f"s {spans.CODED}").select(pii.merged(F.col("s"))).first()[0]
        assert [list(x) for x in got] == want


def hex_runs(mb):
    rng = random.Random(1)
    return " ".join(rng.randbytes(8).hex() for _ in range(int(mb * (1 << 20)) // 17))


@pytest.mark.parametrize("work", ["secrets", "pii", "redact"])
def test_time_follows_the_number_of_matches(spark, work):

    def took(mb):
        if work == "secrets":
            t = hex_runs(mb) + " user=abc password: hunter2secret99"
        else:
            t = " ".join(f"mail a{i}@example.org, call +1 555 010 {i % 10000:04d}" for i in range(int(mb * (1 << 20)) // 48))
        df = spark.createDataFrame([(1, t)], "doc_id long, text string")
        at = time.time()
        if work == "secrets":
            r = secrets.scan(df).first()
            assert r["n_hex"] == len(re.findall("[0-9a-f]{16,}", t)) and r["n_assign"] == 1 and "user:" in r["spans"]
        elif work == "pii":
            r = pii.detect(df).first()
            assert r["n_email"] == len(re.findall(r"@example", t)) == r["n_phone"]
        else:
            r = pii.redact(df).first()
            assert r["text"].count("[EMAIL]") == len(re.findall("@example", t)) and not re.search(r"@example|\+1 555", r["text"])
        return time.time() - at

    took(0.01)
    small, large = took(0.25), took(1)
    print(work, small, large)
    assert large < max(6 * small, 20), (small, large)
