"""Encoding, manifests and filter audits against libraries and plain walks on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, Tree string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def corpus(n=700):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 12)))
    texts = [None, "", " \n\t ", "a", "CAPS AND MORE", "it's 12345 'll we've", "日本語 のテキスト 😀🏽" * 9, "x" * 5000, "ab" * 3000 + " " + "=" * 300, "long " * 4000, "<|endoftext|> x"]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 90))) + rng.choice(["", "#", " Up"]) for _ in range(n - len(texts) - 60)]
    texts += [rng.choice(texts) for _ in range(60)]
    langs = ["en"] * 20 + ["de", "fr", "", None, "日本", "EN"]
    rows = [(i * 3, t, rng.choice(langs), rng.choice(["web", "web", "books", None, ""]), rng.choice([None, len(t or "")]), 1, "t") for i, t in enumerate(texts)]
    rows += [(None, "no id", "en", "web", 5, 1, "t"), (None, "no id", "en", "web", 5, 1, "t"), rows[40], rows[40]]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(spec):
    import public_tokenizers
    import tiktoken

    from canopy.llm.bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(spec), special_tokens={})


def test_encode_is_the_librarys_and_decodes_to_the_text(spark, docs, rows, spec, reference):
    from canopy.llm.bpe import decode, encode

    out = decode(encode(docs, spec), spec).collect()
    want = sorted((r[0] if r[0] is not None else -1, tuple(reference.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"])) for r in out)
    assert got == want
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    assert encode(docs.limit(0), spec).count() == 0


def test_pieces_of_any_length_are_merged_as_by_the_library(spec, reference):
    from canopy.llm.bpe import BATCHED, Encoder, read_ranks

    own, rng = Encoder(read_ranks(spec)), random.Random(3)
    alphabets = (b"abcdeinst er", b"aab", b"=-", bytes(range(256)))
    pieces = [bytes(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 2, 3, 7, 20, BATCHED, BATCHED + 1, 300]))) for _ in range(3000)]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(pieces)]
    assert got == [list(reference._encode_single_piece(p)) for p in pieces]
    assert own.encode(pieces[:50]) == own.encode(pieces[:50])
    assert own.queue.bits.first() == -1 and not own.queue.later and not own.queue.cursor
    for p in pieces[:200]:  # one by one and together are the same
        assert own.merge_long(p).tolist() == own.merge_many([p])[0].tolist()


def test_rank_bits_and_queue_against_a_sorted_list():
    from canopy.llm.bpe import RankBits, RankQueue

    rng, bits, have = random.Random(1), RankBits(50256), set()
    for _ in range(3000):
        r = rng.randrange(50256)
        if rng.random() < 0.5:
            bits.set(r)
            have.add(r)
        elif have:
            r = rng.choice(sorted(have)[:5])
            bits.clear(r)
            have.discard(r)
        assert bits.first() == min(have, default=-1)
    queue, all_of = RankQueue(1000), []
    rank, at = np.array([rng.randrange(1000) for _ in range(500)]), np.arange(500)
    queue.fill(rank, at)
    all_of = sorted(zip(rank.tolist(), at.tolist(), strict=True))
    for p in range(500, 800):
        r = rng.randrange(1000)
        queue.push(r, p)
        all_of = sorted([*all_of, (r, p)])
        assert (queue.bits.first(), queue.pop(queue.bits.first())) == all_of.pop(0)
    assert len(all_of) == 500


def test_unknown_ids_and_cut_ids_are_errors(spark, spec):
    from canopy.llm.bpe import decode

    one = spark.createDataFrame([(1, bytearray(b"\xff\xff\xff\x7f"))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="no token"):
        decode(one, spec).collect()
    with pytest.raises(Exception, match="32-bit"):
        decode(one.selectExpr("doc_id", "substring(ids, 1, 3) AS ids"), spec).collect()
    assert decode(one.selectExpr("doc_id", "cast(null AS binary) AS ids"), spec).first()["decoded"] == b""


def plain_tree(nodes, proofs):
    """Root of a list of (digest, leaves below); siblings are appended to proofs."""
    while len(nodes) > 1:
        up = []
        for i in range(0, len(nodes), 8):
            run = nodes[i : i + 8]
            for k, (_, below) in enumerate(run):
                for x in below:
                    proofs[x] += "".join(d for j, (d, _) in enumerate(run) if j != k)
            up.append((sha("".join(d for d, _ in run)), [x for _, below in run for x in below]))
        nodes = up
    return nodes[0]


def plain_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    own = lambda r, t: sha("".join(map(f, (r[0], r[3], r[2], r[4], t))))
    leaves = [own(r, r[1]) for r in rows]
    proofs, subroot, tops = [""] * len(rows), {}, []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        of = sorted((i for i, r in enumerate(rows) if r[2] == lang), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaves[i]))
        tops.append(plain_tree([(leaves[i], [i]) for i in of], proofs))
        subroot[lang] = tops[-1][0]
    root = plain_tree(tops, proofs)[0]
    out = []
    for i, r in enumerate(rows):
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None and own(r, re.sub("[A-Z]", lambda m: m.group().lower(), r[1])) != leaves[i]
        out.append((r[0] if r[0] is not None else -1, leaves[i], subroot[r[2]], root, sha(proofs[i]), not tampered))
    return sorted(out)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest_against_a_plain_tree(spark, docs, rows, monkeypatch, depth, tmp_path):
    from canopy.llm import manifest
    from canopy.llm.queries import op12_merkle_manifest

    whole = manifest.manifest
    monkeypatch.setattr(manifest, "manifest", lambda rows: whole(rows, depth=depth))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in got) == plain_manifest(rows)
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in got) and not all(r["verified"] for r in got)


def test_manifest_of_few_rows_and_of_none(spark, docs):
    from pyspark.sql import functions as F

    from canopy.llm.manifest import folded, leaf, manifest

    def made(df):
        return folded(manifest(df.withColumn("leaf", leaf(F.col("doc_id"), F.col("text"))).withColumn("root", F.lit(1))), "leaf").collect()

    assert made(docs.limit(0)) == []
    one = made(docs.where("doc_id = 9"))[0]
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == "" and one["Tree"] == "t"
    two = made(docs.where("doc_id IN (9, 12)").withColumn("lang", F.col("doc_id")))
    assert {r["root"] for r in two} == {sha("".join(r["leaf"] for r in sorted(two, key=lambda r: str(r["doc_id"]).encode()))) }
    with pytest.raises(Exception, match="null"):
        manifest(docs.withColumn("leaf", F.lit(None).cast("string"))).collect()


def plain_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", math.inf), r[0])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for r in rows:
        t = r[1] or ""
        w = SPACE.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > first[t]}
        docs.append((r[3] or "", {k for k, v in f.items() if v}, r[0] in good, r[0] in toxic))
    out, shapley = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                shapley[part, k] = shapley.get((part, k), 0) + len(gone)
                redundant = sum(k in d[1] for d in own) - len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, sum(d[1] == {k} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_audit_against_every_order_applied(spark, docs, rows):
    from canopy.llm.audit import audit

    rng = random.Random(2)
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.6]
    labels += [(labels[0][0], 1, 1), (None, 1, 1), (10**9, 1, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(docs, told)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert audit(docs.limit(0), told).count() == 0
    none = audit(docs.where("source = 'books'"), told.limit(0)).collect()
    assert len(none) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in none)


def test_edges_are_eighty_and_steps_six_hundred():
    from canopy.llm.audit import paths

    assert len(paths()) == 600 and len({(a, f) for _, _, a, f in paths()}) == 80
