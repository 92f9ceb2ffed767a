"""Substring dedup with suffix automata of reference shards.

Sending every shard's automaton to every document would cost shards times documents, so shards are made by content and each document's words are streamed only to shards that can match them. The shard of a window of ``window`` words is told by its minimizer, the least hash of its ``GRAM``-word grams: equal windows have equal minimizers. Consecutive windows with one minimizer form a run, and a run is what moves.

1. Documents that equal an earlier one are covered whole and go no further.
2. Blocks of documents send the minimizers of their runs, each once; those met in one place only are done with.
3. Blocks send the words of the other runs, each distinct one once with its first place, to the shard of the minimizer. A shard puts its runs, in order of their places, through a suffix automaton, one for each minimizer. The matching statistic at each word, the length of the longest word sequence ending there that has occurred before, decides which windows have started earlier, and nothing else does.
4. Blocks merge the windows found into maximal spans and remove them.

A minimizer of more than ``HOT`` blocks, as of a passage that a share of all documents has, would bring a run from each of them to one shard. Its runs are cut into their windows instead, which are dealt by digest: the first place of each is aggregated before it is moved, and joined back to the places of the window, where Spark can split a window that stands in very many blocks.

Blocks stand in a table bucketed by block, so that steps 3 and 4 join small tables to them without moving texts.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.durable import durable
from canopy.llm.text import SPACE_WORDS, by_block, segments, split_words, then_give_back

GRAM = 6
#: Windows of a run at most; they are bits of a long.
RUN = 32
BLOCK_BYTES = 4 << 20
#: Buckets of minimizers for each GB of text, and shards of runs; at least LEAST.
BUCKETS_PER_GB, SHARDS_PER_GB, LEAST = 64, 256, 64
#: Buckets of the table of blocks at most; Spark takes up to 100,000.
MOST_STORED = 50_000
#: Blocks that a minimizer's runs may come from, to be matched in one shard.
HOT = 4096

_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _drop() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")
        except Exception:  # noqa: BLE001  the session has ended
            return


class Runs:
    """Runs of windows in the documents of a block."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        words = split_words(texts, SPACE_WORDS)
        self.first, size = words.first, words.end - words.start
        self.begin = np.cumsum(size + 1) - size - 1
        self.size = size
        joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[SPACE_WORDS[words.data]]
        self.joined = joined.tobytes()
        self.window = window
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in words.vocab.to_pylist()], np.uint64)
        h = hashed[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        n = len(h) - window + 1
        counts = np.maximum(np.diff(self.first) - window + 1, 0)
        if n <= 0 or not counts.sum():
            self.start = self.count = self.mini = self.twice = np.zeros(0, np.int64)
            return
        gram = min(GRAM, window)
        g = np.zeros(len(h) - gram + 1, np.uint64)
        for j in range(gram):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        least, width = g, 1
        span = window - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        doc = np.repeat(np.arange(len(counts)), counts)
        at = self.first[:-1][doc] + segments(counts)
        value = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        new |= (np.arange(len(at)) - lead) % RUN == 0
        heads = np.flatnonzero(new)
        self.start, self.mini = at[heads], value[heads].view(np.int64)
        self.count = np.diff(np.append(heads, len(at)))
        # A window can stand twice in a run only if the minimizer does.
        times = np.zeros(len(heads), np.int64)
        for j in range(min(RUN, int(self.count.max())) + span - 1):
            inside = j < self.count + span - 1
            times += inside & (g[np.minimum(self.start + j, len(g) - 1)].view(np.int64) == self.mini)
        self.twice = times > 1

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ones, and whether each stands in several places here."""
        mini, inverse, n = np.unique(self.mini, return_inverse=True, return_counts=True)
        return mini, (n > 1) | (np.bincount(inverse, weights=self.twice, minlength=len(mini)) > 0)

    def _of(self, wanted: np.ndarray) -> np.ndarray:
        """Runs with minimizers in ``wanted`` (sorted)."""
        spot = np.minimum(np.searchsorted(wanted, self.mini), max(0, len(wanted) - 1))
        return np.flatnonzero(wanted[spot] == self.mini) if len(wanted) else np.zeros(0, np.int64)

    def windows(self, wanted: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Windows of runs with minimizers in ``wanted``: distinct digests, where the windows start, and the digest of each."""
        run = self._of(wanted)
        start = np.repeat(self.start[run], self.count[run]) + segments(self.count[run])
        last = start + self.window - 1
        raw, seen = self.joined, {}
        number = [seen.setdefault(xxhash.xxh3_128_digest(raw[x:y]), len(seen)) for x, y in zip(self.begin[start].tolist(), (self.begin[last] + self.size[last]).tolist(), strict=True)]
        return list(seen), start, np.array(number, np.int64)

    def distinct(self, wanted: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Runs with minimizers in ``wanted`` (sorted): distinct word sequences, the runs, and the sequence of each."""
        run = self._of(wanted)
        last = self.start[run] + self.count[run] + self.window - 2
        a, b = self.begin[self.start[run]].tolist(), (self.begin[last] + self.size[last]).tolist()
        seen: dict[bytes, int] = {}
        raw = self.joined
        number = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(a, b, strict=True)], np.int64)
        return list(seen), run, number


def leading(ids: pa.Array, row: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each sequence number, which run has it first: in the document of least id, then of first row, leftmost."""
    rank = np.empty(len(ids), np.int64)
    by_id = pc.sort_indices(pa.table({"id": ids, "row": np.arange(len(ids))}), sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start")
    rank[by_id.to_numpy()] = np.arange(len(ids))
    order = np.lexsort((start, rank[row], number))
    return order[np.unique(number[order], return_index=True)[1]]


class Automaton:
    """Suffix automaton of all sequences put in. ``put`` gives matching statistics on the way: the automaton of what came before knows them."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def put(self, words: list[bytes]) -> list[int]:
        """Length, at each word, of the longest sequence ending there that had occurred before, in earlier sequences or further left in this one."""
        nxt, link, length = self.next, self.link, self.length
        last, out = 0, []
        for w in words:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to
                out.append(length[to])
                continue
            p, fresh = last, to is None
            if fresh:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    out.append(0)
                    last = cur
                    continue
                to = nxt[p][w]
            if length[to] == length[p] + 1:
                target = to
            else:
                target = len(nxt)
                nxt.append(dict(nxt[to]))
                link.append(link[to])
                length.append(length[p] + 1)
                link[to] = target
                while p >= 0 and nxt[p].get(w) == to:
                    nxt[p][w] = target
                    p = link[p]
            out.append(length[target])
            if fresh:
                link[cur] = target
                last = cur
            else:
                last = target
        return out


def seen_before(runs: list[list[bytes]], window: int) -> list[int]:
    """For each run, in order, the windows that occur in earlier runs or further left, as bits."""
    automaton, out = Automaton(), []
    for words in runs:
        bits = 0
        for k, n in enumerate(automaton.put(words)[window - 1 :]):
            if n >= window:
                bits |= 1 << k
        out.append(bits)
    return out


def _store(docs: DataFrame, buckets: int) -> str:
    """Blocks of documents as a table bucketed by block."""
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal block
            block += 1
            bound = pa.array([0, part.num_rows], pa.int32())
            return pa.record_batch([pa.array([block]), *[pa.ListArray.from_arrays(bound, pa.concat_arrays([c])) for c in part.columns]], names=["block", "ids", "texts"])

        yield from by_block("text", one, BLOCK_BYTES)(batches)

    name = f"canopy_{uuid.uuid4().hex}"
    blocks = docs.select("id", "text").mapInArrow(run, f"block long, ids array<{kind}>, texts array<string>")
    blocks.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    _tables.append((spark, name))
    return name


def _longs(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").tobytes()


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, removed, n_removed, kept_text, kept_sha256)`` of each document.

    Words are runs free of white space, unchanged. A word goes if a window of ``window`` words that covers it has the words of a window that starts earlier: in a document of smaller id, or further left in the same one. ``removed``: maximal word ranges ``[start, end)``. Null and empty texts have no words; texts of under ``window`` words stay whole. Null ids count as smallest; of rows with one id, the one stored first counts as smaller. Long texts are looked at whole; repeated rows give a row each; an empty table gives none; other columns don't matter.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # 1. Equal texts: all but the first are covered whole. Only digests move; ties of id go by place.
    marks = durable(rows.select("id", F.monotonically_increasing_id().alias("at"), F.sha2("text", 256).substr(1, 32).alias("digest"), F.octet_length("text").cast("long").alias("size"), "text"))
    firsts = marks.groupBy("digest").agg(F.min(F.struct(F.coalesce(F.col("id").isNotNull(), F.lit(False)).alias("k"), "id", "at")).alias("first"), F.count(F.lit(1)).alias("copies"))
    # Written down, so that the join can split a text of very many copies among tasks
    copied = durable(firsts.where("copies > 1").select("digest", F.col("first.at").alias("at0")))
    gb = (marks.agg(F.sum("size")).first()[0] or 0) / 1e9
    buckets, shards = max(LEAST, round(BUCKETS_PER_GB * gb)), max(LEAST, round(SHARDS_PER_GB * gb))
    again = marks.join(copied, "digest").where("at <> at0")
    later = durable(again.select("at"))
    name = _store(marks.join(later, "at", "left_anti"), min(MOST_STORED, max(LEAST // 4, buckets // 4)))
    blocks = spark.table(name)

    def word_count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(split_words(batch.column("text"), SPACE_WORDS).first)
        whole = n >= window
        return pa.record_batch([batch.column("id"), pa.array(n), pa.array(whole), batch.column("text")], names=["id", "n_words", "whole", "text"])

    hot = HOT

    # 2. Minimizers, each once a block
    def minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mini, several = Runs(batch.column("texts")[i].values, window).minimizers()
                bucket = (mini.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                used, bound = np.unique(bucket[order], return_index=True)
                parts = np.split(order, bound[1:])[: len(used)]
                yield pa.record_batch(
                    [pa.array(used.astype(np.int32)), pa.array([batch.column("block")[i].as_py()] * len(used), pa.int64()), pa.array([_longs(mini[p]) for p in parts], pa.binary()), pa.array([several[p].tobytes() for p in parts], pa.binary())],
                    names=["bucket", "block", "minis", "several"],
                )

    def repeated(table: pa.Table) -> pa.Table:
        minis = [np.frombuffer(m.as_py(), "<i8") for m in table["minis"]]
        several = np.concatenate([np.frombuffer(s.as_py(), bool) for s in table["several"]])
        flat = np.concatenate(minis)
        value, inverse, n = np.unique(flat, return_inverse=True, return_counts=True)
        n += np.bincount(inverse, weights=several, minlength=len(value)).astype(n.dtype)
        n = n[inverse]
        at = np.cumsum([0, *[len(m) for m in minis]])

        def those(hit: np.ndarray) -> pa.Array:
            return pa.array([_longs(m[hit[a:b]]) for m, a, b in zip(minis, at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())

        return pa.table({"block": table["block"], "minis": those((n > 1) & (n <= hot)), "hot": those(n > hot)})

    sent = blocks.select("block", "texts").mapInArrow(then_give_back(minimizers), "bucket int, block long, minis binary, several binary")
    met = sent.groupBy("bucket").applyInArrow(repeated, "block long, minis binary, hot binary").groupBy("block")
    flags = durable(met.agg(F.collect_list("minis").alias("minis"), F.filter(F.collect_list("hot"), lambda h: F.octet_length(h) > 0).alias("hot")))

    def wanted(cell) -> np.ndarray:
        values = cell.as_py()
        return np.sort(np.concatenate([np.frombuffer(v, "<i8") for v in values])) if values else np.zeros(0, np.int64)

    # 3. Runs to shards
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                found = Runs(batch.column("texts")[i].values, window)
                texts, run, number = found.distinct(wanted(batch.column("minis")[i]))
                row = np.searchsorted(found.first, found.start[run], side="right") - 1
                lead = leading(ids, row, found.start[run], number)
                mini = found.mini[run[lead]]
                yield pa.record_batch(
                    [pa.array((mini.view(np.uint64) // np.uint64(buckets) % np.uint64(shards)).astype(np.int32)), pa.array(mini), pa.array(np.full(len(lead), batch.column("block")[i].as_py())), pa.array(np.arange(len(lead), dtype=np.int32)),
                     ids.take(pa.array(row[lead])), pa.array(row[lead]), pa.array(found.start[run[lead]]), pa.array(texts, pa.binary())],
                    names=["shard", "mini", "block", "number", "id", "row", "start", "words"],
                )

    def shard(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("mini", "ascending"), ("id", "ascending"), ("block", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_start"))
        mini, words = table["mini"].to_numpy(), table["words"].to_pylist()
        heads = np.append(np.flatnonzero(np.append(True, mini[1:] != mini[:-1])), len(mini)).tolist()
        bits = np.array([n for a, b in zip(heads[:-1], heads[1:], strict=True) for n in seen_before([w.split(b" ") for w in words[a:b]], window)], np.int64)
        keep = np.flatnonzero(bits)
        return pa.table({"block": table["block"], "number": table["number"], "bits": pa.array(bits)}).take(pa.array(keep))

    run_type = f"shard int, mini long, block long, number int, id {kind}, row long, start long, words binary"
    hits = durable(blocks.join(flags, "block").select("block", "ids", "texts", "minis").mapInArrow(then_give_back(runs), run_type).groupBy("shard").applyInArrow(shard, "block long, number int, bits long"))

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                found = Runs(batch.column("texts")[i].values, window)
                digests, start, number = found.windows(wanted(batch.column("hot")[i]))
                row = np.searchsorted(found.first, start, side="right") - 1
                lead = leading(ids, row, start, number)
                yield pa.record_batch(
                    [pa.array(digests, pa.binary()), pa.array(np.full(len(lead), batch.column("block")[i].as_py())), pa.array(np.arange(len(lead), dtype=np.int32)), ids.take(pa.array(row[lead])), pa.array(row[lead]), pa.array(start[lead])],
                    names=["digest", "block", "number", "id", "row", "start"],
                )

    heated = flags.where(F.size("hot") > 0)
    met_again = None
    if not heated.isEmpty():
        each = durable(blocks.join(heated, "block").select("block", "ids", "texts", "hot").mapInArrow(then_give_back(hot_windows), f"digest binary, block long, number int, id {kind}, row long, start long"))
        place = (F.col("id").isNotNull().alias("k"), "id", "block", "row", "start")
        earliest = each.groupBy("digest").agg(F.min(F.struct(*place, "number")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # Written down, so that the join can split a window of very many blocks among tasks
        earliest = durable(earliest.select("digest", F.col("f.block").alias("block0"), F.col("f.number").alias("number0")))
        met_again = durable(each.join(earliest, "digest").where("block <> block0 OR number <> number0").groupBy("block").agg(F.collect_list("number").alias("hot_hits")))

    # 4. Removal
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = Runs(batch.column("texts")[i].values, window)
                ids = batch.column("ids")[i].values
                gone = np.zeros(len(found.size) + 1, np.int32)
                if batch.column("minis")[i].is_valid:
                    texts, run, number = found.distinct(wanted(batch.column("minis")[i]))
                    bits = np.zeros(max(1, len(texts)), np.int64)
                    got = batch.column("hits")[i]
                    if got.is_valid:
                        bits[got.values.field("number").to_numpy()] = got.values.field("bits").to_numpy()
                    row = np.searchsorted(found.first, found.start[run], side="right") - 1
                    lead = np.zeros(len(run), bool)
                    lead[leading(ids, row, found.start[run], number)] = True
                    mask = np.where(lead, bits[number] if len(number) else 0, -1).astype(np.int64)
                    for k in range(RUN):
                        hit = ((mask >> k) & 1 > 0) & (k < found.count[run])
                        at = found.start[run][hit] + k
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    digests, start, number = found.windows(wanted(batch.column("hot")[i]))
                    again = np.ones(len(start), bool)
                    if len(start):
                        later = np.zeros(len(digests), bool)
                        if batch.column("hot_hits")[i].is_valid:
                            later[batch.column("hot_hits")[i].values.to_numpy()] = True
                        lead = leading(ids, np.searchsorted(found.first, start, side="right") - 1, start, number)
                        again[lead] = later[number[lead]]
                    np.add.at(gone, start[again], 1)
                    np.add.at(gone, start[again] + window, -1)
                yield removed(ids, found, np.cumsum(gone[:-1]) > 0)

    def removed(ids: pa.Array, found: Runs, gone: np.ndarray) -> pa.RecordBatch:
        text, spans, digest, n_removed = [], [], [], []
        raw, begin, size = found.joined, found.begin.tolist(), found.size.tolist()
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            flags_here = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], flags_here, [False])).astype(np.int8))).tolist()
            cuts = list(zip(edge[::2], edge[1::2], strict=True))
            keep, at = [], 0
            for s, e in [*cuts, (b - a, b - a)]:
                if s > at:
                    keep.append(raw[begin[a + at] : begin[a + s - 1] + size[a + s - 1]])
                at = e
            left = b" ".join(keep)
            text.append(left)
            digest.append(hashlib.sha256(left).hexdigest())
            spans.append([{"start": s, "end": e} for s, e in cuts])
            n_removed.append(int(flags_here.sum()))
        return pa.record_batch(
            [ids, pa.array(np.diff(found.first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(n_removed, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
            names=["id", "n_words", "removed", "n_removed", "kept_text", "kept_sha256"],
        )

    # Written down, so that the join below takes the blocks' buckets as they are and moves the hits only
    found = durable(hits.groupBy("block").agg(F.collect_list(F.struct("number", "bits")).alias("hits")))
    out_type = f"id {kind}, n_words long, removed array<struct<start:long,end:long>>, n_removed long, kept_text string, kept_sha256 string"
    main = blocks.join(flags, "block", "left").join(found, "block", "left")
    main = main.withColumn("hot_hits", F.lit(None).cast("array<int>")) if met_again is None else main.join(met_again, "block", "left")
    main = main.select("ids", "texts", "minis", "hot", "hits", "hot_hits").mapInArrow(then_give_back(remove), out_type)
    copies = marks.join(later, "at").select("id", "text").mapInArrow(by_block("text", word_count), f"id {kind}, n_words long, whole boolean, text string")
    kept = F.when(F.col("whole"), F.lit("")).otherwise(F.array_join(F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""), " "))
    span = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    copies = copies.select("id", "n_words", span.alias("removed"), F.when(F.col("whole"), F.col("n_words")).otherwise(0).alias("n_removed"), kept.alias("kept_text"), F.sha2(kept, 256).alias("kept_sha256"))
    return main.unionByName(copies).withColumnRenamed("id", id_col)
