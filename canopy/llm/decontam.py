"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment covers some documents (``SEGMENT_BYTES`` of text, or one that is longer) and holds their words' postings: sorted distinct terms, and for each the rising positions at which it stands. Test phrases are looked up in every segment: the list of a phrase's rarest term, shifted by the term's offset, is intersected with the shifted lists of its other terms in rising order of length. Segments are independent, so nothing is shuffled. Proximity matches begin likewise: at the places of an item's rarest term, whose lists are those of the rarest words in the test set, the others are looked for some words to either side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from canopy.llm.durable import durable, gathered
from canopy.llm.text import ALNUM_WORDS, by_block, segments, slices, split_words, then_give_back

#: Words of test items in one broadcast; more items are looked up in further passes.
BLOCK_WORDS = 200_000
#: Bytes of text in a segment, unless one document has more.
SEGMENT_BYTES = 2 << 20
#: Candidates intersected at once in a segment.
CANDIDATES = 1 << 20
#: Terms of an item, the rarest in the test set, that stand within so many words in a proximity match.
NEAR_TERMS, SLOP = 4, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def posted(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """One segment ``(ids, n_words, terms, bounds, positions)`` of some documents."""
    words = split_words(text, ALNUM_WORDS, lower=True)
    n_words = np.diff(words.first)
    place = np.arange(len(words.codes)) + np.repeat(np.arange(len(n_words)), n_words)
    order = np.argsort(words.codes, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(words.codes, minlength=len(words.vocab)))))

    def packed(values: np.ndarray) -> pa.Array:
        return pa.array([values.astype("<i4").tobytes()], pa.binary())

    # Words hold no line breaks
    terms = pa.array([b"\n".join(words.vocab.to_pylist())], pa.binary())
    return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), packed(n_words), terms, packed(bounds), packed(place[order])], names=["ids", "n_words", "terms", "bounds", "positions"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments ``(segment, ids, n_words, terms, bounds, positions)``, written to shared storage.

    Numbers are packed as little-endian 32-bit integers and terms are joined by line breaks, so that the JVM moves bytes and no arrays. ``positions[bounds[t]:bounds[t + 1]]`` are those of ``terms[t]``; document d has positions ``first[d] + 0 ..`` where ``first`` adds up ``n_words + 1``, so that no phrase crosses documents. Null and empty texts have no words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(by_block("text", lambda batch: posted(*batch.columns), SEGMENT_BYTES), f"ids array<{kind}>, n_words binary, terms binary, bounds binary, positions binary")
    return durable(made.select(F.monotonically_increasing_id().alias("segment"), "*"), wide=True)


@dataclass
class Phrases:
    """Distinct phrases of test items, as rows of term numbers (-1 beyond a shorter phrase's end), and the items that have each."""

    terms: list[bytes]
    windows: np.ndarray
    items: np.ndarray
    bounds: np.ndarray


def phrases(items: list[tuple[object, str | None]], window: int) -> Phrases:
    """Windows of ``window`` consecutive words of each item; an item with fewer words, but some, is one window. ``items`` refer to positions in the list given."""
    words = split_words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS, lower=True)
    rows, owner = [], []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        codes = words.codes[a:b]
        if 0 < len(codes) < window:
            rows.append(np.concatenate((codes, np.full(window - len(codes), -1, codes.dtype)))[None])
        elif len(codes):
            rows.append(np.lib.stride_tricks.sliding_window_view(codes, window))
        else:
            continue
        owner.append(np.full(len(rows[-1]), i))
    if not rows:
        return Phrases([], np.zeros((0, window), int), np.zeros(0, int), np.zeros(1, int))
    windows, inverse = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack((inverse.reshape(-1), np.concatenate(owner))), axis=1)
    return Phrases(words.vocab.to_pylist(), windows, pairs[1], np.searchsorted(pairs[0], np.arange(len(windows) + 1)))


class Segment:
    def __init__(self, ids: pa.Array, n_words: bytes, terms: bytes, bounds: bytes, positions: bytes) -> None:
        self.ids, self.n_words = ids, np.frombuffer(n_words, "<i4").astype(np.int64)
        self.bounds, self.positions = np.frombuffer(bounds, "<i4").astype(np.int64), np.frombuffer(positions, "<i4")
        data = np.frombuffer(terms, np.uint8)
        breaks = data == ord("\n")
        ends = np.append(np.flatnonzero(breaks), len(data)) if len(self.bounds) > 1 else np.zeros(0, np.int64)
        self.terms = slices(data[~breaks], np.concatenate(([0], ends - np.arange(len(ends)))))
        self.first = np.concatenate(([0], np.cumsum(self.n_words + 1)))
        term = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.bounds))
        self.keys = (term << 32) | self.positions

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        """This segment's numbers of the terms, -1 where it has none; the last entry stands for no term."""
        found = pc.index_in(pa.array(terms, pa.binary()), value_set=self.terms.cast(pa.binary()))
        return np.append(pc.fill_null(found, -1).to_numpy(zero_copy_only=False), -2).astype(np.int64)

    def phrase(self, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches: phrase numbers and start positions."""
        number = self.numbers(wanted.terms)[wanted.windows]  # -2 where a shorter phrase has ended
        here = np.flatnonzero((number != -1).all(axis=1))
        size = np.append(np.diff(self.bounds), [1 << 40, 1 << 40])  # by number; -1 and -2 index from the end
        rank = np.argsort(size[number[here]], axis=1, kind="stable")
        rarest = np.take_along_axis(number[here], rank[:, :1], 1)[:, 0]
        load = np.cumsum(size[rarest])
        found_p, found_s, at = [], [], 0
        while at < len(here):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + CANDIDATES, side="right")))
            sel, term = here[at:to], rarest[at:to]
            count = size[term]
            which = np.repeat(np.arange(len(sel)), count)
            start = self.positions[np.repeat(self.bounds[term], count) + segments(count)] - rank[at:to, 0][which]
            for r in range(1, rank.shape[1]):
                offset = rank[at:to, r]
                other = number[sel, offset]
                key = (other[which] << 32) | (start + offset[which]).astype(np.int64)
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (self.keys[spot] == key) | (other[which] == -2)
                which, start = which[keep], start[keep]
            found_p.append(sel[which])
            found_s.append(start)
            at = to
        return (np.concatenate(found_p), np.concatenate(found_s)) if found_p else (np.zeros(0, int), np.zeros(0, int))

    def near(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``terms`` (numbers, an item's rarest first, -1 where there is none here) and positions of their first term that have each other term within ``slop`` words in the same document."""
        here = np.flatnonzero((terms >= 0).all(axis=1)) if terms.size else np.zeros(0, np.int64)
        load = np.cumsum(np.diff(self.bounds)[terms[here, 0]]) if len(here) else here
        rows, places, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(here):
            to = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + CANDIDATES, side="right")))
            row, term = here[at:to], terms[here[at:to], 0]
            count = self.bounds[term + 1] - self.bounds[term]
            row = np.repeat(row, count)
            place = self.positions[np.repeat(self.bounds[term], count) + segments(count)].astype(np.int64)
            for k in range(1, terms.shape[1]):
                doc = np.searchsorted(self.first, place, side="right") - 1
                key = terms[row, k] << 32
                low, high = key | np.maximum(place - slop, self.first[doc]), key | np.minimum(place + slop, self.first[doc + 1] - 2)
                keep = np.searchsorted(self.keys, high, side="right") > np.searchsorted(self.keys, low, side="left")
                row, place = row[keep], place[keep]
            rows.append(row)
            places.append(place)
            at = to
        return np.concatenate(rows), np.concatenate(places)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Segment]]:
    """Segments with their numbers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("segment")[i].as_py(), Segment(batch.column("ids")[i].values, *[batch.column(c)[i].as_py() for c in ("n_words", "terms", "bounds", "positions")])


def with_rarest(benchmark: DataFrame, id_col: str, text_col: str, n: int = NEAR_TERMS) -> DataFrame:
    """``(id, text, rare)``: the ``n`` words of each item that fewest items have, ties in order of bytes; none if it has fewer different words."""
    words = F.array_distinct(F.filter(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWERED), SEPARATORS), lambda w: w != ""))
    items = durable(benchmark.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    each = items.select("at", F.explode(words).alias("t"))
    spread = each.join(each.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t")
    rare = spread.groupBy("at").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "t"))), 1, n).alias("rare")).where(F.size("rare") == n)
    return items.join(rare, "at", "left").select("id", "text", F.coalesce(F.transform("rare", lambda s: s["t"]), F.array().cast("array<string>")).alias("rare"))


def query_blocks(items: DataFrame, block_words: int, window: int) -> Iterator[list[tuple[object, str, list[str]]]]:
    """Test items ``(id, text, rare)`` in blocks of at most ``block_words`` words; they reach the driver one block at a time. Longer items are cut into parts that share ``window - 1`` words, so that each window is in one of them."""
    block, held = [], 0
    block_words = max(block_words, window)
    for item, text, rare in items.toLocalIterator():
        words = re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWERED)))
        step = block_words - window + 1
        for at in range(0, max(1, len(words) - window + 1), step):
            part = words[at : at + block_words]
            if block and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((item, " ".join(part), list(rare) if at == 0 else []))
            held += len(part)
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, slop: int = SLOP, item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(id, n_words, items, spans, near)`` of each document ``(id, text)``: the items with a window in it, the merged word ranges ``[start, end)`` that their occurrences cover, and the items whose rarest terms stand near each other.

    The index is written once. Test items go to the executors in blocks of at most ``block_words`` words, each of which takes a pass over the index: the first one returns every document, further ones only documents with a match, and these go to one table.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    index = build_index(docs, "id")

    def passes() -> Iterator[DataFrame]:
        for number, block in enumerate(query_blocks(with_rarest(benchmark, item_col, item_text), block_words, window)):
            shared = spark.sparkContext.broadcast(([i for i, _, _ in block], phrases([(i, t) for i, t, _ in block], window), [r for _, _, r in block]))
            yield index.mapInArrow(then_give_back(looking(shared, not number)), out)

    def looking(shared: Broadcast, whole: bool):
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, wanted, rare = shared.value
            ids_of = pa.array(names, item_type)
            length = (wanted.windows >= 0).sum(axis=1)
            has = np.flatnonzero([len(r) > 0 for r in rare])
            flat = [t.encode() for k in has.tolist() for t in rare[k]]

            def lists(doc: np.ndarray, item: np.ndarray, docs: int) -> pa.Array:
                pairs = np.unique(np.stack((doc, item)), axis=1)
                bound = np.searchsorted(pairs[0], np.arange(docs + 1)).astype(np.int32)
                return pa.ListArray.from_arrays(bound, ids_of.take(pa.array(pairs[1])))

            for number, segment in _segments(batches):
                docs = len(segment.ids)
                which, start = segment.phrase(wanted)
                change = np.zeros(int(segment.first[-1]) + 2, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, start + length[which], -1)
                covered = np.cumsum(change) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)))
                opens, closes = edges[::2], edges[1::2]
                owner = np.searchsorted(segment.first, opens, side="right") - 1
                base = segment.first[owner]
                bound = np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(bound, pa.StructArray.from_arrays([pa.array(opens - base), pa.array(closes - base)], names=["start", "end"]))
                count = wanted.bounds[which + 1] - wanted.bounds[which]
                item = wanted.items[np.repeat(wanted.bounds[which], count) + segments(count)]
                items = lists(np.repeat(np.searchsorted(segment.first, start, side="right") - 1, count), item, docs)
                row, place = segment.near(segment.numbers(flat)[:-1].reshape(len(has), -1) if len(has) else np.zeros((0, 1), np.int64), slop)
                near = lists(np.searchsorted(segment.first, place, side="right") - 1, has[row] if len(row) else row, docs)
                out = pa.record_batch([pa.array(np.full(docs, number)), pa.array(np.arange(docs)), segment.ids, pa.array(segment.n_words), items, spans, near], names=["_segment", "_row", "id", "n_words", "items", "spans", "near"])
                yield out if whole else out.take(pa.array(np.flatnonzero((np.diff(bound) > 0) | (pc.list_value_length(near).to_numpy(zero_copy_only=False) > 0))))

        return look

    out = f"_segment long, _row long, id {kind}, n_words long, items array<{item_kind}>, spans array<struct<start:long,end:long>>, near array<{item_kind}>"
    asked = passes()
    first = durable(next(asked), wide=True)
    further = gathered(asked, wide=True)
    if further is None:
        return first.drop("_segment", "_row")
    more = further.groupBy("_segment", "_row").agg(*[F.flatten(F.collect_list(c)).alias(f"_{c}") for c in ("items", "spans", "near")])
    joined = first.join(more, ["_segment", "_row"], "left")

    def both(c: str) -> Column:
        return F.array_distinct(F.concat(c, F.coalesce(f"_{c}", F.array().cast(first.schema[c].dataType)))).alias(c)

    return joined.select("id", "n_words", both("items"), F.array_sort(both("spans")).alias("spans"), both("near"))


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        to = F.greatest(acc["end"], s["end"])
        return F.struct(to.alias("end"), (acc["n"] + to - F.greatest(acc["end"], s["start"]).cast("long")).alias("n"))

    return F.aggregate(spans, zero, lambda acc, s: F.when(s["end"] > acc["end"], add(acc, s)).otherwise(acc), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, n_words, n_hit, items, spans, contaminated, near)`` of each document.

    Words are lower-cased runs of digits, letters and non-ASCII. A document word inside an occurrence of an item's window is hit; ``contaminated``: windows of ``min_items`` items or more occur. ``near``: items of which the ``NEAR_TERMS`` words that are rarest in the benchmark stand within ``SLOP`` words of an occurrence of the rarest of them, in any order. Null and empty texts have no words; null or wordless items have no windows; long documents and items are looked at whole; repeated documents are looked at each, repeated items count once for each id; an empty table on either side gives rows without hits, or none; other columns don't matter.
    """
    found = matches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, window, SLOP, item_col, item_text)
    return found.select(
        F.col("id").alias(id_col), "n_words", covered(F.col("spans")).alias("n_hit"), F.array_distinct("items").alias("items"), "spans",
        (F.size(F.array_distinct("items")) >= min_items).alias("contaminated"), F.array_distinct("near").alias("near"),
    )


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], slop: int = SLOP) -> DataFrame:
    """``(query, id, position)``: where a query's first word stands with all its other words within ``slop`` words, for queries ``(name, words)``. Queries without words match nothing; documents of equal ids give rows each."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [[w.encode() for w in dict.fromkeys(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWERED))))] for _, text in queries]
        width = max(map(len, terms), default=0)
        for _, segment in _segments(batches):
            for (name, _), own in zip(queries, terms, strict=True):
                if not own:
                    continue
                _, at = segment.near(segment.numbers((own * width)[: max(width, len(own))])[:-1][None], slop)
                doc = np.searchsorted(segment.first, at, side="right") - 1
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), segment.ids.take(pa.array(doc)), pa.array(at - segment.first[doc])], names=["query", "id", "position"])

    return index.mapInArrow(then_give_back(look), f"query string, id {kind}, position long")
