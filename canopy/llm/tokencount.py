"""Token counts of whole texts by compiled finite-state transducers (see ``transducer``)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.text import by_block, sums, text_bytes
from canopy.llm.transducer import Merger, split_texts, vocabulary


@lru_cache(maxsize=1)
def compiled(spec: str) -> tuple[Merger, dict[str, int]]:
    """One Merger a process; its states stay for the next batches."""
    tokens, added = vocabulary(spec)
    return Merger(tokens), added


def apart(column: pa.Array, added: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at added tokens' strings: the parts, the document of each, and the added tokens in each document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    own, extra = np.arange(len(column)), np.zeros(len(column), np.int64)
    if not added:
        return column, own, extra
    pattern = "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))
    has = pa.compute.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
    if not has.any():
        return column, own, extra
    parts, docs = [], []
    for d, text in enumerate(column.to_pylist()):
        cut = re.split(pattern, text) if has[d] else [text]
        extra[d] = len(cut) - 1
        parts += cut
        docs += [d] * len(cut)
    return pa.array(parts, pa.large_string()), np.array(docs), extra


def count_tokens(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each document.

    spec: the JSON text of a byte-level BPE tokenizer (a vocabulary of bounded size goes to the executors). Strings of added tokens inside a text count one each. Null and empty texts have 0 bytes and 0 tokens; long texts and long pieces of them are counted whole; a row is returned for each row given, repeated or not; an empty table gives no rows; other columns don't matter. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        merger, added = compiled(shared.value)
        ids, column = batch.columns
        size = pa.compute.binary_length(column).fill_null(0).cast(pa.int64())
        parts, owner, total = apart(column, added)
        pieces, first = split_texts(*text_bytes(parts))
        _, bounds, data = pieces.dictionary.buffers()
        n = len(pieces.dictionary)
        each = merger.count(np.frombuffer(data, np.uint8) if n else np.zeros(0, np.uint8), np.frombuffer(bounds, np.int64)[: n + 1] if n else np.zeros(1, np.int64))
        np.add.at(total, owner, sums(each[pieces.indices.to_numpy(zero_copy_only=False)], first))
        return pa.record_batch([ids, size, pa.array(total), pa.array(total > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(by_block("text", work), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("id", id_col)
    )
