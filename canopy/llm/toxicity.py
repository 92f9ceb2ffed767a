"""Toxicity of whole texts: a convolutional classifier on hashed word embeddings, in numpy.

A word's embedding is the mean of the vectors of its hashed features: the word, its first 4 and 5 bytes and its last 4 and 5 bytes, so that words of one stem are near each other. Filters of several widths slide over a text's words; the greatest value of each filter goes into a logistic output. All labelled rows outside the held-out third are learnt from: their features are counted, filters and vectors are fitted by tasks, each on its rows, whose results are averaged in rounds, and thresholds are set from scores of a third of them, for each language, which is told from the text's function words. The driver holds the model and counts by feature and score only.
"""

from __future__ import annotations

import copy
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from canopy.llm.durable import durable
from canopy.llm.text import blocks, by_block, byte_table, give_back, split_words, then_give_back

BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled rows of each class, and bytes of their texts, at most where a caller asks for a sample of either kind and doesn't state the other.
SAMPLE, SAMPLE_BYTES = 1500, 64 << 20
#: Texts of a step, and bytes of them from which a step has fewer.
STEP, STEP_BYTES = 64, 1 << 20
#: Bytes of texts that a task fits the model on, and what it holds of them at a time.
TASK_BYTES, HELD_BYTES = 8 << 20, 16 << 20
#: Labelled ids that are sent to all executors.
FEW_IDS = 1_000_000
#: Words are letters, apostrophes and non-ASCII.
LETTERS = byte_table(bytes(b for b in range(128) if not (chr(b).isalpha() or b == 0x27)))
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in that it is was for on are as with they at be this from have or by not but what all were when your can",
    "de": "der die und den das von zu mit sich auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer",
    "fr": "le la les et des est une dans que qui du pour pas sur au ne par plus ce avec il sont aux cette ou mais leur elle nous vous",
    "es": "el los las del que una por con para su al lo como pero sus este ya entre cuando muy sin sobre ser tiene hasta hay donde quien desde nos",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
#: The score to which each language's threshold is mapped.
AT = 0.7


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # (width, DIM, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def features(vocab: pa.Array) -> np.ndarray:
    """Five hashed features of each word."""
    if not len(vocab):
        return np.zeros((0, 5), np.int64)
    vocab = vocab.cast(pa.large_binary())
    _, offsets, data = vocab.buffers()
    bounds = np.frombuffer(offsets, np.int64)[vocab.offset : vocab.offset + len(vocab) + 1]
    data = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)))
    begin, end = bounds[:-1], bounds[1:]
    size = end - begin
    place = np.arange(bounds[-1] - bounds[0]) - np.repeat(begin - bounds[0], size)
    power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, int(size.max()) + 2, dtype=np.uint64)
    grams = (data[bounds[0] : bounds[-1]].astype(np.uint64) + np.uint64(1)) * power[place]
    out = [np.add.reduceat(grams, begin - bounds[0])]
    for n in (4, 5):
        head, tail = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for k in range(n):
            head = head * np.uint64(1099511628211) + np.where(k < size, data[np.minimum(begin + k, len(data) - 1)], 0).astype(np.uint64)
            tail = tail * np.uint64(1099511628211) + np.where(k < size, data[np.maximum(end - 1 - k, 0)], 0).astype(np.uint64)
        out += [head * np.uint64(2 * n + 1) + np.uint64(n), tail * np.uint64(2 * n + 3) + np.uint64(64 + n)]
    mixed = np.stack(out, axis=1)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Texts:
    """Words of documents, each followed by ``max(WIDTHS)`` empty words; code 0 is the empty word."""

    codes: np.ndarray
    first: np.ndarray
    feats: np.ndarray
    language: np.ndarray


def read(column: pa.Array) -> Texts:
    words = split_words(column, LETTERS, lower=True)
    n = np.diff(words.first)
    pad = max(WIDTHS)
    first = words.first + pad * np.arange(len(n) + 1)
    codes = np.zeros(int(first[-1]), np.int64)
    codes[np.arange(len(words.codes)) + pad * np.repeat(np.arange(len(n)), n)] = words.codes + 1
    listed = np.zeros((len(words.vocab) + 1, len(LANGUAGES)), np.float32)
    for i, name in enumerate(LANGUAGES[1:], 1):
        at = pa.compute.index_in(pa.array([w.encode() for w in FUNCTION_WORDS[name].split()], pa.binary()), value_set=words.vocab.cast(pa.binary()))
        listed[1 + at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), i] = 1
    votes = np.add.reduceat(listed[codes], first[:-1], axis=0) if len(n) else np.zeros((0, len(LANGUAGES)))
    return Texts(codes, first, features(words.vocab), votes.argmax(axis=1))


def shifted(texts: Texts, by: int) -> np.ndarray:
    """The code ``by`` words further right in the same document, 0 beyond its end."""
    out = np.zeros_like(texts.codes)
    out[: len(out) - by] = texts.codes[by:]
    for k in range(1, by + 1):
        out[texts.first[1:] - k] = 0
    return out


def _convolved(embedded: np.ndarray, texts: Texts, model: Model) -> list[np.ndarray]:
    """Filter values at each word, before they are cut off at 0. ``embedded``: by code."""
    out = []
    for w, weights, bias in zip(WIDTHS, model.filters, model.biases, strict=True):
        value = np.broadcast_to(bias, (len(texts.codes), FILTERS)).copy()
        for j in range(w):
            value += (embedded @ weights[j])[shifted(texts, j)]
        out.append(value)
    return out


def embed(texts: Texts, model: Model) -> np.ndarray:
    return np.concatenate((np.zeros((1, DIM), np.float32), model.table[texts.feats].mean(axis=1))).astype(np.float32)


def probability(texts: Texts, model: Model) -> np.ndarray:
    if len(texts.first) < 2:
        return np.zeros(0)
    top = [np.maximum(np.maximum.reduceat(c, texts.first[:-1], axis=0), 0) for c in _convolved(embed(texts, model), texts, model)]
    z = np.concatenate(top, axis=1) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(rng: np.random.Generator) -> Model:
    return Model(
        rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )


def _alike(model: Model, bias: float) -> Model:
    model.out[:], model.out_bias = 0, bias
    model.thresholds = dict.fromkeys(LANGUAGES, 0.5)
    return model


def _weights(labels: np.ndarray, share: float) -> np.ndarray:
    """Of rows, so that both classes count alike; ``share`` of all are toxic."""
    return np.where(labels == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))


def train(texts: list[str], labels: np.ndarray, seed: int = 1, epochs: int = 8, batch: int = STEP, rate: float = 0.01, informed: bool = True) -> Model:
    """Fit on some texts by Adam; a third of them is kept aside for the thresholds. Without ``informed``, embeddings and filters start at random."""
    rng = np.random.default_rng(seed)
    model = _start(rng)
    if not len(texts) or labels.min() == labels.max():
        return _alike(model, -3.0 if not len(texts) or labels.max() == 0 else 3.0)
    order = rng.permutation(len(texts))
    aside, used = order[: len(order) // 3], order[len(order) // 3 :]
    batches = [used[i : i + batch] for i in range(0, len(used), batch)]
    read_in = [read(pa.array([texts[i] for i in b], pa.large_string())) for b in batches]
    if informed:
        _inform(model, read_in, [labels[b] for b in batches])
    _fitted(model, read_in, [labels[b] for b in batches], labels.mean(), rng, epochs, rate)
    _calibrate(model, [texts[i] for i in aside], labels[aside], [texts[i] for i in used], labels[used])
    return model


def _fitted(model: Model, read_in: list[Texts], labels: list[np.ndarray], share: float, rng: np.random.Generator, epochs: int, rate: float = 0.01) -> None:
    """Steps of Adam on batches of texts, each taken once an epoch."""
    moments: dict[str, list[np.ndarray]] = {}
    steps = 0

    def step(name: str, value: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in moments:
            moments[name] = [np.zeros_like(value), np.zeros_like(value)]
        m, v = moments[name]
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.999 * v[at] + 0.001 * grad * grad
        value[at] -= rate * (m[at] / (1 - 0.9**steps)) / (np.sqrt(v[at] / (1 - 0.999**steps)) + 1e-6)

    bias = np.full(1, model.out_bias, np.float32)
    for _ in range(epochs):
        for b in rng.permutation(len(read_in)).tolist():
            t, y, weight = read_in[b], labels[b], _weights(labels[b], share)
            steps += 1
            e = embed(t, model)
            conv = _convolved(e, t, model)
            docs = len(y)
            where = [np.stack([c[s:f].argmax(axis=0) + s for s, f in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True)]) for c in conv]
            top = [np.take_along_axis(c, w, 0) for c, w in zip(conv, where, strict=True)]
            h = np.concatenate([np.maximum(x, 0) for x in top], axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + bias[0], -30, 30)))
            dz = ((p - y) * weight / docs).astype(np.float32)
            dh = dz[:, None] * model.out[None]
            step_out = h.T @ dz
            right = [shifted(t, j) for j in range(max(WIDTHS))]
            touched, grads = [], []
            for i, w in enumerate(WIDTHS):
                g = dh[:, i * FILTERS : (i + 1) * FILTERS] * (top[i] > 0)
                at = where[i]
                gw = np.zeros_like(model.filters[i])
                for j in range(w):
                    code = right[j][at]  # (docs, FILTERS)
                    gw[j] = np.einsum("nfd,nf->df", e[code], g)
                    touched.append(code.reshape(-1))
                    grads.append((g[:, :, None] * model.filters[i][j].T[None]).reshape(-1, DIM))
                step(f"w{i}", model.filters[i], gw)
                step(f"b{i}", model.biases[i], g.sum(axis=0))
            step("out", model.out, step_out)
            step("bias", bias, np.array([dz.sum()], np.float32))
            code, grad = np.concatenate(touched), np.concatenate(grads)
            real = code > 0
            rows = t.feats[code[real] - 1].reshape(-1)
            spread = np.repeat(grad[real] / 5, 5, axis=0)
            unique, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, inverse, spread)
            step("table", model.table, total, unique)
    model.out_bias = float(bias[0])


def _inform(model: Model, texts: list[Texts], labels: list[np.ndarray]) -> None:
    counts = np.zeros((2, BUCKETS))
    n = np.zeros(2)
    for t, y in zip(texts, labels, strict=True):
        _count(t, y, counts)
        n += [(y == k).sum() for k in (0, 1)]
    _begin(model, counts, n)


def _count(t: Texts, y: np.ndarray, counts: np.ndarray) -> None:
    """Add the texts of each class that have a feature."""
    if len(y):
        doc = np.repeat(np.arange(len(y)), np.diff(t.first))
        real = t.codes > 0
        has = np.unique((doc[real, None] * BUCKETS + t.feats[t.codes[real] - 1]).reshape(-1))
        for k in (0, 1):
            counts[k] += np.bincount((has % BUCKETS)[y[has // BUCKETS] == k], minlength=BUCKETS)


def _begin(model: Model, counts: np.ndarray, n: np.ndarray) -> None:
    """Start the first dimension of each feature at its log odds among toxic texts, in standard errors, and let some filters look at it first."""
    odds = np.log((counts[1] + 0.5) / (n[1] - counts[1] + 0.5)) - np.log((counts[0] + 0.5) / (n[0] - counts[0] + 0.5))
    z = odds / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    z[counts.sum(axis=0) == 0] = 0
    model.table *= 0.2
    model.table[:, 0] = np.clip(z, -4, 12) / 3
    for f, b in zip(model.filters, model.biases, strict=True):
        f[:, 0, : FILTERS // 2] = 1
        b[: FILTERS // 2] = -np.linspace(0.5, 1.5, FILTERS // 2)
    model.out[:] = 0.1 * np.abs(model.out)


def _best(p: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """A threshold of greatest F1, in the middle of the gap that it falls into, of ``n`` rows at each different score, ``hits`` of them toxic."""
    order = np.argsort(-p)
    f1 = 2 * np.cumsum(hits[order]) / (np.cumsum(n[order]) + hits.sum())
    k = int(f1.argmax())
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + below) / 2, 0.02, 0.98))


def _set_thresholds(model: Model, language: np.ndarray, p: np.ndarray, n: np.ndarray, hits: np.ndarray, least: int = 20) -> None:
    """From rows kept aside, as counts by language and score; languages with few toxic ones there take the threshold of all."""

    def best(rows: np.ndarray) -> float:
        values, at = np.unique(p[rows], return_inverse=True)
        return _best(values, np.bincount(at, n[rows]), np.bincount(at, hits[rows]))

    pooled = best(np.ones(len(p), bool)) if hits.any() else 0.5
    for i, name in enumerate(LANGUAGES):
        own = language == i
        model.thresholds[name] = best(own) if hits[own].sum() >= least else pooled


def _calibrate(model: Model, texts: list[str], y: np.ndarray, more: list[str], more_y: np.ndarray, least: int = 20) -> None:
    if y.sum() < least:  # too few rows: those used for fitting serve too
        texts, y = texts + more, np.concatenate((y, more_y))
    p, language = [], []
    # By blocks, since filter values take tens of times the bytes of a text
    for b in blocks(pa.record_batch([pa.array(texts, pa.large_string())], names=["text"]), "text", 1 << 20):
        t = read(b.column(0))
        p.append(probability(t, model))
        language.append(t.language)
    p, language = np.concatenate(p), np.concatenate(language)
    _set_thresholds(model, language, p, np.ones(len(p)), y, least)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """0 to 1, the threshold of the text's language mapped to ``AT``."""
    texts = read(column)
    p = probability(texts, model)
    at = np.array([model.thresholds[name] for name in LANGUAGES])[texts.language] if len(p) else p
    return np.clip(np.where(p < at, AT * p / at, AT + (1 - AT) * (p - at) / (1 - at)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _fit_sample(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, sample: int, sample_bytes: int) -> Model:
    """On the driver, on at most ``sample`` rows of each class, those of least id hash, as long as their texts have ``sample_bytes`` together."""
    spark = docs.sparkSession
    chosen: dict[object, int] = {}
    for y in (0, 1):
        rows = ids.where(F.col("y") == y).groupBy("id", "y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        for r in rows:  # an id with both labels counts as toxic
            chosen[r["id"]] = max(y, chosen.get(r["id"], 0))
    if not chosen:
        return train([], np.zeros(0))
    kind = docs.schema[id_col].dataType
    wanted = spark.createDataFrame([(k, v) for k, v in chosen.items()], f"id {kind.simpleString()}, y int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    texts = durable(texts)
    fits, size = [], 0
    for r in texts.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        size += r["n"] or 0
        if size <= sample_bytes:
            fits.append((r["id"],))
    if not fits:
        return train([], np.zeros(0))
    got = texts.join(F.broadcast(spark.createDataFrame(fits, f"id {kind.simpleString()}")), "id", "left_semi").toArrow().sort_by("id")
    model = train([t or "" for t in got["text"].to_pylist()], got["y"].to_numpy())
    del got
    give_back()
    return model


def _flat(model: Model) -> np.ndarray:
    """All but the table, as rows of the table's width."""
    flat = np.concatenate([x.reshape(-1) for x in (*model.filters, *model.biases, model.out, np.float32([model.out_bias]))]).astype(np.float32)
    return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)


def _unflat(model: Model, flat: np.ndarray) -> None:
    flat, at = flat.reshape(-1), 0
    for x in (*model.filters, *model.biases, model.out):
        x[...] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    model.out_bias = float(flat[at])


def _batches(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, STEP):
        yield from blocks(batch.slice(at, STEP), "text", STEP_BYTES)


def _round(rows: DataFrame, model: Model, share: float, epochs: int, seed: int) -> None:
    """Each task goes on from the model on its own rows; each vector becomes the mean of those of the tasks that changed it, by their rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = copy.deepcopy(shared.value)
        rng, held, size, n = np.random.default_rng(seed), [], 0, 0
        for batch in itertools.chain(batches, [None]):
            for part in _batches(batch) if batch is not None else [None]:
                if part is not None:
                    held.append(part)
                    size += part.column("text").nbytes
                if held and (part is None or size >= HELD_BYTES):
                    n += sum(b.num_rows for b in held)
                    _fitted(own, [read(b.column("text")) for b in held], [b.column("y").to_numpy() for b in held], share, rng, epochs)
                    held, size = [], 0
        if n:
            moved = np.flatnonzero((own.table != shared.value.table).any(axis=1))
            flat = _flat(own)
            values = np.concatenate((own.table[moved], flat)).astype(np.float32)
            yield pa.record_batch([pa.array(np.append(moved, BUCKETS + np.arange(len(flat))).astype(np.int32)), pa.array(np.full(len(values), n, np.int64)), *[pa.array(values[:, k]) for k in range(DIM)]], names=["row", "n", *[f"v{k}" for k in range(DIM)]])

    columns = [f"v{k}" for k in range(DIM)]
    told = rows.select("text", "y").mapInArrow(then_give_back(run), f"row int, n long, {', '.join(f'{c} float' for c in columns)}")
    mean = told.groupBy("row").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in columns]).toArrow()
    row, values = mean["row"].to_numpy(), np.stack([mean[c].to_numpy() for c in columns], axis=1)
    inside = row < BUCKETS
    model.table[row[inside]] = values[inside]
    flat = _flat(model)
    flat[row[~inside] - BUCKETS] = values[~inside]
    _unflat(model, flat)
    shared.unpersist()


def _counted(rows: DataFrame) -> np.ndarray:
    def run(batches):
        counts = np.zeros((2, BUCKETS))
        for batch in batches:
            for part in _batches(batch):
                _count(read(part.column("text")), part.column("y").to_numpy(), counts)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), *[pa.array(c[at].astype(np.int64)) for c in counts]], names=["row", "c0", "c1"])

    got = rows.select("text", "y").mapInArrow(then_give_back(run), "row int, c0 long, c1 long").groupBy("row").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    counts = np.zeros((2, BUCKETS))
    for k in (0, 1):
        counts[k, got["row"].to_numpy()] = got[f"c{k}"].to_numpy()
    return counts


def _thresholds_of(rows: DataFrame, model: Model) -> None:
    """From scores of all ``rows``, told apart to four places."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = read(batch.column("text"))
        return pa.record_batch([pa.array(t.language.astype(np.int32)), pa.array(np.round(probability(t, shared.value).astype(np.float64), 4)), batch.column("y")], names=["language", "p", "y"])

    scored = rows.select("text", "y").mapInArrow(by_block("text", work, STEP_BYTES), "language int, p double, y int")
    got = scored.groupBy("language", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).toArrow()
    _set_thresholds(model, *[got[c].to_numpy() for c in ("language", "p", "n", "hits")])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int | None = None, sample_bytes: int | None = None) -> Model:
    """Train on all labelled rows outside the held-out third, of which a third by hash sets the thresholds; ``sample`` and ``sample_bytes`` train on the driver on so many rows of each class and bytes instead.

    Labels of null ids, null labels and labels of no document don't count; an id labelled both ways counts as toxic. Null and empty texts are no words; of an id's several texts the least in order of bytes is taken. With no labels, or those of one class, all scores are alike.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    if sample is not None or sample_bytes is not None:
        return _fit_sample(docs, ids, id_col, text_col, sample or SAMPLE, sample_bytes or SAMPLE_BYTES)
    ids = durable(ids.groupBy("id").agg(F.max("y").alias("y")))
    texts = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, "id").groupBy("id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.first("y").alias("y"))
    rows = durable(texts.withColumn("aside", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0))
    got = rows.groupBy("aside", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    n = {(a, y): sum(r["n"] for r in got if r["y"] == y and r["aside"] == a) for a in (False, True) for y in (0, 1)}
    model = _start(np.random.default_rng(1))
    toxic, clean = (n[False, y] + n[True, y] for y in (1, 0))
    if not toxic or not clean:
        return _alike(model, 3.0 if toxic else -3.0)
    # Too few rows: one part serves for both
    whole = not n[False, 0] or not n[False, 1]
    used = rows if whole else rows.where("NOT aside")
    size = sum(r["bytes"] for r in got if whole or not r["aside"])
    tasks = max(1, size // TASK_BYTES)
    _begin(model, _counted(used), np.array([clean, toxic] if whole else [n[False, 0], n[False, 1]], float))
    share = toxic / (toxic + clean)
    # Eight passes whatever the size: one task takes them at once, several meet after every two
    rounds, epochs = (1, 8) if tasks == 1 else (4, 2)
    for r in range(rounds):
        _round(used.coalesce(tasks), model, share, epochs, r + 1)
    _thresholds_of(rows.where("aside") if n[True, 1] >= 20 else rows, model)
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """``(id, held_out, score, predicted)`` of each whole text; with ``keep``, the columns of ``docs`` and a score of that name.

    Only the text is read, all of it. Null, empty and wordless texts are scored as no words. A score of just ``AT`` is predicted toxic; a text whose function words tie for two languages is taken to be of the first in the list. Rows come back one for one, repeated ones too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    if keep:

        def with_score(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.append_column(keep, pa.array(scores(batch.column(text_col), shared.value)))

        return docs.mapInArrow(by_block(text_col, with_score, 1 << 20), StructType([*docs.schema.fields]).add(keep, DoubleType()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("id"), pa.array(scores(batch.column("_text"), shared.value))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(by_block("_text", work, 1 << 20), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= AT).cast("int").alias("predicted"))
