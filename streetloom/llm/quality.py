"""A quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over every byte of a document. Their responses are
max-pooled in chunks that overlap by half and cover the whole text; the chunks'
maxima are rectified and pooled once more, by mean and by maximum, and a logistic
layer makes one probability of them. A filter is a table of weights for each of
WIDTH byte positions, so inference is table look-ups and sums.

Training uses a bounded sample of labelled rows, chosen by a hash, in one task
of an executor: SAMPLE documents of each label at most, of SAMPLE_BYTES in all; longer
documents count in full. Everything else, the scoring, runs over all texts.

Null and empty texts get the score of a document without responses. Null
labels are ignored; of repeated labels for a doc_id each counts. With labels of one
kind only, or none, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, blank, prepare, table, text_buffer

#: Bytes that a filter sees, filters, and bytes between the starts of chunks (a chunk is two of these long).
WIDTH, FILTERS, STRIDE = 6, 24, 256
#: The sample: documents of each label, and bytes of text in all.
SAMPLE, SAMPLE_BYTES = 1_500, 16 << 20
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.02, 1e-4
#: From this score on a document is predicted as 1.
DECISION = 0.5


class Network:
    """tables: [WIDTH, 256, FILTERS]; bias: [FILTERS]; weights: [2 * FILTERS]; base: a number."""

    def __init__(self, tables: np.ndarray, bias: np.ndarray, weights: np.ndarray, base: float):
        self.tables, self.bias, self.weights, self.base = tables, bias, weights, base

    @classmethod
    def fresh(cls, texts: list[bytes], seed: int = 7) -> Network:
        """Filters start near snippets of the texts, one from each of as many documents."""
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.02, (WIDTH, 256, FILTERS)).astype(np.float32)
        long = [t for t in texts if len(t) >= WIDTH]
        for f in range(FILTERS if long else 0):
            t = long[rng.integers(len(long))]
            at = rng.integers(len(t) - WIDTH + 1)
            for k in range(WIDTH):
                tables[k, t[at + k], f] += 0.4
        return cls(tables, np.full(FILTERS, -0.4, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def pairs(self) -> list[np.ndarray]:
        """Tables for two neighbouring bytes at a time."""
        return [(self.tables[k][:, None, :] + self.tables[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def score(self, data: np.ndarray, offsets: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
        """Probabilities of the documents in a buffer."""
        n = len(offsets) - 1
        out = np.empty(n)
        a = 0
        while a < n:  # a bounded number of bytes at a time; a long document's segments go by parts too
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, "right")) - 1)
            top = self._segments(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], pairs)
            out[a:z] = self._combine(*top)
            a = z
        return out

    def _segments(self, data: np.ndarray, offsets: np.ndarray, pairs: list[np.ndarray]):
        """(maxima over stretches of STRIDE bytes, the document of each stretch, number of documents)."""
        spread, starts, ends, doc = layout(data, offsets)
        tops = np.empty((len(starts), FILTERS), np.float32)
        a = 0
        while a < len(starts):
            z = max(a + 1, int(np.searchsorted(ends, starts[a] + PART, "right")))
            cuts = np.stack([starts[a:z], ends[a:z]], 1).ravel()[:-1] - starts[a]
            tops[a:z] = np.maximum.reduceat(respond(spread[starts[a] : ends[z - 1] + WIDTH - 1], pairs), cuts, axis=0)[::2]
            a = z
        return tops, doc, len(offsets) - 1

    def _combine(self, tops: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        pooled, _, _, _ = self._pool(tops, doc, n)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights.astype(np.float64) + self.base, -40, 40)))

    def _pool(self, tops: np.ndarray, doc: np.ndarray, n: int):
        """Chunks of two stretches each, rectified; then their mean and maximum in each document."""
        chunks, second = tops.copy(), np.zeros(tops.shape, bool)
        if len(tops) > 1:
            same = doc[1:] == doc[:-1]
            second[:-1] = same[:, None] & (tops[1:] > tops[:-1])
            chunks[:-1] = np.where(second[:-1], tops[1:], tops[:-1])
        active = chunks + self.bias
        soft = np.maximum(active, 0)
        pooled = np.zeros((n, 2 * FILTERS))
        if len(tops):
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            size = np.diff(heads, append=len(doc))
            pooled[doc[heads], :FILTERS] = np.add.reduceat(soft, heads, axis=0) / size[:, None]
            pooled[doc[heads], FILTERS:] = np.maximum.reduceat(soft, heads, axis=0)
        return pooled, soft, active > 0, second


#: Bytes whose responses are held at a time.
PART = 128 << 10


def layout(data: np.ndarray, offsets: np.ndarray):
    """Bytes with WIDTH - 1 zeros after each document, where stretches start and end, and their documents; empty documents have none."""
    sizes = np.diff(offsets)
    n = len(sizes)
    place = np.repeat(np.arange(n) * (WIDTH - 1), sizes) + np.arange(len(data))
    spread = np.zeros(len(data) + n * (WIDTH - 1), np.uint8)
    spread[place] = data
    begin = offsets[:-1] + np.arange(n) * (WIDTH - 1)
    stretches = -(-sizes // STRIDE)
    doc = np.repeat(np.arange(n), stretches)
    starts = np.repeat(begin, stretches) + (np.arange(len(doc)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * STRIDE
    return spread, starts, np.minimum(starts + STRIDE, (begin + sizes)[doc]), doc


def respond(spread: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """The filters' responses at each position that has WIDTH bytes."""
    both = spread[:-1].astype(np.int32) << 8 | spread[1:]
    n = len(spread) - WIDTH + 1
    out = pairs[0][both[:n]]
    for k in range(1, len(pairs)):
        out += pairs[k][both[2 * k : 2 * k + n]]
    return out


def train(texts: list[bytes], labels: np.ndarray) -> Network:
    """Logistic loss by Adam on whole documents; gradients flow to the bytes under each chunk's maximum."""
    net = Network.fresh(texts)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.base = float(np.log(share / (1 - share)))
    if labels.min(initial=1) == labels.max(initial=0):
        return net
    rng = np.random.default_rng(11)
    params = [net.tables, net.bias, net.weights, np.array([net.base])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            grads = _gradients(net, [texts[i] for i in pick], labels[pick])
            step += 1
            rate = RATE * min(1, 2 * (EPOCHS - epoch) / EPOCHS)
            for p, g, m1, v1 in zip(params, grads, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.01 * (g * g - v1)
                p -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-6) + rate * DECAY * p).astype(p.dtype)
            net.base = float(params[3][0])
    return net


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    spread, starts, ends, doc = layout(data, offsets)
    pairs = net.pairs()
    tops, at = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
    columns = np.arange(FILTERS)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + PART, "right")))
        got = respond(spread[starts[a] : ends[z - 1] + WIDTH - 1], pairs)
        # a short stretch repeats its last place
        idx = np.minimum(np.arange(STRIDE)[None, :], (ends[a:z] - starts[a:z])[:, None] - 1) + (starts[a:z] - starts[a])[:, None]
        best = got[idx].argmax(1)
        at[a:z] = starts[a:z, None] + np.minimum(best, (ends[a:z] - starts[a:z])[:, None] - 1)
        tops[a:z] = got[at[a:z] - starts[a], columns]
        a = z
    n = len(texts)
    pooled, soft, active, second = net._pool(tops, doc, n)
    p = 1 / (1 + np.exp(-np.clip(pooled @ net.weights + net.base, -40, 40)))
    error = (p - labels) / n
    g_weights = (pooled.T @ error).astype(np.float32)
    if not len(tops):
        return [np.zeros_like(net.tables), np.zeros_like(net.bias), g_weights, np.array([error.sum()])]
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(heads, append=len(doc))
    per = np.zeros(n)
    per[doc[heads]] = size
    flow = error[doc][:, None] * net.weights[None, :FILTERS] / per[doc][:, None]
    top = soft >= np.maximum.reduceat(soft, heads, axis=0)[np.repeat(np.arange(len(heads)), size)]
    # neighbouring chunks share a stretch, so maxima tie; the first counts
    seen = np.cumsum(top, axis=0)
    top &= seen - np.repeat(seen[heads] - top[heads], size, axis=0) == 1
    flow = (flow + error[doc][:, None] * net.weights[None, FILTERS:] * top) * active
    g_bias = flow.sum(0)
    source = np.where(second, np.vstack([at[1:], at[-1:]]), at)
    g_tables = np.zeros_like(net.tables)
    for k in range(WIDTH):
        np.add.at(g_tables[k], (spread[source + k], np.broadcast_to(columns, source.shape)), flow.astype(np.float32))
    return [g_tables, g_bias, g_weights, np.array([error.sum()])]


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Network:
    """A network from the labelled rows that aren't held out."""
    prepare(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", blank(text).alias("text")).join(F.broadcast(picked), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    there = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    taken = rows.repartition(1).sortWithinPartitions("h", "doc_id").select("text", "quality", "h")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole documents by hash until the bytes are used up; the network comes back in one row."""
        texts, labels, used = [], [], 0
        for b in it:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = x.encode()
                used += len(x)
                if used > SAMPLE_BYTES and texts:
                    continue
                texts.append(x)
                labels.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((train(texts, np.array(labels, np.float64)), sum(labels), len(labels)))], pa.binary())], ["net"])

    got = taken.mapInArrow(run, "net binary").first()
    net, ones, n = pickle.loads(got["net"]) if got else (train([], np.zeros(0)), 0, 0)
    # the sample holds as many of each label as there are, up to SAMPLE; scores are for the labels as they are
    if 0 < ones < n:
        net.base += float(np.log(there[1] / there[0]) - np.log(ones / (n - ones)))
    return net


def score(docs: DataFrame, net: Network, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (by default all but one called out) of docs, and a probability of label 1 for each text."""
    prepare(docs.sparkSession)
    keep = [c for c in docs.columns if c != out] if keep is None else keep
    source = docs.select(*keep, *([] if text in keep else [text]))
    at = source.columns.index(text)
    fields = T.StructType([*source.schema.fields[: len(keep)], T.StructField(out, T.DoubleType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = net.pairs()
        for b in batches(it, 2 << 20, text):
            data, offsets = text_buffer(b.column(at).fill_null(""))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(net.score(data, offsets, pairs))], [*keep, out])

    return source.mapInArrow(run, fields)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Score every document; a third by crc32 is held out from training. See the module for nulls and empty texts."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))
