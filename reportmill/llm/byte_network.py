"""A text's quality by a convolutional network over its bytes, in numpy.

Filters of :data:`WIDTH` bytes slide over the whole text, each with a weight for every byte at every
place. Their activations are max-pooled over chunks of :data:`CHUNK` bytes, each of which overlaps
the next by half; chunks' vectors are averaged, so that a text's length does not matter, and one
logistic unit makes a probability of the mean. Training takes a bounded sample of labelled texts,
on the driver; the weights (some 70 KB) go to the tasks, and scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

#: Bytes that a filter sees, and number of filters.
WIDTH, FILTERS = 6, 12
#: Bytes of a chunk; chunks start every half of it.
CHUNK = 256
HALF = CHUNK // 2
#: Training takes this many labelled texts of each class at most, and of each text this many
#: stretches of so many characters, spread evenly from its first to its last character.
TEXTS, STRETCHES, STRETCH = 900, 8, 512
EPOCHS, BATCH, RATE, DECAY = 20, 24, 0.01, 1e-4
#: One training text in so many is cut to a random stretch of at most so many bytes in an epoch, as
#: short texts are rare among labelled ones, and what a text is like its stretches are like too.
CUT_ONE_IN, CUT_TO = 3, 384
#: Bytes convolved at a time.
SEGMENT = 1 << 15


@dataclass(frozen=True)
class Network:
    filters: np.ndarray  # float32, WIDTH x 256 x FILTERS
    offsets: np.ndarray  # float32, FILTERS
    weights: np.ndarray  # float64, FILTERS
    bias: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label must not be learnt: crc32 of its id, as text, leaves 2 when divided by 4. A null id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array and where each starts, in halves of chunks.

    Zeros follow each text, at least as many as keep its filters from the next, up to a whole half;
    a text has two halves at least. The array starts with a filter's width of zeros.
    """
    halves = np.array([max(2, -(-(len(t) + WIDTH - 1) // HALF)) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(halves)])
    data = np.zeros(WIDTH - 1 + starts[-1] * HALF, np.uint8)
    for t, s in zip(texts, starts, strict=False):
        data[WIDTH - 1 + s * HALF : WIDTH - 1 + s * HALF + len(t)] = t
    return data, starts


def _convolved(net: Network, data: np.ndarray) -> Iterator[np.ndarray]:
    """Activations by segments, each (halves, HALF, FILTERS). A place sees the bytes up to it."""
    n = len(data) - WIDTH + 1
    for s in range(0, n, SEGMENT):
        size = min(SEGMENT, n - s)
        out = np.repeat(net.offsets[None], size, 0)
        part = np.empty_like(out)
        for j in range(WIDTH):
            np.take(net.filters[j], data[s + j : s + j + size], axis=0, out=part, mode="clip")
            out += part
        yield np.maximum(out, 0, out=out).reshape(-1, HALF, FILTERS)


def _means(halves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The mean over a text's chunks (two adjacent halves each) of what they are pooled to."""
    chunks = np.maximum(halves[:-1], halves[1:]).astype(np.float64)
    ends = starts[1:] - 1
    sums = np.add.reduceat(chunks, np.stack([starts[:-1], ends], 1).ravel()[:-1], axis=0)[::2]
    return sums / (ends - starts[:-1])[:, None]


def scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """A probability for each text, given as arrays of bytes. It depends on that text only."""
    data, starts = _laid_out(texts)
    halves = np.concatenate([a.max(1) for a in _convolved(net, data)])
    return 1 / (1 + np.exp(-((_means(halves, starts) * net.weights).sum(1) + net.bias)))


def _gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    data, starts = _laid_out(texts)
    tops, places = [], []
    for a in _convolved(net, data):
        at = a.argmax(1)
        tops.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
        places.append(at)
    halves, places = np.concatenate(tops), np.concatenate(places)
    places += (np.arange(len(places)) * HALF)[:, None]
    means = _means(halves, starts)
    off = (1 / (1 + np.exp(-(means @ net.weights + net.bias))) - labels) * share
    each = off[:, None] * net.weights / (starts[1:] - 1 - starts[:-1])[:, None]
    by_chunk = np.repeat(each, starts[1:] - starts[:-1], axis=0)[:-1]
    by_chunk[starts[1:-1] - 1] = 0  # a last half and the next text's first are no chunk
    left = halves[:-1] >= halves[1:]
    top = np.maximum(halves[:-1], halves[1:])
    by_chunk = np.where(top > 0, by_chunk, 0).ravel()
    at = np.where(left, places[:-1], places[1:]).ravel()
    which = np.tile(np.arange(FILTERS), len(top))
    filters = np.stack([np.bincount(data[at + j].astype(np.int64) * FILTERS + which, by_chunk, 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
    return [filters, np.bincount(which, by_chunk, FILTERS), off @ means, np.array(off.sum())]


def _cut(texts: list[np.ndarray], rng: np.random.Generator) -> list[np.ndarray]:
    out = []
    for t in texts:
        if len(t) > 24 and rng.integers(CUT_ONE_IN) == 0:
            size = int(rng.integers(24, CUT_TO))
            at = int(rng.integers(max(1, len(t) - size)))
            t = t[at : at + size]
        out.append(t)
    return out


def train(texts: list[bytes], labels: list[int], prior: float, seed: int = 0) -> Network:
    """Fit a network to texts with labels 0 and 1 by Adam; equal input gives equal weights.

    ``prior`` is the share of label 1 among all labelled rows, which the sample's classes are weighed
    by. Without both classes every text gets the prior.
    """
    rng = np.random.default_rng(seed)
    prior = min(max(prior, 0.01), 0.99)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS), float(np.log(prior / (1 - prior))))
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return replace(net, weights=np.zeros(FILTERS))
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    ones = y.mean()
    weigh = np.where(y == 1, prior / ones, (1 - prior) / (1 - ones))
    values = [net.filters.astype(np.float64), net.offsets.astype(np.float64), net.weights, np.array(net.bias)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(arrays))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            step += 1
            for i, g in enumerate(_gradients(net, _cut([arrays[k] for k in some], rng), y[some], weigh[some] / len(some))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                values[i] = values[i] * (1 - rate * DECAY) - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
            net = Network(values[0].astype(np.float32), values[1].astype(np.float32), values[2], float(values[3]))
    return net


def learn(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from the labelled rows that are not held out.

    Of each class the :data:`TEXTS` ids with the least hashes are taken, and of their texts
    :data:`STRETCHES` stretches; of documents that repeat an id so often that there are more than four
    times :data:`TEXTS`, the first ones. So no more than some 15 MB of ASCII come to the driver. Labels
    other than 0 and 1 and rows without an id are left out; an id with both labels counts as both.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").distinct()
    counts = dict(usable.groupBy("quality").count().collect())
    key = [F.xxhash64("doc_id"), "doc_id"]
    zeros, ones = (usable.filter(F.col("quality") == q).orderBy(*key).limit(TEXTS) for q in (0, 1))
    step = F.greatest((F.length("text") - STRETCH) / (STRETCHES - 1), F.lit(0.0))
    longest = STRETCHES * STRETCH
    spread = F.array_join(F.transform(F.array(*map(F.lit, range(STRETCHES))), lambda i: F.substring("text", (i * step).cast("int") + 1, F.lit(STRETCH))), "")
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(zeros.union(ones)), "doc_id")
    sample = sample.select("quality", F.xxhash64("doc_id").alias("at"), "doc_id", F.when(F.length("text") > longest, spread).otherwise(F.col("text")).alias("text"))
    rows = sample.orderBy("at", "doc_id", "quality", "text").limit(4 * TEXTS).collect()
    return train([r["text"].encode() for r in rows], [r["quality"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each text, without copies."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every whole text, a row for each row; null and empty texts are scored as zeros."""
    bound_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, _arrays(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(scored, "doc_id bigint, score double")
