"""Hamming self-join of fingerprints by a binary trie, traversed as pairs of nodes.

The trie's upper nodes are cut into blocks of bounded size: a node with more rows than a block
may hold is opened, and its children take its place. Pairs of nodes go down from the root
together; the bits in which their prefixes differ are summed, and a pair over the budget is
dropped with all that hangs below it. What is left is pairs of blocks, one task row each. Inside
a task both blocks' tries are traversed the same way, level by level, in slices of bounded size,
down to nodes of few values, which are compared value by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

#: Levels that are opened before any block is closed, and at each further opening.
FIRST_LEVELS, MORE_LEVELS = 4, 2
#: Rows of a block. Pairs of nodes or values that are looked at together.
MOST_ROWS, PART = 1 << 20, 1 << 19
#: Pairs of values from which a pair of nodes is not worth another level.
FEW = 16
#: Rows up to which a table of nodes or node pairs is broadcast (about 50 bytes each).
MOST_BROADCAST = 200_000


def smallest_linked(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[one], root[other])
        new = root.copy()
        np.minimum.at(new, root[one], least)
        np.minimum.at(new, root[other], least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


class _Trie:
    """Levels of the trie over sorted distinct values, whose highest bit is bit 63."""

    def __init__(self, values: np.ndarray, depth: int):
        self.values = values
        self._starts = {depth: self._first(depth)}
        self._children: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _first(self, depth: int) -> np.ndarray:
        prefix = self.values >> np.uint64(64 - depth) if depth else np.zeros(len(self.values), np.uint64)
        return np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))

    def starts(self, depth: int) -> np.ndarray:
        """First value of each node of a level."""
        if depth not in self._starts:
            self._starts[depth] = self._first(depth)
        return self._starts[depth]

    def ends(self, depth: int) -> np.ndarray:
        return np.append(self.starts(depth)[1:], len(self.values))

    def children(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the next level below each node by bit 0 and bit 1, or -1."""
        if depth not in self._children:
            here, below = self.starts(depth), self.starts(depth + 1)
            first = np.searchsorted(below, here)
            last = np.append(first[1:], len(below)) - 1
            bit = (self.values[below] >> np.uint64(63 - depth) & np.uint64(1)).astype(bool)
            self._children[depth] = np.where(bit[first], -1, first), np.where(bit[last], last, -1)
        return self._children[depth]


def _close_nodes(a: _Trie, b: _Trie, same: bool, depth: int, bits: int, budget: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first, end) of nodes of a and b that hold few values, within the budget so far.

    Each block is one node at ``depth``. With ``same``, b is a, and of two nodes only one order comes. Goes depth first over slices
    of the frontier, so that memory is bounded by the levels.
    """
    begun = np.bitwise_count((a.values[:1] ^ b.values[:1]) >> np.uint64(64 - depth)) if depth else np.zeros(1, np.uint8)
    todo = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), begun)] if begun[0] <= budget else []
    while todo:
        d, one, other, spent = todo.pop()
        if len(one) > PART:
            todo += [(d, one[i : i + PART], other[i : i + PART], spent[i : i + PART]) for i in range(0, len(one), PART)]
            continue
        ax, ay, bx, by = a.starts(d)[one], a.ends(d)[one], b.starts(d)[other], b.ends(d)[other]
        few = ((ay - ax) * (by - bx) <= FEW) | (d == bits)
        if few.any():
            yield ax[few], ay[few], bx[few], by[few]
        one, other, spent = one[~few], other[~few], spent[~few]
        if not len(one):
            continue
        (a0, a1), (b0, b1) = a.children(d), b.children(d)
        x0, x1, y0, y1 = a0[one], a1[one], b0[other], b1[other]
        apart = one != other if same else np.ones(len(one), bool)
        steps = [(x0, y0, spent), (x1, y1, spent), (x0, y1, spent + 1), (x1[apart], y0[apart], spent[apart] + 1)]
        one, other, spent = (np.concatenate(x) for x in zip(*steps, strict=True))
        keep = (one >= 0) & (other >= 0) & (spent <= budget)
        todo.append((d + 1, one[keep], other[keep], spent[keep]))


def _spread(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places of the ranges [ax, ay) with all of [bx, by), in parts of bounded size."""
    wide = by - bx
    n = (ay - ax) * wide
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, PART):
        hi = min(lo + PART, total)
        first, last = np.searchsorted(ends, [lo, hi - 1], "right")
        which = np.repeat(np.arange(first, last + 1), np.minimum(ends[first : last + 1], hi) - np.maximum(ends[first : last + 1] - n[first : last + 1], lo))
        k = np.arange(lo, hi) - (ends[which] - n[which])
        row = k // wide[which]
        yield ax[which] + row, bx[which] + k - row * wide[which]


class Block:
    """Rows of one block, as packed by :func:`_pack`: value, node, class and check words, by value."""

    def __init__(self, data: bytes, bits: int, checks: int, own_node: bool, classed: bool = False):
        kind = np.dtype("<u4" if bits <= 32 else "<u8")
        width = kind.itemsize + 8 * own_node + 8 * classed + 8 * checks
        n = len(data) // width
        value = np.frombuffer(data, kind, n).astype(np.uint64)
        at = n * kind.itemsize
        self.node = np.frombuffer(data, np.int64, n, at) if own_node else value.view(np.int64)
        at += 8 * n * own_node
        self.of = np.frombuffer(data, np.int64, n, at) if classed else None
        at += 8 * n * classed
        self.check = np.frombuffer(data, np.uint64, n * checks, at).reshape(checks, n)
        left = value << np.uint64(64 - bits)
        new = np.concatenate(([True], left[1:] != left[:-1])) if n else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], n)
        self.values = left[self.first]


def close_rows(a: Block, b: Block, same: bool, depth: int, bits: int, budget: int, most: int | None = None, tries_before: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of a and b whose values differ in at most ``budget`` bits, in parts.

    With ``most``, their check words differ in at most so many bits as well. Rows of one class
    are left out. With ``same``, b is a, and each pair of different rows comes once. Pairs that are
    close in one of ``tries_before`` tries are left out too, whose values are the check words, cut
    into ``bits`` bits from the lowest.
    """
    if not len(a.values) or not len(b.values):
        return
    one = _Trie(a.values, depth)
    other = one if same else _Trie(b.values, depth)
    for ranges in _close_nodes(one, other, same, depth, bits, budget):
        for i, j in _spread(*ranges):
            near = np.bitwise_count(a.values[i] ^ b.values[j]) <= budget
            if same:
                near &= i <= j
            i, j = i[near], j[near]
            for x, y in _spread(a.first[i], a.end[i], b.first[j], b.end[j]):
                keep = x < y if same else np.ones(len(x), bool)
                if a.of is not None:
                    keep &= a.of[x] != b.of[y]
                    x, y, keep = x[keep], y[keep], keep[keep]
                if most is not None and len(a.check):
                    keep &= sum(np.bitwise_count(p[x] ^ q[y]).astype(np.int16) for p, q in zip(a.check, b.check, strict=True)) <= most
                for t in range(tries_before):
                    x, y, keep = x[keep], y[keep], keep[keep]
                    word, low = divmod(t * bits, 64)
                    apart = (a.check[word][x] ^ b.check[word][y]) >> np.uint64(low) & np.uint64((1 << bits) - 1)
                    keep &= np.bitwise_count(apart) > budget
                if keep.any():
                    yield x[keep], y[keep]


def _edges(rows: Iterator[pa.RecordBatch], bits: int, budget: int, checks: int, own_node: bool, classed: bool, most: int | None, spanning: bool, once: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in range(batch.num_rows):
            same, depth, trie = batch["same"][r].as_py(), batch["depth"][r].as_py(), int(batch["trie"][r].as_py())
            a = Block(batch["one"][r].as_py(), bits, checks, own_node, classed)
            b = a if same else Block(batch["other"][r].as_py(), bits, checks, own_node, classed)
            shift = 0 if same else len(a.node)
            node = a.node if same else np.concatenate([a.node, b.node])
            root = np.arange(len(node))
            for x, y in close_rows(a, b, same, depth, bits, budget, most, trie if once else 0):
                y = y + shift
                if spanning:
                    apart = root[x] != root[y]
                    if apart.any():
                        root = root[smallest_linked(len(node), np.append(root[x[apart]], root), np.append(root[y[apart]], np.arange(len(root))))]
                else:
                    yield _pairs(node[x], node[y])
            if spanning:
                moved = np.flatnonzero(root != np.arange(len(node)))
                yield _pairs(node[moved], node[root[moved]])


def _pairs(one: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other), pa.int64()), pa.array(np.maximum(one, other), pa.int64())], ["a", "b"])


def _pack(batches: Iterator[pa.RecordBatch], bits: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and value -> one row a block, its columns laid end to end."""
    kind = np.dtype("<u4" if bits <= 32 else "<u8")
    held: list[pa.RecordBatch] = []
    now = None

    def packed() -> Iterator[pa.RecordBatch]:
        if held:
            columns = [np.concatenate([b["value"].to_numpy().astype(kind) for b in held])]
            for name in names:
                columns.append(np.concatenate([b[name].to_numpy() for b in held]))
            data = b"".join(x.tobytes() for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([data], pa.binary())], ["block", "data"])
            held.clear()

    for batch in batches:
        ids = batch["block"].dictionary_encode()
        code = ids.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x < y:
                name = ids.dictionary[int(code[x])].as_py()
                if name != now:
                    yield from packed()
                    now = name
                held.append(batch.slice(x, y - x))
    yield from packed()


def _prefix(value: Column, bits: int, depth: int) -> Column:
    return F.shiftrightunsigned(value, bits - depth) if 0 < depth < bits else F.lit(0).cast("long") if depth == 0 else value


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what a count shows to be small; the rest is shuffled."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _below(values: DataFrame, nodes: DataFrame, bits: int, depth: int) -> DataFrame:
    """Rows whose node at that depth is one of ``nodes``."""
    here = _small(nodes.select(F.col("trie").alias("_trie"), F.col("prefix").alias("_prefix")))
    return values.join(here, (F.col("trie") == F.col("_trie")) & (_prefix(F.col("value"), bits, depth) == F.col("_prefix")), "left_semi")


def _near_prefixes(budget: int) -> Column:
    """Whether the common length of both prefixes differs within the budget."""
    short = [F.expr(f"shiftrightunsigned(prefix_{i}, depth_{i} - least(depth_1, depth_2))") for i in (1, 2)]
    return F.bit_count(short[0].bitwiseXOR(short[1])) <= budget


def _children(pairs: DataFrame, below: DataFrame, depth: int, further: int, budget: int) -> DataFrame:
    """Node pairs after the opened nodes (``up``) of one depth gave way to their children (``down``)."""
    for i in (1, 2):
        here = _small(below.select(F.col("trie").alias("_trie"), F.col("up").alias("_up"), F.col("down").alias(f"_down_{i}")))
        fits = (F.col("trie") == F.col("_trie")) & (F.col(f"depth_{i}") == depth) & (F.col(f"prefix_{i}") == F.col("_up"))
        pairs = pairs.join(here, fits, "left").drop("_trie", "_up")
    one_node = (F.col("depth_1") == F.col("depth_2")) & (F.col("prefix_1") == F.col("prefix_2"))
    once = ~one_node | F.col("_down_1").isNull() | (F.col("_down_1") <= F.col("_down_2"))
    moved = []
    for i in (1, 2):
        down = F.col(f"_down_{i}")
        moved += [F.when(down.isNotNull(), further).otherwise(F.col(f"depth_{i}")).alias(f"depth_{i}"), F.coalesce(down, F.col(f"prefix_{i}")).alias(f"prefix_{i}")]
    return cut(pairs.filter(once).select("trie", *moved).filter(_near_prefixes(budget)))


def close(
    values: DataFrame, bits: int, budget: int, checks: int = 0, most: int | None = None, spanning: bool = True, most_rows: int = MOST_ROWS, first: int = FIRST_LEVELS, once: bool = False
) -> DataFrame:
    """(trie, value, ...) rows -> (a, b): rows of one trie within ``budget`` differing bits.

    ``value`` has the low ``bits`` bits of a bigint. ``node`` names a row, and is the value itself
    where there is no such column; ``c0``, ... are ``checks`` further words, of which pairs may
    differ in at most ``most`` bits. Rows with equal ``of``, where there is that column, are of one
    class already and make no pair. Gives edges that span every class of a pair of blocks, or,
    without ``spanning``, every pair once for each trie. With ``once`` it comes in the first trie
    only in which it is close: tries are numbered from 0 then, and their values are the check words,
    cut into ``bits`` bits from the lowest. A value with more rows than a block may hold is dealt
    into several blocks, which meet each other.
    """
    bound_batches(values.sparkSession)
    own_node, classed = "node" in values.columns, "of" in values.columns
    name = "node" if own_node else "value"

    def level(rows: DataFrame, depth: int) -> DataFrame:
        return cut(rows.groupBy("trie", _prefix(F.col("value"), bits, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))

    depth = min(first, bits)
    nodes = level(values, depth)
    one, other = (nodes.select("trie", F.lit(depth).alias(f"depth_{i}"), F.col("prefix").alias(f"prefix_{i}")) for i in (1, 2))
    # a trie has 2**first nodes here at most
    pairs = one.join(other, "trie").filter((F.col("prefix_1") <= F.col("prefix_2")) & _near_prefixes(budget))
    rows = values.withColumn("depth", F.lit(depth))
    while depth < bits:
        opened = nodes.filter(F.col("n") > most_rows).select("trie", "prefix")
        if opened.isEmpty():
            break
        further = min(depth + MORE_LEVELS, bits)
        nodes = level(_below(values, opened, bits, depth), further)
        below = nodes.select("trie", F.shiftrightunsigned("prefix", further - depth).alias("up"), F.col("prefix").alias("down"))
        pairs = _children(pairs, below, depth, further, budget)
        here = _small(opened.select(F.col("trie").alias("_trie"), F.col("prefix").alias("_prefix"), F.lit(further).alias("_further")))
        inside = (F.col("trie") == F.col("_trie")) & (F.col("depth") == depth) & (_prefix(F.col("value"), bits, depth) == F.col("_prefix"))
        rows = rows.join(here, inside, "left").withColumn("depth", F.coalesce("_further", "depth")).drop("_trie", "_prefix", "_further")
        depth = further

    at = F.when(F.col("depth") == 0, 0).otherwise(F.expr(f"shiftrightunsigned(value, {bits} - depth)"))
    rows = rows.withColumn("block", F.concat_ws(":", "trie", "depth", at))
    pairs = pairs.select(*(F.concat_ws(":", "trie", f"depth_{i}", f"prefix_{i}").alias(f"block_{i}") for i in (1, 2)), F.least("depth_1", "depth_2").alias("depth"))
    crowded = nodes.filter(F.col("n") > most_rows) if depth == bits else nodes.limit(0)
    if not crowded.isEmpty():
        k = F.ceil(F.col("n") / most_rows).cast("int")
        parts = _small(cut(crowded.select(F.concat_ws(":", "trie", F.lit(bits), "prefix").alias("_block"), k.alias("_k"))))
        part = F.when(F.col("_k").isNull(), "").otherwise(F.concat(F.lit(":"), F.pmod(F.xxhash64(name), F.col("_k"))))
        rows = rows.join(parts, F.col("block") == F.col("_block"), "left").withColumn("block", F.concat("block", part)).drop("_block", "_k")
        for i in (1, 2):
            each = F.when(F.col("_k").isNull(), F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: F.concat(F.lit(":"), x)))
            pairs = pairs.join(parts, F.col(f"block_{i}") == F.col("_block"), "left").withColumn(f"part_{i}", F.explode(each)).drop("_block", "_k")
        ordered = (F.col("block_1") != F.col("block_2")) | (F.col("part_1") <= F.col("part_2"))
        pairs = pairs.filter(ordered).select("depth", *(F.concat(f"block_{i}", f"part_{i}").alias(f"block_{i}") for i in (1, 2)))

    names = [*(["node"] if own_node else []), *(["of"] if classed else []), *(f"c{i}" for i in range(checks))]
    sorted_rows = rows.select("block", "value", *names).repartition("block").sortWithinPartitions("block", "value")
    packed = cut(sorted_rows.mapInArrow(lambda b: _pack(b, bits, names), "block string, data binary"))
    pairs = cut(pairs)
    depths = _small(pairs.filter("block_1 = block_2").select(F.col("block_1").alias("block"), "depth"))
    trie = F.substring_index("block", ":", 1).alias("trie")
    tasks = packed.join(depths, "block").select(F.lit(True).alias("same"), "depth", trie, F.col("data").alias("one"), F.lit(None).cast("binary").alias("other"))
    apart = pairs.filter("block_1 <> block_2")
    if not apart.isEmpty():
        left = packed.select(F.col("block").alias("block_1"), F.col("data").alias("one")).join(_small(apart), "block_1")
        both = left.join(packed.select(F.col("block").alias("block_2"), F.col("data").alias("other")), "block_2")
        tasks = tasks.unionByName(both.select(F.lit(False).alias("same"), "depth", F.substring_index("block_1", ":", 1).alias("trie"), "one", "other"))
    return tasks.mapInArrow(lambda b: _edges(b, bits, budget, checks, own_node, classed, most, spanning, once), "a bigint, b bigint")
