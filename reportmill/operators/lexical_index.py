"""A stored inverted index for BM25, with exact search that skips blocks of passages.

On disk, below one path:

* ``postings``: a row for each term and block of passages, with the passages' keys, frequencies and
  lengths as arrays, the largest frequency and the least length. Rows lie in folders by segment and
  by hash of the term, sorted by term and block, so a search reads its terms' folders only, and of
  these the row groups that hold its terms.
* ``docs``: key, length and block of each passage.
* ``manifest``: a row for each segment and scope with its number of passages and words. A segment
  counts once it is in here, so a build that fails leaves nothing behind but files nobody reads.
* ``index``: the number of term buckets, the names of the columns and the schema of postings.

A batch of passages is one segment. More batches add segments without touching older ones: idf and
the mean length come from the manifest and the postings when a search runs. Putting a batch again
replaces it, so a job may be repeated.

Passages of like length share a block, as this makes a block's bound tight: no passage in it scores
more than its largest frequency would in its shortest passage. A search scores each query's most
promising blocks first; the score of its last hit there is a bound below which other blocks are
left out, unread but for their bounds.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from reportmill.functions import text as T
from reportmill.operators import retrieval as R
from reportmill.shared import new_folder
from reportmill.shipping import ship
from reportmill.sources.segments import Segments

#: Passages of a block are at most 2 to this.
BLOCK_BITS = 6
BUCKETS = 64
#: Scores are rounded to nine places; bounds get this much on top.
SLACK = 1e-8
#: Postings that a task writes, about.
POSTINGS_A_TASK = 2_000_000
#: Passages that a task counts or inverts at once, and raw words whose terms it remembers.
ROWS, MOST_KNOWN = 512, 500_000


def _counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(scope, key, len, terms) of each passage: its distinct terms with their numbers, without a shuffle.

    The same terms as :func:`functions.text.tokenize` finds; a raw word is judged once a task.
    """
    ship(rows.sparkSession)
    kind = ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())]))
    schema = StructType([StructField("scope", rows.schema["scope"].dataType), StructField(key, rows.schema[key].dataType), StructField("len", LongType()), StructField("terms", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = re.compile(T.TOKEN, re.ASCII).findall, {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                terms, tfs, ends, lens = [], [], [0], []
                for low in batch.column("_low").to_pylist():
                    own: dict[str, int] = {}
                    for raw, n in Counter(words(low or "")).items():
                        term = known.get(raw)
                        if term is None:
                            if len(known) >= MOST_KNOWN:
                                known.clear()
                            term = known[raw] = T.plain_term(raw)
                        if term:
                            own[term] = own.get(term, 0) + n
                    terms += own
                    tfs += own.values()
                    ends.append(len(terms))
                    lens.append(sum(own.values()))
                pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
                each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column(key), pa.array(lens, pa.int64()), each], ["scope", key, "len", "terms"])

    low = F.lower(R.passage_text(rows, text)).alias("_low")
    return rows.select("scope", key, low).mapInArrow(run, schema)


def _inverted(placed: DataFrame, key: str) -> DataFrame:
    """(scope, term, block, hits, max_tf, min_len, n) from passages that lie in order of scope and block, without a shuffle.

    A block whose passages fall to two tasks has two rows for a term, whose bounds and hits add up.
    """
    ship(placed.sparkSession)
    one = StructType([StructField("key", placed.schema[key].dataType), StructField("tf", LongType()), StructField("len", LongType())])
    schema = StructType([StructField("scope", placed.schema["scope"].dataType), StructField("term", StringType())])
    for name, kind in (("block", LongType()), ("hits", ArrayType(one)), ("max_tf", LongType()), ("min_len", LongType()), ("n", LongType())):
        schema = schema.add(name, kind)

    def of(rows: pa.Table) -> pa.RecordBatch:
        block, length, keys, scopes, lists = (rows.column(c).combine_chunks() for c in ("block", "len", key, "scope", "terms"))
        shown = scopes.to_pylist()
        block, length = block.to_numpy(), length.to_numpy()
        new = np.array([True, *(block[i] != block[i - 1] or shown[i] != shown[i - 1] for i in range(1, len(block)))])
        run_of = np.cumsum(new)
        flat = pc.list_flatten(lists)
        doc = pc.list_parent_indices(lists).to_numpy()
        terms = flat.field("term").dictionary_encode()
        code, tf = terms.indices.to_numpy(), flat.field("tf").to_numpy()
        by_key = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="first").to_numpy()
        order = np.lexsort((by_key[doc], code, run_of[doc]))
        doc, code, tf = doc[order], code[order], tf[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (code[1:] != code[:-1]) | (run_of[doc[1:]] != run_of[doc[:-1]]))))
        ends = np.append(starts, len(doc))
        hits = pa.StructArray.from_arrays([keys.take(pa.array(doc)), pa.array(tf), pa.array(length[doc])], ["key", "tf", "len"])
        first = pa.array(doc[starts])
        columns = [scopes.take(first), terms.dictionary.take(pa.array(code[starts])), pa.array(block[doc[starts]]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)]
        most, least = (f.reduceat(x, starts) if len(starts) else x[:0] for f, x in ((np.maximum, tf), (np.minimum, length[doc])))
        return pa.RecordBatch.from_arrays([*columns, pa.array(most), pa.array(least), pa.array(np.diff(ends))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                rows = pa.Table.from_batches([whole.slice(start, ROWS)])
                rows = rows if rest is None else pa.concat_tables([rest, rows])
                block = rows.column("block").to_numpy()
                cut = int(np.flatnonzero(block != block[-1])[-1]) + 1 if block[0] != block[-1] else 0
                if cut:
                    yield of(rows.slice(0, cut))
                rest = rows.slice(cut)
        if rest is not None:
            yield of(rest)

    return placed.select("scope", key, "len", "block", "terms").mapInArrow(run, schema)


class LexicalIndex(Segments):
    """See the module. ``scope`` columns separate statistics, as in :func:`retrieval.bm25`; their nulls are a scope."""

    def __init__(self, spark: SparkSession, path: str, key: str, scope: Sequence[str] = (), buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.key, self.scope, self._buckets = key, list(scope), buckets

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        about = spark.read.parquet(f"{path.rstrip('/')}/index").first()
        return cls(spark, path, about["key"], list(about["scope"]), about["buckets"])

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self._buckets)).cast("int")

    def _scope(self) -> Column:
        """The scope as one value, which equals itself where parts of it are null."""
        return F.struct(F.lit(0).alias("_"), *self.scope).alias("scope")

    def add(self, passages: DataFrame, batch: str, text: str = "text") -> str:
        """Index (key, scope, text, headings) rows as one batch, in place of an earlier one of that name.

        Keys are distinct over all batches; :meth:`absent` keeps those that are new. Null texts
        have no words and count as passages. Returns the segment's name.
        """
        segment = self.new_name()
        counted = _counted(passages.withColumn("scope", self._scope()), self.key, text)
        ordered = counted.repartitionByRange("scope", "len", self.key).sortWithinPartitions("scope", "len", self.key)
        placed = self._written(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
        placed.drop("terms").write.parquet(self.folder("docs", segment))
        totals = placed.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("words"))
        blocks = _inverted(placed, self.key).withColumn("bucket", self._bucket(F.col("term")))
        order = ["bucket", "term", "scope", "block"]
        parts = max(1, -(-(placed.agg(F.sum("len")).first()[0] or 0) // POSTINGS_A_TASK))
        blocks = blocks.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        blocks.write.partitionBy("bucket").parquet(self.folder("postings", segment))
        stored = StructType([*blocks.drop("bucket").schema, StructField("segment", StringType()), StructField("bucket", IntegerType())])
        self.create("index", self.spark.createDataFrame([(self.key, self.scope, self._buckets, stored.json())], "key string, scope array<string>, buckets int, postings string"))
        self.commit(batch, segment, totals.select("scope", "n", "words"))
        return segment

    def docs(self) -> DataFrame:
        """(scope, key, len, block, segment) of all passages."""
        return self.table("docs").filter(F.col("segment").isin(self.names()))

    def absent(self, passages: DataFrame) -> DataFrame:
        """Passages whose key is in no batch yet."""
        return passages.join(self.docs().select(self.key), self.key, "left_anti") if self.has("manifest") else passages

    def _written(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "search")
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def _read(self, wanted: DataFrame) -> DataFrame:
        """Postings in the folders of some terms; a number for each bucket at most is collected for it."""
        buckets = [r[0] for r in wanted.select(self._bucket(F.col("term"))).distinct().collect()]
        schema = json.loads(self.table("index").first()["postings"])
        rows = self.spark.read.schema(StructType.fromJson(schema)).parquet(f"{self.path}/postings")
        return rows.filter(F.col("segment").isin(self.names()) & F.col("bucket").isin(buckets))

    def _weights(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """(query_id, scope, term, weight, df, total, mean) of the queries' terms, over all segments."""
        df = rows.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("scope", "term").agg(F.sum("n").alias("df"))
        totals = self.manifest().groupBy("scope").agg(F.sum("n").alias("total"), (F.sum("words") / F.sum("n")).alias("mean"))
        return self._written(df.join(totals, "scope").join(wanted, "term"))

    @staticmethod
    def _bounds(rows: DataFrame, weights: DataFrame) -> DataFrame:
        """(query_id, scope, segment, block, bound), no passage of which scores more for that query; reads no arrays."""
        best = R.term_score(F.col("total"), F.col("df"), F.col("max_tf"), F.col("min_len"), F.col("mean")) * F.col("weight")
        each = rows.select("scope", "segment", "term", "block", "max_tf", "min_len").join(weights, ["scope", "term"])
        return each.groupBy("query_id", "scope", "segment", "block").agg((F.sum(best) + SLACK).alias("bound"))

    def _scored(self, rows: DataFrame, weights: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, scope, key, score) of the passages of given (query_id, scope, segment, block) rows."""
        asked = rows.select("scope", "segment", "term", "block", "hits").join(weights, ["scope", "term"])
        asked = asked.join(blocks.select("query_id", "scope", "segment", "block"), ["query_id", "scope", "segment", "block"])
        each = asked.select("query_id", "scope", "weight", "df", "total", "mean", F.inline("hits"))
        s = R.term_score(F.col("total"), F.col("df"), F.col("tf"), F.col("len"), F.col("mean")) * F.col("weight")
        return each.groupBy("query_id", "scope", F.col("key").alias(self.key)).agg(F.round(F.sum(s), 9).alias("score")).filter("score > 0")

    def _judged(self, rows: DataFrame, weights: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
        """Scores in each query's first blocks, and all blocks with ``seed`` and ``needed``.

        A block holds a hit at least, so the ``limit`` blocks of highest bound hold ``limit`` hits,
        if there are so many.
        """
        by = Window.partitionBy("query_id", "scope").orderBy(F.desc("bound"), "segment", "block")
        bounds = self._written(self._bounds(rows, weights))
        seeds = bounds.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= limit)
        first = self._written(R.ranked(self._scored(rows, weights, seeds), self.key, limit, ["query_id", "scope"]))
        least = first.filter(F.col("rank") == limit).select("query_id", "scope", F.col("score").alias("least"))
        marked = seeds.select("query_id", "scope", "segment", "block", F.lit(True).alias("seed"))
        judged = bounds.join(least, ["query_id", "scope"], "left").join(marked, ["query_id", "scope", "segment", "block"], "left")
        needed = F.col("seed").isNull() & (F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return first, judged.withColumn("needed", needed)

    def search(self, queries: DataFrame, limit: int = R.DEFAULT_LIMIT) -> DataFrame:
        """(query_id, scope columns, key, score, rank): the same hits as :func:`retrieval.bm25`.

        Blocks with a bound below the last score among a query's first blocks are skipped; a bound
        equal to it is not, as ties go to the smaller key. Weights of terms, bounds and first hits
        are written to the shared folder on the way.
        """
        wanted = R.query_terms(queries)
        rows = self._read(wanted)
        weights = self._weights(rows, wanted)
        first, judged = self._judged(rows, weights, limit)
        hits = first.drop("rank").unionByName(self._scored(rows, weights, judged.filter("needed")))
        out = R.ranked(hits, self.key, limit, ["query_id", "scope"])
        return out.select("query_id", *(F.col(f"scope.{c}").alias(c) for c in self.scope), self.key, "score", "rank")

    def effort(self, queries: DataFrame, limit: int = R.DEFAULT_LIMIT) -> DataFrame:
        """(query_id, blocks, scored): blocks that have a term of the query, and those that its search scores."""
        wanted = R.query_terms(queries)
        rows = self._read(wanted)
        _, judged = self._judged(rows, self._weights(rows, wanted), limit)
        return judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("seed") | F.col("needed")).alias("scored"))
