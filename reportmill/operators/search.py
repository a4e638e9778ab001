"""Search of one corpus as a reader sees it: keywords and headings at once, vectors once they are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from reportmill.operators import retrieval as R
from reportmill.operators.dense_index import DenseIndex
from reportmill.operators.lexical_index import LexicalIndex


def ensure_lexical(index: LexicalIndex, passages: DataFrame, batch: str) -> int:
    """Index the passages whose keys are in no batch yet, as ``batch``; the number of those. Nothing is written if there are none."""
    new = index.absent(passages)
    n = new.count()
    if n:
        index.add(new, batch)
    return n


def ensure_dense(index: DenseIndex, passages: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> int:
    """Embed and index the passages whose keys are not in the index; the number of those.

    ``embed`` adds a column ``vector``; it only sees new passages, as vectors cost most.
    """
    new = passages.join(index._live().select(index.key), index.key, "left_anti") if index.has("manifest") else passages
    return index.upsert(embed(new).select(index.key, "vector"))


def legs(passages: DataFrame, key: str, order: str, lexical: LexicalIndex | None = None, vectors: DenseIndex | None = None, embed_query: Callable[[DataFrame], DataFrame] | None = None) -> list[R.Strategy]:
    """Strategies for :func:`retrieval.hybrid`: lexical (stored, or by a scan), sections, and dense if there is an index.

    ``embed_query`` adds a column ``vector`` to (query_id, query) rows; a query without one has no
    dense leg. An index that nothing was added to has no passages to search, so these are scanned.
    """
    words: R.Strategy = lexical.search if lexical and lexical.has("manifest") else lambda q, k: R.bm25(passages, q, key, k)
    found = [words, lambda q, k: R.route_sections(passages, q, key, order, k)]
    if vectors is not None and embed_query is not None and vectors.has("manifest"):
        found.append(lambda q, k: vectors.search(embed_query(q).filter("vector IS NOT NULL").select("query_id", "vector"), k))
    return found
