"""Token counts: lengths only, by batch encoding inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WIDE_SPACE, bound_batches, text_or_empty
from .pieces import PieceTable, balanced, sums

#: White space other than blanks, tabs and line ends, by any library's definition.
_ODD = re.compile(rf"[\x0b\x0c\x1c-\x1f\x85\xa0{WIDE_SPACE}]")
#: A piece starts where white space follows something else: no token spans that place.
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Beside odd white space, only a blank or line end after a word character is surely safe.
_SAFE = re.compile(r"(?<=\w)(?=[ \n])")


def pieces(text: str) -> list[str]:
    """Cut a text where byte-level BPE has a token boundary whatever stands around it."""
    if _ODD.search(text):
        return [x for x in _SAFE.split(text) if x]
    return _PIECE.findall(text)


@lru_cache(maxsize=4)
def _table(tokenizer_path: str) -> PieceTable:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path)
    tok.no_truncation()
    tok.no_padding()

    def lengths(new: list[str]) -> list[range]:
        got = tok.encode_batch_fast(new, add_special_tokens=False)
        return [range(len(x.ids)) for x in got]

    return PieceTable(lengths)


def _count(texts: pa.Array, tokenizer_path: str) -> Iterator[np.ndarray]:
    table = _table(tokenizer_path)
    for part in balanced(texts):
        each = [pieces(t) if t else [] for t in part.to_pylist()]
        rows, at = table.codes(pa.array(chain.from_iterable(each), pa.string()))
        yield sums(table.lens[rows][at], np.fromiter(map(len, each), np.int64, len(each)))


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``: the number of tokens of each whole ``text``.

    Without begin, end or added special tokens; special strings inside texts count as the
    library takes them by default. Null and empty texts have 0 tokens. Repeated rows, ties
    and further columns pass through; an existing ``out`` column is replaced. No shuffle:
    each Arrow batch is cut into slices of equal bytes, long texts into pieces at token
    boundaries, and a worker encodes each distinct piece once.
    """
    bound_batches(df.sparkSession)

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = list(_count(texts, tokenizer_path))
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return df.withColumn(out, lengths(text_or_empty(text)))
