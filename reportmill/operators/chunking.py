"""Overlapping passages from blocks, each with the headings above it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.operators.walk import walk_groups

CHUNK_SCHEMA = "doc_id string, chunk_id string, chunk_ix int, text string, page int, end_page int, headings array<string>, kind string"
MAX_CHARS, OVERLAP = 1200, 160
#: A sentence: up to and with its closing marks (fixed value). Decimals are cut as well.
SENTENCE = re.compile(r"[^.!?]+[.!?]*")


def tail(text: str, limit: int) -> str:
    """The last ``limit`` characters, from the first whole word on."""
    if limit <= 0 or len(text) <= limit:
        return text if limit > 0 else ""
    end = text[-limit:]
    return end.partition(" ")[2] if " " in end else end


def _pieces(text: str, most: int) -> Iterator[tuple[str, bool]]:
    """Sentences, and the words of those too long; True where a piece must start a part."""
    for sentence in map(str.strip, SENTENCE.findall(text) or [text]):
        if len(sentence) > most:
            for i, word in enumerate(sentence.split()):
                yield word, i == 0
        elif sentence:
            yield sentence, False


def split_prose(text: str, most: int) -> list[str]:
    if len(text) <= most:
        return [text]
    parts: list[str] = []
    for piece, fresh in _pieces(text, most):
        if parts and not fresh and len(parts[-1]) + 1 + len(piece) <= most:
            parts[-1] += f" {piece}"
        else:
            parts.append(piece)
    return parts


def split_table(rows: list[list[str]], most: int) -> list[str]:
    """Parts between rows; each repeats the first row, and holds one more at least."""
    texts = [" | ".join(r) for r in rows]
    if not texts or len("\n".join(texts)) <= most:
        return ["\n".join(texts)] if texts else []
    head, parts = texts[0], []
    for row in texts[1:]:
        if parts and len(parts[-1]) + 1 + len(row) <= most:
            parts[-1] += f"\n{row}"
        else:
            parts.append(f"{head}\n{row}")
    return parts or [head]


def _sections(found: list[dict]) -> Iterator[tuple[int, list[str], dict]]:
    """Each block that is no heading, with the headings above it and the number of its run.

    A run is consecutive paragraphs, or one table; headings stay in force until one of their
    level or above.
    """
    above: list[tuple[int, str]] = []
    run, was = 0, None
    for block in found:
        if block["kind"] == "heading":
            above = [(level, text) for level, text in above if level < block["level"]]
            above.append((block["level"], block["text"]))
        else:
            run += was != "paragraph" or block["kind"] != "paragraph"
            yield run, [text for _, text in above], block
        was = block["kind"]


def _packed(parts: list[tuple[int, str]], most: int, overlap: int) -> list[tuple[int, int, str]]:
    """(page, end_page, text): parts of one run filled up to ``most``, each after the end of the last."""
    out: list[tuple[int, int, str]] = []
    for page, text in parts:
        if out and len(out[-1][2]) + 1 + len(text) <= most:
            out[-1] = (out[-1][0], page, f"{out[-1][2]} {text}")
        else:
            carry = tail(out[-1][2], overlap) if out else ""
            out.append((page, page, f"{carry} {text}" if carry else text))
    return out


def chunk_blocks(found: list[dict], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """Chunks of one document's blocks in reading order: runs under their headings, cut and packed."""
    most = max(1, most)
    overlap = max(0, min(overlap, most - 1))
    made: list[dict] = []
    for _, members in groupby(_sections(found), key=itemgetter(0)):
        run = list(members)
        headings, first = run[0][1], run[0][2]
        if first["kind"] == "table":
            texts = [(first["page"], first["page"], t) for t in split_table([list(r) for r in first["rows"]], most)]
            kind = "table"
        else:
            texts = _packed([(b["page"], part) for _, _, b in run for part in split_prose(b["text"], most)], most, overlap)
            kind = "prose"
        made += [{"text": t.strip(), "page": p, "end_page": e, "headings": headings, "kind": kind} for p, e, t in texts]
    nth: Counter = Counter()
    out = []
    for chunk in made:
        if chunk["text"]:
            nth[chunk["page"]] += 1
            out.append(chunk | {"chunk_id": f"p{chunk['page']}#{nth[chunk['page']]}", "chunk_ix": len(out)})
    return out


def chunks(found: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Passages of every document; a document's blocks are walked in order in one task."""
    rows = found.select("doc_id", "page", "block_ix", "kind", "level", "text", "rows")
    return walk_groups(rows, ["doc_id"], ["page", "block_ix"], partial(chunk_blocks, most=most, overlap=overlap), CHUNK_SCHEMA)


def document_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain texts as one page of paragraph blocks, one for each line that is not blank."""
    line = F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("block_ix", "text")
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.lit(1).alias("page"), line)
    return rows.filter(F.trim("text") != "").select(
        "doc_id", "page", "block_ix", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text", F.lit(None).cast("array<array<string>>").alias("rows")
    )
