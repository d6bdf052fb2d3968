"""Splits text into overlapping chunks on sentence bounds.

A text of at most max words is one chunk. Otherwise sentences are packed greedily; a sentence above
max is cut into windows; a chunk begins with the last overlap words of the one before; a last chunk
below min joins the one before, without the words that both have.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import chunk_id, strip_frontmatter, words
from lorekeep.schema import Chunking

_FENCE = "```"
_END = re.compile(r"(?<=[.!?]) ")


def _paragraphs(text: str) -> Iterator[tuple[bool, list[str]]]:
    """(is a code block, its lines) in order; blank lines and fences part paragraphs."""
    lines: list[str] = []
    fenced = False
    for line in text.replace("\r\n", "\n").split("\n"):
        edge = line.strip().startswith(_FENCE)
        if edge and not fenced:
            yield False, lines
            lines, fenced = [line], True
        elif edge:
            yield True, [*lines, line]
            lines, fenced = [], False
        elif fenced or line.strip():
            lines.append(line)
        else:
            yield False, lines
            lines = []
    yield fenced, lines


def split_sentences(text: str) -> list[str]:
    """Sentences end at ``. ! ?`` before a space or at a paragraph's end; code blocks stay whole."""
    out: list[str] = []
    for fenced, lines in _paragraphs(text):
        if fenced:
            block = "\n".join(lines)
            closed = len(lines) > 1 and lines[-1].strip().startswith(_FENCE)
            out.append(block if closed else block.strip())
            continue
        open_ = ""
        for line in lines:
            *whole, rest = _END.split(line)
            for part in whole:
                out.append((open_ + part).strip())
                open_ = ""
            open_ += rest
            if open_ and not open_.endswith(" "):
                open_ += " "
        out.append(open_.strip())
    return [s for s in out if s]


def plan(counts: list[int], size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Chunks over sentences of so many words: (first sentence, end, words carried from the chunk before, 0), and for
    windows of a long sentence (sentence, sentence, first word, end).

    With the words before each sentence known, a chunk's end is found by bisection: it takes all sentences that fit
    with what is carried, and one at least.
    """
    before = [0, *accumulate(counts)]
    chunks: list[tuple[int, int, int, int]] = []
    at, carried = 0, 0
    while at < len(counts):
        if counts[at] > size:
            step = max(size - overlap, 1)
            starts = range(0, max(counts[at] - size, 0) + step, step)
            chunks += [(at, at, i, i + size) for i in starts if i == 0 or i - step + size < counts[at]]
            at, carried = at + 1, 0
            continue
        end = max(bisect_right(before, before[at] + size - carried) - 1, at + 1)
        end = next((k for k in range(at + 1, end) if counts[k] > size), end)
        chunks.append((at, end, carried, 0))
        carried = min(overlap, carried + before[end] - before[at])
        at = end
    return chunks


def shared_words(before: list[str], after: list[str], most: int) -> int:
    """How many words the end of one and the start of the other share, at most ``most``."""
    return next((n for n in range(min(len(before), len(after), most), 0, -1) if before[-n:] == after[:n]), 0)


def split_text(text: str, rule: Chunking = Chunking()) -> list[str]:  # noqa: B008
    every = text.split()
    if len(every) <= rule.max_tokens:
        return [" ".join(every)] if every else []
    sentences = split_sentences(text)
    of_sentence = [s.split() for s in sentences]
    chunks: list[str] = []
    for first, end, low, high in plan([len(ws) for ws in of_sentence], rule.max_tokens, rule.overlap_tokens):
        if first == end:
            chunks.append(" ".join(of_sentence[first][low:high]))
        else:
            carried = chunks[-1].split()[-low:] if low else []
            chunks.append(" ".join([*carried, *sentences[first:end]]).strip())
    if len(chunks) > 1 and len(tail := chunks[-1].split()) < rule.min_tokens:
        chunks.pop()
        own = tail[shared_words(chunks[-1].split(), tail, rule.overlap_tokens) :]
        chunks[-1] = " ".join([chunks[-1], *own])
    return chunks


def chunk_entries(entries: DataFrame, rule: Chunking = Chunking()) -> DataFrame:  # noqa: B008
    """entries -> chunk_id, entry_id, chunk_index, kind, tags, text; an empty body is one empty chunk.

    Only texts of more than one chunk are sent to Python.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_text(t, rule))

    # step by step, so that no step's result is worked out once for each use
    found = entries.select("id", "kind", "tags", strip_frontmatter(F.coalesce("body", F.lit(""))).alias("body")).withColumn("words", words(F.col("body")))
    found = found.withColumn("one", F.when(F.size("words") <= rule.max_tokens, F.array(F.array_join("words", " "))))
    found = found.withColumn("several", split(F.when(F.col("one").isNull(), F.col("body"))))
    return found.select("id", "kind", "tags", F.posexplode(F.coalesce("one", "several")).alias("chunk_index", "text")).select(
        chunk_id(F.col("id"), F.col("chunk_index")).alias("chunk_id"), F.col("id").alias("entry_id"), "chunk_index", "kind", "tags", "text"
    )
