"""Splitting oversized items at natural boundaries (problem 4).

Method: recursive separator hierarchy. Boundaries are ranked paragraph, line, sentence, word; a piece is packed
greedily up to the limit and cut at the last boundary of the best rank in the upper part of its range, or at the
character limit where there is none; the next piece starts within the trailing overlap, at a word start if one
is there.

Defined results: null texts and texts within the limit give no pieces from `pieces_of_long_texts`; texts of any
length are cut whole in one pass; repeated rows give equal rows, made distinct; offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import spread

_GAP = re.compile(r"[ \t\r\n]+")
PLAIN, SENTENCE, LINE, PARAGRAPH = range(4)


def boundaries(text: str) -> list[list[int]]:
    """Word starts of a text by rank: plain, sentence, line, paragraph; each list ascends."""
    ranked: list[list[int]] = [[], [], [], []]
    for gap in _GAP.finditer(text):
        start, end = gap.span()
        if end == len(text):
            continue
        feeds = text.count("\n", start, end)
        if feeds:
            ranked[PARAGRAPH if feeds > 1 else LINE].append(end)
        else:
            ranked[SENTENCE if start and text[start - 1] in ".!?" else PLAIN].append(end)
    return ranked


def pieces(text: str, limit: int = 1200, least: int = 600, overlap: int = 120) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece if it is within the limit."""
    if not 0 <= overlap <= least < limit:
        raise ValueError("0 <= overlap <= least < limit must hold")
    ranked = boundaries(text)
    every = sorted(x for rank in ranked for x in rank)
    out, start = [], 0
    while len(text) - start > limit:
        end = start + limit
        for rank in (PARAGRAPH, LINE, SENTENCE, PLAIN):
            at = bisect_right(ranked[rank], start + limit)
            if at and ranked[rank][at - 1] > start + least:
                end = ranked[rank][at - 1]
                break
        out.append((start, end))
        at = bisect_left(every, end - overlap)
        start = every[at] if at < len(every) and every[at] < end else end - overlap
    return [*out, (start, len(text))]


def pieces_of_long_texts(df: DataFrame, key: str, text: str, limit: int = 1200, least: int = 600, overlap: int = 120, texts: bool = True) -> DataFrame:
    """(key, char_start, char_end, piece) of every text longer than `limit`, distinct. Only the two columns are read.

    Without `texts` the pieces' texts are left out, so only offsets are moved.
    """
    source = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > limit))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, a, b, t[a:b] if texts else None) for k, t in zip(batch["_key"], batch["_text"]) for a, b in pieces(t, limit, least, overlap)]
            yield pd.DataFrame(rows, columns=["_key", "char_start", "char_end", "piece"])

    kind = source.schema["_key"].dataType.simpleString()
    found = source.mapInPandas(cut, f"_key {kind}, char_start bigint, char_end bigint, piece string").withColumnRenamed("_key", key)
    return found.distinct() if texts else found.drop("piece").distinct()
