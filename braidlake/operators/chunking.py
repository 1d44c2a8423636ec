"""Paragraphs, cleaning and overlapping word windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.functions import text as T
from braidlake.runtime import numbered, spread

_RUN = re.compile(r"[^ \t\n\x0b\f\r]+")


def parse_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_index, text): the paragraphs of each text; blank and null texts have none."""
    return df.select(key, F.posexplode(T.blocks(text)).alias("block_index", "text"))


def clean_blocks(blocks: DataFrame, html: bool = True, citations: bool = True, least: int = 3) -> DataFrame:
    """Cleaned paragraphs of at least `least` characters under their old index."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    return blocks.withColumn("text", T.clean("text", html, citations)).where(F.length("text") >= least)


def _checked(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size >= 1 and 0 <= overlap < size must hold")


def windows(n_words, size: int, overlap: int):
    """Start positions of the windows over n words: stride size - overlap, the last is the first that reaches the end."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((n_words - size) / F.lit(stride))).cast("int")
    return F.when(n_words > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def chunk_words(df: DataFrame, keys: list[str], text: str, size: int = 650, overlap: int = 100) -> DataFrame:
    """(keys, window, start, text): windows of `size` words joined with blanks."""
    _checked(size, overlap)
    words = df.select(*keys, T.word_array(text).alias("_words"))
    # Windows are cut inside the row, so the words aren't carried along with each of them.
    cut = F.transform(windows(F.size("_words"), size, overlap), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("_words", i + 1, size), " ").alias("text")))
    return words.select(*keys, F.posexplode(cut).alias("window", "_w")).select(*keys, "window", F.col("_w.start").alias("start"), F.col("_w.text").alias("text"))


def chunk_words_numbered(df: DataFrame, keys: list[str], text: str, size: int = 650, overlap: int = 100) -> DataFrame:
    """Windows with ids CHUNK-000000, CHUNK-000001 … in the order of the keys and windows."""
    parts = numbered(chunk_words(df, keys, text, size, overlap), [*keys, "window"], "_number")
    return parts.withColumn("id", F.format_string("CHUNK-%06d", "_number")).drop("_number")


def token_windows(counts: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of greedy windows over words of the given token counts.

    A window takes words while it stays within `size` tokens, at least one; the next one starts as far back as `overlap`
    tokens reach, but after the start of the one before; the last is the first that reaches the end.
    """
    out, first, n = [], 0, len(counts)
    end = used = 0
    while first < n:
        while end < n and (used + counts[end] <= size or end == first):
            used += counts[end]
            end += 1
        out.append((first, end))
        if end == n:
            break
        start, back = end, 0
        while start - 1 > first and back + counts[start - 1] <= overlap:
            start -= 1
            back += counts[start]
        used -= sum(counts[first:start])
        first = start
    return out


def chunk_by_tokens(df: DataFrame, source: str, text: str, size: int = 500, overlap: int = 80, counter: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(source, chunk_id, text, char_start, char_end, token_count): windows that keep the text's own white space.

    `counter` gives the tokens of each word; without one a word is a token. Offsets count code points of the stripped
    text. A text is cut in one pass, whatever its length; null and blank texts have no chunks.
    """
    _checked(size, overlap)
    rows = spread(df.select(F.col(source).alias("source"), T.strip(text).alias("_text")).where("_text is not null and _text <> ''"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, body in zip(batch["source"], batch["_text"]):
                spans = [m.span() for m in _RUN.finditer(body)]
                counts = counter([body[a:b] for a, b in spans]) if counter else [1] * len(spans)
                found = token_windows(counts, size, overlap)
                starts, ends = [spans[i][0] for i, _ in found], [spans[j - 1][1] for _, j in found]
                yield pd.DataFrame({"source": [key] * len(found), "chunk_id": range(len(found)), "text": [body[a:b] for a, b in zip(starts, ends)], "char_start": starts, "char_end": ends, "token_count": [sum(counts[i:j]) for i, j in found]})

    kind = rows.schema["source"].dataType.simpleString()
    return rows.mapInPandas(cut, f"source {kind}, chunk_id int, text string, char_start int, char_end int, token_count int")


def chunk_with_offsets(df: DataFrame, source: str, text: str, size: int = 500, overlap: int = 80) -> DataFrame:
    """`chunk_by_tokens` with white-space words as tokens."""
    return chunk_by_tokens(df, source, text, size, overlap)
