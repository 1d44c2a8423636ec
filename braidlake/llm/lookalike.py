"""Visually identical text with different characters (problem 10).

Method: transitive look-alike classes by union-find over strings and code points; the representative of a class is
its most frequent member in the corpus; texts are brought to the canonical order of their combining marks and rewritten
greedily (leftmost, longest) with an Aho-Corasick automaton over all other members, until nothing changes. Canonically
equivalent texts therefore always agree.

Classes join full-width and half-width forms, ligatures, presentation forms, composed and decomposed accents,
invisible characters (with the empty string), special spaces and hyphens, and look-alike letters of other scripts.
Accents, case, digits and line breaks stay apart. Character counts cover all documents; what reaches the driver is
one row per distinct code point, at most the 1.1 million of Unicode.

Defined results: null stays null; an empty text stays empty; a text without foreign members is returned unchanged;
texts are rewritten whole.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import checkpointed, spread

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АаВЕеЅѕІіЈјКМНОоРрСсТУуХхԁԛԜԝҮҺһӀӏѴѵԌ"
CYRILLIC_AS = "AaBEeSsIiJjKMHOoPpCcTYyXxdqWwYhhIlVvG"
GREEK = "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧνϳϲιαυ"
GREEK_AS = "ABEZHIKMNOoPTYXvjciau"
OTHERS = "ɑɡɩ℮ոսցօհՍՕᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃꓐꓓꓖꓗꓝꓡꓢꓣ"
OTHERS_AS = "agienugohUOABCDEHJKLMPRSTVWZBDGKFLSR"
# Characters without a width, special blanks and hyphens.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0x2212, 0xFE63, 0xFF0D]
#: Kinds of compatibility decomposition whose two sides look alike.
ALIKE = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, x: str, y: str) -> None:
        self.parent[self.find(x)] = self.find(y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


@lru_cache(maxsize=1)
def _foreign() -> dict[str, str]:
    """Characters and the plain characters they look like."""
    pairs = {a: b for own, plain in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (OTHERS, OTHERS_AS)) for a, b in zip(own, plain, strict=True)}
    pairs |= {chr(c): "" for c in INVISIBLE} | {chr(c): " " for c in SPACES} | {chr(c): "-" for c in HYPHENS}
    return pairs


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, list[str]]:
    """All classes with more than one member, by an arbitrary root."""
    classes, foreign = Classes(), _foreign()
    for a, b in foreign.items():
        classes.union(a, b)
    marked: list[tuple[str, str]] = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if 0xAC00 <= code < 0xD7A4:  # a syllable and its conjoining letters
            classes.union(c, unicodedata.normalize("NFD", c))
            continue
        shape = unicodedata.decomposition(c)
        if not shape:
            continue
        kind = shape.split(" ", 1)[0]
        plain = unicodedata.normalize("NFD", c)
        if kind[0] != "<":
            classes.union(c, plain)
            if unicodedata.normalize("NFC", plain) != plain:
                marked.append((c, plain))
        elif kind in ALIKE or kind == "<compat>" and (0xFB00 <= code < 0xFB50 and code != 0xFB05 or 0x2160 <= code < 0x2180 or code in (0x132, 0x133, 0x2026)):
            full = unicodedata.normalize("NFKC", c)
            if full.strip() or kind == "<noBreak>":
                classes.union(c, full)
    # An accented letter of another script, and its spelling with combining marks, joins that of its look-alike.
    for c, plain in marked:
        latin = "".join(foreign.get(x, x) for x in plain)
        if latin != plain:
            classes.union(c, unicodedata.normalize("NFC", latin))
    for c, plain in marked:
        for base in _bases().get(plain[0], ()):
            classes.union(base + plain[1:], c)
    return {root: sorted(own) for root, own in classes.members().items() if len(own) > 1}


@lru_cache(maxsize=1)
def _bases() -> dict[str, list[str]]:
    """Look-alike letters by the Latin letter, for spellings with combining marks."""
    out: dict[str, list[str]] = {}
    for a, b in _foreign().items():
        if len(b) == 1 and b.isalpha():
            out.setdefault(b, []).append(a)
            out.setdefault(b, []).append(chr(ord(b) + 0xFEE0))
    return out


def rewrite_rules(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative: the member with the highest count, then fewest and lowest code points.

    The count of a string of several code points is that of its rarest one; the empty string, if a member,
    represents its class, since an invisible character has no other consistent form.
    """
    rules = {}
    for own in look_alikes().values():
        if "" in own:
            chosen = ""
        else:
            chosen = min(own, key=lambda x: (-min(counts.get(c, 0) for c in x), len(x), [ord(c) for c in x]))
        rules |= {x: chosen for x in own if x and x != chosen}
    return rules


class Rewriter:
    """Leftmost-longest rewriting of class members by an Aho-Corasick automaton."""

    def __init__(self, rules: dict[str, str], present: set[str]) -> None:
        import ahocorasick

        # Invisible characters go first, since they may stand between a letter and its accent.
        self.dropped = {ord(x): None for x, y in rules.items() if y == ""}
        self.foreign_ascii = any(x.isascii() for x in rules if set(x) <= present)
        self.automaton = ahocorasick.Automaton()
        # Composing makes characters that no text holds as such, so they may occur too.
        present = present | {c for x in rules if set(x) <= present for c in unicodedata.normalize("NFC", x)}
        for x, y in rules.items():
            if y and set(x) <= present:
                self.automaton.add_word(x, (len(x), y))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii() and not self.foreign_ascii:
            return text
        states = []
        while text not in states:
            states.append(text)
            text = self._once(text.translate(self.dropped))
        return min(states[states.index(text) :])  # the last state, or the least of those that follow each other in a circle

    def _once(self, text: str) -> str:
        # The canonical composition puts marks in order, however they were typed.
        text = unicodedata.normalize("NFC", text)
        if not self.some:
            return text
        out, at = [], 0
        for last, (size, new) in self.automaton.iter_long(text):
            start = last - size + 1
            out += [text[at:start], new]
            at = last + 1
        return "".join([*out, text[at:]])


def code_point_counts(df: DataFrame, text: str) -> dict[str, int]:
    """How often each code point occurs in all texts; counted per partition before the shuffle."""
    source = spread(df.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        total = np.zeros(sys.maxunicode + 1, dtype=np.int64)
        for batch in batches:
            for t in batch["_text"]:
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                found, n = np.unique(codes, return_counts=True)
                total[found] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"_code": at.astype("int32"), "_n": total[at]})

    rows = source.mapInPandas(count, "_code int, _n bigint").groupBy("_code").agg(F.sum("_n").alias("_n")).collect()
    return {chr(r["_code"]): r["_n"] for r in rows}


def unify_look_alikes(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds column `into`, the text in its consistent form; all other columns stay. Runs one counting job first."""
    counts = code_point_counts(df, text)
    rules, present = rewrite_rules(counts), set(counts)
    digest = hashlib.md5(repr((sorted(rules.items()), sorted(present))).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf("string")
    def unified(texts: pd.Series) -> pd.Series:
        rewriter = _rewriter(digest, rules, present)
        return pd.Series([rewriter(t) for t in texts], dtype=object)

    return df.withColumn(into, unified(F.col(text)))


_KEPT: dict[str, Rewriter] = {}


def _rewriter(digest: str, rules: dict[str, str], present: set[str]) -> Rewriter:
    """The worker's rewriter for the rules of this digest, built once."""
    if digest not in _KEPT:
        _KEPT.clear()
        _KEPT[digest] = Rewriter(rules, present)
    return _KEPT[digest]


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _raw, _form): 128-bit digests of each text and of its consistent form; texts are rewritten once."""
    source = spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).isNotNull() & F.col(key).isNotNull()))
    marked = unify_look_alikes(source, "_text", "_same").select("_key", F.md5(F.encode("_text", "utf-8")).alias("_raw"), F.md5(F.encode("_same", "utf-8")).alias("_form"))
    return checkpointed(marked.distinct())


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, spellings): one row per key and class; texts of one class read the same, class_id is the least key.

    spellings is the number of different texts in the class. Partial minima and counts are taken before the shuffle.
    """
    marked = _digests(df, key, text)
    texts = marked.groupBy("_form", "_raw").agg(F.min("_key").alias("_first"))
    classes = texts.groupBy("_form").agg(F.min("_first").alias("class_id"), F.count("*").alias("spellings"))
    return marked.join(classes, "_form").select(F.col("_key").alias(key), "class_id", "spellings").distinct()


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b): keys doc_a < doc_b of texts that differ in code points but agree in their consistent form.

    Texts are compared by 128-bit digests, so the shuffle carries no texts. Distinct spellings are paired first
    and their keys joined after, so that copies of one spelling are never paired with each other.
    """
    marked = _digests(df, key, text)
    forms = marked.select("_form", "_raw").distinct()
    several = forms.groupBy("_form").agg(F.count("*").alias("_n")).where("_n > 1").select("_form")
    kept = marked.join(several, "_form", "left_semi")
    left = kept.select("_form", F.col("_raw").alias("_raw_a"), F.col("_key").alias("doc_a"))
    right = kept.select("_form", F.col("_raw").alias("_raw_b"), F.col("_key").alias("doc_b"))
    return left.join(right, "_form").where((F.col("_raw_a") != F.col("_raw_b")) & (F.col("doc_a") < F.col("doc_b"))).select("doc_a", "doc_b").distinct()
