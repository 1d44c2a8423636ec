"""Scalar text functions as column expressions; all run inside the JVM.

Null input gives null output unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the text formats handled here. White space is spelled out, since engines differ in `\s`.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PARAGRAPH = r"\n[ \t\f]*\n"
HTML_TAG = r"<[^>]+>"
NUMERIC_CITATION = r"\[[ \t]*[0-9]+(?:[ \t]*[-,;][ \t]*[0-9]+)*[ \t]*\]"
HEADING = r"^[ \t]*={2,}[ \t]*(.*?)[ \t]*={2,}[ \t]*$"
HORIZONTAL = r"[ \t\r\f\x{0B}]+"
TOKEN = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
NOT_WORD = r"[^\p{L}\p{N}_]+"
CHUNK_CITATION = r"\[(CHUNK-[0-9]{6})\]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(F.regexp_replace(_c(x), f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse(x) -> Column:
    """White space runs become one blank; outer white space goes."""
    return strip(F.regexp_replace(_c(x), f"{SPACE}+", " "))


def blocks(x) -> Column:
    """Array of paragraphs: split at blank lines, lines stripped and joined with a blank, blank paragraphs dropped."""
    text = F.regexp_replace(_c(x), r"\r\n?", "\n")
    lines = lambda p: F.array_join(F.filter(F.transform(F.split(p, "\n"), strip), lambda s: s != ""), " ")
    return F.filter(F.transform(F.split(text, PARAGRAPH), lines), lambda p: p != "")


def clean(x, html: bool = True, citations: bool = True) -> Column:
    """A paragraph without heading marks, tags and numeric citations, with single blanks."""
    text = F.regexp_replace(_c(x), HEADING, "$1")
    if html:
        text = F.regexp_replace(text, HTML_TAG, " ")
    if citations:
        text = F.regexp_replace(text, NUMERIC_CITATION, " ")
    return strip(F.regexp_replace(text, HORIZONTAL, " "))


def word_array(x) -> Column:
    """White-space separated words; a blank or null text has none."""
    text = collapse(x)
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(text, " "))


def tokens(x) -> Column:
    """Search tokens: lower-case letter and digit runs with inner hyphens and apostrophes; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(TOKEN), 0)


def normal_entity(x) -> Column:
    """Entity name in lower case with single blanks."""
    return F.lower(collapse(x))


def valid_entity(x) -> Column:
    """Longer than two characters and not a number."""
    return (F.length(_c(x)) > 2) & ~_c(x).rlike(r"^[0-9][0-9.,%:/\- ]*$")


def node_id(label, name) -> Column:
    return F.concat(_c(label), F.lit("::"), _c(name))


def plain_name(x) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), NOT_WORD, " "))


def slug(x) -> Column:
    """Stable identity of a name: word runs joined by underscores, at most 120 characters."""
    s = F.regexp_replace(F.regexp_replace(plain_name(x), NOT_WORD, "_"), "^_+|_+$", "")
    return F.when(s == "", "unnamed_entity").otherwise(F.substring(s, 1, 120))


def signature(x) -> Column:
    """Text reduced to its lower-case word characters, for finding copies."""
    return F.regexp_replace(F.lower(_c(x)), NOT_WORD, "")


def mention_count(text, name) -> Column:
    """How often `name` stands in `text` as whole words, whatever the case."""
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])\Q"), F.replace(_c(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_count(_c(text), quoted)


def substring_count(text, part) -> Column:
    """Occurrences of a part, not overlapping; 0 for an empty part."""
    t, p = _c(text), _c(part)
    return F.when(F.length(p) > 0, ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def short_hash(x) -> Column:
    return F.substring(F.md5(F.encode(_c(x), "utf-8")), 1, 10)


def chunk_key(source, chunk_id) -> Column:
    """The key that chunks sort by, as a string."""
    return F.concat_ws("_", _c(source), _c(chunk_id).cast("string"))


def document_key(source, chunk_id, text) -> Column:
    """The chunk key if both parts are there, else the text."""
    return F.when(_c(source).isNotNull() & _c(chunk_id).isNotNull(), chunk_key(source, chunk_id)).otherwise(_c(text))


def json_object(x) -> Column:
    """The outermost {...} of a reply, fences and chatter removed; null if there is none."""
    found = F.regexp_extract(_c(x), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def answer_of(x) -> Column:
    """What stands in <answer> tags, else the text without <thinking> parts."""
    inner = F.regexp_extract(_c(x), r"(?is)<answer>(.*?)</answer>", 1)
    return strip(F.when(_c(x).rlike(r"(?is)<answer>.*?</answer>"), inner).otherwise(F.regexp_replace(_c(x), r"(?is)<thinking>.*?</thinking>", "")))


def without_citations(x) -> Column:
    """An answer without a trailing list of sources and without citation marks."""
    text = F.element_at(F.split(_c(x), r"(?im)^[ \t]*#{0,6}[ \t]*sources?[ \t]*:?[ \t]*$", 2), 1)
    text = F.regexp_replace(text, r"(?:\[[ \t]*[0-9]+(?:[ \t]*,[ \t]*[0-9]+)*[ \t]*\])+", "")
    text = F.regexp_replace(text, r"(?i)\[[ \t]*source[ \t]*:[^\]]+\]", "")
    text = F.regexp_replace(text, r"[ \t]+([.,;:!?])", "$1")
    return strip(F.regexp_replace(text, r"[ \t]{2,}", " "))


def readable_source(x) -> Column:
    """The last part of a path without a hexadecimal suffix."""
    return F.regexp_replace(F.element_at(F.split(strip(x), "/"), -1), r"(?i)_[a-f0-9]{8,64}$", "")


def session_title(x) -> Column:
    """The first 40 characters of a message, with dots if it is longer."""
    return F.when(F.length(_c(x)) > 40, F.concat(F.substring(_c(x), 1, 40), F.lit("..."))).otherwise(_c(x))


def cited_chunks(x) -> Column:
    """Distinct cited chunk ids in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(CHUNK_CITATION), 1)))


def description(xs) -> Column:
    """The first six distinct descriptions that aren't blank, joined; null counts as none."""
    kept = F.filter(F.coalesce(_c(xs), F.array().cast("array<string>")), lambda s: s.isNotNull() & (F.trim(s) != ""))
    return F.array_join(F.slice(F.array_distinct(kept), 1, 6), " ")


def number_or(x, default: float = 1.0) -> Column:
    """A number, or the default where it can't be read."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def verdict(x) -> Column:
    """0 or 1 from true/false, yes/no, "0"/"1" or a number; null for anything else."""
    s = F.lower(F.trim(_c(x).cast("string")))
    n = s.try_cast("double")
    return F.when(s.isin("true", "yes"), 1).when(s.isin("false", "no"), 0).when(n.isin(0.0, 1.0), n.cast("int"))


def source_block(index, source, text) -> Column:
    return F.concat(F.lit('<source id="'), _c(index).cast("string"), F.lit('" name="'), F.coalesce(_c(source), F.lit("unknown")), F.lit('">\n'), strip(text), F.lit("\n</source>"))


def sentences(x) -> Column:
    """Sentences: split after . ! or ? followed by white space."""
    return F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"([.!?])[ \t\r\n]+", "$1\u0001"), "\u0001")


def safe_folder(x) -> Column:
    """Whether a session id may name a folder."""
    return _c(x).cast("string").rlike("^[A-Za-z0-9_-]+$")


def source_name(title, text) -> Column:
    """The last part of a title with twelve hexadecimal digits of the text's hash, `PastFile_` without a title.

    The digits follow from the content, so ingesting a text twice names it alike.
    """
    base = F.element_at(F.split(strip(_c(title)), "/"), -1)
    mark = F.substring(F.md5(F.encode(F.coalesce(_c(text), F.lit("")), "utf-8")), 1, 12)
    return F.concat(F.when(base.isNull() | base.isin("", ".", ".."), "PastFile").otherwise(base), F.lit("_"), mark)


def filled(xs) -> Column:
    """An array of texts without outer white space; null and blank ones go, a null array is empty."""
    array = F.coalesce(_c(xs), F.array().cast("array<string>"))
    return F.filter(F.transform(array, strip), lambda s: s.isNotNull() & (s != ""))


def citation(chunk_id, source, page) -> Column:
    """`[id] source, page n`; the page is left out where it is null."""
    return F.concat(F.lit("["), _c(chunk_id), F.lit("] "), _c(source), F.coalesce(F.concat(F.lit(", page "), _c(page).cast("string")), F.lit("")))


def excerpt(chunk_id, source, page, text, most: int = 1400) -> Column:
    """A chunk as evidence in a prompt: its citation and the first `most` characters of its text."""
    place = F.concat(F.lit("["), _c(chunk_id), F.lit("] Source: "), _c(source), F.coalesce(F.concat(F.lit(", page "), _c(page).cast("string")), F.lit("")))
    return F.concat(place, F.lit("\n"), F.substring(_c(text), 1, most))


def entity_line(name, kind, said) -> Column:
    return F.concat(F.lit("- "), _c(name), F.lit(" ["), F.coalesce(_c(kind), F.lit("")), F.lit("]: "), F.coalesce(_c(said), F.lit("")))


def relation_line(source, kind, target, said) -> Column:
    return F.concat(F.lit("- "), _c(source), F.lit(" --"), _c(kind), F.lit("--> "), _c(target), F.lit(": "), F.coalesce(_c(said), F.lit("")))


def report_text(title, summary, findings) -> Column:
    """Title, summary and findings of a community report, each on lines of its own; blank parts are left out."""
    listed = F.array_join(F.transform(filled(findings), lambda f: F.concat(F.lit("- "), f)), "\n")
    return F.array_join(filled(F.array(_c(title), _c(summary), listed)), "\n")
