import unicodedata
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from braidlake.llm.lookalike import Rewriter, look_alike_classes, look_alike_pairs, look_alikes, rewrite_rules, unify_look_alikes

PLAIN = "The office déjà vu, coöperate - fine."
VARIANTS = [
    "Тhe оffice déjà vu, coöperate - fine.",  # Cyrillic letters
    "Ｔｈｅ office déjà vu, coöperate - fine.",  # full-width
    "The oﬃce déjà vu, coöperate - ﬁne.",  # ligatures
    "The office déjà vu, coöperate - fine.",  # combining accents
    "The of​fice déjà vu, coöp­erate ‐ fine.﻿",  # invisible, space, hyphen
    "The office dе́jà vu, coöperate - fine.",  # a Cyrillic letter with a combining accent
    "The office de‍́jà vu, coöperate - fine.",  # an invisible character before an accent
]
OTHERS = ["The office deja vu, coöperate - fine.", "the office déjà vu, coöperate - fine.", "The office déjà vu,\ncoöperate - fine."]


def rewriter(texts):
    counts = Counter(c for t in texts for c in t)
    return Rewriter(rewrite_rules(counts), set(counts))


def test_variants_agree_and_others_dont():
    rewrite = rewriter([PLAIN] * 20 + VARIANTS + OTHERS)
    assert {rewrite(v) for v in VARIANTS} == {PLAIN} == {rewrite(PLAIN)}
    assert len({rewrite(x) for x in [PLAIN, *OTHERS]}) == 4
    assert rewrite(None) is None and rewrite("") == ""


def test_no_class_joins_two_ascii_characters():
    assert all(sum(x.isascii() and x != "" for x in own if len(x) == 1) <= 1 for own in look_alikes().values())


def test_rewriting_is_stable():
    rewrite = rewriter([PLAIN, *VARIANTS, *OTHERS])
    assert all(rewrite(rewrite(x)) == rewrite(x) for x in VARIANTS)


def test_equivalent_spellings_agree():
    texts = ["\ud55c\uae00 vi\u1ec7t", unicodedata.normalize("NFD", "\ud55c\uae00 vi\u1ec7t"), "\ud55c\uae00 vie\u0302\u0323t", "\ud55c\uae00 vi\u0435\u0323\u0302t", "\ud55c\uae00 vi\u00ea\u0323t"]
    rewrite = rewriter(texts)
    assert len({rewrite(t) for t in texts}) == 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeo\u0435\u043e\u0301\u0302\u0323\u0327\u00e9\u00ea\u1ec7\u200d\ud55c\u1112\u1161\u11ab\uff45 -", max_size=12), st.sampled_from(["NFC", "NFD"]))
def test_forms_follow_canonical_equivalence(text, form):
    other = unicodedata.normalize(form, text)
    rewrite = rewriter([text, other, other])
    assert rewrite(text) == rewrite(other) == rewrite(rewrite(text))


def test_classes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([PLAIN, PLAIN, *VARIANTS[:2], OTHERS[0], None])] + [(3, VARIANTS[1])], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in look_alike_classes(df, "doc_id", "text").collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 3), (4, 4, 1)]


def test_tables(spark):
    texts = [PLAIN, PLAIN, *VARIANTS[:2], OTHERS[0], None, ""]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, VARIANTS[2], "x"), (2, VARIANTS[0], "x")], "doc_id bigint, text string, _form string")
    got = sorted(tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect())
    assert got == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    assert look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    unified = unify_look_alikes(df, "text", "same").where("doc_id = 2").first()
    assert unified["same"] == PLAIN and unified["_form"] == "x"


def test_long_text():
    long = "ﬁne оld text " * 50_000
    assert rewriter(["fine old text"] * 9 + [long[:50]])(long) == "fine old text " * 50_000
