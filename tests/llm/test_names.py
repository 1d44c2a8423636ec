import pytest

from braidlake.llm.names import name_pairs, parse, same_organisation, same_person

SAME = [
    ("Timothy Huhiramen", "Huhiramen, Timothy W."), ("Timothy Huhiramen", "Timtthy Huhiramen"), ("Hugo Bamoloved", "HugoBamoloved"), ("Prof. Dr. Xenia Pihozakak", "Xenia Pihozakak, Ph.D."),
    ("Wanda Göhotazek", "WANDA GOHOTAZEK"), ("Bob Kozifukuk", "Robert Kozifukuk"), ("Chekunup Laboratory of Polar Acoustics", "Chekunup LPA"), ("Univ. of Insect Ecology (Stirath)", "Stirath University for Insect Ecology"),
    ("the Skipuw Instruments group", "Skipuw Instr. Ltd."), ("Webigl SPA", "Webigl Society of Polar Acoustics"), ("Stebew DIE", "Stebew Department of Insect Ecology"), ("V.B. Bekamison", "Bekamison, B. V."),
]
DIFFERENT = [("Greta Dufopivud", "Rebecca Dufopivud"), ("Hanna Kopodiv", "Anna Kopodiv"), ("Chuput Printing", "Chuput Shipping"), ("Wezach Department of Rural Statistics", "Wezach Department of Tidal Energy")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    (kind, x), (_, y) = parse(a), parse(b)
    assert x == y or (same_person if kind == "person" else same_organisation)(x, y) == "full"


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    (kind, x), (_, y) = parse(a), parse(b)
    assert x != y and (same_person if kind == "person" else same_organisation)(x, y) is None


def test_neither():
    assert parse(None) is None and parse("  ") is None and parse("Lake Tileg", "PERSON") is None and parse("Bustivamern", "GPE") is None


def test_pairs(spark):
    names = ["Rafael Mofosigos", "Mofosigos, R.", "Rafael Mofosios", "Rebecca Mofosigas", None, "", "Greta Dufopivud", "Gustav Dufopivud", "G. Dufopivud", "Rafael Mofosigos"]
    rows = [(f"e{i}", n, "PERSON", "x") for i, n in enumerate(names)] + [("e0", "Rafael Mofosigos", "PERSON", "x")]
    df = spark.createDataFrame(rows, "id string, name string, type string, form string")
    got = {tuple(r) for r in name_pairs(df, "id", "name", "type").collect()}
    same = ["e0", "e1", "e2", "e9"]
    assert got == {(a, b) for a in same for b in same if a < b}
    assert name_pairs(df.limit(0), "id", "name", "type").count() == 0


def test_common_suffixes_lose_nothing(spark):
    """Names that share suffixes far beyond the limit of a block are still linked."""
    from pyspark.sql import functions as F

    from braidlake.llm.names import name_links

    forms = [f"{a}{b}asun leila" for a in "bcdfghjklm" for b in "aeiouxyz"] + ["baasuun leila", "l baasun"]
    df = spark.createDataFrame([(i, "person", " ".join(sorted(f.split()))) for i, f in enumerate(forms)], "rec bigint, kind string, form string")
    few = {tuple(r) for r in name_links(df, common=5).collect()}
    many = {tuple(r) for r in name_links(df, common=10_000).collect()}
    assert few == many and name_links(df, common=5).where(F.col("rule") == "initial").count() > 0


def test_keys_lose_no_pair(spark):
    """All pairs by brute force: nicknames, slips in first and last letters, initials and acronyms under common suffixes."""
    from braidlake.llm.names import name_links

    people = [f"{g} {s}" for g in ("becky", "rebecca", "ted", "edward", "edwerd", "karl", "varl", "t") for s in ("kibafemon", "kibafemom", "sibafemon", "kohn", "sohn")] + ["becky maria kohn", "rebecca maria peggy sohn"]
    groups = ["stebew DIE", "department ecology insect stebew", "department ecology insect stebow", "DIE dept stebow", "department department ecology insect stebew", "ecology insect university"]
    forms = [(k, " ".join(sorted(f.split()))) for k, names in (("person", people), ("org", groups)) for f in names]
    want = set()
    for i, (kind, a) in enumerate(forms):
        for j, (other, b) in enumerate(forms[:i]):
            rule = (same_person if kind == "person" else same_organisation)(tuple(a.split()), tuple(b.split())) if kind == other else None
            want |= {(j, i, rule)} if rule else set()
    df = spark.createDataFrame([(i, k, f) for i, (k, f) in enumerate(forms)], "rec bigint, kind string, form string")
    for common in (2, 200):
        assert {tuple(r) for r in name_links(df, common=common).collect()} == want


def test_common_surnames_keep_their_links(spark):
    """Nicknames, slips and long names under a suffix of far more forms than make a block; names of one word and short ones."""
    from braidlake.llm.names import name_classes

    others = [f"{a}{b}{c}{a.lower()}{b}{c}o Anderson" for a in "BCDFGHJKLM" for b in "aeiou" for c in "bcdfghjk"]
    linked = [("Robert Anderson", "Bob Anderson"), ("William Anderson", "Bill Andersen"), ("Ana Maria Sofia Lopez Garcia Anderson", "Garcia Anderson, Ana Maria Sofia"), ("Siemens AG", "Siemens"), ("Wei Li", "W. Li")]
    names = [(n, "PERSON") for n in others] + [(n, "ORG" if "Siemens" in n else "PERSON") for pair in linked for n in pair] + [("Siemens Foundation", "ORG")]
    df = spark.createDataFrame(names, "name string, type string")
    got = {r["id"]: r["class"] for r in name_classes(df, "name", "name", "type").collect()}
    assert all(got[a] == got[b] for a, b in linked) and got["Siemens Foundation"] != got["Siemens"]
    assert len({got[n] for n in others}) == len(others) and not {got[n] for n in others} & {got[a] for a, _ in linked}
