"""Variant spellings of names typed by people (problem 3).

Method: suffix blocking. Names are folded and cut into tokens, and each form is indexed by the suffixes of its tokens, as
written, with nicknames in full, and less any one letter near the end, so that a slip there hides nothing. Two forms that
mean the same have a token that differs by one letter at most, hence share such a suffix. A suffix of more than `common`
forms is not discarded: its forms are indexed again by the suffixed token together with the other fields of the name (all
tokens, one of them less any letter; initial and surname; one token and the initials of the rest), which again lose no
pair, and what is then still long is compared in tiles. Pairs that meet are compared token by token by the ratio of their
longest common subsequence, with rules for initials, nicknames, abbreviations and acronyms.

Links between full forms are closed transitively. A form with only an initial and a surname joins the one person it
fits; if it fits several, it says nothing and stays alone. A surname as it is written goes before one that is only alike.

Defined results: null and blank names are linked to nothing; repeated rows count once; names of places, works, events
and laws are neither persons nor organisations and are left out whatever their type says; a null or wrong type is
overruled by the words of the name; equal names are linked unless they are left out. A name of one distinctive word with
a legal form or the type ORG is an organisation and is linked to others of that word alone; a single word of another type
is left out, since it may be anything.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import combinations, product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm.pii import GIVEN_NAMES
from braidlake.operators.graph import connected_components
from braidlake.runtime import checkpointed, python_tasks, spread

# Titles and degrees around a person's name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor doctor sir dame lord lady rev hon capt captain maj col gen lt sgt herr frau madame monsieur mme senor senora sr sra don dona dipl ing mag".split())
DEGREES = frozenset("md phd msc bsc ma ba mba mphil dphil llb llm jd dds rn esq jr ii iii iv meng beng phil med frs obe mbe".split())
# Legal forms, which don't tell organisations apart.
LEGAL = frozenset("ltd limited inc incorporated gmbh llc llp corp corporation plc ag sa sarl kg bv nv srl spa oy ab as pty co company group holding holdings".split())
# Words left out of comparisons.
SMALL = frozenset("of for and the in on at de la le du des der die das fur und et y e el del".split())
# Abbreviations of words in names of organisations.
EXPANDED = {
    "univ": "university", "uni": "university", "soc": "society", "fdn": "foundation", "fnd": "foundation", "found": "foundation", "dept": "department", "dep": "department", "inst": "institute", "lab": "laboratory",
    "labs": "laboratory", "acad": "academy", "assoc": "association", "assn": "association", "ass": "association", "instr": "instruments", "intl": "international", "int": "international", "mfg": "manufacturing", "manuf": "manufacturing",
    "eng": "engineering", "engr": "engineering", "engg": "engineering", "print": "printing", "prtg": "printing", "ship": "shipping", "shpg": "shipping", "natl": "national", "ctr": "center", "centre": "center", "coll": "college", "hosp": "hospital", "mus": "museum", "org": "organisation",
    "bros": "brothers", "tech": "technology", "sci": "science", "comm": "committee", "govt": "government", "mgmt": "management", "bldg": "building", "svc": "services", "svcs": "services", "ind": "industries", "inds": "industries",
}
# Words that mark an organisation.
ORG_WORDS = frozenset(EXPANDED.values()) | frozenset("council consortium office press survey archive agency bureau ministry authority commission union federation trust club school observatory bank consulting logistics systems partners works studio studios publishing".split())
# Words that mark a place, work, event, law or product.
OTHER_WORDS = frozenset("river lake bridge expedition ballad act reader road street avenue mount mountain island isle bay valley sea canal station tower treaty law conference festival war battle award prize novel song symphony".split())
# Common short forms of given names, each with the full names it stands for.
SHORT_FORMS = """
bill william, will william, billy william, willi wilhelm, bob robert, rob robert, bobby robert, dick richard, rick richard, rich richard, tim timothy, timmy timothy, tom thomas, tommy thomas
mike michael, mick michael, micky michael, dan daniel, danny daniel, dave david, ed edward edmund edwin, ned edward, ted edward theodore, teddy edward theodore, eddie edward, fred frederick alfred, freddy frederick, fritz friedrich
alex alexander alexandra, sandy alexander sandra, sascha alexander, sasha alexander, xander alexander, ben benjamin, benny benjamin, chris christopher christine christian, kit christopher, topher christopher, toph christopher
liz elizabeth, beth elizabeth, betty elizabeth, lizzie elizabeth, lisbeth elizabeth, eliza elizabeth, kate katherine, kathy katherine, katie katherine, kat katherine, kitty katherine, meg margaret, maggie margaret, peggy margaret, madge margaret
sam samuel samantha, sammy samuel, sue susan, susie susan, suzy susan, steph stephanie, steffi stephanie, stevie stephanie, steve stephen steven, becky rebecca, becca rebecca, debbie deborah, deb deborah, jim james, jimmy james, jamie james
joe joseph, joey joseph, jo josephine joanna, josie josephine, pepi josephine, matt matthew, matty matthew, nick nicholas, nicky nicholas, klaus nikolaus, leo leonard leonardo leopold, len leonard, lenny leonard, pat patricia patrick, trish patricia, tricia patricia, patty patricia
simi simon, theo theodore, vicky victoria, vic victor victoria, walt walter, wally walter, gabe gabriel, greg gregory, tony anthony antonio, andy andrew andreas, drew andrew, paco francisco, pancho francisco, kiko francisco, curro francisco, fran francisco frances
pepe jose giuseppe, beppe giuseppe, peppe giuseppe, hannes johannes, hans johannes, jannis johannes, nacho ignacio, kike enrique, lola dolores, quim joaquin, chimo joaquin, gabi gabriel gabriela, rafa rafael, rafi rafael, dani daniel daniela, bea beatrice, sepp josef, toni anton antonia
lena helena magdalena, mimi maria, uli ulrich ulrike, ully ulrich, tomek tomasz, tobi tobias, toby tobias, gus gustav augustus, gusti gustav, berti albert robert, bert albert robert, ron ronald, ray raymond, ken kenneth, larry lawrence, jerry gerald jerome, gerry gerald
harry henry harold, hank henry, jack john, johnny john, chuck charles, charlie charles, art arthur, phil philip, zoli zoltan, vik viktor, fatou fatima, felo felix, nadi nadia, irenka irena, irka irena, ursi ursula, uschi ursula, steven stephen
"""
NICKNAMES = {x: tuple(full) for x, *full in (entry.split() for entry in SHORT_FORMS.replace("\n", ",").split(",") if entry.strip())}
#: Short forms of several full names: they are no proof of one of them.
AMBIGUOUS = sorted(x for x, full in NICKNAMES.items() if len(full) > 1)
#: Letters of an indexed suffix; forms compared in one tile at most; long tokens of a person whose subsets are all keys.
SUFFIX, TILE, MANY = 4, 800, 4
_GIVEN = frozenset(unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in GIVEN_NAMES)
_MARKS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'"})

_LEADING = re.compile(rf"^\s*(?:(?:{'|'.join(sorted(TITLES))})\.?\s+)*(?:[^\W\d_]\.){{2,}}(?=\s*[^\W\d_]{{2}})", re.I)
_TRAILING = re.compile(r"^\s*[^\s,]+,\s*(?:[^\W\d_]\.){2,}\s*$")


def fold(text: str) -> str:
    """Lower case without accents."""
    low = text.casefold().translate(_MARKS)
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


def parse(name: str | None, kind: str | None = None) -> tuple[str, tuple[str, ...]] | None:
    """("person" | "org", tokens) or None for a name that is neither.

    Tokens of a person are words and initials without titles, degrees and order; those of an organisation are words
    in full without small words and legal forms, its acronyms in capitals.
    """
    if not name or not name.strip():
        return None
    # Dotted capitals before a surname, or after a lone one, are initials; elsewhere they are degrees and abbreviations.
    apart = lambda m: m.group().replace(".", ". ")
    name = _LEADING.sub(apart, name) if _LEADING.match(name) else _TRAILING.sub(apart, name)
    text = re.sub(r"\b([^\W\d_]{1,2})\.(?=[^\W\d_]{1,2}\b)", r"\1", re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", name))
    raw = []
    for t in re.findall(r"[^\W_]+(?:['’\-][^\W_]+)*", text):
        parts = t.split("-")
        raw += parts if any(fold(p) in ORG_WORDS or fold(p) in EXPANDED for p in parts) else [t]
    folded = [fold(t) for t in raw]
    words = [EXPANDED.get(t, t) for t in folded]
    legal = any(t in LEGAL for t in folded)
    if folded and folded[0] == "the" and folded[-1] == "group" and len(folded) > 2:
        legal = True
    acronyms = not name.isupper()
    own = [(t, r) for t, r in zip(words, raw) if t not in LEGAL and (t not in SMALL or acronyms and r.isupper() and 2 <= len(r) <= 5)]
    if len(own) == 1 and acronyms:  # what looks like a legal form may stand for the rest of the name
        own = [(t, r) for t, r in zip(words, raw) if (t, r) in own or r.isupper() and len(r) > 2]
    if any(t in ORG_WORDS for t, _ in own):
        org = True
    elif any(t in OTHER_WORDS for t, _ in own):
        return None
    else:
        acronym = len(own) == 2 and any(r.isupper() and 2 <= len(r) <= 5 for _, r in own) and not all(r.isupper() for _, r in own)
        degree = any(t in DEGREES or t in TITLES and not r.isupper() for t, r in zip(folded, raw))
        org = legal or acronym and not degree and (kind or "").strip().upper() != "PERSON" or (kind or "").strip().upper() == "ORG" and not degree and not any(t in _GIVEN for t, _ in own)
    if org:
        tokens = tuple(sorted(r.upper() if r.isupper() and 2 <= len(r) <= 5 and not name.isupper() and t not in ORG_WORDS else t for t, r in own))
        return ("org", tokens) if tokens else None
    tokens: list[str] = []
    for t, r in zip(folded, raw):
        if t in TITLES or t in DEGREES or t in SMALL and len(t) > 1:
            continue
        tokens += list(t) if len(r) == 2 and r.isupper() and not name.isupper() else [t]
    long = [t for t in tokens if len(t) > 1]
    if not long or len(tokens) < 2 or any(c.isdigit() for t in tokens for c in t):
        return None
    return ("person", tuple(sorted(tokens)))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Length of the longest common subsequence over that of the longer token."""
    return common_length(a, b) / max(len(a), len(b), 1)


def alike(a: str, b: str) -> bool:
    """Whether two different tokens are one typing slip apart: their ratio is 1 - 1 / length at least, which is 3/4 for the
    shortest tokens of four letters. Two known given names are never alike."""
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if short < 4 or long - short > 1 or a in _GIVEN and b in _GIVEN:
        return False
    return ratio(a, b) >= 1 - 1 / long - 1e-9


def _nick(a: str, b: str) -> bool:
    return b in NICKNAMES.get(a, ()) or a in NICKNAMES.get(b, ())


def _matched(a: list[str], b: list[str], extra: Callable[[str, str], bool]) -> tuple[list[str], list[str], int]:
    """What of both stays without a partner, and how many partners are only alike."""
    rest_a, rest_b = list(a), list(b)
    for t in a:
        if t in rest_b:
            rest_a.remove(t)
            rest_b.remove(t)
    slips = 0
    for t in list(rest_a):
        for u in rest_b:
            nick = extra(t, u)
            if nick or alike(t, u):
                slips += not nick
                rest_a.remove(t)
                rest_b.remove(u)
                break
    return rest_a, rest_b, slips


def same_person(a: tuple[str, ...], b: tuple[str, ...]) -> str | None:
    """"full" for two full forms of one name, "initial" where one form has only an initial for the given name, or a short
    form of several names."""
    long_a, long_b = [t for t in a if len(t) > 1], [t for t in b if len(t) > 1]
    if len(long_a) > 1 and len(long_b) > 1:
        rest_a, rest_b, slips = _matched(long_a, long_b, _nick)
        if rest_a and rest_b or slips > 1:
            return None
        matched = len(long_a) - len(rest_a)
        if matched < 2 or (rest_a or rest_b) and slips:
            return None
        weak = {t for t in long_a if t in AMBIGUOUS} ^ {t for t in long_b if t in AMBIGUOUS}
        return "initial" if weak and not weak <= {*rest_a, *rest_b} else "full"
    if len(long_a) == len(long_b) == 1:
        return None
    short, full = (a, long_b) if len(long_a) == 1 else (b, long_a)
    surname = next(t for t in short if len(t) > 1)
    initials = [t for t in short if len(t) == 1]
    for t in full:
        if t == surname or alike(t, surname):
            others = [x for x in full if x is not t]
            if surname not in _GIVEN and any(x[0] == i for x in others for i in initials):
                return "initial"
    return None


def same_organisation(a: tuple[str, ...], b: tuple[str, ...]) -> str | None:
    """"full" if all tokens of both have a partner, but for an acronym that stands for the rest of the other."""
    if min(len(a), len(b)) < 2:  # one word alone is linked to its equal only
        return "full" if a == b else None
    rest_a, rest_b, slips = _matched(list(a), list(b), lambda x, y: False)
    if slips > 1:
        return None
    if not rest_a and not rest_b:
        return "full"
    for mine, other in ((rest_a, rest_b), (rest_b, rest_a)):
        if len(mine) == 1 and mine[0].isupper() and len(other) == len(mine[0]) and sorted(t[0].upper() for t in other) == sorted(mine[0]):
            return "full"
    return None


def parsed(df: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """(id, kind, tokens) of persons and organisations, distinct."""
    source = spread(df.select(F.col(key).alias("id"), F.col(name).alias("_name"), F.col(kind).alias("_kind")).where(F.col(key).isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *p) for i, n, k in zip(batch["id"], batch["_name"], batch["_kind"]) if (p := parse(n, k))]
            yield pd.DataFrame([(i, k, " ".join(t)) for i, k, t in rows], columns=["id", "kind", "form"])

    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, kind string, form string").distinct()


def _variants(token: str) -> set[str]:
    """The token and, from four letters on, it less any one letter: two tokens are alike only if their variants meet."""
    return {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) >= 4 else set())


def _less(tokens: list[str], i: int) -> list[str]:
    return tokens[:i] + tokens[i + 1 :]


def _subsets(tokens: list[str]) -> set[str]:
    """Sets of tokens that two forms with a token more or less share: pairs are enough, since two must agree."""
    return {" ".join(sorted(c)) for c in combinations(tokens, 2)}


def _person_keys(tokens: list[str]) -> set[tuple[str, bool]]:
    long = [t for t in tokens if len(t) > 1]
    if len(long) == 1:
        return set() if long[0] in _GIVEN else {(f"i {i} {v}", True) for i in tokens if len(i) == 1 for v in _variants(long[0])}
    return {k for plain in product(*(NICKNAMES.get(t, (t,)) for t in long)) for k in _full_keys(long, plain)}


def _full_keys(long: list[str], plain: tuple[str, ...]) -> set[tuple[str, bool]]:
    """Keys of a full form whose short forms of given names are read as in `plain`."""
    # Without a slip all long tokens of one form are in the other, but for nicknames; with a slip all but one are.
    if len(plain) <= MANY:
        out = {(f"e {' '.join(sorted(c))}", n == len(plain)) for n in range(2, len(plain) + 1) for c in combinations(plain, n)}
    else:
        out = {(f"e {' '.join(sorted(plain))}", True)}
    out |= {(f"p {c}", len(plain) > MANY) for c in _subsets(plain)}
    for i, t in enumerate(long):
        rest, initials = " ".join(sorted(_less(list(plain), i))), {x[0] for x in _less(long, i)}
        out |= {(f"s {rest} {v}", True) for v in _variants(t)} | {(f"i {x} {v}", False) for x in initials for v in _variants(t)}
    return out


def _organisation_keys(tokens: list[str]) -> set[tuple[str, bool]]:
    if len(tokens) == 1:
        return set()
    out = set()
    for i, t in enumerate(tokens):
        rest = _less(tokens, i)
        # An acronym stands for the letters it has, so both forms agree in the initials beside any token they share.
        plain = "".join(sorted(x[0].upper() for x in rest))
        short = {"".join(sorted([*x, *(y[0].upper() for y in _less(rest, j))])) for j, x in enumerate(rest) if x.isupper()}
        for v in _variants(t):
            out |= {(f"s {' '.join(sorted(rest))} {v}", True), (f"a {plain} {v}", False)} | {(f"a {x} {v}", True) for x in short}
    return out


def suffixes(token: str) -> set[str]:
    """The last `SUFFIX` letters of a token and of the token less any one letter, or all of it if it is shorter.

    Tokens that become equal when each gives up one letter at most share one of these.
    """
    tail = token[-SUFFIX - 1 :]
    less = {tail[:i] + tail[i + 1 :] for i in range(len(tail))} if len(token) >= 4 else set()
    return {token[-SUFFIX:]} | less


def suffix_keys(kind: str, form: str) -> set[str]:
    """Suffixes of all tokens of a form that may lead to a link, with nicknames also in full."""
    tokens = [t for t in form.split(" ") if len(t) > 1]
    if kind == "person":
        if len(tokens) == 1 and tokens[0] in _GIVEN:
            return set()
        tokens += [full for t in tokens for full in NICKNAMES.get(t, ())]
    elif len(tokens) == 1:
        return set()
    return {s for t in tokens for s in suffixes(t)}


def name_keys(kind: str, form: str) -> set[tuple[str, bool]]:
    """(key, leads) of refined blocks: two forms that mean the same share a key in which one leads, so no pair is lost."""
    return (_person_keys if kind == "person" else _organisation_keys)(form.split(" "))


def name_links(forms: DataFrame, common: int = 30) -> DataFrame:
    """(a, b, rule): pairs of different forms that mean the same; `forms` has rec, kind, form, all distinct.

    `common` is the number of forms up to which a suffix makes a block of its own; the forms of a longer one go into
    refined blocks. Two forms that only share suffixes of long blocks are both among those, so they meet there.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{k}:{s}", i) for i, k, f in zip(batch["rec"], batch["kind"], batch["form"]) for s in suffix_keys(k, f)]
            yield pd.DataFrame(rows, columns=["key", "rec"])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{k}|{s}", i, lead) for i, k, f in zip(batch["rec"], batch["kind"], batch["form"]) for s, lead in name_keys(k, f)]
            yield pd.DataFrame(rows, columns=["key", "rec", "lead"])

    # Keys that collide only add comparisons.
    tails = checkpointed(forms.mapInPandas(ends, "key string, rec bigint").select(F.xxhash64("key").alias("block"), "rec").distinct())
    sizes = tails.groupBy("block").agg(F.count("*").alias("_n")).where("_n > 1")
    small = tails.join(sizes.where(F.col("_n") <= common).select("block"), "block").withColumn("lead", F.lit(True))
    again = tails.join(sizes.where(F.col("_n") > common).select("block"), "block").select("rec").distinct()
    refined = forms.join(again, "rec", "left_semi").mapInPandas(blocks, "key string, rec bigint, lead boolean").groupBy(F.xxhash64("key").alias("block"), "rec").agg(F.max("lead").alias("lead"))
    keys = checkpointed(small.select("block", "rec", "lead").unionByName(refined))
    counts = keys.groupBy("block").agg(F.count("*").alias("_n"), F.max("lead").alias("_led")).where("_n > 1 and _led").drop("_led")
    tiled = (
        keys.join(counts, "block")
        .join(forms, "rec")
        .withColumn("_tiles", F.ceil(F.col("_n") / F.lit(TILE)).cast("int"))
        .withColumn("_mine", F.pmod(F.xxhash64("rec"), F.col("_tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select("block", "rec", "lead", "kind", "form", F.least("_mine", "_other").alias("low"), F.greatest("_mine", "_other").alias("high"), (F.col("_mine") <= F.col("_other")).alias("left"))
    )
    grouped = tiled.repartition(python_tasks(forms.sparkSession), "block", "low", "high").sortWithinPartitions("block", "low", "high")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, group = None, []

        def pairs(rows: list[tuple]) -> list[tuple]:
            out = []
            for i, (rec, kind, tokens, left, same, lead) in enumerate(rows):
                test = same_person if kind == "person" else same_organisation
                for other, its, more, side, _, leads in rows[i + 1 :]:
                    if not (lead or leads) or not same and left == side or kind != its:
                        continue
                    rule = test(tokens, more)
                    if rule:
                        out.append((min(rec, other), max(rec, other), rule))
            return out

        for batch in batches:
            out = []
            for block, low, high, rec, lead, kind, form, left in zip(*(batch[c] for c in ("block", "low", "high", "rec", "lead", "kind", "form", "left"))):
                if (block, low, high) != current:
                    out += pairs(group)
                    current, group = (block, low, high), []
                group.append((rec, kind, tuple(form.split(" ")), left, low == high, lead))
            yield pd.DataFrame(out, columns=["a", "b", "rule"])
        yield pd.DataFrame(pairs(group), columns=["a", "b", "rule"])

    return grouped.mapInPandas(compare, "a bigint, b bigint, rule string").distinct()


def name_classes(df: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """(id, class): one row per person or organisation; ids of one class mean the same."""
    rows = checkpointed(parsed(df, key, name, kind))
    forms = checkpointed(rows.select("kind", "form").distinct().withColumn("rec", F.monotonically_increasing_id()))
    links = checkpointed(name_links(forms))
    full = connected_components(links.where("rule = 'full'").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = forms.join(full.withColumnRenamed("node", "rec"), "rec", "left").select("rec", "kind", "form", F.coalesce("component", "rec").alias("class"))
    # A form with one long token, or with a short form of several names, joins the only class it fits.
    long = F.filter(F.split("form", " "), lambda t: F.length(t) > 1)
    short = (F.size(long) == 1) | F.arrays_overlap(long, F.array(*[F.lit(x) for x in AMBIGUOUS]))
    marked = classes.withColumn("short", (F.col("kind") == "person") & short)
    weak = links.where("rule = 'initial'")
    sides = weak.select(F.col("a").alias("rec"), F.col("b").alias("other")).union(weak.select("b", "a"))
    surname = F.get(F.filter(long, lambda t: ~t.isin(*AMBIGUOUS)), F.lit(0))
    # The surname as it is written goes before one that is only alike.
    exact = F.when(F.array_contains(F.split("_full", " "), F.col("_surname")), F.col("_fit"))
    fits = (
        sides.join(marked.where("short").select("rec", surname.alias("_surname")), "rec")
        .join(marked.where("not short").select(F.col("rec").alias("other"), F.col("form").alias("_full"), F.col("class").alias("_fit")), "other")
        .groupBy("rec")
        .agg(F.coalesce(F.min(exact), F.min("_fit")).alias("_one"), F.coalesce(F.max(exact), F.max("_fit")).alias("_last"))
        .where("_one = _last")
    )
    final = marked.join(fits, "rec", "left").select("kind", "form", F.coalesce("_one", "class").alias("class"))
    return rows.join(final, ["kind", "form"]).select("id", "class").distinct()


def name_pairs(df: DataFrame, key: str, name: str, kind: str) -> DataFrame:
    """(id_a, id_b): ids id_a < id_b whose names mean the same person or organisation."""
    classes = checkpointed(name_classes(df, key, name, kind))
    left, right = classes.select("class", F.col("id").alias("id_a")), classes.select("class", F.col("id").alias("id_b"))
    return left.join(right, "class").where("id_a < id_b").select("id_a", "id_b").distinct()
