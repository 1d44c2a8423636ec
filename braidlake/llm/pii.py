"""Personal information inside free text (problem 1).

Method: anchor expansion. One Aho-Corasick pass over the lower-cased text finds anchors: at-signs and
their spelled-out forms, schemes, digits, identifier cues, street words, given names, titles, initials, and
words after which a person is named. At each anchor a deterministic local parser expands to the item's
borders and validates it: addresses by their parts, account numbers (type ACCOUNT) by their check digits, names
by context and form, so that a name need not stand in any list. Nothing else of the text is looked at, so the cost
is one automaton pass plus a constant amount of work per anchor.

Defined results: null, empty and blank texts have no items; texts are scanned whole, whatever their
length; of items that overlap the one of the stronger type stays (EMAIL, ACCOUNT, ADDRESS, ID_NUMBER, PHONE, NAME),
then the earlier start, then the longer one; repeated rows give equal rows, which `pii_items` makes distinct.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import spread

# Common given names of the languages at hand.
GIVEN_NAMES = """
alexander amina anna benjamin björn bruno celeste chloé christopher clara daniel dario david deborah edward elena
elizabeth émile fatima felix francisco frederick gabriel giuseppe greta gustav hanna hiro hugo ingrid irena isolde ivo
james joaquín johannes jonas josephine katherine kirsten lars leila leonard lucía luise marek margaret maria marie
martin mateo matthew mei michael nadia nicholas noor olga omar otto paola patricia paul pavel petra priya quentin
rafael rebecca richard robert rosa ruth samuel simon sofía stephanie susan tara theodore thomas timothy tobias tomasz
ulrich ursula vera viktor victoria walter wanda william xenia yara yusuf zoë zoltan john mary peter jane laura
sarah julia emma sophie pierre jean claire carlos juan ana lukas karl heinrich hans anders ahmed ali chen wei
tom tim sam rob bob kate liz nick mike matt ben dan alex fred ed bill will max kim iris
""".split()
# Words that follow a given name in names of institutions, places and works, never in a person's name.
NOT_SURNAMES = """
peak basin method line lake marsh ridge reef road street avenue ave lane drive court rd st square station quarter
institute institution laboratory lab department society association academy university college foundation consortium
archive museum hospital press company office group project survey observatory library center centre school church
valley bay canal river island isle port mount mountain hill bridge tower park garden forest field coast county city
town village district province act treaty law ballad ledger almanac reader viewer expedition conference prize award
report notes chapter section team club union bank hotel theatre theater opera
""".split()
# Words that start a sentence or clause and are therefore capitalised without being names.
STARTERS = """
the a an this that these those its their his her our your my some every each another one no all any both who whose what
which when where why how is are was were did does do can could should would will may might has have had in on at by for
from to of with without within under over above across after before behind beside besides between beyond during near
next inside outside instead because although though while whoever if and or but so as about around against along among
according please thanks thank list show summarise summarize compare explain give tell ask call contact reply write
mail ship send find see note dear regards signed subject answer indexing ticket invoice reference temperature room
coordinates chapter section figure social security passport phone tel email le la les un une des du au aux il elle ils
que qui quand pourquoi comment pendant dans sur sous avec sans pour par je me mon ma mes vous nous el los las una unos
en con sin por para y yo mi su sus qué cuándo cómo quién dónde der die das ein eine einen dem den des im am vom zum zur
wer was wann warum wie wo mit nach bei ohne gegen für auf aus ich sie er es wir trotz während wegen seit numéro
document documento there here then now also however overall interview vivo not very so just still only quite rather
""".split()
# Titles before a name.
TITLES = "mr mrs ms miss dr prof sir madame monsieur herr frau señor señora sr sra mme capt".split()
# Labels and phrases after which a name must follow, with the punctuation that links them.
NAME_CUES = (
    "my name is ", "name=", "name: ", "full name: ", "contact: ", "signed: ", "signed by ", "regards,\n", "sincerely,\n", "cheers,\n", "thanks,\n", '"author": "', '"holder": "', '"name": "', '"owner": "', "author: ", "holder: ", "owner: ", "attn: ", "patient: ", "client: ",
    "me llamo ", "mi nombre es ", "je m'appelle ", "je suis ", "ich heiße ", "mein name ist ", "ich bin ", "mi chiamo ", "dear ", "au nom de ", "a nombre de ", "en nombre de ", "im namen von ", "on behalf of ",
)
#: Those of them that can't be followed by anything else, so that a name in lower case is read as one.
LABELS = ("name=", "name: ", "contact: ", "signed: ", "regards,\n", "sincerely,\n", '"author": "', '"holder": "', '"name": "', '"owner": "', "author: ", "holder: ", "owner: ", "attn: ", "patient: ", "client: ")
# Words after which a person may be named.
PERSON_CUES = """
to for by with from tell told ask asked meet met contact call called thank thanks email and für von mit bei und durch de par avec chez pour à et con por para y di da per saw inform notify send envoyez
colleague doctor nurse teacher professor student client customer patient employee manager director author writer president chairman minister officer neighbour neighbor friend brother sister cousin uncle aunt wife husband son daughter
""".split()
# Those of them that lead to other things as well, and verbs of motion, after which a place follows.
LOOSE_CUES = frozenset("to for by with from and für von mit bei und durch de par avec chez pour à et con por para y di da per".split())
MOTION = re.compile(r"\b(?:mov|went|go|going|goes|came|com|flew|fl[yi]|travel|trip|drive|drove|driv|walk|ran|return|way|visit|journey|train|road|route|ship|sail)\w*\b[^.!?\n]*$", re.I)
#: A public byte-level vocabulary; its lower-case words are common ones.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Verbs and turns after a person's name.
PERSON_VERBS = ("said", "says", "wrote", "writes", "asked", "replied", "lives", "lived", "works", "worked", "called", "signed", "told", "explained", "thinks", "phoned", "emailed", "is", "was", "has", "had", "will", "sagte", "schrieb", "wohnt", "écrit", "habite", "vive", "dijo", "escribió")
# Words before a capitalised word that make it a place or institution.
PLACE_BEFORE = frozenset("lake saint st port mount isle bay the san santa upper lower old new north south east west great little fort cape rue via calle avenida upper".split())
# Given names that are common words; in lower case they are read as names nowhere.
COMMON_WORDS = frozenset("will bill max mark rob iris fred dan tim ben mike nick kim rosa noor tara vera clara irena paul yara".split()) - {"noor", "tara", "vera", "clara", "irena", "yara", "rosa", "paul"}
# Cues before numbers that identify a person.
ID_CUES = ("passport", "reisepass", "pasaporte", "passeport", "social security", "sécurité sociale", "seguridad social", "sozialversicherungsnummer", "national id", "identity card", "identity number", "personalausweis", "ssn", "dni", "nif", "nie ", "nino", "tax id", "steuer-id", "steuernummer")
# Street words of English, French, Spanish and German; the German ones end a compound.
STREET_AFTER = "street st avenue ave road rd lane ln drive dr court ct boulevard blvd square sq terrace place pl way close crescent row gardens".split()
STREET_BEFORE = "rue avenue place boulevard chemin allée quai impasse calle avenida plaza paseo camino carrer via viale piazza".split()
STREET_END = "straße strasse allee weg platz gasse ring damm ufer".split()
STREET_SHORT = frozenset("st dr pl sq ct way row close place via".split())
AT_FORMS = ("@", "[at]", "(at)", "{at}", "<at>", " at ", "[@]", "(@)", " arroba ")

UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĻĽŁŃŅŇŌŐŘŚŞŠŤŪŮŰŲŹŻŽ"
NAME_TOKEN = rf"(?:[{UP}]['’])?[{UP}][^\W\d_]+(?:['’\-](?!s\b)[{UP}]?[^\W\d_]+)*"
INITIAL = rf"[{UP}]\.?"
LOCAL = re.compile(r"[\w.+%\-]+$")
DOMAIN = re.compile(r"[^\W_](?:[\w\-]*[^\W_])?(?:(?:\.| ?[\[({<]dot[\])}>] ?| dot |\[\.\]|\(\.\))[^\W_](?:[\w\-]*[^\W_])?)+")
AFTER_GIVEN = re.compile(rf"((?:-{NAME_TOKEN})?)((?:[ \t ]{INITIAL}(?=[ \t ]))*)[ \t ]({NAME_TOKEN})")
AFTER_INITIAL = re.compile(rf"[{UP}]\.[ \t ]?(?:[{UP}]\.[ \t ]?)*({NAME_TOKEN})")
BEFORE_COMMA = re.compile(rf"(?<![\w'’\-])({NAME_TOKEN}),[ \t ]?$")
BEFORE_PLAIN = re.compile(rf"(?<![\w'’\-])({NAME_TOKEN})[ \t ]$")
LOWER_NAME = re.compile(r"([^\W\d_]{2,}(?:-[^\W\d_]{2,})?)((?:[ \t][^\W\d_]\.)*)[ \t]([^\W\d_]{3,}(?:['’\-][^\W\d_]+)*)(?![\w@])")
LOWER_REST = re.compile(r"(?:-[^\W\d_]{2,})?((?:[ \t][^\W\d_]\.)*)[ \t]([^\W\d_]{3,}(?:['’\-][^\W\d_]+)*)(?![\w@])")
ENDS = re.compile(r"[ \t]*(?:$|[\n.,;:!?\"<>|)(]|[ \t](?:and|und|et|y|e|i)[ \t])")
PAIR_BEFORE = re.compile(rf"(?<![\w'’\-.])({NAME_TOKEN})((?:[ \t]{INITIAL}(?=[ \t]))*)[ \t]({NAME_TOKEN})$")
CUED = re.compile(rf"({NAME_TOKEN}|[{UP}]\.)(,?)((?:[ \t]{INITIAL}(?=[ \t]))*)[ \t]({NAME_TOKEN}|[{UP}]\.)")
TITLE_RUN = re.compile(rf"(?:(?:{'|'.join(TITLES)})\.?[ \t]+)*", re.I)
PARTICLE = r"(?:(?:de|du|des|de la|de las|de los|del|la|le|les|d['’])[ \t]*)?"
HOUSE_BEFORE = re.compile(r"(?<![\w./:\-])(\d{1,5}[a-zA-Z]?(?:[ \-]?(?:bis|ter))?)(,?[ \t])$")
SIDE = r"(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West|Upper|Lower|Old|New|Great|Little|Saint|St)\.?"
STREET_NAME = re.compile(rf"(?<![\w.\-])(\d{{1,5}}[a-zA-Z]?)[ \t]((?:{SIDE}[ \t]+)*{NAME_TOKEN}(?:[ \t]{NAME_TOKEN}){{0,2}})[ \t]$")
BEFORE_REST = re.compile(rf"[ \t]+{PARTICLE}{NAME_TOKEN}(?:[ \t](?:{PARTICLE}){NAME_TOKEN}){{0,2}}")
HOUSE_AFTER = re.compile(r",?[ \t](?:(?:n[oº°]\.?|nº|no\.|num\.?|número|#)[ \t]*)?(\d{1,4}[a-zA-Z]?)(?![\w/\-.:]*\d)(?!\w)")
COMPOUND = re.compile(rf"(?<![\w])[{UP}][^\W\d_\-]*(?:-[{UP}][^\W\d_\-]*)*$")

# Published shapes of telephone numbers (international, North American, British, French, German).
PHONES = re.compile(
    r"""\+\d{1,3}(?:[ .\-]?\(0\))?(?:[ .\-]?\(\d{1,5}\))?(?:[ .\-/]?\d{1,12}){1,6}
    | \(\+?\d{2,5}\)[ .\-]?\d{3,4}(?:[ .\-]?\d{2,4}){1,2}
    | (?:1[ .\-])?\d{3}[.\-]\d{3}[.\-]\d{4}
    | 00\d{2}(?:[ .\-]?\d{2,5}){2,5}
    | 0\d(?:[ .\-]?\d\d){4}
    | 0\d{4}[ \-]?\d{3}[ \-]?\d{3}
    | 0\d{2,4}[ /\-]\d{3,8}(?:[ \-]\d{1,5}){0,2}
    """,
    re.X,
)
# Published shapes of identity, social security and passport numbers.
IDENTITIES = re.compile(
    r"""\d{3}-\d{2}-\d{4} | \d{3}[ ]\d{2}[ ]\d{4}
    | \d{8}-?[A-Za-z] | [XYZ]-?\d{7}-?[A-Z]
    | \d{3}\.\d{3}\.\d{3}-\d{2}
    | \d{6}[-+]\d{4}
    | [A-Za-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Da-d]
    | [A-Z]{2}\d{7} | [A-Z]\d{8} | [A-Z]{2}\d{6}[A-Z]?
    | [12][ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{2}
    """,
    re.X,
)
ID_VALUE = re.compile(r"(?:[ \t]*(?:no\.?|nr\.?|n[oº°]\.?|number|nummer|número|numéro|card|is|ist|es|est|:|#))*[ \t]*([A-Za-z]{0,3}[ \-]?(?:\d{1,4}[ .\-]){0,5}\d[\dA-Za-z]{0,13})(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\w])|\d{4}[ \-]?\d{6}[ \-]?\d{5}(?![\w])")
NOT_IDS = re.compile(r"\b(?:isbn|issn|ticket|invoice|doi|chunk|hash|version|build|coordinates)[ :#.]{0,3}$")

_SOFT = (" ", "\t", " ")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=2)
def common_words(path: str) -> frozenset[str]:
    """Lower-case words that are single tokens of a public vocabulary; without them names come out otherwise, so a file
    that is missing or holds none is an error."""
    with open(path, "rb") as file:
        tokens = (base64.b64decode(line.split()[0]) for line in file)
        words = (t[1:].decode("utf-8", "ignore") for t in tokens if t[:1] == b" ")
        found = frozenset(w for w in words if w.isalpha() and w.islower())
    if not found:
        raise ValueError(f"no words in the vocabulary {path}")
    return found


class Scanner:
    """The automaton and the local parsers; one is built in each Python worker.

    `vocabulary` is a file of a public tokenizer: capitalised words that are common in lower case are no unlisted names.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import ahocorasick

        self.common = common_words(vocabulary)

        self.given = frozenset(GIVEN_NAMES)
        self.blocked = frozenset(NOT_SURNAMES) | frozenset(STARTERS)
        self.cues = frozenset(PERSON_CUES)
        anchors: dict[str, str] = {}
        for x in AT_FORMS:
            anchors[x] = "at"
        for x in "0123456789":
            anchors[x] = "digit"
        for x in self.given:
            anchors[x] = "given"
        for x in self.cues:
            anchors[x + " "] = "person"
        for x in PERSON_VERBS:
            anchors[" " + x] = "verb"
        anchors["'s"] = anchors["’s"] = "verb"
        for x in NAME_CUES:
            anchors[x] = "cue"
        for x in LABELS:
            anchors[x] = "label"
        for x in TITLES:
            anchors[x + " "] = anchors[x + ". "] = "title"
        for x in ID_CUES:
            anchors[x] = "id"
        for x in "abcdefghijklmnopqrstuvwxyzéèáóúíöäüßøåñç":
            anchors[x + ". "] = anchors.get(x + ". ", "initial")
        for x in STREET_AFTER:
            anchors[" " + x] = "street"
        for x in STREET_BEFORE:
            anchors[x + " "] = "rue"
        for x in STREET_END:
            anchors[x + " "] = anchors[x + ", "] = "compound"
        self.automaton = ahocorasick.Automaton()
        for x, kind in anchors.items():
            self.automaton.add_word(x, (kind, len(x)))
        self.automaton.make_automaton()

    def items(self, text: str | None) -> list[tuple[str, int, int]]:
        """(type, start, end) of each item, in order; [] for null or blank text."""
        if not text or text.isspace():
            return []
        low, found, number_end = _lower(text), [], -1
        for last, (kind, size) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            if kind == "digit":
                if start < number_end:
                    continue
                item, number_end = self._number(text, low, start)
            elif kind == "at":
                item = self._email(text, start, end)
            elif kind == "given":
                item = self._given(text, start, end)
            elif kind == "initial":
                item = self._initial(text, start)
            elif kind in ("cue", "label"):
                item = self._cued(text, end, kind == "label") or self._lower_cued(text, low, start, end, kind == "label")
            elif kind == "title":
                item = None if start and low[start - 1].isalnum() else self._cued(text, end) or self._lower_cued(text, low, start, end, True)
            elif kind == "person":
                item = None if start and low[start - 1].isalnum() else self._person(text, start, end)
            elif kind == "verb":
                item = None if end < len(low) and low[end].isalnum() else self._before_verb(text, start)
            elif kind == "id":
                item = None if start and low[start - 1].isalnum() else self._identity(text, low, end)
            elif kind == "street":
                item = self._street(text, start, end)
            elif kind == "rue":
                item = self._rue(text, start, end)
            else:
                item = self._compound(text, start, end)
            if item:
                found.append(item)
        return self._settled(found)

    @staticmethod
    def _settled(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Drops what lies inside or across an item of a stronger type, or of the same type and earlier start.

        Kept items never overlap, so a new one is compared with its two neighbours in order only.
        """
        rank = {"EMAIL": 0, "ACCOUNT": 1, "ADDRESS": 2, "ID_NUMBER": 3, "PHONE": 4, "NAME": 5}
        out: list[tuple[int, int, str]] = []
        for kind in sorted({k for k, _, _ in found}, key=rank.get):
            mine: list[tuple[int, int, str]] = []
            for _, start, end in sorted({x for x in found if x[0] == kind}, key=lambda x: (x[1], -x[2])):
                at = bisect_left(out, (start, 0, ""))
                if (at and out[at - 1][1] > start) or (at < len(out) and out[at][0] < end) or (mine and mine[-1][1] > start):
                    continue
                mine.append((start, end, kind))
            out = sorted([*out, *mine])
        return [(kind, start, end) for start, end, kind in out]

    def _email(self, text: str, start: int, end: int):
        left, right = start, end
        spelled = text[start:end].strip() != "@"
        if spelled or (start and text[start - 1] in _SOFT):
            while left and text[left - 1] in _SOFT:
                left -= 1
        while right < len(text) and text[right] in _SOFT:
            right += 1
        local = LOCAL.search(text, max(0, left - 80), left)
        domain = DOMAIN.match(text, right)
        if not local or not domain:
            return None
        if text[start:end].strip().lower() in ("at", "arroba") and "dot" not in domain.group().lower():
            return None
        if text[start:end] == "@" and ((left < start) != (right > end)):
            return None
        begin = local.start()
        if text[max(0, begin - 3) : begin] == "://" or ":" in text[begin:left]:  # user part of a web address
            return None
        while begin < left and text[begin] in ".-+%":
            begin += 1
        top = re.split(r"[^\w\-]+", domain.group())[-1]
        return ("EMAIL", begin, domain.end()) if begin < left and top.isalpha() and len(top) > 1 else None

    def _number(self, text: str, low: str, at: int):
        """The number around the digit at `at`, and where its run ends."""
        run = at
        while run < len(text) and (text[run].isalnum() or (text[run] in " .-/()+" and run + 1 < len(text) and (text[run + 1].isdigit() or text[run + 1] in "(+")) or (text[run] == ")" )):
            run += 1
        if at and text[at - 1].isdigit():
            return None, at + 1
        starts = [at]
        back = at
        if back and text[back - 1] in "(+":
            back -= 1
            if back and text[back] == "(" and text[back - 1] == "+":
                back -= 1
            if back and text[back] == "+" and text[back - 1] == "(":
                back -= 1
            starts.insert(0, back)
        letters = at
        while letters and at - letters < 3 and (text[letters - 1].isalpha() or (text[letters - 1] == " " and letters == at)):
            letters -= 1
        head = text[letters:at].strip()
        if 0 < len(head) <= 2 and head.isalpha() and head.isascii() and not (letters and text[letters - 1].isalnum()):
            starts.append(letters)
        if NOT_IDS.search(low, max(0, at - 24), at):
            return None, self._token_end(text, at)
        for begin in (at, *starts):
            account = (CARD if begin == at else IBAN).match(text, begin)
            if account and (not begin or not text[begin - 1].isalnum() and text[begin - 1] not in "-/."):
                if self._account(account.group()):
                    return ("ACCOUNT", begin, account.end()), account.end()
                if begin != at and len(account.group()) >= 15:  # an account number with a slip, not a telephone number
                    return None, account.end()
        for begin in starts:
            previous = text[begin - 1] if begin else " "
            if previous.isalnum() or previous in "-/.@#+" and begin == at:
                continue
            m = IDENTITIES.match(text, begin)
            if m and self._ends(text, m.end()) and not re.fullmatch(r"\d{3}[- ](?:00[- ]\d{4}|\d{2}[- ]0000)", m.group()):  # empty groups are never given out
                return ("ID_NUMBER", begin, m.end()), m.end()
            m = PHONES.match(text, begin)
            while m and not self._ends(text, m.end()):
                cut = max(text.rfind(x, begin, m.end()) for x in " .-/")
                m = PHONES.fullmatch(text, begin, cut) if cut > begin else None
            if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                return ("PHONE", begin, m.end()), m.end()
        return None, at + 1 if at == run else self._token_end(text, at)

    @staticmethod
    def _account(value: str) -> bool:
        """Check digits: remainder 1 by 97 for international account numbers, the doubling sum for card numbers."""
        plain = re.sub(r"[ \-]", "", value)
        if plain[0].isalpha():
            return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        digits = [int(c) for c in reversed(plain)]
        return 13 <= len(digits) <= 19 and any(digits) and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0

    @staticmethod
    def _identity(text: str, low: str, end: int):
        """The number after an identifier cue, whatever its shape."""
        m = ID_VALUE.match(text, end)
        if not m or IDENTITIES.match(text, m.start(1)) or PHONES.match(text, m.start(1)):  # known shapes have their own anchors
            return None
        return ("ID_NUMBER", m.start(1), m.end()) if sum(c.isdigit() for c in m.group(1)) >= 5 else None

    @staticmethod
    def _token_end(text: str, at: int) -> int:
        while at < len(text) and text[at].isdigit():
            at += 1
        return at

    @staticmethod
    def _ends(text: str, end: int) -> bool:
        if end >= len(text):
            return True
        c, after = text[end], text[end + 1] if end + 1 < len(text) else " "
        return not (c.isalnum() or c == "_" or (c in "-/" and after.isalnum()) or (c in ".:" and after.isdigit()) or c == "@")

    def _surname(self, token: str) -> bool:
        return len(token) > 2 and all(len(part) < 2 or part.lower() not in self.blocked for part in re.split(r"[-'’]", token))

    def _lower(self, text: str, start: int, end: int):
        """A given name in lower case: a name only after a cue, before a verb of persons, between commas or alone in a field, with a word that may be a surname."""
        if start and (text[start - 1].isalnum() or text[start - 1] in "_-@.'’") or text[start:end] in COMMON_WORDS:
            return None
        m = LOWER_REST.match(text, end)
        if not m or m.group(2).lower() in self.blocked or m.group(2).lower() in self.cues:
            return None
        prefix = text[max(0, start - 30) : start]
        word = re.search(r"([^\W\d_]+)\.?[ \t]+$", prefix)
        rest = text[m.end() : m.end() + 3].lstrip(" \t")
        between = prefix.endswith(", ") and rest[:1] == "," or prefix.rstrip(" \t")[-1:] in ("|", ";", '"') and rest[:1] in ("|", ";", '"')
        verb = re.match(r"[ \t]([^\W\d_]+)", text[m.end() : m.end() + 20])
        told = verb and verb.group(1) in PERSON_VERBS
        return ("NAME", start, m.end()) if between or told or word and word.group(1).lower() in self.cues else None

    def _lower_cued(self, text: str, low: str, start: int, at: int, label: bool):
        """A name in lower case after a cue: two words that are no common ones; after a phrase, a known given name or an end."""
        if start and low[start].isalpha() and low[start - 1].isalnum():
            return None
        at = TITLE_RUN.match(text, at).end()
        m = LOWER_NAME.match(text, at)
        if not m or not m.group(1).islower() or any(t.lower() in self.blocked or t.lower() in self.cues for t in (m.group(1), m.group(3))):
            return None
        known = m.group(1).split("-")[0] in self.given
        return ("NAME", at, m.end()) if known or ENDS.match(text, m.end()) and (label or low[start:at].startswith(("my name", "me llamo", "je m'app", "ich hei", "mein name", "mi nombre", "mi chiamo"))) else None

    def _paired(self, first: str, last: str, loose: bool) -> bool:
        """Whether two capitalised words may be a person's name by their form: they are no place or institution, and at most
        one is a common word, none where the context is loose."""
        if first.lower() in PLACE_BEFORE or not all(self._surname(t) and not t.isupper() for t in (first, last)):
            return False
        return sum(t.lower() in self.common for t in (first, last)) <= (not loose)

    def _person(self, text: str, start: int, at: int):
        """Two capitalised words after a word that names persons."""
        if at >= len(text) or not text[at].isupper():
            return None
        begin = TITLE_RUN.match(text, at).end()
        m = CUED.match(text, begin)
        loose = text[start : at - 1].lower() in LOOSE_CUES and begin == at
        if not m or m.group(2) or min(len(m.group(1)), len(m.group(4))) < 3 or not self._paired(m.group(1), m.group(4), loose):
            return None
        if loose and MOTION.search(text, max(0, start - 60), start):
            return None
        word = re.match(rf"(?:[ \t]|[ \t]?-)({NAME_TOKEN})", text[m.end() : m.end() + 30])
        return None if word and word.group(1).lower() not in STARTERS else ("NAME", begin, m.end())

    def _before_verb(self, text: str, end: int):
        """Two capitalised words before a verb of saying or living."""
        m = PAIR_BEFORE.search(text, max(0, end - 60), end)
        if not m or not self._paired(m.group(1), m.group(3), True):
            return None
        word = re.search(r"(\S+)[ \t]$", text[max(0, m.start() - 20) : m.start()])
        return None if word and word.group(1)[0].isupper() and word.group(1).lower().rstrip(".") not in TITLES else ("NAME", m.start(), end)

    def _given(self, text: str, start: int, end: int):
        if text[start].islower():
            return self._lower(text, start, end)
        if not text[start].isupper() or (start and (text[start - 1].isalnum() or text[start - 1] in "_-@.'’")):
            return None
        if end < len(text) and (text[end].isalnum() or text[end] in "_@.'’" and text[end : end + 2].strip(".'’ \n") != ""):
            return None
        prefix = text[max(0, start - 60) : start]
        full = re.match(rf"(?:-{NAME_TOKEN})?(?![^\W_])", text[end : end + 40])
        stop = end + (full.end() if full else 0)
        m = BEFORE_COMMA.search(prefix)
        if m and self._surname(m.group(1)) and m.group(1).lower() not in self.given:
            begin = start - (len(prefix) - m.start(1))
            ahead = AFTER_GIVEN.match(text, end)
            if not (ahead and self._surname(ahead.group(3))) or not self._plain_before(text, begin):
                return ("NAME", begin, self._initials(text, stop))
        m = BEFORE_PLAIN.search(prefix)
        if m and m.group(1).isupper() and len(m.group(1)) > 3 and self._surname(m.group(1)) and not text[start:end].isupper():
            return ("NAME", start - (len(prefix) - m.start(1)), self._initials(text, stop))
        if m and m.group(1).lower() in ("lake", "saint", "st", "port", "mount", "isle", "bay", "the", "san", "santa"):
            return None
        m = AFTER_GIVEN.match(text, end)
        if not m or not self._surname(m.group(3)) or m.group(3).isupper() != text[start:end].isupper() and len(m.group(3)) < 4:
            return None
        after = text[m.end() : m.end() + 25]
        word = re.match(rf"[ \t]({NAME_TOKEN})", after)
        if word and word.group(1).lower() in NOT_SURNAMES:
            return None
        return ("NAME", start, m.end())

    @staticmethod
    def _initials(text: str, end: int) -> int:
        m = re.match(rf"(?:[ \t][{UP}]\.)*", text[end : end + 12])
        return end + m.end()

    @staticmethod
    def _plain_before(text: str, begin: int) -> bool:
        """Whether what stands before `begin` allows a name to start there rather than a list of words."""
        return begin == 0 or text[begin - 1] in ' \t\n"=<|(:'

    def _initial(self, text: str, start: int):
        if not text[start].isupper() or (start and (text[start - 1].isalnum() or text[start - 1] in "_-.'’")):
            return None
        prefix = text[max(0, start - 60) : start]
        m = BEFORE_COMMA.search(prefix)
        if m and self._surname(m.group(1)) and m.group(1).lower() not in self.given and not AFTER_INITIAL.match(text, start):
            return ("NAME", start - (len(prefix) - m.start(1)), start + 2)
        m = AFTER_INITIAL.match(text, start)
        if not m or not self._surname(m.group(1)):
            return None
        token = re.search(r"(\S+)[ \t]$", prefix)
        if token and (token.group(1)[-1:].isdigit() or token.group(1)[0].isupper() and token.group(1).lower() in self.given | {"figure", "appendix", "section", "part", "vitamin"}):
            return None
        street = re.match(rf"(?:[ \t]{NAME_TOKEN}){{0,2}}[ \t]({'|'.join(STREET_AFTER)})(?!\w)", text[m.end() : m.end() + 60], re.I)
        if street:
            return None
        return ("NAME", start, m.end())

    def _cued(self, text: str, at: int, label: bool = False):
        """A name after a cue. After a label it is one whatever follows; else a word of places or institutions forbids it."""
        while at < len(text) and text[at] in " \t":
            at += 1
        at = TITLE_RUN.match(text, at).end()
        m = CUED.match(text, at)
        if not m:
            return None
        first, comma, last = m.group(1), m.group(2), m.group(4)
        if not comma and m.group(4).endswith(".") and len(last) == 2 and not first.isupper():
            return None
        if any(not (len(t) == 2 and t.endswith(".")) and not self._surname(t) for t in (first, last)):
            return None
        word = re.match(rf"[ \t]({NAME_TOKEN})", text[m.end() : m.end() + 25])
        if word and not label and word.group(1).lower() in NOT_SURNAMES:
            return None
        return ("NAME", at, m.end())

    def _street(self, text: str, start: int, end: int):
        """`12 West Xyz Street`: the anchor is the street word with the blank before it."""
        if end < len(text) and (text[end].isalnum() or text[end] == "-"):
            return None
        word = text[start + 1 : end]
        if word.lower() in STREET_SHORT and not word[0].isupper():
            return None
        m = STREET_NAME.search(text, max(0, start - 70), start + 1)
        if m:
            return ("ADDRESS", m.start(1), end)
        m = re.search(rf"(?:{SIDE}[ \t]+)*{NAME_TOKEN}$", text[max(0, start - 50) : start])
        house = HOUSE_AFTER.match(text, end + (text[end : end + 1] == "."))
        if m and house and word[0].isupper() and "," not in text[end : house.start(1)]:
            return ("ADDRESS", max(0, start - 50) + m.start(), house.end())
        return None

    def _rue(self, text: str, start: int, end: int):
        """`12 rue de Xyz` or `Calle Xyz 12`: the anchor is the street word with the blank after it."""
        if start and (text[start - 1].isalnum() or text[start - 1] in "-'’"):
            return None
        name = BEFORE_REST.match(text, end - 1)
        if not name:
            return None
        house = HOUSE_BEFORE.search(text, max(0, start - 12), start)
        if house:
            return ("ADDRESS", house.start(1), name.end())
        house = HOUSE_AFTER.match(text, name.end())
        return ("ADDRESS", start, house.end()) if house else None

    def _compound(self, text: str, start: int, end: int):
        """`Xyzstraße 12`: the anchor is the ending with the blank after it."""
        stop = end - 1 - (text[end - 2] == ",")
        m = COMPOUND.search(text, max(0, start - 60), start)
        if not m or m.start() == start:
            return None
        house = HOUSE_AFTER.match(text, stop)
        if house:
            return ("ADDRESS", m.start(), house.end())
        house = HOUSE_BEFORE.search(text, max(0, m.start() - 12), m.start())
        return ("ADDRESS", house.start(1), stop) if house else None

    def masked(self, text: str | None) -> str | None:
        """The text with each item replaced by `[TYPE]`; null stays null."""
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end in self.items(text):
            out += [text[at:start], f"[{kind}]"]
            at = end
        return "".join([*out, text[at:]])


_SCANNER: Scanner | None = None


def scanner() -> Scanner:
    """The worker's scanner, built once."""
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


def pii_items(df: DataFrame, key: str, text: str, tab: str) -> DataFrame:
    """(tab, row_id, pii_type, char_start, char_end) of each item, distinct.

    Only `key` and `text` are read. Rows with a null key keep a null row_id. There is no shuffle but the
    one that makes rows distinct, which carries items and no texts.
    """
    source = spread(df.select(F.col(key).alias("row_id"), F.col(text).alias("content")).where(F.col("content").isNotNull()))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = scanner()
        for batch in batches:
            rows = [(i, k, s, e) for i, t in zip(batch["row_id"], batch["content"]) for k, s, e in scan.items(t)]
            yield pd.DataFrame(rows, columns=["row_id", "pii_type", "char_start", "char_end"])

    kind = source.schema["row_id"].dataType.simpleString()
    out = source.mapInPandas(found, f"row_id {kind}, pii_type string, char_start bigint, char_end bigint")
    return out.withColumn("tab", F.lit(tab)).select("tab", "row_id", "pii_type", "char_start", "char_end").distinct()


def mask_pii(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds column `into`: the text with typed placeholders. Null stays null, all other columns stay."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        scan = scanner()
        return pd.Series([scan.masked(t) for t in texts], dtype=object)

    return df.withColumn(into, masked(F.col(text)))
