"""Broken prompt and response pairs (problem 7).

Method: prompt and response are aligned as token sequences. Copies of the question show in the containment of
3-word shingles and in the longest common subsequence; refusals in the alignment of the answer's sentences with refusal
templates, wherever they stand. Quoted and reported refusals are somebody else's and don't count. Empty and cut-off
answers are told by their form, languages by script, frequent words and letters.

Defects, of which a row gets the first that holds: `empty`, `refusal`, `copy`, `truncated`, `other_language`.

Defined results: rows with an error are no answers and left out; a null answer is `empty`; against a null or blank
question an answer can be neither `copy` nor `other_language`; answers are read whole; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.runtime import spread

# A word; characters of scripts without blanks are words each.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+(?:['’][^\W_]+)?")
# Answers that say nothing, in lower case without punctuation.
FILLERS = frozenset(
    """none null nil na n/a nan undefined unknown empty blank tbd todo nothing no answer|no response|not available|not applicable|no data|no result
    keine|keine antwort|keine angabe|nichts|aucun|aucune|aucune réponse|sans réponse|rien|ninguno|ninguna|nada|sin respuesta|ninguna respuesta""".replace("\n    ", "|").split("|")
) | frozenset("none null nil na nan undefined unknown empty blank tbd todo nothing".split()) | {"n a", "no answer", "answer none", "answer n a"}
LABELS = frozenset("answer a response reply output result antwort réponse respuesta assistant final".split()) | {"the answer", "the answer is", "final answer", "my answer"}
# Templates of refusals, the words that carry them, in lower case.
REFUSALS = tuple(
    tuple(_WORD.findall(x))
    for x in (
        "i cannot answer", "i can't answer", "i can not answer", "i cannot provide", "i can't provide", "i cannot respond", "i can't respond", "i cannot say", "i am unable to", "i'm unable to", "i am not able to", "i'm not able to",
        "i won't be able to", "i will not be able to", "i must decline", "i have to decline", "i decline to", "i must refuse", "i refuse to", "i'd rather not", "i would rather not", "i prefer not to", "i'd prefer not to",
        "i don't have enough information", "i do not have enough information", "i don't have sufficient information", "i lack the information", "i have no information", "i don't know", "i do not know", "i have no answer",
        "there is not enough information to", "there isn't enough information to", "not sufficient for me to", "not enough for me to", "context does not contain enough", "context doesn't contain enough", "no answer can be given", "no answer is possible from",
        "this cannot be answered from", "outside what i may", "outside what i can", "outside what i am", "beyond what i may", "beyond what i can", "i can't help", "i cannot help", "i can't assist", "i cannot assist", "i'm afraid i can't", "i am afraid i cannot",
        "i can't share", "i cannot share", "i am not allowed to", "i'm not allowed to", "i am not permitted to", "i'm not permitted to", "i cannot comment", "i can't comment", "i can't discuss", "i cannot discuss", "i won't answer", "i will not answer",
        "kann ich nicht helfen", "kann ich nicht beantworten", "ich kann diese frage nicht", "ich kann das nicht beantworten", "darf ich keine auskunft geben", "kann ich keine auskunft geben", "kann ich nichts sagen", "liegen mir keine informationen vor",
        "ich bin nicht in der lage", "ich darf diese frage nicht", "ich möchte mich dazu nicht", "ich habe nicht genügend informationen", "mir fehlen die informationen", "kann ich nicht dienen", "ich muss die antwort ablehnen", "darüber darf ich nicht", "ich weiß es nicht",
        "je ne peux pas répondre", "je ne peux pas vous aider", "je ne peux pas vous", "je ne suis pas en mesure", "il m'est impossible de", "je ne saurais répondre", "je préfère ne pas", "je refuse de", "je ne dispose pas", "je n'ai pas assez d'informations",
        "je ne suis pas autorisé", "je dois décliner", "je regrette de ne pas pouvoir", "je ne sais pas",
        "no puedo responder", "no puedo ayudar", "no puedo ayudarle", "no puedo contestar", "no me es posible", "no estoy en condiciones de", "no dispongo de información", "no tengo información suficiente", "no tengo suficiente información", "prefiero no responder", "me niego a", "no estoy autorizado", "debo rechazar", "no lo sé",
        "non posso rispondere", "non posso aiutarti", "non posso aiutarla", "non posso aiutare", "non sono in grado di", "non mi è possibile", "non dispongo di informazioni", "non ho abbastanza informazioni", "non ho informazioni sufficienti", "preferisco non rispondere", "mi rifiuto di", "devo rifiutare", "non lo so",
        "não posso responder", "não posso ajudar", "não me é possível", "não sou capaz de", "não tenho informações suficientes", "prefiro não responder", "não consigo responder", "recuso-me a", "não sei responder",
        "ik kan deze vraag niet", "ik kan u niet helpen", "ik kan je niet helpen", "daar kan ik niet", "ik ben niet in staat", "ik heb niet genoeg informatie", "ik mag daar niet", "ik geef liever geen antwoord",
        "я не могу ответить", "я не могу помочь", "не могу ответить на", "не могу помочь", "я не в состоянии", "у меня недостаточно информации", "у меня нет информации", "я не знаю", "я отказываюсь",
        "我无法回答", "我不能回答", "我无法提供", "我不能提供", "无法回答", "抱歉我不能", "我不知道", "没有足够的信息", "お答えできません", "わかりません",
    )
)
# Verbs that report what somebody said.
_REPORTING = frozenset("said says say told tells replied replies wrote writes claimed claims answered answers stated states sagte sagt schrieb antwortete erklärte dit disait répondit écrit répondu dijo dice respondió escribió disse dice rispose respondeu zei schreef сказал сказала ответил ответила".split())
# Frequent short words by language.
COMMON = {
    "en": "the a of and to in that was his it with is for as had on this these those their its not which because another every some one without under behind inside although after before while what who why when where how did does says about been would have an by from were are they he she at text according write summarize",
    "de": "der die das und ist nicht ein eine einen dem den des zu mit sich auf für im von war als auch nach wie aus bei ohne wegen trotz unter weil aber obwohl während über wurde hat was wer wann warum wo steht zum zur gegen vor dass ich",
    "fr": "le la les et est pas un une des du de il elle dans que qui sur au aux pour avec sans sous ce cette son sa ses ne plus par alors mais parce puisque pendant près quand pourquoi dit où à été vers malgré depuis cause texte après avant très cet ces leur dont chez",
    "es": "el la los las y es no un una unos de del que en por con sin para su sus se al lo como más pero porque aunque mientras cerca bajo durante hacia qué cuándo quién dónde cómo dice sobre fue ha texto vez pesar segundo muchos después antes muy este esta hasta desde",
    "it": "il lo la gli le e è non un una uno di del della dei delle che in per con senza da dal dalla al alla su sul sulla si ma perché come anche più quando dove chi cosa questo questa suo sua loro ha era stato nel nella dopo prima durante molto",
    "pt": "o os as e é não um uma de do da dos das que em no na nos nas por para com sem ao à se mas porque como também mais quando onde quem este esta seu sua foi tem depois antes durante muito pelo pela isso você",
    "nl": "de het een en is niet van in op te dat die voor met zijn aan er maar om ook als dan bij nog naar uit door over heeft werd hebben wat wie waar wanneer waarom hoe deze dit zonder omdat tijdens onder achter tussen hij zij ik",
    "pl": "i w na z do nie się że jest to od za po przez jak ale lub przy dla który która które był była było są ma oraz gdy gdzie kto co dlaczego kiedy tego tej bez pod nad przed między",
    "sv": "och i att det som en ett på är av för med den till inte har de om var men från så när vid eller hon han efter under över mellan utan hade skulle vad vem varför hur detta denna sin sitt",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
# English words before a noun; a short phrase that starts with one is a proper answer.
#: Letters that speak for a language in words that aren't capitalised.
_LETTERS = {"de": frozenset("äöüß"), "fr": frozenset("àâæçèéêëîïôœùû"), "es": frozenset("áéíñóú¿¡"), "en": frozenset(), "it": frozenset("àèéìòù"), "pt": frozenset("ãõáâàçéêíóôú"), "nl": frozenset("ëï"), "pl": frozenset("ąćęłńóśźż"), "sv": frozenset("åäö")}
_DETERMINERS = frozenset("the a an this that these those its their his her our my your some any every each another one no both all".split())
# Words that cannot end a complete phrase.
_OPEN = frozenset("the a an and or of to in on at by for with from because since although while which that its their some every another such as than der die das und oder von zu in mit für weil le la les et ou de du des un une à dans que el los las y o del una en con por".split())
_END = re.compile(r"[.!?。！？؟।]+[\"'»”’)\]*_」]*$|[\"»”」]$")
_LIST = re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s+\S")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _words(text: str) -> list[str]:
    return [w.replace("’", "'") for w in _WORD.findall(text.lower())]


def _bare(text: str) -> str:
    """Text without invisible characters and outer white space."""
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t\r").strip()


def is_empty(answer: str) -> bool:
    core = " ".join(re.findall(r"[^\W_]+", answer.lower()))
    return not core or core in FILLERS or core in LABELS


def _unquoted(text: str) -> str:
    """The text without its quoted parts, or the text itself if nothing else is there."""
    plain = re.sub(r"[\"“«„][^\"”»“]*[\"”»“]", " ", text)
    return plain if _WORD.search(plain) else text


def is_refusal(answer: str, share: float = 0.85) -> bool:
    """Whether a refusal template aligns with a sentence of the answer, at any place, within the template's length plus two
    words. Only templates whose words the answer holds are aligned; quoted and reported speech is left out."""
    plain = _unquoted(answer)
    whole = set(_words(plain))
    likely = [(t, share * len(t)) for t in REFUSALS if sum(w in whole for w in t) >= share * len(t)]
    if not likely:
        return False
    for sentence in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n", plain):
        words = _words(sentence)
        known = set(words)
        for template, least in likely:
            n = len(template)
            if sum(w in known for w in template) < least:
                continue
            for at in range(len(words)):
                if words[at] in template and lcs(list(template), words[at : at + n + 2]) >= least and _REPORTING.isdisjoint(words[:at]):
                    return True
    return False


def is_copy(question: str, answer: str) -> bool:
    q, a = _words(question), _words(answer)
    if len(q) < 3 or len(a) < 3:
        return bool(q) and q == a
    of_q = {tuple(q[i : i + 3]) for i in range(len(q) - 2)}
    of_a = [tuple(a[i : i + 3]) for i in range(len(a) - 2)]
    contained = sum(x in of_q for x in of_a) / len(of_a)
    back = len(of_q & set(of_a)) / len(of_q)
    if contained >= 0.7 and back >= 0.7:
        return True
    if len(a) > 2 * len(q) + 4:
        return False
    common = lcs(q, a)
    return common >= 0.85 * len(q) and (common >= 0.85 * len(a) or common >= len(a) - 2 and common >= 0.75 * len(a))


def is_truncated(answer: str) -> bool:
    if answer.endswith(("…", "...")):
        return True
    if _END.search(answer):
        return False
    words = _words(answer)
    lines = answer.strip().split("\n")
    if len(lines) > 1 and all(_LIST.match(x) for x in lines) or len(lines) == 1 and _LIST.match(answer) and len(words) < 12:
        return words[-1] in _OPEN
    if answer[-1] in ",;:(-–—/":
        return True
    inner = re.search(r"[^\W\d_]{3,}[.!?]\s+[\"'«“¿¡(]?[^\W\d_]", answer)
    if inner:
        return True
    if words[-1] in _OPEN and len(words) > 1:
        return True
    return not (words[0] in _DETERMINERS or len(words) <= 4) if len(words) <= 10 else True


def language_scores(text: str) -> dict[str, int]:
    """Evidence for each language: its frequent words, and small words with its letters. Quoted parts don't count."""
    plain = _unquoted(text)
    words = _words(plain)
    small = [w for w in _WORD.findall(plain) if w[0].islower()]
    tokens = [p for w in words for p in (w, *([w.split("'")[0], w.split("'")[1]] if "'" in w else []))]
    return {k: sum(w in own for w in tokens) + sum(not _LETTERS[k].isdisjoint(w) for w in small) for k, own in _COMMON.items()}


def in_other_language(question: str, answer: str) -> bool:
    """Whether script or words of the answer speak for another language: one that leads the question's own by 2 points."""
    of_q, of_a = script(question), script(answer)
    if of_q and of_a and of_q != of_a and {of_q, of_a} != {"han", "kana"}:
        return True
    first, second = sorted(((n, k) for k, n in language_scores(question).items()), reverse=True)[:2]
    scores = language_scores(answer)
    return first[0] > second[0] and max(scores.values()) >= scores[first[1]] + 2


# Blocks of letters by script; those without blanks between words and those with.
SCRIPTS = (("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3))


def script(text: str, least: int = 4) -> str | None:
    """The script of most letters outside quotes; None where there are fewer than `least` letters or no script has 60 %."""
    counts: dict[str, int] = {}
    total = 0
    for c in _unquoted(text):
        if c.isalpha():
            total += 1
            name = "latin" if c < "\u0250" else next((s for s, low, high in SCRIPTS if low <= ord(c) <= high), "other")
            counts[name] = counts.get(name, 0) + 1
    most = max(counts, key=counts.get, default=None)
    return most if total >= least and counts[most] >= 0.6 * total else None


def defect(question: str | None, answer: str | None) -> str | None:
    """The first defect of a pair, or None for a proper answer."""
    plain = _bare(answer or "")
    if not plain or is_empty(plain):
        return "empty"
    if is_refusal(plain):
        return "refusal"
    asked = _bare(question or "")
    if asked and is_copy(asked, plain):
        return "copy"
    if is_truncated(plain):
        return "truncated"
    if asked and len(_words(plain)) >= 3 and in_other_language(asked, plain):
        return "other_language"
    return None


def answer_defects(df: DataFrame, key: str, question: str, answer: str, error: str | None) -> DataFrame:
    """(id, defect) of every defective row without an error, distinct."""
    rows = df.where(F.col(error).isNull()) if error else df
    source = spread(rows.select(F.col(key).alias("_key"), F.col(question).alias("_q"), F.col(answer).alias("_a")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, d) for k, q, a in zip(batch["_key"], batch["_q"], batch["_a"]) if (d := defect(q, a))]
            yield pd.DataFrame(rows, columns=["id", "defect"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInPandas(run, f"id {kind}, defect string").distinct()
