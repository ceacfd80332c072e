"""Stemming, a language guess, and the cleaning of page texts."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that tell English from Spanish, and Spanish marks.
ENGLISH = "the of and to in is that for it was with as on be by this are from or which an not have what how".split()
SPANISH = "el la los las de del que y en un una por con para es se su al como más pero sus le ya qué cómo".split()
_MARKS = "[ñáéíóúü¿¡]"


def guess_language(text: Column, english: list[str] = ENGLISH, spanish: list[str] = SPANISH) -> Column:
    """en, es or unknown, by the words and marks of each; shared words are on neither list."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    en = F.size(F.filter(words, lambda w: w.isin(english)))
    es = F.size(F.filter(words, lambda w: w.isin(spanish))) + F.regexp_count(F.lower(text), F.lit(_MARKS))
    return F.when(en > es, "en").when(es > en, "es").otherwise("unknown")


# English stemming after the published Snowball description (Porter 2).

_V = "aeiouy"
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes", "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(begin: int) -> int:
        for i in range(begin + 1, len(w)):
            if w[i] not in _V and w[i - 1] in _V:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def stem_english(word: str) -> str:
    if len(word) <= 2 or word in _SAME:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _V) else c for i, c in enumerate(word))
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _SAME:
        return w
    if w.endswith(("eed", "eedly")):
        end = "eed" if w.endswith("eed") else "eedly"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), "")
        if end and any(c in _V for c in w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            before = w[: -len(end)]
            if len(before) >= r1 and (end != "ogi" or before.endswith("l")) and (end != "li" or before[-1:] in tuple("cdeghkmnrt")):
                w = before + to
            break
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + to
            break
    for end in _STEP4:
        if w.endswith(end):
            before = w[: -len(end)]
            if len(before) >= r2 and (end != "ion" or before.endswith(("s", "t"))):
                w = before
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Spanish stemming after the published Snowball description.

_ES_V = "aeiouáéíóúü"
_PRONOUNS = sorted("me se sela selo selas selos la le lo las les los nos".split(), key=len, reverse=True)
_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ACTION = "adora ador ación acion adoras adores aciones ante antes ancia ancias".split()
_Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERBS = [v + "r" + e for v in "aei" for e in "ían ías án ás íais ía éis íamos emos á é".split()] + (
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras "
    "ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
_ACUTE = str.maketrans("áéíóú", "aeiou")


def _spanish_regions(w: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""

    def after(begin: int) -> int:
        return next((i + 1 for i in range(begin + 1, len(w)) if w[i] not in _ES_V and w[i - 1] in _ES_V), len(w))

    rv = len(w)
    if len(w) > 2:
        if w[1] not in _ES_V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] in _ES_V), len(w))
        elif w[0] in _ES_V:
            rv = next((i + 1 for i in range(2, len(w)) if w[i] not in _ES_V), len(w))
        else:
            rv = 3
    r1 = after(0)
    return rv, r1, after(r1)


def _longest(w: str, ends: list[str], begin: int = 0) -> str:
    return max((e for e in ends if w.endswith(e) and len(w) - len(e) >= begin), key=len, default="")


def _standard_suffix(w: str, r1: int, r2: int) -> str:
    """The word after the first step; the same word if nothing applies."""
    groups = [(_PLAIN, "", []), (_ACTION, "", ["ic"]), (["logía", "logías"], "log", []), (["ución", "uciones", "ucion"], "u", []), (["encia", "encias"], "ente", []), (["mente"], "", ["ante", "able", "ible"]), (["idad", "idades"], "", ["abil", "ic", "iv"]), (["iva", "ivo", "ivas", "ivos"], "", ["at"])]
    end = _longest(w, [e for ends, *_ in groups for e in ends] + ["amente"])
    if not end:
        return w
    stem = w[: -len(end)]
    if end == "amente":
        if len(stem) < r1:
            return w
        before = _longest(stem, ["iv", "os", "ic", "ad"], r2)
        stem = stem[: len(stem) - len(before)]
        return stem[:-2] if before == "iv" and stem.endswith("at") and len(stem) - 2 >= r2 else stem
    if len(stem) < r2:
        return w
    _, to, befores = next(g for g in groups if end in g[0])
    return stem[: len(stem) - len(_longest(stem, befores, r2))] + to


def stem_spanish(word: str) -> str:
    w = word
    rv, r1, r2 = _spanish_regions(w)
    pronoun = next((p for p in _PRONOUNS if w.endswith(p)), "")
    if pronoun:
        head = w[: -len(pronoun)]
        if (verb := _longest(head, ["iéndo", "ándo", "ár", "ér", "ír"], rv)) and len(head) >= rv:
            w = head[: -len(verb)] + verb.translate(_ACUTE)
        elif _longest(head, ["ando", "iendo", "ar", "er", "ir"], rv) or (head.endswith("uyendo") and len(head) - 5 >= rv):
            w = head
    first = _standard_suffix(w, r1, r2)
    if first != w:
        w = first
    elif (end := _longest(w, _Y_VERBS, rv)) and w[: -len(end)].endswith("u"):
        w = w[: -len(end)]
    elif end := _longest(w, [*_VERBS, "en", "es", "éis", "emos"], rv):
        w = w[: -len(end)]
        if end in ("en", "es", "éis", "emos") and w.endswith("gu"):
            w = w[:-1]
    if end := _longest(w, ["os", "a", "o", "á", "í", "ó", "e", "é"], rv):
        w = w[: -len(end)]
        if end in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


STEMMERS = {"en": stem_english, "es": stem_spanish}


# Cleaning: lines that repeat at the edges of pages go, and hyphens at line ends are decided by what
# else the document has.

_END, _START = re.compile(r"[^\W\d_](?:[\w-]*[^\W\d_])?-$"), re.compile(r"[^\W\d_]+")


def clean_pages(pages: list[str], edge: int = 2, share: float = 0.5) -> list[str]:
    """Texts of a document's pages on one line each. A first or last line that more than ``share`` of
    three or more pages have (numbers aside) is removed. A hyphen at a line end stays if the compound
    is elsewhere in the document, goes if the joined word is, stays if both parts are words there,
    and else goes."""
    split = [[x.strip() for x in p.splitlines() if x.strip()] for p in pages]
    shape = lambda x: re.sub(r"\d+", "0", x)
    if len(split) >= 3:
        seen = Counter(s for lines in split for s in {shape(x) for x in lines[:edge] + lines[-edge:]})
        often = {s for s, n in seen.items() if n > share * len(split)}
        split = [[x for i, x in enumerate(lines) if not (shape(x) in often and (i < edge or i >= len(lines) - edge))] for lines in split]
    forms = {w.casefold() for lines in split for x in lines for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*(?!-?$)", x)}
    parts = {p for w in forms for p in w.split("-")}
    out = []
    for lines in split:
        text = ""
        for x in lines:
            head, tail = re.search(r"[\w-]*-$", text), _START.match(x)
            if head and tail and _END.search(text):
                a, b = head[0][:-1].casefold(), tail[0].casefold()
                keeps = f"{a}-{b}" in forms or (a + b not in forms and len(b) > 2 and {a.rsplit("-", 1)[-1], b} <= parts)
                text = (text if keeps else text[:-1]) + x
            else:
                text = f"{text} {x}" if text else x
        out.append(text)
    return out


def cleaned(df: DataFrame, key: str, pages: str) -> DataFrame:
    """(key, page, text) of documents with an array of page texts."""

    @F.pandas_udf("array<string>")
    def clean(column):
        return column.map(lambda p: clean_pages([x or "" for x in p]) if p is not None else [])

    return df.select(key, F.posexplode(clean(F.col(pages))).alias("page", "text"))
