"""English stemmer (Porter's second algorithm), written from its published description."""

from __future__ import annotations

import functools
import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Exceptional forms.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(word: str, start: int) -> int:
    m = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V and w[-1] not in "wxY"


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w in _SAME:
        return w
    w = w.lstrip("'")
    w = re.sub(rf"(^|[{_V}])y", r"\1Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.lower()
    for s in ("eedly", "eed"):
        if w.endswith(s):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(f"[{_V}]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ogi" or w[at - 1 : at] == "l") and (s != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
