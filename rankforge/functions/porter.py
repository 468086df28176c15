"""Porter stemmer (M.F. Porter, "An algorithm for suffix stripping", 1980).

Per-word helper used by the stemming dictionary job in ``text.py``: Spark
collects the *distinct* words, this function runs once per distinct word
inside a pandas UDF, and the result is joined back. With ``extensions=True``
it also applies the widely used extension set of the NLTK implementation
(irregular forms, short words left alone, ``ies``/``ied`` on four letters,
``alli``/``fulli``/``logi`` in step 2, ``y`` -> ``i`` only after a consonant,
and a two-letter ``*o``), which is the variant a default NLTK stemmer uses.
"""

from __future__ import annotations

from functools import lru_cache

# ---- fixed values: rule tables of the published algorithm ----
IRREGULAR_FORMS = {
    "sky": ("sky", "skies"),
    "die": ("dying",),
    "lie": ("lying",),
    "tie": ("tying",),
    "news": ("news",),
    "inning": ("innings", "inning"),
    "outing": ("outings", "outing"),
    "canning": ("cannings", "canning"),
    "howe": ("howe",),
    "proceed": ("proceed",),
    "exceed": ("exceed",),
    "succeed": ("succeed",),
}
STEP2_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3_SUFFIXES = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4_SUFFIXES = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# ---- end of fixed values ----

_IRREGULAR = {form: root for root, forms in IRREGULAR_FORMS.items() for form in forms}
_VOWELS = frozenset("aeiou")


def _consonant(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _consonant(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """Number of vowel->consonant transitions, the m of [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(stem)):
        cons = _consonant(stem, i)
        if cons and prev_vowel:
            m += 1
        prev_vowel = not cons
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double_consonant(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str, extensions: bool) -> bool:
    n = len(w)
    if n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) \
            and _consonant(w, n - 1) and w[-1] not in "wxy":
        return True
    return extensions and n == 2 and not _consonant(w, 0) and _consonant(w, 1)


def _step1a(w: str, ext: bool) -> str:
    if ext and w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-2]
    if w.endswith("ss"):
        return w
    if w.endswith("s"):
        return w[:-1]
    return w


def _step1b(w: str, ext: bool) -> str:
    if ext and w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    base = None
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            base = w[: -len(suffix)]
            break
    if base is None:
        return w
    for suffix, repl in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if base.endswith(suffix):
            return base[: -len(suffix)] + repl
    if _double_consonant(base):
        return base[:-1] if base[-1] not in "lsz" else base
    if _measure(base) == 1 and _cvc(base, ext):
        return base + "e"
    return base


def _step1c(w: str, ext: bool) -> str:
    if w.endswith("y"):
        stem = w[:-1]
        ok = (len(stem) > 1 and _consonant(stem, len(stem) - 1)) if ext else _has_vowel(stem)
        if ok:
            return stem + "i"
    return w


def _step2(w: str, ext: bool) -> str:
    if ext and w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al", ext)
    for suffix, repl in STEP2_SUFFIXES:
        if not ext and suffix in ("fulli", "logi"):
            continue
        if not ext and suffix == "bli":
            suffix, repl = "abli", "able"
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if suffix == "logi" and ext:
                return stem + repl if _measure(w[:-3]) > 0 else w
            return stem + repl if _measure(stem) > 0 else w
    return w


def _step3(w: str) -> str:
    for suffix, repl in STEP3_SUFFIXES:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + repl if _measure(stem) > 0 else w
    return w


def _step4(w: str) -> str:
    for suffix in STEP4_SUFFIXES:
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if suffix == "ion":
                ok = _measure(stem) > 1 and stem[-1:] in ("s", "t")
            else:
                ok = _measure(stem) > 1
            return stem if ok else w
    return w


def _step5(w: str, ext: bool) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem, ext)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def stem(word: str, extensions: bool = True) -> str:
    """Porter stem of one lower-case word."""
    w = word.lower()
    if extensions:
        if w in _IRREGULAR:
            return _IRREGULAR[w]
        if len(w) <= 2:
            return w
    w = _step1a(w, extensions)
    w = _step1b(w, extensions)
    w = _step1c(w, extensions)
    w = _step2(w, extensions)
    w = _step3(w)
    w = _step4(w)
    return _step5(w, extensions)
