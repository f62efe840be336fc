"""English word stems by the published Porter algorithm (1980), for search over stemmed tokens.

Only distinct tokens of a batch are stemmed; words other than lower-case ASCII letters stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of steps 2, 3 and 4 of the algorithm.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def kinds(word: str) -> str:
    """``v`` or ``c`` for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel: m of the published rules."""
    return kinds(word).count("vc")


def ends_short(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y at the end (*o of the rules)."""
    return kinds(word).endswith("cvc") and word[-1] not in "wxy"


def replaced(word: str, steps: tuple[tuple[str, str], ...], over: int) -> str:
    """The longest suffix that fits is replaced if the measure before it is over ``over``."""
    for end, by in sorted(steps, key=lambda x: -len(x[0])):
        if word.endswith(end):
            root = word[: -len(end)]
            whole = end != "ion" or root.endswith(("s", "t"))
            return root + by if whole and measure(root) > over else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word, by the steps 1a to 5b."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        end = next((e for e in ("ed", "ing") if w.endswith(e)), "")
        if end and "v" in kinds(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and kinds(w).endswith("cc") and w[-1] not in "lsz":
                w = w[:-1]
            elif measure(w) == 1 and ends_short(w):
                w += "e"
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(w, STEP2, 0), STEP3, 0)
    w = replaced(w, tuple((end, "") for end in STEP4), 1)
    if w.endswith("e"):
        root = w[:-1]
        if measure(root) > 1 or (measure(root) == 1 and not ends_short(root)):
            w = root
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def _stems(tokens: pd.Series) -> pd.Series:
    known = {t: stem(t) for t in tokens.dropna().unique()}
    return tokens.map(known)


def stemmed(token: Column) -> Column:
    return F.pandas_udf(_stems, "string")(token)
