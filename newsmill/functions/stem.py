"""English suffix stripping after M. F. Porter, "An algorithm for suffix stripping" (1980),
with the usual later additions: a few irregular words, ``-ied``, ``-ies`` in short words,
``-fulli``, ``-bli``, ``-logi``, and ``y`` kept after a vowel or in two-letter stems."""

# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# Suffix -> replacement, tried in this order.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP_3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word):
    """One letter per character: v(owel) or c(onsonant)."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word):
    shape = _shape(word)
    return sum(1 for a, b in zip(shape, shape[1:]) if a == "v" and b == "c")


def _has_vowel(word):
    return "v" in _shape(word)


def _double(word):
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word):
    shape = _shape(word)
    return (shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _swap(word, rules, least):
    for suffix, new in rules:
        if word.endswith(suffix):
            base = word[:len(word) - len(suffix)]
            return base + new if _measure(base) >= least else word
    return word


def _plural(word):
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word):
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        base = word[:len(word) - len(suffix)]
        if word.endswith(suffix) and _has_vowel(base):
            break
    else:
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _double(base):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if _measure(base) == 1 and _cvc(base) else base


def _final_y(word):
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _step_2(word):
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step_2(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, STEP_2, 1)


def _step_4(word):
    for suffix in STEP_4:
        if word.endswith(suffix):
            base = word[:len(word) - len(suffix)]
            longer = [s for s in STEP_4 if len(s) > len(suffix) and word.endswith(s)]
            if longer:
                continue
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                return base
            return word
    return word


def _step_5(word):
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _final_y(_past(_plural(word)))
    return _step_5(_step_4(_swap(_step_2(word), STEP_3, 1)))


def remembering(limit: int = 200_000):
    """``stem`` with a memory of its own; texts repeat a small vocabulary."""
    known: dict[str, str] = {}

    def look_up(word: str) -> str:
        found = known.get(word)
        if found is None:
            if len(known) >= limit:
                known.clear()
            found = known[word] = stem(word)
        return found
    return look_up
