"""The suffix stripper as SQL over a vocabulary: one common table expression for each step.

Whether a letter is a vowel depends on the letters before it only, so a word's shape (one ``v`` or
``c`` a letter) holds the shapes of all its beginnings, and the measure of a base is the number of
``vc`` in the beginning of that shape.
"""

# Words with a stem of their own.
OWN_STEMS = """('sky', 'sky'), ('skies', 'sky'), ('dying', 'die'), ('lying', 'lie'), ('tying', 'tie'),
    ('news', 'news'), ('innings', 'inning'), ('inning', 'inning'), ('outings', 'outing'),
    ('outing', 'outing'), ('cannings', 'canning'), ('canning', 'canning'), ('howe', 'howe'),
    ('proceed', 'proceed'), ('exceed', 'exceed'), ('succeed', 'succeed')"""
# Suffix and replacement of the second, third and fourth step.
SECOND = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful"))
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", ""))
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti",
          "ous", "ive", "ize", "al", "er", "ic", "ou")

SHAPE = """list_reduce(list_prepend('', string_split(w, '')), lambda s, l: s || CASE
      WHEN l IN ('a', 'e', 'i', 'o', 'u') OR (l = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END)"""


def _measure(cut: int) -> str:
    """Measure of the word without its last letters."""
    base = f"left(s, length(w) - {cut})"
    return f"((length({base}) - length(replace({base}, 'vc', ''))) // 2)"


def _swap(suffix: str, new: str, least: int) -> str:
    """Part of a CASE: the first suffix that fits decides, whether or not the base is long enough."""
    n = len(suffix)
    return (f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_measure(n)} >= {least} "
            f"THEN left(w, length(w) - {n}) || '{new}' ELSE w END")


def _swaps(rules, least=1) -> str:
    return "CASE " + "\n    ".join(_swap(s, new, least) for s, new in rules) + " ELSE w END"


def _fourth() -> str:
    """Longer suffixes come first: a word that ends in one is not tried with a shorter one."""
    kept = lambda suffix: f"AND left(right(w, {len(suffix) + 1}), 1) IN ('s', 't') " if suffix == "ion" else ""
    return "CASE " + "\n    ".join(
        f"WHEN ends_with(w, '{s}') THEN CASE WHEN {_measure(len(s))} > 1 {kept(s)}"
        f"THEN left(w, length(w) - {len(s)}) ELSE w END" for s in FOURTH) + " ELSE w END"


#: consonant, vowel, consonant at the end, the last none of w, x and y; or a vowel and a consonant alone
SHORT_END = "((right(s, 3) = 'cvc' AND right(w, 1) NOT IN ('w', 'x', 'y')) OR s = 'vc')"
DOUBLE = "(length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(s, 1) = 'c')"

PLURAL = """CASE WHEN ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
    WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2)
    WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END"""
# what is left when -ed or -ing goes is marked with a plus, to be mended by the next step
PAST = f"""CASE WHEN ends_with(w, 'ied') THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
    WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(3)} > 0 THEN left(w, length(w) - 1) ELSE w END
    WHEN ends_with(w, 'ed') AND contains(left(s, length(w) - 2), 'v') THEN left(w, length(w) - 2) || '+'
    WHEN ends_with(w, 'ing') AND contains(left(s, length(w) - 3), 'v') THEN left(w, length(w) - 3) || '+'
    ELSE w END"""
MENDED = f"""CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e'
    WHEN {DOUBLE} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE left(w, length(w) - 1) END
    WHEN {_measure(0)} = 1 AND {SHORT_END} THEN w || 'e' ELSE w END"""
FINAL_Y = """CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND left(right(s, 2), 1) = 'c'
    THEN left(w, length(w) - 1) || 'i' ELSE w END"""
# -alli gives -al, which may be an ending of this step again
ALLI = f"CASE WHEN ends_with(w, 'alli') AND {_measure(4)} > 0 THEN left(w, length(w) - 2) ELSE w END"
LOGI = f"""CASE WHEN ends_with(w, 'logi') THEN CASE WHEN {_measure(3)} > 0 THEN left(w, length(w) - 1) ELSE w END
    ELSE {_swaps(SECOND)} END"""
FINAL_E = f"""CASE WHEN ends_with(w, 'e') AND ({_measure(1)} > 1 OR ({_measure(1)} = 1 AND NOT (
    (left(right(s, 4), 3) = 'cvc' AND length(s) > 3 AND left(right(w, 2), 1) NOT IN ('w', 'x', 'y'))
    OR left(s, length(s) - 1) = 'vc'))) THEN left(w, length(w) - 1) ELSE w END"""
FINAL_L = f"CASE WHEN ends_with(w, 'll') AND {_measure(1)} > 1 THEN left(w, length(w) - 1) ELSE w END"


def stems(source: str) -> str:
    """CTEs ending in ``stems(token, stem)`` for the column ``token`` of a CTE with distinct tokens.

    Tokens of up to three letters are their own stems.
    """
    steps = [("plural", PLURAL), ("past", PAST), ("mended", MENDED), ("final_y", FINAL_Y), ("alli", ALLI),
             ("second", LOGI), ("third", _swaps(THIRD)), ("fourth", _fourth()), ("final_e", FINAL_E),
             ("final_l", FINAL_L)]
    out = [f"own_stems(token, stem) AS (VALUES {OWN_STEMS})",
           f"""stem_begin AS (SELECT token, token AS w FROM {source}
  WHERE length(token) > 3 AND token NOT IN (SELECT token FROM own_stems))"""]
    before = "stem_begin"
    for name, rule in steps:
        word = "rtrim(w, '+') AS w, ends_with(w, '+') AS cut" if name == "mended" else "w, false AS cut"
        out.append(f"stem_{name} AS (SELECT token, {rule} AS w FROM (SELECT token, w, cut, {SHAPE} AS s\n"
                   f"  FROM (SELECT token, {word} FROM {before})))")
        before = f"stem_{name}"
    out.append(f"""stems AS (SELECT token, w AS stem FROM {before} UNION ALL
  SELECT v.token, coalesce(o.stem, v.token) FROM {source} v LEFT JOIN own_stems o ON o.token = v.token
    AND length(v.token) > 3 WHERE length(v.token) <= 3 OR o.token IS NOT NULL)""")
    return ",\n".join(out)
