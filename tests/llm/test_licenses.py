import random
import textwrap
import time

from cases import SCHEMA, odd, rows, table
from newsmill.llm.licenses import (
    GAP, MARKS, RULES, SENTENCES, Found, _table, licences, scan_licences, sentences)

TABLE = _table()


def of(text):
    return [f.key for f in licences(sentences(text, TABLE))]


def test_every_known_sentence_passes_the_first_look():
    assert all(any(m in s for m in MARKS) for s in TABLE)


def test_every_rule_is_found_in_its_own_text():
    for name, keys in RULES:
        parts = [SENTENCES[k][0] if k in SENTENCES else f"Released under {k[6:]}." for k in keys]
        if not any(k.startswith("named:") for k in keys):
            for text in ("\n\n".join(parts), "\n\n".join(textwrap.fill(p, 50) for p in parts),
                         "Some prose first.\n" + "\n".join(f" * {p}" for p in parts)):
                assert of(text) == [name], (name, text)


def test_references():
    assert of("no stop before this\nReleased under the MIT License.") == ["MIT"]
    assert of("Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert of("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert of("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert of("// SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert of("The driver's licence was renewed under protest. All rights reserved.") == []


def test_order_and_gaps_matter():
    grant, notice = SENTENCES["mit-grant"][0], SENTENCES["mit-notice"][0]
    assert of(f"{grant}\n\n{notice}") == ["MIT"]
    assert of(f"{notice}\n\n{grant}") == []
    between = "\n\n".join([SENTENCES["copyright"][0]] * 6)
    assert of(f"{grant}\n\n{between}\n\n{notice}") == []


def test_holders_by_name():
    keys = next(k for name, k in RULES if name == "BSD-3-Clause")
    for holder in ("Foo Inc.", "the University of Bar, Baz", "Dr. A. Person Ltd.", "<organization>"):
        parts = [SENTENCES[k][0] for k in keys]
        parts[3] = parts[3].replace("the copyright holder", holder)
        parts[4] = parts[4].replace("THE COPYRIGHT HOLDERS", holder.upper())
        for text in ("\n\n".join(parts), "\n".join(textwrap.fill(p, 50) for p in parts),
                     "Some prose first.\n" + "\n".join(f" * {p}" for p in parts)):
            assert [f.key for f in sentences(text, TABLE)] == list(keys), text
            assert of(text) == ["BSD-3-Clause"], text
    isc = [SENTENCES["isc-grant"][0], SENTENCES["isc-warranty"][0].replace("THE AUTHOR", "FOO INC.")]
    assert [f.key for f in sentences(" ".join(isc), TABLE)] == ["isc-grant", "isc-warranty"]
    other = "Neither the name of the rose. Released under the MIT License. Nor the names of others."
    assert of(other) == ["MIT"]


def test_unknown_sentences_count_for_gaps():
    grant, notice = SENTENCES["mit-grant"][0], SENTENCES["mit-notice"][0]
    def some(n):
        return " ".join(["Prose goes on here."] * n)

    assert of(f"{grant}\n\n{some(4)}\n\n{notice}") == ["MIT"]
    assert of(f"{grant}\n\n{some(5)}\n\n{notice}") == []
    assert of(f"{grant}\n\n1. 2. 3. 4. 5. 6. {notice}") == ["MIT"]
    assert of(f"{grant}\n\n{'no stop at all ' * 1000}\n\n{notice}") == []
    assert of(f"{grant}\n\n{some(5000)}\n\n{notice}\n\n{grant}\n\n{notice}") == ["MIT"]


def test_rows(spark):
    found = rows(["x.\nReleased under the MIT License.", "Licensed under CC BY-NC 4.0."], 50) + odd()
    got = scan_licences(table(spark, found)).collect()
    assert len(got) == len(found)
    assert {r.doc_id: (r.n_sentences, r.licenses, r.spans) for r in got if r.n_sentences} == {
        50: (1, "MIT", "MIT:3:34"), 51: (1, "CC-BY-NC-4.0", "CC-BY-NC-4.0:0:28")}
    assert scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []


def plainly(found):
    """Rules over the list of sentences that are still free, which is made anew after every match."""
    free, matched = list(range(len(found))), []
    for name, keys in RULES:
        again = True
        while again:
            again = False
            for i in range(len(free)):
                taken, at = [], i
                for key in keys:
                    if not taken:
                        hits = [i] if found[free[i]].key == key else []
                    else:
                        last = found[free[taken[-1]]].nth + 1 + GAP
                        hits = [j for j in range(taken[-1] + 1, len(free))
                                if found[free[j]].nth <= last and found[free[j]].key == key]
                    if not hits:
                        break
                    taken.append(hits[0])
                if len(taken) == len(keys):
                    matched.append((found[free[taken[0]]].start, found[free[taken[-1]]].end, name))
                    free = [x for j, x in enumerate(free) if j not in taken]
                    again = True
                    break
    return sorted(matched)


def test_rules_against_brute_force():
    rng = random.Random(6)
    used = sorted({k for _, keys in RULES for k in keys})
    for _ in range(400):
        keys = rng.choice(RULES)[1] + rng.choice(RULES)[1] + tuple(rng.choice(used) for _ in range(rng.randrange(6)))
        keys = [k for k in keys if rng.random() < 0.9]
        if rng.random() < 0.3:
            rng.shuffle(keys)
        nth, found = 0, []
        for i, key in enumerate(keys):
            nth += rng.choice((1, 1, 1, 2, 3, 7))
            found.append(Found(10 * i, 10 * i + 9, key, nth))
        assert [(f.start, f.end, f.key) for f in licences(found)] == plainly(found)


def test_sentences_against_brute_force():
    """Every known sentence of a text made of known ones and others, with its place."""
    rng = random.Random(7)
    listed = [(key, s) for key, some in SENTENCES.items() for s in some]
    for _ in range(60):
        parts = [rng.choice(listed) if rng.random() < 0.6 else (None, "Some words that say nothing at all.")
                 for _ in range(rng.randrange(12))]
        text, want = "", []
        for key, part in parts:
            if key:
                want.append((len(text), key))
            text += part + rng.choice(("\n\n", "\n \n", "\n\n\n"))
        got = [(f.start, f.key) for f in sentences(text, TABLE)]
        assert [k for _, k in got] == [k for _, k in want]
        assert all(a <= b for (a, _), (b, _) in zip(want, got))


def test_very_many_licences_in_one_text(spark):
    notice = f"{SENTENCES['mit-grant'][0]}\n\n{SENTENCES['mit-notice'][0]}\n\n"
    began = time.perf_counter()
    row = scan_licences(table(spark, rows([notice * 20_000]))).first()
    assert row.n_sentences == 40_000 and row.spans.count("MIT:") == 20_000
    assert time.perf_counter() - began < 60
