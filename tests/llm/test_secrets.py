import hashlib
import random
import re
import string
import time

from cases import SCHEMA, odd, rows, table
from newsmill.llm.queries import op3_secret_scans
from newsmill.llm.secrets import KINDS, find_secrets, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def known(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text)
              if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def test_known_shapes_against_brute_force(spark):
    rng = random.Random(1)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", " ", ":", "=", '"', "'",
             "abc", "AKIA", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef0123456789abcdef", "é", "\U0001F600",
             "\n", "deadbeef", "x", "/+._-", "ſ", "K"]
    found = rows(["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(800)])
    got = find_secrets(table(spark, found)).collect()
    texts = {i: t for i, t, *_ in found}
    assert len(got) == len(found)
    assert all([tuple(s) for s in r.base] == known(texts[r.doc_id]) for r in got)


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits + "+/"
    planted = {i: "".join(rng.choice(letters) for _ in range(44)) for i in range(200)}
    words = ("supercalifragilisticexpialidocious antidisestablishmentarianism-and-others "
             "https://example.com/this/is/a/long/path/to/something abcabcabcabcabcabcabcabcabc "
             "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa abcdefghijklmnopqrstuvwxyz0123456789 "
             "donaudampfschifffahrtsgesellschaft aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd")
    found = rows([f"the value {v} is here" for v in planted.values()]) + rows([words] * 200, 1000)
    hit = false = 0
    for r in find_secrets(table(spark, found)).collect():
        if r.doc_id in planted:
            at = f"the value {planted[r.doc_id]} is here".index(planted[r.doc_id])
            hit += any((s.start, s.end) == (at, at + 44) for s in r.random)
        else:
            false += len(r.random)
    assert hit >= 190 and false == 0


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"token={i:06d}x é " for i in range(100_000))
    began = time.perf_counter()
    row = find_secrets(table(spark, rows([text]))).first()
    assert [tuple(s) for s in row.base] == known(text) and len(row.base) == 100_000
    assert time.perf_counter() - began < 60


def test_matches_at_the_ends_of_blocks(spark):
    found = rows(["token=abcdef " * n + "end" for n in (1, 127, 128, 129, 256, 257)])
    texts = {i: t for i, t, *_ in found}
    for r in find_secrets(table(spark, found)).collect():
        assert [tuple(s) for s in r.base] == known(texts[r.doc_id])


def test_odd_rows_and_empty_table(spark):
    got = find_secrets(table(spark, odd())).select("doc_id", written("base").alias("w")).collect()
    assert len(got) == len(odd()) and all(r.w == "" for r in got)
    assert find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_columns_against_brute_force(spark, tmp_path):
    """Counts are by kind, wherever a span stands in its text."""
    access, hexes = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef0123456789abcdef"
    found = rows([access, hexes, f"{hexes} {access}", f"token=abcdef {access} {hexes} {hexes}",
                  f"token=abcdef secret: 'abcdef' passwd=short password=x {access}", "none", "", None])
    table(spark, found).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_secret_scans(spark, str(tmp_path))
    assert got.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    texts = {i: t for i, t, *_ in found}
    for r in got.collect():
        base = known(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_padding_after_one_symbol(spark):
    found = rows(["x" + "=" * 30, "A" + "=" * 19 + " token=abcdef", "0" + "=" * 200])
    texts = {i: t for i, t, *_ in found}
    for r in find_secrets(table(spark, found)).collect():
        assert [tuple(s) for s in r.base] == known(texts[r.doc_id]) and not r.random
