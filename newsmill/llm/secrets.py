"""Secrets in texts: known shapes, and strings that a battery of randomness tests finds.

All of it is Column expressions. A long run of letters an encoding could use is a candidate. Its
encoding is inferred, its symbols are numbered in that encoding, and tested: chi-squared for the
uniformity of symbols and of kinds of symbols, the number of runs below and above the middle, and
the correlation of neighbours. A candidate is a secret when together these tests do not speak
against a random string, and when its symbols are too even for text of that length: the chance of
such evenness in text is tested with false discoveries controlled among the candidates of the same
encoding and about the same length.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsmill.operators.pin import pin

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 6
BLOCK = 128  # matches that are placed together

SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
#: Name, pattern of the whole candidate, symbols in order, symbol evenness of text (sum of squared
#: shares), and the sizes of the kinds of symbols, in the order digits, small, large, others.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)=*$", DIGITS + "abcdef", 0.12, (10, 6, 0, 0)),
    ("base32", r"^[A-Z2-7]+=*$", SYMBOLS.upper() + "234567", 0.066, (6, 0, 26, 0)),
    ("base36", r"^([a-z0-9]+|[A-Z0-9]+)=*$", DIGITS + SYMBOLS, 0.066, (10, 26, 0, 0)),
    ("base64", r"^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$",
     SYMBOLS.upper() + SYMBOLS + DIGITS + "+/", 0.062, (10, 26, 26, 2)),
)
FOLDED = ("hex", "base36")  # encodings written in small or in large letters
AGAINST_RANDOM = 18.47  # 0.999 quantile of chi-squared with four degrees of freedom
FALSE_SHARE = 0.01
FINEST = 90  # smallest chance told apart, in tenths of powers of ten


def _once(value: Column, use) -> Column:
    """``use`` applied to a value that is computed one time only."""
    return F.get(F.transform(F.array(value), use), 0)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches from left to right: start and end in characters, and the value of ``group``.

    What lies between the matches tells where they start. Matches are placed ``BLOCK`` by
    ``BLOCK`` from the start of their block, and blocks after each other, so that no fold drags a
    long array along: the work grows with the matches, however many a text has.
    """
    span = "struct<start:int,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def block(m, number):
        def step(done, i):
            begin = done["at"] + F.length(F.get(m["gaps"], i))
            end = begin + F.length(F.get(m["all"], i))
            one = F.struct(begin.alias("start"), end.alias("end"), F.get(m["values"], i).alias("value"))
            return F.struct(end.alias("at"), F.array_append(done["found"], one).alias("found"))

        first = number * BLOCK
        last = F.least(first + BLOCK, F.size(m["all"])) - 1
        return F.aggregate(F.sequence(first, last), F.struct(
            F.lit(0).alias("at"), none.alias("found")), step)

    def follow(done, made):
        return F.struct((done["at"] + made["at"]).alias("at"),
                        F.array_append(done["starts"], done["at"]).alias("starts"))

    def shifted(blocks):
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(
            "array<int>").alias("starts")), follow, lambda done: done["starts"])
        return F.flatten(F.zip_with(blocks, starts, lambda made, at: F.transform(
            made["found"], lambda s: F.struct(
                (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))

    def found(m):
        numbers = F.sequence(F.lit(0), F.floor((F.size(m["all"]) - 1) / BLOCK).cast("int"))
        return _once(F.transform(numbers, lambda number: block(m, number)), shifted)

    matches = F.struct(F.split(text, pattern, -1).alias("gaps"),
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                       F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    return F.when(text.rlike(pattern), _once(matches, found)).otherwise(none)


def known(text: Column) -> Column:
    """Spans of the known shapes, by start and then kind: array of (start, kind, end)."""
    def named(kind, spans):
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    assigned = F.filter(places(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= MIN_VALUE)
    return F.array_sort(F.concat(named(0, assigned), named(1, places(text, ACCESS)),
                                 named(2, places(text, HEX))))


def _phi(z: Column) -> Column:
    """Standard normal distribution function, by a rational approximation."""
    x = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (
        -1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _encoding(candidate: Column) -> Column:
    """What is known of the first encoding that fits; null if none does."""
    found = F.lit(None)
    for name, pattern, symbols, even, kinds in reversed(ENCODINGS):
        known_as = F.struct(
            F.lit(name).alias("name"), F.lit(symbols).alias("symbols"), F.lit(even).alias("even"),
            F.array(*[F.lit(float(k)) for k in kinds]).alias("kinds"))
        found = F.when(candidate.rlike(pattern), known_as).otherwise(found)
    return found


def _uneven(value: Column, n: Column, symbols: Column, size: Column) -> Column:
    """Chi-squared of the symbols against equal shares."""
    squares = F.aggregate(F.split(symbols, ""), F.lit(0.0), lambda sum_, s: sum_ + F.pow(
        n - F.length(F.replace(value, s, F.lit(""))), F.lit(2)))
    return size / n * squares - n


def _uneven_kinds(value: Column, n: Column, kinds: Column, size: Column) -> Column:
    """Normalised chi-squared of digits, small letters, large letters and others."""
    letters = F.array(*[F.lit(x) for x in (DIGITS, SYMBOLS, SYMBOLS.upper(), "+/")])
    parts = F.filter(F.zip_with(letters, kinds, lambda x, k: F.struct(
        (n - F.length(F.call_function("translate", value, x, F.lit("")))).alias("c"),
        (n * k / size).alias("e"))), lambda x: x["e"] > 0)
    free = F.size(parts) - 1.0
    chi = F.aggregate(parts, F.lit(0.0), lambda sum_, x: sum_ + F.pow(
        x["c"] - x["e"], F.lit(2)) / x["e"])
    return (chi - free) / F.sqrt(2 * free)


def _uneven_runs(value: Column, n: Column, symbols: Column, size: Column) -> Column:
    """Normalised number of runs below and above the middle of the alphabet."""
    half = F.floor(size / 2).cast("int")
    marks = F.concat(F.repeat(F.lit("l"), half), F.repeat(F.lit("h"), (size - half).cast("int")))

    def normal(sides):
        turns = (2 * n - F.length(F.replace(sides, F.lit("lh"), F.lit("")))
                 - F.length(F.replace(sides, F.lit("hl"), F.lit("")))) / 2
        low = F.length(F.replace(sides, F.lit("h"), F.lit(""))).cast("double")
        mean = 2 * low * (n - low) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(spread > 0, (1 + turns - mean) / F.sqrt(spread)).otherwise(9.0)

    # one symbol, all padding after it, has no runs to tell of
    return F.when(n > 1, _once(F.call_function("translate", value, symbols, marks), normal)).otherwise(9.0)


def _correlated(value: Column, n: Column, symbols: Column) -> Column:
    """Normalised correlation of neighbouring symbols."""
    numbers = F.transform(F.split(value, ""), lambda c: F.instr(symbols, c).cast("double"))
    sums = F.aggregate(
        F.filter(numbers, lambda x: x > 0),
        F.struct(*[F.lit(0.0).alias(k) for k in ("s", "q", "p", "first", "last")]),
        lambda a, x: F.struct(
            (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"), (a["p"] + a["last"] * x).alias("p"),
            F.when(a["first"] == 0, x).otherwise(a["first"]).alias("first"), x.alias("last")))

    def normal(a):
        mean = a["s"] / n
        varied = a["q"] - a["s"] * mean
        together = a["p"] - mean * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * mean * mean
        return F.when(varied > 1e-9, (together / varied + 1 / n) * F.sqrt(n)).otherwise(9.0)

    return _once(sums, normal)


def _tests(value: Column, encoding: Column) -> Column:
    """Battery for a value: combined statistic against random, and rarity in text."""
    n, symbols = F.length(value).cast("double"), encoding["symbols"]
    size = F.length(symbols).cast("double")
    free = size - 1

    def combined(chi):
        z = F.greatest((chi - free) / F.sqrt(2 * free), F.lit(0.0))
        z_kind = F.greatest(_uneven_kinds(value, n, encoding["kinds"], size), F.lit(0.0))
        z_runs, z_next = _uneven_runs(value, n, symbols, size), _correlated(value, n, symbols)
        skew = size * encoding["even"] - 1
        chance = _phi((chi - free - n * skew) / F.sqrt(2 * free + 4 * n * skew))
        rarity = F.floor(-10 * F.log10(F.greatest(chance, F.lit(1e-9))))
        return F.struct((z * z + z_kind * z_kind + z_runs * z_runs + z_next * z_next).alias("against"),
                        F.least(rarity, F.lit(FINEST)).cast("int").alias("rarity"))

    return _once(_uneven(value, n, symbols, size), combined)


def candidates(text: Column) -> Column:
    """Array of (start, end, stratum, tests): candidates with an encoding, and their battery."""
    def tested(span):
        plain = F.rtrim(F.translate(span["value"], "-_", "+/"), F.lit("="))

        def known_as(encoding):
            folded = F.when(encoding["name"].isin(*FOLDED), F.lower(plain)).otherwise(plain)
            return _once(folded, lambda value: F.struct(
                span["start"].alias("start"), span["end"].alias("end"),
                F.concat_ws(":", encoding["name"], F.floor(F.log2(
                    F.length(value).cast("double"))).cast("string")).alias("stratum"),
                _tests(value, encoding).alias("tests")))

        return F.get(F.transform(F.filter(F.array(_encoding(span["value"])),
                                          lambda e: e.isNotNull()), known_as), 0)

    return F.filter(F.transform(places(text, CANDIDATE), tested), lambda c: c.isNotNull())


def with_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, base, tried): known spans, and candidates outside of these."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = pin(rows.select("doc_id", known(F.col("text")).alias("base"),
                           candidates(F.col("text")).alias("all")), "base", "all")
    free = F.filter("all", lambda c: ~F.exists(
        "base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return pin(rows.select("doc_id", "base", free.alias("tried")), "tried")


def rarities(spans: DataFrame, share: float = FALSE_SHARE) -> dict[str, int]:
    """The least rarity that counts as a discovery, for each stratum that has one.

    The step-up rule of false discovery rates on counts of candidates by rarity: strata are an
    encoding and a doubling of length, so there are few rows whatever the size of the corpus.
    """
    counted = spans.select(F.explode("tried").alias("c")).groupBy(
        F.col("c.stratum").alias("stratum"), F.col("c.tests.rarity").alias("rarity")).count()
    rarer = Window.partitionBy("stratum").orderBy(F.desc("rarity"))
    counted = counted.withColumns({
        "found": F.sum("count").over(rarer),
        "all": F.sum("count").over(Window.partitionBy("stratum"))})
    enough = counted.filter(F.pow(F.lit(10.0), -F.col("rarity") / 10) * F.col("all")
                            <= share * F.col("found"))
    rows = enough.groupBy("stratum").agg(F.min("rarity").alias("least")).collect()
    return {r.stratum: r.least for r in rows}


def find_secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """One row for each document: ``base`` and ``random``, arrays of (start, kind, end).

    Starts and ends count characters, ends are exclusive, ``kind`` indexes ``KINDS``. Null and
    empty texts have none. Candidates that overlap a known span are left to it. Discovery limits
    come from all documents, so the result of one depends on the others.
    """
    spans = with_spans(docs)
    least = rarities(spans, share)
    limits = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) \
        if least else F.create_map().cast("map<string,int>")
    passed = F.filter("tried", lambda c: (c["tests"]["against"] <= AGAINST_RANDOM)
                      & (c["tests"]["rarity"] >= F.element_at(limits, c["stratum"])))
    return spans.select("doc_id", "base", F.transform(passed, lambda c: F.struct(
        c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))).alias("random"))


def count_kind(spans: Column, kind: int) -> Column:
    """How many of the spans are of that kind."""
    # a second parameter of the lambda, default or not, would be the index of the span
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
