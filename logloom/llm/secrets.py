"""Secrets in texts: known forms, and tokens that pass a battery of randomness tests.

Known forms are matched by pattern. Any other long token of letters and digits is tested
against a uniform draw from the alphabet of its encoding: chi-squared of the symbols, runs
above and below the middle of the alphabet, serial correlation. Each gives a p-value from
the exact moments of such a draw, for any alphabet and length; the least, times three, is
the token's. A token that fails the battery is no secret.

One that passes is held against ordinary writing: letters that follow each other as in the
words of the corpus, in one case or in camel case, with digits and signs between. How much
likelier the token is as a uniform draw than as such writing has mean one over all ordinary
tokens, so its inverse is a p-value of "secret", at every length: short tokens tell little,
long ones much. Tokens are reported at the wanted rate of false reports (Benjamini and
Hochberg, over the tested tokens of like length), by one rule at every size of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import stored

#: Kinds in order, pattern, group whose length counts, least length.
KINDS = (
    (
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
#: What a text must have for a kind to be looked for.
HINTS = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
}
#: Longer runs only, where shorter ones would fail anyway.
FASTER = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}

#: Tokens that are tested.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.05
#: Lengths are told apart in steps of four up to this step.
STRATA = 16
#: p-values are kept as hundredths of their negative decimal logarithm, up to this one.
LEVELS = 30_000
#: A token whose p-value under the uniform draw is smaller fails the battery.
BATTERY = 1e-3
#: Words that teach which letters follow each other are at most so long.
WORD_LETTERS = 19
#: Share of the pairs of letters, of single letters and of a uniform draw in what follows a
#: letter of ordinary writing, as names hold words that the corpus lacks.
SHARES = (0.6, 0.25, 0.15)
#: Chances in ordinary writing that a small letter, a capital, a digit or a sign (rows) is
#: followed by one (columns); the first row is for the start.
TURNS = (
    (0.50, 0.40, 0.08, 0.02),
    (0.86, 0.06, 0.04, 0.04),
    (0.50, 0.42, 0.04, 0.04),
    (0.15, 0.10, 0.70, 0.05),
    (0.50, 0.25, 0.20, 0.05),
)

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
#: Alphabets by encoding, the first that holds the whole token.
ALPHABETS = (
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _LOWER.upper() + "234567",
    _LOWER,
    _DIGITS + _LOWER.upper(),
    _DIGITS + _LOWER,
    _LOWER.upper() + _LOWER,
    _LOWER.upper() + _LOWER + _DIGITS,
    _LOWER.upper() + _LOWER + _DIGITS + "+/",
    _LOWER.upper() + _LOWER + _DIGITS + "-_",
    _LOWER.upper() + _LOWER + _DIGITS + "+/-_",
)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """``start, end, value`` of every match, in code points; value is the group's text."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(
        F.slice(between, 1, F.size(matches)).alias("before"),
        matches.alias("match"),
        values.alias("value"),
    )
    start = F.struct(
        F.lit(0).alias("place"),
        F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"),
    )

    def step(state: Column, row: Column) -> Column:
        begin = state["place"] + F.length(row["before"])
        end = begin + F.length(row["match"])
        own = F.struct(begin.alias("start"), end.alias("end"), row["value"].alias("value"))
        return F.struct(
            end.alias("place"), F.concat(state["found"], F.array(own)).alias("found")
        )

    return F.aggregate(rows, start, step)["found"]


def _base(text: Column) -> Column:
    """All matches of the known forms: ``start, rank, kind, end``."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def matches(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = F.filter(
            spans(text, FASTER.get(kind, pattern), group),
            lambda match: F.length(match["value"]) >= least,
        )
        rows = F.transform(
            found,
            lambda match: F.struct(
                match["start"].alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("kind"),
                match["end"].alias("end"),
            ),
        )
        return F.when(text.rlike(HINTS[kind]), rows).otherwise(none)

    found = [matches(rank, *kind) for rank, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*found))


# --- the test battery --------------------------------------------------------------


def _alphabet(token: Column) -> Column:
    choice = F.lit(ALPHABETS[-1])
    for alphabet in reversed(ALPHABETS[:-1]):
        choice = F.when(token.rlike("^[" + alphabet.replace("-", r"\-") + "]+$"), alphabet).otherwise(
            choice
        )
    return choice


def _above(row: Column) -> Column:
    """Chance of a standard normal value above ``z``: the usual Chebyshev fit of erfc, whose
    relative error is below 1.2e-7; ``t`` is 1 / (1 + |z| / sqrt(8))."""
    z, t = row["z"], row["t"]
    power = F.lit(0.0)
    for factor in (
        0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807,
        -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223,
    ):
        power = power * t + factor
    tail = t * F.exp(power - z * z / 2) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _uniform(row: Column) -> Column:
    """How far off a uniform draw the token is: a standardised value per statistic.

    ``row`` has ``squares``, the sum of squared symbol counts, ``changes`` of side, ``about``,
    the sum of products of neighbours about the alphabet's mean, ``n`` and ``size``.
    Chi-squared is a linear function of the number of equal pairs, whose first three moments
    are known for every alphabet and length; its tail is that of the shifted gamma
    distribution with these. Every neighbour is on the other side with chance one half.
    """
    n, size = row["n"], row["size"]
    p = 1 / size
    spread = n * (n - 1) / 2 * p * (1 - p)
    third = spread * (1 - 2 * p) + n * (n - 1) * (n - 2) * p * p * (1 - p)
    shape = 4 * spread * spread * spread / (third * third)
    equal = ((row["squares"] - n) / 2 - F.lit(0.5) - n * (n - 1) / 2 * p) / F.sqrt(spread)
    gamma = F.greatest(1 + equal / F.sqrt(shape), F.lit(0.0))
    sides = F.greatest(F.abs(row["changes"] - (n - 1) / 2) - 0.5, F.lit(0.0)) / F.sqrt((n - 1) / 4)
    return F.struct(
        row["stratum"].alias("stratum"),
        F.array(
            (F.pow(gamma, F.lit(1 / 3)) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape),
            sides,
            F.abs(row["about"]) / ((size * size - 1) / 12 * F.sqrt(n - 1)),
        ).alias("values"),
    )


def _level(row: Column) -> Column:
    """Hundredths of -log10 of the least p-value, two-sided but for the first, times three."""
    chances = F.transform(
        F.transform(
            row["values"],
            lambda z: F.struct(z.alias("z"), (1 / (1 + F.abs(z) / (2 * math.sqrt(2)))).alias("t")),
        ),
        _above,
    )
    least = 3 * F.least(chances[0], 2 * F.array_min(F.slice(chances, 2, 2)))
    return F.struct(
        row["stratum"].alias("stratum"),
        # Rounded down, so that no p-value counts as smaller than it is.
        F.least(
            F.floor(-100 * F.log10(F.greatest(F.least(least, F.lit(1.0)), F.lit(1e-300)))),
            F.lit(LEVELS),
        ).cast("int").alias("level"),
    )


def _tested(tokens: Column) -> Column:
    """``stratum, level`` of every token of an array of strings: its length in steps of four
    and the level of its p-value under the uniform draw."""
    plain = F.transform(tokens, lambda token: F.regexp_replace(token, "=+$", ""))
    typed = F.transform(
        plain, lambda token: F.struct(token.alias("token"), _alphabet(token).alias("alphabet"))
    )

    def numbers(row: Column) -> Column:
        signs = F.split(row["token"], "")
        codes = F.transform(
            F.filter(signs, lambda sign: F.length(sign) > 0),
            lambda sign: F.instr(row["alphabet"], sign).cast("double"),
        )
        return F.struct(codes.alias("codes"), F.length(row["alphabet"]).cast("double").alias("size"))

    def moments(row: Column) -> Column:
        codes, size = row["codes"], row["size"]
        n = F.size(codes).cast("double")
        return F.struct(
            codes.alias("codes"), size.alias("size"), n.alias("n"), ((size + 1) / 2).alias("middle")
        )

    def sums(row: Column) -> Column:
        codes, n, middle, zero = row["codes"], row["n"], row["middle"], F.lit(0.0)
        # Symbols that are equal.
        counts = F.transform(
            F.array_distinct(codes),
            lambda c: F.size(F.filter(codes, lambda other: other == c)).cast("double"),
        )
        squares = F.aggregate(counts, zero, lambda t, c: t + c * c)
        # Neighbours on two sides of the middle, and their products about it.
        left = F.slice(codes, 1, F.size(codes) - 1)
        right = F.slice(codes, 2, F.size(codes) - 1)
        changes = F.aggregate(
            F.zip_with(
                left, right,
                lambda a, b: F.when((a > middle) != (b > middle), 1.0).otherwise(0.0),
            ),
            zero,
            lambda t, c: t + c,
        )
        about = F.aggregate(
            F.zip_with(left, right, lambda a, b: (a - middle) * (b - middle)), zero, lambda t, c: t + c
        )
        return F.struct(
            n.alias("n"), row["size"].alias("size"), squares.alias("squares"),
            changes.alias("changes"), about.alias("about"),
            F.least(F.floor(n / 4).cast("int"), F.lit(STRATA)).alias("stratum"),
        )

    scored = F.transform(F.transform(F.transform(typed, numbers), moments), sums)
    return F.transform(F.transform(scored, _uniform), _level)


def letter_chances(documents: DataFrame, text: str = "text") -> list[float]:
    """Natural logarithms of the chances that a letter (or the start of a word) is followed
    by each letter, in the distinct words of all texts.

    Words are counted before anything is made of their letters, each once, so a frequent one
    weighs as much as a rare one. Pairs are mixed with single letters and a uniform draw by
    ``SHARES``. The driver gets a row for each pair of letters, 702 at most.
    """
    folded = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2"))
    words = documents.select(F.explode(F.split(folded, "[^a-z]+")).alias("word")).distinct()
    words = words.where(F.length("word").between(2, WORD_LETTERS))
    marked = F.concat(F.lit("^"), F.col("word"))
    pairs = words.select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("word")), lambda at: marked.substr(at, F.lit(2)))
        ).alias("pair")
    )
    counts = {row["pair"]: row["count"] for row in pairs.groupBy("pair").count().collect()}
    alone = {second: sum(counts.get(first + second, 0) for first in "^" + _LOWER) for second in _LOWER}
    letters = sum(alone.values())
    found = []
    for first in "^" + _LOWER:
        total = sum(counts.get(first + second, 0) for second in _LOWER)
        for second in _LOWER:
            uniform = 1 / len(_LOWER)
            single = alone[second] / letters if letters else uniform
            pair = counts.get(first + second, 0) / total if total else single
            parts = zip(SHARES, (pair, single, uniform))
            found.append(math.log(sum(share * chance for share, chance in parts)))
    return found


def _evidence(tokens: Column, chances: list[float]) -> Column:
    """For every token, hundredths of the decimal logarithm of how much likelier it is as a
    uniform draw from its alphabet than as ordinary writing; 0 where it is less likely."""
    letters = F.array(*map(F.lit, chances))
    turns = F.array(*[F.lit(math.log(chance)) for row in TURNS for chance in row])

    def measured(row: Column) -> Column:
        signs = F.filter(F.split(row["token"], ""), lambda sign: F.length(sign) > 0)
        coded = F.transform(
            signs,
            lambda sign: F.struct(
                F.when(sign.rlike("[a-z]"), 1).when(sign.rlike("[A-Z]"), 2)
                .when(sign.rlike("[0-9]"), 3).otherwise(4).alias("kind"),
                F.instr(F.lit(_LOWER), F.lower(sign)).alias("letter"),
            ),
        )
        nothing = F.struct(F.lit(0).alias("kind"), F.lit(0).alias("letter"))
        before = F.concat(F.array(nothing), F.slice(coded, 1, F.size(coded) - 1))

        def chance(last: Column, now: Column) -> Column:
            # A capital after a small letter begins a word.
            begins = (last["kind"] == 1) & (now["kind"] == 2)
            first = F.when(begins, 0).otherwise(last["letter"])
            symbol = (
                F.when(now["letter"] > 0, F.element_at(letters, F.greatest(first * 26 + now["letter"], F.lit(1))))
                .when(now["kind"] == 3, math.log(1 / 10))
                .otherwise(math.log(1 / 4))
            )
            return F.element_at(turns, last["kind"] * 4 + now["kind"]) + symbol

        written = F.aggregate(F.zip_with(before, coded, chance), F.lit(0.0), lambda t, c: t + c)
        drawn = -F.log(F.length(row["alphabet"]).cast("double")) * F.size(signs)
        hundredths = F.floor(100 * (drawn - written) / math.log(10))
        return F.greatest(F.least(hundredths, F.lit(LEVELS)), F.lit(0)).cast("int")

    plain = F.transform(tokens, lambda token: F.regexp_replace(token, "=+$", ""))
    typed = F.transform(
        plain, lambda token: F.struct(token.alias("token"), _alphabet(token).alias("alphabet"))
    )
    return F.transform(typed, measured)


def limits(evidence: DataFrame, rate: float = RATE) -> dict[int, int]:
    """By stratum, the least evidence that is reported; none where nothing is.

    ``evidence`` has ``stratum, evidence, n``: counts, so at most a row for each level of
    each stratum, ``(STRATA + 1) * (LEVELS + 1)``, all of which the driver gets.
    """
    rows = sorted(((r["stratum"], r["evidence"], r["n"]) for r in evidence.collect()), reverse=True)
    total: dict[int, int] = {}
    for stratum, _, n in rows:
        total[stratum] = total.get(stratum, 0) + n
    found: dict[int, int] = {}
    reached = dict.fromkeys(total, 0)
    for stratum, level, n in rows:
        reached[stratum] += n
        if 10 ** (-level / 100) * total[stratum] <= rate * reached[stratum]:
            found[stratum] = level
    return found


# --- operator ------------------------------------------------------------------------


def secrets(
    documents: DataFrame, rate: float = RATE, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Secrets in every text: ``id, text_key, base, random``.

    ``base`` and ``random`` are arrays of ``start, rank, kind, end`` in code points, end
    exclusive, ordered by start, then by kind as listed; ``random`` has tokens that only the
    tests found, none of which meets a base match. Null and empty texts have none; repeated
    rows get equal results; texts are read whole; other columns are not read; an empty table
    gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    tokens = F.when(whole.rlike(TOKEN), spans(whole, TOKEN)).otherwise(none)
    rows = documents.select(
        F.col(id).alias("id"), F.xxhash64(text).alias("text_key"), _base(whole).alias("base"),
        tokens.alias("tokens"),
    )

    free = F.filter(
        F.filter("tokens", lambda token: token["value"].rlike("[A-Za-z]")),
        lambda token: ~F.exists(
            "base", lambda own: (own["start"] < token["end"]) & (token["start"] < own["end"])
        ),
    )
    rows = rows.select("id", "text_key", "base", free.alias("free"))
    chances = letter_chances(documents, text)
    values = F.transform("free", lambda t: t["value"])
    tested = F.zip_with(
        _tested(values), _evidence(values, chances),
        lambda test, own: F.struct(
            test["stratum"].alias("stratum"), test["level"].alias("level"), own.alias("evidence")
        ),
    )
    rows = stored(rows.select("id", "text_key", "base", "free", tested.alias("tests")), "tested")

    passed = math.floor(-100 * math.log10(BATTERY))
    found = limits(
        rows.select(F.explode("tests").alias("test"))
        # What fails the battery counts among the tested, without evidence.
        .withColumn("evidence", F.when(F.col("test.level") < passed, F.col("test.evidence")).otherwise(0))
        .groupBy("test.stratum", "evidence")
        .agg(F.count("*").alias("n")),
        rate,
    )
    least = F.array(*[F.lit(found.get(stratum)).cast("int") for stratum in range(STRATA + 1)])

    def is_random(test: Column) -> Column:
        own = F.element_at(least, test["stratum"] + 1)
        return F.coalesce((test["level"] < passed) & (test["evidence"] >= own), F.lit(False))

    pairs = F.zip_with("free", "tests", lambda t, s: F.struct(t.alias("t"), s.alias("s")))
    random = F.transform(
        F.filter(pairs, lambda p: is_random(p["s"])),
        lambda p: F.struct(
            p["t"]["start"].alias("start"),
            F.lit(len(KINDS)).alias("rank"),
            F.lit("random").alias("kind"),
            p["t"]["end"].alias("end"),
        ),
    )
    return rows.select("id", "text_key", "base", random.alias("random"))


def rendered(found: Column) -> Column:
    """``kind:start:end`` of every span, by start, then kind, joined by commas."""
    return F.array_join(
        F.transform(
            F.sort_array(found), lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])
        ),
        ",",
    )


def digests(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base_sha256, spans`` of every text."""

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")

    return secrets(documents, id=id, text=text).select(
        "id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in KINDS],
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.concat("base", "random")).alias("spans"),
    )


def masked(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``[kind]``.

    Rows and columns stay as they are, whatever further columns are called. Where spans meet, the later one loses what the
    earlier one covers.
    """
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    found = (
        secrets(documents, id=id, text=text)
        .select("id", "text_key", F.sort_array(F.concat("base", "random")).alias("found"))
        .where(F.size("found") > 0)
        .distinct()
        .alias("spans")
    )
    whole, spans = F.col(f"rows.`{text}`"), F.col("spans.found")
    same = F.col(f"rows.`{id}`").eqNullSafe(F.col("spans.id")) & (
        F.xxhash64(whole) == F.col("spans.text_key")
    )
    start = F.struct(F.lit(0).alias("place"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        begin = F.greatest(span["start"], state["place"])
        kept = whole.substr(state["place"] + 1, begin - state["place"])
        mark = F.when(
            span["start"] >= state["place"], F.concat(F.lit("["), span["kind"], F.lit("]"))
        ).otherwise("")
        return F.struct(
            F.greatest(span["end"], state["place"]).alias("place"),
            F.concat(state["out"], kept, mark).alias("out"),
        )

    done = F.aggregate(F.coalesce(spans, none), start, step)
    rest = whole.substr(done["place"] + 1, F.length(whole))
    clean = F.when(spans.isNull(), whole).otherwise(F.concat(done["out"], rest))
    columns = [
        clean.alias(text) if c == text else F.col(f"rows.`{c}`").alias(c) for c in documents.columns
    ]
    return documents.alias("rows").join(found, same, "left").select(columns)
