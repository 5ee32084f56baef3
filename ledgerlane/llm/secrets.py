"""Secret scan: patterns, and random strings found by a battery of randomness tests.

Everything is a DataFrame expression; no Python runs on the executors.

Spans of kinds ``assign``, ``access`` and ``hex`` come from patterns. Spans of kind
``random`` come from tests. A candidate is what pattern spans leave of a run of the base64
alphabets, 20 or more characters together. Its encoding is inferred from its characters
(``hex`` in one case, ``base32``, ``alnum`` or ``base64``), which fixes the number of
symbols K and each symbol's rank. Three tests ask whether the ranks look like K equally
likely independent symbols:

* chi-squared over four ranges of ranks (alphabet uniformity),
* Wald-Wolfowitz runs above and below the middle rank,
* serial correlation of neighbouring ranks.

Each gives a two-sided p-value. The least of them, m, is made even over (0, 1) for random
strings: u = 1 - (1 - m) ** 2.6, as three tests that depend on each other count like 2.6.

A fourth test looks at words and not at ranks. The letter pairs of the corpus's own words,
each word weighed by the logarithm of its count, give every pair a weight: how much likelier
it is in words than among random letters, within bounds. The sum of a run's weights has a mean and a
variance for random strings of its encoding that follow from the weights, so z, the sum in deviations above that
mean, is known for random strings at any size of the corpus, and is high for runs that spell words of any of
its languages. Runs in the form of a UUID name things and are ordinary.

A run is a secret if u is at least U_LIMIT and z is below the limit of its class, an
encoding and a range of lengths. The limit is the largest of Z_LIMITS at which the false ones stay
below ``rate`` of the accepted; a class where none does so accepts nothing. False ones are
estimated in two ways, and the larger counts:

* from ordinary runs: of the runs that the three tests surely refuse, the share whose z is low,
  times the runs whose z alone is high. Classes with few such runs take the share of
  their encoding, or of all;
* from random strings: half of them have z below 0 and 16 in 100 below -1, so the runs there, plus what
  chance may add, bound the genuine ones; accepted runs beyond that bound are false.

In a class of few runs the second bound is wide, so its limit is mostly the first one, and a
lone key is found with the chance of 1 - U_LIMIT times that of z below 2, about 95 in 100.
Only class counts, at most 4 * 8 * 3 * 9, and the sums of 676 letter pairs leave the executors.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns, their group that must be long enough, and its least length.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A candidate has at least so many characters.
CANDIDATE_CHARS = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{CANDIDATE_CHARS},}}"
#: Symbols of an encoding in rank order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Upper ends of the length classes; the last class has no end.
LENGTH_CLASSES = (24, 32, 40, 48, 64, 96, 128)
#: So many independent tests give the least p-value that the three give (simulated).
EFFECTIVE_TESTS = 2.6
#: A random string has a smaller u than U_LIMIT with this chance; a run below SURE is ordinary.
U_LIMIT = 0.02
SURE = 0.001
#: Limits on z that a class may have; from the first one on a run spells words.
Z_LIMITS = (2.0, 1.5, 1.0, 0.5, 0.0, -0.5, -1.0, -1.5)
WORDY = Z_LIMITS[0]
#: A class has so many surely ordinary runs before their share of low z is taken from it alone.
ENOUGH = 50
RATE = 0.1
#: Letter pairs that each first letter has at random beside those counted, so that a small corpus decides little.
PRIOR = 400
#: Bounds of a pair's weight, and the least deviation of one weight that z is measured in.
HEAVIEST = 2.5
LEAST_DEVIATION = 0.3
LETTERS = "abcdefghijklmnopqrstuvwxyz"
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans of a pattern's leftmost matches whose group has at least ``least`` characters.

    The texts between matches and the matches alternate, so their lengths give positions.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    steps = F.arrays_zip(
        F.transform(between, lambda x: F.length(x).cast("bigint")).alias("gap"),
        F.transform(matches, lambda x: F.length(x).cast("bigint")).alias("size"),
        F.transform(groups, lambda x: F.length(x).cast("bigint")).alias("valued"),
    )
    start_type = f"struct<at:bigint,out:{_SPAN}>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out")).cast(start_type)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0).cast("bigint"))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        out = F.when(x["valued"] >= least, F.concat(done["out"], F.array(span))).otherwise(done["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(start_type)

    found = F.aggregate(steps, empty, step, lambda x: x["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Pattern spans by start, then kind."""
    # Runs of hex digits below the least length cannot count, and longer ones are found whole.
    hexes = rf"[0-9a-f]{{{LEAST['hex']},}}"
    access = rf"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, LEAST["assign"], 1),
            _spans(text, access, 1, LEAST["access"]),
            _spans(text, hexes, 2, LEAST["hex"]),
        )
    )


def _tail(z: Column) -> Column:
    """Two-sided normal tail of |z| (Abramowitz and Stegun 26.2.17)."""
    z = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) * 0.3989422804014327 * poly)


def encoding(token: Column) -> Column:
    """The narrowest encoding whose alphabet has all characters; hex of capitals is base16 in lower case."""
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex"))
        .when(token.rlike("^[A-Z2-7]+$"), F.lit("base32"))
        .when(token.rlike("^[0-9A-Za-z]+$"), F.lit("alnum"))
        .otherwise(F.lit("base64"))
    )


_SUMS = ("n", "s", "ss", "sxy", "first", "last", "q0", "q1", "q2", "q3", "above", "changes")


def _sums(symbols: Column, table: Column, k: Column) -> Column:
    """What the tests need, gathered in one walk over the symbols' ranks."""
    kind = "struct<" + ",".join(f"{x}:double" for x in _SUMS) + ">"
    zero = F.struct(*[F.lit(0.0).alias(x) for x in _SUMS]).cast(kind)

    def side(r: Column) -> Column:
        return F.when(r * 2 >= k - 1, 1.0).otherwise(0.0)

    def step(a: Column, symbol: Column) -> Column:
        r = F.call_function("instr", table, symbol).cast("double") - 1
        later = F.when(a["n"] > 0, 1.0).otherwise(0.0)
        return F.struct(
            (a["n"] + 1).alias("n"),
            (a["s"] + r).alias("s"),
            (a["ss"] + r * r).alias("ss"),
            (a["sxy"] + later * a["last"] * r).alias("sxy"),
            F.when(a["n"] > 0, a["first"]).otherwise(r).alias("first"),
            r.alias("last"),
            *[(a[f"q{q}"] + F.when(F.floor(r * 4 / k) == q, 1.0).otherwise(0.0)).alias(f"q{q}") for q in range(4)],
            (a["above"] + side(r)).alias("above"),
            (a["changes"] + later * F.abs(side(r) - side(a["last"]))).alias("changes"),
        ).cast(kind)

    return F.aggregate(symbols, zero, step)


def _battery(a: Column, k: Column) -> Column:
    """The least p-value of the three tests."""
    zero, least = F.lit(0.0), F.lit(1e-12)
    n = a["n"]
    # Chi-squared over four ranges of ranks; those of 62 ranks differ in size.
    chi = zero
    for q in range(4):
        share = (F.ceil(k * (q + 1) / 4) - F.ceil(k * q / 4)).cast("double") / k
        miss = a[f"q{q}"] - n * share
        chi = chi + miss * miss / (n * share)
    # Wilson-Hilferty: the cube root of chi-squared / 3 is near normal; only large values count.
    z = (F.pow(chi / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27))
    p_chi = F.when(z >= 0, _tail(z) / 2).otherwise(1 - _tail(z) / 2)
    below = n - a["above"]
    mean = 2 * a["above"] * below / n + 1
    variance = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
    p_runs = F.when(
        variance > 0, _tail((a["changes"] + 1 - mean) / F.sqrt(F.greatest(variance, least)))
    ).otherwise(zero)
    middle = a["s"] / n
    spread = a["ss"] - n * middle * middle
    lag = a["sxy"] - middle * (2 * a["s"] - a["first"] - a["last"]) + (n - 1) * middle * middle
    # Expected at -1 / n, with variance near 1 / n.
    p_lag = F.when(spread > least, _tail((lag / F.greatest(spread, least) + 1 / n) * F.sqrt(n))).otherwise(zero)
    return F.least(p_chi, p_runs, p_lag)


class PairWeights:
    """Weights of letter pairs; ``rows[a][b]`` is that of letter b behind letter a, zero without any corpus.

    ``others`` are the same with one count less: what the rest of the corpus says of a pair
    that a run has taught once itself, so that random runs do not vouch for themselves.
    """

    def __init__(self, counts: dict[str, int]) -> None:
        self.rows, self.others = [
            [
                self._of_letter([max(counts.get(x + y, 0) - less, 0) for y in LETTERS], sum(counts.get(x + y, 0) for y in LETTERS) - less)
                for x in LETTERS
            ]
            for less in (0, 1)
        ]

    @staticmethod
    def _of_letter(counts: list[int], total: int) -> list[float]:
        likelier = [(n * len(LETTERS) + PRIOR) / (max(total, 0) + PRIOR) for n in counts]
        return [max(-HEAVIEST, min(HEAVIEST, math.log(x))) for x in likelier]

    def weight(self, a: str, b: str) -> float:
        """The weight of two symbols, in any case; zero unless both are letters."""
        i, j = LETTERS.find(a.lower()), LETTERS.find(b.lower())
        return self.rows[i][j] if i >= 0 and j >= 0 else 0.0

    def moments(self, code: str) -> tuple[float, float, float]:
        """Mean and variance of a pair of random symbols, and the covariance of two that share a symbol."""
        symbols = ALPHABETS[code]
        every = [[self.weight(a, b) for b in symbols] for a in symbols]
        k = len(symbols)
        mean = sum(map(sum, every)) / k**2
        behind, before = [sum(row) / k for row in every], [sum(column) / k for column in zip(*every, strict=True)]
        variance = sum(w * w for row in every for w in row) / k**2 - mean**2
        return mean, variance, sum(x * y for x, y in zip(before, behind, strict=True)) / k - mean**2

    def z(self, token: Column, symbols: Column, code: Column) -> Column:
        """The token's sum of weights in deviations above the mean of random strings."""
        # Letters count from 1, anything else is 0 and weighs nothing, as does the start.
        wide = [0.0] * 27 + [w for row in self.others for w in (0.0, *row)]
        table = F.split(F.lit(",".join(map(repr, wide))), ",").cast("array<double>")
        kind = "struct<last:int,sum:double>"

        def step(done: Column, symbol: Column) -> Column:
            letter = F.call_function("instr", F.lit(LETTERS), F.lower(symbol))
            return F.struct(letter.alias("last"), (done["sum"] + F.get(table, done["last"] * 27 + letter)).alias("sum")).cast(kind)

        total = F.aggregate(symbols, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")).cast(kind), step, lambda x: x["sum"])
        known = {k: self.moments(k) for k in ALPHABETS}

        def of_code(i: int) -> Column:
            return F.create_map(*[x for k, m in known.items() for x in (F.lit(k), F.lit(float(m[i])))])[code]

        n = (F.length(token) - 1).cast("double")
        variance = F.greatest(n * of_code(1) + 2 * (n - 1) * of_code(2), n * LEAST_DEVIATION**2)
        return (total - n * of_code(0)) / F.sqrt(variance)


def pair_weights(texts: DataFrame) -> PairWeights:
    """Weights from the words (letters only) of all texts; ``texts`` has one column, text.

    A word counts 1 + floor(log2 n) where it occurs n times, so that no copied text, and no
    copied key, teaches more than some tens of different words.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    words = words.groupBy("word").agg((1 + F.floor(F.log2(F.count("*")))).alias("n"))
    pairs = words.select(F.explode(F.regexp_extract_all("word", F.lit("(?=([a-z]{2}))"), F.lit(1))).alias("pair"), "n")
    return PairWeights(dict(map(tuple, pairs.groupBy("pair").agg(F.sum("n")).collect())))  # at most 676 rows


def _beside(run: Column, base: Column) -> Column:
    """What spans, sorted by start, leave of a run: stretches long enough for a candidate."""
    kind = f"struct<at:bigint,out:{_SPAN}>"
    empty = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("out")).cast(kind)

    def cut(done: Column, end: Column) -> Column:
        piece = F.struct(done["at"].alias("start"), F.lit(3).alias("kind"), end.alias("end"))
        return F.when(end - done["at"] >= CANDIDATE_CHARS, F.concat(done["out"], F.array(piece))).otherwise(done["out"])

    near = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(
        near,
        empty,
        lambda done, b: F.struct(F.greatest(done["at"], b["end"]).alias("at"), cut(done, b["start"]).alias("out")).cast(kind),
        lambda done: cut(done, run["end"]),
    )


def _length_class(size: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for i, end in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(size <= end, F.lit(i)).otherwise(out)
    return out


def candidates(text: Column, base: Column, weights: PairWeights | None = None) -> Column:
    """Candidates as (start, end, code, size class, p, u, z, wordy), beside the base spans.

    ``p`` is three times the least p-value, at most 1, and ``u`` the even one; see above.
    ``wordy`` runs spell words or are UUIDs. Without ``weights`` every z is 0.
    """
    weights = weights or PairWeights({})
    runs = _spans(text, CANDIDATE, 3, CANDIDATE_CHARS)
    free = F.flatten(F.transform(runs, lambda r: _beside(r, base)))

    # Each transform binds what the next one uses, so that nothing is computed per symbol.
    tables = F.create_map(*[x for k, v in ALPHABETS.items() for x in (F.lit(k), F.lit(v))])
    tokens = F.transform(
        free,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            F.substring(text, r["start"].cast("int") + 1, (r["end"] - r["start"]).cast("int")).alias("token"),
        ),
    )
    coded = F.transform(
        tokens,
        lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["token"].alias("token"), encoding(r["token"]).alias("code")),
    )
    split = F.transform(
        coded,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["code"].alias("code"),
            r["token"].alias("token"),
            tables[r["code"]].alias("table"),
            F.length(tables[r["code"]]).cast("double").alias("k"),
            F.filter(
                F.split(
                    F.when(r["code"] == "hex", F.lower(r["token"]))
                    .when(r["code"] == "base64", F.translate(r["token"], "-_", "+/"))
                    .otherwise(r["token"]),
                    "",
                ),
                lambda c: c != "",
            ).alias("symbols"),
        ),
    )
    summed = F.transform(
        split,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["code"].alias("code"),
            F.when(r["token"].rlike(UUID), F.lit(math.inf)).otherwise(weights.z(r["token"], r["symbols"], r["code"])).alias("z"),
            r["k"].alias("k"),
            _sums(r["symbols"], r["table"], r["k"]).alias("sums"),
        ),
    )
    tested = F.transform(
        summed,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["code"].alias("code"),
            r["z"].alias("z"),
            _battery(r["sums"], r["k"]).alias("m"),
        ),
    )
    return F.transform(
        tested,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["code"].alias("code"),
            _length_class(r["end"] - r["start"]).alias("size"),
            F.least(F.lit(1.0), 3 * r["m"]).alias("p"),
            (1 - F.pow(1 - r["m"], F.lit(EFFECTIVE_TESTS))).alias("u"),
            r["z"].alias("z"),
            (r["z"] >= WORDY).alias("wordy"),
        ),
    )


def _false(accepted: list[int], sure: list[int], i: int) -> float:
    """How many of the runs with z below Z_LIMITS[i] are estimated to be ordinary.

    Both lists count runs by the number of Z_LIMITS that z is below: ``accepted`` those
    with a high u, ``sure`` those that the three tests surely refuse.
    """
    found = sum(accepted[i + 1 :])
    from_ordinary = accepted[0] * sum(sure[i + 1 :]) / sure[0] if sure[0] else 0.0
    # At most so many genuine ones, by those below 0 and far below it; 2.33 deviations, 2.7 more as counts are small, leave 1 % to chance.
    share = NormalDist().cdf
    genuine = min(
        (n + 2.33 * math.sqrt(n + 1) + 2.7) / share(z)
        for z in (0.0, -1.0)
        for n in [sum(accepted[Z_LIMITS.index(z) + 1 :])]
    )
    return max(from_ordinary, found - genuine * share(Z_LIMITS[i]))


def limits(found: DataFrame, rate: float = RATE) -> dict[tuple[str, int], float]:
    """The z below which runs of each (encoding, length class) with candidates are accepted; -inf for none."""
    level = F.when(F.col("c.u") >= U_LIMIT, "accepted").when(F.col("c.u") < SURE, "sure")
    below = sum((F.col("c.z") < z).cast("int") for z in Z_LIMITS)
    counts = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy("c.code", "c.size", level.alias("level"), below.alias("below"))
        .count()
        .collect()  # at most len(ALPHABETS) * 8 * 3 * (len(Z_LIMITS) + 1) rows
    )
    accepted: dict[tuple, list[int]] = {}
    sure: dict[tuple, list[int]] = {}
    for code, size, level, below, n in counts:
        accepted.setdefault((code, size), [0] * (len(Z_LIMITS) + 1))
        if level == "accepted":
            accepted[code, size][below] += n
        elif level == "sure":
            for key in ((code, size), (code,), ()):
                sure.setdefault(key, [0] * (len(Z_LIMITS) + 1))[below] += n
    out = {}
    for (code, size), mine in accepted.items():
        like = next((sure[k] for k in ((code, size), (code,), ()) if sum(sure.get(k, [])) >= ENOUGH), [0])
        fits = [z for i, z in enumerate(Z_LIMITS) if _false(mine, like, i) <= rate * sum(mine[i + 1 :])]
        out[code, size] = fits[0] if fits else -math.inf
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, kind, end), by start, then kind.

    Positions are code points, ends exclusive; ``kind`` indexes KINDS. All other columns
    are kept; a column named secret_spans is replaced. Null and empty texts have no spans;
    repeated rows are scanned alike; a table without candidates keeps its pattern spans.
    The text is read three times: for the letter pairs of its words, to count candidates per
    class, and for the result.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = base_spans(whole)
    weights = pair_weights(docs.select(whole.alias("text")))
    counted = docs.select(whole.alias("text")).where(F.col("text").rlike(CANDIDATE))
    counted = counted.withColumn("base", base_spans(F.col("text")))
    below = limits(counted.select(candidates(F.col("text"), F.col("base"), weights).alias("candidates")), rate)
    out = docs.withColumn("secret_spans", base)
    if not below:
        return out
    allowed = F.create_map(
        *[x for (code, size), z in sorted(below.items()) for x in (F.lit(f"{code}:{size}"), F.lit(float(z)))]
    )
    more = F.transform(
        F.filter(
            candidates(whole, F.col("secret_spans"), weights),
            lambda c: (c["u"] >= U_LIMIT) & (c["z"] < F.coalesce(allowed[F.concat_ws(":", c["code"], c["size"])], F.lit(-math.inf))),
        ),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")),
    )
    return out.withColumn(
        "secret_spans",
        F.when(whole.rlike(CANDIDATE), F.array_sort(F.concat("secret_spans", more))).otherwise(F.col("secret_spans")),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``."""
    kind = "struct<at:bigint,out:string>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")).cast(kind)

    def part(start: Column, end: Column) -> Column:
        return F.substring(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))

    def step(done: Column, s: Column) -> Column:
        inside = s["start"] < done["at"]
        out = F.when(inside, done["out"]).otherwise(
            F.concat(done["out"], part(done["at"], s["start"]), F.lit(mark))
        )
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out")).cast(kind)

    whole = F.aggregate(
        spans, empty, step, lambda x: F.concat(x["out"], part(x["at"], F.length(text).cast("bigint")))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: counts per kind, digest of pattern spans, and all spans."""
    spans = F.col("secret_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.filter(spans, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
        count(3).alias("n_random"),
    )
