"""Secrets in texts: fixed patterns, and tokens that pass a battery of randomness tests.

All of it is DataFrame functions. A token in an inferred encoding is tested against the
hypothesis that its characters are uniform and independent: a chi-squared test of the
alphabet's uniformity, a runs test about the alphabet's middle and a lag-one serial
correlation. Fisher's method combines the three. Per encoding and band of lengths, so that
long tokens, which the tests can tell apart well, do not decide for short ones, tokens are
reported down to the p-value at which the estimated share of false alarms among them is
still at most ``FDR``. What is reported and holds enough bits is a secret.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A maximal run that is too short cannot hold a longer one, so the least length can stand
# in these two patterns; in ASSIGN a failing match also uses up its text.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
ASSIGN_LEAST = 12
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.05
LEAST_BITS = 80
BANDS = (24, 32, 48)
# p-values are counted in bins of equal ratio; the last holds all below 10 ** -7.
BINS_PER_DECADE, LAST_BIN = 20, 140
# Above one half, where nearly all are of random tokens.
RANDOM_BINS = 6
# Elements of an array over which a running sum is taken at once.
CHUNK = 128


@dataclass(frozen=True)
class Encoding:
    name: str
    pattern: str
    alphabet: str


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
_MIXED = r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
# The first that fits is the token's encoding. Words of letters alone have none.
ENCODINGS = (
    Encoding("hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    Encoding("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _UPPER + "234567"),
    Encoding("base36", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOWER),
    Encoding("base36", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _UPPER),
    Encoding("base62", rf"^{_MIXED}[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    Encoding("base64", rf"^{_MIXED}[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    Encoding("base64", rf"^{_MIXED}[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)


HIT = "array<struct<start:int,end:int,hit:string>>"
_HITS, _TOKENS, _BASE = "__hits", "__tokens", "__base"


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of whole numbers of zero or more; of an array that is not empty.

    Inside chunks first, and then over chunks, so that long arrays take little more than
    their length.
    """

    def last(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), of)

    def inside(part: Column, before: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(part)),
            lambda i: of(before, last(F.slice(part, F.lit(1), i))),
        )

    def over(chunks: Column) -> Column:
        return _let(
            F.transform(chunks, last),
            lambda totals: F.flatten(
                F.zip_with(
                    chunks,
                    F.transform(
                        F.sequence(F.lit(0), F.size(totals) - 1),
                        lambda k: last(F.slice(totals, F.lit(1), k)),
                    ),
                    inside,
                )
            ),
        )

    def chunked(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(own) - 1, F.lit(CHUNK))
        return F.transform(starts, lambda at: F.slice(own, at + 1, F.lit(CHUNK)))

    return _let(values, lambda own: _let(chunked(own), over))


def _placed(text: Column, hits: Column, pattern: str) -> Column:
    """Spans in code points of a pattern's hits, from the lengths of what lies between."""
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(
        F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit)
    )
    placed = F.zip_with(
        hits,
        _running(sizes, lambda total, n: total + n),
        lambda hit, end: F.struct(
            (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")
        ),
    )
    return F.when(F.size(hits) > 0, placed).otherwise(F.from_json(F.lit("[]"), HIT))


def _apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span.

    In order of the tokens' ends and the spans' starts, a token overlaps one of the spans
    before it if the furthest of them reaches beyond the token's start.
    """
    ends = F.transform(
        tokens,
        lambda c: F.struct(
            c["end"].alias("place"), F.lit(0).alias("reach"), c["start"], c["hit"].alias("hit")
        ),
    )
    starts = F.transform(
        base,
        lambda c: F.struct(
            c["start"].alias("place"),
            c["end"].alias("reach"),
            c["start"],
            F.lit(None).cast("string").alias("hit"),
        ),
    )

    def free(places: Column) -> Column:
        furthest = _running(F.transform(places, lambda c: c["reach"]), lambda a, b: F.greatest(a, b))
        seen = F.zip_with(places, furthest, lambda c, reach: F.struct(c.alias("c"), reach.alias("reach")))
        kept = F.filter(seen, lambda s: s["c"]["hit"].isNotNull() & (s["reach"] <= s["c"]["start"]))
        return F.transform(
            kept,
            lambda s: F.struct(
                s["c"]["start"].alias("start"), s["c"]["place"].alias("end"), s["c"]["hit"].alias("hit")
            ),
        )

    # Nothing that starts where a token ends overlaps it: tokens come first, with reach 0.
    sorted_places = F.array_sort(F.concat(ends, starts))
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), _let(sorted_places, free)).otherwise(tokens)


def _upper_tail(z: Column) -> Column:
    """The standard normal's upper tail at z >= 0, to 1e-7."""
    # Fixed values of Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    return F.greatest(F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly, F.lit(1e-8))


def _one_sided(z: Column) -> Column:
    return F.when(z >= 0, _upper_tail(z)).otherwise(1 - _upper_tail(-z))


def _two_sided(z: Column) -> Column:
    return F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0))


def _total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + of(x).cast("double"))


def _encoded(c: Column) -> Column:
    """The token's encoding, as its place in ENCODINGS from 1, or 0."""
    number = F.lit(0)
    for at, encoding in reversed([*enumerate(ENCODINGS, 1)]):
        number = F.when(c["hit"].rlike(encoding.pattern), F.lit(at)).otherwise(number)
    return F.struct(c["start"], c["end"], F.rtrim(c["hit"], F.lit("=")).alias("body"), number.alias("e"))


def _coded(c: Column) -> Column:
    """The token's characters as places in the encoding's alphabet."""
    alphabets = F.array(*[F.lit(e.alphabet) for e in ENCODINGS])
    sizes = F.array(*[F.lit(float(len(e.alphabet))) for e in ENCODINGS])
    alphabet = F.element_at(alphabets, c["e"])
    codes = F.transform(F.split(c["body"], ""), lambda x: F.position(x, alphabet) - 1)
    return F.struct(
        c["start"], c["end"], c["e"], F.element_at(sizes, c["e"]).alias("m"), codes.alias("codes")
    )


def _counted(c: Column) -> Column:
    """What the three tests count."""
    codes, m = c["codes"], c["m"]
    n = F.size(codes)
    alphabet = F.sequence(F.lit(0), m.cast("int") - 1)
    pairs = F.zip_with(
        F.slice(codes, 1, n - 1),
        F.slice(codes, 2, n - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    middle = (m - 1) / 2
    changes = F.filter(pairs, lambda p: (2 * p["a"] >= m) != (2 * p["b"] >= m))
    return F.struct(
        c["start"],
        c["end"],
        c["e"],
        m.alias("m"),
        n.cast("double").alias("n"),
        _total(alphabet, lambda x: F.pow(F.size(F.filter(codes, lambda y: y == x)), F.lit(2))).alias("squares"),
        F.size(F.filter(codes, lambda x: 2 * x >= m)).cast("double").alias("high"),
        (F.size(changes) + 1).cast("double").alias("runs"),
        _total(pairs, lambda p: (p["a"] - middle) * (p["b"] - middle)).alias("products"),
    )


def _judged(c: Column) -> Column:
    """The stratum of the token and the bin of its combined p-value."""
    n, m = c["n"], c["m"]
    # Chi-squared with its exact moments under the hypothesis, as counts are small.
    chi = m / n * c["squares"] - n
    uniform = _one_sided((chi - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n))
    mean = 2 * c["high"] * (n - c["high"]) / n + 1
    spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    runs = F.when(spread > 0, _two_sided((c["runs"] - mean) / spread)).otherwise(F.lit(1e-8))
    serial = _two_sided(c["products"] / ((m * m - 1) / 12) / F.sqrt(n - 1))
    x = -F.log(uniform) - F.log(runs) - F.log(serial)
    p = F.exp(-x) * (1 + x + x * x / 2)
    place = F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-9))) * BINS_PER_DECADE), F.lit(LAST_BIN))
    band = F.lit(0)
    for least in BANDS:
        band = band + (n >= least).cast("int")
    return F.struct(
        c["start"],
        c["end"],
        F.concat_ws(":", c["e"], band).alias("stratum"),
        place.cast("int").alias("bin"),
        (n * F.log2(m) >= LEAST_BITS).alias("long_enough"),
    )


def _as_kind(at: int) -> Callable[[Column], Column]:
    return lambda c: F.struct(c["start"], F.lit(at).alias("kind"), c["end"])


def scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the base spans (start, kind, end) and the tested tokens of each text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    hits = docs.withColumns({f"{_HITS}_{k}": _hits(whole, p) for k, p in patterns.items()})
    placed = {k: _placed(whole, F.col(f"{_HITS}_{k}"), p) for k, p in patterns.items()}
    placed["assign"] = F.filter(
        placed["assign"],
        lambda c: F.length(F.regexp_extract(c["hit"], ASSIGN, 2)) >= ASSIGN_LEAST,
    )
    base = F.array_sort(
        F.concat(*[F.transform(placed[k], _as_kind(at)) for at, k in enumerate(KINDS[:-1])])
    )
    rows = hits.withColumns({_BASE: base, _TOKENS: placed["token"]})
    apart = _apart(F.col(_TOKENS), F.col(_BASE))
    rows = rows.withColumn(_TOKENS, F.filter(F.transform(apart, _encoded), lambda c: c["e"] > 0))
    for step in (_coded, _counted, _judged):
        rows = rows.withColumn(_TOKENS, F.transform(_TOKENS, step))
    return rows.drop(*[f"{_HITS}_{k}" for k in patterns])


def rejections(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """For each stratum the least bin of p-values that is not reported.

    p-values of random tokens are uniform and those of others lie near zero. So the tokens
    above one half, and one more for chance, tell how many random ones a stratum has, and how
    many of those reported down to some p-value are none of them. The furthest bin is
    taken at which that is at most the share ``FDR``. The counts are over all texts, at most
    strata times bins rows, whatever the input.
    """
    tokens = scan(docs.select(F.col(text).alias("text")), "text").select(F.explode(_TOKENS).alias("t"))
    counts = tokens.groupBy("t.stratum", "t.bin").count()
    here = Window.partitionBy("stratum")
    upper = F.sum(F.when(F.col("bin") < RANDOM_BINS, F.col("count")).otherwise(0)).over(here)
    ranked = counts.select(
        "stratum",
        "bin",
        ((upper + 1) / (1 - 10 ** (-RANDOM_BINS / BINS_PER_DECADE))).alias("random"),
        F.sum("count").over(here.orderBy("bin")).alias("reported"),
    )
    edge = F.pow(F.lit(10.0), -(F.col("bin") + 1) / BINS_PER_DECADE)
    false_share = 1 - F.col("random") * (1 - edge) / F.col("reported")
    ends = ranked.groupBy("stratum").agg(F.max(F.when(false_share <= FDR, F.col("bin"))).alias("last"))
    return {r["stratum"]: -1 if r["last"] is None else r["last"] + 1 for r in ends.collect()}


def find_secrets(
    docs: DataFrame, text: str = "text", into: str = "secrets", rejected: dict[str, int] | None = None
) -> DataFrame:
    """``docs`` with an array ``into`` of spans (start, kind, end), by start and then kind.

    ``kind`` is a place in KINDS; ends are exclusive; positions are code points. A null or
    empty text has none. Rows and other columns stay as they are. ``rejected`` is what
    :func:`rejections` found over the whole corpus; without it, it is taken from ``docs``.
    """
    rejected = rejections(docs, text) if rejected is None else rejected
    limits = F.create_map(*[F.lit(x) for pair in rejected.items() for x in pair]) if rejected else None

    def random(c: Column) -> Column:
        limit = F.coalesce(limits[c["stratum"]], F.lit(LAST_BIN + 1)) if rejected else F.lit(LAST_BIN + 1)
        return c["long_enough"] & (c["bin"] < limit)

    added = F.transform(F.filter(F.col(_TOKENS), random), _as_kind(len(KINDS) - 1))
    rows = scan(docs, text)
    return rows.withColumn(into, F.array_sort(F.concat(F.col(_BASE), added))).drop(_BASE, _TOKENS)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])
        ),
        ",",
    )


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    rows = find_secrets(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    last = len(KINDS) - 1
    rows = rows.select(
        "key", "secrets", F.filter("secrets", lambda c: c["kind"] < last).alias("base")
    )

    def count(at: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == at)).cast("long").alias(f"n_{KINDS[at]}")

    return rows.select(
        F.col("key").alias("doc_id"),
        *[count(at) for at in range(last)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by its first kind."""
    names = F.array(*[F.lit(f"<{kind}>") for kind in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, c: Column) -> Column:
        between = F.substring(text, done["at"] + 1, c["start"] - done["at"])
        fresh = F.concat(done["out"], between, F.get(names, c["kind"]))
        return F.struct(
            F.greatest(done["at"], c["end"]).alias("at"),
            F.when(c["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"),
        )

    return F.aggregate(
        spans,
        begin,
        step,
        lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))),
    )
