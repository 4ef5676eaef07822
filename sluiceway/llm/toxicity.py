"""Toxicity of whole texts by a weighted finite-state grammar of clauses.

Words become symbols: insult, threat, target, negation, reported speech, other. Three
transducers read a clause's symbols: one marks what follows a verb of saying as reported,
one marks what a negation reaches as negated, one collects insults, threats and targets
into the clause's pattern. Their composition is one deterministic machine. Labels give each
trigger word the weight of its arcs and each pattern its weight in the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import held_out, prepare, record
from sluiceway.llm.logistic import fit_logistic, sample_of
from sluiceway.session import stored

FOLDS, TEST_FOLD = 5, 0
# At most about so many labelled rows, chosen by a hash of their id, fit the weights.
FIT_ROWS = 50_000
# A stem must be in so many unmatched toxic documents, and so much more frequent there.
STEM_DOCS, STEM_LIFT = 8, 4
STEM_LENGTHS = (3, 10)
NEGATION_REACH = 3

# Seed words in English, German, French and Spanish.
INSULTS = """
idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown clowns disgusting
dumb fool fools imbecile cretin jerk bastard bastards vermin garbage filth filthy subhuman ugly
idioten dumm dummkopf trottel abschaum wertlos arschloch blöd ekelhaft versager
imbécile idiote idiotes connard salaud stupide crétin ordure dégoûtant minable
idiota idiotas estúpido estúpida imbécil basura inútil asqueroso patético escoria
""".split()
THREATS = """
kill hurt destroy murder strangle stab shoot beat crush exterminate
töten umbringen vernichten verprügeln erschießen tuer frapper détruire égorger écraser
matar golpear destruir aplastar apuñalar
""".split()
TARGETS = """
you your yours yourself u he she him her they them their du dich dir dein euch ihr sie
tu toi te vous ton votre il elle eux ti usted ustedes vosotros él ella ellos
""".split()
NEGATIONS = "not no never none isn aren wasn don nicht kein keine nie pas jamais ni nunca sin".split()
REPORTS = """
said says say called calls wrote writes claimed claims quoted according sagte sagt nannte schrieb
dit disait appelle écrit selon dijo dice llamó escribió según
""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
PLAIN, NEGATED, REPORTED = range(3)
_CLAUSE_END = re.compile("[.!?;:\n\r…|]")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Transducer:
    """States are any values; a step reads a symbol and gives the next state and a symbol."""

    start: Hashable
    step: Callable[[Hashable, tuple[int, int]], tuple[Hashable, tuple[int, int]]]
    final: Callable[[Hashable], Hashable] = lambda state: None


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds what ``first`` writes to ``second``."""

    def step(state, symbol):
        one, written = first.step(state[0], symbol)
        two, written = second.step(state[1], written)
        return (one, two), written

    return Transducer((first.start, second.start), step, lambda state: second.final(state[1]))


def _speech(state: bool, symbol: tuple[int, int]):
    kind, _ = symbol
    return state or kind == REPORT, (kind, REPORTED if state else PLAIN)


def _negation(left: int, symbol: tuple[int, int]):
    kind, mode = symbol
    if kind == NEGATION:
        return NEGATION_REACH, symbol
    return max(0, left - 1), (kind, NEGATED if left and mode == PLAIN else mode)


def _collect(state: tuple[bool, int | None, int], symbol: tuple[int, int]):
    target, trigger, mode_of = state
    kind, mode = symbol
    if kind == TARGET:
        return (True, trigger, mode_of), symbol
    if kind in (INSULT, THREAT):
        # The clause keeps its plainest mode, and a threat before an insult.
        better = trigger is None or (mode, -kind) < (mode_of, -trigger)
        return (target, kind if better else trigger, mode if better else mode_of), symbol
    return state, symbol


def _pattern(state: tuple[bool, int | None, int]) -> int | None:
    target, trigger, mode = state
    return None if trigger is None else (trigger * 2 + target) * 3 + mode


PATTERNS = 2 * 2 * 3
GRAMMAR = compose(
    compose(Transducer(False, _speech), Transducer(0, _negation)),
    Transducer((False, None, PLAIN), _collect, _pattern),
)


@cache
def machine() -> tuple[dict[tuple[int, int], int], list[int | None]]:
    """The grammar's reachable states as one table, and the pattern of each state."""
    numbers, order, table = {GRAMMAR.start: 0}, [GRAMMAR.start], {}
    for state in order:  # grows while it is read
        for kind in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER):
            after, _ = GRAMMAR.step(state, (kind, PLAIN))
            if after not in numbers:
                numbers[after] = len(order)
                order.append(after)
            table[numbers[state], kind] = numbers[after]
    return table, [GRAMMAR.final(state) for state in order]


@dataclass
class Lexicon:
    """Symbols of words, and a search for the words that can start a match.

    ``stems`` are learned: a word that begins with one is an insult and counts as its stem.
    """

    stems: tuple[str, ...] = ()
    kinds: dict[str, int] = field(init=False)
    search: ahocorasick.Automaton | None = field(init=False, default=None)

    def __post_init__(self):
        lists = (INSULTS, THREATS, TARGETS, NEGATIONS, REPORTS)
        self.kinds = {w: k for k, words in reversed([*enumerate(lists)]) for w in words}
        self.known_stems = frozenset(self.stems)
        self.lengths = sorted({len(stem) for stem in self.stems})

    def __getstate__(self):
        return self.__dict__ | {"search": None}

    def triggers(self) -> ahocorasick.Automaton:
        """Finds trigger words (True: the word must end there) and stems (False)."""
        if self.search is None:
            self.search = ahocorasick.Automaton()
            for stem in self.stems:
                self.search.add_word(stem, (stem, False))
            for word, kind in self.kinds.items():
                if kind in (INSULT, THREAT) and word not in self.known_stems:
                    self.search.add_word(word, (word, True))
            self.search.make_automaton()
        return self.search

    def symbol(self, word: str) -> tuple[int, str]:
        """The word's symbol, and the entry that gives it."""
        kind = self.kinds.get(word, OTHER)
        if kind == OTHER:
            for length in self.lengths:
                if word[:length] in self.known_stems:
                    return INSULT, word[:length]
        return kind, word


def clauses(text: str | None, lexicon: Lexicon) -> list[tuple[int, list[str]]]:
    """Pattern and trigger words of each matched clause of a text.

    Clause marks and triggers are met in one pass forward: no mark lies inside a trigger, so
    the last mark passed begins the trigger's clause and the next one ends it.
    """
    text = (text or "").lower()
    found, done = [], -1
    marks = _CLAUSE_END.finditer(text)
    begin, mark = 0, next(marks, None)
    for end, (word, whole) in lexicon.triggers().iter(text):
        start = end - len(word) + 1
        inside = start > 0 and text[start - 1].isalnum()
        if start < done or inside or (whole and text[end + 1 : end + 2].isalnum()):
            continue
        while mark and mark.start() < start:
            begin, mark = mark.end(), next(marks, None)
        done = mark.start() if mark else len(text)
        match = _matched(_WORD.findall(text, begin, done), lexicon)
        if match:
            found.append(match)
    return found


def _matched(words: list[str], lexicon: Lexicon) -> tuple[int, list[str]] | None:
    table, patterns = machine()
    state, used = 0, []
    for word in words:
        kind, entry = lexicon.symbol(word)
        state = table[state, kind]
        if kind in (INSULT, THREAT):
            used.append(entry)
    pattern = patterns[state]
    return None if pattern is None else (pattern, used)


MATCHES = record(
    patterns=T.ArrayType(T.IntegerType()),
    words=T.ArrayType(T.ArrayType(T.StringType())),
)


@dataclass(frozen=True)
class Model:
    """A lexicon, the weights of trigger words (arcs), and those of the document's features."""

    lexicon: Lexicon
    precision: dict[str, float]
    beta: np.ndarray

    def scores(self, matches: list[list[tuple[int, list[str]]]]) -> np.ndarray:
        x = np.array([features(found, self.precision) for found in matches])
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x.reshape(-1, PATTERNS + 1) @ self.beta[1:], -30, 30)))


def features(found: list[tuple[int, list[str]]], precision: dict[str, float]) -> list[float]:
    """The logarithm of each pattern's summed arc weights, and whether anything matched."""
    sums = [0.0] * PATTERNS
    for pattern, words in found:
        sums[pattern] += sum(precision.get(word, 0.5) for word in words)
    return [*np.log1p(sums).tolist(), float(any(sums))]


def _matcher(lexicon: Lexicon):
    @F.pandas_udf(MATCHES)
    def match(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = clauses(text, lexicon)
            rows.append(([p for p, _ in found], [w for _, w in found]))
        return pd.DataFrame(rows, columns=["patterns", "words"])

    return match


def _training_labels(labels: DataFrame, label_key: str, label: str) -> DataFrame:
    """At most about FIT_ROWS ids outside the test fold with the highest of their labels."""
    usable = labels.where(~held_out(label_key, FOLDS, TEST_FOLD) & F.col(label).isin(0, 1))
    by_id = usable.groupBy(F.col(label_key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    return sample_of(by_id, "key", FIT_ROWS)


def prefixes(text: str | None) -> set[str]:
    """All beginnings of the text's words that could be stems."""
    words = set(_WORD.findall((text or "").lower()))
    longest = STEM_LENGTHS[-1]
    return {w[:k] for w in words for k in range(STEM_LENGTHS[0], min(longest, len(w)) + 1)}


def _held(candidates: frozenset[str] | None):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def held(texts: pd.Series) -> pd.Series:
        found = (prefixes(text) for text in texts)
        return pd.Series([sorted(p if candidates is None else p & candidates) for p in found])

    return held


def learned_stems(rows: DataFrame) -> tuple[str, ...]:
    """Stems that unmatched toxic documents share and clean ones mostly lack.

    ``rows`` are labelled texts (text, y, missed), a bounded number. Stems are chosen one
    after another: each is the one whose presence tells the toxic documents not yet covered
    from the clean ones best, by the likelihood ratio; it must be STEM_LIFT times as frequent.
    """
    missed, clean = rows.where("missed"), rows.where("y = 0")
    n_missed, n_clean = missed.count(), clean.count()
    if n_missed < STEM_DOCS:
        return ()

    def counted(of: DataFrame, candidates: frozenset[str] | None) -> DataFrame:
        return of.select(F.explode(_held(candidates)("text")).alias("p")).groupBy("p").count()

    least = max(STEM_DOCS, n_missed // 100)
    candidates = frozenset(
        r["p"] for r in counted(missed, None).where(F.col("count") >= least).collect()
    )
    in_clean = {r["p"]: r["count"] for r in counted(clean, candidates).collect()}
    held = [set(r["p"]) for r in missed.select(_held(candidates)("text").alias("p")).collect()]
    stems: list[str] = []
    while len(held) >= STEM_DOCS:
        counts = Counter(p for own in held for p in own)
        ranked = [
            (_evidence(n, n_missed, in_clean.get(p, 0), n_clean), p)
            for p, n in counts.items()
            if n >= STEM_DOCS
            and n / n_missed >= STEM_LIFT * (in_clean.get(p, 0) + 0.5) / (n_clean + 1)
        ]
        if not ranked:
            break
        stem = max(ranked, key=lambda x: (x[0], len(x[1]), x[1]))[1]
        stems.append(stem)
        held = [own for own in held if stem not in own]
    return tuple(stems)


def _evidence(a: int, n: int, b: int, m: int) -> float:
    """The likelihood ratio of two shares a / n and b / m against a common one."""

    def part(x: int, of: int, p: float) -> float:
        return (x * math.log(p) if x else 0.0) + ((of - x) * math.log1p(-p) if of > x else 0.0)

    both = (a + b) / (n + m)
    return part(a, n, a / n) + (part(b, m, b / m) if m else 0.0) - part(a, n, both) - part(b, m, both)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label_key: str = "doc_id",
    label: str = "toxic",
) -> Model:
    """Learn stems and weights from at most about FIT_ROWS labelled training documents.

    Labels other than 0 and 1 are ignored; of several labels of an id the highest counts.
    Without labels every weight stays at its prior.
    """
    prepare(docs.sparkSession)
    known = stored(_training_labels(labels, label_key, label), "labels")
    # The labels are a bounded number of ids, so they go to the texts.
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(known), "key"
    )
    lexicon = Lexicon()
    first = stored(texts.withColumn("m", _matcher(lexicon)("text")), "matches")
    missed = first.withColumn("missed", F.expr("y = 1 AND size(m.patterns) = 0"))
    stems = learned_stems(missed)
    if stems:
        lexicon = Lexicon(stems)
    rows = first.select("y", _matcher(lexicon)("text").alias("m")).select("y", "m.*").toPandas()
    found = [
        list(zip(p, w, strict=True)) for p, w in zip(rows["patterns"], rows["words"], strict=True)
    ]
    y = rows["y"].to_numpy("float64")
    seen, toxic = Counter(), Counter()
    for own, label_of in zip(found, y, strict=True):
        words = {word for _, used in own for word in used}
        seen.update(words)
        toxic.update(words if label_of else ())
    precision = {word: (toxic[word] + 0.5) / (n + 1) for word, n in seen.items()}
    x = np.array([features(own, precision) for own in found]).reshape(-1, PATTERNS + 1)
    return Model(lexicon, precision, fit_logistic(x, y))


def with_score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; a null or empty text matches nothing."""
    prepare(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([clauses(t, model.lexicon) for t in texts]), dtype="float64")

    return docs.withColumn(into, score(F.col(text).cast("string")))


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score at least 0.5)."""
    model = fit(docs, labels, key, text)
    rows = docs.select(
        F.col(key).alias("doc_id"), held_out(key, FOLDS, TEST_FOLD).alias("held_out"), F.col(text).alias("text")
    )
    return with_score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    score = "__score"
    rows = with_score(docs, fit(docs, labels, key, text), text, score)
    return rows.where(F.col(score) < 0.5).drop(score)
