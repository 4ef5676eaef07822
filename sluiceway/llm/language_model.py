"""Log-probabilities of whole texts under a backoff automaton learned from the corpus.

The automaton has a root and a state for each word of the training documents. An arc leads
from a state by each word that followed its word in training, with the smoothed
log-probability as its weight. A word without an arc takes the failure arc to the root,
whose weight discounts the root's arc for the word. A word that training lacks leads to the
root. A document is read once, from its begin state to its end token, and the weights of
the arcs taken add up.

The automaton is as large as the corpus, so no task holds it. Documents are dealt into
blocks of bounded size. Each block sends the distinct words and pairs it needs, with their
training counts, to the bucket of their hash; a bucket adds up the counts of all blocks and
answers each block in the block's own order. From the answers a block builds the states, arcs
and failure arcs that its documents can reach, and walks every document through them, carrying
the state. States have a depth of one, the last word.

How much of a state's probability its own arcs get is learned from the training tokens, each
left out of the counts in turn, for states of like counts (:func:`learned_shares`).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import held_out, prepare, record
from sluiceway.session import stored

FOLDS, TEST_FOLD = 7, 2
BLOCK_BYTES = 8 << 20
# Share of a state's probability that its own arcs get if none are learned, by the doublings of
# its count; the failure arc has the rest. The last holds for all larger counts.
OWN_SHARE = (
    *(0.4, 0.3, 0.3, 0.3, 0.3, 0.4, 0.4, 0.5, 0.5, 0.5, 0.5, 0.6, 0.6, 0.7, 0.7, 0.7, 0.8),
)
# Shares that are tried for each doubling, and the doublings of all counts below 2 ** 48.
TRIED = tuple(i / 40 for i in range(1, 40)) + (0.985, 0.99, 0.995, 0.998, 0.999)
DOUBLINGS = 48

# Keys of counts: a hash with what is counted in its two lowest bits.
BEGIN, WORD, PAIR = 0, 1, 2
_MASK = (1 << 64) - 4
_BEGIN_KEY = np.uint64(0)

ASKED = record(
    bucket=T.LongType(), block=T.LongType(), keys=T.BinaryType(), counts=T.BinaryType()
)
ANSWERED = record(
    bucket=T.LongType(),
    block=T.LongType(),
    counts=T.BinaryType(),
    words=T.LongType(),
    tokens=T.LongType(),
)


def _key(word: bytes, seed: int = 0) -> int:
    """64-bit hash of a word; two words share one with a probability of 2 ** -62."""
    return xxhash.xxh3_64_intdigest(word, seed) & _MASK | WORD


_END_KEY = _key(b"end", 1)


def _numbered(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's words, split and numbered by Arrow without a Python object for each token.

    Returns the key of each number, the numbers of all tokens, and the tokens of each text;
    number 0 is the end, which follows the words of a text. Words are those of
    :func:`sluiceway.llm.common.ascii_words`.
    """
    raw = [text.encode("utf-8", "surrogatepass") if text else b"" for text in texts]
    column = pa.array(raw, pa.large_binary())
    # The same bytes as text, not validated again: only ASCII bytes are looked at.
    column = pa.LargeStringArray.from_buffers(len(raw), column.buffers()[1], column.buffers()[2])
    parts = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words = parts.flatten()
    # White space at either end of a text leaves an empty part there.
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(filled)])[np.cumsum(pc.list_value_length(parts).to_numpy())]
    coded = words.filter(pa.array(filled)).dictionary_encode()
    different = coded.dictionary.cast(pa.large_binary(), safe=False).to_numpy(zero_copy_only=False)
    keys = np.fromiter(map(_key, different), "uint64", len(different))
    number = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype("int64") + 1, ends, 0)
    return np.append(np.uint64(_END_KEY), keys), number, np.diff(ends, prepend=0) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens(NamedTuple):
    """A block's distinct keys in order, and where its tokens are among them."""

    keys: np.ndarray
    sizes: np.ndarray  # tokens of each document
    begin: int
    words: np.ndarray  # by token: its word, its pair with the word before, and that word
    pairs: np.ndarray
    contexts: np.ndarray


def _read(texts: list[str | None]) -> Tokens:
    key_of, number, counts = _numbered(texts)
    begins = np.cumsum(counts) - counts
    tokens = key_of[number]
    before = np.roll(tokens, 1)
    before[begins] = _BEGIN_KEY
    pairs = _mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
    pairs, of_token = np.unique(pairs & np.uint64(_MASK) | np.uint64(PAIR), return_inverse=True)
    # The begin is the least of all keys; words and pairs lie among each other.
    words, of_number = np.unique(key_of, return_inverse=True)
    keys = np.sort(np.concatenate([np.array([_BEGIN_KEY]), words, pairs]), kind="stable")
    word_at = 1 + np.arange(len(words)) + np.searchsorted(pairs, words)
    pair_at = 1 + np.arange(len(pairs)) + np.searchsorted(words, pairs)
    at = word_at[of_number][number]
    contexts = np.roll(at, 1)
    contexts[begins] = 0
    return Tokens(keys, counts, 0, at, pair_at[of_token], contexts)


def _shrink(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs."""
    raw = values.astype("<u8")
    width = max(1, (int(raw.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + raw.view("uint8").reshape(-1, 8)[:, :width].tobytes()


def _grow(blob: bytes) -> np.ndarray:
    width = blob[0]
    narrow = np.frombuffer(blob, "uint8", offset=1).reshape(-1, width)
    wide = np.zeros((len(narrow), 8), "uint8")
    wide[:, :width] = narrow
    return wide.reshape(-1).view("<u8")


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted keys, and their end."""
    edges = [-(-(b << 32) // buckets) << 32 for b in range(buckets)]
    return np.append(np.searchsorted(keys, np.array(edges, "uint64")), len(keys))


def _asker(buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        read = _read(rows["text"].tolist())
        keys, trains = read.keys, rows["train"].to_numpy("bool")
        learn = np.repeat(trains, read.sizes)
        times = np.bincount(read.words[learn], minlength=len(keys))
        times += np.bincount(read.pairs[learn], minlength=len(keys))
        times[read.begin] += trains.sum()
        at = _split(keys, buckets)
        block, out = int(rows["block"].iloc[0]), []
        for bucket in np.flatnonzero(at[1:] > at[:-1]).tolist():
            own = keys[at[bucket] : at[bucket + 1]]
            first = _shrink(own[:1])
            blob = bytes([len(first)]) + first + _shrink(np.diff(own))
            out.append((bucket, block, blob, _shrink(times[at[bucket] : at[bucket + 1]])))
        return pd.DataFrame(out, columns=["bucket", "block", "keys", "counts"])

    return ask


def _ungap(blob: bytes) -> np.ndarray:
    size = blob[0]
    first = _grow(blob[1 : 1 + size])
    return np.cumsum(np.concatenate([first, _grow(blob[1 + size :])]), dtype="uint64")


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's keys, block by block, and its numbers of words and tokens."""
    rows = rows.sort_values("block", ignore_index=True)
    asked = [_ungap(blob) for blob in rows["keys"]]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    times = np.concatenate([_grow(blob) for blob in rows["counts"]]).astype("float64")
    totals = np.bincount(place, weights=times).astype("uint64")
    of_words = totals[(keys & np.uint64(3)) == WORD]
    ends = np.cumsum([len(own) for own in asked])
    parts = np.split(totals[place], ends[:-1])
    return pd.DataFrame(
        {
            "bucket": rows["bucket"],
            "block": rows["block"],
            "counts": [_shrink(part) for part in parts],
            # Said once for each bucket, on its first row.
            "words": [int((of_words > 0).sum())] + [0] * (len(rows) - 1),
            "tokens": [int(of_words.sum())] + [0] * (len(rows) - 1),
        }
    )


def _doublings(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 1))[1] - 1


class Smoothing:
    """The log-probabilities that arcs get from training counts."""

    def __init__(self, words: int, tokens: int, shares: Sequence[float] = OWN_SHARE):
        self.all = tokens + words + 1
        self.shares = np.array(shares)

    def root_weights(self, count: np.ndarray) -> np.ndarray:
        """Add-one log-probabilities; every unknown word counts as one further word."""
        return np.log10((count + 1) / self.all)

    def own_share(self, state_count: np.ndarray) -> np.ndarray:
        share = self.shares[np.minimum(_doublings(state_count), len(self.shares) - 1)]
        return np.where(state_count > 0, share, 0.0)

    def failure_weights(self, state_count: np.ndarray) -> np.ndarray:
        """What the root's arcs cost more in a state; nothing in one without arcs of its own."""
        return np.log10(1 - self.own_share(state_count))

    def arc_weights(self, word: np.ndarray, state: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of arcs seen in training, from the counts of word, state and both."""
        share = self.own_share(state)
        root = (word + 1) / self.all
        return np.log10(share * pair / np.maximum(state, 1) + (1 - share) * root)


class Automaton:
    """The states and arcs that a block of documents can reach, numbered inside the block.

    A state is the begin or a word that training has; ``root`` is one more. From any state an
    arc is looked up by state and word. Where there is none, the failure arc leads to the root,
    which has an arc for every word of the block: to the word's state, or back to the root.
    """

    def __init__(self, smoothing: Smoothing, seen: Tokens, count: np.ndarray):
        is_pair = (seen.keys & np.uint64(3)) == PAIR
        number = np.cumsum(~is_pair) - 1  # of words and the begin among themselves
        of_words = count[~is_pair]
        self.root = len(of_words)
        self.begin = int(number[seen.begin]) if count[seen.begin] else self.root
        self.words = number[seen.words]
        # Where each pair of words comes from and by which word it leaves.
        source, label = np.zeros(len(count), "int64"), np.zeros(len(count), "int64")
        source[seen.pairs], label[seen.pairs] = number[seen.contexts], self.words
        # In the order of the texts, so that arcs of one text lie together in memory.
        first = np.zeros(len(count), "int64")
        first[seen.pairs[::-1]] = np.arange(len(seen.pairs))[::-1]
        arcs = np.flatnonzero(is_pair & (count > 0))
        arcs = arcs[np.argsort(first[arcs])]
        source, label = source[arcs], label[arcs]
        weights = smoothing.arc_weights(of_words[label], of_words[source], count[arcs])
        self.arcs = dict(zip((source * self.root + label).tolist(), weights.tolist(), strict=True))
        self.failure = [*smoothing.failure_weights(of_words).tolist(), 0.0]
        self.root_arcs = smoothing.root_weights(of_words).tolist()
        self.target = np.where(of_words > 0, np.arange(self.root), self.root).tolist()

    def walk(self, words: list[int]) -> float:
        """The weight of a document's path, read once from left to right."""
        arcs, failure, root_arcs, target, width = self.arcs, self.failure, self.root_arcs, self.target, self.root
        state, total = self.begin, 0.0
        for word in words:
            weight = arcs.get(state * width + word)
            if weight is None:
                weight = failure[state] + root_arcs[word]
            total += weight
            state = target[word]
        return total


def _answered(rows: pd.DataFrame, answers: pd.DataFrame) -> tuple[Tokens, np.ndarray]:
    """A block's tokens, and the training count of each of its keys."""
    read = _read(rows["text"].tolist())
    blobs = answers.sort_values("bucket")["counts"]
    totals = np.concatenate([_grow(blob) for blob in blobs]).astype("float64")
    if len(totals) != len(read.keys):
        raise RuntimeError("a block has changed since it asked for its counts")
    return read, totals


EVIDENCE = record(doubling=T.IntegerType(), tried=T.IntegerType(), fit=T.DoubleType())


def _witness(tokens_in_all: int, words: int):
    """What a block's training tokens say for each share that is tried."""
    all_but_one = tokens_in_all + words

    def witness(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and rows["train"].any():
            read, totals = _answered(rows, answers)
            learn = np.repeat(rows["train"].to_numpy("bool"), read.sizes)
            # Every pair once, with its number of training tokens here. A state seen once has
            # no arc left without its only token.
            times = np.bincount(read.pairs[learn], minlength=len(totals))
            word, state = np.zeros(len(totals)), np.zeros(len(totals))
            word[read.pairs], state[read.pairs] = totals[read.words], totals[read.contexts]
            use = np.flatnonzero((times > 0) & (state > 1))
            times, word, state, pair = times[use], word[use], state[use], totals[use]
            doubling = _doublings(state - 1)
            # Without what all shares have in common, the root's part: a token's probability
            # over that of the root's arc is 1 - share if its arc is gone without it.
            gone = pair == 1
            alone = np.bincount(doubling[gone], weights=times[gone], minlength=DOUBLINGS)
            more = (pair - 1) / (state - 1) * all_but_one / word - 1
            more, times, left = more[~gone], times[~gone], doubling[~gone]
            for at, share in enumerate(TRIED):
                fit = np.bincount(left, weights=times * np.log1p(share * more), minlength=DOUBLINGS)
                fit += alone * np.log1p(-share)
                out += [(d, at, float(fit[d])) for d in np.unique(doubling).tolist()]
        return pd.DataFrame(out, columns=[f.name for f in EVIDENCE])

    return witness


def learned_shares(fits: dict[tuple[int, int], float]) -> list[float]:
    """The likeliest share for each doubling of a state's count, none of them 0 or 1.

    ``fits`` has the log-likelihood of the training tokens by doubling and place in TRIED.
    Each token is left out of its counts, so a state seen n times speaks for those seen n - 1.
    A doubling without tokens gets the share of the next lower one, or 0.5.
    """
    shares: list[float] = []
    for doubling in range(DOUBLINGS):
        if any((doubling, at) in fits for at in range(len(TRIED))):
            # One token for and one against, so that little evidence gives no extreme.
            fit = [
                fits.get((doubling, at), 0.0) + np.log(share) + np.log(1 - share)
                for at, share in enumerate(TRIED)
            ]
            shares.append(TRIED[int(np.argmax(fit))])
        else:
            shares.append(shares[-1] if shares else 0.5)
    return shares


def _scorer(words: int, tokens_in_all: int, key_type: T.DataType, shares: Sequence[float]):
    smoothing = Smoothing(words, tokens_in_all, shares)

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[f.name for f in schema])
        read, totals = _answered(rows, answers)
        begins = np.cumsum(read.sizes) - read.sizes
        count = totals[read.words]
        base = smoothing.root_weights(count)
        automaton = Automaton(smoothing, read, totals)
        ends = (begins + read.sizes).tolist()
        scores = [
            automaton.walk(automaton.words[at:end].tolist())
            for at, end in zip(begins.tolist(), ends, strict=True)
        ]
        return pd.DataFrame(
            {
                "doc_id": rows["key"].to_numpy(),
                "held_out": ~rows["train"].to_numpy(),
                "n_tokens": read.sizes,
                "n_known": np.add.reduceat((count > 0).astype("int64"), begins),
                "train_tokens": tokens_in_all,
                "base_score": np.add.reduceat(base, begins),
                "score": scores,
            }
        )

    schema = T.StructType(
        [
            T.StructField("doc_id", key_type),
            *record(
                held_out=T.BooleanType(),
                n_tokens=T.LongType(),
                n_known=T.LongType(),
                train_tokens=T.LongType(),
                base_score=T.DoubleType(),
                score=T.DoubleType(),
            ),
        ]
    )
    return score, schema


def scored(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shares: Sequence[float] | None = OWN_SHARE,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null, empty or blank text is its end token alone. Rows without an id are held out.
    Without training documents every word is unknown. ``shares`` are what a state's own arcs
    get, by the doublings of its count; None learns them from the training documents, which
    reads the texts once more. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(key).alias("key"),
        (~held_out(key, FOLDS, TEST_FOLD)).alias("train"),
        F.col(text).cast("string").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    count = -(-total // BLOCK_BYTES) or 1
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(count)))
    asked = blocks.groupBy("block").applyInPandas(_asker(count), ASKED)
    answers = stored(asked.groupBy("bucket").applyInPandas(_answer, ANSWERED), "counts")
    words, tokens = answers.agg(F.sum("words"), F.sum("tokens")).first()
    dealt = blocks.groupBy("block").cogroup(answers.select("block", "bucket", "counts").groupBy("block"))
    if shares is None:
        evidence = dealt.applyInPandas(_witness(tokens or 0, words or 0), EVIDENCE)
        # At most DOUBLINGS times TRIED rows.
        fits = evidence.groupBy("doubling", "tried").agg(F.sum("fit").alias("fit")).collect()
        shares = learned_shares({(r["doubling"], r["tried"]): r["fit"] for r in fits})
    score, schema = _scorer(words or 0, tokens or 0, rows.schema["key"].dataType, shares)
    return dealt.applyInPandas(score, schema)
