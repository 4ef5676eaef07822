"""Group spelling variants of the words of a corpus by permuterm rotations.

A word marked with a terminator has a rotation for each place of its characters. Two words
that differ in one character have rotations that agree up to the last one, which is the
edited one; a word that lacks a character is itself the prefix of the rotation that ends in
it. So rotations are sorted and read in ranges of that prefix. A range holds at most one
word without the skipped character and one word for each character of the alphabet: its
size is bounded by the alphabet. Each member leaves it as one row, with its number of
neighbours there and the best of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import of_text, prepare, record
from sluiceway.session import stored

RUN = r"[A-Za-zÀ-ÿ]+"
# One occurrence in so many, chosen by its hash, loses a character.
SLIP = 199
TERMINATOR = "$"
LEAST_LENGTH = 6
LEAST_COUNT = 5
# A form is at least so many times as frequent as its variant.
RATIO = 5
WORDS_AT_ONCE = 200_000

ROTATED = record(
    prefix=T.StringType(), skipped=T.StringType(), leads=T.BooleanType(), n=T.LongType()
)
NEAR = record(word=T.StringType(), n_near=T.LongType(), near_n=T.LongType(), near=T.StringType())
COUNTED = record(word=T.StringType(), n=T.LongType())
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def slipped(prefix: int, word: str) -> str:
    """The word, without one character if the hash of row and word says so."""
    hashed = zlib.crc32(word.encode(), prefix)
    if hashed % SLIP:
        return word
    at = hashed % len(word)
    return word[:at] + word[at + 1 :]


def _counting(least_length: int):
    find = re.compile(RUN).findall

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            COUNTED.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(
                batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                prefix = zlib.crc32(f"{'' if key is None else key}:".encode())
                for letters, n in Counter(find(text)).items():
                    own = slipped(prefix, letters if letters.islower() else letters.translate(LOWER))
                    if len(own) >= least_length:
                        counts[own] += n
                if len(counts) >= WORDS_AT_ONCE:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return run


def word_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """``word`` and ``n`` of all words of the corpus, of given length and frequency.

    Words are maximal runs of Latin letters, A-Z lower-cased. Tasks add up what they read
    before words travel, so a very frequent word is one row per task.
    """
    prepare(docs.sparkSession)
    texts = of_text(docs, key, text).where(F.length("text") >= least_length)
    texts = texts.select(F.col("key").cast("string").alias("key"), "text")
    counted = texts.mapInArrow(_counting(least_length), COUNTED)
    totals = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return totals.where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix``, ``skipped`` and ``n`` of all rotations of the words, whole and cut.

    A whole rotation has an empty ``skipped``; a cut one lacks its last character, which is
    ``skipped``, and ``leads`` says that the character before is another one. From prefix
    and skipped character the word can be read again, so words do not travel beside.
    """
    places = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    before, after = F.expr("left(word, at)"), F.expr("substr(word, at + 1)")
    whole = F.struct(
        F.concat(after, F.lit(TERMINATOR), before).alias("prefix"),
        F.lit("").alias("skipped"),
        F.lit(False).alias("leads"),
    )
    skipped = F.expr("substr(word, at + 1, 1)")
    cut = F.struct(
        F.concat(F.expr("substr(word, at + 2)"), F.lit(TERMINATOR), before).alias("prefix"),
        skipped.alias("skipped"),
        ((F.col("at") == 0) | (skipped != F.expr("substr(word, at, 1)"))).alias("leads"),
    )
    both = F.when(F.col("at") < F.length("word"), F.array(whole, cut)).otherwise(F.array(whole))
    return places.select("n", F.explode(both).alias("r")).select("r.*", "n")


def _near(prefix: str, members: list[tuple[str, bool, int]]) -> Iterator[tuple[str, int, int, str]]:
    """For each member that has neighbours: word, their number, count and name of the best."""
    after, before = prefix.split(TERMINATOR)
    ordered = sorted((-n, before + skipped + after, skipped, leads) for skipped, leads, n in members)
    cut = sum(skipped != "" for _, _, skipped, _ in ordered)
    leading = sum(leads for _, _, _, leads in ordered)
    whole = len(ordered) - cut
    for own in ordered:
        _, word, skipped, leads = own
        count = cut - 1 + (whole if leads else 0) if skipped else leading
        if count:
            # A whole rotation and a cut one are near where the cut one leads.
            best = next(
                b
                for b in ordered
                if b is not own and (leads or b[2] if skipped else b[3])
            )
            yield word, count, -best[0], best[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read sorted rotations group by group; the last group of a batch waits for the next."""
    waiting: pa.Table | None = None

    def scanned(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, rows.num_rows))
        # Rows of groups with one member need not leave Arrow.
        kept = rows.filter(pa.array(np.repeat(sizes > 1, sizes)))
        prefixes, skipped, leads, n = (kept.column(c).to_pylist() for c in ROTATED.names)
        out, at = [], 0
        for size in sizes[sizes > 1].tolist():
            members = list(zip(skipped[at : at + size], leads[at : at + size], n[at : at + size], strict=True))
            out.extend(_near(prefixes[at], members))
            at += size
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, NEAR.names)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if waiting is not None:
            rows = pa.concat_tables([waiting, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        prefix = rows.column("prefix").combine_chunks()
        same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1))
        starts = np.flatnonzero(np.append(True, ~same.to_numpy(zero_copy_only=False)))
        last = int(starts[-1])
        yield scanned(rows.slice(0, last), starts[:-1])
        waiting = rows.slice(last)
    if waiting is not None:
        yield scanned(waiting, np.array([0]))


def neighbours(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and its best near word (``near_n``, ``near``), where there is one.

    Near words differ by exactly one inserted, deleted or replaced character. All rotations
    are sorted over the cluster; the range of a prefix holds the rotation that equals it and
    those with one more character. A pair that differs by one of several equal letters in a
    row meets in as many ranges; it counts in that of the first of them (``leads``).
    """
    ranges = rotations(words).repartitionByRange("prefix").sortWithinPartitions("prefix")
    members = ranges.mapInArrow(_scan, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return (
        members.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms. Each round doubles the steps.

    Counts grow by RATIO along a chain, so chains are short and have no cycles.
    """
    chained = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = chained.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = chained.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stored(moved, "roots")
        chained = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chained


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the different results of :func:`word_counts`. ``form`` is the near word of
    largest count, among equal ones the first in code-point order, if it is at least five
    times as frequent; else null. ``root`` is the end of the chain of forms, the word itself
    if it has none. A null or empty text has no words; a null id reads as an empty one;
    repeated rows count as rows. No other column is read. An empty table has no words.
    """
    words = stored(word_counts(docs, key, text, least_length, least_count), "words")
    near = words.join(neighbours(words), "word", "left")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    found = stored(
        near.select(
            "word",
            F.when(is_form, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
