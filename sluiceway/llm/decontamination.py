"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of every benchmark item. Windows of
one length form a searcher: its shift table tells from the last two words under the
window's end how far the end may move without missing an occurrence, and where it may not
move, the same two words name a bucket of windows that are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import prepare, record
from sluiceway.session import stored

WINDOW = 10
BLOCK = 2
# Benchmark text searched for in one pass; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20

# Letters in lower case, ASCII signs and controls as separators.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F else 32
    for c in range(256)
)
FOUND = record(
    n_words=T.LongType(),
    starts=T.ArrayType(T.IntegerType()),
    ends=T.ArrayType(T.IntegerType()),
    items=T.ArrayType(T.StringType()),
)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters, A-Z in lower case."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Searcher:
    """Finds windows of one length in lists of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], frozenset[str]]):
        self.length = len(next(iter(windows)))
        self.block = min(BLOCK, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for window, items in windows.items():
            for end in range(self.block, self.length + 1):
                part = window[end - self.block : end]
                move = self.length - end
                self.shift[part] = min(move, self.shift.get(part, self.default))
            self.buckets[window[self.length - self.block :]].append((list(window), items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """Starts of the occurrences with the items that have the window there."""
        length, shift, default = self.length, self.shift.get, self.default
        end, count = length, len(text)
        single = self.block == 1
        while end <= count:
            part = (text[end - 1],) if single else (text[end - 2], text[end - 1])
            move = shift(part, default)
            if move:
                end += move
                continue
            start = end - length
            here = text[start:end]
            for window, items in self.buckets[part]:
                if window == here:
                    yield start, items
            end += 1


def windows_of(items: Iterable[tuple[str | None, str | None]]) -> list[Searcher]:
    """One searcher for each length of window that the items have."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(dict)
    for item, text in items:
        own = words(text)
        size = min(WINDOW, len(own))
        for start in range(len(own) - size + 1 if own else 0):
            holders = by_length[size].setdefault(tuple(own[start : start + size]), set())
            if item is not None:
                holders.add(item)
    return [
        Searcher({window: frozenset(items) for window, items in windows.items()})
        for _, windows in sorted(by_length.items())
    ]


def search(
    text: str | None, searchers: list[Searcher]
) -> tuple[int, list[int], list[int], list[str]]:
    """Number of words, the hit ranges of words (disjoint, in order), and the items found."""
    own = words(text)
    found: set[str] = set()
    ranges: list[tuple[int, int]] = []
    for searcher in searchers:
        for start, items in searcher.find(own):
            found |= items
            ranges.append((start, start + searcher.length))
    starts, ends = _union(ranges)
    return len(own), starts, ends, sorted(found)


def _union(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(ranges):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _finder(searchers: list[Searcher]):
    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [search(text, searchers) for text in texts]
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return find


@F.pandas_udf(FOUND)
def _merge(earlier: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for a, b in zip(earlier.itertuples(index=False), later.itertuples(index=False), strict=True):
        ranges = [*zip(a.starts, a.ends, strict=True), *zip(b.starts, b.ends, strict=True)]
        starts, ends = _union(ranges)
        rows.append((a.n_words, starts, ends, sorted({*a.items, *b.items})))
    return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])


def passes(benchmark: DataFrame, item: str, text: str, pass_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``pass_bytes`` of text."""
    items = benchmark.select(
        F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // pass_bytes) or 1
    part = F.pmod(F.xxhash64("text", "item"), F.lit(parts))
    return [items.where(part == n).select("item", "text") for n in range(parts)]


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "found",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, hit ranges ``starts`` and ``ends``, items.

    All columns of ``docs`` are kept; an earlier column named ``into`` is replaced. A null
    or empty text has no words and no hits. An item without words has no window; an item
    whose id is null hits words but is not listed; repeated items count once; an empty
    benchmark hits nothing. The patterns of a pass, at most about ``pass_bytes`` of text,
    go to the tasks with the function; between two passes the rows are stored.
    """
    prepare(docs.sparkSession)
    parts = passes(benchmark, item, item_text, pass_bytes)

    def scan(rows: DataFrame, part: tuple[int, DataFrame]) -> DataFrame:
        number, patterns = part
        find = _finder(windows_of((r["item"], r["text"]) for r in patterns.toLocalIterator()))
        now = find(F.col(text).cast("string"))
        if not number:
            return rows.withColumn(into, now)
        return stored(rows, "decontamination").withColumn(into, _merge(F.col(into), now))

    return reduce(scan, enumerate(parts), docs)


def is_hit(found: str = "found") -> Column:
    return F.size(f"{found}.starts") > 0


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: counts of words, hit words and items, and the items' digest."""
    rows = find_benchmark(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark
    )
    lengths = F.zip_with("found.ends", "found.starts", lambda end, start: (end - start).cast("long"))
    listed = F.array_join("found.items", ",")
    return rows.select(
        F.col("key").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        is_hit().alias("contaminated"),
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, text: str = "text"
) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    found = "__found"
    return find_benchmark(docs, benchmark, text, into=found).where(~is_hit(found)).drop(found)
