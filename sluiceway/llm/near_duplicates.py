"""Near-duplicate documents by one-permutation MinHash with optimal densification.

One hash of each shingle serves all bins: the smallest hash in each of equal ranges is the
bin's value, and an empty bin borrows from the bin that a fixed probe sequence reaches
first. Bands of bins give buckets. Documents with equal shingle sets are one class, and
only classes meet in buckets. A bucket's members are paired with its centre, not with each
other, and pairs are confirmed on whole sets. A bucket may then still hold members that
are like each other but not like the centre. For the members of such buckets an exact rest
follows: those that share a rare shingle are first paired with its best centre; then the
few pairs of components that places and sizes leave possible are confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import Remembered, ascii_words, forgotten, prepare, record
from sluiceway.llm.components import components
from sluiceway.session import stored

BINS = 216
# A pair just similar enough misses every band with at most this probability.
MISS = 1e-7
PROBES = 64
# What a Python worker keeps of hashed words.
KEPT_BYTES = 32 << 20

SIGNATURE = record(n=T.LongType(), digest=T.BinaryType(), bands=T.ArrayType(T.LongType()))


def rows_per_band(percent: int) -> int:
    """The longest band whose chance to miss a pair of ``percent`` similarity is below MISS."""
    similar = percent / 100
    fits = [r for r in range(1, 17) if (1 - similar**r) ** (BINS // r) <= MISS]
    return max(fits, default=1)


@cache
def _hashes() -> Remembered:
    return Remembered(xxhash.xxh3_64_intdigest, KEPT_BYTES)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of ``size`` words."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, "uint64")
    hashed = np.fromiter(map(_hashes().__getitem__, words), "uint64", len(words))
    size = min(size, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, size, "uint64")
    for at in range(size):
        mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[at : at + count])
    return np.unique(mixed)


@cache
def _layout() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bins' lower edges, the probe sequences of empty bins, and a last order of bins."""
    edges = np.array([-(-(j << 32) // BINS) << 32 for j in range(BINS)], "uint64")
    numbers = np.arange(PROBES * BINS, dtype="uint64").reshape(PROBES, BINS)
    order = np.argsort(_mix(np.arange(BINS, dtype="uint64") + np.uint64(1 << 40)))
    return edges, (_mix(numbers + np.uint64(1)) % np.uint64(BINS)).astype("int64"), order


def signature(hashed: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a set that is not empty."""
    edges, probes, order = _layout()
    first = np.searchsorted(hashed, edges)
    after = np.append(first[1:], len(hashed))
    full = first < after
    donor = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        for probe in probes:
            to = probe[empty]
            found = full[to]
            donor[empty[found]] = to[found]
            empty = empty[~found]
            if not len(empty):
                break
        donor[empty] = order[full[order]][0]
    return hashed[first[donor]]


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = len(values) // rows
    keys = np.arange(bands, dtype="uint64")
    for column in values[: bands * rows].reshape(bands, rows).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view("int64")


def _signer(size: int, rows: int):
    def signed(text: str | None) -> tuple:
        hashed = shingles(text, size)
        bands = band_keys(signature(hashed), rows) if len(hashed) else []
        return len(hashed), xxhash.xxh3_128_digest(hashed.tobytes()), bands

    @F.pandas_udf(SIGNATURE)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with forgotten(_hashes()):
            for texts in batches:
                yield pd.DataFrame(list(map(signed, texts)), columns=["n", "digest", "bands"])

    return sign


def _sets(size: int):
    @F.pandas_udf(T.BinaryType())
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with forgotten(_hashes()):
            for texts in batches:
                yield texts.map(lambda text: shingles(text, size).tobytes())

    return whole


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    def shared(x: bytes, y: bytes) -> int:
        both = np.concatenate([np.frombuffer(x, "uint64"), np.frombuffer(y, "uint64")])
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())

    return pd.Series([shared(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _longs(sets: pd.Series) -> pd.Series:
    return sets.map(lambda own: np.frombuffer(own, "int64"))


class _Rounds:
    """Links between classes, found bucket by bucket, and what they connect."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent

    def keep_sets(self, members: DataFrame) -> None:
        """Compute the whole sets of the classes that share a bucket, once for all rounds."""
        needed = self.classes.select("node", "key", "hash").join(
            members.select("node").distinct(), "node"
        )
        texts = self.docs.join(
            needed,
            self.docs["text_hash"].eqNullSafe(needed["hash"])
            & self.docs["key"].eqNullSafe(needed["key"]),
        ).select("node", "text")
        whole = texts.dropDuplicates(["node"]).select("node", _sets(self.size)("text").alias("set"))
        self.sets = stored(whole, "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, na, nb) that are similar enough on whole sets."""
        a = self.sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        b = self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        # Stored, so that the joins can be split where a centre has very many pairs.
        pairs = stored(pairs.where(self.may_link("na", "nb")).distinct(), "pairs")
        measured = pairs.join(a, "a").join(b, "b").withColumn("common", _common("set_a", "set_b"))
        union = F.col("na") + F.col("nb") - F.col("common")
        links = measured.where(100 * F.col("common") >= self.percent * union).select("a", "b")
        return stored(links, "confirmed")

    def may_link(self, na: str, nb: str):
        """The smaller set must be large enough for the similarity to be possible at all."""
        return 100 * F.least(na, nb) >= self.percent * F.greatest(na, nb)

    def may_meet(self, na: str, nb: str, ra: str, rb: str):
        """Sets that have nothing in common before the places ``ra`` and ``rb`` share at most
        what is left from there on."""
        left = F.least(F.col(na) - F.col(ra), F.col(nb) - F.col(rb)) + 1
        return (100 + self.percent) * left >= self.percent * (F.col(na) + F.col(nb))

    def components(self) -> DataFrame:
        """``node`` and ``component`` of all classes that have links."""
        rows = self.classes.select(F.explode("bands").alias("key"), "node", "n")
        heads = rows.groupBy("key").agg(
            F.min("node").alias("head"), F.min_by("n", "node").alias("n_head"), F.count("*").alias("size")
        )
        members = stored(rows.join(heads.where("size > 1").drop("size"), "key"), "buckets")
        self.keep_sets(members)
        pairs = members.where("node <> head").select(
            F.col("head").alias("a"),
            F.col("node").alias("b"),
            F.col("n_head").alias("na"),
            F.col("n").alias("nb"),
        )
        within = stored(components(self.confirm(pairs)), "within")
        apart = self._open(self._labelled(members, within)).select("node").distinct()
        prefixes = self._prefixes(stored(apart, "apart"))
        within = self._joined(within, self.confirm(self._best_stars(prefixes, within)))
        return self._joined(within, self.confirm(self._left(prefixes, within)))

    def _labelled(self, members: DataFrame, within: DataFrame) -> DataFrame:
        return members.join(within, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )

    def _open(self, labelled: DataFrame) -> DataFrame:
        """The rows of keys that hold more than one component."""
        keys = labelled.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high")
        )
        return labelled.join(keys.where("low <> high").select("key"), "key")

    def _prefixes(self, apart: DataFrame) -> DataFrame:
        """The shared shingles among the rarest of each set: similar enough sets share one.

        In any common order of shingles, two such sets share one among the first
        ``n - ceil(similarity * n) + 1`` of each. The order is by number of holders, so that
        copies that each differ in their own way do not meet; ``rank`` is the place of a
        shingle in its set, those that no other set has included, and ``before`` the shared
        one before it.
        """
        held = self.sets.join(apart, "node").select("node", _longs("set").alias("own"))
        held = held.select("node", F.size("own").alias("n"), F.explode("own").alias("key"))
        common = held.groupBy("key").count().where("count > 1")
        shared = held.join(common, "key")
        of_node = Window.partitionBy("node")
        in_order = of_node.orderBy("count", "key")
        ranked = shared.select(
            "key",
            "node",
            F.col("n").cast("long").alias("n"),
            # Shingles that no other set has come before all shared ones.
            (F.col("n") - F.count("*").over(of_node) + F.row_number().over(in_order)).alias("rank"),
            F.lag("key").over(in_order).alias("before"),
        )
        first = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        return stored(ranked.where(F.col("rank") <= first), "prefixes")

    def _best_stars(self, prefixes: DataFrame, within: DataFrame) -> DataFrame:
        """Each member of a rare shingle with the centre that has the fewest rarer ones.

        In a group of copies that is the one closest to what they were copied from.
        """
        members = stored(self._open(self._labelled(prefixes, within)), "open")
        centres = members.groupBy("key").agg(F.min(F.struct("rank", "node", "n", "component")).alias("c"))
        named = centres.select(
            "key",
            F.col("c.node").alias("centre"),
            F.col("c.n").alias("n_centre"),
            F.col("c.rank").alias("its_rank"),
            F.col("c.component").alias("its"),
        )
        met = members.join(named, "key").where("its <> component")
        return met.where(self.may_meet("n", "n_centre", "rank", "its_rank")).select(
            F.col("centre").alias("a"), F.col("node").alias("b"), F.col("n_centre").alias("na"), F.col("n").alias("nb")
        )

    def _left(self, prefixes: DataFrame, within: DataFrame) -> DataFrame:
        """All pairs of components that rare shingles still leave open.

        A row stays if the smallest set that has the shingle, or could be similar to the
        row's, leaves the row a chance; then only shingles of several components stay. A
        pair meets at the first shingle it shares, not again at the next one.
        """
        labelled = stored(self._open(self._labelled(prefixes, within)), "open")
        least = labelled.groupBy("key").agg(F.min("n").alias("least"))
        smallest = F.greatest("least", F.ceil(F.col("n") * self.percent / 100))
        chance = (100 + self.percent) * (F.col("n") - F.col("rank") + 1) >= self.percent * (F.col("n") + smallest)
        live = stored(labelled.join(least, "key").where(chance).drop("least"), "live")
        live = stored(self._open(live), "live")
        sides = [
            live.select(
                "key",
                F.col("node").alias(x),
                F.col("n").alias(f"n{x}"),
                F.col("rank").alias(f"r{x}"),
                F.col("component").alias(f"of_{x}"),
                F.col("before").alias(f"before_{x}"),
            )
            for x in "ab"
        ]
        met = sides[0].join(sides[1], "key").where("a < b AND of_a <> of_b")
        again = F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False))
        return met.where(
            self.may_link("na", "nb") & self.may_meet("na", "nb", "ra", "rb") & ~again
        ).select("a", "b", "na", "nb")

    def _joined(self, within: DataFrame, more: DataFrame) -> DataFrame:
        """The components after further links, which join the components of before."""
        if more.isEmpty():
            return within
        ends = more.select("a", "b")
        for end in ("a", "b"):
            label = within.withColumnRenamed("node", end).withColumnRenamed("component", f"of_{end}")
            ends = ends.join(label, end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        moved = components(ends, "of_a", "of_b").select(
            F.col("node").alias("component"), F.col("component").alias("now")
        )
        # Nodes that had no link until now are their own components.
        known = within.unionAll(moved.select(F.col("component").alias("node"), "component"))
        known = known.groupBy("node").agg(F.min("component").alias("component"))
        after = known.join(moved, "component", "left")
        return stored(after.select("node", F.coalesce("now", "component").alias("component")), "within")


def _resolve(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """For every row its key, text hash, set size, component id, and the row that stays."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sign = _signer(size, rows_per_band(percent))
    signed = docs.select("key", "text_hash", sign("text").alias("s"))
    signed = stored(signed.select("key", "text_hash", "s.*"), "signatures")
    classes = (
        signed.where("n > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct("key", "text_hash")).alias("one"),
            F.min("key").alias("least"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"),
            "digest",
            "least",
            "n",
            "bands",
            F.col("one.key").alias("key"),
            F.col("one.text_hash").alias("hash"),
        )
    )
    classes = stored(classes, "classes")
    within = _Rounds(docs, classes, size, percent).components()
    labelled = classes.join(within, "node", "left").select(
        "digest",
        "least",
        F.coalesce("component", "node").alias("component"),
        F.struct("key", "hash").alias("one"),
    )
    # A row without an id stays only where no row of the component has one.
    first = F.min(F.struct(F.col("one.key").isNull().alias("no_key"), "one")).alias("first")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"), first)
    of_class = labelled.join(least, "component").select("digest", "component_id", "first.one")
    rows = signed.select("key", "text_hash", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    own = F.struct(F.col("key"), F.col("text_hash").alias("hash"))
    return rows.join(of_class, "digest", "left").select(
        "key",
        "text_hash",
        "n",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        ((F.col("n") == 0) | own.eqNullSafe(F.col("one"))).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Sets are distinct shingles of ``size`` words; a shorter text is one shingle; an empty,
    blank or null text has none and is linked with nothing: its component is itself. Rows
    of equal sets are always one component, be their ids equal or not. A null id never
    names a component unless no row of it has an id. No other column is read.
    """
    return _resolve(docs, key, text, size, percent).select(
        F.col("key").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each component, with all columns of ``docs``; blank texts all stay."""
    rows = _resolve(docs, key, text, size, percent)
    rows = stored(rows, "resolved")
    key_, hash_ = "__key", "__hash"
    gone = rows.where(~F.col("stays")).select(
        F.col("key").alias(key_), F.col("text_hash").alias(hash_)
    )
    same = F.col(key).eqNullSafe(F.col(key_)) & F.xxhash64(
        F.col(text).cast("string")
    ).eqNullSafe(F.col(hash_))
    left = docs.join(gone.distinct(), same, "left_anti")
    again = rows.where("stays AND n > 0").groupBy("key", "text_hash").count().where("count > 1")
    return left if again.isEmpty() else left.dropDuplicates([key, text])
