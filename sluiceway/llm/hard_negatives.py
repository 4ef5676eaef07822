"""Hard negatives of anchor vectors by a vertical (BOND) scan.

Vectors lie in blocks stored by dimension. An anchor reads the dimensions of a block in
descending order of its own magnitudes; the smallest and largest values of the dimensions
not yet read bound what each candidate can still gain. Candidates that cannot reach the
best found, or that cannot end in a wanted window of scores, leave the bitmap; those that
stay to the end have exact scores. Anchors are a stated query set, read against all blocks
in passes of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import prepare, record
from sluiceway.session import stored

# Vectors of a block, anchors of a chunk.
BLOCK = 4096
CHUNK = 512
# Dimensions read between two looks at the bounds.
STEP = 8
# What one pass broadcasts: packed anchors and the scores of their positives.
PASS_BYTES = 8 << 20
# Best rows a task holds for its anchors before it hands them on.
HELD_ROWS = 400_000
LONG = np.iinfo("int64")

PACKED = record(
    dim=T.IntegerType(), ids=T.BinaryType(), labels=T.BinaryType(), values=T.BinaryType()
)
CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), *PACKED.fields])
BEST = record(uid=T.LongType(), at=T.IntegerType(), score=T.LongType(), id=T.LongType())
IN_WINDOW = T.StructType([*BEST.fields, T.StructField("slot", T.IntegerType())])


def _packed(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple:
    """Vectors by dimension, sorted by label, in the narrowest integers that hold them."""
    order = np.argsort(labels, kind="stable")
    low, high = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    columns = np.ascontiguousarray(vectors[order].T.astype(kind))
    header = kind[1:].encode()
    return (
        vectors.shape[1],
        ids[order].astype("<i8").tobytes(),
        labels[order].astype("<i8").tobytes(),
        header + columns.tobytes(),
    )


@dataclass
class Block:
    """Vectors by dimension: ``values[d]`` holds one component of all of them."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray

    @classmethod
    def read(cls, dim: int, ids: bytes, labels: bytes, values: bytes) -> Block:
        own = np.frombuffer(ids, "<i8")
        kind = "<" + values[:2].decode()
        columns = np.frombuffer(values, kind, offset=2).reshape(dim, len(own))
        return cls(own, np.frombuffer(labels, "<i8"), columns)

    def largest(self) -> int:
        return max(abs(int(self.values.max())), abs(int(self.values.min()))) if self.values.size else 0


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as blocks of vectors of one length."""
    held: dict[int, list[tuple]] = {}
    count = 0

    def block_of(parts: list[tuple]) -> pa.RecordBatch:
        packed = _packed(*(np.concatenate(columns) for columns in zip(*parts, strict=True)))
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(packed, types, strict=True)], PACKED.names
        )

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        vectors = batch.column("vector")
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.asarray(vectors.offsets)[:-1] - vectors.offsets[0].as_py()
        dims = np.diff(np.asarray(vectors.offsets))
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            values = flat[starts[rows][:, None] + np.arange(dim)[None, :]].reshape(len(rows), dim)
            held.setdefault(int(dim), []).append((ids[rows], labels[rows], values))
        count += batch.num_rows
        if count >= BLOCK:
            yield from (block_of(parts) for parts in held.values())
            held, count = {}, 0
    yield from (block_of(parts) for parts in held.values())


def _pack_chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(rows["vector"].tolist(), "int64").reshape(len(rows), key[1])
    packed = _packed(rows["id"].to_numpy(), rows["label"].to_numpy(), vectors)
    return pd.DataFrame([(key[0], *packed)], columns=CHUNKS.names)


class Scan:
    """One anchor's scan of a block, dimension by dimension."""

    def __init__(self, anchor: np.ndarray, block: Block, exact: str, low: np.ndarray, high: np.ndarray):
        self.order = np.argsort(-np.abs(anchor.astype("float64")), kind="stable")
        self.weights = anchor[self.order].astype(exact)
        self.block, self.exact = block, exact
        least, most = low[self.order] * self.weights, high[self.order] * self.weights
        # What the dimensions from a place on can add at least and at most.
        self.rest_low = self._rest(np.minimum(least, most))
        self.rest_high = self._rest(np.maximum(least, most))

    def _rest(self, contributions: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(contributions) + 1, self.exact)
        sums[:-1] = np.cumsum(contributions[::-1])[::-1]
        return sums

    def run(
        self, candidates: np.ndarray, alive: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the candidates that ``alive`` keeps to the end.

        ``alive`` gets the places of the candidates and the bounds of their scores.
        """
        partial = np.zeros(len(candidates), self.exact)
        dims = len(self.order)
        for start in range(0, dims, STEP):
            stop = min(dims, start + STEP)
            read = self.block.values[np.ix_(self.order[start:stop], candidates)].astype(self.exact)
            partial = partial + self.weights[start:stop] @ read
            if not len(candidates):
                break
            keep = alive(candidates, partial + self.rest_low[stop], partial + self.rest_high[stop])
            if not keep.all():
                candidates, partial = candidates[keep], partial[keep]
        return candidates, partial


def _top(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by descending score and ascending id."""
    places = np.arange(len(scores))
    if len(scores) > count:
        least = np.partition(scores, len(scores) - count)[len(scores) - count]
        places = places[scores >= least]
    return places[np.lexsort((ids[places], -scores[places]))][:count]


def _kth(values: np.ndarray, count: int):
    """The ``count``-th largest value, or None if there are fewer."""
    if len(values) < count:
        return None
    return np.partition(values, len(values) - count)[len(values) - count]


def _longs(scores: np.ndarray) -> list[int]:
    return [min(max(int(s), LONG.min), LONG.max) for s in scores]


class _Best:
    """The best rows that a task has found for each anchor, handed on when they are many."""

    def __init__(self, count: int, schema: T.StructType):
        self.count, self.names = count, schema.names
        self.rows: dict[tuple, tuple[list[int], list[int]]] = {}
        self.size = 0

    def least(self, key: tuple) -> int | None:
        """The score that a further row must reach."""
        found = self.rows.get(key)
        return found[0][-1] if found and len(found[0]) == self.count else None

    def add(self, key: tuple, scores: list[int], ids: list[int]) -> None:
        old = self.rows.get(key, ([], []))
        merged = sorted(zip([-s for s in old[0] + scores], old[1] + ids, strict=True))[: self.count]
        self.rows[key] = ([-s for s, _ in merged], [i for _, i in merged])
        self.size += len(merged) - len(old[0])

    def batch(self) -> pa.RecordBatch:
        rows = [
            (key[0], key[1], score, own, *key[2:])
            for key, found in self.rows.items()
            for score, own in zip(*found, strict=True)
        ]
        self.rows, self.size = {}, 0
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()][: len(self.names)]
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], self.names
        )


def _exact_kind(dim: int, block: Block, anchors: Block):
    """Doubles if they hold every sum of the products exactly, else Python integers."""
    bound = max(1, dim) * block.largest() * anchors.largest()
    return "float64" if bound < 1 << 52 else "object"


def _scanning(best: _Best, scan_anchor) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row["dim"], row["ids"], row["labels"], row["values"])
                anchors = Block.read(row["dim"], row["a_ids"], row["a_labels"], row["a_values"])
                kind = _exact_kind(row["dim"], block, anchors)
                if kind == "object":
                    block = Block(block.ids, block.labels, block.values.astype("object"))
                    anchors = Block(anchors.ids, anchors.labels, anchors.values.astype("object"))
                else:
                    # One conversion for all anchors of the chunk.
                    block = Block(block.ids, block.labels, block.values.astype("float64"))
                low, high = block.values.min(axis=1), block.values.max(axis=1)
                row["positives"] = dict(row.get("positives") or ())
                for at in range(len(anchors.ids)):
                    scan = Scan(anchors.values[:, at], block, kind, low, high)
                    scan_anchor(best, scan, row, at, int(anchors.ids[at]), int(anchors.labels[at]))
                if best.size >= HELD_ROWS:
                    yield best.batch()
        yield best.batch()

    return run


def _find_positives(count: int):
    def scan_anchor(best: _Best, scan: Scan, row: dict, at: int, own: int, label: int) -> None:
        block = scan.block
        start, stop = np.searchsorted(block.labels, [label, label + 1])
        same = np.arange(start, stop)
        same = same[block.ids[same] != own]
        key = (row["uid"], at)
        reach = best.least(key)

        def alive(_, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            needed = [t for t in (reach, _kth(low, count)) if t is not None]
            return high >= max(needed) if needed else np.ones(len(high), "bool")

        places, scores = scan.run(same, alive)
        if len(places):
            top = _top(scores, block.ids[places], count)
            best.add(key, _longs(scores[top]), block.ids[places[top]].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scanning(_Best(count, BEST), scan_anchor)(batches)

    return run


def _find_negatives(count: int, low_percent: int, high_percent: int):
    def scan_anchor(best: _Best, scan: Scan, row: dict, at: int, own: int, label: int) -> None:
        block = scan.block
        windows = []
        for slot, score in enumerate(row["positives"].get(at, ())):
            # 100 * negative between both percentages of the positive, in whole numbers.
            low, high = -(-low_percent * score // 100), high_percent * score // 100
            if low <= high:
                key = (row["uid"], at, slot)
                windows.append((key, low, high, best.least(key)))
        if not windows:
            return
        other = np.flatnonzero(block.labels != label)

        def alive(places: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(places), "bool")
            for _, low, high, reach in windows:
                needed = [t for t in (low, reach) if t is not None]
                inside = _kth(least[(least >= low) & (most <= high)], count)
                if inside is not None:
                    needed.append(inside)
                keep |= ((most >= max(needed)) & (least <= high)).astype("bool")
            return keep

        places, scores = scan.run(other, alive)
        for key, low, high, _ in windows:
            hit = np.flatnonzero(((scores >= low) & (scores <= high)).astype("bool"))
            if len(hit):
                ids = block.ids[places[hit]]
                top = _top(scores[hit], ids, count)
                best.add(key, _longs(scores[hit][top]), ids[top].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scanning(_Best(count, IN_WINDOW), scan_anchor)(batches)

    return run


def usable_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``label`` and whole-number ``vector`` of the rows that take part."""
    bad = F.exists(
        "vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    )
    read = rows.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    usable = read.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(~bad)
    return usable.select("id", "label", F.transform("vector", lambda x: F.floor(x * 256)).alias("vector"))


def _passes(chunks: DataFrame, size: int) -> list[DataFrame]:
    """The chunks in parts of at most PASS_BYTES, one chunk at least."""
    at_once = max(1, PASS_BYTES // max(1, size))
    last = chunks.agg(F.max("chunk")).first()[0]
    if last is None:
        return [chunks]
    return [
        chunks.where((F.col("chunk") >= start) & (F.col("chunk") < start + at_once))
        for start in range(0, last + 1, at_once)
    ]


def _against(blocks: DataFrame, chunks: DataFrame, size: int, find, schema: T.StructType) -> DataFrame:
    """Every block beside every chunk of anchors of its length, pass by pass, scanned."""
    scanned = []
    for part in _passes(chunks, size):
        anchors = part.select(
            "uid",
            F.col("dim").alias("a_dim"),
            *(F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "values")),
            *(c for c in ("positives",) if c in part.columns),
        )
        pairs = blocks.join(F.broadcast(anchors), F.col("dim") == F.col("a_dim"))
        scanned.append(pairs.mapInArrow(find, schema))
    return reduce(DataFrame.unionAll, scanned)


def _first(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first rows of each group, with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """Hard negatives for anchors, both as ``id``, ``label`` and whole-number ``vector``.

    Scores are inner products. An anchor's positives are its first rows of the same label
    and another id, by descending score and ascending id; for each of them the negatives
    are the first rows of other labels whose score lies between both percentages of its
    score. Equal anchors count once, equal rows as often as they occur. Only vectors of
    equal length meet. A score beyond 64 bits is compared and returned as the nearest one.
    """
    prepare(rows.sparkSession)
    blocks = stored(rows.mapInArrow(_pack, PACKED), "blocks")
    distinct = stored(anchors.distinct(), "anchors")
    total = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    parts = -(-total["n"] // CHUNK) or 1
    chunk = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(parts))
    chunks = stored(
        distinct.withColumn("chunk", chunk)
        .withColumn("dim", F.size("vector"))
        .groupBy("chunk", "dim")
        .applyInPandas(_pack_chunk, CHUNKS)
        # Vectors of one length make up a packed row of their own.
        .withColumn("uid", F.shiftleft(F.col("dim").cast("long"), 32) + F.col("chunk")),
        "chunks",
    )
    # A hashed chunk holds about CHUNK anchors; twice as many are beyond any chance.
    size = 2 * CHUNK * ((total["dim"] or 0) * 8 + 16 + positives * 24)
    found = _against(blocks, chunks, size, _find_positives(positives), BEST)
    chosen = stored(_first(found, ["uid", "at"], positives), "positives")
    scores = chosen.groupBy("uid", "at").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda e: e["score"]).alias("scores")
    )
    of_chunk = scores.groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "scores"))).alias("positives")
    )
    windows = stored(chunks.join(of_chunk, "uid"), "windows")
    found = _against(blocks, windows, size, _find_negatives(negatives, low_percent, high_percent), IN_WINDOW)
    best = _first(found, ["uid", "at", "slot"], negatives)
    named = _anchor_ids(chunks)
    pairs = chosen.select(
        "uid",
        "at",
        (F.col("rank") - 1).alias("slot"),
        F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    return (
        best.join(pairs, ["uid", "at", "slot"])
        .join(named, ["uid", "at"])
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def _anchor_ids(chunks: DataFrame) -> DataFrame:
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, ids in zip(batch["uid"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                own = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), uid), pa.int64()),
                        pa.array(np.arange(len(own)), pa.int32()),
                        pa.array(own, pa.int64()),
                    ],
                    ["uid", "at", "anchor_id"],
                )

    schema = record(uid=T.LongType(), at=T.IntegerType(), anchor_id=T.LongType())
    return chunks.select("uid", "ids").mapInArrow(names, schema)


def hard_negatives(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = 100,
    moved: int = 7,
    labels: int = 10,
) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``: see :func:`mine`.

    Rows without id, label or vector, and those with a null or non-finite component, take
    no part. Where the id is divisible by ``moved`` the label first becomes the next of
    ``labels``. A component x becomes floor(256 * x), at the ends of 64 bits if beyond. An
    empty vector scores 0 with other empty ones. No other column is read, and an empty
    table has no rows.
    """
    usable = usable_vectors(rows, key, vector, label)
    turned = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    ready = usable.withColumn("label", turned)
    return mine(ready, ready.where(F.col("id") % every == 0))
