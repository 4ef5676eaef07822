"""Drop lines that many documents share, found with two Bloom filters.

A first pass hashes the distinct lines of each document into a filter of what was seen once
and one of what was seen twice. Tasks write the bits they set, block by block; blocks are
merged, where a bit set on both sides passes into the second filter, so that a line of two
documents is always in it. A second pass sends only the lines that the second filter
suspects through a shuffle, which counts them exactly. A last pass drops lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import of_text, prepare, record
from sluiceway.session import stored

# Bits of one filter are dealt to so many blocks by their lowest bits.
BLOCK_BITS = 8
BLOCKS = 1 << BLOCK_BITS
BITS_A_LINE = 16
# The filter that travels to the tasks has at most so many bits (64 MB). Beyond some
# 30 million different lines more of them are suspected; the result does not change.
MOST_BITS = 1 << 29
MARKS_AT_ONCE = 1_000_000
# At most so many dropped lines travel to the tasks (16 bytes each); more are joined.
BROADCAST_LINES = 500_000

MARKS = record(block=T.IntegerType(), once=T.BinaryType(), twice=T.BinaryType())


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def _keys(text: bytes, least_chars: int) -> set[bytes]:
    keys = {line_key(line) for line in text.split(b"\n")}
    if least_chars <= 1:
        keys.discard(b"")
        return keys
    return {key for key in keys if len(key.decode("utf-8", "replace")) >= least_chars}


def _by_block(positions: np.ndarray) -> list[bytes]:
    """Sorted offsets inside each block, as bytes."""
    blocks = positions & (BLOCKS - 1)
    ordered = positions[np.argsort(blocks, kind="stable")]
    edges = np.searchsorted(np.sort(blocks), np.arange(BLOCKS + 1))
    offsets = (ordered >> BLOCK_BITS).astype("<u4")
    return [offsets[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]


def _marking(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bits that the lines of a task set: two for each different line of a document."""

    def marks(hashes: list[int]) -> pa.RecordBatch:
        hashed = np.array(hashes, "uint64")
        halves = np.concatenate([hashed & np.uint64(0xFFFFFFFF), hashed >> np.uint64(32)])
        positions, counts = np.unique(halves, return_counts=True)
        positions = positions.astype("int64")
        columns = [list(range(BLOCKS)), _by_block(positions), _by_block(positions[counts > 1])]
        types = [pa.int32(), pa.binary(), pa.binary()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, MARKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[int] = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                hashes.extend(map(xxhash.xxh3_64_intdigest, _keys(text, least_chars)))
                if len(hashes) >= MARKS_AT_ONCE:
                    yield marks(hashes)
                    hashes = []
        if hashes:
            yield marks(hashes)

    return run


def _merging(
    width: int, sparse: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge rows of equal blocks, of ``width`` bits each; the bits of a task stay bounded."""

    def bits(raw: bytes) -> np.ndarray:
        if not sparse:
            return np.frombuffer(raw, "uint8")
        at = np.frombuffer(raw, "<u4") & np.uint32(width - 1)
        dense = np.zeros(width, "bool")
        dense[at] = True
        return np.packbits(dense)

    def folded_twice(raw: bytes) -> np.ndarray:
        """Bits that several offsets share once they are folded to the width."""
        at = np.sort(np.frombuffer(raw, "<u4") & np.uint32(width - 1))
        dense = np.zeros(width, "bool")
        dense[at[1:][at[1:] == at[:-1]]] = True
        return np.packbits(dense)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows = zip(*(batch.column(name).to_pylist() for name in MARKS.names), strict=True)
            for block, raw_once, raw_twice in rows:
                once, twice = bits(raw_once), bits(raw_twice)
                if sparse:
                    twice = twice | folded_twice(raw_once)
                if block in held:
                    seen, again = held[block]
                    once, twice = seen | once, again | twice | (seen & once)
                held[block] = once, twice
        for block, (once, twice) in held.items():
            arrays = [
                pa.array([block], pa.int32()),
                pa.array([once.tobytes()], pa.binary()),
                pa.array([twice.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, MARKS.names)

    return run


def twice_seen(texts: DataFrame, least_chars: int) -> np.ndarray:
    """The second filter as packed bits: every line of two rows has both its bits set."""
    marks = stored(texts.select("text").mapInArrow(_marking(least_chars), MARKS), "marks")
    set_bits = marks.agg(F.sum(F.length("once"))).first()[0] or 0
    lines = set_bits // 8
    bits = min(MOST_BITS, 1 << max(16, (lines * BITS_A_LINE).bit_length()))
    width = bits // BLOCKS
    # First within parts of the rows of a block, then the parts.
    part = F.pmod(F.xxhash64("once"), F.lit(8))
    parts = marks.repartition("block", part).mapInArrow(_merging(width, True), MARKS)
    merged = parts.repartition("block").mapInArrow(_merging(width, False), MARKS)
    seen = np.zeros(bits // 8, "uint8")
    for row in merged.select("block", "twice").toLocalIterator():
        seen[row["block"] * width // 8 : (row["block"] + 1) * width // 8] = np.frombuffer(
            row["twice"], "uint8"
        )
    return seen


def _suspected(key: bytes, seen: np.ndarray, mask: int) -> bool:
    hashed = xxhash.xxh3_64_intdigest(key)
    for position in (hashed & 0xFFFFFFFF, hashed >> 32):
        block, offset = position & (BLOCKS - 1), (position >> BLOCK_BITS) & mask
        at = block * (mask + 1) + offset
        if not seen[at >> 3] & (128 >> (at & 7)):
            return False
    return True


def _suspecting(filter_bits, least_chars: int):
    """The suspected lines of each row: id, text hash and digest of the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(filter_bits.value, "uint8")
        mask = len(seen) * 8 // BLOCKS - 1
        for batch in batches:
            at, lines = [], []
            for number, text in enumerate(batch.column("text").to_pylist()):
                for key in _keys(text, least_chars):
                    if _suspected(key, seen, mask):
                        at.append(number)
                        lines.append(xxhash.xxh3_128_digest(key))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(rows),
                    batch.column("hash").take(rows),
                    pa.array(lines, pa.binary()),
                ],
                ["key", "hash", "line"],
            )

    return run


def _dropping(gone_of: Callable[[pa.RecordBatch], Iterator], key_type: T.DataType):
    """Texts without their dropped lines. ``gone_of`` gives each row what to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped = [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), gone_of(batch), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if gone:
                    kept = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone]
                texts.append(b"\n".join(kept))
                counts.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(texts, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                ["key", "text", "n_lines", "n_dropped"],
            )

    schema = record(
        key=key_type, text=T.BinaryType(), n_lines=T.LongType(), n_dropped=T.LongType()
    )
    return run, schema


class _Except:
    """The dropped lines, without those that this row is the first to have."""

    def __init__(self, first: dict[bytes, tuple], own: tuple):
        self.first, self.own = first, own

    def __contains__(self, line: bytes) -> bool:
        return line in self.first and self.first[line] != self.own


def without_shared_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = 2,
    keep_first: bool = True,
    least_chars: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without dropped lines, n_lines, n_dropped.

    Texts are split at line feeds; a line's key is the line without ASCII white space at
    its ends and with A-Z lower-cased. A key of at least ``least_chars`` code points that
    at least ``min_docs`` rows hold (two or more) loses all its lines in all rows, with
    ``keep_first`` all but those of the row of the least id; rows of that id with another
    text give way to the least text hash, and rows equal in id and text all keep it. A null
    id comes last. Lines of a row that repeat inside it only stay. A null text is empty and
    an empty text is one empty line. Repeated rows count as rows. No other column is read.
    """
    if min_docs < 2:
        raise ValueError("a shared line needs two rows or more")
    spark = docs.sparkSession
    prepare(spark)
    texts = of_text(docs, key, text)
    key_type = texts.schema["key"].dataType
    texts = texts.select(
        "key", F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    filter_bits = spark.sparkContext.broadcast(twice_seen(texts, least_chars).tobytes())
    suspect = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("hash", T.LongType()),
            T.StructField("line", T.BinaryType()),
        ]
    )
    suspects = texts.mapInArrow(_suspecting(filter_bits, least_chars), suspect)
    counted = [F.count("*").alias("n")]
    if keep_first:
        order = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
        counted.append(F.min(order).alias("first"))
    gone = stored(suspects.groupBy("line").agg(*counted).where(F.col("n") >= min_docs), "gone")
    own = ["line", *(["first.key", "first.hash"] if keep_first else [])]
    if gone.count() <= BROADCAST_LINES:
        rows = {row[0]: tuple(row[1:]) for row in gone.select(*own).toLocalIterator()}
        listed = spark.sparkContext.broadcast(rows)

        def gone_of(batch: pa.RecordBatch) -> Iterator:
            if not keep_first:
                return (listed.value for _ in range(batch.num_rows))
            keys = zip(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), strict=True)
            return (_Except(listed.value, row) for row in keys)

        source = texts
    else:
        source = _with_lists(texts, suspects, gone, keep_first)

        def gone_of(batch: pa.RecordBatch) -> Iterator:
            return (set(lines or ()) for lines in batch.column("gone").to_pylist())

    run, schema = _dropping(gone_of, key_type)
    return source.mapInArrow(run, schema).select(
        F.col("key").alias("doc_id"), F.col("text").cast("string").alias("text"), "n_lines", "n_dropped"
    )


def _with_lists(texts: DataFrame, suspects: DataFrame, gone: DataFrame, keep_first: bool) -> DataFrame:
    """The rows with the list of lines to drop, joined: for more lines than tasks can hold."""
    lost: Column = F.lit(True)
    found = suspects.join(gone, "line")
    if keep_first:
        lost = ~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("hash") == F.col("first.hash")))
    lists = found.where(lost).groupBy("key", "hash").agg(F.collect_set("line").alias("gone"))
    lists = lists.select(F.col("key").alias("of_key"), F.col("hash").alias("of_hash"), "gone")
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("hash") == F.col("of_hash"))
    return texts.join(lists, same, "left").select("key", "text", "gone")


def digests(shared: DataFrame) -> DataFrame:
    """The kept texts as digests: doc_id, n_lines, n_dropped, kept_sha256."""
    return shared.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))
