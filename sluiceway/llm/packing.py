"""Best-fit packing of tokenized documents with certified sequence counts.

Documents become pieces of at most ``capacity`` tokens. The pieces are dealt into parts of
bounded size; best-fit decreasing packs each part, and dual-feasible functions give a lower
bound of the sequences that the part needs. A part that meets its bound is certified and
hands on only its emptiest sequence; a part with a gap hands on all its loosely filled
ones. What is handed on is exchanged between parts and packed again, until one part held
it all or a round saves nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import Remembered, forgotten, prepare, record
from sluiceway.session import stored

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k.json"
# A part is packed in one task's memory, so its size is bounded.
PART_PIECES = 10_000
# A sequence is loosely filled if more than this share of it is free.
LOOSE = 1 / 16
# What a Python worker keeps of encoded words.
KEPT_BYTES = 128 << 20
DIVISORS = 24

CUT = record(
    starts=T.ArrayType(T.LongType()),
    lengths=T.ArrayType(T.LongType()),
    crcs=T.ArrayType(T.LongType()),
)


def tokenizer_path(name: str) -> str:
    """Where this machine has a public vocabulary file; a path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    No token reaches across the place between a character that is no white space and a
    single space followed by another such character. Texts are cut there, and each
    distinct part is encoded once and kept. The two libraries give the same ids; the faster
    one encodes parts of plain Latin letters, on whose classes no two Unicode versions
    differ.
    """

    _between = re.compile(r"(?<=\S)(?= \S)")
    _latin = re.compile(r"[\x00-\u024F]*").fullmatch

    def __init__(self, name: str, kept: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content for token in added]
        self.fast = _ranked(path)
        self.first = Remembered(self._word, kept // 8)
        self.later = Remembered(lambda word: self._word(word, " "), kept)

    def _ids(self, text: str) -> bytes:
        if self.fast and self._latin(text):
            ids = self.fast(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _word(self, word: str, before: str = "") -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _SpacesTouch
        return self._ids(before + word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        words = text.split(" ")
        try:
            return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))
        except _SpacesTouch:
            return b"".join(map(self._ids, self._between.split(text)))


class _SpacesTouch(Exception):
    """A space is beside other white space or at an end: the plain split does not hold."""


def _ranked(path: str) -> Callable[[str], list[int]] | None:
    """The same vocabulary in its ranked form, if that lies beside it."""
    ranked = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranked):
        return None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranked, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


@cache
def encoder(name: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(name)


def cut(ids: bytes, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and checksums of a document's pieces; only the first may be short."""
    count = len(ids) // 4
    head = count % capacity or min(count, capacity)
    starts = [0, *range(head, count, capacity)]
    ends = [*starts[1:], count]
    view = memoryview(ids)
    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
    return starts, [b - a for a, b in zip(starts, ends, strict=True)], crcs


def _cutter(tokenizer: str, capacity: int, end: int) -> Callable:
    last = np.array([end], "<u4").tobytes()

    @F.pandas_udf(CUT)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        with forgotten(own.first, own.later):
            for texts in batches:
                rows = [cut(own.encode(text) + last, capacity) for text in texts]
                yield pd.DataFrame(rows, columns=["starts", "lengths", "crcs"])

    return pieces


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing; equal lengths in given order."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit f is set if a bin with f free places exists
    bins = np.empty(len(lengths), "int64")
    offsets = np.empty(len(lengths), "int64")
    count = 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fits = has >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            here = by_free[free].pop()
            if not by_free[free]:
                has &= ~(1 << free)
        else:
            free, here = capacity, count
            count += 1
        bins[at], offsets[at] = here, capacity - free
        if free - size:
            by_free[free - size].append(here)
            has |= 1 << (free - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, divisors: int = DIVISORS) -> int:
    """Bins that pieces of these lengths need at least, by dual-feasible functions.

    Two families: one counts a piece above ``capacity - e`` as a whole bin and drops those
    below ``e``; the other rounds ``(k + 1) * length / capacity`` down to a multiple of 1/k.
    """
    sizes, counts = np.unique(np.asarray(lengths, "int64"), return_counts=True)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    wide = sizes * counts
    for least in sizes[2 * sizes <= capacity].tolist():
        whole = sizes > capacity - least
        middle = ~whole & (sizes >= least)
        mass = capacity * int(counts[whole].sum()) + int(wide[middle].sum())
        best = max(best, -(-mass // capacity))
    for k in range(1, divisors + 1):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, capacity * (scaled // capacity))
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


PLACED = record(
    doc_id=T.LongType(),
    piece=T.IntegerType(),
    start=T.LongType(),
    length=T.LongType(),
    ids_crc32=T.LongType(),
    uid=T.LongType(),
    part=T.LongType(),
    bin=T.LongType(),
    offset=T.LongType(),
    bins=T.LongType(),
    bound=T.LongType(),
    exchanged=T.BooleanType(),
)


def _packer(capacity: int, doc_type: T.DataType):
    loose = int(capacity * LOOSE)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        lengths = rows["length"].to_numpy("int64")
        bins, offsets = best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype("int64")
        bound = lower_bound(lengths, capacity)
        emptiest = used.argmin()
        back = capacity - used > loose if len(used) > bound else np.zeros(len(used), bool)
        back[emptiest] |= used[emptiest] < capacity
        rows["bin"], rows["offset"] = bins, offsets
        rows["bins"], rows["bound"] = len(used), bound
        rows["exchanged"] = back[bins]
        return rows[[field.name for field in PLACED]]

    schema = T.StructType([T.StructField("doc_id", doc_type), *PLACED.fields[1:]])
    return pack, schema


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end: int = END,
) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end token alone.
    """
    prepare(docs.sparkSession)
    cut_up = _cutter(tokenizer, capacity, end)(F.col(text).cast("string"))
    cuts = docs.select(F.col(key).alias("doc_id"), cut_up.alias("cut")).select(
        "doc_id", F.explode(F.arrays_zip("cut.starts", "cut.lengths", "cut.crcs")).alias("p"), "cut"
    )
    piece = F.array_position("cut.starts", F.col("p.starts")) - 1
    return cuts.select(
        "doc_id",
        piece.cast("int").alias("piece"),
        F.col("p.starts").alias("start"),
        F.col("p.lengths").alias("length"),
        F.col("p.crcs").alias("ids_crc32"),
    )


def pack_pieces(
    cuts: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES
) -> tuple[DataFrame, DataFrame]:
    """Places of all pieces, and the certificates: round, part, pieces, bins, bound."""
    left = stored(cuts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    pack, schema = _packer(capacity, cuts.schema["doc_id"].dataType)
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
    closed, notes = [], []
    waiting, number, before = left.count(), 0, None
    while True:
        parts = -(-waiting // part_pieces) or 1
        dealt = left.select(*own, F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(parts)).alias("part"))
        placed = stored(dealt.groupBy("part").applyInPandas(pack, schema), f"packed-{number}")
        place = (F.lit(number << 56) + F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id")
        placed_at = placed.select(*own[:-1], place, "offset", "exchanged", "uid")
        by_part = placed.groupBy("part").agg(
            F.count("*").alias("pieces"),
            F.first("bins").alias("bins"),
            F.first("bound").alias("bound"),
            F.count_if(F.col("exchanged")).alias("exchanged"),
        )
        notes.append(by_part.select(F.lit(number).alias("round"), "*"))
        total = by_part.agg(F.sum("exchanged"), F.sum("bins")).first()
        waiting, bins = total[0] or 0, total[1] or 0
        # The bins handed on in the round before were ``before``; fewer are progress.
        if parts == 1 or not waiting or (before is not None and bins >= before):
            closed.append(placed_at)
            break
        closed.append(placed_at.where("NOT exchanged"))
        left = placed.where("exchanged")
        before = left.select("part", "bin").distinct().count()
        number += 1
    return reduce(DataFrame.unionAll, closed).drop("exchanged", "uid"), reduce(
        DataFrame.unionAll, notes
    )


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    end: int = END,
) -> DataFrame:
    """Where each piece of each document goes.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is one piece that holds the end token alone; repeated documents are packed
    each; null ids are carried; other columns are not read; no documents give no rows.
    """
    return pack_pieces(pieces(docs, key, text, capacity, tokenizer, end), capacity)[0]
