"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks. Two vectors within
a squared distance are, in at least one block, within the block's proportional share of it.
So each block is range-joined by itself, over a grid of its first two coordinates, and the
pairs found are confirmed by their cosine in double precision. Equal vectors are one class.
A pair counts in the first block that finds it; what leaves a task is one sum and at most
one link for each vector in it, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluiceway.llm.common import prepare, record
from sluiceway.llm.components import components
from sluiceway.session import stored

LEAST_COSINE = 0.95
BLOCKS = 8
# Vectors on either side of a task: a task's memory is bounded whatever the cells hold.
TILE = 8192
ROWS_AT_ONCE = 512
SLACK = 1e-6

CELLS = T.ArrayType(
    record(block=T.IntegerType(), x=T.IntegerType(), y=T.IntegerType())
)
FOUND = record(node=T.LongType(), links=T.LongType(), other=T.LongType())


@cache
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


@cache
def shares(dim: int, budget: float) -> list[tuple[slice, float]]:
    """Blocks of coordinates, each with its proportional share of the squared distance."""
    count = max(1, min(BLOCKS, dim // 2))
    edges = [dim * k // count for k in range(count + 1)]
    return [(slice(a, b), budget * (b - a) / dim) for a, b in zip(edges, edges[1:], strict=False)]


def _units(raw: list[bytes]) -> np.ndarray:
    vectors = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1).astype("float64")
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _celled(budget: float):
    """The cell of each block, on a grid as wide as the block's range."""

    @F.pandas_udf(CELLS)
    def cells(raws: pd.Series) -> pd.Series:
        out = []
        for raw in raws:
            turned = _units([raw])[0] @ rotation(len(raw) // 4)
            row = []
            for block, (at, share) in enumerate(shares(len(raw) // 4, budget)):
                place = np.floor(turned[at][:2] / (np.sqrt(share) * (1 + SLACK) + SLACK)).astype(int)
                row.append((block, int(place[0]), int(place[1]) if len(place) > 1 else 0))
            out.append(row)
        return pd.Series(out)

    return cells


def _near(home: np.ndarray, guest: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose squared distance is at most the share, a little more by rounding."""
    a = np.hstack([home, (home**2).sum(1)[:, None], np.ones((len(home), 1))]).astype("float32")
    b = np.hstack([-2 * guest, np.ones((len(guest), 1)), (guest**2).sum(1)[:, None]]).astype("float32").T
    for at in range(0, len(a), ROWS_AT_ONCE):
        near = a[at : at + ROWS_AT_ONCE] @ b <= share + 1e-5
        rows, columns = np.nonzero(near)
        yield rows + at, columns


class _Forest:
    """Components of the pairs a task sees, without keeping the pairs."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def merge(self, p: np.ndarray, q: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[p], root[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root[:] = above


def _joiner(least: float, budget: float):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        home, guest = rows[rows["home"]], rows[~rows["home"]]
        if not len(home) or not len(guest):
            return pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        dim, block = len(home["raw"].iloc[0]) // 4, int(rows["block"].iloc[0])
        a, b = _units(home["raw"].tolist()), _units(guest["raw"].tolist())
        turned_a, turned_b = a @ rotation(dim), b @ rotation(dim)
        nodes, index = np.unique(
            np.concatenate([home["node"].to_numpy(), guest["node"].to_numpy()]), return_inverse=True
        )
        index_a, index_b = index[: len(a)], index[len(a) :]
        copies_a, copies_b = home["copies"].to_numpy(), guest["copies"].to_numpy()
        same_cell = guest["own"].to_numpy()
        parts = shares(dim, budget)
        at, share = parts[block]
        links, forest = np.zeros(len(nodes), "int64"), _Forest(len(nodes))
        for i, j in _near(turned_a[:, at], turned_b[:, at], share):
            # Within one cell each vector is on both sides; the smaller one leads.
            lead = ~same_cell[j] | (index_a[i] < index_b[j])
            i, j = i[lead], j[lead]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                alike = np.einsum("ij,ij->i", a[p], b[q]) >= least
                p, q = p[alike], q[alike]
                gaps = (turned_a[p] - turned_b[q]) ** 2
                first = gaps[:, at].sum(1) <= share + SLACK
                for earlier, part in parts[:block]:
                    first &= gaps[:, earlier].sum(1) > part + SLACK
                p, q = p[first], q[first]
                np.add.at(links, index_a[p], copies_b[q])
                np.add.at(links, index_b[q], copies_a[p])
                forest.merge(index_a[p], index_b[q])
        has = links > 0
        return pd.DataFrame({"node": nodes[has], "links": links[has], "other": nodes[forest.root[has]]})

    return join


def _tiled(points: DataFrame) -> DataFrame:
    """The vectors of every task: its tile of a cell, and its tile of the cell's guests.

    The guests of a cell are its own vectors and those of the four neighbours that come
    after it, so that each pair of neighbouring cells meets once.
    """
    cell = ["dim", "block", "x", "y"]
    counts = points.groupBy(*cell).agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in _FORWARD])
    around = counts.select("*", F.explode(steps).alias("s"))
    # What a cell gives as guest: its count goes to the cells that it comes after.
    given = around.select(
        "dim", "block", (F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), "n"
    )
    guests = given.groupBy(*cell).agg(F.sum("n").alias("m"))
    tiles = stored(
        counts.join(guests, cell).select(
            *cell, F.ceil(F.col("n") / TILE).alias("homes"), F.ceil(F.col("m") / TILE).alias("sides")
        ),
        "tiles",
    )
    hashed = F.xxhash64("node")
    task = [*cell, "i", "j"]
    row = ["node", "copies", "raw"]
    at_home = points.join(tiles, cell).select(
        *cell,
        F.pmod(hashed, "homes").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sides") - 1)).alias("j"),
        *row,
        F.lit(True).alias("home"),
        F.lit(False).alias("own"),
    )
    moved = points.select("dim", "block", F.explode(steps).alias("s"), "x", "y", *row).select(
        "dim",
        "block",
        (F.col("x") - F.col("s.dx")).alias("x"),
        (F.col("y") - F.col("s.dy")).alias("y"),
        *row,
        (F.expr("s.dx = 0 AND s.dy = 0")).alias("own"),
    )
    as_guest = moved.join(tiles, cell).select(
        *cell,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("homes") - 1)).alias("i"),
        F.pmod(hashed, "sides").alias("j"),
        *row,
        F.lit(False).alias("home"),
        "own",
    )
    rows = at_home.unionByName(as_guest).select(*task, *row, "home", "own")
    # By all of the task's columns: the joins' partitioning would do for the grouping, and
    # keep all tiles of a crowded cell in one task.
    return rows.repartition(*task)


_FORWARD = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


@F.pandas_udf(T.BinaryType())
def _raw(vectors: pd.Series) -> pd.Series:
    """The components as bytes, or null where a vector can link with nothing."""

    def raw(vector) -> bytes | None:
        if vector is None or not len(vector):
            return None
        values = np.array([np.nan if v is None else v for v in vector], "<f4")
        whole = np.isfinite(values).all() and (values.astype("float64") ** 2).sum() > 0
        # Adding 0 makes -0.0 and 0.0 the same bytes.
        return (values + np.float32(0)).tobytes() if whole else None

    return vectors.map(raw)


def embedding_links(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite,
    link with nothing: their component is themselves. Vectors of different lengths do not
    link. Equal vectors always link. A null id never names a component unless none of its
    vectors has an id. Other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows = stored(
        vectors.select(
            F.col(key).alias("key"), _raw(F.col(embedding).cast("array<float>")).alias("raw")
        ),
        "vectors",
    )
    classes = stored(
        rows.where("raw IS NOT NULL")
        .groupBy("raw")
        .agg(F.count("*").alias("copies"), F.min("key").alias("least"))
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "classes",
    )
    budget = 2 - 2 * least
    points = classes.select(
        (F.octet_length("raw") / 4).cast("int").alias("dim"),
        F.explode(_celled(budget)("raw")).alias("c"),
        "node",
        "copies",
        "raw",
    ).select("dim", "c.*", "node", "copies", "raw")
    tasks = _tiled(stored(points, "points"))
    found = tasks.groupBy("dim", "block", "x", "y", "i", "j").applyInPandas(
        _joiner(least, budget), FOUND
    )
    found = stored(found, "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    within = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = (
        classes.join(links, "node", "left")
        .join(within, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least_id = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = labelled.join(least_id, "component").select(
        "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return rows.join(of_class, "raw", "left").select(
        F.col("key").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("raw").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("raw").isNull(), F.lit(True))
        .otherwise(F.col("key").eqNullSafe(F.col("component_id")))
        .alias("kept"),
    )
