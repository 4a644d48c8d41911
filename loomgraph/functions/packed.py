"""Edges packed once into the cells of a grid, for work that goes over them several times.

A pass over plain edges shuffles pairs of ids anew and, behind a gather, sums of nearly as many rows.  Here ends are dealt into blocks by hash and a
cell's edges lie in rows of some thousands, sorted and written as differences, three bytes or so an edge.  A pass shuffles these rows and, for
each cell, one copy of the nodes of its two blocks; it hands over one row for each node of a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import vectors as V
from .grid import Cell, added
from .scratch import written

#: Edges of a cell (they pass by, so this bounds a task's input) and bytes of the node rows that it holds, both by the mean.
CELL_EDGES, CELL_BYTES = 1 << 26, 192 << 20
#: Edges, or node rows, that are packed at once, and edges that a step sees at once.
PACK, STEP = 1 << 20, 1 << 17
#: Blocks of each side that edges are packed by, at least; a pass takes some of these together.
FINE = 12

PACKED = "cell int, n int, a binary, b binary"


@dataclass
class Packed:
    """Rows (cell, n, a, b) with the ends of n edges of a cell of ``fine`` x ``fine`` blocks, and how many edges there are in all; b is null for edges
    without a destination, which count in their source's degree."""

    rows: DataFrame
    fine: int
    edges: int

    def blocks(self, nodes: int, width: int) -> int:
        """Blocks of each side for a pass: as few as edges and node rows of a cell allow, as long as all cores get a cell of some size."""
        cores = self.rows.sparkSession.sparkContext.defaultParallelism
        busy = min(math.sqrt(1.3 * cores), math.sqrt(self.edges / (STEP * 2)))
        least = max(1.0, busy, math.sqrt(self.edges / CELL_EDGES), nodes * width * 8 / CELL_BYTES)
        return next((p for p in range(1, self.fine) if self.fine % p == 0 and p >= least), self.fine)


def squeezed(words: np.ndarray) -> bytes:
    """Eight-byte words as planes of bytes, compressed."""
    return pa.compress(pa.py_buffer(np.ascontiguousarray(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8).T)), codec="zstd", asbytes=True)


def restored(data: bytes, n: int) -> np.ndarray:
    """The n words of squeezed(), as whole numbers."""
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T).ravel().view(np.int64)


def packed_ids(ids: np.ndarray) -> bytes:
    d = np.diff(ids, prepend=np.int64(0))
    return squeezed((d << 1) ^ (d >> 63))


def unpacked_ids(data: bytes, n: int) -> np.ndarray:
    z = restored(data, n)
    return np.cumsum(((z >> 1) & np.int64((1 << 63) - 1)) ^ -(z & 1))


def blocks_of(ids: np.ndarray, salt: int, fine: int) -> np.ndarray:
    """The block of each id, by a hash of 64 bits."""
    z = np.ascontiguousarray(ids).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(fine)).astype(np.int64)


def _in_packs(batches: Iterator[pa.RecordBatch], pack: Callable[..., pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pack`` of the columns of some batches at a time, PACK rows or so."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield pack(*pa.Table.from_batches(held).columns)
            held, n = [], 0
    if n:
        yield pack(*pa.Table.from_batches(held).columns)


def _cut(key: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal sorted keys begins and ends."""
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _row_batch(cells: list[int], ns: list[int], a: list[bytes], b: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(ns, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["cell", "n", "a", "b"])


def packed(edges: DataFrame, nodes: int, width: int) -> Packed:
    """``edges`` packed and written, for passes with rows of so many ``nodes`` and ``width`` numbers on each side; edges without a source drop out."""
    ship_package(edges.sparkSession)
    fine = FINE
    while fine < nodes * (width + 2) * 8 / CELL_BYTES:  # two for the ids, as in on_cells
        fine *= 2

    def pack(src: pa.ChunkedArray, dst: pa.ChunkedArray) -> pa.RecordBatch:
        a, b, there = src.to_numpy(), dst.fill_null(0).to_numpy(), dst.is_valid().to_numpy()
        cell = blocks_of(a, 0, fine) * fine + np.where(there, blocks_of(b, 1, fine), 0)
        order = np.lexsort((a, b, there, cell))
        a, b, there, cell = a[order], b[order], there[order], cell[order]
        runs = _cut(cell * 2 + there)
        return _row_batch([int(cell[i]) for i, _ in runs], [j - i for i, j in runs], [packed_ids(a[i:j]) for i, j in runs], [packed_ids(b[i:j]) if there[i] else None for i, j in runs])

    ends = edges.where("src is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    rows = written(ends.mapInArrow(lambda batches: _in_packs(batches, pack), PACKED))
    return Packed(rows, fine, int(rows.agg(F.sum("n")).first()[0] or 0))


def _side(nodes: DataFrame, kind: int, width: int, fine: int, p: int) -> DataFrame:
    """Rows (cell, kind, n, a, b) with ids and flat ``v`` of the nodes of a block, a copy for each cell of a grid of p x p; ids only where width is 0."""

    def pack(ids: pa.ChunkedArray, v: pa.ChunkedArray | None = None) -> pa.RecordBatch:
        ids = ids.to_numpy()
        block = blocks_of(ids, kind, fine) // (fine // p)
        order = np.lexsort((ids, block))
        ids, block = ids[order], block[order]
        runs, m = _cut(block), V.matrix_of(v.combine_chunks(), width)[order] if width else None
        return _row_batch([int(block[i]) for i, _ in runs], [j - i for i, j in runs], [packed_ids(ids[i:j]) for i, j in runs], [squeezed(m[i:j]) if width else b"" for i, j in runs])

    rows = nodes.where("id is not null").select(F.col("id").cast("long").alias("id"), *(["v"] if width else []))
    blocks, other = rows.mapInArrow(lambda batches: _in_packs(batches, pack), PACKED), F.explode(F.sequence(F.lit(0), F.lit(p - 1)))
    every = blocks.select(F.col("cell").alias("block"), other.alias("o"), "n", "a", "b")
    cell = F.col("block") * p + F.col("o") if kind == 0 else F.col("o") * p + F.col("block")
    return every.select(cell.cast("int").alias("cell"), F.lit(kind).alias("kind"), "n", "a", "b")


def on_cells(edges: Packed, nodes: int, lefts: tuple[DataFrame, int], rights: tuple[DataFrame, int], begin: Callable, schema: str) -> DataFrame:
    """What all cells hand over, as a table of ``schema``.

    ``lefts``, ``rights``: (id, v) of so many ``nodes`` at sources and destinations, with the width of v; 0 for ids only.  ``begin(left, right)`` gets
    the sides of a cell (grid.Cell) and returns (step, end): ``step(left places, there, right places, there)`` is called for some edges at a
    time, ``end()`` after the last and gives a record batch.
    """
    fine, widths = edges.fine, (lefts[1], rights[1])
    p = edges.blocks(nodes, sum(widths) + 2)  # two for the ids
    wide = fine // p
    cell = (F.floor(F.col("cell") / (fine * wide)) * p + F.floor(F.col("cell") % fine / wide)).cast("int")
    sides = [_side(df, kind, w, fine, p) for kind, (df, w) in enumerate((lefts, rights))]
    dealt = sides[0].unionByName(sides[1]).unionByName(edges.rows.select(cell.alias("cell"), F.lit(2).alias("kind"), "n", "a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, sides, step, end, held = None, None, None, None, None, []

        def flush() -> None:
            if held:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                step(*sides[0].places(a), *sides[1].places(b))

        for batch in batches:
            cells, kinds, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "n"))
            a, b = batch.column("a"), batch.column("b")
            for i in range(batch.num_rows):
                if at != cells[i]:
                    if end is not None:
                        flush()
                        yield end()
                    at, parts, sides, step, end = cells[i], [([], []), ([], [])], None, None, None
                n, kind = int(ns[i]), int(kinds[i])
                if kind < 2:
                    parts[kind][0].append(unpacked_ids(a[i].as_py(), n))
                    parts[kind][1].append(restored(b[i].as_py(), n * widths[kind]).view(float).reshape(n, widths[kind]) if widths[kind] else np.zeros((n, 0)))
                    continue
                if sides is None:
                    sides = [Cell(*x, w) for x, w in zip(parts, widths, strict=True)]
                    parts = None
                    step, end = begin(*sides)
                if (dst := b[i].as_py()) is None:
                    step(*sides[0].places(unpacked_ids(a[i].as_py(), n)), np.zeros(n, np.int64), np.zeros(n, bool))
                    continue
                held.append((unpacked_ids(a[i].as_py(), n), unpacked_ids(dst, n)))
                if sum(len(x) for x, _ in held) >= STEP:
                    flush()
        if end is not None:
            flush()
            yield end()

    return dealt.repartitionById(p * p, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, schema)


def sums(edges: Packed, nodes: int, from_: DataFrame, to: DataFrame, width: int, back: bool = False) -> DataFrame:
    """(id, v): v of ``from_`` (id, v) summed over edges by destination, or with ``back`` v of destinations by source; only ids of ``to``."""

    def begin(left: Cell, right: Cell):
        giver, taker = (right, left) if back else (left, right)
        total, met = np.zeros((len(taker.ids), width)), np.zeros(len(taker.ids), bool)

        def step(l: np.ndarray, here: np.ndarray, r: np.ndarray, there: np.ndarray) -> None:
            ok = here & there
            g, t = (r[ok], l[ok]) if back else (l[ok], r[ok])
            if len(t):
                added(total, t, giver.rows[g])
                met[t] = True

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(taker.ids[met]), V.lists_of(total[met])], names=["id", "v"])

        return step, end

    given, ids = (from_.select("id", "v"), width), (to.select("id"), 0)
    parts = on_cells(edges, nodes, *((ids, given) if back else (given, ids)), begin, "id long, v array<double>")
    return parts.groupBy("id").agg(V.aggregated(F.sum, "v", width).alias("v"))


def degrees(edges: Packed, n: int, nodes: DataFrame) -> DataFrame:
    """(id, outs, ins) of nodes with any: edges that leave a node, wherever to, and edges that come from a node."""

    def begin(left: Cell, right: Cell):
        outs, ins = np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)

        def step(l: np.ndarray, here: np.ndarray, r: np.ndarray, there: np.ndarray) -> None:
            np.add.at(outs, l[here], 1)
            np.add.at(ins, r[here & there], 1)

        def end() -> pa.RecordBatch:
            a, b = outs > 0, ins > 0
            zeros = lambda m: np.zeros(int(m.sum()), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((left.ids[a], right.ids[b]), (outs[a], zeros(b)), (zeros(a), ins[b]))], names=["id", "outs", "ins"])

        return step, end

    ids = (nodes.select("id"), 0)
    return on_cells(edges, n, ids, ids, begin, "id long, outs long, ins long").groupBy("id").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
