"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap.  The chunks are pre-tokenised
in parallel, each from its own first character.  Pre-tokens depend only on what follows their start, so
as soon as two neighbours share a boundary they agree from there on: the first shared boundary
in the overlap is where one chunk hands over to the next.  Each chunk then encodes the pieces that are
its own, and the ids of a text are put together in chunk order.  Where neighbours never meet in an overlap
(a run without boundaries), the left one is read on through the right one, from its last boundary, until it
meets the chunk after that; the other chunks of the text stay as they are.  Shorter texts are single chunks.

Decoding looks up the bytes of each id and concatenates them.

Workers read a batch in slices of half a MB and remember at most ``REMEMBERED`` bytes of pieces and ids.

Defined results: a null text is empty and has no ids; repeated rows are encoded alike, rows of equal
id too; strings of special tokens are ordinary text; the kept columns may have any name; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, handing_back, text_slices

#: Bytes that a worker spends on each of two generations of remembered pieces.
REMEMBERED = 24 << 20
CHUNK, OVERLAP = 32_768, 512
#: Characters before the end of a chunk in which a boundary may still move: more than any pre-token pattern looks ahead.
MARGIN = 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def bytes_by_id(path: str) -> pa.Array:
    """The bytes of each id, null for numbers that are none."""
    found = {v: k for k, v in load_ranks(path).items()}
    return pa.array([found.get(i) for i in range(max(found, default=-1) + 1)], pa.large_binary())


def joined_bytes(table: pa.Array, rows: pa.Array) -> pa.Array:
    """What the ids of each row (4 bytes each) stand for, looked up for all rows at once."""
    rows = rows.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    raw = rows.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view("<u4") if raw is not None and at[-1] > at[0] else np.zeros(0, "<u4")
    found = table.take(pa.array(ids))
    if found.null_count:
        raise KeyError("ids that the rank file doesn't have")
    ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(ends[(at - at[0]) // 4])), found.buffers()[2]])


class Codec:
    """Merges for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.packed = {r: r.to_bytes(4, "little") for r in self.ranks.values()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0

    def merge(self, piece: bytes) -> list[int]:
        """Always join the neighbours whose union has the lowest rank, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n <= 64:  # the usual case: scanning a short list beats a queue
            get, parts, none = ranks.get, [piece[i : i + 1] for i in range(n)], 1 << 62
            pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
            while pairs and (least := min(pairs)) < none:
                i = pairs.index(least)
                joined = parts[i] = parts[i] + parts[i + 1]
                del parts[i + 1], pairs[i]
                if i < len(pairs):
                    pairs[i] = get(joined + parts[i + 1], none)
                if i:
                    pairs[i - 1] = get(parts[i - 1] + joined, none)
            return [ranks[x] for x in parts]
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged into its left neighbour
        back = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has changed since
            end[i], end[middle] = stop, 0
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (left := back[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(queue, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Make all these pieces known; when the memory is full, only pieces of the last generation are taken over."""
        if self.size > REMEMBERED:
            self.before, self.known, self.size = self.known, {}, 0
        known, before = self.known, self.before
        for p in {p for p in pieces if p not in known}:
            known[p] = ids = before.get(p) or b"".join(map(self.packed.__getitem__, self.merge(p.encode("utf-8", "replace"))))
            self.size += 200 + 2 * len(p) + len(ids)

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            self.learn(pieces)
            return b"".join([self.known[p] for p in pieces])

    def forget(self) -> None:
        """Drop the remembered pieces: what is left is the rank table."""
        self.known, self.before, self.size = {}, {}, 0

    def encode(self, text: str) -> bytes:
        return self.encode_pieces(self.pattern.findall(text))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def boundaries(found: regex.Pattern, text: str, last: bool) -> list[int]:
    """Starts of pre-tokens, and the text's end if it is the last chunk.

    Before the last chunk a start near the end doesn't count: more text could have changed it.
    """
    starts = [m.start() for m in found.finditer(text)]
    return [*starts, len(text)] if last else [s for s in starts[:-1] if s < len(text) - MARGIN]


def pieces_of(found: regex.Pattern, parts: list[str], at: list[list[int]], step: int, overlap: int) -> list[tuple[int, str, list[int]]]:
    """(number, text, cuts): what lies between the cuts of all texts, in order, are the pre-tokens of the chunked text.

    A chunk is handed over at the first boundary that it shares with the next one; without such a boundary it is
    read on from its last boundary through the next chunk (and twice as many each time that gives no boundary).
    """
    out, last = [], len(parts) - 1
    k = 0  # the chunk that the text reaches to
    text, cuts, origin, take = parts[0], at[0], 0, 1  # origin: where the text begins, counted from the start of all
    while k < last:
        begin = (k + 1) * step - origin  # of the next chunk
        theirs = {p for p in at[k + 1] if p < overlap}
        seam = next((p for p in cuts if p >= begin and p - begin in theirs), None)
        if seam is not None:
            out.append((len(out), text, [p for p in cuts if p <= seam]))
            k, start, origin, take = k + 1, seam - begin, (k + 1) * step, 1
            text, cuts = parts[k], [p for p in at[k] if p >= start]
            continue
        back = cuts[-1] if cuts else 0
        if len(cuts) > 1:
            out.append((len(out), text, cuts))
            take = 1
        text, origin = text[back:], origin + back
        for _ in range(min(take, last - k)):
            k += 1
            text += parts[k][origin + len(text) - k * step :]
        take *= 2
        cuts = boundaries(found, text, k == last)
    return [*out, (len(out), text, cuts)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str | Column] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The ``keep`` columns of every row with ``ids`` (binary, 4 bytes an id, little-endian)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept"), whole.alias("text"))

    @handing_back
    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            first = 0
            for texts in text_slices(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["kept"].slice(first, len(texts)), pa.array([own.encode(t) for t in texts], pa.binary())], ["kept", "ids"])
                first += len(texts)
        own.forget()

    @F.arrow_udf("array<int>")
    def cut(texts: pa.Array, last: pa.Array) -> pa.Array:
        found, ends = codec(path, pattern).pattern, iter(last.to_pylist())
        return pa.array([boundaries(found, t, next(ends)) for part in text_slices(texts) for t in part], pa.list_(pa.int32()))

    @F.arrow_udf("array<struct<i: int, part: string, cuts: array<int>>>")
    def read_on(chunks: pa.Array) -> pa.Array:
        found, rows = codec(path, pattern).pattern, []
        for i in range(len(chunks)):
            if (c := chunks[i].as_py()) is None:
                rows.append(None)
                continue
            rows.append([{"i": k, "part": t, "cuts": p} for k, t, p in pieces_of(found, [x["part"] for x in c], [x["at"] for x in c], step, overlap)])
        return pa.array(rows, pa.list_(pa.struct([("i", pa.int32()), ("part", pa.string()), ("cuts", pa.list_(pa.int32()))])))

    @F.arrow_udf("binary")
    def encode_pieces(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        own, out = codec(path, pattern), []
        for i in range(len(texts)):
            t, c = texts[i].as_py(), cuts[i].as_py()
            out.append(own.encode_pieces([t[a:b] for a, b in zip(c, c[1:])]))
        return pa.array(out, pa.binary())

    short = rows.where(F.length("text") <= chunk).mapInArrow(encode_whole, T.StructType([rows.schema["kept"], T.StructField("ids", T.BinaryType())]))
    # long texts get a number each, so that neither null nor repeated ids meet; written, so that a lost task finds the same numbers again
    long = Scratch(docs.sparkSession).write(rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id()))
    step = chunk - overlap
    number = F.ceil((F.length("text") - overlap) / step).cast("int")
    parts = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(i.alias("i"), (i == number - 1).alias("last"), F.substring(F.col("text"), i * step + 1, F.lit(chunk)).alias("part")))
    chunks = long.select("row", F.inline(parts)).repartition("row", "i").withColumn("at", cut("part", "last"))
    # one row a text again: no more than the text and its boundaries
    texts = chunks.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "part", "at"))).alias("c"))
    # the first boundary that neighbours share, counted from the start of the right one
    seam = F.expr(f"transform(sequence(0, size(c) - 2), i -> array_min(array_intersect(transform(filter(c[i].at, p -> p >= {step}), p -> p - {step}), filter(c[i + 1].at, p -> p < {overlap}))))")
    texts = texts.withColumn("seam", seam)
    own = F.expr(f"transform(c, (x, k) -> struct(x.i as i, x.part as part, filter(x.at, p -> (k = 0 or p >= get(seam, k - 1)) and (k = size(c) - 1 or p <= {step} + get(seam, k))) as cuts))")
    unmet = F.exists("seam", F.isnull)
    texts = texts.withColumn("read", read_on(F.when(unmet, F.col("c"))))
    pieces = texts.select("row", F.inline(F.coalesce("read", own))).repartition("row", "i").withColumn("ids", encode_pieces("part", "cuts"))
    stitched = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("all"))
    stitched = stitched.select("row", F.expr("aggregate(all, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    stitched = long.select("row", "kept").join(stitched, "row").select("kept", "ids")
    return short.unionByName(stitched).select("kept.*", "ids")


def decode(coded: DataFrame, path: str, ids: str = "ids", out: str = "decoded", text: bool = False) -> DataFrame:
    """``coded`` with the bytes of its ids, or with those bytes as text."""

    @handing_back
    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bytes_by_id(path)
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.slice(first, 64)
                rows = joined_bytes(table, pc.struct_field(part["coded"], ids))
                rows = pa.array([x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.string()) if text else rows.cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part["coded"], rows], ["coded", "decoded"])

    rows = coded.select(F.struct(*coded.columns).alias("coded"))
    kind = T.StringType() if text else T.BinaryType()
    return rows.mapInArrow(bytes_of, T.StructType([rows.schema["coded"], T.StructField("decoded", kind)])).select("coded.*", F.col("decoded").alias(out))


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: number of ids and the SHA-256 of the ids and of the decoded bytes."""
    coded = decode(encode(docs, path, pattern, text, [key]), path)
    return coded.select(key, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
