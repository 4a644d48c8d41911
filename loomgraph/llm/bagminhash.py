"""Near-duplicate classes by BagMinHash.

A text is a multiset of shingles of five words (all its words if it has fewer).  For every shingle a
Poisson process over (weight, time) is explored hierarchically: the weight axis is cut at 0, 1, 2, 4, 8, ...;
blocks below the shingle's count are used as a whole, the block that the count cuts is halved until
each half lies on one side, and halves above the count are dropped.  Each point picks a signature component and lowers it
to its time.  Shingles of equal count meet the same points in every text, so two signatures
agree in a component with exactly the probability of the weighted Jaccard similarity.  Time is
explored only up to a horizon in which each component has almost surely been hit; texts
for which that fails are explored further, which gives the same signature as an endless process.

``bands`` bands of ``rows`` components put texts into buckets.  In a bucket one text, the pivot, is verified against
the others by exact multiset overlap; it is the one that meets most texts in all its buckets.  Texts of a small bucket that the
pivot didn't join to its class are tried against further pivots, each other in the end.  Large buckets that the pivot didn't make
one class (texts around one boilerplate, say) are split by prefix filtering: texts of similarity t share one of the
n - ceil(t n) + 1 rarest of their n shingles, so only texts that share a rare shingle meet again, as buckets of their own, pivot by
pivot, and are verified if the place of that shingle and the parities of their shingle counts leave the similarity possible.  So a group of copies costs one comparison for each copy and
not one for each pair, and no link found by the bands is lost.  With 28 bands of 5 a pair at similarity 0.8 is missed
with probability 1.5e-5, one at 0.85 with 2e-7.

Defined results: texts with equal word sequences (ASCII case folded) are copies of each other; texts
without a word, null ones included, are in no class but their own; rows of equal id are one document (their
texts' classes are joined); each row of a null id is a class of its own, with a null ``class_id``; ids are integers, other
types raise TypeError; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, handing_back, small_or_shuffled, utf8_batches

SHINGLE = 5
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_code = np.arange(256)
LOWER = np.where((_code >= 0x41) & (_code <= 0x5A), _code + 32, _code).astype(np.uint8)
IS_WORD = ((_code >= 0x30) & (_code <= 0x39)) | ((_code >= 0x41) & (_code <= 0x5A)) | ((_code >= 0x61) & (_code <= 0x7A)) | (_code >= 0x80)
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """base ** i and its inverse modulo 2 ** 64, for as many i as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 1 << 21:  # a very long text: not kept
            return tuple(self.made(b, n) for b in (BASE, BASE_INVERSE))
        if len(self.up) < n:
            size = max(n, 1 << 19)
            self.up, self.down = (self.made(b, size) for b in (BASE, BASE_INVERSE))
        return self.up, self.down

    @staticmethod
    def made(b: int, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))


POWERS = Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where each text's words begin (with the end of the last)."""
    n = len(data)
    word = IS_WORD[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # words end with their text
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last[:-1] &= ~word[1:] | begins[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = POWERS.get(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[LOWER[data]] * up[:n], dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles: (text number, hash, count), sorted by text and hash."""
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    end = at[1:][text] if len(text) else np.zeros(0, np.int64)
    place = np.arange(len(words))
    starts = np.flatnonzero((place + SHINGLE <= end) | ((place == at[:-1][text]) & (counts[text] < SHINGLE)) if len(text) else np.zeros(0, bool))
    h = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        there = starts + k < end[starts]
        h = h * U(0x9E3779B97F4A7C15) + np.where(there, words[np.minimum(starts + k, max(0, len(words) - 1))], U(k + 1))
    h = mixed(h)
    text = text[starts]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h)))


def uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((state >> U(11)).astype(np.float64) + 1) * 2.0**-53


def points(seed: np.ndarray, count: np.ndarray, text: np.ndarray, horizon: np.ndarray, m: int, signature: np.ndarray) -> None:
    """Lower ``signature[text, component]`` to the times of all relevant points up to each text's horizon."""
    # one root for each block of weight that the count reaches: [0, 1), [1, 2), [2, 4), [4, 8), ...
    state, low, size, owner, weight = [], [], [], [], []
    for b in range(int(count.max()).bit_length() + 1 if len(count) else 0):
        floor = 0 if b == 0 else 1 << (b - 1)
        some = np.flatnonzero(count > floor)
        state.append(mixed(seed[some] + U((b + 1) * 0xD1B54A32D192ED03 % (1 << 64))))
        low.append(np.full(len(some), floor, np.int64))
        size.append(np.full(len(some), max(1, floor), np.int64))
        weight.append(count[some])
        owner.append(text[some])
    if not state:
        return
    state, low, size, weight, owner = map(np.concatenate, (state, low, size, weight, owner))
    time, flat = np.zeros(len(state)), signature.reshape(-1)
    while len(state):
        # the first point of each process
        state = state + U(0x9E3779B97F4A7C15)
        time = time - np.log(uniform(mixed(state))) / (m * size)
        live = np.flatnonzero(time <= horizon[owner])
        state, low, size, weight, owner, time = (x[live] for x in (state, low, size, weight, owner, time))
        spin = mixed(state ^ U(0xA0761D6478BD642F))
        place = low + ((spin & U(0xFFFFFFFF)) * size.astype(np.uint64) >> U(32)).astype(np.int64)
        hit = np.flatnonzero(place < weight)
        component = ((spin[hit] >> U(32)) * U(m) >> U(32)).astype(np.int64)
        np.minimum.at(flat, owner[hit] * m + component, time[hit])
        # what follows a process's first point: two independent processes on its halves; unit steps of weight go on alone
        wide = np.flatnonzero(size > 1)
        if len(wide):
            unit, half = np.flatnonzero(size == 1), size[wide] // 2
            parts = [tuple(x[unit] for x in (state, low, size, weight, owner, time))]
            for k in (0, 1):
                begin = low[wide] + k * half
                keep = begin < weight[wide]
                own = mixed(state[wide] + U((k + 1) * 0xE7037ED1A0B428DB % (1 << 64)))
                parts.append(tuple(x[keep] for x in (own, begin, half, weight[wide], owner[wide], time[wide])))
            state, low, size, weight, owner, time = map(np.concatenate, zip(*parts, strict=True))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """BagMinHash signatures of ``texts`` texts: times, infinite for a text without shingles."""
    total = np.bincount(text, count, texts)
    out = np.full((texts, m), np.inf)
    with np.errstate(divide="ignore"):
        horizon = (np.log(m) + 3) / total  # component times are exponential with rate `total`
    todo = total > 0
    while todo.any():
        some = todo[text]
        number = np.cumsum(todo) - 1
        part = np.full((int(todo.sum()), m), np.inf)
        points(shingle[some], count[some], number[text[some]], horizon[todo], m, part)
        out[todo] = part
        todo = todo & np.isinf(out).any(1)
        horizon = horizon * 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for k in range(rows):
        key = mixed(key * U(0x9E3779B97F4A7C15) + bits[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """Per row: id, number of shingles, two hashes of the word sequence, band keys (none for a text without a word)."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in utf8_batches(batch["text"]):
                words, at = word_hashes(data, offsets)
                n = np.diff(at)
                place = np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words + (place + U(1)) * U(c)), dtype=np.uint64)]) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
                one, two = (mixed((s[at[1:]] - s[at[:-1]]) + n.astype(np.uint64)).view(np.int64) for s in sums)
                which, shingle, count = shingles(words, at)
                keys = band_keys(signatures(which, shingle, count, end - first, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()), pa.array(keys[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(first, end - first), pa.array(np.bincount(which, count, end - first).astype(np.int64)), pa.array(one), pa.array(two), lists], ["id", "n", "h1", "h2", "bands"])

    return docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("id is not null").mapInArrow(run, "id long, n long, h1 long, h2 long, bands array<long>")


def overlaps(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle multisets of a whole column."""
    parts, base = [], 0
    for first, end, raw, offsets in utf8_batches(data):
        which, shingle, count = shingles(*word_hashes(raw, offsets))
        parts.append((which + first, shingle, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Exact multiset Jaccard similarity of each pair of texts."""
    (ta, ha, ca), (tb, hb, cb) = overlaps(left), overlaps(right)
    n = len(left)
    text, h, c = np.concatenate([ta, tb]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
    order = np.lexsort((h, text))
    text, h, c = text[order], h[order], c[order]
    same = np.flatnonzero((text[1:] == text[:-1]) & (h[1:] == h[:-1]))
    common = np.bincount(text[same], np.minimum(c[same], c[same + 1]), n)
    union = np.bincount(text, c, n) - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose texts reach the threshold."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                keep = pa.array(similarities(part["x"], part["y"]) >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part["a"].filter(keep), part["b"].filter(keep)], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Buckets up to this size are compared pivot by pivot; in larger ones the texts that the first pivot left are joined on their rare shingles.
SMALL = 64


def occurrences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of every shingle occurrence: the k-th one of a shingle is a token of its own, so that multisets become sets."""
    which, h, c = shingles(*word_hashes(raw, offsets))
    k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    return np.repeat(which, c), mixed(np.repeat(h, c) + k.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


#: Tokens that are ordered by their counts, at most; tokens that a task counts at once; bits of a text's parities (whole words of 64).
FREQUENT, COUNTED, PARITIES = 1 << 18, 1 << 20, 1024


def frequent_tokens(scratch: Scratch, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of most texts, sorted, and in how many texts each was counted: all with more than F, the least F that leaves FREQUENT at most.

    Tokens that a task meets once are not counted there (lossy counting): the order needs no exact counts.
    """

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[n > 1]), pa.array(n[n > 1])], ["token", "n"])

        for batch in batches:
            for _, _, data, offsets in utf8_batches(batch["text"]):
                kept.append(occurrences(data, offsets)[1])
                if (size := size + len(kept[-1])) >= COUNTED:
                    yield counted()
                    kept, size = [], 0
        if kept:
            yield counted()

    counts = scratch.write(texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("f")))
    least, behind = 1, 0
    for r in counts.groupBy(F.floor(F.log2("f")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect():  # 64 rows at most
        if (behind := behind + r["count"]) > FREQUENT:
            least = (1 << (r["e"] + 1)) - 1
            break
    found = counts.where(F.col("f") > least).toPandas().sort_values("token")
    return found["token"].to_numpy(np.int64), found["f"].to_numpy(np.int64)


#: Tokens of a part, by the mean: parts are read one by one.  Tokens are counted as one for each 30 bytes of text: a fifth of the shingles.
PART_TOKENS, TOKEN_BYTES = 1 << 18, 30
#: A token in a text's prefix: the token, the text's number and the token's place.
PLACED = np.dtype([("token", "<i8"), ("row", "<i8"), ("place", "<i4")])


def rare_buckets(scratch: Scratch, members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(key, id, n, place, parities) buckets of texts that share one of their rarest shingles.

    Two texts of similarity t or more share one of the n - ceil(t n) + 1 rarest tokens of either, whatever the order of equally
    rare ones.  Any order of all tokens will do, so the few frequent ones have their counts and all others, whose buckets are small, count as
    rarer.  ``place`` is the token's in its text, from 0; bit b of ``parities`` is the parity of the tokens that b stands for.

    Most of the rarest tokens are a single text's: tokens are dealt by hash in packed blocks, and only those that a part has twice become rows.
    """
    ids = scratch.write(members.select("id").distinct())
    mine = scratch.write(texts.join(small_or_shuffled(ids, ids.count()), "id").select("id", "text", F.monotonically_increasing_id().alias("row")))
    parts = max(1, -(-(mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (PART_TOKENS * TOKEN_BYTES)))
    known = texts.sparkSession.sparkContext.broadcast(frequent_tokens(scratch, mine))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, f = known.value
        names = ["row", "id", "n", "parities", "part", "block"]
        kept, size = [], 0

        def let_go() -> pa.RecordBatch:
            placed = np.concatenate(kept)
            part = (mixed(placed["token"].view(np.uint64)) % U(parts)).astype(np.int32)
            placed, part = placed[order := np.argsort(part, kind="stable")], part[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            blocks = pa.array([placed[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True)], pa.binary())
            nulls = [pa.nulls(len(cuts), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*nulls, pa.array(part[cuts]), blocks], names)

        for batch in batches:
            for first, end, data, offsets in utf8_batches(batch["text"]):
                text, token = occurrences(data, offsets)
                count = np.zeros(len(token), np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)
                    count = np.where(frequent[at] == token, f[at], 0)
                order = np.lexsort((token, count, text))
                n = np.bincount(text, minlength=end - first)
                text, token = text[order], token[order]
                place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
                bits = np.bincount(text * PARITIES + (token.view(np.uint64) >> U(17)).astype(np.int64) % PARITIES, minlength=(end - first) * PARITIES) & 1
                parities = np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(-1, PARITIES // 64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - first + 1) * parities.shape[1], pa.int32()), pa.array(parities.ravel()))
                rows = batch["row"].slice(first, end - first)
                yield pa.RecordBatch.from_arrays([rows, batch["id"].slice(first, end - first), pa.array(n), lists, pa.nulls(end - first, pa.int32()), pa.nulls(end - first, pa.binary())], names)
                some = place < (n - np.ceil(n * threshold - 1e-9) + 1)[text]
                placed = np.empty(int(some.sum()), PLACED)
                placed["token"], placed["row"], placed["place"] = token[some], rows.to_numpy()[text[some]], place[some]
                kept.append(placed)
                if (size := size + len(placed)) >= COUNTED:
                    yield let_go()
                    kept, size = [], 0
        if size:
            yield let_go()

    @handing_back
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []

        def met() -> pa.RecordBatch:
            placed = np.concatenate(kept)
            placed = placed[np.argsort(placed["token"], kind="stable")]
            token = placed["token"]
            same = token[1:] == token[:-1]
            placed = placed[np.r_[False, same] | np.r_[same, False]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(placed[c])) for c in PLACED.names], ["key", "row", "place"])

        for batch in batches:
            for part, block in zip(batch["part"].to_pylist(), batch["block"], strict=True):
                if at != part:
                    if kept:
                        yield met()
                    at, kept = part, []
                kept.append(np.frombuffer(block.as_buffer(), PLACED))
        if kept:
            yield met()

    made = scratch.write(mine.mapInArrow(run, "row long, id long, n long, parities array<long>, part int, block binary"))
    blocks = made.where("part is not null").select("part", "block").repartition(parts, "part").sortWithinPartitions("part")
    found = scratch.write(blocks.mapInArrow(shared, "key long, row long, place int"))
    sketched = made.where("part is null").select("row", "id", "n", "parities")
    return found.join(sketched, "row").select("key", "id", "n", "place", "parities")


def may_reach(threshold: float) -> Column:
    """Whether texts that meet at a token in rare_buckets, one of them a pivot with columns named with an a, may reach the threshold.

    True for each pair that does at the first token they share: behind it they have no more tokens in common than either has left, and
    parities differ in as many bits as there are tokens that one has alone, at most.
    """
    both = F.col("n") + F.col("na")
    left = F.least(F.col("n") - F.col("place"), F.col("na") - F.col("placea"))
    apart = sum((F.bit_count(F.col("parities")[i].bitwiseXOR(F.col("paritiesa")[i])) for i in range(PARITIES // 64)), F.lit(0))
    return F.when(left < both * (threshold / (1 + threshold)) - 1e-6, False).otherwise(apart <= both * ((1 - threshold) / (1 + threshold)) + 1e-6)


def star_step(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (v, u), u < v: every neighbourhood is hung on its smallest id.

    The minima are written and counted first, so that a hub's edges need not meet in one task.
    """
    both = pairs.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(pairs.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = scratch.write(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    large = scratch.write(both.join(small_or_shuffled(least, least.count()), "x").where("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct())
    low = scratch.write(large.groupBy("v").agg(F.min("u").alias("m")))
    small = large.join(small_or_shuffled(low, low.count()), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
    return small.unionByName(low.select("v", F.col("m").alias("u"))).distinct()


def ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge but the smallest of each component: the component's smallest id.

    Star steps, each a few grouped minima and joins, until nothing moves.
    """
    now, before = scratch.write(ordered(edges)), None
    while True:
        after = scratch.write(star_step(scratch, now))
        state = after.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(v, u))").alias("h")).first()
        scratch.drop(now)
        now = after
        if before == state:
            return now.select(F.col("v").alias("id"), F.col("u").alias("comp"))
        before = state


class Links:
    """Candidate pairs compared so far, the links among them, and labels: texts of one label are known to be in one class."""

    def __init__(self, scratch: Scratch, texts: DataFrame, threshold: float):
        self.scratch, self.texts, self.threshold = scratch, texts, threshold
        self.tried = self.found = self.labels = None

    def labelled(self, members: DataFrame) -> DataFrame:
        """``members`` with their labels."""
        if self.labels is None:
            return members.withColumn("label", F.col("id"))
        return members.join(small_or_shuffled(self.labels, self.labels.count()), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def mixed(self, members: DataFrame) -> DataFrame:
        """Labelled members of the buckets in which different labels meet."""
        here = self.scratch.write(self.labelled(members))
        keys = self.scratch.write(here.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key"))
        return here.join(small_or_shuffled(keys, keys.count()), "key", "left_semi")

    def compare(self, members: DataFrame, pivots: DataFrame, condition: Column | None = None) -> None:
        """Verify each pivot (key, a, na, la, ...) against the texts of its bucket with other labels."""
        pivots = self.scratch.write(pivots)
        # sizes further apart than the threshold can't reach it
        near = F.least("n", "na") >= self.threshold * F.greatest("n", "na") - 1e-9
        pairs = members.join(small_or_shuffled(pivots, pivots.count()), "key").where(near).where("label <> la")
        pairs = pairs if condition is None else pairs.where(condition)
        pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.scratch.write(pairs)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        found = self.scratch.write(verified(pairs, self.texts, self.threshold).distinct())
        # labels need not be final: equal ones only spare comparisons
        hung = ordered(found)
        if self.labels is not None:
            hung = hung.unionByName(self.labels.select(F.col("id").alias("v"), F.col("label").alias("u")))
        self.found = found if self.found is None else self.found.unionByName(found)
        self.labels = self.scratch.write(star_step(self.scratch, hung).groupBy(F.col("v").alias("id")).agg(F.min("u").alias("label")))

    def by_first_pivots(self, members: DataFrame) -> None:
        """A text that meets most others in all its buckets is likely to be what they were copied from: the best pivot."""
        met = self.scratch.write(members.groupBy("id").agg(F.sum("size").alias("met")))
        here = self.scratch.write(self.labelled(members.join(small_or_shuffled(met, met.count()), "id")))
        best = here.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("back"), "n", "label")).alias("p"))
        self.compare(here, best.select("key", (-F.col("p.back")).alias("a"), F.col("p.n").alias("na"), F.col("p.label").alias("la")))

    def by_all_pivots(self, members: DataFrame, first: int, more: int = 8, condition: Column | None = None, of_pivot: tuple[str, ...] = ()) -> None:
        """Every text of a bucket is a pivot for those behind it, while labels differ; ``first`` pivots in the first round, then ``more`` times as many each.

        ``condition``: what every pair that reaches the threshold has in one of its buckets; columns ``of_pivot`` of the pivot are named with an a.
        """
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "id"))
        left, low, high = self.scratch.write(self.mixed(members).withColumn("rank", rank)), 1, first
        here = left.drop("label")
        while True:
            last = left.agg(F.max("rank")).first()[0]
            if last is None or last <= low:
                return
            pivots = left.where(F.col("rank").between(low, high)).select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"), F.col("rank").alias("r"), *[F.col(c).alias(c + "a") for c in of_pivot])
            self.compare(left, pivots, F.col("rank") > F.col("r") if condition is None else (F.col("rank") > F.col("r")) & condition)
            low, high = high + 1, high * more + 1
            if low >= last:  # all pairs of the largest bucket are done
                return
            left = self.scratch.write(self.mixed(here))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, bands: int = 28, rows: int = 5) -> DataFrame:
    """One row per document: its id under the name ``key``, ``class_id`` (the smallest id of its class), ``representative``."""
    if not isinstance(docs.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} must be an integer column")
    scratch = Scratch(docs.sparkSession)
    sketch = scratch.write(sketches(docs, key, text, bands, rows))
    # equal word sequences have equal band keys: only the smallest id of each sequence goes on
    worded = sketch.where("n > 0")
    reps = scratch.write(worded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    membership = worded.select("id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("id", "rep")
    copies = scratch.write(membership.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    banded = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "n")
    buckets = scratch.write(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    members = scratch.write(banded.join(small_or_shuffled(buckets, buckets.count()), "key"))
    wanted = scratch.write(members.select("id").distinct())
    whole = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = scratch.write(whole.join(small_or_shuffled(wanted, wanted.count()), "id", "left_semi").dropDuplicates(["id", "text"]))
    links = Links(scratch, texts, threshold)
    links.by_first_pivots(members)
    links.by_all_pivots(members.where(F.col("size") <= SMALL), 8)
    large = scratch.write(links.mixed(members.where(F.col("size") > SMALL)).select("key", "id", "n", "size"))
    if large.limit(1).count():
        rare = scratch.write(rare_buckets(scratch, large, texts, threshold))
        links.by_all_pivots(rare, 1, 64, may_reach(threshold), ("place", "parities"))
    final = components(scratch, copies.unionByName(links.found))
    every = sketch.select("id").distinct().join(final, "id", "left").select("id", F.coalesce("comp", "id").alias("class_id"))
    every = every.unionByName(docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id")))
    return every.select(F.col("id").alias(key), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("representative"))
