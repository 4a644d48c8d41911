"""Spelling variants: words one edit apart, found by a frontier that walks a trie held as a table.

Words are put into two tries, one of the words and one of the words reversed, each as a table of nodes
(node, depth, children); a branch with one word left is a leaf that holds the word's tail, so the tables
have a row for each place where words part and no more.  An edit lies in a word's second or in its first half; the first kind is looked for
from the node of the first half on, the second kind likewise in the trie of reversed words, so no search begins at the crowded root.

The frontier has states (word, position, node, edits).  Level by level the states of one depth are joined with the nodes of that
depth: a state without an edit is on its own word's path and tries, for every child, a replacement and a deletion; a state with one
edit follows the one child that its next letter names.  A child is entered only if one of its own children goes on; at a leaf the
tails decide.  Each pair is found once: replacements from the word with the smaller letter, insertions as deletions of the longer
word, at the last letter of a run of equal ones.

Node tables of a level are broadcast after counting, else shuffled; children are at most one for each letter.
Words over ``LONGEST`` code points are compared by hashes of what is left after each deletion (``long_pairs``), which is linear in their length, so
the number of levels is bounded and no pair is lost.

Defined results: null texts have no words, a null id counts as an empty one; every row counts, repeated ones too; without words the
result is empty; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, END = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "$"
LONGEST = 48
#: Modulus (a Mersenne prime) and base of the hash of long words.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the runs of letters of all texts, one code point deleted in one of ``every`` by a hash of document and run."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(f"({RUN}{{{least_length},}}+)"))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def parted(sorted_words: DataFrame, start: int) -> DataFrame:
    """Sorted (back, w, n) with first and last: the depths at which the word adds an edge to its trie; the last one is its leaf.

    Edges that the word before has already are left to it.  At the ends of a partition the neighbour is unknown: such a word adds its whole path, its
    leaf is the end sign, and edges that a word of another partition adds as well are the same rows.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = held = None  # the row before and the one that waits for its next
        out: list[tuple] = []

        def let_go(following: tuple | None) -> None:
            back, w, n = held
            a = shared(before[1], w) if before is not None and before[0] == back else 0 if before is not None else None
            b = shared(w, following[1]) if following is not None and following[0] == back else 0 if following is not None else None
            whole = a is None or b is None
            out.append((back, w, n, max(start, a or 0), len(w) - 1 if whole else max(a, b)))

        for f in frames:
            for row in zip(f["back"], f["w"], f["n"], strict=True):
                if held is not None:
                    let_go(row)
                before, held = held, row
            if out:
                yield pd.DataFrame(out, columns=["back", "w", "n", "first", "last"])
                out.clear()
        if held is not None:
            let_go(None)
            yield pd.DataFrame(out, columns=["back", "w", "n", "first", "last"])

    return sorted_words.mapInPandas(step, "back boolean, w string, n long, first int, last int")


def trie(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(node, depth, children array of (ch, after, tail, n)) of words (back, w, n, first, last): after are the letters that go on below a
    child, tail is what is left at a leaf (the other is null).  A node is its path behind the sign of its trie."""
    at = words.where("first <= last").select("w", "n", "last", F.when(F.col("back"), "<").otherwise(">").alias("side"), F.explode(F.sequence("first", "last")).alias("depth"))
    leaf = F.col("depth") == F.col("last")
    edges = at.select(F.concat("side", F.expr("substring(w, 1, depth)")).alias("node"), "depth", F.expr("substring(w, depth + 1, 1)").alias("ch"), F.when(leaf, F.expr("substring(w, depth + 2)")).alias("tail"), F.when(leaf, F.col("n")).alias("n"))
    edges = scratch.write(edges)
    letters = edges.groupBy("node").agg(F.array_join(F.collect_set("ch"), "").alias("after"))
    inner = edges.where("tail is null").select("node", "depth", "ch").distinct().withColumn("child", F.concat("node", "ch"))
    inner = inner.join(letters.withColumnRenamed("node", "child"), "child").select("node", "depth", "ch", "after", F.lit(None).cast("string").alias("tail"), F.lit(None).cast("long").alias("n"))
    leaves = edges.where("tail is not null").select("node", "depth", "ch", F.lit(None).cast("string").alias("after"), "tail", "n")
    nodes = inner.unionByName(leaves).groupBy("node", "depth").agg(F.collect_set(F.struct("ch", "after", "tail", "n")).alias("children"))
    return scratch.write(nodes.select("node", "children", "depth"), by=["depth"])


#: Children that a state enters, each with the position behind it.
MOVES = """filter(
  if(edits = 1,
    transform(filter(children, c -> c.ch = here), c -> struct(at + 1 as j, c as c)),
    concat(
      transform(filter(children, c -> here <> '$' and c.ch <> '$' and c.ch > here), c -> struct(at + 1 as j, c as c)),
      transform(filter(children, c -> may_delete and c.ch = following), c -> struct(at + 2 as j, c as c)))),
  m -> if(m.c.tail is not null, m.c.tail = substring(w, m.j + 1), locate(substring(w, m.j + 1, 1), m.c.after) > 0))"""


def advance(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States (back, w, n, at, node, edits) one level on: (back, w, n, at, node, tail, near_n), tail null where the walk goes on.

    An edit in the reversed word deletes the last of a run in reading order, which is the first that the walk meets."""
    met = states.join(nodes.select("node", "children"), "node")
    met = met.withColumns({"here": F.expr("substring(w, at + 1, 1)"), "following": F.expr("substring(w, at + 2, 1)")})
    met = met.withColumn("may_delete", F.expr("here <> '$' and here <> if(back, substring(w, at, 1), following)"))
    moved = met.select("back", "w", "n", "node", F.explode(F.expr(MOVES)).alias("m"))
    return moved.select("back", "w", "n", F.col("m.j").alias("at"), F.concat("node", "m.c.ch").alias("node"), "m.c.tail", F.col("m.c.n").alias("near_n"))


def walked(scratch: Scratch, words: DataFrame, start: int) -> list[DataFrame]:
    """Tables (word, n, near, near_n), one for each level that found pairs; each pair in one direction."""
    both = words.select(F.lit(False).alias("back"), F.concat("word", F.lit(END)).alias("w"), "n").unionByName(words.select(F.lit(True).alias("back"), F.concat(F.reverse("word"), F.lit(END)).alias("w"), "n"))
    ranked = scratch.write(parted(both.repartitionByRange("back", "w").sortWithinPartitions("back", "w"), start))
    nodes = trie(scratch, ranked)
    length = F.length("w") - 1
    own = scratch.write(ranked.withColumn("half", F.when(F.col("back"), length - F.floor(length / 2)).otherwise(F.floor(length / 2)).cast("int")).where("half <= last").select("back", "w", "n", "half", "last"))
    sizes = {r["depth"]: r["count"] for r in nodes.groupBy("depth").count().collect()}  # a row for each depth
    found, carried = [], None
    for depth in range(start, max(sizes, default=start - 1) + 1):
        states = own.where((F.col("half") <= depth) & (F.col("last") >= depth)).select("back", "w", "n", F.lit(depth).alias("at"), F.concat(F.when(F.col("back"), "<").otherwise(">"), F.substring("w", 1, depth)).alias("node"), F.lit(0).alias("edits"))
        if carried is not None:
            states = states.unionByName(carried)
        level = nodes.where(F.col("depth") == depth)
        moved = scratch.write(advance(states, small_or_shuffled(level, sizes.get(depth, 0))))
        carried = moved.where("tail is null").select("back", "w", "n", "at", "node", F.lit(1).alias("edits"))
        near = F.concat(F.expr("substring(node, 2)"), "tail")
        bare = lambda c: F.expr(f"if(back, reverse(substring({c}, 1, length({c}) - 1)), substring({c}, 1, length({c}) - 1))")
        found.append(moved.where("tail is not null").withColumn("other", near).select(bare("w").alias("word"), "n", bare("other").alias("near"), "near_n"))
    return found


def deletions(word: str) -> list[int]:
    """Hashes of what is left without each code point, and of the whole word at the end."""
    head, tail, power = [0], 0, 1
    for c in word:
        head.append((head[-1] * BASE + ord(c)) % PRIME)
    out = []
    for i in range(len(word) - 1, -1, -1):
        out.append((head[i] * power + tail) % PRIME)
        tail, power = (ord(word[i]) * power + tail) % PRIME, power * BASE % PRIME
    return [*out[::-1], head[-1]]


def long_pairs(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of pairs with a word over LONGEST, each in one direction: what is left without one code point is
    compared with the same place of words of equal length, or with whole words one shorter; equal hashes are verified."""

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, w in zip(f["id"], f["word"], strict=True):
                hashes = deletions(w)
                last = [k + 1 == len(w) or w[k] != w[k + 1] for k in range(len(w))]
                yield pd.DataFrame({"id": i, "length": len(w), "place": range(len(w) + 1), "hash": hashes, "last": [*last, False]})

    long = scratch.write(words.where(F.length("word") >= LONGEST).withColumn("id", F.monotonically_increasing_id()))
    left = scratch.write(long.select("id", "word").mapInPandas(step, "id long, length int, place int, hash long, last boolean"))
    whole, cut = left.where("place = length"), left.where("place < length")
    a, b = cut.select("hash", "length", "place", F.col("id").alias("a")), cut.select("hash", "length", "place", F.col("id").alias("b"))
    replaced = a.join(b, ["hash", "length", "place"]).where("a < b").where(F.col("length") > LONGEST).select("a", "b", "place", F.lit(2).alias("skip"))
    shorter = whole.select("hash", (F.col("length") + 1).alias("length"), F.col("id").alias("b"))
    deleted = cut.where("last").select("hash", "length", "place", F.col("id").alias("a")).join(shorter, ["hash", "length"]).select("a", "b", "place", F.lit(1).alias("skip"))
    pairs = replaced.unionByName(deleted)
    pairs = pairs.join(long.select(F.col("id").alias("a"), "word", "n"), "a").join(long.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    return pairs.where("substring(word, 1, place) = substring(near, 1, place) and substring(word, place + 2) = substring(near, place + skip)").select("word", "n", "near", "near_n")


def near_words(scratch: Scratch, words: DataFrame, least_length: int = 7) -> DataFrame:
    """(word, near, near_n): all pairs of the words (word, n) that differ by one edit, in both directions."""
    pairs = long_pairs(scratch, words)
    for level in walked(scratch, words.where(F.length("word") <= LONGEST), least_length // 2):
        pairs = pairs.unionByName(level)
    return pairs.select(F.inline(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))))


def roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last one, twice as far each round."""
    now = scratch.write(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = scratch.write(now.join(small_or_shuffled(further, now.count()), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        scratch.drop(now)
        now = after.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: form is its most frequent near word if that occurs ``ratio`` times as often."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(vocabulary(docs, key, text, least_length, least_count))
    best = F.min(F.struct((-F.col("near_n")).alias("back"), F.col("near").alias("form")))
    near = near_words(scratch, words, least_length).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = scratch.write(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(-F.col("best.back") >= ratio * F.col("n"), x).alias(name) for x, name in ((F.col("best.form"), "form"), (-F.col("best.back"), "form_n"))]))
    last = roots(scratch, known.where("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
