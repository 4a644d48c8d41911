"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Words are maximal runs of characters outside ASCII punctuation, blanks and controls, with A-Z lowered.
A window is 13 consecutive words of a benchmark item, or the whole item if it has fewer.

1. The frequency of every benchmark word in the documents is counted.
2. Each window names its rarest words (two different ones if it has them) as its anchors.
3. The index stores the postings (document, position) of the anchor words.
4. Postings are shifted by the anchor's offset in the item.  The shifted lists of a window's anchors are
   intersected: what remains are diagonals (document, item, shift) on which the whole window may occur.
5. On those diagonals the words of the windows whose anchors met are compared, which gives the exact occurrences.

Defined results: a null or wordless document has no words and no hits; a wordless or null item has no
window; items of equal text each count, repeated rows of one item id are one item with the windows of all its texts; rows of equal id are told apart only if their texts are (they
share their hits otherwise); a null document id is kept; a null item id counts as the text ``null``;
columns beyond id and text are not read; an empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_or_shuffled

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Different rarest words of a window whose postings are intersected.
ANCHORS = 2


def words(text: Column) -> Column:
    """The words of a text, with nothing before the first; a text that ends in separators has '' at the end."""
    body = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "^" + SEPARATORS, "")
    return F.split(F.translate(body, UPPER, UPPER.lower()), SEPARATORS)


def name(*columns: str | Column) -> Column:
    """A name for rows by their values: two hashes, so that different rows won't share one in a table of any size."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def word_count(text: Column) -> Column:
    w = words(text)
    return (F.size(w) - (F.element_at(w, -1) == "").cast("int")).cast("long")


def item_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: w != "")


def postings(docs: DataFrame, terms: DataFrame, n_terms: int, key: str, text: str) -> DataFrame:
    """(key, pos, term) of every occurrence of the terms; positions count from 0."""
    tokens = docs.select(F.col(key), F.posexplode(words(F.col(text))).alias("pos", "term"))
    return tokens.join(small_or_shuffled(terms, n_terms), "term", "left_semi")


def frequencies(docs: DataFrame, terms: DataFrame, n_terms: int, text: str) -> DataFrame:
    """(term, freq) of the terms that occur."""
    tokens = docs.select(F.explode(words(F.col(text))).alias("term"))
    return tokens.join(small_or_shuffled(terms, n_terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))


def phrase_occurrences(scratch: Scratch, docs: DataFrame, items: DataFrame, window: int, key: str = "_doc", text: str = "_text") -> DataFrame:
    """(key, item, start, len): every place where a window of an item begins in a document, counted in words.

    ``docs`` has unique ``key`` values; ``items`` has a unique number ``item`` and its ``words``.
    """
    items = scratch.write(items.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(window))))
    placed = items.select("item", F.posexplode("words").alias("at", "word")).withColumnRenamed("word", "term")
    terms = scratch.write(placed.select("term").distinct())
    freq = scratch.write(frequencies(docs, terms, terms.count(), text))
    # a word that never occurs has frequency 0: its windows cannot occur, which the empty list shows
    ranked = placed.join(freq, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("freq", F.lit(0)).alias("freq")))).alias("w"))
    # each window's anchors: the positions in the item of its rarest different words
    rare = f"""
        transform(sequence(0, size(words) - len), s ->
            transform(slice(aggregate(array_sort(transform(slice(w, s + 1, len), x -> struct(x.freq as freq, x.term as term, x.at as at))),
                cast(array() as array<struct<freq: bigint, term: string, at: int>>),
                (a, x) -> if(size(a) > 0 and a[size(a) - 1].term = x.term, a, concat(a, array(x)))), 1, {ANCHORS}), x -> x.at))
    """
    anchored = scratch.write(items.join(ranked, "item").withColumn("anchors", F.expr(rare)).drop("w"))
    anchor = anchored.select("item", "words", F.explode(F.array_distinct(F.flatten("anchors"))).alias("at"))
    anchor = scratch.write(anchor.select("item", "at", F.col("words")[F.col("at")].alias("term")))
    anchor_terms = scratch.write(anchor.select("term").distinct())
    index = scratch.write(postings(docs, anchor_terms, anchor_terms.count(), key, text))
    n_anchor = anchor.count()
    shifted = index.join(small_or_shuffled(anchor, n_anchor), "term").select(key, "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = shifted.groupBy(key, "item", "shift").agg(F.collect_set("at").alias("met"))
    # the windows, by their starts in the item, whose anchors all met
    starts = F.expr("filter(sequence(0, size(anchors) - 1), s -> size(array_except(anchors[s], met)) = 0)")
    diagonals = met.join(small_or_shuffled(anchored.select("item", "anchors"), n_anchor), "item").select(key, "item", "shift", starts.alias("starts"))
    diagonals = scratch.write(diagonals.where(F.size("starts") > 0))
    # the exact words along the diagonals
    some = scratch.write(diagonals.select(key).distinct())
    texts = docs.join(small_or_shuffled(some, some.count()), key, "left_semi").select(key, words(F.col(text)).alias("doc_words"))
    lined = diagonals.join(texts, key).join(small_or_shuffled(anchored.select("item", "words", "len"), n_anchor), "item")
    equal = F.expr("filter(starts, s -> shift + s >= 0 and slice(doc_words, shift + s + 1, len) = slice(words, s + 1, len))")
    return lined.select(key, "item", "shift", "len", F.explode(equal).alias("s")).select(key, "item", (F.col("shift") + F.col("s")).alias("start"), "len")


def covered(spans: Column) -> Column:
    """How many positions sorted spans (start, len) cover together."""
    done = "cast(struct(0 as n, -1 as stop) as struct<n: bigint, stop: bigint>)"
    return F.aggregate(spans, F.expr(done), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["stop"], x["start"]))).cast("long").alias("n"), F.greatest(a["stop"], x["start"] + x["len"]).cast("long").alias("stop")), lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row with its words, words inside an occurrence of a window, items found, and whether hits reach 1 / share of the words."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.col(item).cast("string").alias("name"), item_words(F.col(item_text)).alias("words"))
    # windows of equal texts are looked for once; wordless items, which have none, would all meet in one group
    groups = scratch.write(items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set(F.coalesce("name", F.lit("null"))).alias("names")).withColumn("item", name("words")))
    own = docs.select(F.struct(*keep).alias("kept"), F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_doc", name("_key", "_text"))
    found = scratch.write(phrase_occurrences(scratch, own.select("_doc", "_text"), groups.select("item", "words"), window).distinct())
    hits = found.groupBy("_doc").agg(covered(F.array_sort(F.collect_set(F.struct("start", "len")))).alias("n_hit"))
    named = found.select("_doc", "item").distinct().join(groups.select("item", "names"), "item").groupBy("_doc").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    hits = scratch.write(hits.join(named, "_doc"))
    out = own.select("kept", "_doc", word_count(F.col("_text")).alias("n_words")).join(small_or_shuffled(hits, hits.count()), "_doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "kept.*",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("names"), ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text") -> DataFrame:
    """(key, query, at): places of a query's rarest word with all its other words at most ``within`` words away, in any order.

    One row per place.  Place 0 is the first word.  Rows of equal id and text are one document; rows of equal id with other texts, and all
    rows without an id, are documents of their own; the texts of a repeated query id are one query with the words of all of them.  A frequent
    word is only looked for in the buckets of positions around a rare one.
    """
    scratch = Scratch(docs.sparkSession)
    wanted = queries.select(F.col(query).alias("q"), F.explode(F.array_distinct(F.filter(words(F.col(query_text)), lambda w: w != ""))).alias("term"))
    wanted = scratch.write(wanted.distinct())
    terms = scratch.write(wanted.select("term").distinct())
    n = terms.count()
    own = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_doc", name("_key", "_text"))
    freq = frequencies(own, terms, n, "_text")
    index = scratch.write(postings(own.select("_doc", "_text"), terms, n, "_doc", "_text"))
    ranked = wanted.join(freq, "term", "left").groupBy(F.struct("q").alias("q")).agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "term")).alias("rare"), F.count("*").alias("n"))
    ranked = scratch.write(ranked.select("q", F.col("rare.term").alias("rare"), "n"))
    n_queries = ranked.count()
    rare = index.join(small_or_shuffled(ranked, n_queries), F.col("term") == F.col("rare")).select("_doc", "q", "n", F.col("pos").alias("at")).distinct()
    rare = scratch.write(rare)
    # buckets of `within` positions: the others lie in the same bucket or a neighbour
    near = rare.withColumn("b", F.explode(F.array(*[F.floor(F.col("at") / within) + d for d in (-1, 0, 1)])))
    sought = near.join(small_or_shuffled(wanted.select(F.struct("q").alias("q"), "term"), wanted.count()), "q")
    met = sought.join(index.select("_doc", "term", "pos", F.floor(F.col("pos") / within).alias("b")), ["_doc", "term", "b"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    whole = met.groupBy("_doc", "q", "at").agg(F.count_distinct("term").alias("met"), F.first("n").alias("n")).where("met = n")
    some = scratch.write(whole.select("_doc", "q", "at"))
    ids = scratch.write(own.select("_doc", "_key").join(small_or_shuffled(some.select("_doc").distinct(), some.count()), "_doc", "left_semi").distinct())
    return some.join(small_or_shuffled(ids, ids.count()), "_doc").select(F.col("_key").alias(key), F.col("q.q").alias(query), "at")
