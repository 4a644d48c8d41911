"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its lower-cased words, weighted by their counts.  For each of K components and each
term, r and c follow Gamma(2, 1) and b is uniform, all fixed by hashes of term and component.  With
t = floor(ln(weight) / r + b) the sample's key is ln(c) - r (t + 1 - b); the term with the smallest key is the
component's sample.  Two texts share a sample with a probability that equals the
generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

The gamma values are logarithms of products of two uniforms, so their tails aren't cut: in a text of n words the
winning keys come from an r near ln(n) and beyond.  A key depends on term and weight alone, so the report works it out
once for each term and weight of a group of neighbouring documents, and their texts only take minima.

Defined results: null is the empty text; a text without words has the fingerprint of zeros, alike to itself
(1) and to nothing else (0); equal texts have equal fingerprints.  Documents follow each other by
descending id, null ids last, rows of equal id (and of no id) by a hash of their text.  Extra columns are not read; an empty table gives an empty
result; a single document is its own next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that a bucket of neighbours holds, and buckets at most (their bounds and first ids go to the driver); beyond that they grow.
BUCKET_ROWS, BUCKETS = 256, 65_536
#: Neighbours that share their terms' keys.
GROUP_ROWS = 256
#: Components of one row: 8, since 16 make generated code too long to be compiled (sf0.1: keys 9 s at 8, 52 s at 16).
CHUNK = 8
#: Documents that a task holds, and tasks at most.
TASK_ROWS, TASKS = 1500, 50_000


def gamma(u: Column, v: Column) -> Column:
    """A Gamma(2, 1) value from two uniforms."""
    return -F.ln(u * v)


def with_parameters(terms: DataFrame, k: int) -> DataFrame:
    """``terms``, a row for each ``chunk`` of CHUNK components, with the keys of the samples of ``term`` at ``log_weight`` as an array of longs.

    A key is fixed-point above 24 bits of the term's hash, so that the smallest one names its term.
    """
    part = lambda x, shift, n: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) / F.lit(float(1 << n))

    def key(i: int) -> Column:
        bits = F.xxhash64("term", F.col("chunk") * CHUNK + F.lit(i))
        more = F.xxhash64(bits)
        r, b, c = gamma(part(bits, 32, 32), part(bits, 0, 32)), part(more, 0, 20), gamma(part(more, 42, 22), part(more, 20, 22))
        value = F.ln(c) - r * (F.floor(F.col("log_weight") / r + b) + 1 - b)
        return F.shiftleft(((value + 64) * float(1 << 32)).cast("long"), 24).bitwiseOR(F.col("term").bitwiseAND(F.lit((1 << 24) - 1)))

    chunks = terms.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((k - 1) // CHUNK))))
    return chunks.withColumn("keys", F.array(*[key(i) for i in range(min(k, CHUNK))]))


def samples(terms: DataFrame, by: list[str], k: int) -> DataFrame:
    """Fingerprints of the groups ``by`` of rows (chunk, keys)."""
    inside = range(min(k, CHUNK))
    found = terms.groupBy(*by, "chunk").agg(*[F.min(F.get("keys", F.lit(i))).alias(f"_{i}") for i in inside])
    text = F.concat(*[F.lpad(F.hex(F.col(f"_{i}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for i in inside])
    chunks = [F.max(F.when(F.col("chunk") == c, F.col("_text"))) for c in range((k - 1) // CHUNK + 1)]
    return found.withColumn("_text", F.lower(text)).groupBy(*by).agg(F.substring(F.concat(*chunks), 1, 8 * k).alias("fingerprint"))


def likeness(a: Column, b: Column, k: int) -> Column:
    """Share of the k components that two fingerprints have in common."""
    same = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("int") for i in range(k)]
    return reduce(lambda x, y: x + y, same) / F.lit(float(k))


def fingerprints(texts: DataFrame, key: str = "doc_id", text: str = "text", k: int = 64) -> DataFrame:
    """(key, fingerprint) of each row, for any table of texts with unique keys."""
    words = texts.select(F.col(key), F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORDS)).alias("w")).where("w <> ''")
    terms = words.groupBy(key, F.xxhash64("w").alias("term")).agg(F.count("*").alias("weight")).withColumn("log_weight", F.ln("weight"))
    return texts.select(key).join(samples(with_parameters(terms, k), [key], k), key, "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit("0" * 8 * k)))


def doubles(values: list[float]) -> str:
    """SQL for a constant array."""
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)" if values else "cast(array() as array<double>)"


def bucket_of(place: str, bounds: list[float]) -> Column:
    """How many of the sorted bounds lie below the place, by halving."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))] or [1]
    return F.expr(f"cast(aggregate(array({','.join(map(str, steps))}), 0, (_n, _step) -> if(get({doubles(bounds)}, _n + _step - 1) < {place}, _n + _step, _n)) as long)")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, id, h, copy, place, text, next): each text with the next one by descending id.

    Buckets hold neighbours and about as many documents each, whatever the ids: bounds are quantiles of a number that never falls along the
    order.  A copy of each bucket's first document also goes behind the last one of
    the bucket before, so that no order over the whole table is needed.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    share = (F.shiftright("h", 12) + (1 << 51)) / float(1 << 52)  # 0 to 1 in the order of the hash, which so spreads equal ids
    place = F.when(F.col("id").isNull(), (share + 1) * 2.0**64).otherwise(share - F.col("id").cast("double"))
    narrow = scratch.write(rows.select("id", "h").withColumn("at", place))
    n = narrow.count()
    buckets = min(BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    bounds = []
    if buckets > 1:
        shares = doubles([i / buckets for i in range(1, buckets)])
        bounds = sorted(set(narrow.agg(F.expr(f"percentile_approx(at, {shares}, {max(10_000, 4 * buckets)})")).first()[0]))
    # the first of each bucket: ~id falls as the id rises
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("back"), "h"))
    heads = narrow.withColumn("bucket", bucket_of("at", bounds)).groupBy("bucket").agg(first.alias("f")).select("bucket", F.bitwise_not("f.back").alias("id"), "f.h").orderBy("bucket").collect()
    target = [(r["id"], r["h"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]  # the bucket before; the first one goes behind the last
    target = F.broadcast(spark.createDataFrame(target, "i long, g long, bucket long"))  # at most BUCKETS rows
    copies = rows.join(target, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select("id", "h", "text", "bucket", F.lit(1).alias("copy"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, -(-n // TASK_ROWS)))
    placed = rows.withColumn("at", place).select("id", "h", "text", bucket_of("at", bounds).alias("bucket"), F.lit(0).alias("copy"))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("id"), "h")
    return placed.unionByName(copies).repartition(tasks, "bucket").withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 64) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Everything after the one shuffle by bucket stays in its task.
    """
    rows = with_next(docs, key, text)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    # slot: twice the place, one more for the edited text
    version = lambda v, t: F.struct(F.lit(v).alias("v"), F.col(t).alias("t"))
    versions = F.when(F.col("copy") == 0, F.array(version(0, "text"), version(1, "edited"))).otherwise(F.array(version(0, "text")))
    each = rows.select("bucket", "place", F.inline(versions)).withColumn("slot", 2 * F.col("place") + F.col("v"))
    words = each.select("bucket", "slot", F.explode(F.split(F.lower("t"), WORDS)).alias("w")).where("w <> ''")
    terms = words.groupBy("bucket", "slot", F.xxhash64("w").alias("term")).agg(F.count("*").alias("weight"))
    part = F.floor((F.col("slot") - 2) / (2 * GROUP_ROWS)).alias("part")
    shared = terms.groupBy("bucket", part, "term", "weight").agg(F.collect_list("slot").alias("slots"))  # 2 GROUP_ROWS at most
    keys = with_parameters(shared.select("bucket", "term", "slots", F.ln("weight").alias("log_weight")), k)
    prints = samples(keys.select("bucket", "chunk", "keys", F.explode("slots").alias("slot")), ["bucket", "slot"], k)
    # what else is known of a document, found from the same exchange by bucket, which keeps texts without words as well
    known = rows.select("bucket", "place", F.struct("id", "copy", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).alias("known"))
    of = lambda v: F.when(F.col("slot") % 2 == v, F.col("fingerprint"))
    halves = prints.select("bucket", F.floor(F.col("slot") / 2).alias("place"), of(0).alias("own"), of(1).alias("other"))
    one = lambda c: F.coalesce(F.max(c), F.lit("0" * 8 * k))
    docs_ = halves.unionByName(known, allowMissingColumns=True).groupBy("bucket", "place").agg(one("own").alias("fingerprint"), one("other").alias("edited_fingerprint"), F.max("known").alias("known")).select("bucket", "place", "fingerprint", "edited_fingerprint", "known.*")
    order = Window.partitionBy("bucket").orderBy("place")
    docs_ = docs_.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("copy = 0")
    return docs_.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), k).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), k).alias("near_next"),
    )
