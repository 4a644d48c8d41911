"""Language and quality models: held-out accuracy on invented text, and odd rows."""

import random
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from loomgraph.llm import langid, quality

SYLLABLES = {"en": "the of and ing er at on".split(), "fr": "le eau oi que é ç un".split(), "de": "sch ung ein der ß ü ach".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang := r.choice(list(SYLLABLES)), r.randrange(3, 60)), lang) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("key", F.lit("clash"))
    model = langid.fit(docs.where("doc_id < 200"))
    got = langid.identify(docs.where("doc_id >= 200"), model, keep=["doc_id", "lang"]).collect()
    assert len(got) == 200 and np.mean([x["lang"] == x["lang_pred"] for x in got]) > 0.98 and all(0 <= x["score"] <= 1 for x in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (3, "12 !?"), (None, prose(r, "de", 40_000))], "doc_id long, text string")
    found = [(x["doc_id"], x["lang_pred"], x["score"] > 0.5) for x in langid.identify(odd, model).collect()]
    assert sorted(found, key=str) == sorted([(1, "und", False), (2, "und", False), (3, "und", False), (3, "und", False), (None, "de", True)], key=str)
    none = langid.fit(docs.limit(0))
    assert [x["lang_pred"] for x in langid.identify(odd, none).collect()] == ["und"] * 5
    assert langid.identify(odd.limit(0), model).collect() == []


def test_filter_returns_all_languages_of_a_gram():
    grams = np.arange(1000, dtype=np.int64) * 7919
    planes = np.zeros((1, 1 << 14), np.uint64)
    for k, part in enumerate((grams[:600], grams[300:])):
        for at in langid.slots_of(part, 1 << 14, 3):
            planes[0, at] |= np.uint64(1 << k)
    mask = planes[0][next(langid.slots_of(grams, 1 << 14, 1))]
    for at in langid.slots_of(grams, 1 << 14, 3):
        mask = mask & planes[0][at]
    assert (mask[:600] & np.uint64(1)).all() and (mask[300:] & np.uint64(2)).all() and (mask[600:] & np.uint64(1)).mean() < 0.05


def test_quality(spark):
    r = random.Random(2)
    bad = lambda: "### ".join(prose(r, "en", 40).split()) if r.random() < 0.5 else f"{prose(r, 'en', 1)} " * 60
    rows = [(i, prose(r, "en", 60) if i % 4 else bad(), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").withColumn("score", F.lit("clash")).withColumn("label", F.lit("clash"))
    labels = docs.select("doc_id", "quality", F.lit("clash").alias("text"))
    model = quality.fit(docs, labels.where("doc_id < 400"), dict_bytes=60_000)
    got = quality.score(docs.where("doc_id >= 400"), model, keep=["doc_id", "quality"]).collect()
    assert np.mean([(x["score"] >= 0.3) == x["quality"] for x in got]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "word " * 60_000)], "doc_id long, text string")
    assert all(0 <= x["score"] <= 1 for x in quality.score(odd, model).collect())
    one = quality.fit(docs, labels.where("quality = 1"))
    assert all(x["score"] > 0.9 for x in quality.score(odd, one).collect())
    assert [x["score"] for x in quality.score(odd, quality.fit(docs, labels.limit(0))).collect()] == [0.5] * 4
    assert quality.score(odd.limit(0), model).collect() == []


def test_size_differences_by_hand(spark):
    """Scores of whole texts, long ones too, from a plain loop over their pieces with the model's dictionaries."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, prose(r, "en" if i % 2 else "de", 1 + i * i * 3), i % 2) for i in range(60)], "doc_id long, text string, quality int")
    model = quality.fit(docs, docs.where("doc_id < 40"))
    assert model.good and model.bad and len(model.good) <= 250_000
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    params = zstandard.ZstdCompressionParameters.from_level(quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=18)
    with_dictionary = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for c in (model.good, model.bad)]
    size = lambda c, data: sum(len(c.compress(data[i : i + quality.PIECE])) for i in range(0, len(data), quality.PIECE))
    for x in docs.collect():
        data = x["text"].encode()
        good, bad = (size(c, data) for c in with_dictionary)
        assert abs(got[x["doc_id"]] - 1 / (1 + np.exp(-(model.slope * (bad - good) / len(data) + model.constant)))) < 1e-9
    right = [(x["quality"] == 1) == (got[x["doc_id"]] >= 0.5) for x in docs.collect()]
    assert np.mean(right) > 0.9


def test_excerpts_come_from_the_whole_text():
    data = bytes(range(256)) * 40
    got = quality.excerpts(data, 650).split(b"\n" + data[:2])[0]
    assert got[:64] == data[:64] and quality.excerpts(data, 650).endswith(data[-64:]) and len(quality.excerpts(data, 650)) <= 650
    assert quality.excerpts(b"short", 650) == b"short" and quality.excerpts(data, 10) == data[:10]
    assert quality.share_of_each([10, 10, 1000, 1000], 230) == 103


def test_language_counts_and_decisions_by_hand(spark):
    """Trigram profiles, shares and decisions from plain dictionaries; a large filter has next to no false positives."""
    r = random.Random(6)
    rows = [(i, prose(r, lang := ["en", "fr", "de"][i % 3], r.randrange(1, 40)), lang) for i in range(240)] + [(900, "the the", "en"), (901, "!!", "fr"), (902, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 120 or doc_id >= 900"), min_rate=1e-3, slots=1 << 20)

    def grams(text):
        line = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        line = f" {' '.join(line.split())} "
        return [line[i - 1 : i + 2] for i in range(1, len(line) - 1) if line[i] != " "]

    counts = {lang: Counter(g for k, t, of in rows if of == lang and (k < 120 or k >= 900) for g in grams(t)) for lang in ("en", "fr", "de")}
    profile = {lang: {g for g, n in c.items() if n >= max(1, 1e-3 * sum(c.values()))} for lang, c in counts.items()}
    assert set(model.languages) == set(profile) and [sum(counts[x].values()) for x in model.languages] == sorted((sum(c.values()) for c in counts.values()), reverse=True)
    got = {x["doc_id"]: x for x in langid.identify(docs, model).collect()}
    for k, t, _ in rows:
        g = grams(t)
        if not g:
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
            continue
        share = {lang: sum(x in profile[lang] for x in g) / len(g) for lang in profile}
        assert abs(got[k]["score"] - max(share.values())) < 1e-3 and share[got[k]["lang_pred"]] > max(share.values()) - 1e-3


def test_language_ties_go_to_the_larger_then_the_smaller_name(spark):
    docs = spark.createDataFrame([(1, "abc def", "b"), (2, "abc def", "a"), (3, "abc def ghi abc", "c")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["c", "a", "b"]
    odd = spark.createDataFrame([(1, "abc def"), (2, "def " * 100_000)], "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("found", F.lit(2)).withColumn("score", F.lit("clash"))
    assert [x["lang_pred"] for x in langid.identify(odd, model).orderBy("doc_id").collect()] == ["c", "c"]
    two = langid.fit(docs.where("doc_id < 3"))
    assert [x["lang_pred"] for x in langid.identify(odd, two).collect()] == ["a", "a"]
