"""The pipeline against the same decisions made document by document, on a small table."""

import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, langid, pii
from loomgraph.llm.common import crc_mod
from tests.llm.test_bagminhash import bag, jaccard
from tests.llm.test_phrase_index import brute


def tables(spark, folder):
    r = random.Random(4)
    syllables = {"en": "the of and ing er at on".split(), "fr": "le eau oi que é ç un".split()}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(i, text("en", 20)) for i in range(4)]
    docs = [(i, text(lang := r.choice(["en", "fr"]), r.randrange(5, 90)), lang) for i in range(80)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(5)]
    docs += [(200 + i, docs[i][1] + " added", docs[i][2]) for i in range(5, 10)]
    docs += [(300, text("en", 30) + " " + items[1][1] + " " + text("en", 10), "en"), (301, items[2][1], "en"), (302, text("en", 900) + " " + items[0][1], "en")]
    docs += [(400, "mail jane.doe@example.com now " + text("en", 20), "en"), (401, text("fr", 20) + " jane (at) example (dot) org", "fr"), (402, "123 456 !!", None), (403, None, None), (404, "", "en"), (405, "日本語 の 文", None), (406, text("en", 9000), None)]
    rows = [(k, t, lang, "src0", len(t or "")) for k, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_pipeline_equals_document_by_document(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    model = langid.fit(docs.where((crc_mod("doc_id", 4) != 2) & docs["doc_id"].isNotNull()))
    names, shares = langid.scores(model, [t or "" for _, t, *_ in rows])
    kept = [(k, t) for (k, t, *_), name, share in zip(rows, names, shares) if name != langid.UNDETERMINED and share >= corpus_pipeline.LEAST_SHARE]
    assert not {402, 403, 404, 405} & {k for k, _ in kept} and len(kept) == len(rows) - 4
    bags = {k: bag(t) for k, t in kept}
    parent = {k: k for k in bags}
    find = lambda k: k if parent[k] == k else find(parent[k])
    for a in bags:
        for b in bags:
            if a < b and jaccard(bags[a], bags[b]) >= 0.8 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = [(k, t) for k, t in kept if find(k) == k]
    bad = {k for k, *_, c in brute(kept, items) if c}
    assert {300, 301} <= bad and 302 not in bad
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {k: coder.encode_ordinary(pii.redacted(t)) for k, t in kept if k not in bad}
    assert got.keys() == want.keys()
    for k, ids in want.items():
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids
    assert "<email>" in coder.decode(want[400]) and "<email>" in coder.decode(want[401])


def test_rows_without_an_id_and_repeated_rows(spark, tmp_path):
    rows, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    some = docs.where("doc_id between 20 and 29 or doc_id = 301")
    odd = some.unionByName(some).unionByName(some.selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars"))
    left = corpus_pipeline.decontamination(spark, corpus_pipeline.near_duplicates(spark, odd, str(tmp_path)), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(20, 30))
    alone = corpus_pipeline.decontamination(spark, odd.where("doc_id is null"), str(tmp_path))
    assert alone.count() == 10
    clash = docs.select("*", "doc_id", F.lit(1).alias("lang_pred"), F.lit(2).alias("_doc")).toDF(*docs.columns, "row", "lang_pred", "_doc").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, str(tmp_path)).columns == clash.columns


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_no_arrow_batch_of_more_than_a_few_texts(spark):
    """What executors hold outside of their heap grows with the batches: texts of 20 kB come 100 at a time at most."""
    from loomgraph.llm.common import with_workers

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows]})

    rows = with_workers(spark).range(0, 300, 1, 1).selectExpr("repeat('x', 20000) AS text")
    assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) <= 100
