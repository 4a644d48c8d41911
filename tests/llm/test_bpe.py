import random
from functools import cache

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@cache
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def odd_texts():
    r = random.Random(3)
    bits = [" ", "  ", "\n", "\n\n", "a", "the", " word", "'ll", "'r", "é", "ß", "123", "...", "!!", "日本", "\t", "🙂", "<|endoftext|>", "x" * 30, " " * 40]
    return ["", " ", "a", "\n\n\nb", "Hello  world's", "<|endoftext|>", *["".join(r.choice(bits) for _ in range(r.randrange(1, 400))) for _ in range(60)], "q" * 3000, "9" * 3000, " " * 3000, "ab " * 1000]


def test_whole_and_chunked_texts_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(1000, None), (None, "no id " * 50), (7, "again " * 200), (7, "again " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("i", F.lit(2))
    for chunk, overlap in ((100_000, 512), (200, 60), (90, 40)):
        found = bpe.encode(docs, PATH, PATTERN, "text", ["doc_id", F.col("text").alias("t")], chunk, overlap)
        got = sorted(((r["doc_id"] is None, r["doc_id"]), r["t"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found.collect() if r["t"] is not None)
        want = sorted(((i is None, i), t, oracle().encode_ordinary(t)) for i, t in rows if t is not None)
        assert got == want
        back = bpe.decode(found, PATH, text=True).where("t is not null and decoded <> t").count()
        assert back == 0
    r = bpe.digests(docs.where("doc_id = 1000"), PATH, PATTERN).collect()[0]
    assert r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"]


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_own_merges_equal_the_library():
    own = bpe.Codec(PATH, PATTERN)
    for piece in {p for t in odd_texts() for p in own.pattern.findall(t)}:
        assert own.merge(piece.encode()) == oracle().encode_ordinary(piece)


def test_ids_are_looked_up_for_all_rows_at_once():
    table = pa.array([b"a", b"", None, b"xyz"], pa.large_binary())
    ids = lambda *x: np.array(x, "<u4").tobytes()
    rows = pa.array([ids(3), ids(3, 0, 1), b"", None, ids(0, 0)], pa.binary())
    assert bpe.joined_bytes(table, rows.slice(1)).to_pylist() == [b"xyza", b"", b"", b"aa"]
    assert bpe.joined_bytes(table, rows.slice(2, 2)).to_pylist() == [b"", b""]
    with pytest.raises(KeyError):
        bpe.joined_bytes(table, pa.array([ids(0, 2)], pa.binary()))
