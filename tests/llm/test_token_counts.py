import math
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from pyspark.sql import functions as F

from loomgraph.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(scores, least):
    """The installed unigram tokenizer over the same pieces, with bytes for unknowns."""
    vocab = [("<unk>", least), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *scores.items()]
    model = tokenizers.models.Unigram(vocab, 0, True)
    return lambda text: len(model.tokenize("▁" + text.replace(" ", "▁"))) if text else 0


def texts():
    r = random.Random(2)
    bits = ["hello", " ", "  ", "world", "\n", "日本語", "é", "🙂", "\t", "un", "believ", "able", "123", "▁", "ß", "x" * 40, "the ", "ing", "\x00"]
    return ["", "a", " ", "   ", *["".join(r.choice(bits) for _ in range(r.randrange(1, 120))) for _ in range(300)], "a" * 5000, "日" * 5000, " " * 5000]


def test_equals_the_library():
    vocabulary = C.load_vocabulary(PATH)
    want, own = library(vocabulary.scores, vocabulary.least), C.counter(PATH)
    assert own.by_words
    for t in texts():
        assert own.count(t) == want(t), t


def test_scores_follow_ranks_and_counts_are_plausible():
    """Probabilities that add up to one, and counts near those of the file's own tokenizer."""
    v = C.load_vocabulary(PATH)
    assert abs(sum(math.exp(x) for x in v.scores.values()) - 1) < 1e-3 and C.Counter(v).by_words
    own, file = C.counter(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert own.count("hello world") == len(file.encode("hello world"))
    sample = "Internationalization of tokenizers is hard work. Les mots français comptent aussi, und deutsche Wörter ebenfalls; numbers like 12345 too."
    assert abs(own.count(sample) / len(file.encode(sample)) - 1) < 0.15


def test_ties_and_whole_texts():
    r = random.Random(5)
    for k in range(200):
        pieces = {"".join(r.choice("ab▁") for _ in range(r.randrange(1, 5))): -float(r.randrange(1, 4)) / (3 if k % 2 else 1) for _ in range(12)}
        least = min(0.0, *pieces.values())
        own, want = C.Counter(C.Vocabulary(pieces, least)), library(pieces, least)
        for _ in range(20):
            t = "".join(r.choice("ab c") for _ in range(r.randrange(30)))
            assert own.count(t) == want(t), (pieces, t)


def test_table(spark):
    rows = [(1, "hello world"), (2, None), (2, None), (None, ""), (3, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = C.counts(docs, PATH).collect()
    assert sorted(r["n_tokens"] for r in got)[:3] == [0, 0, 0] and len(got) == 5
    assert C.counts(docs.limit(0), PATH).collect() == []
