"""The transducer against two public implementations, and its decoder."""

import random

import pytest
from pyspark.sql import functions as F

from casemill.llm.tokens import PATTERN, Transducer, encoder, read_ranks, vocabulary_path

PIECES = ["a", "b", " ", "the", "ing", "é", "漢", "字", "😅", "\n", "  ", "'s", "'ll", "1", "23", "_", "--", "A", "<|endoftext|>", "\x00", "ा", "aaaa", "\t", " ", "ﬁ", "İ"]


@pytest.fixture(scope="module")
def machine():
    return Transducer(read_ranks(vocabulary_path()))


def texts():
    rng = random.Random(1)
    yield from ("", " ", "\n\n\n", "a" * 3000, "漢字" * 700, "don't we'll I'VE", "x" + " " * 500, "<|endoftext|>")
    for _ in range(1500):
        yield "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))


def test_equal_to_tiktoken(machine):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    for t in texts():
        assert machine.encode(t) == other.encode_ordinary(t), t[:60]


def test_equal_to_tokenizers(machine):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    some = list(texts())[:400]
    assert [e.ids for e in other.encode_batch(some, add_special_tokens=False)] == [machine.encode(t) for t in some]


def test_decoding_streams(machine):
    for t in texts():
        assert machine.decode(machine.encode(t)) == t
    ids = machine.encode("漢字😅")
    assert "".join(machine.stream(ids)) == "漢字😅" and machine.decode(ids[:-1]).endswith("�")


def test_emission_is_bounded(machine):
    longest = max(map(len, machine.ranks))
    for word in (b"internationalization", "漢字".encode() * 200, b"a" * 1000):
        emitted, held, state = [], 0, None
        for n, (state, out) in enumerate(machine.feed(word), 1):
            emitted += out
            held = max(held, n - sum(len(machine.tokens[i]) for i in emitted))
        assert held <= 3 * longest
        assert emitted + list(machine.rests[state]) == machine.encode_word(word)


def test_column(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "hello world")], "doc_id long, text string").selectExpr("*", "'x' as ids2")
    got = {r["doc_id"]: r["ids"] for r in df.select("doc_id", encoder(spark)(F.col("text")).alias("ids")).collect()}
    assert got == {1: [31373, 995], 2: [], 3: [], 4: [31373, 995]}
    assert df.limit(0).select(encoder(spark)(F.col("text")).alias("ids")).count() == 0
