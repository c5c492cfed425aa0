import random

import public_tokenizers
import tiktoken

from sieveline.llm.byte_pairs import BytePairs, decode, encode, java_pattern, merged, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(n=150):
    rng = random.Random(5)
    letters = "abcdefgeinrst  ABZ019.,;'\n\téß  中文ال\U0001f600́\x00\x1c"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 200))) for _ in range(n)]
    return out + ["don't  stop   \n\n now", " ", "   ", "  x", "x   y", "'re'll've", "<|endoftext|>", "a" * 5000, "1234567 89"]


def test_ids_are_those_of_the_library(spark):
    rows = [(i, t, "kept") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = decode(encode(df, PATH, PATTERN), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == LIBRARY.encode_ordinary(r.text), r.text
        assert bytes(r.decoded) == r.text.encode() and r.word == "kept"


def test_the_fold_of_higher_order_functions(spark):
    """Each distinct word folded by Spark is what the merges in a task give, and what the library gives."""
    made = BytePairs(PATH, PATTERN)
    df = spark.createDataFrame([(t,) for t in texts(40)], "text string")
    folded = made.frequent(df)
    assert len(folded) > 100
    for word, ids in folded.items():
        assert ids == merged(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)


def test_words_that_no_table_has(spark):
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("aabcdeinorsté中") for _ in range(rng.randrange(1, 80)))
        assert merged(word.encode(), RANKS) == LIBRARY.encode_ordinary(word)
    assert sum(len(LIBRARY.decode([i])) for i in merged(b"xq" * 100_000, RANKS)) == 200_000  # a very long word


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "same"), (2, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in decode(encode(df, PATH, PATTERN), PATH).collect())
    same = LIBRARY.encode_ordinary("same")
    assert got == [(0, [], b""), (1, [], b""), (1, [], b""), (2, same, b"same"), (2, same, b"same")]
    assert encode(df.limit(0), PATH, PATTERN).count() == 0


def test_white_space_of_the_pattern():
    assert java_pattern(r"\s+(?!\S)|[^\s\p{L}]+").count("2028") == 3


def test_no_word_is_merged_in_python(spark, monkeypatch):
    """Words that the table of frequent ones lacks, long ones too, are folded by Spark, and each where it stands."""
    monkeypatch.setattr("sieveline.llm.byte_pairs.MOST_WORDS", 3)
    monkeypatch.setattr("sieveline.llm.byte_pairs.merged", None)
    rng = random.Random(7)
    long = ["".join(rng.choice("aabcdeinorsté中") for _ in range(n)) for n in (130, 199, 200, 201, 900, 3000)]
    rows = [(t, "kept") for t in [*texts(60), *long, "ab" * 700, "a" * 901, " ".join(long[:3] * 3), None]]
    got = encode(spark.createDataFrame(rows, "text string, found_0 string"), PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == LIBRARY.encode_ordinary(r.text or "") and r.found_0 == "kept", r.text
