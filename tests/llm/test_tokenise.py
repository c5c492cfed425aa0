import math
import random

import pytest

from sieveline.llm.pieces import BYTE_SCORE, SPACE, Stream, count_long, counts, decode, default_path, encode_marked, load, marked, segments
from sieveline.llm.tokenise import decoded, encode, token_counts

SCHEMA = "doc_id long, text string, ids string, n_tokens int"
TEXTS = ["", None, " ", "Hello  world\n x ", "日本語テキスト 🎉", "naïve café", "a" * 5000, "tab\tand\r\nlines   ", "internationalisation of tokenisers", "x" * 70 + " y", "\u0000odd", "the the the"]


@pytest.fixture(scope="module")
def vocabulary():
    return load()


def whole(text, v):
    """Viterbi over the whole text at once."""
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = [(best[a] + v.scores[text[a:end]], -a) for a in range(max(0, end - v.longest), end) if text[a:end] in v.scores]
        options.append((best[end - 1] + BYTE_SCORE * len(text[end - 1].encode()), -(end - 1)))
        s, a = max(options)
        best.append(s)
        back.append(-a)
    return best[-1]


def score(ids, v):
    byte = set(v.byte_ids)
    return sum(BYTE_SCORE if i in byte else v.scores[v.texts[i]] for i in ids)


def test_stream_reaches_the_best_score(vocabulary):
    rng, finder = random.Random(1), vocabulary.finder()
    for n in range(150):
        text = "".join(rng.choice([SPACE, SPACE, "t", "h", "e", "in", "g", "tion", "é", "語", "\n"]) for _ in range(n))
        ids = encode_marked(text, vocabulary, finder)
        assert math.isclose(score(ids, vocabulary), whole(text, vocabulary), abs_tol=1e-6)
        parts = [i for s in segments(text, vocabulary) for i in encode_marked(s, vocabulary, finder)]
        assert math.isclose(score(parts, vocabulary), score(ids, vocabulary), abs_tol=1e-6) and "".join(segments(text, vocabulary)) == text
        assert len(ids) == 0 or sum(counts([text], vocabulary).values()) == len(ids)


def test_long_stretches_are_counted_as_in_the_trie(vocabulary):
    rng = random.Random(4)
    words = ["".join(rng.choice(["t", "h", "in", "g", "tion", "é", "語", "x", "aaa"]) for _ in range(n)) for n in (1, 2, 5, 17, 60, 300)]
    assert {w: count_long(w, vocabulary) for w in words} == counts(words, vocabulary)
    assert count_long("ab" * 200_000, vocabulary) == len(encode_marked("ab" * 200_000, vocabulary))


def unigram(vocabulary, path):
    """A unigram model file with the pieces and scores of the vocabulary: nothing is trained."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = proto.ModelProto()
    given = sentencepiece.SentencePieceProcessor(model_file=default_path())
    for i in range(given.get_piece_size()):
        name = given.id_to_piece(i)
        kind = 6 if given.is_byte(i) else 2 if given.is_unknown(i) else 3 if given.is_control(i) else 1
        model.pieces.add(piece=name, score=vocabulary.scores.get(name, 0.0), type=kind)
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = True
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return sentencepiece.SentencePieceProcessor(model_file=str(path))


def test_ids_are_those_of_the_library(spark, vocabulary, tmp_path):
    """The public library, given the same pieces and scores as a unigram model, makes the same ids."""
    library = unigram(vocabulary, tmp_path / "unigram.model")
    texts = [t for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [t for t in TEXTS if t and "\u0000" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in encode(df).collect()}
    counted = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    same = 0
    for i, text in enumerate(texts):
        ids = library.encode(text)
        same += ids == got[i]
        # of paths of equal score either may be taken
        total = lambda x: sum(0.0 if vocabulary.texts.get(k) is None else vocabulary.scores[vocabulary.texts[k]] for k in x)
        assert ids == got[i] or math.isclose(total(ids), total(got[i]), rel_tol=1e-5)
        assert counted[i] == len(got[i])
    assert same >= 0.95 * len(texts)  # the others are ties


def test_window_stays_bounded(vocabulary):
    finder = vocabulary.finder()
    stream, most = Stream(vocabulary, finder), 0
    text = marked("the quick brown fox jumps over lazy dogs and tokenisation goes on " * 300)
    out = []
    for c in text:
        out += stream.feed(c)
        most = max(most, len(stream.text))
    assert most < 8 * vocabulary.longest
    assert decode(out + stream.end(), vocabulary) == text[1:].replace(SPACE, " ")


def test_round_trip_and_counts(spark, vocabulary):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (3, TEXTS[3], "x", 1)], SCHEMA)
    got = encode(df)
    rows = got.collect()
    assert all(r.round_trip for r in rows) and len(rows) == df.count()
    back = sorted((str(r.doc_id), r.text) for r in decoded(got).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in df.collect())
    sizes = sorted((str(r.doc_id), r.n_ids) for r in rows)
    assert sizes == sorted((str(r.doc_id), r.n_tokens) for r in token_counts(df).collect())
    mark = spark.createDataFrame([(1, "a" + SPACE + "b")], "doc_id long, text string")
    assert [r.round_trip for r in encode(mark).collect()] == [False]
    assert encode(df.limit(0)).count() == 0 and token_counts(df.limit(0)).count() == 0


def test_short_texts_as_a_stream_and_little_remembered(vocabulary):
    """Texts that a stream would read at once take a shorter way to the same ids; tasks hold few stretches and no trie."""
    from sieveline.llm import pieces, tokenise

    rng, finder = random.Random(4), vocabulary.finder()
    for _ in range(2000):
        text = "".join(rng.choice(f"{SPACE}abcdehinorstüß中😀\n0") for _ in range(rng.randint(1, 2 * vocabulary.longest)))
        stream = Stream(vocabulary, finder)
        want = stream.feed(text) + stream.end()
        assert encode_marked(text, vocabulary, finder) == want
        assert pieces._encode_short(text, vocabulary, finder) == want
    assert tokenise.REMEMBERED <= 100_000


def test_frequent_stretches_outlast_many_rare_ones():
    """200,000 rare stretches between two uses of a frequent one do not make it be encoded twice."""
    from sieveline.llm.tokenise import _Remembered

    made = []
    known = _Remembered(lambda part: made.append(part) or b"")
    for part in ("often", *map(str, range(200_000)), "often"):
        known[part]
    assert made.count("often") == 1
