"""SentencePiece encoding and decoding, and token counts, over columns of text.

Encoding is a streaming Viterbi (``pieces.Stream``): ids are committed as soon as all surviving paths converge, in a window
bounded by the longest piece.  No piece of the usual vocabularies crosses into the next word, so all paths converge before each
mark of a space; stretches between such marks are therefore encoded one by one and remembered, up to REMEMBERED of them in a
task.  A mark that is in the text itself decodes to a space, as the format has no other sign for either: such texts are the
only ones that do not come back as they were, and ``round_trip`` says so.

Token counts insert a batch's distinct stretches in a trie, in the order of a walk, and compute scores once per shared prefix;
a stretch of more than LONGEST_REMEMBERED characters, with which hardly any shares one, is counted in a window of its own.

Defined results: null and empty texts have no ids and count 0; of paths of equal score the one whose last piece is longest is
taken; very long texts, also without a space, need memory for the text itself, its ids and a window of the longest piece; rows
that repeat get the same; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import whole_texts
from sieveline.llm.pieces import SPACE, Vocabulary, count_long, counts, decode, decode_marked, encode_marked, load, marked, segments, unbridged

#: Stretches that a task remembers: some 400 bytes each.  Frequent ones are lost with the others when it is full.
REMEMBERED = 250_000
#: A stretch of more characters is not remembered.
LONGEST_REMEMBERED = 64


class _Remembered(dict):
    """What a function makes of a stretch; cleared when full, and not kept for long stretches."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, part: str):
        made = self.make(part)
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = made
        return made


def _stretches(text: str, vocabulary: Vocabulary) -> list[str]:
    return segments(marked(text), vocabulary) if text else []


def _encode_rows(vocabulary: Vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong: set[str] = set()  # stretches whose ids do not decode to them; decoding goes stretch by stretch

        def made(part: str) -> bytes:
            ids = [i for piece in unbridged(part, vocabulary) for i in within[piece]]
            if decode_marked(ids, vocabulary) != part:
                wrong.add(part)
            return array("i", ids).tobytes()

        finder = vocabulary.finder()
        within = _Remembered(lambda part: encode_marked(part, vocabulary, finder))
        known = _Remembered(made)
        get = known.__getitem__
        for batch in batches:
            keys = batch.column(0)
            texts = whole_texts(batch)
            for at in range(0, len(texts), 256):
                flat, same = [], []
                for raw in texts[at : at + 256]:
                    text = raw.decode("utf-8")
                    parts = _stretches(text, vocabulary)
                    flat.append(b"".join(map(get, parts)))
                    same.append(SPACE not in text and (not wrong or wrong.isdisjoint(parts)))
                sizes = [len(x) // 4 for x in flat]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(flat), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(sizes, pa.int64()), lists, pa.array(same)], schema=schema)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_ids, ids and round_trip (whether decoding the ids gives the text again) of every row.

    The tasks get the vocabulary without its trie, which only counting walks.
    """
    return _rows(docs).mapInArrow(_encode_rows(replace(vocabulary or load(), trie={})), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decoded(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    v = vocabulary or load()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(ids or [], v) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def _count_rows(vocabulary: Vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            keys = batch.column(0)
            texts = whole_texts(batch)
            for at in range(0, len(texts), 256):
                parts = [_stretches(t.decode("utf-8"), vocabulary) for t in texts[at : at + 256]]
                short = {w for p in parts for w in p if len(w) <= LONGEST_REMEMBERED}
                new = short - memory.keys()
                if len(memory) + len(new) > REMEMBERED:
                    memory, new = {}, short
                memory.update(counts(list(new), vocabulary))
                get = lambda w: memory[w] if len(w) <= LONGEST_REMEMBERED else count_long(w, vocabulary)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array([len(p) for p in parts], pa.int64()), pa.array([sum(map(get, p)) for p in parts], pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, n_words (stretches that begin with a space) and n_tokens of every row."""
    return _rows(docs).mapInArrow(_count_rows(vocabulary or load()), "doc_id long, n_words long, n_tokens long")
