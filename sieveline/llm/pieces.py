"""Unigram segmentation over a SentencePiece vocabulary: the streaming Viterbi and the trie-shared scores.

A piece's log probability is the model file's own score if the file is a unigram model.  Files of the BPE type hold merge ranks
instead; for these a piece of rank r (its place in the file) gets the Zipf estimate ``-ln(r + 2.7)``.  Both operators read the
vocabulary on the driver, from a path that is a parameter, and send it with the tasks; its size is fixed by the file.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import add

SPACE = "▁"
#: What a character that no piece covers costs beside its bytes' own scores.
BYTE_SCORE = -20.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with ids and scores; ``byte_ids`` for characters that no piece covers."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    longest: int
    #: Whether a piece may hold a space after another character; if not, each space begins a new segment.
    crosses: bool = False
    #: Whether a piece holds a newline.
    newlines: bool = False
    texts: dict[int, str] = field(default_factory=dict)
    #: Neighbouring characters of any piece: between two others no piece reaches over.
    pairs: frozenset[str] = frozenset()
    bytes_of: dict[int, bytes] = field(default_factory=dict)
    trie: dict = field(default_factory=dict)  # letters to nodes; a node's score is under the empty string


    def finder(self):
        """An automaton of all pieces, which is built anew where it is used."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            out.add_word(piece, (len(piece), score))
        out.make_automaton()
        return out


def default_path() -> str:
    """The installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None, zipf: bool | None = None) -> Vocabulary:
    """Read a SentencePiece model with byte pieces.  ``zipf``: see the module; by default if scores are ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    ids, scores, raw, byte_ids = {}, {}, {}, [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], raw[piece] = i, model.get_score(i)
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary has no pieces for bytes")
    ranks = zipf if zipf is not None else all(float(s).is_integer() for s in raw.values())
    first = min(ids.values(), default=0)
    for piece, i in ids.items():
        scores[piece] = -math.log(i - first + 2.7) if ranks else raw[piece]
    crosses = any(SPACE in p.lstrip(SPACE) for p in ids)
    trie: dict = {}
    for piece, score in scores.items():
        node = trie
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return Vocabulary(ids, scores, tuple(byte_ids), max(map(len, ids), default=1), crosses, any("\n" in p for p in ids), {i: p for p, i in ids.items()}, frozenset(p[k : k + 2] for p in ids for k in range(len(p) - 1)), {i: bytes([b]) for b, i in enumerate(byte_ids)}, trie)


def marked(text: str) -> str:
    """The text as pieces see it: spaces are marks, with one before the text."""
    return SPACE + text.replace(" ", SPACE)


def _width(character: str) -> int:
    return len(character.encode("utf-8", "surrogatepass"))


class Stream:
    """Viterbi over characters that arrive in turn, in memory bounded by the longest piece and the open stretch.

    An automaton of all pieces names those that end at each character.  ``feed`` gives the ids that have become certain: those
    before the latest boundary on which the paths of all positions that a further piece can start from converge.  Of equal
    scores the longest last piece wins.
    """

    def __init__(self, vocabulary: Vocabulary, finder=None) -> None:
        self.v, self.finder = vocabulary, finder or vocabulary.finder()
        self.search = None
        self.text = ""  # what is not committed yet
        self.score = [0.0]  # best score up to each position of it
        self.back: list[int] = [0]  # where the last piece of that path starts
        self.offset = 0  # characters that are committed

    def _ids(self, upto: int) -> list[int]:
        out, at = [], upto
        while at:
            piece = self.text[self.back[at] : at]
            i = self.v.ids.get(piece)
            out += [i] if i is not None else [self.v.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            at = self.back[at]
        return out[::-1]

    def _converged(self) -> int:
        """The latest boundary that the paths of all live positions share."""
        n = len(self.score) - 1
        live = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.back[last])
        return live.pop()

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        size = 2 * self.v.longest
        for at in range(0, len(text), size):
            self._read(text[at : at + size])
            if len(self.text) > size:
                out += self._commit(self._converged())
        return out

    def _read(self, text: str) -> None:
        score, back = self.score, self.back
        done = len(score) - 1  # positions up to here are settled
        self.text += text
        score += [-math.inf] * len(text)
        back += [0] * len(text)
        if self.search is None:
            self.search = self.finder.iter(text)
        else:
            self.search.set(text, False)
        shift = 1 - self.offset
        for end, (size, own) in self.search:
            end += shift
            while done < end - 1:
                done += 1
                self._settle(done)
            s = score[end - size] + own
            if s > score[end]:
                score[end], back[end] = s, end - size
        while done < len(score) - 1:
            done += 1
            self._settle(done)

    def _settle(self, at: int) -> None:
        """Where no path of pieces beats it, a character stands for itself, in bytes if need be."""
        if self.score[at] < self.score[at - 1]:
            single = self.score[at - 1] + BYTE_SCORE * _width(self.text[at - 1])
            if single > self.score[at]:
                self.score[at], self.back[at] = single, at - 1

    def _commit(self, at: int) -> list[int]:
        if not at:
            return []
        out = self._ids(at)
        base = self.score[at]
        self.text, self.score, self.back = self.text[at:], [s - base for s in self.score[at:]], [max(0, b - at) for b in self.back[at:]]
        self.offset += at
        return out

    def end(self) -> list[int]:
        return self._commit(len(self.score) - 1)


def encode_marked(text: str, vocabulary: Vocabulary, finder=None) -> list[int]:
    if finder is not None and len(text) <= 2 * vocabulary.longest:
        return _encode_short(text, vocabulary, finder)
    stream = Stream(vocabulary, finder)
    return stream.feed(text) + stream.end()


def _encode_short(text: str, vocabulary: Vocabulary, finder) -> list[int]:
    """What ``Stream`` makes of a text that it would read at once, without the state that carries one over to the next."""
    n, done = len(text), 0
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for last, (size, own) in (*finder.iter(text), (n, (0, 0.0))):
        while done < last:  # positions that nothing further ends at: a character stands for itself where no piece beats it
            least = score[done]
            done += 1
            if least + BYTE_SCORE > score[done]:  # at one byte, the least that it costs
                single = least + BYTE_SCORE * _width(text[done - 1])
                if single > score[done]:
                    score[done], back[done] = single, done - 1
        if size:
            s = score[last + 1 - size] + own
            if s > score[last + 1]:
                score[last + 1], back[last + 1] = s, last + 1 - size
    out, at, ids = [], n, vocabulary.ids
    while at:
        piece = text[back[at] : at]
        i = ids.get(piece)
        out += [i] if i is not None else [vocabulary.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
        at = back[at]
    return out[::-1]


def segments(text: str, vocabulary: Vocabulary) -> list[str]:
    """Stretches of a marked text that no piece crosses: runs of marks with the word that follows, and single newlines
    where no piece holds one."""
    if vocabulary.crosses:
        return [text]
    if "\n" in text and not vocabulary.newlines:
        out = []
        for line in text.split("\n"):
            out += [*segments(line, vocabulary), "\n"]
        return out[:-1]
    out, parts = [], text.split(SPACE)
    marks = 0
    if parts[0]:
        out.append(parts[0])
    for part in parts[1:]:
        marks += 1
        if part:
            out.append(SPACE * marks + part)
            marks = 0
    if marks:
        out.append(SPACE * marks)
    return out


def unbridged(text: str, vocabulary: Vocabulary) -> list[str]:
    """A stretch cut wherever no piece reaches over: there all paths converge."""
    pairs, out, start = vocabulary.pairs, [], 0
    for k, pair in enumerate(map(add, text, text[1:]), 1):
        if pair not in pairs:
            out.append(text[start:k])
            start = k
    out.append(text[start:])
    return out


def decode_marked(ids: list[int], vocabulary: Vocabulary) -> str:
    byte, texts = vocabulary.bytes_of, vocabulary.texts
    if byte.keys().isdisjoint(ids):
        return "".join([texts[i] for i in ids])
    out = b"".join(byte[i] if i in byte else vocabulary.texts[i].encode("utf-8", "surrogatepass") for i in ids)
    return out.decode("utf-8", "replace")


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text that was encoded."""
    return decode_marked(ids, vocabulary).replace(SPACE, " ")[1:]


def count_long(word: str, vocabulary: Vocabulary) -> int:
    """The number of tokens of one stretch's best path, in memory bounded by the longest piece: counts go along with scores."""
    trie, ids, keep = vocabulary.trie, vocabulary.ids, vocabulary.longest + 1
    score, tokens = [0.0] * keep, [0] * keep  # of the last positions, by their number modulo keep
    walk: list[tuple[int, dict]] = []
    for end, c in enumerate(word, 1):
        on, best, count = [], -math.inf, 0
        for a, node in (*walk, (end - 1, trie)):
            child = node.get(c)
            if child is not None:
                s = child.get("")
                if s is not None and score[a % keep] + s > best:
                    best, count = score[a % keep] + s, tokens[a % keep] + 1
                on.append((a, child))
        before = (end - 1) % keep
        if best < score[before]:
            size = len(c.encode("utf-8", "surrogatepass"))
            if score[before] + BYTE_SCORE * size > best:
                best, count = score[before] + BYTE_SCORE * size, tokens[before] + (1 if c in ids else size)
        score[end % keep], tokens[end % keep], walk = best, count, on
    return tokens[len(word) % keep]


def counts(words: list[str], vocabulary: Vocabulary) -> dict[str, int]:
    """The number of tokens of each word's best path, by one pass over the words in order.

    Sorted words are a walk of their trie: the scores of a prefix that a word shares with the one before are those on the
    stack, so each node of the trie is scored once; a word's end stores its count.
    """
    out: dict[str, int] = {}
    trie, ids = vocabulary.trie, vocabulary.ids
    score, tokens, walks, before = [0.0], [0], [[]], ""
    for word in sorted(set(words)):
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        del score[same + 1 :], tokens[same + 1 :], walks[same + 1 :]
        for end in range(same + 1, len(word) + 1):
            c = word[end - 1]
            on, best, count = [], -math.inf, 0
            for a, node in (*walks[-1], (end - 1, trie)):
                child = node.get(c)
                if child is not None:
                    s = child.get("")
                    if s is not None and score[a] + s > best:
                        best, count = score[a] + s, tokens[a] + 1
                    on.append((a, child))
            if best < score[end - 1]:
                size = len(c.encode("utf-8", "surrogatepass"))
                if score[end - 1] + BYTE_SCORE * size > best:
                    best, count = score[end - 1] + BYTE_SCORE * size, tokens[end - 1] + (1 if c in ids else size)
            score.append(best)
            tokens.append(count)
            walks.append(on)
        out[word] = tokens[-1]
        before = word
    return out
