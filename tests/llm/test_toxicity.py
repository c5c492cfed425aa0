import math
import random

import pytest

from sieveline.llm.toxicity import Automaton, Lexicon, edits, keep_clean, learn, toxicity, training_rows

DOCS = "doc_id long, text string, toxic int, score string"
LABELS = "doc_id long, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    entries = (("idiot", False, 1.0), ("worthless", False, 1.0), ("bad", False, 1.0), ("vequ", True, 1.0), ("lostra", True, 1.0))
    automaton = Automaton(Lexicon(entries))
    rng = random.Random(3)
    for _ in range(4000):
        word = list(rng.choice(entries)[0])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "o", "st"])
        word = "".join(word) + rng.choice(["", "", "an"])
        want = []
        for at, (letters, stem, _) in enumerate(entries):
            d = min(distance(letters, word[:k]) for k in range(len(word) + 1)) if stem else distance(letters, word)
            if d <= edits(len(letters), stem):
                want.append((d, at))
        assert automaton.find(word) == min(want, default=None), word


def test_quotation_counts_less_than_abuse():
    a = Automaton(Lexicon((("idiot", False, 4.0),)))
    plain = a.evidence("what an idiot that is")
    assert a.evidence('he wrote "idiot" on the wall') < plain < a.evidence("you are an idiot here")
    assert a.evidence("IDIOT!!! idi0t") > plain > a.evidence("nothing here") == 0


STRIP = " \t\n\r\x0b\x0c.,;:!?*#$%&()[]{}<>/\\|~^_+=-'\"`´‘’“”„«»…¡¿"
REPORTING = "said says say called calls wrote writes quote quoted quotes word term insult slur".split()
ADDRESS = "you your youre u ya du dich dein ihr tu toi vous usted ustedes".split()


def slow_evidence(text, lexicon):
    """The summed weight of a text, word by word and entry by entry, by the full table of distances."""
    words, best = (text or "").lower().split(), {}
    for i, raw in enumerate(words):
        word, hit = raw.strip(STRIP), None
        for at, (letters, stem, _) in enumerate(lexicon.entries):
            d = min(distance(letters, word[:k]) for k in range(len(word) + 1)) if stem else distance(letters, word)
            if d <= edits(len(letters), stem) and (hit is None or (d, at) < hit):
                hit = (d, at)
        if hit is None or (hit[0] and word in lexicon.guards):
            continue
        before, after = words[max(0, i - 4) : i], words[i + 1 : i + 5]
        near = {w.strip(STRIP) for w in before + after}
        quotes = set('"“”„«»')
        head = raw[: len(raw) - len(raw.lstrip(STRIP))]
        opened = bool(quotes & set(head)) or any(w[:1] in quotes for w in before)
        closed = any(quotes & set(w[-2:]) for w in (raw, *after))
        factor = 0.25 if (opened and closed) or near & set(REPORTING) else 1.5 if near & set(ADDRESS) else 1.0
        best[word] = max(best.get(word, 0.0), lexicon.entries[hit[1]][2] * 0.6 ** hit[0] * factor)
    return sum(best.values())


def test_score_against_brute_force(spark, tables):
    docs, labels = tables
    lexicon, slope, intercept = learn(training_rows(docs, labels))
    assert lexicon.entries and slope > 0
    want = [(str(r.doc_id), round(1 / (1 + math.exp(-(slope * min(slow_evidence(r.text, lexicon), 40.0) + intercept))), 9)) for r in docs.collect()]
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity(docs, labels).collect()) == sorted(want)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    docs, labels = [], []
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randrange(5, 60))
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(["scumbag", "moronic", "vilefiend", "gruk" + rng.choice(["an", "el", "os"]), "grukit"], 2):
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), 0, "x"))
        if i % 3 == 0:
            labels.append((i, int(toxic)))
    docs += [(5000, None, None, None), (5001, "", 1, "x"), (None, "scumbag moronic", 1, "x"), (5002, "you scumbg moronik", 1, "x"), (0, docs[0][1], 0, "x")]
    labels += [(None, 1), (5000, None), (0, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_learns_from_labels(tables):
    docs, labels = tables
    got = toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    of = {r.doc_id: r.predicted for r in got}
    wrong = [i for i in range(900) if of[i] != (i % 6 == 0)]
    assert len(wrong) <= 9 and of[None] == 1 and of[5002] == 1 and of[5000] == of[5001] == 0
    kept = keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_without_labels_and_rows(spark, tables):
    docs, labels = tables
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    given = toxicity(docs, labels.limit(0), entries=[("scumbag", False)]).collect()
    assert {r.doc_id: r.predicted for r in given}[None] == 1
