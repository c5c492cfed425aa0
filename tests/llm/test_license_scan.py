import math
import re

from pyspark.sql import functions as F

from sieveline.llm.license_scan import TEMPLATES, Weights, license_scan

SCHEMA = "path string, text string, license string, score int"
MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
ROWS = [
    ("/a/LICENSE", TEMPLATES["MIT"][3]),
    ("/a/b/c/f.py", "code without a notice"),
    ("/a/b/LICENSE.txt", "Copyright someone\n\n" + TEMPLATES["GPL-3.0"][2].replace(" the terms", "\nthe terms")),
    ("/a/x.py", "# " + APACHE + "\nprint(1)"),
    ("/a/y.py", None),
    ("/z/q.py", "a word on licensing in prose, which is not any known licence text at all"),
    ("/z/r.py", ""),
    (None, MIT),
    ("top.py", "plain"),
    ("/a/y.py", None),
    ("/t/LICENSE-b", APACHE),
    ("/t/LICENSE-a", APACHE),
    ("/t/f.py", "ties go to the lesser path"),
    ("/a/nc.py", "words before\nLicensed under CC BY-NC 4.0.\nwords after"),
    ("/a/odd.py", "This file is distributed under the Zorkmid Exotic Licence, see there."),
    ("/a/long.py", "word " * 30_000 + "and more. Released under the MIT License. " + "word " * 30_000),
]


def is_license():
    return F.col("path").rlike("(^|/)LICENSE[^/]*$")


def cut_out(text):
    """The passages of a text, by another reading of the rule."""
    cue = re.compile("licen[cs]|copyright|redistribut|warrant|spdx|public domain|permission", re.I)
    lines = [x for x in re.split("[\n\r]+", text) if x]
    out = [x for x in lines if cue.search(x)]
    for line in lines:
        if cue.search(line) and len(re.split(r"(?<=[.;!?])\s+", line.strip())) > 1:
            out += [x for x in re.split(r"(?<=[.;!?])\s+", line.strip()) if cue.search(x)]
    return out + [x for x in re.split(r"\r?\n[^\S\n]*\r?\n", text) if "\n" in x.strip() and cue.search(x)]


def vector(passage, every, known):
    """Term counts by inverse document frequency; a term that no template has counts as one in no passage."""
    counts = {}
    for t in re.findall(r"[a-z]+|[0-9]+(?:[.][0-9]+)*", passage.lower()):
        counts[t] = counts.get(t, 0) + 1
    rarity = {}
    for t in counts:
        df = sum(t in set(re.findall(r"[a-z]+|[0-9]+(?:[.][0-9]+)*", p.lower())) for p in every) if t in known else 0
        rarity[t] = math.log((1 + len(every)) / (1 + df)) + 1
    return {t: n * rarity[t] for t, n in counts.items()}


def cosine(a, b):
    dot = sum(x * b.get(t, 0) for t, x in a.items())
    return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if dot else 0.0


def brute(rows):
    """(path, license, score, source_path) of every row, from the rows alone."""
    every = [p for _, t in rows for p in cut_out(t or "")]
    known = {t for forms in TEMPLATES.values() for f in forms for t in re.findall(r"[a-z]+|[0-9]+(?:[.][0-9]+)*", f.lower())}
    forms = [(name, vector(f, every, known)) for name, fs in TEMPLATES.items() for f in fs]
    own = {}
    for path, text in rows:
        best = (0.0, None)
        for p in cut_out(text or ""):
            v = vector(p, every, known)
            for name, f in forms:
                if cosine(v, f) > best[0] + 1e-12:
                    best = (cosine(v, f), name)
        stated = any(re.search(r"\b(licen[cs]ed|released|distributed|available) under\b|spdx-license-identifier", p, re.I) for p in cut_out(text or ""))
        if best[0] >= 0.6 or stated:
            own[path, text] = (best[1] if best[0] >= 0.6 else None, best[0])
    out = []
    for path, text in rows:
        hit = (None, None, None)
        if (path, text) in own:
            hit = (*own[path, text], path)
        elif path:
            parts = path.split("/")[:-1]
            while parts and hit == (None, None, None):
                here = sorted((-s, p, n) for (p, _), (n, s) in own.items() if p and n and p.rsplit("/", 1)[0] == "/".join(parts) and p.rsplit("/", 1)[-1].startswith("LICENSE"))
                if here:
                    hit = (here[0][2], -here[0][0], here[0][1])
                parts.pop()
        out.append((path, hit[0], None if hit[1] is None else round(hit[1], 9), hit[2]))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(p, t, "x", 1) for p, t in ROWS], SCHEMA).repartition(3)
    got = license_scan(df, is_license()).collect()
    assert sorted(((r.path, r.license, r.score and round(r.score, 9), r.source_path) for r in got), key=str) == brute(ROWS)
    of = {r.path: (r.license, r.how) for r in got}
    assert of["/a/b/c/f.py"] == ("GPL-3.0", "inherited") and of["/a/x.py"] == ("Apache-2.0", "own") and of["/a/y.py"] == ("MIT", "inherited") and of["/z/q.py"] == (None, None)
    assert of["/a/nc.py"] == ("CC-BY-NC-4.0", "own") and of["/a/odd.py"] == (None, "unknown") and of["/a/long.py"] == ("MIT", "own") and of["/t/f.py"] == ("Apache-2.0", "inherited")


def test_rows_of_one_path_have_their_own_licence(spark):
    """Rows that share a path or an id, negative ids, no id, no path."""
    rows = [(7, "/a/7", "Released under the MIT License."), (7, "/a/7", "About birds."), (-13, "/b/13", "Released under the Apache License, Version 2.0."), (None, None, "Released under the MIT License."), (None, None, "None.")]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), is_license(), keep=("doc_id",)).collect()
    assert sorted(((r.doc_id or 0, r.license or "", r.how or "") for r in got)) == [(-13, "Apache-2.0", "own"), (0, "", ""), (0, "MIT", "own"), (7, "", ""), (7, "MIT", "own")]


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA), is_license()).count() == 0


def test_every_template_finds_itself():
    w = Weights(TEMPLATES, 0, {})
    for name, forms in TEMPLATES.items():
        for form in forms:
            assert w.best([form])[1] == name
