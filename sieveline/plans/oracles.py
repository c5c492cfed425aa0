"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sieveline.functions.text import FOREIGN_SCRIPTS, FRENCH_STOP_WORDS, LEET_DIGITS, LEET_SYMBOLS
from sieveline.operators.corpus import SEED
from sieveline.operators.heuristic import DEMO as HEURISTIC
from sieveline.operators.matching import INNOCENT, LATIN_SUFFIXES
from sieveline.operators.redact import FALLBACK, POLITE
from sieveline.sources.lexicon import DEMO, sql_values

_TOKEN = r"\p{Tamil}+|\p{Latin}+|\p{Nd}+|\p{L}+|[^\s\p{L}\p{Nd}]+"
_LEX = f"lexicon AS (SELECT * FROM {sql_values()}), exact AS (SELECT * FROM lexicon WHERE surface NOT LIKE '% %'), multi AS (SELECT * FROM lexicon WHERE surface LIKE '% %')"
_TOK = f"tok AS MATERIALIZED (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM documents))"


def _script(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^\\p{{Tamil}}') THEN 'TAMIL' WHEN regexp_matches({t}, '^\\p{{Latin}}') THEN 'LATIN' WHEN regexp_matches({t}, '^\\p{{Nd}}') THEN 'DIGIT' WHEN regexp_matches({t}, '^\\p{{L}}') THEN 'OTHER_SCRIPT' ELSE 'SYMBOL' END"


#: Edit distance counts bytes in DuckDB: characters beyond ASCII, which no surface has, become one byte.
_WORDS = f"words AS MATERIALIZED (SELECT DISTINCT lower(token) AS word, {_script('token')} AS script, regexp_replace(lower(token), '[^\\x00-\\x7F]', '#', 'g') AS bytes FROM tok)"
_SUFFIXES = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(LATIN_SUFFIXES)) + ") AS suffixes(rank, suffix)"
_GUARD = "word NOT IN (" + ", ".join(f"'{w}'" for w in INNOCENT) + ")"
_M = {
    "exact": "SELECT word, 0 AS stage, 0 AS rank, ord, canon, category, severity, 'exact' AS match_type FROM words JOIN exact ON word = surface WHERE script = 'LATIN' AND length(word) >= 2",
    "suffix": f"SELECT word, 1, rank, ord, canon, category, severity, 'suffix_strip' FROM words JOIN {_SUFFIXES} ON suffix(word, suffix) JOIN exact ON surface = left(word, length(word) - length(suffix)) WHERE script = 'LATIN' AND length(word) - length(suffix) >= 4",
    "fuzzy1": f"SELECT word, 2, 0, ord, canon, category, severity, 'fuzzy_levenshtein' FROM words JOIN exact ON abs(length(word) - length(surface)) <= 1 AND levenshtein(bytes, surface) <= 1 WHERE script = 'LATIN' AND length(word) >= 5 AND length(surface) >= 5 AND {_GUARD}",
    "fuzzy2": f"SELECT word, 2, 0, ord, canon, category, severity, 'fuzzy_levenshtein' FROM words JOIN exact ON levenshtein(bytes, surface) <= 2 WHERE script = 'LATIN' AND length(word) >= 6 AND length(surface) >= 4 AND {_GUARD}",
    "fuzzy_short": f"SELECT word, 2, 0, ord, canon, category, severity, 'fuzzy_levenshtein' FROM words JOIN exact ON levenshtein(bytes, surface) <= 1 WHERE script = 'LATIN' AND length(word) IN (4, 5) AND length(surface) >= 4 AND {_GUARD}",
    "substring": "SELECT word, 3, 0, ord, canon, category, severity, 'substring_containment' FROM words JOIN exact ON contains(word, surface) WHERE script = 'LATIN' AND length(word) >= 5 AND length(surface) >= 4 AND severity IN ('high', 'medium')",
}
_MCOLS = "m(word, stage, rank, ord, canon, category, severity, match_type)"


def _best(*kinds: str) -> str:
    return f"WITH {_LEX}, {_TOK}, {_WORDS}, {_MCOLS} AS ({' UNION ALL '.join(_M[k] for k in kinds)}) SELECT word, arg_min(canon, rank * 281474976710656 + ord) AS canon FROM m GROUP BY word"


def _matched(*kinds: str) -> str:
    return f"{_MCOLS} AS ({' UNION ALL '.join(_M[k] for k in kinds)}), best AS (SELECT word, arg_min({{'canon': canon, 'category': category, 'severity': severity, 'match_type': match_type}}, stage * 72057594037927936 + rank * 281474976710656 + ord) AS b FROM m GROUP BY word)"


_PHRASES = """nx AS (SELECT *, lower(token) || ' ' || lower(lead(token) OVER (PARTITION BY doc_id ORDER BY pos)) AS pair FROM tok),
    cand AS (SELECT doc_id, pos, multi.* FROM nx JOIN multi ON pair = surface),
    isl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM cand),
    odd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS k FROM isl),
    starts AS (SELECT * FROM odd WHERE k % 2 = 1)"""
#: The items as entries of a lexicon.
_CAT = """items_ AS (SELECT item_id AS id, lower(name) AS canon, coalesce(kind, '') AS category, CASE size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
    list_filter([lower(brand), lower(name) || 's', lower(brand) || 'x'], lambda x: x IS NOT NULL) AS variants FROM items WHERE item_id IS NOT NULL AND name IS NOT NULL),
    cat AS (SELECT id * 4294967296 + generate_subscripts(l, 1) - 1 AS ord, unnest(l) AS surface, canon, category, severity FROM (SELECT *, [canon] || variants AS l FROM items_)),
    keyed AS (SELECT ord, surface, CASE WHEN ord % 4294967296 = 0 THEN 'canonical' ELSE 'variant' END AS kind, canon, category, severity, contains(surface, ' ') AS phrase FROM cat)"""
#: The weak tagger: phrases, then exact and suffix matches of high or medium severity.
_BIO = f"""{_LEX}, {_TOK}, {_WORDS}, {_matched('exact', 'suffix')}, {_PHRASES},
    bio AS (SELECT t.doc_id, t.pos, t.token,
        CASE WHEN s.pos IS NOT NULL THEN 'B-ABUSE' WHEN i.pos IS NOT NULL THEN 'I-ABUSE' WHEN b.b.severity IN ('high', 'medium') THEN 'B-ABUSE' ELSE 'O' END AS tag,
        CASE WHEN s.pos IS NOT NULL THEN s.canon WHEN i.pos IS NOT NULL THEN i.canon WHEN b.b.severity IN ('high', 'medium') THEN b.b.canon ELSE '' END AS canon,
        CASE WHEN s.pos IS NOT NULL THEN s.category WHEN i.pos IS NOT NULL THEN i.category WHEN b.b.severity IN ('high', 'medium') THEN b.b.category ELSE '' END AS category,
        CASE WHEN s.pos IS NOT NULL THEN s.severity WHEN i.pos IS NOT NULL THEN i.severity WHEN b.b.severity IN ('high', 'medium') THEN b.b.severity ELSE '' END AS severity,
        CASE WHEN s.pos IS NOT NULL OR i.pos IS NOT NULL THEN 'exact' WHEN b.b.severity IN ('high', 'medium') THEN b.b.match_type ELSE '' END AS match_type
        FROM tok t LEFT JOIN starts s ON s.doc_id = t.doc_id AND s.pos = t.pos LEFT JOIN starts i ON i.doc_id = t.doc_id AND i.pos + 1 = t.pos
        LEFT JOIN best b ON b.word = lower(t.token))"""
_GP = f"""{_LEX}, {_TOK}, gp AS (SELECT doc_id, pos, token, CASE WHEN severity = 'high' THEN 'B-ABUSE' ELSE 'O' END AS gold,
    CASE WHEN severity IS NOT NULL THEN 'B-ABUSE' ELSE 'O' END AS pred, coalesce(category, '') AS category, coalesce(kind, '') AS kind FROM tok LEFT JOIN exact ON lower(token) = surface)"""
_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 0), 6) AS f1"""


def _sums(gold: str, pred: str) -> str:
    return f"count(*) FILTER ({gold} AND {pred}) AS tp, count(*) FILTER (NOT {gold} AND {pred}) AS fp, count(*) FILTER ({gold} AND NOT {pred}) AS fn, count(*) FILTER (NOT {gold} AND NOT {pred}) AS tn"


def _collapsed(c: str) -> str:
    """Runs of a character beyond two dropped."""
    cs = f"string_split({c}, '')"
    # each character beside its two predecessors, so that the text is split once
    zipped = f"list_zip({cs}, list_concat([''], {cs}), list_concat(['', ''], {cs}))"
    return f"array_to_string(list_transform(list_filter({zipped}, lambda x: x[1] IS NOT NULL AND NOT (x[1] = x[2] AND x[1] = x[3] AND x[1] <> chr(10))), lambda x: x[1]), '')"


_MENTIONS = r"regexp_replace(text, '(^|[^\p{L}\p{N}_\p{M}@])@[\p{L}\p{N}_\p{M}]+', '\1', 'g')"
_DIGITS, _SYMBOLS = "".join(LEET_DIGITS), "".join(LEET_SYMBOLS)
_FOLD = f"translate(w, '{_SYMBOLS}', '{''.join(LEET_SYMBOLS.values())}')"
_HITS = "length(w) - length(translate(w, '{}', ''))"
_LEET = f"""CASE WHEN regexp_matches(w, '\\p{{L}}') OR {_HITS.format(_DIGITS)} >= 3 THEN translate({_FOLD}, '{_DIGITS}', '{''.join(LEET_DIGITS.values())}')
    WHEN {_HITS.format(_DIGITS)} + {_HITS.format(_SYMBOLS)} >= 2 THEN {_FOLD} ELSE w END"""
_KEY0 = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_KEY = rf"trim(regexp_replace(regexp_replace({_collapsed('k')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in FRENCH_STOP_WORDS) + "]"
_FRENCH = rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{Nl}}\p{{No}}]+'), lambda w: list_contains({_STOP}, w)))"
_FOREIGN = FOREIGN_SCRIPTS
_LATIN_WORDS = f"SELECT DISTINCT lower(token) AS word FROM tok WHERE {_script('token')} = 'LATIN'"
_POLITE_IN = " ".join(f"WHEN contains(word, '{k}') THEN '{v}'" for k, v in POLITE.items())
_POLITE_IS = " ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in POLITE.items())
_CANONS = ", ".join(f"'{r[0]}'" for r in DEMO)
_NODES = "html"
for _tag in ("script", "style", "noscript", "textarea", "input", "select", "option", "code", "pre"):
    _NODES = rf"regexp_replace({_NODES}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>', '<>', 'g')"
_NODES = rf"list_filter(list_transform(regexp_extract_all('>' || regexp_replace({_NODES}, '(?s)<!--.*?-->', '<>', 'g') || '<', '>([^<]+)', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 3 AND regexp_matches(x, '[a-zA-Z\x{{0B80}}-\x{{0BFF}}]'))"
_DRAW = f"md5('{SEED}:' || doc_id)"
_FREQ = r"""freq AS (SELECT token, count(*) FILTER (toxic = 1) AS off, count(*) FILTER (toxic <> 1) AS safe
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{Tamil}{3,}|\p{Latin}{3,}')) AS token, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY token)"""

_ABC, TAMIL_LETTERS = "abcdefghijklmnopqrstuvwxyz", "அஆஇஈஉஊஎஏஐஒஓகஙசஞடணதநபமயரலவழ"
#: Texts and turns as the normalisation leaves them (the tables hold no entities beyond those of pages).
_URLS, _AT = r"(?i)(?:https?://|www\.)\S+", r"'(^|[^\p{L}\p{N}_\p{M}@])@[\p{L}\p{N}_\p{M}]+', '\1', 'g'"
_CLEAN = rf"SELECT doc_id, trim(regexp_replace({_collapsed('u')}, '\s+', ' ', 'g')) AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '{_URLS}', '', 'g'), {_AT}) AS u FROM documents)"
_CLEAN_TURNS = _CLEAN.replace("doc_id", "conv_id, turn").replace("documents", "conversations")
_HEURISTIC = "(VALUES " + ", ".join(f"({k}, '{w}', '{c}')" for k, (w, _, c, _) in enumerate(HEURISTIC)) + ") AS h(rank, word, category)"
_HEURISTIC_WORDS = "|".join(w for w, *_ in HEURISTIC)


def _moderated(table: str, key: str, text: str) -> str:
    """The verdicts of a table's texts."""
    clean = _CLEAN.replace("FROM documents", "FROM docs")
    return f"""WITH {_LEX}, docs AS (SELECT {key} AS doc_id, {text} AS text FROM {table}), c AS MATERIALIZED ({clean}), tok AS MATERIALIZED (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS l FROM c)),
        {_WORDS}, {_matched('exact', 'suffix')}, {_PHRASES},
        fl AS (SELECT t.doc_id, t.pos, t.token, coalesce(s.category, i.category, b.b.category) AS category FROM tok t LEFT JOIN starts s ON s.doc_id = t.doc_id AND s.pos = t.pos LEFT JOIN starts i ON i.doc_id = t.doc_id AND i.pos + 1 = t.pos
            LEFT JOIN best b ON b.word = lower(t.token) WHERE s.pos IS NOT NULL OR i.pos IS NOT NULL OR b.b.severity <> 'low'),
        w AS (SELECT doc_id, string_agg(lower(token), ',' ORDER BY p) AS words FROM (SELECT doc_id, token, min(pos) AS p FROM fl GROUP BY ALL) GROUP BY doc_id),
        k AS (SELECT doc_id, string_agg(category, ',' ORDER BY p) AS categories FROM (SELECT doc_id, category, min(pos) AS p FROM fl WHERE category <> '' GROUP BY ALL) GROUP BY doc_id)
        SELECT d.doc_id, n IS NULL AS safe, coalesce(n, 0)::INT AS spans, coalesce(words, '') AS words, coalesce(categories, '') AS categories FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM fl GROUP BY doc_id) USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN k USING (doc_id)"""


SQL = {
    "a1_lexicon_surfaces": f"WITH {_CAT} SELECT ord, surface, kind, canon, category, severity FROM (SELECT *, CASE WHEN phrase THEN max(ord) OVER (PARTITION BY surface) ELSE min(ord) OVER (PARTITION BY surface) END AS best FROM keyed) WHERE ord = best",
    "a16_text_nodes": f"SELECT page_id, count(*) AS nodes, sum(length(n)) AS chars FROM (SELECT page_id, unnest({_NODES}) AS n FROM pages) GROUP BY page_id",
    "c1_nfc": "SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents",
    "c2_unescape_html": "SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&amp;', chr(1)), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp', '&'), chr(1), '&')) AS h FROM pages",
    "c3_strip_urls": r"SELECT page_id, md5(regexp_replace(html, '(?i)(?:https?://|www\.)\S+', '', 'g')) AS h FROM pages",
    "c4_strip_mentions": f"SELECT doc_id, md5({_MENTIONS}) AS h FROM documents",
    "c5_collapse_repeats": f"SELECT doc_id, md5({_collapsed('text')}) AS h FROM documents",
    "c9_leet_words": rf"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\s+|\S+'), lambda w: {_LEET}), '')) AS h FROM documents",
    "c12_normalize": rf"SELECT doc_id, md5(trim(regexp_replace({_collapsed('t')}, '\s+', ' ', 'g'))) AS h FROM (SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '(?i)(?:https?://|www\.)\S+', '', 'g'), '(^|[^\p{{L}}\p{{N}}_\p{{M}}@])@[\p{{L}}\p{{N}}_\p{{M}}]+', '\1', 'g') AS t FROM documents)",
    "c15_tokens_by_script": f"WITH {_TOK} SELECT {_script('token')} AS script, count(*) AS n, count(DISTINCT token) AS words FROM tok GROUP BY 1",
    "c22_dedup_key": f"SELECT doc_id, md5({_KEY}) AS h FROM (SELECT doc_id, {_KEY0} AS k FROM documents)",
    "c23_stop_words": f"SELECT doc_id, {_FRENCH} AS hits FROM documents",
    "c26_edit_distances": "SELECT n_name, r_name, levenshtein(n_name, r_name) AS dist, least(levenshtein(n_name, r_name), 6) AS bounded, len(list_filter(range(1, least(length(n_name), length(r_name)) + 1), lambda i: left(n_name, i) = left(r_name, i))) AS prefix, round(1 - levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS similarity, CASE WHEN length(n_name) <= 6 THEN 1 WHEN length(n_name) <= 10 THEN 2 ELSE 3 END AS threshold FROM nation, region",
    "c31_masks": f"""WITH {_TOK}, w AS (SELECT DISTINCT token, length(token) AS n FROM tok) SELECT token, n AS graphemes,
        CASE WHEN n <= 2 THEN repeat('*', n) WHEN n <= 6 THEN left(token, 1) || repeat('*', n - 2) || right(token, 1) ELSE left(token, 2) || repeat('*', n - 4) || right(token, 2) END AS partial,
        repeat('█', n) AS block, '[REDACTED: ' || CASE WHEN n % 2 = 0 THEN 'THREAT' ELSE 'HIGH' END || ']' AS tag FROM w""",
    "c35_polite": f"WITH {_TOK} SELECT word, CASE {_POLITE_IS} {_POLITE_IN} ELSE '{FALLBACK}' END AS polite FROM ({_LATIN_WORDS})",
    "d3_offensive_labels": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1",
    "d4_noise": f"SELECT CASE WHEN lang = 'de' THEN 'label' WHEN regexp_matches(text, '{_FOREIGN}') THEN 'script' WHEN NOT regexp_matches(text, '[\\x{{0B80}}-\\x{{0BFF}}]') AND {_FRENCH} >= 3 THEN 'french' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
    "d7_severity_gate": f"WITH {_BIO} SELECT doc_id, count(*) FILTER (severity IN ('high', 'medium') AND category IN ('', 'profanity')) AS n FROM bio WHERE tag <> 'O' GROUP BY doc_id",
    "d11_final_tag": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE upper(role) END AS final_tag FROM conversations",
    "e1_exact_match": f"WITH {_LEX}, {_TOK} SELECT canon, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok JOIN exact ON lower(token) = surface GROUP BY canon",
    "e2_phrases": f"WITH {_LEX}, {_TOK}, {_PHRASES} SELECT doc_id, pos FROM starts",
    "e3_suffix_strip": f"WITH {_TOK}, w AS ({_LATIN_WORDS}), m AS (SELECT word, rank, left(word, length(word) - length(suffix)) AS stem FROM w JOIN {_SUFFIXES} ON ends_with(word, suffix)) SELECT m.word, arg_min(stem, rank) AS canon FROM m JOIN w ON w.word = stem WHERE length(stem) >= 4 GROUP BY m.word",
    "c39_tamil_suffix": rf"""WITH {_TOK}, w AS (SELECT DISTINCT translate(word, '{_ABC}', '{TAMIL_LETTERS}') AS word FROM ({_LATIN_WORDS})), t AS (SELECT word FROM w WHERE regexp_full_match(word, '\p{{Tamil}}+')),
        m AS (SELECT word, n, left(word, length(word) - n) AS stem FROM t, range(1, 6) AS r(n) WHERE length(word) - n >= 4) SELECT m.word, arg_min(stem, n) AS canon FROM m JOIN t ON t.word = stem GROUP BY m.word""",
    "c17_tamil_scripts": rf"""WITH t AS (SELECT unnest(regexp_extract_all(translate(lower(text), '{_ABC}', '{TAMIL_LETTERS}') || ' ' || text, '{_TOKEN}')) AS token FROM conversations)
        SELECT {_script('token')} AS script, CASE WHEN len(regexp_extract_all(token, '[\x{{0B80}}-\x{{0BFF}}]')) >= len(regexp_extract_all(token, '[A-Za-z]')) THEN 'TAMIL' ELSE 'LATIN' END AS dominant, count(*) AS n FROM t GROUP BY ALL""",
    "f1_tamil_verdicts": f"""WITH d AS (SELECT doc_id, regexp_replace(nfc_normalize(translate(lower(text), '{_ABC}', '{TAMIL_LETTERS}')), '(?i)(?:https?://|www\\.)\\S+', '', 'g') AS t FROM documents),
        c AS MATERIALIZED (SELECT doc_id, {_collapsed('t')} AS t FROM d),
        tok AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_TOKEN}')) AS token FROM c),
        lex AS (SELECT ord, translate(surface, '{_ABC}', '{TAMIL_LETTERS}') AS surface, translate(canon, '{_ABC}', '{TAMIL_LETTERS}') AS canon, severity FROM (SELECT * FROM {sql_values()}) WHERE surface NOT LIKE '% %'),
        words AS (SELECT DISTINCT token AS word FROM tok WHERE regexp_matches(token, '^\\p{{Tamil}}') AND length(token) >= 2),
        m AS (SELECT word, n, ord, canon, severity FROM words, range(0, 6) AS r(n) JOIN lex ON surface = left(word, length(word) - n) WHERE n = 0 OR length(word) - n >= 4),
        best AS (SELECT word, arg_min(canon, n * 1000000000 + ord) AS canon, arg_min(severity, n * 1000000000 + ord) AS severity FROM m GROUP BY word)
        SELECT doc_id, canon, count(*) AS n FROM tok JOIN best ON token = word WHERE severity <> 'low' GROUP BY ALL""",
    "d9_guard": f"""WITH g AS (SELECT [{", ".join(f"'{w}'" for w in INNOCENT)}] AS l), s AS (SELECT generate_subscripts(l, 1) AS k, unnest(l) AS v FROM g),
        w AS (SELECT DISTINCT l[doc_id % {len(INNOCENT)} + 1] || left(regexp_extract(lower(coalesce(text, '')), '[a-z]+'), (doc_id // {len(INNOCENT)} % 3)::INT) AS word FROM documents, g)
        SELECT word, arg_min(v || 's', k) AS canon FROM w, s WHERE length(word) >= 5 AND length(v) >= 4 AND NOT list_contains((SELECT l FROM g), word) AND levenshtein(word, v || 's') <= 1 GROUP BY 1""",
    "e4_fuzzy_strict": _best("fuzzy1"),
    "e5_fuzzy_maximum": _best("fuzzy_short", "fuzzy2"),
    "e6_substring": _best("substring"),
    "e7_match_precedence": f"WITH {_LEX}, {_TOK}, {_WORDS}, {_matched('exact', 'suffix', 'fuzzy_short', 'fuzzy2', 'substring')} SELECT word, b.canon AS canon, b.match_type AS match_type FROM best",
    "e8_train_split": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "e11_enrich": f"WITH {_GP} SELECT doc_id, pos, token, canon AS lexicon_canon, lexicon.kind AS lexicon_kind, length(array_to_string(regexp_extract_all(text, '{_TOKEN}'), ' ')) AS sentence_chars FROM gp JOIN documents USING (doc_id) LEFT JOIN lexicon ON lower(token) = surface WHERE pred <> 'O'",
    "f1_tags": f"WITH {_BIO} SELECT tag, match_type, canon, count(*) AS n FROM bio GROUP BY ALL",
    "f2_merge_tags": f"""WITH {_TOK}, t AS (SELECT CASE WHEN length(token) % 3 = 0 THEN 'B-ABUSE' WHEN length(token) % 3 = 1 THEN 'I-ABUSE' ELSE 'O' END AS model,
        CASE WHEN unicode(lower(token)) % 4 = 0 THEN 'B-ABUSE' WHEN unicode(lower(token)) % 4 = 1 THEN 'I-ABUSE' ELSE 'O' END AS lexicon FROM tok)
        SELECT model, lexicon, CASE WHEN model = 'I-ABUSE' AND lexicon = 'I-ABUSE' THEN 'I-ABUSE' WHEN model <> 'O' OR lexicon <> 'O' THEN 'B-ABUSE' ELSE 'O' END AS merged,
        CASE WHEN model <> 'O' AND lexicon <> 'O' THEN 'both' WHEN model <> 'O' THEN 'model' WHEN lexicon <> 'O' THEN 'lexicon' END AS source, count(*) AS n FROM t GROUP BY ALL""",
    "f9_merged_intervals": """WITH e AS (SELECT user_id, (event_id % 500)::INT AS s, s + 1 + s % 9 AS t FROM events),
        m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM e),
        g AS (SELECT *, sum(CASE WHEN pm IS NULL OR s > pm THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM m)
        SELECT user_id, min(s) AS "start", max(t) AS "end" FROM g GROUP BY user_id, g""",
    "g1_value_counts": "SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY lang",
    "g2_sentences": f"WITH {_BIO} SELECT doc_id, arg_min(token, pos) AS first, bool_and(tag = 'O') AS needs_review, md5(string_agg(tag, ' ' ORDER BY pos)) AS tags FROM bio GROUP BY doc_id",
    "g3_unsafe_conversations": f"WITH h AS (SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '{_TOKEN}'), lambda t: lower(t) IN ({_CANONS}))) > 0 AS bad FROM conversations) SELECT conv_id, bool_or(bad) AS unsafe, min(turn) FILTER (bad) AS first_turn FROM h GROUP BY conv_id",
    "g4_token_prf": f"WITH {_GP}, s AS (SELECT label, {_sums('gold = label', 'pred = label')} FROM gp, (VALUES ('O'), ('B-ABUSE'), ('I-ABUSE')) AS l(label) GROUP BY label) SELECT label, tp, fp, fn, tp + fn AS support, {_PRF} FROM s",
    "g5_abuse_prf": f"""WITH {_GP}, s AS (SELECT {_sums("(gold <> 'O')", "(pred <> 'O')")} FROM gp) SELECT tp, fp, fn, tn, {_PRF} FROM s""",
    "g6_overall": f"""WITH {_GP}, s AS (SELECT label, {_sums('gold = label', 'pred = label')} FROM gp, (VALUES ('O'), ('B-ABUSE'), ('I-ABUSE')) AS l(label) GROUP BY label),
        f AS (SELECT label, tp + fn AS support, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s)
        SELECT (SELECT round(count(*) FILTER (gold = pred) / count(*), 6) FROM gp) AS accuracy, round(avg(f1), 6) AS macro_f1, round(coalesce(avg(f1) FILTER (label <> 'O' AND support > 0), 0), 6) AS abuse_macro_f1 FROM f""",
    "g7_sentence_prf": f"""WITH {_GP}, b AS (SELECT doc_id, bool_or(gold <> 'O') AS g, bool_or(pred <> 'O') AS p FROM gp GROUP BY doc_id), s AS (SELECT {_sums('g', 'p')} FROM b) SELECT tp, fp, fn, tn, {_PRF} FROM s""",
    "g9_distinct": f"WITH {_TOK} SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT token) AS words FROM tok",
    "g10_group_sizes": f"SELECT round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents)",
    "g11_term_frequencies": f"WITH {_FREQ} SELECT * FROM freq",
    "g14_lexicon_counts": f"WITH {_CAT} SELECT category, severity, count(*) AS n, sum(len(variants))::BIGINT AS variants FROM items_ GROUP BY GROUPING SETS ((category), (severity), ())",
    "g16_class_weights": f"""WITH {_BIO}, c AS (SELECT tag, count(*) AS n FROM bio GROUP BY tag), w AS (SELECT tag, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c), x AS (SELECT tag, w / avg(w) OVER () AS w FROM w)
        SELECT t.tag, round(least(coalesce(w, 1.0), 20.0), 6) AS weight FROM (VALUES ('O'), ('B-ABUSE'), ('I-ABUSE')) AS t(tag) LEFT JOIN x ON x.tag = t.tag""",
    "h1_near_duplicates": f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS n FROM (SELECT doc_id, lang, {_KEY0} AS k FROM documents)) WHERE n = 1",
    "h5_variants": f"""WITH {_LEX}, {_FREQ}, seeds AS (SELECT ord, canon, length(canon) AS len, CASE WHEN length(canon) <= 6 THEN 1 WHEN length(canon) <= 10 THEN 2 ELSE 3 END AS most FROM exact WHERE kind = 'canonical'),
        w AS (SELECT *, regexp_replace(token, '[^\\x00-\\x7F]', '#', 'g') AS bytes FROM freq WHERE off >= 2 AND off >= 2 * safe + 2 AND length(token) >= 4 AND NOT regexp_matches(token, '\\p{{Tamil}}')),
        p AS (SELECT seeds.*, token, off, levenshtein(canon, bytes) AS dist FROM w JOIN seeds ON abs(length(token) - len) <= most),
        c AS (SELECT ord, canon, token AS variant, off FROM p WHERE dist BETWEEN 1 AND most AND 1 - dist / greatest(len, length(token)) >= 0.65 AND (dist <> 2 OR len(list_filter(range(1, least(len, length(token)) + 1), lambda i: left(canon, i) = left(token, i))) >= greatest(3, floor(len * 0.5)))),
        a AS (SELECT (ord // 100000) * 100000 AS ord, canon, surface AS variant, 0 AS late, ord % 100000 - 1 AS k FROM exact WHERE kind = 'variant' UNION ALL SELECT ord, canon, variant, 1, -off FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY lower(variant) ORDER BY ord, late, k, variant) AS n FROM a WHERE lower(variant) NOT IN (SELECT canon FROM seeds))
        SELECT canon, variant FROM r WHERE n = 1""",
    "h9_vocabulary": f"WITH {_TOK}, c AS (SELECT lower(token) AS token, count(*) AS n, min(doc_id * 10000000 + pos) AS f FROM tok GROUP BY 1) SELECT token, n, row_number() OVER (ORDER BY n DESC, f) + 1 AS id FROM c",
    "e16_token_ids": f"""WITH {_TOK}, c AS (SELECT lower(token) AS token, count(*) AS n, min(doc_id * 10000000 + pos) AS f FROM tok GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, f) + 1 AS id FROM c),
        t AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM conversations) SELECT conv_id, sum(coalesce(id, 1))::BIGINT AS ids, count(*) FILTER (id IS NULL) AS unknown FROM t LEFT JOIN v USING (token) GROUP BY conv_id""",
    "a12_sequences": f"WITH {_BIO} SELECT doc_id::VARCHAR AS sent_id, count(*)::INT AS n, md5(string_agg(lower(token), ' ' ORDER BY pos)) AS tokens, md5(string_agg(tag, ' ' ORDER BY pos)) AS tags FROM bio GROUP BY doc_id",
    "e12_zipped_tags": f"WITH {_GP} SELECT doc_id::VARCHAR AS sent_id, count(*)::INT AS n, (count(*) FILTER (gold <> pred))::INT AS differ FROM gp GROUP BY doc_id",
    "e10_gold_ids": "SELECT doc_id, lang, gold_id FROM documents JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS gold_id FROM labels) USING (doc_id)",
    "e15_siblings": """WITH e AS (SELECT client_id::VARCHAR AS canon, CASE WHEN client_id % 2 = 0 THEN 'LATIN' ELSE 'TAMIL' END AS script, CASE WHEN master_id <> client_id THEN master_id::VARCHAR END AS ref FROM clients), o AS (SELECT DISTINCT canon, script FROM e)
        SELECT a.canon, a.script, b.canon AS sibling, b.script AS sibling_script, count(*) AS n FROM e a LEFT JOIN o b ON a.ref = b.canon GROUP BY ALL""",
    "b6_appended_log": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids, sum(length(props))::BIGINT AS chars, count(DISTINCT event_id) AS events FROM events GROUP BY ALL",
    "e17_neighbours_of_words": """WITH w(query) AS (VALUES ('w0'), ('w7'), ('w100'), ('w499'), ('w1000000000')), v AS (SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS e FROM embeddings),
        p AS (SELECT a.word AS query, b.word AS neighbor, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) AS score FROM v a JOIN w ON a.word = query JOIN v b ON a.word <> b.word),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbor)::INT AS rank FROM p)
        SELECT w.query, v.word IS NOT NULL AS in_vocab, neighbor, round(score, 5) AS score, rank FROM w LEFT JOIN v ON v.word = w.query LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON r.query = w.query""",
    "j4_query_words": f"WITH {_CAT} SELECT surface AS word, min(ord) AS ord FROM keyed WHERE NOT phrase GROUP BY 1",
    "c13_normalize_and_tag": f"WITH c AS ({_CLEAN}), tok AS (SELECT unnest(regexp_extract_all(t, '{_TOKEN}')) AS token FROM c) SELECT {_script('token')} AS script, count(*) AS n FROM tok GROUP BY 1",
    "c21_pool_text": f"SELECT conv_id, turn, md5(lower(t)) AS h FROM ({_CLEAN_TURNS})",
    "g17_pool_statistics": f"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN '..' WHEN turn % 5 = 4 THEN '' ELSE lower(t) END AS t FROM ({_CLEAN_TURNS})),
        n AS (SELECT t, len(list_filter(regexp_extract_all(t, '{_TOKEN}'), lambda x: regexp_matches(x, '^(\\p{{Tamil}}|\\p{{Latin}}|\\p{{Nd}})')))::BIGINT AS k, row_number() OVER (PARTITION BY t ORDER BY conv_id, turn) AS r FROM p)
        SELECT count(*) AS raw, count(*) FILTER (t = '') AS empty, count(*) FILTER (t <> '' AND k > 0 AND r > 1) AS duplicate, count(*) FILTER (t <> '' AND k = 0) AS untrainable,
        count(*) FILTER (t <> '' AND k > 0 AND r = 1) AS kept, (sum(k) FILTER (t <> '' AND k > 0 AND r = 1))::BIGINT AS tokens FROM n""",
    "g12_counters": f"""WITH t AS (SELECT unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM conversations), x AS (SELECT 'word' AS kind, lower(token) AS value FROM t UNION ALL SELECT 'char', unnest(string_split(lower(token), '')) FROM t
        UNION ALL SELECT 'tag', CASE WHEN length(lower(token)) > 6 THEN 'B-ABUSE' ELSE 'O' END FROM t) SELECT kind, value, count(*) AS n FROM x GROUP BY ALL""",
    "g15_totals": f"""WITH {_LEX}, c AS MATERIALIZED (SELECT row_number() OVER () AS doc_id, t FROM ({_CLEAN_TURNS})), tok AS MATERIALIZED (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS l FROM c)),
        {_WORDS}, {_matched('exact', 'suffix')}, {_PHRASES}, bad AS (SELECT doc_id FROM tok JOIN best ON lower(token) = word WHERE b.severity <> 'low' UNION SELECT doc_id FROM starts)
        SELECT count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM bad)) AS n_safe, count(*) FILTER (doc_id IN (SELECT doc_id FROM bad)) AS n_unsafe FROM c""",
    "d10_review_pool": f"WITH {_BIO} SELECT doc_id FROM bio GROUP BY doc_id HAVING bool_and(tag = 'O')",
    "d15_missed": f"WITH {_GP} SELECT doc_id, pos, token FROM gp WHERE pred <> 'O' AND gold = 'O' ORDER BY doc_id, pos LIMIT 20",
    "g18_deltas": f"""WITH {_GP}, t AS (SELECT gold, pred, CASE WHEN category = 'profanity' THEN 'B-ABUSE' ELSE 'O' END AS base FROM gp),
        m AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT {_sums("(gold <> 'O')", "(pred <> 'O')")} FROM t)), n AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (SELECT {_sums("(gold <> 'O')", "(base <> 'O')")} FROM t))
        SELECT round(m.p - n.p, 6) AS precision_delta, round(m.r - n.r, 6) AS recall_delta, round(2 * m.p * m.r / (m.p + m.r) - 2 * n.p * n.r / (n.p + n.r), 6) AS f1_delta FROM m, n""",
    "h10_best_so_far": """WITH e AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
        SELECT event_id, greatest(coalesce(before, value), value) AS best, (k - max(CASE WHEN before IS NULL OR value > before THEN k END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::INT AS stale FROM e""",
    "i4_review_sentences": f"WITH {_BIO} SELECT doc_id, count(*) AS n FROM bio GROUP BY doc_id HAVING bool_and(tag = 'O') ORDER BY doc_id LIMIT 8",
    "i7_unknown_tags": "SELECT DISTINCT upper(event_type) AS tag FROM events WHERE event_id % 3 <> 0 AND upper(event_type) NOT IN ('O', 'B-ABUSE', 'I-ABUSE')",
    "i15_checked": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS left_ids, (SELECT count(DISTINCT doc_id) FROM labels) AS right_ids, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared",
    "c46_heuristic": f"""WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS l FROM documents)),
        m AS (SELECT doc_id, k, arg_min(category, rank) AS category FROM w JOIN {_HEURISTIC} ON contains(regexp_replace(lower(w), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), word) GROUP BY doc_id, k),
        f AS (SELECT doc_id, category, min(k) AS k FROM m GROUP BY ALL), g AS (SELECT doc_id, string_agg(category, ',' ORDER BY k) AS categories FROM f GROUP BY doc_id)
        SELECT d.doc_id, n IS NULL AS safe, coalesce(n, 0)::INT AS spans, coalesce(categories, '') AS categories FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) USING (doc_id)""",
    "c47_heuristic_censor": f"""WITH w AS (SELECT conv_id, turn, text, list_transform(regexp_split_to_array(text, '\\s+'), lambda x: {{'w': x, 'b': regexp_replace(lower(x), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')}}) AS l FROM conversations),
        f AS (SELECT *, list_transform(list_filter(l, lambda x: regexp_matches(x.b, '{_HEURISTIC_WORDS}')), lambda x: lower(x.w)) AS flagged FROM w),
        c AS (SELECT *, list_transform(l, lambda x: {{'w': x.w, 'h': x.w <> '' AND x.b <> '' AND len(list_filter(flagged, lambda t: contains(x.b, t))) > 0}}) AS k FROM f)
        SELECT conv_id, turn, md5(CASE WHEN len(flagged) = 0 THEN text ELSE array_to_string(list_transform(k, lambda x: CASE WHEN NOT x.h THEN x.w WHEN length(x.w) <= 4 THEN left(x.w, 1) || repeat('*', greatest(1, length(x.w) - 2)) || right(x.w, 1)
            ELSE left(x.w, 2) || repeat('*', greatest(1, length(x.w) - 4)) || right(x.w, 2) END), ' ') END) AS censored, CASE WHEN len(flagged) = 0 THEN 0 ELSE len(list_filter(k, lambda x: x.h)) END::INT AS redacted_count FROM c""",
    "a5_csv_round_trip": """SELECT doc_id, md5('"' || text || ', ""') AS h FROM documents""",
    "a8_lines": r"SELECT md5(t) AS h, count(*) AS n FROM (SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS t FROM documents) WHERE regexp_matches(t, '\S') GROUP BY 1",
    "a15_split_lines": r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::INT AS n FROM documents",
    "i13_injection": f"""WITH {_CAT}, w AS (SELECT (ord // 4294967296) * 10 + ord % 4294967296 AS id, surface FROM keyed WHERE severity <> 'low' AND ord % 4294967296 <= 3), fl AS (SELECT unnest(['well', 'then', 'now', 'here', 'today', 'maybe']) AS f),
        r AS (SELECT id, surface, tag, f, row_number() OVER (PARTITION BY id, tag ORDER BY md5('{SEED}' || tag || ':' || id || ':' || f), f) AS k,
            least_ + floor(('0x' || left(md5('{SEED}:' || id || ':' || tag), 8))::BIGINT / 4294967296 * (most - least_ + 1))::INT AS take FROM w, fl, (VALUES ('pre', 1, 3), ('post', 0, 2)) AS t(tag, least_, most)),
        s AS (SELECT id, surface, string_agg(f, ' ' ORDER BY k) FILTER (tag = 'pre' AND k <= take) AS a, string_agg(f, ' ' ORDER BY k) FILTER (tag = 'post' AND k <= take) AS z FROM r GROUP BY id, surface),
        o AS (SELECT *, concat_ws(' ', a, surface, z) AS tokens FROM s)
        SELECT id AS sent_id, tokens, concat_ws(' ', regexp_replace(a, '\\S+', 'O', 'g'), 'B-ABUSE' || repeat(' I-ABUSE', len(string_split(surface, ' ')) - 1), regexp_replace(z, '\\S+', 'O', 'g')) AS tags FROM o""",
    "k2_once": "SELECT DISTINCT user_id FROM events",
    # settings of the second half have changed since the first
    "k6_live_config": """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, n % 2 = 0 AS enabled FROM t)
        SELECT event_id % 2 AS half, event_type, CASE WHEN event_id % 2 = 0 THEN enabled ELSE NOT enabled END AS enabled, count(*) AS n FROM events JOIN s USING (event_type) GROUP BY ALL""",
    "k5_keyed_state": "SELECT user_id, count(*) AS n FROM events GROUP BY ALL",
    "h2_first_seen": "SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms FROM events GROUP BY ALL",
    "f3_verdicts": _moderated("documents", "doc_id", "text"),
    "h9_capped_vocabulary": f"WITH {_TOK}, c AS (SELECT lower(token) AS token, count(*) AS n, min(doc_id * 10000000 + pos) AS f FROM tok GROUP BY 1 HAVING count(*) >= 2), r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, f) + 1 AS id FROM c) SELECT token, n, id FROM r WHERE id <= 1001",
    "i1_errors": f"WITH {_GP} SELECT doc_id, pos, token, category, kind FROM gp WHERE gold = 'O' AND pred <> 'O' ORDER BY (category IN ('profanity', 'sexual')) DESC, kind DESC, token, doc_id, pos LIMIT 20",
    "i2_top_tokens": f"WITH {_TOK} SELECT lower(token) AS token, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
    "i5_union": "SELECT label, count(*) AS n, sum(length(text)) AS chars FROM (SELECT lang AS label, text FROM documents UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY label",
    "i6_leak": "SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS left_ids, (SELECT count(DISTINCT doc_id) FROM labels) AS right_ids, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS shared",
    "i8_sample": f"""WITH c AS (SELECT lang, count(*) AS size, sum(count(*)) OVER () AS total FROM documents GROUP BY lang),
        q AS (SELECT *, round_even(size * 150 / total, 0)::BIGINT AS quota, row_number() OVER (ORDER BY size DESC, lang) AS k FROM c),
        z AS (SELECT lang, CASE WHEN total <= 150 THEN size ELSE least(quota + CASE WHEN k = 1 THEN 150 - sum(quota) OVER () ELSE 0 END, size) END AS quota FROM q),
        r AS (SELECT doc_id, lang, {_DRAW} AS h, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) AS n FROM documents)
        SELECT doc_id, lang FROM r JOIN z USING (lang) ORDER BY (n > quota), h, doc_id LIMIT 150""",
    "i9_split": f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, doc_id) * 2 <= count(*) OVER (PARTITION BY lang) THEN 'dev' ELSE 'test' END AS split FROM documents",
    "i11_oversample": f"""WITH {_BIO}, b AS (SELECT DISTINCT doc_id FROM bio WHERE tag = 'B-ABUSE'), e AS (SELECT bio.*, copy FROM bio JOIN b USING (doc_id), (VALUES (1), (2)) AS c(copy))
        SELECT doc_id AS sent_id, copy, count(*) AS n FROM e WHERE tag <> 'O' OR ('0x' || left(md5('{SEED}:' || doc_id || ':' || copy || ':' || pos), 8))::BIGINT / 4294967296 >= 0.1 GROUP BY ALL""",
    "j3_neighbours": """WITH p AS (SELECT q.vec_id AS query, v.vec_id AS neighbor, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbor) AS rank FROM p) SELECT query, rank, neighbor, round(score, 5) AS score FROM r WHERE rank <= 10""",
    "k1_scored_lines": f"SELECT conv_id, turn, len(l) = 0 AS safe, len(l) AS n FROM (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda t: lower(t)), lambda t: t IN ({_CANONS}))) AS l FROM conversations WHERE trim(text) <> '')",
    "k1_moderated_lines": _moderated("conversations", "conv_id * 1000 + turn", "text"),
    "k5_running_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "k7_flagged_rate": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (value > 50) AS flagged FROM events GROUP BY 1",
    "k3_bursts": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g""",
    "f11_batches": f"WITH n AS (SELECT page_id, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, {_NODES} AS l FROM pages)) SELECT page_id, (pos // 50)::INT AS batch, count(*) AS n FROM n GROUP BY ALL",
    "moderation_prf": f"""WITH {_LEX}, d AS (SELECT doc_id, toxic, regexp_replace(nfc_normalize(text), '(?i)(?:https?://|www\\.)\\S+', '', 'g') AS t FROM documents JOIN labels USING (doc_id)),
        c AS MATERIALIZED (SELECT doc_id, toxic, {_collapsed('t')} AS t FROM d),
        tok AS MATERIALIZED (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS l FROM c)),
        {_WORDS}, {_matched('exact', 'suffix')}, {_PHRASES},
        bad AS (SELECT doc_id FROM tok JOIN best ON lower(token) = word WHERE b.severity <> 'low' UNION SELECT doc_id FROM starts),
        v AS (SELECT toxic = 1 AS g, doc_id IN (SELECT doc_id FROM bad) AS p FROM c), s AS (SELECT {_sums('g', 'p')} FROM v) SELECT tp, fp, fn, tn, {_PRF} FROM s""",
}

#: The same in Spark's SQL.
SQL |= {"c15_sql_tokens": SQL["c15_tokens_by_script"], "l4_sql_verdicts": SQL["f3_verdicts"]}
