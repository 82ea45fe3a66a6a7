"""DuckDB SQL that returns the rows of the engine's queries; shared parts are written once as table expressions."""

from __future__ import annotations

from .fixtures import ROUTE_QUERIES, sample_rows
from .operators.routing import SEED

#: fixed values, written down here a second time so that a wrong one in the engine shows
TEXT_CUES = (
    "code|function|class|def|import|stack ?trace|exception|error|log|logs|json|yaml|regex|api|endpoint|sql|query|variable|"
    "syntax|command|cli|config|null|undefined|traceback"
)
VISION_CUES = (
    "chart|charts|graph|graphs|figure|figures|diagram|diagrams|table|tables|plot|plots|layout|screenshot|image|images|color|"
    "colou?red|axis|legend|infographic|map|maps|drawing|photo|picture|visual|appears|looks|shown"
)
MEDIA_WEIGHTS = {"table": 1.0, "svg": 1.0, "canvas": 1.0, "figure": 0.8, "img": 0.6, "picture": 0.6, "chart": 0.9, "math": 0.7}
STRONG_MEDIA = ("table", "svg", "canvas", "chart")
VISUAL_SNIPPET = "visual evidence (table/chart/figure) — enable an LLM/VLM reader to read its contents"
VISUAL_ANSWER = ("No extractable text matched this query, but relevant visual evidence was retrieved ", ". Enable an LLM/VLM reader to read the figures.")
NO_ANSWER = "No relevant results were found in the index."
PROMPT_HEAD = (
    "Answer the question using ONLY the numbered sources below. Cite every claim with its source number in square brackets, e"
    ".g. [1]. If the sources do not contain the answer, say so.\n\nQuestion: "
)


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\f\\x0B]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _sentences(x: str) -> str:
    """RE2 has no look-behind: a mark after each end, then a split at the marks."""
    return (
        f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(3), 'g'), chr(3)), "
        "lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
    )


_LINES = "list_filter(string_split_regex(text, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda s: regexp_matches(s, '[^\\s\\x1c-\\x1f\\x{85}\\x{a0}]'))"
_STRIPPED = "regexp_replace(s, '^\\s+|\\s+$', '', 'g')"
_TABULAR = (
    f"(length({_STRIPPED}) >= 4 AND ({_count(_STRIPPED, '[|]')} >= 2 OR {_count(_STRIPPED, '(?:^|[^\\pL\\pN_.])-?\\d[\\d,]*\\.?\\d*')} >= 3 "
    f"OR {_count('s', '\\S {2,}\\S')} >= 2))"
)


def _html_score(x: str) -> str:
    has = {t: f"regexp_matches({x}, '(?i)chart')" if t == "chart" else f"regexp_matches({x}, '(?i)<\\s*{t}\\b')" for t in MEDIA_WEIGHTS}
    heaviest = "greatest(" + ", ".join(f"CASE WHEN {has[t]} THEN {w} ELSE 0.0 END" for t, w in MEDIA_WEIGHTS.items()) + ")::DOUBLE"
    strong = " OR ".join(has[t] for t in STRONG_MEDIA)
    cells = _count(x, "(?i)<\\s*(?:tr|td|th|thead|tbody)\\b")
    return f"CASE WHEN {heaviest} > 0 THEN least(1.0::DOUBLE, (CASE WHEN {strong} THEN 0.55 ELSE 0.35 END)::DOUBLE + 0.3::DOUBLE * {heaviest} + 0.25::DOUBLE * (1 - exp(-{cells} / 12.0::DOUBLE))) ELSE 0.0 END"


_LAYOUT = f"""CASE WHEN len({_LINES}) = 0 THEN 0.0 ELSE least(1.0::DOUBLE,
  0.85::DOUBLE * least(1.0::DOUBLE, len(list_filter({_LINES}, lambda s: {_TABULAR}))::DOUBLE / len({_LINES}) * 2.5::DOUBLE)
  + 0.4::DOUBLE * least(1.0::DOUBLE, {_count("text", "\\p{Nd}")}::DOUBLE / greatest({_count("text", "[\\p{Nd}\\pL]")}, 1) * 3.0::DOUBLE)) END"""
_LIKE_HTML = lambda x: f"{_count(f'substr({x}, 1, 4000)', '<[a-zA-Z!/]')} >= 3"

_MEDIA = """CASE page_id % 4 WHEN 0 THEN html
  WHEN 1 THEN html || '<table>' || repeat('<tr><td>1</td></tr>', (page_id % 7)::INT) || '</table>'
  WHEN 2 THEN html || '<IMG src=a><figure></figure>' ELSE html || '<p>the Chart below</p>' END"""

#: the recurrence of soft-ended windows; s is the cleaned text, a the start of the next window
_CHUNKS = f"""
src AS (SELECT doc_id, {_clean("text")} AS s FROM documents),
pos(doc_id, s, a, e, ord) AS (
  SELECT doc_id, s, 0::BIGINT, NULL::BIGINT, -1::BIGINT FROM src WHERE s <> ''
  UNION ALL
  SELECT doc_id, s, CASE WHEN e2 >= length(s) THEN -1 ELSE greatest(e2 - 120, a + 1) END, e2, ord + 1
  FROM (SELECT doc_id, s, a, ord, CASE WHEN a + 800 >= length(s) THEN length(s)
      WHEN dot > 400 THEN a + dot + 2 WHEN line > 400 THEN a + line + 1 WHEN gap > 400 THEN a + gap + 1 ELSE a + 800 END AS e2
    FROM (SELECT *, length(w) - strpos(reverse(w), ' .') - 1 + CASE WHEN strpos(reverse(w), ' .') = 0 THEN -length(w) - 1 ELSE 0 END AS dot,
        length(w) - strpos(reverse(w), chr(10)) + CASE WHEN strpos(reverse(w), chr(10)) = 0 THEN -length(w) - 1 ELSE 0 END AS line,
        length(w) - strpos(reverse(w), ' ') + CASE WHEN strpos(reverse(w), ' ') = 0 THEN -length(w) - 1 ELSE 0 END AS gap
      FROM (SELECT *, substr(s, a + 1, 800) AS w FROM pos WHERE a >= 0)))),
begun AS (SELECT doc_id, s, e, ord, lag(a) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM pos),
chunks AS (
  SELECT doc_id, ord, text, substr(sha1(doc_id || ':' || ord || ':' || substr(text, 1, 32)), 1, 16) AS unit_id
  FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, text
    FROM (SELECT doc_id, ord, regexp_replace(substr(s, b + 1, e - b), '^\\s+|\\s+$', '', 'g') AS text FROM begun WHERE ord >= 0) WHERE text <> ''))"""


def _embedded(name: str, table: str, key: str, text: str = "text") -> str:
    """Table ``name``(key, v): unit mean of the token hashes, 32 numbers; units without tokens have zeros."""
    sums = ", ".join(f"sum(v[{i}])" for i in range(1, 33))
    return f"""
{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {table}),
{name}_h AS (SELECT t, list_transform(range(32), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT - 127.5::DOUBLE) AS v FROM (SELECT DISTINCT t, sha256(t) AS h FROM {name}_t)),
{name}_s AS (SELECT {key}, [{sums}] AS s FROM {name}_t JOIN {name}_h USING (t) GROUP BY {key}),
{name} AS (SELECT u.{key}, CASE WHEN s IS NULL THEN list_transform(range(32), lambda i: 0.0::DOUBLE)
  ELSE list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) END AS v FROM (SELECT DISTINCT {key} FROM {table}) u LEFT JOIN {name}_s USING ({key}))"""


_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({0}, lambda y: y::DOUBLE * y::DOUBLE))))"
_VISION = f"""
vision AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS unit_id, vec_id, vec_id % (SELECT count(*) FROM documents) AS doc_id, {_UNIT.format("embedding")} AS v FROM embeddings)"""


def _ranked(fetch: int, modes: str = "both") -> str:
    text = f"""
text_ranked AS (SELECT * FROM (SELECT q.item_id AS query_id, 'text' AS modality, c.doc_id, c.unit_id, score,
    row_number() OVER (PARTITION BY q.item_id ORDER BY round(score, 9) DESC, c.unit_id) - 1 AS rank
  FROM (SELECT a.item_id, b.unit_id, list_dot_product(a.v, b.v) AS score FROM qe a, ce b) q JOIN chunks c USING (unit_id)) WHERE rank < {fetch})"""
    vision = f"""
vision_ranked AS (SELECT * FROM (SELECT b.item_id AS query_id, 'vision' AS modality, x.doc_id, x.unit_id, list_dot_product(x.v, y.v) AS score,
    row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_dot_product(x.v, y.v), 9) DESC, x.unit_id) - 1 AS rank
  FROM benchmark b JOIN vision y ON y.vec_id = b.item_id, vision x) WHERE rank < {fetch})"""
    union = "SELECT * FROM text_ranked" if modes == "text" else "SELECT * FROM text_ranked UNION ALL SELECT * FROM vision_ranked"
    parts = [_CHUNKS, _embedded("ce", "chunks", "unit_id"), _embedded("qe", "benchmark", "item_id"), text] + ([] if modes == "text" else [_VISION, vision])
    return ",".join(parts) + f",\nranked AS ({union})"


#: words apart by two blanks, so that a word's guards are never shared
_APART = "'  ' || regexp_replace({0}, '[^\\pL\\pN_]', '  ', 'g') || '  '"


def _cues(x: str, words: str) -> str:
    return _count(_APART.format(x), f"(?i) (?:{words.replace('stack ?trace', 'stack(?:  )?trace')}) ")


_CODE = "regexp_matches({0}, '[{{}}();=]|->|=>|::|\\b0x[0-9a-fA-F]+\\b')::INT"


def _hits(table: str, query: str = "query") -> str:
    return f"hits AS (SELECT *, {_cues(query, TEXT_CUES)} AS tc, {_CODE.format(query)} AS code, {_cues(query, VISION_CUES)} AS vc FROM {table})"


_ROUTED = """
routed AS (SELECT *, CASE WHEN t > 0 AND vc = 0 THEN 1 + 0.5 * least(t, 3) WHEN vc > 0 AND t = 0 THEN 0.5 WHEN t > 0 AND vc > 0 THEN 1 + 0.25 * t ELSE 1 END::DOUBLE AS text_weight,
  CASE WHEN t > 0 AND vc = 0 THEN 0.3 WHEN vc > 0 AND t = 0 THEN 1 + 0.5 * least(vc, 3) WHEN t > 0 AND vc > 0 THEN 1 + 0.25 * vc ELSE 1 END::DOUBLE AS vision_weight,
  CASE WHEN t > 0 AND vc = 0 THEN 'text-leaning: ' || t || ' text cue(s)' WHEN vc > 0 AND t = 0 THEN 'vision-leaning: ' || vc || ' vision cue(s)'
    WHEN t > 0 AND vc > 0 THEN 'both: ' || t || ' text / ' || vc || ' vision cue(s)' ELSE 'balanced: no strong modality cue' END AS reason
  FROM (SELECT *, tc + code AS t FROM hits))"""
_QUOTED = ", ".join("({}, '{}')".format(1_000_000 + i, q.replace("'", "''")) for i, q in enumerate(ROUTE_QUERIES))
_ASKED = f"asked(query_id, query) AS (SELECT item_id, text FROM benchmark UNION ALL VALUES {_QUOTED})"
_WORDS = "list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')"
_FEATURES = f"""feats AS (SELECT query_id, 1.0::DOUBLE AS bias, least(tc, 4) / 4.0::DOUBLE AS text, least(vc, 4) / 4.0::DOUBLE AS vision, code::DOUBLE AS codeish,
  len(list_filter({_WORDS}, lambda w: regexp_matches(w, '\\p{{Nd}}')))::DOUBLE / greatest(len({_WORDS}), 1) AS numeric, least(greatest(len({_WORDS}), 1), 20) / 20.0::DOUBLE AS length FROM hits)"""

_PARTS = {
    "rrf": "w * 1.0 / (60 + rank)",
    "minmax": "w * CASE WHEN max(score) OVER m - min(score) OVER m <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m) END",
    "zscore": "w * CASE WHEN stddev_pop(score) OVER m <= 1e-12 THEN 0.5 ELSE 1 / (1 + exp(-(score - avg(score) OVER m) / stddev_pop(score) OVER m)) END",
    "softmax": "w * exp((score - max(score) OVER m) / 0.1::DOUBLE) / sum(exp((score - top) / 0.1::DOUBLE)) OVER m",
}


def _fused(how: str, top_k: int) -> str:
    """From ranked and weights(query_id, text_weight, vision_weight): fused(query_id, pos, doc_id, modality, unit_id, score, c_text, c_vision)."""
    best = "rank, mo, unit_id" if how == "rrf" else "-round(part, 9), mo, rank"
    return f"""
weighed AS (SELECT r.*, CASE WHEN modality = 'text' THEN text_weight ELSE vision_weight END AS w, CASE WHEN modality = 'text' THEN 0 ELSE 1 END AS mo,
  max(score) OVER (PARTITION BY query_id, modality) AS top FROM ranked r JOIN weights USING (query_id)),
parts AS (SELECT *, {_PARTS[how]} AS part FROM weighed WHERE w > 0 WINDOW m AS (PARTITION BY query_id, modality)),
lead_ AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {best}) AS k, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY mo, rank) AS f FROM parts),
grouped AS (SELECT query_id, doc_id, coalesce(sum(part) FILTER (mo = 0), 0) AS c_text, coalesce(sum(part) FILTER (mo = 1), 0) AS c_vision,
  max(modality) FILTER (k = 1) AS modality, max(unit_id) FILTER (k = 1) AS unit_id, max(mo * 1000000 + rank) FILTER (f = 1) AS seen FROM lead_ GROUP BY ALL),
fused AS (SELECT *, c_text + c_vision AS score FROM grouped),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen, doc_id) - 1 AS pos FROM fused) WHERE pos < {top_k})"""


_SHOWN = f"SELECT query_id, pos, doc_id, modality, unit_id, {_r('score')} AS score, {_r('c_text')} AS c_text, {_r('c_vision')} AS c_vision FROM placed"
_WEIGHTS = "weights AS (SELECT query_id, text_weight, vision_weight FROM routed)"


def _hybrid(how: str, depth: int) -> str:
    asked = "asked(query_id, query) AS (SELECT item_id, text FROM benchmark)"
    return f"WITH RECURSIVE {_ranked(3 * depth)}, {asked}, {_hits('asked')}, {_ROUTED}, {_WEIGHTS}, {_fused(how, depth)}"


def _bm25(name: str, queries: str, docs: str, key: str) -> str:
    """Table ``name``(query_id, key, bm25) for queries(query_id, query) and docs(query_id, key, text)."""
    return f"""
{name}_d AS (SELECT query_id, {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS tok FROM {docs}),
{name}_c AS (SELECT query_id, count(*) AS n, avg(len(tok)) AS mean FROM {name}_d GROUP BY query_id),
{name}_q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {queries}),
{name}_f AS (SELECT d.query_id, d.{key}, d.len, d.term, count(*) AS tf FROM (SELECT query_id, {key}, len(tok) AS len, unnest(tok) AS term FROM {name}_d) d
  JOIN {name}_q USING (query_id, term) GROUP BY ALL),
{name}_w AS (SELECT *, count(*) OVER (PARTITION BY query_id, term) AS df FROM {name}_f),
{name}_s AS (SELECT w.query_id, w.{key}, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / CASE WHEN mean > 0 THEN mean ELSE 1 END))) AS bm25
  FROM {name}_w w JOIN {name}_c USING (query_id) GROUP BY ALL),
{name} AS (SELECT query_id, {key}, coalesce(bm25, 0) AS bm25 FROM {name}_d LEFT JOIN {name}_s USING (query_id, {key}))"""


def _blend(source: str, scores: str, top_k: int, k: str = "doc_id", weight: float = 0.5) -> str:
    """From ``source``(query_id, pos, doc_id, score, text, ...) and ``scores``: blended with new pos and c_rerank."""
    scale = lambda c: f"CASE WHEN max({c}) OVER q - min({c}) OVER q < 1e-12 THEN 0.0 ELSE ({c} - min({c}) OVER q) / (max({c}) OVER q - min({c}) OVER q) END"
    return f"""
scaled AS (SELECT f.*, {scale("coalesce(bm25, 0)")} AS rr, {scale("score")} AS fn FROM {source} f LEFT JOIN {scores} USING (query_id, {k}) WINDOW q AS (PARTITION BY query_id)),
mixed AS (SELECT * EXCLUDE (score), CASE WHEN trim(coalesce(text, '')) = '' THEN fn ELSE rr END AS rr2, {weight}::DOUBLE * (CASE WHEN trim(coalesce(text, '')) = '' THEN fn ELSE rr END) + (1 - {weight}::DOUBLE) * fn AS score FROM scaled),
blended AS (SELECT * FROM (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) - 1 AS pos FROM mixed) WHERE pos < {top_k})"""


def _found(how: str, depth: int) -> str:
    """q(query_id, query) and cand: the fused hits of the search over all units, with what they hold; tiles show their title where they have one."""
    return f"""{_hybrid(how, depth)},
q AS (SELECT query_id, query FROM asked),
cand AS (SELECT query_id, pos, p.doc_id, unit_id, modality, score, coalesce(CASE WHEN tile % 7 = 0 THEN 'the figure of document ' || p.doc_id ELSE c.text END, '') AS text,
  coalesce(tile % 3, 0) AS page, '/tiles/' || tile || '.png' AS image_path
  FROM (SELECT *, CASE WHEN modality = 'vision' THEN try_cast(substr(unit_id, 2) AS INT) END AS tile FROM placed) p LEFT JOIN (SELECT DISTINCT unit_id, text FROM chunks) c USING (unit_id))"""


_POOL = f"""{_found("rrf", 5)},
ahits AS (SELECT * RENAME (pos AS rank) FROM cand),
sents AS (SELECT *, {_sentences("text")} AS parts FROM ahits),
spread AS (SELECT query_id, rank, doc_id, unit_id, modality, image_path, len(parts) AS n, unnest(parts) AS sent, unnest(range(len(parts))) AS place_ FROM sents),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, place_) - 1 AS idx FROM spread WHERE length(sent) >= 20 OR n = 1)"""
_CHOSEN = f"""{_POOL}, ptext AS (SELECT query_id, idx, sent AS text FROM pool), {_bm25("ps", "q", "ptext", "idx")},
scored AS (SELECT p.*, s.bm25 AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s.bm25, 9) DESC, rank, idx) AS rn, max(s.bm25) OVER (PARTITION BY query_id) AS best
  FROM pool p JOIN ps s USING (query_id, idx)),
fit AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(sent) ORDER BY rn) AS k FROM scored WHERE rn = 1 OR (score > 0 AND round(score, 9) >= round(0.15::DOUBLE * best, 9))),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS n_chosen FROM fit WHERE k = 1) WHERE n_chosen <= 3),
firsts AS (SELECT query_id, sent, min(idx) AS first_idx FROM pool GROUP BY ALL),
read AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY rank, first_idx, idx) AS place FROM chosen c JOIN firsts USING (query_id, sent)),
opened AS (SELECT *, min(place) OVER (PARTITION BY query_id, doc_id, unit_id) AS opens FROM read),
marked AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY opens) AS marker FROM opened),
seen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, unit_id) AS v FROM ahits WHERE text = '')"""

_MANIFEST = """
m AS (SELECT page_id::VARCHAR AS doc_id, page_id, CASE WHEN page_id % 3 = 0 THEN 'own text of page ' || page_id || '. a | b | c' END AS own, html,
  CASE WHEN page_id % 4 = 0 THEN 'mine' WHEN page_id % 2 = 0 THEN 'title ' || page_id ELSE '' END AS title FROM pages)"""


#: the parser's result by expressions: heads, scripts, styles and comments go, block tags begin lines, other tags leave a mark between texts
def _html_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<!DOCTYPE[^>]*>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<head\\b.*?(</head\\s*>|$)', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<(script|style|noscript)\\b.*?</(script|style|noscript)\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?is)<(p|br|div|li|tr|h[1-6])(\\s[^>]*)?/?>', chr(1) || chr(10) || chr(1), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*(>|$)', chr(1), 'g')"
    x = f"array_to_string(list_filter(string_split({x}, chr(1)), lambda s: s = chr(10) OR regexp_matches(s, '\\S')), '')"
    for name, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{name}', '{char}', 'g')"
    return _clean(x)


_JUDGED = f"""{_VISION},
e AS (SELECT vec_id, vec_id // 5 % 29 AS doc_id, label FROM embeddings),
ranked AS (SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id // 5 % 29 AS doc_id, b.unit_id, list_dot_product(a.v, b.v) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.unit_id) - 1 AS rank FROM vision a, vision b WHERE a.vec_id % 20 = 0) WHERE rank < 10),
qr AS (SELECT DISTINCT a.vec_id AS query_id, b.doc_id, b.doc_id % 3 + 0.0 AS gain FROM e a JOIN e b USING (label) WHERE a.vec_id % 20 = 0 AND b.vec_id % 4 = 1),
good AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM qr WHERE gain > 0)"""


def _measured(ranked: str, extra: str = "") -> str:
    """measured(<extra,> query_id, k, ...) of ``ranked``."""
    lead = f"{extra}, " if extra else ""
    using = f"({lead}query_id)"
    every = f"(SELECT DISTINCT {extra} FROM {ranked}) m, (SELECT vec_id AS query_id FROM e WHERE vec_id % 20 = 0) q" if extra else "(SELECT vec_id AS query_id FROM e WHERE vec_id % 20 = 0) q"
    return f"""
closed AS (SELECT *, row_number() OVER (PARTITION BY {lead}query_id ORDER BY rank) AS i FROM (SELECT {lead}query_id, doc_id, min(rank) AS rank FROM {ranked} GROUP BY ALL)),
raw AS (SELECT {lead}query_id, min(rank) AS raw_first FROM {ranked} JOIN (SELECT query_id, doc_id FROM good) USING (query_id, doc_id) GROUP BY ALL),
found AS (SELECT c.*, g.gain FROM closed c JOIN (SELECT query_id, doc_id, gain FROM good) g USING (query_id, doc_id)),
f AS (SELECT {lead}query_id, k, count(*) FILTER (i <= k) AS n, coalesce(sum(gain / log2(i + 1)) FILTER (i <= k), 0) AS d, min(i) AS first FROM found, (VALUES (1), (5), (10)) ks(k) GROUP BY ALL),
g AS (SELECT query_id, k, count(*) AS relevant, sum(gain / log2(i + 1)) FILTER (i <= k) AS ideal FROM good, (VALUES (1), (5), (10)) ks(k) GROUP BY ALL),
every AS (SELECT {lead}query_id, k FROM {every}, (VALUES (1), (5), (10)) ks(k)),
measured AS (SELECT {lead}query_id, k, coalesce((raw_first < k)::INT, 0)::DOUBLE AS hit, coalesce(n::DOUBLE / relevant, 0) AS recall, coalesce(n::DOUBLE / k, 0) AS precision,
  coalesce(1.0 / first, 0)::DOUBLE AS rr, coalesce(d / ideal, 0) AS ndcg FROM every LEFT JOIN raw USING ({lead}query_id) LEFT JOIN f USING ({lead}query_id, k) LEFT JOIN g USING (query_id, k))"""


def _tiles(scope: bool) -> str:
    by = "content_key, doc_id" if scope else "content_key"
    return f"""WITH t AS (SELECT doc_id AS unit_id, source AS doc_id, coalesce('sha256:' || sha256(text), 'id:' || sha256(doc_id::VARCHAR)) AS content_key FROM documents)
SELECT min(unit_id) AS unit_id, arg_min(doc_id, unit_id) AS doc_id, content_key, count(*) AS duplicate_count,
  CASE WHEN count(*) > 1 THEN string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) ELSE '' END AS members FROM t GROUP BY {by}"""


_RANKED_TIES = """
r AS (SELECT vec_id % 20 AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'vision' ELSE 'text' END AS modality, vec_id * 5 % 23 AS doc_id, vec_id AS unit_id,
  CASE WHEN vec_id % 20 = 3 THEN 0.5 ELSE vec_id * 37 % 11 / 10.0 END::DOUBLE AS score FROM embeddings),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, unit_id) - 1 AS rank FROM r),
weights AS (SELECT query_id, (query_id % 4 / 2.0)::DOUBLE AS text_weight, 1.5::DOUBLE AS vision_weight FROM (SELECT DISTINCT vec_id % 20 AS query_id FROM embeddings))"""

_COUNTS = f"""WITH RECURSIVE {_CHUNKS}, v AS (SELECT vec_id % (SELECT count(*) FROM documents) AS doc_id, vec_id % 3 AS page FROM embeddings),
n AS (SELECT (SELECT count(*) FROM chunks) AS t, (SELECT count(*) FROM v) AS v, (SELECT count(*) FROM (SELECT DISTINCT doc_id, page FROM v)) AS p)"""


def _values(rows) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def _fit_sql() -> str:
    """fitted(w): 4,000 steps of gradient descent from zero on the seed questions, the bias without decay."""
    seed = _values((i, q, float(y)) for i, (q, y) in enumerate(SEED))
    own = _FEATURES.replace("feats AS", "seed_feats AS").replace("FROM hits", "FROM seed_hits")
    hits = _hits("seed").replace("hits AS", "seed_hits AS", 1)
    p = "1 / (1 + exp(-greatest(-30, least(30, list_dot_product(r.x, w)))))"
    return f"""seed(query_id, query, y) AS (VALUES {seed}), {hits}, {own},
seen_(rows_) AS (SELECT list(struct_pack(x := [bias, text, vision, codeish, "numeric", length], y := y)) FROM seed_feats JOIN seed USING (query_id)),
steps(step, w) AS (SELECT 0, list_transform(range(6), lambda i: 0.0::DOUBLE) UNION ALL
  SELECT step + 1, list_transform(range(6), lambda j: w[j + 1] - 0.5::DOUBLE * (list_sum(list_transform(rows_, lambda r: ({p} - r.y) * r.x[j + 1])) / {len(SEED)}
    + CASE WHEN j = 0 THEN 0.0 ELSE 0.001::DOUBLE * w[j + 1] END)) FROM steps, seen_ WHERE step < 4000),
fitted AS (SELECT w FROM steps WHERE step = 4000)"""


def _sample_sql() -> str:
    """The own evaluation set: every document is one chunk, every question has one relevant document, nothing visual is indexed."""
    docs = _values((d, t) for d, t, _ in sample_rows())
    asked = _values((i, q, d) for i, (d, _, q) in enumerate(sample_rows()))
    return f"""WITH sdocs(doc_id, text) AS (VALUES {docs}), sasked(query_id, text, wanted) AS (VALUES {asked}), {_embedded("de", "sdocs", "doc_id")}, {_embedded("qe", "sasked", "query_id")},
srank AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, substr(sha1(doc_id || ':0:' || substr(text, 1, 32)), 1, 16)) AS i FROM qe a, de b JOIN sdocs USING (doc_id)),
own AS (SELECT i FROM srank JOIN sasked USING (query_id) WHERE doc_id = wanted),
ks(k) AS (VALUES (1::BIGINT), (3), (5), (10)),
found AS (SELECT k, avg((i <= k)::INT) AS hit, avg((i <= k)::INT / k::DOUBLE) AS precision, avg(CASE WHEN i <= 10 THEN 1.0::DOUBLE / i ELSE 0 END) AS mrr, avg(CASE WHEN i <= k THEN 1.0::DOUBLE / log2(i + 1) ELSE 0 END) AS ndcg FROM own, ks GROUP BY k)
SELECT mode, k, {_r("hit")} AS hit, {_r("hit")} AS recall, {_r("precision")} AS precision, {_r("mrr")} AS mrr, {_r("ndcg")} AS ndcg, '' AS note FROM found, (VALUES ('text'), ('hybrid')) m(mode)
UNION ALL SELECT 'vision', k, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'skipped: nothing indexed' FROM ks"""


def oracle_sql() -> dict[str, str]:
    out = {
        "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
        "tokenize": "SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)",
        "sentences": f"SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS sent FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)",
        "looks_like_html": f"SELECT page_id, {_LIKE_HTML('html')} AS page_like, {_LIKE_HTML("regexp_replace(html, '<[a-z/]', '', 'g')")} AS bare_like FROM pages",
        "tabular_lines": f"SELECT doc_id, len({_LINES}) AS n_lines, len(list_filter({_LINES}, lambda s: {_TABULAR})) AS n_tabular FROM documents",
        "html_to_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
        "html_richness": f"SELECT page_id, {_r(_html_score('html'))} AS score FROM (SELECT page_id, {_MEDIA} AS html FROM pages)",
        "text_richness": f"SELECT doc_id, {_r(f'greatest(CASE WHEN {_LIKE_HTML("text")} THEN {_html_score("text")} ELSE 0.0 END, {_LAYOUT})')} AS score FROM documents",
        "pixel_decision": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN {_html_text('html')} ELSE '' END AS text, CASE WHEN page_id % 2 <> 0 THEN {_MEDIA} ELSE '' END AS html,
  CASE WHEN page_id % 3 = 0 THEN (page_id % 10 / 10.0)::DOUBLE END AS img FROM pages),
s AS (SELECT page_id, img, text <> '' OR html <> '' AS have, greatest(CASE WHEN html <> '' THEN {_html_score('html')} WHEN {_LIKE_HTML('text')} THEN {_html_score('text')} ELSE 0.0 END, {_LAYOUT}) AS t FROM p),
d AS (SELECT page_id, CASE WHEN img IS NULL THEN CASE WHEN have THEN t ELSE 1.0 END WHEN have THEN greatest(img, 0.7::DOUBLE * t, 0.6::DOUBLE * img + 0.4::DOUBLE * t) ELSE img END AS richness FROM s)
SELECT page_id, {_r('richness')} AS richness, richness >= 0.35 AS index_pixels FROM d""",
        "chunk_text": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, ord, text FROM chunks",
        "chunk_ids": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, ord, unit_id FROM chunks",
        "tile_geometry": """SELECT p_partkey || '_p0_t' || row AS unit_id, p_partkey AS doc_id, row, 0::BIGINT AS x0, row * 448 AS y0, 1280::BIGINT AS x1, least(row * 448 + 512, h) AS y1
FROM (SELECT p_partkey, p_partkey % 37 * 97 + 1 AS h FROM part), range(10) r(row) WHERE row = 0 OR (row * 448 < h AND (row - 1) * 448 + 512 < h)""",
        "tiles_from_paths": r"""WITH p AS (SELECT '/scans/doc_p' || p_partkey % 7 || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_p' || p_partkey || '_t1' END || '.png' AS image_path FROM part),
s AS (SELECT image_path, replace(regexp_extract(image_path, '[^/]*$'), '.png', '') AS stem FROM p)
SELECT stem AS unit_id, coalesce(nullif(regexp_extract(stem, '^(.+)_p', 1), ''), stem) AS doc_id, image_path FROM s""",
        "dedup_exact": _tiles(True),
        "dedup_global": _tiles(False),
        "dedup_stats": """SELECT sum(n)::BIGINT AS input_tiles, count(*) AS unique_tiles, sum(n - 1)::BIGINT AS duplicate_tiles, count(*) FILTER (n > 1) AS groups,
  (sum(n - 1) * 200000)::BIGINT AS bytes_saved, round(sum(n - 1) / sum(n), 4)::DOUBLE AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY text)""",
        "rank_dedup": """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r, doc_id) - 1 AS rank
FROM (SELECT vec_id % 20 AS query_id, vec_id * 7 % 13 AS doc_id, min(vec_id // 20) AS r FROM embeddings GROUP BY ALL)""",
        "hash_vector": """SELECT lower(n_name) AS token, i, ('0x' || substr(sha256(lower(n_name)), (2 * (i % 32) + 1)::INT, 2))::INT - 127.5::DOUBLE AS value FROM nation, range(40) r(i)""",
        "hash_embed": f"WITH {_embedded('e', 'documents', 'doc_id')} SELECT doc_id, i, {_r('v[(i + 1)::INT]')} AS value FROM e, range(32) r(i)",
        "l2_normalize": f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 5)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n FROM x)
SELECT vec_id, i, {_r('CASE WHEN n > 0 THEN v[(i + 1)::INT] / n ELSE v[(i + 1)::INT] END')} AS value FROM n, range(64) r(i)""",
        "vector_topk": f"""WITH {_VISION} SELECT query_id, rank, unit_id, doc_id, {_r('score')} AS score FROM (SELECT a.vec_id AS query_id, b.unit_id, b.doc_id, list_dot_product(a.v, b.v) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.unit_id) - 1 AS rank FROM vision a, vision b WHERE a.vec_id % 20 = 0) WHERE rank < 10""",
        "search_text_only": f"WITH RECURSIVE {_ranked(30, 'text')}, weights AS (SELECT item_id AS query_id, 1.0::DOUBLE AS text_weight, 0.0::DOUBLE AS vision_weight FROM benchmark), {_fused('rrf', 10)} {_SHOWN}",
        "hybrid_search_rrf": f"{_hybrid('rrf', 10)} {_SHOWN}",
        "hybrid_search_calibrated": f"{_hybrid('softmax', 10)} {_SHOWN}",
        "hybrid_search_rerank": f"""{_hybrid('rrf', 30)}, full_ AS (SELECT p.*, CASE WHEN p.modality = 'text' THEN c.text WHEN substr(p.unit_id, 2)::INT % 7 = 0 THEN 'the figure of document ' || p.doc_id END AS text FROM placed p LEFT JOIN (SELECT DISTINCT unit_id, text FROM chunks) c USING (unit_id)),
ftext AS (SELECT query_id, doc_id, coalesce(text, '') AS text FROM full_), {_bm25('fs', 'asked', 'ftext', 'doc_id')}, {_blend('full_', 'fs', 10)}
SELECT query_id, pos, doc_id, modality, unit_id, {_r('score')} AS score, {_r('c_text')} AS c_text, {_r('c_vision')} AS c_vision, {_r('round(rr2, 6)')} AS c_rerank FROM blended""",
        "result_rows": f"""{_hybrid('rrf', 3)} SELECT query_id, pos, '{{"doc_id":' || doc_id || ',"modality":"' || modality || '","unit_id":"' || unit_id || '","page":' ||
  CASE WHEN modality = 'text' THEN 0 ELSE substr(unit_id, 2)::INT % 3 END || '}}' AS row, {_r('score')} AS score FROM placed""",
        "route_features": f"WITH {_ASKED}, {_hits('asked')}, {_FEATURES} SELECT query_id, {', '.join(f'{_r(f)} AS {f}' for f in ('bias', 'text', 'vision', 'codeish', 'numeric', 'length'))} FROM feats",
        "route_heuristic": f"WITH {_ASKED}, {_hits('asked')}, {_ROUTED} SELECT query_id, {_r('text_weight')} AS text_weight, {_r('vision_weight')} AS vision_weight, reason FROM routed",
        "route_learned": f"""WITH RECURSIVE {_fit_sql()}, {_ASKED}, {_hits('asked')}, {_FEATURES},
p AS (SELECT query_id, 1 / (1 + exp(-list_dot_product([bias, text, vision, codeish, "numeric", length], (SELECT list_transform(w, lambda x: round(x, 6)) FROM fitted)))) AS p FROM feats)
SELECT query_id, {_r('p')} AS p, {_r('1 - 0.7::DOUBLE * (2 * p - 1)')} AS text_weight, {_r('1 + 0.7::DOUBLE * (2 * p - 1)')} AS vision_weight FROM p""",
        "bm25_rerank": f"{_found('rrf', 30)}, {_bm25('s', 'q', 'cand', 'doc_id')} SELECT query_id, doc_id, {_r('bm25')} AS bm25 FROM s",
        "rerank_blend": f"""{_found('minmax', 30)}, {_bm25('s', 'q', 'cand', 'doc_id')}, {_blend('cand', 's', 10, weight=0.8)}
SELECT query_id, pos, doc_id, {_r('score')} AS score, {_r('round(rr2, 6)')} AS c_rerank FROM blended""",
        "answer_pool": f"{_POOL} SELECT query_id, idx, doc_id, sent FROM pool",
        "answer_bm25": f"{_CHOSEN} SELECT query_id, idx, {_r('score')} AS score FROM scored",
        "answer_select": f"{_CHOSEN} SELECT query_id, n_chosen AS n, idx, sent FROM chosen",
        "answer_text": f"""{_CHOSEN}, said AS (SELECT query_id, string_agg(sent || ' [' || marker || ']', ' ' ORDER BY place) AS said FROM marked GROUP BY query_id),
sv AS (SELECT query_id, string_agg('[' || v || ']', ' ' ORDER BY v) AS marks FROM seen GROUP BY query_id)
SELECT query_id, coalesce(said, '{VISUAL_ANSWER[0]}' || marks || '{VISUAL_ANSWER[1]}', '{NO_ANSWER}') AS answer FROM q LEFT JOIN said USING (query_id) LEFT JOIN sv USING (query_id)""",
        "answer_citations": f"""{_CHOSEN}, cited AS (SELECT query_id, marker, doc_id, unit_id, modality, substr(sent, 1, 200) AS snippet, coalesce(image_path, '') AS image_path FROM marked WHERE place = opens),
n AS (SELECT query_id, max(marker) AS c FROM cited GROUP BY query_id)
SELECT * FROM cited UNION ALL SELECT query_id, coalesce(c, 0) + v, doc_id, unit_id, modality, '{VISUAL_SNIPPET}', coalesce(image_path, '') FROM seen LEFT JOIN n USING (query_id)
WHERE c IS NULL OR v <= greatest(0, 4 - c)""",
        "llm_prompt": f"""{_POOL}, b AS (SELECT query_id, rank, '[' || (rank + 1) || '] (doc=' || doc_id || ', page=' || page || ', ' || modality || ')' || chr(10) ||
  CASE WHEN text <> '' THEN substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 800) ELSE '[image tile, page ' || page || ' — see attached image ' || (rank + 1) || ']' END AS b, image_path FROM ahits)
SELECT query_id, '{PROMPT_HEAD}' || any_value(query) || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer:' AS prompt,
  coalesce(string_agg(image_path, ',' ORDER BY rank), '') AS images FROM q JOIN b USING (query_id) GROUP BY query_id""",
        "index_build": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS units, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY doc_id",
        "index_tiles": "SELECT vec_id % (SELECT count(*) FROM documents) AS doc_id, count(*) AS tiles, count(DISTINCT vec_id % 3) AS pages FROM embeddings GROUP BY 1",
        "index_stats": f"{_COUNTS} SELECT t AS text_units, v AS vision_units, p AS pages, 0::BIGINT AS tiles_folded, (SELECT count(*) FROM (SELECT doc_id FROM chunks UNION SELECT doc_id FROM v)) AS documents FROM n",
        "index_footprint": f"{_COUNTS} SELECT t * 384 * 4 AS text_bytes, v * 512 * 4 AS vision_bytes FROM n",
        "doc_ids": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id FROM chunks UNION SELECT vec_id % (SELECT count(*) FROM documents) FROM embeddings",
        "delete_docs": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "upsert_docs": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN reverse(text) ELSE text END AS text FROM documents",
        "qrels_normalize": """SELECT vec_id AS query_id, 'd' || vec_id AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 2.5 END::DOUBLE AS gain FROM embeddings
UNION ALL SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'x' ELSE 'y' END, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE FROM embeddings""",
        "distinct_pages": f"{_COUNTS} SELECT p AS pages FROM n",
        "cost_estimate": f"""{_COUNTS}, c AS (SELECT 'text' AS mode, t * 384 * 4 AS vb, t * 1024 AS ab, t / 1000.0::DOUBLE * 0.0001::DOUBLE AS iu, 0.000002::DOUBLE AS qu FROM n
  UNION ALL SELECT 'vision', v * 512 * 4, p * 307200 + v * 81920, v / 1000.0::DOUBLE * 0.02::DOUBLE + p * 0.0003::DOUBLE, 0.0004::DOUBLE FROM n),
a AS (SELECT * FROM c UNION ALL SELECT 'hybrid', sum(vb)::BIGINT, sum(ab)::BIGINT, sum(iu), sum(qu) FROM c)
SELECT mode, vb AS vector_bytes, ab AS artifact_bytes, {_r('iu', 10)} AS index_usd, {_r('qu', 10)} AS query_usd, vb + ab AS storage_bytes, {_r('(vb + ab) / 1073741824.0::DOUBLE * 0.023::DOUBLE', 10)} AS storage_usd_month FROM a""",
        "cost_project": """SELECT pages, mode, b AS bytes_per_page, b * pages AS total_bytes, round(b * pages / 1099511627776.0::DOUBLE, 4) AS total_tb, round(b * pages / 1073741824.0::DOUBLE * 0.023::DOUBLE, 2) AS storage_usd_month
FROM (VALUES (1::BIGINT), (1000000), (10000000)) p(pages), (VALUES ('text', 7680::BIGINT), ('vision', 643072), ('hybrid', 650752)) m(mode, b)""",
        "human_bytes": """SELECT n, CASE WHEN n < 1024 THEN n || ' B' ELSE format('{:.1f} ', n / 1024.0::DOUBLE ** p) || ['KB', 'MB', 'GB', 'TB', 'PB'][p] END AS shown
FROM (SELECT n, least(5, floor(log2(n) / 10))::INT AS p FROM (SELECT pow(5, n_nationkey)::BIGINT AS n FROM nation))""",
        "event_windows": f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, {_r('sum(value)', 4)} AS value FROM events GROUP BY 1, 2""",
        "eval_report": f"""WITH {_JUDGED}, both_ AS (SELECT 'vision' AS mode, * FROM ranked UNION ALL SELECT 'half', * FROM ranked WHERE rank % 2 = 0), {_measured('both_', 'mode')}
SELECT mode, k::BIGINT AS k, {_r('avg(hit)')} AS hit, {_r('avg(recall)')} AS recall, {_r('avg(precision)')} AS precision, {_r('avg(rr)')} AS mrr, {_r('avg(ndcg)')} AS ndcg FROM measured GROUP BY ALL""",
        "route_train": f"WITH RECURSIVE {_fit_sql()} SELECT unnest(['bias', 'text', 'vision', 'codeish', 'numeric', 'length']) AS feature, unnest(list_transform(w, lambda x: round(x, 6))) AS weight FROM fitted",
        "manifest_scan": "SELECT * FROM (VALUES ('a', 'A', 0::BIGINT, 0::BIGINT), ('b', '', 3, 2), ('c', '', 0, 1)) t(doc_id, title, page, images)",
        "scan_tiles": """SELECT * FROM (VALUES ('a_p0_t0', 'a', 'a_p0_t0.png'), ('a_p1_t0', 'a', 'a_p1_t0.png'), ('b_p0_t0', 'b', 'b_p0_t0.png'), ('b_p0_t1', 'b', 'b_p0_t1.png'),
  ('report_p2_p3_t1', 'report_p2', 'report_p2_p3_t1.png'), ('c_p0_t0', 'c', 'c_p0_t0.PNG')) t(unit_id, doc_id, image_path)""",
        # by hand: ten of 120 rows are dark; 3,000 of 9,600 pixels are coloured, over more than 0.6 of 60 rows, with gray levels between 0.25 and 0.75; one gray; a board of black and white
        "image_richness": """SELECT file, score::DOUBLE AS score, lines::DOUBLE AS lines, color::DOUBLE AS color, midtone::DOUBLE AS midtone FROM (VALUES ('a_p0_t0.png', 0, 0, 0, 0), ('a_p1_t0.png', 0.45, 1, 0, 0),
  ('b_p0_t0.png', 1, 1, 1, 0.9375), ('b_p0_t1.png', 0.25, 0, 0, 1), ('report_p2_p3_t1.png', 0, 0, 0, 0), ('c_p0_t0.PNG', 0, 0, 0, 0)) t(file, score, lines, color, midtone)""",
        # by hand: boxes with two of the ten dark rows are darker than the mean; boxes 1 to 5 either way touch the coloured part
        "dedup_ahash": """SELECT * FROM (VALUES ('a_p0_t0.png', 'ffffffffffffffff'), ('a_p1_t0.png', '00ffffff00ffffff'), ('b_p0_t0.png', 'ff8383838383ffff'), ('b_p0_t1.png', 'ffffffffffffffff'),
  ('report_p2_p3_t1.png', '55aa55aa55aa55aa'), ('c_p0_t0.PNG', 'ffffffffffffffff')) t(file, ahash)""",
        "eval_sample": _sample_sql(),
    }
    pieces = f"""WITH RECURSIVE {_MANIFEST}, documents AS (SELECT doc_id, coalesce(own, {_html_text('html')}) AS text, page_id FROM m), {_CHUNKS},
v AS (SELECT page_id, {_html_text('html')} AS text FROM pages),
rich AS (SELECT page_id FROM v WHERE greatest(CASE WHEN {_LIKE_HTML("text")} THEN {_html_score("text")} ELSE 0.0 END, {_LAYOUT}) >= 0.35),
tiles AS (SELECT doc_id, unnest(['/a.png', '/' || doc_id || '.png']) AS image_path, page_id FROM m WHERE page_id % 5 = 0 OR own IS NOT NULL OR page_id IN (SELECT page_id FROM rich))"""
    out["ingest_prepare"] = f"""{pieces} SELECT c.doc_id, c.ord, m.title, c.text, CASE WHEN t.doc_id IS NULL THEN '' ELSE c.doc_id || '_p0_t0=/a.png,' || c.doc_id || '_p0_t1=/' || c.doc_id || '.png' END AS tiles
FROM chunks c JOIN m ON m.doc_id = c.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM tiles) t ON t.doc_id = c.doc_id"""
    out["ingest_batch"] = f"""{pieces} SELECT doc_id, image_path, duplicate_count FROM (SELECT arg_min(doc_id, page_id) AS doc_id, image_path, count(*) AS duplicate_count FROM tiles GROUP BY image_path)
UNION ALL SELECT doc_id, 'text', count(*) FROM chunks GROUP BY doc_id"""
    out["ingest_stats"] = f"""{pieces} SELECT (SELECT count(*) FROM m) AS documents, (SELECT count(*) FROM m WHERE own IS NOT NULL) AS text_docs, (SELECT count(*) FROM m WHERE own IS NULL) AS html_docs,
  (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM tiles) AS tiles, (SELECT count(DISTINCT doc_id) FROM tiles) AS docs_with_pixels, (SELECT count(*) FROM m) - (SELECT count(DISTINCT doc_id) FROM tiles) AS vision_skipped"""
    out["stream_ingest"] = f"{pieces} SELECT doc_id, count(*) AS units FROM chunks GROUP BY doc_id"
    # a vector of 384 numbers repeats one of 32 twelve times
    out["index_roundtrip"] = f"""{pieces}, {_embedded("ce", "chunks", "unit_id")}, nt AS (SELECT doc_id, count(*) AS tiles FROM tiles GROUP BY doc_id)
SELECT c.doc_id, count(*) AS units, {_r("sum(v[1] / sqrt(12::DOUBLE))")} AS first, coalesce(any_value(nt.tiles), 0) AS tiles FROM chunks c JOIN ce USING (unit_id) LEFT JOIN nt ON nt.doc_id = c.doc_id GROUP BY c.doc_id"""
    out |= {f"fuse_{n}": f"WITH {_RANKED_TIES}, {_fused(n, 10)} {_SHOWN}" for n in _PARTS}
    out |= {f"eval_{n}": f"WITH {_JUDGED}, {_measured('ranked')} SELECT query_id, k::BIGINT AS k, {_r(c)} AS {c} FROM measured" for n, c in (("hit", "hit"), ("recall", "recall"), ("precision", "precision"), ("mrr", "rr"), ("ndcg", "ndcg"))}
    return out
