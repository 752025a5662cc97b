"""The same results in plain SQL, for engines with RE2 patterns: what the queries are held against."""

from __future__ import annotations

import itertools

from .functions.patterns import BARE_STAMP, BIRTH_CONTEXT, DETECTORS, INSTITUTION, PLACEHOLDERS, TAJ_BEFORE, plain
from .functions.text import VOWEL_GROUPS
from .operators.detect import LEAST, WEIGHTS
from .operators.ner import CHUNK, NEAR, SHIFT, STRIDE
from .plans.notes import TEXTS_SQL


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def total(pieces: str) -> str:
    return f"coalesce(list_sum(list_transform({pieces}, lambda z: length(z))), 0)"


def matches(src: str, pattern: str, where: str = "whole") -> str:
    """doc_id, text, s (its start), e, found: every match in the rows of src (doc_id, text)."""
    p = quote(plain(pattern))
    g = "0" if where == "whole" else "1"
    tail = r"'(\s*.)$'"
    ends = {"whole": ("b", "b + length(m)"), "tail": ("b + length(m) - length(g)", "b + length(m)"), "head": ("b", "b + length(g)"), "middle": (f"b + length(m) - length(regexp_extract(m, {tail}, 1)) - length(g)", f"b + length(m) - length(regexp_extract(m, {tail}, 1))")}[where]
    return f"""SELECT doc_id, text, cast({ends[0]} AS int) AS s, cast({ends[1]} AS int) AS e, g AS found, i FROM (
      SELECT doc_id, text, i, ms[i] AS m, gr[i] AS g, {total("gs[1:i]")} + {total("ms[1:i-1]")} AS b FROM (
        SELECT doc_id, text, ms, gr, gs, unnest(generate_series(1, len(ms))) AS i FROM (
          SELECT doc_id, text, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {g}) AS gr, string_split_regex(text, {p}) AS gs FROM ({src}) WHERE text IS NOT NULL) WHERE len(ms) > 0))"""


def context(n: int, pattern: str) -> str:
    return f"regexp_matches(substr(text, greatest(s - {n}, 0) + 1, least({n}, s)), {quote(plain(pattern))})"


DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
CHECKSUM = "(" + " + ".join(f"{w} * cast(substr({DIGITS}, {i + 1}, 1) AS int)" for i, w in enumerate(WEIGHTS)) + f") % 10 = cast(substr({DIGITS}, 9, 1) AS int)"
LINE = r"regexp_extract(substr(text, 1, s), '[^\n]*$')"
BIRTH = f"(regexp_matches({LINE}, {quote(plain(BIRTH_CONTEXT))}) OR (NOT contains({LINE}, ':') AND {context(80, BIRTH_CONTEXT)}))"
RULES = {"taj": f"({CHECKSUM} OR {context(60, TAJ_BEFORE)}) AND NOT {context(12, INSTITUTION)}", "dob_numeric": BIRTH, "dob_text": BIRTH} | {k: f"length(found) >= {n}" for k, n in LEAST.items()}


def detected(src: str, name: str) -> str:
    rank, (_, label, where, pattern) = next((i, d) for i, d in enumerate(DETECTORS) if d[0] == name)
    rule = f"WHERE {RULES[name]}" if name in RULES else ""
    return f"SELECT doc_id, s, e, '{label}' AS label, found, {rank * 1_000_000} + i AS ord FROM ({matches(src, pattern, where)}) {rule}"


def all_spans(src: str) -> str:
    return " UNION ALL ".join(detected(src, d[0]) for d in DETECTORS)


def merged(spans: str) -> str:
    return f"""SELECT doc_id, min(s) AS s, max(e) AS e, arg_min(label, struct_pack(a := s, b := s - e, c := ord)) AS label, arg_min(found, struct_pack(a := s, b := s - e, c := ord)) AS found, min(ord) AS ord FROM (
      SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, s - e, ord ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, s - e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({spans}))) GROUP BY doc_id, island"""


CELLS = "list_transform(string_split(substr(l, 2, length(l) - 2), '|'), lambda c: trim(c))"
COLLAPSED = f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN length(l) >= 2 AND starts_with(l, '|') AND ends_with(l, '|') AND len({CELLS}) >= 3 AND length({CELLS}[1]) >= 12
  AND len(list_distinct({CELLS})) = 1 AND NOT regexp_matches({CELLS}[1], '^-+$') THEN '| ' || {CELLS}[1] || ' |' || repeat(' |', len({CELLS}) - 1) ELSE l END), chr(10)) AS text FROM ({TEXTS_SQL})"""
NEAR_SQL = f"""SELECT x.doc_id, x.s, x.e, 'DOCTOR_ID' AS label, x.found, 90000000 + x.i AS ord FROM ({matches("SELECT * FROM src", BARE_STAMP)}) x
  WHERE EXISTS (SELECT 1 FROM first_ f WHERE f.doc_id = x.doc_id AND f.label = 'NAME' AND f.s - 60 <= x.e AND x.s <= f.e + 60)
  AND NOT EXISTS (SELECT 1 FROM first_ f WHERE f.doc_id = x.doc_id AND f.s <= x.s AND f.e >= x.e)"""


def with_spans(src: str) -> str:
    return f"WITH src AS MATERIALIZED ({src}), raw_ AS MATERIALIZED ({all_spans('SELECT * FROM src')}), first_ AS MATERIALIZED ({merged('SELECT * FROM raw_')}), near_ AS MATERIALIZED ({NEAR_SQL}), final_ AS MATERIALIZED ({merged('SELECT * FROM first_ UNION ALL SELECT * FROM near_')})"


LABEL = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACEHOLDERS.items()) + " END"
ORDERED = "SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM final_"
REDACTED = f"""{with_spans(COLLAPSED)} SELECT src.doc_id, coalesce(j.body || substr(src.text, j.last + 1), src.text) AS redacted_text, coalesce(j.n, 0) AS n_spans FROM src LEFT JOIN (
  SELECT o.doc_id, string_agg(substr(t.text, o.prev + 1, o.s - o.prev) || {LABEL}, '' ORDER BY o.s) AS body, max(o.e) AS last, cast(count(*) AS int) AS n FROM ({ORDERED}) o JOIN src t ON t.doc_id = o.doc_id GROUP BY o.doc_id) j ON j.doc_id = src.doc_id"""
LENGTHS = f"SELECT doc_id, text, length(text) AS n FROM ({TEXTS_SQL})"
CHUNKS = f"""SELECT doc_id, 1 AS pass, pos, substr(text, pos + 1, {CHUNK}) AS chunk FROM (SELECT *, unnest(generate_series(0, n - 1, {STRIDE})) AS pos FROM ({LENGTHS}) WHERE n > 0)
  UNION ALL SELECT doc_id, 2, pos, substr(text, pos + 1, {CHUNK}) FROM (SELECT *, unnest(generate_series({SHIFT}, n - 1, {STRIDE})) AS pos FROM ({LENGTHS}) WHERE n > {STRIDE})"""
BOUNDS = f"""SELECT doc_id, b FROM (SELECT doc_id, n, pos AS b FROM (SELECT *, unnest(generate_series(0, n - 1, {STRIDE})) AS pos FROM ({LENGTHS}) WHERE n > 0) WHERE pos > 0
  UNION SELECT doc_id, n, pos + {CHUNK} FROM (SELECT *, unnest(generate_series(0, n - 1, {STRIDE})) AS pos FROM ({LENGTHS}) WHERE n > 0) WHERE pos + {CHUNK} < n)"""


def accepted(words: dict[str, tuple[str, float]], labels: dict[str, str]) -> str:
    """The gazetteer's answers in all chunks, filtered and made distinct."""
    pattern = "|".join(sorted(words, key=len, reverse=True))
    case = lambda f: "CASE found " + " ".join(f"WHEN {quote(w)} THEN {f(*x)}" for w, x in words.items()) + " END"
    raw = f"""SELECT doc_id // 10000000 AS doc_id, pass, pos, i, s + pos AS s, e + pos AS e, found, {case(lambda g, s: quote(labels.get(g, "")))} AS label, {case(lambda g, s: s)} AS score FROM (
      SELECT m.doc_id, c.pass, c.pos, m.s, m.e, m.found, m.i FROM ({matches("SELECT id AS doc_id, chunk AS text FROM chunk_", pattern)}) m JOIN chunk_ c ON c.id = m.doc_id)"""
    raw = raw.replace("doc_id // 10000000 AS doc_id", "doc AS doc_id").replace("SELECT m.doc_id, c.pass", "SELECT c.doc_id AS doc, c.pass")
    return f"""WITH chunk_ AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, pass, pos) AS id FROM ({CHUNKS})), bound_ AS MATERIALIZED ({BOUNDS}), raw_ AS ({raw})
      SELECT doc_id, s AS "start", e AS "end", label, found AS text, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, e ORDER BY pass, pos, i) AS n FROM raw_
      WHERE label <> '' AND score >= 0.7 AND (pass = 1 OR EXISTS (SELECT 1 FROM bound_ b WHERE b.doc_id = raw_.doc_id AND b.b - {NEAR} <= raw_.e AND raw_.s <= b.b + {NEAR}))) WHERE n = 1"""


def manual(value: str, label: str) -> str:
    """By a list of all orders, joints and pieces: the value has two parts."""
    parts = value.split()
    ways = {joint.join(o) for o in itertools.permutations(parts) for joint in (" ", "-", ". ", "")} | set(parts)
    plain = lambda w: "".join(next((f"[{g}]" for g in VOWEL_GROUPS if c.lower() in g), c.replace(".", "[.]")) for c in w)
    p = quote("(?i)" + "|".join(plain(w) for w in sorted(ways, key=lambda w: (-len(w), w))))
    return f"SELECT doc_id, regexp_replace(text, {p}, '[REDACTED_{label}]', 'g') AS redacted_text, cast(len(regexp_extract_all(text, {p})) AS int) AS n_replaced FROM ({TEXTS_SQL})"


SPANS = 'doc_id, s AS "start", e AS "end", label, found AS text'

