"""Oracle SQL: the simple analyzer and the index tables as common table expressions."""

from __future__ import annotations

from lodestone.functions import text as X
from lodestone.operators.stop_words import STOP_WORDS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = ", ".join(quoted(w) for w in sorted({*STOP_WORDS, *X.DROPPED}))
EDGE, SPLIT, REJECT = X.EDGE.replace("'", "''"), X.SPLIT.replace("'", "''"), X.REJECT.replace("'", "''")
DOCUMENTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
PAGES_HEAD = r"SELECT page_id AS doc_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) || ' ' || regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS text FROM pages"
PAGES_BODY = r"SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS text FROM pages"


def clean(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^{EDGE}*-[0-9]') THEN regexp_extract({x}, '^{EDGE}*?(-[0-9].*)$', 1) ELSE regexp_replace({x}, '^{EDGE}+|{EDGE}+$', '', 'g') END"


def number(x: str) -> str:
    return f"regexp_matches(replace({x}, ',', ''), '{X.NUMBER}')"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(replace({text}, chr(10), ' '), '{SPLIT}'), lambda x: x <> '')"


def accepted(t: str) -> str:
    return f"(length({t}) >= 2 AND NOT regexp_matches({t}, '{REJECT}') AND len(list_filter(string_split({t}, '-'), lambda p: p <> '' AND length(p) < 2)) * CAST(contains({t}, '-') AS INTEGER) = 0)"


def occurrences(name: str, source: str) -> str:
    """CTEs ending in {name}: doc_id, pos, term, is_upper of the rows (doc_id, text) of source."""
    return f"""{name}_t AS (SELECT doc_id, {tokens("text")} AS ts FROM ({source})),
{name}_r AS (SELECT doc_id, unnest(ts) AS raw, (generate_subscripts(ts, 1) - 1)::INTEGER AS pos FROM {name}_t),
{name}_c AS (SELECT doc_id, pos, raw, {clean("raw")} AS c FROM {name}_r),
{name} AS (SELECT doc_id, pos, lower(c) AS term, regexp_matches(c, '^\\p{{Lu}}') AS is_upper FROM {name}_c
  WHERE ({number("c")} OR (length(raw) >= 2 AND length(c) >= 2)) AND lower(c) NOT IN ({STOP}) AND {accepted("lower(c)")})"""


POST = "SELECT doc_id, term, count(*) AS tf, bool_and(is_upper) AS all_upper, max(pos) AS last_pos FROM {} GROUP BY doc_id, term"
TERMS = """SELECT term, bool_and(all_upper) AS is_entity, first(doc_id ORDER BY tf DESC, doc_id) AS max_tf_doc, max(tf) AS max_tf, sum(tf)::BIGINT AS total_tf, count(*) AS df FROM {} GROUP BY term"""
STATS = "SELECT doc_id, sum(tf)::BIGINT AS doc_len, count(*) AS n_unique, max(tf) AS max_tf, first(term ORDER BY tf DESC, last_pos, term) AS most_freq_term FROM {} GROUP BY doc_id"


def index(source: str = DOCUMENTS) -> str:
    """CTEs occ, post, terms, stats, corpus."""
    return f"""{occurrences("occ", source)},
post AS ({POST.format("occ")}),
terms AS ({TERMS.format("post")}),
stats AS ({STATS.format("post")}),
corpus AS (SELECT (sum(doc_len) // count(*))::BIGINT AS avl, count(*) AS n_docs, sum(doc_len)::BIGINT AS total_terms FROM stats)"""


#: Adds df and w to cand: query_id, term, is_upper, doc_id, tf, doc_len.
WEIGHTS = """weighed AS (
  SELECT *, 2.5 * tf / (tf + 1.5 * (1 - 0.37 + 0.37 * doc_len / avl)) * ln(CAST((n_docs + 1) // df AS DOUBLE)) AS w
  FROM (SELECT c.*, count(*) OVER (PARTITION BY query_id, term, is_upper) AS df FROM cand c), corpus)"""
