"""DuckDB SQL of those queries of the numbered operators that SQL can express."""

from __future__ import annotations

from convlens.llm.rules import STOP_WORDS

_SAID = "\\### Assistant: </turn> ok"

OP9 = f"""
WITH turns AS (
    SELECT conv_id::BIGINT AS conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, NULL, 0, 'user', '{_SAID}'
    UNION ALL SELECT -7, NULL, 1, 'assistant', '{_SAID}'
), laid AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id, lone ORDER BY turn, role, text) AS before,
        length(replace(replace(text, '\\', '\\b'), '<|', '\\m')) AS text_chars,
        length(replace(replace(replace(role, '\\', '\\b'), '<|', '\\m'), '|>', '\\c')) AS role_chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(text_chars + CASE WHEN before = role THEN 8 ELSE 11 + role_chars END)::BIGINT AS formatted_chars
FROM laid GROUP BY conv_id, lone
"""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP4 = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS said FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM rows_ WHERE len(ws) >= 50)),
firsts AS (SELECT said, min(doc_id) AS first_id FROM windows GROUP BY said),
gone AS (SELECT DISTINCT r, i + k AS place FROM windows JOIN firsts USING (said), range(50) t(k) WHERE first_id < doc_id),
words AS (SELECT r, word, place FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM rows_)),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.place) FILTER (g.r IS NULL) AS said, count(g.r) AS n_removed FROM words w LEFT JOIN gone g ON g.r = w.r AND g.place = w.place GROUP BY w.r)
SELECT doc_id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(said, '')) AS kept_sha256 FROM rows_ LEFT JOIN kept ON kept.r = rows_.r
"""
OP3 = f"""
WITH RECURSIVE rows_ AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS shingle FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 4 THEN range(1, len(ws) - 2) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM rows_)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, told) AS rep, n FROM (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '' ORDER BY shingle)) AS told FROM sets GROUP BY doc_id)),
own AS (SELECT s.* FROM sets s JOIN classes c ON c.doc_id = s.doc_id AND c.rep = s.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM own a JOIN own b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM ways UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen),
lowest AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(l.component, c.rep, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(l.component, c.rep, d.doc_id) AS kept
FROM documents d LEFT JOIN classes c ON c.doc_id = d.doc_id LEFT JOIN lowest l ON l.node = c.rep
"""

TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
asked AS (SELECT row_number() OVER () AS q, item_id, {TERMS.format("text")} AS terms FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
held AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, total GROUP BY term, n_docs),
scores AS (
    SELECT q, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN held USING (term), total GROUP BY ALL
)
SELECT item_id::BIGINT AS item_id, rank::INT AS rank, doc_id::BIGINT AS doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
"""
OP12 = """
WITH told AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || doc_id::VARCHAR) AS h FROM documents
), drawn AS (
    SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM told
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cut
)
SELECT doc_id::BIGINT AS doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def _list(words: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words.split()))) + "]"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HELD = r"regexp_matches({}, '[^\x20\x09-\x0D]')"
OP13 = f"""
WITH told AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_HELD.format("x")}) AS lines
    FROM documents
), windows AS (SELECT r, i, words[i:i + 4] AS five FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM told WHERE len(words) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(5) t(k) GROUP BY r),
counts AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, length(translate(text, {_WHITE}, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::DOUBLE AS n_lines,
        length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g'))::DOUBLE AS n_letters,
        len(list_filter(words, lambda w: list_contains({_list(STOP_WORDS)}, lower(rtrim(w, '.,;:!?')))))::DOUBLE AS n_stop_words,
        len(list_filter(lines, lambda x: regexp_matches(trim(x, {_WHITE}), '^[-*•]')))::DOUBLE AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(trim(x, {_WHITE}), '(\\.\\.\\.|…)$')))::DOUBLE AS n_ellipsis_lines
    FROM told LEFT JOIN repeats USING (r)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id::BIGINT AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 12.0 AND n_symbols / n_words::DOUBLE <= 0.10 AND (n_words < 50 OR n_stop_words / n_words >= 0.01)
        AND n_dup_lines / n_lines <= 0.30 AND n_bullet_lines / n_lines <= 0.90 AND n_ellipsis_lines / n_lines <= 0.30 AND n_letters / word_chars >= 0.60 AS kept
FROM judged
"""

SQL = {
    "op3_near_duplicates": OP3,
    "op4_repeated_passages": OP4,
    "op9_chat_format": OP9,
    "op11_lexical_search": OP11,
    "op12_fill_in_middle": OP12,
    "op13_quality_rules": OP13,
}
