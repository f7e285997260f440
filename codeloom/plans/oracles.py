"""The same results in SQL. Queries on built sources are restated by arithmetic on the part table, without
reading any source text."""

from __future__ import annotations

# Conversations as lines, with the turn before.
_TURNS = """
turns AS (
  SELECT conv_id, turn, text,
         lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_turn,
         lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text
  FROM conversations),
split AS (
  SELECT conv_id, turn, prev_turn,
         CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END AS a
  FROM turns),
line AS (SELECT conv_id, turn, prev_turn, unnest(range(1, len(a) + 1))::INTEGER AS ln, unnest(a) AS text FROM split),
copied AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY ln) AS copy FROM line),
changed AS (
  SELECT n.conv_id, n.turn, n.ln FROM copied n
  WHERE NOT EXISTS (SELECT 1 FROM copied o WHERE o.conv_id = n.conv_id AND o.turn = n.prev_turn
                    AND o.text = n.text AND o.copy = n.copy)),
removed AS (
  SELECT o.conv_id, t.turn, o.ln FROM copied o JOIN turns t ON t.conv_id = o.conv_id AND t.prev_turn = o.turn
  WHERE NOT EXISTS (SELECT 1 FROM copied n WHERE n.conv_id = o.conv_id AND n.turn = t.turn
                    AND n.text = o.text AND n.copy = o.copy))
"""

# Functions of the built sources, one row per part and revision.
_FN = """
revs AS (SELECT unnest([0, 1, 2, 3]) AS rev),
part_fn AS (
  SELECT p_partkey AS k, rev::BIGINT AS rev,
         lower(p_type) || '/m' || (p_partkey // 2000) || '/' || replace(lower(p_brand), '#', '_') ||
           CASE p_type WHEN 'PROMO' THEN '.java' WHEN 'SMALL' THEN '.txt' ELSE '.py' END AS path,
         p_name || ' ' || p_partkey || CASE WHEN rev >= 1 AND p_partkey % 7 = 0 THEN ' v2' ELSE '' END AS words,
         p_size + CASE WHEN p_partkey % 5 = 0 THEN rev ELSE 0 END AS number,
         [0, 1, 3][p_partkey % 3 + 1] AS dl
  FROM part, revs
  WHERE NOT (rev = 0 AND p_partkey % 13 = 0) AND NOT (rev >= 1 AND p_partkey % 11 = 0)),
fn AS (
  SELECT *, 'f_' || k AS name, 'def f_' || k AS key,
         CASE dl WHEN 1 THEN '\"\"\"' || words || '\"\"\"'
                 WHEN 3 THEN '\"\"\"' || chr(10) || '    ' || words || chr(10) || '    \"\"\"' END AS doc,
         'def f_' || k || '(x):' || chr(10) AS head,
         '    y = x + ' || number || ' + ' || k || chr(10) || '    return y * ' || k AS rest,
         row_number() OVER (PARTITION BY path, rev ORDER BY k) AS fn_id,
         (1 + coalesce(sum(4 + dl) OVER (PARTITION BY path, rev ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS start_ln
  FROM part_fn),
text AS (
  SELECT *, head || coalesce('    ' || doc || chr(10), '') || rest AS code, head || rest AS bare FROM fn),
file AS (
  SELECT path, rev, string_agg(code || chr(10) || chr(10), '' ORDER BY k) AS content,
         string_agg(bare || chr(10) || chr(10), '' ORDER BY k) AS bare
  FROM text GROUP BY path, rev),
py AS (SELECT * FROM text WHERE path LIKE '%.py'),
pyfile AS (SELECT * FROM file WHERE path LIKE '%.py'),
touched AS (SELECT * FROM py WHERE rev = 1 AND (k % 5 = 0 OR k % 13 = 0 OR (k % 7 = 0 AND dl > 0))),
step AS (
  SELECT n.path, o.content AS old_content, n.content AS new_content
  FROM (SELECT * FROM pyfile WHERE rev = 1) n LEFT JOIN (SELECT * FROM pyfile WHERE rev = 0) o ON o.path = n.path
  WHERE o.content IS DISTINCT FROM n.content)
"""

# Lines that differ from revision 0 to 1. Between two functions that stay, the last blank lines of both sides are one, other
# blank and quote lines of functions that go match those of functions that come in order. Where the last difference of several
# is only lines that go or come, the blank line above them counts and not the one below.
_LINES = """
stays AS (SELECT path, k FROM py WHERE rev <= 1 GROUP BY path, k HAVING count(*) = 2),
placed AS (
  SELECT p.path, p.k, p.rev, p.dl, p.start_ln, s.k IS NOT NULL AS common,
         count(s.k) OVER (PARTITION BY p.path, p.rev ORDER BY p.k) AS gap
  FROM py p LEFT JOIN stays s ON s.path = p.path AND s.k = p.k
  WHERE p.rev <= 1 AND p.path IN (SELECT path FROM step)),
numbered AS (SELECT *, unnest(range(0, dl + 4)) AS i FROM placed),
kinds AS (
  SELECT *, (start_ln + i)::INTEGER AS ln,
         CASE WHEN dl = 3 AND i IN (1, 3) THEN 'quote' WHEN i = dl + 3 THEN 'blank' ELSE 'own' END AS kind
  FROM numbered),
counts AS (SELECT path, 1 - rev AS rev, gap, kind, count(*) AS there FROM kinds WHERE NOT common GROUP BY ALL),
lone AS (
  SELECT k.*, row_number() OVER w AS copy, count(*) OVER (PARTITION BY k.path, k.rev, k.gap, k.kind) AS here, coalesce(c.there, 0) AS there
  FROM kinds k LEFT JOIN counts c ON c.path = k.path AND c.rev = k.rev AND c.gap = k.gap AND c.kind = k.kind
  WHERE NOT common WINDOW w AS (PARTITION BY k.path, k.rev, k.gap, k.kind ORDER BY ln)),
plain AS (
  SELECT path, rev, gap, ln, true AS common, false AS ends FROM kinds
  WHERE common AND ((k % 5 = 0 AND i = dl + 1) OR (k % 7 = 0 AND dl > 0 AND i = CASE dl WHEN 1 THEN 1 ELSE 2 END))
  UNION ALL SELECT path, rev, gap, ln, false, kind = 'blank' AND there = 0 AND copy = here FROM lone
  WHERE CASE kind WHEN 'own' THEN true WHEN 'quote' THEN copy > there
                  ELSE there = 0 OR (copy < here AND copy > there - 1) END),
slid AS (
  SELECT p.path, p.rev, p.gap FROM plain p
  WHERE ends AND gap = (SELECT max(gap) FROM plain q WHERE q.path = p.path)
    AND EXISTS (SELECT 1 FROM plain q WHERE q.path = p.path AND (q.gap < p.gap OR q.common))),
differ AS (
  SELECT path, rev AS side, ln FROM plain WHERE NOT (ends AND (path, rev, gap) IN (SELECT path, rev, gap FROM slid))
  UNION ALL SELECT k.path, k.rev, k.ln FROM kinds k JOIN slid s ON s.path = k.path AND s.rev = k.rev AND s.gap = k.gap
  WHERE k.common AND k.kind = 'blank')
"""

# The stand-in model: prompts and answers for the functions touched at revision 1.
_ASKED = """
asked AS (
  SELECT *, 'Document this python function:' || chr(10) || code || chr(10) AS prompt FROM touched),
answered AS (
  SELECT *, CASE WHEN length(prompt) % 4 <> 0 THEN '\"\"\"Doc of ' || length(prompt) || ' signs.\"\"\"'
                 ELSE 'def f' || length(prompt) || '(): pass' END AS answer,
         length(prompt) % 4 <> 0 AS success
  FROM asked),
documented AS (
  SELECT t.*, CASE WHEN a.success THEN a.answer ELSE t.doc END AS new_doc,
         t.head || CASE WHEN a.success THEN '    ' || a.answer || chr(10) || CASE WHEN t.dl > 0 THEN '    ' || chr(10) ELSE '' END
                        ELSE coalesce('    ' || t.doc || chr(10), '') END || t.rest AS new_code
  FROM text t LEFT JOIN answered a ON a.k = t.k WHERE t.rev = 1),
newfile AS (
  SELECT path, string_agg(new_code || chr(10) || chr(10), '' ORDER BY k) AS content FROM documented GROUP BY path)
"""

# A user's turn with the assistant's answer.
_PAIR = """
pair AS (
  SELECT u.conv_id, u.turn, u.text AS a, r.text AS b
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
  WHERE u.role = 'user' AND r.role = 'assistant'),
words AS (
  SELECT conv_id, turn, a, b,
         list_filter(string_split_regex(lower(a), '\\s+'), lambda w: w <> '') AS wa,
         list_filter(string_split_regex(lower(b), '\\s+'), lambda w: w <> '') AS wb
  FROM pair)
"""

_LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.text AS comment, l.quality = 1 AS success
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
"""


def _box(value: str, group: str, table: str) -> str:
    return f"""
quart AS (
  SELECT {group} AS g, count(*) AS n, min({value}) AS min, quantile_cont({value}, 0.25) AS q1,
         quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.75) AS q3, max({value}) AS max
  FROM {table} WHERE {value} IS NOT NULL GROUP BY 1),
box AS (
  SELECT q.g, q.n, q.min, q.q1, q.median, q.q3, q.max,
         min({value}) FILTER (WHERE {value} >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
         max({value}) FILTER (WHERE {value} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
         count(*) FILTER (WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM {table} t JOIN quart q ON q.g IS NOT DISTINCT FROM t.{group} GROUP BY ALL)
"""


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_SIX = ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")

# Letters beyond ASCII in the conversations, each with an ASCII sign the texts do not use: this levenshtein counts bytes.
_LETTERS = "éßÉÇçäÄóíÊêüÜÖÍÈöÓèñÑ"
_SIGNS = "0123456789!#$%&()*+-/"

_REPLAY = """
steps AS (
  SELECT *, (k % 5 = 0 OR (rev = 1 AND k % 13 = 0)) AS hit,
         'Document this python function:' || chr(10) || bare || chr(10) AS prompt
  FROM py),
events AS (
  SELECT path, rev, name AS qualname, key, length(prompt) % 4 <> 0 AS success,
         CASE WHEN length(prompt) % 4 <> 0 THEN '\"\"\"Doc of ' || length(prompt) || ' signs.\"\"\"'
              ELSE 'def f' || length(prompt) || '(): pass' END AS comment
  FROM steps WHERE hit AND rev >= 2)
"""

# Files that are deleted at some revision, with deletions kept and not.
_DELETED = """
keeps AS (SELECT unnest([false, true]) AS keep),
present AS (
  SELECT path, rev, NOT ((path LIKE '%3.py' AND rev = 2) OR (path LIKE '%4.py' AND rev = 3)) AS alive FROM file),
told AS (
  SELECT keep, p.*, 'Document this python function:' || chr(10) || bare || chr(10) AS prompt,
         rev >= 2 AND (k % 5 = 0 OR (rev = 3 AND NOT keep AND path LIKE '%3.py')) AS hit
  FROM py p JOIN present USING (path, rev), keeps WHERE alive AND rev >= 1)
"""

ORACLES: dict[str, str] = {
    "conv_previous": f"WITH {_TURNS} SELECT conv_id, turn, prev_turn AS prev_rev, md5(prev_text) AS old_md5, md5(text) AS new_md5 FROM turns",
    "conv_as_of": """SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS content_md5
        FROM conversations WHERE turn <= 3 GROUP BY conv_id""",
    "conv_commit_range": """WITH c AS (SELECT turn AS rev, row_number() OVER (ORDER BY turn DESC) - 1 AS idx
          FROM (SELECT DISTINCT turn FROM conversations)), p AS (SELECT * FROM c WHERE idx >= 1 AND idx < 5)
        SELECT rev, idx, idx = (SELECT max(idx) FROM p) AS is_base FROM p""",
    "conv_changed_lines": f"WITH {_TURNS} SELECT * FROM changed",
    "conv_changed_counts": f"WITH {_TURNS} SELECT conv_id, turn, count(*) AS n_changed FROM changed GROUP BY 1, 2",
    "conv_removed_lines": f"WITH {_TURNS} SELECT * FROM removed",
    "conv_hunks": f"""WITH {_TURNS}, i AS (SELECT *, ln - row_number() OVER (PARTITION BY conv_id, turn ORDER BY ln) AS island FROM changed)
        SELECT conv_id, turn, min(ln) AS start_ln, max(ln) AS end_ln, count(*) AS n_lines FROM i GROUP BY conv_id, turn, island""",
    "src_language": f"""WITH {_FN} SELECT path, rev, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' END AS language
        FROM file""",
    "src_supported": f"""WITH {_FN} SELECT path, rev, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'java' END AS language
        FROM file WHERE path NOT LIKE '%.txt' AND path <> 'economy/m0/brand_2.py'""",
    "src_lines": f"""WITH {_FN}, s AS (SELECT path, rev, string_split(content[:-2], chr(10)) AS a FROM file)
        SELECT path, rev, unnest(range(1, len(a) + 1))::INTEGER AS ln, unnest(a) AS text FROM s""",
    "src_round_trip": f"WITH {_FN} SELECT path, rev, md5(content) AS content_md5 FROM file",
    "src_file_changes": f"""WITH {_FN}, o AS (SELECT * FROM file WHERE rev = 0), n AS (SELECT * FROM file WHERE rev = 1)
        SELECT coalesce(o.path, n.path) AS path,
               CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS status,
               md5(o.content) AS old_md5, md5(n.content) AS new_md5
        FROM o FULL JOIN n ON o.path = n.path WHERE o.content IS DISTINCT FROM n.content""",
    "src_overlay": f"""WITH {_FN}, n AS (SELECT * FROM pyfile WHERE rev = 1)
        SELECT path, rev, md5(content) AS content_md5 FROM n
        UNION ALL SELECT path, rev, md5(content) FROM file WHERE rev = 0 AND path NOT IN (SELECT path FROM n)""",
    "src_modified_paths": f"""WITH {_FN}, w AS (SELECT *, lag(content) OVER (PARTITION BY path ORDER BY rev) AS old FROM file)
        SELECT DISTINCT path FROM w WHERE rev IN (1, 2) AND content IS DISTINCT FROM old AND path NOT LIKE '%.txt'""",
    "src_logical_lines": f"""WITH {_FN}, t AS (
          SELECT path, rev, start_ln, start_ln AS end_ln, 0 AS indent FROM py
          UNION ALL SELECT path, rev, start_ln + 1, start_ln + dl, 4 FROM py WHERE dl > 0
          UNION ALL SELECT path, rev, start_ln + dl + 1, start_ln + dl + 1, 4 FROM py
          UNION ALL SELECT path, rev, start_ln + dl + 2, start_ln + dl + 2, 4 FROM py)
        SELECT *, 'start' AS kind, false AS suspect FROM t""",
    "src_function_spans": f"""WITH {_FN} SELECT path, rev, fn_id, name, false AS is_async, 0 AS indent, start_ln, start_ln + 2 + dl AS end_ln FROM py""",
    "src_doc_spans": f"""WITH {_FN} SELECT path, rev, fn_id, start_ln + 1 AS doc_start_ln, start_ln + dl AS doc_end_ln, doc FROM py WHERE dl > 0""",
    "src_comment_lines": f"""WITH {_FN} SELECT path, rev, unnest(range(start_ln + 1, start_ln + dl + 1))::INTEGER AS ln FROM py""",
    "src_comment_ranges": f"""WITH {_FN} SELECT path, rev, fn_id, start_ln + 1 AS doc_start_ln, start_ln + dl AS doc_end_ln FROM py WHERE dl > 0""",
    "src_doc_pairs": f"WITH {_FN} SELECT path, rev, fn_id, doc, key FROM py WHERE dl > 0",
    "src_changed_lines": f"WITH {_FN}, {_LINES} SELECT path, 1::BIGINT AS rev, ln FROM differ WHERE side = 1",
    "src_removed_lines": f"WITH {_FN}, {_LINES} SELECT path, 1::BIGINT AS rev, ln FROM differ WHERE side = 0",
    "src_changed_functions": f"WITH {_FN} SELECT path, rev, fn_id, name FROM touched",
    "src_changed_history": f"""WITH {_FN}, born AS (SELECT path, min(rev) AS first_rev FROM pyfile GROUP BY path)
        SELECT path, rev, name FROM py JOIN born USING (path)
        WHERE rev = first_rev OR k % 5 = 0 OR (rev = 1 AND (k % 13 = 0 OR (k % 7 = 0 AND dl > 0)))""",
    "src_docs_changed": f"WITH {_FN} SELECT path, rev, fn_id, doc, key FROM touched WHERE dl > 0",
    "src_doc_change_lines": f"""WITH {_FN}, {_LINES}
        SELECT d.path, 1::BIGINT AS rev, d.ln, CASE WHEN dl = 1 THEN '    ' || doc WHEN d.ln = start_ln + 2 THEN '    ' || words ELSE '    \"\"\"' END AS text
        FROM differ d JOIN py p ON p.path = d.path AND p.rev = 0 AND d.ln BETWEEN p.start_ln + 1 AND p.start_ln + p.dl WHERE d.side = 0""",
    "src_doc_slots": f"""WITH {_FN} SELECT path, rev, name, code, start_ln + 1 AS slot_ln, start_ln + dl AS replace_to_ln, 4 AS slot_col FROM touched""",
    "src_strip": f"WITH {_FN} SELECT path, rev, false AS leaves_empty, md5(bare || chr(10)) AS content_md5 FROM pyfile",
    "src_strip_changed": f"""WITH {_FN}
        SELECT path, 1::BIGINT AS rev, false AS leaves_empty, md5(string_agg(
                 CASE WHEN t.k IS NULL THEN p.code ELSE p.bare END || chr(10) || chr(10), '' ORDER BY p.k) || chr(10)) AS content_md5
        FROM py p JOIN step USING (path) LEFT JOIN (SELECT k FROM touched) t ON t.k = p.k
        WHERE p.rev = 1 GROUP BY path""",
    "src_restore": f"""WITH {_FN}
        SELECT path, 1::BIGINT AS rev, md5(string_agg(
                 p.head || coalesce('    ' || o.doc || chr(10), '') || p.rest || chr(10) || chr(10), '' ORDER BY p.k)) AS content_md5
        FROM py p JOIN step USING (path) LEFT JOIN (SELECT k, doc FROM py WHERE rev = 0) o ON o.k = p.k
        WHERE p.rev = 1 GROUP BY path""",
    "src_prompt": f"WITH {_FN}, {_ASKED} SELECT path, rev, name, prompt FROM asked",
    "src_generate": f"WITH {_FN}, {_ASKED} SELECT path, rev, name, answer FROM answered",
    "src_generate_again": f"WITH {_FN}, {_ASKED} SELECT path, rev, name, answer FROM answered",
    "src_validate": f"""WITH {_FN} SELECT path, rev, ok AS success, count(*) AS n FROM py, (SELECT unnest([true, false]) AS ok)
        WHERE dl > 0 GROUP BY path, rev, ok""",
    "src_attempts": f"WITH {_FN}, {_ASKED} SELECT path, rev, fn_id, success, answer AS comment FROM answered",
    "src_accepted": f"""WITH {_FN}, {_ASKED} SELECT path, rev, fn_id, start_ln + 1 AS slot_ln, start_ln + dl AS replace_to_ln,
        4 AS slot_col, answer AS comment FROM answered WHERE success""",
    "src_insert": f"WITH {_FN}, {_ASKED} SELECT path, 1::BIGINT AS rev, md5(content) AS content_md5 FROM newfile WHERE path IN (SELECT path FROM step)",
    "src_update": f"WITH {_FN}, {_ASKED} SELECT path, md5(content) AS content_md5 FROM newfile",
    "src_match_pairs": f"""WITH {_FN} SELECT n.path, o.key AS code, o.doc AS original_comment, n.doc AS agent_comment
        FROM py n JOIN py o ON o.k = n.k AND o.path = n.path WHERE n.rev = 1 AND o.rev = 0 AND n.doc <> o.doc""",
    "src_comment_pairs": f"""WITH {_FN}, {_ASKED} SELECT path, key AS code, doc AS original_comment, new_doc AS agent_comment
        FROM documented WHERE path LIKE '%.py' AND doc <> new_doc""",
    "src_snapshot": f"WITH {_FN} SELECT rev, path, md5(content) AS content_md5 FROM file",
    "load_snapshot_files": f"WITH {_FN} SELECT rev, path, md5(content || chr(10)) AS content_md5 FROM file",
    "pair_jaccard": f"""WITH {_PAIR}, d AS (SELECT conv_id, turn, list_distinct(wa) AS x, list_distinct(wb) AS y FROM words)
        SELECT conv_id, turn, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0.0), 6) AS score FROM d""",
    "pair_levenshtein": f"""WITH {_PAIR}, c AS (SELECT conv_id, turn, translate(a, '{_LETTERS}', '{_SIGNS}') AS x, translate(b, '{_LETTERS}', '{_SIGNS}') AS y FROM pair)
        SELECT conv_id, turn, round(CASE WHEN x = '' AND y = '' THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS score FROM c""",
    "pair_tfidf": f"""WITH {_PAIR},
        w AS (SELECT conv_id, turn, 0 AS side, unnest(wa) AS word FROM words UNION ALL SELECT conv_id, turn, 1, unnest(wb) FROM words),
        tf AS (SELECT conv_id, turn, side, word, count(*) AS c FROM w GROUP BY ALL),
        idf AS (SELECT word, ln((1 + 2 * (SELECT count(*) FROM pair)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY word),
        v AS (SELECT conv_id, turn, side, word, c * idf AS x FROM tf JOIN idf USING (word)),
        norm AS (SELECT conv_id, turn, side, sqrt(sum(x * x)) AS s FROM v GROUP BY ALL),
        dot AS (SELECT l.conv_id, l.turn, sum(l.x * r.x) AS d FROM v l JOIN v r ON r.conv_id = l.conv_id AND r.turn = l.turn AND r.word = l.word
                WHERE l.side = 0 AND r.side = 1 GROUP BY ALL)
        SELECT p.conv_id, p.turn, round(coalesce(d / (na.s * nb.s), 0.0), 6) AS score FROM pair p
        LEFT JOIN dot USING (conv_id, turn)
        LEFT JOIN norm na ON na.conv_id = p.conv_id AND na.turn = p.turn AND na.side = 0
        LEFT JOIN norm nb ON nb.conv_id = p.conv_id AND nb.turn = p.turn AND nb.side = 1""",
    "pair_model": f"WITH {_PAIR} SELECT conv_id, turn, round(least(length(a), length(b)) / greatest(length(a), length(b), 1), 6) AS score FROM pair",
    "pair_embedding": """WITH f AS (SELECT label, min(vec_id) AS first_id FROM embeddings GROUP BY label)
        SELECT e.vec_id, f.first_id, round(list_cosine_similarity(e.embedding::DOUBLE[], g.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e JOIN f USING (label) JOIN embeddings g ON g.vec_id = f.first_id""",
    "box_stats": f"WITH {_box('value', 'event_type', 'events')} SELECT g AS event_type, n, {_rounded(*_SIX)}, n_outliers FROM box",
    "box_stats_null_group": f"""WITH {_box('l_extendedprice', 'line', '(SELECT nullif(l_linenumber, 2) AS line, l_extendedprice FROM lineitem)')}
        SELECT g AS line, n, {_rounded(*_SIX)}, n_outliers FROM box""",
    "box_stats_merged": """SELECT event_type, count(*) AS n, round(min(value), 6) AS min, round(max(value), 6) AS max,
        true AS q1_near, true AS median_near, true AS q3_near FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "compare_stored_runs": f"""WITH {_LABELLED},
        s AS (SELECT lang AS run_id, count(*) AS n, min(n_chars) / 1000 AS min, max(n_chars) / 1000 AS max FROM documents GROUP BY lang),
        a AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE success) AS successes,
                     count(*) FILTER (WHERE success) / count(*) AS ratio FROM labelled GROUP BY lang)
        SELECT run_id, n, round(min, 6) AS min, round(max, 6) AS max, total, successes, round(ratio, 6) AS ratio,
               round(ratio - lag(ratio) OVER (ORDER BY run_id), 6) AS ratio_change
        FROM s LEFT JOIN a ON a.lang = s.run_id""",
    "success_ratio": f"""WITH {_LABELLED} SELECT source, count(*) AS total, count(*) FILTER (WHERE success) AS successes,
        round(count(*) FILTER (WHERE success) / count(*), 6) AS ratio FROM labelled GROUP BY source""",
    "failure_sample": f"""WITH {_LABELLED} SELECT row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)::INTEGER AS pick, doc_id, source
        FROM labelled WHERE NOT success ORDER BY 1 LIMIT 10""",
    "success_report": f"""WITH {_LABELLED},
        pick AS (SELECT row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)::INTEGER AS i, comment FROM labelled WHERE NOT success ORDER BY 1 LIMIT 10),
        r AS (SELECT count(*) FILTER (WHERE success) AS s, count(*) AS t FROM labelled)
        SELECT 0 AS ord, '# Success Report' AS line
        UNION ALL SELECT 1, '**Success ratio:** ' || printf('%.2f', 100.0 * s / t) || '% (' || s || '/' || t || ' successful)' FROM r
        UNION ALL SELECT 2, '## Sample of 10 Failures:'
        UNION ALL SELECT 2 * i + 1, '### Failure ' || i || ':' FROM pick
        UNION ALL SELECT 2 * i + 2, '> ' || regexp_replace(comment, '^\\s+|\\s+\\z', '', 'g') FROM pick""",
    "compare_runs": f"""WITH {_LABELLED}, s AS (SELECT lang AS run_id, n_chars / 1000 AS score FROM documents), {_box('score', 'run_id', 's')},
        a AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE success) AS successes,
                     count(*) FILTER (WHERE success) / count(*) AS ratio FROM labelled GROUP BY lang),
        j AS (SELECT coalesce(g, lang) AS run_id, n, {', '.join(_SIX)}, n_outliers, total, successes, ratio FROM box FULL JOIN a ON a.lang = box.g)
        SELECT run_id, n, {_rounded(*_SIX)}, n_outliers, total, successes, round(ratio, 6) AS ratio,
               round(median - lag(median) OVER (ORDER BY run_id), 6) AS median_change,
               round(ratio - lag(ratio) OVER (ORDER BY run_id), 6) AS ratio_change
        FROM j""",
    "load_score_files": f"""WITH {_PAIR}, d AS (SELECT *, list_distinct(wa) AS x, list_distinct(wb) AS y FROM words)
        SELECT 'run_1' AS run_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0.0), 6) AS score,
               'def f_' || conv_id AS code, a AS original_comment, b AS agent_comment, conv_id || '.py' AS filename, turn::VARCHAR AS agent_commit
        FROM d""",
    "load_attempt_files": f"WITH {_LABELLED} SELECT 'run_1' AS run_id, success, md5(comment) AS comment_md5 FROM labelled",
    "append_runs": f"WITH {_LABELLED} SELECT doc_id, success, CASE WHEN success THEN 'good' ELSE 'bad' END AS run_id FROM labelled",
    "replay_events": f"WITH {_FN}, {_REPLAY} SELECT * FROM events",
    "replay_docs": f"""WITH {_FN}, {_REPLAY}
        SELECT p.path, p.rev, p.name AS qualname, p.key,
               last_value(CASE WHEN e.success THEN e.comment END IGNORE NULLS) OVER (PARTITION BY p.path, p.name ORDER BY p.rev) AS doc
        FROM py p LEFT JOIN events e ON e.path = p.path AND e.rev = p.rev AND e.qualname = p.name WHERE p.rev >= 1""",
    "replay_tree": f"""WITH {_FN}, {_REPLAY}, now AS (
          SELECT p.*, last_value(CASE WHEN e.success THEN e.comment END IGNORE NULLS) OVER (PARTITION BY p.path, p.name ORDER BY p.rev) AS current
          FROM py p LEFT JOIN events e ON e.path = p.path AND e.rev = p.rev AND e.qualname = p.name WHERE p.rev >= 1)
        SELECT path, rev, md5(string_agg(head || coalesce('    ' || current || chr(10), '') || rest || chr(10) || chr(10), '' ORDER BY k) || chr(10)) AS content_md5
        FROM now GROUP BY path, rev""",
    "replay_scores": f"""WITH {_FN}, {_REPLAY}, pairs AS (
          SELECT p.path, p.rev, p.key AS code, p.doc AS original_comment, e.comment AS agent_comment,
                 list_distinct(list_filter(string_split_regex(lower(p.doc), '\\s+'), lambda w: w <> '')) AS x,
                 list_distinct(list_filter(string_split_regex(lower(e.comment), '\\s+'), lambda w: w <> '')) AS y
          FROM events e JOIN py p ON e.path = p.path AND e.rev = p.rev AND e.qualname = p.name
          WHERE e.success AND p.doc <> e.comment)
        SELECT path, rev, code, original_comment, agent_comment, 'replay' AS run_id,
               round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS score FROM pairs""",
    "replay_deleted": f"""WITH {_FN}, {_DELETED}
        SELECT keep, path, rev, name AS qualname, key, last_value(CASE WHEN hit AND length(prompt) % 4 <> 0
                 THEN '\"\"\"Doc of ' || length(prompt) || ' signs.\"\"\"' END IGNORE NULLS) OVER (PARTITION BY keep, path, name ORDER BY rev) AS doc
        FROM told""",
    "src_path_lives": f"""WITH {_FN}, {_DELETED}, seen AS (
          SELECT keep, path, rev, alive, lag(alive, 1, false) OVER (PARTITION BY keep, path ORDER BY rev) AS before
          FROM present, keeps WHERE alive OR NOT keep)
        SELECT keep, path, rev AS from_rev, lead(rev) OVER (PARTITION BY keep, path ORDER BY rev) AS to_rev
        FROM seen WHERE alive <> before QUALIFY alive""",
    "stream_ratio": """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
               count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS successes,
               round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS ratio
        FROM events GROUP BY 1, 2
        HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "stream_changed": f"WITH {_TURNS} SELECT * FROM changed",
    "stream_functions": f"""WITH {_FN}, born AS (SELECT path, min(rev) AS first_rev FROM pyfile GROUP BY path)
        SELECT path, rev, name FROM py JOIN born USING (path)
        WHERE rev = first_rev OR k % 5 = 0 OR (rev = 1 AND (k % 13 = 0 OR (k % 7 = 0 AND dl > 0)))""",
}
