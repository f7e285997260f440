"""SQL for the queries of this subpackage that SQL can express; the others are tested against brute force."""

from __future__ import annotations

#: Levels of the digest trees that the SQL spells out: up to 16 ** 6 rows a source, and as many sources.
LEVELS = 6

_LEAF = "sha256(concat({}))".format(
    ", ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
    )
)


def _levels(name: str, first: str, keys: str) -> str:
    """CTEs ``name``0 .. of nodes (keys, i, n, d), each the runs of 16 of the one before, or its one node again."""
    parts = [f"{name}0 AS ({first})"]
    for k in range(LEVELS):
        parts.append(
            f"""{name}{k + 1} AS MATERIALIZED (SELECT {keys}, i // 16 AS i, max((n + 15) // 16) AS n,
                CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY {keys}, i // 16)"""
        )
    return ",\n".join(parts)


def _walk(name: str, key: str, node: str, parts: list[str], last: str) -> str:
    """CTEs that lead rows (tree keys, spot, proof, folded) up all levels of ``name``, and leave the last one's name."""
    for k in range(LEVELS):
        beside = f"""SELECT w.row, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE s.i < w.spot), '') AS earlier,
            coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (WHERE s.i > w.spot), '') AS later, max(s.n) AS n
            FROM {last} w JOIN {name}{k} s ON s.{key} = w.{node} AND s.i // 16 = w.spot // 16 GROUP BY w.row"""
        now = f"{name}up{k}"
        parts.append(
            f"""{now} AS MATERIALIZED (SELECT w.* EXCLUDE (spot, proof, folded), CASE WHEN b.n > 1 THEN spot // 16 ELSE spot END AS spot,
                CASE WHEN b.n > 1 THEN proof || earlier || later ELSE proof END AS proof,
                CASE WHEN b.n > 1 THEN sha256(earlier || folded || later) ELSE folded END AS folded FROM {last} w JOIN ({beside}) b USING (row))"""
        )
        last = now
    return last


def _merkle() -> str:
    # crc32 of the digits, bit by bit.
    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""leaves AS MATERIALIZED (SELECT doc_id, source, {_LEAF.format(text='text')} AS leaf,
            CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {_LEAF.format(text=lower)} ELSE {_LEAF.format(text='text')} END AS got FROM documents)""",
        """placed AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS row,
            dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves)""",
        _levels("rows_", "SELECT tree, i, n, leaf AS d FROM placed", "tree"),
        _levels("tops_", f"SELECT 0 AS forest, tree AS i, count(*) OVER () AS n, d FROM rows_{LEVELS}", "forest"),
        "start AS (SELECT row, tree, i AS spot, '' AS proof, got AS folded FROM placed)",
    ]
    last = _walk("rows_", "tree", "tree", parts, "start")
    parts.append(f"middle AS (SELECT row, tree, 0 AS forest, tree AS spot, proof, folded FROM {last})")
    last = _walk("tops_", "forest", "forest", parts, "middle")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, source, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified
        FROM placed JOIN {last} USING (row) JOIN rows_{LEVELS} s ON s.tree = placed.tree CROSS JOIN tops_{LEVELS} t"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_LEXICAL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
held AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held CROSS JOIN whole GROUP BY term),
parts AS (
  SELECT row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM held JOIN weights USING (term) JOIN sizes USING (row) CROSS JOIN whole
),
scores AS (SELECT item_id, row, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, row HAVING sum(part) > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores JOIN sizes USING (row)
) WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op11_merkle": _merkle(), "op13_lexical": _LEXICAL}
