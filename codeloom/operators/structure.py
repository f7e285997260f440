"""Functions and their docs, found with regular expressions and windows over the lines of each file.

Only Python is analysed. Strings and comments are blanked in the content row first, so that a line's mask holds
no bracket, quote or comment sign that is not code. Every window and grouping below starts with (path, rev);
``cluster_files`` before these functions therefore is the only shuffle they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.lines import FILE_KEY

# Marks in masked text: rest of a string, line inside a string, first and last sign of a string, edge of a literal.
_FILL, _INSIDE, _OPEN, _CLOSE, _EDGE = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
_MARKS = _FILL + _INSIDE + _OPEN + _CLOSE + _EDGE

# Strings and comments, whichever opens first. Possessive groups keep long strings off the Java stack.
_LITERAL = (
    r"""(?s)(?=["'#])("""
    r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"""'
    r"|'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'''"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|#[^\n]*+)"
)

_DEF = r"(?U)^(async\s+)?def\s+(\w+)"
_CLASS = r"(?U)^class\s+(\w+)"
_STRING_FIRST = rf"^[rRbBuUfF]{{0,2}}{_OPEN}[^{_CLOSE}]*+(?:{_CLOSE}\s*+#?)?$"
_STRING_NEXT = rf"^{_INSIDE}[^{_CLOSE}]*+(?:{_CLOSE}\s*+#?)?$"

_FILE = "PARTITION BY path, rev"
_BEFORE = f"OVER ({_FILE} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = f"OVER ({_FILE} ORDER BY ln ROWS UNBOUNDED PRECEDING)"


def _sql(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _masked(sources: DataFrame) -> DataFrame:
    """Line rows (path, rev, ln, text, mask, code): the line, its mask, and the mask without its indent."""
    content = F.col("content")
    one_break = F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, r"\r\n", "\n")).otherwise(content)
    marked = F.lit(False)
    for mark in _MARKS:
        marked = marked | F.contains(content, F.lit(mark))
    clean = F.when(marked, F.translate(one_break, _MARKS, " " * len(_MARKS))).otherwise(one_break)

    def blank(token):
        body = F.translate(token.substr(F.lit(2), F.char_length(token) - 2), "()[]{}#\\\"'", _FILL * 10)
        string = F.concat(F.lit(_OPEN), F.replace(body, F.lit("\n"), F.lit("\n" + _INSIDE)), F.lit(_CLOSE))
        return F.when(F.startswith(token, F.lit("#")), F.lit("#")).otherwise(string)

    pieces = F.split(F.regexp_replace("clean", _LITERAL, f"{_EDGE}$1{_EDGE}"), _EDGE)
    code = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, blank(piece)).otherwise(piece))
    both = F.arrays_zip(F.split("clean", "\n").alias("text"), F.split(F.array_join(code, ""), "\n").alias("mask"))
    return (
        sources.select(*FILE_KEY, clean.alias("clean"))
        .select(*FILE_KEY, F.posexplode(both).alias("pos", "line"))
        .selectExpr(
            *FILE_KEY, "pos + 1 AS ln", "line.text AS text", "line.mask AS mask", "ltrim(' \\t\\f', line.mask) AS code"
        )
    )


_OPENED = "char_length(code) - char_length(translate(code, '([{', ''))"
_CLOSED = "char_length(code) - char_length(translate(code, ')]}', ''))"
_DELTA = f"({_OPENED}) - ({_CLOSED}) AS delta"
_INDENT = """char_length(text) - char_length(ltrim(' \\t', text))
             + if(contains(text, '\\t'), 7 * (char_length(regexp_extract(text, '^[ \\\\t]*+', 0))
             - char_length(replace(regexp_extract(text, '^[ \\\\t]*+', 0), '\\t', ''))), 0) AS indent"""


def logical_lines(sources: DataFrame) -> DataFrame:
    """(path, rev, start_ln, end_ln, indent, kind, suspect): statements and comments with their line range.

    ``suspect`` flags files whose brackets do not add up or that hold an open quote, where ranges are a guess.
    """
    rows = (
        _masked(sources)
        .selectExpr(*FILE_KEY, "ln", "code", _DELTA, _INDENT)
        .selectExpr(
            "*",
            f"ifnull(sum(delta) {_BEFORE}, 0) AS depth",
            f"ifnull(lag(endswith(code, '\\\\')) OVER ({_FILE} ORDER BY ln), false) AS wrapped",
        )
        .selectExpr(
            *FILE_KEY,
            "ln",
            "indent",
            f"""CASE WHEN depth > 0 OR wrapped OR startswith(code, '{_INSIDE}') THEN 'continuation'
                     WHEN code = '' THEN 'blank' WHEN startswith(code, '#') THEN 'comment' ELSE 'start' END AS kind""",
            "code RLIKE '[\"\\']' OR depth + delta < 0 AS odd",
            "depth + delta AS depth",
        )
        .selectExpr(
            "*",
            f"max(CASE WHEN kind <> 'blank' THEN ln END) {_BEFORE} AS seen",
            f"max(CASE WHEN kind <> 'blank' THEN ln END) OVER ({_FILE}) AS last_ln",
            f"max(odd) OVER ({_FILE}) OR max_by(depth, ln) OVER ({_FILE}) <> 0 AS suspect",
        )
    )
    return rows.where("kind IN ('start', 'comment')").selectExpr(
        *FILE_KEY,
        "ln AS start_ln",
        f"ifnull(lead(seen) OVER ({_FILE} ORDER BY ln), last_ln) AS end_ln",
        "indent",
        "kind",
        "suspect",
    )


def _annotated(sources: DataFrame) -> DataFrame:
    """Lines that are not blank, with what came before them in their file.

    All that patterns can tell is worked out before the lines are sorted; of the text only what may be part of a
    doc travels on.
    """
    rows = (
        _masked(sources)
        .where("code <> ''")
        .selectExpr(
            *FILE_KEY,
            "ln",
            _DELTA,
            _INDENT,
            "endswith(code, '\\\\') AS wraps",
            f"startswith(code, '{_INSIDE}') AS inside",
            "startswith(code, '#') AS hash",
            f"""CASE WHEN (startswith(code, 'def') OR startswith(code, 'async')) AND code RLIKE {_sql(_DEF)} THEN 'def'
                     WHEN startswith(code, 'class') AND code RLIKE {_sql(_CLASS)} THEN 'class' ELSE '' END AS head""",
            "code",
            f"contains(code, '{_OPEN}') AND code RLIKE {_sql(_STRING_FIRST)} AS string_first",
            f"startswith(code, '{_INSIDE}') AND code RLIKE {_sql(_STRING_NEXT)} AS string_next",
            f"if(contains(code, '{_CLOSE}'), instr(mask, '{_CLOSE}') - if(startswith(code, '{_INSIDE}'), 1, 0), 0) AS close_at",
            f"if(startswith(code, '#') OR startswith(code, '{_INSIDE}') OR contains(code, '{_OPEN}'), text, '') AS text",
        )
        .selectExpr(
            *FILE_KEY, "ln", "delta", "indent", "wraps", "inside", "hash", "head", "string_first", "string_next", "close_at", "text",
            f"CASE head WHEN 'def' THEN regexp_extract(code, {_sql(_DEF)}, 2) WHEN 'class' THEN regexp_extract(code, {_sql(_CLASS)}, 1) END AS name",
            "head = 'def' AND startswith(code, 'async') AS is_async",
        )
        .selectExpr(
            "*",
            f"""inside OR ifnull(sum(delta) {_BEFORE}, 0) > 0
                OR ifnull(lag(wraps) OVER ({_FILE} ORDER BY ln), false) AS goes_on""",
        )
        .selectExpr(
            *FILE_KEY, "ln", "indent", "string_next", "close_at", "text", "name", "is_async", "goes_on",
            "hash AND NOT goes_on AS is_comment",
            "NOT goes_on AND NOT hash AS is_stmt",
            "head = 'def' AND NOT goes_on AS is_def",
            "string_first AND NOT goes_on AS is_string",
        )
    )
    stmt = "CASE WHEN is_stmt THEN struct(is_def, indent, ifnull(name, '') AS name) END"
    token = "CASE WHEN NOT goes_on THEN struct(is_def, indent) END"
    code_ln = "CASE WHEN NOT is_comment THEN ln END"
    return (
        rows.selectExpr(
            "*",
            f"last({stmt}, true) {_BEFORE} AS prev_stmt",
            f"last({token}, true) {_BEFORE} AS prev_token",
            f"max({code_ln}) {_BEFORE} AS prev_end",
            f"max({code_ln}) OVER ({_FILE}) AS last_end",
            f"count_if(is_def) {_UPTO} AS fn_id",
        )
        .selectExpr(
            "*",
            "prev_stmt.is_def AS after_def",
            "prev_stmt.indent AS prev_indent",
            "prev_stmt.name AS prev_name",
            "is_string AND ifnull(prev_token.is_def AND indent > prev_token.indent, false) AS doc_first",
            "is_comment AND ifnull(prev_stmt.is_def AND indent > prev_stmt.indent, false) AS doc_comment",
        )
        .drop("prev_stmt", "prev_token")
        .selectExpr(
            "*", f"goes_on AND ifnull(last(CASE WHEN NOT goes_on THEN doc_first END, true) {_UPTO}, false) AS doc_rest"
        )
    )


def functions(sources: DataFrame, qualified: bool = False) -> DataFrame:
    """Every ``def``, nested ones too, with the doc that opens its body.

    (path, rev, fn_id, name, key, is_async, indent, start_ln, header_end_ln, end_ln, doc_start_ln, doc_end_ln,
    doc, doc_tail); ``fn_id`` numbers the functions of a file, ``doc_tail`` is what follows a doc in its last line.
    ``qualified`` adds ``qualname``: the name behind those of all classes and functions around it, copies numbered.

    A statement at indent i ends every block whose indent lies between i and the previous statement's, so one
    row per level it ends is enough to find the end of each function in a single ordered pass. Statements that
    end no block need no row.
    """
    none = "cast(array() AS array<struct<level: int, what: string>>)"
    items = [
        f"""CASE WHEN is_stmt AND (prev_indent > indent OR (prev_indent = indent AND after_def))
             THEN transform(sequence(indent, prev_indent), l -> struct(l AS level, '0 end' AS what)) ELSE {none} END""",
        f"CASE WHEN is_def THEN array(struct(indent AS level, '2 def' AS what)) ELSE {none} END",
        f"""CASE WHEN doc_first OR doc_rest THEN array(struct(-1 AS level, '3 string' AS what))
                 WHEN doc_comment THEN array(struct(-1 AS level, '3 comment' AS what))
                 WHEN goes_on AND after_def THEN array(struct(-1 AS level, '4 header' AS what)) ELSE {none} END""",
    ]
    if qualified:
        items.append(
            f"""CASE WHEN is_stmt AND ifnull(prev_indent < indent, true)
                 THEN array(struct(indent AS level, '1 block' AS what)) ELSE {none} END"""
        )
    level = f"{_FILE}, level ORDER BY ln"
    rows = (
        _annotated(sources)
        .selectExpr("*", f"inline(concat({', '.join(items)})) AS (level, what)")
        .selectExpr(
            "*",
            f"""last(CASE WHEN what = '0 end' THEN prev_end END, true) OVER ({level} DESC, what DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block_end""",
        )
    )
    owners = _owners(rows) if qualified else None
    rows = rows.where("what IN ('2 def', '3 comment', '3 string', '4 header')")

    at_def = "FILTER (WHERE what = '2 def')"
    is_doc = "FILTER (WHERE what LIKE '3 %')"
    cut = "if(what = '3 string' AND close_at > 0, close_at, char_length(text))"
    piece = f"struct(ln, substr(text, 1, {cut}) AS part, substr(text, {cut} + 1) AS tail)"
    aggs = [
        f"max(name) {at_def} AS name",
        f"max(is_async) {at_def} AS is_async",
        f"max(indent) {at_def} AS indent",
        f"max(ln) {at_def} AS start_ln",
        "max(ln) FILTER (WHERE what IN ('2 def', '4 header')) AS header_end_ln",
        f"max(ifnull(block_end, last_end)) {at_def} AS end_ln",
        f"ifnull(bool_and(what = '3 comment' OR doc_first OR string_next) {is_doc}, false) AS doc_ok",
        f"array_sort(collect_list({piece}) {is_doc}) AS doc_lines",
    ]
    found = rows.groupBy(*FILE_KEY, "fn_id").agg(*[F.expr(a) for a in aggs])
    doc = """array_join(transform(doc_lines, (l, i) ->
               if(i = 0, ltrim(' \\t', l.part), concat(repeat('\\n', l.ln - doc_lines[i - 1].ln), l.part))), '')"""
    out = [
        *FILE_KEY,
        "fn_id",
        "name",
        "concat(if(is_async, 'async def ', 'def '), name) AS key",
        "is_async",
        "indent",
        "start_ln",
        "header_end_ln",
        "end_ln",
        "if(doc_ok, doc_lines[0].ln, null) AS doc_start_ln",
        "if(doc_ok, element_at(doc_lines, -1).ln, null) AS doc_end_ln",
        f"if(doc_ok, {doc}, null) AS doc",
        "if(doc_ok, element_at(doc_lines, -1).tail, null) AS doc_tail",
    ]
    if not qualified:
        return found.selectExpr(*out)
    named = found.join(owners, [*FILE_KEY, "fn_id"]).selectExpr(*out, "concat_ws('.', owners, name) AS base")
    copy = f"row_number() OVER ({_FILE}, base ORDER BY start_ln)"
    return named.selectExpr("*", f"{copy} AS copy").selectExpr(
        "*", "if(copy = 1, base, concat(base, '#', copy)) AS qualname"
    ).drop("base", "copy")


def _owners(rows: DataFrame) -> DataFrame:
    """(path, rev, fn_id, owners): names of the classes and functions around each function, outermost first.

    Blocks open in order: one at some level ends all that are as deep or deeper. Those left above a ``def`` are around it;
    blocks that no class or function opened, as under ``if``, have no name.
    """
    events = "array_sort(collect_list(struct(ln, what, level, ifnull(prev_name, '') AS name, fn_id))) AS events"
    opened = "concat(filter(s.open, b -> b.level < e.level), array(struct(e.level AS level, e.name AS name)))"
    around = "transform(filter(s.open, b -> b.level <= e.level AND b.name <> ''), b -> b.name)"
    start = """struct(cast(array() AS array<struct<level: int, name: string>>) AS open,
                      cast(array() AS array<struct<fn_id: bigint, owners: array<string>>>) AS found)"""
    fold = f"""aggregate(events, {start}, (s, e) -> if(e.what = '1 block', struct({opened} AS open, s.found AS found),
               struct(s.open AS open, concat(s.found, array(struct(e.fn_id AS fn_id, {around} AS owners))) AS found)), s -> s.found)"""
    grouped = rows.where("what IN ('1 block', '2 def')").groupBy(*FILE_KEY).agg(F.expr(events))
    return grouped.selectExpr(*FILE_KEY, f"inline({fold})")


def function_spans(sources: DataFrame) -> DataFrame:
    """(path, rev, fn_id, name, is_async, indent, start_ln, end_ln)."""
    return functions(sources).select(*FILE_KEY, "fn_id", "name", "is_async", "indent", "start_ln", "end_ln")


def doc_spans(fns: DataFrame) -> DataFrame:
    """(path, rev, fn_id, doc_start_ln, doc_end_ln, doc) of functions that have a doc."""
    return fns.where("doc_start_ln IS NOT NULL").select(*FILE_KEY, "fn_id", "doc_start_ln", "doc_end_ln", "doc")


def comment_ranges(fns: DataFrame) -> DataFrame:
    return doc_spans(fns).drop("doc")


def comment_lines(fns: DataFrame) -> DataFrame:
    """(path, rev, ln): lines covered by docs."""
    return fns.where("doc_start_ln IS NOT NULL").select(
        *FILE_KEY, F.explode(F.sequence("doc_start_ln", "doc_end_ln")).alias("ln")
    )


def function_doc_pairs(fns: DataFrame) -> DataFrame:
    """(path, rev, fn_id, doc, key) of functions that have a doc."""
    return fns.where("doc IS NOT NULL").select(*FILE_KEY, "fn_id", "doc", "key")


def running_counts(numbers: str) -> str:
    """SQL for an array whose item n, from 0, counts the items of the sorted array ``numbers`` up to n. It ends at
    the last of them; beyond that the count is the size of ``numbers``."""
    steps = f"""transform({numbers}, (l, i) -> array_repeat(i + 1, ifnull(get({numbers}, i + 1), l + 1) - l))"""
    return f"if(size({numbers}) = 0, array(), concat(array_repeat(0, get({numbers}, 0)), flatten({steps})))"


def changed_functions(fns: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions with at least one changed line in their span, with ``mod_lines``, the sorted set of them.

    A change in an inner function counts for the enclosing one too. With ``removed_lines`` and the functions
    of the old side it works on the old side.

    Functions and changed lines of a file meet as two arrays, so both keep their partitioning by file and no
    function is compared with lines outside it: running counts tell where a span's lines begin and end.
    """
    rest = [c for c in fns.columns if c not in FILE_KEY]
    listed = fns.groupBy(*FILE_KEY).agg(F.collect_list(F.struct(*rest)).alias("fns"))
    hit = lines.groupBy(*FILE_KEY).agg(F.sort_array(F.collect_set("ln")).alias("lns"))
    before = "ifnull(get(s.counts, f.start_ln - 1), size(s.lns))"
    upto = "ifnull(get(s.counts, f.end_ln), size(s.lns))"
    found = f"""inline(transform(array(struct(fns, lns, {running_counts('lns')} AS counts)), s -> filter(
                  transform(s.fns, f -> struct(f AS fn, slice(s.lns, {before} + 1, {upto} - {before}) AS mod_lines)),
                  f -> size(f.mod_lines) > 0))[0])"""
    return listed.join(hit, FILE_KEY).selectExpr(*FILE_KEY, found).selectExpr(*FILE_KEY, "fn.*", "mod_lines")


def doc_change_lines(changed: DataFrame) -> DataFrame:
    """(path, rev, fn_id, ln): modified lines of ``changed_functions`` that fall inside the doc."""
    return (
        changed.where("doc_start_ln IS NOT NULL")
        .select(*FILE_KEY, "fn_id", "doc_start_ln", "doc_end_ln", F.explode("mod_lines").alias("ln"))
        .where("ln BETWEEN doc_start_ln AND doc_end_ln")
        .select(*FILE_KEY, "fn_id", "ln")
    )


def with_code(fns: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``code``, the text of each function. Functions of a file meet its content as one array, so the
    content is joined once per file and not once per function."""
    columns = fns.columns
    listed = fns.groupBy(*FILE_KEY).agg(F.collect_list(F.struct(*[c for c in columns if c not in FILE_KEY])).alias("_fns"))
    cut = """inline(transform(array(struct(_fns AS f, split(content, '\\r?\\n') AS l)), s ->
               transform(s.f, x -> struct(x AS fn, array_join(slice(s.l, x.start_ln, x.end_ln - x.start_ln + 1), '\\n') AS code)))[0])"""
    return (
        listed.join(sources.select(*FILE_KEY, "content"), FILE_KEY)
        .selectExpr(*FILE_KEY, cut)
        .selectExpr(*FILE_KEY, "fn.*", "regexp_replace(code, '^\\\\s+|\\\\s+\\\\z', '') AS code")
    )


def doc_slots(changed: DataFrame, sources: DataFrame, step: int = 4) -> DataFrame:
    """Where each changed function takes a new doc: its code, the line to insert before, the column, and the
    last line to replace (``slot_ln - 1`` without a doc). One-line functions have no slot."""
    multi = changed.where("end_ln > header_end_ln")
    return with_code(multi, sources).selectExpr(
        *FILE_KEY,
        "fn_id",
        "name",
        "key",
        "code",
        "header_end_ln + 1 AS slot_ln",
        "ifnull(doc_end_ln, header_end_ln) AS replace_to_ln",
        f"indent + {step} AS slot_col",
        "doc_tail",
    )
