"""Changed functions of edited standard-library files whose truth is known from the language's own parser."""

import ast
import difflib
import glob
import os
import random

from codeloom.operators.diff import changed_lines, line_changes
from codeloom.operators.lines import cluster_files
from codeloom.operators.rewrite import new_side
from codeloom.operators.structure import changed_functions, functions


def defs(text):
    return [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def move(rng, text):
    """The text with one function of its outermost level moved before another one."""
    lines, nodes = text.split("\n"), [n for n in ast.parse(text).body if isinstance(n, ast.FunctionDef) and not n.decorator_list]
    if len(nodes) < 3:
        return text
    node, other = rng.sample(nodes, 2)
    block, at = lines[node.lineno - 1 : node.end_lineno], other.lineno - 1
    if at >= node.end_lineno:
        lines[at:at] = [*block, ""]
        del lines[node.lineno - 1 : node.end_lineno]
    else:
        del lines[node.lineno - 1 : node.end_lineno]
        lines[at:at] = [*block, ""]
    return "\n".join(lines)


def edit(rng, text):
    """The text with up to three functions edited, deleted, copied or documented."""
    lines, below = text.split("\n"), 10**9
    bodies = [n for n in defs(text) if n.body[0].lineno > n.lineno]
    for node in sorted(rng.sample(bodies, min(len(bodies), rng.randint(1, 3))), key=lambda n: -n.lineno):
        if node.end_lineno >= below:
            continue
        below, first = node.lineno, node.body[0]
        pad, own = " " * first.col_offset, lines[node.lineno - 1 : node.end_lineno]
        kind = rng.choice(["edit", "edit", "delete", "copy", "doc"])
        if kind == "edit":
            at = rng.choice(node.body).lineno - 1
            lines[at:at] = [f"{pad}x_{rng.randint(0, 999)} = 1"]
        elif kind == "delete":
            del lines[node.lineno - 1 : node.end_lineno]
        elif kind == "copy":
            own[0] = own[0].replace(node.name, f"{node.name}_copy", 1)
            lines[node.end_lineno : node.end_lineno] = ["", *own]
        else:
            lines[first.lineno - 1 : first.lineno - 1] = [f'{pad}"""', f"{pad}New doc.", f'{pad}"""']
    return "\n".join(lines)


def code_of(text):
    lines = text.split("\n")
    return {n.lineno: "\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in defs(text)}


def edited_files(change):
    """Pairs of every parsed library file before and after an edit, and the changed functions' lines."""
    rng, rows, truth = random.Random(7), [], {}
    for path in sorted(glob.glob(os.path.dirname(ast.__file__) + "/*.py")):
        old = open(path, encoding="utf-8", errors="replace").read()
        try:
            new = change(rng, old)
            before, after = code_of(old), code_of(new)
        except (SyntaxError, ValueError):
            continue
        if "\x0c" not in old and before:
            known = set(before.values())
            truth[path] = {ln for ln, code in after.items() if code not in known}
            rows.append((path, 1, old, new))
    return rows, truth


SCHEMA = "path string, rev bigint, old_content string, new_content string"


def test_changed_functions_are_the_edited_ones(spark):
    rows, truth = edited_files(edit)
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {path: set() for path in truth}
    for r in changed_functions(functions(cluster_files(new_side(df))), changed_lines(df)).select("path", "start_ln").collect():
        found[r.path].add(r.start_ln)
    right = sum(found[p] == truth[p] for p in truth)
    assert len(truth) > 100 and right / len(truth) > 0.85


def test_a_moved_function_is_all_that_changes(spark):
    """Of a file in which one function moved, hardly more lines are reported than by Python's difflib, which reads whole files."""
    rows, _ = edited_files(move)
    rows = [r for r in rows if r[2] != r[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    found = {r.path: r["count"] for r in line_changes(df).groupBy("path").count().collect()}
    worse = 0
    for path, _, old, new in rows:
        edits = difflib.SequenceMatcher(None, old.splitlines(), new.splitlines(), False).get_opcodes()
        least = sum(o[2] - o[1] + o[4] - o[3] for o in edits if o[0] != "equal")
        worse += found.get(path, 0) > least + 4
    assert len(rows) > 40 and worse / len(rows) < 0.1, (worse, len(rows))
