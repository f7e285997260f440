import ast
import glob
import os

from codeloom.operators.diff import changed_lines
from codeloom.operators.lines import cluster_files
from codeloom.operators.rewrite import new_side
from codeloom.operators.structure import changed_functions, doc_slots, functions, logical_lines, with_code


def by_name(rows):
    return {r.name: r for r in rows.collect()}


def test_standard_library_spans_and_docs(spark):
    """Spans and docs of the standard library, told apart by the language's own parser."""
    folder = os.path.dirname(ast.__file__)
    rows, truth = [], {}
    for path in sorted(glob.glob(f"{folder}/[a-d]*.py") + glob.glob(f"{folder}/asyncio/*.py")):
        text = open(path, encoding="utf-8", errors="replace").read()
        if "\x0c" in text:
            continue
        rows.append((0, path, text))
        lines = text.split("\n")
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = node.body[0]
                doc = None
                if (
                    isinstance(first, ast.Expr)
                    and isinstance(first.value, ast.Constant)
                    and isinstance(first.value.value, str)
                    and first.lineno > node.lineno
                ):
                    doc = "\n".join(lines[first.lineno - 1 : first.end_lineno]).strip()
                truth[path, node.lineno] = (node.name, node.end_lineno, doc)
    df = spark.createDataFrame(rows, "rev bigint, path string, content string")
    found = {(r.path, r.start_ln): r for r in functions(cluster_files(df)).collect()}
    assert found.keys() == truth.keys()
    assert [k for k in truth if (found[k].name, found[k].end_ln) != truth[k][:2]] == []
    # A comment ahead of the string is the doc then, as it comes first in the body.
    docs = [k for k in truth if found[k].doc != truth[k][2] and not (found[k].doc or "").startswith("#")]
    assert docs == []


QUIRKS = '''\
@wrap
def decorated(a,
              b=")",
):
    # first
    # second
    return a

async def g():
    \'\'\'Holds """ and # signs
    over two lines\'\'\'
    x = """
def not_a_function():
    """
    return x

def one_line(): return 1
class C:
    def m(self):
        'single'

        def inner():
            return {
                "k": [1,
2],
            }
        return inner
    def m(self):
        r"""raw"""  # tail
        pass
def joined():
    "a" "b"
'''


def test_quirks(files):
    rows = {r.qualname: r for r in functions(files(f=QUIRKS), qualified=True).collect()}
    assert set(rows) == {"decorated", "g", "one_line", "C.m", "C.m.inner", "C.m#2", "joined"}
    decorated = rows["decorated"]
    assert (decorated.start_ln, decorated.header_end_ln, decorated.end_ln) == (2, 4, 7)
    assert decorated.doc == "# first\n    # second"
    assert rows["g"].key == "async def g" and (rows["g"].start_ln, rows["g"].end_ln) == (9, 15)
    assert rows["g"].doc == "\'\'\'Holds \"\"\" and # signs\n    over two lines\'\'\'"
    assert (rows["one_line"].start_ln, rows["one_line"].end_ln, rows["one_line"].doc) == (17, 17, None)
    assert (rows["C.m"].end_ln, rows["C.m"].doc) == (27, "'single'")
    assert (rows["C.m.inner"].start_ln, rows["C.m.inner"].end_ln) == (22, 26)
    assert (rows["C.m#2"].doc, rows["C.m#2"].doc_tail) == ('r"""raw"""', "  # tail")
    assert rows["joined"].doc is None


CHAINS = """class A:
    if True:
        def f(self):
            pass
    class B:
        def f(self):
            def g():
                pass
            return g
if True:
    def f():
        pass
class D:
  class B:
     async def f(self): pass
  def f(self): pass
def f(): pass
"""


def test_names_of_all_owners(files):
    names = [r.qualname for r in functions(files(f=CHAINS), qualified=True).orderBy("start_ln").collect()]
    assert names == ["A.f", "A.B.f", "A.B.f.g", "f", "D.B.f", "D.f", "f#2"]


def test_suspect_files_are_flagged(files):
    rows = logical_lines(files(good="x = (1,\n  2)\n", open_bracket="x = (1\n", open_quote='x = """a\ny = 1\n')).collect()
    assert {r.path: r.suspect for r in rows} == {"good": False, "open_bracket": True, "open_quote": True}
    assert [(r.start_ln, r.end_ln) for r in rows if r.path == "good"] == [(1, 2)]


def test_nested_change_counts_for_both(pairs):
    old = "def outer():\n    def inner():\n        return 1\n    return inner\n\ndef other():\n    return 2\n"
    df = pairs(f=(old, old.replace("return 1", "return 3")), only_deleted=(old, old.replace("    return 2\n", "    pass\n", 0)))
    hit = by_name(changed_functions(functions(new_side(df)), changed_lines(df)))
    assert {n: r.mod_lines for n, r in hit.items()} == {"outer": [3], "inner": [3]}


def test_deletion_only_is_no_change(pairs):
    df = pairs(f=("def f():\n    a = 1\n    return 2\n", "def f():\n    return 2\n"))
    assert changed_functions(functions(new_side(df)), changed_lines(df)).count() == 0


def test_code_after_non_ascii_text(files):
    source = files(f="# é𝄞\nname = 'ü'\ndef f():\n    return 'ß'\n")
    assert with_code(functions(source), source).first().code == "def f():\n    return 'ß'"


def test_slots(files):
    source = files(f='def a():\n    """doc\n    """\n    return 1\ndef b(): return 2\nclass C:\n    def c(\n        self\n    ):\n        pass\n')
    slots = by_name(doc_slots(functions(source), source))
    assert {n: (s.slot_ln, s.replace_to_ln, s.slot_col) for n, s in slots.items()} == {"a": (2, 3, 4), "c": (10, 9, 8)}


def test_long_literals_do_not_exhaust_the_stack(files):
    text = "def f():\n    x = '" + "\\'a" * 50_000 + "'\n    y = [" + "'v', # c\n" * 20_000 + "]\n    return y\ndef g():\n    pass\n"
    found = by_name(functions(files(f=text)))
    assert (found["f"].end_ln, found["g"].start_ln) == (20_004, 20_005)
