from codeloom.operators.rewrite import apply_insertions, restore_comments, strip_changed_comments, strip_comments
from codeloom.operators.structure import doc_slots, functions

DOCS = '''\
def a():
    """Doc a."""
    return 1

def b():
    """
    Doc b.
    """
    return 2
'''
BARE = "def a():\n    return 1\n\ndef b():\n    return 2\n"


def content(df):
    return {r.path: r.content for r in df.collect()}


def test_strip_appends_a_line_break(files):
    assert content(strip_comments(files(f=DOCS, bare=BARE))) == {"f": BARE + "\n", "bare": BARE + "\n"}


def test_strip_marks_emptied_functions(files):
    rows = strip_comments(files(whole='def f():\n    "doc"\n', part=DOCS)).collect()
    assert {r.path: (r.content, r.leaves_empty) for r in rows} == {
        "whole": ("def f():\n\n", True),
        "part": (BARE + "\n", False),
    }


def test_strip_changed_leaves_other_docs(pairs):
    df = pairs(f=(DOCS, DOCS.replace("return 2", "return 3")))
    expected = DOCS.replace('    """\n    Doc b.\n    """\n', "").replace("return 2", "return 3") + "\n"
    assert content(strip_changed_comments(df)) == {"f": expected}


def test_restore_puts_docs_back(pairs):
    cleaned = BARE.replace("return 2", "return 3") + "\n"
    restored = content(restore_comments(pairs(f=(DOCS, cleaned))))
    assert restored == {"f": DOCS.replace("return 2", "return 3")}


def test_restore_skips_deleted_functions(pairs):
    restored = content(restore_comments(pairs(f=(DOCS, "def b():\n    return 2\n"))))
    assert restored == {"f": 'def b():\n    """\n    Doc b.\n    """\n    return 2'}


def test_insertions(spark, files):
    source = files(f='def a():\n    return 1\n\ndef b():\n    """old"""  # tail\n    return 2\n')
    slots = doc_slots(functions(source), source).selectExpr("*", "concat('\"\"\"New ', name, '.\\n    More.\"\"\"') AS comment")
    assert content(apply_insertions(source, slots)) == {
        "f": 'def a():\n    """New a.\n    More."""\n    return 1\n\n'
        'def b():\n    """New b.\n    More."""\n      # tail\n    return 2\n'
    }
    indented = content(apply_insertions(source, slots.where("name = 'a'"), indent_all=True))["f"]
    assert '    """New a.\n        More."""\n' in indented


def test_insert_then_strip_is_strip(files):
    source = files(f=DOCS)
    slots = doc_slots(functions(source), source).selectExpr("*", "'\"\"\"New.\"\"\"' AS comment")
    documented = apply_insertions(source, slots, gap_line=False)
    assert content(strip_comments(documented)) == content(strip_comments(source))
    assert "    \n" in content(apply_insertions(source, slots))["f"]


def test_restore_tells_methods_of_classes_apart(pairs):
    old = 'class A:\n    def __init__(self):\n        """Of A."""\n        self.x = 1\n\nclass B:\n    def __init__(self):\n        """Of B."""\n        self.y = 2\n'
    new = 'class B:\n    def __init__(self):\n        self.y = 2\n'
    (row,) = restore_comments(pairs(m=(old, new))).collect()
    assert row.content == 'class B:\n    def __init__(self):\n        """Of B."""\n        self.y = 2'
