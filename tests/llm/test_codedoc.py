from __future__ import annotations

import ast
import textwrap

from traceloom.llm.codedoc import extract_pairs, functions, is_trivial

SOURCE = textwrap.dedent('''
    # File: a.py
    class Store(Base, metaclass=Meta):
        """A class, not a function."""

        # Read the rows that belong to one id.
        @retry(times=3,
               wait=2)
        def read(self, key=lambda x: x[0]) -> dict[str, list[int]]:  # noqa
            x = """
    def fake(y):
        "Not a function at all, only text."
    """
            # def old(x): return x
            return x

        async def write(
            self,
            path,  # see: here
        ):
            # a remark first
            r"""Write all rows
            to the path that is given.
            """
            def inner(a): "Returns what it was given, no more."; return a

            "left over note, not documentation"

        # Not attached, as an empty line follows.

        def bare(self): return 1

        class Deep:
            def f(self):
                "joined " "literals are one docstring"
    def tail(a, b={"x": (1, [2])}):
        f"""An f-string is no docstring."""
''')


def test_names_and_documentation():
    got = {f.name: f.description for f in functions(SOURCE)}
    assert got == {
        "Store.read": "Read the rows that belong to one id.",
        "Store.write": "Write all rows\nto the path that is given.",
        "Store.write.inner": "Returns what it was given, no more.",
        "Store.bare": "",
        "Store.Deep.f": "joined literals are one docstring",
        "tail": "",
    }


def test_ends_equal_the_compiler_and_line_ends_do_not_matter():
    want = {n.name: n.end_lineno for n in ast.walk(ast.parse(SOURCE)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    for text in (SOURCE, SOURCE.replace("\n", "\r\n"), SOURCE.replace("\n", "\r")):
        assert {f.name.rpartition(".")[2]: f.line_end for f in functions(text)} == want


def test_sources_that_do_not_compile():
    text = 'else:\n    pass\n\ndef ok(x):\n\t"""Says what it does here."""\n\treturn x\n\ndef broken(\n  # unclosed'
    assert [(f.name, f.description) for f in functions(text)][0] == ("ok", "Says what it does here.")
    assert functions('x = """never closed\ndef a():\n    pass') == []


def test_trivial():
    for doc in ("", "TODO", "TBD.", "n/a", "Two words", "_summary_", "[summary] of it all", "Args:\n    x: TYPE", "Reads the rows.", "todo: write this later please", "This method is called read_rows.", "<description of the function here>", "Insert docs."):
        assert is_trivial(doc, "read_rows"), doc
    for doc in ("Read the rows of one file.", "Liefert alle Zeilen der Datei.", "返回所有记录的列表", "Raises ValueError when rows are missing."):
        assert not is_trivial(doc, "read_rows"), doc


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "no functions, but def", "z"), (4, SOURCE, "q")]
    df = spark.createDataFrame(rows, "element_row long, body string, code string")
    assert {r.function_name for r in extract_pairs(df, "element_row").collect()} == {"Store.read", "Store.write", "Store.write.inner", "Store.Deep.f"}
    assert extract_pairs(df.limit(0), "element_row").collect() == []


def test_long_sources_are_quick():
    assert len(functions('def f():\n    """A documentation text."""\n    x = "s"\n' * 20_000)) == 20_000


def test_variables_in_prose_are_no_template():
    assert not is_trivial("Return the parsed value $HOME from env.", "parse") and not is_trivial("Expand {{ name }} in a page before it is sent.", "render")
    assert all(is_trivial(t, "f") for t in ("$DESCRIPTION", "{{ summary }}", "${what} goes here", "Returns {{ value }}", "$NAME: $SUMMARY", "<describe the function>"))
