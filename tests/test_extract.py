"""X-pass: parser edge files (FIXTURES §3) and the Spark projection."""

import random
import re

from corpusweave.functions.pyast import blocks, check_syntax, extract_file
from tests.conftest import sources_df


def chunks_of(rows):
    return [(r["chunk_type"], r["name"], r["class_name"], r["start_line"], r["end_line"])
            for r in rows if r["kind"] == "chunk"]


def calls_of(rows):
    return [(r["name"], r["pos"], r["text"]) for r in rows if r["kind"] == "call"]


def test_empty_and_comment_only_files():
    assert extract_file("a.py", b"") == []
    assert extract_file("a.py", b"# just a comment\n# another\n") == []


def test_syntax_error_and_bad_utf8_become_error_rows():
    rows = extract_file("a.py", b"def f(:\n  pass\n")
    assert [r["kind"] for r in rows] == ["error"] and "line 1" in rows[0]["error"]
    rows = extract_file("b.py", b"x = '\xff\xfe'\n")
    assert rows[0]["kind"] == "error" and "utf-8" in rows[0]["error"]


def test_async_def_decorated_class_nested_class():
    src = (b"import os\n"
           b"async def a():\n    await b()\n"
           b"@dec\nclass D:\n    pass\n"
           b"class C:\n    class Inner:\n        def m(self):\n            pass\n"
           b"    async def am(self):\n        pass\n")
    ch = chunks_of(extract_file("p/m.py", src))
    assert ("function_definition", "a", None, 1, 2) in ch
    assert ("class_definition", "C", "C", 6, 11) in ch
    assert ("function_definition", "am", "C", 10, 11) in ch
    assert not any(c[1] in ("D", "Inner", "m") for c in ch)
    mod = [c for c in ch if c[0] == "module_level"]
    # module span: from `import os` to the end of the decorated class (starts at '@')
    assert mod == [("module_level", "__module_level__", None, 0, 5)]


def test_decorated_method_not_chunked_but_its_calls_count_for_class():
    src = b"class S:\n    @property\n    def size(self):\n        return len(str(self))\n"
    rows = extract_file("s.py", src)
    assert chunks_of(rows) == [("class_definition", "S", "S", 0, 3)]
    assert calls_of(rows) == [("S", 0, "len"), ("S", 1, "str")]


def test_same_function_twice_and_future_import():
    src = b"from __future__ import annotations\nimport a.b as c, d\ndef f():\n    pass\ndef f():\n    g()\n"
    rows = extract_file("x.py", src)
    fs = [c for c in chunks_of(rows) if c[1] == "f"]
    assert [c[3] for c in fs] == [2, 4]
    imps = [(r["pos"], r["text"], r["modules"]) for r in rows if r["kind"] == "import"]
    assert imps == [(0, "import a.b as c, d", ["a", "d"])]


def test_non_ascii_before_call_uses_byte_offsets():
    src = "def f():\n    ä = 'ñ'; g(ä)\n".encode("utf-8")
    rows = extract_file("u.py", src)
    assert calls_of(rows) == [("f", 0, "g")]
    assert [r["content"] for r in rows if r["kind"] == "chunk"][0] == "def f():\n    ä = 'ñ'; g(ä)"


def test_one_line_if_and_nested_call_order():
    rows = extract_file("o.py", b"if x: f(g(1)).h(k())\n")
    assert chunks_of(rows) == [("module_level", "__module_level__", None, 0, 0)]
    assert [c[2] for c in calls_of(rows)] == ["f(g(1)).h", "f", "g", "k"]


def test_check_syntax_message():
    assert check_syntax("x = 1\n") == (True, "")
    ok, msg = check_syntax("def f(:\n")
    assert not ok and msg.endswith("at line 1")


def test_spark_tables_ids(spark):
    from corpusweave.operators import extract as X
    src = sources_df(spark, {"pkg/mod.py": b"import os\nclass A:\n    def run(self):\n        os.getcwd()\n"})
    x = X.extract(src)
    ch = {r["chunk_type"]: r for r in X.chunks(x).collect()}
    assert ch["class_definition"]["symbol_id"] == "pkg.mod.A"
    assert ch["function_definition"]["symbol_id"] == "pkg.mod.A.run"
    import hashlib
    assert ch["function_definition"]["chunk_id"] == hashlib.md5(b"pkg/mod.py::A.run").hexdigest()
    assert ch["module_level"]["symbol_id"] == "pkg.mod.__module_level__"
    calls = X.raw_calls(x).collect()
    assert {(r["caller"], r["raw_call"]) for r in calls} == {("pkg.mod.A", "os.getcwd"),
                                                             ("pkg.mod.A.run", "os.getcwd")}
    res = X.syntax_check  # X9 over a column
    from pyspark.sql import functions as F
    out = spark.createDataFrame([("x=1",), ("def (",)], "t string").select(res(F.col("t")).alias("r")).collect()
    assert out[0]["r"]["valid"] and not out[1]["r"]["valid"]


def _kinds(text, kind):
    return [r for r in extract_file("m.py", text if isinstance(text, bytes) else text.encode()) if r["kind"] == kind]


def test_broken_files_are_read_in_linear_time():
    import time
    shapes = ['print "x"\n' * 20000, "foo(\n" * 20000, "x = {\n" * 20000 + "def f():\n    pass\n", ("def f(:\n    pass\n") * 10000,
              'x = """\n' * 20000 + "y = (", 'a = "\\\n' * 20000, "'''" + "(\n" * 20000]
    for text in shapes:
        t0 = time.process_time()
        assert extract_file("m.py", text.encode())
        assert time.process_time() - t0 < 4, text[:20]  # a parse for each line of the rest took minutes


def test_broken_blocks_cost_themselves_only():
    text = ('import os\n\nX = 1\n# note\nprint "x"\nif X:\n    a()\nelif os:\n    b()\nelse:\n    c()\ntry:\n    d()\nexcept E:\n    e()\n'
            'finally:\n    f()\nY = 2\n')
    assert [r["error"] for r in _kinds(text, "error")] == ["Missing parentheses in call to 'print'. Did you mean print(...)? at line 5"]
    (chunk,) = _kinds(text, "chunk")
    assert (chunk["start_line"], chunk["end_line"], chunk["content"]) == (0, 17, text.rstrip("\n"))  # the source's own text, broken line included
    assert [r["text"] for r in _kinds(text, "call")] == ["a", "b", "c", "d", "e", "f"]


def test_broken_blocks_and_strings_brackets_joined_lines():
    text = ('S = """\ndef no():\n  x = (\n"""\nT = (1,\n2)\nU = 1 + \\\n2\n# ( " \'\nV = "(" + \'"""\'\nbad bad\ndef yes():\n    pass\n')
    assert [r["name"] for r in _kinds(text, "chunk")] == ["yes", "__module_level__"]
    assert len(_kinds(text, "error")) == 1
    # a bracket or text that never ends: what follows is read line by line
    assert [r["name"] for r in _kinds("x = (\ny = 1\n@d\ndef a():\n    pass\nclass B:\n    pass\n", "chunk")][0] == "B"
    assert "f" in [r["name"] for r in _kinds('x = """\ndef f():\n    pass\n', "chunk")]


def test_byte_order_mark_carriage_returns_and_null_bytes():
    for end in ("\r", "\r\n", "\n"):
        text = ("\ufeffé = 1\ndef f(x):\n    return g(é, h(x))\n" + 'print "x"\n').replace("\n", end)
        chunk = [r for r in _kinds(text, "chunk") if r["name"] == "f"][0]
        assert (chunk["start_line"], chunk["end_line"]) == (1, 2)
        assert chunk["content"] == f"def f(x):{end}    return g(é, h(x))"
        assert [r["text"] for r in _kinds(text, "call")] == ["g", "h"]
        assert len(_kinds(text, "error")) == 1
    assert [r["name"] for r in _kinds(b"def f():\n    pass\nx = '\x00'\n", "chunk")] == ["f"]


def test_too_deeply_nested_code_is_an_error_of_its_block():
    text = "def f():\n    pass\nX = " + "-" * 200_000 + "1\n"
    assert [r["name"] for r in _kinds(text, "chunk")] == ["f"] and len(_kinds(text, "error")) == 1
    ok, why = check_syntax("-" * 200_000 + "1")
    assert not ok and why


def test_blocks_cover_a_file_once():
    rng = random.Random(3)
    parts = ["def f():\n", "    pass\n", "x = (1,\n", "2)\n", '"""\n', "# c\n", "\n", "else:\n", "@d\n", "bad bad\n", "'\n", "\\\n", "y = 1\r", "]\r\n"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        got = blocks(text)
        assert all(a[2] == b[1] and a[0] < b[0] for a, b in zip(got, got[1:])) and (not got or got[-1][2] == len(text))
        for line, start, _ in got:
            assert len(re.findall(r"\r\n|\r|\n", text[:start])) == line
