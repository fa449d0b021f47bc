"""Per-file Python source analysis with the standard ``ast`` module.

This is the small per-row helper behind the one ``mapInPandas`` extraction
pass: it turns one file's bytes into tagged rows (chunks, imports, calls,
errors).  All joining, ranking and resolution happens in Spark.

Positions: ``ast`` columns are UTF-8 byte offsets, so text is sliced from the
encoded bytes.  Lines are reported 0-based.
"""

from __future__ import annotations

import ast
import re

from corpusweave.config import MODULE_LEVEL_NAME

CLASS, FUNC, MODULE = "class_definition", "function_definition", "module_level"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


class _Src:
    def __init__(self, data: bytes):
        self.data = data
        # the parser's line ends: LF, CR LF and CR
        self.line_start = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", data))]

    def off(self, lineno: int, col: int) -> int:
        return self.line_start[lineno - 1] + col

    def start(self, node) -> int:
        """Start byte; a decorated definition starts at its first ``@``."""
        decos = getattr(node, "decorator_list", None)
        if decos:
            d = decos[0]
            pos = self.off(d.lineno, d.col_offset)
            at = self.data.rfind(b"@", self.line_start[d.lineno - 1], pos)
            return at if at >= 0 else pos
        return self.off(node.lineno, node.col_offset)

    def start_line(self, node) -> int:
        decos = getattr(node, "decorator_list", None)
        return (decos[0].lineno if decos else node.lineno) - 1

    def end(self, node) -> int:
        return self.off(node.end_lineno, node.end_col_offset)

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].decode("utf-8")


def _pos_key(node):
    if hasattr(node, "lineno"):
        return (node.lineno, node.col_offset)
    for sub in ast.walk(node):
        if hasattr(sub, "lineno"):
            return (sub.lineno, sub.col_offset)
    return (1 << 30, 0)


def _preorder(node):
    """Nodes in source (pre-)order, like a concrete syntax tree walk."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        kids = sorted(ast.iter_child_nodes(n), key=_pos_key)
        stack.extend(reversed(kids))


def calls_in(nodes, src: _Src) -> list[str]:
    """Callee text of every call expression under ``nodes``, pre-order."""
    out = []
    for top in nodes:
        for n in _preorder(top):
            if isinstance(n, ast.Call):
                out.append(src.text(src.off(n.func.lineno, n.func.col_offset),
                                    src.off(n.func.end_lineno, n.func.end_col_offset)))
    return out


def imports_in(body: list, src: _Src) -> list[tuple[str, list[str], int]]:
    """(statement text, top-level module names, level) of every import
    statement, in document order; ``from __future__`` is not an import here."""
    out = []
    for n in (n for top in body for n in _preorder(top)):
        if isinstance(n, ast.Import):
            mods = [a.name.split(".")[0] for a in n.names]
            out.append((src.text(src.start(n), src.end(n)), mods, 0))
        elif isinstance(n, ast.ImportFrom):
            if n.module == "__future__" and n.level == 0:
                continue
            mods = [n.module.split(".")[0]] if (n.module and n.level == 0) else []
            out.append((src.text(src.start(n), src.end(n)), mods, n.level))
    return out


def check_syntax(text: str | None) -> tuple[bool, str]:
    """(valid, "<msg> at line <n>")."""
    if text is None:
        return False, "no source"
    try:
        ast.parse(text)
        return True, ""
    except SyntaxError as e:
        return False, f"{e.msg} at line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:  # e.g. null bytes, too deeply nested
        return False, f"{str(e) or type(e).__name__} at line None"


#: What decides where a top-level block may end: comments, strings, brackets, line ends and joined lines. Possessive, so that
#: no text is scanned twice; an unclosed string is its opening quotes alone.
_MARKS = re.compile(
    r"""(?P<comment>\#[^\r\n]*)"""
    r"""|(?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*+\"\"\"|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\')|(?P<open>\"\"\"|\'\'\')"""
    r"""|(?P<short>"(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*+')"""
    r"""|(?P<joined>\\(?:\r\n|\r|\n))|(?P<line>\r\n|\r|\n)|(?P<up>[(\[{])|(?P<down>[)\]}])""", re.S)
#: A line that begins a block (not indented, empty, a comment or a closing bracket), one that goes on with the block before it,
#: and one that no open bracket can hold.
_START = re.compile(r"[^\s#)\]}]")
_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b")
_NEVER_INSIDE = re.compile(r"(?:def|class|import|async\s+def)\s|@\w")


def blocks(text: str) -> list[tuple[int, int, int]]:
    """Top-level blocks (first line from 0, start, end) in one pass over the text.

    Strings, brackets and joined lines keep a block together. After a string or bracket that never ends, nothing tells what is
    inside, so from its block on every line that may begin a block does."""
    starts = [(0, 0)] if _START.match(text) else []
    line, depth, apart = 0, 0, True
    for m in _MARKS.finditer(text):
        kind = m.lastgroup
        if kind == "up":
            depth += 1
        elif kind == "down":
            depth = max(0, depth - 1)
        elif kind == "open":
            apart = False
            break
        elif kind in ("string", "short", "joined"):
            line += len(re.findall(r"\r\n|\r|\n", m.group())) if "\n" in m.group() or "\r" in m.group() else 0
        elif kind == "line":
            line += 1
            if depth and _NEVER_INSIDE.match(text, m.end()):
                depth = 0
            if not depth and _START.match(text, m.end()):
                starts.append((line, m.end()))
    if not apart or depth:  # the same after a bracket that never closes
        line, at = starts.pop() if starts else (0, 0)
        starts += [(line, at)] if _START.match(text, at) else []
        for m in re.finditer(r"\r\n|\r|\n", text[at:]):
            line += 1
            if _START.match(text, at + m.end()):
                starts.append((line, at + m.end()))
    merged: list[tuple[int, int]] = []
    decorated = False
    for line, at in starts:
        # decorators belong to the definition below them
        if not decorated and not (merged and _GOES_ON.match(text, at)):
            merged.append((line, at))
        decorated = text[at] == "@"
    return [(line, at, end) for (line, at), end in zip(merged, [at for _, at in merged[1:]] + [len(text)])]


def parse_tolerant(text: str) -> tuple[list, list[str]]:
    """Top-level nodes of all blocks that parse, and an error for each that does not; each block is parsed once."""
    nodes, errors = [], []
    for line, start, end in blocks(text):
        try:
            tree = ast.parse(text[start:end])
        except SyntaxError as e:
            errors.append(f"{e.msg} at line {(e.lineno or 1) + line}")
        except (ValueError, RecursionError, MemoryError) as e:
            errors.append(f"{str(e) or type(e).__name__} at line {line + 1}")
        else:
            nodes += ast.increment_lineno(tree, line).body
    return nodes, errors


def extract_file(path: str, data: bytes) -> list[dict]:
    """All tagged rows for one file (X1-X4, X7, X8, parse errors).

    A file that does not parse is cut into top-level blocks: each broken one gives an error row and all others give what they
    hold, with the places and the text of the file itself."""
    rows: list[dict] = []
    data = data.removeprefix(b"\xef\xbb\xbf")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        return [{"kind": "error", "path": path, "error": f"invalid utf-8: {e.reason} at byte {e.start}"}]
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        body, errors = parse_tolerant(text)
        rows += [{"kind": "error", "path": path, "error": e} for e in errors]
    src = _Src(data)

    def chunk(ctype, name, cls, a, b, la, lb, call_nodes):
        rows.append({"kind": "chunk", "path": path, "chunk_type": ctype, "name": name,
                     "class_name": cls, "start_line": la, "end_line": lb,
                     "content": src.text(a, b)})
        for i, c in enumerate(calls_in(call_nodes, src)):
            rows.append({"kind": "call", "path": path, "chunk_type": ctype, "name": name,
                         "class_name": cls, "pos": i, "text": c})

    module_nodes = []
    for node in body:
        decorated = bool(getattr(node, "decorator_list", None))
        if isinstance(node, ast.ClassDef) and not decorated:
            chunk(CLASS, node.name, node.name, src.start(node), src.end(node),
                  node.lineno - 1, node.end_lineno - 1, [node])
            for m in node.body:
                if isinstance(m, _DEFS) and not m.decorator_list:
                    chunk(FUNC, m.name, node.name, src.start(m), src.end(m),
                          m.lineno - 1, m.end_lineno - 1, [m])
        elif isinstance(node, _DEFS) and not decorated:
            chunk(FUNC, node.name, None, src.start(node), src.end(node),
                  node.lineno - 1, node.end_lineno - 1, [node])
        else:
            module_nodes.append(node)
    if module_nodes:
        first, last = module_nodes[0], module_nodes[-1]
        a, b = src.start(first), src.end(last)
        # the span may enclose functions and classes between (kept as is)
        inside = [n for n in body if src.start(n) >= a and src.end(n) <= b]
        chunk(MODULE, MODULE_LEVEL_NAME, None, a, b, src.start_line(first),
              last.end_lineno - 1, inside)
    for i, (stmt, mods, level) in enumerate(imports_in(body, src)):
        rows.append({"kind": "import", "path": path, "pos": i, "text": stmt,
                     "modules": mods, "level": level})
    return rows
