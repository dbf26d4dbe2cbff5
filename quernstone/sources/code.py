"""Source files as tables: nodes, edges, tests and control-flow blocks, by Python UDTFs over (path, code).

Parsing is the one thing that needs Python; each function is a small walk over one file's tree, and
everything after it is DataFrame work. A file that does not parse gives no rows, and parse_errors
tells which. Code is never run.
"""

from __future__ import annotations

import ast
import difflib
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Folders that hold no sources of their own.
SKIPPED = (".git", ".pytest_cache", "__pycache__", "venv", ".venv", "env", "build", "dist", "node_modules", ".tox", ".eggs")
#: Folders whose symbols are no candidates of a search.
NO_CANDIDATES = ("tests", "testing", "test", "docs", ".git", "venv", ".venv", "build", "dist", "packages", "vendor")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Nodes that hold statements.
HOLDERS = (ast.ClassDef, *FUNCTIONS, ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match, ast.ExceptHandler, ast.match_case)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, code and is_test of every Python file under root; names are filtered before contents are read. Malformed bytes become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    files = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED))) & ~F.exists(parts, lambda p: p.endswith(".egg-info")))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("code"), F.lower("path").contains("test").alias("is_test"))


def candidates(nodes: DataFrame, file: str | None = None) -> DataFrame:
    """Nodes that a search ranks: functions, methods and classes, of one file if it is given, outside folders of tests and of others' code."""
    out = nodes.where(F.col("kind").isin("FUNCTION", "METHOD", "CLASS"))
    if file is not None:
        out = out.where(F.col("path") == file)
    return out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, NO_CANDIDATES))))


def _tree(code: str | None):
    try:
        return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return None


def _named(node: ast.AST) -> str:
    """The last name of an expression: f, a.f and a.f() are all f."""
    if isinstance(node, ast.Call):
        node = node.func
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ""


def _defined(tree: ast.AST, path: str) -> Iterator[tuple[str, str, ast.AST, str]]:
    """(id, kind, node, id of what holds it) of each definition, outer ones first."""
    stack: list[tuple[ast.AST, str, bool]] = [(tree, path, False)]
    while stack:
        node, owner, in_class = stack.pop()
        for child in reversed(list(ast.iter_child_nodes(node))):
            if isinstance(child, (ast.ClassDef, *FUNCTIONS)):
                ident = f"{owner}.{child.name}" if ":" in owner else f"{owner}:{child.name}"
                kind = "CLASS" if isinstance(child, ast.ClassDef) else "METHOD" if in_class else "FUNCTION"
                yield ident, kind, child, owner
                stack.append((child, ident, kind == "CLASS"))
            else:
                stack.append((child, owner, in_class))


def _definitions(tree: ast.AST) -> list[ast.AST]:
    """All definitions at any depth, in the order of ast.walk; expressions hold none and are not visited."""
    out, todo = [], deque([tree])
    while todo:
        node = todo.popleft()
        if isinstance(node, (ast.ClassDef, *FUNCTIONS)):
            out.append(node)
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            inner = getattr(node, name, None)
            if isinstance(inner, list):
                todo.extend(x for x in inner if isinstance(x, HOLDERS))
    return out


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a definition without those of definitions inside it."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, (ast.ClassDef, *FUNCTIONS)):
            stack.extend(ast.iter_child_nodes(n))


@udtf(returnType="id string, name string, kind string, start_line int, end_line int, docstring string, signature string")
class ParseNodes:
    def eval(self, path: str, code: str):
        tree = _tree(code)
        if tree is None:
            return
        yield path, path, "FILE", 1, (code or "").count("\n") + 1, ast.get_docstring(tree), None
        for ident, kind, node, _ in _defined(tree, path):
            signature = f"({ast.unparse(node.args)})" if isinstance(node, FUNCTIONS) else None
            kind = "TEST" if kind != "CLASS" and node.name.startswith("test") else kind
            yield ident, node.name, kind, node.lineno, node.end_lineno, ast.get_docstring(node), signature


@udtf(returnType="src string, dst string, kind string, lineno int")
class ParseEdges:
    def eval(self, path: str, code: str):
        tree = _tree(code)
        if tree is None:
            return
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                yield from ((path, a.name, "IMPORTS", n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                yield from ((path, f"{n.module or ''}.{a.name}", "IMPORTS", n.lineno) for a in n.names)
        for ident, kind, node, owner in _defined(tree, path):
            yield owner, ident, "DEFINES", node.lineno
            yield from ((ident, f"symbol:{_named(x)}", "DECORATES", x.lineno) for x in node.decorator_list if _named(x))
            if kind == "CLASS":
                yield from ((ident, f"symbol:{_named(b)}", "INHERITS", node.lineno) for b in node.bases if _named(b))
                continue
            calls = "TESTS" if node.name.startswith("test") else "CALLS"
            for n in _own(node):
                if isinstance(n, ast.Call) and _named(n):
                    yield ident, f"symbol:{_named(n)}", calls, n.lineno
                elif isinstance(n, ast.Raise) and n.exc is not None and _named(n.exc):
                    yield ident, f"symbol:{_named(n.exc)}", "RAISES", n.lineno
                elif isinstance(n, ast.ExceptHandler) and n.type is not None:
                    kinds = n.type.elts if isinstance(n.type, ast.Tuple) else [n.type]
                    yield from ((ident, f"symbol:{_named(k)}", "CATCHES", n.lineno) for k in kinds if _named(k))


@udtf(returnType="id string, name string, start_line int, end_line int, assertions array<struct<line:int,code:string>>, symbols array<string>, fixtures array<string>")
class ParseTests:
    def eval(self, path: str, code: str):
        tree = _tree(code)
        if tree is None:
            return
        for ident, kind, node, _ in _defined(tree, path):
            if kind == "CLASS" or not node.name.startswith("test"):
                continue
            inner = list(_own(node))
            asserts = sorted((n.lineno, ast.unparse(n)) for n in inner if isinstance(n, ast.Assert) or isinstance(n, ast.Call) and _named(n).startswith("assert"))
            names = sorted({n.id for n in inner if isinstance(n, ast.Name)} | {n.attr for n in inner if isinstance(n, ast.Attribute)})
            yield ident, node.name, node.lineno, node.end_lineno, [{"line": x, "code": c} for x, c in asserts], names, [a.arg for a in node.args.args if a.arg != "self"]


@udtf(returnType="function string, block int, parent int, depth int, kind string, start_line int, end_line int, condition string")
class ParseBlocks:
    """Control flow as rows with parent pointers."""

    KINDS = {ast.If: "IF", ast.For: "LOOP", ast.AsyncFor: "LOOP", ast.While: "LOOP", ast.Try: "TRY", ast.With: "WITH", ast.AsyncWith: "WITH", ast.Return: "RETURN", ast.Raise: "RAISE", ast.ExceptHandler: "EXCEPT"}

    def eval(self, path: str, code: str):
        tree = _tree(code)
        if tree is None:
            return
        for ident, kind, node, _ in _defined(tree, path):
            if kind == "CLASS":
                continue
            number = 0
            stack = [(c, 0, 1) for c in reversed(node.body)]
            yield ident, 0, None, 0, "ENTRY", node.lineno, node.end_lineno, None
            while stack:
                n, parent, depth = stack.pop()
                if isinstance(n, (ast.ClassDef, *FUNCTIONS)):
                    continue
                label = self.KINDS.get(type(n))
                if label:
                    number += 1
                    test = getattr(n, "test", None) or getattr(n, "iter", None) or getattr(n, "exc", None) or getattr(n, "type", None)
                    yield ident, number, parent, depth, label, n.lineno, n.end_lineno, ast.unparse(test) if isinstance(test, ast.AST) else None
                    parent, depth = number, depth + 1
                stack.extend((c, parent, depth) for c in reversed(list(ast.iter_child_nodes(n))) if isinstance(c, (ast.stmt, ast.ExceptHandler)))


@udtf(returnType="function string, variable string, action string, line int")
class ParseState:
    """Reads and writes of names and attributes."""

    def eval(self, path: str, code: str):
        tree = _tree(code)
        if tree is None:
            return
        for ident, kind, node, _ in _defined(tree, path):
            if kind == "CLASS":
                continue
            for n in sorted((n for n in _own(node) if isinstance(n, (ast.Name, ast.Attribute))), key=lambda n: (n.lineno, n.col_offset)):
                yield ident, ast.unparse(n), "WRITE" if isinstance(n.ctx, (ast.Store, ast.Del)) else "READ", n.lineno


REVISION = "ok boolean, changed boolean, added long, deleted long, before array<string>, after array<string>, arguments map<string,array<string>>"


def revision(before: Column | str, after: Column | str) -> Column:
    """What a revision of a source file does, as REVISION: whether both texts parse, lines added and deleted, symbols before and after, and the new functions' arguments."""
    return F.pandas_udf(_revised, REVISION)(before, after)


def _revised(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    def one(old: str, new: str) -> tuple:
        a, b = (old or "").splitlines(), (new or "").splitlines()
        diff = [x[:3] for x in difflib.unified_diff(a, b, lineterm="")]
        added, deleted = (sum(x.startswith(c) and x != c * 3 for x in diff) for c in "+-")
        trees = _tree(old), _tree(new)
        if None in trees:
            return False, a != b, added, deleted, [], [], {}
        named = [_definitions(t) for t in trees]
        args = {n.name: [x.arg for x in (*n.args.args, *n.args.kwonlyargs)] for n in named[1] if isinstance(n, FUNCTIONS)}
        return True, a != b, added, deleted, sorted({n.name for n in named[0]}), sorted({n.name for n in named[1]}), args

    return pd.DataFrame([one(x, y) for x, y in zip(before, after)], columns=["ok", "changed", "added", "deleted", "before", "after", "arguments"])


def parsed(files: DataFrame, what) -> DataFrame:
    """The rows of one UDTF over files(path, code), with the path."""
    return files.select("path", "code").lateralJoin(what(F.col("path").outer(), F.col("code").outer())).drop("code")


def parse_errors(files: DataFrame) -> DataFrame:
    """Paths that gave no file node."""
    return files.join(parsed(files, ParseNodes).select("path").distinct(), "path", "left_anti").select("path")


def register(spark: SparkSession) -> None:
    """The UDTFs under SQL names."""
    for name, f in (("parse_nodes", ParseNodes), ("parse_edges", ParseEdges), ("parse_tests", ParseTests), ("parse_blocks", ParseBlocks), ("parse_state", ParseState)):
        spark.udtf.register(name, f)


def traceback_frames(log: Column) -> Column:
    """file, line and function of each frame of the sources, outermost first; frames of installed packages and of the runner are left out."""
    pattern = r'File "([^"]+)", line (\d+), in (\S+)'
    rows = F.arrays_zip(*[F.regexp_extract_all(log, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "file"), (2, "line"), (3, "name"))])
    return F.filter(rows, lambda x: ~x["file"].rlike("site-packages|<string>|pytest|/\\.tox/|^/opt/"))
