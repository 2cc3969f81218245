"""Python sources to graph records, on the standard library's own parser.

Parsing runs on executors, one file at a time; a file that does not parse gives an error
record and leaves the others alone.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDS = (
    "record string, path string, id string, kind string, name string, parent_id string, first int, last int,"
    " body_line int, target string, receiver string, argc int, line int, role string, attrs string"
)
_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
#: Names that open routes, verbs of requests, and launchers of programs.
ROUTE_NAMES = ("route", "get", "post", "put", "delete", "patch", "websocket")
LAUNCHERS = ("run", "call", "check_call", "check_output", "Popen", "system", "execv", "spawnv")
PUBLISHERS = ("publish", "basic_publish", "send_message", "produce", "enqueue")
SUBSCRIBERS = ("subscribe", "consume", "basic_consume", "listen")
MUTATORS = ("append", "add", "update", "extend", "insert", "remove", "pop", "clear", "setdefault", "discard")


def module_name(path: str) -> str:
    name = path[:-3] if path.endswith(".py") else path
    name = name.removeprefix("src/")
    return name.removesuffix("/__init__").replace("/", ".")


def is_test_file(path: str) -> bool:
    base = path.rsplit("/", 1)[-1]
    return base.startswith("test_") or base.endswith("_test.py") or "/tests/" in f"/{path}"


class _Walk(ast.NodeVisitor):
    """Collects the records of one file."""

    def __init__(self, repo: str, path: str):
        self.repo, self.path = repo, path
        self.module = module_name(path)
        self.base = f"{repo}:python:{self.module}"
        self.scope: list[tuple[str, str]] = []  # (id, kind), outermost first
        self.seen: set[str] = set()
        self.out: list[dict] = []
        self.types: list[dict[str, str]] = [{}]

    def add(self, record: str, **values) -> None:
        self.out.append({"record": record, "path": self.path} | values)

    def owner(self) -> str:
        return self.scope[-1][0] if self.scope else f"{self.base}.<module>"

    def qualified(self, name: str) -> str:
        return f"{self.scope[-1][0]}.{name}" if self.scope else f"{self.base}.{name}"

    def enclosing_type(self) -> str | None:
        return next((i for i, k in reversed(self.scope) if k == "type"), None)

    def run(self, tree: ast.Module) -> None:
        file_id = f"{self.repo}:file:{self.path}"
        self.add("node", id=file_id, kind="file", name=self.path.rsplit("/", 1)[-1], first=1)
        calls = any(isinstance(n, ast.Call) for s in tree.body if not isinstance(s, (ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)) for n in ast.walk(s))
        main = any(isinstance(s, ast.If) and self.is_main(s.test) for s in tree.body)
        if calls or main:
            last = max((s.end_lineno or s.lineno for s in tree.body), default=1)
            self.add("node", id=f"{self.base}.<module>", kind="callable", name="<module>", parent_id=file_id, first=1, last=last, body_line=1)
        if main:
            self.add("node", id=f"{self.base}.<main>", kind="entry_point", name="<main>", parent_id=file_id, first=1, attrs='{"trigger": "cli"}')
        for s in tree.body:
            self.visit(s)

    @staticmethod
    def is_main(test: ast.expr) -> bool:
        return isinstance(test, ast.Compare) and isinstance(test.left, ast.Name) and test.left.id == "__name__"

    @staticmethod
    def dotted(node: ast.expr | None) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            inner = _Walk.dotted(node.value)
            return f"{inner}.{node.attr}" if inner else None
        if isinstance(node, ast.Subscript):
            return _Walk.dotted(node.value)
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        return None

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self.qualified(node.name)
        if own in self.seen:
            return
        self.seen.add(own)
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        attrs = {"visibility": "private" if node.name.startswith("_") else "public", "open_base": any(isinstance(b, ast.Call) for b in node.bases)}
        self.add("node", id=own, kind="type", name=node.name, parent_id=self.scope[-1][0] if self.scope else f"{self.repo}:file:{self.path}", first=first, last=node.end_lineno, attrs=json.dumps(attrs, sort_keys=True))
        for b in node.bases:
            if name := self.dotted(b):
                self.add("type_ref", id=own, target=name, role="base", line=b.lineno)
        self.scope.append((own, "type"))
        for s in node.body:
            if isinstance(s, (ast.Assign, ast.AnnAssign)):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name):
                        self.field(own, t.id, s.lineno)
            self.visit(s)
        self.scope.pop()

    def field(self, owner: str, name: str, line: int) -> None:
        own = f"{owner}.{name}"
        if own not in self.seen:
            self.seen.add(own)
            self.add("node", id=own, kind="field", name=name, parent_id=owner, first=line, last=line)

    def function(self, node) -> None:
        decorators = [self.dotted(d.func if isinstance(d, ast.Call) else d) or "" for d in node.decorator_list]
        if any(d.split(".")[-1] == "overload" for d in decorators):
            return
        own = self.qualified(node.name)
        if own in self.seen:
            return
        self.seen.add(own)
        method = bool(self.scope) and self.scope[-1][1] == "type"
        static = any(d.split(".")[-1] == "staticmethod" for d in decorators)
        args = [*node.args.posonlyargs, *node.args.args]
        bound = 1 if method and not static and args else 0
        most = 99 if node.args.vararg else len(args) - bound
        least = max(0, len(args) - bound - len(node.args.defaults))
        test = is_test_file(self.path) and node.name.startswith("test")
        attrs = {
            "argc_min": least,
            "argc_max": most,
            "fixture": any("fixture" in d for d in decorators),
            "params": [a.arg for a in args[bound:]],
            "static": static,
            "returns": self.dotted(node.returns),
        }
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        parent = self.scope[-1][0] if self.scope else f"{self.repo}:file:{self.path}"
        self.add("node", id=own, kind="test" if test else "callable", name=node.name, parent_id=parent, first=first, last=node.end_lineno, body_line=node.body[0].lineno, argc=len(args) - bound, attrs=json.dumps(attrs, sort_keys=True))
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTE_NAMES and d.args:
                route = d.args[0]
                if isinstance(route, ast.Constant) and isinstance(route.value, str) and route.value.startswith("/"):
                    method_ = "" if d.func.attr in ("route", "websocket") else d.func.attr.upper()
                    self.add("endpoint", id=own, kind="http", role="serve", target=route.value, name=method_, line=d.lineno)
        for a in args:
            if a.annotation and (name := self.dotted(a.annotation)):
                self.add("type_ref", id=own, target=name, role="param", line=a.lineno)
        if name := self.dotted(node.returns):
            self.add("type_ref", id=own, target=name, role="return", line=node.lineno)
        self.scope.append((own, "callable"))
        self.types.append({a.arg: n for a in args if a.annotation and (n := self.dotted(a.annotation))})
        for s in node.body:
            self.visit(s)
        self.types.pop()
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", id=f"{self.repo}:file:{self.path}", target=a.name, name=a.asname or a.name.split(".")[0], line=node.lineno)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        parts = self.module.split(".")
        base = ".".join(parts[: len(parts) - node.level]) if node.level else ""
        target = ".".join(x for x in (base, node.module or "") if x)
        for a in node.names:
            self.add("import", id=f"{self.repo}:file:{self.path}", target=target, receiver=a.name, name=a.asname or a.name, line=node.lineno)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self.stored(t, "w", node.lineno)
            if isinstance(t, ast.Name) and isinstance(node.value, ast.Call) and (name := self.dotted(node.value.func)) and name.split(".")[-1][:1].isupper():
                self.types[-1][t.id] = name
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.stored(node.target, "w", node.lineno)
        if isinstance(node.target, ast.Name) and (name := self.dotted(node.annotation)):
            self.types[-1][node.target.id] = name
        if node.value:
            self.visit(node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.stored(node.target, "rw", node.lineno)
        self.visit(node.value)

    def stored(self, target: ast.expr, access: str, line: int) -> None:
        if isinstance(target, ast.Attribute):
            receiver = self.dotted(target.value) or "?"
            if receiver == "self" and (owner := self.enclosing_type()):
                self.field(owner, target.attr, line)
            self.use(target, access)
        elif isinstance(target, ast.Subscript):
            if isinstance(target.value, ast.Attribute):
                self.use(target.value, "rw")
            else:
                self.visit(target.value)
            self.visit(target.slice)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.stored(t, access, line)

    def use(self, node: ast.Attribute, access: str) -> None:
        receiver = self.dotted(node.value) or "?"
        self.add("field_use", id=self.owner(), name=node.attr, receiver=receiver, target=self.enclosing_type() if receiver == "self" else self.type_of(receiver), role=access, line=node.lineno)
        if not isinstance(node.value, ast.Name):
            self.visit(node.value)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.use(node, "r")

    def type_of(self, name: str) -> str | None:
        return next((t[name] for t in reversed(self.types) if name in t), None)

    def visit_Call(self, node: ast.Call) -> None:
        f, argc = node.func, len(node.args) + len(node.keywords)
        if isinstance(f, ast.Name):
            self.add("call", id=self.owner(), name=f.id, argc=argc, line=node.lineno, target=self.enclosing_type())
        elif isinstance(f, ast.Attribute):
            inner = self.dotted(f.value)
            if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id == "super":
                receiver, kind = "base", self.enclosing_type()
            elif inner == "self":
                receiver, kind = "this", self.enclosing_type()
            else:
                receiver = inner or "?"
                kind = self.type_of(receiver) if inner else None
            self.add("call", id=self.owner(), name=f.attr, receiver=receiver, argc=argc, line=node.lineno, target=kind)
            if f.attr in MUTATORS and isinstance(f.value, ast.Attribute):
                self.use(f.value, "rw")
            elif not isinstance(f.value, ast.Name):
                self.visit(f.value)
            first = node.args[0] if node.args else None
            literal = first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None
            if literal and f.attr in ROUTE_NAMES[1:6] and literal.startswith(("/", "http")):
                self.add("endpoint", id=self.owner(), kind="http", role="call", target=literal, name=f.attr.upper(), line=node.lineno)
            if literal and f.attr in (*PUBLISHERS, *SUBSCRIBERS):
                role = "publish" if f.attr in PUBLISHERS else "subscribe"
                heard = next((self.dotted(a) for a in [*node.args[1:], *(k.value for k in node.keywords)] if self.dotted(a)), None)
                self.add("endpoint", id=self.owner(), kind="queue", role=role, target=literal, name=heard if role == "subscribe" else None, line=node.lineno)
            if inner in ("subprocess", "os") and f.attr in LAUNCHERS:
                words = [c.value for c in ast.walk(node) if isinstance(c, ast.Constant) and isinstance(c.value, str)]
                self.add("endpoint", id=self.owner(), kind="process", role="spawn", target=" ".join(words), line=node.lineno)
        else:
            self.visit(f)
        if isinstance(f, ast.Name) and f.id == "open" and node.args and isinstance(node.args[0], ast.Constant):
            mode = next((k.value.value for k in node.keywords if k.arg == "mode" and isinstance(k.value, ast.Constant)), None)
            mode = mode or (node.args[1].value if len(node.args) > 1 and isinstance(node.args[1], ast.Constant) else "r")
            role = "write" if set(str(mode)) & set("wax+") else "read"
            self.add("endpoint", id=self.owner(), kind="file", role=role, target=str(node.args[0].value), line=node.lineno)
        for a in [*node.args, *(k.value for k in node.keywords)]:
            self.visit(a)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and len(node.value) <= 20_000:
            from weftgraph.sources.sql_strings import sql_tables

            for role, table in sql_tables(node.value):
                self.add("endpoint", id=self.owner(), kind="db", role=role, target=table, line=node.lineno)


def parse(repo: str, path: str, text: str) -> list[dict]:
    """The records of one file; a syntax error gives one record of its own."""
    walk = _Walk(repo, path)
    try:
        walk.run(ast.parse(text.removeprefix("﻿")))
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"record": "error", "path": path, "name": type(e).__name__, "attrs": str(e)}]
    return walk.out


def parse_files(files: DataFrame, repo: str = "repo") -> DataFrame:
    """Records of all Python files (path, text); one flat table, told apart by ``record``."""
    schema = pa.schema([(c, pa.int32() if c in ("first", "last", "body_line", "argc", "line") else pa.string()) for c in _COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(repo, path, text)
                if rows:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in _COLUMNS} for r in rows], schema)

    return files.filter(F.endswith("path", F.lit(".py")) & F.col("text").isNotNull()).select("path", "text").mapInArrow(run, RECORDS)


def part(records: DataFrame, record: str) -> DataFrame:
    return records.filter(F.col("record") == record)
