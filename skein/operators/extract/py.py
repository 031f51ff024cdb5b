"""Python facts, from the standard library's syntax tree."""

from __future__ import annotations

import ast
from itertools import accumulate

from skein.operators.extract.lexer import LISTS, agreed
from skein.functions.identity import py_content_hash, py_entity_id


#: Share of bad bytes at which looking for a parse ends; files are rejected well below it.
GIVE_UP = 0.25


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = frozenset((*_FUNCTIONS, ast.ClassDef))
_IMPORTS = frozenset((ast.Import, ast.ImportFrom))
_STOPS = _DEFINITIONS | _IMPORTS | {ast.Call}
_LEAVES = frozenset((ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, type(None), str, int))
_PLAIN = frozenset(("ctx", "op", "ops", "id", "attr", "name", "type_comment", "simple", "is_async", "conversion"))
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


class _Fields(dict):
    """Fields by node type, found out once a type."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = out = tuple(self.find(kind))
        return out


_blocks = _Fields(lambda kind: (b for b in _BLOCKS if b in kind._fields and issubclass(kind, ast.stmt | ast.mod | ast.ExceptHandler | ast.match_case))).__getitem__
_blocks_back = _Fields(lambda kind: reversed(_blocks(kind))).__getitem__
#: Fields below which a call may stand, the last one first.
_below_back = _Fields(lambda kind: () if kind in _LEAVES else (k for k in reversed(kind._fields) if k not in _PLAIN)).__getitem__


def _statements(node: ast.AST) -> list[ast.AST]:
    """``node`` and the statements below it, in the order of ``ast.walk``; expressions hold none."""
    out = [node]
    for x in out:
        for block in _blocks(type(x)):
            out += getattr(x, block)
    return out


class _Walk:
    """Facts in the order of the text's nodes. Nothing but classes and functions inside one another is walked by recursion: how deep an
    expression is, or how long a chain of ``elif``, doesn't matter. What only lists that aren't asked for need is left out."""

    def __init__(self, repo: str, file: str, source: str, lists: tuple[str, ...] = LISTS):
        self.repo, self.file = repo, file
        self.raw = source.encode()
        self.starts = [0, *accumulate(map(len, self.raw.splitlines(keepends=True)))]
        self.out: dict[str, list] = {k: [] for k in LISTS}
        self.wants_entities, self.wants_refs = "entities" in lists, "refs" in lists
        self.wants_names = self.wants_entities or self.wants_refs
        self.wants_imports = "imports" in lists
        self.owner, self.scope, self.inside, self.local = "", "", False, set()
        self.types: dict[str, str] = {}
        self.attributes: dict[str, dict[str, str]] = {}
        self.observed: dict[ast.AST, tuple[list[tuple[ast.expr, str]], set[str]]] = {}

    def visit(self, *nodes: ast.AST) -> None:
        """All of ``nodes`` and what is below them."""
        todo = list(reversed(nodes))
        fields = _below_back if self.wants_refs else _blocks_back
        pop, push = todo.pop, todo.append
        while todo:
            node = pop()
            kind = type(node)
            if kind in _STOPS:
                if kind is ast.Call:
                    self.visit_Call(node)
                elif kind in _IMPORTS:
                    if self.wants_imports:
                        self.visit_Import(node) if kind is ast.Import else self.visit_ImportFrom(node)
                    continue
                elif self.wants_names:
                    self.visit_ClassDef(node) if kind is ast.ClassDef else self.visit_FunctionDef(node)
                    continue
            for name in fields(kind):
                below = getattr(node, name)
                if type(below) is list:
                    todo += below[::-1]
                elif type(below) not in _LEAVES:
                    push(below)

    def anchor(self, node: ast.AST) -> dict:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return {"file": self.file, "start_byte": a, "end_byte": b, "start_line": node.lineno, "end_line": node.end_lineno, "content_hash": py_content_hash(self.raw[a:b].decode(errors="replace"))}

    def entity(self, kind: str, name: str, node: ast.AST, disambiguator: str = "") -> str:
        qualified = f"{self.file}#{self.owner}.{name}" if self.owner and kind != "Class" else f"{self.file}#{name}"
        ident = py_entity_id(self.repo, kind, qualified, disambiguator)
        if self.wants_entities:
            self.out["entities"].append({"entity_id": ident, "kind": kind, "qualified": qualified, "name": name, "owner": self.owner if kind != "Class" else "", "anchor": self.anchor(node)})
        return ident

    def ref(self, node: ast.AST, kind: str, name: str, member: str = "", scope: str = "unqualified", receiver: str = "", src: str | None = None) -> None:
        self.out["refs"].append({
            "kind": kind, "src": self.scope if src is None else src, "scope": scope, "module": "", "name": name, "member": member, "receiver_type": receiver,
            "start_byte": self.starts[node.lineno - 1] + node.col_offset, "start_line": node.lineno,
        })

    def bind(self, local: str, source: str, imported: str = "", namespace: bool = False) -> None:
        self.out["imports"].append({"local_name": local, "source": source, "imported_name": imported, "is_namespace": namespace, "is_default": False})

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.bind(a.asname or a.name.partition(".")[0], a.name if a.asname else a.name.partition(".")[0], namespace=True)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            if a.name != "*":
                self.bind(a.asname or a.name, "." * node.level + (node.module or ""), a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self.entity("Class", node.name, node) if not self.inside else ""
        for b in node.bases if self.wants_refs else ():
            if isinstance(b, ast.Name):
                self.ref(b, "extends", b.id, src=own)
            elif isinstance(b, ast.Attribute) and isinstance(b.value, ast.Name):
                self.ref(b, "extends", b.value.id, b.attr, "qualified", src=own)
        before, self.owner = self.owner, node.name
        if self.wants_refs:
            self.attributes[node.name] = self.attributes_of(node)
        self.visit(*node.body)
        self.owner = before

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        if self.inside:  # a function inside a function is a local name
            self.visit(*node.body)
            return
        arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        count = len(arguments) + bool(node.args.vararg) + bool(node.args.kwarg)
        kind = "Test" if node.name.startswith("test_") else "Method" if self.owner else "Function"
        own = self.entity(kind, node.name, node, "" if kind == "Test" else f"arity:{count}")
        if self.wants_refs:
            self.visit(*node.decorator_list)
        before = self.scope, self.inside, self.local, self.types
        self.scope, self.inside = own, True
        if self.wants_refs:
            found, self.local = self.observe(node)
            typed = [(a.arg, _annotated(a)) for a in arguments if a.annotation]
            self.types = agreed([t for t in typed if t[1]] + [(t.id, k) for t, k in found if k and k[0] != "=" and isinstance(t, ast.Name)])
        if self.wants_refs or self.wants_imports:  # entities don't stand in functions
            self.visit(*node.body)
        self.scope, self.inside, self.local, self.types = before

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.ref(f, "call", f.id, scope="local" if f.id in self.local else "unqualified")
        elif isinstance(f, ast.Attribute):
            o = f.value
            if isinstance(o, ast.Name):
                self.ref(f, "call", o.id, f.attr, "qualified", self.owner if o.id == "self" and self.owner else self.types.get(o.id, ""))
            elif isinstance(o, ast.Attribute) and isinstance(o.value, ast.Name) and o.value.id == "self":
                self.ref(f, "call", o.attr, f.attr, "qualified", self.attributes.get(self.owner, {}).get(o.attr, ""))

    def observe(self, function: ast.AST) -> tuple[list[tuple[ast.expr, str]], set[str]]:
        """What is assigned in a function: targets and types (``=`` before a name that is assigned); and the functions inside it."""
        if function not in self.observed:
            found, local = [], set()
            for x in _statements(function):
                kind = type(x)
                if kind is ast.Assign:
                    if len(x.targets) == 1:
                        v = x.value
                        called = v.func.id if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id[:1].isupper() else ""
                        found.append((x.targets[0], called or (f"={v.id}" if isinstance(v, ast.Name) else "")))
                elif kind is ast.AnnAssign:
                    if isinstance(x.annotation, ast.Name):
                        found.append((x.target, x.annotation.id))
                elif kind in _FUNCTIONS and x is not function:
                    local.add(x.name)
            self.observed[function] = found, local
        return self.observed[function]

    def attributes_of(self, cls: ast.ClassDef) -> dict[str, str]:
        """Types of ``self.x``: constructed, annotated, or taken from a typed parameter of the same function."""
        typed = []
        for f in cls.body:
            if type(f) in _FUNCTIONS:
                params = {a.arg: _annotated(a) for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]}
                for t, k in self.observe(f)[0]:
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        kind = params.get(k[1:], "") if k[:1] == "=" else k
                        if kind:
                            typed.append((t.attr, kind))
            elif isinstance(f, ast.AnnAssign) and isinstance(f.target, ast.Name) and isinstance(f.annotation, ast.Name):
                typed.append((f.target.id, f.annotation.id))
        return agreed(typed)


def _annotated(a: ast.arg) -> str:
    return a.annotation.id if isinstance(a.annotation, ast.Name) else a.annotation.value if isinstance(a.annotation, ast.Constant) and isinstance(a.annotation.value, str) else ""


class Parsed:
    """Facts of a file of which some lines may have been left out."""

    def __init__(self, walk: _Walk, error_ratio: float):
        self.walk, self.error_ratio = walk, error_ratio

    def facts(self) -> dict[str, list]:
        return self.walk.out


def _tree(source: str) -> tuple[ast.Module, float]:
    """The tree and the share of bytes left out: lines that don't parse become blanks of their length, so that places stay."""
    try:
        return ast.parse(source + "\n"), 0.0
    except SyntaxError:
        raw, lines, lost = source.encode(), [f"{x}\n" for x in source.split("\n")], 0
    while True:
        try:
            return ast.parse("".join(lines)), lost / max(1, len(raw))
        except SyntaxError as e:
            at = min(e.lineno or len(lines), len(lines)) - 1
            while at >= 0 and not lines[at].strip():
                at -= 1
            if at < 0:
                raise
            bare = lines[at].rstrip("\r\n")
            lost += len(bare.strip().encode())
            if lost > GIVE_UP * len(raw):
                raise
            lines[at] = " " * len(bare.encode()) + lines[at][len(bare) :]


def extract(repo: str, file: str, source: str, lists: tuple[str, ...] = LISTS) -> Parsed:
    tree, errors = _tree(source)
    walk = _Walk(repo, file, source, lists)
    walk.visit(tree)
    return Parsed(walk, errors)
