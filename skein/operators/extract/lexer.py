"""Tokens with places and matched brackets, for languages with braces."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property
from itertools import accumulate, compress
from operator import itemgetter

from skein.functions.identity import py_content_hash, py_entity_id

#: What an extractor can be asked for.
LISTS = ("entities", "refs", "imports", "reexports", "ext_methods", "field_types")

_PATTERN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$@\u0080-￿][\w$\u0080-￿]*)|(?P<num>\d[\w.]*)"
    r"|(?P<str>\$?@?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<op>=>|:=|\?\.|\.\.\.|&&|\|\||[-+*/%&|^!=<>]=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*")
_OPEN, _CLOSE = "([{", ")]}"
_BRACKETS = frozenset(_OPEN + _CLOSE)
#: The same tokens without groups: ``findall`` gives them as plain strings, which join to the source again.
_WHOLE = re.compile(re.sub(r"\(\?P<\w+>", "(?:", _PATTERN.pattern), re.S)


class _Kinds(dict):
    """A token's kind by its first character, in the order in which the pattern tries them; empty for spaces; ``/`` for what may be a comment's start."""

    def __missing__(self, c: str) -> str:
        if c.isspace() or c == "/":
            kind = "/" if c == "/" else ""
        elif c in "\"'`":
            kind = "str"
        elif c in "_$@" or "A" <= c <= "Z" or "a" <= c <= "z" or "\x80" <= c <= "\uffff":
            kind = "name"
        else:
            kind = "num" if c.isdecimal() else "op"
        self[c] = kind
        return kind


_KIND_OF = _Kinds().__getitem__
_FIRST = itemgetter(0)


class _Lines:
    """The line of each token, looked up when it is asked for."""

    def __init__(self, source: str, ats: list[int]):
        self.source, self.ats, self.feeds = source, ats, None

    def __getitem__(self, i: int) -> int:
        if self.feeds is None:
            self.feeds = [m.start() for m in re.finditer("\n", self.source)]
        return bisect_left(self.feeds, self.ats[i]) + 1


#: Empty places behind the last token, which are also those before the first one: looking a few tokens ahead or back needs no check.
_MARGIN = ("",) * 64


class Unit:
    """A file's tokens by number, in columns (text; kind: name, num, str or op; place; line); ``match`` pairs brackets by token number.

    ``text`` and ``kind`` are the columns' own lookups, empty just before and behind the tokens. Of ``lists`` that aren't asked for, entities
    have no anchors and stay out, as references do."""

    def __init__(self, repo: str, file: str, lang: str, source: str, lists: tuple[str, ...] = LISTS):
        self.repo, self.file, self.lang, self.source = repo, file, lang, source
        self.wants_entities, self.wants_refs = "entities" in lists, "refs" in lists
        self.wants_types = self.wants_refs or "field_types" in lists
        self.match: dict[int, int] = {}
        self._plain, self._wide = source.isascii(), None
        self._scan()
        self.n = len(self.texts)
        self.texts += _MARGIN
        self.kinds += _MARGIN
        self.text, self.kind = self.texts.__getitem__, self.kinds.__getitem__
        self.entities: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.reexports: list[dict] = []
        self.ext_methods: list[dict] = []
        self.field_types: list[dict] = []
        self.scopes: list[tuple[int, int, str]] = []  # first and last token, entity
        self._scope_of: list[str] | None = None

    def _scan(self) -> None:
        """All tokens at once; a file with regular expressions, whose ends tell how to go on, token by token."""
        self._found = found = _WHOLE.findall(self.source)
        self._found_kinds = kinds = list(map(_KIND_OF, map(_FIRST, found)))
        i, divided = -1, False
        for _ in range(kinds.count("/")):
            i = kinds.index("/", i + 1)
            kinds[i] = "" if found[i][1:2] in ("/", "*") else "op"
            divided = divided or kinds[i] == "op"
        self.texts, self.kinds = list(compress(found, kinds)), list(filter(None, kinds))
        if self.lang == "ts" and divided:
            slashes = [i for i, t in enumerate(self.texts) if t[0] == "/"]
            if any(self._regex_may_start(i) and _REGEX.match(self.source, self.ats[i]) for i in slashes):
                self._scan_slowly()
        stack, wrong, texts, match = [], 0, self.texts, self.match
        for n in compress(range(len(texts)), map(_BRACKETS.__contains__, texts)):
            t = texts[n]
            if t in _OPEN:
                stack.append(n)
            elif stack and texts[stack[-1]] == _OPEN[_CLOSE.index(t)]:
                i = stack.pop()
                match[i] = n
                match[n] = i
            else:
                wrong += 1
        #: Stands for a parser's share of error nodes: brackets without a partner among all tokens.
        self.error_ratio = (wrong + len(stack)) / max(1, len(texts))

    @cached_property
    def ats(self) -> list[int]:
        return list(compress(accumulate(map(len, self._found), initial=0), self._found_kinds))

    @cached_property
    def lines(self) -> _Lines:
        return _Lines(self.source, self.ats)

    @cached_property
    def names(self) -> list[int]:
        """The tokens that are names."""
        return [i for i, k in enumerate(self.kinds) if k == "name"]

    def _scan_slowly(self) -> None:
        self.texts, self.kinds, self.ats = [], [], []
        at, n, source = 0, 0, self.source
        while at < len(source):
            for m in _PATTERN.finditer(source, at):
                kind, text, at = m.lastgroup, m.group(), m.start()
                if kind == "space" or kind == "comment":
                    continue
                literal = None
                if kind == "op" and text[0] == "/" and self._regex_may_start(n):
                    literal = _REGEX.match(source, at)
                    if literal:
                        kind, text = "str", literal.group()
                self.texts.append(text)
                self.kinds.append(kind)
                self.ats.append(at)
                n += 1
                if literal:
                    break
            else:
                break
            at += len(text)

    def _regex_may_start(self, n: int) -> bool:
        """Whether token ``n`` may begin a regular expression, by the token before it."""
        if n == 0:
            return True
        kind, text = self.kinds[n - 1], self.texts[n - 1]
        return kind == "op" and text not in ")]}" or text in ("return", "typeof", "case", "in", "of")

    def is_name(self, i: int) -> bool:
        return self.kinds[i] == "name"

    def string(self, i: int) -> str:
        return self.text(i).lstrip("$@")[1:-1]

    def byte(self, char: int) -> int:
        if self._plain:
            return char
        if self._wide is None:  # places of characters of several bytes, and how many bytes more those before each take
            self._wide = [m.start() for m in re.finditer(r"[^\x00-\x7f]", self.source)]
            self._more = [0, *accumulate(len(self.source[i].encode()) - 1 for i in self._wide)]
        return char + self._more[bisect_left(self._wide, char)]

    def anchor(self, first: int, last: int) -> dict:
        start, end = self.ats[first], self.ats[last] + len(self.texts[last])
        return {
            "file": self.file, "start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.lines[first],
            "end_line": self.lines[last] + self.texts[last].count("\n"), "content_hash": py_content_hash(self.source[start:end]),
        }

    def arity(self, open_: int) -> int:
        """Parameters between the bracket at ``open_`` and its partner."""
        close = self.match.get(open_)
        if close is None or close == open_ + 1:
            return 0
        n, i = 1, open_ + 1
        depth = 0
        while i < close:
            t = self.text(i)
            if t in _OPEN and i in self.match:
                i = self.match[i]
            elif t == "<":
                depth += 1
            elif t == ">":
                depth = max(0, depth - 1)
            elif t == "," and depth == 0 and i + 1 < close:
                n += 1
            i += 1
        return n

    @property
    def dir(self) -> str:
        return self.file.rpartition("/")[0] or "."

    def qualify(self, owner: str, name: str) -> str:
        base = self.dir if self.lang in ("go", "cs") else self.file
        return f"{base}#{owner}.{name}" if owner else f"{base}#{name}"

    def entity(self, kind: str, name: str, first: int, last: int, owner: str = "", disambiguator: str = "", scope: bool = False) -> str:
        qualified = self.qualify(owner, name)
        ident = py_entity_id(self.repo, kind, qualified, disambiguator)
        if self.wants_entities:
            self.entities.append({"entity_id": ident, "kind": kind, "qualified": qualified, "name": name, "owner": owner, "anchor": self.anchor(first, last)})
        if scope:
            self.scopes.append((first, last, ident))
            self._scope_of = None
        return ident

    def scope_at(self, i: int) -> str:
        """The innermost entity around token ``i``; empty at module level."""
        if self._scope_of is None:  # inner scopes over outer ones
            self._scope_of = [""] * self.n
            for a, b, e in sorted(((a, -b, e) for a, b, e in self.scopes)):
                b = min(-b, self.n - 1)
                self._scope_of[a : b + 1] = [e] * (b + 1 - a)
        return self._scope_of[i]

    def ref(self, i: int, kind: str, name: str, member: str = "", scope: str = "unqualified", receiver: str = "", src: str | None = None) -> None:
        if not self.wants_refs:
            return
        self.refs.append({
            "kind": kind, "src": self.scope_at(i) if src is None else src, "scope": scope, "module": "", "name": name, "member": member,
            "receiver_type": receiver, "start_byte": self.byte(self.ats[i]), "start_line": self.lines[i],
        })

    def bind(self, local: str, source: str, imported: str = "", namespace: bool = False, default: bool = False) -> None:
        self.imports.append({"local_name": local, "source": source, "imported_name": imported, "is_namespace": namespace, "is_default": default})

    def skip_types(self, i: int) -> int:
        """Past ``<...>`` at ``i``."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < self.n:
            t = self.texts[i]
            depth += (t == "<") - (t == ">")
            i += 1
            if depth == 0:
                break
        return i

    def find(self, i: int, stop: tuple[str, ...]) -> int:
        """The next token at this depth that is one of ``stop``; the number of tokens if none is."""
        texts, kinds, match = self.texts, self.kinds, self.match
        while i < self.n:
            if kinds[i] == "op":
                t = texts[i]
                if t in stop:
                    return i
                if t in _OPEN and i in match:
                    i = match[i]
            i += 1
        return i

    def facts(self) -> dict:
        return {
            "entities": self.entities, "refs": self.refs, "imports": self.imports, "reexports": self.reexports,
            "ext_methods": self.ext_methods, "field_types": self.field_types,
        }


def agreed(observed: list[tuple[str, str]]) -> dict[str, str]:
    """Names whose observed types all agree."""
    seen: dict[str, set[str]] = {}
    for name, kind in observed:
        seen.setdefault(name, set()).add(kind)
    return {n: next(iter(k)) for n, k in seen.items() if len(k) == 1}
