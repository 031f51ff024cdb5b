"""Go facts."""

from __future__ import annotations

from skein.operators.extract.lexer import LISTS, Unit, agreed

_NOT_CALLED = frozenset("if for switch select return func go defer range case map chan interface struct type var const import package else".split())


def extract(repo: str, file: str, source: str, lists: tuple[str, ...] = LISTS) -> Unit:
    u = Unit(repo, file, "go", source, lists)
    variables: list[tuple[str, str]] = []
    local: set[str] = set()
    heads: set[int] = set()
    i, n = 0, u.n
    while i < n:
        t = u.text(i)
        if t == "import":
            _imports(u, i)
        elif t == "type" and u.kind(i) == "name":
            if u.text(i + 1) == "(" and i + 1 in u.match:
                k = i + 2
                while k < u.match[i + 1]:
                    k = _type(u, k, heads) + 1 if u.is_name(k) else k + 1
            elif u.is_name(i + 1):
                _type(u, i + 1, heads)
        elif t == "func":
            _func(u, i, variables, heads)
        elif t == "var" and u.is_name(i + 1):
            kind = _type_at(u, i + 2)
            if kind:
                variables.append((u.text(i + 1), kind))
            if u.text(i + 2) == "func":
                local.add(u.text(i + 1))
        elif u.is_name(i) and u.text(i + 1) == ":=":
            if u.text(i + 2) == "func":
                local.add(t)
            k = i + 2 + (u.text(i + 2) == "&")
            end = k + 2 if u.text(k + 1) == "." else k
            if u.is_name(k) and u.text(end + 1) == "{":
                variables.append((t, u.text(end) if end == k else f"{u.text(k)}.{u.text(end)}"))
        i += 1
    types = agreed(variables)
    kinds, texts = u.kinds, u.texts
    for i in range(n):
        if texts[i + 1] != "(" or kinds[i] != "name" or i in heads:
            continue
        t = u.text(i)
        if u.text(i - 1) != ".":
            if t not in _NOT_CALLED and u.text(i - 1) != "func":
                u.ref(i, "call", t, scope="local" if t in local else "unqualified")
        elif u.is_name(i - 2):
            deep = u.text(i - 3) == "." and u.is_name(i - 4)
            u.ref(i, "call", u.text(i - 2), t, "qualified", "" if deep else types.get(u.text(i - 2), ""))
    return u


def _type_at(u: Unit, i: int) -> str:
    while u.text(i) in ("*", "&"):
        i += 1
    if not u.is_name(i) or u.text(i) in ("func", "map", "chan", "interface", "struct"):
        return ""
    return f"{u.text(i)}.{u.text(i + 2)}" if u.text(i + 1) == "." and u.is_name(i + 2) else u.text(i)


def _imports(u: Unit, i: int) -> None:
    a, b = (i + 2, u.match.get(i + 1, i + 1)) if u.text(i + 1) == "(" else (i + 1, i + 3)
    for k in range(a, b):
        if u.kind(k) == "str":
            path = u.string(k)
            alias = u.text(k - 1) if u.is_name(k - 1) and u.text(k - 1) != "import" else ""
            if alias not in ("_", "."):
                u.bind(alias or path.rpartition("/")[2], path, namespace=True)
            if u.text(i + 1) != "(":
                break


def _type(u: Unit, i: int, heads: set[int]) -> int:
    """The type declared by the name at ``i``; returns its last token."""
    name, k = u.text(i), i + 1
    if u.text(k) == "[" and k in u.match and u.is_name(u.match[k] + 1):
        k = u.match[k] + 1
    if u.text(k) in ("struct", "interface") and k + 1 in u.match:
        close = u.match[k + 1]
        own = u.entity("Class" if u.text(k) == "struct" else "Interface", name, i, close)
        if u.text(k) == "struct":
            _fields(u, name, own, k + 1, close)
        else:  # signatures, not calls
            heads.update(range(k + 1, close))
        return close
    line, end = u.lines[i], k
    while end + 1 < u.n and u.lines[end + 1] == line and u.text(end + 1) != ")":
        end += 1
    u.entity("TypeAlias", name, i, min(end, u.n - 1))
    return end


def _fields(u: Unit, owner: str, own: str, open_: int, close: int) -> None:
    k = open_ + 1
    while k < close:
        line = u.lines[k]
        end = k
        while end + 1 < close and u.lines[end + 1] == line:
            end = u.match[end + 1] if u.text(end + 1) in "([{" and end + 1 in u.match else end + 1
        words = [j for j in range(k, end + 1) if u.kind(j) != "str"]
        star = u.text(k) == "*"
        at = k + star
        if u.is_name(at) and (len(words) == 1 + star or (u.text(at + 1) == "." and len(words) == 3 + star)):  # embedded
            u.ref(at, "extends", u.text(at + 2) if u.text(at + 1) == "." else u.text(at), src=own)
        elif u.is_name(k):
            names = [u.text(k)]
            while u.text(k + 1) == "," and u.is_name(k + 2):
                k += 2
                names.append(u.text(k))
            kind = _type_at(u, k + 1)
            if kind:
                u.field_types += [{"owner": owner, "field": f, "type": kind} for f in names]
        k = end + 1


def _params(u: Unit, open_: int, variables: list[tuple[str, str]]) -> None:
    k, waiting = open_ + 1, []
    while k < u.match[open_]:
        end = u.find(k, (",", ")"))
        if u.is_name(k):
            kind = _type_at(u, k + 1) if end > k + 1 else ""
            waiting.append(u.text(k))
            if end > k + 1:
                variables += [(w, kind) for w in waiting if kind]
                waiting = []
        k = end + 1


def _func(u: Unit, i: int, variables: list[tuple[str, str]], heads: set[int]) -> None:
    k, owner = i + 1, ""
    if u.text(k) == "(" and k in u.match and u.is_name(u.match[k] + 1) and u.text(u.match[k] + 2) in ("(", "["):
        inside = [u.text(j) for j in range(k + 1, u.match[k]) if u.is_name(j)]
        owner = inside[1] if len(inside) > 1 else inside[0] if inside else ""
        if len(inside) > 1:
            variables.append((inside[0], owner))
        k = u.match[k] + 1
    if not u.is_name(k):
        if u.text(k) == "(" and k in u.match:
            _params(u, k, variables)
        return
    args = u.match[k + 1] + 1 if u.text(k + 1) == "[" and k + 1 in u.match else k + 1
    if u.text(args) != "(" or args not in u.match:
        return
    _params(u, args, variables)
    body = u.match[args] + 1
    line = u.lines[u.match[args]]
    while body < u.n and u.text(body) != "{" and u.lines[body] == line:
        body = u.match[body] + 1 if u.text(body) in "([" and body in u.match else body + 1
    last = u.match.get(body, u.match[args]) if u.text(body) == "{" else u.match[args]
    name = u.text(k)
    heads.add(k)
    test = not owner and u.file.endswith("_test.go") and name.startswith("Test") and not name[4:5].islower()
    if test:
        u.entity("Test", name, i, last, scope=True)
    else:
        u.entity("Method" if owner else "Function", name, i, last, owner=owner, disambiguator=f"arity:{u.arity(args)}", scope=True)
