"""TypeScript facts."""

from __future__ import annotations

from itertools import accumulate

from skein.operators.extract.lexer import LISTS, Unit, agreed

_NOT_CALLED = frozenset("if for while switch catch return typeof function await new super import require do else of in throw constructor async".split())
_MODIFIERS = frozenset("public private protected static readonly async abstract override declare get set export default".split())
_HEADS = frozenset("class interface enum type function const let var import export it test describe".split())
_DECLARED = frozenset(("const", "let", "var"))
_STEP = dict.fromkeys("([{", 1) | dict.fromkeys(")]}", -1)
_ACCESS = frozenset(("public", "private", "protected", "readonly"))


def extract(repo: str, file: str, source: str, lists: tuple[str, ...] = LISTS) -> Unit:
    u = Unit(repo, file, "ts", source, lists)
    props: list[tuple[int, int, dict[str, str]]] = []
    variables: list[tuple[str, str]] = []
    heads: set[int] = set()
    texts, wants_names = u.texts, u.wants_entities or u.wants_refs
    depth_of = _depths(u) if wants_names else []
    for i in u.names:
        t, name = texts[i], texts[i + 1]
        if name != "." and t not in _HEADS:
            continue
        if not wants_names:
            if t == "import":
                _import(u, i)
            elif t == "export":
                _reexport(u, i)
            elif t in _DECLARED:
                _variable(u, i, variables, False)
            continue
        if t in ("class", "interface") and u.is_name(i + 1) and u.text(i - 1) != ".":
            body = u.find(u.skip_types(i + 2), ("{",))
            close = u.match.get(body)
            if close is None:
                continue
            own = u.entity("Class" if t == "class" else "Interface", name, i, close)
            _heritage(u, i + 2, body, own)
            if t == "class":
                props.append((body, close, _members(u, name, body, close, heads)))
            else:  # signatures, not calls
                heads.update(range(body, close))
        elif t == "enum" and u.is_name(i + 1) and u.text(i + 2) == "{" and i + 2 in u.match:
            u.entity("Enum", name, i, u.match[i + 2])
        elif t == "type" and u.is_name(i + 1) and u.text(u.skip_types(i + 2)) == "=" and u.text(i - 1) != ".":
            end = _statement_end(u, u.skip_types(i + 2))
            u.entity("TypeAlias", name, i, end)
        elif t == "function" and (u.is_name(i + 1) or name == "*"):
            at = i + 1 + (name == "*")
            args = u.skip_types(at + 1)
            body = u.find(u.match.get(args, args) + 1, ("{", ";"))
            if u.is_name(at) and u.text(args) == "(" and body in u.match:
                heads.add(at)
                u.entity("Function", u.text(at), i, u.match[body], disambiguator=f"arity:{u.arity(args)}", scope=True)
        elif t in _DECLARED:
            _variable(u, i, variables, depth_of[i] == 0)
        elif t == "import":
            _import(u, i)
        elif t == "export":
            _reexport(u, i)
        elif t in ("it", "test", "describe") and name == "(" and u.kind(i + 2) == "str" and u.text(i - 1) != "." and i + 1 in u.match:
            u.entity("Test", u.string(i + 2), i, u.match[i + 1], disambiguator=f"byte:{u.byte(u.ats[i])}", scope=True)
            heads.add(i)
        elif name == "." and u.is_name(i + 2) and u.text(i - 1) != ".":
            _assigned_method(u, i)
            _route(u, i)
    if not u.wants_refs:
        return u
    types = agreed(variables)
    for i in u.names:
        behind = texts[i + 1]
        if behind == "(" or behind == "<" or texts[i] == "new":
            _reference(u, i, types, props, heads)
    return u


def _depths(u: Unit) -> list[int]:
    """How many brackets are open around each token; a bracket stands outside its pair."""
    step = _STEP.get
    steps = [step(t, 0) for t in u.texts[: u.n]]
    return [d - 1 if s > 0 else d for d, s in zip(accumulate(steps), steps, strict=True)]


def _statement_end(u: Unit, i: int) -> int:
    end = u.find(i, (";",))
    line = u.lines[i]
    j = i + 1
    while j < min(end, u.n):
        if u.lines[j] > line and u.is_name(j) and u.text(j - 1) not in ("|", "&", "=", "=>", ",", "<", ":"):
            return j - 1
        if u.text(j) in "([{" and j in u.match:
            j = u.match[j]
        line = u.lines[j]
        j += 1
    return min(end, u.n - 1)


def _heritage(u: Unit, i: int, body: int, own: str) -> None:
    kind = ""
    if not u.wants_refs:
        return
    i = u.skip_types(i)
    while i < body:
        t = u.text(i)
        if t in ("extends", "implements"):
            kind = t
        elif u.is_name(i) and kind and u.text(i + 1) != ".":
            u.ref(i, kind, t, src=own)
        i = u.skip_types(i + 1)


def _type_name(u: Unit, i: int) -> str:
    return u.text(i) if u.is_name(i) and u.text(i + 1) not in (".", "[", "|", "&") else ""


def _members(u: Unit, owner: str, body: int, close: int, heads: set[int]) -> dict[str, str]:
    """Methods of a class body become entities; what comes back are the types of its properties."""
    types: list[tuple[str, str]] = []
    i = body + 1
    while i < close:
        first = i
        while u.text(i) in _MODIFIERS and u.text(i + 1) not in ("(", "=", ":", ";", "?"):
            i += 1
        if u.text(i) == "@":
            i += 1
        if not u.is_name(i):
            i = u.match[i] + 1 if u.text(i) in "([{" and i in u.match else i + 1
            continue
        name, j = u.text(i), i + 1
        if u.text(j) in ("?", "!"):
            j += 1
        j = u.skip_types(j)
        if u.text(j) == "(" and j in u.match:
            end = u.find(u.match[j] + 1, ("{", ";"))
            if name == "constructor":
                types += _ctor_params(u, j)
            if u.text(end) == "{" and end in u.match and end < close:
                heads.add(i)
                u.entity("Method", name, first, u.match[end], owner=owner, disambiguator=f"arity:{u.arity(j)}", scope=True)
                i = u.match[end] + 1
            else:
                i = end + 1
            continue
        if u.text(j) == ":" and _type_name(u, j + 1):
            types.append((name, u.text(j + 1)))
        elif u.text(j) == "=" and u.text(j + 1) == "new" and u.is_name(j + 2):
            types.append((name, u.text(j + 2)))
        line = u.lines[i]
        while j < close and u.text(j) != ";" and (u.lines[j] == line or u.text(j - 1) in ("=", ",", "(", "=>")):
            if u.text(j) in "([{" and j in u.match:
                j = u.match[j]
                line = u.lines[j]
            j += 1
        i = max(j, i + 1)
    return agreed(types)


def _ctor_params(u: Unit, open_: int) -> list[tuple[str, str]]:
    out, i = [], open_ + 1
    while i < u.match[open_]:
        marked = False
        while u.text(i) in _ACCESS:
            marked, i = True, i + 1
        j = i + 1 + (u.text(i + 1) == "?")
        if marked and u.is_name(i) and u.text(j) == ":" and _type_name(u, j + 1):
            out.append((u.text(i), u.text(j + 1)))
        i = u.find(i, (",", ")")) + 1
    return out


def _variable(u: Unit, i: int, variables: list[tuple[str, str]], module: bool) -> None:
    name, j = u.text(i + 1), i + 2
    if name == "{" and i + 1 in u.match:
        end = u.match[i + 1]
        if u.text(end + 1) == "=" and u.text(end + 2) == "require" and u.kind(end + 4) == "str":
            k = i + 2
            while k < end:
                if u.is_name(k):
                    renamed = u.text(k + 1) == ":" and u.is_name(k + 2)
                    u.bind(u.text(k + 2) if renamed else u.text(k), u.string(end + 4), u.text(k))
                k = u.find(k, (",", "}")) + 1
        return
    if not u.is_name(i + 1):
        return
    if u.text(j) == ":" and _type_name(u, j + 1):
        variables.append((name, u.text(j + 1)))
        return
    if u.text(j) != "=":
        return
    if u.text(j + 1) == "new" and u.is_name(j + 2):
        variables.append((name, u.text(j + 2)))
    elif u.text(j + 1) == "require" and u.text(j + 2) == "(" and u.kind(j + 3) == "str":
        u.bind(name, u.string(j + 3), default=True)
    elif module and u.is_name(j + 1):
        call = j + 2 if u.text(j + 2) == "(" else j + 4 if u.text(j + 2) == "." and u.text(j + 4) == "(" else 0
        if call and u.kind(call + 1) == "str" and call in u.match:
            u.entity("Class", name, i + 1, u.match[call])


def _import(u: Unit, i: int) -> None:
    j, names = i + 1, []
    if u.text(j) == "type" and u.text(j + 1) != "from":
        j += 1
    while j < u.n and u.text(j) != "from" and u.kind(j) != "str" and u.text(j) != ";":
        t = u.text(j)
        if t == "*" and u.text(j + 1) == "as":
            names.append((u.text(j + 2), "", True, False))
            j += 3
        elif t == "{" and j in u.match:
            k = j + 1
            while k < u.match[j]:
                if u.text(k) == "type" and u.is_name(k + 1) and u.text(k + 1) != "as":
                    k += 1
                if u.is_name(k):
                    names.append((u.text(k + 2) if u.text(k + 1) == "as" else u.text(k), u.text(k), False, False))
                k = u.find(k, (",", "}")) + 1
            j = u.match[j] + 1
        elif u.is_name(j):
            names.append((t, "", False, True))
            j += 1
        else:
            j += 1
    if u.text(j) == "from" and u.kind(j + 1) == "str":
        for local, imported, namespace, default in names:
            u.bind(local, u.string(j + 1), imported, namespace, default)


def _reexport(u: Unit, i: int) -> None:
    if u.text(i + 1) == "*" and u.text(i + 2) == "from" and u.kind(i + 3) == "str":
        u.reexports.append({"source": u.string(i + 3), "is_star": True, "exported_name": "", "local_alias": ""})
    elif u.text(i + 1) == "{" and i + 1 in u.match and u.text(u.match[i + 1] + 1) == "from":
        source = u.string(u.match[i + 1] + 2)
        k = i + 2
        while k < u.match[i + 1]:
            if u.is_name(k):
                alias = u.text(k + 2) if u.text(k + 1) == "as" else u.text(k)
                u.reexports.append({"source": source, "is_star": False, "exported_name": u.text(k), "local_alias": alias})
            k = u.find(k, (",", "}")) + 1


def _assigned_method(u: Unit, i: int) -> None:
    """``X.y.name = function (...) {...}`` is a method of X."""
    if u.text(i + 3) == "." and u.is_name(i + 4) and u.text(i + 5) == "=":
        f = i + 6 + (u.text(i + 6) == "async")
        if u.text(f) == "function":
            args = u.find(f + 1, ("(",))
            body = u.find(u.match.get(args, args) + 1, ("{", ";"))
            if body in u.match:
                u.entity("Method", u.text(i + 4), i, u.match[body], owner=u.text(i), disambiguator=f"arity:{u.arity(args)}", scope=True)


def _route(u: Unit, i: int) -> None:
    """``router.get('/path', ..., handler)``: the handler is a function named by verb, path and the request fields it reads."""
    if u.text(i + 3) != "(" or u.kind(i + 4) != "str" or u.text(i + 4).startswith("/") or i + 3 not in u.match:
        return
    close, last, k = u.match[i + 3], 0, i + 5
    while k < close:
        if u.text(k) == ",":
            last = k + 1
        k = u.match[k] + 1 if u.text(k) in "([{" and k in u.match else k + 1
    start = last + (u.text(last) == "async")
    if not last or last >= close or u.text(close - 1) != "}":
        return
    arrow = u.find(start, ("=>", ")"))
    if u.text(start) != "function" and u.text(arrow) != "=>":
        return
    fields = sorted({u.text(k + 4) for k in range(last, close - 4) if u.text(k) == "req" and u.text(k - 1) != "." and u.text(k + 1) == "." and u.text(k + 3) == "." and u.is_name(k + 4)})
    name = f"{u.text(i + 2).upper()} {u.string(i + 4)}" + (f" ({', '.join(fields)})" if fields else "")
    u.entity("Function", name, last, close - 1, disambiguator=f"byte:{u.byte(u.ats[last])}", scope=True)


def _reference(u: Unit, i: int, types: dict[str, str], props: list, heads: set[int]) -> None:
    t, before = u.text(i), u.text(i - 1)
    if t == "new" and u.is_name(i + 1) and before != ".":
        if u.text(i + 2) != ".":
            u.ref(i + 1, "type_use", u.text(i + 1))
        return
    call = u.skip_types(i + 1) if u.text(i + 1) == "<" else i + 1
    if u.text(call) != "(" or i in heads:
        return
    if before not in (".", "?."):
        if t not in _NOT_CALLED and u.text(i - 1) not in ("function", "new"):
            u.ref(i, "call", t)
        return
    obj = u.text(i - 2)
    if obj == "this" and u.text(i - 3) != ".":
        u.ref(i, "call", t)
    elif u.is_name(i - 2) and u.text(i - 3) in (".", "?.") and u.text(i - 4) == "this":
        own = next((p for a, b, p in reversed(props) if a <= i <= b), {})
        u.ref(i, "call", obj, t, "qualified", own.get(obj, ""))
    elif u.is_name(i - 2) and u.text(i - 3) not in (".", "?."):
        u.ref(i, "call", obj, t, "qualified", types.get(obj, ""))
