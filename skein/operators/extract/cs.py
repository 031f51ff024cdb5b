"""C# facts."""

from __future__ import annotations

from skein.operators.extract.lexer import LISTS, Unit, agreed

_MODIFIERS = frozenset("public private protected internal static readonly sealed abstract virtual override async partial new extern unsafe const required file".split())
_NOT_CALLED = frozenset("if for foreach while switch catch return typeof nameof sizeof using lock new base this when throw await default checked fixed".split())
_TYPES = frozenset(("class", "struct", "record", "interface"))
_NESTED = _TYPES | {"enum", "delegate", "event"}
_TESTS = frozenset(f"{a}{b}" for a in ("Fact", "Theory", "Test", "TestMethod") for b in ("", "Attribute"))


def extract(repo: str, file: str, source: str, lists: tuple[str, ...] = LISTS) -> Unit:
    u = Unit(repo, file, "cs", source, lists)
    variables: list[tuple[str, str]] = []
    props: list[tuple[int, int, dict[str, str]]] = []
    heads: set[int] = set()
    local: set[str] = set()
    kinds, texts, after = u.kinds, u.texts, 0
    for i in u.names:
        if i < after:
            continue
        t = texts[i]
        if t == "using":
            after = _using(u, i, variables) + 1
        elif kinds[i + 1] != "name":
            continue
        elif t in _TYPES and texts[i - 1] not in (".", ":", ","):
            at = i + 1 + (t == "record" and texts[i + 1] in ("class", "struct"))
            props += _type(u, i, at, variables, heads, local)
        elif t == "enum":
            body = u.find(i + 2, ("{",))
            if body in u.match:
                u.entity("Enum", texts[i + 1], i, u.match[body])
        elif t == "delegate":
            args = u.find(i + 1, ("(",))
            if u.is_name(args - 1) and args in u.match:
                u.entity("TypeAlias", texts[args - 1], i, u.match[args])
        elif texts[i + 2] == "=" and t not in _MODIFIERS:
            if t == "var" and texts[i + 3] == "new" and u.is_name(i + 4):
                variables.append((texts[i + 1], texts[i + 4]))
            elif t != "var" and t != "return":
                variables.append((texts[i + 1], t))
    if not u.wants_refs:
        return u
    types = agreed(variables)
    for i in u.names:
        t, behind = texts[i], texts[i + 1]
        if behind != "(" and behind != "<" and t != "new" or i in heads:
            continue
        before = texts[i - 1]
        if t == "new" and kinds[i + 1] == "name":
            u.ref(i + 1, "type_use", behind)
            continue
        if texts[u.skip_types(i + 1) if behind == "<" else i + 1] != "(" or t in _NOT_CALLED or before == "new":
            continue
        if before not in (".", "?."):
            if kinds[i - 1] != "name" or before in ("return", "await", "else", "in", "throw", "yield"):
                u.ref(i, "call", t, scope="local" if t in local else "unqualified")
        elif texts[i - 2] == "this":
            u.ref(i, "call", t)
        elif kinds[i - 2] == "name":
            obj, own = texts[i - 2], next((p for a, b, p in reversed(props) if a <= i <= b), {})
            if texts[i - 3] in (".", "?."):
                if texts[i - 4] == "this":
                    u.ref(i, "call", obj, t, "qualified", own.get(obj, ""))
            else:
                u.ref(i, "call", obj, t, "qualified", types.get(obj, "") or own.get(obj, ""))
    return u


def _using(u: Unit, i: int, variables: list) -> int:
    j = i + 1 + (u.text(i + 1) == "global")
    if u.text(j) in ("static", "("):
        return j
    end = u.find(j, (";",))
    words = [u.text(k) for k in range(j, min(end, u.n))]
    if "=" in words and "new" not in words and len(words) > 2 and words[1] == "=":
        u.bind(words[0], "".join(words[2:]), namespace=True)
    elif words and all(w == "." or w.isidentifier() for w in words) and words[1:2] in ([], ["."]):
        u.bind("", "".join(words), namespace=True)
    else:
        return i
    return end


def _simple(u: Unit, first: int, last: int) -> str:
    """The plain type name written in tokens ``first`` to ``last``: without generics, array marks and qualifiers."""
    name = ""
    k = first
    texts, kinds = u.texts, u.kinds
    while k <= last:
        if texts[k] == "<":
            k = u.skip_types(k)
            continue
        if kinds[k] == "name":
            name = texts[k]
        k += 1
    return name


def _type(u: Unit, first: int, at: int, variables: list, heads: set[int], local: set[str]) -> list[tuple[int, int, dict[str, str]]]:
    name = u.text(at)
    k = u.skip_types(at + 1)
    fields: list[tuple[str, str]] = []
    if u.text(k) == "(" and k in u.match:
        if u.wants_types:
            _params(u, k, variables, fields)
        k = u.match[k] + 1
    body = u.find(k, ("{", ";"))
    last = u.match.get(body, body) if body < u.n else u.n - 1
    own = u.entity("Interface" if u.text(first) == "interface" else "Class", name, first, last)
    if u.text(k) == ":" and u.wants_refs:
        j = k + 1
        while j < body and u.text(j) != "where":
            end = j
            while end < body and u.text(end) not in (",", "where"):
                end = u.skip_types(end) if u.text(end) == "<" else u.match[end] + 1 if u.text(end) == "(" and end in u.match else end + 1
            base = _simple(u, j, end - 1)
            if base:
                u.ref(j, "extends", base, src=own)
            j = end + 1
    if u.text(body) != "{" or body not in u.match:
        return []
    j = body + 1
    while j < last:
        j = _member(u, name, j, last, variables, fields, heads, local)
    typed = agreed(fields)
    u.field_types += [{"owner": name, "field": f, "type": t} for f, t in typed.items()]
    return [(body, last, typed)]


def _params(u: Unit, open_: int, variables: list, fields: list | None = None) -> None:
    k, close, texts = open_ + 1, u.match[open_], u.texts
    while k < close:
        end = k
        while end < close and texts[end] != ",":
            end = u.skip_types(end) if texts[end] == "<" else u.match[end] + 1 if texts[end] in "([{" and end in u.match else end + 1
        stop = next((j for j in range(k, end) if texts[j] == "="), end)
        if u.is_name(stop - 1) and stop - 1 > k:
            kind = _simple(u, k, stop - 2)
            if kind:
                variables.append((u.text(stop - 1), kind))
                if fields is not None:
                    fields.append((u.text(stop - 1), kind))
        k = end + 1


def _member(u: Unit, owner: str, i: int, close: int, variables: list, fields: list, heads: set[int], local: set[str]) -> int:
    first, test = i, False
    texts, kinds = u.texts, u.kinds
    while texts[i] == "[" and i in u.match:
        for k in range(i + 1, u.match[i]):
            if u.text(k) in _TESTS and u.text(k + 1) in ("]", "(", ","):
                test = True
        i = u.match[i] + 1
    while texts[i] in _MODIFIERS:
        i += 1
    if texts[i] in _NESTED:
        end = u.find(i, ("{", ";"))
        return (u.match.get(end, end) if u.text(end) == "{" else end) + 1  # nested types come by themselves
    k = i
    while k < close and texts[k] not in ("(", "{", ";", "=", "=>", "}"):
        k = u.skip_types(k) if texts[k] == "<" else u.match[k] + 1 if texts[k] == "[" and k in u.match else k + 1
    name_at = k - 1
    while name_at > i and not u.is_name(name_at):
        name_at -= 1
    if u.text(k) == "(" and k in u.match and u.is_name(name_at):
        if u.text(k - 1) == ">":
            name_at = k - 1
            while name_at > i and u.text(name_at) != "<":
                name_at -= 1
            name_at -= 1
        end = u.find(u.match[k] + 1, ("{", ";"))
        arrow = u.find(u.match[k] + 1, ("=>", "{", ";"))
        last = u.match.get(end, end) if u.text(end) == "{" and u.text(arrow) != "=>" else u.find(arrow, (";",)) if u.text(arrow) == "=>" else end
        last = min(last, close)
        heads.add(name_at)
        arity = f"arity:{u.arity(k)}"
        name = u.text(name_at)
        if name == owner and name_at == i:
            u.entity("Method", "ctor", first, last, owner=owner, disambiguator=arity, scope=True)
        else:
            own = u.entity("Test" if test else "Method", name, first, last, owner=owner, disambiguator=arity, scope=True)
            if u.text(k + 1) == "this":
                stop = u.find(k + 1, (",", ")"))
                u.ext_methods.append({"entity_id": own, "name": name, "extended_type": _simple(u, k + 2, stop - 2)})
        if u.wants_refs:
            _params(u, k, variables)
            for j in range(u.match[k] + 1, last):  # functions inside functions
                if texts[j + 1] == "(" and kinds[j] == "name" and kinds[j - 1] == "name" and j + 1 in u.match and texts[u.match[j + 1] + 1] in ("{", "=>") and texts[j - 1] not in ("new", "return", "await", "else", "throw", "in"):
                    local.add(texts[j])
                    heads.add(j)
        return last + 1
    if name_at > i and u.is_name(name_at):
        if u.wants_types:
            fields.append((u.text(name_at), _simple(u, i, name_at - 1)))
        if u.text(k) in ("{", "=>"):
            end = u.match.get(k, k) if u.text(k) == "{" else u.find(k, (";",))
            u.entity("Property", u.text(name_at), first, min(end, close), owner=owner)
            return (u.find(end, (";",)) if u.text(end + 1) == "=" else end) + 1
    end = u.find(k, (";", "}"))
    return max(end, i) + 1
