"""Lexers with a pushdown stack: where is the first thing that the language cannot allow? They alone decide.

Each function takes a text and returns None or (kind, line). Kinds: conflict (merge marker outside literals and comments), unterminated (string,
comment, template or regular expression), unbalanced (delimiter closed that was not open, or by the wrong partner),
premature_end (end of text inside a delimiter or statement), grammar (a token that cannot stand where it stands).
"""

from __future__ import annotations

import datetime
import re

from codequarry.llm.pylex import python_error

Verdict = tuple[str, int] | None

_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|={7}\r?$)", re.M)
_PAIR = {")": "(", "]": "[", "}": "{"}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _conflict(text: str) -> Verdict:
    """The first merge marker of a text that is known not to parse."""
    if "<<<<<<<" in text or ">>>>>>>" in text:
        m = _CONFLICT.search(text)
        if m and m.group()[0] in "<>":
            return "conflict", _line(text, m.start())
    return None


# ---- Python -------------------------------------------------------------------------------------------------------


def python_file(text: str) -> Verdict:
    """The lexer and the stack of :mod:`pylex`; of a broken file the first merge marker, if any, is the error."""
    text = text.removeprefix("\ufeff")
    bad = python_error(text)
    if bad is None:
        return None
    return _conflict(text) or (bad[0], _line(text, bad[1]))


# ---- JSON ---------------------------------------------------------------------------------------------------------

_JSON = re.compile(r'[ \t\r\n]*(?:(?P<s>"(?>[^"\\\x00-\x1f]+|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<v>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)|(?P<p>[{}\[\],:])|(?P<e>\Z))')


_BLANK = re.compile(r"[ \t\r\n]*")


def json_file(text: str) -> Verdict:
    """One strict JSON value by a pushdown automaton: no comments, trailing commas, NaN, single quotes or second value."""
    bad = _json_error(text)
    return bad and (_conflict(text) or bad)


def _json_error(text: str) -> Verdict:
    stack: list[str] = []
    want, at = "value", 0  # value, value_or_end, key, key_or_end, colon, comma, end
    while True:
        m = _JSON.match(text, at)
        if not m:
            nl = _BLANK.match(text, at).end()
            return ("unterminated" if text[nl : nl + 1] == '"' else "grammar"), _line(text, nl)
        at, kind = m.end(), m.lastgroup
        here = m.start(kind)
        if kind == "e":
            return None if want == "end" else ("premature_end", _line(text, here))
        tok = m.group(kind)
        if kind in "sv":
            if want in ("key", "key_or_end") and kind == "s":
                want = "colon"
                continue
            if want not in ("value", "value_or_end"):
                return "grammar", _line(text, here)
            want = "comma" if stack else "end"
        elif tok in "{[":
            if want not in ("value", "value_or_end"):
                return "grammar", _line(text, here)
            stack.append(tok)
            want = "key_or_end" if tok == "{" else "value_or_end"
        elif tok in "}]":
            if not stack or stack[-1] != _PAIR[tok]:
                return "unbalanced", _line(text, here)
            if want not in ("comma", "key_or_end", "value_or_end"):
                return "grammar", _line(text, here)
            stack.pop()
            want = "comma" if stack else "end"
        elif tok == ":":
            if want != "colon":
                return "grammar", _line(text, here)
            want = "value"
        else:
            if want != "comma":
                return "grammar", _line(text, here)
            want = "key" if stack[-1] == "{" else "value"


# ---- TOML ---------------------------------------------------------------------------------------------------------

_T_ESC = r'\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
_T_STRING = re.compile(
    rf'"""(?>[^"\\\x00-\x08\x0b-\x1f\x7f]+|{_T_ESC}|\\[ \t]*\n|"{{1,2}}(?!"))*+"{{3,5}}'
    r"|'''(?>[^'\x00-\x08\x0b-\x1f\x7f]+|'{1,2}(?!'))*+'{3,5}"
    rf'|(?!""")"(?>[^"\\\x00-\x08\x0a-\x1f\x7f]+|{_T_ESC})*+"'
    r"|(?!''')'[^'\x00-\x08\x0a-\x1f\x7f]*+'"
)
_T_KEY = re.compile(rf'[A-Za-z0-9_-]+|(?!""")"(?>[^"\\\x00-\x08\x0a-\x1f\x7f]+|{_T_ESC})*+"' + r"|(?!''')'[^'\x00-\x08\x0a-\x1f\x7f]*+'")
_T_SCALAR = re.compile(
    r"(?P<date>(\d{4})-(\d\d)-(\d\d)(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?)"
    r"|(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|true|false|[+-]?(?:inf|nan)"
    r"|0x[0-9A-Fa-f](?:_?[0-9A-Fa-f])*|0b[01](?:_?[01])*|0o[0-7](?:_?[0-7])*"
    r"|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?"
)
_T_BLANK = re.compile(r"[ \t]*")
_T_GAP = re.compile(r"(?>[ \t\n]+|#[^\x00-\x08\x0a-\x1f\x7f]*(?=\n|\Z))*+")
_T_END = re.compile(r"[ \t]*(?:#[^\x00-\x08\x0a-\x1f\x7f]*)?(?:\n|\Z)")
_T_CODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\.", re.S)


class _Toml(Exception):
    """(kind, position) of the first error."""


class _Table:
    """A name of the document: a table, an array of tables (``parts``: the last of them) or a value."""

    __slots__ = ("parts", "kind", "closed", "frozen")

    def __init__(self, kind: str = "table") -> None:
        self.parts: dict[str, _Table] = {}
        self.kind, self.closed, self.frozen = kind, False, False


def _t_escapes(text: str, at: int) -> str:
    """The text of a string as far as names are compared; escapes must name characters."""

    def char(m: re.Match) -> str:
        code = m.group(1) or m.group(2)
        if not code:
            return m.group()
        n = int(code, 16)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise _Toml("grammar", at + m.start())
        return chr(n)

    return _T_CODE.sub(char, text) if "\\" in text else text


def _t_key(text: str, at: int) -> tuple[list[str], int]:
    """Parts of a dotted key and where it ends, behind blanks."""
    parts = []
    while True:
        at = _T_BLANK.match(text, at).end()
        m = _T_KEY.match(text, at)
        if not m:
            raise _Toml("unterminated" if text[at : at + 1] in ("'", '"') and text[at : at + 3] not in ("'''", '"""') else "grammar", at)
        k = m.group()
        parts.append(k[1:-1] if k[0] == "'" else _t_escapes(k[1:-1], at + 1) if k[0] == '"' else k)
        at = _T_BLANK.match(text, m.end()).end()
        if text[at : at + 1] != ".":
            return parts, at
        at += 1


def _t_assign(table: _Table, key: list[str], at: int, lists: bool, opened: list[_Table]) -> _Table:
    """Enters a key with a value; returns its node. What dotted keys open closes with the section."""
    for k in key[:-1]:
        table = table.parts.setdefault(k, _Table())
        if table.kind == "value" or table.frozen or table.closed or (table.kind == "list" and not lists):
            raise _Toml("grammar", at)
        opened.append(table)
    if table.frozen or key[-1] in table.parts:
        raise _Toml("grammar", at)
    node = table.parts[key[-1]] = _Table("value")
    return node


def _t_header(root: _Table, key: list[str], at: int, many: bool) -> _Table:
    """The table that a header opens."""
    node = root
    for k in key[:-1]:
        node = node.parts.setdefault(k, _Table())
        if node.kind == "value" or node.frozen:
            raise _Toml("grammar", at)
    last = node.parts.get(key[-1])
    if many:
        if last is None:
            last = node.parts[key[-1]] = _Table("list")
        elif last.kind != "list" or last.frozen:
            raise _Toml("grammar", at)
        last.parts, last.closed = {}, True
        return last
    if last is None:
        last = node.parts[key[-1]] = _Table()
    elif last.kind != "table" or last.closed or last.frozen:
        raise _Toml("grammar", at)
    last.closed = True
    return last


def _t_document(text: str) -> None:
    """Raises _Toml at the first error. One loop, a stack of open arrays and inline tables."""
    n, at = len(text), 0
    root = here = _Table()
    opened: list[_Table] = []
    stack: list[tuple[str, int, _Table | None]] = []  # bracket, position, table of an inline one
    node: _Table | None = None
    want = "line"  # line, value (or the end of an array), after
    while True:
        if want == "line":
            at = _T_GAP.match(text, at).end()
            if at >= n:
                return
            if text[at] == "[":
                for x in opened:
                    x.closed = True
                opened = []
                many = text.startswith("[[", at)
                key, end = _t_key(text, at + 1 + many)
                close = "]]" if many else "]"
                if not text.startswith(close, end):
                    raise _Toml("premature_end" if end >= n or text[end] == "\n" else "grammar", end)
                here = _t_header(root, key, at, many)
                m = _T_END.match(text, end + len(close))
                if not m:
                    raise _Toml("grammar", end + len(close))
                at = m.end()
                continue
            key, end = _t_key(text, at)
            if text[end : end + 1] != "=":
                raise _Toml("premature_end" if end >= n else "grammar", end)
            node = _t_assign(here, key, at, True, opened)
            at, want = _T_BLANK.match(text, end + 1).end(), "value"
            continue
        if want == "value":
            inside = stack[-1] if stack else None
            if inside and inside[0] == "[":
                at = _T_GAP.match(text, at).end()
                if text[at : at + 1] == "]":
                    stack.pop()
                    at, want = at + 1, "after"
                    continue
            if at >= n:
                raise _Toml("premature_end", inside[1] if inside else at)
            c = text[at]
            if c == "[":
                stack.append((c, at, None))
                if node is not None:
                    node.frozen = True
                at += 1
                continue
            if c == "{":
                if node is not None:
                    node.frozen = True
                stack.append((c, at, _Table()))
                at = _T_BLANK.match(text, at + 1).end()
                if text[at : at + 1] == "}":
                    stack.pop()
                    at, want = at + 1, "after"
                else:
                    want = "key"
                continue
            m = _T_STRING.match(text, at) if c in "'\"" else _T_SCALAR.match(text, at)
            if not m:
                if c in ")]}":
                    raise _Toml("unbalanced" if c != "]" or not stack else "grammar", at)
                raise _Toml("unterminated" if c in "'\"" else "grammar", at)
            if c == '"':
                _t_escapes(m.group(), at)
            elif m.lastgroup and m.group("date"):
                try:
                    datetime.date(*map(int, m.group("date")[:10].split("-")))
                except ValueError as e:
                    raise _Toml("grammar", at) from e
            at, want = m.end(), "after"
            continue
        if want == "key":
            key, end = _t_key(text, at)
            if text[end : end + 1] != "=":
                raise _Toml("premature_end" if end >= n else "grammar", end)
            node = _t_assign(stack[-1][2], key, at, False, [])
            at, want = _T_BLANK.match(text, end + 1).end(), "value"
            continue
        # after a value
        if not stack:
            m = _T_END.match(text, at)
            if not m:
                at = _T_BLANK.match(text, at).end()
                raise _Toml("unbalanced" if text[at] in ")]}" else "grammar", at)
            at, want = m.end(), "line"
            continue
        bracket, where, _ = stack[-1]
        at = (_T_GAP if bracket == "[" else _T_BLANK).match(text, at).end()
        c = text[at : at + 1]
        if c == ",":
            at = _T_BLANK.match(text, at + 1).end()
            want, node = ("value", None) if bracket == "[" else ("key", None)
        elif c == ("]" if bracket == "[" else "}"):
            stack.pop()
            at += 1
        elif not c:
            raise _Toml("premature_end", where)
        else:
            raise _Toml("unbalanced" if c in ")]}" else "grammar", at)


def toml_file(text: str) -> Verdict:
    """TOML 1.0: literals, delimiters and the names that are taken, by one automaton with a stack."""
    text = text.replace("\r\n", "\n")
    try:
        _t_document(text)
    except _Toml as e:
        return _conflict(text) or (e.args[0], _line(text, e.args[1]))
    return None


# ---- JavaScript and TypeScript --------------------------------------------------------------------------------------

_JS = re.compile(
    r"(?P<nl>\r?\n\s*|[  \r])|(?P<ws>[ \t\f\v\xa0﻿]+)"
    r"|(?P<id>#?(?:[A-Za-z_$\xaa-῿Ⰰ-￯\U00010000-\U0010fffd]|\\u[\da-fA-F{])(?:[\w$‌‍]|\\u(?:\{[\da-fA-F]+\})?)*)"
    r"|(?P<num>(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)"
    r"|(?P<com>//[^\n]*|/\*(?>[^*]+|\*(?!/))*+(?P<comend>\*/|\Z))"
    r"|(?P<str>\"(?>[^\"\\\n]+|\\(?:\r\n|.|\n))*+(?P<d1>\"|)|'(?>[^'\\\n]+|\\(?:\r\n|.|\n))*+(?P<d2>'|))"
    r"|(?P<tick>`)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<semi>;)"
    r"|(?P<op>=>|\.\.\.|\?\.(?!\d)|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|&&|\|\||\?\?|\+\+|--|\*\*|<<|[+\-*%&|^]=|[-+*/%&|^<>=!~?:,.@])",
    re.S,
)
_TEMPLATE = re.compile(r"(?>[^`\\$]+|\\.|\$(?!\{))*+(?P<end>`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?![*/])(?>[^/\\\[\n]+|\\[^\n]|\[(?>[^\]\\\n]+|\\[^\n])*+\])++/[a-zA-Z]*")

#: Reserved words of the language, by what may come next.
_PAREN_KW = frozenset("if while switch with".split())
_STATEMENT_KW = frozenset("break case catch class const continue debugger default do else export finally for function if import return switch throw try var while with enum".split())
_OPERATOR_KW = frozenset("in instanceof extends".split())
_PREFIX_KW = frozenset("typeof void delete new await yield".split())
_BINDING_KW = frozenset("const var".split())
_DANGLING = frozenset("typeof void delete new const var throw".split())
_CONTEXT_JS = frozenset("async get set static let of as from accessor await yield".split())
_CONTEXT_TS = _CONTEXT_JS | frozenset(
    "type interface namespace module declare abstract readonly public private protected override enum is keyof infer asserts satisfies unique out implements extends global require".split()
)
_JOIN_JS = frozenset("of as from".split())
_JOIN_TS = _JOIN_JS | frozenset("is satisfies extends implements".split())
_NEVER_FIRST = frozenset("= == === != !== && || ?? % => **  *= %= += -= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split())
_BINARY = frozenset("= == === != !== && || ?? % => ** + - * / & | ^ << <= *= %= += -= &= |= ^= **= <<= >>= >>>= &&= ||= ??= . ?. ... ! ~".split())


def script_file(text: str, typed: bool) -> Verdict:
    """JavaScript, or TypeScript if ``typed``: a lexer and a stack that also watches how tokens may follow each other.

    Two operands without an operator between them, a binary operator without operands, a control word without its
    parenthesis, and (untyped) a colon that belongs to no object, label, case or conditional are grammar errors.
    """
    context, join = (_CONTEXT_TS, _JOIN_TS) if typed else (_CONTEXT_JS, _JOIN_JS)
    dangling = _DANGLING - {"void"} if typed else _DANGLING  # void is a type as well
    at = text.find("\n") if text.startswith("#!") else 0
    n = len(text)
    # stack entries: [bracket, kind, position, pending conditionals]; kinds: block object class control paren list tmpl
    stack: list[list] = []
    top = ["", "block", 0, 0]
    prev, pk = "", "start"  # last token and its class: start id num str close op semi kw
    prev_paren = ""  # kind of the bracket that prev closed
    fresh, first, case, cls, wants_paren = False, True, False, False, False
    label = False  # prev is the first token of a statement
    match = _JS.match
    if at < 0:
        return None
    while at < n:
        m = match(text, at)
        if not m:
            return "grammar", _line(text, at)
        kind, here = m.lastgroup, at
        if kind in ("d1", "d2"):
            kind = "str"
        elif kind == "comend":
            kind = "com"
        at = m.end()
        if kind == "ws":
            continue
        if kind == "nl":
            fresh = True
            continue
        if kind == "com":
            c = m.group()
            if c.startswith("/*"):
                if not c.endswith("*/") or len(c) < 4:
                    return "unterminated", _line(text, here)
                fresh = fresh or "\n" in c
            continue
        tok = m.group(kind)
        if kind == "op" and tok[0] in "<>=" and (here == 0 or text[here - 1] == "\n") and _CONFLICT.match(text, here):
            return "conflict", _line(text, here)
        operand_before = pk in ("id", "num", "str") or (pk == "close" and (prev != "}" or prev_paren == "object"))
        if kind == "op" and tok == "/" and not (operand_before and prev_paren != "control" or pk in ("id", "num", "str") or (pk == "close" and prev in ")]" and prev_paren != "control")):
            r = _REGEX.match(text, here)
            if not r:
                return "unterminated", _line(text, here)
            at, kind, tok = r.end(), "num", "//"
        if kind == "tick":
            t = _TEMPLATE.match(text, at)
            at = t.end()
            if t.group("end") == "":
                return "unterminated", _line(text, here)
            if t.group("end") == "${":
                stack.append(top)
                top = ["`", "tmpl", here, 0]
                prev, pk, prev_paren, fresh, label = "${", "op", "", False, False
            else:
                if pk == "num" or pk == "str":
                    return "grammar", _line(text, here)
                prev, pk, prev_paren, fresh, label = "`", "str", "", False, False
            continue
        if wants_paren and not (kind == "open" and tok == "(") and not (tok == "await" and prev == "for"):
            return "grammar", _line(text, here)
        if kind in ("id", "num", "str"):
            after_dot = prev in (".", "?.") and pk == "op"
            is_kw = kind == "id" and not after_dot and (tok in _STATEMENT_KW or tok in _PREFIX_KW) and not (typed and prev == "as" and tok == "const")
            if kind == "str" and (len(tok) < 2 or tok[-1] != tok[0]):
                return "unterminated", _line(text, here)
            if kind == "id" and not after_dot and tok in _OPERATOR_KW and pk != "op" and pk != "start" and pk != "semi":
                prev, pk, prev_paren, fresh, label = tok, "op", "", False, False
                continue
            adjacent = False
            if pk in ("id", "num", "str"):
                adjacent = not (pk == "id" and prev in context) and not (kind == "id" and tok in join) and not (kind == "id" and tok in ("with", "assert") and pk == "str")
                if kind != "id" and pk == "id" and prev in ("get", "set", "static", "async", "let") and kind == "num":
                    adjacent = True
            elif pk == "close" and prev == ")":
                adjacent = prev_paren != "control" and not (kind == "id" and tok in join) and not (typed and top[1] != "paren")
            elif pk == "close" and prev == "]":
                adjacent = not (kind == "id" and tok in join) and not typed
            elif pk == "close" and prev == "}" and prev_paren in ("object",):
                adjacent = not (kind == "id" and tok in join) and not typed
            if adjacent and (not fresh or top[0] in ("(", "[", "`") or (top[1] == "object" and not typed)):
                return "grammar", _line(text, here)
            if adjacent and fresh and pk == "id" and kind == "id" and prev in ("else", "do"):
                return "grammar", _line(text, here)
            if prev in _BINDING_KW and pk == "kw" and (kind != "id" or (is_kw and tok not in ("enum", "await", "yield"))):
                return "grammar", _line(text, here)
            starts = pk in ("start", "semi") or (pk == "close" and prev == "}" and prev_paren != "object") or (pk == "open" and prev == "{") or fresh or (pk == "op" and prev == ":" and top[1] == "block")
            if is_kw and not (top[1] in ("object", "class") and top[0] == "{" and kind == "id" and (pk in ("semi", "open", "close") or prev == "," or prev in context or (fresh and top[1] == "class"))):
                if tok == "enum" and not typed:
                    return "grammar", _line(text, here)
                wants_paren = tok in _PAREN_KW or tok == "for"
                if tok in ("with", "assert") and pk == "str":
                    wants_paren = False
                if tok in ("case", "default") and prev != "export":
                    case = True
                if tok == "class":
                    cls = True
                prev, pk = tok, "kw"
            else:
                if typed and tok in ("interface", "namespace", "module") and starts:
                    cls = tok == "interface" or cls
                label = starts
                prev, pk = tok, kind
                prev_paren, fresh = "", False
                continue
            prev_paren, fresh, label = "", False, False
            continue
        label_was, label = label, False
        if kind == "open":
            if tok == "(":
                k = "control" if wants_paren or (pk == "kw" and prev == "catch") or (prev == "await" and pk == "kw") else "paren"
                wants_paren = False
                if pk == "num" or (pk == "str" and prev != "`"):
                    if not fresh or top[0] in ("(", "["):
                        if top[1] not in ("object", "class"):
                            return "grammar", _line(text, here)
            elif tok == "[":
                k = "list"
            else:
                if cls:
                    k, cls = "class", False
                elif pk in ("start", "semi") or (pk == "close" and prev in ")}") or (pk == "open" and prev == "{" and top[1] != "object") or prev in ("=>", "else", "do", "try", "finally", "catch") or (pk == "id" and fresh and top[1] == "block"):
                    k = "block"
                elif pk == "op" and prev == ":" and top[1] == "block" and not top[3] and not typed:
                    k = "block"
                elif typed and pk in ("id", "op", "str", "num") and (pk != "op" or prev in (">", ":", "|", "&")):
                    k = "class" if top[1] != "object" or prev != ":" else "object"
                    if pk == "id" and prev in ("static", "global"):
                        k = "block"
                    elif pk in ("id", "str", "num") or prev == ">":
                        k = "block"
                else:
                    if pk in ("num", "str") and not typed and prev != "`" and not fresh:
                        return "grammar", _line(text, here)
                    if pk == "id" and not typed and not fresh and prev not in context:
                        return "grammar", _line(text, here)
                    k = "block" if pk == "id" and prev == "static" else "object"
            stack.append(top)
            top = [tok, k, here, 0]
            prev, pk, prev_paren, fresh = tok, "open", "", False
            continue
        if kind == "close":
            if tok == "}" and top[0] == "`":
                if pk == "op" and prev == "${" or pk == "op" and prev in _BINARY:
                    return "grammar", _line(text, here)
                t = _TEMPLATE.match(text, at)
                at = t.end()
                if t.group("end") == "":
                    return "unterminated", _line(text, top[2])
                if t.group("end") == "${":
                    prev, pk, prev_paren = "${", "op", ""
                else:
                    top = stack.pop()
                    prev, pk, prev_paren = "`", "str", ""
                fresh = False
                continue
            if not stack or top[0] != _PAIR[tok]:
                return "unbalanced", _line(text, here)
            if pk == "op" and prev in _BINARY and not (prev in ("*", "!") and typed) or pk == "kw" and prev in dangling:
                return "grammar", _line(text, here)
            if pk == "op" and prev in ("<", ">", ":", "?") and not typed and tok != "}":
                return "grammar", _line(text, here)
            prev_paren = top[1]
            top = stack.pop()
            prev, pk, fresh, case = tok, "close", False, False
            continue
        if kind == "semi":
            if pk == "op" and (prev in _BINARY and not (prev in ("*", "!") and typed) or (prev in ("<", ">", ":", "?", ",") and not typed)) or pk == "kw" and (prev in dangling or prev in ("import", "export", "class", "function")):
                return "grammar", _line(text, here)
            if top[0] == "[" or top[0] == "`" or (top[0] == "(" and top[1] != "control") or (top[1] == "object" and not typed):
                return "grammar", _line(text, here)
            prev, pk, prev_paren, fresh, case, top[3] = ";", "semi", "", False, False, 0
            continue
        # operators
        nothing_before = pk in ("start", "semi") or (pk == "op" and prev not in ("++", "--")) or (pk == "open")
        if pk == "kw" and prev in _BINDING_KW:
            return "grammar", _line(text, here)
        if tok in _NEVER_FIRST and nothing_before and not (tok == "=>" and typed) and not (prev in (">", "?", "!") and typed) and not (prev == "*"):
            return "grammar", _line(text, here)
        if tok in ("<", ">", "*", "?", ":") and nothing_before and not typed and not (tok == "*" and (top[1] in ("object", "class") or prev in (",",))) and not (tok == ":" and prev == "?"):
            if not (tok == "*" and pk == "kw") and not (tok == ":" and case):
                return "grammar", _line(text, here)
        if tok in ("<", ">", "?") and pk == "kw" and not typed and prev not in ("default", "super"):
            return "grammar", _line(text, here)
        if tok == "," and nothing_before and top[0] != "[" and not typed:
            return "grammar", _line(text, here)
        if tok in ("++", "--") and pk in ("id", "close") and not fresh:
            prev_paren, label = "", False  # postfix: still an operand
            pk, prev = "num", tok
            continue
        if tok == "?":
            top[3] += 1
        elif tok == ":":
            if top[3] > 0:
                top[3] -= 1
            elif case:
                case = False
                prev, pk, prev_paren, fresh = ";", "semi", "", False
                continue
            elif not typed:
                if top[1] == "block" and pk == "id" and label_was:
                    prev, pk, prev_paren, fresh = ";", "semi", "", False
                    continue
                if top[1] != "object":
                    return "grammar", _line(text, here)
        prev, pk, prev_paren, fresh = tok, "op", "", False
    if stack:
        return "premature_end", _line(text, top[2])
    if pk == "op" and prev not in ("++", "--") and not (typed and prev in (">", "!")) or pk == "kw" and prev not in ("break", "continue", "return", "debugger", "default", "await", "yield") or wants_paren:
        return "premature_end", text.count("\n") + 1
    return None


#: Extensions and the language each stands for.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".json": "json", ".toml": "toml"}


def check(language: str, text: str) -> Verdict:
    """First error of a text in a language of LANGUAGES; an empty text is valid but for JSON."""
    if language == "python":
        return python_file(text)
    if language == "json":
        return json_file(text)
    if language == "toml":
        return toml_file(text)
    return script_file(text, language == "typescript")
