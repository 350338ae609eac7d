"""Python: a lexer and a pushdown stack that decide whether a text is a Python 3 file (grammar of 3.12 and 3.13).

The lexer cuts the text into logical lines of tokens; f-strings are lexed with their fields. The rules below are turned
into finite automata once; a stack of (automaton, state) reads the tokens, so nesting has no limit but memory. What an
automaton of one token of foresight cannot tell (what may be assigned to, the order of arguments and parameters) rides on
the stack as a number per rule.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

Verdict = tuple[str, int] | None
Token = tuple[str, str, int]  # symbol of the grammar, text, position


class Bad(Exception):
    """(kind, position) of the first error."""


# Reserved words of the language.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_PREFIXES = frozenset(("", "r", "u", "b", "f", "br", "rb", "fr", "rf"))
_PAIR = {")": "(", "]": "[", "}": "{"}

_TOKEN = re.compile(
    r"[ \t\f]*+(?:(?P<nl>\r?\n|\r)|(?P<ws>\\\r?\n)|(?P<com>#[^\r\n]*+)"
    r"|(?P<str>[A-Za-z]{0,2}(?:\"\"\"|'''|\"|'))"
    r"|(?P<name>[^\W\d]\w*+)"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])++|0[bB](?:_?[01])++|0[oO](?:_?[0-7])++|(?:\d++(?:_\d++)*+)?\.\d++(?:_\d++)*+(?:[eE][+-]?\d++(?:_\d++)*+)?[jJ]?|\d++(?:_\d++)*+\.?(?:[eE][+-]?\d++(?:_\d++)*+)?[jJ]?))"
    r"|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|->|:=|[-+*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:.;=!])|(?P<end>\Z))"
)
_INDENT = re.compile(r"[ \t\f]*+")
#: Names as the language defines them; asked only where a letter is not ASCII.
_ANY_NAME = regex.compile(r"[\p{XIDS}_]\p{XIDC}*+")
_QUOTES = ("'", '"', "\'\'\'", '"""')


def _inside(q: str, fields: str, escape: str) -> re.Pattern:
    """What lies between the quotes: no line end if they are single; ``fields`` are the braces that end it."""
    if len(q) == 1:
        return re.compile(rf"(?:[^{q}\\\r\n{fields}]++|{escape})*+", re.S)
    return re.compile(rf"(?:[^{q[0]}\\{fields}]++|{escape}|{q[0]}(?!{q[1:]}))*+", re.S)


_BODY = {q: _inside(q, "", r"\\(?:\r\n|.)") for q in _QUOTES}
_FRAW = {q: _inside(q, "{}", r"\\(?:\r\n|[^{}])|\{\{|\}\}|\\(?=[{}])") for q in _QUOTES}
_FBODY = {q: _inside(q, "{}", r"\\N\{[^{}]*+\}|\\(?:\r\n|[^{}])|\{\{|\}\}|\\(?=[{}])") for q in _QUOTES}
_SPEC = {q: re.compile(rf"[^{{}}{q}\r\n]*+" if len(q) == 1 else rf"(?:[^{{}}{q[0]}]++|{q[0]}(?!{q[1:]}))*+") for q in _QUOTES}
_ESCAPE = re.compile(r"\\(?:x(?P<x>[\da-fA-F]{2})?|u(?P<u>[\da-fA-F]{4})?|U(?P<U>[\da-fA-F]{8})?|N(?P<n>\{[^{}]*\})?|.)", re.S)
_AFTER_NUM = regex.compile(r"[\p{XIDC}]++")


def _escapes(body: str, at: int, raw: bool, octets: bool) -> None:
    if octets and not body.isascii():
        raise Bad("grammar", at)
    if raw or "\\" not in body:
        return
    for m in _ESCAPE.finditer(body):
        c = m.group()[1]
        if c == "x" and m.group("x") is None:
            raise Bad("grammar", at + m.start())
        if not octets and c in "uUN":
            if m.group(c if c != "N" else "n") is None or (c == "U" and int(m.group("U"), 16) > 0x10FFFF):
                raise Bad("grammar", at + m.start())
            if c == "N":
                try:
                    unicodedata.lookup(m.group("n")[1:-1])
                except KeyError as e:
                    raise Bad("grammar", at + m.start()) from e


def logical_lines(text: str) -> Iterator[tuple[str, list[Token]]]:
    """(indentation, tokens) of each logical line; symbols are those of the grammar. Raises Bad on what no token can be and
    on an open string."""
    n, at = len(text), 0
    line: list[Token] = []
    indent = ""
    depth: list[str] = []  # brackets, and for f-strings their opening: "f" + quote, "{" + its quote in a field
    match = _TOKEN.match
    start = True
    while True:
        # the text of an f-string, and its format specifications, are no tokens
        while depth and depth[-1][0] in "fs":
            top = depth[-1]
            q, raw = top[2:], top[1] == "r"
            if top[0] == "f":
                m = (_FRAW if raw else _FBODY)[q].match(text, at)
                _escapes(m.group(), at, raw, False)
            else:
                m = _SPEC[q].match(text, at)
            at = m.end()
            if text.startswith("{", at):
                line.append(("{f", "{", at))
                depth.append("{" + top[1:])
                at += 1
            elif top[0] == "s" and text.startswith("}", at):
                depth.pop()
                depth.pop()
                line.append(("}f", "}", at))
                at += 1
            elif top[0] == "f" and text.startswith(q, at):
                depth.pop()
                line.append(("FE", "", at))
                at += len(q)
            elif at < n and text[at] == "}":
                raise Bad("grammar", at)
            else:
                raise Bad("unterminated", at)
        if start:
            m = _INDENT.match(text, at)
            if m.end() < n and text[m.end()] not in "\r\n#":
                indent, start = m.group(), False
        m = match(text, at)
        if m is None:
            m = _ANY_NAME.match(text, at)
            if m is None:
                raise Bad("grammar", at)
            line.append(("NAME", m.group(), at))
            at = m.end()
            continue
        kind = m.lastgroup
        here, at = m.start(kind), m.end()
        if kind == "end":
            break
        if kind == "ws":
            if at >= n:
                raise Bad("premature_end", here)
            continue
        if kind == "com":
            continue
        if kind == "nl":
            if depth:
                continue
            if line:
                yield indent, line
                line = []
            indent, start = "", True
            continue
        tok = m.group(kind)
        if kind == "str":
            q = tok.lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
            prefix = tok[: len(tok) - len(q)].lower()
            if prefix not in _PREFIXES:
                raise Bad("grammar", here)
            if "f" in prefix:
                line.append(("FS", "s", here))
                depth.append("f" + ("r" if "r" in prefix else "-") + q)
                continue
            b = _BODY[q].match(text, at)
            if not text.startswith(q, b.end()):
                raise Bad("unterminated", here)
            _escapes(b.group(), at, "r" in prefix, "b" in prefix)
            at = b.end() + len(q)
            line.append(("STR", "b" if "b" in prefix else "s", here))
            continue
        if kind == "name":
            if not tok.isascii() or text[at : at + 1] > "\x7f":
                m = _ANY_NAME.match(text, here)
                if m is None:
                    raise Bad("grammar", here)
                tok, at = m.group(), m.end()
            line.append((tok if tok in KEYWORDS else "NAME", tok, here))
            continue
        if kind == "num":
            rest = _AFTER_NUM.match(text, at) if text[at : at + 1].isalnum() or text[at : at + 1] == "_" else None
            if rest and rest.group() not in ("and", "else", "for", "if", "in", "is", "or", "not"):
                raise Bad("grammar", here)
            if tok[0] == "0" and len(tok) > 1 and tok.replace("_", "").isdigit() and tok.strip("0_"):
                raise Bad("grammar", here)
            line.append(("NUM", tok, here))
            continue
        if tok in "([{":
            depth.append(tok)
        elif tok in ")]}":
            if not depth or depth[-1][0] != _PAIR[tok]:
                raise Bad("unbalanced", here)
            if len(depth.pop()) > 1:
                tok = "}f"
        elif depth and len(depth[-1]) > 1:  # in a field of an f-string, outside its own brackets
            if tok in (":", ":="):
                depth.append("s" + depth[-1][1:])
                at = here + 1
                line.append((":f", tok, here))
                continue
        if tok == "!":
            if not (depth and len(depth[-1]) > 1 and text[at : at + 1] in ("r", "s", "a")):
                raise Bad("grammar", here)
            line.append(("!f", tok, here))
            at += 1
            continue
        line.append((tok, tok, here))
    if depth:
        raise Bad("premature_end", line[-1][2] if line else n)
    if line:
        yield indent, line


# The rules, one token of foresight. NAME, NUM, STR, FS, FE, NEWLINE, INDENT, DEDENT, END are tokens, SIMPLE is a line of simple statements that is known to be right; "match!", "case!"
# and "type!" the words where they act as keywords, "with(" a bracket right after with.
GRAMMAR = """
file: (NEWLINE | stmt)* END
stmt: simple | if | while | for | try | with | def | class | decorated | async | match
simple: SIMPLE | small (';' small)* [';'] NEWLINE
small: assign | yieldstmt | 'pass' | 'break' | 'continue' | del | return | raise | scope | import | from | assert | alias
assign: list [annotate | augment | chained]
chained: ('=' (yield | list))+
annotate: ':' test ['=' (yield | list)]
augment: ('+='|'-='|'*='|'/='|'//='|'%='|'@='|'&='|'|='|'^='|'>>='|'<<='|'**=') (yield | list)
yieldstmt: yield
del: 'del' targets
return: 'return' [list]
raise: 'raise' [test ['from' test]]
scope: ('global' | 'nonlocal') NAME (',' NAME)*
import: 'import' module (',' module)*
module: dotted ['as' NAME]
dotted: NAME ('.' NAME)*
from: 'from' (('.' | '...')+ [dotted] | dotted) 'import' ('*' | '(' only (',' only)* [','] ')' | only (',' only)*)
only: NAME ['as' NAME]
assert: 'assert' test [',' test]
alias: 'type!' NAME [generics] '=' test
suite: simple | NEWLINE INDENT stmt+ DEDENT
if: 'if' named ':' suite ('elif' named ':' suite)* ['else' ':' suite]
while: 'while' named ':' suite ['else' ':' suite]
for: 'for' targets 'in' list ':' suite ['else' ':' suite]
try: 'try' ':' suite ((except ':' suite)+ ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite)
except: 'except' ['*'] [test ['as' NAME]]
with: 'with' context (',' context)* ':' suite
context: test ['as' target]
def: 'def' NAME [generics] '(' [params] ')' ['->' test] ':' suite
class: 'class' NAME [generics] ['(' [args] ')'] ':' suite
decorated: ('@' named NEWLINE)+ (def | class | async)
async: 'async' (def | with | for)
generics: '[' generic (',' generic)* [','] ']'
generic: ('*' | '**') NAME ['=' item] | NAME [':' test] ['=' test]
match: 'match!' list ':' NEWLINE INDENT case+ DEDENT
case: 'case!' patterns ['if' named] ':' suite
patterns: pattern (',' pattern)* [',']
pattern: '*' NAME | simplepat ('|' simplepat)* ['as' NAME]
simplepat: ['-'] NUM [('+' | '-') NUM] | strings | 'None' | 'True' | 'False' | dotted ['(' [patargs] ')'] | '(' [patterns] ')' | '[' [patterns] ']' | '{' [patitem (',' patitem)* [',']] '}'
patargs: patarg (',' patarg)* [',']
patarg: pattern ['=' pattern]
patitem: '**' NAME | simplepat ':' pattern
params: param (',' param)* [',']
param: NAME [':' test] ['=' test] | '*' [NAME [':' item]] | '**' NAME [':' test] | '/'
lparams: lparam (',' lparam)* [',']
lparam: NAME ['=' test] | '*' [NAME] | '**' NAME | '/'
list: item (',' item)* [',']
item: '*' expr | named
named: test [':=' test]
test: chain ['if' chain 'else' test] | lambda
lambda: 'lambda' [lparams] ':' test
chain: inverse (('and' | 'or') inverse)*
inverse: 'not' inverse | expr (compare expr)*
compare: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' ['not']
expr: ('+' | '-' | '~')* power (('+'|'-'|'*'|'/'|'//'|'%'|'@'|'**'|'<<'|'>>'|'&'|'^'|'|') ('+' | '-' | '~')* power)*
power: ['await'] atom trailer*
trailer: call | subscript | '.' NAME
call: '(' [args] ')'
subscript: '[' slice (',' slice)* [','] ']'
slice: '*' expr | named [':' [test] [':' [test]]] | ':' [test] [':' [test]]
args: arg (',' arg)* [',']
arg: '*' test | '**' test | named ['=' test | comp]
atom: paren | square | braces | NAME | NUM | strings | 'None' | 'True' | 'False' | '...'
paren: '(' [yield | items] ')' | 'with(' [yield | contexts] ')'
contexts: contextitem (comp | (',' contextitem)* [','])
contextitem: item ['as' target]
square: '[' [items] ']'
items: item (comp | (',' item)* [','])
braces: '{' [entries] '}'
entries: entry (comp | (',' entry)* [','])
entry: '**' expr | '*' expr | named [':' test]
comp: ['async'] 'for' targets 'in' chain [more]
more: comp | 'if' chain [more]
targets: target (',' target)* [',']
target: '*' expr | expr
yield: 'yield' ['from' test | list]
strings: (STR | fstring)+
fstring: FS field* FE
field: '{f' (yield | list) ['='] ['!f'] [':f' field*] '}f'
"""


@lru_cache(maxsize=1)
def automata() -> tuple[list[str], list[list[tuple[dict[str, tuple[int, tuple[int, ...]]], bool]]]]:
    """(rule names, rules): per rule its states, each a map token -> (next state, rules to enter on the way) and whether
    the rule may end there. Built from GRAMMAR; raises where one token does not decide."""
    names = [x.split(":", 1)[0] for x in GRAMMAR.strip().split("\n")]
    number = {x: i for i, x in enumerate(names)}
    plain: list[list[tuple[dict[str, int], bool]]] = []
    for text in GRAMMAR.strip().split("\n"):
        toks = regex.findall(r"'[^']+'|\w+|[()\[\]|*+]", text.split(":", 1)[1])
        edges: list[list[tuple[str, int]]] = []  # "" is a move without a token

        def node(edges: list = edges) -> int:
            edges.append([])
            return len(edges) - 1

        def choice(i: int, a: int, b: int, edges: list = edges, toks: list = toks, node=node) -> int:  # noqa: ANN001
            while True:
                at = a
                while i < len(toks) and toks[i] not in (")", "]", "|"):
                    i, at = item(i, at)
                edges[at].append(("", b))
                if i < len(toks) and toks[i] == "|":
                    i += 1
                    continue
                return i

        def item(i: int, a: int, edges: list = edges, toks: list = toks, node=node) -> tuple[int, int]:  # noqa: ANN001
            b, c = node(), node()
            edges[a].append(("", b))
            t = toks[i]
            if t in "([":
                i = choice(i + 1, b, c) + 1
                if t == "[":
                    edges[b].append(("", c))
            else:
                edges[b].append((t, c))
                i += 1
            if i < len(toks) and toks[i] in "*+":
                edges[c].append(("", b))
                if toks[i] == "*":
                    edges[b].append(("", c))
                i += 1
            d = node()
            edges[c].append(("", d))
            return i, d

        first, last = node(), node()
        choice(0, first, last)

        def closure(nodes: set[int], edges: list = edges) -> frozenset[int]:
            todo = list(nodes)
            while todo:
                for t, b in edges[todo.pop()]:
                    if not t and b not in nodes:
                        nodes.add(b)
                        todo.append(b)
            return frozenset(nodes)

        states = [closure({first})]
        out: list[tuple[dict[str, int], bool]] = []
        for st in states:  # grows while it is read
            go: dict[str, set[int]] = {}
            for x in st:
                for t, b in edges[x]:
                    if t:
                        go.setdefault(t, set()).add(b)
            moves = {}
            for t, bs in go.items():
                c = closure(bs)
                if c not in states:
                    states.append(c)
                moves[t] = states.index(c)
            out.append((moves, last in st))
        plain.append(out)

    firsts: dict[int, dict[str, tuple[int, ...]]] = {}

    def first_of(r: int) -> dict[str, tuple[int, ...]]:
        """Token -> rules to enter below this one until the token itself is met."""
        if r not in firsts:
            firsts[r] = {}
            for t, _ in plain[r][0][0].items():
                more = {k: (number[t], *v) for k, v in first_of(number[t]).items()} if t in number else {t.strip("'"): ()}
                if more.keys() & firsts[r].keys():
                    raise ValueError(f"{names[r]}: one token does not decide")
                firsts[r] |= more
        return firsts[r]

    rules = []
    for states in plain:
        made = []
        for moves, end in states:
            table: dict[str, tuple[int, tuple[int, ...]]] = {}
            for t, to in moves.items():
                more = {k: (to, (number[t], *v)) for k, v in first_of(number[t]).items()} if t in number else {t.strip("'"): (to, ())}
                if more.keys() & table.keys():
                    raise ValueError("one token does not decide")
                table |= more
            made.append((table, end))
        rules.append(made)
    return names, rules


#: What rides on the stack: not assignable, a tuple or list of targets, one target, a plain name; then kinds of arguments,
#: parameters and entries.
NOT, SEQUENCE, TARGET, NAME = 0, 1, 2, 3
POSITIONAL, KEYWORD, STAR, DOUBLE, GENERATOR, DEFAULT, SLASH, PAIR, SINGLE = 10, 11, 12, 13, 14, 15, 16, 17, 18
#: Rules whose number is that of all their parts, and those that keep the number of their only part.
_ALL = frozenset("list items contexts targets".split())
_ARGUMENTS = frozenset("args params lparams entries patargs".split())


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(symbol of the grammar, text, position), with line ends and changes of indentation."""
    columns = [(0, 0)]
    cases = [False]  # by level: does it hold the cases of a match
    opened = False
    pos = 0
    for indent, line in logical_lines(text):
        pos = line[0][2]
        indent = indent.rpartition("\f")[2]
        col = alt = 0
        for c in indent:
            col = (col // 8 + 1) * 8 if c == "\t" else col + 1
            alt += 1
        if col == columns[-1][0]:
            if alt != columns[-1][1]:
                raise Bad("grammar", pos)
        elif col > columns[-1][0]:
            if alt <= columns[-1][1]:
                raise Bad("grammar", pos)
            columns.append((col, alt))
            cases.append(opened)
            yield "INDENT", "", pos
        else:
            while col < columns[-1][0]:
                columns.pop()
                cases.pop()
                yield "DEDENT", "", pos
            if (col, alt) != columns[-1]:
                raise Bad("grammar", pos)
        first, second, last = line[0], line[1] if len(line) > 1 else ("", "", pos), line[-1]
        opened = False
        if first[0] == "NAME" and len(line) > 1:
            operand = second[0] in _OPERAND
            if first[1] == "match" and last[0] == ":" and operand or first[1] == "case" and cases[-1]:
                line[0] = (first[1] + "!", *first[1:])
                opened = first[1] == "match"
            elif first[1] == "type" and second[0] == "NAME":
                line[0] = ("type!", *first[1:])
        elif first[0] == "with" and second[0] == "(":
            line[1] = ("with(", *second[1:])
        line.append(("NEWLINE", "", last[2]))
        yield from _known(line)
        pos = last[2]
    for _ in columns[1:]:
        yield "DEDENT", "", pos
    yield "END", "", len(text)


def _order(name: str, seen: list[int], now: int, pos: int) -> None:
    """The order of arguments, parameters and entries."""
    if name == "patargs":
        bad = now != KEYWORD and KEYWORD in seen
    elif name == "args":
        bad = (now == POSITIONAL and (KEYWORD in seen or DOUBLE in seen)) or (now == STAR and DOUBLE in seen) or (GENERATOR in seen) or (now == GENERATOR and seen)
    elif name == "entries":
        bad = bool(seen) and seen[0] != now
    else:
        stars = STAR in seen or GENERATOR in seen
        bad = DOUBLE in seen or (now in (STAR, GENERATOR) and stars) or (now == SLASH and (stars or SLASH in seen or not seen)) or (now == POSITIONAL and DEFAULT in seen and not stars)
    if bad:
        raise Bad("grammar", pos)
    seen.append(now)


_OPERAND = frozenset(("NAME", "NUM", "STR", "FS", "(", "[", "{", "-", "~", "*", "...", "not", "lambda", "await", "None", "True", "False"))
#: Lines known to be right, by their symbols: what stands for them. Forgotten when they are too many.
_LINES: dict[tuple[str, ...], tuple[str, ...] | None] = {}
MOST_LINES = 50_000
#: Heads of compound statements, and the shortest that is as good as any.
_HEADS = {"if": "if NAME :", "elif": "elif NAME :", "while": "while NAME :", "with": "with NAME :", "for": "for NAME in NAME :", "def": "def NAME ( ) :", "class": "class NAME :"}
_BODY_OF = (("INDENT", "", 0), ("SIMPLE", "", 0), ("DEDENT", "", 0))


def _known(line: list[Token]) -> list[Token]:
    """The line, or less that is right exactly where it is: most lines are built like one that was read before."""
    key = tuple([x[1] if x[0] == "STR" else x[0] for x in line])
    short = _LINES.get(key, ())
    if short == ():
        short = None
        head = _HEADS.get(key[0])
        try:
            if head is None:
                if key[0] not in _COMPOUND:
                    read("simple", line)
                    short = ("SIMPLE",)
            elif key[-2] == ":":
                rule = "if" if key[0] == "elif" else key[0]
                read(rule, [(rule, "", 0), *line[1:], *_BODY_OF])
                short = (*head.split(), "NEWLINE")
        except Bad:
            short = None
        if len(_LINES) >= MOST_LINES:
            _LINES.clear()
        _LINES[key] = short
    return line if short is None else [(x, "", line[0][2]) for x in short]


_COMPOUND = frozenset(("try", "except", "finally", "else", "async", "@", "match!", "case!"))


def python_error(text: str) -> Verdict:
    """None for a valid file, else (kind, position) of the first error."""
    try:
        read("file", _tokens(text), len(text))
    except Bad as e:
        return e.args[0], e.args[1]
    return None


def read(rule: str, tokens: Iterable[Token], end: int = 1 << 60) -> None:
    """Raises Bad at the first token that the rule cannot have."""
    names, rules = automata()
    # an entry: rule, its name, state, parts read, number, order of arguments
    stack: list[list] = [[rules[names.index(rule)], rule, 0, 0, NOT, None]]
    for sym, tok, pos in tokens:
        while True:
            top = stack[-1]
            table, may_end = top[0][top[2]]
            go = table.get(sym)
            if go is not None:
                break
            if not may_end or len(stack) == 1:
                raise Bad("premature_end" if sym == "END" or pos >= end else "grammar", pos)
            stack.pop()
            _done(top, stack[-1], pos)
        top[2] = go[0]
        for r in go[1]:
            of = rules[r]
            top = [of, names[r], of[0][0][sym][0], 0, NOT, None]
            stack.append(top)
        note = _ON_TOKEN.get(top[1])
        if note:
            note(top, sym, tok, pos)
        top[3] += 1
    while len(stack) > 1 and stack[-1][0][stack[-1][2]][1]:
        top = stack.pop()
        _done(top, stack[-1], 0)
    if len(stack) > 1 or not stack[0][0][stack[0][2]][1]:
        raise Bad("premature_end", end)


def _on_atom(top: list, sym: str, tok: str, pos: int) -> None:
    top[4] = NAME if sym == "NAME" else NOT


def _on_bracket(top: list, sym: str, tok: str, pos: int) -> None:
    if sym in ("(", "[", "with("):
        top[4] = SEQUENCE


def _on_param(top: list, sym: str, tok: str, pos: int) -> None:
    if sym == "NAME":
        top[4] = STAR if top[4] == GENERATOR else top[4] or POSITIONAL
    elif sym in ("*", "**", "/"):
        top[4] = {"*": GENERATOR, "**": DOUBLE, "/": SLASH}[sym]
    elif sym == "=":
        top[4] = DEFAULT


def _on_arg(top: list, sym: str, tok: str, pos: int) -> None:
    if sym == "=":
        if top[4] != POSITIONAL or top[5] != NAME:
            raise Bad("grammar", pos)
        top[4] = KEYWORD
    else:
        top[4] = STAR if sym == "*" else DOUBLE


def _on_entry(top: list, sym: str, tok: str, pos: int) -> None:
    if sym == ":" and top[5] == -1:
        raise Bad("grammar", pos)
    top[4] = {"*": STAR, "**": DOUBLE, ":": PAIR}[sym]


def _on_comma(top: list, sym: str, tok: str, pos: int) -> None:
    top[4] = min(top[4], SEQUENCE)


def _on_named(top: list, sym: str, tok: str, pos: int) -> None:
    if top[4] != NAME:
        raise Bad("grammar", pos)
    top[4], top[5] = NOT, -1


def _on_trailer(top: list, sym: str, tok: str, pos: int) -> None:
    top[4] = TARGET


def _on_patarg(top: list, sym: str, tok: str, pos: int) -> None:
    top[4] = KEYWORD


def _on_string(top: list, sym: str, tok: str, pos: int) -> None:
    """Text and octets don't go together."""
    if top[5] is not None and top[5] != tok:
        raise Bad("grammar", pos)
    top[5] = tok


def _on_chained(top: list, sym: str, tok: str, pos: int) -> None:
    if top[3] and not top[4]:
        raise Bad("grammar", pos)


def _on_star(top: list, sym: str, tok: str, pos: int) -> None:
    top[5] = sym


def _on_operator(top: list, sym: str, tok: str, pos: int) -> None:
    top[4], top[5] = NOT, sym


#: What a token of a rule's own changes.
_ON_TOKEN = {
    "atom": _on_atom, "paren": _on_bracket, "square": _on_bracket, "param": _on_param, "lparam": _on_param, "arg": _on_arg, "entry": _on_entry, "patarg": _on_patarg, "list": _on_comma, "items": _on_comma, "contexts": _on_comma, "targets": _on_comma,
    "named": _on_named, "trailer": _on_trailer, "subscript": _on_trailer, "strings": _on_string, "chained": _on_chained, "item": _on_star, "target": _on_star,
    "test": _on_operator, "inverse": _on_operator, "expr": _on_operator, "power": _on_operator, "chain": _on_operator,
}


#: Rules around one part that pass its number on, as long as there is no more to them.
_PASS = frozenset("test chain inverse expr named slice atom".split())


def _done(child: list, top: list, pos: int) -> None:
    """Notes what a rule that ends makes of the one around it."""
    name, of, number = child[1], top[1], child[4]
    first = top[3] == 0
    top[3] += 1
    if name == "list" and child[5] == -1 and of != "match":  # a bare := at the top of a statement
        raise Bad("grammar", pos)
    if of in _PASS:
        top[4] = number if first else NOT
        return
    if name in ("params", "lparams") and child[5] and child[5][-1] == GENERATOR:
        raise Bad("grammar", pos)
    if of in _ALL:
        if name == "comp":
            if top[5] == "*":
                raise Bad("grammar", pos)
            top[4] = NOT
        else:
            top[4] = number if first else min(top[4], number, TARGET)
            top[5] = child[5] if child[5] in ("*", -1) else None if first else top[5]
    elif of in _ARGUMENTS:
        if name == "comp":
            if top[4] in (STAR, DOUBLE):
                raise Bad("grammar", pos)
        else:
            top[4], top[5] = number, top[5] or []
            now = {STAR: SINGLE, DOUBLE: PAIR}.get(number, number) if of == "entries" else number
            if of in ("params", "lparams") and now == POSITIONAL and top[5] and top[5][-1] == GENERATOR:
                top[5][-1] = STAR
            elif of in ("params", "lparams") and top[5] and top[5][-1] == GENERATOR:
                if now != DEFAULT:
                    raise Bad("grammar", pos)
                top[5][-1] = STAR
            _order(of, top[5], now, pos)
    elif of == "arg":
        if name == "comp":
            if top[4] != POSITIONAL:
                raise Bad("grammar", pos)
            top[4] = GENERATOR
        elif name == "named":
            top[4], top[5] = POSITIONAL, number
    elif of == "entry":
        if name == "named":
            top[4], top[5] = SINGLE, child[5]
    elif of in ("paren", "square"):
        if name == "yield":
            top[4] = NOT
        else:
            if of == "paren" and child[3] == 1:  # brackets around one thing change nothing
                if name == "items" and child[5] == "*":
                    raise Bad("grammar", pos)
                top[4] = min(number, TARGET)
            else:
                top[4] = min(number, SEQUENCE)
    elif of == "power":
        top[4] = number if top[5] is None else NOT
    elif of == "trailer":
        top[4] = NOT if name == "call" else TARGET
    elif of == "item" or of == "target":
        top[4] = min(number, TARGET) if top[5] == "*" else number
        top[5] = -1 if name == "named" and child[5] == -1 else top[5]
    elif of == "strings":
        if top[5] == "b":
            raise Bad("grammar", pos)
        top[5] = "s"
    elif of == "assign":
        if first:
            top[4] = number
        elif top[4] < (SEQUENCE if name == "chained" else TARGET):
            raise Bad("grammar", pos)
    elif of == "chained":
        top[4] = number if name == "list" else NOT
    elif of == "small" or of == "del" or of == "for" or of == "comp" or of == "context" or of == "contextitem":
        if name in ("targets", "target") and not number:
            raise Bad("grammar", pos)
        if of == "contextitem" and name == "item":
            top[4], top[5] = number, child[5]
    elif of in ("param", "lparam", "patarg"):
        pass
    else:
        top[4] = NOT
