"""The lexers against the parsers of the standard library, which decide nothing themselves."""

import ast
import json
import random
import re
import tomllib
import warnings

import duckdb
import pytest

from codequarry.llm import lexers

PYTHON = [
    'f() = 1', 'f().a = 1', 'f()[0] += 1', 'a, b += 1', '(a, b): int', '(a): int = 3', '[a, b] = c', '[a, b] += c', 'a + b = c', 'x = y + 1 = z', '*a, b = c', '(*a) = 1', 'print(*a)', 'f(a=1, b)',
    'f(**a, *b)', 'f(a=1, *b)', 'f(**a, b=1)', 'f(x for x in y, 1)', 'f(1, x for x in y)', 'f((x for x in y), 1)', 'f(a.b=1)', 'f((a)=1)', 'def f(a=1, b): pass', 'def f(*, a): pass', 'def f(*): pass',
    'def f(a, /, b): pass', 'def f(/): pass', 'def f(*, **k): pass', 'def f(**k, a): pass', 'def f(a, *, b=1, c): pass', 'lambda *: 1', 'lambda a=1, b: 1', 'del f()', 'del a, b[1]',
    'for f() in x: pass', 'for a, b in x: pass', 'with a as f(): pass', 'with a as b, c: pass', 'x = 1 if y', 'x = lambda', '(x := 1)', 'x := 1', '(a.b := 1)', '{1: 2, 3}', '{1, 2: 3}', '{**a, 1: 2}',
    '{*a, 1}', '{x: y for x in z}', '{x for x in z}', '{x: y, z for x in z}', '[*a for a in b]', '(yield)', 'x = yield', 'yield = 1', 'await x', 'not x', 'a not b', 'a is not b', 'a not in b',
    'a == not b', 'a and not b', "b'a' 'b'", "f'{x}' 'a'", "f'{}'", "f'{x!z}'", "f'{x:{y}}'", "f'{x=}'", "f'}'", "f'{{}}'", "'\\x1'", "b'\\x1'", "'\\N{foo}'", '0777', '0_7', '1__0', '1_000', '0x',
    '1e', '1abc', '1if x else 2', 'a b', 'print x', "exec 'a'", 'import a.b as c', 'import a as b.c', 'from . import a', 'from .a import (b, c,)', 'from a import b,', 'from a import *',
    'from a import (*)', 'global a, b', 'global a.b', 'raise x from y', 'raise x, y', 'assert x, y', 'try: pass\nexcept A, B: pass', 'try: pass\nexcept (A, B) as e: pass',
    'try: pass\nexcept* A: pass', '@a.b(c)\ndef f(): pass', '@a\nx = 1', 'class A(b, c=d): pass', 'class A: pass', 'type X = int', 'type = 3', 'match = 1', 'match(x)', 'match x:\n case 1: pass',
    'match x:\n case A(b=1, c) : pass', 'case = 2', 'if x:\npass', 'if x:\n  pass\n   pass', 'if x:\n    a\n  b', 'if x:\n\ta\n        b', 'x = (1,\n2)', 'x = [1, 2', "x = 'abc", "x = '''abc",
    'else: pass', 'return', 'a;b;', 'a;;b', 'a = $b', 'a?', 'x[1:2,:]', 'x[]', 'x[*a]', 'x[a:=1]', 'x[::]', 'x[:::]', '()', '(,)', '[,]', 'f(,)', 'f(a,)', '(a for b in c if d if e)',
    '[a for b in c if d else e]', '[a if b else c for d in e]', 'async def f(): pass', 'async x', 'lambda: (yield)', 'a if b else lambda: c', 'x: int', 'x: int = yield', 'a.1', 'a..b', '...',
    '-x ** -y', 'x = *a, b', 'return *a, b', "print(f'a' b'b')", 'a <> b', 'a = b = c = 1', '1 = a', 'None = 1', 'a.None', 'def None(): pass', '(a, b) = c = d', 'for x in *a, b: pass', '\\\nx',
    'x = \\\n 1', 'x = \\ 1', 'with (a, b): pass', 'with (a): pass', 'with (a as b): pass', 'with (a), b: pass', 'with (yield x): pass', '# c', '\x0c\nx', 'x = 1 # c', 'def f[T](a: T): pass',
    'class A[T: int, *U, **P]: pass', 'f(a for b in c)(d)', 'f(**a for a in b)', 'async with a: pass', '(await x)', 'nonlocal a', 'pass a', 'x = {**a for a in b}',
]
TOML = [
    'a=1\na=2', '[a]\n[a]', '[a]\nb.c=1\n[a.b]\n', '[a]\nb.c=1\n[a.b.d]\n', '[[a]]\n[a]', '[a]\n[[a]]', 'a=[1]\n[[a]]', 'a={b=1}\n[a.c]', 'a={b=1}\na.c=2', 'a={b=1,b=2}', 'a={b.c=1,b.d=2}',
    'a={b={c=1},b.d=2}', 'a={b=1,}', 'a=[1,]', 'a=[,]', 'a=[1 2]', 'a=01', 'a=1_0', 'a=1__0', 'a=0x1F', 'a=+0x1', 'a=1.', 'a=.5', 'a=1e5', 'a=1.e5', 'a=inf', 'a=-nan', 'a=2020-01-01', 'a=2020-02-30',
    'a=2020-01-01T00:00:00Z', 'a=2020-01-01 00:00:00+01:00', 'a=24:00:00', 'a=07:32:00.5', 'a="\\q"', 'a="\\u00e9"', 'a="\\ud800"', 'a="""x""""', 'a="""x""""""', 'a="""\\\n  x"""', 'a="""\\ x"""',
    "a='''x''''", "a='x", "a='x\ny'", 'a="x\ty"', 'a="x\x01"', '# \x01', 'a.b.c=1\na.b=2', 'a.b=1\na.b.c=2', '"a"=1\na=2', '[a.b]\n[a]\n', '[a]\n[a.b]\n[a]', '[a.b]\n[a]\nb.c=1',
    '[[a]]\n[a.b]\n[[a]]\n[a.b]', '[[a.b]]\n[a]', '[ a . "b" ]\nx=1', '[a]b=1', '[a] # c\n', 'a=1 b=2', '=1', 'a', 'a=', 'a=tru', 'a=true', '[', '[]', '[a', '[[a]', 'a="""x', 'a={',
    'a=[{b=1},\n{c=2}]', 'a={b=\n1}', '\ufeffa=1', 'a=1\r', 'a=1\r\nb=2', 'a = "\\u00e9"\n"é" = 1\n"\\u00e9" = 2', 'a.b=1\n[a]\nc=1', '[a]\nb=1\n[a.b]', 'a=[[[[1]]]]', 'fruit.apple=1\n[fruit]\n',
    '[x.y]\n[x]\ny.z=1', 'a=[1]\na.b=1', 'a=0\n[a.b]', '[[x]]\na=1\n[[x]]\na=2\n[x.b]\n[[x.c]]',
]


def valid(language, text):
    try:
        if language == "toml":
            tomllib.loads(text)
        elif language == "json":
            json.loads(text, parse_constant=lambda _: 1 / 0)
        else:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "f", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, ZeroDivisionError):
        return False
    return True


@pytest.mark.parametrize(("language", "text"), [("python", x) for x in PYTHON] + [("toml", x) for x in TOML])
def test_cases(language, text):
    assert (lexers.check(language, text) is None) == valid(language, text)


def broken(rnd, text):
    """A text with one token or character lost, doubled, moved or put in."""
    spans = [m.span() for m in re.finditer(r"\w+|[^\w\s]|\n[ \t]*", text)]
    i = rnd.randrange(len(text))
    (a, b), (c, d) = rnd.choice(spans), rnd.choice(spans)
    return rnd.choice([text[:i], text[:a] + text[b:], text[:b] + " " + text[a:b] + text[b:], text[:a] + text[c:d] + text[b:], text[:a] + rnd.choice(["=", ":", ",", "(", "]", "'", "\n", "\n    ", " if ", " in ", "*", "."]) + text[a:], text[:i] + text[i + 1 :]])


@pytest.mark.parametrize(("language", "suffix"), [("python", ".py"), ("toml", ".toml"), ("json", ".json")])
def test_whole_and_broken_files(language, suffix):
    texts = [r[0] for r in duckdb.sql(f"select text from '/root/testdata/sf0.01/file_text.parquet' where suffix(path, '{suffix}') and length(text) between 1 and 6000 order by file_id").fetchall()]
    texts += [open(m, encoding="utf-8").read() for m in (lexers.__file__, ast.__file__, tomllib.__file__) if language == "python"]
    rnd, seen = random.Random(8), {True: 0, False: 0}
    for t in texts:
        for u in (t, broken(rnd, t), broken(rnd, t)):
            ok = valid(language, u)
            seen[ok] += 1
            assert (lexers.check(language, u) is None) == ok, u
    assert min(seen.values()) > 10


@pytest.mark.parametrize(
    ("language", "text"),
    [("python", "x = " + "(" * 9000 + "1" + ")" * 9000), ("python", "x = " + "-" * 9000 + "1"), ("json", "[" * 9000 + "]" * 9000), ("toml", "a = " + "[" * 1500 + "]" * 1500), ("javascript", "x = " + "[" * 9000 + "]" * 9000), ("python", "".join("  " * i + "if x:\n" for i in range(150)) + "  " * 150 + "y\n")],
)
def test_deep_but_valid(language, text):
    assert lexers.check(language, text) is None and lexers.check(language, text[:-3] + "}") is not None
