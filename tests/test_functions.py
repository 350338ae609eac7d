"""Row-level rules against hand-written cases."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions import scoring as S
from codequarry.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("path", "lang", "test", "area", "component"),
    [
        ("src/flask/app.py", "python", False, "src/flask", "src/flask"), ("src/app.py", "python", False, "src", "src"), ("setup.py", "python", False, "(root)", "."),
        ("backend/app/main.PY", "python", False, "backend", "backend/app"), ("services/ml/serve.py", "python", False, "services/ml", "services/ml"),
        ("a/Tests/x.js", "javascript", True, "a", "a/Tests"), ("x/test_a.py", "python", True, "x", "x"), ("FooTest.java", "java", True, "(root)", "."), ("Makefile", None, False, "(root)", "."),
        (".gitignore", None, False, "(root)", "."), ("a/b.", None, False, "a", "a"), ("w/a.spec.ts", "typescript", True, "w", "w"),
    ],
)
def test_paths(spark, path, lang, test, area, component):
    assert one(spark, path, P.language) == lang
    assert one(spark, path, P.is_test) is test
    assert one(spark, path, P.area) == area
    assert one(spark, path, P.component_of) == component


@pytest.mark.parametrize(
    ("path", "reason"),
    [
        ("a/__pycache__/x.cpython.pyc", "build output or cache (__pycache__/)"), ("dist/app.js", "build output (dist/)"), ("dist/app.py", None), ("pkg.egg-info/x.txt", "build output or cache (pkg.egg-info/)"),
        ("x.pyc", "compiled Python"), ("a/lib.min.css", "minified file"), ("a/app.js.map", "source map"), ("cache/3e5a472df573dc695289f1adde2d59e0.json", "cache entry (hash-named file)"), (".coverage", "test coverage output"), ("a/Thumbs.db", "operating system metadata"), ("a/b.py", None),
    ],
)
def test_generated_reason(spark, path, reason):
    assert one(spark, path, P.generated_reason) == reason


def test_local_kind_ancestors_stems(spark):
    assert one(spark, "b/.env.local", P.local_file_kind) == "environment file"
    assert one(spark, ".env.example", P.local_file_kind) is None
    assert one(spark, "x.db", P.local_file_kind) == "database file"
    assert one(spark, "thumbs.db", P.local_file_kind) is None
    assert one(spark, "a/b/c.py", P.ancestors) == [".", "a", "a/b"]
    assert one(spark, "c.py", P.ancestors) == ["."]
    for p, stem in (("services/ml/tmdb_client.py", "tmdb"), ("backend/tmdbService.js", "tmdb"), ("x/payment-gateway.ts", "paymentgateway"), ("utils.py", "")):
        assert one(spark, p, P.name_stem) == stem
    assert one(spark, "src/a/__init__.py", P.dotted_suffixes) == ["src.a"]
    assert one(spark, "src/a/b.py", P.dotted_suffixes) == ["src.a.b", "a.b"]
    assert one(spark, "a.py", P.dotted_suffixes) == []


@pytest.mark.parametrize(
    ("uri", "kind"),
    [("https://github.com/pallets/flask", "github"), ("https://github.com/pallets/flask.git", "github"), (" https://github.com/pallets/flask/ ", "github"), ("http://github.com/a/b", None), ("https://gitlab.com/a/b", None), ("git@github.com:a/b", None), ("https://github.com/a/..", None), ("/tmp/x", "local"), ("", None)],
)
def test_uri(spark, uri, kind):
    got = one(spark, uri, P.parse_source_uri)
    assert (got and got["kind"]) == kind


@pytest.mark.parametrize(
    ("text", "want"),
    [("a\nb\n", (2, 2, 0)), ("a\n\n  \nb", (4, 2, 0)), ("", (0, 0, 0)), ("a\r\n\r\n", (2, 1, 0)), ("\tx\n\t\ty\n", (2, 2, 3)), ("  x\n", (1, 1, 0)), (None, (None, None, None))],
)
def test_line_metrics(spark, text, want):
    got = one(spark, text, T.line_metrics)
    if text is not None:
        assert tuple(got) == want
    else:
        assert got["lines"] in (None, -1) or got is None


def test_text_rules(spark):
    assert one(spark, "x\n# @generated\n", T.generated_marker) == "marked as generated"
    assert one(spark, "1\n2\n3\n4\n5\n# @generated\n", T.generated_marker) is None
    assert one(spark, "Where is send_static_file() defined?", T.terms) == ["where", "send_static_file", "defined"]
    assert one(spark, "a an in", T.terms) == []
    assert one(spark, "TimestampSigner.get_signature", T.split_words) == ["timestamp", "signer", "get", "signature"]
    for w, s in (("signing", "sign"), ("signed", "sign"), ("class", "class"), ("boxes", "box"), ("is", "is")):
        assert one(spark, w, T.stem) == s
    assert one(spark, "see app\\x.py:76–120, b.md:3 and b.md:3", T.citations) == [("app/x.py", 76, 120), ("b.md", 3, None)]
    assert one(spark, "a\r\nb\n", T.split_lines) == ["a", "b"]
    assert one(spark, "  Jo\u0308rg   M\u00fcller ", lambda c: T.normalize_name(c)) == "j\u00f6rg m\u00fcller"
    assert set(one(spark, "  alpha beta\n# no\nshort\n  alpha beta\n", T.significant_lines)) == {"alpha beta"}


def test_rounding(spark):
    r = spark.createDataFrame([(0.0005,), (-0.0005,), (1.2345,)], "v double").select(S.round3(F.col("v"))).collect()
    assert [x[0] for x in r] == [0.001, 0.0, 1.235]
