"""Training-data operators against brute force, exact round trips, and their defined results on odd input."""

import collections
import itertools
import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.llm import cooccurrence, lexers, mixing, names, packing, parsing, provenance, ranking, spans, splitting, subjects, tokens


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---- 1 ----
def test_pairs_against_brute_force(spark):
    rnd = random.Random(5)
    data = []
    for b in range(400):
        scope = "hot" if b % 3 else "cold"
        k = rnd.randrange(1, 8)
        data += [(scope, f"b{b}", f"i{min(int(rnd.expovariate(0.15)), 40)}") for _ in range(k)]
    data += [("hot", "sweep", f"x{i}") for i in range(40)] + [(None, "b1", "i1"), ("hot", None, "i1"), ("hot", "b1", None)] + data[:30]
    df = spark.createDataFrame(data, "s string, b string, i string").withColumn("n", F.lit("clash"))
    got = {(r["scope"], r["item_a"], r["item_b"]): (r["n"], r["n_a"], r["n_b"], r["together"]) for r in cooccurrence.together(df, scope="s", basket="b", item="i", min_together=3, min_lift=1.2, heavy_share=0.2, block=64).collect()}
    want = {}
    for scope in ("hot", "cold"):
        baskets = collections.defaultdict(set)
        for s, b, i in data:
            if s == scope and b and i:
                baskets[b].add(i)
        baskets = {b: x for b, x in baskets.items() if len(x) <= 30}
        n, one, two = len(baskets), collections.Counter(), collections.Counter()
        for x in baskets.values():
            one.update(x)
            two.update(itertools.combinations(sorted(x), 2))
        for (a, b), m in two.items():
            if m >= 3 and m * n >= 1.2 * one[a] * one[b]:
                want[scope, a, b] = (n, one[a], one[b], m)
    assert got == want and len(want) > 20


def test_pairs_of_nothing(spark):
    e = spark.createDataFrame([], "s string, b string, i string")
    assert cooccurrence.together(e, scope="s", basket="b", item="i").count() == 0


# ---- 2 ----
def test_inverse_normal(spark):
    ps = [0.0005, 0.01, 0.3, 0.5, 0.77, 0.99, 0.9999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(ranking.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-6)


def test_combined_ranking(spark):
    rnd = random.Random(2)
    data = [("r", f"f{i}", 10 ** rnd.uniform(0, 6), rnd.random(), 1) for i in range(50)]
    data += [("r", "f0", 5.0, 0.5, 0), ("r", "gone", None, float("nan"), 1), ("r", "neg", -1.0, 1e15, 1), ("s", "only", 1.0, 1.0, 1), (None, "x", 1.0, 1.0, 1), ("r", None, 1.0, 1.0, 1)]
    df = spark.createDataFrame(data, "repo string, path string, a double, b double, v int")
    got = ranking.combined_ranking(df, scope="repo", key="path", scores={"a": 1.0, "b": 1.0}, version="v").collect()
    mine = [r for r in got if r["repo"] == "r"]
    assert sorted(r["position"] for r in mine) == list(range(1, 53)) and [r["position"] for r in got if r["repo"] == "s"] == [1]

    def z(vals, v):
        if v is None:
            return 0.0
        less, same = sum(x < v for x in vals), sum(x == v for x in vals)
        return statistics.NormalDist().inv_cdf((less + (same + 1) / 2 - 0.5) / len(vals))

    clean = {p: (a if a is not None and 0 <= a < 1e12 else None, b if b == b and 0 <= b < 1e12 else None) for s, p, a, b, v in data if s == "r" and p and v == 1}
    va, vb = [x for x, _ in clean.values() if x is not None], [x for _, x in clean.values() if x is not None]
    want = {p: (z(va, a) + z(vb, b)) / 2 for p, (a, b) in clean.items()}
    for r in mine:
        assert r["combined"] == pytest.approx(want[r["path"]], abs=1e-6)
    assert [r["path"] for r in sorted(mine, key=lambda r: r["position"])] == [r["path"] for r in sorted(mine, key=lambda r: (-r["combined"], r["path"]))]
    # a score in other units changes nothing
    again = ranking.combined_ranking(df.withColumn("a", F.col("a") * 100), scope="repo", key="path", scores={"a": 1.0, "b": 1.0}, version="v").filter("repo = 'r' AND path <> 'neg'")
    assert dict(rows(again, "path", "position")) == {r["path"]: r["position"] for r in mine if r["path"] != "neg"}
    assert ranking.combined_ranking(df.limit(0), scope="repo", key="path", scores={"a": 1.0}).count() == 0


def test_absurd_scores_follow_the_scale(spark):
    """A thousand million is usual where the median is a million, absurd where it is one."""
    data = [("r", f"f{i}", 1.0 + i, 1e6 + i) for i in range(9)] + [("r", "big", 1e9, 1e9)]
    df = spark.createDataFrame(data, "repo string, path string, a double, b double")
    got = {r["path"]: r for r in ranking.combined_ranking(df, scope="repo", key="path", scores={"a": 1.0, "b": 1.0}).collect()}
    assert got["big"]["a_z"] == 0.0 and got["big"]["b_z"] == max(r["b_z"] for r in got.values()) > 1


# ---- 3 ----
LINE = st.text(alphabet="ab .,#\t", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=60), st.sampled_from(["\n", "\r\n"]), st.integers(40, 200), st.integers(0, 4), st.sampled_from(["function", "text"]))
def test_pieces_cover_the_body(lines, end, limit, overlap, kind):
    body = end.join(lines)
    pieces = splitting.split_points(body, kind, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(body)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
    for a, b in pieces:
        assert b - a <= limit
        assert not (0 < b < len(body) and body[b - 1 : b + 1] == "\r\n")
    if overlap == 0:
        assert "".join(body[a:b] for a, b in pieces) == body


@pytest.mark.parametrize("size", [80, 400, 900, 1250])
def test_overlap_has_all_the_lines_asked_for(size):
    """Three lines of up to 3,750 characters fit the limit; a line above the limit has room for none at its far end."""
    body = "\n".join(f"{i:02d} " + "word " * ((size - 4) // 5) for i in range(60))
    pieces = splitting.split_points(body, "text", 4000, 3)
    assert [body[c:b].count("\n") + (body[b - 1] != "\n") for (_, b), (c, _) in zip(pieces, pieces[1:])] == [3] * (len(pieces) - 1)
    assert all(b - a <= 4000 and (a == 0 or body[a - 1] == "\n") for a, b in pieces)
    long = splitting.split_points("head\n" * 3 + "x" * 20_000 + "\n" + "tail\n" * 9, "text", 4000, 3)
    assert all(b - a <= 4000 for a, b in long) and all(a < c <= b < d for (a, b), (c, d) in zip(long, long[1:]))


def test_split_prefers_natural_boundaries(spark):
    body = "\n\n".join(f"def f{i}():\n" + "    x = 1\n" * 20 for i in range(40))
    df = spark.createDataFrame([(1, body, "function", 10, 9), (2, "short", "text", 1, 1), (3, None, "text", None, None), (4, "x" * 9000, "text", None, 7), (5, "", "text", 1, 1)], "id long, t string, k string, s int, e int")
    got = splitting.split_oversized(df, key="id", text="t", kind="k", start_line="s", end_line="e", overlap_lines=0).collect()
    one = [r for r in got if r["item_id"] == 1]
    assert len(one) >= 2 and all(r["body"].startswith("def ") for r in one) and one[0]["start_line"] == 9
    assert "".join(r["body"] for r in sorted(one, key=lambda r: r["piece"])) == body
    four = [r for r in got if r["item_id"] == 4]
    assert {r["n_chars"] <= 4000 for r in four} == {True} and {r["start_line"] for r in four} == {7}
    assert {r["item_id"] for r in got} == {1, 4}
    with pytest.raises(ValueError):
        splitting.split_oversized(df, key="id", text="t", limit=2)


# ---- 4 ----
@pytest.mark.parametrize("few", [48, 1])
def test_spans_against_brute_force(spark, few):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [word(n) for n in (19, 20, 21, 40, 90)]
    texts = [word(rnd.randrange(0, 60)) + (rnd.choice(shared) if rnd.random() < 0.7 else "") + word(rnd.randrange(0, 60)) for _ in range(60)]
    texts += ["", None, texts[3], texts[3], "z" * 100, "z" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("h", F.lit(1))
    pairs, cover, _ = spans.shared_spans(df, key="id", text="t", length=20, few=few, shard_chars=2_000_000 if few > 1 else 64)
    grams = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t or "") - 19):
            grams[t[p : p + 20]].add(i)
    want = {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}
    got = rows(pairs, "id_a", "id_b")
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    for r in cover.collect():
        t, hit = texts[r["id"]], set()
        for p in range(len(t) - 19):
            if len(grams[t[p : p + 20]]) > 1:
                hit.update(range(p, p + 20))
        assert r["shared_chars"] == len(hit) and r["n_chars"] == len(t)


def test_spans_of_nothing(spark):
    pairs, cover, passages = spans.shared_spans(spark.createDataFrame([(1, None), (2, "short")], "id long, t string"), key="id", text="t")
    assert pairs.count() == passages.count() == 0 and rows(cover, "id", "share") == [(2, 0.0)]


# ---- 5 ----
def test_names(spark):
    data = [
        (1, "Greta Halimfoeini", "greta.halimfoeini@a.example"), (2, "Halimfoeini, Greta", "ghalimfoeini@b.example"), (3, "Gréta  HALIMFOEINI", None), (4, "Greta Halmifoeini", "build@ci.invalid"), (5, "G. Halimfoeini", "halimfoeinig@c.example"),
        (6, "Kofi Halimfoeini", "kofi.halimfoeini@a.example"), (7, "GretaHalimfoeini", "build@ci.invalid"), (8, None, "greta.halimf77@z.example"), (9, "greta", "greta.halimfoeini@bluefox12.example"), (10, "bluefox12", "x@y.example"),
        (11, "Parangoley Software GmbH", "oss@parangoley.example"), (12, "PARANGOLEY SOF.", "hello@parangoley.example"), (13, "unknown", None), (14, None, None), (15, "", ""), (16, "Kim", "amber433@q.example"), (17, "Tim Wilikdreini", "wilikdreinit@a.example"), (18, "Timothy Wilikdreini", "timothy_wilikdreini@b.example"),
    ]
    df = spark.createDataFrame(data, "id long, name string, email string").withColumn("names", F.lit(None).cast("array<string>")).withColumn("form", F.lit(1))
    got = dict(rows(names.link_names(df, key="id", name="name", names="names", email="email"), "id", "entity"))
    greta = {i for i, e in got.items() if e == got[1]}
    assert {1, 2, 3, 4, 5, 7, 8, 9, 10} <= greta and not greta & {6, 11, 13, 14, 15, 16}
    assert got[11] == got[12] and got[17] == got[18] and got[6] != got[1]
    assert names.link_names(df.limit(0), key="id", name="name", names="names", email="email").count() == 0


def test_no_form_is_cut_from_a_shared_key(spark):
    """Three forms on init:jane|s; the address of row 1 points to the least frequent one."""
    data = [(1, "Jane S.", "jane.strom@x.example"), (2, "Jane Strom", "jane.strom@y.example")]
    data += [(100 + i, "Jane Sandor", f"jane.sandor@h{i}.example") for i in range(24)] + [(200 + i, "Jane Sibelius", f"jane.sibelius@h{i}.example") for i in range(12)]
    got = dict(rows(names.link_names(spark.createDataFrame(data, "id long, name string, email string"), key="id", name="name", names=None, email="email"), "id", "entity"))
    assert got.get(1) == got[2] and len({got[2], got[100], got[200]}) == 3


def test_names_of_any_script(spark):
    data = [
        (1, "Иван Петров", "ivan.petrov@a.org"), (2, "Петров Иван", None), (3, "Ivan Petrov", "ipetrov@b.org"), (4, "Анна Петрова", "anna.petrova@a.org"),
        (5, "王小明", "w@a.cn"), (6, "王 小明", None), (7, "王小红", None), (8, "प्रिया शर्मा", None), (9, "शर्मा प्रिया", None), (10, "김민준", None), (11, "김 민준", None), (12, "Γιώργος Παππάς", None), (13, "giorgos pappas", "giorgos.pappas@c.gr"),
        (20, None, "contact@foo.org"), (21, "Foo Foundation", "hello@foo.org"), (22, "The Foo Project", None), (23, "Bar Labs", "info@mail.bar.co.uk"), (24, "BAR LAB.", None), (25, "", "info@bar.co.uk"), (26, "Jane Doe via Lists", "jane.doe@x.org"), (27, "Doe, Jane", None),
    ]
    df = spark.createDataFrame(data, "id long, name string, email string")
    got = dict(rows(names.link_names(df, key="id", name="name", names=None, email="email"), "id", "entity"))
    for same in ((1, 2, 3), (5, 6), (8, 9), (10, 11), (12, 13), (20, 21, 22), (23, 24, 25), (26, 27)):
        assert len({got.get(i) for i in same}) == 1 and None not in {got.get(i) for i in same}, same
    assert len({got[i] for i in (1, 4, 5, 7, 8, 10, 12, 20, 23, 26)}) == 10


def test_known_people_join_forms(spark):
    df = spark.createDataFrame([(1, "Ann Onesurname", "ann.onesurname@a.x"), (2, "Ann Twosurname", "ann.twosurname@a.x")], "id long, name string, email string")
    known = spark.createDataFrame([("p", ["ann.onesurname@a.x", "ANN.twosurname@a.x"])], "id string, emails array<string>")
    links = names.link_names(df, key="id", name="name", names=None, email="email", known=known)
    assert rows(names.pairs_within(links, key="id", entity="entity"), "id_a", "id_b") == [(1, 2)]


# ---- 6 ----
@pytest.mark.parametrize(
    ("lang", "text", "kind"),
    [
        ("python", "", None), ("python", "x = 1\n", None), ("python", "def f(:\n", "premature_end"), ("python", "x = 'a\n", "unterminated"), ("python", "x = (1]\n", "unbalanced"), ("python", "if x\n  y\n", "grammar"), ("python", '"""\n<<<<<<< HEAD\n"""\n', None), ("python", "<<<<<<< HEAD\nx\n=======\n", "conflict"), ("python", "x = f\"{a['b']}\"\n", None), ("python", "﻿x = 1\r\n", None),
        ("json", "", "premature_end"), ("json", '{"a": [1, 2]}', None), ("json", "{'a': 1}", "grammar"), ("json", '{"a": 1,}', "grammar"), ("json", "NaN", "grammar"), ("json", '{"a": 1} {"b": 2}', "grammar"), ("json", '{"a": "b', "unterminated"), ("json", '{"a": [1', "premature_end"), ("json", " 1 ", None), ("json", '[1}', "unbalanced"),
        ("toml", "a = 1\n[b]\nc = 'x'\n", None), ("toml", "a =\n", "grammar"), ("toml", "a = [1, 2\n", "premature_end"), ("toml", 'a = "x\n', "unterminated"), ("toml", "", None),
        ("javascript", "", None), ("javascript", "const a = `x ${b} 1`;\n", None), ("javascript", "export interface X { a: number }", "grammar"), ("javascript", "function f(a: number) {}", "grammar"), ("javascript", "f(1, {\n", "premature_end"), ("javascript", "a = 'x", "unterminated"), ("javascript", "<html></html>", "grammar"), ("javascript", "def f(x):\n  pass", "grammar"), ("javascript", "a = b / c / d; e = /[/]/g.test(f)", None), ("javascript", "a = 1\n<<<<<<< HEAD\n", "conflict"), ("javascript", "/* <<<<<<< HEAD */", None),
        ("typescript", "export interface X<T> { a?: number[]; (b: string): void }", None), ("typescript", "let a = 1; }", "unbalanced"), ("typescript", "let a: = 1;", "grammar"), ("typescript", "const v = { a: 1 } as const;", None),
    ],
)
def test_lexers(lang, text, kind):
    got = lexers.check(lang, text)
    assert (got and got[0]) == kind


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8), st.integers(0, 400))
def test_json_automaton_agrees_with_the_library(value, cut):
    import json

    text = json.dumps(value)[: max(0, cut)]
    try:
        json.loads(text, parse_constant=lambda _: 1 / 0)
        ok = True
    except (ValueError, ZeroDivisionError):
        ok = False
    assert (lexers.check("json", text) is None) == ok


def test_parse_rates(spark):
    df = spark.createDataFrame([(1, "r", "a.py", "x ="), (2, "r", "b.py", None), (3, "r", "c.txt", "("), (4, "r", "d.json", "{}"), (5, "s", "e.toml", "a ="), (6, "s", None, "x")], "file_id long, repo string, path string, text string").withColumn("language", F.lit("x"))
    f = parsing.parse_files(df, key="file_id", repo="repo", path="path", text="text")
    assert {r["file_id"]: r["parses"] for r in f.collect()} == {1: False, 2: True, 4: True, 5: False}
    assert {(r["repo"], r["language"]): (r["files"], r["failing"], r["rate"]) for r in parsing.parse_rates(f, repo="repo").collect()} == {("r", "python"): (2, 1, 0.5), ("r", "json"): (1, 0, 0.0), ("s", "toml"): (1, 1, 1.0)}


# ---- 7 ----
def test_provenance(spark):
    code = "\n".join(f"def f{i}(a):\n    return a + {i} * offset\n" for i in range(12))
    lib = "\n".join(f"export function g{i}(a) {{\n  return a * {i} + base;\n}}" for i in range(12))
    mini = "function a(b){return b*2}var c=1;" * 60
    files = [
        ("r", "pkg/a.py", code, 0), ("r", "pkg/b.py", "# Code generated by gen. DO NOT EDIT.\n" + code, 1), ("r", "pkg/c.py", "# Written by hand. There is no generator for this file.\n" + code + "x = 1", 0), ("r", "pkg/d_pb2.py", code, 1), ("r", "vendor/lib/x.js", lib, 1), ("s", "web/copied.js", "/* note */\n" + lib, 1),
        ("r", "static/app.js", mini, 1), ("r", "dist/app.js", lib.replace("g", "h"), 1), ("r", "pkg/dist/normal.py", code + "y = 2", 0), ("r", "pkg/vendors/p.py", code + "z = 3", 0), ("r", "pkg/data.py", "import base64\nD = base64.b64decode(\n" + ("    '" + "QUJDREVG" * 20 + "'\n") * 8 + ")\n", 1), ("r", "web1/package-lock.json", "{}", 1), ("r", "x/__pycache__/m.pyc", None, 1), ("r", "README.md", "# Title\n\nGenerated prose about code.\n", 0), ("r", None, None, 0), ("r", "tool.py", code + "def h(n):\n    return '# DO NOT EDIT: ' + n\n", 0), ("r", "e.py", "", 0),
    ]
    df = spark.createDataFrame([(i, r, p, None, False) for i, (r, p, _, _) in enumerate(files)], "file_id long, repo string, path string, generated_reason string, b boolean")
    t = spark.createDataFrame([(i, r, p, x) for i, (r, p, x, _) in enumerate(files) if x is not None], "file_id long, repo string, path string, text string")
    got = {r["file_id"]: r for r in provenance.label_files(df, t).collect()}
    assert len(got) == len(files)
    for i, (_, p, _, case) in enumerate(files):
        assert got[i]["handwritten"] == (not case), (p, got[i])
    assert got[4]["label"] == got[5]["label"] == "vendored" and got[6]["label"] == "minified" and got[1]["label"] == "generated" and got[10]["label"] == "blob"
    assert provenance.label_files(df.limit(0), t.limit(0)).count() == 0


CODE = "".join(f"x{i} = {i} * offset\n" for i in range(3000))


@pytest.mark.parametrize(
    "text",
    [
        "#!/usr/bin/env python\n# Generated by gen, do not edit.\n" + CODE, '#!/usr/bin/env python\n"""Generated by gen."""\n' + CODE, "# licence\n" * 500 + "# Code generated by gen. DO NOT EDIT.\n" + CODE,
        CODE + "# end of generated code\n" + "# note\n" * 20, CODE + "# end of generated code\n" + "\n" * 20, CODE + "_lr_action = {}\n", CODE + "DESCRIPTOR = _descriptor.FileDescriptor()\n",
    ],
)
def test_markers_are_found_in_whole_texts(text):
    assert provenance.text_evidence(text, "py")[1] >= 13 and provenance.text_evidence("#!/bin/sh\n" + CODE, "py")[1] == 0


def test_belief_propagation_is_exact(spark):
    """Marginals against enumeration on a small tree."""
    import numpy as np

    df = spark.createDataFrame([(1, "r", "a/x.py"), (2, "r", "a/b/y.js"), (3, "r", "a/b/z.min.js")], "file_id long, repo string, path string").withColumn("generated_reason", F.lit(None).cast("string"))
    t = spark.createDataFrame([], "file_id long, repo string, path string, text string")
    got = {r["file_id"]: r["p_handwritten"] for r in provenance.label_files(df, t).collect()}
    pri = np.array(provenance.PRIOR)
    u = {1: pri + [0.5, 0, 0, 0, 0], 2: pri, 3: pri + [0, 0, 13.0, 0, 0]}
    p = {1: 0.0, 2: 0.0, 3: 0.0}
    z = 0.0
    for root, a, b, x, y, m in itertools.product(range(5), repeat=6):
        w = math.exp(provenance.PSI[root][a] + provenance.PSI[a][b] + provenance.PSI[a][x] + provenance.PSI[b][y] + provenance.PSI[b][m] + u[1][x] + u[2][y] + u[3][m])
        z += w
        for k, lab in ((1, x), (2, y), (3, m)):
            p[k] += w * (lab == 0)
    for k in p:
        assert got[k] == pytest.approx(p[k] / z, abs=1e-5)


def test_both_sweeps_agree_at_any_depth(spark):
    """Depth by depth over the cluster and all at once; paths of 3 and of 70 directories, odd ones, null ones."""
    rnd = random.Random(6)
    paths = ["/".join(rnd.choice(["src", "dist", "vendor", "a", "b"]) for _ in range(rnd.randrange(0, 4))) + f"/f{i}." + rnd.choice(["js", "py", "min.js", "json"]) for i in range(60)]
    paths += ["/".join(["d"] * 70) + "/deep.py", "/".join(["d"] * 69) + "/vendor/x.js", "top.py", "", None, "a//b.js"]
    df = spark.createDataFrame([(i, rnd.choice(["r", "s", "big"]), p) for i, p in enumerate(paths[:60])] + [(60 + i, "r", p) for i, p in enumerate(paths[60:])], "file_id long, repo string, path string").withColumn("generated_reason", F.lit(None).cast("string"))
    t = spark.createDataFrame([], "file_id long, repo string, path string, text string")
    once = dict(rows(provenance.label_files(df, t), "file_id", "p_handwritten"))
    assert len(once) == len(paths) and once[61] < 0.1 < 0.7 < once[60]
    short = df.filter("coalesce(length(path), 0) < 60")
    assert dict(rows(provenance.label_files(short, t, task_dirs=9), "file_id", "p_handwritten")) == pytest.approx(dict(rows(provenance.label_files(short, t), "file_id", "p_handwritten")), abs=1e-5)


def test_siblings_decide_where_evidence_is_weak(spark):
    """An older finding and flagged chunks flag a file among generated ones, not elsewhere; no evidence flags nowhere."""
    marked = "// Code generated by gen. DO NOT EDIT.\n" + "".join(f"export const c{i} = {i}\n" for i in range(9))
    names = [("api", f"g{i}.js", marked, None) for i in range(5)] + [("api", "weak.js", None, "marked as generated"), ("api", "none.js", None, None), ("src", "weak.js", None, "marked as generated"), ("src", "a.js", None, None), ("src", "b.js", None, None)]
    df = spark.createDataFrame([(i, "r", f"{d}/{n}", why) for i, (d, n, _, why) in enumerate(names)], "file_id long, repo string, path string, generated_reason string")
    t = spark.createDataFrame([(i, "r", f"{d}/{n}", x) for i, (d, n, x, _) in enumerate(names) if x], "file_id long, repo string, path string, text string")
    c = spark.createDataFrame([("r", f"{d}/weak.js", True) for d in ("api", "src")], "repo string, path string, is_generated boolean")
    got = dict(rows(provenance.label_files(df, t, c), "file_id", "handwritten"))
    assert got == {i: not (n.startswith("g") or (d, n) == ("api", "weak.js")) for i, (d, n, _, _) in enumerate(names)}


def test_the_home_of_a_copied_file_stays(spark):
    lib = "\n".join(f"export function g{i}(a) {{\n  return a * {i} + base;\n}}" for i in range(12))
    own = "\n".join(f"def f{i}(a):\n    return a + {i} * offset\n" for i in range(12))
    files = [("up/lib", "src/core.js", lib), ("r1", "vendor/lib/core.js", lib), ("r2", "node_modules/lib/core.js", lib), ("r3", "src/helper.js", lib), ("r4", "a.py", own), ("r4", "b.py", own.replace("f", "h"))]
    df = spark.createDataFrame([(i, r, p) for i, (r, p, _) in enumerate(files)], "file_id long, repo string, path string").withColumn("generated_reason", F.lit(None).cast("string"))
    t = spark.createDataFrame([(i, r, p, x) for i, (r, p, x) in enumerate(files)], "file_id long, repo string, path string, text string")
    assert dict(rows(provenance.label_files(df, t), "file_id", "handwritten")) == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True}


# ---- 8 ----
@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_packing_histogram(counts):
    segs, total = packing.pack_histogram(counts, 64)
    load, placed = collections.Counter(), collections.Counter()
    for length, rank, first, n in segs:
        assert placed[length] == rank
        placed[length] += n
        for c in range(first, first + n):
            load[c] += length
    assert placed == collections.Counter(counts) and set(load) == set(range(total)) and all(v <= 64 for v in load.values())
    assert total <= 2 * math.ceil(sum(k * v for k, v in counts.items()) / 64) + 1


def test_containers(spark):
    rnd = random.Random(4)
    sizes = [(i, rnd.choice([1, 7, 30, 100, 101, 250, 0])) for i in range(500)] + [(900, None), (901, 1000), (1, 7)]
    df = spark.createDataFrame(sizes, "d long, n int")
    got = packing.fill_containers(df, key="d", size="n", capacity=100).collect()
    load = collections.Counter()
    for r in got:
        load[r["container"]] += r["size"]
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    total = collections.Counter()
    for r in got:
        total[r["d"]] += r["size"]
    want = collections.Counter()
    for d, n in sizes:
        want[d] += n or 0
    assert total == +want
    for d, n in sizes:
        if n and n <= 100 and d != 1:
            assert sum(r["d"] == d for r in got) == 1
    again = packing.fill_containers(df.repartition(5), key="d", size="n", capacity=100).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    u = packing.usage(packing.fill_containers(df, key="d", size="n", capacity=100), capacity=100).first()
    assert u["tokens"] == sum(load.values()) and u["containers"] == len(load)
    assert packing.fill_containers(df.limit(0), key="d", size="n").count() == 0


def test_tokens(spark):
    pytest.importorskip("tiktoken")
    long = "word café 12 " * 30_000 + "x" * 50
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, long)], "d long, t string")
    got = dict(rows(tokens.count_tokens(df, key="d", text="t"), "d", "n_tokens"))
    enc = tokens._encoder(open(tokens.VOCABULARY, "rb").read())
    assert got == {1: 0, 2: 0, 3: 2, 4: len(enc.encode_ordinary(long))}
    rnd = random.Random(3)
    for text in ("a" * 15_000, "".join(rnd.choice("abcé .\n\t!漢🙂'st") for _ in range(18_000)), " \n" * 8_000 + "x", "don't  x\n\n y " * 1_200):
        assert sum(len(enc._core_bpe.encode_single_piece(m.group().encode())) for m in tokens._SPLIT.finditer(text)) == len(enc.encode_ordinary(text))
    assert tokens.n_tokens(enc, "a" * 200_000) == 10 * tokens.n_tokens(enc, "a" * 20_000)


# ---- 9 ----
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=8), st.integers(20, 400))
def test_schedule_deviates_less_than_a_block(parts, slots):
    w = {f"s{i}": p / sum(parts) for i, p in enumerate(parts)}
    done = collections.Counter()
    at = {t: s for s, _, t in mixing.pfair_schedule(w, slots)}
    for t in range(slots):
        if t in at:
            done[at[t]] += 1
        for s, x in w.items():
            assert abs(done[s] - x * (t + 1)) < 1 + 1e-6


def test_mixture(spark):
    rnd = random.Random(9)
    docs = [(i, s, rnd.randrange(1, 60)) for i, s in enumerate(rnd.choices(["a", "B ", "c", "other", None], [70, 20, 5, 4, 1], k=3000))] + [(9001, "a", 0), (9002, "a", None)]
    df = spark.createDataFrame(docs, "d long, source string, n int").withColumn("slot", F.lit(1))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    m, rep = mixing.mix_sources(df, t, key="d", source="source", size="n")
    got = m.collect()
    shares = {r["source"]: r for r in rep.collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"]["tokens"] == 0
    for s, w in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert shares[s]["share"] == pytest.approx(w, abs=0.004)
    times = collections.Counter((r["source"], r["d"]) for r in got)
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(n <= cap[s] for (s, _), n in times.items()) and len({(r["d"], r["repeat"]) for r in got}) == len(got)
    again = mixing.mix_sources(df.repartition(7), t, key="d", source="source", size="n")[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    m2, rep2 = mixing.mix_sources(df.limit(0), t, key="d", source="source", size="n")
    assert m2.count() == 0 and all(r["tokens"] == 0 for r in rep2.collect())


def test_sources_of_tiny_shares_are_kept(spark):
    df = spark.createDataFrame([(i, "a", 50) for i in range(60_000)] + [(70_000 + i, "b", 7) for i in range(20)] + [(80_000 + i, "c", 100) for i in range(3)], "d long, source string, n int")
    t = spark.createDataFrame([("a", 0.99997, 1), ("b", 0.00001, 1), ("c", 0.00002, 1)], "source string, target_share double, max_repeats int")
    m, rep = mixing.mix_sources(df, t, key="d", source="source", size="n")
    got = {r["source"]: r["tokens"] for r in rep.collect()}
    assert got["b"] == 28 and got["c"] == 100 and got["a"] == pytest.approx(3_000_000, abs=50)
    assert m.filter("slot is null").count() == 0
    blocks = {s for s, _, _ in mixing.pfair_schedule({"a": 0.99997, "b": 0.00001, "c": 0.00002}, 8192)}
    assert blocks == {"a", "b", "c"}


# ---- 10 ----
def make_docs(n, seed):
    rnd = random.Random(seed)
    words = {"law": ["verdict", "statute", "tribunal", "notary", "appeal"], "music": ["violin", "chord", "octave", "choir", "tempo"], "sport": ["goalkeeper", "referee", "medal", "javelin", "sprint"]}
    out = []
    for i in range(n):
        k = rnd.choice([0, 1, 1, 1, 2])
        ss = rnd.sample(sorted(words), k)
        body = [f"The {rnd.choice(words[s])} view now reads {rnd.choice(words[s])} before it lists x{rnd.randrange(99)}." for s in ss for _ in range(rnd.randrange(2, 6))]
        body += ["Bump the version and fix a wrong path." for _ in range(rnd.randrange(3))]
        if ss and rnd.random() < 0.3:
            other = rnd.choice([s for s in words if s not in ss])
            body.append(f"Same trick as in the {rnd.choice(words[other])} demo.")
        rnd.shuffle(body)
        out.append((i, " ".join(body) or "Typo in the heading.", "docs", ss))
    return out


def test_subjects_on_held_out_documents(spark):
    docs = make_docs(900, 1)
    df = spark.createDataFrame([d[:3] for d in docs] + [(9000, None, "docs"), (9001, " \n", None), (9002, docs[3][1], None)], "doc_id long, text string, source string").withColumn("subject", F.lit("clash"))
    lab = spark.createDataFrame([(i, s, 1) for i, _, _, ss in docs[:300] for s in ss] + [(5, "unknown subject", 1), (77777, "law", 1), (None, "law", 1)], "doc_id long, subject string, x int")
    model = subjects.train(df, lab, ["law", "music", "sport"], doc="doc_id", text="text", source="source", subject="subject")
    got = collections.defaultdict(set)
    for d, s in rows(subjects.assign(df, model, doc="doc_id", text="text", source="source"), "doc_id", "subject"):
        got[d].add(s)
    right = sum(got[i] == set(ss) for i, _, _, ss in docs[300:])
    assert right / 600 > 0.93 and not got[9000] and not got[9001] and got[9002] == got[3]
    comp = dict(rows(subjects.composition(subjects.assign(df, model, doc="doc_id", text="text", source="source"), df, doc="doc_id"), "subject", "share"))
    assert sum(comp.values()) == pytest.approx(1, abs=1e-4)


def test_rare_words_of_small_subjects_are_learnt(spark):
    """8,500 words of one subject, all of them more frequent, keep no word of the other from the lexicon."""
    filler = " ".join("q" + "".join("abcdefghij"[int(c)] for c in f"{i:04d}") for i in range(8500))
    docs = ["The verdict statute tribunal."] * 6 + ["A violin chord octave."] * 6 + [f"The verdict statute tribunal {filler}."] * 24 + ["A violin chord octave zither."] * 8 + ["A violin chord octave."] * 6
    df = spark.createDataFrame([(i, t, "docs") for i, t in enumerate(docs)], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, "law" if i < 6 else "music") for i in range(12)], "doc_id long, subject string")
    model = subjects.train(df, lab, ["law", "music"], doc="doc_id", text="text", source="source", subject="subject")
    assert model.mention.get(subjects.number("zither")) == 1


def test_each_subject_has_a_link_of_its_own():
    """Two subjects of the same features and other base rates; a third has no rows."""
    import numpy as np

    rnd = np.random.default_rng(3)
    of = np.repeat([0, 1], 600)
    x = np.c_[np.ones(1200), rnd.random(1200)]
    y = (rnd.random(1200) < np.where(of == 0, 0.9, 0.1)).astype(float)
    links, platt = subjects._fit_links(x, y, of, np.arange(1200) % 3, 3)
    p = [np.mean(1 / (1 + np.exp(-(x @ links[s] * platt[s, 0] + platt[s, 1])))) for s in range(3)]
    assert p == pytest.approx([0.9, 0.1, 0.5], abs=0.05)


def test_beam_finds_the_best_combination():
    """Against all combinations of at most two of four subjects; a subject without a mention can be chosen, too."""
    import numpy as np

    rnd = np.random.default_rng(5)
    n_s, k = 4, len(subjects.FEATURES)
    m = subjects.Model(list("abcd"), order=[2, 0, 3, 1], links=rnd.normal(size=(n_s, k + len(subjects.CHAIN))), platt=np.c_[rnd.uniform(0.5, 2, n_s), rnd.normal(size=n_s)], cooc=rnd.normal(size=(n_s, n_s)), beam=16)
    x = rnd.normal(size=(40, n_s, k))
    x[:, :, subjects.FEATURES.index("mentions")] = 0.0
    got = m.decode(x)
    for d in range(len(x)):
        best = None
        for want in [c for r in range(3) for c in itertools.combinations(range(n_s), r)]:
            held, lp = [], 0.0
            for s in m.order:
                row = np.r_[x[d, s], len(held) == 1, len(held) > 1, sum(m.cooc[s, t] for t in held)]
                p = 1 / (1 + math.exp(-(float(m.links[s] @ row) * m.platt[s, 0] + m.platt[s, 1])))
                lp += math.log(p if s in want else 1 - p)
                held += [s] * (s in want)
            best = max(best or (-1e9, ()), (lp, want))
        assert set(np.flatnonzero(got[d])) == set(best[1])


def test_terms_are_numbered_alike_on_both_sides(spark):
    texts = ["Some_nameParts and theClasses, glass; CSS's bosses", "Die Gerichte prüfen Übungsläufe ÉtatsUnis niño's", "", "x y zz 12ab34cd Straßen\r\nlines", "a" * 5000 + " words words wordS"]
    got = spark.createDataFrame(list(enumerate(texts)), "d int, t string").select("d", subjects.term_numbers(F.col("t")).alias("b")).collect()
    for d, b in got:
        assert set(b) == {subjects.number(w) for w in subjects.words(texts[d])} and len(set(b)) == len(b)


def test_subjects_without_labels(spark):
    df = spark.createDataFrame([(1, "a verdict", "docs")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    model = subjects.train(df, lab, ["law"], doc="doc_id", text="text", source="source", subject="subject")
    assert subjects.assign(df, model, doc="doc_id", text="text", source="source").count() == 0


def test_anchors_of_long_texts_do_not_depend_on_the_parts(monkeypatch):
    rnd = random.Random(1)
    t = "".join(rnd.choice("abcde\n ") for _ in range(5000))

    def anchors():
        out = set()
        for ids, offsets, texts in spans._blocks([0, 1, 2], [t, t[:200], t[100:900]], 199):
            doc, pos, h = spans._winnow_block(texts, 100, 101)
            out |= {(ids[d], int(p) + offsets[d], int(x)) for d, p, x in zip(doc, pos, h)}
        return out

    whole = anchors()
    monkeypatch.setattr(spans, "LONG", 300)
    assert anchors() == whole and len(whole) > 80


VALID_JS = [
    "const a = {b: 1, 'c': 2, [d]: 3, get e() { return 1 }, async f() {}, g, ...h};\nexport default a;",
    "class A extends B { static x = 1; #p = 2; constructor() { super(); this.#p = /ab[/]c/g.test('x') } get y() { return this.x } static { f() } async *gen() { yield* x } }",
    "for (const [k, v] of Object.entries(o)) if (k in v) continue; else break\nlabel: while (true) { break label }",
    "import d, { a as b } from './x';\nimport * as ns from \"y\";\nexport { a as default } from 'z';\nexport * from 'q'\nimport j from './d.json' with { type: 'json' }",
    "let f = async (x) => { await x }, g = x => x * 2, h = (a, b = 3, {c, d}, ...r) => ({ a, b });\nvar s = `a ${b ? `n ${c}` : 'd'} e`;",
    "switch (x) { case 1: case 'a': f(); break; default: g() }\nconst t = a ? b : c ? d : e\nx = y\n++z\nif (a) { b } else if (c) d()\nelse e()",
    "a = b / c / d; e = f(1) / 2; g = h[0] / 3; var r = /x/.exec(s); r = x ?? y; o?.p?.[q]?.(r); 1..toString(); x = 1_000n",
    "try { a() } catch { b() } finally { c() }\nnew Foo\nnew Foo(1).bar\ntypeof x === 'y' && delete o.p, void 0\nthrow new Error('x')",
    "do { x++ } while (x < 5)\nvar x = function () {}, y = function* n() {}\n;(function () { 'use strict' })()\n!function(){}()",
    "const re = a.replace(/[\"'`]/g, '').split(/\\s+/)\nif (/x/.test(a)) b()\nconst o = { if: 1, class: 2, default: 3, 'x-y': 4, 5: 6, async: 7, get: 8 }\no.class.if.default()",
    "let x\nlet y = x ? { a: 1 } : [1, , 2]\nexport const z = () => {}\nexport function q() {}\nexport default class extends A {}\nexport async function w() {}",
    "const {a, b: {c}, ...rest} = o; [x, y] = [y, x]; ({a, b} = o)\nvar a = {}\nvar b = []\n{ let z = 1 }\n;[1].map(x => x)",
    "a = b ? (c, d) : e; x = a ? b : (c) => d; async () => { for await (const x of y) { } }; y = async function() {}; z = async x => x",
    "a\n.b()\n.c()", "var s = 'a\\\nb'; x = a\n? b\n: c", "if (a) b; else { }\nwhile(0);", "var a = b\n  , c = d\n;",
    "o = { async *a() {}, async b() {}, *c() {}, get [d]() {}, set e(v) {}, 'f'() {}, 1() {} }", "class A { 'x' = 1; y; static async z() {} ; get; set; a = () => {} \n b = 2\n c() {} }",
]
VALID_TS = [
    "interface A<T extends B = C> { x: string; y?: number[]; (a: string): void; readonly z: { a: 1 }; [k: string]: any; m<T>(a: T): Promise<T> }\ntype U = 'a' | 'b' | { c: number }\nenum E { A = 1, B }",
    "export class A<T> extends B<T> implements C, D { private x: string = ''; constructor(private readonly y: number, public z?: string) { super() } async m(): Promise<void> {} static n?: string; abstract o(): void; declare p: string }",
    "function f<T>(a: T, b?: string, ...c: number[]): a is string { return a as unknown as string }\nconst x = <T,>(a: T) => a; let y = z!; let w: typeof z = y!.a; let q = a satisfies B",
    "declare module 'x' { export function f(): void }\nnamespace N.M { export const a = 1 }\nimport type { A } from './a'; export type { B } from './b'\nabstract class Q { abstract x(): string }",
    "let f: (a: string) => void = (a) => {}; type M = { [K in keyof T]?: T[K] }; type C = A extends infer U ? U : never; let t: [a: string, b?: number]; function assert(x: any): asserts x {}",
]


@pytest.mark.parametrize(("text", "typed"), [(x, False) for x in VALID_JS] + [(x, True) for x in VALID_TS])
def test_valid_scripts_pass(text, typed):
    assert lexers.script_file(text, typed) is None


def test_crowded_baskets(spark):
    """Baskets of many rows: one of two items repeated often counts, one of many items doesn't."""
    data = [("s", "rep", f"i{i % 2}") for i in range(1000)] + [("s", "sweep", f"x{i}") for i in range(1000)] + [("s", f"b{k}", i) for k in range(4) for i in ("i0", "i1")] + [("s", f"o{k}", "z") for k in range(20)]
    got = cooccurrence.together(spark.createDataFrame(data, "s string, b string, i string"), scope="s", basket="b", item="i").collect()
    assert [(r["item_a"], r["item_b"], r["n"], r["n_a"], r["n_b"], r["together"]) for r in got] == [("i0", "i1", 25, 5, 5, 5)]
