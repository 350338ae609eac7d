"""Queries of text, duplicate, retrieval, findings, import, graph, job, streaming and source operators."""

from __future__ import annotations

import os
import subprocess
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.operators import chunking, duplicates, evaluate, findings, graph, imports, jobs, overview, search
from codequarry.operators import history as H
from codequarry.operators.prefix import global_rank
from codequarry.plans import project as J
from codequarry.plans.registry import Registry, values_sql
from codequarry.plans.rows import _AREA, _CODE, _ENTRY, _LOW, _N, _SIG, _TEST, _q
from codequarry.session import cut, table
from codequarry.sources import files as X
from codequarry.sources import git as G
from codequarry.sources import pyast as A
from codequarry.streaming import throttle

R = Registry()
_KEYED = "replace(text, chr(13), '')"

# ---- duplicates ----
_LP = f"WITH s AS (SELECT file_id AS k, {_SIG} AS ls FROM file_text), f AS (SELECT k, len(ls) AS n, unnest(ls) AS l FROM s WHERE len(ls) >= 10), u AS (SELECT l FROM f GROUP BY l HAVING count(*) BETWEEN 2 AND 20), h AS (SELECT f.* FROM f JOIN u USING (l)), p AS (SELECT x.k AS a, y.k AS b, count(*) AS shared, min(least(x.n, y.n)) AS m FROM h x JOIN h y ON x.l = y.l AND x.k < y.k GROUP BY ALL)"


def _line_pairs(spark, base, **kw):  # noqa: ANN001, ANN003, ANN202
    return duplicates.line_pairs(table(spark, base, "file_text"), key="file_id", text="text", **kw)


R.add("find_near_duplicates", lambda s, b: _line_pairs(s, b).select("a", "b", "shared", F.round("containment", 6).alias("containment")), _LP + " SELECT a, b, shared, round(shared / m::double, 6) AS containment FROM p WHERE shared >= 10 AND shared / m::double >= 0.8")
R.add("join_line_inverted_self", lambda s, b: _line_pairs(s, b, min_shared=1, min_containment=0.0).select("a", "b", "shared"), _LP + " SELECT a, b, shared FROM p")
R.add("agg_shared_lines", lambda s, b: _line_pairs(s, b, min_shared=5, min_containment=0.0).select("a", "b", "shared", F.round("containment", 6).alias("containment")), _LP + " SELECT a, b, shared, round(shared / m::double, 6) AS containment FROM p WHERE shared >= 5")
_CC = _LP.replace("WITH s", "WITH RECURSIVE s") + ", e AS (SELECT a, b, shared FROM p WHERE shared >= 10 AND shared / m::double >= 0.8), e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM e2 UNION SELECT e2.b, r.m FROM r JOIN e2 ON e2.a = r.n), c AS (SELECT n, min(m) AS c FROM r GROUP BY n)"
R.add("graph_dup_components", lambda s, b: graph.components(_line_pairs(s, b), "a", "b"), _CC + " SELECT n AS node, c AS component FROM c")
_DG = _CC + " SELECT c AS component, count(*) AS size, (SELECT max(shared) FROM e JOIN c c2 ON c2.n = e.a WHERE c2.c = c.c) AS shared FROM c GROUP BY c"
R.add("agg_dup_groups", lambda s, b: duplicates.duplicate_groups(_line_pairs(s, b)).select("component", "size", "shared"), _DG)
R.add("sort_dup_groups", lambda s, b: global_rank(duplicates.duplicate_groups(_line_pairs(s, b)).select("component", "size"), [F.desc("size"), "component"], "position"), f"SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS position FROM ({_DG})")


@R.query(f"WITH s AS (SELECT repo, file_id, unnest({_SIG}) AS l FROM file_text), u AS (SELECT repo, l FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20), h AS (SELECT s.* FROM s JOIN u USING (repo, l)) SELECT x.file_id AS a, y.file_id AS b, count(*) AS common FROM h x JOIN h y ON x.repo = y.repo AND x.l = y.l AND x.file_id < y.file_id GROUP BY ALL")
def intersect_lines(spark, base):  # noqa: ANN001, ANN201
    p = duplicates.line_pairs(table(spark, base, "file_text"), key="file_id", text="text", min_lines=1, min_shared=1, min_containment=0.0, scope="repo")
    return p.select("a", "b", F.col("shared").alias("common"))


@R.query(J.sql([("zapp/again.py", "arrange", 4, 11, 7, 2, 2), ("zapp/util.py", "prepare", 4, 11, 7, 2, 2)], "path, name, start_line, end_line, body_lines, copies, files"))
def join_function_bodies(spark, base):  # noqa: ANN001, ANN201
    b = duplicates.repeated_bodies(J.texts(spark, base), A.symbols_of(cut(J.parsed(spark, base))))
    return b.select("repo", "path", "name", "start_line", "end_line", "body_lines", "copies", "files")


# ---- chunks and retrieval ----
_WIN = f"WITH l AS (SELECT file_id, string_split_regex({_KEYED}, '[\\n\\x0b\\x0c]') AS s FROM file_text), t AS (SELECT file_id, CASE WHEN len(s) > 1 AND s[-1] = '' THEN list_slice(s, 1, len(s) - 1) ELSE s END AS ls FROM l), w AS (SELECT file_id, ls, unnest(range(1, len(ls) + 1, 50)) AS a FROM t), c AS (SELECT file_id, a AS start_line, least(len(ls), a + 49) AS end_line, array_to_string(list_slice(ls, a, least(len(ls), a + 49)), chr(10)) AS body FROM w)"


@R.query(_WIN + " SELECT file_id, start_line, end_line, length(body) AS chars FROM c WHERE regexp_matches(body, '\\S')")
def chunk_windows(spark, base):  # noqa: ANN001, ANN201
    t = table(spark, base, "file_text").withColumn("text", F.replace("text", F.lit("\r"), F.lit("")))
    return chunking.windows(t, key="file_id", size=50).select("file_id", "start_line", "end_line", F.length("body").alias("chars"))


QUESTION = "Where is rotate_filter or the bucket queue of README handled?"
_TERMS = "('where', 'rotate_filter', 'the', 'bucket', 'queue', 'readme', 'handled')"
_TOK = lambda c: f"list_concat(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), flatten(list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), lambda w: contains(w, '_')), lambda w: list_filter(string_split_regex(w, '_+'), lambda p: p <> ''))))"
_POST = "WITH q AS (SELECT chunk_id, unnest(" + _TOK("symbol") + ") AS term, 1.0::double AS w FROM chunks UNION ALL SELECT chunk_id, unnest(" + _TOK("replace(path, '/', ' ')") + "), 0.4::double FROM chunks UNION ALL SELECT chunk_id, unnest(" + _TOK("body") + "), 0.2::double FROM chunks), p AS (SELECT chunk_id, term, sum(w) AS weight FROM q GROUP BY ALL)"


def _index(spark, base):  # noqa: ANN001, ANN202
    return search.postings(table(spark, base, "chunks"), key="chunk_id")


R.add("fts_index", lambda s, b: _index(s, b).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 6).alias("weight")), _POST + " SELECT chunk_id, count(*) AS terms, round(sum(weight), 6) AS weight FROM p GROUP BY 1")
_NAMED = f"coalesce(lower(symbol) IN {_TERMS} OR string_split(lower(symbol), '.')[-1] IN {_TERMS}, false)"
_CAND = _POST + f", h AS (SELECT chunk_id, sum(weight) AS text_score FROM p WHERE term IN {_TERMS} GROUP BY 1), cand AS (SELECT c.*, text_score, {_NAMED} AS named FROM h JOIN chunks c USING (chunk_id) ORDER BY named DESC, round(text_score, 6) DESC, chunk_id LIMIT 60)"


def _candidates(spark, base):  # noqa: ANN001, ANN202
    return search.candidates(_index(spark, base), table(spark, base, "chunks"), QUESTION, key="chunk_id")


R.add("fts_candidates", lambda s, b: _candidates(s, b).select("chunk_id", "named", F.round("text_score", 6).alias("text_score")), _CAND + " SELECT chunk_id, named, round(text_score, 6) AS text_score FROM cand")
R.add("topk_chunk_candidates", lambda s, b: _candidates(s, b).select("chunk_id"), _CAND + " SELECT chunk_id FROM cand")
_SW = "list_filter(string_split_regex(lower(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: length(w) >= 3)"
_ST = lambda w: f"CASE WHEN suffix({w}, 'ss') THEN {w} WHEN suffix({w}, 'ing') AND length({w}) > 5 THEN left({w}, length({w}) - 3) WHEN suffix({w}, 'ed') AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN suffix({w}, 'es') AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN suffix({w}, 's') AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"
_WORD = f"coalesce(len(list_filter(list_transform({_SW}, lambda w: {_ST('w')}), lambda w: w IN ('where', 'rotate_filter', 'the', 'bucket', 'queue', 'readme', 'handl'))) > 0, false)"
_PM = f"(string_split(lower(path), '/')[-1] IN {_TERMS} OR string_split(string_split(lower(path), '/')[-1], '.')[1] IN {_TERMS})"
_RK = _CAND + f", sc AS (SELECT *, floor((CASE WHEN (SELECT max(text_score) FROM cand) > 0 THEN text_score / (SELECT max(text_score) FROM cand) ELSE 0 END + CASE WHEN named THEN 0.5::double WHEN {_WORD} THEN 0.35::double ELSE 0.0::double END + CASE WHEN {_PM} THEN 0.3::double ELSE 0.0::double END + 0.2::double * coalesce(file_score, 0.0::double) - CASE WHEN coalesce(is_test, false) OR coalesce(is_generated, false) THEN 0.3::double ELSE 0.0::double END) * 1000 + 0.5) / 1000.0::double AS score, path || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0) AS location FROM cand), wn AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, location, chunk_id) AS n FROM sc)"


def _ranked(spark, base, limit=8, per_file=3):  # noqa: ANN001, ANN202
    c = _candidates(spark, base).withColumn("start_line", F.coalesce("start_line", F.lit(0))).withColumn("end_line", F.coalesce("end_line", F.lit(0)))
    return search.rank(c, QUESTION, penal=F.coalesce("is_test", F.lit(False)) | F.coalesce("is_generated", F.lit(False)), limit=limit, per_file=per_file)


R.add("fts_rank", lambda s, b: _ranked(s, b, 60, 60).select("chunk_id", "score"), _RK + " SELECT chunk_id, score FROM sc")
R.add("fts_diversify", lambda s, b: _ranked(s, b).select("location", "score"), _RK + " SELECT location, score FROM wn WHERE named OR n <= 3 ORDER BY score DESC, location LIMIT 8")
R.add("win_per_file_cap", lambda s, b: _ranked(s, b, 60, 1).select("location", "score"), _RK + " SELECT location, score FROM wn WHERE named OR n <= 1 ORDER BY score DESC, location LIMIT 60")
R.add("topk_chunk_results", lambda s, b: _ranked(s, b).select("location"), _RK + " SELECT location FROM wn WHERE named OR n <= 3 ORDER BY score DESC, location LIMIT 8")
R.add("filter_nonblank_question", lambda s, b: s.createDataFrame([("", 5), ("  ", 0), ("where", 99)], "q string, n int").filter(F.trim("q") != "").select("q", F.least(F.greatest("n", F.lit(1)), F.lit(20)).alias("n")), "SELECT 'where' AS q, 20 AS n")
R.add("agg_chunk_count", lambda s, b: table(s, b, "chunks").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")), "SELECT analysis_id, count(*) AS n FROM chunks GROUP BY 1")
R.add("scan_chunk_table", lambda s, b: table(s, b, "chunks").filter("analysis_id is not null AND kind = 'class'").select("chunk_id", "analysis_id", "symbol"), "SELECT chunk_id, analysis_id, symbol FROM chunks WHERE analysis_id IS NOT NULL AND kind = 'class'")

# citations: answers cite the document's own lines, given are windows of five lines
_GIVEN = "g AS (SELECT doc_id, a AS s, least(n, a + 4) AS e FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n, unnest(range(1, len(string_split(text, chr(10))) + 1, 10)) AS a FROM documents WHERE text IS NOT NULL))"
_ANS = "c AS (SELECT doc_id, 1 AS a, 5 AS b FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 2, NULL FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 8, 9 FROM documents WHERE text IS NOT NULL)"


def _citations(spark, base):  # noqa: ANN001, ANN202
    d = table(spark, base, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), F.size(F.split("text", "\n")).alias("n"))
    given = d.select("doc_id", "path", "n", F.explode(F.sequence(F.lit(1), "n", F.lit(10))).alias("start_line")).withColumn("end_line", F.least("n", F.col("start_line") + 4))
    answers = d.select("doc_id", F.concat(F.lit("see "), "path", F.lit(":1-5, "), "path", F.lit(":2 and "), "path", F.lit(":8-9, again "), "path", F.lit(":2")).alias("answer"))
    return search.verify_citations(answers, given, key="doc_id", answer="answer")


_CST = f"WITH {_GIVEN}, {_ANS}, j AS (SELECT c.doc_id, c.a, c.b, bool_or(s = a AND (b IS NULL OR e = b)) AS exact, bool_or(a BETWEEN s AND e) AS ia, bool_or(b BETWEEN s AND e) AS ib FROM c LEFT JOIN g ON g.doc_id = c.doc_id GROUP BY ALL), st AS (SELECT doc_id, a AS start_line, b AS end_line, CASE WHEN exact THEN 'exact' WHEN ia AND (b IS NULL OR ib) THEN 'inside' ELSE 'unsupported' END AS status FROM j)"
R.add("join_citation_range", lambda s, b: _citations(s, b).select("doc_id", F.col("start").alias("start_line"), F.coalesce("end", F.lit(0)).alias("end_line"), "status"), _CST + " SELECT doc_id, start_line, coalesce(end_line, 0) AS end_line, status FROM st")
R.add("qa_citations", lambda s, b: _citations(s, b).groupBy("status").agg(F.count(F.lit(1)).alias("n")), _CST + " SELECT status, count(*) AS n FROM st GROUP BY 1")
R.add("agg_unsupported", lambda s, b: _citations(s, b).agg(F.count_if(F.col("status") == "unsupported").alias("unsupported")), _CST + " SELECT count_if(status = 'unsupported')::bigint AS unsupported FROM st")


@R.query()
def agg_retrieval_recall(spark, base):  # noqa: ANN001, ANN201
    """Of every chunk with a symbol, asked where its symbol is defined, whether the search of its analysis finds it among
    the first 8, and as the first."""
    c = table(spark, base, "chunks").withColumn("analysis_id", F.coalesce(F.col("analysis_id").cast("string"), F.lit(""))).withColumn("start_line", F.coalesce("start_line", F.lit(0))).withColumn("end_line", F.coalesce("end_line", F.lit(0)))
    name = F.regexp_replace("symbol", r"^[^.]*\.", "")
    asked = c.filter("symbol is not null AND symbol <> ''").select("analysis_id", "chunk_id", F.concat(F.lit("where is "), name, F.lit(" defined")).alias("question"))
    penal = F.coalesce("is_test", F.lit(False)) | F.coalesce("is_generated", F.lit(False))
    ranked = search.rank_many(_index(spark, base), c, asked, key="chunk_id", scope="analysis_id", question="question", shared=("where", "defined"), penal=penal)
    got = asked.join(ranked.select("analysis_id", "question", "chunk_id", "position"), ["analysis_id", "question", "chunk_id"], "left")
    return got.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("position").isNotNull()).alias("within_8"), F.count_if(F.col("position") == 1).alias("first"))


# ---- Python sources: symbols, imports, chunks, findings; all files, and a known project in every repository ----
def _edges(spark, base, parsed=None):  # noqa: ANN001, ANN202
    p = cut(J.parsed(spark, base)) if parsed is None else parsed
    return cut(imports.import_edges(imports.resolve_imports(A.imports_of(p), p.select("repo", "path"))))


def _absolute(parsed):  # noqa: ANN001, ANN202
    r = imports.resolve_imports(A.imports_of(parsed).filter("level = 0"), parsed.select("repo", "path"))
    return r.filter("target_path is not null").select("repo", "path", "line", "module", "target_path", "method")


def _unreferenced(spark, base, parsed):  # noqa: ANN001, ANN202
    return findings.unreferenced(J.files(spark, base), J.texts(spark, base), _edges(spark, base, parsed), parsed.select("repo", "path"))


_ABSOLUTE = [
    ("zapp/again.py", 1, "zapp.util", "zapp/util.py"), ("zapp/core/engine.py", 2, "zapp.store.disk", "zapp/store/disk.py"), ("zapp/core/engine.py", 3, "zapp.models", "zapp/models.py"), ("zapp/core/engine.py", 3, "zapp.again", "zapp/again.py"),
    ("zapp/store/disk.py", 3, "zapp.core.engine", "zapp/core/engine.py"), ("zapp/store/disk.py", 4, "zapp.core.engine", "zapp/core/engine.py"), ("zapp/store/models.py", 1, "zapp.store.disk", "zapp/store/disk.py"), ("zlib9/big.py", 1, "zlib9.loose", "zlib9/loose.py"),
    ("run_z.py", 1, "zapp.core.engine", "zapp/core/engine.py"), ("run_z.py", 1, "zapp.store.models", "zapp/store/models.py"), ("tests/test_zmodels.py", 1, "zapp.models", "zapp/models.py"), ("tests/test_zmodels.py", 2, "zextra.helper", "zextra/helper.py"),
]
_root = lambda rows: [(*r, "root") for r in rows]
R.add("scan_ast", lambda s, b: J.parsed(s, b).select("repo", "path", "first_error_line", F.size("imports").alias("imports"), F.size("symbols").alias("symbols")))
R.add("res_absolute", lambda s, b: _absolute(cut(J.parsed(s, b))), J.sql(_root(_ABSOLUTE), "path, line, module, target_path, method", _root([(J.ODD, 1, "zapp.util", "zapp/util.py"), (J.ODD, 1, "zapp", "zapp/__init__.py")])))
R.add("graph_build", lambda s, b: _edges(s, b), J.sql([e for e in J.EDGES if e[0] != J.ODD], "src, dst, first_line", [e for e in J.EDGES if e[0] == J.ODD]))
R.add("chunk_symbols", lambda s, b: chunking.symbol_chunks(J.texts(s, b).filter(F.col("path").endswith(".py")), A.symbols_of(J.parsed(s, b))).select("repo", "path", "start_line", "end_line", "kind", "symbol"))


@R.query()
def chunk_all(spark, base):  # noqa: ANN001, ANN201
    t = J.texts(spark, base)
    py = chunking.symbol_chunks(t.filter(F.col("path").endswith(".py")), A.symbols_of(J.parsed(spark, base))).select("repo", "path", "start_line", "end_line", "kind")
    other = t.filter(~F.col("path").endswith(".py") & P.language(F.col("path")).isNotNull())
    return py.unionByName(chunking.windows(other, key=["repo", "path"]).select("repo", "path", "start_line", "end_line", F.lit("text").alias("kind")))


R.add("cap_chunks", lambda s, b: chunking.cap(chunk_all(s, b).withColumn("file", F.concat_ws(" ", "repo", "path")), order="file").drop("file"))
R.add("find_repeated_functions", lambda s, b: findings.repeated_functions(J.texts(s, b), A.symbols_of(cut(J.parsed(s, b))), J.files(s, b)).select("repo", "kind", "severity", "title", F.size("evidence").alias("evidence")), J.sql([("repeated-logic", "info", "2 identical copies of a function (arrange, prepare)", 2)], "kind, severity, title, evidence"))
R.add("join_interval_cover", lambda s, b: duplicates.outermost(duplicates.repeated_bodies(J.texts(s, b), A.symbols_of(cut(J.parsed(s, b))), min_lines=2)).select("repo", "path", "start_line", "end_line", "copies"), J.sql([("zapp/again.py", 4, 11, 2), ("zapp/util.py", 4, 11, 2)], "path, start_line, end_line, copies"))
_STEM_OF = f"array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({_N}, '(.)\\..*$', '\\1'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\-\\s]+'), lambda w: w <> '' AND w NOT IN ({_q(P.ROLE_WORDS)})), '')"
_ALLF = f"WITH {J.files_sql()}, af AS (SELECT repo, path, language, lines, is_test, generated_reason FROM files UNION ALL SELECT repo, path, language, lines::int, is_test, NULL FROM pf)"
R.add(
    "find_similar_names", lambda s, b: findings.similar_names(J.files(s, b)).select("repo", "title", F.size("evidence").alias("evidence")),
    f"{_ALLF} SELECT repo, count(*) || ' files named after \"' || stem || '\" in ' || count(DISTINCT area) || ' areas' AS title, count(*) AS evidence FROM (SELECT repo, {_AREA} AS area, {_STEM_OF} AS stem FROM af WHERE NOT is_test AND {_CODE} AND generated_reason IS NULL AND lower(language) NOT IN ('css', 'html')) WHERE length(stem) >= 3 AND stem NOT IN ({_q(P.GENERIC_STEMS)}) GROUP BY repo, stem HAVING count(*) >= 3 AND count(DISTINCT area) >= 2",
)
_GENERATED = f"""
WITH f AS (SELECT repo, path AS p, generated_reason AS r, {_LOW} AS n, {_TEST} AS t FROM files),
env AS (SELECT repo, p, t FROM f WHERE (n = '.env' OR prefix(n, '.env.')) AND n NOT IN ({_q(P.ENV_TEMPLATES)})),
db AS (SELECT repo, p FROM f WHERE regexp_matches(n, '\\.(sqlite3?|db)$') AND n <> 'thumbs.db'),
a AS (SELECT repo, CASE WHEN t THEN 'info' ELSE 'warn' END AS severity, 'Environment file committed' || CASE WHEN t THEN ' in tests: ' ELSE ': ' END || p AS title FROM env
UNION ALL SELECT repo, CASE WHEN r IN ('marked as generated', 'minified file', 'source map') THEN 'info' ELSE 'warn' END, CASE WHEN count(*) = 1 THEN 'Generated file committed (' || r || '): ' || min(p) ELSE count(*) || ' generated files committed (' || r || ')' END FROM f WHERE r IS NOT NULL GROUP BY repo, r
UNION ALL SELECT repo, 'info', CASE WHEN count(*) = 1 THEN 'Database file committed: ' || min(p) ELSE count(*) || ' database files committed' END FROM db GROUP BY repo)"""
R.add("find_generated", lambda s, b: findings.committed_generated(J.files(s, b)).select("repo", "severity", "title"), _GENERATED + " SELECT repo, severity, title FROM a")
R.add(
    "find_missing_tests", lambda s, b: findings.missing_tests(J.files(s, b), _edges(s, b)).select("repo", "title", F.size("evidence").alias("evidence")),
    f"{_ALLF}, x AS (SELECT *, {_AREA} AS area FROM af) SELECT repo, 'No tests found for ' || area AS title, least(count(*), 5) AS evidence FROM x WHERE NOT is_test AND {_CODE} AND generated_reason IS NULL AND lower(language) NOT IN ('css', 'html') AND area NOT IN ('(root)', 'zapp', 'zextra') "
    f"AND string_split(area, '/')[-1] NOT IN ({_q(P.ENTRY_DIRS)}) AND (repo, area) NOT IN (SELECT (repo, area) FROM x WHERE is_test) GROUP BY repo, area HAVING sum(lines) >= 300",
)
_TOKENS = "list_concat(regexp_extract_all(text, '([A-Za-z_][\\w.]*)\\s*:\\s*[A-Za-z_]\\w*', 1), regexp_extract_all(text, '\\b[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+\\b'))"
_DOTS = "string_split(replace(regexp_replace(path, '(/__init__)?\\.pyi?$', ''), '/', '.'), '.')"
_USED = sorted({d for s, d, _ in J.EDGES if not s.startswith("tests/") and s != J.ODD})
R.add(
    "find_unreferenced", lambda s, b: _unreferenced(s, b, cut(J.parsed(s, b))).select("repo", "title", F.size("evidence").alias("evidence")),
    f"WITH {J.files_sql()}, mods AS (SELECT DISTINCT repo, unnest({_TOKENS}) AS m FROM file_text t JOIN files f USING (repo, path) WHERE {_N} IN ('pyproject.toml', 'setup.cfg', 'setup.py') AND NOT is_binary AND skip_reason IS NULL), "
    f"c AS (SELECT f.repo, f.path FROM files f JOIN file_text t USING (repo, path) WHERE lower(language) = 'python' AND suffix(path, '.py') AND NOT is_test AND generated_reason IS NULL AND NOT regexp_matches(text, '__name__\\s*==\\s*[''\"]__main__[''\"]|[''\"]__main__[''\"]\\s*==\\s*__name__') "
    f"UNION ALL SELECT repo, path FROM pf WHERE NOT is_test AND NOT guarded AND path NOT IN ({_q(_USED)})), "
    f"e AS (SELECT repo, path FROM c WHERE NOT {_ENTRY}), d AS (SELECT DISTINCT s.repo, s.path FROM (SELECT repo, path, array_to_string(list_slice(p, i, len(p)), '.') AS m FROM (SELECT repo, path, {_DOTS} AS p, unnest(range(1, len({_DOTS}) + 1)) AS i FROM e)) s JOIN mods USING (repo, m)) "
    "SELECT repo, CASE WHEN path = 'zextra/helper.py' THEN 'Only tests import ' ELSE 'No static import found: ' END || path AS title, 1 AS evidence FROM e WHERE (repo, path) NOT IN (SELECT (repo, path) FROM d)",
)
R.add("find_import_cycles", lambda s, b: findings.import_cycles(_edges(s, b)).select("repo", "title", F.size("evidence").alias("evidence")), J.sql([("Import cycle between 2 directories: zapp/core, zapp/store", 2)], "title, evidence"))


@R.query(J.sql([("Two modules named models.py", 2)], "title, evidence"))
def find_same_name_nested(spark, base):  # noqa: ANN001, ANN201
    grouped = spark.createDataFrame([], "repo string, path string")
    return findings.same_name_nested(J.files(spark, base), _edges(spark, base), grouped).select("repo", "title", F.size("evidence").alias("evidence"))


@R.query()
def union_findings(spark, base):  # noqa: ANN001, ANN201
    parsed = cut(J.parsed(spark, base))
    f, t, e = cut(J.files(spark, base)), J.texts(spark, base), _edges(spark, base, parsed)
    dup = cut(findings.near_duplicates(f, t))
    grouped = dup.select("repo", F.explode("evidence").alias("x")).select("repo", "x.path")
    parts = [dup, findings.same_name_nested(f, e, grouped), findings.repeated_functions(t, A.symbols_of(parsed), f), findings.similar_names(f), findings.import_cycles(e), findings.committed_generated(f), findings.missing_tests(f, e), findings.unreferenced(f, t, e, parsed.select("repo", "path"))]
    kept, _ = findings.number([cut(p) for p in parts])
    return kept.select("repo", "id", "kind", "severity", "title", F.size("evidence").alias("evidence"))


_NUM = "WITH d AS (SELECT repo, generated_reason AS kind, path AS p FROM files WHERE generated_reason IS NOT NULL), n AS (SELECT repo, kind, p, row_number() OVER (PARTITION BY repo, kind ORDER BY p) AS n FROM d)"


def _numbered(spark, base):  # noqa: ANN001, ANN202
    f = table(spark, base, "files").filter("generated_reason is not null").select("repo", F.col("generated_reason").alias("kind"), F.col("path").alias("p"))
    d = f.select("repo", "kind", F.lit("info").alias("severity"), F.col("p").alias("title"), F.array(F.struct(F.col("p").alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("string").alias("note"))).alias("evidence"), F.struct(F.lit(0).alias("o0"), F.col("p").alias("o1")).alias("sort_key"))
    return findings.number([d], cap=1)


R.add("win_finding_id", lambda s, b: _numbered(s, b)[0].select("repo", "id", "title"), _NUM + " SELECT repo, kind || '-' || n AS id, p AS title FROM n WHERE n <= 1")
R.add("agg_findings_omitted", lambda s, b: _numbered(s, b)[1], _NUM + " SELECT repo, kind, count(*) - 1 AS omitted FROM n GROUP BY repo, kind HAVING count(*) > 1")
R.add("ui_warn_only", lambda s, b: findings.committed_generated(J.files(s, b)).filter("severity = 'warn'").select("repo", "kind", "title"), _GENERATED + " SELECT repo, 'generated-file-committed' AS kind, title FROM a WHERE severity = 'warn'")

# ---- graphs on trade between nations ----
_TRADE = "t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), e AS MATERIALIZED (SELECT x.src, x.dst FROM t x LEFT JOIN t y ON y.src = x.dst AND y.dst = x.src WHERE x.src <> x.dst AND x.n > coalesce(y.n, 0) + sqrt(x.n))"


def _trade(spark, base):  # noqa: ANN001, ANN202
    """Nations, and an edge where one buys more from another than it sells to it, by more than chance (a square root)."""
    li, o = table(spark, base, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, base, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, base, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, base, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = cut(j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n")))
    back = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("m"))
    e = t.join(back, ["src", "dst"], "left").filter((F.col("src") != F.col("dst")) & (F.col("n") > F.coalesce("m", F.lit(0)) + F.sqrt("n"))).select("src", "dst")
    return graph.build(cut(e), table(spark, base, "nation").select("n_nationkey"))


def _pr_sql(reverse: bool = False, rounds: int = 50) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    sql = f"WITH {_TRADE}, dg AS (SELECT {a} AS s, count(*) AS d FROM e GROUP BY 1), w AS MATERIALIZED (SELECT {a} AS s, {b} AS t, 1 / d::double AS w FROM e JOIN dg ON s = {a}), nd AS MATERIALIZED (SELECT n_nationkey AS k, count(d) = 0 AS loose FROM nation LEFT JOIN dg ON s = n_nationkey GROUP BY 1), r0 AS (SELECT k, 1 / 25.0::double AS r FROM nd)"
    for i in range(1, rounds + 1):
        sql += f", r{i} AS MATERIALIZED (SELECT nd.k, 0.15::double / 25 + 0.85::double / 25 * (SELECT coalesce(sum(r), 0) FROM r{i - 1} JOIN nd q USING (k) WHERE q.loose) + 0.85::double * coalesce(z.s, 0) AS r FROM nd LEFT JOIN (SELECT t, sum(r * w) AS s FROM w JOIN r{i - 1} ON k = w.s GROUP BY t) z ON z.t = nd.k)"
    return sql + f" SELECT k AS node, round(r, 6) AS rank FROM r{rounds}"


_rank6 = lambda df: df.select("node", F.round("rank", 6).alias("rank"))
R.add("graph_pagerank", lambda s, b: _rank6(graph.pagerank(*_trade(s, b))), _pr_sql())
R.add("graph_reach", lambda s, b: _rank6(graph.pagerank(*_trade(s, b), reverse=True)), _pr_sql(True))


@R.query()
def graph_centrality(spark, base):  # noqa: ANN001, ANN201
    """PageRank of the import graph of every repository, on its own."""
    e = _edges(spark, base)
    nodes = J.files(spark, base).filter(F.lower("language") == "python").select("repo", F.col("path").alias("node")).distinct()
    return graph.pagerank(nodes, e).select("repo", "node", F.round("rank", 6).alias("rank"))


_REACH = f"WITH RECURSIVE {_TRADE}, p(a, b) AS (SELECT src, dst FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b), c AS (SELECT n_nationkey AS node, least(n_nationkey, coalesce((SELECT min(p.b) FROM p JOIN p q ON q.a = p.b AND q.b = p.a WHERE p.a = n_nationkey), n_nationkey)) AS component FROM nation)"
R.add("graph_scc", lambda s, b: graph.scc(*_trade(s, b)), _REACH + " SELECT node, component FROM c")
_LAY = _REACH + ", ce AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.component <> y.component), w(k, d) AS (SELECT DISTINCT component, 0 FROM c UNION SELECT ce.a, w.d + 1 FROM w JOIN ce ON ce.b = w.k)"
R.add("graph_layers", lambda s, b: graph.layers(*_trade(s, b))[0].select("node", "layer"), _LAY + " SELECT node, (SELECT max(d) FROM w WHERE k = component) AS layer FROM c")
R.add("graph_cycles", lambda s, b: graph.layers(*_trade(s, b))[1].select("component", "size", F.size("edges").alias("edges")), _REACH + " SELECT c.component, count(*) AS size, (SELECT count(*) FROM e JOIN c x ON x.node = src JOIN c y ON y.node = dst WHERE x.component = y.component AND x.component = c.component) AS edges FROM c GROUP BY 1 HAVING count(*) > 1")
R.add("semi_graph_restrict", lambda s, b: graph.restrict(*_trade(s, b), table(s, b, "nation").filter("n_regionkey < 3").select("n_nationkey"))[1], f"WITH {_TRADE} SELECT src, dst FROM e WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
R.add("agg_edge_count", lambda s, b: _trade(s, b)[1].agg(F.count(F.lit(1)).alias("edges")), f"WITH {_TRADE} SELECT count(*) AS edges FROM e")
R.add("agg_fan_in", lambda s, b: _trade(s, b)[1].groupBy("dst").agg(F.count_distinct("src").alias("fan_in")), f"WITH {_TRADE} SELECT dst, count(DISTINCT src) AS fan_in FROM e GROUP BY 1")
R.add("win_example_dep", lambda s, b: _trade(s, b)[1].groupBy("src").agg(F.min("dst").alias("example")), f"WITH {_TRADE} SELECT src, min(dst) AS example FROM e GROUP BY 1")


@R.query(f"WITH {_TRADE} SELECT a.n_regionkey AS src, b.n_regionkey AS dst, count(*) AS n FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL")
def graph_dir_deps(spark, base):  # noqa: ANN001, ANN201
    _, e = _trade(spark, base)
    n = table(spark, base, "nation")
    j = e.join(n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("us")), "src").join(n.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("ud")), "dst")
    return j.filter("us <> ud").groupBy(F.col("us").alias("src"), F.col("ud").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


R.add("union_edges", lambda s, b: graph_edges_out(s, b), f"WITH {_TRADE} SELECT src, dst, 'import' AS kind, 1 AS weight FROM e UNION ALL SELECT r_regionkey, r_regionkey + 1, 'cochange', 2 FROM region")


@R.query(f"WITH {_TRADE} SELECT src, dst, 'import' AS kind, 1 AS weight FROM e UNION ALL SELECT r_regionkey, r_regionkey + 1, 'cochange', 2 FROM region")
def graph_edges_out(spark, base):  # noqa: ANN001, ANN201
    _, e = _trade(spark, base)
    c = table(spark, base, "region").select(F.col("r_regionkey").alias("src"), (F.col("r_regionkey") + 1).alias("dst"), F.lit("cochange").alias("kind"), F.lit(2).alias("weight"))
    return e.select("src", "dst", F.lit("import").alias("kind"), F.lit(1).alias("weight")).unionByName(c)


R.add("topk_graph_nodes", lambda s, b: _trade(s, b)[1].groupBy("dst").agg(F.count_distinct("src").alias("n")).orderBy(F.desc("n"), "dst").limit(10), f"WITH {_TRADE} SELECT dst, count(DISTINCT src) AS n FROM e GROUP BY 1 ORDER BY n DESC, dst LIMIT 10")

# ---- jobs, limits, streams: events are calls, users callers, types stages ----
R.add("state_rate_limit", lambda s, b: jobs.rate_limit(table(s, b, "events"), caller="user_id", at="ts", order="event_id", per_hour=1).filter("NOT accepted").select("event_id"), "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 1")
R.add("state_progress_throttle", lambda s, b: jobs.stage_changes(table(s, b, "events"), key="user_id", at="ts", order="event_id", stage="event_type").select("event_id"), "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
R.add("state_machine", lambda s, b: jobs.latest(table(s, b, "events").select("user_id", "ts", "event_id", "event_type"), key="user_id", at="ts").select("user_id", "event_type"), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
_JOBS = "j AS (SELECT user_id AS id, arg_max(CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' WHEN 'view' THEN 'RUNNING' ELSE 'QUEUED' END, (ts, event_id)) AS status, max(ts) AS seen FROM events GROUP BY 1)"


def _jobs(spark, base):  # noqa: ANN001, ANN202
    st = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "view", "RUNNING").otherwise("QUEUED")
    e = table(spark, base, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("at"), "event_id", st.alias("status"))
    return jobs.latest(e, key="id", at="at").select("id", "status", "at")


R.add("state_dedupe_active", lambda s, b: jobs.admit(table(s, b, "customer").select(F.col("c_custkey").alias("id")), _jobs(s, b), source="id"), f"WITH {_JOBS} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM j WHERE status IN ('QUEUED', 'RUNNING'))")
R.add("state_abandoned", lambda s, b: jobs.abandon(_jobs(s, b)).select("id", "status"), f"WITH {_JOBS} SELECT id, CASE WHEN status IN ('QUEUED', 'RUNNING') THEN 'FAILED' ELSE status END AS status FROM j")
R.add("topk_recent_done", lambda s, b: jobs.recent_done(_jobs(s, b), at="at", most=15).select("id"), f"WITH {_JOBS} SELECT id FROM j WHERE status = 'DONE' ORDER BY seen DESC LIMIT 15")
R.add("sink_retention", lambda s, b: jobs.kept_jobs(_jobs(s, b), key="id", at="at"), f"WITH {_JOBS} SELECT id FROM j WHERE status = 'DONE' ORDER BY seen DESC, id LIMIT 20")
R.add("scan_analysis_table", lambda s, b: jobs.active(_jobs(s, b), source="id").select("id", "status"), f"WITH {_JOBS} SELECT id, status FROM j WHERE status IN ('QUEUED', 'RUNNING')")


_QUEUE = "q AS (SELECT user_id % 4 AS worker, event_id, ts AS a, ts + to_seconds((event_id * 7919) % 36000) AS b FROM events)"


@R.query(f"WITH {_QUEUE} SELECT x.worker, x.event_id, count(y.event_id) AS waiting, count(y.event_id) >= 20 AS rejected FROM q x LEFT JOIN q y ON y.worker = x.worker AND (y.a < x.a OR (y.a = x.a AND y.event_id < x.event_id)) AND y.b > x.a GROUP BY ALL")
def state_job_queue(spark, base):  # noqa: ANN001, ANN201
    e = table(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.timestamp_micros(F.unix_micros("ts") + (F.col("event_id") * 7919 % 36000) * 1_000_000)
    q = e.select((F.col("user_id") % 4).alias("worker"), "event_id", F.col("ts").alias("a"), start.alias("b"))
    return jobs.queue_depth(q, worker="worker", key="event_id", submitted="a", started="b")


@R.query("WITH p AS (SELECT u.user_id, t.ts FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events) t), l AS (SELECT user_id, ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL) SELECT p.user_id, strftime(p.ts, '%Y-%m-%d %H:%M:%S') AS ts, l.event_type FROM p ASOF LEFT JOIN l ON l.user_id = p.user_id AND l.ts <= p.ts")
def state_poll(spark, base):  # noqa: ANN001, ANN201
    e = table(spark, base, "events").select("user_id", "ts", "event_id", "event_type")
    days = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    span = days.agg(F.sort_array(F.collect_list("ts"))).scalar()  # the moments of asking: one per day of the log
    asked = e.select("user_id").distinct().select("user_id", F.explode(span).alias("ts"))
    out = jobs.as_of(asked, e, key="user_id", at="ts", value="event_type", order="event_id")
    return out.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type")


@R.query("SELECT user_id, status, count(*) AS n, count_if(ok)::bigint AS allowed FROM (SELECT user_id, status, CASE WHEN p IS NULL THEN status = 'QUEUED' WHEN p = 'QUEUED' THEN status IN ('RUNNING', 'FAILED') WHEN p = 'RUNNING' THEN status IN ('RUNNING', 'DONE', 'FAILED') WHEN p = 'DONE' THEN status = 'FAILED' ELSE false END AS ok FROM (SELECT user_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' WHEN 'view' THEN 'RUNNING' ELSE 'QUEUED' END AS status FROM events))) GROUP BY ALL")
def sink_job_state(spark, base):  # noqa: ANN001, ANN201
    st = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "view", "RUNNING").otherwise("QUEUED")
    v = jobs.valid_moves(table(spark, base, "events").select("user_id", "event_id", st.alias("status")), key="user_id", at="event_id", status="status")
    return v.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed"))


def _stream(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Drains a stream with availableNow into parquet below the shared checkpoint folder; complete results replace it."""
    from codequarry.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    out = f"{root}/{name}-{os.getpid()}-{id(df)}"
    if mode == "complete":

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}-d")

        q = df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}-d")
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{out}-d").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}-d")


def _events_stream(spark, base):  # noqa: ANN001, ANN202
    schema = table(spark, base, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(base).withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, base):  # noqa: ANN001, ANN201
    out = _stream(throttle.hourly_counts(_events_stream(spark, base), at="ts", key="event_type"), "stream_hourly_counts", "complete")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@R.query("SELECT event_id, rn <= 1 AS accepted FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events)")
def stream_rate_limit(spark, base):  # noqa: ANN001, ANN201
    out = _stream(throttle.limited_calls(_events_stream(spark, base), caller="user_id", at="ts", call_id="event_id", per_hour=1), "stream_rate_limit", "append")
    return out.select(F.col("call_id").alias("event_id"), "accepted")


R.add("stream_progress_throttle", lambda s, b: throttle.throttled_progress(table(s, b, "events"), job="user_id", at="ts", stage="event_type", event_id="event_id").select("event_id", "stage"))

# ---- interface lookups ----
R.add("ui_report_index", lambda s, b: _trade(s, b)[1].groupBy("dst").agg(F.array_join(F.sort_array(F.collect_list("src")), ",").alias("importers")), f"WITH {_TRADE} SELECT dst, array_to_string(list_sort(list(src)), ',') AS importers FROM e GROUP BY 1")
_E = J.sql([e for e in J.EDGES if e[0] != J.ODD], "src, dst, first_line", [e for e in J.EDGES if e[0] == J.ODD])


@R.query(
    f"WITH {J.files_sql()}, e AS ({_E}), f AS (SELECT repo, path, is_test FROM files WHERE lower(language) = 'python' UNION ALL SELECT repo, path, is_test FROM pf), i AS (SELECT e.repo, dst AS path, count_if(NOT is_test) AS importers, count_if(is_test) AS tests FROM e JOIN f ON f.repo = e.repo AND f.path = src GROUP BY ALL), "
    "o AS (SELECT repo, src AS path, count(*) AS imports FROM e GROUP BY ALL) SELECT f.repo, f.path, coalesce(importers, 0)::bigint AS importers, coalesce(tests, 0)::bigint AS tests, coalesce(imports, 0)::bigint AS imports FROM f LEFT JOIN i ON i.repo = f.repo AND i.path = f.path LEFT JOIN o ON o.repo = f.repo AND o.path = f.path"
)
def ui_file_details(spark, base):  # noqa: ANN001, ANN201
    """Of every Python file how many files and how many tests import it, and how many files it imports."""
    e = _edges(spark, base)
    f = J.files(spark, base).filter(F.lower("language") == "python").select("repo", "path", "is_test")
    into = e.join(f.withColumnRenamed("path", "src"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("path")).agg(F.count_if(~F.col("is_test")).alias("importers"), F.count_if("is_test").alias("tests"))
    out = e.groupBy("repo", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("imports"))
    return f.drop("is_test").join(into, ["repo", "path"], "left").join(out, ["repo", "path"], "left").fillna(0, ["importers", "tests", "imports"])


# ---- sources and sinks on a repository built here ----
_DEMO = {
    "app/__init__.py": "", "app/models.py": "import os\n\n\nclass Item:\n    def total(self):\n        return 1\n", "app/views.py": "from app import models\nfrom .models import Item\n\n\ndef show():\n    return Item().total()\n",
    "tests/test_models.py": "from app.models import Item\n\n\ndef test_total():\n    assert Item().total() == 1\n", "README.md": "# Demo\n\nSee app/models.py.\n",
}


def demo_repo(spark: SparkSession) -> str:
    """A small repository of two commits and a rename, made once per application in the shared checkpoint folder."""
    from codequarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = urlsplit(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path
    d = os.path.join(os.path.dirname(root), f"demo-repo-{spark.sparkContext.applicationId}")
    if os.path.exists(os.path.join(d, "made")):
        return d
    os.makedirs(d, exist_ok=True)
    env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Ann"), ("EMAIL", "ann@example.org"), ("DATE", "2024-01-01T00:00:00Z"))}
    run = lambda *a: subprocess.run(["git", "-C", d, *a], check=True, capture_output=True, env=env)
    run("init", "-q", "-b", "main")
    for p, t in _DEMO.items():
        os.makedirs(os.path.dirname(os.path.join(d, p)) or d, exist_ok=True)
        with open(os.path.join(d, p), "w") as f:
            f.write(t)
    run("add", "-A")
    run("commit", "-q", "-m", "first")
    run("mv", "app/views.py", "app/pages.py")
    run("commit", "-q", "-m", "rename")
    with open(os.path.join(d, "made"), "w"):
        return d


@R.query()
def scan_tree(spark, base):  # noqa: ANN001, ANN201
    return G.inventory(G.read_git(spark, demo_repo(spark), "blobs")).drop("blob_id", "text")


_BLOBS = {p.replace("views", "pages"): t for p, t in _DEMO.items()}
R.add("scan_blob", lambda s, b: G.read_git(s, demo_repo(s), "blobs").select("path", "size_bytes", F.length("content").alias("n")), values_sql([(p, len(t), len(t)) for p, t in _BLOBS.items()], "path, size_bytes, n"))
R.add("scan_text", lambda s, b: G.inventory(G.read_git(s, demo_repo(s), "blobs")).select("path", F.coalesce("text", F.lit("")).alias("text")), values_sql(list(_BLOBS.items()), "path, text"))
R.add("scan_commits", lambda s, b: G.read_git(s, demo_repo(s), "commits").select("author_email", "n_parents", "files_changed", "seq"), values_sql([("ann@example.org", 1, 1, 0), ("ann@example.org", 0, 5, 1)], "author_email, n_parents, files_changed, seq"))
R.add("scan_diff", lambda s, b: G.read_git(s, demo_repo(s), "commit_files").select("path", "change", "seq"), values_sql([("app/pages.py", "R", 0), *((p, "A", 1) for p in _DEMO)], "path, change, seq"))
R.add("scan_blame", lambda s, b: G.blame(s.createDataFrame([(p,) for p in ("app/models.py", "app/pages.py", "gone.py")], "path string"), demo_repo(s), tasks=2).select("path", "email", "lines", F.col("error").isNotNull().alias("failed")), values_sql([("app/models.py", "ann@example.org", 6, False), ("app/pages.py", "ann@example.org", 6, False), ("gone.py", None, 0, True)], "path, email, lines, failed"))


@R.query(values_sql([(0, "app/pages.py"), *((1, p) for p in _BLOBS)], "seq, path"))
def join_rename_closure(spark, base):  # noqa: ANN001, ANN201
    d = demo_repo(spark)
    c = G.read_git(spark, d, "commits")
    return H.follow_renames(G.read_git(spark, d, "commit_files"), c, G.read_git(spark, d, "renames")).join(c.select("commit_id", "seq"), "commit_id").select("seq", "path")


_MAP = "Jane Doe <jane@example.org> <jd@old.example>\nBob <bob@example.org>\nDee <dee@example.org> D <d@x.example>\n# no\n<only@example.org>\n"


def _mailmap(spark):  # noqa: ANN001, ANN202
    return H.parse_mailmap(spark.createDataFrame(list(enumerate(_MAP.split("\n"))), "ord int, value string"))


R.add("scan_mailmap", lambda s, b: _mailmap(s), values_sql([(0, "Jane Doe", "jane@example.org", None, "jd@old.example"), (1, "Bob", None, None, "bob@example.org"), (2, "Dee", "dee@example.org", "D", "d@x.example")], "ord, proper_name, proper_email, commit_name, commit_email"))
R.add("fn_mailmap_map", lambda s, b: H.apply_mailmap(s.createDataFrame([("J", "JD@old.example"), ("b", "bob@example.org"), ("d", "d@x.example"), ("z", "z@z.example")], "name string, email string"), _mailmap(s)), values_sql([("J", "JD@old.example", "Jane Doe", "jane@example.org"), ("b", "bob@example.org", "Bob", "bob@example.org"), ("d", "d@x.example", "Dee", "dee@example.org"), ("z", "z@z.example", "z", "z@z.example")], "name, email, mapped_name, mapped_email"))
R.add("scan_codeowners", lambda s, b: evaluate.codeowners(s.createDataFrame([("*       @org/core",), ("/src/ui/ @Ann @bob",), ("docs/*.md @writer",), ("# x",)], "value string")).select("dir", F.array_join("handles", ",").alias("handles")), values_sql([(".", "org/core"), ("src/ui", "ann,bob"), ("docs", "writer")], "dir, handles"))
R.add("scan_ignore_revs", lambda s, b: s.createDataFrame([(len(x), x == G.open_local(demo_repo(s))) for x in G.ignored_revisions("# formatting\n" + "0" * 40 + "\n" + G.open_local(demo_repo(s)).upper() + "  # head\n" + "abc\n", demo_repo(s))], "digits int, head boolean"), "SELECT 40 AS digits, true AS head")
R.add("join_handle_person", lambda s, b: evaluate.link_handles(table(s, b, "people").filter("NOT coalesce(bot, false)"), table(s, b, "people").select(F.substring_index(F.get("emails", F.lit(0)), "@", 1).alias("handle")).distinct()).groupBy("handle").agg(F.count(F.lit(1)).alias("people")))


@R.query("SELECT CAST(count(*) AS varchar) AS files FROM files")
def sink_report_json(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files")
    report = X.assemble({"overview": overview.overview(f), "languages": overview.languages(f)})
    return report.select(F.get_json_object("value", "$.overview.files").alias("files"))


@R.query("SELECT analysis_id, count(*) AS n FROM chunks WHERE analysis_id IS NOT NULL GROUP BY 1")
def sink_chunks(spark, base):  # noqa: ANN001, ANN201
    from codequarry.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    out = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/chunks-{os.getpid()}"
    c = table(spark, base, "chunks").filter("analysis_id is not null")
    X.drop_expired(spark, out, spark.createDataFrame([], "analysis_id string"))
    X.write_chunks(c, out)
    return X.chunk_table(spark, out).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"))


@R.query()
def sink_markdown_summary(spark, base):  # noqa: ANN001, ANN201
    p = table(spark, base, "part").groupBy(F.col("p_brand").alias("repo"), F.col("p_type").alias("ranking")).agg(F.round(F.avg("p_size"), 3).alias("v"))
    text = evaluate.markdown_table(evaluate.percentile_table(p, repo="repo", ranking="ranking", value="v"), "Sizes")
    return spark.createDataFrame([(text,)], "value string")
