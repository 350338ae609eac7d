"""Queries of row-level functions and predicates over files, documents and identities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.functions import scoring as S
from codequarry.functions import text as T
from codequarry.plans.registry import Registry
from codequarry.session import table

R = Registry()
_D = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"
_N = "string_split(path, '/')[-1]"
_LOW = f"lower({_N})"
_q = lambda xs: ", ".join(f"'{x}'" for x in xs)
_LANG = "CASE lower(regexp_extract(" + _N + r", '^.+\.([^.]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGES.items()) + " END"
_TEST = f"(len(list_filter({_D}, lambda d: lower(d) IN ('test', 'tests', '__tests__'))) > 0 OR regexp_matches({_N}, " + r"'^conftest\.py$|^test_.*\.py$|_test\.py$|\.test\.|\.spec\.|_test\.go$|Tests?\.java$'))"
_CODE = f"(lower(language) IS NOT NULL AND lower(language) NOT IN ({_q(P.NON_CODE)}))"
_ENTRY = f"({_N} IN ({_q(P.ENTRY_NAMES)}) OR regexp_matches(path, '(^|/)docs/conf\\.py$') OR len(list_filter({_D}, lambda d: d IN ({_q(P.ENTRY_DIRS)}))) > 0)"


def per_file(name: str, value: Callable[[], Column], sql: str | None, keep: Callable[[], Column] | None = None, keep_sql: str | None = None, tab: str = "files", key: str = "file_id") -> None:
    """Registers key and value of every row, or of the rows that pass a predicate; columns are built when the query runs."""

    def fn(spark, base):  # noqa: ANN001, ANN202
        df = table(spark, base, tab)
        if keep is not None:
            df = df.filter(keep())
        return df.select(key, value().alias("value"))

    R.add(name, fn, sql and f"SELECT {key}, {sql} AS value FROM {tab}" + (f" WHERE {keep_sql}" if keep_sql else ""))


per_file("fn_language", lambda: P.language(F.col("path")), _LANG)
per_file("fn_is_test", lambda: P.is_test(F.col("path")), _TEST)
_G = f"list_filter({_D}, lambda d: d IN ({_q(P.CACHE_DIRS)}) OR suffix(d, '.egg-info') OR (d IN ('dist', 'build') AND regexp_extract({_LOW}, '\\.([^.]*)$', 1) IN ({_q(P.BUILD_OUTPUT)})))[1]"
per_file(
    "fn_generated_reason", lambda: P.generated_reason(F.col("path")),
    f"CASE WHEN {_G} IN ('dist', 'build') THEN 'build output (' || {_G} || '/)' WHEN {_G} IS NOT NULL THEN 'build output or cache (' || {_G} || '/)' "
    f"WHEN regexp_matches({_LOW}, '\\.py[co]$') THEN 'compiled Python' WHEN {_LOW} IN ('.coverage', 'coverage.xml') THEN 'test coverage output' "
    f"WHEN regexp_matches({_LOW}, '\\.min\\.(js|css)$') THEN 'minified file' WHEN regexp_matches({_LOW}, '\\.(js|css)\\.map$') THEN 'source map' "
    f"WHEN {_LOW} IN ('.ds_store', 'thumbs.db') THEN 'operating system metadata' "
    f"WHEN regexp_matches({_LOW}, '^[0-9a-f]{{16,}}\\.(json|pkl|pickle|bin|npy|npz|joblib|cache|dat)$') THEN 'cache entry (hash-named file)' END",
)
per_file("fn_local_file_kind", lambda: P.local_file_kind(F.col("path")), f"CASE WHEN ({_LOW} = '.env' OR prefix({_LOW}, '.env.')) AND {_LOW} NOT IN ({_q(P.ENV_TEMPLATES)}) THEN 'environment file' WHEN regexp_matches({_LOW}, '\\.(sqlite3?|db)$') AND {_LOW} <> 'thumbs.db' THEN 'database file' END")
per_file("fn_component_of", lambda: P.component_of(F.col("path")), "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END")
_AREA = f"CASE WHEN len(string_split(path, '/')) <= 1 THEN '(root)' WHEN len(string_split(path, '/')) > 2 AND string_split(path, '/')[1] IN ({_q(P.CONTAINERS)}) THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"
per_file("fn_area", lambda: P.area(F.col("path")), _AREA)
per_file("fn_ancestors", lambda: F.array_join(P.ancestors(F.col("path")), "|"), f"'.' || array_to_string(list_transform(range(1, len({_D}) + 1), lambda i: '|' || array_to_string(list_slice({_D}, 1, i), '/')), '')")
per_file("fn_name_stem", lambda: P.name_stem(F.col("path")), f"array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({_N}, '(.)\\..*$', '\\1'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_\\-\\s]+'), lambda w: w <> '' AND w NOT IN ({_q(P.ROLE_WORDS)})), '')")
_DOT = "replace(regexp_replace(path, '(/__init__)?\\.pyi?$', ''), '/', '.')"
per_file("fn_dotted_path", lambda: P.dotted_path(F.col("path")), _DOT)
per_file("fn_shared_dirs", lambda: P.shared_dirs(F.col("path"), F.lit("src/ui/x.py")), f"CASE WHEN {_D}[1] = 'src' THEN 1 + CASE WHEN {_D}[2] = 'ui' THEN 1 ELSE 0 END ELSE 0 END")
per_file("fn_is_ancestor", lambda: P.is_ancestor(F.lit("src"), P.dir_name(F.col("path"))), "(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END) LIKE 'src/%'")
per_file("fn_source_url", lambda: P.source_url(F.lit("https://example.org/r"), F.lit("HEAD"), F.col("path"), F.lit(1), F.when(F.col("lines") > 1, F.col("lines"))), "'https://example.org/r/blob/HEAD/' || path || CASE WHEN lines > 1 THEN '#L1-L' || lines ELSE '#L1' END")
per_file("fn_log_norm", lambda: F.round(S.log_norm(F.col("lines"), F.lit(1000)), 9), "round(ln(1 + lines::double) / ln(1001::double), 9)")
per_file("fn_round3", lambda: S.round3(F.col("size_bytes") / 7), "floor(size_bytes / 7.0::double * 1000 + 0.5) / 1000.0::double")
per_file("fn_format", lambda: F.concat(S.percent(F.least(F.lit(1.0), F.col("lines") / 400)), F.lit(" "), F.round(S.edge_width(F.greatest(F.lit(1), F.col("lines"))), 3).cast("string")), "CAST(round_even(least(1.0::double, lines / 400.0::double) * 100, 0)::bigint AS varchar) || '% ' || round(least(4.0::double, 1 + log2(greatest(1, lines)::double) / 2), 3)::double")
per_file("filter_python", lambda: F.col("path"), "path", lambda: F.lower("language") == "python", "lower(language) = 'python'")
per_file("filter_code", lambda: F.col("path"), "path", lambda: P.is_code(F.lower("language")), _CODE)
per_file("filter_parseable", lambda: F.col("path"), "path", lambda: ~F.col("is_binary") & F.col("skip_reason").isNull(), "NOT is_binary AND skip_reason IS NULL")
per_file("filter_blame_candidates", lambda: F.col("path"), "path", lambda: P.is_code(F.lower("language")) & ~F.col("is_binary") & F.col("skip_reason").isNull() & F.col("generated_reason").isNull(), f"{_CODE} AND NOT is_binary AND skip_reason IS NULL AND generated_reason IS NULL")
per_file("filter_reading_candidates", lambda: F.col("path"), "path", lambda: (F.lower("language") == "python") & ~F.col("is_test") & (F.col("non_blank_lines") >= 5), "lower(language) = 'python' AND NOT is_test AND non_blank_lines >= 5")
per_file("filter_testable", lambda: F.col("path"), "path", lambda: P.is_code(F.lower("language")) & F.col("generated_reason").isNull() & ~F.lower("language").isin("css", "html"), f"{_CODE} AND generated_reason IS NULL AND lower(language) NOT IN ('css', 'html')")
per_file("filter_entry_points", lambda: F.col("path"), "path", lambda: P.is_entry_point(F.col("path")), _ENTRY)
per_file("filter_private_module", lambda: F.col("path"), "path", lambda: P.is_private_module(F.col("path")), f"regexp_matches({_N}, '^_($|[^_])')")
per_file("filter_main_guard", lambda: F.col("path"), "path", lambda: F.col("text").rlike(T.MAIN_GUARD), "regexp_matches(text, '__name__\\s*==\\s*[''\"]__main__[''\"]|[''\"]__main__[''\"]\\s*==\\s*__name__')", tab="file_text")
per_file("filter_guidance_docs", lambda: F.col("path"), "path", lambda: F.col("path").rlike(T.DOC_FILE) & ~F.col("path").rlike(T.NOT_GUIDANCE), "regexp_matches(path, '^(readme|contributing|architecture|hacking|development|design|internals)(\\.(md|rst|txt))?$|^docs?/.*\\.(md|rst|txt)$', 'i') AND NOT regexp_matches(path, 'changelog|changes|history|news|release|upgrading|migration|api|reference|autoapi|_build|_static', 'i')")
per_file("ui_flagged_files", lambda: F.concat_ws("/", F.when(F.col("is_binary"), "binary"), F.col("skip_reason"), F.col("generated_reason")), "concat_ws('/', CASE WHEN is_binary THEN 'binary' END, skip_reason, generated_reason)", lambda: F.col("is_binary") | F.col("skip_reason").isNotNull() | F.col("generated_reason").isNotNull(), "is_binary OR skip_reason IS NOT NULL OR generated_reason IS NOT NULL")
per_file("ui_dir_depth", lambda: P.component_of(F.col("path")), "regexp_replace(path, '/[^/]*$', '')", lambda: (F.instr(F.col("path"), "/") > 0) & (F.size(P.dir_parts(F.col("path"))) <= 2), f"contains(path, '/') AND len({_D}) <= 2")

# texts: file_text has CR LF, unterminated last lines and empty texts
_L = "(CASE WHEN text = '' THEN []::varchar[] WHEN suffix(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END)"
_BL = "regexp_full_match(x, '[ \\t\\r\\f]*')"
_WIDTH = "length(replace(regexp_replace(regexp_extract(x, '^([ \\t\\r\\f]*)', 1), '[\\r\\f]', '', 'g'), chr(9), '    '))"


@R.query(
    f"SELECT file_id, len(l) AS lines, len(list_filter(l, lambda x: NOT {_BL})) AS non_blank, coalesce(list_sum(list_transform(list_filter(l, lambda x: NOT {_BL}), lambda x: {_WIDTH} // 4)), 0)::bigint AS indent_complexity FROM (SELECT file_id, {_L} AS l FROM file_text)"
)
def fn_line_metrics(spark, base):  # noqa: ANN001, ANN201
    return table(spark, base, "file_text").select("file_id", T.line_metrics(F.col("text")).alias("m")).select("file_id", "m.lines", "m.non_blank", "m.indent_complexity")


_HEAD5 = "array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10))"
per_file("fn_generated_marker", lambda: T.generated_marker(F.col("text")), "CASE WHEN " + " OR ".join(f"contains({_HEAD5}, '{m}')" for m in T.GENERATED_MARKERS) + " THEN 'marked as generated' END", tab="file_text")
per_file("fn_looks_binary", lambda: T.looks_binary(F.encode("text", "UTF-8")), "contains(substr(text, 1, 8000), chr(0))", tab="file_text")
_TRIM = "trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_SIG = f"list_distinct(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda x: {_TRIM}), lambda x: length(x) >= 8 AND NOT prefix(x, '#') AND NOT prefix(x, '//')))"
per_file("fn_significant_lines", lambda: F.size(T.significant_lines(F.col("text"))), f"len({_SIG})", tab="file_text")
per_file("fn_split_lines", lambda: F.size(T.split_lines(F.col("text"))), "(SELECT CASE WHEN len(s) > 1 AND s[-1] = '' THEN len(s) - 1 ELSE len(s) END FROM (SELECT string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]') AS s))", tab="file_text")
per_file("fn_config_modules", lambda: F.array_join(F.array_sort(T.config_modules(F.col("text"))), "|"), "array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(text, '([A-Za-z_][\\w.]*)\\s*:\\s*[A-Za-z_]\\w*', 1), regexp_extract_all(text, '\\b[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+\\b')))), '|')", lambda: F.col("path").rlike("toml$"), "suffix(path, 'toml')", tab="file_text")
per_file("fn_doc_tokens", lambda: F.concat(F.array_join(F.array_sort(T.doc_tokens(F.col("text"))["paths"]), "|"), F.lit("#"), F.array_join(F.array_sort(T.doc_tokens(F.col("text"))["modules"]), "|")), None, lambda: F.col("text").isNotNull(), "text IS NOT NULL", tab="documents", key="doc_id")
per_file("fn_terms", lambda: F.array_join(T.terms(F.col("text")), "|"), "array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3), '|')", lambda: F.col("text").isNotNull(), "text IS NOT NULL", tab="documents", key="doc_id")
per_file("fn_tsquery", lambda: T.any_of_query(T.terms(F.col("text"))), "(SELECT coalesce(string_agg(w, ' | ' ORDER BY i), '') FROM (SELECT w, min(i) AS i FROM (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: length(w) >= 3) AS l)) GROUP BY w))", lambda: F.col("text").isNotNull(), "text IS NOT NULL", tab="documents", key="doc_id")
_W = "list_filter(string_split_regex(lower(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"
_STEM = "CASE WHEN suffix(w, 'ss') THEN w " + " ".join(f"WHEN suffix(w, '{s}') AND length(w) > {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in T.STEM_SUFFIXES) + " ELSE w END"
_SYM = (lambda: F.col("symbol").isNotNull(), "symbol IS NOT NULL")
per_file("fn_split_words", lambda: F.array_join(T.split_words(F.col("symbol")), "|"), f"array_to_string({_W}, '|')", *_SYM, tab="chunks", key="chunk_id")
per_file("fn_stem", lambda: F.array_join(F.transform(T.split_words(F.col("symbol")), T.stem), "|"), f"array_to_string(list_transform({_W}, lambda w: {_STEM}), '|')", *_SYM, tab="chunks", key="chunk_id")
_ASK = lambda: F.array(F.lit("rotate"), F.lit("filters"), F.lit("queue"))
per_file("fn_symbol_match", lambda: T.symbol_matches(F.col("symbol"), _ASK()), "lower(symbol) IN ('rotate', 'filters', 'queue') OR string_split(lower(symbol), '.')[-1] IN ('rotate', 'filters', 'queue')", *_SYM, tab="chunks", key="chunk_id")
per_file("fn_symbol_word_match", lambda: T.symbol_word_matches(F.col("symbol"), _ASK()), f"len(list_filter(list_transform(list_filter({_W}, lambda w: length(w) >= 3), lambda w: {_STEM}), lambda w: w IN ('rotate', 'filter', 'queue'))) > 0", *_SYM, tab="chunks", key="chunk_id")
per_file("fn_path_match", lambda: T.path_matches(F.col("path"), F.array(F.lit("readme"), F.lit("changelog.md"))), f"{_LOW} IN ('readme', 'changelog.md') OR string_split({_LOW}, '.')[1] IN ('readme', 'changelog.md')", tab="chunks", key="chunk_id")
per_file("fn_location", lambda: T.location(F.col("path"), F.col("start_line"), F.col("end_line")), "path || ':' || start_line || '-' || end_line", lambda: F.col("start_line").isNotNull() & F.col("end_line").isNotNull(), "start_line IS NOT NULL AND end_line IS NOT NULL", tab="chunks", key="chunk_id")
per_file("filter_bot", lambda: F.col("email"), "email", lambda: T.is_bot(F.col("name"), F.col("email")), "coalesce(regexp_matches(name, '\\[bot]|^(dependabot|renovate|pre-commit-ci|github-actions|greenkeeper|allcontributors|snyk-bot)\\b', 'i'), false) OR coalesce(regexp_matches(email, '\\[bot]|^(dependabot|renovate|pre-commit-ci|github-actions|greenkeeper|allcontributors|snyk-bot)\\b', 'i'), false)", tab="identities", key="identity_id")
per_file("fn_normalize_name", lambda: T.normalize_name("name"), "trim(regexp_replace(nfc_normalize(lower(coalesce(name, ''))), '\\s+', ' ', 'g'))", tab="identities", key="identity_id")
per_file("fn_pattern_to_dir", lambda: P.pattern_to_dir(F.concat(F.lit("/"), P.component_of(F.col("path")), F.lit("/*"))), "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END")


@R.query(
    "SELECT doc_id, c[1] AS path, c[2]::int AS start_line, CASE WHEN c[3] <> '' THEN c[3]::int ELSE 0 END AS end_line FROM (SELECT DISTINCT doc_id, [replace(regexp_extract(m, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9]+):(\\d+)(?:\\s*[-–]\\s*(\\d+))?', 1), '\\', '/'), regexp_extract(m, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9]+):(\\d+)(?:\\s*[-–]\\s*(\\d+))?', 2), regexp_extract(m, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9]+):(\\d+)(?:\\s*[-–]\\s*(\\d+))?', 3)] AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9]+):(\\d+)(?:\\s*[-–]\\s*(\\d+))?')) AS m FROM documents))"
)
def fn_citations(spark, base):  # noqa: ANN001, ANN201
    d = table(spark, base, "documents")
    return d.select("doc_id", F.explode(T.citations(F.col("text"))).alias("c")).select("doc_id", "c.path", F.col("c.start").alias("start_line"), F.coalesce("c.end", F.lit(0)).alias("end_line"))


@R.query(
    "SELECT file_id, repo, u, CASE WHEN m <> '' THEN 'github' WHEN contains(u, '://') OR prefix(u, 'git@') THEN NULL ELSE 'local' END AS kind FROM (SELECT file_id, repo, u, regexp_extract(u, '^https://github\\.com/([A-Za-z0-9][A-Za-z0-9-]{0,38})/([A-Za-z0-9._-]{1,100}?)(?:\\.git)?/?$', 1) AS m FROM (SELECT file_id, repo, CASE file_id % 4 WHEN 0 THEN 'https://github.com/' || repo WHEN 1 THEN 'https://github.com/' || repo || '.git' WHEN 2 THEN 'git@host:' || repo ELSE path END AS u FROM files))"
)
def src_parse_uri(spark, base):  # noqa: ANN001, ANN201
    k = F.col("file_id") % 4
    hub = F.concat(F.lit("https://github.com/"), "repo")
    u = F.when(k == 0, hub).when(k == 1, F.concat(hub, F.lit(".git"))).when(k == 2, F.concat(F.lit("git@host:"), "repo")).otherwise(F.col("path"))
    return table(spark, base, "files").withColumn("u", u).select("file_id", "repo", "u", P.parse_source_uri(F.col("u"))["kind"].alias("kind"))


@R.query("SELECT file_id, start_line, n FROM (SELECT file_id, 1 AS start_line, (SELECT count(*) FROM (SELECT unnest(list_slice(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]'), 2, len(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c]')))) AS x) WHERE trim(x, chr(32) || chr(9)) <> '' AND NOT prefix(trim(x, chr(32) || chr(9)), '#')) AS n FROM file_text)")
def fn_body_lines(spark, base):  # noqa: ANN001, ANN201
    return table(spark, base, "file_text").select("file_id", F.lit(1).alias("start_line"), F.size(T.body_lines(F.col("text"), F.lit(1), F.size(T.split_lines(F.col("text"))))).alias("n"))


@R.query("SELECT file_id, round(0.55 * churn + 0.3 * reach + 0.15 * fan_in - CASE WHEN private_module THEN 0.2 ELSE 0 END, 6)::double AS score FROM scored WHERE churn >= 0 AND reach >= 0 AND fan_in >= 0 AND lower(churn::varchar || reach::varchar || fan_in::varchar) NOT LIKE '%nan%' AND churn < 1e9 AND reach < 1e9 AND fan_in < 1e9")
def fn_reading_score(spark, base):  # noqa: ANN001, ANN201
    s = table(spark, base, "scored")
    for c in ("churn", "reach", "fan_in"):
        s = s.filter((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < 1e9))
    return s.select("file_id", F.round(S.reading_score(F.col("churn"), F.col("reach"), F.col("fan_in"), F.col("private_module")), 6).alias("score"))


@R.query("SELECT file_id, CASE WHEN raw_commits = 0 THEN 'No commits recorded' ELSE 'Changed in ' || raw_commits || CASE WHEN raw_commits = 1 THEN ' commit' ELSE ' commits' END END || '; ' || CASE WHEN fan_in = 0 THEN 'Not imported by other non-test files' ELSE 'Imported by ' || fan_in::int || ' non-test ' || CASE WHEN fan_in = 1 THEN 'file' ELSE 'files' END END || CASE WHEN reach >= 0.5 THEN '; Pulls in much of the codebase, directly or indirectly' ELSE '' END || CASE WHEN private_module THEN '; Private module, ranked lower' ELSE '' END AS reasons FROM scored WHERE raw_commits >= 0 AND fan_in BETWEEN 0 AND 1000000 AND reach BETWEEN 0 AND 1000000 AND private_module IS NOT NULL AND lower(reach::varchar || fan_in::varchar) NOT LIKE '%nan%'")
def fn_reasons(spark, base):  # noqa: ANN001, ANN201
    s = table(spark, base, "scored").filter("raw_commits >= 0 AND fan_in BETWEEN 0 AND 1000000 AND reach BETWEEN 0 AND 1000000 AND private_module IS NOT NULL")
    return s.select("file_id", F.array_join(S.reasons(F.col("raw_commits"), F.col("fan_in").cast("int"), F.col("reach"), F.col("private_module")), "; ").alias("reasons"))


@R.query("SELECT chunk_id, (sum(1) OVER (PARTITION BY repo, path ORDER BY chunk_id))::bigint AS n, (CASE WHEN before + length(body) <= 12000 THEN length(body) ELSE 12000 - before END)::bigint AS taken FROM (SELECT chunk_id, repo, path, body, coalesce(sum(length(body)) OVER (PARTITION BY repo, path ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks) WHERE before < 12000")
def fn_prompt_budget(spark, base):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    w = Window.partitionBy("repo", "path").orderBy("chunk_id")
    before = F.coalesce(F.sum(F.length("body")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = table(spark, base, "chunks").select("chunk_id", before.alias("before"), F.length("body").alias("l"), F.row_number().over(w).alias("n")).filter("before < 12000")
    return c.select("chunk_id", "n", F.when(F.col("before") + F.col("l") <= 12000, F.col("l")).otherwise(12000 - F.col("before")).alias("taken"))
