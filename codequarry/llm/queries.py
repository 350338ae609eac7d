"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import cooccurrence, mixing, names, packing, parsing, provenance, ranking, spans, splitting, subjects, tokens
from codequarry.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _together(spark: SparkSession, base: str) -> DataFrame:
    return cooccurrence.together(table(spark, base, "commit_files"), scope="repo", basket="commit_id", item="path")


@query
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return _together(spark, base).select(F.col("scope").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


@query
def p1_lift(spark: SparkSession, base: str) -> DataFrame:
    return _together(spark, base).select(F.col("scope").alias("repo"), F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n", "n_a", "n_b", "together", F.round("lift", 6).alias("lift"))


_P1 = """
WITH d AS (SELECT DISTINCT repo, commit_id, path FROM commit_files WHERE repo IS NOT NULL AND commit_id IS NOT NULL AND path IS NOT NULL),
b AS (SELECT repo, commit_id FROM d GROUP BY ALL HAVING count(*) <= 30),
k AS (SELECT d.* FROM d JOIN b USING (repo, commit_id)),
n AS (SELECT repo, count(*) AS n FROM b GROUP BY repo),
s AS (SELECT repo, path, count(*) AS c FROM k GROUP BY ALL),
m AS (SELECT x.repo, x.path AS path_a, y.path AS path_b, count(*) AS together FROM k x JOIN k y ON x.repo = y.repo AND x.commit_id = y.commit_id AND x.path < y.path GROUP BY ALL HAVING count(*) >= 5)
SELECT {cols} FROM m JOIN n USING (repo) JOIN s sa ON sa.repo = m.repo AND sa.path = path_a JOIN s sb ON sb.repo = m.repo AND sb.path = path_b
WHERE together * n >= 3 * sa.c * sb.c"""
SQL["p1_found"] = _P1.format(cols="m.repo, path_a, path_b")
SQL["p1_lift"] = _P1.format(cols="m.repo, path_a, path_b, n, sa.c AS n_a, sb.c AS n_b, together, round(together * n / (sa.c * sb.c)::double, 6) AS lift")


@query
def p2_reading_order(spark: SparkSession, base: str) -> DataFrame:
    out = ranking.combined_ranking(
        table(spark, base, "scored"), scope="repo", key="path", scores={"churn": 0.35, "reach": 0.25, "fan_in": 0.2, "raw_commits": 0.2}, version="computed_at"
    )
    return out.select("repo", "path", F.round("combined", 5).alias("combined"), "position")


def _quantile(p: str) -> str:
    """The same rational approximation of the normal quantile in SQL."""
    poly = lambda cs, x, last=None: "(" + "(" * (len(cs) - 1) + f"{cs[0]!r}::double" + "".join(f" * {x} + {c!r}::double)" for c in cs[1:]) + (f" * {x} + {last!r}::double" if last else "") + ")"
    q, r = f"({p} - 0.5::double)", f"(({p} - 0.5::double) * ({p} - 0.5::double))"
    tail = lambda x: f"{poly(ranking.C, x)} / {poly(ranking.D, x, 1.0)}"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"CASE WHEN {p} < {ranking.LOW} THEN {tail(low)} WHEN {p} > {1 - ranking.LOW} THEN -({tail(high)}) ELSE {poly(ranking.A, r)} * {q} / {poly(ranking.B, r, 1.0)} END"


def _p2() -> str:
    w = {"churn": 0.35, "reach": 0.25, "fan_in": 0.2, "raw_commits": 0.2}
    newest = ", ".join(f"{c} DESC NULLS LAST" for c in ("computed_at", *w))
    clean = ", ".join(f"CASE WHEN lower({c}::varchar) NOT LIKE '%nan%' AND {c} >= 0 AND {c} < 'inf'::double THEN {c}::double END AS {c}" for c in w)
    usual = ", ".join(f"CASE WHEN {c} <= coalesce(1e6::double * (SELECT quantile_disc({c}, 0.5) FROM c0 WHERE {c} > 0), 0) THEN {c} END AS {c}" for c in w)
    rank = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY repo, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY repo, {c}) - 1) / 2.0::double - 0.5::double) / count({c}) OVER (PARTITION BY repo) END AS {c}_p" for c in w)
    comb = " + ".join(f"coalesce({_quantile(c + '_p')}, 0) * {x}::double" for c, x in w.items())
    return (
        f"WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY {newest}) AS rn FROM scored WHERE repo IS NOT NULL AND path IS NOT NULL) WHERE rn = 1), "
        f"c0 AS (SELECT repo, path, {clean} FROM n), c AS (SELECT repo, path, {usual} FROM c0), r AS (SELECT repo, path, {rank} FROM c), s AS (SELECT repo, path, round({comb}, 9) AS x FROM r) "
        "SELECT repo, path, round(x, 5) AS combined, row_number() OVER (PARTITION BY repo ORDER BY x DESC, path) AS position FROM s"
    )


SQL["p2_reading_order"] = _p2()


@query
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return p3_pieces(spark, base).filter("piece = 1").select("chunk_id")


@query
def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    out = splitting.split_oversized(table(spark, base, "chunks"), key="chunk_id", text="body", kind="kind", start_line="start_line", end_line="end_line", overlap_lines=3)
    return out.withColumnRenamed("item_id", "chunk_id")


SQL["p3_found"] = "SELECT chunk_id FROM chunks WHERE length(body) > 4000"


@query
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs, _, _ = spans.shared_spans(table(spark, base, "chunks"), key="chunk_id", text="body")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query
def p4_share(spark: SparkSession, base: str) -> DataFrame:
    _, coverage, _ = spans.shared_spans(table(spark, base, "chunks"), key="chunk_id", text="body")
    return coverage.select(F.col("id").alias("chunk_id"), "n_chars", "shared_chars", F.round("share", 6).alias("share"))


# every run of 200 characters of every body, compared as it is
_P4 = "m AS (SELECT chunk_id, i, md5(substr(body, i, 200)) AS h FROM (SELECT chunk_id, body, unnest(range(1, length(body) - 198)) AS i FROM chunks WHERE length(body) >= 200)), g AS (SELECT DISTINCT chunk_id, h FROM m), sh AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1)"
SQL["p4_found"] = f"WITH {_P4}, k AS (SELECT g.* FROM g JOIN sh USING (h)) SELECT DISTINCT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM k a JOIN k b ON a.h = b.h AND a.chunk_id < b.chunk_id"
SQL["p4_share"] = f"""WITH {_P4}, p AS (SELECT DISTINCT chunk_id, i FROM m JOIN sh USING (h)), w AS (SELECT chunk_id, i - lag(i) OVER (PARTITION BY chunk_id ORDER BY i) AS gap FROM p),
s AS (SELECT chunk_id, sum(least(200, coalesce(gap, 200))) AS shared FROM w GROUP BY 1)
SELECT c.chunk_id, length(body) AS n_chars, coalesce(shared, 0)::bigint AS shared_chars, round(CASE WHEN length(body) > 0 THEN coalesce(shared, 0) / length(body)::double ELSE 0 END, 6) AS share FROM chunks c LEFT JOIN s USING (chunk_id) WHERE body IS NOT NULL"""


def _parsed(spark: SparkSession, base: str) -> DataFrame:
    return parsing.parse_files(table(spark, base, "file_text"), key="file_id", repo="repo", path="path", text="text")


@query
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return _parsed(spark, base).filter(~F.col("parses")).select("file_id")


@query
def p6_files(spark: SparkSession, base: str) -> DataFrame:
    return _parsed(spark, base)


@query
def p6_rates(spark: SparkSession, base: str) -> DataFrame:
    return parsing.parse_rates(_parsed(spark, base), repo="repo")


def _subjects(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, base, "documents")
    names = [r["subject"] for r in table(spark, base, "subjects").orderBy("n", "subject").select("subject").distinct().collect()]
    model = subjects.train(docs, table(spark, base, "doc_labels"), sorted(names), doc="doc_id", text="text", source="source", subject="subject", lang="lang")
    return docs, subjects.assign(docs, model, doc="doc_id", text="text", source="source")


@query
def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return _subjects(spark, base)[1]


@query
def p10_composition(spark: SparkSession, base: str) -> DataFrame:
    docs, out = _subjects(spark, base)
    return subjects.composition(out, docs, doc="doc_id")


def _entities(spark: SparkSession, base: str) -> DataFrame:
    return names.link_names(table(spark, base, "identities"), key="identity_id", name="name", names="names", email="email", known=table(spark, base, "people"))


@query
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return names.pairs_within(_entities(spark, base), key="identity_id", entity="entity")


@query
def p5_entities(spark: SparkSession, base: str) -> DataFrame:
    return _entities(spark, base)


def _provenance(spark: SparkSession, base: str) -> DataFrame:
    return provenance.label_files(table(spark, base, "files"), table(spark, base, "file_text"), table(spark, base, "chunks"))


@query
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _provenance(spark, base).filter(~F.col("handwritten")).select("file_id")


@query
def p7_labels(spark: SparkSession, base: str) -> DataFrame:
    return _provenance(spark, base)


def _sizes(spark: SparkSession, base: str) -> DataFrame:
    return tokens.count_tokens(table(spark, base, "documents"), key="doc_id", text="text", keep=("source",))


@query
def p8_packed(spark: SparkSession, base: str) -> DataFrame:
    return packing.fill_containers(_sizes(spark, base), key="doc_id", size="n_tokens")


@query
def p8_usage(spark: SparkSession, base: str) -> DataFrame:
    return packing.usage(p8_packed(spark, base))


@query
def p9_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_sources(_sizes(spark, base), table(spark, base, "mix_targets"), key="doc_id", source="source", size="n_tokens")[0]


@query
def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mix_sources(_sizes(spark, base), table(spark, base, "mix_targets"), key="doc_id", source="source", size="n_tokens")[1]
