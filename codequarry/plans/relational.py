"""Queries of joins, aggregations, windows, top-k and findings over the repository tables and the order tables.

A path names a file only together with its repository, so ``fkey`` (repository, blank, path) is the item of one-graph
operators; order tables take part where a larger or denser relation shows the operator better.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.operators import cochange as C
from codequarry.operators import evaluate as E
from codequarry.operators import history as H
from codequarry.operators import overview as O
from codequarry.operators import ownership as W
from codequarry.operators import ranking as K
from codequarry.operators.prefix import global_rank
from codequarry.plans.registry import Registry
from codequarry.plans.rows import _AREA, _CODE
from codequarry.session import table

R = Registry()
_STAMP = "yyyy-MM-dd HH:mm:ss"
_stamp = lambda c: F.date_format(c, _STAMP)
_STAMP_SQL = "'%Y-%m-%d %H:%M:%S'"
_FKEY = "repo || ' ' || path"


def fkey() -> F.Column:
    return F.concat_ws(" ", "repo", "path")


def items(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "commit_files").dropna(subset=["path"]).select("commit_id", fkey().alias("item"))


def sizes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "commits").select("commit_id", "files_changed")


def commits(spark: SparkSession, base: str) -> DataFrame:
    return H.latest_delivery(table(spark, base, "commits"))


# rows delivered twice: the latest counts; equal deliveries are settled by the greatest row, nulls last
_COMMITS = "co AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC NULLS LAST, author_email DESC NULLS LAST, author_name DESC NULLS LAST, ts DESC NULLS LAST, n_parents DESC NULLS LAST, files_changed DESC NULLS LAST, seq DESC NULLS LAST) AS rn FROM commits) WHERE rn = 1)"
_ITEMS = f"it AS (SELECT DISTINCT commit_id AS g, {_FKEY} AS i FROM commit_files WHERE path IS NOT NULL AND commit_id IS NOT NULL)"
_SMALL = "sm AS (SELECT commit_id FROM commits GROUP BY 1 HAVING max(files_changed) <= 30 INTERSECT SELECT g FROM it GROUP BY 1 HAVING count(*) <= 30)"
_BASE = f"{_ITEMS}, {_SMALL}, d AS (SELECT it.* FROM it JOIN sm ON g = commit_id), c AS (SELECT i, count(*) AS c FROM d GROUP BY i)"
_PAIRS = f"WITH {_BASE}, e AS (SELECT d.* FROM d JOIN c USING (i) WHERE c >= 5), p AS (SELECT x.i AS a, y.i AS b, count(*) AS together FROM e x JOIN e y ON x.g = y.g AND x.i < y.i GROUP BY ALL HAVING count(*) >= 5), s AS (SELECT a, b, together, ca.c AS count_a, cb.c AS count_b, together / ((ca.c + cb.c) / 2.0::double) AS raw FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b)"


@R.query(_PAIRS + " SELECT a, b, together, count_a, count_b, floor(raw * 1000 + 0.5) / 1000.0::double AS degree FROM s WHERE raw >= 0.3 ORDER BY degree DESC, together DESC, a, b LIMIT 300")
def agg_cochange_files(spark, base):  # noqa: ANN001, ANN201
    return C.cochange(items(spark, base), group="commit_id", item="item", sizes=sizes(spark, base), size="files_changed")


@R.query(_PAIRS + " SELECT a, b, together, count_a, count_b, floor(raw * 1000 + 0.5) / 1000.0::double AS degree FROM s WHERE raw >= 0.3")
def join_cochange_self(spark, base):  # noqa: ANN001, ANN201
    return C.cochange(items(spark, base), group="commit_id", item="item", sizes=sizes(spark, base), size="files_changed", limit=None)


_LI = "WITH d AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem), sm AS (SELECT g FROM d GROUP BY g HAVING count(*) <= 6), k AS (SELECT d.* FROM d JOIN sm USING (g)), c AS (SELECT i, count(*) AS c FROM k GROUP BY i), e AS (SELECT k.* FROM k JOIN c USING (i) WHERE c >= 5), p AS (SELECT x.i AS a, y.i AS b, count(*) AS together FROM e x JOIN e y ON x.g = y.g AND x.i < y.i GROUP BY ALL HAVING count(*) >= 5), s AS (SELECT a, b, together, ca.c AS count_a, cb.c AS count_b, together / ((ca.c + cb.c) / 2.0::double) AS raw FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b WHERE together / ((ca.c + cb.c) / 2.0::double) >= 0.01)"


@R.query(_LI + " SELECT a, b, together, count_a, count_b, floor(raw * 1000 + 0.5) / 1000.0::double AS degree FROM s ORDER BY degree DESC, together DESC, a, b LIMIT 300")
def topk_file_pairs(spark, base):  # noqa: ANN001, ANN201
    return C.cochange(table(spark, base, "lineitem"), group="l_orderkey", item="l_suppkey", max_basket=6, min_degree=0.01)


_EDGE = _LI + ", n AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0)"


@R.query(_EDGE + " SELECT a, b, together, CASE WHEN na.s_suppkey IS NOT NULL AND nb.s_suppkey IS NOT NULL THEN na.s_nationkey = nb.s_nationkey END AS has_edge FROM s LEFT JOIN n na ON na.s_suppkey = a LEFT JOIN n nb ON nb.s_suppkey = b")
def join_import_edge_3vl(spark, base):  # noqa: ANN001, ANN201
    n = table(spark, base, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_nationkey")
    x = n.select(F.col("s_suppkey").alias("src"), "s_nationkey")
    e = x.join(n.select(F.col("s_suppkey").alias("dst"), "s_nationkey"), "s_nationkey").filter("src < dst").select("src", "dst")
    p = C.cochange(table(spark, base, "lineitem"), group="l_orderkey", item="l_suppkey", max_basket=6, min_degree=0.01, limit=None)
    return C.edge_flag(p.select("a", "b", "together"), n.select("s_suppkey"), e)


@R.query(_EDGE + " SELECT a, b, together FROM s JOIN n na ON na.s_suppkey = a JOIN n nb ON nb.s_suppkey = b WHERE na.s_nationkey <> nb.s_nationkey")
def ui_pair_filters(spark, base):  # noqa: ANN001, ANN201
    return join_import_edge_3vl(spark, base).filter(F.col("has_edge") == F.lit(False)).select("a", "b", "together")


_AR = f"WITH x AS (SELECT DISTINCT commit_id AS g, repo || ' ' || {_AREA} AS i FROM commit_files WHERE path IS NOT NULL), sm AS (SELECT g FROM x GROUP BY g HAVING count(*) <= 30), d AS (SELECT x.* FROM x JOIN sm USING (g)), c AS (SELECT i, count(*) AS c FROM d GROUP BY i), p AS (SELECT l.i AS a, r.i AS b, count(*) AS together FROM d l JOIN d r ON l.g = r.g AND l.i < r.i GROUP BY ALL HAVING count(*) >= 3) SELECT a, b, together, ca.c AS count_a, cb.c AS count_b, floor(together / ((ca.c + cb.c) / 2.0::double) * 1000 + 0.5) / 1000.0::double AS degree FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b"


def _areas(spark, base, limit):  # noqa: ANN001, ANN202
    cf = table(spark, base, "commit_files").dropna(subset=["path"]).select("commit_id", F.concat_ws(" ", "repo", P.area(F.col("path"))).alias("area"))
    return C.cochange_areas(cf, group="commit_id", area="area", limit=limit)


R.add("agg_cochange_areas", lambda s, b: _areas(s, b, None), _AR)
R.add("join_area_self", lambda s, b: _areas(s, b, None).select("a", "b", "together"), f"SELECT a, b, together FROM ({_AR})")
R.add("topk_area_pairs", lambda s, b: _areas(s, b, 50), _AR + " ORDER BY together DESC, a, b LIMIT 50")
R.add("fn_degree", lambda s, b: _areas(s, b, None).select("a", "b", "degree"), f"SELECT a, b, degree FROM ({_AR})")


@R.query(f"WITH {_BASE} SELECT g AS commit_id, count(*) AS files FROM d GROUP BY g")
def filter_large_commits(spark, base):  # noqa: ANN001, ANN201
    d = C.considered(items(spark, base), group="commit_id", item="item", max_basket=30, sizes=sizes(spark, base), size="files_changed")
    return d.groupBy(F.col("g").alias("commit_id")).agg(F.count(F.lit(1)).alias("files"))


@R.query(f"WITH {_COMMITS} SELECT repo, count_if(n_parents <= 1 AND files_changed > 30)::bigint AS skipped, count_if(n_parents <= 1)::bigint AS considered_or_skipped FROM co GROUP BY repo")
def agg_skipped_commits(spark, base):  # noqa: ANN001, ANN201
    c = commits(spark, base)
    return c.groupBy("repo").agg(F.count_if(F.expr("n_parents <= 1 AND files_changed > 30")).alias("skipped"), F.count_if(F.expr("n_parents <= 1")).alias("considered_or_skipped"))


@R.query(f"WITH {_COMMITS} SELECT commit_id, repo FROM co WHERE n_parents <= 1")
def filter_merge_commits(spark, base):  # noqa: ANN001, ANN201
    return commits(spark, base).filter("n_parents <= 1").select("commit_id", "repo")


_FH = f"WITH {_COMMITS}, d AS (SELECT DISTINCT commit_id, {_FKEY} AS path FROM commit_files WHERE path IS NOT NULL) SELECT path, count(*) AS commits, count(DISTINCT lower(author_email)) AS authors, strftime(min(ts), {_STAMP_SQL}) AS first_changed, strftime(max(ts), {_STAMP_SQL}) AS last_changed FROM d JOIN co USING (commit_id) WHERE coalesce(n_parents, 1) <= 1 GROUP BY path"


def _history(spark, base):  # noqa: ANN001, ANN202
    return H.file_history(items(spark, base).withColumnRenamed("item", "path"), commits(spark, base))


@R.query(_FH)
def agg_file_history(spark, base):  # noqa: ANN001, ANN201
    return _history(spark, base).select("path", "commits", "authors", _stamp("first_changed").alias("first_changed"), _stamp("last_changed").alias("last_changed"))


_AU = f"WITH {_COMMITS}, a AS (SELECT lower(author_email) AS email, count(*) AS commits, strftime(max(ts), {_STAMP_SQL}) AS last_commit_at, coalesce(array_to_string(list_sort(list(DISTINCT author_name) FILTER (author_name IS NOT NULL)), '|'), '') AS names FROM co WHERE author_email IS NOT NULL GROUP BY 1), n AS (SELECT email, name FROM (SELECT lower(author_email) AS email, author_name AS name, row_number() OVER (PARTITION BY lower(author_email) ORDER BY ts DESC NULLS LAST, seq, author_name DESC NULLS LAST) AS rn FROM co WHERE author_email IS NOT NULL) WHERE rn = 1) SELECT email, commits, last_commit_at, names FROM a"


@R.query(_AU)
def agg_authors(spark, base):  # noqa: ANN001, ANN201
    return H.authors(commits(spark, base)).select("email", "commits", _stamp("last_commit_at").alias("last_commit_at"), F.array_join("names", "|").alias("names"))


@R.query(f"WITH {_COMMITS}, j AS (SELECT DISTINCT f.repo, f.path, coalesce(p.id, lower(c.author_email)) AS person FROM commit_files f JOIN co c USING (commit_id) LEFT JOIN (SELECT id, coalesce(bot, false) AS bot, lower(unnest(emails)) AS m FROM people) p ON p.m = lower(c.author_email) WHERE f.path IS NOT NULL AND NOT coalesce(p.bot, false) AND c.author_email IS NOT NULL) SELECT repo, path, count(*) AS people FROM j GROUP BY ALL")
def join_author_count(spark, base):  # noqa: ANN001, ANN201
    j = table(spark, base, "commit_files").dropna(subset=["path"]).join(commits(spark, base).select("commit_id", "author_email").dropna(), "commit_id")
    return H.person_of(j, table(spark, base, "people"), F.col("author_email")).groupBy("repo", "path").agg(F.count_distinct("person").alias("people"))


@R.query(f"SELECT f.file_id, coalesce(h.n, 0) AS commits FROM files f LEFT JOIN (SELECT repo, path, count(DISTINCT commit_id) AS n FROM commit_files WHERE path IS NOT NULL GROUP BY ALL) h USING (repo, path)")
def join_commits_per_file(spark, base):  # noqa: ANN001, ANN201
    n = table(spark, base, "commit_files").dropna(subset=["path"]).distinct().groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, base, "files").join(n, ["repo", "path"], "left").select("file_id", F.coalesce("n", F.lit(0)).alias("commits"))


@R.query(f"SELECT f.file_id, f.language, f.lines, coalesce(length(t.text), -1) AS chars, coalesce(h.n, 0) AS commits, coalesce(s.n, 0) AS chunks FROM files f LEFT JOIN file_text t USING (file_id) LEFT JOIN (SELECT repo, path, count(DISTINCT commit_id) AS n FROM commit_files WHERE path IS NOT NULL GROUP BY ALL) h ON h.repo = f.repo AND h.path = f.path LEFT JOIN (SELECT repo, path, count(*) AS n FROM chunks GROUP BY ALL) s ON s.repo = f.repo AND s.path = f.path")
def join_file_enrich(spark, base):  # noqa: ANN001, ANN201
    n = table(spark, base, "commit_files").dropna(subset=["path"]).distinct().groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"))
    c = table(spark, base, "chunks").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("chunks"))
    t = table(spark, base, "file_text").select("file_id", F.length("text").alias("chars"))
    f = table(spark, base, "files").join(t, "file_id", "left").join(n, ["repo", "path"], "left").join(c, ["repo", "path"], "left")
    return f.select("file_id", "language", "lines", F.coalesce("chars", F.lit(-1)).alias("chars"), F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


@R.query("SELECT coalesce(a.e, b.e) AS email, coalesce(b.n, a.n) AS commits, b.n IS NOT NULL AS from_history FROM (SELECT lower(email) AS e, max(commits) AS n FROM identities WHERE email IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT lower(author_email) AS e, count(*) AS n FROM (SELECT DISTINCT commit_id, author_email FROM commits WHERE author_email IS NOT NULL) GROUP BY 1) b ON a.e = b.e")
def join_identity_merge(spark, base):  # noqa: ANN001, ANN201
    a = table(spark, base, "identities").dropna(subset=["email"]).groupBy(F.lower("email").alias("email")).agg(F.max("commits").alias("a"))
    b = table(spark, base, "commits").select("commit_id", "author_email").dropna().distinct().groupBy(F.lower("author_email").alias("email")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "email", "full").select("email", F.coalesce("b", "a").alias("commits"), F.col("b").isNotNull().alias("from_history"))


# ownership: a file is a part, an owner a supplier, lines are quantities
_OWN = "o AS (SELECT CAST(l_partkey AS varchar) AS path, l_suppkey AS owner, sum(l_quantity)::bigint AS lines FROM lineitem GROUP BY ALL)"
_RANK = "r AS (SELECT path, owner, lines, row_number() OVER w AS rn, sum(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(lines) OVER (PARTITION BY path) AS total FROM o WHERE lines > 0 WINDOW w AS (PARTITION BY path ORDER BY lines DESC, owner))"
_SEEN = "seen AS (SELECT l_suppkey AS owner, max(l_shipdate) AS seen_at FROM lineitem GROUP BY 1), lim AS (SELECT max(l_shipdate) - INTERVAL 365 DAY AS t FROM lineitem)"
_OWNERSHIP = f"WITH {_OWN}, {_RANK}, {_SEEN}, g AS (SELECT path, max(total)::bigint AS total, sum(CASE WHEN rn > 5 THEN lines ELSE 0 END)::bigint AS other_lines, count(*) AS owner_count, min(CASE WHEN 2 * cum >= total THEN rn END) AS bus_factor, max(CASE WHEN rn = 1 THEN r.owner END) AS top_owner, max(CASE WHEN rn = 1 THEN lines / total::double END) AS raw, max(CASE WHEN rn = 1 THEN seen_at END) AS seen_at FROM r LEFT JOIN seen USING (owner) GROUP BY path)"


def _owned(spark, base):  # noqa: ANN001, ANN202
    return table(spark, base, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("path"), F.col("l_suppkey").alias("owner")).agg(F.sum("l_quantity").cast("long").alias("lines"))


def _ownership(spark, base):  # noqa: ANN001, ANN202
    li = table(spark, base, "lineitem")
    seen = li.groupBy(F.col("l_suppkey").alias("owner")).agg(F.max("l_shipdate").alias("at"))
    as_of = li.agg(F.max("l_shipdate").cast("string")).first()[0]
    return W.ownership(_owned(spark, base), last_seen=seen, as_of=as_of)


@R.query(_OWNERSHIP + " SELECT path, total, other_lines, owner_count, bus_factor, top_owner, floor(raw * 1000 + 0.5) / 1000.0::double AS top_share FROM g")
def agg_ownership_file(spark, base):  # noqa: ANN001, ANN201
    return _ownership(spark, base).select("path", "total", "other_lines", "owner_count", "bus_factor", "top_owner", "top_share")


R.add("win_bus_factor", lambda s, b: _ownership(s, b).select("path", "bus_factor"), _OWNERSHIP + " SELECT path, bus_factor FROM g")
R.add("win_owner_flags", lambda s, b: _ownership(s, b).select("path", F.array_join("flags", ",").alias("flags")), _OWNERSHIP + " SELECT path, CASE WHEN total >= 100 AND bus_factor = 1 AND raw >= 0.8 THEN 'single-owner' || CASE WHEN seen_at < (SELECT t FROM lim) THEN ',orphaned' ELSE '' END ELSE '' END AS flags FROM g")
R.add("win_top_owner_active", lambda s, b: _ownership(s, b).select("path", "top_active"), _OWNERSHIP + " SELECT path, seen_at >= (SELECT t FROM lim) AS top_active FROM g")
R.add(
    "win_top_owners",
    lambda s, b: _ownership(s, b).select("path", F.explode("owners").alias("o")).select("path", F.col("o.rn").alias("rn"), F.col("o.owner").alias("owner"), F.col("o.lines").alias("lines"), F.col("o.share").alias("share")),
    f"WITH {_OWN}, {_RANK} SELECT path, rn, owner::varchar AS owner, lines, floor(lines / total::double * 1000 + 0.5) / 1000.0::double AS share FROM r WHERE rn <= 5",
)
R.add("agg_blame_lines", lambda s, b: _owned(s, b), f"WITH {_OWN} SELECT path, owner, lines FROM o")


@R.query("WITH o AS (SELECT p_type || '/' || p_brand || '/p' || p_partkey || '.py' AS path, s_nationkey AS owner, sum(l_quantity)::bigint AS lines FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL), u AS (SELECT '.' AS path, owner, lines FROM o UNION ALL SELECT string_split(path, '/')[1], owner, lines FROM o UNION ALL SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2], owner, lines FROM o), o2 AS (SELECT path, owner, sum(lines)::bigint AS lines FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, sum(lines) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(lines) OVER (PARTITION BY path) AS total FROM o2 WINDOW w AS (PARTITION BY path ORDER BY lines DESC, owner)) SELECT path, max(total)::bigint AS total, count(*) AS owner_count, min(CASE WHEN 2 * cum >= total THEN rn END) AS bus_factor, max(CASE WHEN rn = 1 THEN owner END) AS top_owner FROM r GROUP BY path")
def agg_ownership_dir(spark, base):  # noqa: ANN001, ANN201
    li = table(spark, base, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    j = li.join(table(spark, base, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, base, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = j.groupBy(F.concat(F.concat_ws("/", "p_type", "p_brand"), F.lit("/p"), "p_partkey", F.lit(".py")).alias("path"), F.col("s_nationkey").alias("owner")).agg(F.sum("l_quantity").cast("long").alias("lines"))
    return W.ownership(W.roll_up(o)).select("path", "total", "owner_count", "bus_factor", "top_owner")


@R.query("SELECT i.repo, p.id AS owner, sum(i.commits)::bigint AS lines FROM identities i JOIN (SELECT id, lower(unnest(emails)) AS m FROM people WHERE NOT coalesce(bot, false)) p ON lower(i.email) = p.m GROUP BY ALL")
def join_email_person(spark, base):  # noqa: ANN001, ANN201
    o = W.owned_lines(table(spark, base, "identities"), table(spark, base, "people"), path="repo", lines="commits")
    return o.select(F.col("path").alias("repo"), "owner", "lines")


# rankings
_HS = "WITH b AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS commits, sum(l_quantity)::bigint AS cx FROM lineitem GROUP BY 1), m AS (SELECT max(commits) AS mc, max(cx) AS mx FROM b), s AS (SELECT k, commits, cx, ln(1 + commits::double) / ln(1 + mc::double) * (ln(1 + cx::double) / ln(1 + mx::double)) AS raw FROM b, m)"


@R.query(_HS + " SELECT row_number() OVER (ORDER BY round(raw, 12) DESC, k) AS rank, k AS part, commits, cx AS complexity, floor(raw * 1000 + 0.5) / 1000.0::double AS score FROM s WHERE raw > 0 QUALIFY rank <= 50")
def win_hotspot_rank(spark, base):  # noqa: ANN001, ANN201
    b = table(spark, base, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_orderkey").alias("commits"), F.sum("l_quantity").cast("long").alias("complexity"))
    return K.hotspots(b, key="part", commits="commits", complexity="complexity")


R.add("topk_hotspots", lambda s, b: win_hotspot_rank(s, b).select("part", "rank"), _HS + " SELECT k AS part, row_number() OVER (ORDER BY round(raw, 12) DESC, k) AS rank FROM s WHERE raw > 0 QUALIFY rank <= 50")


@R.query(f"WITH h AS (SELECT repo, path, count(DISTINCT commit_id) AS commits FROM commit_files WHERE path IS NOT NULL GROUP BY ALL), c AS (SELECT file_id, {_FKEY.replace('repo', 'f.repo').replace('path', 'f.path')} AS k, commits, indent_complexity AS cx FROM files f JOIN h ON h.repo = f.repo AND h.path = f.path WHERE {_CODE} AND NOT is_test AND NOT is_binary AND generated_reason IS NULL AND skip_reason IS NULL AND commits > 0) SELECT file_id, commits, cx AS complexity FROM c")
def filter_hotspot_candidates(spark, base):  # noqa: ANN001, ANN201
    n = table(spark, base, "commit_files").dropna(subset=["path"]).distinct().groupBy("repo", "path").agg(F.count(F.lit(1)).alias("commits"))
    f = table(spark, base, "files").filter(P.is_code(F.lower("language")) & ~F.col("is_test") & ~F.col("is_binary") & F.col("generated_reason").isNull() & F.col("skip_reason").isNull())
    return f.join(n, ["repo", "path"]).filter("commits > 0").select("file_id", "commits", F.col("indent_complexity").alias("complexity"))


_RO = "WITH b AS (SELECT c_nationkey AS k, count(*) AS commits FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), f AS (SELECT s_nationkey AS k, count(*) AS fan_in FROM supplier GROUP BY 1), j AS (SELECT n_nationkey AS k, coalesce(commits, 0) AS commits, coalesce(fan_in, 0) AS fan_in, n_regionkey::double AS reach, n_nationkey % 7 = 0 AS priv FROM nation LEFT JOIN b ON b.k = n_nationkey LEFT JOIN f ON f.k = n_nationkey), m AS (SELECT max(commits) AS mc, max(reach) AS mr, max(fan_in) AS mf FROM j), s AS (SELECT k, ln(1 + commits::double) / ln(1 + mc::double) AS churn, reach / mr AS reach, CASE WHEN mf > 0 THEN ln(1 + fan_in::double) / ln(1 + mf::double) ELSE 0 END AS fan, priv FROM j, m), r AS (SELECT *, 0.55::double * churn + 0.3::double * reach + 0.15::double * fan - CASE WHEN priv THEN 0.2::double ELSE 0 END AS raw FROM s)"


def _reading(spark, base):  # noqa: ANN001, ANN202
    b = table(spark, base, "orders").join(table(spark, base, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("commits"))
    f = table(spark, base, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("fan_in"))
    j = table(spark, base, "nation").join(b, "n_nationkey", "left").join(f, "n_nationkey", "left").fillna(0, ["commits", "fan_in"])
    j = j.select("n_nationkey", "commits", "fan_in", F.col("n_regionkey").cast("double").alias("reach"), (F.col("n_nationkey") % 7 == 0).alias("priv"))
    return K.reading_order(j, key="n_nationkey", commits="commits", reach="reach", fan_in="fan_in", private="priv")


R.add("win_reading_rank", lambda s, b: _reading(s, b).select("n_nationkey", "rank", "score", "churn", "reach", "fan_in"), _RO + " SELECT k AS n_nationkey, row_number() OVER (ORDER BY raw DESC, k) AS rank, floor(raw * 1000 + 0.5) / 1000.0::double AS score, floor(churn * 1000 + 0.5) / 1000.0::double AS churn, floor(reach * 1000 + 0.5) / 1000.0::double AS reach, floor(fan * 1000 + 0.5) / 1000.0::double AS fan_in FROM r")


@R.query("SELECT l_partkey AS part, round(sum(l_quantity) / (SELECT max(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey)), 9) AS share FROM lineitem GROUP BY 1")
def win_norm_by_max(spark, base):  # noqa: ANN001, ANN201
    q = table(spark, base, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("q"))
    return q.select("part", F.round(F.col("q") / q.agg(F.max("q")).scalar(), 9).alias("share"))


# overview
_KNOWN = "language IS NOT NULL AND NOT coalesce(is_binary, false)"


@R.query(f"SELECT count(*) AS files, coalesce(sum(CASE WHEN {_CODE} AND NOT coalesce(is_binary, false) THEN lines END), 0)::bigint AS code_lines, floor(count_if({_CODE} AND NOT coalesce(is_binary, false) AND is_test) / count_if({_CODE} AND NOT coalesce(is_binary, false))::double * 1000 + 0.5) / 1000.0::double AS test_file_ratio, (SELECT count_if(NOT coalesce(bot, false))::bigint FROM people) AS contributors, (SELECT count(DISTINCT commit_id) FROM commits) AS commits FROM files")
def agg_overview(spark, base):  # noqa: ANN001, ANN201
    return O.overview(table(spark, base, "files"), table(spark, base, "commits"), table(spark, base, "people")).drop("first_commit_at", "last_commit_at")


_LANGS = f"SELECT lower(language) AS language, count(*) AS files, sum(lines)::bigint AS lines FROM files WHERE {_KNOWN} GROUP BY 1"
R.add("sort_languages", lambda s, b: O.languages(table(s, b, "files")), _LANGS + " ORDER BY lines DESC, language")
R.add("ui_top_languages", lambda s, b: O.top_languages(O.languages(table(s, b, "files")), 3), f"SELECT CASE WHEN rn <= 3 THEN language ELSE 'other' END AS language, sum(files)::bigint AS files, sum(lines)::bigint AS lines FROM (SELECT *, row_number() OVER (ORDER BY lines DESC, language) AS rn FROM ({_LANGS})) GROUP BY 1")
R.add("agg_components", lambda s, b: O.component_table(table(s, b, "files").withColumn("path", F.concat_ws("/", "repo", "path"))), "SELECT CASE WHEN contains(path, '/') THEN repo || '/' || regexp_replace(path, '/[^/]*$', '') ELSE repo END AS component, count(*) AS files, sum(lines)::bigint AS lines FROM files GROUP BY 1")
R.add("agg_limits", lambda s, b: O.limits(table(s, b, "files"), table(s, b, "parse_errors")), "SELECT path, skip_reason AS reason FROM files WHERE skip_reason IS NOT NULL UNION SELECT regexp_replace(path, '^\\./', ''), 'parse error' FROM parse_errors")
R.add("union_skipped", lambda s, b: O.limits(table(s, b, "files"), table(s, b, "parse_errors")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "SELECT reason, count(*) AS n FROM (SELECT path, skip_reason AS reason FROM files WHERE skip_reason IS NOT NULL UNION SELECT regexp_replace(path, '^\\./', ''), 'parse error' FROM parse_errors) GROUP BY 1")

_BL = f"WITH h AS (SELECT {_FKEY} AS path, count(DISTINCT commit_id) AS n FROM commit_files WHERE path IS NOT NULL GROUP BY 1), j AS (SELECT {_FKEY.replace('path', 'f.path')} AS path, coalesce(n, 0) AS commits FROM files f LEFT JOIN h ON h.path = f.repo || ' ' || f.path WHERE {_CODE} AND NOT is_binary AND skip_reason IS NULL AND generated_reason IS NULL)"


def _blame_candidates(spark, base):  # noqa: ANN001, ANN202
    n = items(spark, base).distinct().groupBy(F.col("item").alias("path")).agg(F.count(F.lit(1)).alias("commits"))
    return O.blame_candidates(table(spark, base, "files").withColumn("path", fkey()), n, 100)


R.add("topk_blame_files", lambda s, b: _blame_candidates(s, b).filter("chosen").select("path", "commits"), _BL + " SELECT path, commits FROM j ORDER BY commits DESC, path LIMIT 100")
R.add("except_candidates", lambda s, b: _blame_candidates(s, b).filter("NOT chosen").select("path", "commits"), _BL + " SELECT path, commits FROM j EXCEPT (SELECT path, commits FROM j ORDER BY commits DESC, path LIMIT 100)")


@R.query(f"SELECT area, file_id, lines, rn FROM (SELECT repo || ' ' || {_AREA} AS area, file_id, lines, row_number() OVER (PARTITION BY repo || ' ' || {_AREA} ORDER BY lines DESC, path) AS rn FROM files WHERE NOT is_test) WHERE rn <= 5")
def topk_area_largest(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").filter("NOT is_test").select(F.concat_ws(" ", "repo", P.area(F.col("path"))).alias("area"), "file_id", "path", "lines")
    w = Window.partitionBy("area").orderBy(F.desc("lines"), "path")
    return f.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("area", "file_id", "lines", "rn")


@R.query(f"SELECT area, lines FROM (SELECT repo || ' ' || {_AREA} AS area, sum(lines)::bigint AS lines FROM files WHERE NOT is_test AND {_CODE} AND generated_reason IS NULL AND lower(language) NOT IN ('css', 'html') GROUP BY 1) WHERE lines >= 300")
def agg_area_lines(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").filter(P.is_code(F.lower("language")) & F.col("generated_reason").isNull() & ~F.lower("language").isin("css", "html") & ~F.col("is_test"))
    return f.groupBy(F.concat_ws(" ", "repo", P.area(F.col("path"))).alias("area")).agg(F.sum("lines").alias("lines")).filter("lines >= 300")


@R.query(f"WITH t AS (SELECT DISTINCT repo || ' ' || {_AREA} AS area FROM files WHERE is_test), c AS (SELECT repo || ' ' || {_AREA} AS area, sum(lines)::bigint AS lines FROM files WHERE NOT is_test AND {_CODE} AND generated_reason IS NULL AND lower(language) NOT IN ('css', 'html') GROUP BY 1) SELECT area, lines FROM c WHERE lines >= 300 AND area NOT IN (SELECT area FROM t)")
def anti_untested_area(spark, base):  # noqa: ANN001, ANN201
    t = table(spark, base, "files").filter("is_test").select(F.concat_ws(" ", "repo", P.area(F.col("path"))).alias("area")).distinct()
    return agg_area_lines(spark, base).join(t, "area", "left_anti")


_STEMS = f"regexp_replace(lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '(.)\\..*$', '\\1'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[0-9]+$', '')"


@R.query(f"SELECT stem, count(*) AS files, count(DISTINCT area) AS areas FROM (SELECT repo || ' ' || {_AREA} AS area, {_STEMS} AS stem FROM files) WHERE length(stem) >= 3 GROUP BY stem HAVING count(*) >= 3 AND count(DISTINCT area) >= 2")
def agg_name_stems(spark, base):  # noqa: ANN001, ANN201
    name = F.regexp_replace(P.base_name(F.col("path")), r"(.)\..*$", "$1")
    stem = F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[0-9]+$", "")
    f = table(spark, base, "files").select(F.concat_ws(" ", "repo", P.area(F.col("path"))).alias("area"), stem.alias("stem")).filter(F.length("stem") >= 3)
    return f.groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("area").alias("areas")).filter("files >= 3 AND areas >= 2")


@R.query("SELECT generated_reason AS reason, count(*) AS n, (SELECT array_to_string(list_slice(list_sort(list(f2.repo || ' ' || f2.path)), 1, 10), '|') FROM files f2 WHERE f2.generated_reason = f.generated_reason) AS sample FROM files f WHERE generated_reason IS NOT NULL GROUP BY 1")
def agg_generated_by_reason(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").filter("generated_reason is not null").select(F.col("generated_reason").alias("reason"), fkey().alias("p"))
    w = Window.partitionBy("reason").orderBy("p")
    top = f.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("reason").agg(F.array_join(F.sort_array(F.collect_list("p")), "|").alias("sample"))
    return f.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(top, "reason")


# newcomers, evaluation
_NEW = f"WITH {_COMMITS}, d AS (SELECT DISTINCT commit_id, {_FKEY} AS path FROM commit_files WHERE path IS NOT NULL), ok AS (SELECT commit_id FROM d GROUP BY 1 HAVING count(*) BETWEEN 1 AND 20), f AS (SELECT author_email, commit_id, row_number() OVER (PARTITION BY author_email ORDER BY seq DESC, commit_id DESC) AS rn FROM co JOIN ok USING (commit_id) WHERE author_email IS NOT NULL)"


@R.query(_NEW + " SELECT path, count(*) AS newcomers FROM f JOIN d USING (commit_id) WHERE rn = 1 GROUP BY path")
def agg_newcomer_files(spark, base):  # noqa: ANN001, ANN201
    return H.newcomer_items(commits(spark, base), items(spark, base).withColumnRenamed("item", "path"))


@R.query(_NEW + " SELECT author_email, commit_id FROM f WHERE rn = 1")
def win_first_commit(spark, base):  # noqa: ANN001, ANN201
    d = items(spark, base).distinct().groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter("n BETWEEN 1 AND 20").select("commit_id")
    c = commits(spark, base).join(d, "commit_id", "left_semi").filter("author_email is not null")
    return c.groupBy("author_email").agg(F.max_by("commit_id", F.struct("seq", "commit_id")).alias("commit_id"))


def _parts(spark, base):  # noqa: ANN001, ANN202
    o = table(spark, base, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, base, "part").join(o, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("item"), F.col("p_size").alias("lines"), F.coalesce("n", F.lit(0)).alias("commits"), F.col("p_retailprice").alias("price"))


_PART = "pp AS (SELECT p_brand AS repo, p_partkey AS item, p_size AS lines, coalesce(n, 0) AS commits, p_retailprice AS price FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"
_BASEL = "rk AS (SELECT 'size' AS ranking, repo, item, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, item) AS rank FROM pp UNION ALL SELECT 'commits', repo, item, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, item) FROM pp UNION ALL SELECT 'fan-in', repo, item, row_number() OVER (PARTITION BY repo ORDER BY price DESC, item) FROM pp UNION ALL SELECT 'random', repo, item, row_number() OVER (PARTITION BY repo ORDER BY ('0x' || substr(md5('42:' || item), 1, 13))::bigint, item) FROM pp)"


def _baselines(spark, base):  # noqa: ANN001, ANN202
    return E.baselines(_parts(spark, base), by=["repo"], item="item", lines="lines", fan_in="price", commits="commits")


def _truth(spark, base):  # noqa: ANN001, ANN202
    return _parts(spark, base).filter("lines > 45").select("repo", "item")


_T = "t AS (SELECT repo, item FROM pp WHERE lines > 45)"
R.add("sort_baselines", _baselines, f"WITH {_PART}, {_BASEL} SELECT ranking, repo, item, rank FROM rk")
_MP = f"WITH {_PART}, {_BASEL}, {_T}, n AS (SELECT repo, count(*) AS n FROM pp GROUP BY 1) SELECT ranking, rk.repo, floor((1 - sum(CASE WHEN t.item IS NOT NULL AND n >= 2 THEN rank - 1 END)::double / (count_if(t.item IS NOT NULL AND n >= 2) * (max(n) - 1))::double) * 1000 + 0.5) / 1000.0::double AS percentile FROM rk JOIN n USING (repo) LEFT JOIN t ON t.repo = rk.repo AND t.item = rk.item GROUP BY ALL"
R.add("agg_mean_percentile", lambda s, b: E.mean_percentile(_baselines(s, b), _truth(s, b), by=["ranking", "repo"], item="item"), _MP)
R.add("agg_hits_at_k", lambda s, b: E.hits_at_k(_baselines(s, b), _truth(s, b), by=["ranking", "repo"], item="item"), f"WITH {_PART}, {_BASEL}, {_T} SELECT ranking, rk.repo, count_if(rank <= 10 AND t.item IS NOT NULL)::bigint AS hits FROM rk LEFT JOIN t ON t.repo = rk.repo AND t.item = rk.item GROUP BY ALL")
R.add("agg_median", lambda s, b: E.mean_percentile(_baselines(s, b), _truth(s, b), by=["ranking", "repo"], item="item").groupBy("ranking").agg(F.median("percentile").alias("median")), f"SELECT ranking, median(percentile) AS median FROM ({_MP}) GROUP BY 1")
R.add("intersect_truth", lambda s, b: _baselines(s, b).filter("rank <= 10").join(_truth(s, b), ["repo", "item"], "left_semi").select("ranking", "repo", "item"), f"WITH {_PART}, {_BASEL}, {_T} SELECT ranking, repo, item FROM rk WHERE rank <= 10 AND (repo, item) IN (SELECT (repo, item) FROM t)")


def _grid(spark, base):  # noqa: ANN001, ANN202
    p = _parts(spark, base).withColumn("zero", F.lit(0.0)).withColumn("private", F.col("item") % 9 == 0)
    f = E.feature_matrix(p, by="repo", item="item", centrality="price", reverse="zero", fan_in="commits", churn="commits", lines="lines", private="private")
    return E.grid_search(f, _truth(spark, base), E.variants(spark), by="repo", item="item", limit=None)


_VAR = "v(variant, ce, re, fi, ch, si, pe) AS (VALUES {rows})"


def _grid_sql() -> str:
    import itertools

    out = {k: tuple(map(float, v)) for k, v in E.NAMED.items()}
    steps = (0, 0.25, 0.5, 0.75, 1)
    for c, r, f, ch, s in itertools.product(steps, (0, 0.25, 0.5), steps, steps, steps):
        z = c + r + f + ch + s
        if z:
            for p in (0, 0.2):
                w = (c / z, r / z, f / z, ch / z, s / z)
                out.setdefault("c{:.2f} r{:.2f} f{:.2f} ch{:.2f} s{:.2f} p{:.1f}".format(*w, p), (*w, float(p)))
    rows = ", ".join(f"('{k}', " + ", ".join(f"{x!r}::double" for x in v) + ")" for k, v in out.items())
    return (
        f"WITH {_PART}, {_T}, {_VAR.format(rows=rows)}, m AS (SELECT repo, max(price) AS mp, max(commits) AS mc, max(lines) AS ml, count(*) AS n FROM pp GROUP BY 1), "
        "f AS (SELECT repo, item, n, CASE WHEN mp > 0 THEN price / mp ELSE 0 END AS c, CASE WHEN mc > 0 THEN ln(1 + commits::double) / ln(1 + mc::double) ELSE 0 END AS h, CASE WHEN ml > 0 THEN ln(1 + lines::double) / ln(1 + ml::double) ELSE 0 END AS l, item % 9 = 0 AS priv FROM pp JOIN m USING (repo)), "
        "r AS (SELECT variant, repo, item, n, row_number() OVER (PARTITION BY variant, repo ORDER BY round(c * ce + h * fi + h * ch + l * si - CASE WHEN priv THEN pe ELSE 0 END, 9) DESC, item) AS rank FROM f, v), "
        "p AS (SELECT variant, r.repo, floor((1 - sum(CASE WHEN t.item IS NOT NULL AND n >= 2 THEN rank - 1 END)::double / (count_if(t.item IS NOT NULL AND n >= 2) * (max(n) - 1))::double) * 1000 + 0.5) / 1000.0::double AS pc FROM r LEFT JOIN t ON t.repo = r.repo AND t.item = r.item GROUP BY ALL) "
        "SELECT variant, floor(avg(round(pc * 1000)::bigint) + 0.5) / 1000.0::double AS score FROM p WHERE pc IS NOT NULL GROUP BY 1"
    )


R.add("eval_grid", _grid, _grid_sql())
R.add("agg_variant_score", lambda s, b: _grid(s, b).filter(F.col("variant").isin(list(E.NAMED))), f"SELECT * FROM ({_grid_sql()}) WHERE variant IN ({', '.join(repr(k) for k in E.NAMED)})")
R.add("topk_variants", lambda s, b: _grid(s, b).orderBy(F.desc("score"), "variant").limit(12), f"SELECT * FROM ({_grid_sql()}) ORDER BY score DESC, variant LIMIT 12")
R.add("eval_variant_rank", lambda s, b: _grid(s, b).select("variant"), f"SELECT variant FROM ({_grid_sql()})")


@R.query(f"WITH {_PART}, m AS (SELECT repo, max(price) AS mp, max(commits) AS mc, max(lines) AS ml FROM pp GROUP BY 1) SELECT repo, item, round(CASE WHEN mp > 0 THEN price / mp ELSE 0 END, 9) AS centrality, round(CASE WHEN mc > 0 THEN ln(1 + commits::double) / ln(1 + mc::double) ELSE 0 END, 9) AS churn, round(ln(1 + lines::double) / ln(1 + ml::double), 9) AS size FROM pp JOIN m USING (repo)")
def eval_feature_matrix(spark, base):  # noqa: ANN001, ANN201
    p = _parts(spark, base).withColumn("zero", F.lit(0.0)).withColumn("private", F.lit(False))
    f = E.feature_matrix(p, by="repo", item="item", centrality="price", reverse="zero", fan_in="commits", churn="commits", lines="lines", private="private")
    return f.select("repo", "item", F.round("centrality", 9).alias("centrality"), F.round("churn", 9).alias("churn"), F.round("size", 9).alias("size"))


@R.query("SELECT DISTINCT p_brand AS repo, (dense_rank() OVER (ORDER BY p_brand) - 1) % 2 = 0 AS training FROM part")
def eval_split(spark, base):  # noqa: ANN001, ANN201
    return E.split_half(table(spark, base, "part").select(F.col("p_brand").alias("repo")).distinct(), "repo")


@R.query(f"SELECT DISTINCT d, handles FROM (SELECT repo || '/' || regexp_replace(path, '/[^/]*$', '') AS d, CASE WHEN prefix(path, 'src/ui/') THEN 'ui' WHEN prefix(path, 'src/') THEN 'src' ELSE 'all' END AS handles FROM files WHERE contains(path, '/'))")
def join_longest_prefix(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").filter(F.instr("path", "/") > 0).select("repo", P.dir_name(F.col("path")).alias("path")).distinct()
    owners = spark.createDataFrame([(".", ["all"]), ("src", ["src"]), ("src/ui", ["ui"])], "dir string, handles array<string>")
    o = E.owners_of(f.select("path").distinct(), owners)
    return f.join(o, "path").select(F.concat_ws("/", "repo", "path").alias("d"), F.col("handles")[0].alias("handles"))


_DOTF = "replace(regexp_replace(path, '(/__init__)?\\.pyi?$', ''), '/', '.')"


@R.query(f"WITH f AS (SELECT DISTINCT path FROM files WHERE suffix(path, '.py')), s AS (SELECT path, array_to_string(list_slice(p, i, len(p)), '.') AS suffix FROM (SELECT path, string_split({_DOTF}, '.') AS p, unnest(range(1, greatest(len(string_split({_DOTF}, '.')), 1))) AS i FROM f)) SELECT suffix, min(path) AS path FROM s GROUP BY suffix HAVING count(*) = 1")
def join_suffix_unique(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").filter(F.col("path").endswith(".py")).select("path").distinct()
    return f.select("path", F.explode(P.dotted_suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select("suffix", "path")


@R.query(f"SELECT component, min(path) AS path FROM (SELECT repo || '/' || CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS component, path, row_number() OVER (PARTITION BY repo, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END ORDER BY lines DESC, path) AS rn FROM files) WHERE rn = 1 GROUP BY 1")
def win_top_file_per_dir(spark, base):  # noqa: ANN001, ANN201
    f = table(spark, base, "files").select(F.concat_ws("/", "repo", P.component_of(F.col("path"))).alias("component"), "path", "lines")
    return f.groupBy("component").agg(F.min_by("path", F.struct(-F.col("lines"), F.col("path"))).alias("path"))


# people: rows with one email, or one full name, are one person; named by the first email
_FULL = "trim(regexp_replace(nfc_normalize(lower(n)), '\\s+', ' ', 'g'))"
_PERSON = (
    "WITH RECURSIVE b AS (SELECT lower(email) AS email, coalesce(commits, 0) AS commits, list_concat(coalesce(names, []), CASE WHEN name IS NOT NULL THEN [name] ELSE [] END) AS ns FROM identities WHERE email IS NOT NULL), "
    f"fu AS (SELECT DISTINCT email, {_FULL} AS f FROM (SELECT email, unnest(ns) AS n FROM b) WHERE contains({_FULL}, ' ')), e AS (SELECT DISTINCT x.email AS a, y.email AS b FROM fu x JOIN fu y USING (f)), "
    "r(n, m) AS (SELECT email, email FROM b UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), c AS (SELECT n, min(m) AS c FROM r GROUP BY 1)"
)


@R.query(_PERSON + " SELECT c AS first_email, count(DISTINCT email) AS emails, sum(commits)::bigint AS commits FROM b JOIN c ON n = email GROUP BY 1")
def agg_people(spark, base):  # noqa: ANN001, ANN201
    p = H.resolve_people(table(spark, base, "identities"))
    return p.select(F.col("emails")[0].alias("first_email"), F.size("emails").alias("emails"), "commits")


@R.query("SELECT row_number() OVER (ORDER BY commits DESC, coalesce(name, ''), emails[1]) AS position, id, commits FROM people")
def sort_people(spark, base):  # noqa: ANN001, ANN201
    p = table(spark, base, "people")
    # as in SQL a person without emails comes last among equals; id makes the order total
    return global_rank(p, [F.desc("commits"), F.coalesce("name", F.lit("")), F.get("emails", F.lit(0)).asc_nulls_last(), "id"], "position").select("position", "id", "commits")


@R.query(_PERSON + " SELECT n AS email, c AS component FROM c")
def graph_components(spark, base):  # noqa: ANN001, ANN201
    p = H.resolve_people(table(spark, base, "identities"))
    return p.select(F.explode("emails").alias("email"), F.col("emails")[0].alias("component"))


@R.query(f"SELECT count(DISTINCT repo || ' ' || path) AS files, count(DISTINCT commit_id) AS commits, (SELECT count(*) FROM (SELECT DISTINCT commit_id FROM commits LIMIT 1000)) AS capped FROM commit_files WHERE path IS NOT NULL")
def scan_commit_count(spark, base):  # noqa: ANN001, ANN201
    c = items(spark, base).agg(F.count_distinct("item").alias("files"), F.count_distinct("commit_id").alias("commits"))
    return c.withColumn("capped", table(spark, base, "commits").select("commit_id").distinct().limit(1000).agg(F.count(F.lit(1))).scalar())
