"""Facts from commit history: per file, per author, people, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import is_bot, normalize_name
from codequarry.operators.graph import components
from codequarry.operators.prefix import global_rank
from codequarry.session import cut


def latest_delivery(commits: DataFrame, key: str = "commit_id", by: str = "ingested_at") -> DataFrame:
    """One row per key, that of the latest delivery; the struct comparison settles ties, so it is repeatable."""
    rest = [c for c in commits.columns if c not in (key, by)]
    return commits.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("r")).select(key, "r.*").select(*commits.columns)


def file_history(commit_files: DataFrame, commits: DataFrame, *, merges: bool = False) -> DataFrame:
    """(path, commits, authors, first_changed, last_changed) over non-merge commits; null paths are dropped."""
    c = commits if merges else commits.filter(F.coalesce(F.col("n_parents"), F.lit(1)) <= 1)
    d = commit_files.select("commit_id", "path").dropna().distinct()
    j = d.join(c.select("commit_id", F.lower("author_email").alias("e"), "ts"), "commit_id")
    return j.groupBy("path").agg(
        F.count(F.lit(1)).alias("commits"), F.count_distinct("e").alias("authors"), F.min("ts").alias("first_changed"), F.max("ts").alias("last_changed")
    )


def authors(commits: DataFrame) -> DataFrame:
    """(email, name, names, commits, last_commit_at): merges count; the name is that of the latest commit, the first
    seen (smallest seq) on ties. Rows without an email are dropped."""
    c = commits.filter(F.col("author_email").isNotNull())
    return c.groupBy(F.lower("author_email").alias("email")).agg(
        F.max_by("author_name", F.struct(F.col("ts"), -F.col("seq"))).alias("name"),
        F.sort_array(F.collect_set("author_name")).alias("names"),
        F.count(F.lit(1)).alias("commits"),
        F.max("ts").alias("last_commit_at"),
    )


def parse_mailmap(lines: DataFrame, line: str = "value", ord_col: str = "ord") -> DataFrame:
    """(ord, proper_name, proper_email, commit_name, commit_email) of the four line forms; others are ignored."""
    rx = r"^\s*([^<#]*?)\s*<([^>]*)>\s*(?:([^<#]*?)\s*<([^>]*)>)?\s*(?:#.*)?$"
    g = lambda i: F.regexp_extract(F.col(line), rx, i)
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    ok = F.col(line).rlike(rx) & ~F.trim(F.col(line)).startswith("#")
    two = g(4) != ""
    return lines.filter(ok).select(
        F.col(ord_col).alias("ord"), none(g(1)).alias("proper_name"), F.when(two, none(F.lower(F.trim(g(2))))).alias("proper_email"),
        F.when(two, none(g(3))).alias("commit_name"), F.when(two, F.lower(F.trim(g(4)))).otherwise(F.lower(F.trim(g(2)))).alias("commit_email"),
    ).filter("proper_name is not null or proper_email is not null")


def apply_mailmap(identities: DataFrame, mailmap: DataFrame, name: str = "name", email: str = "email") -> DataFrame:
    """Adds mapped_name and mapped_email; an entry that names the commit name beats one for the email alone, the first
    entry wins. Identities keep all their columns."""
    i = identities.withColumn("__id", F.monotonically_increasing_id())
    m = mailmap.select("ord", "proper_name", "proper_email", "commit_name", "commit_email")
    j = i.join(m, (F.lower(F.col(email)) == F.col("commit_email")) & (F.col("commit_name").isNull() | (F.lower("commit_name") == F.lower(F.col(name)))), "left")
    best = F.min_by(F.struct("proper_name", "proper_email"), F.struct(F.col("commit_name").isNull().cast("int"), "ord"))
    g = j.groupBy("__id").agg(best.alias("b"))
    return i.join(g, "__id").select(*identities.columns, F.coalesce("b.proper_name", name).alias("mapped_name"), F.coalesce("b.proper_email", F.lower(F.col(email))).alias("mapped_email"))


def resolve_people(identities: DataFrame, mailmap: DataFrame | None = None) -> DataFrame:
    """(id, name, emails, names, bot, commits, last_commit_at): identities merged into people.

    Emails are the same in any case; a mail map sends one to another; a full name of two or more words joins. Edges are
    stars around the smallest email of a name, so a common name costs one edge per email. Ids a1, a2, ... follow commits
    descending, name, first email. ``identities``: email, name, names, commits, last_commit_at; null emails are dropped.
    """
    base = identities.filter(F.col("email").isNotNull()).select(
        F.lower("email").alias("email"), "name", F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>")))).alias("names"), F.coalesce("commits", F.lit(0)).alias("commits"), "last_commit_at",
    )
    spelled = base.select("email", F.explode_outer("names").alias("n"))
    if mailmap is not None:
        spelled = apply_mailmap(spelled, mailmap, "n", "email").select("email", F.col("mapped_name").alias("n"), "mapped_email")
        base = apply_mailmap(base, mailmap).withColumn("name", F.coalesce("mapped_name", "name")).drop("mapped_name", "mapped_email")
    else:
        spelled = spelled.withColumn("mapped_email", F.col("email"))
    spelled = spelled.withColumn("full", normalize_name("n"))
    full = spelled.filter(F.instr("full", " ") > 0).select("full", "email").distinct()
    by_name = full.join(full.groupBy("full").agg(F.min("email").alias("src")), "full").select("src", F.col("email").alias("dst"))
    edges = by_name.union(spelled.filter("mapped_email <> email").select(F.col("email").alias("src"), F.col("mapped_email").alias("dst"))).union(base.select(F.col("email").alias("src"), F.col("email").alias("dst")))
    comp = components(edges)
    per_mail = base.groupBy("email").agg(F.max_by("name", F.struct("last_commit_at", "name")).alias("name"), F.sum("commits").alias("commits"), F.max("last_commit_at").alias("last"))
    all_names = spelled.filter("n is not null").groupBy("email").agg(F.collect_set("n").alias("ns"))
    j = per_mail.join(all_names, "email", "left").join(comp, F.col("email") == F.col("node"))
    g = j.groupBy("component").agg(
        F.max_by("name", F.struct("last", F.col("email"))).alias("name"), F.sort_array(F.collect_set("email")).alias("emails"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("ns", F.array().cast("array<string>")))))).alias("names"), F.sum("commits").alias("commits"), F.max("last").alias("last_commit_at"),
    )
    bot = F.exists("names", lambda x: is_bot(x)) | F.exists("emails", lambda x: is_bot(x))
    ranked = global_rank(g, [F.desc("commits"), F.coalesce("name", F.lit("")), F.col("emails")[0]], "__rn")
    return ranked.select(F.concat(F.lit("a"), F.col("__rn")).alias("id"), "name", "emails", "names", bot.alias("bot"), "commits", "last_commit_at")


def rename_aliases(renames: DataFrame) -> DataFrame:
    """([repo,] old, cur, from_seq): what a path is called today and from which commit on (seq 0 is the newest).

    The newest rename of a path counts; where that leads goes on only with a still newer one. Chains are contracted by
    doubling, each repository by itself: O(log n) joins, no path comes to the driver."""
    scope = ["repo"] if "repo" in renames.columns else []
    first = renames.groupBy(*scope, F.col("old_path").alias("old")).agg(F.min(F.struct("seq", "ord", "new_path")).alias("e"))
    own = first.select(*scope, "old", F.col("e.seq").alias("seq"), F.col("e.ord").alias("ord"), F.col("e.new_path").alias("cur"))
    then = own.select(*scope, F.col("old").alias("cur"), F.struct("seq", "ord").alias("k2"))
    step = own.join(then, [*scope, "cur"], "left").select(*scope, "old", "seq", "cur", F.coalesce(F.col("k2") < F.struct("seq", "ord"), F.lit(False)).alias("more"))
    step = cut(step)
    while step.filter("more").limit(1).count():
        on = step.select(*scope, F.col("old").alias("cur"), F.col("cur").alias("c2"), F.col("more").alias("m2"))
        j = step.join(on, [*scope, "cur"], "left")
        step = cut(j.select(*scope, "old", "seq", F.when(F.col("more"), F.col("c2")).otherwise(F.col("cur")).alias("cur"), (F.col("more") & F.coalesce("m2", F.lit(False))).alias("more")))
    return step.select(*scope, "old", "cur", F.col("seq").alias("from_seq"))


def follow_renames(commit_files: DataFrame, commits: DataFrame, renames: DataFrame) -> DataFrame:
    """([repo,] commit_id, path) under today's paths: a file changed under an old name counts for the current one."""
    scope = ["repo"] if "repo" in renames.columns and "repo" in commit_files.columns else []
    alias = rename_aliases(renames).withColumnRenamed("old", "path")
    j = commit_files.select(*scope, "commit_id", "path").join(commits.select(*scope, "commit_id", "seq"), [*scope, "commit_id"]).join(alias, [*scope, "path"], "left")
    return j.select(*scope, "commit_id", F.when(F.col("seq") >= F.col("from_seq"), F.col("cur")).otherwise(F.col("path")).alias("path")).distinct()


def person_of(paths: DataFrame, people: DataFrame, email: Column) -> DataFrame:
    """Adds person: the id of the email's person, the email itself where unknown; bots are removed."""
    who = people.select("id", "bot", F.explode("emails").alias("m")).select(F.lower("m").alias("m"), "id", F.coalesce("bot", F.lit(False)).alias("bot"))
    j = paths.join(who, F.lower(email) == F.col("m"), "left")
    return j.filter(~F.coalesce("bot", F.lit(False))).withColumn("person", F.coalesce("id", F.lower(email))).drop("m", "id", "bot")


def newcomer_items(commits: DataFrame, commit_files: DataFrame, *, most: int = 20, rankable: DataFrame | None = None) -> DataFrame:
    """(path, newcomers): how many authors touched a file in their first commit of 1 to ``most`` current files.

    Authors are raw emails; the first commit has the largest seq. Order: newcomers descending, path."""
    d = commit_files.select("commit_id", "path").dropna().distinct()
    ok = d.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(1, most)).select("commit_id")
    first = commits.join(ok, "commit_id", "left_semi").filter("author_email is not null").groupBy("author_email").agg(F.max_by("commit_id", F.struct("seq", "commit_id")).alias("commit_id"))
    j = first.join(d, "commit_id")
    if rankable is not None:
        j = j.join(rankable.select("path"), "path", "left_semi")
    return j.groupBy("path").agg(F.count(F.lit(1)).alias("newcomers")).orderBy(F.desc("newcomers"), "path")
