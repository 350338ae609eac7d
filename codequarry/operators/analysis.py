"""The whole analysis of one repository: from its folder to the sections of the report and the chunks for search.

Every section is a DataFrame; nothing is gathered but what :func:`codequarry.sources.files.assemble` makes one document
of. Inputs of several sections are written once (reliable checkpoints), the rest stays declarative.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.operators import chunking, cochange, findings, graph, history, imports, overview, ownership, ranking
from codequarry.session import cut
from codequarry.sources import files as X
from codequarry.sources import git as G
from codequarry.sources import pyast

#: Lines that a file needs to be in the reading order.
READABLE = 5


@dataclass
class Analysis:
    sections: dict[str, DataFrame]
    chunks: DataFrame

    def report(self) -> DataFrame:
        """(value): the report as one JSON document."""
        return X.assemble(self.sections)


def _mailmap(files: DataFrame) -> DataFrame:
    lines = files.filter("path = '.mailmap'").select(F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("ord", "value"))
    return history.parse_mailmap(lines)


def analyse(spark: SparkSession, repo: str, *, max_commits: int = 20_000, max_blame: int = 3_000, rounds: int = 50, progress: Callable[[str, int], None] = lambda stage, percent: None) -> Analysis:
    """Sections and chunks of the repository in the folder ``repo``; a folder without commits is an error.

    The newest ``max_commits`` commits count; the ``max_blame`` files with the most commits have their lines attributed;
    what that leaves out, files that were skipped, failed to parse or failed to be attributed, and findings over the cap
    stand in the section ``limits``. ``rounds`` is that of PageRank. ``progress`` hears the stage that begins and the share done, in percent.
    """
    head = G.open_local(repo)
    progress("inventory", 2)
    files = cut(G.inventory(G.read_git(spark, repo, "blobs")))
    python = F.lower("language") == "python"
    readable = ~F.col("is_binary") & F.col("skip_reason").isNull()

    progress("parse", 5)
    parsed = cut(pyast.parse_files(files.filter(python & readable)))
    nodes = files.filter(python).select(F.col("path").alias("node"))
    edges = cut(imports.import_edges(imports.resolve_imports(pyast.imports_of(parsed), files.filter(python).select("path"))))
    plain = files.filter(python & ~F.col("is_test"))
    inner_nodes, inner = graph.restrict(nodes, edges, plain.select("path"))
    inner_nodes, inner = cut(inner_nodes), cut(inner)

    progress("history", 30)
    commits = cut(G.read_git(spark, repo, "commits", maxCommits=max_commits))
    changed = history.follow_renames(G.read_git(spark, repo, "commit_files", maxCommits=max_commits), commits, G.read_git(spark, repo, "renames", maxCommits=max_commits))
    changed = cut(changed.join(files.select("path"), "path", "left_semi"))
    of_file = cut(history.file_history(changed, commits))

    progress("blame", 56)
    chosen = cut(overview.blame_candidates(files, of_file.select("path", "commits"), max_blame))
    blame = cut(G.blame(chosen.filter("chosen"), repo))
    seen = history.authors(commits)
    only_lines = blame.filter("error is null").groupBy("email").agg(F.max_by("name", "last_at").alias("name"), F.max("last_at").alias("last_commit_at")).join(seen.select("email"), "email", "left_anti")
    identities = seen.unionByName(only_lines.select("email", "name", F.array("name").alias("names"), F.lit(0).cast("long").alias("commits"), "last_commit_at"))
    people = cut(history.resolve_people(identities, _mailmap(files)))
    owned = cut(ownership.owned_lines(blame.filter("error is null"), people))
    last = commits.agg(F.max("ts").alias("t")).first()["t"]
    own = lambda o: ownership.ownership(o, last_seen=people.select("id", "last_commit_at"), as_of=last)

    progress("analyze", 94)
    reach = graph.pagerank(inner_nodes, inner, rounds=rounds, reverse=True).select(F.col("node").alias("path"), F.col("rank").alias("reach"))
    fan = inner.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("fan_in"))
    ranked = plain.filter(F.col("non_blank_lines") >= READABLE).select("path", P.is_private_module(F.col("path")).alias("private"))
    ranked = ranked.join(of_file.select("path", "commits"), "path", "left").join(reach, "path", "left").join(fan, "path", "left").fillna(0, ["commits", "reach", "fan_in"])
    reading = cut(ranking.reading_order(cut(ranked), key="path", commits="commits", reach="reach", fan_in="fan_in", private="private"))
    pairs = cochange.cochange(changed, group="commit_id", item="path", nodes=nodes, edges=edges, sizes=commits, size="files_changed")
    areas = cochange.cochange_areas(changed, group="commit_id", area=P.area(F.col("path")))
    counted = files.join(of_file, "path", "left")
    hot = ranking.hotspots(counted.filter(P.is_code(F.lower("language")) & F.col("generated_reason").isNull()).withColumn("commits", F.coalesce("commits", F.lit(0))), key="path", commits="commits", complexity="indent_complexity")
    unit = lambda c: F.when(F.instr(c, "/") > 0, P.dir_name(c)).otherwise(c)
    dirs = cut(graph.directory_edges(inner, unit))
    layers, _ = graph.layers(inner_nodes.select(unit(F.col("node")).alias("node")).distinct(), dirs.select("src", "dst"))

    progress("findings", 96)
    texts = files.filter("text is not null").select("path", "text")
    dup = cut(findings.near_duplicates(files, texts))
    grouped = dup.select(F.explode("evidence").alias("x")).select("x.path")
    parts = [
        dup, findings.same_name_nested(files, edges, grouped), findings.repeated_functions(texts, pyast.symbols_of(parsed), files), findings.similar_names(files),
        findings.import_cycles(edges.join(plain.select(F.col("path").alias("src")), "src", "left_semi").join(plain.select(F.col("path").alias("dst")), "dst", "left_semi")),
        findings.committed_generated(files), findings.missing_tests(files, edges), findings.unreferenced(files, texts, edges, parsed.select("path")),
    ]
    kept, omitted = findings.number([cut(p) for p in parts])

    progress("report", 98)
    limits = overview.limits(files, parsed.filter("first_error_line > 0").select("path"), overflow=chosen.filter("NOT chosen"))
    limits = limits.unionByName(blame.filter("error is not null").select("path", F.concat(F.lit("blame failed: "), "error").alias("reason")))
    limits = limits.unionByName(omitted.select(F.col("kind").alias("path"), F.concat(F.col("omitted").cast("string"), F.lit(" findings omitted")).alias("reason")))
    sections = {
        "repo": spark.createDataFrame([(repo.rstrip("/").rsplit("/", 1)[-1], head)], "name string, head string"),
        "overview": overview.overview(files, commits, people),
        "languages": overview.languages(files),
        "files": counted.join(parsed.select("path", "first_error_line"), "path", "left").drop("text", "blob_id"),
        "edges": edges,
        "components": overview.component_table(files, layers),
        "people": people,
        "ownership": own(owned).unionByName(own(ownership.roll_up(owned))),
        "coupling": pairs,
        "areaCoupling": areas,
        "hotspots": hot,
        "readingOrder": reading,
        "findings": kept,
        "limits": limits,
    }
    progress("chunks", 99)
    py = chunking.symbol_chunks(files.filter(python & readable).select("path", "text"), pyast.symbols_of(parsed))
    other = chunking.windows(files.filter(readable & ~python & F.col("language").isNotNull()).select("path", "text"))
    chunks = py.unionByName(other.select("path", "start_line", "end_line", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("symbol"), "body"))
    chunks = chunking.cap(chunks.join(reading.select("path", F.col("score").alias("file_score")), "path", "left").join(files.select("path", "is_test", F.col("generated_reason").isNotNull().alias("is_generated")), "path"))
    progress("done", 100)
    return Analysis(sections, chunks)
