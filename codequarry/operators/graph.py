"""Iterative graph operators: components, PageRank, strongly connected components, layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component's name is its smallest node.

    Alternating large-star/small-star contraction: edges shrink to stars in O(log n) rounds, also for long chains.
    A hub is pre-aggregated by ``min`` before the shuffle. Self-loops keep their node; null ends are dropped;
    repeated and reversed edges count once. No edges: no rows. Raises if ``max_rounds`` do not suffice.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    nodes = cut(e.select(F.col("a").alias("node")).union(e.select("b")).distinct())
    e = cut(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the least of the node and its neighbours
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node, is linked to the least neighbour
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(low2, F.col("a") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")
        ).select("x.a", "x.b").filter("a <> b").distinct()
        e = cut(small)
        sig = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sig) == last:
            break
        last = tuple(sig)
    else:
        raise RuntimeError("components: no fixpoint within max_rounds")
    return nodes.join(e, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def build(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct (src, dst) without loops; nodes keep the isolated ones. Null ends are dropped."""
    e = edges.select("src", "dst").dropna().filter("src <> dst").distinct()
    n = e.select(F.col("src").alias("node")).union(e.select("dst"))
    if nodes is not None:
        n = n.union(nodes.select(nodes.columns[0]))
    return n.dropna().distinct(), e


def restrict(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subgraph on ``keep``; its isolated nodes stay."""
    k = keep.select(F.col(keep.columns[0]).alias("node")).distinct()
    e = edges.join(k.withColumnRenamed("node", "src"), "src", "left_semi").join(k.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes.join(k, "node", "left_semi"), e.select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 50, cut_every: int = 1, reverse: bool = False) -> DataFrame:
    """([repo,] node, rank): a fixed number of rounds; the rank of nodes without outgoing edges is spread evenly.

    The out-degree is put on the edges once, and that copy is reused by every round. Ranks are read twice in a round, so
    lineage is cut reliably after each (``cut_every``): without it the work of a round would double with every next; the dangling mass is one number per round, a scalar subquery. Nodes must be
    distinct and cover all ends. No nodes: no rows. With ``reverse`` edges run the other way. Where both tables have a
    column ``repo``, every repository is a graph of its own, ranked in the same rounds.
    """
    if "repo" in nodes.columns:
        return _pagerank_by_repo(nodes, edges, damping, rounds, cut_every, reverse)
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("src", "dst")
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    links = cut(e.join(out, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")))
    base = cut(nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("has_out")), "node", "left"))
    ranks = base.select("node", "has_out", F.lit(1.0 / n).alias("rank"))
    for i in range(1, rounds + 1):
        into = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        dangling = ranks.filter("has_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).scalar()
        ranks = base.join(into, F.col("node") == F.col("dst"), "left").select(
            "node", "has_out", (F.lit((1 - damping) / n) + F.lit(damping / n) * dangling + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("rank")
        )
        if i % cut_every == 0 and i < rounds:
            ranks = cut(ranks)
    return ranks.select("node", "rank")


def _pagerank_by_repo(nodes: DataFrame, edges: DataFrame, damping: float, rounds: int, cut_every: int, reverse: bool) -> DataFrame:
    e = edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else edges.select("repo", "src", "dst")
    out = e.groupBy("repo", "src").agg(F.count(F.lit(1)).alias("deg"))
    links = cut(e.join(out, ["repo", "src"]).select("repo", "src", "dst", (1.0 / F.col("deg")).alias("w")))
    sizes = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    base = cut(nodes.select("repo", "node").join(out.select("repo", F.col("src").alias("node"), F.lit(True).alias("has_out")), ["repo", "node"], "left").join(sizes, "repo"))
    ranks = base.withColumn("rank", 1.0 / F.col("n"))
    for i in range(1, rounds + 1):
        into = links.join(ranks.select("repo", F.col("node").alias("src"), "rank"), ["repo", "src"]).groupBy("repo", F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
        loose = ranks.filter("has_out is null").groupBy("repo").agg(F.sum("rank").alias("d"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        ranks = base.join(into, ["repo", "node"], "left").join(loose, "repo", "left").select("repo", "node", "has_out", "n", ((1 - damping) / F.col("n") + damping / F.col("n") * zero("d") + damping * zero("s")).alias("rank"))
        if i % cut_every == 0 and i < rounds:
            ranks = cut(ranks)
    return ranks.select("repo", "node", "rank")


def scc(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of strongly connected components, named by their smallest node.

    Forward-backward colouring: the largest colour (node name) is spread forward to a fixpoint; going backward from the
    node that owns a colour, within its colour, gives one whole component. Settled nodes leave the graph. Nodes without
    an edge in or out settle first, so the rounds follow the depth of cycles, not of the graph.
    """
    n, e = build(edges, nodes)
    left_nodes, left_edges = cut(n), cut(e)
    if left_edges.limit(1).count() == 0:
        return left_nodes.select("node", F.col("node").alias("component"))
    done: DataFrame | None = None

    def settle(part: DataFrame) -> None:
        nonlocal done
        part = cut(part)
        done = part if done is None else done.unionByName(part)

    for _ in range(max_rounds):
        # trim what has no edge in or none out until nothing more falls off
        while True:
            inner = left_edges.select(F.col("src").alias("node")).distinct().join(left_edges.select(F.col("dst").alias("node")).distinct(), "node")
            single = left_nodes.join(inner, "node", "left_anti")
            if single.limit(1).count() == 0:
                break
            settle(single.select("node", F.col("node").alias("component")))
            left_nodes = cut(left_nodes.join(inner, "node", "left_semi"))
            left_edges = cut(restrict(left_nodes, left_edges, left_nodes)[1])
        if left_nodes.limit(1).count() == 0:
            break
        colour = cut(left_nodes.select("node", F.col("node").alias("c")))
        while True:
            into = left_edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.max("c").alias("m"))
            nxt = cut(colour.join(into, F.col("node") == F.col("dst"), "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            moved = nxt.filter("moved").limit(1).count()
            colour = nxt.select("node", "c")
            if not moved:
                break
        same = cut(
            left_edges.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        )
        reached = cut(colour.filter("node = c").select("node", "c"))
        while True:
            more = same.join(reached.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "c").distinct().join(reached, ["node", "c"], "left_anti")
            more = cut(more)
            if more.limit(1).count() == 0:
                break
            reached = cut(reached.unionByName(more))
        names = reached.groupBy("c").agg(F.min("node").alias("component"))
        settle(reached.join(names, "c").select("node", "component"))
        left_nodes = cut(left_nodes.join(reached.select("node"), "node", "left_anti"))
        left_edges = cut(restrict(left_nodes, left_edges, left_nodes)[1])
    else:
        raise RuntimeError("scc: not settled within max_rounds")
    return done if done is not None else n.select("node", F.col("node").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(layers, cycles): layer 0 depends on nothing outside its component, others lie one above their highest dependency.

    layers(node, component, layer); cycles(component, members, edges) for components of two or more nodes, largest
    first. A component is a unit. Edges point from the dependent to what it depends on.
    """
    n, e = build(edges, nodes)
    comp = cut(scc(n, e))
    ce = e.join(comp.select(F.col("node").alias("src"), F.col("component").alias("cs")), "src").join(comp.select(F.col("node").alias("dst"), F.col("component").alias("cd")), "dst")
    up = cut(ce.filter("cs <> cd").select("cs", "cd").distinct())
    level = cut(comp.select("component").distinct().withColumn("layer", F.lit(0)))
    for _ in range(max_rounds):
        above = up.join(level.select(F.col("component").alias("cd"), "layer"), "cd").groupBy("cs").agg((F.max("layer") + 1).alias("m"))
        nxt = cut(level.join(above, F.col("component") == F.col("cs"), "left").select("component", F.greatest("layer", F.coalesce("m", F.lit(0))).alias("layer"), (F.coalesce("m", F.lit(0)) > F.col("layer")).alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        level = nxt.select("component", "layer")
        if not moved:
            break
    else:
        raise RuntimeError("layers: no fixpoint within max_rounds")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("node")).alias("members")).filter("size > 1")
    inner = ce.filter("cs = cd").groupBy(F.col("cs").alias("component")).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    cycles = sizes.join(inner, "component").select("component", "size", "members", "edges").orderBy(F.desc("size"), "component")
    return comp.join(level, "component").select("node", "component", "layer"), cycles


def directory_edges(edges: DataFrame, unit, skip_init: bool = True) -> DataFrame:  # noqa: ANN001
    """([repo,] src, dst, example_src, example_dst): file edges lifted to ``unit(path)``, each with its first example.

    Package initialisers re-export, so edges out of ``__init__.py`` do not count; nor do edges within a unit."""
    by = ["repo"] if "repo" in edges.columns else []
    e = edges.filter(~F.col("src").rlike(r"(^|/)__init__\.py$")) if skip_init else edges
    e = e.select(*by, unit(F.col("src")).alias("us"), unit(F.col("dst")).alias("ud"), F.struct("src", "dst").alias("x")).filter("us <> ud")
    return e.groupBy(*by, F.col("us").alias("src"), F.col("ud").alias("dst")).agg(F.min("x").alias("x")).select(*by, "src", "dst", F.col("x.src").alias("example_src"), F.col("x.dst").alias("example_dst"))
