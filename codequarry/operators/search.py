"""Full-text retrieval over chunks: postings, candidates, ranking, diversity, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as T
from codequarry.functions.scoring import round3
from codequarry.session import cut

#: Default weights of the three fields, and of the ranking.
FIELD_WEIGHTS = {"symbol": 1.0, "path": 0.4, "body": 0.2}
W_SYMBOL, W_WORD, W_PATH, W_FILE, PENALTY = 0.5, 0.35, 0.3, 0.2, 0.3


def tokens(c: Column) -> Column:
    """Words of letters, digits and underscores, and the parts of underscored ones."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))
    parts = F.flatten(F.transform(F.filter(ws, lambda w: F.instr(w, "_") > 0), lambda w: F.filter(F.split(w, "_+"), lambda p: p != "")))
    return F.concat(ws, parts)


def postings(chunks: DataFrame, *, key: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(key, term, weight): the summed field weight of every term of a chunk; written once, bucketed by term, it is the
    index. ``fields`` maps symbol, path and body to columns."""
    f = fields or {"symbol": "symbol", "path": "path", "body": "body"}

    def weighted(field: str, col: str) -> Column:
        c = F.replace(F.col(col), F.lit("/"), F.lit(" ")) if field == "path" else F.col(col)
        return F.transform(tokens(c), lambda t: F.struct(t.alias("term"), F.lit(FIELD_WEIGHTS[field]).alias("w")))

    both = F.concat(*(weighted(k, c) for k, c in f.items()))
    return chunks.select(key, F.explode(both).alias("x")).groupBy(key, F.col("x.term").alias("term")).agg(F.sum("x.w").alias("weight"))


def candidates(index: DataFrame, chunks: DataFrame, question: str, *, key: str, symbol: str = "symbol", limit: int = 60) -> DataFrame:
    """Chunks that hold any term of the question, with text_score; chunks whose symbol is named come first."""
    spark = chunks.sparkSession
    ts = spark.range(1).select(T.terms(F.lit(question)).alias("ts"))
    hits = index.join(F.broadcast(ts.select(F.explode("ts").alias("term")).distinct()), "term").groupBy(key).agg(F.sum("weight").alias("text_score"))
    j = hits.join(chunks, key)
    named = T.symbol_matches(F.col(symbol), _lit_terms(question))
    return j.withColumn("named", named).orderBy(F.desc("named"), F.desc(F.round("text_score", 6)), key).limit(limit)


def _lit_terms(question: str) -> Column:
    return T.terms(F.lit(question))


def rank(matches: DataFrame, question: str, *, path: str = "path", symbol: str = "symbol", file_score: str = "file_score", penal: Column | None = None, start: str = "start_line", end: str = "end_line", limit: int = 8, per_file: int = 3) -> DataFrame:
    """The matches rescored, at most ``per_file`` of a path unless their symbol is named outright, ``limit`` in all.

    The greedy scan of the definition equals a window: until three rows of a path are in, every row is, so a row's
    number within its path decides; the limit is the same order's limit."""
    ts = _lit_terms(question)
    m = matches.withColumn("__max", matches.agg(F.max("text_score")).scalar())
    text = F.when(F.col("__max") > 0, F.col("text_score") / F.col("__max")).otherwise(0.0)
    sym = T.symbol_matches(F.col(symbol), ts)
    score = text + F.when(sym, W_SYMBOL).when(T.symbol_word_matches(F.col(symbol), ts), W_WORD).otherwise(0.0) + F.when(T.path_matches(F.col(path), ts), W_PATH).otherwise(0.0) + F.lit(W_FILE) * F.coalesce(F.col(file_score), F.lit(0.0))
    if penal is not None:
        score = score - F.when(penal, PENALTY).otherwise(0.0)
    r = m.withColumn("score", round3(score)).withColumn("definitional", sym).withColumn("location", T.location(F.col(path), F.col(start), F.col(end))).drop("__max")
    w = Window.partitionBy(path).orderBy(F.desc("score"), "location")
    return r.withColumn("__n", F.row_number().over(w)).filter(F.col("definitional") | (F.col("__n") <= per_file)).drop("__n").orderBy(F.desc("score"), "location").limit(limit)


def rank_many(
    index: DataFrame, chunks: DataFrame, questions: DataFrame, *, key: str, scope: str, question: str, shared: tuple[str, ...] = (), path: str = "path", symbol: str = "symbol", file_score: str = "file_score", penal: Column | None = None, start: str = "start_line", end: str = "end_line", pool: int = 60, limit: int = 8, per_file: int = 3
) -> DataFrame:
    """(scope, question, key, score, position): what ``candidates`` and ``rank`` give for every question, as joins.

    A question is asked of the chunks of its scope. ``shared`` are terms that all questions hold: a chunk that holds no
    other term of a question has the same score for all of them, so of those the first ``pool`` of a scope are enough."""
    q = questions.select(scope, question).distinct().withColumn("ts", F.array_distinct(T.terms(F.col(question))))
    words = F.array(*map(F.lit, shared)).cast("array<string>")
    # of the index only the terms that are asked for, before anything is shuffled by it or kept
    terms = q.select(F.explode("ts").alias("term")).distinct()
    p = cut(index.join(terms, "term", "left_semi").join(chunks.select(key, scope), key).select(key, scope, "term", "weight"))
    base = p.filter(F.array_contains(words, F.col("term"))).groupBy(scope, key).agg(F.sum("weight").alias("base"))
    own = q.select(scope, question, F.explode(F.array_except("ts", words)).alias("term")).join(p, [scope, "term"]).groupBy(scope, question, key).agg(F.sum("weight").alias("own"))
    hit = own.join(base, [scope, key], "left").select(scope, question, key, (F.col("own") + F.coalesce("base", F.lit(0.0))).alias("text_score"))
    order = Window.partitionBy(scope).orderBy(T.symbol_matches(F.col(symbol), words).desc(), F.desc(F.round("base", 6)), key)
    lead = base.join(chunks.select(key, symbol), key).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= pool).select(scope, key, "base")
    rest = q.select(scope, question).join(lead, scope).join(own.select(scope, question, key), [scope, question, key], "left_anti").select(scope, question, key, F.col("base").alias("text_score"))
    m = hit.unionByName(rest).join(q, [scope, question]).join(chunks.drop(scope), key)
    ts = F.col("ts")
    sym = T.symbol_matches(F.col(symbol), ts)
    best = Window.partitionBy(scope, question).orderBy(F.desc("definitional"), F.desc(F.round("text_score", 6)), key)
    m = m.withColumn("definitional", sym).withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= pool)
    m = m.withColumn("__max", F.max("text_score").over(Window.partitionBy(scope, question)))
    text = F.when(F.col("__max") > 0, F.col("text_score") / F.col("__max")).otherwise(0.0)
    score = text + F.when(sym, W_SYMBOL).when(T.symbol_word_matches(F.col(symbol), ts), W_WORD).otherwise(0.0) + F.when(T.path_matches(F.col(path), ts), W_PATH).otherwise(0.0) + F.lit(W_FILE) * F.coalesce(F.col(file_score), F.lit(0.0))
    if penal is not None:
        score = score - F.when(penal, PENALTY).otherwise(0.0)
    r = m.withColumn("score", round3(score)).withColumn("location", T.location(F.col(path), F.col(start), F.col(end)))
    r = r.withColumn("__n", F.row_number().over(Window.partitionBy(scope, question, path).orderBy(F.desc("score"), "location", key))).filter(F.col("definitional") | (F.col("__n") <= per_file))
    r = r.withColumn("position", F.row_number().over(Window.partitionBy(scope, question).orderBy(F.desc("score"), "location", key)))
    return r.filter(F.col("position") <= limit).select(scope, question, key, "score", "position")


def verify_citations(answers: DataFrame, given: DataFrame, *, key: str, answer: str) -> DataFrame:
    """(key, path, start, end, status): exact, inside or unsupported for each distinct citation of an answer.

    ``given``: key, path, start_line, end_line of the excerpts. Start and end may lie inside different excerpts."""
    c = answers.select(F.col(key).alias("k"), F.explode(T.citations(F.col(answer))).alias("c")).select("k", "c.path", "c.start", "c.end")
    g = given.select(F.col(key).alias("k"), "path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    j = c.join(g, ["k", "path"], "left")
    a = j.groupBy("k", "path", "start", "end").agg(
        F.max((F.col("s") == F.col("start")) & (F.col("end").isNull() | (F.col("e") == F.col("end")))).alias("exact"),
        F.max(F.col("start").between(F.col("s"), F.col("e"))).alias("in_s"), F.max(F.col("end").between(F.col("s"), F.col("e"))).alias("in_e"),
    )
    status = F.when(F.col("exact"), "exact").when(F.col("in_s") & (F.col("end").isNull() | F.col("in_e")), "inside").otherwise("unsupported")
    return a.select(F.col("k").alias(key), "path", "start", "end", status.alias("status"))


def prompt_excerpts(results: DataFrame, *, order: list, body: str, budget: int = 12_000) -> DataFrame:
    """Results with ``excerpt``: bodies in order until the budget of characters is spent, the last one cut and marked."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(body)).over(w), F.lit(0))
    left = F.lit(budget) - before
    cutoff = F.when(F.length(body) <= left, F.col(body)).otherwise(F.concat(F.substring(F.col(body), F.lit(1), left.cast("int")), F.lit("\n[truncated]")))
    return results.withColumn("__left", left).filter("__left > 0").withColumn("excerpt", cutoff).drop("__left")


def answer(question: str, results: DataFrame, model=None) -> dict:  # noqa: ANN001
    """Answer protocol: no hits -> a note; no model -> sources only; a model's reply with its citations checked; a
    failing model -> sources and a note. ``model`` is a callable prompt -> text; results are at most a page of rows."""
    rows = [r.asDict(recursive=True) for r in results.collect()]
    if not rows:
        return {"answer": None, "note": "Nothing in this repository matched the question.", "sources": [], "citations": []}
    if model is None:
        return {"answer": None, "note": "No language model is configured; these are the matching sources.", "sources": rows, "citations": []}
    prompt = question + "\n\n" + "\n\n".join(f"{r['location']}\n{r.get('excerpt') or r.get('body')}" for r in rows)
    try:
        reply = model(prompt)
    except Exception as e:  # noqa: BLE001
        return {"answer": None, "note": f"The language model failed: {e}", "sources": rows, "citations": []}
    spark = results.sparkSession
    a = spark.createDataFrame([(1, reply)], "k int, a string")
    g = spark.createDataFrame([(1, r["path"], r["start_line"], r["end_line"]) for r in rows], "k int, path string, start_line int, end_line int")
    checked = [r.asDict() for r in verify_citations(a, g, key="k", answer="a").collect()]
    return {"answer": reply, "note": None, "sources": rows, "citations": checked}
