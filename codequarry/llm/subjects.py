"""Subject areas of documents: classifier chains over term, source and structure features, beam-search decoding.

1. Terms. Words (identifiers split at case and underscore, plural s removed) are hashed to 2^BITS numbers, so the tables
   of the model have a fixed bound however large the corpus. Texts are cut into words once; a document keeps the numbers
   of its words. Over the labelled documents every number is counted per subject; two rounds of self-training repeat the
   count over all documents, with the subjects that the terms settle beyond doubt. A term has a weight for each subject
   that it speaks for; one that points to one subject is a mention of it.
2. Sentences. A naive Bayes model of the other words of a sentence tells genuine mentions from mentions in passing; it
   is trained on labelled documents, where mentions of a subject the document is not about are the passing ones.
3. Chain. One logistic link per subject sees the term weights and mentions of its subject, what the source says, the
   structure of the text and the labels decided by earlier links, with their co-occurrence; held-out Platt scaling
   calibrates it. Weights and Platt pair of a subject are its own, drawn to those of all subjects, and these to a fixed
   prior, the more the fewer labels there are.
4. A beam search over the chain finds the most probable label combination of at most ``max_labels`` subjects.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut

#: Terms are numbered by so many bits of their hash.
BITS = 20
#: A labelled document counts as so many that self-training settled.
TRUST = 4.0
#: A term has a weight for subjects of at least this share of it.
SOFT = 0.3
#: Documents of a term from which the labels alone judge it.
ENOUGH = 6.0
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"([a-zß-ÿ])([A-ZÀ-Þ])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def stem(w: str) -> str:
    """A lower-case word without a plural s."""
    return w[:-1] if len(w) > 4 and w[-1] == "s" and w[-2] != "s" else w


def words(text: str) -> list[str]:
    """Lower-case words of two or more letters; ``someNameParts`` and ``some_name_parts`` count as three words."""
    return [stem(w) for w in _WORD.findall(_CAMEL.sub(r"\1 \2", text).lower()) if len(w) > 1]


def number(word: str, bits: int = BITS) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & ((1 << bits) - 1)


def term_numbers(text: Column) -> Column:
    """The distinct numbers of the words of a text, as an expression: the same as of :func:`words`."""
    ws = F.split(F.lower(F.regexp_replace(text, "([a-zß-ÿ])([A-ZÀ-Þ])", "$1 $2")), r"[^\p{L}]+")
    ws = F.filter(ws, lambda w: F.length(w) > 1)
    cut_s = lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_distinct(F.transform(ws, lambda w: F.crc32(F.encode(cut_s(w), "UTF-8")).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))


#: Features of a (document, subject), and what a link weighs without any label: a fixed prior.
FEATURES = "one mentions genuine share_genuine share_mentions purity top second_on of_best sentences double quoted length none soft soft_share source".split()
CHAIN = "one_before two_before goes_with".split()
PRIOR = np.array([{"one": -1.0, "top": 3.0, "none": -3.0}.get(x, 0.0) for x in FEATURES + CHAIN])


@dataclass
class Model:
    subjects: list[str]
    mention: dict[int, int] = field(default_factory=dict)  # number of a term -> its one subject
    soft: dict[int, list[tuple[int, float]]] = field(default_factory=dict)  # number -> subjects and weights
    frames: dict[str, float] = field(default_factory=dict)
    frame_prior: float = 2.0
    sources: dict[str, np.ndarray] = field(default_factory=dict)  # log odds of the subjects in a source
    order: list[int] = field(default_factory=list)
    links: np.ndarray | None = None  # a row of weights per subject
    platt: np.ndarray | None = None  # slope and intercept per subject
    cooc: np.ndarray | None = None
    max_labels: int = 2
    beam: int = 8

    # -- features --------------------------------------------------------------------------------------------------

    def entry(self, raw: str, seen: dict) -> tuple[int, float, list[tuple[int, float]], str]:
        """(subject of a mention or -1, frame weight, soft weights, word) of a raw word, remembered in ``seen``."""
        w = stem(raw)
        b = number(w)
        seen[raw] = out = (self.mention.get(b, -1), self.frames.get(w, 0.0), self.soft.get(b, []), w)
        return out

    def sentences(self, text: str, seen: dict) -> Iterator[tuple[list[tuple], bool]]:
        """Entries of the words of each sentence, and whether it is quoted."""
        low = _CAMEL.sub(r"\1 \2", text).lower()
        for raw in _SENTENCE.split(low):
            got = [seen.get(w) or self.entry(w, seen) for w in _WORD.findall(raw) if len(w) > 1]
            if got:
                yield got, raw.lstrip()[:1] == ">"

    def measure(self, texts: list[str | None]) -> np.ndarray:
        """(documents, subjects, 6): mentions, genuine ones, sentences, sentences with two mentions, quoted ones, weight
        of all terms; null texts have none."""
        out = np.zeros((len(texts), len(self.subjects), 6))
        seen: dict = {}
        for d, t in enumerate(texts):
            if not t:
                continue
            terms: dict[str, list] = {}
            rows: dict[int, list[float]] = {}
            for got, quoted in self.sentences(t, seen):
                hits: Counter = Counter()
                rest: dict[str, float] = {}
                for s, f, soft, w in got:
                    if s >= 0:
                        hits[s] += 1
                    elif f:
                        rest[w] = f
                    if soft:
                        terms[w] = soft
                if hits:
                    z = self.frame_prior + self.frames.get(f"#{min(3, sum(hits.values()))}", 0.0) + sum(rest.values())
                    g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
                    for s, v in hits.items():
                        r = rows.setdefault(s, [0.0] * 5)
                        r[0] += v
                        r[1] += v * g
                        r[2] += 1
                        r[3] += v > 1
                        r[4] += quoted
            for s, r in rows.items():
                out[d, s, :5] = r
            for soft in terms.values():
                for s, x in soft:
                    out[d, s, 5] += x
        return out

    def features(self, m: np.ndarray, lengths: np.ndarray, sources: list[str | None]) -> np.ndarray:
        """(documents, subjects, FEATURES)."""
        on = m[:, :, 0] > 0
        gen = m[:, :, 1]
        rank = np.empty(gen.shape, int)
        np.put_along_axis(rank, np.argsort(-gen, axis=1, kind="stable"), np.arange(gen.shape[1])[None, :], axis=1)
        safe = lambda a, b: a / np.maximum(b, 1e-6)
        zero = np.zeros(len(self.subjects))
        src = np.array([self.sources.get((s or "").strip().lower(), zero) for s in sources]).reshape(gen.shape)
        soft = m[:, :, 5]
        x = [
            np.ones(gen.shape), np.log1p(m[:, :, 0]), np.log1p(gen), safe(gen, gen.sum(1, keepdims=True)), safe(m[:, :, 0], m[:, :, 0].sum(1, keepdims=True)), safe(gen, m[:, :, 0]), on & (rank == 0), on & (rank > 1),
            safe(gen, gen.max(1, keepdims=True)), np.log1p(m[:, :, 2]), safe(m[:, :, 3], m[:, :, 2]), safe(m[:, :, 4], m[:, :, 2]), np.broadcast_to(np.log1p(lengths)[:, None] / 10, gen.shape), ~on,
            np.log1p(soft), safe(soft, soft.sum(1, keepdims=True)), src,
        ]
        return np.stack([np.asarray(a, float) for a in x], axis=-1)

    # -- chain -----------------------------------------------------------------------------------------------------

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(documents, subjects) of booleans: the best combination that the beam finds, all documents step by step."""
        n, n_s, k = x.shape
        z0 = np.einsum("dsk,sk->ds", x, self.links[:, :k])
        w = self.links[:, k:]
        cooc = np.c_[self.cooc, np.zeros(n_s)]  # the last column stands for no label
        score = np.full((n, self.beam), -np.inf)
        score[:, 0] = 0.0
        held = np.full((n, self.beam, self.max_labels), n_s)
        for s in self.order:
            many = (held < n_s).sum(2)
            z = z0[:, s, None] + w[s, 0] * (many == 1) + w[s, 1] * (many > 1) + w[s, 2] * cooc[s][held].sum(2)
            z = np.clip(z * self.platt[s, 0] + self.platt[s, 1], -30, 30)
            yes = np.where(many < self.max_labels, score - np.logaddexp(0, -z), -np.inf)
            with_s = held.copy()
            at = np.minimum(many, self.max_labels - 1)
            np.put_along_axis(with_s, at[:, :, None], s, axis=2)
            both, which = np.c_[score - np.logaddexp(0, z), yes], np.concatenate([held, with_s], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, : self.beam]
            score = np.take_along_axis(both, best, axis=1)
            held = np.take_along_axis(which, best[:, :, None], axis=1)
        out = np.zeros((n, n_s + 1), bool)
        np.put_along_axis(out, held[:, 0, :], True, axis=1)
        return out[:, :n_s]

    def label(self, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
        """Documents without a word have no subject."""
        m = self.measure(texts)
        lengths = np.array([len(t) if t else 0 for t in texts], float)
        out = self.decode(self.features(m, lengths, sources))
        out[[not t or not t.strip() for t in texts]] = False
        return out


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 30, center: np.ndarray | None = None) -> np.ndarray:
    """Weights shrunk to ``center``, or to 0."""
    center = np.zeros(x.shape[1]) if center is None else center
    w = center.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * (w - center)
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Strength with which a subject's weights and its Platt pair are drawn to those of all subjects.
SHRINK = 3.0


def _fit_links(x: np.ndarray, y: np.ndarray, subject: np.ndarray, fold: np.ndarray, n_s: int, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, Platt pairs), a row per subject: fitted on its own rows, shrunk to those fitted on the rows of all.

    The pairs are fitted on scores of held-out folds. A subject without rows has the pooled weights; without any rows
    these are the prior."""

    def fit(use: np.ndarray) -> np.ndarray:
        pooled = _fit_logistic(x[use], y[use], center=prior)
        return np.array([_fit_logistic(x[use & (subject == s)], y[use & (subject == s)], SHRINK, center=pooled) for s in range(n_s)])

    z = np.zeros(len(y))
    for k in np.unique(fold):
        w = fit(fold != k)
        z[fold == k] = (x[fold == k] * w[subject[fold == k]]).sum(axis=1)
    c = np.c_[z, np.ones(len(z))]
    pooled = _fit_logistic(c, y, l2=1.0, center=np.array([1.0, 0.0]))
    platt = np.array([_fit_logistic(c[subject == s], y[subject == s], SHRINK, center=pooled) for s in range(n_s)])
    platt[:, 0] = np.clip(platt[:, 0], 0.3, 3.0)
    return fit(np.ones(len(y), bool)), platt


def _shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(terms, subjects): how much of a term each subject has, its size half allowed for."""
    # half-way between counts and rates: large subjects don't win, wrong labels of small ones don't either
    rate = counts / np.sqrt(np.maximum(totals, 1))
    n = counts.sum(1, keepdims=True)
    # one sighting more, spread evenly, so that a single chance one is not pure
    return (n * rate / np.maximum(rate.sum(1, keepdims=True), 1e-12) + 1.0 / counts.shape[1]) / (n + 1.0)


def _judge(counts: DataFrame, totals: np.ndarray, least: float) -> dict[int, list[tuple[int, float]]]:
    """Number of a term -> [(subject, share)] of at least SOFT, for terms of ``least`` documents. Terms are judged on the
    executors; what comes to the driver is bounded by the number of hashes."""
    n_s = len(totals)
    per = counts.groupBy("b").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("s") == i, F.col("n"))), F.lit(0.0)) for i in range(n_s))).alias("c"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.array(pdf["c"].tolist(), float).reshape(-1, n_s)
            p = np.where(c.sum(1, keepdims=True) >= least, _shares(c, totals), 0.0)
            i, s = np.nonzero(p >= SOFT)
            yield pd.DataFrame({"b": pdf["b"].to_numpy()[i], "s": s.astype(np.int32), "p": p[i, s]})

    got = per.mapInPandas(judge, "b int, s int, p double").toPandas()
    out: dict[int, list[tuple[int, float]]] = {}
    for b, s, p in zip(got["b"].tolist(), got["s"].tolist(), got["p"].tolist()):
        out.setdefault(b, []).append((s, p))
    return out


def common_terms(base: DataFrame, share: float, least: int = 40) -> set[int]:
    """Terms in more than ``share`` of the documents of some language, more than most subjects have.

    Counted over all documents; languages are compared without case, of unknown language is a group of its own, groups
    under ``least`` documents say nothing. What is returned is bounded: few terms can be in so many documents."""
    size = base.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    agg = base.select("lang", F.explode("bs").alias("b")).groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    return {r["b"] for r in agg.join(size, "lang").filter(F.col("n") > share * F.col("size")).select("b").distinct().collect()}


def _settled(base: DataFrame, mention: dict[int, int], n_s: int) -> DataFrame:
    """(b, s, n): the terms of the documents whose subject the mentions settle beyond doubt; b = -1 counts documents."""
    of = np.full(1 << BITS, -1, np.int16)
    of[list(mention)] = list(mention.values())
    shared = base.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        for pdf in batches:
            lens = pdf["bs"].map(len).to_numpy()
            if not lens.sum():
                continue
            flat = np.concatenate([np.asarray(x, np.int64) for x in pdf["bs"]])
            doc = np.repeat(np.arange(len(lens)), lens)
            s = of[flat]
            on = s >= 0
            c = np.bincount(doc[on] * n_s + s[on], minlength=len(lens) * n_s).reshape(-1, n_s)
            two = np.sort(np.c_[c, np.zeros(len(c), int)], axis=1)[:, -2:]
            sure = (two[:, 1] >= 3) & (two[:, 0] * 4 < two[:, 1])
            best = c.argmax(1)
            keys, n = np.unique(np.r_[(flat[sure[doc]] + 1) * n_s + best[doc[sure[doc]]], best[sure]], return_counts=True)
            yield pd.DataFrame({"b": (keys // n_s - 1).astype(np.int32), "s": (keys % n_s).astype(np.int32), "n": n.astype(float)})

    return base.select("bs").mapInPandas(count, "b int, s int, n double").groupBy("b", "s").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], *, doc: str, text: str, source: str, subject: str, lang: str | None = None, max_train: int = 20_000, rounds: int = 2, purity: float = 0.65, common: float = 0.18, least: float = 1.0) -> Model:
    """A fitted :class:`Model`. At most ``max_train`` labelled documents (by hash of their key) are used for fitting, a
    documented bound; the counts of self-training cover all documents and all words. Texts stay on the executors: to the
    driver come counts and features. A term needs ``least`` labelled documents, or TRUST times as many that self-training
    settled, to have a weight. Labels of unknown documents or subjects and repeated labels are dropped; of a document with
    several labels all count. Without labels no subject is ever assigned."""
    n_s = len(subjects)
    index = F.create_map(*(F.lit(x) for i, s in enumerate(subjects) for x in (s, i)))
    lab = labels.select(F.col(doc).alias("d"), F.col(subject).alias("s")).dropna().filter(F.col("s").isin(subjects)).distinct()
    lab = lab.groupBy("d").agg(F.sort_array(F.collect_list(index[F.col("s")])).alias("ss"))
    code = F.lower(F.trim(F.coalesce(F.col(lang), F.lit("")))) if lang else F.lit("")
    whole = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"), F.col(source).alias("src"), code.alias("lang")).filter("t is not null AND trim(t) <> ''")
    # words once; a document keeps a few bytes for each of its own
    base = cut(whole.select("d", "lang", term_numbers(F.col("t")).alias("bs")))
    ids = cut(lab.join(whole.select("d"), "d", "left_semi").orderBy(F.xxhash64("d"), "d").limit(max_train))
    fold = F.pmod(F.xxhash64("d", F.lit(1)), F.lit(3)).cast("int")
    sample = cut(whole.join(F.broadcast(ids), "d").select("d", "t", "src", "ss", fold.alias("fold"), term_numbers(F.col("t")).alias("bs")))
    gold = sample.select("bs", F.explode("ss").alias("s"), (1.0 / F.size("ss")).alias("n"))
    totals = np.zeros(n_s)
    for r in gold.groupBy("s").agg(F.sum("n").alias("n")).collect():
        totals[r["s"]] = r["n"]
    given = cut(gold.select(F.explode("bs").alias("b"), "s", "n").groupBy("b", "s").agg(F.sum("n").alias("n")))
    # where the labels have seen a term often enough they say themselves whether it belongs to a subject
    well = {r["b"] for r in given.groupBy("b").agg(F.sum("n").alias("n")).filter(F.col("n") >= ENOUGH).select("b").collect()}
    dull = common_terms(base, common) - well
    drop = lambda lex: {b: sp for b, sp in lex.items() if b not in dull}
    pure = lambda lex: {b: max(sp, key=lambda x: x[1])[0] for b, sp in lex.items() if max(p for _, p in sp) >= purity}
    lex = drop(_judge(given, totals, least))
    by_labels = {b: sp for b, sp in lex.items() if b in well}
    model = Model(subjects, mention=pure(lex))
    for _ in range(rounds):
        settled = cut(_settled(base, model.mention, n_s))
        tot = TRUST * totals
        for r in settled.filter("b = -1").collect():
            tot[r["s"]] += r["n"]
        both = settled.filter("b >= 0").unionByName(given.withColumn("n", TRUST * F.col("n")))
        # terms that the labels alone can judge are judged by them, whatever self-training made of them
        lex = {b: sp for b, sp in drop(_judge(both, tot, TRUST * least)).items() if b not in well} | by_labels
        model.mention = pure(lex)
    model.soft = {b: [(s, p - SOFT / 2) for s, p in sp] for b, sp in lex.items()}
    _fit_frames(model, sample)
    n = np.zeros((n_s, n_s))
    docs_of: dict[str, np.ndarray] = {}
    total, freq = 0, np.zeros(n_s)
    for r in sample.groupBy(F.lower(F.trim(F.coalesce("src", F.lit("")))).alias("src"), "ss").agg(F.count(F.lit(1)).alias("n")).collect():
        total += r["n"]
        seen = docs_of.setdefault(r["src"], np.zeros(n_s + 1))
        seen[n_s] += r["n"]
        for s in r["ss"]:
            freq[s] += r["n"]
            seen[s] += r["n"]
            for t in r["ss"]:
                n[s, t] += r["n"] * (s != t)
    model.order = sorted(range(n_s), key=lambda s: (-freq[s], s))
    model.cooc = np.log((n + 0.5) / (np.outer(freq, freq) / max(total, 1) + 0.5))
    rate = (freq + 1) / (total + 2)
    model.sources = {src: np.log((c[:n_s] + 10 * rate) / (c[n_s] + 10)) - np.log(rate) for src, c in docs_of.items()}
    x, y, of, folds = _chain_rows(model, sample)
    model.links, model.platt = _fit_links(x, y, of, folds, n_s, PRIOR)
    return model


def _chain_rows(model: Model, sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of links, decisions, subjects, folds): a row per labelled document and subject, in the order of the
    chain, with the true labels before it. The measures are taken on the executors."""
    shared = sample.sparkSession.sparkContext.broadcast(model)
    n_s = len(model.subjects)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = shared.value.measure(pdf["t"].tolist())
            yield pdf[["src", "ss", "fold"]].assign(m=list(m.reshape(len(m), -1)), length=pdf["t"].str.len().astype(float))

    got = sample.select("t", "src", "ss", "fold").mapInPandas(run, "src string, ss array<int>, fold int, m array<double>, length double").toPandas()
    m = np.array(got["m"].tolist(), float).reshape(-1, n_s, 6)
    x = model.features(m, got["length"].to_numpy(float), got["src"].tolist())
    y = np.zeros((len(got), n_s))
    for i, ss in enumerate(got["ss"]):
        y[i, list(ss)] = 1.0
    extra = np.zeros((len(got), n_s, len(CHAIN)))
    before = np.zeros(y.shape)
    for s in model.order:
        k = before.sum(1)
        extra[:, s] = np.c_[k == 1, k > 1, before @ model.cooc[s]]
        before[:, s] = y[:, s]
    x = np.concatenate([x, extra], axis=2)
    of = np.broadcast_to(np.arange(n_s), y.shape)
    return x.reshape(-1, x.shape[2]), y.ravel(), of.ravel(), np.repeat(got["fold"].to_numpy(int), n_s)


def _fit_frames(model: Model, sample: DataFrame) -> None:
    """Log odds of genuine against passing mention for the other words of a sentence and its number of mentions.

    Words are counted on the executors; those of five or more sentences of the sample come to the driver."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            n: Counter = Counter()
            seen: dict = {}
            for t, ss in zip(pdf["t"], pdf["ss"]):
                for got, _ in m.sentences(t, seen):
                    hits = [s for s, _, _, _ in got if s >= 0]
                    if hits:
                        good = any(s in ss for s in hits)
                        n.update((w, good) for w in {"", f"#{min(3, len(hits))}", *(w for s, _, _, w in got if s < 0)})
            yield pd.DataFrame([(w, c if g else 0, 0 if g else c) for (w, g), c in n.items()], columns=["w", "g", "b"])

    agg = sample.select("t", "ss").mapInPandas(count, "w string, g long, b long").groupBy("w").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    rows = {r["w"]: (r["g"], r["b"]) for r in agg.filter("g + b >= 5 OR w = ''").collect()}
    n_good, n_bad = rows.pop("", (0, 0))
    model.frame_prior = min(3.0, math.log((n_good + 1) / (n_bad + 1)))
    for w, (g, b) in rows.items():
        odds = math.log((g + 0.5) / (n_good + 1)) - math.log((b + 0.5) / (n_bad + 1))
        if abs(odds) > 0.5:
            model.frames[w] = max(-4.0, min(1.5, odds)) * (1.0 if b >= 2 or odds > 0 else 0.5)


def assign(docs: DataFrame, model: Model, *, doc: str, text: str, source: str) -> DataFrame:
    """(doc, subject), one row per subject of each document; null, blank and subjectless texts have none. Exact copies
    are decided alike; whole texts are read; extra columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m.subjects, object)
        for pdf in batches:
            if len(pdf):
                i, s = np.nonzero(m.label(pdf["t"].tolist(), pdf["src"].tolist()))
                yield pd.DataFrame({"d": pdf["d"].to_numpy()[i], "subject": names[s]})

    src = docs.select(F.col(doc).alias("d"), F.col(text).alias("t"), F.col(source).alias("src")).filter(F.col("t").isNotNull())
    return src.mapInPandas(run, f"d {kind}, subject string").withColumnRenamed("d", doc)


def composition(assigned: DataFrame, docs: DataFrame, *, doc: str) -> DataFrame:
    """(subject, documents, share): a document with two subjects counts half for each; '' stands for none."""
    per = assigned.groupBy(doc).agg(F.count(F.lit(1)).alias("k"))
    rows = docs.select(doc).join(assigned, doc, "left").join(per, doc, "left").select(F.coalesce("subject", F.lit("")).alias("subject"), (1 / F.coalesce("k", F.lit(1))).alias("w"))
    by = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("w").alias("w"))
    return by.select("subject", "documents", F.round(F.col("w") / by.agg(F.sum("w")).scalar(), 6).alias("share"))
