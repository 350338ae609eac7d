"""Variant spellings of names typed by people: noisy-channel attribution to canonical forms.

A row's name and email are read as evidence: a full pair of name parts, a part with an initial, a part with the first
letters of the other, a run-together form, a handle, an organisation. Full pairs and organisations are the candidate
canonical forms; their prior is how often they are spelled so, in names and in emails. Every piece of evidence becomes keys of the
canonical forms that could have produced it (exact, initial, prefix, nickname, one edit away), each with a likelihood;
all forms of a key are kept, whatever their rank. Prior and likelihoods are combined and a row is attached to the form
with the greatest posterior, unless a second form comes too close. Handles, mailboxes of one person and an earlier
partial resolution then join forms; connected components of forms are the entities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.operators.graph import components
from codequarry.session import cut

# Short forms people use and the given names they may stand for.
NICKNAMES = {
    "tim": "timothy", "tom": "thomas tomasz", "rob": "robert", "bob": "robert", "bobby": "robert", "bert": "robert", "bill": "william", "will": "william", "billy": "william",
    "beth": "elizabeth", "liz": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "kate": "katharina katherine catherine", "kathi": "katharina", "katie": "katherine", "kathy": "katherine katharina",
    "tony": "anthony", "ned": "edward", "ed": "edward", "eddie": "edward", "ted": "theodore edward", "teddy": "theodore", "theo": "theodore", "kit": "christopher", "chris": "christopher christian christine", "danny": "daniel", "dan": "daniel",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret", "micha": "michael", "mike": "michael", "mick": "michael", "fina": "josefina",
    "sam": "samantha samuel", "sammy": "samantha samuel", "alex": "alexander alexandra", "sasha": "alexander alexandra", "sandy": "alexander alexandra", "xander": "alexander", "jo": "johannes joanna josefina", "hannes": "johannes", "jon": "jonathan", "johnny": "john", "jack": "john",
    "isa": "isabella", "bella": "isabella", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "richie": "richard", "andy": "andrew", "drew": "andrew", "ben": "benjamin", "benny": "benjamin", "niko": "nikolaus", "klaus": "nikolaus", "nick": "nicholas nikolaus",
    "leo": "leonardo leonard", "paco": "francisco", "fran": "francisco francesca", "frank": "francis francisco", "gabi": "gabriela", "gaby": "gabriela", "susie": "susannah susan", "sue": "susannah susan", "susi": "susannah", "suzy": "susannah", "dora": "dorothea", "dot": "dorothy dorothea", "thea": "dorothea", "joe": "joseph", "jim": "james", "jimmy": "james",
    "kim": "kimberly", "matt": "matthew", "dave": "david", "steve": "stephen steven", "greg": "gregory", "jen": "jennifer", "jenny": "jennifer", "vic": "victor viktor", "vik": "viktor", "vicky": "victoria", "nate": "nathaniel", "max": "maximilian", "uli": "ulrich ursula", "ulla": "ursula", "seb": "sebastian",
}
# Words that are no part of a person's name, words of organisations and groups, mailboxes of groups,
# mailboxes of machines, and what people and programs type when they give no name.
_NOISE = frozenset("dr prof mr mrs ms phd msc md jr sr the ii iii".split())
_ORG = frozenset("gmbh inc ltd llc ag corp corporation company software systems laboratories labs collective foundation association institute university authors team project group".split())
_GROUP = frozenset("contact hello info oss opensource code team office mail support".split())
_ROLE = _GROUP | frozenset("admin dev build root noreply webmaster postmaster git".split())
_EMPTY = frozenset("unknown developer user root admin nobody anonymous none test dev author me git noname name your null".split())
# Top-level domains that name no real host, and second levels that are no host's own name.
_RESERVED = frozenset("invalid test localhost local".split())
_SECOND = frozenset("co com org ac net gov edu".split())
# Letters that carry no diacritic apart but stand for Latin ones, and romanised Cyrillic and Greek.
_FOLD = str.maketrans(
    {"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "Ae", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
    | {c: x for c, x in zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў", "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya i yi ye g u".replace("-", "").split(" "))}
    | {c: x for c, x in zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split())}
)
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_CAMEL = regex.compile(r"(\p{Ll})(\p{Lu})")
_PAREN = re.compile(r"\([^)]*\)")
_VIA = re.compile(r"\s+via\s+.*$", re.I | re.S)
_WORDLESS = regex.compile(r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}]{2,4}")


def fold(s: str) -> str:
    """Without diacritics, in lower case, Cyrillic and Greek romanised; letters of other scripts stay."""
    if s.isascii():
        return s.lower()
    low = unicodedata.normalize("NFKC", s).lower().translate(_FOLD)
    # marks that make a letter of its own (nukta, kana voicing, virama) stay
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", low) if unicodedata.combining(c) in (0, 7, 8, 9))).translate(_FOLD)


def _full(p: str) -> bool:
    """More than an initial: two letters, or one of a script without letters for sounds."""
    return len(p) > 1 or p >= "⺀"


def _org_word(token: str, at_end: str) -> bool:
    """A word of organisations, or its first letters with a full stop."""
    return token in _ORG or (at_end == "." and len(token) >= 3 and any(w.startswith(token) for w in _ORG))


def name_parts(name: str | None) -> tuple[list[str], str]:
    """(parts, kind): kind is person, org, bot, handle or none. One-letter parts are initials; order is dropped.

    An organisation has one part, its words without those that say what kind of body it is. A name in Han, Hangul or
    kana without a blank is taken as a family name of one sign and a given name."""
    if not name or not name.strip():
        return [], "none"
    raw = _VIA.sub("", _PAREN.sub(" ", name.strip()))
    low = fold(raw)
    if "[bot]" in low:
        return [low], "bot"
    tokens = [(m.group(), low[m.end() : m.end() + 1]) for m in _TOKEN.finditer(low)]
    if len(tokens) > 1 and any(_org_word(*t) for t in tokens):
        core = "".join(t for t, end in tokens if not _org_word(t, end) and t not in _NOISE)
        return ([core] if len(core) > 1 else []), "org"
    flat = fold(_CAMEL.sub(r"\1 \2", raw))
    parts = [t for t in _TOKEN.findall(flat) if t not in _NOISE]
    if len(parts) == 1 and _WORDLESS.fullmatch(parts[0]):
        return sorted((parts[0][0], parts[0][1:])), "person"
    if any(any(c.isdigit() for c in p) for p in parts):
        return ["".join(parts)], "handle"
    full = [p for p in parts if _full(p)]
    if len(full) == 1 and len(parts) == 1:
        return full, "none" if full[0] in _EMPTY else "handle"
    if len(full) >= 2:  # a middle initial says nothing that the full parts don't
        return sorted({full[0], full[-1]}), "person"
    return sorted(parts, key=len)[-2:] if len(parts) >= 2 else [], "person" if len(parts) >= 2 else "none"


def _pair(a: str, b: str) -> str:
    return f"{min(a, b)}|{max(a, b)}"


def host_of(domain: str) -> str:
    """The label of a domain that its owner chose; nothing for reserved domains."""
    labels = [x for x in domain.split(".") if x]
    if len(labels) < 2 or labels[-1] in _RESERVED:
        return ""
    return labels[-3] if len(labels) > 2 and labels[-2] in _SECOND else labels[-2]


def evidence(name: str | None, others: list[str], email: str | None) -> tuple[list[tuple[str, str]], str, str, str]:
    """([(form, key)], canonical form that the email spells, handle, own label of the domain) of one row.

    Forms: pair (two full parts), org (an organisation), init (part|initial), pre (part|first letters), run (run-together
    local part). A single given name is no evidence: too many people share it. The mailbox of a group names its
    organisation where no person is named.
    """
    ev: list[tuple[str, str]] = []
    handle = strong = ""
    mail = fold((email or "").strip())
    local, _, domain = mail.partition("@")
    host = host_of(domain)
    for nm in dict.fromkeys([name, *others]):
        parts, kind = name_parts(nm)
        if kind == "org" and parts:
            ev.append(("org", parts[0]))
        elif kind == "bot":
            handle = handle or f"bot:{parts[0]}"
        elif kind == "handle" and parts:
            p = parts[0]
            if any(c.isdigit() for c in p):
                handle = handle or p
            else:
                ev.append(("run", p))
        elif kind == "person" and len(parts) == 2:
            a, b = sorted(parts, key=_full)
            ev.append(("pair", _pair(a, b)) if _full(a) else ("init", f"{b}|{a}"))
    if local in _GROUP:
        if len(host) > 1 and not handle and all(f == "org" for f, _ in ev):
            ev.append(("org", host))
            strong = f"org={host}"
    elif local and local not in _ROLE:
        if "[bot]" in local:
            handle = handle or f"bot:{local.rpartition('+')[2]}"
        bits = [b for b in re.split(r"[._\-+]+", local) if b]
        letters = [b.rstrip("0123456789") for b in bits]
        if len(bits) == 2 and all(len(x) > 1 and x.isalpha() for x in letters):
            numbered = bits[1] != letters[1] or bits[0] != letters[0]
            if numbered:  # the part before the number may be cut short
                ev.append(("pre", f"{letters[0]}|{letters[1]}"))
            else:
                ev.append(("pair", _pair(*letters)))
                strong = f"pair={_pair(*letters)}"
        elif len(bits) == 1 and letters[0].isalpha() and len(letters[0]) > 3:
            ev.append(("run", letters[0]))
    return list(dict.fromkeys(ev)), strong, handle, "" if local in _ROLE else host


def _deletes(a: str) -> set[str]:
    """The word and all ways to leave one letter out; short words have too few letters to tell a slip from a name."""
    return {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))} if len(a) > 3 else set()


#: Log likelihoods of the ways a spelling arises from a canonical form; fixed weights of the channel.
CHANNEL = {"pair": 0.0, "nick": -1.5, "typo": -2.0, "run": -1.0, "pre": -1.0, "init": -2.0}
#: Log likelihood of a piece of evidence that a form does not explain.
MISS = -6.0
PREFIX = 6


def keys_of_form(form: str) -> list[tuple[str, str]]:
    """(key, way) of all spellings that the canonical form, ``pair=a|b`` or ``org=a``, may produce."""
    out = [(form, "pair")]
    kind, _, value = form.partition("=")
    if kind == "org":
        return out + [(f"name:{d}", "typo") for d in _deletes(value)]
    a, b = value.split("|")
    for x, y in ((a, b), (b, a)):
        out += [(f"init:{x}|{y[0]}", "init"), (f"pre:{x}|{y[:PREFIX]}", "pre"), (f"run:{x[0]}{y}", "run"), (f"run:{x}{y[0]}", "run"), (f"run:{x}{y}", "run")]
        out += [(f"typo:{x}|{d}", "typo") for d in _deletes(y)]
    return list(dict.fromkeys(out))


def keys_of_evidence(form: str, value: str, typos: bool = True) -> list[tuple[str, str]]:
    """(key, way) under which a piece of evidence looks for canonical forms."""
    if form == "org":
        return [(f"org={value}", "pair"), *((f"name:{d}", "typo") for d in (_deletes(value) if typos else ()))]
    if form != "pair":
        a, _, b = value.partition("|")
        out = [(f"{form}:{value}", form)] if form != "pre" else [(f"pre:{a}|{b[:PREFIX]}", "pre"), (f"pair={_pair(a, b)}", "pair")]
        if form == "init":
            out += [(f"init:{full}|{b}", "nick") for full in NICKNAMES.get(a, "").split()]
        return out
    a, b = value.split("|")
    out = [(f"pair={value}", "pair")]
    for x, y in ((a, b), (b, a)):
        slips = _deletes(y) if typos else ()
        out += [(f"typo:{x}|{d}", "typo") for d in slips]
        for full in NICKNAMES.get(x, "").split():
            out.append((f"pair={_pair(full, y)}", "nick"))
            out += [(f"typo:{full}|{d}", "typo") for d in slips]
    return list(dict.fromkeys(out))


def link_names(df: DataFrame, *, key: str, name: str, names: str | None, email: str, known: DataFrame | None = None, known_id: str = "id", known_emails: str = "emails", min_margin: float = 0.7) -> DataFrame:
    """(key, entity): every row that could be attached, with the name of its person or organisation.

    Names and emails may be null or empty; case, blanks and diacritics do not count. A mailbox used under two or more
    clearly different canonical forms identifies nobody. Rows of placeholders that fit no form alone have no row.
    ``known`` joins the canonical forms of the emails of each of its rows. Keys must be unique.
    """
    src = df.select(F.col(key).alias("k"), F.col(name).alias("n"), (F.col(names) if names else F.array().cast("array<string>")).alias("ns"), F.lower(F.trim(F.col(email))).alias("m"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, n, ns, m in zip(pdf["k"], pdf["n"], pdf["ns"], pdf["m"]):
                ev, strong, handle, site = evidence(n, [x for x in (ns if ns is not None else []) if x], m)
                rows.append((k, m, [f"{a}={b}" for a, b in ev], strong, handle, site))
            yield pd.DataFrame(rows, columns=["k", "m", "ev", "strong", "handle", "site"])

    kind = df.schema[key].dataType.simpleString()
    ev = cut(src.mapInPandas(read, f"k {kind}, m string, ev array<string>, strong string, handle string, site string"))
    # candidate canonical forms: full pairs and organisations; those spelled in an email count more, as typos are rare there
    spelled = ev.select(F.explode("ev").alias("form"), "strong").filter(F.col("form").rlike("^(pair|org)=")).select("form", (F.col("strong") == F.col("form")).alias("st"))
    forms = cut(spelled.groupBy("form").agg((F.count(F.lit(1)) + 2 * F.count_if("st")).alias("freq"), F.count_if("st").alias("mails")))

    def form_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(kk, way, f, q, ml) for f, q, ml in zip(pdf["form"], pdf["freq"], pdf["mails"]) for kk, way in keys_of_form(f)]
            yield pd.DataFrame(rows, columns=["key", "way", "form", "freq", "mails"])

    def ask_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a spelling that an email confirms is no typo
            rows = [(v, kk, way) for v, ok in zip(pdf["v"], pdf["confirmed"]) for kk, way in keys_of_evidence(*v.split("=", 1), typos=not ok)]
            yield pd.DataFrame(rows, columns=["v", "key", "way"])

    spell = cut(forms.mapInPandas(form_keys, "key string, way string, form string, freq long, mails long"))
    table = spell.join(spell.groupBy("key").agg(F.count(F.lit(1)).alias("n_forms")), "key").select("key", "form", "freq", "mails", "n_forms")
    mailed = forms.filter("mails > 0").select(F.col("form").alias("v"), F.lit(True).alias("c"))
    values = ev.select(F.explode("ev").alias("v")).distinct().join(mailed, "v", "left").select("v", F.coalesce("c", F.lit(False)).alias("confirmed"))
    asked = values.mapInPandas(ask_keys, "v string, key string, way string")
    weight = F.create_map(*(F.lit(x) for kv in CHANNEL.items() for x in kv))
    # prior: how often the form is spelled; one that no email spells is more likely somebody's typo or short form
    found = asked.join(table, "key").select("v", "form", (1.5 * F.log("freq") - F.when(F.col("mails") == 0, 2.0).otherwise(0.0)).alias("prior"), (weight[F.col("way")] - F.when(F.col("way") != "pair", F.log(F.col("n_forms").cast("double"))).otherwise(0.0)).alias("ll"))
    # every form of a key counts: a value has few keys and a key few values, so this grows with the forms. What a hit gains
    # over a miss is never negative, however many forms share the key.
    per_value = cut(found.groupBy("v", "form").agg(F.max("prior").alias("prior"), F.max("ll").alias("ll")).select("v", "form", "prior", F.greatest(F.col("ll") - MISS, F.lit(0.0)).alias("gain")))
    # A row's two best forms are found exactly without listing all forms of its most shared value, ``wide``: a form that
    # another value hits comes from there and is looked up in ``wide``; of those that only ``wide`` hits two can matter.
    fan = per_value.groupBy("v").agg(F.count(F.lit(1)).alias("fan"))
    lead = Window.partitionBy("v").orderBy((F.col("prior") + F.col("gain")).desc(), "form")
    leaders = per_value.withColumn("rn", F.row_number().over(lead)).filter("rn <= 2").drop("rn")
    hits = ev.select("k", F.size("ev").alias("n_ev"), F.explode("ev").alias("v")).join(fan, "v").groupBy("k", "n_ev").agg(F.sort_array(F.collect_list(F.struct("fan", "v")), asc=False)["v"].alias("vs"))
    hits = cut(hits.select("k", "n_ev", F.col("vs")[0].alias("wide"), F.slice("vs", F.lit(2), F.size("vs")).alias("rest")))
    some = hits.select("k", "n_ev", "wide", F.explode("rest").alias("v")).join(per_value, "v").groupBy("k", "n_ev", "wide", "form").agg(F.max("prior").alias("prior"), F.sum("gain").alias("gain"))
    also = some.join(per_value.select(F.col("v").alias("wide"), "form", F.col("gain").alias("more")), ["wide", "form"], "left").select("k", "n_ev", "form", "prior", (F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("gain"))
    only = hits.join(leaders.withColumnRenamed("v", "wide"), "wide").select("k", "n_ev", "form", "prior", "gain")
    post = also.unionByName(only).groupBy("k", "form").agg(F.max(F.col("prior") + F.col("gain") + MISS * F.col("n_ev")).alias("score"))
    w = Window.partitionBy("k").orderBy(F.desc("score"), "form")
    ranked = post.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("r = 1")
    attached = ranked.filter(F.col("next").isNull() | (F.col("score") - F.col("next") >= min_margin)).select("k", "form")
    # a domain of one's own goes under the handle that its owner uses as a name
    used = ev.filter("handle <> ''").select(F.col("handle").alias("site")).distinct().withColumn("own", F.lit(True))
    handle = F.when((F.col("handle") == "") & F.col("own"), F.col("site")).otherwise(F.col("handle"))
    got = cut(ev.select("k", "m", "handle", "site").join(attached, "k", "left").join(used, "site", "left").select("k", "m", handle.alias("handle"), "form"))
    # mailboxes and handles of one form, for the rows that have nothing else
    clear = lambda col: got.filter(F.col("form").isNotNull() & (F.col(col) != "")).groupBy(col).agg(F.count_distinct("form").alias("c"), F.min("form").alias(f"f_{col}")).filter("c = 1").drop("c")
    got = got.join(clear("m"), "m", "left").join(clear("handle"), "handle", "left")
    node = F.coalesce("form", "f_handle", "f_m", F.when(F.col("handle") != "", F.concat(F.lit("handle:"), "handle")))
    got = cut(got.select("k", "m", "handle", node.alias("node")).filter("node is not null"))
    # forms joined by an earlier resolution, and by a handle that only ever goes with them
    edges = got.sparkSession.createDataFrame([], "src string, dst string")
    if known is not None:
        mails = known.select(F.col(known_id).alias("p"), F.explode(known_emails).alias("m")).select("p", F.lower(F.trim("m")).alias("m"))
        own = got.groupBy("m").agg(F.count_distinct("node").alias("c"), F.min("node").alias("node")).filter("c = 1").select("m", "node")
        first = mails.join(own, "m").groupBy("p").agg(F.min("node").alias("src"), F.collect_set("node").alias("all"))
        edges = edges.union(first.select("src", F.explode("all").alias("dst")))
    handles = got.filter("handle <> ''").groupBy("handle").agg(F.count_distinct("node").alias("c"), F.min("node").alias("src"), F.max("node").alias("dst")).filter("c = 2")
    edges = edges.union(handles.filter("src like 'handle:%' or dst like 'handle:%'").select("src", "dst"))
    comp = components(edges.filter("src <> dst"))
    return got.join(comp, "node", "left").select(F.col("k").alias(key), F.coalesce("component", "node").alias("entity"))


def pairs_within(links: DataFrame, *, key: str, entity: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of rows of one entity, which is what the query asks for."""
    a = links.select(F.col(entity).alias("e"), F.col(key).alias(f"{key}_a"))
    b = links.select(F.col(entity).alias("e"), F.col(key).alias(f"{key}_b"))
    return a.join(b, "e").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
