"""Personal data by weak supervision, in DataFrame and SQL functions only.

One narrow pass finds candidate spans in every whole text. Three labelers then vote on each candidate,
for (1), against (-1) or not at all (0): a regex labeler judges its form and checksum, a gazetteer
labeler looks up its parts in lists, a context labeler looks for words before it. Vote patterns are
counted by Spark; their number is bounded by kinds x 3^3. From these counts expectation-maximisation
estimates each kind's prior and, for each kind by itself, each labeler's reliability (a two-class Dawid-Skene
model), which gives each pattern the probability that its spans are real. A labeler may turn out useless for a
kind, but its votes never change their meaning. With these as soft labels a logistic span classifier is trained
on the counts of feature patterns (again bounded; all kinds weigh the same), and its score is one more Spark expression. Candidates of the base kinds are spans whatever it says, as the contract has
it; others are spans if their probability is half or more.

Edge cases. A null or empty text has no spans. Repeated rows are judged each. An empty table gives an
empty result; with no candidates the classifier keeps its starting weights. Very long texts: no
pattern here needs more than one pass; groups repeat possessively, which Java matches in a loop, or 19 times at most. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Kinds in the order of the span list; the first four are the contract's.
BASE_KINDS = ("email", "ip", "card", "phone")
_WORD_CHARS = r"[A-Za-z0-9._%+-]"
_KEY = r"(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)"
#: kind: (what a text must hold to be searched, pattern). Each pattern says how far left it may start,
#: so that a scan never restarts within one run of characters; \G is the end of the last match.
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{_WORD_CHARS})){_WORD_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (r"(?i)[a-z]", rf"""(?i:(?<![A-Za-z]){_KEY})[\x20"']{{0,3}}[:=][\x20"']{{0,3}}[A-Za-z0-9_/+.-]{{8,}}+"""),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
}
KINDS = tuple(PATTERNS)
CONTEXT_CHARS = 40
SOME = 512

#: Endings and codes that addresses and numbers have, and words that announce them.
TOP_DOMAINS = "com org net edu gov mil int info biz io co de fr es uk it nl eu us ca au ch at be pt br mx ar jp cn in ru se no fi dk pl".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
KEY_PREFIXES = "ghp_ gho_ github_pat_ glpat- sk- sk_live_ pk_live_ AKIA ASIA xoxb- xoxp- AIza eyJ".split()
PLACEHOLDERS = "example changeme placeholder your_ dummy xxxx 12345678 password".split()
SAMPLE_SSNS = "078-05-1120 219-09-9999 123-45-6789 987-65-4320 987-65-4329".split()
IBAN_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split()
CONTEXT_WORDS = {
    "email": "mail e-mail email contact write address contacto correo kontakt adresse courriel",
    "ip": "ip host server address client login from addr adresse",
    "card": "card visa mastercard credit debit payment karte carte tarjeta",
    "phone": "phone tel call mobile fax cell telefon téléphone teléfono",
    "secret": "key token secret password login auth config export",
    "ssn": "ssn social security tax insurance",
    "iban": "iban account bank konto compte cuenta transfer",
}


def _scan(text: Column, kind: str) -> Column:
    """The kind's leftmost non-overlapping matches as structs, with what stands before each."""
    hint, pattern = PATTERNS[kind]
    spans = "array<struct<kind:string,start:bigint,end:bigint,text:string,before:string>>"
    empty = F.array().cast(spans)
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"), F.regexp_extract_all(text, whole, F.lit(2)).alias("hit"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["hit"].alias("text"), F.substring(p["gap"], -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"))
        full = F.size(acc["some"]) >= SOME  # spans are gathered in two levels, as each array is copied when it grows
        more = F.struct(end.alias("at"), F.when(full, F.array(span)).otherwise(F.concat(acc["some"], F.array(span))).alias("some"), F.when(full, F.concat(acc["all"], F.array(acc["some"]))).otherwise(acc["all"]).alias("all"))
        return F.when(p["hit"] == "", acc).otherwise(more)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("some"), F.array().cast(f"array<{spans}>").alias("all"))
    found = F.aggregate(pairs, start, step, lambda a: F.flatten(F.concat(a["all"], F.array(a["some"]))))
    return F.when(text.rlike(hint), F.filter(found, _passes[kind])).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check; every second one from the right is doubled."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


_passes = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s["text"].rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda s: _luhn(_digits(s["text"])),
    "phone": lambda s: F.char_length(_digits(s["text"])).between(9, 15),
    "secret": lambda s: F.lit(True),
    "ssn": lambda s: F.lit(True),
    "iban": lambda s: F.lit(True),
}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: the candidate spans of every text, kind by kind in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    return d.select("doc_id", F.concat(*(_scan(F.col("text"), k) for k in KINDS)).alias("spans"))


def _has_word(value: Column, words: str) -> Column:
    return F.lower(value).rlike(rf"(?<!\p{{L}})(?:{'|'.join(words.split())})(?!\p{{L}})")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _has_any(value: Column, starts: list[str]) -> Column:
    """Whether a value after : or = begins with one of starts."""
    return value.rlike(rf"""[:=][\x20"']*(?:{'|'.join(starts)})""")


def votes(s: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate."""
    kind, text, digits = s["kind"], s["text"], _digits(s["text"])
    by = lambda cases, other=F.lit(0): F.coalesce(*(F.when(kind == k, v) for k, v in cases.items()), other)
    form = by({
        "email": _vote(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,3}\.[A-Za-z]{2,}$"), text.rlike(r"^[._%+-]|\.-|-\.")),
        "ip": _vote(text.rlike(r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$"), text.rlike(r"^0|\.0[0-9]")),
        "card": _vote(F.char_length(digits).isin(14, 15, 16), text.rlike(r"^0")),
        "phone": _vote(text.rlike(r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]"), text.rlike(r"[\x20().-]{4}")),
        "secret": _vote(text.rlike(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]") & (F.char_length(text) >= 24), ~text.rlike(r"[0-9]")),
        "ssn": _vote(~text.rlike(r"^(?:000|666|9)|-00-|0000$"), text.rlike(r"^(?:000|666|9)|-00-|0000$")),
        "iban": _vote(F.char_length(text).between(15, 32), F.lit(False)),
    })
    listed = by({
        "email": _vote(F.lower(F.regexp_extract(text, r"\.([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS), text.rlike(r"\.[0-9]+$")),
        "ip": _vote(~text.rlike(r"^(?:0|127|255)\."), text.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), digits.rlike(r"^[0178]")),
        "phone": _vote(digits.rlike(rf"^(?:{'|'.join(CALLING_CODES)})"), digits.rlike(r"^0")),
        "secret": _vote(_has_any(text, KEY_PREFIXES), _has_any(F.lower(text), PLACEHOLDERS)),
        "ssn": _vote(F.substring(text, 1, 3).cast("int").between(1, 772) & ~text.isin(SAMPLE_SSNS), text.isin(SAMPLE_SSNS)),
        "iban": _vote(F.substring(text, 1, 2).isin(IBAN_COUNTRIES), ~F.substring(text, 1, 2).isin(IBAN_COUNTRIES)),
    })
    context = by({k: _vote(_has_word(F.concat(s["before"], F.when(kind == "secret", text).otherwise("")), w), F.lit(False)) for k, w in CONTEXT_WORDS.items()})
    return {"form": form.cast("int"), "listed": listed.cast("int"), "context": context.cast("int")}


LABELERS = ("form", "listed", "context")


def features(s: Column) -> dict[str, Column]:
    """What the span classifier sees: 0 or 1 each, besides the kind."""
    text = s["text"]
    flags = {
        "long": F.char_length(text) >= 16,
        "mixed": text.rlike("[A-Za-z]") & text.rlike("[0-9]"),
        "quoted": text.rlike("[\"'=:]"),
        "spaced": text.rlike(r"[\x20()-]"),
        "cue": F.greatest(*(F.when(s["kind"] == k, _has_word(s["before"], w)).otherwise(False) for k, w in CONTEXT_WORDS.items())),
        "edge": ~s["before"].rlike(r"[A-Za-z0-9]$"),
    }
    return {k: v.cast("int") for k, v in flags.items()}


FEATURES = ("long", "mixed", "quoted", "spaced", "cue", "edge")


#: What a labeler is taken to vote on unreal (0) and real (1) candidates before it is seen, and for how many candidates that stands.
TRUST = {0: {1: 0.2, 0: 0.3, -1: 0.5}, 1: {1: 0.6, 0: 0.3, -1: 0.1}}
TRUST_COUNT = 4.0


def fit_em(counts: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """The probability that spans of each (kind, vote, vote, vote) are real, and the model.

    The two-class model: a kind has a prior, and for each kind a labeler has, for each class, a distribution
    over its three votes. A labeler whose votes for would speak against, or the other way round, is useless for
    the kind: both classes get one distribution.
    """
    real: dict[tuple, float] = {}
    model: dict = {"prior": {}, "votes": {}}
    for kind in sorted({p[0] for p in counts}):
        mine = {p: n for p, n in counts.items() if p[0] == kind}
        total, prior = sum(mine.values()), 0.5
        table = {(l, c): dict(TRUST[c]) for l in range(len(LABELERS)) for c in (0, 1)}
        for _ in range(rounds):
            for p in mine:
                yes, no = prior, 1 - prior
                for l, v in enumerate(p[1:]):
                    yes *= table[l, 1][v]
                    no *= table[l, 0][v]
                real[p] = yes / (yes + no)
            prior = (1 + sum(n * real[p] for p, n in mine.items())) / (total + 2)
            for l in range(len(LABELERS)):
                seen = {c: {v: TRUST_COUNT * TRUST[c][v] for v in (1, 0, -1)} for c in (0, 1)}
                for p, n in mine.items():
                    seen[1][p[1 + l]] += n * real[p]
                    seen[0][p[1 + l]] += n * (1 - real[p])
                table[l, 0], table[l, 1] = ({v: x / sum(seen[c].values()) for v, x in seen[c].items()} for c in (0, 1))
                if table[l, 1][1] < table[l, 0][1] or table[l, 1][-1] > table[l, 0][-1]:
                    both = {v: seen[0][v] + seen[1][v] for v in (1, 0, -1)}
                    table[l, 0] = table[l, 1] = {v: x / sum(both.values()) for v, x in both.items()}
        model["prior"][kind] = prior
        model["votes"] |= {(kind, *k): v for k, v in table.items()}
    return real, model


def fit_classifier(rows: list[tuple[str, tuple[int, ...], float, int]], rounds: int = 300, rate: float = 1.0) -> dict[str, float]:
    """Weights of a logistic model from (kind, features, probability, count); one intercept a kind, and each kind weighs the same."""
    weight = {f"kind:{k}": 0.0 for k in KINDS} | {f: 0.0 for f in FEATURES}
    of_kind = {k: sum(n for kind, *_, n in rows if kind == k) for k in {r[0] for r in rows}}
    for _ in range(rounds if of_kind else 0):
        slope = {k: 1e-3 * w for k, w in weight.items()}
        for kind, flags, p, n in rows:
            z = weight[f"kind:{kind}"] + sum(weight[f] for f, on in zip(FEATURES, flags) if on)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / of_kind[kind] / len(of_kind)
            slope[f"kind:{kind}"] += miss
            for f, on in zip(FEATURES, flags):
                if on:
                    slope[f] += miss
        weight = {k: w - rate * slope[k] for k, w in weight.items()}
    return weight


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from candidates()."""
    c = found.select(F.explode("spans").alias("s"))
    c = c.select(F.col("s.kind").alias("kind"), *(v.alias(k) for k, v in votes(F.col("s")).items()), *(v.alias(k) for k, v in features(F.col("s")).items()))
    patterns = c.groupBy("kind", *LABELERS, *FEATURES).count().collect()  # at most kinds * 3^3 * 2^6 rows
    counts: dict[tuple, int] = {}
    for r in patterns:
        key = (r["kind"], *(r[x] for x in LABELERS))
        counts[key] = counts.get(key, 0) + r["count"]
    if not counts:
        return fit_classifier([])
    real, _ = fit_em(counts)
    return fit_classifier([(r["kind"], tuple(r[f] for f in FEATURES), real[r["kind"], *(r[x] for x in LABELERS)], r["count"]) for r in patterns])


def probability(s: Column, weight: dict[str, float]) -> Column:
    z = F.coalesce(*(F.when(s["kind"] == k, F.lit(weight[f"kind:{k}"])) for k in KINDS))
    for k, flag in features(s).items():
        z = z + weight[k] * flag
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, text, probability) of every row, by kind and place."""
    found = cut(candidates(docs))
    weight = train(found)
    judged = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), probability(s, weight).alias("probability")))
    return found.select("doc_id", F.filter(judged, lambda s: s["kind"].isin(*BASE_KINDS) | (s["probability"] >= 0.5)).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    done = F.aggregate(ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then how many spans the method adds, by kind, and how many there are in all."""
    d = find(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = _listed(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS)))
    added = [n(k) for k in KINDS if k not in BASE_KINDS]
    return d.select("doc_id", *(n(k) for k in BASE_KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *added, F.size("spans").cast("long").alias("n_spans"))
