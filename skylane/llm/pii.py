"""Personal data by weak supervision, in DataFrame operations only.

Candidates are what wide patterns match. Three labelers vote on each (1 for, -1 against, 0 abstains): a strict pattern
(octets, check digit, digit counts), a gazetteer (domains, address ranges, issuer and country prefixes, key names) and
the context (cue words before it). Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is for each kind; the posteriors are soft labels of a final span classifier (naive Bayes over votes, length,
digits and neighbouring characters). Spans that a kind's base definition names always stay; others need the classifier.

Texts are read once: a document's candidates are one array, so nothing but counts is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# The kinds in the order of results, and patterns. Possessive quantifiers and look-behinds only keep
# matching linear: (?:\G|(?<!x)) lets a run of x be tried once, from its start or from where the last match ended.
KINDS = ("email", "ip", "card", "phone", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+",
    "local": r"(?<![0-9+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20.-])?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns that only name candidates of a kind: phone numbers without a country.
_ALSO = {"local": "phone"}
_CUES = {
    "email": r"(?i)(e-?mail|mailto|contact|kontakt|contacto|courriel|correo|write to)\W*\w*\W*$",
    "ip": r"(?i)(\bip\b|host|server|address|adresse|direcci|from)\W*\w*\W*$",
    "card": r"(?i)(card|visa|master|amex|karte|carte|tarjeta|credit|iban|payment)\W*\w*\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|handy|ruf|appel|llam)\W*\w*\W*$",
    "secret": r"(?i)(token|secret|passw|api|key|auth|bearer)\w*\W{0,6}$",
}
# Lists of the gazetteer: what speaks for a span, and what against it.
_DOMAINS = "com org net edu gov mil int info biz io co app dev ai de at ch fr be nl es pt it uk ie eu pl cz se no dk fi us ca mx br au nz in jp".split()
_FILES = "png jpg jpeg gif svg webp css js json html htm php pdf".split()
_RESERVED = "0. 10. 127. 169.254. 172.16. 172.31. 192.0.2. 192.168. 198.51.100. 203.0.113. 224. 239. 240. 255.".split()
_NEVER_HOSTS = "0. 127. 255.".split()
_ISSUERS = "34 36 37 4 50 51 52 53 54 55 56 57 58 60 62 64 65 67 22 23 24 25 26 27 35".split()
_COUNTRIES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 971 972".split()
_KEYS = "sk- sk_ pk_ ghp_ gho_ AKIA ASIA xoxb xoxp eyJ AIza glpat-".split()


def _any(values: list[str]) -> str:
    return "(?:" + "|".join(v.replace(".", r"\.") for v in values) + ")"


_GAZETTEER = {
    "email": (rf"(?i)\.{_any(_DOMAINS)}$", rf"(?i)\.{_any(_FILES)}$"),
    "ip": (rf"^(?!{_any(_RESERVED)})", rf"^{_any(_NEVER_HOSTS)}"),
    "card": (rf"^{_any(_ISSUERS)}", r"^[01]"),
    "phone": (rf"^\+{_any(_COUNTRIES)}", r"^\+0"),
    "secret": (rf"^{_any(_KEYS)}", r"^[A-Za-z]+$|^[-=_+/]+$"),
}
CANDIDATE = "struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,traits:array<string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _strict(kind: str, match: Column) -> Column:
    """The base definition of a kind (and, for secrets, mixed characters)."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":  # local numbers have 7 digits at least
        return F.length(_digits(match)).between(8, 15) | ~match.startswith("+")
    if kind == "secret":
        return match.rlike(r"[0-9]") & match.rlike(r"[A-Za-z]")
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit(1)).when(bad, F.lit(-1)).otherwise(F.lit(0))


def _neighbour(char: Column) -> Column:
    return F.when(char == "", "edge").when(char.rlike(r"\s"), "blank").when(char.rlike(r"\w"), "word").otherwise("mark")


def _candidates(matches: Column, between: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, with code point positions from the lengths of what lies between them."""
    kind = _ALSO.get(pattern, pattern)
    rows = F.arrays_zip(matches.alias("match"), between.alias("before"), F.slice(between, 2, 1_000_000_000).alias("after"))
    rows = F.filter(rows, lambda x: x["match"].isNotNull())

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["match"])
        before, after = F.right(x["before"], F.lit(40)), F.substring(x["after"], 1, 1)
        strict, (good, bad) = _strict(kind, x["match"]), _GAZETTEER[kind]
        known = _vote(x["match"].rlike(good), x["match"].rlike(bad))
        context = _vote(before.rlike(_CUES[kind]), F.lit(False))
        length = F.length(x["match"])
        traits = F.array(
            F.lit(f"pattern-{pattern}"),
            F.concat(F.lit("length"), F.least(F.floor(F.log2(length.cast("double"))), F.lit(9)).cast("string")),
            F.concat(F.lit("digits"), F.floor(4 * F.length(_digits(x["match"])) / length).cast("string")),
            F.concat(F.lit("before-"), _neighbour(F.right(before, F.lit(1)))),
            F.concat(F.lit("after-"), _neighbour(after)),
        )
        found = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), (strict & F.lit(kind != "secret" and pattern == kind)).alias("base"), F.array(_vote(strict, ~strict), known, context).alias("votes"), traits.alias("traits"))
        likely = F.length(_digits(x["match"])).between(13, 19) if kind == "card" else F.lit(True)
        return F.struct(end.cast("int").alias("at"), F.when(likely, F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{CANDIDATE}>").alias("found"))
    return F.when(F.size(matches) > 0, F.aggregate(rows, zero, step, lambda s: s["found"])).otherwise(zero["found"])


def candidates(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep and the array of candidates, by kind and start, for every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("whole"), *keep)
    matches = {f"{k}_matches": F.regexp_extract_all("whole", F.lit(PATTERNS[k]), F.lit(0)) for k in PATTERNS}
    rows = rows.withColumns(matches)
    # Texts without a match, the most, aren't split.
    rows = rows.withColumns({f"{k}_between": F.when(F.size(f"{k}_matches") > 0, F.split("whole", PATTERNS[k], -1)) for k in PATTERNS})
    of = {k: _candidates(F.col(f"{k}_matches"), F.col(f"{k}_between"), k) for k in PATTERNS}
    phones = F.array_sort(F.concat(of["phone"], of["local"]))  # one kind, so by start
    return rows.select("doc_id", *keep, F.concat(*[phones if k == "phone" else of[k] for k in KINDS]).alias("candidates"))


def _log_odds(weights: dict[str, float], keys: Column) -> Column:
    """Sum of the weights of an array of keys; unknown keys count nothing."""
    if not weights:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for item in sorted(weights.items()) for x in item])
    return F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(table, k), F.lit(0.0)))


def _vote_keys(kind: Column, votes: Column) -> Column:
    return F.concat(F.array(kind), F.transform(votes, lambda v, j: F.concat_ws(":", kind, j, v)))


def _odds(rows: list, smooth: float = 0.5) -> dict[str, float]:
    """Rows (key, kind, for, against) to log odds: of each kind, and of each key within its kind."""
    total = {r.kind: (r.good, r.bad) for r in rows if r.key == r.kind}
    out = {}
    for r in rows:
        good, bad = total[r.kind]
        if r.key == r.kind:
            out[r.key] = math.log((good + smooth) / (bad + smooth))
        else:
            out[r.key] = math.log((r.good + smooth) / (good + 2 * smooth)) - math.log((r.bad + smooth) / (bad + 2 * smooth))
    return out


def fit(found: DataFrame, rounds: int = 12) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the labelers by expectation-maximisation, and those of the span classifier trained on its posteriors.

    found: what candidates() gives. All candidates count; only sums over vote patterns (27 a kind) and traits come back.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.traits")
    patterns = stage(each.groupBy("kind", "votes", "traits").agg(F.count("*").alias("n")), "patterns")
    votes = stage(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")), "votes")

    def sums(rows: DataFrame, p: Column, keys: Column) -> list:
        split = rows.select("kind", F.explode(keys).alias("key"), (F.col("n") * p).alias("good"), (F.col("n") * (1 - p)).alias("bad"))
        return split.groupBy("kind", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()

    keys = _vote_keys(F.col("kind"), F.col("votes"))
    balance = F.aggregate("votes", F.lit(0), lambda s, v: s + v)
    p = F.when(balance > 0, F.lit(0.9)).when(balance < 0, F.lit(0.1)).otherwise(F.lit(0.5))  # majority vote to start with
    weights: dict[str, float] = {}
    for _ in range(rounds):
        before, weights = weights, _odds(sums(votes, p, keys))
        p = 1 / (1 + F.exp(-_log_odds(weights, keys)))
        if weights.keys() == before.keys() and all(abs(weights[k] - before[k]) < 1e-3 for k in weights):
            break
    all_keys = _span_keys(F.col("kind"), F.col("votes"), F.col("traits"))
    return weights, _odds(sums(patterns, p, all_keys))


def _span_keys(kind: Column, votes: Column, traits: Column) -> Column:
    return F.concat(_vote_keys(kind, votes), F.transform(traits, lambda t: F.concat_ws(":", kind, t)))


def find_pii(docs: DataFrame, threshold: float = 0.9, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep and spans (array of kind, start, end, base, probability) for every row of docs (doc_id, text).

    Positions are code points of the whole text, end exclusive. Spans are ordered by kind as in KINDS, then by start;
    those of different kinds may overlap. A null text counts as empty and has none; repeated rows have the same spans.
    """
    found = stage(candidates(docs, keep), "candidates")
    _, weights = fit(found)

    def judged(c: Column) -> Column:
        p = 1 / (1 + F.exp(-_log_odds(weights, _span_keys(c["kind"], c["votes"], c["traits"]))))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), p.alias("probability"))

    spans = F.filter(F.transform("candidates", judged), lambda s: s["base"] | (s["probability"] >= threshold))
    return found.select("doc_id", *keep, spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; of overlapping spans the one that starts first, then ends last."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["minus_end"]
        part = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        nxt = F.struct(end.alias("at"), F.concat(state["parts"], F.array(part)).alias("parts"))
        inside = F.struct(F.greatest(state["at"], end).alias("at"), state["parts"].alias("parts"))
        return F.when(s["start"] >= state["at"], nxt).otherwise(inside)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(ordered, zero, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.lit(2_147_483_647))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
