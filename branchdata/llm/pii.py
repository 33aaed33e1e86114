"""Personal data by weak-supervision aggregation, with DataFrame functions only.

Base spans come from strict patterns and checks, and always stay.  Further
candidates come from looser patterns of the same four kinds, from strict
matches that fail their check (look-alikes: most are none, which gives the
estimate its negatives), and from long runs with digits that may be secrets.
Labelers vote on all of them (1: personal data, -1: not, 0: no opinion): the
strict pattern and its check, the form, gazetteers (top-level domains, card
issuers, dialling codes, key prefixes), cue words before the span,
counter-cues, and the characters at its ends.

Expectation-maximisation over the counts of vote patterns (a few hundred rows
at any corpus size) estimates each labeler's reliability and each pattern's
probability.  With these as soft labels a naive Bayes classifier is trained
on features of the spans (sums per feature value, made by one aggregate); it
decides which of the further candidates become spans.

The texts are read once: candidates with votes and features are stored, one
row per document, and everything after works on that small table.

Positions are code points, end exclusive.  Defined cases: null and empty
texts have no spans; each row gives a row; other columns are ignored; without
candidates nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import stored

# Kinds in their order, patterns, word lists.
KINDS = ("email", "ip", "card", "phone")          # of base spans
ALL_KINDS = (*KINDS, "secret")
# Strict patterns.  Possessive repeats and the look-behind only keep long runs linear:
# a match can't start inside a run whose start failed, except right after a match.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}"
             r"(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z]{2,24}){1,4}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,128}+(?![A-Za-z0-9_+/=-])",
}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
TOP_LEVEL = "com net org edu gov io info biz co uk de fr es it nl eu us ca au ch at be pl se no dk fi pt".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
DIALLING = r"^\+?\(?(?:1|7|20|27|30|31|32|33|34|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {"email": "e-?mail|mail|contact|write|address", "ip": "ip|host|server|address|login",
        "card": "card|visa|mastercard|amex|credit|debit|payment", "phone": "phone|tel|call|mobile|fax|contact",
        "secret": "token|secret|password|passwd|pwd|api[_-]?key|key|auth|bearer|credentials?"}
KEY_FORMS = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
KEY_STARTS = r"^(?:gh[opsu]_|sk-|pk-|AKIA|xox[abp]-|eyJ)"
COUNTER = "id|no|nr|number|order|ref|version|isbn|sku|serial|ticket"
CONTEXT = 30          # code points before a span that cue words may stand in
RUN = 64              # matches per block of running sums
LABELERS = 6
ROUNDS = 30
SHRINK = 5.0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    values = F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def _sound(kind: str, m: Column) -> Column:
    """The check that a strict match must pass."""
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": m.rlike(OCTETS), "card": n.between(16, 19) & _luhn(m),
            "phone": n.between(8, 15)}[kind]


def _matches(rows: DataFrame, wanted: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each name -> (pattern, condition): the column of all matches in
    ``text`` in order: start, end, m, before (what stands before it, up to
    CONTEXT code points) and after (the next character).

    Each step is a column of its own, so that no text is split once per match.
    Positions are running sums of lengths, in blocks of ``RUN`` matches."""
    none = F.array().cast("array<string>")
    keep = [c for c in rows.columns if c != "text"]
    out = rows.select(*keep, "text", *[
        F.when(when, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{k}_m")
        for k, (pattern, when) in wanted.items()])
    out = out.select("*", *[
        F.when(F.size(f"{k}_m") > 0, F.split("text", pattern, -1)).otherwise(none).alias(f"{k}_b")
        for k, (pattern, _) in wanted.items()]).drop("text")
    out = out.select("*", *[F.expr(
        f"transform({k}_m, (m, i) -> length({k}_b[i]) + length(m))").alias(f"{k}_n") for k in wanted])
    # The one-element arrays bind a block's first sum, which is else made again per match.
    out = out.select("*", *[F.expr(
        f"flatten(transform(sequence(0, int(size({k}_n) / {RUN})), j -> flatten(transform("
        f"array(aggregate(slice({k}_n, 1, j * {RUN}), 0, (s, n) -> s + n)), b -> transform("
        f"slice({k}_n, j * {RUN} + 1, {RUN}), (x, i) -> "
        f"b + aggregate(slice({k}_n, j * {RUN} + 1, i + 1), 0, (s, n) -> s + n))))))").alias(f"{k}_e") for k in wanted])
    return out.select(*keep, *[F.expr(
        f"transform({k}_m, (m, i) -> named_struct('start', {k}_e[i] - length(m), 'end', {k}_e[i], 'm', m, "
        f"'before', right({k}_b[i], {CONTEXT}), 'after', left({k}_b[i + 1], 1)))").alias(k) for k in wanted])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


LOOSER, SOUND, FAILED = range(3)      # a candidate: of a looser pattern, strict, strict but for its check


def _judged(kind: str, how: int, x: Column) -> Column:
    """A candidate with its votes and features."""
    m, before, after = x["m"], F.lower(x["before"]), x["after"]
    digits = _digits(m)
    form = {"email": _vote(m.rlike(r"[A-Za-z]{2,24}$"), m.rlike(r"[0-9-]$")),
            "ip": _vote(m.rlike(OCTETS) | m.contains(":"), F.lit(False)),
            "card": _vote(_luhn(m) & F.length(digits).between(13, 19), F.lit(True)),
            "phone": _vote(F.length(digits).between(8, 15), F.length(digits) < 7),
            "secret": _vote(m.rlike(KEY_FORMS) | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9]")),
                            m.rlike("^[0-9_+/=-]+$"))}[kind]
    known = {"email": _vote(F.lower(F.regexp_extract(m, "([A-Za-z]+)$", 1)).isin(TOP_LEVEL), F.lit(False)),
             "ip": _vote(F.lit(False), m.rlike(r"^(?:0+\.|255\.255)")),
             "card": _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)),
             "phone": _vote(m.rlike(DIALLING), digits.rlike(r"^(?:0{3}|1{5})")),
             "secret": _vote(m.rlike(KEY_STARTS), m.rlike(r"(.)\1{7}"))}[kind]
    cue = before.rlike(rf"\b(?:{CUES[kind]})\b")
    counter = before.rlike(rf"\b(?:{COUNTER})\b[ .:#=]*$")
    left = F.right(before, F.lit(1))
    glued = left.rlike("[a-z0-9_]") | after.rlike("[A-Za-z0-9_]")
    side = lambda c: (F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[A-Za-z]"), 2)     # noqa: E731
                      .when(c.rlike("[0-9]"), 3).otherwise(4))
    votes = F.array(F.lit({SOUND: 1, FAILED: -1}.get(how, 0)), form, known, F.when(cue, 1).otherwise(0),
                    F.when(counter, -1).otherwise(0), F.when(glued, -1).otherwise(1))
    features = F.array(F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int"), side(left), side(after),
                       cue.cast("int"), counter.cast("int"),
                       F.least(F.floor(10 * F.length(digits) / F.length(m)), F.lit(10)).cast("int"),
                       F.lit(how))
    return F.struct(F.lit(ALL_KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                    F.lit(how == SOUND).alias("strict"), votes.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): per row, strict spans, looser candidates that overlap
    none of them, and strict matches that failed and overlap neither."""
    def sound(kind: str, wanted: bool = True) -> Callable[[Column], Column]:
        return lambda x: _sound(kind, x["m"]) == wanted

    def judged(kind: str, how: int) -> Callable[[Column], Column]:
        return lambda x: _judged(kind, how, x)

    def bare(names: list[str]) -> Column:
        return F.concat(*[F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for c in names])

    def apart(spans: str) -> Callable[[Column], Column]:
        return lambda x: ~F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))

    text = F.col("text")
    out = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("number", text.rlike("[0-9]"))
    number = F.col("number")
    needs = {"email": F.contains(text, F.lit("@")), "ip": number, "card": number, "phone": number & F.contains(text, F.lit("+"))}
    maybe = {"email": F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")), "ip": number & F.contains(text, F.lit(":")),
             "card": number, "phone": number, "secret": number & text.rlike("[A-Za-z0-9_+/=-]{20}")}
    out = _matches(out, {f"s_{k}": (STRICT[k], needs[k]) for k in KINDS} | {f"l_{k}": (LOOSE[k], maybe[k]) for k in ALL_KINDS})
    out = out.select("doc_id", *[f"l_{k}" for k in ALL_KINDS],
                     *[F.filter(f"s_{k}", sound(k)).alias(f"s_{k}") for k in KINDS],
                     *[F.filter(f"s_{k}", sound(k, False)).alias(f"f_{k}") for k in KINDS])
    out = out.withColumn("strict", bare([f"s_{k}" for k in KINDS]))
    out = out.withColumns({f"l_{k}": F.filter(f"l_{k}", apart("strict")) for k in ALL_KINDS})
    out = out.withColumn("taken", F.concat("strict", bare([f"l_{k}" for k in ALL_KINDS])))
    found = [F.transform(f"s_{k}", judged(k, SOUND)) for k in KINDS]
    found += [F.transform(f"l_{k}", judged(k, LOOSER)) for k in ALL_KINDS]
    found += [F.transform(F.filter(f"f_{k}", apart("taken")), judged(k, FAILED)) for k in KINDS]
    return out.select("doc_id", F.concat(*found).alias("found"))


def estimate(patterns: dict[tuple[int, tuple[int, ...]], int], rounds: int = ROUNDS,
             ) -> tuple[dict[tuple[int, int], float], dict[tuple[int, tuple[int, ...]], float]]:
    """Expectation-maximisation over counts of (kind, votes): each labeler's
    reliability per kind (how often it is right when it votes), and each
    pattern's probability.  A vote of 0 says nothing.  Labelers are taken to be
    better than chance, which tells the two classes apart."""
    p = {k: min(0.95, max(0.05, 0.5 + 0.2 * sum(k[1]))) for k in patterns}
    rates: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for kind in sorted({k[0] for k in patterns}):
            own = [k for k in patterns if k[0] == kind]
            prior = (1 + sum(patterns[k] * p[k] for k in own)) / (2 + sum(patterns[k] for k in own))
            prior = min(0.95, max(0.05, prior))
            for j in range(LABELERS):
                right, votes = 3.0, 4.0
                for k in own:
                    if k[1][j]:
                        right += patterns[k] * (p[k] if k[1][j] > 0 else 1 - p[k])
                        votes += patterns[k]
                rates[kind, j] = min(0.99, max(0.55, right / votes))
            for k in own:
                z = _logit(prior) + sum(v * _logit(rates[kind, j]) for j, v in enumerate(k[1]))
                p[k] = 1 / (1 + math.exp(-z))
    return rates, p


def train(found: DataFrame) -> Column | None:
    """The classifier's log odds for a candidate ``x`` (as a function of one),
    or None where there are no candidates."""
    each = found.select(F.explode("found").alias("x"))
    counts = each.groupBy("x.kind", "x.votes").count().collect()      # at most 5 * 3 ** 6 rows
    if not counts:
        return None
    _, p = estimate({(r["kind"], tuple(r["votes"])): r["count"] for r in counts})
    soft = F.element_at(F.create_map(*[F.lit(v) for k, q in sorted(p.items()) for v in (_name(*k), q)]),
                        F.concat_ws(",", F.array(F.col("x.kind").cast("string")), F.col("x.votes").cast("array<string>")))
    value = F.posexplode("x.features")
    sums = (each.withColumn("p", soft).select("x.kind", "p", value.alias("feature", "value"))
            .groupBy("kind", "feature", "value").agg(F.sum("p").alias("yes"), F.count(F.lit(1)).alias("n")).collect())
    total: dict[int, list[float]] = {}
    for r in sums:
        if r["feature"] == 0:
            t = total.setdefault(r["kind"], [0.5, 1.0])
            t[0] += r["yes"]
            t[1] += r["n"]
    weights = {f"{k}": _logit(yes / n) for k, (yes, n) in total.items()}
    for r in sums:      # a value's rate, drawn to the kind's own by SHRINK pseudo-rows
        own = total[r["kind"]][0] / total[r["kind"]][1]
        weights[f"{r['kind']},{r['feature']},{r['value']}"] = (
            _logit((r["yes"] + SHRINK * own) / (r["n"] + SHRINK)) - _logit(own))
    return F.create_map(*[F.lit(v) for k, w in sorted(weights.items()) for v in (k, w)])


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def _name(kind: int, votes: tuple[int, ...]) -> str:
    return ",".join(map(str, (kind, *votes)))


def _log_odds(weights: Column, x: Column) -> Column:
    kind = x["kind"].cast("string")
    each = F.transform(x["features"], lambda v, i: F.coalesce(
        F.element_at(weights, F.concat_ws(",", kind, i.cast("string"), v.cast("string"))), F.lit(0.0)))
    return F.aggregate(each, F.coalesce(F.element_at(weights, kind), F.lit(0.0)), lambda s, w: s + w)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, base and spans
    (arrays of kind number, start, end, ordered so)."""
    found = stored(candidates(docs), "pii")
    weights = train(found)
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))     # noqa: E731
    strict = F.filter("found", lambda x: x["strict"])
    kept = strict if weights is None else F.filter("found", lambda x: x["strict"] | (_log_odds(weights, x) > 0))
    return found.select("doc_id", F.array_sort(F.transform(strict, bare)).alias("base"),
                        F.array_sort(F.transform(kept, bare)).alias("spans"))


def written(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
