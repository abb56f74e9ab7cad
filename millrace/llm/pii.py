"""Personal data by weak supervision, with DataFrame operations only.

Base matches of four kinds come from fixed patterns and checks; they always stand. Looser patterns give more candidates of
each kind: spelled out and bracketed email and IP addresses, IPv6, numbers of cards and phones inside matches that fail
as a whole, national phone numbers. Four voters label base matches, passing and failing, and candidates alike: the base
pattern with its check, a check of the form (last label, ranges, Luhn, digits), a gazetteer (top-level domains, special
address ranges, issuers, country codes), and the words around, which may name or speak against such data. Each says yes,
no or nothing. Votes are aggregated over all documents to counts of vote patterns, a table whose size is fixed by the
number of voters; expectation-maximisation on these counts estimates each voter's reliability by kind (what the base
matches teach of the other voters carries over to the candidates), and a logistic span classifier is trained on the
posterior with the same counts. It scores the candidates; those of at least ``threshold`` that overlap no base match are
added.

Positions come from cutting the text at the matches, so they count code points and every match is found once, leftmost
first and without overlap by kind. Patterns are written so that no text, however long, makes them backtrack or recurse.

Defined cases: null and empty texts have no spans; rows that repeat an id are documents of their own; empty tables give
no rows; with no candidates, or no text at all, nothing is trained and only base matches remain; columns other than id
and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import written

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive loops. The lookbehinds start a match only where a run of its first
# class starts or the previous match ended, which is where the leftmost match starts anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_AT = r"(?:\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20)"
_DOT = r"(?:\x20?[\[(](?i:dot|\.)[\])]\x20?|\x20(?i:dot)\x20|\.)"

# The looser patterns of candidates. All repeats are bounded.
LOOSE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}+",
    "ip": rf"(?<![0-9.])(?=[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{0,2}}+\x20?[\[(])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20./-][0-9]{4}){3}|[0-9]{15,16}|3[47][0-9]{2}[\x20./-][0-9]{6}[\x20./-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+().-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[\x20-][0-9]{3,}+(?![0-9.]))|(?<![0-9])00[1-9][0-9]{0,2}(?:[\x20.-]?[0-9]{2,4}){3,4}(?![0-9])",
}

_SAME = "|".join(f"{d}++" for d in range(10))

# The gazetteers, what a span of each kind often holds, and what one that only looks like it holds.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|cn|jp)$", "ip": r"^(?:[1-9]|1[0-9]|[2-9][0-9]|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "phone": r"^(?:\+|00)(?:1|33|34|39|44|49|81|86)",
}
STRANGE = {"email": r"(?i)\.(?:png|jpe?g|gif|js|py|css|html?|txt)$", "ip": r"^(?:0|127|255)\.", "card": rf"^(?:0|(?:{_SAME})$)", "phone": rf"^(?:\+|00)?(?:{_SAME})$"}

# Words around a span that announce its kind, and words that speak against it.
NAMING = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b", "ip": r"(?i)\b(?:ip|address|host|server|login from|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay|paid)\b", "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|cell|ring)\b",
}
AGAINST = {
    "email": r"(?i)\b(?:regex|pattern|placeholder|look|meet|arrived)\b", "ip": r"(?i)\b(?:version|release|section|chapter|build)\b",
    "card": r"(?i)\b(?:order|serial|tracking|invoice|checksum|isbn)\b", "phone": r"(?i)\b(?:isbn|order|version|serial|invoice|ticket)\b",
}

_AROUND = 40


#: Votes and features of a span, all small categories: the table of their combinations has a fixed size.
VOTERS = ("v_regex", "v_form", "v_gazetteer", "v_context")
FEATURES = ("f_before", "f_length")
_SPAN = "array<struct<start:int,end:int,found:string>>"


def _spans(found: Column, gaps: Column) -> Column:
    """The matches with their places in code points: a running sum over gaps and matches, appended in blocks of 128."""
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast(f"array<{_SPAN}>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("found")))
        full = F.size(acc["block"]) >= 128
        return F.struct(
            end.alias("at"),
            F.when(full, one).otherwise(F.concat(acc["block"], one)).alias("block"),
            F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"]).alias("blocks"),
        )

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"))
    return F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["blocks"], F.array(acc["block"]))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weighed(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + weighed(i))
    return total % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that a text without it has no match."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))


def _with_spans(docs: DataFrame, out: str, pattern: str, hint: Column) -> DataFrame:
    """``docs`` with ``out``: all matches of ``pattern`` in ``text``. The matches are found first, and only texts that have some are cut."""
    none = F.array().cast(_SPAN)
    found = docs.withColumn("__found", F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    cut = found.withColumn("__gaps", F.when(F.size("__found") > 0, F.split("text", pattern, -1)))
    return cut.withColumn(out, F.when(F.size("__found") > 0, _spans(F.col("__found"), F.col("__gaps"))).otherwise(none)).drop("__found", "__gaps")


def _plain(kind: str, found: Column) -> Column:
    """A span in the form that its check and gazetteer read: no brackets, spelled out signs or separators."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(found, _AT, "@"), _DOT, ".")
    if kind == "ip":
        return F.regexp_replace(found, _DOT, ".")
    return F.regexp_replace(found, "[^0-9]" if kind == "card" else "[^0-9+]", "")


def _well_formed(kind: str, plain: Column) -> Column:
    if kind == "email":
        return plain.rlike(r"@.*\.[A-Za-z]{2,24}$")
    if kind == "ip":
        return F.when(plain.contains(":"), True).otherwise(passes("ip", plain))
    if kind == "card":
        return passes("card", plain)
    digits = F.length(F.regexp_replace(plain, "[^0-9]", ""))
    return F.when(plain.rlike(r"^(?:\+|00)"), digits.between(9, 15)).otherwise((digits == 10) & plain.rlike("^[2-9]"))


def _votes(kind: str, span: Column, text: Column, loose: bool) -> Column:
    """A span with the voters' answers (1, -1, or 0 for none) and the classifier's features."""
    before = F.substring(text, F.greatest(span["start"] - _AROUND + 1, F.lit(1)), F.least(span["start"], F.lit(_AROUND)))
    around = F.concat(before, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(_AROUND)))
    last, length = F.substring(text, span["start"], F.least(span["start"], F.lit(1))), span["end"] - span["start"]
    plain = _plain(kind, span["found"])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"),
        (F.lit(0) if loose else vote(passes(kind, span["found"]), F.lit(True))).alias("v_regex"),
        vote(_well_formed(kind, plain), F.lit(True)).alias("v_form"),
        vote(~plain.rlike(STRANGE[kind]) & plain.rlike(KNOWN[kind]), plain.rlike(STRANGE[kind])).alias("v_gazetteer"),
        vote(around.rlike(NAMING[kind]) & ~around.rlike(AGAINST[kind]), ~around.rlike(NAMING[kind]) & around.rlike(AGAINST[kind])).alias("v_context"),
        F.when((span["start"] == 0) | last.rlike(r"\s"), 0).when(last.rlike("[A-Za-z0-9]"), 1).otherwise(2).alias("f_before"),
        F.when(length <= 12, 0).when(length <= 20, 1).otherwise(2).alias("f_length"),
    )


def _unlike(spans: Column, others: Column) -> Column:
    """The spans that are none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])))


def label_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and, by kind, ``base_*`` (matches with votes, failed ones included) and ``loose_*`` (candidates of the looser patterns)."""
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _with_spans(df, f"raw_{kind}", BASE[kind], _hint(kind, F.col("text")))
    for kind, pattern in LOOSE.items():
        df = _with_spans(df, f"raw_loose_{kind}", pattern, F.lit(True))
        # What the base pattern matches as a whole has been judged there.
        df = df.withColumn(f"raw_loose_{kind}", _unlike(F.col(f"raw_loose_{kind}"), F.col(f"raw_{kind}")))
    # Any number is a run of digits: only those as long as a card's are candidates for one.
    df = df.withColumn("raw_card", F.filter("raw_card", lambda s: F.length(F.regexp_replace(s["found"], "[^0-9]", "")).between(12, 19)))
    text = F.col("text")

    def voted(kind: str, raw: str, loose: bool) -> Column:
        return F.transform(raw, lambda s: _votes(kind, s, text, loose))

    cols = [voted(k, f"raw_{k}", False).alias(f"base_{k}") for k in KINDS]
    cols += [voted(k, f"raw_loose_{k}", True).alias(f"loose_{k}") for k in LOOSE]
    return df.select("id", *cols)


def vote_counts(spans: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, features, count) over all documents; at most a fixed number of combinations."""
    parts = [spans.select(F.lit(k).alias("kind"), F.explode(f"base_{k}").alias("s")) for k in KINDS]
    parts += [spans.select(F.lit(k).alias("kind"), F.explode(f"loose_{k}").alias("s")) for k in LOOSE]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    keys = ["kind", *(f"s.{c}" for c in (*VOTERS, *FEATURES))]
    rows = whole.select(*keys).groupBy("kind", *VOTERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r[v] for v in VOTERS), tuple(r[f] for f in FEATURES), r["n"]) for r in rows)


def estimate(counts: list, rounds: int = 50) -> dict:
    """Posterior by (kind, votes, features): expectation-maximisation of voters' answer rates given the truth, by kind.

    A voter that abstains says nothing of the truth: a rate is that of an answer among the answers given.
    """
    post = {}
    for kind in sorted({c[0] for c in counts}):
        own = [c for c in counts if c[0] == kind]
        total = sum(c[3] for c in own)
        belief = [0.9 if sum(c[1]) > 0 else 0.1 if sum(c[1]) < 0 else 0.5 for c in own]
        for _ in range(rounds):
            prior = (sum(b * c[3] for b, c in zip(belief, own, strict=True)) + 1) / (total + 2)
            rate = []
            for v in range(len(VOTERS)):
                said = {(y, a): sum((b if y else 1 - b) * c[3] for b, c in zip(belief, own, strict=True) if c[1][v] == a) + 1 + (a == (1 if y else -1)) for y in (0, 1) for a in (-1, 1)}
                rate.append({(y, a): said[y, a] / (said[y, -1] + said[y, 1]) for y, a in said})
            new = []
            for c in own:
                odds = math.log(prior) - math.log(1 - prior) + sum(math.log(rate[v][1, a] / rate[v][0, a]) for v, a in enumerate(c[1]) if a)
                new.append(1 / (1 + math.exp(min(700.0, -odds))))
            belief = new
        post |= {c[:3]: b for c, b in zip(own, belief, strict=True)}
    return post


def _inputs(kind: str, votes: tuple, feats: tuple) -> list[str]:
    """The classifier's inputs, each by kind: answers given, and features."""
    return [f"{kind}:bias", *(f"{kind}:{v}={a}" for v, a in zip(VOTERS, votes, strict=True) if a), *(f"{kind}:{f}={a}" for f, a in zip(FEATURES, feats, strict=True))]


def train(counts: list, post: dict, rounds: int = 500, rate: float = 1.0, decay: float = 1e-4) -> dict[str, float]:
    """Logistic weights of the final span classifier, fitted to the posterior of each combination by its share of its kind."""
    weight: dict[str, float] = {}
    total: dict[str, int] = {}
    for c in counts:
        total[c[0]] = total.get(c[0], 0) + c[3]
    rows = [(_inputs(*c[:3]), post[c[:3]], c[3] / total[c[0]]) for c in counts]
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, want, share in rows:
            got = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(x, 0.0) for x in names)))))
            for x in names:
                slope[x] = slope.get(x, 0.0) + share * (want - got)
        for x, g in slope.items():
            weight[x] = weight.get(x, 0.0) * (1 - rate * decay) + rate * g
    return weight


def _score(kind: str, span: Column, weight: dict[str, float]) -> Column:
    total = F.lit(weight.get(f"{kind}:bias", 0.0))
    for name in (*VOTERS, *FEATURES):
        term = F.lit(0.0)
        for a in (-1, 0, 1, 2):
            term = F.when(span[name] == a, F.lit(weight.get(f"{kind}:{name}={a}", 0.0))).otherwise(term)
        total = total + term
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def _likely(kind: str, weight: dict[str, float], threshold: float) -> Column:
    return F.filter(f"loose_{kind}", lambda s: _score(kind, s, weight) >= threshold)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id``, ``n_*`` (base spans by kind), ``base`` and ``spans``: sorted arrays of (start, kind number, end)."""
    labelled = written(label_spans(docs, id_col=id_col, text_col=text_col), "spans")
    counts = vote_counts(labelled)
    weight = train(counts, estimate(counts))
    good = {k: F.filter(f"base_{k}", lambda s: s["v_regex"] == 1) for k in KINDS}
    df = labelled.select(
        "id", *(F.size(good[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sort_array(F.concat(*(_named(k, good[k]) for k in KINDS))).alias("base"),
        F.concat(*(_named(k, _likely(k, weight, threshold)) for k in LOOSE)).alias("more"),
    )
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return df.withColumn("spans", F.sort_array(F.array_distinct(F.concat(F.col("base"), clear)))).drop("more")


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
