"""Personal data by weak supervision.

Candidate spans come from patterns. Labelers - format checks, gazetteers, words before the span, its shape - each vote
for, against or not at all. Expectation-maximisation over the counts of vote patterns, which cover all documents,
estimates how reliable each labeler is; the posteriors train a logistic classifier on votes and on features of the span
(its length, its mix of characters), which decides on the candidates. Spans of the four base definitions are always
kept. All of it is made of built-in column functions; what reaches the driver is one row for each kind, vote pattern and
feature pattern, of which there are some thousands at most. Candidates are sought once, by `with_candidates`; fitting and
finding only read them.

Patterns are written so that a search takes linear time: a run of characters is entered at its start or right after the
match before (\\G), and repetitions never give back (++).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds without a base definition: account numbers, national numbers, names after a title, keys and passwords.
MORE_KINDS = ("iban", "national", "person", "secret")
KINDS = (*BASE_KINDS, *MORE_KINDS)
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> pattern of its base definition.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a search of the pattern to be worth it.
NEEDS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: Further candidates: written-out addresses, addresses of eight groups, grouped card numbers, national phone numbers;
#: account numbers, numbers in groups of three, two and four, capitalised names after a title, long runs of mixed characters.
MORE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9./])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}/ ?[0-9]{5,8})(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme)\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)?+",
    "secret": r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{16,}+(?![.@])",
}
MORE_NEEDS = {
    "email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[./][0-9]{4}", "phone": r"\([0-9]{3}\)|[0-9]{3}[.-][0-9]{3}[.-]|/ ?[0-9]{5}",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "national": r"[0-9]-[0-9]{2}-[0-9]", "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Monsieur|Madame|Mme)", "secret": r"[0-9][A-Za-z_+/=-]|[A-Za-z_+/=-][0-9]",
}
#: Gazetteers: common endings of mail domains, first digits of card issuers, country codes (of phones; of accounts with
#: the length of their numbers), given names, beginnings of issued keys.
MAIL_ENDINGS = "com org net edu gov mil int io ai app dev info biz co me tv de fr es uk eu it nl be at ch se no dk fi pl pt cz gr ie ru ua tr us ca mx br ar cl au nz jp cn kr in za".split()
ISSUERS = "^(?:4|5[0-8]|2[2-7]|3[0-9]|6)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{10})"
ACCOUNTS = "^(?:AT.{18}|BE.{14}|CH.{19}|DE.{20}|DK.{16}|ES.{22}|FI.{16}|FR.{25}|GB.{20}|IE.{20}|IT.{25}|LU.{18}|NL.{16}|NO.{13}|PL.{26}|PT.{23}|SE.{22})$"
GIVEN = "^(?:anna|anne|antonio|carlos|carmen|claire|david|elena|emma|hans|james|jan|jean|john|jose|juan|julia|karl|laura|lucas|luis|maria|marie|mark|martin|mary|max|michael|paul|peter|pierre|robert|sarah|sofia|sophie|thomas|william) ?"
ISSUED = "^(?:akia|asia|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|rk_live_|pk_live_|xox[abps]-|aiza|eyj|ya29|npm_|hf_|dop_v1_)"
#: Words before a span that speak for its kind, or against any.
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel|reply|@:", "ip": r"\bip\b|address|host|server|adresse|client|remote|login",
    "card": "card|visa|credit|karte|carte|tarjeta|payment|pay|mastercard|amex", "phone": r"phone|tel|call|fax|mobil|ruf|cell|whatsapp|sms",
    "iban": "iban|account|konto|compte|cuenta|bank|bic", "national": r"ssn|social|security|national|tax|\bid\b|versicherung|seguro",
    "person": "name|from|von|contact|patient|dear|signed|author", "secret": r"token|secret|passw|api.?key|\bkey\b|credential|auth|bearer|pwd|private",
}
AGAINST = {kind: r"version|isbn|order|invoice|build|id[:=#]\s*$" for kind in (*BASE_KINDS, "iban", "national")} | {"person": r"street|square|avenue", "secret": r"sha|md5|commit|checksum|hash|digest|etag|https?:|www"}
LABELERS = ("format", "gazetteer", "context", "shape")
_FOUND = "array<struct<start:bigint,end:bigint,value:string,before:string,base:boolean>>"
_CANDIDATES = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Of each place of an array what the values before it come to: zero, step(zero, first), ... In blocks of 128, so that
    long arrays stay cheap; step has to be associative, with zero as its unit."""
    size = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), ((size - 1) / 128).cast("int")), lambda b: F.slice(values, b * 128 + 1, 128))

    def prefix(own: Column, start: Column) -> Column:
        grown = F.aggregate(own, F.array(start), lambda acc, v: F.concat(acc, F.array(step(F.element_at(acc, -1), v))))
        return F.slice(grown, 1, F.size(own))

    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
    return F.when(size == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(blocks, prefix(totals, zero), prefix)))


def running_sums(numbers: Column) -> Column:
    return running(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def _matches(text: Column, pattern: str, needs: str, base: bool) -> Column:
    """Places (code points), values and up to 30 characters before (back to the match before) of all matches: the lengths
    of what lies between them and of themselves add up."""

    def placed(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]
        ahead = F.slice(gaps, 1, F.size(found))
        steps = F.zip_with(ahead, found, lambda gap, value: (F.char_length(gap) + F.char_length(value)).cast("long"))
        starts = F.zip_with(running_sums(steps), ahead, lambda a, gap: F.struct((a + F.char_length(gap)).alias("start"), F.right(gap, F.lit(30)).alias("before")))
        return F.zip_with(starts, found, lambda at, value: F.struct(at["start"].alias("start"), (at["start"] + F.char_length(value)).alias("end"), value.alias("value"), at["before"].alias("before"), F.lit(base).alias("base")))

    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("found")), placed)
    return F.when(text.rlike(needs), found).otherwise(F.array().cast(_FOUND))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """The checks of the base definitions."""
    digits = _digits(value)
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
        "card": F.length(digits).between(16, 19) & _luhn(digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _well_formed(kind: str, value: Column) -> Column:
    """The checks of further candidates."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    remainder = F.aggregate(
        F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), ""), F.lit(0),
        lambda acc, c: F.when(c == "", acc).otherwise(F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)),
    )
    return {
        "card": _luhn(_digits(value)),
        "iban": remainder == 1,
        "national": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "secret": value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("^[-=_+/]|[-=_+/]{3}"),
    }.get(kind, F.lit(True))


def _votes(kind: str, value: Column, valid: Column, before: Column) -> list[Column]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    digits, low = _digits(value), F.lower(value)
    known, unknown = {
        "email": (F.lower(F.regexp_extract(value, r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)).isin(MAIL_ENDINGS), value.rlike(r"[.]{2}|^[.]|\.[0-9]+$")),
        "ip": (value.rlike(r"^(?:10|127|172|192)\.|^(?i:fe80|2001):"), value.rlike(r"^0+\.")),
        "card": (digits.rlike(ISSUERS), digits.rlike("^0")),
        "phone": (value.rlike(COUNTRIES) | value.startswith("("), digits.rlike("^00")),
        "iban": (F.replace(value, F.lit(" "), F.lit("")).rlike(ACCOUNTS), value.rlike("^(?:XX|ZZ|ID|NR)")),
        "national": (value.rlike("^[0-8]"), value.rlike("^9")),
        "person": (F.regexp_replace(low, r"^[a-zñ]+\.? ", "").rlike(GIVEN), F.lit(False)),
        "secret": (low.rlike(ISSUED), low.rlike("^(?:http|www|file|data)")),
    }[kind]
    usual, odd = {
        "email": (F.length(value).between(6, 64), F.length(value) > 128),
        "ip": (F.length(value) >= 7, value.rlike(r"^(?:[0-9]\.){3}[0-9]$")),
        "card": (F.length(digits) == 16, digits.rlike(r"^([0-9])\1+$") | ~F.length(digits).between(13, 19)),
        "phone": (F.length(digits).between(10, 13), digits.rlike(r"([0-9])\1{6}")),
        "iban": (F.length(digits) >= 12, F.length(digits) < 8),
        "national": (~digits.rlike(r"([0-9])\1{4}"), digits.rlike(r"^([0-9])\1+$|123456789")),
        "person": (value.contains(" "), F.length(value) > 60),
        "secret": (value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (value.rlike("[A-Z]") & value.rlike("[a-z]") & (F.length(digits) >= 3)), (F.length(digits) < 2) | value.rlike("(?:[A-Za-z]{4,}[-_/]){2}")),
    }[kind]
    near = F.lower(before)
    return [vote(valid, ~valid), vote(known, unknown), vote(near.rlike(CUES[kind]), near.rlike(AGAINST[kind])), vote(usual, odd)]


def _traits(value: Column) -> list[Column]:
    """Features beside the votes, one character each: the length, and which of letters, digits and marks there are."""
    size = F.length(value)
    return [
        F.when(size < 10, "a").when(size < 18, "b").when(size < 30, "c").when(size < 48, "d").otherwise("e"),
        F.when(value.rlike("[A-Za-z]") & value.rlike("[0-9]"), "m").when(value.rlike("[0-9]"), "n").otherwise("l"),
        F.when(value.rlike(r"[^A-Za-z0-9]"), "p").otherwise("q"),
    ]


def _untouched(own: Column, more: Column) -> Column:
    """Both arrays as one, by start, without those of more that touch a valid span of own. Spans of one array do not
    overlap, so the greatest end before a place and the least start behind it tell."""
    merged = F.array_sort(F.concat(own, more))
    ends = lambda spans: F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(-1).cast("long")))
    starts = lambda spans: F.transform(spans, lambda s: F.when(s["base"], -s["start"]).otherwise(F.lit(-(1 << 60)).cast("long")))

    def judged(spans: Column) -> Column:
        before = running(ends(spans), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
        behind = F.reverse(running(F.reverse(starts(spans)), F.lit(-(1 << 60)).cast("long"), lambda a, b: F.greatest(a, b)))
        limits = F.zip_with(before, behind, lambda a, b: F.struct(a.alias("low"), (-b).alias("high")))
        marked = F.zip_with(spans, limits, lambda s, x: F.struct(s.alias("s"), (~s["more"] | ((s["start"] >= x["low"]) & (s["end"] <= x["high"]))).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["s"])

    return F.when(F.size(more) == 0, own).when(F.size(own) == 0, more).otherwise(_let(merged, judged))


def candidates(text: Column, kind: str) -> Column:
    """All candidate spans of a kind, in order of their start: base matches, valid or not, then further ones that do not
    touch a valid base span. Each has its votes as a string such as "+-0+", and its traits behind them."""

    def judged(more: bool) -> Callable[[Column], Column]:
        def judge(span: Column) -> Column:
            valid = _well_formed(kind, span["value"]) if more else _valid(kind, span["value"])
            marks = [F.when(v == 1, "+").when(v == -1, "-").otherwise("0") for v in _votes(kind, span["value"], valid, span["before"])]
            return F.struct(
                span["start"].alias("start"), span["end"].alias("end"), F.lit(more).alias("more"), (F.lit(not more) & valid).alias("base"),
                F.concat(*marks, *_traits(span["value"])).alias("votes"),
            )

        return judge

    further = F.transform(_matches(text, MORE[kind], MORE_NEEDS[kind], False), judged(True))
    if kind in MORE_KINDS:
        return F.when(text.rlike(MORE_NEEDS[kind]), further)
    own = F.transform(_matches(text, BASE[kind], NEEDS[kind], True), judged(False))
    found = _let(F.struct(own.alias("own"), further.alias("more")), lambda both: _untouched(both["own"], both["more"]))
    return F.when(text.rlike(f"(?:{NEEDS[kind]})|(?:{MORE_NEEDS[kind]})"), found)


def with_candidates(docs: DataFrame, *, text: str = "text", into: str = "pii_candidates") -> DataFrame:
    """docs with the candidates of all kinds, by kind, then start: the one search through the texts. Write the result
    before it is fitted and then used (see stash), else the search runs twice. A null or empty text has none."""
    def named(kind: str) -> Column:
        found = F.transform(candidates(F.col(text), kind), lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["votes"].alias("votes")))
        return F.coalesce(found, F.array().cast(_CANDIDATES))

    return docs.withColumn(into, F.concat(*map(named, KINDS)))


@dataclass
class SpanModel:
    """reliability: of each labeler, the chance that its vote is right; accepted: kind -> vote patterns taken."""

    reliability: dict[str, float]
    weights: dict[str, float]
    accepted: dict[str, list[str]]


def _expectation_maximisation(counts: list[tuple[str, str, int]], rounds: int = 50) -> tuple[dict[str, float], list[float]]:
    """Reliabilities of the labelers, and of each (kind, votes, n) the probability that such a span is personal data.
    Labelers err independently; each kind has its own share of true spans."""
    right = dict.fromkeys(LABELERS, 0.8)
    prior = {kind: 0.5 for kind, _, _ in counts}
    truth = [0.5] * len(counts)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(counts):
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for name, mark in zip(LABELERS, votes[: len(LABELERS)]):
                weight = math.log(right[name] / (1 - right[name]))
                odds += weight if mark == "+" else -weight if mark == "-" else 0
            truth[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        for k, name in enumerate(LABELERS):
            good = sum(n * (p if v[k] == "+" else 1 - p) for (_, v, n), p in zip(counts, truth) if v[k] != "0")
            cast = sum(n for _, v, n in counts if v[k] != "0")
            right[name] = min(0.99, max(0.55, (good + 4) / (cast + 5)))  # better than chance, never certain
        for kind in prior:
            own = [(p, n) for (k, _, n), p in zip(counts, truth) if k == kind]
            prior[kind] = min(0.95, max(0.05, sum(p * n for p, n in own) / sum(n for _, n in own)))
    return right, truth


def _features(kind: str, votes: str) -> list[str]:
    """Names of the features of a span: its votes, and its traits as its kind has them."""
    traits = [f"{kind}:{i}={trait}" for i, trait in enumerate(votes[len(LABELERS) :])]
    return ["bias", f"kind={kind}", *[f"{name}={mark}" for name, mark in zip(LABELERS, votes) if mark != "0"], *traits]


def train(counts: list[tuple[str, str, int]], steps: int = 300) -> SpanModel:
    """Fit on (kind, votes with traits, number of candidates). Without candidates nothing but base spans is accepted."""
    counts = sorted(counts)
    right, truth = _expectation_maximisation(counts)
    weights: dict[str, float] = {}
    total = sum(n for *_, n in counts) or 1
    for _ in range(steps):
        slope: dict[str, float] = {}
        for (kind, votes, n), p in zip(counts, truth):
            names = _features(kind, votes)
            guess = 1 / (1 + math.exp(-sum(weights.get(f, 0) for f in names)))
            for f in names:
                slope[f] = slope.get(f, 0) + (p - guess) * n / total
        for f, s in slope.items():
            weights[f] = 0.999 * weights.get(f, 0) + 2 * s
    accepted = {kind: [v for k, v, _ in counts if k == kind and sum(weights.get(f, 0) for f in _features(k, v)) > 0 and v[0] == "+"] for kind in KINDS}
    return SpanModel(right, weights, accepted)


def fit_spans(marked: DataFrame, *, text: str = "text", candidates: str = "pii_candidates") -> SpanModel:
    """Count the patterns of all candidates of all rows of with_candidates (of plain documents they are sought here) and
    train on the counts."""
    marked = marked if candidates in marked.columns else with_candidates(marked, text=text, into=candidates)
    rows = marked.select(F.inline(candidates)).groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    return train([(r.kind, r.votes, r.n) for r in rows])


def find_spans(marked: DataFrame, model: SpanModel, *, text: str = "text", candidates: str = "pii_candidates", into: str = "pii") -> DataFrame:
    """The rows of with_candidates (of plain documents they are sought here) with `into`, an array of (kind, start, end, base) by kind, then start, in place of the
    candidates; code points, end exclusive. A column named as `into` is replaced.

    All rows stay, repeated ones and those with null keys too; a null or empty text has no spans, an empty table gives an
    empty one. Spans of one kind do not overlap; spans of different kinds may. Nothing is shuffled."""
    marked = marked if candidates in marked.columns else with_candidates(marked, text=text, into=candidates)
    taken = F.filter(candidates, lambda c: reduce(lambda x, y: x | y, [(c["kind"] == kind) & c["votes"].isin(votes) for kind, votes in model.accepted.items()], c["base"]))
    spans = F.transform(taken, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return marked.withColumn(into, spans).drop(candidates)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, *, text: str = "text", spans: str = "pii") -> DataFrame:
    """docs with every span of `spans` replaced by its kind in brackets; overlapping spans are one, named by the first.
    Texts without spans stay as they are. Pieces are cut from four-byte characters, so a cut takes no search."""
    wide = F.encode(F.col(text), "UTF-32")
    # A blank before a piece keeps a mark at its start from being taken for a byte order mark.
    def cut(points: Column, start: Column, size: Column) -> Column:
        piece = F.call_function("substring", points, (4 * start + 1).cast("int"), (4 * size).cast("int"))
        return F.substring(F.decode(F.concat(F.unhex(F.lit("00000020")), piece), "UTF-32"), 2, 1 << 30)

    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def pieces(both: Column) -> Column:
        own, points = both["spans"], both["points"]
        before = running(F.transform(own, lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
        shown = F.zip_with(own, before, lambda s, at: F.when(s["start"] >= at, F.concat(cut(points, at, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(own, lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), cut(points, last, F.octet_length(points) / 4 - last))

    redacted = _let(F.struct(ordered.alias("spans"), wide.alias("points")), pieces)
    return docs.withColumn(text, F.when(F.size(spans) > 0, redacted).otherwise(F.col(text)))
