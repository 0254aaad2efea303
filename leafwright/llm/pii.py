"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, and a
span classifier, trained on what it says, decides by the votes and by the span's own form and surroundings.
SQL operations only; what is fitted are small tables of counted patterns."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Fixed patterns. Possessive forms and the look-behinds only spare the matcher work: a run that fails
# from its first character fails from any later one.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What the method may add: obfuscated addresses, addresses of the newer kind, long numbers that fail the check of digits,
# national telephone numbers, and keys (of a kind of their own).
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
}
# Words before a span that speak for its kind, and words that speak for something else (fixed values).
CUES = {
    "email": "e-?mail|mail|contact|write to|courriel|correo|kontakt",
    "ip": "ip|host|server|address|adresse|client",
    "card": "card|visa|mastercard|credit|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax|appel|llame|telefon",
    "secret": "token|key|secret|password|passwd|pwd|auth",
}
OTHER_CUES = {
    "email": "regex|pattern",
    "ip": "version|release|v",
    "card": "isbn|order|invoice|serial|tracking|id",
    "phone": "isbn|order|invoice|version|page",
    "secret": "sha1|sha256|md5|commit|checksum|digest|hash|etag",
}
# The gazetteer: last parts of host names, first parts of reserved networks, first digits of card issuers, calling codes
# and area codes that are given out, and beginnings of issued keys (fixed values).
GAZETTEER = {
    "email": ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "nl", "ch", "at", "uk", "us", "eu", "info", "biz"],
    "ip": ["0", "127", *[str(i) for i in range(224, 256)]],
    "card": ["34", "35", "36", "37", "38", "40", "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "60", "62", "64", "65"],
    "phone": ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
              "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"],
    "secret": ["AKIA", "ghp_", "xoxb", "sk-"],
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_NEEDS = {"email": "@", "phone": "+", "more email": "([", "ip": ".", "more ip": ":"}  # one of these characters
_RUNS = {"card": r"[0-9](?:[\x20-]?[0-9]){15}", "more card": r"[0-9](?:[\x20-]?[0-9]){15}", "more phone": r"[0-9]{3}[-.][0-9]{4}", "more secret": "[0-9A-Fa-f]{32}"}
_FOUND = "array<struct<v:string,s:int,l:string,r:string>>"
_STEP = 256


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once for all its uses, inside functions of array elements as well."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _running(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running merges of an array, itself included. Arrays are copied as they grow, so they grow in blocks: the cost of
    n elements is n * _STEP / 2 and not n * n / 2."""
    grow = lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x)))

    def in_blocks(blocks: Column) -> Column:
        return _let(F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, start, merge)), F.array(start), grow),
                    lambda before: F.flatten(F.transform(blocks, lambda b, i: F.slice(F.aggregate(b, F.array(F.element_at(before, i + 1)), grow), 2, _STEP))))

    def cut(v: Column) -> Column:
        return F.when(F.size(v) > 0, _let(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _STEP).cast("int")), lambda b: F.slice(v, b * _STEP + 1, _STEP)), in_blocks)).otherwise(v)

    return _let(values, cut)


def _found(text: Column, pattern: str) -> Column:
    """array<struct<v, s, l, r>>: the matches from left to right, where each starts (code points), and the
    text before (up to the match before) and after it. The text is matched twice, however many matches it has."""

    def places(x: Column) -> Column:
        m, g = x["m"], x["g"]
        ends = _running(F.transform(m, lambda v, i: F.length(v) + F.length(F.element_at(g, i + 1))), F.lit(0), lambda a, b: a + b)
        return _let(ends, lambda e: F.transform(m, lambda v, i: F.struct(
            v.alias("v"), (F.element_at(e, i + 1) - F.length(v)).cast("int").alias("s"), F.right(F.element_at(g, i + 1), F.lit(40)).alias("l"), F.left(F.element_at(g, i + 2), F.lit(8)).alias("r"))))

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, _let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), places)))
    return found.cast(_FOUND)


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _listed(kind: str, v: Column) -> Column:
    """Is what identifies the span's owner in the gazetteer?"""
    digits = F.regexp_replace(v, "[^0-9]", "")
    keys = {
        "email": [F.lower(F.regexp_extract(v, r"([A-Za-z0-9-]+)[\])]*$", 1))], "ip": [F.regexp_extract(v, "^0*([0-9]+)", 1)], "card": [F.left(digits, F.lit(2))],
        "phone": [F.when(v.startswith("+"), F.left(digits, F.lit(n))) for n in (1, 2)], "secret": [F.left(v, F.lit(4))]}[kind]
    known = reduce(or_, [k.isin(GAZETTEER[kind]) for k in keys])
    if kind == "phone":  # without a calling code: an area code does not begin with 0 or 1
        known = F.coalesce(known, F.lit(False)) | (~v.startswith("+") & digits.rlike("^[2-9]"))
    return ~known if kind == "ip" else known  # networks on the list are nobody's


def _votes(kind: str, x: Column, strict: Column) -> list[Column]:
    """The labelers: the form, the gazetteer and two of context. 1 is for, 0 against, 2 abstains."""
    near, word = F.concat(x["l"], F.lit(" ")), r"(?i)(?<![a-z])(?:{})[^a-z]"
    return [
        F.when(strict, 1).otherwise(0 if kind == "card" else 2),  # a card number that is none by its check digit
        F.when(_listed(kind, x["v"]), 1).otherwise(2 if kind == "secret" else 0),
        F.when(near.rlike(word.format(CUES[kind])), 1).when(near.rlike(word.format(OTHER_CUES[kind])), 0).otherwise(2),
        F.when(x["l"].rlike(r"[\p{L}\p{N}_]$") | x["r"].rlike(r"^[\p{L}\p{N}_]"), 0).when(x["l"].rlike(r"(?:^|[\s\"'(:=])$"), 1).otherwise(2),
    ]


_SIZES = (4, 4, 4, 3)  # values of each feature below


def _shape(x: Column) -> list[Column]:
    """What the classifier sees besides the votes: length, separators, and what stands before and after."""
    n = F.length(x["v"])
    inside = F.length(F.regexp_replace(x["v"], "[A-Za-z0-9]", ""))
    return [
        F.when(n < 12, 0).when(n < 17, 1).when(n < 24, 2).otherwise(3),
        F.when(inside == 0, 0).when(inside < 3, 1).when(inside < 5, 2).otherwise(3),
        F.when(x["l"] == "", 0).when(x["l"].rlike(r"\s$"), 1).when(x["l"].rlike(r"[\p{L}\p{N}_]$"), 2).otherwise(3),
        F.when((x["r"] == "") | x["r"].rlike(r"^\s"), 0).when(x["r"].rlike(r"^[.,;:!?)\]\"']"), 1).otherwise(2),
    ]


def _spans(found: Column, kind: str, base: bool) -> Column:
    def span(x: Column) -> Column:
        code = F.lit(0)
        for vote in _votes(kind, x, F.lit(base)):
            code = code * 3 + vote
        for size, value in zip(_SIZES, _shape(x)):
            code = code * size + value
        return F.struct(F.lit(ALL_KINDS.index(kind)).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["v"])).cast("int").alias("e"), F.lit(base).alias("base"), code.cast("int").alias("v"))

    kept = F.filter(found, lambda x: _passes(kind, x["v"])) if base else found
    return F.coalesce(F.transform(kept, span), F.array().cast("array<struct<k:int,s:int,e:int,base:boolean,v:int>>"))


def _of_kind(spans: str, k: int) -> Column:
    return F.filter(spans, lambda x: x["k"] == k)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row (id, spans): spans holds struct<k, s, e, base, v> with the kind's place in ALL_KINDS, start and
    end in code points, whether it is a base span, and votes and features as one number. They are in order of
    their starts; what overlaps a base span and is none itself is left out."""
    t = F.col("t")
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    arrays = []
    for group, patterns in (("", BASE), ("more ", MORE)):
        for kind, pattern in patterns.items():
            name, found = f"{group}{kind}", _found(t, pattern)
            if name in _NEEDS:
                found = F.when(reduce(or_, [F.instr(t, c) > 0 for c in _NEEDS[name]]), found)
            elif name in _RUNS:  # shorter numbers are nothing
                found = F.when(t.rlike(_RUNS[name]), found)
            arrays.append(_spans(found, kind, not group))
    spans = out.select("id", F.concat(*arrays).alias("spans"))
    return spans.select("id", F.when(F.exists("spans", lambda x: ~x["base"]), _clear(F.col("spans"))).otherwise(F.col("spans")).alias("spans"))


def _clear(spans: Column) -> Column:
    far = F.lit(2**31 - 1)

    def clear(x: Column) -> Column:
        # where the base spans before end, and where the next of those behind starts
        last = _running(F.transform(x, lambda y: F.when(y["base"], y["e"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        following = _running(F.transform(F.reverse(x), lambda y: F.when(y["base"], y["s"]).otherwise(far)), far, lambda a, b: F.least(a, b))
        return _let(F.struct(last.alias("a"), following.alias("z")), lambda e: F.filter(x, lambda y, i: y["base"] | (
            (F.element_at(e["a"], i + 1) <= y["s"]) & (F.element_at(e["z"], F.size(x) - i) >= y["e"]))))

    return _let(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("o"), x.alias("x")))), lambda x: x["x"]), clear)


def _split_code(code: int) -> tuple[int, list[int]]:
    """Votes (in base 3) and features of a number."""
    shape = []
    for size in reversed(_SIZES):
        code, x = divmod(code, size)
        shape.append(x)
    return code, shape[::-1]


def _digits(v: int, n: int = 4) -> list[int]:
    return [v // 3 ** (n - 1 - i) % 3 for i in range(n)]


def weigh_votes(patterns: list[tuple[int, int, int]], steps: int = 100) -> dict[int, tuple[float, list[float], list[float]]]:
    """Expectation-maximisation over (kind, votes, count): for each kind the share of true spans and, for
    each labeler, how often it votes 1 on true and on false spans, given that it votes.

    The start is a prior in favour of the labelers, worth ten spans each way, which also keeps patterns
    of a few spans from deciding."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(_digits(v), n) for k, v, n in patterns if k == kind]
        share, yes, no = 0.7, [0.8] * 4, [0.3] * 4
        for _ in range(steps):
            post = [posterior(d, share, yes, no) for d, _ in own]
            total = sum(n for _, n in own)
            share = (7 + sum(p * n for p, (_, n) in zip(post, own))) / (10 + total)
            for i in range(4):
                t = [(p * n, d[i]) for p, (d, n) in zip(post, own) if d[i] != 2]
                f = [((1 - p) * n, d[i]) for p, (d, n) in zip(post, own) if d[i] != 2]
                yes[i] = (8 + sum(w for w, x in t if x == 1)) / (10 + sum(w for w, _ in t))
                no[i] = (3 + sum(w for w, x in f if x == 1)) / (10 + sum(w for w, _ in f))
        out[kind] = (share, yes, no)
    return out


def posterior(votes: list[int], share: float, yes: list[float], no: list[float]) -> float:
    a, b = math.log(share), math.log(1 - share)
    for x, t, f in zip(votes, yes, no):
        if x != 2:
            a += math.log(t if x else 1 - t)
            b += math.log(f if x else 1 - f)
    return 1 / (1 + math.exp(max(-60, min(60, b - a))))


def train_classifier(patterns: list[tuple[int, int, int]], steps: int = 300, rate: float = 0.5) -> dict[int, list[float]]:
    """The final span classifier, from (kind, number of votes and features, count): for each kind a logistic curve over
    (1, vote for, vote against) of each labeler and the value of each feature. It is fitted to the posteriors of the
    votes by their counts, so a feature weighs as it goes along with what reliable labelers say; weights are drawn to
    zero, those of features, which see no truth of their own, most."""
    votes: dict[tuple[int, int], int] = {}
    for k, code, n in patterns:
        at = k, _split_code(code)[0]
        votes[at] = votes.get(at, 0) + n
    fitted = weigh_votes([(k, v, n) for (k, v), n in sorted(votes.items())])
    out = {}
    for kind, model in fitted.items():
        own = [(_features(code), posterior(_digits(_split_code(code)[0]), *model), n) for k, code, n in patterns if k == kind]
        total, w = sum(n for _, _, n in own), [0.0] * len(own[0][0])
        drawn = [1e-3] * 9 + [1e-2] * (len(w) - 9)
        for _ in range(steps):
            grad = [r * x for r, x in zip(drawn, w)]
            for x, y, n in own:
                miss = (1 / (1 + math.exp(-max(-60, min(60, sum(a * b for a, b in zip(w, x)))))) - y) * n / total
                for i, a in enumerate(x):
                    if a:
                        grad[i] += miss
            w = [a - rate * g for a, g in zip(w, grad)]
        out[kind] = w
    return out


def _features(code: int) -> list[float]:
    votes, shape = _split_code(code)
    return [1.0, *(float(x == y) for x in _digits(votes) for y in (1, 0)), *(float(x == y) for x, size in zip(shape, _SIZES) for y in range(size))]


def find_pii(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, secrets, n_found).

    Base spans are fixed by BASE and always stay; n_<kind> counts them. The classifier adds spans of MORE
    that it gives at least `threshold` and that no base span overlaps. spans lists those of KINDS as
    kind:start:end by kind, then start, joined by commas; ends are exclusive, places are code points. n_added
    counts the added ones among them. Keys are a kind of their own, in n_secret and, as start:end, in secrets.
    n_found counts everything.

    Each text is gone through a fixed number of times, however many matches it has; what is fitted is a table of the
    patterns of votes and features, of which a kind has at most 81 * 192. Null and empty texts have no spans. Ids may
    be null or repeat; rows that repeat have the same spans. Other columns are ignored.
    """
    spans = durable(candidates(docs, id_col, text_col), "pii")
    counted = spans.select(F.explode("spans").alias("x")).groupBy("x.k", "x.v").count().collect()
    patterns = [(r[0], r[1], r[2]) for r in sorted(counted)]
    weights = train_classifier(patterns)
    good = sorted((k, v) for k, v, _ in patterns if 1 / (1 + math.exp(-max(-60, min(60, sum(a * b for a, b in zip(weights[k], _features(v))))))) >= threshold)
    base = F.filter("spans", lambda x: x["base"])
    added = F.filter("spans", lambda x: ~x["base"] & F.concat_ws(":", x["k"], x["v"]).isin([f"{k}:{v}" for k, v in good]))
    names = F.array(*[F.lit(k) for k in KINDS])

    def line(a: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")

    out = spans.select("id", base.alias("b"), F.filter(added, lambda x: x["k"] < len(KINDS)).alias("a"), F.filter(added, lambda x: x["k"] == len(KINDS)).alias("c"))
    return out.select(
        F.col("id").alias(id_col), *[F.size(_of_kind("b", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(line(F.col("b")), 256).alias("base_sha256"), line(F.concat("b", "a")).alias("spans"), F.size("a").cast("long").alias("n_added"), F.size("c").cast("long").alias("n_secret"),
        F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("secrets"), (F.size("b") + F.size("a") + F.size("c")).cast("long").alias("n_found"))
