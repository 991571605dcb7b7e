"""Personal data by candidate generation and gradient-boosted trees.

Fixed patterns give the base spans. Wider generators, several for each kind, propose further, overlapping spans on the
text with digits and signs of other widths made plain: addresses with their signs spelled out or bracketed, numbers in
other groupings, cards inside longer chains of digits. Boosted trees score them by format and context, and the best of
those over a calibrated threshold are added. The trees are fitted on the driver on synthetic snippets in which no single
feature decides, with features from the same SQL expressions, and become SQL expressions themselves, so that texts meet
DataFrame functions only.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive, and anchored at the start of a run or the end of the last match, they find
# the same spans as the plain forms without trying every character of a run as a start.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Digits and signs of other widths and scripts, and the plain ones; one code point each, so places stay.
PLAIN = ("\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\uff20\uff0e\uff0b\u2010\u2011\u2012\u2013\u00a0\u2009\u202f", "01234567890123456789@.+----\x20\x20\x20")
_AT = r"(?:@|[\[({<]\x20?(?:at|@)\x20?[\])}>])"
_DOT = r"(?:\.|[\[({<]\x20?(?:dot|\.)\x20?[\])}>])"
#: Generators of further candidates, on the plain text; those of one kind may overlap.
WIDER = {
    "email": (
        rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}\x20?{_AT}\x20?[a-z0-9-]{{1,63}}(?:\x20?{_DOT}\x20?[a-z0-9-]{{2,63}}){{1,4}}",
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}\x20at\x20[a-z0-9-]{2,63}(?:\x20dot\x20[a-z]{2,24}){1,3}(?![a-z0-9])",
    ),
    "ip": (rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:\x20?(?:{_DOT}|dot|[,:_-])\x20?[0-9]{{1,3}}){{3}}(?![0-9])",),
    "card": (
        r"(?<![0-9])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{1,7}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|[0-9]{13,19})(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{2,7}){2,4}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9])(?:\+|00)?(?:[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])|(?<![0-9.-])\+?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
        r"(?<![0-9])(?:\+|00?)?[0-9]{1,4}(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9])",
    ),
}
#: What a plain text must have for a kind's generators to be tried.
ASKS = {"email": r"(?i)@|[\[({<]\x20?at\x20?[\])}>]|\x20dot\x20", "ip": r"[0-9][\x20\[({<.,:_-]+[0-9d.]", "card": r"[0-9]{4}[\x20._/-]{0,3}[0-9]{2}", "phone": r"[0-9]{2}[).\x20/-]+[0-9]{2}"}
#: Words before a span that speak for a kind, and words that speak against all.
HINTS = {"email": "mail|contact|write|reach|send", "ip": "ip|host|server|address|ping|login|from|client", "card": "card|visa|master|amex|credit|pay|cc|debit", "phone": "phone|tel|call|mobile|cell|fax|ring|text|dial"}
AGAINST = "order|invoice|isbn|serial|ref|version|token|tracking|part|ticket|hash|build|sku|release|chapter|section|page|score|date|ratio|room"
FEATURES = ("digits", "signs", "groups", "luhn", "octets", "leads", "hinted", "against", "glued_before", "glued_after", "brackets", "spelled", "dots", "first", "length")
TREES, DEPTH, RATE, SNIPPETS = 24, 3, 0.3, 2000
#: Least share of right answers among held-out snippets that an added span's score must stand for.
PRECISION = 0.96

_SPAN = "array<struct<s:int,e:int,m:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def find_all(text: Column, pattern: str, needed: Column) -> Column:
    """Places (code points, end exclusive) and texts of all matches, leftmost and non-overlapping.

    Starts are sums of the lengths before, taken in blocks of 64, so a text with very many matches stays cheap.
    """

    def place(x: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / 64).cast("int")
            inside = F.aggregate(F.slice(x["t"], block * 64 + 1, i % 64), F.lit(0), lambda a, b: a + b)
            start = x["base"][block] + inside + F.length(x["g"][i])
            return F.struct(start.alias("s"), (start + F.length(x["m"][i])).alias("e"), x["m"][i].alias("m"))

        return F.transform(F.sequence(F.lit(0), F.size(x["m"]) - 1), at)

    def blocks(x: Column) -> Column:
        last = F.floor((F.size(x["m"]) - 1) / 64).cast("int")
        base = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(x["t"], F.lit(1), k * 64), F.lit(0), lambda a, b: a + b))
        return _let(F.struct(x["m"], x["g"], x["t"], base.alias("base")), place)

    def steps(x: Column) -> Column:
        lengths = F.zip_with(x["m"], F.slice(x["g"], F.lit(1), F.size(x["m"])), lambda a, b: F.length(a) + F.length(b))
        return F.when(F.size(x["m"]) > 0, _let(F.struct(x["m"], x["g"], lengths.alias("t")), blocks)).otherwise(F.array().cast(_SPAN))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.when(needed, _let(found, steps)).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str) -> Callable[[Column], Column]:
    return lambda c: _valid(kind, c["m"])


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _features(kind: str, text: Column, c: Column) -> Column:
    """FEATURES of a candidate, from its own text and the 24 code points before and 2 after."""
    m = c["m"]
    before = F.lower(F.substring(text, F.greatest(c["s"] - 24, F.lit(0)) + 1, F.least(c["s"], F.lit(24))))
    after = F.substring(text, c["e"] + 1, F.lit(2))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    times = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    parts = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    return F.struct(
        c["s"],
        c["e"],
        c["g"],
        F.length(_digits(m)).cast("double").alias("digits"),
        times(r"[\x20()._/:,-]").alias("signs"),
        F.size(parts).cast("double").alias("groups"),
        one(F.call_function("luhn_check", _digits(m))).alias("luhn"),
        one(F.forall(parts, lambda x: (F.length(x) < 3) | (F.length(x) == 3) & (x <= "255"))).alias("octets"),
        one(m.startswith("+") | m.startswith("00")).alias("leads"),
        one(before.rlike(rf"(?:{HINTS[kind]})[a-z]*\W{{0,3}}(?:\w+\W{{1,3}}){{0,2}}$")).alias("hinted"),
        one(before.rlike(rf"(?:{AGAINST})[a-z]*\W{{0,3}}(?:\w+\W{{1,3}}){{0,2}}$")).alias("against"),
        one(before.rlike(r"[\p{L}0-9_.-]$")).alias("glued_before"),
        one(after.rlike(r"^(?:[\p{L}0-9_]|[.-][0-9])")).alias("glued_after"),
        times(r"[\[\](){}<>]").alias("brackets"),
        times(r"(?i)(?<![a-z])(?:at|dot)(?![a-z])").alias("spelled"),
        times(r"\.").alias("dots"),
        F.coalesce(F.substring(_digits(m), 1, 1).try_cast("double"), F.lit(-1.0)).alias("first"),
        F.least(F.length(m), F.lit(40)).cast("double").alias("length"),
    )


def _proposed(kind: str, text: Column, needed: Column) -> Column:
    """All candidates of a kind with g, the number of their generator; those of one generator are in order."""
    each = [F.transform(find_all(text, pattern, needed), lambda c, g=g: F.struct(c["s"], c["e"], c["m"], F.lit(g).alias("g"))) for g, pattern in enumerate(WIDER[kind])]
    return F.concat(*each)


def _stepped(spans: Column) -> Column:
    """Spans in order that don't overlap, with the first start of every block of about the root of their number."""
    def steps(x: Column) -> Column:
        w = F.greatest(F.ceil(F.sqrt(F.size(x))), F.lit(1)).cast("int")
        heads = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda j: F.get(x, j * w)["s"])).otherwise(F.array().cast("array<int>"))
        return F.struct(x.alias("x"), w.alias("w"), heads.alias("heads"))

    return _let(spans, steps)


def _met(stepped: Column, c: Column) -> Column:
    """Those of the spans that overlap c, up to two blocks of them are looked at: the one that c ends in and the one before."""
    j = F.size(F.filter(stepped["heads"], lambda h: h < c["e"]))
    near = F.slice(stepped["x"], F.greatest((j - 2) * stepped["w"], F.lit(0)) + 1, 2 * stepped["w"])
    return F.when(j > 0, F.filter(near, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))).otherwise(F.filter(stepped["x"], lambda b: F.lit(False)))


# --- boosted trees ------------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A tree as (feature, cut, left, right) or a leaf's number, by Newton gain."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 8:
        return leaf
    best = (1e-3, None, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1.0)
            if gain > best[0]:
                best = (gain, j, float(cut))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def _as_sql(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(c[FEATURES[tree[0]]] <= tree[1], _as_sql(tree[2], c)).otherwise(_as_sql(tree[3], c))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    trees, raw = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(_grow(x, p - y, p * (1 - p), DEPTH))
        raw += RATE * _apply(trees[-1], x)
    return trees


def calibrate(raw: np.ndarray, y: np.ndarray) -> float:
    """The least score over which the share of right answers is at least PRECISION; infinite if there is none."""
    order = np.argsort(-raw, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    ends = np.append(raw[order][1:] < raw[order][:-1], True)
    good = np.flatnonzero(ends & (right >= PRECISION))
    if not len(good):
        return float("inf")
    cut = raw[order][good[-1]]
    below = raw[raw < cut]
    return float((cut + below.max()) / 2 if len(below) else cut - 1e-9)


def _luhn_digit(body: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def snippets(kind: str, seed: int) -> list[tuple[str, int]]:
    """(text with one candidate, whether it is personal data), half and half.

    What is drawn differs between the two by its odds only: format, hints, words that speak against and what the span is
    glued to each occur on both sides.
    """
    r = random.Random(f"{kind}{seed}")
    odds = lambda label, yes, no: r.random() < (yes if label else no)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeiourtnsldmp") for _ in range(r.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    out = []
    for i in range(SNIPPETS):
        label = i % 2
        if kind == "card":
            n = r.choice([15, 16, 16, 16, 13, 19]) if odds(label, 0.95, 0.5) else r.choice([14, 17, 18, 12])
            body = r.choice("3456" if odds(label, 0.95, 0.4) else "012789") + digits(n - 2)
            number = body + (_luhn_digit(body) if odds(label, 0.96, 0.1) else r.choice("0123456789"))
            sign = r.choice(["", "", " ", "-", ".", "/", "  "])
            m = sign.join(number[j : j + 4] for j in range(0, n, 4))
        elif kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            plus = odds(label, 0.4, 0.08)
            shapes = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a[:2]} {b} {c}", f"{a}/{b}{c[:1]}-{c[1:]}"]
            others = [f"{r.randint(1, 31):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{a}-{b}-{c}"]
            m = ("+" + r.choice(["1", "44", "49"]) + " " if plus else "") + r.choice(shapes if odds(label, 1.0, 0.15) else others)
        elif kind == "ip":
            parts = [str(r.randint(0, 255 if odds(label, 1.0, 0.6) else 999)) for _ in range(4)] if odds(label, 0.9, 0.5) else [str(r.randint(0, 12)) for _ in range(4)]
            m = r.choice(["[.]", "(.)", " . ", "[dot]", " dot ", "{.}"] if odds(label, 0.93, 0.15) else [",", ":", "-", "_", ", ", " : "]).join(parts)
        else:
            at = r.choice([" [at] ", " (at) ", "[at]", " {at} ", "<at>"] if odds(label, 0.6, 0.12) else [" at "])
            dot = r.choice([" [dot] ", " (dot) ", "[dot]", ".", " dot "] if at != " at " else [" dot "])
            end = r.choice(["com", "org", "net", "de", "io"]) if odds(label, 0.95, 0.12) else word()
            name = word() + (r.choice([".", "_", ""]) + r.choice([word(), digits(2)]) if odds(label, 0.6, 0.15) else "")
            m = f"{name}{at}{word()}{dot}{end}"
        lead, tail = prose(), " " + prose()
        if odds(label, 0.7, 0.05):
            lead += " " + r.choice(HINTS[kind].split("|")) + r.choice(["", ":", " is", " number", " me"])
        elif odds(label, 0.05, 0.6):
            lead += " " + r.choice(AGAINST.split("|")) + r.choice(["", " no", " id", ":"])
        if odds(label, 0.02, 0.15):
            tail = word() + tail
        out.append((f"{lead} {m}{tail}", label))
    return out


_models: dict[str, tuple[list, float]] = {}


def models(spark: SparkSession) -> dict[str, tuple[list, float]]:
    """For each kind its trees and threshold; fitted once for each process, the same each time."""
    if not _models:
        for kind in KINDS:
            halves = []
            for seed in (1, 2):
                made = json.dumps([{"text": t, "label": y} for t, y in snippets(kind, seed)])
                rows = spark.range(1).select(F.explode(F.from_json(F.lit(made), "array<struct<text:string,label:int>>")).alias("x")).select("x.text", "x.label").repartition(1)
                found = _proposed(kind, F.translate("text", *PLAIN), F.lit(True))
                found = rows.select("label", F.explode(F.transform(found, lambda c: _features(kind, F.col("text"), c))).alias("c")).select("label", "c.*").collect()  # about SNIPPETS rows
                halves.append((np.array([[r[f] for f in FEATURES] for r in found], float), np.array([r["label"] for r in found], float)))
            (x, y), (held, truth) = halves
            trees = boost(x, y)
            _models[kind] = trees, calibrate(sum(RATE * _apply(t, held) for t in trees), truth)
    return _models


# --- the operator -------------------------------------------------------------------------------------------------


def _joined(spans: dict[str, Column]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(F.array_sort(F.transform(spans[kind], lambda c: F.struct(c["s"], c["e"]))), lambda c: F.concat_ws(":", F.lit(kind), c["s"], c["e"]))

    each = [named(k) for k in KINDS]
    return F.array_join(F.concat(*each), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row of docs.

    The counts and the digest are of the base spans, spans of these and the added ones, none of which overlaps a base
    span, an added one of a kind before its own or one of its kind with a better score. Overlaps are looked for among near spans only, so a text with
    very many spans stays cheap. Null texts count as empty; repeated rows and null ids give results like any other; an
    empty table gives an empty result.
    """
    fitted = models(docs.sparkSession)
    text, plain = F.col("text"), F.col("plain")
    digit = text.rlike("[0-9]")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    needs = {k: digit & text.contains(NEEDS[k]) if NEEDS[k] and k != "email" else text.contains("@") if k == "email" else digit for k in KINDS}
    base = {k: F.filter(find_all(text, BASE[k], needs[k]), _holds(k)) for k in KINDS}
    rows = rows.select("doc_id", "text", F.translate("text", *PLAIN).alias("plain"), *[base[k].alias(k) for k in KINDS])

    def added(kind: str) -> Column:
        trees, threshold = fitted[kind]
        none = F.array().cast("array<struct<s:int,e:int,m:string>>")

        def good(bases: Column) -> Column:
            clear = lambda c: ~F.exists(bases, lambda b: F.size(_met(b, c)) > 0)
            scored = F.transform(F.transform(F.filter(_proposed(kind, plain, F.lit(True)), clear), lambda c: _features(kind, plain, c)), lambda c: F.struct(sum((F.lit(RATE) * _as_sql(t, c) for t in trees), F.lit(0.0)).alias("p"), c["s"], c["e"], c["g"]))
            return F.filter(scored, lambda c: c["p"] >= F.lit(threshold))

        def apart(all_of: Column) -> Column:
            if len(WIDER[kind]) == 1:  # one generator's spans never overlap
                return all_of
            lists = F.array(*[_stepped(F.filter(all_of, lambda c, g=g: c["g"] == g)) for g in range(len(WIDER[kind]))])
            better = lambda d, c: (d["p"] > c["p"]) | ((d["p"] == c["p"]) & (d["g"] < c["g"]))
            return _let(lists, lambda every: F.filter(all_of, lambda c: ~F.exists(every, lambda one: F.exists(_met(one, c), lambda d: (d["g"] != c["g"]) & better(d, c)))))

        earlier = [f"added_{k}" for k in KINDS[: KINDS.index(kind)]]
        bases = F.array(*[_stepped(F.transform(k, lambda b: F.struct(b["s"], b["e"]))) for k in (*KINDS, *earlier)])
        found = _let(_let(bases, good), apart)
        in_order = F.array_sort(F.transform(found, lambda c: F.struct(c["s"], c["e"], F.lit("").alias("m"))))
        return F.when(plain.rlike(ASKS[kind]), in_order).otherwise(none)

    for kind in KINDS:
        rows = rows.withColumn(f"added_{kind}", added(kind))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined({k: F.col(k) for k in KINDS}), 256).alias("base_sha256"),
        _joined({k: F.concat(F.col(k), F.col(f"added_{k}")) for k in KINDS}).alias("spans"),
    )
