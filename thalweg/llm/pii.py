"""Personal data by weak supervision; DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Candidates for more (secrets in
key=value text, national numbers, IBANs, titled names, phone numbers without a country code) come from
one broader pattern. A secret's value may stand in quotes and up to eight spaces from the = or : after its key, and
runs to its end: the closing quote, or the last letter, digit or sign of _+/~.- with = as padding.

Labelers vote on each candidate, for, against or not at all: a strict pattern (check digits of IBANs, numbers
that can't be issued), gazetteers (key names, countries, given names; placeholder words and numbers known from
print and film vote against), the context before it, and its shape. Expectation-maximisation over the counts of
vote patterns of the whole corpus estimates how reliable each labeler is; a logistic span classifier is fitted to
the resulting posteriors over kind, votes, and length and make-up of the text, and candidates it accepts are added
where no base span is. Both fits see only counts per pattern (at most 3645 of them), as one expression over a
single row.

Positions are code points, end exclusive. Null and empty texts have no spans. Rows are independent:
repeated rows give equal results. Empty tables give an empty result; without candidates nothing is
added. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

# possessive and anchored to the start of a run, so that long runs cost one pass; what they match is
# what the plain patterns match, leftmost and without overlaps
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Something that every text with a match has.
HINT = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?+){15}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}
#: From the last letter of a key to where its value or the value's quote begins.
KEY = r"[A-Za-z_][\"']?\s{0,8}[=:]\s{0,8}"
EXTRA = {
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[0-9]{1,3})?(?![0-9A-Za-z])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?",
    "tel": r"(?<![0-9+(-])\([0-9]{3}\)\x20?[0-9]{3}[\x20-][0-9]{4}(?![0-9])",
    # last: a value that one of the others describes is theirs
    "secret": rf"(?<=[=:\s\"'])(?:(?<={KEY}[\"'])[^\s\"']{{8,}}+(?=[\"'])|(?<={KEY}[\"']?)[A-Za-z0-9_+/~.-]{{8,}}+={{0,2}})",
}
CANDIDATE = "|".join(f"(?:{p})" for p in EXTRA.values())
CUE = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|auth|api[_-]?key|ssn|social|iban|account|call|tel|phone|mobile|contact|name|dear|from|to|signed)[^A-Za-z0-9]{0,20}$"
ANTI = r"(?i)(?:version|build|commit|rev|sha1?|md5|isbn|issn|order|ref|page|id|http|https|url|src|href|class|style|charset)[^A-Za-z0-9]{0,20}$"
# gazetteers
KEYS = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|social security|ssn|iban|bank)[^A-Za-z0-9]{0,20}$"
PLACEHOLDER = r"(?i)example|changeme|your|placeholder|xxxx|dummy|sample|redacted|0000|1234567|abcdef"
COUNTRIES = ["AD", "AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"]
GIVEN = """
Alan Alice Amy Andrea Andrew Angela Anna Anne Anthony Barbara Ben Brian Carl Carlos Caroline Catherine Charles Chris
Christine Claire Daniel David Diana Edward Elena Elizabeth Emily Emma Eric Eva Frank George Hannah Hans Helen Henry
Ines Jack James Jan Jane Jean John Jose Joseph Juan Julia Karen Karl Kate Laura Linda Louis Lucas Luis Maria Marie
Mark Martin Mary Matthew Michael Nina Olga Oliver Pablo Paul Pedro Peter Pierre Rachel Richard Robert Rosa Sam Sarah
Simon Sofia Stephen Susan Thomas Tom Victor Walter William
""".split()
NO_NAMES = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday No Who What The And But President Speaker Chairman".split()
PRINTED = ["078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789"]
LABELERS, SURFACE = ["strict", "gazetteer", "context", "shape"], {"size": (12, 25), "mix": (0.05, 0.6)}
ROUNDS, STEPS, ACCEPT, BEFORE = 12, 25, 0.5, 32


def pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    """The texts between matches of pattern (one more than there are matches), and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)


def walked(between: Column, found: Column) -> Column:
    """Array of (s, e, m, before) of each match: code points, text, and the end of the text before it."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string,before:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        gap, m = F.get(between, i), F.get(found, i)
        s = acc["at"] + F.char_length(gap)
        e = s + F.char_length(m)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m"), F.right(gap, F.lit(BEFORE)).alias("before")))).alias("out"))

    none = F.array().cast("array<int>")
    return F.aggregate(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(none), start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    spans = F.filter(walked(*pieces(text, BASE[kind])), lambda x: holds(kind, x["m"]))
    some = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(HINT[kind]), some).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def iban_holds(m: Column) -> Column:
    """Whether the check digits fit: the rearranged number, letters as 10 to 35, leaves 1 modulo 97."""
    flat = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substring(flat, 5, 60), F.substring(flat, 1, 4)), "")

    def add(rest: Column, c: Column) -> Column:
        return F.when(c < ":", rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), add) == 1


def step_of(value: Column, bounds: tuple[float, ...]) -> Column:
    return sum(((value >= b).cast("int") for b in bounds), F.lit(0))


def votes(x: Column) -> Column:
    """kind of a candidate, one vote per labeler (1 personal, 0 not, null for no opinion) and steps of its length and share of digits."""
    m, before = x["m"], x["before"]
    kind = F.when(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\."), "person").when(m.rlike(rf"^(?:{EXTRA['ssn']})$"), "ssn").when(m.rlike(r"^\("), "tel").when(m.rlike(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[0-9]{1,3})?$"), "iban").otherwise("secret")
    both = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    strict = F.when(kind == "secret", both & (F.char_length(m) >= 12)).when(kind == "ssn", ~m.rlike("^(?:000|666|9)|-00-|-0000$")).when(kind == "iban", iban_holds(m)).when(kind == "tel", m.rlike(r"^\([2-9][0-9]{2}\)\x20?[2-9]"))
    strict = F.when(kind == "person", m.rlike(r"\x20[A-Z][a-z]+\x20")).otherwise(strict)
    word = F.get(F.split(m, " "), 1)
    against = (
        F.when(kind == "secret", m.rlike(PLACEHOLDER)).when(kind == "ssn", m.isin(PRINTED)).when(kind == "iban", ~F.substring(m, 1, 2).isin(COUNTRIES))
        .when(kind == "person", word.isin(NO_NAMES)).otherwise(m.rlike(r"555[\x20-]01[0-9]{2}$"))
    )
    for_ = F.when(kind == "iban", F.substring(m, 1, 2).isin(COUNTRIES)).when(kind == "person", word.isin(GIVEN)).otherwise(before.rlike(KEYS))
    listed = F.when(against, False).when(for_, True)
    context = F.when(before.rlike(CUE), F.lit(True)).when(before.rlike(ANTI), F.lit(False))
    varied = F.size(F.array_distinct(F.split(m, "")))
    shape = F.when(kind == "secret", (varied >= 7) & ~m.rlike(r"^[a-z]+$|^[0-9.]+$|^//")).when(kind == "iban", varied >= 8).when(kind == "person", m.rlike(r"\x20[A-Z][a-z]{2,}$"))
    cast = [v.cast("int").alias(k) for k, v in zip(LABELERS, (strict, listed, context, shape), strict=True)]
    digits = F.char_length(F.regexp_replace(m, "[^0-9]", "")) / F.char_length(m)
    surface = [step_of(v, SURFACE[k]).alias(k) for k, v in (("size", F.char_length(m)), ("mix", digits))]
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), *cast, *surface)


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)


def doubles(values: list[float]) -> Column:
    return F.array(*map(F.lit, values))


def repeated(start: Column, times: int, step) -> Column:
    """step applied times times to start, within one expression."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda state, _: step(state))


def reliabilities(rows: Column, known: Column, rounds: int = ROUNDS) -> Column:
    """[prior, accuracy of each labeler] by expectation-maximisation over rows(n, v, ...).

    v holds 1 for the prior and then each labeler's vote: 1 personal, -1 not, 0 no opinion; known has how
    many candidates each of them has an opinion on.
    """

    def step(state: Column) -> Column:
        odds = F.transform(state, log_odds)

        def add(total: Column, r: Column) -> Column:
            return let(logistic(dot(r["v"], odds)), lambda p: F.zip_with(total, r["v"], lambda t, v: t + r["n"] * F.when(v > 0, p).when(v < 0, 1 - p).otherwise(0.0)))

        right = F.aggregate(rows, doubles([0.0] * (1 + len(LABELERS))), add)
        # a labeler is better than chance; two votes' worth of the starting belief
        better = F.transform(right, lambda s, k: F.when(k == 0, (s + 1) / (F.get(known, k) + 2)).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.55), (s + 1.6) / (F.get(known, k) + 2)))))
        return better

    return repeated(doubles([0.5] + [0.8] * len(LABELERS)), rounds, step)


def features(x) -> list[tuple[str, Column]]:
    """Indicators of the span classifier; x gives the column of a name."""
    out = [("bias", F.lit(1.0))] + [(f"is_{k}", (x("kind") == k).cast("double")) for k in EXTRA]
    for k in LABELERS:
        out += [(f"{k}_{v}", F.coalesce((x(k) == v).cast("double"), F.lit(0.0))) for v in (0, 1)]
    for k in SURFACE:
        out += [(f"{k}_{v}", (x(k) == v).cast("double")) for v in range(3)]
    return out


def span_classifier(patterns: DataFrame, steps: int = STEPS) -> dict[str, float]:
    """Weights of a logistic model of the posteriors over patterns(kind, votes..., size, mix, n).

    There is a pattern per kind and combination of votes and steps (3645 at most), so they fit into one row,
    and both fits are expressions over it: one job, whatever the number of rounds.
    """
    made = features(F.col)
    names = [k for k, _ in made]
    v = F.array(F.lit(1.0), *(F.coalesce(F.col(k) * 2.0 - 1, F.lit(0.0)) for k in LABELERS))
    every = patterns.agg(F.collect_list(F.struct("kind", v.alias("v"), F.col("n").cast("double").alias("n"), F.array(*(c for _, c in made)).alias("x"))).alias("rows"))

    def summed(rows: Column, part, size: int) -> Column:
        return F.aggregate(rows, doubles([0.0] * size), lambda total, r: F.zip_with(total, part(r), lambda t, a: t + r["n"] * a))

    def fit(rows: Column, seen: Column) -> Column:
        def step(w: Column) -> Column:
            def add(total: Column, r: Column) -> Column:
                return let(r["n"] * (r["target"] - logistic(dot(r["x"], w))), lambda e: F.zip_with(total, r["x"], lambda t, a: t + a * e))

            slope = F.aggregate(rows, doubles([0.0] * len(names)), add)
            # a quarter bounds the curvature of each indicator; several are on at once
            move = F.zip_with(slope, seen, lambda g, n: 4 * g / (4 + len(LABELERS) + len(SURFACE)) / (0.25 + 0.25 * n))
            return F.zip_with(w, move, lambda a, b: a + b)

        return repeated(doubles([0.0] * len(names)), steps, step)

    # what a loop refers to is computed before it, by let(): columns of a plan of their own would be folded into the loops
    def learnt(rows: Column) -> Column:
        known = summed(rows, lambda r: F.transform(r["v"], F.abs), 1 + len(LABELERS))
        odds = let(known, lambda known: F.transform(reliabilities(rows, known), log_odds))
        targets = let(odds, lambda odds: F.transform(rows, lambda r: F.struct(r["n"].alias("n"), r["x"].alias("x"), logistic(dot(r["v"], odds)).alias("target"))))
        return let(targets, lambda rows: let(summed(rows, lambda r: r["x"], len(names)), lambda seen: fit(rows, seen)))

    w = every.select(let(F.array_sort("rows"), learnt).alias("w")).first()["w"]
    return dict(zip(names, w, strict=True))


def accepted(weights: dict[str, float]):
    def test(x: Column) -> Column:
        margin = sum((v * weights[k] for k, v in features(lambda name: x[name])), F.lit(0.0))
        return 1 / (1 + F.exp(-margin)) >= ACCEPT

    return test


def candidate_spans(text: Column) -> Column:
    kind = "array<struct<s:int,e:int,kind:string," + ",".join(f"{k}:int" for k in (*LABELERS, *SURFACE)) + ">>"
    hint = KEY + r"[\"']?[^\s\"']{8}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}|\b(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z]|\([0-9]{3}\)\x20?[0-9]{3}"
    return F.when(text.rlike(hint), F.transform(walked(*pieces(text, CANDIDATE)), votes)).otherwise(F.array().cast(kind))


def with_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns carry, and spans: array of (kind, s, e), base kinds in their order, then added kinds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.struct(*carry).alias("own"), *(base_spans(text, k).alias(f"b_{k}") for k in BASE), candidate_spans(text).alias("more"))
    found = cut(found, "pii")
    patterns = found.where(F.size("more") > 0).select(F.explode("more").alias("x")).select("x.*").groupBy("kind", *LABELERS, *SURFACE).agg(F.count("*").alias("n"))
    weights = span_classifier(patterns)

    def named(kind: str) -> Column:
        return F.transform(f"b_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    whole = F.concat(*map(named, BASE))
    ok = accepted(weights)
    added = F.filter("more", lambda x: ok(x) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    added = F.array_sort(F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return found.withColumn("base", whole).withColumn("spans", F.concat("base", F.when(F.size("more") > 0, added).otherwise(F.array().cast("array<struct<kind:string,s:int,e:int>>")))).drop("more")


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs(doc_id, text)."""
    found = with_spans(docs, ["doc_id"])
    counts = [F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("own.doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in angle brackets; other columns as they are.

    n_chars, where it is there, becomes the length of the new text. Where spans overlap, the earlier
    one (the longer of two with one start) is replaced and what sticks out of it stays covered by it.
    """
    found = with_spans(docs, docs.columns)
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(acc["at"], -x["e"])
        gap = F.col("own.text").substr(acc["at"] + 1, x["s"] - acc["at"])
        tagged = F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))))
        return F.struct(end.alias("at"), F.when(x["s"] >= acc["at"], tagged).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.col("own.text").substr(acc["at"] + 1, F.char_length("own.text"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("own.text"))
    rows = found.select("own", text.alias("text"))
    out = []
    for c, kind in docs.dtypes:
        if c == "text":
            out.append(F.col("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("text").eqNullSafe(F.col("own.text")), F.col("own.n_chars")).otherwise(F.char_length("text")).cast(kind).alias(c))
        else:
            out.append(F.col(f"own.`{c}`").alias(c))
    return rows.select(*out)
