"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Texts are cut into runs of letters and numbers. Numbers, capitalised words (names and whatever else is
capitalised) and units right after a number become typed placeholders, so a question with other numbers,
names or units keeps its template. Windows of WINDOW template tokens are hashed by doubling (pairs,
fours, eights) and hash-joined with the benchmark's windows, which are broadcast while there are at
most BROADCAST of them and joined by shuffle beyond that. Windows with fewer than LITERALS plain
words say too little and are left out.

The runs family is the same with each run of names, and each run of numbers, as one placeholder whose value is
the whole run: a name or number may then be replaced by one of another number of tokens and the windows stay
at one shift. Templates as they are remain beside it, as short items may have too few tokens once runs are one.

The literal family has windows of the lower-cased tokens as they are, names and numbers included and with no
least number of plain words, so copies in capitals or title case match, and items that are themselves in
capitals or mostly names and numbers. contaminated() takes the families asked for, templates alone if none
are named; the query and drop_contaminated() take ALL.

Matches of a document and an item are grouped by alignment. An alignment counts if it covers at least
SHARE of the item's windows, or RUN of them. Then the slots are read from both raw texts: a value of
the item must always stand for the same value in the document; at least AGREE of the slots must
follow each value's most frequent counterpart. So re-parameterised questions are caught, while text
that only has the shape of one is not.

Null and empty texts match nothing, nor do items with fewer than WINDOW tokens. Items with the same
text all match. Rows that repeat an id with another text, of documents or of items, are compared by
themselves and reported once for each pair of ids, by the best match; drop_contaminated() drops an id if any
of its texts holds an item. Rows with a null id match nothing. Empty tables give an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, sent

WINDOW, LITERALS, SHARE, RUN, AGREE, BROADCAST = 8, 4, 0.5, 13, 0.9, 200_000
NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
RAW = rf"[\p{{L}}\p{{M}}]+|{NUMBER}"
UNITS = """
kilometers kilometres kilometer kilometre km meters metres meter metre centimeters cm millimeters mm miles mile feet
foot ft inches inch yards yard kilograms kilogram kg grams gram mg pounds pound lbs lb
ounces ounce oz liters litres liter litre ml gallons gallon hours hour minutes minute seconds second
days day weeks week months month years year dollars dollar euros euro cents cent percent degrees
degree m g l h s
""".split()
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
TEMPLATES = ("template", "runs")
ALL = (*TEMPLATES, "literal")


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW), 0)


def placeholder(raw: Column):
    """The token that stands for raw token x at i: itself or the placeholder of its type."""

    def typed(x: Column, i: Column) -> Column:
        # by byte order: digits, then capitals, then small letters, then everything beyond ASCII
        unit = x.isin(UNITS) & (F.get(raw, i - 1) < ":")
        plain = F.when(unit, UNIT).otherwise(x)
        beyond = F.when(x.rlike(r"^\p{Lu}"), NAME).when(x.rlike(r"^\p{N}"), NUM).otherwise(x)
        return F.when((x >= "a") & (x < "{"), plain).when(x < ":", NUM).when(x < "[", NAME).otherwise(beyond)

    return typed


def template_tokens(raw: Column) -> Column:
    """One token for each raw token."""
    return F.transform(raw, placeholder(raw))


def doubled(after: Column, rest: Column, family: str | None):
    """Joins the hash at each position, and the family if given, with the one that starts where its tokens end."""
    salt = [F.lit(family)] if family else []
    return lambda x: F.zip_with(x, F.slice(x, after, rest), lambda a, b: F.xxhash64(*salt, a, b))


def starts_run(tokens: Column, i: Column) -> Column:
    """Whether the token at i is not a name after a name or a number after a number."""
    x = F.get(tokens, i)
    return ~(x.isin(NAME, NUM) & x.eqNullSafe(F.get(tokens, i - 1)))


def in_runs(tokens: Column) -> Column:
    """The tokens without those that go on with a run."""
    return F.filter(tokens, lambda _, i: starts_run(tokens, i))


def run_values(raw: Column) -> Column:
    """The raw text of each token that in_runs leaves."""
    every = F.transform(raw, lambda _, i: i)

    def joined(starts: Column) -> Column:
        return F.transform(starts, lambda s, k: F.array_join(F.slice(raw, s + 1, F.coalesce(F.get(starts, k + 1), F.size(raw)) - s), " "))

    return let(template_tokens(raw), lambda tokens: let(F.filter(every, lambda i: starts_run(tokens, i)), joined))


def family_tokens(raw: Column, family: str) -> Column:
    if family == "runs":
        return let(template_tokens(raw), in_runs)
    return F.transform(raw, F.lower) if family == "literal" else template_tokens(raw)


def slot_values(raw: Column, family: Column) -> Column:
    """What stands in the text for each token of the family."""
    return F.when(family == "runs", run_values(raw)).otherwise(raw)


def hashed(raw: Column) -> Column:
    typed = placeholder(raw)
    return F.transform(raw, lambda x, i: F.xxhash64(typed(x, i)))


def hashed_in_runs(hashes: Column) -> Column:
    """What hashed() gives for the tokens that in_runs leaves."""
    number, name = F.xxhash64(F.lit(NUM)), F.xxhash64(F.lit(NAME))
    return F.filter(hashes, lambda h, i: ~(((h == number) | (h == name)) & h.eqNullSafe(F.get(hashes, i - 1))))


def windows_of(hashes: Column, family: str) -> Column:
    """Hash of the WINDOW tokens from each position on, for WINDOW a power of two. Those of two families have nothing in common."""
    h, span, rest = hashes, 1, F.lit(1 << 30)
    while span < WINDOW:
        after = F.lit(span + 1)
        span *= 2
        h = let(h, doubled(after, rest, family if span == WINDOW else None))
    return let(h, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - WINDOW + 1, F.lit(0))))


def window_hashes(raw: Column, families: tuple[str, ...]) -> Column:
    """An array of window hashes for each family."""

    def all_windows(typed: Column) -> Column:
        tokens = {"template": typed, "runs": hashed_in_runs(typed), "literal": F.transform(raw, lambda x: F.xxhash64(F.lower(x)))}
        return F.array(*(windows_of(tokens[f], f) for f in families))

    return let(hashed(raw), all_windows)


def contaminated(docs: DataFrame, benchmark: DataFrame, families: tuple[str, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, item_id, n_windows, share, n_slots, slot_agreement) for each document that holds an item."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().withColumn("iid", F.xxhash64("text"))
    items = items.withColumn("raw", raw_tokens(F.col("text")))
    items = cut(reduce(DataFrame.union, (items.select("item_id", "iid", F.lit(f).alias("family"), "raw", slot_values(F.col("raw"), F.lit(f)).alias("mine"), family_tokens(F.col("raw"), f).alias("tokens")) for f in families)), "items")
    spread = reduce(DataFrame.union, (items.where(F.col("family") == f).select("item_id", "iid", "family", "tokens", F.posexplode(F.get(window_hashes(F.col("raw"), (f,)), 0)).alias("ipos", "h")) for f in families))
    plain = F.size(F.filter(F.slice("tokens", F.col("ipos") + 1, WINDOW), lambda x: ~x.isin(NUM, NAME, UNIT)))
    windows = cut(spread.where((plain >= LITERALS) | (F.col("family") == "literal")).select("item_id", "iid", "family", "ipos", "h"), "windows")
    totals = windows.groupBy("item_id", "iid", "family").agg(F.count("*").alias("total"))
    side = windows.join(F.broadcast(totals) if windows.count() <= BROADCAST else totals, ["item_id", "iid", "family"])
    if windows.count() <= BROADCAST:
        side = F.broadcast(side)

    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("tid"))
    placed = docs.select("doc_id", "tid", F.explode(let(raw_tokens(F.col("text")), lambda raw: window_hashes(raw, families))).alias("h"))
    placed = placed.select("doc_id", "tid", F.posexplode("h").alias("dpos", "h"))
    hits = placed.join(side, "h").select("doc_id", "tid", "item_id", "iid", "family", (F.col("dpos") - F.col("ipos")).alias("shift"), "ipos", "total").distinct()
    by = ["doc_id", "tid", "item_id", "iid", "family", "shift"]
    aligned = hits.groupBy(*by).agg(F.count("*").alias("n"), F.first("total").alias("total"), F.collect_set("ipos").alias("at"))
    aligned = cut(aligned.where(F.col("n") >= F.least(F.lit(RUN), F.ceil(F.col("total") * SHARE))), "aligned")

    texts = docs.join(sent(cut(aligned.select("doc_id", "tid").distinct(), "aligned_ids")), ["doc_id", "tid"], "left_semi").dropDuplicates(["doc_id", "tid"])
    both = aligned.join(texts.select("doc_id", "tid", raw_tokens(F.col("text")).alias("theirs")), ["doc_id", "tid"]).withColumn("theirs", slot_values(F.col("theirs"), F.col("family")))
    both = both.join(items.select("item_id", "iid", "family", "tokens", "mine"), ["item_id", "iid", "family"])
    covered = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.exists("at", lambda p: (p <= i) & (i < p + WINDOW)))
    slot = F.transform(
        F.filter(covered, lambda i: F.get("tokens", i).isin(NUM, NAME, UNIT)),
        lambda i: F.struct(F.get("tokens", i).alias("kind"), F.lower(F.get("mine", i)).alias("mine"), F.lower(F.get("theirs", i + F.col("shift"))).alias("yours")),
    )
    slots = both.select(*by, F.explode(slot).alias("slot")).select(*by, "slot.*")
    pairs = slots.groupBy(*by, "kind", "mine", "yours").agg(F.count("*").alias("n"))
    values = pairs.groupBy(*by, "kind", "mine").agg(F.max("n").alias("agree"), F.sum("n").alias("n"))
    checked = values.groupBy(*by).agg(F.sum("n").alias("n_slots"), (F.sum("agree") / F.sum("n")).alias("slot_agreement"))
    found = aligned.join(checked, by, "left").where(F.coalesce("slot_agreement", F.lit(1.0)) >= AGREE)
    best = F.max_by(F.struct("n", "total", "n_slots", "slot_agreement"), F.struct("n", -F.col("shift"), "family")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("b.n").alias("n_windows"), (F.col("b.n") / F.col("b.total")).alias("share"), F.coalesce("b.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("b.slot_agreement", F.lit(1.0)).alias("slot_agreement")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, all columns as they are."""
    found = cut(contaminated(docs, benchmark, ALL).select("doc_id").distinct(), "contaminated")
    return docs.join(sent(found), "doc_id", "left_anti").select(docs.columns)
