import random
import re
from collections import Counter, defaultdict

from thalweg.llm import decontaminate as D


def parse(text):
    raw = re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", text or "")
    out = []
    for k, w in enumerate(raw):
        if w[0].isdigit():
            out.append("#")
        elif w[0].isupper():
            out.append("@")
        elif k and out[-1] == "#" and w in D.UNITS:
            out.append("%")
        else:
            out.append(w)
    return raw, out


def brute(docs, items):
    found = set()
    parsed = {i: parse(t) for i, t in items}
    for d, text in docs:
        draw, dt = parse(text)
        for i, (iraw, it) in parsed.items():
            wins = [p for p in range(len(it) - 7) if sum(x not in "#@%" for x in it[p : p + 8]) >= D.LITERALS]
            hits = defaultdict(set)
            for p in wins:
                for q in range(len(dt) - 7):
                    if dt[q : q + 8] == it[p : p + 8]:
                        hits[q - p].add(p)
            for shift, at in hits.items():
                if len(at) < min(D.RUN, -(-len(wins) // 2)):
                    continue
                counts = defaultdict(Counter)
                for k, x in enumerate(it):
                    if x in "#@%" and any(p <= k < p + 8 for p in at):
                        counts[x, iraw[k].lower()][draw[k + shift].lower()] += 1
                total = sum(sum(c.values()) for c in counts.values())
                if not total or sum(max(c.values()) for c in counts.values()) / total >= D.AGREE:
                    found.add((d, i))
    return found


def test_matches_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ga") for b in ("na", "re", "lo", "ti", "mu", "sa")]

    def words(n):
        return " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", "."]) for _ in range(n))

    question = "Anna buys 3 kg of red apples and then Anna sells 2 kg of them to Boris before noon, how many kg does Anna have if 3 apples were bad?"
    items = [(1, question), (2, words(30)), (3, words(16)), (4, "too short"), (5, None), (6, words(30))]
    docs = [
        (1, words(40) + " " + question + " " + words(20)),
        (2, words(10) + " " + question.replace("Anna", "Carla").replace("3", "17").replace("kg", "miles") + words(5)),
        (3, question.replace("Anna", "Carla", 1).replace("3", "9", 1).replace("2 kg", "9 km")),  # slots that contradict
        (4, items[1][1].upper()),
        (5, words(200) + " " + items[1][1] + " " + items[2][1]),
        (6, items[5][1][: len(items[5][1]) * 2 // 3]),
        (7, None),
        (8, ""),
        (9, words(3000)),
        (10, "Anna buys 3 kg of red apples and then"),
    ]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame([(*d, 0) for d in docs * 2], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert {(1, 1), (2, 1), (5, 2), (5, 3), (6, 6)} <= got and not {d for d, _ in got} & {3, 9, 10}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert D.contaminated(docs, items.limit(0)).collect() == []
    assert D.contaminated(docs.limit(0), items).collect() == []
    assert D.drop_contaminated(docs, items).collect() == []
    assert D.drop_contaminated(docs, items.limit(0)).count() == 1


def test_copies_in_any_case(spark):
    question = "Anna buys 3 kg of red apples and then Anna sells 2 kg of them to Boris before noon"
    names = "ANNA BORIS CARLA DORA EMIL FRITZ 1 2 3 GRETA HANS IDA"
    items = spark.createDataFrame([(1, question), (2, names)], "item_id long, text string")
    docs = [(1, f"so {question.upper()} it was"), (2, f"so {question.title()} it was"), (3, f"so {names} it was"), (4, names.lower()), (5, "Anna Boris Carla 1 2 3 and others"), (6, question)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, items, D.ALL).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 1)}
    assert [r.doc_id for r in D.drop_contaminated(df, items).collect()] == [5]


def test_values_of_other_lengths(spark):
    question = "Anna buys 3 kg of red apples and then Anna sells 2 kg of them to Boris before noon, how many kg does Anna have if 3 apples were bad?"
    short = "Mary Ann lives in New York City on the way home"  # 8 windows of one token each need the names apart
    items = spark.createDataFrame([(1, question), (2, short)], "item_id long, text string")
    docs = [
        (1, question.replace("Anna", "Mary Ann")),
        (2, "so it was " + question.replace("3", "12 000").replace("Boris", "Boris Witt") + " so it was"),
        (3, question.replace("Anna", "Mary Ann", 1).replace("3", "9 500", 1)),  # slots that contradict
        (4, short.replace("Mary", "Jane")),
        (5, "Mary Ann buys 3 kg of red apples and then"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, items).collect()} == {(1, 1), (2, 1), (4, 2)}
    assert [r.doc_id for r in D.drop_contaminated(df, items).collect()] == [5]  # 3 has a long literal part


def test_repeated_ids_and_long_texts(spark):
    """Rows with one id and different texts are compared by themselves; repeated rows change nothing."""
    question = "Anna buys 3 kg of red apples and then Anna sells 2 kg of them to Boris before noon"
    other = "the wide river runs from the old hills down to the grey sea and never once turns back"
    items = spark.createDataFrame([(1, question), (1, other), (1, other), (None, other)], "item_id long, text string")
    rng = random.Random(6)
    long = " ".join(rng.choices("one two three four five six seven".split(), k=150_000))
    docs = [(1, question.replace("3", "7")), (1, other), (1, "nothing of the kind at all in this one"), (2, long + " " + other), (3, long), (None, other), (4, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted(tuple(r) for r in D.contaminated(x, items, D.ALL).collect()) for x in (df, df.union(df), df.orderBy("text"))]
    assert {r[:2] for r in got[0]} == {(1, 1), (2, 1), (4, 1)} and got[0] == got[1] == got[2]
    assert sorted((r.doc_id or 0, len(r.text)) for r in D.drop_contaminated(df, items).collect()) == [(0, len(other)), (3, len(long))]
