import hashlib
import itertools
import math
import random
import re

from pyspark.sql import functions as F

from thalweg.llm import pii
from thalweg.llm.pii import find_pii, mask_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def texts():
    rng = random.Random(2)
    atoms = ["a@b.c", "x.y+z@mail-1.example.com", "@", "..", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1", "00255.0.0.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (504) 555-3727", "+49 ", "+12345", "(555) 555-1234", "é", "🙂", " ", " ", "\n", "password=39886b6a3ae06c044d", "id=12345678", "7", "-", ".", "+", "Dr. Anna Bell"]
    out = [None, "", "a" * 30000, "1" * 30000, "a." * 9000 + "@", "1." * 5000, "+1" * 3000, "1 " * 9000]
    return out + ["".join(rng.choices(atoms, k=rng.randint(1, 25))) for _ in range(600)]


def test_base_spans_match_brute_force(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        want = base(text)
        names = [f"{k}:{s}:{e}" for k, s, e in want]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in PATTERNS], (text, r)
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest(), (text, names, r)
        assert r.spans.split(",")[: len(names)] == (names or r.spans.split(",")[:0])
        for extra in r.spans.split(",")[len(names) :] if r.spans else []:
            kind, s, e = extra.split(":")
            assert all(int(e) <= b or int(s) >= c for _, b, c in want), (text, extra)


def test_added_spans_and_masks(spark):
    rows = [(i, f"the word password={'%018x' % (i * 7919 + 0xABCDEF0123456789)} here", "en", "s", 1) for i in range(30)]
    rows += [(100 + i, f"see page id={10000000 + i} for more", "en", "s", 1) for i in range(30)]
    rows += [(200, "mail é a@b.co now", "en", "s", 17), (201, None, None, None, None), (202, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.spans for r in find_pii(df).collect()}
    assert all(got[i].startswith("secret:18:") for i in range(30)), got[0]
    assert all(got[100 + i] == "" for i in range(30)), got[100]
    masked = {r.doc_id: r for r in mask_pii(df).collect()}
    assert mask_pii(df).columns == df.columns
    assert masked[0].text == "the word password=<SECRET> here" and masked[0].n_chars == len(masked[0].text)
    assert masked[200].text == "mail é <EMAIL> now" and masked[200].n_chars == 18
    assert tuple(masked[201]) == rows[-2] and tuple(masked[202]) == rows[-1] and tuple(masked[100]) == rows[30]
    assert find_pii(df.limit(0)).collect() == [] and mask_pii(df.limit(0)).collect() == []


def test_quoted_spaced_and_long_secrets(spark):
    def key(i, n=40):
        return hashlib.sha512(str(i).encode()).hexdigest()[:n] if n <= 128 else "".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(4))[:n]

    forms = ['see token = "{}" here', "see token='{}' here", "see secret: {} here", '{{"api_key": "{}"}}', "see password={} here"]
    rows = [(10 * i + k, f.format(key(i))) for i in range(20) for k, f in enumerate(forms)]
    rows += [(1000, f'token = "{key(7, 300)}"'), (1001, "the word is: something and page : nothing more")]
    got = {r.doc_id: r.text for r in mask_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(20):
        for k, f in enumerate(forms):
            assert got[10 * i + k] == f.format("<SECRET>")
    assert got[1000] == 'token = "<SECRET>"' and got[1001] == rows[-1][1]


def slow_fit(patterns, em=True):
    """Posterior of each pattern (kind, votes, size, mix, n) and the fitted classifier, in plain loops."""

    def logistic(x):
        return 1 / (1 + math.exp(-x))

    def odds(p):
        return math.log(p / (1 - p))

    signs = [[1] + [0 if v is None else 2 * v - 1 for v in p[1]] for p in patterns]
    n = [p[4] for p in patterns]
    state = [0.5] + [0.8] * 4
    for _ in range(pii.ROUNDS if em else 0):
        post = [logistic(sum(s * odds(q) for s, q in zip(v, state))) for v in signs]
        right = [sum(c * (p if v[k] > 0 else 1 - p) for c, p, v in zip(n, post, signs) if v[k]) for k in range(5)]
        known = [sum(c for c, v in zip(n, signs) if v[k]) for k in range(5)]
        state = [(right[0] + 1) / (known[0] + 2)] + [min(0.99, max(0.55, (right[k] + 1.6) / (known[k] + 2))) for k in range(1, 5)]
    post = [logistic(sum(s * odds(q) for s, q in zip(v, state))) for v in signs]
    rows = []
    for kind, votes, size, mix, _ in patterns:
        x = [1.0] + [float(kind == k) for k in pii.EXTRA]
        x += [float(v == want) for v in votes for want in (0, 1)] + [float(step == k) for step in (size, mix) for k in range(3)]
        rows.append(x)
    w = [0.0] * len(rows[0])
    seen = [sum(c * x[j] for c, x in zip(n, rows)) for j in range(len(w))]
    for _ in range(pii.STEPS):
        wrong = [t - logistic(sum(a * b for a, b in zip(x, w))) for x, t in zip(rows, post)]
        slope = [sum(c * e * x[j] for c, e, x in zip(n, wrong, rows)) for j in range(len(w))]
        w = [a + 4 * g / 10 / (0.25 + 0.25 * s) for a, g, s in zip(w, slope, seen)]
    return state, post, w, [logistic(sum(a * b for a, b in zip(x, w))) >= pii.ACCEPT for x in rows]


def vote_patterns():
    """Votes of labelers that are right 95, 90, 90 and 40 times in a hundred on candidates of which a third is personal."""
    rng, counts = random.Random(12), {}
    for _ in range(6000):
        truth = int(rng.random() < 1 / 3)
        votes = tuple(None if rng.random() < 0.2 else truth if rng.random() < q else 1 - truth for q in (0.95, 0.9, 0.9, 0.4))
        key = (rng.choice(["secret", "iban", "person"]), votes, rng.randrange(3), rng.randrange(3))
        counts[key] = counts.get(key, 0) + 1
    return [(*k, n) for k, n in counts.items()]


def test_votes_are_weighed_as_a_slow_fit_weighs_them(spark):
    patterns = vote_patterns()
    rows = [(k, *v, s, m, n) for k, v, s, m, n in patterns]
    df = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{k} int" for k in (*pii.LABELERS, "size", "mix")) + ", n long")
    weights = pii.span_classifier(df)
    state, post, w, accept = slow_fit(patterns)
    assert max(abs(a - b) for a, b in zip(weights.values(), w, strict=True)) < 1e-9
    ok = pii.accepted(weights)
    x = F.struct(*df.columns)
    got = {tuple(r)[:-2]: r.ok for r in df.withColumn("ok", ok(x)).collect()}
    assert [got[tuple(r[:-1])] for r in rows] == accept
    # reliabilities come out in their order, and decide other than a plain majority or equal weights would
    assert state[1] > 0.9 and min(state[2:4]) > 0.8 and state[4] < 0.6
    majority = [sum(v for v in p[1] if v is not None) * 2 > sum(v is not None for v in p[1]) for p in patterns]
    assert accept != majority and accept != slow_fit(patterns, em=False)[3]


def test_labelers_vote_for_and_against(spark):
    cases = {
        "iban is GB82 WEST 1234 5698 7654 32 here": ("iban", 1, 1, None),
        "iban is GB83 WEST 1234 5698 7654 32 here": ("iban", 0, 1, None),
        "iban is ZZ83 WEST 1234 5698 7654 32 here": ("iban", 0, 0, None),
        "ssn: 078-05-1120 ok": ("ssn", 1, 0, 1),
        "ssn: 536-22-8726 ok": ("ssn", 1, 1, 1),
        "number 000-22-8726 ok": ("ssn", 0, None, None),
        "we met Dr. Anna Bell": ("person", 1, 1, None),
        "we met Dr. Who": ("person", 0, 0, None),
        "call (212) 664-7665 now": ("tel", 1, None, 1),
        "see (012) 555-0123 now": ("tel", 0, 0, None),
        'token = "39886b6a3ae06c044d77"': ("secret", 1, 1, 1),
        "password=your-example-key-1234567": ("secret", 1, 0, 1),
        "commit: 39886b6a3ae06c044d77": ("secret", 1, None, 0),
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string").select("text", F.explode(pii.candidate_spans(F.col("text"))).alias("x"))
    got = {r.text: (r.x.kind, r.x.strict, r.x.gazetteer, r.x.context) for r in df.collect()}
    assert {t: v[:3] for t, v in got.items()} == {t: v[:3] for t, v in cases.items()}
    assert {t: v[3] for t, v in got.items() if v[0] in ("ssn", "tel", "secret")} == {t: v[3] for t, v in cases.items() if v[0] in ("ssn", "tel", "secret")}


def test_repeated_rows(spark):
    rows = [(1, 'token = "39886b6a3ae06c044d77" a@b.co')] * 3 + [(2, "x")]
    got = [tuple(r) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == 4 and len(set(got)) == 2
