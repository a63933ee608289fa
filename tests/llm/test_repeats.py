import hashlib
import random
from collections import defaultdict

from thalweg.llm.repeats import remove_repeats


def brute(docs, length):
    starts = defaultdict(list)
    raws = [(i, (t or "").encode()) for i, t in docs]
    for n, (_, raw) in enumerate(raws):
        for q in range(len(raw) - length + 1):
            starts[raw[q : q + length]].append((n, q))
    gone = [bytearray(len(raw)) for _, raw in raws]
    for places in starts.values():
        if len(places) > 1:
            for n, q in places:
                gone[n][q : q + length] = b"\1" * length
    out = []
    for (i, raw), g in zip(raws, gone, strict=True):
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out.append((i, len(raw), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng, copies):
    def noise(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    passage, other = noise(900), noise(500)
    docs = [None, "", "short", "a" * 1500, "ab" * 400, noise(399)]
    for _ in range(copies):  # one passage between different texts, cut at different places
        a, b = rng.randint(0, 200), rng.randint(600, 900)
        docs.append(noise(rng.randint(0, 300)) + passage[a:b] + noise(rng.randint(0, 300)))
    for _ in range(12):
        docs.append(noise(rng.randint(100, 700)))
    docs += [noise(50) + other + noise(30) + other + "end", other[:399], other[1:], docs[8], docs[8], noise(300) + docs[9][100:700]]
    edited = list(passage)
    for k in range(0, 900, 410):
        edited[k] = "#"
    docs.append("".join(edited))
    return list(enumerate(docs))


def test_matches_brute_force(spark):
    for seed, copies in ((1, 8), (2, 150)):  # below and above the size at which groups are split
        docs = corpus(random.Random(seed), copies)
        df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes long")
        got = sorted((tuple(r)[:5] for r in remove_repeats(df).collect()), key=str)
        assert got == brute(docs, 400)


def test_odd_rows(spark):
    text = "".join(random.Random(5).choices("xyz ", k=700))
    docs = [(1, text), (1, text), (None, text), (None, None), (2, "z" + text[:399])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r)[:5] for r in remove_repeats(df).collect()), key=str)
    assert got == brute(docs, 400)
    assert remove_repeats(df.limit(0)).collect() == []


def brute_words(docs, n):
    """Words of each row in runs of n words that another row has too."""
    rows = [(t or "").split() for _, t in docs]
    holders = defaultdict(set)
    for k, w in enumerate(rows):
        for q in range(len(w) - n + 1):
            holders[tuple(w[q : q + n])].add(k)
    out = []
    for (i, _), w in zip(docs, rows, strict=True):
        on = bytearray(len(w))
        for q in range(len(w) - n + 1):
            if len(holders[tuple(w[q : q + n])]) > 1:
                on[q : q + n] = b"\1" * n
        out.append((i, sum(on)))
    return sorted(out, key=str)


def test_shared_words_match_brute_force(spark):
    rng = random.Random(9)

    def said(n):
        return [rng.choice("ab é cd efg h ij".split()) + str(rng.randint(0, 40)) for _ in range(n)]

    passage, hot = said(60), said(51)
    docs = [None, "", " ".join(hot[:49]), " ".join(said(400)), "  ".join(passage), " ".join(said(30) + passage[5:56] + said(9)), "\n".join(said(3) + passage + passage)]
    docs += [" ".join(said(rng.randint(0, 40)) + hot + said(5)) for _ in range(40)]
    docs += [docs[3], " ".join(p := said(80)) + " x " + " ".join(p)]  # a copy; a passage twice in one row only
    docs = list(enumerate(docs)) + [(None, docs[3]), (3, docs[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (50, 7):
        got = sorted(((r.doc_id, r.n_shared_words) for r in remove_repeats(df, words=n).collect()), key=str)
        assert got == brute_words(docs, n)


def test_short_passage_of_over_50_words_is_found(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choices("to of in a is it on at".split(), k=52))  # below 400 bytes
    docs = [(k, f"one{k} {' '.join(rng.choices('xyz', k=30))} {passage} end{k}") for k in range(3)] + [(9, "x " * 300)]
    got = {r.doc_id: (r.n_removed, r.n_shared_words) for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k] == (0, 52) for k in range(3)) and got[9][1] == 0
