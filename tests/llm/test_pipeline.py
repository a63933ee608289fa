import random
from pathlib import Path

import corpus_pipeline
from tests.llm.brute import near
from tests.llm.test_pii import base

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in ("n", "r", "st", "lm")]
    docs, labels = [], []
    item = " ".join(rng.choices(vocab, k=30))
    for i in range(400):
        words = rng.choices(vocab, k=rng.randint(20, 60))
        bad = i % 4 == 3
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        if i % 40 == 1:
            text += " " + item
        if i % 40 == 2:
            text += f" mail a{i}@b.co now"
        docs.append((i, text, "en", rng.choice("ab"), len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(500 + k, docs[k][1] + " more", "en", "a", 1) for k in range(0, 40, 4)] + [(600, None, None, None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != "mixing":
            assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, rows = {r.doc_id: r for r in rows.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in rows.collect()}
        assert rows.count() == len(kept[name]) and set(kept[name]) <= set(before)
        if name == "quality":
            wrong = [i for i in range(400) if (i in kept[name]) != (i % 4 != 3)]
            assert len(wrong) <= 4
        elif name == "near_dups":
            assert set(kept[name]) == {i for i, _, _, keep in near([(i, r.text) for i, r in before.items()], 5) if keep}
        elif name == "decontamination":
            assert set(kept[name]) == {i for i, r in before.items() if item not in (r.text or "")}
        elif name == "pii":
            assert set(kept[name]) == set(before) and not any(base(r.text) for r in kept[name].values())
            assert all(r.text == before[i].text for i, r in kept[name].items() if not base(before[i].text))
    taken = sum(r.taken for r in kept["mixing"].values())
    assert abs(taken - sum(len(r.text.split()) for r in kept["pii"].values() if r.text)) <= 3
    ran = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert ran == {i: r.taken for i, r in kept["mixing"].items()}
    assert Path(tmp_path).exists()


def test_odd_tables(spark, tmp_path):
    """Extra columns with clashing names, null ids, texts and labels, and empty tables."""
    text = "some plain words that say nothing of note to anyone at all"
    docs = [(1, text, "en", "a", 9, "x"), (1, text, "en", "a", 9, "y"), (2, None, None, None, None, None), (None, "one two", "en", "b", 7, "z")]
    schema = SCHEMA + ", keep string"
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, text), (3, None)], "item_id long, text string")
    for name, rows in (("some", docs), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{d}/labels.parquet")
        (items if rows else items.limit(0)).write.parquet(f"{d}/benchmark.parquet")
    got = sorted(((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()), key=str)
    assert sum(n for _, n in got) == 14 and {i for i, _ in got} == {1, None}  # 12 words once, 2 of the null id
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
