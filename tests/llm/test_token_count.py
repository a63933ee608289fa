import json
import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thalweg.llm.token_count import HeapMerger, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merger():
    return HeapMerger(PATH)


def test_matches_library(merger):
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(7)
    alphabet = list("abc the ing  \n\t.'sd0129!?-éüß中文🙂  ́\x1c\x85Ω") + ["<|endoftext|>", "'ll", "  "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(3000)] + ["a" * 20000, "ab" * 9000, " " * 5000, "<|endoftext|>"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    bad = [(t, w, g) for t, w in zip(texts, want, strict=True) if (g := merger.count(t)) != w]
    assert not bad[:3]


def test_edges(spark, merger):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(df, PATH, limit=1).collect()))
    n = merger.count("hello world")
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 11, n, n > 1), (3, 11, n, n > 1)]
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_other_files_are_refused(tmp_path):
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    changes = [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", spec["pre_tokenizer"] | {"add_prefix_space": True}), ("model", spec["model"] | {"byte_fallback": True})]
    changes.append(("added_tokens", [spec["added_tokens"][0] | {"lstrip": True}]))
    for key, value in changes:
        (tmp_path / "x.json").write_text(json.dumps(spec | {key: value}), encoding="utf-8")
        with pytest.raises(ValueError, match=key):
            HeapMerger(str(tmp_path / "x.json"))


def test_long_texts(spark, merger):
    """Very long words and texts are counted whole, as the library counts them."""
    lib = Tokenizer.from_file(PATH)
    texts = ["ab" * 40_000, "the " * 100_000, "\n" * 30_000, "é中" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.n_bytes, r.n_tokens) for r in count_tokens(df, PATH).orderBy("doc_id").collect()]
    assert got == [(len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for t in texts]
