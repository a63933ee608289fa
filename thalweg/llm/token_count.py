"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

A text is cut into pre-tokens; each becomes a doubly linked list of byte symbols, a heap holds the
adjacent pairs by merge rank, and the lowest is merged until none is left. The count is the initial
symbols minus the merges. Pre-tokens repeat a lot, so each worker remembers counts in a bounded cache.

Files that ask for what isn't built (a normalizer, another pre-tokenizer or split, dropout, byte fallback, added
tokens that take neighbouring space or whole words only) are an error and not miscounted.

Null and empty texts count 0. The vocabulary's special strings inside a text count one token each, as
the library does by default. Rows are independent: repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 200_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for beyond byte-level BPE with the usual split."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    odd = [f"pre_tokenizer.{k}" for k, v in wanted.items() if pre.get(k, True if k == "use_regex" else None) != v]
    odd += ["normalizer"] * bool(spec.get("normalizer")) + ["model.type"] * (model.get("type", "BPE") != "BPE")
    odd += [f"model.{k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    return odd + [f"added_tokens.{k}" for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]


class HeapMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if odd := unsupported(spec):
            raise ValueError(f"{path}: {', '.join(odd)} not supported")
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.symbols = [vocab.get(c, -1 - i) for i, c in enumerate(byte_alphabet())]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        specials = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Initial symbols minus merges of one pre-token."""
        pairs = self.pairs
        ids = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        n = left = len(ids)
        if n < 2:
            return n
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*p, i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := pairs.get((ids[i], ids[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has merged with another since
            ids[i], ids[j] = new, None
            left -= 1
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if p := pairs.get((new, ids[k])):
                    heapq.heappush(heap, (p[0], i, p[1], new, ids[k]))
            h = prev[i]
            if h >= 0 and (p := pairs.get((ids[h], new))):
                heapq.heappush(heap, (p[0], h, p[1], ids[h], new))
        return left

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total, known = len(parts) - 1, self.known
        for part in parts:
            for word, times in Counter(self.split.findall(part)).items():
                n = known.get(word)
                if n is None:
                    n = self.word(word)
                    if len(known) >= CACHE:
                        known.clear()
                    if len(word) <= 64:
                        known[word] = n
                total += n * times
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row; vocabulary: path of a byte-level BPE .json on every executor."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = HeapMerger(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [merger.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
