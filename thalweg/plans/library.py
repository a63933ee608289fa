"""A searchable library of chunks: build, save, load, search, retrieve, ask."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cite, index_text
from ..operators import reports, search
from ..sources.chunks import chunk_files


def union_files(parts: list[DataFrame]) -> DataFrame:
    """The files of several repositories as one table."""
    return reduce(DataFrame.unionByName, parts)


class Library:
    """Chunks with their postings and lengths; vectors are optional. All tables are saved, none is rebuilt on load."""

    TABLES = ("chunks", "postings", "lengths")

    def __init__(self, chunks: DataFrame, postings: DataFrame, lengths: DataFrame, embed_query: Callable[[str], list[float]] | None = None):
        self.chunks, self.postings, self.lengths, self.embed_query = chunks, postings, lengths, embed_query

    @classmethod
    def build(cls, files: DataFrame, folder: str, embed: Callable[[DataFrame], DataFrame] | None = None, **kw) -> Library:
        """Chunk files(repo, path, text or content), index them, and save everything under folder."""
        spark = files.sparkSession
        chunks = chunk_files(files)
        chunks = chunks.withColumn("doc_id", F.xxhash64("repo", "path", "kind", "name", "start_line", "text")).dropDuplicates(["doc_id"])
        (embed(chunks) if embed else chunks).write.mode("overwrite").parquet(f"{folder}/chunks")
        stored = spark.read.parquet(f"{folder}/chunks").withColumn("text", index_text())
        search.postings(stored).write.mode("overwrite").parquet(f"{folder}/postings")
        search.doc_lengths(stored).write.mode("overwrite").parquet(f"{folder}/lengths")
        return cls.load(spark, folder, **kw)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, **kw) -> Library:
        return cls(*(spark.read.parquet(f"{folder}/{t}") for t in cls.TABLES), **kw)

    def search(self, query: str, k: int = 8, rrf_k: int = search.RRF, path_filter: str | None = None, gate_lexical: bool = False) -> DataFrame:
        """The k best chunks with fused, bm25 and dense scores."""
        spark = self.chunks.sparkSession
        asked = spark.createDataFrame([(0, query)], "query_id int, query string")
        found = search.bm25(self.postings, self.lengths, asked).select("doc_id", "bm25")
        lexical = self.chunks.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))
        dense = None
        if self.embed_query and "vector" in self.chunks.columns:
            q = F.array(*(F.lit(float(x)) for x in self.embed_query(query)))
            dense = self.chunks.select("doc_id", F.coalesce(search.dot(F.col("vector"), q), F.lit(0.0)).alias("dense"))
        scores = search.fuse(lexical, dense, rrf_k, gate_lexical)
        rows = self.chunks.join(scores, "doc_id").withColumn("fused", F.col("fused") + search.boost(F.col("name"), F.col("path"), query))
        return search.top(rows, k, path_filter)

    def retrieve(self, question: str, k: int = 8, path_filter: str | None = None) -> DataFrame:
        """Excerpts: pieces of one unit merged, so that a long one doesn't crowd out the rest."""
        hits = self.search(question, 3 * k, path_filter=path_filter)
        return search.excerpts(hits.withColumn("cell", F.col("meta.cell")), k)

    def cites(self, hits: DataFrame) -> DataFrame:
        meta = [F.col(f"meta.{c}") for c in ("cell", "page", "slide")]
        return hits.withColumn("cite", cite(F.col("path"), F.col("start_line"), F.col("end_line"), *meta))

    def repo_map(self) -> DataFrame:
        """A line per file: the signatures it defines in order."""
        name = F.regexp_replace("name", r" \(part .*$", "")
        symbol = F.when(F.col("kind").isin("function", "class"), F.coalesce("meta.signature", F.concat(F.lit("class "), name)))
        return reports.symbol_map(self.chunks.select("repo", "path", F.coalesce("start_line", F.lit(0)).alias("ord"), symbol.alias("symbol"))).orderBy("repo", "path")

    def ask(self, question: str, k: int = 8, path_filter: str | None = None, history: list[dict] | None = None, answer: Callable[[list[dict]], str] | None = None) -> dict:
        """Excerpts for a question and, with a client, its answer. In a chat the previous question joins the
        search and the last six messages go along."""
        before = [m for m in history or [] if m["role"] == "user"]
        query = f"{before[-1]['content']} {question}" if before else question
        found = self.retrieve(query, k, path_filter)
        context = found.transform(search.context).first()["context"] or ""
        if answer is None:
            return {"question": question, "context": context, "answer": None}
        said = [*(history or [])[-6:], {"role": "user", "content": f"{context}\n\nQuestion: {question}"}]
        return {"question": question, "context": context, "answer": answer(said)}
