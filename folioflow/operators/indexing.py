"""From files or prepared chunks to an index on disk, and searches on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import metadata as md
from folioflow.functions.formulas import valid
from folioflow.operators import answer, blocks, chunking, retrieval
from folioflow.options import Options
from folioflow.session import checkpoint
from folioflow.sources import readers

Embedder = Callable[[Column], Column]


def formula_text(f: Column) -> Column:
    """What of a formula is embedded: what it says, what it means, its LaTeX."""
    return F.concat_ws(" ", f.description, f.semantic_description, f.latex)


def chunk_vectors(chunks: DataFrame, embed: Embedder) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of the contents and of the formulas of chunks (chunk_id, content, formulas); a formula's id is its chunk's."""
    text = chunks.where("content <> ''").select(F.col("chunk_id").alias("id"), embed(F.col("content")).alias("vec"))
    each = chunks.select(F.col("chunk_id").alias("id"), F.explode("formulas").alias("f")).select("id", formula_text(F.col("f")).alias("t")).where("t <> ''")
    return text, each.select("id", embed(F.col("t")).alias("vec"))


@dataclass
class Index:
    """Chunks, their vectors and their lexical index; vectors of another width than the first are an error of the search."""

    chunks: DataFrame
    text: DataFrame
    formulas: DataFrame
    lexical: retrieval.LexicalIndex
    embed: Embedder

    def save(self, path: str) -> None:
        readers.save_tables({"chunks": self.chunks, "text_vectors": self.text, "formula_vectors": self.formulas}, path)
        self.lexical.save(f"{path}/lexical")

    @staticmethod
    def load(spark: SparkSession, path: str, embed: Embedder) -> "Index":
        read = spark.read.parquet
        return Index(read(f"{path}/chunks"), read(f"{path}/text_vectors"), read(f"{path}/formula_vectors"), retrieval.LexicalIndex.load(spark, f"{path}/lexical"), embed)

    def search(self, questions: DataFrame, k: int, mode: str = "rrf") -> DataFrame:
        """(qid, id, score, rank) of ``questions (qid, query)``: dense, bm25, weighted or rrf."""
        asked = questions.select("qid", "query", self.embed(F.col("query")).alias("vec"))
        n = k if mode in ("dense", "bm25") else 3 * k
        dense = retrieval.once_per_chunk(retrieval.dual(self.text, self.formulas, asked, 3 * n), n)
        return retrieval.search(mode, dense, retrieval.bm25(self.lexical, questions.select("qid", "query"), n), k)

    def answers(self, questions: DataFrame, k: int = 70, top: int = 3, generator: Callable[[Column], Column] = answer.extractive) -> DataFrame:
        """(qid, prompt, answer) with cited context from the best ``top`` chunks."""
        c = self.chunks.select(F.col("chunk_id").alias("id"), "content", "title", "authors", "year", "section", F.try_element_at("pages", F.lit(1)).alias("page"))
        hits = self.search(questions, k).where(F.col("rank") <= top).join(c, "id")
        source = answer.source_line(F.col("title"), F.col("authors"), F.col("year"), F.col("page"), F.col("section"))
        return answer.answers(questions, answer.context(hits.withColumn("source", source), top), generator)


def build(chunks: DataFrame, embed: Embedder | None = None) -> Index:
    """Index of chunks (chunk_id, content, formulas, title, authors, year, section, pages)."""
    embed = embed or retrieval.hashing_embedder()
    text, formulas = chunk_vectors(chunks, embed)
    return Index(chunks, text, formulas, retrieval.lexical_index(chunks, "chunk_id", F.col("content")), embed)


def typed(layout: DataFrame) -> DataFrame:
    """Merged layout blocks as formulas or paragraphs: short ones that hold as formulas are formula candidates."""
    looks = (F.length("text") < 250) & valid(F.col("text")) & F.col("text").rlike(r"[=≈≤≥∂∇∑∫]")
    kind = F.when(looks, F.lit("formula_candidate")).otherwise(F.lit("paragraph"))
    null = lambda t: F.lit(None).cast(t)
    return layout.select(
        "paper_id", (F.col("page") * 100_000 + F.col("pos")).alias("pos"), F.xxhash64("paper_id", "page", "pos").alias("block_id"), kind.alias("type"), F.col("text").alias("content"), F.when(looks, F.col("text")).alias("latex"),
        "page", null("string").alias("section"), null("string").alias("label"),
    )


def chunks_of_files(files: DataFrame, parser: readers.Parser = readers.pdf_parser, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of binary files (path, content, cache_key), and (path, error) of those that can't be read."""
    layout = checkpoint(readers.layout_blocks(files, parser))
    failed = layout.where("error IS NOT NULL").select(F.col("paper_id").alias("path"), "error")
    rows = layout.where("error IS NULL")
    # title, authors and year stand on the first pages of a file
    first = rows.where("page <= 2").groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "pos", "text"))), lambda x: x.text), "\n").alias("t"))
    name = F.regexp_replace(F.element_at(F.split("paper_id", "/"), -1), r"\.[^.]*$", "")
    about = first.select("paper_id", md.title(F.col("t"), F.lit(None).cast("string"), name).alias("title"), md.all_authors(F.col("t")).alias("authors"), md.year(F.col("t")).alias("year"))
    ordered = blocks.normalize_blocks(checkpoint(_plain(blocks.clean_blocks(typed(blocks.merge_layout(rows))))))
    made = chunking.pack(ordered, options).join(about, "paper_id", "left").join(files.select(F.col("path").alias("paper_id"), "cache_key"), "paper_id", "left")
    return made, failed


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("paper_id", "pos", "block_id", "type", "content", "latex", "page", "section", F.lit(None).cast("string").alias("label"))


def index_directory(spark: SparkSession, directory: str, out: str, embed: Embedder | None = None, parser: readers.Parser = readers.pdf_parser, glob: str = "*.pdf", options: Options | None = None) -> Index:
    """Every file below a directory to an index at ``out``; files with the same content and options are taken from its cache of chunks.

    Files that fail are listed with their error in ``out/failed`` and the others go on.
    """
    embed = embed or retrieval.hashing_embedder()
    files = readers.binary_files(spark, directory, glob, options)
    schema = chunk_schema()
    cache = readers.load_table(spark, out, "cache", schema)
    chunks, failed = chunks_of_files(readers.not_cached(files, cache), parser, options)
    failed.write.mode("overwrite").parquet(f"{out}/failed")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    chunks.select(*names).write.mode("append").parquet(f"{out}/cache")
    kept = spark.read.schema(schema).parquet(f"{out}/cache").join(files.select("cache_key").distinct(), "cache_key", "left_semi")
    build(kept, embed).save(f"{out}/index")
    return Index.load(spark, f"{out}/index", embed)


def chunk_schema() -> str:
    return f"cache_key string, paper_id string, part int, section string, n int, chunk_id string, content string, pages array<int>, formulas array<{chunking.CHUNK_FORMULA}>, title string, authors array<string>, year string"


def index_ready_chunks(spark: SparkSession, directory: str, out: str, embed: Embedder | None = None) -> Index:
    """Prepared chunk files (``*_chunks.json``) to an index at ``out``; malformed files are listed in ``out/failed``."""
    embed = embed or retrieval.hashing_embedder()
    files = readers.chunk_files(spark, directory)
    files.where("error IS NOT NULL").select(F.col("file").alias("path"), "error").write.mode("overwrite").parquet(f"{out}/failed")
    c = readers.ready_chunks(files)
    c = c.select("*", F.col("citation.title").alias("title"), F.col("citation.authors").alias("authors"), F.col("citation.year").alias("year"), F.col("pages") if "pages" in c.columns else F.array().cast("array<int>").alias("pages"))
    build(c, embed).save(f"{out}/index")
    return Index.load(spark, f"{out}/index", embed)
