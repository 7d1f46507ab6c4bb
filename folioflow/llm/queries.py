"""Queries of the text operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import once
from folioflow.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return once(table(spark, d, "chunks").select("chunk_id", *cols), "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import markup

    marked = markup.clean(_chunks(spark, d, "content").where("content IS NOT NULL")).where("marked")
    elements = marked.select(
        F.col("chunk_id").alias("rec_id"),
        F.posexplode(F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("inline")))).alias("p", "kind"),
        F.size("kinds").alias("n"),
    ).select("rec_id", F.when(F.col("n") > 0, F.col("p") + 1).otherwise(0).cast("int").alias("elem_no"), "kind")
    raw = markup.formulas(table(spark, d, "blocks")).where("bare <> trim(raw)")
    return elements.unionByName(raw.select(F.col("id").alias("rec_id"), F.lit(0).cast("int").alias("elem_no"), F.lit("formula_raw").alias("kind")))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import markup

    return markup.clean(_chunks(spark, d, "content")).select("chunk_id", "marked", "text")


def p3_formulas(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import markup

    return markup.formulas(table(spark, d, "blocks")).select("id", "bare")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import homoglyphs

    return homoglyphs.unify(_chunks(spark, d, "content")).select("chunk_id", F.explode("kinds").alias("kind"))


def p7_unified(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import homoglyphs

    return homoglyphs.unify(_chunks(spark, d, "content")).select("chunk_id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import bpe

    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import names

    return names.link(table(spark, d, "authorships"), table(spark, d, "authority"))


def p5_citation_authors(spark: SparkSession, d: str) -> DataFrame:
    """The people of ``chunks.citation.authors``: spelling and entry, where exactly one fits."""
    from folioflow.llm import names

    spellings = table(spark, d, "chunks").select(F.explode("citation.authors").alias("spelling"))
    fits = names.accepted(spellings, table(spark, d, "authority"), True)
    return fits.groupBy("spelling").agg(F.max("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("n")).where("n = 1").select("spelling", "entity_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import names

    return names.variants(table(spark, d, "authorships").select(F.col("name").alias("spelling")))


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that may be scans and all blocks of OCR, with title and journal, against all clean contents."""
    from folioflow.llm import scans

    chunks = table(spark, d, "chunks").select("chunk_id", "content", F.col("source").alias("paper_id"), F.col("citation.title").alias("t"), F.col("citation.journal").alias("j")).where("content IS NOT NULL")
    blocks = table(spark, d, "blocks").where("content IS NOT NULL").select("block_id", "paper_id", "type", "content", "source")
    papers = table(spark, d, "papers").where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.any_value("title", True).alias("title"), F.any_value("journal", True).alias("journal"))
    pages = once(chunks.where(scans.scanned(F.col("content"))), "chunk_id").join(papers, "paper_id", "left")
    pages = pages.select(F.col("chunk_id").alias("rec_id"), "content", F.lit(False).alias("sure"), F.coalesce("t", "title").alias("title"), F.coalesce("j", "journal").alias("journal"))
    ocr = once(blocks.where("source = 'ocr'"), "block_id").join(papers, "paper_id", "left")
    ocr = ocr.select(F.col("block_id").cast("string").alias("rec_id"), "content", F.lit(True).alias("sure"), "title", "journal")
    running = blocks.where("source <> 'ocr' AND type IN ('paragraph', 'abstract')").select("content")
    clean = running.unionByName(chunks.where(~scans.scanned(F.col("content"))).select("content"))
    return scans.repair(pages.unionByName(ocr), clean)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("kind <> 'text'").select("rec_id", "line_no", "kind")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("kind = 'text'").select("rec_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import packing

    return packing.containers(table(spark, d, "documents").select("doc_id", "text"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows are: one row per tenth of the capacity."""
    from folioflow.llm import packing

    per = p9_containers(spark, d).groupBy("container").agg(F.sum(F.col("end_tok") - F.col("begin_tok")).alias("n"))
    return per.groupBy(F.ceil(F.col("n") * 10 / packing.CAPACITY).cast("int").alias("tenth")).agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"))


def _blocks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    rows = table(spark, d, "blocks").where("type IN ('paragraph', 'abstract')").select("block_id", "content", *cols)
    return once(rows, "block_id")


def _rules(spark: SparkSession, d: str):
    """Sentence rules; the counts take every paragraph and abstract, by the language of its label."""
    from folioflow.llm import langid, sentences

    rows = table(spark, d, "blocks").where("type IN ('paragraph', 'abstract') AND content IS NOT NULL").select("content", "language")
    return sentences.learn(sentences.statistics(rows, "content", "language", langid.label_code))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import langid

    rows = table(spark, d, "blocks").where("type IN ('paragraph', 'abstract') AND source <> 'ocr'").select("block_id", "content", "language")
    rules, machines = _rules(spark, d), langid.train(rows)
    return langid.segments(_blocks(spark, d, "language"), "block_id", "content", "language", rules, machines)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).where("wrong").select("block_id", "seg_no", "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).drop("wrong")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import langid, sentences

    rows = table(spark, d, "blocks").where("type IN ('paragraph', 'abstract') AND source = 'grobid'").select("block_id", "content", "language")
    return sentences.split(once(rows, "block_id"), "block_id", "content", _rules(spark, d), "language", langid.label_code)


#: Word shingles of three tokens, 64 runs of 4 byte positions: a pair at 0.6 is missed with probability 0.0016.
CONTENT = dict(size=3, threshold=0.6, run=4, runs=64, least=2)
#: Single tokens, 256 runs of 12 byte positions: a pair at 0.75 is missed with probability 0.0025, at 0.8 with 0.0000001.
TITLE = dict(size=1, threshold=0.75, run=12, runs=256, least=2, late=True)


def _near_content(spark: SparkSession, d: str):
    from folioflow.llm import neardup

    return neardup.near(table(spark, d, "chunks").select("chunk_id", "content"), "chunk_id", "content", **CONTENT)


def _near_titles(spark: SparkSession, d: str):
    from folioflow.llm import neardup

    return neardup.near(table(spark, d, "papers").select("paper_id", "title"), "paper_id", "title", **TITLE)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import neardup

    content = neardup.pairs(_near_content(spark, d), "chunk_id").select(F.lit("content").alias("field"), "id_a", "id_b")
    titles = neardup.pairs(_near_titles(spark, d), "paper_id").select(F.lit("title").alias("field"), "id_a", "id_b")
    return content.unionByName(titles)


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import neardup

    return neardup.summary(_near_content(spark, d), "chunk_id")


def p6_title_classes(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import neardup

    return neardup.summary(_near_titles(spark, d), "paper_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import spans

    return spans.merge(spans.shared(table(spark, d, "documents").select("doc_id", "text")))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    from folioflow.llm import spans

    docs = table(spark, d, "documents").select("doc_id", "text")
    covered = spans.merge(spans.shared(docs)).groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("begin_at")).alias("n_shared"))
    n = F.coalesce(F.length("text"), F.lit(0))
    return docs.join(covered, "doc_id", "left").select(
        "doc_id", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"), F.when(n > 0, F.round(F.coalesce("n_shared", F.lit(0)) / n, 6)).otherwise(0.0).alias("share")
    )


def p10_removed(spark: SparkSession, d: str) -> DataFrame:
    """Stretches to remove so that each shared passage stays in its earliest document."""
    from folioflow.llm import spans

    return spans.merge(spans.shared(table(spark, d, "documents").select("doc_id", "text")).where("later"))


def _all() -> dict[str, Query]:
    here = globals()
    return {n: here[n] for n in sorted((n for n in here if n[0] == "p" and n[1:2].isdigit()), key=lambda n: (int(n[1:].split("_")[0]), n))}


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        return run

    return {n: shipped(f) for n, f in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {}
