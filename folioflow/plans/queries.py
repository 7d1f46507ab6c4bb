"""Queries of the retrieval engine's operators over whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions import formulas as fx
from folioflow.functions import metadata as md
from folioflow.functions import text as tx
from folioflow.operators import answer, blocks, chunking, kb, retrieval
from folioflow.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]
K = 10


# ------------------------------------------------------------ tables


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "title", "source", "year")


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Every document whose id is divisible by 100 asks with its title, or its text where it has none."""
    return _docs(s, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("title", "text", F.lit("")).alias("query"))


def _blocks(s: SparkSession, d: str, *more: str) -> DataFrame:
    cols = ["paper_id", "pos", "type", "content", "latex", "page", "section", "label", *more]
    b = table(s, d, "blocks").select("block_id", *cols)
    return b.groupBy("block_id").agg(F.any_value(F.struct(*cols)).alias("x")).select("block_id", "x.*")


def _chunks(s: SparkSession, d: str, *cols: str) -> DataFrame:
    c = table(s, d, "chunks").select("chunk_id", *cols)
    return c.groupBy("chunk_id").agg(F.any_value(F.struct(*cols)).alias("x")).select("chunk_id", "x.*")


def _kb(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "formula_kb")


def _formulas(s: SparkSession, d: str) -> DataFrame:
    b = table(s, d, "blocks").select("block_id", F.posexplode("formulas").alias("i", "f"))
    f = b.select("f.id", "f.raw", "f.latex", "f.source", "f.page", "f.confidence", "f.description", "f.context").where("id IS NOT NULL")
    return f.groupBy("id").agg(F.any_value(F.struct(*[c for c in f.columns if c != "id"])).alias("x")).select("id", "x.*")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _vector_questions(s: SparkSession, d: str) -> DataFrame:
    q = _vectors(s, d).where("id % 100 = 0").select(F.col("id").alias("qid"), "vec")
    return q.join(_docs(s, d).select(F.col("doc_id").alias("qid"), F.coalesce("title", "text", F.lit("")).alias("query")), "qid", "left").select("qid", "vec", F.coalesce("query", F.lit("")).alias("query"))


# ------------------------------------------------------------ lexical search


def tokenize_docs(s, d):
    t = tx.search_tokens(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_distinct"))


def _index(s, d):
    return retrieval.lexical_index(_docs(s, d), "doc_id", F.col("text"))


def bm25_postings(s, d):
    return _index(s, d).postings.select(F.col("id").alias("doc_id"), "term", "tf", "dl")


def bm25_idf(s, d):
    return _index(s, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(s, d, k=K):
    return retrieval.bm25(_index(s, d), _questions(s, d), k)


def bm25_topk_batch(s, d):
    return _bm25(s, d).select("qid", F.col("id").alias("doc_id"), "score", "rank")


def math_score(s, d):
    p = table(s, d, "papers").where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.max("title").alias("title"))
    return p.select("paper_id", F.round(tx.math_score(F.col("title")), 6).alias("math_score"))


# ------------------------------------------------------------ dense search and fusion


def dense_topk(s, d):
    return retrieval.dense(_vectors(s, d), _vector_questions(s, d), K).select("qid", F.col("id").alias("vec_id"), "score", "rank")


def _dual(s, d):
    v = _vectors(s, d)
    return retrieval.dual(v.where("label % 2 = 0"), v.where("label % 2 = 1"), _vector_questions(s, d), K)


def dual_index_fused(s, d):
    return _dual(s, d).select("qid", F.col("id").alias("vec_id"), "side", "score", "rank")


def dense_dedup_by_chunk(s, d):
    """Ten vectors stand for one chunk; each chunk comes once."""
    hits = _dual(s, d).select("qid", F.floor(F.col("id") / 10).alias("id"), "score")
    return retrieval.once_per_chunk(hits, K).select("qid", F.col("id").alias("chunk"), "score", "rank")


def _lists(s, d):
    q = _vector_questions(s, d)
    a = retrieval.dense(_vectors(s, d), q, 3 * K)
    b = retrieval.bm25(_index(s, d), q.select("qid", "query"), 3 * K)
    return a, b


def hybrid_rrf(s, d):
    return retrieval.rrf(*_lists(s, d), K)


def hybrid_weighted(s, d):
    return retrieval.weighted(*_lists(s, d), K)


def rerank_topk(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return retrieval.rerank(_bm25(s, d, 3 * K), _questions(s, d), docs, 5)


def hyde_multi_query_rrf(s, d):
    """The question and a hypothetical answer (the document's first sentence) searched side by side."""
    q = _docs(s, d).where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.coalesce("title", "text", F.lit("")).alias("query"), F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^.!?]*)", 1).alias("h"))
    parts = retrieval.hypothetical(q, F.col("h"))
    hits = retrieval.bm25(_index(s, d), parts.select(F.struct("qid", "part").alias("qid"), "query"), 3 * K)
    return retrieval.fuse(hits.select("qid.qid", "id", "rank"), K)


# ------------------------------------------------------------ text


def clean_text(s, d):
    return _blocks(s, d).where("content IS NOT NULL").select("block_id", tx.clean_text(F.col("content")).alias("clean"))


def clean_latex(s, d):
    return _blocks(s, d).where("latex IS NOT NULL").select("block_id", tx.clean_latex(F.col("latex")).alias("clean"))


def section_title_flag(s, d):
    return _blocks(s, d).select("block_id", tx.title_flag(F.col("content")).alias("is_title"))


def formula_fragment_flag(s, d):
    x = F.coalesce("latex", "content")
    return _blocks(s, d).select("block_id", fx.fragment_flag(x).alias("fragment"), fx.garbage_flag(x).alias("garbage"), fx.chunk_garbage_flag(x).alias("chunk_garbage"))


def link_tokens(s, d):
    return _kb(s, d).select("id", F.array_join(F.array_sort(F.array_distinct(tx.link_tokens(F.concat_ws(" ", "description", "latex", "context")))), " ").alias("tokens"))


def format_latex(s, d):
    return _chunks(s, d, "content").where("content IS NOT NULL").select("chunk_id", tx.format_latex(F.col("content")).alias("shown"))


def page_from_context(s, d):
    return _blocks(s, d).where("content IS NOT NULL").select("block_id", tx.page_of_context(F.col("content")).alias("page_named")).where("page_named IS NOT NULL")


# ------------------------------------------------------------ ordered blocks


def split_embedded_sections(s, d):
    return blocks.split_sections(_blocks(s, d).where("content IS NOT NULL")).select("block_id", "sub", "type", "content", "section")


def dedup_consecutive(s, d):
    return blocks.drop_repeated(blocks.drop_empty(_blocks(s, d))).select("block_id")


def empty_by_type(s, d):
    return blocks.drop_empty_by_type(_blocks(s, d, "formulas")).select("block_id")


def section_detect(s, d):
    return blocks.detect_sections(_blocks(s, d)).select("block_id", "type", "section")


def section_forward_fill(s, d):
    return blocks.forward_fill(_blocks(s, d)).select("block_id", "section")


def front_matter(s, d):
    return blocks.front_matter(_blocks(s, d)).select("block_id", "front", "section")


def merge_paragraphs(s, d):
    return blocks.merge_paragraphs(_blocks(s, d)).select("paper_id", "pos", "type", "content", "section", "n")


def merge_equations(s, d):
    return blocks.merge_equations(_blocks(s, d)).select("block_id", "type", "latex", "label", "section", "context_before", "description", "semantic_description")


def references_cutoff(s, d):
    return blocks.cut_references(_blocks(s, d)).select("block_id")


# ------------------------------------------------------------ chunking


def chunk_ids(s, d):
    c = _chunks(s, d, "content", "section", "citation", "pages")
    return c.select("chunk_id", chunking.chunk_id(F.coalesce("citation.paper_id", F.lit("unknown")), F.col("content"), F.col("section"), F.col("pages")).alias("made_id"))


def context_windows(s, d):
    return chunking.context_windows(_chunks(s, d, "content", "source"), "source", ["chunk_id"]).select("chunk_id", "prev", "next")


def search_text(s, d):
    b = table(s, d, "blocks").select("block_id", "content", "formulas")
    b = b.groupBy("block_id").agg(F.any_value(F.struct("content", "formulas")).alias("x")).select("block_id", "x.*").where("size(formulas) > 0")
    return b.select("block_id", chunking.search_text(F.col("content"), chunking.unique_formulas(F.col("formulas"))).alias("search_text"))


def chunk_pack(s, d):
    return chunking.pack(blocks.cleaned(_blocks(s, d, "source", "formulas"))).select("chunk_id", "paper_id", "part", "section", "n", "content", "pages", "formulas")


def clean_chain(s, d):
    return blocks.clean_blocks(_blocks(s, d)).select("paper_id", "pos", "block_id", "type", "content", "section", "n")


def normalize_chain(s, d):
    return blocks.normalize_blocks(_blocks(s, d)).select("block_id", "type", "latex", "section")


# ------------------------------------------------------------ formulas


def formula_score(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", F.round(fx.score(F.col("raw")), 6).alias("score"))


def formula_valid(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", fx.valid(F.col("raw")).alias("valid"))


def normalize_formula(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", fx.normalize(F.col("raw")).alias("normal"))


def known_repairs(s, d):
    text, sure = fx.known_repair(F.col("raw"))
    return _formulas(s, d).where("raw IS NOT NULL").select("id", text.alias("repaired"), sure.alias("confidence"))


def formula_variables(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", F.array_join(fx.variables(F.col("raw")), ",").alias("variables"))


def semantic_label(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", fx.semantic_label(F.col("raw"), F.col("context")).alias("label"))


def confidence(s, d):
    return _formulas(s, d).where("raw IS NOT NULL").select("id", F.round(fx.confidence(F.col("raw"), F.coalesce("source", F.lit("heuristic"))), 6).alias("confidence"))


def formula_candidates(s, d):
    """Whole cascade: repair, normalise, check, confidence, variables, meaning."""
    text, sure = fx.known_repair(F.col("raw"))

    def judged(n):
        conf = F.round(fx.confidence(n, F.coalesce("source", F.lit("heuristic")), sure), 6)
        return F.struct(n.alias("normal"), conf.alias("conf"), F.round(fx.score(n), 6).alias("score"), fx.semantic_label(n, F.col("context")).alias("label"), fx.valid(n).alias("valid"))

    f = _formulas(s, d).where("raw IS NOT NULL").select("id", F.inline(F.array(fx.bind(fx.normalize(text), judged))))
    return f.where("valid AND conf >= 0.25").select("id", "normal", "conf", "score", "label", (F.col("conf") >= 0.65).alias("use_for_index"))


def latex_blocks(s, d):
    c = _chunks(s, d, "content").where("content IS NOT NULL")
    found = c.select("chunk_id", F.posexplode(fx.latex_parts(F.col("content"))).alias("i", "latex"))
    key = F.regexp_replace("latex", r"\s+", "")
    w = Window.partitionBy("chunk_id", "key").orderBy("i")
    return found.withColumn("key", key).where("key <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").select("chunk_id", "latex")


def line_candidates(s, d):
    """Runs of neighbouring lines of a document that each look like a formula."""
    lines = _docs(s, d).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("i")
    scored = lines.select("doc_id", "i", F.inline(F.array(F.struct("line", (F.round(fx.score(fx.preclean(F.col("line"))), 6) >= 0.6).alias("hit")))))
    runs = scored.withColumn("run", F.sum(F.when(F.col("hit"), 0).otherwise(1)).over(w)).where("hit")
    g = runs.groupBy("doc_id", "run").agg(F.min("i").alias("first_line"), F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("p"))
    return g.select("doc_id", "first_line", "n_lines", F.array_join(F.transform("p", lambda x: x.line), "\n").alias("candidate"))


# ------------------------------------------------------------ knowledge base


def kb_upsert(s, d):
    f = _formulas(s, d).where("raw IS NOT NULL").select(F.col("raw").alias("latex"), "source", "page", F.col("confidence").alias("score"), F.col("id").alias("pos"))
    return kb.upsert(f).select("id", F.size("variants").cast("bigint").alias("n_variants"), F.size("sources").cast("bigint").alias("n_sources"), F.round("score", 6).alias("score"), "n")


def kb_text_search(s, d):
    q = _questions(s, d)
    return kb.search(_kb(s, d), q)


def kb_similar(s, d):
    """Vectors divisible by 100 against all others of the table, as new formulas against a base."""
    v = _vectors(s, d)
    return kb.similar(v.where("id % 100 <> 0"), v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec"), 5, 0.0).select("qid", "id", F.round("score", 4).alias("score"), "rank")


def kb_lookup(s, d):
    return kb.by_id(_kb(s, d), "kb_001").unionByName(kb.by_number(_kb(s, d), "(1.2)")).select("id", "number", "latex")


def kb_prompt(s, d):
    c = {n: F.col(n) for n in ("number", "latex", "description", "context", "variables")}
    return _kb(s, d).select("id", kb.prompt_lines(c).alias("lines"))


def enrich_class(s, d):
    return _kb(s, d).select("id", fx.model_class(F.col("latex"), F.col("description"), F.col("context")).alias("model_class"))


def enrich_phenomena(s, d):
    return _kb(s, d).select("id", F.array_join(fx.phenomena(F.col("latex"), F.col("description"), F.col("context")), ",").alias("phenomena"))


def enrich_aliases(s, d):
    return _kb(s, d).select("id", F.array_join(fx.aliases(F.col("description"), False), "|").alias("ru"), F.array_join(fx.aliases(F.col("description"), True), "|").alias("en"))


def query_terms(s, d):
    return _kb(s, d).select("id", F.array_join(fx.query_terms(F.col("latex"), F.col("description"), F.col("context")), " ").alias("terms"))


def link_formulas(s, d):
    return kb.link(_chunks(s, d, "content", "section", "pages", "citation").where("content IS NOT NULL"), _kb(s, d)).select("chunk_id", "id", "link_score", "reasons", "rank")


# ------------------------------------------------------------ metadata


def authors_clean(s, d):
    c = _chunks(s, d, "citation")
    return c.select("chunk_id", F.array_join(md.authors(F.col("citation.authors")), "; ").alias("authors"))


def year_extract(s, d):
    return _docs(s, d).select("doc_id", md.year(F.col("text")).alias("year_found"))


def title_extract(s, d):
    return _docs(s, d).select("doc_id", md.article_title(F.coalesce("text", F.lit("")), F.col("title"), F.col("source")).alias("title_found"))


def title_smart(s, d):
    return _docs(s, d).select("doc_id", md.title(F.coalesce("text", F.lit("")), F.col("title"), F.col("source")).alias("title_found"))


def all_authors(s, d):
    return _docs(s, d).select("doc_id", F.array_join(md.all_authors(F.col("text")), "; ").alias("authors"))


def article_authors(s, d):
    return _docs(s, d).select("doc_id", F.array_join(md.article_authors(F.col("text")), "; ").alias("authors"))


def citation_normalize(s, d):
    c = _chunks(s, d, "citation", "source")
    return c.select("chunk_id", tx.filled(F.col("citation.paper_id"), F.col("source")).alias("paper"), F.regexp_extract(F.coalesce("citation.year", F.lit("")), r"(\d{4})", 1).try_cast("int").alias("year"), tx.filled(F.col("citation.doi"), F.col("citation.original_doi")).alias("doi"))


# ------------------------------------------------------------ answers


def _evidence(s, d):
    hits = _bm25(s, d, 3 * K).select("qid", "id", "score", F.col("rank").alias("pos"))
    return answer.evidence(hits, 3)


def evidence_dedup_top(s, d):
    """Hits are documents already, so none is read again."""
    return _evidence(s, d).where("id IS NOT NULL").select("qid", F.col("id").alias("doc_id"), "score", "rank")


def _context(s, d):
    src = answer.source_line(F.col("title"), F.array().cast("array<string>"), F.col("year"), F.lit(None), F.lit(None))
    docs = _docs(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "title", "year")
    return answer.context(retrieval.with_documents(_evidence(s, d), docs).withColumn("source", src))


def build_context(s, d):
    return _context(s, d)


def answer_batch(s, d):
    return answer.answers(_questions(s, d), _context(s, d)).select("qid", "answer")


_SKIP = {"ship", "table"}


def queries() -> dict[str, Query]:
    here = globals()
    names = [n for n, f in here.items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in ("queries", "oracle_sql")]

    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        return run

    return {n: shipped(here[n]) for n in names}


def oracle_sql() -> dict[str, str]:
    from folioflow.plans.oracles import ORACLES

    return dict(ORACLES)
