"""The formula knowledge base: building, searching, enriching and linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions import formulas as fx
from folioflow.functions.text import WS, link_text, link_tokens, page_of_context


def upsert(formulas: DataFrame) -> DataFrame:
    """One entry for each normal form of (latex, source, page, score, pos): first spelling, all variants, best score.

    Ids are digests of the normal form, so the table is the same on every run.
    """
    keyed = formulas.where("latex IS NOT NULL AND latex <> ''").withColumn("norm", fx.formula_key(F.col("latex")))
    seen = F.sort_array(F.collect_set(F.struct("pos", "latex", "source", "page")))
    g = keyed.groupBy("norm").agg(F.max("score").alias("score"), seen.alias("s"), F.count("*").alias("n"))
    first = lambda name: F.array_distinct(F.array_compact(F.transform("s", lambda x: x[name])))
    return g.select(F.md5(F.col("norm").cast("binary")).alias("id"), F.col("s")[0].latex.alias("canonical"), first("latex").alias("variants"), first("source").alias("sources"), first("page").alias("pages"), "score", "n")


def text_score(query: Column, kb: dict[str, Column], strict: bool = False) -> Column:
    """Number 10, a word of the description 5, a word of the context 3, each variable named or explained 2, latex 4.

    A question without Latin letters and digits leaves an empty pattern that any latex
    contains; ``strict`` keeps that from counting.
    """
    q = F.lower(query)
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), f"{WS}+"), lambda w: w != "")
    hit = lambda c: F.exists(words(c), lambda w: F.contains(q, w))
    latex = (F.coalesce(kb["latex"], F.lit("")) != "") & F.contains(bare(kb["latex"]), bare(query))
    if strict:
        latex = latex & (bare(query) != "")
    number = (F.coalesce(kb["number"], F.lit("")) != "") & F.contains(q, F.lower(kb["number"]))
    entries = F.map_entries(F.coalesce(kb["variables"], F.create_map().cast("map<string,string>")))
    named = F.size(F.filter(entries, lambda e: F.contains(q, F.lower(e.key)) | F.contains(q, F.lower(F.coalesce(e.value, F.lit(""))))))
    parts = [F.when(number, 10).otherwise(0), F.when(hit(kb["description"]), 5).otherwise(0), F.when(hit(kb["context"]), 3).otherwise(0), named * 2, F.when(latex, 4).otherwise(0)]
    return reduce(lambda a, b: a + b, parts)


def search(kb: DataFrame, questions: DataFrame, k: int = 5, strict: bool = False) -> DataFrame:
    """(qid, id, score, rank) of the curated formulas; the knowledge base is curated by hand and broadcast below a size."""
    cols = {c: F.col(c) for c in ("number", "latex", "description", "context", "variables")}
    scored = questions.crossJoin(small(kb)).select("qid", "id", text_score(F.col("query"), cols, strict).cast("bigint").alias("score")).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A curated knowledge base up to so many rows is broadcast.
MAX_KB_ROWS = 20_000


def small(kb: DataFrame) -> DataFrame:
    return F.broadcast(kb) if kb.limit(MAX_KB_ROWS + 1).count() <= MAX_KB_ROWS else kb


def similar(kb: DataFrame, questions: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(qid, id, score, rank): formulas (id, vec) most alike to ``questions (qid, vec)`` by cosine, at least ``least``."""
    from folioflow.operators.retrieval import dense

    def unit(df: DataFrame, key: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return df.where("vec IS NOT NULL").select(key, F.transform("vec", lambda x: F.when(norm > 0, (x / norm).cast("float")).otherwise(F.lit(0.0).cast("float"))).alias("vec"))

    return dense(unit(kb, "id"), unit(questions, "qid"), k).where(F.col("score") >= least)


def merge_similar(kb: DataFrame, new: DataFrame, threshold: float) -> DataFrame:
    """(qid, id): for each new formula the entry that it is merged into, by cosine of at least ``threshold``, or null where it is an entry of its own."""
    return new.select("qid").join(similar(kb, new, 1, threshold).select("qid", "id"), "qid", "left")


def by_id(kb: DataFrame, value: str) -> DataFrame:
    return kb.where(F.col("id") == value).orderBy("id").limit(1)


def by_number(kb: DataFrame, value: str) -> DataFrame:
    return kb.where(F.col("number") == value).orderBy("id").limit(1)


def prompt_lines(c: dict[str, Column]) -> Column:
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys(c["variables"])), lambda k: F.concat(k, F.lit(" — "), F.try_element_at(c["variables"], k))), "; ")
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    return F.concat_ws("\n", line("Номер: ", c["number"]), line("LaTeX: ", c["latex"]), line("Описание: ", c["description"]), line("Переменные: ", pairs), line("Контекст: ", c["context"]))


def enrich(kb: DataFrame) -> DataFrame:
    """Fields that are empty get computed values; what is there stays."""
    l, d, c = F.col("latex"), F.col("description"), F.col("context")
    computed = {"model_class": fx.model_class(l, d, c), "phenomena": fx.phenomena(l, d, c), "aliases_ru": fx.aliases(d, False), "aliases_en": fx.aliases(d, True), "query_terms": fx.query_terms(l, d, c)}
    out = kb
    for name, value in computed.items():
        if name in kb.columns:
            empty = F.col(name).isNull() | ((F.col(name) == "") if name == "model_class" else (F.size(name) == 0))
            value = F.when(empty, value).otherwise(F.col(name))
        out = out.withColumn(name, value)
    return out


def link(chunks: DataFrame, kb: DataFrame, least: float = 4.0, top: int = 5) -> DataFrame:
    """(chunk_id, id, link_score, reasons, rank): formulas that fit a chunk, by six additive signals.

    ``chunks``: chunk_id, content, section, pages and, where there are, citation
    and search_text.  Words and pages of both sides meet by equi-joins and each
    signal is summed per pair before the shuffle; only the formulas' numbers,
    which are looked for inside the text, are set against each chunk.
    """
    some = lambda df, n, t="string": (F.col(n) if n in df.columns else F.lit(None)).cast(t)
    cited = F.to_json("citation", {"ignoreNullFields": "false"}) if "citation" in chunks.columns else F.lit(None)
    text = F.concat_ws(" ", "content", "section", cited, some(chunks, "search_text"))
    c = chunks.select("chunk_id", link_text(text).alias("text"), F.array_distinct(link_tokens(text)).alias("all"), F.array_distinct(link_tokens(F.col("section"))).alias("sec"), F.array_distinct(F.coalesce("pages", F.array().cast("array<int>"))).alias("pages"))
    words = F.concat_ws(" ", "id", "number", "latex", "description", some(kb, "semantic_description"), "context", some(kb, "section"), F.concat_ws(" ", F.map_keys("variables")), F.concat_ws(" ", F.map_values("variables")))
    page = F.coalesce(F.nullif("page", F.lit(0)), page_of_context(F.col("context")))
    k = kb.select("id", F.lower("number").alias("number"), page.alias("page"), *[F.array_distinct(link_tokens(x)).alias(n) for n, x in (("key", words), ("des", F.col("description")), ("lat", F.col("latex")), ("con", F.col("context")))])
    signals = ("common", "sec", "des", "lat", "numbered", "same", "near")
    row = lambda **x: [x.get(n, F.lit(0)).cast("int").alias(n) for n in signals]
    has = lambda n: F.array_contains(n, F.col("w")).cast("int")
    of = k.select("id", F.explode(F.array_distinct(F.concat("key", "des", "lat"))).alias("w"), "key", "des", "lat").select("id", "w", *row(common=has("key"), des=has("des"), lat=has("lat")))
    by_word = c.select("chunk_id", F.explode("all").alias("w")).join(small(of), "w").select("chunk_id", "id", *signals)
    by_section = c.select("chunk_id", F.explode("sec").alias("w")).join(small(k.select("id", F.explode("con").alias("w"))), "w").select("chunk_id", "id", *row(sec=F.lit(1)))
    pages = k.where("page IS NOT NULL AND page <> 0").select("id", F.explode(F.array(*[F.struct((F.col("page") + i).alias("p"), F.lit(i).alias("off")) for i in (-1, 0, 1)])).alias("x")).select("id", "x.p", "x.off")
    by_page = c.select("chunk_id", F.explode("pages").alias("p")).join(small(pages), "p").select("chunk_id", "id", *row(same=F.col("off") == 0, near=F.lit(1)))
    numbers = k.where("number <> ''").select("id", "number")
    by_number = c.select("chunk_id", "text").join(small(numbers), F.contains("text", "number")).select("chunk_id", "id", *row(numbered=F.lit(1)))
    pairs = reduce(DataFrame.unionByName, (by_word, by_section, by_page, by_number)).groupBy("chunk_id", "id").agg(*[(F.max(n) if n in ("numbered", "same", "near") else F.sum(n)).alias(n) for n in signals])
    common, sec, des, lat = (F.col(n) for n in signals[:4])
    numbered, same, near = (F.col(n) > 0 for n in signals[4:])
    parts = [F.least(common * 0.8, F.lit(8.0)), F.when(numbered, 5.0).otherwise(0.0), F.when(same, 6.0).when(near, 2.5).otherwise(0.0), F.least(sec * 1.0, F.lit(4.0)), F.least(des * 0.7, F.lit(5.0)), F.least(lat * 0.6, F.lit(3.0))]
    why = F.concat_ws(
        ",", F.when(common > 0, F.concat(F.lit("keyword_overlap:"), common)), F.when(numbered, F.lit("formula_number")), F.when(same, F.lit("same_page")).when(near, F.lit("near_page")),
        F.when(sec > 0, F.concat(F.lit("section_overlap:"), sec)), F.when(des > 0, F.concat(F.lit("description_overlap:"), des)), F.when(lat > 0, F.concat(F.lit("latex_overlap:"), lat)),
    )
    scored = pairs.select("chunk_id", "id", F.round(reduce(lambda a, b: a + b, parts), 3).alias("link_score"), why.alias("reasons")).where(F.col("link_score") >= least)
    w = Window.partitionBy("chunk_id").orderBy(F.desc("link_score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
