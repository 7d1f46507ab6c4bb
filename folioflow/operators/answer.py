"""Evidence, context, prompt and answer of each question of a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.text import filled

SEPARATOR = "\n\n---\n\n"
NOTHING = "В базе не найдено подходящих фрагментов."
SYSTEM_PROMPT = "Отвечай только по приведённому контексту и указывай источники; если ответа в нём нет, скажи об этом."


def evidence(hits: DataFrame, limit: int = 5) -> DataFrame:
    """First occurrence of each chunk (by pos), then the best by score."""
    first = hits.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "id").orderBy("pos"))).where("_r = 1").drop("_r")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "pos", "id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def source_line(title: Column, authors: Column, year: Column, page: Column, section: Column) -> Column:
    """Labelled source of a fragment; authors as a bracketed list."""
    names = F.when(F.size(authors) > 0, F.concat(F.lit("['"), F.array_join(authors, "', '"), F.lit("']")))
    label = lambda t, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(t), c.cast("string")))
    return F.concat_ws("\n", label("Источник: ", title), label("Авторы: ", names), label("Год: ", year), label("Страница: ", page), label("Раздел: ", section))


def text_of(*columns: Column) -> Column:
    return filled(*columns)


def context(ranked: DataFrame, top: int = 3) -> DataFrame:
    """(qid, context): numbered fragments with their sources, best first."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    rows = ranked.where(F.col("rank") <= top).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("p")))).alias("s"))
    return rows.select("qid", F.array_join(F.transform("s", lambda x: x.p), SEPARATOR).alias("context"))


def prompt(question: Column, ctx: Column) -> Column:
    return F.concat(F.lit("Контекст:\n"), ctx, F.lit("\n\nВопрос: "), question, F.lit("\n\nОтвет:"))


def extractive(prompt_text: Column) -> Column:
    """Offline stand-in for a language model: the first sentence of the first fragment."""
    body = F.regexp_extract(prompt_text, r"(?s)\[1\][^\n]*\n(?:(?:Источник|Авторы|Год|Страница|Раздел): [^\n]*\n)*([^\n]*?[.!?])(?:\s|$)", 1)
    return F.when(body != "", body).otherwise(F.lit(NOTHING))


def answers(questions: DataFrame, contexts: DataFrame, generator: Callable[[Column], Column] = extractive) -> DataFrame:
    """(qid, prompt, answer); questions without hits get the fixed message."""
    j = questions.join(contexts, "qid", "left").withColumn("prompt", F.when(F.col("context").isNotNull(), prompt(F.col("query"), F.col("context"))))
    return j.select("qid", "prompt", F.when(F.col("prompt").isNull(), F.lit(NOTHING)).otherwise(generator(F.col("prompt"))).alias("answer"))


def pick_tool(named: Column, tools: list[str]) -> Column:
    """A tool's name as a model gave it; anything else completes."""
    x = F.lower(F.trim(named))
    return F.when(x.isin(*tools), x).otherwise(F.lit("complete"))


class Agent:
    """Linear tool chain over a batch of questions: search, gather, generate, complete."""

    TOOLS = ("search", "gather", "generate", "complete")

    def __init__(self, search: Callable[[DataFrame], DataFrame], generator: Callable[[Column], Column] = extractive, top: int = 5):
        self.search, self.generator, self.top = search, generator, top

    def run(self, questions: DataFrame) -> DataFrame:
        return answers(questions, context(self.search(questions), self.top), self.generator)
