"""Operators on the ordered blocks of a document: (paper_id, pos, block_id) gives the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.formulas import fragment_flag, garbage_flag
from folioflow.functions.text import WS, clean_latex, clean_text, filled, reference_heading, strip, title_flag
from folioflow.operators.ordering import beside, carried_last, cumulative, indexed, nearby
from folioflow.schemas import FORMULA_TYPES
from folioflow.session import checkpoint

#: Types that an equation is made of.
EQUATION_PARTS = ("formula", "formula_candidate", "formula_fragment")
#: The four ways in which a paragraph begins with a title.
TITLES = (
    r"Глава\s+\d+\.?\s+[А-ЯЁA-Z][^.!?]{10,120}",
    r"\d+\.\d+\.\d+\s+[А-ЯЁA-Z][^.!?]{10,120}",
    r"\d+\.\d+\s+[А-ЯЁA-Z][^.!?]{10,120}",
    r"\d+\.\s+[А-ЯЁA-Z][^.!?]{10,120}",
)


def is_formula(kind: Column) -> Column:
    return kind.isin(*FORMULA_TYPES)


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _formulas(blocks: DataFrame) -> Column:
    """Whether a block carries formulas; tables without the column carry none."""
    return F.coalesce(F.size("formulas") > 0, F.lit(False)) if "formulas" in blocks.columns else F.lit(False)


def _own_section() -> Column:
    return F.nullif(F.col("section"), F.lit(""))


def cleaned(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("content", clean_text(F.col("content"))).withColumn("latex", clean_latex(F.col("latex")))


def drop_empty(blocks: DataFrame) -> DataFrame:
    """Blocks with neither content nor latex nor formulas go."""
    return blocks.where((_text("content") != "") | (_text("latex") != "") | _formulas(blocks))


def drop_empty_by_type(blocks: DataFrame) -> DataFrame:
    """The rule of normalisation: equations need anything, paragraphs content or formulas, sections content; other types stay."""
    kind, content = F.col("type"), _text("content") != ""
    equation = kind.isin("equation_block", "formula", "formula_candidate")
    need = F.when(equation, content | (_text("latex") != "") | _formulas(blocks)).when(kind == "paragraph", content | _formulas(blocks)).when(kind == "section", content)
    return blocks.where(F.coalesce(need, F.lit(True)))


def drop_repeated(blocks: DataFrame) -> DataFrame:
    """Blocks equal to the one before them (type, opening of content and latex, page) go."""
    sig = F.struct("type", F.substring(_text("content"), 1, 200).alias("c"), F.substring(_text("latex"), 1, 200).alias("l"), "page")
    near = beside(indexed(blocks).withColumn("_s", sig), {"_p": F.lag("_s").over(nearby())})
    return near.where(~F.col("_s").eqNullSafe(F.col("_p"))).drop("_s", "_p", "rn")


def split_sections(blocks: DataFrame) -> DataFrame:
    """A paragraph that begins with a title becomes a section and a paragraph, both of that section; ``sub`` keeps the order."""
    text = F.coalesce("content", F.lit(""))
    title = rest = F.lit(None).cast("string")
    for form in reversed(TITLES):
        pattern = f"(?s)^({form}){WS}+(.+)$".replace(r"\s", WS)
        one, two = strip(F.regexp_extract(text, pattern, 1)), strip(F.regexp_extract(text, pattern, 2))
        hit = (F.col("type") == "paragraph") & (two != "") & (F.length(one) < 160)
        title, rest = F.when(hit, one).otherwise(title), F.when(hit, two).otherwise(rest)
    names = blocks.columns
    rows = blocks.withColumn("_t", title).withColumn("_r", rest)
    part = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.col("_t").alias("section"))
    same = F.struct(F.col("type"), F.col("content"), (F.col("section") if "section" in names else F.lit(None).cast("string")).alias("section"))
    parts = F.when(F.col("_t").isNotNull(), F.array(part("section", F.col("_t")), part("paragraph", F.col("_r")))).otherwise(F.array(same))
    return rows.select(*[c for c in names if c not in ("type", "content", "section")], F.posexplode(parts).alias("sub", "_x")).select("*", "_x.type", "_x.content", "_x.section").drop("_x")


def detect_sections(blocks: DataFrame) -> DataFrame:
    """Blocks are told apart as sections and paragraphs; those without a section take the one before.  Empty ones that are no formulas go."""
    blocks = blocks.where(is_formula(F.col("type")) | (_text("content") != ""))
    title = title_flag(F.col("content")) & ~is_formula(F.col("type"))
    kind = F.when(is_formula(F.col("type")), F.col("type")).when(title, F.lit("section")).otherwise(F.lit("paragraph"))
    name = F.substring(_text("content"), 1, 180)
    rows = carried_last(blocks.withColumn("type", kind), "_before", F.when(F.col("type") == "section", name))
    return rows.withColumn("section", F.when(F.col("type") == "section", name).otherwise(F.coalesce(_own_section(), "_before"))).drop("_before")


def forward_fill(blocks: DataFrame) -> DataFrame:
    """A section's content is its name; the section before fills where none is given."""
    named = F.when(F.col("type") == "section", F.coalesce(F.nullif(F.col("content"), F.lit("")), _own_section(), F.lit("")))
    rows = carried_last(blocks, "_before", named)
    return rows.withColumn("section", F.when(F.col("type") == "section", F.nullif(F.col("_before"), F.lit(""))).otherwise(F.coalesce(_own_section(), F.nullif(F.col("_before"), F.lit(""))))).drop("_before")


def _first(blocks: DataFrame, hit: Column) -> DataFrame:
    """Blocks with ``_at``, the place (pos, block_id) of the first hit in their document; a document is one row before the join."""
    at = F.min(F.when(hit, F.struct("pos", "block_id"))).alias("_at")
    return blocks.join(blocks.groupBy(F.col("paper_id").alias("_paper")).agg(at).where("_at IS NOT NULL"), F.col("paper_id").eqNullSafe(F.col("_paper")), "left").drop("_paper")


def front_matter(blocks: DataFrame) -> DataFrame:
    """``front``: whether a block stands before the introduction; those without a section get the name of it."""
    rows = _first(blocks, F.lower(_text("content")).rlike("^(введение|introduction)"))
    rows = rows.withColumn("front", F.coalesce(F.struct("pos", "block_id") < F.col("_at"), F.lit(False))).drop("_at")
    return rows.withColumn("section", F.when(F.col("front"), F.coalesce(_own_section(), F.lit("front_matter"))).otherwise(F.col("section"))) if "section" in rows.columns else rows


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Runs of broken paragraphs become one: content, pages, the first section given and ``n`` blocks.

    Fragments of formulas are retyped and end a run, as formulas and sections
    do; blocks of any other type go and do not end it.
    """
    text = F.col("_t")
    fragment = (F.col("type") == "paragraph") & (text != "") & fragment_flag(text)
    kind = F.when(fragment, F.lit("formula_fragment")).otherwise(F.col("type"))
    rows = drop_empty(blocks).withColumn("_t", _text("content")).withColumn("type", kind)
    rows = indexed(rows.where((F.col("type") == "paragraph") | (F.col("type") == "section") | is_formula(F.col("type"))))
    before, before_type = F.lag("_t").over(nearby()), F.lag("type").over(nearby())
    n_words = F.size(F.filter(F.split(text, f"{WS}+"), lambda x: x != ""))
    first = F.substring(text, 1, 1)
    goes_on = ((F.lower(first) == first) & (F.upper(first) != first)) | before.rlike("(,|;|:|и|или)$") | (~before.rlike("[.!?:;]$") & (n_words > 3))
    joins = (F.col("type") == "paragraph") & (before_type == "paragraph") & goes_on & (text != "") & (before != "")
    rows = cumulative(beside(rows, {"_breaks": F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)}), "_run", F.col("_breaks"), order=("rn",))
    part = F.struct("rn", F.col("_t").alias("t"), "page", _own_section().alias("s"))
    out = rows.groupBy("paper_id", "_run").agg(F.min("pos").alias("pos"), F.min("block_id").alias("block_id"), F.min_by("type", "rn").alias("type"), F.min_by("latex", "rn").alias("latex"), F.sort_array(F.collect_list(part)).alias("_p"))
    pages = F.array_distinct(F.array_compact(F.transform("_p", lambda x: x.page)))
    section = F.try_element_at(F.array_compact(F.transform("_p", lambda x: x.s)), F.lit(1))
    return out.select("paper_id", "pos", "block_id", "type", F.array_join(F.transform("_p", lambda x: x.t), " ").alias("content"), "latex", F.col("_p")[0].page.alias("page"), pages.alias("pages"), section.alias("section"), F.size("_p").cast("bigint").alias("n"))


def merge_equations(blocks: DataFrame) -> DataFrame:
    """Formulas become equations that take in the paragraph before them and, where a label follows, the label and the paragraph after.

    What is taken in is no block any more.  A paragraph that explains one
    equation introduces none: along a chain of paragraph, formula, label,
    paragraph, formula, label ... every other paragraph explains.
    """
    rows = indexed(blocks)
    w = nearby()
    part = lambda c: F.coalesce(c.isin(*EQUATION_PARTS), F.lit(False))
    text = F.coalesce("content", F.lit(""))
    t = lambda k: F.lag("type", k).over(w) if k > 0 else F.lead("type", -k).over(w)
    paragraph = F.col("type") == "paragraph"
    rows = beside(rows, {"_linked": F.coalesce(paragraph & (t(1) == "formula_label") & part(t(2)) & (t(3) == "paragraph"), F.lit(False)), "_third": F.pmod(F.col("rn"), F.lit(3))}, 3)
    rows = carried_last(rows, "_start", F.when(~F.col("_linked"), F.col("rn")), ("paper_id", "_third"), ("rn",))
    rows = rows.withColumn("_explains", F.col("_linked") & (F.pmod((F.col("rn") - F.col("_start")) / 3, F.lit(2)) == 1)).withColumn("_p", paragraph & ~F.col("_explains"))
    lag = lambda c, k: F.lag(c, k).over(w)
    led = part(F.col("type")) & F.coalesce(lag("_p", 1), F.lit(False))
    near = beside(rows, {
        "_led": led, "_leads": F.col("_p") & part(F.lead("type").over(w)), "_labels": F.coalesce((F.col("type") == "formula_label") & part(t(1)) & lag("_p", 2), F.lit(False)),
        "_before": F.when(led, lag(text, 1)).otherwise(F.lit("")), "_next": F.when(led & (t(-1) == "formula_label"), F.lead(text).over(w)),
        "_after": F.when(F.coalesce(led & (t(-1) == "formula_label") & (t(-2) == "paragraph"), F.lit(False)), F.lead(text, 2).over(w)).otherwise(F.lit("")),
        "_beside_section": F.when(led, lag(F.col("section"), 1)), "_beside_page": F.when(led, lag(F.col("page"), 1)),
    }, 3)
    made = part(F.col("type"))
    kept = near.where(~F.col("_leads") & ~F.col("_explains") & ~F.col("_labels"))
    out = kept.withColumns({
        "latex": F.when(made, filled(F.col("latex"), text)).otherwise(F.col("latex")), "label": F.when(made, F.coalesce("_next", "label")).otherwise(F.col("label")), "context_before": F.when(made, F.col("_before")),
        "description": F.when(made, F.col("_after")), "semantic_description": F.when(made, F.substring("_before", 1, 300)), "section": F.when(made, F.coalesce(_own_section(), "_beside_section")).otherwise(F.col("section")),
        "page": F.when(made, F.coalesce("page", "_beside_page")).otherwise(F.col("page")), "from_candidate": F.when(made, F.col("type") == "formula_candidate"), "type": F.when(made, F.lit("equation_block")).otherwise(F.col("type")),
    })
    return out.drop("rn", *[c for c in out.columns if c.startswith("_")])


def cut_references(blocks: DataFrame) -> DataFrame:
    """Blocks from the bibliography's heading on go."""
    rows = _first(blocks, (F.col("type") == "section") & reference_heading(F.col("content")))
    return rows.where(F.col("_at").isNull() | (F.struct("pos", "block_id") < F.col("_at"))).drop("_at")


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """The cleaning chain: texts, garbage, embedded titles, repetitions, sections, front matter, broken paragraphs.

    Each step along the order reads its rows twice, so they are written in between.
    """
    rows = cleaned(blocks)
    rows = drop_empty(rows.where((F.col("type") != "formula") | ~garbage_flag(filled(F.col("latex"), F.col("content")))))
    rows = checkpoint(split_sections(rows).withColumn("pos", F.col("pos") * 2 + F.col("sub")).drop("sub"))
    rows = checkpoint(detect_sections(checkpoint(drop_repeated(rows))))
    return drop_repeated(checkpoint(merge_paragraphs(checkpoint(front_matter(rows)))))


def normalize_blocks(blocks: DataFrame) -> DataFrame:
    """The normalising chain: equations, empty blocks, sections."""
    return forward_fill(checkpoint(drop_empty_by_type(merge_equations(blocks))))


def merge_layout(blocks: DataFrame, gap: float = 15.0, shift: float = 120.0) -> DataFrame:
    """Layout blocks (paper_id, page, pos, text, x0, y0, x1, y1) near below each other become one; a page is one fold."""
    item = F.struct("pos", "text", "x0", "y0", "x1", "y1")
    seq = blocks.groupBy("paper_id", "page").agg(F.sort_array(F.collect_list(item)).alias("s"))
    start = F.array().cast("array<struct<pos:int,text:string,x0:double,y0:double,x1:double,y1:double>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = (F.size(acc) > 0) & (x.y0 - last.y1 < gap) & (F.abs(x.x0 - last.x0) < shift)
        merged = F.struct(last.pos.alias("pos"), F.concat(last.text, F.lit(" "), x.text).alias("text"), F.least(last.x0, x.x0).alias("x0"), F.least(last.y0, x.y0).alias("y0"), F.greatest(last.x1, x.x1).alias("x1"), F.greatest(last.y1, x.y1).alias("y1"))
        own = F.struct(x.pos.cast("int").alias("pos"), x.text.alias("text"), x.x0.cast("double").alias("x0"), x.y0.cast("double").alias("y0"), x.x1.cast("double").alias("x1"), x.y1.cast("double").alias("y1"))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(own)))

    return seq.select("paper_id", "page", F.explode(F.aggregate("s", start, step)).alias("b")).select("paper_id", "page", "b.*")
