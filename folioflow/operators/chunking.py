"""Packing ordered blocks into citable chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.functions.formulas import bind, chunk_garbage_flag, normalize, text_of, valid
from folioflow.functions.text import filled, strip
from folioflow.operators.blocks import cut_references
from folioflow.operators.ordering import carried_last, cumulative
from folioflow.options import Options
from folioflow.schemas import FORMULA
from folioflow.session import checkpoint

#: A formula of a chunk.
CHUNK_FORMULA = FORMULA.replace("variable_list:array<string>,", "")


def chunk_id(paper: Column, content: Column, section: Column, pages: Column) -> Column:
    """Paper and the first 8 digits of a digest of paper, section, pages and the content's opening."""
    raw = F.concat(filled(paper, F.lit("unknown")), F.lit("|"), F.coalesce(section, F.lit("")), F.lit("|"), F.coalesce(F.array_join(pages, ","), F.lit("")), F.lit("|"), F.substring(F.coalesce(content, F.lit("")), 1, 500))
    return F.concat(paper, F.lit("_"), F.substring(F.md5(raw.cast("binary")), 1, 8))


def pages_of_string(pages: Column) -> Column:
    """A string of pages counts sign by sign in ids."""
    return F.filter(F.split(F.coalesce(pages, F.lit("")), ""), lambda x: x != "")


def context_windows(chunks: DataFrame, partition: str, order: list[str], n: int = 500) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(*order)
    side = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, n)
    return chunks.withColumn("prev", side(F.lag("content").over(w))).withColumn("next", side(F.lead("content").over(w)))


def search_text(content: Column, formulas: Column) -> Column:
    """Content and what its formulas say, line by line."""
    says = F.flatten(
        F.transform(
            formulas,
            lambda f: F.concat(
                F.array(f.description, f.semantic_description, f.latex),
                F.flatten(F.transform(F.array_sort(F.map_keys(F.coalesce(f.variables, F.create_map().cast("map<string,string>")))), lambda k: F.array(k, F.try_element_at(f.variables, k)))),
            ),
        )
    )
    return F.array_join(F.filter(F.concat(F.array(content), F.coalesce(says, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")), "\n")


def page_list(pages: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(pages, lambda p: p.cast("string").try_cast("int"))))


def unique_formulas(formulas: Column) -> Column:
    """The first formula of each key (id, latex, description, raw) stays; keyless ones go."""
    key = lambda f: F.lower(F.regexp_replace(filled(f.id, f.latex, f.description, f.raw), r"\s+", ""))
    keys = F.transform(formulas, key)
    return F.filter(F.transform(formulas, lambda f, i: F.when((F.array_position(keys, key(f)) == i + 1), f)), lambda f: f.isNotNull())


def merged_formulas(existing: Column, linked: Column) -> Column:
    return unique_formulas(F.concat(existing, linked))


def _latex(c: Column) -> Column:
    """LaTeX as chunks show it: garbage is null, only what is valid is normalised."""
    return bind(strip(text_of(c)), lambda x: F.when(chunk_garbage_flag(x), F.lit(None)).when(valid(x), F.nullif(normalize(x), F.lit(""))).otherwise(x))


def _formula(latex: Column, of: dict[str, Column]) -> Column:
    """A formula of a chunk; what ``of`` lacks is null, and there is none without LaTeX."""
    said, meant = of.get("description", F.lit(None)), of.get("semantic_description", F.lit(None))
    full = of | {"latex": latex, "description": F.coalesce(filled(said, meant), F.lit("")), "semantic_description": F.coalesce(filled(meant, said), F.lit(""))}
    full |= {"variables": F.coalesce(of.get("variables", F.lit(None)), F.create_map().cast("map<string,string>")), "confidence": F.coalesce(of.get("confidence", F.lit(None)), F.lit(0.5)), "type": F.coalesce(of.get("type", F.lit(None)), F.lit("formula_candidate"))}
    names = [x.split(":")[0] for x in CHUNK_FORMULA[len("struct<") : -1].replace("map<string,string>", "map").split(",")]
    return F.when(latex.isNotNull(), F.struct(*[full.get(n, F.lit(None)).alias(n) for n in names]).cast(CHUNK_FORMULA))


def normalized_formulas(formulas: Column, latex: Column, page: Column, source: Column, description: Column, semantic: Column) -> Column:
    """The formulas of a block; the other columns fill what a formula lacks."""

    def one(f: Column) -> Column:
        return bind(_latex(filled(f.latex, latex)), lambda x: _formula(x, {
            "id": f.id, "number": f.number, "raw": filled(f.raw, latex, x), "description": filled(f.description, f.semantic_description, description, semantic), "semantic_description": filled(f.semantic_description, f.description, semantic, description), "variables": f.variables,
            "context": f.context, "source": filled(f.source, source), "page": F.coalesce(F.nullif(f.page, F.lit(0)), page), "confidence": f.confidence, "type": f.type, "extraction_method": f.extraction_method, "link_score": f.link_score,
        }))

    return F.array_compact(F.transform(F.coalesce(formulas, F.array().cast(f"array<{FORMULA}>")), one))


def rendered(blocks: DataFrame) -> DataFrame:
    """Blocks as chunks hold them: ``content`` and ``formulas`` of paragraphs, equations and formulas, and section headings; other types go.

    Columns that a table of blocks lacks count as null.
    """
    has = lambda n, t="string": (F.col(n) if n in blocks.columns else F.lit(None)).cast(t)
    text = lambda n: F.nullif(strip(text_of(has(n))), F.lit(""))
    equation, bare = F.col("type") == "equation_block", F.col("type").isin("formula", "formula_candidate")
    kept = blocks.where(equation | bare | F.col("type").isin("paragraph", "section"))
    raw = F.when(equation, filled(text("latex"), text("normalized"))).when(bare, filled(text("latex"), text("normalized"), text("content")))
    rows = kept.withColumns({"_raw": raw, "_latex": F.when(equation, _latex(raw)).when(bare & valid(raw), _latex(raw))})
    context, said, meant, label = text("context_before"), text("description"), text("semantic_description"), text("label")
    number = filled(has("number"), label)
    own = {
        "id": filled(has("id"), has("formula_id")), "number": number, "raw": filled(has("raw"), F.when(equation, F.col("_raw")).otherwise(F.col("_latex"))), "description": filled(said, meant, F.when(equation, context)), "semantic_description": filled(meant, said, F.when(equation, context)),
        "variables": has("variables", "map<string,string>"), "context": filled(F.when(bare, has("context")), context), "source": has("source"), "page": has("page", "int"), "confidence": has("confidence", "double"), "type": F.col("type"), "extraction_method": has("extraction_method"), "link_score": F.when(bare, has("link_score", "double")),
    }
    own = F.array_compact(F.array(_formula(F.col("_latex"), own)))
    inner = normalized_formulas(has("formulas", f"array<{FORMULA}>"), F.col("_latex"), has("page", "int"), has("source"), F.when(equation, said), F.when(equation, filled(meant, context)))
    rows = rows.withColumn("formulas", F.when(bare, own).when(F.col("type") == "section", F.array().cast(f"array<{CHUNK_FORMULA}>")).otherwise(inner))
    rows = rows.withColumn("formulas", F.when(equation & (F.size("formulas") == 0), own).otherwise(F.col("formulas")))
    line = lambda n: F.concat(F.lit("Формула: "), F.col("_latex"), F.coalesce(F.concat(F.lit(" "), n), F.lit("")))
    shown = F.when(equation, F.concat_ws("\n", context, line(label), said, F.when(~meant.eqNullSafe(said), F.concat(F.lit("Смысл формулы: "), meant))))
    shown = shown.when(bare & F.col("_latex").isNotNull(), F.concat_ws("\n", line(number), filled(said, meant))).when(bare, F.lit(""))
    return rows.withColumn("content", shown.otherwise(text_of(F.col("content")))).drop("_raw", "_latex")


def split_sentences(text: str, limit: int, overlap: int) -> list[str]:
    """Pieces of whole sentences up to ``limit``; each begins with the end of the one before."""
    out, now = [], ""
    for x in re.split(r"(?<=[.!?])\s+", text):
        if now and len(now) + len(x) > limit:
            out.append(now)
            now = f"{now[max(0, len(now) - overlap) :]} {x}"
        else:
            now = f"{now} {x}".strip()
    return [*out, now] if now else out


def pack(blocks: DataFrame, options: Options | None = None) -> DataFrame:
    """(paper_id, part, section, n, chunk_id, content, pages, formulas) greedily packed up to the limit inside each section.

    ``part`` numbers the sections of a document and ``n`` the chunks of a part.
    Headings begin a part and are its name, not its text.  Pieces under the
    least size stay only if they carry formulas; the pieces of a text over the
    limit carry all its formulas.

    A section is the unit of work, so a document of any length is spread over
    tasks; the fold streams over the sorted rows and holds the open chunk only.
    """
    o = options or Options()
    names = ["paper_id", "part", "section", "n", "content", "pages", "formulas"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = section = None
        parts: list[str] = []
        pages: list[int] = []
        formulas: dict[str, None] = {}
        size = n = 0

        def flush() -> list[tuple]:
            nonlocal parts, pages, formulas, size, n
            text = "\n\n".join(parts)
            made = []
            for piece in [text] if len(text) <= o.max_chunk else split_sentences(text, o.max_chunk, o.overlap):
                piece = piece.strip()
                if len(piece) >= o.min_chunk or formulas:
                    made.append((*at, section, n, piece, list(dict.fromkeys(pages)), f"[{','.join(formulas)}]"))
                    n += 1
            parts, pages, formulas, size = [], [], {}, 0
            return made

        rows: list[tuple] = []
        for b in batches:
            for p, k, s, t, g, f in zip(b["paper_id"], b["part"], b["section"], b["content"], b["page"], b["formulas"]):
                t = t.strip()
                if (p, k) != at:
                    rows += flush() if parts or formulas else []
                    at, section, n = (p, k), s, 0
                elif parts and size + len(t) > o.max_chunk:
                    rows += flush()
                if t:
                    size += len(t) + (2 if parts else 0)
                    parts.append(t)
                formulas |= dict.fromkeys(f)
                if g == g and g is not None:
                    pages.append(int(g))
            yield pd.DataFrame(rows, columns=names)
            rows = []
        if parts or formulas:
            yield pd.DataFrame(flush(), columns=names)

    rows = blocks.where("paper_id IS NOT NULL")
    rows = rows if o.include_references else cut_references(rows)
    heading = F.col("type") == "section"
    rows = cumulative(rows, "part", heading.cast("int")).withColumn("part", F.col("part").cast("int"))
    # a heading stands first in its part and names it
    rows = carried_last(rows, "section", F.when(heading, F.substring(text_of(F.col("content")), 1, 180)))
    # written, so that the order is found once and the formulas are normalised in a plan of their own
    rows = rendered(checkpoint(rows.where(~heading))).where("content <> '' OR size(formulas) > 0")
    rows = rows.select("paper_id", "part", "section", "content", "page", F.transform("formulas", lambda f: F.to_json(f)).alias("formulas"), "pos", "block_id")
    ordered = rows.repartition("paper_id", "part").sortWithinPartitions("paper_id", "part", "pos", "block_id").select("paper_id", "part", "section", "content", "page", "formulas")
    made = ordered.mapInPandas(run, "paper_id string, part int, section string, n int, content string, pages array<int>, formulas string")
    made = made.withColumn("formulas", unique_formulas(F.from_json("formulas", f"array<{CHUNK_FORMULA}>")))
    return made.withColumn("chunk_id", chunk_id(F.col("paper_id"), F.col("content"), F.col("section"), F.col("pages")))
