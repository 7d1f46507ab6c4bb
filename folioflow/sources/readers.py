"""Sources: prepared chunk JSON, curated formulas, TEI XML, binary files; and the tables' sinks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import filled, strip
from folioflow.operators.chunking import chunk_id, context_windows, pages_of_string
from folioflow.options import Options
from folioflow.schemas import CHUNK_JSON, KB


def chunk_files(spark: SparkSession, directory: str) -> DataFrame:
    """(file, pos, chunk..., error) of ``*_chunks.json``: a list, or an object with ``chunks`` or ``data``.

    A malformed file gives one row with ``error`` and no chunk; the others load.
    """
    raw = spark.read.option("pathGlobFilter", "*_chunks.json").text(directory, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    item = CHUNK_JSON
    opts = {"mode": "PERMISSIVE"}
    # the first sign tells the shape; an object parsed as an array would give one null element
    as_list = F.from_json("value", f"array<{item}>", opts)
    as_object = F.from_json("value", f"struct<chunks:array<{item}>,data:array<{item}>>", opts)
    parsed = F.when(F.col("value").rlike(r"^\s*\["), as_list).otherwise(F.coalesce(as_object["chunks"], as_object["data"]))
    sound = F.try_parse_json("value").isNotNull()
    rows = raw.select("file", F.when(sound, parsed).alias("c"))
    good = rows.where("c IS NOT NULL").select("file", F.posexplode("c").alias("pos", "chunk"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("c IS NULL").select("file", F.lit(None).cast("int").alias("pos"), F.lit(None).cast(item).alias("chunk"), F.lit("malformed").alias("error"))
    return good.unionByName(bad)


def ready_chunks(files: DataFrame) -> DataFrame:
    """Prepared chunks with id, search text, source and neighbours filled in; empty contents go."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(_chunks)?\.json$", "")
    c = files.where("error IS NULL").select("file", "pos", "chunk.*").where(F.length(strip(F.coalesce("content", F.lit("")))) > 0)
    source = filled(F.col("source"), F.col("citation.paper_id"), F.col("citation.title"), stem)
    section = filled(F.col("section"), F.col("citation.section"))
    cid = filled(F.col("chunk_id"), chunk_id(filled(F.col("citation.paper_id"), source), F.col("content"), section, pages_of_string(F.col("citation.pages"))))
    out = c.select("file", "pos", cid.alias("chunk_id"), "content", filled(F.col("search_text"), F.col("content")).alias("search_text"), source.alias("source"), section.alias("section"), "citation", F.coalesce("formulas", F.array()).alias("formulas"), filled(F.col("type"), F.lit("chunk")).alias("type"))
    return context_windows(out, "file", ["pos"], Options().context_chars)


def formula_base(spark: SparkSession, path: str) -> DataFrame:
    """Curated formulas of ``{"formulas": [...]}``; an absent file is an error of the read."""
    return spark.read.schema(f"formulas array<{KB}>").option("multiLine", True).json(path).select(F.posexplode("formulas").alias("pos", "f")).select("pos", "f.*")


def write_formula_base(kb: DataFrame, path: str) -> None:
    kb.agg(F.sort_array(F.collect_list(F.struct(*[c for c in kb.columns]))).alias("formulas")).coalesce(1).write.mode("overwrite").json(path)


def binary_files(spark: SparkSession, directory: str, glob: str = "*.pdf", options: Options | None = None) -> DataFrame:
    """(path, content, md5, cache_key): files below a directory and the key under which their chunks are kept."""
    conf = str(sorted((options or Options()).as_dict().items()))
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directory)
    return b.select("path", "content", F.md5("content").alias("md5"), F.concat_ws("_", F.md5("content"), F.substring(F.md5(F.lit(conf).cast("binary")), 1, 8)).alias("cache_key"))


def not_cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache.select("cache_key"), "cache_key", "left_anti")


Parser = Callable[[bytes, str], list[tuple[int, int, str, float, float, float, float]]]


def pdf_parser(data: bytes, path: str) -> list[tuple[int, int, str, float, float, float, float]]:
    """(page, pos, text, x0, y0, x1, y1) by the optional PDF library; an ImportError tells that it is missing."""
    import fitz

    out = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        for n, page in enumerate(doc):
            blocks = [b for b in page.get_text("blocks") if b[6] == 0]
            out += [(n + 1, i, b[4].strip(), *map(float, b[:4])) for i, b in enumerate(blocks)]
            if not blocks and Options().ocr_enabled:
                out += [(n + 1, 0, t, 0.0, 0.0, 0.0, 0.0) for t in [ocr(page.get_pixmap(dpi=300).tobytes("png"))] if t]
    return out


def ocr(png: bytes) -> str:
    """Text of a page's image; empty on any failure."""
    try:
        import io

        import pytesseract
        from PIL import Image

        return pytesseract.image_to_string(Image.open(io.BytesIO(png)), lang=Options().ocr_lang).strip()
    except Exception:
        return ""


_FURNITURE = (r"^\s*\d+\s*$", r"\.{4,}\s*\d+\s*$", r"^\d+\.\d+\s+[^\n]{3,80}\s+\d{1,4}$")


def layout_blocks(files: DataFrame, parser: Parser = pdf_parser) -> DataFrame:
    """Layout blocks of every file; a file that fails gives one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows = [(path, *r, None) for r in parser(bytes(data), path)]
                except Exception as e:
                    rows = [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["paper_id", "page", "pos", "text", "x0", "y0", "x1", "y1", "error"])

    got = files.select("path", "content").mapInPandas(run, "paper_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double, error string")
    return got.where(F.col("error").isNotNull() | ~F.coalesce("text", F.lit("")).rlike("|".join(f"({p})" for p in _FURNITURE)))


def parse_tei(xml: str, paper_id: str) -> list[tuple]:
    """(paper_id, pos, type, content, latex, section, page, label) of TEI XML in order; unreadable XML gives none."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    name = lambda e: re.sub(r"^\{.*?\}", "", e.tag) if isinstance(e.tag, str) else ""
    text = lambda e: re.sub(r"\s+", " ", "".join(e.itertext())).strip()
    rows: list[tuple] = []
    add = lambda kind, content, latex=None, section=None, page=None, label=None: rows.append((paper_id, len(rows), kind, content, latex, section, page, label))

    def page_of(e: ET.Element) -> int | None:
        for a in ("page", "n", "from", "{http://www.w3.org/XML/1998/namespace}id"):
            m = re.search(r"\d+", e.attrib.get(a, ""))
            if m:
                return int(m.group())
        return None

    every = list(root.iter())
    title = next((text(e) for e in every if name(e) == "title" and text(e)), "")
    people = [text(e) for e in every if name(e) == "author"] or [text(e) for e in every if name(e) == "contributor"]
    people = [p for p in people if p and len(p) < 120]
    year = next((m.group() for e in every if name(e) == "date" for m in [re.search(r"(19|20)\d{2}", e.attrib.get("when", "") + " " + text(e))] if m), "")
    abstract = next((text(e) for e in every if name(e) == "abstract" and text(e)), "")
    for kind, value in (("title", title), ("authors", ", ".join(people)), ("publication_date", year), ("abstract", abstract)):
        if value:
            add(kind, value)

    def walk(e: ET.Element, section: str | None) -> None:
        for x in e:
            kind = name(x)
            if kind == "head" and name(e) == "div":
                section = text(x) or section
                if text(x):
                    add("section", text(x), section=section)
            elif kind == "p":
                if text(x):
                    add("paragraph", text(x), section=section, page=page_of(x))
                for f in x.iter():
                    if name(f) == "formula":
                        add("formula", "", next((v for v in (f.attrib.get(k) for k in ("tex", "latex", "formula")) if v), text(f)), section, page_of(f), f.attrib.get("label") or f.attrib.get("n"))
            elif kind == "formula":
                add("formula", "", next((v for v in (x.attrib.get(k) for k in ("tex", "latex", "formula")) if v), text(x)), section, page_of(x), x.attrib.get("label") or x.attrib.get("n"))
            elif kind in ("figure", "table"):
                cap = next((text(c) for n in ("head", "figDesc") for c in x.iter() if name(c) == n and text(c)), "")
                if cap:
                    add(kind, cap, section=section, page=page_of(x))
            else:
                walk(x, section)

    for body in (e for e in every if name(e) == "body"):
        walk(body, None)
    return rows


def tei_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of TEI documents (paper_id, xml); the order of siblings matters, so the XML is read in Python."""
    cols = ["paper_id", "pos", "type", "content", "latex", "section", "page", "label"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, x in zip(b["paper_id"], b["xml"]) for r in parse_tei(x or "", p)], columns=cols).astype({"page": "Int32"})

    return docs.select("paper_id", "xml").mapInPandas(run, "paper_id string, pos int, type string, content string, latex string, section string, page int, label string")


def save_tables(tables: dict[str, DataFrame], base: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def load_table(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """A saved table, or an empty one of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(f"{base}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
