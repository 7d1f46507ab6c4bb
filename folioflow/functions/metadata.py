"""Column functions on titles, authors and years of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import any_contains, strip

# Substrings that no author's name has.
NOT_AUTHORS = (
    "университет", "university", "институт", "institute", "лаборатория", "кафедра", "department", "факультет", "faculty", "министерство", "профессор", "professor", "доцент", "доктор",
    "кандидат", "аспирант", "заведующий", "руководитель", "научный", "ректор", "декан", "федеральное", "государственное", "бюджетное", "учреждение", "page", "figure", "table", "equation",
    "section", "оппонент", "рецензент", "научный руководитель", "ведущая организация",
)
THESIS = "на правах рукописи"


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


# Patterns of names, years and titles below are fixed values.
def author(c: Column) -> Column:
    """A name as surname and initials, from five ways of writing it."""
    x = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"\d+$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*[a-z]?,\s*\d?\*?$", ""), r"(?i)\(?orcid[^)]*\)?", "")
    x = F.regexp_replace(x, r"\b[\w.-]+@[\w.-]+\.\w+\b", "")
    return (
        F.when(x.rlike("^[А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+$"), F.regexp_replace(x, r"^(\S+) (\S)\S* (\S)\S*$", "$1 $2.$3."))
        .when(x.rlike(r"^[А-ЯЁ]\.([А-ЯЁ]\.)? [А-ЯЁ][а-яё]+$"), F.regexp_replace(x, r"^(\S+) (\S+)$", "$2 $1"))
        .when(x.rlike(r"^[A-Z]\.([A-Z]\.)? [A-Z][a-z]+$"), F.regexp_replace(x, r"^(\S+) (\S+)$", "$2 $1"))
        .otherwise(x)
    )


def valid_author(c: Column) -> Column:
    return F.length(c).between(3, 50) & c.rlike(r"\p{L}") & ~c.rlike(r"\d") & c.rlike("[. ]") & ~any_contains(F.lower(c), NOT_AUTHORS)


def authors(c: Column) -> Column:
    """A list of names cleaned, checked, written alike and without repetitions, in order."""
    def bare(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"\d+$", ""), r"\s*[a-z]?,\s*\d?\*?$", "")
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), bare), lambda x: ~F.contains(x, F.lit("@")) & valid_author(x))
    return F.array_distinct(F.filter(F.transform(kept, author), lambda x: ~any_contains(F.lower(x), ("университет", "university", "институт", "institute"))))


def _between(c: Column) -> Column:
    return F.when(c.cast("int").between(1950, 2030), c)


def year(text: Column, created: Column | None = None) -> Column:
    """The last plausible year of the opening, else of a DOI, an acceptance, a receipt, a copyright or the file."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 5000)
    years = F.filter(F.regexp_extract_all(head, F.lit(r"\b(19[0-9]{2}|20[0-2][0-9]|2030)\b"), F.lit(1)), lambda y: y.cast("int").between(1950, 2030))
    ways = [F.try_element_at(years, F.lit(-1)), _first(head, r"10\.\d{4}/[^\s]+\.(\d{4})\."), _first(text, r"(?i)Accepted\s*:\s*\d{1,2}\s+[A-Za-z]+\s+(\d{4})"), _first(text, r"(?i)Received\s*:\s*\d{1,2}\s+[A-Za-z]+\s+(\d{4})"), _between(_first(head, r"©\s*(\d{4})"))]
    if created is not None:
        ways.append(_between(_first(created, r"(19[0-9]{2}|20[0-2][0-9])")))
    return F.coalesce(*ways)


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: x != "")


# Titles of files that say nothing, and words that no title's line has.
NO_TITLES = ("на правах рукописи", "title", "untitled")
NOT_TITLE = "(abstract|keywords|doi|received|revised|accepted)"


def article_title(text: Column, meta: Column, source: Column) -> Column:
    """Title of the file's metadata, of ``\\title{}``, the first of 30 lines that may be one, or the file's name."""
    given = F.regexp_replace(meta, r"\s+", " ")
    given = F.when((F.length(meta) > 5) & ~F.lower(meta).isin(*NO_TITLES) & (F.length(given) > 10), given)
    opening = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 30), strip)
    line = F.filter(opening, lambda x: (F.length(x) > 20) & (F.length(x) < 200) & ~x.rlike(f"(?iu){NOT_TITLE}"))
    latex = F.coalesce(text, F.lit("")).rlike(r"\\title\{.*?\}")
    return F.coalesce(given, F.when(latex, F.regexp_extract(text, r"\\title\{(.*?)\}", 1)), F.try_element_at(line, F.lit(1)), F.replace(source, F.lit("_"), F.lit(" ")))


def _is_thesis(text: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(THESIS))


def title(text: Column, meta: Column, source: Column) -> Column:
    """A thesis's title where there is one, else an article's."""
    return F.coalesce(F.when(_is_thesis(text), thesis_title(text)), article_title(text, meta, source))


def all_authors(text: Column) -> Column:
    """A thesis's author where there is one, else an article's authors."""
    of_thesis = authors(F.array(thesis_author(text)))
    return F.when(_is_thesis(text) & thesis_author(text).isNotNull(), of_thesis).otherwise(article_authors(text))


def _after_mark(text: Column, n: int) -> Column:
    """The ``n`` lines after the mark of a thesis, blank ones included."""
    ls = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)
    at = F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.lit(THESIS))), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(ls, at + 1, F.lit(n)))


def thesis_author(text: Column) -> Column:
    """The first full name or name with initials in the 14 lines after the mark of a thesis."""
    name, initials = "[А-ЯЁ][а-яё]+", r"[А-ЯЁ]\.(?:[А-ЯЁ]\.)?"
    pattern = rf"^({name}\s+{name}\s+{name}|{name}\s+{initials}|{initials}\s+{name})$"
    return F.try_element_at(F.filter(_after_mark(text, 14), lambda x: x.rlike(pattern)), F.lit(1))


def thesis_title(text: Column) -> Column:
    """The lines after the mark of a thesis, without names, up to a stop line or a code, as one title of more than 20 characters."""
    stop = r"(?iu)(диссертаци|автореферат|на соискание|ученой степени|специальность)|^\d{2}\.\d{2}\.\d{2}"
    after = _after_mark(text, 29)
    # a line that is a name goes before a stop is looked for, unless it holds a stop word itself
    name = lambda x: x.rlike(r"^[А-ЯЁ][а-яё]+(\s+[А-ЯЁ][а-яё]+){1,2}$") & ~x.rlike(stop)
    rows = F.filter(after, lambda x: (x != "") & ~name(x))
    at = F.array_position(F.transform(rows, lambda x: x.rlike(stop)), F.lit(True)).cast("int")
    kept = F.when(at > 0, F.slice(rows, F.lit(1), at - 1)).otherwise(rows)
    whole = F.regexp_replace(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "), r"^[ .;:\-]+|[ .;:\-]+$", "")
    return F.when(F.length(whole) > 20, whole)


def article_authors(text: Column) -> Column:
    """Names of a contribution statement, else names with initials of the opening."""
    credit = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?is)CRediT authorship contribution statement\s*\n(.*?)(?:\n\n|\z)", 1)
    parts = F.filter(F.split(credit, "\n"), lambda x: F.contains(x, F.lit(":")))
    named = F.filter(F.transform(parts, lambda x: F.trim(F.split_part(x, F.lit(":"), F.lit(1)))), lambda x: (x != "") & valid_author(x))
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    typed = F.transform(F.regexp_extract_all(head, F.lit(r"([A-Z]\.(?:[A-Z]\.)?)\s+([A-Z][a-z]+)"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " "))
    return authors(F.when(F.size(named) > 0, named).otherwise(typed))
