"""Column functions on plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, written out because the engines' ``\\s`` differ.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Characters that are spelled otherwise, in order.
CHARACTERS = (("\uf0b7", "-"), ("\ufeff", ""), ("\u200b", ""), ("\u00a0", " "), ("\uf020", " "), ("…", "..."), ("−", "-"), ("–", "-"), ("—", "-"), ("∙", "·"), ("⋅", "·"), ("§", ""), ("™", ""), ("®", ""))
# Words that carry no meaning when formulas are linked.
LINK_STOP = (
    "для", "при", "это", "как", "или", "что", "где", "также", "который", "equation", "formula", "model", "where", "with", "from", "this",
    "формула", "уравнение", "модель", "глава", "стр", "страница",
)
# Substrings that make a question mathematical.
MATH_TERMS = (
    "уравнение", "equation", "формула", "formula", "нернста", "nernst", "планка", "planck", "пуассона", "poisson", "навье", "navier", "стокса", "stokes", "коэффициент", "coefficient",
    "концентрация", "concentration", "поток", "flux", "потенциал", "potential", "плотность тока", "current density", "диссоциация", "dissociation", "рекомбинация", "recombination",
    "k_d", "kd", "k_r", "kr", "k_w", "kw", "константа", "constant", "вода", "water", "ph", "водородный", "гидроксил", "гидроксида", "ион", "ion", "электродиализ", "electrodialysis",
    "мембрана", "membrane", "опз", "область пространственного заряда", "space charge", "space-charge", "дебаев", "debye", "вах", "вольт-ампер", "current-voltage", "overlimiting current", "limiting current",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def filled(c: Column, *others: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (c, *others)])


def any_contains(c: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms])


def clean_text(c: Column) -> Column:
    """Extraction marks, broken words, control and variant characters; null becomes empty."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:\d+\)", "")
    x = F.regexp_replace(x, r"([A-Za-zА-Яа-яЁё])-+[\s]*\n\s*([A-Za-zА-Яа-яЁё])", "$1$2")
    x = F.regexp_replace(x, r"([A-Za-zА-Яа-яЁё])-+\s+([A-Za-zА-Яа-яЁё])", "$1$2")
    x = F.regexp_replace(x, r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}]", "")
    for old, new in CHARACTERS:
        x = F.replace(x, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_latex(c: Column) -> Column:
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"\(cid:\d+\)", "")
    x = F.regexp_replace(F.translate(x, "\u00a0\u200b\ufeff", " "), r"[ \t]+", " ")
    return strip(x)


def link_text(c: Column) -> Column:
    """Text as formulas are linked by it: lower case, one dash, no LaTeX signs."""
    x = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё−–—×·\\{}_^", "е---x      ")
    return strip(F.regexp_replace(x, f"{WS}+", " "))


def link_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(link_text(c), F.lit("[a-zа-я0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*LINK_STOP))


def search_tokens(c: Column) -> Column:
    """Tokens of the lexical index; accented Latin letters part words."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-zа-яё0-9_+\-*/=∂∇]+"), "")


def math_score(c: Column) -> Column:
    """How mathematical a question is, from 0 to 1."""
    q = F.lower(F.coalesce(c, F.lit("")))
    signs = F.size(F.regexp_extract_all(q, F.lit(r"[=∂∇∑∫±×÷√∞≤≥≠]|\\[a-z]+|_\{|d/d[xt]|\b(?:div|grad|rot)\b"), F.lit(0)))
    terms = reduce(lambda a, b: a + b, [F.contains(q, F.lit(t)).cast("int") for t in MATH_TERMS])
    return F.least(F.least(signs * F.lit(0.25), F.lit(0.6)) + F.least(terms * F.lit(0.1), F.lit(0.4)), F.lit(1.0))


def page_of_context(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"(стр\.?|страница|page)\s*\.?\s*(\d+)", 2), F.lit("")).try_cast("int")


def format_latex(c: Column) -> Column:
    """Bracket delimiters as dollars, for display."""
    x = F.regexp_replace(c, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(x, r"(?s)\\\((.*?)\\\)", r"\$$1\$")


def replace_phrases(c: Column, phrases: dict[str, str]) -> Column:
    """Phrases of a dictionary as marked formulas; an empty dictionary changes nothing."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(f"[ФОРМУЛА: {kv[1]}]")), phrases.items(), c)


def title_flag(c: Column) -> Column:
    """Whether a text looks like a section's title."""
    s = strip(F.coalesce(c, F.lit("")))
    exact = s.rlike(f"(?iu)^({'|'.join(HEADINGS)})$")
    numbered = s.rlike(r"^(Глава\s+\d+\.?\s+.+|\d+\.\d+\.\d+\s+[A-ZА-ЯЁ].+|\d+\.\d+\s+[A-ZА-ЯЁ].+|\d+\.\s+[A-ZА-ЯЁ].+|\d+\s+[A-ZА-ЯЁ][^.!?]{5,180}$)")
    n_words = F.size(F.regexp_extract_all(s, F.lit("[A-Za-zА-Яа-яЁё0-9_]+"), F.lit(0)))
    topical = F.length(s).between(8, 120) & ~F.endswith(s, F.lit(".")) & s.rlike("^[A-ZА-ЯЁ]") & (n_words <= 12) & any_contains(F.lower(s), TOPICS)
    return (F.length(s) > 0) & (F.length(s) <= 220) & (exact | numbered | topical)


# Headings that stand alone, and words that make a short line a heading.
HEADINGS = (
    "Введение", "INTRODUCTION", "Аннотация", "ABSTRACT", "Реферат", "Ключевые слова", "KEYWORDS", "Заключение", "CONCLUSION", "ВЫВОДЫ", "Conclusions", "Литература", "Список литературы", "REFERENCES",
    "БИБЛИОГРАФИЧЕСКИЙ СПИСОК", "Результаты", "RESULTS", "Обсуждение", "DISCUSSION", "Методы", "METHODS", "Материалы и методы", "Теоретическая часть", "THEORETICAL", "Математическая модель", "MATHEMATICAL MODEL",
    "Постановка задачи", "Problem statement",
)
TOPICS = ("модель", "уравнения", "электроконвекция", "результаты", "концентрация", "потенциал", "диффузионный слой", "model", "equations", "electroconvection", "results", "diffusion layer", "mathematical")
REFERENCE_HEADINGS = ("литература", "список литературы", "references", "библиографический список")


def reference_heading(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*REFERENCE_HEADINGS)
