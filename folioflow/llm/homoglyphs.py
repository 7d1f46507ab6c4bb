"""One form for text that looks the same.

Each Arrow batch of a partition is handed to an embedded DuckDB, whose SQL maps
full-width forms, invisible characters, spaces, ligatures and look-alike letters
with ``translate`` and regular expressions and composes accents with
``nfc_normalize``.

Defined results: a null text stays null and has no kinds; an empty text stays
empty.  Superscripts, units, dashes, ``№`` and single Greek letters are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import slices

CHARS = 4_000_000

# Look-alike letters, Cyrillic / Greek and the Latin letter each resembles.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxdhqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανικορυ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXavikopu"
# Look-alikes for writing a word wholly in Cyrillic; Latin on the left.
LATIN = "ABEKMHOPCTYXaeopcyxSIJsij"
LATIN_AS_CYRILLIC = "АВЕКМНОРСТУХаеорсухЅІЈѕіј"
GREEK_OF_CYRILLIC = "ΑΒΕΗΚΜΟΡΤΥΧαορυν"
GREEK_AS_CYRILLIC = "АВЕНКМОРТУХаоруν"

_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_INVISIBLE = r"\x{00AD}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
_ACCENTS = r"\x{0300}-\x{036F}\x{3099}\x{309A}"
_WORD = r"\p{L}\p{N}\p{M}"
#: Joiners are part of the spelling between Devanagari letters.
_JOINED = r"([\x{0900}-\x{097F}])[\x{200C}\x{200D}]+([\x{0900}-\x{097F}])"
_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def _in(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ligatures(x: str) -> str:
    for a, b in _LIGATURES:
        x = f"replace({x}, {_in(a)}, {_in(b)})"
    return x


_MIXED = f"""
    (regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}')
     OR (regexp_matches(w, '\\p{{Latin}}') OR regexp_matches(w, '\\p{{Cyrillic}}')) AND regexp_matches(w, '[{GREEK}]'))"""

# A mixed word is Latin if a letter of it exists in Latin only, else Cyrillic if one exists
# in Cyrillic only, else of the script of most of its letters.
SQL = f"""
WITH a AS (
    SELECT id, content,
           regexp_matches(content, '[{_WIDE[0]}-{_WIDE[9]}{_WIDE[10]}-{_WIDE[35]}{_WIDE[36]}-{_WIDE[-1]}]') AS fullwidth,
           regexp_matches(regexp_replace(content, '{_JOINED}', '\\1\\2', 'g'), '[{_WORD}][{_INVISIBLE}]+[{_WORD}]') AS zero_width,
           regexp_matches(content, '{_SPACES}') AS space,
           regexp_matches(content, '[ﬀ-ﬆ]') AS ligature,
           regexp_replace(regexp_replace(translate(content, {_in(_WIDE)}, {_in(_NARROW)}),
                          '{_SPACES}', ' ', 'g'), '[{_INVISIBLE}]', '', 'g') AS t
    FROM batch
), b AS (
    SELECT * EXCLUDE (t),
           regexp_matches(t, '\\p{{L}}[{_ACCENTS}]')
             AND length(list_aggregate(regexp_extract_all(t, '\\p{{L}}[{_ACCENTS}]+'), 'string_agg', ''))
               > length(nfc_normalize(list_aggregate(regexp_extract_all(t, '\\p{{L}}[{_ACCENTS}]+'), 'string_agg', ''))) AS combining,
           nfc_normalize({_ligatures('t')}) AS t
    FROM a
), c AS (
    SELECT *, list_filter(list_distinct(regexp_extract_all(t, '[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}]+')),
                          lambda w: length(w) > 1 AND {_MIXED}) AS mixed
    FROM b
)
SELECT id,
       CASE WHEN len(mixed) = 0 OR mixed IS NULL THEN t ELSE
         array_to_string(list_transform(regexp_extract_all(t, '[\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}]+|[^\\p{{Latin}}\\p{{Cyrillic}}\\p{{Greek}}]+'),
           lambda w: CASE
             WHEN length(w) < 2 OR NOT {_MIXED} THEN w
             WHEN regexp_matches(w, '[^{LATIN}\\P{{Latin}}]') THEN translate(translate(w, {_in(CYRILLIC)}, {_in(CYRILLIC_AS_LATIN)}), {_in(GREEK)}, {_in(GREEK_AS_LATIN)})
             WHEN regexp_matches(w, '[^{CYRILLIC}\\P{{Cyrillic}}]')
               OR length(regexp_replace(w, '\\P{{Cyrillic}}', '', 'g')) >= length(regexp_replace(w, '\\P{{Latin}}', '', 'g'))
               THEN translate(translate(w, {_in(LATIN)}, {_in(LATIN_AS_CYRILLIC)}), {_in(GREEK_OF_CYRILLIC)}, {_in(GREEK_AS_CYRILLIC)})
             ELSE translate(translate(w, {_in(CYRILLIC)}, {_in(CYRILLIC_AS_LATIN)}), {_in(GREEK)}, {_in(GREEK_AS_LATIN)}) END), '') END AS text,
       list_filter([CASE WHEN combining THEN 'combining' END, CASE WHEN fullwidth THEN 'fullwidth' END,
                    CASE WHEN ligature THEN 'ligature' END, CASE WHEN len(mixed) > 0 THEN 'lookalike' END,
                    CASE WHEN space THEN 'space' END, CASE WHEN zero_width THEN 'zero_width' END],
                   lambda k: k IS NOT NULL) AS kinds
FROM c
"""


def unify(df: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key``, ``text`` in one form, and ``kinds``: the kinds of disguise that were met."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            for whole in batches:
                whole = whole.rename_columns(["id", "content"])
                sizes = [0 if v is None else v for v in pa.compute.binary_length(whole.column(1)).to_pylist()]
                for b, e in slices(sizes, CHARS):
                    con.register("batch", pa.Table.from_batches([whole.slice(b, e - b)]))
                    out = con.sql(SQL).to_arrow_table()
                    con.unregister("batch")
                    schema = pa.schema([(key, whole.schema.field(0).type), ("text", pa.string()), ("kinds", pa.list_(pa.string()))])
                    yield from out.rename_columns([key, "text", "kinds"]).cast(schema).to_batches()
        finally:
            con.close()

    import pyarrow.compute  # noqa: F401

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"{key} {kind}, text string, kinds array<string>")
