"""SQL for DuckDB that says what the queries of :mod:`folioflow.plans.queries` do."""

from __future__ import annotations

from folioflow.plans.values import (
    ACRONYMS, ALIASES, CHARACTERS, CLASSES, GARBAGE, HEADINGS, KEYWORDS, LINK_STOP, MATH, MATH_TERMS, NOT_VARIABLES, PHENOMENA, REPAIRS, SOURCE_TRUST, SYMBOLS, TERM_STOP, TOPICS,
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


BLOCKS = """b AS (SELECT block_id, any_value(paper_id) paper_id, any_value(pos) pos, any_value("type") "type", any_value(content) "content", any_value(latex) latex,
  any_value(page) page, any_value(section) section, any_value(label) label FROM blocks GROUP BY block_id)"""
CHUNKS = """c AS (SELECT chunk_id, any_value(content) "content", any_value(section) section, any_value(source) source, any_value(citation) citation, any_value(pages) pages FROM chunks GROUP BY chunk_id)"""
FORMULAS = """f AS (SELECT f.id id, any_value(f.raw) raw, any_value(f.source) source FROM (SELECT unnest(formulas) f FROM blocks) WHERE f.id IS NOT NULL GROUP BY f.id HAVING any_value(f.raw) IS NOT NULL)"""
TOK = r"list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-zа-яё0-9_+\-*/=∂∇]+', ' ', 'g')), ' '), lambda x: x <> '')"
BM25 = f"""t AS (SELECT doc_id, {TOK.format("text")} toks FROM documents),
dl AS (SELECT doc_id, len(toks) dl FROM t), tot AS (SELECT count(*) n, avg(dl) avgdl FROM dl),
p AS (SELECT term, doc_id, count(*) tf FROM (SELECT doc_id, unnest(toks) term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) df FROM p GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) r FROM df, tot),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END idf FROM raw)"""
HITS = f"""q AS (SELECT doc_id qid, coalesce(title, text, '') query FROM documents WHERE doc_id % 100 = 0),
qt AS (SELECT qid, term, count(*) times FROM (SELECT qid, unnest({TOK.format("query")}) term FROM q) GROUP BY ALL),
s AS (SELECT qid, p.doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
      FROM qt JOIN idf USING (term) JOIN p USING (term) JOIN dl ON dl.doc_id = p.doc_id, tot GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS "rank" FROM s)"""
DENSE = """v AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT vec_id qid, embedding qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, label, round(list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) score FROM q, v)"""
_MATH = " + ".join(f"CAST(contains(q, {_q(t)}) AS INT)" for t in MATH_TERMS)


def _math(x: str) -> str:
    return f"""least(least(len(regexp_extract_all(lower(coalesce({x}, '')), '[=∂∇∑∫±×÷√∞≤≥≠]|\\\\[a-z]+|_\\{{|d/d[xt]|\\b(?:div|grad|rot)\\b')) * 0.25::DOUBLE, 0.6::DOUBLE)
  + least((SELECT {_MATH} FROM (SELECT lower(coalesce({x}, '')) q)) * 0.1::DOUBLE, 0.4::DOUBLE), 1.0::DOUBLE)"""


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '\\(cid:\\d+\\)', '', 'g')"
    x = f"regexp_replace({x}, '([A-Za-zА-Яа-яЁё])-+[\\s]*\\n\\s*([A-Za-zА-Яа-яЁё])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '([A-Za-zА-Яа-яЁё])-+\\s+([A-Za-zА-Яа-яЁё])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '[\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g')"
    for a, b in CHARACTERS:
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return _strip(f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _any(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(t)})" for t in terms) + ")"


_S = _strip("coalesce(raw, '')")
_WORDS = "len(regexp_extract_all({0}, '[A-Za-zА-Яа-яЁё]{{{1},}}'))"
_SYM = SYMBOLS.replace("\\-", "-")
_KB_TEXT = "lower(coalesce(latex, '') || ' ' || coalesce(description, '') || ' ' || coalesce(context, ''))"
_LINK = "translate(lower(coalesce({0}, '')), 'ё−–—×·\\{{}}_^', 'е---x      ')"

_FRAG = r"^([+\-]H|[+\-]OH|H[+\-]|OH[+\-]|[+\-]?\d*OH[+\-]?|[A-ZА-Я][0-9]+[A-ZА-Я]?|[A-ZА-Я][0-9]*[+\-]|[+\-][A-ZА-Я][0-9]*|[cdjxytuvCEPIRFDkKwWrTφϕερν]+[_\d]*|[=+\-*/^_{}()\[\].,;:]+)$"
_ORDER = "(PARTITION BY paper_id ORDER BY pos, block_id)"
_FTYPES = "('formula', 'equation_block', 'formula_candidate', 'formula_fragment')"

ORACLES = {
    "tokenize_docs": f"""SELECT doc_id, CAST(len(t) AS BIGINT) n_tokens, CAST(len(list_distinct(t)) AS BIGINT) n_distinct FROM (SELECT doc_id, {TOK.format("text")} t FROM documents)""",
    "bm25_postings": f"""WITH {BM25} SELECT p.doc_id, term, CAST(tf AS BIGINT) tf, CAST(dl AS BIGINT) dl FROM p JOIN dl USING (doc_id)""",
    "bm25_idf": f"""WITH {BM25} SELECT term, CAST(df AS BIGINT) df, round(idf, 6) idf FROM idf""",
    "bm25_topk_batch": f"""WITH {BM25}, {HITS} SELECT qid, doc_id, score, CAST("rank" AS INT) AS "rank" FROM h WHERE "rank" <= 10 AND score > 0""",
    "evidence_dedup_top": f"""WITH {BM25}, {HITS} SELECT qid, doc_id, score, CAST("rank" AS INT) AS "rank" FROM h WHERE "rank" <= 3 AND score > 0""",
    "math_score": f"""SELECT paper_id, round({_math("title")}, 6) math_score FROM (SELECT paper_id, max(title) title FROM papers WHERE paper_id IS NOT NULL GROUP BY 1)""",
    "dense_topk": f"""WITH {DENSE} SELECT qid, vec_id, score, CAST("rank" AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS "rank" FROM s) WHERE "rank" <= 10""",
    "clean_text": f"""WITH {BLOCKS} SELECT block_id, {_clean('"content"')} AS clean FROM b WHERE "content" IS NOT NULL""",
    "clean_latex": f"""WITH {BLOCKS} SELECT block_id, {_strip("regexp_replace(replace(replace(replace(regexp_replace(latex, '\\(cid:\\d+\\)', '', 'g'), chr(160), ' '), chr(8203), ''), chr(65279), ''), '[ \\t]+', ' ', 'g')")} AS clean FROM b WHERE latex IS NOT NULL""",
    "formula_fragment_flag": f"""WITH {BLOCKS}, x AS (SELECT block_id, {_strip("coalesce(latex, content, '')")} s FROM b)
SELECT block_id, s <> '' AND regexp_matches(s, '{_FRAG}') AS fragment,
  length(s) < 2 OR regexp_matches(s, '^\\d{{1,4}}$') OR {_WORDS.format("s", 2)} > 35 OR regexp_matches(s, '^(_|[.,;:]+|NaCl|KCl|CEM|AEM|EDL|SCR|DL|PD|PS)$') AS garbage,
  length(s) < 3 OR regexp_matches(s, '^(\\d+$|CEM_|AEM_|DL_|PS,$|PD$|NaCl$|KCl$|CatD$|NCatD$|RD$|_$|[.,;:]+$)') AS chunk_garbage FROM x""",
    "dedup_consecutive": f"""WITH {BLOCKS}, e AS (SELECT *, {_strip("coalesce(content, '')")} s, {_strip("coalesce(latex, '')")} l FROM b),
k AS (SELECT * FROM e WHERE s <> '' OR l <> ''),
g AS (SELECT block_id, {{'t': "type", 'c': left(s, 200), 'l': left(l, 200), 'p': page}} sig, lag({{'t': "type", 'c': left(s, 200), 'l': left(l, 200), 'p': page}}) OVER {_ORDER} prev FROM k)
SELECT block_id FROM g WHERE sig IS DISTINCT FROM prev""",
    "empty_by_type": f"""WITH b AS (SELECT block_id, any_value("type") k, any_value(content) "content", any_value(latex) latex, any_value(len(formulas)) n FROM blocks GROUP BY block_id),
x AS (SELECT block_id, k, {_strip("coalesce(content, '')")} <> '' c, {_strip("coalesce(latex, '')")} <> '' l, coalesce(n, 0) > 0 f FROM b)
SELECT block_id FROM x WHERE CASE WHEN k IN ('equation_block', 'formula', 'formula_candidate') THEN c OR l OR f WHEN k = 'paragraph' THEN c OR f WHEN k = 'section' THEN c ELSE true END""",
    "section_forward_fill": f"""WITH {BLOCKS}, x AS (SELECT *, nullif(section, '') own, CASE WHEN "type" = 'section' THEN coalesce(nullif(content, ''), nullif(section, ''), '') END named FROM b),
y AS (SELECT *, nullif(last_value(named IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY pos, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') before FROM x)
SELECT block_id, CASE WHEN "type" = 'section' THEN before ELSE coalesce(own, before) END section FROM y""",
    "front_matter": f"""WITH {BLOCKS}, x AS (SELECT *, row_number() OVER {_ORDER} rn, regexp_matches(lower({_strip("coalesce(content, '')")}), '^(введение|introduction)') hit FROM b),
y AS (SELECT *, coalesce(rn < min(CASE WHEN hit THEN rn END) OVER (PARTITION BY paper_id), false) f FROM x)
SELECT block_id, f AS "front", CASE WHEN f THEN coalesce(nullif(section, ''), 'front_matter') ELSE section END section FROM y""",
    "merge_equations": f"""WITH RECURSIVE {BLOCKS}, x AS (SELECT *, row_number() OVER {_ORDER} rn, "type" IN ('formula', 'formula_candidate', 'formula_fragment') f FROM b),
y AS (SELECT *, lead("type") OVER w t1, lead("type", 2) OVER w t2, lead("type", 3) OVER w t3, lead(f) OVER w f1 FROM x WINDOW w AS (PARTITION BY paper_id ORDER BY rn)),
z AS (SELECT *, CASE WHEN "type" = 'paragraph' AND f1 AND t2 = 'formula_label' THEN CASE WHEN t3 = 'paragraph' THEN 4 ELSE 3 END WHEN "type" = 'paragraph' AND f1 THEN 2 ELSE 1 END step FROM y),
walk AS (SELECT paper_id, rn, step FROM z WHERE rn = 1 UNION ALL SELECT z.paper_id, z.rn, z.step FROM walk JOIN z ON z.paper_id IS NOT DISTINCT FROM walk.paper_id AND z.rn = walk.rn + walk.step),
m AS (SELECT p.*, k.step FROM walk k JOIN z p ON p.paper_id IS NOT DISTINCT FROM k.paper_id AND p.rn = k.rn),
r AS (SELECT m.step n, m.content lead_text, m.section lead_section, coalesce(f.block_id, m.block_id) block_id, coalesce(f."type", m."type") k, coalesce(f.latex, CASE WHEN f.block_id IS NULL THEN m.latex END) latex, coalesce(f.content, CASE WHEN f.block_id IS NULL THEN m.content END) "content",
    CASE WHEN f.block_id IS NULL THEN m.label ELSE f.label END label, CASE WHEN f.block_id IS NULL THEN m.section ELSE f.section END section, l.content label_text, d.content after_text
  FROM m LEFT JOIN z f ON m.step > 1 AND f.paper_id IS NOT DISTINCT FROM m.paper_id AND f.rn = m.rn + 1 LEFT JOIN z l ON m.step > 2 AND l.paper_id IS NOT DISTINCT FROM m.paper_id AND l.rn = m.rn + 2 LEFT JOIN z d ON m.step > 3 AND d.paper_id IS NOT DISTINCT FROM m.paper_id AND d.rn = m.rn + 3),
u AS (SELECT *, k IN ('formula', 'formula_candidate', 'formula_fragment') made FROM r)
SELECT block_id, CASE WHEN made THEN 'equation_block' ELSE k END "type", CASE WHEN made THEN coalesce(nullif(latex, ''), nullif(content, '')) ELSE latex END latex, CASE WHEN made AND n > 2 THEN coalesce(label_text, '') ELSE label END label,
  CASE WHEN made THEN coalesce(nullif(section, ''), CASE WHEN n > 1 THEN lead_section END) ELSE section END section, CASE WHEN made THEN CASE WHEN n > 1 THEN coalesce(lead_text, '') ELSE '' END END context_before,
  CASE WHEN made THEN CASE WHEN n > 3 THEN coalesce(after_text, '') ELSE '' END END description, CASE WHEN made THEN CASE WHEN n > 1 THEN left(coalesce(lead_text, ''), 300) ELSE '' END END semantic_description FROM u""",
    "references_cutoff": f"""WITH {BLOCKS}, x AS (SELECT *, min(CASE WHEN "type" = 'section' AND lower({_strip("coalesce(content, '')")}) IN ('литература', 'список литературы', 'references', 'библиографический список') THEN pos END) OVER (PARTITION BY paper_id) cut FROM b)
SELECT block_id FROM x WHERE cut IS NULL OR pos < cut""",
    "chunk_ids": f"""WITH {CHUNKS} SELECT chunk_id, coalesce(citation.paper_id, 'unknown') || '_' || left(md5(coalesce(nullif(coalesce(citation.paper_id, 'unknown'), ''), 'unknown') || '|' || coalesce(section, '') || '|' || coalesce(array_to_string(pages, ','), '') || '|' || left(coalesce(content, ''), 500)), 8) made_id FROM c""",
    "context_windows": f"""WITH {CHUNKS} SELECT chunk_id, left(coalesce(lag(content) OVER w, ''), 500) "prev", left(coalesce(lead(content) OVER w, ''), 500) "next" FROM c WINDOW w AS (PARTITION BY source ORDER BY chunk_id)""",
    "formula_score": f"""WITH {FORMULAS}, x AS (SELECT id, {_S} s, lower({_S}) l FROM f)
SELECT id, round(CASE WHEN length(s) < 3 THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN contains(s, '=') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(s, '[=≈≠≤≥+−\\-*/^_∂∇∑∏∫√∞]') THEN 0.25 ELSE 0 END
  + CASE WHEN regexp_matches(l, '[αβγδεζηθικλμνξοπρστυφχψωϕεερν]') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(s, '\\d') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(s, '[_^]') THEN 0.1 ELSE 0 END
  + CASE WHEN contains(s, chr(92)) THEN 0.2 ELSE 0 END + CASE WHEN {_any("l", KEYWORDS)} THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(s, '{_SYM}') THEN 0.2 ELSE 0 END
  - CASE WHEN {_WORDS.format("s", 3)} > 8 THEN 0.35 ELSE 0 END - CASE WHEN length(s) > 250 THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(l, '^(рис\\.|рисунок|figure|таблица|table)') THEN 0.5 ELSE 0 END)) END::DOUBLE, 6) score FROM x""",
    "enrich_class": "SELECT id, CASE " + " ".join(f"WHEN {_any('t', k)}{' AND NOT contains(t, ' + _q('нестационар') + ')' if n == '1D_stationary' else ''} THEN {_q(n)}" for k, n in CLASSES) + f" ELSE 'general' END model_class FROM (SELECT id, {_KB_TEXT} t FROM formula_kb)",
    "enrich_phenomena": "SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_any('t', k)} THEN {_q(n)} END" for n, k in PHENOMENA) + f"], lambda x: x IS NOT NULL), ',') phenomena FROM (SELECT id, {_KB_TEXT} t FROM formula_kb)",
    "link_tokens": f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({_LINK.format("concat_ws(' ', description, latex, context)")}, '[a-zа-я0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({", ".join(map(_q, LINK_STOP))})))), ' ') tokens FROM formula_kb""",
    "format_latex": f"""WITH {CHUNKS} SELECT chunk_id, regexp_replace(regexp_replace(content, '(?s)\\\\\\[(.*?)\\\\\\]', '$$\\1$$', 'g'), '(?s)\\\\\\((.*?)\\\\\\)', '$\\1$', 'g') shown FROM c WHERE content IS NOT NULL""",
    "page_from_context": f"""WITH {BLOCKS}, x AS (SELECT block_id, try_cast(nullif(regexp_extract(lower(content), '(стр\\.?|страница|page)\\s*\\.?\\s*(\\d+)', 2), '') AS INT) page_named FROM b WHERE content IS NOT NULL) SELECT * FROM x WHERE page_named IS NOT NULL""",
    "citation_normalize": f"""WITH {CHUNKS} SELECT chunk_id, coalesce(nullif(citation.paper_id, ''), nullif(source, '')) paper, try_cast(regexp_extract(coalesce(citation.year, ''), '(\\d{{4}})', 1) AS INT) AS "year", coalesce(nullif(citation.doi, ''), nullif(citation.original_doi, '')) doi FROM c""",
    "kb_lookup": """SELECT id, number, latex FROM formula_kb WHERE id = 'kb_001' UNION ALL (SELECT id, number, latex FROM formula_kb WHERE number = '(1.2)' ORDER BY id LIMIT 1)""",
    "year_extract": r"""WITH x AS (SELECT doc_id, coalesce("text", '') t FROM documents), y AS (SELECT doc_id, t, list_filter(regexp_extract_all(left(t, 5000), '\b(19[0-9]{2}|20[0-2][0-9]|2030)\b', 1), lambda z: CAST(z AS INT) BETWEEN 1950 AND 2030) ys FROM x)
SELECT doc_id, coalesce(ys[-1], nullif(regexp_extract(left(t, 5000), '10\.\d{4}/[^\s]+\.(\d{4})\.', 1), ''), nullif(regexp_extract(t, '(?i)Accepted\s*:\s*\d{1,2}\s+[A-Za-z]+\s+(\d{4})', 1), ''), nullif(regexp_extract(t, '(?i)Received\s*:\s*\d{1,2}\s+[A-Za-z]+\s+(\d{4})', 1), ''), nullif(regexp_extract(left(t, 5000), '©\s*(\d{4})', 1), '')) year_found FROM y""",
}
_LISTS = f"""{BM25}, v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id qid, embedding qe, coalesce(title, text, '') query FROM v LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
da AS (SELECT qid, vec_id id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) r FROM (SELECT qid, vec_id, round(list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) score FROM q, v)),
qt AS (SELECT qid, term, count(*) times FROM (SELECT qid, unnest({TOK.format("query")}) term FROM q) GROUP BY ALL),
sb AS (SELECT qid, p.doc_id id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score FROM qt JOIN idf USING (term) JOIN p USING (term) JOIN dl ON dl.doc_id = p.doc_id, tot GROUP BY ALL),
db AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) r FROM sb WHERE score > 0),
la AS (SELECT * FROM da WHERE r <= 30), lb AS (SELECT * FROM db WHERE r <= 30)"""
ORACLES["hybrid_rrf"] = f"""WITH {_LISTS}, u AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 6) score FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY ALL)
SELECT qid, id, score, CAST("rank" AS INT) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) "rank" FROM u) WHERE "rank" <= 10"""
ORACLES["hybrid_weighted"] = f"""WITH {_LISTS}, u AS (SELECT coalesce(la.qid, lb.qid) qid, coalesce(la.id, lb.id) id, round(0.6::DOUBLE / coalesce(la.r, 32) + 0.4::DOUBLE / coalesce(lb.r, 32), 6) score FROM la FULL JOIN lb ON la.qid = lb.qid AND la.id = lb.id)
SELECT qid, id, score, CAST("rank" AS INT) "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) "rank" FROM u) WHERE "rank" <= 10"""


def _re(s: str) -> str:
    return _q(s)


ORACLES["formula_valid"] = f"""WITH {FORMULAS}, x AS (SELECT id, {_S} s FROM f), y AS (SELECT id, s, regexp_matches(s, {_re(MATH)}) m,
  len(regexp_extract_all(s, '[А-Яа-яЁё]{{4,}}')) + len(regexp_extract_all(s, '[A-Za-z]{{5,}}')) n FROM x)
SELECT id, length(s) BETWEEN 3 AND 700 AND NOT regexp_matches(s, {_re("|".join(GARBAGE))}) AND NOT regexp_matches(s, {_re(ACRONYMS)}) AND NOT (n > 12 AND NOT m)
  AND (m OR regexp_matches(s, {_re(_SYM)}) OR {_any("lower(s)", KEYWORDS)}) AS valid FROM y"""
ORACLES["known_repairs"] = f"""WITH {FORMULAS}, x AS (SELECT id, raw, {_strip(f"regexp_replace(coalesce(raw, ''), '{WS}+', ' ', 'g')")} s FROM f)
SELECT id, CASE {" ".join(f"WHEN regexp_matches(s, {_re('(?i)' + p)}) THEN {_q(w)}" for p, w, _ in REPAIRS)} ELSE raw END repaired,
  CASE {" ".join(f"WHEN regexp_matches(s, {_re('(?i)' + p)}) THEN {c}::DOUBLE" for p, _, c in REPAIRS)} END confidence FROM x"""
ORACLES["confidence"] = f"""WITH {FORMULAS}, x AS (SELECT id, raw s, lower(raw) l, coalesce(source, 'heuristic') src FROM f)
SELECT id, round(greatest(0.0, least(1.0, CASE src {" ".join(f"WHEN {_q(k)} THEN {v}" for k, v in SOURCE_TRUST.items())} ELSE 0.15 END
  + CASE WHEN contains(s, '=') THEN 0.15 ELSE 0 END + CASE WHEN {_any("s", ("\\frac", "\\partial", "\\nabla", "\\Delta", "\\sum", "\\int", "^", "_"))} THEN 0.25 ELSE 0 END
  + CASE WHEN regexp_matches(s, {_re(_SYM)}) THEN 0.15 ELSE 0 END + CASE WHEN {_any("l", KEYWORDS)} THEN 0.1 ELSE 0 END + CASE WHEN length(s) < 180 THEN 0.05 ELSE 0 END
  - CASE WHEN {_WORDS.format("s", 5)} > 10 THEN 0.2 ELSE 0 END))::DOUBLE, 6) confidence FROM x"""
ORACLES["formula_variables"] = f"""WITH {FORMULAS}, x AS (SELECT id, list_filter(list_transform(regexp_extract_all(raw, '\\\\?[A-Za-zА-Яа-я]+(?:_\\{{?[A-Za-z0-9+\\-]+\\}}?)?(?:\\^\\{{?[+\\-0-9]+\\}}?)?'), lambda v: trim(replace(v, chr(92), ''))),
  lambda v: v <> '' AND length(v) <= 25 AND v NOT IN ({", ".join(map(_q, NOT_VARIABLES))})) v FROM f)
SELECT id, array_to_string(list_filter(v, lambda y, i: list_position(v, y) = i), ',') variables FROM x"""
_ALIAS = "list_sort(list_distinct(flatten([" + ", ".join("CASE WHEN " + _any("t", k) + " THEN [{0}] ELSE CAST([] AS VARCHAR[]) END".replace("{0}", "@" + str(i)) for i, (k, _, _) in enumerate(ALIASES)) + "])))"


def _alias(english: bool) -> str:
    x = _ALIAS
    for i, (_, ru, en) in enumerate(ALIASES):
        x = x.replace(f"@{i}", ", ".join(map(_q, en if english else ru)))
    return x


ORACLES["enrich_aliases"] = f"""SELECT id, array_to_string({_alias(False)}, '|') AS ru, array_to_string({_alias(True)}, '|') AS en FROM (SELECT id, lower(coalesce(description, '')) t FROM formula_kb)"""
ORACLES["query_terms"] = f"""WITH x AS (SELECT *, lower(coalesce(description, '')) t FROM formula_kb), y AS (SELECT id, lower(concat_ws(' ', coalesce(description, ''), coalesce(context, ''), coalesce(latex, ''), array_to_string({_alias(False)}, ' '), array_to_string({_alias(True)}, ' '))) t FROM x)
SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '[a-zа-яё0-9_\\\\^{{}}+-]+'), lambda v: length(v) >= 3 AND v NOT IN ({", ".join(map(_q, TERM_STOP))})))), ' ') terms FROM y"""
ORACLES["kb_prompt"] = """WITH x AS (SELECT *, array_to_string(list_transform(list_sort(map_keys(variables)), lambda k: k || ' — ' || variables[k]), '; ') v FROM formula_kb)
SELECT id, concat_ws(chr(10), CASE WHEN coalesce(number, '') <> '' THEN 'Номер: ' || number END, CASE WHEN coalesce(latex, '') <> '' THEN 'LaTeX: ' || latex END, CASE WHEN coalesce(description, '') <> '' THEN 'Описание: ' || description END,
  CASE WHEN coalesce(v, '') <> '' THEN 'Переменные: ' || v END, CASE WHEN coalesce(context, '') <> '' THEN 'Контекст: ' || context END) AS lines FROM x"""
_TITLE = f"""(length(s) > 0 AND length(s) <= 220 AND (regexp_matches(s, {_re("(?i)^(" + "|".join(HEADINGS) + ")$")})
  OR regexp_matches(s, {_re(r"^(Глава\s+\d+\.?\s+.+|\d+\.\d+\.\d+\s+[A-ZА-ЯЁ].+|\d+\.\d+\s+[A-ZА-ЯЁ].+|\d+\.\s+[A-ZА-ЯЁ].+|\d+\s+[A-ZА-ЯЁ][^.!?]{5,180}$)")})
  OR (length(s) BETWEEN 8 AND 120 AND NOT ends_with(s, '.') AND regexp_matches(s, '^[A-ZА-ЯЁ]') AND len(regexp_extract_all(s, '[A-Za-zА-Яа-яЁё0-9_]+')) <= 12 AND {_any("lower(s)", TOPICS)})))"""
ORACLES["section_title_flag"] = f"""WITH {BLOCKS}, x AS (SELECT block_id, {_strip("coalesce(content, '')")} s FROM b) SELECT block_id, {_TITLE} AS is_title FROM x"""
ORACLES["section_detect"] = f"""WITH {BLOCKS}, x AS (SELECT *, {_strip("coalesce(content, '')")} s FROM b), y AS (SELECT *, CASE WHEN "type" IN {_FTYPES} THEN "type" WHEN {_TITLE} THEN 'section' ELSE 'paragraph' END k FROM x WHERE "type" IN {_FTYPES} OR s <> ''),
z AS (SELECT *, last_value(CASE WHEN k = 'section' THEN left(s, 180) END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY pos, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) before FROM y)
SELECT block_id, k AS "type", CASE WHEN k = 'section' THEN left(s, 180) ELSE coalesce(nullif(section, ''), before) END section FROM z"""
_LINES = f"list_transform(list_slice(string_split(t, chr(10)), 1, 30), lambda z: {_strip('z')})"
_ARTICLE = f"""coalesce(CASE WHEN length(title) > 5 AND lower(title) NOT IN ('на правах рукописи', 'title', 'untitled') AND length(regexp_replace(title, '\\s+', ' ', 'g')) > 10 THEN regexp_replace(title, '\\s+', ' ', 'g') END,
  CASE WHEN regexp_matches(t, '\\\\title\\{{.*?\\}}') THEN regexp_extract(t, '\\\\title\\{{(.*?)\\}}', 1) END,
  list_filter({_LINES}, lambda z: length(z) > 20 AND length(z) < 200 AND NOT regexp_matches(z, '(?i)abstract|keywords|doi|received|revised|accepted'))[1], replace(source, '_', ' '))"""
ORACLES["title_extract"] = f"""SELECT doc_id, {_ARTICLE} title_found FROM (SELECT doc_id, coalesce("text", '') t, title, source FROM documents)"""
_HEAD = r"[А-ЯЁA-Z][^.!?]{10,120}"
_SPLITS = [rf"(?s)^({x}){WS}+(.+)$".replace(r"\s", WS) for x in (rf"Глава\s+\d+\.?\s+{_HEAD}", rf"\d+\.\d+\.\d+\s+{_HEAD}", rf"\d+\.\d+\s+{_HEAD}", rf"\d+\.\s+{_HEAD}")]
_CASES = lambda g: "CASE " + " ".join(f"""WHEN "type" = 'paragraph' AND {_strip(f"regexp_extract(content, {_q(p)}, 2)")} <> '' AND length({_strip(f"regexp_extract(content, {_q(p)}, 1)")}) < 160 THEN {_strip(f"regexp_extract(content, {_q(p)}, {g})")}""" for p in _SPLITS) + " END"
ORACLES["split_embedded_sections"] = f"""WITH {BLOCKS}, x AS (SELECT *, {_CASES(1)} t, {_CASES(2)} r FROM b WHERE content IS NOT NULL)
SELECT block_id, CAST(0 AS INT) sub, CASE WHEN t IS NULL THEN "type" ELSE 'section' END "type", coalesce(t, content) "content", coalesce(t, section) section FROM x UNION ALL SELECT block_id, 1, 'paragraph', r, t FROM x WHERE t IS NOT NULL"""
ORACLES["merge_paragraphs"] = f"""WITH {BLOCKS}, e AS (SELECT *, {_strip("coalesce(content, '')")} s FROM b WHERE {_strip("coalesce(content, '')")} <> '' OR {_strip("coalesce(latex, '')")} <> ''),
k AS (SELECT *, CASE WHEN "type" = 'paragraph' AND s <> '' AND regexp_matches(s, '{_FRAG}') THEN 'formula_fragment' ELSE "type" END k FROM e WHERE "type" IN ('paragraph', 'section') OR "type" IN {_FTYPES}),
p AS (SELECT *, lag(s) OVER w ps, lag(k) OVER w pk FROM k WINDOW w AS {_ORDER}),
j AS (SELECT *, CASE WHEN k = 'paragraph' AND pk = 'paragraph' AND s <> '' AND ps <> '' AND ((lower(left(s, 1)) = left(s, 1) AND upper(left(s, 1)) <> left(s, 1)) OR regexp_matches(ps, '(,|;|:|и|или)$')
  OR (NOT regexp_matches(ps, '[.!?:;]$') AND len(list_filter(string_split_regex(s, '{WS}+'), lambda z: z <> '')) > 3)) THEN 0 ELSE 1 END new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY paper_id ORDER BY pos, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) run FROM j)
SELECT paper_id, min(pos) pos, arg_min(k, (pos, block_id)) "type", string_agg(s, ' ' ORDER BY pos, block_id) "content", arg_min(section, (pos, block_id)) FILTER (WHERE nullif(section, '') IS NOT NULL) section, count(*) n FROM r GROUP BY paper_id, run"""
ORACLES["dual_index_fused"] = f"""WITH v AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL), q AS (SELECT vec_id qid, embedding qe, coalesce(title, text, '') query FROM v LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
w AS (SELECT qid, qe, round(0.7 - 0.5 * m, 6) wt, round(0.3 + 0.5 * m, 6) wf FROM (SELECT qid, qe, {_math("query")} m FROM q)),
s AS (SELECT qid, vec_id, wt, wf, CASE WHEN label % 2 = 0 THEN 'text' ELSE 'formula' END side, round(list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) raw FROM w, v),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY raw DESC, vec_id) r FROM s), u AS (SELECT qid, vec_id, side, round(raw * CASE side WHEN 'text' THEN wt ELSE wf END, 9) score FROM k WHERE r <= 30 AND raw > 0)
SELECT qid, vec_id, side, score, CAST("rank" AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id, side) AS "rank" FROM u) WHERE "rank" <= 10"""
_LT = lambda x: f"""list_distinct(list_filter(regexp_extract_all({_LINK.format(x)}, '[a-zа-я0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({", ".join(map(_q, LINK_STOP))})))"""
_CTEXT = "concat_ws(' ', content, section, CAST(to_json(citation) AS VARCHAR))"
ORACLES["link_formulas"] = f"""WITH {CHUNKS}, cc AS (SELECT chunk_id, {_strip(f"regexp_replace({_LINK.format(_CTEXT)}, '{WS}+', ' ', 'g')")} t, {_LT(_CTEXT)} ct, {_LT("section")} st, coalesce(pages, []) cp FROM c WHERE content IS NOT NULL),
k AS (SELECT id, lower(number) num, coalesce(nullif(page, 0), try_cast(nullif(regexp_extract(lower(coalesce(context, '')), '(стр\\.?|страница|page)\\s*\\.?\\s*(\\d+)', 2), '') AS INT)) fp,
  {_LT("concat_ws(' ', id, number, latex, description, context, array_to_string(map_keys(variables), ' '), array_to_string(map_values(variables), ' '))")} kt, {_LT("description")} dt, {_LT("latex")} lt, {_LT("context")} xt FROM formula_kb),
p AS (SELECT chunk_id, id, len(list_intersect(kt, ct)) a, len(list_intersect(xt, st)) s, len(list_intersect(dt, ct)) e, len(list_intersect(lt, ct)) l, coalesce(num, '') <> '' AND contains(t, num) nn,
  coalesce(list_contains(cp, fp), false) sp, len(list_filter(cp, lambda z: abs(z - fp) <= 1)) > 0 np FROM cc, k),
z AS (SELECT chunk_id, id, round((least(a * 0.8::DOUBLE, 8.0::DOUBLE) + CASE WHEN nn THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN sp THEN 6.0::DOUBLE WHEN np THEN 2.5::DOUBLE ELSE 0 END + least(s * 1.0::DOUBLE, 4.0::DOUBLE) + least(e * 0.7::DOUBLE, 5.0::DOUBLE) + least(l * 0.6::DOUBLE, 3.0::DOUBLE)), 3) link_score,
  concat_ws(',', CASE WHEN a > 0 THEN 'keyword_overlap:' || a END, CASE WHEN nn THEN 'formula_number' END, CASE WHEN sp THEN 'same_page' WHEN np THEN 'near_page' END, CASE WHEN s > 0 THEN 'section_overlap:' || s END, CASE WHEN e > 0 THEN 'description_overlap:' || e END, CASE WHEN l > 0 THEN 'latex_overlap:' || l END) reasons FROM p)
SELECT chunk_id, id, link_score, reasons, CAST(r AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY link_score DESC, id) r FROM z WHERE link_score >= 4) WHERE r <= 5"""
_QS = "q AS (SELECT doc_id qid, coalesce(title, text, '') query FROM documents WHERE doc_id % 100 = 0)"
_ANYWORD = lambda c: f"len(list_filter(string_split_regex(lower(coalesce({c}, '')), '{WS}+'), lambda w: w <> '' AND contains(lower(query), w))) > 0"
ORACLES["kb_text_search"] = f"""WITH {_QS}, s AS (SELECT qid, id, CASE WHEN coalesce(number, '') <> '' AND contains(lower(query), lower(number)) THEN 10 ELSE 0 END + CASE WHEN {_ANYWORD("description")} THEN 5 ELSE 0 END + CASE WHEN {_ANYWORD("context")} THEN 3 ELSE 0 END
  + 2 * len(list_filter(map_entries(coalesce(variables, MAP {{}})), lambda e: contains(lower(query), lower(e.key)) OR contains(lower(query), lower(coalesce(e.value, '')))))
  + CASE WHEN coalesce(latex, '') <> '' AND contains(regexp_replace(lower(latex), '[^a-z0-9]', '', 'g'), regexp_replace(lower(query), '[^a-z0-9]', '', 'g')) THEN 4 ELSE 0 END score FROM q, formula_kb)
SELECT qid, id, CAST(score AS BIGINT) score, CAST(r AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) r FROM s WHERE score > 0) WHERE r <= 5"""
_TOKQ = TOK.format("query")
ORACLES["rerank_topk"] = f"""WITH {BM25}, {HITS}, m AS (SELECT h.qid, h.doc_id id, list_distinct({TOK.format("q.query")}) a, {TOK.format("d.text")} b FROM h JOIN q USING (qid) JOIN documents d ON d.doc_id = h.doc_id WHERE "rank" <= 30 AND score > 0),
z AS (SELECT qid, id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) score FROM m)
SELECT qid, id, score, CAST(r AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) r FROM z) WHERE r <= 5"""
ORACLES["dense_dedup_by_chunk"] = f"""WITH u AS ({ORACLES["dual_index_fused"]}), b AS (SELECT qid, vec_id // 10 AS chunk, max(score) score FROM u GROUP BY ALL)
SELECT qid, CAST(chunk AS BIGINT) chunk, score, CAST(r AS INT) AS "rank" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk) r FROM b) WHERE r <= 10"""
ORACLES["latex_blocks"] = f"""WITH {CHUNKS}, x AS (SELECT chunk_id, replace(replace(replace(replace(regexp_replace(translate(content, chr(61690) || chr(61691) || chr(61673) || chr(61674) || chr(61675) || chr(61676), ''), '\\(cid:\\d+\\)', '', 'g'), chr(160), ' '), chr(61472), ' '), chr(8203), ''), chr(65279), '') t FROM c WHERE content IS NOT NULL),
f AS (SELECT chunk_id, unnest(flatten([regexp_extract_all(t, '(?s)\\$\\$(.*?)\\$\\$', 1), regexp_extract_all(t, '\\$(.*?)\\$', 1), regexp_extract_all(t, '(?s)\\\\\\[(.*?)\\\\\\]', 1), regexp_extract_all(t, '(?s)\\\\begin\\{{equation\\}}(.*?)\\\\end\\{{equation\\}}', 1),
  regexp_extract_all(t, '(?s)\\\\begin\\{{align\\}}(.*?)\\\\end\\{{align\\}}', 1), regexp_extract_all(t, '(?s)\\\\begin\\{{multline\\}}(.*?)\\\\end\\{{multline\\}}', 1)])) v, generate_subscripts(flatten([regexp_extract_all(t, '(?s)\\$\\$(.*?)\\$\\$', 1), regexp_extract_all(t, '\\$(.*?)\\$', 1), regexp_extract_all(t, '(?s)\\\\\\[(.*?)\\\\\\]', 1), regexp_extract_all(t, '(?s)\\\\begin\\{{equation\\}}(.*?)\\\\end\\{{equation\\}}', 1),
  regexp_extract_all(t, '(?s)\\\\begin\\{{align\\}}(.*?)\\\\end\\{{align\\}}', 1), regexp_extract_all(t, '(?s)\\\\begin\\{{multline\\}}(.*?)\\\\end\\{{multline\\}}', 1)]), 1) i FROM x),
g AS (SELECT chunk_id, {_strip("v")} latex, i, regexp_replace({_strip("v")}, '\\s+', '', 'g') k FROM f)
SELECT chunk_id, latex FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, k ORDER BY i) r FROM g WHERE k <> '') WHERE r = 1"""
ORACLES["kb_similar"] = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id qid, v.vec_id id, list_cosine_similarity(q.e, v.e) c FROM v q, v WHERE q.vec_id % 100 = 0 AND v.vec_id % 100 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 6) DESC, id) r FROM s) SELECT qid, id, round(c, 4) score, CAST(r AS INT) AS "rank" FROM k WHERE r <= 5 AND c >= 0"""
ORACLES["search_text"] = """WITH b AS (SELECT block_id, any_value(content) "content", any_value(formulas) fs FROM blocks GROUP BY block_id HAVING len(any_value(formulas)) > 0),
f AS (SELECT block_id, unnest(fs) f, generate_subscripts(fs, 1) i FROM b),
k AS (SELECT *, lower(regexp_replace(coalesce(nullif(f.id, ''), nullif(f.latex, ''), nullif(f.description, ''), nullif(f.raw, '')), '\\s+', '', 'g')) k FROM f),
u AS (SELECT block_id, i, f FROM (SELECT *, row_number() OVER (PARTITION BY block_id, k ORDER BY i) r FROM k WHERE k IS NOT NULL) WHERE r = 1),
l AS (SELECT block_id, i, list_concat([f.description, f.semantic_description, f.latex], flatten(list_transform(list_sort(map_keys(coalesce(f.variables, MAP {}))), lambda n: [n, f.variables[n]]))) s FROM u),
t AS (SELECT block_id, list(s ORDER BY i) s FROM l GROUP BY block_id)
SELECT b.block_id, array_to_string(list_filter(list_concat([content], coalesce(flatten(t.s), [])), lambda z: z IS NOT NULL AND z <> ''), chr(10)) search_text FROM b LEFT JOIN t USING (block_id)"""
