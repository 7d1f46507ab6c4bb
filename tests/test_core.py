"""The retrieval engine's operators on hand-worked cases."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.functions import formulas as fx
from folioflow.functions import metadata as md
from folioflow.functions import text as tx
from folioflow.operators import answer, blocks, chunking, kb, retrieval
from folioflow.plans import queries
from folioflow.sources import readers
from folioflow.streaming import ingest


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("q, score", [("Какое уравнение описывает перенос ионов?", 0.2), ("Что такое потенциал Доннана?", 0.1), ("Что такое электроконвекция?", 0.0), (None, 0.0), ("∂C/∂t = div j", 0.6)])
def test_math_score(spark, q, score):
    assert one(spark, q, tx.math_score) == pytest.approx(score)


def test_tokens(spark):
    assert one(spark, "C_1=k_d·C и Ёж, well-known", tx.search_tokens) == ["c_1=k_d", "c", "и", "ёж", "well-known"]
    assert one(spark, None, tx.search_tokens) == []


def test_clean_text(spark):
    assert one(spark, "  со-\nль  (cid:12)и\n\n\n\nток – 5​§ ", tx.clean_text) == "соль и\n\nток - 5"
    assert one(spark, None, tx.clean_text) == ""


@pytest.mark.parametrize("t, yes", [("Введение", True), ("ВВЕДЕНИЕ", True), ("2.1 Постановка задачи", True), ("Ток растёт.", False), ("", False), (None, False), ("x" * 300, False)])
def test_titles(spark, t, yes):
    assert one(spark, t, tx.title_flag) is yes


def test_formula_functions(spark):
    assert one(spark, "j = -D", fx.score) == pytest.approx(0.6)
    assert one(spark, "C_1 = 2", fx.score) == pytest.approx(1.0)
    once = one(spark, "∂C/∂t = div j", fx.normalize)
    assert once == r"\partial C/\partial t = \operatorname{div} j"
    assert one(spark, once, fx.normalize).endswith(r"\operatorname{\operatorname{div}} j")
    assert one(spark, "a $$x=1$$ b \\[y\\]", fx.latex_parts)[:1] == ["x=1"]
    assert one(spark, r"\frac C_1 \lambda + C_1", fx.variables) == ["C_1", "lambda"]
    assert one(spark, "OH-", fx.fragment_flag) and one(spark, "12", fx.garbage_flag) and one(spark, "CEM_1", fx.chunk_garbage_flag)
    assert one(spark, "j_i = 2", fx.semantic_label).startswith("поток ионов")
    assert one(spark, None, fx.semantic_label) == ""
    assert not one(spark, "https://x = 1", fx.valid) and one(spark, "C_1 = 2", fx.valid)


def test_metadata(spark):
    assert one(spark, "Received 2019, published 2021", md.year) == "2021"
    assert one(spark, "Иванов Иван Иванович", md.author) == "Иванов И.И."
    assert one(spark, "J.K. Smith", md.author) == "Smith J.K."
    df = spark.createDataFrame([(["Иванов Иван Иванович", "Иванов И.И.", "x@y.ru", "Институт мостов"],)], "a array<string>")
    assert df.select(md.authors("a")).first()[0] == ["Иванов И.И."]
    thesis = "На правах рукописи\nПетров Пётр Петрович\nПеренос ионов соли в мембранных\nсистемах с током\nСпециальность 05\nДиссертация"
    assert one(spark, thesis, md.thesis_author) == "Петров Пётр Петрович"


def _list(spark, ids):
    return spark.createDataFrame([(1, i, r + 1) for r, i in enumerate(ids)], "qid int, id string, rank int")


def test_fusion(spark):
    a, b = _list(spark, "abc"), _list(spark, "bd")
    got = {r["id"]: r["score"] for r in retrieval.rrf(a, b, 10).collect()}
    assert got == {"b": 0.032522, "a": 0.016393, "d": 0.016129, "c": 0.015873}
    assert got == {r["id"]: r["score"] for r in retrieval.rrf(b, a, 10).collect()}
    w = {r["id"]: r["score"] for r in retrieval.weighted(a, b, 10).collect()}
    assert w == {"b": 0.7, "a": 0.6125, "d": 0.21875, "c": 0.2125}


def test_bm25_and_dense(spark, tmp_path):
    docs = spark.createDataFrame([(1, "соль и ток"), (2, "ток ток мембрана"), (3, "вода"), (4, None), (5, "")], "doc_id long, text string")
    index = retrieval.lexical_index(docs, "doc_id", F.col("text"))
    q = spark.createDataFrame([(1, "мембрана"), (2, "нет"), (3, "")], "qid int, query string")
    assert [(r["qid"], r["id"]) for r in retrieval.bm25(index, q, 3).collect()] == [(1, 2)]
    index.save(str(tmp_path / "i"))
    again = retrieval.LexicalIndex.load(spark, str(tmp_path / "i"))
    assert retrieval.bm25(again, q, 3).collect() == retrieval.bm25(index, q, 3).collect()
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "id long, vec array<float>")
    hits = retrieval.dense(v, v.select(F.col("id").alias("qid"), "vec"), 1).collect()
    assert {(r["qid"], r["id"], r["score"]) for r in hits} == {(i, i, 1.0) for i in range(4)}


def _blocks(spark, rows):
    return spark.createDataFrame([("p", i, i, t, c, None, 1, None, None) for i, (t, c) in enumerate(rows)], "paper_id string, pos int, block_id int, type string, content string, latex string, page int, section string, label string")


def test_blocks(spark):
    b = _blocks(spark, [("paragraph", "Ток растёт"), ("paragraph", "при росте потенциала."), ("paragraph", "Новый."), ("paragraph", "Новый."), ("section", "Литература"), ("paragraph", "[1]")])
    assert [r["content"] for r in blocks.merge_paragraphs(b).orderBy("pos").collect()][0] == "Ток растёт при росте потенциала."
    assert blocks.drop_repeated(b).count() == 5 and blocks.cut_references(b).count() == 4
    assert blocks.forward_fill(b).where("section = 'Литература'").count() == 2
    s = blocks.split_sections(_blocks(spark, [("paragraph", "2.1 Постановка общей задачи переноса\nТок растёт.")])).orderBy("sub").collect()
    assert [(r["type"], r["content"]) for r in s] == [("section", "2.1 Постановка общей задачи переноса\nТок"), ("paragraph", "растёт.")]
    d = blocks.detect_sections(_blocks(spark, [("paragraph", "Введение"), ("formula", None), ("paragraph", " "), ("table", "x")])).orderBy("pos").collect()
    assert [(r["type"], r["section"]) for r in d] == [("section", "Введение"), ("formula", "Введение"), ("paragraph", "Введение")]
    m = blocks.merge_paragraphs(_blocks(spark, [("paragraph", "Ток и"), ("table", "x"), ("paragraph", "Ещё"), ("paragraph", "OH-"), ("paragraph", "конец.")])).orderBy("pos").collect()
    assert [(r["type"], r["content"]) for r in m] == [("paragraph", "Ток и Ещё"), ("formula_fragment", "OH-"), ("paragraph", "конец.")]


@pytest.mark.parametrize("span", [4096, 2])
def test_equations(spark, monkeypatch, span):
    from folioflow.operators import ordering

    monkeypatch.setattr(ordering, "SPAN", max(span, 4))
    # paragraphs along a chain explain and introduce in turn; a formula without a paragraph stands alone
    kinds = ["paragraph", "formula", "formula_label", "paragraph", "formula", "formula_label", "paragraph", "formula_candidate", "formula_label", "paragraph", "section", "paragraph", "formula", "formula", "equation_block", "paragraph"]
    got = {r["pos"]: (r["type"], r["label"], r["context_before"], r["description"]) for r in blocks.merge_equations(_blocks(spark, [(k, f"t{i}") for i, k in enumerate(kinds)])).collect()}
    assert got == {
        1: ("equation_block", "t2", "t0", "t3"), 4: ("equation_block", None, "", ""), 5: ("formula_label", None, None, None), 7: ("equation_block", "t8", "t6", "t9"), 10: ("section", None, None, None),
        12: ("equation_block", None, "t11", ""), 13: ("equation_block", None, "", ""), 14: ("equation_block", None, None, None), 15: ("paragraph", None, None, None),
    }


def test_order_in_buckets(spark, monkeypatch):
    from folioflow.operators import ordering

    rng = random.Random(6)
    rows = [(f"p{rng.randrange(3)}", rng.randrange(40), i, rng.choice([None, "a", "b"])) for i in range(120)]
    df = spark.createDataFrame(rows, "paper_id string, pos int, block_id int, v string")
    want, n, last = {}, {}, {}
    for p, _, i, v in sorted(rows, key=lambda r: r[:3]):
        before = last.get((p, "id"))
        n[p] = n.get(p, 0) + 1
        last[p] = v or last.get(p)
        last[p, "id"] = i
        want[i] = (n[p], last[p], before)
    monkeypatch.setattr(ordering, "SPAN", 5)
    out = ordering.beside(ordering.carried_last(ordering.indexed(df), "last", F.col("v")), {"before": F.lag("block_id").over(ordering.nearby())}, 2)
    assert {r["block_id"]: (r["rn"], r["last"], r["before"]) for r in out.collect()} == want


def test_chains(spark):
    b = _blocks(spark, [("paragraph", "Введение"), ("paragraph", "Ток растёт и"), ("paragraph", "падает."), ("formula", None), ("paragraph", "1. Математическая модель задачи Ток"), ("paragraph", "1. Математическая модель задачи Ток")]).withColumn("latex", F.when(F.col("pos") == 3, "x = 1"))
    got = [(r["type"], r["content"], r["section"]) for r in blocks.clean_blocks(b).orderBy("pos").collect()]
    name = "1. Математическая модель задачи"
    assert got == [("section", "Введение", "Введение"), ("paragraph", "Ток растёт и падает.", "Введение"), ("formula", "", "Введение"), ("section", name, name), ("paragraph", "Ток", name), ("section", name, name), ("paragraph", "Ток", name)]
    assert blocks.normalize_blocks(b).where("type = 'equation_block'").count() == 1
    lay = spark.createDataFrame([("p", 1, 0, "a", 0.0, 0.0, 9.0, 10.0), ("p", 1, 1, "b", 5.0, 12.0, 9.0, 20.0), ("p", 1, 2, "c", 5.0, 90.0, 9.0, 99.0)], "paper_id string, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in blocks.merge_layout(lay).orderBy("pos").collect()] == ["a b", "c"]


@pytest.mark.parametrize("parts", [1, 8])
def test_pack(spark, parts):
    b = _blocks(spark, [("paragraph", "а" * 800), ("paragraph", "б" * 600), ("paragraph", "в" * 200)]).repartition(parts)
    got = chunking.pack(b).collect()
    assert [len(r["content"]) for r in got] == [1402] and got[0]["chunk_id"].startswith("p_")
    rng = random.Random(1)
    big = _blocks(spark, [("paragraph", " ".join("слово" + "." * (rng.random() < 0.1) for _ in range(rng.randrange(1, 400)))) for _ in range(40)])
    assert all(300 <= len(r["content"]) for r in chunking.pack(big).collect())
    assert chunking.split_sentences("Аб. Вг. Де.", 8, 2) == ["Аб. Вг.", "г. Де."]


def test_pack_formulas(spark):
    f = lambda i, latex, d=None: (i, None, latex, "raw", d, None, {"C_1": "соль"}, None, None, None, None, None, "formula", None, None)
    rows = [
        (0, "paragraph", "Короткий.", None, None, "A", [f("a", "∂C = 1", "поток"), f("n", "NaCl")]), (1, "paragraph", "Кратко.", None, None, "B", []), (2, "equation_block", "не читается", "C_1 = 2", "(7)", "C", []),
        (3, "formula", None, "j_i = -D", "(8)", "C", [f("x", "y = 1")]), (4, "formula_candidate", "z_i = 3", None, None, "C", []), (5, "formula", None, "NaCl", None, "C", []), (6, "formula_fragment", "x = 1", None, None, "C", []), (7, "table", "y" * 400, None, None, "C", []),
        (8, "paragraph", None, None, None, "D", [f("b", "k_d = 4"), f("b", "k_d = 4")]), (9, "equation_block", None, "x", None, "E", [f("e", None)]), (10, "paragraph", "Ток. " * 400, None, None, "F", [f("g", "pH = 7")]),
    ]
    schema = f"paper_id string, pos int, block_id int, type string, content string, latex string, page int, section string, label string, formulas array<{chunking.FORMULA}>"
    heads = {sec: i for i, *_, sec, _ in reversed(rows)}
    df = spark.createDataFrame([("p", 2 * i + 1, i, t, c, x, 1, sec, lab, fs) for i, t, c, x, lab, sec, fs in rows] + [("p", 2 * i, 100 + i, "section", sec, None, 1, None, None, []) for sec, i in heads.items()], schema)
    got: dict = {}
    for r in chunking.pack(df).orderBy("part", "n").collect():
        got.setdefault(r["section"], []).append((r["content"], [(x["id"], x["number"], x["latex"]) for x in r["formulas"]]))
    assert {k: got[k] for k in "ACD"} == {
        "A": [("Короткий.", [("a", None, r"\partial C = 1")])], "D": [("", [("b", None, "k_d = 4")])],
        "C": [("Формула: C_1 = 2 (7)\n\nФормула: j_i = -D (8)\n\nФормула: z_i = 3", [(None, "(7)", "C_1 = 2"), (None, "(8)", "j_i = -D"), (None, None, "z_i = 3")])],
    }
    assert set(got) == set("ACDF") and len(got["F"]) == 2 and all(x[1] == [("g", None, "pH = 7")] for x in got["F"])
    a = chunking.pack(df).where("section = 'A'").first()["formulas"][0]
    assert (a["description"], a["semantic_description"], a["confidence"], a["page"], a["variables"]) == ("поток", "поток", 0.5, 1, {"C_1": "соль"})
    e = df.where("block_id = 2").withColumns({"context_before": F.lit("До."), "description": F.lit("где C_1"), "semantic_description": F.lit("смысл")})
    assert chunking.pack(e).first()["content"] == "До.\nФормула: C_1 = 2 (7)\nгде C_1\nСмысл формулы: смысл"


def test_kb(spark):
    k = spark.createDataFrame([("f1", "(1)", "C_1", "поток ионов", "", {"C_1": "соль"}, None), ("f2", "(2)", "", "вода", "", {}, 3)], "id string, number string, latex string, description string, context string, variables map<string,string>, page int")
    q = spark.createDataFrame([(1, "тема")], "qid int, query string")
    assert [(r["id"], r["score"]) for r in kb.search(k, q).collect()] == [("f1", 4)] and kb.search(k, q, strict=True).count() == 0
    f = spark.createDataFrame([("C_1", "a", 1, 0.5, "1"), ("c_{1}", "b", 2, 0.7, "2"), ("x", "a", 1, 0.1, "3")], "latex string, source string, page int, score double, pos string")
    u = {r["canonical"]: r for r in kb.upsert(f).collect()}
    assert u["C_1"]["variants"] == ["C_1", "c_{1}"] and u["C_1"]["score"] == 0.7 and len(u) == 2
    c = spark.createDataFrame([("c", "поток ионов через слой, поток (1)", "поток ионов", [1])], "chunk_id string, content string, section string, pages array<int>")
    assert [r["id"] for r in kb.link(c, k).collect()] == ["f1"]


def test_sources(spark, tmp_path):
    (tmp_path / "a_chunks.json").write_text(json.dumps([{"content": "один", "citation": {"paper_id": "p", "pages": "12"}}, {"content": " "}]))
    (tmp_path / "b_chunks.json").write_text(json.dumps({"data": [{"content": "два"}]}))
    (tmp_path / "c_chunks.json").write_text('[{"content": "x"} // no\n]')
    files = readers.chunk_files(spark, str(tmp_path))
    assert files.where("error IS NOT NULL").count() == 1
    got = {r["content"]: r for r in readers.ready_chunks(files).collect()}
    assert set(got) == {"один", "два"} and got["два"]["source"] == "b" and got["один"]["chunk_id"].startswith("p_")
    xml = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title><author>A</author><date when="2020"/></teiHeader><text><body><div><head>H</head><p n="4">x<formula tex="a=b">f</formula></p></div></body></text></TEI>'
    tei = readers.tei_blocks(spark.createDataFrame([("p", xml), ("q", "<broken")], "paper_id string, xml string")).orderBy("pos").collect()
    assert [r["type"] for r in tei] == ["title", "authors", "publication_date", "section", "paragraph", "formula"] and tei[5]["latex"] == "a=b"
    (tmp_path / "x.pdf").write_bytes(b"data")
    f = readers.binary_files(spark, str(tmp_path))
    assert readers.not_cached(f, f).count() == 0
    assert readers.layout_blocks(f, lambda data, path: [(1, 0, "text", 0.0, 0.0, 1.0, 1.0), (1, 1, " 12 ", 0.0, 0.0, 1.0, 1.0)]).count() == 1
    assert readers.layout_blocks(f, lambda data, path: 1 / 0).first()["error"].startswith("ZeroDivisionError")
    assert readers.load_table(spark, str(tmp_path), "none", "a int").count() == 0


def test_answer(spark):
    q = spark.createDataFrame([(1, "вопрос"), (2, "другой")], "qid int, query string")
    hits = spark.createDataFrame([(1, "a", 2.0, 1, "Первое. Второе.", "S"), (1, "a", 1.0, 2, "x", "S"), (1, "b", 0.5, 3, "y", "S")], "qid int, id string, score double, pos int, content string, source string")
    ev = answer.evidence(hits, 3)
    assert ev.count() == 2
    got = {r["qid"]: r["answer"] for r in answer.answers(q, answer.context(ev)).collect()}
    assert got == {1: "Первое.", 2: answer.NOTHING}


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, content string").withColumn("at", F.timestamp_seconds("id"))
    src.write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.parquet_stream(spark, str(tmp_path / "in"), src.schema, "at"), lambda d: d.select("content"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("content").collect()) == ["a", "b"]


def test_files_to_answers(spark, tmp_path):
    from folioflow.operators import indexing

    (tmp_path / "in").mkdir()
    text = "The limiting current of the membrane grows with the flow. " * 9
    (tmp_path / "in" / "a.pdf").write_bytes(text.encode())
    (tmp_path / "in" / "b.pdf").write_bytes(b"bad")

    def parser(data, path):
        if data == b"bad":
            raise ValueError("no file")
        return [(1, 0, "Membranes and limiting currents in cells 2019", 0.0, 0.0, 9.0, 9.0), (1, 1, data.decode().strip(), 0.0, 90.0, 9.0, 99.0), (1, 2, "j_i = -D_i C_i", 0.0, 190.0, 9.0, 199.0)]

    q = spark.createDataFrame([("q", "limiting current of the membrane")], "qid string, query string")
    for _ in range(2):
        index = indexing.index_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), parser=parser)
        rows = index.chunks.collect()
        assert len(rows) == 1 and rows[0]["year"] == "2019" and rows[0]["title"].startswith("Membranes") and [f["latex"] for f in rows[0]["formulas"]] == ["j_i = -D_i C_i"]
        assert [r["error"] for r in spark.read.parquet(str(tmp_path / "out" / "failed")).collect()] == ["ValueError: no file"]
    # in an index of one document every idf is negative, so the lexical list is empty
    for mode, n in (("dense", 1), ("bm25", 0), ("weighted", 1), ("rrf", 1)):
        assert index.search(q, 3, mode).count() == n
    assert "limiting current" in index.answers(q).first()["answer"]


def test_ready_chunks_to_index(spark, tmp_path):
    from folioflow.operators import indexing

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x_chunks.json").write_text(json.dumps([{"content": "Ток растёт.", "citation": {"title": "Т", "authors": ["А"], "year": "2020"}}]))
    (tmp_path / "in" / "y_chunks.json").write_text("[")
    index = indexing.index_ready_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    q = spark.createDataFrame([("q", "ток")], "qid string, query string")
    assert index.search(q, 3, "dense").count() == 1 and spark.read.parquet(str(tmp_path / "out" / "failed")).count() == 1


def test_similar_formulas(spark):
    base = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "id string, vec array<float>")
    new = spark.createDataFrame([("n", [0.1, 3.0]), ("m", [1.0, 1.0])], "qid string, vec array<float>")
    assert {(r["qid"], r["id"]) for r in kb.merge_similar(base, new, 0.88).collect()} == {("n", "b"), ("m", None)}


def _shuffled(df):
    """Rows that each shuffle of an executed plan has written."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
        if kind == "ShuffleExchangeExec":
            out.append(p.metrics().apply("shuffleRecordsWritten").value())
    return out


def _many(spark, n=400):
    docs = spark.createDataFrame([(i, f"common word code{i % 50} " + "filler " * (i % 7)) for i in range(n)], "doc_id long, text string").repartition(4).persist()
    return docs, spark.createDataFrame([(i, f"common code{i} common") for i in range(40)], "qid long, query string").persist()


def test_bm25_shuffles_no_pairs(spark):
    docs, q = _many(spark)
    hits = retrieval.bm25(retrieval.lexical_index(docs, "doc_id", F.col("text")), q, 3)
    assert sum(_shuffled(hits)) <= 40 * 3 * 4 * 2  # 16,000 pairs of question and document share a word


def _brute(docs, questions, k):
    """docs: (id, text) as Okapi's formula says it, an id that comes twice is one document to rank."""
    texts = [(i, t.split()) for i, t in docs]
    n, mean = len(texts), sum(len(t) for _, t in texts) / len(texts)
    df = Counter(w for _, t in texts for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for qid, query in questions:
        score = Counter()
        for i, t in texts:
            for w in query.split():
                if tf := t.count(w):
                    score[i] += (raw[w] if raw[w] >= 0 else floor) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
        best = sorted((-round(x, 6), i) for i, x in score.items() if round(x, 6) > 0)[:k]
        out += [(qid, i, -x, r) for r, (x, i) in enumerate(best, 1)]
    return sorted(out)


def test_bm25_blocks_rounds_and_saved(spark, tmp_path, monkeypatch):
    docs, q = _many(spark)
    want = _brute([tuple(r) for r in docs.collect()], [tuple(r) for r in q.collect()], 5)
    index = retrieval.lexical_index(docs, "doc_id", F.col("text"))
    got = lambda i: sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in retrieval.bm25(i, q, 5).collect())
    assert got(index) == want and len(want) == 200
    monkeypatch.setattr(retrieval, "MAX_ASKED", 30)  # three rounds
    assert got(index) == want
    index.save(str(tmp_path / "i"))
    assert got(retrieval.LexicalIndex.load(spark, str(tmp_path / "i"))) == want


def test_bm25_ids_twice_and_nothing(spark):
    rows = [(1, "a b"), (1, "a c d"), (2, "a x y z"), (3, "e f"), (4, "g h i"), (5, "j k"), (6, ""), (7, "l m")]
    docs, q = spark.createDataFrame(rows, "doc_id long, text string"), [(1, "a b"), (2, "m"), (3, "nowhere")]
    index = retrieval.lexical_index(docs, "doc_id", F.col("text"))
    hits = retrieval.bm25(index, spark.createDataFrame(q, "qid long, query string"), 5).collect()
    assert sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in hits) == _brute(rows, q, 5)
    assert retrieval.bm25(index, spark.createDataFrame([], "qid long, query string"), 5).count() == 0
    empty = retrieval.lexical_index(docs.where("false"), "doc_id", F.col("text"))
    assert retrieval.bm25(empty, spark.createDataFrame(q, "qid long, query string"), 5).count() == 0


def _repeated(spark, tmp_path):
    """2,000 ids of two documents of 30 words each; 20 questions share words with all."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ")
    docs = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.concat(words, F.lit(" code"), F.col("id").cast("string"), F.lit(". More.")).alias("text"))
    docs = docs.select("doc_id", "text", F.concat(words, F.lit(" code"), F.col("doc_id").cast("string")).alias("title"), F.lit("src").alias("source"), F.lit(2020).alias("year"))
    docs.unionByName(docs).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_answer_batch_ids_twice_shuffles_no_postings(spark, tmp_path):
    d = _repeated(spark, tmp_path)
    # the search of answer_batch, whose own plan begins after it
    assert sum(_shuffled(queries.queries()["bm25_topk_batch"](spark, d))) < 15_000  # there are 60,000 postings of terms asked for
    assert {r["qid"] for r in queries.queries()["answer_batch"](spark, d).collect()} == set(range(100, 2001, 100))


def test_bm25_ids_twice_packed(spark, monkeypatch):
    # as long as each other or not, in several blocks; no length is met twice with another text of the id
    rows = [(i % 60, f"common word code{i % 50} " + "filler " * (i // 60)) for i in range(400)] + [(None, "common code3"), (None, "code3 a b c")]
    docs, q = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).persist(), [(i, f"common code{i} filler common") for i in range(40)]
    monkeypatch.setattr(retrieval, "DOCS", 64)
    index = retrieval.lexical_index(docs, "doc_id", F.col("text"))
    asked = spark.createDataFrame(q, "qid long, query string")
    got = lambda i: {(r["qid"], r["id"], r["score"]) for r in retrieval.bm25(i, asked, 100).collect()}
    index.tokens, tokens = None, index.tokens
    index.totals.persist()
    saved = got(index)
    index.tokens = tokens
    assert got(index) == saved and len(saved) == 40 * 61
    want = _brute([(-1 if i is None else i, t) for i, t in rows], q, 100)
    assert sorted((a, -1 if i is None else i, s) for a, i, s in saved) == sorted(x[:3] for x in want)


def test_bm25_hits_shuffled_follow_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common code"), F.col("id").cast("string")).alias("text")).repartition(80).persist()
    q = spark.range(200).select(F.col("id").alias("qid"), F.concat(F.lit("common code"), F.col("id").cast("string")).alias("query"))
    hits = retrieval.bm25(retrieval.lexical_index(docs, "doc_id", F.col("text")), q, 10)
    assert sum(_shuffled(hits)) <= retrieval.HITS * 4000 * 1.5  # 80 tasks would give 10 for each of 200 questions
    assert [r["id"] for r in hits.where("rank = 1").orderBy("qid").collect()] == list(range(200))


def test_rerank_shuffles_documents_hit_only(spark, monkeypatch):
    docs = spark.range(5000).select("id", F.concat(F.lit("word"), "id").alias("content"))
    hits = spark.createDataFrame([(q, 10 * q + i) for q in range(3) for i in range(4)], "qid long, id long")
    q = spark.createDataFrame([(i, f"word{10 * i + 2} other") for i in range(3)], "qid long, query string")
    # bounds of broadcasts for a corpus far larger than this one: the join of texts is by shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = retrieval.rerank(hits, q, docs, 1)
        assert sum(_shuffled(df)) < 200
        want = [(i, 10 * i + 2, 0.5, 1) for i in range(3)]
        rows = lambda x: sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in x.collect())
        assert rows(df) == want
        monkeypatch.setattr(retrieval, "MAX_HITS", 2)
        assert rows(retrieval.rerank(hits, q, docs, 1)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["evidence_dedup_top", "build_context", "answer_batch", "hyde_multi_query_rrf"])
def test_batches_shuffle_no_pairs(spark, tmp_path, name):
    """20 questions share a word with each of 2,000 documents."""
    t = F.concat(F.lit("common word code"), F.col("doc_id").cast("string"), F.lit(". More text."))
    docs = spark.range(1, 2001).select(F.col("id").alias("doc_id"), F.lit(2020).alias("year"), F.lit("src").alias("source"))
    docs.withColumn("text", t).withColumn("title", F.concat(F.lit("common code"), F.col("doc_id"))).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.queries()[name](spark, str(tmp_path))
    assert 0 < sum(_shuffled(df)) < 12_000
    got = {r["qid"]: r.asDict() for r in df.collect() if r.asDict().get("rank", 1) == 1}
    assert set(got) == set(range(100, 2001, 100))
    for q, r in got.items():
        assert r.get("doc_id", q) == q and r.get("id", q) == q
        assert r.get("answer", f"common word code{q}.") == f"common word code{q}."
        assert r.get("context", "[1] ").startswith("[1] ") and f"common code{q}\n" in r.get("context", f"common code{q}\n")
