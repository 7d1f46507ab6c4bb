"""The text operators against brute force, round trips and small hand-made cases."""

import random
import re

import pytest

from folioflow.llm import bpe, homoglyphs, langid, markup, names, neardup, packing, scans, sentences, spans

TOKENIZER = f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json"


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- 8


def test_bpe_same_as_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = ["", "  a", "a  ", "\n\n a\n", "it's 'sam we'll'' 'll", "x''s", " \t b", "हिन्दी में ²x ½ 123abc", "don't  \n  ok  z", "'", "''re", "a's's", "Ток 0,5 мА/см² при рН≈7", "电流密度。", "<|endoftext|>", "a" * 300, "\u00a0\u2003x"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab 'st\nё2²-_é中") for _ in range(60)) for _ in range(300)]
    e = bpe.Encoder(bpe.Vocabulary(bpe.load_vocabulary(TOKENIZER)))
    ids, counts = e.encode(texts)
    at = 0
    for x, n in zip(t.encode_batch(texts, add_special_tokens=False), counts.tolist()):
        assert ids[at : at + n].tolist() == x.ids
        at += n


def test_bpe_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", "z")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 2
    assert bpe.encode(df.where("doc_id < 0")).count() == 0


# ---------------------------------------------------------------- 7


def test_homoglyphs(spark):
    cases = {
        "a": ("ｔｈe ９.3", "the 9.3", {"fullwidth"}), "b": ("cafe\u0301", "café", {"combining"}), "c": ("ma\u200dtch", "match", {"zero_width"}), "d": ("5\u00a0mm", "5 mm", {"space"}),
        "e": ("prоbe", "probe", {"lookalike"}), "f": ("ﬁeld", "field", {"ligature"}), "g": ("мA/см² № 5 — α, 样品GRG，好", "мA/см² № 5 — α, 样品GRG，好", set()), "h": ("", "", set()), "j": ("cοst", "cost", {"lookalike"}),
    }
    cases["g"] = ("мА/см² № 5 — α, 样品GRG，好", "мА/см² № 5 — α, 样品GRG，好", set())
    df = spark.createDataFrame([(k, v[0], 1) for k, v in cases.items()] + [("n", None, 1)], "chunk_id string, content string, text int")
    got = {r["chunk_id"]: (r["text"], set(r["kinds"] or [])) for r in homoglyphs.unify(df).collect()}
    assert got.pop("n") == (None, set())
    assert got == {k: (v[1], v[2]) for k, v in cases.items()}


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("<h2>Model</h2>\n\n<ul>\n<li>a (X-1)</li>\n<li>b</li></ul>\n\nText <math>x</math> here.", ["heading", "list_item", "list_item", "formula"]),
        ("# Model\n\n1. a\n2. b\n\n```\nx <- 1\n```\n\nso $x^2$ **it** is", ["heading", "list_item", "list_item", "code", "formula"]),
        ("== Model ==\n\n# a (A-1)\n# b (A-2)\n\n'''so''' {{cite|3}}", ["heading", "list_item", "list_item"]),
        ("\\section{M}\n\n\\begin{itemize}\n\\item a\n\\end{itemize}\n\n\\begin{equation}\nx\n\\end{equation}", ["heading", "list_item", "formula"]),
        ("Only ~~one~~ word.", []),
    ],
)
def test_markup_elements(text, kinds):
    found, marked, clean = markup.convert(text)
    assert marked and found == kinds
    assert not re.search(r"</?[a-z]|\*\*|'''|\\item|~~", clean)


@pytest.mark.parametrize("text", ["das Produkt u_max*v_0 ist 7 [1, 2]", "3 < x < 9 & y > 2; lot # 5 for $ 88", "flow grows\n- 91 -\nwith it", "vom\n39. bis zum Tag", "", None])
def test_plain_text_is_no_markup(text):
    assert markup.convert(text)[1:] == (False, text)


def test_markup_held_out_accuracy():
    right = total = 0
    for text, dialect, labels in markup.labelled_pages(280, 1234):
        nodes = markup.parse(text)
        assert len(list(markup._flat(nodes))) == len(labels)
        among = markup.OF_FORMULA if dialect in markup.OF_FORMULA else markup.OF_TEXT
        right += sum(a == b for a, b in zip(markup.model().label(nodes, among), labels))
        total += len(labels)
    assert total > 300 and right / total > 0.98


@pytest.mark.parametrize("raw, yes", [("$x_1$", True), ("<i>x</i>", True), ("x&nbsp;", True), ("\\frac{a}{b} \\le \\alpha", False), ("a_1*b_2 & c", False), ("C_{H^+} = 2 \\text{m}", False), ("[ x ]", False), ("", False)])
def test_marked_formulas(raw, yes):
    assert markup.marked_formula(raw) is yes


@pytest.mark.parametrize("raw", ["$x_1$", "$$x_1$$", "\\[ x_1 \\]", "\\(x_1\\)", "<math>x_1</math>", "<b>x_1</b><br/>", "{{math|x_1}}", "\\begin{equation}\\label{eq:0} x_1 \\end{equation}", "x_1&nbsp;<sup>*</sup>"])
def test_bare_formula(raw):
    assert markup.bare_formula(raw) == "x_1"
    assert markup.bare_formula("h < 2 \\quad (x > 1)") == "h < 2 \\quad (x > 1)"


# ---------------------------------------------------------------- 2, 1


@pytest.fixture(scope="module")
def rules():
    return sentences.Rules({"": sentences.Lists({"т", "д", "рис", "проф", "al", "dr", "fig", "e.g", "etc", "डॉ"}, {"The", "В", "По", "It"}, {"Tag"})})


@pytest.mark.parametrize(
    "text, parts",
    [
        ("Ток растёт на 5,2 В. Позже он падает.", ["Ток растёт на 5,2 В.", "Позже он падает."]),
        ("См. рис. 5 и др. См. у В. Е. Углечук.", None),
        ("Сюда входят мембрана и т. д. В режиме так.", ["Сюда входят мембрана и т. д.", "В режиме так."]),
        ("Dr. L. Smith et al. saw it. The end", ["Dr. L. Smith et al. saw it.", "The end"]),
        ('He wrote: "No heat. It counts." and asked. It is', ['He wrote: "No heat. It counts." and asked.', "It is"]),
        ("(Опыт прерван. Позже повторили.) По этой причине.", ["(Опыт прерван. Позже повторили.)", "По этой причине."]),
        ("Wait... does it? Yes!", ["Wait... does it?", "Yes!"]),
        ("电流增大。样品“模型。很重要。”并要求！好", ["电流增大。", "样品“模型。很重要。”并要求！", "好"]),
        ("डॉ. कसोरा आए। वे गए।", ["डॉ. कसोरा आए।", "वे गए।"]),
        ("сорбции.Отсюда следует\nвсё. pH близок к 4.", ["сорбции.", "Отсюда следует\nвсё.", "pH близок к 4."]),
        ("diluted to .115 mol.", ["diluted to .115 mol."]),
        ("   ", []),
    ],
)
def test_sentences(rules, text, parts):
    got = [text[b:e] for b, e in rules.spans(text)]
    if parts is not None:
        assert got == parts
    assert "".join("".join(got).split()) == "".join(text.split())


def test_learning_and_split(spark):
    text = "Ток см. рис. {0} и табл. {0} растёт. Схема дана проф. А. Ивановым на рис. {0} слева. Модель верна. "
    df = spark.createDataFrame([(i, "".join(text.format(i + k) for k in range(20))) for i in range(20)] + [(99, None), (100, "")], "block_id long, content string")
    r = sentences.learn(sentences.statistics(df, "content"))
    assert {"рис", "табл", "проф", "см"} <= r.abbreviations and "Схема" in r.starters
    got = sentences.split(df, "block_id", "content", r)
    assert got.where("block_id = 0").count() == 60 and got.where("block_id >= 99").count() == 0
    assert sentences.learn(sentences.statistics(df.where("block_id < 0"), "content")).abbreviations == set()


def test_lists_by_language():
    en = sentences.Lists({"fig"}, {"The"}, denied={"abbreviations": {"art"}, "ordinals": {"Tag"}})
    r = sentences.Rules({"de": sentences.Lists({"art"}, {"Der"}, {"Tag"}), "en": en}, {"der": {"de": 3.0}, "the": {"en": 3.0}, "of": {"en": 2.0}})
    assert [len(r.spans(x)) for x in ("Der Salze in Art. Von der Zelle.", "The flow of this art. Von is the name of it.")] == [1, 2]
    assert len(r.spans("Am 3. Tag der Messung.")) == 1 and len(r.spans("In the cell of 3. Tag is the name.")) == 2
    # without a telling word the label decides, without a label any language that knows the word
    assert [len(r.spans("Xx art. Von yy.", g)) for g in ("de", "en", None)] == [1, 2, 1]


def test_collocations_by_log_likelihood(spark):
    text = "Das war am {0}. Mai in der Zelle. Der Strom stieg auf {0}. Dann fiel er wieder ab. Die Messung endet danach. Dann kam die Nacht sofort. Dann ging es weiter. Dann stieg er wieder. "
    df = spark.createDataFrame([(i, "".join(text.format(i + k) for k in range(15)), "de") for i in range(20)], "block_id long, content string, language string")
    r = sentences.learn(sentences.statistics(df, "content", "language"))
    assert "Mai" in r.lists["de"].ordinals and "Dann" not in r.lists["de"].ordinals


def _language_rows():
    base = {
        "en": "The limiting current of the membrane was measured in the cell and the flow is stable.", "de": "Der Grenzstrom der Membran wurde in der Zelle gemessen und die Strömung ist stabil.",
        "fr": "Le courant limite de la membrane a été mesuré dans la cellule et le flux est stable.", "es": "La corriente límite de la membrana se midió en la celda y el flujo es estable por eso.",
        "ru": "Предельный ток мембраны был измерен в ячейке, и поток ещё остаётся устойчивым.", "uk": "Граничний струм мембрани було виміряно в комірці, і потік ще залишається стійким.", "ja": "膜の限界電流はセルで測定され、流れは安定している。", "zh": "膜的极限电流在电池中测得，流动是稳定的。", "hi": "झिल्ली की सीमा धारा सेल में मापी गई और प्रवाह स्थिर है।",
    }
    return base, [(i * 10 + k, t, g if k else None) for i, (g, t) in enumerate(base.items()) for k in range(6)]


def test_languages(spark, rules):
    base, data = _language_rows()
    data += [(900, base["ru"] + " " + base["en"], "ru"), (901, base["de"], "it"), (902, base["fr"], "fra"), (903, None, "en"), (904, "12.5", "en"), (905, base["uk"], "mixed"), (906, base["en"] + " " + base["fr"] + " " + base["en"], None)]
    df = spark.createDataFrame(data, "block_id long, content string, language string")
    m = langid.train(df)
    got = {}
    for r in langid.segments(df, "block_id", "content", "language", rules, m).where("wrong").orderBy("block_id", "seg_no").collect():
        got.setdefault(r["block_id"], []).append(r["lang"])
        assert 0 < r["confidence"] <= 1
    assert got[900] == ["ru", "en"] and got[901] == ["de"] and got[905] == ["uk"] and got[906] == ["en", "fr", "en"]
    assert not {902, 903, 904} & set(got)
    for i, g in enumerate(base):
        assert got[i * 10] == [g]


@pytest.mark.parametrize("label, code", [(None, None), (" ", None), ("?", None), ("und", None), ("ru/en", None), ("RU", "ru"), ("de_DE", "de"), ("zho", "zh"), ("Ukrainian", "uk"), ("it", "other"), ("en-US", "en")])
def test_labels(label, code):
    assert langid.label_code(label) == code


# ---------------------------------------------------------------- 4


CONFUSED = (("m", "rn"), ("o", "0"), ("e", "c"), ("i", "1"))


def _scan_tables(spark):
    rng = random.Random(8)
    vocab = [a + b for a in ("mem", "cur", "lim", "dif", "con", "geo", "sol", "ion", "vol", "tran") for b in ("brane", "rent", "iting", "fusion", "centration", "metry", "ution", "eter", "tage", "sition", "sport")] + ["current-voltage", "the", "was", "in"]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(9))
    clean = spark.createDataFrame([(" ".join(line() for _ in range(40)),) for _ in range(60)], "content string")
    pages, want = [], set()
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(40)]
        lines, now = [], ""
        for x in w:
            if len(now) + 1 + len(x) > 50:
                if rng.random() < 0.3 and len(x) > 7 and "-" not in x:
                    lines.append(f"{now} {x[:4]}-")
                    now = x[4:]
                    continue
                lines.append(now)
                now = x
            else:
                now = f"{now} {x}".strip()
        lines.append(now)
        kinds = [{"hyphen"} if x.endswith("-") else set() for x in lines]
        for k, x in enumerate(lines[1:-1], 1):
            toks = x.split()
            at = 2
            if len(toks) > 4 and rng.random() < 0.4 and not kinds[k] and "-" not in toks[at]:
                a, b = rng.choice(CONFUSED)
                if a in toks[at][1:]:
                    toks[at] = toks[at][0] + toks[at][1:].replace(a, b, 1)
                    lines[k] = " ".join(toks)
                    kinds[k].add("misread")
        title = f"Effect of salt {i % 7} on membrane flow"
        lines[:0] = [f"{title[:24]}    {i}"]
        kinds[:0] = [{"header"}]
        lines.append(f"- {i} -")
        kinds.append({"page_number"})
        pages.append((f"r{i}", "\n".join(lines), True, title, "Salt Review"))
        want |= {(f"r{i}", k + 1, x) for k, xs in enumerate(kinds) for x in xs}
    return spark.createDataFrame(pages, "rec_id string, content string, sure boolean, title string, journal string"), clean, want


def test_scans(spark, monkeypatch):
    pages, clean, want = _scan_tables(spark)
    odd = spark.createDataFrame([("one", "A title only", True, None, None), ("empty", "", True, None, None), ("list", "one sentence ends.\nanother one of other width here.\nthird.", False, None, None)], pages.schema)
    out = scans.repair(pages.unionByName(odd), clean).cache()
    got = {tuple(r)[:3] for r in out.where("kind <> 'text'").collect()}
    assert len(got & want) > 0.97 * len(want) and len(got & want) > 0.97 * len(got)
    assert not {r for r in got if r[0] in ("one", "empty", "list")}
    text = {r["rec_id"]: r["text"] for r in out.where("kind = 'text'").collect()}
    assert set(text) == {f"r{i}" for i in range(120)} | {"one", "empty"}
    known = set(" ".join(r["content"] for r in clean.collect()).split())
    assert sum(w in known for i in range(120) for w in text[f"r{i}"].split()) > 0.99 * sum(len(text[f"r{i}"].split()) for i in range(120))
    # the perceptrons decide: without weights nothing is found
    monkeypatch.setattr(scans.Perceptron, "average", lambda self: self.w.clear())
    assert scans.repair(pages, clean).where("kind <> 'text'").count() == 0


def test_scans_without_rows(spark):
    pages, clean, _ = _scan_tables(spark)
    assert scans.repair(pages.limit(0), clean).count() == 0
    assert scans.repair(pages.limit(3), clean.limit(0)).where("kind = 'text'").count() == 3


def test_edits():
    e = scans.Editor({"1": ["i"], "rn": ["m"]})
    e.model.w["bias"] = 1.0
    assert "limiting membrane" in e.twice("lim1ting mernbrane") and e.choose_twice("lim1ting mernbrane", [("limiting membrane", 5)]) == ("limiting membrane", 5)
    far = "ab" * 13
    assert scans.Editor({"q": ["x"], "w": ["y"]}).twice(far + "qw") == {far + "xy"}
    assert scans.difference("mernbrane", "membrane") == (2, "rn", "m") and scans.holes("ab") & scans.holes("abc")


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize(
    "typed, surname, others, same",
    [
        ("Иванов И. П.", "Иванов", ["Иван", "Петрович"], True), ("IVANOV I.P.", "Иванов", ["Иван", "Петрович"], True), ("Ivanov, Ivan", "Иванов", ["Иван", "Петрович"], True), ("Ваня Иванов", "Иванов", ["Иван", "Петрович"], True),
        ("Иванов С. П.", "Иванов", ["Иван", "Петрович"], False), ("Hljupashskov P.D.", "Хлюпашсков", ["Павел", "Данилович"], True), ("Bill Droborshadndado", "Droborshadndado", ["William", "R"], True), ("Yu. Savarova", "Саварова", ["Юлия", "Львовна"], True),
        ("Svaarova Yuliya 1,2", "Саварова", ["Юлия", "Львовна"], True), ("", "Иванов", ["Иван"], False), ("Bob Droborshadndado", "Droborshadndado", ["William", "R"], False),
    ],
)
def test_people(typed, surname, others, same):
    assert (names.same_person(names.name_tokens(typed), surname, others) > 0) == same


def test_link(spark):
    authority = spark.createDataFrame(
        [
            (1, "organisation", "Институт водных технологий, г. Жемчужинск", "Institute of Water Technologies, Zhemchuzhinsk", "ИВТ-ЖЕМ", "Zhemchuzhinsk", None), (2, "organisation", "Институт водных технологий, г. Тихоборск", "Institute of Water Technologies, Tikhoborsk", "ИВТ-ТИХ", "Tikhoborsk", None),
            (10, "person", "Талагроншов Александр Данилович", "Talagronshov Aleksandr Danilovich", None, None, 1), (11, "person", "Талагроншов Алексей Данилович", "Talagronshov Aleksey Danilovich", None, None, 2), (12, "person", "Samuel P. Glasagrudthado", "Samuel P. Glasagrudthado", None, None, 2),
        ],
        "entity_id long, kind string, name string, name_lat string, acronym string, city string, home_id long",
    )
    m = spark.createDataFrame(
        [(1, "Talagronshov A.D.", "Jemchujinsk Inst. Water Technol."), (2, "Талагроншов А. Д.", "ИВТ-ТИХ, Тихоборск"), (3, "Талагроншов А.Д.", None), (4, "Sam Glasagrudthado¹", "Институт мостов, Тихоборск"), (5, None, ""), (6, "GLASAGRUDTHADO J.", "Institute of Water Tecnologies (Tikhoborsk)")],
        "mention_id long, name string, affiliation string",
    )
    assert set(rows(names.link(m.union(m), authority))) == {(1, "name", 10), (1, "affiliation", 1), (2, "name", 11), (2, "affiliation", 2), (4, "name", 12), (6, "affiliation", 2)}
    assert names.link(m.limit(0), authority).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    got = dict(rows(names.components(edges)))
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (100, 101, 102)} == {100}


def test_variants(spark):
    people = [
        ["Olretsev Evgenii Pavlovich", "Evgenii Olretsev", "Ольрецев Е. П.", "Olretsev Zhenya", "E. P. Olretsev"], ["Samuel P. Veletrtugsmann", "Sam Veletrtugsmann", "Veletrtugsmann S."],
        ["Глашоров Иван Петрович", "Glashorov Ivan"], ["Глашоров Игорь Данилович", "Glashorov I. D."], ["Glashorov I."], ["I. Glashorov"], ["Kruzenov J."], ["123"],
    ]
    df = spark.createDataFrame([(x,) for p in people for x in p] + [(None,), ("",), ("Evgenii Olretsev",)], "spelling string")
    found: dict = {}
    for spelling, cluster in rows(names.variants(df)):
        found.setdefault(cluster, []).append(spelling)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, people))


# ---------------------------------------------------------------- 6


def _noisy(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_same_as_brute_force(spark):
    rng = random.Random(2)
    bases = [[f"t{rng.randrange(4000)}" for _ in range(60)] for _ in range(12)]
    texts = {f"c{i:03d}": _noisy(rng, bases[i % 12], rng.randrange(0, 6)) for i in range(120)}
    texts |= {"x1": texts["c000"], "x2": texts["c000"].upper(), "e1": "", "e2": "a b", "e3": None}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [("c000", texts["c000"], 1)], "chunk_id string, content string, sig int")
    found = neardup.near(df, "chunk_id", "content", size=3, threshold=0.6, run=4, runs=64, least=2)
    got = set(rows(neardup.pairs(found, "chunk_id")))
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] and texts[b] and neardup._jaccard(texts[a], texts[b], 3) >= 0.6}
    assert got == want and ("c000", "x1") in got
    links_of = {r["chunk_id"]: r["n_links"] for r in neardup.summary(found, "chunk_id").collect()}
    assert links_of["x1"] == sum("x1" in p for p in want)
    # every list handed on to the join, and every broadcast left out
    old = neardup.LONG_LIST, neardup.MAX_BROADCAST_PAIRS, neardup.MAX_BROADCAST_CLASSES
    neardup.LONG_LIST, neardup.MAX_BROADCAST_PAIRS, neardup.MAX_BROADCAST_CLASSES = 3, 0, 0
    try:
        assert set(rows(neardup.pairs(neardup.near(df, "chunk_id", "content", size=3, threshold=0.6, run=4, runs=64, least=2), "chunk_id"))) == want
    finally:
        neardup.LONG_LIST, neardup.MAX_BROADCAST_PAIRS, neardup.MAX_BROADCAST_CLASSES = old


def test_near_titles(spark):
    t = [("p1", "Effect of salt on flow in the Ermat cell 5 at low load today"), ("p2", "Effect of salt on flow in the Ermat cell 5 at low load"), ("p3", "Another title"), ("p4", None), ("p5", "другое название статьи"), ("p6", "Другое название: статьи")]
    found = neardup.near(spark.createDataFrame(t, "paper_id string, title string"), "paper_id", "title", size=1, threshold=0.75, run=12, runs=256, least=2, late=True)
    assert set(rows(neardup.pairs(found, "paper_id"))) == {("p1", "p2"), ("p5", "p6")}


# ---------------------------------------------------------------- 10


def test_shared_spans_same_as_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \nёж中") for _ in range(n))
    passages = [text(n) for n in (199, 200, 201, 260, 900)]
    docs = {i: text(rng.randrange(0, 500)) + (rng.choice(passages) if i % 2 else "") + text(rng.randrange(0, 400)) + (passages[4][100:450] if i % 5 == 0 else "") for i in range(60)}
    docs |= {100: docs[1], 101: "", 102: None, 103: "z" * 700, 104: "z" * 250}
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, pos int")
    owner: dict = {}
    for k, v in docs.items():
        for s in range(len(v or "") - 199):
            owner.setdefault(v[s : s + 200], set()).add(k)
    want = set()
    for k, v in docs.items():
        cover = [False] * (len(v or "") + 1)
        for s in range(len(v or "") - 199):
            if len(owner[v[s : s + 200]]) > 1:
                cover[s : s + 200] = [True] * 200
        b = None
        for i, c in enumerate(cover):
            if c and b is None:
                b = i
            if not c and b is not None:
                want.add((k, b, i))
                b = None
    assert set(rows(spans.merge(spans.shared(df)))) == want and want
    old = spans.MANY_FIELDS
    spans.MANY_FIELDS = 0
    try:
        assert set(rows(spans.merge(spans.shared(df)))) == want
    finally:
        spans.MANY_FIELDS = old


def test_removed_spans_of_different_extents(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh \nёж") for _ in range(n))
    long = text(1200)
    docs = {2: text(90) + long[400:650] + text(80), 5: text(70) + long + text(60), 9: long + text(50)}
    docs |= {3: docs[2], 7: docs[5], 10: docs[9]}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    first: dict = {}
    for k, v in docs.items():
        for s in range(len(v) - 199):
            first.setdefault(v[s : s + 200], k)
    want = {(k, i) for k, v in docs.items() for s in range(len(v) - 199) if first[v[s : s + 200]] < k for i in range(s, s + 200)}
    old = spans.MANY_FIELDS
    try:
        for spans.MANY_FIELDS in (old, 0):
            got = spans.merge(spans.shared(df).where("later")).collect()
            assert {(r["doc_id"], i) for r in got for i in range(r["begin_at"], r["end_at"])} == want
    finally:
        spans.MANY_FIELDS = old


# ---------------------------------------------------------------- 9


def test_packing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"word{rng.randrange(300)}" for _ in range(rng.choice((0, 5, 60, 200, 700))))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = packing.containers(df, capacity=512).collect()
    size = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()}
    room: dict = {}
    pieces: dict = {}
    for r in got:
        room[r["container"]] = room.get(r["container"], 0) + r["end_tok"] - r["begin_tok"]
        pieces.setdefault(r["doc_id"], []).append((r["begin_tok"], r["end_tok"]))
    assert max(room.values()) <= 512 and set(pieces) == set(size)
    for k, p in pieces.items():
        p.sort()
        assert p[0][0] == 0 and p[-1][1] == size[k] and all(a[1] == b[0] for a, b in zip(p, p[1:]))
        assert len(p) == 1 or size[k] > 512
    assert sum(room.values()) / (512 * len(room)) > 0.9
    assert packing.containers(df.limit(0)).count() == 0


def test_patterns_pass_over_other_signs():
    """The patterns of p1 and p2 match as their plain wording does and need at most three fifths of its time on running text."""
    import random
    import re
    import time

    from folioflow.llm import langid, sentences

    plain = {
        sentences._END: r"(?:[.!?…]+|[。！？｡।॥]+|\n[ \t]*\n)",
        sentences._CAPITALS: r"\b[A-ZА-ЯЁІЇЄҐ]{2,}\b",
        sentences._ORDINAL: r"(?<![\w.,])\d+\.\s+(?=[^\W\d_a-z])",
        langid._NOISE: r"\b[A-Z]{1,4}-?\d+\b|\b(?:mA|cm|mm|mol|kV|mV|pH|Hz|kHz|nm|V|L|h|s)\b(?=[\s/.,;)²³]|$)|\d+",
    }
    draw = random.Random(7)
    parts = "mA cm mm mol kV mV pH Hz kHz nm V L h s A AB ABC- -7 12 3. . ... !? 。 … \n \n\t\n _ , ; ) ² ٣ é ж ЖЖ Ї".split(" ") + [" "] * 9
    odd = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(20_000)]
    running = ["Граничний струм визначається швидкістю отруєння мембрани, and the limiting current grows with it " * 20] * 200
    seconds = [0.0, 0.0]
    for fast, slow in plain.items():
        assert [[m.span() for m in fast.finditer(x)] for x in odd] == [[m.span() for m in re.finditer(slow, x)] for x in odd]
        for i, p in enumerate((fast, re.compile(slow))):
            t = time.process_time()
            for x in running:
                p.search(x)
            seconds[i] += time.process_time() - t
    assert seconds[0] < 0.6 * seconds[1]


def test_word_before_a_period():
    from folioflow.llm import sentences

    texts = ["см. и", "a.b.c. d", "pH7. x", "\n\nrés. y", " . ", ".", "e-g. «ab». 12.5. _x. x_. हि. ज़. z\ty."]
    for text in texts:
        for at in (i for i, c in enumerate(text) if c == "."):
            b = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
            m = sentences._LAST.search(text, b, at)
            assert sentences._before(text, at) == ((m.start(), m.group()) if m else (b, ""))
