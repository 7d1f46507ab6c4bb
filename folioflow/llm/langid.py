"""Languages of documents and of the one-language segments of mixed ones.

Hierarchical discrimination: the family is predicted first, by a linear
function of the scripts of a sentence's letters; inside a family of several
languages, linear support vector machines, one for each pair of languages, vote
on hashed character n-grams.  The machines are fitted by averaged
subgradient steps on the hinge loss over a bounded sample of labelled rows
(``SAMPLE`` per language, least hash of the key first); labels that contradict
the family are not used.  Everything else covers all rows.

Defined results: null, empty and letterless texts have no language (``und``)
and no segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import code_points, mix64
from folioflow.llm.sentences import Rules

#: Labelled rows per language on which the machines are fitted.
SAMPLE = 400
BITS = 17
#: Steps on the hinge loss: how fast weights fade, and how far the first step goes.
REGULAR, RATE = 0.1, 20.0
FAMILIES = {"latin": ("de", "en", "es", "fr"), "cyrillic": ("ru", "uk"), "east": ("ja", "zh"), "devanagari": ("hi",)}
# Notations of the languages' names, after lower-casing and cutting a region off.
NOTATIONS = {
    "ru": "ru rus russian русский рус", "en": "en eng english английский", "de": "de deu ger german deutsch немецкий", "fr": "fr fra fre french français francais", "uk": "uk ukr ukrainian українська ua",
    "es": "es spa spanish español espanol castellano", "zh": "zh zho chi chinese 中文 cmn", "ja": "ja jpn japanese 日本語 jp", "hi": "hi hin hindi हिन्दी",
}
_CODE = {n: code for code, ns in NOTATIONS.items() for n in ns.split()}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}
# Labels that name no language or only say that languages are mixed.
NO_LANGUAGE = frozenset("und xx xxx unknown unk n/a na none null mixed mul multi multiple ? - zxx mis".split())


@lru_cache(10_000)
def label_code(label: str | None) -> str | None:
    """ISO 639-1 code of a label in any notation, ``other`` for another language, None for none."""
    if label is None:
        return None
    x = label.strip().lower()
    if not x or x in NO_LANGUAGE or not re.search(r"[^\W\d_]", x):
        return None
    if x in _CODE:
        return _CODE[x]
    if re.search(r"[/,;+&|]", x):
        return None
    head = re.split(r"[-_\s(]", x)[0]
    return _CODE.get(head, "other")


_SCRIPTS = np.zeros(0x110000, np.uint8)
for _f, _ranges in ((1, ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x250), (0x1E00, 0x1F00))), (2, ((0x400, 0x530),)), (3, ((0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFF9F))), (4, ((0x900, 0x964), (0x966, 0x980)))):
    for _a, _b in _ranges:
        _SCRIPTS[_a:_b] = _f
_ORDER = ("latin", "cyrillic", "east", "devanagari")
#: Weight of one letter of each script: a sign of the eastern scripts stands for more of a word.
_WEIGHT = np.array([0.0, 1.0, 1.0, 2.5, 1.2])
#: Numbers, codes (NR-12) and units; the first set lets all other signs be passed over fast.
_NOISE = re.compile(
    r"[A-Zchkmnps\d](?:(?<=\d)\d*|(?<!\w.)(?:(?<=[A-Z])[A-Z]{0,3}-?\d+\b"
    r"|(?:(?<=m)(?:A|m|ol|V)|(?<=[cn])m|(?<=k)(?:V|Hz)|(?<=p)H|(?<=H)z|(?<=[VLhs]))\b(?=[\s/.,;)²³]|$)))"
)
_QUOTES = re.compile(r"[«“„\"「《『(（]")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|「[^」]*」|《[^》]*》|『[^』]*』|\([^()]*\)|（[^（）]*）")


#: Lines that run above or below a page: a name beside a number, or capitals only.
_RUNNING = re.compile(r"^[ \t]*\d{1,5}[ \t]{2,}\S.*$|^.*\S[ \t]{2,}\d{1,5}[ \t]*$|^[^a-zа-яёіїєґà-ÿ\n]*[A-ZА-ЯЁІЇЄҐ]{3}[^a-zа-яёіїєґà-ÿ\n]*$", re.M)
#: How a sentence ends that is not the last one.
_CLOSED = tuple(".!?…。！？｡।॥»”“\"')]}》」』）】›:;")


def prepare(sentence: str) -> str:
    """What of a sentence tells its language: without codes, units, numbers, running lines and what stands in quotes."""
    if "\n" in sentence:
        body = _RUNNING.sub(" ", sentence)
        sentence = body if sum(map(str.isalpha, body)) > 7 else sentence
    bare = _QUOTED.sub(" ", sentence) if _QUOTES.search(sentence) else sentence
    # what is quoted counts where little else is said
    if len(bare) < len(sentence) and sum(map(str.isalpha, bare)) < max(12, sum(map(str.isalpha, sentence)) / 3):
        bare = sentence
    return " ".join(_NOISE.sub(" ", bare).split()).lower()


#: Ends that need no learning: a full word before, a capital after; other sentences stay together.
_SURE_END = re.compile(r"(?<=\w{4}[.!?])\s+(?=[A-ZА-ЯЁЄІЇҐÀ-Ý])|(?<=[。！？।])")


class Machines:
    def __init__(self) -> None:
        self.pairs = [(f, a, b) for f, langs in FAMILIES.items() for i, a in enumerate(langs) for b in langs[i + 1 :]]
        self.weights: dict[tuple[str, str], np.ndarray] = {}

    @staticmethod
    def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashed 1- to 3-grams of all texts and the text of each."""
        padded = [f" {t} " for t in texts]
        size = np.fromiter(map(len, padded), np.int64, len(padded))
        cp = code_points("".join(padded)).astype(np.uint64)
        row = np.repeat(np.arange(len(padded)), size)
        out, rows = [mix64(cp)], [row]
        g = cp
        for n in (2, 3):
            g = g[: len(cp) - n + 1] * np.uint64(1_000_003) + cp[n - 1 :]
            keep = row[: len(g)] == row[n - 1 :]
            out.append(mix64(g[keep] + np.uint64(n << 60)))
            rows.append(row[: len(g)][keep])
        return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)

    def fit(self, texts: list[str], langs: list[str], steps: int = 60, rounds: int = 4) -> None:
        """Averaged subgradient steps on the hinge loss, pair by pair, over single sentences.

        Labels are partly wrong and some rows mix languages.  Before the
        machine is fitted, sentences whose n-grams are likelier under the other
        label are left out, again and again: wrong labels are the minority of a label's
        rows, so they lose; the margin would fit them instead.
        """
        units = [(prepare(u), g) for t, g in zip(texts, langs) for u in _SURE_END.split(t) if len(u) > 8]
        units = [(u, g) for u, g in units if len(u) > (12 if u.isascii() else 6) and family_of(u) == _FAMILY[g]]
        y = np.array([g for _, g in units])
        feats, rows = self.features([u for u, _ in units])
        order = np.argsort(rows, kind="stable")
        feats, rows = feats[order], rows[order]
        ends = np.searchsorted(rows, np.arange(len(units) + 1))
        for _, a, b in self.pairs:
            w = np.zeros(1 << BITS)
            own = np.flatnonzero((y == a) | (y == b))
            for r in range(rounds):
                sign = np.where(y[own] == a, 1.0, -1.0)
                if not len(own) or abs(sign.sum()) == len(own):
                    break
                size = ends[own + 1] - ends[own]
                local = np.repeat(np.arange(len(own)), size)
                x = feats[np.repeat(ends[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                norm = 1 / np.sqrt(np.maximum(size, 1))
                if r < rounds - 1:
                    count = [np.bincount(x, (sign == s)[local], 1 << BITS) + 0.5 for s in (1, -1)]
                    odds = np.log(count[0] / count[0].sum()) - np.log(count[1] / count[1].sum())
                    own = own[sign * np.bincount(local, odds[x], len(own)) > 0]
                    continue
                share = tuple(len(own) / (2 * max((sign == s).sum(), 1)) for s in (1, -1))
                gain = np.where(sign > 0, share[0], share[1]) * sign * norm / len(own)
                # features count as much as their log-odds; the machine starts from zero
                count = [np.bincount(x, (sign == s)[local], 1 << BITS) + 0.5 for s in (1, -1)]
                odds = np.log(count[0] / count[0].sum()) - np.log(count[1] / count[1].sum())
                odds /= max(np.abs(np.bincount(local, odds[x], len(own)) * norm).mean(), 1e-9)
                w, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
                for k in range(steps):
                    bad = sign * np.bincount(local, (w * odds)[x], len(own)) * norm < 1
                    w = w * (1 - REGULAR / (k + 2)) + RATE / (k + 2) ** 0.5 * odds * np.bincount(x, (gain * bad)[local], 1 << BITS)
                    total += w
                w = total / steps * odds
            scale = np.abs(np.bincount(local, w[x], len(own)) * norm).mean() if len(own) and w.any() else 1.0
            self.weights[a, b] = (w / max(scale, 1e-9)).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text (one sentence or more)."""
        prepared = [prepare(t) for t in texts]
        n = len(texts)
        langs, sure = ["und"] * n, np.zeros(n)
        if not n:
            return langs, sure
        shares = family_shares(prepared)
        fam = shares.argmax(1)
        top = shares.max(1)
        for k, f in enumerate(_ORDER):
            rows_of = np.flatnonzero((fam == k) & (top > 0))
            members = FAMILIES[f]
            if not len(rows_of):
                continue
            if len(members) == 1:
                for i in rows_of.tolist():
                    langs[i] = members[0]
                sure[rows_of] = top[rows_of]
                continue
            feats, rows = self.features([prepared[i] for i in rows_of])
            norm = np.sqrt(np.maximum(np.bincount(rows, minlength=len(rows_of)), 1))
            votes = np.zeros((len(rows_of), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    m = np.bincount(rows, self.weights[a, members[j]][feats], len(rows_of)) / norm
                    s = np.tanh(m)
                    votes[:, i] += s
                    votes[:, j] -= s
            best = votes.argmax(1)
            ordered = np.sort(votes, axis=1)
            margin = (ordered[:, -1] - ordered[:, -2]) / 2
            for i, c in zip(rows_of.tolist(), best.tolist()):
                langs[i] = members[c]
            sure[rows_of] = top[rows_of] / (1 + np.exp(-8 * margin))
        return langs, sure


def family_shares(prepared: list[str]) -> np.ndarray:
    size = np.fromiter(map(len, prepared), np.int64, len(prepared))
    out = np.zeros((len(prepared), 4))
    if size.sum():
        s = _SCRIPTS[code_points("".join(prepared))]
        row = np.repeat(np.arange(len(prepared)), size)
        for k in range(4):
            out[:, k] = np.bincount(row, (s == k + 1) * _WEIGHT[k + 1], len(prepared))
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def family_weight(prepared: str) -> float:
    """Letters of a text, those of the eastern scripts counting more."""
    return float(_WEIGHT[_SCRIPTS[code_points(prepared)]].sum()) if prepared else 0.0


def family_of(prepared: str) -> str | None:
    shares = family_shares([prepared])[0]
    return _ORDER[int(shares.argmax())] if shares.max() > 0.7 else None


def train(blocks: DataFrame, key: str = "block_id", text: str = "content", label: str = "language") -> Machines:
    """Machines fitted on at most ``SAMPLE`` labelled rows of each language."""
    notations = F.create_map(*[F.lit(x) for n, c in _CODE.items() for x in (n, c)])
    norm = F.lower(F.trim(F.col(label)))
    code = F.coalesce(notations[norm], notations[F.regexp_extract(norm, r"^([^\-_\s(]+)", 1)])
    rows = blocks.select(F.xxhash64(key).alias("h"), F.col(text).alias("t"), code.alias("c")).where("c IS NOT NULL AND length(t) > 8")
    w = Window.partitionBy("c").orderBy("h")
    sample = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE).select("t", "c").orderBy("c", "h").collect()
    m = Machines()
    m.fit([r["t"] for r in sample], [r["c"] for r in sample])
    return m


#: A sentence whose language is less sure than this takes that of its neighbours in the same family.
DOUBT = 0.62
#: A piece of fewer letters than this beside others takes their language.
LEAST_LETTERS = 8


def segments_of(texts: list[str], rules: Rules, m: Machines, labels: list[str | None] | None = None) -> list[list[tuple[str, float, int, int]]]:
    """(language, confidence, begin, end) of the longest one-language runs of whole sentences of each text."""
    spans = [rules.spans(t, label_code(g)) if t else [] for t, g in zip(texts, labels or [None] * len(texts))]
    langs, sure = m.predict([t[b:e] for t, ss in zip(texts, spans) for b, e in ss])
    out, at = [], 0
    for t, ss in zip(texts, spans):
        n = len(ss)
        own, conf = langs[at : at + n], sure[at : at + n].tolist()
        at += n
        for i in range(n if n > 1 else 0):
            # what lacks its end and is not last is no sentence but a heading or a running line; a word or two tell nothing
            piece = t[ss[i][0] : ss[i][1]]
            if (i < n - 1 and not piece.endswith(_CLOSED)) or (len(piece) < 40 and family_weight(prepare(piece)) < LEAST_LETTERS):
                own[i], conf[i] = "und", 0.0
        if n > 1:
            weight: dict[str, float] = {}
            for (b, e), g, c in zip(ss, own, conf):
                weight[g] = weight.get(g, 0.0) + c * (e - b)
            for i, g in enumerate(own):
                if g == "und" or conf[i] < DOUBT:
                    near = [own[j] for j in (i - 1, i + 1) if 0 <= j < n and own[j] != "und" and conf[j] >= DOUBT and (g == "und" or _FAMILY[own[j]] == _FAMILY[g])]
                    if near:
                        own[i] = max(near, key=lambda x: weight[x])
        runs: list[tuple[str, float, int, int]] = []
        for (b, e), g, c in zip(ss, own, conf):
            if g == "und":
                if runs:
                    runs[-1] = (*runs[-1][:3], e)
                continue
            if runs and runs[-1][0] == g:
                p = runs[-1]
                runs[-1] = (g, (p[1] * (p[3] - p[2]) + c * (e - b)) / max(p[3] - p[2] + e - b, 1), p[2], e)
            else:
                runs.append((g, c, b, e))
        out.append(runs)
    return out


def segments(df: DataFrame, key: str, text: str, label: str | None, rules: Rules, m: Machines) -> DataFrame:
    """``key``, ``seg_no``, ``lang``, ``confidence``, ``begin_at``, ``end_at``, ``wrong``.

    ``wrong``: the label is missing, names another language, or one label stands for several.
    """
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast((rules, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, m = shared.value
        for whole in batches:
            for c in range(0, len(whole), 1000):
                b = whole.iloc[c : c + 1000]
                rows = []
                for k, lab, runs in zip(b[key], b["_label"], segments_of(b["_text"].tolist(), rules, m, b["_label"].tolist())):
                    wrong = len(runs) > 1 or (len(runs) == 1 and label_code(lab) != runs[0][0])
                    rows += [(k, i + 1, g, round(float(s), 4), x, y, wrong) for i, (g, s, x, y) in enumerate(runs)]
                yield pd.DataFrame(rows, columns=[key, "seg_no", "lang", "confidence", "begin_at", "end_at", "wrong"])

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"), (F.col(label) if label else F.lit(None)).cast("string").alias("_label"))
    return rows.mapInPandas(run, f"{key} {kind}, seg_no int, lang string, confidence double, begin_at int, end_at int, wrong boolean")
