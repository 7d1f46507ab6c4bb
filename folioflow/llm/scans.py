"""Repair of text from scanned pages.

Lines are told apart as text, running headers and page numbers by averaged
perceptrons on their position on the page, their shape and their likeness to
the title and journal of the record.  Characters are mended by an
averaged-perceptron editor: for each word it scores every replacement, deletion
and insertion that the confusions of the corpus allow against keeping the word
as it is, and for each line that ends in a broken word joining without the
sign, joining with it, and keeping.  How often a word is met in clean text is a
feature of the editor, not a condition.

Counts cover all data and stay distributed: the vocabulary of the clean text,
the words of the scanned pages, the confusions (met in ``LEAST_MET`` words of
all pages) and each word's candidates are tables that meet by equi-joins.  Sent
to the driver are the confusions (pairs of up to two signs), journals of at
least a five-hundredth of the pages, words of at least ``FREQUENT`` of all
words (so 1 / ``FREQUENT`` at most), and bounded samples for the weights:
``TRAIN_PAGES`` pages and ``TRAIN_WORDS`` words of each label.

Defined results: null and empty contents have no lines; a chunk is scanned if
its line ends lie where the next word would not have fitted.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import checkpoint

TRAIN_PAGES = 3000
TRAIN_WORDS = 8000
FREQUENT = 2e-5
LEAST_MET = 3
#: Two misread signs in a word are sought among confusions that explain at least this share of the words that one sign explains.
USUAL = 0.005
#: Least share of a page's line ends that a wrapped line explains, and the share of lines with markup that speaks against it.
WRAPPED, MARKED = 0.6, 0.5
_STRIP = " \t.,;:!?()[]{}«»„“”\"'’…–—-¬­"
_CODE = re.compile(r"[A-ZА-Я]{1,4}-?\d[\d.]*")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t]*$")
_PAGE = re.compile(r"[ \t]*(?:[-—–\[(]?[ \t]*\d{1,4}[ \t]*[-—–\])]?|(?:p|pp|page|стр|с|s|seite|pág|página)\.?[ \t]*\d{1,4}|第?\d{1,4}[頁页])[ \t]*", re.I)
_OUTER = " \t.,;:?()[]{}«»„“”\"…–—-¬­"
_NUMBER = re.compile(r"[\d.,–-]+\D?")
_SIDE = re.compile(r"^[ \t]*[\d,.]{1,5}[ \t]{2,}(?=\S)|[ \t]{2,}[\d,.]{1,5}[ \t]*$")
_MARKUP = re.compile(r"</?[a-zA-Z]|\\[a-zA-Z]{2,}|^#|\*\*|__|```|~~~|\{\{|\[\[|'''|\]\(|\$\$|^[=-]{4,}$|^[*+] |^\d+\. |^- \D", re.M)


def scanned(content: Column) -> Column:
    """Whether a content has line breaks inside its paragraphs, as scanned pages have.  Cheap and only a first sieve."""
    return content.rlike(r"[^\n]\n[^\n]")


def is_scan(content: str) -> bool:
    """Whether the line ends of a page are those of a text column: the next line's first word would not have fitted."""
    lines = [x.rstrip() for x in content.split("\n")]
    full = sorted(len(x) for x in lines if x.strip())
    if len(full) < 2:
        return False
    # one line of eight may be wider than the column
    width = full[-max(1, len(full) // 8)]
    ends = [(x, y) for x, y in zip(lines, lines[1:]) if x.strip() and y.strip()]
    fitted = sum(len(x) + 1 + len(y.split(None, 1)[0]) >= width or bool(_BREAK.search(x)) for x, y in ends)
    marked = sum(bool(_MARKUP.search(x)) for x in lines)
    return fitted >= WRAPPED * max(len(ends), 1) and marked < MARKED * len(full)


# ---------------------------------------------------------------- words


def spellings(token: str) -> list[str]:
    """The forms under which a token as printed is looked up, lower case: without marks, and without the outer ones only."""
    out = []
    for w in (token.strip(_STRIP), token.strip(_OUTER)):
        low = w.lower()
        if len(low) < 3 or "/" in low or _CODE.fullmatch(w) or _NUMBER.fullmatch(low) or sum(c.isalpha() for c in low) < 2 or low in out:
            continue
        out.append(low)
    return out


def counted(texts: list[str]) -> Counter:
    """Tally of the words of clean texts; tokens are tallied as they are first and looked at once each."""
    raw: Counter = Counter()
    for t in texts:
        raw.update(t.split())
    out: Counter = Counter()
    for t, n in raw.items():
        w = t.strip(_STRIP)
        if len(w) > 2 and w[0].isalpha() and "/" not in w and not _CODE.fullmatch(w):
            out[w.lower()] += n
    return out


def vocabulary(clean: DataFrame, text: str) -> DataFrame:
    """(w, n): how often each word is met in all clean texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # partial counts of each batch, so the shuffle has words and not texts
        for b in batches:
            c = counted(b["t"].tolist())
            yield pd.DataFrame({"w": list(c.keys()), "n": list(c.values())})

    return clean.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInPandas(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def broken(lines: list[str]) -> Iterator[tuple[int, int, str, str, str]]:
    """(line, next line with text or -1, sign, part before, part after) of lines that may end in a broken word."""
    for a, x in enumerate(lines):
        if _BREAK.search(x):
            bare = x.rstrip()
            b = next((j for j in range(a + 1, len(lines)) if lines[j].strip()), -1)
            yield a, b, bare[-1], bare[:-1].split()[-1].lstrip(_STRIP).lower(), lines[b].split()[0] if b >= 0 else ""


def joined_forms(head: str, after: str) -> dict[str, str]:
    """What two parts of a broken word are looked up as."""
    tail = after.strip(_STRIP).lower()
    return {"whole": head + tail, "compound": f"{head}-{tail}", "last": head.rsplit("-", 1)[-1] + tail.split("-", 1)[0], "head": head, "tail": tail}


def lookups(content: str, frequent: set[str] | frozenset[str]) -> dict[str, tuple[bool, bool]]:
    """Words of a page whose decision is asked for: whether they matter even if they are kept, and whether they are printed whole.

    The line after a broken one is looked for past each of the next lines, as what is furniture is decided later.
    """
    out: dict[str, tuple[bool, bool]] = {}

    def ask(w: str, always: bool, plain: bool) -> None:
        x = out.get(w, (False, False))
        out[w] = (x[0] or always, x[1] or plain)

    lines = content.split("\n")
    after = False
    for line in lines:
        toks = line.split()
        ends = bool(_BREAK.search(line))
        for k, t in enumerate(toks):
            whole = not (after and k == 0) and not (ends and k == len(toks) - 1)
            for w in spellings(t):
                if w not in frequent:
                    ask(w, False, whole)
                    for p in w.split("-") if "-" in w else ():
                        if len(p) > 2 and p not in frequent:
                            ask(p, True, whole)
        after = ends if toks else after
    for a, _, _, head, _ in broken(lines):
        for b in range(a + 1, min(a + 6, len(lines))):
            if lines[b].strip():
                for w in joined_forms(head, lines[b].split()[0]).values():
                    if len(w) > 1 and w not in frequent:
                        ask(w, True, False)
    return out


class Perceptron:
    """Averaged perceptron over named features."""

    def __init__(self) -> None:
        self.w: dict = defaultdict(float)
        self._sum: dict = defaultdict(float)
        self._n = 1

    def score(self, features: list) -> float:
        w = self.w
        return sum(w[f] for f in features if f in w)

    def learn(self, features: list, error: float) -> None:
        for f in features:
            self.w[f] += error
            self._sum[f] += error * self._n

    def tick(self) -> None:
        self._n += 1

    def average(self) -> None:
        self.w = {f: v - self._sum[f] / self._n for f, v in self.w.items() if v or self._sum[f]}


# ---------------------------------------------------------------- furniture


def _letters(s: str) -> str:
    return re.sub(r"[\W\d_]+", " ", s.lower()).strip()


@lru_cache(20_000)
def _core_letters(line: str) -> str:
    return _letters(_SIDE.sub("", line).strip())


class Names:
    """Titles and journals by their first signs, so that a line is compared with few of them."""

    def __init__(self, names: list[str]):
        self.names = names
        self.first: dict[str, list[int]] = defaultdict(list)
        for i, n in enumerate(names):
            low = n.lower()
            self.first[low[:1]].append(i)
            self.first["." + low[1:3]].append(i)

    def near(self, raw: str) -> list[str]:
        return [self.names[i] for i in sorted({*self.first.get(raw[:1], ()), *self.first.get("." + raw[1:3], ())})]


def resembles(line: str, names: Names) -> bool:
    """Whether a line shows the beginning of one of the names, misread signs allowed."""
    core = _SIDE.sub("", line).strip()
    if len(_letters(core)) < 6:
        return False
    raw = core.lower()
    for name in names.near(raw):
        if len(raw) > len(name) + 4:
            continue
        head = name[: len(raw)].lower()
        same = sum(x == y for x, y in zip(raw, head))
        if same >= 0.8 * max(len(raw), 1):
            return True
        if same >= 0.25 * len(raw):
            m = SequenceMatcher(None, raw, head, False)
            if m.quick_ratio() >= 0.84 and m.ratio() >= 0.84:
                return True
    return False


def _shape(core: str) -> str:
    """A short line's signs: 9 for a digit, a for a letter."""
    return "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in core) if len(core) < 12 else "long"


def line_features(lines: list[str], i: int, shown: bool, typical: float) -> list:
    line = lines[i]
    core = _SIDE.sub("", line).strip()
    toks = core.lower().split()
    alpha = [c for c in core if c.isalpha()]
    nxt = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
    prv = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
    side = bool(_SIDE.search(line))
    f = ["bias", ("first", i == 0), ("last", i == len(lines) - 1), ("side", side), ("len", min(int(len(core) / max(typical, 1) * 5), 7))]
    f += [("caps", len(alpha) > 5 and sum(c.isupper() for c in alpha) > 0.8 * len(alpha)), ("end", core[-1:] in ".!?:;,)%"), ("begin", core[:1].isupper())]
    f += [("digits", bool(re.search(r"\d", core))), ("next", nxt[:1].islower()), ("prev_open", bool(prv) and prv[-1] not in ".!?")]
    f += [("shown", shown), ("shown_side", shown, side), ("w1", toks[0] if toks else ""), ("w2", " ".join(toks[:2])), ("wl", toks[-1] if toks else ""), ("flow", nxt[:1].islower(), prv[-1:] in ".!?", core[:1].isupper(), core[-1:] in ".!?")]
    numeric = lambda x: bool(x) and len(x) < 12 and any(c.isdigit() for c in x) and sum(c.isalpha() for c in x) < 6 and x[-1] not in ".,;%"
    own = _core_letters(line)
    f += [("again", len(own) > 5 and sum(_core_letters(x) == own for x in lines) > 1)]
    f += [("page_near", numeric(nxt) or numeric(prv)), ("numeric", numeric(line.strip())), ("numeric", numeric(line.strip()), prv[-1:] in ".!?", nxt[:1].islower()), ("edge", i == 0 or i == len(lines) - 1, numeric(line.strip()))]
    shape = _shape(line.strip())
    f += [("shape", shape), ("few", len(alpha) < 6, shape != "long"), ("word", re.sub(r"[\d\W_]+", "", line).lower() if shape != "long" else ""), ("number", bool(re.search(r"\d", line)), len(alpha) < 6, shape != "long")]
    return f


class Furniture:
    """What each line is: ``header``, ``page_number`` or ``text``, the best of three scores."""

    KINDS = ("header", "page_number")

    def __init__(self, journals: list[str] | None = None) -> None:
        self.models = {k: Perceptron() for k in self.KINDS}
        #: Journals met on many pages.
        self.journals = journals or []

    def names(self, own: list[str]) -> Names:
        return Names([*own, *(j for j in self.journals if j not in own)])

    def fit(self, pages: list[tuple[str, list[str]]], epochs: int = 3) -> None:
        """Labels by rule: lines that show the record's own title or journal, and lines that are only a number."""
        rows = []
        for content, own in pages:
            names = self.names(own)
            lines = content.split("\n")
            typical = float(np.median([len(x) for x in lines if x.strip()] or [1]))
            for i, line in enumerate(lines):
                if not line.strip():
                    continue
                shown = resembles(line, names)
                if _PAGE.fullmatch(line):
                    kind = "page_number"
                elif shown:
                    kind = "header"
                else:
                    # without both names, a line may be a header or not
                    kind = "text" if len(own) > 1 else "no_number"
                rows.append((line_features(lines, i, shown, typical), line_features(lines, i, False, typical), kind))
        rng = np.random.default_rng(3)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)).tolist():
                seen, blind, kind = rows[k]
                # every other time without the name, as records without title and journal have it
                f = seen if rng.random() < 0.5 else blind
                for name, m in self.models.items():
                    if kind == "no_number" and name == "header":
                        continue
                    y = 1 if kind == name else -1
                    if y * m.score(f) <= 0:
                        m.learn(f, y)
                    m.tick()
        for m in self.models.values():
            m.average()

    def kinds(self, content: str, own: list[str]) -> list[str]:
        """``page_number``, ``header``, ``blank`` or ``text`` for each line."""
        lines = content.split("\n")
        typical = float(np.median([len(x) for x in lines if x.strip()] or [1]))
        names = self.names(own)
        out = []
        # a single line is no page and has nothing that runs above or below it
        page = sum(bool(x.strip()) for x in lines) > 1
        for i, line in enumerate(lines):
            if not line.strip():
                out.append("blank")
                continue
            if not page:
                out.append("text")
                continue
            f = line_features(lines, i, resembles(line, names), typical)
            score, kind = max((m.score(f), k) for k, m in self.models.items())
            out.append(kind if score > 0 else "text")
        return out


# ---------------------------------------------------------------- the editor


def difference(word: str, known: str) -> tuple[int, str, str]:
    """Position, wrong and right signs that part two words."""
    i = 0
    while i < min(len(word), len(known)) and word[i] == known[i]:
        i += 1
    j = 0
    while j < min(len(word), len(known)) - i and word[-1 - j] == known[-1 - j]:
        j += 1
    return i, word[i : len(word) - j], known[i : len(known) - j]


def holes(word: str) -> set[str]:
    """The word with none, one or two neighbouring signs left out; words that one edit parts share one."""
    return {f"{word[:i]}\0{word[i + k :]}" for k in (0, 1, 2) for i in range(len(word) - k + 1)}


class Editor:
    """Averaged perceptrons that choose among the edits of a word, and among the ways of joining a broken one."""

    def __init__(self, usual: dict[str, list[str]], total: int = 1_000_000):
        self.usual = usual
        self.total = max(total, 1)
        self.model = Perceptron()
        self.joiner = Perceptron()

    def rate(self, n: float) -> int:
        """How often a word is met in clean text: 0 for never, else by powers of four a hundred million words."""
        return 0 if n < 1 else 1 + int(math.log(n * 1e8 / self.total + 1, 4))

    def edits(self, word: str) -> Iterator[tuple[int, str, str]]:
        """(position, wrong, right) of the usual confusions."""
        for i in range(len(word) + 1):
            for k in (0, 1, 2):
                if i + k <= len(word):
                    for right in self.usual.get(word[i : i + k], ()):
                        yield i, word[i : i + k], right

    def twice(self, word: str) -> set[str]:
        """What two edits by usual confusions make of a word."""
        out = set()
        for i, wrong, right in self.edits(word):
            made = word[:i] + right + word[i + len(wrong) :]
            out |= {made[:j] + r + made[j + len(w) :] for j, w, r in self.edits(made) if j >= i + len(right)}
        return out - {word}

    def features(self, word: str, known: str, own: float, n: float, rivals: int) -> list:
        i, wrong, right = difference(word, known)
        j = i + len(wrong)
        p, x = (word[i - 1 : i] or "^"), (word[j : j + 1] or "$")
        kind = "insert" if not wrong else "delete" if not right else "replace"
        t, o = self.rate(n), self.rate(own)
        odd = not wrong.isalpha() if wrong else False
        f = ["bias", kind, (wrong, right), (wrong, right, p), (wrong, right, "", x), ("rate", t), ("own", o), ("rates", o > 0, t), ("odd", odd), ("rivals", min(rivals, 3)), ("length", min(len(word), 9))]
        return [*f, ("kind", kind, o > 0), ("inside", "-" in word, odd), ("more", min(max(t - o, -1), 5), o > 0)]

    def choose(self, word: str, own: float, found: list[tuple[str, float]]) -> tuple[str, float] | None:
        """The candidate (known word, times met) that scores best, or None where keeping the word is best."""
        best, top = None, 0.0
        for known, n in sorted(found):
            s = self.model.score(self.features(word, known, own, n, len(found)))
            if s > top:
                best, top = (known, n), s
        return best

    def choose_twice(self, word: str, found: list[tuple[str, float]]) -> tuple[str, float] | None:
        """The same where two edits lead to the known word, each of which has to beat keeping."""
        best, top = None, 0.0
        for known, n in sorted(found):
            for i, wrong, right in self.edits(word):
                made = word[:i] + right + word[i + len(wrong) :]
                j, w, r = difference(made, known)
                if made == known or j < i or r not in self.usual.get(w, ()):
                    continue
                s = [self.model.score(self.features(x, y, 0, n, len(found))) for x, y in ((word, made), (made, known))]
                if min(s) > 0 and sum(s) > top:
                    best, top = (known, n), sum(s)
        return best

    def fit(self, rows: list[tuple[str, float, list[tuple[str, float]], str | None]], epochs: int = 4) -> None:
        """Rows (word, times met elsewhere, candidates, right word or None to keep it)."""
        rng = np.random.default_rng(4)
        made = [([(k, self.features(w, k, own, n, len(found))) for k, n in sorted(found)], right) for w, own, found, right in rows if found]
        for _ in range(epochs):
            for r in rng.permutation(len(made)).tolist() if made else []:
                options, right = made[r]
                scored = [(self.model.score(f), k, f) for k, f in options]
                top = max(scored, key=lambda x: x[0])
                chosen = top[1] if top[0] > 0 else None
                if chosen != right:
                    if chosen is not None:
                        self.model.learn(top[2], -1)
                    for s, k, f in scored:
                        if k == right:
                            self.model.learn(f, 1)
                self.model.tick()
        self.model.average()

    # -- joins

    def join_features(self, sign: str, forms: dict[str, str], after: str, known: "Known", blind: bool = False) -> dict[str, list]:
        """Features of each way: ``join`` without the sign, ``compound`` with it."""
        r = {k: min(self.rate(known.times(w)), 8) for k, w in forms.items()}
        mends = {k: known.mended(forms[k]) is not None for k in ("whole", "compound", "last")}
        base = [("sign", sign), ("capital", after[:1].isupper()), ("digit", after[:1].isdigit()), ("head", r["head"] > 0, r["tail"] > 0), ("sides", sign, r["head"] > 0, r["tail"] > 0), ("short", len(forms["tail"]) < 3)]
        if not blind:
            base += [("known", r["whole"] > 0, r["compound"] > 0), ("more", (r["whole"] > r["compound"]) - (r["whole"] < r["compound"])), ("last", r["last"] > 0), ("mends", mends["whole"], mends["compound"], mends["last"], sign)]
        return {way: [("way", way), *((way, *f) for f in base)] for way in ("join", "compound")}

    def fit_joins(self, rows: list[tuple[dict[str, list], dict[str, list], str]], epochs: int = 5) -> None:
        rng = np.random.default_rng(5)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)).tolist() if rows else []:
                seen, blind, right = rows[k]
                # every other time without the words, so that the signs and sides are learned too
                f = blind if rng.random() < 0.5 else seen
                scored = {way: self.joiner.score(x) for way, x in f.items()}
                other = "compound" if right == "join" else "join"
                if scored[right] <= max(scored[other], 0):
                    self.joiner.learn(f[right], 1)
                    self.joiner.learn(f[other], -1)
                self.joiner.tick()
        self.joiner.average()

    def way(self, sign: str, forms: dict[str, str], after: str, known: "Known") -> str | None:
        """``join``, ``compound``, or None where the line is left as it is."""
        scored = [(self.joiner.score(f), way) for way, f in self.join_features(sign, forms, after, known).items()]
        top = max(scored)
        return top[1] if top[0] > 0 else None


class Known:
    """What is known of a page's words: times met in clean text, and the mended form with its first place."""

    def __init__(self, rows: list[tuple[str, float, str | None]], frequent: dict[str, int]):
        self.rows = {w: (n, m) for w, n, m in rows}
        self.frequent = frequent

    def times(self, w: str) -> float:
        return self.frequent.get(w) or self.rows.get(w, (0, None))[0]

    def mended(self, w: str) -> tuple[str, int] | None:
        m = self.rows.get(w, (0, None))[1]
        return (m, difference(w, m)[0]) if m else None

    def misread(self, token: str) -> tuple[str, str] | None:
        """The form of a token that is misread and what it is mended to."""
        for low in spellings(token):
            if low in self.frequent:
                continue
            parts = low.split("-")
            if len(parts) > 1 and all(len(p) < 3 or self.times(p) > 1 for p in parts):
                continue
            m = self.mended(low)
            if m is not None:
                return low, m[0]
            if len(parts) > 1:
                made = [self.mended(p) if len(p) > 3 and self.times(p) < 2 else None for p in parts]
                if any(made):
                    return low, "-".join(m[0] if m else p for p, m in zip(parts, made))
        return None


def _like(new: str, old: str) -> str:
    """``new`` in the case of ``old``."""
    return new.upper() if len(old) > 1 and old.isupper() else new.capitalize() if old[:1].isupper() else new


def examine(content: str, own: list[str], furniture: Furniture, editor: Editor, known: Known) -> tuple[list[tuple[int, str]], str]:
    """(line number from 1, kind) of every finding, and the text in continuous paragraphs."""
    lines = content.split("\n")
    kinds = furniture.kinds(content, own)
    found: list[tuple[int, str]] = [(i + 1, k) for i, k in enumerate(kinds) if k in Furniture.KINDS]
    body = [i for i, k in enumerate(kinds) if k == "text"]
    join: dict[int, tuple[str, int]] = {}
    misread: set[int] = set()
    mended: dict[tuple[int, int], str] = {}
    for a, b in zip(body, [*body[1:], -1]):
        if not _BREAK.search(lines[a]):
            continue
        _, _, sign, head, _ = next(broken([lines[a]]))
        after = lines[b].split()[0] if b >= 0 else ""
        if b < 0:
            if sign in "¬­":
                found.append((a + 1, "hyphen"))
            continue
        forms = joined_forms(head, after)
        way = editor.way(sign, forms, after, known)
        if way is None:
            continue
        if way == "join":
            found.append((a + 1, "hyphen"))
        join[a] = ("" if way == "join" else "-", b)
        name = "whole" if way == "join" else "compound"
        m = known.mended(forms[name]) if known.times(forms[name]) < 2 else None
        shift = 0
        if m is None and forms["last"] != forms["whole"] and known.times(forms["last"]) < 2:
            m, shift = known.mended(forms["last"]), len(head) - len(head.rsplit("-", 1)[-1])
        elif m is not None:
            # the mended word stands on the first line
            last = len(lines[a].split()) - 1
            left = lines[a].split()[last].rstrip("-‐¬­")
            core = left.lstrip(_STRIP)
            mended[a, last] = left[: len(left) - len(core)] + _like(m[0], core[:1] if not core.isupper() else core)
            mended[b, 0] = after[len(after.rstrip(_STRIP)) :]
            join[a] = ("", b)
        if m is not None:
            misread.add(a if m[1] + shift < len(head) else b)
    joined = set(join)
    after_join = {b for _, b in join.values()}
    for i in body:
        toks = lines[i].split()
        for k, t in enumerate(toks):
            if (k == len(toks) - 1 and i in joined) or (k == 0 and i in after_join):
                continue
            m = known.misread(t)
            if m is not None:
                misread.add(i)
                at = t.lower().find(m[0])
                mended[i, k] = t[:at] + _like(m[1], t[at : at + len(m[0])]) + t[at + len(m[0]) :]
    found += [(i + 1, "misread") for i in sorted(misread)]
    # continuous paragraphs
    out: list[str] = []
    glue, prev = "", None
    for i in body:
        toks = [x for x in (mended.get((i, k), t) for k, t in enumerate(lines[i].split()))]
        if not toks:
            continue
        new = prev is not None and any(kinds[j] == "blank" for j in range(prev + 1, i)) and prev not in joined or lines[i].startswith("   ") and prev is not None and prev not in joined
        sep = "\n\n" if new else glue if prev is not None else ""
        line = " ".join(toks)
        if i in joined:
            line = re.sub(r"[-‐¬­]+$", "", line)
            glue = join[i][0]
        else:
            glue = " "
        out += [sep, line]
        prev = i
    return sorted(found), "".join(out)


# ---------------------------------------------------------------- Spark


def _neighbours(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(w, k, n, wrong, right): the words of clean text that one edit parts from each word.

    Words and vocabulary meet by the holes that leaving out signs makes, hashed to 64 bits and compared after.
    """

    def holed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for c in range(0, len(whole), 2000):
                b = whole.iloc[c : c + 2000]
                of = [holes(w) for w in b["w"]]
                size = [len(x) for x in of]
                h = pd.util.hash_array(np.array([x for xs in of for x in xs], dtype=object), categorize=False).view(np.int64) if sum(size) else np.zeros(0, np.int64)
                yield pd.DataFrame({"h": h, "w": np.repeat(b["w"].to_numpy(dtype=object), size), "n": np.repeat(b["n"].to_numpy(), size)})

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [difference(w, k) for w, k in zip(b["w"], b["k"])]
            out = b.assign(wrong=[x[1] for x in d], right=[x[2] for x in d])
            n = out["wrong"].str.len() + out["right"].str.len()
            yield out[(n > 0) & (n < 4) & (out["wrong"].str.len() < 3) & (out["right"].str.len() < 3)]

    fit = F.length("w").between(4, 30)
    a = words.where(fit).select("w", F.lit(0).cast("bigint").alias("n")).mapInPandas(holed, "h bigint, w string, n bigint").select("h", "w")
    b = vocab.where(fit & (F.col("n") > 1)).select("w", "n").mapInPandas(holed, "h bigint, w string, n bigint").select("h", F.col("w").alias("k"), "n")
    met = a.join(b, "h").where("w <> k").select("w", "k", "n").distinct()
    return met.mapInPandas(parted, "w string, k string, n bigint, wrong string, right string")


def _mined(met: DataFrame) -> DataFrame:
    """(w, right_word, wrong, right) of the words that exactly one neighbour explains, by a single sign first."""
    one = (F.length("wrong") == 1) & (F.length("right") == 1)
    x = F.struct("k", "wrong", "right")
    per = met.groupBy("w").agg(F.sum(one.cast("int")).alias("n1"), F.count("*").alias("n"), F.max(F.when(one, x)).alias("x1"), F.max(x).alias("x"))
    pick = F.when(F.col("n1") == 1, F.col("x1")).when((F.col("n1") == 0) & (F.col("n") == 1), F.col("x"))
    return per.select("w", pick.alias("p")).where("p IS NOT NULL").select("w", F.col("p.k").alias("right_word"), "p.wrong", "p.right")


def _twice(words: DataFrame, vocab: DataFrame, editor: Editor) -> DataFrame:
    """(w, own, found): words with what two usual confusions make of them and clean text has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for c in range(0, len(whole), 500):
                rows = [(w, x) for w in whole["w"].iloc[c : c + 500] for x in sorted(editor.twice(w))]
                yield pd.DataFrame(rows, columns=["w", "k"])

    made = words.select("w").mapInPandas(run, "w string, k string")
    met = made.join(vocab.select(F.col("w").alias("k"), "n"), "k")
    return met.groupBy("w").agg(F.collect_list(F.struct("k", "n")).alias("found")).select("w", F.lit(0).cast("bigint").alias("own"), "found")


def _chosen(found: DataFrame, editor: Editor, twice: bool = False) -> DataFrame:
    """(w, m): words that the editor does not keep, and what it makes of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for w, own, f in zip(b["w"], b["own"], b["found"]):
                known = [(x["k"], x["n"]) for x in f]
                best = editor.choose_twice(w, known) if twice else editor.choose(w, own, known)
                if best:
                    rows.append((w, best[0]))
            yield pd.DataFrame(rows, columns=["w", "m"])

    return found.mapInPandas(run, "w string, m string")


def _sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most ``n`` of ``total`` rows, least hash of the key first.

    Rows whose hash is far beyond the n-th are dropped first, so that no task hands on more than its share.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * n:
        df = df.where(h < int((1 << 40) * 2 * n / total))
    return df.orderBy(h, key).limit(n)


def repair(pages: DataFrame, clean: DataFrame, text: str = "content") -> DataFrame:
    """(rec_id, line_no, kind, text): one row per finding, and one with kind ``text`` and line 0 for the repaired page.

    ``pages``: rec_id, content, sure (known to be scanned), title, journal; ``clean``: all texts that are no scans.
    """
    sc = pages.sparkSession.sparkContext
    vocab = checkpoint(vocabulary(clean, text))
    total = vocab.agg(F.sum("n")).first()[0] or 0
    frequent = {r["w"]: r["n"] for r in vocab.where(F.col("n") >= max(2.0, FREQUENT * total)).collect()}
    common = sc.broadcast(frequent)

    def scans_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[bool(s) or is_scan(c) for c, s in zip(b["content"], b["sure"])]]

    kinds = "rec_id string, content string, sure boolean, title string, journal string"
    pages = checkpoint(pages.select("rec_id", "content", "sure", "title", "journal").mapInPandas(scans_only, kinds))

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, w, x, y) for r, c in zip(b["rec_id"], b["content"]) for w, (x, y) in lookups(c, common.value.keys()).items()]
            yield pd.DataFrame(rows, columns=["rec_id", "w", "always", "plain"])

    asks = checkpoint(pages.mapInPandas(asked, "rec_id string, w string, always boolean, plain boolean"))
    own = F.coalesce("n", F.lit(0)).alias("own")
    words = checkpoint(asks.groupBy("w").agg(F.max("always").alias("always"), F.max("plain").alias("plain")).join(vocab, "w", "left").select("w", "always", "plain", own))
    # words of clean text, which are to be kept, with the times they are met elsewhere
    long = vocab.where(F.length("w") > 3)
    kept = checkpoint(_sample(long, "w", TRAIN_WORDS, long.count()).select("w", (F.col("n") - 1).alias("own")))
    met = checkpoint(_neighbours(words.select("w").unionByName(kept.select("w")).distinct(), vocab))
    mined = checkpoint(_mined(met.join(words.where("own = 0 AND plain").select("w"), "w")))
    often = mined.groupBy("wrong", "right").agg(F.count("*").alias("n"))
    letters = r"^\p{L}+$"
    # a confusion is met in several words, or puts a digit or a mark for a letter
    ops = often.where((F.col("n") >= LEAST_MET) | (~F.col("wrong").rlike(letters) & (F.col("wrong") != "") & F.col("right").rlike(letters))).collect()
    usual: dict[str, list[str]] = defaultdict(list)
    for r in sorted(ops, key=lambda r: (r["wrong"], r["right"])):
        if r["n"] >= max(LEAST_MET, USUAL * sum(x["n"] for x in ops)):
            usual[r["wrong"]].append(r["right"])
    editor = Editor(dict(usual), total)
    signs = [f"{r['wrong']}\0{r['right']}" for r in ops]
    allowed = met.where(F.concat("wrong", F.lit("\0"), "right").isin(signs) if signs else F.lit(False))
    found = checkpoint(allowed.groupBy("w").agg(F.collect_list(F.struct("k", "n")).alias("found")))

    # weights from bounded samples
    wrong = _sample(found.join(mined.select("w", F.col("right_word").alias("right")), "w"), "w", TRAIN_WORDS, mined.count()).select("w", F.lit(0).cast("bigint").alias("own"), "found", "right")
    right = found.join(kept, "w").select("w", "own", "found", F.lit(None).cast("string").alias("right"))
    rows = [(r["w"], r["own"], [(x["k"], x["n"]) for x in r["found"]], r["right"]) for r in [*wrong.collect(), *right.collect()]]
    rows.sort(key=lambda r: (r[0], r[3] or ""))
    editor.fit(rows)
    first = _chosen(found.join(words.select("w", "own"), "w").select("w", "own", "found"), editor)
    # words that no single edit makes a word of clean text may have two misread signs
    rest = words.where("own = 0 AND plain AND length(w) > 5").join(found.select("w"), "w", "left_anti")
    second = _chosen(_twice(rest, vocab, editor), editor, twice=True)
    mends = checkpoint(first.unionByName(second))
    told = words.join(mends, "w", "left").where("m IS NOT NULL OR (always AND own > 0)").select("w", "own", "m")
    # at most a row for each word of a page
    per = asks.select("rec_id", "w").join(told, "w").groupBy("rec_id").agg(F.collect_list(F.struct("w", "own", "m")).alias("known"))
    whole = pages.join(per, "rec_id", "left")

    share = 1.0 / 500
    n_pages = pages.count()
    journals = [r[0] for r in pages.where("journal IS NOT NULL").groupBy("journal").count().where(F.col("count") >= max(5, share * n_pages)).orderBy("journal").collect()]
    furniture = Furniture(journals)
    sample = [(r["content"], [x for x in (r["title"], r["journal"]) if x], r["known"]) for r in _sample(whole, "rec_id", TRAIN_PAGES, n_pages).collect()]
    furniture.fit([(c, n) for c, n, _ in sample])
    joins = []
    for content, _, k in sample:
        known = Known([(x["w"], x["own"], x["m"]) for x in k or []], frequent)
        for _, _, sign, head, after in broken(content.split("\n")):
            forms = joined_forms(head, after)
            one, two = known.times(forms["whole"]) > 1, known.times(forms["compound"]) > 1
            if one != two:
                joins.append((editor.join_features(sign, forms, after, known), editor.join_features(sign, forms, after, known, True), "join" if one else "compound"))
    editor.fit_joins(joins)
    shared = sc.broadcast((furniture, editor))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        furniture, editor = shared.value
        for b in batches:
            out = []
            for r, c, t, j, k in zip(b["rec_id"], b["content"], b["title"], b["journal"], b["known"]):
                known = Known([(x["w"], x["own"], x["m"]) for x in (k if k is not None else [])], common.value)
                found, text = examine(c, [x for x in (t, j) if x], furniture, editor, known)
                out += [(r, n, kind, None) for n, kind in found]
                out.append((r, 0, "text", text))
            yield pd.DataFrame(out, columns=["rec_id", "line_no", "kind", "text"])

    return whole.select("rec_id", "content", "title", "journal", "known").mapInPandas(run, "rec_id string, line_no int, kind string, text string")
