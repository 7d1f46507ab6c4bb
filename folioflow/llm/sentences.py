"""Sentence boundaries across languages and scripts, learned without supervision.

Per language, the corpus is counted once (:func:`statistics`): words with and
without a final period, what follows the period, and words that begin after a
sure end.  Log-likelihood ratios on these counts give abbreviations, sentence
starters and collocations of a number with the next word (:func:`learn`), and
each period is classified with them.  Counts are taken per million words, so
the lists do not change with the size of the corpus.  Scripts without periods
end at their own signs.  Nothing inside a pair of quotes or brackets is split.

Defined results: null, empty and blank texts have no sentences.  Offsets are
code points of the original text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_L = r"(?:[^\W\d_]|[\u0300-\u036F\u0900-\u0903\u093A-\u094F])"
_WORD = re.compile(_L + r"+(?:[.'’\-]" + _L + r"+)*|\d+(?:[.,–\-]\d+)*|[%°]")
_LAST = re.compile(_L + r"+(?:[.'’\-]" + _L + r"+)*\Z|\d+(?:[.,–\-]\d+)*\Z|[^\w\s]\Z")
#: A candidate end: closing signs, then what may follow.  Patterns begin with a set of signs, so that all others are passed over fast.
_END = re.compile(r"[.!?…。！？｡।॥\n](?:(?<=[.!?…])[.!?…]*|(?<=[。！？｡।॥])[。！？｡।॥]*|(?<=\n)[ \t]*\n)")
_OPEN = {"«": "»", "“": "”", "(": ")", "[": "]", "{": "}", "《": "》", "「": "」", "『": "』", "（": "）", "【": "】", "‹": "›"}
_CLOSERS = "»”“\"')]}》」』）】›"
# Dunning's reference rate of a period after an abbreviation, the least score of one,
# the least share of its periods that a sentence goes on after, the least score of a starter and of a collocation.
RATE, ABBREVIATION, GOES_ON, STARTER, COLLOCATION = 0.99, 0.3, 0.12, 6.0, 7.88
#: Signs on either side of a period whose words tell the language, and a word's least log-odds and occurrences a million words to do so.
AROUND, TELLING, PROFILE = 150, 1.0, 300.0
#: Occurrences from which on a language that has not learned a word denies it; the name under which rows of other languages are counted.
EVIDENCE, MIXED = 5, "other"


def brackets(text: str) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets; signs without a partner are no pair."""
    pairs, stack = [], []
    for m in re.finditer(r"[«»“”„\"()\[\]{}《》「」『』（）【】‹›]", text):
        c, i = m.group(), m.start()
        if c == '"':
            j = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if j is not None:
                pairs.append((stack[j][1], i))
                del stack[j:]
            else:
                stack.append(('"', i))
        elif c == "„":
            stack.append(("“”", i))
        elif c == "“" and any("“" in s[0] for s in stack):
            j = max(k for k in range(len(stack)) if "“" in stack[k][0])
            pairs.append((stack[j][1], i))
            del stack[j:]
        elif c in _OPEN:
            stack.append((_OPEN[c], i))
        else:
            j = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][0] and stack[k][0] != '"'), None)
            if j is not None:
                pairs.append((stack[j][1], i))
                del stack[j:]
    out: list[tuple[int, int]] = []
    for b, e in sorted(pairs):
        if not out or b > out[-1][1]:
            out.append((b, e))
    return out


def _token_begin(text: str, at: int) -> int:
    b = text.rfind(" ", 0, at) + 1
    return max(text.rfind("\n", b, at) + 1, b)


def _before(text: str, at: int) -> tuple[int, str]:
    """Place and text of the word or sign that ends at ``at``; the text is empty if there is none."""
    b = _token_begin(text, at)
    token = text[b:at]
    if token.isalpha():
        return b, token
    p = _LAST.search(text, b, at)
    return (p.start(), p.group()) if p else (b, "")


def _lower(word: str) -> bool:
    """Begins in lower case; ``pH`` and the like count as capitals."""
    return word[:1].islower() and not (len(word) > 1 and word[1:2].isupper())


ROLES = ("abbreviations", "starters", "ordinals")


class Lists:
    """What is learned of one language: abbreviations, sentence starters, words that follow a number with a period.

    ``denied``: by role, the words that another language knows and this one has evidence against.
    """

    def __init__(self, abbreviations: Iterable[str] = (), starters: Iterable[str] = (), ordinals: Iterable[str] = (), denied: dict[str, set[str]] | None = None):
        self.abbreviations, self.starters, self.ordinals = set(abbreviations), set(starters), set(ordinals)
        self.denied = denied or {}


class Rules:
    """Learned lists by language; classifies the candidate ends of a text.

    A word that one language has learned holds in all, except where a language
    has evidence against it.  Which language is spoken around a period, the
    words there tell (``profile``: word, language, log-odds), else the text's
    label does.
    """

    def __init__(self, lists: dict[str, Lists], profile: dict[str, dict[str, float]] | None = None):
        self.lists, self.profile = lists, profile or {}
        for role in ROLES:
            setattr(self, role, set().union(*(getattr(x, role) for x in lists.values())))
        self.deniers: dict[tuple[str, str], set[str]] = defaultdict(set)
        for g, x in lists.items():
            for role, words in x.denied.items():
                for w in words:
                    self.deniers[role, w].add(g)
        self.deniers = dict(self.deniers)

    def _language(self, text: str, at: int, label: str | None) -> str | None:
        """The language around a place of a text."""
        score: dict[str, float] = {}
        for w in _PLAIN.findall(text, max(0, at - AROUND), at + AROUND):
            for g, x in self.profile.get(w.lower(), {}).items():
                score[g] = score.get(g, 0.0) + x
        return max(sorted(score), key=score.__getitem__) if score else label

    def _in(self, role: str, word: str, text: str, at: int, label: str | None) -> bool:
        if word not in getattr(self, role):
            return False
        against = self.deniers.get((role, word))
        return not against or self._language(text, at, label) not in against

    def _period(self, text: str, at: int, after: int, label: str | None) -> bool:
        """Whether the period at ``at`` ends a sentence, the next sign being at ``after``."""
        n = len(text)
        nxt = text[after : after + 1]
        m = _WORD.match(text, after)
        word = m.group() if m else ""
        tight = after == at + 1
        # the word before the period: from its last sign backwards to a blank
        b, prev = _before(text, at)
        if not nxt:
            return True
        if not prev and nxt.isdigit():
            return False
        if tight and (nxt.isdigit() and prev[-1:].isdigit() or nxt in ",;:" or _lower(word)):
            return False
        if nxt in ",;:)]–-%" or (word and _lower(word)):
            return False
        caseless = bool(word) and word[0].isalpha() and not word[0].isupper() and not word[0].islower()
        follows_initial = len(word) == 1 and word.isupper() and text[m.end() : m.end() + 1] == "."
        before = text[max(0, b - 3) : b].rstrip() if prev else ""
        numbered = before[-1:].isdigit() or before[-1:] in "%"
        if len(prev) == 1 and prev.isupper():
            if tight and word[:1].isupper():
                return numbered
            if numbered:
                return True
            if nxt.isdigit() or follows_initial:
                return False
            return caseless or self._in("starters", word, text, at, label) or not word or (len(word) == 1 and word.isupper()) or nxt in "«“„\"(《"
        if prev[:1].isalpha():
            low = prev.lower()
            if tight and word[:1].isupper() and len(prev) < 3:
                return False
            if (len(prev) == 1 and not numbered) or self._in("abbreviations", low, text, at, label):
                if nxt.isdigit() or follows_initial or nxt in "(№#":
                    return False
                return self._in("starters", word, text, at, label) or nxt in "«“„"
            return True
        if prev[:1].isdigit() and not tight and self._in("ordinals", word, text, at, label) and not self._in("starters", word, text, at, label):
            return False
        return True

    def spans(self, text: str, label: str | None = None) -> list[tuple[int, int]]:
        """(begin, end) of the sentences; ``label`` is the language the text is said to have."""
        n = len(text)
        pairs = brackets(text)
        out: list[tuple[int, int]] = []
        begin = k = 0
        at = 0
        while at < n:
            m = _END.search(text, at)
            if m is None:
                break
            s, e = m.span()
            while k < len(pairs) and pairs[k][1] < s:
                k += 1
            inside = k < len(pairs) and pairs[k][0] < s < pairs[k][1]
            if text[s] == "\n":
                if not inside:
                    begin = self._cut(text, begin, s, out)
                at = e
                continue
            if inside:
                o, c = pairs[k]
                if e < c and text[e:c].strip() or m.group()[0] in "…" and False:
                    at = e
                    continue
                # the pair ends with the sign: the sentence may end with the pair
                e = c + 1
                while e < n and text[e] in _CLOSERS and text[e] not in "“":
                    e += 1
                after = self._next(text, e)
                if after >= n:
                    at = e
                    continue
                own = text[begin:o].strip() == ""
                x = text[after]
                if text[e : e + 1] in tuple(".!?。！？…।") or x in ",;:，、；：)":
                    at = e
                    continue
                cased = x.isupper() or x.isdigit() or x in "«“„\"(《¿¡"
                word = _WORD.match(text, after)
                mixed = word is not None and not _lower(word.group()) and x.islower()
                bracket = text[o] in "([{（【"
                ends = own and (cased or mixed or not x.islower()) or (not bracket and (x.isupper() or mixed) and text[c] not in "」』》")
                if ends and not (len(text[o:c]) < 3):
                    begin = self._cut(text, begin, e, out)
                at = e
                continue
            sign = m.group()
            while e < n and text[e] in "»”\"')]}》」』）】›" and not any(b == e for b, _ in pairs[k : k + 2]):
                e += 1
            after = self._next(text, e)
            if sign[0] in "。！？｡।॥":
                ends = True
            elif sign in ("…", "...", "……", "....", "......") or (len(sign) > 1 and set(sign) <= {".", "…"}):
                x = text[after : after + 1]
                word = _WORD.match(text, after)
                ends = not x or x.isupper() or (after > e and x.isdigit()) or (word is not None and x.islower() and not _lower(word.group()))
            elif sign == ".":
                ends = self._period(text, s, after, label)
            else:
                word = _WORD.match(text, after)
                x = text[after : after + 1]
                ends = not (word is not None and _lower(word.group())) and x not in tuple(",;:—–")
            if ends:
                begin = self._cut(text, begin, e, out)
            at = e
        self._cut(text, begin, n, out)
        return out

    @staticmethod
    def _next(text: str, at: int) -> int:
        n = len(text)
        while at < n and text[at].isspace():
            at += 1
        return at

    @staticmethod
    def _cut(text: str, begin: int, end: int, out: list[tuple[int, int]]) -> int:
        b, e = begin, end
        while b < e and text[b].isspace():
            b += 1
        while e > b and text[e - 1].isspace():
            e -= 1
        if e > b:
            out.append((b, e))
        return end


# ---------------------------------------------------------------- learning

#: Runs of capitals are codes such as NR-12 and no words.
_CAPITALS = re.compile(r"[A-ZА-ЯЁІЇЄҐ](?<!\w.)[A-ZА-ЯЁІЇЄҐ]+\b")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ORDINAL = re.compile(r"\d(?<![\w.,].)\d*\.\s+(?=[^\W\d_a-z])")


def count(texts: list[str], langs: list[str]) -> Counter:
    """Counts of a batch: (language, kind, word).  Words are tallied per text in one go; only periods are looked at singly."""
    into: dict[tuple[str, str, str], int] = defaultdict(int)
    met: dict[str, Counter] = {}
    for text, lang in zip(texts, langs):
        met.setdefault(lang, Counter()).update(_PLAIN.findall(_CAPITALS.sub(" ", text)))
        for m in _ORDINAL.finditer(text):
            nxt = _WORD.match(text, m.end())
            if nxt and nxt.group()[:1].isupper():
                into[lang, "ordinal", nxt.group()] += 1
                into[lang, "numbers", ""] += 1
        at = text.find(".")
        while at >= 0:
            dot, at, w = at, text.find(".", at + 1), _before(text, at)[1]
            if not w[:1].isalpha():
                continue
            low = w.lower()
            into[lang, "dots", ""] += 1
            after = Rules._next(text, dot + 1)
            nxt = _WORD.match(text, after)
            word = nxt.group() if nxt else ""
            if len(low) < 12:
                into[lang, "dot", low] += 1
                x = text[after : after + 1]
                initial = len(word) == 1 and word.isupper() and text[nxt.end() : nxt.end() + 1] == "."
                if x and (x.isdigit() or x in ",;:(№" or (word and _lower(word)) or initial or (word and len(low) > 1 and not word[0].isupper() and not word[0].islower())):
                    into[lang, "goes_on", low] += 1
                elif word and word[0].isupper():
                    into[lang, "then", f"{low} {word}"] += 1
            if len(low) > 4 and _lower(w) and word[:1].isalpha() and not _lower(word):
                into[lang, "sure", ""] += 1
                into[lang, "start", word] += 1
    dotted = [(lang, w, n) for (lang, kind, w), n in into.items() if kind == "dot"]
    for lang, c in met.items():
        into[lang, "all", ""] += sum(c.values())
        for w, n in c.items():
            low = w.lower()
            if len(low) < 12:
                into[lang, "bare", low] += n
            if w[0].isupper() and len(w) < 20:
                into[lang, "capital", w] += n
    for lang, w, n in dotted:
        if (lang, "bare", w) in into:
            into[lang, "bare", w] = max(0, into[lang, "bare", w] - n)
    return Counter(into)


def statistics(df: DataFrame, text: str, lang: str | None = None, name: Callable[[str | None], str | None] = lambda x: x) -> DataFrame:
    """(lang, kind, word, n) over all rows; counted per batch, then summed.

    ``lang`` names the column of the language as given, which ``name`` brings to
    one notation; rows without one are counted together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, name(g) or "") for t, g in zip(b["_text"], b["_lang"]) if t]
            c = count([t for t, _ in rows], [g for _, g in rows])
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["lang", "kind", "word", "n"])

    rows = df.select(F.col(text).cast("string").alias("_text"), (F.col(lang) if lang else F.lit("")).alias("_lang"))
    return rows.mapInPandas(run, "lang string, kind string, word string, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))


def _ll(k: float, n: float, p0: float, p1: float) -> float:
    f = lambda p: k * math.log(max(p, 1e-12)) + (n - k) * math.log(max(1 - p, 1e-12))
    return 2 * (f(p1) - f(p0))


def learn(stats: DataFrame) -> Rules:
    """Rules from the counts, language by language.

    Words reach the driver if they are met at least once or twice in a million
    words in the role they may have, so their number is bounded by the rate and
    not by the corpus.
    """
    stats = stats.persist()
    spark = stats.sparkSession
    totals = {(r["lang"], r["kind"]): r["n"] for r in stats.where("word = ''").collect()}
    million = "1e6 / greatest(w_all, 1)"
    base = stats.where("kind = 'all'").select("lang", F.col("n").alias("w_all"))
    per = stats.where("word <> '' AND kind <> 'then'").groupBy("lang", "word").pivot("kind", ["dot", "bare", "goes_on", "start", "capital", "ordinal"]).agg(F.sum("n")).na.fill(0).join(F.broadcast(base), "lang")
    # an abbreviation has the period nearly always; a starter is met after sure ends often; a profile is made of common words
    keep = per.where(f"(dot * {million} >= 2 AND dot >= 2 AND bare <= 3 * dot) OR (start >= 2 AND start * {million} >= 2 AND start * 20 >= capital) OR (ordinal >= 2 AND ordinal * {million} >= 2) OR bare * {million} >= {PROFILE}")
    rows = keep.collect()
    learned: dict[str, Lists] = defaultdict(Lists)
    for r in rows:
        words, sure = max(totals.get((r["lang"], "all"), 1), 1), max(totals.get((r["lang"], "sure"), 0), 1)
        if r["start"] >= 2:
            p0, p1 = min(r["capital"] / words, 0.9), r["start"] / sure
            if p1 > p0 and _ll(r["start"], sure, p0, p1) * min(1, 1e6 / words) > STARTER and r["start"] >= 0.05 * max(r["capital"], 1):
                learned[r["lang"]].starters.add(r["word"])
    # what follows the candidates' periods and is no starter counts as going on
    firsts = spark.createDataFrame([(g, w) for g, x in learned.items() for w in sorted(x.starters)], "lang string, next string")
    asked = spark.createDataFrame([(r["lang"], r["word"]) for r in rows if r["dot"] >= 2], "lang string, w string")
    then = stats.where("kind = 'then'").select("lang", F.split_part("word", F.lit(" "), F.lit(1)).alias("w"), F.split_part("word", F.lit(" "), F.lit(2)).alias("next"), "n")
    odd = then.join(F.broadcast(asked), ["lang", "w"], "left_semi").join(F.broadcast(firsts), ["lang", "next"], "left_anti").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    strange = {(r["lang"], r["w"]): r["n"] for r in odd.collect()}
    for r in rows:
        lang, w, dot, bare = r["lang"], r["word"], r["dot"], r["bare"]
        words, dots = max(totals.get((lang, "all"), 1), 1), totals.get((lang, "dots"), 0)
        scale = min(1e6 / words, 1.0)
        if dot >= 2:
            letters = len(w.replace(".", ""))
            ll = _ll(dot, dot + bare, dots / words, RATE) * scale
            score = ll * math.exp(-letters) * (w.count(".") + 1) * letters ** -(bare * scale / 3)
            goes_on = (r["goes_on"] + strange.get((lang, w), 0)) / dot
            if score >= ABBREVIATION and goes_on >= GOES_ON:
                learned[lang].abbreviations.add(w)
        if r["ordinal"] >= 2 and w not in learned[lang].starters:
            # a collocation with a number: more frequent after "5." than at the begin of a sentence explains
            numbers, sure = max(totals.get((lang, "numbers"), 0), 1), max(totals.get((lang, "sure"), 0), 1)
            p0, p1 = (r["start"] + 0.5) / (sure + 1), r["ordinal"] / numbers
            if p1 > p0 and _ll(r["ordinal"], numbers, p0, p1) * scale > COLLOCATION:
                learned[lang].ordinals.add(w)
    # evidence of a language against what another has learned
    known = {role: set().union(*(getattr(x, role) for x in learned.values())) for role in ROLES}
    every = spark.createDataFrame([(w,) for w in sorted(set().union(*known.values()))], "word string")
    for r in per.join(F.broadcast(every), "word", "left_semi").collect():
        lang, w, x = r["lang"], r["word"], learned[r["lang"]]
        for role, met in (("abbreviations", r["dot"] + r["bare"]), ("starters", r["capital"]), ("ordinals", r["capital"])):
            if lang and lang != MIXED and w in known[role] and w not in getattr(x, role) and met >= EVIDENCE and 1e6 * met / max(totals.get((lang, "all"), 1), 1) >= 2:
                x.denied.setdefault(role, set()).add(w)
    stats.unpersist()
    # words that tell languages apart: how much commoner than in all languages together
    rate: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows:
        if r["lang"] and r["lang"] != MIXED and r["bare"]:
            rate[r["word"]][r["lang"]] = 1e6 * r["bare"] / max(totals.get((r["lang"], "all"), 1), 1)
    n_langs = max(len({g for g, k in totals if k == "all" and g and g != MIXED}), 1)
    profile = {}
    for w, of in rate.items():
        mean = sum(of.values()) / n_langs
        telling = {g: math.log(x / mean) for g, x in of.items() if x >= PROFILE and math.log(x / mean) > TELLING}
        if telling and w[:1].isalpha():
            profile[w] = telling
    return Rules({g: learned[g] for g in sorted(learned)}, profile)


def split(df: DataFrame, key: str, text: str, rules: Rules, lang: str | None = None, name: Callable[[str | None], str | None] = lambda x: x) -> DataFrame:
    """``key``, ``sent_no`` from 1, ``begin_at``, ``end_at`` of every sentence; ``lang`` names the column of the language as given."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for b in batches:
            keys, no, begin, end = [], [], [], []
            for k, t, g in zip(b[key], b["_text"], b["_lang"]):
                for i, (x, y) in enumerate(rules.spans(t, name(g)) if t else []):
                    keys.append(k)
                    no.append(i + 1)
                    begin.append(x)
                    end.append(y)
            yield pd.DataFrame({key: pd.array(keys, dtype=b[key].dtype), "sent_no": pd.array(no, "int32"), "begin_at": pd.array(begin, "int32"), "end_at": pd.array(end, "int32")})

    rows = df.select(F.col(key), F.col(text).cast("string").alias("_text"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("_lang"))
    return rows.mapInPandas(run, f"{key} {kind}, sent_no int, begin_at int, end_at int")
