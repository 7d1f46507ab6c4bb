"""Markup to clean text with a tree-structured graphical model.

A text is read into a tree: the page, its nodes (candidate headings, list
items, code, formulas) and, inside them, inline nodes.  The hidden state of the
page is its dialect, that of a node what produced it; parent-child potentials
connect them and each node emits its surface form.  Potentials are learned from
labelled pages (:func:`labelled_pages`, written by rule), and sum-product messages sent upward
and downward give the marginal of every node, which decides what it is: ``#``
before a line is a heading in one dialect, a list item in another and nothing
in plain text.

Defined results: null and empty texts have no markup and stay as they are.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIALECTS = ("plain", "html", "markdown", "wiki", "latex", "bare", "wrapped")
#: What the page of a text, and what a field that holds one formula may be.
OF_TEXT, OF_FORMULA = DIALECTS[:5], DIALECTS[5:]
KINDS = ("text", "inline", "heading", "list_item", "code", "formula")

_TOKENS = re.compile(
    r"""
      (?P<comment><!--.*?-->)
    | (?P<html_pre><pre\b[^>]*>.*?</pre\s*>|<code\b[^>]*>.*?</code\s*>)
    | (?P<wiki_code><(?:syntaxhighlight|source)\b[^>]*>.*?</(?:syntaxhighlight|source)\s*>)
    | (?P<md_fence>^(?P<f>```+|~~~+)[^\n]*\n.*?^(?P=f)[ \t]*$)
    | (?P<tex_code>\\begin\{(?P<c>lstlisting|verbatim\*?|minted)\}.*?\\end\{(?P=c)\})
    | (?P<tex_env>\\begin\{(?P<e>(?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)\*?)\}.*?\\end\{(?P=e)\})
    | (?P<math_tag><math\b[^>]*>.*?</math\s*>|<script\b[^>]*math/tex[^>]*>.*?</script\s*>)
    | (?P<wiki_math>\{\{math\s*\|(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}\})
    | (?P<dollars>\$\$.+?\$\$)
    | (?P<brackets>\\\[.+?\\\])
    | (?P<parens>\\\(.+?\\\))
    | (?P<dollar>(?<![\\$\w])\$(?![\s$])[^$\n]*?(?<![\s\\])\$(?![\d$]))
    | (?P<html_heading><h[1-6]\b[^>]*>(?P<ht>.*?)</h[1-6]\s*>)
    | (?P<tex_heading>\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?\{(?P<tt>(?:[^{}]|\{[^{}]*\})*)\})
    | (?P<wiki_heading>^(?P<w>={1,6})[ \t]*(?P<wt>[^=\n][^\n]*?)[ \t]*(?P=w)[ \t]*$)
    | (?P<setext>^(?P<st>[^\s\-=#*+][^\n]*)\n(?:={3,}|-{3,})[ \t]*$)
    | (?P<hashes>^\#{2,6}[ \t]+(?P<h2>[^\n]+?)[ \t]*\#*[ \t]*$)
    | (?P<hash>^\#[ \t]+(?P<h1>[^\n]+?)(?P<closing>[ \t]+\#+)?[ \t]*$)
    | (?P<html_item><li\b[^>]*>)
    | (?P<tex_item>\\item\b(?:\[[^\]]*\])?)
    | (?P<stars>^(?:\*{2,}|[*\#]{2,}|:+)[ \t]+(?=\S))
    | (?P<star>^[ \t]*\*[ \t]+(?=\S))
    | (?P<dash>^[ \t]*[-+][ \t]+(?=\S))
    | (?P<number>^[ \t]*\d{1,3}[.)][ \t]+(?=\S))
    | (?P<tex_block>\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]]*\])?)
    | (?P<wiki_ref><ref\b[^>]*?(?:/>|>.*?</ref\s*>))
    | (?P<html_tag></?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>)
    | (?P<entity>&(?:[a-zA-Z]{2,8}|\#\d{1,6}|\#x[0-9a-fA-F]{1,6});)
    | (?P<md_image>!\[(?P<im>[^\]\n]*)\]\([^)\n]*\))
    | (?P<md_link>(?<![\w!])\[(?P<ln>[^\]\n]+)\]\((?P<url>[^)\n]*)\))
    | (?P<wiki_link>\[\[(?:[^\[\]|\n]*\|)?(?P<wl>[^\[\]\n]*)\]\])
    | (?P<template>\{\{[^{}\n]*\}\})
    | (?P<wiki_quote>(?P<q>'{2,5})(?P<qt>[^'\n](?:[^'\n]|'(?!'))*?)(?P=q))
    | (?P<md_strong>(?P<b>\*\*|__|~~)(?P<bt>[^\s*_~](?:[^\n]*?[^\s])?)(?P=b))
    | (?P<md_code>(?P<bq>`+)(?P<ct>[^`\n]+)(?P=bq))
    | (?P<md_em>(?<![\w*])\*(?P<et>[^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])|(?<![\w_])_(?P<ut>[^\s_](?:[^_\n]*[^\s_])?)_(?![\w_]))
    | (?P<tex_style>\\(?:textbf|textit|textsc|texttt|emph|underline|text|mbox)\{(?P<xt>[^{}]*)\})
    | (?P<tex_note>~?\\(?:footnote|cite[a-z]*|label|ref|eqref|index|url|caption)\*?(?:\[[^\]]*\])?\{[^{}]*\})
    | (?P<tex_sign>\\[,;!]|\\[%&$\#_{}]|(?<=\S)~(?=\S))
    | (?P<tex_command>\\[a-zA-Z]{2,}\b\*?)
    """,
    re.X | re.S | re.M | re.I,
)
#: Where a token may begin.
_START = re.compile(r"[<&\\$*_`#~{]|\[\[?|''|!\[|^[ \t]*(?:[-*+=]|\d{1,3}[.)])|^[^\n]+\n(?=(?:={3,}|-{3,})[ \t]*$)", re.M)
_OUTER = frozenset("html_heading tex_heading wiki_heading setext hashes hash html_item tex_item stars star dash number md_fence tex_block".split())


@dataclass
class Node:
    form: str
    begin: int
    end: int
    inner: str = ""
    children: list["Node"] = field(default_factory=list)


def _form(m: re.Match, text: str) -> str:
    """What a node shows: the token and, where it matters, its surroundings."""
    f = next(n for n in _NAMES if m.group(n) is not None)
    near = "alone"
    if f in ("hash", "star", "dash", "number", "stars"):
        line_end = text.find("\n", m.start())
        line_end = len(text) if line_end < 0 else line_end
        line = text[m.start() : line_end]
        after = text[line_end + 1 : line_end + 200]
        before = text[max(0, m.start() - 200) : m.start()]
        mark = line.lstrip()[:1]
        sign = r"\d" if mark.isdigit() else re.escape(mark)
        prev_line = before[:-1].rpartition("\n")[2] if before.endswith("\n") else ""
        if re.match(rf"\s*{sign}", after.split("\n", 1)[0]) or (before and re.match(rf"\s*{sign}", prev_line)):
            near = "run"
        elif before.endswith("\n") and prev_line.strip():
            near = "in_text"
        if f in ("dash", "number", "star") and not re.search(r"[^\W\d_]", line):
            near = "no_word"
        if f == "hash" and m.group("closing"):
            near = "closed"
    if f == "html_tag":
        name = re.match(r"</?([a-zA-Z0-9]+)", m.group()).group(1).lower()
        return f"tag:{name}" if name in _COMMON_TAGS else "tag:other"
    return f"{f}:{near}" if near != "alone" or f in ("hash", "star", "dash", "number", "stars") else f


_NAMES = [n for n in _TOKENS.groupindex if len(n) > 2 and n != "closing" and n != "url"]
_COMMON_TAGS = frozenset("p div span b i em strong a ul ol li br sup sub table tr td th blockquote u s small".split())


def parse(text: str) -> list[Node]:
    """The tree of a text: its nodes in order, inline nodes under the node that holds them."""
    top: list[Node] = []
    parent: Node | None = None
    at = 0
    for start in _START.finditer(text):
        if start.start() < at:
            continue
        m = _TOKENS.match(text, start.start())
        if m is None:
            continue
        form = _form(m, text)
        node = Node(form, m.start(), m.end())
        base = form.split(":")[0]
        if base in _OUTER:
            top.append(node)
            parent = node
        elif parent is not None and "\n" not in text[parent.end : m.start()]:
            parent.children.append(node)
        else:
            top.append(node)
        at = m.end()
    return top


# ---------------------------------------------------------------- labelled pages

_VOCAB = "flow cell ion layer membrane поток слой режим мембрана опыт Strom Zelle Schicht courant canal flujo 电流 溶液".split()
_WRAPS = (
    "$@$", "$$@$$", "\\(@\\)", "\\[@\\]", "\\begin{equation}@\\end{equation}", "\\begin{align*}@\\end{align*}", "<math>@</math>", "<b>@</b>", "<i>@</i><br/>", "<span id='f'>@</span>", "<p>@</p>", "{{math|@}}",
    "@&nbsp;", "&#160;@", "@<sup>1</sup>", "@<!-- n -->",
)
_WRAPPING = dict.fromkeys(("dollar", "dollars", "brackets", "parens", "tex_env", "math_tag", "wiki_math"), "formula") | dict.fromkeys(("tag", "entity", "comment"), "inline")
_BARE = (r"\frac{\partial y_{n}}{\partial z}", r"\nabla \cdot \vec{u}", "a_{n}^2 < b_n", r"\sum_{i=1}^{n} w_i \varepsilon", r"\left( x, y \right) \; \quad z", r"\mathrm{K} \approx 2\,\text{m}", r"\alpha_n * \beta_n & c", r"\sqrt{n} \le \Delta", "p = q")
_FORMULAS = (r"j = -D \frac{\partial C}{\partial x}", r"Re = \frac{V H}{\nu}", r"k_{d} = 2 \cdot 10^{-6} C_{w}", "x^2 + y")


def labelled_pages(n: int = 840, seed: int = 7) -> Iterator[tuple[str, str, list[str]]]:
    """Pages written by rule, with the dialect and the kind of each node in order.

    They stand for hand-labelled pages: every construct of the five dialects
    and the harmless signs of plain text (comparisons, products, prices,
    numbered places, page numbers), alone and mixed.
    """
    rng = random.Random(seed)
    words = lambda k: " ".join(rng.choice(_VOCAB) for _ in range(k))

    def sentence(inline: dict[str, tuple[str, str]]) -> tuple[str, list[str]]:
        parts, labels = [words(4)], []
        for _ in range(rng.choice((0, 1, 1, 2)) if inline else 0):
            form = rng.choice(list(inline))
            kind, pattern = inline[form]
            parts.append(pattern.format(w=words(1), n=rng.randint(1, 99), f=rng.choice(_FORMULAS)))
            labels += [kind] * (2 if "</" in pattern and dialect == "html" and form in ("b", "i", "a", "em", "sup", "span") else 1)
            parts.append(words(3))
        return " ".join(parts) + ".", labels

    inline = {
        "plain": {},
        "html": {
            "b": ("inline", "<b>{w}</b>"), "i": ("inline", "<i>{w}</i>"), "nl": ("inline", "{w}<br>"), "num": ("inline", "{w}&#160;{n}"), "a": ("inline", '<a href="/{n}">{w}</a>'), "em": ("inline", "<em>{w}</em>"),
            "ent": ("inline", "{w}&nbsp;{n}"), "sup": ("inline", "{w}<sup>{n}</sup>"), "com": ("inline", "{w}<!-- p. {n} -->"),
            "span": ("inline", "<SPAN>{w}</SPAN>"), "math": ("formula", "<math>{f}</math>"), "par": ("formula", r"\({f}\)"), "br": ("formula", r"\[{f}\]"),
        },
        "markdown": {
            "b": ("inline", "**{w}**"), "u": ("inline", "__{w}__"), "s": ("inline", "~~{w}~~"), "l": ("inline", "[{w}](ref-{n}.md)"),
            "i": ("inline", "![{w}](fig{n}.png)"), "e": ("inline", "*{w}*"), "c": ("inline", "`{w}`"), "f": ("formula", "${f}$"), "d": ("formula", "$${f}$$"), "p": ("formula", r"\({f}\)"),
        },
        "wiki": {
            "b": ("inline", "'''{w}'''"), "i": ("inline", "''{w}''"), "l": ("inline", "[[{w} {w}|{w}]]"), "t": ("inline", "{{{{cite|{n}}}}}"),
            "r": ("inline", '<ref name="n{n}">note {n}</ref>'), "f": ("formula", "<math>{f}</math>"), "m": ("formula", "{{{{math|{f}}}}}"), "d": ("formula", '<math display="block">{f}</math>'),
        },
        "latex": {
            "b": ("inline", r"\textbf{{{w}}}"), "e": ("inline", r"\emph{{{w}}}"), "c": ("inline", r"~\cite{{k{n}}}"), "n": ("inline", r"\footnote{{{w}}}"),
            "p": ("inline", r"{n}\%"), "f": ("formula", "${f}$"), "d": ("formula", r"\[{f}\]"), "o": ("formula", r"\({f}\)"),
        },
    }

    def block(dialect: str) -> tuple[str, list[str]]:
        kind = rng.choice(("heading", "list", "code", "formula", "text", "text", "text"))
        title, f = words(2), rng.choice(_FORMULAS)
        k = rng.randint(1, 4)
        code = f"for k in range({k}):\n    if v[k] < {k}: total += v[k] * 2"
        if dialect == "plain":
            odd = rng.choice((
                "{w} is 3 < y < 9, and y > 7 {w}.", "lot # 27 at $ 88 a piece, 9 in sum", "the term u_max*v_0 is 7 [1, 2]", "parts K & M; the * is a footnote", "{w}\n- 91 -\n{w}", "{w} {w}\n12. {w} {w}", "{w}\n* {w}\n{w}",
                "{w}\n\n- 7 -\n{w}", "{w}\n- {w} {w}\n{w}", "costs $5 and 7$ more", "{w}\n5) {w}\n{w}", "- 12 -\n{w}", "{w}\n# 5 {w}\n{w}",
            ))
            # whatever looks like a node in plain text is text
            text = odd.replace("{w}", words(2))
            return text, ["text"] * len(list(_flat(parse(text))))
        if dialect == "bare":
            # formulas by themselves: their commands and signs are no markup
            text = " + ".join(rng.choice(_BARE).replace("n", str(rng.randint(1, 9))) for _ in range(rng.randint(1, 3)))
            return text, ["text"] * len(list(_flat(parse(text))))
        if dialect == "wrapped":
            # a formula inside what its source put around it; the formula's own commands and signs are no markup
            inner = " + ".join(rng.choice(_BARE).replace("n", str(rng.randint(1, 9))) for _ in range(rng.randint(1, 2)))
            text = rng.choice(_WRAPS).replace("@", inner)
            return text, [_WRAPPING.get(x.form.split(":")[0], "text") for x, _ in _flat(parse(text))]
        if kind == "text" and dialect in ("html", "latex") and rng.random() < 0.3:
            # signs at the begin of a line mean nothing where tags or commands mark lists and headings
            text = rng.choice(("{w}\n- 91 -\n{w}", "{w} {w}\n12. {w} {w}", "{w}\n* {w}\n{w}", "{w}\n- {w} {w}\n{w}", "{w}\n# 5 {w}\n{w}", "{w}\n5) {w}\n{w}")).replace("{w}", words(2))
            return text, ["text"] * len(list(_flat(parse(text))))
        if kind == "text":
            s, labels = sentence(inline[dialect])
            if dialect == "html" and rng.random() < 0.7:
                return f"<p>{s}</p>", ["inline", *labels, "inline"]
            return s, labels
        if kind == "heading":
            if dialect == "html":
                return rng.choice((f"<h2>{title}</h2>", f'<H1 id="s1">{title}</H1>')), ["heading"]
            if dialect == "markdown":
                return rng.choice((f"# {title}", f"# {title} #", f"## {title}", f"### {title} ###", f"{title}\n---------", f"{title}\n=====")), ["heading"]
            if dialect == "wiki":
                return rng.choice((f"== {title} ==", f"==== {title} ====")), ["heading"]
            return rng.choice((f"\\section{{{title}}}", f"\\subsection*{{{title}}}")), ["heading"]
        if kind == "list":
            items = [words(2) + f" (no. {rng.randint(1, 99)})" for _ in range(k)]
            if dialect == "html":
                tag = rng.choice(("ul", "ol"))
                end = rng.choice(("</li>", ""))
                body = "".join(f"\n<li>{x}{end}" for x in items)
                labels = ["inline"] + [y for _ in items for y in (["list_item", "inline"] if end else ["list_item"])] + ["inline"]
                return f"<{tag}>{body}</{tag}>", labels
            if dialect == "markdown":
                mark = rng.choice(("- ", "* ", "+ ", "1. ", "1) "))
                return "\n".join((f"{i + 1}{mark[1:]}" if mark[0] == "1" else mark) + x for i, x in enumerate(items)), ["list_item"] * k
            if dialect == "wiki":
                mark = rng.choice("*#")
                return "\n".join((mark * (2 if i and rng.random() < 0.3 else 1)) + " " + x for i, x in enumerate(items)), ["list_item"] * k
            env = rng.choice(("itemize", "enumerate"))
            return f"\\begin{{{env}}}\n" + "\n".join(f"\\item {x}" for x in items) + f"\n\\end{{{env}}}", ["inline", *["list_item"] * k, "inline"]
        if kind == "code":
            return {
                "html": rng.choice((f"<pre>{code}</pre>", f'<pre><code class="x">{code}</code></pre>')), "markdown": rng.choice((f"```\n{code}\n```", f"~~~\n{code}\n~~~", f"```text\n{code}\n```")),
                "wiki": f'<syntaxhighlight lang="c">\n{code}\n</syntaxhighlight>',
                "latex": rng.choice((f"\\begin{{lstlisting}}\n{code}\n\\end{{lstlisting}}", f"\\begin{{verbatim}}\n{code}\n\\end{{verbatim}}")),
            }[dialect], ["code"]
        return {
            "html": f"<math>{f}</math>", "markdown": f"$$\n{f}\n$$", "wiki": f"<math>{f}</math>",
            "latex": rng.choice((f"\\begin{{equation}}\n{f}\n\\end{{equation}}", f"\\begin{{align*}}\n{f}\n\\end{{align*}}", f"\\[{f}\\]")),
        }[dialect], ["formula"]

    for i in range(n):
        dialect = DIALECTS[i % len(DIALECTS)]
        blocks = [block(dialect) for _ in range(1 if dialect in OF_FORMULA else rng.randint(1, 5))]
        text, labels = "\n\n".join(b for b, _ in blocks), [x for _, ls in blocks for x in ls]
        # in plain text nodes may also come about where two pieces meet
        yield text, dialect, ["text"] * len(list(_flat(parse(text)))) if dialect == "plain" else labels


# ---------------------------------------------------------------- the model


def _flat(nodes: list[Node]) -> Iterator[tuple[Node, Node | None]]:
    for x in nodes:
        yield x, None
        for y in x.children:
            yield y, x


class TreeModel:
    """Log potentials: page dialect, page-node, node-child and node-surface form."""

    def __init__(self, smooth: float = 0.02):
        d, k = len(DIALECTS), len(KINDS)
        state = lambda dialect, kind: DIALECTS.index(dialect) * k + KINDS.index(kind)
        s = d * k  # a node's state: the dialect that produced it and what it is
        page = np.full(d, 1.0)
        edge = np.full((d, s), smooth)
        inner = np.full((s, s), smooth)
        forms: dict[str, np.ndarray] = {}
        for text, dialect, labels in labelled_pages():
            page[DIALECTS.index(dialect)] += 1
            nodes = list(_flat(parse(text)))
            if len(nodes) != len(labels):
                raise ValueError(f"labels do not fit the nodes of {text!r}")
            of = {id(node): state(dialect, kind) for (node, _), kind in zip(nodes, labels)}
            for node, parent in nodes:
                z = of[id(node)]
                if parent is None:
                    edge[DIALECTS.index(dialect), z] += 1
                else:
                    inner[of[id(parent)], z] += 1
                forms.setdefault(node.form, np.full(s, smooth))[z] += 1
        emitted = sum(forms.values())
        # the form's probability in each state; a form never met says nothing
        self.forms = {f: np.log(c / emitted) for f, c in forms.items()}
        self.unknown = np.zeros(s)
        self.page = np.log(page / page.sum())
        self.edge = np.log(edge / edge.sum(1, keepdims=True))
        self.inner = np.log(inner / inner.sum(1, keepdims=True))
        self.cache: dict[tuple, list[int]] = {}

    def marginals(self, nodes: list[Node], among: tuple[str, ...] = OF_TEXT) -> list[tuple[Node, np.ndarray]]:
        """Posterior of each node's state by one upward and one downward pass; the page is one of the dialects ``among``."""
        up_leaf, up_node = [], []
        root = self.page + np.array([0.0 if d in among else -1e9 for d in DIALECTS])
        for x in nodes:
            own = self.forms.get(x.form, self.unknown).copy()
            messages = []
            for y in x.children:
                e = self.forms.get(y.form, self.unknown)
                m = _lse(self.inner + e[None, :], 1)
                messages.append((e, m))
                own += m
            to_root = _lse(self.edge + own[None, :], 1)
            root += to_root
            up_leaf.append(messages)
            up_node.append((own, to_root))
        out = []
        for x, messages, (own, to_root) in zip(nodes, up_leaf, up_node):
            down = _lse((root - to_root)[:, None] + self.edge, 0)
            belief = own + down
            out.append((x, _normal(belief)))
            for y, (e, m) in zip(x.children, messages):
                out.append((y, _normal(e + _lse((belief - m)[:, None] + self.inner, 0))))
        return out

    def label(self, nodes: list[Node], among: tuple[str, ...] = OF_TEXT) -> list[str]:
        """The kind of each node in order of text."""
        key = (among, *((x.form, tuple(y.form for y in x.children)) for x in nodes))
        if key not in self.cache:
            if len(self.cache) > 20_000:
                self.cache.clear()
            kinds = [int(p.reshape(len(DIALECTS), len(KINDS)).sum(0).argmax()) for _, p in self.marginals(nodes, among)]
            self.cache[key] = kinds
        return [KINDS[i] for i in self.cache[key]]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _normal(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max())
    return p / p.sum()


@lru_cache(1)
def model() -> TreeModel:
    """Trained once in each worker; the pages are written by rule, so all agree."""
    return TreeModel()


_INNER = ("ht", "tt", "wt", "st", "h2", "h1", "im", "ln", "wl", "qt", "bt", "et", "ut", "xt")
_DELIMITERS = re.compile(
    r"^\s*(?:\$\$|\\\[|\\\(|\$|<[^<>]+>|\\begin\{[a-z]+\*?\}|\\label\{[^{}]*\}|\{\{math\s*\|)+\s*|\s*(?:\$\$|\\\]|\\\)|\$|<[^<>]+>|\\end\{[a-z]+\*?\}|\}\})\s*$", re.I
)


def bare_formula(raw: str) -> str:
    """A formula without delimiters, environments, tags, entities and templates."""
    x = raw
    for _ in range(4):
        y = re.sub(r"<!--.*?-->|<(su[pb])\b[^<>]*>\s*[*†‡\d]*\s*</\1>", "", x, flags=re.S | re.I)
        y = html.unescape(y).replace("\u00a0", " ")
        y = re.sub(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>", "", y)
        m = re.fullmatch(r"\s*\{\{\s*math\s*\|(.*)\}\}\s*", y, re.S | re.I)
        if m:
            y = m.group(1)
        m = re.fullmatch(r"\s*(?:\$\$(.*)\$\$|\\\[(.*)\\\]|\\\((.*)\\\)|\$([^$]*)\$)\s*", y, re.S)
        if m:
            y = next(g for g in m.groups() if g is not None)
        m = re.fullmatch(r"\s*\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*)\\end\{\1\}\s*", y, re.S)
        if m:
            y = m.group(2)
        y = re.sub(r"\\(?:label|tag)\{[^{}]*\}|\\(?:nonumber|notag)\b", "", y)
        if y.strip() == x:
            break
        x = y.strip()
    return x.strip()


def marked_formula(raw: str) -> bool:
    """Whether a raw formula has markup, by the marginals of its nodes."""
    nodes = parse(raw)
    return bool(nodes) and any(k != "text" for k in model().label(nodes, OF_FORMULA))


def convert(text: str) -> tuple[list[str], bool, str]:
    """Kinds of the structural elements in order, whether there is markup, clean text."""
    if not text:
        return [], False, text
    nodes = parse(text)
    if not nodes:
        return [], False, text
    kinds = model().label(nodes)
    flat = [x for x, _ in _flat(nodes)]
    found, out, at, marked = [], [], 0, False
    for node, kind in zip(flat, kinds):
        if kind == "text":
            continue
        marked = True
        out.append(text[at : node.begin])
        at = node.end
        piece = text[node.begin : node.end]
        m = _TOKENS.match(text, node.begin)
        inner = next((m.group(g) for g in _INNER if m and m.group(g) is not None), None)
        if kind != "inline":
            found.append(kind)
        if kind == "heading":
            out.append("# " + _plain(inner or piece.lstrip("# ")))
        elif kind == "list_item":
            if inner is not None:
                out.append("- " + _plain(inner))
            else:
                out.append("- ")
        elif kind == "code":
            body = re.sub(r"\A(?:<[^<>]+>|\\begin\{[^{}]*\}(?:\[[^\]]*\])?|(?:```+|~~~+)[^\n]*\n)+|(?:</[^<>]+>|\\end\{[^{}]*\}|```+|~~~+)+\s*\Z", "", piece)
            out.append("```\n" + (html.unescape(body) if piece.startswith("<") else body).strip("\n") + "\n```")
        elif kind == "formula":
            out.append("$" + bare_formula(piece) + "$")
        elif node.form == "entity":
            out.append(html.unescape(piece).replace("\u00a0", " "))
        elif node.form == "md_code":
            out.append(m.group("ct"))
        elif node.form == "tex_sign":
            out.append({"\\,": " ", "\\;": " ", "\\!": "", "~": " "}.get(piece, piece[1:]))
        elif inner is not None:
            out.append(inner)
    out.append(text[at:])
    clean = re.sub(r"[ \t]+\n", "\n", "".join(out))
    clean = re.sub(r"\n{3,}", "\n\n", clean).strip()
    return found, marked, clean if marked else text


def _plain(x: str) -> str:
    return re.sub(r"<[^<>]+>", "", html.unescape(x)).strip()


def clean(df: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """``key``, ``marked``, ``kinds`` of the elements in order and ``text`` without markup."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [convert(t) if t is not None else ([], False, None) for t in b["_text"]]
            yield pd.DataFrame({key: b[key], "marked": [r[1] for r in rows], "kinds": [r[0] for r in rows], "text": [r[2] for r in rows]})

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInPandas(run, f"{key} {kind}, marked boolean, kinds array<string>, text string")


def formulas(blocks: DataFrame) -> DataFrame:
    """``id``, ``raw`` and ``bare`` of each formula of ``blocks.formulas``, once per id.

    The model tells whether anything of the raw formula is markup; only then it is taken off.
    """
    rows = blocks.select(F.explode("formulas").alias("f")).select("f.id", "f.raw").where("id IS NOT NULL AND raw IS NOT NULL").dropDuplicates(["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(bare=[bare_formula(r) if marked_formula(r) else r.strip() for r in b["raw"]])

    return rows.mapInPandas(run, "id string, raw string, bare string")
