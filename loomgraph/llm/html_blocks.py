"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: the text between block-level tags, with character references decoded, white space
folded and scripts, styles and comments left out. Each block is a bag of hashed, weighted features: all tags, classes
and ids on its whole path, all its words (together they weigh as much as WORDS_WEIGH of them), its length and its link
share. A bidirectional LSTM in numpy reads the page's whole sequence of blocks and labels each one as main text or not,
so that every decision sees the whole document. The main blocks are joined in page order by an empty line.

The network is trained in the driver on made-up pages of many layouts (TRAINING_PAGES of them, from a fixed seed, in
double precision); no row of a table takes part. Null and empty inputs give no text; in a page without block-level
elements there is nothing to tell apart, so its whole text is the article. Repeated rows each give a row; extra columns
are ignored. Broken nesting and cut-off tags are tolerated: what can't stand in a head ends it, and an unclosed silent
element ends with its parent. Pages of more than WINDOW blocks are read window by window with the state carried on, so
that what the network holds doesn't follow a page's length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

#: Tags that end a block. Fixed values of the HTML vocabulary.
BLOCK_TAGS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that may stand in a head; any other ends it.
HEAD_TAGS = set("base basefont bgsound head html link meta noscript script style template title".split())
SILENT_TAGS = {"script", "style", "template", "svg", "math", "head", "title", "iframe", "object", "audio", "video", "canvas"}
#: A start tag of the key closes an open tag of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NAME_BUCKETS, PATH_BUCKETS, WORD_BUCKETS, SHAPE_BUCKETS = 4096, 4096, 1 << 15, 32
INPUTS = NAME_BUCKETS + PATH_BUCKETS + WORD_BUCKETS + SHAPE_BUCKETS
HIDDEN, WORDS_WEIGH = 16, 4
#: A word is a run of letters.
WORD = re.compile(r"[^\W\d_]+")
TRAINING_PAGES, EPOCHS, BATCH, SEED = 1600, 10, 24, 11
#: Blocks of a long page that the network reads at a time.
WINDOW = 4096
#: A feature takes part in training if so many made-up pages have it; input weights decay by DECAY of themselves a step.
FEW, DECAY = 20, 3e-4


@dataclass
class Block:
    """Text, the distinct names on its path from the root, those of its own element, the hash of the whole path, linked characters."""

    text: str
    path: tuple[str, ...]
    own: tuple[str, ...]
    whole: int
    linked: int


@dataclass(frozen=True)
class _Open:
    """An open element with what its path has had so far, so that a deep nesting costs no more than a flat one."""

    tag: str
    own: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    whole: int = 0


_ROOT = _Open("")


class _Blocks(HTMLParser):
    """Collects the leaf blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.blocks: list[Block] = []
        self.held: list[str] = []
        self.links = self.linked = self.silent = 0
        self.depth: dict[str, int] = {}

    def end_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            at = self.open[-1] if self.open else _ROOT
            self.blocks.append(Block(text, at.path, at.own, at.whole, self.linked))
        self.held, self.linked, self.links = [], 0, 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        up = self.open[-1] if self.open else _ROOT
        new = tuple(dict.fromkeys(n for n in names if n not in up.path))
        self.open.append(_Open(tag, names, up.path + new if new else up.path, zlib.crc32("/".join(names).encode("utf-8", "surrogatepass"), up.whole)))
        self.depth[tag] = self.depth.get(tag, 0) + 1
        self.silent += tag in SILENT_TAGS

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.depth[tag] -= 1
        self.silent -= tag in SILENT_TAGS
        return tag

    def end_head(self) -> None:
        while self.depth.get("head"):
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self.end_head()
        if not self.silent:
            if tag == "br":
                self.held.append(" ")
            elif tag == "a":
                self.links += 1
        if tag in VOID_TAGS or (tag not in BLOCK_TAGS and tag not in SILENT_TAGS):
            if tag in BLOCK_TAGS and not self.silent:
                self.end_block()
            return
        if not self.silent:
            self.end_block()
        shut = set() if tag in SILENT_TAGS else CLOSES.get(tag, set()) | {"p"} if tag != "option" else CLOSES[tag]
        while self.open and self.open[-1].tag in shut:
            self.pop()
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        self.push(tag, tuple(names))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if not self.depth.get(tag):
            return
        if not self.silent:
            self.end_block()
        while self.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if self.silent and self.open[-1].tag == "head" and data.strip():
            self.end_head()
        if not self.silent:
            self.held.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(re.sub(r"<[A-Za-z/!?][^<>]*\Z", "", html))
    parser.close()
    parser.end_block()
    return parser.blocks


def _word(word: str) -> int:
    return NAME_BUCKETS + PATH_BUCKETS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


@lru_cache(maxsize=65_536)
def _bucket(kind: str, name: str) -> int:
    h = zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass"))
    if kind == "name":
        return h % NAME_BUCKETS
    return NAME_BUCKETS + h % PATH_BUCKETS


#: A block's features: numbers with weights.
Bag = list[tuple[int, float]]


def features(page: list[Block], taught: bytes | None = None) -> list[Bag]:
    """The features of each block; with ``taught`` (a flag for each number) without words that training never saw, which say nothing."""
    out = []
    shape = NAME_BUCKETS + PATH_BUCKETS + WORD_BUCKETS
    for b in page:
        f = [(_bucket("name", x), 1.0) for x in b.path]
        if b.path:
            f += [(_bucket("leaf", b.own[-1]), 1.0), (_bucket("near", "/".join(b.own[-2:])), 1.0), (NAME_BUCKETS + b.whole % PATH_BUCKETS, 1.0)]
        words = dict.fromkeys(WORD.findall(b.text.lower()))
        if words:
            weight, numbers = min(1.0, WORDS_WEIGH / len(words)), [_word(w) for w in words]
            f += [(x, weight) for x in numbers if taught is None or taught[x]]
        size, share = len(b.text), b.linked / len(b.text)
        f.append((shape + min(11, int(np.log2(size + 1))), 1.0))
        f.append((shape + 12 + min(4, int(5 * share)), 1.0))
        f.append((shape + 20 + (b.text[-1] in ".!?…:;"), 1.0))
        out.append(f)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """A bidirectional LSTM over sequences of feature bags with a logistic output for each block.

    ``place`` is the row of each feature in the input weights; features that training never saw share a row of zeros.
    """

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.place = np.arange(INPUTS)
        self.w = {}
        for d in ("f", "b"):
            self.w[f"e{d}"] = np.zeros((INPUTS, 4 * h), np.float64)  # a feature that training never saw says nothing
            self.w[f"u{d}"] = (r.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float64)
            self.w[f"c{d}"] = np.repeat(np.float64([0, 1, 0, 0]), h)
        self.w["o"] = (r.standard_normal(2 * h) / np.sqrt(2 * h)).astype(np.float64)
        self.w["ob"] = np.zeros(1, np.float64)

    def taught(self) -> bytes:
        """A flag for each feature number: whether training saw it (shapes always count, so that no bag is empty)."""
        flags = self.place < len(self.w["ef"]) - 1
        flags[-SHAPE_BUCKETS:] = True
        return flags.astype(np.uint8).tobytes()

    def _layout(self, pages: list[list[Bag]]):
        lengths = np.array([len(p) for p in pages])
        bags = [f for p in pages for f in p]
        flat = self.place[np.fromiter((x for f in bags for x, _ in f), np.int64)]
        scale = np.fromiter((w for f in bags for _, w in f), np.float64)[:, None]
        sizes = np.array([len(f) for f in bags])
        t, b = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(pages)), lengths)
        return lengths, flat, scale, sizes, np.cumsum(sizes) - sizes, t, b, lengths[b] - 1 - t

    def _run(self, d: str, x: np.ndarray, t: np.ndarray, b: np.ndarray, steps: int, width: int, keep: bool):
        """Hidden states [step, page] for inputs placed at (t, b); padding comes after each page's end."""
        h = HIDDEN
        grid = np.zeros((steps, width, 4 * h), np.float64)
        grid[t, b] = x
        u = self.w[f"u{d}"]
        state, cell = np.zeros((width, h), np.float64), np.zeros((width, h), np.float64)
        states = np.zeros((steps + 1, width, h), np.float64)
        tape = []
        for s in range(steps):
            z = grid[s] + state @ u
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            states[s + 1] = state
            if keep:
                tape.append((i, f, o, g, before, squashed))
        return states, tape

    def chance_of_long(self, page: list[Block], taught: bytes | None = None, window: int = WINDOW) -> np.ndarray:
        """The same as ``chance`` for one page, with features and inputs of a window at a time; states are carried on."""
        n, h, z = len(page), HIDDEN, np.repeat(self.w["ob"], len(page))
        for d, weights in (("f", self.w["o"][:h]), ("b", self.w["o"][h:])):
            state = cell = np.zeros(h)
            u = self.w[f"u{d}"]
            for at in range(0, n, window):
                places = np.arange(at, min(n, at + window))
                places = places if d == "f" else n - 1 - places
                _, flat, scale, _, starts, *_ = self._layout([features([page[i] for i in places], taught)])
                states = np.empty((len(places), h))
                for k, x in enumerate(self._inputs(d, flat, scale, starts)):
                    q = x + state @ u
                    gates = _sigmoid(q[: 3 * h])
                    cell = gates[h : 2 * h] * cell + gates[:h] * np.tanh(q[3 * h :])
                    state = states[k] = gates[2 * h :] * np.tanh(cell)
                z[places] += states @ weights
        return _sigmoid(z)

    def _inputs(self, d: str, flat: np.ndarray, scale: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.w[f"e{d}"][flat] * scale, starts, axis=0) + self.w[f"c{d}"]

    def chance(self, pages: list[list[Bag]]) -> list[np.ndarray]:
        """For each page the chance of every block to be main text. Pages need a block or more."""
        lengths, flat, scale, sizes, starts, t, b, back = self._layout(pages)
        steps, width = int(lengths.max()), len(pages)
        ahead, _ = self._run("f", self._inputs("f", flat, scale, starts), t, b, steps, width, False)
        behind, _ = self._run("b", self._inputs("b", flat, scale, starts), back, b, steps, width, False)
        z = ahead[t + 1, b] @ self.w["o"][:HIDDEN] + behind[back + 1, b] @ self.w["o"][HIDDEN:] + self.w["ob"]
        return np.split(_sigmoid(z), np.cumsum(lengths)[:-1])

    def gradients(self, pages: list[list[Bag]], labels: np.ndarray) -> dict[str, np.ndarray]:
        lengths, flat, scale, sizes, starts, t, b, back = self._layout(pages)
        steps, width, h = int(lengths.max()), len(pages), HIDDEN
        runs = {d: self._run(d, self._inputs(d, flat, scale, starts), place, b, steps, width, True) for d, place in (("f", t), ("b", back))}
        hf, hb = runs["f"][0][t + 1, b], runs["b"][0][back + 1, b]
        e = (_sigmoid(hf @ self.w["o"][:h] + hb @ self.w["o"][h:] + self.w["ob"]) - labels) / len(labels)
        out = {"o": np.concatenate((hf.T @ e, hb.T @ e)), "ob": e.sum(keepdims=True)}
        for d, place, w in (("f", t, self.w["o"][:h]), ("b", back, self.w["o"][h:])):
            states, tape = runs[d]
            down = np.zeros((steps, width, h), np.float64)
            down[place, b] = e[:, None] * w
            u = self.w[f"u{d}"]
            du, dgrid = np.zeros_like(u), np.zeros((steps, width, 4 * h), np.float64)
            dstate, dcell = np.zeros((width, h), np.float64), np.zeros((width, h), np.float64)
            for s in range(steps - 1, -1, -1):
                i, f, o, g, before, squashed = tape[s]
                dstate = dstate + down[s]
                dcell = dcell + dstate * o * (1 - squashed**2)
                dz = np.hstack((dcell * g * i * (1 - i), dcell * before * f * (1 - f), dstate * squashed * o * (1 - o), dcell * i * (1 - g**2)))
                dgrid[s] = dz
                du += states[s].T @ dz
                dstate, dcell = dz @ u.T, dcell * f
            dx = dgrid[place, b]
            de = np.zeros_like(self.w[f"e{d}"])
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            de[flat[order][first]] = np.add.reduceat((np.repeat(dx, sizes, axis=0) * scale)[order], first, axis=0)
            out |= {f"u{d}": du, f"c{d}": dx.sum(axis=0), f"e{d}": de}
        return out

    def train(self, pages: list[list[Bag]], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.03) -> None:
        """Adam over batches of pages of like length; a fixed seed makes it repeatable. Features of few pages are left out."""
        seen = np.bincount(np.concatenate([np.unique([x for f in p for x, _ in f]) for p in pages]), minlength=INPUTS)
        rows = np.flatnonzero(seen >= FEW)
        self.place = np.full(INPUTS, len(rows))
        self.place[rows] = np.arange(len(rows))
        for d in "fb":
            self.w[f"e{d}"] = np.zeros((len(rows) + 1, 4 * HIDDEN))
        pages = [[[x for x in f if seen[x[0]] >= FEW] or f[:1] for f in p] for p in pages]
        r = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        count = 0
        for epoch in range(epochs):
            slower = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = r.permutation(len(pages))
            order = order[np.argsort([len(pages[i]) for i in order], kind="stable")]
            batches = np.array_split(order, -(-len(order) // BATCH))
            for k in r.permutation(len(batches)):
                own = batches[k]
                count += 1
                for name, g in self.gradients([pages[i] for i in own], np.concatenate([labels[i] for i in own])).items():
                    if name[0] == "e":
                        g += DECAY * self.w[name]
                        g[-1] = 0
                    m[name] += 0.1 * (g - m[name])
                    v[name] += 0.01 * (g**2 - v[name])
                    self.w[name] -= slower * (m[name] / (1 - 0.9**count)) / (np.sqrt(v[name] / (1 - 0.99**count)) + 1e-8)


# Names that page parts commonly carry in classes and ids; the made-up pages draw on them. Fixed values.
MAIN_NAMES = "content post entry article story text body single main maincontent articlebody postcontent entrycontent storybody page wrapper container column copy prose richtext".split()
SIDE_NAMES = {
    "nav": "nav navbar menu mainmenu navigation breadcrumb breadcrumbs topnav tabs toc sitemap skip".split(),
    "header": "header masthead topbar siteheader branding logo site top hero tagline".split(),
    "footer": "footer sitefooter bottom copyright legal colophon imprint credits".split(),
    "aside": "sidebar aside widget related recommended popular trending rail secondary teaser more links tags".split(),
    "ad": "ad ads advert adverts advertisement banner sponsored promo promotion sponsor adsense dfp commercial".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay message warning newsletter subscribe paywall announcement privacy disclaimer".split(),
    "form": "form search login signup register subscribe contact newsletter field input".split(),
    "comment": "comments comment discussion replies reply responses disqus respond commentlist reader feedback thread".split(),
    "share": "share social sharing follow byline meta author print pagination pager".split(),
}
SIDE_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "p"], "notice": ["div", "section", "aside", "dialog", "p"], "form": ["form", "div"], "comment": ["div", "section", "ol", "ul", "article"], "share": ["div", "ul", "p"]}
SIDE_WORDS = "home about contact login register search menu more read share copyright reserved rights privacy terms cookies accept subscribe newsletter reply comment comments related advertisement sponsored next previous top".split()


def made_up_page(r: random.Random) -> tuple[str, list[str]]:
    """(html, main blocks) of a page with a random layout."""
    syllables = ["".join(r.choice("bcdfghlmnprstvwz") + r.choice("aeiouéäö") for _ in range(r.randint(1, 2))) for _ in range(60)]
    main: list[str] = []
    bare = r.random() < 0.08  # a page without classes and ids
    terse = r.choice([0.1, 0.1, 0.1, 0.3, 0.9])

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def sentence(least: int, most: int) -> str:
        words = [word() for _ in range(r.randint(least, most))]
        return (" ".join(words).capitalize() if r.random() < 0.8 else " ".join(words).upper()) + r.choice([".", ".", "!", "", "?"])

    def named(names: list[str], chance: float) -> str:
        if bare or r.random() > chance:
            return ""
        name = r.choice(names)
        if r.random() < 0.3:
            name += r.choice(["-", "_", " "]) + r.choice([*names, "inner", "wrap", "box", "block", "item", "list", "area", word()])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def paragraph() -> str:
        return sentence(1, 4) if r.random() < terse else " ".join(sentence(4, 18) for _ in range(r.randint(1, 5)))

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return text

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 4 and r.random() < 0.3:
            i = r.randrange(len(words) - 1)
            words[i] = r.choice(["<b>{}</b>", "<i>{}</i>", '<a href="/x">{}</a>', "<em>{}</em>", "<b>{}"]).format(words[i])
        return " ".join(words)

    def side(kind: str) -> str:
        tag = r.choice(SIDE_TAGS[kind])
        plain = tag in ("nav", "header", "footer", "aside", "form")
        if bare and not plain:  # without names, only elements that say what they are can be told apart
            tag = next((t for t in SIDE_TAGS[kind] if t in ("nav", "header", "footer", "aside", "form")), "aside")
        attr = named(SIDE_NAMES[kind], 0.4 if plain else 1.0)
        text = lambda a, b: " ".join([r.choice(SIDE_WORDS)] * (r.random() < 0.3) + [sentence(a, b)])
        if kind in ("nav", "share") or kind in ("header", "footer", "aside") and r.random() < 0.5:
            items = [f'<a href="/{word()}">{text(1, 3)}</a>' for _ in range(r.randint(2, 8))]
            inner = "".join(f"<li>{x}</li>" for x in items)
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>" if r.random() < 0.7 else r.choice([" ", " | ", "<br>"]).join(items)
        elif kind == "form":
            inner = "".join(r.choice([f"<label>{text(1, 3)}</label><input name=x>", f"<button>{text(1, 2)}</button>", f"<p>{text(2, 12)}</p>", f"<select><option>{word()}</option><option>{word()}</option></select>"]) for _ in range(r.randint(1, 4)))
        elif kind == "comment":
            item = "li" if tag in ("ul", "ol") else r.choice(["div", "p", "article", "section"])
            inner = "".join(f"<{item}{named(SIDE_NAMES[kind], 0.5)}>" + r.choice(["{}", "<p>{}</p>", "<h4>{}</h4><p>{}</p>"]).replace("{}", text(3, 40)) + f"</{item}>" for _ in range(r.randint(1, 6)))
            inner = ("" if item == "li" else r.choice(["", f"<h3>{text(1, 3)}</h3>"])) + inner
        else:
            inner = r.choice(["{}", "<p>{}</p>", "<h3>{}</h3><p>{}</p>", "<span>{}</span>", "<p>{}</p><p>{}</p>", "<div>{}</div>"])
            if kind == "header" and r.random() < 0.3:  # the name of the site
                inner = r.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<h3>{}</h3>", "<h1><a href=/>{}</a></h1>"]).replace("{}", sentence(1, 3))
            while "{}" in inner:
                inner = inner.replace("{}", text(2, 30), 1)
        return f"<{tag}{attr}>{inner}</{tag}>"

    def article() -> str:
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        attr = named(MAIN_NAMES, {"article": 0.3, "main": 0.3}.get(tag, 0.9))
        parts, outside = [], ""
        if r.random() < 0.8:
            level = r.choice(["h1", "h1", "h1", "h2"])
            head = f"<{level}{named([f'{a}{b}' for a in ('', 'entry-', 'post-', 'article-', 'page-') for b in ('title', 'headline', 'heading')], 0.25)}>{keep(sentence(3, 10))}</{level}>"
            if r.random() < 0.2 and tag != "td":  # the title stands before the box of the text
                outside = r.choice(["{}", "{}", f"<header class={r.choice(['entry', 'post', 'article'])}-header>{{}}</header>", "<div>{}</div>"]).replace("{}", head) + (side(r.choice(["share", "ad"])) if r.random() < 0.3 else "")
            else:
                parts.append(f"<header>{head}</header>" if tag == "article" and r.random() < 0.1 else head)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 14, 30])):
            kind = r.random()
            if kind < 0.68:
                parts.append(f"<p>{inline(keep(paragraph()))}" + r.choice(["</p>", "</p>", "<br>", ""]))
            elif kind < 0.78:
                level = r.choice(["h2", "h2", "h3", "h4", "h5", "h6"])
                parts.append(f"<{level}>{keep(sentence(2, 7))}</{level}>")
            elif kind < 0.84:
                parts.append(f"<pre>{keep(chr(10).join(sentence(1, 9) for _ in range(r.randint(1, 6))))}</pre>")
            elif kind < 0.87:
                parts.append("<dl>" + "".join(f"<dt>{keep(sentence(1, 4))}</dt><dd>{keep(sentence(2, 12))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
            elif kind < 0.89:
                parts.append(f"<figure><img src=x.png alt=x><figcaption>{keep(sentence(2, 12))}</figcaption></figure>")
            elif kind < 0.94:
                tag2 = r.choice(["ul", "ol"])
                parts.append(f"<{tag2}>" + "".join(f"<li>{inline(keep(sentence(2, 12)))}</li>" for _ in range(r.randint(2, 5))) + f"</{tag2}>")
            elif kind < 0.975:
                parts.append(f"<blockquote>{keep(paragraph())}</blockquote>")
            else:
                parts.append(f"<table><tr><td>{keep(sentence(1, 5))}</td><td>{keep(sentence(1, 5))}</td></tr></table>")
            if r.random() < 0.13:
                parts.append(side(r.choice(["ad", "aside", "share", "notice", "form"])))
        if r.random() < 0.15:
            parts.append(side(r.choice(["share", "aside", "comment", "form"])))
        if r.random() < 0.1:  # links to share the text, right below its title
            parts.insert(min(1, len(parts)), side("share"))
        inner = "".join(parts)
        if tag == "td":
            cells = [f"<td{attr}>{inner}</td>"]
            for place in (0, 1):  # columns beside the text
                if r.random() < 0.4:
                    kind = r.choice(["nav", "ad", "aside", "form"])
                    extra = r.choice([side(kind), "Sponsored: " + sentence(4, 12), "Advertisement " + sentence(2, 8)]) if kind == "ad" else side(kind)
                    cells.insert(place * len(cells), f"<td{named(SIDE_NAMES[kind], 0.4)}>{extra}</td>")
            return f"<table><tr>{''.join(cells)}</tr></table>"
        return outside + (inner if r.random() < 0.08 else f"<{tag}{attr}>{inner}</{tag}>")

    before = [side(k) for k, c in (("notice", 0.25), ("header", 0.45), ("nav", 0.8), ("form", 0.15), ("ad", 0.4), ("aside", 0.15)) if r.random() < c]
    after = [side(k) for k, c in (("share", 0.2), ("comment", 0.45), ("aside", 0.45), ("ad", 0.2), ("form", 0.2), ("nav", 0.15), ("notice", 0.15), ("footer", 0.85)) if r.random() < c]
    r.shuffle(before)
    body = "".join(before) + article() + "".join(after)
    if r.random() < 0.3:
        body = f"<div{named(['page', 'wrapper', 'container', 'site', 'root', 'app', 'layout'], 0.8)}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{sentence(2, 6)}</title></head><body>{body}</body></html>", main


def labelled(html: str, main: list[str]) -> tuple[list[Bag], np.ndarray]:
    """Features and labels of a page; main blocks come in order."""
    page, at, labels = blocks(html), 0, []
    for b in page:
        hit = at < len(main) and b.text == main[at]
        labels.append(float(hit))
        at += hit
    return features(page), np.array(labels, np.float64)


@lru_cache(maxsize=1)
def trained() -> Labeller:
    r = random.Random(SEED)
    pages = [labelled(*made_up_page(r)) for _ in range(TRAINING_PAGES)]
    pages = [(f, y) for f, y in pages if len(f)]
    out = Labeller()
    out.train([f for f, _ in pages], [y for _, y in pages])
    return out


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    """The main text of each page."""
    parsed, taught = [blocks(p) for p in pages], labeller.taught()
    out = [""] * len(pages)
    for i, p in enumerate(parsed):
        if p and not any(b.path for b in p):  # no block-level element: nothing to tell apart
            out[i], parsed[i] = "\n\n".join(b.text for b in p), []
        elif len(p) > WINDOW:
            out[i], parsed[i] = "\n\n".join(b.text for b, c in zip(p, labeller.chance_of_long(p, taught), strict=True) if c >= 0.5), []
    some = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    at = 0
    while at < len(some):
        # pages of like length together; a group's padded grid stays below some thousands of blocks
        end = at + 1
        while end < len(some) and end - at < 256 and len(parsed[some[end]]) * (end - at + 1) < 8192:
            end += 1
        own = some[at:end]
        for i, chance in zip(own, labeller.chance([features(parsed[i], taught) for i in own]), strict=True):
            out[i] = "\n\n".join(b.text for b, c in zip(parsed[i], chance, strict=True) if c >= 0.5)
        at = end
    return out


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = main_texts(part.column("html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
