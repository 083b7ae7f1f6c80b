"""Main text of web pages by a bidirectional LSTM that labels every block with the whole page in view.

A page becomes the sequence of its blocks: stretches of text between block-level tags. Each block is a vector of its hashed
tag path (names of elements, words of their class, id and role) and its hashed words, with a few sizes. The network, plain numpy, is trained
on a bounded sample of pages whose own structure tells the answer, mixed with practice pages in which menus, notices,
comments and so on stand in many places; tasks then label all pages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSE_P = BLOCK_TAGS - {"button", "label", "option"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ALONE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = frozenset("script style textarea template iframe svg xmp noembed noframes".split())  # what they hold is no text of the page
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
TAG_STOP = re.compile(r""">|=\s*["']""")
OPENING = re.compile(r"<[/a-zA-Z]")
BLOCK_EDGE = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?=[\s/>])", re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Za-z]+")

PATHS, WORDS, SIZES = 192, 32, 5
WIDTH = PATHS + WORDS + SIZES

# Names that tell what a part of a page is for; the teacher of the network, which sees them only as hashes.
MAIN = frozenset("article main content entry post story".split())
ASIDE = frozenset(
    "nav menu navbar navigation breadcrumb breadcrumbs header footer aside sidebar widget form search login signup subscribe newsletter ad ads advert advertisement banner promo sponsor sponsored cookie "
    "cookies consent notice notices alert popup modal share social related comment comments reply replies disqus head title toolbar pager pagination copyright".split()
)


class Level:
    """An open element: names of it and of all around it, as hashed counts; the elements around are shared, not copied."""

    def __init__(self, parent: Level | None, tag: str, names: list[str]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.counts = parent.counts.copy() if parent else np.zeros(PATHS, np.float32)
        self.size = len(names) + (parent.size if parent else 0)
        for name in names:
            self.counts[zlib.crc32(name.encode()) % PATHS] += 1.0

    def path(self) -> list[str]:
        out, at = [], self
        while at:
            out += reversed(at.names)
            at = at.parent
        return out[::-1]


@dataclass
class Piece:
    """A block: where it stands, its text, characters inside links."""

    level: Level | None
    text: str
    linked: int

    @property
    def path(self) -> list[str]:
        return self.level.path() if self.level else []


class Markup:
    """Reads a page from left to right; what was looked for in vain is not looked for again, so broken pages take linear time, too."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.plain = False  # after a tag that never ended: quotes count for nothing
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The ``>`` of the tag whose name ends at ``at``. Quotes behind ``=`` may hold one; a quote that is never closed, or only beyond the next tag, holds none."""
        page, start = self.page, at
        while not self.plain:
            m = TAG_STOP.search(page, at)
            if not m:
                self.plain = True
                break
            if m[0] == ">":
                return m.start()
            close = self.find(m[0][-1], m.end())
            first = page.find(">", m.end(), close if close >= 0 else len(page))
            if close < 0 or first >= 0 and "<" not in page[m.end():first] and OPENING.search(page, first, close):
                return first
            at = close + 1
        return self.find(">", start)

    def raw_end(self, name: str, at: int) -> int:
        """Where the content of an element ends that holds no text: behind its end tag, or without one before the next tag of a block."""
        if name not in self.missing:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(self.page, at)
            if m:
                end = self.page.find(">", m.end())
                return end + 1 if end >= 0 else len(self.page)
            self.missing.add(name)
        m = BLOCK_EDGE.search(self.page, at)
        return m.start() if m else len(self.page)

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """(text, name, attributes) of texts and tags in order; one of text and name is empty, the name of an end tag begins with ``/``."""
        page, at, text = self.page, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                break
            name, end = "", -1
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                end = end + 2 if end >= 0 else self.find(">", at)
            elif page.startswith(("<!", "<?"), at):
                end = self.find(">", at)
            else:
                shut = page.startswith("/", at + 1)
                m = TAG_NAME.match(page, at + 1 + shut)
                if m or shut:
                    end = self.tag_end(m.end() if m else at + 2)
                    name = "/" * shut + m[0].lower() if m else ""
            if end < 0:
                at += 1
                continue
            yield page[text:at], "", ""
            attributes = page[m.end():end] if name else ""
            at = end + 1
            if name in RAW:
                if not (name == "svg" and attributes.endswith("/")):
                    at = self.raw_end(name, at)
            elif name:
                yield "", name, attributes
            text = at
        yield page[text:], "", ""


def blocks_of(page: str) -> list[Piece]:
    """The blocks of a page in order, with white space turned into single spaces.

    Text of math, object, noscript and other elements that are no blocks belongs to the block around it. Self-closing and unclosed elements take no text with them; markup that never
    ends is text.
    """
    stack: list[Level] = []
    open_: Counter[str] = Counter()
    out: list[Piece] = []
    texts: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append(Piece(stack[-1] if stack else None, text, linked))
        texts.clear()
        linked = 0

    def pop():
        open_[stack.pop().tag] -= 1

    for raw, name, attributes in Markup(page).parts():
        if raw:
            text = html.unescape(raw)
            texts.append(text)
            linked += len(text) if in_link else 0
        elif name == "br":
            texts.append("\n")
        elif name == "/a":
            in_link = max(0, in_link - 1)
        elif name == "a":
            in_link += 1
        elif name[:1] == "/" and name[1:] in BLOCK_TAGS:
            flush()
            if open_[name[1:]]:
                while stack[-1].tag != name[1:]:
                    pop()
                pop()
        elif name in BLOCK_TAGS:
            flush()
            in_link = 0
            shut = ALONE.get(name, set()) | ({"p"} if name in CLOSE_P else set())
            if name == "body":
                shut = {"head", "title"}
            while stack and stack[-1].tag in shut:
                pop()
            if name not in VOID:
                own = [name]
                for groups in NAMES.findall(attributes):
                    own += [name + "." + w.lower() for w in PART.findall(groups[0] or groups[1] or groups[2])]
                stack.append(Level(stack[-1] if stack else None, name, own))
                open_[name] += 1
    flush()
    return out


def taught(path: list[str]) -> int:
    """What the names of a path say: 1 main text, 0 anything else."""
    names = {part for name in path for part in name.split(".")}
    return int(bool(names & MAIN) and not names & ASIDE)




def vectors(blocks: list[Piece]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), WIDTH), np.float32)
    for i, b in enumerate(blocks):
        row = out[i]
        if b.level:
            row[:PATHS] = b.level.counts
            row[zlib.crc32(b.level.names[-1].encode()) % PATHS] += 0.5
        words = b.text.split(" ")
        bag = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        row[PATHS:PATHS + WORDS] = bag / np.sqrt((bag * bag).sum())
        row[-5:] = np.log1p(len(b.text)) / 5, b.linked / len(b.text), b.text[-1] in ".!?…", i / len(blocks), (b.level.size if b.level else 0) / 8
    return out


class Labeller:
    """A bidirectional LSTM with one output per step; ``weights`` are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.hidden = weights["rf"].shape[0]

    @staticmethod
    def fresh(hidden: int, seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        w = {"out": r.normal(0, 0.3, 2 * hidden), "bias": np.zeros(1)}
        for side in "fb":
            w["x" + side] = r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 4 * hidden))
            w["r" + side] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w["c" + side] = np.concatenate((np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)))  # gates start out remembering
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, there: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States (pages, steps, hidden); ``there``: which steps a page has."""
        n, steps, _ = x.shape
        k, h, c = self.hidden, np.zeros((n, self.hidden), np.float32), np.zeros((n, self.hidden), np.float32)
        drive = x @ self.w["x" + side] + self.w["c" + side]
        out = np.zeros((n, steps, k), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = drive[:, t] + h @ self.w["r" + side]
            gate = 1 / (1 + np.exp(-z[:, :3 * k]))
            i, f, o, g = gate[:, :k], gate[:, k:2 * k], gate[:, 2 * k:], np.tanh(z[:, 3 * k:])
            live = there[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tc, live))
            c = np.where(live, new, c)
            h = np.where(live, o * tc, h)
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        states = np.concatenate((self._run(x, there, "f"), self._run(x, there, "b")), axis=2)
        return 1 / (1 + np.exp(-np.clip(states @ self.w["out"] + self.w["bias"], -30, 30)))

    def gradient(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over steps, by back propagation through time."""
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, there, s, traces[s]) for s in "fb"], axis=2)
        p = 1 / (1 + np.exp(-np.clip(states @ self.w["out"] + self.w["bias"], -30, 30)))
        d = np.where(there, p - y, 0).astype(np.float32) / max(1, there.sum())
        g = {"out": np.einsum("nt,ntk->k", d, states), "bias": d.sum(keepdims=True).reshape(1)}
        k = self.hidden
        for s, own in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            up = d[:, :, None] * self.w["out"][own]
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            gr, dh, dc = np.zeros_like(self.w["r" + s]), 0.0, 0.0
            for t, h0, c0, i, f, o, gg, tc, live in reversed(traces[s]):
                dh = dh + up[:, t]
                cell = np.where(live, dc + dh * o * (1 - tc * tc), 0)
                dz = np.concatenate((cell * gg * i * (1 - i), cell * c0 * f * (1 - f), np.where(live, dh * tc * o * (1 - o), 0), cell * i * (1 - gg * gg)), axis=1)
                dz_all[:, t] = dz
                gr += h0.T @ dz
                dh = np.where(live, dz @ self.w["r" + s].T, dh)
                dc = np.where(live, cell * f, dc)
            g["x" + s], g["r" + s], g["c" + s] = np.einsum("ntd,ntk->dk", x, dz_all), gr, dz_all.sum(axis=(0, 1))
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, there = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), bool)
    for i, v in enumerate(pages):
        x[i, :len(v)], there[i, :len(v)] = v, True
    return x, there


def train(pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, epochs: int = 14, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Labeller:
    """Adam over (vectors, labels) of pages; batches hold pages of like length."""
    net = Labeller.fresh(hidden, seed)
    pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
    batches = []
    for a in range(0, len(pages), batch):
        x, there = padded([v for v, _ in pages[a:a + batch]])
        y = np.zeros(there.shape, np.float32)
        y[there] = np.concatenate([label for _, label in pages[a:a + batch]])
        batches.append((x, there, y))
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    r, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        for j in r.permutation(len(batches)):
            step += 1
            for k, g in net.gradient(*batches[j]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def practice_pages(words: list[str], count: int, seed: int = 11) -> list[str]:
    """Pages of made-up layout over given words: one main text among other parts, by various names and in any order."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]

    def text(low: int, high: int) -> str:
        return html.escape(" ".join(pick(words) for _ in range(int(r.integers(low, high)))))

    def noise() -> str:
        """Now and then a class or id that says nothing."""
        if r.random() < 0.7:
            return ""
        return f' {pick(["class", "id"])}="{"".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(r.integers(1, 7))))}{pick(["", "1", "-2"])}"'

    def paragraphs(low: int, high: int) -> str:
        return "".join(f"<p{noise()}>{text(3, 40)}" + pick(["</p>", "</p>", ""]) for _ in range(int(r.integers(low, high))))

    def links() -> str:
        return f"<ul{noise()}>" + "".join(f'<li{noise()}><a href="/x">{text(1, 4)}</a></li>' for _ in range(int(r.integers(2, 8)))) + "</ul>"

    others = [name for name in sorted(ASIDE) if name not in ("head", "title", "nav", "header", "footer", "aside", "form")]
    out = []
    for _ in range(count):
        def other() -> str:
            kind = pick(["nav", "header", "footer", "aside", "form", "named", "named", "named", "named"])
            inner = pick([links, lambda: paragraphs(1, 4), lambda: text(2, 30), lambda: f"<h3>{text(1, 5)}</h3>" + paragraphs(1, 3)])()
            if kind == "form":
                inner = f"<label>{text(1, 3)}</label><input><button>{text(1, 2)}</button>" + pick(["", inner])
            if kind == "named":
                tag = pick(["div", "section", "div", "aside"])
                return f'<{tag} {pick(["class", "id"])}="{pick(["", "site-", "page-", "main-"])}{pick(others)}{pick(["", "-box", "-list"])}">{inner}</{tag}>'
            return f"<{kind}{noise()}>{inner}</{kind}>"

        body = f"<h1>{text(2, 12)}</h1>" + "".join(pick([lambda: paragraphs(1, 5), lambda: paragraphs(2, 9), lambda: f"<h2>{text(2, 6)}</h2>", lambda: f"<blockquote>{text(4, 20)}</blockquote>", lambda: f"<ul><li>{text(2, 9)}<li>{text(2, 9)}</ul>", lambda: other() if r.random() < 0.3 else ""])() for _ in range(int(r.integers(1, 6))))
        tag = pick([f"<article{noise()}>|</article>", f"<article{noise()}>|</article>", f"<main{noise()}>|</main>", f"<main{noise()}><article{noise()}>|</article></main>", '<div class="content">|</div>', '<div class="post-content">|</div>', '<div id="main">|</div>', '<div class="entry">|</div>'])
        parts = [other() for _ in range(int(r.integers(0, 4)))] + [tag.replace("|", body)] + [other() for _ in range(int(r.integers(0, 4)))]
        out.append(f"<html><head><title>{text(2, 12)}</title></head><body>{''.join(parts)}</body></html>")
    return out


def fit_labeller(pages: DataFrame, sample: int = 200, practice: int = 500) -> Labeller:
    """Train on at most ``sample`` pages, the first by a hash of page_id and url, and ``practice`` generated ones.

    Sampled pages count only if their structure names a main text. The practice pages are made of at most 5,000 different words of the sample, taken from the first 50 words of each
    block: a bound on what the lessons are written with, not on what is labelled.
    """
    keyed = pages.select(F.xxhash64(F.col("page_id").cast("string"), F.col("url").cast("string")).alias("k"), "html").where(F.col("html").isNotNull())
    # the sample's hashes first, so that tasks send numbers and not pages; then one page of each
    smallest = [r["k"] for r in keyed.select("k").distinct().orderBy("k").limit(sample).collect()]
    rows = keyed.where(F.col("k") <= max(smallest)).groupBy("k").agg(F.min("html").alias("html")).orderBy("k").collect() if smallest else []
    read = [blocks_of(r["html"]) for r in rows]
    words = sorted({w for blocks in read for b in blocks for w in b.text.split()[:50]})[:5000] or ["text"]
    read = [b for b in read if any(taught(x.path) for x in b)] + [blocks_of(p) for p in practice_pages(words, practice)]
    return train([(vectors(b), np.array([taught(x.path) for x in b], np.float32)) for b in read])


def label_pages(net: Labeller, pages: list[list[Piece]], batch_steps: int = 20_000) -> list[np.ndarray]:
    """Scores of the blocks of many pages; pages of like length share a batch of a bounded number of steps."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
    group: list[int] = []

    def run():
        x, there = padded([vectors(pages[i]) for i in group])
        for i, s in zip(group, net.scores(x, there), strict=True):
            out[i] = s[:len(pages[i])]
        group.clear()

    for i in order:
        if group and len(pages[i]) * (len(group) + 1) > batch_steps:
            run()
        group.append(i)
    if group:
        run()
    return out


def extract_text(pages: DataFrame, threshold: float = 0.5, sample: int = 200) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    ``text``: the blocks that the network takes for main text, white space inside a block as one space, joined in order by one
    newline; empty for a null or empty html and for pages without such blocks. n_chars counts its code points. Repeated
    rows each get a row; other columns are not read; an empty table gives an empty result.
    """
    weights = fit_labeller(pages, sample).w

    def run(batches):
        net = Labeller(weights)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                read = [blocks_of(t.as_py() or "") for t in part.column(2)]
                texts = ["\n".join(b.text for b, s in zip(blocks, scores, strict=True) if s >= threshold) for blocks, scores in zip(read, label_pages(net, read), strict=True)]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
