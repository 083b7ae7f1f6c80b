"""Personal data in documents: exact patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The network, plain numpy, learns from labelled spans: windows of a bounded sample of documents with the spans that the patterns find there, and written
lines with spans in more ways of writing than the patterns know. Windows that overlap by half cover every stretch of a text that could hold
such data. They are decoded by batches; each character takes its label from the window in which it stands nearest to the middle, and spans are read from the labels of
the whole text. A span is added if it is written like its kind and no exact one is in its way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48  # characters; a window's middle STRIDE belongs to it
REACH = 32  # characters around a trigger that are read

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs are taken whole, so that long ones cost no retries; a match can start at the first digit of a run only
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)

# ways of writing that count for added spans
WRITTEN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]{0,2}[0-9])+"),
    "phone": re.compile(r"(?:\+ ?|\()?[0-9][ ().0-9/-]*[ ().0-9/-][0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def exact_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, by kind and start: leftmost matches of each kind that do not overlap; those that fail the rule of their kind are dropped."""
    out, last, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > last and text[a - 1] in LOCAL_PART:
            a -= 1
        m = DOMAIN.match(text, p + 1) if a < p else None
        if m:
            out.append((0, a, m.end()))
        last = m.end() if m else p + 1
        p = text.find("@", last)
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for kind, pattern, low, high in ((2, CARD, 13, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            d = digits_of(m[0]) if m.end() - m.start() < 40 * high else "0" * (high + 1) if len(digits_of(m[0])) > high else digits_of(m[0])
            if low <= len(d) <= high and (kind != 2 or luhn(d)):
                out.append((kind, m.start(), m.end()))
    return out


def written(kind: int, text: str) -> bool:
    """Whether a span that the network found is written like its kind."""
    name = KINDS[kind]
    if len(text) > 320 or not WRITTEN[name].fullmatch(text):
        return False
    d = digits_of(text)
    if name == "ip":
        return all(_small(p) for p in re.findall("[0-9]+", text))
    if name == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if name == "phone":
        return 9 <= len(d) <= 15 and (text[0] == "+" or len(re.findall("[ ()./-]+", text)) > 1)
    return True


# Characters and labels

PUNCTUATION = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
SYMBOLS = 7 + len(PUNCTUATION)  # beside punctuation: nothing, lower, upper, digit, space, line end, all else


def _symbols() -> np.ndarray:
    table = np.full(129, 6, np.int64)
    for c in range(128):
        x = chr(c)
        table[c] = 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x == " " else 5 if x in "\t\n\x0b\x0c\r" else 7 + PUNCTUATION.index(x) if x in PUNCTUATION else 6
    return table


SYMBOL = _symbols()
LABELS = 1 + 2 * len(KINDS)  # none, then first and inner characters of each kind


def symbols_of(text: str) -> np.ndarray:
    return SYMBOL[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def labels_of(spans: list[tuple[int, int, int]], start: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        a, b, cut = max(a - start, 0), min(b - start, size), a < start
        if a < b:
            out[a:b] = 2 + 2 * kind
            if not cut:
                out[a] = 1 + 2 * kind
    return out


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large loss: inner characters follow their own kind."""
    out = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


ALLOWED = _allowed()


# The network

def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Symbols of windows (n, steps) to labels; ``weights`` are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.hidden = weights["rf"].shape[0]

    @staticmethod
    def fresh(hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        w = {"out": r.normal(0, 0.3, (2 * hidden, LABELS)), "bias": np.zeros(LABELS), "moves": np.zeros((LABELS, LABELS))}
        for side in "fb":
            w["e" + side] = r.normal(0, 0.4, (SYMBOLS, 4 * hidden))
            w["e" + side][:, hidden:2 * hidden] += 1  # gates start out remembering
            w["r" + side] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        (n, steps), k = x.shape, self.hidden
        embedded, inner = self.w["e" + side], self.w["r" + side]
        h = c = np.zeros((n, k), embedded.dtype)
        out = np.empty((n, steps, k), embedded.dtype)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = embedded[x[:, t]] + h @ inner
            gate = 1 / (1 + np.exp(-z[:, :3 * k]))
            i, f, o, g = gate[:, :k], gate[:, k:2 * k], gate[:, 2 * k:], np.tanh(z[:, 3 * k:])
            new = f * c + i * g
            tc = np.tanh(new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, g, tc))
            c, h = new, o * tc
            out[:, t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((self._run(x, "f"), self._run(x, "b")), axis=2) @ self.w["out"] + self.w["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best path of labels through each window."""
        e, moves = self.emissions(x), self.w["moves"] + ALLOWED
        best, back = e[:, 0], np.empty((*x.shape, LABELS), np.int8)
        for t in range(1, x.shape[1]):
            via = best[:, :, None] + moves
            back[:, t] = via.argmax(axis=1)
            best = via.max(axis=1) + e[:, t]
        out = np.empty(x.shape, np.int64)
        out[:, -1] = best.argmax(axis=1)
        for t in range(x.shape[1] - 1, 0, -1):
            out[:, t - 1] = back[np.arange(len(x)), t, out[:, t]]
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss per window: what the right path lacks against the sum over all paths; by forward and backward sums and back propagation through time."""
        traces: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(x, s, traces[s]) for s in "fb"], axis=2)
        e, moves = states @ self.w["out"] + self.w["bias"], self.w["moves"] + ALLOWED
        n, steps, _ = e.shape
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for t in range(1, steps):
            ahead[:, t] = _sum_exp(ahead[:, t - 1, :, None] + moves, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            behind[:, t] = _sum_exp(moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        every = _sum_exp(ahead[:, -1], 1)
        rows, at = np.arange(n)[:, None], np.arange(steps)[None, :]
        right = e[rows, at, y].sum(axis=1) + moves[y[:, :-1], y[:, 1:]].sum(axis=1)
        d = np.exp(ahead + behind - every[:, None, None])
        d[rows, at, y] -= 1
        pair = np.exp(ahead[:, :-1, :, None] + moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - every[:, None, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d, k = d / n, self.hidden
        g = {"out": np.einsum("nth,ntl->hl", states, d), "bias": d.sum(axis=(0, 1)), "moves": pair / n}
        for s, own in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            up = d @ self.w["out"][own].T
            ge, gr, dh, dc = np.zeros_like(self.w["e" + s]), np.zeros_like(self.w["r" + s]), 0.0, 0.0
            for t, h0, c0, i, f, o, gg, tc in reversed(traces[s]):
                dh = dh + up[:, t]
                cell = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate((cell * gg * i * (1 - i), cell * c0 * f * (1 - f), dh * tc * o * (1 - o), cell * i * (1 - gg * gg)), axis=1)
                np.add.at(ge, x[:, t], dz)
                gr += h0.T @ dz
                dh, dc = dz @ self.w["r" + s].T, cell * f
            g["e" + s], g["r" + s] = ge, gr
        return float((every - right).mean()), g


def train(windows: list[tuple[np.ndarray, np.ndarray]], hidden: int = 32, epochs: int = 8, batch: int = 64, rate: float = 0.03, seed: int = 5) -> Tagger:
    """Adam over (symbols, labels) of windows."""
    net = Tagger.fresh(hidden, seed)
    x, y = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for a in range(0, len(x), batch):
            step += 1
            for k, g in net.loss_and_gradient(x[order[a:a + batch]], y[order[a:a + batch]])[1].items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] = (net.w[k] - rate * 0.8**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


# Labelled spans

def practice_lines(words: list[str], count: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Written lines and their spans (kind, start, end): personal data in many ways of writing between given words, and other uses of digits and signs."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[int(r.integers(len(options)))]
    num = lambda n: "".join(str(int(d)) for d in r.integers(0, 10, n))
    name = lambda low=2, high=9: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(r.integers(low, high))))

    def email():
        at, dot = pick([("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", ".")])
        local = pick([name(), f"{name()}.{name()}", f"{name()}.{num(2)}", f"{name()}_{name()}", f"{name().title()}{num(3)}", f"{name()}+{name()}"])
        return 0, local + at + pick([name() + dot + name(2, 4), name() + num(1) + dot + name() + dot + name(2, 4), f"{name()}-{name()}" + dot + name(2, 4)])

    def ip():
        return 1, pick([".", ".", "[.]", "(.)"]).join(str(int(p)) for p in r.integers(0, 256, 4))

    def card():
        sizes = pick([[4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4], [4, 4, 4, 1], [4, 4, 4, 4, 3]])
        d = num(sum(sizes) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        cuts = np.cumsum([0, *sizes])
        return 2, pick([" ", "-", "", ".", " "]).join(d[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def phone():
        return 3, pick([
            f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"+{num(2)}{num(9)}", f"+{num(2)}-{num(3)}-{num(3)}-{num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}",
            f"0{num(2)} {num(4)} {num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}", f"({num(4)}) {num(6)}", f"0{num(3)}/{num(4)}-{num(2)}",
        ])

    def other():
        return None, pick([
            f"20{num(2)}-0{num(1)}-1{num(1)}", f"1{num(1)}.0{num(1)}.20{num(2)}", f"1{num(1)}:{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(2)}.{num(2)}", f"{num(1)},{num(3)},{num(3)}", num(int(r.integers(1, 16))), f"@{name()}", f"{name()}@{name()}",
            "".join(pick("0123456789abcdef") for _ in range(int(r.integers(8, 40)))), f"{num(2)}-{num(2)}", f"#{num(4)}", f"{num(2)}%", f"({num(2)})", f"AK{num(4)}{name(6, 9).upper()}{num(3)}", f"{name()}{num(2)}", f"{num(3)} {name()} {num(3)}", f"{num(1)}. {num(1)}.",
            f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)}-{num(4)} {name()}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(1)}.{num(1)}.{num(1)}",
        ])

    for _ in range(count):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            text += pick(words) + pick([" ", " ", " ", " ", ". ", ", ", "\n", ": "])
            if r.random() < 0.22:
                kind, found = pick([email, ip, card, phone, other, other, other])()
                if kind is not None:
                    spans.append((kind, len(text), len(text) + len(found)))
                text += found + pick([" ", " ", ", ", "\n", ") ", "; ", "%%% ", ". "])
        yield text, spans


def windows_of(text: str) -> list[int]:
    """Numbers of the windows that a text needs: those whose middle lies within REACH characters of a trigger."""
    cells: set[int] = set()
    for m in TRIGGER.finditer(text):
        cells.update(range(max(0, m.start() - REACH) // STRIDE, (m.end() - 1 + REACH) // STRIDE + 1))
    return sorted(c for c in cells if c * STRIDE < len(text))


def window_symbols(symbols: np.ndarray, cell: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    a = cell * STRIDE - (WINDOW - STRIDE) // 2
    part = symbols[max(a, 0):a + WINDOW]
    out[max(a, 0) - a:max(a, 0) - a + len(part)] = part
    return out


def fit_tagger(docs: DataFrame, sample: int = 400, practice: int = 2500, words: int = 3000, seed: int = 13) -> Tagger:
    """Train on at most ``sample`` windows of documents, one of a text and the first by a hash of the texts, with the spans that the exact patterns find in them, and on
    ``practice`` written lines over at most ``words`` different words of these windows."""
    def run(batches):
        for batch in batches:
            found = [(t, m) for t in batch.column(0).to_pylist() if (m := TRIGGER.search(t))]
            yield pa.RecordBatch.from_pydict({"cut": pa.array([t[max(0, m.start() - WINDOW):m.start() + WINDOW] for t, m in found], pa.string())})

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = [r["cut"] for r in texts.mapInArrow(run, "cut string").distinct().orderBy(F.xxhash64("cut"), "cut").limit(sample).collect()]
    r = np.random.default_rng(seed)
    vocabulary = sorted({w for t in cuts for w in t.split() if not TRIGGER.search(w)})[:words] or ["text"]
    lines = [(t, exact_spans(t)) for t in cuts] + list(practice_lines(vocabulary, practice, seed))
    windows = []
    for t, spans in lines:
        symbols, a = symbols_of(t), int(r.integers(0, max(1, len(t) - WINDOW)))
        x = np.zeros(WINDOW, np.int64)
        part = symbols[a:a + WINDOW]
        x[:len(part)] = part
        windows.append((x, labels_of(spans, a, WINDOW)))
    return train(windows)


# Spans of texts

def label_texts(net: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """Spans (kind, start, end) that the network finds in each text."""
    cells, rows = [], []
    for i, t in enumerate(texts):
        if wanted := windows_of(t):
            symbols = symbols_of(t)
            cells += [(i, c) for c in wanted]
            rows += [window_symbols(symbols, c) for c in wanted]
    edge = (WINDOW - STRIDE) // 2
    middles = [net.decode(np.array(rows[a:a + batch]))[:, edge:edge + STRIDE] for a in range(0, len(rows), batch)]
    labels = np.concatenate(middles) if middles else np.zeros((0, STRIDE), np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    a = 0
    while a < len(cells):  # neighbouring windows of a text are read as one
        b = a + 1
        while b < len(cells) and cells[b] == (cells[b - 1][0], cells[b - 1][1] + 1):
            b += 1
        i, c = cells[a]
        run = labels[a:b].reshape(-1)[:len(texts[i]) - c * STRIDE]
        kind = (run + 1) // 2 - 1
        start = (run > 0) & ((run % 2 == 1) | (kind != np.concatenate(([-1], kind[:-1]))))
        for s in np.flatnonzero(start):
            e = s + 1
            while e < len(run) and run[e] == 2 + 2 * kind[s]:
                e += 1
            out[i].append((int(kind[s]), int(c * STRIDE + s), int(c * STRIDE + e)))
        a = b
    return out


def added_spans(text: str, exact: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the network's spans those that are written like their kind, blanks and full stops at the ends apart, and meet no exact span."""
    taken = sorted((a, b) for _, a, b in exact)
    starts = np.array([a for a, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts
    out = []
    for kind, a, b in found:
        a, b = b - len(text[a:b].lstrip(" \t\n\x0b\x0c\r.,:;")), a + len(text[a:b].rstrip(" \t\n\x0b\x0c\r.,:;"))
        if a < b and written(kind, text[a:b]):
            k = int(np.searchsorted(starts, b))  # exact spans that start before b
            if not (k and ends[k - 1] > a):
                out.append((kind, a, b))
    return out


SPANS = "array<struct<kind:int,start:int,end:int,exact:boolean>>"


def find_private(docs: DataFrame, key: str = "doc_id", net: Tagger | None = None, sample: int = 400) -> DataFrame:
    """(key, spans) for each row of ``docs`` (key, text): array of (kind, start, end, exact) by kind and start, in code points, end exclusive.

    kind: the place in KINDS. ``net``: a trained tagger; by default one is fitted on ``docs``, see ``fit_tagger``. Null and empty texts have no spans;
    repeated rows each get a row, a null key stays null, other columns are not read; an empty table gives an empty result.
    """
    weights = (net or fit_tagger(docs, sample)).w
    shape = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())]))

    def run(batches):
        tagger = Tagger(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = []
                for t, found in zip(texts, label_texts(tagger, texts), strict=True):
                    exact = exact_spans(t)
                    every = [(*s, True) for s in exact] + [(*s, False) for s in added_spans(t, exact, found)]
                    out.append([dict(zip(("kind", "start", "end", "exact"), s, strict=True)) for s in sorted(every)])
                yield pa.RecordBatch.from_pydict({key: part.column(0), "spans": pa.array(out, shape)})

    rows = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{key} long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
