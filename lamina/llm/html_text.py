"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks of text at block-level tags. A bidirectional LSTM in numpy reads the blocks in page order, each
as hashed words and hashed tag path, so every block is judged with the whole page as context. It is trained once for
each process on pages made by a seeded generator.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .storage import ship

# HTML's block-level elements, those without an end tag, and those whose content is not text.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary"
    " table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
UNSEEN = frozenset("noscript template svg object".split())

# Quoted values end before the next "<", so that an unpaired quote costs no more than its own tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(/?)([a-z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-z][^\s/>]*)([^<>]*+)>", re.I | re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")

PATH, WORDS, NUMBERS, HIDDEN = 192, 32, 6, 16
WIDTH = PATH + WORDS + NUMBERS
TRAIN_PAGES, EPOCHS, RATE, SEED = 500, 12, 0.01, 8


class Path:
    """The open elements: which slots their tokens fill, kept up to date element by element."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter[str] = Counter()
        self.count, self.flags, self.tokens = [0] * PATH, bytearray(PATH), 0

    def push(self, name: str, tokens: tuple[str, ...]) -> None:
        self.stack.append((name, tokens))
        self.open[name] += 1
        self.tokens += len(tokens)
        for t in tokens:
            slot = _slot(t, PATH)
            self.count[slot] += 1
            self.flags[slot] = 1

    def pop(self) -> str:
        name, tokens = self.stack.pop()
        self.open[name] -= 1
        self.tokens -= len(tokens)
        for t in tokens:
            slot = _slot(t, PATH)
            self.count[slot] -= 1
            self.flags[slot] = self.count[slot] > 0
        return name

    def close(self, name: str) -> None:
        """End the innermost element of that name and all inside it; an end tag without a start is ignored."""
        while self.open[name] and self.pop() != name:
            pass

    def now(self) -> tuple[bytes, str, int]:
        return bytes(self.flags), self.stack[-1][1][-1] if self.stack else "", self.tokens


#: Text, (filled slots, last token, number of tokens) of the path, share of the text in links.
Block = tuple[str, tuple[bytes, str, int], float]


def blocks(page: str) -> list[Block]:
    """Each block with text, in page order; time is in proportion to the page's length."""
    out: list[Block] = []
    path = Path()
    held: list[str] = []
    unseen: list[str] = []
    linked, in_link, last = 0, 0, 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not unseen:
            text = html.unescape(raw)
            held.append(text)
            if in_link:
                linked += len(text)

    def close() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((text, path.now(), min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[last : m.start()])
        last = at = m.end()
        name = (m[2] or m[5] or "").lower()
        ends = bool(m[1] or m[4])
        if not name:
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            if not ends:  # its content ends at its own end tag only
                found = _RAW_END[name].search(page, at)
                last = at = found.end() if found else len(page)
            continue
        if name in UNSEEN or (unseen and name == "foreignobject"):
            if ends:
                if name in unseen:
                    while unseen.pop() != name:
                        pass
            elif not attributes.rstrip().endswith("/"):
                unseen.append(name)
            continue
        if unseen:
            if unseen[-1] != "svg" or name not in BLOCK:
                continue
            unseen.pop()  # a drawing that was not closed ends where the page goes on
        if name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            held.append(" ")
        if name not in BLOCK:
            continue
        close()
        in_link = 0
        if ends:
            path.close(name)
        else:
            above = path.stack[-1][0] if path.stack else ""
            if above == "p" or name == above and name in ("li", "option", "td", "th", "tr", "dd", "dt"):
                path.pop()
            if name not in VOID:
                named = " ".join("".join(x) for x in _NAMED.findall(attributes)).lower()
                path.push(name, (name, *(f".{w}" for w in _WORD.findall(named))))
    add(page[last:])
    close()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % size


def features(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row of WIDTH numbers for each block, or for those from first to before last."""
    last = len(page) if last is None else last
    x = np.zeros((last - first, WIDTH), np.float32)
    for i, (text, (flags, nearest, tokens), linked) in enumerate(page[first:last]):
        x[i, :PATH] = np.frombuffer(flags, np.uint8)
        if nearest:
            x[i, _slot(f"last {nearest}", PATH)] = 1.0
        words = text.lower().split()
        n = len(words)
        x[i, PATH : PATH + WORDS] = np.bincount([_slot(w, WORDS) for w in words], minlength=WORDS) / n
        x[i, PATH + WORDS :] = (np.log1p(n) / 5, linked, sum(w[-1] in ".!?,;:" for w in words) / n, (first + i) / len(page), min(tokens, 60) / 12, n < 6)
    return x


# --- the network --------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """One LSTM from each end; a block's logit is linear in both states."""

    def __init__(self, seed: int):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = r.normal(0, 0.15, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            self.p[d + "h"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[d + "c"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[d + "c"][HIDDEN : 2 * HIDDEN] = 1.0
        self.p["o"] = r.normal(0, 0.15, (2 * HIDDEN, 1)).astype(np.float32)
        self.p["oc"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray):
        steps, n, _ = x.shape
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        pre = x @ self.p[d + "x"] + self.p[d + "c"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        hs, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in order:
            z = pre[t] + h @ self.p[d + "h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            fresh = f * c + i * g
            tc = np.tanh(fresh)
            m = mask[t][:, None]
            kept.append((t, i, f, o, g, c, tc, h, m))
            c = m * fresh + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            hs[t] = h
        return hs, kept

    def _walk(self, d: str, x: np.ndarray, mask: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """What a direction adds to the logits, and its state at the end; nothing else is kept."""
        steps, n, _ = x.shape
        pre = x.reshape(-1, WIDTH) @ self.p[d + "x"] + self.p[d + "c"]
        pre = pre.reshape(steps, n, -1)
        w = self.p["o"][:HIDDEN, 0] if d == "f" else self.p["o"][HIDDEN:, 0]
        (h, c), out = state, np.zeros((steps, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p[d + "h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            fresh = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c = m * fresh + (1 - m) * c
            h = m * (gates[:, 2 * HIDDEN :] * np.tanh(fresh)) + (1 - m) * h
            out[t] = h @ w
        return out, (h, c)

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        zero = np.zeros((x.shape[1], HIDDEN), x.dtype)
        return self._walk("f", x, mask, (zero, zero))[0] + self._walk("b", x, mask, (zero, zero))[0] + self.p["oc"]

    def logits_of_long(self, page: list[Block], piece: int) -> np.ndarray:
        """Of one page, piece by piece in each direction, so that only a piece's features are held."""
        out = np.full(len(page), self.p["oc"][0], np.float32)
        starts = list(range(0, len(page), piece))
        for d in "fb":
            state = (np.zeros((1, HIDDEN), np.float32),) * 2
            for lo in starts if d == "f" else reversed(starts):
                x = features(page, lo, min(lo + piece, len(page)))[:, None]
                part, state = self._walk(d, x, np.ones(x.shape[:2], np.float32), state)
                out[lo : lo + len(x)] += part[:, 0]
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(d, x, mask) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], 2)
        err = (_sigmoid((both @ self.p["o"])[..., 0] + self.p["oc"]) - y) * mask / mask.sum()
        grads = {"o": (both * err[..., None]).sum((0, 1))[:, None], "oc": err.sum(keepdims=True).reshape(1)}
        back = err[..., None] * self.p["o"][:, 0]
        for k, d in enumerate("fb"):
            dx, dh_w, dc_w = np.zeros_like(self.p[d + "x"]), np.zeros_like(self.p[d + "h"]), np.zeros_like(self.p[d + "c"])
            dh, dc = np.zeros(both.shape[1:2] + (HIDDEN,), np.float32), np.zeros(both.shape[1:2] + (HIDDEN,), np.float32)
            for t, i, f, o, g, c, tc, h, m in reversed(runs[d][1]):
                dh = dh + back[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                live = m * dh
                dfresh = m * dc + live * o * (1 - tc**2)
                dz = np.concatenate([dfresh * g * i * (1 - i), dfresh * c * f * (1 - f), live * tc * o * (1 - o), dfresh * i * (1 - g**2)], 1)
                dx += x[t].T @ dz
                dh_w += h.T @ dz
                dc_w += dz.sum(0)
                dh = dz @ self.p[d + "h"].T + (1 - m) * dh
                dc = dfresh * f + (1 - m) * dc
            grads |= {d + "x": dx, d + "h": dh_w, d + "c": dc_w}
        return grads


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(r) for r in rows)
    x, mask = np.zeros((steps, len(rows), WIDTH), np.float32), np.zeros((steps, len(rows)), np.float32)
    for k, r in enumerate(rows):
        x[: len(r), k] = r
        mask[: len(r), k] = 1
    return x, mask


# --- training pages -----------------------------------------------------------------------------------------------

_MARK = "\x01"
_NAMES = {
    "menu": ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "main-menu", "links"],
    "head": ["header", "masthead", "site-header", "banner", "top", "branding"],
    "foot": ["footer", "site-footer", "bottom", "copyright", "colophon"],
    "side": ["sidebar", "aside", "widget", "related", "trending", "popular", "rail", "share", "social", "tags"],
    "note": ["cookie", "notice", "gdpr", "consent", "newsletter", "popup", "alert", "paywall", "subscribe"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbygoogle"],
    "form": ["search", "login", "signup", "contact-form", "form"],
    "talk": ["comments", "comment", "comment-list", "disqus", "responses", "replies", "discussion"],
    "text": ["content", "article", "post", "entry", "article-body", "post-content", "entry-content", "story", "main", "text", "body-copy"],
}
#: Names of boxes that tell nothing.
_NEUTRAL = ["page", "wrapper", "container", "layout", "site", "inner", "outer", "col", "row", "grid", "wrap", "region", "panel", "center", "left", "right", "box", "root", "app", "section"]


def training_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and whether each of its blocks is main text."""
    vocabulary = ["".join(r.choice("aeiourtnslhdmpcéüß") for _ in range(r.randint(1, 9))) for _ in range(150)]

    def words(lo: int, hi: int, stops: bool = True) -> str:
        picked = [r.choice(vocabulary) for _ in range(r.randint(lo, hi))]
        return " ".join(w + ("." if stops and r.random() < 0.12 else "," if stops and r.random() < 0.06 else r.choice(["###", "&amp;&amp;", "!!"]) if r.random() < 0.02 else "") for w in picked)

    def neutral() -> str:
        return r.choice([*_NEUTRAL, r.choice(vocabulary).encode("ascii", "ignore").decode() or "x1"])

    def box(kind: str, tags: list[str], inner: str) -> str:
        tag = r.choice([*tags, "div", "section"])
        plain = tag in tags and tag not in ("div", "section", "ul", "form") and r.random() < 0.6
        named = "" if plain else f' {r.choice(["class", "class", "id"])}="{r.choice(_NAMES[kind])}{r.choice(["", "", " " + neutral()])}"'
        return f"<{tag}{named}>{inner}</{tag}>"

    def prose(mark: str, lo: int, hi: int) -> str:
        ends = r.choice(["</p>", "</p>", ""])
        return "".join(f"<p>{r.choice(['', '<b>', '<span>'])}{mark}{words(lo, hi)}{r.choice(['', '<br>'])}{ends}" for _ in range(r.randint(1, 4)))

    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 3, False)}</a></li>' for i in range(r.randint(2, 8))) + "</ul>"
    part = {
        "menu": lambda: box("menu", ["nav", "ul"], links()),
        "head": lambda: box("head", ["header"], r.choice([f"<h1>{words(1, 4, False)}</h1>", f"<p>{words(2, 9)}</p>", links()])),
        "foot": lambda: box("foot", ["footer"], r.choice([f"&copy; {words(3, 25)}", f"<p>{words(4, 30)}</p>", links()])),
        "side": lambda: box("side", ["aside"], f"<h3>{words(1, 4, False)}</h3>" + r.choice([links(), f"<p>{words(5, 40)}</p>"])),
        "note": lambda: box("note", ["div"], f"{r.choice(['', '<p>'])}{words(5, 40)} <button>{words(1, 2, False)}</button>"),
        "ad": lambda: box("ad", ["div", "ins"], r.choice([words(3, 40), f"<p>{words(3, 40)}</p>"])),
        "form": lambda: box("form", ["form"], f"<form><label>{words(1, 3, False)}</label><input name=q><select><option>{words(1, 2, False)}<option>{words(1, 2, False)}</select><button>{words(1, 2, False)}</button></form>"),
        "talk": lambda: box("talk", ["section", "ol"], f"<h2>{words(1, 3, False)}</h2>" + "".join(f'<{t} class="{r.choice(_NAMES["talk"])}"><p>{words(3, 60)}</p></{t}>' for t in r.choices(["div", "li", "article"], k=r.randint(1, 4)))),
    }

    def body() -> str:
        out = []
        if r.random() < 0.8:
            out.append(f"<h1>{_MARK}{words(2, 12)}</h1>")
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            if kind < 0.7:
                out.append(prose(_MARK, r.choice([1, 3, 6]), r.choice([6, 60, 120])))
            elif kind < 0.8:
                out.append(f"<h2>{_MARK}{words(1, 8, False)}</h2>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{_MARK}{words(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{_MARK}{words(5, 40)}</blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{_MARK}{words(1, 6)}</td><td>{_MARK}{words(1, 6)}</td></tr></table>")
            else:
                out.append(part[r.choice(["ad", "side", "note"])]())
        return "".join(out)

    main = box("text", ["article", "article", "main"], body())
    for _ in range(r.choice([0, 0, 1, 1, 2])):  # boxes around the article, some with what is beside it
        beside = part[r.choice(["side", "side", "ad", "menu", "note", "talk"])]() if r.random() < 0.4 else ""
        tag = r.choice(["main", "div", "div", "div", "section"])
        named = r.choice(["", f' class="{neutral()}"', f' id="{neutral()}"', f' class="{neutral()} {neutral()}"', ' role="main"'])
        main = f"<{tag}{named}>{main}{beside}</{tag}>" if r.random() < 0.7 else f"<{tag}{named}>{beside}{main}</{tag}>"
    before = [part[k]() for k in ("menu", "head", "note", "ad", "form", "side") if r.random() < (0.7 if k == "menu" else 0.4)]
    after = [part[k]() for k in ("talk", "side", "ad", "form", "menu", "foot", "note") if r.random() < (0.8 if k == "foot" else 0.35)]
    r.shuffle(before)
    end = r.choice(["</body></html>", "</body></html>", ""])
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(1, 10)}</title><style>p{{margin:0}}</style></head><body>{"".join(before)}{main}{"".join(after)}{end}'
    found = blocks(page)
    return page.replace(_MARK, ""), [int(_MARK in text) for text, _, _ in found]


@lru_cache(maxsize=1)
def model() -> Labeller:
    """The labeller, trained by Adam on TRAIN_PAGES generated pages; the same each time."""
    r = random.Random(SEED)
    pages = [training_page(r) for _ in range(TRAIN_PAGES)]
    data = [(features(blocks(page)), np.array(labels, np.float32)) for page, labels in pages]
    net, rng = Labeller(SEED), np.random.default_rng(SEED)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 20):
            some = [data[i] for i in order[lo : lo + 20]]
            x, mask = _padded([f for f, _ in some])
            y = np.zeros(mask.shape, np.float32)
            for k, (_, labels) in enumerate(some):
                y[: len(labels), k] = labels
            step += 1
            for k, g in net.gradients(x, mask, y).items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                rate = RATE * (0.2 if epoch >= EPOCHS * 2 // 3 else 1.0)
                net.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


#: Steps of all pages that go through the network together, padding included; a page with more blocks goes alone.
STEPS = 32_768
#: Bytes of pages that are parsed at a time; a longer page is parsed alone.
CHUNK = 4 << 20


def extract(pages: list[str], net: Labeller) -> list[str]:
    """Main text of each page; pages of like length go through the network together."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))

    def keep(i: int, kept: np.ndarray) -> None:
        out[i] = "\n".join(text for (text, _, _), yes in zip(parsed[i], kept) if yes)

    while order:
        n = 1
        while n < min(64, len(order)) and len(parsed[order[n]]) * (n + 1) <= STEPS:
            n += 1
        some, order = order[:n], order[n:]
        if len(parsed[some[0]]) > STEPS:
            keep(some[0], net.logits_of_long(parsed[some[0]], STEPS) >= 0)
            continue
        x, mask = _padded([features(parsed[i]) for i in some])
        kept = net.logits(x, mask) >= 0
        for k, i in enumerate(some):
            keep(i, kept[:, k])
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for whole in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(whole.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(whole):
                before = sizes[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(sizes, before + CHUNK, "right"))), lo + 512)
                batch = whole.slice(lo, hi - lo)
                texts = extract([p or "" for p in batch.column("html").to_pylist()], net)
                yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.
    Content of script, style, noscript, template, svg and object is no text, up to their own end tags. Null html counts as
    empty and gives an empty text; repeated rows and null ids give results like any other; an empty table gives an empty
    result; other columns are ignored. A page's memory is in proportion to its length, with no more for its neighbours.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model())
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(shared), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
