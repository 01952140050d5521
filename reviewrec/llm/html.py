"""Main-text extraction: a bidirectional LSTM in numpy labels every text block of a page from its tag path and words."""

from __future__ import annotations

import bisect
import html as entities
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# -- blocks ----------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe svg math object head title textarea select datalist".split())
#: Elements that end a block before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same kind ends, with the elements that this doesn't reach beyond.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


#: Tags and class words that mark a block as no part of the article, wherever they stand above it.
MARKS_OUTSIDE = frozenset(
    "nav footer aside form button label dialog menu .nav .navbar .menu .breadcrumb .breadcrumbs .footer .sidebar .aside .widget .related .ad .ads .advert .advertisement .promo .sponsor"
    " .sponsored .banner .cookie .cookies .consent .notice .alert .popup .modal .newsletter .subscribe .login .signup .search .share .social .comment .comments .reply .replies .pagination .copyright .masthead".split()
)
MARKS_INSIDE = frozenset("article main .article .content .post .entry .story".split())

PATH = 128
_VOTES: dict[str, tuple[tuple[int, int], tuple[int, int]]] = {}


def votes(name: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two places of a tag or class word in a path vector, and its signs there."""
    if name not in _VOTES:
        if len(_VOTES) > 100_000:
            _VOTES.clear()
        h = zlib.crc32(name.encode())
        _VOTES[name] = (h % PATH, 1 if h >> 20 & 1 else -1), ((h >> 8) % PATH, 1 if h >> 21 & 1 else -1)
    return _VOTES[name]


@dataclass
class Leaf:
    """A block: its text, a signed hash of the different tags and class words above it, how much of it is link text, and whether its markup tells that it belongs to the article."""

    text: str
    path: np.ndarray
    linked: float
    marked: bool


def _labels(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    for kind, *values in _ATTRIBUTE.findall(attributes):
        names += [f"{tag if kind.lower() == 'role' else ''}.{w}" for w in _WORD.findall("".join(values).lower())]
    return tuple(names)


class Stack:
    """Open elements, where each tag is among them, and how often each name is; every step costs what it adds or takes away."""

    def __init__(self):
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.names: dict[str, int] = {}
        self.vector, self.taken = [0] * PATH, None
        self.outside = self.inside = 0

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, names))
        for n in names:
            before = self.names.get(n, 0)
            self.names[n] = before + 1
            if not before:
                self._change(n, 1)

    def pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, names = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            for n in names:
                self.names[n] -= 1
                if not self.names[n]:
                    del self.names[n]
                    self._change(n, -1)

    def _change(self, name: str, by: int) -> None:
        for at, sign in votes(name):
            self.vector[at] += sign * by
        self.taken = None
        self.outside += by * (name in MARKS_OUTSIDE)
        self.inside += by * (name in MARKS_INSIDE)

    def last(self, tag: str) -> int:
        """The innermost open element of a tag; -1 for none."""
        at = self.places.get(tag)
        return at[-1] if at else -1

    def path(self) -> np.ndarray:
        if self.taken is None:
            self.taken = np.array(self.vector, np.float32)
        return self.taken

    def marked(self) -> bool:
        return self.inside > 0 and not self.outside and not ("header" in self.names and "article" not in self.names)

    def end_siblings(self, tag: str) -> None:
        """What an opening block ends: the nearest element of its kind, or of a table's cells and rows all, up to a wall."""
        kinds, walls = SIBLINGS.get(tag, ({"p"}, {"button", "table", "td", "th"}))
        wall = max((self.last(w) for w in walls), default=-1)
        if tag in ("tr", "td", "th"):
            ends = [at[bisect.bisect_right(at, wall)] for k in kinds if (at := self.places.get(k)) and at[-1] > wall]
            if ends:
                self.pop_to(min(ends))
        else:
            k = max(self.last(x) for x in kinds)
            if k > wall:
                self.pop_to(k)


def leaves(page: str) -> list[Leaf]:
    """The text blocks of a page in order, in time that grows with its length; tolerates unclosed and unopened elements, comments and broken markup."""
    out: list[Leaf] = []
    stack = Stack()
    parts: list[str] = []
    linked, last, headless = 0, page.rfind(">"), False

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(text, stack.path(), min(1.0, linked / len(text)), stack.marked()))
            parts.clear()
        linked = 0

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at) if at <= last or page.find("<!--", at) >= 0 else None
        text = page[at : m.start() if m else len(page)]
        if text:
            parts.append(text)
            if stack.last("a") >= 0:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = stack.last(tag)
            if tag in BLOCKS:
                close_block()
            if k >= 0 and (tag in BLOCKS or not stack.blocks or stack.blocks[-1] < k):
                stack.pop_to(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in SKIPPED:
            if not m[3].rstrip().endswith("/") and not (tag == "head" and headless):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.I).search(page, at)
                headless = tag == "head" and not end
                at = end.end() if end else (len(page) if tag != "head" else at)
            continue
        if tag in BLOCKS:
            close_block()
            stack.end_siblings(tag)
        if tag not in VOID and not m[3].endswith("/"):
            stack.push(tag, _labels(tag, m[3]))
    close_block()
    return out


# -- features --------------------------------------------------------------------------------------

WORDS, OTHER, HIDDEN = 32, 5, 16
INPUT = PATH + WORDS + OTHER


def features(pages: list[list[Leaf]]) -> np.ndarray:
    """One row a block, pages one after the other."""
    every = [x for p in pages for x in p]
    out = np.zeros((len(every), INPUT), np.float32)
    if not every:
        return out
    out[:, :PATH] = [x.path for x in every]
    data, bounds = common.utf8(pa.array([x.text for x in every], pa.large_string()))
    for i, j in common.slices(bounds):
        word, at = common.word_hashes(common.LOWER[data[bounds[i] : bounds[j]]], bounds[i : j + 1] - bounds[i])
        of = np.repeat(np.arange(i, j), np.diff(at))
        count = np.bincount(of * WORDS + (word >> np.uint64(40)).astype(np.int64) % WORDS, minlength=j * WORDS)[i * WORDS :].reshape(-1, WORDS)
        out[i:j, PATH : PATH + WORDS] = count / np.maximum(1, np.linalg.norm(count, axis=1, keepdims=True))
        out[i:j, PATH + WORDS] = np.log1p(np.diff(at)) / 4
    out[:, PATH + WORDS + 1] = [x.linked for x in every]
    out[:, PATH + WORDS + 2] = [x.text[-1:] in ".!?…" for x in every]
    k = 0
    for p in pages:
        out[k : k + len(p), PATH + WORDS + 3] = np.linspace(0, 1, len(p)) if p else 0
        k += len(p)
    out[:, PATH + WORDS + 4] = 1
    return out


# -- the network -----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two LSTMs, one each way, and a logistic layer over both states."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        r = np.random.RandomState(seed)
        w = {}
        for way in "fb":
            w[f"{way}x"] = (r.randn(INPUT, 4 * HIDDEN) / np.sqrt(INPUT)).astype(np.float32)
            w[f"{way}h"] = (r.randn(HIDDEN, 4 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
            w[f"{way}b"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)
        w["o"] = (r.randn(2 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
        w["c"] = np.zeros(1, np.float32)
        return cls(w)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """x: (steps, pages, INPUT); states of one direction, padding keeps them."""
        w, steps = self.weights, len(x)
        gates = x @ w[f"{way}x"] + w[f"{way}b"]
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((steps, x.shape[1], HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = gates[t] + h @ w[f"{way}h"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * u
            tanh = np.tanh(new)
            if trace is not None:
                trace.append((t, h, c, i, f, o, u, tanh, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run("f", x, mask), self._run("b", x, mask)], 2)
        return both @ self.weights["o"] + self.weights["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.weights
        traces: dict[str, list] = {"f": [], "b": []}
        state = {way: self._run(way, x, mask, traces[way]) for way in "fb"}
        both = np.concatenate([state["f"], state["b"]], 2)
        p = _sigmoid(both @ w["o"] + w["c"])
        n = max(1, mask.sum())
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n)
        d = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.tensordot(d, both, ([0, 1], [0, 1])), "c": np.array([d.sum()], np.float32)}
        for k, way in enumerate("fb"):
            outer = d[:, :, None] * w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dg = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(w[f"{way}h"])
            for t, h0, c0, i, f, o, u, tanh, m in reversed(traces[way]):
                dh = dh + outer[t]
                live = np.where(m, dh, 0)
                inner = np.where(m, dc, 0) + live * o * (1 - tanh**2)
                g = np.concatenate([inner * u * i * (1 - i), inner * c0 * f * (1 - f), live * tanh * o * (1 - o), inner * i * (1 - u**2)], 1)
                dg[t] = g
                gh += h0.T @ g
                dh = np.where(m, g @ w[f"{way}h"].T, dh)
                dc = np.where(m, inner * f, dc)
            grads |= {f"{way}x": np.tensordot(x, dg, ([0, 1], [0, 1])), f"{way}h": gh, f"{way}b": dg.sum((0, 1))}
        return loss, grads


def padded(x: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((max(sizes), len(sizes), x.shape[1]), np.float32)
    mask = np.zeros(out.shape[:2], bool)
    k = 0
    for j, n in enumerate(sizes):
        out[:n, j] = x[k : k + n]
        mask[:n, j] = True
        k += n
    return out, mask


def train(pages: list[list[Leaf]], labels: list[list[int]], epochs: int = 6, seed: int = 11) -> Labeller:
    """Adam over batches of 32 pages."""
    net, r = Labeller.fresh(seed), np.random.RandomState(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    step = 0
    full = [k for k, p in enumerate(pages) if p]
    for _ in range(epochs):
        r.shuffle(full)
        for lo in range(0, len(full), 32):
            part = sorted(full[lo : lo + 32], key=lambda k: len(pages[k]))
            sizes = [len(pages[k]) for k in part]
            x, mask = padded(features([pages[k] for k in part]), sizes)
            y, _ = padded(np.concatenate([labels[k] for k in part]).astype(np.float32)[:, None], sizes)
            step += 1
            _, grads = net.gradients(x, mask, y[:, :, 0])
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


# -- what it learns from ---------------------------------------------------------------------------

#: Sampled pages that are labelled by these marks, and pages generated with other markup.
SAMPLE, GENERATED = 200, 700
#: Longer pages don't enter the sample.
SAMPLE_CHARS = 200_000


def marked(page: list[Leaf]) -> list[int]:
    return [int(x.marked) for x in page]


def generated(n: int, seed: int = 5) -> tuple[list[list[Leaf]], list[list[int]]]:
    """Pages of a small random grammar: menus, notices, adverts, forms, comments and footers around an article, with or without telling markup."""
    r = np.random.RandomState(seed)
    pick = lambda *x: x[r.randint(len(x))]
    letters = np.array(list("abcdefghijklmnoprstuvwz"))
    lexicon = ["".join(r.choice(letters, r.randint(2, 9))) for _ in range(3000)]
    words = lambda a, b: " ".join(lexicon[int(len(lexicon) * r.rand() ** 2)] for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(words(4, 18).capitalize() + "." for _ in range(r.randint(1, 7)))
    pages, labels = [], []
    for _ in range(n):
        blocks: list[tuple[str, int]] = []

        def menu(tag: str, name: str) -> None:
            items = "".join(f'<li><a href="/{k}">{words(1, 4)}</a></li>' for k in range(r.randint(2, 9)))
            blocks.append((f"<{tag}{name}><ul>{items}</ul></{tag}>", 0))

        def note(name: str) -> None:
            blocks.append((f'<{pick("div", "section", "aside", "p")} class="{name}">{pick(words(2, 25), prose())}</>', 0))

        if r.rand() < 0.8:
            blocks.append((pick("<header><h2>{}</h2></header>", '<div id="masthead"><a href="/">{}</a></div>', '<header class="top"><p>{}</p></header>').format(words(1, 5)), 0))
        if r.rand() < 0.9:
            menu(*pick(("nav", ""), ("div", ' class="menu"'), ("div", ' id="navbar"'), ("nav", ' class="breadcrumb"')))
        for name in ("cookie-consent", "ad", "promo banner", "alert notice", "login"):
            if r.rand() < 0.3:
                note(name)
        opening, closing = pick(("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-entry">', "</div>"), ("<div>", "</div>"), ("<main><article class='story'>", "</article></main>"))
        blocks.append((opening, 1))
        if r.rand() < 0.9:
            blocks.append((f"<h1>{words(2, 12)}</h1>", 1))
        for _ in range(r.randint(1, 16)):
            kind = r.rand()
            if kind < 0.7:
                blocks.append((pick("<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<p>{} <a href='/x'>see</a></p>").format(pick(prose(), prose(), words(1, 4))), 1))
            elif kind < 0.8:
                blocks.append((f"<h2>{words(1, 8)}</h2>", 1))
            elif kind < 0.9:
                blocks.append(("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(r.randint(1, 5))) + "</ul>", 1))
            else:
                blocks.append((f"<blockquote>{prose()}</blockquote>", 1))
            if r.rand() < 0.06:
                blocks.append((f'<div class="{pick("ad", "related", "newsletter", "share social")}">{pick(words(2, 12), prose())}</div>', 0))
        blocks.append((closing, 1))
        if r.rand() < 0.4:
            rows = "".join(f'<div class="comment"><p>{words(1, 3)}</p><p>{prose()}</p></div>' for _ in range(r.randint(1, 5)))
            blocks.append((f'<section class="{pick("comments", "replies")}">{rows}</section>', 0))
        if r.rand() < 0.4:
            blocks.append((f"<aside><h3>{words(1, 4)}</h3><ul><li><a href='/r'>{words(2, 8)}</a></li></ul><p>{prose()}</p></aside>", 0))
        if r.rand() < 0.4:
            blocks.append((f"<form><label>{words(1, 4)}</label><input><button>{words(1, 3)}</button></form>", 0))
        if r.rand() < 0.9:
            blocks.append((pick("<footer>{}</footer>", '<div class="footer">{}</div>', "<footer><p>{}</p></footer>").format("&copy; " + pick(words(2, 20), prose())), 0))
        # a label travels with the text as its first character
        text = "".join(re.sub(r">(?=[^<\s])", f">{chr(0xE000 + y)}", b) for b, y in blocks)
        found = leaves(f"<html><body>{text}</body></html>")
        labels.append([int("\ue001" in x.text) for x in found])
        for x in found:
            x.text = x.text.replace("\ue000", "").replace("\ue001", "") or "."
        pages.append(found)
    return pages, labels


def fit(pages: DataFrame, html: str, key: str) -> Labeller:
    """A labeller from generated pages and at most SAMPLE pages of the table, the first by a hash of their key."""
    first = pages.where(F.length(html) <= SAMPLE_CHARS).select(key).distinct().orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(SAMPLE)
    rows = pages.where(F.length(html) <= SAMPLE_CHARS).join(F.broadcast(first), key, "left_semi").select(F.col(html).cast("string")).limit(2 * SAMPLE)
    found = [leaves(r[0]) for r in sorted(rows.collect())]
    more, labels = generated(GENERATED)
    return train(more + found, labels + [marked(p) for p in found])


def main_text(pages: list[str | None], net: Labeller) -> list[str]:
    found = [leaves(p or "") for p in pages]
    order = sorted((k for k, p in enumerate(found) if p), key=lambda k: len(found[k]))
    out = [""] * len(pages)
    lo = 0
    while lo < len(order):
        hi = lo + 1  # about as many padded blocks in each batch
        while hi < len(order) and hi - lo < 256 and len(found[order[hi]]) * (hi + 1 - lo) <= 20_000:
            hi += 1
        part = [found[k] for k in order[lo:hi]]
        x, mask = padded(features(part), [len(p) for p in part])
        keep = net.logits(x, mask) > 0
        for j, k in enumerate(order[lo:hi]):
            out[k] = "\n".join(b.text for b, y in zip(found[k], keep[:, j], strict=False) if y)
        lo = hi
    return out


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Adds text, the article without what surrounds it, to pages.

    Blocks are the text between block-level tags; references are decoded, white space is one space, empty blocks go. The
    network reads a page's whole block sequence both ways and keeps or drops each block; kept ones are joined by a line break.
    It is trained on generated pages, and on at most SAMPLE pages of the table labelled by their markup.

    Null, empty and text-free pages give an empty text. Repeated rows give equal texts. Broken markup and long pages are read
    to their end. An empty table gives an empty table. A column of pages named text gives way.
    """
    spark = pages.sparkSession
    common.prepare(spark, 500)
    net = spark.sparkContext.broadcast(fit(pages, html, key))
    taken = [c for c in carry or pages.columns if c != "text"]

    label = lambda batch: [pa.array(main_text(batch.column(0).to_pylist(), net.value), pa.string())]
    return common.mapped(pages, taken, [F.col(f"`{html}`").cast("string")], label, "text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, carry=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
