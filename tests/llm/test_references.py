"""The learned operators against plain versions of the same method."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from reviewrec.llm import html, langid, toxicity


def plain_kneser_ney(text):
    """log p of every character of a text by dictionaries, learned from the same text."""
    table = langid.symbols()
    code = [0, 0, 0]
    for c in text:
        s = int(table[ord(c)])
        if s or code[-1] or len(code) < 3:
            code.append(s)
    grams = [tuple(code[k : k + 4]) for k in range(len(code) - 3)]
    count = Counter(grams)
    before = {3: defaultdict(set), 2: defaultdict(set), 1: defaultdict(set)}
    for g in count:
        before[3][g[1:]].add(g[0])
    for g in before[3]:
        before[2][g[1:]].add(g[0])
    for g in before[2]:
        before[1][g[1:]].add(g[0])
    levels = {4: count, **{k: {g: len(x) for g, x in v.items()} for k, v in before.items()}}

    def discount(table):
        one, two = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        return one / (one + 2 * two) if one and one + 2 * two else 0.5

    def p(g):
        if len(g) == 1:
            total = sum(levels[1].values())
            return (levels[1].get(g, 0) + 0.5) / (total + 0.5 * langid.SYMBOLS)
        table = levels[len(g)]
        own = {h: v for h, v in table.items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        d, total = discount(table), sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * p(g[1:])

    return [math.log(p(g)) for g in grams]


def test_kneser_ney_against_dictionaries():
    text = "the cat sat on the mat, and the dog; der hund ist da über"
    gram, _, _ = langid.coded([text])
    keys, n = np.unique(gram, return_counts=True)
    model = langid.build({"x": (keys, n)})
    got = model.log_probabilities(gram)[:, 0]
    assert np.allclose(got, plain_kneser_ney(text), atol=1e-4)


def test_ftrl_against_a_plain_loop():
    r = np.random.RandomState(2)
    rows = [(np.unique(r.randint(0, 50, 8)), int(r.rand() < 0.4)) for _ in range(300)]
    state = np.zeros((2, 1 << toxicity.BITS))
    toxicity.ftrl(iter(rows), state)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for x, y in rows:
        w = {i: weight(i) for i in x}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in x:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
    want = np.zeros(50)
    for i in range(50):
        want[i] = weight(i)
    assert np.allclose(toxicity.weights_of(state)[:50], want, atol=1e-5) and (want == 0).any() and (want != 0).any()


def test_features_are_words_stems_pairs_and_skips():
    data, bounds = b"Nasty little words", np.array([0, 18])
    x, doc = toxicity.features(np.frombuffer(data, np.uint8), bounds)
    # three words, their stems of 4 to 8 letters, two pairs, one skip
    stems = sum(len(w) > k for w in ("nasty", "little", "words") for k in toxicity.STEMS)
    assert len(x) == 3 + stems + 2 + 1 and set(doc) == {0}
    assert set(toxicity.features(np.frombuffer(b"nasty LITTLE words", np.uint8), bounds)[0]) == set(x)


def test_long_text_is_scored_whole():
    w = np.zeros(1 << toxicity.BITS, np.float32)
    x, _ = toxicity.features(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    w[x[0]] = 3
    texts = ["plain words " * 200_000 + "vile", "plain words " * 10, None]
    assert np.round(toxicity.score(pa.array(texts), w), 3).tolist() == [0.953, 0.5, 0.5]


def plain_lstm(net, x):
    """Logits of one page by loops over blocks and units."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    w, size = net.weights, html.HIDDEN
    states = {}
    for way in "fb":
        h, c = [0.0] * size, [0.0] * size
        out = [None] * len(x)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = [w[f"{way}b"][k] + sum(float(x[t][j]) * w[f"{way}x"][j, k] for j in np.flatnonzero(x[t])) + sum(h[j] * w[f"{way}h"][j, k] for j in range(size)) for k in range(4 * size)]
            i, f, o = ([sig(v) for v in g[k * size : (k + 1) * size]] for k in range(3))
            u = [math.tanh(v) for v in g[3 * size :]]
            c = [f[k] * c[k] + i[k] * u[k] for k in range(size)]
            h = [o[k] * math.tanh(c[k]) for k in range(size)]
            out[t] = h
        states[way] = out
    return [sum(a * b for a, b in zip([*states["f"][t], *states["b"][t]], w["o"], strict=True)) + w["c"][0] for t in range(len(x))]


def test_labeller_against_loops():
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title</h1><p>Some words of prose.</p><p>More.</p></article><footer>End</footer></body></html>"
    other = "<div><p>One block</p></div>"
    pages = [html.leaves(p) for p in (page, other)]
    net = html.Labeller.fresh(3)
    x, mask = html.padded(html.features(pages), [len(p) for p in pages])
    got = net.logits(x, mask)
    for j, p in enumerate(pages):
        assert np.allclose(got[: len(p), j], plain_lstm(net, html.features([p])), atol=1e-4)
