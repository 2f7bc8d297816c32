"""A bidirectional LSTM in numpy that labels every block of a page as article or not.

Inputs of a block: the hashed elements of its path, its hashed words and a few figures.  The model
reads all blocks of a page in both directions, so each label sees the whole page.  It is trained
here, on pages from a seeded generator, the first time a process needs it (a few seconds); the
number of pages is a parameter and the result is the same on every run.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np

from .html_blocks import Block, blocks

PATH, WORD, FIGURES, HIDDEN = 96, 32, 6, 16
INPUT = PATH + WORD + FIGURES
TRAINING_PAGES, EPOCHS, SEED = 1500, 14, 11


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    for x in path:
        out[zlib.crc32(x.encode()) % PATH] = 1
    return out


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = b = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD
        return b


_BUCKET = _Buckets()


def features(page: list[Block]) -> np.ndarray:
    """A row of inputs a block."""
    out = np.zeros((len(page), INPUT), np.float32)
    for i, block in enumerate(page):
        out[i, :PATH] = _path_vector(block.path)
        words = block.text.split()
        out[i, PATH : PATH + WORD] = np.bincount([_BUCKET[w] for w in words], minlength=WORD) / len(words)
        n = len(block.text)
        out[i, PATH + WORD :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, block.linked / n, block.text[-1] in ".!?…:", min(1, block.text.count(",") / len(words) * 5), len(block.path) / 10)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    def __init__(self, rng: np.random.Generator):
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.standard_normal((INPUT, 4 * HIDDEN)).astype(np.float32) / np.sqrt(INPUT).astype(np.float32)
            self.p["h" + d] = rng.standard_normal((HIDDEN, 4 * HIDDEN)).astype(np.float32) / np.sqrt(HIDDEN).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1  # to remember, at first
        self.p["o"] = rng.standard_normal(2 * HIDDEN).astype(np.float32) / np.float32(np.sqrt(2 * HIDDEN))
        self.p["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States of one direction; x: (time, pages, inputs), mask: (time, pages, 1)."""
        steps, pages = x.shape[:2]
        pre = x @ self.p["x" + d] + self.p["c" + d]
        h = np.zeros((pages, HIDDEN), np.float32)
        c = np.zeros_like(h)
        out, tape = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                tape.append((t, h, c, i, f, o, g, tanh))
            m = mask[t]
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        f, b = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        return np.concatenate([f, b], axis=2) @ self.p["o"] + self.p["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        (f, tape_f), (b, tape_b) = self._run(x, mask, "f", True), self._run(x, mask, "b", True)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.p["o"] + self.p["ob"]
        m = mask[:, :, 0].astype(np.float32)
        loss = float(((np.logaddexp(0, logits) - y * logits) * m).sum() / m.sum())
        d_logit = (_sigmoid(logits) - y) * m / m.sum()
        grads = {"o": np.einsum("tp,tph->h", d_logit, both), "ob": d_logit.sum(keepdims=True)[0][:1]}
        d_both = d_logit[:, :, None] * self.p["o"]
        for d, tape, d_out in (("f", tape_f, d_both[:, :, :HIDDEN]), ("b", tape_b, d_both[:, :, HIDDEN:])):
            dz_all, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.p["h" + d])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, h0, c0, i, fg, o, g, tanh in reversed(tape):
                dh = dh + d_out[t]
                live = mask[t].astype(np.float32)
                dn, dm = dh * live, dc * live
                do = dn * tanh
                dm = dm + dn * o * (1 - tanh**2)
                dz = np.concatenate([dm * g * i * (1 - i), dm * c0 * fg * (1 - fg), do * o * (1 - o), dm * i * (1 - g**2)], axis=1)
                dz_all[t] = dz
                gh += h0.T @ dz
                dh = dz @ self.p["h" + d].T + dh * (1 - live)
                dc = dm * fg + dc * (1 - live)
            grads["h" + d] = gh
            grads["x" + d] = np.einsum("tpi,tpz->iz", x, dz_all, optimize=True)
            grads["c" + d] = dz_all.sum(axis=(0, 1))
        return loss, grads


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages), 1), bool)
    for k, page in enumerate(pages):
        x[: len(page), k], mask[: len(page), k] = page, True
    return x, mask


def labels(model: BlockLabeller, pages: list[np.ndarray], together: int = 4096) -> list[np.ndarray]:
    """True for article blocks; pages of like length run together, about ``together`` blocks at once."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= together:
            end += 1
        x, mask = padded([pages[k] for k in order[at:end]])
        found = model.logits(x, mask) > 0
        for column, k in enumerate(order[at:end]):
            out[k] = found[: len(pages[k]), column]
        at = end
    return out


# ---- training pages -------------------------------------------------------------------------

_SYLLABLES = {
    "en": "the an in er on re ed nd ha at en es of th or to it is ou ea hi st nt ti as ing ion wh sh ly ble".split(),
    "de": "der die und ein ich en sch ung ver be ge keit heit lich au er te zu ß ü ö ä tz pf".split(),
    "fr": "le la de et les des un une ou que en aux ion ment eau oi é è ê ç ai re ier qui vi".split(),
    "es": "el la de que y en los del se las por un ción ado mente es ar ez os ñ í ó ga qu rr".split(),
}


def _words(rng: random.Random, n: int, lang: str) -> str:
    made = ["".join(rng.choice(_SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(made)


def _sentences(rng: random.Random, n: int, lang: str) -> str:
    return " ".join(_words(rng, rng.randint(3, 22), lang).capitalize() + rng.choice(".....?!") for _ in range(n))


def training_page(rng: random.Random) -> str:
    """A page whose article text carries the mark U+E000 at the start of each of its blocks."""
    lang, other = rng.choice(list(_SYLLABLES)), rng.choice(list(_SYLLABLES))
    mark = "\ue000"
    w = lambda a, b, x=other: _words(rng, rng.randint(a, b), x)
    s = lambda a, b, x=other: _sentences(rng, rng.randint(a, b), x)
    named = lambda *names: rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} {rng.choice(["wide", "box", "clearfix", "row"])}"'])
    links = lambda n: "".join(f'<li><a href="/{w(1, 1)}">{w(1, 3)}</a></li>' for _ in range(n))

    def menu():
        return rng.choice([f"<nav><ul>{links(rng.randint(2, 9))}</ul></nav>", f"<div{named('menu', 'nav', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'topnav')}><ul>{links(rng.randint(2, 9))}</ul></div>", f"<nav>{' '.join(f'<a href=#>{w(1, 2)}</a>' for _ in range(rng.randint(2, 7)))}</nav>"])

    def header():
        return rng.choice([f"<header><h1>{w(1, 4)}</h1><p>{w(2, 9)}</p></header>", f"<header>{s(1, 2)}</header>", f"<div{named('header', 'masthead', 'site-header', 'top')}><div>{w(1, 4)}</div><p>{s(1, 1)}</p></div>", f"<header>{menu()}<p>{w(1, 6)}</p></header>"])

    def footer():
        return rng.choice([f"<footer>&copy; {w(1, 2)} &middot; {s(1, 3)}</footer>", f"<footer><p>{s(1, 2)}</p><ul>{links(rng.randint(1, 5))}</ul></footer>", f"<div{named('footer', 'site-footer', 'copyright', 'colophon')}><p>{s(1, 3)}</p></div>"])

    def side():
        inner = rng.choice([f"<h3>{w(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul>", f"<p>{s(1, 4)}</p>", f"<h2>{w(1, 3)}</h2><p>{s(1, 3)}</p><p>{s(1, 3)}</p>"])
        return rng.choice([f"<aside>{inner}</aside>", f"<div{named('sidebar', 'side', 'related', 'widget', 'recommended', 'trending', 'more')}>{inner}</div>", f"<section{named('sidebar', 'related', 'widget')}>{inner}</section>"])

    def notice():
        tag = rng.choice(["div", "section", "p", "dialog"])
        return f"<{tag}{named('cookie', 'cookies', 'consent', 'notice', 'banner', 'alert', 'gdpr', 'popup', 'modal', 'newsletter', 'subscribe', 'paywall')}>{rng.choice(['', '<p>'])}{s(1, 3)}{rng.choice(['', f'<button>{w(1, 2)}</button>'])}</{tag}>"

    def advert():
        tag = rng.choice(["div", "div", "section", "aside", "p"])
        return f"<!-- ad {rng.randint(0, 999)} --><{tag}{rng.choice([' class=' + chr(34) + 'ad' + chr(34), named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'sponsor')])}>{rng.choice([s(1, 3), f'<p>{s(1, 2)}</p>', f'<a href=#>{w(2, 8)}</a>'])}</{tag}>"

    def form():
        return f"<form{rng.choice(['', named('search', 'login', 'contact', 'signup')])}><p>{s(1, 1)}</p><label>{w(1, 3)}</label><input name=q><select><option>{w(1, 2)}<option>{w(1, 2)}</select><button>{w(1, 2)}</button></form>"

    def comments():
        one = lambda: rng.choice([f'<div{named("comment", "comment-body", "reply")}><b>{w(1, 2)}</b><p>{s(1, 4)}</p></div>', f"<li{named('comment', 'reply')}><p>{s(1, 4)}</p></li>", f'<article{named("comment")}><p>{s(1, 4)}</p></article>', f"<p>{s(1, 3)}</p>"])
        tag = rng.choice(["div", "section", "ol", "ul", "aside"])
        return f"<{tag}{named('comments', 'comment-list', 'discussion', 'responses', 'disqus', 'commentlist')}>{rng.choice(['', f'<h3>{w(1, 3)}</h3>'])}{''.join(one() for _ in range(rng.randint(1, 6)))}</{tag}>"

    def share():
        return f"<div{named('share', 'social', 'tags', 'byline-links', 'pagination', 'pager')}>{rng.choice([w(1, 6), f'<ul>{links(3)}</ul>'])}</div>"

    def block():
        text = mark + _sentences(rng, rng.choice([1, 1, 2, 3, 5, 8]), lang)
        kind = rng.random()
        if kind < 0.55:
            return rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f'<p>{text} <a href="/x">{_words(rng, 2, lang)}</a>.</p>', f"<p>{mark}{_words(rng, rng.randint(1, 4), lang)}.</p>", f"<p><em>{text}</em></p>"])
        if kind < 0.65:
            return f"<h{rng.randint(2, 4)}>{mark}{_words(rng, rng.randint(1, 8), lang)}</h2>"
        if kind < 0.75:
            return "<ul>" + "".join(f"<li>{mark}{_words(rng, rng.randint(1, 14), lang)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.82:
            return f"<blockquote>{text}</blockquote>"
        if kind < 0.88:
            return f"<pre>{text}</pre>"
        if kind < 0.93:
            return "<table>" + "".join(f"<tr><td>{mark}{_words(rng, 2, lang)}</td><td>{mark}{rng.randint(0, 999)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<div>{text}</div>"

    title = f"<h1>{mark}{_sentences(rng, 1, lang) if rng.random() < 0.6 else _words(rng, rng.randint(1, 9), lang)}</h1>"
    count = rng.choice([0, 1, 1, 2, 3, 5, 8, 13, 25])
    body = [block() for _ in range(count)]
    for extra in (advert, notice, side, share, form):
        if rng.random() < 0.12 and body:
            body.insert(rng.randrange(len(body) + 1), extra())
    inside = (title if rng.random() < 0.85 else "") + "".join(body)
    if rng.random() < 0.1:
        inside += comments()
    wrap = rng.choice(["article", "article", "article", "main", "main><article", "div class=content", 'div class="post-content"', "div class=article", 'div id="content"', 'div class="entry"', "div class=story", 'section class="article-body"'])
    tags = [t.split()[0] for t in wrap.split("><")]
    article = "".join(f"<{t}>" for t in wrap.split("><")) + inside + "".join(f"</{t}>" for t in reversed(tags))
    top = [f() for f in (header, menu, form, notice, advert, side) if rng.random() < {menu: 0.75, advert: 0.6}.get(f, 0.25)]
    end = [f() for f in (share, comments, advert, side, form, notice) if rng.random() < 0.28]
    rng.shuffle(top)
    rng.shuffle(end)
    last = [footer()] if rng.random() < 0.85 else []
    return f"<!DOCTYPE html><html><head><title>{w(2, 6)}</title><style>p{{}}</style></head><body>{''.join(top)}{article}{''.join(end + last)}</body></html>"


def training_set(count: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(count):
        found = blocks(training_page(rng))
        truth = np.array(["\ue000" in b.text for b in found], np.float32)
        found = [Block(b.text.replace("\ue000", ""), b.path, b.linked) for b in found]
        keep = [k for k, b in enumerate(found) if b.text]
        xs.append(features([found[k] for k in keep]))
        ys.append(truth[keep])
    return xs, ys


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BlockLabeller:
    """A labeller fitted with Adam on ``pages`` generated pages."""
    xs, ys = training_set(pages, seed)
    rng = np.random.Generator(np.random.PCG64(seed))
    model = BlockLabeller(rng)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
    groups, step = [order[i : i + 16] for i in range(0, len(order), 16)], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for g in rng.permutation(len(groups)):
            x, mask = padded([xs[k] for k in groups[g]])
            y = np.zeros(mask.shape[:2], np.float32)
            for column, k in enumerate(groups[g]):
                y[: len(ys[k]), column] = ys[k]
            _, grads = model.gradients(x, mask, y)
            size = np.sqrt(sum(float((v**2).sum()) for v in grads.values()))
            step += 1
            for k, v in grads.items():
                v = v / max(1.0, size)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] = (model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model
