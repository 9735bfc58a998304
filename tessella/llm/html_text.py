r"""Operator 6, main text of HTML pages: a recurrent block labeller.

A page is cut into leaf blocks, the text between two block-level tags. Each
block is a vector: its hashed tag path (element names, class and id words of all
open elements), its hashed words, and a few counts. A bidirectional LSTM in
numpy reads a page's blocks in order and labels each with the whole page as
context; the main blocks, in page order, are the text.

There are no labelled pages, so the network is trained on pages that a seeded
generator writes: invented words under many layouts, with menus, headers,
adverts, notices, sidebars, forms, reader comments and footers around or inside
articles of different mark-up. Training takes a few seconds on the driver; the
weights (about 200 KB) are broadcast.

White space is ``[\x20\x09-\x0D]``, so no-break spaces stay as they are. The
text of formulas and of an object's fallback is text; drawings (svg) are mark-up.

Defined cases: null html and pages without main blocks give an empty text; raw
text elements, comments and the head are never blocks; a page of any length is
read whole; a broken tag ends at its next ``>``; a block whose probability is
exactly one half is main text; repeated rows are extracted alike; an empty table
gives an empty result; columns beside page_id, url and html aren't read, whatever
their names.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import textops as tx
from tessella.llm.common import ship

PATH, WORDS, COUNTS, HIDDEN = 96, 32, 8, 24
INPUT = PATH + WORDS + COUNTS
PAGES, EPOCHS, BATCH, RATE = 1600, 6, 32, 0.01

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: An attribute value without quotes at the end of a tag, which a slash belongs to.
_VALUE = re.compile(r"=\s*[^\s\"'=<>`]+$")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_PART = re.compile(r"[a-z]+")
# Element names of HTML by their part in a page.
RAW = frozenset("script style noscript template textarea title svg iframe select head annotation annotation-xml".split())
#: Elements that a head may hold; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes script style template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark object param q ruby rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mpadded mphantom menclose mstyle merror mtable mtr mtd".split()
)
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body div section article aside nav main header footer form blockquote".split())


def _raw_end(page: str, at: int, name: str, attributes: str, unclosed: set[str]) -> int:
    """Where a raw element whose start tag ends at ``at`` is over. Without an end tag, only script and style take the rest of the page."""
    if name == "svg" and attributes.endswith("/") and not _VALUE.search(attributes):
        return at
    close = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
    if close:
        return close.end()
    unclosed.add(name)
    return len(page) if name in ("script", "style") else at


def _head_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where a head is over: at its end tag; without one, before the first text or element that can't be in a head."""
    text = None
    while True:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if text is None and page[at:stop].strip():
            text = at
        if not m:
            break
        name = (m[2] or m[5] or "").lower()
        if name == "head" and (m[1] or m[4]):
            return m.end()
        if name and name not in IN_HEAD and not (m[1] or m[4]):
            break
        at = m.end()
        if name in RAW and not (m[1] or m[4]):
            at = _raw_end(page, at, name, m[3] if m[2] else m[6], unclosed)
    return stop if text is None else text


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """The page's leaf blocks in order: path words, text, characters inside links."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    in_link = False
    at, size = 0, len(page)
    path: tuple[str, ...] = ()
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = _SPACE.sub(" ", text).strip(" ")
            if text:
                out.append((path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end = name.lower(), bool(m[1] or m[4])
        if name in RAW and not end:
            at = _head_end(page, at, unclosed) if name == "head" else _raw_end(page, at, name, m[3] if m[2] else m[6], unclosed)
            parts.append(" ")
            continue
        if name == "br":
            parts.append("\n")
            continue
        if name == "a":
            in_link = not end
        if name in INLINE:
            continue
        flush()
        in_link = False
        if name in VOID:
            continue
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            drop = CLOSES.get(name)
            if drop:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in drop:
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPE:
                        break
            words = [name]
            attributes = m[3] if m[2] else m[6]
            if attributes and "=" in attributes:
                for x in _NAMES.findall(attributes):
                    words += ["." + w for w in _PART.findall("".join(x).lower())]
            stack.append((name, tuple(words)))
        path = tuple(w for _, s in stack for w in s)
    flush()
    return out


_paths: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Two signed places for each distinct word of the path; the innermost element also by itself."""
    v = _paths.get(path)
    if v is None:
        v = np.zeros(PATH, np.float32)
        leaf = [w for w in path if w[0] != "."][-1:]
        for w in {*path, *("leaf:" + x for x in leaf)}:
            h = zlib.crc32(w.encode())
            v[h % PATH] += 1 if h >> 30 & 1 else -1
            v[(h >> 8) % PATH] += 1 if h >> 31 & 1 else -1
        if len(_paths) > 50_000:
            _paths.clear()
        _paths[path] = v
    return v


def vectors(pages: list[list[tuple[tuple[str, ...], str, int]]]) -> np.ndarray:
    """Input vectors of all blocks of the pages, one after another."""
    flat = [b for page in pages for b in page]
    out = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return out
    out[:, :PATH] = np.stack([path_vector(b[0]) for b in flat])
    data, offsets = tx.raw(pa.array([b[1] for b in flat], pa.large_string()))
    hashes, row = tx.word_hashes(data, offsets)
    count = np.bincount(row, minlength=len(flat))
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    bags = np.bincount(row * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), sign, len(flat) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = bags / np.maximum(1, np.sqrt((bags * bags).sum(axis=1)))[:, None]
    chars = np.array([len(b[1]) for b in flat], np.float32)
    links = np.array([b[2] for b in flat], np.float32)
    ends = np.array([b[1][-1] in ".!?…" for b in flat], np.float32)
    place = np.concatenate([np.linspace(0, 1, len(p), dtype=np.float32) for p in pages])
    depth = np.array([len(b[0]) for b in flat], np.float32)
    out[:, PATH + WORDS :] = np.stack([np.log1p(count) / 4, np.log1p(chars) / 6, links / np.maximum(1, chars), ends, place, 1 - place, depth / 10, (count < 4)], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * HIDDEN))
        w[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        w[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
    w["o"], w["ob"] = rng.normal(0, 0.1, (2 * HIDDEN + INPUT, 1)), np.zeros(1)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _direction(w: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """One direction over [time, page, INPUT]; padding leaves the state as it is. States, and what the way back needs."""
    steps, n, _ = x.shape
    xs = (x.reshape(-1, INPUT) @ w[f"x{d}"] + w[f"c{d}"]).reshape(steps, n, -1)
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = xs[t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        live = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        if keep:
            tape.append((t, h, c, i, f, o, g, tc, live))
        h, c = np.where(live, o * tc, h), np.where(live, c2, c)
        out[t] = h
    return out, tape


def _back(w: dict, d: str, x: np.ndarray, tape: list, dout: np.ndarray) -> dict:
    steps, n, _ = x.shape
    dz_all = np.zeros((steps, n, 4 * HIDDEN), np.float32)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    dwh = np.zeros_like(w[f"h{d}"])
    for t, h, c, i, f, o, g, tc, live in reversed(tape):
        dh = dh + dout[t]
        dhl, dcl = np.where(live, dh, 0), np.where(live, dc, 0)
        dct = dcl + dhl * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dhl * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        dwh += h.T @ dz
        dh, dc = np.where(live, dz @ w[f"h{d}"].T, dh), np.where(live, dct * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return {f"x{d}": x.reshape(-1, INPUT).T @ flat, f"h{d}": dwh, f"c{d}": flat.sum(axis=0)}


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[time, page, INPUT] and the mask, of pages that lie one after another in x."""
    steps = int(sizes.max())
    mask = np.arange(steps)[:, None] < sizes[None, :]
    out = np.zeros((len(sizes), steps, x.shape[1]), np.float32)
    out[mask.T] = x
    return np.ascontiguousarray(out.transpose(1, 0, 2)), mask


def probabilities(w: dict, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Probability of main text for each block; pages are run in groups of like length."""
    out = np.zeros(len(x), np.float32)
    first = sizes.cumsum() - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    k = 0
    while k < len(order):
        group = order[k : k + max(1, min(64, 100_000 // max(1, int(sizes[order[min(k + 63, len(order) - 1)]]))))]
        k += len(group)
        rows = np.concatenate([np.arange(first[p], first[p] + sizes[p]) for p in group])
        xs, mask = _padded(x[rows], sizes[group])
        both = np.concatenate([_direction(w, "f", xs, mask, False)[0], _direction(w, "b", xs, mask, False)[0], xs], axis=2)
        p = _sigmoid(both @ w["o"] + w["ob"])[:, :, 0]
        out[rows] = p.T[mask.T]
    return out


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = 6) -> dict[str, np.ndarray]:
    """Weights fitted by Adam to generated pages."""
    rng = np.random.Generator(np.random.PCG64(seed))
    data = []
    for k in range(pages):
        page, good = generated_page(random.Random(seed * 1_000_003 + k))
        found = blocks(page)
        if found:
            data.append((vectors([found]), np.array([b[1] in good for b in found], np.float32)))
    w = start_weights(rng)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, total = 0, epochs * -(-len(data) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        order = np.concatenate([np.array(sorted(order[k : k + 8 * BATCH], key=lambda i: len(data[i][1]))) for k in range(0, len(order), 8 * BATCH)])
        starts = rng.permutation(np.arange(0, len(order), BATCH))
        for k in starts:
            batch = [data[i] for i in order[k : k + BATCH]]
            sizes = np.array([len(y) for _, y in batch])
            x, mask = _padded(np.concatenate([v for v, _ in batch]), sizes)
            y, _ = _padded(np.concatenate([t for _, t in batch])[:, None], sizes)
            hf, tf = _direction(w, "f", x, mask, True)
            hb, tb = _direction(w, "b", x, mask, True)
            both = np.concatenate([hf, hb, x], axis=2)
            p = _sigmoid(both @ w["o"] + w["ob"])
            dz = (p - y) * mask[:, :, None] / mask.sum()
            grads = {"o": both.reshape(-1, both.shape[2]).T @ dz.reshape(-1, 1), "ob": dz.sum(axis=(0, 1))}
            dh = dz @ w["o"].T
            grads |= _back(w, "f", x, tf, dh[:, :, :HIDDEN]) | _back(w, "b", x, tb, dh[:, :, HIDDEN : 2 * HIDDEN])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in grads.items():
                m, v = state[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


# Words of page furniture in class names and in its text.
FURNITURE = {
    "menu": ("nav menu topbar navbar navigation links breadcrumb tabs", "home about contact login news products services more search help"),
    "header": ("header masthead site branding top banner logo", "welcome official site your daily portal"),
    "ad": ("ad ads advert advertisement sponsored promo banner sponsor", "sponsored advertisement buy now offer sale discount shop"),
    "notice": ("cookie consent notice gdpr privacy popup modal alert banner", "cookies accept we use privacy policy agree consent settings"),
    "sidebar": ("sidebar side widget related popular trending recommended aside", "related popular most read recent posts tags archive see also"),
    "form": ("form search newsletter subscribe signup login", "subscribe email your name send submit search sign up password"),
    "comments": ("comments comment replies discussion responses disqus reader", "reply says comments posted by likes report ago"),
    "footer": ("footer bottom copyright legal colophon foot", "copyright all rights reserved terms privacy imprint contact"),
    "share": ("share social sharing follow toolbar byline meta", "share tweet follow us facebook print mail"),
}
MAIN = "article main content post entry story body text page hentry".split()
PLAIN = "wrapper container row col inner box block section wrap grid".split()


def generated_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of invented words, and the texts of its main blocks."""
    alphabet = ["".join(rng.choice("bcdfghjklmnprstvwzéñüß") + rng.choice("aeiouäèó") + rng.choice(["", "n", "r", "s", "nt"]) for _ in range(1)) for _ in range(30)]
    good: set[str] = set()

    def word() -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))

    def words(n: int, kind: str = "") -> str:
        own = FURNITURE[kind][1].split() if kind and rng.random() < 0.5 else []
        text = " ".join(rng.choice(own) if own and rng.random() < 0.5 else word() for _ in range(max(1, n)))
        return text[:1].upper() + text[1:]

    def prose(most: int = 8) -> str:
        mark = rng.choice(["", "", "", "### ", "*** ", "&amp;&amp; ", "!! ", "| "])
        return " ".join(words(rng.choice([1, 3, 6, 9, 14, 20])).replace(" ", mark.rstrip() + " " if mark.strip() else " ") + "." for _ in range(rng.randint(1, most)))

    def clean(text: str) -> str:
        return _SPACE.sub(" ", entities.unescape(text)).strip(" ")

    def attribute(kind: str, sure: bool = False) -> str:
        if not sure and rng.random() < 0.2:
            return ""
        names = [rng.choice(FURNITURE[kind][0].split())] + ([rng.choice(PLAIN)] if rng.random() < 0.3 else [])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(names)}"'

    def links(kind: str, n: int) -> str:
        items = [f'<a href="/{word()}">{words(rng.randint(1, 4), kind)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def heading(kind: str) -> str:
        h = rng.choice(["h1", "h2", "h3", "h3", "h4", "h5", "strong"])
        return f"<{h}>{words(rng.randint(1, 3), kind)}</{h}>"

    def furniture(kind: str, inside: bool = False) -> str:
        tag = {"menu": ["nav", "div"], "header": ["header", "div"], "sidebar": ["aside", "div"], "footer": ["footer", "div"], "form": ["form", "div"], "comments": ["section", "div", "ol"]}.get(kind, ["div", "section", "p"])
        t = rng.choice(tag)
        if kind == "menu":
            inner = links(kind, rng.randint(2, 9))
        elif kind == "comments":
            inner = heading(kind) + "".join(f'<div{attribute(kind)}><b>{word()}</b> <span>{words(2, kind)}</span><p>{prose(3)}</p></div>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f'<label>{words(2, kind)}</label><input name="q"><button>{words(1, kind)}</button>'
            inner = inner if t == "form" else f"<form>{inner}</form>"
        elif kind == "sidebar":
            inner = heading(kind) + (links(kind, rng.randint(2, 6)) if rng.random() < 0.7 else f"<p>{prose(2)}</p>")
        elif kind == "footer":
            inner = f"&copy; {word()}.example &middot; {prose(2)}" if rng.random() < 0.6 else f"<p>{words(6, kind)}</p>" + links(kind, 3)
        elif kind == "header":
            title, h = words(rng.randint(1, 4), kind), rng.choice(["h1", "h1", "h2", "p"])
            title = f'<a href="/">{title}</a>' if rng.random() < 0.5 else title
            inner = f"<{h}>{title}</{h}><p>{words(rng.randint(2, 7), kind)}</p>" if rng.random() < 0.5 else f"<div>{title}</div>"
        elif kind == "share":
            inner = links(kind, rng.randint(1, 4))
        else:
            inner = prose(2) if rng.random() < 0.6 else f"<p>{words(8, kind)}</p><a href='/'>{words(2, kind)}</a>"
        named = attribute(kind, inside) or (f' class="{kind}"' if t in ("div", "section", "p", "ol") else "")
        return f"<{t}{named}>{inner}</{t}>"

    body: list[str] = []

    def main(tag: str, text: str, close: bool = True) -> None:
        good.add(clean(text))
        shown = text
        style = rng.random()
        if style < 0.2 and " " in text:
            a, b = text.split(" ", 1)
            shown = f"<b>{a}</b> {b}" if rng.random() < 0.5 else f'<a href="/">{a}</a> {b}'
        elif style < 0.3:
            shown, close = f"<b>{text}<br>", False
        body.append(f"<{tag}>{shown}" + (f"</{tag}>" if close else ""))

    if rng.random() < 0.85:
        main("h1", words(rng.randint(2, 12)))
    for _ in range(rng.choice([0, 1, 2, 4, 7, 12, 18])):
        x = rng.random()
        if x < 0.7:
            main("p", prose(), rng.random() < 0.85)
        elif x < 0.8:
            main(rng.choice(["h2", "h3"]), words(rng.randint(1, 6)))
        elif x < 0.86:
            items = [prose(2) for _ in range(rng.randint(2, 5))]
            good.update(map(clean, items))
            body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
        elif x < 0.89:
            main(rng.choice(["blockquote", "pre", "div"]), prose(3))
        elif x < 0.96:
            body.append(furniture(rng.choice(["ad", "ad", "share", "sidebar", "form", "notice"]), inside=True))
        else:
            main("p", words(rng.randint(1, 3)))
    shape = rng.random()
    names = rng.sample(MAIN, rng.randint(1, 2))
    if shape < 0.12:
        core = f"<section>{''.join(body)}</section>"
    elif shape < 0.18:
        core = f"<table><tr><td>{''.join(body)}</td></tr></table>"
    elif shape < 0.5:
        core = f"<article>{''.join(body)}</article>" if rng.random() < 0.6 else f'<article class="{names[0]}">{"".join(body)}</article>'
    elif shape < 0.65:
        core = f"<main>{''.join(body)}</main>"
    elif shape < 0.92:
        core = f'<div {rng.choice(["class", "id"])}="{"-".join(names)}">{"".join(body)}</div>'
    else:
        core = "".join(body)
    if rng.random() < 0.3:
        core = f'<div class="{rng.choice(PLAIN)}">{core}</div>'
    above = [furniture(k) for k in ("header", "menu", "notice", "ad", "share", "form", "sidebar") if rng.random() < 0.4]
    below = [furniture(k) for k in ("share", "ad", "sidebar", "form", "comments", "menu", "notice", "footer") if rng.random() < (0.6 if k in ("footer", "comments") else 0.3)]
    rng.shuffle(above)
    head = f"<head><title>{words(4)}</title><style>p{{margin:0}}</style></head>" if rng.random() < 0.9 else ""
    end = "</body></html>" if rng.random() < 0.9 else ""
    return f"<!DOCTYPE html><html>{head}<body>{''.join(above)}{core}{''.join(below)}{end}", good


def main_text(pages: list[str], w: dict) -> list[str]:
    """The main text of each page."""
    out = []
    for a, b in tx.text_runs(pages):
        cut = [blocks(p) for p in pages[a:b]]
        sizes = np.array([len(c) for c in cut], np.int64)
        p = probabilities(w, vectors(cut), sizes) >= 0.5
        at = 0
        for c in cut:
            out.append("\n".join(x[1] for x, yes in zip(c, p[at : at + len(c)], strict=True) if yes))
            at += len(c)
    return out


def _extract(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = main_text(["" if t is None else t for t in batch.column("html").to_pylist()], weights.value)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64()),
            })

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(train())
    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), f"page_id {id_type}, url string, text string, n_chars bigint")
