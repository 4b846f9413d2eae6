"""HTML extraction: a recurrent labeller of blocks.

A page becomes the sequence of its leaf blocks. Each block has a vector: hashed vectors of the tags, classes and ids on
the path to it, hashed vectors of its words, and a few measures. A bidirectional LSTM in numpy reads the whole sequence
and labels every block as main text or not, so a block is judged in the context of its document. It is trained on pages
that are generated here with known labels, and on a bounded sample of pages in which sectioning tags give labels away.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented bounds: pages of the table that training looks at (by hash of url), and pages generated for it.
TRAIN_PAGES, MADE_PAGES = 200, 1600
PATH_KINDS, PATH_DIM, WORD_KINDS, WORD_DIM, MEASURES, HIDDEN = 4096, 48, 1024, 12, 6, 24
SIZE = PATH_DIM + WORD_DIM + MEASURES
#: Blocks that are labelled together, padding included, and steps whose inputs are weighed together.
BATCH, CHUNK = 8_000, 2_048

#: Elements that run within a block, that never hold text of their own, that have no end, and that end an
#: open paragraph or list item of the same kind.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HIDDEN_TAGS = frozenset("script style noscript template head title svg math iframe object select option button textarea canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Sections that are not main text, and those that are, as they name themselves.
SIDE_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
SIDE_NAMES = "nav navbar navigation menu topbar header masthead footer sidebar aside widget ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal overlay newsletter subscribe signup login search share social related recommended trending comments comment reply replies respond discussion breadcrumb breadcrumbs pagination pager copyright legal toolbar tags author-box".split()
MAIN_TAGS = ("article", "main")
MAIN_NAMES = "article content main post entry story body text page".split()

#: Elements whose content is no markup.
RAW_TAGS = frozenset("script style noscript template textarea title svg iframe".split())

_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s=>/\"'][^\s=>/]*)(?:\s*=\s*(?:([\"'])|([^\s>\"'][^\s>]*))?)?")
_BARE = re.compile(r"[^\s>]*")
_NAMED = ("class", "id", "role")
_CLOSE = {tag: re.compile(f"</{tag}\\b", re.I) for tag in RAW_TAGS}


class Scanner:
    """Reads the tags of a page in one pass. A quote that is never closed is part of an unquoted value, and it is looked
    for once: what is not found from one place on is not found from a later one."""

    def __init__(self, page: str):
        self.page, self.never = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def attributes(self, at: int) -> tuple[int, list[str], bool]:
        """(place after the tag, words of its class, id and role, whether it closes itself) from after its name on."""
        page, names, n = self.page, [], len(self.page)
        while at < n:
            skipped = _BETWEEN.match(page, at)
            at = skipped.end()
            if page[at : at + 1] == ">":
                return at + 1, names, "/" in skipped[0]
            m = _ATTRIBUTE.match(page, at)
            if not m:
                at += 1  # a stray quote or equals sign
                continue
            at, value = m.end(), m[3] or ""
            if m[2]:
                end = self.find(m[2], at)
                if end < 0:
                    value = _BARE.match(page, at)[0]
                    at += len(value)
                else:
                    value, at = page[at:end], end + 1
            if m[1].lower() in _NAMED:
                names += [w for w in re.split(r"[^a-z0-9]+", value.lower()) if w]
        return n, names, False

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, list[str], bool]]:
        """(start, end, tag, whether it ends an element, names, closes itself) of each tag; comments, declarations and raw
        elements have the tag ''."""
        page, at, n = self.page, 0, len(self.page)
        while (start := page.find("<", at)) >= 0:
            m = _TAG.match(page, start)
            if m:
                tag = m[2].lower()
                at, names, closed = self.attributes(m.end())
                if tag in RAW_TAGS and not m[1]:
                    end = None if closed or f"</{tag}" in self.never else _CLOSE[tag].search(page, at)
                    if not closed and not end:
                        self.never.add(f"</{tag}")
                        at = n
                    elif end:
                        at = self.find(">", end.end()) + 1 or n
                    yield start, at, "", False, [], False
                else:
                    yield start, at, tag, bool(m[1]), names, closed
            elif page.startswith("<!--", start):
                at = self.find("-->", start + 4) + 3
                at = n if at < 4 else at
                yield start, at, "", False, [], False
            elif page[start + 1 : start + 2] in ("!", "?", "/") and page[start + 1 : start + 2]:
                at = self.find(">", start + 1) + 1 or n
                yield start, at, "", False, [], False
            else:
                at = start + 1


class Path:
    """The open elements over a block: its own names, those around it, and the sum of the vectors of all."""

    __slots__ = ("around", "depth", "names", "tag", "total")

    def __init__(self, tag: str, names: tuple[str, ...], around: Path | None):
        self.tag, self.names, self.around = tag, names, around
        own = _PATH_VECTORS[[_path_bucket(n) for n in names]].sum(axis=0)
        self.total = own if around is None else around.total + own
        self.depth = len(names) + (0 if around is None else around.depth)

    def __iter__(self) -> Iterator[str]:
        """Names from the outermost element inwards."""
        nodes, node = [], self
        while node is not None:
            nodes.append(node.names)
            node = node.around
        for names in reversed(nodes):
            yield from names


def blocks(page: str | None) -> list[tuple[Path | None, str, int]]:
    """(path, text, characters in links) of each leaf block with text, in page order. Null and empty pages have none.

    One pass over the page: open elements are kept with how many there are of each, so that an end tag without a start
    costs nothing, however deep the page is.
    """
    page = page or ""
    stack: list[Path] = []
    open_: dict[str, int] = {}
    found, parts = [], []
    linked, in_link, hidden, at = 0, 0, 0, 0

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            found.append((stack[-1] if stack else None, text, linked))
        parts.clear()
        linked = 0

    def pop():
        nonlocal hidden
        tag = stack.pop().tag
        open_[tag] -= 1
        hidden -= tag in HIDDEN_TAGS

    for start, end, tag, ends, names, closed in Scanner(page):
        if start > at and not hidden:
            parts.append(page[at:start])
            linked += (start - at) * (in_link > 0)
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if ends else 1
            continue
        if ends and not open_.get(tag) and tag != "p":
            continue  # an end without a start is no end of a block
        flush()
        in_link = 0
        if ends:
            while open_.get(tag):
                last = stack[-1].tag
                pop()
                if last == tag:
                    break
        else:
            if stack and stack[-1].tag == "p":  # any block ends a paragraph
                pop()
            if tag in SELF_CLOSING and stack and stack[-1].tag == tag:
                pop()
            if tag not in VOID and not closed:
                stack.append(Path(tag, (tag, *("." + w for w in names)), stack[-1] if stack else None))
                open_[tag] = open_.get(tag, 0) + 1
                hidden += tag in HIDDEN_TAGS
    if at < len(page) and not hidden:
        parts.append(page[at:])
    flush()
    return found


_RNG = np.random.default_rng(6)
_PATH_VECTORS = _RNG.normal(0, 1, (PATH_KINDS, PATH_DIM)).astype(np.float32)
_WORD_VECTORS = _RNG.normal(0, 1, (WORD_KINDS, WORD_DIM)).astype(np.float32)
_bucket: dict[str, int] = {}


def _path_bucket(name: str) -> int:
    if name not in _bucket:
        if len(_bucket) > 50_000:
            _bucket.clear()
        _bucket[name] = zlib.crc32(name.encode("utf-8", "replace")) % PATH_KINDS
    return _bucket[name]


def vectors(found: list[tuple[Path | None, str, int]], rename: dict[str, str] | None = None) -> np.ndarray:
    """The input vector of each block of a page. ``rename`` has names on paths that count as others (in training)."""
    x = np.zeros((len(found), SIZE), np.float32)
    for i, (path, text, linked) in enumerate(found):
        if path is not None:
            x[i, :PATH_DIM] = path.total if not rename else _PATH_VECTORS[[_path_bucket(rename.get(n, n)) for n in path]].sum(axis=0)
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if words:
            kinds = np.bincount(np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % WORD_KINDS, minlength=WORD_KINDS)
            x[i, PATH_DIM : PATH_DIM + WORD_DIM] = kinds @ _WORD_VECTORS / len(words)
        depth = 0 if path is None else path.depth
        x[i, -MEASURES:] = (np.log1p(len(words)) / 4, min(1, linked / max(1, len(text))), i / max(1, len(found) - 1), sum(map(text.count, ".!?")) / max(1, len(words)), min(depth, 30) / 10, 1)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM over padded sequences (time, batch, SIZE), with a logistic output for each block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w = {}
        for side in "fb":
            self.w[f"{side}x"] = rng.normal(0, 0.08, (SIZE, 4 * HIDDEN)).astype(np.float32)
            self.w[f"{side}h"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.w[f"{side}b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, side, x, mask):
        """States through time; a masked step keeps the state as it is."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        z = x @ self.w[f"{side}x"] + self.w[f"{side}b"]
        kept = []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            a = z[t] + h @ self.w[f"{side}h"]
            i, f, o, g = _sigmoid(a[:, :HIDDEN]), _sigmoid(a[:, HIDDEN : 2 * HIDDEN]), _sigmoid(a[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            kept.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            kept[-1] += (h,)
        return kept

    def states(self, side, x, mask, out):
        """What _run() gives, states alone: written to ``out``, with the inputs taken some steps at a time."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        wx, wh, wb = (self.w[f"{side}{n}"] for n in "xhb")
        starts = range(0, len(x), CHUNK)
        for at in starts if side == "f" else reversed(starts):
            z = x[at : at + CHUNK] @ wx + wb
            for t in range(len(z)) if side == "f" else range(len(z) - 1, -1, -1):
                a = z[t] + h @ wh
                gates = _sigmoid(a[:, : 3 * HIDDEN])
                c2 = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(a[:, 3 * HIDDEN :])
                m = mask[at + t][:, None]
                h, c = m * gates[:, 2 * HIDDEN :] * np.tanh(c2) + (1 - m) * h, m * c2 + (1 - m) * c
                out[at + t] = h

    def probabilities(self, x, mask):
        """What forward() gives as probabilities, in memory of a few states a block."""
        score = np.zeros(x.shape[:2], np.float32)
        held = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            self.states(side, x, mask, held)
            score += (held @ self.w["o"][part])[..., 0]
        return _sigmoid(score + self.w["ob"])

    def forward(self, x, mask):
        f, b = self._run("f", x, mask), self._run("b", x, mask)
        both = np.zeros((*x.shape[:2], 2 * HIDDEN), np.float32)
        for k in f:
            both[k[0], :, :HIDDEN] = k[-1]
        for k in b:
            both[k[0], :, HIDDEN:] = k[-1]
        return _sigmoid((both @ self.w["o"])[..., 0] + self.w["ob"]), both, f, b

    def gradients(self, x, mask, y):
        p, both, f, b = self.forward(x, mask)
        d = ((p - y) * mask / max(1.0, mask.sum()))[..., None].astype(np.float32)
        grads = {"o": np.einsum("tbh,tbk->hk", both, d), "ob": d.sum(axis=(0, 1))}
        d_both = d @ self.w["o"].T
        for side, kept, part in (("f", f, slice(0, HIDDEN)), ("b", b, slice(HIDDEN, None))):
            gx, gh, gb = (np.zeros_like(self.w[f"{side}{n}"]) for n in "xhb")
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, fg, o, g, tc, m, _ in reversed(kept):
                dh = dh + d_both[t, :, part]
                dc2 = m * (dc + dh * o * (1 - tc**2))
                da = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * fg * (1 - fg), m * dh * tc * o * (1 - o), dc2 * i * (1 - g**2)], axis=1)
                gx += x[t].T @ da
                gh += h.T @ da
                gb += da.sum(axis=0)
                dh, dc = da @ self.w[f"{side}h"].T + (1 - m) * dh, dc2 * fg + (1 - m) * dc
            grads |= {f"{side}x": gx, f"{side}h": gh, f"{side}b": gb}
        return p, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 20, batch: int = 24, rate: float = 0.008, seed: int = 2):
        """Adam over shuffled batches of (vectors, labels)."""
        rng, m, v, step = np.random.default_rng(seed), {k: 0 * w for k, w in self.w.items()}, {k: 0 * w for k, w in self.w.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                chosen = [pages[k] for k in order[at : at + batch]]
                x, mask = padded([p for p, _ in chosen])
                y = np.zeros(mask.shape, np.float32)
                for k, (_, labels) in enumerate(chosen):
                    y[: len(labels), k] = labels
                _, grads = self.gradients(x, mask, y)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g**2
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of main text for the blocks of each page; pages of like length go together, as many as have
        BATCH blocks between them, or one by itself."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= BATCH:
                end += 1
            p = self.probabilities(*padded([pages[k] for k in order[at:end]]))
            for n, k in enumerate(order[at:end]):
                out[k] = p[: len(pages[k]), n]
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), SIZE), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


def given_away(path: Path | None) -> bool | None:
    """What sectioning tags and names on a path say: True main text, False not, None nothing. Those within count."""
    said = None
    in_main = False
    for n in path or ():
        if n in MAIN_TAGS:
            said, in_main = True, True
        elif n in SIDE_TAGS and not (n == "header" and in_main) or n[0] == "." and n[1:] in SIDE_NAMES:
            return False
        elif n[0] == "." and n[1:] in MAIN_NAMES:
            said, in_main = True, True
    return said


def generate(n: int, seed: int = 3, layouts: tuple[str, ...] | None = None) -> list[tuple[str, list[bool]]]:
    """Pages with the label of each block: random words in many layouts, so that neither words nor the names of elements
    by themselves tell much. ``layouts``: names in LAYOUTS of the elements around the main text, all alike often."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "an ber ch de eau er es ing ion ka lo men nd ou que re sch ti un ver wh zu ó ü".split()
    word = lambda: "".join(pick(syllables) for _ in range(1 + int(rng.integers(3))))
    some = lambda lo, hi: " ".join(word() for _ in range(int(rng.integers(lo, hi)))) + pick([".", ".", "", "!"])

    def side(labels: list[bool]) -> str:
        if rng.random() < 0.15:
            return comments(labels)
        name = pick(SIDE_NAMES)
        opening, tag = (f'<div class="{name}">', "div") if rng.random() < 0.6 else (f"<{(t := pick(SIDE_TAGS))}>", t)
        if rng.random() < 0.25:
            opening, tag = pick([f'<section id="{name}">', f'<section class="{word()} {name}">']), "section"
        kind = rng.random()
        if kind < 0.4:
            k = int(rng.integers(1, 7))
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{some(1, 3)}</a></li>' for _ in range(k)) + "</ul>"
            if rng.random() < 0.2:  # lists of links without a name
                opening, tag = "<div>", "div"
        else:
            k = int(rng.integers(1, 5))
            inner = "".join(pick(["<p>{}</p>", "<div>{}</div>", "<h3>{}</h3>"]).format(some(1, 30)) for _ in range(k)) if kind < 0.8 else some(1, 25)
            k = k if kind < 0.8 else 1
        labels += [False] * k
        return f"{opening}{inner}</{tag}>"

    def comments(labels: list[bool]) -> str:
        k = int(rng.integers(1, 6))
        holder = pick(['<div class="comments">', '<div id="comments">', '<section class="comments">', '<div id="respond">', '<div class="replies">'])
        each = pick(["<p>{0}</p><p>{1}</p>", '<div class="comment"><b>{0}</b><p>{1}</p></div>', '<article class="comment"><h4>{0}</h4><p>{1}</p></article>'])
        labels += [False] * (2 * k + 1)
        return f"{holder}<h3>{some(1, 3)}</h3>" + "".join(each.format(some(1, 3), some(3, 45)) for _ in range(k)) + ("</section>" if "section" in holder else "</div>")

    pages = []
    for _ in range(n):
        labels: list[bool] = []
        out = ["<html><body>"]
        out += [side(labels) for _ in range(int(rng.integers(0, 4)))]
        opening, closing = LAYOUTS[pick(layouts or tuple(LAYOUTS))]
        names = {"main": pick(MAIN_NAMES), "any": word()}
        around = [pick(["div", "div", "section", "center", f'div class="{word()}"']) for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.4 else 0)]
        out += [*(f"<{x}>" for x in around), opening.format(**names)]
        if rng.random() < 0.7:
            heading = pick(["h1", "h2"])
            out.append(f"<{heading}>{some(1, 14)}</{heading}>")
            labels.append(True)
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.08:
                out.append(side(labels))
            elif kind < 0.16:
                k = int(rng.integers(1, 5))
                out.append("<ul>" + "".join(f"<li>{some(1, 20)}</li>" for _ in range(k)) + "</ul>")
                labels += [True] * k
            elif kind < 0.21:
                k = int(rng.integers(1, 4))
                out.append("<table>" + "".join(f"<tr><td>{some(1, 4)}</td><td>{some(1, 6)}</td></tr>" for _ in range(k)) + "</table>")
                labels += [True] * (2 * k)
            else:
                out.append(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<h2>{}</h2>", "<pre>{}</pre>", "<div>{}</div>"]).format(some(1, 2) if rng.random() < 0.15 else some(2, 90)))
                labels.append(True)
        out += [closing, *(f"</{x.split()[0]}>" for x in reversed(around))]
        if rng.random() < 0.3:
            out.append(comments(labels))
        out += [side(labels) for _ in range(int(rng.integers(0, 4)))]
        pages.append(("".join(out), labels))
    return pages


#: Elements around the main text of generated pages; those in the second row say nothing by their names.
LAYOUTS = {
    "article": ("<article>", "</article>"), "main": ("<main><div>", "</div></main>"), "named": ('<div class="{main}">', "</div>"), "both": ('<div id="{main}"><article class="{main}">', "</article></div>"),
    "plain": ("<div>", "</div>"), "other": ('<div class="{any}">', "</div>"), "section": ("<section>", "</section>"), "cell": ('<table><tr><td class="{any}">', "</td></tr></table>"), "none": ("", ""),
}


def train(sample: list[str], made: int = MADE_PAGES, seed: int = 4, layouts: tuple[str, ...] | None = None) -> Labeller:
    """A labeller from generated pages and from those sample pages whose every block is given away by its path. On half of
    the sample pages the names that gave main text away are hidden, and names of generated pages are made new at random, so
    that main text is not learned by name alone."""
    data = []
    rng = np.random.default_rng(seed)
    for page, labels in generate(made, layouts=layouts):
        found = blocks(page)
        if len(found) == len(labels) and found:
            data.append((vectors(found, unfamiliar(found, rng)), np.array(labels, np.float32)))
    telling = {n: "div" for n in (*MAIN_TAGS, *("." + n for n in MAIN_NAMES))}
    for page in sample:
        found = blocks(page)
        labels = [given_away(path) for path, _, _ in found]
        if found and None not in labels:
            data.append((vectors(found, telling if rng.random() < 0.5 else None), np.array(labels, np.float32)))
    return Labeller().fit(data)


def unfamiliar(found: list, rng: np.random.Generator) -> dict[str, str]:
    """On most pages, new names for about half of the names on paths but those of sections that are not main text:
    pages will have names that no page of the training had."""
    if rng.random() < 0.25:
        return {}
    side = {*SIDE_TAGS, *("." + n for n in SIDE_NAMES)}
    names = sorted({n for path, _, _ in found for n in path or ()} - side)
    return {n: f"?{rng.integers(1 << 30)}" for n in names if rng.random() < 0.5}


def sample_pages(pages: DataFrame, rows: int = TRAIN_PAGES) -> list[str]:
    """At most ``rows`` pages, those of the smallest hash of the html."""
    short = pages.filter(F.length("html") <= 50_000)
    n = short.count()
    if n > 2 * rows:  # about twice as many by another hash, so that tasks send no more than that between them
        short = short.filter(F.pmod(F.xxhash64("html", F.lit(5)), F.lit(1 << 20)) < max(1, (1 << 21) * rows // n))
    return [r["html"] for r in short.orderBy(F.xxhash64("html"), "html").select("html").limit(rows).collect()]


def extract(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks) of each row: the blocks labelled main text, in page order, joined by blank lines.

    Null, empty and text-less pages have the empty text. Rows that repeat are kept, null ids and urls stay null, an empty
    table gives no rows, and other columns are not looked at. Pages are read whole, however long.
    """
    held = pages.sparkSession.sparkContext.broadcast(model.w)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Labeller()
        ready.w = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [blocks(p) for p in part.column(2).to_pylist()]
                said = ready.label([vectors(f) for f in found])
                texts = ["\n\n".join(t for (_, t, _), p in zip(f, s, strict=True) if p >= 0.5) for f, s in zip(found, said, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())], names=["id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col(id_col).alias("id"), "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint, n_blocks bigint").withColumnRenamed("id", id_col)
