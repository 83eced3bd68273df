r"""Main text of web pages by a recurrent block labeller.

A page is read into blocks of text (leaves of the tag tree; inline tags do not part them). Each block becomes a vector: its tag
path with the class, id and role words of all elements above it, hashed; all its words, hashed; and its length, share of linked
characters, of signs and of digits, and place. A bidirectional LSTM in numpy reads the page's whole sequence and decides for
every block whether it belongs to the article. Text of scripts, styles and comments is markup and never a block.

The network is trained here, from a fixed seed, on pages made by a generator that writes articles among menus, headers, footers,
sidebars, notices, adverts, forms and reader comments with many layouts, so labels are known exactly. Training pages are a bounded
number, ``pages``; every block of every page is labelled.

Blocks kept are written with character references decoded and white space turned into single spaces, joined by ``\n\n``.

Defined cases: a null or empty page has the empty text; a page cut off within a tag or comment loses only that tag or comment;
pages of any length are read whole; equal pages have equal texts; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that do not part text, that have no content, whose content is no text, and that end an open paragraph.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|noscript|svg|iframe|textarea"
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(>?)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[^a-z]+")

_PATH, _WORD, _NUM = 96, 48, 8
_SHALLOW = 24
DIM = _PATH + _WORD + _NUM


@dataclass(frozen=True)
class HtmlParams:
    hidden: int = 24
    embed: int = 32
    pages: int = 1600
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01
    seed: int = 8


class Place:
    """An open element: its own words, those of them that no element above it has, and the element above."""

    __slots__ = ("up", "words", "new", "depth", "_sum", "_tail")

    def __init__(self, up: Place | None, words: tuple[str, ...], new: tuple[str, ...]) -> None:
        self.up, self.words, self.new, self._sum, self._tail = up, words, new, None, None
        self.depth = up.depth + 1 if up else 1

    def __str__(self) -> str:
        """The words of all elements from the outermost one to this."""
        parts, node = [], self
        while node is not None:
            parts.append(" ".join(node.words))
            node = node.up
        return " ".join(reversed(parts))

    def __eq__(self, other: object) -> bool:
        return str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    def _fill(self) -> None:
        """Add up hashed words from the nearest element above that has its sum: each element is done once."""
        chain, node = [], self
        while node is not None and node._sum is None:
            chain.append(node)
            node = node.up
        above, tail = (node._sum, node._tail) if node else (np.zeros(_PATH, np.float32), ())
        for x in reversed(chain):
            if x.new:
                above = above + sum(_hashed("p", w) for w in x.new)
            tail = (tail + x.words)[-3:]
            x._sum, x._tail = above, tail

    def vector(self) -> np.ndarray:
        """Two hashed places for each word of the path, with signs; the words of the innermost elements once more on their own."""
        if self.depth <= _SHALLOW:  # most paths are short and come again
            return _path_vector(str(self))
        if self._sum is None:
            self._fill()
        return self._sum + _tail_vector(self._tail)


@lru_cache(maxsize=50_000)
def _hashed(salt: str, word: str) -> np.ndarray:
    v = np.zeros(_PATH, np.float32)
    for turn in range(2):
        h = zlib.crc32(f"{salt}{turn}{word}".encode())
        v[h % _PATH] += 1.0 if h & 65536 else -1.0
    return v


@lru_cache(maxsize=20_000)
def _path_vector(path: str) -> np.ndarray:
    words = path.split()
    return sum((_hashed("p", w) for w in set(words)), np.zeros(_PATH, np.float32)) + _tail_vector(tuple(words[-3:]))


@lru_cache(maxsize=50_000)
def _tail_vector(tail: tuple[str, ...]) -> np.ndarray:
    return sum((_hashed("q", w) for w in set(tail)), np.zeros(_PATH, np.float32))


def blocks_of(page: str) -> list[tuple[Place | str, str, float]]:
    """(place in the tag tree or "" outside it, text, share of linked characters) of each block with text."""
    out: list[tuple[Place | str, str, float]] = []
    stack: list[tuple[str, Place]] = []
    names, seen = Counter(), Counter()  # of the open elements
    parts: list[str] = []
    path, linked, links = "", 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((path, text, linked / max(1, sum(map(len, parts)))))
            parts.clear()
            linked = 0

    def pop(to: int) -> None:
        nonlocal links
        for name, place in stack[to:]:
            links -= name == "a"
            names[name] -= 1
            seen.subtract(place.new)
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if not parts:
                path = stack[-1][1] if stack else ""
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[3]:
            if m[1]:
                flush()
            continue
        if not m[5]:  # no end of the tag in sight: it goes on to the next one, or to the end of a page cut off here
            at = page.find(">", at) + 1 or end
        name = m[3].lower()
        if name == "br":
            parts.append("\n")
            continue
        if name not in INLINE:
            flush()
        if m[2]:
            for k in () if not names[name] else range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in ENDS_P:
            for k in () if not names["p"] else range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif name in SAME:
            for k in () if not names[name] else range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
                if stack[k][0] in SAME[name]:
                    break
        if name not in VOID:
            words = [name]
            if "=" in m[4]:
                for _, x, y, z in _ATTR.findall(m[4]):
                    words += ["." + w for w in _PARTS.split((x or y or z).lower()) if w]
            new = tuple(w for w in dict.fromkeys(words) if not seen[w])
            stack.append((name, Place(stack[-1][1] if stack else None, tuple(words), new)))
            names[name] += 1
            seen.update(new)
            links += name == "a"
    flush()
    return out


@lru_cache(maxsize=200_000)
def _word_at(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % _WORD


def vectors(blocks: list[tuple[Place | str, str, float]]) -> np.ndarray:
    n = len(blocks)
    out = np.zeros((n, DIM), np.float32)
    for k, (path, text, linked) in enumerate(blocks):
        words = text.lower().split()
        if path:
            out[k, :_PATH] = path.vector()
        out[k, _PATH : _PATH + _WORD] = np.bincount([_word_at(w) for w in words], minlength=_WORD) / len(words) ** 0.5
        size = len(text)
        out[k, _PATH + _WORD :] = (size**0.25 / 4, linked, min(1.0, len(words) / 20), text.count(",") / len(words), text[-1] in ".!?…:", sum(map(text.count, "0123456789")) / size, k / n, k < 3)
    return out


class Labeller:
    """Embedding, forward and backward LSTM, and a logistic output; trained by Adam through time."""

    def __init__(self, p: HtmlParams) -> None:
        rng = np.random.default_rng(p.seed)
        h, e = p.hidden, p.embed
        init = lambda *s: (rng.standard_normal(s) / s[0] ** 0.5).astype(np.float32)
        self.h = h
        self.w: dict[str, np.ndarray] = {"e": init(DIM, e), "eb": np.zeros(e, np.float32), "o": init(2 * h, 1), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": init(e, 4 * h), f"{d}h": init(h, 4 * h), f"{d}b": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def _run(self, d: str, z: np.ndarray, mask: np.ndarray, keep: bool):
        """States over time for inputs (time, page, 4h); at padding the state stays as it is."""
        t, b, h = z.shape[0], z.shape[1], self.h
        hs, cs, saved = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32), []
        out = np.zeros((t, b, h), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[k] + hs @ self.w[d + "h"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * h], -30, 30)))
            i, f, o, n = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
            c = f * cs + i * n
            tc = np.tanh(c)
            m = mask[k][:, None]
            if keep:
                saved.append((k, i, f, o, n, cs, tc, hs, m))
            hs, cs = np.where(m, o * tc, hs), np.where(m, c, cs)
            out[k] = hs
        return out, saved

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        e = np.tanh(x @ self.w["e"] + self.w["eb"])
        runs = {d: self._run(d, e @ self.w[d + "x"] + self.w[d + "b"], mask, keep) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        return (both @ self.w["o"])[:, :, 0] + self.w["ob"], (e, runs, both)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logit, (e, runs, both) = self.logits(x, mask, True)
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        n = mask.sum()
        loss = -float((np.log(np.where(y > 0, q, 1 - q) + 1e-9) * mask).sum() / n)
        dl = ((q - y) * mask / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"], g["ob"] = np.einsum("tbh,tb->h", both, dl)[:, None], dl.sum(keepdims=True)[0]
        dboth, de, h = dl[:, :, None] * self.w["o"][:, 0], np.zeros_like(e), self.h
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            dh, dc = np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
            for k, i, f, o, c_in, before, tc, h_in, m in reversed(runs[d][1]):
                dh = dh + part[k]
                live, dcc = dh * m, dc * m + dh * m * o * (1 - tc * tc)
                dz = np.concatenate([dcc * c_in * i * (1 - i), dcc * before * f * (1 - f), live * tc * o * (1 - o), dcc * i * (1 - c_in * c_in)], axis=1)
                g[d + "h"] += h_in.T @ dz
                g[d + "x"] += e[k].T @ dz
                g[d + "b"] += dz.sum(axis=0)
                de[k] += dz @ self.w[d + "x"].T
                dh, dc = dz @ self.w[d + "h"].T + dh * ~m, dcc * f + dc * ~m
        da = de * (1 - e * e) * mask[:, :, None]
        g["e"], g["eb"] = np.einsum("tbi,tbj->ij", x, da, optimize=True), da.sum(axis=(0, 1))
        return loss, g

    def keep(self, pages: list[np.ndarray], most: int = 40_000) -> list[np.ndarray]:
        """Which blocks of each page belong to the article."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if len(pages[k])]
        while order:
            take, longest = 0, 0
            while take < len(order) and take < 256 and (take + 1) * max(longest, len(pages[order[take]])) <= max(most, len(pages[order[0]])):
                longest = max(longest, len(pages[order[take]]))
                take += 1
            some, order = order[: max(1, take)], order[max(1, take) :]
            x, mask = padded([pages[k] for k in some])
            logit, _ = self.logits(x, mask)
            for j, k in enumerate(some):
                out[k] = logit[: len(pages[k]), j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x, mask = np.zeros((t, len(pages), DIM), np.float32), np.zeros((t, len(pages)), bool)
    for k, v in enumerate(pages):
        x[: len(v), k], mask[: len(v), k] = v, True
    return x, mask


#: Fixed values of the page generator: class words of each kind of block, and words that such blocks use.
KINDS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "menu": (["nav", "ul", "div", "nav"], ["menu", "nav", "navigation", "navbar", "breadcrumb", "topnav", "links"], ["Home", "About", "Contact", "News", "Archive"]),
    "header": (["header", "div"], ["header", "masthead", "topbar", "site-header", "branding"], ["Welcome", "Daily", "Blog"]),
    "footer": (["footer", "div", "footer"], ["footer", "site-footer", "copyright", "colophon", "legal"], ["©", "2024", "Privacy", "Terms", "rights", "reserved"]),
    "sidebar": (["aside", "div", "aside"], ["sidebar", "related", "widget", "popular", "recent", "trending"], ["Related", "Popular", "Recent", "Read", "more"]),
    "notice": (["div", "section", "p"], ["notice", "cookie", "cookies", "consent", "alert", "banner-notice", "gdpr", "paywall"], ["cookies", "Accept", "consent", "policy", "subscribe"]),
    "advert": (["div", "div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor"], ["Buy", "now", "Sale", "offer"]),
    "form": (["form"], ["search", "newsletter", "login", "signup", "subscribe", "form"], ["Email", "Search", "Submit", "Name"]),
    "comments": (["div", "section", "ol"], ["comments", "comment", "comment-list", "replies", "discussion", "responses"], ["Reply", "says", "ago"]),
    "share": (["div", "ul"], ["share", "social", "sharing", "tags", "byline-share"], ["Share", "Tweet"]),
}
#: Marks article blocks of generated pages; taken out before anything is learned.
MARK = "\u2063"
_SYLLABLES = "an ba ch de en er fo ga he il in ka la me mo na no on or pa qu ra re sa se ti to un ve wi zu ü é ción ß".split()


def make_page(rng: np.random.Generator) -> tuple[str, list[str]]:
    """A page, with MARK within each article block, and these blocks' texts."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5))))
    say = lambda lo, hi: " ".join(word() + ("," if rng.random() < 0.08 else "") for _ in range(int(rng.integers(lo, hi)))).capitalize()
    wanted: list[str] = []

    def attr(words: list[str]) -> str:
        kind = pick(["class", "class", "class", "id", "role"])
        more = f" {word()}" if rng.random() < 0.3 else ""
        return f' {kind}="{pick(words)}{more}"'

    def junk(kind: str) -> str:
        tags, classes, words = KINDS[kind]
        tag = pick(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        head = f"<{tag}{'' if plain else attr(classes)}>"
        long_ = rng.random() < 0.5
        items = []
        for _ in range(int(rng.integers(1, 7 if kind != "comments" else 5))):
            text = f"{pick(words) + ' ' if rng.random() < 0.4 else ''}{say(4, 40) + '.' if long_ and kind not in ('menu', 'share', 'form') else say(1, 6)}"
            items.append(text)
        if kind == "menu" or kind == "share" or (kind == "sidebar" and rng.random() < 0.6):
            inner = "".join(f'<li><a href="/{word()}">{x}</a></li>' for x in items)
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>" if rng.random() < 0.7 else "".join(f'<a href="/{word()}">{x}</a> ' for x in items)
        elif kind == "form":
            inner = "".join(f"<label>{x}</label><input name=q>" for x in items) + f"<button>{say(1, 3)}</button>"
        elif kind == "comments":
            inner = ("" if tag == "ol" else f"<h3>{say(1, 4)}</h3>") + "".join(f'<{"li" if tag == "ol" else "div"} class="{pick(["comment", "reply", "comment-body", "response"])}"><p>{x}</p></{"li" if tag == "ol" else "div"}>' for x in items)
        elif rng.random() < 0.5 or tag == "p":
            inner = items[0] if rng.random() < 0.7 else f'{items[0]} <a href="#">{say(1, 3)}</a>'
        else:
            inner = "".join(f"<p>{x}</p>" for x in items) if rng.random() < 0.6 else f"<h2>{items[0]}</h2>" + "".join(f'<p><a href="/{word()}">{x}</a></p>' for x in items[1:])
        return f"{head}{inner}</{tag}>"

    def block(tag: str, lo: int, hi: int) -> str:
        text = say(lo, hi) + pick([".", ".", ".", "", "!"])
        wanted.append(text)
        text = MARK + text
        style = rng.random()
        if style < 0.12 and tag == "p":
            return f"<p><b>{text}<br>"
        if style < 0.2:
            first, _, rest = text.partition(" ")
            return f'<{tag}><a href="/{word()}">{first}</a> {rest}</{tag}>'
        if style < 0.3 and tag == "p":
            return f"<p>{text}"
        return f"<{tag}>{text}</{tag}>"

    body = [block("h1", 2, 14)] if rng.random() < 0.85 else []
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.74:
            body.append(block("p", *((1, 4) if rng.random() < 0.2 else (8, 90))))
        elif kind < 0.82:
            body.append(block(pick(["h2", "h3"]), 1, 8))
        elif kind < 0.9:
            tag = pick(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(block("li", 2, 14) for _ in range(int(rng.integers(1, 5)))) + f"</{tag}>")
        elif kind < 0.95:
            body.append(block(pick(["blockquote", "pre", "figcaption", "div", "td"]), 3, 40))
        else:
            body.append(junk(pick(["advert", "share", "notice", "sidebar", "form"])))
    shape = rng.random()
    if shape < 0.6:
        head, tail = pick([("<article>", "</article>"), ("<article>", "</article>"), (f"<article{attr(['post', 'article', 'entry'])}>", "</article>"), ("<main><article>", "</article></main>")])
    else:
        tag = pick(["div", "main", "section", "div"])
        head, tail = f"<{tag}{attr(['content', 'main', 'post', 'entry', 'entry-content', 'article-body', 'story', 'article', 'post-content', 'text'])}>", f"</{tag}>"
    # Comments may stand at the article's end, inside or after it.
    inside = junk("comments") if rng.random() < 0.12 else ""
    before = [junk(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.45]
    after = [junk(k) for k in ("sidebar", "comments", "advert", "share", "form", "notice", "footer", "footer") if rng.random() < 0.4]
    rng.shuffle(before)
    start = f"<!DOCTYPE html><html lang=en><head><title>{say(2, 10)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>" if rng.random() < 0.9 else ""
    wrap = ("<div class=wrapper>", "</div>") if rng.random() < 0.3 else ("", "")
    end = "</body></html>" if rng.random() < 0.85 else ""
    return start + wrap[0] + "".join(before) + f"<!-- {word()} -->" + head + "".join(body) + inside + tail + "".join(after) + wrap[1] + end, wanted


def labelled(seed: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    while len(xs) < n:
        page, _ = make_page(rng)
        blocks = blocks_of(page)
        if blocks:
            xs.append(vectors([(path, t.replace(MARK, ""), linked) for path, t, linked in blocks]))
            ys.append(np.array([MARK in t for _, t, _ in blocks], np.float32))
    return xs, ys


@lru_cache(maxsize=2)
def trained(p: HtmlParams = HtmlParams()) -> Labeller:
    model, rng = Labeller(p), np.random.default_rng(p.seed)
    xs, ys = labelled(p.seed, p.pages)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, total = 0, p.epochs * -(-len(xs) // p.batch)
    for _ in range(p.epochs):
        order = np.argsort([len(x) + 6 * rng.random() for x in xs])
        groups = [order[k : k + p.batch] for k in range(0, len(order), p.batch)]
        for g in rng.permutation(len(groups)):
            x, mask = padded([xs[k] for k in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(groups[g]):
                y[: len(ys[k]), j] = ys[k]
            _, grad = model.gradients(x, mask, y)
            norm = sum(float((v * v).sum()) for v in grad.values()) ** 0.5
            step += 1
            rate = p.rate * (1 - step / (total + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, v in grad.items():
                v = v / max(1.0, norm)
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                model.w[k] = (model.w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
    return model


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    blocks = [blocks_of(p or "") for p in pages]
    kept = model.keep([vectors(b) for b in blocks])
    return ["\n\n".join(t for (_, t, _), k in zip(b, keep, strict=True) if k) for b, keep in zip(blocks, kept, strict=True)]


def _extract(batches: Iterator[pa.RecordBatch], model: Labeller, size: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            texts = main_texts(part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: HtmlParams = HtmlParams()) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    model = trained(params)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(lambda it: _extract(it, model), f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
