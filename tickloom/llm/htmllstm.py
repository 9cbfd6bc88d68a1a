"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks: the texts between block elements, in order, each with the open elements above it.
Every block becomes a vector of its tag path (tags, and words of class, id and role), of its hashed words, and of a few
measures (length, share of link text, final punctuation, place in the page). A bidirectional LSTM written in NumPy reads the whole
sequence both ways and gives each block the chance of being main text, so what stands around a block counts as much as the
block: a paragraph between comments is a comment, a short line between paragraphs is part of the article.

The model is trained when a query starts. Labels come with the training pages, which are laid out at random from a small grammar
of page parts (article bodies in many containers; menus, headers, footers, sidebars, notices, adverts, forms, related links
and reader comments, some inside the article) and filled with words of a bounded sample of the table's pages
(``SAMPLE`` pages, least hash of the identifier). Seeds are fixed, so the same table gives the same model.

Pages are parsed and labelled inside the tasks, in batches of bounded size; a page is never cut. Rows: a null or empty page,
or one without main text, gives an empty text; markup cut off at the end of a page is dropped; repeated rows are treated one by
one; an empty table gives an empty result. All other columns are ignored but the identifier and the url, which may be null.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.arrays import slices, word_hashes

SAMPLE = 200            # pages whose words fill the training pages
WORDS, LONGEST_WORD = 20_000, 64
TRAIN_PAGES = 1000
EPOCHS = 14
PATH_ROWS, PATH_DIM = 2048, 24
WORD_ROWS, WORD_DIM = 512, 8
HIDDEN = 24
MEASURES = 8
LEAST_CHANCE = 0.15     # the best on generated pages that were not trained on (99.1 % of blocks; 99.0 % at 0.5)

#: Fixed values of HTML: elements within a line, elements whose content is not text, elements that end their like.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label link mark meta q rp rt ruby "
             "s samp small source span strike strong sub sup time track tt u var wbr "
             # formulas: their symbols are text within the line
             "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mover munder munderover mfrac msqrt mroot mfenced "
             "mpadded mphantom mstyle merror menclose mtable mtr mlabeledtr mtd mmultiscripts mprescripts maction none".split())
SILENT = "script|style|template|noscript|title|textarea|svg|iframe|object|canvas|annotation|annotation-xml"
VOID = set("hr area base col embed param".split())
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg(?=[\s/>])[^>]*/>"  # an icon that is closed at once is empty
    rf"|<(?P<silent>{SILENT})(?=[\s/>])[^>]*>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def element_tokens(name: str, rest: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    words = [w.lower() for m in _ATTRIBUTE.finditer(rest) for w in _NAME.findall(m[2] or m[3] or m[4] or "")]
    return (name, *[f".{w}" for w in words])


class Open:
    """An open element and the ones around it; shared by all blocks inside, so nesting of any depth costs one each."""

    __slots__ = ("above", "name", "tokens")

    def __init__(self, above: Open | None, name: str, tokens: tuple[str, ...]):
        self.above, self.name, self.tokens = above, name, tokens

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        """The tokens of all elements, the outermost first."""
        found, at = [], self
        while at is not None:
            found.append(at.tokens)
            at = at.above
        return reversed(found)


def blocks(page: str) -> Iterator[tuple[Open | tuple, str, float]]:
    """(innermost open element, text, share of link text) of every leaf block; outside all elements an empty tuple."""
    stack: list[Open] = []
    is_open: Counter[str] = Counter()
    buffer: list[str] = []
    link = total = 0
    links = 0

    def flush():
        nonlocal link, total
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            share = link / total if total else 0.0
            buffer.clear()
            link = total = 0
            if text:
                return stack[-1] if stack else (), text, share
        return None

    for m in _TOKEN.finditer(page):
        name = m["name"] or m["name2"]
        if name is None:
            s = m[0]
            if s[0] != "<" or len(s) == 1:
                buffer.append(s)
                total += len(s)
                if links:
                    link += len(s)
            continue
        name = name.lower()
        closing = m["close"] or m["close2"]
        if name == "br":
            buffer.append(" ")
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
        else:
            found = flush()
            if found:
                yield found
            links = 0
            if closing:
                while is_open[name]:
                    last = stack.pop()
                    is_open[last.name] -= 1
                    if last.name == name:
                        break
            elif name not in VOID:
                ends = CLOSES.get(name, {"p"})
                while stack and stack[-1].name in ends:
                    is_open[stack.pop().name] -= 1
                rest = m["rest"] if m["name"] else m["rest2"]
                if not rest.rstrip().endswith("/"):
                    stack.append(Open(stack[-1] if stack else None, name, element_tokens(name, rest)))
                    is_open[name] += 1
    found = flush()
    if found:
        yield found


@lru_cache(1 << 16)
def _row_of(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) * PATH_ROWS >> 32


class Pages:
    """Vectors' raw material for a batch of pages: paths, hashed words and measures of all their blocks.

    Paths of all pages form one tree: a node is an element below another node, 0 the root. A path stands for the tokens
    of all its elements, the innermost one with tokens of its own ("end").
    """

    def __init__(self, pages: list[list[tuple[Open | tuple, str, float]]]):
        self.sizes = np.array([len(p) for p in pages], np.int64)
        leaves = [leaf for p in pages for leaf in p]
        known: dict[tuple[int, tuple[str, ...]], int] = {}
        seen: dict[Open, int] = {}

        def node(path: Open | tuple) -> int:
            new, at = [], 0
            if isinstance(path, tuple):
                for tokens in path:
                    at = known.setdefault((at, tokens), len(known) + 1)
                return at
            while path is not None and path not in seen:
                new.append(path)
                path = path.above
            at = seen[path] if path is not None else 0
            for element in reversed(new):
                at = seen[element] = known.setdefault((at, element.tokens), len(known) + 1)
            return at

        self.path = np.array([node(p) for p, _, _ in leaves], np.int64)
        self.n_nodes = len(known) + 1
        self.above = np.array([0, *[a for a, _ in known]], np.int64)
        tokens = [(), *[t for _, t in known]]
        depth = [0] * self.n_nodes
        for k in range(1, self.n_nodes):  # a node comes after the one above it
            depth[k] = depth[self.above[k]] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(np.array(depth)[order])) + 1)[1:]
        self.token = np.array([_row_of(t) for of in tokens for t in of], np.int64)
        self.token_owner = np.repeat(np.arange(self.n_nodes), [len(of) for of in tokens])
        ends = np.unique(self.path)
        self.end_token = np.array([_row_of("leaf:" + t) for k in ends for t in tokens[k]], np.int64)
        self.end_owner = np.repeat(ends, [len(tokens[k]) for k in ends])
        texts = [t for _, t, _ in leaves]
        h, self.word_owner = word_hashes(texts, punctuation=True)
        self.word = (h % np.uint64(WORD_ROWS)).astype(np.int64)
        self.n_words = np.bincount(self.word_owner, minlength=len(texts))
        place = np.concatenate([np.arange(n) / max(n - 1, 1) for n in self.sizes] or [np.empty(0)])
        self.measures = np.zeros((len(texts), MEASURES), np.float32)
        for i, (_, t, share) in enumerate(leaves):
            self.measures[i, 1:6] = (share, t[-1] in ".!?", t[0].isupper(), "©" in t, t.count(",") / (len(t) / 50 + 1))
        self.measures[:, 0] = np.log1p(self.n_words) / 4
        self.measures[:, 6], self.measures[:, 7] = place, self.n_words <= 3


def _sums(index: np.ndarray, values: np.ndarray, n: int, kind: type = np.float32) -> np.ndarray:
    """The rows of ``values`` added up by ``index``."""
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(kind)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Embeddings, two LSTM directions and a logistic output, with training by Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + MEASURES

        def start(*shape):
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"path": (0.3 * r.standard_normal((PATH_ROWS, PATH_DIM))).astype(np.float32),
                  "word": (0.3 * r.standard_normal((WORD_ROWS, WORD_DIM))).astype(np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": start(size, 4 * HIDDEN), f"h{d}": start(HIDDEN, 4 * HIDDEN),
                       f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN:2 * HIDDEN] = 1
        self.p |= {"out": start(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}

    def vectors(self, pages: Pages) -> np.ndarray:
        paths = _sums(pages.token_owner, self.p["path"][pages.token], pages.n_nodes, float)
        for level in pages.levels:
            paths[level] += paths[pages.above[level]]
        paths = (paths + _sums(pages.end_owner, self.p["path"][pages.end_token], pages.n_nodes, float)).astype(np.float32)
        words = np.zeros((len(pages.n_words), WORD_DIM), np.float32)
        has = np.flatnonzero(pages.n_words)
        if len(has):
            begin = (np.cumsum(pages.n_words) - pages.n_words)[has]
            words[has] = np.add.reduceat(self.p["word"][pages.word], begin) / pages.n_words[has, None]
        return np.concatenate((paths[pages.path], words, pages.measures), axis=1)

    def _run(self, x: np.ndarray, d: str, training: bool = True) -> tuple[np.ndarray, list]:
        """States of one direction over (time, batch, input); the cache serves training."""
        t, b, _ = x.shape
        gates = (x.reshape(t * b, -1) @ self.p[f"x{d}"] + self.p[f"b{d}"]).reshape(t, b, -1)
        h, c = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        states, cache = np.empty((t, b, HIDDEN), np.float32), []
        for k in range(t):
            g = gates[k] + h @ self.p[f"h{d}"]
            s = _sigmoid(g[:, :3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            u = np.tanh(g[:, 3 * HIDDEN:])
            before, c = c, f * c + i * u
            tc = np.tanh(c)
            if training:
                cache.append((h, before, i, f, o, u, tc))
            h = o * tc
            states[k] = h
        return states, cache

    def _back(self, x: np.ndarray, cache: list, grad: np.ndarray, d: str, into: dict) -> np.ndarray:
        t, b, size = x.shape
        dg = np.empty((t, b, 4 * HIDDEN), np.float32)
        dh, dc = np.zeros((b, HIDDEN), np.float32), np.zeros((b, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            h, before, i, f, o, u, tc = cache[k]
            dh = dh + grad[k]
            dc = dc + dh * o * (1 - tc * tc)
            dg[k] = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o),
                                    dc * i * (1 - u * u)), axis=1)
            dh, dc = dg[k] @ self.p[f"h{d}"].T, dc * f
            into[f"h{d}"] += h.T @ dg[k]
        flat = dg.reshape(t * b, -1)
        into[f"x{d}"] += x.reshape(t * b, size).T @ flat
        into[f"b{d}"] += flat.sum(0)
        return (flat @ self.p[f"x{d}"].T).reshape(t, b, size)

    @staticmethod
    def _grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block numbers of pages as (time, page) in both directions, padded with 0 at the end, and what is not padding."""
        t, begin = int(sizes.max()), np.cumsum(sizes) - sizes
        k = np.arange(t)[:, None]
        live = k < sizes
        return np.where(live, begin + k, 0), np.where(live, begin + sizes - 1 - k, 0), live

    def scores(self, pages: Pages) -> np.ndarray:
        """The chance of being main text of every block, pages of like length together."""
        out, x = np.zeros(len(pages.n_words), np.float32), self.vectors(pages)
        order = np.argsort(pages.sizes, kind="stable")
        order = order[pages.sizes[order] > 0]
        begin = np.cumsum(pages.sizes) - pages.sizes
        while len(order):
            n = 1
            while n < len(order) and n < 512 and pages.sizes[order[n]] * (n + 1) <= 1.15 * pages.sizes[order[:n + 1]].sum() + 64:
                n += 1
            mine, order = order[:n], order[n:]
            sizes = pages.sizes[mine]
            own = np.concatenate([np.arange(begin[i], begin[i] + pages.sizes[i]) for i in mine])
            ahead, behind, live = self._grid(sizes)
            f, _ = self._run(x[own[ahead]], "f", False)
            b, _ = self._run(x[own[behind]], "b", False)
            score = np.zeros(len(own), np.float32)
            score[ahead[live]] += (f @ self.p["out"][:HIDDEN])[live]
            score[behind[live]] += (b @ self.p["out"][HIDDEN:])[live]
            out[own] = _sigmoid(score + self.p["bias"][0])
        return out

    def gradients(self, pages: Pages, labels: np.ndarray) -> dict:
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        x = self.vectors(pages)
        ahead, behind, live = self._grid(pages.sizes)
        xf, xb = x[ahead] * live[..., None], x[behind] * live[..., None]
        f, cf = self._run(xf, "f")
        b, cb = self._run(xb, "b")
        score = np.zeros(len(x), np.float32)
        score[ahead[live]] += (f @ self.p["out"][:HIDDEN])[live]
        score[behind[live]] += (b @ self.p["out"][HIDDEN:])[live]
        err = (_sigmoid(score + self.p["bias"][0]) - labels) / len(labels)
        ef, eb = np.where(live, err[ahead], 0), np.where(live, err[behind], 0)
        into["out"][:HIDDEN] = np.tensordot(ef, f, ((0, 1), (0, 1)))
        into["out"][HIDDEN:] = np.tensordot(eb, b, ((0, 1), (0, 1)))
        into["bias"][0] = err.sum()
        gf = self._back(xf, cf, ef[..., None] * self.p["out"][:HIDDEN], "f", into)
        gb = self._back(xb, cb, eb[..., None] * self.p["out"][HIDDEN:], "b", into)
        gx = np.zeros_like(x)
        gx[ahead[live]] += gf[live]
        gx[behind[live]] += gb[live]
        by_node = _sums(pages.path, gx[:, :PATH_DIM], pages.n_nodes)
        into["path"] = _sums(pages.end_token, by_node[pages.end_owner], PATH_ROWS)
        for level in reversed(pages.levels):
            np.add.at(by_node, pages.above[level], by_node[level])
        into["path"] += _sums(pages.token, by_node[pages.token_owner], PATH_ROWS)
        per_word = gx[:, PATH_DIM:PATH_DIM + WORD_DIM] / np.maximum(pages.n_words, 1)[:, None]
        into["word"] = _sums(pages.word, per_word[pages.word_owner], WORD_ROWS)
        return into

    def fit(self, pages: list, labels: list[np.ndarray], seed: int = 11, rate: float = 0.02, batch: int = 100) -> Labeller:
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = r.permutation(len(pages))
        batches = [(Pages([pages[i] for i in b]), np.concatenate([labels[i] for i in b]))
                   for b in (order[a:a + batch] for a in range(0, len(order), batch))]
        for epoch in range(EPOCHS):
            for a in r.permutation(len(batches)):
                g = self.gradients(*batches[a])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    now = rate * (1 - epoch / EPOCHS)
                    self.p[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
        return self


#: Names that pages give to their parts.
BODY_NAMES = ["content", "post", "entry", "entry-content", "post-body", "article", "articleBody", "article-text", "story",
              "story-body", "text", "main", "main-content", "body", "page-content", "blog-post", "news", "read", "copy"]
PARTS = {
    "menu": ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "links", "tabs", "breadcrumb", "breadcrumbs", "toc"],
    "head": ["header", "masthead", "top", "topbar", "site-header", "branding", "logo", "banner", "hero"],
    "foot": ["footer", "foot", "bottom", "site-footer", "copyright", "legal", "colophon", "imprint"],
    "side": ["sidebar", "side", "aside", "widget", "rail", "right-column", "secondary", "related", "recommended", "more",
             "popular", "trending", "tags", "archive", "author-box", "see-also"],
    "notice": ["notice", "cookie", "cookies", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "message",
               "warning", "paywall", "disclaimer", "overlay", "privacy"],
    "advert": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "promotion", "adsense", "commercial", "sponsor",
               "shop", "offer"],
    "form": ["form", "search", "searchbox", "login", "signup", "newsletter", "subscribe", "contact", "share", "social", "vote",
             "feedback", "rating"],
    "comments": ["comments", "comment", "comment-list", "reply", "respond", "discussion", "reader-comments", "responses",
                 "guestbook", "disqus", "thread", "user-comments"],
}
PART_TAGS = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}
PART_WORDS = {
    "menu": ["home", "about", "contact", "news", "archive", "sitemap", "login", "products", "help"],
    "head": ["welcome", "daily", "magazine", "home", "subscribe"],
    "foot": ["©", "copyright", "all", "rights", "reserved", "privacy", "policy", "terms", "imprint", "contact"],
    "side": ["related", "popular", "more", "read", "latest", "tags", "archive", "recent", "posts"],
    "notice": ["we", "use", "cookies", "accept", "privacy", "policy", "agree", "notice", "please", "continue"],
    "advert": ["buy", "now", "sale", "sponsored", "advertisement", "free", "offer", "best", "price", "shop"],
    "form": ["search", "email", "subscribe", "submit", "name", "password", "send", "newsletter", "share"],
    "comments": ["reply", "comment", "comments", "says", "posted", "thanks", "great", "agree", "report"],
}


class Layouts:
    """Random pages with a label for every block."""

    def __init__(self, words: list[str], seed: int = 3):
        self.r, self.words = np.random.default_rng(seed), words or ["word"]

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def element(self, tag: str, names: list[str] | None = None) -> tuple[str, ...]:
        """An element, mostly with one of the names; now and then with names of no meaning."""
        rest = ""
        if names and self.r.random() < 0.9:
            rest += f' {self.pick(["class", "class", "id"])}="{self.pick(names)}"'
        if self.r.random() < 0.15:
            rest += f' class="{self.pick("box col wrap row inner block item section container grid x1 c2 clearfix".split())}"'
        return element_tokens(tag, rest)

    def text(self, n: int, own: list[str] | None = None, share: float = 0.4) -> str:
        if own is None and self.r.random() < 0.08:  # an article may use any of these words
            own, share = PART_WORDS[self.pick(list(PART_WORDS))], 0.5
        words = [self.pick(own) if own and self.r.random() < share else self.pick(self.words) for _ in range(max(1, n))]
        words[0] = words[0].capitalize() if self.r.random() < 0.8 else words[0]
        return " ".join(words) + self.pick([".", ".", "", "!", "?"])

    def length(self, short: float) -> int:
        return int(self.r.integers(1, 6)) if self.r.random() < short else int(self.r.integers(5, 60))

    def part(self, kind: str, above: tuple) -> list:
        """One piece of boilerplate, in its own element or one named after it."""
        own = PART_WORDS[kind]
        tagged = kind in PART_TAGS and self.r.random() < 0.6
        top = self.element(PART_TAGS[kind] if tagged else self.pick(["div", "div", "section", "ul"]),
                           PARTS[kind] if not tagged or self.r.random() < 0.4 else None)
        path = (*above, top)
        out = []
        if kind in ("menu", "side", "head", "foot") and self.r.random() < 0.7 or kind == "menu":
            inner = (*path, ("ul",)) if self.r.random() < 0.7 else path
            leaf = ("li",) if inner != path else self.pick([("li",), ("div",), ("p",), ("td",)])
            for _ in range(int(self.r.integers(2, 9))):
                out.append(((*inner, leaf), self.text(int(self.r.integers(1, 4)), own, 0.3), 1.0 if self.r.random() < 0.9 else 0.0))
        if kind == "comments":
            if self.r.random() < 0.7:
                out.append(((*path, self.pick([("h2",), ("h3",), ("div",)])), self.text(2, own, 0.7), 0.0))
            for _ in range(int(self.r.integers(1, 6))):
                inner = (*path, self.element(self.pick(["div", "li", "article"]), PARTS["comments"])) if self.r.random() < 0.8 else path
                if self.r.random() < 0.5:
                    out.append(((*inner, self.pick([("div",), ("p",), ("h4",), self.element("div", ["author", "meta", "user"])])),
                                self.text(2, own, 0.3), float(self.r.random() < 0.4)))
                for _ in range(int(self.r.integers(1, 3))):
                    out.append(((*inner, ("p",)) if self.r.random() < 0.7 else inner, self.text(self.length(0.2), own, 0.1), 0.0))
        elif kind != "menu" and (not out or self.r.random() < 0.5):
            for _ in range(int(self.r.integers(1, 4))):
                leaf = path if self.r.random() < 0.5 else (*path, self.pick([("p",), ("div",), ("h3",), ("li",), ("button",), ("td",)]))
                out.append((leaf, self.text(self.length(0.5), own, 0.25), float(self.r.random() < 0.25)))
        return [(*leaf, 0) for leaf in out]

    def body(self, above: tuple) -> list:
        """The article, with pieces of boilerplate inside now and then."""
        tag = self.pick(["article"] * 5 + ["div", "div", "div", "main", "section", "td"])
        path = (*above, self.element(tag, BODY_NAMES if tag in ("div", "section", "td") or self.r.random() < 0.3 else None))
        if self.r.random() < 0.2:
            path = (*path, self.element("div", BODY_NAMES))
        out = []
        if self.r.random() < 0.8:
            head = (*path, ("header",)) if self.r.random() < 0.15 else path
            out.append(((*head, self.pick([("h1",), ("h1",), ("h2",)])), self.text(int(self.r.integers(1, 14))), 0.0, 1))
        for _ in range(int(self.r.integers(1, 16))):
            if self.r.random() < 0.05:
                out += self.part(self.pick(["advert", "form", "side", "notice"]), path)
            if self.r.random() < 0.07:  # many short paragraphs, some all the same
                same = self.text(int(self.r.integers(1, 6))) if self.r.random() < 0.6 else None
                out += [((*path, ("p",)), same or self.text(int(self.r.integers(1, 6))), 0.0, 1)
                        for _ in range(int(self.r.integers(2, 25)))]
                continue
            if self.r.random() < 0.12:
                inner = (*path, self.pick([("ul",), ("ol",), ("dl",)]))
                for _ in range(int(self.r.integers(2, 6))):
                    out.append(((*inner, ("li",)), self.text(self.length(0.4)), float(self.r.random() < 0.15), 1))
                continue
            leaf = self.pick([("p",)] * 12 + [("h2",), ("h3",), ("blockquote",), ("pre",), ("div",), ("figcaption",), ("td",), None])
            out.append(((*path, leaf) if leaf else path, self.text(self.length(0.35)), 0.2 * float(self.r.random() < 0.2), 1))
        return out

    def page(self) -> list:
        above: tuple = (("html",), ("body",))
        if self.r.random() < 0.3:
            above = (*above, self.element("div", ["page", "wrapper", "container", "site", "outer", "app"]))
        out = []
        for kind in self.r.permutation(["head", "menu", "notice", "advert", "form", "side"]):
            if self.r.random() < 0.4:
                out += self.part(str(kind), above)
        inside = (*above, self.element("main")) if self.r.random() < 0.2 else above
        article = self.body(inside)
        out += article
        if self.r.random() < 0.35:  # comments inside or after the article
            at = article[0][0][:len(inside) + 1] if self.r.random() < 0.4 else inside
            out += self.part("comments", at)
        for kind in self.r.permutation(["side", "advert", "form", "menu", "notice"]):
            if self.r.random() < 0.25:
                out += self.part(str(kind), above)
        if self.r.random() < 0.7:
            out += self.part("foot", above)
        return out


def trained(words: list[str], n: int = TRAIN_PAGES) -> Labeller:
    layouts = Layouts(words)
    pages = [layouts.page() for _ in range(n)]
    return Labeller().fit([[x[:3] for x in p] for p in pages],
                          [np.array([x[3] for x in p], np.float32) for p in pages])


def sample_words(pages: DataFrame, id_col: str, html_col: str, n: int = SAMPLE) -> list[str]:
    """At most ``WORDS`` words of the blocks of ``n`` pages, those with the least hash of their identifier.

    Only about four times as many rows are ordered. The pages stay in the tasks; the driver gets words of bounded length.
    """
    known = pages.where(F.col(html_col).isNotNull())
    mark = F.xxhash64(id_col).bitwiseAND(F.lit(2 ** 31 - 1))
    bound = min(2 ** 31, 4 * n * 2 ** 31 // max(known.count(), 1) + 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0):
                found = {w for _, t, _ in blocks(h.as_py()) for w in t.split() if len(w) <= LONGEST_WORD}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    rows = known.where(mark < bound).orderBy(mark, id_col, html_col).limit(n).select(html_col).mapInArrow(words, "word string")
    return sorted(r.word for r in rows.distinct().orderBy(F.xxhash64("word"), "word").limit(WORDS).collect())


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              model: Labeller | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    model = model or trained(sample_words(rows, "page_id", "html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str] = []
            for part in slices(b.column(2).to_pylist(), lambda h: len(h or ""), 1 << 20):
                leaves = [list(blocks(h)) if h else [] for h in part]
                keep = shared.value.scores(Pages(leaves)) > LEAST_CHANCE
                at = 0
                for p in leaves:
                    texts.append("\n".join(t for (_, t, _), k in zip(p, keep[at:at + len(p)]) if k))
                    at += len(p)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
