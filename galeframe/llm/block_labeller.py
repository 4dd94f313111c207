"""HTML extraction: a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each with the path of tags and class
words that it stands in. A bidirectional LSTM in numpy reads the blocks of the whole page (hashed path, opening
words, the mean over all distinct words, lengths, link share) and says of every block whether it belongs to the main text.

There are no labelled pages, so it learns from pages that mark their article (article, main, role=main,
itemprop=articleBody) outside of elements that name themselves as something else. So that it also knows
pages that mark nothing, training pages are put together anew: the page's own main and other blocks, and
strange text as comments, teasers, notices, forms and adverts, in containers of many usual names. Three pages in ten,
as they are or put together, lose all names, so that link share, length, place and words must tell their parts. At most
SAMPLE_PAGES pages of at most SAMPLE_CHARS characters (least hash of the id) reach the driver; they are learnt whole.
Without any such page the containers' names alone decide.

Text: scripts, styles, comments and other unseen content are left out, character references decoded, white
space inside a block becomes one space, empty blocks vanish, main blocks are joined by two line feeds. A tag that
never ends is text. A tag whose quotes would take in the rest of the page ends at its first >, and so do all tags
behind it. What is nested deeper than DEPTH elements is text of the deepest of these. Null
and empty html give an empty text; a null id or url stays null; repeated rows are worked on row by row; html
of any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.text import ALNUM, slices, words

SAMPLE_PAGES = 300
SAMPLE_CHARS = 60_000
PATH_HASHES = 1 << 12
WORD_HASHES = 1 << 10
HASHES = PATH_HASHES + WORD_HASHES
BAG_HASHES = 1 << 12
DENSE = 8
WIDTH = 16      # of a block's vector
HIDDEN = 16     # of each direction
STEPS = 600
BATCH = 24
BARE = 0.3      # of the pages are learnt without names

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is text up to the end tag
RAW = frozenset("script style title textarea".split())
#: elements with content of their own that is not shown; without an end tag anywhere behind they hide nothing
UNSEEN = frozenset("noscript template iframe object svg math select audio video canvas".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: elements that a new one of the group closes
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table body html div section article main aside nav header footer form td th".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
    r"|(?P<text>[^<]+|<(?!/?[a-zA-Z]))", re.DOTALL)
#: a tag whose quotes mean nothing; text and cdata are never there
PLAIN_TAG = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>(?P<text>(?!))?(?P<cdata>(?!))?")
TAG_BEGIN = re.compile("</?[a-zA-Z]")
DEPTH = 500     # open elements at most; deeper ones count as text of the last
ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[a-z]+")

#: what elements call themselves that are not the main text
OTHER_TAGS = frozenset("nav header footer aside form button label fieldset menu dialog figcaption".split())
OTHER_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement alert author banner bar breadcrumb breadcrumbs byline comment commentlist "
    "comments consent cookie cookies copyright disqus feedback footer gdpr header hidden hint login masthead menu meta modal "
    "nav navbar navigation newsletter notice overlay pagination pager popup promo promoted recommended register related replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar tooltip widget".split())
NAMING_TAGS = frozenset("article main section nav header footer aside dialog".split())
#: parts that link share, length, place and words tell; an advert in a plain container may read like the article
TOLD_WITHOUT_NAMES = frozenset("menu header footer sidebar form".split())
MAIN_NAMES = frozenset("articlebody main".split())

MAIN_PLACES = ("article", "main", "div.content", "div.post-content", "div.entry-content", "div.article-body", "section.story",
               "div.main", "td.content", "div.text", "div", "div.post", "section", "div.body-text", "article.post", "div.page-content")
WRAPPERS = ("", "", "div.wrapper", "div.page", "div.container", "div.row/div.col", "div.site/div.inner", "table/tr/td", "main")
OTHER_PLACES = {
    "menu": ("nav/ul/li", "div.menu/ul/li", "ul.nav/li", "div.navbar/div", "nav", "div.breadcrumb", "header/nav/ul/li", "div.toolbar"),
    "header": ("header", "div.header", "div.site-header/p", "div.masthead", "header/h2", "div.banner/h2", "header/p"),
    "footer": ("footer", "div.footer", "div.site-footer/p", "footer/p", "div.copyright", "footer/ul/li", "footer/div"),
    "sidebar": ("aside", "div.sidebar/p", "aside/ul/li", "div.related/ul/li", "div.widget/p", "aside/div.teaser", "div.recommended/p", "aside/p"),
    "notice": ("div.cookie-notice", "div.notice", "div.alert/p", "div.consent", "div.gdpr/p", "div.popup", "div.overlay/div",
               "div.notice/p", "div.cookie-banner/p", "dialog"),
    "advert": ("div.ad", "div.ads", "div.advert/p", "ins.adsbygoogle", "div.sponsored/p", "div.promo", "aside.ad", "div.ad-slot/div",
               "section.promoted/p"),
    "form": ("form", "form/label", "div.newsletter/form/p", "form.search", "div.login/form", "form/button", "div.subscribe/p",
             "form/p", "div.signup/form/label", "form/fieldset/label"),
    "comments": ("section.comments/p", "div.comments/div.comment/p", "ol.commentlist/li/p", "div.comment", "section.comments/article/p",
                 "div.disqus/p", "ul.comments/li", "div.replies/p", "section.comments/h2", "div.comments/div", "article.comment/p"),
}
MAIN_LEAVES = ("p", "p", "p", "p", "h1", "h2", "ul/li", "blockquote/p", "div", "", "pre", "table/tr/td")


@dataclass
class Block:
    path: tuple[str, ...]  # of tag and names, the outermost first
    text: str
    linked: int            # characters inside links



def _attributes(raw: str) -> tuple[str, bool]:
    """Class, id and role words, and whether the element is unseen."""
    names, unseen = [], False
    for key, *value in ATTRIBUTE.findall(raw):
        key = key.lower()
        if key in ("class", "id", "role", "itemprop"):
            names += NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", max(value, key=len)).lower()
                                   if key != "itemprop" else max(value, key=len).lower())
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", max(value, key=len)):
            unseen = True
    return ".".join(names), unseen


_known_attributes = lru_cache(20_000)(_attributes)


def read(page: str | None) -> list[Block]:
    """The leaf blocks of a page with text, in page order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, place, unseen
    parts: list[str] = []
    linked, links, hide = 0, 0, 0
    ends: dict[str, int] = {}
    count: Counter[str] = Counter()     # open elements by tag
    deeper: Counter[str] = Counter()    # elements beyond DEPTH by tag
    inside, quotes = 0, True            # open elements of UNSEEN; whether quotes in tags count

    def ended(tag: str, at: int) -> bool:
        """Whether an end tag stands anywhere behind a place."""
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s/>]", page, re.IGNORECASE)), default=-1)
        return ends[tag] >= at

    def end_head() -> None:
        while count["head"]:
            pop()

    def end_block() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(tuple(s[1] for s in stack if s[1]), text, min(linked, len(text))))
        parts, linked = [], 0

    def pop() -> None:
        nonlocal links, hide, inside
        tag, place, unseen = stack[-1]
        if place:
            end_block()
        stack.pop()
        deeper.clear()
        count[tag] -= 1
        inside -= tag in UNSEEN
        links -= tag == "a"
        hide -= unseen

    at, page = 0, page or ""
    last = page.rfind(">")
    while at < len(page):
        m = None if not quotes and TAG_BEGIN.match(page, at) else TOKEN.match(page, at)
        if m is None:  # quotes that take in the rest of the page: from here on they mean nothing
            quotes, m = False, PLAIN_TAG.match(page, at) if at < last else None
        at = m.end() if m else at + 1
        text = m["text"] or m["cdata"] if m else "<"  # a tag that never ends
        if text:
            if stack and stack[-1][0] == "head" and text.strip():
                end_head()
            if not hide:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text) * (links > 0)
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        void = m["attrs"].endswith("/")
        inner = inside > 0  # what stands there ends nothing outside
        if m["close"]:
            if deeper[tag]:
                deeper[tag] -= 1
                if tag not in INLINE:
                    end_block()
                continue
            if tag == "p" and not inner and not count["p"]:
                end_block()
            if not count[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("td", "th", "table") and tag in INLINE or stack[k][0] in UNSEEN and (tag in INLINE or tag == "p"):
                    break
            continue
        # an end tag of the head may be left out
        if tag == "body" or stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            end_head()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE and not inner:
                end_block()
            continue
        if tag in RAW:
            if not void and (ended(tag, at) or tag in ("script", "style")):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                last = page.find(">", end.end()) if end else -1
                at = last + 1 if last >= 0 else len(page)
            continue
        if tag in UNSEEN:
            if not void and ended(tag, at):
                stack.append((tag, "", True))
                count[tag] += 1
                inside += 1
                hide += 1
            continue
        if tag == "head" and count["body"]:
            continue
        if tag not in INLINE and not inner:
            end_block()
            for k in range(len(stack) - 1 if count["p"] else -1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPES:
                    break
            closed = CLOSES.get(tag, ())
            for k in range(len(stack) - 1 if any(count[t] for t in closed) else -1, -1, -1):
                if stack[k][0] in closed:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in SCOPES:
                    break
        if void and tag not in INLINE:
            continue
        if len(stack) >= DEPTH:
            deeper[tag] += 1
            continue
        names, unseen = ("", False) if not m["attrs"].strip() else (
            _known_attributes if len(m["attrs"]) < 1000 else _attributes)(m["attrs"])
        unseen = unseen or tag == "head"
        count[tag] += 1
        stack.append((tag, "" if tag in INLINE or inner else f"{tag}.{names}" if names else tag, unseen))
        links += tag == "a"
        hide += unseen
    end_block()
    return blocks


def named_main(path: tuple[str, ...]) -> bool | None:
    """What the names of the containers say: main, other, or nothing."""
    main = False
    for place in path:
        tag, *names = place.split(".")
        if tag in OTHER_TAGS or OTHER_NAMES.intersection(names):
            return False
        main = main or tag in ("article", "main") or bool(MAIN_NAMES.intersection(names))
    return True if main else None


def _number(text: str) -> int:
    """Words of texts have numbers of their own, so that they don't disturb the paths."""
    h = crc32(text.encode("utf-8", "surrogatepass"))
    return PATH_HASHES + h % WORD_HASHES if text.startswith("w:") else h % PATH_HASHES


_number = lru_cache(100_000)(_number)


def bag(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed words of each text, one text after another, and their number."""
    w = words(pa.array(texts, pa.large_string()), ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    keys = np.unique(owner * BAG_HASHES + (w.hashes % np.uint64(BAG_HASHES)).astype(np.int64))
    return keys % BAG_HASHES, np.bincount(keys // BAG_HASHES, minlength=len(texts))


def encode(blocks: list[Block]) -> tuple[list[list[int]], np.ndarray]:
    """Hashed path and word features of each block, and its DENSE numbers."""
    hashed, dense = [], np.zeros((len(blocks), DENSE))
    for k, b in enumerate(blocks):
        own = set()
        for depth, place in enumerate(reversed(b.path[-8:])):
            tag, *names = place.split(".")
            own.add(_number(f"t:{tag}"))
            own.update(_number(f"c:{n}") for n in names)
            if depth < 2:
                own.add(_number(f"{depth}:{tag}"))
        for place in b.path[:-8]:
            own.update(_number(f"c:{n}") for n in place.split(".")[1:])
        own.update(_number(f"w:{w}") for w in b.text.lower().split(" ", 4)[:4])
        hashed.append(sorted(own))
        n = len(b.text)
        dense[k] = (np.log1p(n) / 8, b.linked / n, b.text[-1] in ".!?:;\"”»", b.text.count(" ") / n, n < 40,
                    len(b.path) / 16, k / len(blocks), 1)
    return hashed, dense


class Labeller:
    """Embedding sums into a bidirectional LSTM into one logistic output a block."""

    def __init__(self, seed: int = 10):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(WIDTH + HIDDEN)
        self.p = {
            "hash": rng.normal(0, 0.1, (HASHES, WIDTH)), "bag": rng.normal(0, 0.1, (BAG_HASHES, WIDTH)), "dense": rng.normal(0, 0.3, (DENSE, WIDTH)),
            "out": rng.normal(0, 0.3, (2 * HIDDEN + WIDTH, 1)), "bias": np.zeros(1)}
        for d in ("f", "b"):
            self.p[f"w{d}"] = rng.normal(0, scale, (WIDTH + HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])

    def embed(self, hashed: list[list[int]], dense: np.ndarray, bags: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        counts = np.fromiter(map(len, hashed), np.int64, len(hashed))
        flat = np.fromiter((x for own in hashed for x in own), np.int64, int(counts.sum()))
        x = dense @ self.p["dense"]
        first = np.cumsum(counts) - counts
        some = counts > 0
        if some.any():
            x[some] += np.add.reduceat(self.p["hash"][flat], first[some])
        index, many = bags
        some = many > 0
        if some.any():
            x[some] += np.add.reduceat(self.p["bag"][index], (np.cumsum(many) - many)[some]) / many[some, None]
        return np.tanh(x)

    def chain(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """One direction over T x B x WIDTH; a masked step carries the state on."""
        steps, many, _ = x.shape
        h, c = np.zeros((many, HIDDEN)), np.zeros((many, HIDDEN))
        out = np.zeros((steps, many, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], axis=1)
            gates = z @ self.p[f"w{d}"] + self.p[f"c{d}"]
            sig = 1 / (1 + np.exp(-np.clip(gates[:, :3 * HIDDEN], -30, 30)))
            f, i, o = sig[:, :HIDDEN], sig[:, HIDDEN:2 * HIDDEN], sig[:, 2 * HIDDEN:]
            g = np.tanh(gates[:, 3 * HIDDEN:])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((t, z, f, i, o, g, c, squashed, m))
            c = np.where(m, new, c)
            h = np.where(m, o * squashed, h)
            out[t] = h
        return out

    def back(self, d: str, keep: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        dx = np.zeros((*dout.shape[:2], WIDTH))
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        for t, z, f, i, o, g, c, squashed, m in reversed(keep):
            dh = dh + dout[t]
            here = np.where(m, dh, 0.0)
            dnew = np.where(m, dc, 0.0) + here * o * (1 - squashed ** 2)
            gates = np.concatenate([dnew * c * f * (1 - f), dnew * g * i * (1 - i), here * squashed * o * (1 - o),
                                    dnew * i * (1 - g ** 2)], axis=1)
            grads[f"w{d}"] += z.T @ gates
            grads[f"c{d}"] += gates.sum(0)
            dz = gates @ self.p[f"w{d}"].T
            dx[t] = dz[:, :WIDTH]
            dh = np.where(m, dz[:, WIDTH:], dh)
            dc = np.where(m, dnew * f, dc)
        return dx

    @staticmethod
    def lay(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of sequences, one after another, as T x B x width with a mask."""
        mask = np.arange(int(lengths.max()))[:, None] < lengths
        out = np.zeros((*mask.shape, x.shape[1]))
        out.transpose(1, 0, 2)[mask.T] = x
        return out, mask

    def probability(self, hashed: list[list[int]], dense: np.ndarray, bags: tuple[np.ndarray, np.ndarray],
                    lengths: np.ndarray) -> np.ndarray:
        """Of every block of some pages to be main text; pages of like length are worked on together."""
        if not len(hashed):
            return np.zeros(0)
        x = self.embed(hashed, dense, bags)
        first, out = np.cumsum(lengths) - lengths, np.zeros(len(x))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        for pages in np.array_split(order, max(1, len(order) // 64)):
            n = lengths[pages]
            at = np.repeat(first[pages] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            laid, mask = self.lay(x[at], n)
            h = np.concatenate([self.chain("f", laid, mask), self.chain("b", laid, mask), laid], axis=2)
            z = (h @ self.p["out"])[..., 0] + self.p["bias"]
            out[at] = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).T[mask.T]
        return out

    def step(self, hashed: list[list[int]], dense: np.ndarray, bags: tuple[np.ndarray, np.ndarray], lengths: np.ndarray,
             label: np.ndarray, memory: dict, number: int, rate: float = 0.01) -> float:
        """One step of Adam on the logistic loss of a batch of pages."""
        x = self.embed(hashed, dense, bags)
        laid, mask = self.lay(x, lengths)
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.chain("f", laid, mask, kept["f"]), self.chain("b", laid, mask, kept["b"]), laid], axis=2)
        z = (h @ self.p["out"])[..., 0] + self.p["bias"]
        y = np.zeros(mask.shape)
        y.T[mask.T] = label
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        dz = np.where(mask, p - y, 0.0) / mask.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.tensordot(h, dz, axes=([0, 1], [0, 1]))[:, None]
        grads["bias"][0] = dz.sum()
        dh = dz[..., None] * self.p["out"][:, 0]
        dx = dh[..., 2 * HIDDEN:] + self.back("f", kept["f"], dh[..., :HIDDEN], grads) + self.back(
            "b", kept["b"], dh[..., HIDDEN:2 * HIDDEN], grads)
        flat = dx.transpose(1, 0, 2)[mask.T] * (1 - x ** 2)
        grads["dense"] = dense.T @ flat
        counts = np.fromiter(map(len, hashed), np.int64, len(hashed))
        np.add.at(grads["hash"], np.fromiter((v for own in hashed for v in own), np.int64, int(counts.sum())),
                  np.repeat(flat, counts, axis=0))
        index, many = bags
        np.add.at(grads["bag"], index, np.repeat(flat / np.maximum(many, 1)[:, None], many, axis=0))
        for k, g in grads.items():
            m, v = memory.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.p[k] -= rate * (m / (1 - 0.9 ** number)) / (np.sqrt(v / (1 - 0.99 ** number)) + 1e-8)
        return float(-np.where(mask, y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12), 0).sum() / mask.sum())


def _bare(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path without names: containers that name their use are plain ones."""
    tags = (place.split(".")[0] for place in path)
    return tuple("div" if t in NAMING_TAGS else t for t in tags)


def _arranged(rng: np.random.Generator, main: list[Block], other: list[Block], strange: list[str],
              kinds: frozenset[str]) -> tuple[list[Block], list[int]]:
    """A page put together anew from blocks and strange texts, with other parts of these kinds, and its labels."""
    def pick(options):
        return options[int(rng.integers(len(options)))]

    def path(*parts: str) -> tuple[str, ...]:
        return tuple(p.replace("-", ".") for part in parts for p in part.split("/") if p)

    def texts(kind: str, n: int) -> list[tuple[str, int]]:
        out = []
        for _ in range(n):
            if kind in ("menu", "header", "footer", "sidebar", "form") and other and rng.random() < 0.5:
                b = pick(other)
                text = b.text
            else:
                text = pick(strange)
                if kind in ("menu", "form", "header") or kind != "comments" and rng.random() < 0.5:
                    text = " ".join(text.split()[:int(rng.integers(1, 9))])
            out.append((text, len(text) if kind in ("menu", "sidebar") and rng.random() < 0.7 else 0))
        return out

    wrap = path("html", "body", pick(WRAPPERS))
    blocks, labels = [], []
    if rng.random() < 0.03:  # no markup at all
        return [Block((), b.text, 0) for b in main], [1] * len(main)

    def other_part(kind: str, n: int, inside: tuple[str, ...] = ()) -> None:
        if kind not in kinds:
            return
        place = path(pick(OTHER_PLACES[kind]))
        for text, linked in texts(kind, n):
            blocks.append(Block((*(inside or wrap), *place), text, linked))
            labels.append(0)

    for kind in ("notice", "header", "menu", "advert", "sidebar"):
        if rng.random() < 0.55:
            other_part(kind, int(rng.integers(1, 7)))
    inner = (*wrap, *path(pick(MAIN_PLACES)))
    if rng.random() < 0.3:
        inner = (*inner, "div")
    at = set(rng.integers(0, len(main) + 1, 2).tolist()) if rng.random() < 0.6 else set()
    for k, b in enumerate(main):
        if k in at:
            other_part(pick(("advert", "notice", "form", "sidebar")), int(rng.integers(1, 3)), inner)
        blocks.append(Block((*inner, *path("h1" if not k and rng.random() < 0.6 else pick(MAIN_LEAVES))), b.text, b.linked))
        labels.append(1)
    if rng.random() < 0.5:
        other_part("comments", int(rng.integers(1, 9)), inner if rng.random() < 0.5 else ())
    for kind in ("form", "sidebar", "advert", "menu", "notice", "footer"):
        if rng.random() < 0.4:
            other_part(kind, int(rng.integers(1, 6)))
    return blocks, labels


def train(pages: list[list[Block]], steps: int = STEPS, seed: int = 10) -> Labeller | None:
    """From pages of which some containers name the article; None without any."""
    rng = np.random.default_rng(seed)
    known = []
    for blocks in pages:
        labels = [named_main(b.path) for b in blocks]
        if True in labels:
            known.append((blocks, [1 if x else 0 for x in labels]))
    if not known:
        return None
    strange = [b.text for blocks, labels in known for b, y in zip(blocks, labels, strict=True) if y] or ["text"]
    net, memory = Labeller(seed), {}
    for number in range(1, steps + 1):
        hashed, said, dense, lengths, label = [], [], [], [], []
        for k in rng.integers(0, len(known), BATCH).tolist():
            blocks, labels = known[k]
            bare = rng.random() < BARE
            if rng.random() < 0.75:
                main = [b for b, y in zip(blocks, labels, strict=True) if y]
                other = [b for b, y in zip(blocks, labels, strict=True) if not y]
                if rng.random() < 0.5:  # an article that begins and ends elsewhere
                    begin, end = sorted(rng.integers(0, len(main) + 1, 2).tolist())
                    main = main[begin:end] or main
                blocks, labels = _arranged(rng, main, other, strange, TOLD_WITHOUT_NAMES if bare else frozenset(OTHER_PLACES))
            if bare:
                blocks = [Block(_bare(b.path), b.text, b.linked) for b in blocks]
            h, d = encode(blocks)
            texts = [b.text for b in blocks]
            if rng.random() < 0.5:  # a page without its words: paths must do
                h, texts = [[x for x in own if x < PATH_HASHES] for own in h], [""] * len(h)
            hashed += h
            said += texts
            dense.append(d)
            lengths.append(len(h))
            label += labels
        net.step(hashed, np.concatenate(dense), bag(said), np.array(lengths), np.array(label, float), memory, number,
                 0.01 if number < steps * 0.7 else 0.003)
    return net


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Labeller | None:
    sample = (pages.filter(F.length("html").between(1, chars)).select("page_id", "html")
              .orderBy(F.xxhash64("page_id"), "page_id").limit(rows).toArrow())
    return train([read(h) for h in sample.column("html").to_pylist()])


def texts_of(net: Labeller | None, pages: list[str | None]) -> list[str]:
    """The main text of every page."""
    blocks = [read(p) for p in pages]
    if net is None:
        return ["\n\n".join(b.text for b in own if named_main(b.path) is not False) for own in blocks]
    every = [encode(own) for own in blocks]
    lengths = np.array([len(own) for own in blocks], np.int64)
    flat = [h for own, _ in every for h in own]
    likely = net.probability(flat, np.concatenate([d for _, d in every]) if flat else np.zeros((0, DENSE)),
                             bag([b.text for own in blocks for b in own]), lengths) >= 0.5
    first = np.cumsum(lengths) - lengths
    return ["\n\n".join(b.text for b, y in zip(own, likely[a:a + len(own)].tolist(), strict=True) if y)
            for own, a in zip(blocks, first.tolist(), strict=True)]


def extract(pages: DataFrame, net: Labeller | None) -> DataFrame:
    """pages with the column text instead of html (a column of that name is replaced)."""
    model = pages.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for part in slices(pa.record_batch([column], names=["text"])):
            out += texts_of(model.value, part.column(0).to_pylist())
        return pa.array(out, pa.string())

    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("html", "text")]
    return pages.select(*rest, run(F.col("html")).alias("text"))
