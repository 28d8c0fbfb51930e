"""Main text of HTML pages by a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags. A block's features are the tags and the class
and id words of its ancestors, and what its text looks like (length, link share, punctuation, marks); the chain's
transitions depend on whether neighbours share their container. Weights are fitted by gradient ascent on the
log-likelihood of labelled pages (labelled_pages), and the best labelling is found by Viterbi, batched over pages.

Defined cases: null and empty html and pages without text give the empty text; unclosed and misnested tags close as
browsers roughly do; scripts, styles and comments never are text, even unclosed; the text of all other elements is, that of formulas,
drawings, embedded objects and their stand-ins too, and the field decides on it; text without any markup is one block;
pages of any length are whole; repeated rows give equal texts; other columns are carried by name and never read."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import labelled_pages
from keelson.llm.common import slices, strings

BITS = 13
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "title")}
_SPACE, _VALUE = re.compile(r"\s*"), re.compile(r"[^\s>]*")
#: Open elements that are told apart, as in browsers; what is nested deeper lies in the innermost of them.
DEEPEST = 512
_BLOCK = frozenset(
    "html head body title p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article header footer nav aside main blockquote pre form fieldset figure figcaption hr address details summary select option button label legend center ins dialog hgroup menu noscript object canvas iframe template textarea".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_ENDS_P = _BLOCK - {"button", "label", "option", "select", "ins", "noscript", "object", "canvas", "iframe", "template", "textarea"}
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_HEAD = frozenset(["head", "title"])


class _Scan:
    """A page's tokens by the states of the HTML tokenizer, each character looked at a bounded number of times.

    Quotes enclose a value only after "="; a quote that nothing closes is part of a value without quotes, so that it doesn't
    take the rest of the page. Comments, scripts and styles run to the end where nothing closes them; so does a tag without
    a closing bracket."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.missing: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where `what` is next; what was missed once isn't looked for again."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The end of a tag whose name ends at `at`; -1 if the page ends before."""
        page, close = self.page, at - 1
        while True:
            if close < at:
                close = self.find(">", at)
            if close < 0:
                return -1
            equals = page.find("=", at, close)
            if equals < 0:
                return close + 1
            at = _SPACE.match(page, equals + 1).end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and (end := self.find(quote, at + 1)) >= 0:
                at = end + 1
            else:
                at = _VALUE.match(page, at).end()

    def comment_end(self, at: int) -> int:
        """The end of a comment whose text begins at `at`."""
        if self.page.startswith((">", "->"), at):
            return self.page.index(">", at) + 1
        ends = [(x, x + len(mark)) for mark in ("-->", "--!>") if (x := self.find(mark, at)) >= 0]
        return min(ends)[1] if ends else len(self.page)

    def raw_end(self, tag: str, at: int) -> int:
        """Where the end tag of raw text begins, or -1."""
        if tag in self.missing:
            return -1
        found = _ENDS[tag].search(self.page, at)
        if not found:
            self.missing.add(tag)
            return -1
        return found.start()

    def tokens(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(begin, end, tag, closing, attributes); other markup has no tag but "!", raw text the tag "#"."""
        page, at, drawing = self.page, 0, False
        while (at := page.find("<", at)) >= 0:
            name = _NAME.match(page, at)
            if not name:
                after = page[at + 1 : at + 2]
                if after not in ("!", "?", "/") or not after:
                    at += 1
                    continue
                if page.startswith("!--", at + 1):
                    end = self.comment_end(at + 4)
                else:
                    end = self.find(">", at) + 1 or len(page)
                yield at, end, "!", False, ""
                at = end
                continue
            end = self.tag_end(name.end())
            if end < 0:
                yield at, len(page), "!", False, ""
                return
            tag, closing = name[2].lower(), bool(name[1])
            yield at, end, tag, closing, page[name.end() : end - 1]
            if tag == "svg":
                drawing = not closing and page[end - 2] != "/"
            at = end
            if not closing and (tag in ("script", "style") or (tag == "title" and not drawing)):
                end = self.raw_end(tag, at)
                if end >= 0 or tag != "title":
                    end = end if end >= 0 else len(page)
                    yield at, end, "#", False, ""
                    at = end


@dataclass
class Block:
    """A leaf block: its text, its open block-level elements and the text's characters within links."""

    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int
    features: list[int] = field(default_factory=list)
    same: bool = False


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order; the head has none."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = 0
    link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text and not any(tag in _HEAD for tag, _ in stack):
                out.append(Block(text, tuple(stack), linked))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if link else 0

    open_now: Counter[str] = Counter()
    deeper: Counter[str] = Counter()

    def close(tag: str, until: frozenset[str] = frozenset()) -> None:
        if deeper[tag]:
            deeper[tag] -= 1
            return
        if not open_now[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                open_now.subtract(x for x, _ in stack[i:])
                del stack[i:]
                deeper.clear()
                return
            if stack[i][0] in until:
                return

    at = 0
    for begin, end, tag, closing, attrs in _Scan(page).tokens():
        add(page[at:begin])
        at = end
        if tag in ("!", "#"):
            continue
        if tag in ("script", "style"):
            parts.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            link = False if tag in _ENDS_P else link
            if tag in _VOID or (tag == "title" and attrs.endswith("/")):
                continue
            if closing:
                close(tag)
                continue
            if tag in _ENDS_P:
                close("p", frozenset(["td", "th", "table"]))
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                close(tag, frozenset(["ul", "ol", "dl", "select", "table", "tr"] if tag != "tr" else ["table"]))
            if tag == "body":
                close("head")
            if len(stack) == DEEPEST:
                deeper[tag] += 1
                continue
            names: tuple[str, ...] = ()
            if "=" in attrs:
                names = tuple(sorted({w for g in _NAMES.findall(attrs) for w in _PART.findall("".join(g).lower())}))
            stack.append((tag, names))
            open_now[tag] += 1
        elif tag == "a":
            link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag == "svg" and closing and any(t == "title" for t, _ in stack):
            # an unclosed title of a drawing ends with it
            flush()
            close("title")
    add(page[at:])
    flush()
    return out


@lru_cache(1 << 16)
def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


@lru_cache(1 << 12)
def _ancestors(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    """Features of the chain of elements."""
    out = {"bias"}
    for depth, (tag, names) in enumerate(path):
        out.add(f"in {tag}")
        out.update(f"name {w}" for w in names)
        out.update(f"name {tag} {w}" for w in names)
        if depth == len(path) - 1:
            out.add(f"own {tag}")
            out.update(f"own name {w}" for w in names)
    tags = [tag for tag, _ in path]
    for inside in ("article", "main"):
        if inside in tags:
            after = tags[tags.index(inside) + 1 :]
            out.update(f"{inside} then {t}" for t in after)
            out.update(f"{inside} then name {w}" for _, names in path[tags.index(inside) + 1 :] for w in names)
    if not tags:
        out.add("bare")
    else:
        out.add(f"up {' '.join(tags[-2:])}")
    return tuple(_hash(x) for x in out)


def _looks(block: Block, i: int, n: int) -> list[int]:
    """Features of the text and its place."""
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    share = min(block.linked / max(size, 1), 1.0)
    marks = sum(text.count(c) for c in ".,;?!")
    out = [f"long {min(int(np.log2(words)), 7)}", f"link {int(share * 4)}", f"marks {min(marks * 8 // words, 6)}", f"end {text[-1] if text[-1] in '.?!:' else ''}"]
    out += [f"first {i}" if i < 3 else "", f"last {n - 1 - i}" if n - 1 - i < 3 else ""]
    if "©" in text or "copyright" in text[:40].lower():
        out.append("copyright")
    if text.isupper():
        out.append("upper")
    if share > 0.9:
        out.append("all link")
    tag = block.path[-1][0] if block.path else ""
    out.append(f"{tag} long {min(int(np.log2(words)), 5)}")
    return [_hash(x) for x in out if x]


def featurise(found: list[Block]) -> list[Block]:
    for i, block in enumerate(found):
        block.features = [*_ancestors(block.path), *_looks(block, i, len(found))]
        block.same = i > 0 and found[i - 1].path[:-1] == block.path[:-1]
    return found


@dataclass
class Crf:
    """score(y) = sum of emit[f] over features of main blocks + move[same][y', y] over neighbours."""

    emit: np.ndarray
    move: np.ndarray

    def label(self, found: list[list[Block]]) -> list[np.ndarray]:
        """The best labels of each page's blocks, by Viterbi over padded pages."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(found)
        order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
        for a, b in slices([len(found[i]) for i in order], 1 << 14):
            part = [found[i] for i in order[a:b]]
            gain, same, size = self._padded(part)
            best = np.stack([np.zeros(len(part)), gain[:, 0]], 1)
            back = np.zeros((gain.shape[1], len(part), 2), np.int8)
            scores = [best]
            for t in range(1, gain.shape[1]):
                step = best[:, :, None] + self.move[same[:, t]]
                back[t] = step.argmax(1)
                best = step.max(1)
                best[:, 1] += gain[:, t]
                scores.append(best)
            for j, i in enumerate(order[a:b]):
                y = np.zeros(size[j], np.int64)
                y[-1] = scores[size[j] - 1][j].argmax()
                for t in range(size[j] - 1, 0, -1):
                    y[t - 1] = back[t, j, y[t]]
                out[i] = y
        return out

    def _padded(self, part: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in part])
        gain, same = np.zeros((len(part), size.max())), np.zeros((len(part), size.max()), np.int64)
        flat = [b for page in part for b in page]
        n = np.array([len(b.features) for b in flat])
        sums = np.add.reduceat(self.emit[np.concatenate([b.features for b in flat])], np.cumsum(n) - n)
        where = np.arange(size.max()) < size[:, None]
        gain[where], same[where] = sums, [int(b.same) for b in flat]
        return gain, same, size


def train(pages: list[list[Block]], labels: list[np.ndarray], steps: int = 100, rate: float = 0.2, l2: float = 1e-4) -> Crf:
    """Adam on the mean log-likelihood per block, gradients by forward-backward over padded pages."""
    crf = Crf(np.zeros(1 << BITS), np.zeros((2, 2, 2)))
    keep = [i for i in range(len(pages)) if pages[i]]
    pages, labels = [pages[i] for i in keep], [labels[i] for i in keep]
    flat = [b for page in pages for b in page]
    idx, n = np.concatenate([b.features for b in flat]), np.array([len(b.features) for b in flat])
    of = np.repeat(np.arange(len(flat)), n)
    true = np.concatenate(labels).astype(float)
    m, v = [np.zeros_like(crf.emit), np.zeros_like(crf.move)], [np.zeros_like(crf.emit), np.zeros_like(crf.move)]
    for step in range(1, steps + 1):
        gain, same, size = crf._padded(pages)
        pages_n, width = gain.shape
        live = np.arange(width) < size[:, None]
        y = np.zeros_like(gain, dtype=np.int64)
        y[live] = true.astype(np.int64)
        node = np.stack([np.zeros_like(gain), gain], 2)
        forward, backward = np.zeros((pages_n, width, 2)), np.zeros((pages_n, width, 2))
        forward[:, 0] = node[:, 0]
        for t in range(1, width):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + crf.move[same[:, t]], 1) + node[:, t]
        for t in range(width - 2, -1, -1):
            on = np.logaddexp.reduce(crf.move[same[:, t + 1]] + (node[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(live[:, t + 1, None], on, 0)
        total = np.logaddexp.reduce(forward[np.arange(pages_n), size - 1], 1)
        p = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])[live]
        grads = [np.bincount(idx, (true - p)[of], 1 << BITS) / len(flat) - l2 * crf.emit, -l2 * crf.move]
        pair = forward[:, :-1, :, None] + crf.move[same[:, 1:]] + (node[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.where(live[:, 1:, None, None], pair, -np.inf))
        for kind in (0, 1):
            at = live[:, 1:] & (same[:, 1:] == kind)
            seen = np.bincount((y[:, :-1] * 2 + y[:, 1:])[at], minlength=4).reshape(2, 2)
            grads[1][kind] += (seen - pair[at].sum(0)) / len(flat)
        for j, (x, g) in enumerate(zip((crf.emit, crf.move), grads)):
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.99 * v[j] + 0.01 * g * g
            x += rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
    return crf


def labelled(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels of labelled_pages' markup."""
    found = [blocks(x) for x in pages]
    labels = [np.array([int("\x01" in b.text) for b in page]) for page in found]
    for page in found:
        for b in page:
            b.text = " ".join(b.text.replace("\x01", "").replace("\x02", "").split()) or "-"
        featurise(page)
    return found, labels


@lru_cache(4)
def model(pages: int = 500, seed: int = 0) -> Crf:
    """The field fitted on so many labelled pages."""
    return train(*labelled(labelled_pages.pages(pages, seed)))


def main_texts(pages: list[str], crf: Crf) -> list[str]:
    out: list[str] = []
    for a, b in slices([len(x) for x in pages], 1 << 22):
        found = [featurise(blocks(x)) for x in pages[a:b]]
        out += ["\n".join(block.text for block, y in zip(page, labels) if y) for page, labels in zip(found, crf.label(found))]
    return out


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", crf: Crf | None = None) -> DataFrame:
    """(key, url, text, n_chars) of every row. The field's weights are a few dozen kB and travel with the task."""
    fitted = crf or model()
    types = [pages.schema[c].dataType.simpleString() for c in (key, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(strings(batch.column("__html")), fitted)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    rows = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"))
    return rows.mapInArrow(run, f"`{key}` {types[0]}, `{url}` {types[1]}, text string, n_chars long")
