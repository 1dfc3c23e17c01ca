"""Main text of web pages by deducing each host's template from token equivalence classes.

Tokens are the opening tags of a page, told apart by their path (names with class and id, digits left out), and its runs of
text.  A token's occurrence vector lists how often it occurs on each page of its host.  Tokens with the same vector form a
class:

1. One pass sums, per host and token, pages, occurrences, characters of text and of link text directly inside, and a
   fingerprint of the occurrence vector (the sum of counts times page hashes).  Sums are taken per batch before they are
   shuffled, so a host with a third of all pages is a few rows per batch.
2. Tags on at least half of a host's pages are grouped by fingerprint.  A class is valid if its tokens share one innermost
   enclosing token outside the class; valid classes are nested under the class of that token.  Classes that occur once
   per page are the template's frame, the others (list items, paragraphs) are repeated content of a slot.
3. What the template holds besides its slots goes: runs of text of the class that is on every page of the host (of
   ``MANY_PAGES`` pages or more; on a page they make up at most a third of the text, else they stay), and subtrees of frame
   tokens that are nearly all link text.
4. The main region is the frame's article or main element if it has one, otherwise the innermost token outside of which the
   template has next to no text but links.  All slots of the region are returned in page order.
5. A second pass reads each page with its host's template.  A page without the region uses its own article or main
   element, and without one its body.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are left out wherever they
stand, by element name, role, or the class and id: whole names, or names of two parts one of which says so.  Names decide only
where the template leaves it open: never for html, body, main, article, headings and paragraphs, nor for an element that
holds most of its page's text.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import map_batches, mix, pinned

BROADCAST_BYTES = 32 << 20
SALTS = 16
MANY_PAGES = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*/>"
    r"|<(?P<raw>script|style|title|textarea|noscript|iframe|template|svg|object|select)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"\s+")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LEFT_OUT = set("nav header footer aside form button input label menu dialog".split())
_LEFT_OUT_WORDS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar sidebars footer header masthead cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup share sharing social comment comments disqus replies respond related "
    "recommended widget widgets toolbar pagination pager complementary contentinfo search".split()
)


_NEVER_BY_NAME = set("html body main article h1 h2 h3 h4 h5 h6 p".split())
_PARTS = re.compile(r"[-_]+")


def _says_so(name: str) -> bool:
    """Whether a class or id is a listed word, alone or as the one or the other of two parts."""
    parts = _PARTS.split(name.strip("-_0123456789"))
    if len(parts) > 2 or parts[0] in ("no", "with", "without", "has", "is", "tag", "post", "category"):
        return False
    return not _LEFT_OUT_WORDS.isdisjoint(parts)


def _attributes(text: str) -> tuple[str, bool, bool]:
    """Label of class and id, whether the element is hidden, and whether a class, id or role says that it isn't main text."""
    label, hidden, named = "", False, False
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden":
                hidden = True
            elif kind in ("class", "id", "role"):
                named = named or any(map(_says_so, value.split()))
                if kind != "role" and value:
                    label += ("." if kind == "class" else "#") + re.sub(r"[\d/]+", "", value)
    return label, hidden, named


class Page:
    """Elements of a page in order and its text runs: ``(path, left out, link, text)``; text None is a block boundary."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.runs: list[tuple[str, bool, bool, str | None]] = []
        stack: list[tuple] = []  # name, path, left out, link, elements around that their names exclude
        runs: list[tuple] = []
        state = path, out, link, named = "", False, False, ()
        at, elements = 0, 0

        def leave(k: int):
            nonlocal state
            for name, *_ in stack[k:]:
                if name in _BLOCK:
                    runs.append((*state, None))
                    break
            del stack[k:]
            state = stack[-1][1:] if stack else ("", False, False, ())

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                runs.append((*state, source[at : m.start()]))
            at = m.end()
            if m["raw"]:
                self.tokens.append(f"{state[0]}/{m['raw'].lower()}")
                continue
            if not m["name"]:
                continue
            name = m["name"].lower()
            if m["close"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        leave(k)
                        break
                continue
            ends = _ENDS_ITSELF.get(name, ())
            for k in range(len(stack) - 1, -1, -1):
                open_name = stack[k][0]
                if open_name in ends or (open_name == "p" and name in _BLOCK):
                    leave(k)
                    break
                if open_name in _BLOCK and open_name != "p":
                    break
            if name in _VOID:
                runs.append((*state, None if name == "hr" else " "))
                continue
            label, hidden, says = _attributes(m["attrs"])
            path, out, link, named = state
            inner = f"{path}/{name}{label}"
            self.tokens.append(inner)
            if name in _BLOCK:
                runs.append((*state, None))
            elif name in ("td", "th"):
                runs.append((*state, " "))
            if m["attrs"].rstrip().endswith("/") and name not in _BLOCK and name not in ("a", "b", "i", "em", "strong", "span"):
                continue
            if says and name not in _NEVER_BY_NAME:
                elements += 1
                named = (*named, elements)
            stack.append((name, inner, out or hidden or name in _LEFT_OUT, link or name == "a", named))
            state = stack[-1][1:]
        if at < len(source):
            runs.append((*state, source[at:]))
        self._decide(runs)

    def _decide(self, runs: list[tuple]) -> None:
        """Elements that their names exclude stay if they hold most of the page's text outside links."""
        total, inside = 0, defaultdict(int)
        for _, out, link, named, text in runs:
            if text and not out and not link:
                size = len(text) - text.count(" ") if named or not text.isspace() else 0
                total += size
                for element in named:
                    inside[element] += size
        kept = {e for e, size in inside.items() if 2 * size > total}
        self.runs = [(path, out or any(e not in kept for e in named), link, text) for path, out, link, named, text in runs]

    def blocks(self, slot: str | None, links: tuple = ()) -> list[str]:
        """Kept blocks of text inside ``slot`` (None: the whole page) and outside of ``links``."""
        blocks, part = [], []
        below = None if slot is None else slot + "/"
        apart = tuple(t + "/" for t in links)
        for path, out, _, text in self.runs:
            if text is None:
                if part:
                    blocks.append("".join(part))
                    part = []
            elif not out and (slot is None or path == slot or path.startswith(below)):
                if not links or not (path in links or path.startswith(apart)):
                    part.append(text)
        blocks.append("".join(part))
        clean = (_SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
        return [b for b in clean if b]

    def text(self, slot: str | None, links: tuple = (), constant: frozenset = frozenset()) -> str:
        """The kept blocks joined by an empty line, without the template's constant ones unless they are over a third."""
        blocks = self.blocks(slot, links)
        if constant:
            own = [b for b in blocks if text_hash(b) not in constant]
            if 3 * sum(map(len, own)) >= 2 * sum(map(len, blocks)):
                blocks = own
        return "\n\n".join(blocks)


def text_hash(block: str) -> int:
    return int.from_bytes(hashlib.blake2b(block.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _last(path: str) -> str:
    return re.split(r"[.#]", path.rsplit("/", 1)[-1])[0]


def own_slot(page: Page) -> str | None:
    """A page's own article or main element, else its body."""
    for names in (("article",), ("main",), ("body",)):
        for path in page.tokens:
            if _last(path) in names:
                return path
    return None


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return re.sub(r"^(?:www|m)\.", "", m[1].lower()) if m else ""


# --- template ------------------------------------------------------------------


def token_statistics(pages: DataFrame) -> DataFrame:
    """``host, token, pages, times, vector, chars, link_chars, place`` per host and token; token '' counts the pages."""

    def fn(batch):
        stats: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0, 0, 0, 0, 0])
        for k in range(batch.num_rows):
            number, url, source = (batch.column(c)[k].as_py() for c in range(3))
            host, page = host_of(url), Page(source or "")
            sign = int(mix(np.array([(number or 0) % 2**63], np.uint64))[0] >> np.uint64(16))
            seen: dict[str, list] = {}
            for place, token in enumerate(["", *page.tokens]):
                seen.setdefault(token, [0, place])[0] += 1
            for token, (times, place) in seen.items():
                for j, v in enumerate((1, times, times * sign, 0, 0, place)):
                    stats[host, token][j] += v
            for path, out, link, text in page.runs:
                if text and not out:
                    stats[host, path][3] += len(text)
                    stats[host, path][4] += len(text) * link
        if stats:
            cols = list(zip(*stats.values(), strict=True))
            yield {
                "host": [h for h, _ in stats], "token": [t for _, t in stats], "pages": cols[0], "times": cols[1],
                "vector": [str(v) for v in cols[2]], "chars": cols[3], "link_chars": cols[4], "place": cols[5],
            }

    schema = "host string, token string, pages long, times long, vector string, chars long, link_chars long, place long"
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "chars", "link_chars", "place")]
    vector = F.sum(F.col("vector").cast("decimal(38, 0)")).alias("vector")
    return map_batches(pages, fn, schema).groupBy("host", "token").agg(*sums, vector)


def constant_texts(pages: DataFrame, total: DataFrame) -> DataFrame:
    """``host, texts``: hashes of the blocks that are on every page of a host of ``MANY_PAGES`` or more.

    There are at most as many as blocks on a page.
    """

    def fn(batch):
        seen: dict[tuple[str, int], int] = defaultdict(int)
        for k in range(batch.num_rows):
            page = Page(batch.column(2)[k].as_py() or "")
            host = host_of(batch.column(1)[k].as_py())
            for text in {text_hash(b) for b in page.blocks(own_slot(page))}:
                seen[host, text] += 1
        if seen:
            yield {"host": [h for h, _ in seen], "text": [t for _, t in seen], "pages": list(seen.values())}

    counted = map_batches(pages, fn, "host string, text long, pages long").groupBy("host", "text").agg(F.sum("pages").alias("pages"))
    every = counted.join(total, "host").where((F.col("pages") == F.col("total")) & (F.col("total") >= MANY_PAGES))
    return every.groupBy("host").agg(F.collect_list("text").alias("texts"))


def deduce(stats: pd.DataFrame) -> dict:
    """Nested classes of one host's frequent tags, the main region (None if no tag qualifies), and tags of link text."""
    rows = {r.token: r for r in stats.itertuples(index=False) if r.token}
    groups: dict[tuple, list[str]] = defaultdict(list)
    for token, r in rows.items():
        groups[r.pages, r.times, r.vector].append(token)
    owner = {t: n for n, g in enumerate(groups.values()) for t in g}

    def outer(token: str, group: int) -> str | None:
        while "/" in token:
            token = token.rsplit("/", 1)[0]
            if token in owner and owner[token] != group:
                return token
        return None

    classes = []
    for n, ((pages, times, _), tokens) in enumerate(groups.items()):
        around = {outer(t, n) for t in tokens}
        tokens = sorted(tokens, key=lambda t: rows[t].place / rows[t].pages)
        if len(around) == 1:
            parent = around.pop()
            classes.append({"tokens": tokens, "frame": pages == times, "inside": parent})
    frame = [t for c in classes if c["frame"] for t in c["tokens"]]
    plain = sum(r.chars - r.link_chars for r in rows.values())
    kept = frozenset(
        t for t in frame if 2 * sum(r.chars - r.link_chars for u, r in rows.items() if u == t or u.startswith(t + "/")) > plain
    )
    open_frame = [t for t in frame if not _excluded(t, kept)]
    slot = next((t for name in ("article", "main") for t in sorted(open_frame, key=len) if _last(t) == name), None)
    weight, linked, counted = {}, {}, [(t, r) for t, r in rows.items() if not _excluded(t, kept)]
    for t in open_frame:
        below = [r for u, r in counted if u == t or u.startswith(t + "/")]
        weight[t], linked[t] = sum(r.chars for r in below), sum(r.link_chars for r in below)
    if slot is None:
        bodies = [t for t in open_frame if _last(t) == "body"] or open_frame
        slot = max(bodies, key=lambda t: (weight[t], -len(t)), default=None)
        while slot is not None:
            # Go in only if what is left outside is link text, or next to nothing.
            plain = {t: weight[t] - linked[t] for t in open_frame}
            inner = [t for t in open_frame if t.startswith(slot + "/") and 50 * (plain[slot] - plain[t]) <= plain[slot]]
            if not inner or not plain[slot]:
                break
            slot = min(inner, key=len)
    links = [t for t in open_frame if weight[t] and 10 * linked[t] >= 9 * weight[t] and _last(t) in ("ul", "ol", "div", "section", "table", "dl")]
    return {"classes": classes, "slot": slot, "links": [t for t in links if t != slot]}


def _excluded(path: str, kept: frozenset = frozenset()) -> bool:
    """Whether an element around ``path``, or its own, is left out by name; ``kept`` ones are not by class and id."""
    around = ""
    for step in path.split("/")[1:]:
        around += "/" + step
        name, *labels = re.split(r"[.#]", step)
        named = name not in _NEVER_BY_NAME and around not in kept and any(_says_so(n) for v in labels for n in v.split())
        if name in _LEFT_OUT or named:
            return True
    return False


def templates(pages: DataFrame) -> DataFrame:
    """``host, template, texts``: each host's template as JSON and its constant blocks.  Its tags are on half of the pages, its
    texts on all, so it stays small."""

    def fn(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "template": [json.dumps(deduce(pdf))]})

    stats = pinned(token_statistics(pages))
    total = stats.where("token = ''").select("host", F.col("pages").alias("total"))
    often = stats.join(total, "host").where("2 * pages >= total").drop("total")
    often = often.withColumn("vector", F.col("vector").cast("string"))
    found = often.groupBy("host").applyInPandas(fn, "host string, template string")
    texts = constant_texts(pages, total).select(F.col("host").alias("h"), "texts")
    joined = found.join(texts, found.host == texts.h, "full").select(F.coalesce("host", "h").alias("host"), "template", "texts")
    return pinned(joined)


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; the text is empty for null and empty pages and for pages without any.

    Pages with a null or unreadable url share one host.  Repeated rows are all returned.
    """
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    found = templates(rows)
    size = found.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("template"), F.lit(0)) + 8 * F.coalesce(F.size("texts"), F.lit(0)))).first()[0] or 0
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = rows.withColumn("host", F.regexp_replace(host, r"^(?:www|m)\.", ""))
    if size <= BROADCAST_BYTES:  # measured just above
        joined = keyed.join(F.broadcast(found), "host", "left")
    else:  # a hot host's pages are spread over copies of its template
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
        joined = salted.join(spread, ["host", "salt"], "left")

    def fn(batch):
        read: dict[str, tuple] = {}
        texts = []
        for k in range(batch.num_rows):
            template = batch.column(3)[k].as_py()
            if template not in read:
                parts = json.loads(template) if template else {}
                read[template] = parts.get("slot"), tuple(parts.get("links", ()))
            page = Page(batch.column(2)[k].as_py() or "")
            slot, links = read[template]
            constant = frozenset(batch.column(4)[k].as_py() or ())
            if slot in page.tokens:
                texts.append(page.text(slot, links, constant))
            else:
                texts.append(page.text(own_slot(page), (), constant))
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(joined.select("page_id", "url", "html", "template", "texts"), fn, "page_id long, url string, text string, n_chars long")
