"""HTML extraction: the main text of a page as its maximum-scoring run of words and tags.

A page is read once into a sequence of tokens: words of blocks, which score positive, and tags between blocks, which score negative. What the page marks itself as
something else (navigation, headers, footers, asides, forms, adverts, notices, comments, by element, class, id or role) is one negative token, whatever its length, so that a long
aside in the middle does not tear the article. One linear scan finds the contiguous run of tokens of the greatest sum; its unmarked blocks are the text. The
weights of the kinds of tokens are learned from labelled pages (html and the text wanted) by a perceptron on whole runs with a margin: words stay at 0 or above, tags at 0 or below.

Blocks are the page's block elements; inline elements do not part words, `br` is white space. Reading follows browsers: end tags of nothing are ignored, a `p`, `li` or cell ends
where the next begins, scripts and styles end at their end tag alone. A marked element that is never closed covers what follows only up to the next article, main or h1.

Defined results: a null or empty page, and one where nothing scores above 0, gives an empty text; of equal runs the first and shortest counts. Repeated rows are rows. Pages of any
length and depth are read in time proportional to their length. Other columns are not read, whatever their names. No pages, no rows.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposark.llm.common import map_batches, needed

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist dialog head map object optgroup option select svg video".split())
#: Elements that begin no block and end no paragraph.
PHRASING = INLINE | (UNSEEN - {"dialog", "head"})
IN_HEAD = frozenset("base basefont link meta noscript script style template title".split())
MARKED = frozenset("aside footer form header menu nav".split())
CONTENT = frozenset("article main".split())
LISTS, HEADINGS, TABLES = frozenset("dd dl dt li ol ul".split()), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("caption table tbody td tfoot th thead tr".split())
#: An element that ends where one of the same row begins.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("article aside blockquote body div dl footer form header main menu nav ol section table tbody tr ul".split())

NOISE_WORDS = frozenset("""ad ads adsense advert advertisement advertisements advertising adverts adv alert aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
disqus discussion footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related
replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
STRONG_WORDS = frozenset("article body main post story text".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NEGATED = frozenset("has is no non not with without".split())
#: Headings of what readers or the site add below an article, in the corpus's languages.
AFTERWORDS = re.compile(r"\W*(\d+\s+)?((reader|user|leser|leave a|write a|post a)\s*-?)?\s*(comments?|responses|repl(y|ies)|kommentare?|commentaires?|comentarios?|related( (articles|posts|stories|links|news|reading))?|more (stories|from .{1,40}|articles|news)|read (more|next)|you (may|might) also like|recommended( for you)?|share this( .{1,20})?|advertisement|anzeige|werbung|publicité|publicidad|newsletter|mehr zum thema|weitere artikel|à lire aussi|articles liés|artículos relacionados|subscribe.{0,40}|follow us.{0,40})\s*(\(\s*\d+\s*\))?\W*", re.I)
#: Short blocks that state rights or ask for consent.
RIGHTS = re.compile(r"\s*(©|\(c\)\s|copyright\s+(©|\(c\)|\d{4}))|.*\b(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\W*$", re.I | re.S)
CONSENT = re.compile(r"(?=.*\bcookies?\b)(?=.*\b(accept|agree|consent|continuing|akzeptier\w*|zustimm\w*|acceptez?|accepter|aceptar?|acepta)\b)", re.I | re.S)
SHORT_BLOCK = 300

_MARKUP = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|[!?/])")
#: The rest of a tag: quotes count after = only; a quote that never closes is part of the value.
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SPEAKS = re.compile(r"[\W_]*\w").match
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")

WORD_KINDS = ("plain", "link", "heading")
TAG_KINDS = ("paragraph", "heading", "list", "table", "other", "marked", "content")
PLACES = ("inside", "unmarked", "outside")
N_WORDS = len(WORD_KINDS) * len(PLACES)
N_KINDS = N_WORDS + len(TAG_KINDS) * len(PLACES)


def named_as(names: str) -> int:
    """1 if class names or an id say that an element is something beside the article, 3 if a header, -1 if they say that it is the article, else 0."""
    verdict = 0
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if NEGATED.intersection(parts) or not parts:
            continue
        if parts[-1] == "header":
            verdict = verdict or 3
        elif parts[-1] in NOISE_WORDS or (parts[0] in NOISE_WORDS and parts[-1] not in STRONG_WORDS):
            verdict = 1
        elif parts[-1] in CONTENT_WORDS and (len(parts) == 1 or parts[-1] in ("article", "body", "content", "text") or parts[0] in STRONG_WORDS):
            return -1
    return verdict


@functools.lru_cache(maxsize=4096)
def mark_of(name: str, attributes: str) -> int:
    """2 for an element that is not shown, 1 for one beside the article, 3 for a header, -1 for the article's, 0 for others."""
    if name in UNSEEN:
        return 2
    found: dict[str, str] = {}
    bare = _ATTRIBUTE.sub(lambda m: found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "") and " " or " ", attributes)
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", bare, re.I) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return 2
    if name in ("body", "html"):
        return 0
    role = found.get("role", "").lower()
    said = named_as(html.unescape(f"{found.get('class', '')} {found.get('id', '')}"))
    if name == "header" or (said == 3 and name not in MARKED):
        return 3
    if role in NOISE_ROLES or name in MARKED or said == 1:
        return 1
    return -1 if name in CONTENT or said == -1 or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" else 0


class _Element:
    """An element from event first to event last; next is the event that follows it, earlier where its mark does not reach its end."""

    __slots__ = ("name", "mark", "first", "last", "next", "closed")

    def __init__(self, name: str, mark: int, first: int) -> None:
        self.name, self.mark, self.first, self.last, self.next, self.closed = name, mark, first, first, first + 1, True


def events(page: str) -> list:
    """The page in order: texts as str, and (element, whether it begins here) for elements that part blocks, are links or are marked; "br" is a space."""
    out: list = []
    stack: list[_Element] = []
    open_names: dict[str, int] = {}
    begins_content: list[int] = []  # where articles, main parts and first headings begin

    def begin(name: str, mark: int) -> None:
        e = _Element(name, mark, len(out))
        out.append((e, True))
        if name in ("article", "main", "h1"):
            begins_content.append(e.first)
        if name in VOID:
            return
        stack.append(e)
        open_names[name] = open_names.get(name, 0) + 1

    def end(closed: bool) -> None:
        e = stack.pop()
        open_names[e.name] -= 1
        e.last, e.next, e.closed = len(out), len(out) + 1, closed or e.name in SIBLINGS or e.name == "p"
        out.append((e, False))

    def end_near(names: tuple[str, ...]) -> None:
        """End the nearest of the named elements unless a container is between."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                while len(stack) > k:
                    end(True)
                return
            if stack[k].name in CONTAINERS:
                return

    def text(piece: str) -> None:
        if open_names.get("head") and stack[-1].name == "head" and not piece.isspace():
            end(True)
        out.append(piece)

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        if m[1]:
            stop = page.find("-->", m.end() - 2)
            at = stop + 3 if stop >= 0 else len(page)
            continue
        rest = _REST.match(page, m.end()) if m[3] else None
        if not rest:
            stop = page.find(">", m.end())
            at = stop + 1 if stop >= 0 else len(page)
            continue
        at = rest.end()
        name = m[3].lower()
        if m[2]:
            if open_names.get(name):
                while stack[-1].name != name:
                    end(False)
                end(True)
            elif name in ("br", "p"):
                out.append(" ")
            continue
        if name in RAW:
            stop = _end_of_raw(name).search(page, at)
            out.append(" " if name in ("noscript", "iframe", "textarea") else "")
            at = stop.end() if stop else len(page)
            continue
        if name == "br":
            out.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if open_names.get("head") and name not in IN_HEAD:
            while open_names["head"]:
                end(True)
        mark = mark_of(name, rest[0][:-1]) if name in UNSEEN or name in MARKED or name in CONTENT or "=" in rest[0] or "idden" in rest[0] else 0
        if name in SIBLINGS:
            if name != "option" and open_names.get("p"):
                end_near(("p",))
            end_near(SIBLINGS[name])
        if name == "a":
            if open_names.get("a"):
                end_near(("a",))
            begin(name, max(mark, 0))
        elif name in PHRASING or (name not in _KNOWN and "-" not in name):
            if mark > 0:
                begin(name, mark)
        else:
            if open_names.get("p"):
                end_near(("p",))
            begin(name, mark)
    if at < len(page):
        text(page[at:])
    while stack:
        end(False)
    _settle(out, begins_content)
    return out


_KNOWN = frozenset("address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p param pre section select summary table tbody td tfoot th thead tr ul audio base button canvas datalist embed input map object source svg track video area".split())


@functools.cache
def _end_of_raw(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I)


def _settle(out: list, begins_content: list[int]) -> None:
    """Marks that must not cover the article: of elements never closed, of forms and of wrappers around it, and of an article's own header (4 from here on, of which headings are kept)."""
    elements = [x[0] for x in out if not isinstance(x, str) and x[1]]
    k, article_to = 0, -1
    for e in elements:
        while k < len(begins_content) and begins_content[k] <= e.first:
            k += 1
        if e.name in CONTENT and e.mark == -1:
            article_to = max(article_to, e.last)
        if e.mark == 3:
            e.mark = 4 if e.first < article_to else 1
        if e.mark == 1 and k < len(begins_content) and begins_content[k] < e.last:
            if e.name == "form":
                e.mark = 0
            elif not e.closed:
                e.next = begins_content[k]
    # where all that says it is the article lies in wrappers marked by class alone, these are layout
    content = [e for e in elements if e.mark == -1]
    covered_to = -1
    wrappers, bare = [], False
    for e in elements:
        if e.first < covered_to:
            if e.mark == -1 and wrappers and e.first < wrappers[-1][0].next:
                wrappers[-1][1].append(e)
        elif e.mark in (1, 2):
            covered_to = e.next
            wrappers.append((e, []))
        elif e.mark == -1:
            bare = True
    if content and not bare:
        for e, held in wrappers:
            if held and e.mark == 1 and e.name not in MARKED:
                e.mark = 0


class Page:
    """Blocks (text, whether marked) and the tokens of a page: kind, amount, and the block whose words they are, or -1."""

    def __init__(self, page: str) -> None:
        self.blocks: list[str] = []
        self.tokens: list[tuple[int, float, int]] = []
        items = events(page)
        place_of = 1 if not any(not isinstance(x, str) and x[0].mark == -1 for x in items) else 2
        inside = links = 0
        skip_to = header_to = -1  # events of what is not read; an article's own header
        heading = ""
        after: tuple[int, str] | None = None  # a heading of afterwords: where its parent ends, and its rank
        parents: list[_Element] = []
        texts: list[str] = []
        n_links = 0

        def flush() -> None:
            nonlocal n_links, after
            if not texts:
                return
            words = html.unescape("".join(texts)).split()
            texts.clear()
            of_links, n_links = n_links, 0
            if not words or (at < header_to and not heading):
                return
            text = " ".join(words)
            place = 0 if inside else place_of
            if heading and heading != "h1" and len(text) < 80 and AFTERWORDS.fullmatch(text):
                around = next((p for p in reversed(parents) if p.name not in HEADINGS), None)
                after = (around.last if around else len(items), heading)
            if after or (not inside and len(text) < SHORT_BLOCK and (RIGHTS.match(text) or CONSENT.match(text))):
                self._tag("marked", place)
                return
            n = sum(1 for x in words if _SPEAKS(x))  # separators such as | are no words
            of_links = min(of_links, n)
            self.blocks.append(text)
            k = len(self.blocks) - 1
            if heading:
                self.tokens.append((2 * len(PLACES) + place, float(n), k))
            else:
                if n > of_links or not n:
                    self.tokens.append((place, float(n - of_links), k))
                if of_links:
                    self.tokens.append((len(PLACES) + place, float(of_links), k))

        at = 0
        for at, item in enumerate(items):
            if at < skip_to:
                continue
            if isinstance(item, str):
                texts.append(item)
                if links:
                    n_links += len(item.split())
                continue
            e, begins = item
            if after and at >= after[0]:
                flush()
                after = None
            if begins and e.mark in (1, 2):
                if e.name in PHRASING:
                    texts.append(" ")
                else:
                    flush()
                skip_to = e.next
                if e.mark == 1:
                    self._tag("marked", 0 if inside else place_of)
                continue
            if e.name == "a":
                links = links + 1 if begins else max(0, links - 1)
            if e.name in PHRASING:
                continue
            if e.mark == 4 and begins:
                flush()
                header_to = e.next
            flush()
            if begins and e.name in HEADINGS and after and e.name <= after[1]:
                after = None
            if e.name in HEADINGS:
                heading = e.name if begins else ""
            if e.name not in VOID:
                if begins:
                    parents.append(e)
                elif parents and parents[-1] is e:
                    parents.pop()
            if e.mark == -1:
                if begins:
                    self._tag("content", 0 if inside else place_of)
                    inside += 1
                else:
                    inside -= 1
                    self._tag("content", 0 if inside else place_of)
                continue
            kind = "paragraph" if e.name in ("p", "blockquote", "pre", "hr") else "heading" if e.name in HEADINGS else "list" if e.name in LISTS else "table" if e.name in TABLES else "other"
            self._tag(kind, 0 if inside else place_of)
        at = len(items)
        flush()

    def _tag(self, kind: str, place: int) -> None:
        self.tokens.append((N_WORDS + TAG_KINDS.index(kind) * len(PLACES) + place, 1.0, -1))

    def text(self, weights: list[float]) -> str:
        first, last = best_run([weights[k] * n for k, n, _ in self.tokens])
        chosen = dict.fromkeys(b for _, _, b in self.tokens[first:last] if b >= 0)
        return "\n".join(self.blocks[b] for b in chosen)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Where the contiguous run of the greatest positive sum begins and ends; (0, 0) if there is none. One pass."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def labelled_pages(n: int, seed: int = 7) -> Iterator[tuple[str, str]]:
    """Pages of made-up words in the usual layouts, each with the text wanted of it. Any other pages with their texts do as well."""
    r = random.Random(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v st tr".split() for b in "a e i o u an er".split()]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    words = lambda low, high: [word() for _ in range(r.randint(low, high))]
    sentence = lambda low=4, high=25: " ".join(words(low, high)).capitalize() + "."
    links = lambda k: "".join(f'<li><a href="/{word()}">{" ".join(words(1, 3))}</a></li>' for _ in range(k))
    wrap = lambda name, inner, attributes="": f"<{name}{attributes}>{inner}</{name}>"

    def named(names: str) -> str:
        return f' {r.choice(("class", "id"))}="{r.choice(names.split())}"'

    def noise() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return wrap("nav", wrap("ul", links(r.randint(2, 9))))
        if kind == 1:
            return wrap("div", wrap("ul", links(r.randint(3, 15))), named("menu box links left") if r.random() < 0.7 else "")
        if kind == 2:
            return wrap("aside", wrap("h3", word()) + "".join(wrap("p", sentence()) for _ in range(r.randint(1, 8))))
        if kind == 3:
            return wrap("div", sentence(), named("ad advert banner sponsor cookie-notice promo"))
        if kind == 4:
            return wrap("form", wrap("label", word()) + '<input name="q">' + wrap("button", word()))
        if kind == 5:
            return wrap("div", wrap("h3", "Comments") + "".join(wrap("div", wrap("p", sentence()), ' class="comment"') for _ in range(r.randint(1, 9))), named("comments discussion"))
        if kind == 6:
            return wrap("div", "".join(wrap("div", f'<a href="#">{" ".join(words(2, 6))}</a>') for _ in range(r.randint(2, 8))))
        if kind == 7:
            return wrap("table", "".join(wrap("tr", wrap("td", f'<a href="#">{word()}</a>') + wrap("td", word())) for _ in range(r.randint(2, 6))))
        return wrap("div", " | ".join(f'<a href="#">{word()}</a>' for _ in range(r.randint(2, 8))))

    for _ in range(n):
        blocks: list[tuple[str, str]] = [("h1", " ".join(words(2, 9)))] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13, 21))):
            kind = r.random()
            text = sentence(1, 6) if kind < 0.25 else " ".join(sentence() for _ in range(r.randint(1, 5)))
            blocks.append(("h2" if kind > 0.93 else "li" if kind > 0.85 else "td" if kind > 0.83 else r.choice(("p", "p", "p", "p", "div")), text))
        if r.random() < 0.05:
            blocks = []
        inner = []
        for name, text in blocks:
            shown = text if r.random() < 0.7 else text.replace(" ", f' <a href="#">{word()}</a> ', 0) if r.random() < 0.3 else wrap(r.choice(("b", "i", "a", "span")), text.split(" ")[0]) + text[len(text.split(" ")[0]) :]
            inner.append({"li": wrap("ul", wrap("li", shown)), "td": wrap("table", wrap("tr", wrap("td", shown)))}.get(name) or (f"<p>{shown}" if name == "p" and r.random() < 0.1 else wrap(name, shown)))
            if r.random() < 0.06:
                inner.append(r.choice((wrap("div", sentence(), ' class="ad"'), wrap("script", "if (a < b) { c() }"), wrap("aside", wrap("p", sentence())), "<!-- " + word() + " -->")))
        body = "".join(inner)
        style = r.randrange(6)
        body = wrap("article", body) if style == 0 else wrap("main", body) if style == 1 else wrap("div", body, named("content article-body post entry-content story main")) if style == 2 else wrap("div", wrap("div", body)) if style == 3 else wrap("td", body) if style == 4 else body
        if style == 4:
            body = wrap("table", wrap("tr", wrap("td", wrap("ul", links(5))) + body))
        before, behind = [noise() for _ in range(r.randint(0, 4))], [noise() for _ in range(r.randint(0, 4))]
        foot = r.choice((wrap("footer", sentence()), wrap("div", sentence(), named("footer copyright")), wrap("p", "&copy; " + sentence(2, 6)), ""))
        yield f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before)}{body}{''.join(behind)}{foot}</body></html>", "\n".join(t for _, t in blocks)


#: Labelled pages that the weights are learned from, and how often each is seen.
PAGES, ROUNDS = 600, 6
MARGIN = 0.3


def fit(pages: list[tuple[str, str]], rounds: int = ROUNDS) -> list[float]:
    """Weights of the kinds of tokens, from (html, text wanted): averaged perceptron over whole runs, each beaten by a margin for every token that it has wrong."""
    sign = np.array([1.0] * N_WORDS + [-1.0] * (N_KINDS - N_WORDS))
    w = sign * np.array([1.0] * 3 + [0.3] * 3 + [0.7] * 3 + [0.6] * (N_KINDS - N_WORDS))
    cases = []
    for page, text in pages:
        read, wanted = Page(page), set(text.split("\n"))
        kinds = np.array([k for k, _, _ in read.tokens], int)
        amounts = np.array([n for _, n, _ in read.tokens])
        right = [i for i, (_, _, b) in enumerate(read.tokens) if b >= 0 and read.blocks[b] in wanted]
        run = (right[0], right[-1] + 1) if right else (0, 0)
        cases.append((kinds, amounts, run))
    total, seen = np.zeros(N_KINDS), 0
    for turn in range(rounds):
        for kinds, amounts, (first, last) in cases:
            inside = np.zeros(len(kinds), bool)
            inside[first:last] = True
            scores = w[kinds] * amounts + MARGIN * np.sqrt(amounts) * np.where(inside, -1.0, 1.0)
            a, b = best_run(scores.tolist())
            if (a, b) != (first, last):
                step = np.bincount(kinds[first:last], np.sqrt(amounts[first:last]), N_KINDS) - np.bincount(kinds[a:b], np.sqrt(amounts[a:b]), N_KINDS)
                w = w + 0.1 / (1 + turn) * step / max(1.0, np.abs(step).max())
                w = np.where(sign > 0, np.maximum(w, 0.0), np.minimum(w, 0.0))
            total, seen = total + w, seen + 1
    return (total / max(1, seen)).tolist()


@functools.cache
def default_weights() -> tuple[float, ...]:
    return tuple(fit(list(labelled_pages(PAGES))))


def extract(page: str | None, weights: list[float] | tuple[float, ...]) -> str:
    return Page(page).text(weights) if page else ""


def main_text(pages: DataFrame, weights: list[float] | tuple[float, ...] | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    chosen = tuple(weights or default_weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, chosen) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = needed(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
