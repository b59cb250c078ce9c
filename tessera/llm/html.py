"""Main text of web pages by consensus paths of a host.

Each page scores its containers; a container's path, generalised to tags and classes, gets the score as a vote.
Each page also tells what stands in elements whose names suggest comments, adverts or notices: how much, how much of
it in links, and which text. Both are summed per host in Spark: the host's votes name its main container and the
suspects that are junk there, and every page is then read again at the winning path without them.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import save

#: Fixed values of HTML: elements without content, elements whose content is not text, elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div body td".split())
#: Elements that never hold main text, and those that hold controls: a block of nothing else is no text.
DROP = frozenset("nav aside footer form script style noscript iframe svg math canvas template select option textarea input object embed audio video menu dialog head title".split())
CONTROL = frozenset("button label".split())
#: Words of a class or id that tell of adverts and comments wherever they stand in the name, and those that take it back.
ADVERT = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promoted".split())
TALK = frozenset("comment comments commenter disqus discussion discussions respond replies".split())
UNSAID = frozenset("no non not free without has open closed enabled disabled count".split())
#: Words that tell of junk where a name has only these and words of layout.
JUNK = ADVERT | TALK | frozenset(
    "promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "reply sidebar side widget widgets related recommended recommendations trending share sharing social follow "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc masthead footer header topbar toolbar login search skip legal copyright".split()
)
#: Words of layout that say nothing of what an element holds: a class is junk if it has a junk word and only these beside it.
LAYOUT = frozenset("box list block area wrap wrapper container section inner outer bar item items link links post posts left right top bottom main content text site page global primary secondary col column row unit slot form panel group icons buttons button js c".split())
#: Open elements that a new one of a kind ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl td th article section div body html".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^>]*(?:>|\Z)))", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"[\s ]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(raw)} if raw else {}


def _told_by(names: str) -> tuple[str, bool]:
    """The junk word in the names of a class or id attribute, empty for none, and whether it is one of adverts or talk:
    `sidebar-left` tells `sidebar`, `user-comments-list` tells `comments`, `related-work` and `ad-free` nothing."""
    weak = ""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if not UNSAID.isdisjoint(words):
            continue
        for w in words:
            if w in ADVERT or w in TALK:
                return w, True
        if not weak and all(w in JUNK or w in LAYOUT for w in words):
            weak = next((w for w in words if w in JUNK), "")
    return weak, False


def _is_dropped(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    """What its element, role or style takes out before any vote."""
    if tag in DROP or (tag == "header" and not inside_main):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog")


#: Suspects that are told by a word of adverts or talk, and those that stand in an article, by the first letters of a key.
STRONG, INSIDE = "!", "in"


def _suspect(tag: str, attrs: dict[str, str], inside_main: bool) -> str:
    """Key of an element that its names make suspect: where it stands, tag and word. Empty for none. There are only so many."""
    if tag in ("body", "html", "main") or tag in HEADING:
        return ""
    (word, strong), (other, strong_id) = _told_by(attrs.get("class", "")), _told_by(attrs.get("id", ""))
    if strong_id and not strong or not word:
        word, strong = other, strong_id
    if not word:
        return ""
    return f"{STRONG if strong else ''}{INSIDE if inside_main else 'out'}>{tag if tag in BLOCK else 'inline'}.{word}"


def is_junk(key: str, pages: int, texts: int, chars: int, linked: int, whole: int) -> bool:
    """Whether a suspect is junk, by what pages hold under its key: `texts` different ones on `pages`, `chars` characters,
    `linked` of them in links, out of `whole` on these pages. `junk_here` is the same for a column.

    What holds half of the text is what the pages are for. Otherwise adverts and talk are junk, and so is what is mostly
    links, or says the same on page after page; the rest is junk only outside articles."""
    if 2 * chars >= whole:
        return False
    return key.startswith(STRONG) or 2 * linked >= chars or (pages > 1 and 2 * texts <= pages) or not key.startswith(INSIDE)


def junk_here():
    """`is_junk` over columns path, pages, texts, chars, linked, whole."""
    weak = (2 * F.col("linked") >= F.col("chars")) | ((F.col("pages") > 1) & (2 * F.col("texts") <= F.col("pages"))) | ~F.col("path").startswith(INSIDE)
    return (2 * F.col("chars") < F.col("whole")) & (F.col("path").startswith(STRONG) | weak)


def _label(tag: str, attrs: dict[str, str]) -> str:
    """A step of a generalised path: the tag and its classes, with digits left out, in order."""
    names = sorted({re.sub(r"\d+", "", c) for c in attrs.get("class", "").lower().split()} - {""})
    return ".".join([tag, *names])


#: Part of a block's worth below which containers further out get none: 72 steps out.
LEAST_SHARE = 1e-9


class Page:
    """Blocks of text of a page, each with the containers it stands in."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int, str]] = []  # text, innermost container, characters in links, suspect around it
        self.containers: list[tuple[int, int]] = [(0, -1)]  # number of its path, container around it
        self.steps: list[tuple[int, str]] = [(-1, "")]  # paths as a trie: number of the path before, last step
        numbers: dict[tuple[int, str], int] = {}
        # open elements: tag, container, whether its text is dropped, inside main text, suspect; and how many of each tag
        stack: list[tuple[str, int, bool, bool, str]] = [("", 0, False, False, "")]
        opened: Counter = Counter()
        text: list[str] = []
        linked, links, said = 0, 0, False

        def close_block() -> None:
            nonlocal linked, said
            joined = SPACE.sub(" ", entities.unescape("".join(text))).strip() if said else ""
            if joined and not stack[-1][2]:
                self.blocks.append((joined, stack[-1][1], linked, stack[-1][4]))
            text.clear()
            linked, said = 0, False

        def close_from(k: int) -> None:
            opened.subtract(s[0] for s in stack[k:])
            del stack[k:]

        at = 0
        while True:
            m = TAG.search(source, at)
            piece = source[at : m.start()] if m else source[at:]
            if piece and not stack[-1][2]:
                text.append(piece)
                linked += len(piece) if links else 0
                said = said or not piece.isspace() and not (opened["button"] or opened["label"])
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:  # an end tag
                if tag == "a":
                    links = max(0, links - 1)
                if not opened[tag]:
                    if tag == "p":
                        close_block()
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if any(s[0] in BLOCK for s in stack[k:]):
                            close_block()
                        close_from(k)
                        break
                    if stack[k][0] in SCOPE and tag not in BLOCK:
                        break
                continue
            raw = m[3] or ""  # none where a quote is never closed: the tag ends at its first >
            attrs = _attributes(raw)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCK:
                close_block()
                if tag != "hr" and opened["p"]:  # a block ends an open paragraph, with what was left open in it
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "p":
                            close_from(k)
                            break
                        if stack[k][0] in BLOCK:
                            break
            if tag in ENDS and any(opened[x] for x in ENDS[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ENDS[tag]:
                        close_block()
                        close_from(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
            if tag in VOID or raw.endswith("/") and tag not in BLOCK:
                continue
            if tag == "a":
                links += 1
            _, box, dropped, main, suspect = stack[-1]
            dropped = dropped or _is_dropped(tag, attrs, main)
            if attrs and not dropped and not suspect.startswith(STRONG) and (key := _suspect(tag, attrs, main)):
                if tag in BLOCK:  # the outermost one, but adverts and talk before others
                    suspect = key if key.startswith(STRONG) or not suspect else suspect
                elif not main or key.rpartition(".")[2] in ADVERT:  # inside a line there is no vote
                    dropped = True
            if tag in CONTAINER and not dropped:
                step = (self.containers[box][0], _label(tag, attrs))
                if step not in numbers:
                    numbers[step] = len(self.steps)
                    self.steps.append(step)
                self.containers.append((numbers[step], box))
                box = len(self.containers) - 1
            stack.append((tag, box, dropped, main or tag in ("article", "main"), suspect))
            opened[tag] += 1
        close_block()

    def path(self, number: int) -> str:
        """A path as text, from its number."""
        steps = []
        while number > 0:
            number, label = self.steps[number]
            steps.append(label)
        return "".join(f">{s}" for s in reversed(steps))

    def scores(self) -> dict[int, float]:
        """Score of each container path, by its number: characters outside links of its blocks, the full amount where they
        stand directly in it and a part further out (none beyond LEAST_SHARE), more for the elements that name the main
        text."""
        out: dict[int, float] = {}
        for t, box, linked, suspect in self.blocks:
            if suspect:
                continue
            worth = len(t) - 2 * min(linked, len(t))
            share = 1.0
            while box > 0 and share > LEAST_SHARE:
                path, outer = self.containers[box]
                out[path] = out.get(path, 0.0) + worth * share
                share *= 0.75
                box = outer
        return {p: s * (2.0 if re.search(r"(?:article|main)[^>]*$", self.steps[p][1].rpartition(">")[2]) else 1.0) for p, s in out.items() if s > 0}

    def suspects(self) -> dict[str, tuple[int, int, int]]:
        """Of each suspect: characters, those in links, and crc32 of its text on this page."""
        out: dict[str, tuple[int, int, int]] = {}
        for t, _, linked, key in self.blocks:
            if key:
                chars, links, crc = out.get(key, (0, 0, 0))
                out[key] = (chars + len(t), links + min(linked, len(t)), zlib.crc32(t.encode("utf-8", "surrogatepass"), crc))
        return out

    def whole(self) -> int:
        return sum(len(b[0]) for b in self.blocks)

    def own_junk(self) -> set[str]:
        """Suspects that are junk as far as the page alone can tell."""
        whole = self.whole()
        return {k for k, (chars, links, _) in self.suspects().items() if is_junk(k, 1, 1, chars, links, whole)}

    def text_at(self, path: str, junk: set[str] | frozenset = frozenset()) -> str:
        """Blocks inside any container of a path, in page order, without those of junk."""
        ends = [0] * len(self.steps)  # how far a path agrees with the one asked for, -1 if it doesn't
        for i, (before, label) in enumerate(self.steps[1:], 1):
            ends[i] = ends[before] + 1 + len(label) if ends[before] >= 0 and path.startswith(f">{label}", ends[before]) else -1
        inside = [False] * len(self.containers)
        for i, (p, outer) in enumerate(self.containers[1:], 1):
            inside[i] = ends[p] == len(path) or (outer >= 0 and inside[outer])
        return "\n\n".join(t for t, box, _, key in self.blocks if inside[box] and key not in junk)

    def text(self, path: str | None, junk: set[str] | frozenset) -> str:
        """Main text at a path, at the page's own best container where that gives none, or of all blocks that are not
        mostly links where no container has any worth."""
        got = self.text_at(path, junk) if path else ""
        if not got:
            own = self.best()
            if own:
                return self.text_at(own, junk)
            return "\n\n".join(t for t, _, linked, key in self.blocks if linked < len(t) / 2 and key not in junk)
        return got

    def best(self) -> str | None:
        """Path of the page's own best container; ties go to the smaller path."""
        s = self.scores()
        top = max(s.values(), default=0.0)
        return min(self.path(p) for p, v in s.items() if v == top) if s else None


def host_of(url):
    """Host of a url column, lowered; null for none."""
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, junk): the winning container path of every host, null if no page has one, and its suspects that are junk.

    Each page has one vote, shared out by its scores, and tells each of its suspects with the crc32 of its text there.
    Votes are summed before the shuffle and spread by path and text in it, so a host of any size is a few rows of each
    step; keys of suspects come from fixed words and elements, which bounds the list of a host."""

    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told: dict = {}

            def tell(key: tuple, *numbers: int) -> None:
                told[key] = [x + y for x, y in zip(told.get(key, (0, 0, 0, 0)), numbers)]

            for host, source in zip(b["host"], b["html"]):
                page = Page(source)
                scores = page.scores()
                top = max(scores.values(), default=0)
                for p, s in scores.items():
                    if s >= 0.1 * top:
                        tell((host, page.path(p), -1), round(1000 * s / top), 0, 0, 0)
                for key, (chars, links, crc) in page.suspects().items():
                    tell((host, key, crc), 1, chars, links, page.whole())
            columns = {c: pd.Series([k[i] for k in told], dtype=t) for i, (c, t) in enumerate((("host", object), ("path", object), ("crc", "int64")))}
            numbers = {c: pd.Series([v[i] for v in told.values()], dtype="int64") for i, c in enumerate(("n", "chars", "linked", "whole"))}
            yield pd.DataFrame(columns | numbers)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).where("host is not null and html is not null")
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "linked", "whole")]
    by_text = rows.mapInPandas(votes, "host string, path string, crc long, n long, chars long, linked long, whole long").groupBy("host", "path", "crc").agg(*sums)
    by_path = by_text.groupBy("host", "path", (F.col("crc") < 0).alias("box")).agg(*sums, F.count("*").alias("texts")).withColumn("pages", F.col("n"))
    best = F.min_by("path", F.when(F.col("box"), F.struct(-F.col("n"), "path"))).alias("path")
    return by_path.groupBy("host").agg(best, F.sort_array(F.collect_list(F.when(~F.col("box") & junk_here(), F.col("path")))).alias("junk"))


#: Bytes of host paths that are handed to every task, and salts of a host beyond that.
FEW_BYTES, SALTS = 32 << 20, 32


def extract(pages: DataFrame, few_bytes: int = FEW_BYTES) -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars).

    A page without the winning path of its host, and one without a host, is read at its own best container. Elements
    whose names suggest junk are left out if they are junk on the host (see `is_junk`), on a page without a host if they
    are on it.
    A null html is empty, an empty page has an empty text; null ids stay null. Rows are kept as they are, repeated
    ones too; other columns are left out. The table of paths is broadcast while its measured bytes are at most
    `few_bytes`; beyond that pages meet it in a shuffle, those of one host under SALTS keys.
    """
    paths = save(host_paths(pages))
    size = paths.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("path"), F.lit(0)) + F.octet_length(F.array_join("junk", ",")) + 8 * F.size("junk") + 48)).first()[0] or 0

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for source, path, junk in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                page = Page(source)
                texts.append(page.text(path, page.own_junk() if junk is None else set(junk)))
            yield pa.record_batch([b.column(0), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    if size <= few_bytes:
        rows = rows.join(F.broadcast(paths), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = rows.join(salted, ["host", "salt"], "left")
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "path", "junk")
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
