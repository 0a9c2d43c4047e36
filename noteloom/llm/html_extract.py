"""Main text of web pages by paths that a host's pages agree on (operator 3)."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import join_one, released, stash

#: Up to so many hosts their winning paths are broadcast; beyond, they are joined by shuffling.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe svg math object select xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never part of an article.
BOILER_TAGS = frozenset("nav footer aside form button dialog menu fieldset head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|notification|alerts?|side-?bars?|"
    r"menus?|nav(?:bar|igation)?s?|footers?|masthead|site-header|page-header|topbar|comments?|commentlist|disqus|replies|respond|share|sharing|social|related|recommended|widgets?|"
    r"popups?|modal|overlay|newsletter|subscri(?:be|ption)|signup|login|search|breadcrumbs?|pagination|pager|toolbar|skip-link|copyright)(?=$|[\s_-])",
    re.I,
)
#: Parts of class names that tell of a layout with or without something, not of the element itself.
LAYOUT_WORDS = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|not|with|without)[_-]\S*", re.I)
#: Elements and roles that stay out even of a page whose text all lies in boilerplate.
NEVER_TAGS = BOILER_TAGS - {"form", "fieldset"}
NEVER_ROLES = BOILER_ROLES - {"form", "search"}
CONTAINERS = frozenset("article main section div td body center blockquote ul ol table tbody tr dl".split())
#: Elements whose own text is likely an article's; text of others is from so many characters on.
TEXT_TAGS, LONG_TEXT = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd figcaption td".split()), 80
#: What an opening tag ends where it is left open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
_SCOPE = frozenset("table ul ol dl div section article main aside nav header footer form body td th blockquote".split())


def _named(names: str) -> bool:
    return bool(BOILER_WORDS.search(LAYOUT_WORDS.sub("", names)))


class Page:
    """Elements and text blocks of a page, in page order; tolerant of what is left open or cut off. Where all text would
    be boilerplate by class, id, hidden, form or header, only what lies in NEVER_TAGS and NEVER_ROLES is."""

    def __init__(self, source: str | None):
        self.parent: list[int] = [-1]
        self.tag: list[str] = [""]
        self.path: list[str] = [""]
        self.boiler: list[bool] = [False]
        self.never: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        if source:
            self._parse(source)
            if all(self.boiler[n] for n, _, _ in self.blocks):
                self.boiler = self.never

    def _parse(self, source: str) -> None:
        stack, buffer, owner, at, end = [0], [], 0, 0, len(source)
        links, in_link = 0, 0

        def flush() -> None:
            nonlocal links
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    self.blocks.append((owner, text, min(links, len(text))))
                buffer.clear()
            links = 0

        def close(upto: int) -> None:
            nonlocal owner
            flush()
            del stack[upto:]
            owner = stack[-1]

        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                piece = source[at:stop]
                buffer.append(html.unescape(piece))  # a reference does not run on across a tag
                if in_link:
                    links += len(piece.strip())
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if m[1] else 1
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in RAW and not m[1]:
                if not m[3].endswith("/"):
                    shut = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = shut.end() if shut else end
                continue
            if tag in VOID:
                flush()
                continue
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        close(k)
                        break
                    if tag in ("p", "li") and self.tag[stack[k]] in _SCOPE:
                        break
                flush()
                continue
            flush()
            in_link = 0
            ends = ENDS.get(tag, ())
            k = len(stack) - 1
            while k > 0 and (self.tag[stack[k]] in ends or self.tag[stack[k]] == "p" or self.tag[stack[k]] not in _SCOPE and ends):
                if self.tag[stack[k]] in ends or self.tag[stack[k]] == "p":
                    close(k)
                k -= 1
            if m[3].endswith("/") and m[3].strip() == "/":
                continue
            classes, ident, role, hidden = "", "", "", False
            if m[3]:
                for a in _ATTR.finditer(m[3]):
                    v = a[2] or a[3] or a[4] or ""
                    key = a[1].lower()
                    if key == "class":
                        classes = v
                    elif key == "id":
                        ident = v
                    elif key == "role":
                        role = v
                    elif key == "hidden":
                        hidden = True
            up = stack[-1]
            general = _DIGITS.sub("#", ".".join([tag, *sorted(classes.split())]))
            in_article = any(self.tag[x] in ("article", "main") for x in stack)
            bad = tag in BOILER_TAGS or tag == "header" and not in_article or role.lower() in BOILER_ROLES or hidden or tag not in ("body", "html", "article", "main") and (_named(classes) or _named(ident))
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(f"{self.path[up]}>{general}" if self.path[up] else general)
            self.boiler.append(self.boiler[up] or bad)
            self.never.append(self.never[up] or tag in NEVER_TAGS or role.lower() in NEVER_ROLES)
            owner = len(self.tag) - 1
            stack.append(owner)
        flush()

    def scores(self) -> dict[int, float]:
        """What each container gets from the text blocks below it: all of it, halved for each container between."""
        out: dict[int, float] = {}
        for node, text, links in self.blocks:
            if self.boiler[node]:
                continue
            worth, x = (len(text) - links) * (1 - links / len(text)), node
            if self.tag[x] not in TEXT_TAGS:
                worth *= 0.7
            while x > 0 and worth >= 1:
                if self.tag[x] in CONTAINERS:
                    out[x] = out.get(x, 0.0) + worth * (1.2 if self.tag[x] in ("article", "main") else 1.0)
                    worth *= 0.5
                x = self.parent[x]
        return out

    def best(self) -> str | None:
        s = self.scores()
        return self.path[max(s, key=lambda k: (s[k], -k))] if s else None

    def whole(self, chosen: list[bool]) -> set[int]:
        """The chosen elements, each widened to its nearest article or main; without one, to each ancestor in turn as
        long as what that adds is mostly text like an article's."""
        added: dict[int, list[int]] = {}  # characters below each element that are not chosen, and those like an article's
        for node, text, links in self.blocks:
            if self.boiler[node] or chosen[node]:
                continue
            fits, x = 2 * links < len(text) and (self.tag[node] in TEXT_TAGS or len(text) >= LONG_TEXT), node
            while x > 0:
                s = added.setdefault(x, [0, 0])
                s[0] += len(text)
                s[1] += len(text) * fits
                x = self.parent[x]
        tops, seen = set(), set()
        for x in range(1, len(self.tag)):
            if not chosen[x] or chosen[self.parent[x]]:
                continue
            up = x
            while up > 0 and self.tag[up] not in ("article", "main"):
                up = self.parent[up]
            if up > 0:
                tops.add(up)
                continue
            top = x
            while (up := self.parent[top]) > 0 and up not in seen:
                (n, fits), (m, had) = added.get(up, (0, 0)), added.get(top, (0, 0))
                if 2 * (fits - had) < n - m:
                    break
                seen.add(up)
                top = up
            tops.add(top)
        return tops

    def text(self, path: str | None) -> str:
        """Blocks of the whole article around the elements of that path, boilerplate left out; without such, around the page's best container, then all."""
        for p in dict.fromkeys([path, self.best()]):
            if p is not None:
                chosen = [q == p for q in self.path]
                for i in range(1, len(chosen)):
                    chosen[i] = chosen[i] or chosen[self.parent[i]]
                if not any(chosen[n] and not self.boiler[n] for n, _, _ in self.blocks):
                    continue
                tops = self.whole(chosen)
                for i in range(1, len(chosen)):
                    chosen[i] = i in tops or chosen[i] or chosen[self.parent[i]]
                return " ".join(t for n, t, _ in self.blocks if chosen[n] and not self.boiler[n])
        return " ".join(t for n, t, _ in self.blocks if not self.boiler[n])


def host_column(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[tuple[str, str], float] = {}
        pages: Counter = Counter()
        for host, source in zip(b.column(0).to_pylist(), b.column(1)):
            if host:
                pages[host] += 1
                page = Page(source.as_py())
                s = page.scores()
                if s:
                    k = max(s, key=lambda k: (s[k], -k))
                    key = (host, page.path[k])
                    sums[key] = sums.get(key, 0.0) + math.log1p(s[k])
        rows = [(h, p, round(v * 1000), 0) for (h, p), v in sums.items()] + [(h, None, None, n) for h, n in pages.items()]
        kinds = (("host", pa.string()), ("path", pa.string()), ("votes", pa.int64()), ("pages", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, from the element path that the pages of its host agree on: all of the article around it.

    Returns one row per input row: id, url, text (never null), n_chars (its code points). A null or empty page
    gives an empty text. Pages without a host use their own best container, as does a page without the winning
    path. Ties of votes go to the smaller path. Null ids and repeated rows are rows like any other (repeated rows
    vote as often); other columns are ignored; an empty table gives no rows. Votes are summed for each batch before
    the shuffle, so a host with a third of all pages is as many rows as it has paths.
    """
    rows = df.select(F.col(id_col), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("_host", host_column(F.col("_url")))
    votes = rows.select(F.col("_host").alias("host"), F.col("_html").alias("html")).mapInArrow(released(_votes), "host string, path string, votes long, pages long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("pages").alias("pages"))
    best = F.min(F.when(F.col("path").isNotNull(), F.struct((-F.col("votes")).alias("v"), "path")))
    won = votes.groupBy("host").agg(best.alias("x"), F.sum("pages").alias("_n")).select(F.col("host").alias("_host"), F.col("x.path").alias("_path"), "_n")
    won = stash(won, "op3-paths")
    blank = rows.where("_host = ''").withColumn("_path", F.lit(None).cast("string"))
    rows = join_one(rows.where("_host <> ''"), won, "_host", "_n", keys=BROADCAST_HOSTS, hot=0).unionByName(blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py()).text(p.as_py()) for h, p in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[b.schema.names[0], "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "_url", "_html", "_path").mapInArrow(released(run), f"`{id_col}` {kind}, url string, text string, n_chars long")
