"""HTML extraction by template deduction from equivalence classes.

The tokens of a page are its opening tags, each under its path, and its text nodes. Over the different pages of a
host, a token's occurrence vector says how often it is on each page; tokens with the same vector form an
equivalence class. Vectors are compared by a sum of page hashes times counts, so they are summed where the pages
are and never laid out. Classes on at least half of a host's pages, and two of them, are valid. Copies of a page count as one: each is weighed by one over their number. Each is parted by
the gaps of the class around it, so that classes nest: together they are the template. What its tokens leave
between them are slots.

The main slot is that of an article element of the template, or else of the innermost of the template's elements
that holds most of the text in slots; articles beside it in the same element belong to it. A page's text is what stands in its main slot and is not the template's: a
text node of a class goes where the class's tokens come in the template's order on that page, if the class has elements as well. Inside an article,
whose paragraphs may well be said on many pages, only those nodes go whose element holds the same words on each
page that has it (text and element are of one class), and never the page's title. Parts that are not the article's
own by HTML's elements (menus, forms, footers and so on) go as well.

Class names alone drop nothing. A name is plain if all its words are of a list of such parts ("advert", "comment-list"), and vague if only
one of them is ("share-price"). A named part goes if at least half of its text is links; if its name is plain and it is a
container, or its element is of a class of the template; and outside of articles if its name is vague and its element is of a class.

Vectors over a single page tell nothing, so a host with one page has no template; its page is taken by its own elements.

Defined results: a null or empty page has an empty text; a page without a host is taken alone; pages
of a host with equal html count as one; a page of whose main slot all but the title would be the template's keeps it;
columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import materialise

#: A token on fewer pages is of no class.
LEAST = 2
FEW_CONTENTS = 1_000_000
#: Tokens of all templates that are broadcast, 12 bytes each; beyond that, pages go to their templates by host and salt.
FEW_TOKENS = 1_000_000
SALTS = 64
SHARE = 0.5
#: The main slot holds at least this share of the text of the slot around it.
MOST = 0.8

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noembed noframes xmp template".split())
ASIDE = frozenset("head nav footer aside form script style noscript iframe svg math canvas object button select textarea dialog menu template noembed noframes xmp audio video map fieldset datalist title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot option legend summary".split())
SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPE = frozenset("html body article main section div nav aside header footer form ul ol dl table td th blockquote figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
# Words in class and id names of parts that are not the article's own; the second kind unless a word of the third is there as well.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising advertorial adsense adslot adbox sponsor sponsored sponsors promo promos promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars comment comments commentlist disqus replies respond cookie cookies consent gdpr newsletter subscribe subscription signup login popup modal overlay footer masthead pagination pager share sharing sharebar social related recommended recommendations copyright skiplink toolbar paywall banner banners".split())
UNLESS = frozenset("header notice notices alert alerts side aside form search widget widgets links tags meta legal disclaimer".split())
CONTENT = frozenset("article content main post entry story body text".split())
# Words that leave a name plain, and elements that hold blocks.
NEUTRAL = frozenset("a area articles bar block bottom box button buttons center column container first footer form header holder inner inline item items label large last left links list mobile module outer panel row section slot small space the thread title top unit right widget wrap wrapper".split())
CONTAINER = frozenset("div section ul ol dl table figure details fieldset center".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
WHITE = re.compile(r"\s+")


def _attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(said):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


#: What an element's class and id say of it: nothing, a vague name, a plain one.
UNNAMED, VAGUE, PLAIN = 0, 1, 2


def _apart(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element is not the article's own text by HTML itself."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ROLES:
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def named(tag: str, attributes: dict[str, str]) -> int:
    """How an element is named as a part that is not the article's."""
    if tag in ("html", "body", "main", "article"):
        return UNNAMED
    out = UNNAMED
    for name in (n for a in ("class", "id") for n in attributes.get(a, "").split()):
        words = {w.lower() for w in WORD.findall(name)}
        sure = words & NEVER
        if sure or (words & UNLESS and not words & CONTENT):
            out = max(out, PLAIN if words <= NEVER | UNLESS | NEUTRAL else VAGUE)
    return out


def key(said: str) -> int:
    return xxhash.xxh64_intdigest(said.encode(), 7) >> 1


class Page:
    """A page's tokens and blocks. tags: (path key, path, position, text length inside); texts: (key, path, position, length), both without parts that are not the article's."""

    def __init__(self, source: str):
        self.tags: list[list] = []
        self.texts: list[list] = []
        #: by element, as in tags: the element around it, whether HTML sets it apart, its name, whether it is in an article, characters of all its text and of links in it
        self.about: list[list] = []
        #: (text, places of the open elements, keys of its text nodes, whether in an article)
        self.blocks: list[tuple[str, tuple[int, ...], tuple[int, ...], bool]] = []
        self.inside: list[tuple[int, ...]] = []  # of each text: places of its open elements
        self.title = ""
        self.opened: list[tuple[str, str, int]] = []  # tag, path, place in tags
        self.around: tuple[int, ...] | None = ()  # their places, until one is opened or closed
        self.articles = 0
        self.suspects: list[int] = []  # places of elements that HTML sets apart or that are named
        self.run: list[str] = []
        self.nodes: list[int] = []
        self.position = 0
        self.parse(source)
        gone = self.gone = self.dropped(frozenset())
        tags = self.tags
        for said, places, *_ in self.blocks:
            if not gone or gone.isdisjoint(places):
                for place in places:
                    tags[place][3] += len(said)
        if gone:
            for entry, places in zip(self.texts, self.inside, strict=True):
                if not gone.isdisjoint(places):
                    entry[3] = 0

    def dropped(self, classed: frozenset[int] | set[int]) -> set[int]:
        """Places of the elements that are not the article's own; `classed`: keys of the elements of the template."""
        out = set()
        for place in self.suspects:
            token, path, _, _ = self.tags[place]
            _, apart, name, in_article, chars, linked = self.about[place]
            if apart:
                out.add(place)
            elif name and chars:
                plain = name == PLAIN and (_name(path) in CONTAINER or token in classed)
                vague = not in_article and token in classed
                if 2 * linked >= chars or plain or vague:
                    out.add(place)
        return out

    def parse(self, source: str) -> None:
        at = 0
        while True:
            found = TOKEN.search(source, at)
            self.text(source[at : found.start()] if found else source[at:])
            if not found:
                break
            at = found.end()
            if found[2] is None:
                if found[0].startswith("<![CDATA["):
                    self.text(found[0][9:].removesuffix("]]>"), raw=True)
                continue
            tag = found[2].lower()
            if found[1]:
                self.close(tag)
                continue
            self.open(tag, found[3])
            if tag in RAW or tag in ("title", "textarea"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if tag == "title":
                    said = source[at : end.start() if end else len(source)]
                    self.title = self.title or WHITE.sub(" ", html.unescape(said)).strip()
                    self.text(said)
                at = end.end() if end else len(source)
                self.close(tag)
        self.flush()

    def text(self, said: str, raw: bool = False) -> None:
        if not said:
            return
        self.run.append(said if raw or "&" not in said else html.unescape(said))
        words = said.split()
        if words:
            path = self.opened[-1][1] if self.opened else ""
            node = key(path + "\0" + " ".join(words))
            self.nodes.append(node)
            self.texts.append([node, path, self.position, len(said)])
            self.inside.append(self.places())
            self.position += 1
            if self.suspects:
                named = [x[2] for x in self.opened if self.about[x[2]][2]]
                if named:
                    length = sum(map(len, words))
                    linked = length if any(x[0] == "a" for x in self.opened) else 0
                    for place in named:
                        self.about[place][4] += length
                        self.about[place][5] += linked

    def places(self) -> tuple[int, ...]:
        if self.around is None:
            self.around = tuple(x[2] for x in self.opened)
        return self.around

    def flush(self) -> None:
        said = WHITE.sub(" ", "".join(self.run)).strip() if self.run else ""
        if said:
            self.blocks.append((said, self.places(), tuple(self.nodes), self.articles > 0))
        self.run, self.nodes = [], []

    def open(self, tag: str, said: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.run.append(" ")
        if tag in CLOSES_P:
            self.close("p", SCOPE)
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self.close(other, SCOPE - {"td", "th"} if tag == "tr" else SCOPE)
        if tag in VOID:
            return
        attributes = _attributes(said) if said.strip(" /") else {}
        names = ".".join(sorted(attributes.get("class", "").split()))
        path = f"{self.opened[-1][1] if self.opened else ''}>{tag}{'.' + names if names else ''}"
        in_article = self.articles > 0
        apart, name = _apart(tag, attributes, in_article), named(tag, attributes) if attributes else UNNAMED
        if apart or name:
            self.suspects.append(len(self.tags))
        self.about.append([self.opened[-1][2] if self.opened else -1, apart, name, in_article, 0, 0])
        self.opened.append((tag, path, len(self.tags)))
        self.articles += tag == "article"
        self.around = None
        self.tags.append([key(path), path, self.position, 0])
        self.position += 1
        if said.rstrip().endswith("/") and tag in ("svg", "path", "use", "circle", "rect"):
            self.opened.pop()
            self.around = None

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of that name; not past an element of `within`."""
        for i in range(len(self.opened) - 1, -1, -1):
            if self.opened[i][0] == tag:
                if any(x[0] in BLOCK for x in self.opened[i:]):
                    self.flush()
                self.articles -= sum(x[0] == "article" for x in self.opened[i:])
                del self.opened[i:]
                self.around = None
                return
            if self.opened[i][0] in within:
                return

    def main(self, anchor: int | None) -> set[int]:
        """The places in tags of the elements that hold the text: of the anchor's path, else an article, a main element or the body; with an article, those beside it."""
        for wanted in (lambda t: t[0] == anchor, lambda t: _name(t[1]) == "article", lambda t: _name(t[1]) == "main", lambda t: _name(t[1]) == "body"):
            found = [i for i, t in enumerate(self.tags) if wanted(t) and i not in self.gone and t[3]]
            if found:
                root = max(found, key=lambda i: (self.tags[i][3], -i))
                if _name(self.tags[root][1]) != "article":
                    return {root}
                around = self.about[root][0]
                return {i for i, t in enumerate(self.tags) if self.about[i][0] == around and _name(t[1]) == "article"}
        return set()

    def said_by(self, classes: list[dict]) -> tuple[set[int], set[int]]:
        """The text nodes of the template, and those of them that their elements hold on every page; of classes that come in the template's order here."""
        place: dict[int, int] = {}
        for node, at in (*((t[0], t[2]) for t in self.tags), *((t[0], t[2]) for t in self.texts)):
            place.setdefault(node, at)
        fixed, sure = set(), set()
        for c in classes:
            if all(kind == TEXT for kind in c["kinds"]):
                continue  # words that come together without an element of their own: pages that say the same, not a template
            order = [place[t] for t in c["tokens"] if t in place]
            if order == sorted(order):
                fixed |= {t for t, kind in zip(c["tokens"], c["kinds"], strict=True) if kind != TAG}
                sure |= {t for t, kind in zip(c["tokens"], c["kinds"], strict=True) if kind == HELD}
        return fixed, sure

    def extract(self, anchor: int | None, classes: list[dict] | None = None, classed: list[int] | None = None) -> str:
        """The main element's blocks, without parts that are not its own and text nodes of the template; `classed`: keys of its named elements."""
        roots = self.main(anchor)
        gone = self.dropped(set(classed)) if classed else self.gone
        kept = [b for b in self.blocks if gone.isdisjoint(b[1]) and (not roots or not roots.isdisjoint(b[1]))]
        fixed, sure = self.said_by(classes or [])
        own = [b for b in kept if b[0] == self.title or not b[2] or not set(b[2]) <= (sure if b[3] else fixed)]
        return "\n".join(b[0] for b in (own if any(b[0] != self.title for b in own) else kept))


def _name(path: str) -> str:
    return path.rpartition(">")[2].partition(".")[0]


#: Kinds of a class's tokens: a tag; a text node; a text node of one class with its element.
TAG, TEXT, HELD = 0, 1, 2
TOKEN_SCHEMA = "host string, token long, text boolean, path string, vector long, pages double, times double, position double, chars double"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pages of a batch, by host and token. A text node has the path of its element."""
    for batch in batches:
        sums: dict[tuple, list] = {}
        for content, host, source, share in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen: dict[tuple, list] = {}
            parsed = Page(source)
            for text, tokens in ((False, parsed.tags), (True, parsed.texts)):
                for k, path, position, chars in tokens:
                    entry = seen.setdefault((host, k, text, path), [0, position, 0])
                    entry[0] += 1
                    entry[2] += chars
            # by content, so copies add to the vectors of all their tokens alike
            weight = xxhash.xxh64_intdigest(str(content).encode(), 11)
            for at, (times, position, chars) in seen.items():
                entry = sums.setdefault(at, [0, 0.0, 0.0, 0.0, 0.0])
                entry[0] = (entry[0] + weight * times) & 0xFFFFFFFFFF
                entry[1] += share
                entry[2] += share * times
                entry[3] += share * position
                entry[4] += share * chars
        rows = [(*at, *entry) for at, entry in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=[x.split()[0] for x in TOKEN_SCHEMA.split(", ")])


CLASS_SCHEMA = "host string, class int, parent int, pages long, tokens array<long>, kinds array<int>, paths array<string>, main long, named array<long>"


def nested(groups: list[pd.DataFrame]) -> list[tuple[pd.DataFrame, int]]:
    """Classes (tokens with their places, in order) -> those, parted by the gaps of the class around them, each with the number of that one or -1.

    The wider class, by pages and then by where it begins, is the one around.
    """
    out: list[tuple[pd.DataFrame, int]] = []
    for g in sorted(groups, key=lambda g: (-int(g["pages"].iloc[0]), float(g["place"].iloc[0]), int(g["token"].iloc[0]))):
        parts = [(g, -1)]
        for number in range(len(out)):
            around = out[number][0]["place"].to_numpy()
            fresh = []
            for part, parent in parts:
                place = part["place"].to_numpy()
                gap = np.searchsorted(around, place, "right")
                inside = out[number][1] == parent and around[0] <= place[0] and place[-1] <= around[-1]
                if inside:
                    fresh += [(part[gap == k], number) for k in np.unique(gap)]
                else:
                    fresh.append((part, parent))
            parts = fresh
        out += parts
    return out


def _nest(rows: pd.DataFrame) -> pd.DataFrame:
    """The valid classes of a host, each with the class whose gap it lies in, and the main slot's token."""
    host = rows["host"].iloc[0]
    groups = [g.sort_values(["place", "token"]) for _, g in rows.groupby(["vector", "pages", "times"], sort=True)]
    classes = nested(groups)
    of = {(path, v, p, t) for path, text, v, p, t in zip(rows["path"], rows["text"], rows["vector"], rows["pages"], rows["times"], strict=True) if not text}
    texts = rows[rows["text"]]
    said: dict[str, int] = {}
    for path, chars in zip(texts["path"], texts["chars"], strict=True):
        said[path] = said.get(path, 0) + int(chars)
    tags = rows[~rows["text"] & (rows["pages"] == rows["times"])].sort_values(["place", "token"])
    # what the template's own words leave of an element's text is in slots
    slots = {t: int(c) - sum(n for p, n in said.items() if p == path or p.startswith(path + ">")) for t, path, c in zip(tags["token"], tags["path"], tags["chars"], strict=True)}
    slots = {t: n for t, n in slots.items() if n > 0}
    name = dict(zip(tags["token"], tags["path"], strict=True))
    place = dict(zip(tags["token"], tags["place"], strict=True))
    articles = [t for t in slots if _name(name[t]) == "article"]
    main = max(articles, key=lambda t: (slots[t], -place[t])) if articles else None
    if main is None and slots:
        main = min(slots, key=lambda t: (-slots[t], place[t]))
        while True:
            inside = [t for t in slots if name[t].startswith(name[main] + ">") and slots[t] >= MOST * slots[main]]
            if not inside:
                break
            main = min(inside, key=lambda t: (place[t], t))
    out = []
    for number, (g, parent) in enumerate(classes):
        kinds = [TAG if not text else HELD if (path, v, p, t) in of else TEXT for text, path, v, p, t in zip(g["text"], g["path"], g["vector"], g["pages"], g["times"], strict=True)]
        suspects = [t for t, path, kind in zip(g["token"], g["path"], kinds, strict=True) if kind == TAG and "." in path.rpartition(">")[2] and named(_name(path), {"class": path.rpartition(">")[2].partition(".")[2].replace(".", " ")})]
        out.append((host, number, parent, int(g["pages"].iloc[0]), g["token"].tolist(), kinds, g["path"].tolist(), main, suspects))
    return pd.DataFrame(out, columns=[x.split()[0] for x in CLASS_SCHEMA.split(", ")]).astype({"main": "Int64"})


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.select("page_id", "url", "html", F.when(host != "", host).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """The classes of each host's template. A host's rows are as many as its pages have tokens on half of them, not more."""
    hosted = with_host(pages).filter(F.col("host").isNotNull() & (F.length("html") > 0)).select("host", F.xxhash64("html").alias("content"), "html")
    contents = materialise(hosted.groupBy("host", "content").agg(F.count("*").alias("copies")), "template-contents")
    copied = contents.filter("copies > 1")
    # contents that are there more than once: broadcast where they are few, joined by a shuffle beyond
    copied = F.broadcast(copied) if copied.count() <= FEW_CONTENTS else copied
    weighed = hosted.join(copied, ["host", "content"], "left").select("content", "host", "html", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("share"))
    sums = (F.round(F.sum(x)).cast("long").alias(x) for x in ("pages", "times", "chars"))
    tokens = weighed.mapInArrow(_tokens, TOKEN_SCHEMA).groupBy("host", "token", "text", "path").agg(F.expr("sum(vector) % 1099511627776L").alias("vector"), *sums, F.sum("position").alias("position"))
    count = contents.groupBy("host").agg(F.count("*").alias("host_pages"))
    wide = tokens.filter(F.col("pages") >= LEAST).join(count, "host").filter(F.col("pages") >= SHARE * F.col("host_pages"))
    return wide.withColumn("place", F.col("position") / F.col("pages")).groupBy("host").applyInPandas(_nest, CLASS_SCHEMA)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    classes = materialise(templates(pages), "templates")
    # of a template: its main slot, the classes that have words, and elements with the name of a part that is not the article's
    words = F.expr("filter(collect_list(struct(tokens, kinds)), c -> exists(c.kinds, k -> k > 0))")
    each = classes.groupBy("host").agg(F.first("main").alias("main"), words.alias("classes"), F.flatten(F.collect_list("named")).alias("named"), F.sum(F.size("tokens")).alias("held"))
    each = materialise(each, "template-slots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = []
                for source, main, classes, classed in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                    texts.append(Page(source).extract(main, classes, classed) if source else "")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    hosted, each = with_host(pages), each.select("host", "main", "classes", "named", "held")
    if (each.agg(F.sum("held")).first()[0] or 0) <= FEW_TOKENS:
        joined = hosted.join(F.broadcast(each), "host", "left")
    else:
        # pages of a host are dealt to SALTS tasks, each with the host's template
        salted = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "main", "classes", "named")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
