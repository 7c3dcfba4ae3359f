"""Main text of web pages by equivalence classes of page tokens.

Tokens are tags in their place (the path of open elements) and whole blocks of text. Over the pages
of a host each token has an occurrence vector: how often it stands on each page. Tokens with equal
vectors are a class. A class is valid if it is large and frequent enough and holds tags, and it is
nested below the class that encloses it; the nested valid classes are the host's template. What a
page has beyond the template are slots. Slots in the article are extracted; slots that the template
encloses in menus, headers, footers, sidebars, notices, adverts, forms or comments are not.

Vectors are never gathered: a class is told by the number of pages, the number of occurrences and a
pair of sums of 31-bit hashes of (page, occurrences), which is summed up before it is exchanged. So a host
with a third of all pages is a row for each token and task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provender.llm.common import cut, long_texts, text_of

#: A class needs this many pages, this share of its host's pages, and this many tokens.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 10, 0.95, 2
#: Characters of a path that are kept; what is longer ends with a hash.
MAX_PATH = 512
#: Template texts (16 bytes each) up to this number are broadcast; beyond it, joined by host.
BROADCAST_TEXTS = 200_000

# Elements of the language by what they do.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body br center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
CLOSES_PARAGRAPH = BLOCKS - {"body", "br", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES_SAME = frozenset("dd dt li option td th tr".split())
LEFT_OUT = frozenset(
    """aside audio button canvas datalist dialog footer form frameset head iframe input label
    legend math menu nav noframes noscript object optgroup option progress script select style svg
    template textarea title video""".split()
)
ARTICLE = frozenset("article main".split())
# Words in class, id or role that name what is no main text, and what may stand
# before and after them. Other words ("with-sidebar", "no-comments") say something else.
_BEFORE = "article|bottom|entry|global|js|left|main|mobile|page|post|primary|right|secondary|site|sticky|sub|top|user|wp"
_AFTER = r"""area|bar|block|body|box|button|buttons|column|container|content|form|holder|info|inner|item|items|label|law|left|link
    |links|list|message|outer|panel|placeholder|posts|right|row|section|slot|title|top|bottom|unit|wrap|wrapper|zone|\d+"""
_WORDS = r"""(?:ads?|advert[^\W_]*|adsense|alert|banner|breadcrumbs?|comments?|commentlist|consent|contentinfo|cookies?
    |disqus|dropdown|footer|gdpr|header|login|masthead|menus?|modal|nav|navbar|navigation|newsletter
    |notices?|notification|pagination|pager|popup|promos?|promotion|recommended|related|replies|reply
    |discussion|respond|search|share|sharing|sidebar|signup|social|sponsor[^\W_]*|subscribe|teaser|toolbar|widgets?)"""
_NAMED = re.compile(
    # The header of an article is that of its text.
    rf"""(?!(?:article|entry|post)[-_]+header)(?:(?:{_BEFORE})[-_]+)*{_WORDS}(?:[-_]+(?:{_WORDS}|{_AFTER}))*""",
    re.X | re.I,
)
# Words in class, id or role of an article that is a reader's comment.
_COMMENT = re.compile(r"(?:user[-_]+)?(?:comments?|reply|replies)(?:[-_]+(?:body|box|content|entry|inner|item|\d+))*", re.I)
_RAW = "script|style|title|textarea|iframe|noframes|xmp"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    | <(?P<raw>{_RAW})(?=[\s/>])[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)
    | <(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>
    | <[a-z/!?][^>]*(?:>|\Z) | </?\Z""",
    re.X | re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_HOLDS = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)


class Element:
    __slots__ = ("name", "path", "inside", "left_out")

    def __init__(self, name: str, path: str, inside: bool, left_out: bool):
        self.name, self.path, self.inside, self.left_out = name, path, inside, left_out


ROOT = Element("", "", False, False)


def names_of(attributes: str) -> str:
    return " ".join(b or c or d for _, b, c, d in _ATTRIBUTE.findall(attributes)) if attributes else ""


def named(names: str) -> bool:
    """Whether a whole class, id or role names what is no main text."""
    return any(_NAMED.fullmatch(w) for w in names.split())


def comment(names: str) -> bool:
    """Whether a whole class, id or role names a reader's comment."""
    return any(_COMMENT.fullmatch(w) for w in names.split())


def path_below(path: str, step: str) -> str:
    """The path of an element below ``path``. A long one keeps its outer elements and ends with a hash of
    the whole, so that paths take bounded memory however deep elements are nested."""
    whole = f"{path}/{step}"
    if len(whole) <= MAX_PATH:
        return whole
    return f"{path.partition('/#')[0]}/#{xxhash.xxh64_hexdigest(whole)}"


def holders(page: str) -> frozenset[int]:
    """Where the elements open that hold an article or main. Articles that are named as comments,
    teasers and the like do not count for what is around them."""
    found: set[int] = set()
    if not _HOLDS.search(page):
        return frozenset()
    stack, places = [ROOT], [-1]
    for token in _TOKEN.finditer(page):
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:], places[depth:]
            continue
        _close_implied(name, stack)
        del places[len(stack) :]
        if name in ARTICLE and not named(names_of(token["attributes"])):
            # What is around a place that was found before was found with it.
            for place in reversed(places):
                if place in found:
                    break
                found.add(place)
        if name not in VOID and not token["attributes"].endswith("/"):
            stack.append(Element(name, "", False, False))
            places.append(token.start())
    return frozenset(found)


def opened(name: str, attributes: str, parent: Element, holds: bool = False) -> Element:
    """An element below ``parent``: its path, whether it is in an article, and whether it is of
    those parts of a page that are no main text. A name tells that only of an element that neither
    is nor ``holds`` an article or main, and of an article that is a reader's comment and holds no other."""
    names = names_of(attributes)
    left_out = (
        parent.left_out
        or name in LEFT_OUT
        or (name == "header" and not parent.inside)
        or (not holds and name not in ("html", "body", *ARTICLE) and named(names))
        or (not holds and name == "article" and comment(names))
        or bool(attributes and _HIDDEN.search(attributes))
    )
    path = path_below(parent.path, name + (f".{names}" if names else ""))
    return Element(name, path, parent.inside or name in ARTICLE, left_out)


def walk(page: str) -> Iterator[tuple[str, Element | str, Element]]:
    """The tags and texts of a page in order: ("tag" or "end", element, parent), ("text", text, parent)."""
    stack, at, holding = [ROOT], 0, holders(page)
    for token in _TOKEN.finditer(page):
        if token.start() > at:
            yield "text", page[at : token.start()], stack[-1]
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if token["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                closed = stack[depth]
                del stack[depth:]
                yield "end", closed, stack[-1]
            elif name in BLOCKS:
                yield "end", Element(name, stack[-1].path, False, False), stack[-1]
            continue
        _close_implied(name, stack)
        element = opened(name, token["attributes"], stack[-1], token.start() in holding)
        yield "tag", element, stack[-1]
        if name not in VOID and not token["attributes"].endswith("/"):
            stack.append(element)
    if at < len(page):
        yield "text", page[at:], stack[-1]


def _close_implied(name: str, stack: list[Element]) -> None:
    """Elements that an opening tag closes: a paragraph, or one of its own kind in a list or table."""
    target = "p" if name in CLOSES_PARAGRAPH else name if name in CLOSES_SAME else ""
    if not target:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == target:
            del stack[i:]
            return
        if stack[i].name in BLOCKS:
            return


def parts(page: str) -> Iterator[tuple[Element, str | None]]:
    """The opening tags of a page, and between them its blocks with the element that they start in.

    Character references are decoded, and white space in a block is made single spaces.
    """
    gathered: list[str] = []
    at = ROOT
    for kind, what, parent in walk(page):
        if kind == "text":
            if gathered and (parent.inside, parent.left_out) != (at.inside, at.left_out):
                if text := joined(gathered):
                    yield at, text
                gathered.clear()
            if not gathered:
                at = parent
            gathered.append(html.unescape(what))
            continue
        if what.name in BLOCKS:
            if text := joined(gathered):
                yield at, text
            gathered.clear()
        if kind == "tag":
            yield what, None
    if text := joined(gathered):
        yield at, text


def joined(texts: list[str]) -> str:
    return " ".join("".join(texts).split())


def block_token(at: Element, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{at.path}|{text}") - (1 << 63)


def tokens(page: str) -> Counter:
    """Occurrences of each token of a page: (hash, is tag, path)."""
    found: Counter = Counter()
    for element, text in parts(page):
        if text is None:
            found[xxhash.xxh64_intdigest(element.path) - (1 << 63), True, element.path] += 1
        else:
            found[block_token(element, text), False, element.path] += 1
    return found


def occurrence_sums(pages: DataFrame) -> DataFrame:
    """``host, token, is_tag, path, pages, total, s1, s2``: for each token of a host what tells its
    occurrence vector. ``pages`` has ``host`` and ``html``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, page in zip(batch["host"], batch["html"], strict=True):
                seen = xxhash.xxh64_intdigest(page)
                for (token, is_tag, path), n in tokens(page).items():
                    row = sums.setdefault((host, token, is_tag, path), [0, 0, 0, 0])
                    mark = xxhash.xxh128_intdigest(f"{seen}:{n}")
                    row[0] += 1
                    row[1] += n
                    row[2] += mark & 0x7FFFFFFF  # sums of 31 bits cannot overflow a long
                    row[3] += mark >> 31 & 0x7FFFFFFF
                # Texts of one page are never in a template, so a batch may go out in parts.
                if len(sums) > 200_000:
                    yield _sums(sums)
                    sums = {}
            yield _sums(sums)

    schema = "host string, token long, is_tag boolean, path string, pages long, total long, s1 long, s2 long"
    read = pages.mapInPandas(counted, schema)
    return read.groupBy("host", "token").agg(
        F.first("is_tag").alias("is_tag"), F.min("path").alias("path"),
        *[F.sum(c).alias(c) for c in ("pages", "total", "s1", "s2")],
    )


def _sums(sums: dict) -> pd.DataFrame:
    names = ["host", "token", "is_tag", "path", "pages", "total", "s1", "s2"]
    return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=names)


def templates(pages: DataFrame) -> DataFrame:
    """``host, token, is_tag, path, class, below``: the tokens of each host's template with the
    number of their class and of that which encloses it (null for the outermost)."""
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_PAGES)
    frequent = occurrence_sums(pages).join(sizes, "host").where(
        (F.col("pages") >= MIN_PAGES) & (F.col("pages") >= F.col("size") * MIN_SHARE)
    )

    def nested(rows: pd.DataFrame) -> pd.DataFrame:
        """A host's frequent tokens; at most as many as its pages have on average."""
        classes = []
        for _, members in rows.groupby(["pages", "total", "s1", "s2"], sort=True):
            if len(members) >= MIN_TOKENS and members["is_tag"].any():
                classes.append(members)
        classes.sort(key=lambda c: (c["path"].str.len().min(), -int(c["total"].iloc[0])))
        out, tags = [], []
        for number, members in enumerate(classes):
            paths = list(members["path"])
            around = [
                (len(p), other) for other, own in tags for p in own
                if all(q == p or q.startswith(p + "/") for q in paths)
            ]
            below = max(around)[1] if around else None
            # Tokens without an enclosing class have to be the outermost ones.
            if below is None and tags:
                continue
            tags.append((number, list(members.loc[members["is_tag"], "path"])))
            out.append(members.assign(**{"class": number, "below": below}))
        names = ["host", "token", "is_tag", "path", "class", "below"]
        if not out:
            return pd.DataFrame(columns=names)
        found = pd.concat(out)[names]
        return found.assign(below=found["below"].astype("Int32"))

    schema = "host string, token long, is_tag boolean, path string, class int, below int"
    return frequent.groupBy("host").applyInPandas(nested, schema)


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The text of the slots in the article (in the page, if it has none), one block a line.

    Where the template would take most of the text, the host's pages are copies of one article and
    not different ones in one frame. Then what they share is kept.
    """
    whole = _slots(page, frozenset())
    if not template:
        return whole
    rest = _slots(page, template)
    return rest if 2 * len(rest) >= len(whole) else whole


def _slots(page: str, template: frozenset[int]) -> str:
    article, other = [], []
    for element, text in parts(page):
        if text is None or element.left_out or block_token(element, text) in template:
            continue
        (article if element.inside else other).append(text)
    return "\n".join(article or other)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text, n_chars``, a row for each row of ``df``.

    A null page is an empty one and has an empty text. Pages without a host are pages of the host
    "". Null ids and repeated rows stay (equal pages count once each in the vectors); other columns
    are not looked at; an empty table gives no rows. Whole pages are read, twice; they are
    exchanged only if the templates' texts are too many to broadcast.
    """
    long_texts(df.sparkSession)
    pages = df.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"),
        text_of(html_col).alias("html"),
    )
    texts = cut(
        templates(pages.select("host", "html")).where("not is_tag").groupBy("host").agg(F.collect_set("token").alias("template"))
    )
    size = texts.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(texts) if size <= BROADCAST_TEXTS else texts, "host", "left")

    @F.pandas_udf("string")
    def extracted(pages: pd.Series, fixed: pd.Series) -> pd.Series:
        none: frozenset[int] = frozenset()
        return pd.Series(
            [main_text(p, none if t is None else frozenset(t)) for p, t in zip(pages, fixed, strict=True)],
            dtype="object",
        )

    return joined.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), extracted("html", "template").alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
