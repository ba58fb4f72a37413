"""Operator 12, HTML extraction: the main text of web pages by shallow features of flat text blocks and a decision tree.

A page is cut into flat blocks of text at its block-level tags. Each block has its number of words and its link density
(the share of its words inside links), the same of the block before and of the block after it, the kind of its tag and
the region of the page it stands in (main text, boilerplate, neither). A decision tree, trained by Spark on the blocks of
a small table of labelled pages (PAGES), says which blocks are main text. Cutting blocks is a small helper in Python over
Arrow batches; features of neighbours, the tree (as one expression) and the text are put together in the JVM, in the
page's own row, so pages are neither exploded nor shuffled.

Defined cases: null html counts as empty and gives empty text; scripts, styles, comments, hidden elements and what else is
never shown are not blocks; a tag or comment that the page's end cuts off is markup, and elements that are never closed
end with the element around them; white space is what str.split() takes for it, also from references (&nbsp;); pages are
judged row by row, so ties, repeated rows and null ids or urls change nothing for each other; an empty table gives an
empty result; pages are whole, however long; further columns are carried, but those named like one of the new ones (NEW)
give way to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

NEW = ("text", "n_chars")
BLOCKS = "array<struct<text:string,words:double,links:double,kind:double,region:double>>"
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "kind", "region")
DEPTH = 8

# Elements of HTML by what they are to a reader.
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "noscript", "template", "svg", "select", "button", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KINDS = {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "figcaption": 1.0} | dict.fromkeys(HEADINGS, 2.0) | {"li": 3.0, "dd": 3.0, "dt": 3.0, "td": 3.0, "th": 3.0}
# Words in classes, ids and roles that name parts of a page beside its main text, and names of its main text.
BESIDE = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices notification alert popup modal dialog overlay newsletter subscribe subscription signup login register nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar aside complementary widget widgets related recommended recommendations trending popular share sharing social footer contentinfo masthead topbar toolbar copyright comment comments reply replies respond disqus discussion search skip".split())
MAIN = set("articlebody articlecontent articletext postbody postcontent entrycontent storybody storycontent maincontent".split())
STATES = set("has with without no hide open closed enabled disabled count on off".split())
#: Headings that begin comments or links to other pages; what follows in the same element is beside the main text.
ENDS = re.compile(r"(\d+\s+)?(reader |user )?(comments?|responses?|replies|leave a (comment|reply)|related( \w+)?|read more|more (stories|articles|posts)|recommended( for you)?|share this( \w+)?|kommentare?|commentaires?|comentarios?)(\s*\(\d+\))?:?", re.I)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<told>(?:[^\"'>]++|\"[^\"<]*+\"|'[^'<]*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|href|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""", re.I)
CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")
NEITHER, IN_MAIN, IN_BESIDE, IN_FORM, IN_HEADER = 0, 1, 2, 3, 4


def _attributes(told: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(told)} if "=" in told or "hidden" in told else {}


def _names(told: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element's class, id or role names something beside the main text, and whether it names the main text."""
    beside = main = False
    for token in " ".join(told.get(k, "") for k in ("class", "id", "role", "itemprop")).split():
        parts = [x.lower() for x in re.findall("[A-Z]*[a-z]+|[A-Z]+", token)]
        whole = "".join(parts)
        main |= whole in MAIN or token == told.get("role") and whole in ("main", "article")
        if parts and not STATES & {parts[0], parts[-1]}:
            beside |= whole in BESIDE or not BESIDE.isdisjoint(parts)
    return beside, main


def _region(name: str, told: dict[str, str], around: int) -> int:
    """The region inside an element, by that around it. What is beside the main text stays so, except that main text may stand in a form."""
    if around == IN_BESIDE or name in ("html", "body"):
        return around
    beside, main = _names(told)
    if name in ("nav", "footer", "aside", "dialog") or beside and name != "main":
        return IN_BESIDE
    if name == "header":
        return IN_HEADER if around in (IN_MAIN, IN_HEADER) else IN_BESIDE
    if name in ("article", "main") or main:
        return IN_MAIN
    return IN_FORM if name in ("form", "fieldset") else around


def blocks(page: str) -> Iterator[tuple[int, str, float, float, float, float]]:
    """The blocks of a page in order: where each begins, its text, words, link density, kind and region."""
    stack: list[tuple[str, int, bool, float]] = []  # open elements: name, region inside, whether what is inside is not shown, kind
    opened: Counter[str] = Counter()
    region, hidden, linked, at, begin, end = NEITHER, False, False, 0, 0, len(page)
    pieces: list[tuple[str, bool]] = []
    found: list[list] = []
    seen_main = False

    def flush() -> None:
        nonlocal pieces, region
        text = " ".join("".join(x for x, _ in pieces).split())
        if text:
            many = len(text.split()) + (0 if text.isascii() else len(CJK.findall(text)) // 2)
            links = sum(len(x.split()) + (0 if x.isascii() else len(CJK.findall(x)) // 2) for x, yes in pieces if yes)
            kind = stack[-1][3] if stack else 0.0
            if kind == 2.0 and region != IN_BESIDE and ENDS.fullmatch(text):
                region = IN_BESIDE  # from here to the end of the element around the heading
                own = next(i for i in reversed(range(len(stack))) if stack[i][0] in HEADINGS)
                for i in range(max(own - 1, 0), len(stack)):
                    stack[i] = (stack[i][0], IN_BESIDE, *stack[i][2:])
            found.append([begin, text, float(many), min(1.0, links / many), kind, region])
        pieces = []

    def close(i: int) -> None:
        nonlocal region, hidden
        opened.subtract([x[0] for x in stack[i:]])
        del stack[i:]
        region, hidden = stack[-1][1:3] if stack else (NEITHER, False)

    def shown(upto: int) -> None:
        nonlocal begin
        if upto > at and not hidden:
            if not pieces:
                begin = at
            pieces.append((html.unescape(page[at:upto]), linked))

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            break
        shown(m.start())
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in BLOCK:
            flush()
        if m["end"]:
            if name == "a":
                linked = False
            for i in reversed(range(len(stack))) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if (name not in BLOCK or name == "p") and stack[i][0] in BLOCK and stack[i][0] != "p":
                    break  # never closes what is around the block
            continue
        told = _attributes(m["told"])
        if name in RAW:
            if not m["told"].endswith("/>"):
                last = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = last.end() if last else end
            continue
        if name == "br":
            pieces.append((" ", linked))
        if name in VOID:
            continue
        if name == "a":
            linked = "href" in told
        if name in BLOCK:  # a block-level tag ends an open paragraph
            for i in reversed(range(len(stack))) if opened["p"] else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCK:
                    break
        unseen = hidden or "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "").lower()
        region, hidden = _region(name, told, region), unseen
        seen_main |= region == IN_MAIN
        stack.append((name, region, hidden, KINDS.get(name, stack[-1][3] if stack else 0.0)))
        opened[name] += 1
    else:
        at = end
    shown(end)
    flush()
    for x in found:
        r = x[5]
        x[5] = {IN_MAIN: 1.0, IN_HEADER: 1.0 if x[4] == 2.0 else 2.0, NEITHER: -1.0 if seen_main else 0.0}.get(r, 2.0)
        yield tuple(x)


def _blocks(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: [dict(zip(("text", "words", "links", "kind", "region"), b[1:], strict=True)) for b in blocks(p)])


#: The labelled pages: pieces of HTML with whether their blocks are main text; {n} stands for n words.
_LINKS = "<ul><li><a href=x>{1}</a></li><li><a href=x>{2}</a></li><li><a href=x>{1}</a></li><li><a href=x>{3}</a></li></ul>"
PAGES = [
    # marked up by elements
    [("<nav>" + _LINKS + "</nav><div class=ad>{8}</div>", 0), ("<article><h1>{7}</h1><p>{40}</p><p>{3}</p><p>{25}</p><ul><li>{9}</li><li>{4}</li></ul><p>{1}</p><h2>{2}</h2><p>{60}</p></article>", 1), ("<footer>{9} <a href=x>{2}</a></footer>", 0)],
    [("<header><h1>{3}</h1><p>{12}</p></header><nav>" + _LINKS + "</nav>", 0), ("<main><h1>{5}</h1><p>{30} <a href=x>{3}</a> {12}</p><p><a href=x>{4}</a></p><blockquote>{20}</blockquote><p>{1}</p><table><tr><td>{2}</td><td>{1}</td></tr></table></main>", 1), ("<aside><h2>{2}</h2><p>{35}</p>" + _LINKS + "</aside><footer><p>{30}</p></footer>", 0)],
    [("<div class=cookie-notice><p>{25}</p><a href=x>{1}</a></div>", 0), ("<article><header><h1>{6}</h1></header>", 1), ("<header><p>{4}</p></header>", 0), ("<p>{2}</p><div>{50}</div><div>{3}</div>", 1), ("<div class=promo><p>{20}</p></div>", 0), ("<p>{15}</p>", 1), ("<ul class=share><li>{1}</li><li>{1}</li></ul></article><section id=comments><h2>{1}</h2><p>{40}</p><p>{4}</p></section>", 0)],
    [("<div>{30}</div><p>{14}</p><div>{3}</div>", 0), ("<main><div>{12}</div><div>{2}</div><p>{70}</p><dl><dt>{1}</dt><dd>{8}</dd></dl></main>", 1), ("<div><p>{45}</p><p>{2}</p></div><p>{20}</p>" + _LINKS, 0)],
    [("<article><h1>{4}</h1><p>{22}</p>", 1), (_LINKS, 0), ("<p>{31}</p><p>{2}</p><p>{4} <a href=x>{6}</a></p></article>", 1), ("<form><p>{15}</p><label>{2}</label></form><h3>{3}</h3><p>{25}</p>", 0)],
    [("<article><p>{1}</p></article>", 1), ("<p>{1}</p><footer>{3}</footer>", 0)],
    [("<article><p>{3}</p></article>", 1)],
    [("<p>{9}</p>", 0), ("<main>{6}</main>", 1)],
    [("<div>{2}</div>", 0), ("<main><h1>{3}</h1><p>{30}</p><p>{4}</p><p>{1}</p></main>", 1)],
    [("<article><h2>{2}</h2><p>{1}</p><p>{5} <a href=x>{3}</a></p></article>", 1), ("<p>{35}</p>", 0)],
    [("<article><p>{6}</p></article>", 1), ("<p>{3}</p><p>{40}</p><p>{20}</p>", 0)],
    [("<div class=menu>{5} <a href=x>{4}</a></div><div id=banner><p>{40}</p><p>{5} <a href=x>{6}</a></p><p>{60}</p></div>", 0), ("<article><h1><a href=x>{5}</a></h1><p>{10} <a href=x>{5}</a></p><p>{2}</p><p><a href=x>{3}</a> {4}</p><p><a href=x>{6}</a></p><p>{30}</p><p><a href=x>{2}</a> {5}</p><p>{1}</p><div>{20} <a href=x>{9}</a></div><div>{3} <a href=x>{2}</a></div><div>{30}</div></article>", 1), ("<div>{5} <a href=x>{5}</a></div><p>{40}</p><div>{10} <a href=x>{4}</a></div><p>{30}</p><p><a href=x>{6}</a></p><p>{25}</p>", 0), ("<aside><p>{6} <a href=x>{4}</a></p><p>{40}</p><p>{5} <a href=x>{6}</a></p><p>{60}</p><div><a href=x>{8}</a></div><p>{20}</p></aside>", 0)],
    [("<main><p>{6} <a href=x>{6}</a></p><ul><li><a href=x>{2}</a> {9}</li><li>{7} <a href=x>{3}</a></li><li>{3}</li></ul><p>{14}</p></main>", 1), ("<div class=related><div>{9} <a href=x>{5}</a></div><p>{30}</p></div><p>{8} <a href=x>{3}</a></p><p>{50}</p>", 0)],
    [("<main><p><a href=x>{4}</a></p><p><a href=x>{2}</a></p><p>{2}</p><p><a href=x>{9}</a></p><h2><a href=x>{3}</a></h2><p>{1} <a href=x>{1}</a></p><p>{5}</p><p><a href=x>{1}</a></p></main>", 1), ("<footer><a href=x>{3}</a></footer>", 0)],
    [("<article><h1>{2}</h1><p>{1}</p><p><a href=x>{2}</a></p><p>{2}</p><h2>{1}</h2><p><a href=x>{7}</a></p>", 1), (_LINKS, 0), ("<p>{1}</p></article>", 1), ("<div><a href=x>{3}</a></div><p>{30}</p>", 0)],
    [("<article><p>{1} <a href=x>{3}</a></p></article>", 1), (_LINKS, 0)],
    [("<article><p>{40}</p><p>{30}</p></article>", 1)],
    [("<main><p>{20}</p><p>{2}</p></main>", 1)],
    [("<article><h1>{4}</h1><p>{80}</p><p>{60}</p><p>{12}</p></article>", 1)],
    # without elements or names that tell: by words and links
    [("<div>" + _LINKS + "</div><div>{2}</div>", 0), ("<h1>{6}</h1><p>{45}</p><p>{30}</p><p>{6}</p><p>{55}</p><p>{12} <a href=x>{4}</a> {9}</p>", 1), ("<div><a href=x>{2}</a> <a href=x>{1}</a> {1}</div><div>{6}</div>", 0)],
    [("<table><tr><td><a href=x>{2}</a></td><td><a href=x>{3}</a></td></tr></table>", 0), ("<h2>{4}</h2><p>{28}</p><ul><li>{14}</li><li>{9}</li><li>{16}</li></ul><p>{33}</p>", 1), ("<p><a href=x>{8}</a></p><p><a href=x>{9}</a></p><p><a href=x>{12}</a></p><div>{4}</div>", 0)],
    [("<div><a href=x>{1}</a> | <a href=x>{1}</a> | <a href=x>{1}</a></div>", 0), ("<h1>{8}</h1><div>{80}</div><div>{48}</div><div>{20}</div>", 1), ("<h3>{2}</h3>" + _LINKS + "<p>{5}</p>", 0)],
    [("<div>{3}</div><div>{1} <a href=x>{2}</a></div>", 0), ("<h1>{5}</h1><p>{18}</p><p>{24}</p><h2>{3}</h2><p>{36}</p><p>{5}</p><p>{41}</p>", 1), ("<h3>{2}</h3><div><a href=x>{7}</a></div><div><a href=x>{6}</a></div><div>{7} <a href=x>{5}</a></div>", 0)],
    [("<p><a href=x>{3}</a></p>", 0), ("<p>{100}</p><p>{2}</p><p>{90}</p><p>{60}</p>", 1), ("<p>{3}</p>", 0)],
    [("<p>{70}</p><p>{3}</p><p>{50}</p>", 1)],
    # beside the main text, however long
    [("<div class=sidebar><h2>{2}</h2><p>{60}</p><p>{30}</p></div>", 0), ("<h1>{4}</h1><p>{20}</p><p>{50}</p>", 1), ("<div class=comment><p>{80}</p><p>{20}</p></div><div id=footer><p>{50}</p></div>", 0)],
]


def _filled(pieces: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return [(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), x), yes) for x, yes in pieces]


def labelled() -> list[tuple[float, list[float]]]:
    """A row for each block of PAGES: its label and FEATURES."""
    out = []
    for pieces in map(_filled, PAGES):
        ends, upto = [], 0
        for x, yes in pieces:
            upto += len(x)
            ends.append((upto, yes))
        found = list(blocks("".join(x for x, _ in pieces)))
        size = lambda k: found[k][2:4] if 0 <= k < len(found) else (0.0, 0.0)  # noqa: B023, E731
        for k, (begin, _, words, links, kind, region) in enumerate(found):
            label = next(yes for end, yes in ends if begin < end)
            out.append((float(label), [words, links, *size(k - 1), *size(k + 1), kind, region]))
    return out


def train(spark: SparkSession, rows: list[tuple[float, list[float]]] | None = None, depth: int = DEPTH) -> list:
    """The tree as nested lists: [feature, threshold, where at most that, where more], or a label. rows: label and FEATURES,
    by default those of PAGES."""
    table = spark.createDataFrame([(y, Vectors.dense(x)) for y, x in rows or labelled()], ["label", "features"]).coalesce(1)
    told = DecisionTreeClassifier(maxDepth=depth, maxBins=256, minInstancesPerNode=1, seed=1).fit(table).toDebugString
    lines = iter([x.strip() for x in told.splitlines()[1:] if x.strip()])

    def node():
        line = next(lines)
        if line.startswith("Predict"):
            return float(line.split(":")[1])
        feature, threshold = re.search(r"feature (\d+) <= (\S+)\)", line).groups()
        below = node()
        next(lines)  # the line of the other side
        return [int(feature), float(threshold), below, node()]

    return node()


def decided(tree, features: list[Column]) -> Column:
    """The tree as one expression of the features: whether a block is main text."""
    if not isinstance(tree, list):
        return F.lit(tree == 1.0)
    feature, threshold, below, above = tree
    return F.when(features[feature] <= threshold, decided(below, features)).otherwise(decided(above, features))


def extract(pages: DataFrame, tree: list | None = None, column: str = "html") -> DataFrame:
    """pages without its html, with text (the main text) and n_chars."""
    tree = tree or train(pages.sparkSession)

    def main(b: Column) -> Column:
        def judged(x: Column, k: Column) -> Column:
            size = lambda y: [F.coalesce(y["words"], F.lit(0.0)), F.coalesce(y["links"], F.lit(0.0))]
            return decided(tree, [x["words"], x["links"], *size(F.get(b, k - 1)), *size(F.get(b, k + 1)), x["kind"], x["region"]])

        return F.array_join(F.transform(F.filter(b, judged), lambda x: x["text"]), " ")

    rest = [c for c in pages.columns if c.lower() not in (*NEW, column.lower())]
    cut = F.pandas_udf(_blocks, BLOCKS)(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    made = pages.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0)).alias("row"), cut.alias("b"))
    found = made.select("row", let(F.col("b"), main).alias("text"))
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], "text", F.length("text").cast("long").alias("n_chars"))
