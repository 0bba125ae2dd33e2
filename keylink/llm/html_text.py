"""Main text of web pages from flat text blocks and a decision tree.

Markup is cut into blocks at block elements; scripts, styles, forms and other elements without prose
never become blocks. A block has its word count and link density, those of its neighbours, and
whether it lies in an article, in an element named for page furniture, or in a heading. A decision
tree, fitted by Spark ML on the small labelled table below, keeps or drops each block. The tree goes
to the tasks as a few thresholds, so a page is read once and nothing is shuffled. Names that an
article's own parts bear as well (``related-work``, ``legal``) make furniture outside of articles alone.
A block of links in an article is kept where its neighbours are prose, and dropped in a list of links.

Elements without prose go up to their own closing tag. Without one, scripts, styles and other raw text
run to the end, as in HTML; forms, selects, buttons, objects and the like go only as a tag, and so does
a head, whose title, styles and scripts go on their own.

Defined results: null or empty html gives an empty text; markup that is cut off is read to its end;
character references without an end are decoded where HTML allows it; repeated rows are extracted
each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "article", "furniture", "heading",
)
# The labelled table: FEATURES (link densities in hundredths), then 1 for main text.
LABELLED = [
    (1, 0, 2, 0, 16, 0, 1, 0, 0, 1), (1, 0, 1, 0, 2, 0, 1, 0, 0, 1), (2, 0, 90, 0, 0, 0, 1, 0, 0, 1),
    (1, 0, 2, 0, 2, 100, 1, 0, 0, 1), (2, 0, 1, 100, 1, 100, 1, 0, 0, 1), (1, 0, 0, 0, 90, 0, 1, 0, 1, 1),
    (3, 0, 3, 0, 3, 0, 1, 0, 0, 1), (2, 33, 5, 0, 1, 0, 1, 0, 0, 1), (7, 28, 9, 0, 5, 0, 1, 0, 0, 1),
    (45, 0, 60, 0, 52, 0, 1, 0, 0, 1), (8, 0, 0, 0, 45, 0, 1, 0, 1, 1), (3, 0, 50, 0, 2, 0, 1, 0, 0, 1),
    (1, 0, 12, 0, 30, 0, 1, 0, 0, 1), (120, 5, 6, 0, 14, 0, 1, 0, 0, 1), (30, 20, 40, 0, 3, 0, 1, 0, 0, 1),
    (12, 0, 1, 100, 44, 0, 1, 0, 1, 1), (2, 0, 80, 0, 5, 0, 1, 0, 1, 1), (6, 0, 6, 0, 6, 0, 1, 0, 0, 1),
    (25, 10, 0, 0, 0, 0, 1, 0, 0, 1), (4, 50, 70, 0, 60, 0, 1, 0, 0, 1), (15, 0, 33, 0, 1, 100, 1, 0, 0, 1),
    (60, 0, 55, 0, 48, 0, 0, 0, 0, 1), (35, 3, 80, 0, 70, 0, 0, 0, 0, 1), (22, 0, 40, 0, 38, 0, 0, 0, 0, 1),
    (9, 0, 2, 100, 60, 0, 0, 0, 1, 1), (90, 12, 7, 0, 4, 0, 0, 0, 0, 1), (14, 0, 50, 0, 45, 0, 0, 0, 0, 1),
    (18, 5, 90, 2, 40, 0, 0, 0, 0, 1), (5, 0, 45, 0, 50, 0, 0, 0, 1, 1), (41, 0, 9, 0, 2, 0, 0, 0, 0, 1),
    (12, 100, 40, 0, 50, 0, 1, 0, 0, 1), (5, 100, 60, 0, 30, 0, 1, 0, 0, 1), (8, 100, 30, 5, 45, 10, 1, 0, 0, 1),
    (3, 100, 20, 0, 15, 0, 1, 0, 0, 1), (20, 90, 35, 0, 80, 0, 1, 0, 0, 1), (6, 70, 12, 20, 9, 15, 1, 0, 0, 1),
    (4, 100, 8, 0, 70, 3, 1, 0, 0, 1), (9, 100, 70, 0, 3, 0, 1, 0, 0, 1), (2, 60, 25, 0, 4, 33, 1, 0, 0, 1),
    (19, 0, 0, 0, 8, 100, 1, 0, 0, 1), (19, 0, 8, 100, 0, 0, 1, 0, 0, 1), (40, 0, 5, 100, 6, 100, 1, 0, 0, 1),
    (55, 5, 30, 0, 3, 100, 1, 0, 0, 1), (7, 0, 2, 100, 50, 0, 1, 0, 0, 1), (33, 0, 4, 100, 12, 90, 1, 0, 0, 1),
    (3, 0, 6, 100, 4, 100, 1, 0, 0, 1), (80, 12, 0, 0, 2, 100, 1, 0, 0, 1), (28, 0, 14, 80, 3, 0, 1, 0, 0, 1),
    (45, 0, 30, 0, 3, 100, 0, 0, 0, 1), (60, 5, 50, 0, 2, 100, 0, 0, 0, 1), (25, 0, 2, 100, 4, 100, 0, 0, 0, 1),
    (100, 3, 0, 0, 1, 100, 0, 0, 0, 1), (18, 0, 40, 0, 6, 80, 0, 0, 0, 1), (30, 8, 25, 0, 12, 60, 0, 0, 0, 1),
    (70, 0, 3, 100, 1, 100, 0, 0, 0, 1), (16, 0, 22, 0, 2, 100, 0, 0, 0, 1), (36, 2, 6, 70, 5, 90, 0, 0, 0, 1),
    (1, 0, 0, 0, 0, 0, 0, 0, 0, 1), (4, 0, 0, 0, 0, 0, 0, 0, 0, 1), (8, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (15, 10, 0, 0, 0, 0, 0, 0, 0, 1), (3, 33, 0, 0, 0, 0, 0, 0, 0, 1),
    (6, 100, 5, 100, 4, 100, 1, 0, 0, 0), (9, 80, 4, 100, 60, 0, 1, 0, 0, 0), (7, 100, 45, 0, 8, 100, 1, 0, 0, 0),
    (12, 95, 3, 90, 5, 80, 1, 0, 0, 0), (2, 100, 30, 0, 6, 85, 1, 0, 0, 0), (5, 75, 6, 70, 20, 0, 1, 0, 0, 0),
    (3, 100, 50, 0, 2, 100, 1, 0, 0, 0), (2, 100, 2, 100, 3, 100, 1, 0, 0, 0), (4, 100, 1, 100, 40, 0, 1, 0, 0, 0),
    (1, 100, 1, 100, 1, 100, 0, 1, 0, 0), (2, 100, 0, 0, 1, 100, 0, 1, 0, 0), (9, 0, 1, 100, 8, 0, 0, 1, 0, 0),
    (14, 0, 30, 0, 0, 0, 0, 1, 0, 0), (40, 0, 20, 0, 30, 0, 0, 1, 0, 0), (70, 2, 60, 0, 50, 0, 0, 1, 0, 0),
    (6, 0, 80, 0, 9, 0, 1, 1, 0, 0), (35, 0, 50, 0, 44, 0, 1, 1, 0, 0), (3, 0, 40, 0, 25, 0, 1, 1, 1, 0),
    (12, 30, 10, 40, 8, 0, 0, 1, 0, 0), (28, 0, 33, 0, 3, 100, 1, 1, 0, 0), (5, 0, 2, 0, 30, 0, 0, 1, 1, 0),
    (1, 100, 1, 100, 1, 100, 0, 0, 0, 0), (3, 100, 2, 100, 9, 0, 0, 0, 0, 0), (5, 80, 4, 90, 6, 70, 0, 0, 0, 0),
    (4, 0, 2, 100, 3, 100, 0, 0, 0, 0), (6, 0, 3, 80, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 2, 100, 0, 0, 0, 0),
    (2, 0, 3, 0, 4, 0, 0, 0, 0, 0), (7, 20, 5, 60, 2, 100, 0, 0, 0, 0), (12, 60, 10, 50, 11, 70, 0, 0, 0, 0),
    (20, 75, 3, 0, 4, 0, 0, 0, 0, 0), (5, 0, 6, 0, 3, 0, 0, 0, 0, 0), (30, 90, 20, 80, 25, 90, 0, 0, 0, 0),
]

# HTML elements by their use here.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
NESTING = frozenset(
    "article aside blockquote body dd details dialog div dl dt fieldset figure footer header html li "
    "main nav ol section table td th tr ul a h1 h2 h3 h4 h5 h6".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
FURNITURE = frozenset("nav aside footer menu dialog".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|banner|promo|nav|navbar|navigation|menu|"
    r"sidebar|footer|breadcrumbs?|comments?|comment(?:list|form|area|box|section|thread)|disqus|replies|"
    r"notice|notices|cookies?|consent|gdpr|share|sharing|social|newsletter|subscribe|signup|popup|modal|"
    r"overlay|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
OUTER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:side|header|masthead|related|recommended|login|widget|copyright|disclaimer|legal)"
    r"(?:$|[\s_-])",
    re.I,
)
SINGLE = frozenset("form select button".split())  # never inside themselves
_PAIRED = r"noscript|template|form|select|button|svg|object"
_RAW = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<drop>script|style|textarea|iframe|title)(?=[\s/>])[^>]*+>.*?(?:</(?P=drop)\s*+>|\Z)"
)
_PAIRS = re.compile(
    r"<title\s*+/>|" + _RAW + r"|<(?P<end>/?)(?P<pair>" + _PAIRED + r")(?=[\s/>])[^>]*+>", re.I | re.S
)
_TOKEN = re.compile(
    _RAW + r"|<(?P<pair>" + _PAIRED + r")(?=[\s/>])[^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-z][^<>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTR = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _closed(page: str) -> dict[int, int]:
    """Where each paired element without prose that is closed begins and ends."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for m in _PAIRS.finditer(page):
        if not m["pair"]:
            continue
        name = m["pair"].lower()
        begun = opened.setdefault(name, [])
        if m["end"]:
            if begun:
                ends[begun.pop()] = m.end()
        elif name == "svg" and m[0].endswith("/>"):
            ends[m.start()] = m.end()
        else:
            if name in SINGLE:
                begun.clear()
            begun.append(m.start())
    return ends


def blocks(page: str) -> list[tuple[str, float, bool, bool, bool]]:
    """(text, link density, article, furniture, heading) of each block, in page order."""
    out, parts = [], []
    stack: list[tuple[str, bool, bool]] = []  # element, opens an article, is furniture

    def flush() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.split()) for t, a in parts if a)
            kinds = [s[0] for s in stack]
            out.append((
                text, min(1.0, linked / len(text.split())), any(s[1] for s in stack),
                any(s[2] for s in stack), any(k[0] == "h" and k[1:].isdigit() for k in kinds),
            ))
        parts.clear()

    def add(raw: str) -> None:
        if raw:
            parts.append((html.unescape(raw), any(s[0] == "a" for s in stack)))

    at, closed = 0, None
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["pair"]:
            closed = _closed(page) if closed is None else closed
            at = closed.get(m.start(), at)
        if m["drop"] or m["pair"]:
            # scripts, buttons, pictures and the like lie within a line; forms don't
            if m["pair"] and m["pair"].lower() == "form":
                flush()
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if tag in BLOCKS:
            flush()
        if tag == "br":
            parts.append((" ", False))
        elif tag in VOID or tag not in NESTING:
            continue
        elif m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif not m["attrs"].rstrip().endswith("/") or tag == "a":
            named = " ".join(a or b or c for a, b, c in _ATTR.findall(m["attrs"]))
            inside = any(s[1] for s in stack)
            furniture = tag in FURNITURE or (tag == "header" and not inside) or bool(NAMES.search(named))
            furniture = furniture or (not inside and bool(OUTER_NAMES.search(named)))
            if tag in ("body", "html", "article", "main"):
                furniture = False
            stack.append((tag, tag in ("article", "main"), furniture))
    add(page[at:])
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    edge = (0.0, 0.0)
    sizes = [edge, *[(float(len(b[0].split())), 100 * b[1]) for b in found], edge]
    kept = []
    for i, b in enumerate(found):
        x = (*sizes[i + 1], *sizes[i], *sizes[i + 2], *(float(f) for f in b[2:]))
        node = tree
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(b[0])
    return "\n\n".join(kept)


_TREES: dict[str, object] = {}


def fitted_tree(spark: SparkSession):
    """The tree as nested (feature, threshold, left, right), with True for main text at its leaves."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    session = spark.sparkContext.applicationId
    if session not in _TREES:
        values = ", ".join(str(row) for row in LABELLED)
        rows = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(FEATURES)}, label)")
        rows = rows.select(*[F.col(c).cast("double").alias(c) for c in rows.columns]).coalesce(1)
        table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        model = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=1, seed=1).fit(table)

        def read(node):
            if node.getClass().getSimpleName() == "LeafNode":
                return node.prediction() > 0.5
            split = node.split()
            return (split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild()))

        _TREES[session] = read(model._java_obj.rootNode())
    return _TREES[session]


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """Every row without its markup, with ``text`` and ``n_chars``."""
    tree = fitted_tree(pages.sparkSession)
    own = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    plain = pages.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(own)], F.col(f"`{column}`").alias("_html")
    )
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p.as_py(), tree) for p in part.column(n)]
                cols = [part.column(i) for i in range(n)]
                cols += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:n], "text", "n_chars"])

    done = plain.mapInArrow(run, f"{spec}{', ' if spec else ''}text string, n_chars long")
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(own)], "text", "n_chars")
