"""Keyword-stuffed pages, link lists and tag pages, by the shapes of their lines.

Every line is reduced to a shape: words become ``w`` (lower case), ``W``
(capital first) or ``n`` (digit first), links become ``U``, everything else stays. A
shape says how many words, capitals, separators and links a line has, and
whether it reads as a sentence, as code, or as neither, by their shares of its
words. Where such shapes hold the larger part of a page, its keyword lines are read once more, and those
that have the function words of a sentence are taken out. Shapes are grouped per page; a page is flagged if the few largest of its
non-sentence, non-code shapes hold more than half of its words and their words are the same ones again and again.

One pass over the whole texts, no shuffle of text: only a few small rows per
document (coarse shape, lines, words) are grouped by Spark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than this share of a page's words must be in stuffed lines.
SHARE = 0.5
#: At least this share of the words in keyword and tag lines must be repeats.
REPEATS = 0.4
#: A line is a sentence if at least this share of its words are function words, two at least.
SPOKEN = 0.2
#: So many coarse shapes, those of the most words, must hold the share of stuffed words.
FEW_SHAPES = 24
#: Words from which a line is long: one sentence end per so many words is still a list.
LONG = 40
#: Distinct shapes that a task keeps the reading of.
CACHE = 200_000

# fixed values: common function words of English, German, French and Spanish
FUNCTION_WORDS = frozenset(
    b"""a an and are as at be been but by can could did do does for from had has have he her here his i if in is it its may
    not of on or our she should so than that the their then there these they this those to was we were what when which who will with would you your
    das dem den der die ein eine ist mit nicht und von zu
    dans des du est et le les pour que qui un une
    con del el es las los para por una y""".split()
)

_FOLD = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_WORDS = [(re.compile(rb"a[aA0]*"), b"w"), (re.compile(rb"A[aA0]*"), b"W"), (re.compile(rb"0[aA0]*"), b"n")]
_LINE = re.compile(rb"\r\n|\r|\n")
_LINK = re.compile(rb"w://[^\s<>\"')\]]*")
_MARKUP = re.compile(rb"<[^<>]*>")
_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+")
_CODE = re.compile(rb"[{}();=<>\[\]\"'`$&\\^%@]")
#: Characters of code that prices and names in running text have too.
_SOFT = re.compile(rb"['$&%@]")
_STOP = re.compile(rb"[.!?:](?=\s|$)")
_BRACKET = re.compile(rb"\[([^\[\]]*)\]\(U\)")
#: A capitalised word is ``Ww``; this counts it once.
_WHOLE = re.compile(rb"[wWn]+")
_ONLY_WORDS = re.compile(rb"[wWn]")
_HASH = re.compile(rb"(?<![\w&])#[wW]\w*")
_KEY = re.compile(rb"^\s*[-*]?\s*\w+\s*:(\s+\S+)?\s*$")
_STRING = re.compile(rb"(:\s*)?\"([^\"]*)\"(?=(\s*:)?)")
_PLAIN = re.compile(rb"[wn]( [wn])*")
_APART = re.compile(rb"(?i)https?://[^\s<>\"')\]]*|<[^<>]*>")
_CELLS = re.compile(rb"^\s*[nw.]+(,[nw.]+)+\s*$")


def shape_of(line: bytes) -> bytes:
    """A line's shape with words still to be counted in links."""
    s = line.translate(_FOLD)
    for pattern, to in _WORDS:
        s = pattern.sub(to, s)
    return s


def _quoted_words(body: bytes) -> int:
    """Words in quoted strings of plain lower-case words: list entries, and named values of at least four words."""
    found = 0
    for named, said, key in _STRING.findall(body):
        n = len(_ONLY_WORDS.findall(said))
        if not key and _PLAIN.fullmatch(said) and said.count(b"w") * 4 >= 3 * n and (n >= 4 or not named):
            found += n
    return found


def read_shape(shape: bytes) -> tuple[str, str, int]:
    """(kind, coarse shape, words) of a line's shape; kind is link, tag, keyword or other."""
    words = len(_ONLY_WORDS.findall(shape))
    if not words:
        return "other", "", 0
    linked = _LINK.sub(b"U", shape)
    links = linked.count(b"U")
    body = _BRACKET.sub(rb"\1", linked)
    markup = body.count(b"<") and body.count(b">")
    body = _MARKUP.sub(b" ", body)
    if body.count(b"(") == body.count(b")") == 0 and body.count(b";") > 1:
        body = body.replace(b";", b",")  # a list of words, not statements
    own = _ONLY_WORDS.findall(body)
    capitals, numbers = own.count(b"W"), own.count(b"n")
    code = len(_CODE.findall(body))
    tags = len(_HASH.findall(body))
    cells = body.count(b"|")
    separators = sum(body.count(c) for c in (b",", b"|", b"/"))
    n = len(own)
    soft = len(_SOFT.findall(body))
    # a list by its shares: capitals are free, but there are next to no sentence ends and code, and four words to an item at most unless the line is long
    whole = len(_WHOLE.findall(body))
    listed = whole >= 4 and (separators > 1 and (separators + 1) * 4 >= whole or whole >= LONG) and len(_STOP.findall(body)) * LONG <= whole and (code - soft) * 12 <= whole and soft * 2 <= whole and numbers * 4 <= whole
    key_value = bool(_KEY.match(body)) or bool(_CELLS.match(body) and numbers)
    if links and whole <= 8 and code == soft and not key_value:
        kind = "link"
    elif tags and (code - soft) * 12 <= whole and soft * 2 <= whole and tags * 2 >= len(body.split()):
        kind = "tag"
    elif n and not key_value and (listed or not capitals and not code and numbers * 4 <= n):
        kind = "keyword"
    elif b'"' in body and _quoted_words(body) * 4 >= 3 * n > 0:
        kind = "keyword"
    else:
        kind = "other"
    size = "1" if n <= 1 else "2" if n <= 3 else "4" if n <= 7 else "8" if n <= 15 else "16"
    coarse = f"{size}w{'C' if capitals else ''}{'|' if cells else ',' if separators else ''}{'L' * min(links, 2)}{'#' if tags else ''}{'<' if markup else ''}{'c' if code else ''}"
    return kind, coarse, words


def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, tuple[str, str, int]] = {}
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            lines, found = shape_of(raw), Counter()
            shapes = _LINE.split(lines)
            for shape, n in Counter(shapes).items():
                if shape not in known:
                    if len(known) >= CACHE:
                        known.clear()
                    known[shape] = read_shape(shape)
                kind, coarse, words = known[shape]
                if words:
                    found[kind, coarse if kind != "other" else "", 0] += n
                    found[kind, coarse if kind != "other" else "", 1] += n * words
            total = sum(v for (_, _, i), v in found.items() if i)
            stuffed = sum(v for (k, _, i), v in found.items() if i and k != "other")
            said = same = 0
            if stuffed > SHARE * total:
                # the words themselves, links aside, to see whether they are sentences and whether they are repeats
                vocabulary = Counter()
                read: dict[bytes, tuple[str, str, int]] = {}
                for shape, line in zip(shapes, _LINE.split(raw), strict=True):
                    if shape not in read:
                        read[shape] = known[shape] if shape in known else read_shape(shape)
                    kind, coarse, words = read[shape]
                    if kind == "other":
                        continue
                    own = _WORD.findall(_APART.sub(b" ", line))
                    spoken = sum(w.lower() in FUNCTION_WORDS for w in own) if kind == "keyword" else 0
                    if spoken >= 2 and spoken >= SPOKEN * len(own):
                        for i, n in ((0, 1), (1, words)):
                            found[kind, coarse, i] -= n
                            found["other", "", i] += n
                    else:
                        vocabulary.update(own)
                said, same = sum(vocabulary.values()), len(vocabulary)
            for kind, coarse, i in list(found):
                if not i and found[kind, coarse, 0]:
                    rows.append((doc, kind, coarse, found[kind, coarse, 0], found[kind, coarse, 1], said, said - same))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "kind", "shape", "n_lines", "n_words", "said", "repeats"])


def line_shapes(documents: DataFrame) -> DataFrame:
    """``doc_id, kind, shape, n_lines, n_words, said, repeats``: the grouped line shapes of each document.

    ``said`` and ``repeats`` count the words of the document's stuffed lines without their
    links, and how many of them occurred before; 0 where stuffed lines do not
    hold the larger part. NULL texts and texts without words have no rows.
    """
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_shapes, "doc_id bigint, kind string, shape string, n_lines bigint, n_words bigint, said bigint, repeats bigint")


def stuffed_pages(documents: DataFrame, share: float = SHARE, repeats: float = REPEATS, few: int = FEW_SHAPES) -> DataFrame:
    """``doc_id, stuffed_share, link_share, n_shapes`` of flagged pages, one row per ``doc_id``.

    Repeated ids count as one page. Links and tags name things and need not
    repeat; a page that is mostly these is flagged without repeats. Empty input gives no rows.
    """
    words = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("n_words")).otherwise(0))
    shapes = line_shapes(documents).groupBy("doc_id", "kind", "shape").agg(*[f(c).alias(c) for c, f in (("n_words", F.sum), ("said", F.max), ("repeats", F.max))])
    by_size = F.reverse(F.sort_array(F.collect_list(F.when(F.col("kind") != "other", F.col("n_words")))))
    page = shapes.groupBy("doc_id").agg(
        F.aggregate(F.slice(by_size, 1, few), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("top"),
        F.sum("n_words").alias("total"),
        words("link", "tag", "keyword").alias("stuffed"),
        words("link").alias("links"),
        words("link", "tag").alias("marked"),
        F.count_distinct(F.when(F.col("kind") != "other", F.col("shape"))).alias("n_shapes"),
        F.max("said").alias("said"),
        F.max("repeats").alias("repeats"),
    )
    again = (F.col("repeats") >= repeats * F.col("said")) | (F.col("marked") > share * F.col("total"))
    page = page.where((F.col("top") > share * F.col("total")) & again)
    return page.select("doc_id", (F.col("stuffed") / F.col("total")).alias("stuffed_share"), (F.col("links") / F.col("total")).alias("link_share"), "n_shapes")
