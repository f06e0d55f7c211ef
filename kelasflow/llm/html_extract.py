"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: elements of equal path and
signature are one node, which counts the pages that have it, their child
sequences (presentation styles) and the texts under it (content features).
Importance is entropy over pages.  A style that varies from page to page is
important, one layout everywhere is not; a text that stands on every page is
noise, one that a page has for itself is content; text in links is not.  Both
meet in the composite importance of a branch; a branch of low importance, or
one whose presentation names it as noise (menu, footer, form, comments ...;
importance 0), is removed from each page.

Tasks fold their pages into counts per node before anything is shuffled, so a
host that holds a third of all pages is one small tree, and pages themselves
meet the removed branches of their host in a plain join.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.llm.common import ascii_lower, materialize, text_of
from kelasflow.llm.html_blocks import Reader, _hash, main_text

DECAY = 0.9                 # weight of content against presentation, per style
THRESHOLD = 0.35            # branches below this share of the host's best importance go
MIN_PAGES = 3               # a branch on fewer pages of its host is not judged
NODE_ROWS = 1 << 16         # counts that a task keeps before it sends them on


def host_of(url: Column) -> Column:
    """Host of an url, A-Z lower-cased; null where it has none."""
    return F.nullif(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


# --------------------------------------------------------------- the site's tree
_COUNTS = pa.schema([("host", pa.string()), ("path", pa.int64()), ("above", pa.list_(pa.int64())), ("style", pa.bool_()),
                     ("item", pa.int64()), ("pages", pa.int64()), ("times", pa.int64()), ("spread", pa.float64()),
                     ("chars", pa.int64()), ("links", pa.int64())])
COUNTS = ("host string, path long, above array<long>, style boolean, item long, pages long, times long, spread double, "
          "chars long, links long")


def _rows(styles: dict, texts: dict) -> pa.RecordBatch:
    """Counts of (host, path, ...) keys as one batch."""
    out = [(h, p, list(above), True, i, n, 0, 0.0, 0, 0) for (h, p, i, above), n in styles.items()]
    out += [(h, p, None, False, i, *v) for (h, p, i), v in texts.items()]
    columns = list(zip(*out)) if out else [()] * len(_COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)


def _node_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    styles, texts = defaultdict(int), defaultdict(lambda: [0, 0, 0.0, 0, 0])
    for batch in batches:
        for host, text in zip(batch.column(0), batch.column(1)):
            host, page = host.as_py(), reader.read(text.as_py())
            for path, (above, safe) in page.nodes.items():
                if not safe:                            # what cannot be removed need not be judged
                    styles[host, path, _hash(path, "\n".join(page.children.get(path, ()))), above] += 1
            here = defaultdict(lambda: [0, 0, 0])
            for block, path, links, _ in page.blocks:
                count = here[path, _hash(path, block)]
                count[0] += 1
                count[1], count[2] = len(block), max(count[2], links)
            for (path, item), (n, chars, links) in here.items():
                total = texts[host, path, item]
                total[0] += 1
                total[1] += n
                total[2] += n * math.log(n)
                total[3], total[4] = chars, max(total[4], links)
            if len(styles) + len(texts) > NODE_ROWS:
                yield _rows(styles, texts)
                styles.clear()
                texts.clear()
    yield _rows(styles, texts)


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, above, m, presentation, content, weight): one row per
    merged element of a host that a page may lose.

    ``pages`` has host and html.  ``m`` is the number of pages with the
    element, ``presentation`` the entropy of its styles to the base m,
    ``content`` one less the mean entropy of the texts right in it (weighted
    by length, less their share of links); both are 1 where m is 1.
    """
    counts = pages.mapInArrow(_node_counts, COUNTS)
    merged = counts.groupBy("host", "path", "style", "item").agg(
        F.first("above").alias("above"), F.sum("pages").alias("pages"), F.sum("times").alias("times"),
        F.sum("spread").alias("spread"), F.max("chars").alias("chars"), F.max("links").alias("links"))
    style = F.col("style")
    one = merged.groupBy("host", "path").agg(
        F.max("above").alias("above"), F.sum(F.when(style, F.col("pages"))).alias("m"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("pages") * F.ln("pages"))).alias("_style"),
        F.sum(F.when(~style, F.col("chars"))).alias("weight"), F.sum(F.when(~style, F.col("links"))).alias("_links"),
        F.sum(F.when(~style, F.col("chars") * (F.ln("times") - F.col("spread") / F.col("times")))).alias("_text"))
    base = F.when(F.col("m") > 1, F.ln("m"))
    return one.select(
        "host", "path", "above", F.coalesce("m", F.lit(0)).alias("m"), "styles",
        F.coalesce((F.ln("m") - F.col("_style") / F.col("m")) / base, F.lit(1.0)).alias("presentation"),
        F.coalesce((1 - F.least(F.lit(1.0), F.col("_text") / F.col("weight") / base))
                   * (1 - F.col("_links") / F.col("weight")), F.lit(1.0)).alias("content"),
        F.coalesce("weight", F.lit(0)).alias("weight"))


def branch_importance(tree: DataFrame) -> DataFrame:
    """(host, path, m, importance): composite importance of every branch, the
    presentation of its top with the content of all that is below it."""
    below = (tree.where("weight > 0 AND above IS NOT NULL")
             .select("host", F.explode("above").alias("path"), "content", "weight")
             .groupBy("host", "path").agg((F.sum(F.col("content") * F.col("weight")) / F.sum("weight")).alias("_below")))
    share = F.pow(F.lit(DECAY), F.col("styles"))
    composite = (1 - share) * F.col("presentation") + share * F.col("_below")
    return (tree.where("above IS NOT NULL").join(below, ["host", "path"])
            .select("host", "path", "m", composite.alias("importance")))


def removed_branches(pages: DataFrame) -> DataFrame:
    """(host, removed): paths of a host's branches of low importance.

    They are branches of its template, each on several pages; ``removed``
    grows with the template, not with the pages.
    """
    judged = branch_importance(materialize(style_trees(pages), "style-tree"))
    best = judged.groupBy("host").agg(F.max("importance").alias("_best"))
    low = judged.where(F.col("m") >= MIN_PAGES).join(best, "host").where(
        F.col("importance") < THRESHOLD * F.col("_best"))
    return low.groupBy("host").agg(F.collect_set("path").alias("removed"))


# ------------------------------------------------------------------- extraction
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    none: frozenset = frozenset()
    for batch in batches:
        out = []
        for text, removed in zip(batch.column(2), batch.column(3)):
            gone = frozenset(removed.as_py()) if removed.is_valid else none
            out.append(main_text(reader.read(text.as_py(), gone)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                         ["id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page, whole.

    Character references are decoded, white space inside a block becomes one
    space, blocks follow in page order.  Null html is empty and gives an empty
    text.  A page without a host (null url, no ``://``) is judged by its own
    presentation alone.  Repeated rows and ids are kept as they are; an empty
    table gives no rows; other columns are not read, so their names cannot
    clash.  Where a page marks its article (article, main, or such a role),
    text outside goes; unnamed parts inside it are never removed.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(F.col(html_col)).alias("html"))
    hosted = rows.withColumn("host", host_of(F.col("url").cast("string")))
    removed = materialize(removed_branches(hosted.where("host IS NOT NULL").select("host", "html")), "removed-branches")
    read = hosted.join(removed, "host", "left").select("id", "url", "html", "removed").mapInArrow(
        _texts, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return read.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                       F.length("text").cast("long").alias("n_chars"))
