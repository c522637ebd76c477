"""Pages as blocks with places: repeated headers and footers, columns, tables, page lists, recognised pages.

``blocks``: doc_id, page_idx, blk_idx, type, x0, y0, x1, y1, text; ``pages``: doc_id, page_idx, width, height.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import rx

#: What a footer holds.
FOOTERS = [(r"CEP\s*\d{5}-?\d{3}", "i"), (r"\(\d{2}\)\s*\d[\s.\-]*\d{3,4}[\s.\-]*\d{4}", ""), (r"Página\s*\d+", "i"), (r"Pág\.\s*\d+", "i"), (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "")]


def is_footer(text: Column) -> Column:
    out = F.lit(False)
    for p, flags in FOOTERS:
        out = out | rx.has(text, p, flags)
    return out


def sampled(page: Column, total: Column, sample: int = 50, ends: int = 10) -> Column:
    """Whether a page is looked at: all up to ``sample`` pages, else the first and last ten and evenly spread others."""
    middle = sample - 2 * ends
    step = (total - 2 * ends) / F.lit(float(middle + 1))
    spread = F.transform(F.sequence(F.lit(1), F.lit(max(middle, 1))), lambda i: F.floor(ends + step * i).cast("int"))
    return (total <= sample) | (page < ends) | (page >= total - ends) | (F.array_contains(spread, page) if middle > 0 else F.lit(False))


def text_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that hold text, stripped."""
    return blocks.filter("type = 0").withColumn("text", rx.strip(F.col("text"))).filter("text <> ''")


def _facts(blocks: DataFrame, pages: DataFrame, sample: int, share: float) -> DataFrame:
    """Pages with ``total, looked`` and ``keys``, the heights at which their document has headers or footers.

    Of the blocks only the outermost edges at each height of a page are shuffled, without texts.
    """
    facts = pages.withColumn("total", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("looked", sampled(F.col("page_idx"), F.col("total"), sample))
    looked = facts.filter("total >= 3 and looked")
    edges = text_blocks(blocks).groupBy("doc_id", "page_idx", (F.bround(F.col("y0") / 5) * 5).alias("y_key")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    seen = edges.join(looked.select("doc_id", "page_idx", "height"), ["doc_id", "page_idx"]).filter(_zone())
    n_looked = looked.groupBy("doc_id").agg(F.count("*").alias("n_looked"))
    keys = seen.groupBy("doc_id", "y_key").agg(F.countDistinct("page_idx").alias("n")).join(n_looked, "doc_id").filter(F.col("n") >= F.col("n_looked") * share)
    return facts.join(keys.groupBy("doc_id").agg(F.collect_set("y_key").alias("keys")), "doc_id", "left")


def _zone() -> Column:
    return (F.col("y0") < F.col("height") * 0.12) | (F.col("y1") > F.col("height") * 0.88)


def _header_or_footer() -> Column:
    """Whether a block that was joined with its page's facts is a header or footer."""
    repeated = _zone() & F.array_contains("keys", F.bround(F.col("y0") / 5) * 5)
    foot = (F.col("y1") > F.col("height") * 0.85) & (F.col("looked") | F.col("keys").isNotNull()) & is_footer(F.col("text"))
    return F.coalesce((F.col("total") >= 3) & (F.coalesce(repeated, F.lit(False)) | F.coalesce(foot, F.lit(False))), F.lit(False))


def header_footer_blocks(blocks: DataFrame, pages: DataFrame, sample: int = 50, share: float = 0.5) -> DataFrame:
    """``doc_id, page_idx, blk_idx`` of blocks that are headers or footers.

    A height at which text stands in the header or footer zone of at least ``share`` of the sampled pages marks such
    blocks everywhere; so do footer texts at the foot of a page.  Documents of fewer than three pages have none.
    """
    facts = _facts(blocks, pages, sample, share).select("doc_id", "page_idx", "height", "total", "looked", "keys")
    return text_blocks(blocks).join(facts, ["doc_id", "page_idx"]).filter(_header_or_footer()).select("doc_id", "page_idx", "blk_idx").distinct()


def _columns_counted() -> list[Column]:
    """Aggregates over a page's text blocks that tell whether it has two columns."""
    lo, hi = F.col("width") * 0.40, F.col("width") * 0.60
    left = (F.col("x1") <= hi) & (F.col("x0") < lo)
    right, across = F.col("x0") >= lo, (F.col("x0") < lo) & (F.col("x1") > hi)
    return [F.count("*").alias("n"), F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.count_if(across).alias("c")]


def _two() -> Column:
    return (F.col("n") >= 4) & (F.col("c") <= F.col("n") * 0.3) & (F.col("l") >= 2) & (F.col("r") >= 2)


def two_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_idx, two_columns`` per page with text: two blocks or more on either side, few across."""
    b = text_blocks(blocks).join(pages.select("doc_id", "page_idx", "width"), ["doc_id", "page_idx"])
    return b.groupBy("doc_id", "page_idx").agg(*_columns_counted()).select("doc_id", "page_idx", _two().alias("two_columns"))


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Text blocks with ``pos``, their place in reading order: by columns on pages with two, else top to bottom."""
    b = text_blocks(blocks).join(pages.select("doc_id", "page_idx", "width"), ["doc_id", "page_idx"])
    b = b.join(two_columns(blocks, pages), ["doc_id", "page_idx"])
    side = F.when(F.col("two_columns"), (F.col("x0") >= F.col("width") / 2).cast("int")).otherwise(0)
    order = Window.partitionBy("doc_id", "page_idx").orderBy("side", "y0", F.when(F.col("two_columns"), F.lit(0.0)).otherwise(F.col("x0")), "blk_idx")
    return b.withColumn("side", side).withColumn("pos", F.row_number().over(order) - 1)


def page_texts(blocks: DataFrame, pages: DataFrame, rects: DataFrame | None = None, tables: DataFrame | None = None, columns: bool = True) -> DataFrame:
    """``doc_id, page_idx, text``: blocks without headers, footers and what lies in tables, then the tables.

    A page of two columns is its blocks in reading order as they are.  ``rects``: doc_id, page_idx, x0..y1; ``tables``:
    doc_id, page_idx, tbl_idx, markdown.
    """
    keys = ["doc_id", "page_idx"]
    facts = _facts(blocks, pages, 50, 0.5).select(*keys, "width", "height", "total", "looked", "keys")
    side = (F.col("x0") >= F.col("width") / 2).cast("int").alias("side")
    row = F.struct(side, "y0", "blk_idx", "text", "x0", "x1", "y1", _header_or_footer().alias("off"))
    # texts are shuffled once, to their page, which is one row from here on
    found = text_blocks(blocks).join(facts, keys).groupBy(keys).agg(F.collect_list(row).alias("rows"), *_columns_counted())
    two = _two() if columns else F.lit(False)
    found = pages.select(keys).join(found.select(*keys, "rows", two.alias("two")), keys, "left")
    kept = F.filter("rows", lambda r: ~r["off"])
    if rects is not None:
        found = found.join(_of_page(rects), keys, "left")
        kept = F.filter(kept, lambda r: ~F.coalesce(F.exists("rects", _inside(r)), F.lit(False)))
    placed = lambda pos, text: F.struct(pos.cast("long").alias("pos"), text.alias("text"))
    plain = F.coalesce(F.transform(kept, lambda r: placed(r["blk_idx"], r["text"])), F.array().cast("array<struct<pos:bigint,text:string>>"))
    if tables is not None:
        put = tables.groupBy(keys).agg(F.collect_list(placed(F.col("tbl_idx") + (1 << 30), F.col("markdown"))).alias("put"))
        found = found.join(put, keys, "left")
        plain = F.when(F.col("put").isNull(), plain).otherwise(F.concat(plain, "put"))
    lines = F.when(F.coalesce("two", F.lit(False)), F.sort_array("rows")["text"]).otherwise(F.sort_array(plain)["text"])
    return found.select(*keys, F.array_join(lines, "\n").alias("text")).fillna({"text": ""})


def _of_page(rects: DataFrame) -> DataFrame:
    """A page's few rectangles as one array."""
    return rects.groupBy("doc_id", "page_idx").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("rects"))


def _inside(block: Column | dict[str, Column], slack: float = 2.0) -> Callable[[Column], Column]:
    return lambda r: (block["x0"] >= r["x0"] - slack) & (block["y0"] >= r["y0"] - slack) & (block["x1"] <= r["x1"] + slack) & (block["y1"] <= r["y1"] + slack)


def outside_tables(blocks: DataFrame, rects: DataFrame, slack: float = 2.0) -> DataFrame:
    """Blocks that lie in no table of their page: a page's few rectangles meet its blocks as one array."""
    inside = _inside({k: F.col(k) for k in ("x0", "y0", "x1", "y1")}, slack)
    return blocks.join(_of_page(rects), ["doc_id", "page_idx"], "left").filter(~F.coalesce(F.exists("rects", inside), F.lit(False))).drop("rects")


def page_list(spec: Column, total: Column) -> Column:
    """``"1,5,10-20"`` (from 1) as sorted distinct page numbers from 0 that exist; all pages for a blank list.

    Anything malformed, below 1 or descending raises an error.
    """
    parts = F.transform(F.split(spec, ","), rx.strip)
    bad = lambda p: F.raise_error(F.concat(F.lit("not a page list: "), p))
    number = lambda p, k: F.regexp_extract(p, r"^(\d+)\s*(?:-\s*(\d+))?$", k)

    def pages(p: Column) -> Column:
        a = number(p, 1).cast("int")
        b = F.when(number(p, 2) == "", a).otherwise(F.when(number(p, 2) != "", number(p, 2)).cast("int"))
        ok = rx.has(p, r"^[0-9]+\s*(?:-\s*[0-9]+)?$")
        return F.when(~ok, bad(p)).when((a < 1) | (b < a), bad(p)).when(a > total, F.array().cast("array<int>")).otherwise(F.sequence(a - 1, F.least(b, total) - 1))

    listed = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p != ""), pages))))
    every = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(rx.strip(spec), F.lit("")) == "", every).otherwise(listed)


def page_key(image: Column, lang: Column) -> Column:
    """The cache key of a page image."""
    return F.sha2(F.concat(image, lang.cast("binary")), 256)


def cached_pages(pages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with ``page_hash, lang`` that the cache (``page_hash, lang, text, created_at``) knows, and those it lacks."""
    known = pages.join(cache.select("page_hash", "lang", F.col("text").alias("cached")), ["page_hash", "lang"])
    return known, pages.join(cache, ["page_hash", "lang"], "left_anti")


def cache_put(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache with recognised pages added, the newest of a key kept; empty texts are not cached."""
    rows = cache.unionByName(found.filter(rx.strip(F.col("text")) != ""))
    latest = F.max_by(F.struct("text", "created_at"), "created_at")
    return rows.groupBy("page_hash", "lang").agg(latest.alias("r")).select("page_hash", "lang", "r.text", "r.created_at")


def cache_expire(cache: DataFrame, days: int, now: Column) -> DataFrame:
    return cache.filter(F.col("created_at") >= now - F.expr(f"interval {days} days"))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
