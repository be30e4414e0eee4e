"""Text furniture, page parts and scalar projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.records import is_records
from lodestone.sources.log import scratch

LEAST_CHARS, LEAST_DOCS = 12, 5
#: Tasks among which a frequent line's places are dealt where they meet what was learnt.
SALTS = 16


def trimmed_line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\r\n\f"))


def prose_lines(text: Column) -> Column:
    """The lines of a text, those of paragraphs that hold records blanked: rows of data are no furniture. An empty line may follow the last."""

    def one(paragraph: Column) -> Column:
        lines = F.split(paragraph, "\n", -1)
        return F.array_append(F.when(is_records(paragraph), F.transform(lines, lambda _: F.lit(""))).otherwise(lines), F.lit(""))

    return F.flatten(F.transform(F.split(text, "\n\n", -1), one))


def _learnable(documents: DataFrame) -> DataFrame:
    """source, doc_id, line, k: the trimmed lines that teach, with a hash of source and line."""
    # Outer, as Spark works out twice more whether the array of an inner one is empty; a null is no line of 12 characters.
    lines = documents.select("source", "doc_id", F.explode_outer(prose_lines(F.col("text"))).alias("raw")).select("source", "doc_id", trimmed_line(F.col("raw")).alias("line"))
    return lines.where(F.length("line") >= LEAST_CHARS).withColumn("k", F.xxhash64("source", "line"))


def line_counts(documents: DataFrame) -> DataFrame:
    """k, n: how often the hash of a source and line occurs, a fold to keep: counts of more documents join it by `merged_counts`."""
    return _learnable(documents).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def merged_counts(*folds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, folds).groupBy("k").agg(F.sum("n").alias("n"))


def boilerplate_lines(documents: DataFrame, sample_docs: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """source, line, n_docs: trimmed lines of 12 characters or more that 5 or more documents of a source share.

    Lines of paragraphs that hold records teach nothing. Hashes are counted first (``counts``: a kept fold over all these documents
    in its place), and only lines whose hash is frequent enough travel as text, where their documents are counted exactly.
    ``sample_docs`` learns from a source's first documents by id only; without it every document counts.
    """
    if sample_docs is not None:
        documents = documents.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("_n") <= sample_docs)
    counts = line_counts(documents) if counts is None else counts
    # Kept, so that its size is known when Spark chooses how to join.
    path = scratch(documents.sparkSession, "frequent-lines")
    counts.where(F.col("n") >= LEAST_DOCS).select("k").write.parquet(path)
    frequent = documents.sparkSession.read.schema("k long").parquet(path)
    lines = _learnable(documents).join(frequent, "k", "left_semi").select("source", "doc_id", "line").distinct()
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= LEAST_DOCS)


def dropped_lines(documents: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """doc_id, n: the places (from 0) of the lines of each document that its source's boilerplate has.

    Only hashes of lines long enough to be boilerplate travel, and a line's places are dealt over several tasks.
    """
    learnt = boilerplate_lines(documents) if learnt is None else learnt
    line = trimmed_line(F.col("raw"))
    keys = [F.xxhash64("line").alias("k1"), F.xxhash64("line", F.lit(1)).alias("k2")]
    rows = documents.select("source", "doc_id", F.posexplode_outer(prose_lines(F.col("text"))).alias("n", "raw")).select("source", "doc_id", "n", line.alias("line")).where(F.length("line") >= LEAST_CHARS)
    rows = rows.select("source", "doc_id", "n", *keys, F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALTS)).cast("int").alias("salt"))
    known = learnt.select(F.col("source").alias("of"), *keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    same = (rows["k1"] == known["k1"]) & (rows["k2"] == known["k2"]) & (rows["salt"] == known["salt"]) & rows["source"].eqNullSafe(known["of"])
    return rows.join(known, same, "left_semi").select("doc_id", "n")


def boilerplate_strip(documents: DataFrame) -> DataFrame:
    """doc_id, lines_dropped, chars_dropped: what the source's boilerplate lines take from each document."""
    gone = dropped_lines(documents).groupBy("doc_id").agg(F.collect_list("n").alias("gone"))
    sizes = F.transform("gone", lambda n: F.length(F.element_at(F.split("text", "\n", -1), n + 1)))
    found = documents.join(gone, "doc_id", "left")
    return found.select("doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_dropped"), F.coalesce(F.aggregate(sizes, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("chars_dropped"))


def boilerplate_text(documents: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """The documents' columns, text being each one (doc_id is unique) without its source's boilerplate lines, and marks of where what is left came from.

    A mark (kept_from, source_from) begins each run of kept lines; `origin` reads them. Every other character stays as it is.
    A document of boilerplate alone has an empty text and no marks; a null text stays null.
    """
    gone = dropped_lines(documents, learnt).groupBy("doc_id").agg(F.collect_list("n").alias("_gone"))
    found = documents.join(gone, "doc_id", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    lines = F.split("text", "\n", -1)
    last = F.size(lines) - 1
    each = F.transform(lines, lambda x, i: F.struct(F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x).alias("raw"), (~F.array_contains("_gone", i)).alias("kept")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("kept_at"), F.lit(False).alias("before"), F.array().cast("array<struct<kept_from:bigint,source_from:bigint>>").alias("marks"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["raw"]).cast("long")
        mark = F.struct(s["kept_at"].alias("kept_from"), s["at"].alias("source_from"))
        fresh = x["kept"] & ~s["before"]
        return F.struct((s["at"] + size).alias("at"), F.when(x["kept"], s["kept_at"] + size).otherwise(s["kept_at"]).alias("kept_at"), x["kept"].alias("before"), F.when(fresh, F.array_append(s["marks"], mark)).otherwise(s["marks"]).alias("marks"))

    found = found.withColumn("_lines", each)
    kept = F.array_join(F.transform(F.filter("_lines", lambda x: x["kept"]), lambda x: x["raw"]), "")
    whole = F.size("_gone") == 0
    none = F.array().cast("array<struct<kept_from:bigint,source_from:bigint>>")
    one = F.array(F.struct(F.lit(0).cast("long").alias("kept_from"), F.lit(0).cast("long").alias("source_from")))
    marks = F.when(F.col("text").isNull(), none).when(whole, one).otherwise(F.aggregate("_lines", start, step)["marks"])
    columns = [F.when(whole, F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in documents.columns]
    return found.select(*columns, marks.alias("marks"))


def origin(marks: Column, offset: Column) -> Column:
    """The offset in the source of an offset in the stripped text; null before the first mark."""
    at = F.try_element_at(F.filter(marks, lambda m: m["kept_from"] <= offset), F.lit(-1))
    return at["source_from"] + offset - at["kept_from"]


def blob_identity(documents: DataFrame) -> DataFrame:
    """The hash of the bytes, and that of the text with white space collapsed and trimmed."""
    folded = F.regexp_replace(F.regexp_replace("text", r"[ \t\n\r\f]+", " "), "^ | $", "")
    return documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("blob_sha"), F.sha2(folded.cast("binary"), 256).alias("fingerprint"))


def snippet(documents: DataFrame, n: int = 400) -> DataFrame:
    return documents.select("doc_id", F.when(F.length("text") <= n, F.col("text")).otherwise(F.concat(F.substring("text", 1, n), F.lit("…"))).alias("snippet"))


def read_page(documents: DataFrame, offset: int = 100, most: int = 500) -> DataFrame:
    total = F.length("text")
    return documents.select("doc_id", F.substring("text", offset + 1, most).alias("page"), total.cast("long").alias("total_chars"), (total > offset + most).alias("truncated"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href: the quoted href of every anchor, in any case and with either quote."""
    links = F.explode(F.filter(F.transform(tags(F.col("html"), "a"), lambda x: attribute(x, "href")), lambda x: x.isNotNull()))
    return pages.select("page_id", links.alias("href"))


def page_hosts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


#: Character references that titles are unescaped from, in this order.
REFERENCES = (("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"))


def unescaped(text: Column) -> Column:
    for escaped, plain in REFERENCES:
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")


def attribute(tag: Column, name: str) -> Column:
    """The quoted value of an attribute of a tag; its name isn't the end of a longer one. Null if it has none."""
    pattern = rf"(?is)(?:^|[^a-z0-9-]){name}\s*=\s*(\"[^\"]*\"|'[^']*')"
    value = F.regexp_extract(tag, pattern, 1)
    return F.when(value != "", F.substring(value, F.lit(2), F.length(value) - 2))


def tags(html: Column, names: str) -> Column:
    """All start tags of these names (``a|img``), each up to its first ``>``, as an array."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<(?:{names})(?:[\s/][^>]*)?>)"), 1)


def title_of(html: Column) -> Column:
    """The page's og:title, or else its title element; unescaped, null if blank."""
    own = F.filter(F.transform(F.filter(tags(html, "meta"), lambda m: F.lower(attribute(m, "property")) == "og:title"), lambda m: unescaped(attribute(m, "content"))), lambda x: x != "")
    element = unescaped(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1))
    return F.coalesce(F.try_element_at(own, F.lit(1)), F.when(element != "", element))


def html_title(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", title_of(F.col("html")).alias("title"))


def page_tags(pages: DataFrame) -> DataFrame:
    """page_id, tag, n, with_href: start tags by name, and how many carry a quoted href."""
    found = pages.select("page_id", F.explode(tags(F.coalesce("html", F.lit("")), "a|area|link|meta|script|img|iframe|form")).alias("raw"))
    name = F.lower(F.regexp_extract("raw", "^<([A-Za-z]+)", 1))
    return found.groupBy("page_id", name.alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.count(attribute(F.col("raw"), "href")).alias("with_href"))
