"""Statistics of books and images. All are aggregations with partial sums, so no key is too large for a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_stats(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Chapters, pages and characters of documents: doc_id, chapters, pages, chars. chapters: doc_id, pages; paragraphs:
    doc_id, text."""
    c = chapters.groupBy("doc_id").agg(F.count("*").alias("chapters"), F.sum("pages").alias("pages"))
    p = paragraphs.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"))
    return c.join(p.hint("merge"), "doc_id", "full").select("doc_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("chapters", "pages", "chars")))


def keywords(docs: DataFrame, k: int = 10, least: int = 4) -> DataFrame:
    """The k most frequent words of each row of documents, of so many letters at least: doc_id, rank, word, n; ties by the
    word. A text's words are sorted and counted where the row lies, by the places where the next word begins, and only the
    k counts leave it: nothing is shuffled."""
    words = F.sort_array(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= least))
    rows = docs.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    begins = F.filter(F.transform("w", lambda w, i: F.when((i == 0) | (w != F.get("w", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("b", begins)
    counts = F.transform("b", lambda at, i: F.struct((at - F.coalesce(F.get("b", i + 1), F.size("w"))).alias("less"), F.get("w", at).alias("word")))
    best = F.slice(F.sort_array(counts), 1, k)
    return rows.select("doc_id", F.posexplode(best).alias("i", "c")).select("doc_id", (F.col("i") + 1).alias("rank"), "c.word", (-F.col("c.less")).cast("long").alias("n"))


def is_scanned(pages: DataFrame) -> DataFrame:
    """Whether no page of a document has text: doc_id, scanned."""
    return pages.groupBy("doc_id").agg(F.bool_and(F.trim(F.coalesce("text", F.lit(""))) == "").alias("scanned"))


def image_summary(images: DataFrame) -> DataFrame:
    """doc_id, page_count and usable (pages whose image can be shown). images: a row a page, with kind."""
    return images.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("kind").isin("jpeg", "raw")).alias("usable"))


def distinct_notes(images: DataFrame) -> DataFrame:
    """Different notes of a document in the order in which they first come: doc_id, notes array<string>."""
    first = images.where("note <> ''").groupBy("doc_id", "note").agg(F.min("img_seq").alias("seq"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda s: s["note"]).alias("notes"))


def largest_image(images: DataFrame, pages: DataFrame) -> DataFrame:
    """The largest image of every page, the first of equals: doc_id, page_no, img_seq, kind (``none`` without one)."""
    sized = images.where("width > 0 AND height > 0")
    best = sized.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("img_seq", "kind"), F.struct(F.col("width") * F.col("height"), -F.col("img_seq"))).alias("b"))
    return pages.select("doc_id", "page_no").join(best.hint("merge"), ["doc_id", "page_no"], "left").select("doc_id", "page_no", "b.img_seq", F.coalesce("b.kind", F.lit("none")).alias("kind"))


def doc_info(info: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a document with pages: doc_id, title, author, page_count. info: doc_id, key (Title, Author), value."""
    side = lambda key: info.where(F.col("key") == key).groupBy("doc_id").agg(F.min("value").alias(key.lower()))
    n = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    out = n.join(side("Title"), "doc_id", "left").join(side("Author"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), "page_count")
