"""Operator 9: benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window of a benchmark item is 13 consecutive words (an item of fewer words is one window). A document can hold a
window only if it holds the window's rarest word, so that word alone is the window's prefix: words are ordered by their
number of occurrences in the corpus, counted over all documents. Document words that are some window's prefix are
joined with the windows; the prefix's offset fixes where the window would begin, which must lie inside the document
(the length and positional bounds); and each candidate is verified word by word over a window-sized slice of the
document's own words. What is verified is exact whatever the join proposed.

The words of the benchmark are a small table. It is broadcast only where its counted rows are within ``BROADCAST_ROWS``;
beyond that the joins sort and merge by word: corpus words are then counted before they meet the vocabulary, so that a row
a word and partition is moved, and places of prefix words meet the windows in a join that AQE splits where a word is
common. Documents are shuffled once to meet their candidates, by a key of the whole row's id and text: rows without an id
or with the same one share nothing unless they are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored

#: Fixed values of the contract: what separates words, and the words of a window.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table that may be broadcast: at most about 100 bytes each, so 20 MB.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased and other letters as they are. Spark's lower() is the same for ASCII texts and
    much faster there."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(low, F.lit("")), NOT_WORD), lambda w: w != "")


def _meet(big: DataFrame, small: DataFrame, rows: int, on: str) -> DataFrame:
    """An inner join with a small side of so many counted rows: broadcast within the bound, else sorted and merged."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge"), on)


def frequency(words: DataFrame, vocabulary: DataFrame, rows: int) -> DataFrame:
    """word and n: occurrences in the corpus (``words``: word) of each word of the vocabulary, of so many counted rows."""
    if rows <= BROADCAST_ROWS:  # most words are dropped before they are counted
        words = _meet(words, vocabulary, rows, "word")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts if rows <= BROADCAST_ROWS else _meet(counts, vocabulary, rows, "word")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, null or not."""
    given = [x for c in (id_col, text_col) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(*given).alias("_key"), F.xxhash64(F.lit(1), *given).alias("_key2")]


def windows(items: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a distinct window of an item: item_id, word (its rarest, the first of equals in the alphabet), off (its
    first place in the window), len and win (the words, joined by blanks). items: item_id, w; frequency: word, n."""
    starts = F.when(F.size("w") <= window, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.size("w") - (window - 1)))
    cut = items.where(F.size("w") > 0).select("item_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, window)))).alias("win"))
    words_of = cut.select("item_id", "win", F.posexplode("win").alias("off", "word"))
    ranked = words_of.join(frequency.hint("merge"), "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("off")))
    out = ranked.groupBy("item_id", F.array_join("win", " ").alias("win"), F.size("win").alias("len")).agg(rarest.alias("r"))
    return out.where(F.col("r.n") > 0).select("item_id", "win", "len", F.col("r.word").alias("word"), F.col("r.off").alias("off"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  keep: tuple[str, ...] = (), window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the columns ``keep``, n_words, n_hit (words inside an occurrence of a
    window), items (item ids as strings, sorted), n_items and contaminated. ``keep`` must not have these names.

    A null or empty text has no words and no hits; a null or empty item no windows. Equal items are all named, and a null
    item id counts as the empty string. Rows of the same id, null ids included, are judged each by its own words. With an
    empty benchmark nothing is hit. Only the named columns are read.
    """
    text, key = F.col(f"`{text_col}`"), row_key(id_col, text_col)
    base = docs.select(*key, words(text).alias("w"))
    items = stored(benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item_id"), words(F.col(f"`{item_text_col}`")).alias("w")), "benchmark-items")
    vocabulary = stored(items.select(F.explode("w").alias("word")).distinct(), "benchmark-words")
    counts = frequency(base.select(F.explode("w").alias("word")), vocabulary, vocabulary.count())
    wins = stored(windows(items, counts, window), "benchmark-windows")
    drop(items, vocabulary)
    near = base.select("_key", "_key2", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    hits = _meet(near, wins, wins.count(), "word").where((F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n")))
    found = hits.groupBy("_key", "_key2").agg(F.collect_set(F.struct((F.col("pos") - F.col("off") + 1).alias("start"), "len", "win", "item_id")).alias("found"))

    # The texts are shuffled, not their words, which take more room.
    at = text_col if text_col in keep else "_text"
    rows = docs.select(*key, F.col(f"`{id_col}`").alias("doc_id"), *(F.col(f"`{c}`") for c in keep), *([] if at in keep else [text.alias(at)]))
    both = rows.join(found.hint("merge"), ["_key", "_key2"], "left")
    # One expression a row: words, then true candidates, are each bound to a name, so that however the optimizer moves
    # this, a filter on the verdict included, a text is cut once and not once a candidate.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    result = once(words(F.col(f"`{at}`")), lambda w: once(F.filter("found", lambda c: F.array_join(F.slice(w, c["start"], c["len"]), " ") == c["win"]), lambda t: _counted(w, t)))
    both = both.select("doc_id", *(F.col(f"`{c}`") for c in keep), once(result, lambda r: F.struct(r["n_words"], r["n_hit"], r["items"], contaminated(r["n_hit"], r["n_words"]).alias("contaminated"))).alias("_r"))
    return both.select("doc_id", *(F.col(f"`{c}`") for c in keep), "_r.n_words", "_r.n_hit", "_r.items", F.size("_r.items").cast("long").alias("n_items"), "_r.contaminated")


def _counted(w: Column, true: Column) -> Column:
    """struct<n_words, n_hit, items> of a document's words and the true candidates, null if it has none."""
    places = F.array_distinct(F.transform(true, lambda c: F.struct(c["start"].alias("s"), c["len"].alias("n"))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(places, lambda c: F.sequence(c["s"], c["s"] + c["n"] - 1)))))
    named = F.array_sort(F.array_distinct(F.transform(true, lambda c: c["item_id"])))
    return F.struct(F.size(w).cast("long").alias("n_words"), F.when(true.isNull(), 0).otherwise(covered).cast("long").alias("n_hit"), F.coalesce(named, F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contract's verdict."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
