"""Benchmark decontamination with a positional inverted index, DataFrame functions only.

Test items are cut into windows of consecutive words. The index holds, for every corpus
token that is among the rarest terms of some window, a posting: term, document, position.
A window's lists are intersected from the rarest on, positions less offsets being equal
for phrases, close to each other for proximity. What is left, few places, is read in the
documents themselves: a phrase word by word, a near match by all its words standing, in
any order, within ``slop`` more words than the window has.

Nothing grows with the corpus on one task: terms are counted per task before the shuffle,
tokens travel without the document they stand in, a document's matches are bounded by its
length. What is joined with the corpus is broadcast if its measured size allows it, else
both sides are shuffled, the documents once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import broadcast_measured, staged, text_or_empty

#: Characters between words, letters brought to lower case.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 13
#: Terms of a window whose lists are intersected; words that a near match may have more.
RAREST, SLOP = 3, 3
#: Stands behind the last word of every document, where no word can be.
_END = " "


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    lower = F.translate(text_or_empty(text), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lower, NO_WORD), "")


def item_windows(items: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """``item, window`` (array of words): all windows of an item, or its words if fewer."""
    cut = items.select(F.col(key).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (cut.select("item", "w", F.explode(starts).alias("s"))
            .select("item", F.slice("w", F.col("s"), F.lit(size)).alias("window")).distinct())


def documents_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, content`` tell rows apart; rows that repeat both count as one document."""
    return docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(F.col(text))).alias("content"),
                       words(F.col(text)).alias("w"))


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: how often each of ``terms`` occurs in the corpus."""
    tokens = documents.select(F.explode("w").alias("term"))
    return tokens.join(broadcast_measured(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def rarest_terms(windows: DataFrame, counts: DataFrame, most: int = RAREST) -> DataFrame:
    """``wid, rank, term, offset``: the rarest terms of each window, from rank 0 on.

    A window with a term that the corpus lacks has no occurrence and is left out.
    """
    terms = windows.select("wid", F.posexplode("window").alias("offset", "term")).groupBy("wid", "term").agg(
        F.min("offset").alias("offset"))
    counted = terms.join(counts, "term", "left").groupBy("wid").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("rare"))
    return counted.where(F.col("rare")[0]["n"] > 0).select("wid", F.posexplode(F.slice("rare", 1, most)).alias("rank", "r")).select(
        "wid", "rank", "r.term", "r.offset")


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, key, content, pos`` for every token that is one of ``terms``."""
    tokens = documents.select("key", "content", F.posexplode("w").alias("pos", "term"))
    return tokens.join(broadcast_measured(terms), "term", "left_semi").select("term", "key", "content", "pos")


@dataclass(frozen=True)
class Index:
    """Stored tables: ``item, wid``; ``wid, window, n``; rarest terms; postings; and one
    ``key, content, n_words`` for every row of the documents."""

    items: DataFrame
    windows: DataFrame
    rarest: DataFrame
    postings: DataFrame
    lengths: DataFrame

    def lists(self, rank: int) -> DataFrame:
        """The terms of a rank with their windows; bounded by the test items."""
        return broadcast_measured(self.rarest.where(F.col("rank") == rank).select("wid", "term", "offset"))


def build_index(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                item_key: str = "item_id", item_text: str = "text", size: int = WINDOW) -> Index:
    cut = staged(item_windows(items, item_key, item_text, size), "windows")
    windows = staged(cut.select("window").distinct().select(
        F.monotonically_increasing_id().alias("wid"), "window", F.size("window").alias("n")), "window-ids")
    documents = documents_of(docs, key, text)
    terms = staged(windows.select(F.explode("window").alias("term")).distinct(), "terms")
    rarest = staged(rarest_terms(windows, term_counts(documents, terms)), "rarest")
    sought = staged(rarest.select("term").union(docs.sparkSession.createDataFrame([(_END,)], "term string")).distinct(), "sought")
    named = staged(cut.join(windows, "window").select("item", "wid"), "items")
    # the lengths come with the tokens, so that texts are cut into words twice and no more
    ended = documents.withColumn("w", F.concat("w", F.array(F.lit(_END))))
    stored = staged(postings(ended, sought).withColumn("is_end", F.col("term") == _END), "postings", by="is_end")
    return Index(named, windows, rarest, stored.where("NOT is_end").drop("is_end"),
                 stored.where("is_end").select("key", "content", F.col("pos").cast("long").alias("n_words")))


def _same(key: str = "_key", content: str = "_content") -> Column:
    return F.col("key").eqNullSafe(F.col(key)) & (F.col("content") == F.col(content))


def phrase_places(index: Index) -> DataFrame:
    """``key, content, wid, start``: where all lists of a window meet at one start; stored."""
    found = index.postings.join(index.lists(0), "term").select(
        "wid", "key", "content", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    listed = index.postings.select("term", F.col("key").alias("_key"), F.col("content").alias("_content"), "pos")
    for rank in range(1, RAREST):
        following = index.lists(rank)
        asked = found.join(following, "wid")
        # the same start in the next list
        met = asked.join(listed, (asked["term"] == listed["term"]) & _same() & (asked["start"] + asked["offset"] == listed["pos"]),
                         "left_semi").select(*found.columns)
        found = met.unionByName(found.join(following, "wid", "left_anti"))  # short windows have fewer lists
    return staged(found.select("key", "content", "wid", "start").distinct(), "phrase-places")


def near_places(index: Index, slop: int = SLOP) -> DataFrame:
    """``key, content, wid, pos``: postings of a window's rarest term that have others of its
    rarest terms within ``slop`` more words than the window has; stored."""
    spans = index.windows.select("wid", (F.col("n") + slop).alias("span"))
    widest = spans.agg(F.max("span")).first()[0] or 1
    found = index.postings.join(index.lists(0), "term").join(broadcast_measured(spans), "wid").select("wid", "key", "content", "pos", "span")
    block = F.floor(F.col("pos") / widest)
    # a posting stands in its own block and in those beside it, so that near ones share one
    listed = index.postings.select("term", F.col("key").alias("_key"), F.col("content").alias("_content"), F.col("pos").alias("_pos"),
                                   F.explode(F.array(block - 1, block, block + 1)).alias("_block"))
    for rank in range(1, RAREST):
        following = index.lists(rank).select("wid", "term")
        asked = found.join(following, "wid").withColumn("block", block)
        met = asked.join(listed, (asked["term"] == listed["term"]) & _same() & (asked["block"] == listed["_block"])
                         & (F.abs(asked["pos"] - listed["_pos"]) < asked["span"]), "left_semi").select(*found.columns)
        found = met.unionByName(found.join(following, "wid", "left_anti"))
    return staged(found.select("key", "content", "wid", "pos").distinct(), "near-places")


def asked_documents(docs: DataFrame, places: list[DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, content, w`` of the documents with places, each once; stored."""
    asked = places[0].select("key", "content")
    for more in places[1:]:
        asked = asked.unionByName(more.select("key", "content"))
    asked = staged(asked.distinct().withColumnsRenamed({"key": "_key", "content": "_content"}), "asked")
    given = docs.select(F.col(key).alias("key"), F.xxhash64(text_or_empty(F.col(text))).alias("content"), F.col(text).alias("text"))
    met = given.join(broadcast_measured(asked), _same(), "left_semi")
    return staged(met.groupBy("key", "content").agg(F.first("text").alias("text")).select("key", "content", words(F.col("text")).alias("w")), "asked-words")


def _read(asked: DataFrame, places: DataFrame, index: Index) -> DataFrame:
    """Places with their window and the words of their document."""
    found = places.join(broadcast_measured(index.windows), "wid").withColumnsRenamed({"key": "_key", "content": "_content"})
    return asked.join(found, _same())


def phrase_matches(index: Index, places: DataFrame, asked: DataFrame) -> DataFrame:
    """``key, content, start, n, wid``: every occurrence of a window as a phrase."""
    read = _read(asked, places, index).where(F.slice("w", F.col("start") + 1, F.col("n")) == F.col("window"))
    return read.select("key", "content", "start", "n", "wid")


def proximity_matches(index: Index, places: DataFrame, asked: DataFrame, slop: int = SLOP) -> DataFrame:
    """``key, content, wid``: windows all of whose words stand in some run of ``slop`` more
    words than the window has; phrases among them."""
    span = F.col("n") + slop
    first = F.greatest(F.col("pos") - span + 2, F.lit(1))
    near = F.exists(F.sequence(first, F.col("pos") + 1), lambda s: F.size(F.array_except("window", F.slice("w", s, span))) == 0)
    return _read(asked, places, index).where(near).select("key", "content", "wid").distinct()


def _covered(spans: Column) -> Column:
    """Words covered by sorted ``(start, end)`` spans that may overlap."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["to"], s["end"]).alias("to"),
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"),
    ), lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", size: int = WINDOW,
                  share: int = 20, slop: int = SLOP) -> DataFrame:
    """One row per document: ``n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    A word is hit if it lies in an occurrence of a window; a document is contaminated if
    at least one in ``share`` of its words is hit. ``items`` lists the items with
    occurring windows as sorted strings; ``n_near`` counts the items with a window whose
    words stand near each other, phrases included. Null or empty texts have no words and are not
    contaminated; items without words match nothing; rows with equal key and text get
    equal results; a null key is a key like any other.
    """
    index = build_index(docs, items, key, text, item_key, item_text, size)
    phrases, close_by = phrase_places(index), near_places(index, slop)
    asked = asked_documents(docs, [phrases, close_by], key, text)
    matches = staged(phrase_matches(index, phrases, asked), "matches")
    near = staged(proximity_matches(index, close_by, asked, slop), "near")
    by = ["key", "content"]
    hits = matches.groupBy(*by).agg(F.collect_set(F.struct(
        F.col("start"), (F.col("start") + F.col("n")).alias("end"))).alias("spans"))
    hits = hits.select(*by, _covered(F.array_sort("spans")).cast("long").alias("n_hit"))
    found = matches.select(*by, "wid").distinct().join(index.items, "wid").select(*by, "item").distinct()
    found = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    close = near.join(index.items, "wid").select(*by, "item").distinct().groupBy(*by).agg(F.count("*").alias("n_near"))

    def with_more(left: DataFrame, right: DataFrame) -> DataFrame:
        more = right.withColumnsRenamed({"key": "_key", "content": "_content"})
        return left.join(more, _same(), "left").drop("_key", "_content")

    # every phrase is a near match
    per_document = with_more(with_more(close, hits), found).withColumnsRenamed({"key": "hit_key", "content": "hit_content"})
    counted = index.lengths
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.col("items"), none)
    return counted.join(per_document, _same("hit_key", "hit_content"), "left").select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), listed.alias("items"),
        F.col("content").alias("content_hash"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text", size: int = WINDOW,
                      share: int = 20) -> DataFrame:
    """``docs`` without its contaminated documents, all columns kept."""
    bad = staged(contamination(docs, items, key, text, item_key, item_text, size, share).where("contaminated").select(
        F.col(key).alias("_bad_key"), F.col("content_hash").alias("_bad_content")), "contaminated")
    same = F.col(key).eqNullSafe(F.col("_bad_key")) & (F.xxhash64(text_or_empty(F.col(text))) == F.col("_bad_content"))
    return docs.join(broadcast_measured(bad), same, "left_anti")
