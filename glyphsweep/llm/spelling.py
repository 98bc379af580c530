"""Spelling variants: words one edit apart, found by a frontier that walks a trie of all words.

The trie is a table of edges. Only its forks and word ends are nodes, an edge holds the
letters up to the next of them, so long words cost no more levels than they have forks. A
state is a word, what is left of it, the node reached and whether its edit is used. All
states with the edit unused lie on the word's own path, which building the trie gives;
there an edit is spent in each place where it can lead anywhere: a letter replaced by
another edge of the node, or a letter of the word passed over. The other states step level
by level: a join with the edges on (node, next letter), kept if the edge's letters go on
like the word. What ends with its word on a word's end is a neighbour. A letter put in is
the same pair seen from the other word.

Nodes are named by 128-bit hashes of their prefixes, so no row holds a prefix; every
neighbour is compared letter by letter in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run in one of so many (document, run) pairs loses a letter.
SLIP = 199
LETTERS, OCCURRENCES = 6, 5
#: A form occurs at least so many times as often as its variant.
FORM_TIMES = 5
_ROWS = 1 << 15


def words_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``word, n``: the distinct words with their occurrences, slips applied."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"),
    ).select("key", F.translate("run", UPPER, LOWER).alias("run"))
    # a run's slip is the same in all of a document, so its repeats are counted first
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    size = F.char_length("run")
    at = F.pmod(h, size).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, size))
    slipped = runs.where(size >= LETTERS).select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return slipped.where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= OCCURRENCES)


# --- the trie -------------------------------------------------------------------------

def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, depth, node, letter`` for every prefix of every word; no letter at its end."""
    columns: tuple[list, ...] = ([], [], [], [])

    def batch_of() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.binary(), pa.string())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                         names=["id", "depth", "node", "letter"])
        for c in columns:
            c.clear()
        return out

    for batch in batches:
        for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            running = xxhash.xxh3_128()
            for depth, letter in enumerate((*word, "")):
                for column, value in zip(columns, (number, depth, running.digest(), letter), strict=True):
                    column.append(value)
                running.update(letter)
                if len(columns[0]) >= _ROWS:
                    yield batch_of()
    if columns[0]:
        yield batch_of()


def _left(text: str | Column, start: Column) -> Column:
    """What is left of a text from a position counted from 1."""
    text = F.col(text) if isinstance(text, str) else text
    return text.substr(start, F.greatest(F.char_length(text) - start + 1, F.lit(0)))


#: Words that meet the edges of a node in one task; the edges of nodes with more are repeated.
BLOCK = 10_000


def paths(words: DataFrame) -> DataFrame:
    """The words' own ways through the trie: ``id, node, letter, next, label, rest, salts``.

    One row for each fork or word end on the way: the letter that leads on (empty at the
    word's end), the next node, the letters up to it, what is left of the word, and in how
    many blocks the words of the node are dealt. ``words`` is the stored table ``id, word``.
    """
    steps = staged(words.select("id", "word").mapInArrow(_prefixes, "id long, depth int, node binary, letter string"), "prefixes")
    below = steps.where("depth > 0")
    forks = below.groupBy("node", "letter").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.count("*").alias("ways"), F.max((F.col("letter") == "").cast("int")).alias("ends"), F.sum("n").alias("n"))
    nodes = forks.where("ways > 1 OR ends = 1").select("node", F.ceil(F.col("n") / BLOCK).cast("int").alias("salts"))
    root = steps.where("depth = 0").withColumn("salts", F.lit(-(-words.count() // BLOCK) or 1))  # all words: no join
    on_way = below.join(nodes, "node").select(*root.columns).unionByName(root)
    ways = on_way.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "letter", "salts"))).alias("way"))
    spread = ways.join(words.select("id", "word"), "id").select("id", "word", F.posexplode("way").alias("i", "here"), "way").select(
        "id", "word", "here.node", "here.letter", "here.depth", "here.salts", F.get("way", F.col("i") + 1).alias("next"))
    return spread.select(
        "id", "node", "letter", F.col("next.node").alias("next"),
        F.col("word").substr(F.col("depth") + 1, F.coalesce(F.col("next.depth"), F.col("depth")) - F.col("depth")).alias("label"),
        _left("word", F.col("depth") + 1).alias("rest"), "salts")


# --- the frontier ---------------------------------------------------------------------

#: What follows where a word may end; no letter, so no word holds it.
_END = "."


def _letter(text: Column, at: Column | int) -> Column:
    """The letter at a position counted from 1, ``_END`` behind the last."""
    found = text.substr(F.lit(at) if isinstance(at, int) else at, F.lit(1))
    return F.when(found == "", F.lit(_END)).otherwise(found)


def trie_edges(way: DataFrame) -> DataFrame:
    """``node, salt, letter, next, tail, size, ahead, next_salts``, once for each block of
    the node's words: the letters behind the first one, their number with it, the letters
    that lead on from ``next`` and in how many blocks its words are."""
    # all words through an edge agree on its letters and its end
    edges = way.where("letter <> ''").groupBy("node", "letter").agg(
        F.min("next").alias("next"), F.min("label").alias("label"), F.max("salts").alias("salts"))
    onward = way.groupBy("node", "letter").agg(F.max("salts").alias("salts")).select(
        "node", F.when(F.col("letter") == "", F.lit(_END)).otherwise(F.col("letter")).alias("letter"), "salts")
    # a node has at most as many letters as the alphabet, under a hundred
    ahead = onward.groupBy(F.col("node").alias("next")).agg(
        F.array_join(F.array_sort(F.collect_list("letter")), "").alias("ahead"), F.max("salts").alias("next_salts"))
    return edges.join(ahead, "next").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "letter", "next",
        _left("label", F.lit(2)).alias("tail"), F.char_length("label").alias("size"), "ahead", "next_salts")


def _salt(salts: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(salts)).cast("int").alias("salt")


def neighbours(words: DataFrame) -> DataFrame:
    """``id, other``: both directions of every pair of words one edit apart.

    ``words`` is the stored table ``id, word`` of distinct words with unique numbers.
    """
    way = staged(paths(words), "paths")
    edges = staged(trie_edges(way), "edges")
    ends = way.where("letter = ''").select("node", F.col("id").alias("other"))
    inner = way.where("letter <> ''").select("id", "node", _salt("salts"), "letter", _left("rest", F.lit(2)).alias("behind"))
    # the edge's letters go on like the word, and its end like what is left then
    goes_on = F.startswith("behind", F.col("tail")) & F.contains("ahead", _letter(F.col("behind"), F.col("size")))
    landed = ("id", F.col("next").alias("node"), _salt("next_salts"), _left("behind", F.col("size")).alias("rest"))
    other = edges.withColumnRenamed("letter", "other_letter")
    replaced = inner.join(other, ["node", "salt"]).where((F.col("letter") != F.col("other_letter")) & goes_on).select(*landed)
    # of a run of equal letters the last is passed over, the others give the same word
    passed = inner.where(_letter(F.col("behind"), 1) != F.col("letter")).select("id", "node", "salt", F.col("behind").alias("rest"))
    states = staged(replaced.unionByName(passed), "frontier")
    found = None
    while states.take(1):
        ended = staged(states.where("rest = ''").join(ends, "node").select("id", "other"), "ended")
        found = ended if found is None else found.unionByName(ended)
        going = states.where("rest <> ''").select(
            "id", "node", "salt", F.col("rest").substr(1, 1).alias("letter"), _left("rest", F.lit(2)).alias("behind"))
        states = staged(going.join(edges, ["node", "salt", "letter"]).where(goes_on).select(*landed), "frontier")
    if found is None:
        return words.select("id", F.col("id").alias("other")).where("false")
    found = found.where("id <> other")
    both = found.unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    a, b = words.select("id", F.col("word").alias("wa")), words.select(F.col("id").alias("other"), F.col("word").alias("wb"))
    return both.join(a, "id").join(b, "other").where(F.levenshtein("wa", "wb", 1) == 1).select("id", "other")


def roots(forms: DataFrame) -> DataFrame:
    """``id, root``: the last word that forms lead to; ``forms`` holds ``id, form`` (ids).

    A form is more frequent than its word, so there are no circles; each round halves the
    way that is left.
    """
    ahead = staged(forms.select("id", F.col("form").alias("root")), "ahead")
    while True:
        onward = ahead.select(F.col("id").alias("root"), F.col("root").alias("further"))
        moved = staged(ahead.join(onward, "root", "left").select(
            "id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "ahead")
        ahead = moved.select("id", "root")
        if not moved.where("moved").take(1):
            return ahead


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    A null or empty text has no words; a null key counts as an empty one where slips are
    chosen; repeated rows count again. ``form`` is the most frequent near word (of equally
    frequent ones the first in code-point order) if it occurs five times as often or more,
    else null; ``root`` follows forms to the last. No other column is looked at, an empty
    table gives an empty result.
    """
    words = staged(words_of(docs, key, text).select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = staged(neighbours(words), "near")
    # the greatest n first, then the first in code-point order, which is byte order
    best = near.join(words.select(F.col("id").alias("other"), F.col("word").alias("near_word"), F.col("n").alias("near_n")), "other").groupBy(
        "id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near_word", "other")).alias("top"))
    judged = staged(words.join(best, "id", "left").withColumn(
        "has", F.coalesce(-F.col("top.less") >= FORM_TIMES * F.col("n"), F.lit(False))), "judged")
    last = roots(judged.where("has").select("id", F.col("top.other").alias("form")))
    names = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    named = judged.join(last, "id", "left").join(names, "root", "left")
    return named.select(
        "word", F.when(F.col("has"), F.col("top.near_word")).alias("form"), F.coalesce("root_word", "word").alias("root"),
        "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), -F.col("top.less")).alias("form_n"))
