"""Benchmark decontamination with a positional inverted index, in DataFrame functions alone.

Each run of ``window`` words of an item is represented by its two rarest words,
rare by their counts in the corpus.  The index holds the postings (document,
position) of these words only.  Lists are shifted by the word's place in the
item and intersected: where both words stand at the right distance, the words of
the document around that place are compared with the item's.  Words are looked
up in a fold that joins at least what the exact one joins; the last comparison is
exact.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import Kept

_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Test words up to which the tables on them are broadcast; beyond, they are shuffled.
BROADCAST_WORDS = 200_000
#: Documents with alignments up to which their keys, 8 bytes each, are broadcast; beyond, they are shuffled.
BROADCAST_KEYS = 100_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _NOT_WORD), "")


def _exact(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def _loose(text: Column) -> Column:
    """Lower-cases all letters, so that it joins what _exact joins; final sigma depends on what follows."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ς"), F.lit("σ"))


class Index:
    """Windows of the test items and the postings of their rarest words in the corpus."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None):
        if window < 1:
            raise ValueError("a window has at least one word")
        self.kept = kept = Kept(docs.sparkSession)
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep or []]).alias("rest"))
        self.docs = rows.withColumn("key", F.xxhash64("doc_id", "text"))
        items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.transform(_words(F.col(item_text)), _exact).alias("words"), _words(_loose(F.col(item_text))).alias("loose"))
        items = items.where(F.size("words") > 0).distinct()
        items = kept.keep(items.select(F.xxhash64("item_id", "words").alias("item"), "*", F.least(F.size("words"), F.lit(window)).alias("length")), "items")
        n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
        self.small = F.broadcast if n_words <= BROADCAST_WORDS else (lambda frame: frame)
        self.items = items

        at = items.select("item", "length", F.size("words").alias("n"), F.posexplode("loose").alias("place", "term"))
        terms = at.select("term").distinct()
        found = self.docs.select(F.explode(_words(_loose(F.col("text")))).alias("term")).join(self.small(terms), "term").groupBy("term").count()
        counts = kept.keep(found, "counts")
        starts = at.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("length") + 1), F.least(F.col("place"), F.col("n") - F.col("length")))).alias("start"))
        rarest = starts.join(counts, "term", "left").groupBy("item", "start").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "place", "term"))).alias("by_count"))
        first, second = F.col("by_count")[0], F.get("by_count", F.lit(1))
        # a window with a word that the corpus lacks stands nowhere
        pairs = rarest.where(first["count"] > 0).select("item", first["place"].alias("p"), F.coalesce(second["place"], first["place"]).alias("q"))
        self.pairs = kept.keep(pairs.distinct(), "pairs")
        places = self.pairs.select("item", "p").union(self.pairs.select("item", "q")).distinct()
        self.places = kept.keep(places.join(at.select("item", F.col("place").alias("p"), "term"), ["item", "p"]), "places")
        tokens = self.docs.select("key", F.posexplode(_words(_loose(F.col("text")))).alias("position", "term"))
        self.postings = kept.keep(tokens.join(self.small(self.places.select("term").distinct()), "term"), "postings")

    def _shifted(self) -> DataFrame:
        return self.postings.join(self.small(self.places), "term")

    def alignments(self) -> DataFrame:
        """Where an item would begin in a document, if the two rarest words of one of its windows stand right."""
        met = self._shifted().groupBy("key", "item", (F.col("position") - F.col("p")).alias("shift")).agg(F.collect_set("p").alias("found"))
        pairs = self.pairs.groupBy("item").agg(F.collect_list(F.struct("p", "q")).alias("pairs"))
        both = F.exists("pairs", lambda x: F.array_contains("found", x["p"]) & F.array_contains("found", x["q"]))
        return met.join(self.small(pairs), "item").where(both).select("key", "item", "shift")

    def phrases(self) -> DataFrame:
        """Per document: doc_id, n_words, n_hit, n_items, items (ids, sorted as strings), contaminated, text, rest."""
        found = self.alignments().join(self.small(self.items.select("item", "item_id", "words", "length")), "item")
        found = self.kept.keep(found.groupBy("key").agg(F.collect_list(F.struct("item_id", "shift", "words", "length")).alias("near")), "aligned")
        keys = F.broadcast if found.count() <= BROADCAST_KEYS else (lambda frame: frame)
        # only the texts of documents with alignments move; as a table, their words are split once and not anew for each place that is compared
        aligned = self.docs.select("key", "text").join(keys(found.select("key")), "key", "left_semi").select("key", _words(F.col("text")).alias("doc_words"))
        rows = self.kept.keep(aligned, "words").join(found, "key").withColumn("n_words", F.size("doc_words").cast("long"))

        def whole(x: Column) -> Column:
            """Starts, in the document, of the item's windows that stand there."""
            def stands(s: Column) -> Column:
                at = x["shift"] + s
                here = F.transform(F.slice("doc_words", at + 1, x["length"]), _exact)
                return F.when((at >= 0) & (at + x["length"] <= F.col("n_words")), here == F.slice(x["words"], s + 1, x["length"])).otherwise(F.lit(False))

            starts = F.filter(F.sequence(F.lit(0), F.size(x["words"]) - x["length"]), stands)
            return F.struct(x["item_id"].alias("item_id"), F.flatten(F.transform(starts, lambda s: F.sequence(x["shift"] + s, x["shift"] + s + x["length"] - 1))).alias("places"))

        hits = F.filter(F.transform("near", whole), lambda x: F.size(x["places"]) > 0)
        rows = self.kept.keep(rows.select("key", hits.alias("hits")), "hits")
        n_hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["places"])))).cast("long")
        hit = rows.where(F.size("hits") > 0).groupBy("key").agg(F.any_value(F.struct(n_hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"]))).alias("items"))).alias("found"))
        rows = self.docs.withColumn("n_words", F.size(_words(F.col("text"))).cast("long")).join(keys(hit), "key", "left")
        items = F.coalesce("found.items", F.array().cast("array<string>"))
        rows = rows.select("doc_id", "n_words", F.coalesce("found.n_hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"), "text", "rest")
        return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "text", "rest")

    def near(self, within: int) -> DataFrame:
        """doc_id, item_id, each pair once: the two rarest words of a window stand at most ``within`` words apart, in any order.

        An item of one word is near itself wherever it stands; two equal words need two
        places.  Only neighbours in the document are compared, so ties add nothing.  Documents and
        items without words have no rows; a null doc_id comes back as null.
        """
        ends = self.pairs.select("item", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("place"))
        terms = ends.join(self.places.select("item", F.col("p").alias("place"), "term"), ["item", "place"])
        rows = self.postings.join(self.small(terms), "term")
        order = Window.partitionBy("key", "item", "p", "q").orderBy("position", "place")
        rows = rows.select("*", F.lag("place").over(order).alias("place_before"), F.lag("position").over(order).alias("position_before"))
        close = (F.col("p") == F.col("q")) | ((F.col("place") != F.col("place_before")) & (F.col("position") - F.col("position_before")).between(1, within))
        hits = rows.where(close).select("key", "item").distinct().join(self.small(self.items.select("item", "item_id")), "item")
        return self.docs.select("key", "doc_id").distinct().join(hits, "key").select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None, **columns: str) -> DataFrame:
    """Documents with passages of test items.

    docs, benchmark: any frames with an id and a text each; other columns are
    ignored.  Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased.  A window is ``window`` words of an item in a row; an item of
    fewer words, but not none, is one window.
    Returns per document: doc_id, n_words, n_hit (words inside any occurrence of
    any window), n_items, items (ids of items with occurring windows, as strings,
    sorted), contaminated, text, rest (a struct of the columns in ``keep``).  Null or empty texts have no words; items without an id
    are ignored, items that share one count once; rows of documents that share an
    id keep their own rows.  With no items, nothing is hit.
    """
    return Index(docs, benchmark, window, keep=keep, **columns).phrases()
