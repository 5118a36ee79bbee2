"""Finding texts that hold others, through postings of their runs of three characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3


def grams(text: Column, size: Column | int = GRAM) -> Column:
    """The distinct runs of so many characters; none where the text is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def holding(wanted: DataFrame, texts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of a wanted text and a text that holds it, in any case; with keys, only those that agree in them.

    wanted: keys, ``wanted``; texts: keys, ``id``, ``text``.  Returns keys, wanted, id,
    text (as given).  A wanted text is looked up by the rarest of its runs of three
    characters (of itself where it is shorter), and what is found is compared; so texts
    meet only wanted ones they share a rare run with, not all of them.  Null or empty
    wanted texts hold nothing, equal ones count once.
    """
    keys = keys or []
    wanted = wanted.select(*keys, F.lower("wanted").alias("wanted")).where("wanted <> ''").distinct()
    size = F.least(F.length("wanted"), F.lit(GRAM))
    asked = wanted.select(*keys, "wanted", F.explode(grams(F.col("wanted"), size)).alias("gram"))
    sizes = asked.select(F.length("gram").alias("size")).distinct()  # of 1, 2, 3 those that occur
    lower = texts.select(*keys, "id", "text", F.lower("text").alias("low"))
    postings = lower.select(*keys, "id", "low").crossJoin(F.broadcast(sizes)).select(*keys, "id", F.explode(grams(F.col("low"), F.col("size"))).alias("gram"))  # three rows of sizes at most
    postings = postings.join(asked.select(*keys, "gram").distinct(), [*keys, "gram"], "left_semi")
    counts = postings.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    # a run that no text has decides at once: the inner join would leave it out, so it counts 0
    rarest = asked.join(counts, [*keys, "gram"], "left").groupBy(*keys, "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select(*keys, "wanted", F.col("r.gram").alias("gram"))
    met = rarest.join(postings, [*keys, "gram"]).select(*keys, "wanted", "id")
    return met.join(lower, [*keys, "id"]).where(F.contains("low", "wanted")).select(*keys, "wanted", "id", "text")
