"""A log of admin actions replayed as sets: approvals, edits, discards, merges and what undoes them.

The outcome is that of the actions one after the other in the order of ``seq``,
without those that are undone; no action is applied one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import kept

#: What an action makes of a claim's status.
STATUS = {"approve": "matched", "evidence": "evidence", "discard": "discarded"}
FIELDS = ["brand", "product_name"]


def effective(actions: DataFrame) -> DataFrame:
    """The actions that count: those that no counting undo names.

    actions: seq (distinct), kind, undoes (the earlier seq that an undo takes back), and
    more columns.  An undo can be undone; one that names no earlier action does nothing.
    Undos are settled from those that none names; rounds are as many as undos in a chain.
    """
    undos = actions.where("kind = 'undo' and undoes < seq").select("seq", "undoes")
    undos = kept(undos.join(actions.select(F.col("seq").alias("undoes")), "undoes", "left_semi"))
    counts = undos.select("seq", F.lit(None).cast("boolean").alias("counts"))  # null: not settled
    while True:
        named = undos.join(counts, "seq").select(F.col("undoes").alias("seq"), "counts")
        by = named.groupBy("seq").agg(F.bool_or(F.coalesce("counts", F.lit(False))).alias("undone"), F.bool_or(F.col("counts").isNull()).alias("waits"))
        settled = F.when(F.coalesce("undone", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)
        counts = kept(counts.select("seq").join(by, "seq", "left").select("seq", settled.alias("counts")))
        if counts.where("counts is null").isEmpty():
            break
    undone = undos.join(counts.where("counts"), "seq").select(F.col("undoes").alias("seq")).distinct()
    return actions.where("kind <> 'undo'").join(undone, "seq", "left_anti")


def merge_ends(merges: DataFrame) -> DataFrame:
    """Where what a merge moves ends up: seq, source, end, last (the source of the last merge on the way).

    merges: seq, source, target.  What stands at a target moves on with its next later
    merge; chains are followed by doubling, in rounds that grow with their logarithm.
    """
    points = merges.select("seq", F.col("target").alias("at"), F.lit(None).cast("long").alias("leaves")).union(merges.select("seq", F.col("source").alias("at"), F.col("seq").alias("leaves")))
    after = Window.partitionBy("at").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nexts = points.withColumn("next", F.min("leaves").over(after)).where("leaves is null").select("seq", "next")
    ends = kept(merges.join(nexts, "seq").select("seq", "source", F.col("target").alias("end"), F.col("source").alias("last"), "next"))
    while not ends.where("next is not null").isEmpty():
        further = ends.select(F.col("seq").alias("next"), F.col("end").alias("e"), F.col("last").alias("l"), F.col("next").alias("n"))
        joined = ends.join(further, "next", "left")
        ends = kept(joined.select("seq", "source", F.coalesce("e", "end").alias("end"), F.coalesce("l", "last").alias("last"), F.col("n").alias("next")))
    return ends.select("seq", "source", "end", "last")


def replay(claims: DataFrame, products: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and products after a log of actions.

    claims: claim_id, status, entity_id, brand, product_name; products: entity_id,
    is_retracted.  actions: seq, kind, claim_id, value, entity_id, source, target,
    undoes.  approve sets the status to matched and the product to ``entity_id``;
    evidence and discard set the status; edit_brand and edit_product_name set a field
    to ``value``; merge moves every claim that is then at ``source`` to ``target`` and
    retracts the source (not if both are one); undo takes an action back as if it had
    never been.  Of actions on a claim the last of its kind counts.  Claims also return
    previous_entity_id, the product that the last merge moved them from.
    """
    todo = kept(effective(actions))
    on_claim = todo.where(F.col("kind") != "merge").groupBy("claim_id").agg(
        F.max_by("kind", F.when(F.col("kind").isin(*STATUS), F.col("seq"))).alias("last_kind"),
        F.max(F.when(F.col("kind") == "approve", F.struct("seq", "entity_id"))).alias("approved"),
        *[F.max(F.when(F.col("kind") == f"edit_{f}", F.struct("seq", "value"))).alias(f"new_{f}") for f in FIELDS],
    )
    rows = claims.join(on_claim, "claim_id", "left")
    status = F.col("status")
    for kind, value in STATUS.items():
        status = F.when(F.col("last_kind") == kind, value).otherwise(status)
    fields = {f: F.when(F.col(f"new_{f}").isNotNull(), F.col(f"new_{f}.value")).otherwise(F.col(f)) for f in FIELDS}
    rows = rows.withColumns({"status": status, **fields, "since": F.coalesce("approved.seq", F.lit(-1)), "entity_id": F.when(F.col("approved").isNotNull(), F.col("approved.entity_id")).otherwise(F.col("entity_id"))})
    rows = rows.select("claim_id", "status", "entity_id", *FIELDS, "since")

    merges = todo.where("kind = 'merge' and source <> target").select("seq", "source", "target")
    ends = merge_ends(merges)
    first = ends.join(ends.groupBy("source").agg(F.min("seq").alias("seq")), ["source", "seq"]).select(F.col("source").alias("entity_id"), "end", "last")
    early, late = rows.where("since < 0"), rows.where("since >= 0")  # claims that were never approved here move with a product's first merge
    moved = early.join(first, "entity_id", "left")
    leaves = late.select("claim_id", "entity_id", "since").join(ends, F.col("entity_id") == F.col("source")).where(F.col("seq") > F.col("since")).groupBy("claim_id").agg(F.min_by(F.struct("end", "last"), "seq").alias("r")).select("claim_id", "r.*")
    out = moved.unionByName(late.join(leaves, "claim_id", "left"))
    out = out.select("claim_id", "status", F.coalesce("end", "entity_id").alias("entity_id"), F.col("last").alias("previous_entity_id"), *FIELDS)
    gone = merges.select(F.col("source").alias("entity_id"), F.lit(True).alias("gone")).distinct()
    return out, products.join(gone, "entity_id", "left").withColumn("is_retracted", F.col("is_retracted") | F.coalesce("gone", F.lit(False))).drop("gone")
