"""Retractions that follow from one another: claims to events, events to products, products to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Store


class Catalogue:
    """Claims, events and products in a store, kept true by what each change brings with it.

    An event whose claims are all discarded is retracted; a product that loses its last
    live event is retracted; a product that is retracted takes its events with it.
    Each step starts from what changed and reads the rows of the touched claims, events
    and products alone.  Tables: ``links`` by claim, ``backing`` (the claims behind each
    event, with their status) by event, ``events`` and ``products`` by product.
    """

    def __init__(self, store: Store):
        self.store = store

    def load(self, claims: DataFrame, events: DataFrame, links: DataFrame, products: DataFrame) -> None:
        """The first version.  claims: claim_id, status; events: event_id, entity_id, is_retracted; links: event_id, claim_id; products: entity_id, is_retracted."""
        batch = self.store.begin("load", 0)
        if batch is None:
            return
        links = links.select("event_id", "claim_id").distinct()
        backing = links.join(claims.select("claim_id", "status"), "claim_id").join(events.select("event_id", "entity_id"), "event_id").select("event_id", "claim_id", "status", "entity_id")
        for name, keys, rows in (("links", ["claim_id"], links), ("backing", ["event_id"], backing), ("events", ["entity_id"], events.select("event_id", "entity_id", "is_retracted")), ("products", ["entity_id"], products.select("entity_id", "is_retracted"))):
            batch.replace(name, keys, rows, rows)
        batch.commit()

    def step(self, number: int, claims: DataFrame | None = None, gone_events: DataFrame | None = None, gone_products: DataFrame | None = None) -> bool:
        """Applies changed claims (claim_id, status) and retractions (event_id, entity_id; entity_id) with all that follows.  False if the batch was done before.

        What has no live event from the start, or gets a claim back, stays as it is:
        only the change to retracted goes on.
        """
        batch, spark = self.store.begin("changes", number), self.store.spark
        if batch is None:
            return False
        events = spark.createDataFrame([], "event_id string, entity_id long") if gone_events is None else gone_events
        products = spark.createDataFrame([], "entity_id long") if gone_products is None else gone_products
        if claims is not None:
            met = batch.rows_of("links", claims).select("event_id").distinct().persist()
            backing = batch.rows_of("backing", met).join(claims.select("claim_id", F.col("status").alias("now")), "claim_id", "left").select("event_id", "claim_id", F.coalesce("now", "status").alias("status"), "entity_id").persist()
            batch.replace("backing", ["event_id"], met, backing)
            bare = backing.groupBy("event_id", "entity_id").agg(F.bool_and(F.col("status") == "discarded").alias("bare")).where("bare").drop("bare")
            events = events.unionByName(bare)
        events = events.distinct().persist()
        touched = events.select("entity_id").union(products.select("entity_id")).distinct().persist()

        taken = products.select("entity_id", F.lit(True).alias("taken")).distinct()
        mine = batch.rows_of("events", touched).join(events.select("event_id", F.lit(True).alias("named")), "event_id", "left").join(taken, "entity_id", "left")
        goes = ~F.col("is_retracted") & (F.coalesce("named", F.lit(False)) | F.coalesce("taken", F.lit(False)))
        mine = mine.select("event_id", "entity_id", (F.col("is_retracted") | goes).alias("is_retracted"), goes.alias("goes")).persist()
        batch.replace("events", ["entity_id"], touched, mine.drop("goes"))
        lost = mine.groupBy("entity_id").agg((F.bool_or("goes") & F.bool_and("is_retracted")).alias("lost"))
        # a product that goes for want of live events has none left to take along, so the cascade ends here
        own = batch.rows_of("products", touched).join(lost, "entity_id", "left").join(taken, "entity_id", "left")
        batch.replace("products", ["entity_id"], touched, own.select("entity_id", (F.col("is_retracted") | F.coalesce("lost", F.lit(False)) | F.coalesce("taken", F.lit(False))).alias("is_retracted")))
        batch.commit()
        for frame in (events, touched, mine):
            frame.unpersist()
        return True
