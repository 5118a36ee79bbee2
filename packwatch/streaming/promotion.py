"""Promotion of claims as they come, in any order, with the tables that promotion of all at once would give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import promote as P
from .store import Batch, Store

#: Tables of results; ``claims``, ``by_event`` and ``by_variant`` hold the state between batches.
RESULTS = ["decided", "entities", "flags", "variants", "observations", "events", "folded"]
_EVENT = ["resolved", "old", "new"]
#: What is kept of every claim, and what some tables of results need besides.
_CLAIM = ["claim_id", "extracted_at", "key", "brand", "name", "category", "old", "new", "size_unit", "reason", "entity_id", "variant_id", "day", "blocked"]
_MORE = {"variants": ["known_variant", "upc"], "observations": ["retailer", "raw_item_id", "old_unit", "new_unit", "old_price", "new_price"]}
#: Names that are sent to all tasks at most; more of them meet their claims by a shuffle.
FEW = 100_000


class Promotion:
    """Promotes batches of claims against products, variants, events and raw items that were known before.

    A late claim may come first of its name, code or event, or bring an event evidence;
    so what a batch touches is done again, from the claims kept by name, then by event
    and variant: names of its claims (those they had before, too), then events and
    variants that claims of these names are in or were in.  Everything else stays as
    it is written.  A claim keeps the variant, day and image that were found when it
    came, and only columns that the wanted results need.  All tables of a batch take
    effect together.
    """

    def __init__(self, store: Store, entities: DataFrame, variants: DataFrame, events: DataFrame, raw_items: DataFrame, today: str, results: list[str] | None = None):
        """``results``: the tables to keep, all of RESULTS if not given; what only others need isn't kept either."""
        self.store, self.entities, self.variants, self.events, self.raw_items, self.today = store, entities, variants, events, raw_items, today
        self.results = RESULTS if results is None else results

    def run(self, stream: DataFrame, checkpoint: str, name: str = "claims"):
        """Promotes a stream of claims until its end; a batch that is run again changes nothing twice."""
        return stream.writeStream.foreachBatch(lambda rows, number: self.step(rows, number, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def step(self, claims: DataFrame, number: int, name: str = "claims") -> bool:
        """Promotes a batch; of a claim that comes again the latest batch counts, within one batch the last extracted.  False if the batch was done before."""
        batch = self.store.begin(name, number)
        if batch is None:
            return False
        held: list[DataFrame] = []

        def hold(frame: DataFrame) -> DataFrame:
            held.append(frame.persist())
            return held[-1]

        wanted = set(self.results)
        rest = [c for c in claims.columns if c not in ("claim_id", "extracted_at")]
        claims = claims.groupBy("claim_id").agg(F.max(F.struct("extracted_at", *rest)).alias("r")).select("claim_id", "r.*")
        rows = P.placed(P.prepared(claims), self.variants, self.raw_items, self.today)
        rows = hold(rows.select(*_CLAIM, *[c for name, more in _MORE.items() if name in wanted for c in more]))
        mine, names, before = self._names(batch, rows, hold)
        live = P.resolved(mine.where("reason is null"), self.entities, send=lambda keys: _sent(hold(keys)))
        live = hold(live if wanted & {"entities", "flags"} else live.select(*rows.columns, "resolved"))
        ids = mine.select("claim_id")
        batch.replace("claims", ["key"], names, self._kept(mine, live))

        sized = live.where("old is not null and new is not null").select("claim_id", "extracted_at", "key", "brand", "name", "size_unit", "variant_id", "day", "blocked", *_EVENT)
        touched = [sized.select(*_EVENT)] + ([before.where("resolved is not null and old is not null and new is not null").select(*_EVENT)] if before is not None else [])
        touched = hold(reduce(DataFrame.union, touched).distinct())
        by_event = hold(self._group(batch, "by_event", _EVENT, touched, sized, names))
        outcomes = hold(P.outcomes(by_event, self.events))
        made, folded = P.made_events(outcomes)
        event = ["entity_id", "size_before", "size_after"]
        events = touched.toDF(*event)
        if "events" in wanted:
            batch.replace("events", event, events, made)
        if "folded" in wanted:
            joined = outcomes.where("known_event is not null").groupBy("known_event").agg(*[F.any_value(c).alias(c) for c in _EVENT])
            folded = folded.join(joined, F.col("event_id") == F.col("known_event")).select(F.col("resolved").alias("entity_id"), F.col("old").alias("size_before"), F.col("new").alias("size_after"), "event_id", "more_evidence", "evidence")
            batch.replace("folded", event, events, folded)
        if "variants" in wanted:
            codes = [live.select("variant_id")] + ([before.where("resolved is not null").select("variant_id")] if before is not None else [])
            codes = hold(reduce(DataFrame.union, codes).distinct())
            batch.replace("variants", ["variant_id"], codes, P.made_variants(self._group(batch, "by_variant", ["variant_id"], codes, live, names)))
        if "decided" in wanted:
            unsized = live.where("old is null or new is null")
            decided = P.decisions(by_event.select("claim_id", "resolved", "variant_id").union(unsized.select("claim_id", "resolved", "variant_id")), outcomes).unionByName(P.refusals(mine))
            batch.replace("decided", ["claim_id"], ids.union(by_event.select("claim_id")), decided)
        if "observations" in wanted:
            batch.replace("observations", ["claim_id"], ids, P.made_observations(live))
        products = F.concat(F.lit("new-"), F.col("key"))
        if "entities" in wanted:
            batch.replace("entities", ["entity_id"], names.select(products.alias("entity_id")), P.made_entities(live).drop("claim_id"))
        if "flags" in wanted:
            batch.replace("flags", ["target"], names.select(products.alias("target")), P.suspect_flags(P.made_entities(live)))
        batch.commit()
        for frame in held:
            frame.unpersist()
        return True

    @staticmethod
    def _kept(mine: DataFrame, live: DataFrame) -> DataFrame:
        """The claims with what they resolved to, refused ones with null."""
        refused = mine.where("reason is not null").withColumn("resolved", F.lit(None).cast("string"))
        return live.select(*refused.columns).unionByName(refused)

    @staticmethod
    def _names(batch: Batch, rows: DataFrame, hold) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """All claims of the touched names, the names, and the claims as they stood before."""
        homes = batch.rows_of("homes", rows.select("claim_id"))
        if homes is not None:
            homes = hold(homes)
        again = homes is not None and not homes.isEmpty()
        names = rows.select("key").union(homes.select("key")) if again else rows.select("key")
        names = _sent(hold(names.distinct()))
        batch.replace("homes", ["claim_id"], rows.select("claim_id"), rows.select("claim_id", "key"))
        before = batch.rows_of("claims", names)
        if before is None:
            return rows, names, None
        before = hold(before)
        others = before.join(rows.select("claim_id"), "claim_id", "left_anti") if again else before
        return hold(others.select(*rows.columns).unionByName(rows)), names, before

    @staticmethod
    def _group(batch: Batch, name: str, keys: list[str], touched: DataFrame, now: DataFrame, names: DataFrame) -> DataFrame:
        """All claims of the touched groups: those of other names as kept, those of the touched names as they are now."""
        kept = batch.rows_of(name, touched)
        rows = now if kept is None else kept.join(names, "key", "left_anti").unionByName(now)
        batch.replace(name, keys, touched, rows)
        return rows

    def tables(self) -> dict[str, DataFrame]:
        """The results as of the last batch, with the columns of ``promote``."""
        out = {name: self.store.read(name) for name in self.results}
        return {name: frame.drop("entity_id", "size_before", "size_after") if name == "folded" else frame for name, frame in out.items()}


def _sent(held: DataFrame) -> DataFrame:
    """Held rows of names, sent to all tasks if they are few."""
    return F.broadcast(held) if held.limit(FEW + 1).count() <= FEW else held
