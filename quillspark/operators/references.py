"""Results that a conversation has been shown, and which of them a later turn means.

A registration (conversation, turn, results) gives each result its place in the list as ordinal. A reference
(conversation, turn, kind, ordinal) means a result of the latest set registered before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.asof import as_of


def registered(registrations: DataFrame) -> DataFrame:
    """(conversation, turn, ordinal, ref, price, why) of results as array<struct<ref, price, trusted>>.

    `why` is null for a result that counts; else untrusted_or_unidentified, or duplicate_identity where a trusted
    result of the conversation had that identity before (an earlier turn, or an earlier place of one).
    """
    x = registrations.select("conversation", "turn", F.posexplode("results").alias("pos", "r")).select("conversation", "turn", (F.col("pos") + 1).alias("ordinal"), "r.ref", "r.price", F.coalesce(F.col("r.trusted") & (F.col("r.ref") != ""), F.lit(False)).alias("fit"))
    first = x.where("fit").groupBy("conversation", "ref").agg(F.min(F.struct("turn", "ordinal")).alias("first"))
    x = x.join(first, ["conversation", "ref"], "left")
    why = F.when(~F.col("fit"), "untrusted_or_unidentified").when(F.struct("turn", "ordinal") != F.col("first"), "duplicate_identity")
    return x.select("conversation", "turn", "ordinal", "ref", "price", why.alias("why"))


def looked_up(references: DataFrame, results: DataFrame) -> DataFrame:
    """(conversation, turn, ref, why) of references to registered results.

    An ordinal takes the counting result at that place of the latest set, `cheapest` its only cheapest one. `why`
    is no_results before the first set, else not_uniquely_resolved where there isn't exactly one. Sets with no
    counting result are sets as well.
    """
    sets = results.groupBy("conversation", "turn").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("why").isNull(), F.struct("ordinal", "ref")))).alias("places"),  # one list's results
        F.array_sort(F.collect_list(F.when(F.col("why").isNull() & F.col("price").isNotNull(), F.struct("price", "ref")))).alias("priced"),
    )
    x = as_of(references.select("conversation", "turn", "kind", "ordinal"), sets, ["conversation"], ["turn"], ["places", "priced"])
    priced = F.col("found.priced")
    least = F.filter(priced, lambda p: p["price"] == F.get(priced, F.lit(0))["price"])
    cheapest = F.when(F.size(least) == 1, F.get(least, F.lit(0))["ref"])
    hit = F.when(F.col("kind") == "ordinal", F.try_element_at("found.places", F.col("ordinal"))).when(F.col("kind") == "cheapest", cheapest)
    why = F.when(F.col("found").isNull(), "no_results").when(hit.isNull(), "not_uniquely_resolved")
    return x.select("conversation", "turn", hit.alias("ref"), why.alias("why"))
