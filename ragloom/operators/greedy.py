"""Sequential folds as distributed steps: greedy acceptance over a link table (15.1), least-loaded assignment (15.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.sequences import numbered
from ragloom.plans.storage import stored


def greedy_accept(rows: DataFrame, links: DataFrame, id_col: str, base: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """What a fold in order of the ids accepts when a row goes that is linked to an accepted one before it (15.1); links left per round.

    rows: id_col, other columns pass through. links: a, b in either direction. base: ids (id_col) that are accepted beforehand, whatever
    their order. Adds accepted, blocked_by (the first accepted row that it is linked to: of the base, else of the rows) and round.

    The fold's result is the lexicographically first maximal independent set. In each round the rows without an open link to an earlier
    row are accepted at once, and their later neighbours go; a round is two joins over the links still open, which are written, so that
    no lineage grows and nothing is gathered. In an order that has nothing to do with the links the rounds grow with the logarithm of
    the rows; a chain of links in order takes one for each second row.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    refused = None
    if base is not None:
        held = base.select(F.col(id_col).alias("held")).distinct()
        both = pairs.select("low", "high").unionByName(pairs.select(F.col("high").alias("low"), F.col("low").alias("high")))
        refused = stored(both.join(held, both["low"] == held["held"], "left_semi").join(held, both["high"] == held["held"], "left_anti").groupBy(F.col("high").alias("id")).agg(F.min("low").alias("blocked_by")).withColumn("round", F.lit(0)), "refused")
        for side in ("low", "high"):
            pairs = pairs.join(held, pairs[side] == held["held"], "left_anti").join(refused.select(F.col("id").alias("gone")), F.col(side) == F.col("gone"), "left_anti")
    pairs = stored(pairs, "links")
    open_, rounds, going = pairs, [pairs.count()], []
    while rounds[-1]:
        first = open_.select(F.col("low").alias("id")).distinct().join(open_.select(F.col("high").alias("id")).distinct(), "id", "left_anti")
        out = stored(open_.join(first, open_["low"] == first["id"], "left_semi").select(F.col("high").alias("id")).distinct().withColumn("round", F.lit(len(rounds))), "refused")
        going.append(out)
        gone = out.select(F.col("id").alias("gone"))
        # a link is settled when its later row is gone, or its earlier one is accepted (then the later is gone) or gone
        open_ = stored(open_.join(gone, open_["high"] == gone["gone"], "left_anti").join(gone, open_["low"] == gone["gone"], "left_anti"), "links")
        rounds.append(open_.count())
    later = None
    for out in going:
        later = out if later is None else later.unionByName(out)
    if later is not None:
        lost = stored(later, "refused")
        kept = pairs.join(lost, pairs["low"] == lost["id"], "left_anti")
        by = lost.join(kept, lost["id"] == kept["high"]).groupBy("id", "round").agg(F.min("low").alias("blocked_by")).select("id", "blocked_by", "round")
        refused = by if refused is None else refused.unionByName(by)
    if refused is None:
        return rows.select("*", F.lit(True).alias("accepted"), F.lit(None).cast(rows.schema[id_col].dataType).alias("blocked_by"), F.lit(None).cast("int").alias("round")), rounds
    done = rows.join(refused.withColumnRenamed("id", "_id"), rows[id_col] == F.col("_id"), "left")
    return done.select(*rows.columns, F.col("_id").isNull().alias("accepted"), "blocked_by", "round"), rounds


def least_loaded(requests: DataFrame, sources: DataFrame, *, key: str, order: str, source: str, load: str, tie: str) -> DataFrame:
    """requests with the source that a fold would give each (15.2): in `order`, the source of least load, which then grows by one.

    sources: key, source, load (0 or more) and `tie`, by which equal loads are ordered, then by source. A source's slots are its loads from
    now on; the fold takes the slots of a key in the order (load, tie, source). So the i-th request of a key gets the i-th slot: slots and
    requests are numbered by range partitions and joined, and no task holds a key. How high the loads rise is found from the histogram
    of loads, so no more slots are made than there are requests. Keys without a source give null; null keys and loads take no part.
    """
    asks = numbered(requests.where(F.col(key).isNotNull()), key, order)
    counts = asks.groupBy(key).agg(F.count("*").alias("_asks"))
    held = sources.where(F.col(key).isNotNull() & F.col(load).isNotNull())
    # with the loads in order: up to the next load, the sources so far share what is asked for
    by = Window.partitionBy(key).orderBy(load)
    steps = held.groupBy(key, load).agg(F.count("*").alias("_at")).withColumn("_sources", F.sum("_at").over(by)).withColumn("_sum", F.sum(F.col("_at") * F.col(load)).over(by))
    steps = steps.join(counts, key).withColumn("_below", F.col("_sources") * F.col(load) - F.col("_sum")).where("_below < _asks")
    # the highest load that is reached, and how many of its slots are taken
    level = steps.groupBy(key).agg(F.max(F.struct(load, "_sources", "_below", "_asks")).alias("_s")).select(key, F.expr(f"_s.{load} + (_s._asks - _s._below - 1) div _s._sources").alias("_level"))
    slots = held.join(level, key).where(F.col(load) <= F.col("_level")).select(key, F.col(source).alias("source"), F.col(tie).alias("_tie"), F.explode(F.sequence(F.col(load), F.col("_level"))).alias("load_before"))
    slots = numbered(slots.withColumn("_slot", F.struct("load_before", "_tie", "source")), key, "_slot").select(F.col(key).alias("_key"), F.col("position").alias("_position"), "source", "load_before")
    given = asks.join(slots, (F.col(key) == F.col("_key")) & (F.col("position") == F.col("_position")), "left")
    return given.select(*requests.columns, "source", "load_before")
