"""Components over posting lists without all pairs of a list: shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import scratch, written
from ragloom.llm.components import components

#: Members of a list's most frequent component that its other members meet in a turn, and turns at most before all remaining pairs.
CENTRES, TURNS = 2, 2
#: Neighbours that a member of a list meets in the first turn; rows of a list that are put in order together; members up to which a list's remaining pairs
#: all meet where there is an exact bound for longer lists.
NEIGHBOURS, DEALT, SHORT = 3, 500, 100


def fact(row: str | Column, column: str) -> Column:
    """A column of an aliased row or a field of a struct."""
    return F.col(f"{row}.{column}") if isinstance(row, str) else row[column]


def linked_components(lists: DataFrame, facts: list[str], likely: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], name: str, rest: Callable[[DataFrame], DataFrame] | None = None, once: Callable[[str, str], Column] | None = None, across: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of every node with a confirmed link; the components are those of all confirmed pairs that share a list.

    lists: rows (key, node, rank, *facts), read more than once, so written beforehand. rank: how typical a node is of the lists that it
    is in (the same in all of them); the most typical meet others first. likely(x, y): a condition on the facts of two aliased rows.
    confirm(pairs): the rows of (a, b) that are links. rest(nodes): of nodes (node, label, leads), the pairs (aliased x
    and y; x leads, labels differ) that an exact bound does not rule out, in place of the last step's pairs of lists of over SHORT.
    once(x, y): of the lists that a likely pair shares, true in one at least; the last step leaves the others out. across(rows): in place of the last step's pairs
    of lists of over SHORT, the links (a, b) between members of these lists (rows with label and modal) whose labels differ, without a row for
    each pair. Pairs are not confirmed twice but by across.

    First every member of a list meets its most typical member. Then turns follow in the lists whose members still lie in several
    components: in the first, members meet their NEIGHBOURS in order of the first fact (a length or size); after that, members outside
    the list's most frequent component meet its next most typical members; components are made anew in each. As rank is the same in all lists, the members of a group meet the same few nodes in each list that they share. Last,
    what is left meets all members of other components, in long lists those that rest leaves. Two members of one component need not meet, so the result is that of all pairs,
    while a list of m near copies costs about m pairs a turn, not m * m.
    """
    spark = lists.sparkSession
    with scratch(spark):
        row, order = F.struct("node", *facts), F.struct("rank", F.xxhash64("node"))
        heads = lists.groupBy("key").agg(F.max_by(row, order).alias("h"), F.count("*").alias("members")).where("members > 1").select("key", "h.*")
        met = heads.alias("x").join(lists.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & likely("x", "y"))
        tried: list[DataFrame] = []

        def fresh(met: DataFrame, step: str) -> DataFrame:
            """The pairs (a, b) of `met` (aliased x, y) but for those tried; they are tried then."""
            pairs = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
            for known in tried:
                pairs = pairs.join(known, ["a", "b"], "left_anti")
            tried.append(written(pairs, f"{step}-pairs"))
            return tried[-1]

        links, labels = _links(fresh(met, f"{name}-0"), confirm, None, f"{name}-0")

        def parted(rows: DataFrame, labels: DataFrame) -> DataFrame:
            """The rows, with their label, of lists that lie in several components; modal: the most frequent of these."""
            marked = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            sizes = marked.groupBy("key", "label").count()
            # a list of two has met
            modal = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("modal"), F.sum("count").alias("members"), F.count("*").alias("parts")).where("parts > 1 AND members > 2")
            return marked.join(modal.select("key", "modal", "members"), "key")

        left = lists
        for turn in range(1, TURNS + 1):
            left = written(parted(left.select("key", "node", "rank", *facts), labels), f"{name}-left")
            cost = left.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("label") != F.col("modal"), F.col("members"))).alias("pairs")).first()
            if not cost["rows"]:
                return written(labels, f"{name}-done", up=1)
            if cost["pairs"] <= 4 * cost["rows"] or turn == TURNS:
                break
            if turn == 1:
                # long lists are dealt into groups of about DEALT
                group = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("members") / DEALT))
                w = Window.partitionBy("key", group).orderBy(facts[0], "node")
                row = F.struct("node", "label", *facts)
                met = left.select(row.alias("x"), F.array(*(F.lead(row, i).over(w) for i in range(1, NEIGHBOURS + 1))).alias("next")).select("x", F.explode("next").alias("y")).where((F.col("x.label") != F.col("y.label")) & likely("x", "y"))
            else:
                place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("rank"), F.xxhash64("node"), "node"))
                best = left.where("label = modal").select("key", "node", "rank", *facts).withColumn("place", place).where(F.col("place") <= CENTRES * (turn - 1) + 1)
                centres = best.where(F.col("place") > CENTRES * (turn - 2) + 1).drop("place")
                met = centres.alias("x").join(left.where("label <> modal").alias("y"), (F.col("x.key") == F.col("y.key")) & likely("x", "y"))
            links, labels = _links(fresh(met, f"{name}-{turn}"), confirm, links, f"{name}-{turn}")

        # between two outsiders the smaller node leads; with a member of the most frequent component the outsider does
        meets = (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.modal")) | (F.col("x.node") < F.col("y.node")))
        short = left.where(F.col("members") <= SHORT) if rest or across else left
        # a list is left out only where its members have one label or all have met, so the one list of a pair is there wherever the pair is new
        apart = meets & likely("x", "y") & once("x", "y") if once else meets & likely("x", "y")
        met = short.where("label <> modal").alias("x").join(short.alias("y"), apart)
        links, labels = _links(fresh(met, f"{name}-all"), confirm, links, f"{name}-all")
        long = left.where(F.col("members") > SHORT)
        if across and not long.isEmpty():
            apart = parted(long.select("key", "node", *facts), labels)
            links = written(across(apart).unionByName(links).distinct(), f"{name}-across")
            labels = components(links, name=f"{name}-across-labels")
        if rest and not long.isEmpty():
            nodes = long.groupBy("node").agg(F.max(F.col("label") != F.col("modal")).alias("leads")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            links, labels = _links(fresh(rest(nodes), f"{name}-apart"), confirm, links, f"{name}-apart")
        return written(labels, f"{name}-done", up=1)


def _links(pairs: DataFrame, confirm, before: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame]:
    """The confirmed of the pairs (a, b), and those of before; the components of both."""
    links = confirm(pairs).select("a", "b")
    links = written(links if before is None else links.unionByName(before), f"{name}-links")
    return links, components(links, name=f"{name}-labels")
