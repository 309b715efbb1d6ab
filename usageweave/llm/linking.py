"""Groups of linked nodes, found by comparing few of the pairs that share a key.

Nodes that link share a key. Members of a large group all share keys with each other, so
not all pairs are looked at. In turns, one node is picked for each key that still holds
several groups, and nodes are compared with the picked of their keys that are in other
groups; in the first turn, in which all are, with that one only that they share most keys
with. Turns go on while at least one in a hundred of the pairs they compare links.
A large family of near copies so costs a few comparisons a member.

What is left are nodes whose keys still hold several groups, many of them in families of
copies that are not quite near enough to link. Most of what two of these sets have in common
they have in common with the whole family, so they are told apart by what they don't: the
core of a family are the elements that more than half of its sets hold, the edits of a set
those elements that only it or the core holds. With d(x, y) elements in one of two sets only,
d(x, y) = edits(x) + edits(y) - 2 * (edits of both). Pairs that link even without an edit in
common both link with the set of fewest edits for its size, which is compared with those.
All others have to share so many edits that they share one of the first of each, rarest
first (a prefix filter), and only pairs that do are compared. No link between groups is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageweave.llm.blocks import unpacked
from usageweave.llm.components import components
from usageweave.llm.shared import stored


def several(postings: DataFrame) -> DataFrame:
    """The ``postings`` (key, node, ...) of keys that several nodes have."""
    keys = postings.groupBy("key").agg(F.count("*").alias("nodes")).where("nodes > 1")
    return postings.join(keys.select("key"), "key")


def beside(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b, ...) with the ``columns`` of both nodes of ``rows`` (node, ...), as
    ``a_`` and ``b_`` and their names. Of rows only those of the pairs are dealt out twice.
    """
    ends = [pairs.select(F.col(end).alias("node")) for end in "ab"]
    nodes = ends[0].unionByName(ends[1]).distinct()
    own = rows.select("node", *columns).join(nodes, "node", "left_semi")
    for end in "ab":
        names = [F.col(c).alias(f"{end}_{c}") for c in columns]
        pairs = pairs.join(own.select(F.col("node").alias(end), *names), end)
    return pairs


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of packed sets as lists of numbers."""
    for batch in batches:
        own = [unpacked(k.as_py()).astype(np.int64) for k in batch.column("keys")]
        lists = pa.array(own, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("family"), lists], ["family", "elements"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that only a set or its family's core holds, and how many these are with
    those that stand ``alone`` in no other set.
    """
    for batch in batches:
        edits = []
        for own, core in zip(batch.column("keys"), batch.column("core")):
            core = np.asarray(core.as_py() or [], np.int64)
            edits.append(np.setxor1d(unpacked(own.as_py()).astype(np.int64), core))
        n = np.array([len(e) for e in edits], np.int64) + batch.column("alone").to_numpy()
        out = batch.select(["node", "family", "size"])
        out = out.append_column("n_edits", pa.array(n, pa.int64()))
        yield out.append_column("edits", pa.array(edits, pa.list_(pa.int64())))


class Grouping:
    """``postings`` (key, node, ...): a row for each key of a node, only keys that several
    nodes have. ``near``: what two rows x and y of one key must meet in order to be
    compared, in SQL. ``sets`` (node, size, alone, keys): how many elements the set of a node
    has, how many of them no other set has, and all others, packed. Nodes link if their sets
    have ``percent`` of all elements of both in common. ``compare`` gets pairs (a, b), each
    once and never twice, and whether most of them are not alike; it returns those that
    link, stored.
    """

    def __init__(
        self,
        postings: DataFrame,
        compare: Callable[[DataFrame, bool], DataFrame],
        sets: DataFrame,
        percent: int,
        near: str = "true",
    ) -> None:
        self.postings, self.compare, self.near = postings, compare, near
        self.sets, self.percent = sets, percent
        self.extra = [c for c in postings.columns if c not in ("key", "node")]
        self.open = postings
        self.seen: DataFrame | None = None
        self.labels: DataFrame | None = None
        #: Pairs that were compared, and turns that were taken.
        self.compared = self.turns = 0

    def _unsettled(self) -> DataFrame:
        """Postings of keys that hold several groups, with the group of each node. Groups only
        grow, so a key that holds one is done with.
        """
        if self.labels is None:
            return self.postings.withColumn("component", F.col("node"))
        p = self.open.join(self.labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        ends = p.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
        p = stored(p.join(ends.where("a <> b").select("key"), "key"), "linking-unsettled")
        self.open = p.drop("component")
        return p

    def _unseen(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) that were not compared yet."""
        return pairs if self.seen is None else pairs.join(self.seen, ["a", "b"], "left_anti")

    def _link(self, pairs: DataFrame, most_unlike: bool) -> bool:
        """Compare the different ones of ``pairs`` (a < b, unseen); whether enough of them link
        that another turn is worth it.
        """
        once = stored(pairs.select("a", "b").distinct(), "linking-pairs")
        self.seen = once if self.seen is None else self.seen.unionByName(once)
        found = self.compare(once, most_unlike).select("a", "b")
        n_pairs, n_links = once.count(), found.count()
        self.compared += n_pairs
        if n_links:
            self.labels = components(found) if self.labels is None else self._merged(found)
        return n_links > n_pairs / 100

    def _merged(self, found: DataFrame) -> DataFrame:
        """The labels after links ``found`` (a, b) between groups: these are merged as nodes of
        a graph of groups.
        """
        labels = self.labels
        for end in "ab":
            of = labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_label"))
            found = found.join(of, end, "left")
        ends = [F.coalesce(f"{e}_label", e).alias(e) for e in "ab"]
        groups = components(stored(found.select(*ends).distinct(), "linking-groups"))
        groups = groups.select(F.col("node").alias("component"), F.col("component").alias("to"))
        # Nodes that were alone till now are groups of their own.
        alone = found.where("a_label IS NULL").select(F.col("a").alias("node"))
        alone = alone.unionByName(found.where("b_label IS NULL").select(F.col("b").alias("node")))
        alone = alone.distinct().withColumn("component", F.col("node"))
        every = labels.unionByName(alone).join(groups, "component", "left")
        component = F.coalesce("to", "component").alias("component")
        return stored(every.select("node", component), "linking-labels")

    def _turn(self) -> bool:
        p = self._unsettled()
        turn = F.xxhash64("node", F.lit(self.turns)).alias("turn")
        pick = F.min(F.struct(turn, "node", "component", *self.extra)).alias("y")
        picked = p.groupBy("key").agg(pick).select("key", "y.*").drop("turn")
        near = f"x.key = y.key AND x.component <> y.component AND {self.near}"
        pairs = p.alias("x").join(picked.alias("y"), F.expr(near))
        if not self.turns:
            pairs = pairs.groupBy(F.col("x.node").alias("of"), F.col("y.node").alias("to"))
            best = F.max(F.struct("shared", "to"))["to"].alias("to")
            pairs = pairs.agg(F.count("*").alias("shared")).groupBy("of").agg(best)
        else:
            pairs = pairs.selectExpr("x.node AS of", "y.node AS to")
        self.turns += 1
        pairs = pairs.select(F.least("of", "to").alias("a"), F.greatest("of", "to").alias("b"))
        return self._link(self._unseen(pairs), False)

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node, ...) with the group of each node."""
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        joined = rows.join(self.labels, "node", "left")
        return joined.withColumn("component", F.coalesce("component", "node"))

    def _edited(self, p: DataFrame) -> DataFrame:
        """(node, family, size, n_edits, edits, w) of the nodes of ``p`` (key, node, ...). A
        family are nodes that chains of keys reach. Sets x and y link if 2 * (100 + percent)
        times the number of edits of both is x.w + y.w at least.
        """
        first = p.groupBy("key").agg(F.min("node").alias("b"))
        chained = p.join(first, "key").select(F.col("node").alias("a"), "b").distinct()
        families = components(stored(chained, "linking-chains"))
        families = families.withColumnRenamed("component", "family")
        sets = stored(self.sets.join(families, "node"), "linking-sets")
        elements = sets.select("family", "keys").mapInArrow(
            _elements, "family binary, elements array<long>"
        )
        elements = elements.select("family", F.explode("elements").alias("element"))
        held = elements.groupBy("family", "element").agg(F.count("*").alias("n")).where("n > 1")
        members = stored(sets.groupBy("family").agg(F.count("*").alias("members")), "linking-members")
        core = held.join(members, "family").where("2 * n > members")
        core = core.groupBy("family").agg(F.collect_list("element").alias("core"))
        beside_core = sets.join(stored(core, "linking-core"), "family", "left").mapInArrow(
            _edits, "node binary, family binary, size long, n_edits long, edits array<long>"
        )
        more, less = 100 + self.percent, 100 - self.percent
        w = F.expr(f"{more} * n_edits - {less} * size").alias("w")
        return stored(beside_core.select("*", w), "linking-edits")

    def _rest(self) -> None:
        p = self._unsettled()
        if p.isEmpty():
            return
        edited = self._edited(p)
        least = edited.groupBy("family").agg(F.min(F.struct("w", "node")).alias("least"))
        least = stored(least.select("family", "least.*"), "linking-fewest")
        least = self._labelled(least).select(
            "family",
            F.col("w").alias("least_w"),
            F.col("node").alias("to"),
            F.col("component").alias("to_component"),
        )
        edited = edited.join(least, "family")
        with_it = self._labelled(edited.where("w + least_w <= 0").drop("edits"))
        with_it = with_it.where("component <> to_component").selectExpr(
            "least(node, to) AS a", "greatest(node, to) AS b"
        )
        self._link(self._unseen(with_it), False)
        # Edits that one group alone has are in no pair of groups: they count, but can't join.
        rows = self._labelled(edited.select("node", "family", F.explode("edits").alias("edit")))
        ends = [F.min("component").alias("a"), F.max("component").alias("b")]
        often = rows.groupBy("family", "edit").agg(F.count("*").alias("n"), *ends).where("a <> b")
        rows = rows.join(often.select("family", "edit", "n"), ["family", "edit"])
        ordered = F.sort_array(F.collect_list(F.struct("n", "edit")))["edit"].alias("ordered")
        own = rows.groupBy("node", "component").agg(ordered)
        own = own.join(edited.drop("edits", "to", "to_component"), "node")
        both = 2 * (100 + self.percent)
        needed = f"greatest(1, (w + least_w + {both - 1}) div {both})"
        own = own.withColumn("before", F.expr("n_edits - size(ordered)")).withColumn(
            "reach", F.expr(f"greatest(0, least(size(ordered), n_edits - before - {needed} + 1))")
        )
        prefix = own.select(
            "node", "component", "family", "size", "n_edits", "w", "before",
            F.posexplode(F.expr("slice(ordered, 1, CAST(reach AS INT))")).alias("at", "edit"),
        )
        prefix = prefix.withColumn("behind", F.expr("n_edits - before - at"))
        prefix = stored(prefix.drop("before", "at", "n_edits"), "linking-rest")
        # Behind their first common edit that bounds all they share.
        near = (
            "x.family = y.family AND x.edit = y.edit AND x.component <> y.component"
            f" AND x.node < y.node AND {both} * least(x.behind, y.behind) >= x.w + y.w"
            f" AND 100 * x.size >= {self.percent} * y.size"
            f" AND 100 * y.size >= {self.percent} * x.size"
        )
        pairs = prefix.alias("x").join(prefix.alias("y"), F.expr(near))
        pairs = pairs.selectExpr("x.node AS a", "y.node AS b")
        self._link(self._unseen(pairs), True)

    def run(self) -> DataFrame:
        """(node, component): the smallest node that links reach, for linked nodes."""
        while self._turn():
            pass
        self._rest()
        if self.labels is None:
            return self.postings.select("node", F.col("node").alias("component")).limit(0)
        return self.labels


def smallest_ids(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, component, component_id) for each node of ``members`` (node, doc_id): its label
    of ``labels``, null for a node that links with none, and the smallest doc_id of all
    members of its component. Null ids don't count as smallest.
    """
    lows = members.groupBy("node").agg(F.min("doc_id").alias("low"))
    marked = stored(lows.join(labels, "node", "left"), "linking-lows")
    # One row for each component, stored, is joined with its nodes, however many they are.
    of = marked.where("component IS NOT NULL").groupBy("component")
    least = stored(of.agg(F.min("low").alias("least")), "linking-least")
    smallest = F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("least"))
    joined = marked.join(least, "component", "left")
    return stored(joined.select("node", "component", smallest.alias("component_id")), "linking-ids")
