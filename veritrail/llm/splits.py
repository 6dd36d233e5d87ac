"""Splits that keep related records together.

Records are linked by the identifiers they share. The component table below a folder holds the
component of every identifier and the split of every component, and grows with each batch:

* the identifiers of the batch are looked up, so that what is known takes part as one node;
* hooking lets every node point to its smallest neighbour and pointer jumping replaces pointers
  by the roots they lead to; the graph is contracted to its roots until no link is left. Nodes
  are compared by hash, so pointers lead down a random order and are short;
* an existing component keeps its split, new components fill the deficits of the proportions, and
  a merge of components of different splits is quarantined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from veritrail.functions.idents import linking_identifier, trimmed
from veritrail.session import cut
from veritrail.sources.commits import Commits

#: The splits, with the proportions records are assigned in unless others are given.
PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}
QUARANTINED = "quarantined"
#: Slices of the order new components are assigned in; sums of slices are all that is put in one task.
SLICES = 4096
#: Rows of one component or identifier that are joined in one block.
BLOCK_ROWS = 20_000
#: Batches after which pointers and states are written whole.
COMPACT = 16


def _node(kind: str, value: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(kind), value)))


def _mapped(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``rows`` with each node of ``column`` replaced by its root in ``up`` (node, root), if it has one."""
    own = up.select(F.col("node").alias(column), F.col("root").alias("_further"))
    return rows.join(own, column, "left").withColumn(column, F.coalesce("_further", column)).drop("_further")


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) whose component's smallest node is another.

    Each round hooks, jumps until all pointers lead to roots, and contracts the links to these.
    """
    pair = F.array_sort(F.array("a", "b"))
    ordered = lambda df: df.where(F.col("a") != F.col("b")).select(pair[0].alias("a"), pair[1].alias("b")).distinct()
    links, known = cut(ordered(links)), None
    while not links.isEmpty():
        # hook: every node that has a smaller neighbour points to the smallest
        up = cut(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        # jump: pointers double their reach, twice at once, until the last doubling moves none
        far, moved = up, True
        while moved:
            twice = _mapped(far, "root", far)
            again = _mapped(twice.withColumn("before", F.col("root")), "root", twice)
            far = cut(again.select("node", "root", (F.col("root") != F.col("before")).alias("moved")))
            moved = not far.where("moved").isEmpty()
            far = far.drop("moved")
        known = far if known is None else _mapped(known, "root", far).unionByName(far)
        links = cut(ordered(_mapped(_mapped(links, "a", far), "b", far)))
    return known if known is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def spread(rows: DataFrame, key: str, table: DataFrame, hot: DataFrame, salt: str, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``table``, which has one row for each ``key``; a key of ``hot`` (key, n: its
    rows) is joined in blocks of BLOCK_ROWS, told apart by the column ``salt`` of the rows."""
    hot = hot.select(key, F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    if hot.isEmpty():
        return rows.join(table, key, how)
    blocks = F.coalesce("_blocks", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("_block", F.pmod(F.hash(salt), blocks)).drop("_blocks")
    table = table.join(hot, key, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return rows.join(table, [key, "_block"], how).drop("_block")


class ComponentTable:
    """Components and their splits below ``folder``, a folder all executors share.

    Each batch has a folder of its own, named by a commit that is written last; nothing committed is
    written again, and a folder that holds a table is opened as it is. members (node, root) are those
    a batch brought. pointers (node, root) say what became of roots that were merged, and lead to the
    root of now in one step; of several the last is right, as of states (root, split, records). Every
    COMPACT batches both are written whole, so only those from there on are read. How many records
    each split has stands in the commit.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Commits(spark, folder)
        self.commits = self.log.all()

    @property
    def batches(self) -> int:
        return len(self.commits)

    def _read(self, what: str, schema: str, commits: list[dict]) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], f"{schema}, n int")
        return self.spark.read.schema(f"{schema}, n int").parquet(*(f"{self.folder}/{c['name']}/{what}" for c in commits))

    def _live(self) -> list[dict]:
        first = max((n for n, c in enumerate(self.commits) if c["whole"]), default=0)
        return self.commits[first:]

    def pointers(self) -> DataFrame:
        """(node, root) of every root that was merged into another, as of now."""
        rows = self._read("pointers", "node binary, root binary", self._live())
        return rows.groupBy("node").agg(F.max_by("root", "n").alias("root"))

    def members(self) -> DataFrame:
        """(node, root) as of now."""
        return _mapped(self._read("members", "node binary, root binary", self.commits).select("node", "root"), "root", self.pointers()).select("node", "root")

    def states(self) -> DataFrame:
        """(root, split, records) of every component as of now."""
        rows = self._read("states", "root binary, split string, records long", self._live())
        rows = rows.groupBy("root").agg(F.max_by("split", "n").alias("split"), F.max_by("records", "n").alias("records"))
        return rows.join(self.pointers().select(F.col("node").alias("root")), "root", "left_anti")

    def add(self, records: DataFrame, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
        """Adds a batch of (record, node, own, split): one row for each identifier of a record, among
        them its own, with the split it was delivered with or null. Returns (record, smallest, split,
        state): the smallest record of the batch in the component, and its state: kept, filled or
        quarantined; split is null for the last. An empty batch adds nothing.
        """
        proportions = proportions or PROPORTIONS
        records, history = cut(records), self.batches > 0
        out = "record string, smallest string, split string, state string"
        if records.isEmpty():
            return self.spark.createDataFrame([], out)
        if history:
            old = cut(records.select("node").distinct().join(self.members().withColumnRenamed("root", "held"), "node"))
            records = records.join(old, "node", "left")
        else:
            records = records.withColumn("held", F.lit(None).cast("binary"))

        # what a record shares with others is linked to the smallest of it; all its nodes are one
        shared = F.when(~F.col("own") | F.col("held").isNotNull(), F.coalesce("held", "node"))
        centre = cut(
            records.groupBy("record").agg(
                F.coalesce(F.min(shared), F.min("node")).alias("a"),
                F.max(shared).alias("b"),
                F.count(shared).alias("n"),
                F.max(F.when(F.col("own") & F.col("held").isNull(), F.col("node"))).alias("node"),
                F.sort_array(F.collect_set("split")).alias("delivered"),  # at most three
            )
        )
        links = centre.where(F.col("a") < F.col("b")).select("a", "b")
        many = centre.where((F.col("n") > 2) & (F.col("a") < F.col("b"))).select("record", "a")
        if not many.isEmpty():
            links = links.unionAll(records.withColumn("b", shared).where(F.col("b").isNotNull()).join(many, "record").select("a", "b"))
        up = cut(roots(links))
        jump = up.select(F.col("node").alias("a"), F.col("root").alias("to"))
        hot = centre.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
        own = spread(centre, "a", jump, cut(hot), "record", "left").select("record", F.coalesce("to", "a").alias("root"), "node", "delivered")
        own = cut(own)

        groups = own.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_set("delivered"))).alias("delivered"), F.count(F.lit(1)).alias("size"), F.min("record").alias("smallest"))
        before = dict.fromkeys((*PROPORTIONS, QUARANTINED), 0) | (self.commits[-1]["totals"] if history else {})
        if history:
            touched = cut(old.select(F.col("held").alias("node")).distinct().join(self.states().withColumnRenamed("root", "node"), "node"))
            held = _mapped(touched.withColumn("root", F.col("node")), "root", up)
            held = held.groupBy("root").agg(F.collect_set("split").alias("kept"), F.sum("records").alias("before"))  # at most four splits
            groups = groups.join(held, "root", "left")
            for row in touched.groupBy("split").agg(F.sum("records").alias("n")).collect():
                before[row["split"]] -= row["n"]
        else:
            groups = groups.withColumns({"kept": F.array().cast("array<string>"), "before": F.lit(0).cast("long")})
        splits = F.array_union(F.coalesce("kept", F.array().cast("array<string>")), "delivered")
        # what is quarantined stays so; a component without a split of its own is new
        conflict = (F.size(splits) > 1) | F.array_contains(splits, QUARANTINED)
        split = F.when(conflict, F.lit(QUARANTINED)).when(F.size(splits) == 1, splits[0])
        groups = cut(groups.select("root", "size", "smallest", (F.col("size") + F.coalesce("before", F.lit(0))).alias("records"), split.alias("split")))
        state = F.when(F.col("split") == QUARANTINED, F.lit(QUARANTINED)).otherwise(F.lit("kept"))
        have = {r["split"]: r["n"] for r in groups.groupBy("split").agg(F.sum("records").alias("n")).collect()}
        coming = have.pop(None, 0)
        have = {s: n + have.get(s, 0) for s, n in before.items()}
        settled = groups.where(F.col("split").isNotNull()).withColumn("state", state)
        if coming:
            filled = _fill(groups.where(F.col("split").isNull()).drop("split"), have, coming, proportions, seed)
            groups = cut(settled.unionByName(filled))
            for row in groups.where("state = 'filled'").groupBy("split").agg(F.sum("records").alias("n")).collect():
                have[row["split"]] += row["n"]
        else:
            groups = settled
        self._write(records, own, groups, up, old if history else None, have)

        split = F.when(F.col("state") != QUARANTINED, F.col("split")).alias("split")
        hot = groups.where(F.col("size") > BLOCK_ROWS).select("root", F.col("size").alias("n"))
        return spread(own.select("record", "root"), "root", groups.select("root", "smallest", split, "state"), hot, "record").select("record", "smallest", "split", "state")

    def _write(self, records: DataFrame, own: DataFrame, groups: DataFrame, up: DataFrame, old: DataFrame | None, totals: dict[str, int]) -> None:
        number, live = self.batches, len(self._live())
        commit = {"name": f"batch-{number:06}-{uuid.uuid4().hex}", "whole": number == 0 or live >= COMPACT, "totals": totals}
        write = lambda what, df: df.withColumn("n", F.lit(number)).write.mode("errorifexists").parquet(f"{self.folder}/{commit['name']}/{what}")
        fresh = _mapped(records.where("NOT own AND held IS NULL").select("node").distinct().withColumn("root", F.col("node")), "root", up)
        write("members", fresh.select("node", "root").unionAll(own.where("node IS NOT NULL").select("node", "root")))
        states = groups.select("root", "split", "records")
        moved = up.limit(0)
        if old is not None:
            # roots that were merged now, and those that led to them before
            moved = up.join(old.select(F.col("held").alias("node")).distinct(), "node", "left_semi").select("node", "root")
            known = self.pointers()
            again = known.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root").select("node", F.col("to").alias("root"))
            moved = moved.unionAll(again)
            if commit["whole"]:
                states = states.unionAll(self.states().join(states, "root", "left_anti").join(moved.select(F.col("node").alias("root")), "root", "left_anti"))
                moved = moved.unionAll(known.join(moved, "node", "left_anti"))
        write("pointers", moved)
        write("states", states)
        self.log.add(number, commit)
        self.commits.append(commit)


def _fill(new: DataFrame, have: dict[str, int], coming: int, proportions: dict[str, float], seed: int) -> DataFrame:
    """Gives each component of ``new`` (root, records, ...) a split, where the splits ``have`` so many
    records and ``coming`` are new. In a random order, and large ones first, components are laid end to
    end, and the deficits of the splits too: a component gets the split that holds its middle. Sums run
    over slices first, so no task sorts all of them."""
    total = coming + sum(n for split, n in have.items() if split in proportions)
    deficit = {split: max(0.0, share * total - have.get(split, 0)) for split, share in proportions.items()}
    scale = coming / sum(deficit.values()) if sum(deficit.values()) else 0
    order = F.pmod(F.xxhash64("root", F.lit(seed)), F.lit(SLICES))
    sliced = new.withColumn("slice", order - F.least(F.floor(F.log2("records")), F.lit(62)) * SLICES)
    sums = sliced.groupBy("slice").agg(F.sum("records").alias("sum"))
    # at most SLICES times 63 slices
    before = sums.select("slice", (F.sum("sum").over(_window(None, "slice")) - F.col("sum")).alias("before"))
    middle = F.col("before") + F.sum("records").over(_window("slice", "root")) - F.col("records") / 2
    edge, split = 0.0, F.lit(list(proportions)[-1])
    for name in reversed(list(proportions)):
        edge = sum(deficit[n] for n in list(proportions)[: list(proportions).index(name) + 1]) * scale
        split = F.when(middle <= edge, F.lit(name)).otherwise(split)
    return sliced.join(before, "slice").withColumns({"split": split, "state": F.lit("filled")}).drop("slice", "before")


def _window(partition: str | None, order: str) -> WindowSpec:
    return Window.partitionBy(F.col(partition) if partition else F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def manifest_links(manifest: DataFrame) -> DataFrame:
    """(record, node, own, split) of a manifest: each record with itself, its package and its sequence.

    Null and blank identifiers and the stand-ins of missing ones link nothing; rows without a
    record_id are left out; unassigned and unknown splits are null.
    """
    split = F.lower(trimmed(F.col("split")))
    node = lambda kind, value, own: F.when(value.isNotNull(), F.struct(_node(kind, value).alias("node"), F.lit(own).alias("own")))
    nodes = F.array_compact(
        F.array(
            node("record:", F.col("record_id"), True),
            node("package:", linking_identifier(F.col("package_id")), False),
            node("sequence:", linking_identifier(F.col("sequence_id")), False),
        )
    )
    rows = manifest.where(F.col("record_id").isNotNull())
    rows = rows.select(F.col("record_id").alias("record"), F.explode(nodes).alias("n"), F.when(split.isin(*PROPORTIONS), split).alias("split"))
    return rows.select("record", "n.node", "n.own", "split").distinct()


def assigned(manifest: DataFrame, table: ComponentTable, proportions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Adds a manifest to ``table``: record_id, group_id (the smallest record_id of the batch in
    the group), split and state of each record. Repeated rows count once."""
    out = table.add(manifest_links(manifest), proportions, seed)
    return out.select(F.col("record").alias("record_id"), F.col("smallest").alias("group_id"), "split", "state")


def torn_groups(manifest: DataFrame, table: ComponentTable) -> DataFrame:
    """Every record of a group that the delivered splits tear apart, which is what ``table``, empty
    before, quarantines: record_id, group_id. An empty manifest gives no row."""
    return assigned(manifest, table).where(F.col("state") == QUARANTINED).select("record_id", "group_id")
