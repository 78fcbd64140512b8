"""Connected components of an edge table by union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, forget, mapped

#: Edges that one task may take into its union-find; with more, tasks contract their parts and stars do the rest.
ONE_TASK_EDGES = 200_000


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contracted(edges: DataFrame) -> DataFrame:
    """(a, b) with b the root of a among the edges of a's partition; a task holds the nodes of its own edges."""

    def run(batches):
        import pyarrow as pa

        uf, kinds = UnionFind(), None
        for batch in batches:
            kinds = batch.schema
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                uf.union(a, b)
        nodes = [x for x in uf.parent if uf.find(x) != x]
        for k in range(0, len(nodes), 10_000):
            part = nodes[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kinds.field("a").type), pa.array([uf.find(x) for x in part], kinds.field("b").type)], ["a", "b"])

    return mapped(edges.select("a", "b"), run, edges.select("a", "b").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame, *, one_task: int = ONE_TASK_EDGES, kept: bool = False) -> DataFrame:
    """(a, b): every node of edges (a, b) that is not its component's smallest, and that smallest node.

    Nodes are of any ordered type. Few edges (counted) go through one union-find. More are contracted within
    their partitions, and then large and small stars alternate until nothing changes; each round is
    checkpointed, and no node's neighbours are ever gathered. Loops and repeated edges count for nothing. Edges of
    checkpointed tables (kept) are read from these, others are checkpointed first.
    """
    edges = edges.select("a", "b").where("a <> b")
    own = [] if kept else [checkpointed(edges)]
    edges = edges if kept else own[0]
    n = edges.count()
    if n <= one_task:
        out = checkpointed(_contracted(edges.repartition(1)))
        forget(*own)
        return out
    edges, old = checkpointed(_contracted(edges)), None
    forget(*own)
    mark = None
    while True:
        if old is not None:
            forget(old)
        edges, old = checkpointed(_small_star(_large_star(edges))), edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            forget(old)
            return edges
        mark = now
