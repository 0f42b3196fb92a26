"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by the reference points (pivots) nearest to it, in order. Near vectors have
most of their nearest pivots in common. Pivots are vectors of the same label, twice the square root
of their number, so inverted lists stay short as a label grows. Two vectors that share ``SHARED`` of
``NEAREST`` pivots share one among the ``NEAREST - SHARED + 1`` lowest of each, so a vector stands in
that many lists; in a list, pairs are counted by the pivots they share, and those with enough
are verified by cosine, in blocks of bounded size. A pair is settled in one list only: that of its
lowest shared pivot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmine.functions.ranking import skew_join
from talkmine.operators.components import connected
from talkmine.session import cut_lineage

NEAREST, SHARED = 7, 3
#: pivots of a label: so many times the square root of its vectors, at least the other number, or all
PER_ROOT, LEAST_PIVOTS = 2, 32
COSINE = 0.93
#: vectors that are held against the pivots of their label at once
ASSIGNED = 8192
#: vectors that are compared with as many others at once
BLOCK = 512


def usable(vector: Column) -> Column:
    """Whether a vector exists and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame) -> DataFrame:
    """The vectors (group, node, vector, n) with the lowest hashes, about as many as a group of ``n`` needs."""
    wanted = F.greatest(F.lit(LEAST_PIVOTS), F.ceil(PER_ROOT * F.sqrt("n")))
    share = F.least(F.lit(1.0), wanted / F.col("n"))
    return vectors.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30))


def permutations(vectors: DataFrame, pivots: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """node and its ``nearest`` pivots in order, of vectors (group, node, vector, n).

    A group meets its pivots in blocks, so a label with a third of all vectors is many tasks.
    """
    blocks = F.ceil(F.col("n") / ASSIGNED).cast("int")
    left = vectors.select("group", F.pmod(F.xxhash64("node"), blocks).alias("block"), "node", "vector")
    right = pivots.select("group", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("node").alias("pivot"),
                           F.col("vector").alias("of_pivot"))

    def order(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"node": pd.Series([], dtype="int64"), "pivots": pd.Series([], dtype=object)})
        b = b.sort_values("pivot")
        like = _unit(np.stack(a["vector"])) @ _unit(np.stack(b["of_pivot"])).T
        first = np.argsort(-like, axis=1, kind="stable")[:, :nearest]
        return pd.DataFrame({"node": a["node"], "pivots": list(b["pivot"].to_numpy()[first])})

    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInPandas(
        order, "node long, pivots array<long>")


def _counts(x: np.ndarray, y: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots, and how many below ``pivot``, each row of ``x`` shares with each of ``y``."""
    names, at = np.unique(np.r_[x.ravel(), y.ravel()], return_inverse=True)
    marks = np.zeros((len(x) + len(y), len(names)), np.float32)
    marks[np.r_[np.repeat(np.arange(len(x)), x.shape[1]), len(x) + np.repeat(np.arange(len(y)), y.shape[1])], at] = 1
    low = marks[:, names < pivot]
    return marks[:len(x)] @ marks[len(x):].T, low[:len(x)] @ low[len(x):].T


def _verify(cosine: float, shared: int):
    def read(rows) -> tuple[np.ndarray, ...]:
        flat = rows.values
        first, n = rows.offsets[0].as_py(), rows.offsets[-1].as_py()
        flat = flat.slice(first, n - first)

        def table(name: str) -> np.ndarray:
            return flat.field(name).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

        return flat.field("node").to_numpy(), table("pivots"), flat.field("copies").to_numpy(), _unit(table("vector"))

    def compute(batches):
        for batch in batches:
            nodes, links, edges = [], [], []
            for i in range(batch.num_rows):
                pivot = batch.column("pivot")[i].as_py()
                x = read(batch.column("left").slice(i, 1))
                same = not batch.column("right")[i].is_valid
                y = x if same else read(batch.column("right").slice(i, 1))
                many = min(shared, x[1].shape[1])
                count, lower = _counts(x[1], y[1], pivot)
                link = (count >= many) & (lower == 0) & (x[3] @ y[3].T >= cosine)
                if same:
                    np.fill_diagonal(link, False)
                nodes.append(x[0])
                links.append(link @ y[2])
                if not same:
                    nodes.append(y[0])
                    links.append(link.T @ x[2])
                edges.append(_spanning(x[0], y[0], link))
            node, at = np.unique(np.concatenate(nodes), return_inverse=True)
            total = np.bincount(at, np.concatenate(links)).astype(np.int64)
            edge = np.concatenate(edges)
            keep = total > 0
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[node[keep], edge[:, 0]]), pa.array(np.r_[total[keep], np.zeros(len(edge), np.int64)]),
                pa.array(np.r_[node[keep], edge[:, 1]])], names=["node", "links", "other"])

    return compute


def _spanning(a: np.ndarray, b: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Edges that connect what the links of two blocks connect: to the least reachable node."""
    least_a, least_b = a.copy(), b.copy()
    none = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(least_a, np.where(link, least_b[None, :], none).min(axis=1, initial=none))
        new_b = np.minimum(least_b, np.where(link, new_a[:, None], none).min(axis=0, initial=none))
        if (new_a == least_a).all() and (new_b == least_b).all():
            break
        least_a, least_b = new_a, new_b
    edges = np.r_[np.c_[a, least_a], np.c_[b, least_b]]
    return edges[edges[:, 0] != edges[:, 1]]


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, nearest: int = NEAREST,
                    shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``embeddings`` (vec_id, embedding, label).

    Vectors of one label and one length link if they share ``shared`` of their ``nearest`` pivots
    and their cosine is at least ``cosine``. Null and zero vectors, those with a null or a
    non-finite component, and rows without a label link with nothing. Equal vectors of one
    label are one node with a number of copies; each copy links with the others. The component
    is the least vec_id that links lead to, and that row is kept (every row that repeats it).
    """
    rows = embeddings.select("vec_id", "label", "embedding")
    fit = usable(F.col("embedding")) & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    number = "float" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    # adding 0 makes -0.0 and 0.0 one value
    vector = F.transform("embedding", lambda x: x.cast(number) + F.lit(0.0).cast(number))
    keyed = rows.withColumn("vector", F.when(fit, vector)).withColumn(
        "node", F.when(fit, F.xxhash64(F.lit("vector"), "label", "vector")))
    nodes = cut_lineage(keyed.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.min("vec_id").alias("low"), F.count("*").alias("copies")))
    grouped = nodes.select(F.struct("label", F.size("vector").alias("size")).alias("group"), "node", "vector", "copies")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1")
    vectors = cut_lineage(skew_join(grouped, sizes, "group", "n"))
    ordered = permutations(vectors, choose_pivots(vectors), nearest)
    # each vector stands in the lists of its lowest pivots
    prefix = F.slice(F.sort_array("pivots"), F.lit(1), F.size("pivots") - F.least(F.lit(shared), F.size("pivots")) + 1)
    entries = cut_lineage(ordered.select("node", "pivots", F.explode(prefix).alias("pivot")))
    # a pivot is a vector of one label, so its name names the list
    several = entries.groupBy("pivot").agg(F.count("*").alias("n")).filter("n > 1")
    members = skew_join(entries, several, "pivot", "n").join(vectors.select("node", "vector", "copies"), "node")
    members = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    blocks = cut_lineage(members.groupBy("pivot", "block", "blocks").agg(
        F.collect_list(F.struct("node", "pivots", "copies", "vector")).alias("members")))
    none = F.lit(None).cast(blocks.schema["members"].dataType)
    whole = blocks.filter("blocks = 1").select("pivot", F.col("members").alias("left"), none.alias("right"))
    cut = blocks.filter("blocks > 1")
    left = cut.select("pivot", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"),
                      F.col("block").alias("own"), F.col("members").alias("left"))
    pairs = whole.unionByName(left.join(cut.select("pivot", "block", "members"), ["pivot", "block"]).select(
        "pivot", "left", F.when(F.col("own") != F.col("block"), F.col("members")).alias("right")))
    found = cut_lineage(pairs.mapInArrow(_verify(cosine, shared), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected(found.filter("node <> other").select("node", "other").distinct())
    known = cut_lineage(nodes.select("node", "low", "copies").join(links, "node", "left").join(parts, "node", "left")
                        .withColumn("root", F.coalesce("component", "node")))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of_nodes = cut_lineage(skew_join(known, least, "root", "n").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return keyed.select("vec_id", "node").join(of_nodes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
