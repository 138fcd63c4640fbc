"""Near-duplicate embeddings by NN-descent: a neighbour graph refined until it is settled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushmap.llm.shared import components, stored

THRESHOLD = 0.93
#: Neighbours per list, and how like two vectors must be for their lists to be followed.
NEIGHBOURS = 10
FOLLOW = 0.5
#: Random orders for the first lists, places looked ahead in each, and bits of an order, at least.
ORDERS, AHEAD, BITS = 8, 12, 20
#: How probable it may be that a pair at the threshold, in evenly spread vectors, meets in no order;
#: where that takes more orders than this, vectors are compared block by block at once.
LOST, MOST_ORDERS = 0.001, 128
ROUNDS = 6
#: Vectors whose links are searched by brute force, and the share of them with all links found.
AUDIT, RECALL = 1_024, 0.99
#: Vectors in a block of a component, and of a label that is compared as a whole.
BLOCK, WIDE_BLOCK = 512, 4_096


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 1))


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, e) of rows with a key, a label and a finite vector other than zero."""
    e = F.col("e")
    return df.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast("array<double>").alias("e"),
    ).where(
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall(e, lambda x: F.abs(x) < float("inf")), F.lit(False))
        & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    )


def _unit(classes: DataFrame) -> DataFrame:
    """(id, label, dim, v): vectors of length one as bytes."""

    def run(batches):
        for batch in batches:
            out, dims = [], []
            for e in batch.column(2).to_pylist():
                x = np.array(e, np.float64)
                x = x / np.abs(x).max()  # first, so that no square overflows
                out.append((x / np.sqrt((x * x).sum())).tobytes())
                dims.append(len(e))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                ["id", "label", "dim", "v"],
            )

    return classes.select("id", "label", "e").mapInArrow(
        run, "id long, label string, dim int, v binary"
    )


def orders_for(most: int, threshold: float) -> tuple[int, int]:
    """(orders, bits) for labels of up to ``most`` vectors.

    A pair meets in an order if the two agree in the first log2(most / AHEAD) bits, as about AHEAD
    vectors do then. They agree in each bit with probability 1 - angle / pi.
    """
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    met = agree ** np.log2(max(most / AHEAD, 1))
    if met <= 1e-9:
        orders = MOST_ORDERS + 1
    else:
        orders = int(np.ceil(np.log(LOST) / np.log1p(-met))) if met < 1 else 1
    return max(ORDERS, orders), min(62, max(BITS, int(np.ceil(np.log2(max(most, 1)))) + 4))


def first_lists(
    units: DataFrame, seed: int, orders: int = ORDERS, bits: int = BITS
) -> DataFrame:
    """Pairs (a, b, sim) of vectors of one label that lie close in one of several random orders.

    An order sorts vectors by the sides of random planes they are on. Sorting is by range, so a
    label or a dense place of any size is spread over many tasks; each vector is compared with
    those a few places ahead.
    """

    def coded(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.standard_normal((dim, orders * bits))
                x = _matrix(part.column(3))
                sides = (x @ planes[dim] > 0).reshape(len(x), orders, bits)
                codes = sides @ (np.int64(1) << np.arange(bits, dtype=np.int64)[::-1])
                for t in range(orders):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(2),
                            pa.array(np.full(len(x), t, np.int32)),
                            part.column(1),
                            pa.array(codes[:, t]),
                            part.column(0),
                            part.column(3),
                        ],
                        ["dim", "t", "label", "code", "id", "v"],
                    )

    by = ["dim", "t", "label", "code", "id"]
    ranged = (
        units.mapInArrow(coded, "dim int, t int, label string, code long, id long, v binary")
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
    )

    def compared(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch])
            whole = table.combine_chunks().to_batches()[0]
            old = 0 if tail is None else len(tail)
            dims = whole.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = whole.slice(low, high - low)
                x = _matrix(part.column(5))
                place = np.array(
                    [f"{t}|{g}" for t, g in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                )
                ids = part.column(4).to_numpy()
                found = np.full((len(x), AHEAD), -2.0)
                for s in range(1, min(AHEAD, len(x) - 1) + 1):
                    sim = np.einsum("ij,ij->i", x[:-s], x[s:])
                    sim[place[:-s] != place[s:]] = -2.0
                    found[: len(x) - s, s - 1] = sim
                keep = found >= FOLLOW
                keep[np.arange(len(x)), found.argmax(1)] = True  # and the nearest in any case
                keep &= found > -2.0
                i, s = np.nonzero(keep)
                fresh = low + i + s + 1 >= old  # pairs within the tail are known
                i, s = i[fresh], s[fresh]
                yield _pairs(ids[i], ids[i + s + 1], found[i, s])
            tail = whole.slice(max(0, len(whole) - AHEAD))

    return ranged.mapInArrow(compared, "a long, b long, sim double")


def _pairs(one: np.ndarray, two: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(sim)],
        ["a", "b", "sim"],
    )


def _similar(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) with their similarity."""
    one = units.select(F.col("id").alias("id1"), F.col("v").alias("v1"))
    two = units.select(F.col("id").alias("id2"), F.col("v").alias("v2"))
    both = (
        pairs.join(one, F.col("a") == F.col("id1"))
        .select("a", "b", "v1")
        .join(two, F.col("b") == F.col("id2"))
        .select("a", "b", "v1", "v2")
    )

    def run(batches):
        for batch in batches:
            sims = [
                float(np.dot(np.frombuffer(x), np.frombuffer(y))) if len(x) == len(y) else -1.0
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"]
            )

    return both.mapInArrow(run, "a long, b long, sim double")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim", "fresh").unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim", "fresh")
    )


def _listed(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the ``k`` best of one of their ends."""
    best = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    return (
        _both_ways(edges)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .groupBy(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"))
        .agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
    )


def descend(edges: DataFrame, units: DataFrame, links: DataFrame, k: int, threshold: float) -> DataFrame:
    """Refine lists through neighbours of neighbours; return all links seen on the way."""
    lists = stored(_listed(edges.withColumn("fresh", F.lit(1)), k))
    for _ in range(ROUNDS):
        ways = _both_ways(lists).where(F.col("sim") >= FOLLOW)
        there = ways.select("v", "u", F.col("fresh").alias("f1"))
        onward = ways.select(F.col("v").alias("m"), F.col("u").alias("w"), F.col("fresh").alias("f2"))
        known = lists.select("a", "b")
        asked = (
            there.join(onward, F.col("u") == F.col("m"))
            .where((F.col("v") < F.col("w")) & (F.col("f1") + F.col("f2") > 0))
            .select(F.col("v").alias("a"), F.col("w").alias("b"))
            .distinct()
            .join(known, ["a", "b"], "left_anti")
        )
        made = stored(_similar(stored(asked), units))
        links = stored(
            links.unionByName(made.where(F.col("sim") >= threshold).select("a", "b")).distinct()
        )
        old = lists.withColumn("fresh", F.lit(0))
        after = stored(_listed(old.unionByName(made.withColumn("fresh", F.lit(1))), k))
        if after.where("fresh = 1").isEmpty():
            break
        lists = after
    return links


def _counts(grouped: DataFrame, threshold: float) -> DataFrame:
    """(id, others) for vectors of components: how many vectors each links with, itself left out.

    Saturated lists are enlarged to the whole component. Its vectors, in blocks, meet block by
    block in separate tasks; blocks too far apart by their centres and radii are not compared.
    ``grouped``: id, component, size, v.
    """
    angle = float(np.arccos(min(1.0, threshold))) + 1e-9
    totals = stored(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members")))
    salted = grouped.join(totals.withColumnRenamed("component", "c2"), F.col("component") == F.col("c2"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = stored(
        salted.select(
            "id", "component", "size", "v", blocks.alias("n"),
            F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
        )
    )
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    meeting = spread.select(
        "component",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block", "id", "size", "v",
    )

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        side = table.column("block").to_numpy()
        ids, sizes = table.column("id").to_numpy(), table.column("size").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        counts = np.zeros(len(ids), np.int64)
        if len(one) and len(two) and _near(x[one], x[two], angle):
            linked = x[one] @ x[two].T >= threshold
            # Products of whole blocks round as they like; pairs at the edge are taken singly.
            rough = np.argwhere(np.abs(x[one] @ x[two].T - threshold) < 1e-9)
            for a, b in rough.tolist():
                linked[a, b] = float(np.dot(x[one[a]], x[two[b]])) >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
                counts[one] = linked @ sizes[two]
            else:
                counts[one] = linked @ sizes[two]
                counts[two] = linked.T @ sizes[one]
        return pa.table({"id": ids, "others": counts})

    return (
        meeting.groupBy("component", "i", "j")
        .applyInArrow(compare, "id long, others long")
        .groupBy("id")
        .agg(F.sum("others").alias("others"))
    )


def block_links(units: DataFrame, threshold: float, block: int = WIDE_BLOCK) -> DataFrame:
    """Pairs (a, b) that join exactly the vectors that links join, from all pairs of each label.

    A label's vectors, in blocks, meet block by block in separate tasks. Of the links of two blocks
    a spanning forest leaves the task, so what is made does not grow with the square of a group.
    """
    space = [F.col("label"), F.col("dim")]
    sizes = stored(
        units.groupBy(F.col("label").alias("label2"), F.col("dim").alias("dim2")).agg(
            F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n")
        )
    )
    placed = units.join(sizes, (space[0] == F.col("label2")) & (space[1] == F.col("dim2"))).select(
        "id", "label", "dim", "v", "n", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block")
    )
    meeting = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "label", "dim",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block", "id", "v",
    )

    def compare(key, table):
        side = table.column("block").to_numpy()
        ids = table.column("id").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        one, two = np.flatnonzero(side == key[2].as_py()), np.flatnonzero(side == key[3].as_py())
        root = np.arange(len(ids))
        a, b = [], []
        for low in range(0, len(one), BLOCK):
            rows = one[low : low + BLOCK]
            sims = x[rows] @ x[two].T
            for r, c in np.argwhere(np.abs(sims - threshold) < 1e-9).tolist():
                sims[r, c] = 2.0 if float(np.dot(x[rows[r]], x[two[c]])) >= threshold else -2.0
            linked = sims >= threshold
            for r in np.flatnonzero(linked.any(1)).tolist():
                own = root[rows[r]]
                met = np.unique(root[two[linked[r]]])
                met = met[met != own]
                if len(met):
                    a += [ids[rows[r]]] * len(met)
                    b += ids[met].tolist()
                    root[np.isin(root, met)] = own
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return meeting.groupBy("label", "dim", "i", "j").applyInArrow(compare, "a long, b long")


def _near(x: np.ndarray, y: np.ndarray, angle: float) -> bool:
    a, b = x.mean(0), y.mean(0)
    if not (a.any() and b.any()):
        return True
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    radius = [np.arccos(np.clip((m @ c).min(), -1, 1)) for m, c in ((x, a), (y, b))]
    return float(np.arccos(np.clip(a @ b, -1, 1))) <= sum(radius) + angle


def audit(units: DataFrame, found: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of vectors with links, compared with all vectors, that have all their links found.

    It is taken apart for vectors with up to NEIGHBOURS links and with more, and the lower share
    counts, so that large groups do not hide what small ones lose. ``units`` has one row per
    distinct vector, ``found`` (id, others) counts distinct vectors. ``queries`` vectors at most,
    those with the least hash of their key, are drawn from all, and as many from those for which no
    more than NEIGHBOURS links are found.
    """
    counted = found.select(F.col("id").alias("id3"), F.col("others").alias("seen"))
    few = (
        units.join(counted, F.col("id") == F.col("id3"), "left")
        .where(F.coalesce("seen", F.lit(0)) <= NEIGHBOURS)
        .select(*units.columns)
    )
    drawn = {
        r["id"]: r
        for rows in (units, few)
        for r in rows.orderBy(F.xxhash64("id"), "id").limit(queries).collect()
    }.values()
    if not drawn:
        return 1.0
    by: dict[tuple[str, int], tuple[list, list]] = {}
    for r in drawn:
        ids, rows = by.setdefault((r["label"], r["dim"]), ([], []))
        ids.append(r["id"])
        rows.append(np.frombuffer(bytes(r["v"])))
    asked = {k: (np.array(ids), np.stack(rows)) for k, (ids, rows) in by.items()}

    def run(batches):
        for batch in batches:
            spaces = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            ids = batch.column(0).to_numpy()
            for space in set(spaces) & set(asked):
                at = np.flatnonzero([s == space for s in spaces])
                x = _matrix(batch.column(3).take(pa.array(at)))
                q_ids, q = asked[space]
                # Pairs at the edge round as they like and are not asked for.
                hit = (q @ x.T >= threshold + 1e-9) & (q_ids[:, None] != ids[at][None, :])
                n = hit.sum(1)
                some = n > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[some]), pa.array(n[some].astype(np.int64))], ["id2", "n"]
                )

    true = units.mapInArrow(run, "id2 long, n long").groupBy("id2").agg(F.sum("n").alias("n"))
    rows = (
        true.join(found, F.col("id2") == F.col("id"), "left")
        .groupBy((F.col("n") <= NEIGHBOURS).alias("small"))
        .agg(F.avg((F.coalesce("others", F.lit(0)) >= F.col("n")).cast("int")).alias("share"))
        .collect()
    )
    return min((r["share"] for r in rows), default=1.0)


def near_embeddings(
    df: DataFrame,
    threshold: float = THRESHOLD,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    neighbours: int = NEIGHBOURS,
    tries: int = 4,
) -> DataFrame:
    """(key, n_links, component_id, kept) per row of ``df``.

    Vectors of one label and length link at a cosine of ``threshold`` or more, in double
    precision. Null labels and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Equal vectors of one label are one node. Lists start from random
    orders and are refined by neighbours of neighbours until no list changes. Lists that are
    full of links are enlarged to their whole component, which is compared block by block; all
    counts come from that comparison. The number of orders and their bits grow with the largest
    label. An audit by brute force for a bounded set of vectors then measures the share of vectors
    with all their links, and further random orders are added until it is met. After ``tries``
    times, or where orders cannot serve the threshold, all vectors of a label are compared block by
    block. Rows with a null key get no links and a null component. Of rows with one key, the least (label, vector) counts.
    An empty table gives an empty result.
    """
    rows = usable(df, key, vector, label)
    if rows.select("id").distinct().count() < rows.count():
        least = F.min(F.struct("label", "e"))
        rows = rows.groupBy("id").agg(least.alias("r")).select("id", "r.label", "r.e")
    rows = stored(rows)
    classes = stored(
        rows.groupBy("label", "e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    )
    units = stored(_unit(classes))
    sizes = classes.select(F.col("id").alias("id2"), "size")
    edges, links, found, comps = None, None, None, None
    most = units.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    orders, bits = orders_for(most, threshold)
    if orders > MOST_ORDERS or threshold < FOLLOW:
        tries = 0
    for attempt in range(tries + 1):
        if attempt == tries:
            links = stored(block_links(units, threshold))
        else:
            made = first_lists(units, attempt, orders, bits)
            made = made if edges is None else edges.unionByName(made)
            edges = stored(made.groupBy("a", "b").agg(F.max("sim").alias("sim")))
            seen = edges.where(F.col("sim") >= threshold).select("a", "b").distinct()
            links = stored(seen if links is None else seen.unionByName(links).distinct())
            links = descend(edges, units, links, neighbours, threshold)
        comps = stored(components(links))
        grouped = stored(
            comps.join(units, "id").join(sizes, F.col("id") == F.col("id2")).select(
                "id", "component", "size", "v"
            )
        )
        found = stored(_counts(grouped.withColumn("size", F.lit(1).cast("long")), threshold))
        if attempt == tries or audit(units, found, threshold) >= RECALL:
            break
    # Copies count with every node they belong to.
    found = stored(_counts(grouped, threshold)) if _copies(classes) else found
    nodes = stored(
        classes.join(found.withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"), "left")
        .join(comps.withColumnRenamed("id", "id3"), F.col("id") == F.col("id3"), "left")
        .select(
            F.col("label").alias("label2"),
            F.col("e").alias("e2"),
            (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    placed = rows.join(
        nodes, (F.col("label") == F.col("label2")) & (F.col("e") == F.col("e2"))
    ).select(F.col("id").alias("id2"), "n_links", "component")
    return df.select(F.col(key)).join(placed, F.col(key) == F.col("id2"), "left").select(
        key,
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", F.col(key)).alias("component_id"),
        F.coalesce(F.col(key) == F.coalesce("component", F.col(key)), F.lit(False)).alias("kept"),
    )


def _copies(classes: DataFrame) -> bool:
    return not classes.where("size > 1").isEmpty()
