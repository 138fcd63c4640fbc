"""Merkle manifest of a table: hash trees per group and over the groups, with a proof for each row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushmap.llm.shared import running_totals, stored, unused

#: Nodes that become one parent.
FAN_OUT = 3


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(*columns: Column) -> Column:
    """Digest of a row's values: '-' for null, else their UTF-8 byte count, ':' and the value."""
    texts = [c.cast("string") for c in columns]
    return digest(
        *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    )


def ranked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves, groups) of stored leaves (grp, key, leaf, ...).

    Leaves get ``g``, the number of groups before theirs (null first), ``idx``, the number of
    leaves before them in their group (by key, null first, then leaf), and ``n``, the leaves of
    their group. Range partitions count on their own; what is moved between them is one row for
    each partition and group, so a group of any size is spread over many tasks.
    """
    order = [F.col(c).asc_nulls_first() for c in ("grp", "key", "leaf")]
    placed = stored(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("rows").over(whole))
        .withColumnsRenamed({"part": "part2", "grp": "grp2"})
    )
    # Null is the first of all groups, and an empty name comes before all other names.
    named = starts.select(F.col("grp2").alias("grp3"), F.lit(1).alias("one")).distinct()
    groups = stored(
        running_totals(
            named, "one", (), [F.col("grp3").asc_nulls_first()], "g"
        ).select("grp3", F.col("g").cast("long").alias("g"))
    )
    within = Window.partitionBy("part", "grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.join(groups, F.col("grp2").eqNullSafe(F.col("grp3"))).drop("grp3")
    same = (F.col("part") == F.col("part2")) & F.col("grp").eqNullSafe(F.col("grp2"))
    numbered = (
        placed.withColumn("inner", F.count(F.lit(1)).over(within))
        .join(starts, same)
        .withColumn("idx", F.col("start") + F.col("inner"))
        .drop("part", "part2", "grp2", "rows", "start", "inner")
    )
    return stored(numbered), groups


def families(nodes: DataFrame, fan_out: int) -> DataFrame:
    """Nodes (g, idx, n, hash) with the digests of their siblings, left and right ones joined.

    Slot s of a family meets its siblings by equi-joins of the table with itself: one for each
    shift of 1 .. fan_out - 1, to slot (s + shift) mod fan_out; with two slots that is idx XOR 1.
    Keys (g, idx) are unique, so no join has a hot key.
    """
    slot = F.col("idx") % fan_out
    out = nodes
    for shift in range(1, fan_out):
        sibling = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fan_out == 2 else (
            F.col("idx") - slot + (slot + shift) % fan_out
        )
        other = nodes.select(
            F.col("g").alias(f"g{shift}"), F.col("idx").alias(f"i{shift}"), F.col("hash").alias(f"h{shift}")
        )
        found = out.withColumn("_sibling", sibling)
        out = found.join(
            other, (F.col("g") == F.col(f"g{shift}")) & (F.col("_sibling") == F.col(f"i{shift}")), "left"
        ).drop("_sibling", f"g{shift}", f"i{shift}")
    # By slot: the shifts that lead to the left wrap around.
    lefts, rights = F.lit(""), F.lit("")
    for s in range(fan_out):
        def at(slots: range) -> Column:
            return F.concat(F.lit(""), *[F.coalesce(F.col(f"h{(t - s) % fan_out}"), F.lit("")) for t in slots])

        lefts = F.when(slot == s, at(range(s))).otherwise(lefts)
        rights = F.when(slot == s, at(range(s + 1, fan_out))).otherwise(rights)
    return out.select("g", "idx", "n", "hash", lefts.alias("lefts"), rights.alias("rights"))


def levels(nodes: DataFrame, most: int, fan_out: int) -> list[DataFrame]:
    """Families of each level, from the leaves up, of groups of at most ``most`` nodes.

    The nodes in slot zero emit the parents; a group that has come down to one node, its root,
    stays on that level. Each level is stored, so none is worked out twice.
    """
    out = []
    while True:
        made = stored(families(nodes, fan_out))
        out.append(made)
        if most <= 1:
            return out
        most = -(-most // fan_out)
        nodes = made.where((F.col("n") > 1) & (F.col("idx") % fan_out == 0)).select(
            "g",
            F.floor(F.col("idx") / fan_out).cast("long").alias("idx"),
            F.ceil(F.col("n") / fan_out).cast("long").alias("n"),
            digest("hash", "rights").alias("hash"),
        )


def paths(made: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """(g, idx, subroot, path) for the leaves: what stands beside each of their ancestors.

    ``path`` lists (lefts, rights) from the leaf upwards and ends with the path of its group's
    root, from ``tops`` (g, path). Parents hand their path down, so each level joins a third of
    its rows, and the work of all levels is that of the leaves, half as much again.
    """
    top = tops.select(F.col("g").alias("g2"), F.col("path").alias("path2"))
    step = F.array(F.struct("lefts", "rights"))
    above = None
    for level, made_here in reversed(list(enumerate(made))):
        roots = (
            made_here.where("n = 1")
            .join(top, F.col("g") == F.col("g2"))
            .select("g", "idx", F.col("hash").alias("subroot"), F.col("path2").alias("path"))
        )
        here = roots
        if above is not None:
            parents = above.select(
                F.col("g").alias("g3"), F.col("idx").alias("idx3"), "subroot", F.col("path").alias("path3")
            )
            parent = F.floor(F.col("idx") / fan_out).cast("long")
            children = (
                made_here.where("n > 1")
                .withColumn("_parent", parent)
                .join(parents, (F.col("g") == F.col("g3")) & (F.col("_parent") == F.col("idx3")))
                .select("g", "idx", "subroot", F.concat(step, "path3").alias("path"))
            )
            here = children.unionByName(roots)
        above = stored(here) if level else here
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, at: digest(at["lefts"], own, at["rights"]))


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    group: str,
    key: str,
    extra: dict[str, Column] | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """One row per row of the table: ``key``, leaf, subroot, root, path, and the ``extra`` columns.

    A leaf is the digest of the values of ``columns`` (``row_digest``). In each group leaves stand by
    key, null first, rows of one key by their digest; every ``fan_out`` nodes in a row, at the end
    fewer, even one, become the digest of theirs, until one is left: the subroot. Subroots by
    group, null first, then bytewise, give the root in the same way. ``path`` is the proof: an
    array of (lefts, rights), the digests beside the leaf and beside each of its ancestors, from
    the leaf upwards. ``extra`` are worked out in the same pass over the table.

    Nulls in any column have a digest of their own; null is a group like others. Repeated rows are
    leaves of their own, with equal digests; which of them stands first makes no difference to the
    roots. An empty table has an empty manifest. Texts are read once and never moved: only
    digests are shuffled. A path has one step for each time the rows can be divided by
    ``fan_out``. Columns of the table named like results do no harm, but for names in ``extra``.
    """
    if fan_out < 2:
        raise ValueError("fan_out must be 2 or more")
    leaves = stored(rows.select(
        F.col(group).cast("string").alias("grp"),
        F.col(key).alias("key"),
        row_digest(*[F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(f"x_{name}") for name, c in (extra or {}).items()],
    ))
    placed, groups = ranked(leaves)
    nodes = placed.select("g", "idx", "n", F.col("leaf").alias("hash"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    made = levels(nodes, most, fan_out)
    roots = made[0].where("n = 1")
    for level in made[1:]:
        roots = roots.unionByName(level.where("n = 1"))
    n_groups = groups.count()
    tops = roots.select(
        F.lit(0).cast("long").alias("g"),
        F.col("g").alias("idx"),
        F.lit(n_groups).cast("long").alias("n"),
        "hash",
    )
    above = levels(tops, n_groups, fan_out)
    root = above[-1].where("n = 1").select("hash").first()
    none = F.array().cast("array<struct<lefts:string,rights:string>>")
    start = above[-1].where("n = 1").select("g", none.alias("path")).limit(1)
    upper = stored(
        paths(above, start, fan_out).select(F.col("idx").alias("g"), "path")
    )
    found = paths(made, upper, fan_out).withColumnsRenamed({"g": "g4", "idx": "idx4"})
    joined = placed.join(found, (F.col("g") == F.col("g4")) & (F.col("idx") == F.col("idx4")))
    results = {
        "leaf": F.col("leaf"),
        "subroot": F.col("subroot"),
        "root": F.lit(root["hash"] if root else None).cast("string"),
        "path": F.col("path"),
        **{name: F.col(f"x_{name}") for name in (extra or {})},
    }
    return joined.select(
        F.col("key").alias(key), *[c.alias(unused(rows.select(key), name)) for name, c in results.items()]
    )


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["lefts"], at["rights"])), ""), 256)
