"""Connected groups: of links, and of the members of buckets that a check links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwarden.llm.common import passing, staged


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b); a component is known by its smallest id.

    Each round every node takes the smallest label around it, then the label of that label, until none changes: a number
    of rounds about the logarithm of the longest path. Labels are staged each round; only a count of changes reaches the driver.
    """
    edges = staged(links.select("a", "b").union(links.select("b", "a")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = staged(labels.join(around, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")), "lower")
        of_label = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        jumped = lower.join(of_label, "component", "left").select("id", F.least("component", F.coalesce("next", "component")).alias("component"), "was")
        jumped = staged(jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.filter(F.col("component") != F.col("was")).isEmpty():
            return labels


def bucket_groups(
    buckets: DataFrame,
    check: Callable[[DataFrame, DataFrame], DataFrame],
    prepare: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    stars: int = 2,
    cheap: int = 4,
    broadcast_buckets: int = 1_000_000,
    bound: tuple[list[str], Column] | None = None,
    cells: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    read: Callable[[], None] = lambda: None,
) -> DataFrame:
    """(id, component) of the ids that ``check`` links to another one of the same bucket.

    buckets: (bucket, id), distinct. ``prepare(ids)`` gives what ``check(pairs, prepared)`` needs to return the linked ones of
    ``pairs`` (a, b), where many pairs may share one a. The groups are those of all pairs of a bucket, without forming them: first each
    bucket's members are checked with one of them only, the one whose buckets are largest, which is the middle of a
    group of variants. What is linked is one group; pairs within a group need no check. Only buckets that still hold several
    groups go on, with another member each, until the pairs left are at most ``cheap`` times the members, or after
    ``stars`` rounds. Then every pair of members of different groups that is left is checked. If ``refine(ids, prepared)`` is
    given, it deals the members left after the first round into finer buckets (bucket, id), of which any two ids to be linked
    share one, and these are treated so instead. It may mark members as ``core``; then only pairs with a core member need be checked.

    ``bound`` names columns of ``prepared`` and a condition on them (``x_a`` and ``x_b`` for a column x) that every pair that ``check`` links
    fulfils. It is tested inside the join of the members that are left, so that pairs that fail it never leave that join.

    ``cells(inside, prepared)``, if given, finds the links among the members (bucket, id, component) that are left itself, so that their
    pairs never become rows; it may return more links that hold, and any links that join the same groups.

    ``read`` is called once ``buckets`` are not needed any more. Tables that only the next step reads go as soon as it has.

    Buckets of one member leave at the start; the keys of the others (8 bytes each) are broadcast for that up to ``broadcast_buckets``.
    """

    def shared_only(all_members: DataFrame) -> DataFrame:
        shared, drop_shared = passing(all_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
        sized = all_members.join(F.broadcast(shared) if shared.count() <= broadcast_buckets else shared, "bucket")
        core = F.col("core") if "core" in all_members.columns else F.lit(True).alias("core")
        sized, drop_sized = passing(sized.select("bucket", "id", "n", core), "sized")
        drop_shared()
        members = staged(sized.join(sized.groupBy("id").agg(F.sum("n").alias("score")), "id").select("bucket", "id", "core", "score"), "members")
        drop_sized()
        return members

    members = shared_only(buckets)
    read()
    prepared = prepare(members.select("id").distinct())
    labels, links = None, None

    def add(pairs: DataFrame) -> None:
        join(check(pairs.distinct(), prepared))

    def join(found: DataFrame) -> None:
        nonlocal labels, links
        found = staged(found.select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    def settle(members: DataFrame, rounds: int, last: bool) -> DataFrame | None:
        """Checks what must be; returns the members left after the rounds, if finer buckets shall deal with them."""
        used = None
        for star in range(rounds + 1):
            if labels is None:
                marked = members.withColumn("component", F.col("id"))
            else:
                marked = members.join(labels, "id", "left").select("bucket", "id", "core", "score", F.coalesce("component", "id").alias("component"))
            groups = marked.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("core")).alias("rim"))
            n, apart = F.sum("n"), lambda c: (F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))) / 2
            mixed = staged(groups.groupBy("bucket").agg((apart("n") - apart("rim")).alias("pairs"), n.alias("n")).filter("pairs > 0"), "mixed")
            left = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
            if not left["pairs"]:
                return None
            inside, drop_inside = passing(marked.join(mixed.select("bucket"), "bucket"), "inside")
            if not last and star == rounds:
                return inside
            if last and (left["pairs"] <= cheap * left["n"] or star == rounds):
                if cells:
                    join(cells(inside, prepared))
                    drop_inside()
                    return None
                names, fits = bound or ([], F.lit(True))
                if names:
                    bounded, drop_bounded = passing(inside.join(prepared.select("id", *names), "id"), "bounded")
                    drop_inside()
                    inside, drop_inside = bounded, drop_bounded
                one, other = (inside.select("bucket", F.col("id").alias(e), F.col("core").alias(f"core_{e}"), F.col("component").alias(f"c{e}"), *[F.col(c).alias(f"{c}_{e}") for c in names]) for e in "ab")
                once = (F.col("a") < F.col("b")) | ~F.col("core_b")
                met = one.filter("core_a").join(other, "bucket").filter(once & (F.col("ca") != F.col("cb")) & fits)
                add(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
                drop_inside()
                return None
            fresh = inside if used is None else inside.join(used, ["bucket", "id"], "left_anti")
            best = F.max(F.struct("score", F.col("id").alias("a"), F.col("component").alias("ca"))).alias("c")
            centers = staged(fresh.groupBy("bucket").agg(best).select("bucket", "c.a", "c.ca"), "centers")
            now = centers.select("bucket", F.col("a").alias("id"))
            used = now if used is None else used.unionByName(now)
            add(inside.join(centers, "bucket").filter(F.col("component") != F.col("ca")).select("a", F.col("id").alias("b")))
            drop_inside()
        return None

    rest = settle(members, stars if refine is None else 1, last=refine is None)
    if rest is not None:
        settle(shared_only(staged(refine(rest.select("id").distinct(), prepared), "finer")), stars, last=True)
    return labels if labels is not None else members.select("id", F.col("id").alias("component")).limit(0)
