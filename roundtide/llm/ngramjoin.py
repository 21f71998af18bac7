"""Jaccard join on word n-grams: rare-first prefixes, length, positional and suffix filters.

Two sets that reach the threshold share an n-gram among the first few of each (the prefix) under any
common order. The order here is rare first: by the number of documents that hold an n-gram, then by
its hash.

1. N-grams that one document alone holds come first in it. Those in a fixed quarter of the hash space
   are counted for all documents; a document with as many of its own as its prefix is long has no
   partner and leaves. What is left (copies, mostly) is counted in full, one document for equal sets.
2. Prefix n-grams of two or more documents are posting lists; of equal lists one is kept.
3. Hub rounds: in each list every member meets the member of least rank; a pair must pass the length,
   positional and suffix filters and is verified once, on full sets. Links make components, so a
   list of near copies takes as many comparisons as it has members.
4. In lists that still span several components the members outside the largest one meet the others,
   dealt into blocks; only pairs of different components that pass the filters leave the join, each
   once, and are verified.

The suffix filter cuts the hash space into ``PARTITIONS`` parts and keeps the parity of a set's count in
each: parts of unequal parity hold an n-gram that only one of the two sets has. All filters are exact.

Edge cases: null, empty and blank texts have no n-grams and link with nothing; a text of fewer words
than an n-gram is one n-gram; documents with a null id are returned unlinked with a null component;
repeated rows of one id are one node with the links of all its texts and come back once per row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns, stage_table, texts
from roundtide.llm.graph import components
from roundtide.llm.neardup import linked, mix, shingler

#: Every so many n-grams are counted for all documents.
SLICE = 4
PARTITIONS = 1024
HUB_ROUNDS = 2
#: Members of a list on one side of a block; pairs that read one copy of a set.
BLOCK = 1024
#: Keys with at least 1 / FREQUENT of the rows go to all tasks: at most so many.
FREQUENT = 1 << 14


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join with a table of one row a key that says how many rows hold it.

    Keys with a large share of the rows, ``FREQUENT`` at most, are broadcast; no other key is large.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * FREQUENT >= total
    hot = F.broadcast(facts.where(often))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(facts.where(~often), key))


def prefix_length(n, percent: int):
    """Prefix of a set of n: one more than what may be missing from a set that reaches the threshold."""
    return n - F.ceil(n * percent / F.lit(100)).cast("long") + 1


def least_overlap(na, nb, percent: int):
    """The smallest intersection of sets of these sizes at the threshold."""
    return F.ceil((na + nb) * percent / F.lit(100 + percent))


def _sized(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, digest, part): the size and 128-bit digest of each set, and its n-grams of one slice."""

    def make():
        shingles = shingler(width)

        def step(ids, text):
            out = [], [], [], []
            for i, t in zip(ids, text):
                h = shingles(t)
                digest = np.array([h.sum(), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()
                for column, value in zip(out, (i, len(h), digest, h[h % np.uint64(SLICE) == 0].tobytes())):
                    column.append(value)
            return list(out)

        return step

    return map_columns(texts(docs), make, "doc_id long, n long, digest binary, part binary")


def _listed(rows: DataFrame, sets: str) -> DataFrame:
    """(rid, gram) for every hash of packed sets."""

    def make():
        def step(rid, packed):
            arrays = [np.frombuffer(p, np.int64) for p in packed]
            return [np.repeat(np.array(rid, np.int64), [len(a) for a in arrays]), np.concatenate(arrays) if arrays else []]

        return step

    return map_columns(rows.select("rid", sets), make, "rid long, gram long", chunk=64)


def _with_partners(sized: DataFrame, percent: int) -> DataFrame:
    """Documents whose own n-grams in the slice don't fill their prefix."""
    grams = _listed(sized, "part").groupBy("gram").agg(F.min("rid").alias("rid"), F.count("*").alias("held"))
    own = grams.where("held = 1").groupBy("rid").agg(F.count("*").alias("own"))
    left = sized.drop("part").join(own, "rid", "left").where(F.coalesce("own", F.lit(0)) < prefix_length(F.col("n"), percent))
    return left.drop("own")


def _full_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(rid, n, node, marks, grams): full sets of the representatives, with the parity of each partition."""

    def make():
        shingles = shingler(width)

        def step(ids, text):
            out = [], [], [], []
            for i, t in zip(ids, text):
                h = shingles(t)
                digest = np.array([h.sum(), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes()
                parity = np.bincount((h >> np.uint64(32)).astype(np.int64) % PARTITIONS, minlength=PARTITIONS) & 1
                marks = np.packbits(parity.astype(np.uint8)).view(np.int64)
                for column, value in zip(out, (i, digest, marks, h.tobytes())):
                    column.append(value)
            return list(out)

        return step

    found = texts(docs).join(reps.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = map_columns(found, make, "node long, digest binary, marks array<long>, grams binary").dropDuplicates(["node", "digest"])
    return found.join(reps, ["node", "digest"]).drop("digest")


def _members(sets: DataFrame, percent: int) -> DataFrame:
    """(list, size, rid, n, at): members of the posting lists, with the n-gram's position in each."""
    grams = stage_table(_listed(sets, "grams"), "grams")
    shared = stage_table(grams.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"), "shared-grams")
    ranked = join_hot(grams, shared, "gram", "held").join(sets.select("rid", "n"), "rid")
    per_set = Window.partitionBy("rid")
    ranked = ranked.withColumn("own", F.col("n") - F.count("*").over(per_set))
    ranked = ranked.withColumn("at", F.col("own") + F.row_number().over(per_set.orderBy("held", "gram")))
    prefixes = stage_table(ranked.where(F.col("at") <= prefix_length(F.col("n"), percent)).select("gram", "rid", "n", "at"), "prefixes")
    lists = prefixes.groupBy("gram").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("who"))
    lists = lists.where("size > 1").groupBy("who", "size").agg(F.min("gram").alias("gram")).select("gram", "size")
    return join_hot(prefixes, stage_table(lists, "lists"), "gram", "size").withColumnRenamed("gram", "list")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length, positional and suffix filter on two rows with n, at and marks."""
    na, nb, at_a, at_b = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"at{a}"), F.col(f"at{b}")
    needed = least_overlap(na, nb, percent)
    reachable = F.least(at_a, at_b) + F.least(na - at_a, nb - at_b)
    apart = sum((F.bit_count(F.col(f"marks{a}")[i].bitwiseXOR(F.col(f"marks{b}")[i])) for i in range(PARTITIONS // 64)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (reachable >= needed) & (apart <= na + nb - 2 * needed)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids that reach the threshold, as pairs of nodes; a set of many pairs is read in copies."""
    pairs = stage_table(pairs.distinct(), "candidates")
    used = pairs.groupBy("b").agg(F.count("*").alias("pairs"))
    pairs = join_hot(pairs, stage_table(used, "candidate-counts"), "b", "pairs")
    pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("a"), F.ceil(F.col("pairs") / BLOCK)))
    copies = pairs.select("b", "copy").distinct().join(sets.select(F.col("rid").alias("b"), F.col("grams").alias("grams_b"), F.col("node").alias("node_b")), "b")
    both = pairs.select("a", "b", "copy").join(copies, ["b", "copy"])
    both = both.join(sets.select(F.col("rid").alias("a"), F.col("grams").alias("grams_a"), F.col("node").alias("node_a")), "a")

    def make():
        def step(a, b, x, y):
            keep = [(i, j) for i, j, s, t in zip(a, b, x, y) if linked(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent)]
            return [[i for i, _ in keep], [j for _, j in keep]]

        return step

    return map_columns(both.select("node_a", "node_b", "grams_a", "grams_b"), make, "a long, b long", chunk=64)


def _hub_pairs(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a list of several components with the list's member of least rank in this turn."""
    rank = F.struct(F.xxhash64("node", F.lit(turn)).alias("k"), "rid", "node", "component", "n", "at", "marks")
    hubs = members.groupBy("list").agg(F.min(rank).alias("hub"), F.count("*").alias("rows"))
    hubs = stage_table(hubs.where("rows > 1"), "hubs")
    met = join_hot(members, hubs, "list", "rows").where("component != hub.component and rid != hub.rid")
    named = met.select(
        *[F.col(c).alias(f"{c}_a") for c in ("rid", "n", "at", "marks")], *[F.col(f"hub.{c}").alias(f"{c}_b") for c in ("rid", "n", "at", "marks")]
    )
    return named.where(_may_link("_a", "_b", percent)).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


def _rest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one list: those outside its largest component meet the others."""
    parts = members.groupBy("list", "component").agg(F.count("*").alias("k"))
    mains = parts.groupBy("list").agg(
        F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("rows"), (F.sum("k") - F.max("k")).alias("outside"), F.count("*").alias("parts")
    )
    mains = stage_table(mains.where("parts > 1"), "open-lists")
    rows = stage_table(join_hot(members, mains, "list", "rows"), "open-members")
    block = lambda count: F.pmod(F.xxhash64("rid"), F.ceil(F.col(count) / BLOCK))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(count) / BLOCK) - 1))
    facts = "rid", "component", "n", "at", "marks"
    left = rows.where("component != main").select(
        "list", block("outside").alias("x"), every("rows").alias("y"), *[F.col(c).alias(f"{c}_a") for c in facts]
    )
    right = rows.select("list", every("outside").alias("x"), block("rows").alias("y"), (F.col("component") == F.col("main")).alias("inner"), *[F.col(c).alias(f"{c}_b") for c in facts])
    once = F.col("inner") | (F.col("rid_a") < F.col("rid_b"))
    met = left.join(right, ["list", "x", "y"]).where((F.col("component_a") != F.col("component_b")) & once & _may_link("_a", "_b", percent))
    return met.select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))


def linked_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links); a row per document."""
    sized = stage_table(_sized(docs, width).withColumn("rid", F.monotonically_increasing_id()), "sized")
    left = stage_table(_with_partners(sized.where("n > 0 and doc_id is not null"), percent), "with-partners")
    classes = stage_table(left.groupBy("digest", "n").agg(F.min(F.struct("doc_id", "rid")).alias("first")), "classes")
    reps = classes.select("digest", "n", F.col("first.rid").alias("rid"), F.col("first.doc_id").alias("node"))
    sets = stage_table(_full_sets(docs, reps, width), "sets")
    members = _members(sets, percent).join(sets.select("rid", "node", "marks"), "rid")
    members = stage_table(members, "members")

    # equal sets, and the texts of one id, are linked from the start
    same = left.join(classes, ["digest", "n"]).select("doc_id", F.col("first.doc_id").alias("node")).where("doc_id != node")
    links = stage_table(same.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "links")
    for turn in range(HUB_ROUNDS + 1):
        named = stage_table(components(links), "components")
        placed = members.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs = _hub_pairs(placed, turn, percent) if turn < HUB_ROUNDS else _rest_pairs(placed, percent)
        links = stage_table(links.unionByName(_verified(pairs, sets, percent)), "links")
    named = components(links).withColumnRenamed("node", "doc_id")
    return sized.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
