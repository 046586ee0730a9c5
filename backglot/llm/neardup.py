"""MinHash near-deduplication as a chosen-path set similarity join.

* Every document's shingle set gets minwise tokens. In each of ``trees`` independent trees documents branch by the
  token of the next depth, recursively, until a node holds at most ``small`` documents or ``depth`` is reached.
* A small node is compared exhaustively in the task that owns it, by sketches: a breadth-first search in which each document
  meets only those not reached yet. It emits the links of a spanning forest, so a node never makes more rows than it has
  documents. The sketch lets every pair near the threshold pass; what it connects are candidates.
* Candidate components are confirmed on full sets: a component of at most ``small`` documents goes to one task with its sets,
  a larger one by its nodes. The search is the same, exact this time. Components are taken over the confirmed links.
* A node that no branching makes small holds near copies. It is dealt out in chunks of ``small`` documents, each with the
  node's least document. Documents that are not in that document's component in the end (strays) meet all chunks,
  on full sets.

Identical sets are one vertex, found by a digest, so thousands of copies cost one row. A pair of similarity s shares
a node at depth d with probability s^d per tree; with the defaults, a pair at 0.8 is missed once in 10^14 cases where
nodes split at the first level, and once in 340 where they split down to the last; a document is lost to a component only if all
its links to it are.

Defined results for odd inputs: texts without words (null, empty) have the empty set and link with nothing; rows of
one ``doc_id`` are one vertex, linked by any of their texts; a null ``doc_id`` links with nothing, has a null component and is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.components import connected_components
from backglot.llm.shingles import Minwise, alike_by_set, alike_by_sketch, feature_batches, search_links, set_batches
from backglot.session import ship_package
from backglot.sources.tables import Scratch, scan

TREES = 20
DEPTH = 6
SMALL = 256  # documents of a node that are compared at once


def features(docs: DataFrame, shingle: int, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Per document: size and digest of its shingle set, sketch, and its node at the first depth of every tree."""
    ship_package(docs.sparkSession)
    minwise = Minwise(trees, depth)
    kind = dict(docs.dtypes)["doc"]
    schema = f"doc {kind}, n_shingles long, digest binary, sketch binary, nodes array<bigint>"
    return docs.mapInArrow(lambda batches: feature_batches(batches, shingle, minwise), schema)


def branch(vertices: DataFrame, scratch: Scratch, depth: int = DEPTH, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """Final nodes ``(node, digest)`` of 2 to ``small`` documents, and those ``(node, digest, size)`` that stay larger.

    The first level looks at digests alone; only documents of crowded nodes bring their sketch along and branch on by it.
    """
    open_ = vertices.select("digest", F.posexplode("nodes").alias("tree", "node"))
    final, old = None, None
    for level in range(1, depth + 1):
        sizes = scratch.keep(open_.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes")
        joined = scratch.keep(open_.join(sizes, "node"), "branched")
        scratch.drop(sizes, *([old] if old is not None else []))
        done, old = joined.where(F.col("size") <= small).select("node", "digest"), joined
        done = scratch.keep(done, "final")
        final = done if final is None else final.unionByName(done)
        open_ = joined.where(F.col("size") > small).drop("size")
        if open_.isEmpty():
            return final, None
        if level == 1:
            open_ = open_.join(vertices.select("digest", "sketch"), "digest")
        if level < depth:
            byte = F.substring("sketch", F.col("tree") * depth + level + 1, F.lit(1))
            open_ = open_.withColumn("node", F.xxhash64("node", byte))
    return final, scratch.keep(joined.where(F.col("size") > small).select("node", "digest", "size"), "crowded")


def _chunk(size: Column, small: int, digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.ceil(size / small))


def chunks(crowded: DataFrame, small: int) -> DataFrame:
    """Crowded nodes as nodes ``(node, digest)`` of about ``small`` documents, each beside the node's least document."""
    dealt = crowded.select(F.xxhash64("node", _chunk(F.col("size"), small, F.col("digest"))).alias("node"), "digest")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / small) - 1)).alias("chunk")
    copied = leaders(crowded).select("node", "digest", every).select(F.xxhash64("node", "chunk").alias("node"), "digest")
    return dealt.union(copied).distinct()


def leaders(crowded: DataFrame) -> DataFrame:
    """``(node, digest, size)`` of every crowded node's least document, by a hash."""
    least = crowded.groupBy("node").agg(F.min(F.xxhash64("digest")).alias("least"))
    both = crowded.join(least, "node").where(F.xxhash64("digest") == F.col("least"))
    return both.select("node", "digest", "size")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Columns of one ``grp`` after another; groups are bounded."""
    held, last = None, None
    for batch in batches:
        columns = batch.to_pydict()
        groups = columns.pop("grp")
        start = 0
        for i in range(len(groups) + 1):
            if i < len(groups) and groups[i] == last:
                continue
            if held is not None:
                for c, values in columns.items():
                    held[c] += values[start:i]
            start = i
            if i < len(groups):
                if held is not None:
                    yield held
                held, last = {c: [] for c in columns}, groups[i]
    if held is not None:
        yield held


def links_within(rows: DataFrame, near) -> DataFrame:
    """``(u, v)``: a spanning forest of the links of each ``grp`` of ``rows(grp, doc, ...)``, found in the task that owns it.

    ``near`` makes the test of :func:`search_links` from a group's columns; rows with one ``own`` count as linked.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        some = next(batches, None)
        if some is None:
            return
        kind = some.schema.field("doc").type
        found: list[tuple] = []

        def made() -> pa.RecordBatch:
            pair = [pa.array([link[k] for link in found], kind) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(pair, ["u", "v"])

        def whole():
            yield some
            yield from batches

        for group in _grouped(whole()):
            docs, own = group["doc"], group.get("own")
            label = None if own is None else np.unique(np.array(own), return_inverse=True)[1]
            links = search_links(len(docs), near(group), label) if len(docs) > 1 else []
            found += [(docs[i], docs[j]) for i, j in links if docs[i] != docs[j]]
            if len(found) > 10_000:
                yield made()
                found.clear()
        yield made()

    kind = dict(rows.dtypes)["doc"]
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(work, f"u {kind}, v {kind}").distinct()


def candidates(nodes: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    rows = nodes.join(vertices.select("digest", "doc", "n_shingles", "sketch"), "digest").withColumnRenamed("node", "grp").drop("digest")
    return links_within(rows, lambda g: alike_by_sketch(g["sketch"], np.array(g["n_shingles"]), percent))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    trees: int = TREES,
    depth: int = DEPTH,
    small: int = SMALL,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row of ``docs``: size of its set, least key it is linked to over any steps."""
    scratch = Scratch(docs.sparkSession)
    given = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    found = scratch.keep(features(given, shingle, trees, depth), "features")
    able = found.where("n_shingles > 0 AND doc IS NOT NULL")
    copies = able.groupBy("digest").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = scratch.keep(copies.select("digest", "rep"), "copies")
    held = able.select("doc", "digest").join(copies, "digest")
    same = scratch.keep(held.where("doc != rep").select(F.col("doc").alias("u"), F.col("rep").alias("v")).distinct(), "same")
    # A set is one vertex, named by the least document that has it.
    vertices = able.join(copies, "digest", "left").where("rep IS NULL OR rep = doc").drop("rep")
    vertices = scratch.keep(vertices.dropDuplicates(["digest"]), "vertices")

    nodes, crowded = branch(vertices, scratch, depth, small)
    if crowded is not None:
        nodes = nodes.unionByName(scratch.keep(chunks(crowded, small), "chunks"))
    coarse = scratch.keep(candidates(nodes, vertices, percent), "candidates")
    groups = scratch.keep(connected_components(coarse, scratch), "groups")

    kind = dict(given.dtypes)["doc"]
    exact = lambda g: alike_by_set(g["shingles"], percent)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Sets of vertices; ``wanted(doc)`` is distinct."""
        texts = given.join(wanted, "doc", "left_semi")
        made = texts.mapInArrow(lambda batches: set_batches(batches, shingle), f"doc {kind}, digest binary, shingles binary")
        return scratch.keep(made.where(F.octet_length("shingles") > 0).dropDuplicates(["doc", "digest"]), "sets")

    sets = sets_of(groups.select(F.col("id").alias("doc")))
    counted = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    sized = groups.join(counted, "component").select(F.col("id").alias("doc"), "component", "n")
    few = sets.join(sized.where(F.col("n") <= small), "doc").select(F.col("component").alias("grp"), "doc", "shingles")
    links = scratch.keep(links_within(few, exact), "links")
    many = sets.join(sized.where(F.col("n") > small).select("doc"), "doc", "left_semi")
    many = nodes.join(many, "digest").select(F.col("node").alias("grp"), "doc", "shingles")
    links = links.unionByName(scratch.keep(links_within(many, exact), "links")).unionByName(same)
    members = scratch.keep(connected_components(links, scratch), "members")

    if crowded is not None:
        more = stray_links(crowded, vertices, members, sets_of, exact, small, scratch)
        if more is not None:
            stars = members.where("id != component").select(F.col("id").alias("u"), F.col("component").alias("v"))
            members = scratch.keep(connected_components(stars.unionByName(more), scratch), "members")
    answer = found.select(F.col("doc").alias(key), "n_shingles").join(members.withColumnRenamed("id", key), key, "left")
    answer = scratch.keep(answer.select(key, "n_shingles", F.coalesce("component", key).alias("component_id")), "answer")
    scratch.drop_others(answer)
    return answer


def stray_links(crowded: DataFrame, vertices: DataFrame, members: DataFrame, sets_of, exact, small: int, scratch: Scratch) -> DataFrame | None:
    """Links of documents of crowded nodes that are outside the component of the node's least document."""
    of = members.select(F.col("id").alias("doc"), F.col("component").alias("own"))
    placed = crowded.join(vertices.select("digest", "doc"), "digest").join(of, "doc", "left")
    placed = scratch.keep(placed.withColumn("own", F.coalesce("own", "doc")), "placed")
    main = leaders(crowded).select("node", "digest").join(placed, ["node", "digest"]).select("node", F.col("own").alias("main"))
    placed = scratch.keep(placed.join(main, "node"), "placed")
    strays = placed.where("own != main")
    if strays.isEmpty():
        return None
    meeting = placed.join(strays.select("node").distinct(), "node", "left_semi")
    dealt = meeting.select(F.xxhash64("node", _chunk(F.col("size"), small, F.col("digest"))).alias("grp"), "doc", "digest", "own")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / small) - 1)).alias("chunk")
    spread = strays.select("node", "doc", "digest", "own", every).select(F.xxhash64("node", "chunk").alias("grp"), "doc", "digest", "own")
    rows = scratch.keep(dealt.union(spread).distinct(), "meeting")
    sets = sets_of(rows.select("doc").distinct())
    return scratch.keep(links_within(rows.join(sets, ["doc", "digest"]).drop("digest"), exact), "links")


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(scan(spark, folder, "documents"), shingle=4)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
