"""Merkle manifest of a dataset: one tree per group, one over the groups' roots, and a proof for every row.

Rows are numbered inside their group by key ranges (no global sort in one task), and ``2 ** bits`` consecutive ones are a
leaf partition. Trees are climbed tier by tier, ``bits`` levels at a time: a partition folds its own nodes and hands up one.

Proofs are an octopus multiproof, one per leaf partition: the partition lists the coordinates ``(level, index)`` of all
nodes that its rows' proofs need and that do not follow from its own rows, each once; they are fetched by one join with the
stored nodes; the interiors that the rows share are folded once; the single proofs are expanded in the task. Since
partitions are aligned, what is missing is the siblings on the way up. A partition of any tier asks only for nodes of the
next tier, and takes over what its parent partition fetched, so a node is asked for at most ``2 ** (bits - 1)`` times and
the nodes near the root are not hot.

Digests are lowercase hex; H is the sha256 of its inputs' concatenation.

Defined results for odd inputs: a null column is ``-`` in the leaf; a null group is a group and comes first; null ids
come first in their group, rows of one id are ordered by leaf, equal rows are leaves of their own; a lone row's leaf is its
group's root, a lone group's root the root, and without siblings the proof is the digest of nothing; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm.numbering import bounded_groups, number_rows
from backglot.sources.tables import hand_over, scan

BITS = 10  # levels folded by one partition
PROOF = ("leaf", "subroot", "root", "proof_sha256", "folded_root")


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def hashed(*digests: bytes) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def height(width: int) -> int:
    """Levels above ``width`` nodes until one is left."""
    return max(width - 1, 0).bit_length()


def fold_levels(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes and the ``levels`` levels above them; a last node without a partner is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def missing_coordinates(indices: list[int], width: int, levels: int | None = None) -> list[tuple[int, int]]:
    """``(level, index)`` of the nodes that proofs of all nodes at ``indices`` need beside those nodes, each once.

    What follows from the nodes themselves is left out; ``levels`` ends the way up before the root.
    """
    have, out = sorted(set(indices)), []
    for level in range(height(width) if levels is None else levels):
        held = set(have)
        out += [(level, i ^ 1) for i in have if i ^ 1 not in held and i ^ 1 < width]
        have = sorted({i >> 1 for i in have})
        width = (width + 1) // 2
    return out


def fold_proof(leaf: bytes, index: int, siblings: list[bytes | None]) -> bytes:
    """The root that a leaf and its siblings lead to; no sibling: the node is hashed alone."""
    node = leaf
    for sibling in siblings:
        pair = (node,) if sibling is None else (sibling, node) if index & 1 else (node, sibling)
        node, index = hashed(*pair), index >> 1
    return node


def _climb(batches: Iterator[pa.RecordBatch], keep_inner: bool, bits: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for group in bounded_groups(batches):
        width, block = group[0]["width"], group[0]["block"]
        levels = fold_levels([r["digest"].encode() for r in group], min(bits, height(width)))
        for level, nodes in enumerate(levels):
            top = level == len(levels) - 1
            if top or keep_inner:
                at = (block << bits) >> level
                wide = -(-width >> level)
                rows += [(group[0]["tree"], level, at + i, wide, top, n.decode()) for i, n in enumerate(nodes)]
        if len(rows) > 10_000:
            yield _stored(rows)
            rows = []
    yield _stored(rows)


def _stored(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    names = ["tree", "level", "pos", "width", "top", "digest"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def climb(nodes: DataFrame, keep_inner: bool, bits: int) -> DataFrame:
    """``(tree, level, pos, width, top, digest)`` of one tier above ``nodes(tree, pos, width, digest)``; levels count from them."""
    blocks = nodes.select("tree", "pos", "width", "digest", F.shiftright("pos", bits).alias("block"))
    dealt = blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(
        lambda batches: _climb(batches, keep_inner, bits),
        "tree string, level int, pos long, width long, top boolean, digest string",
    )


def fetch_paths(leaves: DataFrame, bits: int) -> DataFrame:
    """``(tree, block, path, subroot)`` of every partition of ``leaves(tree, pos, width, digest)``.

    ``path`` holds the fetched siblings from the partition's own root upwards, null where there is none.
    """
    tier = hand_over(climb(leaves, False, bits), "nodes")
    tiers = []
    while True:
        tops = tier.where("top").select("tree", "pos", "width", "digest")
        none = F.array().cast("array<string>")
        done = tops.where("width = 1").select("tree", F.col("pos").alias("block"), none.alias("path"), F.col("digest").alias("subroot"))
        more = tops.where("width > 1")
        if more.isEmpty():
            paths = done
            break
        tier = hand_over(climb(more, True, bits), "nodes")
        tiers.append((done, more, tier))
    for done, below, above in reversed(tiers):
        paths = hand_over(done.union(_fetch(below, above, paths, bits)), "paths")
    return paths


def _wanted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The coordinates in the next tier that each partition's proofs miss; a null index where a level has no sibling."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            levels = min(bits, height(row["width"]))
            missed = dict(missing_coordinates([row["pos"]], row["width"], levels))
            rows += [(row["tree"], row["pos"], row["pos"] >> bits, level, missed.get(level)) for level in range(levels)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        made = [pa.array(c, k) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(made, ["tree", "block", "parent", "level", "index"])


def _fetch(below: DataFrame, above: DataFrame, parents: DataFrame, bits: int) -> DataFrame:
    """Paths of partitions with the roots ``below`` from the stored nodes ``above`` and the paths of their parents."""
    wanted = below.mapInArrow(lambda batches: _wanted(batches, bits), "tree string, block long, parent long, level int, index long")
    store = above.where("NOT top").select("tree", "level", F.col("pos").alias("index"), "digest")
    found = wanted.join(store, ["tree", "level", "index"], "left").groupBy("tree", "block", "parent")
    found = found.agg(F.array_sort(F.collect_list(F.struct("level", "digest"))).alias("items"))
    up = parents.select("tree", F.col("block").alias("parent"), F.col("path").alias("rest"), "subroot")
    joined = found.join(up, ["tree", "parent"])
    return joined.select("tree", "block", F.concat(F.col("items.digest"), F.col("rest")).alias("path"), "subroot")


def _prove(batches: Iterator[pa.RecordBatch], key: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of every partition with their proofs; its first row carries what was fetched."""
    batches = iter(batches)
    some = next(batches, None)
    if some is None:
        return
    kinds = [some.schema.field(key).type] + [pa.string()] * 5
    for group in bounded_groups(chain([some], batches)):
        head, rows = group[0], group[1:]
        levels = fold_levels([r["digest"].encode() for r in rows], min(bits, height(rows[0]["width"])))
        above = [s and s.encode() for s in head["path"]]
        over = [s and s.encode() for s in head["over"]]
        out = []
        for i, row in enumerate(rows):
            siblings = _inside(levels, i) + above
            folded = fold_proof(fold_proof(row["given"].encode(), row["pos"], siblings), head["tree_pos"], over)
            proof = hashed(*[s for s in siblings + over if s is not None])
            out.append((row[key], row["digest"], head["subroot"], head["root"], proof.decode(), folded.decode()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [key, *PROOF])


def _inside(levels: list[list[bytes]], i: int) -> list[bytes | None]:
    """Siblings of the i-th row inside its partition."""
    siblings = []
    for nodes in levels[:-1]:
        siblings.append(nodes[i ^ 1] if i ^ 1 < len(nodes) else None)
        i >>= 1
    return siblings


def prove_rows(rows: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``(key, leaf, subroot, root, proof_sha256, folded_root)`` of ``rows(tree, key, digest, given)``.

    ``digest`` is the leaf of the manifest, ``given`` the leaf that the proof is checked with; trees are ordered by name.
    """
    leaves = hand_over(number_rows(rows, [key, "digest"]), "leaves")
    paths = fetch_paths(leaves.select("tree", "pos", "width", "digest"), bits)
    roots = paths.select("tree", F.col("subroot").alias("digest")).distinct()
    # The trees' roots are the leaves of one more tree.
    trees = number_rows(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    trees = hand_over(trees, "trees")
    over = fetch_paths(trees.select("tree", "pos", "width", "digest"), bits)
    over = hand_over(_inside_paths(trees, over, bits), "over")
    heads = paths.join(over, "tree")

    kind = dict(rows.dtypes)[key]
    none = lambda t: F.lit(None).cast(t)
    texts = "array<string>"
    body = leaves.select(
        "tree", F.shiftright("pos", bits).alias("block"), "pos", "width", key, "digest", "given",
        none(texts).alias("path"), none(texts).alias("over"), none("string").alias("subroot"), none("string").alias("root"),
        none("long").alias("tree_pos"),
    )
    first = heads.select(
        "tree", "block", F.lit(-1).cast("long").alias("pos"), none("long").alias("width"), none(kind).alias(key),
        none("string").alias("digest"), none("string").alias("given"), "path", "over", "subroot", "root", "tree_pos",
    )
    both = body.unionByName(first).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    schema = f"{key} {kind}, " + ", ".join(f"{n} string" for n in PROOF)
    return both.mapInArrow(lambda batches: _prove(batches, key, bits), schema)


def _inside_paths(trees: DataFrame, paths: DataFrame, bits: int) -> DataFrame:
    """``(tree, tree_pos, over, root)`` per tree: its whole path, one sibling a level up to the root."""
    blocks = trees.select("tree", "name", "pos", "width", "digest", F.shiftright("pos", bits).alias("block"))
    first = paths.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "path", "subroot")
    both = blocks.unionByName(first, allowMissingColumns=True)
    dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.mapInArrow(lambda batches: _list_paths(batches, bits), "tree string, tree_pos long, over array<string>, root string")


def _list_paths(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for group in bounded_groups(batches):
        head, rows = group[0], group[1:]
        levels = fold_levels([r["digest"].encode() for r in rows], min(bits, height(rows[0]["width"])))
        out = []
        for i in range(len(rows)):
            out.append([s and s.decode() for s in _inside(levels, i)] + head["path"])
        columns = [
            pa.array([r["name"] for r in rows], pa.string()),
            pa.array([r["pos"] for r in rows], pa.int64()),
            pa.array(out, pa.list_(pa.string())),
            pa.array([head["subroot"]] * len(rows), pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "tree_pos", "over", "root"])


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = scan(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    others = [F.col("doc_id"), F.col("source"), F.col("lang")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = leaf_digest(*others, F.col("n_chars"), F.col("text"))
    changed = leaf_digest(*others, F.col("n_chars") + 1, F.col("text"))
    rows = docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("tree"),
        "doc_id",
        leaf.alias("digest"),
        F.when(tampered, changed).alias("given"),
    )
    rows = rows.withColumn("given", F.coalesce("given", "digest"))
    return prove_rows(rows, "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def _rise(name: str, start: str) -> str:
    """SQL: all levels of the trees over ``start(tree, pos, width, digest)``."""
    return f"""{name}(tree, level, pos, width, digest) AS (
  SELECT tree, 0, pos, width, digest FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(width) + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE width > 1 GROUP BY tree, level, pos // 2
)"""


def _way(name: str, start: str, nodes: str) -> str:
    """SQL: the node on the way up and the sibling beside it, level by level, from ``start(id, tree, pos, node)``."""
    return f"""{name}(id, tree, level, pos, node, sibling) AS (
  SELECT f.id, f.tree, 0, f.pos, f.node, n.digest FROM {start} f
  LEFT JOIN {nodes} n ON n.tree = f.tree AND n.level = 0 AND n.pos = xor(f.pos, 1)
  UNION ALL
  SELECT w.id, w.tree, w.level + 1, w.pos // 2,
    sha256(CASE WHEN w.sibling IS NULL THEN w.node WHEN w.pos % 2 = 1 THEN w.sibling || w.node ELSE w.node || w.sibling END),
    n.digest
  FROM {name} w JOIN {nodes} h ON h.tree = w.tree AND h.level = w.level AND h.pos = w.pos AND h.width > 1
  LEFT JOIN {nodes} n ON n.tree = w.tree AND n.level = w.level + 1 AND n.pos = xor(w.pos // 2, 1)
)"""


_PARTS = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_PARTS.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b:
    list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
OP11_SQL = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format("n_chars")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 7 = 0 THEN {_LEAF.format("n_chars + 1")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS width, leaf AS digest, row_number() OVER () AS id FROM given
), {_rise("nodes", "leaves")},
subroots AS (
  SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS width, digest
  FROM nodes WHERE width = 1
), {_rise("tops", "subroots")},
starts AS (SELECT id, tree, pos, coalesce(changed, leaf) AS node FROM leaves),
{_way("ways", "starts", "nodes")},
ends AS (
  SELECT id, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof, arg_max(node, level) AS node FROM ways GROUP BY id
), seconds AS (
  SELECT e.id, '' AS tree, s.pos, e.node FROM ends e JOIN leaves l ON l.id = e.id JOIN subroots s ON s.name = l.tree
), {_way("over_ways", "seconds", "tops")},
over_ends AS (
  SELECT id, string_agg(coalesce(sibling, ''), '' ORDER BY level) AS proof, arg_max(node, level) AS node
  FROM over_ways GROUP BY id
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof || o.proof) AS proof_sha256,
  o.node AS folded_root, o.node = r.digest AS verified
FROM leaves l JOIN ends e ON e.id = l.id JOIN over_ends o ON o.id = l.id JOIN subroots s ON s.name = l.tree
CROSS JOIN (SELECT digest FROM tops WHERE width = 1) r
"""
