"""Merkle manifest of a dataset: a persistent tree whose versions copy only the path of a changed leaf.

Leaves are cut into aligned blocks of 8^4. One task builds a block's nodes; each
leaf that is checked makes a version of the block, which shares all nodes but the
leaf's ancestors. Block roots are the leaves of the tree above, built the same way
until one block is left, and so are the trees' roots. A block gets its path to
the root as one row, and its versions go on along it wherever the block lies:
versions of different blocks never meet.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivox.llm.common import cut, table
from lumivox.llm.ordered import numbered

#: Children of a node, fields of a leaf in order, and what divides the checksum of a tampered row's id.
ARITY, FIELDS, TAMPERED = 8, ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Levels that one task builds; a block has ARITY to this power leaves.
BLOCK_LEVELS = 4
#: ASCII capitals and their small letters.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left; a lone node has none."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Block:
    """The base version of consecutive nodes and their ancestors within the block."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def run(self, level: int, at: int) -> list[bytes]:
        start = at - at % ARITY
        return self.levels[level][start : start + ARITY]

    def path(self, at: int) -> Iterator[tuple[int, list[bytes]]]:
        """From a leaf upwards: its place in its run, and the run's others."""
        for level in range(len(self.levels) - 1):
            run, place = self.run(level, at), at % ARITY
            yield place, run[:place] + run[place + 1 :]
            at //= ARITY

    def version(self, at: int, leaf: bytes) -> list[bytes]:
        """Copies of the leaf's ancestors, lowest first, when the leaf is replaced; all other nodes are shared with the base."""
        copied = [leaf]
        for level in range(len(self.levels) - 1):
            run = self.run(level, at)
            run[at % ARITY] = copied[-1]
            copied.append(digest(*run))
            at //= ARITY
        return copied


def packed(path: Iterator[tuple[int, list[bytes]]]) -> bytes:
    """Steps of a path as bytes: place, number of siblings, siblings."""
    return b"".join(struct.pack("BB", place, len(others)) + b"".join(others) for place, others in path)


def steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        place, n = struct.unpack_from("BB", path, at)
        out.append((place, [path[i : i + 64] for i in range(at + 2, at + 2 + 64 * n, 64)]))
        at += 2 + 64 * n
    return out


def continued(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """The root of the version that has ``node`` at the foot of the path."""
    for place, others in path:
        node = digest(*others[:place], node, *others[place:])
    return node


def block_of(rows: pa.Table, levels: int) -> tuple[Block, pa.Table]:
    """A group's block and its rows in order."""
    rows = rows.sort_by("at")
    return Block([x.encode() for x in rows.column("digest").to_pylist()], min(levels, height(rows.column("n")[0].as_py()))), rows


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / ARITY**levels).cast("long"))


def upper(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, at, digest, n) of the nodes that the blocks of ``nodes`` end in."""

    def run(rows: pa.Table) -> pa.Table:
        block, rows = block_of(rows, levels)
        n = -(-rows.column("n")[0].as_py() // ARITY**levels)
        return pa.table({"tree": rows.column("tree")[:1], "at": rows.column("block")[:1], "digest": [block.root.decode()], "n": [n]})

    return in_blocks(nodes.select("tree", "at", "digest", "n"), levels).groupBy("tree", "block").applyInArrow(run, "tree string, at long, digest string, n long")


def paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, at, top, path) of every node: its tree's root and the packed path there.

    A tree of more than one block is built upwards first; each block then adds what it
    has to the path of its own root. The number of rounds is the logarithm of the largest tree.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= ARITY**levels:
        above = nodes.select("tree").distinct().select("tree", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("top"), F.lit(b"").alias("path"))
    else:
        above = paths(cut(upper(nodes, levels)), levels)

    def run(rows: pa.Table, onward: pa.Table) -> pa.Table:
        block, rows = block_of(rows, levels)
        rest, top = onward.column("path")[0].as_py(), onward.column("top")[0].as_py() or block.root.decode()
        ways = [packed(block.path(i)) + rest for i in range(rows.num_rows)]
        return pa.table({"tree": rows.column("tree"), "at": rows.column("at"), "top": [top] * len(ways), "path": pa.array(ways, pa.binary())})

    left = in_blocks(nodes.select("tree", "at", "digest", "n"), levels).groupBy("tree", "block")
    right = above.select(F.col("tree").alias("own"), F.col("at").alias("place"), "top", "path").groupBy("own", "place")
    return left.cogroup(right).applyInArrow(run, "tree string, at long, top string, path binary")


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed): leaf digests, and that after tampering where a row is tampered with."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    columns = {c: docs[c].cast(kinds.get(c, "string")) for c in FIELDS}

    def leaf(text: Column) -> Column:
        return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS[:-1]), field(text)).cast("binary"), 256)

    hit = F.crc32(columns["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    tree = F.coalesce(F.concat(F.lit("+"), columns["lang"]), F.lit("!"))  # a missing language comes first
    return docs.select(tree.alias("tree"), columns["doc_id"].alias("doc_id"), leaf(columns["text"]).alias("digest"), F.when(hit, leaf(F.translate(columns["text"], CAPITALS, SMALL))).alias("changed"))


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaf, roots, proof and outcome of the check of every document.

    Per language the leaves ascend by doc_id (nulls first, equal ids by digest; rows alike
    in all fields have proofs of their own places); languages ascend by bytes, a missing
    one first. Rows whose id is null are never tampered with. Null, empty and very long
    texts are fields like others; further columns don't count. No rows give no rows.
    """
    rows = leaves(docs)
    nodes = numbered(rows, "tree", ["doc_id", "digest"], docs.select("doc_id").count())
    nodes = cut(nodes)
    tops = cut(upper(nodes, levels))
    blocks = cut(paths(tops, levels))  # from each block's root to that of its language
    languages = blocks.groupBy("tree").agg(F.first("top").alias("digest")).withColumn("all", F.lit("all"))
    ranked = numbered(languages, "all", ["tree"], 1)
    top = paths(ranked.select(F.col("all").alias("tree"), "at", "digest", "n"), levels)
    subroots = ranked.select(F.col("tree").alias("own"), "at").join(top.select(F.col("at").alias("rank"), F.col("top").alias("root"), F.col("path").alias("rest")), F.col("at") == F.col("rank")).select("own", "root", "rest")
    onward = blocks.join(subroots, F.col("tree") == F.col("own")).select("own", F.col("at").alias("place"), F.col("top").alias("subroot"), "root", "path", "rest")

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        block, rows = block_of(rows, levels)
        subroot, root = (above.column(c)[0].as_py() for c in ("subroot", "root"))
        way = steps(above.column("path")[0].as_py() + above.column("rest")[0].as_py())
        siblings = b"".join(x for _, others in way for x in others)
        out = {c: [] for c in ("proof_sha256", "folded_root", "verified")}
        for at, changed in enumerate(rows.column("changed").to_pylist()):
            version = block.version(at, changed.encode() if changed else block.levels[0][at])
            folded = continued(version[-1], way).decode()
            out["proof_sha256"].append(digest(*(x for _, others in block.path(at) for x in others), siblings).decode())
            out["folded_root"].append(folded)
            out["verified"].append(folded == root)
        n = rows.num_rows
        return pa.table({"doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": [subroot] * n, "root": [root] * n} | out)

    return in_blocks(nodes, levels).groupBy("tree", "block").cogroup(onward.groupBy("own", "place")).applyInArrow(run, RESULT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def sql_field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR) END"


def sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join([*(sql_field(c) for c in FIELDS[:-1]), sql_field(text)]) + ")"


#: Bits of the checksum follow one by one: a byte is mixed in, then eight steps of the reflected polynomial.
SQL_CRC32 = """xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def sql_way(nodes: str, tree: str, nth: str) -> str:
    """Per level what comes before and after a node's ancestor in its run."""
    return f"""SELECT o.r, n.level, coalesce(string_agg(n.node, '' ORDER BY n.nth) FILTER (n.nth < o.{nth} // pow8), '') AS before, coalesce(string_agg(n.node, '' ORDER BY n.nth) FILTER (n.nth > o.{nth} // pow8), '') AS after
    FROM o JOIN (SELECT *, CAST(pow(8, level) AS BIGINT) AS pow8 FROM {nodes} WHERE n > 1) n ON {tree} AND n.nth // 8 = o.{nth} // (8 * pow8) GROUP BY o.r, n.level"""


ORACLE_SQL = f"""
WITH RECURSIVE l AS (
    SELECT doc_id, coalesce('+' || lang, '!') AS tree, {sql_leaf("text")} AS leaf,
        CASE WHEN {SQL_CRC32} % 3 = 0 THEN {sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
    FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS r FROM l),
nodes AS (
    SELECT 0 AS level, tree, nth, n, leaf AS node FROM ranked
    UNION ALL SELECT level + 1, tree, nth // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY nth)) FROM nodes WHERE n > 1 GROUP BY level, tree, nth // 8, n),
subs AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, place AS nth, n, subroot AS node FROM subs
    UNION ALL SELECT level + 1, nth // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY nth)) FROM tops WHERE n > 1 GROUP BY level, nth // 8, n),
o AS (SELECT r, doc_id, ranked.tree AS tree, leaf, changed, nth, subroot, place FROM ranked JOIN subs ON ranked.tree = subs.tree),
steps AS (SELECT 0 AS half, * FROM ({sql_way("nodes", "n.tree = o.tree", "nth")}) UNION ALL SELECT 1, * FROM ({sql_way("tops", "true", "place")})),
ways AS (SELECT r, list(before || '|' || after ORDER BY half, level) AS way, string_agg(before || after, '' ORDER BY half, level) AS siblings FROM steps GROUP BY r),
folded AS (
    SELECT o.*, sha256(coalesce(siblings, '')) AS proof_sha256, list_reduce([coalesce(changed, leaf)] || coalesce(way, []), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2))) AS folded_root
    FROM o LEFT JOIN ways ON o.r = ways.r)
SELECT doc_id, leaf, subroot, node AS root, proof_sha256, folded_root, folded_root = node AS verified FROM folded, (SELECT node FROM tops WHERE n = 1)
"""
