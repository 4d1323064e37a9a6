"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

Texts are sets of shingles of five lower-cased words (letters, digits, anything outside ASCII).
Identical texts are grouped first and stand for one node. Every node gets ``TREES`` signatures of
``DEPTHS[0]`` MinHash values; a tree is the trie of one signature. Nodes that share a prefix in
some tree are candidates. The join begins with the longest prefixes, and shortens them while the
recall, estimated from the similarities of the links found and the chance of a pair of such
similarity to share a prefix, is below the target; the shortest prefix reaches it for any pair
at the threshold.

Candidates are verified per connected group of candidates: a group's nodes are cut into blocks
of bounded size, every pair of blocks is one unit of work, and all pairs in it are compared
through the shingles they have in common. Pairs are never emitted: a unit returns each node's
number of links and a spanning forest of the links. So a node is sent once per block of its
group, whatever the number of its links.

Defined results: null text and text without words have no shingles; such documents (and
documents without a partner) are classes of their own, except that identical texts always share
a class. Fewer than five words make one shingle. Repeated rows and repeated or null ids are
identical or different texts like any others; a class is named by its least id, or by a negative
number when all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.llm.bytewords import ALNUM, Words, mix, slices, words_of
from nodeloom.plans.components import components
from nodeloom.plans.store import Saved, save

SHINGLE = 5
THRESHOLD = 0.8
TREES = 48
#: Prefix lengths tried in turn, longest first.
DEPTHS = (10, 8, 6)
TARGET_RECALL = 0.998
#: Bounds of one block: nodes and shingles.
BLOCK_NODES, BLOCK_SHINGLES = 512, 200_000
#: Incidence columns multiplied at once.
COLUMNS = 4096
BINS = 8


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): the distinct-or-not shingle hashes of all texts, and where each text's begin."""
    n = np.diff(words.first)
    hashes = words.hashes()
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(words.first[:-1] - first[:-1], count) + np.arange(first[-1])
    size = np.repeat(np.minimum(n, SHINGLE), count)
    out = mix(size.astype(np.uint64))
    for k in range(SHINGLE):
        take = size > k
        if take.all():
            out = mix(out ^ hashes[begin + k])
        else:
            out[take] = mix(out[take] ^ hashes[begin[take] + k])
    return out, first


def constants(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the hash family."""
    seed = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seed[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[count:] >> np.uint64(32)).astype(np.uint32)


def tree_keys(hashes: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The (text, tree) keys of the signature prefixes of length ``depth``; every text needs a shingle."""
    texts = len(first) - 1
    factor, offset = constants(trees * max(depth, DEPTHS[0]))
    keys = np.zeros((texts, trees), np.uint64)
    short = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
    step, begin = 1 << 15, 0
    while begin < texts:  # some texts at a time, so that their hashes stay in the cache
        stop = max(begin + 1, int(np.searchsorted(first, first[begin] + step, "right")) - 1)
        part, at = short[first[begin]:first[stop]], first[begin:stop] - first[begin]
        buffer = np.empty_like(part)
        for tree in range(trees):
            key = np.full(stop - begin, tree + 1, np.uint64)
            for level in range(depth):
                i = level * trees + tree  # a shorter prefix has the same first values
                np.multiply(part, factor[i], out=buffer)
                np.add(buffer, offset[i], out=buffer)
                key = mix(key ^ np.minimum.reduceat(buffer, at))
            keys[begin:stop, tree] = key
        begin = stop
    return keys


def recall_at(similarity: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Chance of a pair of this similarity to share a prefix in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def estimated_recall(bins: np.ndarray, threshold: float, depth: int, trees: int) -> float:
    """Share of links found, judged by the similarities of those found; one more at the threshold is supposed."""
    size = len(bins)
    middle = threshold + (np.arange(size) + 0.5) * (1 - threshold) / size
    chance = recall_at(np.concatenate([[threshold], middle]), depth, trees)
    found = np.concatenate([[1.0], bins])
    return float(found.sum() / (found / chance).sum())


@dataclass
class Settings:
    threshold: float = THRESHOLD
    trees: int = TREES
    depths: tuple[int, ...] = DEPTHS
    target: float = TARGET_RECALL
    block_nodes: int = BLOCK_NODES
    block_shingles: int = BLOCK_SHINGLES


def _signed(docs: DataFrame, key: str, text: str, trees: int, depth: int) -> DataFrame:
    """(id, digest, size, keys) of every document, without its text."""
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(2)):
                part = batch.slice(begin, end - begin)
                hashes, first = shingles(words_of(part.column(2), ALNUM))
                size = np.diff(first)
                some = np.flatnonzero(size)
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, trees, 0))]).astype(np.int32)
                keys = tree_keys(hashes, np.append(first[:-1][some], first[-1]), trees, depth) if len(some) else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), lists], schema.names)

    rows = docs.select(F.col(key).cast("bigint").alias("id"), _digest(text).alias("digest"), F.col(text).alias("t"))
    return rows.mapInArrow(run, schema)


def _digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to the least node of every bucket it shares; a hot bucket is only counted and minimised."""
    rows = nodes.select("node", F.explode("keys").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = save(least.select("bucket", "least"), "lsh_buckets")
    return rows.join(held.df, "bucket").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def _blocks(nodes: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """(node, id, digest, size, label, i, j, side): each node of a group with the block pairs it takes part in."""
    own = nodes.select("node", "id", "digest", "size").join(groups, "node")
    total = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    many = F.greatest(F.ceil(F.col("n") / settings.block_nodes), F.ceil(F.col("s") / settings.block_shingles)).cast("int")
    large = save(total.select("label", many.alias("cuts")).filter("cuts > 1"), "lsh_cuts")
    tagged = save(own, "lsh_groups").df.join(large.df, "label", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    tagged = tagged.withColumn("block", F.pmod(F.xxhash64("node"), F.col("cuts").cast("bigint")).cast("int"))
    spread = tagged.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return spread.select(
        "node", "id", "digest", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")


def compare(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, roots, bins) of one block pair, or of one block when all sides are equal.

    ``sets`` are distinct shingle hashes. Intersections are products of the incidence matrix,
    columns that only one set has being left out.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size.astype(int))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + COLUMNS + 1, COLUMNS))
        for c, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if begin < end:
                width = min(COLUMNS, int(column[end - 1]) - c * COLUMNS + 1)
                matrix = np.zeros((n, width), np.float32)
                matrix[owner[begin:end], column[begin:end] - c * COLUMNS] = 1.0
                common += matrix @ matrix.T
    union = size[:, None] + size[None, :] - common
    alike = common / np.maximum(union, 1)
    near = (common >= threshold * union - 1e-6) & (union > 0)
    np.fill_diagonal(near, False)
    if side.min() != side.max():
        near &= side[:, None] != side[None, :]
    place = ((alike[near] - threshold) / (1 - threshold) * BINS).astype(int)
    bins = np.bincount(np.clip(place, 0, BINS - 1), minlength=BINS) // 2
    roots = np.arange(n)
    while True:
        low = np.minimum(roots, np.where(near, roots[None, :], n).min(1))
        low = low[low]
        if (low == roots).all():
            return near.sum(1), roots, bins
        roots = low


_UNIT = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType()),
    T.StructField("bins", T.ArrayType(T.LongType()))])


def _verified(docs: DataFrame, key: str, text: str, placed: DataFrame, settings: Settings) -> DataFrame:
    """(node, root, links, bins) from every block pair; the texts come from ``docs`` by id and digest."""
    texts = docs.select(F.col(key).cast("bigint").alias("d_id"), _digest(text).alias("d_digest"), F.col(text).alias("t"))
    held = save(placed, "lsh_placed").df
    one = held.select("node", "id", "digest").distinct()
    # A sort-merge join whatever the sizes: neither side is bounded.
    whole = texts.join(one.hint("merge"), (F.col("d_digest") == F.col("digest")) & F.col("d_id").eqNullSafe(F.col("id"))).select("node", "t")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1)):
                part = batch.slice(begin, end - begin)
                hashes, first = shingles(words_of(part.column(1), ALNUM))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["s_node", "shingles"])

    sets = whole.mapInArrow(hashed, "s_node bigint, shingles binary")
    units = held.select("node", "label", "i", "j", "block").join(sets, F.col("node") == F.col("s_node"))
    units = units.select("label", "i", "j", "node", "block", "shingles")
    units = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, side, members = None, [], [], []
        rows: list[dict] = []

        def finish() -> None:
            if len(nodes) < 2 or (unit[1] != unit[2] and min(side) == max(side)):
                return  # a unit of two blocks that only one has nodes for: that block's own unit counts its pairs
            links, roots, bins = compare(members, np.array(side), settings.threshold)
            for k in np.flatnonzero(links).tolist():
                rows.append({"node": nodes[k], "root": nodes[roots[k]], "links": int(links[k]), "bins": None})
            if bins.any():
                rows.append({"node": None, "root": None, "links": 0, "bins": bins.tolist()})

        for batch in batches:
            labels, i, j, node, block = (batch.column(c).to_pylist() for c in range(5))
            for k, now in enumerate(zip(labels, i, j, strict=True)):
                if now != unit:
                    finish()
                    unit, nodes, side, members = now, [], [], []
                if nodes and nodes[-1] == node[k]:
                    continue  # a repeated row
                nodes.append(node[k])
                side.append(block[k])
                members.append(np.frombuffer(batch.column(5)[k].as_buffer(), np.uint64))
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        finish()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return units.mapInArrow(run, _UNIT)


_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("bins", pa.list_(pa.int64()))])


@dataclass
class Links:
    """Written tables of the join: ``nodes`` (node, digest, id, copies, label, links) and the depth it ended at."""

    nodes: Saved
    members: DataFrame
    depth: int
    recall: float


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> Links:
    """Find all pairs of different texts at the threshold; see the module for what is kept of them."""
    settings = settings or Settings()
    for depth in settings.depths:
        signed = save(_signed(docs, key, text, settings.trees, depth), "lsh_signed")
        unique = signed.df.groupBy("digest").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.first("keys").alias("keys"))
        nodes = save(unique.withColumn("node", F.monotonically_increasing_id()), "lsh_nodes")
        placed = _blocks(nodes.df, components(_candidates(nodes.df)).df, settings)
        found = save(_verified(docs, key, text, placed, settings), "lsh_found")
        counted = found.df.filter(F.col("bins").isNotNull()).select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        bins = np.zeros(BINS)
        for row in counted:
            bins[row["pos"]] = row["n"]
        recall = estimated_recall(bins, settings.threshold, depth, settings.trees)
        if recall >= settings.target or depth == settings.depths[-1]:
            break
        for table in (signed, nodes, found):
            table.drop()
    linked = found.df.filter(F.col("node").isNotNull())
    labels = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b"))).df.toDF("l_node", "label")
    links = linked.groupBy("node").agg(F.sum("links").alias("links")).toDF("k_node", "links")
    whole = nodes.df.select("node", "digest", "id", "copies").join(labels, F.col("node") == F.col("l_node"), "left")
    whole = whole.join(links, F.col("node") == F.col("k_node"), "left").select(
        "node", "digest", "id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    return Links(save(whole, "lsh_links"), signed.df.select("id", "digest"), depth, recall)


def _named(links: Links) -> Saved:
    """Nodes with the name and the representative of their class."""
    name = links.nodes.df.groupBy("label").agg(
        F.min("id").alias("least"), F.sum("copies").alias("members"),
        F.min_by("node", F.struct(F.col("id").isNull(), F.col("id"), F.col("node"))).alias("first"))
    held = save(name.select(F.col("label").alias("c_label"), F.coalesce("least", -1 - F.col("label")).alias("class_id"), "members", "first"), "lsh_classes")
    return save(links.nodes.df.join(held.df, F.col("label") == F.col("c_label")).select(
        F.col("digest").alias("n_digest"), F.col("id").alias("n_id"), "class_id", "members", "links", "copies",
        (F.col("node") == F.col("first")).alias("first")), "lsh_named")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One row per document: its class, the class's documents, its copies, and its links to different texts."""
    links = join(docs, key, text, settings)
    named = _named(links).df
    return links.members.join(named, F.col("digest") == F.col("n_digest")).select(
        F.col("id").alias(key), "class_id", F.col("members").alias("class_size"), "copies", F.col("links").alias("n_links"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """One document of each class (the one with the least id), with the columns of ``docs``."""
    kept = _named(join(docs, key, text, settings)).df.filter("first").select("n_digest", "n_id")
    digest, ident, columns = "__nl_c_digest", "__nl_c_id", docs.columns
    own = docs.withColumns({digest: _digest(text), ident: F.col(key).cast("bigint")})
    own = own.join(kept, (F.col(digest) == F.col("n_digest")) & F.col(ident).eqNullSafe(F.col("n_id")), "left_semi")
    return own.dropDuplicates([digest, ident]).select(*columns)
