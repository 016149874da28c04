"""Near copies by SimHash and exact Jaccard similarity of word shingles.

Texts are sets of hashed shingles, and equal sets are one node. Fingerprints of the
same shingles that differ in a few bits are found with vantage-point trees, and the
pairs they link are compared exactly. Fingerprints miss pairs at the lower end of the
similarity, so what they have not joined goes through a prefix-filtered self-join:
under any order of all shingles, two sets of similarity s or more share one among
the first n - ceil(s * n) + 1 of each, at places that leave enough shingles for what
they have to share. The order puts shingles that many documents of a sample hold
last; the sample decides how many sets meet, never which of them are found. Sets
that meet are compared by profile (how many of their shingles fall in each of some
classes, four in each about, which bounds what they can share), and those that may be
similar shingle by shingle.

The sets under one shingle are first compared with one of them, a central one of
which few shingles are rare, and what that links is joined. That is repeated with
other centres while it pays; then all pairs still in different components are
compared, by classes of sizes, and in parts under a hot shingle. A large group of copies thus costs a few rows per copy, not one per pair.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftmesh.llm.arrow import id_and_text, map_batches
from driftmesh.llm.fingerprints import SEED, majority, shingle_hashes
from driftmesh.llm.vptree import near_links
from driftmesh.operators.components import component_labels
from driftmesh.storage import discard, materialize

#: Documents whose shingles are counted for the order, on average.
SAMPLE = 5_000
#: Shingles of the sample, the most common ones, that the order knows.
KNOWN = 100_000
#: Rounds of comparing with one set per shingle, at most, before all pairs are compared;
#: and rows per set up to which all pairs are compared at once.
STARS = 3
ROWS = 4
#: Shingles and classes of sizes with more than one in so many of all rows are dealt to parts.
HOT_SHARE = 256
#: Classes of a set's profile at least; they are a power of two, so that those of a larger set can be folded.
PROFILE = 32


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, size))


def node_of(shingles: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of it."""
    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def profile(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each class, as 16-bit numbers, or 32-bit ones in large sets."""
    classes = max(PROFILE, 1 << max(0, len(shingles) // 4 - 1).bit_length())
    return np.bincount((shingles % np.uint64(classes)).astype(np.int64), minlength=classes).astype("<u2" if len(shingles) < 1 << 16 else "<u4").tobytes()


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return [shingle_set(t, size) for t in _texts(batch)]


def _common(plain: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, sorted, and how many do."""
    every = max(1, plain.count() // SAMPLE)
    sample = plain.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def run(batch: pa.RecordBatch) -> dict:
        made = _sets(batch, size)
        return {"shingle": np.concatenate(made).view(np.int64) if made else []}

    counted = map_batches(sample, run, "shingle long").groupBy("shingle").count().filter("count > 2")
    rows = counted.orderBy(F.desc("count"), "shingle").limit(KNOWN).collect()
    found = sorted((r["shingle"] % (1 << 64), r["count"]) for r in rows)
    return np.array([s for s, _ in found], np.uint64), np.array([c for _, c in found], np.int64)


def _prefix(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    n = prefix_length(len(shingles), similarity)
    if not len(known):
        return shingles[:n]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    often = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.argsort(often, kind="stable")[:n]]


def _kept_pairs(both: DataFrame, decide, similarity: float) -> DataFrame:
    """src, dst: rows whose ``left`` and ``right`` share enough; ``decide`` gives (sizes, shared)."""

    def compare(batch: pa.RecordBatch) -> dict:
        near = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("left", "right", "n_left", "n_right")), strict=True):
            total, shared = decide(*row)
            near.append(bool(shared >= similarity * (total - shared) - 1e-9))
        keep = pa.array(near, pa.bool_())
        return {"src": batch.column("a").filter(keep), "dst": batch.column("b").filter(keep)}

    return map_batches(both.select("a", "b", "left", "right", "n_left", "n_right"), compare, "src long, dst long")


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    left = table.select(F.col("node").alias("a"), F.col(column).alias("left"), F.col("n").alias("n_left"))
    right = table.select(F.col("node").alias("b"), F.col(column).alias("right"), F.col("n").alias("n_right"))
    return pairs.join(left, "a").join(right, "b")


def _by_profile(x: bytes, y: bytes, n_x: int, n_y: int) -> tuple[int, int]:
    """Sizes of both sets together, and the most that they can share."""
    counts = [np.frombuffer(p, "<u2" if n < 1 << 16 else "<u4").astype(np.int64) for p, n in ((x, n_x), (y, n_y))]
    classes = min(map(len, counts))
    one, other = (c.reshape(-1, classes).sum(axis=0) for c in counts)
    return n_x + n_y, int(np.minimum(one, other).sum())


def _by_shingle(x: bytes, y: bytes, n_x: int, n_y: int) -> tuple[int, int]:
    one, other = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return len(one) + len(other), len(np.intersect1d(one, other, assume_unique=True))


def _similar(pairs: DataFrame, plain: DataFrame, nodes: DataFrame, similarity: float, size: int) -> DataFrame:
    """src, dst: the pairs of nodes (a, b) whose sets have the similarity."""
    likely = _kept_pairs(_both(pairs, nodes, "profile"), _by_profile, similarity)
    likely = materialize(likely.select(F.col("src").alias("a"), F.col("dst").alias("b")), "likely-pairs")
    wanted = likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))).distinct()
    holders = materialize(nodes.join(wanted, "node").select("node", F.col("first").alias("held")), "holders")
    held = plain.join(holders.select("held").distinct(), F.col("id").eqNullSafe(F.col("held")), "left_semi")

    def run(batch: pa.RecordBatch) -> dict:
        made = _sets(batch, size)
        return {"node": [node_of(s) for s in made], "n": list(map(len, made)), "shingles": [s.tobytes() for s in made]}

    sets = map_batches(held, run, "node long, n long, shingles binary").join(holders.select("node"), "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node"]), "shingle-sets")
    found = materialize(_kept_pairs(_both(likely, sets, "shingles"), _by_shingle, similarity), "new-links")
    discard(likely, holders, sets, pairs)
    return found


def _fingerprint_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: nodes of equal fingerprints, and of those linked within ``radius`` bits."""
    prints = materialize(nodes.groupBy("fingerprint").agg(F.min("node").alias("one")), "node-fingerprints")
    alike = nodes.join(prints, "fingerprint").select(F.col("one").alias("a"), F.col("node").alias("b"))
    links = near_links(prints.select("fingerprint"), radius)
    near = links.join(prints.toDF("src", "a"), "src").join(prints.toDF("dst", "b"), "dst").select("a", "b")
    pairs = alike.unionAll(near).filter(F.col("a") != F.col("b"))
    return materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-pairs")


def _open(shared: DataFrame, links: DataFrame | None, turn: int) -> DataFrame:
    """``shared`` with the label of each node and one node (the hub) per shingle, without shingles of one component."""
    named = shared.withColumn("label", F.col("node"))
    if links is not None:
        named = shared.join(component_labels(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(-F.col("centrality"), F.xxhash64(F.lit(turn), "node"), "node", "n", "pos", "label")
    hubs = named.groupBy("shingle").agg(F.min(order).alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most")
    one = named.join(hubs, "shingle").select(*ROW, "label", *[F.col("hub")[c].alias(f"{c}2") for c in ("node", "n", "pos", "label")])
    return materialize(one, "open-shingles")


#: Columns of a set's place under a shingle.
ROW = ["shingle", "node", "n", "pos", "centrality"]


def _meeting(rows: DataFrame, similarity: float, share: int = HOT_SHARE) -> DataFrame:
    """The pairs under each shingle whose sizes allow the similarity, the smaller set first.

    Sizes are in classes a factor of 1 / ``similarity`` wide, so a set meets its own class
    and the next one only. The smaller sets of a shingle and class that hold more than one
    in ``share`` of all rows are dealt to parts, each of which meets the larger sets.
    """
    wide = 1.000001 * math.log(1 / similarity) + 1e-9
    own = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(wide))
    held = rows.withColumn("class", own)
    sizes = materialize(held.groupBy("shingle", "class").agg(F.count("*").alias("held")), "shingle-sizes")
    total = sizes.agg(F.sum("held")).first()[0] or 0
    hot = sizes.filter(F.col("held") * share > total).select("shingle", "class", F.ceil(F.col("held") * share / F.lit(max(total, 1))).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than ``share`` rows, as they add up to the total at most
    parts = F.coalesce("parts", F.lit(1))
    smaller = held.join(hot, ["shingle", "class"], "left").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    smaller = smaller.select("shingle", "class", "part", "node", "n", "pos", "label")
    # a larger set meets the smaller ones of its own class and the one before, in all their parts
    larger = held.toDF("shingle", "node2", "n2", "pos2", "label2", "own").withColumn("class", F.explode(F.array(F.col("own") - 1, F.col("own"))))
    larger = larger.join(hot, ["shingle", "class"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "own")
    allowed = F.col("n") >= F.lit(similarity) * F.col("n2") - F.lit(1e-9)
    ordered = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("node") < F.col("node2")))
    return smaller.join(larger, ["shingle", "class", "part"]).filter(allowed & ordered)


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components that may share enough.

    Sets of too different sizes cannot, nor those where too few shingles come after
    the first one they share; of a similar pair's rows, that of its first passes.
    """
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("n") + F.col("n2")) - F.lit(1e-9))
    alike = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= least
    apart = rows.filter((F.col("label") != F.col("label2")) & alike)
    return materialize(apart.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct(), "meeting-pairs")


def _shared_shingles(printed: DataFrame) -> DataFrame:
    """Prefix shingles that several nodes have, with each node's size, the shingle's place in it, and how central it is."""
    sets = printed.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    meet = sets.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    several = meet.groupBy("shingle").count().filter("count > 1").select("shingle")
    shared = materialize(meet.join(several, "shingle").select("shingle", "node", "n", "pos"), "shared-shingles")
    # the share of its prefix that others have as well, in steps, so that turns differ in the centre they take
    central = shared.groupBy("node").agg(F.round(20 * F.count("*") / F.first("n")).alias("centrality"))
    rows = materialize(shared.join(central, "node").select(*ROW), "central-shingles")
    discard(shared)
    return rows


def similar_groups(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and component_id.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of
    ``similarity`` or more are linked; component_id is the smallest id reachable over
    links. Texts without words are equal sets, and so linked to each other; null ids
    are never the smallest unless a group has no other; repeated rows stay. ``radius``
    decides which links fingerprints find, not which are found in all.
    """
    plain = id_and_text(docs, id_col, text_col)
    known, counts = _common(plain, size)
    kind = plain.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        hashes = [shingle_hashes(t, size) for t in _texts(batch)]
        made = list(map(np.unique, hashes))
        return {
            "id": batch.column("id"),
            "node": list(map(node_of, made)),
            "n": list(map(len, made)),
            "fingerprint": np.array(list(map(majority, hashes)), np.uint64).view(np.int64),
            "prefix": [_prefix(s, known, counts, similarity).view(np.int64) for s in made],
            "profile": list(map(profile, made)),
        }

    printed = map_batches(plain, run, f"id {kind}, node long, n long, fingerprint long, prefix array<long>, profile binary")
    printed = materialize(printed, "shingle-nodes")
    prints = printed.select("id", "node")
    nodes = printed.groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("profile").alias("profile"), F.min("fingerprint").alias("fingerprint"))
    nodes = materialize(nodes, "nodes")
    n_nodes = nodes.count()

    links = _similar(_fingerprint_pairs(nodes, radius), plain, nodes, similarity, size)
    opened = _shared_shingles(printed)
    shared, pays = opened, True
    for turn in range(STARS + 1):
        left = _open(shared, links, turn)
        held = left.groupBy("shingle").agg(F.count("*").alias("n"))
        all_pairs = held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
        if all_pairs is None:
            break
        last = turn == STARS or not pays or all_pairs <= ROWS * n_nodes
        rows = left
        if last:
            rows = _meeting(left.select("shingle", "node", "n", "pos", "label"), similarity)
        pairs = _pairs(rows, similarity)
        n_pairs = pairs.count()
        found = _similar(pairs, plain, nodes, similarity, size)
        pays = 20 * found.count() >= n_pairs
        before, links = links, materialize(links.unionAll(found), "similar-links")
        discard(before, found, opened)
        shared, opened = left.select(*ROW), left
        if last:
            break

    named = nodes.join(component_labels(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
    chosen = named.join(groups, "label").select("node", "component_id")
    return prints.join(chosen, "node").select(F.col("id").alias(id_col), "component_id")
