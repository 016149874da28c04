"""Exact dedup of batches against frozen snapshots.

A batch of documents is digested once and grouped by digest on its own, so its copies
cost one row each before anything else happens. Digests of a batch are dealt to shards
and screened by the static filters of every snapshot before it; those that a filter lets
through join that snapshot's exact buckets. The digests found there, and those with
several rows in a batch, have their bytes compared. A batch is then frozen itself.
Only digests, lengths and ids are shuffled, and each text once, to the digest that its
bytes are compared under; equal texts combine there before they are counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.llm.arrow import id_and_text
from driftmesh.llm.columns import BLANKS
from driftmesh.llm.fuse import BinaryFuse
from driftmesh.storage import materialize

#: Digests that one filter holds, about.
SHARD = 1 << 12
#: Parts of a digest's texts that are compared with its row of suspects in different tasks.
SALTS = 16


def normalised(text: Column) -> Column:
    """The text without its blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


@dataclass(frozen=True)
class Snapshot:
    """A batch that no longer changes.

    docs: id, text. rows: row, id, n_chars, sha, digest, one for each document. buckets:
    digest, key, n_rows, best, one for each digest, with the row that stays. filters:
    shard, filter.
    """

    docs: DataFrame
    rows: DataFrame
    buckets: DataFrame
    filters: DataFrame
    shards: int


def _bare(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """id, n_chars, bare, sha, digest of documents (id, text)."""
    bare = docs.select("id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("bare"))
    hashed = bare.withColumn("sha", F.unhex(F.sha2("bare", 256)))
    return hashed.withColumn("digest", F.substring("sha", 1, digest_bytes))


def _best(batch: Column) -> Column:
    """The row that stays: most code points, then smallest id, nulls last, then the first row."""
    order = F.struct((-F.col("n_chars")).alias("chars"), F.col("id").isNull().alias("unnamed"), "id", batch.alias("batch"), "row")
    return F.min(order).alias("best")


def freeze(docs: DataFrame, batch: int = 0, digest_bytes: int = 32, shard: int = SHARD) -> Snapshot:
    """A snapshot of documents (id, text): digested, grouped, and filters built shard by shard."""
    rows = _bare(docs, digest_bytes).select(F.monotonically_increasing_id().alias("row"), F.lit(batch).alias("batch"), "id", "n_chars", "sha", "digest")
    rows = materialize(rows, "exact-rows")
    grouped = rows.groupBy("digest").agg(F.count("*").alias("n_rows"), _best(F.col("batch")))
    buckets = materialize(grouped.withColumn("key", F.xxhash64("digest")), "exact-buckets")
    shards = max(1, -(-buckets.count() // shard))

    def build(table: pa.Table) -> pa.Table:
        made = BinaryFuse.of(table["key"].to_numpy())
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "filter": pa.array([made.dump()], pa.binary())})

    filters = buckets.select("key", F.pmod("key", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(build, "shard long, filter binary")
    return Snapshot(docs, rows, buckets, materialize(filters, "exact-filters"), shards)


def screened(buckets: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests of ``buckets`` that the snapshot's filters let through: all it has, and one in 256 others."""

    def test(digests: pa.Table, filters: pa.Table) -> pa.Table:
        if not filters.num_rows or not digests.num_rows:
            return digests.select(["digest"]).slice(0, 0)
        held = BinaryFuse.load(filters["filter"][0].as_py()).contains(digests["key"].to_numpy())
        return digests.select(["digest"]).filter(pa.array(held))

    dealt = buckets.select("digest", "key", F.pmod("key", F.lit(snapshot.shards)).alias("shard"))
    return dealt.groupBy("shard").cogroup(snapshot.filters.groupBy("shard")).applyInArrow(test, "digest binary")


@dataclass
class ExactIndex:
    """Snapshots in the order they came, and the digests that more than one of them holds."""

    digest_bytes: int = 32
    shard: int = SHARD
    snapshots: list[Snapshot] = field(default_factory=list)
    shared: list[DataFrame] = field(default_factory=list)

    def add(self, docs: DataFrame) -> DataFrame:
        """Freeze documents (id, text); the digests they have in common with earlier ones come back."""
        new = freeze(docs, len(self.snapshots), self.digest_bytes, self.shard)
        found = [screened(new.buckets, old).join(old.buckets.select("digest"), "digest") for old in self.snapshots]
        met = materialize(_all(found).distinct() if found else new.buckets.select("digest").limit(0), "exact-met")
        self.snapshots.append(new)
        self.shared.append(met)
        return met

    def groups(self) -> DataFrame:
        """id, keep_id, group_size, kept, text_sha256, n_chars: one row for every document added."""
        rows, buckets = _all([s.rows for s in self.snapshots]), _all([s.buckets for s in self.snapshots])
        shared = materialize(_all(self.shared).distinct(), "exact-shared")
        several = buckets.filter("n_rows > 1").select("digest")
        collided = self._collided(materialize(several.unionAll(shared).distinct(), "exact-suspects"))
        merged = buckets.join(shared, "digest").groupBy("digest").agg(F.sum("n_rows").alias("n_rows"), F.min("best").alias("best"))
        own = buckets.join(shared, "digest", "left_anti").select("digest", "n_rows", "best")
        # written, so that the join below deals both sides itself and can split a hot digest
        classes = materialize(own.unionAll(merged), "exact-classes")
        if collided is None:
            return _named(rows.join(classes, "digest"))
        apart = rows.join(collided, "digest", "left_anti").join(classes, "digest")
        return _named(apart).unionAll(_named(self._by_bytes(collided)))

    def _collided(self, suspects: DataFrame) -> DataFrame | None:
        """Digests whose texts are not all the same, byte by byte; None if there are none."""
        salted = suspects.select("digest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        texts = self._texts().select("digest", "bare", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
        # shuffled at every size: what is compared grows with the documents, and so would a broadcast
        forms = texts.join(salted.hint("merge"), ["digest", "salt"]).groupBy("digest", "bare").agg(F.count("*").alias("n"))
        found = materialize(forms.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "exact-collided")
        return None if found.isEmpty() else found

    def _by_bytes(self, collided: DataFrame) -> DataFrame:
        """Rows of digests that stand for several texts, with the row that stays for each text."""
        members = self._texts().join(collided, "digest").withColumns({"row": F.monotonically_increasing_id(), "batch": F.lit(0)})
        members = materialize(members, "exact-members")
        return members.join(members.groupBy("digest", "bare").agg(F.count("*").alias("n_rows"), _best(F.col("batch"))), ["digest", "bare"])

    def _texts(self) -> DataFrame:
        return _all([_bare(s.docs, self.digest_bytes) for s in self.snapshots])


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _named(rows: DataFrame) -> DataFrame:
    kept = (F.col("batch") == F.col("best.batch")) & (F.col("row") == F.col("best.row"))
    return rows.select("id", F.col("best.id").alias("keep_id"), F.col("n_rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_chars")


def dedup_exact(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are without blanks; of equal ones the row with the most code
    points stays, then the one with the smallest id. ``docs`` is taken as ``batches``
    batches that come one after the other, dealt by a hash of the id; the result does not
    depend on their number. ``digest_bytes`` of the SHA-256 are the digest; bytes are
    compared, so that a short one gives the same result.

    Null texts count as empty, and empty and blank ones equal each other. Null ids come
    after all others, and keep_id is null where a group has no other. Of rows that repeat
    id and length one is kept. Long texts are digested whole. Other columns are not
    carried, so no name can clash. An empty table gives an empty one.
    """
    named = id_and_text(docs, id_col, text_col)
    index = ExactIndex(digest_bytes, shard)
    turn = F.pmod(F.xxhash64("id"), F.lit(batches))
    for k in range(batches):
        index.add(named.filter(turn == k))
    return index.groups().withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and a text, one."""
    kept = dedup_exact(docs, batches, id_col, text_col).filter("kept")
    kept = materialize(kept.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n")), "exact-kept")
    chars = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("__sha")) & (chars == F.col("__n"))
    return docs.join(kept, same).dropDuplicates(["__id", "__sha"]).select(*[F.col(f"`{c}`") for c in docs.columns])
