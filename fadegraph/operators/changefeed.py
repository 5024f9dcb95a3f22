"""Applying a feed of inserts, updates and deletes: bucketed copy-on-write.

A table lives in a folder of the shared file system as ``n_buckets`` buckets,
hashed by item, and a chain of manifests that name the folder each bucket is in.
``apply`` pre-aggregates the feed per item (map side first, so an item with a
third of all entries costs one row a task), routes the result to its buckets,
merges it there with the old rows of the *touched* buckets only, writes
replacement folders and commits a new manifest, whose name only one writer can
create.  Readers of an older manifest are never disturbed; a writer that loses the
race gets ``FileExistsError`` and nothing of its work becomes visible.

The merge keeps, per item, the largest seq seen, the seq and kind of the latest
upsert or removal, and the fields of the latest upsert.  All three are maxima,
so the result does not depend on order of arrival, repeats or batch borders, and
a tombstone stays behind to fend off entries that come later than the removal.

Reinforcements count once a seq, however often and late they are delivered, so
their seqs are kept: in rows of their own for each item and ``SLICE`` places of the
log, which hold at most ``SLICE`` of them and are hashed to buckets by item and slice.
An item with a third of all entries is thus spread over many buckets and rows.

Buckets are made for ``BUCKET_BYTES`` each by the size of the first feed and the
table is rewritten with twice as many (or more) when they have outgrown it by two.

Defined cases: an entry without seq, without its item or with an unknown
operation is ignored; an empty or blank item counts as missing; of copies with
equal seq the one with more fields filled gives the fields, and the larger delta counts; a
delta that is null, NaN or not above 0 reinforces nothing, but its seq counts as seen; an empty feed commits
nothing; further columns of the feed are ignored.
"""
from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fadegraph.sources import hadoop
from fadegraph.sources.shared import scratch_path

BUCKET_BYTES, LEAST_BUCKETS, SLICE = 64 << 20, 12, 4_096
FIELDS = {
    "workspace": "string", "src": "string", "dst": "string", "channel": "string", "kind": "string",
    "tags": "array<string>", "confidence": "double", "source": "string", "label": "string",
}
STEPS = "array<struct<seq:bigint,delta:double>>"
STATE = (
    "item string, slice bigint, last_seq bigint, life bigint, entry struct<seq:bigint,filled:int,"
    + ",".join(f"{k}:{v}" for k, v in FIELDS.items())
    + f">, steps {STEPS}"
)


def operation(op: Column) -> Column:
    """An operation's name in letters only, lower case: NodeUpsert and node_upsert are one."""
    return F.lower(F.regexp_replace(op, "[^A-Za-z]", ""))


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("item", "slice"), F.lit(n)).cast("int")


def _once(steps: Column) -> Column:
    """Each seq once, with its largest delta."""
    ordered = F.sort_array(steps, asc=False)
    return F.filter(ordered, lambda s, i: (i == 0) | (s["seq"] != F.get(ordered, i - 1)["seq"]))


def _merge(df: DataFrame) -> DataFrame:
    # equal sets of steps are one, so copies of an entry cost nothing
    return df.groupBy("bucket", "item", "slice").agg(
        F.max("last_seq").alias("last_seq"), F.max("life").alias("life"), F.max("entry").alias("entry"), F.flatten(F.collect_set("steps")).alias("steps"),
    ).withColumn("steps", F.when(F.size("steps") > 1, _once(F.col("steps"))).otherwise(F.col("steps")))


def _entries(feed: DataFrame) -> DataFrame:
    """Entries that take effect: op, item and the feed's columns."""
    known = ("nodeupsert", "nodearchive", "edgeupsert", "edgereinforce", "edgeprune")
    rows = feed.withColumn("_op", operation(F.col("op"))).filter(F.col("_op").isin(*known) & F.col("seq").isNotNull())
    return rows.withColumn("item", F.when(F.col("_op").startswith("edge"), F.col("edge_id")).otherwise(F.col("src"))).filter(F.trim("item") != "")


def _sliced(entries: DataFrame) -> DataFrame:
    """Each entry for its item (slice 0), and each effective reinforcement for its slice as well."""
    step = (F.col("_op") == "edgereinforce") & (F.col("delta") > 0) & ~F.isnan("delta")
    own = F.when(step, F.array(F.lit(0).cast("bigint"), (F.floor(F.col("seq") / SLICE) + 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return entries.withColumn("slice", F.explode(own))


def item_rows(feed: DataFrame, n_buckets: int) -> DataFrame:
    """States of single entries, to be merged: a row for the item, and one for a reinforcement's slice, with their buckets."""
    filled = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in FIELDS))
    first = F.col("slice") == 0
    rows = _sliced(_entries(feed)).select(
        "item", "slice", F.col("seq").alias("last_seq"),
        # seq and, in the lowest bit, whether the item exists after it
        F.when(first & (F.col("_op") != "edgereinforce"), F.shiftleft("seq", 1).bitwiseOR(F.col("_op").endswith("upsert").cast("bigint"))).alias("life"),
        F.when(first & F.col("_op").endswith("upsert"), F.struct(
            F.col("seq").alias("seq"), filled.alias("filled"), *(F.col(c).cast(t).alias(c) for c, t in FIELDS.items()))).alias("entry"),
        F.when(~first, F.array(F.struct(F.col("seq").alias("seq"), F.col("delta").cast("double").alias("delta")))).alias("steps"),
    )
    return rows.withColumn("bucket", _bucket(n_buckets))


def _bytes(df: DataFrame) -> int:
    """What the optimiser takes the size of a table for; of files that is their length."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class BucketedTable:
    """A table of items, changed by copy-on-write of whole buckets."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, n_buckets: int | None = None) -> BucketedTable:
        """An empty table; without ``n_buckets`` the first feed's size tells how many."""
        t = cls(spark, path or scratch_path(spark, "items"))
        t._commit({"version": 0, "n_buckets": n_buckets or 0, "buckets": {}})
        return t

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in hadoop.names(self.spark, f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of ``version``, or the newest that is whole: a writer that died while committing leaves none."""
        for v in [version] if version is not None else reversed(self._versions()):
            try:
                return json.loads(hadoop.read_text(self.spark, f"{self.path}/manifest/v{v:08d}.json"))
            except ValueError:
                continue
        raise FileNotFoundError(f"no manifest in {self.path}")

    def _commit(self, m: dict) -> None:
        hadoop.write_text_once(self.spark, f"{self.path}/manifest/v{m['version']:08d}.json", json.dumps(m))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.path}/{f}" for f in folders))

    def apply(self, feed: DataFrame) -> dict:
        """Merge a feed and commit; gives the manifest that now holds."""
        m = self.manifest()
        version = self._versions()[-1] + 1
        n, old = m["n_buckets"], m["buckets"]
        if not n:
            size = _bytes(feed)
            # what is not read from files has no known size
            n = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)) if size < 1 << 60 else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        held = _bytes(self._read(sorted(old.values()))) if old else 0
        split = held > 2 * BUCKET_BYTES * n
        while held > BUCKET_BYTES * n and split:
            n *= 2
        changes = item_rows(feed, n)
        if old:
            # from the ids alone; at most n small numbers come to the driver
            ids = _sliced(_entries(feed)).select(_bucket(n).alias("bucket")).distinct()
            touched = set(old) if split else {str(r.bucket) for r in ids.toLocalIterator()}
            base = self._read([f for b, f in old.items() if b in touched]).withColumn("bucket", _bucket(n))
            changes = changes.unionByName(base)
        folder = f"data/v{version:08d}-{uuid.uuid4().hex[:8]}"
        # entries are combined on the map side together with old rows, then each bucket goes to its task
        changes = _merge(changes).repartitionById(n, "bucket").sortWithinPartitions("bucket", "item", "slice")
        changes.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        new = {x[7:]: f"{folder}/{x}" for x in hadoop.names(self.spark, f"{self.path}/{folder}") if x.startswith("bucket=")}
        if not new:
            return m
        m = {"version": version, "n_buckets": n, "buckets": new if split else old | new}
        self._commit(m)
        return m

    def states(self, version: int | None = None) -> DataFrame:
        """All items and slices, tombstones included."""
        return self._read(sorted(self.manifest(version)["buckets"].values()))

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The items that exist: item, seq of its last entry, and the fields of its last upsert."""
        return self.states(version).filter((F.col("slice") == 0) & (F.col("life").bitwiseAND(F.lit(1)) == 1)).select(
            "item", F.col("last_seq").alias("seq"), *(F.col(f"entry.{c}").alias(c) for c in FIELDS)
        )

    def strengths(self, version: int | None = None) -> DataFrame:
        """(item, seq, confidence, strength, reinforced): existing items after the reinforcements that follow their last upsert.

        Strength starts at the upsert's confidence (0.8 without a usable one) and is 1 at most.
        """
        s = self.states(version)
        live = s.filter((F.col("slice") == 0) & (F.col("life").bitwiseAND(F.lit(1)) == 1)).select("item", "last_seq", F.col("entry.seq").alias("since"), F.col("entry.confidence").alias("confidence"))
        later = F.filter("steps", lambda x: x["seq"] > F.col("since"))
        gains = (
            s.filter("slice > 0").select("item", "steps").join(live.select("item", "since"), "item")
            .select("item", F.size(later).alias("k"), F.aggregate(later, F.lit(0.0), lambda a, x: a + x["delta"]).alias("gain"))
            .groupBy("item").agg(F.sum("k").alias("k"), F.sum("gain").alias("gain"))
        )
        start = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(0.8)
        return live.join(gains, "item", "left").select(
            "item", F.col("last_seq").alias("seq"), "confidence", F.least(F.lit(1.0), start + F.coalesce("gain", F.lit(0.0))).alias("strength"),
            F.coalesce("k", F.lit(0)).cast("bigint").alias("reinforced"))

    def vacuum(self) -> int:
        """Delete the folders that the newest manifest does not name; older versions can't be read after that."""
        m = self.manifest()
        keep, gone = {f.rsplit("/", 1)[0] for f in m["buckets"].values()}, 0
        for name in hadoop.names(self.spark, f"{self.path}/data"):
            if f"data/{name}" not in keep:
                hadoop.delete(self.spark, f"{self.path}/data/{name}")
                gone += 1
        return gone


def build(feeds: list[DataFrame], path: str | None = None, n_buckets: int | None = None) -> BucketedTable:
    """A new table with the feeds applied one after another."""
    t = BucketedTable.create(feeds[0].sparkSession, path, n_buckets)
    for f in feeds:
        t.apply(f)
    return t


def halves(feed: DataFrame, arrived: str) -> list[DataFrame]:
    """A feed in two batches, the later half of the time of arrival after the earlier; entries without a time come with the second."""
    when = F.col(arrived).cast("timestamp").cast("double")
    half = feed.agg((F.min(when) / 2 + F.max(when) / 2).alias("half")).first().half
    early = F.coalesce(when <= F.lit(half).cast("double"), F.lit(False))
    return [feed.filter(early), feed.filter(~early)]


def replay(feed: DataFrame, path: str | None = None, n_buckets: int | None = None, arrived: str | None = None) -> DataFrame:
    """The items that exist after a whole feed, rebuilt from an empty table.

    With a column ``arrived`` the feed is applied in two batches, so that the second rewrites buckets of the first.
    """
    return build([feed] if arrived is None else halves(feed, arrived), path, n_buckets).snapshot()
