"""Tables with a key that take batch after batch without being rewritten: merge on read.

A batch is reduced to one row per key and added as a version of its own; a NULL field of a change means that the field stays. Readers merge:
per key and field the newest value wins. The rows of a version are dealt into buckets by the key's hash, as many as its own size asks for (a
power of two), so that a small batch is one file and a version that grew out of many has many. Every bucket has a Bloom filter, kept as
rows of bits. So a batch that asks which of its keys are stored reads the filters of its own buckets, and of the rows only the key column of
the buckets whose filter does not exclude one of its keys.

``compact`` joins neighbouring versions of like size, newest first, so that every row is rewritten a number of times that grows with the
logarithm of the table. When the oldest version, the base, is among them, changes are merged into it. A version counts from the moment its
commit file is there; the commit of a compaction names the versions that it replaces, and ``vacuum`` deletes those. A batch that is given
again under the same version does nothing. One writer at a time; readers may go on reading.

Rows without a key are never the same as others. They can be added, not changed.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import materialize, store_of

#: Rows of a bucket, which is one file and one task of a write: for wide rows a few hundred megabytes, for narrow ones a larger number is better.
ROWS_PER_BUCKET = 1 << 16
#: Bits of a bucket's filter per row (a power of two is taken), and bits that a key sets.
BITS_PER_ROW, PROBES = 12, 4
#: Neighbouring versions of like size that are joined, and how much larger the older may be.
FAN_IN, LIKE = 4, 2
#: Rows up to which Spark may pass the side of a join through the driver. The files of keys that are much alike are small, but not what is read of them.
BROADCAST_ROWS = 100_000


@dataclass
class Version:
    name: str
    order: int
    base: bool
    buckets: int
    bits: int
    rows: int
    touched: list[int]
    replaces: list[str] = field(default_factory=list)


def _power(n: float) -> int:
    """The smallest power of two that is not less."""
    return 1 << (math.ceil(n) - 1).bit_length() if n > 1 else 1


def _side(rows: DataFrame, n: int) -> DataFrame:
    """The side of a join that has up to ``n`` rows."""
    return rows if n <= BROADCAST_ROWS else rows.hint("merge")


class KeyedTable:
    """The table at ``path`` with the columns of ``schema``. ``key`` is one of them."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.key, self.rows_per_bucket = spark, path.rstrip("/"), key, rows_per_bucket
        self.schema = StructType.fromDDL(schema)
        self.columns = list(self.schema.names)

    # --- versions -------------------------------------------------------------------------------------------------------------

    def versions(self, live: bool = True) -> list[Version]:
        """Committed versions, oldest first: one small file each, a number that compaction keeps low."""
        store, root = store_of(self.path)
        folder = f"{root}/commits"
        if store.get_file_info(folder).type.name == "NotFound":
            return []
        found = []
        for info in store.get_file_info(FileSelector(folder)):
            if info.base_name.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    found.append(Version(**json.loads(f.read())))
        gone = {name for v in found for name in v.replaces} if live else set()
        return sorted((v for v in found if v.name not in gone), key=lambda v: (not v.base, v.order))

    def has(self, order: int) -> bool:
        """Whether a batch of this number was taken, itself or as a part of a later version."""
        return any(v.name == f"v{order}" for v in self.versions(live=False))

    def _hash(self) -> Column:
        key = F.col(self.key).cast("string")
        return F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*self.columns))

    def _spots(self, bits: Column) -> Column:
        """Words and bits that a key sets in the filter of its bucket."""
        at = [F.pmod(F.xxhash64(F.lit(i), F.col(self.key).cast("string")), bits) for i in range(PROBES)]
        mask = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(32)).cast("int"))
        return F.array(*[F.struct(F.floor(p / 32).cast("int").alias("word"), mask(p).alias("mask")) for p in at])

    def _write(self, rows: DataFrame, name: str, order: int, base: bool, expected: int, replaces: list[str] | None = None) -> None:
        buckets = _power(expected / self.rows_per_bucket)
        bits = max(64, _power(BITS_PER_ROW * expected / buckets))
        dealt = rows.select(*self.columns, "_new", F.lit(order).cast("long").alias("_order"), F.pmod(self._hash(), F.lit(buckets)).cast("int").alias("bucket"))
        folder = f"{self.path}/rows/version={name}"
        dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self._stored_at([folder], f"{self.path}/rows") if expected else None
        counts = written.groupBy("bucket").count().collect() if written is not None else []  # one row per bucket
        if counts:
            spots = written.filter(F.col(self.key).isNotNull()).select("bucket", F.explode(self._spots(F.lit(bits))).alias("s"))
            filters = spots.groupBy("bucket", "s.word").agg(F.bit_or("s.mask").alias("mask"))
            filters.write.mode("overwrite").parquet(f"{self.path}/filters/version={name}")
        version = Version(name, order, base, buckets, bits, sum(r["count"] for r in counts), sorted(r.bucket for r in counts), replaces or [])
        store, root = store_of(self.path)
        store.create_dir(f"{root}/commits", recursive=True)
        own = f"{root}/commits/{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(json.dumps(asdict(version)).encode())
        store.move(own, f"{root}/commits/{name}.json")

    def _stored_at(self, folders: list[str], base: str) -> DataFrame:
        schema = StructType(list(self.schema.fields)).add("_new", "boolean").add("_order", "long").add("version", "string").add("bucket", "integer")
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*folders)

    def _rows(self, parts: list[tuple[str, int]]) -> DataFrame:
        """The rows of some buckets of some versions; no other file is opened."""
        return self._stored_at([f"{self.path}/rows/version={name}/bucket={b}" for name, b in parts], f"{self.path}/rows")

    # --- asking ---------------------------------------------------------------------------------------------------------------

    def _candidates(self, keys: DataFrame) -> DataFrame:
        """``(key, version, bucket)`` where the filter does not exclude the key; a written table."""
        live = [v for v in self.versions() if v.touched]
        asked = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        if not live:
            return asked.select(self.key, F.lit("").alias("version"), F.lit(0).alias("bucket")).limit(0)
        facts = F.array(*[F.struct(F.lit(v.name).alias("version"), F.lit(v.buckets).alias("n"), F.lit(v.bits).alias("bits")) for v in live])
        spread = asked.select(self.key, F.xxhash64(F.col(self.key).cast("string")).alias("h"), F.explode(facts).alias("v"))
        spots = spread.select(self.key, "v.version", F.pmod("h", F.col("v.n")).cast("int").alias("bucket"), F.explode(self._spots(F.col("v.bits"))).alias("s"))
        spots = spots.select(self.key, "version", "bucket", "s.word", F.col("s.mask").alias("asked"))
        filters = self.spark.read.schema("bucket int, word int, mask long, version string").option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/version={v.name}" for v in live])
        met = spots.join(_side(filters, sum(v.buckets * v.bits // 32 for v in live)), ["version", "bucket", "word"]).filter(F.col("mask").bitwiseAND(F.col("asked")) == F.col("asked"))
        return materialize(met.groupBy(self.key, "version", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") == PROBES).drop("n"))

    def candidate_files(self, keys: DataFrame) -> list[tuple[str, int]]:
        """The buckets, by version, whose rows have to be read to know which keys are stored."""
        return [(r.version, r.bucket) for r in self._candidates(keys).select("version", "bucket").distinct().collect()]

    def known(self, keys: DataFrame) -> DataFrame:
        """The distinct keys that have a row."""
        candidates = self._candidates(keys)
        parts = [(r.version, r.bucket) for r in candidates.select("version", "bucket").distinct().collect()]
        read = {name for name, _ in parts}
        stored = _side(self._rows(parts).select(self.key), sum(v.rows for v in self.versions() if v.name in read))
        return candidates.select(self.key).distinct().join(stored, self.key, "left_semi")

    # --- changing -------------------------------------------------------------------------------------------------------------

    def _complete(self, rows: DataFrame, new: bool | Column) -> DataFrame:
        filled = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        return rows.select(*filled, (F.lit(new) if isinstance(new, bool) else new).alias("_new"))

    def create(self, rows: DataFrame) -> None:
        """The first version; ``rows`` has one row per key."""
        if self.versions():
            raise ValueError("the table is there already")
        # The count sets the number of buckets; the rows themselves are written once.
        self._write(self._complete(rows, True), "v0", 0, True, rows.count())

    def add(self, rows: DataFrame, order: int) -> None:
        """Add rows whose keys are not stored, each once, as version ``order`` (from 1, rising)."""
        if not self.has(order):
            whole = materialize(self._complete(rows, True))
            self._write(whole, f"v{order}", order, False, whole.count())

    def apply(self, changes: DataFrame, order: int, added: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Take a batch of changes, one row per key, as version ``order``; NULL fields stay as they are.

        Changes of unknown keys are dropped; with ``added``, which makes whole rows of them, they become rows.
        """
        if self.has(order):
            return
        batch = materialize(changes.filter(F.col(self.key).isNotNull()))
        known = materialize(self.known(batch))
        n_known = known.count()
        known = _side(known, n_known)
        rows = self._complete(batch.join(known, self.key, "left_semi"), False)
        if added is not None:
            rows = rows.unionByName(self._complete(added(batch.join(known, self.key, "left_anti")), True))
        # One row per key, so the count needs no second copy of the rows.
        self._write(rows, f"v{order}", order, False, n_known if added is None else batch.count())

    # --- reading --------------------------------------------------------------------------------------------------------------

    def _reduced(self, changes: DataFrame) -> DataFrame:
        """One row per key: of every field the newest value. Rows without a key stay."""
        others = [c for c in self.columns if c != self.key]
        newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in others]
        keyed = changes.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(*newest, F.bool_or("_new").alias("_new"))
        return keyed.unionByName(changes.filter(F.col(self.key).isNull()).select(*keyed.columns))

    def _merged(self, versions: list[Version], parts: Callable[[Version], list[int]]) -> DataFrame:
        base = self._rows([(v.name, b) for v in versions if v.base for b in parts(v)])
        changed = [(v.name, b) for v in versions if not v.base for b in parts(v)]
        if not changed:
            return base.select(*self.columns)
        rows = self._rows(changed)
        # A single version has one row per key, so that nothing is moved.
        changes = self._reduced(rows) if len({name for name, _ in changed}) > 1 else rows
        own = changes.select(F.col(self.key), *[F.col(c).alias(f"n_{c}") for c in self.columns if c != self.key])
        # The base is never shuffled for a few changes: Spark knows their size.
        kept = base.join(_side(own, sum(v.rows for v in versions if not v.base)), self.key, "left").select(
            *[F.col(c) if c == self.key else F.coalesce(f"n_{c}", c).alias(c) for c in self.columns])
        return kept.unionByName(changes.filter("_new").select(*self.columns))

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, merged; with ``keys``, those of the keys' buckets only, then those of the keys."""
        live = self.versions()
        if keys is None:
            return self._merged(live, lambda v: v.touched)
        asked = keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        most = max([v.buckets for v in live], default=1)
        own = [r[0] for r in asked.select(F.pmod(self._hash_of_key(), F.lit(most)).alias("b")).distinct().collect()]  # at most the number of buckets
        wanted = self._merged(live, lambda v: sorted({b % v.buckets for b in own} & set(v.touched)))
        return wanted.join(asked, self.key, "left_semi").select(*self.columns)

    def _hash_of_key(self) -> Column:
        return F.xxhash64(F.col(self.key).cast("string"))

    # --- keeping it small -----------------------------------------------------------------------------------------------------

    def compact(self) -> bool:
        """Join the newest versions of like size, if there are enough of them; whether it did."""
        live = self.versions()
        chosen, rows = [], 0
        for v in reversed(live):
            if chosen and v.rows > LIKE * rows:
                break
            chosen.insert(0, v)
            rows += v.rows
        if len(chosen) < FAN_IN:
            return False
        base, order = chosen[0].base, max(v.order for v in chosen)
        joined = self._merged(chosen, lambda v: v.touched) if base else None
        whole = self._complete(joined, True) if base else self._reduced(self._rows([(v.name, b) for v in chosen for b in v.touched]))
        self._write(whole, f"c{order}-{uuid.uuid4().hex[:8]}", order, base, rows, [v.name for v in chosen])
        return True

    def vacuum(self) -> None:
        """Delete the files of replaced versions. Their commits stay, so that a repeated batch is known."""
        store, root = store_of(self.path)
        live = {v.name for v in self.versions()}
        for v in self.versions(live=False):
            for part in ("rows", "filters"):
                folder = f"{root}/{part}/version={v.name}"
                if v.name not in live and store.get_file_info(folder).type.name != "NotFound":
                    store.delete_dir(folder)
