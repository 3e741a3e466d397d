"""Tables in the shared folder that change a bucket at a time, with all-or-nothing commits.

The state of a folder is its newest manifest: one small file that names, for each table, the folders each hash bucket
is made of, and which stream batches it holds. Data is written to folders that nobody knows yet; a commit then puts the
next manifest in place, which fails if another writer was first. Whatever fails before that leaves the old state.

* ``rewrite`` replaces the buckets that a batch touches (copy on write).
* ``append`` adds a folder to the buckets that a batch touches. Folders are merged in tiers, ``FAN`` of one tier to one of
  the next, so a bucket of n batches has about ``FAN * log(n)`` folders and a row is written about ``log(n)`` times.
* ``lookup`` finds the keys that are stored. Each folder of a bucket has a Bloom filter, kept as rows of bits; only folders
  whose filter has a key are opened. A bucket asked for more than ``FILTERED_KEYS`` keys is opened without its filters: each
  would say yes to one of them, if only by chance.

The manifest grows with buckets and tiers, not with batches; the newest ``KEPT`` manifests stay, so finding the state is
one listing. Folders that no manifest names are left to the caller's cleanup policy.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import child_names, delete_file, put_file, read_file

BUCKETS = 64
FAN = 8
KEPT = 10
RETRIES = 10
BITS_PER_KEY = 16
HASHES = 5
# A filter of 16 to 32 bits a key says yes to one of at most 16,000 keys it does not have, so to one of so many almost surely.
FILTERED_KEYS = 1 << 16

State = dict[str, object]


class ConflictError(RuntimeError):
    """Another writer changed what this commit builds on; the whole batch has to run again."""


class Store:
    """The manifests of one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _entry(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:020d}.json"

    def _versions(self) -> list[int]:
        names = child_names(self.spark, f"{self.root}/_manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def state(self) -> State:
        versions = self._versions()
        if not versions:
            return {"version": 0, "tables": {}, "lists": {}, "applied": {}, "notes": {}}
        return json.loads(read_file(self.spark, self._entry(versions[-1])))

    def commit(self, change: Callable[[State], None]) -> State:
        """Apply a change to the newest state; it is applied again to a newer one if another writer was first."""
        for _ in range(RETRIES):
            state = copy.deepcopy(self.state())
            change(state)
            state["version"] += 1
            if put_file(self.spark, self._entry(state["version"]), json.dumps(state)):
                for old in self._versions()[:-KEPT]:
                    delete_file(self.spark, self._entry(old))
                return state
        raise ConflictError(f"{RETRIES} commits to {self.root} were overtaken")

    def folder(self, name: str) -> str:
        """A path that no other run uses."""
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def read_list(self, name: str, state: State | None = None) -> DataFrame | None:
        """The folders of a list, or None without any."""
        folders = (state or self.state())["lists"].get(name, [])
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def relative(self, folder: str) -> str:
        return folder.removeprefix(self.root + "/")


def mark_applied(state: State, run: str, batch_id: int) -> None:
    state["applied"][run] = batch_id


def is_applied(state: State, run: str, batch_id: int) -> bool:
    """Whether a stream's batch is part of the state. Batches of a run commit in order."""
    return state["applied"].get(run, -1) >= batch_id


class BucketedTable:
    """One table of a store, in ``buckets`` hash buckets of ``keys``.

    Buckets are meant to fit a few tasks each: their number is fixed when the table is created.
    """

    def __init__(self, store: Store, name: str, keys: list[str], buckets: int = BUCKETS, filters: bool = False, fan: int = FAN):
        self.store, self.name, self.keys, self.filters, self.fan = store, name, keys, filters, fan
        self.buckets = store.state()["tables"].get(name, {}).get("buckets", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def entry(self, state: State) -> dict:
        return state["tables"].setdefault(self.name, {"buckets": self.buckets, "schema": None, "runs": {}})

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most their number."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None, state: State | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        entry = self.entry(state or self.store.state())
        if entry["schema"] is None:
            raise ValueError(f"table {self.name} has not been written")
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.store.root}/{run['folder']}" for b, runs in entry["runs"].items() if wanted is None or b in wanted for run in runs]
        return self._open(paths, entry)

    def _open(self, paths: list[str], entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, level: int = 0) -> dict[str, dict]:
        """Write rows to a new folder, split by bucket; returns the run of each bucket that has rows."""
        folder = self.store.folder(self.name)
        dealt = rows.withColumn("_bucket", self.bucket())
        dealt.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        names = [n for n in child_names(self.store.spark, folder) if n.startswith("_bucket=")]
        runs = {
            n.removeprefix("_bucket="): {"folder": self.store.relative(f"{folder}/{n}"), "level": level} for n in names
        }
        if self.filters and runs:
            self._write_filters(folder, runs)
        return runs

    # ---- Bloom filters ----

    def _bits(self, keys: DataFrame, size: Column) -> DataFrame:
        """The bits of each key in a filter of ``size`` bits (a power of two): ``word`` and ``mask``."""
        places = F.array(*[F.xxhash64(F.lit(n + 1), *self.keys).bitwiseAND(size - 1) for n in range(HASHES)])
        exploded = keys.withColumn("_place", F.explode(places))
        mask = F.expr("shiftleft(1L, cast(_place & 63 AS int))")
        return exploded.withColumns({"word": F.shiftright("_place", 6), "mask": mask}).drop("_place")

    def _write_filters(self, folder: str, runs: dict[str, dict]) -> None:
        spark = self.store.spark
        keys = spark.read.parquet(folder).select(F.col("_bucket").cast("int").alias("bucket"), *self.keys)
        size, wanted = 64, keys.count() * BITS_PER_KEY
        while size * len(runs) < wanted:
            size *= 2
        bits = self._bits(keys, F.lit(size).cast("long")).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        bits.withColumn("_bucket", F.col("bucket")).write.partitionBy("_bucket").parquet(f"{folder}-filter")
        for bucket, run in runs.items():
            run["filter"] = self.store.relative(f"{folder}-filter/_bucket={bucket}")
            run["bits"] = size

    def _asked(self, keys: DataFrame) -> dict[int, int]:
        """Buckets of the keys and about how many different keys each is asked for."""
        distinct = F.approx_count_distinct(F.xxhash64(*self.keys)).alias("keys")
        counted = keys.groupBy(self.bucket().alias("bucket")).agg(distinct)
        return {r["bucket"]: r["keys"] for r in counted.collect()}

    def runs_with(self, keys: DataFrame, state: State | None = None) -> list[str]:
        """Folders in which one of the keys may be stored; those without a key's bits are not opened for few keys."""
        entry = self.entry(state or self.store.state())
        wanted = self._asked(keys)
        runs = {b: entry["runs"].get(str(b), []) for b in sorted(wanted)}
        opened = [run["folder"] for b, r in runs.items() if wanted[b] > FILTERED_KEYS for run in r]
        runs = {b: r for b, r in runs.items() if wanted[b] <= FILTERED_KEYS}
        filters = [run["filter"] for r in runs.values() for run in r]
        if not filters:
            return opened
        spark = self.store.spark
        stored = spark.read.parquet(*[f"{self.store.root}/{f}" for f in filters]).withColumn(
            "run", F.regexp_extract(F.input_file_name(), r"([0-9a-f]{32})-filter/_bucket=", 1)
        )
        sizes = spark.createDataFrame(
            sorted({(run["folder"].split("/")[1], run["bits"]) for r in runs.values() for run in r}), "run string, size long"
        )
        asked = keys.select(*self.keys).distinct().withColumn("bucket", self.bucket()).where(F.col("bucket").isin(*runs))
        asked = self._bits(asked.join(sizes.select("size").distinct()), F.col("size"))
        hits = (
            asked.join(stored.join(sizes, "run"), ["bucket", "size", "word"])
            .where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
            .groupBy("bucket", "run", *self.keys)
            .count()
            .where(F.col("count") == HASHES)
        )
        found = {(r["bucket"], r["run"]) for r in hits.select("bucket", "run").distinct().collect()}
        return opened + [run["folder"] for b, r in runs.items() for run in r if (b, run["folder"].split("/")[1]) in found]

    def lookup(self, keys: DataFrame, state: State | None = None) -> DataFrame:
        """Those of the keys that are stored."""
        asked = keys.select(*self.keys).distinct()
        stored = self._opened_for(keys, state or self.store.state())
        return asked.limit(0) if stored is None else asked.join(stored.select(*self.keys), self.keys, "left_semi")

    def fetch(self, keys: DataFrame, state: State | None = None) -> DataFrame | None:
        """The stored rows of the keys, or None before anything is stored. Needs filters."""
        stored = self._opened_for(keys, state or self.store.state())
        return None if stored is None else stored.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _opened_for(self, keys: DataFrame, state: State) -> DataFrame | None:
        entry = self.entry(state)
        if entry["schema"] is None:
            return None
        return self._open([f"{self.store.root}/{f}" for f in self.runs_with(keys, state)], entry)

    # ---- writing ----

    def rewrite(self, buckets: list[int], rows: DataFrame, state: State | None = None) -> Callable[[State], None]:
        """Write the new content of some buckets; returns the change for a commit.

        ``state`` is what the rows were made from. The commit fails if another one has changed any of these buckets since.
        """
        base = copy.deepcopy(self.entry(state or self.store.state())["runs"])
        schema = json.loads(rows.schema.json())
        runs = self._write(rows)
        stray = set(runs) - {str(b) for b in buckets}
        if stray:
            raise ValueError(f"rows of buckets {sorted(stray)} that are not rewritten")

        def change(state: State) -> None:
            entry = self.entry(state)
            entry["schema"] = schema
            for b in map(str, buckets):
                if entry["runs"].get(b, []) != base.get(b, []):
                    raise ConflictError(f"bucket {b} of {self.name} has changed")
                entry["runs"][b] = [runs[b]] if b in runs else []

        return change

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[State], None]:
        """Apply changes to the buckets of their keys; ``merge`` makes the new rows from the stored ones and the changes.

        Only those buckets are read and written. Returns the change for a commit.
        """
        state = self.store.state()
        buckets = self.touched(changes)
        return self.rewrite(buckets, merge(self.read(buckets, state), changes), state)

    def append(self, rows: DataFrame) -> Callable[[State], None]:
        """Write more rows; returns the change for a commit."""
        schema = json.loads(rows.schema.json())
        runs = self._write(rows)

        def change(state: State) -> None:
            entry = self.entry(state)
            entry["schema"] = schema
            for b, run in runs.items():
                entry["runs"].setdefault(b, []).append(run)

        return change

    def merge(self, combine: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """Merge tiers that have ``fan`` folders, one job a tier; returns the number of folders that went.

        ``combine`` may put rows of the same keys into one, as long as it does not matter which rows it gets together.
        """
        gone = 0
        while True:
            state = self.store.state()
            entry = self.entry(state)
            level = min(
                (lv for runs in entry["runs"].values() for lv in {r["level"] for r in runs}
                 if sum(r["level"] == lv for r in runs) >= self.fan),
                default=None,
            )
            if level is None:
                return gone
            full = {
                b: [r for r in runs if r["level"] == level]
                for b, runs in entry["runs"].items() if sum(r["level"] == level for r in runs) >= self.fan
            }
            paths = [f"{self.store.root}/{r['folder']}" for runs in full.values() for r in runs]
            merged = self._write(combine(self._open(paths, entry)), level + 1)

            def change(state: State, full=full, merged=merged) -> None:
                runs_of = self.entry(state)["runs"]
                for b, old in full.items():
                    if any(r not in runs_of.get(b, []) for r in old):
                        raise ConflictError(f"bucket {b} of {self.name} has changed")
                    runs_of[b] = [r for r in runs_of[b] if r not in old] + ([merged[b]] if b in merged else [])

            self.store.commit(change)
            gone += len(paths) - len(full)
