"""Versioned tables: a base snapshot, a change log, and branches.

A change log has the columns of the table plus ``version``, ``branch`` and ``op``
('upsert' or 'delete'; for a delete only the key is used). A branch is a line of
ancestry: its own changes up to a version, then its parent's up to the fork. Opening
a branch copies nothing; reading one touches the base and the log once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rankweave.session import BROADCAST_ROWS, at_most, durable, stored

LOG_COLUMNS = ("version", "branch", "op")
FOREVER = 2**62
# Rows of a table and its log that one task of a merge compares, about.
MERGE_ROWS = 200_000


@dataclass(frozen=True)
class Line:
    """A branch and the last version of it that is seen."""

    branch: str
    upto: int = FOREVER


def changes_in(log: DataFrame, ancestry: list[Line]) -> DataFrame:
    """Log rows visible along an ancestry."""
    seen: Column = F.lit(False)
    for line in ancestry:
        seen = seen | ((F.col("branch") == line.branch) & (F.col("version") <= line.upto))
    return log.where(seen)


def last_changes(log: DataFrame, key: list[str]) -> DataFrame:
    """The latest log row of every key. A key's changes are folded before the shuffle."""
    whole = F.struct(*log.columns)
    return log.groupBy(*key).agg(F.max_by(whole, F.col("version")).alias("__last")).select("__last.*")


def read_branch(base: DataFrame, log: DataFrame, key: list[str], ancestry: list[Line]) -> DataFrame:
    """The table as seen along an ancestry."""
    last = last_changes(changes_in(log, ancestry), key)
    untouched = base.join(last.select(*key), key, "left_anti")
    return untouched.select(*base.columns).unionByName(
        last.where(F.col("op") != "delete").select(*base.columns)
    )


def diff_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(*key, op, col, old, new): a row per changed field, values as text.

    Rows only on one side give all their fields, with op 'insert' or 'delete'.
    """
    fields = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*fields).alias("a"))
    b = after.select(*key, F.struct(*fields).alias("b"))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("col"),
                F.col("a")[c].cast("string").alias("old"),
                F.col("b")[c].cast("string").alias("new"),
                (~F.col("a")[c].eqNullSafe(F.col("b")[c])).alias("changed"),
            )
            for c in fields
        ]
    )
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("update")
    return (
        a.join(b, key, "full")
        .select(*key, op.alias("op"), F.inline(cells))
        .where(F.col("changed") | (F.col("op") != "update"))
        .select(*key, "op", "col", "old", "new")
    )


def diff_branch(
    base: DataFrame, log: DataFrame, key: list[str], parent: list[Line], branch: str
) -> DataFrame:
    """What ``branch`` changed since it was forked; ``parent`` is the view at the fork.

    Only the keys in the branch's own log are looked up.
    """
    own = changes_in(log, [Line(branch)])
    keys = own.select(*key).distinct()
    before = read_branch(base.join(keys, key, "left_semi"), log.join(keys, key, "left_semi"), key, parent)
    after = read_branch(before, own, key, [Line(branch)])
    return diff_rows(before, after, key)


def merge_fields(
    fork: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str]
) -> DataFrame:
    """Three-way comparison per key: (*key, fork, ours, theirs, op, merged, conflicts).

    A field changed on one side only takes that side's value. A field changed on
    both sides to different values, or changed on one side and deleted on the other,
    is a conflict: an entry (col, base, ours, theirs) of ``conflicts``.
    """
    fields = [c for c in fork.columns if c not in key]
    sides = {
        name: df.select(*key, F.struct(*fields).alias(name))
        for name, df in (("fork", fork), ("ours", ours), ("theirs", theirs))
    }
    rows = sides["fork"].join(sides["ours"], key, "full").join(sides["theirs"], key, "full")
    o, t, f = F.col("ours"), F.col("theirs"), F.col("fork")
    o_changed, t_changed = ~o.eqNullSafe(f), ~t.eqNullSafe(f)
    gone = (o.isNull() | t.isNull()) & f.isNotNull()
    row_conflict = gone & o_changed & t_changed & ~o.eqNullSafe(t)
    cells, merged = [], []
    for c in fields:
        mine, other = ~o[c].eqNullSafe(f[c]), ~t[c].eqNullSafe(f[c])
        clash = ~gone & mine & other & ~o[c].eqNullSafe(t[c])
        cells.append(
            F.when(
                clash,
                F.struct(
                    F.lit(c).alias("col"),
                    f[c].cast("string").alias("base"),
                    o[c].cast("string").alias("ours"),
                    t[c].cast("string").alias("theirs"),
                ),
            )
        )
        merged.append(F.when(other, t[c]).otherwise(o[c]).alias(c))
    whole = F.when(
        row_conflict,
        F.struct(
            F.lit("<row>").alias("col"),
            F.when(f.isNotNull(), "present").alias("base"),
            F.when(o.isNotNull(), "present").otherwise("deleted").alias("ours"),
            F.when(t.isNotNull(), "present").otherwise("deleted").alias("theirs"),
        ),
    )
    conflicts = F.filter(F.array(whole, *cells), lambda x: x.isNotNull())
    op = F.when(t.isNull(), "delete").otherwise("upsert")
    return rows.where(t_changed & ~o.eqNullSafe(t)).select(
        *key,
        "fork",
        "ours",
        "theirs",
        op.alias("op"),
        F.struct(*merged).alias("merged"),
        conflicts.alias("conflicts"),
    )


def conflict_rows(merge: DataFrame, key: list[str]) -> DataFrame:
    """(*key, col, base, ours, theirs) out of :func:`merge_fields`."""
    return merge.select(*key, F.inline("conflicts"))


def merge_branches(
    base: DataFrame, log: DataFrame, key: list[str], parent: list[Line], fork: list[Line], branch: str
) -> DataFrame:
    """:func:`merge_fields` of a branch into its parent, over the branch's keys only.

    What is near those keys is written once, as it is read from several sides, and then
    dealt by key to as many tasks as ``MERGE_ROWS`` asks for: a task sorts several tables
    side by side, so the sizes that Spark aims at are too large.
    """
    own = stored(changes_in(log, [Line(branch)]), "own")
    keys = stored(own.select(*key).distinct(), "keys")
    if at_most(keys, BROADCAST_ROWS):
        near = [df.join(F.broadcast(keys), key, "left_semi") for df in (base, log)]
    else:
        parts = (base.count() + own.count()) // MERGE_ROWS + 1
        near = [df.repartition(parts, *key).join(keys.repartition(parts, *key), key, "left_semi") for df in (base, log)]
    near_base, near_log = stored(near[0], "near-base"), stored(near[1], "near-log")
    parts = (near_base.count() + near_log.count()) // MERGE_ROWS + 1
    near_base, near_log, own = (df.repartition(parts, *key) for df in (near_base, near_log, own))
    at_fork = read_branch(near_base, near_log, key, fork).repartition(parts, *key)
    ours = read_branch(near_base, near_log, key, parent).repartition(parts, *key)
    theirs = read_branch(at_fork, own, key, [Line(branch)]).repartition(parts, *key)
    return merge_fields(at_fork, ours, theirs, key)


def merge_changes(merge: DataFrame, key: list[str]) -> DataFrame:
    """(op, *columns): the changes a merge makes where nothing is in conflict."""
    clean = merge.where(F.size("conflicts") == 0)
    names = [f.name for f in merge.schema["merged"].dataType.fields]
    return clean.select("op", *key, *[F.col("merged")[n].alias(n) for n in names])


def inverse_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(op, *columns): the changes that lead from ``after`` back to ``before``."""
    restore = before.exceptAll(after).select(F.lit("upsert").alias("op"), *before.columns)
    extra = after.join(before.select(*key), key, "left_anti").select(
        F.lit("delete").alias("op"), *before.columns
    )
    return restore.unionByName(extra)


class VersionedTable:
    """A versioned table below a path: base, log and small catalogue tables.

    ``base/`` is written once. Every commit appends ``log/version=n``. ``meta/`` has
    one JSON row per catalogue version; it is written last, so a commit is seen
    whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        try:
            versions = spark.read.parquet(f"{path}/meta")
        except AnalysisException:
            raise FileNotFoundError(f"no versioned table at {path!r}") from None
        self._meta = json.loads(versions.orderBy(F.col("at").desc()).select("body").first()["body"])

    @classmethod
    def track(cls, df: DataFrame, key: list[str] | str, path: str) -> "VersionedTable":
        """Start the history of a table."""
        key = [key] if isinstance(key, str) else list(key)
        clash = set(LOG_COLUMNS) & set(df.columns)
        if clash:
            raise ValueError(f"column names kept for the log: {sorted(clash)}")
        if df.groupBy(*key).count().where("count > 1").limit(1).collect():
            raise ValueError(f"key {key} is not unique")
        df.write.mode("errorifexists").parquet(f"{path}/base")
        meta = {"at": 0, "version": 0, "key": key, "branches": {"main": None}, "savepoints": {}, "merges": {}, "commits": {}}
        cls._write_meta(df.sparkSession, path, meta)
        return cls(df.sparkSession, path)

    @staticmethod
    def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
        spark.createDataFrame([(json.dumps(meta),)], "body string").coalesce(1).write.mode(
            "errorifexists"
        ).parquet(f"{path}/meta/at={meta['at']}")

    def _update(self, **changes) -> None:
        meta = {**self._meta, **changes, "at": self._meta["at"] + 1}
        self._write_meta(self.spark, self.path, meta)
        self._meta = meta

    @property
    def key(self) -> list[str]:
        return self._meta["key"]

    @property
    def version(self) -> int:
        return self._meta["version"]

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base")

    def log(self) -> DataFrame:
        """The change log of the committed versions."""
        base = self.base()
        done = sorted(int(v) for v in self._meta["commits"])
        if not done:
            empty = base.limit(0)
            return empty.select(
                "*", F.lit(0).cast("long").alias("version"), F.lit("").alias("branch"), F.lit("").alias("op")
            )
        rows = self.spark.read.option("basePath", f"{self.path}/log").parquet(
            *[f"{self.path}/log/version={v}" for v in done]
        )
        return rows.withColumn("version", F.col("version").cast("long")).select(*base.columns, *LOG_COLUMNS)

    def _known(self, branch: str) -> None:
        if branch not in self._meta["branches"]:
            raise ValueError(f"unknown branch {branch!r}")

    def ancestry(self, branch: str = "main", as_of: int | None = None) -> list[Line]:
        """The branch and its parents, each with the last version seen."""
        self._known(branch)
        upto = FOREVER if as_of is None else as_of
        lines = [Line(branch, upto)]
        parent = self._meta["branches"][branch]
        while parent is not None:
            upto = min(upto, parent["at"])
            lines.append(Line(parent["from"], upto))
            parent = self._meta["branches"][parent["from"]]
        return lines

    def _fork(self, branch: str) -> list[Line]:
        """Where the branch left its parent."""
        self._known(branch)
        parent = self._meta["branches"][branch]
        if parent is None:
            raise ValueError(f"{branch!r} has no parent")
        return self.ancestry(parent["from"], parent["at"])

    def _merge_base(self, branch: str) -> list[Line]:
        """What both sides had in common last: the branch as last merged, else the fork."""
        fork = self._fork(branch)
        merged = self._meta.get("bases", {}).get(branch)
        return self.ancestry(branch, merged[-1][1]) if merged else fork

    def create_branch(self, name: str, source: str = "main") -> None:
        """Open a branch at the current version; nothing is copied."""
        self._known(source)
        if name in self._meta["branches"]:
            raise ValueError(f"branch {name!r} exists")
        self._update(branches={**self._meta["branches"], name: {"from": source, "at": self.version}})

    def commit(self, branch: str = "main", upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Write rows and deleted keys on a branch as one version; returns its number."""
        self._known(branch)
        base = self.base()
        parts = []
        if upserts is not None:
            parts.append(upserts.select(*base.columns).withColumn("op", F.lit("upsert")))
        if deletes is not None:
            others = [
                F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema if f.name not in self.key
            ]
            parts.append(deletes.select(*self.key, *others).withColumn("op", F.lit("delete")).select(*base.columns, "op"))
        if not parts:
            raise ValueError("nothing to commit")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return self._append(branch, rows)

    def _append(self, branch: str, rows: DataFrame, **changes) -> int:
        version = self.version + 1
        rows = rows.withColumn("branch", F.lit(branch))
        target = f"{self.path}/log/version={version}"
        rows.write.mode("overwrite").parquet(target)
        written = self.spark.read.parquet(target)
        if written.groupBy(*self.key).count().where("count > 1").limit(1).collect():
            raise ValueError("a commit must change a key once only")
        commits = {**self._meta["commits"], str(version): branch}
        self._update(version=version, commits=commits, **changes)
        return version

    def read(self, branch: str = "main", as_of: int | None = None) -> DataFrame:
        return read_branch(self.base(), self.log(), self.key, self.ancestry(branch, as_of))

    def diff(self, branch: str) -> DataFrame:
        return diff_branch(self.base(), self.log(), self.key, self._fork(branch), branch)

    def merge(self, branch: str) -> tuple[int | None, DataFrame]:
        """Merge into the parent. (version, conflicts): no version when there is a conflict."""
        parent = self._meta["branches"][branch]["from"] if self._fork(branch) else "main"
        # Read by the test and by the commit, so it is worked out once.
        merge = durable(
            merge_branches(self.base(), self.log(), self.key, self.ancestry(parent), self._merge_base(branch), branch)
        )
        conflicts = conflict_rows(merge, self.key)
        if conflicts.limit(1).collect():
            return None, conflicts
        merges = {**self._meta["merges"], str(self.version + 1): branch}
        bases = self._meta.get("bases", {})
        bases = {**bases, branch: [*bases.get(branch, []), [self.version + 1, self.version]]}
        columns = self.base().columns
        changes = merge_changes(merge, self.key).select(*columns, "op")
        version = self._append(parent, changes, merges=merges, bases=bases)
        return version, conflicts

    def undo_merge(self, version: int) -> int:
        """Give the keys a merge changed the values they had before it."""
        if str(version) not in self._meta["merges"]:
            raise ValueError(f"version {version} is not a merge")
        branch = self._meta["commits"][str(version)]
        # The merged branch may be merged again, so its base is that of the merges that still hold.
        kept = {b: [m for m in merged if m[0] != version] for b, merged in self._meta.get("bases", {}).items()}
        return self._back_to(branch, version - 1, only=version, bases=kept)

    def _back_to(self, branch: str, as_of: int, only: int | None = None, **changes) -> int:
        rows = self.inverse(branch, as_of, only)
        return self._append(branch, rows.select(*self.base().columns, "op"), **changes)

    def inverse(self, branch: str, as_of: int, only: int | None = None) -> DataFrame:
        """(op, *columns) leading from the branch as it is back to a version of it."""
        log = self.log()
        own = log.where((F.col("branch") == branch) & (F.col("version") > as_of))
        if only is not None:
            own = own.where(F.col("version") == only)
        keys = own.select(*self.key).distinct()
        near_base = self.base().join(keys, self.key, "left_semi")
        near_log = log.join(keys, self.key, "left_semi")
        before = read_branch(near_base, near_log, self.key, self.ancestry(branch, as_of))
        after = read_branch(near_base, near_log, self.key, self.ancestry(branch))
        return inverse_changes(before, after, self.key)

    def savepoint(self, name: str, branch: str = "main") -> str:
        """Name the current version; returns the savepoint's time-ordered id."""
        from rankweave.functions.scalars import uuidv7

        self._known(branch)
        one = self.spark.range(1).select(uuidv7(F.current_timestamp(), F.lit(f"{branch}/{name}")).alias("u"))
        ident = one.first()["u"]
        points = {**self._meta["savepoints"], name: {"branch": branch, "version": self.version, "id": ident}}
        self._update(savepoints=points)
        return ident

    def _savepoint(self, name: str) -> dict:
        if name not in self._meta["savepoints"]:
            raise ValueError(f"unknown savepoint {name!r}")
        return self._meta["savepoints"][name]

    def undo_summary(self, name: str) -> DataFrame:
        """(op, n): what going back to a savepoint would do."""
        point = self._savepoint(name)
        rows = self.inverse(point["branch"], point["version"])
        return rows.groupBy("op").agg(F.count("*").alias("n"))

    def undo_to(self, name: str) -> int:
        """Bring the branch back to a savepoint, as a new version."""
        point = self._savepoint(name)
        return self._back_to(point["branch"], point["version"])
