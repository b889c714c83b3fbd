"""A table with constraints, policies, triggers and change rows; changes are rewrites into a new snapshot.

A snapshot is a Parquet folder; a change writes the next one and then moves the pointer, so readers never see half
a change and BEGIN / ROLLBACK keep and restore a pointer.

Row policies hold for reads and, where a user is named, for every change: a user changes only rows that the policies
show, and new rows must pass the checks.  A policy names the user as current_user (or current_role); the name is put in as
a literal, never as text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize


class ConstraintError(ValueError):
    pass


@dataclass
class ForeignKey:
    columns: list[str]
    parent: "Table"
    parent_columns: list[str]
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass
class Policy:
    name: str
    using: str | None = None
    check: str | None = None
    command: str = "all"
    roles: tuple[str, ...] = ()


_LEXEMES = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|[A-Za-z_]\w*|\s+|.""", re.S)


def bound(text: str, user: str) -> Column:
    """The predicate of a policy, false where null: whole words current_user and current_role outside quotes become the user's name as a literal."""
    name = f"cast(unhex('{user.encode().hex()}') AS STRING)"
    return F.coalesce(F.expr("".join(name if x.lower() in ("current_user", "current_role") else x for x in _LEXEMES.findall(text))), F.lit(False))


@dataclass
class Table:
    name: str
    df: DataFrame
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    serial: str | None = None
    foreign: list[ForeignKey] = field(default_factory=list)
    children: list["Table"] = field(default_factory=list)
    policies: list[Policy] = field(default_factory=list)
    rls: bool = False
    triggers: dict[tuple[str, str], list[Callable]] = field(default_factory=dict)
    changes: list[DataFrame] = field(default_factory=list)
    version: int = 0

    def __post_init__(self) -> None:
        for f in self.foreign:
            f.parent.children.append(self)

    # Reading

    def read(self, user: str | None = None, superuser: bool = False) -> DataFrame:
        """All rows, or those that every policy for this user lets see."""
        if not self.rls or superuser or user is None:
            return self.df
        return self.df.filter(self._seen(user, "select"))

    def _seen(self, user: str | None, command: str) -> Column:
        """Whether every policy of a command lets the user see a row."""
        out = F.lit(True)
        if self.rls and user is not None:
            for p in self._applicable(user, command):
                out = out & bound(p.using, user) if p.using else out
        return out

    def _admit(self, rows: DataFrame, user: str | None, command: str) -> None:
        """An error if a new row fails a policy's check (its using, where it has no check)."""
        if self.rls and user is not None:
            for p in self._applicable(user, command):
                if (p.check or p.using) and rows.filter(~bound(p.check or p.using, user)).take(1):
                    raise PermissionError(f"{self.name}: policy {p.name} refuses a row")

    def _applicable(self, user: str, command: str) -> list[Policy]:
        return [p for p in self.policies if p.command in ("all", command) and (not p.roles or user in p.roles)]

    # Checks

    def violations(self, rows: DataFrame, present: DataFrame | None = None) -> dict[str, DataFrame]:
        """Of each constraint, the offending rows."""
        out = {f"not_null {c}": rows.filter(F.col(c).isNull()) for c in {*self.not_null, *self.key}}
        out |= {f"check {n}": rows.filter(~F.coalesce(F.expr(e), F.lit(True))) for n, e in self.checks.items()}
        whole = rows if present is None else present.unionByName(rows)
        for cols in [*([self.key] if self.key else []), *self.unique]:
            told = whole.filter(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0)
            out[f"unique {','.join(cols)}"] = told.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        for f in self.foreign:
            parents = f.parent.df.select(*(F.col(p).alias(c) for p, c in zip(f.parent_columns, f.columns))).distinct()
            out[f"foreign {','.join(f.columns)}"] = rows.filter(sum((F.col(c).isNull().cast("int") for c in f.columns), F.lit(0)) == 0).join(parents, f.columns, "left_anti")
        return out

    def _verify(self, rows: DataFrame, present: DataFrame | None = None) -> None:
        for name, bad in self.violations(rows, present).items():
            if bad.take(1):
                raise ConstraintError(f"{self.name}: {name}")

    def _fire(self, when: str, what: str, rows: DataFrame) -> None:
        for f in self.triggers.get((when, what), []):
            f(self, rows)

    def _log(self, kind: str, rows: DataFrame) -> None:
        self.version += 1
        self.changes.append(rows.select(F.lit(self.name).alias("table"), F.lit(kind).alias("kind"), F.to_json(F.struct(*self.df.columns)).alias("data"), F.lit(self.version).alias("version")))

    def change_log(self) -> DataFrame:
        """table, kind, data (JSON) and version (which rises with each change of the table) of each changed row."""
        out = self.changes[0]
        for d in self.changes[1:]:
            out = out.unionByName(d)
        return out

    # Changes; each returns the rows it affected

    def insert(self, rows: DataFrame, on_conflict: str = "error", user: str | None = None, assign: dict[str, str] | None = None) -> DataFrame:
        """Missing columns get defaults or null, serial ones the next numbers.

        on_conflict: error; nothing; or update, which applies assign (over t.*, the present row, and s.*, the new one) to the
        rows whose key is there.  Rows that a policy's check refuses are left out.
        """
        for c, kind in self.df.dtypes:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.expr(self.defaults[c]).cast(kind) if c in self.defaults else F.lit(None).cast(kind))
        rows = rows.select(*(F.col(c).cast(k).alias(c) for c, k in self.df.dtypes))
        if self.serial:
            rows = number_rows(rows, self.serial, self.df.agg(F.max(self.serial)).first()[0] or 0)
            rows = rows.withColumn(self.serial, F.col(self.serial).cast(self.df.schema[self.serial].dataType))
        if self.rls and user is not None:
            own = self._applicable(user, "insert")
            if self.policies and not own:
                raise PermissionError(f"{self.name}: no policy lets {user} insert")
            for p in own:
                if p.check or p.using:
                    rows = rows.filter(bound(p.check or p.using, user))
        if on_conflict == "update":
            return self.merge(rows, self.key, assign or {}, insert={c: f"s.{c}" for c in self.df.columns}, user=user)
        if on_conflict == "nothing" and self.key:
            rows = rows.join(self.df.select(*self.key), self.key, "left_anti").dropDuplicates(self.key)
        rows = materialize(rows, "insert")
        self._fire("before", "insert", rows)
        self._verify(rows, self.df)
        self.df = materialize(self.df.unionByName(rows.select(*self.df.columns)), self.name)
        self._log("insert", rows)
        self._fire("after", "insert", rows)
        return rows

    def update(self, assign: dict[str, str], where: str = "true", user: str | None = None) -> DataFrame:
        old, hit = self.df, predicate(where) & self._seen(user, "update")
        new = old.select(*(F.when(hit, F.expr(assign[c]).cast(k)).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c, k in old.dtypes), hit.alias("_hit"), *(F.col(c).alias(f"_old_{c}") for c in self._referred()))
        new = materialize(new, "update")
        rows = new.filter("_hit").select(*old.columns)
        self._admit(rows, user, "update")
        self._fire("before", "update", rows)
        self._verify(rows, new.filter("NOT _hit").select(*old.columns))
        moved = new.filter("_hit").select(*(F.col(f"_old_{c}") for c in self._referred()), *(F.col(c).alias(f"_new_{c}") for c in self._referred()))
        cascades = bool(set(assign) & set(self._referred()))
        if cascades:
            moved = moved.filter(~sum((F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")).cast("int") for c in self._referred()), F.lit(0)).eqNullSafe(F.lit(len(self._referred()))))
            self._refused(moved, "on_update")
        self.df = materialize(new.select(*old.columns), self.name)
        self._log("update", rows)
        if cascades:
            self._cascade(moved, "on_update")
        self._fire("after", "update", rows)
        return rows

    def delete(self, where: str = "true", user: str | None = None) -> DataFrame:
        hit = predicate(where) & self._seen(user, "delete")
        return self._remove(materialize(self.df.withColumn("_hit", hit), "delete"))

    def _remove(self, marked: DataFrame) -> DataFrame:
        """Without the rows of marked (the table and _hit) that are hit."""
        gone = marked.filter("_hit").select(*self.df.columns)
        self._fire("before", "delete", gone)
        keys = gone.select(*(F.col(c).alias(f"_old_{c}") for c in self._referred()))
        if self.children:
            self._refused(keys, "on_delete")
        self.df = materialize(marked.filter("NOT _hit").select(*self.df.columns), self.name)
        self._log("delete", gone)
        if self.children:
            self._cascade(keys, "on_delete")
        self._fire("after", "delete", gone)
        return gone

    def _referred(self) -> list[str]:
        """The columns that a cascade follows: the key, and those that children refer to."""
        out = list(self.key)
        for child in self.children:
            out += [c for f in child.foreign if f.parent is self for c in f.parent_columns if c not in out]
        return out

    def _links(self):
        seen = []
        for child in self.children:
            for f in child.foreign:
                if f.parent is self and not any(f is x for x in seen):
                    seen.append(f)
                    yield child, f

    def _touched(self, child: "Table", f: ForeignKey, keys: DataFrame) -> DataFrame:
        """The child's rows that refer to a key; with their old and, on an update, new columns."""
        extra = [c for c in keys.columns if c.startswith("_new_")]
        own = keys.select(*(F.col(f"_old_{p}").alias(f"_k{i}") for i, p in enumerate(f.parent_columns)), *extra).dropDuplicates([f"_k{i}" for i in range(len(f.columns))])
        return child.df.join(own, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(f.columns)])

    def _after(self, child: "Table", f: ForeignKey, touched: DataFrame, event: str) -> DataFrame | None:
        """Old and new columns of the child's rows for its own children; None if the child's children can't be concerned."""
        deletes = event == "on_delete" and f.on_delete == "cascade"
        if not child.children or not (deletes or set(f.columns) & set(child._referred())):
            return None
        old = [F.col(c).alias(f"_old_{c}") for c in child._referred()]
        if deletes:
            return touched.select(*old)
        to = dict(zip(f.columns, (F.col(f"_new_{p}") if event == "on_update" and f.on_update == "cascade" else F.lit(None).cast(child.df.schema[c].dataType) for c, p in zip(f.columns, f.parent_columns))))
        return touched.select(*old, *(to.get(c, F.col(c)).alias(f"_new_{c}") for c in child._referred()))

    def _refused(self, keys: DataFrame, event: str) -> None:
        """An error if a row anywhere below refers with restrict; before anything is changed."""
        for child, f in self._links():
            touched = self._touched(child, f, keys)
            if getattr(f, event) == "restrict":
                if touched.take(1):
                    raise ConstraintError(f"{child.name}: rows refer to {self.name}")
                continue
            below = self._after(child, f, touched, event)
            if below is not None:
                child._refused(below, "on_delete" if event == "on_delete" and f.on_delete == "cascade" else "on_update")

    def _cascade(self, keys: DataFrame, event: str) -> None:
        """Carry out what the foreign keys ask of the children, and of theirs; each change is logged and fires the child's triggers."""
        for child, f in self._links():
            action = getattr(f, event)
            touched = materialize(self._touched(child, f, keys), "touched")
            if action == "restrict" or not touched.take(1):
                continue
            below = self._after(child, f, touched, event)
            names = child.df.columns
            marks = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(f.columns)]
            told = touched.select(*(f"_k{i}" for i in range(len(f.columns))), *(c for c in touched.columns if c.startswith("_new_"))).distinct()
            if event == "on_delete" and action == "cascade":
                rows, kind = touched.select(*names), "delete"
                child.df = materialize(child.df.join(told, marks, "left_anti"), child.name)
            else:
                to = {c: (F.col(f"_new_{p}") if action == "cascade" else F.lit(None)).cast(child.df.schema[c].dataType) for c, p in zip(f.columns, f.parent_columns)}
                new = child.df.join(told.withColumn("_hit", F.lit(True)), marks, "left")
                new = materialize(new.select(*(F.when(F.col("_hit"), to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in names), F.coalesce("_hit", F.lit(False)).alias("_hit")), child.name)
                rows, kind = new.filter("_hit").select(*names), "update"
                child._verify_own(rows)
                child.df = new.select(*names)
            child._log(kind, rows)
            if below is not None:
                child._cascade(below, "on_delete" if kind == "delete" else "on_update")
            child._fire("after", kind, rows)

    def _verify_own(self, rows: DataFrame) -> None:
        """NOT NULL and CHECK of rows that a cascade changed."""
        for name, bad in self.violations(rows).items():
            if name.startswith(("not_null", "check")) and bad.take(1):
                raise ConstraintError(f"{self.name}: {name}")

    def merge(self, source: DataFrame, on: list[str], matched: dict[str, str] | str | None = None, when: str = "true", insert: dict[str, str] | None = None, user: str | None = None) -> DataFrame:
        """matched: assignments over t.* and s.*, or "delete", or None; insert: values over s.*, or None.  One full join and one rewrite.

        Returns the rows that were inserted, updated or deleted.  A row that two source rows match is an error.
        """
        cols, kinds = self.df.columns, dict(self.df.dtypes)
        t, s = self.df.withColumn("_t", F.monotonically_increasing_id()).alias("t"), source.withColumn("_s", F.lit(True)).alias("s")
        j = t.join(s, [F.col(f"t.{c}") == F.col(f"s.{c}") for c in on], "full")
        both = F.col("_t").isNotNull() & F.col("_s").isNotNull() & predicate(when) & self._seen_as("t", user, "delete" if matched == "delete" else "update")
        fresh = F.col("_t").isNull()
        kind = F.when(fresh, "insert" if insert is not None else "skip").when(both, "delete" if matched == "delete" else "update" if matched else "keep").otherwise("keep")
        values = []
        for c, k in kinds.items():
            v = F.col(f"t.{c}")
            if matched and matched != "delete" and c in matched:
                v = F.when(both, F.expr(matched[c]).cast(k)).otherwise(v)
            if insert is not None:
                given = insert[c] if c in insert else self.defaults.get(c)
                v = F.when(fresh, F.expr(given).cast(k) if given else F.lit(None).cast(k)).otherwise(v)
            values.append(v.alias(c))
        out = materialize(j.select(*values, kind.alias("_kind"), "_t", *(F.col(f"t.{c}").alias(f"_old_{c}") for c in self._referred())).filter("_kind <> 'skip'"), self.name)
        if out.filter("_t IS NOT NULL").groupBy("_t").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("_kind") != "keep").cast("int")).alias("c")).filter("n > 1 AND c = 1").take(1):
            raise ConstraintError(f"{self.name}: two source rows match one row")
        changed = {k: out.filter(F.col("_kind") == k).select(*cols) for k in ("insert", "update", "delete")}
        untouched = out.filter("_kind = 'keep'").dropDuplicates(["_t"]).select(*cols)
        new = untouched.unionByName(changed["update"]).unionByName(changed["insert"])
        self._admit(changed["update"], user, "update")
        self._admit(changed["insert"], user, "insert")
        for k, rows in changed.items():
            self._fire("before", k, rows)
        self._verify(changed["update"].unionByName(changed["insert"]), untouched)
        referred = self._referred()
        gone = out.filter("_kind = 'delete'").select(*(F.col(f"_old_{c}") for c in referred))
        moved = out.filter("_kind = 'update'").select(*(F.col(f"_old_{c}") for c in referred), *(F.col(c).alias(f"_new_{c}") for c in referred))
        moves = isinstance(matched, dict) and bool(set(matched) & set(referred))
        if self.children:
            if matched == "delete":
                self._refused(gone, "on_delete")
            elif moves:
                self._refused(moved, "on_update")
        self.df = materialize(new, self.name)
        for k, rows in changed.items():
            self._log(k, rows)
        if self.children:
            if matched == "delete":
                self._cascade(gone, "on_delete")
            elif moves:
                self._cascade(moved, "on_update")
        for k, rows in changed.items():
            self._fire("after", k, rows)
        return out.filter("_kind <> 'keep'").select(*cols)

    def _seen_as(self, alias: str, user: str | None, command: str) -> Column:
        """_seen of the row under an alias of a join."""
        if not self.rls or user is None:
            return F.lit(True)
        row = self.df.columns
        out = F.lit(True)
        for p in self._applicable(user, command):
            if p.using:
                name = f"cast(unhex('{user.encode().hex()}') AS STRING)"
                words = [name if x.lower() in ("current_user", "current_role") else f"{alias}.{x}" if x in row else x for x in _LEXEMES.findall(p.using)]
                out = out & F.coalesce(F.expr("".join(words)), F.lit(False))
        return out

    def add_column(self, name: str, kind: str) -> None:
        self.df = self.df.withColumn(name, F.lit(None).cast(kind))


def number_rows(rows: DataFrame, column: str, above: int) -> DataFrame:
    """Fill nulls of column with consecutive numbers above `above`.

    Partitions are counted first, so the numbering needs no single task.
    """
    d = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    need = F.col(column).isNull()
    sizes = d.filter(need).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row a partition
    top = d.agg(F.max(column)).first()[0] or 0
    own = F.row_number().over(Window.partitionBy("_part", need).orderBy("_at"))
    return d.withColumn("_own", own).join(F.broadcast(base), "_part", "left").withColumn(column, F.when(need, F.lit(max(above, top)) + F.col("_base") + F.col("_own")).otherwise(F.col(column))).select(*rows.columns)


class Transaction:
    """The tables' snapshots, restored by rollback."""

    def __init__(self, *tables: Table):
        self.kept = [(t, t.df, list(t.changes)) for t in tables]

    def rollback(self) -> None:
        for t, df, changes in self.kept:
            t.df, t.changes = df, changes


class Sequences:
    """nextval and currval on the driver; currval before nextval is 0."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def nextval(self, name: str) -> int:
        self.at[name] = self.at.get(name, 0) + 1
        return self.at[name]

    def currval(self, name: str) -> int:
        return self.at.get(name, 0)


def predicate(text: str) -> Column:
    return F.coalesce(F.expr(text), F.lit(False))
