"""Schema evolution: differences, layer policies, alignment, fingerprints and contracts."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Which types widen to which without loss.
WIDENS = {
    "tinyint": ("smallint", "int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("bigint", "double", "string"),
    "bigint": ("double", "string"),
    "float": ("double",),
    "double": ("string",),
    "date": ("timestamp", "string"),
    "timestamp": ("string",),
}
#: Digits that integers need, for decimals to hold them.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
CONTROL_PREFIX = "_"


def widens(old: str, new: str, extra: tuple[str, ...] = ()) -> bool:
    """Whether old values fit new. extra: rules "a -> b". Decimals widen if neither places before nor after the point shrink."""
    if old == new or f"{old} -> {new}" in extra or new in WIDENS.get(old, ()):
        return True
    a, b = (re.fullmatch(r"decimal\((\d+),(\d+)\)", t) for t in (old, new))
    if b and old in DIGITS:
        return int(b[1]) - int(b[2]) >= DIGITS[old]
    return bool(a and b and int(b[2]) >= int(a[2]) and int(b[1]) - int(b[2]) >= int(a[1]) - int(a[2]))


@dataclass(frozen=True)
class Change:
    kind: str  # added, retyped or dropped
    column: str
    old: str | None = None
    new: str | None = None


def diff(incoming: StructType, existing: StructType, control: tuple[str, ...] = ()) -> list[Change]:
    """Changes from existing to incoming. Control columns (an underscore first, or named) do not count as dropped."""
    now, was = ({f.name: f.dataType.simpleString() for f in s} for s in (incoming, existing))
    found = [Change("added", c, None, t) for c, t in now.items() if c not in was]
    found += [Change("retyped", c, was[c], t) for c, t in now.items() if c in was and was[c] != t]
    found += [Change("dropped", c, t, None) for c, t in was.items() if c not in now and not c.startswith(CONTROL_PREFIX) and c not in control]
    return found


@dataclass(frozen=True)
class Policy:
    allowed: tuple[str, ...] = ("add", "widen", "drop", "narrow")
    on_drop: str = "null_fill_and_alert"
    on_narrow: str = "cast_and_alert"
    widen_rules: tuple[str, ...] = ()

    @staticmethod
    def for_classification(kind: str) -> Policy:
        """Personal data may only gain columns; other tables may also widen."""
        return Policy(allowed=("add",) if kind.lower() == "pii" else ("add", "widen"), on_drop="fail", on_narrow="fail")


BRONZE = Policy()
SILVER = Policy(allowed=("add", "widen"), on_drop="null_fill_and_alert", on_narrow="fail")


@dataclass
class Decision:
    """audit: (change_type, column, old, new, status). violations: what blocks the batch."""

    target: StructType
    audit: list[tuple] = field(default_factory=list)
    violations: list[Change] = field(default_factory=list)


def decide(incoming: StructType, existing: StructType, policy: Policy, control: tuple[str, ...] = ()) -> Decision:
    """The schema that the table will have, what happens to each change, and what is not allowed."""
    types = {f.name: f for f in existing}
    out = Decision(existing)
    for c in diff(incoming, existing, control):
        if c.kind == "added":
            act, status = "add", "applied"
        elif c.kind == "dropped":
            act, status = "drop", "graceful_null_fill" if policy.on_drop != "fail" else "blocked"
        elif widens(c.old, c.new, policy.widen_rules):
            act, status = "widen", "applied"
        elif widens(c.new, c.old, policy.widen_rules):
            act, status = "narrow", "implicit"  # narrower values fit the stored type
        else:
            act, status = "narrow", "graceful_cast" if policy.on_narrow != "fail" else "blocked"
        if status == "applied" and act not in policy.allowed:
            status = "blocked"
        if status == "blocked":
            out.violations.append(c)
        elif act in ("add", "widen"):
            types[c.column] = incoming[c.column]
        out.audit.append((act, c.column, c.old, c.new, status))
    out.target = StructType(list(types.values()))
    return out


def align(df: DataFrame, target: StructType, *, keep_extra: bool = False) -> DataFrame:
    """df in the columns, order and types of target: what it lacks is null, what differs in type is cast where possible."""
    kinds = dict(df.dtypes)
    columns = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in kinds and kinds[f.name] != f.dataType.simpleString() else F.col(f.name) if f.name in kinds else F.lit(None).cast(f.dataType).alias(f.name) for f in target]
    return df.select(*columns, *[c for c in df.columns if keep_extra and c not in target.names])


def evolve(df: DataFrame, existing: StructType, policy: Policy, control: tuple[str, ...] = ()) -> tuple[DataFrame | None, DataFrame | None, Decision]:
    """(batch to append, batch to quarantine, decision): one of the two is None."""
    said = decide(df.schema, existing, policy, control)
    if said.violations:
        facts = json.dumps([c.__dict__ for c in said.violations], sort_keys=True)
        return None, df.withColumn("_quarantine_reason", F.lit("schema change not allowed")).withColumn("_schema_diff", F.lit(facts)), said
    return align(df, said.target), None, said


def values_lost(df: DataFrame, target: StructType) -> DataFrame:
    """column, lost: values that a cast to target makes null, in one pass."""
    kinds = dict(df.dtypes)
    cast = [f for f in target if f.name in kinds and kinds[f.name] != f.dataType.simpleString()]
    if not cast:
        return df.sparkSession.createDataFrame([], "column string, lost long")
    once = df.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in cast])
    return once.select(F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("lost")) for f in cast])).alias("r")).select("r.*")


def apply_type_overrides(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in overrides.items() if c in df.columns})


def apply_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Renames incoming names to canonical ones, where the canonical one is not there already."""
    return df.withColumnsRenamed({a: c for a, c in aliases.items() if a in df.columns and c not in df.columns})


def fingerprint(schema: StructType) -> str:
    said = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in schema))
    return hashlib.sha256(said.encode()).hexdigest()[:16]


def unchanged(incoming: StructType, stored_fingerprint: str | None, existing: StructType) -> bool:
    """Whether the difference need not be looked for: the fingerprint is known and the table has every column."""
    return fingerprint(incoming) == stored_fingerprint and set(incoming.names) <= set(existing.names)


SCHEMA_HISTORY = "table_name string, generation long, batch string, fingerprint string, fields array<struct<name: string, type: string>>, recorded_at timestamp"


def history_row(said: StructType, table: str, generation: int, batch: str, at) -> tuple:
    """A row of SCHEMA_HISTORY, as plain values: how a table's landed batch looked. Control columns are left out."""
    own = [f for f in said if not f.name.startswith(CONTROL_PREFIX)]
    return (table, generation, batch, fingerprint(StructType(own)), [(f.name, f.dataType.simpleString()) for f in own], at)


def generation_changes(history: DataFrame) -> DataFrame:
    """table_name, generation, change (new, removed or retyped), field, old, new: what each generation of a schema history
    changes of the one before it. A generation whose fingerprint is the one before has no rows, nor has the first one."""
    before = Window.partitionBy("table_name").orderBy("generation")
    rows = history.withColumns({"_was": F.lag("fields").over(before), "_print": F.lag("fingerprint").over(before)}).filter("_was IS NOT NULL AND fingerprint <> _print")
    name = lambda fs: F.transform(fs, lambda f: f["name"])
    now, was = F.col("fields"), F.col("_was")
    change = lambda kind, f, old, new: F.struct(F.lit(kind).alias("change"), f["name"].alias("field"), old.alias("old"), new.alias("new"))
    nothing = F.lit(None).cast("string")
    added = F.transform(F.filter(now, lambda f: ~F.array_contains(name(was), f["name"])), lambda f: change("new", f, nothing, f["type"]))
    gone = F.transform(F.filter(was, lambda f: ~F.array_contains(name(now), f["name"])), lambda f: change("removed", f, f["type"], nothing))
    old_type = lambda f: F.filter(was, lambda g: g["name"] == f["name"])[0]["type"]
    kept = F.filter(now, lambda f: F.exists(was, lambda g: (g["name"] == f["name"]) & (g["type"] != f["type"])))
    retyped = F.transform(kept, lambda f: change("retyped", f, old_type(f), f["type"]))
    return rows.select("table_name", "generation", F.inline(F.concat(added, gone, retyped)))


AUDIT = "table_name string, layer string, change_type string, column_name string, old_type string, new_type string, status string, run_id string, recorded_at timestamp"


def audit_rows(spark: SparkSession, said: Decision, table: str, layer: str, run_id: str, at) -> DataFrame:
    return spark.createDataFrame(audit_tuples(said, table, layer, run_id, at), AUDIT)


def audit_tuples(said: Decision, table: str, layer: str, run_id: str, at) -> list[tuple]:
    """Rows of AUDIT, as plain values."""
    return [(table, layer, act, c, old, new, status, run_id, at) for act, c, old, new, status in said.audit]


def drift_report(audit: DataFrame, repeated: int = 3) -> DataFrame:
    """table_name, changes, blocked, severity, repeated_drift."""
    rank = F.max(F.when(F.col("status") == "blocked", 2).when(F.col("status").startswith("graceful"), 1).otherwise(0))
    out = audit.groupBy("table_name").agg(F.count("*").alias("changes"), F.count_if(F.col("status") == "blocked").alias("blocked"), rank.alias("_rank"))
    names = F.element_at(F.array(F.lit("INFO"), F.lit("WARNING"), F.lit("CRITICAL")), F.col("_rank") + 1)
    return out.select("table_name", "changes", "blocked", names.alias("severity"), (F.col("changes") >= repeated).alias("repeated_drift"))


def check_contract(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """df, if it has all required columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the contract needs columns {missing}")
    return df


@dataclass(frozen=True)
class Contract:
    """What consumers rely on. required columns are there, of their type and never null; optional ones may lack; key is unique."""

    version: str
    required: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)
    key: tuple[str, ...] = ()


def contract_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """column, problem (missing, type, null or repeated), rows: what of a table breaks its contract, null rows where all do.

    A type that widens to the contract's is none. Nulls are counted in one pass; the key in one aggregation.
    """
    kinds, spark = dict(df.dtypes), df.sparkSession
    said = [(c, "missing", None) for c in contract.required if c not in kinds]
    said += [(c, "type", None) for c, t in (contract.required | contract.optional).items() if c in kinds and not widens(kinds[c], t)]
    out = spark.createDataFrame(said, "column string, problem string, rows long")
    there = [c for c in contract.required if c in kinds]
    if there:
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in there])
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("null").alias("problem"), F.col(c).alias("rows")) for c in there])
        out = out.unionByName(nulls.select(F.inline(rows)).filter("rows > 0"))
    if contract.key and set(contract.key) <= set(kinds):
        again = df.groupBy(*contract.key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.sum("n").alias("rows"))
        out = out.unionByName(again.filter("rows > 0").select(F.lit(",".join(contract.key)).alias("column"), F.lit("repeated").alias("problem"), "rows"))
    return out


def version_bump(old: StructType, new: StructType, required: tuple[str, ...] = ()) -> str:
    """major: a column goes, narrows or becomes required; minor: a column comes or widens; patch: neither."""
    found = diff(new, old)
    if any(c.kind == "dropped" or c.kind == "retyped" and not widens(c.old, c.new) or c.kind == "added" and c.column in required for c in found):
        return "major"
    return "minor" if found else "patch"
