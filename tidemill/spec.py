"""Table specifications: what a dataset's columns, keys, rules and policies are."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class DqRules:
    """Rules by kind; those over one column list columns, the others map columns to their limits."""

    not_null: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted_values: dict[str, list] = field(default_factory=dict)
    range: dict[str, tuple] = field(default_factory=dict)
    format: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TableSpec:
    table: str
    primary_key: tuple[str, ...]
    source_format: str = "json"
    is_cdc: bool = False
    dedup_order_by: str | None = None
    hash_fields: tuple[str, ...] = ()
    dq_rules: DqRules = DqRules()
    masking: dict[str, str] = field(default_factory=dict)
    pii_fields: tuple[str, ...] = ()
    event_time_column: str | None = None
    late_arrival_window_days: int = 7
    type_overrides: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    schema_policy: dict[str, dict] = field(default_factory=dict)
    record_filter: str | None = None
    buckets: int = 8
    contract_version: str = "1.0.0"

    @staticmethod
    def from_dict(said: dict[str, Any]) -> TableSpec:
        """A spec from plain data. Unknown keys are refused, so that a misspelt rule does not go unnoticed."""
        own = dict(said)
        unknown = set(own) - {f.name for f in fields(TableSpec)}
        if unknown:
            raise ValueError(f"{own.get('table')}: unknown keys {sorted(unknown)}")
        if isinstance(own["primary_key"], str):
            own["primary_key"] = (own["primary_key"],)
        own["dq_rules"] = DqRules(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.get("dq_rules", {}).items()})
        return TableSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})


@dataclass(frozen=True)
class ScdSpec:
    table: str
    scd_type: int
    primary_key: tuple[str, ...]
    tracked_columns: tuple[str, ...]
    metadata_columns: tuple[str, ...] = ()
    history_table: str | None = None


def load_specs(folder: str) -> dict[str, TableSpec]:
    """A spec for each .json or .yaml file in a folder; a bad file is logged and left out."""
    found = {}
    for path in sorted(Path(folder).iterdir()):
        if path.suffix not in (".json", ".yaml", ".yml"):
            continue
        try:
            text = path.read_text()
            if path.suffix == ".json":
                said = json.loads(text)
            else:
                import yaml

                said = yaml.safe_load(text)
            spec = TableSpec.from_dict(said)
            found[spec.table] = spec
        except Exception as e:  # noqa: BLE001
            log.warning("%s is no table specification: %s", path, e)
    return found
