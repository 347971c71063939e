"""Capability registries in JSON files: a base, or an extension of a parent whose bytes must be the ones it names.

A file holds {version, capabilities}, or {version, extends, extends_sha256} with `capabilities` to add or
`replace_capability` to put in the place of one of its id. Files are small and read on the driver; a
registry is a table that joins broadcast after a look at its size.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.planner import REGISTRY

LISTS = ["target_names", "aliases", "required_slots", "optional_slots", "supported_modifiers", "supported_temporal_roles", "supported_reference_types", "required_policies"]
FIELDS = {"capability_id", "version", "action", "target_type", "provider_binding", "consequentiality", "confirmation_required", "execution_status", *LISTS}
EFFECTS = ("read", "write", "destructive")


def checked(raw: dict[str, Any]) -> dict[str, Any]:
    """A capability, or an error that says what is wrong with it; names are folded."""
    if set(raw) != FIELDS:
        raise ValueError(f"capability fields differ: {sorted(set(raw) ^ FIELDS)}")
    for k in LISTS:
        if not isinstance(raw[k], list) or not all(isinstance(x, str) and x for x in raw[k]):
            raise ValueError(f"{k} must be a list of words")
    rules = {
        "an id and target names are needed": raw["capability_id"] and raw["target_names"],
        "only contacting a person takes any name": "*" not in raw["target_names"] or (raw["target_type"], raw["action"]) == ("person", "contact"),
        "a capability is mock only": raw["execution_status"] == "mock_only",
        "an effect is read, write or destructive": raw["consequentiality"] in EFFECTS,
        "a slot is required or optional": not set(raw["required_slots"]) & set(raw["optional_slots"]),
        "reading needs no confirmation": not (raw["confirmation_required"] and raw["consequentiality"] == "read"),
    }
    for what, holds in rules.items():
        if not holds:
            raise ValueError(f"{raw['capability_id']}: {what}")
    return raw | {k: [x.casefold() for x in raw[k]] for k in ("target_names", "aliases")}


def load(path: str | Path) -> tuple[str, list[dict[str, Any]]]:
    """(version, capabilities) of a registry file and all it extends, however deep."""
    path = Path(path)
    raw = json.loads(path.read_text(encoding="utf-8"))
    own = [checked(x) for x in raw.get("capabilities", [])]
    if "extends" not in raw:
        if set(raw) != {"version", "capabilities"}:
            raise ValueError(f"{path.name} is no registry")
        found = own
    else:
        if set(raw) - {"version", "extends", "extends_sha256"} not in ({"capabilities"}, {"replace_capability"}) or Path(raw["extends"]).name != raw["extends"]:
            raise ValueError(f"{path.name} is no extension of a file beside it")
        parent = path.with_name(raw["extends"])
        if hashlib.sha256(parent.read_bytes()).hexdigest() != raw["extends_sha256"]:
            raise ValueError(f"{parent.name} isn't the file that {path.name} extends")
        found = load(parent)[1]
        if "replace_capability" in raw:
            new = checked(raw["replace_capability"])
            if [x["capability_id"] for x in found].count(new["capability_id"]) != 1:
                raise ValueError(f"{parent.name} has no single {new['capability_id']}")
            found = [new if x["capability_id"] == new["capability_id"] else x for x in found]
        found = found + own
    ids = [x["capability_id"] for x in found]
    if len(set(ids)) < len(ids):
        raise ValueError("a capability id repeats")
    return raw["version"], found


def table(spark: SparkSession, capabilities: list[dict[str, Any]]) -> DataFrame:
    """The capabilities as the planner's registry; '*' among the names takes any."""
    rows = [(c["capability_id"], c["action"], [c["target_type"]], [x for x in (*c["target_names"], *c["aliases"]) if x != "*"], c["required_slots"], c["optional_slots"], c["supported_temporal_roles"], c["supported_modifiers"], c["confirmation_required"]) for c in capabilities]
    return spark.createDataFrame(rows, REGISTRY)
