"""Source descriptors: configuration of one source, read on the driver and checked."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarry import schemas

REQUIRED = ("source_id", "source_type", "display_name", "owner", "rights_policy")
DEFAULTS = {"visibility": "private", "refresh_policy": "manual", "adapter_version": "unversioned"}


def descriptor(values: dict) -> dict:
    """Checked, with defaults; keys that are not fields go into `configuration`."""
    fields = {*REQUIRED, *DEFAULTS, "configuration"}
    out = {**DEFAULTS, **{k: v for k, v in values.items() if k in fields}}
    out["configuration"] = {**(values.get("configuration") or {}), **{k: v for k, v in values.items() if k not in fields}}
    if absent := [k for k in REQUIRED if not out.get(k)]:
        raise ValueError(f"a source descriptor needs {', '.join(absent)}")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._:/-]{0,99}", out["source_id"]):
        raise ValueError(f"{out['source_id']!r} is no source id")
    for key in ("source_type", "visibility", "refresh_policy", "rights_policy"):
        if out[key] not in schemas.ALLOWED[key]:
            raise ValueError(f"{out[key]!r} is no {key}")
    return out


def load_descriptor(path: str) -> dict:
    """From a YAML or JSON file."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith((".yaml", ".yml")):
        import yaml  # only needed here

        return descriptor(yaml.safe_load(raw))
    return descriptor(json.loads(raw))


def as_row(spark: SparkSession, d: dict) -> DataFrame:
    names = [x.split()[0] for x in schemas.SOURCES.split(", ")]
    return spark.createDataFrame([tuple(json.dumps(d[n]) if n == "configuration" else d[n] for n in names)], schemas.SOURCES)
