"""Severity, track kinds, presets and targets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and numbers that results have to agree on. Order matters in SEVERITY_OF.
WEIGHTS = {"critical": 10, "high": 6, "medium": 3, "low": 1}
SEVERITY_OF = [
    ("passport", "critical"), ("credit card", "critical"), ("credit card number", "critical"), ("ssn", "critical"), ("driver license", "critical"), ("id card", "critical"),
    ("face", "high"), ("person", "high"), ("email", "high"), ("phone number", "high"), ("house number", "high"), ("code", "high"),
    ("license plate", "medium"), ("screen", "medium"), ("name badge", "medium"), ("street sign", "medium"), ("document", "medium"), ("mailbox", "medium"), ("lanyard", "medium"),
    ("gps location", "high"), ("gps coordinates", "high"), ("creation time", "medium"), ("device info", "medium"), ("title and description", "medium"), ("embedded text", "medium"), ("software", "low"),
]
DEFAULT_SEVERITY = "medium"
DEFAULT_TARGETS = ["person", "face", "license plate", "screen"]
PRESETS = [
    ("family", ["person", "face", "license plate", "screen"], "blur", 31, 14, 6),
    ("street", ["person", "face", "license plate"], "pixelate", 18, 16, 6),
    ("documents", ["passport", "credit card", "driver license", "id card", "document", "name badge", "lanyard"], "blur", 41, 12, 6),
    ("location", ["street sign", "house number", "license plate", "mailbox"], "blur", 35, 14, 6),
    ("screen-share", ["screen", "face"], "blur", 35, 8, 3),
]
CHOICES = {"mode": ("blur", "pixelate", "replace"), "audio": ("keep", "mute", "pitch"), "backend": ("api", "hosted", "local"), "provider": ("sam", "grounding-sam", "yunet", "owlv2")}
REMOTE_PROVIDER, LOCAL_PROVIDERS = "sam", ("grounding-sam", "yunet", "owlv2")
OPTION_DEFAULTS = {"mode": "blur", "strength": 21, "mask_margin": 10, "carry_frames": 4}


def severity(name: Column) -> Column:
    """The first name in order that stands inside the kind decides; medium if none does."""
    low = F.lower(name)
    out = None
    for key, level in SEVERITY_OF:
        out = F.when(F.contains(low, F.lit(key)), level) if out is None else out.when(F.contains(low, F.lit(key)), level)
    return out.otherwise(DEFAULT_SEVERITY)


def weight(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), level)


def kind_of(track_key: Column) -> Column:
    """pii:<kind>:<n> is of that kind; any other key of what stands before the first colon."""
    parts = F.split(track_key, ":")
    return F.when((parts[0] == "pii") & (F.size(parts) >= 2), F.get(parts, F.lit(1))).otherwise(parts[0])


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, targets array<string>, mode string, strength int, mask_margin int, carry_frames int")


def apply_preset(options: DataFrame) -> DataFrame:
    """Options that still have their default take the preset's value; targets always do.

    An unknown preset leaves ``targets`` null, which callers report. The preset table has five rows.
    """
    p = F.broadcast(presets(options.sparkSession).withColumnsRenamed({k: f"_{k}" for k in ("targets", *OPTION_DEFAULTS)}))
    out = options.join(p, "preset", "left")
    changed = {k: F.when((F.col(k) == F.lit(v)) & F.col(f"_{k}").isNotNull(), F.col(f"_{k}")).otherwise(F.col(k)) for k, v in OPTION_DEFAULTS.items()}
    return out.withColumns({**changed, "targets": F.col("_targets")}).drop(*[f"_{k}" for k in ("targets", *OPTION_DEFAULTS)])


def split_targets(text: Column) -> Column:
    """Names between commas or semicolons, trimmed; null if there are none."""
    found = F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found)


def resolve_targets(targets: Column, added: Column, use_defaults: Column) -> Column:
    """Added targets come after the defaults; named targets replace them unless they are asked for."""
    defaults = F.array(*[F.lit(x) for x in DEFAULT_TARGETS])
    none = F.array().cast("array<string>")
    t, a = F.coalesce(targets, none), F.coalesce(added, none)
    return F.when(F.size(a) > 0, F.array_distinct(F.concat(defaults, a, t))).when((F.size(t) > 0) & use_defaults, F.array_distinct(F.concat(defaults, t))).when(F.size(t) > 0, t).otherwise(defaults)


def check_options(options: dict, known: Iterable[str]) -> dict:
    """Driver-side: unknown names and values out of range are errors."""
    unknown = sorted(set(options) - set(known))
    if unknown:
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    for name, allowed in CHOICES.items():
        if options.get(name) is not None and options[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    for name in ("strength", "pitch_factor"):
        if options.get(name, 1) <= 0:
            raise ValueError(f"{name} must be positive")
    for name in ("mask_margin", "carry_frames", "total_frames", "margin"):
        if options.get(name, 0) < 0:
            raise ValueError(f"{name} must not be negative")
    provider, backend = options.get("provider"), options.get("backend")
    here = bool(options.get("local")) or backend == "local" or provider in LOCAL_PROVIDERS
    if backend not in (None, "local") and here:
        raise ValueError(f"what runs locally takes no backend {backend}")
    if provider == REMOTE_PROVIDER and backend == "local":
        raise ValueError(f"provider {provider} is remote: name backend api or hosted, or a local provider")
    if options.get("location_audit") and here:
        raise ValueError("a location estimate needs a remote model, and these options promise a local run")
    return options
