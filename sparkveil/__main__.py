"""``python -m sparkveil audit|redact|doctor`` on Parquet tables; exit 0, 1 (findings) or 2 (error)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import api
from .functions import lookups
from .operators import summary

TABLES = {"audit": ("texts", "detections", "transcript", "tags", "ocr", "codes", "media", "errors"), "redact": ("texts", "detections", "ocr", "codes")}
PRESET_OPTIONS = ("mode", "strength", "mask_margin", "carry_frames")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkveil")
    p.add_argument("command", choices=("audit", "redact", "doctor"))
    for name in dict.fromkeys(n for names in TABLES.values() for n in names):
        p.add_argument(f"--{name}", metavar="PARQUET")
    p.add_argument("--out", help="folder for the results, one Parquet table each")
    for name in ("total-frames", "carry-frames", "mask-margin", "width", "height", "strength", "every"):
        p.add_argument(f"--{name}", type=int)
    for name in ("margin", "fps", "pitch-factor"):
        p.add_argument(f"--{name}", type=float)
    for name in ("mode", "audio", "backend", "provider"):
        p.add_argument(f"--{name}", choices=lookups.CHOICES[name])
    for name in ("keep", "exclude", "target", "add-target"):
        p.add_argument(f"--{name}", action="append")
    for name in ("local", "location-audit", "targets-default"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    p.add_argument("--preset", choices=[n for n, *_ in lookups.PRESETS])
    p.add_argument("--kind", choices=("video", "photo", "audio"), help="a photo is one frame, a recording has none")
    p.add_argument("--fail-on", choices=summary.LEVELS)
    return p


def options(a: dict, spark: SparkSession) -> dict:
    """What was given, with the values that a preset adds; targets are resolved as phrases."""
    o = {k: v for k, v in a.items() if v is not None}
    preset, target, more, defaults = (o.pop(k, None) for k in ("preset", "target", "add_target", "targets_default"))
    if preset:
        name, targets, *values = next(row for row in lookups.PRESETS if row[0] == preset)
        target = target or targets
        for key, value in zip(PRESET_OPTIONS, values, strict=True):
            if o.get(key, lookups.OPTION_DEFAULTS[key]) == lookups.OPTION_DEFAULTS[key]:
                o[key] = value
    if target or more or defaults:
        from pyspark.sql import functions as F

        names = lambda x: F.lit(",".join(x)) if x else F.lit(None).cast("string")
        both = lookups.resolve_targets(lookups.split_targets(names(target)), lookups.split_targets(names(more)), F.lit(bool(defaults)))
        o["targets"] = list(spark.range(1).select(both.alias("t")).first()["t"])
    return o


def _only(df: DataFrame, targets: list[str] | None) -> DataFrame:
    """Tracks of the phrases that are asked for; finds in texts and codes are always kept."""
    from pyspark.sql import functions as F

    if targets is None or "track_key" not in df.columns:
        return df
    return df.where(F.split("track_key", ":")[0].isin(*targets, "pii", "code"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = vars(_parser().parse_args(argv))
    command, out = a.pop("command"), a.pop("out")
    spark = spark or SparkSession.builder.appName("sparkveil").getOrCreate()
    try:
        if command == "doctor":
            found = api.doctor(spark)
            found.show(truncate=False)
            return 2 if found.where("area = 'core' and not ok").count() else 0
        if not out:
            raise ValueError("--out names the folder for the results")
        paths = {n: a.pop(n) for names in TABLES.values() for n in names if n in a}
        o = options(a, spark)
        targets = o.pop("targets", None)
        tables = {n: _only(spark.read.parquet(paths[n]), targets) for n in TABLES[command] if paths.get(n)}
        if command == "redact":
            o.pop("kind", None)
            o.pop("fail_on", None)
        found = getattr(api, command)(**tables, **o)
        for name, df in found.items():
            df.write.mode("errorifexists").parquet(f"{out.rstrip('/')}/{name}")
        return int(spark.read.parquet(f"{out.rstrip('/')}/gate").first()["exit_code"]) if "gate" in found else 0
    except Exception as e:  # the exit code is the result that callers read
        print(f"sparkveil: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
