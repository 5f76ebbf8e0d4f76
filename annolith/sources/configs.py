"""Strict configurations: exactly the keys that are known, values of the right kind and in range, constants as they must be."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The modes of a policy, their constraints and the order in which ties are broken.
MODES = ("high_precision", "balanced", "high_recall")
CONSTRAINTS = ("min_precision", "max_fp_per_image", "max_overall_fp_per_image")
TIE_BREAK = ("higher_precision", "lower_overall_fp", "lower_target_fp", "higher_threshold")


def mapping(path: str | Path) -> dict[str, Any]:
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def exactly(given: dict, keys: set[str], what: str) -> None:
    if set(given) != keys:
        raise ValueError(f"{what}: missing {sorted(keys - set(given))}, unknown {sorted(map(str, set(given) - keys))}")


def number(value: Any, name: str, least: float = 0.0, most: float = math.inf, whole: bool = False) -> float:
    """A finite number in range; truth values are no numbers."""
    if isinstance(value, bool) or not isinstance(value, int if whole else int | float) or not math.isfinite(value) or not least <= value <= most:
        raise ValueError(f"{name} must be a{' whole' if whole else ''} number from {least} to {most}, not {value!r}")
    return value


@dataclass(frozen=True)
class RunConfig:
    """A run's configuration.  ``constants``: values that a run of this kind must have."""

    experiment: str
    data: str
    model: str
    image_size: int
    epochs: int
    patience: int
    seed: int
    deterministic: bool
    device: str
    workers: int
    cache: bool
    pretrained: bool
    batch: float
    smoke_epochs: int
    smoke_fraction: float

    @classmethod
    def load(cls, path: str | Path, overrides: dict[str, Any] | None = None, constants: dict[str, Any] | None = None, may_override: tuple[str, ...] = ("device", "workers", "batch")) -> RunConfig:
        given = mapping(path)
        exactly(given, {f.name for f in fields(cls)}, str(path))
        wanted = {k: v for k, v in (overrides or {}).items() if v is not None}
        if foreign := sorted(set(wanted) - set(may_override)):
            raise ValueError(f"cannot be overridden: {', '.join(foreign)}")
        given |= wanted
        for name in ("epochs", "smoke_epochs"):
            number(given[name], name, 1, 2 if name == "smoke_epochs" else math.inf, whole=True)
        for name in ("patience", "seed", "workers"):
            number(given[name], name, whole=True)
        number(given["image_size"], "image_size", 1, whole=True)
        number(given["batch"], "batch", -1)
        if number(given["smoke_fraction"], "smoke_fraction", 0, 1) == 0:
            raise ValueError("smoke_fraction must be above 0")
        for name in ("deterministic", "cache", "pretrained"):
            if not isinstance(given[name], bool):
                raise ValueError(f"{name} must be true or false")
        for name in ("experiment", "data", "model", "device"):
            given[name] = str(given[name])
            if not given[name]:
                raise ValueError(f"{name} must not be empty")
        for name, value in (constants or {}).items():
            if type(given[name]) is not type(value) or given[name] != value:
                raise ValueError(f"{name} must be {value!r}")
        return cls(**given)


@dataclass(frozen=True)
class Policy:
    """Constraints of each mode on exploratory operating points of an open split."""

    split: str
    label: str
    target: str
    same_cost: int
    modes: dict[str, dict[str, float]]

    @classmethod
    def load(cls, path: str | Path, allowed: tuple[str, ...] = ("valid",)) -> Policy:
        from annolith.sources.tables import require_split

        given = mapping(path)
        require_split(given.get("split"), allowed)
        exactly(given, {"schema_version", "split", "label", "target", "objective", "production", "tie_break", "same_cost", "modes"}, str(path))
        for name, value in {"schema_version": 1, "objective": "maximize_recall", "production": False, "tie_break": list(TIE_BREAK)}.items():
            if type(given[name]) is not type(value) or given[name] != value:
                raise ValueError(f"{name} must be {value!r}")
        number(given["same_cost"], "same_cost", whole=True)
        if not isinstance(given["modes"], dict):
            raise ValueError("modes must be a mapping")
        exactly(given["modes"], set(MODES), "modes")
        modes = {}
        for mode, scenario in given["modes"].items():
            exactly(scenario, {"rationale", "constraints"}, mode)
            if not scenario["rationale"]:
                raise ValueError(f"{mode} needs a rationale")
            exactly(scenario["constraints"], set(CONSTRAINTS), mode)
            modes[mode] = {k: float(number(v, f"{mode} {k}", 0, 1 if k == "min_precision" else math.inf)) for k, v in scenario["constraints"].items()}
        return cls(given["split"], str(given["label"]), str(given["target"]), given["same_cost"], modes)

    def rows(self, spark: SparkSession) -> DataFrame:
        """mode and its constraints, one row each."""
        return spark.createDataFrame([(m, *[self.modes[m][c] for c in CONSTRAINTS]) for m in MODES], "mode string, " + ", ".join(f"{c} double" for c in CONSTRAINTS))


def foundation_checks(spark: SparkSession, config: str, root: str, counts: dict[str, int], files: tuple[str, ...] = ()) -> DataFrame:
    """check, passed, detail: root, configuration, files, and for each split its folders and number of images.  Nothing is changed or repaired."""
    from annolith.sources.tables import images as image_files
    from annolith.sources.tables import raw_config

    found: list[tuple[str, bool, str]] = [("root", Path(root).is_dir(), root), ("configuration", Path(config).is_file(), config)]
    found += [(f"file {f}", (Path(root) / f).is_file(), f) for f in files]
    try:
        names = raw_config(config, root).names
        found.append(("classes", True, ", ".join(f"{k} = {v}" for k, v in sorted(names.items()))))
    except (OSError, ValueError, KeyError, TypeError) as e:
        found.append(("classes", False, str(e)))
    for split, wanted in counts.items():
        images, labels = Path(root) / split / "images", Path(root) / split / "labels"
        there = images.is_dir() and labels.is_dir()
        found.append((f"{split} folders", there, str(images.parent)))
        n = image_files(spark, f"file://{images.resolve()}").count() if images.is_dir() and any(images.iterdir()) else 0
        found.append((f"{split} images", images.is_dir() and n == wanted, f"{n} of {wanted}"))
    return spark.createDataFrame(found, "check string, passed boolean, detail string")
