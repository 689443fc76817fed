"""Settings of a run: key=value files, JSON configuration with checks, model side files and the run folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from pathlib import Path

from tessera.operators.decode import sidecar_names

# Names of the files that may hold a model's class names, by ending of the model's own name or in its folder.
ENDINGS = (".names", ".labels")
BESIDE = ("class_name", "class_names", "class_name.txt", "class_names.txt", "classes.txt", "labels.txt", "data.yaml", "data.yml")
SECRET = ("key", "token", "secret", "password")


def env_file(text: str) -> dict[str, str]:
    """KEY=value lines; # comments, blank lines, `export` and one pair of quotes around a value go."""
    out = {}
    for line in text.splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#"):
            v = value.strip()
            out[key.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v
    return out


@dataclass
class Settings:
    """What a run needs; wrong values fail here, before any plan is built."""

    image: str = ""
    tile: int = 512
    overlap: int = 128
    confidence: float = 0.25
    iou: float = 0.35
    workers: int = 4
    max_tiles: int | None = None
    green_threshold: float = 0.35
    green_margin: float = 10.0
    bins: list[float] = field(default_factory=list)
    block: tuple[int, int] = (2, 2)
    weights: tuple[float, float] = (0.7, 0.3)
    canopy: float = 0.2
    breaks: tuple[float, float] = (0.33, 0.66)
    api_key: str = ""

    def __post_init__(self):
        self.block, self.weights, self.breaks = tuple(self.block), tuple(self.weights), tuple(self.breaks)
        shares = {"confidence": self.confidence, "canopy": self.canopy, "green_threshold": self.green_threshold}
        wrong = [k for k, v in shares.items() if not 0 <= v <= 1]
        wrong += ["tile"] * (self.tile < 1) + ["overlap"] * (not 0 <= self.overlap < self.tile) + ["iou"] * (not 0 < self.iou <= 1)
        wrong += ["workers"] * (self.workers < 1) + ["max_tiles"] * (self.max_tiles is not None and self.max_tiles < 1) + ["green_margin"] * (self.green_margin < 0)
        wrong += ["bins"] * (any(b <= 0 for b in self.bins) or sorted(set(self.bins)) != list(self.bins)) + ["block"] * (min(self.block) < 1)
        wrong += ["weights"] * (min(self.weights) < 0 or sum(self.weights) == 0) + ["breaks"] * (not 0 <= self.breaks[0] < self.breaks[1] <= 1)
        if wrong:
            raise ValueError(f"wrong settings: {', '.join(wrong)}")

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings that are named; names that there are not are an error."""
        given, known = json.loads(text), {f.name for f in fields(cls)}
        if extra := sorted(set(given) - known):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        return cls(**given)

    def to_json(self) -> str:
        """Secrets that are set come out as ***."""
        held = {k: "***" if v and any(s in k for s in SECRET) else v for k, v in asdict(self).items()}
        return json.dumps(held, indent=2, ensure_ascii=False)


def run_folder(root: str, settings: Settings, name: str = "", now: datetime | None = None) -> Path:
    """A run's folder with its configuration; log lines go to run_log.txt there by ``log``."""
    where = Path(root, name.strip() or (now or datetime.now()).strftime("run_%Y%m%d_%H%M%S"))
    where.mkdir(parents=True, exist_ok=True)
    (where / "run_config.json").write_text(settings.to_json(), encoding="utf-8")
    return where


def log(run: Path, line: str) -> None:
    with (run / "run_log.txt").open("a", encoding="utf-8") as out:
        out.write(line + "\n")


def class_names(model: str) -> list[str]:
    """Names from the first of a model's side files that holds any."""
    path = Path(model)
    for each in [*map(path.with_suffix, ENDINGS), *(path.parent / n for n in BESIDE)]:
        if each.is_file() and (names := sidecar_names(each.read_text(encoding="utf-8"))):
            return names
    return []


def input_size(model: str, default: int = 640) -> int:
    """The side of a model's input, by ``resolution`` or ``imgsz`` in environment.json beside it."""
    side = Path(model).parent / "environment.json"
    try:
        held = json.loads(side.read_text(encoding="utf-8")) if side.is_file() else {}
    except ValueError:
        held = {}
    found = next((held[k] for k in ("RESOLUTION", "resolution", "imgsz") if str(held.get(k, "")).isdigit()), default)
    return int(found)
