"""Settings, kept as JSON on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Names and path segments that are left out of scans, on every system and on some.
EVERYWHERE = (
    ".git .hg .svn node_modules bower_components .npm .yarn .pnpm-store .next .nuxt .angular .parcel-cache .turbo .venv venv virtualenv __pycache__ .tox .nox "
    ".mypy_cache .pytest_cache .ruff_cache .ipynb_checkpoints site-packages __pypackages__ .eggs .conda anaconda3/envs anaconda3/pkgs miniconda3/envs miniconda3/pkgs "
    "mambaforge/envs mambaforge/pkgs .docker .gradle .m2 .nuget .terraform .bundle .ccache"
).split()
ON_WINDOWS = (
    "$Recycle.Bin",
    "System Volume Information",
    "\\Windows\\WinSxS",
    "\\Windows\\servicing",
    "\\Windows\\SoftwareDistribution",
    "\\AppData\\Local\\Temp",
    "\\AppData\\Local\\Microsoft\\Windows\\INetCache",
    "\\AppData\\Local\\npm-cache",
    "\\AppData\\Local\\pip",
    "\\.cargo\\registry",
    "\\.rustup\\toolchains",
)
ELSEWHERE = "/proc /sys /dev /run /snap .cache /.cargo/registry /.rustup/toolchains .local/share/Trash".split()


def default_exclusions(system: str = os.name) -> list[str]:
    """What a scan leaves out unless told otherwise; ``system`` as ``os.name``."""
    return [*EVERYWHERE, *(ON_WINDOWS if system == "nt" else ELSEWHERE)]


DEFAULT_EXCLUSIONS = tuple(default_exclusions())


def default_roots() -> list[str]:
    """Drive letters on Windows, the home folder elsewhere."""
    if os.name == "nt":
        return [f"{c}:\\" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if os.path.exists(f"{c}:\\")]
    home = os.path.expanduser("~")
    return [home if home != "~" else "/"]


@dataclass
class Settings:
    roots: list[str] = field(default_factory=default_roots)
    exclusions: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUSIONS))
    match_mode: str = "Substring"
    case_sensitive: bool = False
    max_results: int = 1_000
    watch_filesystem: bool = True
    auto_rescan_time: str = ""

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Missing fields get their defaults; a file that cannot be read gives the defaults."""
        try:
            found = json.loads(Path(path).read_text(encoding="utf-8"))
            return cls(**{f.name: found[f.name] for f in fields(cls) if f.name in found})
        except (OSError, ValueError, TypeError):
            return cls()

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2), encoding="utf-8")

    def checked(self) -> Settings:
        """The same within the ranges that a user may choose."""
        kept = {f.name: getattr(self, f.name) for f in fields(self)}
        return Settings(**kept | {"max_results": min(100_000, max(100, self.max_results))})
