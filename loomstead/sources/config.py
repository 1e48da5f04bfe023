"""Settings from a JSON file, and the folder that a project begins at."""

from __future__ import annotations

import json
import os
from pathlib import Path

from loomstead.sources import git

# Settings with their defaults, and the files that mark a project's folder and the folder of several packages.
DEFAULTS = {"maxFileSizeBytes": 1 << 20, "maxFiles": 20_000, "followSymlinks": False, "redactSecrets": True, "git": True, "watch": True, "contextBudget": 6000, "maxContextFiles": 12, "ignore": []}
MARKERS = ("package.json", "pyproject.toml", "setup.py", "requirements.txt", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "composer.json", "Gemfile", ".git")
SHARED_MARKERS = ("pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "rush.json", "go.work")
STEPS, SHARED_STEPS = 64, 6


def read_config(text: str | None, defaults: dict | None = None) -> dict:
    """Settings of a JSON text over the defaults; a value of another type than its default, and a text that is no object, count for nothing."""
    base = dict(DEFAULTS if defaults is None else defaults)
    try:
        given = json.loads(text or "{}")
    except ValueError:
        return base
    if not isinstance(given, dict):
        return base
    fits = lambda a, b: type(a) is type(b) or (isinstance(a, float) and isinstance(b, int) and not isinstance(b, bool))
    return base | {k: v for k, v in given.items() if k in base and fits(base[k], v)}


def _is_shared(folder: Path) -> bool:
    if any((folder / name).exists() for name in SHARED_MARKERS):
        return True
    manifest = folder / "package.json"
    try:
        found = json.loads(manifest.read_text("utf-8")) if manifest.is_file() else {}
    except (OSError, ValueError):
        return False
    return isinstance(found, dict) and "workspaces" in found


def find_root(*, explicit: str | None = None, client_roots: list[str] = (), folder: str | None = None) -> str:
    """The folder a project begins at: the one that is given, else the first of the client's, else that of the working folder.

    From the working folder it is the top of the git tree, else the nearest folder above with a marker, and from there up to six folders
    further the one that holds several packages. The home folder and the root of the disk are refused.
    """
    start = Path(explicit or next(iter(client_roots), None) or folder or os.getcwd()).resolve()
    found = start
    if not explicit and not client_roots:
        top = git.top_level(str(start))
        if top:
            found = Path(top).resolve()
        else:
            found = next((at for at, _ in zip((start, *start.parents), range(STEPS)) if any((at / name).exists() for name in MARKERS)), start)
            found = next((at for at, _ in zip(found.parents, range(SHARED_STEPS)) if _is_shared(at)), found)
    if found == Path.home().resolve() or found == Path(found.anchor):
        raise ValueError(f"{found} is no project folder")
    return str(found)
