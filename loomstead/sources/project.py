"""What a project is: frameworks, languages, package manager, path aliases and workspace packages."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (framework, priority, dependencies, files, words in a file) that tell a framework.
FRAMEWORKS = [
    ("Next.js", 100, ["next"], ["next.config.js", "next.config.ts", "next.config.mjs"], {}),
    ("Nuxt", 100, ["nuxt", "nuxt3"], ["nuxt.config.ts", "nuxt.config.js"], {}),
    ("Expo", 95, ["expo"], [], {"app.json": '"expo"'}),
    ("React Native", 90, ["react-native"], [], {}),
    ("Angular", 90, ["@angular/core"], ["angular.json"], {}),
    ("NestJS", 90, ["@nestjs/core"], [], {}),
    ("SvelteKit", 90, ["@sveltejs/kit"], [], {}),
    ("Remix", 90, ["@remix-run/react", "@remix-run/node"], [], {}),
    ("Astro", 90, ["astro"], [], {}),
    ("Vue", 70, ["vue"], [], {}),
    ("Svelte", 70, ["svelte"], [], {}),
    ("React", 60, ["react"], [], {}),
    ("Express", 60, ["express"], [], {}),
    ("Fastify", 60, ["fastify"], [], {}),
    ("Django", 100, [], ["manage.py"], {"requirements.txt": "django", "pyproject.toml": "django"}),
    ("FastAPI", 100, [], [], {"requirements.txt": "fastapi", "pyproject.toml": "fastapi"}),
    ("Flask", 90, [], [], {"requirements.txt": "flask", "pyproject.toml": "flask"}),
    ("Laravel", 100, [], ["artisan"], {}),
    ("Flutter", 100, [], [], {"pubspec.yaml": "flutter"}),
]
LANGUAGE_MARKERS = {
    "TypeScript": ["tsconfig.json", "tsconfig.base.json"], "JavaScript": ["package.json", "jsconfig.json"],
    "Python": ["pyproject.toml", "requirements.txt", "Pipfile", "setup.py", "setup.cfg"], "Go": ["go.mod"], "Rust": ["Cargo.toml"],
    "Java": ["pom.xml", "build.gradle", "build.gradle.kts"], "PHP": ["composer.json"], "Ruby": ["Gemfile"], "Dart": ["pubspec.yaml"], "C#": ["global.json"],
}
LOCKFILES = [
    ("pnpm-lock.yaml", "pnpm"), ("bun.lockb", "bun"), ("yarn.lock", "yarn"), ("package-lock.json", "npm"), ("uv.lock", "uv"), ("poetry.lock", "poetry"), ("Pipfile.lock", "pipenv"),
    ("requirements.txt", "pip"), ("Cargo.lock", "cargo"), ("go.sum", "go"), ("composer.lock", "composer"), ("Gemfile.lock", "bundler"), ("pubspec.lock", "pub"),
]


def _holds(files: Column, name: str) -> Column:
    return F.array_contains(F.map_keys(files), name)


def _depends(files: Column, package: str) -> Column:
    found = F.lit(False)
    for group in ("dependencies", "devDependencies", "peerDependencies"):
        found = found | F.coalesce(F.get_json_object(files["package.json"], f"$.{group}['{package}']").isNotNull(), F.lit(False))
    return found


def detect(manifests: DataFrame) -> DataFrame:
    """``(project_id, framework, frameworks, languages, package_manager)`` from root files ``(project_id, name, content)``.

    Frameworks come by priority, the order of the table breaks ties; a declared package manager wins over lock files.
    """
    files = F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("content", F.lit("")))))
    own = manifests.dropDuplicates(["project_id", "name"]).groupBy("project_id").agg(files.alias("f"))
    f = F.col("f")
    hits = []
    for k, (name, priority, packages, marks, words) in enumerate(FRAMEWORKS):
        told = F.lit(False)
        for package in packages:
            told = told | _depends(f, package)
        for mark in marks:
            told = told | _holds(f, mark)
        for file, word in words.items():
            told = told | F.coalesce(F.lower(f[file]).contains(word.lower()), F.lit(False))
        hits.append(F.when(told, F.struct(F.lit(-priority).alias("p"), F.lit(k).alias("k"), F.lit(name).alias("name"))))
    frameworks = F.transform(F.array_sort(F.array_compact(F.array(*hits))), lambda x: x["name"])
    languages = F.array_compact(F.array(*[F.when(F.arrays_overlap(F.map_keys(f), F.array(*map(F.lit, marks))), name) for name, marks in LANGUAGE_MARKERS.items()]))
    declared = F.regexp_extract(F.get_json_object(f["package.json"], "$.packageManager"), "^([^@]+)", 1)
    locked = F.coalesce(*[F.when(_holds(f, file), name) for file, name in LOCKFILES], F.when(_holds(f, "package.json"), "npm"))
    return own.select(
        "project_id", F.get(frameworks, F.lit(0)).alias("framework"), frameworks.alias("frameworks"), languages.alias("languages"),
        F.coalesce(F.when(declared != "", declared), locked).alias("package_manager"),
    )


def fingerprint(package: Column, folder: Column, markers: Column) -> Column:
    """Identity of a project without remote or commits: package name, folder name and sorted markers."""
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.coalesce(package, F.lit(""))), F.lower(folder), F.array_join(F.array_sort(markers), ",")), 256), 1, 24)


def _relaxed(text: str) -> dict:
    """JSON with comments and trailing commas; an empty object where it cannot be read."""
    bare = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    try:
        found = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare))
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def path_aliases(files: dict[str, str]) -> list[tuple[str, str]]:
    """``(prefix, folder)`` pairs of the first configuration that names paths; ``@/*`` to ``src/*`` is ``("@/", "src/")``."""
    for name in ("tsconfig.json", "tsconfig.base.json", "jsconfig.json"):
        options = _relaxed(files.get(name, "")).get("compilerOptions") or {}
        if paths := options.get("paths"):
            base = options.get("baseUrl") or "."
            found = []
            for alias, targets in paths.items():
                if targets:
                    target = posixpath.normpath(posixpath.join(base, targets[0].removesuffix("*") or "."))
                    found.append((alias.removesuffix("*"), "" if target == "." else target + ("/" if targets[0].endswith("*") else "")))
            return found
    return []


def workspace_packages(files: dict[str, str]) -> list[tuple[str, str]]:
    """``(package name, folder)`` of the members of a monorepo; ``files`` has all manifests by relative path."""
    globs: list[str] = []
    inside = False
    for line in files.get("pnpm-workspace.yaml", "").splitlines():
        if re.match(r"packages\s*:", line):
            inside = True
        elif inside and (m := re.match(r"\s*-\s*[\"']?([^\"'#\s]+)", line)):
            globs.append(m[1])
        elif line.strip() and not line.startswith((" ", "-", "#")):
            inside = False
    spaces = _relaxed(files.get("package.json", "")).get("workspaces") or []
    globs += spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    found = []
    for path in sorted(files):
        folder, _, name = path.rpartition("/")
        if name == "package.json" and folder and any(not g.startswith("!") and re.fullmatch(re.escape(g.rstrip("/")).replace(r"\*\*", ".*").replace(r"\*", "[^/]*"), folder) for g in globs):
            if label := _relaxed(files[path]).get("name"):
                found.append((label, folder))
    return found
