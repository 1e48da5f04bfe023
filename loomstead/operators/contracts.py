"""HTTP endpoints in source text, and which call of one project meets which route of another."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import canonical_path, join_canonical

# Verbs, receivers that serve, receivers that call, hosts that are one's own.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "all")
SERVERS = re.compile(r"(?:app|server|[\w$]*router|routes?)", re.I)
CLIENTS = re.compile(r"(?:axios|api|apiclient|client|http|https|request|instance|agent|fetcher|[\w$]*api)", re.I)
LOCAL_HOSTS = re.compile(r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])", re.I)

_HEAD = re.compile(
    r"\b(?P<who>[A-Za-z_$][\w$]*)\s*\.\s*(?P<verb>" + "|".join(VERBS) + r"|use)\s*(?:<[^()]*>)?\s*\("
    r"|(?<![\w$.])(?P<fetch>fetch)\s*\(|@(?P<mark>[A-Z][a-z]+)\s*\(|@\w+\.(?P<route>route|" + "|".join(VERBS) + r")\s*\(", re.I
)
_QUOTED = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|`([^`]*)`")
_BASE_URL = re.compile(r"base_?url\s*[:=]\s*(?:\"([^\"]*)\"|'([^']*)'|`([^`]*)`)", re.I)
_METHOD = re.compile(r"\bmethod\s*:\s*[\"'`]([A-Za-z]+)[\"'`]")
_METHODS = re.compile(r"\bmethods\s*=\s*[\[(]\s*[\"']([A-Za-z]+)[\"']", re.I)
_NAME = re.compile(r"\s*([A-Za-z_$][\w$]*)")
_OPEN, _CLOSE = "([{", ")]}"


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose bracket opens just before ``at``, as written, and where the call ends.

    Brackets and literals within an argument belong to it; a call that does not end has what there is of it.
    """
    found, depth, begin, n = [], 0, at, len(text)
    while at < n:
        c = text[at]
        if c in "\"'`":
            at += 1
            while at < n and text[at] != c:
                at += 2 if text[at] == "\\" else 1
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            if not depth:
                break
            depth -= 1
        elif c == "," and not depth:
            found.append(text[begin:at])
            begin = at + 1
        at += 1
    found.append(text[begin:at])
    return found, at


def path_of(argument: str) -> str | None:
    """The path that an argument spells: literals as they are, anything that is joined to them as ``{}``; None if it begins otherwise."""
    first = _QUOTED.match(argument.lstrip())
    if not first:
        return None
    parts, depth, begin = [], 0, 0
    at, n = 0, len(argument)
    while at <= n:  # cut at plus signs outside of brackets and literals
        if at == n or (argument[at] == "+" and not depth):
            parts.append(argument[begin:at].strip())
            begin = at + 1
        elif literal := _QUOTED.match(argument, at):
            at = literal.end() - 1
        elif argument[at] in _OPEN:
            depth += 1
        elif argument[at] in _CLOSE:
            depth -= 1
        at += 1
    spelt = (_QUOTED.fullmatch(part) for part in parts if part)
    return "".join("{}" if m is None else next(g for g in m.groups() if g is not None) for m in spelt)


def scan(text: str, path: str = "") -> list[tuple[str, str | None, str, int, bool, str | None]]:
    """``(role, method, path, line, is_external, mounted_name)`` of each route, call and mount of a file.

    Roles are provides, consumes and mounts; the method is null for any. An unclear receiver is left out.
    """
    if not text:
        return []
    base = _BASE_URL.search(text)
    address = next((g for g in base.groups() if g is not None), "") if base else ""
    elsewhere = bool(re.match(r"[a-z]+://", address, re.I)) and not LOCAL_HOSTS.match(address)
    ends = [m.start() for m in re.finditer("\n", text)]
    found, prefix = {}, ""

    def add(role: str, method: str | None, spelt: str, at: int, external: bool = False, name: str | None = None) -> None:
        line = bisect.bisect_left(ends, at) + 1
        found.setdefault((role, method, spelt, line, name), external)

    for m in _HEAD.finditer(text):
        given, end = arguments(text, m.end())
        spelt = path_of(given[0])
        if m["mark"]:
            if m["mark"] == "Controller":
                prefix = spelt or ""
            elif m["mark"].lower() in VERBS and m["mark"] == m["mark"].title() and not path.lower().endswith(".py"):
                add("provides", None if m["mark"] == "All" else m["mark"].upper(), "/" + "/".join(x.strip("/") for x in (prefix, spelt) if x), m.start())
            continue
        if spelt is None or not spelt.startswith(("/", "http")):
            continue
        if m["route"]:
            if path.lower().endswith(".py") and spelt.startswith("/"):
                methods = _METHODS.search(text, m.end(), end)
                method = (methods[1].upper() if methods else "GET") if m["route"].lower() == "route" else m["route"].upper()
                add("provides", None if method == "ALL" else method, spelt, m.start())
        elif m["fetch"]:
            option = _METHOD.search(text, m.end(), end)
            add("consumes", option[1].upper() if option else "GET", spelt, m.start(), elsewhere or "://" in spelt)
        elif m["verb"].lower() == "use":
            name = _NAME.fullmatch(given[-1].rstrip()) if len(given) > 1 else None
            if SERVERS.fullmatch(m["who"]) and name and spelt.startswith("/"):
                add("mounts", None, spelt, m.start(), False, name[1])
        else:
            serves, calls = bool(SERVERS.fullmatch(m["who"])), bool(CLIENTS.fullmatch(m["who"]))
            if serves != calls and text[m.start() - 1 : m.start()] != "@":
                method = m["verb"].upper()
                add("provides" if serves else "consumes", None if method == "ALL" else method, spelt, m.start(), calls and (elsewhere or "://" in spelt))
    return [(*key[:4], external, key[4]) for key, external in found.items()]


def endpoints(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content") -> DataFrame:
    """``(file_id, project_id, role, method, raw_path, canonical, line, is_external, mounted_name)`` of all files, in one pass.

    Null and empty texts have none; a repeated row gives its endpoints once, as only they are compared, never the texts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, p, *e) for f, p, w, c in zip(batch["file_id"], batch["project_id"], batch["path"], batch["content"]) for e in scan(c, w or "")]
            yield pd.DataFrame(rows, columns=["file_id", "project_id", "role", "method", "raw_path", "line", "is_external", "mounted_name"])

    kind = files.schema[id].dataType.simpleString()
    where = F.col(path) if path in files.columns else F.lit("")
    # a text without any of these words has no endpoint
    likely = F.col(content).rlike(r"(?i)\.\s*(?:" + "|".join(VERBS) + r"|use)\b|\bfetch\b|@[A-Z][a-z]+\s*\(|\.route\b")
    found = files.where(likely).select(F.col(id).alias("file_id"), F.col(project).alias("project_id"), where.alias("path"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {kind}, project_id string, role string, method string, raw_path string, line int, is_external boolean, mounted_name string"
    )
    return found.withColumn("canonical", canonical_path(F.col("raw_path"))).distinct()


def first_mounts(mounts: DataFrame, imports: DataFrame) -> DataFrame:
    """``(target_file_id, prefix)``: the first mount that reaches a file through an import of the mounting one.

    ``imports`` has ``(file_id, names, resolved_file_id)``; an import that lists no names may bring in any.
    """
    reached = mounts.where("role = 'mounts'").join(imports.where("resolved_file_id IS NOT NULL").select("file_id", "names", "resolved_file_id"), "file_id")
    reached = reached.where("names IS NULL OR size(names) = 0 OR array_contains(names, mounted_name)")
    first = F.min_by("canonical", F.struct("file_id", "line", "canonical"))
    return reached.groupBy(F.col("resolved_file_id").alias("target_file_id")).agg(first.alias("prefix"))


def with_mounts(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """Routes with the prefix of the mount that reaches their file: ``mounts`` has ``(target_file_id, prefix)``."""
    joined = routes.join(mounts.select(F.col("target_file_id").alias("file_id"), "prefix"), "file_id", "left")
    return joined.withColumn("canonical", F.when(F.col("prefix").isNotNull(), join_canonical(F.col("prefix"), F.col("canonical"))).otherwise(F.col("canonical"))).drop("prefix")


def provided(found: DataFrame, imports: DataFrame) -> DataFrame:
    """Routes of all files as clients reach them: under the mounts that lead to their files."""
    return with_mounts(found.where("role = 'provides'"), first_mounts(found, imports))


_SITE = ("project_id", "file_id", "line", "method")


def links(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Each call key with its call sites and the routes they meet: ``(method, canonical, consumers, providers)``.

    A call meets the routes of its method and path or, where there is none, those of its path for any method. Both sides
    are lists of ``(project_id, file_id, line, method)`` in that order; ``providers`` is empty for an unmatched call.
    Calls to other hosts are left out.
    """
    side = lambda rows, name: rows.withColumn("_m", F.col("method")).groupBy(F.col("_m").alias("key"), "canonical").agg(F.array_sort(F.collect_set(F.struct(*_SITE))).alias(name)).withColumnRenamed("key", "method")
    served = side(routes, "providers")
    exact = served.where("method IS NOT NULL").withColumnRenamed("providers", "exact")
    wild = served.where("method IS NULL").select("canonical", F.col("providers").alias("wild"))
    wanted = side(calls.where("NOT is_external"), "consumers")
    none = F.array().cast(served.schema["providers"].dataType)
    return wanted.join(exact, ["method", "canonical"], "left").join(wild, "canonical", "left").select("method", "canonical", "consumers", F.coalesce("exact", "wild", none).alias("providers"))


def match(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``(method, canonical, consumers, providers)``: how many call sites and routes each call key of :func:`links` has.

    Both sides are counted per key before they meet, so that the join is as large as the distinct keys.
    """
    served = routes.groupBy("method", "canonical").agg(F.count("*").alias("providers"))
    exact = served.where("method IS NOT NULL").select("method", "canonical", F.col("providers").alias("exact"))
    wild = served.where("method IS NULL").select("canonical", F.col("providers").alias("wild"))
    wanted = calls.where("NOT is_external").groupBy("method", "canonical").agg(F.count("*").alias("consumers"))
    return (
        wanted.join(exact, ["method", "canonical"], "left").join(wild, "canonical", "left")
        .select("method", "canonical", "consumers", F.coalesce("exact", "wild", F.lit(0)).cast("long").alias("providers"))
    )


def report(found: DataFrame, imports: DataFrame) -> DataFrame:
    """``(metric, value)``: routes, calls, external calls, call keys that meet a route, that meet none, and routes nobody calls."""
    calls, routes = found.where("role = 'consumes'"), provided(found, imports)
    count = lambda rows, name: rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    keys = match(calls, routes)
    parts = [
        count(found.where("role = 'provides'"), "routes"), count(calls, "calls"), count(calls.where("is_external"), "external"),
        count(keys.where("providers > 0"), "linked"), count(keys.where("providers = 0"), "unmatched"), count(unused_routes(calls, routes), "unused"),
    ]
    return reduce(DataFrame.unionByName, parts)


def role_counts(found: DataFrame) -> DataFrame:
    """Endpoints of each project by role."""
    count = lambda role: F.count_if(F.col("role") == role).alias(role)
    return found.groupBy("project_id").agg(count("provides"), count("consumes"), count("mounts"))


def by_role(found: DataFrame, live: DataFrame, role: str) -> DataFrame:
    """Endpoints of a role in active files, with their paths, sorted by canonical path."""
    return found.where(F.col("role") == role).join(live.select("file_id", "relative_path"), "file_id").orderBy("canonical", "method", "relative_path", "line")


def unused_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes that no call of any project meets: ``(method, canonical)``."""
    wanted = calls.where("NOT is_external").select("method", "canonical").distinct()
    exact = routes.where("method IS NOT NULL").select("method", "canonical").distinct().join(wanted, ["method", "canonical"], "left_anti")
    wild = routes.where("method IS NULL").select("method", "canonical").distinct().join(wanted.select("canonical").distinct(), "canonical", "left_anti")
    return exact.unionByName(wild.select("method", "canonical"))


def callers_of(calls: DataFrame, path: str) -> DataFrame:
    """Call sites of a path, which is lower-cased and freed of outer slashes only."""
    return calls.where(F.col("canonical") == path.lower().strip("/")).select("project_id", "file_id", "line", "method")


def http_impact(routes: DataFrame, calls: DataFrame, origins: DataFrame | int) -> DataFrame:
    """Call sites that meet a route of each origin file: ``(origin, project_id, file_id, line, method, canonical)``.

    ``origins`` is one file id or has ``(origin)``. A route for any method is met only by calls for whose method the path has no route of its own.
    """
    if isinstance(origins, int):
        origins = routes.sparkSession.createDataFrame([(origins,)], "origin long")
    keyed = routes.select("file_id", F.col("method").alias("_m"), "canonical").distinct()
    own = keyed.join(origins.select(F.col("origin").alias("file_id")).distinct(), "file_id", "left_semi").withColumnRenamed("file_id", "origin")
    exact = routes.where("method IS NOT NULL").select("method", "canonical").distinct().withColumn("_exact", F.lit(True))
    known = calls.where("NOT is_external").join(exact, ["method", "canonical"], "left")
    hits = known.join(own, "canonical").where("_m = method OR (_m IS NULL AND _exact IS NULL)")
    return hits.select("origin", "project_id", "file_id", "line", "method", "canonical").distinct()


def impact_with_http(reached: DataFrame, routes: DataFrame, calls: DataFrame, live: DataFrame, members: DataFrame) -> DataFrame:
    """What a change reaches by imports and by HTTP: ``(origin, project_id, relative_path, depth, via)``.

    ``reached`` has ``(origin, node, depth)``; calls count in the projects that share the first workspace of the origin's
    project, or in that project alone. ``members`` has ``(workspace_id, project_id, added_at)``. A file reached both ways keeps the imports.
    """
    names = live.select("file_id", "project_id", "relative_path")
    by_import = reached.join(names, F.col("node") == F.col("file_id")).select("origin", "project_id", "relative_path", "depth", F.lit("imports").alias("via"))
    first = members.groupBy("project_id").agg(F.min_by("workspace_id", F.struct("added_at", "workspace_id")).alias("workspace_id"))
    origins = reached.select("origin").distinct().join(names, F.col("origin") == F.col("file_id")).select("origin", F.col("project_id").alias("_own"))
    shared = first.join(members.select("workspace_id", F.col("project_id").alias("project_id_2")), "workspace_id").select(F.col("project_id").alias("_own"), F.col("project_id_2").alias("project_id"))
    scope = shared.unionByName(origins.select("_own", F.col("_own").alias("project_id"))).distinct()
    sites = http_impact(routes, calls, origins).join(origins, "origin").join(scope, ["_own", "project_id"], "left_semi")
    by_http = sites.join(names.select("file_id", "relative_path"), "file_id").select("origin", "project_id", "relative_path", F.lit(1).alias("depth"), F.lit("http").alias("via")).distinct()
    order = Window.partitionBy("origin", "project_id", "relative_path").orderBy(F.col("via").desc(), "depth")
    return by_import.unionByName(by_http).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
