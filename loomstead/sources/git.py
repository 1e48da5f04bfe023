"""Adapters for the text that git prints; the commands themselves run on the driver."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD, RECORD = "\x1f", "\x1e"
LOG_FORMAT = FIELD.join(["%H", "%an", "%aI", "%s"]) + RECORD


def run(root: str, *args: str, timeout: int = 20) -> str | None:
    """Output of a git command in a folder; None if git is missing, fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def parse_status(text: str) -> dict:
    """Branch, upstream, ahead, behind and files of ``status --porcelain --branch``; a renamed file has its new name."""
    found = {"branch": None, "upstream": None, "ahead": 0, "behind": 0, "files": []}
    for line in text.splitlines():
        if line.startswith("## "):
            m = re.match(r"## (?:No commits yet on )?(.+?)(?:\.\.\.(\S+))?(?: \[(.*)\])?$", line)
            found["branch"], found["upstream"] = m[1], m[2]
            for word, count in re.findall(r"(ahead|behind) (\d+)", m[3] or ""):
                found[word] = int(count)
        elif len(line) > 3:
            path = line[3:].rpartition(" -> ")[2].strip('"')
            found["files"].append((line[:2].strip(), path))
    return found | {"clean": not found["files"]}


def candidates(spark: SparkSession, root: str) -> DataFrame | None:
    """``(relative_path)`` of the files git knows or does not ignore; None without git."""
    text = run(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    return None if text is None else spark.createDataFrame([(p,) for p in text.split("\0") if p], "relative_path string")


def log_rows(log: Column) -> Column:
    """Array of ``struct(commit, author, at, subject)`` of a log printed with :data:`LOG_FORMAT`."""
    records = F.filter(F.transform(F.split(log, RECORD), lambda r: F.trim(F.regexp_replace(r, r"^\s+", ""))), lambda r: r != "")
    part = lambda r, k: F.element_at(F.split(r, FIELD), k)
    return F.transform(records, lambda r: F.struct(part(r, 1).alias("commit"), part(r, 2).alias("author"), F.to_timestamp(part(r, 3)).alias("at"), part(r, 4).alias("subject")))


def changed_since(committed: DataFrame, working: DataFrame, untracked: DataFrame) -> DataFrame:
    """Distinct paths of all three lists."""
    return committed.select("relative_path").unionByName(working.select("relative_path")).unionByName(untracked.select("relative_path")).distinct()


def history(spark: SparkSession, root: str, *, limit: int = 20, since: str | None = None, file: str | None = None, branch: str | None = None) -> DataFrame | None:
    """``(commit, author, at, subject)`` of the newest commits, of a branch, since a date, of a file; None without git."""
    args = ["log", f"-n{limit}", f"--format={LOG_FORMAT}", *([f"--since={since}"] if since else []), *([branch] if branch else []), *(["--", file] if file else [])]
    text = run(root, *args)
    if text is None:
        return None
    rows = spark.createDataFrame([(text,)], "log string")
    return rows.select(F.explode(log_rows(F.col("log"))).alias("c")).select("c.*")


def diff(root: str, *, staged: bool = False, ref: str | None = None, file: str | None = None, names: bool = False) -> str | None:
    """The difference of the working tree, or of what is staged, from the last commit or ``ref``; only the paths with ``names``."""
    return run(root, "diff", *(["--cached"] if staged else []), *(["--name-only"] if names else []), *([ref] if ref else []), *(["--", file] if file else []))


def show(root: str, ref: str, path: str | None = None) -> str | None:
    """A commit, or a file as it was in one."""
    return run(root, "show", f"{ref}:{path}" if path else ref)


def blame(spark: SparkSession, root: str, path: str) -> DataFrame | None:
    """``(line, commit, author, at, text)`` of each line of a file."""
    text = run(root, "blame", "--line-porcelain", "--", path)
    if text is None:
        return None
    rows, commit, line, author, at = [], None, 0, None, None
    for row in text.split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", row):
            commit, line = m[1], int(m[2])
        elif row.startswith("author "):
            author = row[7:]
        elif row.startswith("author-time "):
            at = int(row[12:])
        elif row.startswith("\t"):
            rows.append((line, commit, author, at, row[1:]))
    return spark.createDataFrame(rows, "line int, commit string, author string, at long, text string").withColumn("at", F.timestamp_seconds("at"))


def branches(root: str) -> list[str]:
    """Local branches, in order of their names; none without git."""
    return (run(root, "for-each-ref", "--format=%(refname:short)", "refs/heads") or "").split()


def _word(root: str, *args: str) -> str | None:
    return (run(root, *args) or "").strip() or None


def head_commit(root: str) -> str | None:
    return _word(root, "rev-parse", "HEAD")


def root_commit(root: str) -> str | None:
    """The first commit of all, the earliest in order of hashes where there are several."""
    return min((run(root, "rev-list", "--max-parents=0", "HEAD") or "").split(), default=None)


def current_branch(root: str) -> str | None:
    """None where the head is at no branch."""
    return _word(root, "symbolic-ref", "--short", "-q", "HEAD")


def remote_url(root: str, name: str = "origin") -> str | None:
    return _word(root, "remote", "get-url", name)


def top_level(folder: str) -> str | None:
    return _word(folder, "rev-parse", "--show-toplevel")


def version() -> str | None:
    return (_word(".", "--version") or "").removeprefix("git version ") or None


def summary(root: str) -> dict | None:
    """Branch, head, files changed and the last commits of a working tree; None without git or outside of one."""
    status = run(root, "status", "--porcelain", "--branch")
    if status is None:
        return None
    found = parse_status(status)
    log = run(root, "log", "-n5", "--format=%h %s") or ""
    return {"branch": found["branch"], "head": head_commit(root), "clean": found["clean"], "changed": [p for _, p in found["files"]], "ahead": found["ahead"], "behind": found["behind"], "recent": log.splitlines()}
