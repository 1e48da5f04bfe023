"""Files that nobody wrote by hand as they stand: generated, bundled or minified, third-party, or data saved as code.

Method: linear support-vector classifiers, one for each of those four kinds, on hashed character n-grams, words and path
components. Training labels come from giveaways (marks in the first comment, telling folders and suffixes, texts of bare
literals). Each labelled file is learnt twice: as it is, and with its giveaway comment and its path masked, so that the
classifiers must also know such files by their body alone. Validation is split by repository: of the repositories that
training did not see, half choose the thresholds and half give the figures (``held_out``).

Scale: training rows are a documented sample (``SAMPLE`` labelled and as many other files, fewer where files are so long that
their features would pass ``TRAINING_BYTES``, taken by a hash of the file's id); features are made on the executors and
no text reaches the driver. Every file is classified, in one pass without a shuffle, with broadcast weights of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import materialise

BITS = 17
SAMPLE = 8000
TRAINING_BYTES = 160 << 20
EPOCHS = 5
NGRAM = 4
KINDS = ("generated", "minified", "vendored", "data")

# What gives a file away, and what only looks like it.
GENERATED_MARKS = (
    r"code generated by|@generated|auto-?generated|automatically generated|machine[- ]generated|this file (?:is|was) generated"
    r"|generated (?:from|by) \S+|changes will be (?:lost|overwritten)|do not (?:edit|modify) (?:by hand|this file|manually)|do not edit\.?\s*$"
    r"|g[ée]n[ée]r[ée] automatiquement|generado autom[áa]ticamente|automatisch (?:erzeugt|generiert|erstellt)"
)
HAND_MARKS = r"hand-?(?:written|edited|maintained)|(?:written|edited|maintained|kept) by hand|edit this file directly|safe to edit"
LICENCE_MARKS = r"@license|^/\*!|^(?:#|//|/\*\*?|\s\*)\s*[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\b"
GENERATED_PATH = r"(?:^|/)(?:__generated__|gen|generated)/|\.generated\.\w+$|_pb2\.py$|\.pb\.go$"
MINIFIED_PATH = r"(?:^|/)dist/|[.-]min\.\w+$|\.bundle\.\w+$"
VENDORED_PATH = r"(?:^|/)(?:vendor|_vendor|vendored|third_party|thirdparty|third-party|node_modules|bower_components|deps|external)/"
# Extensions of files that hold data or prose as they should, for which bare literals and long lines tell nothing.
PLAIN_FILES = frozenset("json yaml yml toml ini cfg conf env properties csv tsv txt md rst adoc xml html htm svg lock log ipynb tex po".split())
_MARKS = re.compile(GENERATED_MARKS, re.I | re.M)
_HAND = re.compile(HAND_MARKS, re.I)
_LICENCE = re.compile(LICENCE_MARKS, re.M)
_PATHS = {kind: re.compile(pattern) for kind, pattern in zip(KINDS, (GENERATED_PATH, MINIFIED_PATH, VENDORED_PATH))}
_HEAD = re.compile(r"(?:\s*(?:#![^\n]*\n|//[^\n]*(?:\n|$)|#[^\n]*(?:\n|$)|--[^\n]*(?:\n|$)|/\*[\s\S]*?\*/|<!--[\s\S]*?-->))+")
_WORD = re.compile(r"[A-Za-z_$][\w$]+")
_LITERAL = re.compile(r"[-+]?\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_BUNDLER = re.compile(r"\b__\w*(?:pack|bundle)\w*_(?:require|modules)__\b|\bwebpackJsonp\b|\bSystem\.register\(\[")
_COMMENT = re.compile(r"(?:^|\s)(?:#|//|--)\s")
_ROW = re.compile(r"^[ \t]*(\S.*?)\s*$", re.M)


def _extension(path: str) -> str:
    return path.rpartition(".")[2].lower()


def head_of(text: str) -> tuple[str, str]:
    """The comments a file begins with, and the rest."""
    m = _HEAD.match(text)
    return (m[0], text[m.end() :]) if m else ("", text)


def literal_share(text: str) -> float:
    """Share of the text that literals and their separators make up."""
    sample = _LITERAL.sub("", text)
    return 1 - len(re.sub(r"[\s,;(){}\[\]+:=]", "", sample)) / max(1, len(re.sub(r"\s", "", text)))


def giveaway(path: str, text: str) -> str | None:
    """Label for training: the kind that something outside the body gives away, or ``data`` for bare literals; None for none."""
    head, body = head_of(text.lstrip("\ufeff"))
    if _HAND.search(head):
        return None
    if _MARKS.search(head):
        return "generated"
    for kind, pattern in _PATHS.items():
        if pattern.search(path):
            return kind
    if _extension(path) in PLAIN_FILES:
        return None
    if _LICENCE.search(head):
        return "vendored"
    if _BUNDLER.search(body):
        return "minified"
    if len(body) > 800 and sum(map(body.count, " \n\t")) < 0.06 * len(body):
        return "minified"
    bare = _LITERAL.sub("0", body)
    if max(map(len, bare.split("\n"))) > 400 and len(bare) / (bare.count("\n") + 1) > 150:
        return "minified"
    if len(body) < 1500 or _COMMENT.search(body):
        return None
    rows = Counter(_ROW.findall(bare))
    row, times = rows.most_common(1)[0] if rows else ("", 0)
    return "data" if literal_share(body) > 0.9 or (rows.total() >= 25 and len(row) * times > 0.5 * len(bare)) else None


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class Names(dict):
    """Hashed places of names seen so far; emptied when it holds half a million."""

    def __missing__(self, name: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[name] = found = _hash(name)
        return found


_NAMES = Names()


def ngrams(text: str) -> np.ndarray:
    """Hashed places of all byte n-grams."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    n = len(raw) - NGRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    code = raw[:n].copy()
    for k in range(1, NGRAM):
        code = code * np.uint32(257) + raw[k : k + n]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def parts(path: str, text: str, masked: bool) -> tuple[list[int], list[int], list[int], list[int], np.ndarray]:
    """Places of shape, path, first-comment and word features, and of the n-grams."""
    head, body = head_of(text.lstrip("﻿"))
    extension = _extension(path)
    lines = body.count("\n") + 1
    size = max(1, len(body))
    width = max(map(len, body.split("\n"))) if body else 0
    share = literal_share(body) if size > 400 else 0.0
    dense = 1 - sum(map(body.count, " \n\t")) / size
    what = extension if extension in PLAIN_FILES else ""  # long lines and literals tell other things of data and prose
    shape = [
        f"s:{extension}", f"s:{extension}:{min(size // lines // 20, 12)}", f"s:{what}w{min(width // 100, 12)}", f"s:{what}l{int(share * 10)}:{min(size // 1000, 4)}",
        f"s:{what}d{int(dense * 20)}", f"s:{what}c{min(body.count('#') + body.count('//'), 3)}",
    ]
    folders, names = [], []
    if not masked:
        *folders, name = path.split("/")
        names = [f"f:{x}" for x in re.split(r"[-_]", re.sub(r"\d+", "0", name.partition(".")[0]))[-2:]]
        names += ["x:" + re.sub(r"\d+|[0-9a-f]{4,}", "0", x) for x in name.split(".")[1:]] + [f"d:{x}" for x in folders]
        names.append("x:dots%d" % name.count("."))
    said = [] if masked else [w.lower() for w in _WORD.findall(re.sub(r"\d+", "0", head))]
    heads = ["h:" + w for w in said] + [f"h:{a} {b}" for a, b in zip(said, said[1:])] + ([] if masked else ["h:" + head[:3]] if head else [])
    place = _NAMES.__getitem__
    words = {"w:" + w for w in _WORD.findall(body)}
    return list(map(place, shape)), list(map(place, names)), list(map(place, set(heads))), list(map(place, words)), ngrams(body)


WEIGHTS = (0.8, 1.0, 1.5, 1.5)  # of shape, path, first-comment and word features; n-grams have 4 in all


def vector(path: str, text: str, masked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of all features and their values."""
    *groups, grams = parts(path, text, masked)
    value = np.zeros(2 << BITS, np.float32)
    for group, weight in zip(groups, WEIGHTS):
        if group:
            np.add.at(value, np.array(group, np.int64), weight / np.sqrt(len(group)))
    if len(grams):
        at, count = np.unique(grams, return_counts=True)
        value[at + (1 << BITS)] = count * (4.0 / len(grams))
    where = np.flatnonzero(value)
    return where.astype(np.int32), value[where]


def _descend(rows: list[tuple], seed: int) -> dict:
    """Averaged sub-gradient steps on the hinge loss of every kind at once, over each row as it is and masked.

    ``rows`` are ``(project, kind or None, (places, values) as it is, (places, values) masked)``. A row of another kind
    says nothing of a kind.
    """
    random = np.random.default_rng(seed)
    examples = [(*v, np.array([1.0 if kind == k else 0.0 if kind else -1.0 for k in KINDS])) for _, kind, *vectors in rows for v in vectors]
    signs = np.array([y for *_, y in examples]).reshape(-1, len(KINDS))
    boost = np.clip((signs < 0).sum(0) / np.maximum(1, (signs > 0).sum(0)), 1.0, 4.0)
    weights, total = np.zeros((2 << BITS, len(KINDS)), np.float32), np.zeros((2 << BITS, len(KINDS)), np.float32)
    bias, bias_total, t = np.zeros(len(KINDS)), np.zeros(len(KINDS)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(examples)):
            where, much, y = examples[i]
            much = much.astype(np.float32)  # kept at half precision, as they were sent
            t += 1
            wrong = (y != 0) & (y * (much @ weights[where] + bias) < 1)
            if wrong.any():
                step = np.where(wrong, 0.5 / (1 + t * 1e-4) * y * np.where(y > 0, boost, 1.0), 0.0)
                change = np.outer(much, step).astype(np.float32)
                weights[where] += change
                bias += 0.1 * step
                # the average of all states, kept by adding each step with the share of time it is in force
                total[where] -= t * change
                bias_total -= 0.1 * t * step
        weights *= 0.98
        total *= 0.98
    return {"weights": weights + total / (t + 1), "bias": bias + bias_total / (t + 1), "threshold": np.zeros(len(KINDS))}


def _margins(rows: list[tuple], model: dict) -> np.ndarray:
    return np.array([much.astype(np.float32) @ model["weights"][where] + model["bias"] for _, _, (where, much), _ in rows]).reshape(-1, len(KINDS))


def train(rows: list[tuple], seed: int = 5) -> dict:
    """Weights and thresholds from ``(project, kind or None, vector, masked vector)`` rows.

    Rows without a giveaway are unlabelled rather than by hand: those that a first fit takes for one of the kinds are left
    out of the second fit, but not of the validation, where they count as by hand. ``held_out`` is the share of rows right in
    repositories that neither the weights nor the thresholds have seen.
    """
    part = {p: zlib.crc32((p or "").encode()) % 8 for p in {r[0] for r in rows}}
    learn = [r for r in rows if part[r[0]] > 1] or rows
    model = _descend(learn, seed)
    doubtful = (_margins(learn, model) > 0).any(1)
    model = _descend([r for r, odd in zip(learn, doubtful) if r[1] or not odd], seed)
    for wanted in (0, 1):
        check = [r for r in rows if part[r[0]] == wanted]
        if len(check) < 50 or not any(r[1] for r in check):
            continue
        margins, kinds = _margins(check, model), np.array([KINDS.index(r[1]) if r[1] else -1 for r in check])
        if wanted == 0:
            for k in range(len(KINDS)):
                own = (kinds == k) | (kinds < 0)
                truth, found = kinds[own] == k, margins[own, k]
                if truth.any():
                    model["threshold"][k] = max(np.linspace(-0.3, 0.3, 13), key=lambda c: (round(2 * (truth & (found > c)).sum() / max(1, truth.sum() + (found > c).sum()), 3), -abs(c)))
        else:
            model["held_out"] = float((((margins > model["threshold"]).any(1)) == (kinds >= 0)).mean())
    return model


def score(paths: list[str], texts: list[str], model: dict) -> list[float]:
    """Of each file the greatest signed distance over the thresholds of the kinds."""
    weights, level, found = model["weights"], model["bias"] - model["threshold"], []
    grams_at = weights[1 << BITS :]
    for path, text in zip(paths, texts):
        *groups, grams = parts(path, text, False)
        total = level.copy()
        for group, weight in zip(groups, WEIGHTS):
            if group:
                total += weight / len(group) ** 0.5 * weights[group].sum(0)
        if len(grams):
            total += 4.0 * np.take(grams_at, grams, axis=0).mean(0)
        found.append(float(total.max()))
    return found


def _drawn(files: DataFrame, share: float, plain_share: float) -> DataFrame:
    """Features of files drawn by a hash: all of a kind within ``share`` of all hashes, others within ``plain_share``."""
    least = -(1 << 63)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, path, text, order in zip(batch["project"], batch["path"], batch["text"], batch["o"]):
                kind = giveaway(path or "", text)
                if kind is None and order >= least + plain_share * 2.0**64:
                    continue
                vectors = [x for masked in (False, True) for x in vector(path or "", text, masked)]
                rows.append((order, project, kind, *(x.astype(np.int32 if i % 2 == 0 else np.float16).tobytes() for i, x in enumerate(vectors))))
            yield pd.DataFrame(rows, columns=["o", "project", "kind", "at", "value", "masked_at", "masked_value"])

    chosen = files.where(F.col("o") < F.lit(int(min(least + share * 2.0**64, 2.0**63 - 1024))))
    return chosen.mapInPandas(run, "o long, project string, kind string, at binary, value binary, masked_at binary, masked_value binary")


def fit(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content", sample: int = SAMPLE) -> dict:
    """The classifiers for a table of files; the features of at most ``sample`` labelled and as many other rows reach the driver."""
    base = files.where(F.col(content).isNotNull()).select(F.col(project).alias("project"), F.col(path).alias("path"), F.col(content).alias("text"), F.xxhash64(F.col(id)).alias("o"))
    size, length = base.agg(F.count("*"), F.avg(F.length("text"))).first()
    if not size:
        return {"weights": np.zeros((2 << BITS, len(KINDS)), np.float32), "bias": -np.ones(len(KINDS)), "threshold": np.zeros(len(KINDS))}
    # a vector has six bytes for each of its distinct n-grams and words, and each row has two vectors
    most = max(200, min(sample, int(TRAINING_BYTES / (2 * 12 * min(length + 200, 2 << BITS)))))
    # a quarter of files at most are given away; draw enough rows by hash for both labels
    drawn = materialise(_drawn(base, min(1.0, 6.0 * most / size), min(1.0, 1.3 * most / size)))  # read twice, so that no more than wanted is sent
    rows = [r for labelled in (True, False) for r in drawn.where(F.col("kind").isNotNull() == labelled).orderBy("o").limit(most).collect()]
    read = lambda at, value: (np.frombuffer(at, np.int32), np.frombuffer(value, np.float16))
    found = [(r.project, r.kind, read(r["at"], r["value"]), read(r["masked_at"], r["masked_value"])) for r in sorted(rows, key=lambda r: r.o)]
    return train(found)


def classify(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content", sample: int = SAMPLE) -> DataFrame:
    """``(file_id, score, by_hand)`` of every row, whatever its extension.

    Null or empty content is by hand (there is nothing that a program or third party wrote); null paths count as empty.
    Repeated rows are classified each; other columns are not read; whole texts are read.
    """
    model = fit(files, id=id, project=project, path=path, content=content, sample=sample)
    shared = files.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["content"]]
            found = score([p or "" for p in batch["path"]], texts, shared.value)
            batch["score"] = found
            batch["by_hand"] = [not t or s <= 0 for t, s in zip(texts, found)]
            yield batch[["file_id", "score", "by_hand"]]

    return files.select(F.col(id).alias("file_id"), F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {files.schema[id].dataType.simpleString()}, score double, by_hand boolean"
    )


def not_by_hand(files: DataFrame, **options) -> DataFrame:
    """``(file_id)`` of the files that nobody wrote by hand as they stand, once each."""
    return classify(files, **options).where("NOT by_hand").select("file_id").distinct()
