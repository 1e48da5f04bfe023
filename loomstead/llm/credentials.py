"""Credentials in source and configuration text: where they stand, and the text with only them made unreadable.

Method: a linear-chain conditional random field labels lexical tokens with shape and context features. Four states:
O (outside), B (first piece of a credential), I (more of it), G (what stands between two pieces of one credential:
quotes, plus signs, line ends). Viterbi paths give the spans; exactly the characters of B and I tokens are redacted.

Every token of every text is scored. A path can leave O only over a stretch of tokens whose gain, bounded from above by
the scores and the weights of the moves, is not negative; :func:`open_places` finds those stretches with running sums and
extremes, and only they go through the recursion. The labels are those of the recursion over the whole text.

The weights lie beside this module in ``credentials.npz``. ``python -m loomstead.llm.credentials FOLDER...`` makes them from
a seed: lines that :func:`training_lines` writes, set among ordinary lines of Python's own library and of the folders given
(``lines``, ``chunks`` and ``seed`` are the documented bounds; nothing of a corpus is sampled). They have a fixed size and are
broadcast. Files are labelled in one pass without a shuffle.
"""

from __future__ import annotations

import base64
import os
import random
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

O, B, I, G = range(4)
HASH = 1 << 15
BEFORE, AFTER = 9, 7
OFFSETS = [o for o in range(-BEFORE, AFTER + 1) if o]
COLUMNS = 1 + len(OFFSETS) + 2
TRAINING_LINES, TRAINING_CHUNKS, TRAINING_SEED, ROUNDS = 11000, 3000, 7, 80
WEIGHTS = Path(__file__).with_name("credentials.npz")

# The lines of a key block after its frame: header fields, then lines of at least sixteen key characters and a shorter last one.
_BETWEEN = r"(?:\s|\\[nr]|[\"'`+,;.])"
_CUT_BODY = (
    rf"(?:{_BETWEEN}*(?:[A-Z][A-Za-z]+-[A-Z][A-Za-z]+: [^\n\\]*|[A-Za-z0-9+/]{{16,}}={{0,2}}))+"
    rf"(?:{_BETWEEN}*(?:\n|\\n){_BETWEEN}*[A-Za-z0-9+/]+={{0,2}}(?=\s*(?:[\"'`]|\\n|\n|\Z)))?"
)
LEXER = re.compile(
    r"(?:[A-Za-z0-9_+]|/(?!/\s))(?:[A-Za-z0-9_+/.\-#*!~%^]*[A-Za-z0-9_+/*!])?(?:(?<=[A-Za-z0-9+/]{16})={1,2}(?![\w=]))?"
    r"|\n[ \t]*|://|//(?=\s)"
    r"|-----BEGIN [A-Z0-9 ]+-----(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z0-9 ]+-----"
    rf"|-----BEGIN [A-Z0-9 ]+-----(?:{_CUT_BODY})?"
    r"|\S"
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")


# ---------------------------------------------------------------- features

def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % (HASH - 1) + 1


def _words(token: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(token)]


# Stems of names that hold credentials (in English, German, Spanish, French, Portuguese), of names that hold other opaque values, and words of placeholders.
SENSITIVE = (
    "passw passphrase passwd pwd secret token apikey accesskey privatekey signingkey sharedkey masterkey key auth bearer basic credential pass pw dsn login pin"
    " kennwort passwort geheim schluessel zugang clave contrasena secreto motdepasse mdp jeton senha"
).split()
BENIGN = "hash sha md5 commit digest etag checksum integrity fingerprint thumbprint uuid trace request span label hint ref name public cert fixture revision version build image logo blob count type url primary foreign sort cache".split()
PLACEHOLDER = "your here change replace insert real example dummy fake sample placeholder todo redacted enter put not my test xxx use own none tbd".split()
LISTED = frozenset(SENSITIVE + BENIGN + PLACEHOLDER)


_BENIGN, _PLACEHOLDER = frozenset(BENIGN), frozenset(PLACEHOLDER)
_SHAPES = str.maketrans({c: "A" if c.isupper() else "a" if c.islower() else "0" for c in map(chr, range(128)) if c.isalnum()})
_RUNS = re.compile(r"(?<=A)A+|(?<=a)a+|(?<=0)0+")
_PREFIX = re.compile(r"[A-Za-z]{2,5}[-_](?:[a-z]{3,5}[-_])?")
_BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")
# Public formats of access keys and tokens.
_FORMAT = re.compile(
    r"(?P<aws>(?:AKIA|ASIA)[A-Z0-9]{16})|(?P<hub>gh[pousr]_[A-Za-z0-9]{36,})|(?P<chat>xox[abprs]-[0-9A-Za-z-]{20,})|(?P<cloud>AIza[\w-]{30,})"
    r"|(?P<pay>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})|(?P<model>sk-[A-Za-z0-9-]{20,})|(?P<jwt>eyJ[\w-]{10,}\.[\w-]{10,}\.?[\w.-]*)"
)
_DUMMIES = ("EXAMPLE", "example", "XXXX", "xxxx", "0000000")


_DIGITS = str.maketrans("123456789", "000000000")
PLAIN = 16  # tokens shorter than this are told apart but for their digits


def plain(token: str) -> str:
    """What the features of a token are made of: digits of short tokens count alike, and so do letters beyond Latin-1."""
    return token.translate(_DIGITS) if len(token) < PLAIN and token <= "\xff" * len(token) else "?" if len(token) == 1 else token


class _Kept(dict):
    """Results of a function of one argument; emptied when it holds half a million."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, key):
        if len(self) > 500_000:
            self.clear()
        self[key] = found = self.of(key)
        return found


def _part(part: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a part of a name tells: ``(stems, listed words)``; stems may run over the words of the part."""
    listed = [w for w in dict.fromkeys(_words(part)) if w in LISTED]
    squashed = part.lower().translate(_MARKS)
    stems = ["+" + x for x in SENSITIVE if x in squashed] + ["-" + w for w in listed if w in _BENIGN]
    if squashed.startswith(_BENIGN_STARTS):
        stems += ["-" + x for x in BENIGN if squashed.startswith(x) and "-" + x not in stems]
    return tuple(stems), tuple(listed)


def _outline(shown: str) -> tuple[str, tuple[str, ...]]:
    """What follows from the shape of a token: ``(class, features)``."""
    size = len(shown)
    letters = set(shown)
    coarse = "long" if size >= 20 and "0" in letters else "num" if letters == {"0"} else "word" if letters <= _WORD_SHAPES and letters != {"_"} else "mixed"
    found = ["bias", "C:" + coarse]
    if size > 1:
        shape = _RUNS.sub("", shown)
        digits, upper, lower = shown.count("0"), shown.count("A"), shown.count("a")
        found += [
            "n:%d" % min(size // 4, 16), "S:" + (shape if len(shape) <= 10 else "many"), "mix:%d%d%d" % (digits > 0, upper > 0, lower > 0),
            "turns:%d" % min(len(shape) * 6 // size, 6), "runs:%d" % min(shape.count("a"), 5),
            "marks:" + ("" if digits + upper + lower == size else "".join(sorted(letters - _ALNUM_SHAPES))),
        ]
        if size >= 16 and len(shape) > 10:
            found.append("random")
    return _SHARED.setdefault((coarse, *found), (coarse, tuple(found)))


def _tellers():
    """Whether a lower-case text holds a stem, a listed word or a mark of a dummy."""
    needles = {*SENSITIVE, *LISTED, *(x.lower() for x in _DUMMIES)}
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("|".join(sorted(needles, key=len, reverse=True)))
        return lambda text: pattern.search(text) is not None
    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


_MARKS = {ord(c): None for c in map(chr, range(128)) if not c.isalnum()}
_BENIGN_STARTS = tuple(BENIGN)
_WORD_SHAPES, _ALNUM_SHAPES = set("Aa_"), set("Aa0")
_SHARED: dict[tuple, tuple] = {}
_PARTS, _OUTLINES = _Kept(_part), _Kept(_outline)
_TELLS = _tellers()
_EMPTY: tuple[str, ...] = ()


def signature(token: str) -> tuple:
    """All that the features of a token (made plain) follow from; far fewer than there are tokens."""
    first, size = token[0], len(token)
    if first == "\n":
        return ("line",)
    if size > 9 and token.startswith("-----"):
        return ("pem", token.split("-----")[1].removeprefix("BEGIN "))
    if not (first.isalnum() or first in "_+/"):
        return ("mark", first)
    shown = token.translate(_SHAPES)
    outline = _OUTLINES[shown]
    if size < 2:
        return (outline, 0, _EMPTY, _EMPTY, _EMPTY)
    coarse, stems, listed, more = outline[0], _EMPTY, _EMPTY, _EMPTY
    if coarse != "num" and _TELLS(token.lower()):
        if coarse == "long":
            listed = tuple(sorted({w for w in _words(token) if w in LISTED}))
        elif "." in token or "/" in token:
            for part in token.replace("/", ".").split("."):
                if part:
                    found, words = _PARTS[part]
                    stems, listed = stems + found, listed + words
            stems, listed = tuple(sorted(set(stems))), tuple(sorted(set(listed)))
        else:
            stems, listed = _PARTS[token]
        if any(x in token for x in _DUMMIES):
            more += ("dummy",)
    if "_" in token[2:6] or "-" in token[2:6]:
        if m := _PREFIX.match(token):
            more += ("p:" + m[0],)
    if size >= 12 and "0" in shown and _HEX.fullmatch(token):
        more += ("hex:%d" % min(size, 130),)
    if size >= PLAIN:
        if "dummy" not in more and (m := _FORMAT.fullmatch(token)) and len(set(token)) > 8:
            more += ("format", "format:" + m.lastgroup)
        if size <= 200 and size % 4 == 0 and _BASE64.fullmatch(token):
            try:
                text = base64.b64decode(token, validate=True)
                if b":" in text and all(32 <= c < 127 for c in text):
                    more += ("pair",)
            except ValueError:
                pass
        if size == 36 and _UUID.fullmatch(token):
            more += ("uuid",)
    return (outline, min(len(set(token)) * 8 // size, 8), stems, listed, more)


def features_of(sign: tuple) -> tuple[list[str], list[str], list[str]]:
    """What a token tells about its own label, about a neighbour at a certain distance, and about its neighbourhood."""
    if sign[0] == "line":
        return ["bias", "C:line"], ["c:line"], ["c:line"]
    if sign[0] == "pem":
        return ["bias", "C:pem", "pem:" + sign[1], "private" if "PRIVATE" in sign[1] else "public"], ["c:pem"], ["c:pem"]
    if sign[0] == "mark":
        return ["bias", "C:" + sign[1]], ["c:" + sign[1]], []
    (coarse, outline), same, stems, listed, more = sign
    own, near, around = [*outline, *more], ["c:" + coarse], ["c:long"] if coarse == "long" else []
    if len(outline) > 2:
        own.append("same:%d" % same)
    if stems:
        sensitive, benign = any(x[0] == "+" for x in stems), any(x[0] == "-" for x in stems)
        told = ["K:both" if sensitive and benign else "K:sensitive" if sensitive else "K:benign"] + ["k:" + x[1:] for x in stems]
        near += told
        around += told
    if listed:
        own += ["W:" + w for w in listed]
        if coarse != "long":
            around += ["w:" + w for w in listed]
        if held := sum(w in _PLACEHOLDER for w in listed):
            own.append("placeholder:%d" % min(held, 2))
    return own, near, around


def token_features(token: str) -> tuple[list[str], list[str], list[str]]:
    return features_of(signature(plain(token)))


# ---------------------------------------------------------------- tokens of many texts at once

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_START, _BODY, _END, _KEY, _SPACE = 1, 2, 4, 8, 16
_CLASSES = bytes(
    _START * (c in _LETTERS + "_+/") | _BODY * (c in _LETTERS + "_+/.-#*!~%^") | _END * (c in _LETTERS + "_+/*!") | _KEY * (c in _LETTERS + "+/") | _SPACE * c.isspace()
    for c in map(chr, range(256))
)
_ZEROS = bytes(48 if 48 <= c < 58 else c for c in range(256))
_WIDE_SPACE = re.compile(r"[\u0100-\uffff]")  # a space beyond Latin-1 becomes one that is no blank
_PEM = re.compile(LEXER.pattern[LEXER.pattern.index("-----BEGIN") : LEXER.pattern.rindex(r"|\S")])
_PRIME = 0x9E3779B97F4A7C15  # odd, so that it has an inverse for tokens at any place
_INVERSE = pow(_PRIME, -1, 1 << 64)
_LINE = np.uint64(1)  # all line ends are one token


class _Powers:
    """Powers of the prime and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64)))) for base in (_PRIME, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(begin, end, hash)`` of the tokens that ``LEXER`` finds, by operations over all characters.

    A word goes from the first character it may begin with to the last it may end with, in each run of word characters;
    padding follows a word, the rest are single characters. The hash is that of the plain token, from running sums.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = _WIDE_SPACE.sub(lambda m: "\v" if m[0].isspace() else m[0], text).encode("latin-1", "replace")
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    points, classes = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_CLASSES), np.uint8)
    body = (classes & _BODY) != 0
    change = np.zeros(n + 1, np.int8)  # +1 where a token of several characters begins, -1 after it
    ends = np.zeros(n, np.int32)  # where the token that begins here ends; 0 for none
    blocks: list[tuple[int, int]] = []
    if b"-----BEGIN" in raw:
        at = 0
        while m := _PEM.search(text, at):
            line = max(text.rfind("\n", 0, m.start()) + 1, blocks[-1][1] if blocks else 0)
            inside = [w.start() for w in LEXER.finditer(text, line, m.end()) if w.start() <= m.start()]
            at = m.start() + 1
            if inside and inside[-1] == m.start():  # else a word has swallowed the frame
                blocks.append(m.span())
                at = m.end()
    slash = points == 47
    colons = np.flatnonzero((points[:-2] == 58) & slash[1:-1] & slash[2:]) if n > 2 else np.zeros(0, np.int64)
    lines = np.flatnonzero(points == 10)
    for begin, end in blocks:
        body[begin:end] = False
        ends[begin] = end
        change[begin] += 1
        change[end] -= 1
    if blocks:
        within = np.cumsum(change, dtype=np.int8) > 0
        colons, lines = colons[~within[colons]], lines[~within[lines]]
    body[colons + 1] = body[colons + 2] = False
    blank = (points == 32) | (points == 9)
    stops = np.append(np.flatnonzero(~blank), n)
    after = stops[np.cumsum(~blank, dtype=np.int32)[lines]]
    edges = np.flatnonzero(np.concatenate((body[:1], body[1:] != body[:-1], body[-1:])))
    low, high = edges[::2], edges[1::2]
    opens = body & ((classes & _START) != 0)
    starts = np.append(np.flatnonzero(opens), n)
    first = starts[np.cumsum(opens, dtype=np.int32)[low] - opens[low]]
    words = first < high
    first, high = first[words], high[words]
    closes = body & ((classes & _END) != 0)
    last = np.flatnonzero(closes)[np.cumsum(closes, dtype=np.int32)[high - 1] - 1] + 1 if len(first) else first
    follows = np.flatnonzero((points[np.minimum(last, n - 1)] == 61) & (last < n))
    for k in follows[high[follows] == last[follows]]:
        at = stop = int(last[k])
        since = at
        while since and at - since < 16 and classes[since - 1] & _KEY:
            since -= 1
        while stop < n and points[stop] == 61:
            stop += 1
        if at - since == 16 and stop - at <= 2 and not (stop < n and (text[stop].isalnum() or text[stop] == "_")):
            last[k] = stop
    for begin, end in ((colons, colons + 3), (lines, after), (first, last)):
        ends[begin] = end
        change[begin] += 1
        change[end] -= 1
    alone = np.flatnonzero((np.cumsum(change[:-1], dtype=np.int8) == 0) & ((classes & _SPACE) == 0))
    ends[alone] = alone + 1
    begin = np.flatnonzero(ends)
    end = ends[begin].astype(np.int64)
    up, down = _POWERS(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.frombuffer(raw.translate(_ZEROS), np.uint8) * up, out=sums[1:])
    hashes = (sums[end] - sums[begin]) * down[begin]
    for k in np.flatnonzero(end - begin >= PLAIN):  # few, and told apart to the digit
        hashes[k] = hash(raw[begin[k] : end[k]]) & 0xFFFFFFFFFFFFFFFF
    hashes[points[begin] == 10] = _LINE
    return begin, end, hashes


class Places(dict):
    """Hashed places of feature names."""

    def __missing__(self, name: str) -> int:
        self[name] = found = _hash(name)
        return found


class Scores:
    """Number of the signature of each token seen so far, and what each number adds to the scores: ``B``, ``I`` and ``G`` less ``O``.

    A signature has scores of its own, a kind of neighbour (what it adds to tokens at each distance) and a kind of
    surroundings (what it adds to all tokens near it). The kinds are few, so that their tables stay small. Tokens are looked up by
    their hashes, in an open table and, where two fall on one place of it, in a dictionary.
    """

    LIMIT, BITS = 400_000, 21

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        less = lambda table: np.ascontiguousarray(table[..., 1:] - table[..., :1])
        self.weights = less(weights["own"]), less(weights["context"]), less(weights["pooled"])
        self.moves = weights["moves"]
        self.places = Places()
        self.reset()

    def reset(self) -> None:
        self.held, self.number = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        self.more: dict[int, int] = {}
        self.count, self.known, self.fresh = 0, {}, []
        self.kinds: tuple[dict[tuple, int], dict[tuple, int]] = ({(): 0}, {(): 0})
        self.own = np.zeros((3, 1), np.float32)  # number 0 stands for places outside the text
        self.near, self.around = np.zeros((3, len(OFFSETS), 1), np.float32), np.zeros((3, 2, 1), np.float32)
        self.kind_of = np.zeros((2, 1), np.int32)

    def numbers(self, text: str, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the tokens of a text."""
        place = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = np.where(self.held[place] == hashes, self.number[place], 0)
        missing = np.flatnonzero(found == 0)
        if len(missing):
            new, at, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            order = np.argsort(at, kind="stable")
            numbers = np.zeros(len(new), np.int32)
            for k in order:
                key, i = int(new[k]), missing[at[k]]
                number = self.more.get(key)
                if number is None:
                    self.count += 1
                    sign = signature(plain(text[begin[i] : end[i]]))
                    number = self.known.get(sign)
                    if number is None:
                        number = self.known[sign] = len(self.known) + 1
                        self.fresh.append(sign)
                    if self.number[place[i]]:
                        self.more[key] = number
                    else:
                        self.held[place[i]], self.number[place[i]] = new[k], number
                numbers[k] = number
            found[missing] = numbers[back]
        self.learn()
        return found

    def learn(self) -> None:
        """Scores of the tokens that were met since the last call, all at once."""
        if not self.fresh:
            return
        place = self.places.__getitem__
        each = [features_of(sign) for sign in self.fresh]
        self.fresh = []
        flat = np.array([place(x) for own, _, _ in each for x in own], np.int64)
        begin = np.cumsum([0, *[len(own) for own, _, _ in each]])[:-1]
        self.own = np.concatenate((self.own, np.add.reduceat(self.weights[0][flat], begin, axis=0).T), 1)
        numbers = np.empty((2, len(each)), np.int32)
        for k, (kinds, weights) in enumerate(zip(self.kinds, self.weights[1:])):
            new = []
            for i, features in enumerate(each):
                key = tuple(features[k + 1])
                if key not in kinds:
                    kinds[key] = len(kinds)
                    new.append(weights[:, list(map(place, key))].sum(1))
                numbers[k, i] = kinds[key]
            if new:
                rows = np.stack(new, -1).transpose(1, 0, 2)  # label, distance, kind
                if k:
                    self.around = np.concatenate((self.around, rows), 2)
                else:
                    self.near = np.concatenate((self.near, rows), 2)
        self.kind_of = np.concatenate((self.kind_of, numbers), 1)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """Scores ``[3, n]`` of a sequence of token numbers; texts are parted, begun and ended by ``BEFORE`` zeros or more."""
        near, around = self.kind_of[0][numbers].astype(np.intp), self.kind_of[1][numbers].astype(np.intp)
        n = len(numbers)
        found, part, sums = np.empty((3, n)), np.empty(n, np.float32), np.zeros((2, n + 1))
        for label in range(3):
            score = np.take(self.own[label], numbers)
            for k, offset in enumerate(OFFSETS):
                np.take(self.near[label, k], near, out=part, mode="clip")
                if offset < 0:
                    score[-offset:] += part[:offset]
                else:
                    score[:-offset] += part[offset:]
            for side in (0, 1):
                np.cumsum(np.take(self.around[label, side], around), dtype=np.float64, out=sums[side, 1:])
            total = found[label]
            total[:] = score
            total[BEFORE:] += sums[0, BEFORE:-1] - sums[0, : n - BEFORE]
            total[:BEFORE] += sums[0, : min(BEFORE, n)]
            total[: n - AFTER] += sums[1, AFTER + 1 :] - sums[1, 1 : n - AFTER + 1]
            total[n - AFTER :] += sums[1, n] - sums[1, n - AFTER + 1 : n + 1]
        return found


def _sums(values: np.ndarray, first: int, last: int) -> np.ndarray:
    """Sum of ``values`` (along axis 1) over the places from ``first`` to ``last`` away."""
    n, length, labels = values.shape
    total = np.zeros((n, length + 1, labels), np.float32)
    np.cumsum(values, 1, out=total[:, 1:])
    at = np.arange(length)
    return total[:, np.clip(at + last + 1, 0, length)] - total[:, np.clip(at + first, 0, length)]


def score(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Emission scores of padded token places ``[n, length]``; 0 stands for no token."""
    length = places.shape[1]
    found = rows[places, 0].copy()
    for k, offset in enumerate(OFFSETS):
        if abs(offset) >= length:
            continue
        if offset < 0:
            found[:, -offset:] += rows[places[:, :offset], k + 1]
        else:
            found[:, :-offset] += rows[places[:, offset:], k + 1]
    found += _sums(rows[places, -2], -BEFORE, -1)
    found += _sums(rows[places, -1], 1, AFTER)
    return found


NEVER = -1e9
#: Which states may follow which: a gap must lead to another piece.
ALLOWED = np.array([[1, 1, 0, 0], [1, 1, 1, 1], [1, 1, 1, 1], [0, 0, 1, 1]], bool)
STARTS, ENDS = np.array([1, 1, 0, 0], bool), np.array([1, 1, 1, 0], bool)


def viterbi(emission: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of each padded sequence."""
    n, length, _ = emission.shape
    steps = np.where(ALLOWED, moves, NEVER)
    best = emission[:, 0] + np.where(STARTS, 0, NEVER)
    back = np.zeros((length, n, 4), np.int8)
    stay = np.arange(4, dtype=np.int8)
    for t in range(1, length):
        ways = best[:, :, None] + steps[None]
        back[t] = ways.argmax(1)
        following = ways.max(1) + emission[:, t]
        live = (t < lengths)[:, None]
        best = np.where(live, following, best)
        back[t] = np.where(live, back[t], stay)
    labels = np.zeros((n, length), np.int8)
    state = (best + np.where(ENDS, 0, NEVER)).argmax(1)
    for t in range(length - 1, -1, -1):
        labels[:, t] = state
        state = back[t, np.arange(n), state]
    return labels


# ---------------------------------------------------------------- training lines

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi wo zu bran cle drin fost gral helm jot kest lorn mast nort pell quin rast stol tern vand wick".split()
_PLAIN = (
    "order user cache report index queue table value state check event group model route cloud paper river stone light field market garden window"
    " account address answer author basket branch bridge budget bucket button camera canvas castle center circle client column copper corner course"
    " customer danger delivery design detail dinner doctor engine family farmer finger flower forest friend guitar hammer harbor island jacket kitchen"
    " ladder lesson letter member memory mirror morning mountain number office orange parcel pencil planet player pocket record region sample season"
    " server silver sister spring station stream summer target ticket timber travel valley vessel village winter writer yellow"
).split()
_SECRET_NAMES = (
    "password passwd pwd pass passphrase secret token api_key apikey auth_token access_token access_key access_key_id secret_key client_secret private_key"
    " signing_key shared_key service_token deploy_token bearer db_password smtp_pass root_pw webhook_secret hmac_key encryption_key refresh_token x_api_key"
    " admin_password app_secret master_key session_secret license_key key_id session_token jwt_secret cookie_secret bot_token"
    " kennwort passwort db_kennwort geheim_key clave clave_api contrasena senha mot_de_passe mdp jeton secreto pin_code"
).split()
_OTHER_NAMES = (
    "checksum etag commit base_commit last_good_sha digest integrity fixture_hash trace_id request_id build_id revision version label title message name"
    " path url host image logo color region format pattern content_hash blob thumbprint fingerprint sha sha256 md5 uuid span_id correlation_id"
    " primary_key key_name foreign_key sort_key cache_key token_count token_type max_tokens password_label password_hint secret_name secret_ref key_label token_url auth_mode"
).split()
# What placeholders are put together from, and the schemes of references to stores.
_ASKS = "change insert put enter replace add paste use set fill".split()
_THINGS = "password token secret key api-key apikey credential passphrase value pw".split()
_STORES = "vault ssm secretsmanager keyring op sops env file gcp-sm azure-kv kms credstash pass config".split()


class _Writer:
    """Lines of code and configuration with marked credentials."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, *choices):
        return self.r.choice(choices)

    def chars(self, letters: str, n: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(n))

    def word(self) -> str:
        return self.r.choice(_PLAIN) if self.r.random() < 0.6 else "".join(self.r.sample(_SYLLABLES, self.r.randint(2, 3)))

    def cased(self, name: str, style: str | None = None) -> str:
        style = style or self.pick("snake", "camel", "upper", "camel", "kebab" if self.r.random() < 0.1 else "snake")
        parts = name.split("_")
        if style == "camel":
            name = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == "upper":
            name = name.upper()
        elif style == "kebab":
            name = "-".join(parts)
        elif style == "flat":
            name = "".join(parts)
        return name + (str(self.r.randint(0, 99)) if style != "kebab" and self.r.random() < 0.25 else "") + (f"_{self.r.randint(1, 99)}" if self.r.random() < 0.1 else "")

    def key_name(self) -> str:
        name = self.r.choice(_SECRET_NAMES)
        if self.r.random() < 0.2:
            name = self.word() + "_" + name
        return self.cased(name, "flat" if self.r.random() < 0.12 else None)

    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    @property
    def alnum(self) -> str:
        return self.low + self.low.upper() + self.num

    def credential(self) -> str:
        r, a = self.r, self.alnum
        kind = r.randrange(17)
        if kind == 0:
            return self.chars("0123456789abcdef", r.choice([32, 40, 64]))
        if kind == 1:
            return "gh" + self.pick("p", "o", "u", "s", "r") + "_" + self.chars(a, 36)
        if kind == 2:
            return "xox" + self.pick("b", "p", "a") + "-" + self.chars(self.num, 11) + "-" + self.chars(a, 24)
        if kind == 3:
            return self.pick("AK", "AS") + "IA" + self.chars(self.low.upper() + self.num, 16)
        if kind == 4:
            return self.pick("sk-", "sk-proj-", "sk_live_", "sk_test_", "rk_live_", "rk_test_") + self.chars(a, r.choice([24, 40]))
        if kind == 5:
            return "AI" + "za" + self.chars(a + "_-", 35)
        if kind == 6:
            return "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJ" + self.chars(a, r.randint(20, 50)) + "." + self.chars(a + "_-", 43)
        if kind in (7, 8):
            return self.chars(a + "+/", r.choice([42, 30, 22])) + "=="[: r.randint(0, 2)]
        if kind in (9, 10):
            return f"{self.word()}-{self.word()}-{r.randint(0, 999):03d}"
        if kind in (11, 12):
            return f"{self.word().title()}{self.pick('#', '!', '*', '%', '_', '-', '+', '@', '$', '&')}{r.randint(0, 9999):04d}{self.word()}"
        if kind == 13:
            return self.chars(a, r.randint(8, 18))
        if kind == 14:  # what people choose
            return self.pick(f"{self.word()}{r.randint(1, 9999)}", f"{self.word()}{self.pick('_', '-', '.', '')}{self.word()}{r.randint(1, 99)}", f"{self.word().title()}{r.randint(1, 999)}{self.pick('!', '#', '$', '')}")
        if kind == 15:
            return f"{self.word().title()}{self.pick('_', '#', '-', '.')}{r.randint(1000, 9999)}{self.word()}"
        return self.chars(a, 1) + self.chars(a + "!#%*^~", r.randint(8, 16)) + self.chars(a, 1)

    def dummy(self) -> str:
        """A placeholder: a request to put something in its place, or a word that says that it is none."""
        r, thing, gap = self.r, self.r.choice(_THINGS), self.pick("-", "_", "", " ")
        words = self.pick(
            ["your", thing], ["your", thing, "here"], [thing, "here"], [r.choice(_ASKS), thing], [r.choice(_ASKS), "your", thing], [r.choice(_ASKS), "with", "your", thing], [r.choice(_ASKS), "me"],
            [r.choice(_ASKS), "me", self.pick("in", "before", "for"), self.word()], ["not", "a", "real", thing], ["not", "the", thing], ["no", thing], ["my", thing], ["my", self.word(), thing], ["fake", thing], ["dummy", thing],
            ["example", thing], ["sample", thing], ["test", thing], ["some", thing], ["use", "your", "own", thing], [thing, "goes", "here"], ["replace", "with", self.pick("real", "actual", "your"), thing],
            [self.pick("changeme", "example", "placeholder", "redacted", "todo", "tbd", "none", "test", "dummy", "secret", "password", "unset", "empty", "null", "hidden", "removed", "fixme")],
        )
        return (gap.join(words).upper() if r.random() < 0.3 else gap.join(w.title() for w in words) if r.random() < 0.1 else gap.join(words)) + self.pick("", "", "", "!", "...")

    def reference(self) -> str:
        """Where a secret is kept."""
        path = "/".join(self.word() for _ in range(self.r.randint(1, 3)))
        return self.pick(f"{self.r.choice(_STORES)}:{path}", f"{self.r.choice(_STORES)}://{path}", f"{self.r.choice(_STORES)}:/{path}", f"{self.word()}-store/{path}", f"secrets/{path}", f"arn:aws:{self.r.choice(_STORES)}:{path}", f"/run/secrets/{path}")

    def not_credential(self) -> str:
        r, a = self.r, self.alnum
        kind = r.randrange(16)
        if kind < 3:
            return self.dummy()
        if kind == 3:
            return "<" + r.choice(["your-api-key", "password", "token", "secret", "api-key", "your-token"]) + ">"
        if kind == 4:
            return self.pick("x", "X", "*", "0", "-", ".") * r.randint(6, 30)
        if kind == 5:
            return self.pick("${", "$", "%(", "#{", "{{") + self.key_name().upper() + self.pick("}", "")
        if kind == 6:
            return "{{ " + self.cased(self.word() + "_secret", "upper") + " }}"
        if kind == 7:
            return self.reference()
        if kind == 8:
            return self.pick("gh" + "p_", "gh" + "s_", "sk-", "sk" + "_live_", "xox" + "b-") + self.pick("X", "x", "0") * r.randint(20, 40)
        if kind == 9:
            return self.pick("AK", "AS") + "IA" + self.pick("EXAMPLE" * 2 + "00", "XXXXXXXXXXXXXXXX", "IOSFODNN7EXAMPLE", "0000000000000000")
        if kind < 13:
            return self.pick("Please type your {} again", "Forgot your {}?", "The {}s do not match", "Enter a {}", "Wrong {} or user name", "Your {} has expired", "Invalid {}", "Show the {}", "Reset {}").format(self.pick("password", "token", "secret", "key", "passphrase"))
        if kind == 13:
            return ""
        return self.word() + self.pick("", " ", "_", "/", "-") + self.word()

    def hash_like(self) -> str:
        r = self.r
        kind = r.randrange(8)
        if kind < 3:
            return self.chars("0123456789abcdef", r.choice([32, 40, 40, 64]))
        if kind == 3:
            return "sha512-" + self.chars(self.alnum + "+/", 86) + "=="
        if kind == 4:
            return "sha256:" + self.chars("0123456789abcdef", 64)
        if kind == 5:
            return "-".join(self.chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        if kind == 6:
            return "data:" + self.pick("image/png", "font/woff2", "image/gif") + ";base64," + self.chars(self.alnum + "+/", r.randint(40, 120))
        return self.chars("0123456789abcdef", 12)

    def pem(self, private: bool) -> str:
        kind = self.pick("RSA PRIVATE KEY", "EC PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY") if private else self.pick("PUBLIC KEY", "CERTIFICATE", "RSA PUBLIC KEY")
        line = self.pick("\n", "\n", "\\n")
        body = line.join(self.chars(self.alnum + "+/", 64) for _ in range(self.r.randint(1, 4)))
        if line == "\n" and self.r.random() < 0.2:  # one literal a line
            line = '\\n" +\n  "'
            body = line.join(self.chars(self.alnum + "+/", 64) for _ in range(self.r.randint(1, 4)))
        end = f"{line}-----END {kind}-----" if self.r.random() < 0.7 else ""
        return f"-----BEGIN {kind}-----{line}{body}{end}"

    def ordinary(self) -> str:
        """A line without any credential."""
        w, r = self.word, self.r
        a, b, c = w(), w(), w()
        return r.choice([
            lambda: f"  const {a}{r.randint(0, 9)} = {b}{c.title()}({w()}, {r.randint(0, 99)});",
            lambda: f"import {{ {a}{b.title()}Key }} from \"@/{c}/{w()}-{w()}{r.randint(0, 400)}\";",
            lambda: f"from apps.{a}.src.{b}.{c}_{w()}{r.randint(0, 300)} import {w()}_{w()}_key",
            lambda: f"export async function {a}{b.title()}Token({c}: any, limit?: number) {{",
            lambda: f"    throw new Error('{a} {b} is missing')",
            lambda: f"def {a}_{b}_key({c}: str, limit: int = {r.randint(1, 99)}):",
            lambda: f"for {a}_item in {b}.{a}_list:",
            lambda: f"INSERT INTO {a}_key VALUES ({r.randint(0, 99)}, '{self.chars(self.alnum, 10)}', {r.randint(1, 99999)}, '{self.chars('0123456789abcdef', 12)}');",
            lambda: f"  {{ id: {r.randint(1, 99)}, lat: {r.random() * 90:.5f}, lon: -{r.random() * 90:.5f}, code: \"{self.chars(self.low.upper() + self.num, 6)}\" }},",
            lambda: f"  \"{a}_{b}\": \"./{c}/{{id}}\",",
            lambda: f"  \"{a}_key\": {{",
            lambda: f"{a}.{b} = `${{{a}.{c}}}/{w()}`;",
            lambda: f"// The {a} key may be stale here. See the note on {b} token.",
            lambda: f"  if ({a}.key > {r.randint(1, 99)} && {a}.token !== null) {{",
            lambda: f"MAX_{a.upper()}_KEY = {r.randint(1, 999)}",
            lambda: "    \"" + self.chars(self.alnum + "+/", 76) + "\" +",
            lambda: f"{a}_{r.randint(0, 9)}: \"*/5 * * * *\"",
            lambda: f"  {a}_{r.randint(0, 9)}: [1, 2, 3]",
            lambda: f"# {a} {b}",
            lambda: f"const {{ {a}{b.title()} }} = require(\"../{c}/{w()}-{w()}\");",
            lambda: f"CREATE TABLE {a}_token (id BIGINT PRIMARY KEY, {b}_key TEXT NOT NULL);",
            lambda: f"{self.pick('', 'export ')}class {a.title()}{b.title()}{self.pick('Engine', 'Store', 'Client', 'Service')}{self.pick(' {', ':', f' extends {c.title()}{w().title()}Manager {{', f'({c.title()}{w().title()}Planner):')}",
            lambda: f"from libs.{a}_{b}.lib.{c}.{w()}_{w()}_{w()}{r.randint(1, 400)} import {w()}_{w()}",
            lambda: f"import {{ {a}{b.title()} }} from {self.pick(chr(39), chr(34))}{self.pick('./', '../', '@/')}{a}-{b}/{self.pick('src', 'lib', 'tests')}/{c}/{w()}{self.pick('-', '_')}{w()}{self.pick('-', '_')}{w()}{r.randint(1, 400)}';",
            lambda: f"const {{ {a}{c.title()} }} = require({self.pick(chr(39), chr(34))}{self.pick('./', '../', '@/')}{a}-{b}/src/{c}/{w()}-{w()}-{w()}{r.randint(1, 400)}');",
            lambda: f"{self.pick('const iconPath = ', 'ICON_PATH = ')}\"" + "L".join(f"{'M' if not i else ''}{r.randint(1, 99)}.{r.randint(0, 9)}" for i in range(4)) + " " + " ".join(f"{r.randint(1, 99)}.{r.randint(0, 9)}L{r.randint(1, 99)}" for _ in range(8)) + "\";",
            lambda: f"//# sourceMappingURL={a}-{b}{r.randint(1, 400)}.js.map",
            lambda: f"module.exports = \"{self.chars(self.alnum + '+/', r.randint(40, 160))}\";",
            lambda: f"{self.pick('// ', '# ', '-- ')}{self.pick('reverted in', 'see', 'fixed by', 'since', 'cherry-picked from')} {self.pick(self.chars('0123456789abcdef', 40), self.chars('0123456789abcdef', 7), '-'.join(self.chars('0123456789abcdef', n) for n in (8, 4, 4, 4, 12)))}",
            lambda: f"const {self.pick('deviceId', 'traceId', 'requestId', 'userId', 'tenantId', 'orderUuid')} = \"{'-'.join(self.chars('0123456789abcdef', n) for n in (8, 4, 4, 4, 12))}\";",
            lambda: (lambda v: f"  {v}.{b} = {v}.{b}.replace(/{self.pick(chr(92) + 's+', '[({]+', '^[^}]*', chr(92) + ')$')}/g, {self.pick(chr(39), chr(34))}{self.pick('', '-', '(', '}')}');")(f"{a}{r.randint(0, 9)}"),
            lambda: f"  for (const {a}Item of {b}{r.randint(0, 9)}.{a}List) {{",
            lambda: f"{self.pick('', '    ', '        ')}{self.pick('return', 'yield', 'await', 'throw', 'raise', 'del', 'assert', 'print')} {a}{r.randint(0, 99)}{self.pick('', ';')}",
            lambda: f"    {a} = {self.pick('os.getenv', 'os.environ.get', 'config.get', 'getenv')}(\"{b.upper()}_{self.pick('SECRET', 'TOKEN', 'KEY', 'PASSWORD')}\"{self.pick('', ', ' + chr(34) * 2, ', None')})",
            lambda: f"  {a}{r.randint(0, 9)}.{b} = {{\"{c}\": [{r.randint(0, 9)}, {r.randint(0, 9)}], \"open\": \"(\"}}",
            lambda: f"  extends {a.title()}{b.title()}Builder implements {c.title()}Key",
            lambda: "",
        ])()

    def pieces(self, secret: str) -> list:
        """A credential spread over literals that are put together again."""
        count = min(self.r.choice([2, 2, 2, 3, 3, 4, 6, 8, 10]), max(2, len(secret) // 2))
        cuts = sorted(self.r.sample(range(1, len(secret)), count - 1))
        parts = [secret[a:b] for a, b in zip([0, *cuts], [*cuts, len(secret)])]
        q = self.pick('"', "'")
        start, between, end = self.pick(
            (q, f"{q} + {q}", q), (q, f"{q} +\n    {q}", q), (f"[\n  {q}", f"{q},\n  {q}", f"{q},\n].join({q}{q})"), (f"[{q}", f"{q}, {q}", f"{q}].join({q}{q})"), (f"(\n    {q}", f"{q}\n    {q}", f"{q}\n)"), (f"{q}{q}.join([{q}", f"{q}, {q}", f"{q}])"),
        )
        found: list = [start]
        for part in parts:
            found += [(part,), between]
        return [*found[:-1], end]

    def assignment(self, name: str, value: list) -> list:
        r = self.r
        head = self.pick(f"const {name} = ", f"let {name} = ", f"{name} = ", f"  {name} = ", f"export const {name} = ", f"var {name} = ", f"self.{name} = ", f"static final String {name} = ", f"{name} := ")
        return [head, *value, self.pick(";", "", "", ";")]

    def quoted(self, text: str, marked: bool) -> list:
        q = self.pick('"', '"', "'", "`")
        return [q, (text,) if marked else text, q]

    def sample(self) -> list:
        """One statement as a list of plain strings and marked pieces (one-tuples)."""
        r = self.r
        marked = r.random() < 0.5
        value = self.credential() if marked else self.not_credential()
        m = (lambda s: (s,)) if marked else (lambda s: s)
        kind = r.randrange(36)
        name = self.key_name()
        host = self.pick("db", "cache", "queue", "mail", "api") + self.pick(".example.internal", ".example.test", ".local", "")
        user = self.pick("app", "svc", "admin", "batch", "root", self.word())
        if kind < 6:
            return self.assignment(name, self.quoted(value, marked))
        if kind == 6:
            return self.assignment(name, self.pieces(value)) if marked else self.assignment(name, self.quoted(value, False))
        if kind == 7:
            return self.assignment(name, self.pieces(self.credential()))
        if kind in (8, 9):  # a hash or other data under a name of its own
            return self.assignment(self.cased(r.choice(_OTHER_NAMES)), self.quoted(self.hash_like(), False))
        if kind == 10:
            return self.assignment(name, [self.pick(f"process.env.{name} || ", f'os.environ.get("{name}", ', f'os.getenv("{name}", ', f"process.env.{name} ?? "), *self.quoted(value, marked)])
        if kind == 11:
            return self.assignment(name, [self.pick("process.env." + name, f'os.environ["{name}"]', f'{self.pick("read", "load", "fetch", "get")}_{self.pick("secret", "key")}("{self.reference()}")', f"nextToken({r.randint(1, 99)})", f"get_token({self.word()})", f"{self.word()}.{self.cased(self.word() + '_token')}", f"input(\"{self.word()}: \")")])
        if kind == 12:
            return [self.pick("  ", "") + f'"{name}": "', m(value), '",']
        if kind == 13:
            q = self.pick('"', "'", "")
            if q == "" and not re.fullmatch(r"[\w\-./+=#*!%]*", value):
                q = '"'
            return [f"{self.pick('', '  ', '- ')}{name}: {q}", m(value), q]
        if kind == 14:
            return [f"- name: {name}\n  value: {self.pick(chr(39), chr(34))}", m(value), "'"] if marked or r.random() < 0.5 else [f"- name: {name}\n  valueFrom: {self.reference()}"]
        if kind == 15:
            return [f"{self.pick('export ', '', '# export ')}{name}=", *(self.quoted(value, marked) if r.random() < 0.6 or not re.fullmatch(r"[\w\-./+=#*!%]+", value) else [m(value)])]
        if kind in (16, 17):
            scheme = self.pick("postgres", "mysql", "amqp", "redis", "mongodb", "https")
            secret = self.pick(self.chars(self.alnum, r.randint(8, 16)), self.credential()) if marked else self.pick("${pw}", "{pw}", "${QUEUE_PW}", "<password>", "****", "${DB_PASS}")
            if marked and not re.fullmatch(r"[\w\-.*!~]+", secret):
                secret = self.chars(self.alnum, 12)
            q = self.pick('"', "'", "`", 'f"', "")
            return [f"{self.pick('const dsn = ', 'DSN = ', 'dsn: ', 'url = ')}{q}{scheme}://{user}:", m(secret), f"@{host}:{r.randint(1000, 9999)}/main{q[-1:]}"]
        if kind == 18:
            return [f"{self.pick('const headers = { Authorization: ', 'HEADERS = {' + chr(34) + 'Authorization' + chr(34) + ': ')}\"Bearer ", m(value if marked else self.pick("${token}", "xxxxxxxxxxxxxxxx", "<token>", "{token}")), '" }']
        if kind == 19:
            pair = base64.b64encode(f"{user}:{self.chars(self.alnum, r.randint(8, 14))}".encode()).decode()
            return [f"{self.pick('const auth = ', 'AUTH = ', 'Authorization: ')}\"Basic ", m(pair if marked else self.pick("${encoded}", "xxxxxxxx", "<base64>", "{pair}")), '";']
        if kind == 20:
            return [f"{self.pick('curl -s -H ', 'curl -H ')}\"{self.pick('X-Api-Key: ', 'Authorization: Bearer ', 'X-Auth-Token: ')}", m(value if marked else self.pick("$TOKEN", "<your-api-key>", "xxxxxxxxxxxxxxxx", self.dummy().replace(" ", "-"), "$API_KEY")), f'" https://{host}/v1/ping']
        if kind == 21:
            return [f"curl -s -u {user}:", m(self.chars(self.alnum, r.randint(8, 14))) if marked else self.pick('"$PW"', "$PASSWORD", "<password>"), f" https://{host}/health"]
        if kind == 22:
            return [f"{self.pick('// ', '# ', '-- ')}{self.pick('', self.pick('old ', 'new ', 'prod ', 'staging ', 'legacy ', 'temporary ', 'current ', 'backup '))}{self.pick('key', 'password', 'token', 'secret', 'login', 'pw')}{self.pick(': ', ' is ', ' = ', ', works: ', ', valid until ' + self.word() + ': ')}", m(value)]
        if kind == 23:
            return [f"ALTER {self.pick('ROLE', 'USER')} {user}_{r.randint(1, 99)} WITH PASSWORD '", m(value), "';"]
        if kind == 24:
            return [f"{self.pick('connect', 'Client', 'session = connect')}(\"{host}\"{self.pick(').login(', ', user=')}\"{user}\", {self.pick('', 'password=', name.lower() + '=')}\"", m(value), '");']
        if kind == 25:
            return [f"var cfg{r.randint(1, 999)} = \"", m(value if marked else self.hash_like()), '" // ' + (name if marked else self.pick("checksum", "commit", "digest", "etag", "fixture", "trace"))]
        if kind == 26:
            secret = self.chars(self.alnum, r.randint(8, 16))
            return [f"'Server={host};Database=main;User Id={user};{self.pick('Pwd', 'Password')}=", m(secret) if marked else self.pick("${pw}", "{0}", "****"), ";Encrypt=true';"]
        if kind == 27:
            return [self.pick("const pem = `", 'PEM = """', "tls_key: |\n  ", 'const key = "'), m(self.pem(marked)), self.pick("`;", '"""', "", '";')]
        if kind == 28:
            return [f"{{ user: \"{user}\", {name}: \"", m(value), '" };']
        if kind == 29:
            secret = self.chars(self.alnum, r.randint(16, 32)) if marked else self.pick("${key}", "<key>", "{api_key}", "xxxxxxxx")
            return [f"const {self.word()}Url = `https://{host}/v1/{self.word()}{self.pick('?', '?format=csv&', '?id=7&')}{self.pick('api_key', 'token', 'access_token', 'key', 'sig', 'signature', 'apikey', 'auth')}=", m(secret), self.pick("`;", '"', "&page=2`", "'")]
        if kind in (31, 32):  # a credential in a remark
            who = self.pick("ops", "the team", "support", "the admin", "we", "they", self.word())
            before = self.pick("", "", who + " " + self.pick("gave", "sent", "asked for", "want us to", "told me to", "always") + " ", "todo ", "TODO ", "fixme ", "note: ", "hint: ", "temp: ", "ask " + self.word() + " to ")
            verb = self.pick("rotate", "revoke", "replace", "remove", "use", "try", "expire", "swap", "drop", "keep", "login with", "works with", "valid: ", "was", "still valid:", "told to use", "reset to")
            return [f"{self.pick('', '    ', chr(9))}{self.pick('// ', '# ', '-- ', '/* ', '* ')}{before}{verb} ", m(value if marked else self.pick(self.word(), self.dummy(), self.reference(), f"{self.word()} {self.word()}", f"{self.word()}.{self.cased(self.word() + '_' + self.word())}"))]
        if kind == 33:  # data kept in code, a literal a line
            lines = [self.chars(self.alnum + "+/", 76) for _ in range(r.randint(1, 4))] + [self.chars(self.alnum + "+/", r.randint(4, 76)) + self.pick("", "=", "==")]
            start, between, end = self.pick(('"', '" +\n  "', '";'), ("'", "' +\n    '", "';"), ('(\n    "', '"\n    "', '"\n)'), ('[\n  "', '",\n  "', '",\n].join("")'))
            where = self.pick("icon", "logo", "font", "image", "sprite", "wasm", "data", "blob", "payload", "table", "chart", "map", self.word(), self.word())
            return [self.pick(f"export const {where.upper()} =\n  ", f"const {where}{r.randint(0, 99)} =\n  ", f"{where.upper()}_DATA = ", f"module.exports = ", f"const {where} = decode("), start, between.join(lines), end]
        if kind == 34:
            return self.assignment(name, self.pieces(self.credential()))
        if kind == 30:  # opaque values beside harmless names
            return [self.pick(f'{{ id: "{self.word()}", hash: "', f'"{self.cased(r.choice(_OTHER_NAMES))}": "', f"{self.word()}_{r.randint(1, 99)}: \""), self.hash_like(), '",']
        return [self.pick("For staging, set `", "Set `", "Run with `"), f"{name.upper()}=", m(value), self.pick("` first.", "` in your shell.")]


_DOUBTFUL = re.compile(
    r"(?i)-----BEGIN|(?:passw|secret|token|api_?key|pwd|credential|auth|passphrase|signature)\w*[\"']?\s*(?:[:=]|=>|,|\()\s*[^\s]*[\"'`][^\"'`\s]{5,}[\"'`]|://[^\s/:]+:[^\s/@]+@|\b(?:basic|bearer) [a-z0-9+/=._-]{8,}"
    r"|\b(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk[-_]|eyJ)[\w-]{12,}"
)
_ORDINARY_FILES = re.compile(r"\.(?:py|[cm]?js|ts|tsx|json|ya?ml|sh|md|css|sql|go|toml|cfg|ini)$")


def ordinary_texts(folders: list[str], most: int = 6000, seed: int = TRAINING_SEED) -> list[list[str]]:
    """Lines of up to ``most`` files of the folders, drawn by a seed; tests and key stores are left out."""
    paths = [
        os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder) for name in names
        if _ORDINARY_FILES.search(name) and not re.search(r"(?i)[\\/](?:tests?|__pycache__|testing|fixtures?)[\\/]", at + "/")
    ]
    paths.sort()
    found = []
    for path in random.Random(seed).sample(paths, min(most, len(paths))):
        try:
            text = Path(path).read_text("utf-8")
        except (OSError, UnicodeDecodeError):
            continue
        if 0 < len(text) < 1_000_000:
            found.append(text.split("\n"))
    return found


def _chunk(writer: _Writer, texts: list[list[str]], least: int, most: int) -> str:
    """Some neighbouring lines of an ordinary file that hold nothing like a credential."""
    for _ in range(20):
        lines = writer.r.choice(texts)
        at = writer.r.randrange(len(lines))
        chunk = "\n".join(lines[at : at + writer.r.randint(least, most)])
        if len(chunk) < 2000 and not _DOUBTFUL.search(chunk):
            return chunk
    return ""


def labelled(parts: list) -> tuple[list[str], np.ndarray]:
    """Tokens and labels of a list of plain strings and marked pieces (one-tuples)."""
    text, spans, first = "", [], True
    for part in parts:
        if isinstance(part, tuple):
            spans.append((len(text), len(text) + len(part[0]), first))
            text += part[0]
            first = False
        else:
            text += part
            if "\n" in part and not part.startswith(('"', "'", "[", "(")):
                first = True
    tokens, labels = [], []
    for m in LEXER.finditer(text):
        # a frame's token may reach beyond the marked piece, never before it
        inside = [s for s in spans if s[0] <= m.start() < s[1]]
        tokens.append(m[0])
        labels.append((B if m.start() == inside[0][0] and inside[0][2] else I) if inside else O)
    marks = np.array(labels, np.int8)
    hits = np.flatnonzero(marks)
    for a, b in zip(hits, hits[1:]):
        if marks[b] == I:
            marks[a + 1 : b] = G
    return tokens, marks


def training_lines(lines: int = TRAINING_LINES, seed: int = TRAINING_SEED, texts: list[list[str]] = (), chunks: int = 0) -> list[tuple[list[str], np.ndarray]]:
    """Token sequences with labels: ``lines`` statements among ordinary lines, and ``chunks`` of ordinary text without any."""
    writer = _Writer(seed)

    def around() -> list:
        if texts and writer.r.random() < 0.5:
            chunk = _chunk(writer, texts, 1, 4)
            return [chunk, "\n"] if chunk else []
        return [x for _ in range(writer.r.randint(0, 2)) for x in (writer.ordinary() if writer.r.random() < 0.8 else "", "\n")]

    found = []
    for _ in range(lines):
        parts = [*around(), *writer.sample(), "\n"]
        if writer.r.random() < 0.4:
            parts += [*writer.sample(), "\n"]
        found.append(labelled([*parts, *around()]))
    found += [labelled([_chunk(writer, texts, 3, 12)]) for _ in range(chunks if texts else 0)]
    return [pair for pair in found if pair[0]]


def _ragged(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows) + 1, max(map(len, rows))), np.int64)
    for i, row in enumerate(rows):
        out[i + 1, : len(row)] = row
    return out


class _Bucket:
    """Training sequences of similar length, padded."""

    def __init__(self, data: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n, width = len(data), max(len(p) for p, _ in data)
        self.places, self.gold = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        for i, (places, labels) in enumerate(data):
            self.places[i, : len(places)], self.gold[i, : len(places)] = places, labels
        self.live = np.arange(width)[None] < np.array([len(p) for p, _ in data])[:, None]
        self.onehot = np.eye(4, dtype=np.float32)[self.gold] * self.live[..., None]
        self.moves = np.array([[((self.gold[:, :-1] == a) & (self.gold[:, 1:] == b) & self.live[:, 1:]).sum() for b in range(4)] for a in range(4)], float)

    def gradient(self, rows: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Error of each place and label (gold less expected), and of the moves: forward and backward sums."""
        live, (n, width) = self.live, self.places.shape
        emission = score(self.places, rows)
        local = np.exp(emission - emission.max(2, keepdims=True))
        power = np.where(ALLOWED, np.exp(moves), 0).astype(np.float32)
        alpha, beta = np.zeros((n, width, 4), np.float32), np.zeros((n, width, 4), np.float32)
        state = local[:, 0] * STARTS
        for t in range(width):
            if t:
                state = np.where(live[:, t, None], (state @ power) * local[:, t], state)
            state = state / state.sum(1, keepdims=True)
            alpha[:, t] = state
        state = np.tile(ENDS.astype(np.float32), (n, 1))
        beta[:, width - 1] = state
        for t in range(width - 2, -1, -1):
            following = (state * local[:, t + 1]) @ power.T
            state = np.where(live[:, t + 1, None], following / following.sum(1, keepdims=True), state)
            beta[:, t] = state
        posterior = alpha * beta
        posterior /= posterior.sum(2, keepdims=True)
        joint = alpha[:, :-1, :, None] * power * (local[:, 1:] * beta[:, 1:])[:, :, None, :]
        joint *= (live[:, 1:] / np.maximum(joint.sum((2, 3)), 1e-30))[..., None, None]
        return (self.onehot - posterior) * live[..., None], self.moves - joint.sum((0, 1))


def train(lines: int = TRAINING_LINES, seed: int = TRAINING_SEED, rounds: int = ROUNDS, folders: list[str] = (), chunks: int = TRAINING_CHUNKS) -> dict[str, np.ndarray]:
    """Weights fitted to the training lines; with ``folders``, once more with the ordinary lines that the first fit took for credentials."""
    texts = ordinary_texts(folders) if folders else []
    data = training_lines(lines, seed, texts, chunks)
    weights = fit(data, rounds)
    if texts:
        taken = []
        for whole, pieces in zip(texts, label_texts(["\n".join(t) for t in texts], Scores(weights))):
            text = "\n".join(whole)
            for at in sorted({text.count("\n", 0, start) for start, _, label in pieces if label == B}):
                chunk = "\n".join(whole[max(0, at - 2) : at + 3])
                if len(chunk) < 2000 and not _DOUBTFUL.search(chunk):
                    taken.append(chunk)
        random.Random(seed).shuffle(taken)
        weights = fit(data + [labelled([chunk]) for chunk in taken[:chunks]], rounds)
    return weights


def fit(sequences: list[tuple[list[str], np.ndarray]], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights that maximise the penalised likelihood of labelled sequences (Adam over all of them)."""
    names: dict[str, int] = {}
    data = sorted(
        ((np.array([names.setdefault(plain(t), len(names) + 1) for t in tokens]), labels) for tokens, labels in sequences),
        key=lambda pair: len(pair[0]),
    )
    buckets = [_Bucket(data[i : i + 250]) for i in range(0, len(data), 250)]
    places = Places().__getitem__
    each = [[list(map(places, part)) for part in token_features(t)] for t in names]
    features = [_ragged([row[k] for row in each]) for k in range(3)]
    used, at = zip(*(np.unique(f, return_inverse=True) for f in features))
    at = [a.reshape(f.shape) for a, f in zip(at, features)]
    size, offsets = len(names) + 1, len(OFFSETS)
    widths = (4, offsets * 4, 8)
    params = [np.zeros((len(u), w), np.float32) for u, w in zip(used, widths)] + [np.zeros((4, 4))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    orders = [np.argsort(a.ravel(), kind="stable") for a in at]
    begins = [np.searchsorted(a.ravel()[order], np.arange(len(u))) for a, order, u in zip(at, orders, used)]

    def spread(place: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each token's features (feature 0 is none)."""
        total = np.zeros((size, weights.shape[1]), np.float32)
        for column in place.T:
            total += weights[column]
        return total

    def gather(k: int, errors: np.ndarray) -> np.ndarray:
        """Sum over tokens of the errors at each feature."""
        sums = np.add.reduceat(errors[orders[k] // at[k].shape[1]], begins[k])
        sums[0] = 0
        return sums

    def cut(table: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        return (table[:, :offset], table[:, -offset:]) if offset < 0 else (table[:, offset:], table[:, : table.shape[1] - offset])

    columns = [0, *OFFSETS]
    sources = [np.concatenate([cut(b.places, o)[0].ravel() for b in buckets if abs(o) < b.places.shape[1]]) for o in columns]
    everywhere = sources[0]
    for step in range(1, rounds + 1):
        rows = np.concatenate([spread(a, p) for a, p in zip(at, params)], 1).reshape(size, COLUMNS, 4)
        results = [bucket.gradient(rows, params[3]) for bucket in buckets]
        errors = np.zeros((size, COLUMNS, 4), np.float32)
        for k, offset in enumerate(columns):
            target = np.concatenate([cut(e, offset)[1].reshape(-1, 4) for e, _ in results if abs(offset) < e.shape[1]])
            for label in range(4):
                errors[:, k, label] = np.bincount(sources[k], target[:, label], size)
        for k, (low, high) in ((-2, (1, BEFORE)), (-1, (-AFTER, -1))):
            target = np.concatenate([_sums(e, low, high).reshape(-1, 4) for e, _ in results])
            for label in range(4):
                errors[:, k, label] = np.bincount(everywhere, target[:, label], size)
        moves = sum(pair for _, pair in results)
        gradients = (gather(0, errors[:, 0]), gather(1, errors[:, 1:-2].reshape(size, -1)), gather(2, errors[:, -2:].reshape(size, -1)), moves * ALLOWED)
        for p, g, m1, m2, penalty in zip(params, gradients, first, second, (0.3, 0.5, 0.5, 0.05)):
            g = g - penalty * p
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.98
            m2 += 0.02 * g * g
            p += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.98**step)) + 1e-6)
    own, context, pooled = np.zeros((HASH, 4), np.float32), np.zeros((offsets, HASH, 4), np.float32), np.zeros((2, HASH, 4), np.float32)
    own[used[0]] = params[0]
    context[:, used[1]] = params[1].reshape(-1, offsets, 4).transpose(1, 0, 2)
    pooled[:, used[2]] = params[2].reshape(-1, 2, 4).transpose(1, 0, 2)
    own[0], context[:, 0], pooled[:, 0] = 0, 0, 0
    return {"own": own, "context": context, "pooled": pooled, "moves": params[3]}


_MODELS: dict[tuple, dict[str, np.ndarray]] = {}


def save(weights: dict[str, np.ndarray], path: Path = WEIGHTS) -> None:
    """The rows of features that were learnt, to half precision."""
    rows = {name: np.flatnonzero(np.abs(weights[name]).reshape(-1, HASH, 4).sum((0, 2)) > 1e-3) for name in ("own", "context", "pooled")}
    np.savez_compressed(
        path, moves=weights["moves"], **{f"{name}_rows": r for name, r in rows.items()}, **{name: weights[name][..., r, :].astype(np.float16) for name, r in rows.items()}
    )


def load(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    held = np.load(path)
    found = {"moves": held["moves"]}
    for name, shape in (("own", (HASH, 4)), ("context", (len(OFFSETS), HASH, 4)), ("pooled", (2, HASH, 4))):
        found[name] = np.zeros(shape, np.float32)
        found[name][..., held[f"{name}_rows"], :] = held[name]
    return found


def model(lines: int | None = None, seed: int = TRAINING_SEED) -> dict[str, np.ndarray]:
    """The weights that are shipped; with ``lines``, weights trained on so many written lines alone. Kept for the process."""
    if (lines, seed) not in _MODELS:
        _MODELS[lines, seed] = load() if lines is None else train(lines, seed)
    return _MODELS[lines, seed]


# ---------------------------------------------------------------- applying

PADDING = max(BEFORE, AFTER) + 1
SLICE = 120_000  # characters that are scored at once, but for a longer text


def open_places(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Places that a best path may leave O for: those that some stretch covers whose gain is bounded by no less than 0.

    ``scores`` are those of B, I and G less O; texts are parted by places of far lower scores. The bound of a stretch adds
    the move into B, at each further place the best of the three states with the best move into it, and the best move out.
    """
    gain = np.where(ALLOWED, moves, NEVER) - moves[O, O]
    into, out = gain[1:, 1:].max(0), gain[1:, O].max()
    further = np.cumsum((scores + into[:, None]).max(0))
    before = np.maximum.accumulate(scores[0] + gain[O, B] - further)  # the best beginning no later
    after = np.maximum.accumulate(further[::-1])[::-1]  # the best end no earlier
    return before + after + out >= -1e-6


def _decode(scores: np.ndarray, begin: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Labels of all places, those of ``begin`` to ``end`` (both inside O on either side) by the recursion, the others O."""
    labels = np.zeros(scores.shape[1], np.int8)
    order = np.argsort(end - begin, kind="stable")
    at = 0
    while at < len(order):
        last = at
        while last < len(order) and (last == at or (last - at + 1) * (end[order[last]] - begin[order[last]] + 2) <= 200_000):
            last += 1
        chosen = order[at:last]
        lengths = end[chosen] - begin[chosen] + 2
        emission = np.zeros((len(chosen), int(lengths.max()), 4))
        for row, a, b in zip(emission, begin[chosen], end[chosen]):
            row[1 : b - a + 1, 1:] = scores[:, a:b].T
            row[0, 1:] = row[b - a + 1, 1:] = NEVER
        for row, a, b in zip(viterbi(emission, moves, lengths), begin[chosen], end[chosen]):
            labels[a:b] = row[1 : b - a + 1]
        at = last
    return labels


def _slices(texts: list[str]) -> Iterator[range]:
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield range(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield range(begin, len(texts))


#: Literals that are put together: parted by plus signs, commas, blanks and line ends only.
_CHAIN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"(?:\s*[+,.]?\s*\"(?:[^\"\\\n]|\\.)*\")+|'(?:[^'\\\n]|\\.)*'(?:\s*[+,.]?\s*'(?:[^'\\\n]|\\.)*')+")
_LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'")


def whole_chains(text: str, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``pieces`` with the rest of each chain of literals that holds two pieces of one credential: all of a chain or none."""
    joined = [k for k in range(1, len(pieces)) if pieces[k][2] == I and pieces[k][0] > pieces[k - 1][1] and re.search("[\"']", text[pieces[k - 1][1] : pieces[k][0]])]
    if not joined:
        return pieces
    found = dict.fromkeys((start, end) for start, end, _ in pieces)
    kinds = {(start, end): label for start, end, label in pieces}
    done = -1
    for k in joined:
        if pieces[k][0] < done:
            continue
        low = pieces[k - 1][0]
        for m in _CHAIN.finditer(text, max(0, text.rfind("\n\n", 0, low))):
            if m.start() > low:
                break
            if m.end() <= pieces[k][0]:
                continue
            first = True
            for literal in _LITERAL.finditer(text, m.start(), m.end()):
                span = literal.span(1 if literal[1] is not None else 2)
                for old in [x for x in found if span[0] <= x[0] < span[1]]:
                    del found[old]
                found[span] = None
                kinds[span] = B if first else I
                first = False
            done = m.end()
            break
    return sorted((start, end, kinds[start, end]) for start, end in found)


def label_texts(texts: list[str], scores: Scores) -> list[list[tuple[int, int, int]]]:
    """Labelled pieces ``(start, end, label)`` of each text, label B or I."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for part in _slices(texts):
        if scores.count > scores.LIMIT:
            scores.reset()
        joined = "\0".join([texts[i] for i in part])
        offsets = np.cumsum([0, *[len(texts[i]) + 1 for i in part]])
        begin, end, hashes = cut(joined)
        owner = np.repeat(np.arange(len(part)), np.diff(np.searchsorted(begin, offsets)))
        inside = begin < offsets[owner + 1] - 1  # not what parts the texts
        begin, end, owner = begin[inside], end[inside], owner[inside]
        at = np.arange(len(begin)) + PADDING * (owner + 1)
        flat = np.zeros(len(begin) + PADDING * (len(part) + 1), np.int64)
        flat[at] = scores.numbers(joined, begin, end, hashes[inside])
        each = scores.of(flat)
        each[:, flat == 0] = -1e4
        open_at = open_places(each, scores.moves)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], open_at, [0])).astype(np.int8)))
        if not len(edges):
            continue
        labels = _decode(each, edges[::2], edges[1::2], scores.moves)[at]
        for k in np.flatnonzero((labels == B) | (labels == I)):
            i = owner[k]
            found[part[i]].append((int(begin[k] - offsets[i]), int(end[k] - offsets[i]), int(labels[k])))
        for i in {part[owner[k]] for k in np.flatnonzero(labels == I)}:
            found[i] = whole_chains(texts[i], found[i])
    return found


#: Escapes stay, and so does a plus sign between two literals.
_KEY_CHARACTERS = re.compile(r"(\\[nrt]|(?<![A-Za-z0-9+/=])\+(?![A-Za-z0-9+/=]))|([A-Za-z0-9+/=]+)")


def redact(text: str, pieces: list[tuple[int, int, int]]) -> str:
    """The text with each letter and digit of the pieces read as ``x``; key block frames and line ends stay."""
    out, at = [], 0
    for start, end, _ in pieces:
        piece = text[start:end]
        if piece.startswith("-----BEGIN"):
            head = piece.index("-----", 10) + 5
            tail = piece.rfind("-----END")
            tail = len(piece) if tail < 0 else tail
            hidden = piece[:head] + _KEY_CHARACTERS.sub(lambda m: m[1] or "x" * len(m[2]), piece[head:tail]) + piece[tail:]
        else:
            hidden = "x" * len(piece)
        out += [text[at:start], hidden]
        at = end
    return "".join(out) + text[at:]


_SCORES: dict[int, Scores] = {}


def _worker_scores(weights: dict[str, np.ndarray]) -> Scores:
    """One cache per worker process and model, shared by its tasks."""
    if id(weights) not in _SCORES:
        _SCORES.clear()
        _SCORES[id(weights)] = Scores(weights)
    return _SCORES[id(weights)]


def scan(files: DataFrame, *, id: str = "file_id", content: str = "content", lines: int | None = None, seed: int = TRAINING_SEED) -> DataFrame:
    """``(file_id, lines, redacted)`` of every row: the lines on which credentials begin, and the text without them.

    Lines are counted from 1 and parted by LF. Null content gives no lines and null, empty content no lines and the
    empty text; rows without a credential keep their text. Repeated rows are scanned each, other columns are not read, long texts are read whole.
    """
    shared = files.sparkSession.sparkContext.broadcast(model(lines, seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _worker_scores(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch["content"]]
            labelled = label_texts(texts, scores)
            yield pd.DataFrame({
                "file_id": batch["file_id"],
                "lines": [sorted({t.count("\n", 0, start) + 1 for start, _, label in pieces if label == B}) for t, pieces in zip(texts, labelled)],
                "redacted": [None if c is None else redact(c, pieces) if pieces else c for c, pieces in zip(batch["content"], labelled)],
            })

    return files.select(F.col(id).alias("file_id"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {files.schema[id].dataType.simpleString()}, lines array<int>, redacted string"
    )


def credential_lines(files: DataFrame, **options) -> DataFrame:
    """``(file_id, line)`` of each line on which a credential begins, once."""
    return scan(files, **options).select("file_id", F.explode("lines").alias("line")).distinct()


if __name__ == "__main__":
    import sys

    save(train(folders=[os.path.dirname(os.__file__), *sys.argv[1:]]))
