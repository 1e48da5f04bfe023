"""Symbols, imports and references of source files: one pass over (file, content), no shuffle."""

from __future__ import annotations

import ast
import bisect
import hashlib
import keyword
import re
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Symbol kinds that the parsers tell apart.
KINDS = "class interface type enum function method constant variable property component hook route".split()
# Kinds of references and imports.
REFERENCES = "call new extends implements jsx decorator".split()
IMPORTS = "static dynamic require type export_from".split()
_TS_MARK = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[`{}/]")
_TS_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TS_QUASI = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_TS_TOP = re.compile(
    r"^(?P<export>export\s+(?:default\s+)?)?(?:declare\s+|abstract\s+|async\s+)*(?:(?P<kind>class|interface|type|enum|function\*?)\s+(?P<name>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+(?P<var>[A-Za-z_$][\w$]*)(?P<typed>\s*:[^=\n]+)?\s*=\s*(?P<arrow>(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=>\n]+)?=>|(?:async\s+)?function\b)?)",
    re.M,
)
_TS_MEMBER = re.compile(
    r"(?P<mods>(?:(?:public|private|protected|static|readonly|async|override|get|set|abstract|declare|accessor)\b(?![^\S\n]*[(<=:;?!\n}])\s*|\*\s*)*)(?P<name>#?[A-Za-z_$][\w$]*|\"[^\"\n]*\"|'[^'\n]*'|\d+|\[[^\]\n]*\])[^\S\n]*[?!]?[^\S\n]*(?P<next>[(<:=]|(?=[;}\n])|\Z)"
)
_TS_ARROW = re.compile(r"\s*(?:async\b\s*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[A-Za-z_$][\w$]*)\s*(?::[^=>\n]+)?=>)")
_TS_IMPORT = re.compile(
    r"^\s*import\s+(?P<type>type\s+)?(?P<names>[^;\"']*?)\s*from\s*[\"'](?P<from>[^\"']+)[\"']|^\s*import\s*[\"'](?P<effect>[^\"']+)[\"']"
    r"|^\s*export\s+(?:\*(?:\s+as\s+\w+)?|\{(?P<re>[^}]*)\})\s*from\s*[\"'](?P<refrom>[^\"']+)[\"']|\brequire\(\s*[\"'](?P<req>[^\"']+)[\"']\s*\)|\bimport\(\s*[\"'](?P<dyn>[^\"']+)[\"']\s*\)",
    re.M,
)
_CALL = re.compile(r"(?<![\w$#])(?P<name>#?[A-Za-z_$][\w$]*)(?:\s*\?\.)?(?:<[^<>()=;/]*(?:<[^<>()=;/]*>[^<>()=;/]*)*>)?(?:\s*\(|(?=`))")
_NEW = re.compile(r"(?<![\w$.])new\s+([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)")
_HERITAGE = re.compile(r"(?<![\w$.])(?:class|interface)\s+[A-Za-z_$][\w$]*(?P<head>[^{;]*)\{")
_JSX = re.compile(r"<([A-Z][\w$]*(?:\.[\w$]+)*)(?=[\s/>])(?!\s+extends\b)")
_DECORATOR = re.compile(r"(?<![\w$@])@([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)")
# Receivers whose calls with a path declare routes.
_TS_ROUTE = re.compile(r"(?<![\w$])(?P<object>(?:[\w$]+\s*\.\s*)*(?:app|router|server|api|v\d+))\s*\.\s*(?P<verb>get|post|put|patch|delete|options|head|all)\s*(?:<[^<>()]*>)?\(\s*(?P<q>[\"'`])(?P<path>/[^\n]*?)(?P=q)", re.I)
_PY_NOISE = re.compile(r"#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_PY_CALL = re.compile(r"(?<!\w)(?<!def )(?<!class )([A-Za-z_]\w*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function typeof await super constructor import require delete void new throw in of do else case yield async".split())


def _short(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()[:240]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _bare(text: str) -> str:
    """``text`` at its length with comments, regular expressions and the insides of strings blanked; expressions within templates stay."""
    out, at, depths = [], 0, []

    def blank(upto: int, keep: str | None = None) -> None:
        nonlocal at
        part = text[at:upto]
        hidden = re.sub(r"[^\n]", " " if keep is None else "_", part)
        out.append(hidden if keep is None or len(part) < 2 else keep + hidden[1:-1] + keep)
        at = upto

    def quasi() -> None:
        nonlocal at
        end = _TS_QUASI.match(text, at).end()
        blank(end)
        if text.startswith("${", end):
            out.append("  ")
            at = end + 2
            depths.append(0)
        elif end < len(text):
            out.append("`")
            at = end + 1

    while m := _TS_MARK.search(text, at):
        out.append(text[at : m.start()])
        at, mark = m.start(), m[0]
        if mark == "`":
            out.append("`")
            at += 1
            quasi()
        elif mark in "{}":
            if depths and mark == "}" and depths[-1] == 0:
                depths.pop()
                out.append(" ")
                at += 1
                quasi()
                continue
            if depths:
                depths[-1] += 1 if mark == "{" else -1
            out.append(mark)
            at += 1
        elif mark == "/":
            before = text[max(0, at - 40) : at].rstrip()
            starts = not before or before[-1] in "(,=:[!&|?{;+-*%~^" or before.endswith("=>") or re.search(r"(?<![\w$.])(?:return|typeof|case|in|of|void|delete|throw)$", before)
            found = _TS_REGEX.match(text, at) if starts else None
            if found:
                blank(found.end(), "_")
            else:
                out.append("/")
                at += 1
        else:
            blank(m.end(), None if mark[0] == "/" else mark[0])
    return "".join(out) + text[at:]


_GROUP = re.compile(r"[()\[\]{};]")
_OTHER = re.compile(r"[^\n;(){}\[\]]*")
_GOES_ON = re.compile(r"\s*(?:[=:.?&|+\-/,]|\Z)")


def _block_end(text: str, at: int) -> int:
    """Place after the brace group that opens first after ``at``, outside of other brackets, or after the statement if none does."""
    depth = 0
    for m in _GROUP.finditer(text, at):
        if m[0] in "([{":
            depth += 1
        elif m[0] == ";":
            if depth == 0:
                return m.end()
        elif depth or m[0] == "}":
            depth -= 1
            if depth <= 0 and m[0] == "}":
                return m.end()
    return len(text)


def _group_end(text: str, at: int) -> int:
    """Place after the bracket that closes the one at ``at``."""
    depth = 0
    for m in _GROUP.finditer(text, at):
        depth += 1 if m[0] in "([{" else -1 if m[0] != ";" else 0
        if depth == 0:
            return m.end()
    return len(text)


def _members(bare: str, at: int, end: int) -> Iterator[tuple[str, str, int, int, int, int]]:
    """``(name, kind, start, name_at, head_end, end)`` of the members of a class body from ``at`` to ``end``."""
    while at < end:
        if bare[at].isspace() or bare[at] == ";":
            at += 1
        elif bare[at] == "@":
            at = m.end() if (m := _DECORATOR.match(bare, at)) else at + 1
            if (m := re.compile(r"\s*\(").match(bare, at, end)):
                at = _group_end(bare, m.end() - 1)
        elif m := re.compile(r"static\s*(?=\{)").match(bare, at):
            at = _group_end(bare, m.end())
        elif m := _TS_MEMBER.match(bare, at, end + 1):
            name_at, start = m.start("name"), m.start()
            follow = m["next"] or ""
            if follow in ("(", "<"):
                stop = m.end() - 1
                if follow == "<":
                    stop = bare.find("(", stop)
                stop = _group_end(bare, stop) if stop >= 0 else end
                # a return type of braces stands before the body, on the same line
                typed = re.compile(r"\s*:\s*(?=\{)").match(bare, stop, end)
                tail = _group_end(bare, typed.end()) if typed else stop
                body = re.compile(r"[^{};]*[{;}]").match(bare, tail, end + 1)
                if body and body[0][-1] == "{":
                    head, stop = body.end() - 1, _group_end(bare, body.end() - 1)
                else:
                    head = stop = min(end, body.end() - 1 if body else end)
                yield m["name"], "method", start, name_at, head, min(stop, end)
            else:
                k, value = m.end(), m.end() if follow == "=" else -1
                while follow and k < end and bare[k] not in ";}":
                    c = bare[k]
                    if c in "([{":
                        k = _group_end(bare, k)
                        continue
                    if c == "\n" and not _GOES_ON.match(bare, k) and bare[max(0, k - 80) : k].rstrip()[-1:] not in tuple("=:,?&|+-*("):
                        break
                    if c == "=" and value < 0 and bare[k + 1 : k + 2] != ">":
                        value = k + 1
                    k += 1
                stop = k = min(k, end)
                yield m["name"], "method" if value >= 0 and _TS_ARROW.match(bare, value, k) else "property", start, name_at, k, k
            at = max(stop, at + 1)
        elif bare[at] in "([{":
            at = _group_end(bare, at)
        else:  # no member: the rest of the line, as far as a bracket
            at = max(at + 1, _OTHER.match(bare, at).end())


def _enclosing(spans: list[tuple], places: list) -> list[int | None]:
    """For each place the innermost span ``(first, end)`` around it."""
    order, out, stack, k = sorted(range(len(spans)), key=lambda i: (spans[i][0], [-x for x in spans[i][1]] if isinstance(spans[i][1], tuple) else -spans[i][1])), [None] * len(places), [], 0
    for i in sorted(range(len(places)), key=places.__getitem__):
        while k < len(order) and spans[order[k]][0] <= places[i]:
            while stack and spans[stack[-1]][1] <= spans[order[k]][0]:
                stack.pop()
            stack.append(order[k])
            k += 1
        while stack and spans[stack[-1]][1] <= places[i]:
            stack.pop()
        out[i] = stack[-1] if stack else None
    return out


def _pairs(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """Place after the closing bracket of each opening one, and the opening one of each closing."""
    ends, starts, stack = {}, {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack:
            ends[stack[-1]], starts[m.start()] = m.end(), stack[-1]
            stack.pop()
    return ends, starts


def _script_references(bare: str, markup: bool, known: set[int], types: list[tuple[int, int]]) -> list[tuple[str, str, int, int]]:
    """``(name, kind, place, start of the expression)``; ``known`` are places of names that are declared, ``types`` spans without calls."""
    ends, starts = _pairs(bare)
    found: list[tuple[str, str, int, int]] = []

    def chain(at: int) -> int:
        """Where the expression starts whose last name stands at ``at``."""
        while m := re.search(r"(?<!\.)\??\.\s*$", bare[max(0, at - 400) : at]):
            k = at - (len(m.string) - m.start()) - 1
            while k >= 0 and bare[k].isspace():
                k -= 1
            while k >= 0 and bare[k] in ")]" and k in starts:
                k = starts[k] - 1
                while k >= 0 and bare[k] in "?.!":
                    k -= 1
            at = k + 1 if k < 0 or not re.match(r"[\w$#\"'`]", bare[k]) else k - len(re.search(r"[\w$#\"'`]*$", bare[max(0, k - 200) : k + 1])[0]) + 1
        return at

    for m in _NEW.finditer(bare):
        name = re.split(r"\s*\.\s*", m[1])[-1]
        known.add(m.end() - len(name))
        if m[1] != "target":
            found.append((name, "new", m.start(), m.start()))
    calls = list(_CALL.finditer(bare))
    for m, typed in zip(calls, _enclosing(types, [m.start() for m in calls])):
        at, name = m.start(), m["name"]
        before = bare[max(0, at - 60) : at].rstrip()
        member = before.endswith(".") and not before.endswith("...")
        if at in known or typed is not None or not member and (name in _KEYWORDS or re.search(r"(?<![\w$.])(?:function\s*\*?|class|interface|enum)$", before)):
            continue
        if m[0].endswith("(") and not member and not re.search(r"(?<![\w$.])(?:extends|case)$", before):
            after = ends.get(m.end() - 1, len(bare))
            if re.compile(r"[^\S\n]*\{").match(bare, after):
                continue
            if re.compile(r"[^\S\n]*:[^;{}()\n]*\{").match(bare, after) and (before[-1:] in tuple("{,;}") or re.search(r"(?<![\w$.])(?:async|get|set|static|public|private|protected|override)$", before)):
                continue
        found.append((name, "call", at, chain(at) if member else at))
    for m in _HERITAGE.finditer(bare):
        head = m["head"]
        while (plain := re.sub(r"<[^<>]*>", lambda x: " " * len(x[0]), head)) != head:
            head = plain
        for clause in re.finditer(r"(?<![\w$.])(extends|implements)\s+(.*?)(?=(?<![\w$.])(?:extends|implements)\s|\Z)", head, re.S):
            for part in clause[2].split(","):
                if name := re.fullmatch(r"\s*(?:[\w$]+\s*\.\s*)*([A-Za-z_$][\w$]*)\s*", part):
                    found.append((name[1], clause[1], m.start("head") + clause.start(), m.start("head") + clause.start()))
    for m in _JSX.finditer(bare) if markup else ():
        before = bare[max(0, m.start() - 60) : m.start()].rstrip()
        if not re.search(r"[\w$)\]]$", before) or re.search(r"(?<![\w$.])(?:return|default|case|yield|await)$", before) or bare[m.start() - 1] in " \n\t" and re.match(r"[^<>=;]*/?>", bare[m.end() : m.end() + 400]):
            found.append((m[1], "jsx", m.start(), m.start()))
    found += [(m[1].rpartition(".")[2], "decorator", m.start(), m.start()) for m in _DECORATOR.finditer(bare)]
    return sorted((x for x in found if len(x[0]) <= 200), key=lambda x: (x[2], x[1]))


def _names(text: str) -> list[str]:
    found = []
    for part in re.split(r"[,{}]", text or ""):
        word = part.strip().removeprefix("type ").split(" as ")[-1].strip()
        if word and word != "*":
            found.append(word)
    return found


def parse_script(text: str, path: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Symbols ``(name, qualified, kind, signature, first, last, exported, parent, hash)``, imports ``(specifier, kind, line, names)``
    and references ``(name, kind, line, symbol around it)`` of TypeScript or JavaScript: top-level declarations, members of classes, routes."""
    bare = _bare(text)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    markup = path.lower().endswith(("x",))
    symbols: list[tuple] = []
    spans: list[tuple[int, int]] = []
    known: set[int] = set()
    types: list[tuple[int, int]] = []
    tops = list(_TS_TOP.finditer(bare))
    for m, following in zip(tops, [*(t.start() for t in tops[1:]), len(bare)]):
        name, kind = m["name"] or m["var"], (m["kind"] or "").rstrip("*")
        end = _block_end(bare, m.end())
        if not kind:
            kind = "function" if m["arrow"] else "constant" if re.fullmatch(r"[A-Z][A-Z0-9_]+", name) else "variable"
        if kind == "function":
            kind = "component" if markup and name[:1].isupper() else "hook" if re.match(r"use[A-Z]", name) else kind
        if kind in ("interface", "type"):
            types.append((m.start(), min(end, following)))  # one that is never closed ends at the next declaration
        exported = bool(m["export"])
        open_at = bare.find("{", m.start())
        head = text[m.start() : open_at if m.start() < open_at < end else bare.find("\n", m.start()) if "\n" in bare[m.start():] else len(text)]
        symbols.append((name, name, kind, _short(head), line(m.start()), line(end - 1), exported, None, _digest(text[m.start() : end])))
        spans.append((m.start(), end))
        if kind == "class" and (body := bare.find("{", m.end() - 1)) > 0:
            parent = len(symbols) - 1
            for own, sort, start, name_at, stop, after in _members(bare, body + 1, end - 1):
                label = text[name_at : name_at + len(own)]
                known.add(name_at)
                symbols.append((label, f"{name}.{label}", sort, _short(text[start:stop]), line(start), line(after - 1), False, parent, _digest(text[start:after])))
                spans.append((start, after))
    ends, _ = _pairs(bare)
    routes = []
    for m in _TS_ROUTE.finditer(text):
        # the text between the quotes is blanked in bare; all before it must be code there
        if bare[m.start() : m.start("path")] == text[m.start() : m.start("path")] and bare[m.start("path")] != "/":
            after = ends.get(text.index("(", m.end("verb")), m.end())
            routes.append((f"{m['verb'].upper()} {m['path']}", m.start(), after))
    for (name, start, after), parent in zip(routes, _enclosing(spans, [r[1] for r in routes])):
        symbols.append((name, name, "route", _short(text[start:after])[:160], line(start), line(after - 1), False, parent, _digest(text[start:after])))
    imports: list[tuple] = []
    for m in _TS_IMPORT.finditer(text):
        at = m.start() + (len(m[0]) - len(m[0].lstrip()))
        if bare[at] != text[at]:
            continue
        spec = m["from"] or m["effect"] or m["refrom"] or m["req"] or m["dyn"]
        kind = ("type" if m["type"] and m["names"] else "static") if m["from"] or m["effect"] else "export_from" if m["refrom"] else "require" if m["req"] else "dynamic"
        imports.append((spec, kind, line(at), _names(m["names"] or m["re"])))
    found = _script_references(bare, markup or not path.lower().endswith(".ts"), known, types)
    references = [(name, kind, line(start), k) for (name, kind, _, start), k in zip(found, _enclosing(spans, [x[2] for x in found]))]
    return symbols, imports, references


def parse_python(text: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """The same of Python; a file that does not parse gives the definitions, bases, decorators and calls that its lines show."""
    symbols: list[tuple] = []
    imports: list[tuple] = []
    references: list[tuple] = []
    lines = text.split("\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        open_at: list[tuple[int, int]] = []
        bare = _PY_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text).split("\n")
        for n, (row, code) in enumerate(zip(lines, bare), 1):
            depth = len(code) - len(code.lstrip())
            while code.strip() and open_at and open_at[-1][0] >= depth:
                open_at.pop()
            if m := re.match(r"\s*@([\w.]+)", code):
                references.append((m[1].rpartition(".")[2], "decorator", n, open_at[-1][1] if open_at else None))
            if m := re.match(r"\s*(?:async\s+)?(?:def|class)\s+\w+", code):
                open_at.append((depth, len(symbols)))
                if m[0].split()[0] == "class":
                    bases = re.match(r"\s*\(([^()]*)", code[m.end():])
                    references += [(b.strip().rpartition(".")[2], "extends", n, len(symbols)) for b in (bases[1].split(",") if bases else ()) if re.fullmatch(r"\s*[A-Za-z_][\w.]*\s*", b)]
            references += [(c[1], "call", n, open_at[-1][1] if open_at else None) for c in _PY_CALL.finditer(code) if not keyword.iskeyword(c[1])]
            if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", row):
                symbols.append((m[3], m[3], "class" if m[2] == "class" else "method" if m[1] else "function", _short(row.rstrip(":")), n, n, not m[3].startswith("_"), None, _digest(row)))
            elif m := re.match(r"\s*(?:from\s+([\w.]+)\s+import\s+(.+)|import\s+([\w.]+))", row):
                imports.append((m[1] or m[3], "static", n, _names((m[2] or "").strip("()"))))
        return symbols, imports, references

    spans: dict[int, tuple] = {}
    places: list[tuple] = []

    def refer(name: str, kind: str, node) -> None:
        if name and len(name) <= 200:
            references.append((name, kind, node.lineno))
            places.append((node.lineno, node.col_offset))

    last = lambda node: last(node.func) if isinstance(node, ast.Call) else last(node.value) if isinstance(node, ast.Subscript) else node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def add(node, kind: str, owner: str | None, parent: int | None) -> int:
        name = node.name
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        head = "\n".join(lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - 1)])
        symbols.append((name, f"{owner}.{name}" if owner else name, kind, _short(head.rstrip().rstrip(":")), node.lineno, node.end_lineno, not name.startswith("_"), parent, _digest(body)))
        spans[len(symbols) - 1] = ((min([node.lineno, *(d.lineno for d in node.decorator_list)]), 0 if node.decorator_list else node.col_offset), (node.end_lineno, node.end_col_offset))
        return len(symbols) - 1

    def walk(body, owner: str | None, parent: int | None, in_class: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                at = add(node, "method" if in_class else "function", owner, parent)
                for mark in node.decorator_list:
                    if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args and isinstance(mark.args[0], ast.Constant):
                        verb = mark.func.attr.upper()
                        if verb in {"GET", "POST", "PUT", "PATCH", "DELETE", "ROUTE"}:
                            route = f"{'ANY' if verb == 'ROUTE' else verb} {mark.args[0].value}"
                            symbols.append((route, route, "route", route, node.lineno, node.lineno, False, at, _digest(route)))
                walk(node.body, symbols[at][1], at, False)
            elif isinstance(node, ast.ClassDef):
                at = add(node, "class", owner, parent)
                for base in node.bases:
                    refer(last(base), "extends", base)
                walk(node.body, symbols[at][1], at, True)
            elif isinstance(node, ast.Assign) and owner is None:
                for target in node.targets:
                    if isinstance(target, ast.Name):
                        kind = "constant" if re.fullmatch(r"[A-Z][A-Z0-9_]+", target.id) else "variable"
                        row = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                        symbols.append((target.id, target.id, kind, _short(row), node.lineno, node.end_lineno, not target.id.startswith("_"), None, _digest(row)))

    walk(tree.body, None, None, False)
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports.extend((a.name, "static", node.lineno, [a.asname or a.name.split(".")[0]]) for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            imports.append(("." * node.level + (node.module or ""), "static", node.lineno, [a.asname or a.name for a in node.names]))
        elif isinstance(node, ast.Call):
            refer(node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None, "call", node)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for mark in node.decorator_list:
                refer(last(mark), "decorator", mark)
    owners = list(spans)
    return symbols, imports, [(*r, None if k is None else owners[k]) for r, k in zip(references, _enclosing(list(spans.values()), places))]


def parse(path: str | None, text: str | None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Symbols, imports and references ``(name, kind, line)`` of one file."""
    symbols, imports, references = parse_owned(path, text)
    return symbols, imports, [r[:3] for r in references]


def parse_owned(path: str | None, text: str | None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """``parse`` with the ordinal of the symbol around each reference as its fourth value."""
    extension = (path or "").rpartition(".")[2].lower()
    if not text:
        return [], [], []
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    if extension == "py":
        return parse_python(text)
    if extension in ("ts", "tsx", "js", "jsx", "mjs", "cjs"):
        return parse_script(text, path)
    return [], [], []


def extract_symbols(files: DataFrame, *, id: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """``(file_id, ordinal, name, qualified_name, type, signature, line_start, line_end, exported, parent, hash)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, k, *s) for f, p, c in zip(batch["file_id"], batch["path"], batch["content"]) for k, s in enumerate(parse(p, c)[0])]
            frame = pd.DataFrame(rows, columns=["file_id", "ordinal", "name", "qualified_name", "type", "signature", "line_start", "line_end", "exported", "parent", "hash"])
            frame["parent"] = frame["parent"].astype("Int64")
            yield frame

    kind = files.schema[id].dataType.simpleString()
    return files.select(F.col(id).alias("file_id"), F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {kind}, ordinal int, name string, qualified_name string, type string, signature string, line_start int, line_end int, exported boolean, parent long, hash string"
    )


def extract_imports(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content") -> DataFrame:
    """``(file_id, project_id, path, specifier, kind, line, names)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, j, p, *i) for f, j, p, c in zip(batch["file_id"], batch["project_id"], batch["path"], batch["content"]) for i in parse(p, c)[1]]
            yield pd.DataFrame(rows, columns=["file_id", "project_id", "path", "specifier", "kind", "line", "names"])

    key = files.schema[id].dataType.simpleString()
    return files.select(F.col(id).alias("file_id"), F.col(project).alias("project_id"), F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {key}, project_id string, path string, specifier string, kind string, line int, names array<string>"
    )


def extract_references(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content") -> DataFrame:
    """``(file_id, project_id, ordinal, name, kind, line, from_ordinal)``; ``from_ordinal`` is the ordinal of the innermost symbol around it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, j, k, *r) for f, j, p, c in zip(batch["file_id"], batch["project_id"], batch["path"], batch["content"]) for k, r in enumerate(parse_owned(p, c)[2])]
            frame = pd.DataFrame(rows, columns=["file_id", "project_id", "ordinal", "name", "kind", "line", "from_ordinal"])
            frame["from_ordinal"] = frame["from_ordinal"].astype("Int64")
            yield frame

    key = files.schema[id].dataType.simpleString()
    return files.select(F.col(id).alias("file_id"), F.col(project).alias("project_id"), F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(
        run, f"file_id {key}, project_id string, ordinal int, name string, kind string, line int, from_ordinal long"
    )


def resolve_imports(imports: DataFrame, files: DataFrame, *, aliases: list[tuple[str, str]] = (), packages: list[tuple[str, str]] = ()) -> DataFrame:
    """``imports`` with ``(is_external, package_name, resolved_file_id, resolved_path)``.

    ``aliases`` are ``(prefix, folder)`` pairs and ``packages`` ``(name, folder)`` pairs of the workspace (see ``sources.project``). Relative specifiers are tried with the usual extensions and index files, dotted Python ones from the project's
    root and source folders; the first candidate that is a file of the project wins. One join on (project, path).
    """
    spec, own = F.col("specifier"), F.col("path")
    folder = F.regexp_replace(own, r"[^/]*$", "")
    script = F.lower(own).rlike(r"\.(?:tsx?|jsx?|mjs|cjs)$")
    relative = spec.startswith(".")

    def normal(column):
        """The path without ``.`` and with each ``..`` taken off together with the folder before it, however many there are."""
        none = F.array().cast("array<string>")
        step = lambda done, x: (
            F.when((x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x)))
        )
        return F.array_join(F.aggregate(F.split(column, "/"), none, step), "/")

    joined = normal(F.concat(folder, spec))
    inner = F.lit(None).cast("string")
    for prefix, target in aliases:
        inner = F.coalesce(inner, F.when(spec.startswith(prefix), F.concat(F.lit(target), F.expr(f"substring(specifier, {len(prefix) + 1})"))))
    for name, target in packages:
        rest = F.expr(f"substring(specifier, {len(name) + 2})")
        inner = F.coalesce(inner, F.when(spec == name, F.lit(target + "/src/index.ts")).when(spec.startswith(name + "/"), F.concat(F.lit(target + "/src/"), F.regexp_replace(rest, "^src/", ""))))
    joined = F.coalesce(F.when(~relative, inner), joined)
    stem = F.regexp_replace(joined, r"\.(?:js|jsx|mjs|cjs)$", "")
    tails = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
    from_script = F.array_distinct(F.array(joined, *[F.concat(stem, F.lit(t)) for t in tails]))
    dotted = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    roots = F.array(F.lit(""), F.lit("src/"), F.lit("app/"), F.lit("lib/"))
    bases = F.when(relative, F.array(F.concat(folder, F.repeat(F.lit("../"), F.length(F.regexp_extract(spec, r"^\.+", 0)) - 1)))).otherwise(roots)
    from_python = F.flatten(F.transform(bases, lambda b: F.array(normal(F.concat(b, dotted, F.lit(".py"))), normal(F.concat(b, dotted, F.lit("/__init__.py"))))))
    tries = F.when(script & (relative | inner.isNotNull()), from_script).when(~script, from_python).otherwise(F.array().cast("array<string>"))
    keys = ["project_id", "file_id", "path", "specifier", "kind", "line"]
    spread = imports.select(*keys, F.posexplode(tries).alias("_order", "_try"))
    known = files.groupBy("project_id", F.col("relative_path").alias("_try")).agg(F.min("file_id").alias("_target"))
    best = spread.join(known, ["project_id", "_try"]).groupBy(*keys).agg(F.min_by(F.struct("_target", "_try"), "_order").alias("_best"))
    package = F.when(spec.startswith("node:"), "node").when(spec.startswith("@"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)).when(script, F.regexp_extract(spec, r"^([^/]+)", 1)).otherwise(F.regexp_extract(spec, r"^([^.]+)", 1))
    outside = F.col("_best").isNull() & ~relative & inner.isNull()
    same = reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys])
    return imports.alias("i").join(best.alias("b"), same, "left").select("i.*", "b._best").select(
        *imports.columns, outside.alias("is_external"), F.when(outside, package).alias("package_name"), F.col("_best._target").alias("resolved_file_id"), F.col("_best._try").alias("resolved_path")
    )
