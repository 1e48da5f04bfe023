"""Source files whose text is not valid in the language of their extension.

Method: a lexer per language turns the text into a string of token classes, and a pushdown stack reads it once: an opening
bracket is pushed, a closing one pops its group, which is held against the token sequences that its language forbids
there and is put into the group around it as one symbol. What stays on the stack ends too early, a closing bracket that
does not fit its opening one is unbalanced; unterminated literals, characters outside the language and merge-conflict
markers outside literals and comments have classes of their own. Time follows the length of a text, however deep its
brackets are. JSON and Python are checked exactly on top: the groups of JSON are its grammar, and Python's own parser
has the last word on Python files.

One pass over the files, no shuffle but the final counts; nothing is broadcast.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The languages that are checked, by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "py": "python",
    "json": "json", "go": "go", "sql": "sql", "css": "css",
}

CONFLICT = r"^(?:<<<<<<<|=======|>>>>>>>|\|\|\|\|\|\|\|)(?:[ \t][^\n]*|\r?)$"
BRACKETS = re.compile(r"[()\[\]{}]")
CLOSES = {"(": ")", "[": "]", "{": "}"}


class Problem(Exception):
    """The first thing found wrong, as a short name."""


# ---------------------------------------------------------------- JavaScript and TypeScript

_PLAIN_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'[^'\n]*'|\"[^\"\n]*\"|\{[^{}`]*\})*\})*`"
_REGEX_BODY = r"/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
_SCRIPT_TOKENS = (
    r"[A-Za-z_$\u0080-￿#][\w$\u0080-￿]*|[ \t\r﻿]+|\n\s*"
    r"|[;,(){}\[\]@]"
    r"|//[^\n]*|/\*[\s\S]*?\*/"
    r"|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
    r"|" + _PLAIN_TEMPLATE +
    r"|\d(?:[\w]|\.\d|\.(?![\w.])|(?<=[eE])[+-](?=\d))*|\.\d\w*"
    r"|" + CONFLICT +
    r"|=>|\.\.\.|\?\.(?!\d)|\+\+|--|(?:\*\*|<<|>>>?|&&|\|\||\?\?|[-+*/%&|^])=|[=!]==?|[<>]=|\*\*|&&|\|\||\?\?|[-+*/%&|^~!<>=?:.]"
    r"|[^\s]"
)
_SCRIPT = re.compile(_SCRIPT_TOKENS, re.M)
_SCRIPT_SLASH = re.compile(r"(?<=[=(,:;!&|?{\[+])[ \t\r\n]*" + _REGEX_BODY + "|" + _SCRIPT_TOKENS, re.M)
_MAYBE_SLASH = re.compile(r"[=(,:;!&|?{\[+]\s*/[^/*]")
_NUMBER = re.compile(r"(?:0[xXbBoO][\dA-Fa-f_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")
LEXICON_ENTRIES = 1 << 19


class Lexicon(dict):
    """Class of every token seen so far; emptied when it holds ``LEXICON_ENTRIES``."""

    def __init__(self, fixed: dict[str, str], classify) -> None:
        super().__init__(fixed)
        self.fixed, self.classify = fixed, classify

    def __missing__(self, token: str) -> str:
        kind = self.classify(token)
        if len(self) >= LEXICON_ENTRIES:
            self.clear()
            self.update(self.fixed)
        if len(token) < 80:
            self[token] = kind
        return kind


def _marker(token: str) -> bool:
    return token[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||")


def _script_class(token: str) -> str:
    first = token[0]
    if first.isalpha() or first in "_$#":
        return "i" if token != "#" else "X"
    if first in "'\"":
        return "s" if len(token) > 1 else "X"
    if first == "`":
        return "t" if len(token) > 1 else "`"
    if token[:2] in ("//", "/*"):
        return ""
    bare = token.lstrip()
    if not bare or bare == "﻿":
        return "N" if first == "\n" else ""
    if bare[0] == "/":
        return "r"
    if first.isdigit() or first == ".":
        return "n" if _NUMBER.fullmatch(token) else "X"
    if _marker(token):
        return "M"
    return "i" if first >= "\x80" else "X"


# Reserved and contextual words by the part they play.
_WORDS = {
    **dict.fromkeys("typeof void delete new throw case".split(), "k"),
    **dict.fromkeys("const let var".split(), "D"),
    **dict.fromkeys("if while switch".split(), "w"),
    **dict.fromkeys("return await yield else do try finally in of instanceof as from default static get set async extends this super null true false break continue debugger with catch".split(), "K"),
    "for": "f", "function": "F", "class": "C", "import": "I", "export": "Q",
}
_TYPED = {
    **_WORDS,
    **dict.fromkeys("interface type enum namespace module declare abstract readonly public private protected is keyof infer satisfies implements asserts unique override accessor out any unknown never symbol global using".split(), "K"),
}
_MARKS = {
    **{m: "b" for m in "** && || ?? == === != !== <= >= **= <<= >>= >>>= &&= ||= ??= += -= *= /= %= &= |= ^= / % ^".split()},
    **{m: m for m in "= . ? : ; , ( ) [ ] { }".split()},
    **{m: "p" for m in "| &".split()}, **{m: "+" for m in "+ -".split()}, **{m: "!" for m in "! ~".split()},
    **{m: "g" for m in "< >".split()},
    "++": "u", "--": "u", "=>": "a", "...": "e", "?.": ".", "*": "m", "@": "K",
}
_PLAIN_WORDS = Lexicon({**_MARKS, **_WORDS}, _script_class)
_TYPED_WORDS = Lexicon({**_MARKS, **_TYPED}, _script_class)
_SCRIPT_BAD = (
    r"[MX]|[snr][isnr]|i[snr]|ii|A[isnr]|[=b]N*[=b;,]|[=b.>a:e]N*$|aN*[;,]|^N*[b=.]|[,;]N*b|:N*,|^N*,N*,"
    r"|D(?![iKABNo])|DN*$|(?<!\.)w(?!N*[P:,;=?])|(?<![.iK])wN*$|(?<!\.)\.N*(?![iKowDfFCIQk#.])|Q(?![KDFCBmNfiI=:;,.P])|[QIFC]N*$"
    r"|FiPN*$|Fi?N*$|CiN*$|(?<![.])k[;,]|(?<![.])kN*$|IB(?!N*K)|,N*;"
)
SCRIPT_BAD = re.compile(_SCRIPT_BAD + r"|Ii(?!N*[,K])|Di\??:|\?:|FiP:|FiP(?!N*B)|\?N*[,;]|^N*g")
TYPED_BAD = re.compile(_SCRIPT_BAD + r"|Ii(?!N*[,K=B])|^N*gN*(?![iK])")
TYPED_X_BAD = re.compile(_SCRIPT_BAD + r"|Ii(?!N*[,K=B])")


def _skip_template(text: str, at: int) -> int:
    """Place after the template literal whose back-tick stands at ``at``; -1 if it does not end."""
    depth: list[int] = []  # open braces of each ${ } that is being read
    at += 1
    n = len(text)
    while at < n:
        c = text[at]
        if not depth or depth[-1] < 0:  # inside literal text
            if c == "\\":
                at += 1
            elif c == "`":
                if not depth:
                    return at + 1
                depth.pop()
            elif c == "$" and text[at + 1 : at + 2] == "{":
                depth.append(0)
                at += 1
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            if depth[-1] == 0:
                depth.pop()
            else:
                depth[-1] -= 1
        elif c == "`":
            depth.append(-1)
        elif c in "'\"":
            end = at + 1
            while end < n and text[end] != c and text[end] != "\n":
                end += 2 if text[end] == "\\" else 1
            at = end
        at += 1
    return -1


_TAG = re.compile(r"<(?:/?[A-Za-z][\w.:-]*)?(?:\s+(?:[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<brace>\{)))?|(?P<spread>\{)))*\s*/?>")


def _skip_braces(text: str, at: int) -> int:
    """Place after the brace group that opens at ``at``, over strings and templates; -1 if it does not end."""
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return at + 1
        elif c == "`":
            at = _skip_template(text, at)
            if at < 0:
                return -1
            continue
        elif c in "'\"":
            end = text.find(c, at + 1)
            if 0 <= end and "\n" not in text[at:end]:
                at = end
        at += 1
    return -1


def _skip_markup(text: str, at: int) -> int:
    """Place after the JSX element that opens at ``at``; -1 if it does not end, 0 if it is none."""
    depth, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "{":
            at = _skip_braces(text, at)
            if at < 0:
                return -1
            continue
        if c == "<":
            closing = text[at + 1 : at + 2] == "/"
            end = at + 1
            while end < n and text[end] != ">":
                if text[end] == "{":
                    end = _skip_braces(text, end)
                    if end < 0:
                        return -1
                    continue
                if text[end] in "\"'":
                    end = text.find(text[end], end + 1)
                    if end < 0:
                        return -1
                end += 1
            if end >= n:
                return -1
            if closing:
                depth -= 1
            elif text[end - 1] != "/":
                depth += 1
            at = end + 1
            if depth == 0:
                return at
            continue
        at += 1
    return -1


_MARKUP = re.compile(r"(?:(?<=[=(,:?&|\[{>])|(?<=return)|(?<=return[ ]))[ \t\r\n]*(<(?:[A-Za-z][\w.]*(?=[\s/>])|>))")


def _without_markup(text: str) -> str:
    """TSX text with each JSX element replaced by ``null`` (the element itself must end)."""
    if "</" not in text and "/>" not in text:
        return text
    parts, at = [], 0
    while m := _MARKUP.search(text, at):
        start = m.start(1)
        end = _skip_markup(text, start)
        if end < 0:
            if re.match(r"<\w+(?:\s+extends\s|\s*,|>\s*\()", text[start:]):  # type parameters of an arrow function
                parts.append(text[at : start + 1])
                at = start + 1
                continue
            raise Problem("markup does not end")
        parts += [text[at:start], "null"]
        at = end
    parts.append(text[at:])
    return "".join(parts)


def script_classes(text: str, lexicon: Lexicon) -> str:
    """Token classes of JavaScript or TypeScript."""
    lexer = _SCRIPT_SLASH if _MAYBE_SLASH.search(text) else _SCRIPT
    code = "".join(map(lexicon.__getitem__, lexer.findall(text)))
    if "`" not in code:
        return code
    out: list[str] = []  # templates within templates: step over each whole literal
    at = 0
    while True:
        for m in lexer.finditer(text, at):
            kind = lexicon[m[0]]
            if kind == "`":
                at = _skip_template(text, m.start())
                if at < 0:
                    raise Problem("unterminated literal")
                out.append("t")
                break
            out.append(kind)
        else:
            return "".join(out)


def _name(found: str) -> str:
    return "conflict marker" if "M" in found else "unterminated literal or foreign character" if "X" in found else "unexpected token"


def check_script(text: str, extension: str) -> None:
    typed = extension != "js"
    if extension == "tsx":
        text = _without_markup(text)
    bad = TYPED_X_BAD if extension == "tsx" else TYPED_BAD if typed else SCRIPT_BAD
    code = script_classes(text, _TYPED_WORDS if typed else _PLAIN_WORDS)
    if found := re.search("[MX]", code):
        raise Problem(_name(found[0]))
    if re.match(r"N*\{N*s:", code):
        raise Problem("unexpected token")

    def reduce(kind: str, inside: str, before: str) -> str:
        if kind != "{" or before in ("(," if typed else "=(,?"):
            inside = inside.replace("N", "")
        if found := bad.search(inside):
            raise Problem(_name(found[0]))
        if kind != "{":
            if ";" in inside and before != "f" and not (before == "K" and kind == "("):
                raise Problem("unexpected token")
            if not typed and inside.count(":") > inside.count("?"):
                raise Problem("unexpected token")
        elif not typed and before in "=(,?" and before and ";" in inside:
            raise Problem("unexpected token")
        return "P" if kind == "(" else "A" if kind == "[" else "B"

    code = _reduced(code, reduce)
    if found := bad.search(code):
        raise Problem(_name(found[0]))


def _reduced(code: str, reduce) -> str:
    """``code`` with each bracket group replaced by ``reduce(kind, inside, before)``, inner groups first, in one pass.

    ``inside`` is the group's own code with its inner groups already replaced, ``before`` the symbol in front of it: the
    bracket around it where it comes first there, nothing at the start of the text.
    """
    stack: list[tuple[str, list[str]]] = [("", [])]
    parts, at = stack[0][1], 0
    for m in BRACKETS.finditer(code):
        if m.start() > at:
            parts.append(code[at : m.start()])
        at, mark = m.end(), m[0]
        if mark in CLOSES:
            parts = []
            stack.append((mark, parts))
            continue
        kind, parts = stack.pop()
        if CLOSES.get(kind) != mark:
            raise Problem("unbalanced delimiter")
        outer, around = stack[-1]
        around.append(reduce(kind, "".join(parts), around[-1][-1] if around else outer))
        parts = around
    if len(stack) > 1:
        raise Problem("premature end")
    parts.append(code[at:])
    return "".join(parts)


# ---------------------------------------------------------------- JSON

_JSON = re.compile(
    r'(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")'
    r"|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))"
    r"|(?P<word>(?:true|false|null)\b)|(?P<mark>[\[\]{},:])|(?P<conflict>" + CONFLICT + r")|(?P<odd>[^ \t\r\n])",
    re.M,
)
_JSON_CLASS = {"string": "s", "number": "v", "word": "v", "conflict": "M", "odd": "X"}
_JSON_OBJECT = re.compile(r"(?:s:[sv](?:,s:[sv])*+)?")
_JSON_ARRAY = re.compile(r"(?:[sv](?:,[sv])*+)?")


def check_json(text: str) -> None:
    code = "".join([m[0] if m.lastgroup == "mark" else _JSON_CLASS[m.lastgroup] for m in _JSON.finditer(text)])
    if found := re.search("[MX]", code):
        raise Problem(_name(found[0]))

    def reduce(kind: str, inside: str, before: str) -> str:
        if not (_JSON_OBJECT if kind == "{" else _JSON_ARRAY).fullmatch(inside):
            raise Problem("unexpected token")
        return "v"

    if _reduced(code, reduce) not in ("s", "v"):
        raise Problem("unexpected token" if code else "premature end")


# ---------------------------------------------------------------- Python

_PREFIX = r"(?:[rRuU]|[bB][rR]?|[rR][bB]|[fF][rR]?|[rR][fF])?"
_PYTHON = re.compile(
    _PREFIX + r'(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''"
    r"|\"(?!\"\")(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*')"
    r"|[^\W\d]\w*|[ \t\f\r]+"
    r"|\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t]*"
    r"|[;:,(){}\[\]~](?!=)|\#[^\n]*|\\\n"
    r"|\d(?:\w|\.(?!\.)|(?<=[eE])[+-](?=\d))*|\.\d(?:\w|(?<=[eE])[+-](?=\d))*"
    r"|" + CONFLICT +
    r"|\*\*=?|//=?|<<=?|>>=?|->|:=|\.\.\.|[-+*/%@&|^=!<>]=|[-+*/%@&|^<>=.:]"
    r"|\S",
    re.M,
)
_PY_NUMBER = re.compile(r"(?:0[xXbBoO][\dA-Fa-f_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[jJ]?")
_PY_WORDS = {
    **dict.fromkeys("def class if elif while for with except match".split(), "h"),
    **dict.fromkeys("else try finally lambda".split(), "K"),
    **dict.fromkeys("return yield await async in is not and or import from as raise assert del global nonlocal pass break continue None True False case type".split(), "K"),
}
_PY_MARKS = {
    **{m: "b" for m in "** // / % @ & | ^ << >> == != <= >= < > **= //= += -= *= /= %= @= &= |= ^= <<= >>= := ->".split()},
    **{m: m for m in "= . : ; , ( ) [ ] { }".split()}, **{m: "+" for m in "+ - ~".split()}, "*": "m", "**": "m", "...": "n",
}


def _python_class(token: str) -> str:
    first = token[0]
    if token[-1] in "'\"" and len(token) > 1:
        return "s"
    if first == "_" or first.isalpha():
        return "i"
    if first == "\n":
        return "N"
    if first in " \t\f\r#" or token == "\\\n":
        return ""
    if first.isdigit() or first == ".":
        return "n" if _PY_NUMBER.fullmatch(token) else "X"
    return "M" if _marker(token) else "X"


_PY_LEXICON = Lexicon({**_PY_MARKS, **_PY_WORDS}, _python_class)
_PY_SHAPE = re.compile(r"[N(){}\[\]]")
_PY_BAD = re.compile(r"[MX]|[n][isn]|s[in]|i[sn]|ii|[AP][isn]|[=b+.]$|[=b]{2}|^[b=]|[,:;]b|,,|[=b+][,;:]|\.[^iKh]")


def check_python(text: str) -> None:
    """What the lexer and the block structure object to; :func:`check` lets Python's parser confirm it."""
    tokens = _PYTHON.findall(text)
    kinds = list(map(_PY_LEXICON.__getitem__, tokens))
    code = "".join(kinds)
    if found := re.search("[MX]", code):
        raise Problem(_name(found[0]))
    indent = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\n)*([ \t]*)", text)[1]
    breaks = (token.rpartition("\n")[2] for token, kind in zip(tokens, kinds) if kind == "N")
    lines: list[tuple[str, str]] = []
    depth = begin = 0
    for m in _PY_SHAPE.finditer(code):
        mark = m[0]
        if mark == "N":
            following = next(breaks)
            if depth <= 0:
                lines.append((indent, code[begin : m.start()]))
                begin, indent = m.end(), following
        elif mark in "([{":
            depth += 1
        else:
            depth -= 1
    lines.append((indent, code[begin:]))
    stack, opened = [""], False

    def reduce(kind: str, inside: str, before: str) -> str:
        if found := _PY_BAD.search(inside):
            raise Problem(_name(found[0]))
        return {"(": "P", "[": "A", "{": "n"}[kind]

    for indent, code in lines:
        if not code:
            continue
        code = _reduced(code.replace("N", ""), reduce)
        if found := _PY_BAD.search(code):
            raise Problem(_name(found[0]))
        if opened:
            if not (len(indent) > len(stack[-1]) and indent.startswith(stack[-1])):
                raise Problem("missing block")
            stack.append(indent)
        else:
            while len(indent) < len(stack[-1]):
                stack.pop()
            if indent != stack[-1]:
                raise Problem("unexpected indent")
        opened = code.endswith(":")
        if code[0] == "h" and len(code) > 1 and code[1] not in "=.,:b)" and ":" not in code:
            raise Problem("missing colon")
        if code in ("h", "hi", "Kh", "Khi"):
            raise Problem("premature end")
    if opened:
        raise Problem("premature end")


# ---------------------------------------------------------------- Go, SQL, CSS

_GO = re.compile(
    r"(?P<word>[A-Za-z_\u0080-￿][\w\u0080-￿]*)|(?P<line>\n\s*)|(?P<comment>//[^\n]*|/\*[\s\S]*?\*/)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[^\n])*\")|(?P<raw>`[^`]*`)|(?P<rune>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[\dA-Fa-f]{2}|u[\dA-Fa-f]{4}|U[\dA-Fa-f]{8}))')"
    r"|(?P<number>(?:0[xXbBoO][\dA-Fa-f_.pP]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*)i?(?!\w))|(?P<conflict>" + CONFLICT + ")"
    r"|(?P<mark>&\^=?|<<=?|>>=?|:=|\.\.\.|<-|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^~!<>=:;,.(){}\[\]])|(?P<odd>\S)",
    re.M,
)
_GO_CLASS = {"string": "s", "raw": "t", "rune": "n", "number": "n", "line": "N", "comment": "", "conflict": "M", "odd": "X"}
_GO_WORDS = {
    **dict.fromkeys("return if else for switch case default go defer select range chan map struct interface break continue goto fallthrough".split(), "K"),
    "package": "p", "import": "I", "func": "F", "var": "V", "const": "V", "type": "T",
}
_GO_MARKS = {
    **{m: "b" for m in "&^ << >> && || == != <= >= += -= *= /= %= &= |= ^= <<= >>= &^= / % | < > ^".split()},
    **{m: m for m in ". : ; , ( ) [ ] { }".split()}, "=": "=", ":=": "=", "...": "e", "<-": "+", "+": "+", "-": "+", "*": "+", "&": "+", "!": "+", "~": "+", "++": "u", "--": "u",
}
_GO_BAD = re.compile(r"[MX]|[sn][isn]|i[sn](?!N*$)|iii|A[sn]|[=b]N*[=b;,]|[=b+.]N*$|^N*[b=.]|[,;]N*b|,N*,|\.N*[^iKTVP]|FN*$|FiN*$|FiPN*$|[VTIp]N*$")


def check_go(text: str) -> None:
    out = []
    for m in _GO.finditer(text):
        kind = m.lastgroup
        out.append(_GO_WORDS.get(m[0], "i") if kind == "word" else _GO_MARKS[m[0]] if kind == "mark" else _GO_CLASS[kind])
    code = "".join(out)
    if found := re.search("[MX]", code):
        raise Problem(_name(found[0]))
    if not re.match(r"N*pi(?:N|;|$)", code):
        raise Problem("unexpected token" if code.strip("N") else "premature end")

    def reduce(kind: str, inside: str, before: str) -> str:
        if found := _GO_BAD.search(inside):
            raise Problem(_name(found[0]))
        if kind != "{" and ";" in inside:
            raise Problem("unexpected token")
        if kind == "(" and before not in "IVT" and before and re.search(r"[^,N(]N+$", inside) and "N" in inside.strip("N"):
            raise Problem("unexpected token")  # a list that ends on its own line needs a comma
        return "P" if kind == "(" else "A" if kind == "[" else "B"

    code = _reduced(code, reduce)
    for line in re.split("[N;]+", code):
        if not line:
            continue
        if line[0] not in "pIFVT" or _GO_BAD.search(line):
            raise Problem("unexpected token")
        if line[0] == "F" and "B" not in line and not re.fullmatch(r"FP?i.*[PiA]", line):
            raise Problem("premature end")
        if line[0] == "V" and re.fullmatch("Vi", line):
            raise Problem("premature end")
        if line[0] == "I" and not re.fullmatch(r"I[i.]?[sPt]", line):
            raise Problem("unexpected token")
        if line[0] == "T" and not re.fullmatch(r"T(?:P|iA?=?.+)", line):
            raise Problem("premature end")


_SQL = re.compile(
    r"(?P<comment>--[^\n]*|/\*[\s\S]*?\*/)|(?P<string>[eEnNbBxX]?'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`\n]*`)|(?P<dollar>\$(\w*)\$[\s\S]*?\$\5\$)"
    r"|(?P<word>[A-Za-z_\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?(?!\w)|\.\d+)|(?P<conflict>" + CONFLICT + ")"
    r"|(?P<mark>::|<>|!=|<=|>=|\|\||->>?|:=|[-+*/%<>=.,;:(){}\[\]?@$&|~#^!])|(?P<odd>\S)",
    re.M,
)
# Words a statement begins with, and words that something must follow.
_SQL_STARTS = set(
    "select insert update delete create alter drop with begin commit rollback set grant revoke truncate comment explain analyze vacuum"
    " declare use do call copy lock merge replace pragma values start savepoint release show end reindex refresh execute prepare listen notify".split()
)
_SQL_OPEN = set(
    "select from where insert into values create table alter drop update set delete join on and or not by group order having union with as is in like"
    " primary foreign references if exists default check constraint add column role password rename to when then case index unique view limit offset between distinct using".split()
)
_SQL_MARKS = {**{m: m for m in ". , ; ( ) [ ] { }".split()}, "*": "m", "?": "v", "$": "v", "@": "v", ":": "v"}


def check_sql(text: str) -> None:
    statements: list[tuple[str, list[str]]] = []
    code, words = [], []
    for m in _SQL.finditer(text):
        kind = m.lastgroup or ""
        if kind == "comment":
            continue
        if kind == "conflict" or kind == "odd":
            raise Problem(_name("M" if kind == "conflict" else "X"))
        if kind == "mark":
            if m[0] == ";":
                statements.append(("".join(code) + ";", words))
                code, words = [], []
            else:
                code.append(_SQL_MARKS.get(m[0], "b"))
        elif kind == "word":
            lowered = m[0].lower()
            words.append(lowered)
            code.append("o" if lowered in _SQL_OPEN else "w")
        else:
            code.append("n" if kind == "number" else "q" if kind == "quoted" else "s")
    if code:
        statements.append(("".join(code), words))

    def reduce(kind: str, inside: str, before: str) -> str:
        if re.search(r"^,|,$|,,|b$|[sn][sn]|[sn]w(?![sPw])(?=[,b]|$)(?<!sw)", inside):
            raise Problem("unexpected token")
        return "P"

    for code, words in statements:
        code = _reduced(code, reduce)
        body = code.rstrip(";")
        if not body:
            continue
        if not words or words[0] not in _SQL_STARTS or body[0] not in "wo":
            if not body.startswith("P"):
                raise Problem("unexpected token")
            continue
        if re.search(r",$|,,|b$|\.$|[sn][sn]|^.,|,;", body) or (body.endswith("o") and words[-1] not in ("default", "exists", "unique", "all", "role", "column")):
            raise Problem("premature end")
        if words[0] == "insert" and not ({"values", "select", "default", "with", "table"} & set(words)):
            raise Problem("premature end")
        if words[0] == "insert" and "values" in words and "select" not in words and not body.rstrip(",").endswith("P") and not {"on", "returning"} & set(words):
            raise Problem("premature end")
        if words[:2] == ["create", "table"] and "P" not in body and "as" not in words:
            raise Problem("premature end")
        if len(words) < 2 and words[0] in ("insert", "create", "alter", "drop", "update", "delete", "select", "with", "set", "grant", "revoke", "truncate") and len(body) < 2:
            raise Problem("premature end")
        if words[0] == "alter" and len(body) < 5:
            raise Problem("premature end")


_CSS = re.compile(
    r"(?P<comment>/\*[\s\S]*?\*/)|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<conflict>" + CONFLICT + ")"
    r"|(?P<url>url\(\s*[^\"'()\s][^()\s]*\s*\))|(?P<open>/\*|[\"'])|(?P<mark>[{}()\[\];:])|(?P<word>[^\s{}()\[\];:\"'/]+|/)|(?P<odd>\S)",
    re.M,
)
_CSS_CLASS = {"comment": "", "string": "w", "conflict": "M", "url": "w", "open": "X", "word": "w", "odd": "X"}


def check_css(text: str) -> None:
    code = "".join([m[0] if m.lastgroup == "mark" else ("r" if m.lastgroup == "word" and m[0][0] == "@" else _CSS_CLASS[m.lastgroup]) for m in _CSS.finditer(text)])
    if found := re.search("[MX]", code):
        raise Problem(_name(found[0]))

    def reduce(kind: str, inside: str, before: str) -> str:
        if kind == "{":
            for declaration in re.split(";", inside):
                if declaration and "B" not in declaration and not declaration.startswith("r"):
                    if not re.fullmatch(r"w+:[wPA:]+", declaration):
                        raise Problem("unexpected token")
            return "B"
        return "P" if kind == "(" else "A"

    code = _reduced(code, reduce)
    if not re.fullmatch(r"(?:r[wPA:]*(?:;|B)|[wPA:]+B|;)*", code):
        raise Problem("premature end" if not re.search("[B;]$", code) else "unexpected token")


def extension_of(path: str | None) -> str:
    name = (path or "").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def check(path: str | None, content: str | None) -> str | None:
    """What is wrong with a file, or None; None too for other extensions and for null content."""
    extension = extension_of(path)
    if extension not in LANGUAGES or content is None:
        return None
    text = content[1:] if content.startswith("﻿") else content
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        if extension in ("ts", "tsx", "js"):
            check_script(text, extension)
        elif extension == "json":
            check_json(text)
        elif extension == "py":
            if "\0" in text:
                return "foreign character"
            check_python(text)
        elif extension == "go":
            check_go(text)
        elif extension == "sql":
            check_sql(text)
        else:
            check_css(text)
    except Problem as problem:
        if extension == "py":
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return str(problem)
            return None
        return str(problem)
    return None


def syntax_report(files: DataFrame, *, id: str = "file_id", project: str = "project_id", path: str = "path", content: str = "content") -> DataFrame:
    """``(file_id, project_id, language, problem)`` of every file of a checked language; ``problem`` is null if valid.

    Null or empty content has no problem (an empty JSON file has one: it holds no value), a null path has no language and no row, repeated rows collapse,
    and other columns are not read. Files of any length are read whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["problem"] = [check(p, c) for p, c in zip(batch["path"], batch["content"])]
            batch["language"] = [LANGUAGES[extension_of(p)] for p in batch["path"]]
            yield batch[["file_id", "project_id", "language", "problem"]]

    wanted = F.lower(F.regexp_extract(F.col(path), r"\.([^./]*)$", 1)).isin(list(LANGUAGES))
    return (
        files.where(wanted)
        .select(F.col(id).alias("file_id"), F.col(project).alias("project_id"), F.col(path).alias("path"), F.col(content).alias("content"))
        .mapInPandas(run, f"file_id {files.schema[id].dataType.simpleString()}, project_id string, language string, problem string")
        .distinct()
    )


def invalid_files(files: DataFrame, **columns: str) -> DataFrame:
    """``(file_id)`` of the files that are not valid."""
    return syntax_report(files, **columns).where("problem IS NOT NULL").select("file_id").distinct()


def syntax_rates(report: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per project and language."""
    return report.groupBy("project_id", "language").agg(
        F.count("*").alias("files"), F.count("problem").alias("invalid"),
        F.round(F.count("problem") / F.count("*"), 6).alias("rate"),
    )
