"""PHP tokens, and what can be said from tokens alone."""

from __future__ import annotations

import re
from dataclasses import dataclass


class PhpError(ValueError):
    """Source that cannot be read."""


@dataclass(slots=True)
class Token:
    kind: str  # open close inline var name int float string template comment op
    text: str
    line: int
    start: int


_OPS = [
    "<<<=", "**=", "...", "<=>", "===", "!==", "<<=", ">>=", "??=", "?->", "**", "=>", "->", "::", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "++", "--", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<", ">>",
    "#[",
]
_TOKEN = re.compile(
    r"(?P<ws>\s+)|(?P<comment>//[^\n]*?(?=\?>|\n|$)|\#(?!\[)[^\n]*?(?=\?>|\n|$)|/\*.*?\*/)|(?P<close>\?>\n?)|(?P<var>\$[A-Za-z_\x80-￿][\w\x80-￿]*)"
    r"|(?P<heredoc><<<[ \t]*(?P<q>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n)|(?P<float>\d[\d_]*\.[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*[eE][+-]?\d+)"
    r"|(?P<int>0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*)|(?P<name>\\?[A-Za-z_\x80-￿][\w\x80-￿]*(?:\\[A-Za-z_\x80-￿][\w\x80-￿]*)*)"
    r"|(?P<single>'(?:[^'\\]|\\.)*')|(?P<double>\"(?:[^\"\\]|\\.)*\")|(?P<back>`(?:[^`\\]|\\.)*`)|(?P<op>" + "|".join(re.escape(o) for o in _OPS) + r"|[-+*/%=<>!.,;:?(){}\[\]&|^~@$])",
    re.S,
)


def tokenize(code: str, comments: bool = False) -> list[Token]:
    out: list[Token] = []
    at, line, inside = 0, 1, False
    while at < len(code):
        if not inside:
            m = re.compile(r"<\?(?:php\b|=)", re.I).search(code, at)
            end = m.start() if m else len(code)
            if end > at:
                out.append(Token("inline", code[at:end], line, at))
                line += code.count("\n", at, end)
            if not m:
                break
            if m[0] == "<?=":
                out.append(Token("name", "echo", line, m.start()))
            at, inside = m.end(), True
            continue
        m = _TOKEN.match(code, at)
        if not m:
            raise PhpError(f"line {line}: unexpected {code[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind in ("q", "tag"):
            kind = "heredoc"
        end = m.end()
        if m["heredoc"]:
            stop = re.compile(rf"^[ \t]*{m['tag']}\b", re.M).search(code, m.end())
            if not stop:
                raise PhpError(f"line {line}: heredoc without end")
            body = code[m.end() : stop.start()]
            out.append(Token("string" if m["q"] == "'" else "template", body[:-1] if body.endswith("\n") else body, line, at))
            end = stop.end()
        elif kind == "comment":
            if comments:
                out.append(Token("comment", text, line, at))
        elif kind == "close":
            out.append(Token("op", ";", line, at))
            inside = False
        elif kind == "single":
            out.append(Token("string", re.sub(r"\\([\\'])", r"\1", text[1:-1]), line, at))
        elif kind == "double":
            body = text[1:-1]
            plain = not re.search(r"(?<!\\)(?:\\\\)*[$]|\{\$", body)
            out.append(Token("string", _unescape(body), line, at) if plain else Token("template", body, line, at))
        elif kind == "back":
            out.append(Token("template", text[1:-1], line, at))
        elif kind != "ws":
            out.append(Token(kind, text, line, at))
        line += code.count("\n", at, end)
        at = end
    return out


def _unescape(body: str) -> str:
    return re.sub(r"\\(n|t|r|v|e|f|\\|\$|\")", lambda m: {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "e": "\x1b", "f": "\f"}.get(m[1], m[1]), body)


def strip_comments(code: str) -> str:
    """Code without comments on the same lines: one on a line with code after it becomes a space."""
    try:
        found = [t for t in tokenize(code, True) if t.kind == "comment"]
    except PhpError:
        return code
    out, at = [], 0
    for t in found:
        out.append(code[at : t.start])
        lines = t.text.count("\n")
        out.append("\n" * lines if lines else " ")
        at = t.start + len(t.text)
    out.append(code[at:])
    return re.sub(r"[ \t]+(?=\r?\n|$)", "", "".join(out))


def class_declaration(code: str) -> dict | None:
    """Namespace, class, fqcn and extends of the first named class, from tokens."""
    try:
        ts = tokenize(code)
    except PhpError:
        return None
    namespace = ""
    for i, t in enumerate(ts):
        if t.kind != "name":
            continue
        word = t.text.lower()
        before = ts[i - 1] if i else None
        if word == "namespace" and i + 1 < len(ts) and ts[i + 1].kind == "name":
            namespace = ts[i + 1].text
        if word in ("class", "interface", "trait", "enum") and i + 1 < len(ts) and ts[i + 1].kind == "name" and not (before and (before.text == "::" or before.text.lower() == "new" or before.text == "->")):
            if word == "enum" and ts[i + 1].text.lower() in ("extends", "implements"):
                continue
            name = ts[i + 1].text
            parent = ts[i + 3].text if i + 3 < len(ts) and ts[i + 2].text.lower() == "extends" else None
            return {"namespace": namespace, "class": name, "fqcn": f"{namespace}\\{name}".lstrip("\\"), "extends": parent}
    return None
