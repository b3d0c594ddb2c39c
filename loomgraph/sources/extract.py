"""Facts of source files: Python by its own parser, Markdown and configuration by rules, other languages by line patterns."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "file_path string, fact string, name string, qualified string, kind string, span_start long, span_end long, line long, value string, target string"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
MAX_DEPTH = 1536
#: Definitions that qualify what is in them; deeper ones, as in a file of unclosed braces, don't.
MAX_NESTING = 64

#: By language: (kind, pattern whose first group is the name) of definitions that start a line.
PATTERNS = {
    "rust": [("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("module", r"\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), ("const", r"\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)"), ("type_alias", r"\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)")],
    "javascript": [("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"\s*(?:export\s+)?interface\s+(\w+)"), ("enum", r"\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("type_alias", r"\s*(?:export\s+)?type\s+(\w+)\s*[=<]")],
    "go": [("method", r"func\s+\([^)]*\)\s*(\w+)"), ("function", r"func\s+(\w+)"), ("struct", r"type\s+(\w+)\s+struct\b"), ("interface", r"type\s+(\w+)\s+interface\b"), ("type_alias", r"type\s+(\w+)\s+(?!struct\b|interface\b)")],
    "java": [("class", r"\s*(?:[a-z]+\s+)*class\s+(\w+)"), ("interface", r"\s*(?:[a-z]+\s+)*interface\s+(\w+)"), ("enum", r"\s*(?:[a-z]+\s+)*enum\s+(\w+)"), ("method", r"\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], .]+\s+(\w+)\s*\(")],
    "csharp": [("namespace", r"\s*namespace\s+([\w.]+)"), ("class", r"\s*(?:[a-z]+\s+)*class\s+(\w+)"), ("struct", r"\s*(?:[a-z]+\s+)*struct\s+(\w+)"), ("interface", r"\s*(?:[a-z]+\s+)*interface\s+(\w+)"), ("enum", r"\s*(?:[a-z]+\s+)*enum\s+(\w+)"), ("method", r"\s+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)+[\w<>\[\], .?]+\s+(\w+)\s*\(")],
    "kotlin": [("class", r"\s*(?:[a-z]+\s+)*class\s+(\w+)"), ("interface", r"\s*(?:[a-z]+\s+)*interface\s+(\w+)"), ("object", r"\s*(?:[a-z]+\s+)*object\s+(\w+)"), ("function", r"\s*(?:[a-z]+\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)"), ("type_alias", r"\s*(?:[a-z]+\s+)*typealias\s+(\w+)")],
    "ruby": [("module", r"\s*module\s+([\w:]+)"), ("class", r"\s*class\s+([\w:]+)"), ("method", r"\s*def\s+(?:self\.)?([\w?!=]+)")],
    "c": [("struct", r"\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("union", r"\s*(?:typedef\s+)?union\s+(\w+)\s*\{"), ("enum", r"\s*(?:typedef\s+)?enum\s+(\w+)\s*\{"), ("function", r"(?!\s|return\b|else\b|if\b)[\w\s*]+?\b(\w+)\s*\([^;]*\)\s*\{?\s*$")],
}
PATTERNS["typescript"] = PATTERNS["javascript"]
IMPORTS = {
    "rust": r"\s*(?:pub\s+)?use\s+([\w:]+)", "javascript": r"\s*(?:import|export)\b.*?from\s+['\"]([^'\"]+)", "typescript": r"\s*(?:import|export)\b.*?from\s+['\"]([^'\"]+)", "go": r"\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$",
    "java": r"\s*import\s+(?:static\s+)?([\w.]+)", "csharp": r"\s*using\s+([\w.]+)\s*;", "kotlin": r"\s*import\s+([\w.]+)", "ruby": r"\s*require(?:_relative)?\s+['\"]([^'\"]+)", "c": r"\s*#\s*include\s*[<\"]([^>\"]+)",
}
_NEXT_BRACE = re.compile(rb"\r?\n[ \t]*\{")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "return", "match", "catch", "fn", "def", "func", "fun", "function", "class", "sizeof", "elif", "and", "or", "not", "in", "new", "when"}


def fact(path: str, kind_of_fact: str, **own) -> tuple:
    return tuple({"file_path": path, "fact": kind_of_fact, **own}.get(c) for c in COLUMNS)


def line_starts(content: bytes) -> list[int]:
    out, at = [0], content.find(b"\n")
    while at >= 0:
        out.append(at + 1)
        at = content.find(b"\n", at + 1)
    return out


def python_facts(path: str, content: bytes) -> list[tuple]:
    """Functions, methods and classes with byte spans; calls, imports, bases and notable strings."""
    starts = line_starts(content)
    at = lambda node, end=False: starts[(node.end_lineno if end else node.lineno) - 1] + (node.end_col_offset if end else node.col_offset)
    out: list[tuple] = []
    todo: list[tuple[ast.AST, str, bool, int]] = [(ast.parse(content), "", False, 0)]
    while todo:
        node, outer, in_class, depth = todo.pop()
        if depth > MAX_DEPTH:
            raise ValueError("nested too deep")
        inner, inner_class = outer, in_class
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            inner, inner_class = f"{outer}::{node.name}" if outer else node.name, kind == "class"
            out.append(fact(path, "symbol", name=node.name, qualified=inner, kind=kind, span_start=at(node), span_end=at(node, True), line=node.lineno))
            if kind == "class":
                out += [fact(path, "relation", name=inner, kind="extends", target=ast.unparse(b), span_start=at(b), span_end=at(b, True), line=b.lineno) for b in node.bases]
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                value = ast.unparse(node.func.value) if isinstance(node.func, ast.Attribute) else None
                out.append(fact(path, "ref", name=name, kind="call", span_start=at(node.func), span_end=at(node.func, True), line=node.lineno, value=value))
        elif isinstance(node, ast.Import):
            out += [fact(path, "import", target=a.name, name=a.asname, line=node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [fact(path, "import", target="." * node.level + (node.module or ""), name=a.name, value=a.asname, line=node.lineno) for a in node.names]
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and notable(node.value):
            out.append(fact(path, "string", value=node.value, line=node.lineno))
        todo += [(child, inner, inner_class, depth + 1) for child in ast.iter_child_nodes(node)]
    return out


def notable(value: str) -> bool:
    return len(value) >= 6 and any(c.isalnum() for c in value) and any(c.isalpha() for c in re.sub(r"\{[^}]*\}|%[a-z]", "", value))


def markdown_facts(path: str, content: bytes) -> list[tuple]:
    """Headings, each spanning to the next of the same or a shallower depth; links and fenced code as strings."""
    out, heads, fence, at = [], [], None, 0
    for number, raw in enumerate(content.split(b"\n"), 1):
        line = raw.decode("utf-8", "replace")
        if m := re.match(r"\s*(```+|~~~+)", line):
            if fence is None:
                fence = (m[1][0], number, [])
            elif m[1][0] == fence[0]:
                out.append(fact(path, "string", value="\n".join(fence[2]), line=fence[1]))
                fence = None
        elif fence is not None:
            fence[2].append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            heads.append((len(m[1]), m[2], at, number))
        else:
            out += [fact(path, "string", value=f"{a} {b}", line=number) for a, b in re.findall(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", line)]
        at += len(raw) + 1
    stack: list[tuple[int, str]] = []
    ends, later = [len(content)] * len(heads), []
    for k in range(len(heads) - 1, -1, -1):  # later heads of ever smaller depth: what is deeper ends nothing above
        while later and heads[later[-1]][0] > heads[k][0]:
            later.pop()
        ends[k] = heads[later[-1]][2] if later else len(content)
        later.append(k)
    for (depth, title, start, number), end in zip(heads, ends, strict=True):
        slug = re.sub(r"[ _-]+", "-", re.sub(r"[^a-z0-9 _-]+", "", title.lower())).strip("-") or "section"
        stack = [s for s in stack if s[0] < depth] + [(depth, slug)]
        out.append(fact(path, "symbol", name=title, qualified="::".join(s for _, s in stack), kind="heading", span_start=start, span_end=end, line=number))
    return out


def flatten_keys(value, prefix: str = "") -> list[str]:
    """Dotted paths of nested objects; arrays are not descended."""
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            key = f"{prefix}.{k}" if prefix else str(k)
            out += [key, *flatten_keys(v, key)]
    return out


def config_facts(path: str, content: bytes) -> list[tuple]:
    text, ending = content.decode("utf-8", "replace"), path.rsplit(".", 1)[-1].lower()
    if ending == "json":
        keys, kind = flatten_keys(json.loads(text)), "json"
    elif ending == "toml":
        keys, kind = flatten_keys(tomllib.loads(text)), "toml"
    elif ending in ("yaml", "yml"):
        import yaml

        keys, kind = [k for part in yaml.safe_load_all(text) for k in flatten_keys(part)], "yaml"
    else:
        keys, kind = re.findall(r"(?m)^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=", text), "env"
    lines = text.split("\n")
    first: dict[str, int] = {}
    for number, line in enumerate(lines, 1):
        for word in re.findall(r"[\w-]+", line):
            first.setdefault(word, number)

    def place(key: str) -> int:
        """The first line that has the key's last part as a word; where that part is no word, as text."""
        own = key.rsplit(".", 1)[-1]
        if re.fullmatch(r"[\w-]+", own):
            return first.get(own, 1)
        at = text.find(own)
        return 1 + text.count("\n", 0, at) if own and at >= 0 else 1

    return [fact(path, "config", name=k, kind=kind, line=place(k)) for k in keys]


def masked(content: bytes, lang: str) -> bytes:
    """The content with comments and literals blanked, byte for byte, so that braces and names in them count for nothing."""
    single = rb"'(?:\\.|[^'\\\n])*'" if lang in ("javascript", "typescript", "ruby") else rb"'(?:\\.[^'\n]*|[^'\\\n]{1,4})'"
    comment = rb"\#[^\n]*" if lang == "ruby" else rb"//[^\n]*|/\*.*?(?:\*/|\Z)"
    literals = re.compile(rb"%s|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|%s" % (comment, single), re.S)
    return literals.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), content)


def closing_braces(code: bytes) -> dict[int, int]:
    """Where the block of each opening brace ends: behind the brace that closes it, or at the end of the file."""
    ends, opened = {}, []
    for m in re.finditer(rb"[{}]", code):
        if m[0] == b"{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends | dict.fromkeys(opened, len(code))


def pattern_facts(path: str, content: bytes, lang: str) -> list[tuple]:
    """Definitions, imports and calls by line patterns; a definition spans to the brace that closes it, or its line, and is qualified by the definitions around it."""
    out, at = [], 0
    patterns = [(k, re.compile(p)) for k, p in PATTERNS[lang]]
    imports = re.compile(IMPORTS[lang])
    code = masked(content, lang)
    ends, around = closing_braces(code), []
    for number, (raw, bare) in enumerate(zip(content.split(b"\n"), code.split(b"\n"), strict=True), 1):
        line = bare.decode("utf-8", "replace")
        defined = None
        while around and around[-1][0] <= at:
            around.pop()
        for kind, pattern in patterns:
            if m := pattern.match(line):
                defined = m[1]
                qualified = "::".join([around[-1][1], defined] if around else [defined])
                end = ends.get(opening_brace(code, at, len(raw)), at + len(raw))
                out.append(fact(path, "symbol", name=defined, qualified=qualified, kind=kind, span_start=at, span_end=end, line=number))
                if end > at + len(raw) and len(around) < MAX_NESTING:
                    around.append((end, qualified))
                break
        if m := imports.match(raw.decode("utf-8", "replace")):
            out.append(fact(path, "import", target=m[1], line=number))
        else:
            for m in _CALL.finditer(line):
                if m[1] != defined and m[1] not in _KEYWORDS:
                    start = at + len(line[: m.start(1)].encode())
                    out.append(fact(path, "ref", name=m[1], kind="call", span_start=start, span_end=start + len(m[1]), line=number))
        at += len(raw) + 1
    return out


def opening_brace(code: bytes, start: int, width: int) -> int:
    """The first brace of a line, or one that the next line starts with; -1 without either."""
    at = code.find(b"{", start, start + width)
    if at < 0 and (m := _NEXT_BRACE.match(code, start + width)):
        at = m.end() - 1
    return at


def facts_of(path: str, content: bytes, lang: str) -> list[tuple]:
    """All facts of a file, or one ``failure``: never part of them."""
    try:
        if lang == "python":
            out = python_facts(path, content)
        elif lang == "markdown":
            out = markdown_facts(path, content)
        elif lang == "config":
            out = config_facts(path, content)
        elif lang in PATTERNS:
            out = pattern_facts(path, content, lang)
        else:
            return []
    except Exception as e:  # a file that can't be parsed is reported as such
        return [fact(path, "failure", value=f"{type(e).__name__}: {e}"[:200])]
    return list(dict.fromkeys(out))


def extract(files: DataFrame) -> DataFrame:
    """One row per fact of files (path, content, lang)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, lang in zip(batch["path"], batch["content"], batch["lang"], strict=True):
                if content is not None and lang:
                    out = pd.DataFrame(facts_of(path, bytes(content), lang), columns=COLUMNS)
                    for c in ("span_start", "span_end", "line"):
                        out[c] = out[c].astype("Int64")
                    yield out

    return files.select("path", "content", "lang").mapInPandas(run, FACTS)
