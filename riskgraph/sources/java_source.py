"""Structure of Java files: packages, imports, types, methods, fields, calls, comments.

A tokenizer and one pass over the tokens, without a grammar: declarations are told by their
shape, bodies by their braces. Of a file that cannot be read so a row says why, with what a
scan line by line can tell. Files are read with ``binaryFile`` and parsed in batches, a row per file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, package string, total_lines int, code_lines int, error string, "
    "imports array<struct<import_path:string,is_static:boolean,is_wildcard:boolean>>, "
    "types array<struct<name:string,kind:string,line:int,last_line:int,modifiers:array<string>,extends:array<string>,implements:array<string>,enclosing:string,annotations:array<string>>>, "
    "methods array<struct<name:string,owner:string,line:int,last_line:int,modifiers:array<string>,returns:string,params:array<struct<type:string,name:string>>,throws:array<string>,annotations:array<string>,complexity:int,deprecated:boolean>>, "
    "fields array<struct<name:string,owner:string,type:string,line:int,modifiers:array<string>,annotations:array<string>>>, "
    "calls array<struct<owner:string,method:string,line:int,qualifier:string,name:string,argc:int,receiver_type:string,receiver_source:string>>, "
    "docs array<struct<kind:string,start_line:int,end_line:int,text:string>>"
)
# Words of the language.
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "default", "synchronized", "native", "strictfp", "transient", "volatile", "sealed", "non-sealed"}
TYPE_WORDS = {"class", "interface", "enum", "record"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "super", "this", "try", "assert", "new", "else", "do", "case", "yield"}
DECISIONS = {"if", "for", "while", "case", "catch", "&&", "||", "?"}

_TOKEN = re.compile(
    r"""(?P<doc>/\*.*?\*/)|(?P<line>//[^\n]*)|(?P<text>\"\"\".*?\"\"\")|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<chr>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<word>non-sealed|@?[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>&&|\|\||->|::|\.\.\.|[^\s\w])""",
    re.S,
)


class Token:
    __slots__ = ("text", "kind", "line")

    def __init__(self, text: str, kind: str, line: int):
        self.text, self.kind, self.line = text, kind, line


def tokens(code: str) -> tuple[list[Token], list[dict]]:
    """Tokens without comments, and the comments."""
    out, docs, line, at = [], [], 1, 0
    for m in _TOKEN.finditer(code):
        line += code.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup in ("doc", "line"):
            kind = "javadoc" if m[0].startswith("/**") else "block" if m.lastgroup == "doc" else "line"
            docs.append({"kind": kind, "start_line": line, "end_line": line + m[0].count("\n"), "text": m[0][:1000]})
        else:
            out.append(Token(m[0], m.lastgroup, line))
    return out, docs


class _Parser:
    def __init__(self, code: str):
        self.t, self.docs = tokens(code)
        self.package, self.imports, self.types, self.methods, self.fields, self.calls = "", [], [], [], [], []

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def close(self, i: int, left: str, right: str) -> int:
        """Index of the sign that closes the one at i, or the end."""
        depth = 0
        for j in range(i, len(self.t)):
            depth += (self.t[j].text == left) - (self.t[j].text == right)
            if not depth:
                return j
        return len(self.t) - 1

    def name(self, i: int) -> tuple[str, int]:
        """A dotted name from i, and the index after it."""
        parts = [self.at(i)]
        i += 1
        while self.at(i) == "." and (self.at(i + 1) == "*" or self.t[i + 1].kind == "word"):
            parts.append(self.at(i + 1))
            i += 2
        return ".".join(parts), i

    def type_name(self, i: int) -> tuple[str, int]:
        """A type with its type arguments and brackets left out of the name, and the index after it."""
        text, i = self.name(i)
        if self.at(i) == "<":
            i = self.close(i, "<", ">") + 1
        while self.at(i) in ("[", "]", "..."):
            i += 1
        return text, i

    def run(self) -> "_Parser":
        i = 0
        while i < len(self.t):
            w = self.at(i)
            if w == "package":
                self.package, i = self.name(i + 1)
            elif w == "import":
                static = self.at(i + 1) == "static"
                path, i = self.name(i + 1 + static)
                self.imports.append({"import_path": path.removesuffix(".*"), "is_static": static, "is_wildcard": path.endswith(".*")})
            elif w == ";":
                i += 1
            else:
                i = self.member(i, None)
        return self

    def member(self, i: int, owner: str | None) -> int:
        """One declaration from i; the index after it."""
        marks, words, start = [], [], i
        while i < len(self.t):
            w = self.at(i)
            if w.startswith("@") and w != "@interface" and not (w == "@" and self.at(i + 1) == "interface"):
                text, i = self.name(i)
                marks.append(text.lstrip("@"))
                if self.at(i) == "(":
                    i = self.close(i, "(", ")") + 1
            elif w in MODIFIERS:
                words.append(w)
                i += 1
            else:
                break
        w = self.at(i)
        if w == "@" or w == "@interface":
            i += 1 + (w == "@")
            return self.declared_type(i - 1, "annotation", owner, words, marks)
        if w in TYPE_WORDS and self.t[i + 1].kind == "word" and not (w == "record" and self.at(i + 2) not in ("(", "<")):
            return self.declared_type(i, w, owner, words, marks)
        if w == "{":
            end = self.close(i, "{", "}")
            self.body(i, end, owner, "<init>", {})
            return end + 1
        if i < len(self.t) and w == "<":
            i = self.close(i, "<", ">") + 1
        if i >= len(self.t) or self.t[i].kind != "word":
            return max(i, start) + 1
        kind, j = self.type_name(i)
        if self.at(j) == "(":  # a constructor
            return self.declared_method(i, j, "", owner, words, marks, constructor=True)
        if j < len(self.t) and self.t[j].kind == "word":
            if self.at(j + 1) == "(":
                return self.declared_method(j, j + 1, kind, owner, words, marks)
            while j < len(self.t):
                self.fields.append({"name": self.at(j), "owner": owner, "type": kind, "line": self.t[j].line, "modifiers": words, "annotations": marks})
                depth = 0
                while j < len(self.t) and not (not depth and self.at(j) in (",", ";")):
                    depth += (self.at(j) in ("(", "{", "[")) - (self.at(j) in (")", "}", "]"))
                    j += 1
                if self.at(j) != ",":
                    break
                j += 1
            return j + 1
        return j + 1

    def declared_type(self, i: int, kind: str, owner: str | None, words: list[str], marks: list[str]) -> int:
        name, line = self.at(i + 1), self.t[i].line
        j = i + 2
        up: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        if self.at(j) == "<":
            j = self.close(j, "<", ">") + 1
        if self.at(j) == "(":
            end = self.close(j, "(", ")")
            for p in self.parameters(j, end):
                self.fields.append({"name": p["name"], "owner": name, "type": p["type"], "line": line, "modifiers": ["private", "final"], "annotations": []})
            j = end + 1
        while j < len(self.t) and self.at(j) != "{":
            if self.at(j) in up:
                which = up[self.at(j)]
                j += 1
                while j < len(self.t) and self.at(j) not in ("{", *up):
                    text, j = self.type_name(j)
                    which.append(text)
                    j += self.at(j) == ","
            else:
                j += 1
        end = self.close(j, "{", "}") if j < len(self.t) else j
        self.types.append({
            "name": name, "kind": kind, "line": line, "last_line": self.t[min(end, len(self.t) - 1)].line, "modifiers": words, "extends": up["extends"],
            "implements": up["implements"], "enclosing": owner, "annotations": marks,
        })
        k = j + 1
        if kind == "enum":
            depth = 0
            while k < end and not (not depth and self.at(k) == ";"):
                depth += (self.at(k) in ("(", "{")) - (self.at(k) in (")", "}"))
                k += 1
            k += 1
        while k < end:
            k = k + 1 if self.at(k) == ";" else self.member(k, name)
        return end + 1

    def parameters(self, left: int, right: int) -> list[dict]:
        out, i = [], left + 1
        while i < right:
            while self.at(i) == "final" or self.at(i).startswith("@"):
                i += 1
                if self.at(i) == "(":
                    i = self.close(i, "(", ")") + 1
            kind, i = self.type_name(i)
            out.append({"type": kind, "name": self.at(i)})
            while i < right and self.at(i) != ",":
                i += 1
            i += 1
        return out

    def declared_method(self, i: int, left: int, returns: str, owner: str | None, words: list[str], marks: list[str], constructor: bool = False) -> int:
        right = self.close(left, "(", ")")
        params, j, throws = self.parameters(left, right), right + 1, []
        while j < len(self.t) and self.at(j) not in ("{", ";"):
            if self.at(j) == "throws":
                j += 1
                while j < len(self.t) and self.at(j) not in ("{", ";"):
                    text, j = self.type_name(j)
                    throws.append(text)
                    j += self.at(j) == ","
            else:
                j += 1
        end = self.close(j, "{", "}") if self.at(j) == "{" else j
        name = self.at(i)
        decisions = sum(self.at(k) in DECISIONS and not (self.at(k) == "?" and self.at(k - 1) in ("<", ",")) for k in range(j, end))
        if not constructor:
            self.methods.append({
                "name": name, "owner": owner, "line": self.t[i].line, "last_line": self.t[min(end, len(self.t) - 1)].line, "modifiers": words, "returns": returns,
                "params": params, "throws": throws, "annotations": marks, "complexity": 1 + decisions, "deprecated": "Deprecated" in marks,
            })
        if self.at(j) == "{":
            self.body(j, end, owner, name, {p["name"]: p["type"] for p in params})
        return end + 1

    def body(self, left: int, right: int, owner: str | None, method: str, params: dict[str, str]) -> None:
        """Calls within braces; receivers are typed by locals, parameters, then fields."""
        local: dict[str, str] = {}
        for i in range(left, right):
            t = self.t[i]
            if t.kind != "word" or t.text.startswith("@"):
                continue
            if self.at(i - 1) in ("{", ";", "(", "}", "final") and t.text[:1].isupper():
                kind, j = self.type_name(i)
                if j < right and self.t[j].kind == "word" and self.at(j + 1) in ("=", ";", ":"):
                    local[self.at(j)] = kind
            if t.text == "new":
                kind, j = self.type_name(i + 1)
                if self.at(j) == "(":
                    self.call(owner, method, t.line, "new", kind, j, {}, {})
            elif self.at(i + 1) == "(" and t.text not in NOT_CALLS and self.at(i - 1) != "new" and not (self.at(i - 1) == "." and self._created(i)):
                parts, k = [], i - 1
                while self.at(k) == "." and k > left and self.t[k - 1].kind == "word":
                    parts.insert(0, self.at(k - 1))
                    k -= 2
                qualifier = ".".join(parts) if parts else ("" if self.at(i - 1) != "." else "<expression>")
                self.call(owner, method, t.line, qualifier, t.text, i + 1, local, params)

    def _created(self, i: int) -> bool:
        k = i - 1
        while self.at(k) == "." and self.t[k - 1].kind == "word":
            k -= 2
        return self.at(k) == "new"

    def call(self, owner, method, line: int, qualifier: str, name: str, left: int, local: dict, params: dict) -> None:
        right, argc, depth = self.close(left, "(", ")"), 0, 0
        if right > left + 1:
            argc = 1
            for j in range(left + 1, right):
                depth += (self.at(j) in ("(", "{", "[")) - (self.at(j) in (")", "}", "]"))
                argc += not depth and self.at(j) == ","
        kind = source = None
        if qualifier in local:
            kind, source = local[qualifier], "local"
        elif qualifier in params:
            kind, source = params[qualifier], "param"
        elif qualifier not in ("", "new"):
            kind = next((f["type"] for f in self.fields if f["owner"] == owner and f["name"] == qualifier), None)
            source = "field" if kind else None
        self.calls.append({"owner": owner, "method": method, "line": line, "qualifier": qualifier, "name": name, "argc": argc, "receiver_type": kind, "receiver_source": source})


def parse(code: str, path: str) -> dict:
    """The parts of one file as a row."""
    lines = code.split("\n")
    row = {"path": path, "package": None, "total_lines": len(lines), "code_lines": sum(bool(x.strip()) and not x.strip().startswith("//") for x in lines), "error": None}
    try:
        p = _Parser(code).run()
        return row | {"package": p.package, "imports": p.imports, "types": p.types, "methods": p.methods, "fields": p.fields, "calls": p.calls, "docs": p.docs}
    except Exception as e:  # whatever a file holds, the others are read; the row says what went wrong
        row["error"] = type(e).__name__
    try:
        return row | scanned(lines)
    except Exception:
        return row | {"imports": [], "types": [], "methods": [], "fields": [], "calls": [], "docs": []}


_DECLARED = re.compile(r"\b(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)")
_IMPORTED = re.compile(r"\s*import\s+(static\s+)?([\w.$]+?)(\.\*)?\s*;")
_HEADED = re.compile(r"^\s*((?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)([\w$.]+(?:<[^<>()]*>)?(?:\[\])*)\s+([a-zA-Z_$][\w$]*)\s*\(([^()]*)\)?")
_COMMENTED = re.compile(r"\s*(/\*|\*|//)")


def scanned(lines: list[str]) -> dict:
    """What can be told line by line of a file that has no readable structure: package, imports, types, heads of methods and comments.

    Methods belong to the last type declared above them; lengths, calls and fields are not told.
    """
    out: dict = {"package": "", "imports": [], "types": [], "methods": [], "fields": [], "calls": [], "docs": []}
    comment = None
    for at, line in enumerate(lines, 1):
        if _COMMENTED.match(line):
            comment = comment or at
            continue
        if comment is not None:
            text = "\n".join(lines[comment - 1 : at - 1]).strip()
            kind = "javadoc" if text.startswith("/**") else "block" if text.startswith("/*") else "line"
            out["docs"].append({"kind": kind, "start_line": comment, "end_line": at - 1, "text": text[:1000]})
            comment = None
        if not out["package"] and (found := re.match(r"\s*package\s+([\w.$]+)\s*;", line)):
            out["package"] = found[1]
        elif found := _IMPORTED.match(line):
            out["imports"].append({"import_path": found[2], "is_static": bool(found[1]), "is_wildcard": bool(found[3])})
        elif found := _DECLARED.search(line):
            above = {"modifiers": [], "extends": [], "implements": [], "enclosing": None, "annotations": []}
            out["types"].append({"name": found[2], "kind": found[1], "line": at, "last_line": len(lines), **above})
        elif (found := _HEADED.match(line)) and found[2] not in NOT_CALLS and found[3] not in NOT_CALLS:
            owner = out["types"][-1]["name"] if out["types"] else None
            params = [p.split() for p in found[4].split(",") if len(p.split()) > 1]
            out["methods"].append({
                "name": found[3], "owner": owner, "line": at, "last_line": at, "modifiers": found[1].split(), "returns": found[2],
                "params": [{"type": p[-2], "name": p[-1]} for p in params], "throws": [], "annotations": [], "complexity": 1, "deprecated": False,
            })
    return out


def java_files(spark: SparkSession, root: str, subset: DataFrame | None = None) -> DataFrame:
    """A row of parts for every Java file below a folder, or for those of ``subset(path)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").load(root).select("path", "content")
    if subset is not None:
        files = files.join(subset.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parse(bytes(c).decode("utf-8", "replace"), p) for p, c in zip(pdf["path"], pdf["content"])])

    return files.mapInPandas(run, SCHEMA)


def exploded(files: DataFrame, part: str) -> DataFrame:
    """Rows of one kind of part with path and package of their file."""
    return files.select("path", "package", F.explode(part).alias("x")).select("path", "package", "x.*")


def directories(files: DataFrame) -> DataFrame:
    """Rows (path, parent) of all folders above the files."""
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).filter("path <> ''").distinct()
    return above.withColumn("parent", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
