"""Go sources, by a token scanner."""

from __future__ import annotations

import re

from graphloom.lang.base import Analysis
from graphloom.lang.tokens import Token, match, scan, unquote

#: File name endings of other platforms than linux on amd64.
SYSTEMS = (
    "aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "js", "nacl", "netbsd", "openbsd", "plan9",
    "solaris", "wasip1", "windows", "zos",
)
MACHINES = (
    "386", "arm", "arm64", "loong64", "mips", "mips64", "mips64le", "mipsle", "ppc64", "ppc64le", "riscv64", "s390x", "sparc64", "wasm",
)
TRUE_TAGS = {"linux", "amd64", "unix", "gc", "cgo"}
KEYWORDS = {
    "if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "map", "chan", "struct", "interface", "type",
    "var", "const", "package", "import", "make", "len", "cap", "append", "copy", "delete", "panic", "recover", "print", "println",
    "new", "close", "string", "int", "int64", "float64", "byte", "rune", "bool", "error", "else", "goto", "break", "continue",
}
_LITERAL_BEFORE = {"=", ":=", "(", ",", "[", "{", "&", "return", ":", "]", "<-", "=="}


def other_platform(path: str) -> bool:
    """Whether a file name ends in another system or machine, after some other part."""
    parts = path.rsplit("/", 1)[-1].removesuffix(".go").split("_")
    if len(parts) > 2 and parts[-2] in (*SYSTEMS, "linux") and parts[-1] in (*MACHINES, "amd64") and "_".join(parts[:-2]):
        return parts[-2] in SYSTEMS or parts[-1] in MACHINES
    return len(parts) > 1 and bool("_".join(parts[:-1])) and parts[-1] in (*SYSTEMS, *MACHINES)


def build_matches(expression: str) -> bool:
    """A //go:build expression of tags, !, && and ||, on linux and amd64; one with parentheses is taken to match."""
    if "(" in expression:
        return True
    holds = lambda tag: (tag.lstrip("!").strip() in TRUE_TAGS or bool(re.fullmatch(r"go1\.\d+", tag.lstrip("!").strip()))) != (tag.count("!") % 2 == 1)
    return any(all(holds(tag.strip()) for tag in part.split("&&")) for part in expression.split("||"))


class Go:
    language = "go"

    def can_handle(self, path: str) -> bool:
        return path.endswith(".go") and not path.endswith("_test.go") and not other_platform(path)

    def nesting(self, text: str) -> int:
        raise NotImplementedError("E015: nesting of Go sources")

    def functions(self, text: str) -> int:
        return len(re.findall(r"(?m)^func\b", text))

    def analyze(self, text: str, path: str) -> Analysis:
        out = Analysis(path, self.language)
        out.nodes[0]["end_line"] = max(1, text.count("\n") + 1)
        head = text.split("\npackage ", 1)[0]
        tag = re.search(r"(?m)^//go:build (.+)$", head)
        if tag and not build_matches(tag[1]):
            return out
        t = scan(text, go=True)
        names: set[str] = set()
        exported: set[str] = set()
        i = 0
        while i < len(t):
            word = t[i].text
            if word == "import":
                i = self._imports(out, t, i)
            elif word == "func":
                i = self._function(out, text, t, i, exported)
            elif word == "type":
                i = self._block(t, i, lambda a: self._type(out, text, t, a, exported))
            elif word in ("const", "var"):
                if word == "var":
                    names.add("var")
                i = self._block(t, i, lambda a: self._variable(out, text, t, a, exported))
            else:
                i += 1
        self._calls(out, t)
        self._contain(out)
        out.export(exported)
        self._classify(out, t)
        return out

    def _block(self, t: list[Token], i: int, one) -> int:
        """Declarations after a keyword: one, or a list in parentheses, each on its own line."""
        if i + 1 < len(t) and t[i + 1].text == "(":
            stop, j = match(t, i + 1), i + 2
            while j < stop:
                j = max(one(j), j + 1)
                while j < stop and t[j].line == t[j - 1].line and t[j - 1].text != ";":
                    j += 1
            return stop + 1
        return max(one(i + 1), i + 2)

    def _imports(self, out: Analysis, t: list[Token], i: int) -> int:
        stop = match(t, i + 1) if t[i + 1].text == "(" else i + 3
        for j in range(i + 1, min(stop, len(t))):
            if t[j].kind == "string":
                path = unquote(t[j])
                before = t[j - 1]
                alias = before.text if before.line == t[j].line and (before.kind == "name" and before.text != "import" or before.text == ".") else None
                if alias == "_":
                    out.imported(path, kind="side_effect")
                elif alias == ".":
                    out.imported(path)
                else:
                    out.imported(path, path.rsplit("/", 1)[-1], alias, "namespace")
                if t[i + 1].text != "(":
                    return j + 1
        return stop + 1

    def _function(self, out: Analysis, text: str, t: list[Token], i: int, exported: set[str]) -> int:
        j, owner = i + 1, None
        if t[j].text == "(":
            stop = match(t, j)
            named = [x.text for x in t[j + 1 : stop] if x.kind == "name"]
            generic = next((k for k in range(j, stop) if t[k].text == "["), stop)
            named = [x.text for x in t[j + 1 : generic] if x.kind == "name"] or named
            owner, j = named[-1], stop + 1
        name = t[j].text
        j += 1
        if t[j].text == "[":
            j = match(t, j) + 1
        j = match(t, j) + 1
        while j < len(t) and t[j].text != "{" and t[j].line == t[j - 1].line:
            if t[j].text in ("interface", "struct") and j + 1 < len(t) and t[j + 1].text == "{":
                j = match(t, j + 1) + 1
                continue
            j = match(t, j) + 1 if t[j].text in ("(", "[") else j + 1
        has_body = j < len(t) and t[j].text == "{"
        stop = match(t, j) if has_body else j - 1
        full = f"{owner}.{name}" if owner else name
        cut = t[j].start if has_body else t[stop].end
        out.node("function", full, t[i].line, t[stop].line, signature=re.sub(r"\s+", " ", text[t[i].start : cut]).strip())
        if name[:1].isupper():
            exported.add(full)
        return stop + 1

    def _type(self, out: Analysis, text: str, t: list[Token], i: int, exported: set[str]) -> int:
        name, j = t[i].text, i + 1
        if j < len(t) and t[j].text == "[" and j + 1 < len(t) and t[j + 1].kind == "name" and t[match(t, j) + 1].text in ("struct", "interface", "func", "map", "["):
            j = match(t, j) + 1
        alias = j < len(t) and t[j].text == "="
        j += alias
        kind = {"struct": "class", "interface": "interface"}.get(t[j].text if j < len(t) else "", "type_alias")
        stop = j
        if kind != "type_alias":
            stop = match(t, j + 1)
        else:
            while stop + 1 < len(t) and t[stop + 1].line == t[stop].line:
                stop = match(t, stop + 1) if t[stop + 1].text in "([{" else stop + 1
        node = out.node(kind, name, t[i].line, t[stop].line, signature=f"type {name} {t[j].text}")
        if name[:1].isupper():
            exported.add(name)
        if kind == "class":
            k = j + 2
            while k < stop:
                line = t[k].line
                row = []
                while k < stop and t[k].line == line:
                    row.append(t[k])
                    k = match(t, k) + 1 if t[k].text in "([{" else k + 1
                plain = [x for x in row if x.kind != "string" and x.text != "*"]
                if [x.kind for x in plain] == ["name"] or [x.text if x.kind == "mark" else x.kind for x in plain] == ["name", ".", "name"]:
                    out.edge(node, f"class:{out.path}:{plain[-1].text}", "extends")
        return stop + 1

    def _variable(self, out: Analysis, text: str, t: list[Token], i: int, exported: set[str]) -> int:
        j, found = i, []
        while j < len(t) and t[j].kind == "name" and t[j].line == t[i].line:
            found.append(t[j])
            if j + 1 < len(t) and t[j + 1].text == ",":
                j += 2
                continue
            break
        for x in found:
            if x.text != "_":
                out.node("variable", x.text, x.line, x.line)
                if x.text[:1].isupper():
                    exported.add(x.text)
        while j + 1 < len(t) and t[j + 1].line == t[j].line:
            j = match(t, j + 1) if t[j + 1].text in "([{" else j + 1
        return j + 1

    def _calls(self, out: Analysis, t: list[Token]) -> None:
        at = lambda k: t[k].text if 0 <= k < len(t) else ""
        for i, x in enumerate(t):
            if x.kind != "name" or at(i - 1) in (".", "func", "type"):
                continue
            path, j = [x.text], i
            while at(j + 1) == "." and j + 2 < len(t) and t[j + 2].kind == "name":
                path.append(t[j + 2].text)
                j += 2
            if at(j + 1) == "{" and path[-1][:1].isalpha() and at(i - 1) in _LITERAL_BEFORE and path[0] not in KEYWORDS:
                if path[-1][:1].isupper() or len(path) == 1:
                    out.called(".".join(path), True)
                    k = i - 1 - (at(i - 1) == "&")
                    if at(k) in (":=", "=") and k > 0 and t[k - 1].kind == "name":
                        out.bindings.append(dict(variable=t[k - 1].text, type=".".join(path)))
            elif at(j + 1) == "(" and (len(path) > 1 or path[0] not in KEYWORDS) and not (at(i - 1) == ")" and at(i - 2) != ""):
                out.called(".".join(path))

    def _contain(self, out: Analysis) -> None:
        types = {n["name"]: n["id"] for n in out.nodes if n["node_type"] in ("class", "type_alias")}
        for n in out.nodes:
            owner = n["name"].split(".")[0]
            if n["node_type"] == "function" and "." in n["name"] and owner in types:
                out.edge(types[owner], n["id"], "contains")

    def _classify(self, out: Analysis, t: list[Token]) -> None:
        danger = set()
        words = {x.text for x in t if x.kind == "name"}
        if words & {"go", "select", "chan"} or any(x.text == "<-" for x in t):
            danger.add("concurrency")
        paths = {m["specifier"] for m in out.imports}
        if "reflect" in paths:
            danger.add("dynamic_reflection")
        if paths & {"unsafe", "C"}:
            danger.add("ffi")
        out.danger = sorted(danger)
        busy = any(n["node_type"] in ("function", "class") for n in out.nodes)
        out.tier = "full" if danger else "standard" if busy else "trivial"
        out.file_kind = "normal"
