"""TypeScript sources, by a token scanner."""

from __future__ import annotations

import re

from graphloom.lang.base import Analysis
from graphloom.lang.tokens import Token, match, nesting, scan, unquote

#: Modules and names that tell a danger or raise the tier.
IO_MODULES = ("fs", "net", "http", "https", "child_process", "os", "process", "dgram", "tls", "readline", "worker_threads", "path")
TIMERS = (
    "Promise.all", "Promise.race", "Promise.allSettled", "Promise.any", "setTimeout", "setInterval", "setImmediate",
    "process.nextTick", "queueMicrotask",
)
NUMERIC = ("parseFloat", "parseInt", "Number", "Number.isNaN", "Number.isFinite")
KEYWORDS = {
    "if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "constructor", "new", "do",
    "else", "try", "throw", "case", "delete", "void", "in", "of", "instanceof", "yield", "with",
}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "accessor"}
BLOCKS = {"if", "for", "while", "do", "switch", "try"}


class TypeScript:
    language = "typescript"

    def can_handle(self, path: str) -> bool:
        return bool(re.search(r"\.tsx?$", path)) and not re.search(r"\.d\.ts$|\.(test|spec)\.[^/]*$", path)

    def analyze(self, text: str, path: str) -> Analysis:
        return _File(text, path).run()

    def nesting(self, text: str) -> int:
        return nesting(scan(text), BLOCKS)

    def functions(self, text: str) -> int:
        return sum(n["node_type"] == "function" for n in self.analyze(text, "x.ts").nodes)


class _File:
    def __init__(self, text: str, path: str):
        self.text, self.t = text, scan(text)
        self.out = Analysis(path, TypeScript.language)
        self.out.nodes[0]["end_line"] = max(1, text.count("\n") + 1)
        self.names: set[str] = set()  # exported
        self.owners: list[tuple[int, int, str]] = []  # class bodies
        self.kinds: set[str] = set()
        self.top: list[str] = []  # first word of each statement

    def at(self, i: int) -> Token:
        return self.t[i] if 0 <= i < len(self.t) else Token("mark", "", 0, len(self.text), len(self.text))

    def signature(self, i: int, j: int) -> str:
        return re.sub(r"\s+", " ", self.text[self.at(i).start : self.at(j).start]).strip()

    def run(self) -> Analysis:
        i = 0
        while i < len(self.t):
            i = max(self.statement(i), i + 1)
        self.calls()
        self.out.export(self.names)
        self.classify()
        return self.out

    def end(self, i: int) -> int:
        """The place after the statement that starts at i: at a semicolon, or where a line starts that cannot go on."""
        j = i
        while j < len(self.t):
            x = self.at(j)
            if x.kind == "mark" and x.text in "([{":
                j = match(self.t, j) + 1
                if self.at(j - 1).text == "}" and self.at(j).line > self.at(j - 1).line and self.at(j).text not in (".", ",", "?.", ")", "as", "||", "&&", "?", ":"):
                    return j
                continue
            if x.text == ";" and x.kind == "mark":
                return j + 1
            following = self.at(j + 1)
            if following.line > x.line and following.kind == "name" and x.kind != "mark":
                return j + 1
            j += 1
        return j

    def statement(self, i: int) -> int:
        first, exported, default = i, False, False
        if self.at(i).text == "@":  # a decorator
            j = i + 2
            while self.at(j).text == ".":
                j += 2
            return match(self.t, j) + 1 if self.at(j).text == "(" else j
        if self.at(i).text == "export":
            exported, i = True, i + 1
            if self.at(i).text == "default":
                default, i = True, i + 1
            if self.at(i).text in ("*", "{") or self.at(i).text == "type" and self.at(i + 1).text in ("{", "*"):
                return self.reexport(i)
        while self.at(i).text in ("declare", "abstract", "async") and self.at(i + 1).kind == "name":
            i += 1
        word = self.at(i).text
        self.top.append(word)
        flags = {self.at(k).text for k in range(first, i)}
        if word == "import" and self.at(i + 1).text not in ("(", "."):
            return self.imports(i)
        if word == "function":
            return self.function(first, i, "async" in flags, exported, default)
        if word == "class":
            return self.type_("class", first, i, "abstract" in flags, exported, default)
        if word == "interface":
            return self.type_("interface", first, i, False, exported, default)
        if word == "enum" or word == "const" and self.at(i + 1).text == "enum":
            return self.type_("enum", first, i + (word == "const"), False, exported, default)
        if word in ("type", "namespace", "module") and self.at(i + 1).kind == "name":
            self.kinds.add("type" if word == "type" else "logic")
            if exported:
                self.names.add(self.at(i + 1).text)
            return self.end(i)
        if word in ("const", "let", "var"):
            return self.variables(first, i, word, exported)
        if word not in (";", ""):
            self.kinds.add("logic")
            if default and self.at(i).kind == "name":
                self.names.add(word)
        return self.end(i)

    def imports(self, i: int) -> int:
        out, j = self.out, i + 1
        kind = "static_value"
        if self.at(j).kind == "string":
            out.imported(unquote(self.at(j)), symbol_kind="named", kind="side_effect")
            return self.end(j)
        if self.at(j).text == "type" and self.at(j + 1).text != "from":
            kind, j = "static_type", j + 1
        stop = j
        while stop < len(self.t) and self.at(stop).kind != "string":
            stop += 1
        specifier = unquote(self.at(stop)) if stop < len(self.t) else ""
        if self.at(j).kind == "name" and self.at(j + 1).text == "=":  # import x = require('y')
            out.imported(specifier, self.at(j).text, None, "namespace", kind)
            return self.end(stop)
        while j < stop:
            if self.at(j).text == "*":
                out.imported(specifier, "*", self.at(j + 2).text, "namespace", kind)
                j += 3
            elif self.at(j).text == "{":
                for name, alias, own in self.names_in(j):
                    out.imported(specifier, name, alias, "named", "static_type" if own else kind)
                j = match(self.t, j) + 1
            elif self.at(j).kind == "name" and self.at(j).text != "from":
                out.imported(specifier, self.at(j).text, None, "default", kind)
                j += 1
            else:
                j += 1
        return self.end(stop)

    def names_in(self, i: int):
        """(name, alias, whether it is a type) of a list in braces."""
        j, stop = i + 1, match(self.t, i)
        while j < stop:
            own = self.at(j).text == "type" and self.at(j + 1).kind == "name" and self.at(j + 1).text != "as"
            j += own
            name, alias = self.at(j).text, None
            if self.at(j + 1).text == "as":
                alias, j = self.at(j + 2).text, j + 2
            if name not in (",", "}"):
                yield name, alias, own
            while j < stop and self.at(j).text != ",":
                j += 1
            j += 1

    def reexport(self, i: int) -> int:
        kind = "static_type" if self.at(i).text == "type" else "static_value"
        i += kind == "static_type"
        if self.at(i).text == "*":
            j, alias = i + 1, None
            if self.at(j).text == "as":
                alias, j = self.at(j + 1).text, j + 2
            self.out.imported(unquote(self.at(j + 1)), "*" if alias else None, alias, "namespace", kind, True)
            if alias:
                self.names.add(alias)
            return self.end(j)
        found, j = list(self.names_in(i)), match(self.t, i) + 1
        if self.at(j).text == "from":
            for name, alias, own in found:
                self.out.imported(unquote(self.at(j + 1)), name, alias, "named", "static_type" if own else kind, True)
                self.names.add(alias or name)
            return self.end(j)
        self.names |= {name for name, _, _ in found}
        return self.end(j - 1) if self.at(j).text == ";" else j

    def body(self, i: int) -> int:
        """The place of the brace that opens the body of a function whose parameters open at i."""
        j = match(self.t, i) + 1
        while j < len(self.t) and self.at(j).text not in ("{", ";"):
            if self.at(j).text in ("(", "["):
                j = match(self.t, j)
            j += 1
        if self.at(j).text == "{" and self.at(j - 1).text in (":", "|", "<"):  # an object type before the body
            j = match(self.t, j) + 1
            while j < len(self.t) and self.at(j).text not in ("{", ";"):
                j += 1
        return j

    def function(self, first: int, i: int, is_async: bool, exported: bool, default: bool) -> int:
        self.kinds.add("logic")
        j = i + 1 + (self.at(i + 1).text == "*")
        name = self.at(j).text if self.at(j).kind == "name" else "default"
        while j < len(self.t) and self.at(j).text != "(":
            j += 1
        open_ = self.body(j)
        stop = match(self.t, open_) if self.at(open_).text == "{" else open_
        self.out.node("function", name, self.at(first).line, self.at(stop).line, is_async=is_async, signature=self.signature(first, open_))
        if exported:
            self.names.add(name)
        return stop + 1

    def type_(self, kind: str, first: int, i: int, abstract: bool, exported: bool, default: bool) -> int:
        self.kinds.add("logic" if kind == "class" else "const" if kind == "enum" else "type")
        name = self.at(i + 1).text if self.at(i + 1).kind == "name" and self.at(i + 1).text not in ("extends", "implements") else "default"
        j, heads, mode, depth = i + 1, [], None, 0
        while j < len(self.t) and (self.at(j).text != "{" or depth):
            x = self.at(j).text
            depth += {"<": 1, ">": -1}.get(x, 0)
            if not depth and x in ("extends", "implements"):
                mode = x
            elif mode and not depth and self.at(j).kind == "name" and self.at(j - 1).text in ("extends", "implements", ","):
                k = j
                while self.at(k + 1).text == ".":
                    k += 2
                heads.append((self.at(k).text, mode))
            j += 1
        stop = match(self.t, j)
        node = self.out.node(kind, name, self.at(first).line, self.at(stop).line, is_abstract=abstract, signature=self.signature(first, j))
        for base, mode in heads:
            target = "interface" if mode == "implements" or kind == "interface" else "class"
            self.out.edge(node, f"{target}:{self.out.path}:{base}", "extends", "implements" if mode == "implements" else None)
        if exported:
            self.names.add(name)
        if kind == "class":
            self.owners.append((j, stop, name))
            self.methods(j + 1, stop, name, node)
        return stop + 1

    def methods(self, i: int, stop: int, owner: str, node: str) -> None:
        while i < stop:
            first, flags = i, set()
            while self.at(i).text in MODIFIERS and self.at(i + 1).text not in ("(", "=", ";", ":", "?"):
                flags.add(self.at(i).text)
                i += 1
            i += self.at(i).text in ("*", "#")
            j = i + 1
            if self.at(j).text == "<":
                while j < stop and self.at(j).text != "(":
                    j += 1
            if self.at(i).kind == "name" and self.at(j).text == "(":
                open_ = self.body(j)
                last = match(self.t, open_) if self.at(open_).text == "{" else open_
                name = f"{owner}.{self.at(i).text}"
                found = self.out.node(
                    "function", name, self.at(first).line, self.at(min(last, stop)).line, is_async="async" in flags,
                    is_abstract="abstract" in flags, signature=self.signature(first, min(open_, stop)),
                )
                self.out.edge(node, found, "contains")
                i = min(last, stop) + 1
            else:
                i = max(min(self.end(i), stop), i + 1)

    def variables(self, first: int, i: int, word: str, exported: bool) -> int:
        stop = self.end(i)
        j = i + 1
        if self.at(j).text in ("{", "["):
            self.kinds.add("logic")
            return stop
        name = self.at(j).text
        while j < stop and self.at(j).text != "=":
            if self.at(j).text in ("(", "[", "{"):
                j = match(self.t, j)
            j += 1
        value = j + 1
        is_async = self.at(value).text == "async"
        value += is_async
        arrow = self.at(value).text == "function"
        if self.at(value).text == "(" or self.at(value).text == "<":
            k = value
            while self.at(k).text != "(" and k < stop:
                k += 1
            k = match(self.t, k) + 1
            while k < stop and self.at(k).text not in ("=>", ";", "{"):
                k += 1
            arrow = self.at(k).text == "=>"
        elif self.at(value).kind == "name" and self.at(value + 1).text == "=>":
            arrow = True
        if arrow:
            self.kinds.add("logic")
            k = value
            while k < stop and self.at(k).text not in ("=>", "{"):
                k = match(self.t, k) + 1 if self.at(k).text in ("(", "[") else k + 1
            self.out.node("function", name, self.at(first).line, self.at(stop - 1).line, is_async=is_async, signature=self.signature(first, k))
        else:
            plain = word == "const" and self.at(value).kind in ("string", "number") and self.at(value + 1).text in (";", "as", "") or (
                word == "const" and (value + 1 >= stop or self.at(value).text in ("true", "false", "null", "-"))
            )
            self.kinds.add("const" if plain else "logic")
        if exported:
            self.names.add(name)
        return stop

    def calls(self) -> None:
        t, out = self.t, self.out
        for i, x in enumerate(t):
            if x.kind == "name" and x.text in ("import", "require") and self.at(i + 1).text == "(" and self.at(i + 2).kind == "string":
                out.imported(unquote(t[i + 2]), kind="dynamic")
            if x.kind != "name" or self.at(i - 1).text in (".", "?.", "function") or x.text in KEYWORDS:
                continue
            path, j = [x.text], i
            while self.at(j + 1).text in (".", "?.") and self.at(j + 2).kind == "name":
                path.append(self.at(j + 2).text)
                j += 2
            open_ = j + 1
            if self.at(open_).text == "<":
                k, depth = open_, 0
                while k < len(t):
                    depth += {"<": 1, ">": -1}.get(t[k].text, 0)
                    if not depth or t[k].text in (";", "{"):
                        break
                    k += 1
                open_ = k + 1 if not depth and self.at(k + 1).text == "(" else open_
            owner = next((n for a, b, n in self.owners if a < i < b), None)
            new = self.at(i - 1).text == "new"
            if new:
                out.called(".".join(path), True)
                if self.at(i - 2).text == "=":
                    k = i - 3
                    while k > 0 and t[k].text not in ("const", "let", "var", ";", "{", "}"):
                        k -= 1
                    if t[k].text in ("const", "let", "var"):
                        out.bindings.append(dict(variable=self.at(k + 1).text, type=".".join(path)))
                continue
            if self.at(open_).text != "(":
                continue
            declared = self.at(match(t, open_) + 1).text in ("{", ":") and owner and self.at(i - 1).text in ({"", "{", "}", ";"} | MODIFIERS)
            if declared:
                continue
            if path[0] == "this" and len(path) == 2 and owner:
                out.called(f"{owner}.{path[1]}")
            elif path[0] != "this":
                out.called(".".join(path))

    def classify(self) -> None:
        out = self.out
        words = {x.text for x in self.t if x.kind == "name"}
        called = {c["callee"] for c in out.calls}
        io = any(m["specifier"].removeprefix("node:").split("/")[0] in IO_MODULES for m in out.imports)
        danger = set()
        if words & {"async", "await"} or called & set(TIMERS):
            danger.add("concurrency")
        if any(c.startswith("Math.") for c in called) or called & set(NUMERIC) or words & {"NaN", "Infinity"}:
            danger.add("numeric_precision")
        loose = any(x.text == "as" and self.at(i + 1).text in ("any", "unknown") for i, x in enumerate(self.t))
        checks = any(x.text in ("typeof", "instanceof") and x.kind == "name" for x in self.t)
        if checks or loose or called & {"eval", "Reflect.get", "Reflect.set"}:
            danger.add("dynamic_reflection")
        statements = set(self.top)
        started = {"if", "for", "while", "do", "switch", "try"} & statements
        declared = {
            "import", "function", "class", "interface", "enum", "type", "namespace", "module", "const", "let", "var", "", ";", "}", "{", ")",
        }
        expression = bool(statements - declared - started)
        if io or expression:
            danger.add("io_side_effect")
        if statements & {"let", "var"}:
            danger.add("shared_mutable_global")
        out.danger = sorted(danger)
        hard = danger or started or words & {"throw", "try", "any", "unknown", "never"} or re.search(r"\bextends\b[^{;]*\?[^{;]*:", self.text)
        busy = {"function", "class"} & statements or "logic" in self.kinds
        out.tier = "full" if hard else "standard" if busy else "trivial"
        out.file_kind = (
            "normal" if "logic" in self.kinds else "pure_constant" if "const" in self.kinds else "pure_type" if "type" in self.kinds else "barrel"
        )
