"""Python sources, by the standard library's parser."""

from __future__ import annotations

import ast

from graphloom.lang.base import Analysis

#: Modules and calls that tell a danger.
MODULES = {
    "io_side_effect": (
        "os", "sys", "subprocess", "socket", "shutil", "io", "pathlib", "requests", "urllib", "http", "aiohttp", "tempfile", "fileinput",
    ),
    "concurrency": ("asyncio", "threading", "multiprocessing", "concurrent", "queue", "_thread"),
    "ffi": ("ctypes", "cffi"),
    "dynamic_reflection": ("importlib", "inspect"),
    "numeric_precision": ("math", "decimal", "fractions", "cmath", "statistics"),
}
CALLS = {
    "dynamic_reflection": ("eval", "exec", "compile", "__import__", "getattr", "setattr", "delattr", "globals", "locals", "vars"),
    "io_side_effect": ("open", "input", "subprocess."),
    "numeric_precision": ("float", "complex", "Decimal", "Fraction", "math."),
    "concurrency": ("Thread", "Lock", "RLock", "Pool", "threading.", "asyncio.", "multiprocessing.", "concurrent."),
    "ffi": ("CDLL", "ctypes.", "cffi."),
}
HOOKS = ("__getattr__", "__setattr__", "__delattr__", "__getattribute__")
TYPE_MAKERS = ("TypeVar", "NewType", "NamedTuple", "TypedDict", "ParamSpec", "namedtuple")
TYPE_BASES = ("Protocol", "TypedDict", "NamedTuple", "Enum", "IntEnum", "StrEnum")
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(x: ast.AST) -> str | None:
    if isinstance(x, ast.Name):
        return x.id
    if isinstance(x, ast.Attribute) and (base := dotted(x.value)):
        return f"{base}.{x.attr}"
    return None


def _is_type_checking(x: ast.AST) -> bool:
    return isinstance(x, ast.If) and dotted(x.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING")


class Python:
    language = "python"

    def can_handle(self, path: str) -> bool:
        return path.endswith(".py")

    def analyze(self, text: str, path: str) -> Analysis:
        out = Analysis(path, self.language)
        tree = ast.parse(text)
        out.nodes[0]["end_line"] = max(1, text.count("\n") + 1)
        for x in tree.body:
            self._define(out, x)
        self._imports(out, tree)
        self._calls(out, tree)
        out.export(self._all(tree))
        out.danger = sorted(self._danger(tree))
        out.tier, out.file_kind = self._tier(tree), self._kind(tree, out)
        return out

    def nesting(self, text: str) -> int:
        def deep(x: ast.AST, n: int) -> int:
            n += isinstance(x, NESTING)
            return max([n, *(deep(y, n) for y in ast.iter_child_nodes(x))])

        return deep(ast.parse(text), 0)

    def functions(self, text: str) -> int:
        return sum(isinstance(x, FUNCTIONS) for x in ast.walk(ast.parse(text)))

    def _define(self, out: Analysis, x: ast.AST, owner: tuple[str, str] | None = None) -> None:
        if isinstance(x, FUNCTIONS):
            name = f"{owner[0]}.{x.name}" if owner else x.name
            result = f" -> {ast.unparse(x.returns)}" if x.returns else ""
            is_async = isinstance(x, ast.AsyncFunctionDef)
            node = out.node(
                "function", name, x.lineno, x.end_lineno, is_async=is_async,
                signature=f"{'async ' * is_async}def {x.name}({ast.unparse(x.args)}){result}",
                is_abstract=any((dotted(d) or "").endswith("abstractmethod") for d in x.decorator_list),
                decorators=[ast.unparse(d) for d in x.decorator_list],
            )
            if owner:
                out.edge(owner[1], node, "contains")
        elif isinstance(x, ast.ClassDef) and owner is None:
            bases = ", ".join(ast.unparse(b) for b in [*x.bases, *x.keywords])
            node = out.node(
                "class", x.name, x.lineno, x.end_lineno, signature=f"class {x.name}" + (f"({bases})" if bases else ""),
                is_abstract=any((dotted(b) or "").endswith("ABC") for b in x.bases), decorators=[ast.unparse(d) for d in x.decorator_list],
            )
            for b in x.bases:
                if (name := dotted(b)) is not None:
                    out.edge(node, f"class:{out.path}:{name.rsplit('.', 1)[-1]}", "extends")
            for y in x.body:
                if isinstance(y, FUNCTIONS):
                    self._define(out, y, (x.name, node))
        elif isinstance(x, (ast.If, ast.Try)):
            for y in ast.iter_child_nodes(x):
                if isinstance(y, (*FUNCTIONS, ast.ClassDef)):
                    self._define(out, y)

    def _imports(self, out: Analysis, tree: ast.Module) -> None:
        only_types = {id(y) for x in ast.walk(tree) if _is_type_checking(x) for y in ast.walk(x)}
        for x in ast.walk(tree):
            kind = "static_type" if id(x) in only_types else "static_value"
            if isinstance(x, ast.Import):
                for a in x.names:
                    out.imported(a.name, a.name, a.asname, "namespace", kind)
            elif isinstance(x, ast.ImportFrom):
                dots = "." * x.level
                for a in x.names:
                    if a.name == "*":
                        out.imported(dots + (x.module or ""), kind="side_effect")
                    elif x.module is None:  # from . import x: each name may be a module of its own
                        out.imported(dots + a.name, a.name, a.asname, "namespace", kind)
                    else:
                        out.imported(dots + x.module, a.name, a.asname, "named", kind)

    def _calls(self, out: Analysis, tree: ast.Module) -> None:
        def walk(x: ast.AST, owner: str | None) -> None:
            if isinstance(x, ast.ClassDef):
                owner = x.name
            if isinstance(x, ast.Call) and (name := dotted(x.func)):
                if owner and name.startswith(("self.", "cls.")) and name.count(".") == 1:
                    name = f"{owner}.{name.split('.')[1]}"
                    out.called(name)
                else:
                    out.called(name, name.rsplit(".", 1)[-1][:1].isupper())
            for y in ast.iter_child_nodes(x):
                walk(y, owner)

        walk(tree, None)

    def _all(self, tree: ast.Module) -> set[str]:
        found: set[str] = set()
        for x in tree.body:
            targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AugAssign, ast.AnnAssign)) else []
            if any(dotted(t) == "__all__" for t in targets) and isinstance(x.value, (ast.List, ast.Tuple, ast.Set)):
                found |= {e.value for e in x.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)}
        return found

    def _danger(self, tree: ast.Module) -> set[str]:
        found: set[str] = set()
        for x in ast.walk(tree):
            if isinstance(x, (ast.AsyncFunctionDef, ast.Await, ast.AsyncFor, ast.AsyncWith)):
                found.add("concurrency")
            if isinstance(x, FUNCTIONS) and x.name in HOOKS or isinstance(x, ast.keyword) and x.arg == "metaclass":
                found.add("dynamic_reflection")
            if isinstance(x, ast.Attribute) and dotted(x.value) == "math":
                found.add("numeric_precision")
            modules = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""] if isinstance(x, ast.ImportFrom) else []
            for module in modules:
                found |= {k for k, listed in MODULES.items() if module.split(".")[0] in listed}
            if isinstance(x, ast.Call) and (name := dotted(x.func)):
                found |= {k for k, listed in CALLS.items() if any(name == c or c.endswith(".") and name.startswith(c) for c in listed)}
        for x in tree.body:
            if isinstance(x, (ast.Global, ast.Nonlocal)):
                found.add("shared_mutable_global")
            if isinstance(x, (ast.Assign, ast.AnnAssign)) and not self._dunder(x) and isinstance(
                x.value, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)
            ):
                found.add("shared_mutable_global")
        return found

    def _dunder(self, x: ast.AST) -> bool:
        targets = x.targets if isinstance(x, ast.Assign) else [x.target]
        names = [dotted(t) or "" for t in targets]
        return all(n.startswith("__") and n.endswith("__") for n in names)

    def _tier(self, tree: ast.Module) -> str:
        hard = (ast.Try, ast.Global, ast.Nonlocal, ast.AsyncFunctionDef, ast.Await, ast.AsyncFor, ast.AsyncWith)
        for x in ast.walk(tree):
            hook = isinstance(x, FUNCTIONS) and x.name in HOOKS[:3]
            meta = isinstance(x, ast.keyword) and x.arg == "metaclass"
            run = isinstance(x, ast.Call) and dotted(x.func) in ("exec", "eval")
            if isinstance(x, hard) or hook or meta or run:
                return "full"
        plain = (ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.AugAssign)
        return "trivial" if all(isinstance(x, plain) for x in tree.body) else "standard"

    def _kind(self, tree: ast.Module, out: Analysis) -> str:
        seen: set[str] = set()
        for x in tree.body:
            if isinstance(x, (ast.Import, ast.ImportFrom)) or _is_type_checking(x):
                continue
            if isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
                continue
            if isinstance(x, (ast.Assign, ast.AnnAssign)):
                if not self._dunder(x):
                    seen.add(self._value_kind(x.value))
            elif isinstance(x, ast.ClassDef) and self._pure_type(x):
                seen.add("type")
            else:
                seen.add("logic")
        if "logic" in seen:
            return "normal"
        return "pure_constant" if "const" in seen else "pure_type" if "type" in seen else "barrel"

    def _value_kind(self, value: ast.AST | None) -> str:
        if value is None or isinstance(value, ast.Call) and (dotted(value.func) or "").rsplit(".", 1)[-1] in TYPE_MAKERS:
            return "type"
        if isinstance(value, ast.Subscript) or isinstance(value, ast.BinOp) and isinstance(value.op, ast.BitOr):
            return "type"
        if isinstance(value, ast.UnaryOp):
            value = value.operand
        if isinstance(value, ast.Tuple):
            return "const" if all(self._value_kind(e) == "const" for e in value.elts) else "logic"
        return "const" if isinstance(value, ast.Constant) else "logic"

    def _pure_type(self, x: ast.ClassDef) -> bool:
        based = any((dotted(b) or "").rsplit(".", 1)[-1] in TYPE_BASES for b in x.bases)
        quiet = all(
            isinstance(y, (ast.AnnAssign, ast.Pass))
            or isinstance(y, ast.Assign) and based
            or isinstance(y, ast.Expr) and isinstance(y.value, ast.Constant)
            for y in x.body
        )
        return quiet and (based or any((dotted(d.func if isinstance(d, ast.Call) else d) or "").endswith("dataclass") for d in x.decorator_list) or all(not isinstance(y, ast.Assign) for y in x.body))
