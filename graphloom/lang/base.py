"""What a language adapter returns for a file, and the pass that runs adapters over files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import ship

NODE = (
    "struct<id:string,node_type:string,name:string,file_path:string,start_line:int,end_line:int,signature:string,"
    "is_exported:boolean,is_async:boolean,is_abstract:boolean,decorators:array<string>>"
)
EDGE = "struct<source:string,target:string,edge_type:string,sub_kind:string>"
IMPORT = "struct<seq:int,specifier:string,name:string,alias:string,symbol_kind:string,kind:string,reexport:boolean>"
CALL = "struct<callee:string,is_constructor:boolean>"
BINDING = "struct<variable:string,type:string>"
ANALYSIS = (
    f"path string, language string, nodes array<{NODE}>, edges array<{EDGE}>, imports array<{IMPORT}>, calls array<{CALL}>, "
    f"exports array<string>, bindings array<{BINDING}>, tier string, file_kind string, danger array<string>, classified boolean, "
    "warning string"
)


@dataclass
class Analysis:
    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    bindings: list[dict] = field(default_factory=list)
    tier: str = "trivial"
    file_kind: str = "barrel"
    danger: list[str] = field(default_factory=list)
    classified: bool = True
    warning: str | None = None

    def __post_init__(self) -> None:
        if not self.nodes:
            self.node("file", self.path.rsplit("/", 1)[-1], 1, 1)

    @property
    def file_id(self) -> str:
        return f"file:{self.path}"

    def node(self, kind: str, name: str, start: int, end: int, **more) -> str:
        node_id = self.file_id if kind == "file" else f"{kind}:{self.path}:{name}"
        given = dict(signature=None, is_exported=False, is_async=False, is_abstract=False, decorators=[]) | more
        self.nodes.append(dict(id=node_id, node_type=kind, name=name, file_path=self.path, start_line=start, end_line=end) | given)
        return node_id

    def edge(self, source: str, target: str, kind: str, sub_kind: str | None = None) -> None:
        self.edges.append(dict(source=source, target=target, edge_type=kind, sub_kind=sub_kind))

    def imported(self, specifier: str, name: str | None = None, alias: str | None = None, symbol_kind: str = "named", kind: str = "static_value", reexport: bool = False) -> None:
        self.imports.append(
            dict(seq=len(self.imports), specifier=specifier, name=name, alias=alias, symbol_kind=symbol_kind, kind=kind, reexport=reexport)
        )

    def called(self, callee: str, is_constructor: bool = False) -> None:
        self.calls.append(dict(callee=callee, is_constructor=is_constructor))

    def export(self, names: set[str]) -> None:
        """Mark nodes whose name is exported and draw their edges."""
        for n in self.nodes:
            if n["node_type"] != "file" and n["name"] in names:
                n["is_exported"] = True
                self.edge(self.file_id, n["id"], "exports")
        self.exports = sorted(names)

    def failed(self, why: str) -> Analysis:
        """Nothing is known of a file that cannot be read: it counts as the hardest kind."""
        self.tier, self.file_kind, self.classified, self.warning = "full", "normal", False, why
        return self

    @property
    def is_mechanical(self) -> bool:
        return self.file_kind != "normal" and not self.danger


class Adapter(Protocol):
    language: str

    def can_handle(self, path: str) -> bool: ...

    def analyze(self, text: str, path: str) -> Analysis: ...

    def nesting(self, text: str) -> int: ...


def adapter(language: str) -> Adapter:
    """The adapter of a language; C has none yet."""
    from graphloom.lang.go import Go
    from graphloom.lang.python_ import Python
    from graphloom.lang.typescript import TypeScript

    known = {"python": Python, "typescript": TypeScript, "go": Go}
    if language not in known:
        raise NotImplementedError(f"E015: no adapter for {language}")
    return known[language]()


def analyze(files: DataFrame) -> DataFrame:
    """ANALYSIS of files (path, language, content): one Arrow pass, a row per file.

    A file that cannot be parsed keeps its file node and says why.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapters: dict[str, Adapter] = {}
        for frame in frames:
            rows = []
            for path, language, content in zip(frame["path"], frame["language"], frame["content"], strict=True):
                own = adapters.setdefault(language, adapter(language))
                try:
                    found = own.analyze(content or "", path)
                except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                    found = Analysis(path, language).failed(f"{path}: {e}")
                rows.append(asdict(found))
            yield pd.DataFrame(rows, columns=[f.name for f in fields(Analysis)])

    return files.select("path", "language", F.col("content").cast("string").alias("content")).mapInPandas(run, ANALYSIS)
