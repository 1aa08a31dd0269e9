"""Stages with inputs and outputs, run in order and skipped while nothing they read has changed."""

from __future__ import annotations

import ast
import glob
import hashlib
import inspect
import json
import os
import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Mapping[str, str]], None]
    inputs: Sequence[str] = ()
    outputs: Sequence[str] = ()
    settings: Mapping[str, object] = field(default_factory=dict)


def expand(reference: str, values: Mapping[str, str]) -> list[str]:
    """Paths that a reference stands for: `{name}` from the values, `{a,b}` alternatives, and file patterns."""

    def fill(m: re.Match) -> str:
        if "," in m[1]:
            return m[0]
        if m[1] not in values:
            raise KeyError(f"no value for {{{m[1]}}}")
        return str(values[m[1]])

    todo, out = [re.sub(r"\{([^{}]*)\}", fill, reference)], []
    while todo:
        text = todo.pop(0)
        if m := re.search(r"\{([^{}]*,[^{}]*)\}", text):
            todo = [text[: m.start()] + part + text[m.end() :] for part in m[1].split(",")] + todo
        elif re.search(r"[*?\[]", text):
            out += sorted(glob.glob(text))
        else:
            out.append(text)
    return out


def fingerprint(path: str) -> str:
    """Content hash of a file, or of all files of a folder with their names; `missing` if there is nothing."""
    if os.path.isdir(path):
        parts = [f"{os.path.relpath(os.path.join(d, f), path)}={fingerprint(os.path.join(d, f))}" for d, _, fs in sorted(os.walk(path)) for f in sorted(fs)]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()
    if not os.path.exists(path):
        return "missing"
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def code_fingerprint(source: str) -> str:
    """Hash of what Python source does: comments, layout and docstrings do not count."""
    tree = ast.parse(source)
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                node.body = node.body[1:] or [ast.Pass()]
    return hashlib.sha256(ast.dump(tree).encode()).hexdigest()


def import_closure(start: str, root: str) -> list[str]:
    """Python files under `root` that the file `start` imports, directly or through others, itself included. Imports are read
    from the source, so those inside functions count; modules outside `root` do not."""
    found, todo = set(), [os.path.abspath(start)]
    top = os.path.abspath(root)
    while todo:
        path = todo.pop()
        if path in found:
            continue
        found.add(path)
        with open(path, encoding="utf-8") as file:
            tree = ast.parse(file.read())
        here = os.path.relpath(os.path.dirname(path), top).split(os.sep)
        for node in ast.walk(tree):
            names = []
            if isinstance(node, ast.Import):
                names = [a.name.split(".") for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                base = [p for p in here[: len(here) - node.level + 1] if p != "."] if node.level else []
                own = base + (node.module.split(".") if node.module else [])
                names = [own, *[[*own, a.name] for a in node.names]]
            for parts in names:
                for k in range(1, len(parts) + 1):
                    stem = os.path.join(top, *parts[:k])
                    todo += [p for p in (f"{stem}.py", os.path.join(stem, "__init__.py")) if os.path.isfile(p)]
    return sorted(found)


def by_visit(rows: DataFrame, visit: str, visits: Sequence, fit: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """`fit` of the rows of every visit, one folder for each under `folder`; visits that are finished there are not fitted
    again, so an interrupted run goes on where it stopped."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    for v in visits:
        path = f"{folder}/visit-{v}"
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not mark.getFileSystem(conf).exists(mark):
            fit(rows.where(F.col(visit) == v)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(*[f"{folder}/visit-{v}" for v in visits])


class Runner:
    """Runs stages in their order. A record beside the outputs holds what a stage read and how; a stage is skipped if that is
    unchanged, its outputs are as it left them, and no earlier stage it reads from ran."""

    def __init__(self, stages: Sequence[Stage], values: Mapping[str, str], record: str):
        names = [s.name for s in stages]
        if len(set(names)) != len(names):
            raise ValueError("two stages have one name")
        made: set[str] = set()
        for s in stages:
            for o in s.outputs:
                if o in made:
                    raise ValueError(f"two stages make {o}")
                made.add(o)
        later: set[str] = set()
        for s in reversed(list(stages)):
            later |= set(s.outputs)
            if bad := [i for i in s.inputs if i in later]:
                raise ValueError(f"{s.name} reads {bad} before it is made")
        self.stages, self.values, self.record = stages, values, record

    def _state(self, refs: Sequence[str]) -> dict[str, str]:
        return {p: fingerprint(p) for r in refs for p in expand(r, self.values)}

    def _code(self, s: Stage) -> str:
        try:
            source = inspect.getsource(s.run)
        except (OSError, TypeError):
            source = repr(s.run)
        return hashlib.sha256((source + json.dumps(dict(s.settings), sort_keys=True, default=str)).encode()).hexdigest()

    def plan(self) -> list[tuple[str, str]]:
        """(stage, reason) of every stage that would run."""
        known = self._load()
        out, fresh = [], set()
        for s in self.stages:
            old = known.get(s.name)
            if old is None:
                why = "never ran"
            elif old["code"] != self._code(s):
                why = "code or settings changed"
            elif any(i in fresh for i in s.inputs):
                why = "an earlier stage runs"
            elif old["inputs"] != self._state(s.inputs):
                why = "inputs changed"
            elif old["outputs"] != self._state(s.outputs):
                why = "outputs changed"
            else:
                continue
            out.append((s.name, why))
            fresh |= set(s.outputs)
        return out

    def _load(self) -> dict:
        if not os.path.exists(self.record):
            return {}
        with open(self.record, encoding="utf-8") as f:
            return json.load(f)

    def run(self) -> list[str]:
        """Runs what is due; the names of the stages that ran. The first failure ends the run and leaves no record of its stage."""
        due, ran = {n for n, _ in self.plan()}, []
        for s in self.stages:
            if s.name not in due:
                continue
            known = self._load()
            known.pop(s.name, None)
            began, inputs = time.time(), self._state(s.inputs)
            s.run(self.values)
            known[s.name] = {"code": self._code(s), "inputs": inputs, "outputs": self._state(s.outputs), "seconds": round(time.time() - began, 3)}
            with open(f"{self.record}.part", "w", encoding="utf-8") as f:
                json.dump(known, f, indent=1, sort_keys=True)
            os.replace(f"{self.record}.part", self.record)
            ran.append(s.name)
        return ran
