"""An ordered list of stages, each from the previous one's table to its own.

Every stage's result is written to a folder that driver and executors share and read back, so the lineage ends there. The first
stage that fails ends the run; a later run over the same folder begins after the last whole stage, if that was made from the same source by the same stages:
each folder's name holds a fingerprint of the source's plan and files, and of the names and code of the stages so far, with the constants, enclosed values and functions of the
project that they use. Installed libraries are known by name: after an upgrade take a new folder.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import sysconfig
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from types import CellType, CodeType, FunctionType, MethodType, ModuleType
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


@dataclass(frozen=True)
class Outcome:
    stage: str
    path: str
    resumed: bool


class StageFailed(RuntimeError):
    """Names the stage; the cause is chained."""


def preflight(stages: Sequence[Stage]) -> None:
    """Refuses a list that cannot run: empty, unnamed, repeated or uncallable stages."""
    names = [n for n, _ in stages]
    faults = [f"stage {k} has no usable name" for k, n in enumerate(names, 1) if not n or "/" in n]
    faults += [f"stage {n!r} is listed twice" for n in sorted({n for n in names if names.count(n) > 1})]
    faults += [f"stage {n!r} cannot be called" for n, f in stages if not callable(f)]
    if faults or not stages:
        raise ValueError("; ".join(faults) or "no stages")


def corrected_inputs(paths: dict[str, str]) -> dict[str, str]:
    """Named input paths with the common slip in a suffix mended (``.jso`` for ``.json``); refuses blank ones, all at once."""
    blank = sorted(k for k, v in paths.items() if not (v or "").strip())
    if blank:
        raise ValueError(f"no path for {', '.join(blank)}")
    return {k: v.strip() + "n" if v.strip().lower().endswith(".jso") else v.strip() for k, v in paths.items()}


def _whole(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


#: Where the interpreter and installed libraries live; what is defined there is known by its name.
_LIBRARIES = tuple(sysconfig.get_paths()[k] for k in ("stdlib", "platstdlib", "purelib", "platlib"))


#: Methods that change a container. Containers enclosed by a function that names one of them do not count.
_CHANGING = {"add", "append", "clear", "extend", "insert", "pop", "remove", "setdefault", "update"}


def _installed(module: ModuleType | None) -> bool:
    where = getattr(module, "__file__", None)
    return where is None or where.startswith(_LIBRARIES)


def _described(x: object, seen: dict[int, int]) -> object:
    """What a value is, as far as a stage's result may depend on it: code with the constants, defaults, enclosed values and named globals of all functions within it, by value."""
    if x is None or isinstance(x, (bool, int, float, complex, str, bytes)):
        return repr(x)
    if id(x) in seen:
        return ("again", seen[id(x)])
    seen[id(x)] = len(seen)
    each = lambda xs: [_described(y, seen) for y in xs]
    if isinstance(x, (list, tuple)):
        return (type(x).__name__, each(x))
    if isinstance(x, (set, frozenset)):
        return ("set", sorted(map(repr, x)))
    if isinstance(x, dict):
        return ("dict", [(repr(k), _described(v, seen)) for k, v in x.items()])
    if isinstance(x, CodeType):
        return ("code", x.co_code.hex(), x.co_names, x.co_varnames, x.co_freevars, each(x.co_consts))
    if isinstance(x, functools.partial):
        return ("partial", each((x.func, x.args, x.keywords)))
    if isinstance(x, MethodType):
        return ("method", each((x.__func__, x.__self__)))
    if isinstance(x, ModuleType):
        return ("module", x.__name__)
    if isinstance(x, FunctionType):
        module = sys.modules.get(x.__module__)
        if x.__module__ != "__main__" and _installed(module) and module is not None:
            return ("function", x.__module__, x.__qualname__)
        cells = [c.cell_contents for c in x.__closure__ or () if _filled(c)]
        if _CHANGING & set(x.__code__.co_names):  # a stage's own log is not what it is made of
            cells = [c for c in cells if not isinstance(c, (list, dict, set))]
        return ("function", each((x.__code__, x.__defaults__, x.__kwdefaults__, cells)), [(n, _described(v, seen)) for n, v in _globals(x)])
    if isinstance(x, type):
        if _installed(sys.modules.get(x.__module__)):
            return ("class", x.__module__, x.__qualname__)
        return ("class", x.__qualname__, [(k, _described(v, seen)) for k, v in vars(x).items() if not k.startswith("__") or callable(v)])
    inner = vars(x) if hasattr(x, "__dict__") and not _installed(sys.modules.get(type(x).__module__)) else {}
    return ("object", type(x).__module__, type(x).__qualname__, _described(type(x), seen), _described(dict(inner), seen))


def _filled(cell: CellType) -> bool:
    try:
        cell.cell_contents  # noqa: B018
    except ValueError:
        return False
    return True


def _globals(f: FunctionType) -> list[tuple[str, object]]:
    """The globals that a function, or one within it, names, and what it may name in modules of its own project."""
    names, todo = [], [f.__code__]
    while todo:
        code = todo.pop()
        names += code.co_names
        todo += [c for c in code.co_consts if isinstance(c, CodeType)]
    names = sorted(set(names))
    found = [(n, f.__globals__[n]) for n in names if n in f.__globals__]
    own = [m for _, m in found if isinstance(m, ModuleType) and not _installed(m)]
    return found + [(f"{m.__name__}.{n}", vars(m)[n]) for m in own for n in names if n in vars(m)]


def _code(step: Callable) -> str:
    """What a stage does: equal for stages whose code, and that of all it calls in its own project, is equal."""
    return repr(_described(step, {}))


def _source(df: DataFrame) -> str:
    """The plan of a table and, in one row, its files with their lengths and times, which Spark lists a folder at a time."""
    folders = sorted({unquote(name.rpartition("/")[0]) for name in df.inputFiles()})
    files = []
    if folders:
        listed = df.sparkSession.read.format("binaryFile").load(folders).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
        files = list(listed.agg(F.count("h"), F.sum("h")).first())
    return re.sub(r"#\d+|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString()) + repr((folders, files))


def run_stages(source: DataFrame, stages: Sequence[Stage], folder: str, resume: bool = True) -> tuple[DataFrame, list[Outcome]]:
    """The last stage's table, and what was done for each. A stage is skipped only if it and all before it are whole."""
    preflight(stages)
    spark, now, log = source.sparkSession, source, []
    mark = hashlib.sha256(_source(source).encode())
    for k, (name, step) in enumerate(stages, 1):
        mark.update(f"{name}\0{_code(step)}\0".encode())
        path = f"{folder.rstrip('/')}/{k:02d}-{name}-{mark.hexdigest()[:12]}"
        if resume and _whole(spark, path):
            log.append(Outcome(name, path, True))
        else:
            resume = False
            try:
                step(now).write.mode("overwrite").parquet(path)
            except Exception as e:
                raise StageFailed(f"stage {k} ({name})") from e
            log.append(Outcome(name, path, False))
        now = spark.read.parquet(path)
    return now, log
