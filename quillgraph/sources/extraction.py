"""Reading text through a language model: configuration, instruction, and a client that runs on the executors.

The client is a parameter, so that any service (or, in tests, a plain function) can stand behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Node labels and relations of the exchange records, with their property keys.
NODES = {
    "Person": ["姓名", "字", "生年", "户籍类型", "户籍地", "学籍", "家庭排行", "学术专长"],
    "Official Position": ["官职名称", "官阶"],
    "ImperialExam": ["考试等级", "考试时间", "考试地点"],
    "Place": ["历史名称", "现代名称", "现代区划层级", "经纬坐标"],
}
RELATIONS = {
    "参与": ("Person", "ImperialExam", ["甲第等级", "考中年龄", "名次", "功名"]),
    "担任": ("Person", "Official Position", ["授予类型", "迁转", "授予时间"]),
    "社会关系": ("Person", "Person", ["关系类型"]),
    "生": ("Person", "Place", []),
    "任务执行": ("Person", "Place", ["职事名目", "任务时间"]),
    "职任": ("Person", "Place", ["任职时间"]),
    "隶属": ("Place", "Place", []),
}


def schema_text() -> str:
    """The record schema, a line for each label and relation."""
    nodes = [f"node {label}: {', '.join(keys)}" for label, keys in NODES.items()]
    edges = [f"relationship {label}: {a} -> {b}" + (f"; {', '.join(keys)}" if keys else "") for label, (a, b, keys) in RELATIONS.items()]
    return "\n".join([*nodes, *edges])


def instruction(text: Column, entities: Column) -> Column:
    """What a model is asked for a text and its found entities (array<string>, may be null)."""
    head = F.lit(f"Return the facts of the text as JSON Lines, one node or relationship a line, under this schema only.\n{schema_text()}\nText: ")
    return F.concat(head, F.coalesce(text, F.lit("")), F.lit("\nEntities: "), F.array_join(F.coalesce(entities, F.array().cast("array<string>")), "、"))


def read_config(path: str) -> dict[str, dict[str, str]]:
    """Sections of plain ``key: value`` pairs (the part of YAML that configurations use), read on the driver.

    Comments start a line or follow white space. Deeper nesting and lists are refused, not misread."""
    out: dict[str, dict[str, str]] = {}
    section: dict[str, str] | None = None
    with open(path, encoding="utf-8") as f:
        for number, raw in enumerate(f, 1):
            line = raw.rstrip()
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            key, colon, value = line.partition(":")
            value = value.strip()
            if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
                value = value[1 : value.find(value[0], 1)]
            else:
                value = value.partition(" #")[0].strip()
            indented = line[0] in " \t"
            if not colon or line.lstrip().startswith("- ") or (indented and (section is None or not value)):
                raise ValueError(f"{path}:{number}: only sections of key: value pairs can be read")
            if not indented:
                section = out.setdefault(key.strip(), {})
                if value:
                    section[""] = value
            else:
                section[key.strip()] = value
    return out


def answers(df: DataFrame, prompt: str, make_client: Callable[[], Callable[[str], Iterable[str]]], into: str = "raw") -> DataFrame:
    """Adds the model's answer to each prompt.

    ``make_client`` is called once a task; its client takes a prompt and returns the answer's pieces. Pieces of nothing but white space are
    dropped, the others joined. A call that fails gives ``[]``, so one bad answer costs no task. A null prompt is not sent; its answer is null.
    """

    @F.pandas_udf(StringType())
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def one(p):
            if p is None:
                return None
            try:
                return "".join(piece for piece in client(p) if piece and piece.strip())
            except Exception:  # noqa: BLE001 - whatever a service raises
                return "[]"

        for batch in batches:
            yield pd.Series([one(p) for p in batch], dtype=object)

    return df.withColumn(into, ask.asNondeterministic()(F.col(prompt)))


SPANS = "array<struct<type_idx:int,start:int,length:int>>"


def spans(df: DataFrame, text: str, make_model: Callable[[], Callable[[list[str]], list[list[tuple[int, int, int]]]]], into: str = "spans") -> DataFrame:
    """Adds the spans (type, start, length in characters) that an extraction model finds in each text.

    ``make_model`` is called once a task, where it loads weights; its model takes a batch of texts. Null texts have no spans; a span outside its text is an error."""

    @F.pandas_udf(SPANS)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in batches:
            texts = [x or "" for x in batch]
            out = []
            for x, found in zip(texts, model(texts), strict=True):
                if any(start < 0 or length <= 0 or start + length > len(x) for _, start, length in found):
                    raise ValueError("a span lies outside its text")
                out.append([{"type_idx": k, "start": start, "length": length} for k, start, length in found])
            yield pd.Series(out, dtype=object)

    return df.withColumn(into, infer(F.col(text)))


def span_rows(df: DataFrame, key: str, text: str, into: str = "spans") -> DataFrame:
    """(line_id, type_idx, start, text): a row for each span, for grouping by label."""
    each = df.select(F.col(key).alias("line_id"), F.col(text).alias("line"), F.explode(into).alias("x"))
    return each.select("line_id", "x.type_idx", "x.start", F.expr("substring(line, x.start + 1, x.length)").alias("text"))
