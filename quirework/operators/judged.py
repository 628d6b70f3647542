"""Model-judged operators: compose, one call, parse and validate. The call is a plug-in; tests use a table of answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Canned:
    """Answers by prompt, else a default: a deterministic double."""

    def __init__(self, answers: dict[str, str], default: str = "{}"):
        self.answers, self.default = answers, default

    def complete(self, prompt: str) -> str:
        return self.answers.get(prompt, self.default)


_FENCE = re.compile(r"^\s*```[a-z]*\s*\n(.*?)\n\s*```\s*$", re.S)
_ESCAPE = re.compile(r'\\(?!["\\/bfnrtu])')


def parse_json(raw: str) -> dict | None:
    """The object in a model's answer: fences off, illegal escapes doubled; None where it is none."""
    m = _FENCE.match(raw or "")
    text = m.group(1) if m else (raw or "")
    for t in (text, _ESCAPE.sub(r"\\\\", text)):
        try:
            got = json.loads(t)
            return got if isinstance(got, dict) else None
        except ValueError:
            continue
    return None


def judged(df: DataFrame, id_col: str, prompt_col: str, client: Callable[[], Client], valid: Callable[[dict], bool], attempts: int = 2) -> DataFrame:
    """(id, answer, error): one call per row, asked again up to `attempts` times while the answer is not valid."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = client()
        for pdf in batches:
            rows = []
            for i, p in zip(pdf[id_col], pdf[prompt_col]):
                answer, error = None, "no prompt" if p is None else None
                for _ in range(attempts if p is not None else 0):
                    got = parse_json(c.complete(p))
                    if got is not None and valid(got):
                        answer, error = json.dumps(got, sort_keys=True), None
                        break
                    error = "no object" if got is None else "not valid"
                rows.append((i, answer, error))
            yield pd.DataFrame(rows, columns=[id_col, "answer", "error"])

    return df.select(id_col, prompt_col).mapInPandas(run, f"`{id_col}` {kind}, answer string, error string")
