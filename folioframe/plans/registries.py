"""What can be plugged in: runners by type of task, parsers by ending, and model providers, one of them active."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Generic, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runs import Refused

T = TypeVar("T")
#: A runner takes all tasks of its type (task_id, type, doc_id, payload) and gives (task_id, status, code, message).
Runner = Callable[[DataFrame], DataFrame]
OUTCOME = "task_id string, status string, code string, message string"
# Types of tasks, and codes of what has no runner, of a failure without a code, and of a missing model.
TASK_TYPES = ("parse", "export", "rechunk", "module_install", "qa_generate", "dataset_build")
NO_RUNNER, UNEXPECTED, NO_MODEL = "E03", "E06", "MODEL_NOT_INSTALLED"


@dataclass
class Registry(Generic[T]):
    """Things by name; names are alike in either case, and a later one takes an earlier one's place."""

    items: dict[str, T] = field(default_factory=dict)

    def register(self, name: str, item: T) -> T:
        self.items[name.lower()] = item
        return item

    def get(self, name: str | None) -> T | None:
        return self.items.get((name or "").lower())

    def names(self) -> list[str]:
        return sorted(self.items)


def run_tasks(tasks: DataFrame, runners: Registry[Runner]) -> DataFrame:
    """OUTCOME of tasks (task_id, type, doc_id, payload): all those of a type go to its runner at once, as one job.

    A runner that is refused, or breaks, fails its own tasks, with its code or UNEXPECTED; those it says nothing of are
    done. Types without a runner fail with NO_RUNNER. Types are few: they are looked up, not scanned for.
    """
    kind = F.lower(F.coalesce("type", F.lit("")))
    out = tasks.where(~kind.isin(runners.names())).select("task_id", F.lit("failed"), F.lit(NO_RUNNER), F.concat(F.lit("no runner for "), F.coalesce("type", F.lit("a task without a type"))))
    for name in runners.names():
        mine = tasks.where(kind == name)
        try:
            said = runners.get(name)(mine).select("task_id", F.col("status").alias("s"), F.col("code").alias("c"), F.col("message").alias("m"))
            each = mine.select("task_id").join(said, "task_id", "left").select("task_id", F.coalesce("s", F.lit("done")), "c", F.coalesce("m", F.lit("")))
        except Exception as e:
            code = e.code if isinstance(e, Refused) else UNEXPECTED
            each = mine.select("task_id", F.lit("failed"), F.lit(code), F.lit(f"{type(e).__name__}: {e}"))
        out = out.union(each)
    return out.toDF("task_id", "status", "code", "message")


@dataclass
class Provider:
    """A model: what it can do, and an answer for each of several prompts."""

    model_id: str | None = None
    max_context: int = 0
    answer: Callable[[Sequence[str]], list[str]] | None = None

    def capabilities(self) -> dict[str, object]:
        return {"chat": self.answer is not None, "max_context": self.max_context, "model_id": self.model_id}

    def healthy(self) -> bool:
        return self.answer is not None

    def chat(self, prompts: Sequence[str]) -> list[str]:
        if self.answer is None:
            raise Refused(NO_MODEL, "no model is installed")
        return self.answer(prompts)


@dataclass
class Providers(Registry[Provider]):
    """Providers, of which one is active; there always is one: without any, or if the active one is gone, it has no model."""

    active: str = "null"

    def register(self, name: str, item: Provider, *, activate: bool = True) -> Provider:
        if activate:
            self.active = name.lower()
        return super().register(name, item)

    def current(self) -> Provider:
        return self.get(self.active) or Provider()

    def listed(self) -> dict[str, object]:
        return {"providers": sorted({*self.names(), "null"}), "active": self.active if self.get(self.active) else "null"}


def parsers_for(ext: str | None, parsers: Registry[T]) -> T:
    """The parser of an ending; an ending without one is refused."""
    found = parsers.get((ext or "").lstrip("."))
    if found is None:
        raise Refused(NO_RUNNER, f"no parser for {ext or 'a file without an ending'}")
    return found
