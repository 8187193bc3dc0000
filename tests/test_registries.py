"""Runners, parsers and providers by name."""

import pytest
from pyspark.sql import functions as F

from folioframe.plans import registries as rg
from folioframe.plans.runs import Refused


def test_runners(spark):
    runners = rg.Registry()
    runners.register("Parse", lambda tasks: tasks.where("doc_id = 'bad'").select("task_id", F.lit("failed").alias("status"), F.lit("E05").alias("code"), F.lit("empty").alias("message")))

    def refused(tasks):
        raise Refused("E07", "no room")

    runners.register("export", refused)
    runners.register("rechunk", lambda tasks: tasks.select("no_such_column"))
    rows = [("1", "parse", "a"), ("2", "PARSE", "bad"), ("3", "export", "a"), ("4", "rechunk", "a"), ("5", "qa_generate", "a"), ("6", None, None)]
    tasks = spark.createDataFrame([(*r, "{}") for r in rows], "task_id string, type string, doc_id string, payload string")
    got = {r.task_id: (r.status, r.code) for r in rg.run_tasks(tasks, runners).collect()}
    assert got == {"1": ("done", None), "2": ("failed", "E05"), "3": ("failed", "E07"), "4": ("failed", "E06"), "5": ("failed", "E03"), "6": ("failed", "E03")}
    assert rg.run_tasks(tasks.limit(0), runners).count() == 0 and set(runners.names()) < set(rg.TASK_TYPES)


def test_providers_and_parsers():
    providers = rg.Providers()
    assert providers.listed() == {"providers": ["null"], "active": "null"} and not providers.current().healthy()
    assert providers.current().capabilities() == {"chat": False, "max_context": 0, "model_id": None}
    with pytest.raises(Refused, match="MODEL_NOT_INSTALLED"):
        providers.current().chat(["?"])
    providers.register("local", rg.Provider("m", 100, lambda prompts: [p.upper() for p in prompts]))
    providers.register("other", rg.Provider("n", 10), activate=False)
    assert providers.current().chat(["a"]) == ["A"] and providers.listed() == {"providers": ["local", "null", "other"], "active": "local"}
    providers.items.clear()
    assert not providers.current().healthy() and providers.listed()["active"] == "null"
    parsers = rg.Registry()
    parsers.register("docx", len)
    assert rg.parsers_for(".DOCX", parsers) is len
    for ext in ("pdf", None):
        with pytest.raises(Refused, match="E03"):
            rg.parsers_for(ext, parsers)
