"""Model clients with a stand-in for the service: keys, cache, second tries, usage, proposals; and settings."""

import json

import pytest
from pyspark.sql import functions as F

from mapforge.operators import prompt
from mapforge.sources import models, settings

TO = settings.Endpoint("http://nowhere/v1", "m", "k")


def test_environment(tmp_path):
    file = tmp_path / "env"
    file.write_text("# A=0\n\nexport A = 'x'\nB=\"y=z\"\nC=\nno sign\nD=4\n")
    env = settings.environment(file, {"D": "", "E": "5"})
    assert env == {"A": "x", "B": "y=z", "C": "", "D": "", "E": "5"}
    assert settings.first_of(env, ["C", "D", "missing", "B"]) == "y=z" and settings.first_of(env, ["C"], "d") == "d"
    to = settings.endpoint(env, ["C"], ["A"], ["E"], "url", "model")
    assert (to.url, to.model, to.key) == ("url", "5", "x") and "x'" not in repr(to)
    assert settings.environment(tmp_path / "none", {}) == {}


def test_second_tries():
    slept = []
    fails = iter([models.ModelError(429, "", {"Retry-After": "7"}), models.ModelError(None, "timeout"), models.ModelError(503, "", {"Retry-After": "soon"})])

    def call():
        for e in fails:
            raise e
        return {"ok": 1}

    assert models.patiently(call, slept.append) == {"ok": 1} and slept == [7.0, 4.0, 8.0]

    def refused():
        raise models.ModelError(401, "no")

    with pytest.raises(models.ModelError):
        models.patiently(refused, slept.append)
    assert len(slept) == 3

    def never():
        raise models.ModelError(500, "down")

    slept.clear()
    with pytest.raises(models.ModelError):
        models.patiently(never, slept.append)
    assert slept == [2.0, 4.0, 8.0, 16.0, 32.0]


def test_chat_asks_once(spark, tmp_path):
    log = tmp_path / "log"

    def send(url, payload, key):
        with open(log, "a") as f:
            f.write(payload["messages"][1]["content"] + "\n")
        return {"choices": [{"message": {"content": json.dumps({"said": payload["messages"][1]["content"]})}}], "usage": {"prompt_tokens": 5}}

    asked = spark.createDataFrame([(1, "t1", "a"), (2, "t1", "b"), (3, "t2", "a")], "n int, table string, user string").withColumns({"system": F.lit("s"), "schema": F.lit("{}"), "tag": F.lit("x")})
    first = models.chat(asked, TO, f"{tmp_path}/cache", send)
    rows = {r.n: r for r in first.collect()}
    assert [json.loads(rows[i].content)["said"] for i in (1, 2, 3)] == ["a", "b", "a"] and not rows[1].cached
    assert sorted(log.read_text().split()) == ["a", "b"]
    again = models.chat(asked.union(asked.where("n = 1").withColumn("user", F.lit("c")).select(asked.columns)), TO, f"{tmp_path}/cache", send)
    assert again.count() == 4 and sorted(log.read_text().split()) == ["a", "b", "c"]
    used = {r.table: r for r in models.usage(again, "table", order="n").collect()}
    assert (used["t1"].calls, used["t1"].cached_calls, used["t1"].prompt_tokens) == (3, 2, 5) and (used["t2"].calls, used["t2"].cached_calls, used["t2"].completion_tokens) == (4, 3, 0)
    assert models.chat(asked.where("false"), TO, f"{tmp_path}/empty", send).count() == 0


def test_embeddings(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "n int, text string").coalesce(1)

    def send(url, payload, key):
        assert len(payload["input"]) <= 64
        return {"data": [{"index": i, "embedding": [float(x[1:]), 1.0]} for i, x in reversed(list(enumerate(payload["input"])))]}

    def broken(url, payload, key):
        raise models.ModelError(400, "no")

    assert all(r.vector is None for r in models.embed(texts, TO, f"{tmp_path}/v", broken).collect())
    assert all(r.vector == [float(r.n), 1.0] and not r.cached for r in models.embed(texts, TO, f"{tmp_path}/v", send).collect())
    assert all(r.vector == [float(r.n), 1.0] and r.cached for r in models.embed(texts, TO, f"{tmp_path}/v", broken).collect())
    assert models.embed(texts, settings.Endpoint("u", "m"), f"{tmp_path}/v", send).where("vector is not null").isEmpty()


def test_model_proposer(spark, tmp_path):
    def send(url, payload, key):
        user = payload["messages"][1]["content"]
        name = user.split("Column: ")[1].split("\n")[0]
        said = {"disposition": "reuse", "target": "T.lost" if name == "b" and "Try again" not in user else "T.a", "confidence": 0.9}
        if name == "c":
            assert "- a: reuse -> T.a\n- b: reuse -> T.a" in user
            said = {"disposition": "new_attribute", "new_name": "c", "on_type": "T", "confidence": 0.8}
        return {"choices": [{"message": {"content": json.dumps(said)}}]}

    schema = "column string, position int, datatype string, shape string, samples array<string>, subject string, candidates array<struct<doc_id string, score double, aliased_from string>>"
    columns = spark.createDataFrame([(c, i, "string", None, ["v"], "T", [("T.a", 0.5, None)]) for i, c in enumerate("abc")], schema)
    cards = spark.createDataFrame([("T.a",)], "card_id string")
    out = {r.column: r.proposal for r in prompt.model_proposer("t.csv", TO, f"{tmp_path}/p", send)(columns, cards).collect()}
    assert out["a"].target == "T.a" and out["b"].target == "T.a" and (out["c"].disposition, out["c"].new_name, out["c"].target) == ("new_attribute", "c", None)
