"""Chat and embedding models as joins: what is asked, left joined to a stored cache by a content key, and only the rest sent out.

The cache is a Parquet table, to which the answers of each call are appended when all of them are there; a run that was cut
short finds the answers of the calls before.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.small import checkpointed
from .settings import Endpoint

#: What is tried again, how often, and how many texts go in a request.
RETRIED = (429, 500, 502, 503, 504)
RETRIES, BATCH, TAG = 5, 64, 80
_CHAT = "key string, content string, prompt_tokens long, completion_tokens long"
_VECTORS = "key string, vector array<double>"
Send = Callable[[str, dict[str, Any], str | None], dict[str, Any]]


class ModelError(RuntimeError):
    """A request that failed for good; ``status`` is null where no answer came."""

    def __init__(self, status: int | None, text: str, headers: Mapping[str, str] | None = None) -> None:
        super().__init__(f"{status}: {text[:500]}")
        self.status, self.headers, self.again = status, headers or {}, status is None or status in RETRIED


def post(url: str, payload: dict[str, Any], key: str | None, timeout: float = 60.0) -> dict[str, Any]:
    """One request, without a second try."""
    asked = urllib.request.Request(url, json.dumps(payload).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as got:
            return json.loads(got.read())
    except urllib.error.HTTPError as e:
        raise ModelError(e.code, e.read().decode("utf-8", "replace"), e.headers) from None
    except (TimeoutError, urllib.error.URLError) as e:
        raise ModelError(None, type(e).__name__) from None


def pause(attempt: int, headers: Mapping[str, str]) -> float:
    """Seconds before the next try: 2, 4, 8 and so on, or what the server asks for where that is longer."""
    try:
        asked = float(headers.get("Retry-After") or 0)
    except ValueError:
        asked = 0.0
    return max(2.0 ** (attempt + 1), asked)


def patiently(call: Callable[[], dict[str, Any]], sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """``call`` until it answers; an error that another try won't mend, or the last one, is raised."""
    for attempt in range(RETRIES):
        try:
            return call()
        except ModelError as e:
            if not e.again:
                raise
            sleep(pause(attempt, e.headers))
    return call()


def content_key(*parts: tuple[str, Column]) -> Column:
    """SHA-256 of a JSON object of the named parts, its keys in order."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(parts, key=lambda p: p[0])))), 256)


def tag(*parts: Column) -> Column:
    """A label of a request: its parts by underscores, any other character too, cut at 80."""
    return F.substring(F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9_]+", "_"), 1, TAG)


def _cache(df: DataFrame, path: str, schema: str) -> DataFrame:
    spark = df.sparkSession
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)
    return found.dropDuplicates(["key"])


def _through(keyed: DataFrame, path: str, schema: str, fetch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """``keyed`` with the cache's columns and ``cached``; each key that is missing is fetched once and appended."""
    keyed = checkpointed(keyed)
    known = _cache(keyed, path, schema)
    hits = known.select("key").withColumn("cached", F.lit(True))
    new = keyed.join(hits.select("key"), "key", "left_anti").dropDuplicates(["key"])
    marked = checkpointed(keyed.join(hits, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False))))
    if not new.isEmpty():
        new.mapInPandas(fetch, schema).write.mode("append").parquet(path)
    return marked.join(_cache(keyed, path, schema), "key", "left")


def chat(asked: DataFrame, to: Endpoint, cache: str, send: Send = post, max_tokens: int = 1024) -> DataFrame:
    """``asked(system, user, schema, tag, ...)`` with ``content`` (JSON), ``prompt_tokens``, ``completion_tokens`` and ``cached``.

    ``schema`` is the JSON schema of the answer. Requests with equal text are sent once; answers that were cached cost no tokens.
    An empty table asks nothing. A request that fails for good fails the call, and what the call was answered is not stored;
    the cache keeps what earlier calls left there.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                form = {"type": "json_schema", "json_schema": {"name": r.tag, "strict": True, "schema": json.loads(r.schema)}}
                said = [{"role": "system", "content": r.system}, {"role": "user", "content": r.user}]
                payload = {"model": to.model, "messages": said, "temperature": 0, "max_tokens": max_tokens, "response_format": form}
                got = patiently(lambda p=payload: send(f"{to.url.rstrip('/')}/chat/completions", p, to.key))
                used = got.get("usage") or {}
                rows.append((r.key, got["choices"][0]["message"]["content"], int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CHAT.split(", ")])

    key = content_key(("model", F.lit(to.model)), ("base_url", F.lit(to.url)), ("system", F.col("system")), ("user", F.col("user")), ("schema", F.col("schema")))
    return _through(asked.withColumn("key", key), cache, _CHAT, fetch)


def embed(texts: DataFrame, to: Endpoint, cache: str, send: Send = post) -> DataFrame:
    """``texts(text, ...)`` with ``vector`` and ``cached``; without a key, or if any request fails, no vectors at all (search is then lexical)."""
    none = texts.withColumns({"vector": F.lit(None).cast("array<double>"), "cached": F.lit(False)})
    if not to.key:
        return none

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                got = patiently(lambda p=part: send(f"{to.url.rstrip('/')}/embeddings", {"model": to.model, "input": list(p["text"])}, to.key))
                vectors = [x["embedding"] for x in sorted(got["data"], key=lambda x: x.get("index", 0))]
                yield pd.DataFrame({"key": list(part["key"]), "vector": vectors})

    key = content_key(("model", F.lit(to.model)), ("base_url", F.lit(to.url)), ("text", F.col("text")))
    try:
        return _through(texts.withColumn("key", key), cache, _VECTORS, fetch).drop("key")
    except Exception as e:  # noqa: BLE001 - whatever the service does wrong, search goes on without it
        if "ModelError" not in str(e) and "KeyError" not in str(e):
            raise
        return none


def usage(answers: DataFrame, of: str, *, order: str) -> DataFrame:
    """``of, calls, cached_calls, prompt_tokens, completion_tokens``, each added up from the first of ``of`` by ``order`` on."""
    paid = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), F.col(c))), F.lit(0))
    own = answers.groupBy(of).agg(F.min(order).alias("o"), F.count("*").alias("calls"), F.count_if("cached").alias("cached_calls"), *(paid(c).alias(c) for c in ("prompt_tokens", "completion_tokens")))
    so_far = Window.orderBy("o", of).rowsBetween(Window.unboundedPreceding, 0)  # a row for each table of a run
    return own.select(of, *(F.sum(c).over(so_far).alias(c) for c in ("calls", "cached_calls", "prompt_tokens", "completion_tokens")))
