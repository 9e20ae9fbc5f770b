"""Asking language models in batches: what is still to be asked, what a cache answers, the log of calls, verdicts.

Models are called outside. A cache is a table with one row a key (key, output, input_tokens, output_tokens), and answers are
such rows with cost_usd and latency_s. Nothing is grouped but keys, so a prompt that a third of all requests share is one row
wherever rows meet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.outputs import json_object
from .prompts import messages_json, prompt_hash

LOG = ("alias", "model", "prompt_hash", "input_tokens", "output_tokens", "cost_usd", "latency_s", "cached", "timestamp")
# What counts as no: JSON's false, null, zeros and empty values.
EMPTY = r'^(false|null|-?0(\.0*)?([eE][+-]?[0-9]+)?|""|\[\]|\{\})$'


def resolve(config: dict, alias: str) -> dict:
    """The parameters that a configuration (model_list of model_name and litellm_params) gives an alias; a name with a slash is a model itself."""
    known = {m["model_name"]: dict(m.get("litellm_params") or {}) for m in config.get("model_list") or ()}
    if alias in known:
        return known[alias]
    if "/" in alias:
        return {"model": alias}
    raise KeyError(f"unknown model {alias}; there are {sorted(known)}")


def requests(prompts: DataFrame, config: dict, alias: str, **parameters) -> DataFrame:
    """prompts (any columns and messages) with alias, model, prompt_hash and key. The key covers the parameters and the messages, never the API key."""
    p = resolve(config, alias) | {k: v for k, v in parameters.items() if v is not None}
    told = json.dumps({k: v for k, v in p.items() if k != "api_key"}, sort_keys=True, default=str)
    key = F.sha2(F.concat(F.lit(told + "\n"), messages_json(F.col("messages"))), 256)
    return prompts.select("*", F.lit(alias).alias("alias"), F.lit(p["model"]).alias("model"), prompt_hash(F.col("messages")).alias("prompt_hash"), key.alias("key"))


def pending(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, model, messages), one row a key that the cache doesn't hold."""
    fresh = asked.join(cache.select("key"), "key", "left_anti")
    return fresh.groupBy("key").agg(F.first("model").alias("model"), F.first("messages").alias("messages"))


def completed(asked: DataFrame, cache: DataFrame, answers: DataFrame, *order: str) -> DataFrame:
    """asked with output and the columns of a log of calls; a request that nothing answers has a null output and `cached` null.

    Of the requests with one fresh key the first in `order` (which tells requests apart) was the call; the others, and all
    that the cache holds, are cached and cost nothing. An answer to a key that the cache holds is left out."""
    fresh = answers.join(cache.select("key"), "key", "left_anti")
    columns = ("key", "output", "input_tokens", "output_tokens", "cost_usd", "latency_s")
    zero = [F.lit(0.0).alias("cost_usd"), F.lit(0.0).alias("latency_s")]
    held = cache.select(*columns[:4], *zero, F.lit(True).alias("held")).unionByName(fresh.select(*columns, F.lit(False).alias("held")))
    mark = F.struct(*order)
    first = asked.groupBy("key").agg(F.min(mark).alias("__first"))
    d = asked.join(held.join(first, "key"), "key", "left")
    cached = F.col("held") | (mark != F.col("__first"))
    paid = [F.when(cached, 0.0).otherwise(F.col(c)).alias(c) for c in columns[4:]]
    return d.select(*asked.columns, "output", "input_tokens", "output_tokens", *paid, cached.alias("cached"))


def call_log(done: DataFrame) -> DataFrame:
    """The log of the answered requests, for sources.records' JSON lines or functions.outputs' call_costs()."""
    return done.where("cached is not null").withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6).select(*LOG)


def grown(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with what it didn't hold; of repeated answers to a key one stays."""
    columns = ("key", "output", "input_tokens", "output_tokens")
    new = answers.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct(*columns[1:])).alias("a"))
    return cache.select(*columns).unionByName(new.select("key", "a.*"))


def is_phi(output: Column) -> Column:
    """What a verifier's answer says: "is_phi" and not empty; an answer that can't be read, or a null one, says no."""
    said = F.to_json(F.try_variant_get(F.try_parse_json(json_object(output)), "$.is_phi", "variant"))
    return F.coalesce(~said.rlike(EMPTY), F.lit(False))


def verdicts(outputs: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, is_phi) from (doc_id, start, end, label, output): what the confidence gate asks for."""
    return outputs.groupBy("doc_id", "start", "end", "label").agg(F.max(is_phi(F.col("output"))).alias("is_phi"))
