"""Quality rules judged per host: each document's own rules, failures aggregated by host, host rates shrunk
with an empirical beta prior, and the host verdicts joined back to the documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import _SPACE, Texts, cuts, mix, per_text, sums_per_text
from terralex.session import materialise

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class HostRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_host_failure: float = 0.5  # a host goes if its shrunk failure rate is above this
    weak_prior: float = 2.0  # prior weight in documents where the hosts' rates do not vary
    broadcast_hosts: int = 100_000


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The rule features of a slice of texts, all counted exactly on whole texts."""
    t = Texts(texts)
    starts, ends, before = t.words()
    owner = per_text(before)
    points = t.code_points()
    symbols = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_SYMBOL[t.data], out=symbols[1:])
    repeat = np.zeros(len(starts), bool)
    if len(starts) > 2:
        words = t.hashes(starts, ends)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        window = mix(words[inside] + mix(words[inside + 1] + mix(words[inside + 2])))
        window = mix(window ^ mix(owner[inside].astype(np.uint64)))
        twice = inside[_repeated(window)]
        for k in range(3):
            repeat[twice + k] = True
    return {
        "n_words": np.diff(before),
        "word_chars": sums_per_text(points[ends] - points[starts], before),
        "n_symbols": symbols[t.offsets[1:]] - symbols[t.offsets[:-1]],
        "n_dup_lines": _repeated_lines(t),
        "n_repeat_words": sums_per_text(repeat.astype(np.int64), before),
    }


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur at least twice."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, values), len(twice) - 1)
    return twice[at] == values


def _repeated_lines(t: Texts) -> np.ndarray:
    breaks = np.flatnonzero(t.data == 10)
    starts = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]), kind="stable")
    owner = np.sort(np.concatenate([np.arange(t.count), np.searchsorted(t.offsets[1:], breaks, "right")]), kind="stable")
    after = np.append(starts[1:], len(t.data))
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends = np.where(last, t.offsets[1:][owner], after - 1)
    solid = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(~_SPACE[t.data], out=solid[1:])
    kept = solid[ends] > solid[starts]
    starts, ends, owner = starts[kept], ends[kept], owner[kept]
    key = mix(t.hashes(starts, ends) ^ mix(owner.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[again], minlength=t.count).astype(np.int64)


def with_features(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, source and a struct `_rules` of the features of each text; or, with `whole_rows`, the document
    itself as a struct `row` in place of doc_id (its columns then cannot clash with others)."""
    whole = F.struct("*").alias("row")
    inner = docs.select(whole, "source") if whole_rows else docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    kept = inner.drop("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("_rules", T.StructType([T.StructField(f, T.LongType()) for f in FEATURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("row").field("text") if whole_rows else batch.column("text")
            for start, count in cuts(text):
                rules = measure(text.slice(start, count))
                struct = pa.StructArray.from_arrays([pa.array(rules[f], pa.int64()) for f in FEATURES], names=list(FEATURES))
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(start, count) for n in names), struct], names=[*names, "_rules"])

    return inner.mapInArrow(run, schema)


def base_failed(options: HostRules):
    r = F.col("_rules")
    few = r.n_words < options.min_words
    return few | (100 * r.n_repeat_words > options.max_repeat_percent * r.n_words)


def host_verdicts(features: DataFrame, options: HostRules = HostRules()) -> DataFrame:
    """One row per host (`source`; null is a host of its own): documents, failures, shrunk rate, verdict.

    The prior's mean and weight come from the mean and variance of the hosts' failure rates (method of
    moments). The counts combine before the shuffle, so a host with a third of all documents is no hot spot.
    """
    hosts = features.groupBy(F.col("source").alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(base_failed(options).cast("long")).alias("n_failed"))
    rates = hosts.agg(F.avg(F.col("n_failed") / F.col("n_docs")).alias("mean"), F.var_samp(F.col("n_failed") / F.col("n_docs")).alias("var"))
    row = rates.first()
    mean, var = row["mean"] or 0.0, row["var"]
    weight = options.weak_prior if not var else max(mean * (1 - mean) / var - 1, options.weak_prior)
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= options.max_host_failure)


def judge(features: DataFrame, options: HostRules = HostRules(), hosts: DataFrame | None = None) -> DataFrame:
    """Features with `base_failed`, `host_rate` and `kept`. Hosts are broadcast only if counted few enough; a
    larger table is a sort-merge join whose hot hosts AQE splits."""
    hosts = host_verdicts(features, options) if hosts is None else hosts
    if hosts.count() <= options.broadcast_hosts:
        hosts = F.broadcast(hosts)
    hosts = hosts.select(F.col("host").alias("_host"), "host_rate", "host_kept")
    out = features.join(hosts, F.col("source").eqNullSafe(F.col("_host")), "left").drop("_host")
    failed = base_failed(options)
    return out.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(F.col("host_kept"), F.lit(True))})


def score_documents(docs: DataFrame, options: HostRules = HostRules()) -> DataFrame:
    """One row per document: its features, `base_failed`, its host's rate and `kept`.

    Null or empty text: no words, so it fails. Null source: one host. Repeated rows are judged each. Other
    columns of `docs` are ignored, whatever their names. An empty table gives an empty result.
    """
    features = materialise(with_features(docs))
    judged = judge(features, options)
    return judged.select("doc_id", *(F.col(f"_rules.{f}").alias(f) for f in FEATURES), "base_failed", "host_rate", "kept")


def keep_documents(docs: DataFrame, options: HostRules = HostRules()) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns."""
    hosts = materialise(host_verdicts(materialise(with_features(docs)), options))
    return judge(with_features(docs, whole_rows=True), options, hosts).where("kept").select("row.*")
