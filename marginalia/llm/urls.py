"""URL filters: host and path rules, then a ratio of character language models.

Two smoothed variable-order Markov models (contexts of up to three characters,
Witten-Bell interpolation) are counted over all training URLs, one for accepted and
one for rejected ones.  A URL's value is the difference of its log-likelihoods over
its length; the threshold is calibrated on every fifth training URL, held out of the
counts, for the best mean of both classes' accuracies.

Training URLs are the whole table: rejected are those whose host has one of the
``reject_terms`` among its words, accepted the others, but without those that only a blocking rule
refuses: such rules speak about owners and not about what a URL looks like.

The counts that reach the driver are bounded by the alphabet and the order: at most
two times 32^4 numbers.

Defined results.  A null URL or one without ``://`` has an empty host and path and
is blocked; without any rejected or accepted training URL the method allows.  Rows
repeat as given, ids may be null, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
REJECT_TERMS = ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "track", "xxx")

ORDER, SYMBOLS = 3, 32
BINS = 400  # of the calibration's histogram, over differences from -5 to 5

# Letters, one symbol for digits, three signs, any other character, and the ends of a URL.
_SYMBOL = np.full(256, 30, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[48:58], _SYMBOL[46], _SYMBOL[45], _SYMBOL[47] = 26, 27, 28, 29
_END = 31


def host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    low = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the columns ``host`` and ``path``; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(text: str) -> np.ndarray:
    """Codes of the four-symbol windows of a URL, its ends included."""
    s = _SYMBOL[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    s = np.concatenate([np.full(ORDER, _END), s, [_END]])
    return ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell log-probabilities of the last symbol of every window, from four-symbol counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS ** (order + 1)).sum(axis=0).reshape(-1, SYMBOLS)
        kinds = (n > 0).sum(axis=1, keepdims=True) + 1e-9
        # The context of this order drops its first symbol for the order below.
        below = np.tile(p.reshape(-1, SYMBOLS), (n.shape[0] // max(1, p.size // SYMBOLS), 1))
        p = (n + kinds * below) / (n.sum(axis=1, keepdims=True) + kinds)
    return np.log(p).ravel()


def _training(urls: DataFrame, terms: tuple) -> DataFrame:
    term = F.col("host").rlike(r"(^|[.-])(" + "|".join(map(re.escape, terms)) + r")([.-]|$)")
    shown = urls.filter((F.length("host") > 0) & (term | F.coalesce(F.col("verdict") != "block", F.lit(True))))
    return shown.select(F.concat("host", "path").alias("url"), term.cast("int").alias("rejected"), (F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).alias("kept"))


def train(urls: DataFrame, terms: tuple = REJECT_TERMS) -> np.ndarray:
    """Differences of log-probabilities by window code, accepted minus rejected."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, SYMBOLS ** (ORDER + 1)), np.int64)
        for pdf in frames:
            for label, part in pdf.groupby("rejected"):
                codes = np.concatenate([grams(u) for u in part["url"]])
                np.add.at(total[label], codes, 1)
        label, code = np.nonzero(total)
        yield pd.DataFrame({"rejected": label.astype(np.int32), "code": code, "n": total[label, code]})

    rows = (_training(urls, terms).filter(~F.col("kept")).select("url", "rejected").mapInPandas(run, "rejected int, code long, n long")
            .groupBy("rejected", "code").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((2, SYMBOLS ** (ORDER + 1)))
    counts[rows["rejected"].to_numpy(int), rows["code"].to_numpy(int)] = rows["n"].to_numpy(float)
    if not counts.sum(axis=1).all():
        return np.zeros(counts.shape[1], np.float32)
    return (log_probabilities(counts[0]) - log_probabilities(counts[1])).astype(np.float32)


def values(urls: DataFrame, model: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` and ``value``, the length-normalised difference for ``host`` and ``path``."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [float(shared.value[grams(u)].mean()) for u in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, pa.float64())], [*columns, "value"])

    rows = urls.select(*columns, F.concat("host", "path").alias("_url"))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns), "value double"]))


def calibrate(urls: DataFrame, model: np.ndarray, terms: tuple = REJECT_TERMS) -> float:
    """The value from which a URL is accepted, by the held-out fifth; 0 when a class is missing there."""
    kept = _training(urls, terms).filter("kept").select("rejected", F.col("url").alias("host"), F.lit("").alias("path"))
    cell = F.least(F.greatest(F.floor((F.col("value") + 5) / 10 * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = values(kept, model, ["rejected"]).groupBy("rejected", cell.alias("cell")).count().toPandas()
    seen = np.zeros((2, BINS))
    seen[rows["rejected"].to_numpy(int), rows["cell"].to_numpy(int)] = rows["count"].to_numpy(float)
    if not seen.sum(axis=1).all():
        return 0.0
    share = seen.cumsum(axis=1) / seen.sum(axis=1, keepdims=True)
    good = share[1] - share[0]  # rejected below the cut less accepted below it
    best = np.flatnonzero(good == good.max())
    return float((best[0] + best[-1] + 2) / 2 / BINS * 10 - 5)


def judge(pages: DataFrame, rules: tuple = RULES, terms: tuple = REJECT_TERMS) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, value``."""
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_of(rules)
    urls = urls.select("*", name.alias("rule"), verdict.alias("verdict"))
    model = train(urls, terms)
    cut = calibrate(urls, model, terms)
    by_method = F.when((F.length("host") > 0) & (F.col("value") >= cut), "allow").otherwise("block")
    return values(urls, model, ["page_id", "host", "path", "rule", "verdict"]).withColumn("verdict", F.coalesce("verdict", by_method))
