"""Quality rules by document and by host.

Documents are measured one by one; rule failures are added up per host, each host's rate is shrunk towards the
rate of all hosts with a beta prior fitted to the hosts themselves, and the verdict on the host goes back to its
documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_or_empty

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
WINDOW = 8
_NOT_WORD = "\t\n\x0b\x0c\r "
_ROWS = {}


def _multipliers(n: int) -> np.ndarray:
    if n not in _ROWS:
        _ROWS[n] = np.random.default_rng(20240229).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _ROWS[n]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words inside windows of ``window`` words that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.uint64, count=len(words))
    if len(seen) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(n, dtype=np.uint64)
    for k, m in enumerate(_multipliers(window)):
        hashed += mixed[k:k + n] * m
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def _measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8").split()  # bytes split at exactly the six blanks of the word rule
    lines, again, seen = text.split("\n"), 0, set()
    if len(lines) > 1:
        for line in lines:
            if line.strip(_NOT_WORD):
                again += line in seen
                seen.add(line)
    chars = len(text) - sum(map(text.count, _NOT_WORD))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def _kernel(texts: list[str]) -> dict[str, list]:
    rows = [_measure(t) for t in texts]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, columns)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by the five measures; a null text counts as one without words."""
    clash = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"} & set(docs.columns)
    kept = docs.drop(*clash).withColumn(text, text_or_empty(text))
    return map_texts(kept, _kernel, MEASURES, text)


def base_failed() -> Column:
    """Fixed rule: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rules whose failures are added up per host."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "few_words": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_words"),
        "word_length": (mean < 2) | (mean > 15),
    }


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: documents, failures of any rule, and the shrunk rate ``posterior``.

    The prior beta(a, b) has the mean and the variance between hosts of the raw rates by the method of moments,
    with the binomial share of the variance taken off. Hosts that do not differ (or a single host) give a strong
    prior, and every host then has the common rate. Documents without a host form one host of their own (null).
    """
    failed = F.lit(False)
    for rule in rules().values():
        failed = failed | rule
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(failed.cast("long")).alias("fails"),
        *[F.sum(rule.cast("long")).alias(f"fails_{name}") for name, rule in rules().items()])
    moments = hosts.agg(
        (F.sum("fails") / F.sum("n")).alias("p"),
        F.coalesce(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n"), 2)) / F.sum("n") - F.pow(F.sum("fails") / F.sum("n"), 2), F.lit(0.0)).alias("v"),
        (F.count("*") / F.sum("n")).alias("inverse_n"))
    noise = F.col("p") * (1 - F.col("p")) * F.col("inverse_n")
    between = F.greatest(F.col("v") - noise, F.col("p") * (1 - F.col("p")) * 1e-6)
    strength = F.when(between > 0, F.greatest(F.col("p") * (1 - F.col("p")) / between - 1, F.lit(1e-3))).otherwise(F.lit(1.0))
    prior = moments.select((F.col("p") * strength).alias("a"), ((1 - F.col("p")) * strength).alias("b"))
    # one row of two numbers, so this join cannot multiply rows
    return hosts.crossJoin(F.broadcast(prior)).withColumn("posterior", (F.col("fails") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b")))


def apply_host_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """Measures, ``base_failed``, the host's ``host_rate`` and ``kept`` for every document.

    ``kept`` is false for documents that fail the base rule and for all documents of a host whose shrunk failure
    rate is over ``max_rate``. Null and empty texts have no words and fail. Repeated rows are kept as rows. An
    empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    measured = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text")))
    rates = host_rates(measured, "host").select(F.col("host").alias("rate_host"), F.col("posterior").alias("host_rate"))
    joined = measured.join(rates, measured.host.eqNullSafe(rates.rate_host), "left").drop("rate_host")
    return joined.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))
