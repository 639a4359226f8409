"""Host-level quality rules, in DataFrame functions only.

Each document is measured by rules; failures are summed by host (the ``source`` column), each host's failure rate is shrunk towards
the corpus by a beta prior whose two parameters are estimated from the hosts themselves, and the verdict on the host is joined back.

A document is rejected when it fails a base rule, when it fails a document rule by a wide margin, or when it fails one narrowly and
its host is a bad one (shrunk failure rate of ``host_limit`` or more). A document that passes every rule is kept whatever its host.

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own; repeated rows count once
each; an empty table gives an empty result; other columns pass through ``quality_filter`` untouched.

Plan: to carry texts along, documents are measured twice (once to sum by host, once for the verdict) so that no text is shuffled or
copied; without texts the measures are written once. Only one row of sums per host and task is shuffled. The host table is broadcast when it has at most ``broadcast_hosts`` rows; beyond that the measures are joined by
host and salt, the host table being repeated once for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earlywarn.llm.storage import materialize

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Production parameters.
HOST_LIMIT = 0.5
BROADCAST_HOSTS = 100_000
SALTS = 64


def _repeated_windows(words: Column, n: Column) -> Column:
    """Sorted start positions of 3-word windows that occur twice or more.

    One long per window holds the high bits of its hash and, below them, its position; after sorting these, equal windows are neighbours.
    Neighbours with equal hash bits count only if their words are equal too.
    """
    bits = F.ceil(F.log2(n + 1)).cast("int")

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return F.call_function("shiftleft", F.call_function("shiftright", h, bits), bits).bitwiseOR(i.cast("long"))

    return F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), packed))).otherwise(F.array().cast("array<bigint>"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("_body"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_body", body).withColumn("_words", F.array_remove(F.split("_body", BLANKS, -1), ""))
    out = out.withColumn("_n", F.size("_words")).withColumn("_lines", lines)
    out = out.withColumn("_sorted", _repeated_windows(F.col("_words"), F.col("_n")))
    bits = F.ceil(F.log2(F.col("_n") + 1)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def same(x: Column, y: Column) -> Column:
        p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
        equal = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
        for k in range(3):
            equal = equal & (F.get("_words", p + k) == F.get("_words", q + k))
        return F.coalesce(equal, F.lit(False))

    twice = F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j + 1)) | ((j > 0) & same(x, F.get("_sorted", F.greatest(j - 1, F.lit(0))))))
    out = out.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask))))
    covered = F.aggregate(F.transform("_starts", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_starts", j + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    measures = {
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_body", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
    }
    # a filter on the verdict must not be pushed below this step: the optimizer would write the measures out in it, many times over
    return out.select(*docs.columns, *(c.alias(k) for k, c in measures.items()), F.monotonically_increasing_id().alias("_row"))


def _rules() -> tuple[Column, Column, Column]:
    """Failures: base, by a wide margin, narrow or wide. All in integers, so that no rounding decides."""
    n, symbols, dup, lines, chars = (F.col(c) for c in ("n_words", "n_symbols", "n_dup_lines", "n_lines", "word_chars"))
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    wide = (4 * symbols > n) | (2 * dup > lines)
    narrow = (10 * symbols > n) | (5 * dup > lines) | (chars < 2 * n) | (chars > 15 * n)
    return base, wide, wide | narrow


def host_verdicts(measured: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """``_host, host_docs, host_failures, host_rate, host_bad``: one row per host."""
    base, _, failed = _rules()
    by_host = measured.groupBy(_host_key(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum((base | failed).cast("long")).alias("host_failures"))
    by_host = materialize(by_host)
    rate = F.col("host_failures") / F.col("host_docs")
    # one row: the mean and the spread of the rates of all hosts
    r = by_host.agg((F.sum("host_failures") / F.sum("host_docs")).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("w")).first()
    mean = r.m or 0.0
    # rates of hosts of n documents differ by mean * (1 - mean) / n by chance alone
    spread = max(0.0, (r.v or 0.0) - mean * (1 - mean) * (r.w or 0.0))
    strength = max(1.0, min(10_000.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 10_000.0
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return by_host.select("_host", "host_docs", "host_failures", shrunk.alias("host_rate"), (shrunk >= host_limit).alias("host_bad"))


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def measured_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``key`` with the measures, base_failed, host_bad and kept. Without texts to carry, the measures are written once and read twice."""
    slim = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), F.col(host).alias(host))
    measured = materialize(measure(slim, "_text").drop("_text", "_row"))
    return _judge(measured, host_verdicts(measured, host, host_limit), F.col(key), host, broadcast_hosts)


def quality_verdicts(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``docs`` with the measures, base_failed, host_bad and kept. The rows and their measures are written once and read twice."""
    measured = materialize(measure(docs, text))
    return _judge(measured, host_verdicts(measured, host, host_limit), F.col(text), host, broadcast_hosts)


def _judge(measured: DataFrame, hosts: DataFrame, salt: Column, host: str, broadcast_hosts: int) -> DataFrame:
    hosts = materialize(hosts).select("_host", "host_bad")
    keyed = measured.withColumn("_host", _host_key(host))
    if hosts.count() <= broadcast_hosts:
        joined = keyed.join(F.broadcast(hosts), "_host", "left")
    else:
        salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_salt")
    base, wide, failed = _rules()
    joined = joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~wide & ~(failed & F.coalesce("host_bad", F.lit(False))))
    return joined.drop("_host")


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents kept, with their own columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    text = names[docs.columns.index(options.pop("text", "text"))]
    host = names[docs.columns.index(options.pop("host", "source"))]
    return quality_verdicts(inner, text, host, **options).where("kept and _row >= 0").select(*names).toDF(*docs.columns)
