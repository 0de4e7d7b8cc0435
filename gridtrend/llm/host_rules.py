"""Quality rules by host, in DataFrame functions only.

Each document is measured once. Failures of every rule are counted by host (its
``source``), a host's failure rate is shrunk towards the rate of all documents with
a beta prior whose strength is estimated from how much hosts differ (method of
moments), and a host that fails a rule more often than the limit after shrinking is
rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtrend.llm.common import SPACE, keep, small, words

SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
LIMIT = 0.5
#: Strength of the prior where hosts differ no more than chance makes them.
FIRM = 1e6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of each text; those of a null text are zero.

    ``n_repeat_words`` counts the words covered by a three-word window that the text
    has at least twice. The windows are sorted with their places, so that equal ones
    are neighbours; each step is a plain projection, one after the other, because a
    later step reads the array of the one before by position.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = docs.select(
        *docs.columns,
        words(F.col(text)).alias("__w"),
        lines.alias("__lines"),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = plain.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__tri": F.sort_array(
                F.transform(
                    F.arrays_zip(
                        F.col("__w").alias("a"),
                        F.slice("__w", 2, F.greatest(F.size("__w"), F.lit(1))).alias("b"),
                        F.slice("__w", 3, F.greatest(F.size("__w"), F.lit(1))).alias("c"),
                    ),
                    lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("t"), i.alias("i")),
                )
            ),
        }
    ).drop("__w", "__lines")
    last = F.size("__tri") - 1

    def doubled(x: Column, k: Column) -> Column:
        before = (k > 0) & (F.get("__tri", k - 1)["t"] == x["t"])
        after = (k < last) & (F.get("__tri", k + 1)["t"] == x["t"])
        return before | after

    places = F.transform(F.filter("__tri", doubled), lambda x: x["i"])
    spread = counted.withColumn("__at", F.sort_array(places)).drop("__tri")

    def covers(i: Column, k: Column) -> Column:
        """Words that this window covers and the next repeated one does not."""
        following = F.coalesce(F.get("__at", k + 1), i + 3)
        return F.least(following - i, F.lit(3))

    covered = F.aggregate(F.transform("__at", covers), F.lit(0), lambda acc, x: acc + x)
    return spread.withColumn("n_repeat_words", covered.cast("long")).drop("__at")


def failures() -> dict[str, Column]:
    """Whether a measured document fails each rule."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def shrunk_rates(flags: DataFrame, host: str = "source") -> DataFrame:
    """(host, n, shrunk rate of each rule). ``flags`` has one 0/1 column per rule.

    With rates p of hosts of n documents and the mean m over all documents, the
    spread beyond chance is V = (sum n (p - m)^2 - (H - 1) m (1 - m)) / (N - sum n^2 / N)
    and the prior's strength K = m (1 - m) / V - 1, so a rate becomes
    (failures + m K) / (n + K). Rows without a host are left out.
    """
    hosts = keep(
        flags.filter(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in RULES])
    )
    n = F.col("n").cast("double")
    whole = hosts.agg(
        F.sum("n").alias("N"),
        F.count(F.lit(1)).alias("H"),
        F.sum(n * n).alias("squares"),
        *[F.sum(r).alias(f"f_{r}") for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / n).alias(f"q_{r}") for r in RULES],
    ).first()
    if not whole["N"]:
        return hosts.select(host, "n", *[F.lit(None).cast("double").alias(r) for r in RULES])
    rates = {}
    for r in RULES:
        mean = whole[f"f_{r}"] / whole["N"]
        spread = whole["N"] - whole["squares"] / whole["N"]
        over = whole[f"q_{r}"] - mean * mean * whole["N"] - (whole["H"] - 1) * mean * (1 - mean)
        between = over / spread if spread > 0 else 0.0
        strength = min(FIRM, max(0.0, mean * (1 - mean) / between - 1)) if between > 0 else FIRM
        rates[r] = (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select(host, "n", *[v.alias(r) for r, v in rates.items()])


def rejected_hosts(rates: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    worst = F.greatest(*[F.round(r, 9) for r in RULES])
    return rates.filter(worst > limit).select(F.col(host).alias("__host"))


def verdicts(whole: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Measured documents with ``base_failed`` and ``kept``.

    A document is kept if it passes the two base rules (at least 50 words; no more
    than half of them in repeated windows) and its host is not rejected; without a
    host only the base rules count. Repeated rows are judged, and counted, each.
    """
    fails = failures()
    whole = keep(whole.withColumn("base_failed", fails["short"] | fails["repeats"]))
    flags = whole.select(host, *[v.cast("int").alias(r) for r, v in fails.items()])
    bad = keep(rejected_hosts(shrunk_rates(flags, host), host, limit))
    if small(bad, 128):
        bad = F.broadcast(bad)
    marked = whole.join(bad, F.col(host) == F.col("__host"), "left")
    return marked.withColumn("kept", ~F.col("base_failed") & F.col("__host").isNull()).drop("__host")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", limit: float = LIMIT) -> DataFrame:
    """The documents that the rules keep, with their own columns as they were; a
    column that has the name of a measure is set aside meanwhile."""
    set_aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in (text, host)}
    judged = verdicts(measured(docs.withColumnsRenamed(set_aside), text), host, limit)
    return judged.filter("kept").select(*[F.col(set_aside.get(c, c)).alias(c) for c in docs.columns])
