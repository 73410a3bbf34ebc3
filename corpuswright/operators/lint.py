"""Style rules: profile construction, percentile scores, findings, and ordered replacements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import japanese as J
from ..functions import rules as R
from ..functions import text as T
from ..functions.rules import Rules
from .analysis import sums
from .once import once
from .quantiles import quantiles

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
FINDING = "struct<rule:string,value:double,limit:double,message:string,place:string>"


def profile(metrics: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """metric, p10..p90, zero_ratio and direction of a reference distribution; one scan for all metrics."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x"), F.lit(d).alias("direction")) for m, d in directions.items()]))
    rows = metrics.select(cells.alias("z")).select("z.metric", "z.direction", "z.x")
    zeros = rows.groupBy("metric", "direction").agg(F.avg((F.col("x") == 0).cast("double")).alias("zero_ratio"))
    found = quantiles(rows, ["metric"], "x", PERCENTILES).select("metric", *[F.col(f"q{k}").alias(f"p{round(100 * p)}") for k, p in enumerate(PERCENTILES)])
    return zeros.join(found, "metric", "left")


def scored(metrics: DataFrame, key: str, reference: DataFrame, names: Sequence[str], compat: bool = False) -> DataFrame:
    """key, metric, value, percentile and deviation of every document and metric; the profile has a row per metric."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    long = metrics.select(F.col(key).alias("key"), cells.alias("z")).select("key", "z.metric", "z.value").join(F.broadcast(reference), "metric")
    p = T.percentile_of(F.col("value"), *[F.col(f"p{round(100 * q)}") for q in PERCENTILES], compat=compat)
    return long.withColumn("percentile", p).withColumn("deviation", T.deviation(F.col("percentile"), F.col("direction"))).select("key", "metric", "value", "percentile", "deviation")


# The reference distribution of the five rules' measures, and their default limits.
SPREAD = {
    "ten": (0.136, 0.304, 0.524, 0.792, 1.105),
    "bold": (0.0, 0.0, 0.0, 1.242, 4.329),
    "kanji": (0.119, 0.144, 0.174, 0.21, 0.249),
    "burstiness": (-0.377, -0.305, -0.234, -0.156, -0.081),
    "cv": (0.453, 0.532, 0.62, 0.728, 0.85),
}
LIMITS = {"ten": 1.65, "bold": 13.0, "kanji": 0.305, "burstiness": -0.45, "cv": 0.38}
UPPER = ("ten", "bold", "kanji")  # rules that a value above their limit breaks; the others a value below it


@dataclass(frozen=True)
class LintOptions:
    """Limits of the style rules. Overrides replace single limits and leave the others; with ``shallow`` they replace
    all, and a rule without one takes the percentile of the distribution that ``lower`` or ``upper`` names."""

    limits: Mapping[str, float] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    min_sentences: int = 10
    shallow: bool = False
    lower: str = "p10"
    upper: str = "p90"
    spread: Mapping[str, Sequence[float]] = field(default_factory=lambda: SPREAD)

    def limit(self, name: str) -> float:
        if name in self.limits:
            return self.limits[name]
        if self.limits and self.shallow:
            return self.spread[name][[f"p{round(100 * p)}" for p in PERCENTILES].index(self.upper if name in UPPER else self.lower)]
        return LIMITS[name]


def findings(df: DataFrame, text: str, rules: Rules, options: LintOptions = LintOptions(), phrases: Mapping[str, str] | None = None) -> DataFrame:  # noqa: B008
    """Adds ``findings``: what the rules say of a column of prose paragraphs (lists, quotes, headings, tables and code are
    no prose, see ``analysis.prose``); empty under the least number of sentences. ``phrases``: name -> pattern, each
    reported from two hits on. Sentences, lengths and sums are columns of their own, worked out once."""
    t, n = F.col(text), F.nullif(F.col("_n"), F.lit(0))
    rows = df.withColumn("_sents", T.sentences(t, rules)).withColumn("_chars", T.solid_length(t))
    rows = rows.withColumns({"_n": F.size("_sents"), "_mora": sums(F.transform("_sents", lambda x: T.mora(x).cast("double"))), "_length": sums(F.transform("_sents", lambda x: T.solid_length(x).cast("double")))})
    for name in ("_mora", "_length"):
        mean = F.col(f"{name}.total") / n
        rows = rows.withColumn(f"{name}_mean", mean).withColumn(f"{name}_sd", F.sqrt(F.greatest(F.col(f"{name}.squares") / n - mean * mean, F.lit(0.0))))
    m, s = F.col("_mora_mean"), F.col("_mora_sd")
    patterns = list((phrases or {}).values())
    ten, kanji, bold, *hits = T.counts_of(t, [f"[{rules.commas[:1]}]", rules.ideograph, R.BOLD, *patterns], J.needed)
    rows = rows.withColumns({
        "_ten": ten / n, "_bold": T.per_thousand(bold, F.col("_chars")), "_kanji": kanji / F.nullif(F.col("_chars"), F.lit(0)),
        "_burstiness": F.when(F.col("_n") >= 2, (s - m) / F.nullif(s + m, F.lit(0.0))), "_cv": F.col("_length_sd") / F.nullif(F.col("_length_mean"), F.lit(0.0)),
    } | {f"_phrase{k}": x for k, x in enumerate(hits)})
    found = []
    for name in (x for x in LIMITS if x not in options.disabled):
        value, limit, above = F.col(f"_{name}"), options.limit(name), name in UPPER
        place = T.position_label(value, *map(F.lit, options.spread[name]))
        found.append(F.when(value > limit if above else value < limit, F.struct(F.lit(name).alias("rule"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), F.lit("above" if above else "below").alias("message"), place.alias("place"))))
    for k, name in enumerate(phrases or {} if "phrases" not in options.disabled else ()):
        hits = F.col(f"_phrase{k}")
        found.append(F.when(hits >= 2, F.struct(F.lit("phrase").alias("rule"), hits.cast("double").alias("value"), F.lit(2.0).alias("limit"), F.lit(name).alias("message"), F.lit(None).cast("string").alias("place"))))
    none = F.array().cast(f"array<{FINDING}>")
    enough = F.coalesce(F.col("_n") >= options.min_sentences, F.lit(False))
    return once(rows.withColumn("findings", F.when(enough, F.array_compact(F.array(*found)) if found else none).otherwise(none)).select(*df.columns, "findings"), "findings")


def found(df: DataFrame, *keys: str) -> DataFrame:
    """The keys, rule, value, limit, message and place: a row a finding. The explosion is an outer one, since for a plain
    one Spark works out all findings once more to drop empty rows early."""
    return df.select(*keys, F.explode_outer("findings").alias("z")).where("z is not null").select(*keys, "z.*")


def autofix(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """A text after each (pattern, replacement) in turn."""
    for pattern, to in replacements:
        text = F.regexp_replace(text, pattern, to)
    return text


def fix_counts(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """How many hits the replacements have together, each on what the ones before it left."""
    total = F.lit(0)
    for pattern, to in replacements:
        total = total + T.count_of(text, pattern)
        text = F.regexp_replace(text, pattern, to)
    return total
