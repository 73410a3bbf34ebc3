"""Text queries. Latin rules over ``documents``; Markdown is put around their lines by a rule, since they hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import lint, markdown, patterns, tokens
from ..sources.tables import table
from .panel_queries import rounded
from .registry import register


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8239) || chr(12288)"
SENTS = f"""s AS (SELECT doc_id, lang, source, text, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '(,)\\s*[\\n\\r]+\\s*', '\\1', 'g'), '([.!?])', '\\1' || chr(1), 'g'), '[\\x01\\n\\r]+'),
 lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS sents FROM documents)"""
LEN = "length(regexp_replace(x, '\\s', '', 'g'))"


def _like(pattern: str):  # noqa: ANN202
    return lambda x: x.rlike(pattern)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


@register(f"""WITH {SENTS}, e AS (SELECT doc_id, unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS pos FROM s)
SELECT doc_id, pos::INT AS pos, length(regexp_replace(sentence, '\\s', '', 'g'))::INT AS chars, md5(sentence) AS digest FROM e""")
def sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(T.sentences(F.col("text"), LATIN)).alias("pos", "sentence"))
    return rows.select("doc_id", "pos", T.solid_length(F.col("sentence")).alias("chars"), F.md5("sentence").alias("digest"))


@register(f"""WITH {SENTS}, m AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars, list_transform(sents, lambda x: {LEN}::DOUBLE) AS ls, text, sents FROM s)
SELECT doc_id, chars::INT AS chars_body, len(ls)::INT AS n_sentences, round(list_avg(ls), 6) AS mean_chars, round(list_stddev_pop(ls), 6) AS sd_chars,
 CASE WHEN len(ls) >= 2 THEN round((list_stddev_pop(ls) - list_avg(ls)) / nullif(list_stddev_pop(ls) + list_avg(ls), 0), 6) END AS burstiness,
 round(len(regexp_extract_all(text, ',')) / nullif(len(ls), 0), 6) AS ten_per_sentence, round(len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*|__[^_\\n]+__')) / nullif(chars, 0) * 1000, 6) AS bold_per_1k,
 round(len(regexp_extract_all(text, '[A-Z]')) / nullif(chars, 0), 6) AS capital_ratio, round(len(list_filter(sents, lambda x: regexp_matches(x, '(ed|ing)[.!?]?$'))) / nullif(len(sents), 0), 6) AS polite_ratio, round(least(1.0, len(ls) / 30.0), 6) AS weight FROM m""")
def doc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").withColumn("sents", T.sentences(F.col("text"), LATIN))
    rows = rows.withColumns({"chars_body": T.solid_length(F.col("text")), "ls": F.transform("sents", lambda x: T.solid_length(x).cast("double")), "n_sentences": F.size("sents")})
    text, n = F.col("text"), F.nullif(F.col("n_sentences"), F.lit(0))
    out = rows.select(
        "doc_id", "chars_body", "n_sentences", T.mean_of(F.col("ls")).alias("mean_chars"), T.spread_of(F.col("ls")).alias("sd_chars"), T.burstiness(F.col("ls")).alias("burstiness"),
        (T.count_of(text, ",") / n).alias("ten_per_sentence"), T.per_thousand(T.count_of(text, r"\*\*[^*\n]+\*\*|__[^_\n]+__"), F.col("chars_body")).alias("bold_per_1k"),
        (T.count_of(text, "[A-Z]") / F.nullif(F.col("chars_body"), F.lit(0))).alias("capital_ratio"), T.share_like(F.col("sents"), LATIN.polite).alias("polite_ratio"), T.weight(F.col("n_sentences")).alias("weight"),
    )
    return rounded(out, "mean_chars", "sd_chars", "burstiness", "ten_per_sentence", "bold_per_1k", "capital_ratio", "polite_ratio", "weight")


REASON = f"""{SENTS}, r AS (SELECT doc_id, source, CASE WHEN regexp_replace(coalesce(text, ''), '\\s', '', 'g') = '' THEN 'empty_body' WHEN length(regexp_replace(text, '\\s', '', 'g')) < 300 THEN 'short_body'
 WHEN len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) < 0.30 * length(regexp_replace(text, '\\s', '', 'g')) THEN 'other_script' WHEN len(regexp_extract_all(text, '[A-Za-zÀ-ÿ]')) < 200 THEN 'few_letters'
 WHEN len(regexp_extract_all(text, '[a-zà-ÿ]')) < 0.12 * length(regexp_replace(text, '\\s', '', 'g')) THEN 'low_kana' WHEN len(sents) < 5 THEN 'few_sentences' END AS reason FROM s)"""


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    return documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", T.exclusion_reason(F.col("text"), F.lit(""), no, no, LATIN).alias("reason"))


@register(f"WITH {REASON} SELECT source, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT 'all', coalesce(reason, 'kept'), count(*) FROM r GROUP BY 1, 2")
def exclusion_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reasons(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("kept"))).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(rows.groupBy("reason").agg(F.sum("n").alias("n")).withColumn("source", F.lit("all")))


@register(f"WITH {REASON} SELECT doc_id FROM r WHERE reason IS NULL")
def kept_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(spark, sf_dir).where("reason is null").select("doc_id")


WORDS = "w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM documents)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))
    return documents(spark, sf_dir, "doc_id", "lang", "source", "text").select(F.col("doc_id").alias("key"), "lang", "source", F.explode_outer(found).alias("word")).where("word is not null")


@register(f"WITH {WORDS} SELECT word, count(*) AS freq, count(DISTINCT doc_id) AS doc_freq FROM w GROUP BY 1")
def word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.frequencies(words(spark, sf_dir), *())


@register("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, round(len(list_distinct(t)) / nullif(len(t), 0), 6) AS ttr FROM w""")
def ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir, "doc_id", "text").withColumn("t", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    return rounded(t.select("doc_id", F.size("t").alias("n_tokens"), T.type_token_ratio(F.col("t")).alias("ttr")), "ttr")


_seen = "CASE WHEN list_contains(a.types, b.types[1]) THEN a.types ELSE list_append(a.types, b.types[1]) END"
_none = "{'f': 0::DOUBLE, 'n': 0::BIGINT, 'types': []::VARCHAR[]}"
_fold = lambda t: f"list_reduce(list_transform({t}, lambda x: {{'f': 0::DOUBLE, 'n': 0::BIGINT, 'types': [x]}}), lambda a, b: CASE WHEN len({_seen}) <= 0.72 * (a.n + 1) THEN {{'f': a.f + 1, 'n': 0::BIGINT, 'types': []::VARCHAR[]}} ELSE {{'f': a.f, 'n': a.n + 1, 'types': {_seen}}} END, {_none})"
_factors = lambda x: f"CASE WHEN {x}.n > 0 THEN {x}.f + (1 - len({x}.types) / {x}.n) / (1 - 0.72) ELSE {x}.f END"


@register(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS t FROM documents), s AS (SELECT doc_id, len(t) AS n, {_fold('t')} AS a, {_fold('list_reverse(t)')} AS b FROM w WHERE len(t) >= 50), k AS (SELECT doc_id, n, {_factors('a')} AS ka, {_factors('b')} AS kb FROM s)
SELECT documents.doc_id, round((CASE WHEN ka > 0 THEN n / ka ELSE n END + CASE WHEN kb > 0 THEN n / kb ELSE n END) / 2, 6) AS mtld FROM documents LEFT JOIN k USING (doc_id)""")
def mtld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical diversity forwards and backwards, one pass over a document's words each way."""
    t = documents(spark, sf_dir, "doc_id", "text").withColumn("t", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1)))
    return rounded(t.select("doc_id", tokens.mtld("t").alias("mtld")), "mtld")


CHARS = """c AS (SELECT doc_id, lang, source, len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0) AS upper_ratio, len(regexp_extract_all(text, '[0-9]')) / nullif(length(text), 0) AS digit_ratio,
 len(regexp_extract_all(text, '[À-ÿ]')) / nullif(length(text), 0) AS accent_ratio, len(regexp_extract_all(text, '[,;:]')) / nullif(length(text), 0) AS comma_ratio FROM documents)"""
RATIOS = ("upper_ratio", "digit_ratio", "accent_ratio", "comma_ratio")


@register(f"WITH {CHARS} SELECT lang, count(*) AS n, {', '.join(f'round(avg({r}), 8) AS {r}' for r in RATIOS)} FROM c GROUP BY 1")
def char_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = F.col("text"), F.nullif(F.length("text"), F.lit(0))
    ratios = dict(zip(RATIOS, ("[A-Z]", "[0-9]", "[À-ÿ]", "[,;:]"), strict=True))
    each = documents(spark, sf_dir, "lang", "text").select("lang", *[(T.count_of(text, p) / n).alias(c) for c, p in ratios.items()])
    return rounded(each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in RATIOS]), *RATIOS, to=8)


@register("""SELECT lang, count(*) AS n, round(sum(len(regexp_extract_all(text, '[A-Z]'))) / sum(length(text)), 8) AS pooled_upper, round(avg(len(regexp_extract_all(text, '[A-Z]')) / nullif(length(text), 0)), 8) AS mean_upper FROM documents GROUP BY 1""")
def pooled_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = documents(spark, sf_dir, "lang", "text").select("lang", T.count_of(F.col("text"), "[A-Z]").alias("u"), F.length("text").alias("n"))
    return rounded(each.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.sum("u") / F.sum("n")).alias("pooled_upper"), F.avg(F.col("u") / F.nullif(F.col("n"), F.lit(0))).alias("mean_upper")), "pooled_upper", "mean_upper", to=8)


ODDS = f"""WITH {WORDS}, a AS (SELECT word, count(*) AS f FROM w WHERE lang = 'en' GROUP BY 1), b AS (SELECT word, count(*) AS f FROM w WHERE lang = 'de' GROUP BY 1),
u AS (SELECT coalesce(a.word, b.word) AS word, coalesce(a.f, 0) AS fa, coalesce(b.f, 0) AS fb FROM a FULL JOIN b ON a.word = b.word), t AS (SELECT sum(fa)::DOUBLE AS na, sum(fb)::DOUBLE AS nb FROM u),
z AS (SELECT word, fa, fb, na, nb, 0.01::DOUBLE * (na + nb) AS a0, 0.01::DOUBLE * (na + nb) * (fa + fb) / (na + nb) AS p FROM u, t)
SELECT word, fa::BIGINT AS freq_a, fb::BIGINT AS freq_b, round((ln((fb + p) / (nb + a0 - fb - p)) - ln((fa + p) / (na + a0 - fa - p))) / sqrt(1 / (fa + p) + 1 / (fb + p)), 6) AS z FROM z"""


@register(ODDS)
def log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir)
    side = lambda lang: rows.where(F.col("lang") == lang).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return rounded(tokens.log_odds(side("en"), side("de")), "z")


@register(f"WITH o AS ({ODDS}) (SELECT 'b' AS side, word, z FROM o ORDER BY z DESC, word LIMIT 20) UNION ALL (SELECT 'a' AS side, word, z FROM o ORDER BY z, word LIMIT 20)")
def log_odds_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = log_odds(spark, sf_dir)
    ends = [z.orderBy(order, "word").limit(20).select(F.lit(side).alias("side"), "word", "z") for side, order in (("b", F.desc("z")), ("a", F.asc("z")))]
    return ends[0].unionByName(ends[1])


@register(f"""WITH {WORDS}, x AS (SELECT word, substr(source, 4)::INT AS year, count(DISTINCT doc_id) AS df FROM w GROUP BY 1, 2), n AS (SELECT substr(source, 4)::INT AS year, count(*) AS docs FROM documents GROUP BY 1),
top AS (SELECT word FROM x GROUP BY 1 ORDER BY sum(df) DESC, word LIMIT 90), g AS (SELECT word FROM x JOIN top USING (word) GROUP BY 1 HAVING sum(df) >= 30 ORDER BY sum(df) DESC, word LIMIT 30)
SELECT g.word, n.year, round(100.0 * coalesce(x.df, 0) / n.docs, 6) AS rate FROM g CROSS JOIN n LEFT JOIN x ON x.word = g.word AND x.year = n.year""")
def word_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 30 words in most documents, with the share of each source's documents that have them."""
    year = F.substring("source", 4, 9).cast("int")
    counts = words(spark, sf_dir).select("key", "word", year.alias("year")).distinct().groupBy("word", "year").agg(F.count(F.lit(1)).alias("df"))
    docs = documents(spark, sf_dir, "source").groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("docs"))
    # a word's counts go along with its total, one a source, as a join with the counts would work them out twice
    totals = counts.groupBy("word").agg(F.sum("df").alias("n"), F.collect_list(F.struct("year", "df")).alias("z")).orderBy(F.desc("n"), "word").limit(90)
    top = totals.where("n >= 30").orderBy(F.desc("n"), "word").limit(30).select("word", "z")
    grid = F.broadcast(top).crossJoin(docs)  # 30 words by source
    df = F.get(F.filter("z", lambda x: x["year"] == F.col("year")), F.lit(0))["df"]
    out = grid.withColumn("rate", 100.0 * F.coalesce(df, F.lit(0)) / F.col("docs"))
    return rounded(out.select("word", "year", "rate"), "rate")


PATTERNS = {"the": r"\bthe\b", "double letters": r"tt|ss", "long word": r"[a-z]{10,}", "comma": ","}
_P = " UNION ALL ".join(f"SELECT '{n}' AS pattern, year, len(regexp_extract_all(text, '{p}')) AS hits, length(text) AS chars FROM d" for n, p in PATTERNS.items())


@register(f"""WITH d AS (SELECT substr(source, 4)::INT AS year, lower(text) AS text FROM documents WHERE length(text) >= 300), h AS ({_P}),
y AS (SELECT pattern, year, sum(hits)::BIGINT AS hits, count(*) FILTER (hits > 0) AS articles, count(*) AS n, 1000.0 * sum(hits) / nullif(sum(chars), 0) AS v FROM h GROUP BY 1, 2),
e AS (SELECT pattern, min_by(v, year) FILTER (year <= 9) v0, min(year) FILTER (year <= 9) y0, max_by(v, year) FILTER (year <= 9) v1, max(year) FILTER (year <= 9) y1, min_by(v, year) FILTER (year > 9) v2, min(year) FILTER (year > 9) y2, max_by(v, year) FILTER (year > 9) v3, max(year) FILTER (year > 9) y3 FROM y GROUP BY 1),
s AS (SELECT pattern, (v1 - v0) / nullif(y1 - y0, 0) AS pre, (v3 - v2) / nullif(y3 - y2, 0) AS post FROM e)
SELECT pattern, round(pre, 6) AS pre_slope, round(post, 6) AS post_slope, CASE WHEN pre > 0.05 AND post > 2 * pre THEN 'accelerating' WHEN pre > 0.05 THEN 'rising before' WHEN post > 0.05 THEN 'rising after' WHEN post < -0.05 THEN 'falling' ELSE 'flat' END AS verdict FROM s""")
def pattern_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import slopes, verdict

    rows = documents(spark, sf_dir, "source", "text").where(F.length("text") >= 300).select(F.substring("source", 4, 9).cast("int").alias("year"), F.lower("text").alias("text"))
    hits = F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), T.count_of(F.col("text"), p).alias("hits")) for n, p in PATTERNS.items()]))
    yearly = rows.select("year", F.length("text").alias("chars"), hits.alias("z")).groupBy("z.pattern", "year").agg((1000.0 * F.sum("z.hits") / F.nullif(F.sum("chars"), F.lit(0))).alias("v"))
    out = slopes(yearly, 9, bridge=False, by=("pattern",)).withColumn("verdict", verdict(F.col("pre_slope"), F.col("post_slope")))
    return rounded(out.select("pattern", "pre_slope", "post_slope", "verdict"), "pre_slope", "post_slope")


LEXICON, CONTROL = ("thing", "tion", "ness", "able", "mente"), ("and", "the", "est", "und")
_L = " UNION ALL ".join(f"SELECT '{w}' AS word, {'true' if w in CONTROL else 'false'} AS control, year, contains(text, '{w}') AS hit FROM d" for w in LEXICON + CONTROL)


@register(f"""WITH d AS (SELECT substr(source, 4)::INT AS year, lower(text) AS text FROM documents), l AS ({_L}),
r AS (SELECT word, control, 100 * avg(hit::INT) FILTER (year < 10) AS before, 100 * avg(hit::INT) FILTER (year >= 10) AS after, count(*) FILTER (hit) AS docs FROM l GROUP BY 1, 2 HAVING count(*) FILTER (hit) >= 5),
q AS (SELECT *, after / nullif(before, 0) AS ratio FROM r), b AS (SELECT min(ratio) AS lo, max(ratio) AS hi FROM q WHERE control)
SELECT word, control, docs, round(before, 6) AS before, round(after, 6) AS after, round(ratio, 6) AS ratio, ratio < lo OR ratio > hi AS outside FROM q, b""")
def lexicon_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexicon against control words: growth of the share of documents, and whether it leaves the controls' band."""
    rows = documents(spark, sf_dir, "source", "text").select(F.substring("source", 4, 9).cast("int").alias("year"), F.lower("text").alias("text"))
    cells = F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(w in CONTROL).alias("control"), F.col("text").contains(w).alias("hit")) for w in LEXICON + CONTROL]))
    each = rows.select("year", cells.alias("z")).groupBy("z.word", "z.control")
    rate = lambda c: 100 * F.avg(F.when(c, F.col("z.hit").cast("int")))
    r = each.agg(rate(F.col("year") < 10).alias("before"), rate(F.col("year") >= 10).alias("after"), F.count_if("z.hit").alias("docs")).where("docs >= 5")
    r = r.withColumn("ratio", F.col("after") / F.nullif(F.col("before"), F.lit(0.0)))
    band = r.where("control").agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    out = r.crossJoin(F.broadcast(band)).withColumn("outside", (F.col("ratio") < F.col("lo")) | (F.col("ratio") > F.col("hi"))).drop("lo", "hi")
    return rounded(out, "before", "after", "ratio")


@register("""WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{3,}')) AS word FROM benchmark), d AS (SELECT lower(text) AS text FROM documents WHERE text IS NOT NULL),
c AS (SELECT word, (length(text) - length(replace(text, word, ''))) // length(word) AS n FROM l, d WHERE contains(text, word))
SELECT word, count(n) AS documents, coalesce(sum(n), 0)::BIGINT AS n FROM l LEFT JOIN c USING (word) GROUP BY 1""")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the benchmark's items as one lexicon: the documents that contain each, inside of words too, and its
    occurrences, in one pass over the texts."""
    lexicon = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{3,}"), F.lit(0))).alias("word")).distinct()
    texts = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.lower("text").alias("text"))
    return patterns.word_counts(texts, "doc_id", "text", lexicon)


@register("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{3,}'), 1) AS k FROM documents),
n AS (SELECT doc_id FROM w GROUP BY 1 HAVING count(*) BETWEEN 100 AND 700), c AS (SELECT doc_id, word, count(*) AS c FROM w JOIN n USING (doc_id) WHERE k <= 100 GROUP BY 1, 2)
SELECT doc_id, round(max(c) / 100.0, 6) AS top_share, round(count(*) FILTER (c = 1) / count(*), 6) AS hapax_share, round(count(*) / 100.0, 6) AS ttr FROM c GROUP BY 1""")
def lexical_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.lexical_window(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", "[a-z]{3,}", 100, 700)
    return rounded(found.withColumnRenamed("key", "doc_id"), "top_share", "hapax_share", "ttr")


@register(f"""WITH {WORDS}, c AS (SELECT substr(word, 1, 2) AS concept, word, count(*) AS n FROM w GROUP BY 1, 2), p AS (SELECT concept, n, n::DOUBLE / sum(n) OVER (PARTITION BY concept) AS p FROM c)
SELECT concept, sum(n)::BIGINT AS n, abs(round(sum(p * log2(p)), 6)) AS entropy_bits, round(max(p), 6) AS top_share FROM p GROUP BY 1""")
def concept_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each concept's words from sums: log2(N) - sum(n log2 n) / N needs no window over words."""
    c = words(spark, sf_dir).groupBy(F.substring("word", 1, 2).alias("concept"), "word").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").cast("double")
    out = c.groupBy("concept").agg(F.sum("n").alias("n"), (F.log2(n) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n).alias("entropy_bits"), (F.max("n") / n).alias("top_share"))
    return rounded(out.withColumn("entropy_bits", F.abs("entropy_bits")), "entropy_bits", "top_share")


ENDING = "CASE WHEN regexp_matches(x, '\\?$') THEN 'question' WHEN regexp_matches(x, '!$') THEN 'exclamation' WHEN regexp_matches(x, '[.]$') THEN 'stop' ELSE 'open' END"


@register(f"""WITH {SENTS}, e AS (SELECT doc_id, lang, unnest(list_transform(sents, lambda x: {ENDING})) AS ending FROM s), k AS (SELECT * FROM (VALUES ('question'), ('exclamation'), ('stop'), ('open')) AS v(ending)),
d AS (SELECT doc_id, lang, k.ending, avg((e.ending = k.ending)::INT) AS r, count(*) FILTER (e.ending = k.ending) AS n, count(*) AS t FROM e, k GROUP BY 1, 2, 3)
SELECT lang, ending, round(median(r), 6) AS median_ratio, round(sum(n) / sum(t), 6) AS pooled_ratio FROM d GROUP BY 1, 2""")
def sentence_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"question": r"\?$", "exclamation": "!$", "stop": "[.]$", "open": "[^.!?]$"}
    rows = documents(spark, sf_dir, "lang", "text").withColumn("s", T.sentences(F.col("text"), LATIN)).where(F.size("s") > 0)
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("ending"), F.size(F.filter("s", _like(p))).alias("n")) for k, p in kinds.items()]))
    each = rows.select("lang", F.size("s").alias("t"), cells.alias("z"))
    out = each.groupBy("lang", "z.ending").agg(F.median(F.col("z.n") / F.col("t")).alias("median_ratio"), (F.sum("z.n") / F.sum("t")).alias("pooled_ratio"))
    return rounded(out, "median_ratio", "pooled_ratio")


@register("""SELECT conv_id, turn, role, length(text)::INT AS chars, lag(length(text)) OVER o::INT AS prev_chars, lead(role) OVER o AS next_role,
 CASE row_number() OVER o WHEN 1 THEN 'first' ELSE CASE WHEN lead(turn) OVER o IS NULL THEN 'last' ELSE 'middle' END END AS position FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.partitionBy("conv_id").orderBy("turn")
    chars = F.length("text")
    position = F.when(F.row_number().over(o) == 1, "first").when(F.lead("turn").over(o).isNull(), "last").otherwise("middle")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", chars.alias("chars"), F.lag(chars).over(o).alias("prev_chars"), F.lead("role").over(o).alias("next_role"), position.alias("position"))


HREF = "regexp_extract_all(coalesce(html, ''), '(?:href|src)=\"([^\"]*)\"', 1)"


@register(f"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, unnest({HREF}) AS link FROM pages)
SELECT host, count(*) AS links, count(*) FILTER (regexp_matches(link, '^https?://') AND regexp_extract(link, '^https?://([^/?#]+)', 1) <> host) AS external_links, count(DISTINCT page_id) AS pages FROM l GROUP BY 1""")
def links_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]*)"'), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", host("url").alias("host"), found.alias("ls")).where(F.size("ls") > 0)
    away = F.size(F.filter("ls", lambda x: x.rlike("^https?://") & (host(x) != F.col("host"))))
    each = pages.groupBy("page_id", "host").agg(F.sum(F.size("ls")).alias("n"), F.sum(away).alias("away"))
    return each.groupBy("host").agg(F.sum("n").alias("links"), F.sum("away").alias("external_links"), F.count(F.lit(1)).alias("pages"))


@register("""SELECT page_id, len(regexp_extract_all(html, '<a[ >]'))::INT AS n_links, len(regexp_extract_all(html, '<img[ >]'))::INT AS n_images, len(regexp_extract_all(html, '<li[ >]'))::INT AS n_items,
 len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)[1:5]))::INT AS capped_targets FROM pages""")
def html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: T.count_of(F.col("html"), p)
    targets = F.slice(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), 1, 5)
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", n("<a[ >]").alias("n_links"), n("<img[ >]").alias("n_images"), n("<li[ >]").alias("n_items"), n("<p[ >]").alias("n_paragraphs"), F.size(F.array_distinct(targets)).alias("capped_targets"))


@register("""WITH t AS (SELECT p_size % 5 AS grp, p_name AS title FROM part), g AS (SELECT grp, count(*) AS n, avg(length(title)) AS mean_length, median(length(title)) AS median_length,
 100 * avg(regexp_matches(title, '[0-9]')::INT) AS digit_pct, 100 * avg(regexp_matches(title, '[?!:]')::INT) AS symbol_pct FROM t GROUP BY 1 HAVING count(*) >= 20)
SELECT grp, n, round(mean_length, 6) AS mean_length, median_length, round(digit_pct, 6) AS digit_pct, round(symbol_pct, 6) AS symbol_pct FROM g""")
def title_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("p_name")
    pct = lambda p: 100 * F.avg(title.rlike(p).cast("int"))
    out = table(spark, sf_dir, "part", "p_size", "p_name").groupBy((F.col("p_size") % 5).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(title)).alias("mean_length"), F.median(F.length(title)).alias("median_length"), pct("[0-9]").alias("digit_pct"), pct("[?!:]").alias("symbol_pct"))
    return rounded(out.where("n >= 20"), "mean_length", "digit_pct", "symbol_pct")


MARKED = """l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, source, i, line, CASE i % 6 WHEN 1 THEN 'heading' WHEN 2 THEN 'body' WHEN 3 THEN 'list' WHEN 4 THEN 'quote' WHEN 5 THEN 'code' ELSE 'body' END AS kind FROM l)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: line i becomes a heading, prose, a nested list item, a quote, a code block or prose."""
    bare = F.split("text", "\n")
    line = lambda x, i: (
        F.when(i % 6 == 0, F.concat(F.lit("## "), x)).when(i % 6 == 2, F.concat(F.lit("  - "), x)).when(i % 6 == 3, F.concat(F.lit("> "), x))
        .when(i % 6 == 4, F.concat(F.lit("```py\n"), x, F.lit("\n```"))).otherwise(F.concat(F.lit("word "), x))
    )
    return documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", F.array_join(F.transform(bare, line), "\n").alias("md"))


@register(f"""WITH {MARKED} SELECT doc_id, count(*) FILTER (kind = 'heading') AS headings, 0::BIGINT AS deep_headings, count(*) FILTER (kind = 'list') AS list_items, count(*) FILTER (kind = 'list') AS nested_items, 0::BIGINT AS ordered_items, 0::BIGINT AS table_rows,
 count(*) FILTER (kind = 'quote') AS quote_lines, 3 * count(*) FILTER (kind = 'code') AS code_lines, count(*) FILTER (kind = 'body') AS body_lines, count(*) FILTER (kind = 'quote') AS quote_blocks,
 (count(*) FILTER (i % 6 = 2) + (SELECT 0)) AS paragraphs FROM k GROUP BY doc_id""")
def markdown_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = markdown.line_table(marked(spark, sf_dir), "doc_id", "md")
    return markdown.structure(lines).withColumnRenamed("key", "doc_id")


@register(f"""WITH {MARKED} SELECT source, count(*) FILTER (kind = 'code') AS blocks, round(median(length(line)) FILTER (kind = 'code'), 6) AS median_chars, round(100.0 * count(DISTINCT doc_id) FILTER (kind = 'code') / count(DISTINCT doc_id), 6) AS with_code_pct FROM k GROUP BY 1""")
def code_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir)
    blocks = markdown.code_blocks(markdown.line_table(rows, "doc_id", "md")).join(rows.select(F.col("doc_id").alias("key"), "source"), "key")
    found = blocks.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.median("n_chars").alias("median_chars"), F.countDistinct("key").alias("with_code"))
    whole = rows.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    out = whole.join(found, "source", "left").withColumn("blocks", F.coalesce("blocks", F.lit(0))).withColumn("with_code_pct", 100.0 * F.coalesce("with_code", F.lit(0)) / F.col("docs"))
    return rounded(out.select("source", "blocks", "median_chars", "with_code_pct"), "median_chars", "with_code_pct")


@register(f"""WITH {MARKED}, q AS (SELECT doc_id, source, CASE WHEN regexp_matches(substr(line, 1, 80), '^(Q|A)\\s*:') THEN 'dialogue' WHEN regexp_matches(lower(substr(line, 1, 80)), 'error|exception|failed') THEN 'error' WHEN regexp_matches(substr(line, 1, 80), 'https?://') THEN 'sourced' WHEN length(line) > 20 THEN 'foreign' ELSE 'plain' END AS quote_kind FROM k WHERE kind = 'quote')
SELECT quote_kind, count(*) AS blocks, count(DISTINCT doc_id) AS articles FROM q GROUP BY 1""")
def quote_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = markdown.line_table(marked(spark, sf_dir), "doc_id", "md").where("kind = 'quote'")
    block = lines.groupBy("key", "block").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("pos", F.regexp_replace("line", "^\\s*> ?", "").alias("t")))), lambda x: x["t"])).alias("b"))
    head = F.substring("b", 1, 80)
    kind = F.when(head.rlike(r"^(Q|A)\s*:"), "dialogue").when(F.lower(head).rlike("error|exception|failed"), "error").when(head.rlike("https?://"), "sourced").when(F.length("b") > 20, "foreign").otherwise("plain")
    return block.groupBy(kind.alias("quote_kind")).agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("key").alias("articles"))


FEATURES = {"bold": r"\*\*[^*\n]+\*\*", "symbols": "[#$%&]", "digits": "[0-9]"}
_F = ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in FEATURES.items())


@register(f"""WITH f AS (SELECT doc_id, n_chars, {_F} FROM documents), u AS ({' UNION ALL '.join(f"SELECT '{n}' AS feature, {n} AS has, n_chars FROM f" for n in FEATURES)})
SELECT feature, has, count(*) AS n, round(median(n_chars), 6) AS median_chars FROM u GROUP BY 1, 2""")
def split_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("text").rlike(p).alias("has")) for n, p in FEATURES.items()]))
    rows = documents(spark, sf_dir, "text", "n_chars").select("n_chars", cells.alias("z"))
    return rounded(rows.groupBy("z.feature", "z.has").agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_chars")), "median_chars")


@register(f"""WITH f AS (SELECT doc_id, n_chars, {_F} FROM documents), d AS (SELECT bold::INT + symbols::INT + digits::INT AS decorations, n_chars, doc_id FROM f)
SELECT decorations, count(*) AS n, round(median(n_chars), 6) AS median_chars, round(avg(quality), 6) AS quality FROM d LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def decoration_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum((F.col("text").rlike(p).cast("int") for p in FEATURES.values()), F.lit(0))
    rows = documents(spark, sf_dir, "doc_id", "text", "n_chars").select("doc_id", "n_chars", total.alias("decorations")).join(table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    return rounded(rows.groupBy("decorations").agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_chars"), F.avg("quality").alias("quality")), "median_chars", "quality")


@register("""SELECT 'flagged' AS part, count(*) AS n, round(median(n_chars), 6) AS median_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL
SELECT 'unflagged', count(*), round(median(n_chars), 6) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def flag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, flags = documents(spark, sf_dir, "doc_id", "n_chars"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    part = lambda name, how: docs.join(flags, "doc_id", how).agg(F.count(F.lit(1)).alias("n"), F.median("n_chars").alias("median_chars")).select(F.lit(name).alias("part"), "n", "median_chars")
    return rounded(part("flagged", "left_semi").unionByName(part("unflagged", "left_anti")), "median_chars")


@register("""WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), d AS (SELECT epoch(date_trunc('second', nxt))::BIGINT - epoch(date_trunc('second', ts))::BIGINT AS s FROM e WHERE nxt IS NOT NULL)
SELECT CASE WHEN s = 0 THEN 'same' WHEN s < 3600 THEN 'quick' ELSE 'later' END AS delay, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM d GROUP BY 1""")
def edit_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id").withColumn("nxt", later).where("nxt is not null")
    found = rows.groupBy(T.edit_delay(F.col("ts"), F.col("nxt")).alias("delay")).agg(F.count(F.lit(1)).alias("n"))
    whole = found.agg(F.sum("n").alias("whole"))
    return rounded(found.crossJoin(F.broadcast(whole)).select("delay", "n", (100.0 * F.col("n") / F.col("whole")).alias("pct")), "pct")


@register("""WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderdate::DATE AS day, count(*) AS fetched FROM orders GROUP BY 1, 2), a AS (SELECT month, count(*) AS done, sum(fetched)::BIGINT AS fetched FROM d WHERE fetched >= 2 GROUP BY 1),
s AS (SELECT unnest(generate_series(DATE '1994-12-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS m)
SELECT strftime(m, '%Y-%m') AS month, coalesce(done, 0) AS done, day(last_day(m))::INT AS days, coalesce(fetched, 0) AS fetched, CASE WHEN done IS NULL THEN 'missing' WHEN done = day(last_day(m)) THEN 'complete' ELSE 'partial' END AS state FROM s LEFT JOIN a ON a.month = strftime(m, '%Y-%m')""")
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.ingest import expected_months, manifest_rollup

    days = table(spark, sf_dir, "orders", "o_orderdate").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("fetched")).withColumn("complete", F.col("fetched") >= 2)
    return manifest_rollup(days, expected_months(spark, "1994-12", "2001-12"))


@register("""SELECT o_orderkey AS job FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def job_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("job"))
    return jobs.join(table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job")), "job", "left_anti")


TURNS = """t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS before, list_distinct(regexp_extract_all(lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)), '[a-z]{4,}')) AS after, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{4,})"), F.lit(1)))
    o = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lead("text").over(o).alias("nxt"))
    return rows.where("nxt is not null and text is not null").select("conv_id", "turn", found(F.col("text")).alias("before"), found(F.col("nxt")).alias("after"))


@register(f"""WITH {TURNS}, x AS (SELECT conv_id, turn, unnest(before) AS word, after FROM t WHERE nxt IS NOT NULL) SELECT word, count(*) AS seen, count(*) FILTER (list_contains(after, word)) AS stayed, round(100.0 * count(*) FILTER (list_contains(after, word)) / count(*), 6) AS survival_pct FROM x GROUP BY 1 HAVING count(*) >= 5""")
def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a word of a text is still there in the next one (before and after a rewrite)."""
    each = turns(spark, sf_dir).select(F.explode("before").alias("word"), "after").withColumn("stays", F.array_contains("after", F.col("word")))
    out = each.groupBy("word").agg(F.count(F.lit(1)).alias("seen"), F.count_if("stays").alias("stayed")).where("seen >= 5")
    return rounded(out.withColumn("survival_pct", 100.0 * F.col("stayed") / F.col("seen")), "survival_pct")


@register(f"""WITH {TURNS}, x AS (SELECT conv_id, turn, list_filter(before, lambda x: NOT list_contains(after, x)) AS lost, list_filter(after, lambda x: NOT list_contains(before, x)) AS gained FROM t WHERE nxt IS NOT NULL),
l AS (SELECT conv_id, turn, unnest(lost) AS a FROM x), g AS (SELECT conv_id, turn, unnest(gained) AS b FROM x), p AS (SELECT a, b FROM l JOIN g USING (conv_id, turn) WHERE substr(a, 1, 3) = substr(b, 1, 3))
SELECT a AS lost, b AS gained, count(*) AS n FROM p GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 30""")
def replacement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: words of one concept that went, with those of it that came in the same rewrite."""
    from ..operators import rewrite

    rows = turns(spark, sf_dir).select(F.array_except("before", "after").alias("lost"), F.array_except("after", "before").alias("gained"))
    every = rows.select(F.explode(F.concat("lost", "gained")).alias("word")).distinct()
    concepts = every.withColumn("concept", F.substring("word", 1, 3))  # words that begin alike stand for a concept
    return rewrite.replacements(rows, concepts).orderBy(F.desc("n"), "lost", "gained").limit(30)


METRICS = {"n_chars": "two", "commas": "high", "capitals": "low"}
MSQL = """m AS (SELECT doc_id, lang, n_chars::DOUBLE AS n_chars, len(regexp_extract_all(text, ',')) * 1000.0 / nullif(length(text), 0) AS commas, len(regexp_extract_all(text, '[A-Z]')) * 1000.0 / nullif(length(text), 0) AS capitals FROM documents),
u AS (SELECT doc_id, lang, 'n_chars' AS metric, 'two' AS direction, n_chars AS x FROM m UNION ALL SELECT doc_id, lang, 'commas', 'high', commas FROM m UNION ALL SELECT doc_id, lang, 'capitals', 'low', capitals FROM m),
r AS (SELECT metric, direction, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.9) AS p90, avg((x = 0)::INT) AS zero_ratio FROM u WHERE lang = 'en' GROUP BY 1, 2)"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.nullif(F.length("text"), F.lit(0))
    rate = lambda p: T.count_of(F.col("text"), p) * 1000.0 / n
    return documents(spark, sf_dir, "doc_id", "lang", "text", "n_chars").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"), rate(",").alias("commas"), rate("[A-Z]").alias("capitals"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.profile(measures(spark, sf_dir).where("lang = 'en'"), METRICS)


@register(f"WITH {MSQL} SELECT metric, direction, round(p10, 6) AS p10, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(zero_ratio, 6) AS zero_ratio FROM r")
def profile_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reference(spark, sf_dir), "p10", "p25", "p50", "p75", "p90", "zero_ratio")


@register(f"WITH {MSQL} SELECT lang, metric, count(*) AS n, round(100 * avg((x > p90)::INT), 6) AS above_pct, round(100 * avg((x < p10)::INT), 6) AS below_pct FROM u JOIN r USING (metric) WHERE lang <> 'en' GROUP BY 1, 2")
def exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS]))
    long = measures(spark, sf_dir).where("lang <> 'en'").select("lang", cells.alias("z")).select("lang", "z.*").join(F.broadcast(reference(spark, sf_dir)), "metric")
    pct = lambda c: 100 * F.avg(c.cast("int"))
    return rounded(long.groupBy("lang", "metric").agg(F.count(F.lit(1)).alias("n"), pct(F.col("x") > F.col("p90")).alias("above_pct"), pct(F.col("x") < F.col("p10")).alias("below_pct")), "above_pct", "below_pct")


@register(f"""WITH {MSQL}, q AS (SELECT doc_id, metric, direction, x, CASE WHEN x <= p10 THEN least(10, CASE WHEN p10 = 0 THEN 0 ELSE greatest(0, 10 * x / p10) END) WHEN x >= p90 THEN 95
 WHEN x <= p25 THEN CASE WHEN p25 = p10 THEN 10 ELSE 10 + (x - p10) / (p25 - p10) * 15 END WHEN x <= p50 THEN CASE WHEN p50 = p25 THEN 25 ELSE 25 + (x - p25) / (p50 - p25) * 25 END
 WHEN x <= p75 THEN CASE WHEN p75 = p50 THEN 50 ELSE 50 + (x - p50) / (p75 - p50) * 25 END ELSE CASE WHEN p90 = p75 THEN 75 ELSE 75 + (x - p75) / (p90 - p75) * 15 END END AS p FROM u JOIN r USING (metric, direction) WHERE x IS NOT NULL),
d AS (SELECT doc_id, p, CASE direction WHEN 'low' THEN greatest(0, 50 - p) / 50 WHEN 'high' THEN greatest(0, p - 50) / 50 ELSE abs(p - 50) / 50 END AS dev FROM q)
SELECT doc_id, count(*) AS metrics, round(avg(p), 5) AS mean_percentile, round(avg(dev), 5) AS overall FROM d GROUP BY 1""")
def style_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lint.scored(measures(spark, sf_dir), "doc_id", reference(spark, sf_dir), list(METRICS)).where("value is not null")
    return rounded(found.groupBy(F.col("key").alias("doc_id")).agg(F.count(F.lit(1)).alias("metrics"), F.avg("percentile").alias("mean_percentile"), F.avg("deviation").alias("overall")), "mean_percentile", "overall", to=5)


PHRASES = {"of the": r"\bof the\b", "doubled": r"\bthe the\b"}


@register(f"""WITH {SENTS}, m AS (SELECT doc_id, text, list_transform(sents, lambda x: {LEN}::DOUBLE) AS ls, length(regexp_replace(text, '\\s', '', 'g')) AS chars, len(regexp_extract_all(text, ',')) / nullif(len(sents), 0) AS ten FROM s WHERE len(sents) >= 10),
f AS (SELECT doc_id, 'ten' AS rule, 'above' AS message, ten AS v, ten > 1.65 AS hit FROM m UNION ALL SELECT doc_id, 'bold', 'above', len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) / nullif(chars, 0) * 1000, len(regexp_extract_all(text, '\\*\\*[^*\\n]+\\*\\*')) / nullif(chars, 0) * 1000 > 13 FROM m
 UNION ALL SELECT doc_id, 'burstiness', 'below', (list_stddev_pop(ls) - list_avg(ls)) / nullif(list_stddev_pop(ls) + list_avg(ls), 0), (list_stddev_pop(ls) - list_avg(ls)) / nullif(list_stddev_pop(ls) + list_avg(ls), 0) < -0.45 FROM m
 UNION ALL SELECT doc_id, 'cv', 'below', list_stddev_pop(ls) / nullif(list_avg(ls), 0), list_stddev_pop(ls) / nullif(list_avg(ls), 0) < 0.38 FROM m
 UNION ALL SELECT doc_id, 'kanji', 'above', len(regexp_extract_all(text, '[A-Z]')) / nullif(chars, 0), len(regexp_extract_all(text, '[A-Z]')) / nullif(chars, 0) > 0.305 FROM m
 UNION ALL SELECT doc_id, 'phrase', 'of the', len(regexp_extract_all(text, '\\bof the\\b')), len(regexp_extract_all(text, '\\bof the\\b')) >= 2 FROM m UNION ALL SELECT doc_id, 'phrase', 'doubled', len(regexp_extract_all(text, '\\bthe the\\b')), len(regexp_extract_all(text, '\\bthe the\\b')) >= 2 FROM m)
SELECT doc_id, rule, message, round(v, 5) AS value FROM f WHERE hit""")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lint.findings(documents(spark, sf_dir, "doc_id", "text"), "text", LATIN, phrases=PHRASES)
    return rounded(lint.found(rows, "doc_id").select("doc_id", "rule", "message", "value"), "value", to=5)


FIXES = (("\\bthe the\\b", "the"), (" ,", ","), ("([a-z]),([a-z])", "$1, $2"), ("\\*{3}", ""))


@register("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bthe the\\b', 'the', 'g'), ' ,', ',', 'g'), '([a-z]),([a-z])', '\\1, \\2', 'g'), '\\*{3}', '', 'g')) AS fixed FROM documents""")
def autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(lint.autofix(F.col("text"), FIXES)).alias("fixed"))


@register("""WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS ws FROM benchmark), w AS (SELECT DISTINCT unnest(ws) AS word FROM b), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS word FROM documents)
SELECT word, count(*) AS articles FROM d JOIN w USING (word) GROUP BY 1""")
def lexicon_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each word that a lexicon shares with the corpus."""
    found = lambda df, *k: df.select(*k, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))).alias("word"))
    lexicon = found(table(spark, sf_dir, "benchmark", "text")).distinct()
    return found(documents(spark, sf_dir, "doc_id", "text"), "doc_id").join(lexicon, "word").groupBy("word").agg(F.count(F.lit(1)).alias("articles"))


@register("""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, '[0-9]+')) AS a, list_distinct(regexp_extract_all(regexp_replace(text, '[0-9]{7,}', '', 'g'), '[0-9]+')) AS b FROM documents)
SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS lost_numbers FROM d""")
def number_tokens_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a text that a rewrite lost; the rewrite here drops long digit runs."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))
    text = F.col("text")
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.size(F.array_except(numbers(text), numbers(F.regexp_replace(text, "[0-9]{7,}", "")))).alias("lost_numbers"))


@register(f"""WITH {WORDS}, a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM benchmark), b AS (SELECT DISTINCT source, word FROM w)
SELECT source, (SELECT count(*) FROM a) AS lexicon, count(*) AS words, count(a.word) AS both FROM b LEFT JOIN a USING (word) GROUP BY 1""")
def lexicon_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a lexicon, of each source's set of words, and of what they share."""
    lexicon = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    own = words(spark, sf_dir).select("source", "word").distinct()
    each = own.join(lexicon.withColumn("known", F.lit(1)), "word", "left").groupBy("source").agg(F.count(F.lit(1)).alias("words"), F.count("known").alias("both"))
    return each.crossJoin(F.broadcast(lexicon.agg(F.count(F.lit(1)).alias("lexicon")))).select("source", "lexicon", "words", "both")  # one row


@register("""WITH d AS (SELECT source, regexp_extract_all(text, '[A-Za-z]{5,}') AS coded, regexp_replace(text, '[A-Za-z]{5,}', ' ', 'g') AS rest, length(text) + 2 * len(regexp_extract_all(text, '[A-Za-z]{5,}')) AS chars FROM documents)
SELECT source, count(*) AS n, sum(len(coded))::BIGINT AS inside, sum(len(regexp_extract_all(rest, '[A-Za-z][A-Za-z0-9_.-]*')))::BIGINT AS outside, round(avg(len(coded) / nullif(chars, 0) * 1000), 6) AS code_per_1k FROM d GROUP BY 1""")
def code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English words inside of inline code against those outside; a rule makes each word of five letters inline code."""
    rows = documents(spark, sf_dir, "source", "text").select("source", F.regexp_replace("text", "[A-Za-z]{5,}", "`$0`").alias("md"))
    inside, outside = T.code_words(F.col("md"))
    each = rows.select("source", inside.alias("i"), outside.alias("o"), T.per_thousand(T.count_of(F.col("md"), R.INLINE_CODE), F.length("md")).alias("c"))
    return rounded(each.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("i").cast("long").alias("inside"), F.sum("o").cast("long").alias("outside"), F.avg("c").alias("code_per_1k")), "code_per_1k")
