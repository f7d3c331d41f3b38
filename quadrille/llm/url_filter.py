"""Operator 8: a URL filter by the ratio of two character language models.

Two variable-order Markov models, for accepted and for rejected URLs, are counted over all URLs: seeds of the rejected ones are URLs
whose host has a term of a block list as a part of its own; all others count as accepted. The probability of a character is that of the longest context,
smoothed recursively by the shorter ones (weight SMOOTH). A URL is scored by the difference of the log-likelihoods over its length.
Hosts are dealt to FOLDS folds by a hash, and each fold is scored by models of all the others, so no URL vouches for itself and a
host without any listed term is rejected if it reads like listed ones. The cut-off is calibrated over all URLs: of the scores, in
hundredths, below which at most CLEAN_LOSS of the URLs that aren't listed lie, the one that best tells the seeds from the rest. A
URL is kept if it isn't listed and its score is not below the cut-off.

Because every URL is padded, all counts follow from those of the ORDER + 1 characters at each place; the models are worked out over
these distinct strings alone and joined back.

Defined results. A null URL has a null score and isn't kept; an empty one is scored by its end alone. Repeated rows count and score
each. No URL is cut. Ties between cut-offs: the lowest. With no rejected URL at all (or no accepted one) nothing is scored (score 0), and all that isn't listed is kept. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import small, written

ORDER = 4
SMOOTH = 2.0
ALPHABET = 128
FOLDS = 8
#: Share of the URLs that aren't listed which the cut-off may cost.
CLEAN_LOSS = 0.01
BLOCKED = ("casino", "bets", "pills", "spam", "adult", "ads-track")

#: Counts and probabilities: of accepted (a) and rejected (r) URLs, as each fold is scored with them.
_MODELS = [f"{m}{f}" for f in range(FOLDS) for m in "ar"]


def listed(blocked: tuple[str, ...]) -> str:
    """Hosts with one of these terms between what isn't a letter."""
    return f"(^|[^a-z])({'|'.join(blocked)})([^a-z]|$)"


def url_scores(pages: DataFrame, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, url, is_seed (its host is listed), score_micro (a millionth of a nat a character), keep."""
    at = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z]+://)?([^/]*)", 1)
    at = at.withColumn("is_seed", host.rlike(listed(blocked))).withColumn("fold", ((F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(host), 1, 1)) - 1) % FOLDS).cast("int"))
    named = at.where("url IS NOT NULL").groupBy("url", "is_seed", "fold").agg(F.count("*").alias("n"))
    named = written(named.withColumn("s", F.concat(F.lit("\x01" * ORDER), F.regexp_replace(F.lower("url"), "^[a-z]+://", ""), F.lit("\x02"))), "urls")
    grams = named.select("url", "n", "is_seed", "fold", F.explode(F.expr(f"transform(sequence(1, length(s) - {ORDER}), i -> substr(s, i, {ORDER + 1}))")).alias("g"))
    own = lambda c: F.sum(F.when((F.col("is_seed") == (c[0] == "r")) & (F.col("fold") != int(c[1])), F.col("n")).otherwise(0)).alias(c)
    per = written(grams.groupBy("g").agg(*map(own, _MODELS)), "grams")
    model = per.select("g", *(F.lit(1.0 / ALPHABET).alias(f"p{m}") for m in _MODELS))
    for k in range(ORDER + 1):
        pair = per.groupBy(F.substring("g", ORDER + 1 - k, k + 1).alias("x")).agg(*(F.sum(m).alias(f"x{m}") for m in _MODELS))
        pair = written(pair.withColumn("c", F.expr(f"substr(x, 1, {k})")), "pairs")
        context = pair.groupBy("c").agg(*(F.sum(f"x{m}").alias(f"c{m}") for m in _MODELS))
        rated = pair.join(small(context, 32 + 16 * FOLDS), "c").drop("c")
        model = model.withColumn("x", F.substring("g", ORDER + 1 - k, k + 1)).join(rated, "x").select("g", *(((F.col(f"x{m}") + SMOOTH * F.col(f"p{m}")) / (F.col(f"c{m}") + SMOOTH)).alias(f"p{m}") for m in _MODELS))
    model = written(model.select(F.col("g").alias("mg"), F.array(*(F.log(f"pa{f}") - F.log(f"pr{f}") for f in range(FOLDS))).alias("d")), "url-model")
    scored = grams.join(small(model, 64 + 8 * FOLDS), F.col("g") == F.col("mg")).groupBy("url").agg(F.first("n").alias("n"), F.first("is_seed").alias("is_seed"), (F.sum(F.get("d", F.col("fold"))) / F.count("*")).alias("score"))
    scored = written(scored, "url-scores")
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("bin")).agg(F.sum(F.when(F.col("is_seed"), 0).otherwise(F.col("n"))).alias("a"), F.sum(F.when(F.col("is_seed"), F.col("n")).otherwise(0)).alias("r"))
    # few rows: one a hundredth of a nat
    over, every = Window.orderBy(F.col("bin").desc()), Window.partitionBy()
    gain = F.try_divide(F.sum("a").over(over), F.sum("a").over(every)) - F.try_divide(F.sum("r").over(over), F.sum("r").over(every))
    # the share of what isn't listed that lies below
    lost = F.try_divide(F.sum("a").over(every) - F.sum("a").over(over), F.sum("a").over(every))
    best = bins.withColumn("gain", F.when(F.round(lost, 9) <= CLEAN_LOSS, F.round(gain, 9))).agg(F.max_by("bin", F.struct(F.col("gain"), -F.col("bin"))).alias("cut"), F.sum("a").alias("ta"), F.sum("r").alias("tr")).select(F.when((F.col("ta") > 0) & (F.col("tr") > 0), F.col("cut")).alias("cut"))
    known = scored.select(F.col("url").alias("_u"), "score").crossJoin(F.broadcast(best))
    out = at.join(known, F.col("url") == F.col("_u"), "left")
    score = F.when(F.col("url").isNotNull(), F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.floor(F.col("score") * 1000000)))
    return out.select("page_id", "url", F.coalesce("is_seed", F.lit(False)).alias("is_seed"), score.cast("bigint").alias("score_micro"), F.when(F.col("url").isNull() | F.col("is_seed"), F.lit(False)).otherwise(F.col("cut").isNull() | (F.floor(F.col("score") * 100) >= F.col("cut"))).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_scores(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    parts = []
    for k in range(ORDER + 1):
        sums = ", ".join(f"sum({m}) AS x{m}" for m in _MODELS)
        totals = ", ".join(f"sum(x{m}) AS c{m}" for m in _MODELS)
        rates = ", ".join(f"(x.x{m} + {SMOOTH}::DOUBLE * m.p{m}) / (c.c{m} + {SMOOTH}::DOUBLE) AS p{m}" for m in _MODELS)
        first = ", ".join(f"1.0::DOUBLE / {ALPHABET} AS p{m}" for m in _MODELS)
        parts.append(f"x{k} AS (SELECT substr(g, {ORDER + 1 - k}, {k + 1}) AS x, substr(g, {ORDER + 1 - k}, {k}) AS c, {sums} FROM per GROUP BY ALL)")
        parts.append(f"c{k} AS (SELECT c, {totals} FROM x{k} GROUP BY c)")
        before = f"m{k - 1}" if k else f"(SELECT g, {first} FROM per)"
        parts.append(f"m{k} AS (SELECT m.g, {rates} FROM {before} m JOIN x{k} x ON x.x = substr(m.g, {ORDER + 1 - k}, {k + 1}) JOIN c{k} c ON c.c = x.c)")
    counts = ", ".join(f"sum(CASE WHEN {'is_seed' if m[0] == 'r' else 'NOT is_seed'} AND fold <> {m[1]} THEN n ELSE 0 END)::DOUBLE AS {m}" for m in _MODELS)
    return f"""
WITH h AS (SELECT page_id, url, regexp_extract(lower(url), '^(?:[a-z]+://)?([^/]*)', 1) AS host FROM pages),
p AS (SELECT page_id, url, regexp_matches(host, '{listed(BLOCKED)}') AS is_seed, (instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1) % {FOLDS} AS fold FROM h),
named AS (SELECT url, is_seed, fold, count(*) AS n, repeat(chr(1), {ORDER}) || regexp_replace(lower(url), '^[a-z]+://', '') || chr(2) AS s FROM p WHERE url IS NOT NULL GROUP BY url, is_seed, fold),
grams AS (SELECT url, n, is_seed, fold, substr(s, i, {ORDER + 1}) AS g FROM (SELECT url, n, is_seed, fold, s, unnest(range(1, length(s) - {ORDER} + 1)) AS i FROM named)),
per AS (SELECT g, {counts} FROM grams GROUP BY g),
{", ".join(parts)},
scored AS (SELECT url, first(n) AS n, first(is_seed) AS is_seed, sum(CASE fold {" ".join(f"WHEN {f} THEN ln(pa{f}) - ln(pr{f})" for f in range(FOLDS))} END) / count(*) AS score FROM grams JOIN m{ORDER} USING (g) GROUP BY url),
bins AS (SELECT floor(score * 100)::BIGINT AS bin, sum(CASE WHEN is_seed THEN 0 ELSE n END)::DOUBLE AS a, sum(CASE WHEN is_seed THEN n ELSE 0 END)::DOUBLE AS r FROM scored GROUP BY 1),
gains AS (SELECT bin, round(sum(a) OVER (ORDER BY bin DESC) / sum(a) OVER () - sum(r) OVER (ORDER BY bin DESC) / sum(r) OVER (), 9) AS gain,
         round((sum(a) OVER () - sum(a) OVER (ORDER BY bin DESC)) / sum(a) OVER (), 9) AS lost FROM bins),
best AS (SELECT bin AS cut FROM gains WHERE lost <= {CLEAN_LOSS} ORDER BY gain DESC, bin LIMIT 1)
SELECT p.page_id, p.url, coalesce(p.is_seed, false) AS is_seed, floor(s.score * 1000000)::BIGINT AS score_micro,
       coalesce(NOT p.is_seed AND floor(s.score * 100) >= (SELECT cut FROM best), false) AS keep
FROM p LEFT JOIN scored s ON p.url = s.url"""


ORACLE = _oracle()
