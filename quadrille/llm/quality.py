"""Operator 7: a quality classifier that is a sparse ensemble of rules.

Statistics of each text (shares of kinds of characters, word and line repetition, words that mark a label) feed shallow trees; every
path of a tree is a conjunctive rule, a lasso logistic regression keeps few of them, and these become one Spark column expression.
There is a head for quality and one for toxicity; a document is kept if it passes both. The models are fitted on at most SAMPLE
labelled documents, chosen by a hash of doc_id; every document is scored. The sample is dealt to three parts: words that mark a label
are looked for in two parts and told of the third, rules and weights are fitted on two, and the threshold is set on the one that
they haven't seen.

Defined results. A null text has null scores and is rejected; an empty one is scored by its statistics, all 0. Repeated rows score
alike; a null doc_id is scored like any other, but is never a training row. Of several labels of a document the lowest quality and
the highest toxicity count. Without training rows of both kinds, or with too few for a rule, a head passes everything (score 1, or 0 for toxicity). Texts of
any length are measured whole. Other columns pass through the stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE_VALUES, bound_batches, folded_words, joined, mixed, signed, span_hashes, spans, steps
from ._bpe import NONE, Table

#: Bound of the training sample, in labelled documents.
SAMPLE = 12_000
#: Share of clean labelled documents that a threshold may cost.
CLEAN_LOSS = 0.005
TREES = 24
DEPTH = 3
PARTS = 3

_GROUPS = {"upper": range(65, 91), "digit": range(48, 58), "blank": (9, 32), "line": (10, 13), "mark": b".,;:?'\"-()", "shout": b"!", "pipe": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "control": [*range(9), 11, 12, *range(14, 32), 127], "wide": range(128, 256)}
STATISTICS = ("bytes", *(f"{g}_share" for g in _GROUPS), "words", "word_bytes", "word_variety", "line_variety", "poor_words", "toxic_words")
_KIND = np.full(256, len(_GROUPS), np.int64)
for _i, _bytes in enumerate(_GROUPS.values()):
    _KIND[list(_bytes)] = _i


def _variety(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys a document over all its keys; 1 without any."""
    total = np.bincount(doc, minlength=n)
    both = keys ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(both, return_index=True)
    return np.bincount(doc[first], minlength=n) / np.maximum(total, 1) + (total == 0)


def measure(texts: pa.Array, poor: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    data, offsets = joined(texts)
    n = len(texts)
    out = np.zeros((n, len(STATISTICS)))
    if not n:
        return out
    size = np.diff(offsets) - 1
    doc_of_byte = np.repeat(np.arange(n), size + 1)
    kinds = np.bincount(doc_of_byte * (len(_GROUPS) + 1) + _KIND[data], minlength=n * (len(_GROUPS) + 1)).reshape(n, -1)[:, :-1].astype(float)
    kinds[:, list(_GROUPS).index("line")] -= 1  # the one that joined() adds
    out[:, 0] = size
    out[:, 1 : 1 + len(_GROUPS)] = kinds / np.maximum(size, 1)[:, None]
    starts, ends, words = folded_words(data)
    doc = doc_of_byte[starts]
    count = np.bincount(doc, minlength=n)
    at = 1 + len(_GROUPS)
    out[:, at] = count
    out[:, at + 1] = np.bincount(doc, ends - starts, n) / np.maximum(count, 1)
    out[:, at + 2] = _variety(doc, words, n)
    a, z = spans(data != 10)
    out[:, at + 3] = _variety(doc_of_byte[a], span_hashes(BYTE_VALUES[0][data], a, z), n)
    for k, lexicon in ((4, poor), (5, toxic)):
        if len(lexicon):
            hit = Table(lexicon, np.ones(len(lexicon), np.int32)).get(words) != NONE
            out[:, at + k] = np.bincount(doc, hit, n) / np.maximum(count, 1)
    return out


def _measured(poor: np.ndarray, toxic: np.ndarray):
    kind = pa.struct([(s, pa.float64()) for s in STATISTICS])

    @F.arrow_udf(", ".join(f"{s} double" for s in STATISTICS))
    def statistics(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        rows = [measure(b.column("text"), poor, toxic) for b in steps(iter([batch]))]
        table = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
        return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATISTICS))], fields=list(kind))

    return statistics


@dataclass
class Head:
    """Rules (conjunctions of (statistic, is_above, cut)), their weights, and the score from which on it says yes."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    bias: float
    threshold: float

    def column(self, statistics: Column) -> Column:
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            test = F.lit(True)
            for i, above, cut in rule:
                c = statistics.getField(STATISTICS[i])
                test = test & ((c > cut) if above else (c <= cut))
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, cut in rule:
        out &= (x[:, i] > cut) == above
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list:
    """All paths of TREES trees, each over half of the rows and of the statistics."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, 33)[:-1])) for i in range(x.shape[1])]
    rules: dict = {}

    def split(rows: np.ndarray, columns: np.ndarray, path: tuple) -> None:
        if path:
            rules[tuple(sorted(path))] = True
        if len(path) == DEPTH or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best = (1e-9, -1, 0.0)
        total, ones = len(rows), y[rows].sum()
        base = ones * (total - ones) / total
        for i in columns:
            bins = np.searchsorted(cuts[i], x[rows, i], side="left")
            n = np.cumsum(np.bincount(bins, minlength=len(cuts[i]) + 1))[:-1]
            p = np.cumsum(np.bincount(bins, y[rows], len(cuts[i]) + 1))[:-1]
            ok = (n >= 8) & (total - n >= 8)
            if ok.any():
                n, p = n[ok], p[ok]
                gain = base - p * (n - p) / n - (ones - p) * (total - n - ones + p) / (total - n)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], i, cuts[i][ok][k])
        if best[1] >= 0:
            _, i, cut = best
            above = x[rows, i] > cut
            split(rows[~above], columns, (*path, (int(i), False, float(cut))))
            split(rows[above], columns, (*path, (int(i), True, float(cut))))

    for _ in range(TREES):
        split(rng.choice(len(x), max(1, len(x) // 2), replace=False), rng.permutation(x.shape[1])[: 1 + x.shape[1] // 2], ())
    return list(rules)


def fit_head(x: np.ndarray, y: np.ndarray, clean: np.ndarray, clean_is: int, held: np.ndarray, lasso: float = 2e-3) -> Head:
    """y: 0 or 1; clean: the rows of which at most CLEAN_LOSS may end on the wrong side; clean_is: their y; held: rows that only the
    threshold sees."""
    judged = x[held & clean]
    x, y, clean = x[~held], y[~held], clean[~held]
    if len(y) == 0 or y.min() == y.max():
        return Head([], [], 20.0 if clean_is else -20.0, 0.5)
    rules = grow_rules(x, y, np.random.Generator(np.random.PCG64(11)))
    if not rules:  # too few rows for a single one
        return Head([], [], 20.0 if clean_is else -20.0, 0.5)
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(np.float64)
    _, first = np.unique(r, axis=1, return_index=True)
    first = np.sort(first)
    rules, r = [rules[i] for i in first], r[:, first]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    mean = r.mean(0)
    z = r - mean
    step = 4 / max(1e-9, np.linalg.norm(z * np.sqrt(balance)[:, None], 2) ** 2 + balance.sum())
    w, b = np.zeros(r.shape[1]), 0.0
    v, vb, t = w, b, 1.0
    for _ in range(300):  # proximal gradient with momentum
        g = (1 / (1 + np.exp(-(z @ v + vb))) - y) * balance
        nw = v - step * (z.T @ g)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * lasso, 0)
        nb = vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nw, nb, nt
    on = np.flatnonzero(np.abs(w) > 1e-6)
    bias = float(b - mean[on] @ w[on])
    score = 1 / (1 + np.exp(-(r[:, on] @ w[on] + bias)))
    if len(judged):
        seen = np.stack([holds(rules[i], judged) for i in on], 1).astype(np.float64) if len(on) else np.zeros((len(judged), 0))
        side = 1 / (1 + np.exp(-(seen @ w[on] + bias)))
    else:
        side = score[clean] if clean.any() else np.array([0.5])
    if clean_is:
        threshold = min(0.5, float(np.quantile(side, CLEAN_LOSS, method="lower")))
    else:
        threshold = max(0.5, float(np.quantile(side, 1 - CLEAN_LOSS, method="higher")) + 1e-9)
    return Head([rules[i] for i in on], [float(w[i]) for i in on], bias, threshold)


def lexicon(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashes of all words whose presence speaks clearly for y = 1."""
    if y.sum() < 5 or y.sum() > len(y) - 5:
        return np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    vocabulary, which = np.unique(np.concatenate(words), return_inverse=True)
    yes, no = np.bincount(which, y[doc], len(vocabulary)), np.bincount(which, 1 - y[doc], len(vocabulary))
    odds = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((no + 0.5) / (len(y) - y.sum() + 1))
    # the least that the odds may be, two standard errors down
    least = odds - 2 * np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    return vocabulary[(least > 1.6) & (50 * no <= yes)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Head, Head, np.ndarray, np.ndarray]:
    """The heads of quality and toxicity, and the lexicons that the statistics need."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    have = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")

    @F.arrow_udf("array<bigint>")
    def present(texts: pa.Array) -> pa.Array:
        out = []
        for b in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            data, offsets = joined(b.column("text"))
            starts, _, words = folded_words(data)
            cut = np.searchsorted(starts, offsets)
            out += [signed(np.unique(words[i:j])) for i, j in zip(cut[:-1], cut[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    none = np.zeros(0, np.uint64)
    got = have.join(F.broadcast(chosen), have["_id"] == chosen["doc_id"]).select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"), _measured(none, none)("text").alias("s"), present("text").alias("w")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got = got.take(pa.array(order))
    x = np.stack([c.to_numpy() for c in got.column("s").combine_chunks().flatten()], 1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    q, t = got.column("quality").to_numpy().astype(float), got.column("toxic").to_numpy().astype(float)
    held = got.column("w").combine_chunks()
    flat, ends = held.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy().astype(np.int64))))
    w = [flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
    poor, toxic = lexicon(w, 1 - q), lexicon(w, t)
    part = (mixed(got.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(PARTS)).astype(np.int64)
    for k, y in (("poor_words", 1 - q), ("toxic_words", t)):
        # whether a text has such a word is told by what the other parts have taught
        for p in range(PARTS):
            own, rest = np.flatnonzero(part == p), np.flatnonzero(part != p)
            words = lexicon([w[i] for i in rest], y[rest]) if len(rest) else np.zeros(0, np.uint64)
            x[own, STATISTICS.index(k)] = [np.isin(w[i], words).any() for i in own] if len(words) else 0
    clean = (q == 1) & (t == 0)
    held = part == PARTS - 1
    return fit_head(x, q, clean, 1, held), fit_head(x, t, clean, 0, held), poor, toxic


def scored(docs: DataFrame, labels: DataFrame, name: str = "_quality") -> DataFrame:
    """docs with a struct column: quality_score, toxic_score, keep."""
    bound_batches(docs.sparkSession)
    quality, toxicity, poor, toxic = fit(docs, labels)
    own = docs.withColumn(name + "_s", _measured(poor, toxic)(F.col("text").cast("string")))
    s = F.col(name + "_s")
    for k in ("poor_words", "toxic_words"):
        s = s.withField(k, F.when(F.col(name + "_s").getField(k) > 0, 1.0).otherwise(0.0))
    own = own.withColumn(name + "_s", s)
    s = F.col(name + "_s")
    q, t = F.when(F.col("text").isNotNull(), quality.column(s)), F.when(F.col("text").isNotNull(), toxicity.column(s))
    own = own.withColumn(name, F.struct(q.alias("quality_score"), t.alias("toxic_score"))).drop(name + "_s")
    s = F.col(name)
    return own.withColumn(name, s.withField("keep", F.coalesce((s["quality_score"] >= quality.threshold) & (s["toxic_score"] < toxicity.threshold), F.lit(False))))


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    name = "_quality"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name).where(f"`{name}`.keep").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the scores, and keep, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "_quality.quality_score", "_quality.toxic_score", "_quality.keep")
