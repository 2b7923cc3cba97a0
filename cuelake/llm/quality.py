"""Quality classifier with hierarchical empirical Bayes.

A document gets evidence from its own text: a logistic model over style measures and telling words,
fitted on labelled documents. Hosts and the paths below them get posteriors by grouped aggregation:
the mean evidence of a host is shrunk toward the global mean, that of a path toward its host, the
more the fewer documents there are and the less the groups differ. A document's odds are those of
its own evidence times the odds of its path against the global odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: At most so many labelled documents are fitted, those with the least hash of their id.
SAMPLE = 20_000
WORDS = 256
_STYLE = 10
#: Texts whose words are held at a time.
_AT_ONCE = 200
_SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_LETTER = re.compile(r"[^\W\d_]+")


def style_of(text: str) -> list[float]:
    """Measures of a whole text, each about between 0 and 1."""
    raw = text.encode()
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    upper = sum(x.isupper() and len(x) > 1 for x in words)
    marked = sum(not x[-1].isalnum() and x[-1] not in ".,;:?!\"')»" for x in words)
    return [
        (size - len(raw.translate(None, _SYMBOLS))) / size,
        (size - len(raw.translate(None, b"0123456789"))) / size,
        upper / n,
        marked / n,
        text.count("!") / n,
        text.count("|") / n,
        len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        min(len(text) / n, 20) / 20,
        min(np.log1p(n), 12) / 12,
    ]


#: Letters of a word's beginning that count as a word of their own: stems tell where endings vary.
STEMS = (5, 7)


def words_of(text: str) -> set[str]:
    """Distinct words of a text, and the beginnings of the longer ones with a hyphen."""
    words = set(_LETTER.findall(text.lower()))
    return words.union(*[{w[:k] + "-" for w in words if len(w) > k} for k in STEMS])


@dataclass
class Head:
    """Logistic weights of one target, on telling words and style."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * _STYLE + 1))
    bias: float = -3.0

    def inputs(self, styles: np.ndarray, words: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(words), 2 * _STYLE + len(self.words) + 1))
        x[:, :_STYLE] = styles
        x[:, _STYLE : 2 * _STYLE] = np.sqrt(np.clip(styles, 0, None))
        for i, found in enumerate(words):
            for w in found & self.words.keys():
                x[i, 2 * _STYLE + self.words[w]] = 1
        # However many telling words there are, one is often enough.
        x[:, -1] = x[:, 2 * _STYLE : -1].any(axis=1)
        return x

    def logits(self, styles: np.ndarray, words: list[set[str]]) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        return np.clip(self.inputs(styles, words) @ self.weights + self.bias, -12, 12)


def telling_words(measured: DataFrame, k: int, n_words: int = WORDS) -> list[str]:
    """At most ``n_words`` words that tell documents with target ``k`` by a z-score of their log odds, best first."""
    bad = F.col("targets")[k]
    total, all_bad = measured.agg(F.count("*"), F.sum(bad)).first()
    bad_docs, good_docs = all_bad or 0, total - (all_bad or 0)
    seen = measured.select(F.explode("words").alias("word"), bad.alias("bad")).groupBy("word").agg(F.sum("bad").alias("k"), F.count("*").alias("n"))
    seen = seen.where("k >= 3").selectExpr("word", "k + 0.5D as a", "n - k + 0.5D as b", f"{bad_docs} - k + 0.5D as c", f"{good_docs} - n + k + 0.5D as d")
    seen = seen.withColumn("odds", F.expr("ln(a / c) - ln(b / d)")).withColumn("z", F.expr("odds / sqrt(1 / a + 1 / b + 1 / c + 1 / d)"))
    return [r[0] for r in seen.where("z > 5 and odds > 2").orderBy(F.desc("z"), "word").limit(n_words).collect()]


def fit_head(styles: np.ndarray, words: list[set[str]], truth: np.ndarray, telling: list[str]) -> Head:
    """Newton steps of a ridge-penalised logistic regression on style and the telling words."""
    if truth.sum() in (0, len(truth)):
        rate = (truth.sum() + 0.5) / (len(truth) + 1)
        return Head(bias=float(np.log(rate / (1 - rate))))
    head = Head({w: i for i, w in enumerate(telling)})
    x = np.hstack([head.inputs(styles, words), np.ones((len(words), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (truth - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    head.weights, head.bias = w[:-1], float(w[-1])
    return head


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            texts = [t or "" for t in part.column("text").to_pylist()]
            styles = pa.array([style_of(t) for t in texts], pa.list_(pa.float64()))
            found = pa.array([list(words_of(t)) for t in texts], pa.list_(pa.string()))
            yield pa.record_batch([styles, found, part.column("targets")], names=["style", "words", "targets"])


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, int], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict[str, Head]:
    """A head for each target column of ``labels``; ``targets`` says which value of it means "reject".

    Labels with a null id or a null target, and labels of unknown documents, are left out; an id with
    several different labels takes part with each, documents that repeat an id with the text of the least hash. Null texts are
    empty. Without labels a head rejects nothing. At most ``sample``
    labelled documents are read. Their words are counted by Spark; the driver gets the telling ones.
    """
    known = labels.where(F.col(id_col).isNotNull())
    for t in targets:
        known = known.where(F.col(t).isNotNull())
    wanted = F.array(*[(F.col(t) == v).cast("int") for t, v in targets.items()])
    # No more than ``sample`` rows of an id and a few numbers: small enough to broadcast.
    known = known.select(F.col(id_col).alias("_id"), wanted.alias("targets")).orderBy(F.xxhash64("_id"), "targets").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    # Of rows that repeat an id one is fitted, so that no more come than there are labels.
    nth = F.row_number().over(Window.partitionBy("_id", "targets").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_nth", nth).where("_nth = 1")
    measured = materialise(rows.select("text", "targets").mapInArrow(_measured, "style array<double>, words array<string>, targets array<int>"), "labelled")
    telling = [telling_words(measured, k) for k in range(len(targets))]
    any_words = F.array(*[F.lit(w) for w in sorted(set().union(*telling))]).cast("array<string>")
    got = measured.select("style", F.array_intersect("words", any_words).alias("words"), "targets").toArrow()
    if not got.num_rows:
        return {t: Head() for t in targets}
    styles = np.array(got["style"].to_pylist())
    words = [set(x) for x in got["words"].to_pylist()]
    truth = np.array(got["targets"].to_pylist(), np.float64)
    return {t: fit_head(styles, words, truth[:, k], telling[k]) for k, t in enumerate(targets)}


def evidence(text: Column, heads: dict[str, Head]) -> Column:
    """Log odds of each head for a text, as an array in the order of the heads."""

    known = set().union(*[h.words.keys() for h in heads.values()])

    @F.arrow_udf("array<double>")
    def logits(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), _AT_ONCE):
            # Of a text's words only the telling ones are held.
            part = [t or "" for t in texts.slice(at, _AT_ONCE).to_pylist()]
            styles = np.array([style_of(t) for t in part]).reshape(-1, _STYLE)
            words = [words_of(t) & known for t in part]
            out += list(np.stack([h.logits(styles, words) for h in heads.values()], axis=1))
        return pa.array(out, pa.list_(pa.float64()))

    return logits(text)


def _odds(p: str) -> str:
    return f"ln({p} / (1 - {p}))"


def site_rates(paths: DataFrame, host: str = "host", path: str = "path", n: str = "n", s: str = "s") -> DataFrame:
    """(host, path, host_rate, path_rate, global_rate): posterior means by two-level shrinkage.

    ``paths`` has one row per host and path: ``n`` documents and the sum ``s`` of their probabilities. A
    level's prior strength is what the method of moments gives, m (1 - m) / variance - 1 of the group
    means, kept between 2 and 10,000. Null hosts and paths are groups of their own.
    """
    paths = paths.select(F.col(host).alias(host), F.col(path).alias(path), F.col(n).alias("n"), F.col(s).alias("s"))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    strength = "greatest(2D, least(10000D, coalesce({m} * (1 - {m}) / nullif({v}, 0D) - 1, 10000D)))"
    top = hosts.agg((F.sum("hs") / F.sum("hn")).alias("global_rate"), F.var_samp(F.expr("hs / hn")).alias("hv"))
    hosts = hosts.crossJoin(F.broadcast(top))  # one row
    hosts = hosts.withColumn("k", F.expr(strength.format(m="global_rate", v="hv"))).withColumn("host_rate", F.expr("(hs + k * global_rate) / (hn + k)"))
    joined = paths.join(hosts.select(F.col(host).alias("_h"), "host_rate", "global_rate"), F.col(host).eqNullSafe(F.col("_h"))).drop("_h")
    spread = joined.agg(F.avg(F.expr("power(s / n - host_rate, 2)")).alias("pv"))
    joined = joined.crossJoin(F.broadcast(spread))  # one row
    joined = joined.withColumn("k", F.expr(strength.format(m="host_rate", v="pv")))
    return joined.select(host, path, "host_rate", F.expr("(s + k * host_rate) / (n + k)").alias("path_rate"), "global_rate")


def judge(docs: DataFrame, heads: dict[str, Head], host: Column, path: Column, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with evidence (log odds by head), host_rate, path_rate, p_reject (the largest over the heads) and kept.

    Null text counts as empty; no row depends on its id, so ids may be null or repeat. Columns named
    like the new ones are replaced. Hosts with few documents lean on the global rate. The text is read
    twice and shuffled only if there are too many paths to broadcast.
    """
    docs = docs.drop("evidence", "host_rate", "path_rate", "p_reject", "kept")
    base = docs.withColumn("_host", host).withColumn("_path", path).withColumn("evidence", evidence(F.col(text_col), heads))
    p = [1 / (1 + F.exp(-F.col("evidence")[k])) for k in range(len(heads))]
    sums = base.groupBy("_host", "_path").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(p)])
    sums = materialise(sums, "site-sums")
    out = base
    chance = []
    for k in range(len(heads)):
        rates = site_rates(sums, "_host", "_path", "n", f"s{k}").select(
            F.col("_host").alias(f"_h{k}"), F.col("_path").alias(f"_p{k}"), F.struct("host_rate", "path_rate", "global_rate").alias(f"_r{k}")
        )
        out = out.join(rates, F.col("_host").eqNullSafe(F.col(f"_h{k}")) & F.col("_path").eqNullSafe(F.col(f"_p{k}")), "left")
        shift = F.expr(f"{_odds(f'_r{k}.path_rate')} - {_odds(f'_r{k}.global_rate')}")
        chance.append(1 / (1 + F.exp(-(F.col("evidence")[k] + F.coalesce(shift, F.lit(0.0))))))
    p = chance[0] if len(chance) == 1 else F.greatest(*chance)
    return out.select(
        *[out[c] for c in docs.columns], "evidence",
        F.col("_r0.host_rate").alias("host_rate"), F.col("_r0.path_rate").alias("path_rate"),
        p.alias("p_reject"), (p < threshold).alias("kept"),
    )


#: What rejects a document: quality 0 or toxic 1.
TARGETS = {"quality": 0, "toxic": 1}


def judged_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents have a source but no URL: the source is the host, and its part in one language the path. Columns named like the
    judgement's are replaced; rows with null or repeated ids are judged each by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    heads = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, TARGETS)
    return judge(docs, heads, F.col("source"), F.concat_ws("/", "source", "lang"))


def good_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those of ``docs`` that are kept, with the columns as they were, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, source, lang = (plain.columns[names.index(c)] for c in ("text", "source", "lang"))
    heads = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    judged = judge(plain, heads, F.col(source), F.concat_ws("/", source, lang), text_col=text)
    return judged.where("kept").select(*plain.columns).toDF(*names)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judged_documents(spark, docs, sf_dir)
    return out.select(
        "doc_id", F.round(F.col("evidence")[0], 6).alias("quality_evidence"), F.round(F.col("evidence")[1], 6).alias("toxic_evidence"),
        F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"),
        F.round("p_reject", 6).alias("p_reject"), "kept",
    )
