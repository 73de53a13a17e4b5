"""Mixing sources to target weights: soft membership and projected-gradient least squares.

A classifier, fitted on a bounded sample of a labelled table, gives each document posteriors over domains. The expected
tokens of a domain are the sum of rate * tokens * posterior over all documents. Rates, one for each document and from 0
to MAX_RATE, are fitted so that these sums match the targets: accelerated projected gradient descent from rate 1 on the
squared distance to the targets, each domain's divided by its tokens. As the domains' Gram matrix is at most the diagonal
of these tokens, a step of length 1 is safe. A target out of reach, above MAX_RATE times a domain's tokens, pulls as if it
were that, so that other domains don't suffer from it; the result states targets as they were and sums as they became.

All steps but the projection depend on a document through its posteriors only, so that a document's rate follows from
its posteriors and the short history of distances. An iteration is therefore one aggregation over a narrow table; the
states are written every STORED steps, which spares repeating the history. A document is taken floor(rate + u) times, u in [0, 1) being a hash of its id.

Scale: one pass predicts; each iteration sends one row of sums for each task. Nothing is joined or shuffled by source,
so a source with any share of the rows is dealt with like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import let, materialize, n_words, pieces, release
from cairn.llm.text_arrays import word_hashes

BUCKETS = 1 << 11
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 4_000
FIT_STEPS = 200
MAX_RATE = 4.0
#: Steps at most, and the change of a domain's sum, as a part of its tokens, that ends them after the first ten.
ITERATIONS = 40
#: Steps after which the documents' states are written, so that a step never repeats more than so many.
STORED = 8
TOLERANCE = 1e-5
#: Production targets: the share of all tokens that each domain is to have.
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}
#: The domain whose tokens all stay; it fixes the size of the mixture.
ANCHOR = "clean"

_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>!"))
_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of log counts of hashed words, of length 1, a constant, shares of symbols and capitals, and length; words in each text."""
    out, sizes = np.zeros((len(texts), BUCKETS + 4), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    for first, hashes, counts in word_hashes(texts):
        n = len(counts)
        row = np.repeat(np.arange(n), counts)
        cells = row * BUCKETS + (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        bags = np.log1p(np.bincount(cells, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32))
        out[first : first + n, :BUCKETS] = bags / np.maximum(1e-9, np.sqrt((bags**2).sum(axis=1, keepdims=True)))
        sizes[first : first + n] = counts
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = max(1, len(raw))
        out[i, BUCKETS:] = 1.0, len(raw.translate(None, _SYMBOLS)) / n, len(raw.translate(None, _CAPITALS)) / n, np.log1p(sizes[i]) / 10
    return out, sizes


def fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = FIT_STEPS, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a multinomial logistic regression, by accelerated gradient descent; columns are scaled first."""
    scale = 1 / np.maximum(1e-3, x.std(axis=0))
    scale[-4] = 1.0
    x = x * np.minimum(scale, 50)
    wanted = np.eye(classes, dtype=np.float32)[y]
    rate = 4 * len(x) / max(1.0, float((x**2).sum(axis=1).max()) * len(x))
    w = ahead = np.zeros((x.shape[1], classes), dtype=np.float32)
    for step in range(steps):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ (p - wanted) / len(x) + ridge * ahead)
        ahead, w = new + step / (step + 3) * (new - w), new
    return (w * np.minimum(scale, 50)[:, None]).astype(np.float32)


def train(docs: DataFrame, labelled: DataFrame) -> tuple[list[str], np.ndarray | None]:
    """Domains in alphabetical order and weights; labelled has doc_id and domain. The sample has the least hashes."""
    sample = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = F.broadcast(sample)  # SAMPLE rows at most
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "domain").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def rowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "domain": batch["domain"].array, "x": [r.tobytes() for r in features(list(batch["text"]))[0]]})

    got = sorted(rows.mapInPandas(rowed, "doc_id long, domain string, x binary").collect(), key=lambda r: r["doc_id"])
    domains = sorted({r["domain"] for r in got})
    if not domains:
        return [], None
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in got])
    return domains, fit(x, np.array([domains.index(r["domain"]) for r in got]), len(domains))


def posteriors(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with all their columns and n_tokens and p (array), in place of any columns so named. The columns stay in Arrow, nulls and all."""
    own = [c for c in docs.columns if c not in ("n_tokens", "p")]
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x, sizes = features(batch["text"].to_pylist())
            z = (x @ sent.value).astype(np.float64)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = pa.array(list(p / p.sum(axis=1, keepdims=True)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), p], names=[*own, "n_tokens", "p"])

    taken = docs.select(*[F.col(f"`{c}`") for c in own])
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]
    return taken.mapInArrow(run, T.StructType([*taken.schema.fields, *added]))


def state_of(history: list[list[float]], most: float, start: Column | None = None) -> Column:
    """A document's rate r and where the next step starts, y, after the steps of history, from its column p.

    ``start`` is the state before them, that of rate 1 if not given.

    A step is a number for each domain, and at the end how much of the rate's change is added to the next start.
    """
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")) if start is None else start
    if not history:
        return start
    k = len(history[0]) - 1
    steps = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in history])

    def step(a: Column, v: Column) -> Column:
        r = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), a["y"] - sum((F.col("p")[i] * v[i] for i in range(k)), F.lit(0.0))))
        return let(r, lambda r: F.struct(r.alias("r"), (r + v[k] * (r - a["r"])).alias("y")))

    return F.aggregate(steps, start, step)


def rate_of(history: list[list[float]], most: float) -> Column:
    return state_of(history, most)["r"]


def fit_rates(members: DataFrame, targets: list[float] | None, shares: list[float], anchor: int, most: float, iterations: int | None = None) -> tuple[list[list[float]], list[float], list[float]]:
    """The history of steps, the targets and the sums reached, for a table with n_tokens and p."""
    k = len(shares)
    sums = [F.sum(F.col("n_tokens") * F.col("p")[i]).alias(f"r{i}") for i in range(k)]
    row = members.agg(*sums).first()
    at_one = np.array([row[f"r{i}"] or 0.0 for i in range(k)])
    goal = np.array(targets) if targets else np.array(shares) / shares[anchor] * at_one[anchor]
    pull = np.minimum(goal, most * at_one)
    scale = np.where(at_one > 0, at_one, np.inf)
    history: list[list[float]] = []
    reached = ahead = at_one
    table, start, since = members, None, 0
    for t in range(ITERATIONS if iterations is None else iterations):
        history.append([*((ahead - pull) / scale).tolist(), t / (t + 3)])
        stepped = table.select("n_tokens", "p", state_of(history[since:], most, start).alias("s"))
        if len(history) - since == STORED:
            old, table, start, since = table, materialize(stepped, "rates"), F.col("s"), len(history)
            release(old)
            stepped = table
        row = stepped.agg(*[F.sum(F.col(f"s.{x}") * F.col("n_tokens") * F.col("p")[i]).alias(f"{x}{i}") for x in "ry" for i in range(k)]).first()
        before, (reached, ahead) = (reached, ahead), (np.array([row[f"{x}{i}"] or 0.0 for i in range(k)]) for x in "ry")
        if t >= 10 and max((np.abs(now - then) / scale).max() for now, then in zip((reached, ahead), before, strict=True)) <= TOLERANCE:
            break
    if table is not members:
        release(table)
    return history, goal.tolist(), reached.tolist()


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> DataFrame:
    """docs with all their columns and n_tokens, p (map of domain to posterior), rate and copies, one row for each row.

    target_tokens and reached_tokens (maps by domain, equal in all rows) are the sums wanted and those that the rates give.

    docs has doc_id and text, labelled has doc_id and domain; where a doc_id has several domains the first by name
    counts, where it has several texts the classifier is fitted on the one with the least hash. Tokens are words; null and empty texts have none and the posteriors that the classifier gives to no words.
    A domain without a weight has the target 0; weights of domains that no labelled row has are dropped, and the rest
    scaled. If the anchor isn't labelled, the first domain is. Without labelled rows every document has rate 1 and no
    posteriors. Repeated rows have equal rates, and a null doc_id is one like others. An empty table gives an empty
    result. Columns of the input with these six names are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_tokens", "p", "rate", "copies", "target_tokens", "reached_tokens")]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    domains, model = train(docs, labelled)
    if model is None:
        empty = F.create_map().cast("map<string,double>")
        return docs.withColumns({"n_tokens": n_words(F.col("text")), "p": empty, "rate": F.lit(1.0), "copies": F.lit(1).cast("long"), "target_tokens": empty, "reached_tokens": empty})
    members = materialize(posteriors(docs, model), "posteriors")
    shares = [weights.get(d, 0.0) for d in domains]
    at = domains.index(anchor) if anchor in domains else 0
    shares = shares if shares[at] > 0 else [1.0 if i == at else s for i, s in enumerate(shares)]
    history, *totals = fit_rates(members.select("n_tokens", "p"), None, shares, at, max_rate)
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = members.withColumn("rate", rate_of(history, max_rate))
    named = F.array(*[F.lit(d) for d in domains])
    goal, reached = (F.map_from_arrays(named, F.array(*[F.lit(float(x)) for x in t])) for t in totals)
    return rated.withColumns({"p": F.map_from_arrays(named, F.col("p")), "copies": F.floor(F.col("rate") + u).cast("long"), "target_tokens": goal, "reached_tokens": reached})


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain of a table with doc_id, quality and toxic: toxic before low before clean."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed = mix(docs, domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "n_tokens", *[F.col("p")[d].alias(f"p_{d}") for d in WEIGHTS], "rate", "copies", *[F.col(f"{t}_tokens")[d].alias(f"{t}_{d}") for t in ("target", "reached") for d in WEIGHTS])


ORACLE_SQL = None
