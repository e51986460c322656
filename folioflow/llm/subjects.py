"""Subject areas of documents (problem 10).

Sentences are the units: a document on two subjects is a mix of sentences on either and of plain
ones. Features are hashed words and word pairs. Complement naive Bayes on the labelled documents
gives each subject's first weights (the negative log of a feature's rate in all text outside the subject);
expectation-maximization then runs over the sentences of all documents, labelled ones kept to
their labels and to none, and re-estimates every subject's and the plain text's feature
distribution. The share and the number of a document's sentences on a subject are calibrated
into independent posteriors by logistic regression on the labelled documents.

The labelled documents used are at most ``MAX_LABELLED`` (the smallest hashes of the id); all
other counts cover all documents. The model is a table of ``BUCKETS`` x (subjects + 1) numbers.

Defined results: null, empty and blank texts have no sentence and no subject; repeated labels
count once; labels of unknown documents or subjects are left out; repeated documents are
classified each; without any label there is no model and no row.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder

BUCKETS = 1 << 17
MAX_LABELLED = 20_000
ROUNDS = 4
#: Occurrences that smoothing adds, and how often a weight counts: sentences are short, and a word that a subject shares with no other should decide.
SMOOTH, SCALE = 2.0, 2.0
LANGUAGES = 32
_SENTENCE = re.compile("(?<=[.!?\u2026\u3002\uff01\uff1f])\\s+|[\n\r\x0b\f\x85\u2028\u2029]+")
_WORD = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=1 << 18)
def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def features(sentence: str) -> list[int]:
    """Hashed words and pairs of a sentence, each once."""
    h = [_word_hash(w) for w in _WORD.findall(sentence.lower())]
    return list({x % BUCKETS for x in h} | {(a * 31 + b) % 0xFFFFFFFB % BUCKETS for a, b in zip(h, h[1:])})


def encode_documents(documents: DataFrame) -> DataFrame:
    """doc_id, lang (a bucket of the language), ids (features of all sentences, one after another), starts (of each sentence)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            flat, ends, starts, breaks = [], [0], [], [0]
            for text in b.column(1).to_pylist():
                for s in _SENTENCE.split(text or ""):
                    if f := features(s):
                        starts.append(len(flat) - ends[-1])
                        flat += f
                ends.append(len(flat))
                breaks.append(len(starts))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            at = pa.ListArray.from_arrays(pa.array(breaks, pa.int32()), pa.array(starts, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), ids, at], ["doc_id", "lang", "ids", "starts"])

    lang = F.pmod(F.xxhash64(F.lower(F.trim(F.coalesce("lang", F.lit(""))))), F.lit(LANGUAGES)).cast("int")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), lang.alias("lang")).mapInArrow(run, "doc_id long, lang int, ids array<int>, starts array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids, start of each sentence, its document's place in the batch)."""
    ids, starts = batch.column("ids"), batch.column("starts")
    flat, n = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
    per = np.diff(starts.offsets.to_numpy())
    doc = np.repeat(np.arange(len(per)), per)
    base = np.concatenate([[0], np.cumsum(n)])[:-1]
    return flat, starts.flatten().to_numpy() + base[doc], doc


def _posteriors(flat: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray, prior: np.ndarray, allowed: np.ndarray | None) -> np.ndarray:
    """Probability of plain text (column 0) and of each subject for each of n sentences; owner: the sentence of each feature."""
    telling = weights.any(axis=1)[flat]
    ids, at = flat[telling], owner[telling]
    score = np.stack([np.bincount(at, weights=weights[ids, i], minlength=n) for i in range(weights.shape[1])], axis=1) + prior
    if allowed is not None:
        score = np.where(allowed, score, -1e9)
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(axis=1, keepdims=True)


def _owners(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sentence of each feature, the features of each sentence)"""
    length = np.diff(np.append(starts, len(flat)))
    return np.repeat(np.arange(len(starts)), length), length


#: Shares of a sentence below this count as none.
_FAINT = 1e-3


def _counts_schema(k: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} float" for i in range(k))


def _sum_counts(partial: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts (BUCKETS x k) and, from the buckets below 0, units by language (LANGUAGES x k)."""
    rows = partial.groupBy("bucket").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).toArrow()  # at most BUCKETS + LANGUAGES rows
    at = rows.column("bucket").to_numpy()
    cells = np.stack([rows.column(f"c{i}").to_numpy() for i in range(k)], axis=1) if len(at) else np.zeros((0, k))
    out, units = np.zeros((BUCKETS, k)), np.zeros((LANGUAGES, k))
    out[at[at >= 0]] = cells[at >= 0]
    units[-1 - at[at < 0]] = cells[at < 0]
    return out, units


def _emit(counts: np.ndarray, units: np.ndarray, k: int) -> pa.RecordBatch:
    used, spoken = np.flatnonzero(counts.any(axis=1)), np.flatnonzero(units.any(axis=1))
    data = np.vstack([units[spoken], counts[used]]).astype("float32")
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - spoken, used]).astype("int32")), *[pa.array(data[:, i]) for i in range(k)]], ["bucket", *[f"c{i}" for i in range(k)]])


def _expect(encoded: DataFrame, weights: np.ndarray, prior: np.ndarray, spoken: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One E-step over all documents: expected feature counts of plain text (what no subject has) and of each subject."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, prior))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pr = shared.value
        counts, units = np.zeros((BUCKETS, k - 1)), np.zeros((LANGUAGES, k - 1))
        for b in it:
            flat, starts, doc = _flat(b)
            if not len(starts):
                continue
            owner, length = _owners(flat, starts)
            mask = np.asarray(b.column("mask").to_numpy(zero_copy_only=False))[doc]
            p = _posteriors(flat, owner, len(starts), w, pr, ((mask[:, None] >> np.arange(k)) & 1).astype(bool))
            lang = b.column("lang").to_numpy()[doc]
            for i in range(1, k):
                share = np.where(p[:, i] > _FAINT, p[:, i], 0.0)
                units[:, i - 1] += np.bincount(lang, weights=share * length, minlength=LANGUAGES)
                at = np.flatnonzero((share > 0)[owner])
                counts[:, i - 1] += np.bincount(flat[at], weights=share[owner[at]], minlength=BUCKETS)
        yield _emit(counts, units, k - 1)

    inside, units = _sum_counts(encoded.mapInArrow(run, _counts_schema(k - 1)), k - 1)
    rest = np.maximum(spoken.sum(axis=1) - inside.sum(axis=1), 0.0), np.maximum(spoken.sum(axis=0) - units.sum(axis=1), 0.0)
    return np.column_stack([rest[0], inside]), np.column_stack([rest[1], units])


def _first_counts(encoded: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature counts and units of all labelled documents (column 0) and of those with each subject; feature counts of all documents by language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, units = np.zeros((BUCKETS, k + LANGUAGES)), np.zeros((LANGUAGES, k + LANGUAGES))
        for b in it:
            flat, starts, doc = _flat(b)
            if not len(starts):
                continue
            length = _owners(flat, starts)[1]
            lang = b.column("lang").to_numpy()[doc]
            spoken = flat.astype("int64") * LANGUAGES + np.repeat(lang, length)
            counts[:, k:] += np.bincount(spoken, minlength=BUCKETS * LANGUAGES).reshape(BUCKETS, LANGUAGES)
            label = np.asarray(b.column("label").to_numpy(zero_copy_only=False))[doc]
            for i in range(k):
                has = (((label >> i) & 1) if i else (label > 0)).astype("float64")
                if has.any():
                    np.add.at(units[:, i], lang, has * length)
                    counts[:, i] += np.bincount(flat, weights=np.repeat(has, length), minlength=BUCKETS)
        yield _emit(counts, units, k + LANGUAGES)

    counts, units = _sum_counts(encoded.mapInArrow(run, _counts_schema(k + LANGUAGES)), k + LANGUAGES)
    return counts[:, :k], units[:, :k], counts[:, k:]


def _complement_weights(inside: np.ndarray, everything: np.ndarray, spoken: np.ndarray, units: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Complement naive Bayes: the negative log of a feature's smoothed rate in all text outside a subject.

    Rates are relative to what the complement's share of the languages that the feature occurs in
    lets expect (spoken: feature counts by language; units, total: the subject's and all text by
    language), as the common words of a language would otherwise add up to clusters of languages.
    Only features that clearly speak for a subject keep their weight.
    """
    k = inside.shape[1]
    w = np.zeros_like(inside)
    whole = units.sum(axis=0) / max(total.sum(), 1.0)
    for i in range(1, k):
        share = (units[:, i] + 500 * whole[i]) / (total + 500)
        base = np.clip(spoken @ share / np.maximum(spoken.sum(axis=1), 1e-9), 1e-4, 0.9)
        outside = np.maximum(everything - inside[:, i], 0.0)
        rate = (outside + SMOOTH * (1 - base)) / ((everything + SMOOTH) * (1 - base))
        p = np.clip((inside[:, i] + SMOOTH * base) / (everything + SMOOTH), 1e-6, 1 - 1e-3)
        odds = np.log(p / (1 - p)) - np.log(base / (1 - base))
        z = (inside[:, i] - everything * base) / np.sqrt(everything * base * (1 - base) + 1e-9)
        w[:, i] = np.where((odds >= least) & (z >= 3) & (inside[:, i] >= 1.5), -SCALE * np.log(rate), 0.0)
    return w


def _profiles(encoded: DataFrame, weights: np.ndarray, prior: np.ndarray, k: int) -> DataFrame:
    """doc_id, n (sentences) and mass (expected sentences) of each subject, one array a document."""
    shared = encoded.sparkSession.sparkContext.broadcast((weights, prior))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pr = shared.value
        for b in it:
            flat, starts, doc = _flat(b)
            mass = np.zeros((b.num_rows, k))
            if len(starts):
                p = _posteriors(flat, _owners(flat, starts)[0], len(starts), w, pr, None)
                np.add.at(mass, doc, np.where(p > 0.5, p, 0.0))
            n = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(n.astype("int32")), pa.array(list(mass[:, 1:]), pa.list_(pa.float64()))], ["doc_id", "label", "n", "mass"])

    return encoded.mapInArrow(run, "doc_id long, label long, n int, mass array<double>")


def _design(n: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Calibration features of (document, subject) pairs: log odds of the share, log of the number."""
    share = (mass + 0.05) / (n + 0.4)
    return np.stack([np.ones_like(share), np.log(share / (1 - np.minimum(share, 0.98))), np.log(mass + 0.2)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method; wrong labels are met by soft targets."""
    beta = np.zeros(x.shape[1])
    y = np.where(y > 0, 0.97, 0.005)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """(df read from a table in the shared folder, a call that removes the table)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/features_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(df.schema).parquet(path), lambda: where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def classify(documents: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject, posterior of every document and subject with a sentence on it."""
    spark = documents.sparkSession
    names = sorted({r.subject for r in areas.select("subject").collect() if r.subject})
    k = len(names) + 1
    number = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i + 1))]) if names else F.lit(None)
    schema = "doc_id long, subject string, posterior double"
    if not names:
        return spark.createDataFrame([], schema)
    bits = labels.select(F.col("doc_id").cast("long").alias("doc_id"), number[F.col("subject")].alias("s")).filter("s is not null and doc_id is not null").distinct()
    bits = bits.groupBy("doc_id").agg(F.sum(F.pow(F.lit(2.0), F.col("s"))).cast("long").alias("label"))
    bits = bits.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the bounded sample of labelled documents

    full = (1 << k) - 1
    known = F.coalesce("label", F.lit(0).cast("long"))
    encoded = encode_documents(documents).join(F.broadcast(bits), "doc_id", "left")  # at most max_labelled rows
    encoded, forget = written(encoded.select("doc_id", "lang", "ids", "starts", known.alias("label"), F.when(known > 0, known.bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(full).cast("long")).alias("mask")))

    first, units, spoken = _first_counts(encoded, k)
    if not first[:, 1:].any():
        forget()
        return spark.createDataFrame([], schema)
    weights, prior = _complement_weights(first, first[:, 0], spoken, units, units[:, 0], 1.2), np.array([0.0, *[-3.0] * (k - 1)])
    for _ in range(rounds):
        counts, units = _expect(encoded, weights, prior, spoken, k)
        weights = _complement_weights(counts, counts.sum(axis=1), spoken, units, units.sum(axis=1), 1.5)
        prior = np.log((units.sum(axis=0) + 1) / (units[:, 0].sum() + 1))
    profiles = checkpointed(_profiles(encoded, weights, prior, k))
    forget()

    known = profiles.filter("label > 0").limit(2 * max_labelled).toPandas()
    n = np.repeat(known["n"].to_numpy(), k - 1).astype("float64")
    mass = np.vstack(known["mass"].to_numpy()).reshape(-1)
    y = ((known["label"].to_numpy()[:, None] >> np.arange(1, k)) & 1).reshape(-1)
    beta = [float(b) for b in _fit(_design(n, mass), y)]

    each = profiles.filter("n > 0").select("doc_id", "n", F.posexplode("mass").alias("i", "m")).filter("m > 0.5")
    share = (F.col("m") + 0.05) / (F.col("n") + 0.4)
    logit = F.lit(beta[0]) + F.lit(beta[1]) * F.log(share / (1 - F.least(share, F.lit(0.98)))) + F.lit(beta[2]) * F.log(F.col("m") + 0.2)
    subject = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("i") + 1)
    return each.select("doc_id", subject.alias("subject"), (1 / (1 + F.exp(-logit))).alias("posterior"))


def found(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    return classify(documents, labels, areas).filter("posterior >= 0.5").select("doc_id", "subject")


def composition(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Documents by subject and source."""
    own = found(documents, labels, areas).join(documents.select("doc_id", F.lower(F.trim("source")).alias("source")), "doc_id")
    return own.groupBy("subject", "source").agg(F.count("*").alias("documents"))
