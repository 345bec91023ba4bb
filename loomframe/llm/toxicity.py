"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a string over seven word classes: insult, threat, target, intent,
negation, report and other. Five transducers read it side by side: target, negation
and report remember what stands before a word, the insult transducer puts out a match
at an insult, and the threat transducer one where an intent, a threatening verb and a
target follow each other, or a verb and a target. Their composition is one deterministic
machine whose matches carry the context that they stand in. A clause's score is the
sum of its matches' weights, less where the match is denied or reported; clauses, not
words, are what is scored. Insults and their weights, and the weight of each
kind of clause, are learned from labels.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import held, table

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = range(7)
#: Labelled rows of each class that learning takes at most on average, chosen by a hash of the id.
SAMPLE = 8_000
#: A term must stand in this many toxic documents, and its log odds must reach LEAST_ODDS and so many of their standard errors.
SUPPORT, LEAST_ODDS, SIGMAS = 4, 1.2, 3.0
#: Lengths of the word beginnings that count as terms beside whole words.
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
_marks = ".,;:!?()[]{}\"'|*#$%&<>-_"
_ends = (".", ",", ";", "!", "?", ":")

SEEDS = {
    THREAT: "kill hurt destroy beat shoot stab burn hang töten schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
    TARGET: "you your yours u he she they him his them her their du dich dir ihr euch sie toi vous ton tes votre ils elles tú te ti tu usted ustedes ellos ellas".split(),
    NEGATION: "not no never nobody nothing isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás".split(),
    REPORT: "said says say told wrote claimed called quoted sagte sagt schrieb dit disait écrit dijo dice escribió".split(),
    INTENT: "will gonna shall i'll we'll going werde werden wollen vais allons veux voy vamos quiero".split(),
}


def memory(trigger: int, reach: int) -> list[list[int]]:
    """A transducer that counts down from reach after the trigger: next state by state and class."""
    return [[reach if c == trigger else max(0, s - 1) for c in range(7)] for s in range(reach + 1)]


#: The threat transducer: idle, up to four words after an intent, up to three after a verb that follows an intent, up to three after another verb.
IDLE, MEANT, ARMED, BARE = 0, range(1, 5), range(5, 8), range(8, 11)


def threat_step(state: int, kind: int) -> int:
    if kind == INTENT:
        return MEANT[-1]
    if kind == THREAT:
        return ARMED[-1] if state in MEANT else BARE[-1]
    if kind == TARGET and (state in ARMED or state in BARE) or state in (MEANT[0], ARMED[0], BARE[0], IDLE):
        return IDLE
    return state - 1


def compose(*parts: list[list[int]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """The product machine, and the parts' states in each of its states."""
    states = list(itertools.product(*(range(len(p)) for p in parts)))
    at = {s: k for k, s in enumerate(states)}
    return [[at[tuple(p[x][c] for p, x in zip(parts, s, strict=True))] for c in range(7)] for s in states], states


#: A target and a negation act on the next four and three words, a reporting verb on the rest of a clause of up to twelve.
STEP, _states = compose(memory(TARGET, 4), memory(NEGATION, 3), memory(REPORT, 12), [[threat_step(s, c) for c in range(7)] for s in range(11)])
#: By state: what the match of an insult stands in (bits: aimed at a target, denied, reported), and what a target there puts out.
CONTEXT = [sum((x > 0) << k for k, x in enumerate(s[:3])) for s in _states]
THREATENS = [1.0 if s[3] in ARMED else 0.5 if s[3] in BARE else 0.0 for s in _states]
#: What a match weighs in its clause, by context.
WEIGHT = [(2.0 if c & 1 else 1.0) * (0.25 if c & 2 else 1.0) * (0.5 if c & 4 else 1.0) for c in range(8)]
FEATURES = 2 * 8 + 5


def bare(word: str) -> str:
    return word.strip(_marks)


class Words(dict):
    """word as written -> (class, weight, mark that ends it, if any), filled on demand."""

    def __init__(self, terms: dict[str, float], most: int = 400_000):
        super().__init__()
        self.terms, self.most = terms, most
        self.classes = {w: c for c, own in SEEDS.items() for w in own}

    def __missing__(self, word: str):
        w = bare(word)
        kind, weight = self.classes.get(w, OTHER), 0.0
        for t in (w, *(f"{w[:k]}*" for k in reversed(STEMS) if len(w) >= k)):
            if t in self.terms:
                kind, weight = INSULT, self.terms[t]
                break
        end = word[-1] if word[-1] in _ends else ""
        out = None if kind == OTHER and not end else (kind, weight, end)
        if len(self) < self.most:
            self[word] = out
        return out


def clauses(seen: list) -> list[tuple[float, int, bool]]:
    """Score, context and whether it threatens, of each clause with a match. A colon or comma after a reporting verb doesn't end its clause."""
    out = []
    state, score, context, threat = 0, 0.0, 0, False
    for x in seen:
        if x is None:
            state = STEP[state][OTHER]
            continue
        kind, weight, end = x
        v = weight if kind == INSULT else THREATENS[state] if kind == TARGET else 0.0
        if v:
            # a threat is aimed by its own pattern
            c = CONTEXT[state] | (kind == TARGET)
            score += v * WEIGHT[c]
            context, threat = context | c, threat or kind == TARGET
        state = STEP[state][kind]
        if end and not (CONTEXT[state] & 4 and (end == ":" or end == "," and kind == REPORT)):
            if score:
                out.append((score, context, threat))
            state, score, context, threat = 0, 0.0, 0, False
    if score:
        out.append((score, context, threat))
    return out


def features(text: str, words: Words) -> list[float]:
    """Scores of matched clauses summed by context and kind, number of matched clauses, largest clause, density and length."""
    own = text.lower().split()
    found = clauses([words[w] for w in own])
    sums = [0.0] * 16
    for score, context, threat in found:
        sums[context + 8 * threat] += score
    n = max(1, len(own))
    return [*(math.log1p(s) for s in sums), math.log1p(len(found)), max((x[0] for x in found), default=0.0), math.log1p(100 * sum(sums) / n), math.log1p(n), float(bool(found))]


def count_terms(batches):
    """toxic and clean documents with each term, by half of the rows."""
    sums: dict[int, tuple[Counter, Counter]] = {h: (Counter(), Counter()) for h in (0, 1)}
    for batch in batches:
        for t, y, half in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            own = {bare(w) for w in t.lower().split()}
            terms = own | {f"{w[:k]}*" for w in own for k in STEMS if len(w) >= k}
            sums[half][1 - y].update(terms)
    for half, (bad, good) in sums.items():
        # only terms of toxic documents can be kept, but another task may have seen them
        terms = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([half] * len(terms), pa.int32()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], ["term", "half", "bad", "good"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(bad: Column, good: Column, n_bad: float, n_good: float) -> Column:
    """Log odds of a term that reaches the thresholds, else null."""
    odds = F.log((bad + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
    error = F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return F.when((bad >= min(SUPPORT, max(2, 0.05 * n_bad))) & (odds >= LEAST_ODDS) & (odds >= SIGMAS * error), odds)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray] | None:
    """Terms with weights, and the logistic weights of the features. None if the labels don't hold both classes.

    docs has doc_id and text, labels doc_id and toxic; a null label or text is no example, and of several labels of an id the
    largest counts. Learning takes a sample of SAMPLE rows of each class on average, by a hash of the id; the driver gets the
    terms of these whose evidence is large enough, however many, and the features of these.
    Features of either half of the sample come from terms of the other half, so they are as strong as on new rows.
    """
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = labels.where(F.when(F.col("toxic") == 1, part < SAMPLE / n[1]).otherwise(part < SAMPLE / n[0]))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half"))
    size = {(r.half, r.toxic): r.n for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.mapInArrow(count_terms, "term string, half int, bad long, good long").groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("bad", "good")])
    tot = [[size.get((h, y), 0) for y in (1, 0)] for h in (0, 1)]
    odds = [evidence(F.col(f"bad{h}"), F.col(f"good{h}"), *tot[h]).alias(f"odds{h}") for h in (0, 1)]
    every = evidence(F.col("bad0") + F.col("bad1"), F.col("good0") + F.col("good1"), tot[0][0] + tot[1][0], tot[0][1] + tot[1][1])
    rows = counted.select("term", *odds, every.alias("odds")).where("coalesce(odds, odds0, odds1) is not null").toPandas()
    terms, whole = [dict(rows.loc[rows[f"odds{h}"].notna(), ["term", f"odds{h}"]].itertuples(index=False)) for h in (0, 1)], dict(rows.loc[rows["odds"].notna(), ["term", "odds"]].itertuples(index=False))
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def measure(batches):
        words = [Words(t) for t in sent.value]
        for batch in batches:
            texts, toxic, half = (batch.column(k).to_pylist() for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array([features(t, words[1 - h]) for t, h in zip(texts, half, strict=True)], pa.list_(pa.float64())), pa.array(toxic, pa.int32())], ["x", "toxic"])

    got = sample.mapInArrow(measure, "x array<double>, toxic int").toPandas()
    if got["toxic"].nunique() < 2:
        return None
    x, y = np.stack(got["x"]), got["toxic"].to_numpy(float)
    weights = logistic(x, y)
    # the sample may hold the classes in other proportions than the labels
    weights[-1] += math.log(n[1] / n[0]) - math.log(y.sum() / (len(y) - y.sum()))
    return whole, weights


def score(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """Replaces the text by score and predicted. Null and empty texts score as texts without words; without a model all scores are 0. Rows are scored alone and whole. Columns score and predicted of docs are replaced."""
    docs = docs.drop("score", "predicted")
    keep = [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = Words(sent.value[0]) if sent.value else None
        for batch in batches:
            n = batch.num_rows
            s = np.zeros(n)
            if words is not None and n:
                x = np.array([features(t or "", words) for t in batch.column(batch.num_columns - 1).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(x @ sent.value[1][:-1] + sent.value[1][-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes if c != text), "score double, predicted int"])
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held(1, 3)))
    return score(docs.select("doc_id", held(1, 3).alias("held_out"), "text"), model)
