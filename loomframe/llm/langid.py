"""Language identification by multilingual mixture inference.

Letter trigrams are hashed into a fixed number of slots; one pass over all
training rows sums slot counts for each language. A document is then taken as a
mixture of languages: expectation-maximisation estimates the proportions, and
a language stays in the set only if the likelihood it adds exceeds a penalty
that grows with the logarithm of the document's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import held, table, tidied

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
ROUNDS = 12
#: Trigrams overlap, so one letter is seen three times; the penalty is scaled for that.
PENALTY = 3.0
SMOOTH = 0.05
PRIOR = 1.0
UNKNOWN = "und"
#: Part of a document's trigrams, none of which any learned language has, beyond which the pipeline rejects it.
MOST_UNSEEN = 0.5
ADDED = ("lang_pred", "score", "languages", "unseen")

_letters = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Slots of the trigrams of a text's letters, lower case; each run of others counts as one blank. Empty without letters."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return np.empty(0, np.int64)
    code = np.where(is_letter, code, np.uint32(32))
    blank = ~is_letter
    code = code[~(blank & np.concatenate(([False], blank[:-1])))].astype(np.uint64)
    h = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the slots seen, and log P(slot | language); the last row is that of unseen slots.

    Each task sums its rows, so one row per language, slot and task is shuffled. The
    result, which the driver gets, is bounded by SLOTS rows for each different value of lang.
    """

    @tidied
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            found: dict[str, list] = {}
            for t, who in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(who, []).append(trigrams(t))
            for who, parts in found.items():
                sums[who] = sums.get(who, 0) + np.bincount(np.concatenate(parts), minlength=SLOTS)
        for who, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([who] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "slot", "n"])

    train = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = train.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["lang"].unique())
    slots = np.unique(rows["slot"].to_numpy(np.int64))
    n = np.zeros((len(slots) + 1, len(names)))
    n[np.searchsorted(slots, rows["slot"].to_numpy(np.int64)), np.searchsorted(np.array(names, object), rows["lang"].to_numpy(object))] = rows["n"]
    return names, slots, np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * SLOTS)) if len(names) else n


def mixture(counts: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the given languages by expectation-maximisation, and the log likelihood."""
    top = logp.max(1)
    p = np.ascontiguousarray(np.exp(logp - top[:, None]).T)
    share = np.full(len(p), 1 / len(p))
    total = counts.sum()
    for _ in range(ROUNDS):
        share = share * (p @ (counts / (share @ p))) / total
    return share, float(counts @ (np.log(share @ p) + top))


def infer(counts: np.ndarray, logp: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The chosen languages, largest first, their proportions, and the posterior mean of the first one's proportion in the mixture of all languages."""
    singles = counts @ logp
    chosen = [int(singles.argmax())]
    share, now, full = np.ones(1), float(singles.max()), np.ones(1)
    if logp.shape[1] > 1:
        full, best = mixture(counts, logp)
        penalty = PENALTY * np.log(1 + counts.sum())
        for k in [k for k in np.argsort(-full) if k != chosen[0]]:
            if best - now <= penalty or full[k] < 0.01:
                break
            more, ll = mixture(counts, logp[:, [*chosen, k]])
            if ll - now > penalty:
                chosen, share, now = [*chosen, int(k)], more, ll
    order = np.argsort(-share, kind="stable")
    n = counts.sum()
    return [chosen[i] for i in order], share[order], float((full[chosen[order[0]]] * n + PRIOR) / (n + PRIOR * len(full)))


def identify(docs: DataFrame, model: tuple, text: str = "text", keep: bool = False) -> DataFrame:
    """Adds lang_pred, score, languages (name and proportion of each chosen language) and unseen to the other columns, and to the text if it is kept.

    score is the expected proportion of lang_pred in the mixture of all languages, before the penalty
    leaves any out and with PRIOR trigrams of each language added, so that short texts are less sure; unseen is the part of the trigrams that no language was learned with.
    A null text or one without letters gives `und`, score 0, no languages and no value of unseen;
    a model without languages `und`, 0, none and 1. Each row is judged alone, repeated rows alike.
    The whole text is read. Columns of these names in docs are replaced.
    """
    docs = docs.drop(*ADDED)
    names, slots, logp = model
    sent = docs.sparkSession.sparkContext.broadcast((names, slots, logp.astype(np.float32)))
    at = docs.columns.index(text)
    kept = [k for k in range(len(docs.columns)) if keep or k != at]
    rest = [docs.columns[k] for k in kept]

    @tidied
    def run(batches):
        names, slots, logp = sent.value
        where = np.full(SLOTS, len(slots), np.int32)
        where[slots] = np.arange(len(slots))
        logp = logp.astype(float)
        for batch in batches:
            pred, score, kinds, unseen = [], [], [], []
            for t in batch.column(at).to_pylist():
                g = trigrams(t) if t else ()
                if not len(g) or not names:
                    pred.append(UNKNOWN), score.append(0.0), kinds.append([]), unseen.append(1.0 if len(g) else None)
                    continue
                seen, n = np.unique(where[g], return_counts=True)
                who, share, most = infer(n.astype(float), logp[seen])
                unseen.append(float(n[seen == len(slots)].sum() / n.sum()))
                pred.append(names[who[0]]), score.append(min(1.0, most)), kinds.append([{"lang": names[k], "share": float(s)} for k, s in zip(who, share, strict=True)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(kinds, kind), pa.array(unseen, pa.float64())], [*rest, *ADDED])

    return docs.mapInArrow(run, ", ".join([*(f"`{docs.columns[k]}` {docs.dtypes[k][1]}" for k in kept), "lang_pred string, score double, languages array<struct<lang:string,share:double>>, unseen double"]))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held(2, 4)))
    return identify(docs.select("doc_id", held(2, 4).alias("held_out"), "text"), model).drop("unseen")


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: drops documents without a letter, and those of which over MOST_UNSEEN of the trigrams are in no learned language.

    Learns from all rows with a language. Where no row has one, every document with a letter stays. Rows are judged alone, so repeated rows share their fate.
    """
    model = fit(docs)
    plain = docs.select(*[F.col(c).alias(f"__{c}") for c in docs.columns])
    tagged = identify(plain, model, "__text", keep=True).where("unseen is not null")
    known = tagged.where(F.col("unseen") <= MOST_UNSEEN) if model[0] else tagged
    return known.select(*[F.col(f"__{c}").alias(c) for c in docs.columns])
