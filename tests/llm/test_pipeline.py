"""The pipeline against a plain version of all five stages, and on hard tables."""

import os
import re
import sys

import corpus_pipeline
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loomframe.llm import bpe, common, pii

sys.path.insert(0, os.path.dirname(__file__))
SF = "/root/testdata/sf0.001"


def test_stages_are_four_or_five():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_groups(sets, percent):
    """Ids that are the smallest of what they reach."""
    top = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((top[i], top[j]))
                top = {x: a if t == b else t for x, t in top.items()}
    return {i for i in ids if top[i] == i}


def holds_item(text, items):
    """Whether an item stands in a text: 12 of 16 tokens of a window in place, or all of a short item."""
    own = [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", text or "")]
    at = {}
    for k, t in enumerate(own):
        at.setdefault(t, []).append(k)
    for item in items:
        want = [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", item or "")]
        found = {}
        for k, t in enumerate(want):
            for p in at.get(t, ()):
                found.setdefault(p - k, []).append(k)
        wide = min(16, len(want))
        need = len(want) if len(want) < 9 else 0.75 * wide
        if any(sum(a <= k < a + wide for k in ks) >= need for ks in found.values() for a in ks) and want:
            return True
    return False


def without_identifiers(text):
    from test_operators import plain_base

    out, at = [], 0
    for kind, a, b in plain_base(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_run_is_the_plain_one(spark):
    import tiktoken

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    kept = first_of_groups({i: shingles(t) for i, t in rows.items()}, 80)
    rows = {i: t for i, t in rows.items() if i in kept and not holds_item(t, items)}
    # no term of this small table discloses an identifier; the terms are tested apart
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert pii.disclosing(docs) == {k: {} for k in pii.KINDS}
    path, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Coder(path, pattern).ranks, special_tokens={})
    want = {i: library.encode_ordinary(without_identifiers(t)) for i, t in rows.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, list(r.ids)) for r in got} == {i: (len(x), x) for i, x in want.items()}


@pytest.fixture(scope="module")
def hard_dir(spark, tmp_path_factory):
    """Tables with nulls, repeated rows, extra columns and a text of over 20,000 words."""
    at = str(tmp_path_factory.mktemp("hard"))
    r = np.random.default_rng(3)
    long = " ".join(f"word{k}" for k in r.integers(0, 30_000, 25_000))
    texts = [(1, long), (2, long + " end"), (3, None), (3, None), (4, ""), (5, "one two"), (5, "one two"), (None, "no id here"), (None, None), (6, "call +1 (212) 555-0100 now"), (7, "... 123 ...")]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({"score": F.lit(1), "n_email": F.lit("x"), "component": F.lit(2.0), "lang_pred": F.lit(None).cast("string"), "__text": F.lit("own")}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(None, "no id"), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_on_hard_tables(spark, hard_dir, tmp_path):
    got = corpus_pipeline.run(spark, hard_dir).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 1), (True, 5), (True, 6)]
    empty = str(tmp_path / "empty")
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{hard_dir}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_stages_keep_columns(spark, hard_dir):
    docs = spark.read.parquet(f"{hard_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, hard_dir).columns == docs.columns


def test_a_text_of_ten_megabytes(spark, tmp_path):
    """Every stage reads one very long text whole, and its copy goes."""
    path = str(tmp_path / "long")
    big = " ".join(f"w{k * 7919 % 999_983}" for k in range(1_300_000))
    assert len(big) > 9_000_000
    spark.createDataFrame([(1, big, "en", None, None), (2, big, "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, big[-80:])], "item_id long, text string").limit(0).write.parquet(f"{path}/benchmark.parquet")
    (row,) = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", F.size("ids").alias("n")).collect()
    assert row.doc_id == 1 and row.n == row.n_tokens > 1_300_000


def test_scratch_tables_go(spark):
    where = common.scratch(spark, "some")
    spark.range(3).write.parquet(where)
    assert spark.read.parquet(where).count() == 3
    common.clear(spark)
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(where).count()

