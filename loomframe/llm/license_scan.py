"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a text is a header candidate, and so is every run of terms that is as long as a
template or one of its sentences, on one line or several; each is compared to the templates and
their sentences. Whole texts are compared to the full licences. What lacks all of the weighty
terms of a template can't reach the threshold, so lines, runs and texts without any of them are
passed over, and none is lost. A tag that names a licence by its identifier is taken at its word.
Inverse document frequencies of the templates' and licences' terms are counted over the whole corpus. A file that is mostly licence is the licence of its directory; files without a header of their own take that of the nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import cut, table

#: Short notices of common licences, as their authors publish them.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. BSD 3-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "CC0-1.0": "Released into the public domain under CC0 1.0 Universal",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License",
}
#: Full texts of licences, without their copyright lines. There is none of the CC-BY licences here.
FULL = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
#: Cosine from which a line is a header, part of a file's words in headers from which it is a licence file, and cosine to a full licence from which it is that.
COSINE, FILE_SHARE, WHOLE = 0.6, 0.5, 0.85
_term = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_tag = re.compile(r"spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+)")


def terms(text: str) -> list[str]:
    return _term.findall(text.lower())


def sentences(templates: dict[str, str]) -> list[tuple[str, str]]:
    """Name and text of every template and of each of its sentences."""
    out = []
    for name, whole in templates.items():
        out.append((name, whole))
        out += [(name, s) for s in re.split(r"(?<=[a-z0-9])\. ", whole) if len(terms(s)) >= 3 and s != whole]
    return out


def frequencies(docs: DataFrame, templates: dict[str, str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and in how many each term of the templates stands. At most a row for each term and task is shuffled."""
    vocabulary = frozenset(t for x in templates.values() for t in terms(x))

    def run(batches):
        n, sums = 0, Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                sums.update(vocabulary.intersection(terms(t)))
        sums[""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    got = {r.term: r.n for r in docs.select(F.col("text").alias("text")).where("text is not null").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return got.pop("", 0), got


class Matcher:
    """Cosines of lines to the templates' sentences, over the templates' terms and one slot for all others."""

    def __init__(self, names: list[tuple[str, str]], n: int, df: dict[str, int], least: float):
        self.names = names
        self.at = {t: k for k, t in enumerate(sorted({t for _, x in self.names for t in terms(x)}))}
        self.idf = np.array([math.log((1 + n) / (1 + df.get(t, 0))) + 0.1 for t in self.at])
        self.rare = math.log(1 + n) + 0.1
        self.rows = np.stack([self.vector(terms(x))[0] for _, x in self.names])
        self.rows /= np.linalg.norm(self.rows, axis=1)[:, None]
        self.needed = self.weighty(least)
        self.lengths = defaultdict(list)
        for k, (_, x) in enumerate(names):
            self.lengths[len(terms(x))].append(k)

    def weighty(self, least: float) -> frozenset[str]:
        """Terms of which any text must hold one that reaches a cosine: a template's others weigh too little together."""
        words, out = list(self.at), set()
        for row in self.rows:
            order = np.argsort(row)
            light = np.sqrt(np.cumsum(row[order] ** 2)) < least - 1e-9
            out.update(words[k] for k in order[~light] if row[k])
        return frozenset(out)

    def vector(self, own: list[str]) -> tuple[np.ndarray, float]:
        """Weights of known terms, and the norm with unknown ones."""
        v, other = np.zeros(len(self.at)), 0
        for t in own:
            k = self.at.get(t)
            if k is None:
                other += 1
            else:
                v[k] += 1
        v *= self.idf
        return v, math.sqrt(float(v @ v) + other * self.rare**2)

    def best(self, line: str) -> tuple[str | None, float]:
        v, norm = self.vector(terms(line))
        if not norm:
            return None, 0.0
        c = self.rows @ v / norm
        k = int(c.argmax())
        return self.names[k][0], min(1.0, float(c[k]))


    def windows(self, low: str) -> list[tuple[float, str, int, int]]:
        """Score, name, start and end of the runs of terms that hold a weighty one, are as long as a template and reach COSINE: the best first, none that overlaps a better one."""
        found = list(_term.finditer(low))
        cue = np.zeros(len(found) + 1, np.int64)
        reach, stretches = max(self.lengths), []
        for p in [k for k, m in enumerate(found) if m[0] in self.needed]:
            cue[p + 1] = 1
            a, b = max(0, p - reach + 1), min(len(found), p + reach)
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = b
            else:
                stretches.append([a, b])
        cue = cue.cumsum()
        hits = []
        for a, b in stretches:
            at = np.array([self.at.get(m[0], -1) for m in found[a:b]])
            sums = np.zeros((b - a + 1, len(self.at) + 1), np.int32)
            sums[np.arange(1, b - a + 1), at] = 1  # unknown terms: the last slot
            sums = sums.cumsum(0)
            for length, rows in self.lengths.items():
                n = min(length, b - a)
                counts = sums[n:] - sums[:-n]
                v = counts[:, :-1] * self.idf
                c = v @ self.rows[rows].T / np.sqrt((v * v).sum(1) + counts[:, -1] * self.rare**2)[:, None]
                for i in np.flatnonzero((c.max(1) >= COSINE) & (cue[a + n : b + 1] > cue[a : b + 1 - n])).tolist():
                    k = int(c[i].argmax())
                    hits.append((-min(1.0, float(c[i, k])), a + i, rows[k], a + i + n))
        out, taken = [], np.zeros(len(found), bool)
        for s, i, k, j in sorted(hits):
            if not taken[i:j].any():
                taken[i:j] = True
                out.append((-s, self.names[k][0], found[i].start(), found[j - 1].end()))
        return out


def words_within(low: str, spans: list[tuple[int, int]]) -> int:
    """How many words of a text any of the spans touches."""
    inside = np.zeros(len(low) + 1, np.int64)
    for a, b in spans:
        inside[a + 1 : b + 1] = 1
    inside = inside.cumsum()
    return sum(int(inside[m.end()] > inside[m.start()]) for m in re.finditer(r"\S+", low))


def headers(docs: DataFrame, templates: dict[str, str] = TEMPLATES, full: dict[str, str] = FULL) -> DataFrame:
    """Adds license, score and is_file to the other columns of docs, in place of the text: the best line's or window's template if its cosine reaches COSINE, or the full licence that the text is.

    Null and empty texts have no licence and score 0. Ties go to tags, then lines, the earlier first, then the earlier template. Whole texts are read. Columns license, score and is_file of docs are replaced.
    """
    docs = docs.drop("license", "score", "is_file")
    n, df = frequencies(docs, templates | {f"{k} in full": x for k, x in full.items()})
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        m = Matcher(sentences(templates), n, df, COSINE)
        whole = Matcher(list(full.items()), n, df, WHOLE) if full else None
        tags = {k.lower() + end: k for k in {*templates, *full} for end in ("", "-only", "-or-later", "+")}
        cache: dict[str, tuple] = {}
        for batch in batches:
            names, scores, files = [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                name, score, spans, is_file = None, 0.0, [], False
                low = t.lower() if t else ""
                held = set(terms(low))
                for tag in _tag.finditer(low):
                    if tag[1] in tags:
                        spans.append(tag.span())
                        if score < 1.0:
                            name, score = tags[tag[1]], 1.0
                if not held.isdisjoint(m.needed):
                    at = 0
                    for line in low.split("\n"):
                        if not m.needed.isdisjoint(terms(line)):
                            if line not in cache:
                                if len(cache) > 50_000:
                                    cache.clear()
                                cache[line] = m.best(line)
                            who, s = cache[line]
                            if s >= COSINE:
                                spans.append((at, at + len(line)))
                                if s > score:
                                    name, score = who, s
                        at += len(line) + 1
                    for s, who, a, b in m.windows(low):
                        spans.append((a, b))
                        if s > score:
                            name, score = who, s
                is_file = bool(spans) and words_within(low, spans) >= FILE_SHARE * len(low.split())
                if whole and not held.isdisjoint(whole.needed):
                    who, s = whole.best(low)
                    if s >= WHOLE:
                        name, score, is_file = who, s, True
                names.append(name), scores.append(score), files.append(is_file)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(files, pa.bool_())], [*keep, "license", "score", "is_file"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes if c != "text"), "license string, score double, is_file boolean"])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def directory(path: Column) -> Column:
    """Everything before the last slash; the empty text for a bare name."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/+$", "")


def inherit(scanned: DataFrame, path: str = "path") -> DataFrame:
    """Adds inherited and inherited_from (license and directory of the nearest directory above or at the file's that holds a licence file) and effective.

    A directory with several licence files has that with the highest score, ties the first name. A null path inherits nothing.
    Directories, not files, are joined to their ancestors, so a directory with many files counts once.
    """
    scanned = scanned.drop("dir", "inherited", "inherited_from", "effective")
    own = directory(F.col(path))
    files = scanned.where(F.col("is_file") & F.col(path).isNotNull()).select(own.alias("dir"), "license", "score").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select(F.col("dir").alias("from_dir"), F.col("x.license").alias("found"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.array(F.lit("")), above)))
    dirs = scanned.where(F.col(path).isNotNull()).select(own.alias("dir")).distinct()
    near = dirs.select("dir", F.explode(above).alias("from_dir")).join(files, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), "from_dir", "found")).alias("x")).select("dir", F.col("x.found").alias("inherited"), F.col("x.from_dir").alias("inherited_from"))
    out = scanned.withColumn("dir", own).join(cut(near), "dir", "left")
    return out.withColumn("effective", F.coalesce("license", "inherited"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; the query puts each in a directory of its source and language."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return inherit(headers(docs)).select("doc_id", "path", "license", F.round("score", 9).alias("score"), "is_file", "inherited", "inherited_from", "effective")
