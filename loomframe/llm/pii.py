"""Personal data: direct identifiers, and terms that give them away.

Direct identifiers (e-mail, ip, card and phone numbers) are protected entities.
One pass over the corpus counts how often each term stands near each entity and
how often it stands anywhere. The information that a term discloses about an
entity is log2(P(entity near | term) / P(entity near)), and likewise about a
kind; terms whose disclosure and posterior exceed thresholds are generalised
along with the entities: near that entity, or near all of the kind. Where nearly all
uses of a term are near, the others disclose as much, and it is generalised wherever it stands.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import cut, table, tidied

KINDS = ("email", "ip", "card", "phone")
#: Words to each side that count as near an entity.
REACH = 4
#: Uses near one entity that a term must have to give it away, or different entities near it to give away their kind.
LEAST = 5
#: Bits that a term must disclose, and the part of its uses that must be near the entity or kind.
BITS, POSTERIOR = 6.0, 0.5
#: The part of its uses near the entity or kind from which a term is generalised anywhere.
ANYWHERE = 0.9
#: Sums that a task holds before it hands them on; disclosing terms that are sent to every task, while more are joined.
SUMS, SENT = 200_000, 100_000

_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_word = re.compile(r"[^\x20\x09-\x0D]+")
_trim = ".,;:!?()[]{}\"'|*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local@domain: only runs before an at sign can start one."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Direct identifiers as kind, start and end, by start and then kind as listed. Empty text: none."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def term(word: str) -> str:
    """A word as it is counted: lower case, without marks around it, digits alike."""
    return _digit.sub("0", word.strip(_trim).lower())


def near_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """Kind, start, end, term and entity for each word within reach of an entity that no entity overlaps. A word counts once for each entity."""
    out = []
    starts = [x for _, x, _ in spans]
    reach = list(itertools.accumulate((y for _, _, y in spans), max))  # the furthest end so far
    for kind, a, b in spans:
        before = []
        end = a
        while end > 0 and len(before) < REACH:
            while end > 0 and text[end - 1].isspace():
                end -= 1
            start = end
            while start > 0 and not text[start - 1].isspace():
                start -= 1
            if start < end:
                before.append((start, end))
            end = start
        after = []
        for m in _word.finditer(text, b):
            after.append(m.span())
            if len(after) == REACH:
                break
        for s, e in before + after:
            k = bisect_left(starts, e)  # spans that start before the word's end
            if not (k and reach[k - 1] > s) and (t := term(text[s:e])):
                out.append((kind, s, e, t, text[a:b]))
    return out


def disclosed(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, term, entity, bits and posterior of what exceeds the thresholds: entity is null where a term gives away the kind, else the key of the one that it gives away.

    Counts cover every row and stay distributed: P(entity | term) is judged against P(entity), and P(kind | term) against P(kind).
    The support is LEAST uses near the entity, or LEAST different entities of the kind, however many other mentions there are.
    """
    docs = docs.select(F.col(text).alias("text")).where("text is not null")

    def rows(sums: Counter) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.binary()), pa.array([sums[k] for k in keys], pa.int64())], ["kind", "term", "entity", "n"])

    @tidied
    def count(batches):
        sums: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                for kind, x, y in spans:
                    sums[kind, None, key(t[x:y])] += 1
                for kind, _, w, entity in {(kind, s, w, entity) for kind, s, _, w, entity in near_terms(t, spans)}:
                    sums[kind, w, key(entity)] += 1
                own = t.split()
                sums[None, None, None] += len(own)
                for w, n in Counter(own).items():
                    if w := term(w):
                        sums[None, w, None] += n
            if len(sums) > SUMS:
                yield rows(sums)
                sums.clear()
        yield rows(sums)

    counted = cut(docs.mapInArrow(count, "kind string, term string, entity binary, n long").groupBy("kind", "term", "entity").agg(F.sum("n").alias("n")))
    total = F.broadcast(counted.where("kind is null and term is null").select(F.greatest(F.col("n"), F.lit(1)).alias("words")))
    mentions = counted.where("kind is not null and term is null").select("kind", "entity", F.col("n").alias("mentions"))
    near = counted.where("kind is not null and term is not null")
    one = near.where(F.col("n") >= LEAST).join(mentions, ["kind", "entity"]).select("kind", "term", "entity", "n", "mentions")
    many = near.groupBy("kind", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= LEAST)
    many = many.join(F.broadcast(mentions.groupBy("kind").agg(F.sum("mentions").alias("mentions"))), "kind").select("kind", "term", F.lit(None).cast("binary").alias("entity"), "n", "mentions")
    uses = counted.where("kind is null and term is not null").select("term", F.col("n").alias("uses"))
    prior = F.least(F.lit(1.0), 2 * REACH * F.col("mentions") / F.col("words"))
    judged = one.union(many).join(uses, "term").crossJoin(total).withColumn("posterior", F.col("n") / F.greatest("uses", "n")).withColumn("bits", F.log2(F.col("posterior") / prior))
    return judged.where((F.col("bits") >= BITS) & (F.col("posterior") >= POSTERIOR)).select("kind", "term", "entity", "bits", "posterior")


def disclosing(docs: DataFrame, text: str = "text") -> dict[str, dict] | DataFrame:
    """What disclosed() finds: up to SENT rows as a dictionary for each kind, of bits and posterior by term or by term and entity; beyond, the frame itself."""
    found = cut(disclosed(docs, text))
    if found.limit(SENT + 1).count() > SENT:
        return found
    out: dict[str, dict] = {k: {} for k in KINDS}
    for r in found.collect():
        out[r.kind][r.term if r.entity is None else (r.term, bytes(r.entity))] = (r.bits, r.posterior)
    return out


def key(entity: str) -> bytes:
    return hashlib.blake2b(entity.encode("utf-8"), digest_size=12).digest()


def anywhere(cues: dict[str, dict]) -> frozenset[str]:
    """Terms that are generalised wherever they stand."""
    return frozenset(k if isinstance(k, str) else k[0] for own in cues.values() for k, (_, posterior) in own.items() if posterior >= ANYWHERE)


def all_spans(text: str, cues: dict[str, dict], always: frozenset[str] = frozenset()) -> tuple[list, list]:
    """Direct identifiers, and these with the terms that disclose a kind near entities of it, or an entity near that one, and with those that always go; no term overlaps an identifier."""
    base = base_spans(text)
    more = {("term", s, e) for kind, s, e, w, entity in near_terms(text, base) if w in cues[kind] or (w, key(entity)) in cues[kind]} if base and any(cues.values()) else set()
    if always and not always.isdisjoint(map(term, set(text.split()))):
        starts, reach = [x for _, x, _ in base], list(itertools.accumulate((y for _, _, y in base), max))
        for m in _word.finditer(text):
            k = bisect_left(starts, m.end())
            if term(m[0]) in always and not (k and reach[k - 1] > m.start()):
                more.add(("term", *m.span()))
    order = (*KINDS, "term")
    return base, sorted([*base, *more], key=lambda x: (x[1], order.index(x[0])))


def said(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def by_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of found that each different text needs, as a list by the text's digest; kind is null for terms that always go."""

    @tidied
    def near(batches):
        for batch in batches:
            rows = [(d, *x) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in {(kind, w, key(entity)) for kind, _, _, w, entity in near_terms(t, base_spans(t))} | {(None, w, None) for w in set(map(term, t.split())) if w}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.binary()))], ["digest", "kind", "term", "entity"])

    each = texts.mapInArrow(near, "digest string, kind string, term string, entity binary").distinct()
    one = each.join(found.where("entity is not null").select("kind", "term", "entity"), ["kind", "term", "entity"], "left_semi").select("digest", "kind", "term", "entity")
    many = each.join(found.where("entity is null").select("kind", "term"), ["kind", "term"], "left_semi").select("digest", "kind", "term", F.lit(None).cast("binary").alias("entity"))
    always = each.where("kind is null").join(found.where(F.col("posterior") >= ANYWHERE).select("term").distinct(), "term", "left_semi").select("digest", "kind", "term", "entity")
    return one.union(many).union(always).groupBy("digest").agg(F.collect_set(F.struct("kind", "term", "entity")).alias("cues"))


def sanitise(docs: DataFrame, cues: dict[str, dict] | DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256, spans and sanitised to the other columns, in place of the text.

    Entities are replaced by their kind in angle brackets, terms by <term>; overlapping spans by
    that of the first. Null text has no spans and stays null. Every row is judged alone and whole.
    Cues in a frame are joined to the texts, so no task holds them all. Columns of the added names in docs are replaced.
    """
    docs = docs.drop(*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "sanitised")
    keep = [c for c in docs.columns if c != text]
    joined = isinstance(cues, DataFrame)
    sent = None if joined else docs.sparkSession.sparkContext.broadcast(cues)

    @tidied
    def run(batches):
        always = frozenset() if joined else anywhere(sent.value)
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(KINDS) + 3)]
            lists = batch.column(len(keep) + 1).to_pylist() if joined else itertools.repeat(None)
            for t, own in zip(batch.column(len(keep)).to_pylist(), lists):
                if joined:
                    known: dict[str, dict] = {k: {} for k in KINDS}
                    always = frozenset(x["term"] for x in own or () if x["kind"] is None)
                    for x in own or ():
                        if x["kind"] is None:
                            continue
                        known[x["kind"]][x["term"] if x["entity"] is None else (x["term"], x["entity"])] = True
                else:
                    known = sent.value
                base, spans = all_spans(t or "", known, always)
                n = Counter(k for k, _, _ in base)
                for c, v in zip(columns, [*(n[k] for k in KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(spans), None if t is None else replaced(t, spans)], strict=True):
                    c.append(v)
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns, kinds)], [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "sanitised"])

    schema = ", ".join([*(f"`{c}` {k}" for c, k in docs.dtypes if c != text), *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, sanitised string"])
    own = docs.select(*keep, F.col(text).alias("__own"))
    if joined:
        digest = F.sha2("__own", 256)
        lists = by_text(own.where("__own is not null").select(digest.alias("digest"), "__own"), cues).select(F.col("digest").alias("__digest"), F.col("cues").alias("__cues"))
        own = own.join(lists, digest == F.col("__digest"), "left").select(*keep, "__own", "__cues")
    return own.mapInArrow(run, schema)


def replaced(text: str, spans: list) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitise(docs, disclosing(docs)).drop("sanitised")


def sanitised_text(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the text of every document without personal data; a null text stays null."""
    plain = docs.select(*[F.col(c).alias(f"__{c}") for c in docs.columns])
    out = sanitise(plain, disclosing(docs), "__text")
    return out.select(*[F.col("sanitised" if c == "text" else f"__{c}").alias(c) for c in docs.columns])
