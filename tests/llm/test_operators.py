"""The text operators against plain versions, on small tables with hard rows."""

import hashlib
import itertools
import math
import re
import shutil
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import bpe, decontaminate, embeddings, langid, license_scan, minhash, pii, registry, store, substring, toxicity
from loomframe.llm.components import components
from loomframe.llm.common import xxhash64

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(*texts):
    return [(k, t, "en", None, None) for k, t in enumerate(texts)]


def words(n, seed=0, vocabulary=5000):
    r = np.random.default_rng(seed)
    return [f"w{k}" for k in r.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def hard(spark):
    long = " ".join(words(3000, 1))
    base = " ".join(words(120, 2))
    near = " ".join([*words(120, 2)[:60], "changed", *words(120, 2)[61:]])
    return spark.createDataFrame(rows(None, "", "   \n\t", "one", "two words", long, base, base, near, "a  b\n\n c", "x\x1cy \xa0z", "日本 語 ² ½", "word " * 130, "word " * 130 + "end") + [(None, "no id here at all", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_xxhash64_is_sparks(spark):
    got = spark.range(-50, 50).select("id", F.xxhash64("id").alias("h")).toPandas()
    assert (xxhash64(got["id"].to_numpy()) == got["h"].to_numpy()).all()


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5000, 5000), (None, 3), (5001, 5000)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[k] == 0 for k in range(201)) and all(got[1000 + k] == 1000 for k in range(60)) and got[5001] == got[5000] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_is_the_librarys(spark, hard, some, empty):
    import tiktoken

    path, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Coder(path, pattern).ranks, special_tokens={})
    for docs in (hard, some):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in bpe.digests(docs, path, pattern).collect():
            ids = library.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    encoded = bpe.encode(some.select("doc_id", "text"), path, pattern)
    assert {r.doc_id: r.text for r in bpe.decode(encoded, path, pattern).collect()} == {r.doc_id: r.text for r in some.collect()}
    assert bpe.digests(empty, path, pattern).count() == 0


def test_bpe_long_pieces():
    import tiktoken

    path, pattern = bpe.public_ranks()
    coder = bpe.Coder(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})
    for t in ("ab" * 3000, "x" * 2500, "th" * 700 + "e" * 900):
        assert np.frombuffer(b"".join(x[1] for x in coder.encode([t])[0]), np.int32).tolist() == library.encode_ordinary(t)


def test_store_gives_back_what_it_got(spark, hard, some, empty, tmp_path):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = ["a<|endoftext|>b", "<|endoftext|>", "a \rb", "\ra", "a\r\nb", "\na", " a", "a \nb", "a\n\nb", "don't 's it''s", "x\u00a0y z", "e\u0301 \u0501\u0501. a1.b", "tail...\n***next", "a\x1cb c"]
    extra = spark.createDataFrame([(1_000_000 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    for k, docs in enumerate((hard, some, empty, extra)):
        docs = docs.select("doc_id", "text")
        docs = docs.union(docs.limit(2))
        at = str(tmp_path / f"store{k}")
        store.write(docs, at, path)
        want = sorted([(r.doc_id is not None, r.doc_id or 0, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()])
        assert sorted([(r.doc_id is not None, r.doc_id or 0, r.ids) for r in store.read(spark, at).collect()]) == want
        got = store.read_digests(spark, at).collect()
        sums = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
        assert sums == Counter((i if known else None, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for known, i, x in want)
        ends = sorted((r.start, r.start + r.n_tokens) for r in got)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False)) and (not ends or ends[0][0] == 0)
        assert store.chunks(spark, at).groupBy("key").count().where("count > 1").count() == 0
        in_order = [r.doc_id for r in store.recipes(spark, at).orderBy("part", "place").collect()]
        assert in_order == sorted(in_order, key=lambda x: (x is not None, x or 0)) and [r.doc_id for r in sorted(got, key=lambda r: (r.start, r.n_tokens))] == in_order


def public_path():
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json")


def test_store_tells_damage(spark, some, tmp_path):
    assert store.merkle([]) != store.merkle([store.digest(b"a")]) != store.merkle([store.digest(b"b")])
    ids = np.arange(10_000, dtype=np.uint32) % 977
    assert store.cuts(ids)[-1] == 10_000 and max(np.diff([0, *store.cuts(ids)])) <= store.MOST
    assert store.cuts(np.concatenate((ids[:5], ids)))[-3:] == [e + 5 for e in store.cuts(ids)[-3:]]
    path = str(tmp_path / "damaged")
    store.write(some.select("doc_id", "text"), path, public_path())

    def rewritten(what, change):
        """The store with one of its tables changed."""
        other = f"{path}-{len(list(tmp_path.iterdir()))}"
        shutil.copytree(path, other)
        df = change(spark.read.parquet(f"{path}/{what}"))
        shutil.rmtree(f"{other}/{what}")
        df.write.parquet(f"{other}/{what}")
        return other

    first = store.chunks(spark, path).agg(F.min("key").alias("k")).first().k
    flipped = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.unhex(F.lpad(F.hex(F.expr("(conv(hex(substring(payload, -1, 1)), 16, 10) + 1) % 256").cast("long")), 2, "0")))
    bad = [
        rewritten("objects/kind=0", lambda df: df.withColumn("payload", F.when(F.col("key") == F.lit(first), flipped).otherwise(F.col("payload")))),
        rewritten("recipes", lambda df: df.where(f"doc_id != {some.agg(F.max('doc_id')).first()[0]}")),
        rewritten("recipes", lambda df: df.withColumn("payload", F.reverse(F.hex("payload")).cast("binary"))),
        rewritten("manifest", lambda df: df.withColumn("start", F.col("start") + 1)),
    ]
    for at in bad:
        with pytest.raises(Exception, match="match"):
            store.read_digests(spark, at).collect()


def plain_components(sets, percent):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_near_duplicates_are_the_plain_ones(spark, hard, some, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    copies = [" ".join([*words(150, 7)[:k], "new", *words(150, 7)[k + 1 :]]) for k in range(0, 150, 6)]
    many = spark.createDataFrame([(10_000 + k, t, None, None, None) for k, t in enumerate(copies)], DOCS)
    for docs in (hard.where("doc_id is not null").union(many), some):
        sets = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
        want = plain_components(sets, 85)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs, 85).collect()}
        assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_of_hard_tables(spark, hard, empty):
    assert minhash.near_duplicates(empty).count() == 0
    got = [r for r in minhash.near_duplicates(hard).collect() if r.doc_id is None]
    assert len(got) == 1 and got[0].kept and got[0].component_id is None


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_repeated_ids_are_one_document(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    a, b, c = (" ".join(words(200, k)) for k in (71, 72, 73))
    table = [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (9, b + " more"), (7, c), (7, c), (None, a), (8, None), (8, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).where("doc_id is not null").collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 8, True), (8, 8, True), (9, 3, False), (9, 3, False)]
    assert sorted((r.doc_id or 0, r.text or "") for r in minhash.one_of_each(docs).collect()) == sorted([(3, a + " more"), (7, c), (8, ""), (0, a)])


def test_components_fail_where_they_dont_settle(spark):
    links = spark.createDataFrame([(k, (k * 7919 + 13) % 4001) for k in range(4000)], "a long, b long").repartition(16)
    with pytest.raises(RuntimeError):
        components(links, 0)
    assert components(links).where("component > id").count() == 0


def plain_repeats(texts, window=50):
    first, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        grams = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        stay = [True] * len(w)
        for k, g in enumerate(grams):
            if first.get(g, i) < i:
                stay[k : k + window] = [False] * window
        for g in grams:
            first.setdefault(g, i)
        out[i] = (len(w), len(w) - sum(stay), " ".join(x for x, s in zip(w, stay, strict=True) if s))
    return out


def test_repeats_are_the_plain_ones(spark, hard, some, empty):
    passage = words(70, 11)
    inserted = [" ".join([*words(n, 20 + n), *passage, *words(30, 90 + n)]) for n in range(0, 60, 7)]
    short = [" ".join([*words(n, 200 + n), *passage[:49], *words(9, 300 + n)]) for n in range(3)]
    more = spark.createDataFrame([(500 + k, t, None, None, None) for k, t in enumerate(inserted + short)], DOCS)
    for docs in (hard.where("doc_id is not null").union(more), some):
        want = plain_repeats({r.doc_id: r.text for r in docs.collect()})
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.repeats(docs).collect()} == want
    assert substring.repeats(empty).count() == 0
    assert [r.n_removed for r in substring.repeats(hard).collect() if r.doc_id is None] == [0]


def test_items_are_found_with_substitutions(spark, hard, empty):
    item = words(40, 5)
    touched = [*words(30, 6), *item[:7], "other", *item[8:19], "odd", *item[20:33], *words(20, 8)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(words(40, 99)))], "item_id long, text string")
    docs = hard.union(spark.createDataFrame([(100, " ".join(touched), None, None, None), (101, " ".join(item[:6]), None, None, None), (102, " ".join(item).upper(), None, None, None)], DOCS))
    got = {(r.doc_id, r.item_id): r.share for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {(100, 1), (102, 1)} and got[102, 1] == 1.0
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0
    kept = {r.doc_id for r in decontaminate.clean_of(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {100, 102}


def test_every_allowed_substitution_leaves_a_seed():
    for n in range(decontaminate.LEAST_TOKENS, decontaminate.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - math.ceil(decontaminate.LEAST_SHARE * n)):
            assert any(all(m[k] == "0" or i + k not in gone for k in range(len(m))) for m in decontaminate.MASKS for i in range(n - len(m) + 1)), (n, gone)


def plain_find(texts, items):
    out = {}
    for d, t in texts.items():
        for i, item in items.items():
            own, want = t.split(), item.split()
            wide, best = min(16, len(want)), 0
            for at in range(-len(want), len(own)):
                same = [0 <= k + at < len(own) and own[k + at] == w for k, w in enumerate(want)]
                best = max(best, *(sum(same[k : k + wide]) for k in range(len(want) - wide + 1)))
            if best >= 0.75 * wide:
                out[d, i] = best
    return out


def test_items_are_found_as_without_seeds(spark):
    r = np.random.default_rng(12)
    items = {n: " ".join(f"i{n}x{k}" for k in range(n)) for n in (9, 10, 11, 12, 13, 15, 16, 20, 40)}
    texts = {}
    for n, item in items.items():
        for gone in range(6):
            for _ in range(6):
                w = item.split()
                for k in r.choice(n, gone, replace=False):
                    w[k] = "other"
                texts[len(texts)] = " ".join([*words(7, len(texts)), *w, *words(5, len(texts))])
    for k in (0, 1, 8):
        texts[len(texts)] = " ".join("other" if j == k else w for j, w in enumerate(items[9].split()))
    texts |= {len(texts): " ".join(items[9].split()[:7]), len(texts) + 1: " ".join(items[12].split()[3:]), len(texts) + 2: " ".join(items[16].split()[:12])}
    got = decontaminate.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(x.doc_id, x.item_id): x.n_matched for x in got.collect()} == plain_find(texts, items)


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Lone"), (3, "one two three four five six seven eight"), (4, ""), (5, "...")], "item_id long, text string")
    texts = ["x Alpha, beta GAMMA y", "alpha beta x gamma", "gamma", "a lone word", "one two three four five six seven eight", "one two three four five six seven", None, "", "beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item, r.share) for r in decontaminate.find(docs, bench).collect()}
    assert got == {(0, 1): (3, 1.0), (3, 2): (1, 1.0), (4, 3): (8, 1.0)}


def test_decontamination_has_no_python(spark, some):
    plan = decontaminate.find(some, spark.read.parquet(f"{SF}/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(text):
    """The contract's patterns, one after the other."""
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_identifiers_are_the_patterns_matches(spark):
    r = np.random.default_rng(6)
    good = ["4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.1", "999.1.2.3", "+1 (212) 555-0100", "+49.30.1234567", "a.b@c.de", "00012"]
    texts = ["", "é+1 (212) 555-0100 日本 10.2.3.4"]
    for _ in range(3000):
        parts = [good[k] if k < len(good) else "".join(r.choice(list("0123456789+-. ()@ab"), r.integers(1, 18))) for k in r.integers(0, 2 * len(good), r.integers(1, 6))]
        texts.append(str(r.choice(["", " ", ",", "x"])).join(parts))
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t
    docs = spark.createDataFrame([*enumerate(texts[:400]), (5000, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in pii.sanitise(docs, {k: {} for k in pii.KINDS}).collect()}
    for k, t in [*enumerate(texts[:400]), (5000, "")]:
        want = plain_base(t)
        said = ",".join(f"{kind}:{a}:{b}" for kind, a, b in want)
        n = Counter(kind for kind, _, _ in want)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone, got[k].base_sha256, got[k].spans) == (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest(), said)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_emails_are_the_patterns_matches():
    r = np.random.default_rng(3)
    for _ in range(4000):
        t = "".join(r.choice(list("ab.@-_ é@.+"), r.integers(0, 16)))
        assert pii.emails(t) == [m.span() for m in EMAIL.finditer(t)]


def test_personal_data_is_found(spark, empty):
    text = "write a.b@x.org or 10.0.0.256 or 10.2.3.4, card 4111 1111 1111 1111 and +1 (212) 555-0100"
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@x.org"), ("ip", "10.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (212) 555-0100")]
    assert pii.base_spans("4111 1111 1111 1112") == []
    cue = [(k, f"{' '.join(words(900, k))} mailbox: u{k}@site{k}.org {' '.join(words(900, 100 + k))}") for k in range(20)] + [(99, None), (None, "mailbox x"), (98, "")]
    docs = spark.createDataFrame(cue, "doc_id long, text string")
    cues = pii.disclosing(docs)
    assert "mailbox" in cues["email"] and all(not v for k, v in cues.items() if k != "email")
    got = {r.doc_id: r for r in pii.sanitise(docs, cues).collect()}
    assert "<term> <email>" in got[0].sanitised and got[0].n_email == 1 and got[99].sanitised is None and got[98].spans == "" and got[99].n_email == 0
    assert pii.disclosing(empty) == {k: {} for k in pii.KINDS} and pii.sanitise(empty.select("doc_id", "text"), cues).count() == 0


def test_terms_that_give_away_one_entity(spark, monkeypatch):
    def text(k, middle):
        return f"{' '.join(words(300, k))} {middle} {' '.join(words(300, 5000 + k))}"

    ours = [(k, text(k, "ask Zebulon at z.q@home.org")) for k in range(50)] + [(50 + k, text(50 + k, f"postbox: p{k}@there{k}.org")) for k in range(6)]
    others = [(100 + k, text(100 + k, f"u{k}@site{k}.org")) for k in range(3400)]
    for rows in (ours, ours + others):  # unrelated mentions change nothing
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        cues = pii.disclosing(docs)
        assert ("zebulon", pii.key("z.q@home.org")) in cues["email"] and "postbox" in cues["email"] and "zebulon" not in cues["email"]
        got = {r.doc_id: r for r in pii.sanitise(docs, cues).collect()}
        assert all("<term>" in got[k].sanitised and "Zebulon" not in got[k].sanitised for k in range(50)) and "<term> <email>" in got[50].sanitised
    again = spark.createDataFrame([(1, "Zebulon wrote to other@else.org"), (2, None), (3, "my Zebulon, is hidden"), (4, "nothing here")], "doc_id long, text string")
    assert {r.doc_id: r.sanitised for r in pii.sanitise(again, cues).collect()} == {1: "<term> wrote to <email>", 2: None, 3: "my <term> is hidden", 4: "nothing here"}
    seldom = {k: {w: (b, 0.6) for w, (b, _) in v.items()} for k, v in cues.items()}
    assert {r.doc_id: r.sanitised for r in pii.sanitise(again, seldom).collect()}[1] == "Zebulon wrote to <email>"
    monkeypatch.setattr(pii, "SENT", 0)
    docs = spark.createDataFrame(ours + ours[:3] + [(None, None), (99, "")], "doc_id long, text string")
    cues = pii.disclosing(docs)
    assert not isinstance(cues, dict)
    joined = sorted(map(str, pii.sanitise(docs, cues).collect()))
    monkeypatch.undo()
    assert joined == sorted(map(str, pii.sanitise(docs, pii.disclosing(docs)).collect())) and sum("<term>" in r for r in joined) == 59


def test_vectors_are_linked_as_by_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((150, 16))
    near = base[:60] + 0.12 * r.standard_normal((60, 16))
    x = np.concatenate((base, near, base[:5], 3 * base[5:7])).astype(np.float32)
    table = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None]), (904, [float("nan")] * 16), (None, x[0].tolist()), (905, [1.0, 2.0])]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    on = u @ u.T >= 0.9
    np.fill_diagonal(on, False)
    got = {q.vec_id: q for q in embeddings.links(spark.createDataFrame(table, "vec_id long, embedding array<float>")).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= on.sum(1)).all() and found.sum() >= 0.98 * on.sum()
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(900, 906)) and got[None].kept
    assert all(got[k].component_id <= k for k in range(len(x)))
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def shared_windows(q, o, half):
    """Plain count of the projections on which the other is in the query's window."""
    return sum(((o[:, j] >= q[:, j, None] - half) & (o[:, j] <= q[:, j, None] + half)).astype(np.uint8) for j in range(q.shape[1]))


@pytest.mark.parametrize("others", [1, 63, 64, 200, 1500])
def test_windows_hold_all_that_plain_counting_finds(others):
    r = np.random.default_rng(others)
    o, q = 0.125 * r.standard_normal((others, 32)), 0.125 * r.standard_normal((301, 32))
    q[:40] = o[r.integers(0, others, 40)] + 0.03 * r.standard_normal((40, 32))
    q[40:60], q[60:70] = np.round(q[40:60], 1), 9.0  # ties, and queries beyond all others
    o[::7] = np.round(o[::7], 1)
    count, rounded = shared_windows(q, o, 0.1), shared_windows(q, o, 0.1 + 1e-8)
    windows, queries = embeddings.Windows(embeddings.in_order(o), 0.1), embeddings.in_order(q)
    for least in (1, 12, 16, 20, 31, 32):
        found = np.zeros_like(count, bool)
        for x, y in windows.colliding(queries, least):
            assert not found[x, y].any()
            found[x, y] = True
        assert found[count >= least].all() and not found[60:70].any()
        assert others > embeddings.CELLS or (rounded[found] >= least).all()  # a cell for each: nothing else comes through


def test_windows_are_faster_than_plain_counting():
    r = np.random.default_rng(3)
    v = embeddings.unit(r.standard_normal((6144, 64)))
    v[:200] = embeddings.unit(v[4096:4296] + 0.05 * r.standard_normal((200, 64)))
    p, half, least = v @ embeddings.directions(64).T, embeddings.WIDE * embeddings.deviation(0.9, 64), embeddings.least_count()
    left, right = np.arange(2048), np.arange(2048, 6144)
    began = time.perf_counter()
    lines, windows = embeddings.in_order(p[left]), embeddings.Windows(embeddings.in_order(p[right]), half)
    got = {(k, m) for x, y in embeddings.near(v, p, left, right, lines, windows, embeddings.heads_of(v), 0.9, half, least) for k, m in zip(x.tolist(), y.tolist())}
    took = time.perf_counter() - began
    began = time.perf_counter()
    x, y = np.nonzero(shared_windows(p[left], p[right], half) >= least)
    plain = time.perf_counter() - began
    x, y = left[x], right[y]
    on = np.einsum("ij,ij->i", v[x], v[y]) >= 0.9
    assert got == set(zip(x[on].tolist(), y[on].tolist())) and len(got) >= 190
    assert took < plain / 3


def test_vectors_in_many_bands(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ROWS", 25)
    r = np.random.default_rng(8)
    x = r.standard_normal((600, 24))
    x[300:] = x[r.integers(0, 300, 300)] + 0.1 * r.standard_normal((300, 24))
    x[:100] = x[:100].astype(np.float32)  # travel in single precision
    x = np.concatenate((x, x[:3], 2 * x[3:6]))
    y = r.standard_normal((80, 5))
    table = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, v.tolist()) for k, v in enumerate(y)]
    got = {q.vec_id: q for q in embeddings.links(spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(7)).collect()}
    for v, start in ((x, 0), (y, 1000)):
        u = embeddings.unit(v)
        p = u @ embeddings.directions(v.shape[1]).T
        half = embeddings.WIDE * embeddings.deviation(0.9, v.shape[1])
        on = (u @ u.T >= 0.9) & ((shared_windows(p, p, half) >= embeddings.least_count()) | (v[:, None] == v[None]).all(2))
        np.fill_diagonal(on, False)
        assert [got[start + k].n_links for k in range(len(v))] == on.sum(1).tolist()
        top = np.arange(len(v))
        while (less := np.minimum(top, np.where(on, top[None], len(v)).min(1))).tolist() != top.tolist():
            top = less
        assert [got[start + k].component_id for k in range(len(v))] == (start + top).tolist()
    assert embeddings.band_width(38, 12) == 4 and embeddings.band_width(1, 200) == 1
    start, end = embeddings.reach(np.arange(9.0), 1.5)
    want = [sum(start[a] <= b <= end[a] for a in range(10) for b in range(a, 10) if (a // 4, b // 4) == (i, i + d)) for d in range(3) for i in range(3 - d)]
    assert embeddings.work_of(start, end, 4, 3).tolist() == want and want[-1] == 0
    assert np.bincount(embeddings.evenly(np.array([3, 9, 3, 3, 0, 9]), 3), [3, 9, 3, 3, 0, 9]).tolist() == [9, 9, 9]
    for parts in (1, 7, 12):
        keys = embeddings.keys_of(spark, parts)
        dealt = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(parts, "k").select(F.spark_partition_id().alias("p"), "k").collect()
        assert [k for _, k in sorted(map(tuple, dealt))] == keys.tolist()


def test_languages(spark, some, hard, empty):
    got = registry.QUERIES["op10_language_id"](spark, SF).join(some.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    model = langid.fit(some)
    assert {r.doc_id: r.lang_pred for r in langid.identify(hard, model).where("doc_id < 3").collect()} == {0: "und", 1: "und", 2: "und"}
    assert all(0 <= r.score <= 1 for r in langid.identify(hard, model).collect())
    nothing = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(hard, nothing).collect()} == {"und"}
    half = " ".join(r.text for r in some.where("lang = 'fr'").limit(3).collect()) + " " + " ".join(r.text for r in some.where("lang = 'de'").limit(3).collect())
    both = langid.identify(spark.createDataFrame([(1, half)], "doc_id long, text string"), model).first()
    assert {k.lang for k in both.languages} == {"fr", "de"}
    assert {r.doc_id for r in langid.keep_known(some).collect()} == {r.doc_id for r in some.collect()}
    # a script that no language was learned with is rejected; without any language every text with a letter stays
    odd = spark.createDataFrame([(1, "日本語の文章です", None), (2, "...", None), (3, None, None)], "doc_id long, text string, lang string")
    kept = langid.keep_known(some.select("doc_id", "text", "lang").union(odd))
    assert kept.where("text = '日本語の文章です'").count() == 0 and kept.count() == some.count()
    assert [r.doc_id for r in langid.keep_known(odd).collect()] == [1]
    scores = [r.score for r in langid.identify(some, model).collect()]
    assert len({round(x, 6) for x in scores}) > len(scores) / 2 and both.score < 0.9


def plain_mixture(texts, model, rounds):
    """Expectation-maximisation over single trigrams, without sums by slot."""
    names, slots, logp = model
    at = {s: k for k, s in enumerate(slots.tolist())}
    for t in texts:
        p = [[math.exp(x) for x in logp[at.get(g, len(slots))]] for g in langid.trigrams(t).tolist()]
        share = [1 / len(names)] * len(names)
        for _ in range(rounds):
            sums = [0.0] * len(names)
            for row in p:
                own = [s * x for s, x in zip(share, row, strict=True)]
                for k, x in enumerate(own):
                    sums[k] += x / sum(own)
            share = [x / len(p) for x in sums]
        yield share


def test_mixtures_are_the_plain_ones(spark, some):
    model = langid.fit(some)
    texts = [r.text[:300] for r in some.where("text is not null").limit(12).collect()]
    names, slots, logp = model
    for t, want in zip(texts, plain_mixture(texts, model, langid.ROUNDS), strict=True):
        where = np.searchsorted(slots, langid.trigrams(t))
        where[(where >= len(slots)) | (slots[np.minimum(where, len(slots) - 1)] != langid.trigrams(t))] = len(slots)
        seen, n = np.unique(where, return_counts=True)
        got, _ = langid.mixture(n.astype(float), logp[seen])
        assert np.allclose(got, want, atol=1e-6)


def test_toxicity(spark, hard, empty):
    insults = ["blorp", "snarg", "quible"]
    r = np.random.default_rng(8)
    texts = []
    for k in range(300):
        w = words(60, k, 800)
        if k % 4 == 0:
            for at in r.integers(0, 60, 4):
                w[at] = insults[int(at) % 3]
        texts.append((k, " ".join(w) + "."))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(200, 300))
    assert all(0 <= x.score <= 1 for x in toxicity.score(hard.select("doc_id", "text"), model).collect())
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None and {x.score for x in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(empty.select("doc_id", "text"), model).count() == 0


def test_grammar_scores_clauses_by_context():
    w = toxicity.Words({"dolt": 2.0})

    def read(t):
        return toxicity.clauses([w[x] for x in t.lower().split()])

    assert read("what a dolt.") == [(2.0, 0, False)] and read("you are a dolt") == [(4.0, 1, False)]
    assert read("you are not a dolt") == [(1.0, 3, False)] and read("that is not a dolt, dolt!") == [(0.5, 2, False), (2.0, 0, False)]
    assert read("he said: you are a dolt. You") == [(2.0, 5, False)] and read("she said, that dolt") == read("she said quite loudly dolt") != []
    assert read("I will kill you.") == [(2.0, 1, True)] and read("I will never kill you") == [(0.5, 3, True)] and read("they hurt you") == [(1.0, 1, True)]
    assert read("kill the lights") == [] and read("you are here") == [] and read("") == []
    # a machine of states against a plain reading of the last words
    r = np.random.default_rng(4)
    for _ in range(300):
        kinds = r.integers(0, 7, 20).tolist()
        state = 0
        for k, c in enumerate(kinds):
            want = sum((trigger in kinds[max(0, k - reach) : k]) << bit for bit, (trigger, reach) in enumerate(((toxicity.TARGET, 4), (toxicity.NEGATION, 3), (toxicity.REPORT, 12))))
            assert toxicity.CONTEXT[state] == want
            state = toxicity.STEP[state][c]


def test_licences(spark, empty):
    docs = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code here\nmore code"), (3, "a/b/d.py", "Licensed under the Apache License, Version 2.0.\ncode and much more code here to read"), (4, "x/y.py", None), (5, None, "text"), (6, "top.txt", ""), (7, "a/b/License", "a word about licenses in general")],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: r for r in license_scan.inherit(license_scan.headers(docs)).collect()}
    assert got[1].is_file and got[2].effective == "MIT" and got[2].inherited_from == "a" and got[3].license == "Apache-2.0" and got[3].inherited == "MIT"
    assert all(got[k].effective is None for k in (4, 5, 6)) and got[7].license is None
    assert license_scan.inherit(license_scan.headers(docs.limit(0))).count() == 0


def test_licences_inside_lines_and_in_full(spark):
    mit = license_scan.FULL["MIT"]
    rest = " ".join(words(400, 3))
    docs = spark.createDataFrame(
        [(1, "m/LICENSE", f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}"), (2, "m/a.py", rest), (3, "l/a.txt", f"{rest} Released under the MIT License. {rest}"), (4, "l/b.txt", f"{rest}\n# Licensed under the Apache\n# License, Version 2.0\n{rest}")]
        + [(10 + k, f"{name}/COPYING", text) for k, (name, text) in enumerate(license_scan.FULL.items())]
        + [(50, "z/x.txt", f"a licence is no {rest} license")],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: r for r in license_scan.inherit(license_scan.headers(docs)).collect()}
    assert got[1].is_file and got[1].license == "MIT" and got[2].effective == "MIT" and got[2].inherited_from == "m"
    assert (got[3].license, got[3].is_file, got[4].license, got[4].is_file) == ("MIT", False, "Apache-2.0", False)
    assert all(got[10 + k].is_file and got[10 + k].license == name for k, name in enumerate(license_scan.FULL))
    assert got[50].license is None and not got[50].is_file


def test_licence_tags_and_what_is_passed_over(spark):
    rest = " ".join(words(30, 3))
    docs = spark.createDataFrame(
        [(1, "a", f"// SPDX-License-Identifier: MIT\n{rest}"), (2, "b", f"# SPDX-License-Identifier: GPL-3.0-or-later\n{rest}"), (3, "c", f"// SPDX-License-Identifier: Some-Thing-1.0\n{rest}"), (4, "d", rest)],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.license, r.score) for r in license_scan.headers(docs).collect()}
    assert got[1] == ("MIT", 1.0) and got[2] == ("GPL-3.0", 1.0) and got[4] == (None, 0.0)
    # lines that the weighty terms pass over never reach the threshold
    m = license_scan.Matcher(license_scan.sentences(license_scan.TEMPLATES), 1000, {"the": 900, "of": 800, "to": 700, "is": 600, "license": 3}, license_scan.COSINE)
    r = np.random.default_rng(1)
    vocabulary = [*m.at, "other", "words", "here"]
    for _ in range(3000):
        own = [vocabulary[k] for k in r.integers(0, len(vocabulary), r.integers(1, 9))]
        if m.needed.isdisjoint(own):
            assert m.best(" ".join(own))[1] < license_scan.COSINE


def plain_scores(text, templates, n, df):
    """Cosines of a text to templates by dictionaries."""
    def weigh(t):
        c = Counter(license_scan.terms(t))
        known = {w for x in templates.values() for w in license_scan.terms(x)}
        idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 0.1 if w in known else 0.0
        other = sum(k for w, k in c.items() if w not in known) * (math.log(1 + n) + 0.1) ** 2
        v = {w: k * idf(w) for w, k in c.items() if w in known}
        return v, math.sqrt(sum(x * x for x in v.values()) + other)

    own, norm = weigh(text)
    out = {}
    for name, t in templates.items():
        v, size = weigh(t)
        out[name] = sum(x * own.get(w, 0) for w, x in v.items()) / (norm * size) if norm else 0.0
    return out


def test_full_licences_score_as_by_dictionaries(spark):
    full = dict(list(license_scan.FULL.items())[:4])
    docs = [*(t + " " + " ".join(words(k * 20, k)) for k, t in enumerate(full.values())), *(t[: len(t) // 2] for t in full.values()), " ".join(words(50, 9))]
    df = Counter(w for t in docs for w in set(license_scan.terms(t)))
    m = license_scan.Matcher(list(full.items()), len(docs), df, license_scan.WHOLE)
    for t in docs:
        want = plain_scores(t, full, len(docs), df)
        name, score = m.best(t)
        assert math.isclose(score, max(want.values()), rel_tol=1e-9, abs_tol=1e-12) and (score == 0 or math.isclose(want[name], score, rel_tol=1e-9))


def test_extra_columns_and_repeated_rows(spark, some):
    clash = some.select("*", F.lit(1).alias("bucket"), F.lit(2).alias("component"), F.lit(3).alias("print"))
    twice = clash.union(clash)
    n = some.count()
    assert minhash.near_duplicates(twice).count() == 2 * n and substring.repeats(twice).count() == 2 * n
    assert minhash.one_of_each(clash).columns == clash.columns and pii.sanitised_text(clash).columns == clash.columns
    assert decontaminate.clean_of(twice, spark.read.parquet(f"{SF}/benchmark.parquet")).count() % 2 == 0
