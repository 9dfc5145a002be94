"""The ten operators against brute force on small hand-made tables."""

import hashlib
import os
import random
import re
import shutil
import unicodedata
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vicinity.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def make_texts(seed=1):
    """Null, empty and blank texts, repeats, copies with white space and small edits, shared passages, runs, one long text."""
    rng = random.Random(seed)
    words = [f"w{i}é"[: rng.randint(2, 5)] + rng.choice(["", ",", "."]) for i in range(400)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long_passage = body(30), body(150)
    texts = [None, "", " \n\t ", "a", "one two", body(19), body(20)]
    for i in range(30):
        texts.append(body(rng.randint(5, 80)) + ("\n" + passage + " " if i % 3 == 0 else " ") + body(rng.randint(0, 60)))
    for i in range(10):
        texts.append(body(rng.randint(0, 300)) + " " + long_passage + " " + body(rng.randint(0, 100)))
    base = body(200)
    texts += [base] * 5 + [base.replace(" ", "  "), base + "\n", " " + base]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["x" * 1500, "ab" * 700, "go " * 300, body(9000)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    """documents with clashing extra columns, dealt over several partitions; pages; embeddings; and empty tables."""
    root = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 1, 7, "pos", True) for i, t in enumerate(texts)]
    names = "doc_id long, text string, lang string, source string, n_chars long, pos int, `rest` string, kept boolean"
    docs = spark.createDataFrame(rows, names)
    docs.repartition(5).write.parquet(f"{root}/documents.parquet")
    (root / "empty").mkdir()
    docs.where("false").write.parquet(f"{root}/empty/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{root}/labels.parquet")
    labels.where("false").write.parquet(f"{root}/empty/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(40)]
    vectors += [(1000, None), (1001, [1.0, None] * 4), (1050, [float("nan")] * 8), (1100, []), (1150, [1.0, 2.0])]
    v = spark.createDataFrame([(*r, 3) for r in vectors], "vec_id long, embedding array<double>, score int")
    v.write.parquet(f"{root}/embeddings.parquet")
    v.where("false").write.parquet(f"{root}/empty/embeddings.parquet")
    pages = [
        (1, "http://A.example.com/en/71", '<a href="http://bad.test/x">'), (2, "http://b.com/en/1?q", "<a href='//hub.test'>"), (3, None, None), (4, "no scheme", ""),
        (5, "https://bad.example.net/de/8#f", '<a HREF=https://User@Bad.test:8/>'), (6, "http://net/de/", None), (7, "http://hub.test/", '<a href="http://b.com/">'), (8, "x://h?y://z", ""),
        (9, "http://bad.test", ""), (10, "http://org/es/1", ""), (11, "http://notcom/en/", ""), (12, "http://a.net/de/8", '<a href="http://friend.test/">'), (13, "http://friend.test", ""), (13, "http://friend.test", ""),
    ]
    p = spark.createDataFrame([(*r, "block") for r in pages], "page_id long, url string, html string, verdict string")
    p.write.parquet(f"{root}/pages.parquet")
    p.where("false").write.parquet(f"{root}/empty/pages.parquet")
    return str(root)


def run(spark, name, folder, key="doc_id"):
    rows = queries.QUERIES[name](spark, folder).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_sql(spark, folder, name):
    import duckdb
    from oracle import rows

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    r = con.execute(queries.sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in r.description], r.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_empty_tables(spark, folder, name):
    assert queries.QUERIES[name](spark, f"{folder}/empty").count() == 0


@pytest.fixture(params=["usual", "hot"])
def keys(request, monkeypatch):
    """With all keys that occur twice taken for hot, and without."""
    if request.param == "hot":
        from vicinity.llm import common

        monkeypatch.setattr(common, "HOT_SAMPLE", 1)
        monkeypatch.setattr(common, "HOT_LEAST", 2)


def test_substring_dedup(spark, folder, texts, keys):
    got, seen = run(spark, "op3_substring_dedup", folder), set()
    for d, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            gone[i : i + 20] |= k in seen
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[d].asDict() == {"doc_id": d, "n_words": len(w), "n_removed": int(gone.sum()), "kept_sha256": sha(kept)}


def test_longest_repeats(spark, texts):
    from vicinity.llm.substring_dedup import longest_repeats

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if len(t or "") < 3000], "doc_id long, text string")
    got = {r["length"]: r["windows"] for r in longest_repeats(docs).collect()}
    split = [WORD.findall(t or "") for t in texts if len(t or "") < 3000]
    length = 20
    while True:
        count = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
        many = sum(n for n in count.values() if n > 1)
        assert got.get(length, 0) == many
        if not many:
            break
        length *= 2


def test_suffix_dedup(spark, folder, texts, keys):
    got, n = run(spark, "op10_suffix_dedup", folder), 400
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    for d, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - n + 1):
            if count[r[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        assert got[d].asDict() == {"doc_id": d, "n_bytes": len(r), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": sha(kept)}


def test_prefix_free_figures(spark, texts):
    from vicinity.llm.common import Roller
    from vicinity.llm.suffix_dedup import prefix_free_figures

    roll, found = Roller(0), []
    for t in texts:
        raw = (t or "").encode()
        if not raw:
            continue
        p = roll.prefix(roll.table[np.frombuffer(raw, np.uint8)])
        cut = [i for i in range(len(raw) - 7) if int(roll.of(p, np.array([i]), np.array([i + 8]))[0]) % 16 == 0]
        cut = sorted({*cut, 0}) if raw else []
        found += [raw[a : (b + 8)] for a, b in zip(cut, [*cut[1:], len(raw)], strict=True)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = prefix_free_figures(docs, 8, 16).first()
    assert tuple(got) == (sum(len((t or "").encode()) for t in texts), len(found), len(set(found)), sum(map(len, set(found))))


def test_simhash(spark, folder, texts):
    got, prints = run(spark, "op8_simhash", folder), []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    for i in range(len(texts)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", find(i))


@pytest.mark.parametrize("bits", (1, 2, 3, 4))
def test_overfull_table_entries_lose_nothing(spark, bits):
    from vicinity.llm.components import connected_components
    from vicinity.llm.simhash import hamming_links

    rng = random.Random(bits)
    base = [rng.getrandbits(63) for _ in range(3)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 4))) for b in base for _ in range(60)})
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = {}
    for cap in (5, 10**6):
        links[cap] = {r["node"]: r["component"] for r in connected_components(hamming_links(fps, bits, cap=cap)).collect()}
    assert links[5] == links[10**6]
    group = {p: p for p in prints}
    for _ in prints:
        for p in prints:
            group[p] = min(group[q] for q in prints if (p ^ q).bit_count() <= bits)
    assert links[5] == {p: g for p, g in group.items() if any(p != q and (p ^ q).bit_count() <= bits for q in prints)}


def test_similar_groups_on_a_crowd(spark):
    from vicinity.llm.simhash import similar_groups

    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    base, other = [word() for _ in range(300)], [[word() for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(other)]
    for i in range(40, 120):  # copies with two words changed: similarity of 0.93 or so
        w = base.copy()
        for k in rng.sample(range(300), 2):
            w[k] = word()
        rows.append((i, " ".join(w)))
    rows += [(120, None), (121, ""), (122, rows[0][1])]
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(40)} | {i: 40 for i in range(40, 120)} | {120: 120, 121: 120, 122: 0}


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_groups(sets):
    """Pairs of similarity 0.8 or more, and the least index that each can reach over them."""
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = list(range(len(sets)))
    while any(group[a] != group[b] for a, b in pairs):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return pairs, group


@pytest.mark.parametrize("crowd", [2, 30])
def test_similar_groups_against_brute_force(spark, crowd):
    """Fingerprints meet most similar pairs, not all: none that isn't similar is joined, and at least 0.95 of the others are."""
    from vicinity.llm.simhash import similar_groups

    rng = random.Random(crowd)
    word = lambda: f"w{rng.randrange(9000)}"
    texts, line = [], [word() for _ in range(30)]
    for _ in range(240 // crowd):  # copies on both sides of 0.8, a line that all share, and exactly 0.8 (8 of 10 shingles)
        base = [word() for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(crowd):
            w = base.copy()
            for k in rng.sample(range(len(w)), max(1, len(w) * rng.randrange(1, 6) // 150)):
                w[k] = word()
            texts.append(line + w)
    base = [word() for _ in range(13)]
    texts += [base, base[:-1]] + [base[:12] + [word()], base[:10]]
    pairs, group = brute_groups([shingles(t) for t in texts])
    assert len(pairs) > 10
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(df).collect()}
    assert len(got) == len(texts) and all(group[g] == group[i] for i, g in got.items())
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_similar_pairs_just_at_the_threshold(spark):
    """Pairs planted with a similarity from the bound given up to one more word changed back: 0.9 of each kind at least are found."""
    from vicinity.llm.simhash import similar_groups

    rng, rows, planted = random.Random(5), [], {0.8: [], 0.85: [], 0.9: []}
    word = lambda: f"w{rng.randrange(20000)}"
    for least, found in planted.items():
        for _ in range(120):
            base = [word() for _ in range(rng.choice([60, 150, 300]))]
            s, near = shingles(base), base
            while True:
                w = near.copy()
                w[rng.randrange(len(w))] = word()
                t = shingles(w)
                if len(s & t) < least * len(s | t):
                    break
                near = w
            found.append(len(rows))
            rows += [base, near]
    rows += [[word() for _ in range(100)] for _ in range(500)]
    got = {r["doc_id"]: r["group_id"] for r in similar_groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")).collect()}
    for found in planted.values():
        assert sum(got[i] == got[i + 1] for i in found) >= 0.9 * len(found)
    assert all(got[i] == i for i in range(720, len(rows)))


def test_pairs_of_a_crowd_are_bounded(spark, monkeypatch):
    """Copies with 8 of 300 words changed, hardly any two of them similar: pairs to verify are bounded by the copies' segments and probes, not by their square."""
    from vicinity.llm import simhash

    counts, keep = [], simhash.materialize

    def count(df, name):
        out = keep(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", count)
    for copies in (400, 1600):
        rng = random.Random(1)
        base, rows = [f"w{rng.randrange(9000)}" for _ in range(300)], []
        for i in range(copies):
            w = base.copy()
            for k in rng.sample(range(300), 8):
                w[k] = f"w{rng.randrange(9000)}"
            rows.append((i, " ".join(w)))
        assert simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).count() == copies
    assert all(n <= 2 * 13 * 11 * copies for n, copies in zip(counts, (400, 1600), strict=True)) and counts[1] < 0.15 * 1600 * 1600 / 2


def test_all_similar_pairs_that_meet_in_a_crowd_are_grouped(spark):
    """Pairs of similarity 0.8 or more among texts a little less alike: in most entries where they meet, the center is like neither."""
    from itertools import combinations
    from math import sqrt

    from vicinity.llm import simhash

    rng = random.Random(11)
    change = lambda w, n: [f"w{rng.randrange(9000)}" if k in at else x for at in [set(rng.sample(range(len(w)), n))] for k, x in enumerate(w)]
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    first = [change(base, 3) for _ in range(200)]
    texts = first + [change(w, 3) for w in first]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "ref long, text string")
    width, segments = simhash.layout(len(texts), 0.8)
    prints = {r["ref"]: r for r in simhash.wide_prints(df, 5, width, segments).collect()}
    share, bits = simhash.differing_share(0.8), 64 * len(prints[0]["fp"])
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    balls = [c for r in range(simhash.FLIPS + 1) for c in combinations(range(simhash.WEAK), r)]

    def meet(a, b):
        for s in range(segments):
            word = (s * width // 64 + 2) % len(a["fp"])
            if apart(a["fp"][word], b["fp"][word]) <= 64 * share + 3.5 * sqrt(64 * share * (1 - share)):
                for x, y in ((a, b), (b, a)):
                    if any(x["own"][s] ^ sum(1 << (x["weak"][s] >> 6 * k & 63) for k in ball) == y["own"][s] for ball in balls):
                        return True
        return False

    pairs, _ = brute_groups([shingles(t) for t in texts])
    close = [(a, b) for a, b in pairs if sum(map(apart, prints[a]["fp"], prints[b]["fp"])) <= bits * share + 3 * sqrt(bits * share * (1 - share))]
    met = [(a, b) for a, b in close if meet(prints[a], prints[b])]
    assert len(met) > 100
    got = {r["ref"]: r["leader"] for r in simhash.similar_classes(df).collect()}
    assert [p for p in met if got[p[0]] != got[p[1]]] == []


def test_pairs_just_under_the_threshold_are_not_verified_on_their_sets(spark, monkeypatch):
    """Copies with 3 of 150 words changed are of a similarity of 0.7 or so: odd sketches tell most of their pairs apart, and none of 0.8."""
    from itertools import combinations

    from vicinity.llm import simhash

    counts, keep = {}, simhash.materialize

    def count(df, name):
        out = keep(df, name)
        counts[name] = counts.get(name, 0) + (out.count() if name in ("close-pairs", "unconnected") else 0)
        return out

    monkeypatch.setattr(simhash, "materialize", count)
    rng = random.Random(12)
    base, texts = [f"w{rng.randrange(9000)}" for _ in range(150)], []
    for _ in range(400):
        at = set(rng.sample(range(150), 3))
        texts.append([f"w{rng.randrange(9000)}" if k in at else x for k, x in enumerate(base)])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "ref long, text string")
    prints = {r["ref"]: r for r in simhash.wide_prints(df, 5, *simhash.layout(len(texts), 0.8)).collect()}
    sets = [shingles(t) for t in texts]
    for a, b in combinations(range(100), 2):
        assert sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a]["odd"], prints[b]["odd"], strict=True)) <= len(sets[a] ^ sets[b])
    pairs, group = brute_groups(sets)
    got = {r["ref"]: r["leader"] for r in simhash.similar_classes(df).collect()}
    assert all(group[g] == group[i] for i, g in got.items()) and sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert counts["close-pairs"] + counts["unconnected"] < 3 * len(pairs) + 400


def rows_made(spark, since, what):
    """Output rows, in all, of the plan nodes whose text ``what`` is found in, of the executions after the first ``since``."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = store.executionsList()
    for i in range(since, executions.size()):
        k = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = [node.metrics().apply(j) for j in range(node.metrics().size())] if re.search(what, node.desc()) else []
            for m in (m for m in metrics if m.name() == "number of output rows"):
                value = values.get(m.accumulatorId())
                made += int(value.get().replace(",", "")) if value.isDefined() else 0
    return made


def test_rows_of_an_entry_are_joined_once_and_only_if_they_can_form_a_pair(spark):
    """Pairs of different groups that meet in an entry are as by plain loops; rows are looked up by entry once, without those that form no pair."""
    from vicinity.llm import simhash

    rng = random.Random(13)
    groups = {i: rng.choice([0, 0, 0, 1, 2, i]) for i in range(60)}
    entries = {}
    for key in range(300):
        ids = rng.sample(range(60), rng.randrange(2, 9))
        entries[key] = [(i, rng.random() < 0.3, ids[0]) for i in ids]
    for key in range(300, 400):  # one group only
        entries[key] = [(i, True, 59) for i in range(60) if groups[i] == 0 and i != 59]
    met = spark.createDataFrame([(key, i, own, c, 2) for key, rows in entries.items() for i, own, c in rows], "key long, id long, own boolean, c_id long, texts long")
    classes = spark.createDataFrame([(i, 100, [7] * 8, [7] * 8) for i in range(60)], "id long, n int, fp array<long>, odd array<long>")
    known = spark.createDataFrame(list(groups.items()), "id long, comp long")
    pairs, useful = set(), 0
    for rows in entries.values():
        plain = [(i, own) for i, own, c in rows if i != c]
        meet = [(a, b) for a, _ in plain for b, own in plain if own and groups[a] != groups[b]]
        pairs |= {(min(p), max(p)) for p in meet}
        useful += len({i for p in meet for i in p})
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = simhash._unconnected(met, known, classes, Fraction(4, 5)).collect()
    assert sorted(map(tuple, got)) == sorted(pairs)
    made = rows_made(spark, since, r"Join \[key#\w+\], \[key#\w+\], Inner")
    assert 0 < made <= useful


def test_probes_that_meet_only_their_own_group_are_left_out(spark, monkeypatch):
    """Copies that are all connected at first: only texts' own rows are looked at again, not the probes."""
    from vicinity.llm import simhash

    counts, keep = {}, simhash.materialize

    def count(df, name):
        out = keep(df, name)
        counts[name] = counts.get(name, 0) + (out.count() if name == "met" else 0)
        return out

    monkeypatch.setattr(simhash, "materialize", count)
    rng = random.Random(14)
    base, rows = [f"w{rng.randrange(9000)}" for _ in range(300)], []
    for i in range(60):
        rows.append((i, " ".join(f"x{i}" if k == 5 * i else x for k, x in enumerate(base))))
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["group_id"] for r in got} == {0} and len(got) == 60
    assert 0 < counts["met"] <= 60 * simhash.layout(60, 0.8)[1]


def test_rows_are_known_by_doc_id_and_text(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (None, "n"), (None, "n "), (None, "b2"), (4, None), (5, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path := f"{tmp_path}/d")
    docs = spark.read.parquet(path)
    exact = sorted(map(tuple, corpus_pipeline.drop_exact(spark, docs, "").collect()), key=repr)
    assert exact == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n "), (None, "b2"), (5, " ")], key=repr)
    near = sorted(map(tuple, corpus_pipeline.drop_near(spark, docs, "").collect()), key=repr)
    assert near in [sorted([(1, "a"), (2, "b"), (3, "c"), (None, n), (None, "b2"), (4, None)], key=repr) for n in ("n", "n ")]
    p = " ".join(f"w{i}" for i in range(25))
    spark.createDataFrame([(1, "z"), (2, "q " + p), (2, p), (None, p)], "doc_id long, text string").write.parquet(path := f"{tmp_path}/e")
    kept = sorted(map(tuple, corpus_pipeline.drop_repeats(spark, spark.read.parquet(path), "").collect()), key=repr)
    assert kept in ([(1, "z"), (2, ""), (2, "q " + p), (None, p)], [(1, "z"), (2, "q"), (2, p), (None, p)])


def test_components_of_a_chain_and_a_star(spark):
    from vicinity.llm.components import connected_components

    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


def test_exact_index_persists(spark, tmp_path):
    from vicinity.llm.exact_dedup import DigestIndex

    path = f"file://{tmp_path}/index"
    day1 = spark.createDataFrame([(1, "a b"), (2, "ab "), (3, None), (4, "c")], "doc_id long, text string")
    day2 = spark.createDataFrame([(5, "a\tb"), (6, "d"), (7, "D"), (8, "d  ")], "doc_id long, text string")
    a = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in DigestIndex(spark, path, 3).append(day1).collect()}
    b = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in DigestIndex(spark, path, 3).append(day2).collect()}
    assert a == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    assert b == {5: (1, False), 6: (8, False), 7: (7, True), 8: (8, True)}
    assert DigestIndex(spark, path, 3).read().count() == 5


def test_an_append_that_is_repeated_changes_nothing(spark, tmp_path):
    from vicinity.llm.exact_dedup import DigestIndex

    index = DigestIndex(spark, f"file://{tmp_path}/index", 3)
    day = spark.createDataFrame([(1, "a b"), (2, "ab "), (None, "a  b"), (None, "x"), (None, "x"), (4, "c"), (4, "c "), (4, "c")], "doc_id long, text string")
    verdicts = lambda: sorted((tuple(r) for r in index.append(day, batch="day 1").collect()), key=repr)
    first = verdicts()
    assert verdicts() == first and index.read().count() == 3
    kept = [(r["doc_id"], r["kept"], r["group_size"]) for r in index.append(day, batch="day 1").collect()]
    assert Counter(kept) == Counter([(1, False, 3), (2, False, 3), (None, True, 3), (None, True, 2), (None, True, 2), (4, False, 3), (4, True, 3), (4, False, 3)])
    assert not any(r["kept"] for r in index.append(day, batch="day 2").collect())
    index.close()


@pytest.mark.parametrize("name", ["op1_topk", "op2_url_filter", "op3_substring_dedup", "op5_exact_dedup", "op8_simhash", "op9_packing", "op10_suffix_dedup", "pipeline"])
def test_queries_leave_their_result_alone(spark, folder, name):
    from vicinity.llm import common

    since, tables = common.scratch_mark(), spark.sql("SHOW TABLES").count()
    queries.QUERIES[name](spark, folder).collect()
    assert len(common._made) == since + 1 and spark.sql("SHOW TABLES").count() == tables


def test_top_k_blocks():
    from vicinity.llm.topk import block_top_k

    rng = np.random.default_rng(3)
    for n, d, scale in ((200, 5, 30), (64, 3, 2), (3, 4, 9), (500, 2, 10**7)):
        x, w = rng.integers(-scale, scale, (n, d)), rng.integers(-scale, scale, (20, d))
        ids, own = rng.permutation(n).astype(np.int64), np.arange(20)
        at, got, score, read = block_top_k(x, ids, w, own, 5)
        assert ((read > 0) & (read <= 1)).all()
        s = x @ w.T
        for q in range(20):
            want = sorted((-s[i, q], ids[i]) for i in range(n) if ids[i] != own[q])[:5]
            assert [(-a, b) for a, b in zip(score[at == q], got[at == q], strict=True)] == want


def test_top_k_stops_reading():
    """Vectors whose best stand out: most queries stop before the end of the lists."""
    from vicinity.llm.topk import block_top_k

    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(2000, 2)) ** 5 * 50).astype(np.int64)
    w = rng.integers(1, 100, (30, 2))
    at, got, score, read = block_top_k(x, np.arange(2000), w, np.full(30, -1), 5)
    for q in range(30):
        s = x @ w[q]
        assert got[at == q].tolist() == np.lexsort((np.arange(2000), -s))[:5].tolist()
    assert (read < 1).mean() > 0.8


def test_packing(spark, folder, texts):
    from itertools import combinations

    from vicinity.llm.packing import optimal_boundaries, pack

    rng = np.random.default_rng(2)
    lengths, counts = np.unique(rng.integers(0, 60, 40)), None
    counts = rng.integers(1, 9, len(lengths))
    for k in (1, 2, 3):
        cost = lambda ends: sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))
        best = min(cost((*c, lengths[-1])) for c in combinations(lengths[:-1].tolist(), k - 1))
        assert cost(optimal_boundaries(lengths, counts, k)) == best
    rows = pack(spark.read.parquet(f"{folder}/documents.parquet"), max_length=100, buckets=4, budget=300).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
        assert r["length"] <= r["padded"] and r["slot"] * r["padded"] < 300
    assert total == Counter({d: len(WORD.findall(t or "")) for d, t in enumerate(texts)}) + Counter() or all(
        total[d] == len(WORD.findall(t or "")) for d, t in enumerate(texts)
    )
    whole = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):  # pieces follow one another without a gap
        assert r["start"] == whole.get(r["doc_id"], 0) and r["length"] <= 100
        whole[r["doc_id"]] = r["start"] + r["length"]
    assert len({(r["batch_id"], r["slot"]) for r in rows}) == len(rows)
    again = pack(spark.read.parquet(f"{folder}/documents.parquet").repartition(7, "text"), max_length=100, buckets=4, budget=300)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    for batch, n in Counter(r["batch_id"] for r in rows).items():
        padded = {r["padded"] for r in rows if r["batch_id"] == batch}
        assert len(padded) == 1 and (n * max(padded) <= 300 or n == 1)


def test_sentencepiece(spark, folder, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    from vicinity.llm.sentencepiece_fst import MODEL, decode_documents, encode_documents

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    odd = ["  Hello  world\n\tx ñ日 ", " " * 37 + "the", "▁a", "🙂🙂\x00", "don't <s> </s>", "ﬁ Ａ\r\n" * 3]
    docs = spark.createDataFrame(list(enumerate([*texts, *odd])), "doc_id long, text string")
    encoded = encode_documents(docs)
    got = {r["doc_id"]: r for r in encoded.collect()}
    back = {r["doc_id"]: r["text"] for r in decode_documents(encoded).collect()}
    for d, t in enumerate([*texts, *odd]):
        assert list(got[d]["ids"]) == sp.encode(t or "") and got[d]["round_trip"] and back[d] == (t or "").replace("▁", " ")


def test_quality_and_language_on_odd_texts(spark, folder, texts):
    q = run(spark, "op6_quality", folder)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in q.values()) and len(q) == len(texts)
    lang = run(spark, "op7_language_id", folder)
    assert {r["lang_pred"] for r in lang.values()} <= {"en", "fr", "und"}
    letter = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    assert all((r["lang_pred"] == "und") == (not letter(texts[d])) for d, r in lang.items())


def test_letters_and_scripts():
    from vicinity.llm.langid import _NAMES, has_letter, word_scripts

    for t in ("½ ² 12", "Ⅷ", "١٢", "_ “” —", "", None):
        assert not has_letter(t)
    assert all(map(has_letter, ("ª", "12a", "ʰ", "字")))
    for word, script in (("“Привет", "Cyrillic"), ("—Привет", "Cyrillic"), ("„λόγος", "Greek"), ("“abc”", "Latin"), ("a\u0301", "Latin"), ("½", "Latin"), ("《字", "Han")):
        buf = np.frombuffer(word.encode(), np.uint8)
        assert _NAMES[word_scripts(buf, np.array([0]), np.array([len(buf)]))[0]] == script


def test_language_sample_is_bounded(spark):
    from vicinity.llm.langid import fit

    rows = [(i, f"l{i % 5}", "words of it") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert fit(docs).langs == [f"l{k}" for k in range(5)]
    with pytest.raises(ValueError):
        fit(docs, languages=4)


def plain_features(text):
    """Word and trigram buckets of a text, one by one."""
    from vicinity.llm.common import Roller
    from vicinity.llm.quality import BITS, REPEAT

    raw, roll, words = (text or "").encode(), Roller(0), []
    last = None
    for w in raw.split():
        b = np.frombuffer(w, np.uint8)
        words.append(REPEAT if w == last else int(roll.of(roll.prefix(roll.table[b]), np.array([0]), np.array([len(b)]))[0]) >> (64 - BITS))
        last = w
    sign, grams, mask = [32 if c in b" \t\n\x0b\x0c\r" else c for c in raw], [], 2**32 - 1
    for a, b, c in zip(sign, sign[1:], sign[2:], strict=False):
        h = (a * 0x9E3779B1 & mask) ^ (b * 0x85EBCA6B & mask) ^ (c * 0xC2B2AE35 & mask)
        grams.append(((h ^ h >> 15) * 0x2C1B3C6D & mask) >> (32 - BITS))
    return words, grams


def test_quality_scores_and_training_against_plain_loops(texts):
    import pyarrow as pa

    from vicinity.llm.quality import BITS, PRIOR, QualityModel, train

    rng = np.random.default_rng(3)
    some = [t for t in texts if len(t or "") < 2000]
    model = QualityModel(rng.normal(size=1 << BITS).astype(np.float32), rng.normal(size=1 << BITS).astype(np.float32), 0.3)
    got = model.scores(pa.array(some, pa.string()))
    for t, z in zip(some, got, strict=True):
        words, grams = plain_features(t)
        total = (sum(float(model.words[w]) for w in words) + sum(float(model.grams[g]) for g in grams)) / (len(words) + len(grams) + PRIOR) if words else 0.0
        assert z == pytest.approx(1 / (1 + np.exp(-total - 0.3)), abs=1e-6)

    some, labels, dim, size, rate, epochs = [t for t in some if (t or "").split()][:5], [1, 0, 1, 0, 0], 4, 1 << BITS, 0.5, 2
    model, rng = train(some, labels, dim=dim, epochs=epochs, rate=rate, seed=7), np.random.default_rng(7)
    vectors = rng.uniform(-1 / dim, 1 / dim, (2 * size, dim)).astype(np.float32).astype(float)
    out, bias, step = np.zeros((dim, 2)), np.zeros(2), 0
    for _ in range(epochs):
        for i in rng.permutation(len(some)):
            words, grams = plain_features(some[i])
            bag = Counter([*words, *(g + size for g in grams)])
            weight = {k: n / (len(words) + len(grams) + PRIOR) for k, n in bag.items()}
            lr = rate * (1 - step / (epochs * len(some)))
            step += 1
            mean = sum(w * vectors[k] for k, w in weight.items())
            p = np.exp(mean @ out + bias)
            g = p / p.sum() - np.eye(2)[labels[i]]
            back = out @ g
            for a in range(dim):
                for c in range(2):
                    out[a, c] -= lr * mean[a] * g[c]
            bias -= lr * g
            for k, w in weight.items():
                vectors[k] -= lr * min(1.0, 20 * w) * back
    fold = vectors @ (out[:, 1] - out[:, 0])
    assert np.allclose(model.words, fold[:size], atol=1e-4) and np.allclose(model.grams, fold[size:], atol=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_null_and_repeated_ids(spark, tmp_path):
    """Every operator takes null doc_ids and repeated rows, and returns a row for each."""
    p = " ".join(f"w{i}" for i in range(120))
    rows = [(1, p, "en"), (1, p, "en"), (None, p, "en"), (None, p, "fr"), (2, "", "fr"), (2, p + " x", "fr"), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op3_substring_dedup", "op4_sentencepiece", "op5_exact_dedup", "op6_quality", "op7_language_id", "op8_simhash", "op9_packing", "op10_suffix_dedup"):
        got = Counter(r["doc_id"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == Counter([1, 1, None, None, 2, 2, None]), name
    kept = {(r["doc_id"], r["n_removed"]) for r in queries.QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()}
    assert kept == {(1, 0), (None, 0), (2, 0), (2, 120)}


def test_words_longer_than_blocks(spark, tmp_path):
    """Texts beyond a block of one or two megabytes, one of them a single word; a passage that crosses a block's end."""
    p = " ".join(f"w{i}" for i in range(200))
    long_text = " ".join(f"v{i}" for i in range(400_000)) + " " + p
    spark.createDataFrame([(1, p), (2, long_text), (3, "ab" * 1_300_000), (4, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = {x["doc_id"]: x for x in queries.QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()}
    assert [(r[d]["n_words"], r[d]["n_removed"]) for d in (1, 2, 3, 4)] == [(200, 0), (400_200, 200), (1, 0), (1, 0)]
    r = {x["doc_id"]: x for x in queries.QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).collect()}
    size = len(p)
    assert [r[d]["n_removed"] for d in (1, 2, 3, 4)] == [size, size, 2_600_000, 0]


def test_viterbi_against_all_paths():
    from itertools import product

    from vicinity.llm.langid import viterbi

    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 3, 0, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.normal(size=(first[-1], 3)).astype(np.float32)
    label = viterbi(s, first, 0.8)
    for a, b in zip(first, first[1:], strict=False):
        value = lambda p, a=a: sum(s[a + i, k] for i, k in enumerate(p)) - 0.8 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert value(label[a:b]) == pytest.approx(max(value(p) for p in product(range(3), repeat=b - a)))


@pytest.mark.parametrize("name, column, truth, least", [("op6_quality", "predicted", "quality", 0.97), ("op7_language_id", "lang_pred", "lang", 0.98)])
def test_held_out_accuracy(spark, name, column, truth, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).where("held_out")
    table = spark.read.parquet(f"{sf}/{'labels' if truth == 'quality' else 'documents'}.parquet").select("doc_id", truth)
    rows = got.join(table, "doc_id").collect()
    assert len(rows) > 100 and sum(r[column] == r[truth] for r in rows) / len(rows) >= least


def test_mixed_language_spans(spark):
    from vicinity.llm.langid import fit, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    en, de = (docs.where(f"lang = '{x}' AND n_chars BETWEEN 500 AND 900").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    r = identify(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), fit(docs)).first()
    assert {s["lang"] for s in r["spans"]} == {"en", "de"} and r["spans"][0]["start"] == 0 and r["spans"][-1]["end"] == len(WORD.findall(en + " " + de))


def test_link_graph_reaches_hosts_without_rules(spark, folder):
    rows = queries.QUERIES["op2_url_filter"](spark, folder).collect()
    verdict = {r["host"]: r["verdict"] for r in rows if r["rule"] is None}
    assert verdict["hub.test"] == "block" and verdict["friend.test"] == "allow" and verdict[""] == "allow"


def test_pipeline(spark, folder, texts):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        docs.write.parquet(path := f"{folder}/stage-{name.replace(' ', '-')}")
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == before.columns and [d for d in docs.dtypes] == [d for d in before.dtypes]
            assert docs.count() <= before.count()
        if name == "substring dedup":
            same = docs.withColumnRenamed("text", "now").join(before, "doc_id").where("now = text AND text LIKE '%\n%'")
            assert same.count() > 0  # what loses nothing keeps its white space
    assert docs.count() > 0
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() == docs.count()


def test_scratch_tables_are_written_without_helper_programs(spark, tmp_path, monkeypatch):
    """A side file with checksums tells that Hadoop's local writer made a file, which starts ``chmod`` three times in the executor."""
    from vicinity.llm import common, substring_dedup, suffix_dedup

    monkeypatch.setattr(common, "delete_path", lambda spark, path: None)
    words = " ".join(f"word{i}" for i in range(150))
    docs = spark.createDataFrame([(i, f"start{i} {words} end{i}") for i in range(6)], "doc_id long, text string")
    since = common.scratch_mark()
    assert [r.n_removed for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()] == [0] + [150] * 5
    assert all(r.n_removed > 1000 for r in suffix_dedup.suffix_dedup(docs).collect())
    folders = [p.removeprefix("file://") for p in common._made[since:]]
    names = [x for p in folders for x in os.listdir(p)]
    monkeypatch.undo()
    common.finish(spark, since)
    assert len(folders) >= 10 and any(x.startswith("part-") for x in names)
    assert not [x for x in names if x.endswith(".crc")]


def test_files_of_failed_attempts_are_not_data(spark, tmp_path):
    """Tables that Python workers write: only what a task that ended well has named; all rows, empty tables, and buckets in their places."""
    from vicinity.llm import common

    docs = spark.createDataFrame([(i % 97 if i % 5 else None, "x" * i, {"a b": i}) for i in range(500)], "doc_id long, text string, rest struct<`a b`:long>")
    out = common.materialize_arrow(docs.repartition(3), "test")
    folder = out._vicinity_path.removeprefix("file://")
    some = next(x for x in os.listdir(folder) if x.startswith("part-"))
    shutil.copy(f"{folder}/{some}", f"{folder}/_attempt")
    assert sorted(map(str, spark.read.parquet(out._vicinity_path).collect())) == sorted(map(str, docs.collect()))
    assert common.materialize_arrow(docs.where("doc_id > 1000"), "test").collect() == []
    text = common.bucketed(docs, "test", "doc_id")
    assert text.schema["rest"].dataType == docs.schema["rest"].dataType
    joined = text.join(text.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 400
    assert joined.where("n > 4").count() == sum(n for n in Counter(i % 97 for i in range(500) if i % 5).values() if n > 4)
