"""The corpus operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connection, differences
from pyspark.sql import functions as F

from panemill.llm import ann, byte_bpe, language_id, media, minhash_dedup, mixing, quality, queries, quotations, toxicity, warc
from panemill.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1: near duplicates


def groups_by_brute_force(rows, width=2):
    """(set size, least reachable id) of each row, by comparing all pairs of rows that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1) if w else 0)))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, own in enumerate(sets):
        common = Counter(j for x in own for j in where[x])
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for x in own:
            where[x].append(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [(len(own), least.get(root(i))) for i, own in enumerate(sets)]


def near_copies(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.03, 0.06, 0.1]) else w for w in base]
            texts.append(" ".join(copy))
    return texts


def check_groups(spark, rows, width=2):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, width=width).collect())
    assert got == Counter((i, n, c, i == c) for (i, _), (n, c) in zip(rows, groups_by_brute_force(rows, width), strict=True))


def test_near_duplicates_equal_brute_force(spark):
    check_groups(spark, list(enumerate(near_copies(3, 60))))


def test_near_duplicates_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op1_minhash"](spark, sf).collect()}
    assert got == dict(zip([i for i, _ in rows], groups_by_brute_force(rows), strict=True))


def test_near_duplicates_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "Two  Words"), (8, "É é"), (9, "é É"), (10, "x" * 100_000), (11, "a " * 50_000)]
    check_groups(spark, rows)
    check_groups(spark, rows, width=5)
    docs = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "q r s"), (5, "a b c"), (5, "a b c"), (None, ""), (7, ""), (7, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 3, False), (None, 3, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True)], key=str)
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    kept = minhash_dedup.deduplicated(docs.withColumn("component_id", F.lit("clash")).withColumn("r1", F.lit(0)).withColumn("row", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "component_id", "r1", "row"]
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == [(0, ""), (0, "q r s"), (3, "a b c"), (7, ""), (7, "")]
    assert minhash_dedup.deduplicated(empty(spark)).count() == 0


def test_one_id_with_several_texts(spark):
    cases = (
        ([(2, "a"), (3, "a"), (3, "b"), (4, "b")], [(2, "a"), (3, "b")]),
        ([(1, "a"), (1, "b"), (2, "a")], [(1, "a"), (1, "b")]),
        ([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (2, "b")], [(1, "a"), (1, "b")]),
        ([(0, "b"), (1, "a"), (1, "a more")], None),  # a and a more are one group: one of both texts of the least id stays
    )
    rows, want = [], []
    for k, (given, kept) in enumerate(cases):  # ids and words of their own
        text = lambda t: " ".join(f"{t[0]}{k}{j}" for j in range(9)) + t[1:]  # noqa: B023, E731
        rows += [(10 * k + i, text(t)) for i, t in given]
        want += [(10 * k + i, text(t)) for i, t in kept or ()]
    check_groups(spark, rows)
    kept = sorted(tuple(r) for r in minhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert [r for r in kept if r[0] < 30] == sorted(want)
    assert [i for i, _ in kept if i >= 30] == [30, 31]


def test_near_duplicates_with_a_hot_group(spark, monkeypatch):
    from panemill.llm import common

    monkeypatch.setattr(common, "SPLIT", 20)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.01 else "x" for w in base) for _ in range(200)] + ["same text of many"] * 200 + [""] * 100 + near_copies(9, 30)
    check_groups(spark, list(enumerate(texts)))
    check_groups(spark, [(k % 50, t) for k, t in enumerate(texts)], width=5)


def test_block_comparison_of_many_unlinked(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 7)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(f"x{rng.randint(0, 10**6)}" if rng.random() < 0.07 else w for w in base) for _ in range(80)]
    check_groups(spark, list(enumerate(texts)))


def test_near_duplicates_by_five_words(spark):
    texts = ["", "one", "a b c d", "a b c d", "a b c e"]
    for k in range(12):
        base = [f"v{k}_{j}" for j in range(100)]
        some = [w if j % 20 != 10 else "changed" for j, w in enumerate(base)]  # 0.82 by pairs of words, 0.58 by fives
        texts += [" ".join(x) for x in (base, some, [*base, "more"])]
    rows = list(enumerate(texts))
    check_groups(spark, rows, width=5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for (i, _), (_, c) in zip(rows, groups_by_brute_force(rows, 5), strict=True) if i == c}
    assert {r["doc_id"] for r in minhash_dedup.deduplicated(docs).collect()} == want
    assert len(want) > minhash_dedup.deduplicated(docs, width=2).count()


def test_posterior_floor():
    assert 0 < minhash_dedup.posterior_floor(32, 0.8, 1e-6) < minhash_dedup.posterior_floor(128, 0.8, 1e-6) < 103


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {5: 5} | {k: 5 for k in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2: mixing


def test_mix_equals_sql(spark, sf):
    assert differences(queries.QUERIES["op2_mixing"](spark, sf), connection(sf), queries.ORACLE["op2_mixing"]) == ""


def test_mix_targets_and_edge_cases(spark):
    rows = [(k, "w " * (k % 7), "b" if k % 5 else None) for k in range(300)] + [(1000, "x " * 10, "a"), (1000, "x " * 10, "a"), (None, "y", "c"), (2000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    assert sum({r["source_size"]: r["target"] for r in out}.values()) == pytest.approx(total)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    assert sum(r["taken"] for r in out) <= total
    tiny = {r["source_size"]: r["target"] for r in out}
    assert tiny[20] == 60  # three times its size at most
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mix_of_repeated_and_null_ids_equals_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 16)
    monkeypatch.setattr(mixing, "BUCKET", 10)
    rows = [(None, "w " * (k % 4), "hot", "en") for k in range(200)] + [(7, "seven words are in this text here", "hot", "en")] * 150 + [(7, "other", "b", None)] * 40
    rows += [(k, "x " * (k % 9), "abc"[k % 3], "de") for k in range(150)] + [(5000, "y " * 30_000, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert differences(mixing.mix(docs), connection(str(tmp_path)), mixing.ORACLE) == ""
    taken, texts = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["size"]] += r["copies"]
    for r in mixing.mixed_documents(docs).collect():
        texts[r["doc_id"], len((r["text"] or "").split())] += 1
    assert texts == +taken


# --- 3, 4: classifiers


def held_out(spark, sf, name, label, column):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    return [(r[label], r[column]) for r in queries.QUERIES[name](spark, sf).where("held_out").join(labels, "doc_id").collect()]


def test_quality_on_documents_held_out(spark):
    pairs = held_out(spark, "/root/testdata/sf0.01", "op3_quality", "quality", "kept")
    assert sum((q == 1) == kept for q, kept in pairs) / len(pairs) > 0.95


def test_toxicity_on_documents_held_out(spark):
    pairs = held_out(spark, "/root/testdata/sf0.1", "op4_toxicity", "toxic", "score")
    bad, good = ([s for t, s in pairs if t == want] for want in (1, 0))
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert all(0 <= s <= 1 for _, s in pairs)


def test_toxicity_tolerates_gaps():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "re", "tu", "sen", "dor"]) for _ in range(rng.randint(1, 3)))
    bags = [(k % 4 == 0, sorted({word() for _ in range(60)} | ({rng.choice(["idiot", "scumbag"])} if k % 4 == 0 else set()))) for k in range(400)]
    model = toxicity.train([(int(label), units) for label, units in bags], lambda weights, least: [sorted(toxicity.Windows(weights, least).of(" ".join(units)))[:20] for _, units in bags])
    score = lambda text: float(toxicity.Scorer(model).scores(toxicity.pa.array([text]))[0])
    for text in ("idiot", "what an i.d.i.o.t", "i d i o t", "IDIOT!", "an id-iot", "iddiot", "scumbag", "you id iot", "scum bag", "id\niot", "sc um bag", "zzzzzzzzidiotzzzzzzzz", "scu\tmb\nag"):
        assert score(f"kalo {text} mi") > 0.7, text
    for text in ("kalo mire", "", "tusendor lo", "the of", "idea", "1234 ?? --"):
        assert score(text) < 0.3, text


def test_kernel_by_brute_force():
    from itertools import combinations

    def expanded(word):
        letters, found = "^" + word, Counter()
        for n in (3, 4):
            for at in combinations(range(len(letters)), n):
                if (skips := at[-1] - at[0] - n + 1) <= toxicity.SKIPS:
                    found[tuple(letters[k] for k in at)] += toxicity.DECAY**skips
        units = [toxicity.DECAY ** (at[-1] - at[0] - n + 1) for n in (3, 4) for at in combinations(range(len(letters)), n) if at[-1] - at[0] - n + 1 <= toxicity.SKIPS]
        norm = sum(w * w for w in units) ** 0.5
        return {k: v / norm for k, v in found.items()}

    words, marks = ["idiot", "idxiot", "idea", "clown", "crown", "pathetic"], ["idiot", "clown", "patetic"]
    got = toxicity.Landmarks(marks).kernel(words)
    for i, a in enumerate(words):
        for j, b in enumerate(marks):
            x, y = expanded(a), expanded(b)
            assert got[i, j] == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()), abs=2e-3)


def expanded(letters):
    """Weights of a string's subsequences of three and four letters."""
    from itertools import combinations

    found, units = Counter(), []
    for n in (3, 4):
        for at in combinations(range(len(letters)), n):
            if (skips := at[-1] - at[0] - n + 1) <= toxicity.SKIPS:
                found["".join(letters[k] for k in at)] += toxicity.DECAY**skips
                units.append(toxicity.DECAY**skips)
    norm = sum(w * w for w in units) ** 0.5 or 1.0
    return {k: v / norm for k, v in found.items()}


def windows_by_hand(text):
    """Words run together, and windows within long runs of letters: (letters, whether they begin a word)."""
    words = [w for w in ("".join(c for c in t if c.isalpha()) for t in text.lower().split()) if w]
    least, most = toxicity.JOINED
    found = [("".join(words[k : k + n]), True) for n in range(2, toxicity.PARTS + 1) for k in range(len(words) - n + 1)]
    found += [(w[k : k + n], k == 0) for w in words if len(w) >= most for n in range(least, most + 1) for k in range(len(w) - n + 1)]
    return {x for x in found if least <= len(x[0]) <= most}


def number_of(sub):
    return sum((0 if c == "^" else ord(c) - 96) << (6 * (2 - k)) for k, c in enumerate(sub))


def test_windows_equal_brute_force():
    rng = np.random.default_rng(8)
    weights = np.zeros(toxicity._THREE + toxicity._FOUR, np.float32)
    weights[: toxicity._THREE] = rng.normal(size=toxicity._THREE)
    texts = ["an id iot of the scum Bag,\nidi\tot", "id\niot 12 !! extraordinarilylongwordindeed id iot", "a b c d e f g", "", None, "one", "....", "x" * 300 + " yes no"]
    for text in texts:
        for least in (-0.2, 0.4):
            value = lambda w, begins: sum(v * weights[number_of(k)] for k, v in expanded(("^" if begins else "") + w).items() if len(k) == 3)  # noqa: B023, E731
            want = {w if begins else toxicity.INSIDE + w for w, begins in windows_by_hand(text or "") if value(w, begins) >= least}
            assert set(toxicity.Windows(weights, least).of(text)) == want, (text, least)


@pytest.fixture(scope="module")
def machine(spark):
    """The machine that the labels of sf0.1 give."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learnt_from(docs, labels, "doc_id", "text", "toxic")


def test_telling_words_with_a_letter_put_in(machine):
    scorer = toxicity.Scorer(machine)
    score = lambda texts: scorer.scores(toxicity.pa.array(texts))
    words = ["idiot", "clown", "stupid", "trash", "pathetic", "worthless", "disgusting"]
    common = ["moron", "loser"]  # of letters that stand in a row in many ordinary words
    put_in = lambda words: [f"{w[:k]}{c}{w[k:]}" for w in words for k in range(1, len(w)) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert (score(put_in(words)) >= 0.7).mean() > 0.99
    assert (score(put_in(common)) >= 0.7).mean() > 0.6
    words += common
    assert (score(words) >= 0.7).all()
    split = [f"of the {w[:k]}{gap}{w[k:]} and" for w in words for k in range(2, len(w) - 1) for gap in (" ", "\n", " - ")]
    split += [f"{w[:2]} {w[2:4]} {w[4:]}" for w in words] + [f"bbbbbbbbbb{w}bbbbbbbbbb" for w in words]
    assert (score(split) >= 0.7).all()
    assert (score(["the other one", "extra shine", "", "a clear noun of the year", None]) < 0.3).all()


def test_document_scores_by_direct_computation(spark, sf, machine):
    """Every unit's value from the weights of its subsequences, one at a time."""
    weights, sums = machine["weights"], {}

    def number(sub):
        low = [(0 if c == "^" else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37) for c in sub]
        key = 0
        for c in low:
            key = key << 6 | c
        return key if len(sub) == 3 else ((key * 2654435761 % 2**32) >> 10) + toxicity._THREE

    def value(letters):
        if letters not in sums:
            sums[letters] = sum(v * float(weights[number(k)]) for k, v in expanded(letters).items()) + machine["offset"]
        return max(sums[letters], toxicity.NO_UNIT)

    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 400").limit(25).collect()] + ["what an i d i o t", "id xiot", "…", ""]
    for text, got in zip(texts, toxicity.Scorer(machine).scores(toxicity.pa.array(texts)), strict=True):
        units = {"^" + "".join(c for c in w if c.isalpha()) for w in toxicity.units_of(text)}
        units = {u[at : at + 16] for u in units for at in (range(0, len(u) - 12, 4) if len(u) > 16 else (0,))}
        units |= {("^" if begins else "") + w for w, begins in windows_by_hand(text)}
        best = max((value(u) for u in units if len(u) > 3), default=toxicity.NO_UNIT)
        a, b = machine["logistic"]
        assert got == pytest.approx(1 / (1 + np.exp(-(min(1.0, max(toxicity.NO_UNIT, best)) * a + b))), abs=2e-3), text


def test_toxicity_at_the_threshold(spark):
    rows = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["predicted"] == (1 if r["score"] >= 0.7 else 0) for r in rows)


def test_quality_views_share_no_feature():
    a, b = ("some plain words", "src1", "en", 16), ("SOME !!plain!! words", "src1", "en", 16)
    assert (quality.metadata_view(*a)[5:] != quality.metadata_view("x", "src2", "de", 1)[5:]).any()
    assert (quality.content_view(a[0]) == quality.content_view(a[0])).all()
    assert (quality.content_view(a[0]) != quality.content_view(b[0])).any()
    assert len(quality.content_view("x")) == quality.SPLIT_AT
    assert np.isfinite(np.concatenate([quality.metadata_view(None, None, None, None), quality.content_view(None)])).all()


def test_quality_scores_by_direct_computation(spark, sf):
    """The query's scores against the model applied document by document; half-precision features only choose the weights."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_quality"](spark, sf).collect()}
    for r in docs.collect():
        want = quality.score(model, quality._views([r["text"]], [r["source"]], [r["lang"]], [r["n_chars"]]))
        assert got[r["doc_id"]]["score"] == pytest.approx(float(want[2][0]), abs=1e-9)
        assert got[r["doc_id"]]["kept"] == (got[r["doc_id"]]["score"] >= quality.THRESHOLD)


def test_classifier_edge_cases(spark):
    docs = documents(spark, ["fine text here", None, "", " ", "x" * 50_000]).unionByName(documents(spark, ["fine text here"]))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(0, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    several = spark.createDataFrame([(k % 5, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls, several):
        assert toxicity.toxicity(docs, labels).count() == 6
        assert quality.quality(docs, labels).count() == 6
        assert toxicity.accepted(docs, labels).columns == docs.columns
        clash = docs.withColumns({c: F.lit("clash") for c in ("score", "views", "label", "key", "held_out", "id")})
        assert toxicity.toxicity(clash, labels).count() == quality.quality(clash.drop("n_chars"), labels).count() == 6
        assert set(quality.accepted(clash, labels).columns) == set(clash.columns)
        scores = {(r["doc_id"], r["score"]) for r in quality.quality(docs, labels).collect()}
        assert len(scores) == 5  # the repeated row is scored alike
    assert toxicity.toxicity(empty(spark), none).count() == 0
    assert quality.quality(empty(spark), none).count() == 0


# --- 5: WARC


def test_warc_round_trip(spark):
    rows = [(i, None if i == 2 else f"http://x/ä{i}\n", None if i in (1, 5) else "" if i == 7 else "same" if i % 2 else f"p{i}é\r\n\r\nWARC/1.1") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("top", F.lit(1))
    out = {r["page_id"]: r for r in warc.archived(spark, pages).collect()}
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), i)
    assert len(out) == len(rows)
    for i, _, html in rows:
        raw, top = (html or "").encode(), last[html or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == i else "revisit", None if top == i else top)
        assert tuple(out[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert warc.archived(spark, pages.limit(0)).count() == 0


def test_warc_members_can_be_read_alone(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://x", f"page {k}" * k) for k in range(50)], "id long, url string, html string").withColumn("top", F.lit(None).cast("long"))
    manifest = warc.normalise(warc.write_whole(pages, f"file://{tmp_path}/whole"), f"file://{tmp_path}/members")
    total = 0
    for uri in (r["uri"] for r in manifest.collect()):
        raw = open(uri.removeprefix("file://"), "rb").read()
        for line in open(uri.removeprefix("file://") + ".idx"):
            at, size, name, _ = line.split()
            member = zlib.decompress(raw[int(at) : int(at) + int(size)], 31)
            assert f"WARC-Record-ID: {name}".encode() in member
            total += 1
        assert len(list(warc.records(iter([gzip.decompress(raw)])))) == len(raw and open(uri.removeprefix("file://") + ".idx").readlines())
    assert total == 50


def test_warc_edge_cases(spark):
    rows = [(None, "u", "same"), (3, "u", "same"), (3, "u", "same"), (1, "u", "same"), (None, "a b%20c/ü?x=%C3", "lonely"), (8, "big", "z" * 3_000_000), (9, "s", "s"), (10, "s", "s")]
    out = warc.archived(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), revisit_from=2).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in out), key=str) == sorted(
        [(None, "revisit", 3), (3, "response", None), (3, "response", None), (1, "revisit", 3), (None, "response", None), (8, "response", None), (9, "response", None), (10, "response", None)], key=str
    )
    assert {r["url"] for r in out} == {"u", "a b%20c/ü?x=%C3", "big", "s"}
    assert {r["payload_bytes"] for r in out if r["page_id"] == 8} == {3_000_000}


def test_warc_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    last = {}
    for r in pages:
        last[r["html"] or ""] = max(last.get(r["html"] or "", -1), r["page_id"])
    out = {r["page_id"]: r for r in queries.QUERIES["op5_warc"](spark, sf).collect()}
    assert len(out) == len(pages)
    for r in pages:
        raw, top = (r["html"] or "").encode(), last[r["html"] or ""]
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if top == r["page_id"] else "revisit", None if top == r["page_id"] else top)
        assert tuple(out[r["page_id"]][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_inflated_pieces_are_bounded():
    import io

    packed = gzip.compress(b"a" * 50_000_000) + gzip.compress(b"") + gzip.compress(b"end")
    sizes, tail = [], b""
    for piece in warc.inflated(io.BytesIO(packed)):
        sizes.append(len(piece))
        tail = (tail + piece)[-5:]
    assert max(sizes) <= warc.CHUNK and sum(sizes) == 50_000_003 and tail == b"aaend"


def test_warc_stream_in_small_pieces():
    whole = b"".join(warc.record(k, "u", b"x\r\n\r\n" * k, None, False) for k in range(5))
    assert b"".join(warc.records(whole[k : k + 7] for k in range(0, len(whole), 7))) == whole
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-30]])))


# --- 6: quotations


def test_quotation_links(spark):
    rows = [(1, 0, "Hello there\n\nsecond para"), (1, 1, "> hello   there\n\nyes"), (1, 2, "> > Hello there\n> yes\nno"), (1, 3, "new topic"), (1, 4, "> unknown\n\nok"), (1, 5, None), (None, 0, "> x"), (2, 0, "Hello there"), (2, 1, "> second para")]
    out = {(r["conv_id"], r["turn"]): r for r in quotations.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [out[1, k]["reply_to"] for k in range(6)] == [None, 0, 1, None, None, None]
    assert [out[1, k]["root"] for k in range(6)] == [0, 0, 0, 3, 4, 5]
    assert [out[1, k]["own_text"] for k in (0, 1, 2, 4)] == ["Hello there\n\nsecond para", "yes", "no", "ok"]
    assert (out[1, 2]["deepest"], out[1, 2]["linked"], out[1, 4]["linked"], out[2, 1]["reply_to"]) == (2, 2, 0, None)


def test_quotations_of_a_hot_thread(spark, monkeypatch):
    from panemill.llm import common

    monkeypatch.setattr(common, "SPLIT", 50)
    monkeypatch.setattr(quotations, "RUN", 16)
    rng = random.Random(6)
    texts = [rng.choice(["ok", "fine", "no", "> ok\n\nyes", "> fine\n\nok", "> > no\n> ok\n\nwell", "> never said"]) for _ in range(300)]
    rows = [(1, 2 * k, t) for k, t in enumerate(texts)] + [(2, 5, "x"), (2, 5, "> x"), (2, 6, "> x"), (3, None, "y"), (4, 1, "")]
    clash = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("rank", F.lit("clash")).withColumn("root", F.lit("clash"))
    linked = quotations.link_quotes(clash)
    out = {(r["conv_id"], r["turn"]): r for r in linked.where("conv_id = 1").collect()}
    last, want, root = {}, {}, {}
    for k, t in enumerate(texts):
        quotes = sorted((level, quotations.normalised(body)) for level, body in quotations.passages(t) if level)
        hits = [(level, -last[body]) for level, body in quotes if body in last]
        want[k] = -min(hits)[1] if hits else None
        root[k] = k if want[k] is None else root[want[k]]
        for level, body in quotations.passages(t):
            if not level:
                last[quotations.normalised(body)] = k
    order = sorted(range(300), key=lambda k: (root[k], k))
    for k in range(300):
        r = out[1, 2 * k]
        assert (r["reply_to"], r["root"], r["position"]) == (None if want[k] is None else 2 * want[k], 2 * root[k], order.index(k) + 1)
    rest = sorted((str(tuple(r[c] for c in ("conv_id", "turn", "reply_to", "position", "own_text"))) for r in linked.where("conv_id > 1").collect()))
    assert rest == sorted(map(str, [(2, 5, None, 1, "x"), (2, 5, None, 1, ""), (2, 6, 5, 2, ""), (3, None, None, None, "y"), (4, 1, None, 1, "")]))
    built = quotations.conversations(linked, most=7).where("conv_id = 1").collect()
    assert max(len(r["messages"]) for r in built) <= 7
    assert sorted((m["position"], m["text"]) for r in built for m in r["messages"]) == sorted((r["position"], r["own_text"]) for r in out.values())
    assert quotations.link_quotes(clash.limit(0)).count() == quotations.as_mail(clash.limit(0)).count() == 0


def test_mail_quotes_the_turns_before(spark):
    rows = [(1, 3, "b"), (1, 1, "a"), (1, 9, None), (1, 12, "d"), (2, 1, "e\nf"), (2, 2, "g"), (None, 1, "h"), (1, 3, "b")]
    out = sorted((str(r["conv_id"]), r["turn"], r["text"]) for r in quotations.as_mail(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect())
    assert out == sorted([("1", 1, "\na"), ("1", 3, "> a\n\nb"), ("1", 3, "> a\n\nb"), ("1", 9, ">> a\n> b\n\n"), ("1", 12, ">> b\n\nd"), ("2", 1, "\ne\nf"), ("2", 2, "> e\n> f\n\ng"), ("None", 1, "\nh")])


def test_quotations_of_the_table(spark, sf):
    source = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    out = queries.QUERIES["op6_quotations"](spark, sf).collect()
    assert len(out) == len(source)
    for r in out:
        assert quotations.normalised(r["own_text"]) == quotations.normalised(source[r["conv_id"], r["turn"]] or "")
        same = [t for t in range(r["turn"]) if quotations.normalised(source.get((r["conv_id"], t)) or "") == quotations.normalised(source.get((r["conv_id"], r["turn"] - 1)) or "-")]
        assert r["reply_to"] == (max(same) if same else None)


# --- 7: languages


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.QUERIES["op7_language"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_languages_by_direct_vector_sums(spark, sf):
    """Prototypes and cosines from vectors bound and added letter by letter."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()
    letters, table = language_id._letters.astype(np.int64), language_id._symbol_table()

    def vector(text):
        symbols = [0, *(int(table[ord(c)]) for c in (text or "").lower()), 0]
        symbols = [s for k, s in enumerate(symbols) if s or k == 0 or symbols[k - 1]]
        out = np.zeros(language_id.DIMENSIONS)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return out

    vectors = {r["doc_id"]: vector(r["text"][:2000] if r["text"] else r["text"]) for r in rows}
    docs = spark.createDataFrame([(r["doc_id"], r["text"][:2000] if r["text"] else r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    sums = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    langs = sorted(sums)
    units = np.array([sums[g] / np.linalg.norm(sums[g]) for g in langs])
    units -= units.mean(axis=0)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    for i, v in vectors.items():
        if np.abs(v).sum():
            cosine = units @ v / np.linalg.norm(v)
            assert got[i]["lang_pred"] == langs[int(np.argmax(cosine))]
            assert got[i]["score"] == pytest.approx(1 / np.exp(language_id.SHARPNESS * (cosine - cosine.max())).sum(), abs=1e-3)


def test_language_edge_cases(spark):
    docs = documents(spark, ["hello hello", None, "", "123 !!", "hello", "hello"])
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert [out[k]["lang_pred"] for k in range(6)] == ["en", "und", "und", "und", "en", "en"]
    assert {r["lang_pred"] for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(empty(spark)).count() == 0
    equal = spark.createDataFrame([(k, "hello there", g) for k, g in enumerate(["b", "a", "b", "a"] * 4)], "doc_id long, text string, lang string")
    clash = equal.withColumns({c: F.lit("clash") for c in ("id", "held_out", "score", "lang_pred", "component")})
    assert {r["lang_pred"] for r in language_id.identify(clash).collect()} == {"a"}  # a tie goes to the first by code point


# --- 8: byte-level BPE


def test_bpe_equals_tiktoken(spark, sf):
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    odd = ["", " a", " a b ", "a  b", "a \n b c\n d  ", "a b\n", "　 a b  c", "a" * 3000, "áéí" * 500, "1234567 89'll don't 's x's", " " * 3000 + "x", "😀👨‍👩" * 50]
    odd += ["".join(rng.choice("abcé \n1,.' ") for _ in range(400)) for _ in range(60)]
    codec = byte_bpe.Codec(ranks, public.PATTERN)
    for text in odd:
        assert codec.encode(text) == reference.encode_ordinary(text), text[:40]
        assert codec.decode(codec.encode(text)) == text.encode()
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(documents(spark, [None, *odd], 10**6))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in byte_bpe.round_trip(docs, path, public.PATTERN).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    clash = documents(spark, ["a b", None]).withColumns({c: F.lit("clash") for c in ("id", "n_tokens", "ids", "bytes", "ids_sha256")})
    assert sorted(r["n_tokens"] for r in byte_bpe.round_trip(clash, path, public.PATTERN).collect()) == [0, 2]
    some = docs.limit(20)
    decoded = byte_bpe.decode(byte_bpe.encode(some, path, public.PATTERN), path)
    assert all(r["bytes"] == texts[r["doc_id"]].encode() for r in decoded.collect())
    assert byte_bpe.round_trip(empty(spark), path, public.PATTERN).count() == 0


# --- 9: neighbours


def test_neighbours_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = defaultdict(list)
    for r in sorted(queries.QUERIES["op9_neighbours"](spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((ids, d)) if j != k][:10]
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in got[ids[k]])
        hits += len({v for v, _ in got[ids[k]]} & set(ids[best].tolist()))
        total += len(best)
    assert hits / total >= 0.9


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [1.0]), (8, []), (6, [2.0, 0.0])] + [(1000 + k, [1.0, 0.0]) for k in range(1, 60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = ann.search(table).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 0] == [(0, v, 0.0) for v in [1, 100, *range(1001, 1009)]]
    assert [r["vec_id"] for r in out if r["query_id"] == 100][:3] == [0, 1, 1001]
    assert ann.search(table.limit(0)).count() == 0
    few = ann.search(table.where("vec_id in (0, 6)")).collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(6, 1.0)]


def brute_neighbours(rows, k=10):
    """For each query id the k nearest others: (distance, id), an id by its nearest vector to any of the query's."""
    out = {}
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        best = {}
        for i, x in rows:
            if i != q:
                best[i] = min([best.get(i, np.inf), *(float(np.sqrt(np.cumsum((np.array(x) - np.array(y)) ** 2)[-1])) for j, y in rows if j == q)])
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIRST", 3)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(3)
    table = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 3.0]), (2, [0.0, 9.0])]
    ids = [int(i) for i in rng.integers(0, 60, 300)] + [100, 200, 200]
    many = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in ids]
    for rows in (table, [(i, v) for i, v in many if any(v)], [(5, [1.0, k + 1.0]) for k in range(50)] + [(0, [1.0, 0.5]), (6, [1.0, 90.0])]):
        got = defaultdict(list)
        out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1)
        for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert got == brute_neighbours(rows)


def test_samples_by_hash_are_full_and_stable(spark):
    from panemill.llm.common import least_hashes

    rows = spark.range(20_000).repartition(5)
    want = {r["id"] for r in rows.orderBy(F.xxhash64("id")).limit(1000).collect()}
    assert {r["id"] for r in least_hashes(rows, F.xxhash64("id"), 1000, 20_000, "id").collect()} == want
    assert least_hashes(rows, F.xxhash64("id"), 30_000, 20_000, "id").count() == 20_000
    assert least_hashes(rows.limit(0), F.xxhash64("id"), 10, 0, "id").count() == 0


def test_neighbours_exact_mode(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # groups of both sides must meet in every partition
    x = np.random.default_rng(9).normal(size=(1500, 12))
    rows = list(enumerate(x.tolist()))
    got = defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    for q in range(0, 1500, 100):
        d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        assert got[q] == [(d[j], j) for j in np.lexsort((np.arange(1500), d)) if j != q][:10]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_neighbours_among_many_of_one_code(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODES", 2)  # a cluster's vectors share a list and nearly a code
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(10, 16)), 300, axis=0) + 0.02 * rng.normal(size=(3000, 16)))[rng.permutation(3000)]
    got = defaultdict(set)
    for r in ann.search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[k] & set(np.argsort(((x - x[k]) ** 2).sum(axis=1))[1:11].tolist())) for k in range(0, 3000, 100))
    assert hits / 300 >= 0.99


# --- 10: media


def test_media_round_trip(spark):
    texts = ["", None, "x" * 64, "é" * 40, "<p>a & b</p>", "same", "same", "z" * 10_000]
    docs = documents(spark, texts).withColumn("feature", F.lit("clash"))
    out = {r["doc_id"]: r for r in media.documents_as_media(docs).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert tuple(out[k][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) == want
        stored = media.media_of(raw)
        assert (out[k]["media_bytes"], out[k]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert out[k]["caption"] == f"{len(raw)} bytes"
    assert out[5]["feature"] == out[6]["feature"]
    assert media.documents_as_media(docs.limit(0)).count() == 0


def test_media_of_the_table(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.QUERIES["op10_media"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        raw = texts[r["doc_id"]]
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.media_of(raw)
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(padded))
        assert tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) == want


def test_documents_as_sequences_keep_text_and_media(spark):
    texts = ["one\n\ntwo <b>&amp;</b>", "", None, "three"]
    pages = media.paged(documents(spark, texts), "doc_id")
    for r in media.sequences(pages, "doc_id").collect():
        lines = [line.strip() for line in (texts[r["doc_id"]] or "").split("\n") if line.strip()]
        assert [p["text"] for p in r["sequence"] if p["kind"] == "text"] == lines
        assert [(p["pos"], p["digest"], p["caption"]) for p in r["sequence"] if p["kind"] == "img"] == [
            (len(lines), hashlib.sha256(media.media_of((texts[r["doc_id"]] or "").encode())).hexdigest(), f"{len((texts[r['doc_id']] or '').encode())} bytes")
        ]


def test_sequences_keep_order(spark):
    page = '<p>one</p><script>no()</script><figure><img src="sha256:aa" alt="x"><figcaption>a  caption</figcaption></figure>two &amp; three<img src="sha256:bb" alt="alt"><img src="http://other"><p>four'
    parts = media.parse(page)
    assert [(p["pos"], p["kind"], p["text"] or p["digest"], p["caption"]) for p in parts] == [(0, "text", "one", None), (1, "img", "aa", "a caption"), (2, "text", "two & three", None), (3, "img", "bb", "alt"), (4, "img", None, None), (5, "text", "four", None)]
    assert parts[4]["src"] == "http://other"
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    refs = media.references(media.sequences(pages, "id"), "id")
    found = media.resolve(refs, spark.createDataFrame([("aa", b"bytes")], "digest string, media binary")).orderBy("pos").collect()
    assert [(r["pos"], r["media"] and bytes(r["media"])) for r in found] == [(1, b"bytes"), (3, None)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<img src="http://h/x.png" alt="cap">', [("img", "http://h/x.png", "cap")]),
        ("<figure><figcaption>of nothing</figcaption></figure>", [("caption", "of nothing", None)]),
        ('<figure><img src="sha256:aa"><figcaption>never <b>closed</b>', [("img", "aa", "never closed")]),
        ('<figure><img src="sha256:aa">text<figure><img src="sha256:bb"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>', [("img", "aa", "out"), ("text", "text", None), ("img", "bb", "in")]),
        ('<figcaption>no figure</figcaption><p>a<figure><p>b</p><figcaption><p>c</p><p>d</p></figcaption><img src="sha256:aa" alt="e"></figure>f', [("text", "no figure", None), ("text", "a", None), ("text", "b", None), ("img", "aa", "c d"), ("text", "f", None)]),
        ('<img><img src=""><script>x</script><p>y', [("text", "y", None)]),
        ("<p>" + "long " * 200_000, [("text", ("long " * 200_000).strip(), None)]),
        ("</figure></p></figcaption>z<b", [("text", "z<b", None)]),
    ],
)
def test_parts_of_pages(page, want):
    got = media.parse(page)
    assert [(p["kind"], p["text"] or p["digest"] or p["src"], p["caption"]) for p in got] == want
    assert [p["pos"] for p in got] == list(range(len(got)))


def test_no_text_of_the_pages_is_lost(spark, sf):
    import re
    from html import unescape

    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        plain = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " ", r["html"] or "")
        want = Counter(unescape(re.sub(r"<[^>]*>", " ", plain)).split())
        got = Counter(w for p in media.parse(r["html"]) for w in f"{p['text'] or ''} {(p['caption'] or '') if p['kind'] != 'text' else ''}".split())
        assert not want - got or sum((want - got).values()) <= 0.01 * sum(want.values())


def test_split_joins_keep_columns(spark, monkeypatch):
    from panemill.llm import common

    monkeypatch.setattr(common, "SPLIT", 5)
    rows = common.written(spark.range(100).select(F.when(F.col("id") < 80, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("parts"), F.col("id").alias("part")), "split")
    out = common.spread_join(rows, spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"])
    assert out.columns == ["k", "parts", "part", "v"] and sorted((r["parts"], r["v"]) for r in out.collect()) == [(k, 2 if k < 80 else 2 * k) for k in range(100)]


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from panemill.llm.common import table, written

    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, before, sf), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= kept and rows
        if name == "near_duplicates":
            given = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in rows) == sorted(i for (i, _), (_, c) in zip(given, groups_by_brute_force(given, corpus_pipeline.WIDTH), strict=True) if i == c)
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
        kept = {r["doc_id"] for r in rows}
    n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == n


def test_pipeline_edge_cases(spark, tmp_path):
    import corpus_pipeline

    texts = ["a plain text of some words that stays", None, "", " ", "x" * 100_000] + ["the same text of several words here"] * 4
    rows = [(k, t, None if k % 3 else "s", None if k % 2 else "en", None) for k, t in enumerate(texts)] + [(0, texts[0], "s", "en", None), (0, "another text under the same id number", "s", "en", 5), (None, "no id at all but a text", None, None, None)]
    some = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("id", "row", "k1", "r1", "size", "copies", "score")})
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("some", some), ("none", some.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        held = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:-1]:
            held = function(spark, held, str(tmp_path / name))
            assert held.columns == docs.columns, stage
        tokens = corpus_pipeline.STAGES[-1][1](spark, held, "").count()
        assert tokens == 0 if name == "none" else tokens > 0
        if name == "some":
            deduped = corpus_pipeline.keep_one_of_each(spark, spark.read.parquet(str(tmp_path / name / "documents.parquet")), "")
            assert sorted(((r["doc_id"], r["text"]) for r in deduped.collect()), key=str) == sorted(
                [(0, texts[0]), (0, "another text under the same id number"), (1, None), (2, ""), (3, " "), (4, texts[4]), (5, texts[5]), (None, "no id at all but a text")], key=str
            )


def test_folding_takes_a_part_of_the_table_at_a_time():
    """The driver holds no copy of the landmarks' table in double precision."""
    import tracemalloc

    import numpy as np

    from panemill.llm import toxicity

    rng = np.random.default_rng(1)
    landmarks = toxicity.Landmarks(["".join(chr(97 + i) for i in rng.integers(0, 26, 12)) for _ in range(400)])
    alphas = rng.normal(size=400)
    tracemalloc.start()
    got = landmarks.folded(alphas)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(landmarks.used) > 16_384 and peak < got.nbytes + landmarks.table.nbytes
    assert np.array_equal(got[landmarks.used], (landmarks.table[:-1] @ alphas).astype(np.float32)) and np.count_nonzero(got) <= len(landmarks.used)
    print(len(landmarks.used), landmarks.table.nbytes, got.nbytes, peak)
