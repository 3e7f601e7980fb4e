"""Mixing, search, joins, scores and the pipeline: edge cases, and brute force on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import jaccard, lm, mixing, topk, toxicity
from tidewheel.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _targets(totals, weights=(5, 2, 1), share=1.5, most=2):
    """By resharing again and again, as the words of the rule have it."""
    w = {s: weights[i % len(weights)] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s)))}
    budget, full = share * sum(totals.values()), set()
    while True:
        left, open_w = budget - sum(most * totals[s] for s in full), sum(w[s] for s in totals if s not in full)
        aims = {s: most * totals[s] if s in full else left * w[s] / open_w for s in totals}
        over = {s for s in totals if s not in full and aims[s] > most * totals[s]}
        if not over:
            return aims
        full |= over


def _check_mix(rows):
    by = {}
    for r in rows:
        by.setdefault(r["own"], []).append(r)
    aims = _targets({s: sum(r["size"] for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert abs(v[0]["target"] - aims[s]) < 1e-6 * max(1, aims[s]) and v[0]["source_size"] == sum(r["size"] for r in v)
        assert 0 <= aims[s] - sum(r["taken"] for r in v) < 1 + len(v)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in v)


def test_mixing(spark, edge, none):
    done = mixing.taken(edge.withColumn("own", F.col("source")))
    rows = done.collect()
    assert len(rows) == edge.count() and set(done.columns) == {*edge.columns, "own", "source_size", "target", "taken", "epochs"} and mixing.taken(none).count() == 0
    assert all(r["size"] == len(WORD.findall(r["text"] or "")) for r in rows)
    _check_mix(rows)
    again = mixing.taken(edge.repartition(3)).collect()
    assert sorted(map(str, ((r["doc_id"], r["taken"]) for r in rows))) == sorted(map(str, ((r["doc_id"], r["taken"]) for r in again)))
    lean = mixing.shared(mixing.sized(edge))
    assert "text" not in lean.columns and sorted(map(str, ((r["doc_id"], r["taken"]) for r in rows))) == sorted(map(str, ((r["doc_id"], r["taken"]) for r in lean.collect())))
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixing.mix(none).count() == 0
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    expected = Counter()
    for r in rows:
        expected[r["source"]] += r["taken"]
    assert words == expected


def test_mixing_over_ranges(spark, monkeypatch):
    """A source of many ranges: its rows' prefix sums come from several tasks, and the cut is exact."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice("aaaab")) for i in range(1500)]
    done = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("own", F.col("source"))).collect()
    for s in "ab":
        own = [x for x in done if x["source"] == s]
        assert sum(x["taken"] for x in own) == int(own[0]["target"] + 1e-6)
        assert sum(x["taken"] not in (x["epochs"] * x["size"], (x["epochs"] + 1) * x["size"]) for x in own) <= 1
    _check_mix(done)


def test_mixing_is_native(spark, edge):
    plan = mixing.taken(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _brute(ids, rows, k):
    m = np.array(rows)
    out = {}
    for i in [i for i in range(len(ids)) if ids[i] % 20 == 0]:
        scores = m @ m[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], int(scores[j])) for j in order]
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_search(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 40)
    r = np.random.default_rng(3)
    base = r.normal(size=(6, 8))
    rows = base[r.integers(0, 6, 400)] + 0.05 * r.normal(size=(400, 8))
    rows *= np.exp(spread * r.normal(size=400))[:, None]
    rows[50:60] = rows[50]  # ties
    vectors = [(i, x.tolist()) for i, x in enumerate(rows)]
    odd = [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8), (1080, [0.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for x in topk.search(df, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    whole = np.floor(64 * rows).astype(int)
    ids = [*range(400), 1080]
    expected = _brute(np.array(ids), [*whole.tolist(), [0] * 8], 7)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == expected
    monkeypatch.setattr(topk, "CHUNK", 300)  # a few queries at a time
    again = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in topk.search(df, F.col("vec_id") % 20 == 0, k=7).collect()}
    assert again == {(q, i): x for q, v in got.items() for i, x in v.items()}
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>")
    assert topk.search(few, F.col("vec_id") % 20 == 0).count() == 2
    assert topk.search(few.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_beyond_64_bits(spark):
    """A score or component that is no whole number of 64 bits is an error; sums that only pass beyond them on the way are right."""
    find = lambda *vectors: topk.search(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1).collect()
    big = 2.0**31
    assert [(r["vec_id"], r["score"]) for r in find([big, big, -big], [big, big, big], [1.0, 0.0, 0.0])] == [(1, 2**62), (2, 2**31)]
    for vectors in (([1e10, 1.0], [1e10, 2.0]), ([1e18], [64.0]), ([-1e30], [1.0]), ([1.0], [float(2**63)])):
        with pytest.raises(Exception, match="64 bits|OVERFLOW|overflow"):
            find(*vectors)


def test_top_k_rows_do_not_grow_with_tasks(spark, monkeypatch):
    """Of unit vectors in no order of score, the rows that tasks give for a query grow as the logarithm of the buckets do."""
    monkeypatch.setattr(topk, "BUCKET", 20)
    given = []
    real = topk._top
    monkeypatch.setattr(topk, "_top", lambda rows, k: given.append(rows.count()) or real(rows, k))
    counts = {}
    for n in (640, 5120):
        r = np.random.default_rng(n)
        v = r.normal(size=(n, 12))
        v /= np.sqrt((v**2).sum(axis=1))[:, None]
        df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
        given.clear()
        got = topk.search(df, F.col("vec_id") < 10, k=5, scale=1000)
        assert got.count() == 50
        counts[n] = sum(given) / 10
        e = np.floor(1000 * v).astype(np.int64)
        for x in got.where("rank = 1").collect():
            scores = e @ e[x["query_id"]]
            scores[x["query_id"]] = -(10**9)
            assert x["score"] == scores.max()
    assert counts[5120] < 2.5 * counts[640]  # with eight times the buckets


def test_pruning_by_coordinate_is_used():
    r = np.random.default_rng(1)
    rows = np.floor(64 * r.normal(size=(500, 8))).astype(np.int64)
    bucket = topk.Bucket(np.arange(500), rows)
    for i in range(0, 500, 25):
        scores = rows @ rows[i]
        bound = float(np.sort(scores)[-3])
        places = bucket.candidates(rows[i], bound)
        assert set(np.flatnonzero(scores >= bound)) <= set(bucket.ids[places].tolist())
    near = bucket.candidates(bucket.rows[0], 0.97 * float(bucket.lengths[0]) ** 2)
    assert 0 < len(near) < 250


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100), (200, 201), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 20 * 20 for i in range(60)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _groups(docs):
    """Class and links of each document by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in docs.items():
        words = WORD.findall(text)
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    ids, links, top = sorted(docs), Counter(), {i: i for i in docs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                top[q] = p
    return {i: (root(i), links[i]) for i in ids}


def test_plan_reaches_its_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = jaccard.plan(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= jaccard.HASHES


def test_join_query(spark):
    from tidewheel.llm.queries import op5_ngram_jaccard

    docs = {i: r["text"] for i, r in _documents(spark).items()}
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op5_ngram_jaccard(spark, SF).collect()} == _groups(docs)


def test_join_of_a_large_group(spark, monkeypatch):
    """Near copies of one text in several blocks, and some that are not near."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(60):
        own = list(words)
        for _ in range(i % 4):
            own[r.randrange(60)] = f"x{i}"
        docs[i] = " ".join(own)
    docs |= {100 + i: " ".join(f"y{i}_{k}" for k in range(20)) for i in range(5)}
    found = jaccard.links(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {x["key"]: (x["class_id"], x["n_links"]) for x in found.collect()} == _groups(docs)


def test_join_edges(spark, edge, none):
    rows = {}
    for r in jaccard.links(edge).collect():
        rows.setdefault(r["key"], []).append((r["class_id"], r["n_links"], r["first"]))
    assert rows[1] == [(1, 1, True)] and rows[8] == [(1, 1, False)] and sorted(rows[2]) == [(2, 1, True)] * 2
    assert rows[None] == [(None, 0, True)] and rows[4] == [(4, 0, True)] and rows[5] == [(5, 1, True)] and rows[6] == [(5, 1, False)]
    kept = jaccard.unique(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "4", "5", "7", "9", "10"])
    assert jaccard.links(none).count() == 0 and jaccard.unique(none).count() == 0


def test_lm_base_and_gain(spark):
    from tidewheel.llm.queries import op4_lm_scoring

    sf = "/root/testdata/sf0.01"  # enough to learn from
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    count = Counter()
    for i, r in docs.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(WORD.findall(lower(r["text"])))
            count["\n"] += 1
    n, v = sum(count.values()), len(count)
    held = [0.0, 0.0]
    for r in op4_lm_scoring(spark, sf).collect():
        tokens = WORD.findall(lower(docs[r["doc_id"]]["text"])) + ["\n"]
        base = sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
        if r["held_out"]:
            held = [held[0] + r["base_score"], held[1] + r["score"]]
    assert held[1] > held[0] + 0.05 * abs(held[0])


def _local_model(texts):
    """The totals, the spelling and the n-gram counts of texts, and a function that gives the automaton of other texts."""
    unit, every = lm.Unit(texts), np.ones(len(texts), dtype=bool)
    held = [dict(zip(v.tolist(), c.tolist())) for v, c in unit.counted(every)]
    table = np.zeros(int(lm.Spelling.OFFSETS[-1]), dtype=np.float32)
    cells, often = unit.cells(every)
    table[cells] = often
    totals = lm.Totals(sum(held[0].values()), len(held[0]), table)

    def counts(other):
        return [np.array([h.get(v, 0) for v in g.values.tolist()], dtype=np.int64) for h, g in zip(held, (other.words, other.pairs, other.triples))]

    return totals, lm.Spelling(table), counts


def _brute_score(text, training, spelling):
    """log10 of a text's probability, by the formulas of the docstring on dictionaries."""
    tokens = lambda t: [*WORD.findall(t.lower()), "\n"]
    one, two, three = Counter(), Counter(), Counter()
    for t in training:
        own = ["\n", *tokens(t)]
        one.update(own[1:])
        two.update(zip(own, own[1:]))
        three.update(zip(own, own[1:], own[2:]))
    n = sum(one.values())

    def spelled(w):
        data = np.frombuffer(w.encode() + b"\n", dtype=np.uint8)
        return 0.01 if w == "\n" else 0.99 * 10 ** spelling.logs(data, np.array([0]), np.array([len(data) - 1]))[0]

    def alone(w):
        return max(one[w] - lm.D, 0) / n + lm.D * len(one) / n * spelled(w)

    def after(h, w):
        v = (1 + one[h] / lm.KNEE[0]) ** -lm.SLOPE[0]
        return (1 - v) * two[h, w] / max(one[h], 1) + v * alone(w)

    def last(g, h, w):
        v = (1 + two[g, h] / lm.KNEE[1]) ** -lm.SLOPE[1]
        return (1 - v) * three[g, h, w] / max(two[g, h], 1) + v * after(h, w)

    own = ["\n", *tokens(text)]
    return np.log10(after(own[0], own[1])) + sum(np.log10(last(*own[i - 2 : i + 1])) for i in range(2, len(own)))


def _small_corpus(seed, texts, words="a b c dd eé ff".split()):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(texts)]


@pytest.mark.parametrize("fan", [256, 2])
def test_lm_by_brute_force(spark, fan):
    """Units that ask each other directly, and over several levels of a tree, score as dictionaries of the whole corpus do."""
    train, rest = _small_corpus(1, 40), _small_corpus(2, 12, "a b c dd zz Qx".split())
    docs = spark.createDataFrame([(i, t, i < 40) for i, t in enumerate(train + rest)], "doc_id long, text string, own boolean").repartition(5)
    got = {r["doc_id"]: r for r in lm.score(docs, F.col("own"), unit=150, fan=fan).collect()}
    assert len(got) == 52
    table = _local_model([t.encode() for t in train])[1]
    for i, t in enumerate(train + rest):
        want = _brute_score(t, train, table)
        assert abs(got[i]["score"] - want) < 1e-5 * max(1, abs(want)), (i, t)


@pytest.mark.parametrize("fan", [4, 2])
def test_lm_counts_beyond_32_bits(spark, fan):
    """Sums of more than 2**32, with one level of the tree and with two."""
    for values in ([0, 1, 2**32 - 1], [5, 2**32 + 5, 2**40], []):
        values = np.array(values, dtype=np.int64)
        assert lm._read_counts(len(values), lm._counts(values)).tolist() == values.tolist()
    hashes = np.sort(np.random.default_rng(1).integers(1, 2**48, 50, dtype=np.uint64) << np.uint64(16))
    cells = np.arange(0, 50_000, 1000, dtype=np.uint64)
    rows, want = [], np.zeros(50, np.int64)
    for unit in range(4):
        own = np.arange(unit, 50, 1 + unit)
        counts = 2**31 + own * 2**28
        want[own] += counts
        rows += lm._ranges(unit, 1, 0, 0, hashes[own], counts, fan) + lm._ranges(unit, 0, 0, 0, cells[own], counts, fan)
    answers, totals = lm._answers(spark.createDataFrame([(u, o, p, n, bytearray(v), bytearray(c)) for u, o, p, n, v, c in rows], lm._ASKED_SQL), 4, 0, fan)
    for unit in range(4):
        given = sorted((r["part"], r["n"], bytes(r["counts"])) for r in answers.where(f"unit = {unit} and order = 1").collect())
        got = np.concatenate([lm._read_counts(n, c) for _, n, c in given])
        assert got.tolist() == want[np.arange(unit, 50, 1 + unit)].tolist() and got.max() > 2**32
    assert sum(r["totals"][0] for r in totals.where("order = 1").collect()) == want.sum()
    spelled = np.concatenate([lm._read_counts(r["n"], bytes(r["counts"])) for r in totals.where("order = 0").collect()])
    assert sorted(spelled.tolist()) == sorted(want.tolist())


def test_lm_reads_pieces_of_a_text_as_the_whole():
    train = [t.encode() for t in _small_corpus(3, 30)]
    totals, spelling, counts = _local_model(train)
    unit = lm.Unit([t.encode() for t in _small_corpus(4, 9, "a b c dd zz".split())] + [b"a b " * 900])
    automaton = lm.Automaton(unit, counts(unit), totals, spelling)
    assert np.allclose(automaton.read(unit, 10**6), automaton.read(unit, 3)) and np.allclose(automaton.read(unit, 10**6), automaton.read(unit))


def test_lm_is_a_distribution():
    """In every state the probabilities of all next tokens sum to one: those of known ones, and the share of the unknown ones' spelling."""
    train = [t.encode() for t in _small_corpus(6, 25)]
    totals, spelling, counts = _local_model(train)
    unit = lm.Unit(train)
    automaton = lm.Automaton(unit, counts(unit), totals, spelling)
    words = np.arange(len(unit.words.values))
    assert automaton.known.all()
    at = unit.words.first
    q = np.array([0.01 if unit.start[p] < 0 else 0.99 * 10 ** spelling.logs(unit.data, unit.start[[p]], unit.end[[p]])[0] for p in at])
    for state in np.flatnonzero(automaton.fail != 1 + unit.end_word).tolist():  # nothing is read after a text's end
        logs, to = automaton.step(np.full(len(words), state), words)
        assert (to > 0).all()
        unknown, s = np.log(lm.D * totals.different / totals.tokens), state
        while s:
            unknown, s = unknown + automaton.weight[s], automaton.fail[s]
        assert abs(np.exp(logs).sum() + np.exp(unknown) * (1 - q.sum()) - 1) < 1e-6, state
    first = 10 ** np.array([_first_byte(spelling, b) for b in range(256)])
    assert abs(first.sum() - 1) < 1e-6


def test_lm_long_unknown_tokens():
    """The price of an unknown word is its whole spelling, however long it is."""
    totals, spelling, counts = _local_model([b"a b a b a c", b"b c", b"c c a"])
    for n in (10, 300, 5000):
        for of in (totals, lm.Totals(0, 0, totals.cells)):
            unit = lm.Unit([b"x" * n])
            none = [np.zeros(len(g.values), np.int64) for g in (unit.words, unit.pairs, unit.triples)]
            got = lm._scores([b"x" * n], none, of, spelling)[0, 3]
            q = spelling.logs(np.frombuffer(b"x" * n + b"\n", dtype=np.uint8), np.array([0]), np.array([n]))[0] + np.log10(0.99)
            share = np.log10(lm.D * of.different / of.tokens) if of.tokens else 0.0
            assert abs(got - (share + q + share + np.log10(0.01))) < 1e-6 * abs(q), n
    assert q < -1000


def _first_byte(spelling, byte):
    """log10 of the probability that a word begins with a byte; 0x20 ends it at once."""
    data = np.array([byte, 10], dtype=np.uint8)
    cells, _ = lm.Spelling.cells(data, np.array([0]), np.array([0 if byte == 32 else 1]))
    p = 1 / 256
    for k in range(4):
        own = cells[0, k]
        p = (spelling.counts[own] + lm.BYTE_A * p) / (spelling.n[k][(own - lm.Spelling.OFFSETS[k]) >> 8] + lm.BYTE_A)
    return np.log10(p)


def test_lm_edges(spark, edge, none):
    done = lm.score(edge, F.col("doc_id") % 2 == 1)
    rows = done.collect()
    assert len(rows) == edge.count() and set(done.columns) == set(edge.columns) | {"n_tokens", "n_known", "train_tokens", "base_score"}
    assert all(r["n_tokens"] == len(WORD.findall(r["text"] or "")) + 1 and np.isfinite(r["score"]) for r in rows)
    assert sum(r["text"] is None for r in rows) == 1 and lm.score(none, F.lit(True)).count() == 0
    blind = lm.score(edge, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in blind)


def test_toxicity(spark, edge, none):
    r = random.Random(4)
    plain = "the house was near a river and people walked along its quiet green banks every day".split()
    rows = []
    for i in range(600):
        words = [r.choice(plain) for _ in range(30)]
        if i % 5 == 0:
            words[r.randrange(30)] = r.choice(["idiot", "moron", "stupid"])
        rows.append((i, " ".join(words) + f" n{i}", int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert set(model.lexicon) == {"idiot", "moron", "stupid"}
    for hidden in ("1d10t", "idiooooot", "$tup1d", "m0r0n", "i-d-i-o-t", "St**pid***".replace("**p", "up")):
        assert set(model.findings(f"the river {hidden} was near")) & set(model.lexicon), hidden
    assert set(model.findings("such an i d i o t here")) == {"idiot"}
    assert model.findings("the house of 2020 was near 10 rivers and 3rd street") == {}
    assert model.score("you 1d10t") > 0.5 > 0.3 > model.score("the river was near") and model.score("") == model.score("the river")
    done = toxicity.score_all(edge, model, out="score")
    assert done.columns == edge.columns and all(0 <= x["score"] <= 1 for x in done.collect()) and toxicity.score_all(none, model).count() == 0
    read = toxicity.restore(edge.limit(0).union(edge), model).collect()
    assert [x["restored"] is None for x in read] == [x["text"] is None for x in read]
    empty = toxicity.fit(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert empty.score("anything") == 0.5


def test_toxicity_of_hidden_words():
    plain = "the house was near a river and people walked along its quiet green banks every day you had been seen letter i am"
    counts = np.bincount(toxicity._trigrams(" ".join([plain] * 50)), minlength=toxicity.ALPHABET**3)
    model = toxicity.Model({"idiot": 3.0, "moron": 3.0, "stupid": 3.0, "ass": 3.0, "slag": 3.0}, counts, plain=frozenset({"green", "letter"}))
    hidden = {"stuupid": "stupid", "iddiot": "idiot", "mmorron": "moron", "1d!0t": "idiot", "$|@9": "slag", "you/1d10t": "idiot", "1d1#0t": "idiot"}
    hidden |= {c.join("idiot"): "idiot" for c in toxicity.SEPARATORS}
    hidden |= {x: "idiot" for x in ("i d i o t!", '"i d i o t"', "a i d i o t", "y o u i d i o t", "(i. d. i. o. t.)", "i-d i-o-t", "1 d ! 0 t", "i\nd\ni\no\nt", "i   d   i   o   t")}
    hidden |= {"a s s": "ass", "a.s.s": "ass", "$ | @ 9": "slag", "$ t u p ! d": "stupid"}
    for text, word in hidden.items():
        assert word in model.findings(f"the river {text} was near"), text
        assert word in model.findings(text), text
    for text in (plain, "the house of 2020 was near 10 rivers, and 3rd street", "it's 1 2 3 4 5 and/or 455", "a b c d e f g"):
        assert model.findings(text) == {}, text
    assert model.characters.decode("x1!|0+" * 300)


def test_toxicity_skips_no_lattice_that_may_hide_a_word():
    r, lexicon = random.Random(5), {w: 3.0 for w in "idiot stupid moron scumbag glibly eggs".split()}
    own, full = (toxicity.Model(lexicon, np.ones(toxicity.ALPHABET**3)) for _ in range(2))
    full.may_hide = lambda bare: True
    written = {}
    for c, letters in toxicity.IMITATES.items():
        for x in letters:
            written.setdefault(x, []).append(c)
    for _ in range(400):
        word = "".join(r.choice(list(lexicon))[: r.randint(2, 9)] for _ in range(r.randint(1, 2)))
        token = "".join((r.choice(written[c]) if c in written and r.random() < 0.3 else c) * r.choice([1, 1, 2]) + (r.choice(toxicity.SEPARATORS[1:]) if r.random() < 0.2 else "") for c in word)
        assert own.says(token) == full.says(token), token


def test_toxicity_decodes_the_best_of_all_readings():
    """Against brute force over all readings of short tokens."""
    counts = np.bincount(toxicity._trigrams("bigs of oils zips gobs lists bit slags " * 9), minlength=toxicity.ALPHABET**3)
    model = toxicity.CharacterModel(counts)
    size = toxicity.ALPHABET

    def cost(token, i, text):
        def log(text, c):
            last = ([0, 0] + [toxicity._CLASS[x] for x in text])[-2:]
            return -model.logs[(last[0] * size + last[1]) * size + c]

        if i == len(token):
            return log(text, 0) if text else 0.0
        c, out = token[i], []
        out += [more + log(text, toxicity._CLASS[x]) + cost(token, i + 1, text + x) for x, more in [(x, 1.0) for x in toxicity.IMITATES.get(c, "")] + [(c, 0.0)] * c.isalpha()]
        if not c.isalpha() and (c not in toxicity.IMITATES or c in toxicity.SEPARATORS):
            out.append(1.5 + cost(token, i + 1, text))
        if i and text and (c == token[i - 1] or text[-1] in toxicity.IMITATES.get(c, "") or text[-1] == c):
            out.append(0.7 + cost(token, i + 1, text))
        return min(out)

    def told(token):
        """The cost of the decoded text's cheapest way."""
        read = model.decode(token)
        seen = {}

        def walk(i, n):
            if (i, n) not in seen:
                text, c, out = read[:n], token[i] if i < len(token) else "", []
                last = ([0, 0] + [toxicity._CLASS[x] for x in text])[-2:]
                at = (last[0] * size + last[1]) * size
                if i == len(token):
                    seen[i, n] = (-model.logs[at] if n else 0.0) if n == len(read) else 1e9
                    return seen[i, n]
                if n < len(read) and (read[n] == c or read[n] in toxicity.IMITATES.get(c, "")):
                    out.append((0.0 if read[n] == c else 1.0) - model.logs[at + toxicity._CLASS[read[n]]] + walk(i + 1, n + 1))
                if not c.isalpha() and (c not in toxicity.IMITATES or c in toxicity.SEPARATORS):
                    out.append(1.5 + walk(i + 1, n))
                if i and text and (c == token[i - 1] or text[-1] in toxicity.IMITATES.get(c, "") or text[-1] == c):
                    out.append(0.7 + walk(i + 1, n))
                seen[i, n] = min(out, default=1e9)
            return seen[i, n]

        return walk(0, 0)

    r = random.Random(7)
    for _ in range(60):
        token = "".join(r.choice("16!|b0-5g") for _ in range(8))
        assert abs(told(token) - cost(token, 0, "")) < 1e-5, token


def test_toxicity_query_is_accurate(spark):
    from tidewheel.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    clean, toxic = [p for p, x in held if not x], [p for p, x in held if x]
    assert sum(clean) <= 0.03 * len(clean) and sum(toxic) >= 0.5 * len(toxic)


def test_pipeline(spark, edge, none, tmp_path):
    import corpus_pipeline as pipe

    spark.createDataFrame([(1, 0), (7, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, none):
        now = docs
        for name, stage in pipe.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
            now.write.parquet(f"{tmp_path}/{name}-{docs is none}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{docs is none}")
        last = pipe.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert len(last) == now.count() and all(r["exact"] for r in last)


@pytest.mark.parametrize("labels", [[], [(1, 0), (7, 0)], [(1, 1), (7, 1)], [(1, 0), (7, 1)]])
def test_pipeline_keeps_documents_without_a_model(spark, edge, tmp_path, labels):
    import corpus_pipeline as pipe
    from tidewheel.llm.queries import op2_toxicity

    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    assert pipe.drop_toxic(spark, edge, str(tmp_path)).count() == edge.count()
    assert all(r["predicted"] == (r["score"] >= 0.3) == 0 for r in op2_toxicity(spark, str(tmp_path)).collect())
    rows = pipe.run(spark, str(tmp_path)).collect()
    assert {1, 7} <= {r["doc_id"] for r in rows} and all(r["exact"] for r in rows)


def test_toxicity_of_positives_in_one_fold(spark):
    """Whichever fold the positives fall in, the model knows them, and texts without findings stay below the threshold."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5))
    for rest in (True, False):
        toxic = (F.col("n") % 4 == 0) & ((fold == 0) if rest else (fold != 0))
        docs = spark.range(800).select(F.col("id").alias("doc_id"), F.expr("id div 5").alias("n"))
        docs = docs.withColumn("toxic", toxic.cast("int"))
        docs = docs.withColumn("text", F.concat(F.lit("the river n"), "doc_id", F.lit(" was near m"), "doc_id", F.when(toxic, F.lit(" idiot")).otherwise(F.lit(" house"))))
        model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
        assert "idiot" in model.lexicon and model.score("you idiot") > 0.5 and model.score("the river") < 0.3


def test_pipeline_run(spark):
    import corpus_pipeline as pipe

    docs = _documents(spark)
    rows = pipe.run(spark, SF).collect()
    groups = _groups({i: r["text"] for i, r in docs.items()})
    assert rows and all(r["exact"] for r in rows)
    assert {groups[r["doc_id"]][0] for r in rows} <= {g for g, _ in groups.values()}
    kept = Counter(groups[i][0] for i in {r["doc_id"] for r in rows})
    assert max(kept.values()) == 1, "one document of each group"
