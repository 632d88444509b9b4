"""Classifier, language model, near-dedup and line dedup against brute force."""

import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddymesh.llm import brown, common, line_dedup, near_dedup, quality

SCHEMA = "doc_id long, text string, row string, n int, root int, word string, ranges string, line int"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "r", 1, 2, "w", "x", 3) for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def words(text):
    data = (text or "").encode()
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data).split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(texts, k, threshold=(80, 100)):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    up = {d: d for d in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(texts)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                both = len(x & y)
                if threshold[1] * both >= threshold[0] * (len(x) + len(y) - both):
                    up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    made = [None, "", "  ", "one", "one", "One two", "a b c d e f"]
    for _ in range(150):  # a large group around the threshold
        own = list(base)
        for at in rng.integers(0, len(own), rng.integers(0, 6)):
            own[at] = f"x{rng.integers(0, 10**6)}"
        made.append(" ".join(own))
    made += [" ".join(base)] * 40 + [" ".join(f"y{x}" for x in rng.integers(0, 50, 30)) for _ in range(40)] + ["long " * 30_000]
    docs = frame(spark, made)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k).collect()}
    want = brute_components(dict(enumerate(made)), k)
    assert {d: v[:2] for d, v in got.items()} == want
    assert all(v[2] == (d == v[1]) for d, v in got.items())
    out = near_dedup.deduplicated(docs, k)
    assert out.columns == docs.columns and out.count() == len({v[1] for v in want.values()})


def test_near_duplicates_with_odd_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "z z z z z z z")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert sorted(k for _, _, k in got) == [False, False, True, True]
    assert [c for _, c, _ in got if c != -1] == [5, 5, 5]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    for n, same in ((2000, 1600), (400, 380), (60, 50)):
        guess = []
        for _ in range(40):
            common = rng.integers(0, 1 << 63, same, dtype=np.uint64) * np.uint64(2)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - same, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])) for _ in range(2))
            guess.append(near_dedup.estimated(near_dedup.sketch(a)[None], near_dedup.sketch(b)[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(guess) - same / (2 * n - same)) < 0.04


def brute_lines(texts, least=50):
    """Deleted lines by the definition: maximal runs that share a fingerprint with its first occurrence."""
    import hashlib

    lines = {d: [(i, x, len(words(x)), int(hashlib.md5(x.encode()).hexdigest()[:15], 16)) for i, x in enumerate(t.split("\n")) if words(x)] for d, t in texts.items() if t is not None}
    prints = defaultdict(set)
    for d, own in lines.items():
        for i in range(len(own)):
            total, j = 0, i
            while j < len(own) and total < least:
                total, j = total + own[j][2], j + 1
            if total >= least:
                h, pos = min((own[p][3], p) for p in range(i, j))
                prints[h].add((d, pos))
    gone = defaultdict(set)
    for places in prints.values():
        d0, p0 = min(places)
        for d, p in places - {(d0, p0)}:
            a, b, shift = lines[d], lines[d0], p - p0
            equal = lambda q: 0 <= q < len(a) and 0 <= q - shift < len(b) and a[q][3] == b[q - shift][3]
            lo = hi = p
            while equal(lo - 1):
                lo -= 1
            while equal(hi + 1):
                hi += 1
            if sum(a[q][2] for q in range(lo, hi + 1)) >= least:
                gone[d] |= {a[q][0] for q in range(lo, hi + 1)}
    return gone


def test_line_dedup(spark, texts):
    rng = np.random.default_rng(4)
    passage = [" ".join(f"p{rng.integers(0, 99)}" for _ in range(n)) for n in (20, 20, 20, 60)]
    made = dict(texts)
    extra = [None, "", "\n\n", "short\nshort", "\n".join(passage), "x y\n" + "\n\n".join(passage[:3]) + "\nz", "own line\n" + passage[3] + "\nend", passage[3] + "\n" + passage[3], "\n".join(["again " * 20] * 9)]
    extra += [f"unique {k}\n{passage[3]}\nunique too {k}" for k in range(60)]
    made |= {10_000 + k: t for k, t in enumerate(extra)}
    docs = spark.createDataFrame([(d, t, "r", 1, 2, "w", "x", 3) for d, t in made.items()], SCHEMA).repartition(4)
    gone = brute_lines(made)
    rows = line_dedup.line_dedup(docs, report=True).collect()
    assert {r.doc_id: set(r.removed) for r in rows} == {d: gone.get(d, set()) for d in made}
    for r in rows:
        assert r.text == (None if made[r.doc_id] is None else "\n".join(x for i, x in enumerate(made[r.doc_id].split("\n")) if i not in gone[r.doc_id]))
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and out.count() == len(made)
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def repeated_lines(texts, least=50):
    """Deleted lines by content: those in any run of that many words that also stands at an earlier place."""
    lines = {d: [(i, x, len(words(x))) for i, x in enumerate(t.split("\n")) if words(x)] for d, t in texts.items()}
    runs = defaultdict(list)
    for d, own in sorted(lines.items()):
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(n for _, _, n in own[a : b + 1]) >= least:
                    runs[tuple(x for _, x, _ in own[a : b + 1])].append((d, [i for i, _, _ in own[a : b + 1]]))
    gone = defaultdict(set)
    for places in runs.values():
        for d, at in places[1:]:
            gone[d] |= set(at)
    return gone


def test_line_dedup_finds_repeats_by_content(spark):
    import hashlib

    rng = np.random.default_rng(8)
    # The common line has the smallest hash of all, so it was every window's fingerprint.
    common_line = min((f"all rights reserved {k}" for k in range(3000)), key=lambda x: hashlib.md5(x.encode()).hexdigest())
    body = ["\n".join(" ".join(f"q{x}" for x in rng.integers(0, 10**6, 30)) for _ in range(2)) for _ in range(3)]
    tail = "five more words at end"
    made = {0: f"a junk page\n{common_line}\nnothing else here", 1: f"{common_line}\n{body[0]}", 2: f"own\n{common_line}\n{body[0]}\nend", 3: f"{body[1]}\nother", 4: f"{body[1]}\n{tail}", 5: f"x\n{body[1]}\n{tail}\ny"}
    # Few kinds of lines of many lengths: repeats of all sorts, also within a document.
    kinds = [" ".join(f"k{k}w{j}" for j in range(n)) for k, n in enumerate((1, 3, 7, 12, 20, 24, 31, 49, 50))]
    made |= {10 + d: "\n".join(kinds[k] if k < 9 else "" for k in rng.integers(0, 10, rng.integers(0, 14))) for d in range(80)}
    want = repeated_lines(made)
    assert want[2] == {1, 2, 3} and want[4] == {0, 1} and want[5] == {1, 2, 3}
    docs = spark.createDataFrame([(d, t, "r", 1, 2, "w", "x", 3) for d, t in made.items()], SCHEMA).repartition(4)
    assert {r.doc_id: set(r.removed) for r in line_dedup.line_dedup(docs, report=True).collect()} == {d: want[d] for d in made}


@pytest.mark.parametrize("sizes", [(1 << 17, 1 << 15, 1024, 64), (50, 30, 10, 4), (0, 0, 0, 3)])
def test_brown_scores(spark, texts, sizes):
    made = {d: t for d, t in texts.items() if d < 60} | {1000: None, 1001: "", 1002: "unseenword unseenword And", 1003: " x  Y\x0bz"}
    docs = spark.createDataFrame([(d, t, "r", 1, 2, "w", "x", 3) for d, t in made.items()], SCHEMA).repartition(3)
    head, classed, clustered, n_classes = sizes
    rows = {r.doc_id: r for r in brown.brown_scores(docs, 7, head, classed, clustered, n_classes).collect()}
    train = [d for d in made if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for d in train for w in [*words(made[d]), "end"])
    n, v = sum(count.values()), len(count)
    for d, r in rows.items():
        own = [*words(made[d]), "end"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert r.score < 0 and math.isfinite(r.score)


def test_brown_model_is_better_than_its_base(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    r = brown.brown_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_exchange_finds_classes():
    rng = np.random.default_rng(6)
    pairs = np.zeros((22, 22))
    for w in range(20):
        for u in range(20):
            pairs[w, u] = rng.poisson(40 if (w % 2) != (u % 2) else 2)
    of = brown.exchange(pairs, 20, 2)
    assert len({of[w] for w in range(0, 20, 2)}) == len({of[w] for w in range(1, 20, 2)}) == 1 and of[0] != of[1]


def test_brown_rare_words_have_classes(spark):
    rng = np.random.default_rng(5)
    # x words stand where a words do, y words where b words do; all x and y are beyond the words that workers hold.
    texts = [" ".join(f"{k}{rng.integers(0, 5)}" if rng.random() < 0.8 else f"{far}{rng.integers(0, 400)}" for _ in range(60) for k, far in ("ax", "by")) for _ in range(120)]
    xs, ys = [f"x{k}" for k in range(40)], [f"y{k}" for k in range(40)]
    turns, blocks = " ".join(w for p in zip(xs, ys, strict=True) for w in p), " ".join(xs + ys)
    ids = [d for d in range(5000, 5100) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    docs = spark.createDataFrame([*enumerate(texts), (ids[0], turns), (ids[1], blocks)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in brown.brown_scores(docs, 7, 10, 10, 10, 2).where("held_out").collect()}
    # The same words; only their classes tell the orders apart.
    assert got[ids[0]].base_score == pytest.approx(got[ids[1]].base_score)
    assert got[ids[0]].score > got[ids[1]].score + 20


def test_brown_without_texts(spark):
    assert brown.brown_scores(frame(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = spark.createDataFrame([(90_000, None), (90_001, ""), (90_002, "ab"), (None, "a text without an id"), (90_003, "x" * 300_000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("quality", F.lit("clash")).withColumn("of", F.lit(1))
    model = quality.fitted(both, labels.withColumn("text", F.lit("clash")))
    rows = quality.quality_scores(both, model)
    got = {r.of.doc_id: r.quality_score for r in rows.collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == docs.count() + 5
    assert got[90_000] == got[90_001] == got[90_002] == model.share
    held = [(got[r.doc_id], r.quality) for r in labels.where(quality.held_out(F.col("doc_id"))).collect()]
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.93
    none = quality.fitted(both, labels.limit(0))
    assert {r.quality_score for r in quality.quality_scores(both.limit(5), none).collect()} == {1.0}
    assert quality.quality_scores(both.limit(0), none).count() == 0


def test_quality_scores_by_plain_cosines_and_votes(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(900_001, None), (900_002, ""), (None, "ab")], "doc_id long, text string"), allowMissingColumns=True)
    model = quality.fitted(docs, labels)
    rows = docs.collect()

    def terms(text):
        data = (text or "").encode()
        if len(data) < 3:
            return None
        out = Counter()
        for a, b, c in zip(data, data[1:], data[2:]):
            out[((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20] += 1
        own = text.split()
        if own:
            again = sum(own[k] in own[:k] for k in range(len(own))) if len(own) < 2000 else len(own) - len(set(own))
            near = sum(own[k] == own[k - 1] for k in range(1, len(own))) + sum(own[k] == own[k - 2] for k in range(2, len(own)))
            for k, share in enumerate((again / len(own), near / len(own))):
                out[quality.TERMS + k * quality.REPEATS + min(quality.REPEATS - 1, int(share * quality.REPEATS))] = math.sqrt(len(data) - 2)
        return out

    counted = [terms(r.text) for r in rows]
    seen = Counter(t for c in counted if c for t in c)
    idf = np.array([math.log((len(rows) + 1) / (seen[t] + 1)) + 1 for t in range(quality.WIDTH)])
    assert np.allclose(model.idf, idf, atol=1e-5)

    def vector(found):
        dense = np.zeros(quality.WIDTH)
        for t, n in found.items():
            dense[t] = math.log1p(n) * idf[t]
        own = dense / np.linalg.norm(dense) @ model.basis.astype(float)
        return own / np.linalg.norm(own)

    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    once = {r.doc_id: c for r, c in sorted(zip(rows, counted), key=lambda x: x[0].text or "", reverse=True) if r.doc_id in marks and c}
    vectors = sorted((marks[d], tuple(vector(c))) for d, c in once.items())
    of_model = sorted((int(y), tuple(v)) for y, v in zip(model.labels, model.vectors.astype(float)))
    assert len(vectors) == len(of_model)
    for y in (0, 1):
        a, b = (np.array([v for kind, v in side if kind == y]) for side in (vectors, of_model))
        assert np.abs((a @ b.T).max(axis=1) - 1).max() < 1e-4  # each labelled text is there
    want = Counter()
    for r, c in zip(rows, counted):
        if c is None:
            score = sum(marks.values()) / len(marks)
        else:
            cosine = model.vectors.astype(float) @ vector(c)
            near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
            vote = {k: math.exp(quality.SHARPNESS * (cosine[k] - 1)) * model.stands[k] for k in near}
            score = sum(v for k, v in vote.items() if model.labels[k] == 1) / sum(vote.values())
        want[r.doc_id, round(score, 2)] += 1
    got = quality.quality_scores(docs, model).select("of.doc_id", "quality_score").collect()
    by_id = lambda found: sorted((k[0] if k[0] is not None else -1, k[1]) for k in found.elements())
    scores = sorted((r.doc_id if r.doc_id is not None else -1, r.quality_score) for r in got)
    assert [d for d, _ in scores] == [d for d, _ in by_id(want)]
    assert np.allclose([s for _, s in scores], [s for _, s in by_id(want)], atol=0.011)


def test_class_model_by_its_table_of_classes(spark, texts, monkeypatch):
    made = [*list(texts.values())[:120], None, "", "Word word unseen"]
    docs, tables, real = frame(spark, made), {}, brown.stored
    monkeypatch.setattr(brown, "stored", lambda df, what, *rest: tables.setdefault(what, real(df, what, *rest)))
    got = {r.doc_id: r for r in brown.brown_scores(docs, head=400, classed=100, clustered=40, n_classes=8).collect()}
    learnt = {bytes(r.word): (r.n, r["class"]) for r in tables["classes"].collect()}
    training = [words(t) for k, t in enumerate(made) if zlib.crc32(str(k).encode()) % 7 != 2]
    counts = Counter(w for own in training for w in own)
    assert {w: n for w, (n, _) in learnt.items()} == counts  # every training word has a class
    tokens, types, end = sum(counts.values()) + len(training), len(counts) + 1, 8
    in_class, once, types_in = Counter(), Counter(), Counter()
    for n, c in learnt.values():
        in_class[c] += n
        types_in[c] += 1
        once[c] += n == 1
    unknown = max(range(9), key=lambda c: (once[c], -c))
    of = lambda w: learnt[w][1] if w in learnt else unknown
    moves = Counter()
    for own in training:
        seq = [end, *map(of, own), end]
        moves.update(zip(seq, seq[1:]))
    into = [sum(moves[a, c] for a in range(9)) for c in range(9)]
    unigram = [(n + 1) / (sum(into) + 9) for n in into]
    step = [[(moves[a, c] + brown.SMOOTH * unigram[c]) / (sum(moves[a, x] for x in range(9)) + brown.SMOOTH) for c in range(9)] for a in range(9)]
    assert all(abs(sum(row) - 1) < 1e-9 for row in step)
    whole = in_class[unknown] + types_in[unknown] + 1
    emit = lambda w: (learnt.get(w, (0, 0))[0] + 1) / whole if of(w) == unknown else learnt[w][0] / in_class[of(w)]
    for c in range(8):  # the words of a class, and the unknown word in its class, share 1
        if in_class[c]:
            assert abs(sum(emit(w) for w in learnt if of(w) == c) + (1 / whole if c == unknown else 0) - 1) < 1e-9
    for k, text in enumerate(made):
        own = words(text)
        seq = [end, *map(of, own), end]
        score = sum(math.log10(step[a][b]) for a, b in zip(seq, seq[1:])) + sum(math.log10(emit(w)) for w in own)
        base = sum(math.log10((counts[w] + 1) / (tokens + types + 1)) for w in own) + math.log10((len(training) + 1) / (tokens + types + 1))
        assert math.isclose(got[k].score, score, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(got[k].base_score, base, rel_tol=1e-9, abs_tol=1e-6)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own) + 1, sum(w in counts for w in own) + 1, tokens)


def test_row_numbers_stay(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "r") for k in range(400)], "doc_id long, text string, row string").repartition(7).orderBy(F.rand())
    rows = common.numbered(docs)
    assert rows.select("row").distinct().count() == 400 and rows.select("of.*").columns == docs.columns
    assert sorted((r.row, r.of.doc_id) for r in rows.collect()) == sorted((r.row, r.of.doc_id) for r in rows.repartition(3).collect())


def test_shared_folder_is_named_on_a_cluster():
    conf = type("Conf", (), {"get": lambda self, key, default=None: None})()
    context = type("Context", (), {"getConf": lambda self: conf, "master": "spark://host:7077"})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(type("Session", (), {"sparkContext": context, "conf": conf})())


def test_operators_leave_columns_of_their_own_names_alone(spark):
    rows = [(1, "a b c d e f g", "x", 1, 2, "o"), (2, "a b c d e f g", "y", 3, 4, "p"), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_dedup_row string, row int, key int, of string")
    assert sorted(tuple(r) for r in near_dedup.deduplicated(docs).collect()) == [rows[0], rows[2]]
    assert sorted(tuple(r) for r in line_dedup.line_dedup(docs).collect()) == rows


def test_line_dedup_of_equal_lines_is_linear(spark):
    docs = spark.createDataFrame([(1, "\n".join(["one line of seven words is this"] * 30_000)), (2, "a line " * 30)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: len(r.removed) for r in line_dedup.line_dedup(docs, report=True).collect()}
    assert got == {1: 29_999, 2: 0} and time.perf_counter() - began < 60
