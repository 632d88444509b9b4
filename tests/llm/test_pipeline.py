"""The corpus pipeline: each stage against brute force on its own input, odd rows, reruns, empty tables."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_models import brute_components, brute_lines, words

import corpus_pipeline
from eddymesh.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, of int, mix_at string, key string, length int"


def made():
    rng = random.Random(3)
    good = ["river", "stone", "window", "garden", "letter", "morning", "silver", "market", "winter", "travel"]
    passage = "\n".join(" ".join(rng.choices(good, k=12)) for _ in range(6))
    texts = ["\n".join(" ".join(rng.choices(good, k=10)) + f" {i}-{j}" for j in range(rng.randint(4, 12))) for i in range(60)]
    texts += [f"opening words {i}\n{passage}\nclosing words {i} and some more of them" for i in range(5)]
    texts += [" ".join(rng.choices(["buy", "now", "!!!", "cheap"], k=60)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " end", None, "", " ", "x " * 9000]
    rows = [(k if k != 7 else None, t, "en", [None, "a", "b", "hot", "hot", "hot"][k % 6], len(t or ""), "r", 1, "m", "k", 2) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]], [(k, int(not 65 <= k < 105), 0) for k in range(len(texts))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, labels = made()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_each_stage_on_its_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        f(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = before, docs.collect()
        if name != "pack":
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
    whole = lambda found: Counter(tuple(r) for r in found)

    # Kept rows are those that the classifier scores 0.7 or more, unchanged; clean ones stay, junk goes.
    before, after = rows["quality"]
    model = quality.fitted(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores([r.text for r in before])
    assert whole(after) == whole(r for r, s in zip(before, scores) if s >= 0.7)
    names = {r.doc_id for r in after}
    assert len(names & set(range(65))) > 60 and len(names & set(range(65, 105))) < 4

    # Rows in the order in which the first of equal lines stays.
    before, after = rows["line_dedup"]
    order = sorted(range(len(before)), key=lambda k: (before[k].doc_id is None, before[k].doc_id or 0))
    gone = brute_lines({at: before[k].text for at, k in enumerate(order)})
    want = Counter()
    for at, k in enumerate(order):
        text = before[k].text
        if text is not None:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(at, ()))
        want[before[k].doc_id, text, len(text) if text is not None else None] += 1
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == want

    before, after = rows["near_dedup"]
    order = sorted(range(len(before)), key=lambda k: (before[k].doc_id is None, before[k].doc_id or 0))
    groups = brute_components({at: before[k].text for at, k in enumerate(order)}, 5)
    assert whole(after) == whole(before[k] for at, k in enumerate(order) if groups[at][1] == at)

    # None to two times each, near the targets; only rows of the input.
    before, after = rows["mix"]
    taken, had, size = whole(after), whole(before), defaultdict(lambda: [0, 0])
    assert all(0 < n <= 2 * had[r] for r, n in taken.items())
    for side, found in enumerate((before, after)):
        for r in found:
            size[r.source][side] += len(words(r.text))
    total = sum(a for a, _ in size.values())
    longest = max(len(words(r.text)) for r in before)
    assert all(b <= 2 * a for a, b in size.values()) and abs(sum(b for _, b in size.values()) - 1.5 * total) <= len(size) * longest

    before, after = rows["pack"]
    places = defaultdict(list)
    for r in after:
        assert 0 < r.length <= 2048
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(1 for r in after if r.piece == 0) == len(before)


def test_reruns_agree_and_leave_no_tables(spark, folder):
    from eddymesh.llm.common import shared_folder

    at = shared_folder(spark).removeprefix("file:").replace("//", "/")
    first = corpus_pipeline.run(spark, folder)
    one = Counter(tuple(r) for r in first.collect())
    left = set(os.listdir(at))
    second = corpus_pipeline.run(spark, folder)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[c] for c in keys) for r in second.collect()) == Counter(tuple(r[c] for c in keys) for r in first.collect())
    assert sum(one.values()) == second.count()
    assert len(set(os.listdir(at)) - left) == 1  # the result


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
