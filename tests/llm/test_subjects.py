"""Subject areas: parts of the model, and accuracy on documents held out."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import subjects
from tablelens.llm.common import canonical_source
from tablelens.llm.subjects import CHANGE, MESSAGE, PATH, Terms, assign_subjects, fit_subjects, learn_terms, read_lines, train

DATA = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")


def test_lines():
    text = "Fix violin\n\nbody text\ndiff --git a/src/x_y.py b/src/x_y.py\nindex 1..2 100644\n--- a/src/x_y.py\n+++ b/src/x_y.py\n@@ -1,2 +1,2 @@\n kept = 1\n-oldName\n+newName = fooBar(2)\n"
    d = read_lines(text)
    assert d.lines == [(MESSAGE, ["Fix", "violin"]), (MESSAGE, ["body", "text"]), (PATH, ["src", "x", "y", "py"]), (CHANGE, ["old", "Name"]), (CHANGE, ["new", "Name", "foo", "Bar"])]
    assert d.n_changed == 2 and d.n_files == 1
    sql = read_lines("x\ndiff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1,2 @@\n--- quantum comment\n+++ counter\ndiff --git a/b.lua b/b.lua\n--- a/b.lua\n+++ b/b.lua\n@@ -1 +1 @@\n--- violin\n")
    assert [w for zone, w in sql.lines if zone == CHANGE] == [["quantum", "comment"], ["counter"], ["violin"]] and sql.n_changed == 3
    for t in (None, "", "\n\n"):
        assert read_lines(t).lines == []
    assert len(read_lines("+x" * 1_000_000).lines) == 1


def test_terms_by_form():
    t = Terms({"molekul": (0,), "harvest": (1,), "galaxy": (2,), "bondage": (0, 2)}, {"result", "harvey"})
    for raw, s in (("Molekül", 0), ("HARVESTS", 1), ("harvesting", 1), ("havrest", 1), ("harvvest", 1), ("harest", 1), ("galaxies", -1), ("result", -1), ("harvey", -1), ("Molekülzahl", 0), ("x", -1)):
        assert t.of(raw) == (() if s < 0 else (s,)), raw
    assert t.of("Bondage") == (0, 2)


def test_a_term_of_two_subjects():
    docs = [read_lines(f"{w} here") for w in ["tempo", "tempo", "violin", "goal"] * 8 + ["plain"] * 150]
    labels = [frozenset(s) for s in [{0}, {1}, {0}, {1}] * 8 + [()] * 150]
    terms = learn_terms(docs, labels, 2)
    assert terms.of("tempo") == (0, 1) and terms.of("violin") == (0,) and terms.of("goal") == (1,) and terms.of("here") == ()


def synthetic(n, seed):
    rng = random.Random(seed)
    words = {"music": ["violin", "sonata", "choir", "tempo"], "law": ["court", "verdict", "lawsuit", "clause"]}
    texts, labels = [], []
    for _ in range(n):
        about = [s for s in words if rng.random() < 0.4]
        lines = [f"handle the {rng.choice(words[s])} when {rng.choice(words[s])} changes" for s in about for _ in range(2)]
        if rng.random() < 0.4:
            lines.append(f"seen while looking at the {rng.choice(sum(words.values(), []))} thing")
        rng.shuffle(lines)
        texts.append("\n".join(["some change", *lines]))
        labels.append(frozenset(about))
    return texts, labels


def test_chain_and_beam():
    texts, labels = synthetic(600, 1)
    model = train(texts, ["s"] * 600, labels, ["law", "music"])
    test, truth = synthetic(200, 2)
    x = np.stack([f if (f := model.features(t)) is not None else np.zeros((2, model.links.evidence.shape[1])) for t in test])
    got = model.decode(x, np.zeros(200, int))
    found = [frozenset(model.subjects[s] for s in np.flatnonzero(row)) for row in got]
    assert sum(a == b for a, b in zip(found, truth)) >= 190
    every = {}
    fixed, after = model.links.fixed(x, np.zeros(200, int)), model.links.after
    for bits in range(4):  # the beam is wide enough for two subjects to be exact
        y = np.array([bits & 1, bits >> 1], bool)
        z = np.stack([fixed[:, s] + (y * after[s])[model.order[: model.order.index(s)]].sum() for s in range(2)], 1)
        z = np.where(x.any(axis=2), model.slope * z + model.shift, z)
        every[bits] = -np.logaddexp(0, np.where(y, -z, z)).sum(axis=1)
    best = np.stack([every[b] for b in range(4)], 1).argmax(axis=1)
    assert (best == got @ np.array([1, 2])).all()


def test_no_labels_and_no_subjects(spark):
    docs = spark.createDataFrame([(1, "the violin", "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    for names in ([], ["music"]):
        model = fit_subjects(docs, labels, spark.createDataFrame([(n,) for n in names], "subject string"))
        assert assign_subjects(docs, model).collect() == []
    model = fit_subjects(docs.limit(0), labels, spark.createDataFrame([("music",)], "subject string"))
    assert assign_subjects(docs.limit(0), model).collect() == []


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the violin " * (1 + i % 50), "s") for i in range(300)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, "music") for i in range(300)], "doc_id bigint, subject string")
    names = spark.createDataFrame([("music",)], "subject string")
    seen = []
    monkeypatch.setattr(subjects, "train", lambda texts, *rest: seen.append(texts))
    for how in ({"sample": 40}, {"sample_chars": 9_000}, {"longest": 100}, {}):
        fit_subjects(docs, labels, names, **how)
    assert len(seen[0]) == 40 and 0 < sum(map(len, seen[1])) <= 9_000 and max(map(len, seen[2])) <= 100 and len(seen[3]) == 300
    fit_subjects(docs.repartition(5), labels, names, sample_chars=9_000)
    assert seen[4] == seen[1]


def test_canonical_source(spark):
    df = spark.createDataFrame([("Forge-Alpha ",), (" forge_alpha",), ("FORGE  ALPHA\t",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(canonical_source(F.col("s"))).collect()] == ["forge_alpha"] * 3 + [None, ""]


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/subject_labels.parquet")
    test = F.pmod(F.xxhash64("doc_id", F.lit("test")), F.lit(3)) == 0
    model = fit_subjects(docs, labels.filter(~test), spark.read.parquet(f"{DATA}/subjects.parquet"))
    wanted = labels.filter(test)
    clashing = docs.withColumns({c: F.lit(1) for c in ("subject", "labels", "labelled_id")})
    got = {tuple(r) for r in assign_subjects(clashing, model).join(wanted.select("doc_id").distinct(), "doc_id").collect()}
    return got, {tuple(r) for r in wanted.filter(F.col("subject").isNotNull()).select("doc_id", "subject").collect()}


def test_held_out_accuracy(held_out):
    got, true = held_out
    assert len(true) > 300
    assert len(got & true) / len(got) > 0.93 and len(got & true) / len(true) > 0.93  # some labels are wrong
