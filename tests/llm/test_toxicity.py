import math
import re

import numpy as np
import pyarrow as pa
import regex

from siltstone.llm import toxicity
from siltstone.llm.common import doc_mod, table
from siltstone.llm.queries import queries

LABELLED = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, hits int, features string"


def test_held_out_documents_are_ranked_and_called_right(spark):
    rows = queries()["op3_toxicity"](spark, LABELLED).collect()
    assert len(rows) == table(spark, LABELLED, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in table(spark, LABELLED, "labels").where("toxic is not null").collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert bad and good
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.95
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) > 0.95


def test_features_count_what_they_name():
    texts = pa.array(["You are a M0R0N !!", "", "calm words here"])
    found = toxicity.features(texts, {"moron$": 3.0})
    at = dict(zip(toxicity.FEATURES, found.T, strict=True))
    assert at["hits"].tolist() == [1, 0, 0] and at["masked"].tolist() == [1, 0, 0]
    assert math.isclose(at["density"][0], 100 / 5) and math.isclose(at["addressed"][0], 100 / 5)
    assert at["capitals"][0] > 0.3 and at["exclaimed"][1] == 0


def test_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "you rotten vile scum" if i % 2 else "a calm and pleasant day", "s", 1, "f") for i in range(400)], SCHEMA)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    model = toxicity.fit(docs, labels, doc_mod("doc_id", 5) != 0)
    odd = spark.createDataFrame([(1, None, "s", 1, "f"), (1, None, "s", 1, "f"), (None, "", "s", 1, "f"), (3, "scum " * 100_000, None, None, None), (4, "ok", "", 0, "")], SCHEMA)
    scored = model.score(odd)
    assert sorted(scored.columns) == sorted(c for c in odd.columns if c != "text")
    assert scored.count() == 5
    stayed = toxicity.keep(odd, model)
    assert stayed.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in stayed.collect()) == [0, 1, 1, 4]
    assert toxicity.keep(odd.limit(0), model).count() == 0


def test_rows_that_are_kept_send_their_text_once(spark, monkeypatch):
    """pipeline: a row's text went to Python twice, within the row and beside it."""
    docs = spark.createDataFrame([(i, "you rotten vile scum" if i % 2 else "a calm and pleasant day", "s", 1, "f") for i in range(400)], SCHEMA)
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), doc_mod("doc_id", 5) != 0)
    sent, given = [], toxicity.with_features
    monkeypatch.setattr(toxicity, "with_features", lambda rows, *more: (sent.append(rows.schema.simpleString()), given(rows, *more))[1])
    odd = docs.where("doc_id < 4").unionByName(spark.createDataFrame([(5, None, None, None, None)], SCHEMA))
    stayed = toxicity.keep(odd.select("hits", "text", "doc_id", "score", "features"), model)
    assert [s.count("text:string") for s in sent] == [1]
    assert stayed.columns == ["hits", "text", "doc_id", "score", "features"]
    assert sorted(map(tuple, stayed.collect()), key=lambda r: r[2]) == [(1, "a calm and pleasant day", i, "s", "f") for i in (0, 2)] + [(None, None, 5, None, None)]


def test_labels_of_one_class_or_none_give_a_constant(spark):
    docs = spark.createDataFrame([(i, f"text {i}", None, None, None) for i in range(50)], SCHEMA)
    for labels in (docs.selectExpr("doc_id", "0 as toxic"), docs.selectExpr("doc_id", "cast(null as int) as toxic")):
        model = toxicity.fit(docs, labels, doc_mod("doc_id", 5) != 0)
        assert {r.score for r in model.score(docs).collect()} == {0.0}


def test_rare_labels_are_all_drawn_and_reach_every_part(spark):
    """op3_toxicity, pipeline"""
    docs = spark.createDataFrame([(i, "you rotten vile scum" if i % 400 == 0 else f"a calm and pleasant day {i}", "s", 1, "f") for i in range(4000)], SCHEMA)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 400 = 0 as int) as toxic")
    model = toxicity.fit(docs, labels, doc_mod("doc_id", 5) != 9, sample=100)
    assert model.trees is not None
    scored = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert min(s for i, s in scored.items() if i % 400 == 0) > max(s for i, s in scored.items() if i % 400)


def plain_features(text: str, lexicon: dict[str, float]) -> dict[str, float]:
    """The features of one text by loops over its words."""
    chunks = re.split(r"[\x09-\x0D ]+", text)
    spell = str.maketrans({k: v for k, v in toxicity.STAND_INS.items()})
    forms = [("".join(regex.findall(r"\p{L}", c.lower())), "".join(regex.findall(r"\p{L}", c.lower().translate(spell)))) for c in chunks]

    def weight(word: str) -> float:
        return max([0.0, lexicon.get(word + "$", 0.0), *(lexicon.get(word[:n], 0.0) for n in toxicity.STEMS)])

    shown = [weight(p) for p, _ in forms]
    found = [max(s, weight(r)) for s, (_, r) in zip(shown, forms, strict=True)]
    spoken = [p in toxicity.ADDRESS for p, _ in forms]
    words, signs = max(1, sum(1 for c in chunks if c)), max(1, sum(map(len, chunks)))
    letters, capitals = [len(regex.findall(r"\p{L}", c)) for c in chunks], [len(regex.findall(r"\p{Lu}", c)) for c in chunks]
    hits = [k for k, w in enumerate(found) if w > 0]
    near = sum(any(spoken[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k in hits)
    return {
        "hits": len(hits),
        "density": 100 * len(hits) / words,
        "weight": sum(found),
        "densest": max((sum(k <= j < k + toxicity.WINDOW for j in hits) for k in hits), default=0),
        "addressed": 100 * near / words,
        "masked": sum(w > s for w, s in zip(found, shown, strict=True)),
        "capitals": sum(capitals) / max(1, sum(letters)),
        "shouted": sum(a == b > 2 for a, b in zip(capitals, letters, strict=True)) / words,
        "punctuation": sum(len(regex.findall(r"[^\p{L}\p{N}\s]", c)) for c in chunks) / signs,
        "exclaimed": 100 * sum(c.count("!") + c.count("?") for c in chunks) / signs,
        "obfuscated": 100 * sum(bool(regex.search(r"\p{L}[^\p{L}\s'’-]+\p{L}", c)) for c in chunks) / words,
        "log_words": math.log1p(words),
    }


def walked(lines: list[str], row: list[float]) -> float:
    """What a tree in Spark's text form predicts for a row."""
    at = 0
    while not (leaf := re.match(r"\s*Predict: (\S+)", lines[at])):
        depth, feature, sign, limit = re.match(r"(\s*)If \(feature (\d+) (<=|>) (\S+)\)", lines[at]).groups()
        assert sign == "<="
        if row[int(feature)] <= float(limit):
            at += 1
        else:
            at = next(k for k in range(at + 1, len(lines)) if lines[k].startswith(f"{depth}Else")) + 1
    return float(leaf[1])


def test_scores_are_those_of_the_trees_as_text(spark):
    """op3_toxicity, pipeline: every document of a folder, by loops over words, trees and the calibration's steps."""
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, doc_mod("doc_id", 5) != 0)
    trees = [re.split(r"\n", t.toDebugString.strip("\n"))[1:] for t in model.trees.stages[-1].trees]
    weights = model.trees.stages[-1].treeWeights
    steps, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in model.score(docs.select("doc_id", "text")).collect():
        found = plain_features(texts[r.doc_id], model.lexicon)
        row = [found[k] for k in toxicity.FEATURES]
        margin = sum(w * walked(t, row) for w, t in zip(weights, trees, strict=True))
        assert math.isclose(r.score, float(np.clip(np.interp(margin, steps, values), 0, 1)), abs_tol=1e-9), r.doc_id
