"""Names, languages, context words, propagation, streams' state and the file sink, at their edges and on held-out texts."""

import json
import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.functions.matches import spans
from docveil.functions.stem import stem
from docveil.operators import detect, langmodel, names, resolve, tagger

GIVEN = "Bodil Verner Signe Torkil Agnete Malthe Rigmor Ebbe Jytte Viggo".split()
FAMILY = "Bruun Kvist Damsgaard Winther Toft Lauridsen Skovgaard Bagger Thorup Hjort".split()
TOWNS = "Skive Ribe Hobro Lemvig Thisted Struer Varde Skagen Tønder Faxe".split()
FIRMS = "Novatek Jydbyg Fynsdata Nordlast Kystfisk Midtel Sydrens Øresol Vestglas Bornfrugt".split()


def generated(rnd, given, family, towns, firms, cues):
    """A sentence and its names: (text, {(entity, value)})."""
    g, f, t, o = rnd.choice(given), rnd.choice(family), rnd.choice(towns), rnd.choice(firms)
    told = rnd.choice(["advokat ", "vidnet ", "dommer "]) if cues else ""
    return rnd.choice(
        [
            (f"Så spurgte {told}{g} {f} om bilaget.", {(E.PERSON, f"{g} {f}")}),
            (f"Derefter talte {told}{g} {f} i en time.", {(E.PERSON, f"{g} {f}")}),
            (f"Mødet med {told}{f} blev holdt senere.", {(E.PERSON, f)}),
            (f"Pakken blev sendt til {'7800 ' if cues else ''}{t} med posten.", {(E.LOCATION, t)}),
            (f"Han arbejder hos {o}{' A/S' if cues else ''} og er glad.", {(E.ORGANIZATION, o)}),
            ("Der var intet nyt i sagen den dag.", set()),
        ]
    )


def score(spark, train, test):
    pages = lambda rows: spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "page_uid long, text string")
    found = {}
    for r in tagger.tag_names(pages(test), tagger.train(pages(train))).collect():
        assert test[r["page_uid"]][0][r["start"] : r["end"]] == r["value"]
        found.setdefault(r["page_uid"], set()).add((r["entity"], r["value"]))
    right = sum(len(found.get(k, set()) & want) for k, (_, want) in enumerate(test))
    return right / sum(map(len, found.values())), right / sum(len(want) for _, want in test)


def test_names_without_cues(spark):
    """Known words where no rule sees them; then words that no training text has."""
    rnd = random.Random(3)
    train = [generated(rnd, GIVEN[:7], FAMILY[:7], TOWNS[:7], FIRMS[:7], True) for _ in range(900)]
    known = [generated(rnd, GIVEN[:7], FAMILY[:7], TOWNS[:7], FIRMS[:7], False) for _ in range(300)]
    precision, recall = score(spark, train, known)
    assert precision > 0.97 and recall > 0.97
    new = [generated(rnd, GIVEN[7:], FAMILY[7:], TOWNS[7:], FIRMS[7:], False) for _ in range(300)]
    precision, recall = score(spark, train, new)
    print(f"held-out words: precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.7 and recall > 0.7


def test_tagger_edges(spark):
    rows = [(1, None), (2, ""), (3, "."), (4, "vidnet Anna Holm kom her. " * 2000 + "Nej " * 5000), (5, "\n\n"), (6, "vidnet Anna Holm kom.")]
    pages = spark.createDataFrame(rows, "page_uid long, text string")
    model = tagger.train(pages)
    got = tagger.tag_names(pages, model).collect()
    assert {r["page_uid"] for r in got} <= {4, 6} and any(r["value"] == "Anna Holm" for r in got)
    assert tagger.tag_names(pages.limit(0), tagger.train(pages.limit(0))).count() == 0
    assert tagger.tag_names(pages, tagger.Model()).count() == 0


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(1)
    model = tagger.Model(rnd.normal(size=(50, tagger.TAGS)), rnd.normal(size=(tagger.TAGS + 1, tagger.TAGS)))
    found = [rnd.integers(0, 50, (n, 3)) for n in (1, 4, 2, 3, 4)]

    def total(x, tags):
        last, s = tagger.TAGS, 0.0
        for f, t in zip(x, tags, strict=True):
            if t and t % 2 == 0 and last not in (t - 1, t):
                return -math.inf
            s += model.table[f, t].sum() + model.steps[last, t]
            last = t
        return s

    for x, tags in zip(found, model.decode(found), strict=True):
        best = max(itertools.product(range(tagger.TAGS), repeat=len(x)), key=lambda y: total(x, y))
        assert abs(total(x, tags) - total(x, best)) < 1e-9


def test_sentences():
    text = "Hr. Holm kom. Så gik adv. Bo Lund\nhjem til Åby A/S! ok"
    assert [[text[a:b] for a, b in zip(s.starts, s.ends, strict=True)] for s in tagger.sentences(text)] == [["Hr.", "Holm", "kom", "."], ["Så", "gik", "adv.", "Bo", "Lund"], ["hjem", "til", "Åby", "A/S", "!", "ok"]]


def test_case_evidence(spark):
    rows = [(1, "Her kom Lund. Lund gik; en lund er grøn. Så kom Møller og møller"), (2, "Gage | Holm\nHolm"), (3, "Ja, Holm sagde det, og hos Holm"), (4, None)]
    pages = spark.createDataFrame(rows, "page_uid long, text string")
    counts = {r["word"]: tuple(r)[1:] for r in names.case_counts(pages).collect()}
    assert counts["lund"] == (1, 1, 1) and counts["holm"] == (0, 2, 2) and counts["gage"] == (0, 0, 1) and counts["møller"] == (1, 1, 0)
    told = {r["word"]: r for r in names.word_evidence(names.case_counts(pages)).collect()}
    assert told["holm"]["is_name"] and told["holm"]["small_name"] and not told["gage"]["is_name"] and not told["lund"]["small_name"]
    found = spark.createDataFrame([(2, E.PERSON, 0, 4, "Gage"), (2, E.PERSON, 7, 11, "Holm"), (3, E.PERSON, 4, 8, "Holm"), (9, E.PERSON, 0, 1, "x")], "page_uid long, entity string, start int, end int, value string")
    rows = {(r["page_uid"], r["start"]): r for r in names.name_evidence(found, pages, names.word_evidence(names.case_counts(pages))).collect()}
    assert len(rows) == 4 and rows[2, 7]["has_name"] and rows[2, 7]["words"] == ["Holm"] and not rows[2, 0]["has_name"] and rows[9, 0]["words"] == []
    kept = detect.plausible_names(names.name_evidence(found, pages, names.word_evidence(names.case_counts(pages))), pages).collect()
    assert {(r["page_uid"], r["start"]) for r in kept} == {(2, 7), (3, 4)}


def test_touching_tokens_over_long_texts(spark):
    """Spans and tokens meet across stretches, at their borders and where either is longer than one."""
    rnd = random.Random(5)
    text = " ".join(rnd.choice(["Aa", "b", "Ccc" * 40, "Ddddd"]) for _ in range(300))
    made = [(1, a, min(len(text), a + rnd.choice([1, 5, 63, 64, 65, 400]))) for a in rnd.sample(range(len(text)), 60)]
    pages = spark.createDataFrame([(1, text)], "page_uid long, text string")
    got = Counter((r["start"], r["end"], r["token_start"]) for r in names.touching_tokens(spark.createDataFrame(made, "page_uid long, start int, end int"), pages).collect())
    places, at = [], 0
    for w in text.split(" "):
        places.append((at, at + len(w), w))
        at += len(w) + 1
    assert got == Counter((a, b, s) for _, a, b in set(made) for s, e, w in places if w[0].isupper() and s < b and e > a)


def test_language_model(spark):
    rows = [("en", "the cat and the dog"), ("da", "katten og hunden er her"), ("da", None), (None, "the"), ("en", "")]
    texts = spark.createDataFrame(rows, "lang string, text string")
    model = {r["gram"]: r["scores"] for r in langmodel.fit(texts).collect()}
    counts = Counter()
    for lang, t in rows:
        for w in (t or "").split() if lang else ():
            counts.update((lang, f" {w} "[k : k + 3]) for k in range(len(w)))
    totals = {x: sum(n for (y, _), n in counts.items() if x == y) for x in ("en", "da")}
    assert model == {g: {x: math.floor(1000 * math.log((counts[x, g] + 1) / (totals[x] + len(model)))) for x in totals} for _, g in counts}
    scored = langmodel.language_scores(texts.select("text"), langmodel.fit(texts)).withColumn("r", langmodel.model_ratio(F.col("scores"))).collect()
    assert [r["r"] > 6 for r in scored] == [True, False, False, True, False] and scored[2]["r"] == 1
    assert langmodel.language_scores(texts, langmodel.fit(texts.limit(0))).withColumn("r", langmodel.model_ratio(F.col("scores"))).where("r IS NOT NULL").count() == 0
    assert langmodel.fit(texts, most=5).count() == 5


def test_stems(spark):
    words = ["adresse", "adressen", "adresser", "adressernes", "telefonen", "telefon", "konto", "kontoen", "by", "er", "personnummer", "personnummeret"]
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert len({got[w] for w in words[:3]}) == 1 and got["telefonen"] == got["telefon"] and got["kontoen"] == "konto" and got["by"] == "by" and got["er"] == "er" and got["personnummer"] == got["personnummeret"]


@pytest.mark.parametrize("most", [1 << 17, 2])
def test_propagation_in_parts(spark, monkeypatch, most):
    monkeypatch.setattr(resolve, "MOST_PATTERNS", most)
    pages = spark.createDataFrame([(1, "Ida Holm og Per Lund"), (2, "HOLM, idaholmx İholm perlund"), (3, None), (4, "")], "page_uid long, text string")
    found = spark.createDataFrame([(1, E.PERSON, "ida holm", "Ida Holm", 0, 8), (1, E.PERSON, "per lund", "Per Lund", 12, 20)], "page_uid long, entity string, key string, value string, start int, end int")
    want = {(2, "HOLM", 0), (2, "idaholm", 6), (2, "holm", 16), (2, "perlund", 21)}
    assert {(r["page_uid"], r["value"], r["start"]) for r in resolve.propagate_names(pages, found).collect()} == want
    assert {(r["page_uid"], r["value"], r["start"]) for r in resolve.propagate_names(pages, found, word_bounds=True).collect()} == {(2, "HOLM", 0), (2, "perlund", 21)}
    assert resolve.propagate_names(pages, found.limit(0)).count() == 0


def test_spans_of_long_texts(spark):
    """Places are right across the parts that they are worked out in."""
    import re

    for n in (0, 1, 63, 64, 65, 128, 129, 5000):
        text = "".join(f"æ{'x' * (k % 7)}{k}" for k in range(n))
        got = spark.createDataFrame([(text,)], "t string").select(spans(F.col("t"), "[0-9]+").alias("s")).first()["s"]
        assert [(r["start"], r["end"], r["value"]) for r in got] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


# --- streams -----------------------------------------------------------


def test_undo_limits():
    """A line of limited length forgets its oldest versions and still stops at its ends."""
    from docveil.streaming.session import Replayer

    class Held:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    p = Replayer(2, None)
    p.held = Held()
    got = []
    for part in ([(3, "do"), (1, "do"), (2, "do")], [(4, "undo"), (5, "undo"), (6, "undo")], [(7, "redo"), (8, "do"), (9, "redo")]):
        got += next(p.handleInputRows((1,), iter([pd.DataFrame(part, columns=["seq", "action"])]), None))["version"].tolist()
    assert got == [1, 2, 3, 2, 1, 1, 2, 4, 4]


def test_pages_are_forgotten_in_time(spark, tmp_path):
    from docveil.streaming import session

    for k, rows in enumerate([[(1, 0), (2, 0)], [(1, 5), (3, 5)], [(9, 100)], [(1, 101), (9, 101)]]):
        spark.createDataFrame(rows, "page_uid long, s long").select("page_uid", F.timestamp_seconds(F.col("s") + 1000).alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pages = session.arriving(spark, f"{tmp_path}/in", "page_uid long, at timestamp", 10)
        session.scan_stream(pages, lambda df: df.select("page_uid"), f"{tmp_path}/out", f"{tmp_path}/log", f"{tmp_path}/cp", at="at", keep="20 seconds").awaitTermination(120)
    assert sorted(r["page_uid"] for r in spark.read.parquet(f"{tmp_path}/out").select("page_uid").collect()) == [1, 1, 2, 3, 9]


# --- files -------------------------------------------------------------


def test_failed_write_leaves_no_file(spark, tmp_path):
    from docveil.sources import files

    rows = spark.range(200).select(F.col("id").alias("pos"), F.concat(F.lit("f"), "id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("body")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        files.write_files(rows, f"file://{tmp_path}/a", F.col("body"))
    assert not (tmp_path / "a").exists() or list((tmp_path / "a").iterdir()) == []
    good = rows.withColumn("body", F.when(F.col("pos") % 2 == 0, "y"))
    assert files.write_files(good, f"file://{tmp_path}/a", F.col("body")) == {"saved": 100, "failed": 100, "bytes": 100}
    assert files.write_files(good, f"file://{tmp_path}/a", F.col("body"))["saved"] == 100  # other names
    assert files.write_files(good.where("pos < 4"), f"file://{tmp_path}/a", F.lit("zz"), replace=True)["bytes"] == 8
    there = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert sum(n.endswith(".txt") for n in there) == 202 and "f0_1.txt" in there and "_attempts" not in there
    assert json.loads((tmp_path / "a" / "_report.json").read_text())["saved"] == 4 and files.read_back(spark, f"file://{tmp_path}/a").count() == 202


def test_names_apart(spark):
    from docveil.sources.files import named_apart

    rows = [(1, "a.txt"), (2, "A.txt"), (3, "a_1.txt"), (4, "a.txt"), (5, ".x"), (6, ".x"), (7, "b"), (8, "b")]
    got = [r["name"] for r in named_apart(spark.createDataFrame(rows, "pos long, name string")).orderBy("pos").collect()]
    assert len({n.lower() for n in got}) == len(rows) and got[0] == "a.txt" and got[3] == "a_2.txt" and got[7] == "b_1"
