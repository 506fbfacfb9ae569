"""What reviews on larger tables and odd inputs have shown."""

import pytest
from pyspark.sql import functions as F

from docveil.functions import entities as E
from docveil.operators import detect
from docveil.shared import materialize


def test_a_number_beside_a_card_is_no_part_of_it(spark):
    card = "4028005252517056"
    texts = [f"{card} 27", f"126 {card}", f"42 4366089147969128 {card}", "4495589438270767 42", "4111 1111 1111 1111 27", "3782-822463-10005 og 1", f"9{card}9999", "a" + card + "b"]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_uid int, text string")
    found = detect.detect(pages, rules=tuple(r for r in detect.RULES if r.entity == E.CARD)).collect()
    assert sorted((r["page_uid"], r["value"]) for r in found) == [(0, card), (1, card), (2, card), (2, "4366089147969128"), (3, "4495589438270767"), (4, "4111 1111 1111 1111"), (5, "3782-822463-10005"), (7, card)]


def test_lines_and_points_that_share_places_meet_once(spark):
    """30 boxes stand for 3,000 lines and 20 places for 2,000 points; equal to all pairs, unplaced points too."""
    from docveil.operators import words

    points = spark.range(2000).selectExpr("id AS point_id", "id % 2 AS page_uid", "if(id % 20 = 3, NULL, double(id % 20 * 7)) AS x", "double(id % 20 * 5) AS y")
    lines = spark.range(3000).selectExpr("2999 - id AS line_id", "id % 2 AS page_uid", "double(id % 30 * 3) AS x0", "double(id % 30 * 4) AS y0").withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 12})
    pairs = points.join(lines, "page_uid")
    dy, aside = F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("y")), F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0))
    inside = pairs.where("x BETWEEN x0 - 1.5 AND x1 + 1.5 AND y BETWEEN y0 - 1.5 AND y1 + 1.5")
    want = [p.groupBy("page_uid", "point_id").agg(F.min_by("line_id", F.struct(by, "line_id"))) for p, by in ((pairs, dy + 0.25 * aside), (inside, dy))]
    got = [words.nearest_line(points, lines), words.line_at(points, lines)]
    for a, b in zip(got, want, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = got[0]._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join Inner, (page_uid") :]
    assert join.count("Aggregate") >= 2, "places and boxes are told apart before they meet"


def test_a_town_that_is_given_often_counts_once(spark):
    """Codes given a thousand times make no more rows of a candidate than codes given once."""
    values = spark.createDataFrame([("8500 Grenaa",), ("8500 Grena",), ("8000 Grenaa",), ("8500 Xyzby",)], "value string")
    codes = spark.range(2000).selectExpr("int(if(id % 2 = 0, 8500, 8340)) AS code", "if(id % 2 = 0, 'Grenaa', 'Malling') AS city")
    got = sorted((r["value"], r["accepted"]) for r in detect.postal_match(values, codes).collect())
    assert got == [("8000 Grenaa", True), ("8500 Grena", True), ("8500 Grenaa", True), ("8500 Xyzby", False)]


def test_what_has_a_row_for_each_page_is_not_sent_whole(spark):
    """Small as these tables look, no join by page sends one to the driver."""
    from docveil.operators import names, resolve

    pages = spark.createDataFrame([(1, 1, "p 1", "Her kom Ida Holm i dag"), (2, 2, "p 2", "ingen")], "page_uid long, pos long, label string, text string")
    found = spark.createDataFrame([(1, E.PERSON, 8, 16, "Ida Holm", 0.85)], "page_uid long, entity string, start int, end int, value string, score double")
    told = names.name_evidence(found, pages, names.word_evidence(names.case_counts(pages)))
    for df in (detect.plausible_names(told, pages), resolve.findings(found.withColumn("key", F.lower("value")), pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin [page_uid" in x] and "SortMergeJoin [page_uid" in plan


def test_op1_sends_no_variants(spark, monkeypatch):
    """Variants of fingerprints, links and groups grow with the corpus and are joined by exchanges, whatever Spark takes their sizes for."""
    from docveil.llm import components, simhash

    plans = []

    def seen(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    docs = spark.range(60).selectExpr("id AS doc_id", "concat('w', id div 3, ' a b c d e f g h i j k l m n o p q r s t u v w x', if(id % 3 = 2, ' y', '')) AS text")
    out = simhash.near_duplicates(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60 and len(plans) > 6
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_a_catalogue_is_read_by_ranges(spark):
    """No window holds a whole catalogue; records that a range's end cuts come back whole, as do comments before them."""
    import re

    from docveil.sources import catalogues

    rows = [(lang, "ctx" if k % 4 == 0 else None, f"m{k:03}\nsecond\nthird", f"p{k}" if k % 3 == 0 else None, f"{lang} {k}\nnext" if k % 5 else "", k % 7 == 0) for lang in ("da", "en") for k in range(60)]
    entries = spark.createDataFrame(rows, "lang string, context string, msgid string, plural string, value string, fuzzy boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        lines = catalogues.catalogue_lines(entries)
        back = catalogues.read_catalogues(lines)
        key = lambda r: (r[0], r[2])
        assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(rows, key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for df in (lines, back):
        assert not re.search(r"windowspecdefinition\(lang#\d+, (seq|at)#", df._jdf.queryExecution().analyzed().toString())


def test_xhtml_bodies_are_dealt_over_all_tasks(spark):
    """A small file of many rows is read by one task, but not worked on by it."""
    from docveil.queries_text import xhtml_bodies

    df = xhtml_bodies(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == df.select("p_partkey").distinct().count() > 0


def test_spans_are_found_once_and_in_compiled_steps(spark):
    """Keys of findings come from written spans, not from a second search; what makes spans stands before their explosion, where Spark compiles it."""
    from docveil.operators import resolve

    texts = ["Ring tlf 20 30 40 50 nu", "Mobil: 20304050", "telefonbog 20304050", "ingen tal", None, "CVR-nr. 25313763", "25313764"]
    pages = spark.createDataFrame([(k, k, f"p {k}", t) for k, t in enumerate(texts)], "page_uid long, pos long, label string, text string")
    rules = tuple(r for r in detect.RULES if r.entity in (E.PHONE, E.CVR))
    spans = detect.detect(pages, rules=rules, context=True)
    found = resolve.findings(spans, pages, names=False)
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    made = [x for x in spans._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x]
    assert made and all("Generate explode(__values#" in x for x in made)
    assert sorted((r["page_uid"], r["entity"], r["key"], round(r["score"], 2)) for r in found.collect()) == [(0, E.PHONE, "20304050", 0.85), (1, E.PHONE, "20304050", 0.65), (5, E.CVR, "25313763", 1.0)]


def test_context_is_looked_for_only_where_a_stem_stands(spark):
    """The quick look at the text around a span gives up no context word."""
    words = [*" ".join(detect.CONTEXT.values()).split(), "Telefonerne", "(TLF.)", "konto-nr", "bor/by", "mobilens,", "kontaxt", "xbank", "p-nr.", "c/o"]
    rows = [(f"{a}{w} 12345678 {b}", e) for w in words for e in (*detect.CONTEXT, E.EMAIL) for a, b in (("", ""), ("se ", "her"))]
    rows += [(f"her 12345678 {w} nu", e) for w in words for e in detect.CONTEXT] + [(f"{w} {'x ' * n}12345678", E.PHONE) for w in words for n in (4, 5, 57, 60, 61)]
    df = spark.createDataFrame(rows, "text string, entity string").withColumn("start", F.instr("text", "12345678") - 1).withColumn("end", F.col("start") + 8)
    told = F.create_map(*(F.lit(x) for key, found in detect.CONTEXT.items() for x in (key, sorted({detect.plain_stem(w) for w in found.split()}))))
    want = F.coalesce(F.arrays_overlap(F.try_element_at(told, F.col("entity")), detect.context_words(F.col("text"), F.col("start"), F.col("end"))), F.lit(False))
    got = detect.with_context(F.col("text"), F.col("entity"), F.col("start"), F.col("end"), F.lit(0.3)) > 0.3
    told_apart = df.select(want.alias("want"), got.alias("got")).groupBy("want", "got").count().collect()
    assert {(r["want"], r["got"]) for r in told_apart} == {(True, True), (False, False)}


def test_a_further_stream_joins_what_was_seen_by_an_exchange(spark, monkeypatch):
    """The keys of the log, a row a page, are not sent whole."""
    from docveil.queries_text import scanned_stream
    from docveil.streaming import session

    streams, scan = [], session.scan_stream
    monkeypatch.setattr(session, "scan_stream", lambda *a, **k: streams.append(scan(*a, **k)) or streams[-1])
    assert scanned_stream(spark, "/root/testdata/sf0.001").count() > 0
    plan = streams[1]._jsq.streamingQuery().lastExecution().executedPlan().toString() if hasattr(streams[1]._jsq, "streamingQuery") else streams[1]._jsq.lastExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_marks_meet_findings_by_place(spark):
    """Equal to comparing all rectangles with all marks, empty ones and pages without marks too; no array holds a page's marks."""
    from docveil.functions.geometry import covered
    from docveil.operators import resolve

    box = "struct(double({0}) AS x0, double({1}) AS y0, double({0} + 20) AS x1, double({1} + 9) AS y1)"
    one, two = box.format("(id * 13 % 70 / 2 - 9)", "(id * 5 % 30 / 4 - 3)"), box.format("(id * 11 % 50 / 2)", "(id * 7 % 20)")
    found = spark.range(900).selectExpr("id AS k", "id % 7 AS page_uid", "id % 9 <> 0 AS selected", f"CASE id % 5 WHEN 0 THEN slice(array({one}), 1, 0) WHEN 1 THEN array({one}, {two}) ELSE array({one}) END AS rects")
    existing = spark.range(400).selectExpr("id * 3 % 6 AS page_uid", "if(id % 4 = 1, 'highlight', 'redact') AS kind", "if(id % 3 = 0, 'search', 'hand') AS source", f"array({one}, {two}) AS rects")
    drawn = existing.where("kind = 'redact' AND source = 'search'").groupBy("page_uid").agg(F.flatten(F.collect_list("rects")).alias("drawn"))
    want = found.where("selected").join(drawn, "page_uid", "left").where(F.col("drawn").isNull() | ~covered(F.col("rects"), F.col("drawn")))
    got = resolve.redaction_items(found, existing)
    assert got.columns == found.columns or set(got.columns) == set(found.columns)
    kept = sorted(r["k"] for r in want.collect())
    assert 0 < len(kept) < 800 and sorted(r["k"] for r in got.collect()) == kept
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_listed_words(spark):
    """Equal to what word_offsets() places, over columns both ways, words of no width, blocks and empty words; the query moves no words."""
    from docveil.operators import words
    from docveil.queries import words_to_text

    df = spark.range(1200).selectExpr(
        "id % 40 AS page_uid", "id AS seq", "double(id * 37 % 90) AS x0", "double(id * 13 % 50) AS y0", "double(id * 37 % 90 + id % 5 * 4) AS x1", "double(id * 13 % 50 + id % 3 * 9) AS y1",
        "CASE id % 11 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE substr('abcdefg', 1, int(id % 6 + 1)) END AS text", "int(id div 400) AS block", "int(id div 130) AS line",
    )
    placed = words.word_offsets(df).groupBy("page_uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat("sep", "text").alias("t")))), lambda w: w["t"]), "").alias("text"))
    want = {r[0]: r[1] for r in placed.collect()}
    listed = df.groupBy("page_uid").agg(F.array_sort(F.collect_list(F.struct(*df.columns[1:]))).alias("w")).select("page_uid", words.listed_text(F.col("w")))
    assert {c for t in want.values() for c in t} >= {"\n", " "} and {r[0]: r[1] for r in listed.collect()} == {r[0]: r[1] for r in words.words_to_text(df).collect()} == want
    assert "Exchange" not in words_to_text(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_files_are_placed_and_read_by_tasks(spark, tmp_path):
    """New names pass over those that are there, none is lost; the driver lists no files to read them; a task that is run again finds what it has moved."""
    from docveil.sources import files

    path = f"file://{tmp_path}/a"
    rows = lambda *names: spark.createDataFrame([(k, n, f"{n} {len(names)}") for k, n in enumerate(names)], "pos long, name string, body string")
    assert files.write_files(rows("a.txt"), path, F.col("body"))["saved"] == 1
    assert files.write_files(rows("a.txt", "a_1.txt", "B c.txt"), path, F.col("body"))["saved"] == 3
    got = files.read_back(spark, path)
    assert sorted(bytes(r["content"]) for r in got.collect()) == [b"B c.txt 3", b"a.txt 1", b"a.txt 3", b"a_1.txt 3"]
    assert len({r["name"].lower() for r in got.collect()}) == 4 == sum(p.suffix == ".txt" for p in (tmp_path / "a").iterdir())
    assert "binaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "b" / "try").mkdir(parents=True)
    (tmp_path / "b" / "try" / "x").write_text("1")
    (tmp_path / "b" / "y").write_text("2")  # moved before
    (tmp_path / "b" / "try.names").write_text("x\ny\n")
    files._place(spark, f"file://{tmp_path}/b", [f"{tmp_path}/b/try"])
    assert {r["name"]: bytes(r["content"]) for r in files.read_back(spark, f"file://{tmp_path}/b").collect()} == {"x": b"1", "y": b"2"}
    (tmp_path / "b" / "try.names").write_text("z\n")
    with pytest.raises(Exception, match="z"):
        files._place(spark, f"file://{tmp_path}/b", [f"{tmp_path}/b/try"])


def test_sentences_are_decoded_together_and_once(spark, monkeypatch):
    """The tags are those of each sentence decoded alone, whatever is remembered; equal sentences are decoded once."""
    import numpy as np
    import pyarrow as pa

    from docveil.operators import tagger

    rnd = np.random.default_rng(3)
    sent = type("Sent", (), {"value": (rnd.normal(size=(tagger.BUCKETS, tagger.TAGS)), rnd.normal(size=(tagger.TAGS + 1, tagger.TAGS)))})
    words = "Anna Holm bor i 8500 Aarhus , og A/S Byg 12 er her . Nu".split()
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 90))) for _ in range(300)] * 2 + [None, "", "Anna\n\nHolm"]
    want, model = [], tagger.Model(*sent.value)
    for text in texts:
        names = []
        for s in tagger.sentences(text or ""):
            for k, t in enumerate(model.decode([tagger.features(s)])[0].tolist()):
                if t and t % 2:
                    names.append((tagger.KINDS[t // 2], s.starts[k], s.ends[k]))
                elif t:
                    names[-1] = (*names[-1][:2], s.ends[k])
        want.append([{"entity": e, "start": a, "end": b, "value": text[a:b]} for e, a, b in names])
    decoded, decode = [], tagger.Model.decode
    monkeypatch.setattr(tagger.Model, "decode", lambda own, found, wanted=None: decoded.extend(found) or decode(own, found, wanted))
    assert tagger._tagger(sent)(pa.array(texts)).to_pylist() == want
    kinds = {tuple(s.words) for t in texts for s in tagger.sentences(t or "")}
    assert sum(len(x) <= tagger.LONGEST for x in decoded) == sum(len(x) <= tagger.LONGEST for x in kinds) < 600
    for name, most in (("KNOWN", 3), ("LONGEST", 5), ("TOGETHER", 40)):
        monkeypatch.setattr(tagger, name, most)
        assert tagger._tagger(sent)(pa.array(texts)).to_pylist() == want


def test_rows_are_replayed_in_place():
    """As frames are; a state is asked for once, and a long line is not copied for each entry."""
    import random
    import time

    import pandas as pd

    from docveil.streaming.session import Replayer, RowReplayer

    class Held:
        value, asked = None, 0

        def exists(self):
            self.asked += 1
            return self.value is not None

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.value = value

    rnd = random.Random(2)
    for most in (None, 1, 7):
        one, two = Replayer(most, None), RowReplayer(most, None)
        one.held, two.held = Held(), Held()
        for turn in range(3):
            part = [(turn * 500 + k, rnd.choice(["do", "do", "undo", "redo"])) for k in range(500)]
            rnd.shuffle(part)
            frame = next(one.handleInputRows(("s",), iter([pd.DataFrame(part[:200], columns=["seq", "action"]), pd.DataFrame(part[200:], columns=["seq", "action"])]), None))
            rows = list(two.handleInputRows(("s",), iter([{"session": "s", "seq": q, "action": a} for q, a in part]), None))
            assert [tuple(r) for r in rows] == list(frame.itertuples(index=False, name=None)) and [r["seq"] for r in rows] == sorted(q for q, _ in part)
        assert one.held.asked == two.held.asked == 3
    long, began = RowReplayer(None, None), time.process_time()
    long.held = Held()
    assert [r["version"] for r in long.handleInputRows((1,), ({"seq": k, "action": "do"} for k in range(60000)), None)][-1] == 60000
    assert time.process_time() - began < 5


def test_prefixes_are_dealt_once(spark, monkeypatch):
    """Texts of one set have one set of prefixes, and these go through one exchange to the members, by key; no table of all of them is written."""
    from docveil.llm import simhash

    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name="step": plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rows = [(k, " ".join(f"w{k % 40 * 50 + n}" for n in range(40)) + (" more" if k % 3 == 0 else "")) for k in range(200)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(k, k % 40) for k, _ in rows}
    dealt = [p for name, p in plans if name == "members" and "RepartitionByExpression [key" in p]
    assert len(dealt) == 1 and "spread" not in {name for name, _ in plans}
    assert all("Aggregate [f0" in line or "Aggregate [key" in line for line in dealt[0].splitlines() if "Aggregate" in line)
