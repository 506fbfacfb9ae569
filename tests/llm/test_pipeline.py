"""The pipeline stage by stage against brute force."""

import random
from collections import Counter

import pytest

from docveil.llm.words import lower_words

pipeline = pytest.importorskip("corpus_pipeline")


def similar(a, b):
    """Jaccard similarity of 0.8 or more of five-word shingles."""
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (lower_words(a), lower_words(b)))
    return len(x & y) >= 0.8 * len(x | y)


def one_of_each_group(rows):
    """By brute force: of each component of similar texts the row of the smallest id."""
    texts = sorted({r[1] for r in rows})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]):
                root[find(i)] = find(j)
    of, first = {t: find(k) for k, t in enumerate(texts)}, {}
    for r in sorted(rows):
        first.setdefault(of[r[1]], r)
    return sorted(first.values())


def test_pipeline(spark, tmp_path):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(800)]
    prose = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    rows = []
    for k in range(120):
        text = prose(rnd.randint(80, 300))
        if k % 12 == 1:
            text = "word " * 100
        if k % 12 == 2:
            text = rows[0][1]
        if k % 12 == 3:
            text += " " + items[k % 5][1]
        if k % 12 == 5:  # near copies, by a changed word or words added
            near = rows[k - 1][1].split()
            near[k % len(near)] = "changed"
            text = " ".join(near) if k % 24 == 5 else rows[k - 1][1] + " " + prose(8)
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    rows.append(rows[4])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, work) in enumerate(pipeline.STAGES):
        work(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append([tuple(r) for r in docs.collect()])
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good = [r for r in rows if len(set(lower_words(r[1]))) > 1]
    assert Counter(seen[0]) == Counter(good)
    assert sorted(seen[1]) == one_of_each_group(good)
    assert len(seen[1]) < len({r[1] for r in good}) - 5
    clean = [r for r in seen[1] if not any(t in r[1] for _, t in items)]
    assert sorted(seen[2]) == sorted(clean) and len(clean) < len(seen[1])
    times = Counter(seen[3])
    assert set(times) <= set(clean) and set(times.values()) <= {1, 2}
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    assert abs(words(seen[3]) - 1.5 * words(clean)) < 0.05 * words(clean)
    assert len(seen[4]) == len(seen[3])
    per = Counter(r[docs.columns.index("shard")] for r in seen[4])
    assert max(per.values()) - min(per.values()) <= 1
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_stages_take_anything(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""
    from pyspark.sql import functions as F

    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, text = prose(60000), prose(90)
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, long, "en", "s", 1), (3, text, None, "s", None), (3, text, None, "s", None), (None, text, "en", None, 5), (None, prose(70), "en", None, 5), (4, prose(80), "de", "t", 6)]
    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = ["kept", "h", "g", "rows", "times", "size", "copies", "n_words", "fingerprint", "item_ids", "shard", "verdict", "key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in clash})
    counts = []
    for k, (name, work) in enumerate(pipeline.STAGES):
        work(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"o{k}"))
        out = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert name == "sharding" or (out.columns == docs.columns and out.where(" OR ".join(f"{c} <> 'clash'" for c in clash)).count() == 0)
        counts.append(out.count())
        empty = work(spark, docs.limit(0), str(tmp_path / "none")) if name != "decontamination" else work(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        docs = out
    # The null and the empty text fail the rules; of the text that occurs three times the one with an id stays.
    assert counts[:3] == [6, 4, 4] and counts[4] == counts[3]


def test_near_dedup_takes_the_signatures(spark, tmp_path, monkeypatch):
    """Near-dedup joins what op1's deletion-variant signatures link, if it has the similarity; its groups are those of brute force."""
    from pyspark.sql import functions as F

    from docveil.llm import simhash

    rnd = random.Random(5)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = [(k, prose(200), "en", "s", 1) for k in range(20)]
    rows += [(20 + k, rows[k][1] + " " + prose(1), "en", "s", 1) for k in range(20)] + [(40 + k, rows[k][1].upper(), "en", "s", 1) for k in range(5)]
    docs, taken = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), []
    real, prints = simhash.signature_pairs, {}

    def seen(base, *more):
        prints.update({r["f0"]: r["print"] & (2**64 - 1) for r in base.select("f0", "print").distinct().collect()})
        taken.extend(real(base, *more).collect())
        return real(base, *more)

    monkeypatch.setattr(simhash, "signature_pairs", seen)
    assert sorted(tuple(r) for r in pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == one_of_each_group([(k, t.lower() if k > 39 else t, *more) for k, t, *more in rows])
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert {(r["f0"], r["g0"]) for r in taken} == near and len(near) > 3
    op1 = simhash.simhash(docs, pipeline.SHINGLE_WORDS).select(F.col("f0")).distinct().collect()
    assert {r[0] & (2**64 - 1) for r in op1} == set(prints.values())
