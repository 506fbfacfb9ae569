"""The ten operators against brute force, libraries and SQL, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=150, seed=1):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows = []
    for k in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(60, 200))]
        text = " ".join(words)
        if k % 10 == 3 and rows:
            near = rows[rnd.randrange(len(rows))][1].split()
            near[rnd.randrange(len(near))] = "changed"
            text = " ".join(near)
        if k % 15 == 7:
            text = rows[0][1]
        if k % 20 == 9:
            text = "same line here\n" * 40
        if k % 25 == 11:
            text = " ".join(w + "###" for w in words)
        rows.append((k, text, "en", f"s{rnd.choice([0, 0, 0, 1, 2, 3])}", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \t\n", "en", "s1", 3), (1003, "One", "en", "s1", 3), (1004, "Long " * 30000, "en", "s9", 150000), (5, rows[5][1], "en", rows[5][3], 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "kept": F.lit(1)}).cache()


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def groups(prints, ids, most):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= most:
                root[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def test_simhash(docs, rows):
    from docveil.llm.simhash import near_duplicates

    prints = [fingerprint(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], groups(prints, [r[0] for r in rows], 3), strict=True))
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect())
    assert got == want
    assert len({w[2] for w in want}) < len(rows) - 20
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "wide"), [(64, 2048), (4, 30), (64, 64)])
def test_links_of_large_buckets(spark, monkeypatch, block, wide):
    """All fingerprints share a half, so every link is found by comparing blocks or finer keys, chains included."""
    from docveil.llm import simhash
    from docveil.llm.components import connected_components

    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "WIDE_BLOCK", wide)
    rnd = random.Random(4)
    values = {0}
    for _ in range(400):
        values.add(rnd.choice(list(values)) ^ sum(1 << rnd.randrange(32) for _ in range(rnd.choice([2, 3, 9]))))
    for x in list(values)[:40]:  # and some that differ in the shared half
        values.add(x ^ 1 << 40 ^ 1 << 3)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "f0 long")
    edges = simhash.links(df).where("f0 <> g0").collect()
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges) and len(edges) < 80 * len(values)
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df).toDF("u", "v")).collect()}
    want = groups(values, values, 3)
    assert [roots.get(v, v) for v in values] == want


def test_components(spark):
    """Long chains, stars, repeated and reversed links, and none."""
    from docveil.llm.components import connected_components

    rnd = random.Random(5)
    names = rnd.sample(range(-(10**12), 10**12), 300)
    pairs = [(names[k], names[k + 1]) for k in range(100)] + [(names[200], names[k]) for k in range(150, 290)] + [(names[1], names[0]), (names[5], names[5])]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    chain, star = names[:101], [names[200], *names[150:290]]
    assert got == {**dict.fromkeys(chain, min(chain)), **dict.fromkeys(star, min(star))}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_documents(spark, monkeypatch):
    """Groups by exact similarity of five-word shingles, all of them."""
    from docveil.llm import simhash

    rnd = random.Random(9)
    vocab = [f"w{k}" for k in range(3000)]
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(80, 250))] for _ in range(60)]
    for k in range(60):
        near = list(texts[k])
        for _ in range(rnd.randint(1, 6)):
            near[rnd.randrange(len(near))] = "new"
        texts.append(near)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, None), (501, ""), (502, rows_text := " ".join(texts[0])), (502, rows_text), (503, "a b"), (504, "A  b")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
                n += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    want = [(i, least[find(k)]) for k, (i, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for names, parts, turn in ((1 << 20, 4096, 1 << 26), (0, 1, 100)):  # names joined, members sorted in small parts, many turns
        with monkeypatch.context() as m:
            m.setattr(simhash, "SENT_NAMES", names)
            m.setattr(simhash, "PART_MEMBERS", parts)
            m.setattr(simhash, "LEAST_TURN", turn)
            m.setattr(simhash, "TURN_BYTES", min(2, turn))
            got = [(r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect()]
        assert n > 40 and Counter(got) == Counter(want)


def test_no_link_is_lost_by_a_third_text(spark):
    """A and B are linked whether C, which is no copy of either but shares their shingles, is there or not."""
    from docveil.llm.simhash import similar_documents

    same = [f"t{k}" for k in range(97)]
    texts = [" ".join(same + [f"{x}{k}" for k in range(n)]) for x, n in (("a", 7), ("b", 16), ("c", 17))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert jaccard(sets[0], sets[1]) >= 0.8 > max(jaccard(sets[0], sets[2]), jaccard(sets[1], sets[2]))
    for n in (2, 3):
        rows = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in similar_documents(rows).collect()} == {0: 0, 1: 0, **({2: 2} if n == 3 else {})}


def test_bound_of_shared_shingles(spark):
    """For all sizes up to 300 and all ranges of partners' sizes the bound is no more than the least of the exact numbers."""
    from pyspark.sql import Window

    from docveil.llm.simhash import fewest_shared, shared_least

    a, b = F.col("a"), F.col("b")
    pairs = spark.range(1, 301).withColumnRenamed("id", "a").select("a", F.explode(F.sequence(F.ceil(a * 0.8 - 1e-9), F.floor(a / 0.8 + 1e-9))).alias("b")).withColumn("exact", shared_least(a, b, 0.8))
    up = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    above = pairs.where(b >= a).withColumn("least", F.min("exact").over(up))
    assert above.where(fewest_shared(a, a, b, 0.8) > F.col("least")).count() == 0 and above.count() > 10000
    down = Window.partitionBy("a").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    below = pairs.where(b <= a).withColumn("least", F.min("exact").over(down))
    assert below.where(fewest_shared(a, b, a, 0.8) > F.col("least")).count() == 0


@pytest.mark.parametrize("most", [4, 0])
def test_similar_documents_whole(spark, monkeypatch, most):
    """Every pair of 0.8 or more is linked, whether text was appended or a block replaced, near the bound too."""
    from docveil.llm import simhash

    monkeypatch.setattr(simhash, "MOST_PAIRS", most)  # all pairs at once, or hubs before
    rnd = random.Random(17)
    prose = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    block, rows, want = prose(12), [], {}
    for k in range(60):
        text = prose(rnd.randint(60, 200)) + block
        part = rnd.randint(1, len(text) // 6)
        at = rnd.randrange(len(text) - part)
        near = text + prose(part) if k % 2 else text[:at] + prose(part) + text[at + part :]
        rows += [(k, " ".join(text)), (1000 + k, " ".join(near))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (text, near))
        want[1000 + k] = k if len(a & b) >= 0.8 * len(a | b) else 1000 + k
    rows += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i"), (2002, "a b c d e f g x")]
    want.update({2001: 2000, 2002: 2002})
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want and sum(v < 1000 for v in want.values()) > 20


def test_simhash_null_ids(spark):
    """A null doc_id is no component_id where a group has another."""
    from docveil.llm.simhash import near_duplicates

    rows = [(None, "a b c d"), (7, "a b c d"), (None, "x y z"), (3, None), (4, "")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted([(None, 7), (7, 7), (None, None), (3, 3), (4, 3)], key=str)


def test_quality(docs, rows):
    from docveil.llm.quality import SOFT_RULES, beta_prior, judge_quality

    got = judge_quality(docs)
    assert {"text", "n_words", "kept"} <= set(got.columns) and got.columns.count("kept") == 1
    seen = Counter()
    for r in got.collect():
        text = r["text"] or ""
        w = SPACE.findall(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if SPACE.search(line):
                dup += line in lines
                lines.add(line)
        base = len(w) < 50 or 2 * len(again) > len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), base)
        assert r["kept"] == (not base and r["n_soft"] == 0) and r["verdict"] == "ordinary" and r["n_strict"] >= r["n_soft"]
        seen[r["kept"], r["n_soft"]] += 1
    assert seen[True, 0] > 100 and seen[False, 1] > 3 and len(SOFT_RULES) == 5
    a, b = beta_prior(0.2, 0.01, 0.01)
    assert abs(a / (a + b) - 0.2) < 1e-9
    assert judge_quality(docs.limit(0)).count() == 0


def test_host_verdicts(spark):
    """The same documents are kept on one host and dropped on another: a verdict can save and can cost them."""
    from docveil.llm.quality import judge_quality
    from docveil.llm.queries import _QUALITY_SQL

    rnd = random.Random(12)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    shown = {"clean": prose(), "odd": prose() + " #" * 12, "bad": prose() + " #" * 30}
    rows = []
    for host, share in (("good", 0.0), ("plain", 0.2), ("junk", 0.95), (None, 0.2)):
        rows += [(f"{host} {k}", "few words" if k < 400 * share else prose(), host) for k in range(400)]
        rows += [(f"{host} {name}", t, host) for name, t in shown.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumn("verdict", F.lit("clash"))
    got = judge_quality(docs, keep=["doc_id", "verdict"]).collect()
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert {h: tuple(kept[f"{h} {x}"] for x in shown) for h in ("good", "plain", "junk", None)} == {"good": (True, True, True), "plain": (True, True, False), "junk": (True, False, False), None: (True, True, False)}
    assert Counter(r["verdict"] for r in got) == {"trusted": 403, "ordinary": 806, "condemned": 403}
    con = duckdb.connect()
    con.register("documents", docs.drop("verdict").toArrow())
    names = [d[0] for d in con.execute(_QUALITY_SQL).description]
    want = {r["doc_id"]: (r["kept"], r["verdict"], r["n_strict"]) for r in (dict(zip(names, x, strict=True)) for x in con.fetchall())}
    assert want == {r["doc_id"]: (r["kept"], r["verdict"], r["n_strict"]) for r in got}


def test_personal(spark):
    from docveil.llm.personal import KINDS, base_spans, candidates, find_personal, luhn, reliabilities, train

    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in card.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15])

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab123456789...@@++- ()-é") for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    secret = 'x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y'
    texts += [secret] * 5 + ["call 555-123-4567 now", "page 2020-01-02 in", None, "1" * 5000, "a" * 5000 + "@", "kort 4111 1111 1111 1111"]
    for t in texts:
        assert base_spans(t or "") == brute(t or "")
    got = find_personal(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        base = brute(t or "")
        said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(said) <= set(r["spans"].split(","))
    assert got[3000]["spans"] == "secret:11:51"
    # The method's spans, by the same votes gathered and trained in one process.
    found = [candidates(t or "", brute(t or "")) for t in texts]
    good = {c for c, p in train(Counter(x[3] for f in found for x in f)).items() if p >= 0.5}
    for r, t, f in zip(got, texts, found, strict=True):
        every = sorted(brute(t or "") + [x[:3] for x in f if x[3] in good])
        assert r["spans"] == ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in every)
    few = spark.createDataFrame([(1, secret), (1, secret), (None, "a@b.c")], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    assert sorted((str(r["doc_id"]), r["n_email"]) for r in find_personal(few).collect()) == [("1", 0), ("1", 0), ("None", 1)]
    assert find_personal(few.limit(0)).count() == 0
    assert train({}) == {}
    votes, counts = np.array([[1, 1], [1, 0], [2, 2], [0, 2], [0, 0]]), np.array([50.0, 30, 60, 40, 20])
    theta, post, prior = reliabilities(votes, counts)
    assert post[0] > 0.9 and post[2] < 0.1 and 0 < prior < 1 and np.allclose(theta.sum(2), 1)


def test_mixing(docs, rows):
    from docveil.llm.mixing import mix

    got = mix(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(SPACE.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    total, target, free = 1.5 * sum(size.values()), {}, list(range(len(names)))
    weight = [(5, 2, 1)[k % 3] for k in range(len(names))]
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[k] for k in free) if free else 0
        full = [k for k in free if level * weight[k] >= 2 * size[names[k]]]
        if not full:
            break
        for k in full:
            target[k] = 2.0 * size[names[k]]
            free.remove(k)
    for k in free:
        target[k] = level * weight[k]
    taken = Counter()
    for r in got:
        k = names.index(r["source"])
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[k]) < 1e-6 * max(1, target[k])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[k] += r["taken"]
    for k in range(len(names)):
        # Whole copies of a source's only long document can't come nearer than half of it.
        assert abs(taken[k] - target[k]) <= (15000 if names[k] == "s9" else 0.02 * target[k] + 100)
    again = {(r["doc_id"], r["taken"]) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mix(docs.limit(0)).count() == 0


def test_urls(spark):
    from docveil.llm import urls
    from docveil.llm.queries import URL_RULES, _url_sql

    rnd = random.Random(2)
    hosts = ["example.com", "a.example.com", "EXAMPLE.net", "b.org", "xexample.com", "com", "net", "", "x.de.net", "example.com.evil"]
    paths = ["", "/", "/en/7", "/en/71?x=/en/8", "/de/8#a", "/es/", "/en", "/en/\n9", "//en/"]
    rows = [(k, rnd.choice(["http://", "https://", "", "x://y://"]) + rnd.choice(hosts) + rnd.choice(paths)) for k in range(500)] + [(7, None), (8, ""), (9, "://"), (9, "http://é.example.com/en/7")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(map(str, (tuple(r) for r in urls.judge_urls(pages, URL_RULES).select(cols).collect())))
    con = duckdb.connect()
    page_rows = pages.select("page_id", "url").toArrow()  # noqa: F841
    con.execute("CREATE VIEW pages AS SELECT * FROM page_rows")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({_url_sql()})").fetchall()))
    # Hosts of many pages lie in several ranges, to each of which the rules above come.
    deep = spark.range(3000).selectExpr("id AS page_id", "concat('http://', if(id % 3 = 0, 'a.b.c.com', concat('h', id % 40, '.c.com')), '/p', id % 7, '/x') AS url")
    many = [f"block h{k}.c.com/p{k % 7}" for k in range(30)] + ["allow c.com/p3", "block com/", "allow com/", "block b.c.com/p1/", "allow a.b.c.com/p1", "block x.org/"]
    parsed = [urls.parse_rule(r) for r in many]

    def brute(host, path):
        fits = [(len(h + p), len(h), h + p) for h, p, _ in parsed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[2] if fits else None
        said = {v for h, p, v in parsed if h + p == rule}
        return rule, ("block" if "block" in said else "allow")

    for rules in (many, spark.createDataFrame(parsed, "host string, path string, verdict string")):
        found = urls.judge_urls(deep, rules).collect()
        assert len(found) == 3000 and all((r["rule"], r["verdict"]) == brute(r["host"], r["path"]) for r in found)
    assert urls.judge_urls(pages, []).where("verdict <> 'allow'").count() == 0
    assert urls.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_sharding(spark, docs, rows):
    from docveil.llm import sharding

    got = sharding.shard(docs, 7)
    assert {"text", "slot", "size"} <= set(got.columns) and got.columns.count("size") == 1
    got = got.collect()
    counts = Counter(r["shard"] for r in got)
    assert sum(counts.values()) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 and r["law"] == "rows" and r["grown_shard"] is None for r in got)
    m = sharding.communication_matrix([5, 0, 100, 33], [46, 46, 46], 1)
    assert m.sum(1).tolist() == [5, 0, 100, 33] and m.sum(0).tolist() == [46, 46, 46]
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.PART_ROWS, held = 100, sharding.PART_ROWS
    try:
        big = sharding.shard(many, 3).collect()
    finally:
        sharding.PART_ROWS = held
    assert all(sorted(r["slot"] for r in big if r["shard"] == s) == list(range(1000)) for s in range(3))
    assert abs(np.corrcoef([r["doc_id"] for r in big], [r["slot"] for r in big])[0, 1]) < 0.1
    assert sharding.shard(docs.limit(0)).count() == 0
    alike = spark.range(2000).repartition(5).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    slots = lambda df: sorted((r["shard"], r["slot"]) for r in sharding.shard(df, 3).collect())
    assert slots(alike) == [(s, k) for s in range(3) for k in range(667 - (s == 2))] and slots(alike.coalesce(2)) == slots(alike)


def test_hypergeometric():
    """The exact law at every size: counts against the formula, and mean and deviation where numpy's own draw ends."""
    from docveil.llm.sharding import hypergeometric

    draw = np.random.default_rng(3)
    good, bad, n, times = 7, 11, 6, 20000
    seen = Counter(hypergeometric(draw, good, bad, n) for _ in range(times))
    for k in range(n + 1):
        p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
        assert abs(seen[k] - p * times) < 5 * math.sqrt(p * times) + 3
    for whole in (9 * 10**8, 3 * 10**9, 10**12):
        good, n = whole // 24, whole // 4096
        x = np.array([hypergeometric(draw, good, whole - good, n) for _ in range(400)], float)
        mean, spread = n / 24, math.sqrt(n / 24 * 23 / 24 * (1 - 1 / 4096))
        assert abs(x.mean() - mean) < 5 * spread / 20 and 0.85 < x.std() / spread < 1.15
    assert [hypergeometric(draw, 5, 0, 3), hypergeometric(draw, 0, 5, 3), hypergeometric(draw, 5, 5, 10), hypergeometric(draw, 5, 5, 0)] == [3, 0, 5, 0]


def test_html(spark):
    import itertools

    from docveil.llm.html import Block, blocks, extract_text, graph, main_blocks, main_text
    from docveil.llm.mincut import min_cut

    page = (
        "<html><head><title>no</title><script>var t='<p>no</p>';</script></head><body><header><h1>Site</h1><nav>x</nav></header><div class='cookie-notice'>We use cookies here.</div><main><article>"
        "<header><h1>Title</h1></header><p>Hello &amp; bye <a href=x>link</a>\n more.<div class='ad'>Buy now, cheap.</div><p>Second<br>line<!-- no -->.<ul><li>one<li>two</ul></article>"
        "<section class=comments><p>A reader says long things, indeed very long ones, on and on.</p></section></main><aside>Side</aside><form>Form</form><footer>f</footer>"
    )
    assert main_text(page) == "Title\n\nHello & bye link more.\n\nSecond line.\n\none\n\ntwo"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<nav>a</nav>"), (5, "u", "<p unclosed 'q <b"), (5, "u", page), (6, "u", "<div>" * 3000 + "deep text of some length, here." * 5)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[1] == main_text(page) and all(r["text"] == "" for r in got if r["page_id"] in (2, 3, 4))

    assert extract_text(spark.createDataFrame(rows[:0], "page_id long, url string, html string")).count() == 0
    parts = {
        "<article><script src='/a.js'/>var x=1;</script><p>Text.</article>": "Text.", "<article><p title='a hidden gem'>Text.</p></article>": "Text.", "<article><p hidden>No.</p><p>Text.</article>": "Text.",
        "<article><p>a\u00a0 b &nbsp;c\n\t d</article>": "a\u00a0 b \u00a0c d", "<article>x <svg><path/></svg><svg/> y</article>": "x y", "<body class='has-sidebar'><main><p>Text.</main>": "Text.",
        "<section class=comments><article><p>A reader says long things, at length.</article></section><article><p>Text.</article>": "Text.",
    }
    assert {p: main_text(p) for p in parts} == parts
    # What a block's neighbours are decides where it says little itself: here the cut differs from the signs of the gains.
    prose = "<p>It is a long sentence, with commas, that says much about what is here. And one more, to be sure.</p>"
    plain = "<div>" + prose + prose + "<p><a href=x>See here</a></p>" + prose + "</div><div><div><a href=x>Home</a></div><div><a href=y>All</a></div></div>"
    found = blocks(plain)
    assert [g > 0 for g in graph(found)[0]] == [True, True, False, True, False, False] and main_blocks(found) == [True] * 4 + [False] * 2

    def cost(label, gain, edges):
        return sum(g for x, g in zip(label, gain, strict=True) if g > 0 and not x) - sum(g for x, g in zip(label, gain, strict=True) if g < 0 and x) + sum(w for i, j, w in edges if label[i] != label[j])

    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 8)
        gain = [rnd.choice([-2, -1, -0.5, 0, 0.5, 1, 2]) * rnd.random() for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n), rnd.random()) for _ in range(rnd.randint(0, 14))]
        best = min(cost(x, gain, edges) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(min_cut(gain, edges), gain, edges) - best) < 1e-9
    for _ in range(150):
        found = [Block("x" * rnd.randint(1, 90) + "." * rnd.randint(0, 3), rnd.choice(["p", "li", "h1", "div"]), rnd.choice(["plain", "plain", "main", "part", "head"]), rnd.randrange(3), rnd.randrange(4), rnd.randrange(3), 0) for _ in range(rnd.randint(0, 9))]
        gain, edges = graph(found)
        best = min(cost(x, gain, edges) for x in itertools.product([False, True], repeat=len(found)))
        assert abs(cost(main_blocks(found), gain, edges) - best) < 1e-9


@pytest.mark.parametrize("held", [1 << 18, 50])
def test_lm(docs, rows, held):
    from docveil.llm import lm

    lm.HELD_COUNTS, old = held, lm.HELD_COUNTS
    try:
        got = lm.score(docs, F.col("doc_id") % 7 != 2).collect()
    finally:
        lm.HELD_COUNTS = old
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    counts = Counter(w for r in rows if r[0] % 7 != 2 for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = tokens(texts[r["doc_id"]])
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["score"] <= 1e-9


def test_count_filter(spark):
    from docveil.llm.lm import build_filter

    rnd = np.random.default_rng(1)
    h, n = rnd.integers(-(2**63), 2**63 - 1, 5000), rnd.integers(1, 5000, 5000)
    table, least = build_filter(spark.createDataFrame([(int(a), 2 if b > 1 else 1, int(b)) for a, b in zip(h, n, strict=True)], "h long, o byte, n long"))
    assert least == 2 and (table.levels(h.view(np.uint64)) == np.floor(np.log2(n)).astype(int) + 1).mean() > 0.999
    assert (table.levels(rnd.integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)) > 0).mean() < 0.001


@pytest.mark.parametrize("group", [1024, 96])
def test_lm_whole(spark, monkeypatch, group):
    """Scores from the levels of all n-grams, those that occur once too, in one turn and in several."""
    from docveil.llm import lm

    monkeypatch.setattr(lm, "GROUP", group)
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 30))) for _ in range(40)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") < 30).collect()}
    tokens = [t.split() + [""] for t in texts]
    one, two = Counter(w for t in tokens[:30] for w in t), Counter(p for t in tokens[:30] for p in zip([None, *t], t))
    level = lambda n: float(n) if n < 2 else 2 ** (math.floor(math.log2(n)) + 0.5)
    total = sum(one.values()) + len(one) + 1
    assert sum(n == 1 for n in two.values()) > 100
    for k, t in enumerate(tokens):
        want = 0
        for a, b in zip([None, *t], t):
            context = 30 if a is None else level(one[a])
            want += math.log10((min(level(two[a, b]), context) + 60 * (level(one[b]) + 1) / total) / (context + 60))
        assert abs(got[k] - want) < 1e-6 * max(1, abs(want))


def test_count_filter_grows(spark):
    """Nothing is left out where the entries need more than the least number of segments."""
    from docveil.llm.lm import build_filter

    h = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 400)
    table, _ = build_filter(spark.createDataFrame([(int(x), 2, 1) for x in h], "h long, o byte, n long"), 1 << 20, 1)
    assert len(table.bits) * 8 == 512 << 20 and (table.levels(h.view(np.uint64)) == 1).all()


def test_lm_empty(docs):
    from docveil.llm.lm import score

    assert score(docs.limit(0), F.lit(True)).count() == 0
    alone = score(docs, F.lit(False)).first()
    assert alone["held_out"] and alone["train_tokens"] == 0 and alone["n_known"] == 0


def test_tokens(spark, docs, rows):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    from docveil.llm.tokens import PIECES, Vocabulary, count_tokens, load_pieces
    from docveil.llm.tokens import Counter as Pieces

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab ▁\nç漢😀 ") for _ in range(rnd.randint(0, 40))) for _ in range(800)] + [r[1] for r in rows[:40]]
    # Byte-pair vocabulary: the library that its file belongs to.
    whole, model = load_pieces(), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert whole.merges and whole.bytes
    more = ["".join(rnd.choice(["a", "the ", "   ", "ing", "<0x0A>", "<s>", "=", "==", "\t", "é"]) for _ in range(rnd.randint(0, 30))) for _ in range(1000)]
    counter = Pieces(whole)
    assert [counter.tokens(t) for t in texts + more] == [len(model.encode(t)) if t else 0 for t in texts + more]
    long = "xy漢" * 20000
    assert counter.tokens(long) == len(model.encode(long))
    # Unigram vocabularies: the library's unigram model, with its ties.
    small = [("▁a", -1.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("aab", -3.0)]
    for pieces, fallback in (([*whole.pieces, *((f"<0x{k:02X}>", min(s for _, s in whole.pieces)) for k in range(256))], True), (small, False)):
        own = Tokenizer(models.Unigram([("\U0010ffffunk", min(s for _, s in pieces)), *pieces], 0, fallback))
        own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = Pieces(Vocabulary(pieces, bytes=fallback))
        assert [counter.tokens(t) for t in texts] == [len(own.encode(t).ids) for t in texts]
    got = count_tokens(docs, Vocabulary(small))
    assert got.count() == len(rows) and got.where("doc_id IN (1000, 1001)").agg(F.max("n_tokens")).first()[0] == 0
    assert Pieces(Vocabulary([])).tokens("ab") == 1 and Pieces(Vocabulary([], True, True)).tokens("ab") == 5
    assert count_tokens(docs.limit(0), whole).count() == 0


def test_words_are_counted_once(spark):
    """A worker remembers the words of a large task, and its next task takes them over; marks in any place give what the library gives."""
    import sentencepiece

    from docveil.llm.tokens import PIECES, Counter, counter_of, load_pieces

    made, whole, model = [], load_pieces(), sentencepiece.SentencePieceProcessor(model_file=PIECES)

    class Watched(Counter):
        def pieces_of(self, word):
            made.append(word)
            return super().pieces_of(word)

    counter, text = Watched(whole), " ".join(f"{k:x}" for k in range(130000))
    assert counter.tokens(text) == counter.tokens(text) == len(model.encode(text)) and len(made) == len(set(made)) == 130000
    odd = ["a b", " a b", "a b ", "a  b", "▁a b", "a▁b", "a ▁ b", "▁", " ", "  ", "a▁", "é x\u2009y z", "\na b\n"]
    assert [counter.tokens(t) for t in odd] == [len(model.encode(t)) for t in odd]
    assert counter_of(whole) is counter_of(whole) is not counter_of(load_pieces())


def test_decontamination(spark, docs, rows):
    from docveil.llm import decontaminate as D

    rnd = random.Random(6)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(20, 50)))) for k in range(30)] + [(40, ""), (41, None), (42, "short one"), (43, "dup item of words " * 5), (44, "dup item of words " * 5)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(400)) for _ in range(60)]
    for k in range(0, 60, 2):
        words = texts[k].split()
        leak = items[rnd.randrange(30)][1].upper().split()
        if k % 6 == 0:
            leak[len(leak) // 3] = "changed"
        at = rnd.randrange(len(words))
        texts[k] = " ".join(words[:at] + leak + words[at:])
    texts += [None, "", "Short One", "dup item of words " * 9]
    texts.append(" ".join(rnd.choice(vocab) for _ in range(70000)) + " " + items[7][1])  # longer than what is looked at together
    table = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("item_ids", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows_got = D.find_leaks(table, bench).collect()
    got = {r["doc_id"]: r["item_ids"] for r in rows_got}
    assert len(rows_got) == len(texts) + 1

    def brute(text):
        w, out = (text or "").lower().split(), []
        for i, t in items:
            v = (t or "").lower().split()
            if v:
                grams = {tuple(v[k : k + 5]) for k in range(max(1, len(v) - 4))}
                n = min(5, len(v))
                there = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                if len(grams & there) >= 0.6 * len(grams):
                    out.append(i)
        return out

    assert {k: sorted(v) for k, v in got.items()} == {k: brute(t) for k, t in enumerate(texts)}
    D.ITEMS_AT_ONCE, held = 12, D.ITEMS_AT_ONCE
    try:
        assert {r["doc_id"]: sorted(r["item_ids"]) for r in D.find_leaks(table, bench).collect()} == {k: sorted(v) for k, v in got.items()}
    finally:
        D.ITEMS_AT_ONCE = held
    assert D.find_leaks(table, bench.limit(0)).where("contaminated").count() == 0
    assert D.find_leaks(table.limit(0), bench).count() == 0


def test_rejected_candidates_hide_none(spark):
    """An account number and a national number inside a run that looks like a secret are candidates too, and become spans where the run is rejected."""
    from docveil.llm import personal

    texts = ["Konto ID-DE89370400440532013000 ok", "ref-no-2020-555-12-3456-aa"]
    kinds = [{(t[a:b], k) for a, k, b, _ in personal.candidates(t, [])} for t in texts]
    assert ("DE89370400440532013000", 4) in kinds[0] and any(k == 7 for _, k in kinds[0])
    rows = [(k, texts[0]) for k in range(3)] + [(k, f"IBAN DE89370400440532013000 nr {k}") for k in range(10, 60)] + [(k, f"see build-{k}a-{k}b7{k} file") for k in range(100, 160)]
    found = {r["doc_id"]: r["spans"] for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == found[1] != ""
    one = spark.createDataFrame([([(0, 7, 9), (2, 4, 6), (9, 4, 12), (10, 5, 11)],)], "f array<struct<start:bigint,kind:int,stop:bigint>>").select(personal.settled(F.col("f")).alias("s")).first()["s"]
    assert [tuple(x) for x in one] == [(0, 7, 9), (9, 4, 12)]


def test_long_secrets_are_candidates():
    from docveil.llm.personal import candidates

    for n in (20, 200, 201, 342, 5000):
        text = "token = " + ("aB3_" * n)[:n] + " end"
        assert [x[:3] for x in candidates(text, [])] == [(8, 7, 8 + n)]
    for n in (3, 64, 65, 4000):
        text = "to " + "a" * n + " (at) " + "b" * n + ".org now, Dr. A" + "c" * n + " E" + "d" * n
        found = [x[:3] for x in candidates(text, [])]
        assert (3, 0, 3 + n + 6 + n + 4) in found and found[-1] == (text.index("Dr"), 6, len(text))


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["similar_groups", "personal_counts", "mixing_targets", "shard_laws", "op2_quality", "op5_url_filter", "op11_ranked_search", "op12_merkle_manifest", "media_payloads"])
def test_queries_equal_their_sql(spark, name):
    """Over whole tables; all pairs of documents in SQL for the groups of near copies."""
    from docveil.llm.queries import oracle_sql, queries

    data, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries()[name](spark, data)
    con.execute(oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, con.fetchall()))
