"""Ranked search, the manifest and media archives against brute force, at their edges and with faults."""

import hashlib
import io
import math
import re
import time
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ROWS = [
    (1, "the cat sat on the mat", "en", "a", 22),
    (2, "The CAT-sat; é_É ÆØÅ 12 12 12", None, "a", 30),
    (3, None, "en", None, None),
    (4, "", "en", "a", 0),
    (5, "the the the dog", "en", "b", 15),
    (5, "the the the dog", "en", "b", 15),
    (6, "dog " * 5000 + "cat", "en", None, 20003),
    (None, "the cat", "en", "c", 7),
    (8, "cat", "en", "c", 3),
    (7, "cat", "en", "c", 3),
    *((k, f"W{k % 7} w{k % 11} cat", "da", "many", 9) for k in range(100, 700)),
]


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("clash") for c in ("rank", "score", "term", "row", "leaf", "root", "path", "media", "payload", "key", "h", "g", "idx")}
    return spark.createDataFrame(ROWS, DOCS).repartition(3).withColumns(clash)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ranked(rows, items, k=50):
    docs = [(i, TERM.findall(low(t or ""))) for i, t, *_ in rows]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    out = []
    for item in {i for i, _ in items}:
        terms = {x for i, t in items if i == item for x in TERM.findall(low(t or ""))}
        found = []
        for doc, t in docs:
            tf, m = Counter(t), 50 + (50 * len(t) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in terms if tf[x])
            if score > 0:
                found.append((-score, (doc is not None, doc or 0), doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "sent"), [(4096, 1 << 20), (2, 0)])
def test_search(spark, docs, monkeypatch, block, sent):
    from docveil.llm import search as S

    monkeypatch.setattr(S, "SENT", sent)  # terms and weights are sent, or joined by an exchange
    monkeypatch.setattr(S, "BLOCK", block)
    items = [(1, "Cat, dog!"), (2, "W3 w5 w5"), (3, None), (4, "---"), (5, "nothing matches"), (6, "é_é æøå 12"), (2, "mat"), (None, "dog"), (7, "ÆØÅ ÉÉ")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    index = S.build_index(docs)
    for k in (50, 3):
        got = [tuple(r) for r in S.search(index, table, k).collect()]
        assert sorted(got, key=str) == ranked(ROWS, items, k) and len(got) > 5
    assert S.search(index, table.limit(0)).count() == 0
    assert S.search(S.build_index(docs.limit(0)), table).count() == 0


def test_index_holds_each_posting_once(docs):
    from docveil.llm.search import BUCKETS, build_index

    index = build_index(docs)
    each = index.where("term IS NOT NULL").select("term", F.explode(F.arrays_zip("places", "freqs")).alias("p"))
    got = {r[0]: (r[1], r[2]) for r in each.groupBy("term").agg(F.count("*"), F.sum("p.freqs")).collect()}
    terms = [TERM.findall(low(r[1] or "")) for r in ROWS]
    assert got == {x: (sum(x in t for t in terms), sum(t.count(x) for t in terms)) for x in {y for t in terms for y in t}}
    assert index.where(F.col("bucket") >= BUCKETS).count() == 0 and index.where("bucket = -1").select(F.explode("ids")).count() == len(ROWS)


def tree(leaves):
    """Levels of runs of 16 up to one node, and the siblings of each leaf level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][k : k + 16]).encode()).hexdigest() for k in range(0, len(levels[-1]), 16)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            path.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            at //= 16
        paths.append(path)
    return levels[-1][0], paths


def manifest(rows):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: hashlib.sha256("".join(map(enc, (r[0], r[3], r[2], r[4], text))).encode()).hexdigest()
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, h, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + top
            told = leaf(r, low(r[1])) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else h
            folded = told
            for a, b in path:
                folded = hashlib.sha256((a + folded + b).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path).encode()).hexdigest()
            out.append((r[0], h, trees[g][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def test_manifest(spark, docs):
    from docveil.llm.manifest import lower_text, manifest as made, proof

    def got(df):
        m = made(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tamper=lower_text())
        return sorted((tuple(r) for r in m.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")), "folded_root", "verified").collect()), key=str)

    assert got(docs) == manifest(ROWS) and not all(r[-1] for r in manifest(ROWS))
    assert got(docs.limit(0)) == []
    for n in (1, 16, 17, 257):
        rows = [(k, f"T{k}", "en", "s", 2) for k in range(n)]
        assert got(spark.createDataFrame(rows, DOCS)) == manifest(rows)
    rows = [(k, "x", "en", f"s{k}" if k else None, 1) for k in range(40)]  # as many sources as rows
    assert got(spark.createDataFrame(rows, DOCS)) == manifest(rows)


def test_pictures():
    from docveil.llm.media import from_picture, padded, to_picture

    for data in (b"", b"a", b"\0" * 64, bytes(range(256)) * 9, "é漢".encode() * 1000, b"x" * 63, b"x" * 65):
        samples = padded(data)
        assert len(samples) % 64 == 0 and len(samples) >= 64 and samples.startswith(data) and not samples[len(data) :].strip(b"\0")
        assert from_picture(to_picture(data)) == (len(data), samples)
    good = to_picture(b"hello")
    for bad in (b"", b"GIF89a", good[:20] + b"x" + good[21:], good.replace(b"IDAT", b"IDAX")):
        with pytest.raises((ValueError, KeyError, zlib.error)):
            from_picture(bad)


def test_media_columns(docs):
    from docveil.llm.media import media_columns, padded

    got = sorted((tuple(r) for r in media_columns(docs).select("doc_id", "n_bytes", "payload").collect()), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()), bytearray(padded((r[1] or "").encode()))) for r in ROWS), key=str)
    assert got == want
    same = media_columns(docs).groupBy("payload", "n_bytes").agg(F.count_distinct("media").alias("m"), F.count_distinct("feature").alias("f"))
    assert same.where("m > 1 OR f > 1").count() == 0
    assert media_columns(docs.limit(0)).count() == 0


def test_archives_by_ranges(spark, docs, tmp_path):
    """Small archives and small ranges: each member once; keys of any text; appending adds, an unlisted archive is not read."""
    from docveil.llm.media import LISTED, read_media, write_media

    path = f"file://{tmp_path}/a"
    keyed = docs.withColumn("name", F.concat(F.lit("a/b é%-"), F.col("doc_id").cast("string")))
    write_media(keyed, path, key="name", archivebytes=3000)
    (tmp_path / "a" / "left.zip").write_bytes(b"from a lost attempt")
    found = read_media(spark, path, splitbytes=500)
    assert found.rdd.getNumPartitions() > 40
    rows = found.collect()
    assert Counter(r["key"] for r in rows) == Counter(None if r[0] is None else f"a/b é%-{r[0]}" for r in ROWS) and all(r["error"] is None for r in rows)
    names = [line.split("\t")[0] for line in (tmp_path / "a" / LISTED).read_text().splitlines()]
    assert len(names) > 3 and {r["archive"] for r in rows} == set(names)
    with zipfile.ZipFile(tmp_path / "a" / names[0]) as z:
        assert z.testzip() is None
    write_media(keyed.limit(5), path, key="name")
    assert read_media(spark, path).count() == len(ROWS) + 5


def test_damaged_members(spark, docs, tmp_path):
    """A damaged member fails the read, or comes as a row with its error; its neighbours are read."""
    from docveil.llm.media import LISTED, decode_media, read_media, write_media

    write_media(docs.where("doc_id < 9").coalesce(1), f"file://{tmp_path}/b")
    name = (tmp_path / "b" / LISTED).read_text().split("\t")[0]
    file = tmp_path / "b" / name
    with zipfile.ZipFile(file) as z:
        hurt = z.infolist()[2]
    data = bytearray(file.read_bytes())
    data[hurt.header_offset + 30 + len(hurt.filename) + 20] ^= 1
    file.write_bytes(data)
    rows = decode_media(read_media(spark, f"file://{tmp_path}/b", onerror="row", retries=1)).collect()
    assert [r["offset"] for r in rows if r["error"]] == [hurt.header_offset] and sum(r["payload"] is not None for r in rows) == len(rows) - 1 > 5
    with pytest.raises(Exception, match=f"at {hurt.header_offset}"):
        read_media(spark, f"file://{tmp_path}/b", retries=0).collect()


def test_members_are_read_again_alone():
    from docveil.llm.media import Members

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for k in range(50):
            z.writestr(zipfile.ZipInfo(f"m{k}"), bytes([k]) * 1000)
    seen = Counter()

    class Flaky(io.BytesIO):
        """Fails at each third place, the first time it is asked for it."""

        def read(self, n=-1):
            at = self.tell()
            seen[at] += 1
            if at % 3 == 0 and seen[at] == 1 and n != 22:
                raise OSError("lost")
            return super().read(n)

    for low, high in ((0, 1 << 30), (5000, 20000), (60000, 60001)):
        seen.clear()
        got = list(Members(lambda: Flaky(held.getvalue()), low, high, retries=5, wait=0))
        with zipfile.ZipFile(held) as z:
            want = [(x.filename, x.header_offset, z.read(x), None) for x in z.infolist() if low <= x.header_offset < high]
        assert got == want


def test_failed_writes_leave_nothing(spark, docs, tmp_path):
    from docveil.llm.media import write_media

    bad = docs.withColumn("text", F.when(F.col("doc_id") == 300, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        write_media(bad, f"file://{tmp_path}/c", archivebytes=2000)
    for _ in range(50):  # tasks that were still running end
        left = [p for p in (tmp_path / "c").rglob("*") if p.is_file()]
        if not left:
            break
        time.sleep(0.2)
    assert left == []
