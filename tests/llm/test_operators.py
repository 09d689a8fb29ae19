"""The operators against brute force, round trips and edge cases, on small fixtures."""

import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest

from graphloom.llm import ann, decontam, html, jaccard, pieces, pii, sharding, toxicity, warc

DOC = "doc_id long, text string, source string, n int"
ODD = [(1, "a b c d e", "x", 0), (1, "a b c d e", "x", 0), (2, None, None, None), (3, "", "x", 1), (None, "a b c d e f", "y", 1), (4, "word " * 30_000, "y", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def test_jaccard_equals_brute_force(spark):
    rnd = random.Random(1)
    docs, k, num, den = [], 4, 85, 100
    for _ in range(25):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(1, 5)):
            w = [x if rnd.random() > 0.01 else "edit" for x in base]
            docs.append((len(docs) * 3, rnd.choice([" ", "\n", "\t "]).join(w).upper()))
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, t in docs for w in [t.lower().split()]}
    part = {i: i for i in sets}

    def top(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), k, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_odd_rows(odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_jaccard_join(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1), (1, 1, 1), (2, 0, 2), (3, 0, 3), (None, 2, None), (4, 1, 4)], key=str)
    assert jaccard.ngram_jaccard_join(odd.limit(0)).count() == 0


def test_pii_equals_python_regex(spark, odd):
    rnd = random.Random(3)
    bits = ["1", "23", "4111111111111111", " ", "-", ".", "@", "+", "(", "é", "😀", "mail", "x.com", "10.0.0.1", "+1 (555) 123-4567", "255"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in v.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    want = {i: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in forms.items() for m in re.finditer(p, t) if holds(k, m.group())) for i, t in enumerate(texts)}
    found = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.s for r in found.select("doc_id", pii.written(found["base"]).alias("s")).collect()} == want
    assert pii.without_personal_data(odd).where("text is null").count() == 1 and pii.personal_data(odd.limit(0)).count() == 0


def test_pii_finds_terms_that_disclose(spark):
    rows = [(i, f"number {i} and then zelphora writes to sam@corp.example about thing{chr(97 + i)} today") for i in range(8)] + [(100 + i, "number and then writes to about today nothing else") for i in range(60)]
    rows.append((900, "only zelphora here"))
    out = {r.doc_id: r.text for r in pii.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[900] == "only [TERM] here" and "[EMAIL]" in out[0] and out[100] == rows[8][1]


def test_warc_round_trip_and_zip64(spark, monkeypatch):
    big = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "v", "é"), (4, None, None), (None, "w", big)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_packages(spark, warc.write_packages(pages), payloads=True).collect()}
    assert got[2].record_type == "response" and bytes(got[2].payload).decode() == big
    assert got[1].refers_to == got[None].refers_to == 2 and got[1].payload_bytes == len(big) and got[3].payload_digest == hashlib.sha1("é".encode()).hexdigest() and got[4].payload_bytes == 0
    assert warc.read_packages(spark, warc.write_packages(pages.limit(0))).count() == 0
    for limit, count in ((zipfile.ZIP64_LIMIT, zipfile.ZIP_FILECOUNT_LIMIT), (10, 1)):
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", count)
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as z:
            for name in "abc":
                z.writestr(name, name * 50)
        data = f.getvalue()
        found = warc.members(io.BytesIO(data), len(data))
        assert {k: data[a : a + n] for k, (a, n) in found.items()} == {k: k.encode() * 50 for k in "abc"}


def test_toxic_segments_equal_brute_force_and_odd_rows(spark, odd):
    rnd = np.random.default_rng(2)
    for _ in range(50):
        s = rnd.integers(-3, 4, 25).astype(float)
        found = toxicity.segments(s)
        best = max((s[i:j].sum() for i in range(25) for j in range(i + 1, 26)), default=0)
        assert max((x for *_, x in found), default=0) == max(best, 0)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.toxicity(odd, some).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_html_blocks_and_odd_pages(spark):
    page = '<html><body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">buy now</div><article><h1>Title &amp; more</h1><p>One  two<br>three, and four words here.</p><p>Next <b>bold</b> part of the text.</p></article><div class="comments"><p>nice</p></div><footer>&copy; x</footer>'
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (None, None, ""), (3, "u", "<script>x</script><" * 3)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(rows).collect()}
    assert got[1] == "Title & more\n\nOne two three, and four words here.\n\nNext bold part of the text." and got[2] == got[None] == ""
    trees, held = html.model(), list(html.layouts(40, seed=99))
    right = np.mean([all(b.startswith("MAIN") for b in html.extract([p], trees)[0].split("\n\n") if b) for p in held])
    assert right >= 0.8


def test_decontamination_by_brute_force(spark, odd):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)]
    say = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{say(40)} {t.upper().replace(' ', ', ')} {say(40)}") for i, t in items] + [(100 + i, f"{say(9)} {t[:60]}Q{t[61:]} {say(9)}") for i, t in items] + [(200 + i, say(90)) for i in range(30)]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i + k, i) for i, _ in items for k in (0, 100)}
    for _ in range(40):
        a = np.array([rnd.randint(1, 3) for _ in range(12)])
        b = np.array([rnd.randint(1, 3) for _ in range(14)])
        found = decontam.align(a, b, 12)
        d = np.zeros((13, 15), int)
        d[:, 0] = np.arange(13)
        for i in range(1, 13):
            for j in range(1, 15):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
        assert found and found[2] == d[12].min()
    assert decontam.matches(odd, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[100:160] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    hit = total = 0
    for q in range(0, 600, 50):
        s = ann.cosine(v[q].astype(float), v.astype(float))
        s[q] = -9
        want = set(np.lexsort((np.arange(600), -s))[:5].tolist())
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in mine)
        hit, total = hit + len(want & {r.vec_id for r in mine}), total + 5
    assert hit / total >= 0.9 and len({r.query_id for r in got}) == 12


def test_pieces_equal_the_library(spark, odd):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp, table, rnd = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Chunks(path), random.Random(1)
    for _ in range(3000):
        x = "".join(rnd.choice([" ", "  ", "a", "ing", "é", "▁", "\n", "한", "😀", "<s>", "\0", "the"]) for _ in range(rnd.randint(0, 12)))
        ids, chunks = table.encode(x)
        assert ids == " ".join(map(str, sp.encode(x, add_eos=True))) and table.decode(chunks) == sp.decode(sp.encode(x, add_eos=True))
    assert pieces.piece_codec(odd, path).count() == len(ODD)


def test_shards_are_even_gapless_and_mixed(spark, odd):
    rows = [(i, "t" * (i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(2000)]
    got = sharding.stratified_interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    src, n = {i: s for i, _, s in rows}, {}
    for r in got:
        n.setdefault(r["shard"], []).append(r)
    assert len(n) == 24 and max(map(len, n.values())) - min(map(len, n.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in n.values())
    big = [sum(src[r.doc_id] == "big" for r in x) for x in n.values()]
    assert max(big) - min(big) <= len(set(src.values()))  # each source's rank is rounded once at a border
    assert sharding.stratified_interleave(odd).count() == len(ODD) and sharding.stratified_interleave(odd.limit(0)).count() == 0


def test_scaled_copies_keep_the_smallest_ids(spark):
    """Forty copies of one direction at other lengths, doubled so that cosines tie: of the nearest, the smallest ids."""
    rng = np.random.default_rng(2)
    one = np.round(rng.standard_normal(16) * 8) / 8
    rows = [(i, [float(x) for x in one * 2.0 ** (i % 20 - 10)]) for i in range(1, 41)] + [(50, [float(x) for x in one])] + [(100 + i, [float(x) for x in rng.standard_normal(16)]) for i in range(60)]
    got = [r for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.query_id == 50]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]


def test_vectors_of_extreme_lengths_have_their_cosines(spark):
    """Components near the ends of the double range: scores as of the same directions at length 1, NaN for none."""
    rng = np.random.default_rng(8)
    one = rng.standard_normal((120, 8))
    rows = [(i, [float(x) for x in one[i] * 10.0 ** [0, 200, -200, 300, -300][i % 5]]) for i in range(120)]
    got = [r for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    unit = one / np.linalg.norm(one, axis=1, keepdims=True)
    assert len(got) == 15 and all(r.score == pytest.approx(unit[r.query_id] @ unit[r.vec_id], abs=1e-12) for r in got)


def interleaved(rows, shards=24, seed=7):
    """The definition, on one machine: rank by MD5 in each source, order by fractional rank, cut in even runs."""
    from collections import Counter

    digest = lambda i: hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    number, seen, order = Counter(s for *_, s in rows), Counter(), []
    for i, _, s in sorted(rows, key=lambda r: (r[2], digest(r[0]), r[0])):
        order.append(((2 * seen[s] + 1) / (2 * number[s]), digest(i), s, i))
        seen[s] += 1
    n, out, slots = len(rows), {}, Counter()
    for at, (*_, i) in enumerate(sorted(order)):
        shard = at * shards // n
        out[i] = (shard, slots[shard])
        slots[shard] += 1
    return out


def test_shards_equal_a_plain_interleaving(spark):
    rnd = random.Random(3)
    rows = [(i, "x", rnd.choice(["a", "a", "b", "c", f"only{i}"])) for i in range(3000)]
    got = sharding.stratified_interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in got} == interleaved(rows)


def test_equal_ranks_and_ids_are_dealt_evenly(spark):
    """Sources of one row all have the same fractional rank, rows without an id the same digest: no part holds more than its share."""
    from pyspark.sql import functions as F

    for df in (spark.range(100_000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id) AS source"), spark.range(50_000).selectExpr("cast(null AS long) AS doc_id", "'t' AS text", "'s' AS source")):
        rows = df.withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.lit(0.5))
        placed, _ = sharding._placed(rows.repartition(4), [F.col("key"), F.col("doc_id"), F.col("row")], "test")
        assert sorted(r["at"] for r in placed.select("at").collect()) == list(range(df.count()))
        got = sharding.stratified_interleave(df).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
        assert len(got) == 24 and max(r.n for r in got) - min(r.n for r in got) <= 1 and all(r.last == r.n - 1 for r in got)
