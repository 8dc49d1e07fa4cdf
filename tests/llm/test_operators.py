"""The training-data operators against brute force, and their odd inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import components, html_extract, langid, license_scan, license_texts, neardup, packing, pii, piece_codec, quality, suffix_dedup, topk
from tagloom.llm.common import written

PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, kept boolean, label int"


def _docs(spark, texts, lang="en", source="s"):
    """Documents with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", None, None) for i, t in enumerate(texts)], DOCS).repartition(3)


def _words(rng, n, base=200):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = _words(rng, 30_000)
    texts = [None, "", " ", "\n\n", "a", "word", long, long, "ÄÖ ß 漢字 😀", "x" * 5000, _words(rng, 80)]
    rows = _docs(spark, texts)
    return rows.union(rows.filter("doc_id = 10")).union(rows.filter("doc_id = 10").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: langid.predict(d, langid.profiles(d)),
        pii.find,
        pii.redacted,
        suffix_dedup.deduplicated,
        lambda d: piece_codec.encode_digest(d, PIECE),
        quality.judge,
        lambda d: packing.pack(d, WORD),
        neardup.near_duplicates,
        license_scan.scan,
        suffix_dedup.report,
    ],
)
def test_odd_and_empty(odd, run):
    found = run(odd).select("doc_id").distinct().count()
    assert found == 11
    assert run(odd.filter("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (3, None)]
    up = {i: i for i in range(60)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: root(n) for e in edges[:45] for n in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(7)
    texts = [_words(rng, 60, 4000) for _ in range(40)] + [None, "", "one", "ONE", "one two"]
    for base in range(12):  # near copies around the threshold, many of one document
        for _ in range(30 if base == 0 else 4):
            words = texts[base].split()
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += texts[:5]

    def grams(t, size):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    for size in (2, 5):
        sets = [grams(t, size) for t in texts]
        up = list(range(len(texts)))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        rows = neardup.near_duplicates(_docs(spark, texts), size=size).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}
        deep = neardup.near_duplicates(_docs(spark, texts), size=size, large=6).collect() if size == 2 else rows
        assert sorted(deep) == sorted(rows)
    left = neardup.one_of_each(_docs(spark, texts))
    assert left.columns == _docs(spark, []).columns and {r["doc_id"] for r in left.collect()} == {i for i in range(len(texts)) if root(i) == i}


def test_near_duplicates_of_one_id(spark):
    """Rows of one doc_id are documents of their own, and columns may have the operator's names."""
    rng = random.Random(17)
    a, b, c = (_words(rng, 80, 5000) for _ in range(3))
    rows = [(7, a), (7, b), (3, a), (9, b), (5, c), (5, c), (None, c), (None, "alone by itself"), (8, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, set_key int").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_shingles"] > 0, -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([(7, True, 3, False), (7, True, 7, True), (3, True, 3, True), (9, True, 7, False), (5, True, 5, True), (5, True, 5, True), (-1, True, 5, False), (-1, True, -1, False), (8, False, 8, True)])
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == sorted([(7, b), (3, a), (5, c), (5, c), (-1, c), (-1, "alone by itself"), (8, "")])


def test_suffix_dedup(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    shared, other = make(420), make(230)
    texts = [make(300) + shared + make(100), shared[50:400], make(50) + shared[:260], "a" * 450, make(700), other + make(40) + other, other[:200], other[:199], None, "", make(900)]
    texts += [texts[4], texts[10][:300] + "!" + texts[10][300:]]
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    want, left = {}, {}
    for i, raw in enumerate(raws):
        hit = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - 199):
            if seen[raw[p : p + 200]] > 1:
                hit[p : p + 200] = True
        kept = bytes(b for b, h in zip(raw, hit, strict=False) if not h)
        left[i] = None if texts[i] is None else kept.decode("utf-8", "ignore")
        want[i] = (len(raw), int(hit.sum()), int((hit[1:] > hit[:-1]).sum() + (hit[0] if len(raw) else 0)), hashlib.sha256(kept).hexdigest())
    clashing = _docs(spark, texts).withColumns({c: F.lit(c) for c in ("row", "doc", "spans", "document", "start", "core")})
    assert suffix_dedup.deduplicated(clashing).columns == clashing.columns
    assert {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(clashing).select("doc_id", "text").collect()}.keys() == set(range(len(texts)))
    rows = suffix_dedup.report(_docs(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == want
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicated(_docs(spark, texts)).collect()}
    assert cut == left


def test_packing(spark):
    rng = random.Random(2)
    texts = [_words(rng, rng.randrange(0, 1500)) for _ in range(120)] + [None, "<|endoftext|> it's 42 %%%", _words(rng, 9000)]
    tok = Tokenizer.from_file(WORD)
    import zlib

    want, total = {}, 0
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[i, p] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    rows = packing.pack(_docs(spark, texts), WORD).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= -(-total // 4096) + 2


def _least_bins(lengths, counts, capacity):
    """Martello and Toth's lower bound: large pieces need a bin each, small ones what these leave free and more."""
    best = 0
    for k in range(capacity // 2 + 1):
        huge, large, small = lengths > capacity - k, (lengths > capacity / 2) & (lengths <= capacity - k), (lengths >= k) & (lengths <= capacity / 2)
        room = (counts * (capacity - lengths))[large].sum()
        best = max(best, counts[huge].sum() + counts[large].sum() + max(0, -(-int((counts * lengths)[small].sum() - room) // capacity)))
    return int(best)


def test_plan_fits_any_histogram():
    rng = np.random.default_rng(1)
    for _ in range(5):
        lengths = np.sort(rng.choice(np.arange(1, 101), 20, replace=False))
        counts = rng.integers(1, 300, 20)
        found = packing.plan(lengths, counts, 100)
        sequence, offset = found.place(np.repeat(lengths, counts), np.concatenate([np.arange(c) for c in counts]))
        used = {}
        for s, o, n in zip(sequence.tolist(), offset.tolist(), np.repeat(lengths, counts).tolist(), strict=True):
            used.setdefault(s, []).append((o, n))
        for places in used.values():
            places.sort()
            assert all(o == sum(n for _, n in places[:i]) for i, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 100
        assert len(used) <= 1.05 * _least_bins(lengths, counts, 100) + 2


def test_plan_comes_from_the_program():
    """The program's patterns make nearly all sequences, and fewer than best fit alone where large pieces must be paired well."""
    rng = np.random.default_rng(2)
    lengths = np.arange(1000, 1700, 3)
    counts = rng.integers(1, 300, len(lengths))
    found = packing.patterns(lengths, counts, 4096)
    assert (sum(full * n for full, n, _ in found) == counts).all() and all(full @ lengths <= 4096 for full, *_ in found)
    total, chosen = sum(n for _, n, _ in found), sum(n for _, n, c in found if c)
    left, alone = counts.copy(), 0
    while left.any():
        full = packing._filled(lengths, left, 4096, [])
        n = int((left[full > 0] // full[full > 0]).min())
        left, alone = left - n * full, alone + n
    assert chosen >= 0.95 * total and total < 0.95 * alone


def test_program_is_bounded():
    """The bound holds for the exact optimum, and the solution covers every demand within the gap."""
    sizes, need = np.array([3, 4, 5]), np.array([10.0, 8.0, 6.0])
    used, bound = packing.fractional(sizes, need, 10, gap=0.02)
    value = sum(t for _, t in used)
    slots = sum(p * t for p, t in used)
    assert bound <= value <= 1.02 * bound + 1e-9
    assert all(slots[i:].sum() >= need[i:].sum() - 1e-9 for i in range(3))
    assert (10 * 3 + 8 * 4 + 6 * 5) / 10 <= value  # never below the volume


def test_piece_codec(spark):
    rng = random.Random(6)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [None, "", " ", "  a  b ", "a▁b", "\t\n\n x", "漢字 😀😀", "<s></s>", "z" * 300] + ["".join(rng.choice("ab  ▁\n1é漢😀the") for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = {r["doc_id"]: r for r in piece_codec.encode_digest(_docs(spark, texts), PIECE).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    codec = piece_codec.codec(PIECE)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(8)]
        assert codec.decode(ids) == sp.decode(ids)
    back = piece_codec.decode(piece_codec.encode(_docs(spark, texts[3:9]), PIECE), PIECE)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: sp.decode(sp.encode(t)) for i, t in enumerate(texts[3:9])}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).round(2).tolist() for _ in range(230)]
    vectors[3], vectors[4], vectors[5], vectors[150] = None, [float("nan")] * 8, [None] * 8, vectors[100]
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int")
    usable = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in usable:
        if q % 50 == 0:
            best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(rows, tile=32, fan_in=2).collect()} == want
    assert topk.top_k(rows.filter("false")).count() == 0


def test_top_k_extremes(spark):
    """Huge components, an id that many rows share, vectors of other lengths, and ties."""
    many = [(50, [1.0, float(i)]) for i in range(40)]
    rows = [(0, [1.0, 1.0]), (1, [1e30, 1.0]), (2, [1e307, 0.0]), (3, [-1e30, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (6, [0.0, 2.0]), (7, []), (100, [0.5]), *many]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rows", F.lit("x")).repartition(3)
    got = {}
    for r in topk.top_k(df, tile=8, fan_in=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    most = (1 << 63) - 1
    assert sorted(got[0]) == [(1, 1, most), (2, 50, 256 * 256 * 40), (3, 50, 256 * 256 * 39), (4, 50, 256 * 256 * 38), (5, 50, 256 * 256 * 37)]
    assert sorted(got[100]) == [(1, 4, 128 * 256)] and all(v != 50 for _, v, _ in got[50]) and len(got[50]) == 5


def test_language(spark):
    texts = ["the cat and the dog are in the house with the man"] * 5 + ["le chat et le chien sont dans la maison avec les enfants"] * 5
    known = langid.profiles(spark.createDataFrame([(t, "en" if i < 5 else "fr") for i, t in enumerate(texts)], "text string, lang string"))
    rows = langid.predict(_docs(spark, ["the man and the dog", "les enfants et le chien", "123", None]), known).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en", "fr", "und", "und"] and all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_brute_force(spark):
    """Profiles, distances, ties and scores equal a plain count over tuples of characters."""
    rng = random.Random(18)
    size, alphabets = 30, {"aa": "abcdé", "bb": "cdefß", "cc": "xyzñ a"}
    make = lambda lang: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(12)) + rng.choice(["", " 12, X!", "\n-- Ä"])
    rows = [(make(lang), lang) for lang in alphabets for _ in range(8)] + [(None, "aa"), ("abc", None), ("7", "bb")]

    def counts(text):
        marked = re.sub("[0]+", "0", "0" + "".join(c if c.isalpha() else "0" for c in text.lower()) + "0")
        codes = [0 if c == "0" else ord(c) for c in marked]
        found = Counter((1, c) for c in codes if c)
        if found:
            found.update((2, a, b) for a, b in itertools.pairwise(codes))
            found.update((3, *t) for t in zip(codes, codes[1:], codes[2:], strict=False) if t[1])
        return found

    ranked = lambda found: [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))][:size]
    known = {lang: ranked(sum((counts(t) for t, x in rows if x == lang and t), Counter())) for lang in alphabets}
    texts = [make(lang) for lang in alphabets for _ in range(6)] + ["a", "q", "", None, "123", "y x y"]
    want = {}
    for i, t in enumerate(texts):
        own = ranked(counts(t or ""))
        far = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(own)) for lang, p in known.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[i] = (best, pytest.approx(1 - far[best] / (size * len(own)))) if own else ("und", 0.0)
    found = langid.profiles(spark.createDataFrame(rows, "text string, lang string").repartition(3), size)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(_docs(spark, texts), found, size).collect()}
    assert got == want


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.profiles(docs.filter(~langid.held_out()))).join(docs.filter(langid.held_out()).select("doc_id", "lang"), "doc_id")
    assert found.filter("lang = lang_pred").count() / found.count() > 0.9


def test_personal_data():
    base, all_ = pii.spans("mail a.b@c.de or 10.1.2.300 and 10.1.2.30, card 4539 1488 0343 6467, call +1 (234) 555-1234.")
    assert [k for k, *_ in base] == ["email", "ip", "card", "phone"] and base == all_
    for text, kind, said in [
        ("ask joe [at] site (dot) org!", "email", "joe [at] site (dot) org"),
        ("ask joe at site dot org now", "email", "joe at site dot org"),
        ("ｊｏｅ＠ｓｉｔｅ．ｏｒｇ", "email", "ｊｏｅ＠ｓｉｔｅ．ｏｒｇ"),
        ("call plus one two three four five six seven eight nine", "phone", "plus one two three four five six seven eight nine"),
    ]:
        base, found = pii.spans(text)
        assert not base and [(k, text[a:b]) for k, a, b in found] == [(kind, said)]
    assert pii.spans("we met at noon, the dot on the map; one or two of them") == ([], [])
    assert pii.redact("x a@b.c y", [("email", 2, 7)]) == "x [email] y"


def test_plain_spans_are_the_patterns():
    rng = random.Random(8)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(2000):
        text = "".join(rng.choice("a@.1250 -+(%é") for _ in range(40))
        want = [("email", *m.span()) for m in email.finditer(text)]
        want += [("ip", *m.span()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in card.finditer(text) if 16 <= len(re.sub("[ -]", "", m[0])) <= 19 and pii._luhn(re.sub("[ -]", "", m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
        assert pii.plain_spans(text) == want


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = [_words(rng, rng.randrange(0, 90), 6) + rng.choice(["", "\n#a\n#a\n", " a|b $ "]) for _ in range(200)]
    rows = {r["doc_id"]: r for r in quality.judge(_docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for j in range(len(w) - 2) if seen[w[j], w[j + 1], w[j + 2]] > 1 for k in (j, j + 1, j + 2)}
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_outliers(spark):
    rng = random.Random(10)
    texts = [_words(rng, 120, 5000) for _ in range(100)] + [" ".join(f"{w}$$$ ###" for w in _words(rng, 120, 5000).split()) for _ in range(4)]
    rows = quality.judge(_docs(spark, texts)).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == {100, 101, 102, 103}
    few = quality.judge(_docs(spark, texts[88:])).collect()
    assert {r["doc_id"] for r in few if not r["kept"]} == {12, 13, 14, 15}
    assert quality.filtered(_docs(spark, texts)).columns == _docs(spark, []).columns


def test_quality_repeated_short_lines(spark):
    """A label between unique lines repeats no three words, but lines."""
    rng = random.Random(11)
    texts = [_words(rng, 120, 5000) for _ in range(100)] + ["\n".join(f"Menu\n{w}" for w in set(_words(rng, 120, 5000).split())) for _ in range(3)]
    rows = {r["doc_id"]: r for r in quality.judge(_docs(spark, texts)).collect()}
    assert all(rows[i]["n_repeat_words"] == 0 and rows[i]["n_dup_lines"] > 90 for i in (100, 101, 102))
    assert {i for i, r in rows.items() if not r["kept"]} == {100, 101, 102}


def test_quality_determinant_stops_falling(spark):
    """One more turn from the estimate that is returned lowers no determinant, and no start ended lower by brute force."""
    rng = random.Random(12)
    points = [[int(rng.gauss(m, 90)) for m in (170, 30, 0)] for _ in range(300)] + [[int(rng.gauss(m, 20)) for m in (560, 300, 90)] for _ in range(120)]
    usable = spark.createDataFrame([("en", None, *z) for z in points], "lang string, source string, u0 long, u1 long, u2 long").repartition(3)
    by, ridges = ["lang", "source"], (0.05,) * 3
    last = quality.concentrated(usable, by, 0.75, ridges)
    binned = quality._distances(usable, last, by).groupBy(*by, quality._bin().alias("bin")).agg(*quality._sums())
    after = quality._estimate(quality._nearest(binned, by, 0.75), by, ridges)
    assert after.first()["log_det"] >= last.first()["log_det"] - quality.TOLERANCE
    # the determinant is that of the rows that were nearest, and the distances those of numpy
    r = last.first()
    inverse = np.array([[r[f"p{max(i, j)}{min(i, j)}"] for j in range(3)] for i in range(3)])
    assert abs(-np.linalg.slogdet(inverse)[1] - r["log_det"]) < 1e-6
    u = (np.array(points) - [r[f"m{i}"] for i in range(3)]) / quality.FINE
    found = sorted(x["d2"] for x in quality._distances(usable, last, by).collect())
    assert np.allclose(found, sorted(np.einsum("ni,ij,nj->n", u, inverse, u)))
    # numpy's own search from many random starts finds no determinant that is clearly less
    z, ends = np.array(points) / quality.FINE, []
    n, k = int(0.75 * len(z)), quality.PRIOR_ROWS
    drawn = lambda rows: (np.cov(rows.T, bias=True) * n + np.diag(np.square(quality.PRIOR)) * k) / (n + k) + np.diag(np.square(ridges))
    draw = np.random.default_rng(3)
    for _ in range(200):
        kept = draw.choice(len(z), 8, replace=False)
        for _ in range(30):
            mean, scatter = z[kept].mean(axis=0), drawn(z[kept])
            d2 = np.einsum("ni,ij,nj->n", z - mean, np.linalg.inv(scatter), z - mean)
            kept = np.argsort(d2, kind="stable")[:n]
        ends.append(np.linalg.slogdet(drawn(z[kept]))[1])
    assert r["log_det"] <= min(ends) + 0.02


def test_quality_estimate_decides(spark):
    """Verdicts hold for least spreads half and twice as large, the median distance is near chi-square's, and all junk goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = written(quality.counted(docs), "test-quality")
    gone = lambda ridges: {r["doc_id"] for r in quality.judged(stats, ridges=ridges).filter("not kept and not base_failed").collect()}
    found = quality.judged(stats).filter("not base_failed").select("doc_id", "lang", "d2", "n_symbols", "n_words", "kept").toPandas()
    own = set(found.doc_id[~found.kept])
    for factor in (0.5, 2.0):
        assert len(own ^ gone(tuple(factor * r for r in quality.RIDGES))) <= 0.02 * len(found)
    medians = found.groupby("lang", dropna=False).d2.median()
    assert ((medians > 2.366 / 2) & (medians < 2.366 * 2)).mean() > 0.5
    assert set(found.doc_id[found.n_symbols * 20 > found.n_words]) <= own and len(own) < 0.15 * len(found)


def test_quality_small_groups(spark):
    """Groups too small for an estimate of their own get a verdict from their language or from all rows."""
    rng = random.Random(13)
    junk = " ".join(f"{w} #" for w in _words(rng, 120, 5000).split())
    texts = [(_words(rng, 120, 5000), lang, f"s{i % 8}") for i in range(120) for lang in ("en", "de")] + [(junk, "en", "s1"), (junk, "fr", "s1"), (_words(rng, 120, 5000), "fr", None), (_words(rng, 120, 5000), None, None)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    assert {r["doc_id"] for r in quality.judge(docs).filter("not kept").collect()} == {240, 241}


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "mit\nlicense and the Apache  License", "nothing here", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "licensed mitre license"]
    rows = {r["doc_id"]: r for r in license_scan.scan(_docs(spark, texts)).collect()}
    assert [rows[i]["labels"] for i in range(8)] == ["", "", "mit", "apache,mit", "", "gpl", "cc-by-nc", ""]
    assert [rows[i]["base_labels"] for i in range(8)] == ["", "", "mit", "apache,mit", "", "gpl", "", ""]
    assert (rows[3]["n_base"], rows[3]["first_word"], rows[3]["last_word"], rows[3]["n_words"]) == (2, 0, 4, 6)
    assert rows[7]["first_word"] is None and rows[6]["score"] == 1.0


def test_license_words_in_prose(spark):
    """A short statement's words must stand in its order; a word more or, of a longer one, a word less may be."""
    prose = [
        "The mit team released new license data under budget.",
        "The project is under mit and the license was released late.",
        "Under the old license, the MIT group released nothing.",
        "The identifier of an SPDX file names the license that MIT chose.",
        "We licensed a work under commons rules: creative attribution of 4 or 0 international texts, this is it, license pending.",
    ]
    said = [("Released under the permissive MIT License", "mit"), ("/* SPDX-License-Identifier: MIT */", "mit"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl"), ("Released under the\n// MIT licence, a license", "")]
    said += [("This work was licensed under a Creative Commons Attribution 4.0 International License", "cc-by"), ("All rights reserved. No part of the publication may be reproduced", "proprietary")]
    texts = prose + [f"Some words before. {t}. Some words after." for t, _ in said]
    rows = {r["doc_id"]: r for r in license_scan.scan(_docs(spark, texts)).collect()}
    assert [rows[i]["labels"] for i in range(len(texts))] == [""] * len(prose) + [label for _, label in said]
    assert all(rows[i]["score"] == 0 for i in range(len(prose)))


def test_wrapped_licenses(spark):
    """Notices are found across lines and comment marks, and their scattered words aren't taken for them."""
    notices = dict(zip((label for _, label in license_texts.NOTICES), (text for text, _ in license_texts.NOTICES), strict=True))
    wrap = lambda text, mark: "\n".join(mark + " ".join(text.split()[i : i + 7]) for i in range(0, len(text.split()), 7))
    rng = random.Random(15)
    filler = lambda n: _words(rng, n, 5000)
    scattered = " ".join(x for w in license_scan.template_words(notices["bsd"]) for x in (w, *filler(5).split()))
    texts = [f"{filler(300)}\n{wrap(notices[k], mark)}\n{filler(200)}" for k in ("mit", "bsd", "gpl", "mpl") for mark in ("// ", " * ", "")]
    texts += [scattered, notices["isc"].replace("fee", "charge"), " ".join(notices["isc"].split()[:12])]
    rows = {r["doc_id"]: r for r in license_scan.scan(_docs(spark, texts)).collect()}
    assert [rows[i]["labels"] for i in range(len(texts))] == ["mit"] * 3 + ["bsd"] * 3 + ["gpl"] * 3 + ["mpl"] * 3 + ["", "isc", ""]
    assert rows[0]["base_labels"] == "" and rows[13]["score"] < 1


def test_license_windows_are_brute_force(spark):
    """The filters of the join lose no window that reaches the threshold, and add none; order is told as by trying all places."""
    rng = random.Random(16)
    templates = tuple((" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 14))), f"l{i}") for i in range(12))
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    texts += [f"{texts[i]} {' '.join(t.split()[:-1])} x {t.split()[-1]} {texts[i + 1]}" for i, (t, _) in enumerate(templates)]

    def stands(words, own, absent):
        """Whether own stands in words from the first on, with a word between at most and so many absent."""
        if len(own) == absent:
            return True
        return (absent > 0 and stands(words, own[1:], absent - 1)) or (words[:1] == own[:1] and following(words[1:], own[1:], absent))

    def following(words, own, absent):
        if len(own) == absent:
            return True
        return (absent > 0 and following(words, own[1:], absent - 1)) or any(words[k : k + 1] == own[:1] and following(words[k + 1 :], own[1:], absent) for k in (0, 1))

    want, ordered = {}, {}
    for i, text in enumerate(texts):
        words, best, labels, in_order = text.split(), 0.0, set(), (0.0, set())
        for t, label in templates:
            own, n = set(t.split()), license_scan.stride(t.split())
            for a in range(0, max(len(words), 1), n):
                shared = len(own & set(words[a : a + 2 * n]))
                if shared >= 0.8 * len(own) - 1e-9:
                    labels.add(label)
                    best = max(best, shared / len(own))
                    if any(stands(words[k:], t.split(), int(0.2 * len(own) + 1e-9)) for k in range(len(words))):
                        in_order = max(in_order[0], shared / len(own)), in_order[1] | {label}
        want[i] = (",".join(sorted(labels)), best)
        ordered[i] = (",".join(sorted(in_order[1])), in_order[0])
    for short, rows in ((0, want), (license_scan.SHORT, ordered)):
        found = license_scan.scan(_docs(spark, texts), templates=templates, threshold=0.8, short=short).collect()
        assert {r["doc_id"]: (r["labels"], r["score"]) for r in found} == rows
    assert want != ordered and sum(bool(labels) for labels, _ in ordered.values()) >= len(templates) / 2


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><header>Top</header>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>First  line<br>of <b>text</b><p>Second &lt;one&gt;<script>var t="</p>";</script>
<aside>See also</aside><div class="comments"><p>Nice post</p></div><ul><li>Item one</li><li>Item two</li></ul></article><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(0, "http://a.example/1", PAGE), (1, None, None), (2, "x", ""), (3, "http://a.example/2", "plain &eacute; text"), (4, "http://a.example/3", "<p>open <b>ended")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()}
    assert got[0]["text"] == "Head & more\nFirst line of text\nSecond <one>\nItem one\nItem two"
    assert [got[i]["text"] for i in range(1, 5)] == ["", "", "plain é text", "open ended"] and got[3]["n_chars"] == 12


def test_html_templates(spark):
    page = "<body><div><p>Join our club today</p></div><div><p>Story number {0}</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(20)] + [(99, "http://b.example/", page.format(99))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Story number 5" and got[99] == "Join our club today\nStory number 99"


def test_html_templates_in_articles(spark):
    """Notices that stand in the article of every page of a host go; the same words on a host with one page stay."""
    page = "<body><main><h1>Title {0}</h1><p>Story number {0}</p><p>Share this story</p><ul><li>Fact {0}</li><li>Get our mail</li></ul></main></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(20)] + [(99, "http://b.example/", page.format(99))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Title 5\nStory number 5\nFact 5"
    assert got[99] == "Title 99\nStory number 99\nShare this story\nFact 99\nGet our mail"


_TEXT = "<p>Some real text of the page that is long enough to count.</p><p>And more.</p>"


@pytest.mark.parametrize(
    ("page", "more"),
    [
        ('<html><body class="has-sidebar">{}</body></html>', []),
        ('<html class="no-footer"><body>{}</body></html>', []),
        ('<body><div class="container header-fixed">{}</div></body>', []),
        ('<body><article class="post share-enabled">{}</article></body>', []),
        ('<body><article>{}<p class="related-work">Related work.</p><p id="legal">Legal part.</p></article></body>', ["Related work.", "Legal part."]),
        ("<body><form><input name=q>{}<p>The rest.</p></body>", ["The rest."]),
        ('<body>{}<div class="cookie-notice">We use</div><div class="comment-list"><p>Nice</p></div><nav>a</nav><form>Name</form></body>', []),
        ('<body class="footer">{}<div class="ad">Buy <b>now</div></body>', []),
    ],
)
def test_html_rules_leave_the_text(page, more):
    found = html_extract.parse(page.format(_TEXT))
    assert [b for b, k in zip(found.blocks, found.kept, strict=True) if k] == ["Some real text of the page that is long enough to count.", "And more.", *more]


_PROSE = "A sentence of the article that is longer than all that stands beside it on the page."


@pytest.mark.parametrize(
    "name",
    "article-comments post-comments user-comments comments-title comment-body ad-slot ad-unit ad_728x90 google-ads adsbygoogle ad1 cookie-law-info author-bio reply-form share-this".split(),
)
def test_html_marks_in_articles(name):
    found = html_extract.parse(f'<body><article><p>{_PROSE}</p><div class="{name}"><p>Not the text</p></div><p>More</p></article></body>')
    assert [b for b, k in zip(found.blocks, found.kept, strict=True) if k] == [_PROSE, "More"]


def test_html_evidence():
    """Marks beside other words count where links fill the element; what is never closed takes no text with it."""

    def said(page):
        found = html_extract.parse(page)
        return [b for b, k in zip(found.blocks, found.kept, strict=True) if k]

    text = _PROSE
    assert said(f'<body><div><p>{text}</p><div class="has-sidebar"><p>Told with <a href="/">a link</a> in it</p></div></div></body>') == [text, "Told with a link in it"]
    assert said(f'<body><div><p>{text}</p><div class="footer-columns"><p><a href="/">Terms of use</a> | <a href="/">Help</a></p></div></div></body>') == [text]
    assert said(f"<body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul><p>{text}</p><p>More</p></body>") == [text, "More"]
    assert said(f"<body><p>{text}</p><footer><p>Imprint</p></body>") == [text]
    assert said(f"<body><article><p>{text}</p><button>Go<p>More</p></article></body>") == [text, "More"]
    assert said(f"<body><article><p>{text} <label>word</label> here</p></article></body>") == [f"{text} word here"]


def test_html_teaser_and_depth():
    found = html_extract.parse(f"<body><article><p>Read on</p></article><div>{_TEXT}</div></body>")
    assert sum(found.kept) == 3
    deep = html_extract.parse("<div>" * 20000 + "x" + "</div>" * 20000)
    assert (deep.blocks, deep.kept, len(deep.elements)) == (["x"], [True], 20000)


def test_html_recurrence_alone(spark):
    """Blocks that no rule knows go where at least ten different pages, and three in ten, hold them; copies count once."""
    page = "<body><section><p>{0} of {1}</p><p>Told by our staff</p></section><div><p>Rare line</p></div></body>"
    rows = [(i, "http://a.example/x", page.format("Story", i)) for i in range(10)] + [(100 + i, "http://b.example/", page.format("Story", i)) for i in range(9)]
    rows += [(200 + i, "http://b.example/", page.format("Story", 0)) for i in range(5)] + [(300 + i, "http://c.example/", page.format("Story", i)) for i in range(10)] + [(400 + i, "http://c.example/", f"<p>Other page {i}</p>") for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows) and all(got[i] == f"Story of {i}" for i in range(10))
    assert got[100] == got[200] == "Story of 0\nTold by our staff\nRare line" and got[300] == "Story of 0\nTold by our staff\nRare line"
    assert html_extract.extract(pages.filter("false")).count() == 0


def test_html_counts_before_rules(spark):
    """Subtrees that rules would drop are hashed and counted too."""
    page = '<body><nav><p>Home</p></nav><article><p>Story number {0} is told here.</p></article><footer>All about us</footer></body>'
    found = html_extract.parsed(spark.createDataFrame([(i, "http://a.example/", page.format(i)) for i in range(12)], "page_id long, url string, html string")).cache()
    assert len(html_extract.templates(found).first()["gone"]) == 3


@pytest.mark.parametrize("said", ["jane@example{dot}com", "jane@example<dot>com", "jane@example[punkt]com", "jane@example(point)com", "jane@example [ . ] com", "jane{@}example.com", "jane{ at }example.com", "jane< at >example.com", "jane at example . com"])
def test_pii_disguise_alone(said):
    """A disguise is found whatever else the text holds."""
    for text in (f"Write to {said} today", f"Write to {said} today, room one, two, three, four"):
        found = pii.spans(text)[1]
        assert [s for s in found if s[0] == "email"] == [("email", 9, 9 + len(said))]


@pytest.mark.parametrize(
    "prose",
    [
        "The train leaves at 10.30 sharp", "We open at 9.15 and close at 17.30.", "It sells at price at 3.50", "look at example.com for more", "Visit us at example.com", "Contact us at example.com today",
        "We looked at it . Then we left", "see section 4 at page 3.2", "Meet @ 10.30 or at noon dot 5", "the e.g. at example.com case", "in 2019 at example.com", "one dot at the end. of it",
    ],
)
def test_prose_is_no_personal_data(prose):
    assert pii.spans(prose) == ([], [])
    assert pii.spans(f"{prose} and so on, [dot] it is") == ([], [])


@pytest.mark.parametrize(("said", "kind"), [("jane.doe at example.com", "email"), ("jane7 at example.com", "email"), ("janeDoe at mail.example.org", "email"), ("jane @ example.com", "email"), ("jane at example dot com", "email"), ("192 dot 168 dot 1 dot 1", "ip")])
def test_disguises_without_cue(said, kind):
    for text in (said, f"so {said} it is", f"über {said}, one, two, three, four"):
        base, found = pii.spans(text)
        assert not base and [(k, text[a:b]) for k, a, b in found if k == kind] == [(kind, said)]


def test_traced_offsets_are_brute_force():
    """Source spans by rewriting one character at a time with its sources beside it."""
    rng = random.Random(20)
    rules = [(re.compile("ab|c"), lambda m: "XYZ"[: rng.randrange(4)]), (re.compile("[XY]+"), lambda m: m[0].lower()), (re.compile("d."), lambda m: "")]
    for _ in range(500):
        text = "".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 30)))
        seen, cells = pii.Traced(text), [(c, i, i + 1) for i, c in enumerate(text)]
        for pattern, to in rules:
            made = []
            seen = seen.rewrite(pattern, lambda m, to=to, made=made: made.append(to(m)) or made[-1])
            out, done = [], 0
            for m, new in zip(list(pattern.finditer("".join(c for c, *_ in cells))), made, strict=True):
                a, b = m.span()
                out += cells[done:a] + (cells[a:b] if new == m[0] else [(c, cells[a][1], cells[b - 1][2]) for c in new])
                done = b
            cells = out + cells[done:]
        assert (seen.text, seen.starts, seen.ends) == ("".join(c for c, *_ in cells), [a for _, a, _ in cells], [b for *_, b in cells])


def test_pii_gate():
    """No text that the gate holds back is changed by a transducer."""
    rng = random.Random(14)
    parts = ["jane", " ", "at", "AT", "@", " at ", " dot ", ".", " . ", "[", "]", "{", "}", "<", ">", "(", ")", "dot", "punkt", "point", "example", "com", "one", "two ", "three-", "\u0430", "\u00ad", "\u017f", "\n"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert pii.suspicious(text) or pii.deobfuscated(text).text == text
