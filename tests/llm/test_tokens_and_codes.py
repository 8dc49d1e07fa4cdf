"""Vector codes, token alignment and decontamination against brute force, and their odd inputs."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm import decontaminate, token_align, vector_codes

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _compressed(rows, parts=4, entries=256, rounds=4):
    """(code, error, label_error, codebooks_sha256) of rows (vec_id, embedding, label), every distance taken."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in rows) // parts)
    x = np.zeros((len(rows), parts * width), dtype=np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r[1])] = np.clip(np.floor(np.array(r[1], dtype=np.float32).astype(float) * 1024), -(1 << 24), 1 << 24)
    x = x.reshape(len(rows), parts, width)
    by = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(np.float32(v)) for v in rows[i][1]]))[:entries]
    books = [x[by, p].copy() for p in range(parts)]

    def assign():
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        return [k.argmin(1) for k in d], sum(k.min(1) for k in d)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in set(codes[p].tolist()):
                own = x[codes[p] == e, p]
                books[p][e] = own.sum(0) // len(own)
    codes, error = assign()
    labels = Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        labels[r[2]] += e
    digest = sha(",".join(str(v) for b in books for v in b.ravel().tolist()))
    return sorted(((r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), labels[r[2]], digest) for i, r in enumerate(rows)), key=repr), books


def test_vector_codes(spark):
    rng = random.Random(2)
    make = lambda n: [rng.gauss(0, 0.2) for _ in range(n)]
    base = make(12)
    rows = [(i, make(12) if i % 3 else [v + rng.choice((0, 0.001)) for v in base], i % 4) for i in range(700)]
    rows += [(3, make(12), None), (3, make(12), None), (None, make(12), 1), (800, None, 1), (801, [0.1, None], 1), (802, [float("nan")] * 12, 1), (803, [float("inf")] * 12, 1), (804, [], 2), (805, make(7), 2), (806, [3e38, -3e38], None)]
    rows += [(900 + i, base, 9) for i in range(300)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, same string").repartition(3)
    want, _ = _compressed(rows)
    got = sorted((tuple(r) for r in vector_codes.compress(table).collect()), key=repr)
    assert got == want
    few = rows[:9]
    assert sorted((tuple(r) for r in vector_codes.compress(table.limit(0).union(spark.createDataFrame([(*r, "x", "y") for r in few], table.schema))).collect()), key=repr) == _compressed(few)[0]
    assert vector_codes.compress(table.filter("false")).count() == 0
    assert vector_codes.compress(table.filter("vec_id = 804")).first()["code"] == "00000000"


def test_orchard_passes_over_entries():
    rng = np.random.default_rng(3)
    centres = rng.integers(-5000, 5000, (32, 8))
    entries = (centres[:, None] + rng.integers(-20, 20, (32, 8, 8))).reshape(256, 8)
    entries[9] = entries[4]
    x = entries[rng.integers(0, 256, 3000)] + rng.integers(-9, 9, (3000, 8))
    found, d2, met = vector_codes.Codebook(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (found == d.argmin(1)).all() and (d2 == d.min(1)).all()
    assert met < 0.5 * d.size


def test_decoding_of_codes(spark):
    rows = [(i, [float(i % 7), 0.5, -1.0, 2.0], 0) for i in range(40)]
    table = vector_codes.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    book = vector_codes.codebooks(table)
    back = vector_codes.decode(vector_codes.encode(table, book), book).collect()
    assert sorted((r["vec_id"], r["embedding"]) for r in back) == [(r[0], r[1]) for r in rows]


def _hit(text, windows):
    """(words, hit words, items) by comparing every window at every place."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hit, items = set(), set()
    for win, names in windows.items():
        for i in range(len(ws) - len(win) + 1):
            if tuple(ws[i : i + len(win)]) == win:
                hit |= set(range(i, i + len(win)))
                items |= names
    return len(ws), len(hit), items


def test_decontamination(spark):
    rng = random.Random(5)
    say = lambda n, base=12: " ".join(rng.choice("the of and to in is on at by for as it".split()[:base]) for _ in range(n))
    items = [(i, say(rng.randrange(8, 30))) for i in range(30)] + [(40, "Short ONE"), (41, "x"), (42, None), (43, "..."), (44, "é漢 ẞ 9a"), (45, say(10)), (46, say(3)), (None, "no id has this item of theirs in it at all now"), (1, say(14))]
    items.append((47, items[0][1]))
    windows = {}
    for item, text in items:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for i in range(max(1, len(ws) - 9)) if ws else ():
            windows.setdefault(tuple(ws[i : i + 10]), set()).update([] if item is None else [str(item)])
    texts = [say(rng.randrange(0, 400)) for _ in range(60)] + [None, "", "?!", "x", "a short-one, x", "é漢\tẞ\n9A", "y " * 30_000 + items[3][1]]
    texts += [f"{say(5)}. {t}, {say(4)}" for _, t in items if t] + [" ".join(items[5][1].split()[:9]), "zz " + " ".join(items[6][1].upper().split()[-10:])]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", "y", 1), (None, "x", "x", "y", 1)], "doc_id long, text string, hits string, items string, n_words int").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, win string")
    want = []
    for i, t in [*enumerate(texts), (3, texts[3]), (None, "x")]:
        n, hit, found = _hit(t, windows)
        want.append((i, n, hit, len(found), sha(",".join(sorted(found))), hit > 0))
    got = [tuple(r) for r in decontaminate.report(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    small = decontaminate.find(docs, bench, block_bytes=2_000).collect()
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in small), key=repr) == sorted((w[:4] for w in want), key=repr)
    assert all(a["end"] < b["start"] for r in small for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    none = decontaminate.report(docs, bench.filter("false"))
    assert none.count() == len(want) and none.filter("contaminated or n_items > 0").count() == 0
    assert decontaminate.report(docs.filter("false"), bench).count() == 0


def _aligned(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    alphabet, vocab = token_align.byte_alphabet(), {i: s for s, i in a.get_vocab().items()}
    rows, docs_of = [], Counter()
    for t in texts:
        raw = f" {t}".encode()
        ids = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        parts = [bytes(alphabet[c] for c in vocab[i]) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(p) != raw for p in parts):
            ids, parts = ([], []), ([], [])
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        spans = [list(zip([0, *e], e, strict=False)) for e in ends]
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e] if len(raw) < 3000 else None
        common = sorted(set(ends[0]) & set(ends[1]))
        shown = []
        for s, e in zip([0, *common], common, strict=False):
            shown.append("|".join(",".join(str(i) for i, (u, v) in zip(ids[k], spans[k], strict=True) if s <= u and v <= e) for k in (0, 1)))
        docs_of.update(set(links))
        rows.append((ids, links, len(common), ";".join(shown)))
    best = Counter()
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    return [(len(ids[0]), len(ids[1]), g, len(links), sum(docs_of[p] == best[p[0]] for p in links), sum(docs_of[p] for p in links), sha(shown) if shown else "") for ids, links, g, shown in rows]


def test_token_alignment(spark):
    rng = random.Random(6)
    letters = "abcdefghij eé漢😀 \n\t.,'’0123ΩЖ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    texts += [None, "", " ", "  two  spaces ", "a▁b", "<|endoftext|> <s> </s> <0x41>", "x" * 900, "\u0000\u0085　", "The quick brown fox jumps over the lazy dog.", "\r\n\r\n", "é ﬁ"]
    rows = [(i, t, "p", 1) for i, t in enumerate(texts)] + [(5, texts[5], "p", 1), (None, texts[6], "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    want = _aligned([r[1] for r in rows])
    want = sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=repr)
    for pairs in (token_align.BLOCK_PAIRS, 300):
        got = token_align.aligned(docs, BYTE, PIECE, public_tokenizers.PATTERN, pairs)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert token_align.aligned(docs.filter("false"), BYTE, PIECE, public_tokenizers.PATTERN).count() == 0
    shown = token_align.groups(docs.filter("doc_id = 8"), BYTE, PIECE, public_tokenizers.PATTERN, hashed=False).first()["groups"]
    assert sha(shown) == next(w[-1] for w in want if w[0] == 8)


@pytest.mark.parametrize("piece", [1, 2, 7, 512])
def test_merge_path(piece):
    rng = random.Random(piece)
    for n in (1, 2, 5, 40, 900):
        last = 3 * n
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), n), last})) for _ in range(2))
        i, j, group = token_align.merge_path(a, b, piece)
        cuts, common = sorted({*a.tolist(), *b.tolist()}), sorted({*a.tolist()} & {*b.tolist()})
        assert i.tolist() == [int(np.searchsorted(a, c)) for c in cuts] and j.tolist() == [int(np.searchsorted(b, c)) for c in cuts]
        assert group.tolist() == [int(np.searchsorted(common, c)) for c in cuts]


def test_ranks_are_the_merges():
    """Ids ascend in merge order and each entry merges to itself, so that ranks give what the listed merges give."""
    with open(BYTE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    at = {m: i for i, m in enumerate(merges)}
    assert all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
    for entry in model["vocab"]:
        s = list(entry)
        while len(s) > 1 and entry != "<|endoftext|>":
            rank, i = min((at.get((s[i], s[i + 1]), len(at)), i) for i in range(len(s) - 1))
            assert rank < len(at), entry
            s[i : i + 2] = [s[i] + s[i + 1]]


def test_long_texts_encode_alike():
    tokens, full = token_align.ByteTokens(BYTE, public_tokenizers.PATTERN), Tokenizer.from_file(BYTE)
    for text in (" " * 400_000 + "a", "\n" * 200_000, "ab" * 200_000, "漢\u0085 a1 ﬁ" * 500):
        assert tokens.encode(text) == full.encode(text, add_special_tokens=False).ids
