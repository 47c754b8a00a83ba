"""Best-fit packing, ranked search and alignment: small cases by hand, and the registered queries against brute force."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import Row

from strandfold.llm import align, bestfit, entries, pii, repeats, search, secrets

DOCS = "doc_id long, text string, term string, n long, length long, uid long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "x", 1, 2, 3) for i, t in enumerate(texts)], DOCS)


# Packing.


def simulated(sizes, capacity):
    """Sequences that the same rules need, piece by piece."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    free = []
    while large:
        a = large.pop(0)
        i = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        free.append(capacity - a - (large.pop(i) if i is not None else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


def test_plan_is_the_rules_piece_by_piece():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([6, 30, 100])
        kinds = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
        sizes = [rng.choice(kinds) for _ in range(rng.randint(1, 80))]
        segments, n = bestfit.plan(dict(Counter(sizes)), capacity)
        used, ranks = [[] for _ in range(n)], defaultdict(list)
        for size, first, many, at, each, offset in segments:
            ranks[size] += range(first, first + many)
            for j in range(many):
                used[at + j // each].append((offset + j % each * size, size))
        assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(c)) for s, c in Counter(sizes).items()}
        for own in used:
            end = 0
            for offset, size in sorted(own):
                assert offset == end
                end += size
            assert 0 < end <= capacity and sum(3 * s > capacity for _, s in own) <= 2
        assert sorted(capacity - sum(s for _, s in own) for own in used) == simulated(sizes, capacity)


WORD_TEXTS = [None, "", "  ", "Hello, World! it's 12½ o'clock", "ÀÉÎ ÷ ß µª", "a b c", "x<|endoftext|>y", "é Σας ΟΔΟΣ", "日本語 text", "a" * 300 + "'ll", "tab\tnew\nline\r\n", "don't DON'T 'S", "\x1codd\x85"]


def test_ids_are_the_tokenizer_s():
    from tokenizers import Tokenizer

    path = entries.tokenizer_path("word_bpe_49k.json")
    want = Tokenizer.from_file(path)
    for texts in (WORD_TEXTS, WORD_TEXTS):
        for t, ids in zip(texts, bestfit.encode([x or "" for x in texts], path, 0), strict=True):
            assert list(memoryview(ids).cast("I")) == [*want.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing(spark):
    path = entries.tokenizer_path("word_bpe_49k.json")
    texts = [*WORD_TEXTS, *["one two three"] * 40, "word " * 5000, "", "b " * 63]
    df = docs_of(spark, texts).union(docs_of(spark, ["again", "again"], 3)).union(spark.createDataFrame([(None, "no key", "", 1, 2, 3)], DOCS))
    rows = bestfit.pack_best_fit(df.repartition(3), path, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] and r["start"] == 64 * r["piece"]
    for own in by_sequence.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    got = Counter()
    for k, own in by_doc.items():
        for r in own:
            got[k, r["piece"], bytes(r["ids"])] += 1
    want = Counter()
    for r in df.collect():
        (ids,) = bestfit.encode([r["text"] or ""], path, 0)
        want.update((r["doc_id"], i, ids[at : at + 256]) for i, at in enumerate(range(0, len(ids), 256)))
    assert got == want
    assert bestfit.pack_best_fit(df.limit(0), path).collect() == []


def test_op11(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entries.op11_bestfit(spark, sf).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entries.tokenizer_path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in docs.items()}
    want = {(k, i): (at, len(v[at : at + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in v[at : at + 2048]))) for k, v in ids.items() for i, at in enumerate(range(0, len(v), 2048))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    room = Counter()
    for r in rows:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048 and len(room) == len(simulated([r["length"] for r in rows], 2048))


# Search.


def scored(docs, text):
    """{row: score} of a query by the formula."""
    lower = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
    counts = [Counter(lower(t)) for t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for i, c in enumerate(counts):
        m = 75 + 25 * sum(c.values()) * n_docs // n_terms if c else 0
        for t in lower(text):
            if t in c:
                out[i] += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
    return {i: s for i, s in out.items() if s > 0}


@pytest.mark.parametrize(("k", "shard_rows", "block"), [(20, 8192, 1 << 20), (3, 7, 1), (1, 1, 200)])
def test_search(spark, k, shard_rows, block):
    rng = random.Random(3)
    words = ["Alpha", "beta", "ÉTÉ", "été", "x1", "the", "of", "日本"]
    texts = [None, "", "...", *(" ".join(rng.choices(words, [1, 3, 1, 1, 2, 30, 9, 1], k=rng.choice([1, 3, 40]))) for _ in range(120)), *["the beta beta"] * 30]
    ids = [*range(len(texts) - 2), 5, None]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n long, item long")
    items = [(0, "the ALPHA of beta"), (1, None), (1, "été été missing"), (None, "x1 x1 日本"), (2, "..."), (3, "the")]
    got = search.search(docs.repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=k, shard_rows=shard_rows, block_bytes=block).collect()
    want = []
    for item, text in items:
        own = scored(texts, text)
        first = sorted(own, key=lambda i: (-own[i], ids[i] is None, ids[i] or 0))[:k]
        want += [(item, rank + 1, ids[i], own[i]) for rank, i in enumerate(first)]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark, ["a b"]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs_of(spark, [None, ""]), items).collect() == []
    assert search.search(docs, items).collect() == [Row(item_id=1, rank=1, doc_id=0, score=scored(["a b"], "a")[0])]


# Alignment.


def token_bytes():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(entries.tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=entries.tokenizer_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    return a, b, align._token_bytes_a(entries.tokenizer_path()), align._token_bytes_b(entries.tokenizer_path("piece_bpe_32k.model"))


def aligned_by_force(texts):
    a_model, b_model, a_bytes, b_bytes = token_bytes()
    out, holders = [], Counter()
    for t in texts:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
            a, b = [], []
        spans = []
        for ids, own in ((a, a_bytes), (b, b_bytes)):
            at, s = 0, []
            for x in ids:
                s.append((at, at + len(own[x]), x))
                at += len(own[x])
            spans.append(s)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for _, e, x in spans[side]:
                groups[bisect_left(cuts, e)][side].append(str(x))
        links, i = [], 0
        for s, e, x in spans[0]:
            while i < len(spans[1]) and spans[1][i][1] <= s:
                i += 1
            j = i
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((x, spans[1][j][2]))
                j += 1
        out.append((len(a), len(b), ["|".join(",".join(side) for side in g) for g in groups], links))
        holders.update(set(links))
    most = Counter()
    for (x, y), n in holders.items():
        most[x] = max(most[x], n)
    return [(na, nb, len(g), len(k), sum(holders[p] == most[p[0]] for p in k), sum(holders[p] for p in k), ";".join(g)) for na, nb, g, k in out]


SPACED = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "foo\n bar", "foo\n  bar", "x\ty", "naïve café's — déjà", "日本語 テキスト", "<s> </s> <|endoftext|> [INST]", "a▁b", "ok ▁", "\x00\x01 z", "tab\t b", "😀 😀", "a b  c", "\x1c x\x85 y", "aaaa" * 100, "the the the cat", "the cat"]


def test_alignment(spark):
    texts = [*SPACED, *["the cat sat"] * 20]
    df = docs_of(spark, texts).union(spark.createDataFrame([(None, "the", "", 1, 2, 3), (4, "cat", "", 1, 2, 3)], DOCS))
    rows = [r.asDict() for r in df.collect()]
    want = sorted((r["doc_id"] is None, r["doc_id"], *x) for r, x in zip(rows, aligned_by_force([r["text"] for r in rows]), strict=True))
    a, b = entries.tokenizer_path(), entries.tokenizer_path("piece_bpe_32k.model")
    for options in ({}, {"most": 1}, {"most": 3, "chars": 1}):
        got = align.align(df.repartition(3), a, b, **options).collect()
        assert sorted((r["doc_id"] is None, *(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))) for r in got) == want
    assert align.align(df.limit(0), a, b).collect() == []


def test_op13(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: x for r, x in zip(rows, aligned_by_force([r["text"] for r in rows]), strict=True)}
    got = entries.op13_alignment(spark, sf).collect()
    assert len(got) == len(want) and got[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for r in got:
        *sizes, groups = want[r["doc_id"]]
        assert list(r[1:7]) == sizes and r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


# Repeats.

# Two texts of 200 letters that differ in 63 of them, chosen so that the polynomial hashes of the whole and of
# their minimizer, which both hold, are equal.
COLLIDING = (
    "cxbdgjmowrrxvqcbxfbjhrurwtrrbrdgeswcwzvaxzxsmdshmccxceytvurfssbzjncambwpijcdstnsatzyjmkwqzbtuujofctupmzvijxbonghhmikyuhcdxkjswiycyvapqukwjtzizjuhqxuelqdhshhmhnkpvybsygavpqhdmecyzbcjafvzltyxrcrswrqvath",
    "cxcdgumqwebxaqcwxfbjhaurwhrryodreksuhlahxfxsmdshztwxzwgeyuzfsxbzjntzmbwpijcdstnsatzyjmkwqzbtuujofctupmzvijxbonghhmikyuhcdxkjswiycyvauqykwjtaizxchqxualedhchhxhnkeqfbayiejphpdmeuytbcjpfvaltzpmcaszrankah",
)


def test_texts_of_equal_hashes_are_kept_whole(spark):
    data = [np.frombuffer(t.encode(), np.uint8) for t in COLLIDING]
    sums = [repeats._sums(x)[0][200] for x in data]
    runs = [repeats.runs_of(x, np.array([0, 200]), 200) for x in data]
    assert sums[0] == sums[1] and runs[0][4] == runs[1][4] and runs[0][5] != runs[1][5]
    for texts in (COLLIDING, [f"{i}{t}" for i, t in enumerate(COLLIDING)]):
        out = repeats.remove_repeats(docs_of(spark, texts)).collect()
        assert sorted(bytes(r["kept"]).decode() for r in out) == sorted(texts) and all(not r["removed"] for r in out)
    out = repeats.remove_repeats(docs_of(spark, [*COLLIDING, COLLIDING[0]])).collect()
    assert Counter(bytes(r["kept"]).decode() for r in out) == Counter(["", "", COLLIDING[1]])


def test_ties_of_grams_do_not_depend_on_the_length_of_a_text():
    rng = random.Random(3)
    window = "".join(rng.choices("ab", k=200)).encode()
    alone = repeats.runs_of(np.frombuffer(window, np.uint8), np.array([0, 200]), 200)
    for before in (0, 5, 70_000, 3_000_000):
        text = bytes(rng.choices(b"abc ", k=before)) + window + b"zz"
        text_, first, last, at, gram, _ = repeats.runs_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200)
        own = np.flatnonzero((first <= before) & (before <= last))[0]
        assert at[own] - before == alone[3][0] and gram[own] == alone[4][0]


def test_added_spans_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te"]) for _ in range(rng.randint(2, 3)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(60)]
    for i in range(60):
        who = f"who{i % 45}@mail.example.com"
        said = f"{word()} Oddname{i % 45} {word()} {who} lonely{i} {word()}, kalolo{i}x "
        texts.append(" ".join(word() for _ in range(20)) + " " + said + " ".join(word() for _ in range(rng.randint(0, 30))))
    texts += [texts[70], texts[71], "", "Oddname3 elsewhere", texts[64].replace("@mail", "@other")]
    want = brute.disclosing(texts)
    assert {k for k, _ in want.values()} == {"generalise", "remove"} and any(len(x) > 3 and x != "[TERM]" for _, x in want.values())
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        text = r["text"] or ""
        base = brute.pii(text)
        assert [tuple(s) for s in r["pii"] if s["kind"] in pii.BASE] == base
        extra = [(want[m[0].lower()], m.start(), m.end()) for m in re.finditer(r"[^\W_]{3,}", text) if m[0].lower() in want and not any(m.start() < b and a < m.end() for _, a, b in base)]
        assert sorted(tuple(s) for s in r["pii"] if s["kind"] in pii.ADDED) == sorted((k, a, b) for (k, _), a, b in extra)
        clean = text
        for label, a, b in sorted([(label, a, b) for (_, label), a, b in extra] + [(f"[{k.upper()}]", a, b) for k, a, b in base], key=lambda x: -x[1]):
            clean = clean[:a] + label + clean[b:]
        assert (r["sanitised"] or "") == clean


def test_secrets_need_a_key_inside():
    der = lambda tag, *parts: (b := b"".join(parts)) is not None and bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x82" + len(b).to_bytes(2, "big")) + b
    rsa_id = bytes.fromhex("06092a864886f70d010101")
    number = lambda size, last: der(2, b"\x7b" * (size - 1) + bytes([last]))
    rsa = der(0x30, b"\x02\x01\x00", number(64, 0xFB), b"\x02\x03\x01\x00\x01", *(number(32, i) for i in range(6)))
    sealed = lambda inner, name=rsa_id: der(0x30, b"\x02\x01\x00", der(0x30, name, b"\x05\x00"), der(4, inner))
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    kinds = lambda text: [k for *_, k in secrets.scan(text) if k not in secrets.BASE]
    for no_key in (sealed(b""), sealed(b"it was a dark and stormy night out there"), der(0x30, b"\x02\x01\x00", *(der(2, b"\x00" * 40),) * 8)):
        assert kinds(f"a {base64.b64encode(no_key).decode()} b") == [] == kinds(f"a {no_key.hex()} b")
    assert kinds(f"{head}.zz.q") == []
    ec = der(0x30, b"\x02\x01\x01", der(4, b"k" * 32))
    for key in (rsa, sealed(rsa), ec, sealed(ec, bytes.fromhex("06072a8648ce3d0201"))):
        for code in (base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode(), key.hex(), key.hex().upper()):
            for width in (28, 64, 10**6):
                lines = [code[i : i + width] for i in range(0, len(code), width)]
                if len(lines[0]) < 16:
                    continue
                for joint in ("\n", "\n> ", '"\n"', '\\n" +\n  "', "\\n", "\r\n\t"):
                    body = joint.join(lines)
                    found = [s for s in secrets.scan(f"so '{body}'\nand more") if s[2] not in secrets.BASE]
                    assert found == [(4, 4 + len(body), "der")], (width, joint)
    blank = base64.urlsafe_b64encode(b' {"alg":"HS256"}').decode().rstrip("=")
    assert kinds(f"{blank}.eyJzdWIiOjF9.c2ln") == ["jwt"]
    # Many keys cut short in one text: each reads only what it announces.
    cut = base64.b64encode(b"openssh-key-v1\x00" + b"\x00\x00\x00\x04none" * 2 + b"\x00\x00\x00\x00\x00\x00\x00\x01\x00\x00\x00\x08").decode()
    started = time.perf_counter()
    assert kinds((cut + "\n") * 20000) == [] and time.perf_counter() - started < 20
