"""The registered queries on the smallest tables: every column of the contracts against brute force or exact round trips."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pandas as pd
import pytest

from strandfold.llm import chat, decontaminate, entries


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return {r["doc_id"]: r for r in rows}


def rows_of(query, spark, sf, *columns):
    df = query(spark, sf)
    assert df.columns[: len(columns)] == list(columns)
    return df.collect()


def test_every_query_is_registered():
    names = ["pipeline", *(f"op{i}_" for i in range(1, 14))]
    assert [n for n in names if not any(q.startswith(n) for q in entries.queries())] == []


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in entries.oracle_sql().items():
        df = entries.queries()[name](spark, sf)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall()), name


def test_op1(spark, sf, docs):
    got = rows_of(entries.op1_pii, spark, sf, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        own = brute.pii(docs[r["doc_id"]]["text"] or "")
        counts = Counter(k for k, _, _ in own)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [counts[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == brute.sha(brute.said(own)) and r["spans"].startswith(brute.said(own))


def test_op2(spark, sf, docs):
    got = rows_of(entries.op2_secrets, spark, sf, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        own = brute.secrets(docs[r["doc_id"]]["text"] or "")
        counts = Counter(k for k, _, _ in own)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [counts[k] for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == brute.sha(brute.said(own)) and set(brute.said(own).split(",")) <= set(r["spans"].split(","))


def leaks(docs, items, least=0.8):
    """{(doc, item): best similarity} over all windows; pairs that share too few shingles anywhere are skipped exactly."""

    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else []

    out, own_of = {}, {d: shingles(t) for d, t in docs.items()}
    for i, text in items.items():
        theirs = Counter(shingles(text))
        m = sum(theirs.values())
        for d, own in own_of.items():
            w = min(len(own), m)
            if w and sum(s in theirs for s in own) >= least / (1 + least) * (w + m) - 1e-9:
                best = max(decontaminate.weighted_similarity(Counter(own[x : x + w]), theirs) for x in range(len(own) - w + 1))
                if best >= least:
                    out[d, i] = best
    return out


def test_op3(spark, sf, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = leaks({d: r["text"] for d, r in docs.items()}, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows_of(entries.op3_decontaminate, spark, sf, "doc_id", "item_id", "similarity")}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_op4(spark, sf, docs):
    got = rows_of(entries.op4_language, spark, sf, "doc_id", "held_out", "lang_pred", "score")
    langs = {r["lang"] for r in docs.values()} - {None}
    right = tried = 0
    for r in got:
        own = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        has = any(c.isalpha() for c in own["text"] or "")
        assert r["lang_pred"] in langs if has else r["lang_pred"] == "und"
        if r["held_out"] and has and own["lang"]:
            tried += 1
            right += r["lang_pred"] == own["lang"]
    assert len(got) == len(docs) and right >= 0.95 * tried > 20


def test_op5(spark, sf, docs):
    got = rows_of(entries.op5_shards, spark, sf, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots, sizes, places = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        places[data].add(r["shard"])
    assert all(0 <= s < 16 and sorted(x) == list(range(len(x))) for s, x in slots.items())
    # No shard is off its share by more than one text at either end; copies are split by a splitter only.
    share, longest = sum(sizes.values()) / 16, max(r["size"] for r in got)
    assert all(abs(sizes[s] - share) <= longest for s in range(16)) and sum(len(x) - 1 for x in places.values()) <= 15


def test_op6(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids.tolist()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = pd.DataFrame([r.asDict() for r in rows_of(entries.op6_neighbours, spark, sf, "query_id", "rank", "vec_id", "score")])
    hit = 0
    for q in ids[ids % 50 == 0].tolist():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (own.score.diff().dropna() <= 0).all()
        assert np.abs(s[np.searchsorted(ids, own.vec_id)] - own.score).max() < 1e-12
        hit += len(set(own.vec_id) & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert hit >= 0.9 * len(got) and len(got) == 5 * (ids % 50 == 0).sum()


def test_op7(spark, sf, docs):
    prints = {d: brute.fingerprint(r["text"] or "") for d, r in docs.items()}
    want = brute.components(prints)
    got = rows_of(entries.op7_simhash, spark, sf, "doc_id", "fingerprint", "component_id")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def check_pieces(pieces, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(entries.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts.items()}
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert by.keys() == ids.keys()
    for d, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["ids_crc32"] == zlib.crc32(ids[d][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


def test_op8(spark, sf, docs):
    got = rows_of(entries.op8_packing, spark, sf, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    check_pieces(got, {d: r["text"] for d, r in docs.items()})


def test_op9(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    by = defaultdict(list)
    for c, *rest in sorted(rows):
        by[c].append(rest)
    got = rows_of(entries.op9_chat, spark, sf, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    assert sorted(r["conv_id"] for r in got) == sorted(by)
    for r in got:
        own = by[r["conv_id"]]
        loss = "".join(x for _, a, x in own if a == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), brute.sha("".join(f"{a}\n{x}\n" for _, a, x in own)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert r["formatted_chars"] >= sum(len(a) + len(x) for _, a, x in own[:1]) + len(chat.TURN + chat.ROLE + chat.END)


def test_op10(spark, sf, docs):
    ids = sorted(docs)
    data = [(docs[d]["text"] or "").encode() for d in ids]
    masks = dict(zip(ids, brute.repeats(data, 200), strict=True))
    got = rows_of(entries.op10_repeats, spark, sf, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(r["doc_id"] for r in got) == ids
    for r in got:
        own, mask = np.frombuffer((docs[r["doc_id"]]["text"] or "").encode(), np.uint8), masks[r["doc_id"]]
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(own), mask.sum(), spans)
        assert r["kept_sha256"] == hashlib.sha256(own[~mask].tobytes()).hexdigest()


def test_pipeline_stages(spark, sf, docs):
    """Each stage on what its predecessor kept, against brute force."""
    import corpus_pipeline
    from test_operators import _near_groups

    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["language"](spark, start, sf).collect()
    assert {r["doc_id"] for r in kept} <= {d for d, r in docs.items() if any(c.isalpha() for c in r["text"] or "")} and len(kept) > 0.9 * len(docs)
    assert all(r == docs[r["doc_id"]] for r in kept)
    kept.sort(key=lambda r: r["doc_id"])
    groups = _near_groups([r["text"] for r in kept])
    want = [r for i, r in enumerate(kept) if groups[i] == i]
    frame = lambda rows: spark.createDataFrame(rows, start.schema)
    unlike = stages["near_duplicates"](spark, frame(kept), sf).collect()
    assert sorted(unlike) == sorted(want)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    leaking = {d for d, _ in leaks({r["doc_id"]: r["text"] for r in unlike}, items)}
    clean = stages["decontamination"](spark, frame(unlike), sf).collect()
    assert leaking and sorted(clean) == sorted(r for r in unlike if r["doc_id"] not in leaking)
    private = {r["doc_id"]: r for r in stages["personal_data"](spark, frame(clean), sf).collect()}
    assert private.keys() == {r["doc_id"] for r in clean}
    for r in clean:
        own = private[r["doc_id"]]
        found = brute.pii(r["text"] or "")
        assert not any(r["text"][a:b] in own["text"] for k, a, b in found if k == "email") and (own["lang"], own["source"]) == (r["lang"], r["source"])
        assert found or own["text"] == r["text"] or own["n_chars"] == len(own["text"])
    check_pieces(stages["packing"](spark, frame(list(private.values())), sf).collect(), {d: r["text"] for d, r in private.items()})
