"""The external induced sort against plain sorting and plain search."""

import random
from collections import defaultdict

import brute
import numpy as np
import pytest

from strandfold.llm import induced, repeats


def symbols(pieces):
    return np.frombuffer(b"".join(bytes(x + induced.FIRST_BYTE for x in p) + b"\x01" for p in pieces) + b"\x00", np.uint8).copy()


@pytest.mark.parametrize("direct,in_memory", [(0, 96 << 20), (0, 0), (1 << 19, 96 << 20)])
def test_orders_and_windows(monkeypatch, direct, in_memory):
    monkeypatch.setattr(induced, "DIRECT", direct)
    monkeypatch.setattr(induced, "IN_MEMORY", in_memory)
    rng = random.Random(direct + in_memory)
    for turn in range(120):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", b"a", bytes(range(97, 123))])
        pieces = [bytes(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randint(0, 20)):
            p, q = rng.choice(pieces), rng.choice(pieces)
            pieces.append(p[rng.randint(0, len(p) - 1) :] + q[: rng.randint(1, len(q))])
        if turn % 3 == 0:
            pieces = [p * rng.randint(1, 4) for p in pieces]
        data, size = symbols(pieces), rng.choice([1, 3, 5, 8, 17, 40])
        order = induced._suffix_order(data.astype(np.int32), int(data.max()) + 1)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tobytes())
        starts = defaultdict(list)
        for i in range(len(data) - size + 1):
            if not (data[i : i + size] < induced.FIRST_BYTE).any():
                starts[data[i : i + size].tobytes()].append(i)
        got = induced.repeated_windows(data, size)
        assert all(bool(got[i]) == (len(found) > 1) for found in starts.values() for i in found)


@pytest.mark.parametrize("hot", [5000, 3])
def test_hot_passages(spark, hot):
    """One passage in most texts, surroundings of their own, copies, a long run of one letter, texts split among shards."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(60), prose(25)
    texts = [f"{prose(rng.randint(0, 30))} {passage[: rng.randint(150, len(passage))]} {prose(20)}" for _ in range(60)]
    texts += [line] * 40 + [f"{line}\n{line}\n{prose(5)}"] * 3 + ["x" * 700, "y" * 210, "z" * 200, "", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    data = [(t or "").encode() for t in texts]
    want = brute.repeats(data, 200)
    texts_of = df.selectExpr("xxhash64(coalesce(text, '')) as h", "hash(coalesce(text, '')) as h2", "coalesce(text, '') as text", "doc_id")
    found = repeats.find_repeats(texts_of.drop("doc_id"), 200, hot).collect()
    by = defaultdict(list)
    for r in found:
        by[r["h"], r["h2"]].append((r["start"], r["end"]))
    for r in texts_of.collect():
        mask = np.zeros(len(data[r["doc_id"]]), bool)
        for a, b in by[r["h"], r["h2"]]:
            mask[a:b] = True
        assert (mask == want[r["doc_id"]]).all()
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df).collect()}
    assert kept == {i: np.frombuffer(data[i], np.uint8)[~want[i]].tobytes() for i in range(len(data))}


def test_shards_of_whole_grams():
    import pyarrow as pa

    rng = random.Random(3)
    piece = lambda: bytes(rng.choices(b"abcd", k=rng.randint(20, 40)))
    bases = [piece() for _ in range(20)]
    rows = [(g, g, i, 5, p) for g, x in enumerate(bases) for i, p in enumerate([x, x[3:] + b"z", piece()])]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["gram", "h", "h2", "first", "bytes"])
    outs = []
    for most in (1, 100, 1 << 20):

        class Frame:
            def repartition(self, _):
                return self

            def sortWithinPartitions(self, _):
                return self

            def mapInArrow(self, work, _):
                return [r for size in (1, 7, 100) for b in [list(work(iter(table.to_batches(size))))] for r in [sorted(x for o in b for x in zip(*o.to_pydict().values(), strict=True))]]

        outs += repeats._compare(Frame(), 12, most)
    assert all(o == outs[0] for o in outs) and len(outs[0]) >= 40
