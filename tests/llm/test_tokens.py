import random
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import packing, tokenizer
from tidemark.session import table

ALPHABET = " \t\n\r　 a'sItreb9。，é中文ö!?-_.0x \x1c😀"


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.ForcedBoundaryEncoder(tokenizer.read_ranks("byte_bpe_50k"))


def test_cut_anywhere_it_is_certain(encoder, monkeypatch):
    monkeypatch.setattr(tokenizer, "FRAGMENT", 1)
    rnd = random.Random(1)
    for _ in range(4000):
        t = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 16)))
        assert encoder.encode(t) == encoder.whole.encode_ordinary(t), repr(t)


def test_texts_in_one_batch_with_nulls_and_very_long(encoder):
    texts = ["", None, "a", "ab " * 50_000, "。" * 3000, None, "it's <|endoftext|>", "x" * 30_000]
    ids, offsets = encoder.encode_array(pa.array(texts))
    for i, t in enumerate(texts):
        got = ids[offsets[i] : offsets[i + 1]].tolist()
        assert got == encoder.whole.encode_ordinary(t or "")
        assert encoder.whole.decode(got) == (t or "")
    assert encoder.encode_array(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0, 0]


def test_query_equals_the_whole_tokenizer(spark, small, encoder):
    from tidemark.llm.queries import p8_ids

    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    got = {r.doc_id: r.ids for r in p8_ids(spark, small).collect()}
    assert got == {k: encoder.whole.encode_ordinary(t or "") for k, t in texts.items()}


def test_second_library_agrees(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Grüße, 世界! it's 12 <|endoftext|>  x", "\n\n a"):
        assert t.encode(text, add_special_tokens=False).ids == encoder.encode(text)


def test_packing_holds_every_item_once_within_capacity():
    rnd = np.random.default_rng(3)
    for n, capacity in [(0, 10), (1, 10), (5000, 1000), (3000, 64)]:
        items = np.minimum(rnd.lognormal(5, 1.2, n).astype(np.int64), capacity)
        items[: n // 10] = capacity // 2
        at, bins = packing.pack(items, capacity)
        load = np.bincount(at, weights=items, minlength=bins)
        assert len(at) == n and (n == 0 or load.max() <= capacity)
        assert bins <= 1.06 * max(-(-items.sum() // capacity), (items > capacity / 2).sum()) + 1


def test_documents_in_containers(spark):
    rows = [(1, "word " * 700), (2, ""), (3, None), (4, "a b c"), (4, "a b c"), (None, "x"), *[(i, "tok " * (i % 90)) for i in range(10, 200)]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, shard int")
    budgets = spark.createDataFrame([("s", 64, "byte_bpe_50k"), ("l", 256, "byte_bpe_50k"), ("bad", 0, "byte_bpe_50k")], "tier string, capacity_tokens int, tokenizer string")
    got = packing.pack_documents(docs, budgets, "doc_id", "text", shard_items=60).collect()
    assert {r.tier for r in got} == {"s", "l"}
    load, parts = {}, {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.tokens
        parts.setdefault((r.tier, r.doc_id), []).append(r)
        assert r.container.startswith(r.tier)
    cap = {r.container: r.capacity for r in got}
    assert all(v <= cap[k] for k, v in load.items())
    assert len(parts["s", 4]) == 2 and len(parts["s", 3]) == 1 and ("s", None) not in parts
    assert sorted(r.part for r in parts["l", 1]) == [0, 1, 2] and sum(r.tokens for r in parts["l", 1]) == sum(r.tokens for r in parts["s", 1])
    assert all(len(v) == 1 for (t, d), v in parts.items() if d not in (1, 4) and sum(r.tokens for r in v) <= {"s": 64, "l": 256}[t])
    empty = packing.pack_documents(docs.limit(0), budgets, "doc_id", "text")
    assert empty.count() == 0 and packing.fill(empty).count() == 0


def test_linear_program_over_all_configurations():
    rnd = random.Random(6)
    for _ in range(60):
        capacity = rnd.choice([40, 100, 1000])
        sizes = sorted({rnd.randint(capacity // 4 + 1, capacity) for _ in range(rnd.randint(1, 7))}, reverse=True)
        demand = np.array([rnd.randint(1, 9) for _ in sizes], dtype=float)
        columns = packing.configurations(sizes, capacity)
        every = {c for n in (1, 2, 3) for c in combinations_with_replacement(range(len(sizes)), n) if sum(sizes[k] for k in c) <= capacity}
        assert len(columns) == len(every) and (columns @ np.array(sizes) <= capacity).all()
        used = packing.fewest(columns, demand)
        assert np.allclose(sum(times * config for config, times in used), demand, atol=1e-6)
        # optimal: prices of the sizes under which no configuration is worth more than its container, and all uses are paid
        least = sum(times for _, times in used)
        price = np.linalg.solve(np.array([config for config, _ in used], dtype=float), np.ones(len(sizes)))
        assert (columns @ price <= 1 + 1e-6).all() and abs(price @ demand - least) < 1e-5
