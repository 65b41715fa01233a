import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpuslens.llm import windows
from llm_support import LONG, documents, hard_docs, hard_rows
from tokenizers import Tokenizer

PATH = public_tokenizers.path(windows.TOKENIZER)
NASTY = [
    None, "", " ", "don't DON'T we'll x''s .'s '5 5' a'b", "foo,bar.baz!!;qux 3.14 1a2b", "É é İ İ É", "a b c　d", "<|endoftext|> A<|startoftext|>b C",
    "<|ENDOFTEXT|> <| |>", "tab\tnew\nline\x0bvt\x0cff\rcr", "ünï cödé 😀 ßtraße ΣΑΣ", "__init__ a_b c-d e@f.g", "''' 's 'S", "x" * 5000, "1234567890" * 50, "!?" * 2000, "日本語テキスト abc",
    "́lead a ́b", "á, b̈.", "it's,he'd;they're",
]


def plain(text, model):
    return model.encode(text or "", add_special_tokens=False).ids + [1]


def covered(plan, counts):
    """Every piece's tokens lie in exactly one place; windows have no holes. Returns the windows' sizes."""
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(c) for c in counts.values()])
    parts, held = {}, {}
    for piece, start, size, window, offset in zip(*(a.tolist() for a in windows.places(plan.arrays(), length, rank))):
        parts.setdefault(piece, []).append((start, size))
        held.setdefault(window, []).append((offset, size))
    for members in [*parts.values(), *held.values()]:
        at = 0
        for begin, size in sorted(members):
            assert begin == at and size > 0
            at += size
    assert all(sum(s for _, s in parts[k]) == n for k, n in enumerate(length.tolist()))
    assert sorted(held) == list(range(plan.windows))
    return [sum(s for _, s in m) for m in held.values()]


def test_combinations_are_all():
    lengths = [1, 2, 3, 5, 6, 7, 8, 11, 13, 15, 16]
    want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths, k) if sum(c) == 16}
    found = windows.combinations(lengths, 16, 3)
    assert {tuple(sorted(c, reverse=True)) for c in found} == want and len(found) == len(want)
    assert all(len(c) <= 2 for c in windows.combinations(lengths, 16, 2))


def test_least_squares():
    rng = random.Random(3)
    for _ in range(20):
        counts = {n: rng.randint(0, 60) for n in rng.sample(range(1, 17), 9)}
        counts = {n: c for n, c in counts.items() if c}
        found = windows.combinations(list(counts), 16, 3)
        if not found:
            continue
        a = np.array([[c.count(n) for c in found] for n in counts], float)
        b = np.array(list(counts.values()), float)
        x = np.zeros(len(found))
        found_x = windows.solve(counts, found, 1e-6, sweeps=400)
        got = np.array([found_x.get(s, 0.0) for s in range(len(found))])
        assert (got >= 0).all()
        step = 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):  # projected gradient, to the end
            x = np.maximum(0, x - step * (a.T @ (a @ x - b)))
        assert np.sum((a @ got - b) ** 2) <= np.sum((a @ x - b) ** 2) + 0.05 * (1 + b.sum())


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_token(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64])
    for _ in range(25):
        counts = {n: rng.choice([1, 2, 3, 10, 57]) for n in rng.sample(range(1, window + 1), rng.randint(1, window))}
        plan = windows.Plan(counts, window, rng.choice([1, 2, 3]))
        sizes = covered(plan, counts)
        assert all(s & (s - 1) == 0 and s <= window for s in sizes)
        assert sum(s != window for s in sizes) <= window.bit_length()
        assert sum(sizes) == sum(n * c for n, c in counts.items())


def test_one_length_only():
    for length in (1, 3, 1500, 2047, 2048):
        counts = {length: 1000}
        sizes = covered(windows.Plan(counts), counts)
        assert sum(sizes) == 1000 * length and sum(s != 2048 for s in sizes) <= 11


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 9) for n in range(1, 2049)}
    small, large = (windows.Plan({n: c * k for n, c in counts.items()}) for k in (1, 10_000))
    assert len(large.rules) < 4 * windows.DEPTH ** 2 * windows.WINDOW
    assert large.solved > 0.75 * large.windows  # even with lengths spread evenly the combinations do most of the work


def test_units_give_the_ids_of_the_whole_text():
    model, own = Tokenizer.from_file(PATH), windows.Tokens(PATH)
    assert own.words
    rng = random.Random(2)
    letters = "aB's.,'! 9\n\té́<|>-_tdm𝔘 "
    texts = NASTY + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    flat, ends = own.ids(pa.array(texts, pa.string()), 1)
    for k, text in enumerate(texts):
        assert flat[ends[k] : ends[k + 1]].tolist() == plain(text, model), repr(text)


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), windows.Tokens(path)
    assert not own.words
    flat, ends = own.ids(pa.array(NASTY, pa.string()), 1)
    for k, text in enumerate(NASTY):
        assert flat[ends[k] : ends[k + 1]].tolist() == plain(text, model)


def test_whole_table(spark):
    docs = documents(spark)
    model = Tokenizer.from_file(PATH)
    ids = {r["doc_id"]: np.array(plain(r["text"], model), "<u4") for r in docs.collect()}
    rows = windows.packed(docs, PATH).collect()
    held, pieces = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for groups in (held, pieces):
        for members in groups.values():
            at = 0
            for begin, n in sorted(members):
                assert begin == at
                at += n
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: len(v) for d, v in ids.items()}
    sizes = [sum(n for _, n in m) for m in held.values()]
    assert all(s & (s - 1) == 0 and s <= 2048 for s in sizes) and sum(s < 2048 for s in sizes) <= 11


def test_sequences_hold_the_ids(spark):
    docs = documents(spark).limit(40)
    model = Tokenizer.from_file(PATH)
    ids = {r["doc_id"]: plain(r["text"], model) for r in docs.collect()}
    got = windows.sequences(docs, PATH, window=256).collect()
    for r in got:
        assert len(r["ids"]) <= 256 and sum(p["length"] for p in r["pieces"]) == len(r["ids"])
        for p in r["pieces"]:
            assert r["ids"][p["offset"] : p["offset"] + p["length"]] == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
    assert sum(len(r["ids"]) for r in got) == sum(map(len, ids.values()))


def test_hard_rows(spark):
    docs = hard_docs(spark).withColumns({n: windows.F.lit("x") for n in ("ids", "length", "row", "position", "sequence_id", "offset")})
    got = windows.packed(docs, PATH)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in hard_rows()}
    model = Tokenizer.from_file(PATH)
    assert sum(r["length"] for r in rows) == sum(len(plain(r[1], model)) for r in hard_rows())
    assert sum(r["doc_tokens"] for r in rows if r["doc_id"] == 4 and r["start"] == 0) == 2 * len(plain(LONG, model)) + len(plain("other text with the same id", model))
    assert windows.packed(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        windows.packed(docs, PATH, window=100)
