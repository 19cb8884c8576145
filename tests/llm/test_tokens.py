import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import token_files
from lexmill.llm.token_counts import FALLBACK, Trie, token_counts, zipf_pieces
from lexmill.llm.token_files import Block, Encoder, repair, token_digests, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = Tokenizer.from_file(PATH)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


AWKWARD = ["", " ", "  ", "a  b", "a \n b", "a\t b ", " lead", "x<|endoftext|> y", "it's  we'll", "é\u00a0 z", "a \u00a0b", "a \u2003b \u3000c \x85d", "中 文 字", "a\x1c b \x1cc", "🙂 🙂x", "\n\n b", "a " * 40, "x" * 5000]


def test_encoder_on_awkward_texts(encoder):
    ids, counts = encoder([t.encode() for t in AWKWARD], None)
    expected = [MODEL.encode(t, add_special_tokens=False).ids for t in AWKWARD]
    assert counts.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for e in expected for i in e]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '.1 \n\té\u00a0\u2003中🙂<|>")), max_size=25), max_size=5))
def test_encoder_on_any_text(encoder, texts):
    ids, counts = encoder([t.encode() for t in texts], 2)
    assert ids.tolist() == [i for t in texts for i in [*MODEL.encode(t, add_special_tokens=False).ids, 2]]
    assert counts.sum() == len(ids)


def test_encoder_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(token_files, "PIECES_HELD", 3)
    small = Encoder(PATH)
    for t in ("one two three four", "five six one", "two seven", "one one", "six two nine", "one ten", "nine eleven twelve one", "one two"):
        assert small([t.encode()], None)[0].tolist() == MODEL.encode(t, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), max_size=8), st.sampled_from([7, 70_000]), st.integers(1, 5))
def test_grammar_round_trip(docs, base, rounds):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    rules, expanded, symbols, ends = repair(ids, counts, base, rounds, 2)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    row = {"symbol_bytes": width, "base": base, "ids": list(range(len(docs))), "n_tokens": counts.astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "expanded": expanded.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes()}
    block = Block(row)
    for j, d in enumerate(docs):
        assert block.document(j).tolist() == d
        for a in range(0, len(d), 7):
            assert block.part(j, a, min(a + 5, len(d))).tolist() == d[a : a + 5]


def test_grammar_shrinks_repeats():
    ids = np.array([1, 2, 3, 4] * 1000, np.uint32)
    rules, expanded, symbols, ends = repair(ids, np.array([4000]), 10, 6, 2)
    assert len(symbols) < 300 and int(expanded.max()) >= 16 and ends.tolist() == [len(symbols)]


def digests(rows):
    out, at = [], 0
    for i, t in rows:
        ids = [*MODEL.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(docs, rows):
    got = [tuple(r) for r in token_digests(docs, PATH, block_tokens=5000).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    in_order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    nulls = [r for r in in_order if r[0] is None]
    expected = [digests([(r[0], r[1]) for r in order + in_order[len(nulls) :]]) for order in (nulls, nulls[::-1])]
    assert got in expected


def test_empty_table(no_docs):
    assert token_digests(no_docs, PATH).collect() == []


def test_blocks_hold_what_they_say(docs, tmp_path):
    write_tokens(docs, str(tmp_path / "t"), PATH, block_tokens=5000)
    for row in ds.dataset(str(tmp_path / "t")).to_table().to_pylist():
        block = Block(row)
        assert row["total"] == block.n_tokens.sum() == len(block.expand(block.symbols)) and row["first"] == row["ids"][0]


def brute_count(pieces, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * FALLBACK, best[end - 1][1] - size)]
        options += [(best[b][0] + pieces[word[b:end]], best[b][1] - 1) for b in range(end) if word[b:end] in pieces]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abcé中", max_size=12), max_size=12), st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=4), st.integers(-9, -1).map(float)))
def test_trie_against_brute_force(words, pieces):
    ordered = sorted(words)
    assert Trie(pieces).counts(ordered) == [brute_count(pieces, w) for w in ordered]


def test_token_counts(docs, rows, no_docs):
    pieces = zipf_pieces(PIECES)
    memo: dict = {}
    count = lambda w: memo.setdefault(w, brute_count(pieces, f"▁{w}") if len(w) < 1000 else None)
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(docs, PIECES).collect()), key=str)
    expected = []
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        expected.append((r[0], len(words), sum(count(w) if len(w) < 1000 else Trie(pieces).counts([f"▁{w}"])[0] for w in words)))
    assert got == sorted(expected, key=str)
    assert token_counts(no_docs, PIECES).collect() == []


def test_first_round_replaces_every_frequent_pair():
    """Many distinct pairs that share hash slots, each as frequent: one round makes a rule of each."""
    pairs = np.random.default_rng(1).integers(0, 50_000, (3000, 2))
    ids = np.tile(pairs, (30, 1)).reshape(-1)
    rules, _, symbols, _ = repair(ids, np.full(len(ids) // 2, 2), 50_000, rounds=1)
    assert set(map(tuple, rules.tolist())) == set(map(tuple, pairs.tolist()))
    assert len(symbols) == len(ids) // 2


def left_over(symbols, ends):
    """The most frequent pair that is left, and how often it occurs."""
    closed = set((ends - 1).tolist())
    pairs = Counter((int(a), int(b)) for i, (a, b) in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if i not in closed)
    return pairs.most_common(1)[0][1] if pairs else 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=80), max_size=8), st.integers(2, 6))
def test_no_frequent_pair_is_left(docs, least):
    counts = np.array([len(d) for d in docs], np.int64)
    _, _, symbols, ends = repair(np.array([x for d in docs for x in d], np.uint32), counts, 7, None, least)
    assert left_over(symbols, ends) < least


@pytest.mark.parametrize("base", [50_257, 65_400, 70_000])
def test_no_frequent_pair_is_left_in_a_block(base):
    """Ids of a skewed law, more rules than two bytes can name for the second base."""
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, 150_000) - 1, 50_000).astype(np.uint32)
    counts = np.full(1500, 100)
    rules, expanded, symbols, ends = repair(ids, counts, base, None, 6)
    assert left_over(symbols, ends) < 6 and expanded.min() >= 2
    width = 2 if base + len(rules) <= 1 << 16 else 4
    assert width == (2 if base == 50_257 else 4)
    block = Block({"symbol_bytes": width, "base": base, "ids": list(range(1500)), "n_tokens": counts.astype("<u4").tobytes(), "ends": ends.astype("<u4").tobytes(), "rules": rules.astype(f"<u{width}").tobytes(), "expanded": expanded.astype("<u4").tobytes(), "symbols": symbols.astype(f"<u{width}").tobytes()})
    assert (block.expand(block.symbols) == ids).all()


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that knows only lengths, ids are still the tokenizer's."""
    monkeypatch.setattr(token_files, "run_hashes", lambda data, starts, ends, values: (ends - starts).astype(np.uint64))
    small = Encoder(PATH)
    for texts in (["one two six ten"], ["abc abd"], ["ten six", "two one abc", ""]):
        ids, counts = small([t.encode() for t in texts], 2)
        assert ids.tolist() == [i for t in texts for i in [*MODEL.encode(t, add_special_tokens=False).ids, 2]] and len(counts) == len(texts)


def test_another_pre_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    model, other = Tokenizer.from_file(path), Encoder(path)
    assert not other.by_pieces and Encoder(PATH).by_pieces
    texts = ["It's  a Test", "", "\n x y"]
    ids, counts = other([t.encode() for t in texts], None)
    assert ids.tolist() == [i for t in texts for i in model.encode(t, add_special_tokens=False).ids] and counts[1] == 0


def test_pairs_are_found_by_their_slots():
    """Few keys are left to bisection, and pairs that share a slot are told apart."""
    from lexmill.llm.token_files import SLOTS, _places, _slots

    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 50_000, (2, 60_000)).astype(np.uint32)
    keys = (left.astype(np.uint64) << np.uint64(32)) | right
    pairs = np.unique(keys[:20_000])
    home = _slots((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    assert len(np.unique(home)) < len(home) <= SLOTS
    rows = {k: i for i, k in enumerate(pairs.tolist())}
    assert _places(pairs, keys, home, _slots(left, right)).tolist() == [rows.get(k, -1) for k in keys.tolist()]
