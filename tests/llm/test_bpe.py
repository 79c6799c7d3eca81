import os
import random

import pytest

from tessella.llm.bpe import DEFAULT_VOCABULARY, Decoder, Encoder, MergeList, Transducer, count_tokens, decode_corpus, encode_corpus

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary here")


def brute_force(merges: MergeList, data: bytes) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    ids = [merges.ids[bytes([b])] for b in data]
    while True:
        best = min(((merges.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges.rank), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i : i + 2] = [merges.ids[merges.bytes_of[ids[i]] + merges.bytes_of[ids[i + 1]]]]


def random_merges(rnd: random.Random) -> MergeList:
    tokens = [bytes([b]) for b in range(256)]
    use = [b"a", b"b", b"c"]
    merges = []
    for _ in range(rnd.randint(1, 14)):
        a, b = rnd.choice(use), rnd.choice(use)
        if a + b not in use and len(a + b) < 12:
            merges.append((a, b))
            use.append(a + b)
            tokens.append(a + b)
    return MergeList({t: i for i, t in enumerate(tokens)}, merges)


def test_transducer_equals_brute_force_on_random_merge_lists():
    rnd = random.Random(7)
    for _ in range(150):
        m = random_merges(rnd)
        for _ in range(12):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60)))
            t = Transducer(m)
            out = []
            for i in range(0, len(data), 7):
                out += t.feed(data[i : i + 7])
            assert out + t.finish() == brute_force(m, data)


def test_memory_stays_constant():
    rnd = random.Random(1)
    m = random_merges(rnd)
    t = Transducer(m)
    out = list(t.feed(b"ab" * 20_000))
    assert t.peak < 3_000 and b"".join(m.bytes_of[i] for i in out + t.finish()) == b"ab" * 20_000
    assert m.sufficient_lookahead() >= m.max_token


@needs_vocabulary
def test_equals_the_public_library_and_round_trips(rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(DEFAULT_VOCABULARY)
    public.encode_special_tokens = True
    texts = ["", None, "   ", "\n\n x", "<|endoftext|>", "don't we'll", "Größe 解析する 🧭🧭", "a" * 5000, "=" * 3000, "x1 22 333  \t\n", "naïve " * 400, "﻿ \u00a0 b"]
    docs = rows("doc_id long, text string, ids string", *((i, t, "clash") for i, t in enumerate(texts)))
    enc = encode_corpus(docs)
    got = {r.doc_id: r.ids for r in enc.collect()}
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode_corpus(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert encode_corpus(docs.filter("doc_id < 0")).count() == 0


def test_decoder_keeps_split_characters():
    m = MergeList({bytes([b]): b for b in range(256)}, [])
    d = Decoder(m)
    assert "".join(d.feed([b]) for b in "é🧭".encode()) + d.finish() == "é🧭"
    assert Encoder(m).encode(None) == []


def test_split_pattern_comes_from_the_file():
    from tessella.llm.bpe import SPLIT, split_pattern

    model = {"type": "BPE", "vocab": {}, "merges": []}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    assert split_pattern({"model": model, "pre_tokenizer": level}) == SPLIT
    own = {"type": "Split", "pattern": {"Regex": "[a-z]+"}, "behavior": "Isolated"}
    assert split_pattern({"model": model, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [own, level | {"use_regex": False}]}}) == "[a-z]+"
    for bad in (
        {"model": model | {"end_of_word_suffix": "</w>"}, "pre_tokenizer": level}, {"model": model, "pre_tokenizer": level, "normalizer": {"type": "Lowercase"}}, {"model": model, "pre_tokenizer": {"type": "Metaspace"}},
        {"model": model, "pre_tokenizer": level | {"use_regex": False}}, {"model": model, "pre_tokenizer": level | {"add_prefix_space": True}}, {"model": model},
    ):
        with pytest.raises(ValueError):
            split_pattern(bad)


def test_a_window_beyond_the_bound_is_an_error():
    from tessella.llm.bpe import WINDOW, MergeList, Transducer

    ids = {bytes([i]): i for i in range(256)} | {b"ab": 256}
    t = Transducer(MergeList(ids, [(b"a", b"b")]))
    assert len(list(t.feed(b"ab" * 5000)) + t.finish()) == 5000 and t.peak <= WINDOW + t.bound
    t = Transducer(MergeList(ids, [(b"a", b"b")]))
    t.bound = 0
    t._settle = lambda: iter(())
    with pytest.raises(RuntimeError, match="more than the merge list can need"):
        list(t.feed(b"ab" * 5000))
