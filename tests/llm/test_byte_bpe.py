import base64
import gc
import hashlib
import pickle
import random
import weakref

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quillgraph.llm.byte_bpe import NO_PAIR, ByteBpe, PairTable, PerfectHash, _begins, _kinds, codec, decode_documents, encode_documents, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(5000))
    assert sorted(table.values) == list(range(5000)) and table.n == 5000
    assert table.find(b"absent") == -1 and PerfectHash([]).find(b"x") == -1


def test_same_ids_as_the_library(bpe, peer):
    rng = random.Random(5)
    alphabet = "ab c's 'll12\n\t\r   　é中😀.,!?-_\x1c\x85  "
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        ids = bpe.encode(text)
        assert ids == peer.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_words_merged_side_by_side(bpe, peer):
    """Many texts at once give the ids of the library, without merging short words one by one."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßж中") for _ in range(rng.randrange(1, 30))) + rng.choice(["", "", ".", ",", "!", "7"])
    texts = [rng.choice([" ", " ", "  ", " \n"]).join(word() for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "a", "x " + "y" * 3000, "of the of"]
    for memo in (700_000, 20):
        own = ByteBpe(open(PATH, "rb").read(), public_tokenizers.PATTERN, memo_entries=memo)
        assert list(own.packed_all(texts)) == [bpe.packed(t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.packed_all(texts)] == [peer.encode_ordinary(t) for t in texts]
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(500))]
    own, merged = codec(PATH, public_tokenizers.PATTERN), []
    own.merge = lambda raw, merge=own.merge: merged.append(raw) or merge(raw)
    list(own.packed_all(plain))
    assert len(merged) <= 1  # the first word


def test_many_texts_are_encoded_by_columns(peer):
    """No pre-token of many texts is cut by the pattern or merged on its own, whatever stands beside it."""
    rng = random.Random(8)
    ends = ["", "", ".", ",", "$$$", "'s", "'ll've", "!'t", ".\n", "...\n\n ", "12", " 　", "\x85", "é中😀", " | ", "'r", "''d"]
    words = ["".join(rng.choice("abcdefghéß中") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(30))) for _ in range(400)]
    texts += ["'", "s", "'", "re", "'l", "l", " ", "'s", "", "x ", " y", "\n", "\n'm", "  ", "'ve"]  # nothing goes over the end of a text
    own = codec(PATH, public_tokenizers.PATTERN)
    own.pattern = own.merge = own._pieces = own._token = None
    got = [np.frombuffer(x, "<u4").tolist() for x in own.packed_all(texts)]
    assert got == [peer.encode_ordinary(t) for t in texts]


def test_pre_tokens_of_a_column_are_those_of_the_pattern(bpe, monkeypatch):
    rng = random.Random(9)
    alphabet = "ab  c'''stmdrevlLS12٣½\n\r\t　 \xa0\x1c\x85é中😀.,_́ "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(20_000)]
    want = [bpe.packed(t) for t in texts]
    assert list(bpe.packed_all(texts)) == want
    monkeypatch.setattr("quillgraph.llm.byte_bpe.AT_ONCE", 100)  # the parts change nothing
    monkeypatch.setattr("quillgraph.llm.byte_bpe.SIDE_BY_SIDE", 3)
    assert list(bpe.packed_all(texts[:2000])) == want[:2000]
    assert list(bpe.packed_all([])) == [] and list(bpe.packed_all(["", ""])) == [b"", b""]
    other = ByteBpe(open(PATH, "rb").read(), r"\w+|\W")  # a pattern that isn't cut by columns
    assert list(other.packed_all(["ab' c", "d's"])) == [other.packed("ab' c"), other.packed("d's")]


def test_characters_of_all_kinds_are_cut_as_by_the_pattern(bpe):
    """Every character beside a letter, a number, a mark and white space."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{c}1{c}.{c}\n{c} {c}" for c in every)
    points, first = np.frombuffer(f"{text}\0\0".encode("utf-32-le"), "<u4"), np.zeros(len(text) + 2, bool)
    first[[0, len(text)]] = True
    assert _begins(points, first, _kinds()).tolist() == [m.start() for m in bpe.pattern.finditer(text)]


def test_pair_table_finds_all_and_nothing_else():
    rng = random.Random(7)
    pairs = {rng.randrange(60) << 32 | rng.randrange(60): i for i in range(2000)}
    table = PairTable(pairs)
    left, right = np.divmod(np.arange(3600), 60)
    assert table.find(left, right).tolist() == [pairs.get(a << 32 | b, NO_PAIR) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert PairTable({}).find(left, right).tolist() == [NO_PAIR] * 3600


def test_long_pre_tokens(bpe, peer):
    for text in ("a" * 5000, "abc" * 700, "\n" * 400, " " * 999 + "x", "ünï" * 300):
        assert bpe.encode(text) == peer.encode_ordinary(text)


def test_memo_may_overflow(peer):
    with open(PATH, "rb") as f:
        from quillgraph.llm.byte_bpe import ByteBpe

        small = ByteBpe(f.read(), public_tokenizers.PATTERN, memo_entries=3)
    text = "some words, and more words. And yet more words"
    assert small.encode(text) == peer.encode_ordinary(text)


def test_operators(bpe, peer, rows, clashing, no_docs):
    got = round_trip(clashing, bpe).collect()
    want = []
    for doc, text, *_ in rows:
        ids = peer.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert round_trip(no_docs, bpe).count() == 0
    encoded = encode_documents(clashing, bpe)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in decode_documents(encoded, bpe).collect()}
    assert back == {doc: text or "" for doc, text, *_ in rows}


def test_dropped_codec_goes_at_once(bpe):
    """Without the collector: a Python worker drops a stage's codec before it loads what the next stage sends."""
    own = pickle.loads(pickle.dumps(bpe))
    own.encode("some words, zzyzxq unheard-of  ones\n and 12 more")
    assert own.plain and own.spaced
    gone, memo = weakref.ref(own), weakref.ref(own.spaced)
    gc.disable()
    try:
        del own
        assert gone() is None and memo() is None
    finally:
        gc.enable()
