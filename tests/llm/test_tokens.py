import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from taxaflow.llm import queries
from taxaflow.llm.bpe import Transducer, Utf8Machine, codec, decode, encode
from taxaflow.llm.elias_fano import EliasFano
from taxaflow.llm.token_files import WordEncoder, read_ids, write_ids

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
POOL = ["a", "b", " ", "\n", "é", "ñ", "日", "🙂", "the", "ing", "1", "...", "\t", "́", "Th", "\r", "'s", "'ll", "ß", "\x00", "İ.", " ", "<|endoftext|>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_transducer_equals_the_library():
    own = codec(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text in [*texts(3000), "a" * 5000, " " * 3000, "=" * 2500, "thing" * 1500]:
        ids = np.frombuffer(own.encode(text), "<i4").tolist()
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text


def test_transducer_forgets_states_without_changing_results():
    own = codec(RANKS, P.PATTERN)
    small = Transducer(own.ranks, most=20)
    for text in texts(200, 5):
        assert small.run(text.encode()) == own.transducer.run(text.encode())


def test_utf8_machine_in_pieces():
    rng = random.Random(2)
    pool = [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xF4, 0x90, 0xE0, 0xC0]
    for _ in range(5000):
        data = bytes(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        cut, machine = rng.randint(0, len(data)), Utf8Machine()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.close() == data.decode(errors="replace")


def test_op7(spark, folder, rows):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec(RANKS, P.PATTERN).ranks, special_tokens={})
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op7_bpe(spark, folder).collect()), key=str) == sorted(want, key=str)


def test_columns_encode_and_decode(docs, empty):
    coded = docs.select("text", decode(encode("text", RANKS, P.PATTERN), RANKS, P.PATTERN).alias("back")).collect()
    assert all((r.text or "") == r.back for r in coded)
    assert empty.select(encode("text", RANKS, P.PATTERN)).collect() == []


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (1, 1 << 62), (1000, 1000), (3000, 10**7), (2000, 1 << 60), (2000, 100)):
        values = np.sort(rng.integers(0, most, n)).astype(np.uint64)
        back, _ = EliasFano.from_bytes(b"xx" + EliasFano.of(values).to_bytes(), 2)
        assert (back.values() == values).all()
        assert all(back.select(i) == int(values[i]) for i in range(n))
    assert len(EliasFano.of(np.arange(0, 10**6, 100, dtype=np.uint64)).to_bytes()) * 8 < 10_000 * 11


def test_word_encoder_equals_the_library():
    own, library = WordEncoder(WORDS, most=500), Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    sample = [*texts(4000, 3), "İ. x", "don'. can't!!", "é́.é"]
    coded = own.encode([x.encode() for x in sample], 2)
    assert [np.frombuffer(x, own.kind).tolist() for x in coded] == [x.ids + [2] for x in library.encode_batch(sample, add_special_tokens=False)]


def test_plain_words_go_to_the_library_as_one_text():
    class Counting:
        texts = 0

        def __init__(self, tokenizer):
            self.encode_batch_fast = lambda texts, **k: setattr(self, "texts", self.texts + len(texts)) or tokenizer.encode_batch_fast(texts, **k)

    own, library = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    own.tokenizer = Counting(own.tokenizer)
    rng = random.Random(8)
    words = ["".join(rng.choice("abzÀÖØÝÞßéöøÿ×÷ªAZ") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "$$$"]) for _ in range(3000)]
    plain = [w for w in words if not set(w) & set("×÷ª")]
    coded = own.encode([" ".join(plain).encode()], 2)[0]
    assert np.frombuffer(coded, own.kind).tolist() == library.encode(" ".join(plain), add_special_tokens=False).ids + [2]
    assert own.tokenizer.texts < 10
    coded = own.encode([" ".join(words).encode()], 2)[0]
    assert np.frombuffer(coded, own.kind).tolist() == library.encode(" ".join(words), add_special_tokens=False).ids + [2]


def expected_files(rows):
    library, start, want = Tokenizer.from_file(WORDS), 0, []
    library.encode_special_tokens = True
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return want


def test_op6(spark, folder, rows):
    got = sorted(map(tuple, queries.op6_token_files(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected_files(rows)


def test_many_small_blocks_and_none(spark, docs, rows, empty, tmp_path):
    write_ids(docs, str(tmp_path / "a"), WORDS, 2, block_ids=50)
    assert sorted(map(tuple, read_ids(spark, str(tmp_path / "a")).collect()), key=lambda r: r[1]) == expected_files(rows)
    write_ids(empty, str(tmp_path / "b"), WORDS, 2)
    assert read_ids(spark, str(tmp_path / "b")).collect() == []
