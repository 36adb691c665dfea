"""Token counts, packing and token files against the library and plain Python."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from poolboard.llm import packing, range_coder, token_count, token_file
from poolboard.llm.tokens import WordEncoder, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", None, " ", "\n a\x0bb\x0cc ", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|x", "ΣΑΣ σς", "İstanbul ﬁ",
       "it's'll '''re 're're", "١٢٣ ½", "日本語テキスト", "é ́a", "\x1ca\x1d", "\x85a\xa0b", "word " * 5000, "x" * 3000,
       "🎉🎉👍🏽 ǅ ſ K ß", "\0 a\0b", "password=abc123DEF", "a" * 70 + " " + "!?" * 50]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def some_texts(seed, count):
    rng = random.Random(seed)
    pool = "".join(t for t in ODD if t and len(t) < 200) + " aeiounst.,!"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(count)]


def test_transducer_counts_as_the_library_does(library):
    machine = token_count.Transducer(PATH)
    for text in ODD + some_texts(1, 800):
        assert machine.text((text or "").encode()) == len(ids(library, text)), text


def test_chunk_maps_compose_in_any_cut(library, monkeypatch):
    machine = token_count.Transducer(PATH)
    for size in (1, 3, 17):
        monkeypatch.setattr(token_count, "CHUNK", size)
        for text in ODD[:10] + some_texts(2, 60):
            assert machine.text((text or "").encode()) == len(ids(library, text)), (size, text)


def test_a_small_table_of_transitions_is_made_anew(library, monkeypatch):
    monkeypatch.setattr(token_count, "TRANSITIONS", 40)
    monkeypatch.setattr(token_count, "WORDS", 5)
    machine = token_count.Transducer(PATH)
    for text in some_texts(3, 60):
        assert machine.text(text.encode()) == len(ids(library, text))


def test_word_encoder_equals_the_library(library):
    encoder = WordEncoder(PATH)
    texts = ODD + some_texts(4, 500)
    assert [a.tolist() for a in encoder.encode(texts)] == [ids(library, t) for t in texts]
    assert encoder.encode([]) == []


def test_word_encoder_forgets_and_learns_again(library, monkeypatch):
    from poolboard.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_WORDS", 30)
    monkeypatch.setattr(tokens, "LETTERS", 200)
    encoder = WordEncoder(PATH)
    for texts in (ODD, some_texts(6, 80), ["x" * 5000, "often often rare"], some_texts(6, 80), ODD, [None, ""]):
        assert [a.tolist() for a in encoder.encode(texts)] == [ids(library, t) for t in texts]
        assert len(encoder.words) <= 30 and len(encoder.pool) == encoder.size.sum()
        assert max(map(len, encoder.words.to_pylist())) <= tokens.MEMO_LENGTH


def test_chunks_of_long_texts_are_rows(spark, texts, library):
    rows = [(n, t) for n, t in enumerate(ODD + some_texts(8, 30))] + [(3, ODD[3])] + [(13, ODD[13])] * 2 + [(None, ODD[13])]
    expected = sorted(repr((i, len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > 10)) for i, t in rows)
    for chunk, fan in ((7, 3), (50, 4)):
        found = token_count.token_counts(texts(rows).repartition(3), PATH, 10, chunk=chunk, fan=fan)
        assert sorted(repr(tuple(r)) for r in found.collect()) == expected
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_token_count_rows(spark, texts, library):
    rows = [(n, t) for n, t in enumerate(ODD)] + [(3, ODD[3]), (None, "a b")]
    found = token_count.token_counts(texts(rows), PATH, limit=10).collect()
    assert sorted(map(repr, [tuple(r) for r in found])) == sorted(repr((
        i, len((t or "").encode()), len(ids(library, t)), len(ids(library, t)) > 10)) for i, t in rows)
    assert token_count.token_counts(texts([]), PATH).count() == 0


@pytest.mark.parametrize("open_bins", [1, 2, 8])
def test_bounded_best_fit_against_a_plain_search(open_bins):
    rng = random.Random(open_bins)
    fit, free, order = packing.BestFit(50, open_bins), {}, []
    for _ in range(600):
        length = rng.randint(1, 50)
        number, offset, closed = fit.put(length)
        able = [s for s in free.values() if s >= length]
        if able:
            assert 50 - offset == min(able)
        else:
            assert offset == 0
            if len(free) == open_bins:
                fullest = min(free.values())
                assert free.pop(closed[0]) == fullest
        free[number] = 50 - offset - length
        if not free[number]:
            assert free.pop(number) == 0 and number in closed
        assert len(free) <= open_bins
        order.append(number)


def packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_places_every_piece(spark, texts, library):
    rows = [(n, t) for n, t in enumerate(ODD + some_texts(5, 200))] + [(3, ODD[3]), (None, "a b")]
    found = packing.pack_documents(texts(rows).repartition(5), PATH, capacity=64, open_bins=4).collect()
    expected = []
    for i, t in rows:
        own = np.array([*ids(library, t), 0], dtype="<u4")
        expected += [(i, n, at, len(own[at:at + 64]), zlib.crc32(own[at:at + 64].tobytes()))
                     for n, at in enumerate(range(0, len(own), 64))]
    assert sorted(map(repr, [tuple(r)[:5] for r in found])) == sorted(map(repr, expected))
    assert packed(found, 64) <= 1.1 * sum(r.length for r in found) / 64 + 2
    assert packing.pack_documents(texts([]), PATH).count() == 0


@pytest.mark.parametrize("values", [[], [7], [0] * 5000, list(range(3000)), [1, 2, 3] * 1500, [65535] * 2049])
def test_segments_round_trip(values):
    ids_ = np.array(values, dtype="<u2")
    raw = range_coder.encode_segment(ids_)
    assert range_coder.decode_segment(raw).tolist() == values


def test_random_segments_round_trip_and_repetition_is_small():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 49408, 10_000)
    assert range_coder.decode_segment(range_coder.encode_segment(noise)).tolist() == noise.tolist()
    again = np.tile(noise[:40], 400)
    assert len(range_coder.encode_segment(again)) < len(again) // 4


def test_a_changed_byte_is_noticed():
    raw = bytearray(range_coder.encode_segment(np.arange(4000) % 700))
    raw[-3] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_segment(bytes(raw))


def test_token_files_give_back_every_document(spark, texts, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT", 500)
    rows = [(n, t) for n, t in enumerate(ODD + some_texts(6, 100))] + [(3, ODD[3]), (None, "a b")]
    random.Random(0).shuffle(rows)
    path = str(tmp_path / "ids")
    token_file.write_token_files(texts(rows).repartition(3), path, PATH, parts=4)
    found = token_file.read_token_files(spark, path).orderBy("start").collect()
    start, expected = 0, []
    coded = [(i, np.array([*ids(library, t), 1], dtype="<u4")) for i, t in rows]
    for i, own in sorted(coded, key=lambda r: (r[0] is None, r[0] or 0, r[1].astype("<u2").tobytes())):
        expected.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert [tuple(r) for r in found] == expected


def test_no_documents_give_an_empty_file(spark, texts, tmp_path):
    path = str(tmp_path / "none")
    token_file.write_token_files(texts([]), path, PATH)
    assert token_file.read_token_files(spark, path).count() == 0
